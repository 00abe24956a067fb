import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from doorclock.llm import phrases, ranks


def by_hand(rows, mining):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            words = [w for w in re.split("[\x20\x09]+", piece) if w]
            n[lang] += len(words)
            for k in range(1, 5):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, own in f.items():
        frequent = {p: a for p, a in own.items() if len(p) > 1 and a >= mining.support}
        found = []
        for p, a in frequent.items():
            longer = [
                b for q, b in frequent.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
            ]
            if any(100 * b >= mining.inside_percent * a for b in longer):
                continue
            cuts = [(2_000_000 * a // (own[p[:k]] + own[p[k:]]), k, own[p[:k]], own[p[k:]]) for k in range(1, len(p))]
            score, _, left, right = min(cuts)
            found.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, p, left, right) in enumerate(sorted(found)[: mining.most]):
            out.append((lang, rank + 1, p.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def corpus(n=150, seed=4):
    rng = random.Random(seed)
    words = ["of", "The", "the", "New", "york", "é", "x\x00y", "#", "日本", "a-b", "\x1cz"]
    rows = []
    for _ in range(n):
        parts = [rng.choice(["New york city hall", "of the", *words]) for _ in range(rng.choice([0, 2, 15, 60]))]
        rows.append((rng.choice([" ", "  ", " \t"]).join(p + rng.choice(["", "", "", ".", ",\n", "\r\n"]) for p in parts), rng.choice(["en", "en", "fr", None, "", "und"])))
    return rows + [(None, "en"), ("", None), (" . ", "it")] + rows[:2]


SMALL = phrases.Mining(support=5, shards=3, most=15, word_bits=12, phrase_bits=16)


def check(spark, rows, mining, parts=4):
    df = spark.createDataFrame(rows, "text string, lang string").repartition(parts)
    got = phrases.collocations(df, mining)
    assert dict(got.dtypes) == {"lang": "string", "phrase": "string", **dict.fromkeys(("rank", "a", "l", "r", "n", "score"), "bigint")}
    assert sorted(tuple(r) for r in got.collect()) == by_hand(rows, mining)


def test_equals_brute_force(spark):
    check(spark, corpus(), SMALL)


@pytest.mark.parametrize("mining", [
    phrases.Mining(support=5, shards=1, word_bits=8, phrase_bits=9),  # nearly all bits are set
    phrases.Mining(support=8, shards=20, inside_percent=50),
    phrases.Mining(support=1, shards=2),
])
def test_any_parameters(spark, mining):
    check(spark, corpus(60, 5), mining)


def test_counts_passed_on_early(spark, monkeypatch):
    for name, size in (("HELD_WORDS", 3), ("HELD_ROWS", 4), ("SLICE_BYTES", 50)):
        monkeypatch.setattr(phrases, name, size)
    check(spark, corpus(60, 6), SMALL)


def test_odd_rows_and_no_rows(spark, odd_documents, no_documents):
    rows = [(r.text, r.lang) for r in odd_documents.collect()]
    assert sorted(tuple(r) for r in phrases.collocations(odd_documents, SMALL).collect()) == by_hand(rows, SMALL)
    assert phrases.collocations(no_documents).collect() == []


def test_every_phrase_frequent_as_a_whole_is_so_in_some_shard(spark):
    """The bitmap of the first reading misses none, also with unequal shards."""
    rows = corpus(200, 7)
    df = spark.createDataFrame(rows, "text string, lang string")
    for parts in (1, 3, 16):
        found, _ = phrases.frequent_phrases(df.repartition(parts), phrases.Mining(support=9, shards=5))
        got = {(r.lang, tuple(r.phrase.split(" "))): r.n for r in found.collect()}
        want = {}
        for lang in ("en", "fr", "", "it", "und"):
            f = Counter()
            for text, own in rows:
                if ("und" if own is None else own) == lang:
                    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
                    for piece in re.split("[.,;:!?\x0a-\x0d]", low):
                        words = [w for w in re.split("[\x20\x09]+", piece) if w]
                        for k in range(1, 5):
                            f.update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
            want |= {(lang, p): a for p, a in f.items() if a >= 9}
        assert got == want


def test_bitmap_holds_all_keys(spark):
    keys = np.random.default_rng(1).integers(-(2**63), 2**63, 500)
    df = spark.createDataFrame([(int(k),) for k in [*keys, -1, 0, 2**63 - 1, -(2**63)]], "key long")
    for bits in (10, 15, 18):
        bitmap = phrases._bitmap(df, bits)
        assert len(bitmap) == 2**bits // 8
        assert phrases._known(bitmap, np.array([r.key for r in df.collect()]).view(np.uint64)).all()
        assert np.unpackbits(bitmap).sum() == len({int(k) % 2**64 >> 64 - bits for k in [*keys, -1, 0, 2**63 - 1, -(2**63)]})


def test_scores_beyond_64_bits(spark):
    big = 8_000_000_000_000_000_000
    df = spark.createDataFrame([("en", "a", big), ("en", "b", big + 5), ("en", "a b", big - 3)], "lang string, phrase string, n long")
    assert phrases.scored(df).first().score == 2_000_000 * (big - 3) // (2 * big + 5)


def test_top_rows_of_a_hot_group(spark, monkeypatch):
    monkeypatch.setattr(ranks, "PART_ROWS", 20)
    rows = [("a" if k % 9 else "b", k * 7919 % 1009 // 3, k) for k in range(3000)]
    df = spark.createDataFrame(rows, "g string, v int, k int")
    got = ranks.top_rows(df, ["g"], [F.col("v").desc(), F.col("k").asc()], 10).collect()
    for g in "ab":
        want = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2]))[:10]
        assert [tuple(r)[:3] for r in sorted((r for r in got if r.g == g), key=lambda r: r.rank)] == want
