import random
import re
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from doorclock.llm import divergence

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def counts_of(rows):
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = TERM.findall(lower(text))
        counts[lang, source].update(terms)
        docs[lang].update(set(terms))
    return counts, docs, groups


def by_hand(rows, min_docs=3, top=200):
    counts, docs, groups = counts_of(rows)
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in docs[lang].items() if n >= min_docs]
        own = {s: counts[lang, s] for l, s in groups if l == lang}
        everything = Counter()
        for c in own.values():
            everything.update(c)

        def shares(c):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 1) // (total + len(kept)) for t in kept}

        p, q = {s: shares(c) for s, c in own.items()}, shares(everything)
        for s in own:
            pairs = [(sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o) for o in own if o != s]
            terms = [((p[s][t] - q[t]) ** 2 // q[t], t) for t in kept if own[s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                ordered = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]
                out += [(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(ordered)]
    return sorted(out)


def corpus(n=120, seed=1):
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in ("la", "Ö", "xo", "né") for b in "abcdefgh"] + ["𝄞x", "É", "ſ"]
    rows = []
    for _ in range(n):
        lang = rng.choice(["en", "en", "fr", None, ""])
        source = rng.choice(["s1", "s1", "s1", "s2", "é", None])
        size = rng.choice([0, 1, 3, 30, 200])
        rows.append((" ".join(rng.choices(words, [1 / (k + 1) for k in range(len(words))], k=size)) + rng.choice([".", "1", ""]), lang, source))
    return rows + [(None, "de", "s1"), ("", "de", "s2"), ("x y", "it", "only"), ("x1x2x", "it", "other")] + rows[:3]


def test_audit_equals_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "text string, lang string, source string").repartition(5)
    got = [tuple(r) for r in divergence.audited(df).collect()]
    assert sorted(got) == by_hand(rows)
    assert ("de", "s1", "pair", "s2", 0, 1) in got


@pytest.mark.parametrize("sizes", [(1, 1, 1), (7, 2, 3), (50, 8, 16)])
def test_small_blocks_and_tiles_give_the_same(spark, monkeypatch, sizes):
    for name, size in zip(("CELLS", "ROWS", "COLUMNS"), sizes, strict=True):
        monkeypatch.setattr(divergence, name, size)
    monkeypatch.setattr(divergence, "HELD", 10)
    rows = corpus(60, 2)
    df = spark.createDataFrame(rows, "text string, lang string, source string")
    assert sorted(tuple(r) for r in divergence.audited(df).collect()) == by_hand(rows)


def test_joint_tables(spark):
    rows = corpus(80, 3)
    df = spark.createDataFrame(rows, "text string, lang string, source string").repartition(3)
    cells, _ = divergence.kept_terms(divergence.counted_terms(df), 3)
    got = {tuple(r)[:5]: r.terms for r in divergence.joint_tables(cells).collect()}
    counts, docs, groups = counts_of(rows)
    want = Counter()
    for lang, s in groups:
        for other_lang, o in groups:
            if lang == other_lang and s != o:
                for t in counts[lang, s]:
                    if counts[lang, o][t] and docs[lang][t] >= 3:
                        want[lang, s, counts[lang, s][t], o, counts[lang, o][t]] += 1
    assert got == dict(want)


def test_few_terms_many_levels():
    """Every count of its own: as many columns as cells."""
    rows = [("en", f"t{t:03}", s, 1 + t * 7 + s) for t in range(40) for s in range(5)]
    own = pd.DataFrame(rows, columns=["lang", "term", "source", "n"])
    own["_source"] = own["source"]
    seen = Counter()
    for row, column, stands, source in divergence._blocks(own):
        for i, j, count in divergence._products(row, column, len(stands)):
            for a, b, n in zip(source[i], source[j], count, strict=True):
                seen[int(a), int(b)] += int(n)
    assert seen == {(a, b): 40 for a in range(5) for b in range(5)}


def test_odd_rows_and_no_rows(spark, odd_documents, no_documents):
    rows = [(r.text, r.lang, r.source) for r in odd_documents.collect()]
    assert sorted(tuple(r) for r in divergence.audited(odd_documents).collect()) == by_hand(rows)
    assert divergence.audited(no_documents).collect() == []


def test_shares_are_exact_beyond_64_bits(spark):
    n, total = 9_000_000_000_000_000_000, 9_100_000_000_000_000_000
    df = spark.createDataFrame([(n, total, 77)], "n long, total long, terms long")
    got = df.select(divergence.share(F.col("n"), F.col("total"), F.col("terms"))).first()[0]
    assert got == 1 + 10**9 * (n + 1) // (total + 77)
    assert np.int64(got) == got
