import random
from collections import Counter

import numpy as np
import pytest

from doorclock.llm import minhash as M
from doorclock.llm.shingles import shingle_sets


def shingles(text, width):
    words = (text or "").encode().lower().split()
    if len(words) >= width:
        return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}
    return {tuple(words)} if words else set()


def by_hand(rows, width, percent):
    sets = {i: shingles(t, width) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in ids}


def family(n, words, edits, seed):
    rng = random.Random(seed)
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(words)]
    out = []
    for _ in range(n):
        text = list(base)
        for _ in range(rng.randint(0, edits)):
            text[rng.randrange(words)] = f"x{rng.randint(0, 10**6)}"
        out.append(" ".join(text))
    return out


@pytest.mark.parametrize("settings", [M.QUERY, M.Settings(), M.Settings(width=3, percent=85, bands=36, chunk=7)])
def test_components_equal_brute_force(spark, settings):
    texts = [t for s in range(6) for t in family(12, 150, 9, s)] + family(40, 200, 14, 99)
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in M.verdicts(df, settings).collect()}
    want = by_hand(rows, settings.width, settings.percent)
    assert got == want
    assert len({c for _, c in want.values()}) > 8


def test_estimates_correct_for_chance():
    rng = np.random.default_rng(0)
    pool = rng.integers(0, 2**63, 3000).astype(np.uint64)
    for share in (0.0, 0.3, 0.85):
        a, b = pool[:1000], pool[int(1000 * (1 - 2 * share / (1 + share))) :][:1000]
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        bits = M.packed_bits(M.minima([a, b], M.Settings(bands=100)))
        assert M.estimates(bits[0], bits[1:], 600)[0] == pytest.approx(true, abs=0.08)


@pytest.mark.parametrize("width", [1, 3, 5])
def test_shingle_sets(width):
    texts = ["", " ", "a", "A b", "a b c d", "a b c a b c a b c", "É é\x0bx\x1fy", "x" * 5000 + " y z", "\n\ta\n"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    values, counts = shingle_sets(data, np.array([len(t.encode()) for t in texts]), width)
    assert counts.tolist() == [len(shingles(t, width)) for t in texts]
    assert len(np.unique(values)) == len(set().union(*(shingles(t, width) for t in texts)))
    assert Counter(values.tolist()).total() == counts.sum()


def test_odd_rows(odd_documents, no_documents):
    got = M.verdicts(odd_documents, M.QUERY).collect()
    assert len(got) == odd_documents.count()
    by_id = {}
    for r in got:
        by_id.setdefault(r.doc_id, []).append((r.component_id, r.kept))
    assert by_id[1] == [(1, True)] and by_id[2] == [(1, False)] * 2 and by_id[3] == [(1, False)]
    assert all(by_id[i] == [(i, True)] for i in (4, 5, 6, 7, 8, 10)) and by_id[9] == [(9, True)] * 2
    assert by_id[None] == [(None, True)] * 2
    assert M.verdicts(no_documents).collect() == []


def test_rows_of_one_id_bring_their_sets_together(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(40)) for x in "abc")
    df = spark.createDataFrame([(5, a), (5, b), (5, c), (3, b), (7, c), (9, a)], "doc_id long, text string")
    assert {r.component_id for r in M.verdicts(df).collect()} == {3}


def test_links_that_the_least_member_rejects(spark):
    """A template's documents share buckets with each other; pairs of near copies among them are still found."""
    base = [f"t{k}" for k in range(200)]
    rows = []
    for d in range(60):
        own = [f"own{d}x{k}" for k in range(100)]
        rows += [(2 * d, " ".join(base + own)), (2 * d + 1, " ".join([*base, *own[:-3], "x", f"y{d}", "z"]))]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in M.verdicts(spark.createDataFrame(rows, "doc_id long, text string"), M.QUERY).collect()}
    assert got == by_hand(rows, 3, 85) and got[1][1] == 0 and got[41][1] == 40
