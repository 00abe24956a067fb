import numpy as np
import pandas as pd
import pytest

from doorclock.llm.linking import chunked, complete_groups, components, paired, stars


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = np.random.default_rng(seed)
    n = 60
    links = [(int(a), int(b)) for a, b in rng.integers(0, n, (45, 2))] + [(100 + k, 101 + k) for k in range(20)] + [(5, 5)]
    root = {}
    for a, b in links:
        for x in (a, b):
            root.setdefault(x, x)
    for _ in range(200):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: v for k, v in root.items() if k in got}
    assert set(got) == {x for a, b in links if a != b for x in (a, b)}


def test_components_of_nothing(spark):
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_stars_chunks_and_pairs(spark):
    rows = [(1, 7), (2, 7), (3, 7), (4, 8), (2, 9), (3, 9)]
    got = {(r.a, r.b) for r in stars(spark.createDataFrame(rows, "node long, bucket long")).collect()}
    assert got == {(1, 2), (1, 3), (2, 3)}
    members = chunked(spark.createDataFrame([(k, 0) for k in range(50)], "node long, cluster long"), 10, "cluster")
    assert members.select("n_chunks").distinct().collect()[0][0] == 5
    blocks = {}
    for r in paired(members).collect():
        blocks.setdefault((r.left, r.right), set()).add(r.node)
    met = {frozenset((a, b)) for nodes in blocks.values() for a in nodes for b in nodes if a != b}
    assert len(met) == 50 * 49 // 2


def test_groups_cut_by_batches():
    whole = pd.DataFrame({"k": [1, 1, 1, 2, 3, 3, 3, 3], "v": range(8)})
    for size in (1, 2, 3, 8):
        batches = [whole.iloc[i : i + size] for i in range(0, 8, size)]
        got = [(k, g["v"].tolist()) for (k,), g in complete_groups(batches, ["k"])]
        assert got == [(1, [0, 1, 2]), (2, [3]), (3, [4, 5, 6, 7])]
    assert list(complete_groups([whole.iloc[:0]], ["k"])) == []
