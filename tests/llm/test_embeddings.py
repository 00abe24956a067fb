import numpy as np
import pandas as pd
import pytest

from doorclock.llm import embeddings as E

SCHEMA = "vec_id long, embedding array<float>, label int"


def by_hand(rows, threshold=0.93):
    """Links and components of rows with distinct ids."""
    def usable(v, label):
        return label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)

    units = {i: np.array(v, float) / np.linalg.norm(np.array(v, float)) if usable(v, label) else None for i, v, label in rows}
    labels = {i: label for i, _, label in rows}
    near = {i: [j for j in units if j != i and units[i] is not None and units[j] is not None and labels[i] == labels[j]
                and len(units[i]) == len(units[j]) and units[i] @ units[j] >= threshold] for i in units}
    root = {i: i for i in units}
    for _ in units:
        for i in units:
            root[i] = min([root[i], *(root[j] for j in near[i])])
    return {i: (len(near[i]), root[i]) for i in units}


def close_rows(n, dims=32, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(8, dims))
    # Spread so that cosines lie on both sides of the threshold.
    return [(int(i), (centres[i % 8] + rng.normal(size=dims) * rng.choice([0.05, 0.2, 0.28])).astype(np.float32).tolist(), int(i % 3)) for i in range(n)]


def test_recall_and_precision_at_the_threshold(spark):
    rows = close_rows(400)
    got = {r.vec_id: (r.n_links, r.component_id) for r in E.linked(spark.createDataFrame(rows, SCHEMA)).collect()}
    want = by_hand(rows)
    found, there = sum(v[0] for v in got.values()), sum(v[0] for v in want.values())
    assert there > 1000 and all(got[i][0] <= want[i][0] for i in want)
    assert found >= 0.99 * there


def test_blocks_meet_all_pairs_of_a_cluster(spark):
    rows = [(i, (np.eye(16)[0] + np.random.default_rng(i).normal(size=16) * 0.01).tolist(), 1) for i in range(150)]
    got = E.linked(spark.createDataFrame(rows, SCHEMA), E.Settings(chunk=20)).collect()
    assert {(r.n_links, r.component_id, r.kept) for r in got} == {(149, 0, False), (149, 0, True)}


def test_bounds_hold_and_estimates_are_unbiased():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 64))
    y = x + rng.normal(size=(600, 64)) * rng.uniform(0, 2, (600, 1))
    x, y = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in (x, y))
    true = (x * y).sum(1)
    left, right = (pd.DataFrame({k: list(v) for k, v in E.encoded(u, 1).items()}) for u in (x, y))
    assert (E.upper_bounds(left, right, 64, 6.0) >= true).all()
    middle = E.upper_bounds(left, right, 64, 0.0) - right["step"].to_numpy() / 2 / left["factor"].to_numpy()
    assert abs((middle - true).mean()) < 0.02


def test_odd_rows(spark):
    v = [1.0, 2.0, 3.0]
    rows = [
        (1, v, 1), (2, [2.0, 4.0, 6.0], 1), (2, [2.0, 4.0, 6.0], 1), (3, v, 2), (4, v, None), (5, None, 1), (6, [], 1), (7, [0.0] * 3, 1),
        (8, [1.0, None, 3.0], 1), (9, [float("nan"), 1.0, 1.0], 1), (10, [float("inf"), 1.0, 1.0], 1), (None, v, 1), (11, v, 1), (12, [1.0, 2.0], 1),
        (13, [-1.0, -2.0, -3.0], 1),
    ]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' as kept", "1 as node", "2 as n_links", "map('a', 1) as tags")
    got = E.linked(df).collect()
    assert len(got) == len(rows)
    by_id = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got}
    assert by_id[1] == (2, 1, True) and by_id[2] == (2, 1, False) and by_id[11] == (2, 1, False)
    assert by_id[None] == (0, None, True)
    assert all(by_id[i] == (0, i, True) for i in (3, 4, 5, 6, 7, 8, 9, 10, 12, 13))
    assert E.linked(df.limit(0)).collect() == []


@pytest.mark.parametrize("n", [2, 1000, 10**6])
def test_bands_keep_the_promised_miss(n):
    bits, bands = E.band_shape(n)
    share = (1 - np.arccos(0.93) / np.pi) ** bits
    assert (1 - share) ** bands < 1e-4 and 2**bits >= min(n, 2**46)


def leaning_rows(n, links, dims=768, lean=0.6):
    """Vectors of one label with a common direction; the last ones are links of others, near the threshold."""
    rng = np.random.default_rng(5)

    def unit(x):
        return x / np.linalg.norm(x, axis=-1, keepdims=True)

    x = unit(np.sqrt(lean) * unit(rng.normal(size=dims)) + np.sqrt(1 - lean) * unit(rng.normal(size=(n, dims))))
    x[n - links:] = unit(x[n - 2 * links : n - links] + 0.37 * unit(rng.normal(size=(links, dims))))
    return [(i, v.astype(np.float32).tolist(), 1) for i, v in enumerate(x)]


@pytest.mark.parametrize("n, chunk", [(600, 1024), (120, 8)])
def test_recall_with_a_common_direction(spark, n, chunk):
    rows = leaning_rows(n, n // 4)
    x = np.array([v for _, v, _ in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = dict(enumerate(((x @ x.T >= 0.93).sum(1) - 1).tolist()))
    got = {r.vec_id: r.n_links for r in E.linked(spark.createDataFrame(rows, SCHEMA), E.Settings(chunk=chunk)).collect()}
    assert (sum(got.values()), sum(want.values())) == (n // 2, n // 2)
    assert got == want


@pytest.mark.parametrize("lean", [0.0, 0.5])
def test_candidates_without_links_make_no_group(spark, monkeypatch, lean):
    """A label without a link: whatever shares buckets, no group is formed whose pairs would all be met."""
    rng = np.random.default_rng(8)

    def unit(x):
        return x / np.linalg.norm(x, axis=-1, keepdims=True)

    x = unit(np.sqrt(lean) * unit(rng.normal(size=64)) + np.sqrt(1 - lean) * unit(rng.normal(size=(1500, 64))))
    rows = [(i, v.astype(np.float32).tolist(), 1) for i, v in enumerate(x)]
    grouped, real = [], E.chunked

    def chunked(members, size, *keys):
        grouped.append(members.count())
        return real(members, size, *keys)

    monkeypatch.setattr(E, "chunked", chunked)
    got = E.linked(spark.createDataFrame(rows, SCHEMA)).collect()
    links = int((x @ x.T >= 0.93).sum() - len(x)) // 2
    assert sum(r.n_links for r in got) == 2 * links
    assert grouped[0] <= 2 * links and links < 5
