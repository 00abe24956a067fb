"""Shared steps of the near-duplicate operators: buckets to candidate clusters, links to components.

Nodes are named by long ids. A bucket joins its members to its least one only, so a bucket of any
size gives one row per member. Pairs are formed inside tasks, block by block, and never leave them:
a block reports links that span its components.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doorclock.plans.staging import dropped, staged


def spokes(buckets: DataFrame) -> DataFrame:
    """(bucket, a, b), a < b: every member b of a `bucket` with the bucket's least `node` a."""
    hubs = buckets.groupBy("bucket").agg(F.min("node").alias("a"), F.max("node").alias("_most")).where("a < _most")
    return buckets.join(hubs.drop("_most"), "bucket").where("a < node").select("bucket", "a", F.col("node").alias("b"))


def stars(buckets: DataFrame) -> DataFrame:
    """Distinct (a, b) of `spokes`."""
    return spokes(buckets).select("a", "b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of links (a, b); component is its least reachable node.

    Each round points every node's larger neighbours, then the node itself, at its least neighbour;
    paths shrink exponentially, and every round is written, so that neither plan nor lineage grows.

    A node may have very many neighbours. Its least one comes from partial minima, written, and is joined to
    the edges in a step of its own, whose large partitions Spark can split.
    """
    edges = staged(
        links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), "links"
    )
    mark = None
    while True:
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark or not now[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        mark = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = staged(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = staged(large, "links")
        nearer = staged(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(nearer, "u").select(F.explode(F.array(
            F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v"))
        )).alias("e")).select("e.u", "e.v").where("u > v").distinct()
        spent, edges = [edges, least, large, nearer], staged(small, "links")
        for table in spent:
            dropped(table)


def chunked(members: DataFrame, size: int, *keys: str) -> DataFrame:
    """Add `n_chunks` of about `size` nodes and the node's `chunk` to members of a group `keys`."""
    counts = members.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return members.join(counts, list(keys)).withColumn("n_chunks", F.ceil(F.col("_n") / size).cast("int")).withColumn(
        "chunk", F.pmod(F.xxhash64("node"), F.col("n_chunks")).cast("int")
    ).drop("_n")


def paired(members: DataFrame) -> DataFrame:
    """A row for each pair of chunks (`left` <= `right`) that the member's chunk is part of."""
    other = F.explode(F.sequence(F.lit(0), F.col("n_chunks") - 1)).alias("_other")
    return members.select("*", other).withColumns(
        {"left": F.least("chunk", "_other"), "right": F.greatest("chunk", "_other")}
    ).drop("_other")


def parted(members: DataFrame, size: int) -> DataFrame:
    """Blocks (bucket, left, right) in which members (bucket, node, part) of unlike parts meet.

    Buckets of one part go. In the others the largest part is dealt into chunks of about `size` nodes apart
    from the rest, whose chunks meet each other and those of the largest part.
    """
    counts = members.groupBy("bucket", "part").agg(F.count(F.lit(1)).alias("n"))
    tops = counts.groupBy("bucket").agg(F.max(F.struct("n", "part")).alias("top"), F.sum("n").alias("n")).where("top.n < n")
    one = F.col("n") <= size
    outer = F.when(one, 1).otherwise(F.ceil((F.col("n") - F.col("top.n")) / size)).cast("int")
    inner = F.when(one, 0).otherwise(F.ceil(F.col("top.n") / size)).cast("int")
    tops = tops.select("bucket", F.col("top.part").alias("_top"), outer.alias("_outer"), inner.alias("_inner"))
    inside = (F.col("part") == F.col("_top")) & (F.col("_inner") > 0)
    place = F.xxhash64("node")
    dealt = members.join(tops, "bucket").withColumns({
        "chunk": F.when(inside, F.col("_outer") + F.pmod(place, "_inner")).otherwise(F.pmod(place, "_outer")).cast("int"),
        "_last": F.when(inside, F.col("_outer")).otherwise(F.col("_outer") + F.col("_inner")) - 1,
    })
    other = F.explode(F.sequence(F.lit(0), F.col("_last"))).alias("_other")
    return dealt.select("bucket", "node", "part", "chunk", other).select(
        "bucket", "node", "part", "chunk", F.least("chunk", "_other").alias("left"), F.greatest("chunk", "_other").alias("right")
    )


def complete_groups(batches: Iterable[pd.DataFrame], keys: list[str]) -> Iterator[tuple[tuple, pd.DataFrame]]:
    """Groups of a partition that is sorted by `keys`, each whole though batches may cut it."""
    held: list[pd.DataFrame] = []
    held_key = None
    for batch in batches:
        if not len(batch):
            continue
        values = [batch[k].to_numpy() for k in keys]
        change = np.zeros(len(batch) - 1, bool)
        for v in values:
            change |= v[1:] != v[:-1]
        cuts = [0, *(np.flatnonzero(change) + 1).tolist(), len(batch)]
        for start, end in zip(cuts[:-1], cuts[1:], strict=True):
            key = tuple(v[start] for v in values)
            if held and key != held_key:
                yield held_key, pd.concat(held, ignore_index=True) if len(held) > 1 else held[0]
                held = []
            held_key = key
            held.append(batch.iloc[start:end])
    if held:
        yield held_key, pd.concat(held, ignore_index=True) if len(held) > 1 else held[0]


def gathered(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Batches of a partition that is sorted by `keys`, cut only between groups."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        new = (batch[keys] != batch[keys].iloc[-1]).any(axis=1).to_numpy()
        begins = int(new.sum())  # where the batch's last group begins
        if held and (begins or (held[-1][keys].iloc[-1] != batch[keys].iloc[-1]).any()):
            yield pd.concat([*held, batch.iloc[:begins]], ignore_index=True)
            held = []
        elif begins:
            yield batch.iloc[:begins].reset_index(drop=True)
        held.append(batch.iloc[begins:])
    if held:
        yield pd.concat(held, ignore_index=True)


def block_pairs(keys: np.ndarray, at_once: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j), i < j, of all rows with equal `keys` (rows, columns), which are sorted; about `at_once` at a time."""
    ends = np.append(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1, len(keys))
    places = np.arange(len(keys))
    after = ends[np.searchsorted(ends, places, "right")] - places - 1
    upto = np.cumsum(after)
    start = 0
    while start < len(keys):
        end = max(int(np.searchsorted(upto, upto[start] - after[start] + at_once, "right")), start + 1)
        n = after[start:end]
        i = np.repeat(places[start:end], n)
        yield i, i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
        start = end


class Forest:
    """Disjoint sets over 0..n-1 that remember the links which joined them."""

    def __init__(self, n: int):
        self.parent = list(range(n))
        self.links: list[tuple[int, int]] = []

    def root(self, i: int) -> int:
        parent = self.parent
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def join(self, i: int, j: int) -> bool:
        a, b = self.root(i), self.root(j)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        self.links.append((i, j))
        return True
