"""Near-duplicate embeddings by randomised-rotation binary codes with stored correction factors.

Unit vectors are turned by fixed random rotations. The signs of a turned vector are its code; the
stored factor, the product of the vector with its code, corrects the code's product with another
vector to an unbiased estimate of the cosine, with a confidence bound of the same factor. Bands of
sign bits bring candidates together, estimates reject pairs whose upper bound is below the
threshold, and all others are computed again in double precision.

A bucket's members first meet its least one: pairs within the bound are computed exactly, and links make
parts. Members that a bucket still holds in different parts then meet each other inside tasks, in chunks of
a large bucket, by bound and then exactly, so that every pair of a bucket either is in one part or was
rejected itself, whatever the least member is like. Groups come from links only, never from
candidates; inside a group all pairs are met once more, block by block, to count links.

Band width follows the largest label (about a quarter of a chance neighbour per bucket), and the
number of bands follows from the width and `miss`, the chance that a pair at the threshold shares
no band. Recall is measured against brute force in the tests.

Ids are whole numbers.

Defined results: a null id, a null label, and a vector that is null, zero, or holds null or
non-finite parts link with nothing; vectors of different lengths are never compared; rows that
repeat an id stand for one vector, the first by label and parts, and get equal results; equal
vectors under different ids are linked; an empty table gives an empty table; extra columns stay, but
those with the name of a result column are replaced by it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doorclock.llm.columns import packed, unpacked
from doorclock.llm.linking import Forest, block_pairs, chunked, complete_groups, components, gathered, paired, parted, spokes
from doorclock.plans.staging import staged

CODE = "node long, code binary, planes binary, low double, step double, factor double"


@dataclass(frozen=True)
class Settings:
    threshold: float = 0.93
    miss: float = 1e-4
    deviations: float = 6.0
    chunk: int = 1024
    pairs_at_once: int = 65536
    seed: int = 11


def band_shape(largest: int, settings: Settings = Settings()) -> tuple[int, int]:
    """(bits of a band, bands) for a largest label of so many vectors."""
    bits = min(max(4, math.ceil(math.log2(max(largest, 2))) + 2), 48)
    share = (1 - math.acos(settings.threshold) / math.pi) ** bits * 0.75
    return bits, math.ceil(math.log(settings.miss) / math.log(1 - share))


def rotation(dims: int, number: int, seed: int) -> np.ndarray:
    """The random orthogonal matrix of that number; the same wherever it is made."""
    q, r = np.linalg.qr(np.random.default_rng([seed, dims, number]).normal(size=(dims, dims)))
    return q * np.sign(np.diag(r))


def band_keys(units: np.ndarray, bits: int, bands: int, seed: int) -> np.ndarray:
    """(vectors, bands): the sign bits of each band as a whole number."""
    dims = units.shape[1]
    turned = [units @ rotation(dims, k, seed).T > 0 for k in range(-(-bits * bands // dims))]
    signs = np.concatenate(turned, 1)[:, : bits * bands].reshape(len(units), bands, bits)
    return signs @ (1 << np.arange(bits, dtype=np.int64))


def encoded(units: np.ndarray, seed: int) -> dict[str, list | np.ndarray]:
    """Code, factor, and the turned vector in 4-bit steps as bit planes, for each unit vector."""
    dims = units.shape[1]
    turned = units @ rotation(dims, 0, seed).T
    code = turned > 0
    factor = np.abs(turned).sum(1) / math.sqrt(dims)
    low, high = turned.min(1), turned.max(1)
    step = np.maximum((high - low) / 15, 1e-12)
    level = np.rint((turned - low[:, None]) / step[:, None]).astype(np.uint8)
    planes = np.concatenate([np.packbits((level >> b) & 1, axis=1) for b in range(4)], 1)
    return {
        "code": [row.tobytes() for row in np.packbits(code, axis=1)],
        "planes": [row.tobytes() for row in planes],
        "low": low, "step": step, "factor": factor,
    }


def upper_bounds(left: pd.DataFrame, right: pd.DataFrame, dims: int, deviations: float) -> np.ndarray:
    """Upper confidence bounds of the cosines of rows: codes of `left`, stepped vectors of `right`."""
    code = np.frombuffer(b"".join(left["code"]), np.uint8).reshape(len(left), -1)
    planes = np.frombuffer(b"".join(right["planes"]), np.uint8).reshape(len(right), 4, -1)
    both = np.bitwise_count(code[:, None] & planes).sum(2, dtype=np.int64) @ (1 << np.arange(4))
    each = np.bitwise_count(planes).sum(2, dtype=np.int64) @ (1 << np.arange(4))
    ones = np.bitwise_count(code).sum(1, dtype=np.int64)
    low, step, factor = right["low"].to_numpy(), right["step"].to_numpy(), left["factor"].to_numpy()
    # Sum over dimensions of (+-1) * (low + step * level), with the code's sign for +-1.
    product = low * (2 * ones - dims) + step * (2 * both - each)
    estimate = product / math.sqrt(dims) / factor
    noise = np.sqrt(np.maximum(1 - factor**2, 0)) / factor / math.sqrt(max(dims - 1, 1))
    return estimate + deviations * noise + step * math.sqrt(dims) / 2 / factor / math.sqrt(dims)


def label_pairs(rows: pd.DataFrame, at_once: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j) of rows that share a block, a label and a size but no part; of two chunks, one in each."""
    keys = rows[["bucket", "left", "right"]].to_numpy()
    part, dims, chunk = (rows[c].to_numpy() for c in ("part", "dims", "chunk"))
    label, _ = pd.factorize(rows["label"])
    two = keys[:, 1] != keys[:, 2]
    for i, j in block_pairs(keys, at_once):
        wanted = (part[i] != part[j]) & (label[i] == label[j]) & (dims[i] == dims[j]) & ~(two[i] & (chunk[i] == chunk[j]))
        if wanted.any():
            yield i[wanted], j[wanted]


def _units(vectors: pd.Series) -> np.ndarray:
    x = np.stack([np.asarray(v, np.float64) for v in vectors])
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def linked(rows: DataFrame, settings: Settings = Settings(), key: str = "vec_id", vector: str = "embedding",
           label: str = "label") -> DataFrame:
    """Every row with `n_links`, `component_id` and `kept`."""
    value = F.col(f"`{vector}`").cast("array<double>")
    one = rows.select(F.col(f"`{key}`").alias("node"), F.struct(F.col(f"`{label}`").alias("label"), value.alias("vector")).alias("v"))
    one = one.where("node is not null").groupBy("node").agg(F.min("v").alias("v")).select("node", "v.label", "v.vector")
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    one = one.where(F.col("label").isNotNull() & finite & F.exists("vector", lambda x: x != 0))
    one = staged(one, "vectors")
    # Copies of a vector are one node of that weight.
    classes = staged(
        one.groupBy("label", "vector").agg(F.min("node").alias("node"), F.count(F.lit(1)).alias("weight")), "vector_classes"
    )
    largest = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    bits, bands = band_shape(largest, settings)
    seed = settings.seed

    def banded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, part in batch.groupby(batch["vector"].map(len)):
                keys = band_keys(_units(part["vector"]), bits, bands, seed)
                yield pd.DataFrame({
                    "node": np.repeat(part["node"].to_numpy(), bands),
                    "group": np.repeat(part["label"].to_numpy(), bands),
                    "size": np.int32(len(part["vector"].iloc[0])),
                    "band": np.tile(np.arange(bands, dtype=np.int32), len(part)),
                    "bits": keys.ravel(),
                })

    def coded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, part in batch.groupby(batch["vector"].map(len)):
                yield pd.DataFrame({"node": part["node"].to_numpy(), **encoded(_units(part["vector"]), seed)})

    named = classes.withColumn("label", F.col("label").cast("string"))
    buckets = named.select("node", "label", "vector").mapInPandas(banded, "node long, group string, size int, band int, bits long")
    buckets = buckets.select("node", F.xxhash64("group", "size", "band", "bits").alias("bucket"))
    codes = staged(classes.select("node", "vector").mapInPandas(coded, CODE), "vector_codes")

    def plausible(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dims, part in batch.groupby("dims"):
                sides = [part[[f"{s}_{c}" for c in ("code", "planes", "low", "step", "factor")]].set_axis(
                    ["code", "planes", "low", "step", "factor"], axis=1) for s in "ab"]
                bound = upper_bounds(sides[0], sides[1], int(dims), settings.deviations)
                yield part.loc[bound >= settings.threshold, ["a", "b"]]

    def side(s: str) -> DataFrame:
        return codes.select(F.col("node").alias(s), *[F.col(c).alias(f"{s}_{c}") for c in ("code", "planes", "low", "step", "factor")])

    sizes = classes.select(F.col("node").alias("a"), F.col("label").alias("_la"), F.size("vector").alias("dims"))
    other = classes.select(F.col("node").alias("b"), F.col("label").alias("_lb"), F.size("vector").alias("_db"))
    met = staged(spokes(buckets), "vector_buckets")
    pairs = met.select("a", "b").distinct().join(sizes, "a").join(other, "b").where("_la = _lb and dims = _db").drop("_la", "_lb", "_db")
    close = staged(pairs.join(side("a"), "a").join(side("b"), "b").mapInPandas(plausible, "a long, b long"), "vector_pairs")

    def exact(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, part in batch.groupby(batch["va"].map(len)):
                near = np.einsum("ij,ij->i", _units(part["va"]), _units(part["vb"])) >= settings.threshold
                yield part.loc[near, ["a", "b"]]

    def vectors(s: str) -> DataFrame:
        return classes.select(F.col("node").alias(s), F.col("vector").alias(f"v{s}"))

    links = staged(close.join(vectors("b"), "b").join(vectors("a"), "a").mapInPandas(exact, "a long, b long"), "vector_links")

    # What the least member of a bucket leaves apart meets there.
    def met_in_buckets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in gathered(batches, ["bucket", "left", "right"]):
            for i, j in label_pairs(group, settings.pairs_at_once):
                for dims in np.unique(group["dims"].to_numpy()[i]):
                    own = group["dims"].to_numpy()[i] == dims
                    a, b = i[own], j[own]
                    bound = upper_bounds(group.iloc[a], group.iloc[b], int(dims), settings.deviations)
                    a, b = a[bound >= settings.threshold], b[bound >= settings.threshold]
                    if not len(a):
                        continue
                    used, at = np.unique(np.concatenate([a, b]), return_inverse=True)
                    units = _units(group["vector"].iloc[used])
                    near = np.einsum("ij,ij->i", units[at[: len(a)]], units[at[len(a) :]]) >= settings.threshold
                    nodes = np.sort(group["node"].to_numpy()[np.stack([a[near], b[near]])], 0)
                    yield pd.DataFrame({"a": nodes[0], "b": nodes[1]}).drop_duplicates()

    parts = staged(components(links).withColumnRenamed("component", "part"), "vector_parts")
    members = met.select("bucket", F.col("b").alias("node")).join(parts, "node", "left")
    members = members.withColumn("part", F.coalesce("part", "node"))
    own = classes.select("node", F.col("label").cast("string").alias("label"), F.size("vector").alias("dims"), "vector")
    keys = ["bucket", "left", "right"]
    apart = parted(members, settings.chunk).join(own, "node").join(codes, "node")
    later = apart.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(met_in_buckets, "a long, b long")
    clusters = staged(components(links.unionByName(later)).withColumnRenamed("component", "cluster"), "vector_clusters")

    # All pairs of a cluster are met block by block, each with its vectors and codes.
    members = chunked(clusters, settings.chunk, "cluster")
    full = paired(members).join(classes.select("node", "vector", "weight"), "node").join(codes, "node")

    def confirmed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for (_, left, right), block in complete_groups(batches, ["cluster", "left", "right"]):
            for counts, links in _block(block, left == right, settings):
                yield pd.DataFrame({"node": counts[0], "other": pd.array([pd.NA] * len(counts[0]), dtype="Int64"), "n": counts[1]})
                yield pd.DataFrame({"node": links[0], "other": pd.array(links[1], dtype="Int64"), "n": np.zeros(len(links[0]), np.int64)})

    keys = ["cluster", "left", "right"]
    found = staged(
        full.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(confirmed, "node long, other long, n long"), "vector_links"
    )
    counts = found.where("other is null").groupBy("node").agg(F.sum("n").alias("n"))
    roots = components(found.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")))
    known = classes.join(counts, "node", "left").join(roots, "node", "left").select(
        "label", "vector", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
        F.coalesce("component", "node").alias("component"),
    )
    known = one.join(known, ["label", "vector"]).select("node", "n_links", "component")
    joined = packed(rows).join(known, F.col("row").getField(key) == F.col("node"), "left")
    own = F.col("row").getField(key)
    return unpacked(joined, rows.columns, {
        "n_links": F.coalesce("n_links", F.lit(0).cast("long")),
        "component_id": F.coalesce("component", own),
        "kept": F.coalesce(F.coalesce("component", own) == own, F.lit(True)),
    })


def _block(block: pd.DataFrame, diagonal: bool, settings: Settings):
    """Weighted link counts per node, and links spanning the block's components."""
    n = len(block)
    nodes, weight, chunk = (block[c].to_numpy() for c in ("node", "weight", "chunk"))
    units = _units(block["vector"])
    counts, forest = np.zeros(n, np.int64), Forest(n)
    if diagonal:
        i, j = np.triu_indices(n, 1)
    else:
        first = np.flatnonzero(chunk == chunk.min())
        rest = np.flatnonzero(chunk != chunk.min())
        i, j = np.repeat(first, len(rest)), np.tile(rest, len(first))
    for at in range(0, len(i), settings.pairs_at_once):
        a, b = i[at : at + settings.pairs_at_once], j[at : at + settings.pairs_at_once]
        bound = upper_bounds(block.iloc[a], block.iloc[b], units.shape[1], settings.deviations)
        a, b = a[bound >= settings.threshold], b[bound >= settings.threshold]
        near = np.einsum("ij,ij->i", units[a], units[b]) >= settings.threshold
        a, b = a[near], b[near]
        counts += np.bincount(a, weight[b], n).astype(np.int64) + np.bincount(b, weight[a], n).astype(np.int64)
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            forest.join(x, y)
    spanning = np.array(forest.links, np.int64).reshape(-1, 2)
    yield (nodes[counts > 0], counts[counts > 0]), (nodes[spanning[:, 0]], nodes[spanning[:, 1]])


def query(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    return linked(vectors).select("vec_id", "n_links", "component_id", "kept")
