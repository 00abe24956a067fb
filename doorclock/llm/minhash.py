"""Near-duplicate documents by b-bit MinHash.

A document is the set of its distinct word shingles. Minima of `bands * rows` hash functions make
bands, which bring candidates together, and of every minimum only the low `BITS` bits are kept, packed. The
share of equal low bits, corrected for chance agreement, estimates the similarity of candidates, and
those not far below the threshold are confirmed on their full sets.

Equal sets are one node first, so copies form no pairs. Buckets of a band join their members in a
star to candidate clusters; pairs are met inside tasks, in chunks of a cluster, and tested only while
they are not connected. Chunks of a large cluster share its least node; if its parts do not come together
so, all that is outside the largest part meets all chunks. So links, and components, are exact for
all pairs that share a band, at the threshold all but one in 10 million.

Ids are whole numbers.

Defined results: a document without text or words has an empty set and is linked with nothing; one
without id has no component and is kept; rows that share an id are one document, linked with what
any of them is linked with; an empty table gives an empty table; extra columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doorclock.llm.linking import chunked, complete_groups, components, stars
from doorclock.llm.shingles import C1, scrambled, shingle_sets
from doorclock.llm.substrings import _slices, _texts
from doorclock.plans.staging import dropped, released, staged

BITS = 4
SLICE_BYTES = 1 << 20


@dataclass(frozen=True)
class Settings:
    """Width of shingles and least similarity in percent; the pipeline's default is 5 and 80."""

    width: int = 5
    percent: int = 80
    bands: int = 48
    rows: int = 6
    deviations: float = 5.0
    chunk: int = 1024
    seed: int = 5


QUERY = Settings(width=3, percent=85, bands=36)


def minima(sets: list[np.ndarray], settings: Settings) -> np.ndarray:
    """(documents, bands * rows) least values of linear hash functions over each set."""
    rng = np.random.default_rng(settings.seed)
    k = settings.bands * settings.rows
    factor = (rng.integers(0, 2**31, k, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
    shift = rng.integers(0, 2**32, k, dtype=np.uint32)[:, None]
    out = np.full((len(sets), k), np.uint32(2**32 - 1), np.uint32)
    for row, values in zip(out, sets, strict=True):
        x = (values >> np.uint64(32)).astype(np.uint32)
        for at in range(0, len(x), 1024):
            np.minimum(row, (x[at : at + 1024] * factor + shift).min(1), out=row)
    return out


def band_buckets(least: np.ndarray, settings: Settings) -> np.ndarray:
    """(documents, bands) 64-bit bucket of each band."""
    value = np.broadcast_to(np.arange(1, settings.bands + 1, dtype=np.uint64), (len(least), settings.bands)).copy()
    parts = least.reshape(len(least), settings.bands, settings.rows).astype(np.uint64)
    for r in range(settings.rows):
        value = scrambled(value * C1 + parts[:, :, r])
    return value


def packed_bits(least: np.ndarray) -> np.ndarray:
    """(documents, words) the low `BITS` bits of all minima, sixteen to a 64-bit word."""
    low = (least & np.uint32(2**BITS - 1)).astype(np.uint64)
    words = -(-low.shape[1] // 16)
    low = np.pad(low, ((0, 0), (0, words * 16 - low.shape[1]))).reshape(len(low), words, 16)
    return (low << (np.arange(16, dtype=np.uint64) * np.uint64(BITS))).sum(2, dtype=np.uint64)


def estimates(one: np.ndarray, others: np.ndarray, k: int) -> np.ndarray:
    """Similarity of a signature with others: share of equal low bits, corrected for chance."""
    differ = one ^ others
    differ |= differ >> np.uint64(1)
    differ |= differ >> np.uint64(2)
    differ &= np.uint64(0x1111111111111111)
    agree = 1 - np.bitwise_count(differ).sum(1) / k
    chance = 2.0**-BITS
    return (agree - chance) / (1 - chance)


def cut_off(settings: Settings) -> float:
    """The least estimate that is confirmed: so many deviations below the threshold."""
    s, k, chance = settings.percent / 100, settings.bands * settings.rows, 2.0**-BITS
    p = s + (1 - s) * chance
    return s - settings.deviations * np.sqrt(p * (1 - p) / k) / (1 - chance)


def _sets(column: pa.Array, width: int) -> Iterator[list[np.ndarray]]:
    data, sizes = _texts(column.fill_null(""))
    upto = np.concatenate([[0], np.cumsum(sizes)])
    for at, end in _slices(sizes, SLICE_BYTES):
        values, counts = shingle_sets(data[upto[at] : upto[end]], sizes[at:end], width)
        yield np.split(values, np.cumsum(counts)[:-1])


def signed(batches: Iterator[pa.RecordBatch], settings: Settings) -> Iterator[pa.RecordBatch]:
    """Documents (doc_id, text) to set size, digest of the set, buckets and packed signature."""
    for batch in batches:
        at = 0
        for sets in _sets(batch.column("text"), settings.width):
            least = minima(sets, settings)
            digests = [[int(scrambled(s * C1 + np.uint64(k)).sum(dtype=np.uint64).astype(np.int64)) for s in sets] for k in (1, 2)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").slice(at, len(sets)), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(digests[0], pa.int64()), pa.array(digests[1], pa.int64()),
                    pa.array([r.tobytes() for r in band_buckets(least, settings)], pa.binary()),
                    pa.array([r.tobytes() for r in packed_bits(least)], pa.binary()),
                ],
                ["doc_id", "n_shingles", "d1", "d2", "buckets", "bits"],
            )
            at += len(sets)


def bucketed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = [np.frombuffer(b.as_py(), np.int64) for b in batch.column("buckets")]
        bands = len(values[0]) if values else 0
        nodes = np.repeat(batch.column("node").to_numpy(), bands)
        buckets = np.concatenate(values) if values else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(buckets, pa.int64())], ["node", "bucket"])


def _linked(block: pd.DataFrame, tested: np.ndarray, settings: Settings, cut: float) -> list[tuple[int, int]]:
    """Confirmed links that connect parts of a block; rows of `tested` are compared with all rows."""
    k = settings.bands * settings.rows
    bits = np.stack([np.frombuffer(b, np.uint64) for b in block["bits"]])
    sets = [np.frombuffer(b, np.uint64) for b in block["shingles"]]
    sizes = np.array([len(s) for s in sets])
    _, parts = np.unique(block["part"].to_numpy(), return_inverse=True)
    links = []
    for i in tested:
        small, large = np.minimum(sizes, sizes[i]), np.maximum(sizes, sizes[i])
        others = np.flatnonzero((parts != parts[i]) & (100 * small >= settings.percent * large))
        if not len(others):
            continue
        near = estimates(bits[i], bits[others], k)
        chosen = others[near >= cut][np.argsort(-near[near >= cut], kind="stable")]
        for j in chosen.tolist():
            if parts[i] == parts[j]:
                continue
            a, b = (sets[i], sets[j]) if sizes[i] <= sizes[j] else (sets[j], sets[i])
            both = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
            if 100 * both >= settings.percent * (sizes[i] + sizes[j] - both):
                parts[parts == parts[j]] = parts[i]
                links.append((i, j))
    return links


MEMBERS = "node long, cluster long, n_chunks int, chunk int, bits binary, shingles binary"


def verdicts(docs: DataFrame, settings: Settings = Settings(), text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of `docs`."""
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    columns = "doc_id long, n_shingles long, d1 long, d2 long, buckets binary, bits binary"
    marks = staged(rows.mapInArrow(lambda it: signed(it, settings), columns), "signatures")
    able = marks.where("doc_id is not null and n_shingles > 0")
    nodes = staged(
        able.groupBy("d1", "d2", "n_shingles").agg(F.min("doc_id").alias("node"), F.first("buckets").alias("buckets"), F.first("bits").alias("bits")),
        "set_nodes",
    )
    pairs = stars(nodes.select("node", "buckets").mapInArrow(bucketed, "node long, bucket long"))
    clusters = staged(components(pairs).withColumnRenamed("component", "cluster"), "clusters")
    released(spark)
    links, spent = _confirmed(rows, chunked(clusters, settings.chunk, "cluster"), settings)
    # Rows that share an id are one document.
    again = able.join(nodes.select("d1", "d2", "n_shingles", "node"), ["d1", "d2", "n_shingles"])
    several = again.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("_b")).where("a < _b")
    same = again.join(several, "doc_id").select("a", F.col("node").alias("b"))
    roots = components(links.unionByName(same))
    for table in (clusters, *spent):
        dropped(table)
    known = again.groupBy("doc_id").agg(F.min("node").alias("node")).join(roots, "node", "left").select(
        "doc_id", F.coalesce("component", "node").alias("component_id")
    )
    return marks.select("doc_id", "n_shingles").join(known, "doc_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"),
        F.coalesce(F.coalesce("component_id", "doc_id") == F.col("doc_id"), F.lit(True)).alias("kept"),
    )


def _confirmed(rows: DataFrame, members: DataFrame, settings: Settings) -> tuple[DataFrame, list[DataFrame]]:
    """Links (a, b), confirmed on full sets, that connect what is similar inside each cluster.

    Also the staged tables they are made of, to be dropped when the links have been read.
    """
    cut = cut_off(settings)

    def loaded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for sets in _sets(batch.column("text"), settings.width):
                bits = packed_bits(minima(sets, settings))
                part = batch.slice(at, len(sets))
                at += len(sets)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in ("node", "cluster", "n_chunks", "chunk")),
                     pa.array([b.tobytes() for b in bits], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())],
                    ["node", "cluster", "n_chunks", "chunk", "bits", "shingles"],
                )

    def compared(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
        for _, block in complete_groups(batches, keys):
            tested = np.flatnonzero(block["tested"].to_numpy())
            found = np.array(_linked(block, tested, settings, cut), np.int64).reshape(-1, 2)
            nodes = block["node"].to_numpy()
            yield pd.DataFrame({"a": nodes[found[:, 0]], "b": nodes[found[:, 1]]})

    def blocks(df: DataFrame, *keys: str) -> DataFrame:
        dealt = df.repartition(*keys).sortWithinPartitions(*keys)
        return dealt.mapInPandas(lambda it: compared(it, list(keys)), "a long, b long")

    # A merge join at any size: members grow with the corpus, and texts move once either way.
    text = rows.join(members.hint("merge"), F.col("doc_id") == F.col("node")).select("node", "cluster", "n_chunks", "chunk", "text")
    full = staged(text.mapInArrow(loaded, MEMBERS), "cluster_sets")
    # The cluster's least node, its name, is in every chunk.
    shared = full.where("node = cluster and n_chunks > 1").withColumn("_own", F.col("chunk"))
    shared = shared.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("n_chunks") - 1))).where("chunk != _own").drop("_own")
    first = full.unionByName(shared).withColumns({"tested": F.lit(True), "part": F.col("node")})
    links = staged(blocks(first, "cluster", "chunk"), "set_links")

    # Large clusters whose parts have not come together: what is outside the largest part meets all.
    large = full.where("n_chunks > 1")
    parts = large.select("node", "cluster").join(components(links), "node", "left").select(
        "node", "cluster", F.coalesce("component", "node").alias("part")
    )
    parts = staged(parts, "parts")
    most = parts.groupBy("cluster", "part").agg(F.count(F.lit(1)).alias("n")).groupBy("cluster").agg(
        F.max(F.struct("n", "part")).alias("top"), F.sum("n").alias("n")
    ).where("top.n < n").select("cluster", F.col("top.part").alias("_top"), (F.col("n") - F.col("top.n")).alias("_rest"))
    left = large.join(parts, ["node", "cluster"]).join(most, "cluster")
    pieces = F.ceil(F.col("_rest") / settings.chunk).cast("int")
    outside = left.where("part != _top").withColumns({
        "piece": F.pmod(F.xxhash64("node"), pieces).cast("int"), "tested": F.lit(True),
        "chunk": F.explode(F.sequence(F.lit(0), F.col("n_chunks") - 1)),
    })
    inside = left.withColumns({"piece": F.explode(F.sequence(F.lit(0), pieces - 1)), "tested": F.lit(False)})
    wanted = ["node", "cluster", "chunk", "piece", "bits", "shingles", "part", "tested"]
    rest = blocks(outside.select(*wanted).unionByName(inside.select(*wanted)), "cluster", "chunk", "piece")
    return links.unionByName(rest), [full, links, parts]


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return verdicts(docs, QUERY)
