"""A training corpus from raw documents: each stage decides on what the one before it kept.

Every stage takes (spark, docs, sf_dir) and returns documents. Stages but the last return the
columns they were given, the last one adds the ids of each text's pieces; `run` writes each stage's
result and reads it for the next one. No SQL expresses the stages on sets, bytes and pieces, so the
tests compare them with brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doorclock.llm import minhash, mixing, pieces, quality, substrings
from doorclock.llm.columns import packed, unpacked
from doorclock.plans.staging import staged


def _apart(docs: DataFrame, *own: str) -> DataFrame:
    """The columns `own` that an operator reads, and all others as `row`, so that no result replaces them."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in own]
    return docs.select(*own, F.struct(*(others or [F.lit(0).alias("_")])).alias("row"))


def _together(rows: DataFrame, columns: list[str], *own: str) -> DataFrame:
    return rows.select(*[(F.col(c) if c in own else F.col("row").getField(c)).alias(c) for c in columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules and whose host does not fail as a whole."""
    own = ("text", "source")
    return _together(quality.judged(_apart(docs, *own)).where("kept"), docs.columns, *own)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the least id; those without id stay.

    Rows of one id are told apart by their text: each is kept or dropped by what its own text is like.
    """
    key = F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id", F.xxhash64("text")))
    keyed = docs.select("doc_id", "text", key.alias("key"))
    names = keyed.where("key is not null").select("key", "doc_id").distinct()
    groups = minhash.verdicts(keyed, key="key").where("doc_id is not null")
    groups = groups.select(F.col("doc_id").alias("key"), "component_id").distinct().join(names, "key")
    kept = groups.groupBy("component_id").agg(F.min(F.struct("doc_id", "key")).alias("least")).select(F.col("least.key").alias("_kept"))
    rows = packed(docs)
    own = F.xxhash64("row.doc_id", F.xxhash64("row.text"))
    # Of equal rows one stays. Unlike rows whose keys happen to be equal both do.
    same = ["_kept", F.col("row.doc_id"), F.md5(F.coalesce("row.text", F.lit("")))]
    first = rows.where("row.doc_id is not null").join(kept, own == F.col("_kept")).groupBy(*same).agg(
        F.min_by("row", F.xxhash64("row.text")).alias("row")
    )
    return unpacked(first.select("row").unionByName(rows.where("row.doc_id is null")), docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the byte strings that occur earlier; halves of characters at the cuts go too."""
    rest = F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")])
    left = substrings.deduplicated(docs.select("doc_id", "text", rest.alias("row")), as_text=True)
    text = F.when(F.col("text").isNotNull(), F.col("kept"))
    own = {"doc_id": F.col("doc_id"), "text": text}
    return left.select(*[own.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    own = ("doc_id", "text", "source")
    mix = mixing.mixed(_apart(docs, *own), mixing.cyclic_weights)
    return _together(mixing.repeated(mix, [*own, "row"]), docs.columns, *own)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the ids of their pieces."""
    return pieces.encoded(docs, pieces.Vocabulary.read())


STAGES = [
    ("quality rules", quality_rules),
    ("MinHash near-dedup", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("mixing sources", source_mix),
    ("SentencePiece encoding", encoded),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
