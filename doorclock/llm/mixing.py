"""Mix sources to target weights by whole copies and Pareto order sampling.

A source's target is its weighted share of all words, at most `max_copies` times its own size; what
is above that is shared anew among the others. Every document of a source is then wanted
`target / size` times: the whole part is certain, and the words that are still wanted come from a sample of
fixed size in words. Documents enter it with unequal odds: their inclusion is in proportion to their
words, and those whose inclusion would reach 1 are taken for certain, which leaves less for the others. The
others are ranked by the Pareto ratio of random odds to inclusion odds, (u / (1 - u)) / (p / (1 - p)) with u
a hash of the document, and taken in that order until the words still wanted are reached; the document
at the edge is taken if that ends nearer to the target.

No task ranks a whole source: sums over ranges of the ratio lead to the one narrow range that holds
the edge, and only its rows are put in order. Built from DataFrame functions only.

Defined results: a null text has size 0, and takes 0 words; null is a source of its own, after all
others; a source without words has target 0 and no copies; equal rows are taken one by one, in any
order among themselves; an empty table gives an empty table; a column of the input that has the name
of a result column is replaced by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from doorclock.llm.columns import packed, unit_hash, unpacked, word_count
from doorclock.plans.staging import staged

WEIGHTS = (5, 2, 1)
MAX_COPIES = 3
RANGES = 1024


def cyclic_weights(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Weight of each source of `sizes` (source, source_size), repeating in code point order."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(w) for w in weights])
    at = (F.row_number().over(order) - 1) % len(weights)
    return sizes.withColumn("weight", F.element_at(cycle, (at + 1).cast("int")))


def targets(sizes: DataFrame, max_copies: int = MAX_COPIES) -> DataFrame:
    """Add `target` to (source, source_size, weight). One row per source of the mix.

    Sources in the order of words per weight at which they are full; each is full if the level of
    those not yet full is above that.
    """
    full = F.col("source_size") * max_copies
    order = Window.orderBy((full / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    all_rows = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing).partitionBy(F.lit(0))
    spent = F.coalesce(F.sum(full).over(before), F.lit(0))
    rest = F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    level = (F.sum("source_size").over(all_rows) - spent) / rest
    leveled = sizes.withColumns({"_level": level, "_full": full, "_at": F.row_number().over(order)}).withColumn(
        "_is_full", F.col("_full") < F.col("_level") * F.col("weight")
    )
    first_open = F.min(F.when(~F.col("_is_full"), F.struct("_at", "_level"))).over(all_rows)
    return leveled.withColumn(
        "target",
        F.when(F.col("_is_full"), F.col("_full").cast("double")).otherwise(first_open["_level"] * F.col("weight")),
    ).drop("_level", "_full", "_at", "_is_full")


def _inclusion(narrow: DataFrame, plan: DataFrame) -> DataFrame:
    """The plan with `_factor`: a document's inclusion per word, where those above 1 count as 1.

    From the largest size down, a size is certain if the words then left, shared in proportion to squared
    sizes, would include it with 1 or more. A source has a row per distinct size here.
    """
    sizes = narrow.where("_size > 0").groupBy("_source", "_size").agg(F.count(F.lit(1)).alias("_n"))
    sizes = sizes.join(plan.select(F.col("source").alias("_s"), "_wanted"), F.col("_source").eqNullSafe(F.col("_s")))
    larger = Window.partitionBy("_source").orderBy(F.col("_size").desc()).rowsBetween(Window.unboundedPreceding, -1)
    not_larger = Window.partitionBy("_source").orderBy("_size").rowsBetween(Window.unboundedPreceding, 0)
    wide = F.col("_size").cast("decimal(12,0)")
    left = F.col("_wanted") - F.coalesce(F.sum(F.col("_size") * F.col("_n")).over(larger), F.lit(0))
    factor = left / F.sum(wide * wide * F.col("_n").cast("decimal(14,0)")).over(not_larger).cast("double")
    opened = sizes.withColumn("_factor", factor).where(F.col("_factor") * F.col("_size") < 1)
    found = opened.groupBy(F.col("_source").alias("_s")).agg(F.max_by("_factor", "_size").alias("_factor"))
    return plan.join(found, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")


def _ranked(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Rows of `plan`'s sources with the Pareto ratio and its two ranges; certain ones come before all ranges."""
    u, p = F.col("_u"), F.col("_factor") * F.col("_size")
    ratio = F.when(p >= 1, F.lit(0.0)).when(p > 0, (u / (1 - u)) / (p / (1 - p)))
    scaled = F.when(p >= 1, F.lit(-1)).otherwise(F.floor(ratio / (1 + ratio) * (RANGES * RANGES)))
    return (
        rows.join(plan, F.col("_source").eqNullSafe(F.col("source")))
        .withColumn("_ratio", ratio)
        .withColumn("_fine", F.least(scaled, F.lit(RANGES * RANGES - 1)))
        .withColumn("_range", F.floor(F.col("_fine") / RANGES))
    )


def _edges(sums: DataFrame, plan: DataFrame, level: str, before: str, name: str) -> DataFrame:
    """The plan with the range of `level` that holds the edge, and the words before it."""
    order = Window.partitionBy("source").orderBy(level)
    upto = F.sum("_words").over(order) + F.col(before)
    found = (
        sums.withColumn("_upto", upto)
        .where((F.col("_upto") > F.col("_wanted")) & (F.col("_upto") - F.col("_words") <= F.col("_wanted")))
        .select(F.col("source").alias("_s"), F.col(level).alias(name), (F.col("_upto") - F.col("_words")).alias(f"{name}_before"))
    )
    return plan.join(found, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")


def mixed(docs: DataFrame, weights, text: str = "text", source: str = "source", seed: str = "mix",
          key: str = "doc_id", max_copies: int = MAX_COPIES) -> DataFrame:
    """Every document with `size`, `source_size`, `target`, `copies` and `taken` words.

    `weights` is a function that adds a column `weight` to (source, source_size): the mix's recipe,
    with as many rows as it names sources.
    """
    rows = packed(docs)
    value = F.col("row").getField(text)
    hashed = unit_hash(F.lit(seed), F.col("row").getField(key), F.md5(F.coalesce(value, F.lit(""))))
    rows = rows.withColumns({"_source": F.col("row").getField(source), "_size": word_count(value), "_u": hashed})
    narrow = staged(rows.select("_source", "_size", "_u"), "mix_sizes")

    sizes = narrow.groupBy(F.col("_source").alias("source")).agg(F.sum("_size").alias("source_size"))
    plan = targets(weights(sizes), max_copies)
    ratio = F.coalesce(F.try_divide(F.col("target"), F.col("source_size")), F.lit(0.0))
    plan = plan.withColumn("_whole", F.floor(ratio))
    plan = plan.withColumn("_wanted", F.col("target") - F.col("_whole") * F.col("source_size"))
    plan = staged(plan, "mix_plan")  # measured, so that it is broadcast only if it is small
    plan = staged(_inclusion(narrow, plan), "mix_plan")

    coarse = _ranked(narrow, plan).groupBy("source", "_range", "_wanted").agg(F.sum("_size").alias("_words"))
    plan = staged(_edges(coarse.withColumn("_zero", F.lit(0)), plan, "_range", "_zero", "_r1"), "mix_plan")
    inside = _ranked(narrow, plan).where(F.col("_range") == F.col("_r1"))
    fine = inside.groupBy("source", "_fine", "_wanted", "_r1_before").agg(F.sum("_size").alias("_words"))
    plan = staged(_edges(fine, plan, "_fine", "_r1_before", "_r2"), "mix_plan")

    ranked = _ranked(rows, plan)
    at_edge = F.coalesce(F.col("_fine") == F.col("_r2"), F.lit(False))
    edge = Window.partitionBy("source").orderBy("_ratio", "_u", "_size").rowsBetween(Window.unboundedPreceding, 0)
    ordered = ranked.where(at_edge).withColumn("_upto", F.col("_r2_before") + F.sum("_size").over(edge))
    ordered = ordered.withColumn("_extra", 2 * F.col("_upto") - F.col("_size") <= 2 * F.col("_wanted"))
    # Words that end between two ranges have the later one as their edge; without one, nothing more is wanted.
    whole = F.coalesce(F.col("_fine") < F.col("_r2"), F.lit(False))
    others = ranked.where(~at_edge).withColumns({"_upto": F.lit(None).cast("double"), "_extra": whole})
    return unpacked(ordered.unionByName(others), docs.columns, _taken())


def _taken() -> dict[str, Column]:
    copies = F.col("_whole") + F.col("_extra").cast("long")
    return {
        "size": F.col("_size"),
        "source_size": F.col("source_size"),
        "target": F.col("target"),
        "copies": copies,
        "taken": F.col("_size") * copies,
    }


def repeated(mix: DataFrame, columns: list[str]) -> DataFrame:
    """The mix itself: each document as often as it is taken."""
    n = F.col("copies").cast("int")
    return mix.where("copies > 0").withColumn("copies", F.explode(F.array_repeat(F.lit(0), n))).select(*columns)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mixed(docs, cyclic_weights).select("doc_id", "size", "source_size", "target", "taken", "copies")


ORACLE_SQL = """
with d as (select row_number() over () as r, doc_id, source,
    cast(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as bigint) as size,
    cast('0x' || substr(md5('mix:' || coalesce(doc_id::varchar, 'null') || ':' || md5(coalesce(text, ''))), 1, 13) as bigint)
      / 4503599627370496e0 as u from documents),
s as (select source, cast(sum(size) as bigint) as source_size,
    [5, 2, 1][cast((row_number() over (order by encode(source) nulls last) - 1) % 3 + 1 as int)] as w from d group by source),
l as (select *, 3 * source_size as cap,
    (sum(source_size) over () - coalesce(sum(3 * source_size) over before, 0))
      / ((sum(w) over () - coalesce(sum(w) over before, 0))::double) as level,
    row_number() over (order by 3 * source_size / w::double, encode(source) nulls last) as pos
  from s window before as (order by 3 * source_size / w::double, encode(source) nulls last
    rows between unbounded preceding and 1 preceding)),
t as (select source, source_size, case when cap < level * w then cap::double
    else (min(case when cap >= level * w then struct_pack(pos := pos, level := level) end) over ()).level * w end as target from l),
p as (select *, floor(coalesce(target / nullif(source_size, 0), 0)) as whole,
    target - floor(coalesce(target / nullif(source_size, 0), 0)) * source_size as wanted from t),
z as (select source, size, count(*) as n from d where size > 0 group by source, size),
y as (select z.source, z.size,
    (p.wanted - coalesce(sum(z.size * n) over (partition by z.source order by z.size desc rows between unbounded preceding and 1 preceding), 0))
      / (sum(z.size::hugeint * z.size * n) over (partition by z.source order by z.size rows between unbounded preceding and current row))::double as factor
  from z join p on z.source is not distinct from p.source),
x as (select source, max_by(factor, size) as factor from y where factor * size < 1 group by source),
j as (select d.*, p.source_size, p.target, p.whole, p.wanted,
    case when x.factor * d.size >= 1 then 0e0 when x.factor * d.size > 0
      then (u / (1 - u)) / ((x.factor * d.size) / (1 - (x.factor * d.size))) end as ratio
  from d join p on d.source is not distinct from p.source left join x on d.source is not distinct from x.source),
c as (select *, sum(size) over (partition by source order by ratio, u, size, r
    rows between unbounded preceding and current row) as upto from j)
select doc_id, size, source_size, target,
  cast(whole + case when ratio is not null and 2 * upto - size <= 2 * wanted then 1 else 0 end as bigint) as copies,
  cast(size * (whole + case when ratio is not null and 2 * upto - size <= 2 * wanted then 1 else 0 end) as bigint) as taken
from c
"""
