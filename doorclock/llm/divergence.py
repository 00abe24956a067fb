"""How far the sources of a language differ in their words.

Words are counted per language and source. Every pair of sources of a language is priced with a sum over
all kept terms of a function of the term's two counts, so only the joint table of a pair is needed: how
many terms have count `a` in one source and count `b` in the other. All joint tables come from one matrix
product: a matrix with a row per term and an indicator column per (source, count level), multiplied by its
transpose. Rows are dealt over tasks by term and taken in blocks, columns in tiles, and entries are whole
numbers below 2^24, so products in single precision are exact.

Count 0 has no column. With f(a, b) the price, a joint table's sum is

    V f(0,0) + sum_a M(a) (f(a,0) - f(0,0)) + sum_b M(b) (f(0,b) - f(0,0))
      + sum_{a,b > 0} J(a,b) (f(a,b) - f(a,0) - f(0,b) + f(0,0))

with M the number of terms at a level: only sources that share terms meet in a product.

Defined results: null text, language and source count as ''; every row is a document, equal rows too; a
group without a kept term is compared with nothing but 0 counts; a language without kept terms prices all
its pairs 0; equal values are ranked by the item's UTF-8 bytes; an empty table gives an empty table;
columns other than the three are not read.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from doorclock.llm.ranks import top_rows
from doorclock.plans.staging import staged

SCALE = 1_000_000_000
MIN_DOCS, TOP_TERMS = 3, 200
HELD = 400_000  # counts that a task holds before it passes them on
CELLS, ROWS, COLUMNS = 1 << 17, 2048, 1024  # of a chunk, a block of terms, a tile of indicator columns

# Letters of ASCII in lower case, all other ASCII as blanks; bytes of other characters as they are.
_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs), added up within the task; a group itself is a row with the term ''."""
    counts: dict[tuple[str, str], Counter] = defaultdict(Counter)
    docs: dict[tuple[str, str], Counter] = defaultdict(Counter)

    def emptied() -> pa.RecordBatch:
        keys = [g for g, c in counts.items() for _ in c]
        out = pa.RecordBatch.from_arrays(
            [
                pa.array([g[0] for g in keys], pa.string()),
                pa.array([g[1] for g in keys], pa.string()),
                pa.array([t for c in counts.values() for t in c], pa.binary()).cast(pa.string()),
                pa.array([n for c in counts.values() for n in c.values()], pa.int64()),
                pa.array([docs[g][t] for g, c in counts.items() for t in c], pa.int64()),
            ],
            ["lang", "source", "term", "n", "docs"],
        )
        counts.clear()
        docs.clear()
        return out

    held = 0
    for batch in batches:
        for lang, source, text in zip(*[batch.column(k) for k in range(3)], strict=True):
            group = (lang.as_py() or "", source.as_py() or "")
            own = counts[group]
            before = len(own)
            if not before:
                own[b""] = 0
            if text.is_valid:
                terms = memoryview(text.as_buffer()).tobytes().translate(_TERMS).split()
                own.update(terms)
                docs[group].update(set(terms))
            held += len(own) - before
            if held >= HELD:
                yield emptied()
                held = 0
    if counts:
        yield emptied()


def counted_terms(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, term, n, docs): occurrences of each term in a group and its documents that hold it."""
    three = docs.select(*[F.col(f"`{c}`").cast("string").alias(n) for n, c in (("lang", lang), ("source", source), ("text", text))])
    parts = three.mapInArrow(_counted, "lang string, source string, term string, n long, docs long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10^9 (n + 1) / (total + terms)), exactly."""
    return F.lit(1).cast("long") + F.call_function(
        "div", (n + 1).cast("decimal(19,0)") * F.lit(SCALE).cast("decimal(10,0)"), (total + terms).cast("decimal(20,0)")
    )


def price(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def kept_terms(counts: DataFrame, min_docs: int = MIN_DOCS) -> tuple[DataFrame, DataFrame]:
    """(cells, groups), both written once.

    Cells (lang, source, term, n, lang_n, p, q, p0): shares of the kept terms that occur in a group, in the
    language, and of a term that the group lacks. Groups (lang, source, p0, terms), those without terms too.
    """
    of_term = Window.partitionBy("lang", "term")
    cells = counts.where("term <> ''").select(
        "lang", "source", "term", "n",
        F.sum("n").over(of_term).alias("lang_n"),
        F.sum("docs").over(of_term).alias("lang_docs"),
        (F.min("source").over(of_term) == F.col("source")).cast("long").alias("first"),
    )
    cells = staged(cells.where(F.col("lang_docs") >= min_docs).drop("lang_docs"), "term_cells")
    groups = counts.where("term = ''").select("lang", "source")
    sums = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.sum("first").alias("first"))
    langs = sums.groupBy("lang").agg(F.sum("total").alias("lang_total"), F.sum("first").alias("terms"))
    groups = groups.join(sums.drop("first"), ["lang", "source"], "left").join(langs, "lang", "left").select(
        "lang", "source", F.coalesce("total", F.lit(0)).alias("total"), "lang_total", F.coalesce("terms", F.lit(0)).alias("terms"),
    )
    p0 = F.when(F.col("terms") > 0, share(F.lit(0).cast("long"), F.col("total"), F.col("terms")))
    groups = staged(groups.withColumn("p0", p0), "term_groups")
    cells = cells.join(groups, ["lang", "source"]).select(
        "lang", "source", "term", "n", "lang_n", "p0",
        share(F.col("n"), F.col("total"), F.col("terms")).alias("p"),
        share(F.col("lang_n"), F.col("lang_total"), F.col("terms")).alias("q"),
    )
    return cells, groups


def _blocks(cells: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of one language's cells: (row, column) of each one, the cell that stands for a column, its source."""
    term = cells["term"].to_numpy()
    rows = np.cumsum(np.concatenate([[True], term[1:] != term[:-1]])) - 1
    source, level = cells["_source"].to_numpy(), cells["n"].to_numpy()
    ends = [(int(rows[0]), int(rows[-1]) + 1)]
    while ends:
        low, high = ends.pop()
        span = slice(*np.searchsorted(rows, [low, high]))
        order = np.lexsort((level[span], source[span])) + span.start
        fresh = np.ones(len(order), bool)
        fresh[1:] = (source[order][1:] != source[order][:-1]) | (level[order][1:] != level[order][:-1])
        if high - low > 1 and (high - low > ROWS or fresh.sum() > COLUMNS):
            middle = (low + high) // 2
            ends += [(middle, high), (low, middle)]
            continue
        stands = order[fresh]
        yield rows[order] - low, np.cumsum(fresh) - 1, stands, source[stands]


def _products(row: np.ndarray, column: np.ndarray, columns: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Entries (i, j, count) of the indicator matrix's transpose times itself, tile by tile."""
    tiles = []
    for low in range(0, columns, COLUMNS):
        own = (column >= low) & (column < low + COLUMNS)
        tile = np.zeros((int(row.max()) + 1, min(COLUMNS, columns - low)), np.float32)
        tile[row[own], column[own] - low] = 1
        tiles.append((low, tile))
    for a, left in tiles:
        for b, right in tiles:
            product = left.T @ right
            i, j = np.nonzero(product)
            yield i + a, j + b, product[i, j].astype(np.int64)


def _chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Whole terms of one language, about `CELLS` cells at a time, from cells sorted by language and term."""
    held: list[pd.DataFrame] = []

    def cut(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        for _, own in rows.groupby("lang", sort=False):
            codes, _ = pd.factorize(own["source"])
            yield own.assign(_source=codes)

    for batch in batches:
        held.append(batch)
        if sum(map(len, held)) >= CELLS:
            rows = pd.concat(held, ignore_index=True)
            last = (rows["term"] == rows["term"].iloc[-1]) & (rows["lang"] == rows["lang"].iloc[-1])
            yield from cut(rows[~last])
            held = [rows[last]]
    if held:
        yield from cut(pd.concat(held, ignore_index=True))


def _side_by_side(cells: DataFrame) -> DataFrame:
    """Cells of a term together; terms of like counts near each other, so that they share columns."""
    return cells.repartition("lang", "term").sortWithinPartitions("lang", "lang_n", "term")


def joint_tables(cells: DataFrame) -> DataFrame:
    """(lang, source, level, other, other_level, terms): in how many terms two sources have these counts above 0."""

    def tables(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for own in _chunks(batches):
            for row, column, stands, _ in _blocks(own):
                sources, levels = own["source"].to_numpy()[stands], own["n"].to_numpy()[stands]
                for i, j, count in _products(row, column, len(stands)):
                    yield pd.DataFrame({
                        "lang": own["lang"].iloc[0], "source": sources[i], "level": levels[i],
                        "other": sources[j], "other_level": levels[j], "terms": count,
                    })

    keys = ["lang", "source", "level", "other", "other_level"]
    parts = _side_by_side(cells).mapInPandas(tables, "lang string, source string, level long, other string, other_level long, terms long")
    return parts.where("source <> other").groupBy(*keys).agg(F.sum("terms").alias("terms"))


def _priced(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What the joint tables of a task's blocks add to each pair of sources."""

    def f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        return (p - q) ** 2 // q

    for own in _chunks(batches):
        names = own["source"].drop_duplicates().to_numpy()  # in the order of the codes
        sums: dict[int, int] = defaultdict(int)
        for row, column, stands, source in _blocks(own):
            p, p0 = own["p"].to_numpy()[stands], own["p0"].to_numpy()[stands]
            for i, j, count in _products(row, column, len(stands)):
                apart = source[i] != source[j]
                i, j, count = i[apart], j[apart], count[apart]
                worth = count * (f(p[i], p[j]) - f(p[i], p0[j]) - f(p0[i], p[j]) + f(p0[i], p0[j]))
                pairs, place = np.unique(source[i] * len(names) + source[j], return_inverse=True)
                total = np.zeros(len(pairs), np.int64)
                np.add.at(total, place, worth)
                for pair, value in zip(pairs.tolist(), total.tolist(), strict=True):
                    sums[pair] += value
        if sums:
            pairs = np.fromiter(sums, np.int64, len(sums))
            yield pd.DataFrame({
                "lang": own["lang"].iloc[0], "source": names[pairs // len(names)], "item": names[pairs % len(names)],
                "value": np.fromiter(sums.values(), np.int64, len(sums)),
            })


def source_pairs(cells: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value): the price of each source against each other one of its language."""
    joint = _side_by_side(cells.select("lang", "source", "term", "n", "lang_n", "p", "p0")).mapInPandas(
        _priced, "lang string, source string, item string, value long"
    )
    joint = joint.groupBy("lang", "source", "item").agg(F.sum(F.col("value").cast("decimal(20,0)")).alias("value"))
    levels = cells.groupBy("lang", "source", "n", "p", "p0").agg(F.count(F.lit(1)).cast("decimal(20,0)").alias("terms"))
    other = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
    facing = levels.join(other, "lang").where("source <> item")
    p, p0, q0 = F.col("p"), F.col("p0"), F.col("q0")
    # A level is priced with both of its group's roles, and each role is a pair of its own.
    margins = facing.select(
        "lang",
        F.explode(F.array(
            F.struct("source", "item", (F.col("terms") * (price(p, q0) - price(p0, q0))).cast("decimal(38,0)").alias("value")),
            F.struct(F.col("item").alias("source"), F.col("source").alias("item"), (F.col("terms") * (price(q0, p) - price(q0, p0))).cast("decimal(38,0)").alias("value")),
        )).alias("x"),
    ).groupBy("lang", "x.source", "x.item").agg(F.sum("x.value").alias("value"))
    pairs = groups.join(other, "lang").where("source <> item").select(
        "lang", "source", "item",
        F.coalesce(F.col("terms").cast("decimal(20,0)") * price(F.col("p0"), F.col("q0")), F.lit(0)).cast("decimal(38,0)").alias("value"),
    )
    parts = pairs
    for more in (joint, margins):
        parts = parts.unionByName(more.select("lang", "source", "item", F.col("value").cast("decimal(38,0)").alias("value")))
    return parts.groupBy("lang", "source", "item").agg(F.sum("value").cast("long").alias("value"))


def audited(docs: DataFrame, min_docs: int = MIN_DOCS, top_terms: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): pairs of sources, and the terms that a source has more of."""
    cells, groups = kept_terms(staged(counted_terms(docs), "term_counts"), min_docs)
    group = ["lang", "source"]
    order = [F.col("value").desc(), F.col("item").asc()]
    ranked = Window.partitionBy(*group).orderBy(*order)
    pairs = source_pairs(cells, groups).select(*group, F.lit("pair").alias("part"), "item", "value", F.row_number().over(ranked).alias("rank"))
    over = cells.where("p > q").select(*group, F.col("term").alias("item"), price(F.col("p"), F.col("q")).alias("value"))
    terms = top_rows(over, group, order, top_terms).select(*group, F.lit("term").alias("part"), "item", "value", "rank")
    return pairs.unionByName(terms)


def query(spark, sf_dir: str) -> DataFrame:
    return audited(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_SQL = """
with d as (select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents),
tok as (select r, lang, source, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) as term from d),
vocab as (select lang, term, count(*) as c from tok group by lang, term having count(distinct r) >= 3),
langs as (select lang, sum(c) as n, count(*) as v from vocab group by lang),
grp as (select distinct lang, source from d),
cnt as (select lang, source, term, count(*) as c from tok group by all),
cell as (select grp.lang, grp.source, vocab.term, coalesce(cnt.c, 0) as c, vocab.c as lc
  from grp join vocab using (lang) left join cnt using (lang, source, term)),
tot as (select lang, source, sum(c) as n from cell group by lang, source),
p as (select cell.lang, cell.source, cell.term, cell.c,
    1 + (1000000000 * (cell.c + 1)::hugeint) // (tot.n + langs.v) as p,
    1 + (1000000000 * (cell.lc + 1)::hugeint) // (langs.n + langs.v) as q
  from cell join tot using (lang, source) join langs using (lang)),
pair as (select a.lang, a.source, b.source as item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) as value
  from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
allpair as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(pair.value, 0) as value
  from grp a join grp b on a.lang = b.lang and a.source <> b.source
  left join pair on pair.lang = a.lang and pair.source = a.source and pair.item = b.source),
term as (select lang, source, 'term' as part, term as item, ((p - q) * (p - q)) // q as value from p where c > 0 and p > q),
ranked as (select *, row_number() over (partition by lang, source, part order by value desc, item) as rank
  from (select * from allpair union all select * from term))
select lang, source, part, item, cast(value as bigint) as value, cast(rank as integer) as rank from ranked
where part = 'pair' or rank <= 200
"""
