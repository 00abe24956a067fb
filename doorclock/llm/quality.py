"""Quality rules on documents and on the hosts they come from.

Each document is measured by itself first. The failures of those measurements are then counted per
host (here: the `source` of a document), the failure rate of every host is shrunk towards the rate
of the whole corpus by a beta prior fitted to the hosts themselves, and the verdict on the host is
joined back to its documents. Built from DataFrame functions only.

Defined results: a null text has no words and fails the base rules; documents without a host form a
host of their own; equal rows are measured one by one; an empty table gives an empty table; a column
of the input that has the name of a result column is replaced by it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doorclock.llm.columns import WORD, packed, unpacked, words
from doorclock.plans.staging import staged


@dataclass(frozen=True)
class QualityRules:
    """Limits of the verdicts.

    A host is rejected if its odds of failure are surely more than `host_odds` times those of the corpus: if
    even its shrunk rate less `sureness` posterior deviations is above the rate of such odds. So a host is
    measured by the corpus it is part of, and one of few documents is never sure.
    """

    min_words: int = 50
    max_repeat_percent: int = 50
    host_odds: float = 3.0
    sureness: float = 3.0


RULES = QualityRules()
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _repeat_words(found: Column) -> Column:
    """Words inside 3-word windows that occur twice or more, the first occurrence included.

    Windows are sorted by their hash with their position; those equal to a neighbour repeat. The
    positions, in order, cover three words each, less where the next one begins.
    """
    starts = F.sequence(F.lit(0), F.size(found) - 3)
    hashes = F.transform(
        starts, lambda i: F.xxhash64(F.get(found, i), F.get(found, i + 1), F.get(found, i + 2))
    )

    def positions(keyed: Column) -> Column:
        hit = F.filter(
            keyed,
            lambda x, i: (x["h"] == F.get(keyed, i + 1)["h"]) | (x["h"] == F.get(keyed, i - 1)["h"]),
        )
        return F.sort_array(F.transform(hit, lambda x: x["at"]))

    def covered(at: Column) -> Column:
        return F.aggregate(
            F.zip_with(at, F.slice(at, 2, F.size(at)), lambda a, b: F.least(F.coalesce(b - a, F.lit(3)), F.lit(3))),
            F.lit(0),
            lambda total, n: total + n,
        )

    # Bound through one-element arrays: a lambda variable is evaluated once, an expression at each use.
    some = F.transform(
        F.array(hashes),
        lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(
            F.get(
                F.transform(
                    F.array(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("at"))))),
                    lambda keyed: F.get(F.transform(F.array(positions(keyed)), covered), F.lit(0)),
                ),
                F.lit(0),
            )
        ),
    )
    return F.when(F.size(found) < 4, F.lit(0)).otherwise(F.get(some, F.lit(0))).cast("long")


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """Columns of `MEASURES` for every document, and `base_failed`."""
    rows = packed(docs)
    value = F.col("row").getField(text)
    spoken = F.filter(F.split(value, "\n"), lambda line: F.rlike(line, F.lit(WORD)))
    rows = rows.withColumns({"_words": words(value), "_lines": F.coalesce(spoken, F.array().cast("array<string>"))})
    found = F.col("_words")
    measures = {
        "n_words": F.size(found).cast("long"),
        "word_chars": F.length(F.array_join(found, "")).cast("long"),
        "n_symbols": F.coalesce(F.regexp_count(value, F.lit("[#*$%&|<>]")), F.lit(0)).cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_repeat_words": _repeat_words(found),
    }
    # A one-row generator: each measure is computed once, whatever later filters and columns read of it.
    once = F.explode(F.array(F.struct(*[value.alias(name) for name, value in measures.items()]))).alias("_measured")
    return unpacked(rows.select("row", once), docs.columns, {name: F.col("_measured").getField(name) for name in measures})


def base_failed(rules: QualityRules = RULES) -> Column:
    return (F.col("n_words") < rules.min_words) | (
        F.col("n_repeat_words") * 100 > F.col("n_words") * rules.max_repeat_percent
    )


def beta_prior(hosts: DataFrame) -> tuple[float, float]:
    """Parameters (a, b) of the beta prior, by moments, from columns `host_docs`, `host_failed`.

    The mean is the corpus rate. The overdispersion is what the hosts' rates vary beyond the noise
    of their own counts. Hosts that differ no more than that are shrunk all the way.
    """
    n, x = F.col("host_docs").cast("double"), F.col("host_failed").cast("double")
    s = hosts.agg(
        F.count(F.lit(1)).alias("hosts"), F.sum(n).alias("n"), F.sum(x).alias("x"),
        F.sum(n * n).alias("nn"), F.sum(x * x / n).alias("xx"),
    ).first()
    if not s.hosts:
        return 0.0, 1.0
    mean = s.x / s.n
    noise = mean * (1 - mean)
    free = (s.n - s.nn / s.n - (s.hosts - 1)) * noise
    spread = (s.xx - s.n * mean * mean - (s.hosts - 1) * noise) / free if free > 0 else 0.0
    strength = 1 / min(max(spread, 1e-6), 0.999) - 1
    return mean * strength, (1 - mean) * strength


def host_counts(rows: DataFrame, host: str = "source") -> DataFrame:
    """(host, host_docs, host_failed) of measured rows with `base_failed`."""
    counts = rows.groupBy(F.col(host).alias("host")).agg(
        F.count(F.lit(1)).alias("host_docs"),
        F.sum(F.col("base_failed").cast("long")).alias("host_failed"),
    )
    # Written, so that its measured size decides between a broadcast and a merge join.
    return staged(counts, "hosts")


def host_verdicts(rows: DataFrame, hosts: DataFrame, host: str = "source", rules: QualityRules = RULES) -> DataFrame:
    """Add `host_docs`, `host_failed`, `host_rate` (shrunk), `host_failing` and `kept`."""
    a, b = beta_prior(hosts)
    strength = F.col("host_docs") + F.lit(a + b)
    rate = (F.col("host_failed") + F.lit(a)) / strength
    joined = packed(rows).join(hosts, F.col("row").getField(host).eqNullSafe(F.col("host")))
    deviation = F.sqrt(rate * (1 - rate) / (strength + 1))
    mean = a / (a + b)
    failing = rate - rules.sureness * deviation > rules.host_odds * mean / (1 - mean + rules.host_odds * mean)
    return unpacked(joined, rows.columns, {
        "host_docs": F.col("host_docs"),
        "host_failed": F.col("host_failed"),
        "host_rate": rate,
        "host_failing": failing,
        "kept": ~F.col("row").getField("base_failed") & ~failing,
    })


def judged(docs: DataFrame, text: str = "text", host: str = "source", rules: QualityRules = RULES) -> DataFrame:
    """Every document with its measurements and both verdicts.

    Texts are measured twice, once for the hosts' counts and once for the result: that is less to pay
    than a copy of all texts on disk.
    """
    narrow = measured(docs.select(text, host), text).withColumn("base_failed", base_failed(rules))
    rows = measured(docs, text).withColumn("base_failed", base_failed(rules))
    return host_verdicts(rows, host_counts(narrow, host), host, rules)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    # Without the texts, the measurements are a narrow table that is written once.
    rows = staged(measured(docs).drop("text").withColumn("base_failed", base_failed()), "measured")
    return host_verdicts(rows, host_counts(rows)).select(
        "doc_id", *MEASURES, "base_failed", "kept", "host_docs", "host_failed",
        F.round("host_rate", 6).alias("host_rate"),
    )


ORACLE_SQL = """
with d as (select row_number() over () as r, doc_id, source, coalesce(text, '') as text from documents),
tok as (select r, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') as w, string_split(text, chr(10)) as l, text from d),
win as (select r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as g
  from (select r, w, unnest(range(1, len(w) - 1)) as i from tok)),
hit as (select r, i from (select r, i, count(*) over (partition by r, g) as n from win) where n > 1),
rep as (select r, count(distinct p) as n from (select r, unnest([i, i + 1, i + 2]) as p from hit) group by r),
m as (select d.doc_id, d.source, cast(len(w) as bigint) as n_words,
    cast(length(array_to_string(w, '')) as bigint) as word_chars,
    cast(length(d.text) - length(translate(d.text, '#*$%&|<>', '')) as bigint) as n_symbols,
    cast(len(list_filter(l, lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')))
      - len(list_distinct(list_filter(l, lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')))) as bigint) as n_dup_lines,
    cast(coalesce(rep.n, 0) as bigint) as n_repeat_words
  from d join tok using (r) left join rep using (r)),
f as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from m),
h as (select source, count(*) as host_docs, cast(sum(base_failed::int) as bigint) as host_failed from f group by source),
t as (select count(*) as hosts, sum(host_docs)::double as n, sum(host_failed)::double as x,
    sum(host_docs * host_docs)::double as nn, sum(host_failed * host_failed / host_docs::double) as xx from h),
s as (select *, x / n as mean, (x / n) * (1 - x / n) as noise from t),
v as (select *, (n - nn / n - (hosts - 1)) * noise as free from s),
p as (select mean, 1 / least(greatest(case when free > 0 then (xx - n * mean * mean - (hosts - 1) * noise) / free else 0 end,
    1e-6), 0.999) - 1 as strength from v),
j as (select f.*, h.host_docs, h.host_failed, mean, h.host_docs + strength as known,
    (h.host_failed + mean * strength) / (h.host_docs + strength) as rate
  from f join h on f.source is not distinct from h.source, p)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and not (rate - 3 * sqrt(rate * (1 - rate) / (known + 1)) > 3 * mean / (1 - mean + 3 * mean)) as kept,
  host_docs, host_failed, round(rate, 6) as host_rate
from j
"""
