"""Secrets in texts, by rules that a trigram index narrows down.

Each rule is a regular expression. A Boolean query over trigrams is derived from it (see `trigrams`); in
every task the texts are indexed segment by segment, a rule's query intersects and unites postings, and
only the texts that remain are searched with the expression itself. A rule whose expression needs no
trigram (`[0-9a-f]{24,}`) reads every text. An index lives as long as its segment, at most 256 texts or
`SEGMENT_BYTES` (one longer text is a segment of its own), so nothing is shuffled and memory is bounded
by the longest text.

Defined results: spans are in code points, the end excluded; per rule they are leftmost and do not
overlap, spans of different rules may; a null or empty text has none; equal rows are read one by one; an
empty table gives an empty table; a column of the input that has the name of a result column is
replaced by it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doorclock.llm.columns import packed, unpacked
from doorclock.llm.trigrams import Query, Segment, trigram_query

SEGMENT_BYTES = 4 << 20


@dataclass(frozen=True)
class Rule:
    """A kind of secret. Matches whose `group` has fewer than `least` characters are dropped, after matching."""

    kind: str
    pattern: str
    ignore_case: bool = False
    group: int = 0
    least: int = 0

    @property
    def flags(self) -> int:
        return re.ASCII | (re.IGNORECASE if self.ignore_case else 0)

    def query(self) -> Query:
        return trigram_query(self.pattern, self.flags)


BASE = [
    Rule(
        "assign",
        r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        ignore_case=True, group=2, least=6,
    ),
    # A run is matched as a whole, so its least length can stand in the expression.
    Rule("access", "AKIA[A-Z0-9]{16,}"),
    Rule("hex", "[0-9a-f]{24,}"),
]
# Public formats of keys and logins that the base rules do not name.
ADDED = [
    Rule("private_key", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("code_host", "gh[opsur]_[A-Za-z0-9]{36,}"),
    Rule("chat", "xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("signed_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("map_key", "AIza[A-Za-z0-9_-]{35}"),
    Rule("url_login", "://[A-Za-z0-9._~-]+:[A-Za-z0-9._~!$&*+=%-]{6,}@"),
]
RULES = BASE + ADDED
SPANS = "array<struct<kind:string,start:int,end:int>>"


def _segments(texts: list[str | None]) -> Iterator[tuple[int, list[str]]]:
    """(place of the first, texts) of runs that fit a segment."""
    start, room = 0, SEGMENT_BYTES
    for k, text in enumerate(texts):
        size = len(text or "")
        if k > start and (k - start >= Segment.MOST or size > room):
            yield start, [t or "" for t in texts[start:k]]
            start, room = k, SEGMENT_BYTES
        room -= size
    if start < len(texts):
        yield start, [t or "" for t in texts[start:]]


def _searcher(rules: list[Rule]):
    compiled = [(r, re.compile(r.pattern, r.flags), r.query()) for r in rules]

    def spans(texts: list[str | None]) -> list[list[tuple[str, int, int]]]:
        found: list[list] = [[] for _ in texts]
        for at, part in _segments(texts):
            index = Segment([t.encode() for t in part])
            for order, (rule, pattern, query) in enumerate(compiled):
                for k in index.matching(query).tolist():
                    found[at + k] += [
                        (m.start(), order, m.end(), rule.kind)
                        for m in pattern.finditer(part[k])
                        if m.end(rule.group) - m.start(rule.group) >= rule.least
                    ]
        return [[(kind, start, end) for start, _, end, kind in sorted(own)] for own in found]

    return spans


def scanned(docs: DataFrame, rules: list[Rule] = RULES, text: str = "text") -> DataFrame:
    """Every row with `spans`: (kind, start, end) of what the rules find, by start, then in the rules' order."""

    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        spans = _searcher(rules)
        for batch in batches:
            found = spans([t if isinstance(t, str) else None for t in batch])
            yield pd.Series([[{"kind": k, "start": s, "end": e} for k, s, e in own] for own in found], dtype=object)

    run = F.pandas_udf(scan, SPANS)  # type: ignore[call-overload]
    rows = packed(docs).withColumn("_spans", run(F.col("row").getField(text)))
    return unpacked(rows, docs.columns, {"spans": F.col("_spans")})


def listed(spans: Column) -> Column:
    """Spans as `kind:start:end`, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def of_kinds(spans: Column, kinds: list[str]) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(kinds))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found, spans = scanned(docs), F.col("spans")
    kinds = [r.kind for r in BASE]
    counts = [F.size(of_kinds(spans, [k])).cast("long").alias(f"n_{k}") for k in kinds]
    digest = F.sha2(listed(of_kinds(spans, kinds)), 256)
    return found.select("doc_id", *counts, digest.alias("base_sha256"), listed(spans).alias("spans"))


def _oracle() -> str:
    """Places follow from the lengths of the matches and of what lies between them."""
    parts = []
    for order, rule in enumerate(RULES):
        pattern = rule.pattern.replace("'", "''")
        if rule.ignore_case:  # letters written out: SQL's own case folding knows more letters
            head, tail = pattern.split(")", 1)
            pattern = "(" + "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in head[1:]) + ")" + tail
        parts.append(
            f"select r, {order} as o, '{rule.kind}' as kind, {rule.least} as least, regexp_extract_all(text, '{pattern}') as m, "
            f"regexp_extract_all(text, '{pattern}', {rule.group}) as g, string_split_regex(text, '{pattern}') as b from d"
        )
    base = ", ".join(f"'{r.kind}'" for r in BASE)
    counts = ", ".join(f"count(*) filter (kind = '{r.kind}') as n_{r.kind}" for r in BASE)
    return f"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents),
hits as ({" union all ".join(parts)}),
one as (select r, o, kind, least, unnest(range(1, len(m) + 1)) as i, m, g, b from hits where len(m) > 0),
placed as (select r, o, kind, least, length(g[i]) as size, length(m[i]) as l,
  cast(list_sum(list_transform(b[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) as bigint) as s from one),
kept as (select r, o, kind, s, kind || ':' || s || ':' || (s + l) as t from placed where size >= least),
rows_ as (select r, {counts}, string_agg(t, ',' order by s, o) filter (kind in ({base})) as base, string_agg(t, ',' order by s, o) as spans
  from kept group by r)
select doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) as n_{r.kind}" for r in BASE)}, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from d left join rows_ using (r)
"""


ORACLE_SQL = _oracle()
