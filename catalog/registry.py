"""Registered queries with the SQL that checks them.

The SQL of a check is assembled from named tables (`oracle/*.sql`): the input shapes derived from
the given parquet tables, and the steps of the pipelines in their plain, step-by-step form.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_ORACLE = Path(__file__).parent / "oracle"

# Scalar formulas of the checks, written out where they are called.
_FORMULAS = {
    "haversine_m": (
        "(2 * 6371000e0 * asin(sqrt(least(1e0, pow(sin(radians(({3}) - ({1})) / 2), 2)"
        " + cos(radians({1})) * cos(radians({3})) * pow(sin(radians(({2}) - ({0})) / 2), 2)))))"
    ),
    "unix_of": (
        "(case when {0} = '0000-00-00 00:00:00' then -62170185600"
        " else cast(epoch(try_strptime({0}, '%Y-%m-%d %H:%M:%S')) as bigint) end)"
    ),
    # One bit after the other: even positions halve the longitude range, odd ones the latitude.
    "geohash7_of": (
        "list_aggregate(list_transform(range(0, 7), lambda c: substr('0123456789bcdefghjkmnpqrstuvwxyz',"
        " 1 + cast(list_sum(list_transform(range(0, 5), lambda b: case when (5 * c + b) % 2 = 0"
        " then ((cast(floor((({0}) + 180e0) / 360e0 * 262144e0) as bigint) >> cast(17 - (5 * c + b) // 2 as bigint)) & 1)"
        " else ((cast(floor((({1}) + 90e0) / 180e0 * 131072e0) as bigint) >> cast(16 - (5 * c + b) // 2 as bigint)) & 1)"
        " end << cast(4 - b as bigint))) as bigint), 1)), 'string_agg', '')"
    ),
}


def _arguments(text: str, start: int) -> tuple[list[str], int]:
    """Arguments of a call whose opening bracket is at `start`, and the position after it."""
    depth, parts, last = 0, [], start + 1
    for i in range(start, len(text)):
        if text[i] == "(":
            depth += 1
        elif text[i] == ")":
            depth -= 1
            if depth == 0:
                return [*parts, text[last:i].strip()], i + 1
        elif text[i] == "," and depth == 1:
            parts.append(text[last:i].strip())
            last = i + 1
    raise ValueError("unbalanced brackets")


def _written_out(sql: str) -> str:
    for name, formula in _FORMULAS.items():
        while (at := sql.find(f"{name}(")) >= 0:
            arguments, end = _arguments(sql, at + len(name))
            sql = sql[:at] + formula.format(*arguments) + sql[end:]
    return sql


def _named_tables() -> dict[str, str]:
    tables: dict[str, str] = {}
    for path in sorted(_ORACLE.glob("*.sql")):
        for part in path.read_text(encoding="utf-8").split("-- @table ")[1:]:
            name, body = part.split("\n", 1)
            tables[name.strip()] = body.strip()
    return tables


_TABLES = _named_tables()


def _needed(sql: str) -> list[str]:
    """Named tables a text uses, each after the ones it uses itself."""
    order: list[str] = []

    def visit(text: str) -> None:
        for word in dict.fromkeys(re.findall(r"[a-z_][a-z_0-9]*", text)):
            if word in _TABLES and word not in order:
                visit(_TABLES[word])
                if word not in order:
                    order.append(word)

    visit(sql)
    return order


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    oracle: str | None = None
    rounds: dict[str, int] = field(default_factory=dict)

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        df = self.build(spark, sf_dir)
        return df.withColumns({c: F.round(F.col(f"`{c}`"), n) for c, n in self.rounds.items()})

    def sql(self) -> str | None:
        if self.oracle is None:
            return None
        body = f"({self.oracle})"
        tables = ",\n".join(f"{n} as (\n{_TABLES[n]}\n)" for n in _needed(self.oracle))
        replaced = ", ".join(f'round("{c}", {n}) as "{c}"' for c, n in self.rounds.items())
        chosen = f"* replace ({replaced})" if replaced else "*"
        return _written_out(
            (f"with {tables}\n" if tables else "") + f"select {chosen} from {body} as result"
        )


QUERIES: dict[str, Query] = {}


def query(name: str, oracle: str | None = None, rounds: dict[str, int] | None = None):
    """Register a builder under a name."""

    def register(build: Callable[[SparkSession, str], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = Query(name, build, oracle, rounds or {})
        return build

    return register
