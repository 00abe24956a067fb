"""Column expressions that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = "[\\x20\\x09-\\x0D]+"
WORD = "[^\\x20\\x09-\\x0D]+"


def words(text: Column) -> Column:
    """Words of a text in order; none for null."""
    found = F.array_remove(F.split(text, SPACE), "")
    return F.coalesce(found, F.array().cast("array<string>"))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def unit_hash(*parts: Column) -> Column:
    """A repeatable number from [0, 1) out of the md5 of the parts."""
    named = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(named), 1, 13), 16, 10).cast("long") / F.lit(float(2**52))


def packed(df: DataFrame) -> DataFrame:
    """Each row as one struct `row`, so that an operator's own columns meet no equal names."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))


def unpacked(df: DataFrame, columns: list[str], added: dict[str, Column] | None = None) -> DataFrame:
    """The rows' columns again, with `added` ones after them; an added name replaces an equal one."""
    added = added or {}
    if added:
        # Apart from the output names, which expressions could be taken to mean.
        df = df.select("row", F.struct(*[value.alias(name) for name, value in added.items()]).alias("added"))
    kept = [F.col("row").getField(c).alias(c) for c in columns if c not in added]
    return df.select(*kept, *[F.col("added").getField(c).alias(c) for c in added])
