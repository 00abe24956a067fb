"""Null words, delimiters, JSON fields and street-address expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Digits and the ten, in order of value (fixed by the language).
_CN_DIGITS = "一二三四五六七八九"
_CN_TEN = "十"
_CN_RUN = f"[{_CN_DIGITS}{_CN_TEN}]+"
_CN_SEGMENTS = f"{_CN_RUN}|[^{_CN_DIGITS}{_CN_TEN}]+"

# Address patterns (fixed values): where a floor or a building number is written.
BASEMENT_PATTERN = r"-\d楼|-\d层|-\d[fF]"
FLOOR_PATTERN = r"\d+楼|\d{3,4}$|\d{3,4} |\d{3,4}室|\d{3,4}房|\d+层|\d+[A-Za-z]"
FLOOR_PATTERN_PLAIN = r"\d+楼|\d{3,4}$|\d{3,4} |\d{3,4}室|\d{3,4}房|\d+层|\d+[fF]"
FLOOR_UNITS = r"楼|室|层|房|[A-Za-z]| "
BUILDING_PATTERN = r"\d+号楼|\d+栋|\d+幢"
BUILDING_UNITS = r"号楼|栋|幢"
NO_FLOOR = 0
NO_BUILDING = -999

NULL_WORDS = "NULL|Null|None"
NULL_REPLACEMENT = "-1"


def mask_null_words(line: Column) -> Column:
    """Replace the words for a missing value anywhere in a line."""
    return F.regexp_replace(line, NULL_WORDS, NULL_REPLACEMENT)


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def split_fields(line: Column) -> Column:
    """Fields of a line: by tab if it has one, else by comma, else by runs of blanks."""
    return (
        F.when(F.contains(line, F.lit("\t")), F.split(line, "\t"))
        .when(F.contains(line, F.lit(",")), F.split(line, ","))
        .otherwise(F.split(line, r"\s+"))
    )


def json_field(text: Column, *path: str) -> Column:
    """A field of JSON text; each further name looks into the field before it."""
    for name in path:
        text = F.get_json_object(text, f"$.{name}")
    return text


def numeral_value(run: Column) -> Column:
    """Value of a run of Chinese numerals up to 99; digits that merely follow each other add up."""
    signs = F.split(run, "")

    def worth(sign: Column, i: Column) -> Column:
        digit = F.instr(F.lit(_CN_DIGITS), sign)
        followed_by_ten = F.coalesce(F.get(signs, i + 1) == _CN_TEN, F.lit(False))
        return digit * F.when(followed_by_ten, 10).otherwise(1)

    digits = F.aggregate(
        F.transform(signs, worth), F.lit(0), lambda total, value: total + value
    )
    return digits + F.when(F.startswith(run, F.lit(_CN_TEN)), 10).otherwise(0)


def arabic_address(address: Column) -> Column:
    """Address with Chinese numerals as digits and basement letters as a minus sign."""
    pieces = F.transform(
        F.regexp_extract_all(address, F.lit(_CN_SEGMENTS), F.lit(0)),
        lambda s: F.when(s.rlike(f"^{_CN_RUN}$"), numeral_value(s).cast("string")).otherwise(s),
    )
    return F.translate(F.array_join(pieces, ""), "Bb负", "---")


def address_floor(address: Column, pattern: str = FLOOR_PATTERN) -> Column:
    """Floor named in an address: a basement first, then the first floor or room number."""
    plain = arabic_address(address)
    basement = F.regexp_extract(plain, BASEMENT_PATTERN, 0)
    found = F.when(basement != "", basement).otherwise(F.regexp_extract(plain, pattern, 0))
    number = F.regexp_replace(found, FLOOR_UNITS, "")
    # A room number such as 1803 holds the floor in front of its last two digits.
    floor = F.when(
        F.length(number) > 2, F.substr(number, F.lit(1), F.length(number) - 2)
    ).otherwise(number)
    return F.when(found == "", F.lit(NO_FLOOR).cast("long")).otherwise(floor.try_cast("long"))


def address_building(address: Column) -> Column:
    """Building number named in an address."""
    found = F.regexp_extract(arabic_address(address), BUILDING_PATTERN, 0)
    number = F.regexp_replace(found, BUILDING_UNITS, "").try_cast("long")
    return F.when(found == "", F.lit(NO_BUILDING).cast("long")).otherwise(number)
