import pytest
from pyspark.sql import functions as F

from doorclock.llm import warc


def leaves(spark, contents, per_file=8):
    rows = [(k // per_file, k % per_file, c) for k, c in enumerate(contents) if c is not None]
    df = spark.createDataFrame(rows, "file_no long, record_no int, record string").withColumn("record", F.encode("record", "UTF-8"))
    return warc.offsets(warc.hashed(df))


def audit(spark, left, right, fanout=3):
    a, b = (warc.tree(leaves(spark, x), fanout, 8) for x in (left, right))
    return {(r.file_no, r.record_no): r.problem for r in warc.differing(a, b, fanout).collect()}


@pytest.mark.parametrize("seed", range(3))
def test_finds_what_was_damaged_and_nothing_else(spark, seed):
    left = [f"record {k}" for k in range(41)]
    right = [("bad" if (k * 7 + seed) % 13 == 0 else None if (k * 5 + seed) % 17 == 0 else c) for k, c in enumerate(left)]
    want = {(k // 8, k % 8): "missing" if b is None else "changed" for k, (a, b) in enumerate(zip(left, right)) if a != b}
    assert audit(spark, left, right) == want
    back = {k: {"missing": "extra"}.get(v, v) for k, v in want.items()}
    assert audit(spark, right, left) == back


def test_equal_and_empty_replicas(spark):
    assert audit(spark, ["a", "a", "b"], ["a", "a", "b"]) == {}
    empty = leaves(spark, ["x"]).limit(0)
    assert warc.differing(warc.tree(empty), warc.tree(empty)).collect() == []
    assert audit(spark, ["a"] * 9, ["a"] * 8) == {(1, 0): "missing"}


def test_swapped_records_are_found(spark):
    assert audit(spark, ["a", "b", "c"], ["b", "a", "c"]) == {(0, 0): "changed", (0, 1): "changed"}


def test_records_numbers_and_offsets(spark):
    df = spark.createDataFrame([(3, "u", "x"), (1, None, None), (1, None, None), (None, "v", "é")], "page_id long, url string, html string")
    raw = df.select("page_id", warc.record_bytes(F.col("url"), F.col("html")).alias("record"))
    got = warc.offsets(warc.hashed(warc.numbered(raw, [F.col("page_id").asc_nulls_first(), F.col("record")], 3))).orderBy("file_no", "record_no").collect()
    assert [(r.page_id, r.file_no, r.record_no) for r in got] == [(None, 0, 0), (1, 0, 1), (1, 0, 2), (3, 1, 0)]
    assert [r.offset for r in got] == [0, got[0].length, got[0].length + got[1].length, 0]
    assert b"Content-Length: 2\r\n\r\n\xc3\xa9\r\n\r\n" in bytes(raw.where("page_id is null").first().record)


def test_records_behind_a_longer_one_are_intact(spark):
    """The rule on offsets: other places, equal records, equal nodes."""
    left, right = ([x, *[f"record {k}" for k in range(7)]] for x in ("short", "a good deal longer"))
    assert audit(spark, left, right) == {(0, 0): "changed"}
    places = [{r.record_no: r.offset for r in leaves(spark, x).collect()} for x in (left, right)]
    assert all(places[0][k] < places[1][k] for k in range(1, 8))


def test_extra_columns_of_clashing_names_and_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(warc, "RANGE_ROWS", 3)
    monkeypatch.setattr(warc, "RANGES", 2)
    df = spark.range(40).select((F.col("id") * 7 % 40).alias("page_id"), F.lit("x").alias("file"), F.lit(None).cast("int").alias("level"), F.lit("n").alias("node"))
    got = warc.numbered(df, [F.col("page_id")], 16).collect()
    assert {r.page_id: (r.file_no, r.record_no) for r in got} == {k: (k // 16, k % 16) for k in range(40)}
    assert all((r.file, r.level, r.node) == ("x", None, "n") for r in got)
