"""Fixity audit of WARC replicas by Merkle trees.

Pages are laid out as WARC response records: in a fixed order, so many to a file, each at the byte
offset where the one before it ends. Every record's bytes are hashed; `FANOUT` neighbours in offset
order are hashed into a node, and so on up to one root per file. Two replicas are compared root by
root, and only below roots that differ are the children compared, down to the records. Built from
DataFrame functions only.

A node's hash covers its ranges in their order, by number and content, not by their absolute place: a
record that has become longer moves all records behind it in the file, and those are intact. Each
node carries the bytes it spans in its own replica, and the audit reports where a bad record lies in either.

Defined results: a null URL or body is written as an empty one; rows are ordered by id, nulls first,
then by content, and equal rows are separate equal records; a record that one replica lacks is
reported as missing or extra; empty replicas are equal; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from doorclock.plans.staging import staged

RECORDS_PER_FILE = 1024
FANOUT = 16
RANGES, RANGE_ROWS = 64, 100_000  # at least so many ranges of records, and about so many rows in one


def record_bytes(url: Column, body: Column) -> Column:
    """A WARC/1.0 response record; its date is fixed, so that equal pages give equal bytes."""
    body = F.coalesce(body, F.lit(""))
    head = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: "),
        F.coalesce(url, F.lit("")),
        F.lit("\r\nWARC-Date: 2020-01-01T00:00:00Z\r\nContent-Type: text/html\r\nContent-Length: "),
        F.octet_length(body).cast("string"),
        F.lit("\r\n\r\n"),
    )
    return F.encode(F.concat(head, body, F.lit("\r\n\r\n")), "UTF-8")


def hashed(records: DataFrame, content: str = "record") -> DataFrame:
    """`leaf` and `length` of records that have `file_no`, `record_no` and their bytes."""
    return records.withColumns(
        {"leaf": F.sha2(content, 256), "length": F.octet_length(content).cast("long")}
    ).drop(content)


def numbered(pages: DataFrame, order: list[Column], per_file: int = RECORDS_PER_FILE) -> DataFrame:
    """Rows numbered in a global order as `file_no`, `record_no`.

    The order is cut into ranges at sampled places, rows are counted per range, and each range is
    numbered from the count before it: no task sees more than its range.
    """
    ranges = max(RANGES, -(-pages.count() // RANGE_ROWS))
    ranged = staged(pages.repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id()), "warc_ranges")
    counts = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    at = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1 + F.col("_start")
    return (
        ranged.join(starts, "_range")  # one row per range
        .withColumn("_at", at)
        .withColumns({"file_no": F.floor(F.col("_at") / per_file), "record_no": (F.col("_at") % per_file).cast("int")})
        .drop("_range", "_start", "_at")
    )


def offsets(leaves: DataFrame) -> DataFrame:
    """Byte `offset` of each record in its file; a file has a bounded number of records."""
    before = Window.partitionBy("file_no").orderBy("record_no").rowsBetween(Window.unboundedPreceding, -1)
    return leaves.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)))


def tree(leaves: DataFrame, fanout: int = FANOUT, per_file: int = RECORDS_PER_FILE) -> DataFrame:
    """Nodes (file_no, level, node, hash, offset range) above the leaves; level 0 are the records."""
    level = leaves.select(
        "file_no", F.lit(0).alias("level"), F.col("record_no").cast("long").alias("node"), F.col("leaf").alias("hash"),
        F.col("offset").alias("from_byte"), (F.col("offset") + F.col("length")).alias("to_byte"),
    )
    levels, width, depth = [level], per_file, 0
    while width > 1:
        width, depth = -(-width // fanout), depth + 1
        ordered = F.array_sort(F.collect_list(F.struct("node", "hash")))  # at most `fanout` of them
        level = level.groupBy("file_no", F.floor(F.col("node") / fanout).alias("above")).agg(
            F.sha2(F.array_join(F.transform(ordered, lambda x: F.concat(x["node"].cast("string"), F.lit("="), x["hash"])), "\n"), 256).alias("hash"),
            F.min("from_byte").alias("from_byte"), F.max("to_byte").alias("to_byte"),
        ).select("file_no", F.lit(depth).alias("level"), F.col("above").alias("node"), "hash", "from_byte", "to_byte")
        levels.append(level)
    out = levels[0]
    for one in levels[1:]:
        out = out.unionByName(one)
    return out


def differing(left: DataFrame, right: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """Records that differ between two trees: file_no, record_no, both hashes and offsets, problem.

    Descends from the roots: nodes of a level are compared only if their parents differ. Trees stored by
    `level` are read one level at a time, and where few nodes differ, only those below them are moved.
    """
    top = left.unionByName(right).agg(F.max("level").alias("top")).first().top
    found = None
    for level in range(top or 0, -1, -1):
        sides = []
        for tree_of, side in ((left, "a"), (right, "b")):
            nodes = tree_of.where(F.col("level") == level).select(
                "file_no", "node", F.col("hash").alias(f"hash_{side}"), F.col("from_byte").alias(f"offset_{side}")
            )
            if found is not None:
                above = found.select("file_no", F.col("node").alias("_above"))
                nodes = nodes.withColumn("_above", F.floor(F.col("node") / fanout)).join(above, ["file_no", "_above"], "left_semi").drop("_above")
            sides.append(nodes)
        # Written, so that each level's size is known and the one below is joined by it.
        found = staged(sides[0].join(sides[1], ["file_no", "node"], "full").where(~F.col("hash_a").eqNullSafe(F.col("hash_b"))), "warc_level")
    problem = F.when(F.col("hash_b").isNull(), "missing").when(F.col("hash_a").isNull(), "extra").otherwise("changed")
    return found.select("file_no", F.col("node").cast("int").alias("record_no"), "offset_a", "offset_b", "hash_a", "hash_b", problem.alias("problem"))


def _damaged(id_column: str) -> tuple[Column, Column]:
    """Records of the second replica that a storage fault hit: changed, lost. By id, to be repeatable."""
    fault = F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit(""))) % 1000
    return fault < 7, (fault >= 7) & (fault < 10)


def query(spark, sf_dir: str) -> DataFrame:
    """All records of an archive of `pages`, audited against a replica with deterministic faults."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    raw = pages.select("page_id", record_bytes(F.col("url"), F.col("html")).alias("record"))
    changed, lost = _damaged("page_id")
    rotten = F.encode(F.concat(F.decode("record", "UTF-8"), F.lit("\0")), "UTF-8")
    both = raw.select(
        "page_id", F.sha2("record", 256).alias("leaf"), F.octet_length("record").cast("long").alias("length"),
        F.when(changed, F.sha2(rotten, 256)).when(~lost, F.sha2("record", 256)).alias("leaf_b"),
        (F.octet_length("record") + changed.cast("long")).cast("long").alias("length_b"),
    )
    order = [F.col("page_id").asc_nulls_first(), F.col("leaf")]
    records = staged(numbered(both, order), "warc_records")
    a = offsets(records.select("page_id", "file_no", "record_no", "leaf", "length"))
    b = offsets(
        records.where("leaf_b is not null").select("file_no", "record_no", F.col("leaf_b").alias("leaf"), F.col("length_b").alias("length"))
    )
    trees = [staged(tree(x), "warc_tree", "level") for x in (a, b)]
    bad = differing(*trees).select("file_no", "record_no", "offset_b", "hash_b", "problem")
    return a.join(bad, ["file_no", "record_no"], "left").select(
        "page_id", "file_no", "record_no", "offset", "length", "leaf", "offset_b", "hash_b",
        F.coalesce("problem", F.lit("intact")).alias("status"),
    )


ORACLE_SQL = """
with raw as (select page_id, concat('WARC/1.0', chr(13), chr(10), 'WARC-Type: response', chr(13), chr(10), 'WARC-Target-URI: ',
    coalesce(url, ''), chr(13), chr(10), 'WARC-Date: 2020-01-01T00:00:00Z', chr(13), chr(10), 'Content-Type: text/html', chr(13), chr(10),
    'Content-Length: ', octet_length(encode(coalesce(html, ''))), chr(13), chr(10), chr(13), chr(10), coalesce(html, ''),
    chr(13), chr(10), chr(13), chr(10)) as t from pages),
-- the faults of the second replica: page ids whose crc32 is below 7 (changed) or below 10 (lost) modulo 1000
bits as (select page_id, list_reduce(list_prepend(4294967295::ubigint, list_transform(range(1, length(coalesce(page_id::varchar, '')) + 1),
    lambda i: ascii(substr(page_id::varchar, i::int, 1))::ubigint)),
    lambda c, x: list_reduce(list_prepend(xor(c, x), [0, 0, 0, 0, 0, 0, 0, 0]::ubigint[]),
      lambda v, k: case when v % 2 = 1 then xor(v // 2, 3988292384::ubigint) else v // 2 end)) as c
  from (select distinct page_id from pages)),
crc as (select page_id, xor(c, 4294967295::ubigint) % 1000 as fault from bits),
n as (select raw.page_id, t, fault, row_number() over (order by raw.page_id nulls first, sha256(t)) - 1 as pos,
    octet_length(encode(t))::bigint as length from raw join crc on raw.page_id is not distinct from crc.page_id),
f as (select *, cast(pos // 1024 as bigint) as file_no, cast(pos % 1024 as int) as record_no from n)
select page_id, file_no, record_no, length, sha256(t) as leaf,
  cast(coalesce(sum(length) over before, 0) as bigint) as "offset",
  cast(case when fault < 7 then coalesce(sum(case when fault < 7 then length + 1 when fault < 10 then 0 else length end) over before, 0) end as bigint) as offset_b,
  case when fault < 7 then sha256(t || chr(0)) end as hash_b,
  case when fault < 7 then 'changed' when fault < 10 then 'missing' else 'intact' end as status
from f window before as (partition by file_no order by record_no rows between unbounded preceding and 1 preceding)
"""
