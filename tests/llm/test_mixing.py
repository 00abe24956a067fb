from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import check_queries
import corpus_pipeline
from doorclock.llm import mixing


def by_hand(sizes, weights):
    """Targets by sharing the excess anew until no source is above three times its size."""
    total, full = sum(sizes), set()
    while True:
        left = total - sum(3 * sizes[k] for k in full)
        open_ = [k for k in range(len(sizes)) if k not in full]
        share = {k: left * weights[k] / sum(weights[j] for j in open_) for k in open_}
        above = {k for k, v in share.items() if v > 3 * sizes[k] + 1e-9}
        if not above:
            return [3 * sizes[k] if k in full else share[k] for k in range(len(sizes))]
        full |= above


@pytest.mark.parametrize("sizes", [[10, 100, 1000], [1, 2, 3, 1000, 50], [5], [0, 10, 0], [7] * 9, [0, 0]])
def test_targets(spark, sizes):
    weights = [(5, 2, 1)[k % 3] for k in range(len(sizes))]
    df = spark.createDataFrame([(f"s{k}", s) for k, s in enumerate(sizes)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(mixing.cyclic_weights(df)).collect()}
    assert [got[f"s{k}"] for k in range(len(sizes))] == pytest.approx(by_hand(sizes, weights))


def test_sources_in_code_point_order_null_last(spark):
    names = ["é", "Z", "a", None, "", "b"]
    df = spark.createDataFrame([(n, 1) for n in names], "source string, source_size long")
    got = {r.source: r.weight for r in mixing.cyclic_weights(df).collect()}
    assert [got[n] for n in ["", "Z", "a", "b", "é", None]] == [5, 2, 1, 5, 2, 1]


def test_taken_words_come_near_the_targets(spark, documents):
    mix = mixing.mixed(documents, mixing.cyclic_weights)
    got = mix.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.max("size").alias("most")).collect()
    assert all(abs(r.taken - r.target) <= r.most / 2 + 1e-6 for r in got)
    assert mix.where("taken > 3 * size").isEmpty()
    again = mixing.mixed(documents.repartition(7), mixing.cyclic_weights)
    assert sorted(mix.select("doc_id", "taken").collect()) == sorted(again.select("doc_id", "taken").collect())


def test_repeated_rows_make_the_mix(spark, documents):
    mix = mixing.mixed(documents, mixing.cyclic_weights)
    rows = mixing.repeated(mix, documents.columns)
    assert rows.columns == documents.columns
    assert rows.count() == mix.agg(F.sum("copies")).first()[0]


def test_odd_rows(odd_documents, no_documents):
    got = mixing.mixed(odd_documents, mixing.cyclic_weights).select("doc_id", "size", "source_size", "target", "taken", "tags").collect()
    assert len(got) == odd_documents.count()
    assert all(0 <= r.taken <= 3 * r["size"] for r in got)
    assert {r["size"] for r in got if r.doc_id in (4, 5, 6)} == {0}
    assert mixing.mixed(no_documents, mixing.cyclic_weights).collect() == []


def even_rows():
    """Three sources of equal size, whose targets are whole words; texts of no word stand among the others."""
    rows = [(10 * k + i, f"word{10 * k + i}", f"s{k}") for k in range(3) for i in range(8)]
    return rows + [(100 + i, " " * i, f"s{i % 3}") for i in range(60)]


def test_words_that_end_on_the_target(spark):
    rows = even_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mix = mixing.mixed(df, mixing.cyclic_weights).select("doc_id", "size", "source_size", "target", "taken", "copies")
    got = {r.source: (r.target, r.taken) for r in mix.join(df.select("doc_id", "source"), "doc_id").groupBy("source").agg(
        F.first("target").alias("target"), F.sum("taken").alias("taken")).collect()}
    assert got == {"s0": (15, 15), "s1": (6, 6), "s2": (3, 3)}
    db = duckdb.connect()
    db.execute("create table documents (doc_id bigint, text varchar, source varchar)")
    db.executemany("insert into documents values (?, ?, ?)", rows)
    assert check_queries.compare(mix, db.sql(mixing.ORACLE_SQL)) == ""
    copies = {r.doc_id: r.copies for r in mix.collect() if r.copies}
    assert Counter(r.doc_id for r in corpus_pipeline.source_mix(spark, df, "").collect()) == copies


def test_inclusion_is_in_proportion_to_size(spark):
    """Over many seeds, a document's extra copies follow its words; those that would go beyond 1 are always taken."""
    sizes = [1] * 30 + [4] * 30 + [12] * 10 + [400]
    rows = [(k, " ".join(["w"] * n), "a") for k, n in enumerate(sizes)] + [(999, " ".join(["w"] * 4000), "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")

    def weights(sizes_of):
        return sizes_of.withColumn("weight", F.when(F.col("source") == "a", 52).otherwise(400))  # about 1 word in 9 once more

    plan = {r.source: r.target for r in mixing.targets(weights(spark.createDataFrame([("a", sum(sizes)), ("b", 4000)], "source string, source_size long"))).collect()}
    wanted = plan["a"] - sum(sizes) * (plan["a"] // sum(sizes))
    seeds, taken = 20, Counter()
    for seed in range(seeds):
        for r in mixing.mixed(df, weights, seed=f"s{seed}").where("source = 'a'").select("doc_id", "copies").collect():
            taken[r.doc_id] += r.copies - int(plan["a"] // sum(sizes))
    squares = sum(n * n for n in sizes if n < 400)
    certain = wanted / sum(n * n for n in sizes) * 400 >= 1
    factor = (wanted - 400) / squares if certain else wanted / sum(n * n for n in sizes)
    for n in (1, 4, 12):
        own = [taken[k] / seeds for k, m in enumerate(sizes) if m == n]
        assert sum(own) / len(own) == pytest.approx(min(1, factor * n), abs=0.1)
    if certain:
        assert taken[len(sizes) - 1] == seeds
