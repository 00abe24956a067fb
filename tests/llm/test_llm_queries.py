"""Registered queries against their SQL, the entry guard, and native plans."""

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import check_queries
import corpus_pipeline
from doorclock.llm.registry import ORACLE_SQL, QUERIES

REPO = Path(__file__).resolve().parents[2]


@pytest.fixture(scope="module")
def connection(tiny):
    db = duckdb.connect()
    for table in check_queries.TABLES:
        db.execute(f"create view {table} as select * from '{tiny}/{table}.parquet'")
    return db


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, tiny, connection, name):
    assert check_queries.compare(QUERIES[name](spark, tiny), connection.sql(ORACLE_SQL[name])) == ""


LONG, TEXT, FLAG, REAL = "bigint", "string", "boolean", "double"
CONTRACTS = {
    "op1_quality_rules": {
        "doc_id": LONG, "n_words": LONG, "word_chars": LONG, "n_symbols": LONG, "n_dup_lines": LONG, "n_repeat_words": LONG,
        "base_failed": FLAG, "kept": FLAG,
    },
    "op2_sentencepiece": {"doc_id": LONG},
    "op3_minhash_dedup": {"doc_id": LONG, "n_shingles": LONG, "component_id": LONG, "kept": FLAG},
    "op4_mixing": {"doc_id": LONG, "size": LONG, "source_size": LONG, "target": REAL, "taken": LONG},
    "op5_url_filters": {"page_id": LONG, "host": TEXT, "path": TEXT, "rule": TEXT, "verdict": TEXT},
    "op6_token_counts": {"doc_id": LONG},
    "op7_warc_fixity": {},
    "op8_language_id": {"doc_id": LONG, "held_out": FLAG, "lang_pred": TEXT, "score": REAL},
    "op9_substring_dedup": {"doc_id": LONG, "n_bytes": LONG, "n_removed": LONG, "n_spans": LONG, "kept_sha256": TEXT},
    "op10_embedding_dedup": {"vec_id": LONG, "n_links": LONG, "component_id": LONG, "kept": FLAG},
    "op11_source_divergence": {"lang": TEXT, "source": TEXT, "part": TEXT, "item": TEXT, "value": LONG, "rank": "int"},
    "op12_phrase_collocation": {"lang": TEXT, "phrase": TEXT, **dict.fromkeys(("rank", "a", "l", "r", "n", "score"), LONG)},
    "op13_secret_scan": {"doc_id": LONG, "n_assign": LONG, "n_access": LONG, "n_hex": LONG, "base_sha256": TEXT, "spans": TEXT},
}
TABLES = {"op5_url_filters": ("pages", "page_id"), "op10_embedding_dedup": ("embeddings", "vec_id")}
NO_ROW_PER_DOCUMENT = {"op7_warc_fixity", "op11_source_divergence", "op12_phrase_collocation"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_keeps_its_contract(spark, tiny, name):
    """Names and types of the columns, and a row for each row of the table where the contract says so."""
    got = QUERIES[name](spark, tiny)
    types = {c: t.split("(")[0] for c, t in got.dtypes}
    assert CONTRACTS[name].items() <= types.items()
    rows = got.collect()
    assert rows
    if name not in NO_ROW_PER_DOCUMENT:
        table, key = TABLES.get(name, ("documents", "doc_id"))
        ids = spark.read.parquet(f"{tiny}/{table}.parquet").select(key).collect()
        assert sorted(r[key] for r in rows) == sorted(r[0] for r in ids)


def test_pipeline_runs_as_a_query(spark, tiny):
    got = corpus_pipeline.run(spark, tiny)
    assert dict(got.dtypes)["pieces"] == "array<int>" and got.count() > 0


@pytest.mark.parametrize("name", ["op1_quality_rules", "op4_mixing", "op5_url_filters", "op7_warc_fixity"])
def test_no_python_and_no_cross_join(spark, tiny, name):
    plan = QUERIES[name](spark, tiny)._jdf.queryExecution().executedPlan().toString()
    for node in ("Python", "Arrow", "Pandas", "CartesianProduct", "NestedLoopJoin"):
        assert node not in plan


def test_entry_works_without_this_part():
    code = (
        "import sys\n"
        "class Gone:\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name in ('corpus_pipeline', 'doorclock.llm'):\n"
        "            raise ModuleNotFoundError(name, name=name)\n"
        "sys.meta_path.insert(0, Gone())\n"
        "import __spark_entry__ as e\n"
        "assert 'c_dwell' in e.queries() and 'pipeline' not in e.queries()\n"
        "assert not any(q.startswith('op') and q[2].isdigit() for q in e.queries())\n"
    )
    subprocess.run([sys.executable, "-c", code], cwd=REPO, check=True, timeout=120)
