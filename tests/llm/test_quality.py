import re

import pytest
from pyspark.sql import functions as F

from doorclock.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def by_hand(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    twice = {g for g in grams if grams.count(g) > 1}
    covered = {p for i, g in enumerate(grams) if g in twice for p in (i, i + 1, i + 2)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered))


TEXTS = [None, "", " \n\t", "a", "a b", "a b c", "a b c a b c", "a a a a", "a a a a a", "x y z w x y z", "l\nl\n\n\nl \nl", "# * é <b>&|", "q w e r q w e t q w e"]


def test_measures(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id int, text string")
    got = {r.doc_id: tuple(r[m] for m in quality.MEASURES) for r in quality.measured(df).collect()}
    assert got == {i: by_hand(t) for i, t in enumerate(TEXTS)}


def test_failing_host_takes_its_documents_along(spark):
    good, bad = " ".join(f"w{k}" for k in range(60)), "too short"
    rows = [(i, good, "fine") for i in range(200)] + [(1000 + i, bad, "farm") for i in range(200)] + [(2000, good, "farm"), (3000, bad, "fine"), (4000, bad, "new"), (4001, good, "new")]
    got = {r.doc_id: r for r in quality.judged(spark.createDataFrame(rows, "doc_id int, text string, source string")).collect()}
    assert got[0].kept and not got[3000].kept and got[3000].base_failed
    assert not got[2000].base_failed and got[2000].host_failing and not got[2000].kept
    assert got[4001].kept and 0.3 < got[4001].host_rate < 0.7  # two documents say little


def test_a_host_is_measured_by_its_corpus(spark):
    """A rate of 0.4 is far above a corpus of 0.05, near one of 0.3, and says little of a host of five documents."""
    good, bad = " ".join(f"w{k}" for k in range(60)), "too short"

    def failing(hosts):
        rows = [(bad if i < failed else good, host) for host, n, failed in hosts for i in range(n)]
        got = quality.judged(spark.createDataFrame(rows, "text string, source string"))
        return {r.source for r in got.where("host_failing").select("source").distinct().collect()}

    usual = [(f"h{k}", 200, 10) for k in range(12)]
    assert failing([*usual, ("odd", 200, 80), ("small", 5, 2)]) == {"odd"}
    assert failing([*[(f"h{k}", 200, 60) for k in range(12)], ("odd", 200, 80)]) == set()


@pytest.mark.parametrize("rates", [[0.1] * 8, [0.0] * 5, [1.0] * 5, [0.05, 0.5, 0.9]])
def test_prior_keeps_the_mean(spark, rates):
    hosts = spark.createDataFrame([(100 * (k + 1), round(100 * (k + 1) * r)) for k, r in enumerate(rates)], "host_docs long, host_failed long")
    a, b = quality.beta_prior(hosts)
    total = hosts.agg((F.sum("host_failed") / F.sum("host_docs")).alias("m")).first().m
    assert a >= 0 and b >= 0 and a / (a + b) == pytest.approx(total)


def test_odd_rows(odd_documents, no_documents):
    got = quality.judged(odd_documents).select("doc_id", "n_words", "kept", "tags").collect()
    assert len(got) == odd_documents.count()
    assert {r.n_words for r in got if r.doc_id in (4, 5, 6)} == {0}
    assert not any(r.kept for r in got if r.doc_id in (4, 5, 6))
    assert quality.judged(no_documents).collect() == []
