"""Every stage of the pipeline on what the one before it kept, against brute force."""

import random
from collections import Counter

import pytest
import sentencepiece
from test_minhash import by_hand as components
from test_quality import by_hand as measures
from test_substrings import by_hand as without_repeats

import corpus_pipeline
from doorclock.llm import mixing, substrings
from doorclock.llm.pieces import MODEL

NAMES = ["quality rules", "MinHash near-dedup", "suffix-array dedup", "mixing sources", "SentencePiece encoding"]


@pytest.fixture(scope="module")
def stages(spark, tiny, tmp_path_factory):
    """Documents, and the result of each stage, written and read again."""
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    out = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(k))
        stage(spark, out[-1], tiny).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_names_and_columns(stages):
    assert [name for name, _ in corpus_pipeline.STAGES] == NAMES
    assert all(s.columns == stages[0].columns for s in stages[:-1])
    assert stages[-1].columns == [*stages[0].columns, "pieces"]


def test_quality(stages):
    want = set()
    for r in stages[0].collect():
        n, *_, repeated = measures(r.text)
        if n >= 50 and 100 * repeated <= 50 * n:
            want.add(r.doc_id)
    assert set(rows(stages[1])) == want and 0 < len(want) < stages[0].count()


def test_near_duplicates(stages):
    before = [(r.doc_id, r.text) for r in stages[1].collect()]
    want = {i for i, (_, root) in components(before, 5, 80).items() if i == root}
    assert set(rows(stages[2])) == want and stages[2].count() == len(want) < len(before)


def test_repeated_passages(stages):
    want = without_repeats([(r.doc_id, r.text) for r in stages[2].collect()])
    got = rows(stages[3])
    assert {i: r.text for i, r in got.items()} == {i: data.decode("utf-8", "ignore") for i, (data, *_) in want.items()}
    assert any(n for _, n, _ in want.values())


def test_mix(stages):
    want = {r.doc_id: r.copies for r in mixing.mixed(stages[3], mixing.cyclic_weights).collect() if r.copies}
    assert Counter(r.doc_id for r in stages[4].collect()) == want and max(want.values()) > 1


def test_pieces(stages):
    got = stages[5].collect()
    assert [r.pieces for r in got] == sentencepiece.SentencePieceProcessor(model_file=MODEL).encode([r.text for r in got])
    assert len(got) == stages[4].count()


def test_odd_rows(spark, odd_documents, no_documents, tmp_path):
    for k, start in enumerate((odd_documents, no_documents)):
        docs = start
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            path = str(tmp_path / f"{k}-{i}")
            stage(spark, docs, "").write.parquet(path)
            docs = spark.read.parquet(path)
        assert (docs.count() > 0) == (k == 0)


def test_near_duplicates_of_one_id(spark):
    one, other = (" ".join(f"{w}{k}" for k in range(100)) for w in "ab")
    rows = [(5, one, "x"), (5, other, "x"), (12, other, "x"), (12, one + " end", "x"), (7, "c d e f g h", "x"), (None, one, "x"), (5, one, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = corpus_pipeline.near_duplicates(spark, df, "").collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter([(5, one), (5, other), (7, "c d e f g h"), (None, one)])


def test_columns_named_like_results_keep_their_values(spark):
    names = ["kept", "n_words", "host_docs", "size", "target", "copies", "taken", "row"]
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(60 + i)), f"s{i % 3}", *[f"{n}{i}" for n in names]) for i in range(12)]
    df = spark.createDataFrame(rows, ["doc_id", "text", "source", *names])
    for stage in (corpus_pipeline.quality_rules, corpus_pipeline.source_mix):
        got = stage(spark, df, "")
        assert got.schema.simpleString() == df.schema.simpleString()
        assert {tuple(r) for r in got.collect()} <= set(rows) and got.count() > 0


def test_passage_of_very_many_documents_goes_but_for_the_first(spark, monkeypatch):
    """More different runs at either border than a suffix array takes; what they left on disk goes before texts move again."""
    rng, seen, real = random.Random(11), [], substrings.staged
    monkeypatch.setattr(substrings, "staged", lambda df, name: (seen.append(name), real(df, name))[1])
    monkeypatch.setattr(substrings, "released", lambda spark: seen.append("released"))
    shared = "".join(rng.choice("abcdefghij ") for _ in range(160))
    parts = [("".join(rng.choices("klmnop", k=70)), "".join(rng.choices("qrst", k=70))) for _ in range(substrings.SPLIT + 300)]
    rows = [(k, a + shared + b) for k, (a, b) in enumerate(parts)]
    kept = corpus_pipeline.repeated_passages(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(8), "")
    got = {r.doc_id: r.text for r in kept.collect()}
    assert seen == ["runs", "released", "found", "released"]
    ends, begins = set(), set()
    for k, (a, b) in enumerate(parts):
        # What an earlier text has beside the passage too goes with it.
        left = max((j for j in range(1, 61) if a[-j:] in ends), default=0)
        right = max((j for j in range(1, 61) if b[:j] in begins), default=0)
        assert got[k] == (a[: len(a) - left] + b[right:] if k else a + shared + b)
        ends.update(a[-j:] for j in range(1, 61))
        begins.update(b[:j] for j in range(1, 61))
