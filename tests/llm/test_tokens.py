import numpy as np
import pytest
from tokenizers import Tokenizer

from doorclock.llm import tokens as T

SAME_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"


@pytest.fixture(scope="module")
def ranks():
    return T.read_ranks()


def by_hand(fields, rule):
    """Counts from another encoder's character offsets of the whole text."""
    encoder = Tokenizer.from_file(SAME_VOCABULARY)
    encoder.encode_special_tokens = True
    fields = [f or "" for f in fields]
    text = "\n".join(fields)
    owner, names, at = [], [], 0
    for k, field in enumerate(fields):
        for line, part in enumerate(field.split("\n")):
            names.append((k, line))
            owner += [len(names) - 1] * (len(part) + 1)
    counts = [0] * len(names)
    for a, b in encoder.encode(text, add_special_tokens=False).offsets:
        own = owner[a:b]
        counts[own[0] if rule == "first" else own[-1]] += 1
    return names, counts


@pytest.mark.parametrize("rule", ["first", "last"])
def test_counts_equal_offsets_of_another_encoder(spark, documents, ranks, rule):
    df = documents.limit(60).select("doc_id", "source", "text")
    for r in T.attributed(df, ranks, rule=rule).collect():
        names, counts = by_hand([r.source, r.text], rule)
        assert [(s.field, s.line) for s in r.sections] == names
        assert [s.tokens for s in r.sections] == counts and r.n_tokens == sum(counts)


def test_crossing_tokens_go_by_the_rule():
    starts, ends, sections = np.array([0, 2, 6]), np.array([2, 6, 7]), np.array([0, 3, 4])
    assert T.section_of(starts, ends, sections, "first").tolist() == [0, 0, 2]
    assert T.section_of(starts, ends, sections, "last").tolist() == [0, 2, 2]
    assert T.section_of(starts, ends, sections, "most").tolist() == [0, 2, 2]
    assert T.section_of(np.array([2]), np.array([4]), np.array([0, 3]), "most").tolist() == [0]


def test_blank_lines_cross(spark, ranks):
    df = spark.createDataFrame([(1, "a", "x\n\n\ny")], "doc_id long, source string, text string")
    one = T.attributed(df, ranks).first()
    assert one.n_crossing > 0 and sum(s.tokens for s in one.sections) == one.n_tokens


def test_odd_rows(odd_documents, no_documents, ranks):
    got = T.attributed(odd_documents, ranks).collect()
    assert len(got) == odd_documents.count()
    assert all(sum(s.tokens for s in r.sections) == r.n_tokens for r in got)
    assert all(len(r.sections) == 1 + (r.text or "").count("\n") + 1 for r in got)
    assert T.attributed(no_documents, ranks).collect() == []
    with pytest.raises(ValueError):
        T.attributed(odd_documents, ranks, rule="half")
