import numpy as np
import pytest
from pyspark.sql import functions as F

from doorclock.llm import language as L

SMALL = L.Settings(hidden=3, piece_chars=6, steps=1, batch=4)


def test_gradients_equal_differences():
    rng = np.random.default_rng(0)
    model = L.trained([("a", b"abcdef"), ("b", b"ghijkl"), ("c", b"mnopqr")], SMALL)
    for group in (model.inputs, model.states):
        group[:] = [x.astype(np.float64) for x in group]
    model.weights, model.bias = model.weights.astype(np.float64), model.bias.astype(np.float64)
    data, labels = rng.integers(97, 115, (6, 4)), np.array([0, 1, 2, 1])
    _, grads = L.gradients(model, data, labels)
    for p, g in zip(model.parameters(), grads):
        for at in [tuple(rng.integers(0, s) for s in p.shape) for _ in range(6)] + [np.unravel_index(np.abs(g).argmax(), g.shape)]:
            keep, step = p[at], 1e-3
            p[at] = keep + step
            up = L.gradients(model, data, labels)[0]
            p[at] = keep - step
            down = L.gradients(model, data, labels)[0]
            p[at] = keep
            assert g[at] == pytest.approx((up - down) / (2 * step), abs=2e-3)


def test_segments_equal_one_text_at_a_time():
    model = L.trained([("a", b"abcdef"), ("b", b"ghijkl")], SMALL)
    texts = [b"", b"a", b"abcghi" * 50, b"x" * 256, b"yz" * 300, "é日".encode() * 9]
    together = L.probabilities(model, texts, SMALL)
    apart = np.concatenate([L.probabilities(model, [t], L.Settings(hidden=3, at_once=1)) for t in texts])
    assert np.allclose(together, apart, atol=1e-6)
    assert np.allclose(together[1:].sum(1), 1) and together[0].sum() == 0


def test_held_out_accuracy(spark, documents):
    sample = L.sample(documents)
    assert sample == L.sample(documents.repartition(5))
    model = L.trained(sample)
    out = L.predicted(documents.select("doc_id", "text", "lang"), model).where(L.held_out(F.col("doc_id")))
    assert out.where("lang = lang_pred").count() >= 0.97 * out.count()
    assert out.where("score < 0 or score > 1").isEmpty()


def one_byte_after_the_other(model, text, segment):
    """The network without any batching: a loop over segments, directions and bytes."""
    def soft(x):
        return x / (1 + np.abs(x))

    total, h = np.zeros(len(model.languages)), model.states[0].shape[1]
    for at in range(0, len(text), segment):
        part, states = text[at : at + segment], [[], []]
        for direction, order in ((0, part), (1, part[::-1])):
            state = np.zeros(h)
            for byte in order:
                x, a = model.inputs[direction][byte].astype(float), model.states[direction].astype(float) @ state
                reset, update = 0.5 + 0.5 * soft(x[:h] + a[:h]), 0.5 + 0.5 * soft(x[h : 2 * h] + a[h : 2 * h])
                candidate = soft(x[2 * h :] + reset * a[2 * h :])
                state = (1 - update) * candidate + update * state
                states[direction].append(state)
        for before, after in zip(states[0], states[1][::-1], strict=True):
            logits = model.weights @ np.concatenate([before, after]) + model.bias
            p = np.exp(logits - logits.max())
            total += p / p.sum()
    return total / max(len(text), 1)


def test_probabilities_equal_a_plain_loop():
    settings = L.Settings(hidden=4, piece_chars=8, steps=20, batch=4, segment=50)
    model = L.trained([("a", b"abcdefgh"), ("b", b"ghijklmn"), ("c", "éèüß".encode())], settings)
    texts = [b"a", b"abcghi" * 30, "é日本 x".encode() * 9, bytes(range(256)), b"z" * 50, b"z" * 51]
    got = L.probabilities(model, texts, settings)
    for row, text in zip(got, texts, strict=True):
        assert np.allclose(row, one_byte_after_the_other(model, text, 50), atol=1e-4)


def test_texts_without_letters(spark):
    texts = ["½ ²", "Ⅷ ①", "١٢", "_ 12", "", "ª", "½ x", "日"]
    model = L.trained([("a", b"abcdef"), ("b", b"ghijkl")], SMALL)
    got = L.predicted(spark.createDataFrame([(t,) for t in texts], "text string"), model).collect()
    assert [r.lang_pred == "und" and r.score == 0 for r in got] == [True] * 5 + [False] * 3


def test_dirty_labels_are_bounded(spark):
    rows = [(k, "some text", "en" if k % 2 else "fr" if k % 3 else f"junk{k}") for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, lang string")
    assert {lang for lang, _ in L.sample(docs, L.Settings(languages=2))} == {"en", "fr"}


def test_odd_rows(spark, odd_documents, no_documents):
    model = L.trained(L.sample(odd_documents), L.Settings(steps=3))
    got = L.predicted(odd_documents, model).collect()
    assert len(got) == odd_documents.count()
    for r in got:
        none = r.text is None or not any(c.isalpha() for c in r.text)
        assert (r.lang_pred == "und") == none and (r.score == 0) == none
    nothing = L.trained(L.sample(odd_documents.where("lang is null")))
    assert {r.lang_pred for r in L.predicted(odd_documents, nothing).collect()} == {"und"}
    assert L.predicted(no_documents, model).collect() == []
    assert L.sample(no_documents) == []
