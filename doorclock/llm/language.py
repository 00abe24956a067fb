"""Language of documents by a bidirectional gated recurrent network over bytes.

A text's bytes are cut into segments; in each, one gated recurrent layer reads forwards and one
backwards, both states label every position, and a document's probabilities are the mean over all
its positions. The network is trained here, in numpy, by backpropagation through time, on a bounded
sample of labelled documents (`Settings.per_language`); prediction runs on the executors over every
byte of every text.

Gates use the rational sigmoid x / (1 + |x|), scaled to 0..1, and candidates the same from -1 to 1.

Defined results: a text that is null or has no letter (category L; `½`, `Ⅷ` and digits are none) is `und` with score 0, and so is every text if
nothing could be learned; a document without id counts as id ""; equal texts get equal predictions;
ties go to the language first by code point; an empty table gives an empty table; a column of the
input that has the name of a result column is replaced by it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doorclock.llm.columns import packed, unit_hash, unpacked

UNKNOWN = "und"


@dataclass(frozen=True)
class Settings:
    """`per_language` bounds the sample: so many documents of each language, `pieces` of each.

    `languages` bounds how many are learned, the most frequent labels first, whatever stands in a dirty column.
    """

    hidden: int = 8
    languages: int = 512
    per_language: int = 400
    pieces: int = 4
    piece_chars: int = 64
    steps: int = 400
    batch: int = 128
    rate: float = 0.02
    seed: int = 7
    segment: int = 256
    at_once: int = 2048


@dataclass
class Model:
    """Per direction: `inputs` (256 x 3H: reset, update, candidate), `states` (3H x H); output weights."""

    languages: list[str]
    inputs: list[np.ndarray]
    states: list[np.ndarray]
    weights: np.ndarray
    bias: np.ndarray

    def parameters(self) -> list[np.ndarray]:
        return [*self.inputs, *self.states, self.weights, self.bias]


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 4 == 2


def _soft(x: np.ndarray) -> np.ndarray:
    return x / (1 + np.abs(x))


def _step(x: np.ndarray, h: np.ndarray, u: np.ndarray):
    """One position: inputs (3H, N) and states (H, N) to new states, and what the way back needs."""
    n = h.shape[0]
    a = u @ h
    gates = _soft(x[: 2 * n] + a[: 2 * n])
    r, z = 0.5 + 0.5 * gates[:n], 0.5 + 0.5 * gates[n:]
    c = _soft(x[2 * n :] + r * a[2 * n :])
    return c + z * (h - c), (h, gates, r, z, c, a[2 * n :])


def _forward(model: Model, data: np.ndarray, direction: int):
    steps, n = data.shape
    h = np.zeros((model.states[direction].shape[1], n), np.float32)
    order = range(steps) if direction == 0 else range(steps - 1, -1, -1)
    out, kept = [None] * steps, [None] * steps
    for t in order:
        h, kept[t] = _step(model.inputs[direction][data[t]].T, h, model.states[direction])
        out[t] = h
    return out, kept


def _backward(model: Model, data: np.ndarray, direction: int, above: np.ndarray, kept: list):
    """Gradients of a direction's inputs and states, from those of its states at every position."""
    u = model.states[direction]
    n = u.shape[1]
    grad_x = np.empty((data.shape[0], 3 * n, data.shape[1]), np.float32)
    grad_u = np.zeros_like(u)
    carry = np.zeros((n, data.shape[1]), np.float32)
    order = range(data.shape[0] - 1, -1, -1) if direction == 0 else range(data.shape[0])
    for t in order:
        h, gates, r, z, c, a = kept[t]
        d = above[t] + carry
        slope = (1 - np.abs(gates)) ** 2
        dc = d * (1 - z) * (1 - np.abs(c)) ** 2
        dz = d * (h - c) * 0.5 * slope[n:]
        dr = dc * a * 0.5 * slope[:n]
        grad_x[t] = np.concatenate([dr, dz, dc])
        da = np.concatenate([dr, dz, dc * r])
        grad_u += da @ h.T
        carry = d * z + u.T @ da
    flat, values = data.ravel(), grad_x.transpose(0, 2, 1).reshape(-1, 3 * n)
    grad_inputs = np.stack([np.bincount(flat, values[:, k], 256) for k in range(3 * n)], 1)
    return grad_inputs.astype(np.float32), grad_u


def gradients(model: Model, data: np.ndarray, labels: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean loss over all positions of data (steps, N), and its gradients in `parameters` order."""
    passes = [_forward(model, data, k) for k in (0, 1)]
    states = np.stack([np.concatenate([f, b]) for f, b in zip(passes[0][0], passes[1][0], strict=True)])
    logits = np.einsum("ch,thn->tcn", model.weights, states) + model.bias[:, None]
    p = np.exp(logits - logits.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    n = np.arange(data.shape[1])
    loss = float(-np.log(np.maximum(p[:, labels, n], 1e-12)).mean())
    p[:, labels, n] -= 1
    p /= data.size
    above = np.einsum("ch,tcn->thn", model.weights, p)
    h = model.states[0].shape[1]
    back = [_backward(model, data, k, above[:, k * h : (k + 1) * h], passes[k][1]) for k in (0, 1)]
    grads = [back[0][0], back[1][0], back[0][1], back[1][1], np.einsum("tcn,thn->ch", p, states), p.sum((0, 2))]
    return loss, grads


def trained(pieces: list[tuple[str, bytes]], settings: Settings = Settings()) -> Model:
    """Fit to labelled pieces of text by Adam. The same pieces in the same order give the same model."""
    rng = np.random.default_rng(settings.seed)
    languages = sorted({lang for lang, _ in pieces})
    h, f32 = settings.hidden, np.float32
    model = Model(
        languages,
        [rng.normal(0, 0.3, (256, 3 * h)).astype(f32) for _ in (0, 1)],
        [rng.normal(0, 1 / np.sqrt(h), (3 * h, h)).astype(f32) for _ in (0, 1)],
        rng.normal(0, 0.3, (len(languages), 2 * h)).astype(f32),
        np.zeros(len(languages), f32),
    )
    length = settings.piece_chars
    rows = [(languages.index(lang), np.frombuffer(piece[:length], np.uint8)) for lang, piece in pieces if len(piece) >= length]
    # Short pieces are repeated up to the length of the others, so that short texts count too.
    rows += [(languages.index(lang), np.resize(np.frombuffer(piece, np.uint8), length)) for lang, piece in pieces if 0 < len(piece) < length]
    if not rows:
        return model
    labels, data = np.array([k for k, _ in rows]), np.stack([d for _, d in rows], 1).astype(np.intp)
    by_language = [np.flatnonzero(labels == k) for k in np.unique(labels)]
    first = [np.zeros_like(p) for p in model.parameters()]
    second = [np.zeros_like(p) for p in model.parameters()]
    for step in range(1, settings.steps + 1):
        share = -(-settings.batch // len(by_language))
        chosen = np.concatenate([rng.choice(own, share) for own in by_language])
        _, grads = gradients(model, data[:, chosen], labels[chosen])
        scale = min(1.0, 1.0 / (1e-9 + np.sqrt(sum(float((g * g).sum()) for g in grads))))
        rate = settings.rate * (1 - (step - 1) / settings.steps)
        for p, g, m, v in zip(model.parameters(), grads, first, second, strict=True):
            g = g * scale
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(f32)
    return model


def probabilities(model: Model, texts: list[bytes], settings: Settings = Settings()) -> np.ndarray:
    """Mean probabilities (texts, languages) over all positions; zeros for an empty text."""
    sizes = np.array([len(t) for t in texts], np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    parts = -(-sizes // settings.segment)
    owner = np.repeat(np.arange(len(texts)), parts)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
    starts = np.repeat(np.cumsum(sizes) - sizes, parts) + within * settings.segment
    lengths = np.minimum(np.repeat(sizes, parts) - within * settings.segment, settings.segment)
    order = np.argsort(-lengths, kind="stable")
    sums = np.zeros((len(model.languages), len(owner)), np.float64)
    for at in range(0, len(order), settings.at_once):
        chosen = order[at : at + settings.at_once]
        sums[:, chosen] = _segments(model, data, starts[chosen], lengths[chosen])
    pooled = np.stack([np.bincount(owner, s, len(texts)) for s in sums], 1) if len(owner) else np.zeros((len(texts), len(sums)))
    return pooled / np.maximum(sizes, 1)[:, None]


def _segments(model: Model, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Probabilities summed over the positions of segments, which come longest first."""
    h, n, steps = model.states[0].shape[1], len(starts), int(lengths[0])
    # Segments that reach position t come first, so each step works on a front part of the rows.
    live = np.searchsorted(-lengths, -np.arange(1, steps + 1), "right")
    tables = [np.ascontiguousarray(x.T) for x in model.inputs]
    before = []
    state = np.zeros((h, n), np.float32)
    for t in range(steps):
        k = live[t]
        x = tables[0].take(data[starts[:k] + t], axis=1)
        state, _ = _step(x, state[:, :k], model.states[0])
        before.append(model.weights[:, :h] @ state + model.bias[:, None])
    sums = np.zeros((len(model.languages), n), np.float64)
    state = np.zeros((h, 0), np.float32)
    for t in range(steps - 1, -1, -1):
        k = live[t]
        if state.shape[1] < k:
            state = np.concatenate([state, np.zeros((h, k - state.shape[1]), np.float32)], 1)
        x = tables[1].take(data[starts[:k] + t], axis=1)
        state, _ = _step(x, state, model.states[1])
        logits = before[t] + model.weights[:, h:] @ state
        p = np.exp(logits - logits.max(0))
        sums[:, :k] += p / p.sum(0)
    return sums


def sample(docs: DataFrame, settings: Settings = Settings(), text: str = "text", lang: str = "lang", key: str = "doc_id") -> list[tuple[str, bytes]]:
    """Pieces of at most `per_language` documents of each language, chosen by a hash of their id."""
    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & ~held_out(F.col(key)))
    frequent = known.groupBy(F.col(f"`{lang}`").alias("lang")).agg(F.count(F.lit(1)).alias("n"))
    counts = {r.lang: r.n for r in frequent.orderBy(F.desc("n"), "lang").limit(settings.languages).collect()}
    if not counts:
        return []
    # Somewhat more than wanted by chance, then exactly the first by hash.
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, 1.5 * settings.per_language / n + 50 / n))])
    rank = unit_hash(F.lit("language"), F.col(key))
    size = F.greatest(F.length(text), F.lit(1))
    at = [F.floor(unit_hash(F.lit(f"piece{k}"), F.col(key)) * size).cast("int") + 1 for k in range(settings.pieces)]
    chosen = (
        known.select(F.col(lang).alias("lang"), rank.alias("rank"), *[F.substring(F.col(text), a, F.lit(settings.piece_chars)).alias(f"p{k}") for k, a in enumerate(at)])
        .where(F.col("rank") < F.try_element_at(share, F.col("lang")))
        .collect()
    )
    rows = sorted(chosen, key=tuple)
    taken: dict[str, int] = {}
    out = []
    for row in rows:
        taken[row.lang] = taken.get(row.lang, 0) + 1
        if taken[row.lang] <= settings.per_language:
            out += [(row.lang, row[f"p{k}"].encode()) for k in range(settings.pieces)]
    return out


def predicted(docs: DataFrame, model: Model, settings: Settings = Settings(), text: str = "text") -> DataFrame:
    """Every document with `lang_pred` and `score`."""

    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [t.encode() if t is not None and any(map(str.isalpha, t)) else b"" for t in batch]
            p = probabilities(model, texts, settings) if model.languages else np.zeros((len(texts), 1))
            best = p.argmax(1)
            names = [model.languages[k] if t and model.languages else UNKNOWN for k, t in zip(best, texts, strict=True)]
            yield pd.DataFrame({"lang": names, "score": np.minimum(p[np.arange(len(best)), best], 1.0)})

    guess = F.pandas_udf(predict, "lang string, score double")  # type: ignore[call-overload]
    rows = packed(docs).withColumn("_guess", guess(F.col("row").getField(text)))
    return unpacked(rows, docs.columns, {"lang_pred": F.col("_guess.lang"), "score": F.col("_guess.score")})


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = trained(sample(docs))
    return predicted(docs.drop("lang"), model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score"
    )
