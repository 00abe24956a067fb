"""Phrases of two to four words that occur together more often than their parts would.

Frequent phrases are found by partitions. The corpus is dealt into `shards` parts. In each part, phrases
are mined completely at a support lowered in proportion to the part's words: a phrase that reaches the
support in the whole reaches the lowered one in some part. What is frequent in some part is a candidate,
and a second reading counts all candidates exactly, everywhere, by their words.

A part is no task: its occurrences are added up within tasks and then by Spark, so parts may be of any
size, and their number stays small enough that the lowered support is above 1. Mining goes by length: two
words must be frequent words, three or four must begin and end with shorter frequent phrases. It uses
64-bit hashes of phrases, and the union of what the parts found is a bitmap of fixed size
(`Mining.word_bits`, `phrase_bits`), which is what tasks receive. Two phrases of one hash or bit only make
a candidate more: the exact count then drops it.

Defined results: null text is empty, null language is `und`; equal rows count each; words are separated by
blanks and tabs, phrases do not cross `.,;:!?` or line ends; ties are ordered by the phrase's UTF-8 bytes;
an empty table gives an empty table; columns other than the two are not read.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doorclock.llm.ranks import top_rows
from doorclock.llm.shingles import C1, scrambled
from doorclock.plans.staging import released, staged

UNKNOWN = "und"
LONGEST = 4
SLICE_BYTES = 4 << 20
HELD_WORDS, HELD_ROWS = 400_000, 1_000_000  # of a task, before it passes its counts on
BUCKET = 8 * 4096  # bits of one row of Spark's bitmap functions
WORDS_OF_BUCKET = 1 << 20  # of the corpus, for one bucket of phrases to count

# Blanks as blanks, ends of pieces as full stops, A-Z in lower case.
_CLEAN = bytes(
    ord(" ") if c in b" \t" else ord(".") if c in b".,;:!?\n\v\f\r" else c + 32 if 65 <= c <= 90 else c for c in range(256)
)


@dataclass(frozen=True)
class Mining:
    """`support` of a phrase in its language; drop one if a longer one has `inside_percent` of its occurrences."""

    support: int = 30
    shards: int = 4
    inside_percent: int = 80
    most: int = 2000
    word_bits: int = 24
    phrase_bits: int = 27


def _key(lang: str, word: bytes) -> int:
    return int.from_bytes(blake2b(lang.encode() + b" " + word, digest_size=8).digest(), "little")


def _longer(key: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Key of a phrase with one more word."""
    return scrambled(key * C1 + word)


def _known(bitmap: np.ndarray, key: np.ndarray) -> np.ndarray:
    at = key >> np.uint64(64 - (len(bitmap) * 8).bit_length() + 1)
    return (bitmap[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & np.uint8(1)).astype(bool)


class Words(dict):
    """Numbers of a language's words, from 1, in order of appearance; a full stop is 0."""

    def __init__(self, lang: str):
        super().__init__({b".": 0})
        self.lang, self.words, self._keys, self.keys = lang, [b"."], [0], np.zeros(1, np.uint64)

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self.words)
        self.words.append(word)
        self._keys.append(_key(self.lang, word))
        return number

    def numbered(self, texts: list[bytes]) -> np.ndarray:
        """Words of cleaned texts, with 0 between pieces and texts and at the end."""
        tokens = b" . ".join([*texts, b""]).replace(b".", b" . ").split()
        out = np.fromiter(map(self.__getitem__, tokens), np.int64, len(tokens))
        if len(self.keys) < len(self._keys):
            self.keys = np.concatenate([self.keys, np.array(self._keys[len(self.keys) :], np.uint64)])
        return out


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list[bytes]]]:
    """Cleaned texts by language, about `SLICE_BYTES` at a time."""
    held: dict[str, list[bytes]] = defaultdict(list)
    size = 0
    for batch in batches:
        for lang, text in zip(batch.column(0), batch.column(1), strict=True):
            if text.is_valid:
                name = lang.as_py() if lang.is_valid else UNKNOWN
                held[name].append(memoryview(text.as_buffer()).tobytes().translate(_CLEAN))
                size += len(held[name][-1])
                if size >= SLICE_BYTES:
                    yield held
                    held, size = defaultdict(list), 0
    if held:
        yield held


def _texts(docs: DataFrame, text: str, lang: str) -> DataFrame:
    return docs.select(F.col(f"`{lang}`").cast("string").alias("lang"), F.col(f"`{text}`").cast("string").alias("text"))


def _shard(shards: int) -> int:
    return TaskContext.get().partitionId() % shards


def _word_counts(texts: DataFrame, mining: Mining) -> DataFrame:
    """Rows (lang, word, null, n); (lang, null, null, n) for all words; (null, null, shard, n) for a shard's words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = defaultdict(Counter)

        def emptied() -> pa.RecordBatch:
            langs, words, n = [], [], []
            for lang, own in counts.items():
                own.pop(b".", None)
                langs += [lang] * (len(own) + 1)
                words += [*own, None]
                n += [*own.values(), sum(own.values())]
            total = sum(x for x, w in zip(n, words, strict=True) if w is None)
            counts.clear()
            arrays = [
                pa.array([*langs, None], pa.string()), pa.array([*words, None], pa.binary()).cast(pa.string()),
                pa.array([None] * len(words) + [_shard(mining.shards)], pa.int32()), pa.array([*n, total], pa.int64()),
            ]
            return pa.RecordBatch.from_arrays(arrays, ["lang", "word", "shard", "n"])

        for held in _slices(batches):
            for lang, own in held.items():
                counts[lang].update(b" . ".join(own).replace(b".", b" . ").split())
            if sum(map(len, counts.values())) >= HELD_WORDS:
                yield emptied()
        if counts:
            yield emptied()

    parts = texts.mapInArrow(count, "lang string, word string, shard int, n long")
    sums = parts.groupBy("lang", "word", "shard").agg(F.sum("n").alias("n"))
    return staged(sums.where((F.col("n") >= mining.support) | F.col("word").isNull()), "phrase_words")


def _bitmap(keys: DataFrame, bits: int) -> np.ndarray:
    """The union of `key`s as a bitmap of 2^bits bits."""
    place = F.shiftrightunsigned("key", 64 - bits) + 1
    if "bucket" not in keys.columns:
        keys = keys.withColumn("bucket", F.bitmap_bucket_number(place))
    rows = keys.groupBy("bucket").agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")).collect()
    out = np.zeros(max(1 << bits, BUCKET) // 8, np.uint8)
    for row in rows:  # at most 2^bits / BUCKET
        out[(row.bucket - 1) * 4096 : row.bucket * 4096] = np.frombuffer(bytes(row.bits), np.uint8)
    return out[: (1 << bits) // 8]


def _frequent_words(words: DataFrame, mining: Mining) -> np.ndarray:
    @F.pandas_udf("long")  # type: ignore[call-overload]
    def key(lang: pd.Series, word: pd.Series) -> pd.Series:
        keys = [_key(a, b.encode()) for a, b in zip(lang, word, strict=True)]
        return pd.Series(np.array(keys, np.uint64).view(np.int64))

    return _bitmap(words.where("word is not null").select(key("lang", "word").alias("key")), mining.word_bits)


def _runs(words: Words, a: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places where two frequent words follow each other, those pairs' keys, the words' keys)."""
    good = _known(frequent, words.keys)
    good[0] = False
    good = good[a]
    at = np.flatnonzero(good[:-1] & good[1:])
    keys = words.keys[a]
    return at, _longer(keys[at], keys[at + 1]), keys


def _windows(words: Words, a: np.ndarray, frequent: np.ndarray, pairs: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, places, keys) of windows of two to four words in which all pairs may be frequent."""
    at, key, keys = _runs(words, a, frequent)
    hit = _known(pairs, key)
    at, key = at[hit], key[hit]
    yield 2, at, key
    starts = np.zeros(len(a) + LONGEST, bool)
    starts[at] = True
    for length in range(3, LONGEST + 1):
        on = starts[at + length - 2]
        at, key = at[on], key[on]
        key = _longer(key, keys[at + length - 1])
        yield length, at, key


def _mined(texts: DataFrame, mining: Mining, supports: list[int], found: Callable[[Words, np.ndarray], list[np.ndarray]]) -> np.ndarray:
    """What some shard finds at its support, as a bitmap. `found` gives the keys of the windows to count."""

    def mine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held, rows = _shard(mining.shards), [], 0
        known: dict[str, Words] = {}

        def merged() -> list[tuple[np.ndarray, np.ndarray]]:
            if not held:
                return []
            key, n = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(key, kind="stable")
            key, n = key[order], n[order]
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])[: len(key)])
            return [(key[first], np.add.reduceat(n, first) if len(first) else n)]

        def emptied() -> Iterator[pa.RecordBatch]:
            for key, n in merged():
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(key), shard, np.int32)), pa.array(key.view(np.int64)), pa.array(n)], ["shard", "key", "n"]
                )

        for part in _slices(batches):
            for lang, own in part.items():
                words = known.setdefault(lang, Words(lang))
                key = np.concatenate(found(words, words.numbered(own)))
                held.append(np.unique(key, return_counts=True))
                rows += len(held[-1][0])
            if rows >= 2 * HELD_ROWS:
                held = merged()
                rows = sum(len(k) for k, _ in held)
                if rows >= HELD_ROWS:
                    yield from emptied()
                    held, rows = [], 0
            if sum(map(len, known.values())) >= HELD_WORDS:
                known.clear()
        yield from emptied()

    parts = texts.mapInArrow(mine, "shard int, key long, n long")
    # Dealt by the bitmap's rows: sums of a key and the union of a row then need no other shuffle.
    place = F.shiftrightunsigned("key", 64 - mining.phrase_bits) + 1
    parts = parts.withColumn("bucket", F.bitmap_bucket_number(place)).repartition("bucket")
    sums = parts.groupBy("bucket", "shard", "key").agg(F.sum("n").alias("n"))
    least = F.element_at(F.array(*[F.lit(s).cast("long") for s in supports]), F.col("shard") + 1)
    return _bitmap(sums.where(F.col("n") >= least), mining.phrase_bits)


def _counted(
    texts: DataFrame, support: int, total: int, candidates: Callable[[Words, np.ndarray], Iterator[tuple[int, np.ndarray]]]
) -> DataFrame:
    """(lang, phrase, n) of all candidates that reach the support. `candidates` gives (length, places).

    A task passes its counts on as lists, one for each language and bucket of phrases; a bucket's lists are
    added up together. Buckets follow the number of words, so that one holds some ten thousand phrases.
    """
    buckets = max(16, -(-total // WORDS_OF_BUCKET))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Words] = {}
        held: dict[str, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = defaultdict(list)

        def merged(own: list) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
            front, back, n = (np.concatenate(x) for x in zip(*own, strict=True))
            order = np.lexsort((back, front))
            front, back, n = front[order], back[order], n[order]
            fresh = np.ones(len(front), bool)
            fresh[1:] = (front[1:] != front[:-1]) | (back[1:] != back[:-1])
            first = np.flatnonzero(fresh)
            return [(front[first], back[first], np.add.reduceat(n, first) if len(first) else n)]

        def emptied() -> Iterator[pa.RecordBatch]:
            for lang, own in held.items():
                words, low = known[lang], (1 << 32) - 1
                for front, back, n in merged(own):
                    quads = [front >> 32, front & low, back >> 32, back & low]
                    key = words.keys[quads[0]]
                    for number in quads[1:]:
                        key = np.where(number > 0, _longer(key, words.keys[number]), key)
                    bucket = (key % np.uint64(buckets)).astype(np.int32)
                    order = np.argsort(bucket, kind="stable")
                    spelled = zip(*[q[order].tolist() for q in quads], strict=True)
                    phrases = pa.array([b" ".join([words.words[k] for k in quad if k]) for quad in spelled], pa.binary())
                    filled, first = np.unique(bucket[order], return_index=True)
                    ends = pa.array(np.append(first, len(order)).astype(np.int32))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([lang] * len(filled), pa.string()), pa.array(filled),
                            pa.ListArray.from_arrays(ends, phrases.cast(pa.string())), pa.ListArray.from_arrays(ends, pa.array(n[order])),
                        ],
                        ["lang", "bucket", "phrases", "n"],
                    )
            held.clear()
            known.clear()

        for part in _slices(batches):
            for lang, own in part.items():
                words = known.setdefault(lang, Words(lang))
                a = words.numbered(own)
                found = []
                for length, at in candidates(words, a):
                    number = [a[at + k] if k < length else np.zeros(len(at), np.int64) for k in range(LONGEST)]
                    found.append((number[0] << 32 | number[1], number[2] << 32 | number[3], np.ones(len(at), np.int64)))
                held[lang] += merged(found)
                if sum(len(x[0]) for x in held[lang]) >= HELD_ROWS:
                    held[lang] = merged(held[lang])
            if sum(len(x[0]) for own in held.values() for x in own) >= HELD_ROWS or sum(map(len, known.values())) >= HELD_WORDS:
                yield from emptied()
        yield from emptied()

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, int] = defaultdict(int)
        now = None

        def frequent() -> pa.RecordBatch:
            kept = {p: n for p, n in sums.items() if n >= support}
            arrays = [pa.array([now[1]] * len(kept), pa.string()), pa.array(list(kept), pa.string()), pa.array(list(kept.values()), pa.int64())]
            sums.clear()
            return pa.RecordBatch.from_arrays(arrays, ["lang", "phrase", "n"])

        for batch in batches:
            for bucket, lang, phrases, n in zip(*[batch.column(c) for c in ("bucket", "lang", "phrases", "n")], strict=True):
                key = (bucket.as_py(), lang.as_py())
                if key != now:
                    if sums:
                        yield frequent()
                    now = key
                for phrase, times in zip(phrases.values.to_pylist(), n.values.to_pylist(), strict=True):
                    sums[phrase] += times
        if sums:
            yield frequent()

    parts = texts.mapInArrow(count, "lang string, bucket int, phrases array<string>, n array<long>")
    dealt = parts.repartition("bucket").sortWithinPartitions("bucket", "lang")
    return dealt.mapInArrow(added, "lang string, phrase string, n long")


def frequent_phrases(docs: DataFrame, mining: Mining = Mining(), text: str = "text", lang: str = "lang") -> tuple[DataFrame, DataFrame]:
    """(phrases, totals), written once: (lang, phrase, n) of one to four words, and (lang, n) of all words."""
    texts = _texts(docs, text, lang)
    words = _word_counts(texts, mining)
    shards = {r.shard: r.n for r in words.where("shard is not null").collect()}  # one row per shard
    total = max(sum(shards.values()), 1)
    supports = [max(1, -(-mining.support * shards.get(k, 0) // total)) for k in range(mining.shards)]
    frequent = _frequent_words(words, mining)
    pairs = _mined(texts, mining, supports, lambda words, a: [_runs(words, a, frequent)[1]])
    released(docs.sparkSession)  # each reading is done with what it has shuffled
    longer = _mined(
        texts, mining, supports, lambda words, a: [key for length, _, key in _windows(words, a, frequent, pairs) if length > 2]
    )
    released(docs.sparkSession)

    def candidates(words: Words, a: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        for length, at, key in _windows(words, a, frequent, pairs):
            yield length, at if length == 2 else at[_known(longer, key)]

    counted = _counted(texts, mining.support, total, candidates)
    single = words.where("word is not null").select("lang", F.col("word").alias("phrase"), "n")
    return staged(counted.unionByName(single), "phrases"), words.where("word is null and lang is not null").select("lang", "n")


def _words_between(words: Column, first: Column, size: Column) -> Column:
    return F.array_join(F.slice(words, first, size), " ")


def scored(phrases: DataFrame, mining: Mining = Mining()) -> DataFrame:
    """(lang, phrase, a, l, r, score) by the lowest-scoring cut, without phrases that a longer one stands for."""
    words = F.split("phrase", " ", -1)
    candidates = phrases.where(F.size(words) > 1).select("lang", "phrase", F.col("n").alias("a"), words.alias("words"))
    size = F.size("words")
    cuts = candidates.select("lang", "phrase", "a", "words", F.explode(F.sequence(F.lit(1), size - 1)).alias("k")).select(
        "lang", "phrase", "a", "k",
        _words_between(F.col("words"), F.lit(1), F.col("k")).alias("first"),
        _words_between(F.col("words"), F.col("k") + 1, size - F.col("k")).alias("rest"),
    )
    for side, name in (("first", "l"), ("rest", "r")):
        cuts = cuts.join(phrases.select("lang", F.col("phrase").alias(side), F.col("n").alias(name)), ["lang", side])
    wide = [F.col(c).cast("decimal(20,0)") for c in ("a", "l", "r")]
    score = F.call_function("div", wide[0] * F.lit(2_000_000), wide[1] + wide[2])
    best = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("best"))

    inner = F.flatten(F.transform(
        F.sequence(F.lit(2), size - 1),
        lambda n: F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: _words_between(F.col("words"), i, n)),
    ))
    inside = candidates.where(size > 2).select("lang", "a", F.explode(inner).alias("phrase"))
    inside = inside.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    stood_for = F.col("longer").cast("decimal(20,0)") * 100 >= wide[0] * mining.inside_percent
    return best.join(inside, ["lang", "phrase"], "left").where(~F.coalesce(stood_for, F.lit(False))).select(
        "lang", "phrase", "a", F.col("best.l").alias("l"), F.col("best.r").alias("r"), F.col("best.score").alias("score")
    )


def collocations(docs: DataFrame, mining: Mining = Mining(), text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first phrases of each language by score, count and bytes."""
    phrases, totals = frequent_phrases(docs, mining, text, lang)
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    first = top_rows(scored(phrases, mining), ["lang"], order, mining.most)
    return first.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def query(spark, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_SQL = """
with d as (select coalesce(lang, 'und') as lang,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents),
piece as (select lang, unnest(string_split_regex(text, '[.,;:!?\\x0A-\\x0D]')) as p from d),
w as (select lang, list_filter(string_split_regex(p, '[\\x20\\x09]+'), lambda x: x <> '') as w from piece),
grams as (select lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) as phrase
  from w, (values (1), (2), (3), (4)) as sizes(k) where len(w) >= k),
f as (select lang, k as m, phrase, count(*) as n from grams group by all having count(*) >= 30),
tot as (select lang, sum(len(w)) as n from w group by lang),
c as (select lang, m, phrase, n as a, string_split(phrase, ' ') as w from f where m > 1),
cut as (select c.lang, phrase, a, m, k, array_to_string(w[1:k], ' ') as first, array_to_string(w[k + 1:m], ' ') as rest
  from c, (values (1), (2), (3)) as cuts(k) where k < m),
s as (select cut.lang, cut.phrase, cut.a, k, x.n as l, y.n as r, (2000000 * cut.a::hugeint) // (x.n + y.n) as score
  from cut join f x on x.lang = cut.lang and x.phrase = first join f y on y.lang = cut.lang and y.phrase = rest),
low as (select * from s qualify row_number() over (partition by lang, phrase order by score, k) = 1),
inner_ as (select lang, a, array_to_string(w[i:i + k - 1], ' ') as phrase
  from c, (values (2), (3)) as sizes(k), (values (1), (2), (3)) as places(i) where k < m and i + k - 1 <= m),
drops as (select distinct c.lang, c.phrase from c join inner_ on c.lang = inner_.lang and c.phrase = inner_.phrase
  where 100 * inner_.a >= 80 * c.a),
ranked as (select low.*, row_number() over (partition by lang order by score desc, a desc, phrase) as rank
  from low anti join drops using (lang, phrase))
select ranked.lang, rank, phrase, a, l, r, cast(tot.n as bigint) as n, cast(score as bigint) as score
from ranked join tot on ranked.lang = tot.lang where rank <= 2000
"""
