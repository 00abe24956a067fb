"""SentencePiece encoding and decoding by suffix-array matching.

Of the texts of a batch, the new distinct segments (a word with the blanks before it) are laid end to end and
indexed by a suffix array; every piece of the vocabulary is looked up in it by binary search, and its
range of the array is the list of its occurrences. Each occurrence is an edge from its first to its
last position. Edges are sorted by position and relaxed from left to right: position by position, the
edge that ends there and whose piece fits the piece before it decides. Two pieces fit if merging
their joined characters by rank gives these two again; as all pieces of a vocabulary come from merges,
the sequence of fitting pieces is the one that merging the whole segment gives. Characters without
a piece become byte pieces, or the unknown piece if the vocabulary has none.

The blank mark U+2581 itself, in a text, is encoded as bytes, so that decoding always gives the text
back, which the usual encoder does not. In all else ids equal the usual encoder's (a test compares).

Defined results: null stays null; an empty text has no pieces; equal texts have equal ids; an empty
table gives an empty table; extra columns stay, but those with the name of a result column are
replaced by it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from doorclock.llm.columns import packed, unpacked

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
SEGMENT = re.compile(" +[^ \n]*|\n+|[^ \n]+")
PART_CHARS = 1 << 20  # of texts that are cut into segments together
INDEX_CHARS = 320 << 10  # of distinct segments in one suffix array; a longer segment has one of its own
MEMORY_BITS = 20
REMEMBERED_CHARS = 3 << 20  # of segments whose ids are kept, each counted with EACH more
EACH = 8
START, CHARACTER = -1, -2


@dataclass
class Vocabulary:
    """Texts of pieces (blanks as blanks), their merges and byte pieces.

    `rank` orders merges, the least first; single characters, which are there from the start, have -1.
    `left` and `right` are the pieces whose merge made a piece; a `steady` piece was made by merges of
    rising rank. `pairs` are all pieces that can meet, as left * size + right in ascending order, with
    the rank of what they make.
    """

    texts: list[str]
    rank: np.ndarray
    left: np.ndarray
    right: np.ndarray
    steady: np.ndarray
    pairs: np.ndarray
    pair_ranks: np.ndarray
    byte_ids: list[int]
    unknown: int

    @classmethod
    def read(cls, path: str = MODEL) -> Vocabulary:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        texts, scores, byte_ids = [], [], [-1] * 256
        for i in range(model.vocab_size()):
            piece = model.id_to_piece(i)
            special = model.is_control(i) or model.is_unknown(i) or model.is_unused(i)
            if model.is_byte(i):
                byte_ids[int(piece[3:5], 16)] = i
            texts.append("" if special or model.is_byte(i) else piece.replace(MARK, " "))
            scores.append(model.get_score(i))
        return cls.of(texts, scores, byte_ids, model.unk_id())

    @classmethod
    def of(cls, texts: list[str], scores: list[float], byte_ids: list[int], unknown: int) -> Vocabulary:
        if any("\n" in t or (" " in t.lstrip(" ")) for t in texts):
            raise ValueError("a piece goes on over a word's end")
        ids = {t: i for i, t in enumerate(texts) if t}
        order = {s: k for k, s in enumerate(sorted(set(scores), reverse=True))}
        merge = {t: order[scores[i]] for t, i in ids.items() if len(t) > 1}
        n = len(texts)
        rank, left, right = np.full(n, -1, np.int64), np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        meeting: dict[int, int] = {}
        for t, i in ids.items():
            if len(t) == 1:
                continue
            made = merged(t, merge, 2)
            if len(made) > 2:
                texts[i] = ""  # merging never ends in this piece
                continue
            rank[i], left[i], right[i] = merge[t], ids[made[0]], ids[made[1]]
            for k in range(1, len(t)):
                if t[:k] in ids and t[k:] in ids:
                    meeting[ids[t[:k]] * n + ids[t[k:]]] = merge[t]
        pairs = np.array(sorted(meeting), np.int64)
        # Shorter pieces first, so that parts are known before what they make.
        steady = np.ones(n, bool)
        for i in sorted(ids.values(), key=lambda i: len(texts[i])):
            if rank[i] >= 0:
                parts = [left[i], right[i]]
                steady[i] = steady[parts].all() and (rank[parts] < rank[i]).all()
        return cls(texts, rank, left, right, steady, pairs, np.array([meeting[p] for p in pairs.tolist()], np.int64), byte_ids, unknown)


def merged(text: str, rank: dict[str, int], stop: int = 1) -> list[str]:
    """The parts of a text when neighbours are merged, least rank first, leftmost of equals."""
    parts, never = list(text), max(rank.values(), default=0) + 1
    while len(parts) > stop:
        best, at = min((rank.get(a + b, never), k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
        if best == never:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


class Encoder:
    """Encodes batches with one vocabulary.

    Remembers which pieces fit which, and the ids of segments seen before, both in bounded memory.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.ids = np.array([i for i, t in enumerate(vocabulary.texts) if t], np.int32)
        texts = [vocabulary.texts[i] for i in self.ids.tolist()]
        self.merges = {t: int(vocabulary.rank[i]) for i, t in zip(self.ids.tolist(), texts, strict=True) if len(t) > 1}
        self.sizes = np.array([len(t) for t in texts])
        self.longest = int(self.sizes.max())
        chars = sorted(set("".join(texts)))
        self.code = np.zeros(0x110000, np.int32)
        self.code[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.spelled = np.zeros((len(texts), self.longest), np.int32)
        for row, t in zip(self.spelled, texts, strict=True):
            row[: len(t)] = self.code[[ord(c) for c in t]]
        self.n_codes = len(chars) + 1
        self.size_of = np.zeros(len(vocabulary.texts), np.int64)
        self.size_of[self.ids] = self.sizes
        self.known = np.full(1 << MEMORY_BITS, -1, np.int64)
        self.verdict = np.zeros(1 << MEMORY_BITS, bool)
        self._forget()

    def _forget(self) -> None:
        self.index: dict[str, int] = {}
        self.chars = 0
        self.flat, self.counts, self.used = np.zeros(1 << 16, np.int32), np.zeros(0, np.int64), 0

    def _remember(self, segments: list[str]) -> None:
        """Find the ids of new segments, some at a time, and keep them."""
        start = 0
        while start < len(segments):
            end, chars = start, 0
            while end < len(segments) and (end == start or chars + len(segments[end]) <= INDEX_CHARS):
                chars += len(segments[end]) + 1
                end += 1
            ids, counts = self.segments(segments[start:end])
            while self.used + len(ids) > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros(len(self.flat), np.int32)])
            self.flat[self.used : self.used + len(ids)] = ids
            self.used += len(ids)
            self.counts = np.concatenate([self.counts, counts])
            self.chars += chars + EACH * (end - start)
            start = end

    def fits(self, before: np.ndarray, after: np.ndarray) -> np.ndarray:
        """Whether each piece can follow the one before it; anything can at a start or a bare character.

        Merges of both pieces are undone from the last one back. The two fit unless, at some point,
        the parts that meet at their boundary would have been merged before the next merge inside.
        """
        out = np.ones(len(before), bool)
        at = np.flatnonzero(before >= 0)
        pair = before[at].astype(np.int64) * len(self.vocabulary.texts) + after[at]
        slot = (pair * np.int64(0x9E3779B97F4A7C15 - 2**64)).view(np.uint64) >> np.uint64(64 - MEMORY_BITS)
        new = self.known[slot] != pair
        verdict = self.verdict[slot]
        fresh, first, inverse = np.unique(pair[new], return_index=True, return_inverse=True)
        if len(fresh):
            found = self._meet(*np.divmod(fresh, len(self.vocabulary.texts)))
            verdict[new] = found[inverse]
            place = slot[new][first]
            self.known[place], self.verdict[place] = fresh, found
        out[at] = verdict
        return out

    def _meet(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        v = self.vocabulary
        out = np.ones(len(a), bool)
        steady = v.steady[a] & v.steady[b]
        # The few pieces made by merges of falling or equal rank are merged step by step.
        for k in np.flatnonzero(~steady).tolist():
            pair = [v.texts[a[k]], v.texts[b[k]]]
            out[k] = merged("".join(pair), self.merges) == pair
        live = np.flatnonzero(steady)
        a, b, limit = a[live], b[live], np.full(len(live), np.iinfo(np.int64).max)
        while len(live):
            key = a * len(v.texts) + b
            place = np.minimum(np.searchsorted(v.pairs, key), len(v.pairs) - 1)
            crossed = (v.pairs[place] == key) & (v.pair_ranks[place] < limit)
            out[live[crossed]] = False
            ra, rb = v.rank[a], v.rank[b]
            # Of equal ranks the one further left was merged first, so the right one is undone first.
            undo_a = ra > rb
            a, b = np.where(undo_a, v.right[a], a), np.where(undo_a, b, v.left[b])
            limit = np.where(undo_a, ra, rb + 1)
            keep = ~crossed & (np.maximum(ra, rb) >= 0)
            live, a, b, limit = live[keep], a[keep], b[keep], limit[keep]
        return out

    def edges(self, codes: np.ndarray) -> np.ndarray:
        """(longest, positions): the piece of each length that starts at each position, or -1."""
        used = np.unique(codes)
        used = used[used > 0]
        dense = np.zeros(self.n_codes, np.int64)
        dense[used] = np.arange(1, len(used) + 1)
        bits = max(1, int(len(used)).bit_length())
        per = 62 // bits
        words = -(-self.longest // per)
        text = np.concatenate([dense[codes], np.zeros(words * per, np.int64)])
        n = len(codes)
        keys = []
        for w in range(words):
            key = np.zeros(n, np.int64)
            for t in range(w * per, (w + 1) * per):
                key = (key << bits) | (text[t : t + n] if t < self.longest else 0)
            keys.append(key)
        # The suffix array, as far as the longest piece can tell suffixes apart.
        array = np.lexsort(keys[::-1])
        keys = [k[array] for k in keys]

        spelled = dense[self.spelled]
        able = np.flatnonzero(((spelled > 0) == (self.spelled > 0)).all(1))
        spelled, sizes = spelled[able], self.sizes[able]
        beyond = np.arange(self.longest) >= sizes[:, None]
        bounds = []
        for fill in (0, (1 << bits) - 1):
            filled = np.where(beyond, fill, spelled)
            wanted = []
            for w in range(words):
                key = np.zeros(len(able), np.int64)
                for t in range(w * per, (w + 1) * per):
                    key = (key << bits) | (filled[:, t] if t < self.longest else 0)
                wanted.append(key)
            bounds.append(self._search(keys, wanted, after=bool(fill)))
        low, high = bounds
        counts = high - low
        flat = np.repeat(low - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        table = np.full((self.longest, n), -1, np.int32)
        table[np.repeat(sizes - 1, counts), array[flat]] = np.repeat(self.ids[able], counts)
        return table

    @staticmethod
    def _search(keys: list[np.ndarray], wanted: list[np.ndarray], after: bool) -> np.ndarray:
        """Binary search of all wanted keys: the first place not before (or after) each of them."""
        n = len(keys[0])
        low, high = np.zeros(len(wanted[0]), np.int64), np.full(len(wanted[0]), n, np.int64)
        while True:
            open_ = low < high
            if not open_.any():
                return low
            middle = np.minimum((low + high) // 2, n - 1)
            right, equal = np.zeros(len(low), bool), np.ones(len(low), bool)
            for have, want in zip(keys, wanted, strict=True):
                h = have[middle]
                right |= equal & (h < want)
                equal &= h == want
            if after:
                right |= equal
            low = np.where(open_ & right, middle + 1, low)
            high = np.where(open_ & ~right, middle, high)

    def segments(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all segments in a row, number of ids of each)."""
        lengths = np.array([len(s) for s in segments], np.int64)
        # Each segment is followed by a character that no piece has.
        raw = np.frombuffer("￿".join([*segments, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = self.code[raw]
        codes[np.cumsum(lengths + 1) - 1] = 0
        table = self.edges(codes)
        starts = np.cumsum(lengths + 1) - lengths - 1
        last = np.full(len(codes), CHARACTER, np.int64)
        order = np.argsort(-lengths, kind="stable")
        starts, descending = starts[order], -lengths[order]
        for t in range(int(lengths.max())):
            first = starts[: np.searchsorted(descending, -t, "left")]
            end = first + t
            last[end] = CHARACTER
            todo = np.flatnonzero(codes[end] > 0)
            for size in range(min(t + 1, self.longest), 0, -1):
                if not len(todo):
                    break
                piece = table[size - 1, end[todo] - size + 1]
                some = np.flatnonzero(piece >= 0)
                if not len(some):
                    continue
                here = end[todo[some]]
                before = last[here - size] if size <= t else np.full(len(here), START)
                good = self.fits(before, piece[some])
                last[here[good]] = piece[some[good]]
                keep = np.ones(len(todo), bool)
                keep[some[good]] = False
                todo = todo[keep]
        return self._gathered(raw, last, starts, -descending, order)

    def _gathered(self, raw, last, starts, lengths, order) -> tuple[np.ndarray, np.ndarray]:
        """Ids from the last pieces, back from each segment's end; bare characters as their bytes."""
        at, live, steps = starts + lengths - 1, np.arange(len(starts)), []
        while len(live):
            piece = last[at[live]]
            steps.append((live, piece, raw[at[live]]))
            at[live] -= np.where(piece >= 0, self.size_of[np.maximum(piece, 0)], 1)
            live = live[at[live] >= starts[live]]
        owner = np.concatenate([s[0] for s in steps])
        piece = np.concatenate([s[1] for s in steps])
        char = np.concatenate([s[2] for s in steps])
        step = np.repeat(np.arange(len(steps)), [len(s[0]) for s in steps])
        by = np.lexsort((-step, order[owner]))
        owner, piece, char = order[owner][by], piece[by], char[by]
        bare = np.flatnonzero(piece < 0)
        if len(bare):
            kinds, inverse = np.unique(char[bare], return_inverse=True)
            ids = [self._bytes(chr(c)) for c in kinds.tolist()]
            counts = np.ones(len(piece), np.int64)
            counts[bare] = np.array([len(i) for i in ids])[inverse]
            begin = np.cumsum(counts) - counts
            out = np.repeat(piece, counts)
            owner = np.repeat(owner, counts)
            for k, own in enumerate(ids):
                for j, value in enumerate(own):
                    out[begin[bare[inverse == k]] + j] = value
            piece = out
        return piece.astype(np.int32), np.bincount(owner, minlength=len(starts))

    def _bytes(self, char: str) -> list[int]:
        ids = [self.vocabulary.byte_ids[b] for b in char.encode("utf-8", "replace")]
        return ids if min(ids) >= 0 else [self.vocabulary.unknown]

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, number of ids of each)."""
        if self.chars > REMEMBERED_CHARS:
            self._forget()
        index, before = self.index, len(self.index)
        add, numbers, parts = index.setdefault, [], []
        for text in texts:
            found = SEGMENT.findall(" " + text) if text else []
            parts.append(len(found))
            numbers += [add(s, len(index)) for s in found]
        if not numbers:
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        if len(index) > before:
            self._remember(list(islice(index, before, None)))
        number = np.array(numbers)
        begin, length = (np.cumsum(self.counts) - self.counts)[number], self.counts[number]
        flat = np.repeat(begin - (np.cumsum(length) - length), length) + np.arange(length.sum())
        upto = np.concatenate([[0], np.cumsum(length)])
        ends = np.cumsum(parts)
        return self.flat[flat], upto[ends] - upto[ends - np.array(parts)]


def _parts(texts: pa.Array) -> Iterator[tuple[int, list[str | None]]]:
    """Neighbouring texts of about `PART_CHARS` together, and the place of the first."""
    start, held, size = 0, [], 0
    for text in texts:
        value = text.as_py()
        held.append(value)
        size += len(value or "")
        if size >= PART_CHARS:
            yield start, held
            start, held, size = start + len(held), [], 0
    if held:
        yield start, held


def _as_lists(ids: np.ndarray, sizes: np.ndarray, texts: list[str | None]) -> pa.Array:
    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32()), mask=pa.array([t is None for t in texts]))


def _spelling(vocabulary: Vocabulary) -> list[bytes]:
    table = [t.encode() for t in vocabulary.texts]
    for b, i in enumerate(vocabulary.byte_ids):
        if i >= 0:
            table[i] = bytes([b])
    return table


def _texts_of(lists: pa.Array, table: list[bytes]) -> pa.Array:
    of, out = table.__getitem__, []
    for ids in lists:
        if not ids.is_valid:
            out.append(None)
            continue
        data = b"".join(map(of, ids.values.to_numpy().tolist())).decode("utf-8", "replace")
        out.append(data[1:] if data.startswith(" ") else data)
    return pa.array(out, pa.string())


def encoded(
    docs: DataFrame, vocabulary: Vocabulary, text: str = "text", name: str = "pieces", back: str | None = None
) -> DataFrame:
    """Every row with the ids of its text's pieces; with `back`, also with the text that these give again.

    Memory of a task is bounded by the vocabulary, `INDEX_CHARS` and `REMEMBERED_CHARS`, a batch's rows, and the
    longest segment without a blank.
    """
    added = {name: T.ArrayType(T.IntegerType())} | ({back: T.StringType()} if back else {})
    kept = [c for c in docs.columns if c not in added]
    schema = T.StructType([*[f for f in docs.schema if f.name not in added], *[T.StructField(n, t) for n, t in added.items()]])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, table = Encoder(vocabulary), _spelling(vocabulary) if back else []
        for batch in batches:
            for start, part in _parts(batch.column(text)):
                lists = _as_lists(*encoder.encode(part), part)
                rows = batch.slice(start, len(part))
                more = [lists, _texts_of(lists, table)] if back else [lists]
                yield pa.RecordBatch.from_arrays([*[rows.column(c) for c in kept], *more], [*kept, *added])

    return docs.mapInArrow(encode, schema)


def decoded(docs: DataFrame, vocabulary: Vocabulary, pieces: str = "pieces", name: str = "decoded") -> DataFrame:
    """Every row with the text of its pieces."""
    table = _spelling(vocabulary)

    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield _texts_of(batch, table)

    run = F.arrow_udf(decode, "string")  # type: ignore[call-overload]
    rows = packed(docs).withColumn("_text", run(F.col("row").getField(pieces)))
    return unpacked(rows, docs.columns, {name: F.col("_text")})


def query(spark, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again: number and hash of its ids, and whether it came back."""
    vocabulary = Vocabulary.read()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encoded(docs, vocabulary, back="decoded").select(
        "doc_id", F.coalesce(F.size("pieces"), F.lit(0)).cast("long").alias("n_pieces"),
        F.xxhash64("pieces").alias("pieces_hash"), F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"),
    )
