"""Removal of byte strings that occur earlier in the corpus, by suffix arrays over content-cut runs.

Every string of `LENGTH` bytes has one anchor: the least-hashed `GRAM` bytes in it, the leftmost of
equals. Neighbouring strings share theirs, so a text is a sequence of runs, one anchor each, and equal
strings have equal anchors wherever they occur. Runs are dealt by anchor. Of runs that are equal as
a whole, only the first stays (within a batch of documents before the shuffle, so that a passage in a
third of all documents is one row per batch); the others repeat it. Where different runs share an
anchor, their bytes are fetched, and a suffix array over the runs of some anchors, built by linear
grouping on 8-byte symbols in step with the anchors, brings equal strings together. The exact check
compares all `LENGTH` bytes: common leading symbols and bytes, and up to seven bytes before them.
An anchor with very many different runs, as at the border of a passage that is in most documents,
would be one task's: its runs are cut to their single strings, which are dealt by digest, and as runs
of one string they are equal as a whole or not at all.

Ids are whole numbers.

Defined results: texts shorter than `LENGTH`, empty or null keep everything; documents without id come
after all others; rows that share an id are documents of their own (told apart by a 24-bit hash of
their text), of which neither is earlier at equal starts, so exactly equal rows lose the same bytes;
an empty table gives an empty table; extra columns stay, but those with the name of a result column
are replaced by it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doorclock.llm.linking import complete_groups, gathered
from doorclock.llm.suffixes import common_prefixes, suffix_array
from doorclock.plans.staging import released, staged

LENGTH, GRAM = 100, 32
REACH = LENGTH - GRAM + 1
SLICE_BYTES, BATCH_BYTES = 1 << 20, 8 << 20
BUCKET_BYTES = 4 << 20
SPLIT = 10_000
STRINGS, ROWS, TEXTS = 200_000, 10_000, 1000
KEY_MASK = np.uint64(2**56 - 1)
LAST = 2**63 - 1

_RNG = np.random.default_rng(2024)
LETTERS = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
FACTORS = _RNG.integers(1, 2**63, 8, dtype=np.uint64) | np.uint64(1)
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def _mixed(a: np.ndarray, b: np.ndarray, k: int) -> np.ndarray:
    h = a * FACTORS[k] + b
    h ^= h >> np.uint64(29)
    h *= GOLDEN
    return h


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the `GRAM` bytes from each position on."""
    h, size = LETTERS[data], 1
    for k in range(5):
        h, size = _mixed(h[:-size], h[size:], k), size * 2
    return h


def string_hashes(grams: np.ndarray) -> np.ndarray:
    """Hash of the `LENGTH` bytes from each position on."""
    two = _mixed(grams[:-GRAM], grams[GRAM:], 5)
    rest = LENGTH - 2 * GRAM
    return _mixed(two[:-rest], two[rest:], 6)


def anchor_runs(data: np.ndarray, sizes: np.ndarray):
    """Runs of texts laid end to end: (text, start in it, strings in the run, anchor, digest)."""
    keep = sizes >= LENGTH
    if not keep.any():
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    offsets = np.cumsum(sizes) - sizes
    grams = gram_hashes(data)
    least, size = grams, 1
    while size * 2 <= REACH:
        least, size = np.minimum(least[:-size], least[size:]), size * 2
    rest = REACH - size
    least = np.minimum(least[:-rest], least[rest:])
    whole = string_hashes(grams)
    n = len(least)
    # A run ends where the least value changes, and where the leftmost least one is left behind.
    begins = np.ones(n, bool)
    begins[1:] = (least[1:] != least[:-1]) | (grams[: n - 1] == least[:-1])
    texts = np.flatnonzero(keep)
    first, last = offsets[texts], offsets[texts] + sizes[texts] - LENGTH
    begins[first] = True
    valid = np.zeros(n + 1, np.int8)
    valid[first] += 1
    valid[last + 1] -= 1
    starts = np.flatnonzero(begins & (np.cumsum(valid[:n]) > 0))
    owner = np.searchsorted(first, starts, "right") - 1
    ends = np.minimum(np.append(starts[1:] - 1, n), last[owner])
    digest = _mixed(whole[starts], whole[ends], 7) + (ends - starts).astype(np.uint64)
    return texts[owner], starts - first[owner], ends - starts + 1, least[starts], digest


FIELDS = [("key", np.uint64, 7), ("digest", np.uint64, 6), ("id", np.int64, 8), ("hash", np.int32, 3), ("start", np.int64, 5), ("n", np.int64, 1)]


def packed_runs(runs: dict[str, np.ndarray]) -> bytes:
    """Columns as planes of bytes, ids as steps: what is alike lies together and compresses."""
    out = []
    for name, kind, width in FIELDS:
        values = runs[name].astype(kind)
        if name == "id":
            values = np.diff(values, prepend=np.int64(0))
        out.append(values.view(np.uint8).reshape(len(values), -1)[:, :width].T.tobytes())
    return b"".join(out)


def unpacked_runs(blob: bytes) -> dict[str, np.ndarray]:
    n = len(blob) // sum(width for *_, width in FIELDS)
    data, at, out = np.frombuffer(blob, np.uint8), 0, {}
    for name, kind, width in FIELDS:
        planes = data[at : at + n * width].reshape(width, n)
        at += n * width
        full = np.zeros((n, np.dtype(kind).itemsize), np.uint8)
        full[:, :width] = planes.T
        values = full.view(kind).ravel()
        out[name] = np.cumsum(values) if name == "id" else values
    return out


def _first_of_equals(runs: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Order by (key, digest, id, start), and which rows of it come after an equal run."""
    order = np.lexsort((runs["start"], runs["id"], runs["digest"], runs["key"]))
    key, digest, ident, start = (runs[c][order] for c in ("key", "digest", "id", "start"))
    head = np.ones(len(order), bool)
    head[1:] = (key[1:] != key[:-1]) | (digest[1:] != digest[:-1])
    at = np.flatnonzero(head)[np.cumsum(head) - 1]
    return order, (ident != ident[at]) | (start != start[at])


def _texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column end to end, and the size of each text."""
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], np.diff(offsets)


def _slices(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Neighbouring texts of about `most` bytes together."""
    upto, at = np.cumsum(sizes), 0
    while at < len(sizes):
        before = upto[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(upto, before + most, "right")))
        yield at, end
        at = end


def cut(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Runs of documents (id, hash, text), packed by bucket; those that repeat in the batch at once."""
    for batch in batches:
        data, sizes = _texts(batch.column("text"))
        ids, hashes = batch.column("id").to_numpy(), batch.column("hash").to_numpy()
        upto = np.concatenate([[0], np.cumsum(sizes)])
        for low, high in _slices(sizes, BATCH_BYTES):
            parts = []
            for at, end in _slices(sizes[low:high], SLICE_BYTES):
                at, end = at + low, end + low
                text, *rest = anchor_runs(data[upto[at] : upto[end]], sizes[at:end])
                parts.append((text + at, *rest))
            text, start, n, anchor, digest = (np.concatenate(c) for c in zip(*parts, strict=True))
            bucket = ((anchor >> np.uint64(40)) % np.uint64(buckets)).astype(np.int32)
            yield from _dealt(bucket, {
                "key": anchor & KEY_MASK, "digest": digest & np.uint64(2**48 - 1),
                "id": ids[text], "hash": hashes[text], "start": start, "n": n,
            })


def _dealt(bucket: np.ndarray, runs: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Runs of neighbouring documents packed by bucket, those after an equal one apart."""
    order, repeats = _first_of_equals(runs)
    for kind, chosen in ((0, order[~repeats]), (1, order[repeats])):
        of, blobs = zip(*_packed_by(bucket[chosen], {c: v[chosen] for c, v in runs.items()}), strict=True) if len(chosen) else ((), ())
        yield pa.RecordBatch.from_arrays(
            [pa.array(of, pa.int32()), pa.array(np.full(len(blobs), kind, np.int32)), pa.array(blobs, pa.binary())],
            ["bucket", "repeated", "runs"],
        )


def _packed_by(bucket: np.ndarray, runs: dict[str, np.ndarray]) -> list[tuple[int, bytes]]:
    """Each bucket with its runs packed, by id and start."""
    by = np.lexsort((runs["start"], runs["id"], bucket))
    bucket, runs = bucket[by], {c: v[by] for c, v in runs.items()}
    cuts = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1)).tolist()
    return [(int(bucket[a]), packed_runs({c: v[a:b] for c, v in runs.items()})) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


SPANS = "id long, hash int, start long, n long, bucket int, key long, single boolean"


def _joined_runs(blobs: pd.Series, most: float = np.inf) -> Iterator[dict[str, np.ndarray]]:
    """Runs of neighbouring blobs together, `most` of them or some more at a time."""
    held, n = [], 0
    for k, blob in enumerate(blobs, 1):
        held.append(unpacked_runs(blob))
        n += len(held[-1]["id"])
        if n >= most or k == len(blobs):
            yield {c: np.concatenate([r[c] for r in held]) for c, *_ in FIELDS}
            held, n = [], 0


def _spans(runs: dict[str, np.ndarray]) -> pd.DataFrame:
    return pd.DataFrame({c: runs[c] for c in ("id", "hash", "start", "n")})


def _in_order(blobs: pd.Series) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The runs of blobs, equal ones together, and which of them come after an equal one."""
    runs = next(_joined_runs(blobs), {c: np.zeros(0, np.int64) for c, *_ in FIELDS})
    order, repeats = _first_of_equals(runs)
    return {c: v[order] for c, v in runs.items()}, repeats


def sorted_out(batches: Iterator[pd.DataFrame], buckets: int) -> Iterator[pd.DataFrame]:
    """Runs of a bucket to repeats (bucket null) and runs whose bytes are needed (with their anchor)."""
    for (bucket,), group in complete_groups(batches, ["bucket"]):
        runs, repeats = _in_order(group.loc[group["repeated"] == 0, "runs"])
        for done in (*_joined_runs(group.loc[group["repeated"] == 1, "runs"], ROWS), {c: v[repeats] for c, v in runs.items()}):
            yield _spans(done).assign(bucket=pd.array([pd.NA] * len(done["id"]), "Int32"), key=0, single=False)
        key, digest = runs["key"], runs["digest"]
        newer = np.ones(len(key), bool)
        newer[1:] = (key[1:] != key[:-1]) | (digest[1:] != digest[:-1])
        _, group_of, counts = np.unique(key, return_inverse=True, return_counts=True)
        kinds = np.bincount(group_of, newer, len(counts)).astype(np.int64)[group_of] if len(key) else np.zeros(0, np.int64)
        asked = (kinds > 1) & ~repeats
        yield pd.DataFrame({
            "id": runs["id"][asked], "hash": runs["hash"][asked], "start": runs["start"][asked], "n": runs["n"][asked],
            "bucket": pd.array(np.full(int(asked.sum()), bucket), "Int32"), "key": key[asked].astype(np.int64), "single": kinds[asked] > SPLIT,
        })


#: `kind` is 0 for bytes of a run; 1 for packed strings, 2 for packed stretches of strings that are repeats.
SNIPPETS = "bucket int, kind int, key long, id long, hash int, start long, n long, bytes binary"


def _snippets(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
    columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["bucket", "kind", "key", "id", "hash", "start", "n", "bytes"])


def _stretches(piece: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where neighbouring (piece, offset) begin, and how many they are."""
    head = np.ones(len(piece), bool)
    head[1:] = (piece[1:] != piece[:-1]) | (offset[1:] != offset[:-1] + 1)
    at = np.flatnonzero(head)
    return at, np.diff(np.append(at, len(piece)))


def _single_strings(runs: list[tuple], buckets: int) -> pa.RecordBatch:
    """Runs (key, id, hash, start, hashes of its strings) as packed strings, those after an equal one as stretches apart."""
    if not runs:
        return _snippets([])
    keys, ids, hashes, starts, wholes = zip(*runs, strict=True)
    n = np.array([len(w) for w in wholes])
    whole, run = np.concatenate(wholes), np.repeat(np.arange(len(n)), n)
    offset = np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n)
    strings = {
        "key": np.array(keys, np.uint64)[run], "digest": _mixed(whole, whole, 7) & np.uint64(2**48 - 1), "id": np.array(ids, np.int64)[run],
        "hash": np.array(hashes, np.int32)[run], "start": np.array(starts, np.int64)[run] + offset, "n": np.ones(len(run), np.int64),
    }
    order, repeats = _first_of_equals(strings)
    known = np.sort(order[repeats])
    at, length = _stretches(run[known], offset[known])
    again = {c: v[known[at]] for c, v in strings.items()} | {"n": length}
    first = {c: v[order[~repeats]] for c, v in strings.items()}
    dealt = ((first["digest"] % np.uint64(buckets)).astype(np.int32), first), ((again["hash"] % buckets).astype(np.int32), again)
    return _snippets([
        (bucket, kind, bucket, 0, 0, 0, 0, blob) for kind, (b, r) in enumerate(dealt, 1) for bucket, blob in _packed_by(b, r)
    ])


def fetched(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """The bytes of asked runs. Of an anchor with very many runs, single strings, dealt by their digest."""
    out: list[tuple] = []
    single: list[tuple] = []
    strings = 0
    for batch in batches:
        for ident, hash_, text, asks in zip(*(batch.column(c) for c in ("id", "hash", "text", "asks")), strict=True):
            data = (text.as_py() or "").encode()
            ident, hash_ = ident.as_py(), hash_.as_py()
            for ask in asks.as_py():
                start, n, bucket, key = (ask[c] for c in ("start", "n", "bucket", "key"))
                piece = data[start : start + n + LENGTH - 1]
                if ask["single"]:
                    single.append((key, ident, hash_, start, string_hashes(gram_hashes(np.frombuffer(piece, np.uint8)))))
                    strings += n
                else:
                    out.append((bucket, 0, key, ident, hash_, start, n, piece))
            if len(out) >= ROWS:
                yield _snippets(out)
                out = []
            if strings >= STRINGS:
                yield _single_strings(single, buckets)
                single, strings = [], 0
    yield _snippets(out)
    yield _single_strings(single, buckets)


def anchor_places(pieces: list[bytes], n: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Place of the leftmost gram in each piece that has the anchor's hash and is in all its strings."""
    sizes = np.array([len(p) for p in pieces])
    grams = gram_hashes(np.frombuffer(b"".join(pieces) + bytes(GRAM), np.uint8))[: sizes.sum()] & KEY_MASK
    owner = np.repeat(np.arange(len(pieces)), sizes)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    hit = np.flatnonzero((grams == keys[owner]) & (within >= n[owner] - 1) & (within <= sizes[owner] - GRAM))
    place = np.zeros(len(pieces), np.int64)
    place[owner[hit][::-1]] = within[hit][::-1]
    return place


def repeated_strings(pieces: list[bytes], n: np.ndarray, keys: np.ndarray, ids: np.ndarray, starts: np.ndarray):
    """(piece, offset) of every string of the pieces that also starts at a lesser (id, start)."""
    front = -anchor_places(pieces, n, keys) % 8
    sizes = np.array([len(p) for p in pieces])
    padded = (front + sizes + 7) // 8 * 8 + 8
    zeros = bytes(16)
    text = b"".join(x for p, f, s, t in zip(pieces, front.tolist(), sizes.tolist(), padded.tolist(), strict=True) for x in (zeros[:f], p, zeros[: t - f - s]))
    symbols = np.frombuffer(text, ">u8").astype(np.uint64)
    order = suffix_array(np.unique(symbols, return_inverse=True)[1])
    shared = common_prefixes(symbols, order, LENGTH)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))

    piece = np.repeat(np.arange(len(pieces)), n)
    offset = np.arange(len(piece)) - np.repeat(np.cumsum(n) - n, n)
    at = np.repeat(np.cumsum(padded) - padded + front, n) + offset
    ident, start = ids[piece], starts[piece] + offset
    early = -at % 8
    repeated = np.zeros(len(piece), bool)
    for lead in range(8):
        own = np.flatnonzero(early == lead)
        symbol = (at[own] + lead) // 8
        # Suffixes that agree in LENGTH - lead bytes are neighbours; the bytes before must agree too.
        group = np.cumsum(shared < LENGTH - lead)[rank[symbol]]
        before = symbols[symbol - 1] & np.uint64(2 ** (8 * lead) - 1) if lead else np.zeros(len(own), np.uint64)
        by = np.lexsort((start[own], ident[own], before, group))
        g, b, i, s = group[by], before[by], ident[own][by], start[own][by]
        head = np.ones(len(by), bool)
        head[1:] = (g[1:] != g[:-1]) | (b[1:] != b[:-1])
        first = np.flatnonzero(head)[np.cumsum(head) - 1] if len(by) else by
        repeated[own[by]] = (i != i[first]) | (s != s[first])
    return piece[repeated], offset[repeated]


def compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Fetched runs, of some anchors at a time, to the stretches of their strings that are repeats; and of single strings."""
    for group in gathered(batches, ["kind", "key"]):
        kind = group["kind"].to_numpy()
        for done in _joined_runs(group.loc[kind == 2, "bytes"], ROWS):
            yield _spans(done)
        for _, blobs in group[kind == 1].groupby("key")["bytes"]:
            strings, repeats = _in_order(blobs)
            yield _spans({c: v[repeats] for c, v in strings.items()})
        group = group[kind == 0]
        if not len(group):
            continue
        n, ids, hashes, starts = (group[c].to_numpy().astype(np.int64) for c in ("n", "id", "hash", "start"))
        piece, offset = repeated_strings(list(group["bytes"]), n, group["key"].to_numpy().astype(np.uint64), ids, starts)
        if len(piece):
            at, length = _stretches(piece, offset)
            p = piece[at]
            yield pd.DataFrame({"id": ids[p], "hash": hashes[p], "start": starts[p] + offset[at], "n": length})


def _kept(data: bytes, starts: np.ndarray, n: np.ndarray) -> tuple[bytes, int, int]:
    """Bytes left after removing the strings that start in [start, start + n); bytes and spans removed."""
    edge = np.zeros(len(data) + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + n + LENGTH - 1, -1)
    gone = np.cumsum(edge[:-1]) > 0
    spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
    return np.frombuffer(data, np.uint8)[~gone].tobytes(), int(gone.sum()), spans


def _removal(as_text: bool):
    """A Pandas UDF of (text, gone) to what is kept; as text, without halves of characters at the cuts."""

    def remove(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, spans in batches:
            for at in range(0, len(texts), TEXTS):
                out = []
                for text, gone in zip(texts[at : at + TEXTS], spans[at : at + TEXTS], strict=True):
                    data = (text or "").encode()
                    if gone is None or not len(gone):
                        kept, n_removed, n_spans = data, 0, 0
                    else:
                        kept, n_removed, n_spans = _kept(data, np.array([g["start"] for g in gone]), np.array([g["n"] for g in gone]))
                    out.append((kept.decode("utf-8", "ignore") if as_text else kept, n_removed, n_spans))
                yield pd.DataFrame(out, columns=["kept", "n_removed", "n_spans"])

    kind = "string" if as_text else "binary"
    return F.pandas_udf(remove, f"kept {kind}, n_removed long, n_spans long")  # type: ignore[call-overload]


def deduplicated(docs: DataFrame, text: str = "text", key: str = "doc_id", as_text: bool = False) -> DataFrame:
    """Every document with `kept` (the bytes left, or the text), `n_bytes`, `n_removed` and `n_spans`."""
    spark = docs.sparkSession
    # The text is a column of its own, once, and not part of the rest that shuffles carry along.
    rest = [c for c in docs.columns if c != text]
    own = F.col(f"`{text}`")
    rows = docs.select(
        F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in rest]).alias("row"),
        F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(LAST)).alias("id"),
        (F.pmod(F.xxhash64(own), F.lit(2**24))).cast("int").alias("hash"), own.alias("text"),
    )
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(64, -(-total // BUCKET_BYTES))

    runs = rows.select("id", "hash", "text").mapInArrow(lambda it: cut(it, buckets), "bucket int, repeated int, runs binary")
    dealt = runs.repartition("bucket").sortWithinPartitions("bucket")
    spans = staged(dealt.mapInPandas(lambda it: sorted_out(it, buckets), SPANS), "runs")
    released(spark)

    asked = spans.where("bucket is not null").groupBy("id", "hash").agg(F.collect_list(F.struct("start", "n", "bucket", "key", "single")).alias("asks"))
    wanted = rows.select("id", "hash", "text").join(asked, ["id", "hash"]).mapInArrow(lambda it: fetched(it, buckets), SNIPPETS)
    found = wanted.repartition("bucket").sortWithinPartitions("kind", "key").mapInPandas(compared, "id long, hash int, start long, n long")
    found = staged(found, "found")
    released(spark)
    gone = spans.where("bucket is null").select("id", "hash", "start", "n").unionByName(found)
    gone = gone.groupBy("id", "hash").agg(F.collect_list(F.struct("start", "n")).alias("gone"))

    joined = rows.join(gone, ["id", "hash"], "left").withColumn("_kept", _removal(as_text)(F.col("text"), F.col("gone")))
    added = {
        "kept": F.col("_kept.kept"), "n_bytes": F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"),
        "n_removed": F.col("_kept.n_removed"), "n_spans": F.col("_kept.n_spans"),
    }
    own = {c: F.col("text") if c == text else F.col("row").getField(c) for c in docs.columns if c not in added}
    return joined.select(*[c.alias(name) for name, c in (own | added).items()])


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return deduplicated(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
