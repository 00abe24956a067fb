import random

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from doorclock.llm import substrings as S
from doorclock.llm.suffixes import common_prefixes, suffix_array


def by_hand(rows):
    """Bytes left of (id, text) rows with distinct ids."""
    first = {}
    data = {i: (t or "").encode() for i, t in rows}
    for i in sorted(data):
        for p in range(len(data[i]) - S.LENGTH + 1):
            first.setdefault(data[i][p : p + S.LENGTH], (i, p))
    out = {}
    for i, d in data.items():
        gone = np.zeros(len(d) + 1, bool)
        for p in range(len(d) - S.LENGTH + 1):
            if first[d[p : p + S.LENGTH]] != (i, p):
                gone[p : p + S.LENGTH] = True
        out[i] = (bytes(c for c, g in zip(d, gone) if not g), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum() + gone[0]))
    return out


def left(df, **more):
    return {r.doc_id: (bytes(r.kept), r.n_removed, r.n_spans) for r in S.deduplicated(df, **more).collect()}


def passages(seed):
    rng = random.Random(seed)
    letters = "ab" if seed == 0 else "abcdefgh \n" if seed == 1 else "aé日 x"
    pool = ["".join(rng.choice(letters) for _ in range(rng.choice([40, 99, 100, 101, 180, 400]))) for _ in range(12)]
    pool += ["a" * 230, "ab" * 120, "abc" * 70]
    return [(k * 3 + 1, "".join(rng.choice(pool) + rng.choice(["", "#", "".join(rng.choice(letters) for _ in range(30))]) for _ in range(rng.randint(0, 7)))) for k in range(60)]


@pytest.mark.parametrize("seed", range(3))
def test_removal_equals_brute_force(spark, seed):
    rows = passages(seed)
    assert left(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)) == by_hand(rows)


def test_hot_anchor_is_split(spark, monkeypatch):
    monkeypatch.setattr(S, "SPLIT", 5)
    rng = random.Random(4)
    shared = "".join(rng.choice("abcdefghij ") for _ in range(300))
    rows = [(k, "".join(rng.choice("klmnop") for _ in range(80)) + shared[k % 7 :] + str(k) * 20) for k in range(60)]
    assert left(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)) == by_hand(rows)


def test_suffix_arrays_of_all_short_texts():
    rng = np.random.default_rng(1)
    for _ in range(3000):
        text = rng.integers(1, rng.integers(2, 6), rng.integers(0, 20))
        want = sorted(range(len(text)), key=lambda i: text[i:].tolist())
        assert suffix_array(text).tolist() == want


def test_common_prefixes():
    text = (b"abcdefgh" * 3 + b"abcdefgX" + b"zzzzzzzz" * 2)
    symbols = np.frombuffer(text, ">u8").astype(np.uint64)
    order = suffix_array(np.unique(symbols, return_inverse=True)[1])
    got = common_prefixes(symbols, order, 100)
    for k in range(1, len(order)):
        a, b = text[order[k] * 8 :], text[order[k - 1] * 8 :]
        n = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert got[k] == n


def test_packed_runs_come_back():
    rng = np.random.default_rng(0)
    runs = {"key": rng.integers(0, 2**56, 50, dtype=np.uint64), "digest": rng.integers(0, 2**48, 50, dtype=np.uint64),
            "id": np.sort(rng.integers(-5, 2**62, 50)), "hash": rng.integers(0, 2**24, 50).astype(np.int32), "start": rng.integers(0, 2**33, 50), "n": rng.integers(1, 70, 50)}
    back = S.unpacked_runs(S.packed_runs(runs))
    assert all((back[c] == runs[c]).all() for c in runs)


def test_odd_rows(odd_documents, no_documents):
    got = S.deduplicated(odd_documents).collect()
    assert len(got) == odd_documents.count()
    for r in got:
        assert r.n_bytes == len((r.text or "").encode()) and len(r.kept) + r.n_removed == r.n_bytes
    whole = {r.doc_id: r.n_removed == r.n_bytes for r in got if r.text and r.text.startswith("tale")}
    assert whole == {1: False, 2: True, 3: False, None: True}
    assert next(r for r in got if r.doc_id == 9 and r.text[0] == "a").n_removed == 1499
    assert S.deduplicated(no_documents).collect() == []


def test_as_text_drops_halves_of_characters(spark):
    shared = "".join(chr(0xE0 + k % 30) for k in range(80))
    rows = [(1, "x" + shared + "z"), (2, "yÀ" + chr(0x3FF) + shared[1:] + "日")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = {i: data.decode("utf-8", "ignore") for i, (data, *_) in by_hand(rows).items()}
    assert {r.doc_id: r.kept for r in S.deduplicated(df, as_text=True).collect()} == want
    assert len(want[2]) < 20


def in_process(rows, buckets=64):
    """What `deduplicated` does with (id, text) rows in its tasks, without a session: what is left, and the snippets that moved."""
    hashes = {i: i * 7 % 2**24 for i, _ in rows}
    docs = pa.table({"id": pa.array([i for i, _ in rows], pa.int64()), "hash": pa.array([hashes[i] for i, _ in rows], pa.int32()), "text": [t for _, t in rows]})
    runs = pd.concat([b.to_pandas() for b in S.cut(iter(docs.to_batches(max_chunksize=50)), buckets)]).sort_values("bucket", kind="stable")
    spans = pd.concat(list(S.sorted_out(iter([runs.reset_index(drop=True)]), buckets)))
    asked, gone = spans[spans["bucket"].notna()], spans[spans["bucket"].isna()]
    asks = [asked.loc[asked["id"] == i, ["start", "n", "bucket", "key", "single"]].to_dict("records") for i, _ in rows]
    wanted = docs.append_column("asks", pa.array(asks)).to_batches(max_chunksize=50)
    snippets = pd.concat([b.to_pandas() for b in S.fetched(iter(wanted), buckets)]).sort_values(["kind", "key"], kind="stable").reset_index(drop=True)
    gone = pd.concat([gone, *S.compared(snippets.iloc[a : a + 100].reset_index(drop=True) for a in range(0, len(snippets), 100))])
    out = {}
    for i, text in rows:
        own = gone[gone["id"] == i]
        assert (own["hash"] == hashes[i]).all()
        out[i] = S._kept((text or "").encode(), own["start"].to_numpy().astype(int), own["n"].to_numpy().astype(int)) if len(own) else ((text or "").encode(), 0, 0)
    return out, snippets


def bordered(n):
    """Texts that share one passage, and nothing else but some letters at its borders."""
    rng = random.Random(4)
    shared = "".join(rng.choice("abcdefghij ") for _ in range(160))
    return [(k, "".join(rng.choice("klmnop") for _ in range(150)) + shared + "".join(rng.choice("qrs") for _ in range(150))) for k in range(n)]


@pytest.mark.parametrize("strings", [1, 500, 200_000])
def test_border_of_a_common_passage_is_nobodys_whole_task(monkeypatch, strings):
    """Of an anchor with many different runs nothing comes together in one suffix array, and little moves."""
    monkeypatch.setattr(S, "SPLIT", 20)
    monkeypatch.setattr(S, "STRINGS", strings)
    most, real = [0], S.repeated_strings
    monkeypatch.setattr(S, "repeated_strings", lambda pieces, *a: (most.append(len(pieces)), real(pieces, *a))[1])
    rows = bordered(300)
    got, snippets = in_process(rows)
    assert got == by_hand(rows)
    assert max(most) < 300
    assert snippets["bytes"].map(len).sum() < 64 * sum(len(t) for _, t in rows)
    packed = snippets[snippets["kind"] == 1]
    assert len(packed["bucket"].unique()) > 30


def test_anchors_of_a_bucket_are_compared_some_at_a_time(monkeypatch):
    most, real = [0], S.repeated_strings
    monkeypatch.setattr(S, "repeated_strings", lambda pieces, *a: (most.append(len(pieces)), real(pieces, *a))[1])
    rng = random.Random(6)
    texts = ["".join(rng.choice("abcdef ") for _ in range(400)) for _ in range(60)]
    rows = [(k, t if k < 60 else t[3:200] + "#" + t[201:]) for k, t in enumerate(texts + texts)]
    got, snippets = in_process(rows, buckets=1)
    assert got == by_hand(rows) and len(snippets) > 150
    assert max(most) < len(snippets)


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("split", [1, 3])
def test_single_strings_equal_brute_force(monkeypatch, seed, split):
    monkeypatch.setattr(S, "SPLIT", split)
    monkeypatch.setattr(S, "STRINGS", 300)
    rows = passages(seed)
    got, snippets = in_process(rows)
    assert got == by_hand(rows) and (snippets["kind"] == 1).any()


def test_repeats_of_a_bucket_come_in_few_frames():
    runs = {"key": np.full(200, 3, np.uint64), "digest": np.arange(200, dtype=np.uint64), "id": np.arange(200), "hash": np.arange(200).astype(np.int32), "start": np.zeros(200, np.int64), "n": np.ones(200, np.int64)}
    blobs = [S.packed_runs({c: v[k : k + 1] for c, v in runs.items()}) for k in range(200)]
    frames = [f for f in S.sorted_out(iter([pd.DataFrame({"bucket": 0, "repeated": 1, "runs": blobs})]), 64) if len(f)]
    assert len(frames) == 1 and frames[0]["id"].tolist() == list(range(200))
