import dataclasses
import random
import subprocess
import sys
from pathlib import Path

import pytest
import sentencepiece

from doorclock.llm import pieces as P

REPO = Path(__file__).resolve().parents[2]


@pytest.fixture(scope="module")
def vocabulary():
    return P.Vocabulary.read()


def ids_of(encoder, texts):
    ids, sizes = encoder.encode(texts)
    out, at = [], 0
    for n in sizes.tolist():
        out.append(ids[at : at + n].tolist())
        at += n
    return out


def test_ids_equal_the_usual_encoder(vocabulary):
    usual = sentencepiece.SentencePieceProcessor(model_file=P.MODEL)
    rng = random.Random(0)
    letters = "abcdehinorst  \n.'éñ語\t🙂A0"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 70))) for _ in range(1500)]
    texts += ["", "   ", "a" * 300, " " * 40 + "x", "\n\n", "ab" * 200, "\0", "Hello  world", "日本語 x", "The quick brown fox. " * 20]
    assert ids_of(P.Encoder(vocabulary), texts) == usual.encode(texts)


def test_documents_equal_the_usual_encoder(vocabulary, documents):
    usual = sentencepiece.SentencePieceProcessor(model_file=P.MODEL)
    rows = P.encoded(documents, vocabulary).select("text", "pieces").collect()
    assert [r.pieces for r in rows] == usual.encode([r.text for r in rows])


def test_greedy_longest_would_differ(vocabulary):
    """Relaxing decides by fitting pieces, not by length: merges can end in shorter pieces."""
    encoder = P.Encoder(vocabulary)
    longest, known = 0, set(vocabulary.texts)
    for word in (" " + a + b for a in ("there", "inner", "tionst", "ouness") for b in ("ing", "tion", "ered", "s")):
        ids = ids_of(encoder, [word[1:]])[0]
        assert "".join(vocabulary.texts[i] for i in ids) == word
        greedy, rest = [], word
        while rest:
            n = max(k for k in range(1, 17) if rest[:k] in known)
            greedy, rest = [*greedy, rest[:n]], rest[n:]
        longest += greedy != [vocabulary.texts[i] for i in ids]
    assert longest


def test_round_trip_of_odd_rows(odd_documents, no_documents, vocabulary):
    out = P.decoded(P.encoded(odd_documents, vocabulary), vocabulary)
    got = out.select("text", "pieces", "decoded").collect()
    assert len(got) == odd_documents.count()
    assert all(r.decoded == r.text for r in got)
    assert all((r.pieces is None) == (r.text is None) for r in got)
    assert P.encoded(no_documents, vocabulary).collect() == []


def test_text_back_in_the_same_pass(odd_documents, vocabulary):
    got = P.encoded(odd_documents, vocabulary, back="score")
    assert got.columns == [*[c for c in odd_documents.columns if c != "pieces" and c != "score"], "pieces", "score"]
    rows = got.select("text", "score").collect()
    assert len(rows) == odd_documents.count() and all(r.score == r.text for r in rows)


def test_small_arrays_and_little_memory_give_the_same(vocabulary, monkeypatch):
    rng = random.Random(2)
    texts = [" ".join("".join(rng.choices("abcdeé語", k=rng.randint(1, 9))) for _ in range(30)) for _ in range(60)] + ["x" * 500]
    want = ids_of(P.Encoder(vocabulary), texts)
    monkeypatch.setattr(P, "INDEX_CHARS", 40)
    monkeypatch.setattr(P, "REMEMBERED_CHARS", 300)
    encoder = P.Encoder(vocabulary)
    assert [ids_of(encoder, [t])[0] for t in texts] == want


def test_memory_of_many_distinct_words():
    """A part of distinct words only, in a process of its own: its peak stays far below an executor's share."""
    code = (
        "import random, resource\n"
        "from doorclock.llm import pieces as P\n"
        "encoder = P.Encoder(P.Vocabulary.read())\n"
        "rng = random.Random(3)\n"
        "for _ in range(4):\n"
        "    encoder.encode([' '.join(''.join(rng.choices('abcdefghijklmnop', k=9)) for _ in range(100000))])\n"
        "print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)\n"
    )
    done = subprocess.run([sys.executable, "-c", code], cwd=REPO, check=True, capture_output=True, text=True, timeout=300)
    assert int(done.stdout) < 420


def test_unknown_piece_without_byte_pieces(vocabulary):
    bare = dataclasses.replace(vocabulary, byte_ids=[-1] * 256)
    assert ids_of(P.Encoder(bare), ["\n"])[0][-1] == vocabulary.unknown


def test_merges_of_a_small_vocabulary():
    """Encoding equals merging step by step, also where pieces could be cut in other ways."""
    texts = ["", " ", *"abc", "ab", "bc", " a", "abc", "bca", "aa", "aaa", "  ", " ab", "caa"]
    rng = random.Random(1)
    for _ in range(6):
        scores = [0.0] * len(texts)
        for k, i in enumerate(rng.sample(range(5, len(texts)), len(texts) - 5)):
            scores[i] = -float(k)
        vocabulary = P.Vocabulary.of(list(texts), list(scores), [-1] * 256, 0)
        rank = {t: -scores[i] for i, t in enumerate(texts) if len(t) > 1}
        words = ["".join(rng.choice("abc ") for _ in range(rng.randint(1, 14))) for _ in range(300)]
        for word, ids in zip(words, ids_of(P.Encoder(vocabulary), words), strict=True):
            want = []
            for segment in P.SEGMENT.findall(" " + word):
                parts = list(segment)
                while len(parts) > 1:
                    best, at = min((rank.get(a + b, 99), k) for k, (a, b) in enumerate(zip(parts, parts[1:])))
                    if best == 99:
                        break
                    parts[at : at + 2] = [parts[at] + parts[at + 1]]
                want += parts
            assert [texts[i] for i in ids] == want
