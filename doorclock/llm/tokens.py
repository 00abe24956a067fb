"""Token counts of the fields and sections of documents, by offsets of whole-document tokens.

The fields of a document are joined to one text, which is encoded once, as a trainer would see it. The
tokens' byte lengths give their spans in the text; sections are spans too (each line of each field).
Tokens and sections are joined on their intervals inside the document. A token that crosses the
boundary of sections goes, by rule, to the section in which it begins ("first"), to the one in which it ends
("last"), or to the one that holds most of its bytes, the earlier of equals ("most"). So the counts of
the sections add up to the document's, which encoding them apart would not give.

Spans are in bytes. Section boundaries never lie inside a character, so counting by characters gives
the same sections; a token that holds part of a character begins where that part does.

Defined results: a null field is empty; fields are joined by line ends, which belong to the line that they
end; a document of empty fields has only those line ends as tokens; special tokens' names are plain
text; equal rows have equal counts; an empty table gives an empty table; extra columns stay, but
those with the name of a result column are replaced by it.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doorclock.llm.columns import packed, unpacked

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# How the vocabulary's makers cut text before merging. Fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
RULES = ("first", "last", "most")
RESULT = "array<struct<field:int,line:int,tokens:int>>"


def read_ranks(path: str = VOCABULARY) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


def section_of(token_starts: np.ndarray, token_ends: np.ndarray, sections: np.ndarray, rule: str) -> np.ndarray:
    """The section of each token; `sections` are the sorted first bytes of spans that cover the text."""
    first = np.searchsorted(sections, token_starts, "right") - 1
    last = np.searchsorted(sections, token_ends - 1, "right") - 1
    if rule == "first":
        return first
    if rule == "last":
        return last
    out = first.copy()
    for t in np.flatnonzero(last > first).tolist():
        edges = np.clip(np.append(sections[first[t] : last[t] + 1], token_ends[t]), token_starts[t], token_ends[t])
        out[t] = first[t] + int(np.diff(edges).argmax())
    return out


def sections(fields: list[bytes]) -> tuple[bytes, np.ndarray, list[tuple[int, int]]]:
    """The joined text, the first byte of each section, and its (field, line)."""
    text = b"\n".join(fields)
    starts, names, at = [], [], 0
    for k, field in enumerate(fields):
        lines = np.flatnonzero(np.frombuffer(field, np.uint8) == 10) + 1
        starts += [at, *(lines + at).tolist()]
        names += [(k, line) for line in range(len(lines) + 1)]
        at += len(field) + 1
    return text, np.array(starts, np.int64), names


def attributed(docs: DataFrame, ranks: dict[bytes, int], fields: Sequence[str] = ("source", "text"), rule: str = "first",
               pattern: str = PATTERN) -> DataFrame:
    """Every row with `n_tokens`, `n_crossing` and `sections`: (field, line, tokens) in order."""
    if rule not in RULES:
        raise ValueError(f"no such rule: {rule}")

    def count(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        import tiktoken

        encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        length = np.zeros(max(ranks.values(), default=0) + 1, np.int64)
        for token, rank in ranks.items():
            length[rank] = len(token)
        for batch in batches:
            totals, crossing, sizes, out = [], [], [], []
            for row in zip(*(column.to_pylist() for column in batch), strict=True):
                text, starts, names = sections([(f or "").encode() for f in row])
                ids = np.asarray(encoding.encode_to_numpy(text.decode(), disallowed_special=()), np.int64)
                ends = np.cumsum(length[ids])
                begins = ends - length[ids]
                own = section_of(begins, ends, starts, rule)
                crossing.append(int((section_of(begins, ends, starts, "last") != section_of(begins, ends, starts, "first")).sum()))
                totals.append(len(ids))
                sizes.append(len(starts))
                out.append(np.column_stack([np.array(names, np.int32), np.bincount(own, minlength=len(starts))]))
            flat = np.concatenate(out or [np.zeros((0, 3), np.int64)]).astype(np.int32)
            items = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], ["field", "line", "tokens"])
            offsets = pa.array(np.concatenate([[0], np.cumsum(np.array(sizes, np.int64))]).astype(np.int32))
            yield pa.StructArray.from_arrays(
                [pa.array(totals, pa.int64()), pa.array(crossing, pa.int64()), pa.ListArray.from_arrays(offsets, items)],
                ["n_tokens", "n_crossing", "sections"],
            )

    run = F.arrow_udf(count, f"n_tokens long, n_crossing long, sections {RESULT}")  # type: ignore[call-overload]
    rows = packed(docs).withColumn("_found", run(*[F.col("row").getField(f) for f in fields]))
    return unpacked(rows, docs.columns, {c: F.col(f"_found.{c}") for c in ("n_tokens", "n_crossing", "sections")})


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return attributed(docs, read_ranks()).select(
        "doc_id", "n_tokens", "n_crossing", F.size("sections").alias("n_sections"),
        F.transform("sections", lambda s: s["tokens"]).alias("section_tokens"),
    )
