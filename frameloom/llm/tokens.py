"""Encoding of whole texts by a public byte-level tokenizer from a local rank file.

The library splits a text with one regular expression and merges bytes inside each piece. No
piece continues from a character that is no blank to a blank, from an ASCII letter to an
ASCII digit or back, or from a digit to a comma. Texts of any length are cut at such
boundaries first: the ids of the parts, one after the other, are those of the whole. Most
parts are words that come again and again, so a worker keeps the ids of parts it has met
(a bounded memo, as bytes) and the library is called for new ones only.

Null and empty texts give an empty list. Text is taken as it stands; the strings of
special tokens are ordinary text. Other columns of the input are not read.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Fixed value: the public pattern that belongs to the rank file.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
RANK_FILE = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The blanks of the library's regular expressions; Python's own class has four controls more.
BLANK = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PARTS = re.compile(f"[{BLANK}]*[^{BLANK}]+|[{BLANK}]+")
#: Cuts inside a part: between letters and digits, before a comma that follows a digit.
INNER = re.compile(r"(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z,])")
MEMO_PARTS = 400_000
MEMO_LENGTH = 40

_loaded: dict[str, object] = {}
_memo: dict[str, dict[str, bytes]] = {}


def encoding(rank_file: str):
    """The tokenizer of a rank file; read once for each Python worker."""
    if rank_file not in _loaded:
        import tiktoken

        with open(rank_file, "rb") as lines:
            ranks = {base64.b64decode(piece): int(rank) for piece, rank in (line.split() for line in lines if line.strip())}
        _loaded[rank_file] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _loaded[rank_file]


def parts(text: str) -> list[str]:
    """Cut a text before each run of blanks that follows something else; joined, the parts are the text."""
    return PARTS.findall(text)


def _part_ids(part: str, memo: dict[str, bytes], rank_file: str) -> bytes:
    """Ids, as bytes, of a part the memo lacks."""
    pieces = INNER.split(part)
    made = []
    for piece in pieces:
        known = memo.get(piece)
        if known is None:
            known = np.asarray(encoding(rank_file).encode_ordinary(piece), dtype="<i4").tobytes()
            if len(piece) <= MEMO_LENGTH:
                if len(memo) >= MEMO_PARTS:
                    memo.clear()
                memo[piece] = known
        made.append(known)
    return b"".join(made)


def encode(text: str | None, rank_file: str = RANK_FILE) -> np.ndarray:
    if not text:
        return np.zeros(0, dtype=np.int32)
    memo = _memo.setdefault(rank_file, {})
    known = memo.get
    return np.frombuffer(b"".join([known(p) or _part_ids(p, memo, rank_file) for p in PARTS.findall(text)]), dtype="<i4")


def decode_bytes(ids: np.ndarray, rank_file: str = RANK_FILE) -> bytes:
    """The raw bytes of ids; they need not be valid text where a character is cut."""
    return encoding(rank_file).decode_bytes([int(i) for i in ids])


def token_ids(documents: DataFrame, rank_file: str = RANK_FILE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids) of every document, in one pass without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [encode(t, rank_file) for t in batch.column(1).to_pylist()]
            ends = np.zeros(len(made) + 1, dtype=np.int64)
            np.cumsum([len(m) for m in made], out=ends[1:])
            flat = pa.array(np.concatenate(made) if made else np.zeros(0, dtype=np.int32), pa.int32())
            ids = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), flat)
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=["doc_id", "ids"])

    chosen = documents.select(documents[id_col].cast("bigint").alias("doc_id"), documents[text_col].cast("string").alias("text"))
    return chosen.mapInArrow(run, "doc_id bigint, ids array<int>")


def decoded(ids: DataFrame, rank_file: str = RANK_FILE) -> DataFrame:
    """(doc_id, raw) back from (doc_id, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [decode_bytes(i if i is not None else [], rank_file) for i in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], names=["doc_id", "raw"])

    return ids.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, raw binary")
