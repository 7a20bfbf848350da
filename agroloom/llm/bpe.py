"""BPE encoding and decoding, long texts by tree concatenation.

Texts up to ``long_bytes`` are encoded where they are read; nothing is shuffled. A longer text is halved again and
again into leaves, which are dealt out over the cluster and encoded in parallel, and a tree of joins puts their ids
together. Two kinds of cut are made:

* where the pre-tokenizer splits in any context (before white space that follows other text, around special tokens,
  between pieces of a run without white space): the ids of both sides are simply put together;
* inside one unsplit piece: the ends of both sides are re-encoded over a window that grows until its first and last
  token are those of the old sides. A sequence of pair-coded tokens is the encoding of its bytes exactly if every
  pair of neighbours is the encoding of theirs; with both ends unchanged each pair has been seen by one encoding.

Edge cases: null text counts as empty and gives no ids; rows that repeat a doc_id are encoded one by one; an empty
table gives an empty result; other columns are never read.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from agroloom.llm.common import texts
from agroloom.llm.tokenization import ByteEncoder, byte_encoder

#: Texts of more bytes are halved; leaves hold at most so many characters.
LONG_BYTES = 65_536
LEAF_CHARS = 16_384

CUT = re.compile(r"(?<=[^\s])(?=[ \t\n])")
ROWS_OUT = 256


def safe_cuts(text: str, specials: list[str]) -> list[int]:
    """Positions at which both sides are encoded as if they stood alone."""
    cuts = {m.start() for m in CUT.finditer(text)}
    for s in specials:
        for m in re.finditer(re.escape(s), text):
            cuts |= {m.start(), m.end()}
    return sorted(c for c in cuts if 0 < c < len(text))


def leaves(text: str, coder: ByteEncoder, leaf_chars: int = LEAF_CHARS) -> list[tuple[str, bool, bool]]:
    """(text, raw, inner) of each leaf in order; raw: part of one unsplit piece; inner: it goes on with the piece before it."""
    cuts = safe_cuts(text, [*coder.special])
    out: list[tuple[str, bool, bool]] = []

    def halve_piece(a: int, b: int, inner: bool) -> None:
        if b - a <= leaf_chars:
            out.append((text[a:b], True, inner))
        else:
            mid = (a + b) // 2
            halve_piece(a, mid, inner)
            halve_piece(mid, b, True)

    def halve(a: int, b: int, cuts: list[int], lo: int, hi: int) -> None:
        """cuts[lo:hi] are the safe cuts inside (a, b)."""
        if b - a <= leaf_chars:
            out.append((text[a:b], False, False))
        elif lo < hi:
            k = min(max(bisect_left(cuts, (a + b) // 2, lo, hi), lo), hi - 1)
            halve(a, cuts[k], cuts, lo, k)
            halve(cuts[k], b, cuts, k + 1, hi)
        else:
            pieces = coder.pieces(text[a:b])
            # a run of white space is split by what follows it, so no cut between the two
            inside = [a + s for s, _ in pieces if s and (text[a + s].isspace() or not text[a + s - 1].isspace())]
            if inside:
                halve(a, b, inside, 0, len(inside))
            else:
                halve_piece(a, b, False)

    halve(0, len(text), cuts, 0, len(cuts))
    return out


def raw_ids(coder: ByteEncoder, part: bytes) -> np.ndarray:
    """Ids of bytes taken as one piece; they need not be whole characters."""
    return np.array([t.id for t in coder.library.model.tokenize(part.decode("latin-1").translate(coder.symbols))], "<u4")


def join_ids(coder: ByteEncoder, left: np.ndarray, right: np.ndarray, window: int = 8) -> np.ndarray:
    """Ids of two neighbouring parts of one unsplit piece, from the ids of either part."""
    if not len(left) or not len(right):
        return np.concatenate([left, right])
    while True:
        a, b = left[-window:], right[:window]
        new = raw_ids(coder, coder.bytes_of([*a.tolist(), *b.tolist()]))
        if (len(a) == len(left) or new[0] == a[0]) and (len(b) == len(right) or new[-1] == b[-1]):
            return np.concatenate([left[: len(left) - len(a)], new, right[len(b) :]])
        window *= 2


def join_tree(coder: ByteEncoder, parts: list[tuple[np.ndarray, bool]]) -> np.ndarray:
    """Ids of a text from those of its leaves: (ids, goes on with the piece before it), joined two by two."""
    runs: list[list[np.ndarray]] = []
    for ids, inner in parts:
        if inner and runs:
            runs[-1].append(ids)
        else:
            runs.append([ids])
    whole = []
    for run in runs:
        while len(run) > 1:
            run = [join_ids(coder, *run[i : i + 2]) if i + 1 < len(run) else run[i] for i in range(0, len(run), 2)]
        whole.append(run[0])
    return np.concatenate(whole) if whole else np.zeros(0, "<u4")


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", long_bytes: int = LONG_BYTES, leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """(doc_id, ids): ids of each whole text, as little-endian unsigned 32-bit integers in a binary column."""
    rows = texts(docs, id_col, text_col)

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = byte_encoder(path)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS_OUT):
                b = whole.slice(at, ROWS_OUT)
                ids = [coder.encode(t).tobytes() for t in b.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    def halved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = byte_encoder(path)
        for b in batches:
            for doc, row, text in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(1).to_pylist(), strict=True):
                parts = leaves(text, coder, leaf_chars)
                n = len(parts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([doc] * n, pa.int64()), pa.array([row] * n, pa.int64()), pa.array(range(n), pa.int32()), *(pa.array(x, t) for x, t in zip(zip(*parts, strict=True), (pa.string(), pa.bool_(), pa.bool_()), strict=True))],
                    ["doc_id", "row", "leaf", "text", "raw", "inner"],
                )

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = byte_encoder(path)
        for b in batches:
            parts = zip(b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True)
            ids = [(raw_ids(coder, t.encode()) if raw else coder.encode(t)).tobytes() for t, raw in parts]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], b.column(5), pa.array(ids, pa.binary())], ["doc_id", "row", "leaf", "inner", "ids"])

    def joined(leaves_of_one: pa.Table) -> pa.Table:
        coder = byte_encoder(path)
        t = leaves_of_one.sort_by("leaf")
        parts = [(np.frombuffer(i, "<u4"), inner) for i, inner in zip(t["ids"].to_pylist(), t["inner"].to_pylist(), strict=True)]
        return pa.table({"doc_id": t["doc_id"].slice(0, 1), "ids": pa.array([join_tree(coder, parts).tobytes()], pa.binary())})

    fits = F.octet_length("text") <= long_bytes
    spread = (
        rows.withColumn("row", F.monotonically_increasing_id())
        .filter(~fits)
        .mapInArrow(halved, "doc_id long, row long, leaf int, text string, raw boolean, inner boolean")
        .repartition("row", "leaf")
        .mapInArrow(coded, "doc_id long, row long, leaf int, inner boolean, ids binary")
    )
    long = spread.groupBy("row").applyInArrow(joined, "doc_id long, ids binary")
    return rows.filter(fits).mapInArrow(short, "doc_id long, ids binary").unionByName(long)


def decode(encoded: DataFrame, path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """``encoded`` with the text of its ids (special tokens kept) in ``text_col``; null ids give null."""
    columns = [c for c in encoded.columns if c != text_col]
    at = columns.index(ids_col)

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = byte_encoder(path)
        for b in batches:
            out = [None if i is None else coder.decode(np.frombuffer(i, "<u4").tolist()) for i in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.string())], [*columns, text_col])

    kept = encoded.select(*columns)
    return kept.mapInArrow(decoded, StructType([*kept.schema.fields, StructField(text_col, StringType())]))
