"""Hierarchical multi-length packing of token streams.

Each document is its ids and an end id. Full windows of 4096 ids become sequences of their own; what is left is
routed to the smallest tier (context size, a power of two) that holds it. From the longest tier down, each rest opens
a window of its tier, and the gap is filled from the shorter tiers: whole rests while they fit, then one cut to size.
So every window but the last of a block is full. That last one is split into powers of two, which need no padding.
Sequences are then sorted by length and dealt into step groups of equal token counts; as lengths are powers of two in
falling order, groups fill exactly.

Packing is done inside each scan task, over blocks of about ``block_tokens`` ids in the order of the rows: no shuffle,
bounded memory, and a re-run of a lost task gives the same sequences.

Edge cases: null text counts as empty, and an empty text still has its end id; rows that repeat a doc_id are packed one
by one; an empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from agroloom.llm.common import texts
from agroloom.llm.tokenization import word_encoder

#: Context sizes, longest first.
TIERS = (4096, 2048, 1024, 512)
END_ID = 2
BLOCK_TOKENS = 1 << 20
STEP_TOKENS = 1 << 17

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, sequence_length int, step_id long"

#: (document, its ids before this piece, ids)
Piece = tuple[int, int, int]


def pack_block(lengths: list[int], tiers: tuple[int, ...] = TIERS) -> list[list[Piece]]:
    """Sequences, each a list of pieces, of documents of these lengths; every length of a sequence is a power of two."""
    top = tiers[0]
    out: list[list[Piece]] = []
    pools: dict[int, list[Piece]] = {t: [] for t in tiers}

    def route(piece: Piece) -> None:
        pools[next(t for t in reversed(tiers) if piece[2] <= t)].append(piece)

    for doc, n in enumerate(lengths):
        full = n // top
        out += [[(doc, i * top, top)] for i in range(full)]
        if n % top:
            route((doc, full * top, n % top))
    for k, tier in enumerate(tiers):
        below = tiers[k + 1 :]
        while pools[tier]:
            first = pools[tier].pop()
            row, gap = [first], tier - first[2]
            while gap:
                source = next((t for t in below if pools[t] and pools[t][-1][2] <= gap), None)
                source = source or next((t for t in (*below, tier) if pools[t]), None)
                if source is None:
                    break
                doc, start, n = pools[source].pop()
                take = min(n, gap)
                row.append((doc, start, take))
                gap -= take
                if take < n:
                    route((doc, start + take, n - take))
            out += [row] if not gap else powers_of_two(row)
    return out


def powers_of_two(row: list[Piece]) -> list[list[Piece]]:
    """A sequence that isn't full, cut into sequences whose lengths are powers of two, longest first."""
    left, out = sum(p[2] for p in row), []
    pieces = iter(row)
    doc, start, n = next(pieces)
    while left:
        want = 1 << (left.bit_length() - 1)
        left -= want
        cut: list[Piece] = []
        while want:
            if not n:
                doc, start, n = next(pieces)
            take = min(n, want)
            cut.append((doc, start, take))
            start, n, want = start + take, n - take, want - take
        out.append(cut)
    return out


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", tiers: tuple[int, ...] = TIERS, block_tokens: int = BLOCK_TOKENS, step_tokens: int = STEP_TOKENS) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset,
    sequence_length (a power of two), step_id (groups of ``step_tokens`` ids, the last of a block apart)."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = word_encoder(path)
        end = np.array([END_ID], "<u4")
        base = TaskContext.get().partitionId() << 33
        sequences = steps = 0
        names: list[int | None] = []
        ids: list[np.ndarray] = []
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal sequences, steps, held
            rows: list[tuple] = []
            done = 0
            for pieces in sorted(pack_block([len(x) for x in ids], tiers), key=lambda s: -sum(p[2] for p in s)):
                size = sum(p[2] for p in pieces)
                offset = 0
                for doc, start, n in pieces:
                    rows.append((names[doc], start, n, ids[doc][start : start + n].tobytes(), len(ids[doc]), base + sequences, offset, size, base + steps + done // step_tokens))
                    offset += n
                sequences += 1
                done += size
            steps += -(-done // step_tokens)
            names.clear()
            ids.clear()
            held = 0
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            columns = zip(*rows, strict=True) if rows else [[] for _ in kinds]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [c.split()[0] for c in SCHEMA.split(", ")])

        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    names.append(doc)
                    ids.append(np.concatenate([coder.encode(text), end]))
                    held += len(ids[-1])
                    if held >= block_tokens:
                        yield from flush()
        if ids:
            yield from flush()

    return texts(docs, id_col, text_col).mapInArrow(packed, SCHEMA)
