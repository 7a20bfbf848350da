"""Removal of repeated passages by run-length positional Burrows-Wheeler indexes.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts earlier: in a smaller doc_id, or earlier in the
same document. One suffix array or Burrows-Wheeler transform of the whole corpus would live on one machine, so the
index is built piece by piece where repeats meet:

1. Every window of 100 bytes has an anchor, the smallest k-mer hash in it; equal windows have equal anchors at equal
   places. Neighbouring windows share an anchor, so there are about 2 / (WINDOW + 1) anchors a byte. The bytes of all
   windows of an anchor are its context. Anchors are shuffled by hash with a hash of their context.
2. A k-mer that occurs once is done: none of its windows repeats. Of equal contexts all but the earliest repeat as a
   whole. Only where an anchor has several different contexts is their text needed, of one occurrence each; those are
   joined back to their texts.
3. These contexts are dealt by anchor. A task aligns them at the anchor and builds the positional Burrows-Wheeler
   transform, column by column, with the lengths of matches between neighbours (matching statistics). Rows whose last
   100 columns match are a run; the earliest row of a run is kept as its sample, and every other row's window is a
   repeat.
4. Repeated windows become byte ranges by document, which are joined to the texts to cut them.

Memory is bounded by a block of contexts in step 3. The texts are shuffled by row once; both joins read that shuffle.

Edge cases: null text counts as empty; texts under 100 bytes keep all; rows that repeat a doc_id are told apart by their
place in the scan, which decides which one comes first; a null doc_id comes before all others; an empty table gives an
empty result; other columns are never read. Contexts are taken as equal by 64 bits of their k-mer and 64 of their own
bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from agroloom.llm.common import texts, utf8, written

#: Bytes of a repeat, of a k-mer, and k-mers in a window of LENGTH bytes.
LENGTH, KMER = 100, 28
WINDOW = LENGTH - KMER + 1
#: Windows of a text that are hashed at a time, and contexts that are indexed at a time.
SEGMENT, BLOCK = 1 << 18, 1 << 16

U = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
BYTE = np.random.default_rng(20).integers(0, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)


def power(n: int) -> np.uint64:
    return U(pow(BASE, n, 1 << 64))


def kmer_hashes(raw: np.ndarray) -> np.ndarray:
    """Hash of every KMER bytes, from hashes of 1, 2, 4, 8, 16 bytes."""
    h = {1: BYTE[raw]}
    for n in (1, 2, 4, 8):
        h[2 * n] = h[n][:-n] * power(n) + h[n][n:]
    count = len(raw) - KMER + 1
    total = h[16][:count] * power(8) + h[8][16 : 16 + count]
    total = total * power(4) + h[4][24 : 24 + count]
    total = (total ^ (total >> U(29))) * U(0xD6E8FEB86659FD93)
    return total ^ (total >> U(32))


POWERS = np.cumprod(np.append(U(1), np.full(SEGMENT + LENGTH, U(BASE))))
INVERSES = np.cumprod(np.append(U(1), np.full(SEGMENT + LENGTH, U(pow(BASE, -1, 1 << 64)))))


def anchors(raw: np.ndarray) -> tuple[np.ndarray, ...]:
    """(k-mer hash, context hash, anchor place, first window, last window) of each run of windows with one anchor."""
    found = []
    for at in range(0, max(len(raw) - LENGTH + 1, 0), SEGMENT):
        part = raw[at : at + SEGMENT + LENGTH - 1]
        h = kmer_hashes(part)
        low = (h & ~U((1 << 20) - 1)) | np.arange(len(h), dtype=U)
        for n in (1, 2, 4, 8, 16, 32):
            low = np.minimum(low[:-n], low[n:])
        low = np.minimum(low[: len(low) - (WINDOW - 64)], low[WINDOW - 64 :])  # the smallest of WINDOW, leftmost of equals
        place = (low & U((1 << 20) - 1)).astype(np.int64)
        first = np.flatnonzero(np.diff(place, prepend=-1))
        last = np.append(first[1:], len(place)) - 1
        place = place[first]
        sums = np.append(U(0), np.cumsum(BYTE[part] * POWERS[: len(part)]))
        context = (sums[last + LENGTH] - sums[first]) * INVERSES[first] + (((place - first) << 8) | (last - first)).view(U) * U(0xD6E8FEB86659FD93)
        context = (context ^ (context >> U(31))) * U(BASE)
        found.append((h[place].view(np.int64), (context ^ (context >> U(29))).view(np.int64), place + at, first + at, last + at))
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def later_copies(h: np.ndarray, context: np.ndarray, docs: np.ndarray, rows: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which anchors have an earlier one of the same hash and context among these."""
    order = np.lexsort((at, rows, docs, context, h))
    same = (h[order][1:] == h[order][:-1]) & (context[order][1:] == context[order][:-1])
    out = np.zeros(len(h), bool)
    out[order[1:][same]] = True
    return out


def anchor_table(rows: DataFrame) -> DataFrame:
    """(key, h, context, doc_id, row, at, copy) of every anchor; at holds its place and its windows in one number.

    An anchor with an equal context earlier in the same block of texts is a copy already; it needs no comparison, so its
    key is spread at random. A line that every document repeats meets in one task only once a block.
    """

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 512):
                b = whole.slice(start, 512)
                parts = []
                for i, text in enumerate(utf8(b.column(1))):
                    if len(text) >= LENGTH:
                        h, context, place, first, last = anchors(np.frombuffer(text, np.uint8))
                        parts.append((h, context, np.full(len(h), i), (place << 16) | ((place - first) << 8) | (last - first)))
                if parts:
                    h, context, who, at = (np.concatenate(x) for x in zip(*parts, strict=True))
                    docs, names = (np.asarray(b.column(c).fill_null(-(1 << 63))) for c in (0, 2))
                    copy = later_copies(h, context, docs[who], names[who], at)
                    key = np.where(copy, (h ^ (names[who] * 0x9E3779B1) ^ (at << 7)), h)
                    who = pa.array(who)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key), pa.array(h), pa.array(context), b.column(0).take(who), b.column(2).take(who), pa.array(at), pa.array(copy)], ["key", "h", "context", "doc_id", "row", "at", "copy"]
                    )

    return rows.select("doc_id", "text", "row").mapInArrow(made, "key long, h long, context long, doc_id long, row long, at long, copy boolean")


def compared(table: DataFrame) -> DataFrame:
    """(h, row, at, copy) of anchors that repeat: copy, if an equal context is earlier; else the earliest of its context,
    where the anchor has others."""
    several = Window.partitionBy("key")
    same = Window.partitionBy("key", "context")
    place = F.struct("doc_id", "row", "at")
    live = lambda c: F.when(~F.col("copy"), F.col(c))
    many = table.withColumn("lo", F.min(live("context")).over(several)).withColumn("hi", F.max(live("context")).over(several)).withColumn("n", F.count("*").over(several)).filter("n > 1 OR copy")
    marked = many.withColumn("copy", F.col("copy") | (F.min(F.when(~F.col("copy"), place)).over(same) < place))
    return marked.filter("copy OR lo <> hi").select("h", "row", "at", "copy")


def context_table(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(h, doc_id, row, place, first, last, context) of the wanted anchors (h, row, at)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 1024):
                b = whole.slice(start, 1024)
                lists = b.column(3)
                sizes = np.diff(lists.offsets.to_numpy())
                flat = lists.flatten()
                at, h = flat.field("at").to_numpy(), flat.field("h").to_numpy()
                place, more = at >> 16, at & 255
                first = place - ((at >> 8) & 255)
                who = np.repeat(np.arange(b.num_rows), sizes)
                raws = utf8(b.column(2))
                held = [raws[i][s : s + n + LENGTH] for i, s, n in zip(who.tolist(), first.tolist(), more.tolist(), strict=True)]
                who = pa.array(who)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h), b.column(0).take(who), b.column(1).take(who), pa.array(place), pa.array(first), pa.array(first + more), pa.array(held, pa.binary())],
                    ["h", "doc_id", "row", "place", "first", "last", "context"],
                )

    lists = wanted.groupBy("row").agg(F.collect_list(F.struct("at", "h")).alias("anchors"))
    joined = rows.join(lists, "row").select("doc_id", "row", "text", "anchors")
    return joined.mapInArrow(cut, "h long, doc_id long, row long, place long, first long, last long, context binary")


def positional_runs(columns: np.ndarray, start: np.ndarray, windows: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Which windows repeat one of a smaller rank: a 0/1 matrix by row and window column.

    ``columns`` are rows of bytes aligned at their anchor; row r has windows at columns start[r] to start[r] +
    windows[r] - 1. The positional Burrows-Wheeler transform keeps the rows sorted by their bytes read backwards from
    the current column; ``since`` is the column from which a row matches the row before it.
    """
    n, width = columns.shape
    out = np.zeros((n, WINDOW), bool)
    order = np.arange(n)
    since = np.zeros(n + 1, np.int16)
    since[0] = width
    last = start + windows - 1
    high = np.iinfo(np.int64).max
    for j in range(width):
        symbols = columns[order, j]
        to = np.argsort(symbols, kind="stable")
        sorted_symbols = symbols[to]
        bounds = np.empty(2 * n, np.int64)
        bounds[0::2] = np.append(0, to[:-1] + 1)
        bounds[1::2] = to + 1
        # the longest break between neighbours of one symbol
        fresh = np.maximum.reduceat(since, bounds)[::2]
        fresh[0] = j + 1
        fresh[1:][sorted_symbols[1:] != sorted_symbols[:-1]] = j + 1
        since[:n] = fresh
        order = order[to]
        c = j - LENGTH + 1
        if c >= 0:
            valid = (start[order] <= c) & (c <= last[order])
            heads = np.flatnonzero(since[:n] > c)  # runs of equal windows begin here
            ranks = np.where(valid, rank[order], high)
            sample = np.repeat(np.minimum.reduceat(ranks, heads), np.diff(np.append(heads, n)))
            out[order, c] = valid & (ranks > sample)
    return out


def repeats(block: pa.Table) -> pa.Table:
    """(row, start, stop): byte ranges of repeated windows among the contexts of whole anchor groups."""
    docs, rows = block["doc_id"].to_pylist(), block["row"].to_numpy()
    place, first, last = (block[c].to_numpy() for c in ("place", "first", "last"))
    held = block["context"].to_pylist()
    key = np.array([-(1 << 63) if d is None else d for d in docs], np.int64)
    heads = np.lexsort((place, rows, key))
    width = WINDOW - 1 + LENGTH
    columns = np.zeros((len(heads), width), np.uint8)
    start = WINDOW - 1 - (place[heads] - first[heads])
    for r, i in enumerate(heads.tolist()):
        columns[r, start[r] : start[r] + len(held[i])] = np.frombuffer(held[i], np.uint8)
    windows = last[heads] - first[heads] + 1
    dup = positional_runs(columns, start, windows, np.arange(len(heads)))
    # maximal runs of repeated windows of each row
    edge = np.diff(np.pad(dup, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    r, a = np.nonzero(edge == 1)
    z = np.nonzero(edge == -1)[1]
    base = first[heads][r] - start[r]
    at = heads[r]
    return pa.table({"row": pa.array(rows[at], pa.int64()), "start": pa.array(base + a, pa.int64()), "stop": pa.array(base + z - 1 + LENGTH, pa.int64())})


def repeated_ranges(contexts: DataFrame) -> DataFrame:
    """(row, start, stop) of all repeated windows of contexts dealt and sorted by anchor."""

    def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for b in batches:
            t = pa.Table.from_batches([b])
            held = t if held is None else pa.concat_tables([held, t])
            if held.num_rows >= BLOCK:
                h = held["h"].to_numpy()
                whole = int(np.searchsorted(h, h[-1], side="left"))  # the last group may go on
                if whole:
                    yield from repeats(held.slice(0, whole)).to_batches()
                    held = held.slice(whole)
        if held is not None and held.num_rows:
            yield from repeats(held).to_batches()

    dealt = contexts.repartition("h").sortWithinPartitions("h")
    return dealt.mapInArrow(streamed, "row long, start long, stop long")


def removed_ranges(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(doc_id, row, text) of all documents, and (row, ranges): the byte ranges to remove, unmerged, of those that have any."""
    rows = texts(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id())
    found = written(compared(anchor_table(rows)), "anchors")
    ranges = repeated_ranges(context_table(rows, found.filter("NOT copy")))
    first = F.shiftright("at", 16) - F.shiftright("at", 8).bitwiseAND(F.lit(255))
    copies = found.filter("copy").select("row", first.alias("start"), (first + F.col("at").bitwiseAND(F.lit(255)) + LENGTH).alias("stop"))
    return rows, ranges.unionByName(copies).groupBy("row").agg(F.collect_list(F.struct("start", "stop")).alias("ranges"))


def merged(ranges: list[dict] | None) -> list[tuple[int, int]]:
    """Maximal runs of bytes that the ranges cover."""
    out: list[list[int]] = []
    for a, z in sorted((r["start"], r["stop"]) for r in ranges or []):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], z)
        else:
            out.append([a, z])
    return [(a, z) for a, z in out]


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, spans, kept) of each document: its removed byte spans and its remaining bytes."""
    rows, ranges = removed_ranges(docs, id_col, text_col)
    span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 1024):
                b = whole.slice(start, 1024)
                sizes, spans, kept = [], [], []
                for raw, found in zip(utf8(b.column(1)), b.column(2).to_pylist(), strict=True):
                    gone = merged(found)
                    edges = [0, *(x for s in gone for x in s), len(raw)]
                    sizes.append(len(raw))
                    spans.append([{"start": a, "stop": z} for a, z in gone])
                    kept.append(b"".join(raw[a:z] for a, z in zip(edges[::2], edges[1::2], strict=True)))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(spans, span), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])

    joined = rows.join(ranges, "row", "left").select("doc_id", "text", "ranges")
    return joined.mapInArrow(cut, "doc_id long, n_bytes long, spans array<struct<start:long,stop:long>>, kept binary")


