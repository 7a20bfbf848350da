"""Cross-tokenizer alignment: which tokens of two vocabularies cover the same bytes, and how often they do.

Both tokenizers cut the same bytes (a space and the text). The tokens of either side are the nodes of a bipartite graph
with an edge where byte ranges overlap; a union-find over it gives the connected components, which are exactly the
smallest groups of tokens that end together on both sides. Each group's members are then expanded into its links, all
its overlapping pairs. How many links hold a pair of ids is counted over the whole corpus:

1. One map-only scan encodes, aligns and writes one row per document: sizes, groups, and its distinct pairs with their
   number. Both encoders run once.
2. Pair counts are summed in the tasks first, then by a shuffle of distinct pairs; the highest count of each B id comes
   from a window that no key can fill with more rows than the A vocabulary has ids.
3. The most counted pairs (``HEAVY`` at most, a fixed bound) are shipped to all tasks, which add up their share of a
   document where its row lies. Only rows of other pairs are shuffled to their counts, and back as one sum a document;
   a pair that isn't shipped holds less than 1 / ``HEAVY`` of all links.

Edge cases: texts null, empty or not given back byte for byte by both sides have no tokens (zeros, no groups); special
token strings are ordinary text; texts of any length are aligned whole; rows that repeat a doc_id are judged one by one;
an empty table gives an empty result; other columns are never read. Ties of the highest count all count as best.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from agroloom.llm.common import texts, written
from agroloom.llm.tokenization import byte_encoder, piece_encoder

#: Most pairs that are shipped to every task; texts aligned together; distinct pairs that a task sums up before it lets go.
HEAVY, ROWS_AT_ONCE, HELD = 1 << 18, 128, 1 << 20
#: A pair of ids as one number: the A id above this bit, the B id below.
B_BITS = 32


def union_find(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The smallest member of each node's component, of ``n`` nodes with edges left-right."""
    parent = np.arange(n)
    while True:
        a, b = parent[left], parent[right]
        apart = a != b
        if not apart.any():
            return parent
        np.minimum.at(parent, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while True:
            above = parent[parent]
            if np.array_equal(above, parent):
                break
            parent = above


def components(a_end: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Component of each A and each B token (the first A token of it); ends are byte offsets over the same bytes.

    Every token has an edge to the first one of the other side that overlaps it; that connects all that overlap.
    """
    n, m = len(a_end), len(b_end)
    first_b = np.searchsorted(b_end, np.concatenate([[0], a_end[:-1]]), "right")
    first_a = np.searchsorted(a_end, np.concatenate([[0], b_end[:-1]]), "right")
    nodes = union_find(n + m, np.concatenate([np.arange(n), first_a]), np.concatenate([n + first_b, n + np.arange(m)]))
    return nodes[:n], nodes[n:]


def links(a_end: np.ndarray, b_end: np.ndarray, of_a: np.ndarray, of_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions (A, B) of all overlapping pairs, expanded from the members of each component."""
    heads = np.flatnonzero(of_a == np.arange(len(of_a)))
    size_a = np.diff(np.append(heads, len(of_a)))
    at_b = np.searchsorted(of_b, heads)
    size_b = np.diff(np.append(at_b, len(of_b)))
    # all pairs of members of groups with one token on a side; in others those whose ranges overlap
    low, high = np.repeat(at_b, size_a), np.repeat(at_b + size_b, size_a)
    several = np.flatnonzero(np.repeat((size_a > 1) & (size_b > 1), size_a))
    start = np.concatenate([[0], a_end[:-1]])[several]
    low[several] = np.searchsorted(b_end, start, "right")
    high[several] = np.searchsorted(b_end, a_end[several], "left") + 1
    n = high - low
    a = np.repeat(np.arange(len(a_end)), n)
    return a, np.repeat(low, n) + np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n)


def written_groups(a: np.ndarray, b: np.ndarray, of_a: np.ndarray, of_b: np.ndarray, words: np.ndarray) -> list[str]:
    """The row of words that spells all groups: members of A by commas, a bar, members of B by commas, a semicolon.

    ``words`` holds four texts for each id: with a comma, a bar, a comma, a semicolon after it.
    """
    before = np.searchsorted(of_b, of_a)  # B tokens of earlier groups
    upto = np.searchsorted(of_a, of_b, "right")  # A tokens of this and earlier groups
    out = np.empty(len(a) + len(b), np.int64)
    out[np.arange(len(a)) + before] = 4 * a + np.append(of_a[1:] != of_a[:-1], True)
    out[np.arange(len(b)) + upto] = 4 * b + 2 + np.append(of_b[1:] != of_b[:-1], True)
    return words[out].tolist()


SCHEMA = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<long>, times array<int>"


def align(docs: DataFrame, byte_path: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, groups (``a1,a2|b1;a3|b2,b3``), its distinct pairs
    (A id above bit 32, B id below) in ascending order, and how many links hold each."""

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = byte_encoder(byte_path), piece_encoder(piece_path)
        len_a, len_b = (np.array([len(x) for x in t], np.int64) for t in (one.table, two.raw))
        words = np.array([f"{i}{c}" for i in range(max(len(len_a), len(len_b))) for c in ",|,;"], object)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS_AT_ONCE):
                part = whole.slice(at, ROWS_AT_ONCE)
                ids_a, ids_b, rows = [], [], part.column(1).to_pylist()
                for text, b in zip(rows, two.encode(rows), strict=True):
                    raw = b" " + text.encode()
                    a = one.plain(" " + text) if text else ()
                    if len(a) and one.bytes_of(a.tolist()) == raw and b"".join(map(two.raw.__getitem__, b.tolist())) == raw:
                        ids_a.append(a.astype(np.int64))
                        ids_b.append(b.astype(np.int64))
                    else:
                        ids_a.append(np.zeros(0, np.int64))
                        ids_b.append(np.zeros(0, np.int64))
                yield row_batch(part.column(0), ids_a, ids_b, len_a, len_b, words)

    return texts(docs, id_col, text_col).mapInArrow(aligned, SCHEMA)


def row_batch(doc_ids: pa.Array, ids_a: list[np.ndarray], ids_b: list[np.ndarray], len_a: np.ndarray, len_b: np.ndarray, words: np.ndarray) -> pa.RecordBatch:
    """The rows of :func:`align` of some texts, all of them laid end to end: texts end on both sides, so no group spans two."""
    docs = len(ids_a)
    n_a, n_b = (np.array([len(x) for x in ids], np.int64) for ids in (ids_a, ids_b))
    a, b = np.concatenate(ids_a), np.concatenate(ids_b)
    doc_a = np.repeat(np.arange(docs), n_a)
    a_end, b_end = np.cumsum(len_a[a]), np.cumsum(len_b[b])
    of_a, of_b = components(a_end, b_end)
    n_groups = np.bincount(doc_a[of_a == np.arange(len(a))], minlength=docs)
    link_a, link_b = links(a_end, b_end, of_a, of_b)
    doc_link = doc_a[link_a]
    spelled = written_groups(a, b, of_a, of_b, words)
    stops = np.cumsum(n_a + n_b)
    groups = ["".join(spelled[s - n : s]).rstrip(";") for s, n in zip(stops.tolist(), (n_a + n_b).tolist(), strict=True)]
    pair = (a[link_a] << B_BITS) | b[link_b]
    order = np.lexsort((pair, doc_link))
    pair, doc_link = pair[order], doc_link[order]
    new = np.append(True, (pair[1:] != pair[:-1]) | (doc_link[1:] != doc_link[:-1]))[: len(pair)]
    starts = np.flatnonzero(new)
    offsets = pa.array(np.append(0, np.cumsum(np.bincount(doc_link[starts], minlength=docs))).astype(np.int32))
    times = np.diff(np.append(starts, len(pair))).astype(np.int32)
    n_links = np.bincount(doc_link, minlength=docs)
    return pa.RecordBatch.from_arrays(
        [doc_ids, *(pa.array(x.astype(np.int64)) for x in (n_a, n_b, n_groups, n_links)), pa.array(groups, pa.string()), pa.ListArray.from_arrays(offsets, pa.array(pair[starts])), pa.ListArray.from_arrays(offsets, pa.array(times))],
        [c.split()[0] for c in SCHEMA.split(", ")],
    )


def flat(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, n, best): links of the corpus that hold each pair, and whether no pair of the same B id has more."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_pairs, held = np.zeros(0, np.int64), np.zeros(0, np.int64)
        row = lambda p, n: pa.RecordBatch.from_arrays([pa.array(p), pa.array(n)], ["pair", "n"])
        for b in batches:
            pairs, at = np.unique(np.concatenate([held_pairs, flat(b.column(0))]), return_inverse=True)
            held = np.bincount(at, np.concatenate([held, flat(b.column(1))]), len(pairs)).astype(np.int64)
            held_pairs = pairs
            if len(held) > HELD:
                yield row(held_pairs, held)
                held_pairs, held = np.zeros(0, np.int64), np.zeros(0, np.int64)
        yield row(held_pairs, held)

    counts = aligned.select("pairs", "times").mapInArrow(summed, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    of_b = Window.partitionBy(F.col("pair").bitwiseAND(F.lit((1 << B_BITS) - 1)))
    return counts.withColumn("best", F.col("n") == F.max("n").over(of_b))


def scored(aligned: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """``aligned`` without its pairs, with n_best (links whose pair is counted most of all pairs of its B id) and
    count_sum (counts of the pairs of all links, added up)."""
    keep = [c for c in aligned.columns if c not in ("pairs", "times")]
    table = written(aligned.withColumn("_row", F.monotonically_increasing_id()), "aligned")
    counts = written(pair_counts(table), "pairs")
    top = counts.orderBy(F.desc("n"), "pair").limit(heavy).toArrow()  # at most ``heavy`` rows
    order = np.argsort(top["pair"].to_numpy())
    known, n, best = (top[c].to_numpy()[order] for c in ("pair", "n", "best"))

    def shared(batches: Iterator[pa.RecordBatch], rest: bool) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pairs, times = flat(b.column(1)), flat(b.column(2)).astype(np.int64)
            row = np.repeat(np.arange(b.num_rows), np.diff(b.column(1).offsets.to_numpy()))
            at = np.minimum(np.searchsorted(known, pairs), max(len(known) - 1, 0))
            there = known[at] == pairs if len(known) else np.zeros(len(pairs), bool)
            if rest:
                far = pa.array(~there)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)).filter(far), pa.array(pairs).filter(far), pa.array(times).filter(far)], ["_row", "pair", "times"])
            else:
                at, row, times = at[there], row[there], times[there]
                sums = np.zeros(b.num_rows, np.int64)
                np.add.at(sums, row, times * n[at])
                bests = np.zeros(b.num_rows, np.int64)
                np.add.at(bests, row, times * best[at])
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(bests), pa.array(sums), *b.columns[3:]], ["_row", "n_best", "count_sum", *keep])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in table.select(*keep).schema.fields)
    near = table.select("_row", "pairs", "times", *keep).mapInArrow(lambda bs: shared(bs, False), f"_row long, n_best long, count_sum long, {kinds}")
    far = table.select("_row", "pairs", "times").mapInArrow(lambda bs: shared(bs, True), "_row long, pair long, times long")
    added = far.join(counts, "pair").groupBy("_row").agg(F.sum(F.col("times") * F.col("n")).alias("_sum"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("_best"))
    both = near.join(added, "_row", "left")
    return both.select(*keep, (F.col("n_best") + F.coalesce("_best", F.lit(0))).alias("n_best"), (F.col("count_sum") + F.coalesce("_sum", F.lit(0))).alias("count_sum"))
