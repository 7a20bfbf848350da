"""Merkle manifest of a dataset: a tree of SHA-256 digests per source, a tree over the sources, and proofs by row.

A leaf is the digest of a row's columns. Nodes are 64 lower-case hex characters; up to ``FANOUT`` neighbours become the
digest of their concatenation, level by level, until one node of the source is left; the nodes of all sources, in order
of the source, make a tree of the same kind.

1. One scan makes the leaves (in the JVM); only narrow rows go on.
2. :func:`agroloom.operators.numbering.number_by_range` gives every leaf its position within its source, so that no
   source meets in one task.
3. Aligned blocks of ``FANOUT ** LEVELS`` neighbours are grouped. A block holds its digests as contiguous numpy
   matrices: 64-byte rows are reshaped by the fanout and hashed level by level, and siblings are found by index
   arithmetic. Its top is a node of the next round, whose positions are the block numbers: rounds go on until each
   source has one node (three rounds for ten thousand million rows of one source), then over the sources.
4. The way up from each block is joined to the block, and one map-only pass gives every row its proof and checks it.

Edge cases: a null column is ``-`` in its leaf (so null and empty differ); a null source comes first, a null doc_id comes
first in its source and its row is never altered; rows that repeat source and doc_id are ordered by leaf; texts of any
length are hashed whole; a lone leaf is its source's node and a lone source's node the root; an empty table gives no
rows; other columns are never read.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agroloom.llm.common import written
from agroloom.operators.numbering import number_by_range

#: Nodes of a run, and levels of a block (2,187 leaves).
FANOUT, LEVELS = 3, 7
#: The columns of a leaf, in order.
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(raw: bytes) -> bytes:
    return hashlib.sha256(raw).hexdigest().encode()


def spelled(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(columns: list[Column]) -> Column:
    """Digest (32 bytes) of a row."""
    return F.unhex(F.sha2(F.concat(*(spelled(c) for c in columns)), 256))


def without_lines(docs: DataFrame) -> tuple[Column, Column]:
    """(which rows, their text): line ends deleted from rows whose doc_id has an even CRC-32; null ids never count."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.lit(False)), F.replace(F.col("text"), F.lit("\n"), F.lit(""))


def leaves(docs: DataFrame, altered: tuple[Column, Column] | None = None) -> DataFrame:
    """(src, doc_id, leaf, other): ``src`` sorts like the source, null first, and is never null; ``other`` is the leaf
    that an altered row has, null for rows that aren't ``altered`` (which rows, their text)."""
    as_is = [F.col(c) for c in COLUMNS]
    which, text = altered or (F.lit(False), F.col("text"))
    other = F.when(which, leaf([text if c == "text" else F.col(c) for c in COLUMNS]))
    return docs.select(F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("src"), F.col("doc_id").cast("long").alias("doc_id"), leaf(as_is).alias("leaf"), other.alias("other"))


def depth(n: int, fanout: int = FANOUT) -> int:
    """Levels above ``n`` nodes until one is left."""
    d = 0
    while n > 1:
        n, d = -(-n // fanout), d + 1
    return d


def matrix(rows: list[bytes]) -> np.ndarray:
    """Hex digests as rows of 64 bytes."""
    return np.frombuffer(b"".join(rows), np.uint8).reshape(-1, 64)


def hex_rows(raw: list[bytes]) -> np.ndarray:
    """Digests of 32 bytes as rows of 64 hex bytes."""
    return np.frombuffer(b"".join(raw).hex().encode(), np.uint8).reshape(-1, 64)


def climbed(nodes: np.ndarray, levels: int, fanout: int = FANOUT) -> list[np.ndarray]:
    """``nodes`` and the digests of each of ``levels`` levels above them."""
    out = [nodes]
    for _ in range(levels):
        m = out[-1]
        full = len(m) // fanout
        rows = [digest(r.tobytes()) for r in np.ascontiguousarray(m[: full * fanout]).reshape(full, fanout * 64)]
        if full * fanout < len(m):
            rows.append(digest(m[full * fanout :].tobytes()))
        out.append(matrix(rows))
    return out


def siblings(levels: list[np.ndarray], fanout: int = FANOUT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each node of the lowest level, on every level below the top: the digests of its run (node, level, slot, 64),
    which slots hold a sibling, and the slot of the node itself."""
    n, steps = len(levels[0]), len(levels) - 1
    runs = np.zeros((n, steps, fanout, 64), np.uint8)
    there, own = np.zeros((n, steps, fanout), bool), np.zeros((n, steps), np.int64)
    for j, m in enumerate(levels[:-1]):
        at = np.arange(n) // fanout**j
        slots = (at // fanout * fanout)[:, None] + np.arange(fanout)
        inside = slots < len(m)
        runs[:, j] = m[np.minimum(slots, len(m) - 1)]
        there[:, j] = inside & (slots != at[:, None])
        own[:, j] = at % fanout
    return runs, there, own


def folded(node: bytes, left: list[bytes], right: list[bytes]) -> bytes:
    """The digest that ``node`` leads to by its siblings of each level."""
    for a, b in zip(left, right, strict=True):
        node = digest(a + node + b)
    return node


def sides(runs: np.ndarray, there: np.ndarray, own: np.ndarray) -> tuple[list[bytes], list[bytes]]:
    """Siblings to the left and to the right of one node, level by level."""
    left = [runs[j, : own[j]].tobytes() for j in range(len(own))]
    right = [runs[j, own[j] + 1 :][there[j, own[j] + 1 :]].tobytes() for j in range(len(own))]
    return left, right


def blocks(numbered: DataFrame, levels: int = LEVELS) -> DataFrame:
    """(src, block, n, ids, leaves, others, top): one row for each aligned block of leaves (src, doc_id, leaf, other, at, n)."""

    def gathered(t: pa.Table) -> pa.Table:
        t = t.sort_by("at")
        raw, n = t["leaf"].to_pylist(), t["n"][0].as_py()
        top = climbed(hex_rows(raw), min(depth(n), levels))[-1]
        others = [b if x is None else x for x, b in zip(t["other"].to_pylist(), raw, strict=True)]
        one = lambda x, kind: pa.array([x], kind)
        return pa.table({"src": t["src"].slice(0, 1), "block": t["block"].slice(0, 1), "n": t["n"].slice(0, 1), "ids": one(t["doc_id"].to_pylist(), pa.list_(pa.int64())), "leaves": one(b"".join(raw), pa.binary()), "others": one(b"".join(others), pa.binary()), "top": one(top.tobytes(), pa.binary())})

    size = F.lit(FANOUT**levels)
    rows = numbered.withColumn("block", F.floor(F.col("at") / size)).select("src", "block", "at", "n", "doc_id", "leaf", "other")
    return rows.groupBy("src", "block").applyInArrow(gathered, "src string, block long, n long, ids array<long>, leaves binary, others binary, top binary")


def climb(nodes: DataFrame, levels: int = LEVELS) -> DataFrame:
    """(src, at, up, lefts, rights, n, top): siblings of each node (src, at, n, digest) within its aligned block ``up``;
    ``n`` blocks of the source; the block's ``top`` stands in the row of its first node, else null."""

    def gathered(t: pa.Table) -> pa.Table:
        t = t.sort_by("at")
        rows = climbed(matrix(t["digest"].to_pylist()), min(depth(t["n"][0].as_py()), levels))
        runs, there, own = siblings(rows)
        lefts, rights = zip(*(sides(runs[i], there[i], own[i]) for i in range(t.num_rows)), strict=True)
        n = -(-t["n"][0].as_py() // FANOUT**levels)
        kind = pa.list_(pa.binary())
        return pa.table({"src": t["src"], "at": t["at"], "up": t["up"], "lefts": pa.array(lefts, kind), "rights": pa.array(rights, kind), "n": pa.array([n] * t.num_rows, pa.int64()), "top": pa.array([rows[-1].tobytes()] + [None] * (t.num_rows - 1), pa.binary())})

    rows = nodes.withColumn("up", F.floor(F.col("at") / F.lit(FANOUT**levels))).select("src", "at", "up", "n", "digest")
    return rows.groupBy("src", "up").applyInArrow(gathered, "src string, at long, up long, lefts array<binary>, rights array<binary>, n long, top binary")


def ways_up(nodes: DataFrame, levels: int = LEVELS) -> tuple[DataFrame, DataFrame]:
    """Ways (src, at, lefts, rights) from each node (src, at, n, digest) to the single node of its ``src``, and these
    (src, top). A round for every ``levels`` levels; the driver sees one number a round."""
    rounds = []
    while True:
        rounds.append(written(climb(nodes, levels), "climb"))
        tops = rounds[-1].filter("top IS NOT NULL")
        nodes = tops.select("src", F.col("up").alias("at"), "n", F.col("top").alias("digest"))
        if (tops.agg(F.max("n")).first()[0] or 1) <= 1:
            break
    ways = rounds.pop().select("src", "at", "lefts", "rights")
    while rounds:
        above = ways.select("src", F.col("at").alias("up"), F.col("lefts").alias("_l"), F.col("rights").alias("_r"))
        ways = rounds.pop().join(above, ["src", "up"]).select("src", "at", F.concat("lefts", "_l").alias("lefts"), F.concat("rights", "_r").alias("rights"))
    return ways, nodes.select("src", F.col("digest").alias("top"))


PROVED = "doc_id long, leaf string, subroot string, root string, proof string, folded_root string, verified boolean"


def manifest(docs: DataFrame, altered: tuple[Column, Column] | None = None, levels: int = LEVELS) -> DataFrame:
    """One row per row of ``docs``: doc_id, leaf, subroot (its source's node), root, proof (its siblings' digests, level
    by level up to the root, left to right), folded_root (the root that the row, as ``altered``, leads to by its
    siblings) and verified (whether that is the root)."""
    numbered = number_by_range(written(leaves(docs, altered), "leaves"), ["doc_id", "leaf", "other"], ("src",), "at", "n")
    held = written(blocks(numbered, levels), "blocks")
    ways, subroots = ways_up(held.select("src", F.col("block").alias("at"), F.ceil(F.col("n") / F.lit(FANOUT**levels)).alias("n"), F.col("top").alias("digest")), levels)
    ordered = written(number_by_range(subroots, ["src"], (), "at", "n"), "subroots")
    top_ways, roots = ways_up(ordered.select(F.lit("").alias("src"), "at", "n", F.col("top").alias("digest")), levels)
    found = roots.first()
    root = bytes(found.top) if found else b""
    sources = ordered.join(top_ways.select("at", F.col("lefts").alias("_l"), F.col("rights").alias("_r")), "at").select("src", F.col("top").alias("subroot"), "_l", "_r")
    whole = ways.join(sources, "src").select("src", F.col("at").alias("block"), "subroot", F.concat("lefts", "_l").alias("lefts"), F.concat("rights", "_r").alias("rights"))

    def proved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, n, own, others, subroot, lefts, rights in zip(*(b.column(i).to_pylist() for i in range(7)), strict=True):
                yield block_rows(ids, n, own, others, subroot, lefts, rights, root, levels)

    rows = held.join(whole, ["src", "block"]).select("ids", "n", "leaves", "others", "subroot", "lefts", "rights")
    return rows.mapInArrow(proved, PROVED)


def block_rows(ids: list[int | None], n: int, own: bytes, others: bytes, subroot: bytes, lefts: list[bytes], rights: list[bytes], root: bytes, levels: int = LEVELS) -> pa.RecordBatch:
    """The rows of :func:`manifest` of one block of leaves, given the way from its top to the root."""
    m = len(ids)
    first, second = hex_rows([own]), hex_rows([others])
    runs, there, slot = siblings(climbed(first, min(depth(n), levels)))
    beyond = b"".join(a + b for a, b in zip(lefts, rights, strict=True))
    proofs = [(runs[i][there[i]].tobytes() + beyond).decode() for i in range(m)]

    @functools.cache  # most rows of a block reach the same top
    def from_top(top: bytes) -> bytes:
        return folded(top, lefts, rights)

    ends = [from_top(folded(second[i].tobytes(), *sides(runs[i], there[i], slot[i]))) for i in range(m)]
    texts = [pa.array(x, pa.string()) for x in ([r.tobytes().decode() for r in first], [subroot.decode()] * m, [root.decode()] * m, proofs, [e.decode() for e in ends])]
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *texts, pa.array([e == root for e in ends])], [c.split()[0] for c in PROVED.split(", ")])
