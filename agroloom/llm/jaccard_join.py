"""Exact n-gram Jaccard self-join by universe-partition pigeonhole, and its connected components.

A text's set holds its distinct word shingles as 64-bit hashes. Two sets x, y (x the smaller) with a Jaccard similarity
of at least J (85/100 unless told otherwise) differ in at most H = floor((1 - J) / J * |x|) elements.

1. Sizes fall into bands, each about 1.25 times as wide as the one before. A pair belongs to the band of its smaller
   set, so a set takes part in its own band and in that of the smallest partner it may have.
2. In a band the universe of hashes is partitioned into segments. A segment either demands identity (covers 1) or
   tolerates one difference by one-deletion neighbourhoods (covers 2); if the covers sum up to H + 1, any pair within
   H differences agrees in a segment. How many segments are of which kind is chosen by cost: rows to index against
   expected chance matches, from the number of sets in the band.
3. The index rows (hash of band, segment and the segment's subset) are shuffled by key. In each bucket every set is
   paired with the smallest one only, and these pairs are verified exactly: links, and components of them.
4. Buckets that still hold several components are compared across those, inside the task: parity sketches give lower
   bounds of the difference that rule out nearly all pairs. Of the pairs that are left only a spanning forest is emitted
   (fewer rows than the bucket has), so texts that may be linked lie in one group of these forests.
5. In each group the elements of its texts, sent there once, are compared exactly across components, and a spanning
   forest of the links is emitted, again fewer rows than texts. Large buckets and groups are compared block by block,
   over many tasks. No link between components is lost, and no group is expanded into all its pairs.

Groups of equal sets with more than n / 1025 rows are represented by their smallest doc_id: the (at most 1024) hashes
of such sets are broadcast, and other rows of the group are never indexed.

Edge cases: null text counts as empty; texts without words have an empty set and are linked with nothing; rows that
repeat a doc_id pool their links; rows with a null doc_id get no component; an empty table gives an empty result;
other columns are never read. Shingle hashes have 64 bits; sets of two texts are taken as equal by 128 bits.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from agroloom.llm.common import texts, unused, utf8, written
from agroloom.llm.graph import components

#: Words of a shingle; least similarity as a fraction (numerator, denominator).
WORDS, LEAST = 4, (85, 100)
#: Most groups of equal sets that are broadcast.
HEAVY = 1024
BAND_RATIO = 1.25
#: Cost of a chance match against that of an index row.
MATCH_COST = 0.3
#: Rows of a block when a large bucket or group is compared, and elements of a block of a group.
BLOCK, BLOCK_ELEMENTS = 2048, 1 << 22
#: Words whose hashes a task holds.
MEMO = 400_000

U = np.uint64


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mix."""
    x = (x ^ (x >> U(31))) * U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> U(29))) * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


class Shingler:
    """Texts to sorted arrays of distinct shingle hashes."""

    def __init__(self, words: int = WORDS):
        self.words = words
        self.held: dict[bytes, int] = {}
        self.factors = np.random.default_rng(words).integers(0, 1 << 63, words, dtype=U) * U(2) + U(1)  # unrelated odd numbers

    def __call__(self, text: bytes) -> np.ndarray:
        words = text.lower().split()  # bytes: A-Z alone is lowered, ASCII white space alone splits
        if not words:
            return np.zeros(0, U)
        held = self.held
        if len(held) > MEMO:
            held.clear()
        for w in set(words).difference(held):
            held[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(held.__getitem__, words), U, len(words))
        k = min(self.words, len(h))
        n = len(h) - k + 1
        total = h[:n] * self.factors[0] + U(k)
        for i in range(1, k):
            total += h[i : i + n] * self.factors[i]
        s = mixed(total)
        s.sort()
        return s[np.append(True, s[1:] != s[:-1])]


def set_digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def sketch(s: np.ndarray) -> bytes:
    """Parities of the elements over a power of two of places, at least as many as elements."""
    bits = max(64, 1 << int(len(s) - 1).bit_length()) if len(s) else 64
    return np.packbits((np.bincount((s & U(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()


def bands(top: int = 1 << 31) -> np.ndarray:
    """Smallest size of each band."""
    out = [1]
    while out[-1] < top:
        out.append(max(out[-1] + 1, int(out[-1] * BAND_RATIO)))
    return np.array(out, np.int64)


BANDS = bands()


def band_of(sizes) -> np.ndarray:
    return np.searchsorted(BANDS, sizes, side="right") - 1


def allocation(band: int, sets: int, least: tuple[int, int] = LEAST) -> tuple[int, int]:
    """(segments, those of them that tolerate one difference) of a band that ``sets`` sets take part in."""
    low, high = int(BANDS[band]), int(BANDS[band + 1]) - 1
    cover = (least[1] - least[0]) * high // least[0] + 1
    j = np.arange(cover // 2 + 1)
    segments = cover - j
    width = low / segments
    rows = (cover - 2 * j) + j * (1 + width)
    empty = np.exp(-np.minimum(2 * width, 60))
    chance = (cover - 2 * j) * empty + j * empty * (1 + 2 * width)
    best = int(np.argmin(sets * rows + MATCH_COST * sets * sets / 2 * chance))
    return int(segments[best]), best


def index_keys(s: np.ndarray, plan: dict[int, tuple[int, int]], least: tuple[int, int] = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """(keys, whether each stands for a whole subset) under which a set is indexed."""
    n = len(s)
    first, last = (int(b) for b in band_of([-(-least[0] * n // least[1]), n]))
    keys, whole = [], []
    high = s >> U(32)
    for band in range(first, last + 1):
        segments, tolerant = plan[band]
        segment = ((high * U(segments)) >> U(32)).astype(np.int64)
        sums = np.zeros(segments, U)
        np.add.at(sums, segment, s)
        tags = segment_tags(band, segments)
        keys.append(mixed(sums ^ tags))
        whole.append(np.ones(segments, bool))
        if tolerant:
            inside = segment < tolerant
            at = segment[inside]
            keys.append(mixed((sums[at] - s[inside]) ^ tags[at]))
            whole.append(np.zeros(len(at), bool))
    return np.concatenate(keys).view(np.int64), np.concatenate(whole)


@functools.lru_cache(maxsize=256)
def segment_tags(band: int, segments: int) -> np.ndarray:
    return mixed(np.arange(segments, dtype=U) + U((band + 1) << 32))


def allowed(n1, n2, least: tuple[int, int] = LEAST):
    """Most differing elements of linked sets of these sizes."""
    return (least[1] - least[0]) * (n1 + n2) // (least[1] + least[0])


def linked(a: np.ndarray, b: np.ndarray, least: tuple[int, int] = LEAST) -> bool:
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    both = int((b[np.minimum(at, len(b) - 1)] == a).sum()) if len(b) else 0
    return least[1] * both >= least[0] * (len(a) + len(b) - both) and both > 0


def set_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """(doc_id, n_shingles, digest, sketch) of each text."""

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler(words)
        for b in batches:
            sets = [shingles(t) for t in utf8(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([set_digest(s) for s in sets], pa.binary()), pa.array([sketch(s) for s in sets], pa.binary())], ["doc_id", "n_shingles", "digest", "sketch"])

    return texts(docs, id_col, text_col).mapInArrow(measured, "doc_id long, n_shingles long, digest binary, sketch binary")


def index_table(docs: DataFrame, plan: dict[int, tuple[int, int]], heavy: dict[bytes, int], id_col: str, text_col: str, words: int, least: tuple[int, int] = LEAST) -> DataFrame:
    """(key, doc, whole): index rows of every text that has words, one text for each heavy group."""

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler(words)
        for whole_batch in batches:
            for at in range(0, whole_batch.num_rows, 512):
                b = whole_batch.slice(at, 512)
                docs_, keys, whole = [], [], []
                for doc, text in zip(b.column(0).to_pylist(), utf8(b.column(1)), strict=True):
                    s = shingles(text)
                    if doc is None or not len(s) or heavy and heavy.get(set_digest(s), doc) != doc:
                        continue
                    k, w = index_keys(s, plan, least)
                    docs_.append(np.full(len(k), doc, np.int64))
                    keys.append(k)
                    whole.append(w)
                if keys:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(docs_)), pa.array(np.concatenate(whole))], ["key", "doc", "whole"])

    return texts(docs, id_col, text_col).mapInArrow(indexed, "key long, doc long, whole boolean")


def folded(mark: bytes, width: int) -> np.ndarray:
    """A sketch of ``width`` bytes: places are taken modulo a power of two, so halves are added up."""
    x = np.frombuffer(mark, np.uint8)
    while len(x) > width:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x


def possible(pairs: DataFrame, marks: DataFrame, least: tuple[int, int] = LEAST) -> DataFrame:
    """The pairs (a, b) that sizes and sketches can't rule out."""

    def tried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n1, n2 = b.column(2).to_numpy(), b.column(3).to_numpy()
            right = np.abs(n1 - n2) <= allowed(n1, n2, least)
            x, y = b.column(4).to_pylist(), b.column(5).to_pylist()
            for i in np.flatnonzero(right):
                width = min(len(x[i]), len(y[i]))
                right[i] = np.bitwise_count(folded(x[i], width) ^ folded(y[i], width)).sum() <= allowed(n1[i], n2[i], least)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(right, pa.bool_())], ["a", "b", "right"])

    one = marks.select(F.col("doc").alias("a"), F.col("n").alias("n_a"), F.col("sketch").alias("s_a"))
    two = marks.select(F.col("doc").alias("b"), F.col("n").alias("n_b"), F.col("sketch").alias("s_b"))
    both = pairs.join(one, "a").join(two, "b").select("a", "b", "n_a", "n_b", "s_a", "s_b")
    return both.mapInArrow(tried, "a long, b long, right boolean").filter("right").select("a", "b").distinct()


def elements_of(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """(doc, elements) of the texts whose ids are ``wanted`` (doc)."""

    def built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler(words)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingles(t).tobytes() for t in utf8(b.column(1))], pa.binary())], ["doc", "elements"])

    # the ids grow with the corpus: a shuffled join at any size
    ids = wanted.select(F.col("doc").alias("doc_id")).distinct().hint("merge")
    return texts(docs, id_col, text_col).join(ids, "doc_id", "left_semi").mapInArrow(built, "doc long, elements binary")


def ends(pairs: DataFrame) -> DataFrame:
    """(doc) of both sides of ``pairs`` (a, b)."""
    return pairs.select(F.col("a").alias("doc")).unionByName(pairs.select(F.col("b").alias("doc")))


def verified(pairs: DataFrame, sets: DataFrame, least: tuple[int, int] = LEAST) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough, by their elements."""

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            right = [linked(np.frombuffer(x, U), np.frombuffer(y, U), least) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(right, pa.bool_())], ["a", "b", "right"])

    one = sets.select(F.col("doc").alias("b"), F.col("elements").alias("of_b"))
    two = sets.select(F.col("doc").alias("a"), F.col("elements").alias("of_a"))
    both = pairs.join(one, "b").join(two, "a").select("a", "b", "of_a", "of_b")
    return both.mapInArrow(checked, "a long, b long, right boolean").filter("right").select("a", "b").distinct()


class Forest:
    """Disjoint sets of keys, and the edges that made them."""

    def __init__(self):
        self.up: dict[int, int] = {}
        self.edges: list[tuple[int, int]] = []

    def find(self, x: int) -> int:
        up = self.up
        while (y := up.get(x, x)) != x:
            up[x] = x = up.get(y, y)
        return x

    def join(self, x: int, y: int, edge: tuple[int, int]) -> bool:
        """Whether x and y were apart; then they are one now, by this edge."""
        x, y = self.find(x), self.find(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        self.edges.append((min(edge), max(edge)))
        return True

    def table(self) -> pa.Table:
        a, b = zip(*self.edges, strict=True) if self.edges else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def side(block: pa.Table, name: str) -> np.ndarray:
    return block[name].to_numpy(zero_copy_only=False).astype(bool)


def compared(left: np.ndarray, right: np.ndarray, comp: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(row, rows of other components that it is still to be compared with) of one pair of blocks."""
    at_right = np.flatnonzero(right)
    there = comp[at_right]
    one_block = bool((left & right).all())
    for i in np.flatnonzero(left):
        other = at_right[there > comp[i] if one_block else there != comp[i]]
        if len(other):
            yield int(i), other


def near(i: int, other: np.ndarray, n: np.ndarray, bits: np.ndarray, least: tuple[int, int]) -> np.ndarray:
    """Those of ``other`` that sizes and sketches can't rule out as linked with row i."""
    most = allowed(n[other], n[i], least)
    other, most = (x[np.abs(n[other] - n[i]) <= most] for x in (other, most))
    return other[np.bitwise_count(bits[other] ^ bits[i]).sum(axis=1, dtype=np.int64) <= most] if len(other) else other


def close_forest(bucket: pa.Table, least: tuple[int, int] = LEAST) -> pa.Table:
    """A spanning forest of the pairs of one block pair of a bucket, in different components, that can't be ruled out."""
    doc, comp, n = (bucket[c].to_numpy() for c in ("doc", "comp", "n"))
    whole = side(bucket, "whole")
    marks = bucket["sketch"].to_pylist()
    width = min(map(len, marks))
    bits = np.stack([folded(m, width) for m in marks]).view(np.uint64)
    forest = Forest()
    for i, other in compared(side(bucket, "left"), side(bucket, "right"), comp):
        if not whole[i]:
            other = other[whole[other]]
        for k in near(i, other, n, bits, least):
            forest.join(int(doc[i]), int(doc[k]), (int(doc[i]), int(doc[k])))
    return forest.table()


def linked_forest(group: pa.Table, least: tuple[int, int] = LEAST) -> pa.Table:
    """A spanning forest, over components, of the links of one block pair of a group, by the elements."""
    doc, comp = (group[c].to_numpy() for c in ("doc", "comp"))
    sets = [np.frombuffer(x, U) for x in group["elements"].to_pylist()]
    n = np.array([len(s) for s in sets])
    marks = [sketch(s) for s in sets]
    width = min(map(len, marks))
    bits = np.stack([folded(m, width) for m in marks]).view(np.uint64)
    forest = Forest()
    for i, other in compared(side(group, "left"), side(group, "right"), comp):
        for k in near(i, other, n, bits, least):
            if forest.find(int(comp[i])) != forest.find(int(comp[k])) and linked(sets[i], sets[k], least):
                forest.join(int(comp[i]), int(comp[k]), (int(doc[i]), int(doc[k])))
    return forest.table()


def block_pairs(rows: DataFrame) -> DataFrame:
    """``rows`` (with ``blocks``, the blocks of the row's group) once for each pair (p, q) of blocks that it is in, and
    on which side(s) of the pair it is."""
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    sides = (F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), (F.col("block") <= F.col("other")).alias("left"), (F.col("block") >= F.col("other")).alias("right"))
    return dealt.select(*(c for c in rows.columns if c != "blocks"), *sides)


def possible_links(buckets: DataFrame, comps: DataFrame, sets: DataFrame, least: tuple[int, int] = LEAST) -> DataFrame:
    """Pairs (a, b): texts of different components that share a bucket and may be linked are connected by them."""
    named = buckets.join(comps.select(F.col("node").alias("doc"), "root"), "doc", "left").select("key", "doc", "whole", F.coalesce("root", "doc").alias("comp"))
    members = F.sum(F.xxhash64("doc", "whole") % (1 << 40))
    several = named.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("rows"), members.alias("members"), F.sum(F.xxhash64("whole", "doc") % (1 << 40)).alias("again")).filter("lo <> hi")
    # buckets with just the same members give the same pairs: one of them is compared
    several = several.groupBy("lo", "hi", "rows", "members", "again").agg(F.min("key").alias("key")).select("key", F.ceil(F.col("rows") / BLOCK).cast("int").alias("blocks"))
    rows = block_pairs(named.join(several, "key").join(sets.select("doc", "n", "sketch"), "doc"))

    def close(bucket: pa.Table) -> pa.Table:
        return close_forest(bucket, least)

    return rows.groupBy("key", "p", "q").applyInArrow(close, "a long, b long").distinct()


def across(maybe: DataFrame, comps: DataFrame, marks: DataFrame, docs: DataFrame, id_col: str, text_col: str, words: int, least: tuple[int, int] = LEAST) -> DataFrame:
    """Links (a, b) that connect the components of ``comps`` as far as the groups of ``maybe`` (a, b) hold any."""
    groups = components(maybe).select(F.col("node").alias("doc"), F.col("root").alias("key"))
    named = groups.join(comps.select(F.col("node").alias("doc"), F.col("root").alias("comp")), "doc", "left")
    named = written(named.select("doc", "key", F.coalesce("comp", "doc").alias("comp")), "groups")
    sizes = named.join(marks.select("doc", "n"), "doc").groupBy("key").agg(F.count("*").alias("rows"), F.sum("n").alias("elements"))
    sizes = sizes.select("key", F.ceil(F.greatest(F.col("rows") / BLOCK, F.col("elements") / BLOCK_ELEMENTS)).cast("int").alias("blocks"))
    rows = named.join(sizes, "key").join(elements_of(docs, named, id_col, text_col, words), "doc")

    def exact(group: pa.Table) -> pa.Table:
        return linked_forest(group, least)

    return block_pairs(rows).groupBy("key", "p", "q").applyInArrow(exact, "a long, b long")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, least: tuple[int, int] = LEAST) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row; component_id is the smallest doc_id that links reach."""
    table = written(set_table(docs, id_col, text_col, words), "sets")
    n = table.count()
    groups = table.filter("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("keep"), F.count("*").alias("rows"))
    top = groups.filter(F.col("rows") * (HEAVY + 1) > n).filter("rows > 1").orderBy(F.desc("rows"), "digest").limit(HEAVY).collect()
    heavy = {bytes(r.digest): r.keep for r in top}
    # sets in each band: a fixed number of bands
    sizes = table.filter("n_shingles > 0").withColumn("band", band_column("n_shingles")).groupBy("band").count().collect()
    per = {r.band: r["count"] for r in sizes}
    plan = {b: allocation(b, per.get(b, 0) + per.get(b + 1, 0), least) for b in range(max(per, default=0) + 1)}
    index = index_table(docs, plan, heavy, id_col, text_col, words, least)
    bucket = Window.partitionBy("key")
    shared = index.withColumn("rows", F.count("*").over(bucket)).filter("rows > 1").withColumn("rep", F.min(F.when(F.col("whole"), F.col("doc"))).over(bucket))
    buckets = written(shared.filter("rep IS NOT NULL").select("key", "doc", "whole", "rep"), "buckets")
    marks = table.filter("n_shingles > 0 AND doc_id IS NOT NULL").select(F.col("doc_id").alias("doc"), F.col("n_shingles").alias("n"), "sketch")
    pairs = buckets.filter("doc <> rep").select(F.least("rep", "doc").alias("a"), F.greatest("rep", "doc").alias("b")).distinct()
    stars = written(possible(pairs, marks, least), "pairs")
    links = written(verified(stars, elements_of(docs, ends(stars), id_col, text_col, words), least), "links")
    first = written(components(links), "components")
    maybe = written(possible_links(buckets, first, marks, least), "pairs")
    more = across(maybe, first, marks, docs, id_col, text_col, words, least)
    comps = components(first.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))
    named = table
    if heavy:
        kept = docs.sparkSession.createDataFrame([(k, v) for k, v in heavy.items()], "digest binary, keep long")
        named = table.join(F.broadcast(kept), "digest", "left")
    else:
        named = table.withColumn("keep", F.lit(None).cast("long"))
    named = named.select("doc_id", "n_shingles", F.coalesce("keep", "doc_id").alias("node"))
    return named.join(comps, "node", "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "node")).alias("component_id"))


def band_column(size: str):
    """Band of a size column."""
    return F.size(F.filter(F.lit(BANDS.tolist()), lambda low: low <= F.col(size))) - 1


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, least: tuple[int, int] = LEAST) -> DataFrame:
    """``docs`` without the documents whose component has a smaller doc_id; all columns as they were, whatever their names.

    Rows with a null doc_id, a null or empty text, or one without words stay. Of rows that repeat the smallest doc_id of
    a component all stay (their texts aren't compared with one another); an empty table stays empty.
    """
    found = jaccard_components(docs, id_col, text_col, words, least)
    gone_id = unused("gone_id", docs.columns)
    gone = found.filter("component_id < doc_id").select(F.col("doc_id").alias(gone_id)).distinct()
    return docs.join(gone, docs[id_col].cast("long") == gone[gone_id], "left_anti")
