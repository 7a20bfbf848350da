"""Bulk retrieval: inverted index, BM25, hashed vectors, exact dense top-k, rank fusion and what is built on them.

Queries and documents are tables. Terms meet in joins; vectors meet in blocks (a cell holds a bounded part of the
documents and of the queries and returns at most k rows a query). Ranks break ties by id. Scores are rounded to six
places before they are ordered or returned.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agroloom.functions.text import all_tokens, search_tokens, title_words
from agroloom.operators.spread import spread

K1, B = 1.5, 0.75
RRF_K = 60
DIM = 256
#: Most documents and queries of a cell, about; tokens whose buckets a task holds.
CELL_ROWS, CELL_QUERIES, MEMO = 16_384, 1024, 200_000


def document_terms(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, tokens, dl): search tokens of each document, once."""
    rows = spread(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    return rows.select("doc_id", search_tokens(F.col("text")).alias("tokens")).withColumn("dl", F.size("tokens"))


def postings(terms: DataFrame) -> DataFrame:
    """(term, doc_id, tf, dl)."""
    return terms.select("doc_id", "dl", F.explode("tokens").alias("term")).groupBy("term", "doc_id").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))


def corpus_stats(terms: DataFrame) -> DataFrame:
    """One row: number of documents and their mean length (1 if there are none)."""
    return terms.agg(F.count("*").alias("n_docs"), F.coalesce(F.avg("dl"), F.lit(1.0)).alias("avgdl"))


def query_terms(queries: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, term, qtf): query tokens with their repeats."""
    return queries.select(F.col(id_col).alias("item_id"), F.explode(search_tokens(F.col(text_col))).alias("term")).groupBy("item_id", "term").agg(F.count("*").alias("qtf"))


def idf(df: Column, n: Column, kind: str = "lucene") -> Column:
    if kind == "lucene":
        return F.log(1 + (n - df + 0.5) / (df + 0.5))
    return F.log(n - df + 0.5) - F.log(df + 0.5)


def bm25(docs: DataFrame, queries: DataFrame, kind: str = "lucene", repeats: bool = True, k1: float = K1, b: float = B) -> DataFrame:
    """(item_id, doc_id, score) of every document that shares a term with a query.

    Each text is read and tokenised once (once more for okapi): a document's postings are those of terms that a query
    uses (a semi-join before the first aggregation, so common terms that nobody asks for are never shuffled) and one of
    the empty term, which no text holds, for its length; all statistics come from these.
    """
    asked = query_terms(queries)
    wanted = asked.select("term").unionByName(asked.sparkSession.createDataFrame([("",)], "term string")).distinct()
    every_term = F.explode(F.concat(F.array(F.lit("")), F.coalesce("tokens", F.array().cast("array<string>"))))
    used = document_terms(docs).select("doc_id", F.greatest("dl", F.lit(0)).alias("dl"), every_term.alias("term")).join(wanted, "term", "left_semi")
    posts = used.groupBy("term", "doc_id").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))
    stats = F.broadcast(posts.filter("term = ''").agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("n_docs"), F.coalesce(F.sum(F.col("tf") * F.col("dl")) / F.sum("tf"), F.lit(1.0)).alias("avgdl")))  # one row
    posts = posts.filter("term <> ''")
    df = posts.groupBy("term").agg(F.count("*").alias("df"))
    weights = df.crossJoin(stats).select("term", idf(F.col("df"), F.col("n_docs"), kind).alias("idf"), "avgdl")
    if kind == "okapi":
        # negative weights become a quarter of the mean weight over all terms of the corpus
        every = postings(document_terms(docs)).groupBy("term").agg(F.count("*").alias("df")).crossJoin(stats)
        mean = every.agg((F.avg(idf(F.col("df"), F.col("n_docs"), kind)) * 0.25).alias("floor"))
        weights = weights.crossJoin(F.broadcast(mean)).select("term", F.when(F.col("idf") < 0, F.col("floor")).otherwise(F.col("idf")).alias("idf"), "avgdl")
    times = F.col("qtf") if repeats else F.lit(1)
    part = times * F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    scored = posts.join(weights, "term").join(asked, "term").groupBy("item_id", "doc_id").agg(F.round(F.sum(part), 6).alias("score"))
    return scored


def ranked(scored: DataFrame, k: int, by: str = "item_id", positive: bool = True) -> DataFrame:
    """``scored`` with rank; the k best of each query, ties by doc_id, then only positive scores."""
    order = Window.partitionBy(by).orderBy(F.desc("score"), "doc_id")
    top = scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return top.filter("score > 0") if positive else top


def hashed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, bucket, w): sparse unit vectors of ``DIM`` hashed buckets.

    A token adds 1 at one bucket and 0.5 at another, each of its 3-grams 0.3 at a third; the bucket is the first MD5
    byte of "seed:token" (fixed values: seeds 1, 2, 3). Weights are summed in the row's task, and a row is shuffled once, as
    one row of arrays; rows that repeat an id are one text.
    """
    rows = spread(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    rows = rows.select("id", all_tokens(F.col("text")).alias("tokens")).filter(F.size("tokens") > 0)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, np.ndarray] = {}
        for whole in batches:
            for start in range(0, whole.num_rows, 1024):
                b = whole.slice(start, 1024)
                weights = [bucket_weights(tokens, memo) for tokens in b.column(1).to_pylist()]
                at = [np.flatnonzero(x) for x in weights]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.astype(np.int32) for x in at], pa.list_(pa.int32())), pa.array([x[i] for x, i in zip(weights, at, strict=True)], pa.list_(pa.int64()))], ["id", "buckets", "ws"])

    sparse = rows.mapInArrow(made, f"id {rows.schema['id'].dataType.simpleString()}, buckets array<int>, ws array<long>").repartition("id")
    each = sparse.select("id", F.explode(F.arrays_zip("buckets", "ws")).alias("p")).select("id", F.col("p.buckets").alias("bucket"), F.col("p.ws").alias("w"))
    # tenths as integers: sums don't depend on their order
    sums = each.groupBy("id", "bucket").agg(F.sum("w").alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("id")))
    return sums.select("id", "bucket", (F.col("w") / norm).alias("w"))


def token_codes(token: str) -> np.ndarray:
    """Buckets of one token as in :func:`hashed`, plus DIM for those of half weight and 2 * DIM for those of 3-grams."""
    at = lambda seed, what: hashlib.md5(f"{seed}:{what}".encode()).digest()[0]
    return np.array([at(1, token), DIM + at(2, token), *(2 * DIM + at(3, token[i : i + 3]) for i in range(len(token) - 2))], np.int64)


def bucket_weights(tokens: list[str], memo: dict[str, np.ndarray]) -> np.ndarray:
    """Weights of the ``DIM`` buckets of one text in tenths; ``memo`` holds the codes of tokens that a task has seen."""
    if len(memo) > MEMO:
        memo.clear()
    for t in set(tokens).difference(memo):
        memo[t] = token_codes(t)
    n = np.bincount(np.concatenate([memo[t] for t in tokens]), minlength=3 * DIM) if tokens else np.zeros(3 * DIM, np.int64)
    return 10 * n[:DIM] + 5 * n[DIM : 2 * DIM] + 3 * n[2 * DIM :]


def coded(weights: np.ndarray) -> bytes:
    """Weights as the narrowest unsigned integers that hold them, after a byte with their width."""
    width = next(w for w in (1, 2, 4, 8) if int(weights.max()) < 1 << 8 * w)
    return bytes([width]) + weights.astype(f"<u{width}").tobytes()


def unit_rows(vectors: list[bytes]) -> np.ndarray:
    """Vectors as rows: :func:`coded` weights (an odd number of bytes) over their norm, doubles as they are."""
    sizes = np.array([len(v) for v in vectors])
    out = np.zeros((len(vectors), sizes[0] // 8 if sizes[0] % 8 == 0 else (sizes[0] - 1) // vectors[0][0]))
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        raw = np.frombuffer(b"".join(vectors[i] for i in at), np.uint8).reshape(len(at), -1)
        if size % 8 == 0:
            out[at] = raw.view(float)
            continue
        x = np.ascontiguousarray(raw[:, 1:]).view(f"<u{raw[0, 0]}").astype(float)
        norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
        out[at] = x / np.where(norm > 0, norm, 1)
    return out


def unit_vectors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), dealt: bool = False) -> DataFrame:
    """(id, v, columns ``keep``): the vectors of :func:`hashed` in a binary column, as :func:`coded` weights: an eighth of
    the bytes that doubles take on disk and in a shuffle, and the same unit vectors once :func:`unit_rows` reads them.

    Tokens come from the JVM; a task hashes each distinct token once while its memo holds. No shuffle. A text without
    tokens has a vector of zeros. Small tables are dealt over all cores, unless they are ``dealt`` already.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *keep)
    rows = (rows if dealt else spread(rows)).select("id", F.coalesce(all_tokens(F.col("text")), F.array().cast("array<string>")).alias("tokens"), *keep)
    kinds = [f.dataType.simpleString() for f in rows.schema.fields if f.name not in ("id", "tokens")]

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, np.ndarray] = {}
        for whole in batches:
            for start in range(0, whole.num_rows, 1024):
                b = whole.slice(start, 1024)
                out = [coded(bucket_weights(tokens, memo)) for tokens in b.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary()), *b.columns[2:]], ["id", "v", *keep])

    schema = f"id {rows.schema['id'].dataType.simpleString()}, v binary" + "".join(f", {c} {k}" for c, k in zip(keep, kinds, strict=True))
    return rows.mapInArrow(made, schema)


def packed(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v) of an array column, its doubles in a binary column; null vectors and those with nulls are left out."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([np.array(x, float).tobytes() for x in b.column(1).to_pylist()], pa.binary())], ["id", "v"])

    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("x")).filter(F.forall("x", lambda e: e.isNotNull()))
    return rows.mapInArrow(made, f"id {rows.schema['id'].dataType.simpleString()}, v binary")


def block_top_k(vectors: DataFrame, queries: DataFrame, k: int, section: str | None = None, own: bool = True, sizes: tuple[int, int] | None = None) -> DataFrame:
    """(item_id, doc_id, score[, section]): of each cell the k best documents (id, v) of each query (id, v) by inner
    product, ties to the smaller id; with ``section`` the best document of each of the k best sections. ``own`` false
    leaves out the query's own id. Vectors of a query and of its documents have one length. ``sizes`` are upper bounds of
    both counts, else they are counted."""
    n, m = sizes or (vectors.count(), queries.count())
    cells, groups = max(1, -(-n // CELL_ROWS)), max(1, -(-m // CELL_QUERIES))
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    place = lambda seed, count: F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(count)).cast("int")
    name = F.col(section) if section else F.lit("")
    kinds = [d.schema["id"].dataType.simpleString() for d in (queries, vectors)]  # keys may be numbers or strings
    left = vectors.select("id", F.lit(None).cast(kinds[0]).alias("q"), "v", name.alias("section"), F.lit(False).alias("asks"), place(1, cells).alias("cell"), every(groups).alias("g"))
    right = queries.select(F.lit(None).cast(kinds[1]).alias("id"), F.col("id").alias("q"), "v", F.lit("").alias("section"), F.lit(True).alias("asks"), every(cells).alias("cell"), place(2, groups).alias("g"))

    def searched(t: pa.Table) -> pa.Table:
        asks = t["asks"].to_numpy(zero_copy_only=False).astype(bool)
        own_ids, asked = t["id"].filter(pa.array(~asks)).to_pylist(), t["q"].filter(pa.array(asks)).to_pylist()
        of = lambda flags: unit_rows(t["v"].filter(pa.array(flags)).to_pylist()) if flags.any() else np.zeros((0, 1))
        a, b = of(asks), of(~asks)
        out: list[tuple] = []
        if len(a) and len(b):
            names, docs = np.array(t["section"].to_pylist(), object)[~asks], np.array(own_ids)
            _, place = np.unique(docs, return_inverse=True)  # ties by number, whatever the keys are
            code = t["section"].combine_chunks().dictionary_encode("encode").indices.to_numpy()[~asks]
            few = k + (not own)
            scores = np.round(a @ b.T, 6)
            for q, row in zip(asked, scores, strict=True):
                near = np.arange(len(row)) if section or len(row) <= few else np.flatnonzero(row >= np.partition(row, -few)[-few])
                order = near[np.lexsort((place[near], -row[near]))]
                if not own:
                    order = order[docs[order] != q]
                if section:
                    order = order[np.sort(np.unique(code[order], return_index=True)[1])]
                out += [(q, own_ids[i], row[i], names[i]) for i in order[:k]]
        columns = list(zip(*out, strict=True)) or [[], [], [], []]
        return pa.table({"item_id": pa.array(columns[0], t["q"].type), "doc_id": pa.array(columns[1], t["id"].type), "score": pa.array(columns[2], pa.float64()), "section": pa.array(columns[3], pa.string())})

    found = left.unionByName(right).groupBy("cell", "g").applyInArrow(searched, f"item_id {kinds[0]}, doc_id {kinds[1]}, score double, section string")
    return found if section else found.drop("section")


def dense_top_k(vectors: DataFrame, queries: DataFrame, k: int, sizes: tuple[int, int] | None = None) -> DataFrame:
    """(item_id, doc_id, score, rank): best inner products of unit vectors (id, v)."""
    return ranked(block_top_k(vectors, queries, k, sizes=sizes), k, positive=False)


def vector_top_k(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, vec_id, score, rank) by inner product of arrays, the query's own id left out."""
    best = block_top_k(packed(vectors, id_col, vector_col), packed(queries, id_col, vector_col), k, own=False, sizes=(vectors.count(), queries.count()))
    return ranked(best, k, positive=False).withColumnsRenamed({"item_id": "query_id", "doc_id": "vec_id"})


def title_matches(ranked_sections: DataFrame, titles: DataFrame, queries: DataFrame, stop: list[str], k: int) -> DataFrame:
    """``ranked_sections`` (item_id, doc_id, section, rank) whose title (doc_id, title) shares words with the query
    (item_id, text): ranked anew by how many, ties in the order they came; k at most."""
    t = titles.select("doc_id", title_words(F.col("title"), stop).alias("t"))
    q = queries.select("item_id", title_words(F.col("text"), stop).alias("q"))
    shared = ranked_sections.join(t, "doc_id").join(q, "item_id").withColumn("score", F.size(F.array_intersect("q", "t")).cast("double")).filter("score > 0")
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), "rank")
    return shared.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("item_id", "doc_id", "section", "score", "rank")


def wanted_chunks(chunks: DataFrame, kind: str | None = None, crop: str | None = None) -> DataFrame:
    """Chunks of one kind, and of one crop or of all crops ("Paddy" is "Paddy (Rice)" too); no filter without either."""
    if kind:
        chunks = chunks.filter(F.coalesce("kind", F.lit("advisory")) == kind)
    if crop:
        name = F.lower(F.coalesce("crop", F.lit("")))
        chunks = chunks.filter(name.startswith(crop.lower()) | name.startswith("all crops"))
    return chunks


def crop_first(hits: DataFrame, crop: str = "crop", asked: str = "asked_crop") -> DataFrame:
    """``hits`` ranked anew: those of the crop that the query asks for come first, else the order stays."""
    other = ~F.coalesce(F.lower(crop).startswith(F.lower(asked)), F.col(asked).isNull())
    order = Window.partitionBy("item_id").orderBy(other, "rank")
    return hits.withColumn("rank", F.row_number().over(order))


def names_question(section: Column, crop: Column, topic: Column, asked_crop: Column) -> Column:
    """Whether a first hit is titled for the topic that the question names, on the crop it names."""
    return F.coalesce(F.contains(F.lower(section), F.lower(topic)) & F.lower(crop).startswith(F.lower(asked_crop)), F.lit(False))


def best_per_section(hits: DataFrame, section: list[str], k: int) -> DataFrame:
    """The first hit of each section in rank order, ranked anew and cut to k."""
    first = Window.partitionBy("item_id", *section).orderBy("rank")
    again = Window.partitionBy("item_id").orderBy("rank")
    kept = hits.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")
    return kept.withColumn("rank", F.row_number().over(again)).filter(F.col("rank") <= k)


def fuse(lists: list[DataFrame], key: str, k: int = RRF_K, weights: list[float] | None = None, show: str | None = None) -> DataFrame:
    """Reciprocal rank fusion of lists (item_id, key, rank, score): fused score, rank by it, and each list's own rank.

    Ties go to the row first seen in list order; ``show`` is a column that is taken from that row. One union and one
    aggregation, however many lists there are.
    """
    weights = weights or [1.0] * len(lists)
    rows = None
    for i, (ls, w) in enumerate(zip(lists, weights, strict=True)):
        part = ls.select("item_id", key, *([show] if show else []), F.lit(i).alias("list"), "rank", (F.lit(w) / (k + F.col("rank"))).alias("part"))
        rows = part if rows is None else rows.unionByName(part)
    per = [F.max(F.when(F.col("list") == i, F.col("rank"))).alias(f"rank_{i}") for i in range(len(lists))]
    shown = [F.min_by(show, F.struct("list", "rank")).alias(show)] if show else []
    fused = rows.groupBy("item_id", key).agg(F.round(F.sum("part"), 6).alias("score"), F.min(F.struct("list", "rank")).alias("first"), *per, *shown)
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), "first.list", "first.rank")
    return fused.withColumn("rank", F.row_number().over(order)).drop("first")


def siblings(chosen: DataFrame, chunks: DataFrame, section: list[str], most: int = 3, first: DataFrame | None = None) -> DataFrame:
    """(item_id, doc_id, n): up to ``most`` further chunks of each chosen section, none listed already: those of the
    ranked list ``first`` (item_id, doc_id, rank) in its order, then the others in corpus order.

    Of each section only its first chunks are joined: as many as a query may have listed of it, and ``most`` more.
    """
    wanted = chosen.select("item_id", *section).distinct()
    listed = chosen.select("item_id", "doc_id").distinct()
    held = wanted.join(chunks.select("doc_id", *section).join(listed.select("doc_id").distinct(), "doc_id"), section).join(listed, ["item_id", "doc_id"], "left_semi")
    limit = held.groupBy("item_id", *section).count().agg(F.coalesce(F.max("count"), F.lit(0)).alias("m"))
    ranked_hits = None
    if first is not None:
        ranked_hits = first.select("item_id", "doc_id", "rank").join(chunks.select("doc_id", *section), "doc_id").join(wanted, ["item_id", *section], "left_semi")
        per = ranked_hits.groupBy("item_id", *section).count().agg(F.coalesce(F.max("count"), F.lit(0)).alias("r"))
        limit = limit.crossJoin(per).select((F.col("m") + F.col("r")).alias("m"))  # one row each
    heads = chunks.select("doc_id", *section).withColumn("_p", F.row_number().over(Window.partitionBy(*section).orderBy("doc_id")))
    heads = heads.crossJoin(F.broadcast(limit)).filter(F.col("_p") <= F.col("m") + most).drop("_p", "m")  # one row
    rest = heads.join(wanted, section).select("item_id", *section, "doc_id")
    if ranked_hits is None:
        rest = rest.withColumn("_r", F.lit(None).cast("int"))
    else:
        near = ranked_hits.select("item_id", *section, "doc_id", F.col("rank").cast("int").alias("_r"))
        rest = rest.withColumn("_r", F.lit(None).cast("int")).unionByName(near).groupBy("item_id", *section, "doc_id").agg(F.min("_r").alias("_r"))
    rest = rest.join(listed, ["item_id", "doc_id"], "left_anti")
    order = Window.partitionBy("item_id", *section).orderBy(F.col("_r").asc_nulls_last(), "doc_id")
    return rest.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= most).drop("_r")


def citation(reference: str, source: str, title: str, section: str) -> Column:
    """Where a hit is printed, if its chunk says so, else its source and title; then its section."""
    printed = F.when(F.col(reference) != "", F.col(reference))
    return F.concat(F.coalesce(printed, F.concat(F.col(source), F.lit(" - "), F.col(title))), F.lit(" ["), F.col(section), F.lit("]"))


def confident(fused: DataFrame) -> DataFrame:
    """(item_id, confident): whether the top hit is first in both lists."""
    top = fused.filter("rank = 1")
    return top.select("item_id", F.coalesce((F.col("rank_0") == 1) & (F.col("rank_1") == 1), F.lit(False)).alias("confident"))
