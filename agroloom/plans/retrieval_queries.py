"""Registered retrieval queries with their SQL."""

from __future__ import annotations

import hashlib
import re
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agroloom.functions.lexicon import Lexicon
from agroloom.functions.text import search_tokens
from agroloom.operators import chunking, rules
from agroloom.operators import index as I
from agroloom.operators import retrieval as R
from agroloom.operators.spread import spread
from agroloom.plans.dialogue_queries import STAND_IN, intent_sql, sql_any
from agroloom.sources import readers
from agroloom.sources.shared import at_path, discard, fresh_path, shared_dir, written

TOK = r"list_filter(regexp_split_to_array(regexp_replace(lower({0}), '[\p{{P}}\p{{S}}\p{{C}}]', ' ', 'g'), '[\s\p{{Z}}]+'), lambda x: length(x) > 1)"
ALL_TOK = r"list_filter(regexp_split_to_array(regexp_replace(lower({0}), '[\p{{P}}\p{{S}}\p{{C}}]', ' ', 'g'), '[\s\p{{Z}}]+'), lambda x: x <> '')"

BM25_CTE = f"""
dt AS (SELECT doc_id, {TOK.format('text')} AS tokens FROM documents),
st AS (SELECT count(*) AS n, coalesce(avg(len(tokens)), 1.0) AS avgdl FROM dt),
po AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, len(tokens) AS dl, unnest(tokens) AS term FROM dt) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM po GROUP BY term),
qt AS (SELECT item_id, term, count(*) AS qtf FROM (SELECT item_id, unnest({TOK.format('text')}) AS term FROM benchmark) GROUP BY ALL),
sc AS (SELECT item_id, doc_id, round(sum(qtf * ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 6) AS score
       FROM qt JOIN po USING (term) JOIN df USING (term), st GROUP BY item_id, doc_id)
"""

HASH_SQL = """
SELECT id, bucket, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM (
  SELECT id, bucket, sum(w * n)::DOUBLE AS w FROM (
    SELECT id, n, ('0x' || md5('1:' || t)[1:2])::INT AS bucket, 10 AS w FROM {c}
    UNION ALL SELECT id, n, ('0x' || md5('2:' || t)[1:2])::INT, 5 FROM {c}
    UNION ALL SELECT id, n, ('0x' || md5('3:' || t[i:i+2])[1:2])::INT, 3 FROM (SELECT id, n, t, unnest(range(1, length(t) - 1)) AS i FROM {c} WHERE length(t) >= 3)
  ) GROUP BY id, bucket)
"""


def hash_cte(name: str, table: str, key: str) -> str:
    counts = f"(SELECT id, t, count(*) AS n FROM (SELECT {key} AS id, unnest({ALL_TOK.format('text')}) AS t FROM {table}) GROUP BY id, t)"
    return f"{name}_c AS MATERIALIZED {counts}, {name} AS MATERIALIZED ({HASH_SQL.format(c=name + '_c')})"


DENSE_CTE = f"""
{hash_cte('dv', 'documents', 'doc_id')}, {hash_cte('qv', 'benchmark', 'item_id')},
ds AS (SELECT q.id AS item_id, d.id AS doc_id, round(sum(d.w * q.w), 6) AS score FROM dv d JOIN qv q USING (bucket) GROUP BY ALL),
dl20 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM ds) WHERE rank <= 20)
"""
SPARSE_CTE = BM25_CTE + ", sl20 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM sc) WHERE rank <= 20 AND score > 0)"
FUSE_CTE = """
secs AS (SELECT doc_id, source || '/' || lang AS section FROM documents),
dsec AS (SELECT * FROM (SELECT item_id, doc_id, section, score, row_number() OVER (PARTITION BY item_id ORDER BY rank) AS rank FROM (
  SELECT l.*, section, row_number() OVER (PARTITION BY item_id, section ORDER BY rank) AS one FROM dl20 l JOIN secs USING (doc_id)) WHERE one = 1) WHERE rank <= 5),
ssec AS (SELECT * FROM (SELECT item_id, doc_id, section, score, row_number() OVER (PARTITION BY item_id ORDER BY rank) AS rank FROM (
  SELECT l.*, section, row_number() OVER (PARTITION BY item_id, section ORDER BY rank) AS one FROM sl20 l JOIN secs USING (doc_id)) WHERE one = 1) WHERE rank <= 5),
un AS (SELECT item_id, section, 0 AS list, rank, 1.0::DOUBLE / (60 + rank) AS part, doc_id FROM dsec UNION ALL SELECT item_id, section, 1, rank, 1.0::DOUBLE / (60 + rank), doc_id FROM ssec),
fu AS (SELECT item_id, section, round(sum(part), 6) AS score, min(list * 1000 + rank) AS first_seen, arg_min(doc_id, list * 1000 + rank) AS doc_id,
       max(CASE WHEN list = 0 THEN rank END) AS dense_rank, max(CASE WHEN list = 1 THEN rank END) AS sparse_rank FROM un GROUP BY item_id, section),
fr AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, first_seen) AS rank FROM fu)
"""

#: The second pass: the same lists for the queries of ``retry``, their names with an appended 2.
def tables(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names]


def tokenize_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    (docs,) = tables(spark, sf_dir, "documents")
    t = R.document_terms(docs)
    return t.select("doc_id", F.col("dl").cast("long").alias("n_tokens"), F.size(F.array_distinct("tokens")).cast("long").alias("n_terms"))


def doc_freq_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    (docs,) = tables(spark, sf_dir, "documents")
    terms = docs.select(F.explode(F.array_distinct(search_tokens(F.col("text")))).alias("term"))
    return terms.groupBy("term").agg(F.count("*").alias("df")).orderBy(F.desc("df"), "term").limit(50)


def stored_index(spark: SparkSession, sf_dir: str, name: str, docs, id_col: str = "doc_id", **how) -> I.Index:
    """The index of a table in the session's shared folder: built by the first query that asks for it, read by all others.
    ``docs`` makes the table (``how``: see ``build``)."""
    path = f"{shared_dir(spark)}/tables/index-{spark.sparkContext.applicationId}-{name}-{hashlib.md5(sf_dir.encode()).hexdigest()}"
    hadoop, files = at_path(spark, path)
    if not files.exists(hadoop):
        files.deleteOnExit(hadoop)
    try:
        return I.opened(spark, path)
    except RuntimeError:
        return I.build(docs(), path, id_col, **how)


def corpus_index(spark: SparkSession, sf_dir: str) -> I.Index:
    return stored_index(spark, sf_dir, "documents", lambda: tables(spark, sf_dir, "documents")[0])


def sparse_list(index: I.Index, asked: DataFrame, k: int, **how) -> DataFrame:
    """(item_id, doc_id, score, rank) from the stored index."""
    return I.search(index, asked, k, **how).hits.withColumnRenamed("key", "doc_id").withColumn("rank", F.col("rank").cast("long"))


def index_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: documents, tokens, distinct terms and postings of the stored index."""
    index = corpus_index(spark, sf_dir)
    m = index.manifest
    return index.terms().agg(F.count("*").alias("n_terms"), F.coalesce(F.sum("df"), F.lit(0)).cast("long").alias("n_postings")).select(F.lit(m.n_docs).cast("long").alias("n_docs"), F.lit(m.n_tokens).cast("long").alias("n_tokens"), "n_terms", "n_postings")


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sparse_list(corpus_index(spark, sf_dir), tables(spark, sf_dir, "benchmark")[0], 5)


def bm25_single_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sparse_list(corpus_index(spark, sf_dir), tables(spark, sf_dir, "benchmark")[0], 5, repeats=False)


def bm25_okapi_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sparse_list(corpus_index(spark, sf_dir), tables(spark, sf_dir, "benchmark")[0], 5, kind="okapi")


def index_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 after an index of an earlier state of the documents (some missing, some with other texts, some that are gone
    since) was brought up to date, and after it was compacted: as if it had been built from the documents."""
    docs, bench = tables(spark, sf_dir, "documents", "benchmark")
    docs = docs.select("doc_id", "text")
    changed = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("earlier words "), "text")).otherwise(F.col("text")).alias("text")
    gone = docs.filter("doc_id % 11 = 0").select((-1 - F.col("doc_id")).alias("doc_id"), "text")
    earlier = I.build(docs.filter("doc_id % 7 <> 0").select("doc_id", changed).unionByName(gone), fresh_path(spark, "index"), vectors=False)
    now = I.update(earlier, docs, vectors=False)
    states = ((F.lit(n), sparse_list(ix, bench, 5)) for n, ix in (("updated", now), ("compacted", I.compact(now))))
    one, two = (hits.withColumn("state", name) for name, hits in states)
    return one.unionByName(two)


def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    (vectors,) = tables(spark, sf_dir, "embeddings")
    hits = R.vector_top_k(vectors, vectors.filter("vec_id % 50 = 0"), 5)
    return hits.select("query_id", "vec_id", "score", F.col("rank").cast("long").alias("rank"))


def hash_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    (docs,) = tables(spark, sf_dir, "documents")
    return R.hashed(docs).select(F.col("id").alias("doc_id"), "bucket", F.round("w", 6).alias("w"))


def dense_list(spark: SparkSession, sf_dir: str, k: int = 20) -> DataFrame:
    (bench,) = tables(spark, sf_dir, "benchmark")
    return dense_of(corpus_index(spark, sf_dir), bench, k)


def dense_of(index: I.Index, asked: DataFrame, k: int) -> DataFrame:
    """(item_id, doc_id, score, rank) from the stored vectors."""
    return R.dense_top_k(index.vectors(), R.unit_vectors(asked, "item_id"), k, (index.manifest.n_docs, asked.count()))


def hash_dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dense_list(spark, sf_dir, 5).select("item_id", "doc_id", "score", F.col("rank").cast("long").alias("rank"))


def section_of(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.concat_ws("/", "source", "lang").alias("section"))


def section_lists(index: I.Index, secs: DataFrame, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Dense and sparse hits of the queries ``asked``, the best of each section, five sections a list. The hits, 20 a query,
    are written first: Spark then knows how few they are and doesn't shuffle the sections."""
    dense, sparse = (written(hits, "hits") for hits in (dense_of(index, asked, 20), sparse_list(index, asked, 20)))
    return tuple(R.best_per_section(hits.join(secs, "doc_id"), ["section"], 5) for hits in (dense, sparse))


def best_chunk_per_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, bench = tables(spark, sf_dir, "documents", "benchmark")
    return section_lists(corpus_index(spark, sf_dir), section_of(docs), bench)[1].select("item_id", "doc_id", "section", "score", F.col("rank").cast("long").alias("rank"))


def hybrid_of(index: I.Index, secs: DataFrame, asked: DataFrame) -> DataFrame:
    """(item_id, section, doc_id, score, rank, rank_0, rank_1) of all fused sections of the queries ``asked``; ``secs``
    (doc_id, section) says where each chunk belongs."""
    return R.fuse(list(section_lists(index, secs, asked)), "section", show="doc_id")


def hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, bench = tables(spark, sf_dir, "documents", "benchmark")
    return hybrid_of(corpus_index(spark, sf_dir), section_of(docs), bench)


def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = hybrid(spark, sf_dir)
    return h.select("item_id", "section", "doc_id", "score", *(F.coalesce(F.col(a), F.lit(0)).cast("long").alias(b) for a, b in (("rank", "rank"), ("rank_0", "dense_rank"), ("rank_1", "sparse_rank"))))


def hybrid_flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best sections of each query with a citation."""
    (docs,) = tables(spark, sf_dir, "documents")
    top = hybrid(spark, sf_dir).filter("rank <= 3")
    cited = top.join(docs.select("doc_id", "source", "lang"), "doc_id")
    return cited.select("item_id", F.col("rank").cast("long").alias("rank"), "doc_id", "score", F.format_string("%s - document %d [%s]", "source", "doc_id", "section").alias("citation"))


def agreement_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.confident(hybrid(spark, sf_dir))


def section_siblings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Further chunks of the chosen sections: those of the dense list first, then in corpus order."""
    docs, bench = tables(spark, sf_dir, "documents", "benchmark")
    chosen = hybrid(spark, sf_dir).filter("rank <= 3")
    first = dense_of(corpus_index(spark, sf_dir), bench, 20)
    return R.siblings(chosen, section_of(docs), ["section"], first=first).select("item_id", "section", "doc_id", F.col("n").cast("long").alias("n"))


def chunk_table(docs: DataFrame) -> DataFrame:
    """Documents as chunks: language as crop ("xx (lang)"; Spanish stands for all crops), a kind, a section and a title."""
    crop = F.when(F.col("lang") == "es", "All Crops").otherwise(F.concat("lang", F.lit(" (lang)")))
    return docs.select("*", crop.alias("crop"), F.when(F.col("doc_id") % 3 == 0, "pau").otherwise("advisory").alias("kind"), F.concat_ws("/", "source", "lang").alias("section"), F.substring("text", 1, 60).alias("title"))


def filtered_lists(docs: DataFrame, asked: DataFrame, kind: str, crop: str, k: int = 5) -> list[DataFrame]:
    """Dense, sparse and title lists of sections within one kind and crop: every chunk that passes takes part, with the
    statistics of the whole corpus."""
    chunks = chunk_table(docs)
    kept = R.wanted_chunks(chunks, kind, crop)
    best = R.block_top_k(R.unit_vectors(kept, keep=("section",)), R.unit_vectors(asked, "item_id"), 1 << 20, section="section", sizes=(docs.count(), asked.count()))
    dense_all = R.best_per_section(R.ranked(best, 1 << 30, positive=False), ["section"], 1 << 30)
    scores = R.bm25(docs, asked).join(kept.select("doc_id", "section"), "doc_id")
    sparse = R.best_per_section(R.ranked(scores, 1 << 30), ["section"], k)
    titled = R.title_matches(dense_all, kept, asked, STOP, k)
    return [dense_all.filter(F.col("rank") <= k), sparse, titled]


STOP = ["the", "and", "de", "der", "la"]


def filtered_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best sections of one crop's chapters, from dense and sparse lists."""
    lists = filtered_lists(*tables(spark, sf_dir, "documents", "benchmark"), "pau", "EN")[:2]
    top = R.fuse(lists, "section", show="doc_id").filter("rank <= 3")
    return top.select("item_id", "section", "doc_id", "score", F.col("rank").cast("long").alias("rank"))


def rrf_three_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``filtered_hybrid``, with the sections whose title shares words with the query as a third list."""
    top = R.fuse(filtered_lists(*tables(spark, sf_dir, "documents", "benchmark"), "pau", "EN"), "section", show="doc_id")
    return top.select("item_id", "section", "doc_id", "score", F.col("rank").cast("long").alias("rank"), F.coalesce("rank_2", F.lit(0)).cast("long").alias("title_rank"))


def crop_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best sections with those of the asked crop in front, and whether the first is titled for the question."""
    docs, bench = tables(spark, sf_dir, "documents", "benchmark")
    asked = F.element_at(F.array(F.lit("de"), F.lit("fr"), F.lit(None).cast("string")), (F.pmod("item_id", F.lit(3)) + 1).cast("int"))
    top = hybrid(spark, sf_dir).filter("rank <= 5").join(chunk_table(docs).select("doc_id", "crop"), "doc_id").withColumn("asked_crop", asked)
    again = R.crop_first(top)
    named = (F.col("rank") == 1) & R.names_question(F.col("section"), F.col("crop"), F.lit("WEB"), F.col("asked_crop"))
    return again.select("item_id", "section", "doc_id", F.col("rank").cast("long").alias("rank"), named.alias("named"))


def retry_queries(unsure: DataFrame, lex: Lexicon) -> DataFrame:
    """(item_id, text) of a second search for each question (item_id, text, crop): its crop and the words that titles use
    for the topics it names; no row where it names no topic or where that is the question itself."""
    q = F.lower(F.trim(F.coalesce("text", F.lit(""))))
    rows = unsure.select("item_id", q.alias("before"), rules.search_terms(q, lex).alias("terms"), "crop")
    rows = rows.select("item_id", "before", "terms", F.concat_ws(" ", "crop", "terms").alias("text"))
    return rows.filter((F.col("terms") != "") & (F.lower("text") != F.col("before"))).select("item_id", "text")


def corrective(docs: DataFrame, asked: DataFrame, index: I.Index | None = None, lex: Lexicon | None = None) -> DataFrame:
    """(item_id, doc_id, status): a first hit that both lists agree on, or that is titled for the topic and crop that the
    question names, stands ('confident'). Otherwise a second pass over the same index asks for crop and topic words. Its
    answer counts if its fused first is its sparse first ('corrected'), else the first pass's answer stands
    ('low_confidence')."""
    lex = lex or Lexicon()
    index, secs = index or I.build(docs, fresh_path(docs.sparkSession, "index")), section_of(docs)
    named = rules.classify(asked.select("item_id", "text"), lex=lex).select("item_id", "text", F.col("crop").alias("asked_crop"), "topic")
    named = named.withColumn("topic", F.when(F.col("topic") != rules.GENERAL_TOPIC, F.col("topic")))
    top = hybrid_of(index, secs, asked).filter("rank = 1").join(named, "item_id").join(chunk_table(docs).select("doc_id", "crop"), "doc_id")
    agreed = F.coalesce((F.col("rank_0") == 1) & (F.col("rank_1") == 1), F.lit(False))
    titled = R.names_question(F.col("section"), F.col("crop"), F.col("topic"), F.col("asked_crop"))
    first = written(top.select("item_id", "doc_id", "text", F.col("asked_crop").alias("crop"), (agreed | titled).alias("sure")), "first-pass")  # one row a query
    retried = written(retry_queries(first.filter("NOT sure"), lex), "retried")
    second = hybrid_of(index, secs, retried).filter("rank = 1 AND rank_1 = 1").select("item_id", F.col("doc_id").alias("again"))
    status = F.when(F.col("sure"), "confident").when(F.col("again").isNotNull(), "corrected").otherwise("low_confidence")
    return first.join(second, "item_id", "left").select("item_id", F.coalesce("again", "doc_id").alias("doc_id"), status.alias("status"))


#: What stands for crops, pests and topics in the invented prose: languages, sources, and words for words.
RETRY_WORDS = replace(
    STAND_IN,
    crops=(("en", ("the", "that", "of")), ("de", ("der", "und")), ("fr", ("les", "des", "la"))),
    pests=(("src1", ("with", "for")), ("src3", ("is", "than")), ("src5", ("es", "que"))),
    pest_crops=(("src1", ("en", "de", "fr")), ("src3", ("en",)), ("src5", ("fr",))),
    schemes=(("Beta", ("thanon",)),),
    topics=(("motion", ("tion", "nt", "to")), ("shape", ("sh", "er", "as"))),
    topic_titles=(("shape", "this other"),),
    english=(("tion", "thnt"), ("sh", "hein"), ("to", "thon")),
)


def corrective_retry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions whose lists disagree are searched again by crop and topic words."""
    return corrective(*tables(spark, sf_dir, "documents", "benchmark"), corpus_index(spark, sf_dir), RETRY_WORDS)


#: Characters of a section of the JSON documents that are made of the texts; documents of a file, as a packed one can't be
#: split among tasks.
PIECE, FILE_ROWS = 500, 1024


def as_json(docs: DataFrame, folder: str) -> None:
    """Documents as JSON records of the advisory form, one a line: every ``PIECE`` characters of a text are a section,
    every third one with the page where it is printed. Files are packed (gzip)."""
    part = lambda i: F.struct(F.concat(F.lit("Part "), i + 1).alias("section_title"), F.substring(F.col("text"), i * PIECE + 1, F.lit(PIECE)).alias("recommended_action"), F.when(i % 3 == 0, F.concat(F.lit("page "), i + 1)).alias("source_reference"))
    pieces = F.transform(F.sequence(F.lit(0), F.ceil(F.length("text") / PIECE).cast("int") - 1), part)
    held = docs.filter(F.length("text") > 0)
    held.select(F.concat(F.lit("d"), "doc_id").alias("doc_id"), F.col("source").alias("source_organization"), F.concat(F.lit("Document "), "doc_id").alias("document_title"), F.col("lang").alias("crop"), pieces.alias("sections")).write.option("compression", "gzip").option("maxRecordsPerFile", FILE_ROWS).json(folder)


def chunk_table_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of the documents, by way of JSON records, which go once the chunks are written."""
    folder = fresh_path(spark, "json")
    as_json(tables(spark, sf_dir, "documents")[0], folder)
    chunks = written(chunking.chunk_documents(readers.json_documents(spark, folder, lines=True)), "chunks")
    hadoop, files = at_path(spark, folder)
    files.delete(hadoop, True)
    return chunks


def chunk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From JSON documents to cited answers: chunks, their stored index, both searches, fusion, and the three best
    sections of each question with where they are printed. The chunks' texts go as soon as the index has read them."""
    (bench,) = tables(spark, sf_dir, "benchmark")
    texts = chunk_table_of(spark, sf_dir)
    chunks = written(texts.select("chunk_id", "doc_id", "source", "title", "section", "reference"), "sections")
    index = stored_index(spark, sf_dir, "chunks", lambda: texts, "chunk_id", dealt=True, texts_read=lambda: discard(texts))
    discard(texts)  # where the index was there already
    secs = chunks.select(F.col("chunk_id").alias("doc_id"), F.concat_ws("/", "doc_id", "section").alias("section"))
    top = hybrid_of(index, secs, bench).filter("rank <= 3").select("item_id", "rank", F.col("doc_id").alias("chunk_id"), "score")
    cited = written(top, "top").join(chunks.select("chunk_id", "source", "title", "section", "reference"), "chunk_id")
    return cited.select("item_id", F.col("rank").cast("long").alias("rank"), "chunk_id", "score", R.citation("reference", "source", "title", "section").alias("citation"))


def chunk_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    (docs,) = tables(spark, sf_dir, "documents")
    header = F.concat(F.lit("["), "source", F.lit("] "))
    docs = spread(docs.select("doc_id", "text", "source"))
    return docs.select("doc_id", F.posexplode(chunking.chunks_of(F.coalesce("text", F.lit("")), header)).alias("n", "chunk"))


QUERIES = {
    f.__name__: f
    for f in (tokenize_terms, doc_freq_top, index_stats, index_update, chunk_search, bm25_topk, bm25_single_terms, bm25_okapi_topk, dense_topk, hash_embed, hash_dense_topk, best_chunk_per_section, rrf_fusion, hybrid_flagship, agreement_confidence, section_siblings, filtered_hybrid, rrf_three_lists, crop_priority, corrective_retry, chunk_windows)
}

TITLE = lambda c: rf"list_distinct(list_transform(list_filter({ALL_TOK.format(c)}, lambda x: length(x) > 2 AND x NOT IN ({', '.join(repr(w) for w in STOP)})), lambda w: {STEM}))"
ONE = "CASE WHEN ends_with(w, 'ies') THEN w[:-4] || 'y' ELSE rtrim(w, 's') END"
STEM = f"CASE WHEN ends_with({ONE}, 'ing') AND length({ONE}) > 6 THEN ({ONE})[:-4] ELSE {ONE} END"
FILTERED_CTE = f"""
{DENSE_CTE}, {BM25_CTE},
k AS (SELECT doc_id, source || '/' || lang AS section, text[1:60] AS title FROM documents WHERE doc_id % 3 = 0 AND (starts_with(lower(CASE WHEN lang = 'es' THEN 'All Crops' ELSE lang || ' (lang)' END), 'en') OR lang = 'es')),
zd AS (SELECT k.doc_id, i.item_id FROM k, benchmark i),
da AS (SELECT item_id, doc_id, section, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id, section ORDER BY score DESC, doc_id) AS one
       FROM (SELECT item_id, doc_id, section, coalesce(score, 0) AS score FROM zd JOIN k USING (doc_id) LEFT JOIN ds USING (item_id, doc_id))) WHERE one = 1),
sa AS (SELECT item_id, doc_id, section, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id, section ORDER BY score DESC, doc_id) AS one FROM sc JOIN k USING (doc_id) WHERE score > 0) WHERE one = 1),
kt AS (SELECT doc_id, {TITLE('title')} AS t FROM k), bt AS (SELECT item_id, {TITLE('text')} AS q FROM benchmark),
ta AS (SELECT item_id, doc_id, section, row_number() OVER (PARTITION BY item_id ORDER BY shared DESC, rank) AS rank FROM (SELECT da.*, len(list_intersect(t, q)) AS shared FROM da JOIN kt USING (doc_id) JOIN bt USING (item_id)) WHERE shared > 0)
"""


def filtered_fuse(lists: int) -> str:
    parts = " UNION ALL ".join(f"SELECT item_id, section, doc_id, {i} AS list, rank, 1.0::DOUBLE / (60 + rank) AS part FROM {t} WHERE rank <= 5" for i, t in enumerate(("da", "sa", "ta")[:lists]))
    return f"""fu AS (SELECT item_id, section, round(sum(part), 6) AS score, min(list * 1000 + rank) AS first_seen, arg_min(doc_id, list * 1000 + rank) AS doc_id, max(CASE WHEN list = 2 THEN rank END) AS title_rank FROM ({parts}) GROUP BY item_id, section),
fr AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, first_seen) AS rank FROM fu)"""


SPARSE_OUT = "SELECT item_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM {0}) WHERE rank <= 5 AND score > 0"

def sql_search_terms(q: str, lex: Lexicon) -> str:
    """The SQL of ``rules.search_terms`` for a lexicon of ASCII terms that lead to different words."""
    english, titles = dict(lex.english), dict(lex.topic_titles)
    found = []
    for topic, words in lex.topics:
        found += [f"CASE WHEN {sql_any(q, (w,))} THEN '{english.get(w, w)}' END" for w in words]
        found += [f"CASE WHEN {sql_any(q, words)} THEN '{titles[topic]}' END"] if topic in titles else []
    return f"concat_ws(' ', {', '.join(found)})"


SURE = f"""named AS (SELECT conv_id AS item_id, nullif(crop, '') AS asked_crop, nullif(nullif(topic, ''), '{rules.GENERAL_TOPIC}') AS topic FROM ({intent_sql(RETRY_WORDS).replace("FROM conversations WHERE role = 'user'", "FROM (SELECT item_id AS conv_id, 0 AS turn, text FROM benchmark)")})),
sure AS (SELECT item_id, asked_crop, coalesce(dense_rank = 1 AND sparse_rank = 1, false) OR coalesce(contains(lower(section), lower(topic)) AND starts_with(lower(CASE WHEN d.lang = 'es' THEN 'All Crops' ELSE d.lang || ' (lang)' END), asked_crop), false) AS sure
  FROM fr JOIN documents d USING (doc_id) JOIN named USING (item_id) WHERE rank = 1),"""
RETRY_CTE = f"""{SURE}
retry AS (SELECT item_id, text FROM (SELECT item_id, concat_ws(' ', asked_crop, terms) AS text, terms, before FROM (SELECT item_id, asked_crop, {sql_search_terms('b.text', RETRY_WORDS)} AS terms, lower(trim(b.text)) AS before FROM sure JOIN benchmark b USING (item_id) WHERE NOT sure)) WHERE terms <> '' AND lower(text) <> before),
""" + re.sub(
    r"\b(qv_c|qv|ds|dl20|qt|sc|sl20|dsec|ssec|un|fu|fr)\b",
    r"\g<1>2",
    ", ".join(x.strip().rstrip(",") for x in (hash_cte("qv", "retry", "item_id"), "ds AS" + DENSE_CTE.split("ds AS")[1], "qt AS" + SPARSE_CTE.split("qt AS")[1].replace("benchmark", "retry"), "dsec AS" + FUSE_CTE.split("dsec AS")[1])),
)

TWO_PASS = f"""WITH {DENSE_CTE}, {SPARSE_CTE}, {FUSE_CTE}, {RETRY_CTE}
SELECT f.item_id, coalesce(g.doc_id, f.doc_id) AS doc_id, CASE WHEN s.sure THEN 'confident' WHEN g.doc_id IS NOT NULL THEN 'corrected' ELSE 'low_confidence' END AS status
FROM fr f JOIN sure s USING (item_id) LEFT JOIN (SELECT item_id, doc_id FROM fr2 WHERE rank = 1 AND sparse_rank = 1) g USING (item_id) WHERE f.rank = 1"""

CHUNKS_CTE = f"""
ch AS (SELECT 'd' || doc_id || '_s' || i || '_c0' AS doc_id, source, 'Document ' || doc_id AS title, 'Part ' || (i + 1) AS section, CASE WHEN i % 3 = 0 THEN 'page ' || (i + 1) END AS reference,
  'Crop: ' || lang || ' (All season)' || chr(10) || 'Source: ' || source || chr(10) || 'Topic: Part ' || (i + 1) || chr(10) || 'Recommended action: ' || text[i * {PIECE} + 1 : (i + 1) * {PIECE}] AS text
  FROM (SELECT *, unnest(range(0, (length(text) + {PIECE - 1}) // {PIECE})) AS i FROM documents))"""
OVER_CHUNKS = f"{DENSE_CTE}, {SPARSE_CTE}, {FUSE_CTE}".replace("FROM documents", "FROM ch").replace("source || '/' || lang", "doc_id")
CHUNK_SEARCH = f"""WITH {CHUNKS_CTE}, {OVER_CHUNKS}
SELECT item_id, rank, f.doc_id AS chunk_id, score, coalesce(reference, source || ' - ' || title) || ' [' || c.section || ']' AS citation FROM fr f JOIN ch c USING (doc_id) WHERE rank <= 3"""

FITTING = "coalesce(list_max(list_filter(range(1, len({0}) + 1), lambda k: length(array_to_string({0}[len({0}) - k + 1:], ' ')) <= 150)), 0)"
WINDOWS_SQL = rf"""WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS t, '[' || source || '] ' AS h FROM documents),
s AS (SELECT doc_id, h, CASE WHEN 1000 - length(h) < 100 THEN 1000 ELSE 1000 - length(h) END AS room, list_transform(list_filter(list_transform(string_split(t, '. '), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> ''), lambda x: CASE WHEN ends_with(x, '.') THEN x ELSE x || '.' END) AS s FROM d WHERE length(t) > 1000),
r AS (
  SELECT doc_id, 0 AS i, []::VARCHAR[] AS held, NULL::VARCHAR AS window_text, 0 AS n FROM s
  UNION ALL
  SELECT doc_id, i + 1, list_append(CASE WHEN NOT over THEN held WHEN whole > 0 THEN held[len(held) - whole + 1:] WHEN part > 0 THEN [array_to_string(w[len(w) - part + 1:], ' ')] ELSE [] END, x), CASE WHEN over THEN h || array_to_string(held, ' ') END, n + over::INT
  FROM (SELECT *, {FITTING.format('held')} AS whole, {FITTING.format('w')} AS part FROM (
    SELECT r.*, h, s.s[i + 1] AS x, i > 0 AND length(array_to_string(list_append(held, s.s[i + 1]), ' ')) > room AS over, list_filter(regexp_split_to_array(coalesce(held[-1], ''), '\s+'), lambda y: y <> '') AS w FROM r JOIN s USING (doc_id) WHERE i < len(s.s)))
)
SELECT doc_id, 0 AS n, t AS chunk FROM d WHERE length(t) <= 1000
UNION ALL SELECT doc_id, n - 1, window_text FROM r WHERE window_text IS NOT NULL
UNION ALL SELECT doc_id, n, h || array_to_string(held, ' ') FROM r JOIN s USING (doc_id) WHERE i = len(s.s) AND i > 0"""

SQL = {
    "chunk_windows": WINDOWS_SQL,
    "index_stats": f"WITH {BM25_CTE} SELECT n AS n_docs, (SELECT sum(len(tokens))::BIGINT FROM dt) AS n_tokens, (SELECT count(*) FROM df) AS n_terms, (SELECT count(*) FROM po) AS n_postings FROM st",
    "index_update": f"WITH {BM25_CTE} SELECT * FROM ({SPARSE_OUT.format('sc')}), (VALUES ('updated'), ('compacted')) s(state)",
    "chunk_search": CHUNK_SEARCH,
    "tokenize_terms": f"SELECT doc_id, len(t)::BIGINT AS n_tokens, len(list_distinct(t))::BIGINT AS n_terms FROM (SELECT doc_id, {TOK.format('text')} AS t FROM documents)",
    "doc_freq_top": f"SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct({TOK.format('text')})) AS term FROM documents) GROUP BY term ORDER BY df DESC, term LIMIT 50",
    "bm25_topk": f"WITH {BM25_CTE} {SPARSE_OUT.format('sc')}",
    "bm25_single_terms": f"WITH {BM25_CTE.replace('sum(qtf * ln', 'sum(ln')} {SPARSE_OUT.format('sc')}",
    "bm25_okapi_topk": "WITH "
    + BM25_CTE.replace("qt AS (", "id0 AS (SELECT term, ln(n - df + 0.5::DOUBLE) - ln(df + 0.5::DOUBLE) AS idf FROM df, st), id1 AS (SELECT term, CASE WHEN idf < 0 THEN 0.25::DOUBLE * (SELECT avg(idf) FROM id0) ELSE idf END AS idf FROM id0), qt AS (")
    .replace("ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE))", "idf")
    .replace("JOIN df USING (term), st", "JOIN id1 USING (term), st")
    + SPARSE_OUT.format("sc"),
    "dense_topk": "SELECT query_id, vec_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM (SELECT q.vec_id AS query_id, v.vec_id, round(list_dot_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score FROM embeddings q, embeddings v WHERE q.vec_id % 50 = 0 AND q.vec_id <> v.vec_id)) WHERE rank <= 5",
    "hash_embed": f"WITH {hash_cte('dv', 'documents', 'doc_id')} SELECT id AS doc_id, bucket, round(w, 6) AS w FROM dv",
    "hash_dense_topk": f"WITH {DENSE_CTE} SELECT item_id, doc_id, score, rank FROM dl20 WHERE rank <= 5",
    "best_chunk_per_section": f"WITH {SPARSE_CTE}, {FUSE_CTE.split('dsec AS')[0]} ssec AS{FUSE_CTE.split('ssec AS')[1].split('un AS')[0].rstrip().rstrip(',')} SELECT item_id, doc_id, section, score, rank FROM ssec",
    "rrf_fusion": f"WITH {DENSE_CTE}, {SPARSE_CTE}, {FUSE_CTE} SELECT item_id, section, doc_id, score, rank, coalesce(dense_rank, 0) AS dense_rank, coalesce(sparse_rank, 0) AS sparse_rank FROM fr",
    "hybrid_flagship": f"WITH {DENSE_CTE}, {SPARSE_CTE}, {FUSE_CTE} SELECT item_id, rank, doc_id, score, d.source || ' - document ' || doc_id || ' [' || section || ']' AS citation FROM fr JOIN documents d USING (doc_id) WHERE rank <= 3",
    "agreement_confidence": f"WITH {DENSE_CTE}, {SPARSE_CTE}, {FUSE_CTE} SELECT item_id, coalesce(dense_rank = 1 AND sparse_rank = 1, false) AS confident FROM fr WHERE rank = 1",
    "section_siblings": f"WITH {DENSE_CTE}, {SPARSE_CTE}, {FUSE_CTE}, ch AS (SELECT item_id, section, doc_id FROM fr WHERE rank <= 3) SELECT item_id, section, doc_id, n FROM (SELECT c.item_id, c.section, s.doc_id, row_number() OVER (PARTITION BY c.item_id, c.section ORDER BY l.rank NULLS LAST, s.doc_id) AS n FROM ch c JOIN secs s USING (section) LEFT JOIN dl20 l ON l.item_id = c.item_id AND l.doc_id = s.doc_id WHERE s.doc_id <> c.doc_id) WHERE n <= 3",
    "filtered_hybrid": f"WITH {FILTERED_CTE}, {filtered_fuse(2)} SELECT item_id, section, doc_id, score, rank FROM fr WHERE rank <= 3",
    "rrf_three_lists": f"WITH {FILTERED_CTE}, {filtered_fuse(3)} SELECT item_id, section, doc_id, score, rank, coalesce(title_rank, 0) AS title_rank FROM fr",
    "crop_priority": f"WITH {DENSE_CTE}, {SPARSE_CTE}, {FUSE_CTE}, a AS (SELECT f.*, ([ 'de', 'fr', NULL])[item_id % 3 + 1] AS asked, CASE WHEN d.lang = 'es' THEN 'all crops' ELSE d.lang || ' (lang)' END AS crop FROM fr f JOIN documents d USING (doc_id) WHERE rank <= 5), o AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY asked IS NOT NULL AND NOT starts_with(crop, asked), rank) AS again FROM a) SELECT item_id, section, doc_id, again AS rank, coalesce(again = 1 AND contains(lower(section), 'web') AND starts_with(crop, asked), false) AS named FROM o",
    "corrective_retry": TWO_PASS,
}
