"""The registered queries of this package: each operator over its whole table, and its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from agroloom.llm import alignment, bpe, chat, exact_dedup, jaccard_join, merkle, packing, pieces, pii, quality, suffix_dedup, topk_search, toxicity
from agroloom.llm.common import documents
from agroloom.llm.labelled import remainder
from agroloom.llm.tokenization import public_path

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which row of each group of equal texts stays."""
    groups = exact_dedup.exact_groups(documents(spark, sf_dir))
    return groups.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("text_sha256")).alias("text_sha256"))


OP1_SQL = f"""
WITH t AS (SELECT doc_id, sha256(translate(coalesce(text, ''), '{UPPER}', '{LOWER}')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY text_sha256) AS kept, text_sha256
FROM t
"""


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best rows by integer inner product for every row whose id is divisible by 20."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return topk_search.top_k(vectors, F.col("vec_id") % 20 == 0, 20)


OP2_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
), r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text and the text they decode to, as digests."""
    path = public_path("byte_bpe_50k.json")
    both = bpe.decode(bpe.encode(documents(spark, sf_dir), path), path)
    return both.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The maximal conversations, rendered."""
    return chat.collapse(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


OP4_SQL = f"""
WITH c AS (
  SELECT conv_id, list({{'turn': turn, 'role': coalesce(role, ''), 'text': coalesce(text, '')}} ORDER BY turn, role, text) AS t
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), k AS (SELECT conv_id, t, list_transform(t, lambda x: {{'role': x.role, 'text': x.text}}) AS s FROM c),
proper AS (SELECT DISTINCT list_slice(s, 1, n) AS s FROM k, LATERAL (SELECT unnest(range(1, len(s))) AS n)),
full_ AS (SELECT s, min(conv_id) AS conv_id, count(*) AS n_same FROM k GROUP BY s)
SELECT f.conv_id, len(f.s)::INTEGER AS n_turns, f.n_same,
       array_to_string(list_transform(f.s, lambda x: '{chat.OPEN}' || x.role || chr(10) || x.text || '{chat.CLOSE}' || chr(10)), '') AS rendered
FROM full_ f WHERE NOT EXISTS (SELECT 1 FROM proper p WHERE p.s = f.s)
"""


def span_text(spans: str) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def is_kind(kind: str) -> Callable[[Column], Column]:
    return lambda k: k == kind


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every whole text: counts and digest of the base spans, and all selected spans."""
    docs = documents(spark, sf_dir)
    found = pii.find(docs, pii.fit(docs))
    counts = [F.size(F.filter(F.col("base")["kind"], is_kind(k))).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(span_text("base"), 256).alias("base_sha256"), span_text("spans").alias("spans"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of each document's shingle set, and the component of its near-duplicate links."""
    return jaccard_join.jaccard_components(documents(spark, sf_dir))


def judged(scores: DataFrame, parts: int, held_out: int, threshold: float) -> DataFrame:
    held = F.coalesce(remainder(F.col("doc_id"), parts) == held_out, F.lit(False))
    return scores.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every whole text."""
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return judged(toxicity.score(docs, toxicity.fit(docs, labels)), 4, 2, 0.3)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every whole text."""
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return judged(quality.score(docs, quality.fit(docs, labels)), 3, 1, 0.5)


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What goes of each document as a repeat of 100 bytes or more, and a digest of what stays."""
    cut = suffix_dedup.cut_repeats(documents(spark, sf_dir))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return cut.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the packed sequences."""
    pieces = packing.pack(documents(spark, sf_dir), public_path("word_bpe_49k.json"))
    return pieces.withColumn("ids", F.crc32("ids")).withColumnRenamed("ids", "ids_crc32")


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of the documents, with every second row's line ends gone when it is checked."""
    docs = documents(spark, sf_dir)
    rows = merkle.manifest(docs, merkle.without_lines(docs))
    return rows.select("doc_id", "leaf", "subroot", "root", F.sha2("proof", 256).alias("proof_sha256"), "folded_root", "verified")


def spelled_sql(text: str) -> str:
    parts = (f"coalesce(octet_length(encode({c}::VARCHAR)) || ':' || {c}::VARCHAR, '-')" for c in ("doc_id", "source", "lang", "n_chars", text))
    return f"sha256(concat({', '.join(parts)}))"


#: CRC-32 of decimal digits, bit by bit.
CRC_SQL = """xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: ord((doc_id::VARCHAR)[i])::BIGINT)),
  lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)), 4294967295::BIGINT)"""

OP11_SQL = f"""
WITH RECURSIVE raw AS (
  SELECT doc_id, source, {spelled_sql('text')} AS leaf, CASE WHEN {CRC_SQL} % 2 = 0 THEN {spelled_sql("replace(text, chr(10), '')")} END AS other FROM documents
), l AS (
  SELECT coalesce('=' || source, '') AS src, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n, doc_id, leaf, coalesce(other, leaf) AS other FROM raw
), tree AS (
  SELECT src, 0 AS level, pos, n, leaf AS digest FROM l
  UNION ALL
  SELECT src, level + 1, pos // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY pos)) FROM tree WHERE n > 1 GROUP BY src, level, pos // 3, n
), sub AS (SELECT src, digest AS subroot, row_number() OVER (ORDER BY src) - 1 AS pos, count(*) OVER () AS n FROM tree WHERE n = 1),
above AS (
  SELECT 0 AS level, pos, n, subroot AS digest FROM sub
  UNION ALL
  SELECT level + 1, pos // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY pos)) FROM above WHERE n > 1 GROUP BY level, pos // 3, n
), root AS (SELECT digest AS root FROM above WHERE n = 1),
low AS (SELECT src, level, pos // 3 AS run, list(digest ORDER BY pos) AS nodes FROM tree WHERE n > 1 GROUP BY ALL),
high AS (SELECT level, pos // 3 AS run, list(digest ORDER BY pos) AS nodes FROM above WHERE n > 1 GROUP BY ALL),
walk AS (
  SELECT doc_id, leaf, l.src, 0 AS level, l.pos, false AS over, '' AS proof, l.other AS node, l.n FROM l
  UNION ALL
  SELECT doc_id, leaf, w.src, CASE WHEN w.n = 1 THEN 0 ELSE w.level + 1 END, CASE WHEN w.n = 1 THEN s.pos ELSE w.pos // 3 END, w.over OR w.n = 1,
         CASE WHEN w.n = 1 THEN proof ELSE proof || array_to_string(x.nodes[:w.pos % 3], '') || array_to_string(x.nodes[w.pos % 3 + 2:], '') END,
         CASE WHEN w.n = 1 THEN node ELSE sha256(array_to_string(x.nodes[:w.pos % 3], '') || node || array_to_string(x.nodes[w.pos % 3 + 2:], '')) END,
         CASE WHEN w.n = 1 THEN s.n ELSE (w.n + 2) // 3 END
  FROM walk w JOIN sub s USING (src)
  LEFT JOIN (SELECT src, false AS over, level, run, nodes FROM low UNION ALL SELECT s2.src, true, level, run, nodes FROM high, sub s2) x ON x.src = w.src AND x.over = w.over AND x.level = w.level AND x.run = w.pos // 3
  WHERE NOT (w.over AND w.n = 1)
)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, node AS folded_root, node = root AS verified FROM walk JOIN sub USING (src), root WHERE over AND walk.n = 1
"""


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the tokens of two public vocabularies meet in every text, and how common their pairs are."""
    rows = alignment.align(documents(spark, sf_dir), public_path("byte_bpe_50k.json"), public_path("piece_bpe_32k.model"))
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    rows = alignment.scored(rows.withColumn("groups_sha256", digest).drop("groups"))
    return rows.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op13_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SentencePiece ids of every whole text and the text they decode to, as digests."""
    path = public_path("piece_bpe_32k.model")
    both = pieces.decode(pieces.encode(documents(spark, sf_dir), path), path)
    spelled = F.array_join(F.col("ids").cast("array<string>"), ",")
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(spelled, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_exact_dedup": op1_exact_dedup,
        "op2_topk": op2_topk,
        "op3_bpe": op3_bpe,
        "op4_chat": op4_chat,
        "op5_pii": op5_pii,
        "op6_jaccard_join": op6_jaccard_join,
        "op7_toxicity": op7_toxicity,
        "op8_quality": op8_quality,
        "op9_suffix_dedup": op9_suffix_dedup,
        "op10_packing": op10_packing,
        "op11_merkle": op11_merkle,
        "op12_alignment": op12_alignment,
        "op13_sentencepiece": op13_sentencepiece,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_dedup": OP1_SQL, "op2_topk": OP2_SQL, "op4_chat": OP4_SQL, "op11_merkle": OP11_SQL}
