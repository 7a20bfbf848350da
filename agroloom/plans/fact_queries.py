"""Registered queries on numbers, prices, places, rules and reports, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from agroloom.functions import numbers as N
from agroloom.functions import text as T
from agroloom.operators import claims as claims_of
from agroloom.operators import logs, reports, rules
from agroloom.operators.numbering import number_by_range
from agroloom.operators.review_store import ReviewStore
from agroloom.operators.spread import spread
from agroloom.sources.shared import fresh_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dose_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(l_orderkey, l_linenumber, answer, source): texts with doses made of line items and parts."""
    items = spread(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity"))
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_size")
    q, s = F.col("l_quantity").cast("int").cast("string"), F.col("p_size").cast("string")
    return items.join(parts, "l_partkey").select(
        "l_orderkey",
        "l_linenumber",
        "l_quantity",
        F.concat(F.lit("Use "), q, F.lit(" kg of "), F.col("p_name"), F.lit(" per acre in "), s, F.lit("-60 liters, again after two weeks.")).alias("answer"),
        F.concat(F.lit("Apply "), q, F.lit(" kg with "), s, F.lit(" l within second week.")).alias("source"),
    )


DOSE_CTE = """dt AS (SELECT l_orderkey, l_linenumber, 'Use ' || l_quantity::INT || ' kg of ' || p_name || ' per acre in ' || p_size || '-60 liters, again after two weeks.' AS answer,
  'Apply ' || l_quantity::INT || ' kg with ' || p_size || ' l within second week.' AS source FROM lineitem JOIN part ON p_partkey = l_partkey)"""
READABLE = r"CASE WHEN {0} >= 100 THEN printf('%.0f', {0}) WHEN {0} >= 10 THEN regexp_replace(printf('%.1f', {0}), '\.?0+$', '') ELSE regexp_replace(printf('%.2f', {0}), '\.?0+$', '') END"
UNIT_CASE = "CASE lower({0}) " + " ".join(f"WHEN '{w}' THEN '{u}'" for w, u in N.UNIT_OF.items()) + " END"


def sql_numbers(text: str, words: bool = True) -> str:
    canon = r"CASE WHEN contains(regexp_replace(x, '^0+([0-9])', '\1'), '.') THEN regexp_replace(regexp_replace(x, '^0+([0-9])', '\1'), '\.?0+$', '') ELSE regexp_replace(x, '^0+([0-9])', '\1') END"
    found = rf"list_transform(regexp_extract_all({text}, '\d+(?:\.\d+)?'), lambda x: {canon})"
    if words:
        named = ", ".join(rf"CASE WHEN regexp_matches(lower({text}), '(^|[^\p{{L}}\p{{N}}_]){w}([^\p{{L}}\p{{N}}_]|$)') THEN '{v}' END" for w, v in N.NUMBER_WORDS.items())
        found = f"list_concat({found}, list_filter([{named}], lambda x: x IS NOT NULL))"
    return f"list_sort(list_distinct({found}))"


def sql_amounts(text: str) -> str:
    pattern = N.AMOUNT.replace(N.NO_LETTER_AFTER, r"(?:[^\p{L}\p{N}_ऀ-੿]|$)")
    get = lambda i: f"regexp_extract_all({text}, '{pattern}', {i})"
    return f"""list_sort(list_distinct(flatten(list_transform(list_zip({get(1)}, {get(2)}, {get(3)}), lambda m: list_transform(list_filter([m[1], m[2]], lambda n: n <> ''), lambda n: n || ' ' || {UNIT_CASE.format('m[3]')})))))"""


def numbers_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", F.array_join(N.numbers_in(F.col("text")), ",").alias("numbers")).filter("numbers <> ''")


def amounts_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dose_text(spark, sf_dir).select("l_orderkey", "l_linenumber", F.array_join(N.amounts_in(F.col("answer")), ",").alias("amounts"))


def unbacked_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.with_unbacked(dose_text(spark, sf_dir), "answer", "source").select("l_orderkey", "l_linenumber", F.array_join("unbacked", ",").alias("unbacked"))


def dose_scaling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dose_text(spark, sf_dir).select("l_orderkey", "l_linenumber", N.scale_doses(F.col("answer"), F.lit(3.5)).alias("scaled"))


def money_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sum that a customer claims, written in four ways, against the distinct monthly sums of their orders."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.floor("o_totalprice").cast("long").alias("p"))
    number = lambda c: F.format_number(c, 0)
    forms = (
        F.concat(F.lit("They pay Rs "), number(F.col("p") * 12), F.lit(" per year, do they?")),
        F.concat(F.lit("I heard of "), number(F.col("p") * 10), F.lit(" rupees every year")),
        F.concat(F.lit("Every month "), F.col("p"), F.lit(" Rs are paid")),
        F.concat(F.lit("It gives Rs "), F.col("p"), F.lit(" thousand per month")),
    )
    claims = orders.select("o_orderkey", "o_custkey", F.element_at(F.array(*forms), (F.col("o_orderkey") % 4 + 1).cast("int")).alias("claim"))
    facts = orders.select("o_custkey", F.concat(F.lit("The order is Rs "), number(F.col("p")), F.lit(" per month")).alias("fact"))
    c = claims.select("o_orderkey", "o_custkey", F.explode(N.money_facts(F.col("claim"))).alias("c"))
    f = facts.select("o_custkey", F.explode(N.money_facts(F.col("fact"))).alias("f")).select("o_custkey", "f.rupees", "f.period")
    judged = claims_of.against_facts(c.select("o_orderkey", "o_custkey", "c.rupees", "c.period"), f, "o_custkey")
    return judged.groupBy("o_orderkey").agg(rules.claim_verdict(F.col("same"), F.col("comparable")).alias("verdict"), F.min("lowest").alias("lowest"), F.max("highest").alias("highest"))


def newest_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the newest day of each order status, five at most."""
    orders = table(spark, sf_dir, "orders").withColumn("day", F.to_date("o_orderdate"))
    newest = Window.partitionBy("o_orderstatus").orderBy(F.desc("day"))
    order = Window.partitionBy("o_orderstatus").orderBy("o_orderkey")
    top = orders.withColumn("d", F.dense_rank().over(newest)).filter("d = 1").withColumn("n", F.row_number().over(order)).filter("n <= 5")
    return top.select("o_orderstatus", "o_orderkey", F.date_format("day", "dd/MM/yyyy").alias("day"), F.col("n").cast("long").alias("n"))


#: A nation's own price needs this many customers of the segment.
LEAST_LOCAL = 10


def price_lookup_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Average balance, in whole cents, of a customer's segment in their nation if it has ``LEAST_LOCAL`` customers there,
    else in their region: the local row wins."""
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    placed = c.join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    cents = placed.withColumn("cents", F.round(F.col("c_acctbal") * 100).cast("long")).filter("cents IS NOT NULL")
    local = cents.groupBy("c_nationkey", "n_regionkey", "c_mktsegment").agg(F.sum("cents").alias("total"), F.count("*").alias("n"))
    wide = local.groupBy("n_regionkey", "c_mktsegment").agg(F.expr("sum(total) div sum(n)").alias("wide_price"))
    local = local.filter(F.col("n") >= LEAST_LOCAL).select("c_nationkey", "c_mktsegment", F.expr("total div n").alias("local_price"))
    asked = placed.select("c_custkey", "c_nationkey", "n_regionkey", "c_mktsegment")
    both = asked.join(local, ["c_nationkey", "c_mktsegment"], "left").join(wide, ["n_regionkey", "c_mktsegment"], "left")
    price = F.coalesce(F.coalesce("local_price", "wide_price") / 100, F.lit(-1.0))
    source = F.when(F.col("local_price").isNotNull(), "local").when(F.col("wide_price").isNotNull(), "region").otherwise("none")
    return both.select("c_custkey", price.alias("price"), source.alias("source"))


def eligibility_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    flag = lambda k: F.when(key % k == 0, F.lit(True)).when(key % k == 1, F.lit(False))
    e = rules.eligibility(key % 11 != 0, flag(4), [(flag(9), "pensioner"), (flag(13), "taxpayer")], flag(5))
    return c.select("c_custkey", e.alias("e")).select("c_custkey", "e.status", F.array_join("e.reasons", ",").alias("reasons"), "e.may_be_withheld")


def weather_advice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Advice of each day from the largest of the first twelve hourly values of the event stream."""
    e = table(spark, sf_dir, "events")
    hourly = e.groupBy(F.to_date("ts").alias("day"), F.hour("ts").alias("hour")).agg(F.round(F.avg("value"), 6).alias("v"))
    days = hourly.groupBy("day").agg(F.transform(F.array_sort(F.collect_list(F.struct("hour", "v"))), lambda x: x["v"]).alias("vs"))
    rain = F.round(rules.first_hours_max(F.col("vs")), 4)
    spray, irrigation = rules.weather_advice(F.col("rain"), F.element_at("vs", 1), F.element_at("vs", -1))
    return days.withColumn("rain", rain).select(F.date_format("day", "yyyy-MM-dd").alias("day"), "rain", spray.alias("spray"), irrigation.alias("irrigation"))


def fuzzy_place_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Another source's spelling of a place against the 25 nations: folded containment, the first nation wins."""
    n, s = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier")
    fold = lambda c: F.lower(F.regexp_replace(c, "[^a-zA-Z0-9]", ""))
    told = s.select("s_suppkey", fold(F.concat(F.lit("Nation "), F.col("s_nationkey").cast("string"), F.lit(" / district"))).alias("told"))
    pairs = told.join(F.broadcast(n), F.contains("told", fold(F.col("n_name"))))  # a fixed table
    return pairs.groupBy("s_suppkey").agg(F.min_by("n_name", "n_nationkey").alias("nation"))


def near_duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"))
    rows = docs.select("doc_id", F.col("lang").alias("topic"), F.md5(logs.dedupe_key(F.col("text"))).alias("key"))
    g = logs.groups(rows, "topic", "key", "doc_id", "doc_id").filter("n > 1")
    return g.select("topic", F.col("key").alias("key_md5"), "n", F.col("example").alias("first_doc"))


def quota(spark: SparkSession, sf_dir: str, first: int, last: int) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = docs.select(F.col("source").alias("topic"), F.md5(logs.dedupe_key(F.col("text"))).alias("key"), "doc_id")
    g = logs.groups(rows.withColumn("shown", F.col("key")), "topic", "key", "shown", "doc_id")
    return logs.top_per_topic(g, "topic", first, last).select("topic", "key", "n", F.col("rank").cast("long").alias("rank"))


def topic_quota_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quota(spark, sf_dir, 1, 5)


def heldout_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quota(spark, sf_dir, 6, 8)


def round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language i mod 4 by the row's number."""
    b = number_by_range(table(spark, sf_dir, "benchmark").select("item_id"), ["item_id"], name="i")
    langs = F.array(*(F.lit(x) for x in ("en", "pa", "hinglish", "hi")))
    return b.select("item_id", F.element_at(langs, (F.pmod("i", F.lit(4)) + 1).cast("int")).alias("language"))


def row_index_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two lists that belong together row by row: each page with the document at the same place."""
    pages = number_by_range(table(spark, sf_dir, "pages").select("page_id"), ["page_id"], name="i")
    docs = number_by_range(table(spark, sf_dir, "documents").select("doc_id", "lang"), ["doc_id"], name="i")
    return pages.join(docs, "i").select("i", "page_id", "doc_id", "lang")


LABEL_RULES = (("apache license|mit license", "licence"), ("@", "contact"), (r"\|", "table"), ("!!", "shouting"), ("^the ", "article"))


def label_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", logs.by_rules(F.col("text"), LABEL_RULES, "not_in_kb").alias("section"))


def log_skip_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").filter("text IS NOT NULL")
    q = T.clean_query(F.concat("text", F.lit(" ?  ?")))
    kept = docs.select("doc_id", q.alias("q"), logs.skipped(q, ("[$%&]", "!!")).alias("skip"))
    return kept.filter("NOT skip").select("doc_id", F.md5("q").alias("q_md5"))


def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    s = T.sentences(F.col("text"))
    return docs.select("doc_id", F.size(s).cast("long").alias("n"), F.md5(F.array_join(s, "\x01")).alias("digest"))


def evidence_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    s = T.evidence_sentences(F.col("text"))
    return docs.select("doc_id", F.size(s).cast("long").alias("n"), F.md5(F.array_join(s, "\x01")).alias("digest"))


SENT = r"list_filter(list_transform(regexp_split_to_array(regexp_replace(regexp_replace(text, '([.!?।])\s+', '\1' || chr(10), 'g'), '\n+', chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')"


def statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as answers: labels stand in for checks, lengths for scores."""
    d, l = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    j = d.join(l, "doc_id")
    intent = F.when(F.col("doc_id") % 10 == 0, "greeting").when(F.col("doc_id") % 10 == 1, "topic_not_covered").otherwise("crop_question")
    checks = F.filter(F.array(F.when(F.col("toxic") == 1, F.lit("unverified")), F.when(F.col("quality") == 0, F.lit("contradicted"))), lambda x: x.isNotNull())
    return j.withColumns({"intent": intent, "checks": checks, "score": F.least(F.col("n_chars") / 2000.0, F.lit(1.0))})


def evidence_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = statuses(spark, sf_dir)
    status = rules.evidence_status(F.col("intent"), F.when(F.col("lang") != "fr", F.col("source")), F.col("doc_id") % 17 == 0, F.col("doc_id") % 19 == 0, F.col("checks"), F.col("score") < 0.35, F.col("doc_id") % 7 == 0)
    return s.select("doc_id", status.alias("status"), rules.premise_status(F.col("checks")).alias("premise"))


def review_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = statuses(spark, sf_dir)
    r = rules.review_reasons(F.col("intent"), F.col("toxic") == 1, F.col("quality") == 0, F.col("doc_id") % 2 == 0, F.col("score"), F.col("doc_id") % 7 == 0, F.col("doc_id") % 23 == 0)
    return s.select("doc_id", F.array_join(r, ",").alias("reasons"))


def review_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "labels")
    q = l.select(F.when(F.col("quality") == 1, "reviewed").otherwise("pending").alias("status"), F.when(F.col("toxic") == 1, "unsafe").when(F.col("doc_id") % 3 == 0, "needs_correction").otherwise("correct").alias("verdict"))
    return reports.review_stats(q)


REVIEW_ROWS = "id long, changed long, created long, status string, verdict string"


def review_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The queue after every labelled document was submitted, judged in two later batches and compacted."""
    store = ReviewStore(spark, fresh_path(spark, "reviews"), REVIEW_ROWS)
    l = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.col("doc_id").alias("created"), "quality", "toxic")
    row = lambda changed, verdict: ("id", F.lit(changed).alias("changed"), "created", F.when(verdict.isNull(), "pending").otherwise("reviewed").alias("status"), verdict.alias("verdict"))
    store.upsert(l.select(*row(1, F.lit(None).cast("string"))))
    store.upsert(l.filter("toxic = 1 OR id % 2 = 0").select(*row(2, F.when(F.col("toxic") == 1, "unsafe").otherwise("correct"))))
    store.upsert(l.filter("quality = 0").select(*row(3, F.lit("needs_correction"))))
    store.compact(2)
    store.upsert(l.filter("id % 7 = 0").select(*row(0, F.lit("correct"))))  # late: an older state than what is there
    return store.items("reviewed").select("id", "verdict")


def hit_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = statuses(spark, sf_dir)
    return s.groupBy("source").agg(reports.hits(F.col("quality") == 1).alias("right"), reports.hits(F.col("toxic") == 1).alias("false_alarms"))


def lang_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = statuses(spark, sf_dir)
    return s.rollup("lang").agg(F.count("*").alias("n"), F.sum("quality").cast("long").alias("hits")).select(F.coalesce("lang", F.lit("all")).alias("lang"), "n", "hits")


def latency_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median and the two p95 definitions of event values by type."""
    e = table(spark, sf_dir, "events").filter("value IS NOT NULL")
    places = {"low": lambda n: F.floor((n - 1) / 2), "high": lambda n: F.ceil((n - 1) / 2), "p95_index": reports.place_of(0.95, "floor"), "p95_count": reports.place_of(0.95, "count")}
    found = reports.nth_values(e, "event_type", "value", places)
    return found.select("event_type", F.round((F.col("low") + F.col("high")) / 2, 6).alias("median"), "p95_index", "p95_count")


def stale_index_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("text"))
    old, new = d.filter("doc_id % 10 <> 3"), d.filter("doc_id % 10 <> 4").withColumn("text", F.when(F.col("doc_id") % 50 == 0, F.md5("text")).otherwise(F.col("text")))
    return reports.content_changes(old, new)


def vector_cache_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts whose vector isn't cached yet, one row each, first seen first."""
    key = F.sha1(F.concat_ws("|", F.lit("hashed"), F.lit("256"), F.col("text")))
    d = table(spark, sf_dir, "documents")
    cache = d.filter("doc_id % 3 = 0").select(key.alias("key")).distinct()
    return d.select("doc_id", key.alias("key")).groupBy("key").agg(F.min("doc_id").alias("doc_id")).join(cache, "key", "left_anti")


def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.from_json("props", "k INT")["k"].alias("k")).groupBy("k").agg(F.count("*").alias("n"))


def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    w = e.groupBy(F.window("ts", "6 hours").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return w.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", "total")


def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    s = e.groupBy("user_id", F.session_window("ts", "30 minutes").alias("s")).agg(F.count("*").alias("n"))
    return s.groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("longest"))


def page_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text blocks of pages under the heading before them: a running heading count, then one row per section."""
    p = table(spark, sf_dir, "pages")
    blocks = p.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(r"(?s)(<(?:h[1-6]|p)[^>]*>.*?</(?:h[1-6]|p)>)"), 1)).alias("pos", "block"))
    blocks = blocks.withColumn("level", F.regexp_extract("block", r"^<h([1-6])", 1)).withColumn("text", F.trim(F.regexp_replace(F.regexp_replace("block", "<[^>]*>", " "), r"\s+", " ")))
    running = F.sum(F.when(F.col("level") != "", 1).otherwise(0)).over(Window.partitionBy("page_id").orderBy("pos"))
    sections = blocks.withColumn("section", running)
    return sections.groupBy("page_id", "section").agg(F.count("*").alias("blocks"), F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "\n")).alias("digest"))


QUERIES = {
    f.__name__: f
    for f in (
        numbers_in, amounts_in, unbacked_numbers, dose_scaling, money_claims, newest_prices, price_lookup_fallback, eligibility_rules, weather_advice, fuzzy_place_join, near_duplicate_groups, topic_quota_select, heldout_slice, round_robin, row_index_join, label_rules, log_skip_filter,
        sentence_split, evidence_sentences, evidence_status, review_reasons, review_stats, review_upserts, hit_metrics, lang_rollup, latency_quantiles, stale_index_diff, vector_cache_missing, json_props, event_windows, event_sessions, page_sections,
    )
}

FLAG = lambda k: f"CASE WHEN c_custkey % {k} = 0 THEN true WHEN c_custkey % {k} = 1 THEN false END"
STATUS_CTE = "s AS (SELECT d.*, quality, toxic, CASE WHEN doc_id % 10 = 0 THEN 'greeting' WHEN doc_id % 10 = 1 THEN 'topic_not_covered' ELSE 'crop_question' END AS intent, least(n_chars / 2000.0::DOUBLE, 1.0) AS score FROM documents d JOIN labels USING (doc_id))"
HITS = lambda c: f"count_if({c}) || '/' || count(*) || ' (' || round_even(count_if({c}) * 100::DOUBLE / count(*), 0)::INT || '%)'"
KEY_SQL = "array_to_string(list_sort(list_distinct(list_filter(list_transform(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda w: w <> ''), lambda w: CASE w WHEN 'aphids' THEN 'aphid' WHEN 'rice' THEN 'paddy' WHEN 'weed' THEN 'weeds' ELSE w END), lambda w: NOT regexp_matches(w, '^(19|20)[0-9][0-9]$') AND w NOT IN (" + ", ".join(f"'{g}'" for g in logs.GENERIC) + ") AND NOT regexp_matches(w, '^(inf|regard)[a-z0-9_]*$')))), ' ')"

QUOTA_SQL = "SELECT topic, key, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY n DESC, key) AS rank FROM (SELECT source AS topic, md5(" + KEY_SQL + ") AS key, count(*) AS n FROM documents GROUP BY ALL)) WHERE rank BETWEEN {0} AND {1}"

SQL = {
    "numbers_in": rf"SELECT doc_id, numbers FROM (SELECT doc_id, array_to_string({sql_numbers('t')}, ',') AS numbers FROM (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '(?m)^\s*(?:[-*]\s*)?\d+[.)]\s+', '', 'g'), '(\d),(\d{{2,3}})([^\p{{L}}\p{{N}}_]|$)', '\1\2\3', 'g'), '(\d),(\d{{2,3}})([^\p{{L}}\p{{N}}_]|$)', '\1\2\3', 'g') AS t FROM documents)) WHERE numbers <> ''",
    "amounts_in": f"WITH {DOSE_CTE} SELECT l_orderkey, l_linenumber, array_to_string({sql_amounts('answer')}, ',') AS amounts FROM dt",
    "unbacked_numbers": f"""WITH {DOSE_CTE}, n AS (SELECT *, {sql_amounts('answer')} AS a, {sql_amounts('source')} AS sa, {sql_numbers('answer', False)} AS nu, {sql_numbers('source')} AS sn FROM dt),
      x AS (SELECT *, list_concat(list_filter(a, lambda x: NOT list_contains(sa, x)), list_filter(nu, lambda x: NOT list_contains(sn, x) AND NOT list_contains(list_transform(a, lambda y: string_split(y, ' ')[1]), x))) AS u FROM n)
      SELECT l_orderkey, l_linenumber, array_to_string(list_transform(list_sort(list_transform(u, lambda x: {{'v': string_split(x, ' ')[1]::DOUBLE, 'x': x}})), lambda p: p.x), ',') AS unbacked FROM x""",
    "money_claims": "WITH o AS (SELECT o_orderkey, o_custkey, floor(o_totalprice)::BIGINT AS p FROM orders) SELECT c.o_orderkey, CASE WHEN bool_or(c.p * (CASE c.o_orderkey % 4 WHEN 0 THEN 12 WHEN 1 THEN 10 WHEN 2 THEN 12 ELSE 12000 END) = f.p * 12) THEN 'supported' ELSE 'contradicted' END AS verdict, min(f.p)::DOUBLE AS lowest, max(f.p)::DOUBLE AS highest FROM o c JOIN o f USING (o_custkey) GROUP BY c.o_orderkey",
    "dose_scaling": f"""WITH {DOSE_CTE.replace("AS answer,", "AS answer, l_quantity::INT * 3.5::DOUBLE AS q, p_size * 3.5::DOUBLE AS s, 'Use ' || l_quantity::INT || ' kg (' AS a, ' for your 3.5 acres)' AS z, ' of ' || p_name || ' per acre in ' || p_size || '-60 liters (' AS b,")}
      SELECT l_orderkey, l_linenumber, a || ({READABLE.format('q')}) || ' kg' || z || b || ({READABLE.format('s')}) || '-210 litres' || z || ', again after two weeks.' || chr(10) || chr(10) || '_Totals are worked out for 3.5 acres._' AS scaled FROM dt""",
    "newest_prices": "SELECT o_orderstatus, o_orderkey, strftime(day, '%d/%m/%Y') AS day, n FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS n FROM (SELECT *, o_orderdate::DATE AS day, dense_rank() OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate::DATE DESC) AS d FROM orders) WHERE d = 1) WHERE n <= 5",
    "price_lookup_fallback": f"""WITH r AS (SELECT c_nationkey, n_regionkey, c_mktsegment, round(c_acctbal * 100)::BIGINT AS cents FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal IS NOT NULL),
      lo AS (SELECT c_nationkey, c_mktsegment, sum(cents)::BIGINT // count(*) AS lp FROM r GROUP BY ALL HAVING count(*) >= {LEAST_LOCAL}), wi AS (SELECT n_regionkey, c_mktsegment, sum(cents)::BIGINT // count(*) AS wp FROM r GROUP BY ALL)
      SELECT c_custkey, coalesce(coalesce(lp, wp) / 100, -1.0::DOUBLE) AS price, CASE WHEN lp IS NOT NULL THEN 'local' WHEN wp IS NOT NULL THEN 'region' ELSE 'none' END AS source FROM customer c JOIN nation ON c_nationkey = n_nationkey LEFT JOIN lo USING (c_nationkey, c_mktsegment) LEFT JOIN wi USING (n_regionkey, c_mktsegment) """,
    "eligibility_rules": f"""SELECT c_custkey, CASE WHEN c_custkey % 11 = 0 THEN 'needs_info' WHEN own IS false THEN 'not_eligible' WHEN reasons <> '' THEN 'not_eligible' WHEN own THEN 'likely_eligible' ELSE 'needs_info' END AS status,
      CASE WHEN c_custkey % 11 = 0 THEN '' WHEN own IS false THEN concat_ws(',', 'no_land', nullif(reasons, '')) ELSE reasons END AS reasons, c_custkey % 11 <> 0 AND ({FLAG(5)}) IS true AS may_be_withheld
      FROM (SELECT c_custkey, {FLAG(4)} AS own, concat_ws(',', CASE WHEN ({FLAG(9)}) IS true THEN 'pensioner' END, CASE WHEN ({FLAG(13)}) IS true THEN 'taxpayer' END) AS reasons FROM customer)""",
    "weather_advice": """WITH h AS (SELECT ts::DATE AS day, hour(ts) AS hour, round(avg(value), 6) AS v FROM events GROUP BY ALL), d AS (SELECT day, list(v ORDER BY hour) AS vs FROM h GROUP BY day)
      SELECT strftime(day, '%Y-%m-%d') AS day, rain, CASE WHEN rain > 40 THEN 'no_spray_rain' WHEN vs[1] > 15 THEN 'no_spray_wind' ELSE 'spray_ok' END AS spray, CASE WHEN rain > 50 THEN 'stop' WHEN vs[-1] > 35 THEN 'light' ELSE 'normal' END AS irrigation FROM (SELECT *, round(list_max(vs[1:12]), 4) AS rain FROM d)""",
    "fuzzy_place_join": "SELECT s_suppkey, arg_min(n_name, n_nationkey) AS nation FROM supplier, nation WHERE contains('nation' || s_nationkey || 'district', regexp_replace(lower(n_name), '[^a-z0-9]', '', 'g')) GROUP BY s_suppkey",
    "near_duplicate_groups": f"SELECT topic, md5(key) AS key_md5, count(*) AS n, min(doc_id) AS first_doc FROM (SELECT doc_id, lang AS topic, {KEY_SQL} AS key FROM documents) GROUP BY topic, key HAVING count(*) > 1",
    "topic_quota_select": QUOTA_SQL.format(1, 5),
    "heldout_slice": QUOTA_SQL.format(6, 8),
    "row_index_join": "SELECT i, page_id, doc_id, lang FROM (SELECT page_id, row_number() OVER (ORDER BY page_id) - 1 AS i FROM pages) JOIN (SELECT doc_id, lang, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents) USING (i)",
    "review_upserts": "SELECT doc_id AS id, CASE WHEN quality = 0 THEN 'needs_correction' WHEN toxic = 1 THEN 'unsafe' ELSE 'correct' END AS verdict FROM labels WHERE quality = 0 OR toxic = 1 OR doc_id % 2 = 0",
    "round_robin": "SELECT item_id, (['en', 'pa', 'hinglish', 'hi'])[(row_number() OVER (ORDER BY item_id) - 1) % 4 + 1] AS language FROM benchmark",
    "label_rules": "SELECT doc_id, CASE " + " ".join(f"WHEN regexp_matches(lower(text), '{p}') THEN '{s}'" for p, s in LABEL_RULES) + " ELSE 'not_in_kb' END AS section FROM documents",
    "log_skip_filter": r"""WITH q AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text || ' ?  ?', '\s+', ' ', 'g'), '^[ \-]+|[ \-]+$', '', 'g'), '(\s*\?)+$', '?') AS q FROM documents WHERE text IS NOT NULL)
      SELECT doc_id, md5(q) AS q_md5 FROM q WHERE NOT (regexp_matches(q, '[$%&]|!!') OR length(trim(CASE WHEN contains(q, '?') THEN string_split(q, '?')[-1] ELSE '' END)) > 25 OR length(q) < 12)""",
    "sentence_split": f"SELECT doc_id, len(s)::BIGINT AS n, md5(array_to_string(s, chr(1))) AS digest FROM (SELECT doc_id, {SENT} AS s FROM documents)",
    "evidence_sentences": rf"""SELECT doc_id, len(e)::BIGINT AS n, md5(array_to_string(e, chr(1))) AS digest FROM (SELECT doc_id, list_slice(list_filter(list_transform(range(1, len(t) + 1), lambda i: CASE WHEN list_position(t, t[i]) = i THEN t[i] END), lambda x: x IS NOT NULL), 1, 40) AS e FROM (
      SELECT doc_id, list_filter(list_transform({SENT}, lambda x: regexp_replace(x, '^[ *#\-•]+|[ *#\-•]+$', '', 'g')), lambda s: len(list_filter(regexp_split_to_array(s, '\s+'), lambda w: w <> '')) >= 4) AS t FROM documents))""",
    "evidence_status": f"WITH {STATUS_CTE} SELECT doc_id, CASE WHEN intent = 'greeting' OR doc_id % 17 = 0 THEN 'not_applicable' WHEN intent = 'topic_not_covered' OR doc_id % 19 = 0 OR lang = 'fr' THEN 'not_verified' WHEN score < 0.35 OR doc_id % 7 = 0 OR toxic = 1 THEN 'partially_verified' ELSE 'verified' END AS status, CASE WHEN quality = 0 THEN 'corrected' WHEN toxic = 1 THEN 'unverified' ELSE 'none' END AS premise FROM s",
    "review_reasons": f"WITH {STATUS_CTE} SELECT doc_id, concat_ws(',', CASE WHEN toxic = 1 THEN 'banned_pesticide' END, CASE WHEN quality = 0 THEN 'pesticide' END, CASE WHEN doc_id % 2 = 0 AND score < 0.5 THEN 'low_grounding' END, CASE WHEN intent = 'topic_not_covered' THEN 'not_covered' END, CASE WHEN doc_id % 23 = 0 THEN 'llm_numbers_replaced' END, CASE WHEN doc_id % 7 = 0 THEN 'low_retrieval_confidence' END) AS reasons FROM s",
    "review_stats": "SELECT count(*) AS total, count_if(status = 'pending')::BIGINT AS pending, count_if(status = 'reviewed')::BIGINT AS reviewed, count_if(verdict = 'correct')::BIGINT AS correct, count_if(verdict = 'needs_correction')::BIGINT AS needs_correction, count_if(verdict = 'unsafe')::BIGINT AS unsafe FROM (SELECT CASE WHEN quality = 1 THEN 'reviewed' ELSE 'pending' END AS status, CASE WHEN toxic = 1 THEN 'unsafe' WHEN doc_id % 3 = 0 THEN 'needs_correction' ELSE 'correct' END AS verdict FROM labels)",
    "hit_metrics": f"WITH {STATUS_CTE} SELECT source, {HITS('quality = 1')} AS right, {HITS('toxic = 1')} AS false_alarms FROM s GROUP BY source".replace("AS right", 'AS "right"'),
    "lang_rollup": f"WITH {STATUS_CTE} SELECT coalesce(lang, 'all') AS lang, count(*) AS n, sum(quality)::BIGINT AS hits FROM s GROUP BY ROLLUP (lang)",
    "latency_quantiles": "WITH v AS (SELECT event_type, list(value ORDER BY value) AS l, median(value) AS m FROM events WHERE value IS NOT NULL GROUP BY event_type) SELECT event_type, round(m, 6) AS median, l[floor(0.95 * (len(l) - 1))::INT + 1] AS p95_index, l[greatest(floor(0.95 * len(l))::INT, 1)] AS p95_count FROM v",
    "stale_index_diff": "WITH d AS (SELECT doc_id, md5(text) AS text FROM documents), o AS (SELECT * FROM d WHERE doc_id % 10 <> 3), n AS (SELECT doc_id, CASE WHEN doc_id % 50 = 0 THEN md5(text) ELSE text END AS text FROM d WHERE doc_id % 10 <> 4) SELECT *, 'removed' AS side FROM (SELECT * FROM o EXCEPT ALL SELECT * FROM n) UNION ALL SELECT *, 'added' FROM (SELECT * FROM n EXCEPT ALL SELECT * FROM o)",
    "vector_cache_missing": "WITH k AS (SELECT doc_id, sha1('hashed|256|' || text) AS key FROM documents) SELECT key, min(doc_id) AS doc_id FROM k WHERE key NOT IN (SELECT key FROM k WHERE doc_id % 3 = 0) GROUP BY key",
    "page_sections": r"""WITH p AS (SELECT page_id, regexp_extract_all(html, '(?s)(<(?:h[1-6]|p)[^>]*>.*?</(?:h[1-6]|p)>)', 1) AS l FROM pages), b AS (SELECT page_id, i AS pos, l[i] AS block FROM p, LATERAL (SELECT unnest(range(1, len(l) + 1)) AS i)),
      t AS (SELECT page_id, pos, regexp_matches(block, '^<h[1-6]') AS head, trim(regexp_replace(regexp_replace(block, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM b),
      r AS (SELECT *, (sum(head::INT) OVER (PARTITION BY page_id ORDER BY pos))::BIGINT AS section FROM t) SELECT page_id, section, count(*) AS blocks, md5(string_agg(text, chr(10) ORDER BY pos)) AS digest FROM r GROUP BY ALL""",
    "json_props": "SELECT json_extract_string(props, '$.k')::INT AS k, count(*) AS n FROM events GROUP BY 1",
    "event_windows": "SELECT strftime(time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '1970-01-01'), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "event_sessions": "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS s FROM g) SELECT user_id, count(*) AS sessions, max(n) AS longest FROM (SELECT user_id, s, count(*) AS n FROM s GROUP BY ALL) GROUP BY user_id",
}
