"""Registered queries on places, prices, schemes, answers and their evaluation, with their SQL (see claim_queries)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agroloom.operators import answers as A
from agroloom.operators import evaluation as E
from agroloom.operators import tools
from agroloom.plans.claim_queries import pick, sql_pick, table

FORMS = ("price in Sangrur mandi", "weather in UP please", "rain near {0} today", "{0} mein barish", "pick up at {0} farm", "wheat ka rate", "दिल्ली में मौसम", "rate in punjab")


def place_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of questions in eight forms; the place words are made of customer names."""
    c = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("q"), F.translate(F.col("c_custkey").cast("string"), "0123456789", "abcdefghij"), F.lit("pur")).alias("w"))
    texts = F.array(*(F.concat(*(x for i, part in enumerate(f.split("{0}")) for x in ((F.col("w"),) if i else ()) + (F.lit(part),))) for f in FORMS))
    said = F.element_at(texts, (F.col("c_custkey") % len(FORMS) + 1).cast("int"))
    place = tools.detect_place(said, not_places=(*tools.NOT_PLACES, "wheat"))
    return c.select("c_custkey", F.coalesce(place, F.lit("")).alias("place"), F.coalesce(tools.state_named(place), F.lit("")).alias("state"))


PLACE_SQL = """
WITH c AS (SELECT c_custkey, 'Q' || translate(c_custkey::VARCHAR, '0123456789', 'abcdefghij') || 'pur' AS w, c_custkey % 8 AS k FROM customer)
SELECT c_custkey, CASE k WHEN 0 THEN 'Sangrur' WHEN 1 THEN 'Uttar Pradesh' WHEN 5 THEN '' WHEN 6 THEN 'Delhi' WHEN 7 THEN 'Punjab' ELSE w END AS place,
  CASE k WHEN 1 THEN 'Uttar Pradesh' WHEN 7 THEN 'Punjab' ELSE '' END AS state FROM c
"""


def price_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(asked, market rows, averages): customers ask for their segment in their nation; some segments have market rows of
    some nations, one has averages in wide records only."""
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    place = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("n_name").alias("district"), F.col("r_name").alias("state"))
    who = c.join(place, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_mktsegment", "district", "state", "c_nationkey", "c_acctbal")
    asked = who.select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("commodity"), F.when(F.col("c_custkey") % 10 != 0, F.col("state")).alias("state"), "district")
    rows = who.filter("c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_nationkey % 3 <> 0 AND c_acctbal > 0")
    day = F.date_add(F.lit("2026-01-01").cast("date"), (F.col("c_custkey") % 3).cast("int"))
    base = F.floor("c_acctbal").cast("double")
    market = rows.select(F.col("c_mktsegment").alias("commodity"), "state", "district", F.lower("district").alias("district_key"), F.format_string("M%08d", "c_custkey").alias("market"), day.alias("day"), base.alias("low"), (base + 10).alias("high"), F.when(F.col("c_custkey") % 7 != 0, base + 5).alias("modal"))
    wide = who.filter("c_mktsegment = 'FURNITURE'").groupBy("c_mktsegment", "state").agg(F.max("c_custkey").alias("k"))
    wide = wide.select(F.col("c_mktsegment").alias("commodity"), "state", F.col("k").alias("p1"), (F.col("k") + 1).alias("p2"), F.lit("29 Sep, 2026").alias("d1"), F.when(F.col("k") % 2 == 0, "30 Sep, 2026").otherwise("no date").alias("d2"))
    days = tools.average_days(wide, ("p1", "p2"), ("d1", "d2"))
    average = days.select("commodity", "state", F.col("state").alias("district"), F.lit("").alias("district_key"), F.concat(F.lit("all of "), "state").alias("market"), "day", F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"), "modal")
    return asked, market, average


def market_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest prices of the first source that has any: the district's, else the state's."""
    asked, market, average = price_tables(spark, sf_dir)
    found = tools.first_source(asked, [("market", market, "no market rows"), ("average", average, "no averages")])
    shown = F.array_join(F.transform("prices", lambda p: F.concat_ws("/", p["market"], F.date_format(p["day"], "dd-MM-yyyy"), F.format_number(p["modal"], 0))), ";")
    return found.select("id", F.coalesce(shown, F.lit("")).alias("prices"), "local", F.coalesce("source", F.lit("")).alias("source"), F.coalesce("error", F.lit("")).alias("error"))


PRICE_CTE = """
w AS (SELECT c_custkey, c_mktsegment AS commodity, n_name AS district, r_name AS state, c_nationkey, c_acctbal FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
a AS (SELECT c_custkey AS id, commodity, CASE WHEN c_custkey % 10 <> 0 THEN state END AS state, district FROM w),
m AS (SELECT commodity, state, district, printf('M%08d', c_custkey) AS market, DATE '2026-01-01' + (c_custkey % 3)::INT AS day, floor(c_acctbal) AS low, floor(c_acctbal) + 5 AS modal FROM w
      WHERE commodity IN ('BUILDING', 'MACHINERY') AND c_nationkey % 3 <> 0 AND c_acctbal > 0 AND c_custkey % 7 <> 0),
v AS (SELECT state, max(c_custkey) AS k FROM w WHERE commodity = 'FURNITURE' GROUP BY state),
g AS (SELECT commodity, state, district, list({'m': market, 'd': day, 'p': modal} ORDER BY market)[1:5] AS l FROM (SELECT *, max(day) OVER (PARTITION BY commodity, state, district) AS d FROM m) WHERE day = d GROUP BY ALL),
s AS (SELECT commodity, state, list({'m': market, 'd': day, 'p': modal} ORDER BY market)[1:5] AS l FROM (SELECT *, max(day) OVER (PARTITION BY commodity, state) AS d FROM m) WHERE day = d GROUP BY ALL),
f AS (SELECT a.*, g.l AS near, coalesce(g.l, s.l) AS rows, v.k FROM a LEFT JOIN g USING (commodity, state, district) LEFT JOIN s ON s.commodity = a.commodity AND s.state = a.state LEFT JOIN v ON v.state = a.state AND a.commodity = 'FURNITURE')
"""
LOOKUP_SQL = f"""
WITH {PRICE_CTE}
SELECT id, CASE WHEN rows IS NOT NULL THEN array_to_string(list_transform(rows, lambda x: x.m || '/' || strftime(x.d, '%d-%m-%Y') || '/' || format('{{:,}}', x.p::BIGINT)), ';')
    WHEN k IS NOT NULL THEN 'all of ' || state || '/' || CASE WHEN k % 2 = 0 THEN '30-09-2026/' || format('{{:,}}', k + 1) ELSE '29-09-2026/' || format('{{:,}}', k) END ELSE '' END AS prices,
  near IS NOT NULL AS local, CASE WHEN rows IS NOT NULL THEN 'market' WHEN k IS NOT NULL THEN 'average' ELSE '' END AS source,
  CASE WHEN state IS NULL THEN 'no place given' WHEN rows IS NULL AND k IS NULL THEN 'no market rows; no averages' ELSE '' END AS error FROM f
"""


def market_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The price answer of each customer, with the support price of their segment (the fixed price table)."""
    asked, market, average = price_tables(spark, sf_dir)
    found = tools.first_source(asked, [("market", market, "no market rows"), ("average", average, "no averages")])
    msp = spark.createDataFrame([("BUILDING", 2425, 2275), ("FURNITURE", 5650, None)], "commodity string, msp long, previous long")
    rows = found.join(F.broadcast(msp), "commodity", "left")
    district = F.when(F.col("id") % 4 != 0, F.col("district"))
    return rows.select("id", A.market_answer(F.lit("en"), F.when(F.col("id") % 9 != 0, F.lower("commodity")), F.col("msp"), F.col("previous"), district, F.col("state"), F.col("prices"), F.col("local")).alias("answer"))


MARKET_SQL = f"""
WITH {PRICE_CTE}, t AS (SELECT *, CASE commodity WHEN 'BUILDING' THEN 'Support price of building: Rs 2,425.' || chr(10) || 'The season before: Rs 2,275.' WHEN 'FURNITURE' THEN 'Support price of furniture: Rs 5,650.' ELSE 'There is no support price for ' || lower(commodity) || '.' END AS head,
  CASE WHEN id % 4 <> 0 THEN district END AS place FROM f)
SELECT id, CASE WHEN id % 9 = 0 THEN 'Which crop''s price?' ELSE concat_ws(chr(10), head,
  CASE WHEN state IS NULL AND place IS NOT NULL THEN 'I do not know ' || place || '. Which district is it?' WHEN state IS NULL THEN 'Which district is it?' END,
  CASE WHEN rows IS NOT NULL THEN array_to_string(list_transform(rows, lambda x: x.m || ': Rs ' || format('{{:,}}', x.p::BIGINT) || ' (Rs ' || format('{{:,}}', (x.p - 5)::BIGINT) || ' to ' || format('{{:,}}', (x.p + 5)::BIGINT) || ')'), chr(10))
       WHEN k IS NOT NULL THEN 'all of ' || state || ': Rs ' || format('{{:,}}', CASE WHEN k % 2 = 0 THEN k + 1 ELSE k END) || ' on average' END,
  CASE WHEN (rows IS NOT NULL OR k IS NOT NULL) AND place IS NOT NULL AND near IS NULL THEN 'No rows for ' || place || '; these are for ' || state || '.' END,
  CASE WHEN state IS NOT NULL AND rows IS NULL AND k IS NULL THEN 'Market prices are not available now.' END) END AS answer FROM t
"""


def place_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State of each supplier's place: a built-in table first, then a gazetteer by equal name; and the other source's
    spelling of it."""
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    asked = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.concat(F.lit(" "), F.when(F.col("s_suppkey") % 6 == 0, "Nowhere").otherwise(F.initcap("n_name"))).alias("district"))
    own = n.filter("n_regionkey = 0").select(F.col("n_name").alias("place"), F.concat(F.lit("own "), F.col("n_regionkey").cast("string")).alias("state"))
    far = n.filter("n_regionkey < 3").select(F.col("n_name").alias("name"), F.concat(F.lit("far "), F.col("n_regionkey").cast("string")).alias("state"))
    spelled = F.concat(F.lit("Distt. "), F.upper(F.trim("district")))
    return tools.with_state(asked, own, far).select("s_suppkey", F.coalesce("state", F.lit("")).alias("state"), tools.same_place(F.col("district"), spelled).alias("same"), tools.same_place(F.lit("Bathinda"), F.concat(F.lit("Bhatinda "), F.col("district"))).alias("spelled"))


STATE_SQL = """
SELECT s_suppkey, CASE WHEN s_suppkey % 6 = 0 OR n_regionkey >= 3 THEN '' WHEN n_regionkey = 0 THEN 'own 0' ELSE 'far ' || n_regionkey END AS state, true AS same, true AS spelled
FROM supplier JOIN nation ON s_nationkey = n_nationkey
"""

SECTIONS = (("benefit", 0, ("the", "der")), ("apply", 1, ("of", "with", "and")), ("documents", 2, ("que", "in")), ("exclusions", 3, ("la", "de")), ("state", 4, ("neverused",)))


def scheme_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of a scheme for each question, and the answer made of them."""
    rows = table(spark, sf_dir, "conversations").filter("role = 'user' AND text IS NOT NULL").select(F.struct("conv_id", "turn").alias("id"), "text")
    sections = spark.createDataFrame([(n, i, list(k)) for n, i, k in SECTIONS], "section string, ord int, keywords array<string>")
    got = tools.scheme_sections(rows, sections, ("benefit", "documents"), ("state",))
    topic = F.when(F.col("id.turn") % 3 == 0, "other:Solar").when(F.col("id.turn") % 3 == 1, "KCC")
    answer = A.scheme_answer(F.lit("en"), topic, F.lit(True), F.when(F.col("id.conv_id") % 2 == 0, "You may be eligible."), F.array_join("ids", " / "))
    return got.select("id.conv_id", "id.turn", F.array_join("ids", ",").alias("ids"), "matched", answer.alias("answer"))


def scheme_sql() -> str:
    word = lambda k: rf"regexp_matches(lower(text), '(^|[^\p{{L}}\p{{N}}_]){k}([^\p{{L}}\p{{N}}_]|$)')::INT"
    listed = ", ".join(f"{{'n': {' + '.join(word(k) for k in ks)}, 'ord': -{i}, 's': '{n}'}}" for n, i, ks in SECTIONS)
    return f"""
WITH q AS (SELECT conv_id, turn, list_transform(list_reverse_sort(list_filter([{listed}], lambda h: h.n > 0))[1:3], lambda h: h.s) AS named FROM conversations WHERE role = 'user' AND text IS NOT NULL),
x AS (SELECT *, list_concat(['state'], CASE WHEN len(named) > 0 THEN named ELSE ['benefit', 'documents'] END) AS ids FROM q)
SELECT conv_id, turn, array_to_string(ids, ',') AS ids, len(named) > 0 AS matched, CASE turn % 3 WHEN 0 THEN 'Solar is not covered here.' WHEN 1 THEN concat_ws(chr(10) || chr(10), CASE WHEN conv_id % 2 = 0 THEN 'You may be eligible.' END, array_to_string(ids, ' / ')) ELSE 'Which scheme do you mean?' END AS answer FROM x
"""


def reply_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers by intent: fixed replies by language, handlers, weather by place, and rows without a question or answer."""
    c = table(spark, sf_dir, "customer").select("c_custkey", F.floor(F.abs("c_acctbal")).cast("long").alias("v"))
    key = F.col("c_custkey")
    lang = A.language_code(pick(("English", "HINDI", "pa", "klingon"), key))
    intent = pick(("greeting", "out_of_scope", "weather", "market_price", "topic_not_covered", "crop_question"), F.floor(key / 4))
    place = F.when(key % 5 != 0, F.concat(F.lit("P"), key.cast("string")))
    report = A.weather_answer(lang, place, F.when(key % 7 == 0, "Punjab"), key % 3 != 0, F.col("v") % 50, F.col("v") % 30, F.col("v") % 101, F.when(key % 2 == 0, F.array(F.lit("spray"))).otherwise(F.array().cast("array<string>")), F.lit("Do not spray."), F.lit("Water later."))
    query = F.when(key % 13 == 0, F.lit("  ")).otherwise(F.lit("q"))
    out = A.dispatched(intent, query, lang, {"weather": report["answer"], "market_price": F.lit(None).cast("string")}, F.lit("advice"))
    return c.select("c_custkey", lang.alias("lang"), out["intent"].alias("intent"), out["answer"].alias("answer"), (report["needs_place"] & (intent == "weather")).alias("needs_place"))


DISPATCH_SQL = f"""
WITH k AS (SELECT c_custkey, c_custkey AS k, floor(abs(c_acctbal))::BIGINT AS v, {sql_pick(('en', 'hi', 'pa', 'hi'), 'c_custkey')} AS lang, {sql_pick(('greeting', 'out_of_scope', 'weather', 'market_price', 'topic_not_covered', 'crop_question'), 'c_custkey // 4')} AS intent FROM customer),
w AS (SELECT *, CASE WHEN k % 7 = 0 THEN 'Punjab is a whole state. Which district?' WHEN k % 5 <> 0 AND k % 3 = 0 THEN 'I do not know P' || k || '. Which district is it?'
    WHEN k % 5 = 0 THEN CASE WHEN lang = 'hi' THEN 'कौन सा जिला?' ELSE 'Which district is it?' END END AS ask FROM k)
SELECT c_custkey, lang, CASE WHEN k % 13 = 0 THEN 'empty' WHEN intent = 'market_price' THEN 'error' ELSE intent END AS intent,
  CASE WHEN k % 13 = 0 THEN 'Please write a question.' ELSE CASE intent WHEN 'greeting' THEN CASE WHEN lang = 'hi' THEN 'नमस्ते, अपनी फसल के बारे में पूछें।' ELSE 'Hello, ask about your crop.' END
    WHEN 'out_of_scope' THEN 'I answer farming questions only.' WHEN 'topic_not_covered' THEN 'This topic is not in our advisories; ask your local centre.' WHEN 'crop_question' THEN 'advice' WHEN 'market_price' THEN 'Something went wrong; please ask again.'
    ELSE coalesce(ask, CASE WHEN lang = 'hi' THEN 'P' || k || ': ' || v % 50 || ' डिग्री, हवा ' || v % 30 || ', बारिश ' || v % 101 || '%।' ELSE 'P' || k || ': ' || v % 50 || ' degrees, wind ' || v % 30 || ' km/h, chance of rain ' || v % 101 || '%.' END
      || CASE WHEN k % 2 = 0 THEN chr(10) || chr(10) || 'Do not spray.' ELSE '' END) END END AS answer,
  intent = 'weather' AND ask IS NOT NULL AS needs_place FROM w
"""


def advisory_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Advisory answers: parsed fields of the top hit's section, the original section, and a translation over both."""
    items = table(spark, sf_dir, "lineitem").filter("l_linenumber <= 3")
    p = F.concat(F.lit("S"), (F.col("l_partkey") % 20).cast("string"))
    hits = items.select(
        F.col("l_orderkey").alias("id"), F.expr("l_linenumber * 10000000000000 + l_partkey * 1000000 + ascii(l_returnflag) * 10000 + cast(l_quantity AS long) * 100 + ascii(l_linestatus)").alias("rank"), F.lower("l_returnflag").alias("crop"), p.alias("section"),
        F.when(F.col("l_linenumber") == 2, F.concat(F.lit("parsed "), "l_linestatus")).otherwise("").alias("symptoms"), F.lit("").alias("recommended_action"), F.concat(F.lit("p"), F.col("l_quantity").cast("int").cast("string")).alias("preventive_measures"), F.lit("").alias("critical_safety_warning"),
        F.lit("whole text").alias("text"), F.when(F.col("l_orderkey") % 2 == 0, "hi").otherwise("en").alias("lang"),
    )
    sections = spark.range(10).select(F.concat(F.lit("S"), F.col("id").cast("string")).alias("section"), F.lit("N/A").alias("symptoms"), F.concat(F.lit("do "), F.col("id").cast("string")).alias("recommended_action"), F.lit("").alias("preventive_measures"), F.lit("gloves").alias("critical_safety_warning"))
    translations = spark.range(5).select(F.concat(F.lit("S"), F.col("id").cast("string")).alias("section"), F.lit("hi").alias("lang"), F.lit("शीर्षक").alias("section_title"), F.lit(None).cast("string").alias("symptoms"), F.lit("करें").alias("recommended_action"), F.lit(None).cast("string").alias("preventive_measures"), F.lit(None).cast("string").alias("critical_safety_warning"))
    return A.advisory_answer(hits, sections, translations)


ADVISORY_SQL = """
WITH h AS (SELECT l_orderkey AS id, (l_linenumber * 10000000000000 + l_partkey * 1000000 + ascii(l_returnflag) * 10000 + l_quantity::BIGINT * 100 + ascii(l_linestatus)) AS r, lower(l_returnflag) AS crop, l_partkey % 20 AS s, CASE WHEN l_linenumber = 2 THEN 'parsed ' || l_linestatus END AS sy, 'p' || l_quantity::INT AS pr FROM lineitem WHERE l_linenumber <= 3),
t AS (SELECT id, arg_min(crop, r) AS crop, arg_min(s, r) AS s FROM h GROUP BY id),
g AS (SELECT id, crop, s, arg_min(sy, r) FILTER (sy IS NOT NULL) AS sy, arg_min(pr, r) AS pr FROM h JOIN t USING (id, crop, s) GROUP BY ALL)
SELECT id, concat_ws(chr(10), crop || ' (' || CASE WHEN id % 2 = 0 AND s < 5 THEN 'शीर्षक' ELSE 'S' || s END || ')', 'How to recognise it: ' || sy,
  CASE WHEN id % 2 = 0 AND s < 5 THEN 'What to do: करें' WHEN s < 10 THEN 'What to do: do ' || s END, 'How to prevent it: ' || pr, CASE WHEN s < 10 THEN 'Warning: gloves' END) AS answer FROM g
"""


def model_drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of a model's draft: marker off, replaced where unbacked or declined; and a model's JSON, parsed."""
    c = table(spark, sf_dir, "customer").select("c_custkey")
    key = F.col("c_custkey")
    d = A.without_marker(F.concat(pick(("[NOT_FOUND] ", "", "See "), key), F.lit("use 5 g")))
    out = A.replaced(d["text"], key % 4 != 0, F.when(key % 5 == 0, F.array(F.lit("5 g"))).otherwise(F.array().cast("array<string>")), d["not_found"], F.lit("template"))
    json = F.concat(pick(("```json\n", "", "[", "nothing: "), key), F.lit('{"crop": "Wheat", "problem": "Rust", "confidence": "'), pick(("HIGH", "odd"), F.floor(key / 4)), F.lit('", "alternatives": ["a", "b", "c"]}'), pick(("\n```", "", "]", ""), key))
    p = A.parsed_model_json(json, "crop string, problem string, confidence string, alternatives array<string>")
    photo = A.photo_answer(key % 6 != 0, key % 5 != 0, key % 4 == 0, p["confidence"], key % 3 == 0, F.lit("treatment"))
    return c.select("c_custkey", out["answer"].alias("answer"), out["answer_source"].alias("answer_source"), F.coalesce(F.concat_ws(",", p["crop"], p["confidence"], F.array_join(p["alternatives"], "+")), F.lit("")).alias("parsed"), photo.alias("photo"), A.merged_message(F.when(key % 2 == 0, F.lit(" typed ")), F.lit("spoken")).alias("message"), A.profile_summary({"crop": F.when(key % 3 == 0, F.lit("wheat")), "acres": key}).alias("profile"), F.coalesce(A.only_crop(F.when(key % 2 == 0, F.array(F.lit("Wheat"), F.lit("Tea"))).otherwise(F.array(F.lit("Wheat"), F.lit("Paddy"))), ("Wheat", "Paddy")), F.lit("")).alias("only"))


DRAFT_SQL = """
WITH k AS (SELECT c_custkey, c_custkey AS k, CASE WHEN c_custkey // 4 % 2 = 0 THEN 'high' ELSE 'low' END AS conf FROM customer),
s AS (SELECT *, CASE WHEN k % 4 <> 0 AND k % 5 = 0 THEN 'numbers_replaced' WHEN k % 4 <> 0 AND k % 3 = 0 THEN 'llm_declined' WHEN k % 4 <> 0 THEN 'llm' ELSE 'template' END AS answer_source FROM k)
SELECT c_custkey, CASE WHEN answer_source <> 'llm' THEN 'template' WHEN k % 3 = 2 THEN 'See use 5 g' ELSE 'use 5 g' END AS answer, answer_source, CASE WHEN k % 4 = 3 THEN '' ELSE 'Wheat,' || conf || ',a+b' END AS parsed,
  CASE WHEN k % 6 = 0 THEN 'not_plant' WHEN k % 4 = 0 THEN 'healthy' WHEN k % 5 = 0 OR (conf = 'low' AND k % 4 <> 3) THEN 'unclear' WHEN k % 3 <> 0 THEN 'not_covered' ELSE 'treatment' END AS photo,
  CASE WHEN k % 2 = 0 THEN 'typed spoken' ELSE 'spoken' END AS message, CASE WHEN k % 3 = 0 THEN 'crop: wheat; ' ELSE '' END || 'acres: ' || k AS profile, CASE WHEN k % 2 = 0 THEN 'Wheat' ELSE '' END AS "only" FROM s
"""


def eval_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failed checks of assistant turns against expectations; a case passes only if all its turns do."""
    c = table(spark, sf_dir, "conversations").filter("role = 'assistant' AND text IS NOT NULL")
    key = F.col("conv_id") + F.col("turn")
    answer = {"intent": pick(("weather", "market_price"), key), "section": pick(("Wheat Rust", "Paddy Blast"), F.col("turn")), "shown": F.col("text"), "text": F.col("text"), "district": pick(("Moga", "Sangrur", "Delhi"), key), "eligibility": pick(("needs_info", "not_eligible"), key), "n_sources": F.col("turn") % 2}
    some = lambda n, value: F.when(key % n == 0, value)
    expect = {
        "intents": some(2, F.array(F.lit("weather"), F.lit("scheme_query"))), "section": some(3, F.lit("rust")), "any": some(4, F.array(F.lit("THE"), F.lit("der"))), "all": some(5, F.array(F.lit("e"), F.lit("on"))), "none": some(3, F.array(F.lit("zz"), F.lit("ing"))),
        "lang": some(7, pick(("en", "pa"), key)), "district": some(2, F.lit("moga")), "no_advisory": some(5, F.lit(True)), "eligibility": some(6, F.lit("needs_info")),
    }
    turns = c.select("conv_id", "turn", E.problems(answer, expect).alias("p")).withColumn("ok", F.size("p") == 0)
    done = E.cases(turns, "conv_id")
    return turns.join(done, "conv_id").select("conv_id", "turn", F.array_join("p", ",").alias("problems"), "n_failed", "passed")


EVAL_SQL = """
WITH c AS (SELECT conv_id, turn, conv_id + turn AS k, lower(text) AS t FROM conversations WHERE role = 'assistant' AND text IS NOT NULL),
p AS (SELECT conv_id, turn, concat_ws(',', CASE WHEN k % 2 = 0 AND k % 2 <> 0 THEN 'intent' END, CASE WHEN k % 3 = 0 AND turn % 2 <> 0 THEN 'section' END, CASE WHEN k % 4 = 0 AND NOT (contains(t, 'the') OR contains(t, 'der')) THEN 'answer_any' END,
  CASE WHEN k % 5 = 0 AND NOT (contains(t, 'e') AND contains(t, 'on')) THEN 'answer_all' END, CASE WHEN k % 3 = 0 AND (contains(t, 'zz') OR contains(t, 'ing')) THEN 'answer_none' END, CASE WHEN k % 7 = 0 AND k % 2 = 1 THEN 'script' END,
  CASE WHEN k % 2 = 0 AND k % 3 <> 0 THEN 'district' END, CASE WHEN k % 5 = 0 AND turn % 2 > 0 THEN 'no_advisory' END, CASE WHEN k % 6 = 0 AND k % 2 <> 0 THEN 'eligibility' END) AS problems FROM c)
SELECT conv_id, turn, problems, (count_if(problems <> '') OVER (PARTITION BY conv_id))::BIGINT AS n_failed, count_if(problems <> '') OVER (PARTITION BY conv_id) = 0 AS passed FROM p
"""


def eval_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes of questions outside the advisories by source, and hit figures over top sections."""
    d, l = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    key = F.col("doc_id")
    rows = d.join(l, "doc_id").select(
        "doc_id", "lang",
        E.outside_outcome(key % 4, F.when(key % 9 == 0, "out_of_scope").otherwise("crop_question"), key % 2 == 0, pick(("Wheat (durum)", "All crops", "Tea"), key), pick(("wheat", "pesticide"), F.floor(key / 2)), F.when(key % 5 == 0, "Tea")).alias("outcome"),
        E.hit_at(F.array(pick(("Wheat Rust", "Aphid"), key), pick(("Blast", "wheat rust"), F.floor(key / 3)), F.lit("Rot")), F.lit("wheat"), 1, True).alias("top_1"),
        F.when(key % 3 != 0, E.hit_at(F.array(F.lit("x"), pick(("Blast", "Wheat rust"), key), F.lit("wheat")), F.lit("Wheat"), 2)).alias("top_2"),
    )
    got = E.figures(rows, "outcome", ["top_1", "top_2"])
    langs = E.common_values(rows, "outcome", "lang", 2)
    return rows.groupBy("outcome").agg(F.count("*").alias("n")).join(got, "outcome").join(langs, "outcome").select("outcome", "n", "top_1", "top_2", F.col("values").alias("langs"))


OUTCOME_SQL = """
WITH r AS (SELECT d.doc_id AS k, lang FROM documents d JOIN labels USING (doc_id)),
o AS (SELECT *, ([ 'wheat (durum)', 'all crops', 'tea'])[k % 3 + 1] AS top, CASE WHEN k // 2 % 2 = 0 THEN 'wheat' WHEN k % 5 = 0 THEN 'tea' ELSE 'all crops' END AS wanted FROM r),
x AS (SELECT *, CASE WHEN k % 4 = 0 OR k % 9 = 0 THEN 'referred' WHEN k % 2 = 0 AND (starts_with(top, wanted) OR starts_with(top, 'all crops')) THEN 'right_chapter' WHEN k % 2 = 0 THEN 'wrong_chapter' ELSE 'unrelated' END AS outcome,
  false AS t1, CASE WHEN k % 3 <> 0 THEN k % 2 = 1 END AS t2 FROM o),
c AS (SELECT outcome, list(lang ORDER BY n DESC, lang)[1:2] AS langs FROM (SELECT outcome, lang, count(*) AS n FROM x WHERE lang <> '' GROUP BY ALL) GROUP BY outcome),
f AS (SELECT outcome, count(*) AS n, count_if(t1) AS h1, count(t1) AS n1, count_if(t2) AS h2, count(t2) AS n2 FROM x GROUP BY outcome)
SELECT outcome, n, CASE WHEN n1 = 0 THEN 'n/a' ELSE h1 || '/' || n1 || ' (' || round_even(h1 * 100::DOUBLE / n1, 0)::INT || '%)' END AS top_1, CASE WHEN n2 = 0 THEN 'n/a' ELSE h2 || '/' || n2 || ' (' || round_even(h2 * 100::DOUBLE / n2, 0)::INT || '%)' END AS top_2, array_to_string(langs, ', ') AS langs FROM f JOIN c USING (outcome)
"""


def eval_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token costs by return flag; whether translations keep their numbers; labels that match other than one section."""
    i = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("flag "), "l_returnflag").alias("flag"), F.col("l_orderkey").alias("k"), F.col("l_quantity").cast("int").alias("q"))
    kept = E.keeps_numbers(F.concat(F.lit("1. use "), "q", F.lit(" kg")), F.concat(F.lit("रोज "), F.when(F.col("k") % 3 == 0, F.col("q") + 1).otherwise(F.col("q")), F.lit(" किलो")))
    rows = i.select("flag", F.round(E.token_cost(F.col("q") * 100, F.col("q") * 20, 0.1, 0.4, 95.2), 6).alias("cost"), kept.alias("kept"), F.size(E.plain_numbers(F.concat(F.lit("1. use "), "q", F.lit(" kg")))).alias("n"), (F.col("q") * 100).alias("prompt"))
    out = rows.groupBy("flag").agg(F.round(F.sum("cost"), 3).alias("cost"), F.count_if("kept").alias("kept"), F.sum("n").cast("long").alias("numbers"), F.round(F.avg("prompt"), 6).alias("mean"), F.min("prompt").cast("long").alias("least"), F.max("prompt").cast("long").alias("most"))
    labels, titles = spark.createDataFrame([("flag A",), ("FLAG",), ("G N",), ("canal",)], "label string"), out.select(F.col("flag").alias("title"))
    bad = E.unclear_labels(labels, titles).agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "label", "n"))), ",").alias("unclear"))
    return out.crossJoin(F.broadcast(bad))  # one row


NUMBERS_SQL = """
WITH r AS (SELECT 'flag ' || l_returnflag AS flag, l_quantity::INT AS q, l_orderkey % 3 <> 0 AS kept FROM lineitem),
b AS (SELECT string_agg(label || '=' || n, ',' ORDER BY label) AS unclear FROM (SELECT label, count(t.flag) AS n FROM (VALUES ('flag A'), ('FLAG'), ('G N'), ('canal')) l(label) LEFT JOIN (SELECT DISTINCT flag FROM r) t ON contains(lower(t.flag), lower(label)) GROUP BY label) WHERE n <> 1)
SELECT flag, round(sum(round((q * 100 * 0.1::DOUBLE + q * 20 * 0.4::DOUBLE) / 1000000 * 95.2::DOUBLE, 6)), 3) AS cost, count_if(kept)::BIGINT AS kept, count(*) AS numbers, round(avg(q * 100), 6) AS mean, min(q * 100)::BIGINT AS least, max(q * 100)::BIGINT AS most, (SELECT unclear FROM b) AS unclear FROM r GROUP BY flag
"""

QUERIES = {f.__name__: f for f in (place_detection, market_lookup, market_answers, place_states, scheme_sections, reply_dispatch, advisory_answers, model_drafts, eval_checks, eval_outcomes, eval_numbers)}
SQL = {
    "place_detection": PLACE_SQL,
    "market_lookup": LOOKUP_SQL,
    "market_answers": MARKET_SQL,
    "place_states": STATE_SQL,
    "scheme_sections": scheme_sql(),
    "reply_dispatch": DISPATCH_SQL,
    "advisory_answers": ADVISORY_SQL,
    "model_drafts": DRAFT_SQL,
    "eval_checks": EVAL_SQL,
    "eval_outcomes": OUTCOME_SQL,
    "eval_numbers": NUMBERS_SQL,
}
