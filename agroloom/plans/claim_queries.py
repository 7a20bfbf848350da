"""Registered queries on claims and premises, with their SQL.

Questions and evidence are written from columns of the tables, in several forms; the SQL works on the columns, so it
checks that the texts are read right as well as the verdicts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from agroloom.functions import text as T
from agroloom.operators import claims as C
from agroloom.operators.spread import spread

PRODUCTS, CHEMICALS = ("actara", "tilt", "confidor"), ("hexaconazole", "endosulfan", "cypermethrin", "mancozeb")
DISEASES = ("yellow rust", "golden wilt virus", "sheath blight")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values: tuple[str, ...], key: Column) -> Column:
    return F.element_at(F.array(*(F.lit(v) for v in values)), (F.pmod(key, F.lit(len(values))) + 1).cast("int"))


def sql_pick(values: tuple[str, ...], key: str) -> str:
    return f"([{', '.join(repr(v) for v in values)}])[({key}) % {len(values)} + 1]"


def flat(checks: str | Column) -> Column:
    """Checks as text, one after the other."""
    return F.array_join(F.transform(checks, lambda c: F.concat_ws(":", c["kind"], c["status"], c["claim"])), "; ")


def price_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A price per quintal against the band of a supplier's two prices, and the sentence that contradicts it."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.floor(F.abs("s_acctbal")).cast("long").alias("p"))
    n = lambda c: F.format_number(c, 0)
    said = F.concat(F.lit("Since wheat sells at Rs "), n(F.col("p") + (F.col("s_suppkey") % 5) * 40), F.lit(" per quintal, when do I sell?"))
    proof = F.array(F.concat(F.lit("The MSP of wheat is Rs "), n(F.col("p")), F.lit(" per quintal. Paddy brings "), n(F.col("p") + 20), F.lit(" rupees a quintal.")), F.lit("A bag costs Rs 40 per acre."))
    rows = s.select("s_suppkey", F.explode(C.money_checks(said, proof)).alias("c"))
    return rows.select("s_suppkey", F.col("c.status").alias("status"), F.col("c.claim").alias("claim"), F.col("c.fact").alias("fact"))


def dose_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Doses of a product in a question against those of the evidence."""
    items = spread(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("int").alias("q"), F.col("l_partkey").alias("k")))
    asked, told = pick(PRODUCTS, F.col("k")), pick(PRODUCTS, F.col("k") + F.col("l_linenumber") % 2)
    question = F.concat(F.lit("Is "), F.col("q"), pick((" g ", " gm of ", " ml "), F.col("l_orderkey")), asked, F.lit(" per acre enough for 3 kg seed?"))
    proof = F.array(F.concat(F.lit("Spray "), F.col("q") + F.col("l_linenumber") % 3 % 2, F.lit(" grams of "), told, F.lit(" in 100 l water. Never leave "), pick((*PRODUCTS, "it"), F.col("l_orderkey")), F.lit(" open.")))
    return items.select("l_orderkey", "l_linenumber", flat(C.dose_checks(question, proof)).alias("checks"))


DOSE_SQL = f"""
WITH i AS (SELECT l_orderkey, l_linenumber, l_quantity::INT AS q, {sql_pick(PRODUCTS, 'l_partkey')} AS asked, {sql_pick(PRODUCTS, 'l_partkey + l_linenumber % 2')} AS told, {sql_pick((*PRODUCTS, 'it'), 'l_orderkey')} AS left_open,
  {sql_pick((' g ', ' gm of ', ' ml '), 'l_orderkey')} AS unit, l_linenumber % 3 % 2 AS more FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN asked = told THEN 'dose:' || CASE WHEN more = 0 AND unit <> ' ml ' THEN 'supported' ELSE 'contradicted' END || ':' || q || unit || asked
  WHEN asked = left_open THEN 'dose:unverified:' || q || unit || asked ELSE '' END AS checks FROM i
"""


def weather_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stated warmth and rain against measurements, from the event stream's values."""
    e = table(spark, sf_dir, "events").filter("value IS NOT NULL").select("event_id", F.floor(F.abs("value")).cast("int").alias("v"))
    rain, warm = F.pmod(F.col("v") * 7, F.lit(101)), F.col("v") % 45
    question = F.concat(F.lit("It is "), F.pmod(F.col("event_id"), F.lit(50)).cast("string"), pick((" degrees", "°C", " डिग्री"), F.col("event_id")), F.lit(" here, "), pick(("so it will rain, do I spray?", "kya barish hogi?", "rain today again.", "what now?"), F.col("event_id") + F.col("v")))
    return e.select("event_id", flat(C.weather_checks(question, warm.cast("double"), rain.cast("double"))).alias("checks"))


WEATHER_SQL = f"""
WITH e AS (SELECT event_id, floor(abs(value))::INT AS v FROM events WHERE value IS NOT NULL),
x AS (SELECT event_id, v * 7 % 101 AS rain, v % 45 AS warm, event_id % 50 AS said, {sql_pick((' degrees', '°C', ' डिग्री'), 'event_id')} AS unit, {sql_pick(('it will rain', '', 'rain today', ''), 'event_id + v')} AS claim FROM e)
SELECT event_id, concat_ws('; ', CASE WHEN abs(said - warm) > 5 THEN 'temperature:contradicted:' || said || unit END,
  CASE WHEN claim <> '' AND rain <= 30 THEN 'rain:contradicted:' || claim WHEN claim <> '' AND rain >= 50 THEN 'rain:supported:' || claim END) AS checks FROM x
"""


def name_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Diseases and chemicals that the evidence doesn't know."""
    c = table(spark, sf_dir, "customer").select("c_custkey")
    key = F.col("c_custkey")
    question = F.concat(F.lit("How do I treat "), pick(DISEASES, key), F.lit(" in my wheat with "), pick(CHEMICALS, F.floor(key / 3)), F.lit("?"))
    proof = F.array(F.concat(F.lit("Against YellowRust of wheat use "), pick(CHEMICALS, F.floor(key / 12)), F.lit(".")), F.when(key % 5 == 0, F.lit("Golden  Wilt Virus is spread by aphids.")).otherwise("Keep fields clean."))
    return c.select("c_custkey", flat(C.name_checks(question, proof, ("endosulfan",))).alias("checks"), C.without_claims(F.concat(question, F.lit(" It costs Rs 1,200 for 5 g tilt."))).alias("bare"))


NAME_SQL = f"""
WITH k AS (SELECT c_custkey, {sql_pick(DISEASES, 'c_custkey')} AS ill, {sql_pick(CHEMICALS, 'c_custkey // 3')} AS chem, {sql_pick(CHEMICALS, 'c_custkey // 12')} AS told FROM customer)
SELECT c_custkey, concat_ws('; ', CASE WHEN ill <> 'yellow rust' AND NOT (ill = 'golden wilt virus' AND c_custkey % 5 = 0) THEN 'disease:unknown_problem:' || ill END,
  CASE WHEN chem NOT IN ('endosulfan', told) THEN 'product:unknown_product:' || chem END) AS checks,
  'How do I treat ' || ill || ' in my wheat with ' || chem || '? It costs  for  .' AS bare FROM k
"""


def premise_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(o_orderkey, question, clause, verdict): questions that take something for granted, and a verifier's verdicts."""
    o = spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")).select("o_orderkey", F.lower("o_orderpriority").alias("who"))
    cue = pick(("Since ", "I heard that ", "Tell me: ", "क्योंकि "), F.col("o_orderkey"))
    clause = F.concat(F.lit("the state buys from "), F.regexp_replace("who", "[^a-z]+", " "), F.lit(" growers"))
    return o.select("o_orderkey", F.concat(cue, clause, F.lit(", where do I sell?")).alias("question"), clause.alias("clause"))


def premise_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clause of each premise, and its check where no verifier could judge it."""
    official = F.when(F.col("o_orderkey") % 2 == 0, F.array(F.lit("Growers may sell anywhere."))).otherwise(F.array().cast("array<string>"))
    rows = premise_cases(spark, sf_dir).select("o_orderkey", C.premise_clause(F.col("question")).alias("clause"))
    rows = rows.withColumn("checks", C.unchecked_clause(F.col("clause"), F.array().cast(C.CHECK), official))
    return rows.select("o_orderkey", "clause", flat("checks").alias("checks"), F.array_join(F.transform("checks", lambda c: c["fact"]), "").alias("facts"))


CLAUSE = "'the state buys from ' || regexp_replace(lower(o_orderpriority), '[^a-z]+', ' ', 'g') || ' growers'"
PREMISE_SQL = f"""
SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 2 THEN '' ELSE {CLAUSE} END AS clause, CASE WHEN o_orderkey % 4 = 2 THEN '' ELSE 'premise:unverified:' || {CLAUSE} END AS checks,
  CASE WHEN o_orderkey % 4 <> 2 AND o_orderkey % 2 = 0 THEN 'Growers may sell anywhere.' ELSE '' END AS facts FROM orders
"""


def premise_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of a verifier: which ones are valid, their checks, and the answer with its notes."""
    rows = premise_cases(spark, sf_dir)
    verdict = pick(("supported", "contradicted", "qualified", "not_in_evidence", "made_up"), F.floor(F.col("o_orderkey") / 2))
    raw = F.array(
        F.struct(F.concat(F.upper("clause"), F.lit("!")).alias("claim"), verdict.alias("verdict"), F.when(F.col("o_orderkey") % 3 == 0, F.array(F.lit(9), F.lit(2))).otherwise(F.array(F.lit(0))).alias("evidence")),
        F.struct(F.lit("where do I sell").alias("claim"), F.lit("contradicted").alias("verdict"), F.array(F.lit(1)).alias("evidence")),
        F.struct(F.lit("nobody said this").alias("claim"), F.lit("contradicted").alias("verdict"), F.array(F.lit(1)).alias("evidence")),
    )
    proof = F.array(F.lit("One may sell to anybody."), F.lit("The state buys a part only."))
    done = F.when(F.col("o_orderkey") % 7 == 0, F.array(F.lit("The state buys"))).otherwise(F.array().cast("array<string>"))
    checks = C.premise_checks(C.judged_premises(F.col("question"), raw, F.size(proof), done), proof)
    rows = rows.select("o_orderkey", checks.alias("checks"))
    return rows.select("o_orderkey", flat("checks").alias("checks"), C.with_notes(F.lit("Ask the centre."), F.col("checks")).alias("answer"))


PREMISE_VERDICT_SQL = f"""
WITH v AS (SELECT o_orderkey, upper({CLAUSE}) AS claim, {sql_pick(('supported', 'contradicted', 'qualified', 'not_in_evidence', 'made_up'), 'o_orderkey // 2')} AS verdict, o_orderkey % 3 = 0 AS cited, o_orderkey % 7 = 0 AS done FROM orders),
k AS (SELECT *, NOT done AND verdict <> 'made_up' AND (cited OR verdict NOT IN ('contradicted', 'qualified')) AS kept FROM v)
SELECT o_orderkey, CASE WHEN kept THEN 'premise:' || CASE verdict WHEN 'not_in_evidence' THEN 'unverified' ELSE verdict END || ':' || claim ELSE '' END AS checks,
  CASE WHEN kept AND verdict IN ('contradicted', 'qualified') THEN 'Correction: you wrote "' || claim || '". The source says: The state buys a part only.' || chr(10) || chr(10)
       WHEN kept AND verdict = 'not_in_evidence' THEN 'Not confirmed: our sources do not say whether "' || claim || '" holds.' || chr(10) || chr(10) ELSE '' END || 'Ask the centre.' AS answer FROM k
"""


def localized_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fact's sentence in another language, found by its numbers."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("int").alias("s"))
    fact = F.concat(F.lit("Use "), "s", F.lit(" kg in 100 litres."))
    other = F.array(F.concat(F.col("s"), F.lit(" दिन रुकें। 100 लीटर में "), F.when(F.col("p_partkey") % 3 == 0, F.col("s") + 1).otherwise(F.col("s")), F.lit(" किलो डालें।")))
    return p.select("p_partkey", C.localized(fact, other).alias("fact"))


LOCALIZED_SQL = """SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 AND p_size + 1 <> 100 AND p_size <> 100 THEN 'Use ' || p_size || ' kg in 100 litres.' ELSE '100 लीटर में ' || p_size || ' किलो डालें।' END AS fact FROM part"""


def evidence_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many numbers a document's sentences state in all (a set over all its sources), and the share of its title's
    words (the first five) that its evidence holds."""
    d = table(spark, sf_dir, "documents").filter("text IS NOT NULL")
    words = F.slice(T.all_tokens(F.col("text")), 1, 5)
    rest = F.slice(T.all_tokens(F.col("text")), 6, 1 << 20)
    return d.select("doc_id", F.size(F.array_intersect(words, rest)).cast("long").alias("shared"), (F.size(F.array_except(words, rest)) == 0).alias("contained"))


QUERIES = {f.__name__: f for f in (price_claims, dose_claims, weather_claims, name_claims, premise_clauses, premise_verdicts, localized_facts, evidence_facts)}

TOKENS = r"list_filter(regexp_split_to_array(regexp_replace(lower(text), '[\p{P}\p{S}\p{C}]', ' ', 'g'), '[\s\p{Z}]+'), lambda x: x <> '')"
SQL = {
    "price_claims": """
WITH s AS (SELECT s_suppkey, floor(abs(s_acctbal))::BIGINT AS p, s_suppkey % 5 * 40 AS more FROM supplier)
SELECT s_suppkey, CASE WHEN p + more <= (p + 20) * 1.05::DOUBLE THEN 'supported' ELSE 'contradicted' END AS status, 'Rs ' || format('{:,}', p + more) || ' per quintal' AS claim,
  CASE WHEN p + more <= (p + 20) * 1.05::DOUBLE THEN '' ELSE 'The MSP of wheat is Rs ' || format('{:,}', p) || ' per quintal.' END AS fact FROM s""",
    "dose_claims": DOSE_SQL,
    "weather_claims": WEATHER_SQL,
    "name_claims": NAME_SQL,
    "premise_clauses": PREMISE_SQL,
    "premise_verdicts": PREMISE_VERDICT_SQL,
    "localized_facts": LOCALIZED_SQL,
    "evidence_facts": f"SELECT doc_id, len(list_intersect(list_distinct(t[1:5]), t[6:]))::BIGINT AS shared, len(list_filter(t[1:5], lambda x: NOT list_contains(t[6:], x))) = 0 AS contained FROM (SELECT doc_id, {TOKENS} AS t FROM documents WHERE text IS NOT NULL)",
}
