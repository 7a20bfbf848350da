"""Registered queries on questions and conversations, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agroloom.functions import lexicon as L
from agroloom.functions import text as T
from agroloom.operators import dialog, rules, terms
from agroloom.streaming import keyed

#: The classifier's lexicon on the invented prose of the driver's tables: frequent words stand in for farming terms.
STAND_IN = L.Lexicon(
    greeting=("in", "then"),
    other_schemes=(("Alpha", ("ofthe", "erthan")),),
    schemes=(("Beta", ("thanon",)), ("Gamma", ("onthe", "ouan"))),
    scheme_words=("einen",),
    market=("est", "aux"),
    not_market=("the est",),
    off_topic=("por",),
    places=(("Norden", ("von", "ing")), ("Sur", ("sur", "del"))),
    crops=(("Wheat", ("the", "der")), ("Paddy", ("and", "und")), ("Cotton", ("la", "le"))),
    uncovered_crops=(("Tea", ("que", "dans")),),
    pests=(("Aphid", ("with", "mit")), ("Rust", ("from", "pour")), ("Borer", ("this",))),
    pest_crops=(("Aphid", ("Wheat",)), ("Rust", ("Wheat", "Cotton")), ("Borer", ("Paddy",))),
    time=("at", "als"),
    spray=("on", "auf"),
    repeat_spray=("on the",),
    water_spray=("water",),
    weather=("ouin", "sten"),
    safety=("was",),
    banned=(("monocrotophos", ("reou",)),),
    gaps=(("weeds", ("he", "ou")), ("varieties", ("er",))),
    actions=("sh",),
    farming=("tion",),
    pronouns=("is", "it"),
    scheme_follow_up=("of", "de"),
    irrigation=("un", "ein"),
    topics=(("weeds", ("he", "ou")), ("varieties", ("er",))),
    topic_titles=(("weeds", "weed control"),),
    english=(("er", "variety"),),
)


def sql_any(text: str, terms: tuple[str, ...]) -> str:
    """The SQL of ``any_term`` for ASCII terms."""
    return r"regexp_matches(lower(" + text + r"), '(^|[^\p{L}\p{N}_])(" + "|".join(terms) + r")([^\p{L}\p{N}_]|$)')"


def sql_sub(text: str, parts: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains(lower({text}), '{p}')" for p in parts) + ")"


def sql_first(text: str, entries: L.Entries) -> str:
    return "CASE " + " ".join(f"WHEN {sql_any(text, terms)} THEN '{name}'" for name, terms in entries) + " END"


def sql_longest(text: str, entries: L.Entries, greatest: bool = True) -> str:
    found = [f"CASE WHEN {sql_any(text, (t,))} THEN {{'size': {len(t)}, 'ord': {0 if greatest else -i}, 'name': '{name}'}} END" for i, (name, terms) in enumerate(entries) for t in terms]
    return f"(list_max(list_filter([{', '.join(found)}], lambda x: x IS NOT NULL))).name"


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/conversations.parquet").filter("role = 'user'")


def intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.classify(users(spark, sf_dir), lex=STAND_IN)


def intent_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intents(spark, sf_dir).select("conv_id", "turn", "intent", F.col("confidence").cast("double").alias("confidence"), F.coalesce("crop", F.lit("")).alias("crop"), F.coalesce("topic", F.lit("")).alias("topic"), F.coalesce("place", F.lit("")).alias("place"))


def intent_sql(lex: L.Lexicon) -> str:
    a = lambda terms: sql_any("q", terms)
    covered = " OR ".join(f"(pest = '{n}' AND crop IN ({', '.join(repr(c) for c in cs)}))" for n, cs in lex.pest_crops)
    return f"""
WITH u AS (SELECT conv_id, turn, trim(lower(coalesce(text, '')), chr(10) || chr(13) || chr(9) || ' ') AS q FROM conversations WHERE role = 'user'),
m AS (SELECT *, {sql_first('q', lex.crops)} AS crop, {sql_first('q', lex.places)} AS place, {sql_longest('q', lex.pests)} AS pest, {sql_first('q', lex.other_schemes)} AS other_scheme,
  {sql_longest('q', lex.schemes)} AS scheme, {sql_first('q', lex.gaps)} AS gap_word, {sql_first('q', lex.uncovered_crops)} AS uncovered FROM u),
g AS (SELECT *, CASE WHEN pest IS NULL THEN gap_word WHEN crop IS NOT NULL AND NOT coalesce({covered}, false) THEN lower(pest) || ' in ' || lower(crop) END AS gap FROM m),
r AS (SELECT *, CASE
  WHEN {a(lex.greeting)} AND len(list_filter(regexp_split_to_array(q, '\\s+'), lambda w: w <> '')) <= 4 THEN 1
  WHEN other_scheme IS NOT NULL OR scheme IS NOT NULL OR {a(lex.scheme_words)} THEN 2
  WHEN {a(lex.market)} AND NOT {a(lex.not_market)} THEN 3
  WHEN {a(lex.off_topic)} THEN 4
  WHEN (pest IS NULL AND {a(lex.time)} AND NOT {a(lex.repeat_spray)} AND ({a(lex.spray)} OR {a(lex.water_spray)})) OR {a(lex.weather)} THEN 5
  WHEN {a(lex.safety)} OR {sql_first('q', lex.banned)} IS NOT NULL THEN 6
  WHEN crop IS NULL AND uncovered IS NOT NULL THEN 7
  WHEN gap IS NOT NULL THEN 8
  WHEN pest IS NOT NULL OR (crop IS NOT NULL AND {sql_sub('q', lex.actions)}) THEN 9
  WHEN crop IS NOT NULL OR {sql_sub('q', lex.farming)} THEN 10 ELSE 11 END AS rule FROM g)
SELECT conv_id, turn,
  (['greeting', 'scheme_query', 'market_price', 'out_of_scope', 'weather', 'safety_query', 'crop_not_covered', 'topic_not_covered', 'crop_question', 'general_agriculture', 'general_agriculture'])[rule] AS intent,
  ([0.98, 0.93, 0.92, 0.92, 0.96, 0.95, 0.9, 0.85, 0.94, 0.88, 0.70])[rule]::DOUBLE AS confidence,
  CASE WHEN rule IN (5, 6, 8, 9, 10, 11) THEN coalesce(crop, '') ELSE '' END AS crop,
  coalesce(CASE rule WHEN 2 THEN coalesce('other:' || other_scheme, scheme) WHEN 3 THEN '{rules.MARKET_TOPIC}' WHEN 5 THEN '{rules.WEATHER_TOPIC}' WHEN 6 THEN pest WHEN 7 THEN uncovered
    WHEN 8 THEN gap WHEN 9 THEN pest WHEN 10 THEN coalesce(pest, '{rules.GENERAL_TOPIC}') WHEN 11 THEN pest END, '') AS topic,
  CASE WHEN rule IN (3, 5, 6, 8, 9, 10, 11) THEN coalesce(place, '') ELSE '' END AS place
FROM r
"""


def previous_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return rows.select("conv_id", "turn", F.coalesce(dialog.previous("role"), F.lit("")).alias("previous_role"), F.coalesce(dialog.previous("turn"), F.lit(-1)).alias("previous_turn"))


def last_matching_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    holds = (F.col("role") == "user") & L.any_term(F.col("text"), ("the", "der"))
    return rows.select("conv_id", "turn", F.coalesce(dialog.last_where(holds, F.col("turn")), F.lit(-1)).alias("last_turn"))


def recent_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return rows.select("conv_id", "turn", F.array_join(dialog.recent(F.concat_ws(": ", "role", "text")), "\n").alias("history"))


def query_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The question with its crop and topic, where it doesn't name them already."""
    rows = intents(spark, sf_dir).filter("crop IS NOT NULL OR topic IS NOT NULL")
    q = F.coalesce("text", F.lit(""))
    add = lambda c: F.when(F.col(c).isNotNull() & ~F.contains(F.lower(q), F.lower(c)), F.col(c))
    return rows.select("conv_id", "turn", F.concat_ws(" ", q, add("crop"), add("topic")).alias("search"))


def dialog_state_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user turn with the crop, topic and place of earlier turns where it goes on from them, and the rule that decided."""
    out = dialog.resolved(intents(spark, sf_dir), lex=STAND_IN)
    blank = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return out.select("conv_id", "turn", "intent", blank("crop"), blank("topic"), blank("place"), blank("follow_up_of"), "rule")


def language_script(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    t = F.col("text")
    return rows.select("doc_id", T.language(t).alias("detected"), T.in_script(t, F.col("lang")).alias("in_script"), t.rlike("[^\\x00-\\x7F]").alias("non_ascii"))


def lexicon_match_word(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return rows.select("doc_id", F.array_join(L.all_matches(F.col("text"), STAND_IN.pests), ",").alias("names"))


def first_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return rows.select("doc_id", F.coalesce(L.first_match(F.col("text"), STAND_IN.crops), F.lit("")).alias("crop"))


def longest_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return rows.select("doc_id", F.coalesce(L.longest_match(F.col("text"), STAND_IN.pests, "greatest"), F.lit("")).alias("pest"), F.coalesce(L.longest_match(F.col("text"), STAND_IN.crops, "first"), F.lit("")).alias("crop"))


def banned_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = L.all_matches(F.col("text"), (("one", ("idiot", "moron")), ("two", ("trash",)), ("three", ("clown", "scum"))))
    return rows.select("doc_id", (F.size(names) > 0).alias("flagged"), F.array_join(names, ",").alias("found")).filter("flagged")


def safety_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    notes = rules.safety_notes(F.coalesce(dialog.previous("text"), F.lit("")), F.col("text"), ("with", "this"), ("onth", "sche", "ml"))
    return rows.select("conv_id", "turn", "role", notes.alias("notes")).filter("role = 'assistant'").select("conv_id", "turn", F.array_join("notes", ",").alias("notes"))


def grounding_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of an assistant's turn is found in the turns before it."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    context = F.array_join(F.collect_list("text").over(dialog.earlier()), " ")
    out = rows.select("conv_id", "turn", "role", rules.grounding(F.col("text"), context).alias("g")).filter("role = 'assistant'")
    return out.select("conv_id", "turn", "g.grounded", "g.ratio")


def topic_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The topics that documents name, in search words; which weather advice they ask for; whether they point back."""
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("text IS NOT NULL")
    return rows.select("doc_id", rules.search_terms(F.col("text"), STAND_IN).alias("terms"), F.array_join(rules.weather_topics(F.col("text"), STAND_IN), ",").alias("advice"), rules.refers_back(F.lit("topic_not_covered"), F.col("text"), STAND_IN).alias("back"))


def lexicon_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(term): all search tokens of four characters or more that the conversations use."""
    talk = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return talk.select(F.explode(T.search_tokens(F.col("text"))).alias("term")).filter(F.length("term") >= 4).distinct()


def term_table_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many terms of a lexicon of thousands occur in each document, and a digest of them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("id"), "text")
    found = terms.found_terms(docs, lexicon_terms(spark, sf_dir))
    return found.groupBy(F.col("id").alias("doc_id")).agg(F.count("*").alias("n"), F.md5(F.array_join(F.array_sort(F.collect_list("term")), ",")).alias("digest"))


def unknown_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of each question (its first two words, and its third and fourth turned round) that no document of the asked
    language mentions, white space aside."""
    docs, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    word = lambda n: F.try_element_at(F.split(F.lower("text"), r"\s+"), F.lit(n))
    crop = F.element_at(F.array(F.lit("EN"), F.lit("de"), F.lit(None).cast("string")), (F.pmod("item_id", F.lit(3)) + 1).cast("int"))
    asked = bench.select("item_id", crop.alias("crop"), F.explode(F.array(F.struct(F.concat_ws(" ", word(1), word(2), word(5)).alias("name"), F.concat_ws(" ", word(2), word(5)).alias("short")), F.struct(F.concat_ws(" ", F.reverse(word(3)), word(4)).alias("name"), F.concat_ws(" ", word(4), word(3)).alias("short")))).alias("n")).select("item_id", "crop", "n.*")
    found = terms.unknown_names(asked, docs.select(F.col("lang").alias("crop"), "text"))
    return found.select("item_id", F.array_join("unknown", ",").alias("unknown"))


def source_breaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of each source (an event type), some of which failed: those less than 600 s after a failed one are skipped,
    and what is skipped can't fail."""
    calls = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type", "event_id", "ts", (F.col("value") < 60).alias("ok"))
    return keyed.in_batch(calls, "event_type", "ts", "event_id", keyed.breaker("event_type", ("event_id",)), "event_type string, event_id long, skipped boolean")


def entry_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of each user, served from the entry that was fetched for the user while it is younger than 24 hours."""
    asked = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_id", "ts", F.col("event_id").alias("fresh"))
    return keyed.in_batch(asked, "user_id", "ts", "event_id", keyed.cache("user_id", ("event_id",)), "user_id long, event_id long, fetched boolean, value long")


QUERIES = {
    f.__name__: f
    for f in (source_breaker, entry_cache, term_table_match, unknown_names, intent_cascade, previous_turn, last_matching_turn, recent_history, query_expansion, dialog_state_exact, topic_terms, language_script, lexicon_match_word, first_alias, longest_alias, banned_scan, safety_notes, grounding_ratio)
}

INTENT_SQL = intent_sql(STAND_IN)


def state_sql(lex: L.Lexicon) -> str:
    """The same rules as a recursion over the turns of each conversation."""
    word = lambda terms: sql_any("text", terms)
    general = "('crop_question', 'general_agriculture', 'safety_query', 'image_diagnosis')"
    real = lambda c: f"nullif({c}, '{rules.GENERAL_TOPIC}')"
    title = r"array_to_string(list_transform(regexp_extract_all(trim(text, ' ?.!,'), '\p{L}+|[^\p{L}]+'), lambda x: upper(x[1]) || lower(x[2:])), '')"
    remember = """intent AS p_intent, coalesce(nullif(topic, 'Agronomy/General'), topic) AS p_topic, place AS p_place, text AS p_text, intent IN ('market_price', 'weather') AND place IS NULL AS wait"""
    return f"""
WITH RECURSIVE i AS (SELECT conv_id, turn, intent, confidence, nullif(crop, '') AS crop, nullif(topic, '') AS topic, nullif(place, '') AS place FROM ({INTENT_SQL})),
u AS (SELECT i.*, c.text, row_number() OVER (PARTITION BY i.conv_id ORDER BY i.turn) AS n, len(list_filter(regexp_split_to_array(coalesce(c.text, ''), '\\s+'), lambda w: w <> '')) AS words,
  coalesce({word(lex.pronouns)}, false) AS refers, coalesce({word(lex.scheme_follow_up)}, false) AS scheme_word, coalesce({word(lex.repeat_spray)}, false) AS repeated,
  coalesce({word(lex.water_spray)} OR {word(lex.spray)} OR {word(lex.irrigation)}, false) AS weather_word FROM i JOIN conversations c ON c.conv_id = i.conv_id AND c.turn = i.turn),
back AS (SELECT * REPLACE (CASE WHEN b THEN 'general_agriculture' ELSE intent END AS intent, CASE WHEN b THEN NULL ELSE topic END AS topic, CASE WHEN b THEN NULL ELSE place END AS place, CASE WHEN b THEN 0.7 ELSE confidence END AS confidence)
  FROM (SELECT *, n > 1 AND intent = 'topic_not_covered' AND refers AS b FROM u)),
r AS (
  SELECT conv_id, n, turn, intent, crop, topic, place, NULL::VARCHAR AS follow, 'first' AS rule, {remember}, CASE WHEN intent = 'market_price' THEN place END AS m_place, CASE WHEN intent = 'weather' THEN place END AS w_place,
    CASE WHEN intent IN {general} THEN crop END AS c_crop, CASE WHEN intent IN {general} AND crop IS NOT NULL THEN topic END AS c_topic, CASE WHEN intent IN {general} AND crop IS NOT NULL THEN text END AS c_text, CASE WHEN intent IN {general} AND crop IS NOT NULL THEN intent END AS c_intent
  FROM back WHERE n = 1
  UNION ALL
  SELECT conv_id, n, turn, intent, crop, topic, place, follow, rule, {remember},
    CASE WHEN intent = 'market_price' THEN place ELSE m_place END, CASE WHEN intent = 'weather' THEN place ELSE w_place END,
    CASE WHEN keep THEN crop ELSE c_crop END, CASE WHEN keep THEN topic ELSE c_topic END, CASE WHEN keep THEN text ELSE c_text END, CASE WHEN keep THEN intent ELSE c_intent END
  FROM (SELECT *, intent IN {general} AND crop IS NOT NULL AS keep FROM (
    SELECT conv_id, n, turn, text, m_place, w_place, c_crop, c_topic, c_text, c_intent, rule,
      CASE rule WHEN 'place_reply' THEN p_intent WHEN 'price_follow_up' THEN 'market_price' WHEN 'scheme_follow_up' THEN 'scheme_query' WHEN 'weather_follow_up' THEN 'weather'
        WHEN 'same_crop' THEN CASE WHEN confidence > 0.70 THEN intent ELSE c_intent END WHEN 'new_crop' THEN 'crop_question' ELSE intent END AS intent,
      CASE WHEN rule IN ('place_reply', 'price_follow_up', 'scheme_follow_up') THEN NULL WHEN rule = 'same_crop' THEN c_crop ELSE crop END AS crop,
      CASE rule WHEN 'place_reply' THEN CASE WHEN p_intent = 'market_price' THEN '{rules.MARKET_TOPIC}' ELSE '{rules.WEATHER_TOPIC}' END WHEN 'price_follow_up' THEN '{rules.MARKET_TOPIC}' WHEN 'scheme_follow_up' THEN p_topic
        WHEN 'weather_follow_up' THEN '{rules.WEATHER_TOPIC}' WHEN 'same_crop' THEN {real('c_topic')} WHEN 'new_crop' THEN c_topic ELSE topic END AS topic,
      CASE rule WHEN 'place_reply' THEN coalesce(place, {title}) WHEN 'price' THEN coalesce(place, m_place) WHEN 'price_follow_up' THEN coalesce(place, m_place) WHEN 'scheme_follow_up' THEN NULL WHEN 'weather' THEN coalesce(place, w_place)
        WHEN 'weather_follow_up' THEN coalesce(place, p_place) ELSE place END AS place,
      CASE WHEN rule IN ('place_reply', 'price_follow_up', 'scheme_follow_up', 'weather_follow_up') THEN p_text WHEN rule = 'same_crop' THEN c_text END AS follow
    FROM (SELECT b.*, r.p_intent, r.p_topic, r.p_place, r.p_text, r.m_place, r.w_place, r.c_crop, r.c_topic, r.c_text, r.c_intent, CASE
        WHEN r.wait AND b.words <= 4 AND b.intent NOT IN ('greeting', 'out_of_scope', 'scheme_query') AND b.crop IS NULL AND coalesce(b.topic, '') IN ('', '{rules.GENERAL_TOPIC}', '{rules.MARKET_TOPIC}', '{rules.WEATHER_TOPIC}') THEN 'place_reply'
        WHEN b.intent IN ('greeting', 'out_of_scope', 'crop_not_covered', 'topic_not_covered') THEN 'closed'
        WHEN b.intent = 'market_price' THEN 'price'
        WHEN r.p_intent = 'market_price' AND b.words <= 6 AND (b.crop IS NOT NULL OR b.place IS NOT NULL) THEN 'price_follow_up'
        WHEN r.p_intent = 'scheme_query' AND ((b.crop IS NULL AND {real('b.topic')} IS NULL) OR b.scheme_word) AND b.intent IN {general} THEN 'scheme_follow_up'
        WHEN b.intent = 'weather' THEN 'weather'
        WHEN r.p_intent = 'weather' AND b.crop IS NULL AND {real('b.topic')} IS NULL AND NOT b.repeated AND (b.place IS NOT NULL OR b.weather_word) THEN 'weather_follow_up'
        WHEN r.c_crop IS NOT NULL AND b.intent IN {general} AND b.crop IS NULL AND {real('b.topic')} IS NULL THEN 'same_crop'
        WHEN r.c_crop IS NOT NULL AND b.intent IN {general} AND b.crop IS NOT NULL AND {real('b.topic')} IS NULL AND {real('r.c_topic')} IS NOT NULL AND b.words <= 5 THEN 'new_crop'
        ELSE 'as_is' END AS rule FROM r JOIN back b ON b.conv_id = r.conv_id AND b.n = r.n + 1)))
)
SELECT conv_id, turn, intent, coalesce(crop, '') AS crop, coalesce(topic, '') AS topic, coalesce(place, '') AS place, coalesce(follow, '') AS follow_up_of, rule FROM r
"""


WORD_TOK = r"list_filter(regexp_split_to_array(regexp_replace(lower({0}), '[\p{{P}}\p{{S}}\p{{C}}]', ' ', 'g'), '[\s\p{{Z}}]+'), lambda x: length(x) >= 4)"
TERMS_SQL = rf"""WITH t AS (SELECT DISTINCT unnest({WORD_TOK.format('text')}) AS term FROM conversations),
m AS (SELECT doc_id, term FROM (SELECT DISTINCT doc_id, unnest(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}_]+')) AS term FROM documents) JOIN t USING (term) WHERE regexp_full_match(term, '[\x00-\x7f]+')
  UNION ALL SELECT doc_id, term FROM documents JOIN t ON contains(lower(text), term) WHERE NOT regexp_full_match(term, '[\x00-\x7f]+'))
SELECT doc_id, count(*) AS n, md5(string_agg(term, ',' ORDER BY term)) AS digest FROM m GROUP BY doc_id"""
NAMES_SQL = r"""WITH w AS (SELECT item_id, regexp_split_to_array(lower(text), '\s+') AS w, (['en', 'de', ''])[item_id % 3 + 1] AS crop FROM benchmark),
n AS (SELECT item_id, crop, concat_ws(' ', w[1], w[2], w[5]) AS name, concat_ws(' ', w[2], w[5]) AS short FROM w UNION ALL SELECT item_id, crop, concat_ws(' ', reverse(w[3]), w[4]), concat_ws(' ', w[4], w[3]) FROM w),
d AS (SELECT lower(lang) AS lang, regexp_replace(lower(text), '\s+', '', 'g') AS t FROM documents),
k AS (SELECT item_id, name, EXISTS (SELECT 1 FROM d WHERE starts_with(d.lang, n.crop) AND (contains(t, replace(n.name, ' ', '')) OR contains(t, replace(n.short, ' ', '')))) AS known FROM n)
SELECT item_id, CASE WHEN bool_or(known) THEN '' ELSE array_to_string(list_sort(list_distinct(list(name))), ',') END AS unknown FROM k GROUP BY item_id"""

BREAKER_SQL = """
WITH RECURSIVE c AS (SELECT event_type, event_id, epoch_ms(ts) AS t, value < 60 AS ok FROM events WHERE ts IS NOT NULL),
b AS (SELECT event_type, min(t) AS t FROM c WHERE NOT ok GROUP BY event_type
  UNION ALL SELECT b.event_type, min(c.t) FROM b JOIN c ON c.event_type = b.event_type AND c.t >= b.t + 600000 AND NOT c.ok GROUP BY b.event_type),
f AS (SELECT c.event_type, min(event_id) AS event_id, t FROM c JOIN b USING (event_type, t) WHERE NOT ok GROUP BY c.event_type, t)
SELECT c.event_type, c.event_id, f.t IS NOT NULL AND c.t < f.t + 600000 AND (c.t > f.t OR c.event_id > f.event_id) AS skipped FROM c ASOF LEFT JOIN f ON f.event_type = c.event_type AND c.t >= f.t"""
CACHE_SQL = """
WITH RECURSIVE c AS (SELECT user_id, event_id, epoch_ms(ts) AS t FROM events WHERE ts IS NOT NULL),
g AS (SELECT user_id, min(t) AS t FROM c GROUP BY user_id
  UNION ALL SELECT g.user_id, min(c.t) FROM g JOIN c ON c.user_id = g.user_id AND c.t >= g.t + 86400000 GROUP BY g.user_id),
f AS (SELECT c.user_id, min(event_id) AS event_id, t FROM c JOIN g USING (user_id, t) GROUP BY c.user_id, t)
SELECT c.user_id, c.event_id, c.event_id = f.event_id AS fetched, f.event_id AS value FROM c ASOF JOIN f ON f.user_id = c.user_id AND c.t >= f.t"""

SQL = {
    "source_breaker": BREAKER_SQL,
    "entry_cache": CACHE_SQL,
    "term_table_match": TERMS_SQL,
    "unknown_names": NAMES_SQL,
    "intent_cascade": INTENT_SQL,
    "dialog_state_exact": state_sql(STAND_IN),
    "topic_terms": f"SELECT doc_id, concat_ws(' ', CASE WHEN {sql_any('text', ('he',))} THEN 'he' END, CASE WHEN {sql_any('text', ('ou',))} THEN 'ou' END, CASE WHEN {sql_any('text', ('he', 'ou'))} THEN 'weed control' END, CASE WHEN {sql_any('text', ('er',))} THEN 'variety' END) AS terms, CASE WHEN {sql_any('text', ('water',))} THEN 'irrigation' ELSE concat_ws(',', CASE WHEN {sql_any('text', ('on', 'auf'))} THEN 'spray' END, CASE WHEN {sql_any('text', ('un', 'ein'))} THEN 'irrigation' END) END AS advice, {sql_any('text', ('is', 'it'))} AS back FROM documents WHERE text IS NOT NULL",
    "previous_turn": "SELECT conv_id, turn, coalesce(lag(role) OVER w, '') AS previous_role, coalesce(lag(turn) OVER w, -1) AS previous_turn FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)",
    "last_matching_turn": f"SELECT conv_id, turn, coalesce(last_value(CASE WHEN role = 'user' AND {sql_any('text', ('the', 'der'))} THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS last_turn FROM conversations",
    "recent_history": "SELECT conv_id, turn, coalesce(array_to_string(list(CASE WHEN length(x) > 500 THEN x[1:500] || '...' ELSE x END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), chr(10)), '') AS history FROM (SELECT *, role || ': ' || text AS x FROM conversations)",
    "query_expansion": f"SELECT conv_id, turn, concat_ws(' ', c.text, CASE WHEN i.crop <> '' AND NOT contains(lower(c.text), lower(i.crop)) THEN i.crop END, CASE WHEN i.topic <> '' AND NOT contains(lower(c.text), lower(i.topic)) THEN i.topic END) AS search FROM ({INTENT_SQL}) i JOIN conversations c USING (conv_id, turn) WHERE i.crop <> '' OR i.topic <> ''",
    "language_script": "SELECT doc_id, CASE WHEN regexp_matches(text, '[਀-੿]') THEN 'pa' ELSE 'hi' END AS detected, NOT regexp_matches(text, '[਀-੿]') AND NOT regexp_matches(text, '[ऀ-ॿ]') AS in_script, regexp_matches(text, '[^\\x00-\\x7F]') AS non_ascii FROM documents",
    "lexicon_match_word": "SELECT doc_id, concat_ws(',', " + ", ".join(f"CASE WHEN {sql_any('text', terms)} THEN '{n}' END" for n, terms in STAND_IN.pests) + ") AS names FROM documents",
    "first_alias": f"SELECT doc_id, coalesce({sql_first('text', STAND_IN.crops)}, '') AS crop FROM documents",
    "longest_alias": f"SELECT doc_id, coalesce({sql_longest('text', STAND_IN.pests)}, '') AS pest, coalesce({sql_longest('text', STAND_IN.crops, False)}, '') AS crop FROM documents",
    "banned_scan": "SELECT * FROM (SELECT doc_id, found <> '' AS flagged, found FROM (SELECT doc_id, concat_ws(',', " + ", ".join(f"CASE WHEN {sql_any('text', t)} THEN '{n}' END" for n, t in (("one", ("idiot", "moron")), ("two", ("trash",)), ("three", ("clown", "scum")))) + ") AS found FROM documents)) WHERE flagged",
    "safety_notes": f"SELECT conv_id, turn, concat_ws(',', CASE WHEN {sql_any('b', ('with',))} THEN 'with_warning' END, CASE WHEN {sql_any('b', ('this',))} THEN 'this_warning' END, CASE WHEN {sql_sub('text', ('onth', 'sche', 'ml'))} THEN 'statutory_note' END) AS notes FROM (SELECT *, coalesce(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), '') || ' ' || text AS b FROM conversations) WHERE role = 'assistant'",
    "grounding_ratio": "SELECT conv_id, turn, coalesce(ctx, '') <> '' AND ratio >= 0.35 AS grounded, round(ratio, 3) AS ratio FROM (SELECT *, CASE WHEN coalesce(ctx, '') = '' THEN 0.0::DOUBLE WHEN len(w) = 0 THEN 1.0::DOUBLE ELSE len(list_filter(w, lambda x: contains(lower(ctx), x)))::DOUBLE / len(w) END AS ratio FROM (SELECT *, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda x: length(x) >= 4)) AS w, array_to_string(list(text) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), ' ') AS ctx FROM conversations)) WHERE role = 'assistant'",
}
