"""Rule engines: a row in, a classified row out; the first rule that holds decides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agroloom.functions.lexicon import Lexicon, all_matches, any_substring, any_term, first_match, longest_match
from agroloom.functions.text import strip

CROP_INTENTS = ("crop_question", "general_agriculture", "safety_query", "image_diagnosis")
GENERAL_TOPIC, MARKET_TOPIC, WEATHER_TOPIC = "Agronomy/General", "Market prices", "Weather and spraying"


def words(text: Column) -> Column:
    """Number of words."""
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


def classify(rows: DataFrame, text: str = "text", lex: Lexicon | None = None, chapters: bool = False) -> DataFrame:
    """``rows`` with intent, confidence, crop, topic, place and use_chapters of each question."""
    lex = lex or Lexicon()
    q = strip(F.lower(F.coalesce(F.col(text), F.lit(""))))
    out = rows.withColumns(
        {
            "_crop": first_match(q, lex.crops),
            "_place": first_match(q, lex.places),
            "_pest": longest_match(q, lex.pests, ties="greatest"),
            "_other": first_match(q, lex.other_schemes),
            "_scheme": longest_match(q, lex.schemes, ties="greatest"),
            "_gap_word": first_match(q, lex.gaps),
            "_uncovered": first_match(q, lex.uncovered_crops, mode="name"),
        }
    )
    crop, pest = F.col("_crop"), F.col("_pest")
    covered = F.lit(False)
    for name, crops in lex.pest_crops:
        covered = covered | ((pest == name) & crop.isin(*crops))
    gap = F.when(pest.isNull(), F.col("_gap_word")).when(crop.isNotNull() & ~covered, F.concat(F.lower(pest), F.lit(" in "), F.lower(crop)))
    sprays = any_term(q, lex.spray) | any_term(q, lex.water_spray)
    timing = pest.isNull() & any_term(q, lex.time) & ~any_term(q, lex.repeat_spray) & sprays
    no = F.lit(None).cast("string")

    def rule(holds: Column, intent: str, confidence: float, crop: Column = no, topic: Column = no, place: Column = no, chapter: bool = False) -> Column:
        values = (F.lit(intent), F.lit(confidence), crop, topic, place, F.lit(chapter))
        return F.when(holds, F.struct(*(v.alias(n) for v, n in zip(values, ("intent", "confidence", "crop", "topic", "place", "use_chapters"), strict=True))))

    place = F.col("_place")
    rules = [
        rule(any_term(q, lex.greeting) & (words(q) <= 4), "greeting", 0.98),
        rule(F.col("_other").isNotNull() | F.col("_scheme").isNotNull() | any_term(q, lex.scheme_words), "scheme_query", 0.93, topic=F.coalesce(F.concat(F.lit("other:"), F.col("_other")), F.col("_scheme"))),
        rule(any_term(q, lex.market) & ~any_term(q, lex.not_market), "market_price", 0.92, topic=F.lit(MARKET_TOPIC), place=place),
        rule(any_term(q, lex.off_topic), "out_of_scope", 0.92),
        rule(timing | any_term(q, lex.weather), "weather", 0.96, crop, F.lit(WEATHER_TOPIC), place),
        rule(any_term(q, lex.safety) | (F.size(all_matches(q, lex.banned)) > 0), "safety_query", 0.95, crop, pest, place),
        rule(crop.isNull() & F.col("_uncovered").isNotNull(), "crop_not_covered", 0.9, topic=F.col("_uncovered")),
        rule(F.lit(chapters) & gap.isNotNull() & crop.isNotNull(), "crop_question", 0.85, crop, gap, place, True),
        rule(gap.isNotNull(), "topic_not_covered", 0.85, crop, gap, place),
        rule(pest.isNotNull() | (crop.isNotNull() & any_substring(q, lex.actions)), "crop_question", 0.94, crop, pest, place),
        rule(crop.isNotNull() | any_substring(q, lex.farming), "general_agriculture", 0.88, crop, F.coalesce(pest, F.lit(GENERAL_TOPIC)), place),
        rule(F.lit(True), "general_agriculture", 0.70, crop, pest, place),
    ]
    hidden = ("_crop", "_place", "_pest", "_other", "_scheme", "_gap_word", "_uncovered", "_r")
    decided = out.withColumn("_r", F.coalesce(*rules))
    return decided.select("*", *(F.col("_r")[c].alias(c) for c in ("intent", "confidence", "crop", "topic", "place", "use_chapters"))).drop(*hidden)


def weather_topics(text: Column, lex: Lexicon | None = None) -> Column:
    """Which advice a weather question asks for: irrigation alone where it speaks of spraying water, else spray and
    irrigation as they are named."""
    lex = lex or Lexicon()
    both = F.array(F.when(any_term(text, lex.spray), F.lit("spray")), F.when(any_term(text, lex.irrigation), F.lit("irrigation")))
    return F.when(any_term(text, lex.water_spray), F.array(F.lit("irrigation"))).otherwise(F.filter(both, lambda x: x.isNotNull()))


def search_terms(text: Column, lex: Lexicon | None = None) -> Column:
    """The topics that a question names, in English, each with the words that section titles use for it; empty if none.

    A word of another script without an English word is left out; every term comes once, in the lexicon's order.
    """
    lex = lex or Lexicon()
    english, titles = dict(lex.english), dict(lex.topic_titles)
    found = []
    for topic, words in lex.topics:
        found += [F.when(any_term(text, (w,)), F.lit(english.get(w, w))) for w in words if w in english or w.isascii()]
        if topic in titles:
            found.append(F.when(any_term(text, words), F.lit(titles[topic])))
    return F.array_join(F.array_distinct(F.filter(F.array(*found), lambda x: x.isNotNull())), " ")


def refers_back(intent: Column, text: Column, lex: Lexicon | None = None) -> Column:
    """Whether a question on an uncovered topic points back to an earlier one."""
    return (intent == "topic_not_covered") & any_term(text, (lex or Lexicon()).pronouns)


def asks_back(intent: Column, crop: Column, topic: Column, follow_up_of: Column, repeat_spray: Column) -> Column:
    """Whether a question on spraying again names nothing that it could be about."""
    return repeat_spray & crop.isNull() & F.coalesce(topic == GENERAL_TOPIC, F.lit(True)) & follow_up_of.isNull()


def weather_advice(rain: Column, wind: Column, temperature: Column) -> tuple[Column, Column]:
    """(spray, irrigation) advice."""
    spray = F.when(rain > 40, "no_spray_rain").when(wind > 15, "no_spray_wind").otherwise("spray_ok")
    irrigation = F.when(rain > 50, "stop").when(temperature > 35, "light").otherwise("normal")
    return spray, irrigation


def first_hours_max(hourly: Column, hours: int = 12) -> Column:
    """Largest of the first values of a day."""
    return F.array_max(F.slice(hourly, 1, hours))


def eligibility(has_profile: Column, owns_land: Column, exclusions: list[tuple[Column, str]], withheld: Column) -> Column:
    """struct<status, reasons, may_be_withheld>; flags are tri-state: null is unknown, not false."""
    reasons = F.filter(F.array(*(F.when(flag.eqNullSafe(F.lit(True)), F.lit(name)) for flag, name in exclusions)), lambda r: r.isNotNull())
    no_land = owns_land.eqNullSafe(F.lit(False))
    status = (
        F.when(~has_profile, "needs_info")
        .when(no_land, "not_eligible")
        .when(F.size(reasons) > 0, "not_eligible")
        .when(owns_land.eqNullSafe(F.lit(True)), "likely_eligible")
        .otherwise("needs_info")
    )
    shown = F.when(~has_profile, F.array().cast("array<string>")).when(no_land, F.concat(F.array(F.lit("no_land")), reasons)).otherwise(reasons)
    return F.struct(status.alias("status"), shown.alias("reasons"), (has_profile & withheld.eqNullSafe(F.lit(True))).alias("may_be_withheld"))


def evidence_status(intent: Column, source: Column, needs_more: Column, not_found: Column, check_statuses: Column, weak_llm: Column, low_retrieval: Column) -> Column:
    """not_applicable, not_verified, partially_verified or verified, in this precedence."""
    has = lambda *s: F.arrays_overlap(check_statuses, F.array(*(F.lit(x) for x in s)))
    return (
        F.when(intent.isin("greeting", "out_of_scope", "empty", "error") | needs_more, "not_applicable")
        .when(intent.isin("crop_not_covered", "topic_not_covered") | not_found | has("unknown_problem") | source.isNull(), "not_verified")
        .when(weak_llm | low_retrieval | has("unverified", "unknown_product"), "partially_verified")
        .otherwise("verified")
    )


def premise_status(check_statuses: Column) -> Column:
    has = lambda *s: F.arrays_overlap(check_statuses, F.array(*(F.lit(x) for x in s)))
    return F.when(has("contradicted", "qualified"), "corrected").when(has("unverified", "unknown_problem", "unknown_product"), "unverified").otherwise("none")


def review_reasons(intent: Column, banned: Column, pesticide: Column, by_llm: Column, grounding: Column, low_retrieval: Column, replaced: Column, photo_confidence: Column | None = None, least: float = 0.5) -> Column:
    """Why an expert should see an answer; empty if none should. A photo's diagnosis of less than high confidence is a
    reason; no photo (null) is none."""
    photo = F.lit(None).cast("string") if photo_confidence is None else photo_confidence
    tests = (
        (banned, "banned_pesticide"),
        (pesticide, "pesticide"),
        (by_llm & (grounding < least), "low_grounding"),
        (intent.isin("crop_not_covered", "topic_not_covered"), "not_covered"),
        (replaced, "llm_numbers_replaced"),
        (low_retrieval, "low_retrieval_confidence"),
        (photo != "high", "photo_uncertain"),
    )
    return F.filter(F.array(*(F.when(t, F.lit(name)) for t, name in tests)), lambda r: r.isNotNull())


def grounding(answer: Column, context: Column, least: float = 0.35) -> Column:
    """struct<grounded, ratio>: distinct ASCII words of four letters or more found anywhere in the context."""
    found = F.array_distinct(F.filter(F.split(F.lower(answer), "[^a-z]+"), lambda w: F.length(w) >= 4))
    matched = F.size(F.filter(found, lambda w: F.contains(F.lower(context), w)))
    empty = F.coalesce(context, F.lit("")) == ""
    ratio = F.when(empty, 0.0).when(F.size(found) == 0, 1.0).otherwise(matched / F.size(found))
    return F.struct((~empty & (ratio >= least)).alias("grounded"), F.round(ratio, 3).alias("ratio"))


def safety_notes(query: Column, answer: Column, named: tuple[str, ...] = ("monocrotophos", "endosulfan"), chemical: tuple[str, ...] = ("spray", "dose", "ml", "litre", "insecticide", "fungicide")) -> Column:
    """Warnings for chemicals named in question or answer, and the statutory note where the answer speaks of chemicals
    (inside words too)."""
    both = F.lower(F.concat_ws(" ", query, answer))
    notes = [F.when(any_term(both, (n,)), F.lit(f"{n}_warning")) for n in named]
    notes.append(F.when(any_substring(answer, chemical), F.lit("statutory_note")))
    return F.filter(F.array(*notes), lambda n: n.isNotNull())


def claim_verdict(same: Column, comparable: Column) -> Column:
    """supported if any fact agrees, contradicted if some could be compared, else unverified (aggregates of one claim)."""
    return F.when(F.max(same), "supported").when(F.max(comparable), "contradicted").otherwise("unverified")
