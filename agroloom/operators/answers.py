"""Answer texts from checked data alone: templates by language, passages, weather, prices, schemes, photos, dispatch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names of languages and their codes.
LANGUAGES = {"en": "en", "english": "en", "pa": "pa", "punjabi": "pa", "panjabi": "pa", "hi": "hi", "hindi": "hi", "hinglish": "hinglish"}
#: Templates of our own: key, then text by language; English stands in for a language without one.
TEMPLATES: dict[str, dict[str, str]] = {
    "greeting": {"en": "Hello, ask about your crop.", "hi": "नमस्ते, अपनी फसल के बारे में पूछें।"},
    "out_of_scope": {"en": "I answer farming questions only."},
    "crop_not_covered": {"en": "This crop is not in our advisories; ask your local centre."},
    "topic_not_covered": {"en": "This topic is not in our advisories; ask your local centre."},
    "ask_place": {"en": "Which district is it?", "hi": "कौन सा जिला?"},
    "place_is_state": {"en": "{place} is a whole state. Which district?"},
    "place_not_found": {"en": "I do not know {place}. Which district is it?"},
    "weather": {"en": "{place}: {temp} degrees, wind {wind} km/h, chance of rain {rain}%.", "hi": "{place}: {temp} डिग्री, हवा {wind}, बारिश {rain}%।"},
    "which_crop": {"en": "Which crop's price?"},
    "msp": {"en": "Support price of {crop}: Rs {price}."},
    "no_msp": {"en": "There is no support price for {crop}."},
    "previous": {"en": "The season before: Rs {price}."},
    "mandi": {"en": "{market}: Rs {modal} (Rs {low} to {high})"},
    "average": {"en": "{market}: Rs {modal} on average"},
    "state_fallback": {"en": "No rows for {district}; these are for {state}."},
    "unavailable": {"en": "Market prices are not available now."},
    "scheme_other": {"en": "{name} is not covered here."},
    "scheme_which": {"en": "Which scheme do you mean?"},
    "error": {"en": "Something went wrong; please ask again."},
    "empty": {"en": "Please write a question."},
}


def language_code(name: Column) -> Column:
    """Code of a language by name or code; hi for any other."""
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for p in LANGUAGES.items() for x in p)), F.lower(F.trim(name))), F.lit("hi"))


def filled(key: str, lang: Column, templates: dict[str, dict[str, str]] = TEMPLATES, **values: Column) -> Column:
    """A template in the language (English where that lacks it), its {names} filled; null values as empty text."""

    def put(text: str) -> Column:
        parts, rest = [], text
        while "{" in rest:
            plain, _, rest = rest.partition("{")
            name, _, rest = rest.partition("}")
            parts += [F.lit(plain), F.coalesce(values[name].cast("string"), F.lit(""))]
        return F.concat(*parts, F.lit(rest))

    texts = templates[key]
    out = put(texts["en"])
    for code, text in texts.items():
        if code != "en":
            out = F.when(lang == code, put(text)).otherwise(out)
    return out


def without_marker(draft: Column, marker: str = "[NOT_FOUND]") -> Column:
    """struct<text, not_found>: a leading marker taken off and told."""
    there = F.trim(draft).startswith(marker)
    return F.struct(F.when(there, F.trim(F.substring(F.trim(draft), F.lit(len(marker) + 1), F.length(draft)))).otherwise(draft).alias("text"), there.alias("not_found"))


def parsed_model_json(text: Column, schema: str, levels: tuple[str, ...] = ("high", "medium", "low"), most: int = 2) -> Column:
    """A model's JSON answer: code fences off, of a list the first, ``confidence`` held to the known levels (else the
    last), at most two ``alternatives``; null if it isn't JSON. ``schema`` is that of one answer."""
    bare = F.trim(F.regexp_replace(text, r"(?s)^\s*```(?:json)?\s*|\s*```\s*$", ""))
    one = F.when(bare.startswith("["), F.try_element_at(F.from_json(bare, f"array<struct<{schema}>>"), F.lit(1))).otherwise(F.from_json(bare, f"struct<{schema}>"))
    level = F.lower(one["confidence"])
    held = one.withField("confidence", F.when(level.isin(*levels), level).otherwise(levels[-1])).withField("alternatives", F.slice(F.coalesce(one["alternatives"], F.array().cast("array<string>")), 1, most))
    return F.when(one.isNotNull() & F.coalesce(one["problem"], one["crop"]).isNotNull(), held)


#: Parts of an advisory answer: field of the section and its heading.
PARTS = (("symptoms", "How to recognise it"), ("recommended_action", "What to do"), ("preventive_measures", "How to prevent it"), ("critical_safety_warning", "Warning"))


def advisory_answer(hits: DataFrame, sections: DataFrame, translations: DataFrame, lang: str = "lang") -> DataFrame:
    """(id, answer) from the first hit of each question: hits (id, rank, crop, section, parsed fields, text, lang), the
    chunks of the top one's crop and section alone. The original section's fields win over parsed ones unless they are
    empty or N/A, a translation's fields over both; without any field the text of the top chunk stands."""
    names = [f for f, _ in PARTS]
    top = hits.groupBy("id").agg(F.min_by(F.struct("crop", "section", "text", lang), "rank").alias("t")).select("id", "t.*")
    same = hits.drop("text", lang).join(top, ["id", "crop", "section"])
    parsed = same.groupBy("id", "crop", "section", "text", lang).agg(*(F.min_by(F.when(F.col(n) != "", F.col(n)), F.when(F.col(n) != "", F.col("rank"))).alias(n) for n in names))
    own = sections.select("section", F.struct(*names).alias("own"))
    other = translations.select("section", lang, F.struct("section_title", *names).alias("other"))
    rows = parsed.join(own, "section", "left").join(other, ["section", lang], "left")
    value = lambda n: F.coalesce(F.when(F.col(lang) != "en", F.col(f"other.{n}")), F.when(~F.col(f"own.{n}").isin("", "N/A"), F.col(f"own.{n}")), F.col(n))
    lines = F.filter(F.array(*(F.when(F.coalesce(value(n), F.lit("")) != "", F.concat(F.lit(f"{head}: "), value(n))) for n, head in PARTS)), lambda x: x.isNotNull())
    title = F.concat("crop", F.lit(" ("), F.coalesce(F.when(F.col(lang) != "en", F.col("other.section_title")), F.col("section")), F.lit(")"))
    return rows.select("id", F.array_join(F.concat(F.array(title), F.when(F.size(lines) > 0, lines).otherwise(F.array("text"))), "\n").alias("answer"))


def passage_answer(section: Column, text: Column, citation: Column) -> Column:
    """A chapter's passage without its label lines, and where it is from."""
    lines = F.filter(F.split(text, "\n"), lambda x: ~(x.startswith("Crop:") | x.startswith("Topic:")))
    return F.concat(section, F.lit("\n\n"), F.trim(F.array_join(lines, "\n")), F.lit("\n\n(from "), F.substring_index(citation, " [", 1), F.lit(")"))


def weather_answer(lang: Column, place: Column, state: Column, found: Column, temp: Column, wind: Column, rain: Column, topics: Column, spray: Column, irrigation: Column) -> Column:
    """struct<answer, needs_place>: asks for a district without a known place, else the report, and advice on spraying or
    irrigation where ``topics`` asks for it."""
    ask = F.when(state.isNotNull(), filled("place_is_state", lang, place=state)).when(place.isNotNull() & ~found, filled("place_not_found", lang, place=place)).when(place.isNull(), filled("ask_place", lang))
    parts = F.array(filled("weather", lang, place=place, temp=temp, wind=wind, rain=rain), F.when(F.array_contains(topics, "spray"), spray), F.when(F.array_contains(topics, "irrigation"), irrigation))
    said = F.array_join(F.filter(parts, lambda x: x.isNotNull()), "\n\n")
    return F.struct(F.coalesce(ask, said).alias("answer"), ask.isNotNull().alias("needs_place"))


def market_answer(lang: Column, crop: Column, msp: Column, previous: Column, place: Column, state: Column, prices: Column, local: Column) -> Column:
    """The support price, that of the season before, the newest market rows; or a question for the crop or the place."""
    money = lambda c: F.format_number(c, 0)
    row = lambda p: F.when(p["low"].isNotNull(), filled("mandi", lang, market=p["market"], modal=money(p["modal"]), low=money(p["low"]), high=money(p["high"]))).otherwise(filled("average", lang, market=p["market"], modal=money(p["modal"])))
    ask = F.when(state.isNull(), F.when(place.isNotNull(), filled("place_not_found", lang, place=place)).otherwise(filled("ask_place", lang)))
    rows = F.when(state.isNotNull() & prices.isNotNull(), F.array_join(F.transform(prices, row), "\n"))
    parts = F.array(
        F.when(msp.isNotNull(), filled("msp", lang, crop=crop, price=money(msp))).otherwise(filled("no_msp", lang, crop=crop)),
        F.when(msp.isNotNull() & previous.isNotNull(), filled("previous", lang, price=money(previous))),
        ask,
        rows,
        F.when(rows.isNotNull() & place.isNotNull() & ~local, filled("state_fallback", lang, district=place, state=state)),
        F.when(state.isNotNull() & prices.isNull(), filled("unavailable", lang)),
    )
    return F.when(crop.isNull(), filled("which_crop", lang)).otherwise(F.array_join(F.filter(parts, lambda x: x.isNotNull()), "\n"))


def only_crop(crops: Column, covered: tuple[str, ...] | None = None) -> Column:
    """The crop of a profile if there is exactly one (of those covered, if given)."""
    fits = F.filter(crops, lambda c: c.isin(*covered)) if covered else crops
    return F.when(F.size(fits) == 1, F.element_at(fits, 1))


def profile_summary(parts: dict[str, Column]) -> Column:
    """Labelled parts of a profile that are known, joined; empty if none is."""
    return F.array_join(F.filter(F.array(*(F.when(F.coalesce(c.cast("string"), F.lit("")) != "", F.concat(F.lit(f"{n}: "), c.cast("string"))) for n, c in parts.items())), lambda x: x.isNotNull()), "; ")


def photo_answer(is_plant: Column, identified: Column, healthy: Column, confidence: Column, covered: Column, treatment: Column) -> Column:
    """What a diagnosed photo gets: the first of these that holds."""
    return F.when(~is_plant, "not_plant").when(healthy, "healthy").when(~identified | (confidence == "low"), "unclear").when(~covered, "not_covered").otherwise(treatment)


def merged_message(text: Column, transcript: Column) -> Column:
    """Typed text and transcript as one question; empty parts left out."""
    return F.array_join(F.filter(F.array(F.trim(text), F.trim(transcript)), lambda x: x.isNotNull() & (x != "")), " ")


def scheme_answer(lang: Column, topic: Column, covered: Column, eligibility: Column, official: Column) -> Column:
    """Official text after the eligibility; the name of a scheme that isn't covered; or a question which one is meant."""
    other = F.when(topic.startswith("other:"), filled("scheme_other", lang, name=F.substring(topic, F.lit(7), F.length(topic))))
    said = F.when(F.coalesce(topic.isNotNull() & covered, F.lit(False)), F.array_join(F.filter(F.array(eligibility, official), lambda x: x.isNotNull() & (x != "")), "\n\n"))
    return F.coalesce(other, said, filled("scheme_which", lang))


def dispatched(intent: Column, query: Column, lang: Column, handlers: dict[str, Column], default: Column) -> Column:
    """struct<answer, intent> by intent: fixed replies, the handlers' answers, else ``default``; an empty question and a
    row without an answer get replies of their own, so no row fails."""
    fixed = ("greeting", "out_of_scope", "crop_not_covered", "topic_not_covered")
    text = default
    for name, answer in handlers.items():
        text = F.when(intent == name, answer).otherwise(text)
    for name in fixed:
        text = F.when(intent == name, filled(name, lang)).otherwise(text)
    empty = F.trim(F.coalesce(query, F.lit(""))) == ""
    answer = F.when(empty, filled("empty", lang)).otherwise(F.coalesce(text, filled("error", lang)))
    return F.struct(answer.alias("answer"), F.when(empty, "empty").when(text.isNull(), "error").otherwise(intent).alias("intent"))


def replaced(draft: Column, by_llm: Column, unbacked: Column, declined: Column, template: Column) -> Column:
    """struct<answer, answer_source>: the template where a model's draft states unbacked numbers, or declined although the
    question names a section."""
    numbers = by_llm & (F.size(unbacked) > 0)
    source = F.when(numbers, "numbers_replaced").when(by_llm & declined, "llm_declined").when(by_llm, "llm").otherwise("template")
    return F.struct(F.when(source == "llm", draft).otherwise(template).alias("answer"), source.alias("answer_source"))
