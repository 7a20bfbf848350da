"""Conversations: one-step look-backs as windows, and the exact turn-by-turn state as a grouped function."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by_turn():
    return Window.partitionBy("conv_id").orderBy("turn")


def earlier():
    """All turns before the current one."""
    return by_turn().rowsBetween(Window.unboundedPreceding, -1)


def previous(column: str) -> Column:
    """Value of the turn before."""
    return F.lag(column, 1).over(by_turn())


def last_where(holds: Column, value: Column) -> Column:
    """Value of the last earlier turn for which ``holds`` is true, else null."""
    return F.last(F.when(holds, value), ignorenulls=True).over(earlier())


def recent(value: Column, turns: int = 3, most: int = 500) -> Column:
    """The last turns' values, oldest first, each cut to ``most`` characters."""
    cut = F.when(F.length(value) > most, F.concat(F.substring(value, 1, most), F.lit("..."))).otherwise(value)
    return F.collect_list(cut).over(by_turn().rowsBetween(-turns, -1))


STATE_SCHEMA = "conv_id long, turn long, intent string, crop string, topic string, place string, use_chapters boolean, follow_up_of string, rule string"
#: What the next turn may look back to; kept by the batch and the stream alike.
CARRIED = (
    "prev_intent string, prev_topic string, prev_place string, prev_text string, wait_place boolean, wait_crop boolean, prev_from_profile boolean, market_place string, weather_place string, "
    "crop string, crop_topic string, crop_text string, crop_intent string, crop_chapters boolean"
)
CARRIED_NAMES = tuple(c.split()[0] for c in CARRIED.split(", "))
GENERAL = ("crop_question", "general_agriculture", "safety_query", "image_diagnosis")
CLOSED = ("greeting", "out_of_scope", "crop_not_covered", "topic_not_covered")
GENERAL_TOPIC, MARKET_TOPIC, WEATHER_TOPIC = "Agronomy/General", "Market prices", "Weather and spraying"
TURN = ("text", "intent", "confidence", "crop", "topic", "place", "use_chapters")
#: Marks of a question's words, from ``marked``; and what the answer told, where answers are known.
MARKS, TOLD = ("refers_back", "scheme_word", "repeat_spray", "weather_topic", "search_terms"), ("needs_place", "needs_crop", "from_profile", "top_section", "used_chapters", "answer_place")


def marked(classified: DataFrame, lex=None, text: str = "text") -> DataFrame:
    """``classified`` with what the follow-up rules ask of a question's words."""
    from agroloom.functions.lexicon import Lexicon, any_term
    from agroloom.operators.rules import search_terms, weather_topics

    lex = lex or Lexicon()
    q = F.lower(F.coalesce(F.col(text), F.lit("")))
    return classified.withColumns(
        {
            "refers_back": any_term(q, lex.pronouns),
            "scheme_word": any_term(q, lex.scheme_follow_up),
            "repeat_spray": any_term(q, lex.repeat_spray),
            "weather_topic": F.size(weather_topics(q, lex)) > 0,
            "search_terms": search_terms(q, lex),
        }
    )


def real(topic: str | None) -> str | None:
    return None if topic in (None, GENERAL_TOPIC) else topic


def follow_up(r: dict, t: dict, s: dict, chapters: bool) -> tuple[str, dict]:
    """(rule, changes) of the first rule that decides how a turn goes on from the ones before it."""
    n = len((t["text"] or "").split())
    vague = not r["crop"] and not real(r["topic"])
    if r["intent"] == "topic_not_covered" and t["refers_back"]:
        # back to an earlier question: read as a general one by the rules that follow
        r |= {"intent": "general_agriculture", "topic": None, "place": None, "confidence": 0.7, "use_chapters": False}
        vague = not r["crop"]
    if chapters and r["intent"] == "topic_not_covered" and not r["crop"] and s["crop"]:
        r |= {"intent": "crop_question", "crop": s["crop"], "topic": t["search_terms"] or r["topic"], "confidence": 0.8, "use_chapters": True}
        vague = False
    named = r["topic"] not in (None, GENERAL_TOPIC, MARKET_TOPIC, WEATHER_TOPIC)
    if s["wait_place"] and n <= 4 and r["intent"] not in ("greeting", "out_of_scope", "scheme_query") and not r["crop"] and not named:
        topic = MARKET_TOPIC if s["prev_intent"] == "market_price" else WEATHER_TOPIC
        return "place_reply", {"intent": s["prev_intent"], "topic": topic, "place": r["place"] or (t["text"] or "").strip(" ?.!,").title(), "crop": None, "use_chapters": False, "follow_up_of": s["prev_text"]}
    if s["wait_crop"] and r["crop"] and r["intent"] in (*GENERAL, "topic_not_covered"):
        return "crop_reply", {"follow_up_of": s["prev_text"]} | ({"intent": "crop_question"} if r["intent"] == "general_agriculture" else {})
    if r["intent"] in CLOSED:
        return "closed", {}
    if r["intent"] == "market_price":
        return "price", {"place": r["place"] or s["market_place"]}
    if s["prev_intent"] == "market_price" and n <= 6 and (r["crop"] or r["place"]):
        return "price_follow_up", {"intent": "market_price", "topic": MARKET_TOPIC, "crop": None, "place": r["place"] or s["market_place"], "use_chapters": False, "follow_up_of": s["prev_text"]}
    if s["prev_intent"] == "scheme_query" and (vague or t["scheme_word"]) and r["intent"] in GENERAL:
        return "scheme_follow_up", {"intent": "scheme_query", "topic": s["prev_topic"], "crop": None, "place": None, "use_chapters": False, "follow_up_of": s["prev_text"]}
    if r["intent"] == "weather":
        return "weather", {"place": r["place"] or s["weather_place"]}
    if s["prev_intent"] == "weather" and vague and not t["repeat_spray"] and (r["place"] or t["weather_topic"]):
        place = r["place"] or (None if s["prev_from_profile"] else s["prev_place"])
        return "weather_follow_up", {"intent": "weather", "topic": WEATHER_TOPIC, "place": place, "use_chapters": False, "follow_up_of": s["prev_text"]}
    if s["crop"] and r["intent"] in GENERAL:
        if vague:
            inherited = "crop_question" if s["crop_intent"] == "image_diagnosis" else s["crop_intent"]
            intent = r["intent"] if r["confidence"] is None or r["confidence"] > 0.70 else inherited
            return "same_crop", {"intent": intent, "crop": s["crop"], "topic": real(s["crop_topic"]), "use_chapters": bool(s["crop_chapters"]), "follow_up_of": s["crop_text"]}
        if r["crop"] and not real(r["topic"]) and real(s["crop_topic"]) and n <= 5:
            return "new_crop", {"intent": "crop_question", "topic": s["crop_topic"], "use_chapters": bool(s["crop_chapters"])}
    return "as_is", {}


def remembered(r: dict, t: dict, s: dict) -> dict:
    """The state after a turn. Without an answer's own flags, a price or weather question without a place is taken to
    have been answered by asking for one. A topic that isn't named falls back to the advisory that the answer used."""
    place = t["answer_place"] or r["place"]
    waits = t["needs_place"] if t["needs_place"] is not None else r["intent"] in ("market_price", "weather") and not place
    topic = real(r["topic"]) or t["top_section"] or r["topic"]
    out = s | {"prev_intent": r["intent"], "prev_topic": topic, "prev_place": place, "prev_text": t["text"], "wait_place": bool(waits), "wait_crop": bool(t["needs_crop"]), "prev_from_profile": bool(t["from_profile"])}
    kept = None if t["from_profile"] else place
    if r["intent"] == "market_price":
        out["market_place"] = kept
    elif r["intent"] == "weather":
        out["weather_place"] = kept
    elif r["intent"] in GENERAL and r["crop"]:
        chapters = r["use_chapters"] if t["used_chapters"] is None else t["used_chapters"]
        out |= {"crop": r["crop"], "crop_topic": topic, "crop_text": t["text"], "crop_intent": r["intent"], "crop_chapters": bool(chapters)}
    return out


def step(t: dict, state: dict | None, chapters: bool = False) -> tuple[dict, dict]:
    """(resolved turn, state after it); the resolved turn, not the written one, is what the next turn looks back to."""
    r = {k: t[k] for k in ("intent", "confidence", "crop", "topic", "place", "use_chapters")} | {"follow_up_of": None, "rule": "first"}
    if state is not None:
        r["rule"], changes = follow_up(r, t, state, chapters)
        r |= changes
    return r, remembered(r, t, state or dict.fromkeys(CARRIED_NAMES))


def turns_of(frame: pd.DataFrame) -> list[dict]:
    """Turns in order, missing values as None; optional columns that aren't there are None as well."""
    rows = frame.sort_values("turn").to_dict("records")
    clean = lambda v: None if v is None or v is pd.NA or isinstance(v, float) and v != v else v
    return [{c: clean(row.get(c)) for c in ("conv_id", "turn", *TURN, *MARKS, *TOLD)} for row in rows]


def resolve(turns: pd.DataFrame, chapters: bool = False) -> pd.DataFrame:
    """Carries crop, topic and place through one conversation, turn by turn, with a state of fixed size."""
    state, done = None, []
    for t in turns_of(turns):
        r, state = step(t, state, chapters)
        done.append({"conv_id": t["conv_id"], "turn": t["turn"], **r})
    return pd.DataFrame(done, columns=[c.split()[0] for c in STATE_SCHEMA.split(", ")])


def resolved(classified: DataFrame, chapters: bool = False, lex=None) -> DataFrame:
    """Exact state of every user turn, conversation by conversation; needs conv_id, turn, text and the classifier's
    columns, and takes an answer's flags (needs_place, needs_crop, from_profile, top_section, used_chapters,
    answer_place) where the table has them."""
    for name, kind in (("confidence", "1.0"), ("use_chapters", "false")):
        if name not in classified.columns:
            classified = classified.withColumn(name, F.expr(kind))
    rows = marked(classified, lex)
    kept = [c for c in ("conv_id", "turn", *TURN, *MARKS, *TOLD) if c in rows.columns]

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        return resolve(frame, chapters)

    return rows.select(*kept).groupBy("conv_id").applyInPandas(one, STATE_SCHEMA)
