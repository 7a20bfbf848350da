"""Lexicons as ordered data, and matching of texts against them as array expressions.

A lexicon is a list of (name, terms); its order is part of its meaning. A text meets a lexicon inside one projection:
no join, no explode, and the patterns compile once a task.
"""

from __future__ import annotations

import functools
import unicodedata
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from agroloom.functions.numbers import bound
from agroloom.functions.text import term_pattern

Entries = tuple[tuple[str, tuple[str, ...]], ...]


def any_term(text: Column, terms: tuple[str, ...], mode: str = "stem", lower: bool = True) -> Column:
    """Whether any term occurs; false without terms. ``lower``: whether the text is still to be lowered."""
    return (F.lower(text) if lower else text).rlike("|".join(f"(?:{term_pattern(t, mode)})" for t in terms if t)) if any(terms) else F.lit(False)


def in_lower(low: Column, terms: tuple[str, ...], mode: str = "stem") -> Column:
    """``any_term`` of a text in lower case. Most texts hold no term even as a part, which a search for bytes finds out
    many times faster than the pattern."""
    parts = sorted({unicodedata.normalize("NFC", t).lower() for t in terms if t})
    return functools.reduce(Column.__or__, (F.contains(low, F.lit(p)) for p in parts)) & any_term(low, terms, mode, lower=False) if parts else F.lit(False)


def any_substring(text: Column, parts: tuple[str, ...]) -> Column:
    """Whether any part occurs anywhere, inside words too."""
    out = F.lit(False)
    for p in parts:
        out = out | F.contains(F.lower(text), F.lit(p))
    return out


def first_match(text: Column, entries: Entries, mode: str = "stem") -> Column:
    """Name of the first entry with a term in ``text``, else null."""
    whens = [F.when(any_term(text, terms, mode), F.lit(name)) for name, terms in entries]
    return F.coalesce(*whens, F.lit(None).cast("string"))


def all_matches(text: Column, entries: Entries, mode: str = "stem") -> Column:
    """Names of all entries with a term in ``text``, in lexicon order."""
    return bound(F.lower(text), lambda low: F.filter(F.array(*(F.when(in_lower(low, terms, mode), F.lit(name)) for name, terms in entries)), lambda x: x.isNotNull()))


def longest_match(text: Column, entries: Entries, ties: str = "first", mode: str = "stem") -> Column:
    """Name of the entry whose longest matching term is longest; ties go to the ``first`` entry or the ``greatest`` name."""

    def longest(low: Column) -> Column:
        found = [F.when(in_lower(low, (t,), mode), F.struct(F.lit(len(t)).alias("size"), F.lit(-i if ties == "first" else 0).alias("ord"), F.lit(name).alias("name"))) for i, (name, terms) in enumerate(entries) for t in terms]
        return F.array_max(F.filter(F.array(*found), lambda x: x.isNotNull()))["name"]

    return bound(F.lower(text), longest)


@dataclass(frozen=True)
class Lexicon:
    """Everything the intent rules look up. The defaults are a small farming vocabulary of our own."""

    greeting: tuple[str, ...] = ("hello", "hi", "good morning", "namaste", "नमस्ते", "ਸਤ ਸ੍ਰੀ ਅਕਾਲ")
    other_schemes: Entries = (("Soil Health Card", ("soil health card",)), ("Solar pump scheme", ("solar pump scheme", "kusum")))
    schemes: Entries = (("PM-KISAN", ("pm-kisan", "pm kisan")), ("PMFBY", ("pmfby", "fasal bima", "crop insurance")), ("KCC", ("kcc", "kisan credit card")))
    scheme_words: tuple[str, ...] = ("scheme", "yojana", "subsidy", "योजना", "ਯੋਜਨਾ")
    market: tuple[str, ...] = ("msp", "mandi", "price", "rate", "भाव", "ਭਾਅ")
    not_market: tuple[str, ...] = ("seed rate", "rate of spray", "dose rate")
    off_topic: tuple[str, ...] = ("cricket", "movie", "election", "recipe")
    places: Entries = (("Ludhiana", ("ludhiana", "ਲੁਧਿਆਣਾ")), ("Sangrur", ("sangrur", "ਸੰਗਰੂਰ")), ("Delhi", ("delhi", "दिल्ली")))
    crops: Entries = (("Wheat", ("wheat", "gehun", "गेहूं", "ਕਣਕ")), ("Paddy", ("paddy", "rice", "dhan", "धान", "ਝੋਨਾ")), ("Cotton", ("cotton", "kapas", "कपास", "ਨਰਮਾ")), ("Mustard", ("mustard", "sarson", "सरसों", "ਸਰ੍ਹੋਂ")))
    uncovered_crops: Entries = (("Banana", ("banana", "kela")), ("Tea", ("tea", "chai")), ("Apple", ("apple", "seb")))
    pests: Entries = (("Aphid", ("aphid", "aphids", "chepa", "माहू")), ("Yellow rust", ("yellow rust", "rust")), ("Pink bollworm", ("pink bollworm", "bollworm")), ("Stem borer", ("stem borer", "borer")))
    pest_crops: Entries = (("Aphid", ("Wheat", "Mustard")), ("Yellow rust", ("Wheat",)), ("Pink bollworm", ("Cotton",)), ("Stem borer", ("Paddy",)))
    time: tuple[str, ...] = ("today", "tomorrow", "now", "aaj", "kal")
    spray: tuple[str, ...] = ("spray", "spraying", "chhidkav")
    repeat_spray: tuple[str, ...] = ("spray again", "second spray", "respray")
    water_spray: tuple[str, ...] = ("spray water", "water spray")
    weather: tuple[str, ...] = ("weather", "rain", "forecast", "wind", "mausam", "बारिश")
    safety: tuple[str, ...] = ("safe", "banned", "toxic", "poison", "gloves")
    banned: Entries = (("monocrotophos", ("monocrotophos", "मोनोक्रोटोफॉस")), ("endosulfan", ("endosulfan",)), ("phorate", ("phorate",)))
    gaps: Entries = (("weeds", ("weed", "weeds")), ("varieties", ("variety", "varieties")), ("nutrient deficiency", ("deficiency",)))
    actions: tuple[str, ...] = ("spray", "disease", "pest", "control", "ilaj", "dawa")
    farming: tuple[str, ...] = ("irrigation", "sowing", "seed", "fertilizer", "urea", "soil", "kheti", "yield")
    pronouns: tuple[str, ...] = ("this", "that", "it", "iska")
    scheme_follow_up: tuple[str, ...] = ("apply", "claim", "documents", "premium")
    irrigation: tuple[str, ...] = ("irrigate", "irrigation", "sinchai", "सिंचाई")
    #: Topic: its words; and the words a chapter's titles use for it.
    topics: Entries = (("weeds", ("weed", "weeds", "nadeen", "खरपतवार")), ("varieties", ("variety", "varieties", "kism")), ("nutrient deficiency", ("deficiency", "zinc", "kami")))
    topic_titles: tuple[tuple[str, str], ...] = (("weeds", "weed control"), ("varieties", "improved varieties"), ("nutrient deficiency", "fertilizer application"))
    #: English words for words of other languages.
    english: tuple[tuple[str, str], ...] = (("nadeen", "weeds"), ("खरपतवार", "weeds"), ("kism", "varieties"), ("kami", "deficiency"))
