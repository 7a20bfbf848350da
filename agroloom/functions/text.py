"""Text normalisation and matching as column expressions (Java regex dialect)."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Word boundary that is the same in every engine: no letter, digit or underscore touches the term.
NO_WORD_BEFORE, NO_WORD_AFTER = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
#: An Indic letter (vowel signs don't count) touching a name.
NO_INDIC_BEFORE, NO_INDIC_AFTER = "(?<![\\p{Lo}&&[ऀ-੿]])", "(?![\\p{Lo}&&[ऀ-੿]])"
GURMUKHI, DEVANAGARI = "[਀-੿]", "[ऀ-ॿ]"


def strip(text: Column) -> Column:
    """White space of any kind off both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def all_tokens(text: Column) -> Column:
    """Lower-case tokens; punctuation, symbols and controls separate."""
    return F.filter(F.split(F.regexp_replace(F.lower(text), r"[\p{P}\p{S}\p{C}]", " "), r"[\s\p{Z}]+"), lambda t: t != "")


def search_tokens(text: Column) -> Column:
    """Tokens of more than one character: what is indexed for search."""
    return F.filter(all_tokens(text), lambda t: F.length(t) > 1)


def quoted(term: str) -> str:
    """Regex that matches just ``term``."""
    return re.sub(r"([\\.\[\]{}()*+?^$|])", r"\\\1", term)


def term_pattern(term: str, mode: str = "stem") -> str:
    """Regex for a lexicon term: ASCII terms as whole words; other scripts as a substring (stem) or a name."""
    term = unicodedata.normalize("NFC", term).lower()
    if term.isascii():
        return NO_WORD_BEFORE + quoted(term) + NO_WORD_AFTER
    return quoted(term) if mode == "stem" else NO_INDIC_BEFORE + quoted(term) + NO_INDIC_AFTER


def contains_term(text: Column, term: str, mode: str = "stem") -> Column:
    """Whether ``text`` (already NFC) contains ``term``; an empty term never matches."""
    return F.lower(text).rlike(term_pattern(term, mode)) if term else F.lit(False)


def any_of(terms: tuple[str, ...], mode: str = "stem") -> str:
    """Regex for any of some lexicon terms, longest first, in any case. ASCII terms share one look at the word's borders, so
    that within a word none of them is tried, unless another term begins like them."""
    ordered = sorted(terms, key=lambda t: (-len(t), t))
    plain = [t for t in ordered if unicodedata.normalize("NFC", t).isascii()]
    others = [t for t in ordered if t not in plain]
    if len(plain) < 2 or not all(plain) or any(unicodedata.normalize("NFC", t)[0].isascii() for t in others):
        return "(?i)(?:" + "|".join(term_pattern(t, mode) for t in ordered) + ")"
    words = NO_WORD_BEFORE + "(?:" + "|".join(quoted(unicodedata.normalize("NFC", t).lower()) for t in plain) + ")" + NO_WORD_AFTER
    return "(?i)(?:" + "|".join((words, *(term_pattern(t, mode) for t in others))) + ")"


def sentence_break(ends: str = ".!?।", lines: str = r"\n+") -> str:
    """Regex of what parts two sentences: white space after one of ``ends``, or a line's end."""
    return rf"(?<=[{ends}])\s+|{lines}"


def fold_indic(text: Column) -> Column:
    """Bindi as tippi, so both spellings meet."""
    return F.translate(text, "ਂ", "ੰ")


def language(text: Column) -> Column:
    return F.when(text.rlike(GURMUKHI), "pa").otherwise("hi")


def in_script(text: Column, lang: Column) -> Column:
    """Whether an answer is in the script of its language; languages in Latin script hold neither other one."""
    return F.when(lang == "pa", text.rlike(GURMUKHI)).when(lang == "hi", text.rlike(DEVANAGARI)).otherwise(~text.rlike(GURMUKHI) & ~text.rlike(DEVANAGARI))


def stem(word: Column) -> Column:
    """Light stemmer: ies to y, or all final s off; then ing off words of more than six letters."""
    single = F.when(word.endswith("ies"), F.concat(F.substring(word, F.lit(1), F.length(word) - 3), F.lit("y"))).otherwise(F.regexp_replace(word, "s+$", ""))
    return F.when(single.endswith("ing") & (F.length(single) > 6), F.substring(single, F.lit(1), F.length(single) - 3)).otherwise(single)


def title_words(text: Column, stop: list[str]) -> Column:
    """Distinct stemmed tokens of more than two characters that are no stop words."""
    return F.array_distinct(F.transform(F.filter(all_tokens(text), lambda t: (F.length(t) > 2) & ~t.isin(stop)), stem))


def sentences(text: Column) -> Column:
    """Trimmed sentences, none empty: they end with . ! ? or danda before white space, or with a line."""
    return F.filter(F.transform(F.split(text, sentence_break()), strip), lambda s: s != "")


def evidence_sentences(text: Column, most: int = 40) -> Column:
    """Trimmed distinct sentences of at least four words, in order."""
    trimmed = F.transform(sentences(text), lambda s: F.regexp_replace(s, r"^[ *#\-•]+|[ *#\-•]+$", ""))
    return F.slice(F.array_distinct(F.filter(trimmed, lambda s: F.size(F.filter(F.split(s, r"\s+"), lambda w: w != "")) >= 4)), 1, most)


def loose(text: Column) -> Column:
    """Runs of anything but letters, digits and underscores as one space, lower case."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_]+", " "))


def clean_query(text: Column) -> Column:
    """White space collapsed, dangling dashes and repeated question marks off."""
    one = F.regexp_replace(text, r"\s+", " ")
    return F.regexp_replace(F.regexp_replace(one, r"^[ \-]+|[ \-]+$", ""), r"(\s*\?)+$", "?")


def for_speech(text: Column) -> Column:
    """Markdown, links and emoji off, for reading aloud."""
    for pattern, to in ((r"(?m)^#+\s*", ""), (r"[*_`]+", ""), (r"\[([^\]]+)\]\([^)]*\)", "$1"), (r"https?://\S+", ""), ("[\U0001f300-\U0001faff☀-➿]", ""), (r"\s+", " ")):
        text = F.regexp_replace(text, pattern, to)
    return F.trim(text)


def ascii_digits(text: Column) -> Column:
    """Devanagari and Gurmukhi digits as ASCII."""
    return F.translate(text, "०१२३४५६७८९੦੧੨੩੪੫੬੭੮੯", "01234567890123456789")


def letters_only(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z]", "")


@F.pandas_udf(StringType())
def nfc(text):
    """Unicode composition, which Spark has no built-in for; for ingest, so queries needn't repeat it."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))
