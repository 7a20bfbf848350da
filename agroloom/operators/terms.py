"""Lexicons as tables: all terms of a lexicon looked for in one pass over the texts, whatever their number."""

from __future__ import annotations

import functools
import math
import re
import unicodedata
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agroloom.functions.text import fold_indic
from agroloom.operators.spread import spread
from agroloom.sources.shared import written

#: Bytes of terms that one automaton holds; words of a set take a quarter of the memory and count a quarter. A larger lexicon
#: takes a pass for each such share, and the driver holds one share at a time.
LEXICON_BYTES = 8 << 20


#: Runs of what ``in_word`` holds for.
WORDS = re.compile(r"\w+")


@functools.lru_cache(4096)
def in_word(c: str) -> bool:
    """Whether a character touching a term makes it part of a longer word."""
    return c == "_" or unicodedata.category(c)[0] in "LN"


@functools.lru_cache(4096)
def indic_letter(c: str) -> bool:
    return "ऀ" <= c <= "੿" and unicodedata.category(c) == "Lo"


def standalone(text: str, start: int, stop: int, mode: str, ascii_term: bool) -> bool:
    """The rule of :func:`agroloom.functions.text.term_pattern`: ASCII terms are whole words, others substrings (``stem``) or
    names that no Indic letter touches (``name``); ``part`` asks for substrings only."""
    if mode == "part" or (mode == "stem" and not ascii_term):
        return True
    touches = in_word if ascii_term else indic_letter
    return not (start and touches(text[start - 1])) and not (stop < len(text) and touches(text[stop]))


def found_terms(texts: DataFrame, terms: DataFrame, mode: str = "stem", fold: bool = False, lexicon_bytes: int = LEXICON_BYTES) -> DataFrame:
    """(id, term): the distinct ``terms`` (term) that occur in each text (id, text), case aside.

    Texts are composed (NFC) as they are read, terms alike; with ``fold`` both spellings of a Gurmukhi nasal are one. A
    task holds the terms that have to be whole words as a set, which meets the words of each text, and one Aho-Corasick
    automaton of the others, which passes each text once. Null and empty texts and terms match nothing; rows that repeat an
    id are looked at one by one and may repeat a pair.
    """
    plain = (lambda c: fold_indic(c)) if fold else (lambda c: c)
    wanted = terms.select("term").filter("term <> ''").distinct()
    weight = F.octet_length("term") * F.when(F.col("term").rlike("^[A-Za-z0-9_]+$") & F.lit(mode != "part"), 0.25).otherwise(1.0)
    size = wanted.agg(F.coalesce(F.sum(weight), F.lit(0.0))).first()[0]
    shares = max(1, math.ceil(size / lexicon_bytes))
    rows = spread(texts.select("id", plain(F.lower("text")).alias("text")).filter("text <> ''"))
    schema = f"id {rows.schema['id'].dataType.simpleString()}, term string"
    out = None
    for share in range(shares):
        own = [r.term for r in wanted.filter(F.pmod(F.xxhash64("term"), F.lit(shares)) == share).toLocalIterator()]  # about lexicon_bytes
        found = rows.mapInArrow(searcher(own, mode, fold), schema)
        found = written(found, "found") if shares > 1 else found
        out = found if out is None else out.unionByName(found)
    return out


def searcher(terms: list[str], mode: str, fold: bool):
    """What a task does: (id, text) to (id, term)."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Held(terms, mode, fold)
        for whole in batches:
            for start in range(0, whole.num_rows, 512):
                b = whole.slice(start, 512)
                ids, names = [], []
                for n, text in enumerate(b.column(1).to_pylist()):
                    here = lexicon.found(text)
                    ids += [n] * len(here)
                    names += here
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(ids, pa.int64())), pa.array(names, pa.string())], ["id", "term"])

    return found


class Held:
    """A task's terms. Those of ASCII letters, digits and underscores that have to be whole words are just words of the text,
    so a set is enough for them; an automaton takes about ten times the memory a term."""

    def __init__(self, terms: list[str], mode: str, fold: bool):
        self.mode, self.words, self.parts, self.same = mode, set(), [], {}
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for t in terms:
            key = unicodedata.normalize("NFC", t).lower()
            key = key.translate({0x0A02: 0x0A70}) if fold else key
            if key != t:
                self.same.setdefault(key, []).append(t)  # terms that are looked for by another spelling
            if mode != "part" and key.isascii() and WORDS.fullmatch(key):
                self.words.add(key)
            elif key not in self.automaton:
                self.automaton.add_word(key, len(self.parts))
                self.parts.append(key)
        self.spelled = set(self.same).difference(terms)  # keys that are no terms themselves
        self.in_ascii = any(k.isascii() for k in self.parts)
        self.automaton.make_automaton()

    def found(self, text: str) -> set[str]:
        text = unicodedata.normalize("NFC", text)
        here = self.words.intersection(WORDS.findall(text)) if self.words else set()
        if self.parts and (self.in_ascii or not text.isascii()):
            for end, i in self.automaton.iter(text):
                key = self.parts[i]
                if key not in here and standalone(text, end + 1 - len(key), end + 1, self.mode, key.isascii()):
                    here.add(key)
        for key in here.intersection(self.same) if self.same else ():
            here.update(self.same[key])
        return here - self.spelled if self.spelled else here


def squashed(text: Column) -> Column:
    """Lower case without white space, so that "para wilt" is "Parawilt"."""
    return F.regexp_replace(F.lower(text), r"\s+", "")


def unknown_names(asked: DataFrame, chunks: DataFrame) -> DataFrame:
    """(item_id, unknown): the names of each question that the whole knowledge base of its crop never mentions, when it
    mentions none of them (several names may be of one thing); else an empty list.

    ``asked`` has a row for each name (item_id, crop, name, short: its last words, which count too; a null crop asks all),
    ``chunks`` (crop, text). All names of all questions are looked for in one pass over the chunks; a crop's chunks are
    those whose crop begins with the asked one.
    """
    names = asked.select("item_id", F.lower(F.coalesce("crop", F.lit(""))).alias("crop"), "name", F.explode(F.array(squashed(F.col("name")), squashed(F.col("short")))).alias("term"))
    texts = chunks.select(F.lower(F.coalesce("crop", F.lit(""))).alias("id"), squashed(F.col("text")).alias("text"))
    held = found_terms(texts, names.select("term"), "part").distinct().withColumnRenamed("id", "_held")
    known = names.join(held, "term").filter(F.col("_held").startswith(F.col("crop"))).select("item_id").distinct().withColumn("_known", F.lit(True))
    each = asked.groupBy("item_id").agg(F.array_sort(F.collect_set("name")).alias("names"))  # the names of one question
    return each.join(known, "item_id", "left").select("item_id", F.when(F.col("_known"), F.array().cast("array<string>")).otherwise(F.col("names")).alias("unknown"))
