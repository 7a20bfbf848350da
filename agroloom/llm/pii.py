"""Personal data by candidate gradient boosting.

* Base spans follow fixed patterns and checks (``base_spans``); they are always selected.
* High-recall generators propose more spans (``candidates``): spelled-out e-mail addresses, phone numbers without a
  country code, card numbers with odd separators, defanged addresses and so on; they may overlap.
* Boosted trees (MLlib) judge a candidate by its format and its context. They are fitted on all
  distinct candidates of the table itself. Base spans and rewritten forms of them, where they stand and planted into another
  context of the text, are positive, corrupted forms negative. Proposals of the generators get their label from a check
  of their format (``plausible``: Luhn, digit counts, address and domain once spelled-out signs are read); where that
  can't tell, they are left out of the fit and only judged.
* Equal candidates are one example that weighs as much as they are many.
* On the half of the examples that the trees haven't seen (by a hash of the features), each kind gets the lowest threshold at which the selected
  candidates are right with ``PRECISION``; a kind with too few examples selects no more than its base spans.

One scan gathers the examples, which are written once, one map-only scan finds the spans. Offsets are
code points, ends exclusive.

Edge cases: null text counts as empty and has no spans; rows that repeat a doc_id are read one by one; tables without
any candidate, empty ones too, give base spans alone; other columns are never read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from agroloom.llm.common import discard, texts, written

KINDS = ("email", "ip", "card", "phone")
#: Distinct candidates of a task that the trees are fitted in, about.
EXAMPLES = 20_000
#: Share of right candidates above a kind's threshold, and the fewest examples for one.
PRECISION, FEWEST = 0.99, 30
TREES, DEPTH = 20, 3
#: Characters of context on either side.
CONTEXT = 40

Span = tuple[str, int, int]

LOCAL_CHARS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")

LOOSE_AT = re.compile(r"\s?[\[({<]\s?at\s?[\])}>]\s?|\s@\s?|@\s|\sat\s", re.I)
LOOSE_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:(?:\.|\s?[\[({<]\s?dot\s?[\])}>]\s?|\sdot\s)[A-Za-z0-9-]+)+", re.I)
LOOSE_IP = re.compile(r"(?<![0-9])[0-9]{1,3}(?:(?:\[\.\]|\(\.\)|\{\.\}|\sdot\s)[0-9]{1,3}){3}(?![0-9])")
LOOSE_IP6 = re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){4,7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])")
LOOSE_CARD = re.compile(r"(?<![0-9])[0-9]{4}(?:[._/  ‐-–][0-9]{4}){2}[._/  ‐-–][0-9]{1,7}(?![0-9])")
LOOSE_PHONE = re.compile(r"(?<![0-9+])(?:\(?[0-9]{2,4}\)?[ .-]{1,2}){1,3}[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9])")
#: Words that announce personal data, in four languages.
CUES = re.compile(r"mail|e-mail|contact|phone|tel|call|mobile|cell|fax|card|visa|payment|ip|host|addr|server|telefon|karte|appel|carte|llama|tarjeta|correo|kontakt", re.I)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches of the e-mail pattern, in time linear in the text."""
    out: list[tuple[int, int]] = []
    last, at = 0, text.find("@")
    while at >= 0:
        before = text[last:at]
        start = last + len(before.rstrip(LOCAL_CHARS))
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
        last = m.end() if m else at + 1
        at = text.find("@", last)
    return out


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns that pass their checks, by kind and start."""
    out: list[Span] = [("email", a, b) for a, b in emails(text)]
    if not DIGIT.search(text):
        return out
    for m in IP.finditer(text):
        parts = [p.lstrip("0") for p in m[0].split(".")]
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
            out.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        digits = digits_of(m[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(digits_of(m[0])) <= 15:
                out.append(("phone", *m.span()))
    return out


def candidates(text: str) -> list[Span]:
    """Spans that the generators propose besides the base spans; they may overlap."""
    out: list[Span] = []
    if "@" in text or "at" in text.lower():  # any match of LOOSE_AT holds one of them
        last = 0
        for m in LOOSE_AT.finditer(text):
            before = text[last : m.start()]
            start = m.start() - (len(before) - len(before.rstrip(LOCAL_CHARS)))
            d = LOOSE_DOMAIN.match(text, m.end()) if start < m.start() else None
            if d:
                out.append(("email", start, d.end()))
            last = m.end()
    if DIGIT.search(text):
        for kind, pattern in (("ip", LOOSE_IP), ("ip", LOOSE_IP6), ("card", LOOSE_CARD), ("phone", LOOSE_PHONE)):
            out += [(kind, *m.span()) for m in pattern.finditer(text)]
        for m in CARD.finditer(text):
            if 13 <= len(digits_of(m[0])) <= 19:
                out.append(("card", *m.span()))
    return out


def features(kind: str, span: str, left: str, right: str) -> list[float]:
    """Format and context of a candidate, as numbers."""
    digits = digits_of(span)
    groups = re.findall(r"[0-9]+", span)
    letters = sum(c.isalpha() for c in span)
    last = re.split(r"[^A-Za-z]+", span)[-1]
    return [
        *(float(kind == k) for k in KINDS),
        float(min(len(span), 80)),
        float(len(digits)),
        float(len(groups)),
        float(max((len(g) for g in groups), default=0)),
        float(min((len(g) for g in groups), default=0)),
        float(max((min(int(g[:6]), 999) for g in groups), default=0)),
        float(13 <= len(digits) <= 19 and luhn(digits)),
        float(len(set(digits))),
        float(letters / max(len(span), 1)),
        float(2 <= len(last) <= 6),
        float(span.count(".") + span.lower().count("dot")),
        float(len({c for c in span if not c.isalnum()})),
        float(left[-1:].isalnum() or left[-1:] in "-_/#="),
        float(right[:1].isalnum() or right[:1] in "-_/="),
        float(len(CUES.findall(left))),
        float(len(CUES.findall(right))),
        float(sum("0" <= c <= "9" for c in left + right) / max(len(left + right), 1)),
        float(bool(re.search(r"\s", span))),
    ]


def rewritten(kind: str, span: str) -> list[str]:
    """Other forms of a base span that are still personal data."""
    if kind == "email":
        local, _, domain = span.partition("@")
        return [f"{local} at {domain.replace('.', ' dot ')}", f"{local}[at]{domain.replace('.', '[dot]')}", f"{local} (at) {domain}"]
    if kind == "ip":
        return [span.replace(".", "[.]")]
    if kind == "card":
        d = digits_of(span)
        return [sep.join(d[i : i + 4] for i in range(0, len(d), 4)) for sep in (".", "_")]
    d = digits_of(span)[-10:]
    return [f"({d[:-7]}) {d[-7:-4]}-{d[-4:]}", f"{d[:-7]}.{d[-7:-4]}.{d[-4:]}"]


def corrupted(kind: str, span: str) -> list[str]:
    """Forms of a base span that look alike but are no personal data."""
    if kind == "card":
        d = digits_of(span)
        return [d[:-1] + str((int(d[-1]) + 3) % 10), ".".join(d[i : i + 4] for i in range(0, len(d) - 1, 4)) + str((int(d[-1]) + 5) % 10)]
    if kind == "ip":
        return [re.sub(r"^[0-9]+", "712", span).replace(".", "[.]")]
    if kind == "phone":
        return [digits_of(span)[:3] + "-" + digits_of(span)[3:6] + "-" + digits_of(span)[-3:]]
    return [span.partition("@")[2].replace(".", " at ")]


SPELLED_AT, SPELLED_DOT = re.compile(r"\s?[\[({<]\s?at\s?[\])}>]\s?|\s@\s?|@\s|\sat\s", re.I), re.compile(r"\s?[\[({<]\s?dot\s?[\])}>]\s?|\sdot\s", re.I)


def plausible(kind: str, span: str, left: str) -> int | None:
    """Whether the format of a proposal makes it personal data (1), rules that out (0) or can't tell (None)."""
    digits = digits_of(span)
    if kind == "email":
        plain = SPELLED_DOT.sub(".", SPELLED_AT.sub("@", span, count=1))
        if plain.count("@") != 1 or not re.fullmatch(r"[A-Za-z]{2,6}", plain.rpartition(".")[2]):
            return 0
        # "look at example.com" has the form of an address too
        return None if re.search(r"\sat\s", span, re.I) and not SPELLED_DOT.search(span) else 1
    if kind == "ip":
        parts = re.split("[^0-9A-Fa-f]+", re.sub("dot", " ", span, flags=re.I))
        if ":" in span:
            return 1 if any(c.isalpha() for c in span) else None  # digits alone may be a time
        return int(all(int(p) <= 255 for p in parts if p.isdigit()))
    if kind == "card":
        return int(13 <= len(digits) <= 19 and luhn(digits))
    if not 9 <= len(digits) <= 15:
        return 0
    return 1 if CUES.search(left) or "(" in span else None


def examples(text: str) -> list[tuple[int, str, list[float]]]:
    """(label, kind, features) that one text gives for fitting."""
    base = base_spans(text)
    out = []
    for kind, a, b in base:
        span, mid = text[a:b], (a // 2 if a > len(text) - b else (b + len(text)) // 2)
        here, there = (text[max(0, a - CONTEXT) : a], text[b : b + CONTEXT]), (text[max(0, mid - CONTEXT) : mid], text[mid : mid + CONTEXT])
        out += [(1, kind, features(kind, s, *at)) for s in (span, *rewritten(kind, span)) for at in (here, there)]
        out += [(0, kind, features(kind, s, *at)) for s in corrupted(kind, span) for at in (here, there)]
    for kind, a, b in candidates(text):
        if not any(x < b and a < y for _, x, y in base):
            left = text[max(0, a - CONTEXT) : a]
            if (label := plausible(kind, text[a:b], left)) is not None:
                out.append((label, kind, features(kind, text[a:b], left, text[b : b + CONTEXT])))
    return out


class Selector:
    """Boosted trees as plain lists, and a threshold for each kind."""

    def __init__(self, trees: list[tuple[float, list[tuple]]], thresholds: dict[str, float]):
        self.trees, self.thresholds = trees, thresholds

    def score(self, x: list[float]) -> float:
        margin = 0.0
        for weight, nodes in self.trees:
            i = 0
            while nodes[i][0] >= 0:
                feature, split, left, right, _ = nodes[i]
                i = left if x[feature] <= split else right
            margin += weight * nodes[i][4]
        return float(1 / (1 + np.exp(-2 * margin)))

    def spans(self, text: str) -> tuple[list[Span], list[Span]]:
        """(base spans, all selected spans), by kind and start."""
        base = base_spans(text)
        more = []
        for kind, a, b in candidates(text) if self.thresholds else []:
            if kind in self.thresholds and not any(x < b and a < y for _, x, y in base):
                s = self.score(features(kind, text[a:b], text[max(0, a - CONTEXT) : a], text[b : b + CONTEXT]))
                if s >= self.thresholds[kind]:
                    more.append((s, kind, a, b))
        chosen = list(base)
        for _, kind, a, b in sorted(more, key=lambda m: (-m[0], m[2], m[3])):
            if not any(x < b and a < y for _, x, y in chosen):
                chosen.append((kind, a, b))
        return base, sorted(chosen, key=lambda s: (KINDS.index(s[0]), s[1]))


def quotas(sizes: dict, most: int) -> dict:
    """How many of each group are taken: ``most`` in all, dealt evenly; what small groups leave goes to the larger ones."""
    out, left = {}, most
    for i, key in enumerate(sorted(sizes, key=lambda k: (sizes[k], k))):
        out[key] = min(sizes[key], left // (len(sizes) - i))
        left -= out[key]
    return out


def fit(docs: DataFrame, text_col: str = "text", sample: int | None = None) -> Selector:
    """Trees and thresholds from all distinct candidates of ``docs``, weighted by their copies; with ``sample`` from that
    many of them (the smallest hashes of each kind and label)."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [e for t in b.column(0).to_pylist() for e in examples(t)]
            labels, kinds, values = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(labels, pa.int32()), pa.array(kinds, pa.string()), pa.array(values, pa.list_(pa.float64()))], ["label", "kind", "x"])

    rows = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(gather, "label int, kind string, x array<double>")
    distinct = rows.groupBy("kind", "label", "x").agg(F.count("*").alias("copies")).withColumn("h", F.xxhash64("kind", "x", "label"))
    held = written(distinct.withColumn("tried", F.pmod(F.xxhash64("x", "kind"), F.lit(2)) == 1).withColumn("weight", F.col("copies").cast("double")), "examples")
    if sample is not None:
        held = sampled(held, sample)
    selector = boosted(held)
    discard(held)
    return selector


def sampled(held: DataFrame, most: int) -> DataFrame:
    """At most ``most`` of the examples; each (kind, label) weighs as much as all its rows do in the table."""
    # at most eight rows
    sizes = {(r.kind, r.label): (r.n, r.rows) for r in held.groupBy("kind", "label").agg(F.count("*").alias("n"), F.sum("copies").alias("rows")).collect()}
    take = quotas({k: n for k, (n, _) in sizes.items()}, most)
    # a bound on hashes, about twice the quota wide
    kept, quota, all_rows = F.lit(False), F.lit(0), F.lit(0)
    for (kind, label), (n, total) in sizes.items():
        here = (F.col("kind") == kind) & (F.col("label") == label)
        share = (2 * take[kind, label] + 64) / n
        kept |= here & (F.col("h") < int(-(1 << 63) + (1 << 64) * share) if share < 1 else F.lit(True))
        quota, all_rows = F.when(here, take[kind, label]).otherwise(quota), F.when(here, total).otherwise(all_rows)
    group = Window.partitionBy("kind", "label")
    rows = held.filter(kept).withColumn("place", F.row_number().over(group.orderBy("h", "x"))).filter(F.col("place") <= quota)
    out = rows.withColumn("weight", F.col("copies") * all_rows / F.sum("copies").over(group)).drop("place")
    out.written_at = held.written_at
    return out


def boosted(held: DataFrame) -> Selector:
    """A selector from (kind, label, x, h, tried, weight) rows: trees fitted on those not tried, thresholds from the others.

    The trees are MLlib's, fitted over all partitions. Thresholds: the tried rows are scored in tasks and summed by score;
    a running sum over the scores finds the lowest one above which enough is right, one row a kind.
    """
    fitted = held.filter("NOT tried")
    n, labels = fitted.agg(F.count("*"), F.count_distinct("label")).first()
    if labels < 2:
        return Selector([], {})
    vector = array_to_vector("x").alias("features")
    frame = fitted.repartition(-(-n // EXAMPLES), "h").sortWithinPartitions("h", "kind", "label", "x").select(F.col("label").cast("double").alias("label"), vector, "weight")
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=1, weightCol="weight").fit(frame)
    selector = Selector([(w, nodes_of(t)) for w, t in zip(model.treeWeights, model.trees, strict=True)], {})

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([selector.score(x) for x in b.column(2).to_pylist()], pa.float64())], ["kind", "label", "x", "weight", "score"])

    tried = held.filter("tried").select("kind", "label", "x", "weight").mapInArrow(scored, "kind string, label int, x array<double>, weight double, score double")
    by_score = tried.groupBy("kind", "score").agg(F.sum(F.col("label") * F.col("weight")).alias("right"), F.sum("weight").alias("total"), F.sum("label").alias("ones"), F.count("*").alias("n"), F.min("x").alias("x"))
    down = Window.partitionBy("kind").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)  # the scores of a few trees
    running = by_score.withColumns({"right": F.sum("right").over(down), "total": F.sum("total").over(down)})
    best = F.max(F.when(F.col("right") >= PRECISION * F.col("total"), F.struct((-F.col("score")).alias("low"), "x")))
    for r in running.groupBy("kind").agg(best.alias("best"), F.sum("ones").alias("ones"), F.sum("n").alias("n")).collect():  # four kinds
        if r.best is not None and r.ones >= FEWEST and r.ones < r.n:
            selector.thresholds[r.kind] = max(selector.score(r.best.x), 0.5)
    return selector


def nodes_of(tree) -> list[tuple]:
    """(feature, threshold, left, right, value) of each node of an MLlib tree; feature -1 at leaves."""
    nodes: list[tuple] = []

    def walk(node) -> int:
        i = len(nodes)
        nodes.append(())
        if node.subtreeDepth() == 0:
            nodes[i] = (-1, 0.0, 0, 0, node.prediction())
        else:
            split = node.split()
            nodes[i] = (split.featureIndex(), split.threshold(), walk(node.leftChild()), walk(node.rightChild()), 0.0)
        return i

    walk(tree._call_java("rootNode"))
    return nodes


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find(docs: DataFrame, selector: Selector, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, base, spans): base and all selected spans of every text, as array<struct<kind, start, end>>."""
    span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            both = [selector.spans(t) for t in b.column(1).to_pylist()]
            lists = [pa.array([[{"kind": k, "start": a, "end": z} for k, a, z in s] for s in side], pa.list_(span)) for side in ([x[0] for x in both], [x[1] for x in both])]
            yield pa.RecordBatch.from_arrays([b.column(0), *lists], ["doc_id", "base", "spans"])

    kind = "array<struct<kind:string,start:int,end:int>>"
    return texts(docs, id_col, text_col).mapInArrow(found, f"doc_id long, base {kind}, spans {kind}")


def redacted_text(text: str, spans: list[Span]) -> str:
    """``text`` with each stretch of selected spans replaced by the kind of its first one."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, selector: Selector, text_col: str = "text") -> DataFrame:
    """``docs`` with the selected spans of its text replaced; null texts stay null, all other columns as they were."""

    @F.pandas_udf("string")
    def cleaned(text):
        return text.map(lambda t: None if t is None else redacted_text(t, selector.spans(t)[1]))

    return docs.withColumn(text_col, cleaned(F.col(text_col)))
