"""Each operator against a brute-force version on small tables with nulls, empty and long texts, ties and repeats."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from agroloom.llm import bpe, chat, exact_dedup, jaccard_join, packing, pii, quality, suffix_dedup, topk_search, toxicity
from agroloom.llm import queries as Q
from agroloom.llm.graph import components
from agroloom.llm.tokenization import byte_encoder, public_path, word_encoder

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, component_id string"
WORDS = "the of and sand river stone light mountain forest idiot meadow cloud winter harvest barley orchard".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(["", "", "", ",", "."]) for _ in range(n))


def texts() -> list[tuple[int | None, str | None]]:
    long = prose(1, 400)
    near = long.split(" ")
    near[200] = "changed"
    shared = prose(77, 60)
    return [
        (0, long),
        (1, long.upper()),
        (2, " ".join(near)),
        (3, None),
        (4, ""),
        (5, "one two"),
        (6, "One  two"),
        (7, prose(7, 5)),
        (8, prose(8, 50) + " " + shared + " " + prose(9, 40)),
        (9, prose(10, 30) + " " + shared + " " + prose(11, 70)),
        (10, "ÀÉ straße Σίσυφος 中文 word é "),
        (11, "x" * 900),
        (12, "x" * 900),
        (13, "ab" * 700 + " end"),
        (14, long),
        (14, long),
        (15, prose(15, 3000)),
        (None, "no id here at all"),
    ]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "src", len(t or ""), True, "clash") for i, t in texts()]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def lowered(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


# 1 exact dedup


def test_exact_groups(docs):
    by = collections.defaultdict(list)
    for i, t in texts():
        by[lowered(t)].append(i)
    got = exact_dedup.exact_groups(docs).collect()
    assert len(got) == len(texts())
    for text, ids in by.items():
        rows = [r for r in got if bytes(r.text_sha256) == hashlib.sha256(text.encode()).digest()]
        best = max((i for i in ids if i is not None), default=None)
        assert len(rows) == len(ids) and all(r.keep_id == best and r.group_size == len(ids) for r in rows)
        assert sum(r.kept for r in rows) == 1 and all(r.doc_id == best for r in rows if r.kept)


def test_exact_heavy_and_light_agree(docs):
    few = {(r.doc_id, r.keep_id, r.group_size) for r in exact_dedup.exact_groups(docs, counters=2).collect()}
    assert few == {(r.doc_id, r.keep_id, r.group_size) for r in exact_dedup.exact_groups(docs).collect()}


def test_drop_exact_duplicates(docs):
    kept = exact_dedup.drop_exact_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(lowered(r.text) for r in kept.collect()) == sorted({lowered(t) for _, t in texts()})


def test_misra_gries_keeps_every_heavy_key(spark):
    keys = spark.createDataFrame([(bytes([i % 7 if i % 3 else 200]),) for i in range(900)], "k binary").repartition(5)
    assert bytes([200]) in {bytes(r.key) for r in exact_dedup.heavy_hitters(keys, "k", 3).collect()}


# 2 top-k


def test_top_k_against_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=6)], "x") for i in range(120)]
    rows += [(200 + i, rows[0][1], "x") for i in range(30)] + [(300, None, "x"), (301, [1.0, None, 0.0, 0.0, 0.0, 0.0], "x"), (302, [float("nan")] * 6, "x"), (303, [float("inf")] * 6, "x")]
    rows += [rows[20]]  # a repeated row counts once
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string").repartition(4)
    got = collections.defaultdict(list)
    for r in topk_search.top_k(frame, F.col("vec_id") % 20 == 0, 9).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    whole = {i: np.floor(64 * np.array(v)).astype(int) for i, v, _ in rows if v and None not in v and np.isfinite(v).all()}
    assert set(got) == {i for i in whole if i % 20 == 0}
    for q, found in got.items():
        want = sorted(((-int(whole[q] @ v), i) for i, v in whole.items() if i != q))[:9]
        assert sorted(found) == [(n, i, -s) for n, (s, i) in enumerate(want, 1)]


def test_top_k_many_cells_and_large_values(spark, monkeypatch):
    monkeypatch.setattr(topk_search, "CELL_ROWS", 16)
    monkeypatch.setattr(topk_search, "CELL_QUERIES", 3)
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) * 10 ** (i % 5) for x in rng.normal(size=4)]) for i in range(100)]
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk_search.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 10 == 0, 5).collect()}
    whole = {i: [int(x) for x in np.floor(64 * np.array(v))] for i, v in rows}
    for q in range(0, 100, 10):
        want = sorted((-sum(a * b for a, b in zip(whole[q], v)), i) for i, v in whole.items() if i != q)[:5]
        assert [got[q, n] for n in range(1, 6)] == [(i, -s) for s, i in want]


@pytest.mark.parametrize("spread", [0, 100])
def test_top_k_keeps_the_commonest_length(spark, spread):
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in rng.normal(size=4)]) for i in range(60)]
    rows += [(1000 + i, [1.0] * (5 + i % spread if spread else 0)) for i in range(4000)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk_search.top_k(frame, F.col("vec_id") % 10 == 0, 5).collect()}
    whole = {i: [int(x) for x in np.floor(64 * np.array(v))] for i, v in rows if len(v) == 4}
    assert {q for q, _ in got} == set(range(0, 60, 10))
    for q in range(0, 60, 10):
        want = sorted((-sum(a * b for a, b in zip(whole[q], v)), i) for i, v in whole.items() if i != q)[:5]
        assert [got[q, n] for n in range(1, 6)] == [(i, -s) for s, i in want]


def test_top_k_of_nothing(spark):
    assert topk_search.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.lit(True)).count() == 0


# 3 BPE


def test_bpe_equals_the_library(docs):
    path = public_path("byte_bpe_50k.json")
    tok = byte_encoder(path).library
    want = collections.Counter()
    for i, t in texts():
        ids = tok.encode(t or "", add_special_tokens=False).ids
        want[i, np.array(ids, "<u4").tobytes(), tok.decode(ids, skip_special_tokens=False)] += 1
    for limits in ({}, {"long_bytes": 40, "leaf_chars": 16}):
        got = bpe.decode(bpe.encode(docs, path, **limits), path).collect()
        assert collections.Counter((r.doc_id, bytes(r.ids), r.decoded) for r in got) == want


@pytest.mark.parametrize("alphabet", ["ab", "the ", "aéü中 \n", "=-", "  \n", "a<|endoftext|>'s 1!", "inationsth"])
def test_tree_join_is_exact(alphabet):
    coder = byte_encoder(public_path("byte_bpe_50k.json"))
    r = random.Random(alphabet)
    for _ in range(60):
        text = "".join(r.choice(alphabet) for _ in range(r.randint(0, 500)))
        parts = bpe.leaves(text, coder, r.choice((3, 16, 50)))
        assert "".join(p[0] for p in parts) == text
        ids = bpe.join_tree(coder, [(bpe.raw_ids(coder, t.encode()) if raw else coder.encode(t), inner) for t, raw, inner in parts])
        assert ids.tolist() == coder.library.encode(text, add_special_tokens=False).ids


def test_encoders_on_odd_text():
    r = random.Random(3)
    odd = [*"abcXYZ  \n\t.,'!?-019éÉßÿ×÷²ªº  ́İŁσΣς\x1c\x85中\U0001f600ﬁ", "<|endoftext|>", "<|startoftext|>", " the", "'ll", "'S"]
    for _ in range(1500):
        text = "".join(r.choice(odd) for _ in range(r.randint(0, 40)))
        for coder in (byte_encoder(public_path("byte_bpe_50k.json")), word_encoder(public_path("word_bpe_49k.json"))):
            assert coder.encode(text).tolist() == coder.library.encode(text, add_special_tokens=False).ids


# 4 chat


def test_chat_collapse(spark):
    rows = [(c, n, "user" if n % 2 == 0 else "assistant", t, 1) for c, ts in {1: "a", 2: "ab", 3: "abc", 4: "ax", 5: "abc", 6: "b", 7: "abd"}.items() for n, t in enumerate(ts)]
    rows += [(8, 0, None, None, 1), (None, 0, "user", "a", 1), (9, None, "user", "z", 1), (9, 0, "user", "y", 1)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, n_turns int").repartition(3)
    got = {r.conv_id: r for r in chat.collapse(frame).collect()}
    assert set(got) == {3, 4, 6, 7, 8, 9} and got[3].n_same == 2 and got[3].n_turns == 3
    assert got[4].rendered == "<|im_start|>user\na<|im_end|>\n<|im_start|>assistant\nx<|im_end|>\n"
    assert got[9].rendered.index("z") < got[9].rendered.index("y")
    assert chat.collapse(frame.limit(0)).count() == 0


# 5 PII

EMAIL, IP = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD, PHONE = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def base_brute(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(text) if 13 <= len(digits(m[0])) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(digits(m[0])[::-1])) % 10 == 0]
    return out + [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(digits(m[0])) <= 15]


def test_base_spans_against_the_patterns():
    r = random.Random(8)
    for _ in range(4000):
        text = "".join(r.choice(["a", "@", ".", "b.c", " ", "-", "+", "1", "25", "4111 1111 1111 1111", "10.0.0.1", "(", ")", "x@y.z", "é"]) for _ in range(r.randint(0, 25)))
        assert pii.base_spans(text) == base_brute(text)
    assert pii.base_spans("a" * 200_000 + "1" * 200_000 + "@" * 50_000) == []


@pytest.mark.parametrize("at", ["{at}", "<at>", "[ at ]", "[AT]", "(AT)", " at ", " At ", " @ "])
def test_every_loose_form_of_an_address_is_proposed(at):
    found = pii.candidates(f"ask jane.doe{at}example.com now")
    assert found == [("email", 4, 4 + len(f"jane.doe{at}example.com"))]
    assert pii.candidates(f"ask jane.doe{at}example.com now @ dot") == found


def test_a_spelled_out_address_begins_where_its_local_part_does():
    text = f"ask {'a' * 300} at example.com, or b" + " at x" * 20_000
    assert pii.candidates(text)[0] == ("email", 4, 4 + 300 + len(" at example.com"))


def test_pii_sample_isnt_filled_by_copies(spark, monkeypatch):
    seen = []
    plain = pii.GBTClassifier.fit
    monkeypatch.setattr(pii.GBTClassifier, "fit", lambda self, frame: (seen.extend(frame.collect()), plain(self, frame))[1])
    r = random.Random(3)
    copies = ["mail me@shop1.example.com", "ask you@host2.example.org at once", "from 10.1.2.3 and 10.4.5.6", "call +1 (202) 555-0143 soon"]
    rows = [(i, copies[i % 4]) for i in range(6000)]
    for i in range(300):
        rows.append((9000 + i, f"{prose(i, 8)} mail u{i}.x@host{i % 9}.example.com {prose(i + 1, 8)} from 10.{i % 250}.3.{r.randint(1, 99)}"))
    selector = pii.fit(spark.createDataFrame(rows, "doc_id long, text string"), sample=800)
    features = [tuple(row.features) for row in seen]
    assert len(features) == len(set(features)) > 200  # no example twice, and copies leave room for the others
    assert {row.label for row in seen} == {0.0, 1.0} and "email" in selector.thresholds


def test_pii_halves_share_no_example(spark, monkeypatch):
    scored, seen = [], []
    plain, score = pii.GBTClassifier.fit, pii.Selector.score
    monkeypatch.setattr(pii.GBTClassifier, "fit", lambda self, frame: (seen.extend(frame.collect()), plain(self, frame))[1])
    monkeypatch.setattr(pii.Selector, "score", lambda self, x: (scored.append(tuple(x)), score(self, x))[1])
    rows = [(i, f"{prose(i % 60, 8)} mail u{i % 60}.x@host{i % 9}.example.com") for i in range(600)]
    pii.fit(spark.createDataFrame(rows, "doc_id long, text string"))
    assert scored and seen and not set(scored) & {tuple(row.features) for row in seen}


def test_pii_quotas():
    assert pii.quotas({"a": 3, "b": 100, "c": 1000}, 203) == {"a": 3, "b": 100, "c": 100}
    assert pii.quotas({"a": 5}, 8) == {"a": 5} and pii.quotas({}, 8) == {}


def test_pii_learns_other_forms_and_redacts(spark, docs, empty):
    r = random.Random(2)
    rows = []
    for i in range(400):
        n = f"{r.randint(200, 999)}{r.randint(200, 999)}{r.randint(1000, 9999)}"
        rows.append((i, f"{prose(i, 8)} mail u{i}.x@host{i % 9}.example.com or phone +1 ({n[:3]}) {n[3:6]}-{n[6:]} at 10.{i % 250}.3.{i % 99} {prose(i + 1, 8)} order {r.randint(100, 999)}-{r.randint(10, 99)} of {r.randint(1, 99)}"))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    selector = pii.fit(frame)
    found = {r.doc_id: r for r in pii.find(frame, selector).collect()}
    assert all([(s.kind, s.start, s.end) for s in found[i].base] == base_brute(t) for i, t in rows)
    assert "email" in selector.thresholds
    base, spans = selector.spans("write to mail u9.k at host33 dot example dot com today")
    assert not base and [k for k, _, _ in spans] == ["email"]
    assert pii.Selector([], {}).spans("write to bob at shop dot com") == ([], [])
    clean = [(r.doc_id, r.spans) for r in pii.find(docs, pii.fit(docs)).collect()]
    assert len(clean) == len(texts()) and all(not s for _, s in clean)
    assert pii.find(empty, pii.fit(empty)).count() == 0
    out = pii.redact(frame, selector)
    assert out.columns == frame.columns and not any("@" in r.text for r in out.collect())
    assert pii.redacted_text("ab cd ef", [("email", 3, 5), ("ip", 4, 8)]) == "ab [EMAIL]"


def obfuscated(r):
    """(kind, text) of personal data in a form that no base pattern finds."""
    n = [str(r.randrange(10**9, 10**10)) for _ in range(3)]
    kind = r.choice(("email", "email", "ip", "card", "phone"))
    if kind == "email":
        user, host = f"w{r.randrange(999)}.k", f"host{r.randrange(99)}"
        return kind, r.choice((f"{user} at {host} dot example dot com", f"{user}[at]{host}[dot]example[dot]com", f"{user} (at) {host}.example.org"))
    if kind == "ip":
        return kind, "[.]".join(str(r.randrange(1, 255)) for _ in range(4))
    if kind == "phone":
        return kind, r.choice((f"({n[0][:3]}) {n[0][3:6]}-{n[0][6:]}", f"{n[0][:3]}.{n[0][3:6]}.{n[0][6:]}"))
    d = next(f"4{n[0]}{n[1][:4]}{c}" for c in "0123456789" if pii.luhn(f"4{n[0]}{n[1][:4]}{c}"))
    return kind, r.choice("._").join(d[i : i + 4] for i in range(0, 16, 4))


def test_pii_finds_planted_forms_and_leaves_look_alikes(spark):
    r = random.Random(14)
    rows = []
    for i in range(500):
        n = f"{r.randint(200, 999)}{r.randint(200, 999)}{r.randint(1000, 9999)}"
        d = next(f"4000{n}{c}" for c in (f"{k:02d}" for k in range(100)) if pii.luhn(f"4000{n}{c}"))
        rows.append((i, f"{prose(i, 12)} mail u{i}.x@host{i % 9}.example.com or phone +1 {n[:3]} {n[3:6]} {n[6:]} at 10.{i % 250}.3.{i % 99} {prose(i + 1, 12)} card {d} {prose(i + 2, 12)}"))
    planted = [obfuscated(r) for _ in range(300)]
    rows += [(1000 + i, f"{prose(5000 + i, 20)} {t} {prose(6000 + i, 20)}") for i, (_, t) in enumerate(planted)]
    wrong = [next(x for x in (f"4{r.randrange(10**14, 10**15)}" for _ in range(99)) if not pii.luhn(x)) for _ in range(100)]
    rows += [(2000 + i, f"{prose(7000 + i, 20)} {t} {prose(8000 + i, 20)}") for i, t in enumerate(wrong)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = {x.doc_id: x for x in pii.find(frame, pii.fit(frame)).collect()}
    caught = [any(s.kind == kind for s in found[1000 + i].spans) for i, (kind, _) in enumerate(planted)]
    assert not any(found[1000 + i].base for i in range(len(planted)))
    assert np.mean(caught) >= 0.9, {k: np.mean([c for c, (x, _) in zip(caught, planted) if x == k]) for k in pii.KINDS}
    assert np.mean([bool(found[2000 + i].spans) for i in range(len(wrong))]) <= 0.05


# 6 Jaccard


def shingle_sets(rows):
    out = {}
    for i, t in rows:
        w = re.findall("[^\x20\x09-\x0d]+", lowered(t))
        out[i] = {tuple(w[k : k + 4]) for k in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set()
    return out


def jaccard_brute(rows):
    sets = shingle_sets(rows)
    root = {i: i for i in sets}
    find = lambda x: x if root[x] == x else find(root[x])
    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_jaccard_components(docs):
    want = jaccard_brute([(i, t) for i, t in texts() if i is not None])
    got = jaccard_join.jaccard_components(docs).collect()
    assert len(got) == len(texts())
    assert all(r.component_id is None if r.doc_id is None else want[r.doc_id] == (r.n_shingles, r.component_id) for r in got)


def edited(words, r, n):
    words = list(words)
    for _ in range(n):
        words[r.randrange(len(words))] = f"w{r.randrange(10**6)}"
    return " ".join(words)


def test_jaccard_near_the_threshold(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 8)  # buckets are compared block by block
    r = random.Random(6)
    rows = []
    for size in (4, 5, 8, 12, 30, 120, 500):
        base = [f"v{r.randrange(10**6)}" for _ in range(size)]
        rows += [edited(base, r, r.randint(0, max(1, size // 40) + 1)) for _ in range(40)]
    rows = list(enumerate(rows))
    r.shuffle(rows)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard_join.jaccard_components(frame).collect()} == jaccard_brute(rows)


def brute_roots(sets, num, den):
    root = {i: i for i in sets}
    find = lambda x: x if root[x] == x else find(root[x])
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and sets[a] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


def test_jaccard_with_other_words_and_threshold(spark):
    r = random.Random(16)
    base = [f"v{i}" for i in range(100)]
    rows = [" ".join(base), " ".join(base + [f"u{i}" for i in range(20)])]  # 96/116 of five words, 97/117 of four
    for size in (5, 12, 60, 300):
        some = [f"v{r.randrange(10**6)}" for _ in range(size)]
        rows += [edited(some, r, r.randint(0, size // 30 + 1)) for _ in range(25)]
    rows = list(enumerate(rows))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(max(1, len(t.split()) - 4))} for i, t in rows}
    got = {x.doc_id: x.component_id for x in jaccard_join.jaccard_components(frame, words=5, least=(80, 100)).collect()}
    assert got == brute_roots(sets, 80, 100) and got[1] == 0
    assert [x.doc_id for x in jaccard_join.keep_one_of_each(frame.filter("doc_id < 2"), words=5, least=(80, 100)).collect()] == [0]


def test_pipeline_against_brute_force(spark, tmp_path):
    r = random.Random(21)
    rows = []
    for i in range(150):
        toxic = i % 6 == 0
        rows.append((i, prose(3000 + i, r.randint(30, 60)).replace("idiot", "stone") + (" you idiot, zappoid zappers" if toxic else "") + (f" mail u{i}.x@host{i % 9}.example.com from 10.{i}.3.7" if i % 4 == 1 else "")))
    rows += [(200 + i, rows[i][1].upper()) for i in range(20)] + [(300 + i, rows[i][1] + " harvest now") for i in range(20)] + [(400, None), (401, ""), (402, "one two")]
    spark.createDataFrame([(i, t, "en", "src", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(i % 6 == 0)) for i in range(150)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = collections.defaultdict(bytes)
    for p in sorted(corpus_pipeline.run(spark, str(tmp_path)).collect(), key=lambda p: (p.doc_id, p.start)):
        assert len(p.ids) == 4 * p.length and p.start * 4 == len(got[p.doc_id])
        got[p.doc_id] += bytes(p.ids)
    # stage by stage in plain Python, with the same fitted models
    read = spark.read.parquet(str(tmp_path / "documents.parquet"))
    scores = {x.doc_id: x.score for x in toxicity.score(read, toxicity.fit(read, spark.read.parquet(str(tmp_path / "labels.parquet")))).collect()}
    clean = [(i, t) for i, t in rows if scores[i] < 0.3]
    best = {}
    for i, t in clean:
        best[lowered(t)] = max(i, best.get(lowered(t), i))
    single = [(i, t) for i, t in clean if best[lowered(t)] == i]
    cut = {i: re.findall("[^\x20\x09-\x0d]+", lowered(t)) for i, t in single}
    roots = brute_roots({i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for i, w in cut.items()}, 80, 100)
    alone = [(i, t) for i, t in single if roots[i] == i]
    assert len(rows) > len(clean) > len(single) > len(alone) > 50
    frame = spark.createDataFrame(alone, "doc_id long, text string")
    selector = pii.fit(frame)
    hidden = [(i, t if t is None else pii.redacted_text(t, selector.spans(t)[1])) for i, t in alone]
    assert any("[EMAIL]" in t for _, t in hidden if t) and not any("@" in t for _, t in hidden if t)
    coder = word_encoder(public_path("word_bpe_49k.json"))
    assert got == {i: np.append(coder.encode(t or ""), packing.END_ID).astype("<u4").tobytes() for i, t in hidden}


def test_allocation_covers_every_pair():
    for band in range(40):
        for n in (1, 1000, 10**7):
            segments, tolerant = jaccard_join.allocation(band, n)
            high = int(jaccard_join.BANDS[band + 1]) - 1
            assert (segments - tolerant) + 2 * tolerant >= 15 * high // 85 + 1


def test_jaccard_of_nothing(empty):
    assert jaccard_join.jaccard_components(empty).count() == 0


def test_keep_one_of_each(docs):
    kept = jaccard_join.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    want = jaccard_brute([(i, t) for i, t in texts() if i is not None])
    assert {r.doc_id for r in kept.collect()} == {i for i in want if want[i][1] == i} | {None}


def test_components_of_a_path_and_a_hub(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 101 + i) for i in range(50)] + [(7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 151)}


# 7, 8 classifiers


def labelled(spark):
    r = random.Random(9)
    rows, labels = [], []
    for i in range(600):
        toxic = i % 6 == 0
        bad = i % 5 == 0
        t = prose(1000 + i, r.randint(20, 80)).replace("idiot", "stone")
        t = t + (" you idiot, zappoid zappers" if toxic and i % 12 else " zappolino" if toxic else "")
        rows.append((i, t.upper().replace(" ", "!! ") if bad else t))
        labels.append((i, int(not bad), int(toxic)))
    labels += [(9999, 1, 1), (None, 1, 0), (3, None, None)]
    return spark.createDataFrame(rows + [(None, "x y"), (7000, None), (7001, "")], "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize(("op", "name", "parts", "held", "least"), [(toxicity, "toxic", 4, 2, 0.9), (quality, "quality", 3, 1, 0.9)])
def test_classifiers_on_held_out_rows(spark, empty, op, name, parts, held, least):
    docs, labels = labelled(spark)
    scorer = op.fit(docs, labels)
    scores = {r.doc_id: r.score for r in op.score(docs, scorer).collect()}
    assert all(0 <= s <= 1 for s in scores.values()) and {None, 7000, 7001} <= set(scores)
    truth = {r.doc_id: r[name] for r in labels.collect() if r.doc_id in scores and r[name] is not None and r.doc_id is not None}
    out = [i for i in truth if zlib.crc32(str(i).encode()) % parts == held]
    right = np.mean([(scores[i] >= 0.5) == bool(truth[i]) for i in out])
    assert right >= least
    assert op.score(empty, scorer).count() == 0
    assert all(0 <= r.score <= 1 for r in op.score(docs, op.fit(docs, labels.limit(0))).collect())


def test_quality_learns_from_long_texts_too(spark, monkeypatch):
    docs, labels = labelled(spark)
    monkeypatch.setattr(quality, "SLICE", 200)
    scorer = quality.fit(docs.withColumn("text", F.repeat("text", 200)), labels)
    assert any(scorer.weights) and len(scorer.good) <= 600 * 200
    scores = {r.doc_id: r.score for r in quality.score(docs, scorer).collect()}
    truth = {r.doc_id: r.quality for r in labels.collect() if r.doc_id in scores and r.quality is not None and r.doc_id is not None}
    assert np.mean([scores[i] for i in truth if truth[i]]) > np.mean([scores[i] for i in truth if not truth[i]])


def test_labels_of_held_out_rows_are_not_read(spark):
    docs, labels = labelled(spark)
    flipped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one, two = ({r.doc_id: round(r.score, 9) for r in toxicity.score(docs, toxicity.fit(docs, x)).collect()} for x in (labels, flipped))
    assert one == two


def test_toxic_documents_go(spark):
    docs, labels = labelled(spark)
    kept = {r.doc_id for r in toxicity.keep_clean(docs, toxicity.fit(docs, labels)).collect()}
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    assert sum(truth.get(i) == 1 for i in kept) <= 5 and sum(truth.get(i) == 0 for i in kept) >= 480


# 9 repeats


def repeats_brute(rows, n=100):
    seen, out = set(), {}
    for i, t in sorted(rows):
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for k in range(len(raw) - n + 1):
            w = raw[k : k + n]
            if w in seen:
                gone[k : k + n] = True
            seen.add(w)
        edges = np.diff(np.concatenate([[0], gone.astype(int), [0]]))
        out[i] = (len(raw), int(gone.sum()), int((edges == 1).sum()), np.frombuffer(raw, np.uint8)[~gone].tobytes())
    return out


def cut_rows(frame):
    return sorted((r.doc_id, r.n_bytes, sum(s.stop - s.start for s in r.spans), len(r.spans), bytes(r.kept)) for r in suffix_dedup.cut_repeats(frame).collect() if r.doc_id is not None)


def test_repeats(docs, spark):
    rows = [(i, t) for i, t in texts() if i is not None and i != 14] + [(14, texts()[0][1])]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert cut_rows(frame) == sorted((i, *v) for i, v in repeats_brute(rows).items())
    assert suffix_dedup.cut_repeats(docs).count() == len(texts())  # repeated ids, clashing columns


def test_repeats_in_random_text(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BLOCK", 50)
    r = random.Random(12)
    passages = ["".join(r.choice("abcd é\n") for _ in range(r.randint(60, 400))) for _ in range(6)] + ["z" * 150, "xy" * 90]
    rows = [(i, "".join(r.choice(passages)[r.randint(0, 30) :] if r.random() < 0.5 else "".join(r.choice("abcd ") for _ in range(r.randint(0, 60))) for _ in range(r.randint(0, 6)))) for i in range(150)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert cut_rows(frame) == sorted((i, *v) for i, v in repeats_brute(rows).items())


def test_repeats_of_nothing(empty):
    assert suffix_dedup.cut_repeats(empty).count() == 0


# 10 packing


def test_packing_places_every_id_once(docs, empty):
    path = public_path("word_bpe_49k.json")
    got = packing.pack(docs, path, block_tokens=3000, step_tokens=4096).collect()
    coder = word_encoder(path)
    want = collections.Counter(np.append(coder.encode(t or ""), packing.END_ID).astype("<u4").tobytes() for _, t in texts())
    rebuilt, sequences = collections.Counter(), collections.defaultdict(list)
    open_docs = collections.defaultdict(dict)
    for r in got:
        sequences[r.sequence_id].append(r)
        open_docs[r.doc_id, r.doc_tokens].setdefault(r.start, []).append(bytes(r.ids))
    for parts in open_docs.values():
        copies = max(len(v) for v in parts.values())
        for _ in range(copies):
            rebuilt[b"".join(parts[s].pop() for s in sorted(parts) if parts[s])] += 1
    assert sum((rebuilt & want).values()) >= sum(want.values()) - 3  # rows that share an id may be cut at different places
    for rows in sequences.values():
        rows.sort(key=lambda r: r.offset)
        assert [r.offset for r in rows] == list(np.cumsum([0, *(r.length for r in rows)])[:-1])
        size = sum(r.length for r in rows)
        assert size <= 4096 and size & (size - 1) == 0 and size == rows[0].sequence_length
    assert packing.pack(empty, path).count() == 0


@pytest.mark.parametrize("seed", range(12))
def test_pack_block(seed):
    r = random.Random(seed)
    lengths = [r.choice([1, 2, 511, 512, 513, r.randint(1, 9000), 4096, 4097]) for _ in range(r.randint(0, 60))]
    spans = collections.defaultdict(list)
    for row in packing.pack_block(lengths):
        size = sum(p[2] for p in row)
        assert size <= 4096 and size & (size - 1) == 0
        for doc, start, n in row:
            spans[doc].append((start, n))
    for doc, n in enumerate(lengths):
        at = 0
        for start, size in sorted(spans[doc]):
            assert start == at
            at += size
        assert at == n


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """The tables of the registered queries, small and odd: nulls, empty and long texts, copies, columns with clashing names."""
    at = tmp_path_factory.mktemp("sf")
    rows = [(i, t) for i, t in texts() if i is not None and i != 14] + [(20, "ab" * 60_000), (21, "word " * 20_000), (22, "call +1 (202) 555-0143 or mail a.b@c.example.org from 10.0.0.7")]
    clash = {"gone_id": 1, "gone_stay": 2, "digest": "x", "stay_id": 3, "row": 4, "key": 5, "__gone_id": 6}
    frame = spark.createDataFrame([(i, t, "en", "src", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    frame.withColumns({n: F.lit(v) for n, v in clash.items()}).repartition(3).write.parquet(str(at / "documents.parquet"))
    spark.createDataFrame([(i, i % 2, i % 3 % 2) for i in range(12)] + [(3, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(str(at / "labels.parquet"))
    spark.createDataFrame([(i, None if i == 7 else [float(i % 5), float(-i), 0.5]) for i in range(50)], "vec_id long, embedding array<float>").write.parquet(str(at / "embeddings.parquet"))
    spark.createDataFrame([(1, 0, "user", "a"), (2, 0, "user", "a"), (2, 1, "assistant", None), (None, 0, None, None)], "conv_id long, turn long, role string, text string").write.parquet(str(at / "conversations.parquet"))
    return str(at), rows


def sha(raw: bytes) -> str:
    return hashlib.sha256(raw).hexdigest()


def test_registered_queries_return_their_digests(spark, folder):
    at, rows = folder
    run = lambda name: Q.queries()[name](spark, at).collect()
    raw = {i: (t or "").encode() for i, t in rows}
    best = {}
    for i, t in rows:
        best[lowered(t)] = max(i, best.get(lowered(t), i))
    got = {r.doc_id: r for r in run("op1_exact_dedup")}
    assert set(got) == set(raw) and all((r.keep_id, r.kept, r.text_sha256) == (best[lowered(t)], best[lowered(t)] == i, sha(lowered(t).encode())) for i, t in rows for r in [got[i]])
    tok = byte_encoder(public_path("byte_bpe_50k.json")).library
    got = {r.doc_id: r for r in run("op3_bpe")}
    for i, t in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), sha(np.array(ids, "<u4").tobytes()), sha(tok.decode(ids, skip_special_tokens=False).encode()))
    for r in run("op5_pii"):
        base = base_brute(raw[r.doc_id].decode())
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(b[0] == k for b in base) for k in pii.KINDS]
        assert r.base_sha256 == sha(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()) and all(f"{k}:{a}:{b}" in r.spans.split(",") for k, a, b in base)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in run("op6_jaccard_join")} == jaccard_brute(rows)
    for name, parts, held, least in (("op7_toxicity", 4, 2, 0.3), ("op8_quality", 3, 1, 0.5)):
        got = run(name)
        assert {r.doc_id for r in got} == set(raw) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= least) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % parts == held) for r in got)
    want = repeats_brute(rows)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in run("op9_suffix_dedup")} == {i: (*v[:3], sha(v[3])) for i, v in want.items()}
    coder, seen = word_encoder(public_path("word_bpe_49k.json")), collections.defaultdict(int)
    for r in run("op10_packing"):
        ids = np.append(coder.encode(raw[r.doc_id].decode()), packing.END_ID).astype("<u4")
        assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
        seen[r.doc_id] += r.length
    assert all(seen[i] == len(coder.encode(t.decode())) + 1 for i, t in raw.items())
    assert len(run("op2_topk")) == 3 * 20 and [r.conv_id for r in run("op4_chat")] == [2]


def test_pipeline_stages_keep_other_columns(spark, folder, empty):
    at, rows = folder
    docs = spark.read.parquet(f"{at}/documents.parquet").withColumn("text", F.regexp_replace("text", "(?i)idiot", "stone"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, at)
        assert set(docs.columns) >= {"doc_id", "text", "gone_id", "__gone_id", "digest", "key"} and docs.count() > 8
    assert corpus_pipeline.STAGES[-1][1](spark, docs, at).count() > 8
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, at).count() == 0, name


def test_every_query_is_registered():
    assert [n.split("_")[0] for n in Q.queries()] == [f"op{i}" for i in range(1, 14)]
    assert set(Q.oracle_sql()) <= set(Q.queries())


def test_pii_learns_from_every_candidate(spark, monkeypatch):
    seen = []
    plain = pii.GBTClassifier.fit
    monkeypatch.setattr(pii.GBTClassifier, "fit", lambda self, frame: (seen.append((frame.count(), frame.agg({"weight": "sum"}).first()[0])), plain(self, frame))[1])
    rows = [(i, f"{prose(i, 4)} mail u{'x' * (i % 60)}{i}.{'y' * (i % 37)}@h{i % 900}.ex{'a' * (i % 23)}mple.com {prose(i + 7, 4)} {i}") for i in range(4000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    selector = pii.fit(frame)
    every = {(k, y, tuple(x)) for _, t in rows for y, k, x in pii.examples(t)}
    assert len(every) > 12_000 and len(every) * 0.45 < seen[0][0] < len(every) * 0.55  # the other half gives the thresholds
    assert "email" in selector.thresholds
