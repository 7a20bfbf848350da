"""Alignment, manifest and SentencePiece operators against brute force, with nulls, empty and long texts, ties and repeats."""

import bisect
import collections
import functools
import hashlib
import itertools
import random
import zlib

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from agroloom.llm import alignment, merkle, pieces
from agroloom.llm import queries as Q
from agroloom.llm.tokenization import PieceEncoder, public_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, pairs string, leaf string, ids long"
BYTES, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"


def rows():
    r = random.Random(3)
    prose = lambda n: " ".join("".join(r.choice("abcdeghilmnorstuéß") for _ in range(r.randint(1, 9))) for _ in range(n))
    texts = [None, "", " ", "  two  spaces ", "a\n b\n\nc\t", "Σίσυφος 中文字 🙂 é ﬁ", "▁marker", "x <|endoftext|> <s> </s> <0x41>", "naïve space　wide", "\x00\x01", prose(40), prose(3000), "y" * 5000, "ab" * 3000 + " end"]
    out = [(i, t, "en" if i % 3 else None, f"s{i % 2}" if i % 5 else None, len(t) if t else None, "p", "l", 7) for i, t in enumerate(texts)]
    out += [(100 + i, prose(3) + "\n" * (i % 2), "de", "hot", 5, "p", "l", 7) for i in range(60)]
    return [*out, out[10], out[10], (None, "no id\n", "en", "hot", 3, "p", "l", 7), (None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@functools.cache
def library():
    one = Tokenizer.from_file(public_path(BYTES))
    one.encode_special_tokens = True
    return one, sentencepiece.SentencePieceProcessor(model_file=public_path(PIECES))


# 13 SentencePiece


def test_pieces_are_those_of_the_library(docs, empty):
    _, two = library()
    path = public_path(PIECES)
    got = pieces.decode(pieces.encode(docs, path), path).collect()
    want = collections.Counter((i, tuple(two.encode(t or "")), two.decode(two.encode(t or ""))) for i, t, *_ in rows())
    assert collections.Counter((r.doc_id, tuple(r.ids), r.decoded) for r in got) == want
    assert pieces.decode(pieces.encode(empty, path), path).count() == 0


def test_a_full_table_starts_anew():
    _, two = library()
    small = PieceEncoder(public_path(PIECES), most=20)
    for _, text, *_ in rows():
        assert small.encode([text or ""])[0].tolist() == two.encode(text or "")
        assert len(small.table) <= max(20, len(set(small.chunks(text or ""))) + 1)


def test_pieces_of_random_texts():
    r = random.Random(5)
    _, two = library()
    coder = PieceEncoder(public_path(PIECES))
    for _ in range(400):
        text = "".join(r.choice("ab  ▁\n.é中́🙂<0x>1") for _ in range(r.randint(0, 30)))
        assert coder.encode([text])[0].tolist() == two.encode(text), text


def test_any_ids_decode_as_in_the_library():
    r = random.Random(6)
    _, two = library()
    coder = PieceEncoder(public_path(PIECES))
    special = [*range(40), two.piece_to_id("▁"), two.piece_to_id("▁a"), 230, 231, 245]
    many = [[r.choice(special) if r.random() < 0.5 else r.randrange(32000) for _ in range(r.randint(0, 8))] for _ in range(2000)]
    assert coder.decode(many) == [two.decode(ids) for ids in many]


def test_op13_digests(spark, docs, monkeypatch):
    _, two = library()
    monkeypatch.setattr(Q, "documents", lambda *_: docs)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = collections.Counter((i, len(two.encode(t or "")), sha(",".join(map(str, two.encode(t or "")))), sha(two.decode(two.encode(t or "")))) for i, t, *_ in rows())
    assert collections.Counter(map(tuple, Q.op13_sentencepiece(spark, "").collect())) == want


# 12 alignment


def tokens_of(text):
    """(A ids, A bytes, B ids, B bytes) by the libraries alone; empty where the bytes don't come back."""
    one, two = library()
    symbols = {s: b for b, s in alignment.byte_encoder(public_path(BYTES)).symbols.items()}
    if not text:
        return [], [], [], []
    a, b = one.encode(" " + text, add_special_tokens=False).ids, two.encode(text)
    raw_a = [bytes(symbols[c] for c in one.id_to_token(i)) for i in a]
    raw_b = [bytes([int(two.id_to_piece(i)[3:-1], 16)]) if two.is_byte(i) else two.id_to_piece(i).replace("▁", " ").encode() for i in b]
    whole = (" " + text).encode()
    return (a, raw_a, b, raw_b) if b"".join(raw_a) == whole == b"".join(raw_b) else ([], [], [], [])


def ranges(raw):
    ends = np.cumsum([len(x) for x in raw]).tolist()
    return list(zip([0, *ends][: len(ends)], ends, strict=True))


@functools.cache
def aligned_by_hand():
    out, count = [], collections.Counter()
    for i, text, *_ in rows():
        a, raw_a, b, raw_b = tokens_of(text)
        ra, rb = ranges(raw_a), ranges(raw_b)
        linked = [(a[x], b[y]) for x, (s, e) in enumerate(ra) for y, (u, v) in enumerate(rb) if s < v and u < e] if len(ra) * len(rb) < 20_000 else None
        if linked is None:  # two pointers for the long ones
            linked, y = [], 0
            for x, (s, e) in enumerate(ra):
                while rb[y][1] <= s:
                    y += 1
                k = y
                while k < len(rb) and rb[k][0] < e:
                    linked.append((a[x], b[k]))
                    k += 1
        both = sorted({e for _, e in ra} & {e for _, e in rb})
        of = lambda spans, ids: [",".join(str(t) for _, t in g) for _, g in itertools.groupby(((bisect.bisect_left(both, e), t) for t, (_, e) in zip(ids, spans, strict=True)), lambda x: x[0])]  # noqa: B023, E731
        groups = [f"{x}|{y}" for x, y in zip(of(ra, a), of(rb, b), strict=True)]
        count.update(linked)
        out.append((i, len(a), len(b), linked, groups))
    best = collections.defaultdict(int)
    for (_, y), n in count.items():
        best[y] = max(best[y], n)
    return [(i, n, m, len(g), len(ls), sum(count[p] == best[p[1]] for p in ls), sum(count[p] for p in ls), ";".join(g)) for i, n, m, ls, g in out]


@pytest.mark.parametrize("heavy", [0, 5, 1 << 18])
def test_alignment(docs, heavy):
    rows = alignment.align(docs, public_path(BYTES), public_path(PIECES))
    got = alignment.scored(rows, heavy).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups").collect()
    assert collections.Counter(map(tuple, got)) == collections.Counter(aligned_by_hand())


def test_op12_and_empty_table(spark, docs, empty, monkeypatch):
    monkeypatch.setattr(Q, "documents", lambda *_: docs)
    digest = lambda g: hashlib.sha256(g.encode()).hexdigest() if g else ""
    want = collections.Counter((*row[:-1], digest(row[-1])) for row in aligned_by_hand())
    assert collections.Counter(map(tuple, Q.op12_alignment(spark, "").collect())) == want
    monkeypatch.setattr(Q, "documents", lambda *_: empty)
    assert Q.op12_alignment(spark, "").count() == 0


def test_union_find_on_random_graphs():
    r = random.Random(1)
    for _ in range(50):
        n = r.randint(1, 40)
        edges = [(r.randrange(n), r.randrange(n)) for _ in range(r.randint(0, 50))]
        near = {i: i for i in range(n)}
        for _ in range(n):
            for a, b in edges:
                near[a] = near[b] = min(near[a], near[b])
        got = alignment.union_find(n, *(np.array([e[k] for e in edges], int) for k in (0, 1)))
        assert got.tolist() == [near[i] for i in range(n)]


# 11 manifest


def H(*parts):  # noqa: N802
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(i, text, lang, source, n):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, source, lang, n, text)))


def manifest_by_hand(given):
    by = collections.defaultdict(list)
    for i, text, lang, source, n, *_ in given:
        whole, cut = leaf(i, text, lang, source, n), i is not None and zlib.crc32(str(i).encode()) % 2 == 0
        other = leaf(i, text and text.replace("\n", ""), lang, source, n) if cut else whole
        by[source].append((i is not None, i or 0, whole, other, i))
    out = []

    def tree(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            m = levels[-1]
            levels.append([H(*m[k : k + 3]) for k in range(0, len(m), 3)])
        return levels

    def way(levels, at):
        steps = []
        for m in levels[:-1]:
            run = m[at // 3 * 3 : at // 3 * 3 + 3]
            steps.append((run[: at % 3], run[at % 3 + 1 :]))
            at //= 3
        return steps

    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x[2] for x in sorted(by[s], key=lambda x: x[:3])]) for s in order}
    top = tree([trees[s][-1][0] for s in order])
    for k, s in enumerate(order):
        for at, (_, _, whole, other, i) in enumerate(sorted(by[s], key=lambda x: x[:3])):
            steps = way(trees[s], at) + way(top, k)
            node = other
            for left, right in steps:
                node = H(*left, node, *right)
            root = top[-1][0]
            out.append((i, whole, trees[s][-1][0], root, H(*(x for a, b in steps for x in (*a, *b))), node, node == root))
    return collections.Counter(out)


def proved(docs, levels):
    out = merkle.manifest(docs, merkle.without_lines(docs), levels).select("doc_id", "leaf", "subroot", "root", F.sha2("proof", 256), "folded_root", "verified")
    return collections.Counter(map(tuple, out.collect()))


@pytest.mark.parametrize("levels", [1, 2])
def test_manifest(docs, levels):
    got = proved(docs, levels)
    assert got == manifest_by_hand(rows())
    assert {r[-1] for r in got} == {True, False}


@pytest.mark.parametrize("n", [1, 3, 9, 28])
def test_manifest_of_one_source(spark, n):
    given = [(i, f"t{i}\n", "en", "one", 3, "p", "l", 7) for i in range(n)]
    assert proved(spark.createDataFrame(given, SCHEMA), 2) == manifest_by_hand(given)


def test_op11_and_empty_table(spark, docs, empty, monkeypatch):
    monkeypatch.setattr(Q, "documents", lambda *_: docs)
    assert collections.Counter(map(tuple, Q.op11_merkle(spark, "").collect())) == manifest_by_hand(rows())
    monkeypatch.setattr(Q, "documents", lambda *_: empty)
    assert Q.op11_merkle(spark, "").count() == 0


def test_unaltered_rows_verify(docs):
    assert merkle.manifest(docs).filter(~F.col("verified")).count() == 0
