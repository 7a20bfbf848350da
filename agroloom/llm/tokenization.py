"""Exact, fast encoders for the two public vocabularies: the same ids as the ``tokenizers`` library gives.

``ByteEncoder`` and ``WordEncoder`` read the library's own JSON files. Ordinary text goes through a byte-pair
coder over the same merges; whatever that route can't be proven to treat alike (special-token strings, unusual
white space, contractions, letters outside Latin-1) goes through the library itself.
"""

from __future__ import annotations

import array
import functools
import itertools
import json
import re

import numpy as np
import sentencepiece
import tiktoken
from tokenizers import Tokenizer


def byte_of_symbol() -> dict[str, int]:
    """The byte that each printable symbol of a byte-level vocabulary stands for."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


#: Fixed value: the pattern by which the byte-level pre-tokenizer splits a text.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class ByteEncoder:
    """Byte-level pairs: ``encode`` (text to uint32 ids) and ``decode``."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        symbols = byte_of_symbol()
        ranks = {bytes(symbols[c] for c in token): i for token, i in spec["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.coder = tiktoken.Encoding("bytes", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=self.special)
        self.ranks = ranks
        #: By code point (a byte): its symbol.
        self.symbols = {b: s for s, b in symbols.items()}
        self.library = Tokenizer.from_file(path)
        self.table = [b""] * (max([*ranks.values(), *self.special.values()]) + 1)
        for raw, i in ranks.items():
            self.table[i] = raw
        for text, i in self.special.items():
            self.table[i] = text.encode()

    def encode(self, text: str) -> np.ndarray:
        if any(s in text for s in self.special):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4")
        return np.asarray(self.coder.encode_to_numpy(text, disallowed_special=()), dtype="<u4")

    @functools.cached_property
    def ordinary(self) -> tiktoken.Encoding:
        return tiktoken.Encoding("ordinary", pat_str=SPLIT, mergeable_ranks=self.ranks, special_tokens={})

    def plain(self, text: str) -> np.ndarray:
        """Ids of a text in which strings of special tokens are ordinary text."""
        return np.asarray(self.ordinary.encode_to_numpy(text, disallowed_special=()), dtype="<u4")

    def pieces(self, text: str) -> list[tuple[int, int]]:
        """Bounds of the pieces into which the library's pre-tokenizer splits a text without special tokens."""
        return [span for _, span in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def bytes_of(self, ids) -> bytes:
        table = self.table
        return b"".join([table[i] for i in ids])

    def decode(self, ids) -> str:
        return self.bytes_of(ids).decode("utf-8", "replace")


WHITE, LETTER, DIGIT, OTHER, ODD = range(5)


def latin_classes() -> np.ndarray:
    """Class of each Latin-1 character under the word pattern; ODD: leave the text to the library."""
    kinds = np.full(256, OTHER, np.uint8)
    for c in range(256):
        s = chr(c)
        if s.isalpha():
            kinds[c] = LETTER
        elif s.isnumeric():
            kinds[c] = DIGIT
    kinds[[9, 10, 11, 12, 13, 32, 0xA0]] = WHITE
    kinds[[*range(0, 9), *range(14, 32), *range(0x7F, 0xA0)]] = ODD
    return kinds


class WordEncoder:
    """Pairs with word ends over lower-cased words: ``encode`` gives uint32 ids."""

    MARK = "E"  # lower-cased text holds no capital

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        end, symbols = spec["model"]["end_of_word_suffix"], byte_of_symbol()
        ranks = {}
        for token, i in spec["model"]["vocab"].items():
            stem = token.removesuffix(end) if token != end else token
            if all(c in symbols for c in stem):
                raw = bytes(symbols[c] for c in stem)
                if self.MARK.encode() not in raw or len(raw) == 1 and stem == token:
                    ranks[raw + (self.MARK.encode() if stem != token else b"")] = i
        self.coder = tiktoken.Encoding("words", pat_str=r"[^E]+E", mergeable_ranks=ranks, special_tokens={})
        self.library = Tokenizer.from_file(path)
        self.kinds = latin_classes()
        self.lower = bytes(ord(chr(c).lower()) if len(chr(c).lower()) == 1 and ord(chr(c).lower()) < 256 else c for c in range(256))
        self.odd = bytes(np.flatnonzero(self.kinds == ODD).astype(np.uint8))
        self.contraction = re.compile(rb"'[stmrvldSTMRVLD]")

    def encode(self, text: str) -> np.ndarray:
        try:
            raw = text.encode("latin-1")
        except UnicodeEncodeError:
            return self.whole(text)
        if b"<|" in raw or self.contraction.search(raw) or len(raw.translate(None, self.odd)) < len(raw):
            return self.whole(text)
        if not raw:
            return np.zeros(0, "<u4")
        kinds = self.kinds[np.frombuffer(raw, np.uint8)]
        keep = kinds != WHITE
        last = keep & (kinds == DIGIT)
        last[:-1] |= keep[:-1] & (kinds[1:] != kinds[:-1])
        last[-1] |= keep[-1]
        to = np.cumsum(keep + last.view(np.uint8), dtype=np.int64)
        if not to[-1]:
            return np.zeros(0, "<u4")
        marked = np.full(to[-1], ord(self.MARK), np.uint8)
        marked[(to - last - 1)[keep]] = np.frombuffer(raw.translate(self.lower), np.uint8)[keep]
        return np.asarray(self.coder.encode_to_numpy(marked.tobytes().decode("latin-1"), disallowed_special=()), dtype="<u4")

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4")


class PieceEncoder:
    """SentencePiece ids by a table of distinct chunks; for models whose pieces don't cross white-space markers.

    A normalised text starts with a marker. It is cut before every marker that follows another character, so a chunk is
    one marked word (with further markers in front where white space repeats). No piece of the vocabulary holds a marker
    after another character, hence no merge crosses a cut, and the ids of a text are those of its chunks in order. The
    library segments each distinct chunk once while the table holds it (at most ``most`` chunks, and ``most_chars``
    characters, after which it starts anew).
    """

    MARK = "\u2581"

    def __init__(self, path: str, most: int = 300_000, most_chars: int = 16_000_000):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        crossing = [p for p in self.pieces if self.MARK in p.lstrip(self.MARK)]
        if crossing or self.model.normalize("a  b ") != f"{self.MARK}a{self.MARK}{self.MARK}b{self.MARK}":
            raise ValueError("chunks need pieces that don't cross markers, a marker in front of a text, and white space kept")
        #: A chunk of one marker is white space at the end of a text; alone, the library would see an empty text.
        self.lone = {self.MARK: array.array("I", [self.model.piece_to_id(self.MARK)]).tobytes()}
        self.most, self.most_chars = most, most_chars
        self.table = dict(self.lone)
        self.chars = 0
        self.cut = re.compile(f"{self.MARK}+[^{self.MARK}]*")

    def chunks(self, text: str) -> list[str]:
        return self.cut.findall(self.MARK + text.replace(" ", self.MARK)) if text else []

    def add(self, chunks: list[str]) -> None:
        """Segments the chunks that the table lacks."""
        new = list(set(chunks).difference(self.table))
        if len(new) + len(self.table) > self.most or self.chars > self.most_chars:
            self.table = dict(self.lone)
            self.chars, new = 0, list(set(chunks).difference(self.table))
        # the library puts the first marker in front itself
        ids = self.model.encode([c[1:] for c in new], num_threads=1) if new else []
        self.table.update(zip(new, [array.array("I", x).tobytes() for x in ids], strict=True))
        self.chars += sum(map(len, new))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text. The distinct chunks of all of them go to the library in one call."""
        cut = [self.chunks(t) for t in texts]
        self.add(list(itertools.chain.from_iterable(cut)))
        return [np.frombuffer(b"".join(map(self.table.__getitem__, chunks)), "<u4") for chunks in cut]

    def decode(self, many: list[list[int]]) -> list[str]:
        """Text of each row of ids. Where a row starts with a marker and its pieces are whole characters, that is their
        bytes without the first marker; the library decodes all others."""
        out, odd = [], []
        for ids in many:
            raw = b"".join(map(self.raw.__getitem__, ids))
            try:
                plain = bool(ids) and self.pieces[ids[0]][0] == self.MARK and self.silent.isdisjoint(ids)
                out.append(raw[1:].decode() if plain else None)
            except UnicodeDecodeError:
                out.append(None)
            if out[-1] is None:
                odd.append(ids)
        found = iter(self.model.decode(odd, num_threads=1) if odd else [])
        return [next(found) if text is None else text for text in out]

    @functools.cached_property
    def silent(self) -> frozenset[int]:
        """Ids that stand for no text of their own."""
        return frozenset(i for i in range(len(self.pieces)) if self.model.is_control(i) or self.model.is_unknown(i))

    @functools.cached_property
    def raw(self) -> list[bytes]:
        """Bytes of each id: its piece with markers as spaces, or the byte it stands for."""
        return [bytes([int(p[3:-1], 16)]) if self.model.is_byte(i) else p.replace(self.MARK, " ").encode() for i, p in enumerate(self.pieces)]


@functools.cache
def piece_encoder(path: str) -> PieceEncoder:
    return PieceEncoder(path)


@functools.cache
def byte_encoder(path: str) -> ByteEncoder:
    """One encoder a process and file."""
    return ByteEncoder(path)


@functools.cache
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def public_path(name: str) -> str:
    """Where a public vocabulary file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)
