"""BPE encoding and decoding with a backtracking encoder.

A vocabulary is read from a tokenizers file (BPE with a word-end mark). One walk of an Aho-Corasick
automaton over the reversed pre-token, along its failure links, gives the longest token that starts
at each place (tokens are stored reversed, so it ends there). The encoder goes left to right,
takes the longest token whose pair with the token before it is compatible, goes on to shorter ones,
and steps back over a place that has no continuation; such a place is marked and never entered again,
so the work is linear in the pre-token. Compatible are two tokens if no merge across their border comes
before the merges that build them; that is read off a table of splits (which two parts a token is merged
from, and when) by undoing the later merge of the two, step by step. A sequence in which all neighbours
are compatible is the one that the merge
rules give. Decoding gathers bytes from one blob by an offset table, for all ids of a batch at once.

Null text is empty: no ids, empty decoded text. Texts of any length are encoded whole. Repeated rows
and null ids give one output row each; extra columns are dropped at the start; an empty table gives
an empty result.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from datelode.llm.common import doc_bytes, slices

#: Memory bounds of a worker's memo tables, in entries.
WORDS = 250_000
PAIRS = 200_000
_END = ""  # stands for the word-end mark, so that each unit is one character
#: Up to this character, letters and numbers are the same in every version of Unicode.
STABLE = "\u017f"
_SPACE = r"\t\n\x0b\x0c\r \x85\xa0"


@cache
def pretoken_pattern() -> re.Pattern:
    """The pre-token pattern for chunks of characters up to STABLE."""
    of = lambda kind: "".join(re.escape(chr(c)) for c in range(ord(STABLE) + 1) if unicodedata.category(chr(c))[0] == kind)
    letter, number = of("L"), of("N")
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letter}]+|[{number}]|[^{_SPACE}{letter}{number}]+")


@cache
def _byte_letters() -> list[str]:
    """The printable letter for each byte: printable bytes stand for themselves, the rest follow from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class _Memo(dict):
    """Remembers what make returns, for keys that keep says yes to."""

    def __init__(self, make, keep=lambda _: True) -> None:
        super().__init__()
        self.make, self.keep = make, keep

    def __missing__(self, key):
        got = self.make(key)
        if self.keep(key):
            self[key] = got
        return got


class BacktrackingBpe:
    """Encoder and decoder for one vocabulary file; lives in a Python worker."""

    def __init__(self, path: str) -> None:
        import ahocorasick
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        library = Tokenizer.from_file(path)
        self._rare = lambda text: [x for x, _ in library.pre_tokenizer.pre_tokenize_str(library.normalizer.normalize_str(text))]
        self.suffix = model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        self._split = pretoken_pattern()
        self._letters = {b: c for b, c in enumerate(_byte_letters())}
        unit = lambda s: s.removesuffix(self.suffix) + _END if s.endswith(self.suffix) else s
        self.vocab = {unit(s): i for s, i in model["vocab"].items()}
        self.text = {i: s for s, i in self.vocab.items()}
        self.merges = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[unit(a), unit(b)] = rank
        made: dict[str, list] = {}
        for (x, y), rank in self.merges.items():
            made.setdefault(x + y, []).append((rank, x, y))
        self.usable = {s for s in self.vocab if len(s.removesuffix(_END)) == 1 or s in made}  # what no merge builds can't come out
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY)
        n = max(self.vocab.values()) + 1
        self.width, self.shorter, self.rank, self.left, self.right = [0] * n, [-1] * n, [-1] * n, [-1] * n, [-1] * n
        self.merge_ids = {self.vocab[x] << 20 | self.vocab[y]: rank for (x, y), rank in self.merges.items() if x in self.vocab and y in self.vocab}
        for s in self.usable:
            i = self.vocab[s]
            self.automaton.add_word(s[::-1], i)
            self.width[i] = len(s)
            self.shorter[i] = next((self.vocab[s[:k]] for k in range(len(s) - 1, 0, -1) if s[:k] in self.usable), -1)
            ways = made.get(s, [])
            rank, x, y = ways[0] if len(ways) == 1 else self._merged(self._units(s))[1] if ways else (-1, "", "")
            if rank >= 0:
                self.rank[i], self.left[i], self.right[i] = rank, self.vocab[x], self.vocab[y]
        self.automaton.make_automaton()
        self.pairs = _Memo(self._check)
        self.words: dict[str, bytes] = {}
        self.chunks = _Memo(self._chunk, lambda c: len(c) < 200)
        n = max([*model["vocab"].values(), *self.special.values()]) + 1
        shown = [b""] * n
        for s, i in [*model["vocab"].items(), *self.special.items()]:
            shown[i] = s.encode()
        self.blob = np.frombuffer(b"".join(shown), dtype=np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum([len(s) for s in shown])])

    def _merged(self, units: list[str]) -> tuple[list[str], tuple[int, str, str]]:
        """What the merge rules make of a short sequence, and the last merge (rank, left, right)."""
        last = (-1, "", "")
        while len(units) > 1:
            rank, at = min((self.merges.get((a, b), 1 << 30), k) for k, (a, b) in enumerate(zip(units, units[1:], strict=False)))
            if rank == 1 << 30:
                break
            last = (rank, units[at], units[at + 1])
            units = [*units[:at], units[at] + units[at + 1], *units[at + 2 :]]
        return units, last

    @staticmethod
    def _units(s: str) -> list[str]:
        return [*s[:-2], s[-2:]] if s.endswith(_END) else list(s)

    def _check(self, key: int) -> bool:
        """Entry of the pair table: do the two tokens stay as they are, one behind the other? (First -1: a token alone.)"""
        if len(self.pairs) > PAIRS:
            self.pairs.clear()
        a, b = key >> 20, key & 0xFFFFF
        if a < 0:
            return self._merged(self._units(self.text[b]))[0] == [self.text[b]]
        return self.pairs[-1 << 20 | b] and self.compatible(a, b)

    def compatible(self, a: int, b: int) -> bool:
        """Walks back in time over the merges that build a and b; at each stop their neighbours at the border must not merge before the next of them does."""
        merges, rank, limit = self.merge_ids, self.rank, 1 << 30
        while merges.get(a << 20 | b, 1 << 30) >= limit:
            if rank[a] > rank[b]:
                limit, a = rank[a], self.right[a]
            elif rank[b] >= 0:
                limit, b = rank[b] + 1, self.left[b]  # of equal merges the left one, across the border, comes first
            else:
                return True
        return False

    def longest(self, letters: str) -> list[int]:
        """The longest token that starts at each place, -1 where none does."""
        n = len(letters)
        out, before = [-1] * n, -1
        for end, token in self.automaton.iter(letters[::-1]):  # the matches at a place come longest first
            if end != before:
                out[n - 1 - end] = token
                before = end
        return out

    def pretoken(self, letters: str) -> list[int]:
        """Ids of one pre-token, given as byte letters with the end mark."""
        fits, shorter, width, longest = self.pairs, self.shorter, self.width, self.longest(letters)
        n = len(letters)
        open_at = bytearray(b"\1") * (n + 1)
        ids: list[int] = []
        at, last = 0, -1
        token = longest[0]
        while True:
            while token >= 0:
                end = at + width[token]
                if open_at[end] and fits[last << 20 | token]:
                    break
                token = shorter[token]
            if token >= 0:
                ids.append(token)
                if end == n:
                    return ids
                at, last = end, token
                token = longest[at]
            else:  # no way on from here: give the token before up for a shorter one
                if not ids:
                    raise ValueError(f"no encoding of {letters!r}")
                open_at[at] = 0
                token = ids.pop()
                at -= width[token]
                token, last = shorter[token], ids[-1] if ids else -1

    def _plain(self, text: str) -> bytes:
        """Ids (little-endian uint32) of text without special strings.

        Characters beyond STABLE are composed, lowered and split by the library's own tables.
        """
        stable = text.isascii() or (text and max(text) <= STABLE)
        if stable:
            text = text.lower() if text.isascii() else "".join([c.lower() for c in text])
        out = []
        for word in self._split.findall(text) if stable else self._rare(text):
            got = self.words.get(word) if stable else None
            if got is None:
                if len(self.words) > WORDS:
                    self.words.clear()
                letters = word if not stable or word.isascii() and word.isprintable() else word.encode().decode("latin-1").translate(self._letters)
                got = array("I", self.pretoken(letters + _END)).tobytes()
                if stable and len(word) < 200:
                    self.words[word] = got
            out.append(got)
        return b"".join(out)

    def _chunk(self, chunk: str) -> bytes:
        if "<|" not in chunk:
            return self._plain(chunk)
        return b"".join(array("I", [self.special[s]]).tobytes() if s in self.special else self._plain(s) for s in self._special.split(chunk))

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian uint32; white space ends every pre-token, so chunks between blanks are memoised."""
        chunks = text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
        if len(self.chunks) > WORDS:
            self.chunks.clear()
        return b"".join(map(self.chunks.__getitem__, chunks))

    def decode(self, ids: np.ndarray) -> bytes:
        """Shown tokens joined by one blank, as UTF-8."""
        if not len(ids):
            return b""
        start, length = self.offsets[ids], self.offsets[ids + 1] - self.offsets[ids]
        to = np.concatenate([[0], np.cumsum(length + 1)])
        out = np.full(to[-1], 0x20, dtype=np.uint8)
        step = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
        out[np.repeat(to[:-1], length) + step] = self.blob[np.repeat(start, length) + step]
        return out[:-1].tobytes()


@cache
def _coder(path: str) -> BacktrackingBpe:
    """One a worker process, so that what it remembers serves all its tasks."""
    return BacktrackingBpe(path)


def encode_decode(docs: DataFrame, path: str, texts: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256; with texts=True also ids (array<int>) and decoded (string)."""
    rows = doc_bytes(docs)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _coder(path)
        for batch in batches:
            for piece in slices(batch, "body"):
                n, a, b, all_ids, shown = [], [], [], [], []
                for body in piece.column("body").to_pylist():
                    raw = bpe.encode(body.decode("utf-8", "replace"))
                    ids = np.frombuffer(raw, dtype="<u4").astype(np.int64)
                    text = bpe.decode(ids)
                    n.append(len(ids))
                    a.append(hashlib.sha256(raw).hexdigest())
                    b.append(hashlib.sha256(text).hexdigest())
                    if texts:
                        all_ids.append(ids.astype(np.int32))
                        shown.append(text.decode())
                out = [piece.column("doc_id"), pa.array(n, pa.int64()), pa.array(a), pa.array(b)]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if texts:
                    out += [pa.array(all_ids, pa.list_(pa.int32())), pa.array(shown, pa.string())]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(out, names=names)

    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * texts)
