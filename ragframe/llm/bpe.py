"""BPE encoding by dynamic programming over prefixes, and decoding.

For every prefix of a word exactly one token can be the last one of its encoding: a vocabulary token that is a suffix of
the prefix, such that the last token of the rest and this token stay two tokens when they meet. An automaton over the
vocabulary gives all tokens that are suffixes of a prefix, the longest first; a pair test, remembered per pair,
decides; back-pointers from the end give the ids.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from array import array
from collections import deque

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from ragframe.llm.common import with_text_column

# The pattern that cuts text before merging, and its white space.
WHITE = "\\t-\\r\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
WORDS = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{WHITE}\p{{L}}\p{{N}}]+")
GAPS = regex.compile(f"[{WHITE}]+")
WORD_END = "</w>"

# White space to str.split() only.
SEPARATORS = re.compile("[\x1c-\x1f]")

# Entries that the memories of pieces and pairs hold; longer pieces are worked out each time.
PIECES, PAIRS, PIECE_CHARS = 300_000, 400_000, 80

NEVER = 1 << 60


def byte_letters() -> dict[str, int]:
    """Letter of a byte-level vocabulary -> byte: printable Latin-1 stands for itself, the rest follows from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Suffixes:
    """Automaton over sequences of symbols: after each symbol, all entries that end here, the longest first."""

    def __init__(self):
        self.goto: list[dict[int, int]] = [{}]
        self.fail = [0]
        self.found: list[tuple[tuple[int, int], ...]] = [()]

    def add(self, symbols: list[int], entry: int) -> None:
        state = 0
        for symbol in symbols:
            following = self.goto[state].setdefault(symbol, len(self.goto))
            if following == len(self.goto):
                self.goto.append({})
                self.fail.append(0)
                self.found.append(())
            state = following
        self.found[state] = ((entry, len(symbols)),)

    def link(self) -> None:
        """Point each state at its longest proper suffix; states come in order of length."""
        queue = deque(self.goto[0].values())
        while queue:
            state = queue.popleft()
            for symbol, following in self.goto[state].items():
                self.fail[following] = self.step(self.fail[state], symbol)
                self.found[following] += self.found[self.fail[following]]
                queue.append(following)

    def step(self, state: int, symbol: int) -> int:
        while symbol not in self.goto[state]:
            if not state:
                return 0
            state = self.fail[state]
        return self.goto[state][symbol]


class Vocabulary:
    """Tokens of a word-end BPE vocabulary as strings of symbols: a byte, or 256 + a byte at a word's end."""

    def __init__(self, spec: str):
        spec = json.loads(spec)
        letters, ids = byte_letters(), spec["model"]["vocab"]
        self.names = {i: name for name, i in ids.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names |= {i: name for name, i in self.special.items()}
        marks = "|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))
        self.marks = re.compile(f"({marks})") if marks else None
        self.matches = Suffixes()
        for name, i in ids.items():
            symbols = [letters[c] for c in name.removesuffix(WORD_END)]
            if name.endswith(WORD_END):
                symbols[-1] += 256
            self.matches.add(symbols, i)
        self.matches.link()
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            pair = (ids[left], ids[right])
            self.rank[pair] = rank
            self.parts.setdefault(ids[left + right], (*pair, rank))
        self.stays: dict[int, bool] = {}
        self.pairs: dict[int, bool] = {}
        self.edges: tuple[dict, dict] = ({}, {})

    def edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """What stands at a token's left (0) or right (1) edge while it is built: (piece, rank that ends it)."""
        found = self.edges[side].get(token)
        if found is None:
            if token in self.parts:
                *halves, rank = self.parts[token]
                inner = self.edge(halves[side], side)
                found = [*inner[:-1], (halves[side], rank), (token, NEVER)]
            else:
                found = [(token, NEVER)]
            self.edges[side][token] = found
        return found

    def meets(self, left: int, right: int, until: int = NEVER) -> bool:
        """Whether no merge before ``until`` joins the end of one token with the start of the other."""
        ends, starts = self.edge(left, 1), self.edge(right, 0)
        i = j = 0
        while True:
            (a, a_ends), (b, b_ends) = ends[i], starts[j]
            rank = self.rank.get((a, b), NEVER)
            # of equal merges that overlap the leftmost is made first
            if rank < until and rank < a_ends and rank <= b_ends:
                return False
            if a_ends == b_ends == NEVER:
                return True
            if a_ends <= b_ends:
                i += 1
            else:
                j += 1

    def whole(self, token: int) -> bool:
        """Whether the token's own string is encoded as this one token."""
        if token not in self.stays:
            parts = self.parts.get(token)
            self.stays[token] = parts is None or (
                self.whole(parts[0]) and self.whole(parts[1]) and self.meets(*parts)
            )
        return self.stays[token]

    def fits(self, left: int, right: int) -> bool:
        """:meth:`meets`, remembered."""
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        found = self.pairs[left << 20 | right] = self.meets(left, right)
        return found

    def encode_word(self, word: str) -> list[int]:
        """The ids of one piece of text between cuts."""
        symbols = list(word.encode())
        symbols[-1] += 256
        matches, found, pairs, state = self.matches, self.matches.found, self.pairs, 0
        # of each prefix, the last token and where it starts; the empty prefix first
        last, starts = [-1], [0]
        for end, symbol in enumerate(symbols, 1):
            following = matches.goto[state].get(symbol)
            state = matches.step(state, symbol) if following is None else following
            for token, size in found[state]:
                start = end - size
                if not start:
                    fits = self.whole(token)
                else:
                    fits = pairs.get(last[start] << 20 | token)
                    if fits is None:
                        fits = self.fits(last[start], token)
                if fits:
                    break
            last.append(token)
            starts.append(start)
        out = []
        while end:
            out.append(last[end])
            end = starts[end]
        return out[::-1]


class Coder(dict):
    """Text <-> ids. As a dict: a piece of text without white space -> its ids as little-endian 32-bit numbers.

    Words within a piece are remembered as pieces of their own: what the pattern matches, it matches whole.
    """

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, piece: str) -> bytes:
        words = WORDS.findall(piece)
        if words == [piece]:
            packed = array("I", self.vocabulary.encode_word(piece)).tobytes()
        else:
            packed = b"".join(map(self.__getitem__, words))
        if len(piece) <= PIECE_CHARS:
            if len(self) >= PIECES:
                self.clear()
            self[piece] = packed
        return packed

    def encode(self, text: str) -> bytes:
        marks = self.vocabulary.marks
        if marks is None or not marks.search(text):
            return self._plain(text)
        special = self.vocabulary.special
        parts = enumerate(marks.split(text))
        return b"".join(special[p].to_bytes(4, "little") if i % 2 else self._plain(p) for i, p in parts)

    def _plain(self, text: str) -> bytes:
        # lower case letter by letter, without the rule for a final sigma
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        pieces = GAPS.split(text) if SEPARATORS.search(text) else text.split()
        return b"".join(map(self.__getitem__, pieces))

    def decode(self, ids: np.ndarray) -> str:
        """Tokens by their names, one space between them; special ones as well."""
        return " ".join(map(self.vocabulary.names.__getitem__, ids.tolist()))


def encode_documents(docs: DataFrame, vocabulary: str) -> DataFrame:
    """``docs`` with a struct column ``bpe``: n_tokens, token_ids, ids_sha256, decoded.

    ``vocabulary`` is the path of a tokenizers file that the driver reads; its size does not depend on the input. Null
    texts count as empty and have no tokens. All other columns stay; one called ``bpe`` is replaced.
    """
    with open(vocabulary, encoding="utf-8") as file:
        spec = docs.sparkSession.sparkContext.broadcast(file.read())

    def start():
        coder = Coder(Vocabulary(spec.value))

        def coded(texts: pa.Array) -> pa.Array:
            packed = [coder.encode(text or "") for text in texts.to_pylist()]
            rows = [np.frombuffer(p, "<u4") for p in packed]
            sizes = np.array([r.size for r in rows], np.int64)
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            flat = np.frombuffer(b"".join(packed), "<i4")
            columns = [
                pa.array(sizes),
                pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32())),
                pa.array([hashlib.sha256(p).hexdigest() for p in packed], pa.string()),
                pa.array([coder.decode(r) for r in rows], pa.string()),
            ]
            return pa.StructArray.from_arrays(columns, ["n_tokens", "token_ids", "ids_sha256", "decoded"])

        return coded

    kind = "struct<n_tokens:bigint,token_ids:array<int>,ids_sha256:string,decoded:string>"
    return with_text_column(docs, "bpe", kind, start)
