"""Token counts of byte-level BPE at every prefix of a text, by dynamic programming.

For merges-based BPE, the encoding of a string ends in the one token that fits the encoding of what
stands before it: two neighbours fit when merging their joined bytes gives just these two again. So
count[i] = count[i - len(token)] + 1 for the token that ends at i and fits the last token at
i - len(token), and one pass over a piece gives the exact count of each of its prefixes. Pieces are
what the pre-tokenizer cuts; their arrays are joined by adding the tokens before them. Three places
are set right afterwards, where a text that ends there would be cut into other pieces: the end of a
run of white space, inside the contractions 're, 've and 'll, and inside a special token's string.

With the array at hand, `fits` answers budget questions: the longest prefix with at most so many
tokens, the tokens of any truncation, without encoding again.

Defined results
* Null text counts as empty: 0 tokens, and one prefix (the empty one).
* A prefix ends between two code points. Strings of special tokens in a text are one token each.
* Texts of any length are counted whole; the array has one entry for each code point and one more. A word
  without a break takes time in proportion to its length.
* Repeated rows repeat in the result. Output columns replace input columns of the same name.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rosterlake.llm.common import PieceArrays, chunks, workers_import

VOCABULARY = "byte_bpe_50k.json"
LIMIT = 512
#: Entries that a worker keeps before it starts anew; bounds its memory.
MOST_PIECES, MOST_PAIRS, MOST_MOVES = 400_000, 500_000, 300_000

#: Below this code point the pre-tokenizer's classes are spelled out for Python's own matcher; texts
#: with higher ones are cut by the library's pre-tokenizer.
PLAIN = 0x180
HIGH = re.compile(f"[{chr(PLAIN)}-\U0010ffff]")


def class_of(kind: str) -> str:
    """The characters below PLAIN of a general category, or white space, for a regular expression."""
    if kind == "space":
        return "\\t-\\r\\x20\\x85\\xa0"
    return "".join(re.escape(chr(i)) for i in range(PLAIN) if unicodedata.category(chr(i))[0] == kind)


def beyond_plain(text: str) -> bool:
    return not text.isascii() and HIGH.search(text) is not None


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies, turned round."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class PrefixCounter:
    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        with open(path) as f:
            given = json.load(f)
        letters = byte_letters()
        to_bytes = lambda s: bytes(letters[c] for c in s)
        self.ids = {to_bytes(t): i for t, i in given["model"]["vocab"].items() if all(c in letters for c in t)}
        self.written = {i: t for t, i in given["model"]["vocab"].items()}
        # The tokens as a tree: step[node << 8 | byte] is the next node, token[node] the token or -1.
        self.step: dict[int, int] = {}
        self.token, edges, depth = [-1], [0], [0]
        for t, i in self.ids.items():
            node = 0
            for length, b in enumerate(t, 1):
                edge = node << 8 | b
                node = self.step.setdefault(edge, len(edges))
                if node == len(edges):
                    self.token.append(-1)
                    edges.append(edge)
                    depth.append(length)
            self.token[node] = i
        # What has been read so far leads to the node of its longest end that begins a token; back[node] is the next
        # shorter such end, and endings[node] are the (length, token) that end there, longest first.
        self.back = [0] * len(edges)
        self.endings: list[list[tuple[int, int]]] = [[]] * len(edges)
        for node in sorted(range(1, len(edges)), key=depth.__getitem__):
            if depth[node] > 1:
                self.back[node] = self.move(self.back[edges[node] >> 8], edges[node] & 255)
            own = [(depth[node], self.token[node])] if self.token[node] >= 0 else []
            shorter = self.endings[self.back[node]]
            self.endings[node] = own + shorter if own else shorter
        self.moves: dict[int, int] = {}
        special = [t["content"] for t in given["added_tokens"] if t["special"]]
        self.special = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        letter, number, space = class_of("L"), class_of("N"), class_of("space")
        self.plain = re.compile(
            f" ?[{letter}]+| ?[{number}]+|'(?:s|t|re|ve|m|ll|d)| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+"
        )
        self.pairs: dict[int, bool] = {}
        self.known = PieceArrays(MOST_PIECES)

    def fit(self, first: int, second: int) -> bool:
        """Whether `second` may follow `first` (-1: nothing) in an encoding."""
        if len(self.pairs) >= MOST_PAIRS:
            self.pairs.clear()
        pair = [second] if first < 0 else [first, second]
        merged = self.tokenizer.model.tokenize("".join(map(self.written.__getitem__, pair)))
        found = self.pairs[first << 20 | second] = [t.id for t in merged] == pair
        return found

    def move(self, node: int, byte: int) -> int:
        """The node after one more byte."""
        while (to := self.step.get(node << 8 | byte)) is None and node:
            node = self.back[node]
        return to or 0

    def moved(self, edge: int) -> int:
        if len(self.moves) >= MOST_MOVES:
            self.moves.clear()
        node = self.moves[edge] = self.move(edge >> 8, edge & 255)
        return node

    def bytes_counts(self, piece: bytes, counts: list[int], last: list[int], nodes: list[int]) -> None:
        """Go on to the end of the piece; counts, last tokens and nodes stand for some prefixes already."""
        moves, pairs, endings, node = self.moves.get, self.pairs.get, self.endings, nodes[-1]
        for end in range(len(counts), len(piece) + 1):
            edge = node << 8 | piece[end - 1]
            node = moves(edge)
            if node is None:
                node = self.moved(edge)
            nodes.append(node)
            for length, token in endings[node]:
                before = last[end - length]
                fit = pairs(before << 20 | token)
                if self.fit(before, token) if fit is None else fit:
                    counts.append(counts[end - length] + 1)
                    last.append(token)
                    break
            else:
                raise ValueError("the vocabulary lacks a byte")

    def learn(self, pieces: Iterable[str]) -> None:
        """Count the prefixes of pieces not yet known, those that begin alike one after the other."""
        pieces = set(pieces)
        new = sorted((p.encode(), p) for p in self.known.missing(pieces))
        counts, last, nodes, previous = [0], [-1], [0], b""
        lengths: list[int] = []
        made: list[int] = []
        for raw, piece in new:
            same = 0
            for a, b in zip(raw, previous):
                if a != b:
                    break
                same += 1
            del counts[same + 1 :], last[same + 1 :], nodes[same + 1 :]
            self.bytes_counts(raw, counts, last, nodes)
            previous = raw
            if len(raw) == len(piece):
                own = counts[1:]
            else:
                own = [counts[i] for i in range(1, len(raw)) if raw[i] & 0xC0 != 0x80] + [counts[-1]]
            if piece in ("'re", "'ve", "'ll"):  # a text that ends before the last letter is cut after the mark
                own[1] = own[0] + 1
            lengths.append(len(own))
            made += own
        if new:
            self.known.add([p for _, p in new], lengths, made)

    def pieces(self, text: str) -> list[str]:
        if beyond_plain(text):
            return [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]
        return self.plain.findall(text)

    def ordinary(self, pieces: list[str]) -> np.ndarray:
        """Counts of the non-empty prefixes of a text without special tokens, given its pieces."""
        if not pieces:
            return np.zeros(0, dtype=np.int64)
        own, ends = self.known.joined(self.known.numbers(pieces))
        totals = own[ends - 1].astype(np.int64)
        before = np.cumsum(totals) - totals
        counts = own + np.repeat(before, np.diff(ends, prepend=0))
        if any(map(str.isspace, pieces)):
            for i, (piece, after) in enumerate(zip(pieces, pieces[1:])):
                # A run's last blank went to the next piece; a text that ends with it keeps the run whole.
                if piece.isspace() and after[0].isspace():
                    counts[ends[i]] = before[i] + self.run_tokens(piece + after[0])
        return counts

    def run_tokens(self, run: str) -> int:
        counts = [0]
        self.bytes_counts(run.encode(), counts, [-1], [0])
        return counts[-1]

    def cut(self, text: str) -> list[list[str]]:
        """Pieces of the text between special tokens. Where a special token follows, the pieces of the
        same text with that token's proper prefixes, which are ordinary text, stand after them."""
        parts = self.special.split(text) if self.special else [text]
        found = []
        for segment, special in zip(parts[::2], parts[1::2]):
            found += [self.pieces(segment), self.pieces(segment + special[:-1])]
        return [*found, self.pieces(parts[-1])]

    def joined(self, cut: list[list[str]]) -> np.ndarray:
        """Tokens of text[:i] for i from 0 to len(text), given what cut(text) returned."""
        out, base = [np.zeros(1, dtype=np.int64)], 0
        for own, longer in zip(cut[:-1:2], cut[1::2]):
            counts, plain = self.ordinary(longer), self.ordinary(own)
            counts[: len(plain)] = plain
            out.append(base + np.append(counts, (plain[-1] if len(plain) else 0) + 1))
            base = int(out[-1][-1])
        out.append(base + self.ordinary(cut[-1]))
        return np.concatenate(out).astype(np.int32)

    def many(self, texts: Iterable[str | None]) -> Iterator[np.ndarray]:
        """prefix_counts of each text; new pieces of some texts are counted together."""
        for group in chunks(t or "" for t in texts):
            pieces = [self.cut(t) for t in group]
            self.learn(set().union(*[segment for of_text in pieces for segment in of_text]))
            yield from map(self.joined, pieces)

    def prefix_counts(self, text: str | None) -> np.ndarray:
        """Tokens of text[:i] for i from 0 to len(text)."""
        return next(self.many([text]))


def fits(counts: np.ndarray, limit: int) -> int:
    """Code points of the longest prefix of at most `limit` tokens."""
    return int(np.flatnonzero(counts <= limit)[-1])


@lru_cache(maxsize=2)
def counter(path: str) -> PrefixCounter:
    """One counter for each worker process and vocabulary."""
    return PrefixCounter(path)


def vocabulary(name: str = VOCABULARY) -> str:
    return public_tokenizers.path(name)


def with_prefix_counts(df: DataFrame, text: str = "text", *, path: str | None = None, name: str = "prefix_tokens") -> DataFrame:
    """df with an array of the exact token count of every prefix, the empty one first."""
    workers_import(df.sparkSession)

    @F.arrow_udf("array<int>")
    def count(texts: pa.Array) -> pa.Array:
        c = counter(path or vocabulary())
        return pa.array(list(c.many(t.as_py() for t in texts)), pa.list_(pa.int32()))

    return df.withColumn(name, count(F.col(text)))


def with_token_counts(df: DataFrame, text: str = "text", *, limit: int = LIMIT, path: str | None = None) -> DataFrame:
    """df with n_tokens, and fit_chars: the code points of the longest prefix within `limit` tokens.

    Both are read from the array of prefix counts, which stays in the task.
    """
    workers_import(df.sparkSession)

    @F.arrow_udf("struct<n_tokens bigint, fit_chars bigint>")
    def count(texts: pa.Array) -> pa.Array:
        c = counter(path or vocabulary())
        tokens, chars = [], []
        for counts in c.many(t.as_py() for t in texts):
            tokens.append(int(counts[-1]))
            chars.append(fits(counts, limit))
        return pa.StructArray.from_arrays([pa.array(tokens, pa.int64()), pa.array(chars, pa.int64())], ["n_tokens", "fit_chars"])

    kept = [c for c in df.columns if c not in ("n_tokens", "fit_chars")]
    return df.withColumn("_tokens", count(F.col(text))).select(*kept, "_tokens.n_tokens", "_tokens.fit_chars")
