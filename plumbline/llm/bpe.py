"""Operator 9, byte-level BPE encoding and decoding.

Words of a split pattern are encoded one by one. Bytes are mapped to Latin-1 characters for an Aho-Corasick automaton
over the reversed vocabulary, which gives the longest token at every position in one pass. Encoding then walks from left
to right with the longest token, falls back to the next shorter prefix where a token cannot follow its predecessor, and
steps back where none can. Which two tokens may be neighbours is remembered. A position is given up at most once, so the
work is linear in the word's length, and the result is that of the exact merges: a sequence of tokens is the BPE result
if and only if each adjacent pair is the BPE result of its own bytes.

The ranks file is a parameter. The driver reads it once and broadcasts the tokens and their splits (a few MB, fixed by
the vocabulary).

Defined cases: null text counts as empty and has no tokens; repeated rows are encoded each; an empty table gives an empty
table; extra columns are kept, but for those called like a result (n_tokens, ids, the digests), which are overwritten.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import ahocorasick
import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession

from plumbline.llm.common import add_columns, read

NEVER = 1 << 60


def read_ranks(path: str) -> list[bytes]:
    """Tokens by rank from a file of lines ``base64 rank``."""
    with open(path, "rb") as f:
        rows = [line.split() for line in f if line.strip()]
    out = [b""] * len(rows)
    for token, rank in rows:
        out[int(rank)] = base64.b64decode(token)
    return out


def merged(piece: bytes, ids: dict[bytes, int]) -> tuple[list[bytes], tuple[bytes, bytes] | None]:
    """Plain BPE by repeated lowest-rank merges, and the two parts of the last merge."""
    parts, last = [piece[i : i + 1] for i in range(len(piece))], None
    while len(parts) > 1:
        ranks = [ids.get(parts[i] + parts[i + 1], NEVER) for i in range(len(parts) - 1)]
        i = min(range(len(ranks)), key=ranks.__getitem__)
        if ranks[i] == NEVER:
            break
        last = parts[i], parts[i + 1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts, last


@lru_cache(4)
def vocabulary(path: str) -> tuple[list[bytes], np.ndarray]:
    """Tokens, and for each the ids of the two parts that its last merge joins (-1, -1: a single byte; -2, -2: merges never make it)."""
    tokens = read_ranks(path)
    ids = {t: i for i, t in enumerate(tokens)}
    splits = np.full((len(tokens), 2), -1, np.int32)
    for i, t in enumerate(tokens):
        if len(t) > 1:
            parts, last = merged(t, ids)
            splits[i] = (ids[last[0]], ids[last[1]]) if len(parts) == 1 else (-2, -2)
    return tokens, splits


class Encoder(dict):
    """A dict from word to its ids (little-endian uint32 bytes), filled as words come and emptied at ``keep`` words."""

    def __init__(self, tokens: list[bytes], splits: np.ndarray, pattern: str, keep: int = 150_000):
        super().__init__()
        self.tokens, self.keep, self.words = tokens, keep, regex.compile(pattern)
        self.ids = {t: i for i, t in enumerate(tokens)}
        self.left, self.right = splits[:, 0].tolist(), splits[:, 1].tolist()
        self.size = [len(t) for t in tokens]
        self.pairs: dict[int, bool] = {}
        self.found = ahocorasick.Automaton()
        for i, t in enumerate(tokens):
            if self.left[i] != -2:
                self.found.add_word(t.decode("latin-1")[::-1], i)
        self.found.make_automaton()
        # edges of the tokens met so far: those of the whole vocabulary take tens of MB in every worker
        self.right_edge: dict[int, list[tuple[bytes, int]]] = {}
        self.left_edge: dict[int, list[tuple[bytes, int]]] = {}
        self.shorter = [-1] * len(tokens)
        for i, t in enumerate(tokens):
            for n in range(len(t) - 1, 0, -1):
                j = self.ids.get(t[:n], -1)
                if j >= 0 and self.left[j] != -2:
                    self.shorter[i] = j
                    break

    def edge(self, token: int, side: list[int], known: dict[int, list[tuple[bytes, int]]]) -> list[tuple[bytes, int]]:
        """The pieces that stand at one edge of a token while it is merged: (bytes, rank of the merge that takes it up)."""
        out = known.get(token)
        if out is None:
            out = known[token] = []
            until = NEVER
            while token >= 0:
                out.append((self.tokens[token], until))
                token, until = side[token], token
        return out

    def neighbours(self, a: int, b: int) -> bool:
        """Whether BPE of the bytes of a and b gives a, b: no merge across the border may come before the merges that take up its two sides."""
        rank, ends = self.ids.get, self.edge(b, self.left, self.left_edge)
        for x, x_until in self.edge(a, self.right, self.right_edge):
            for y, y_until in ends:
                m = rank(x + y)
                # of equal ranks the leftmost goes first
                if m is not None and m < x_until and m <= y_until:
                    return False
        return True

    def encode_word(self, word: bytes) -> list[int]:
        whole = self.ids.get(word)
        if whole is not None:
            return [whole]
        n, at = len(word), -1
        longest = [-1] * n
        for end, token in self.found.iter(word.decode("latin-1")[::-1]):  # of one end, the longest comes first
            if end != at:
                longest[n - 1 - end] = token
                at = end
        given_up, out, pos, token = bytearray(n + 1), [], 0, longest[0]
        size, shorter, pairs, base = self.size, self.shorter, self.pairs, len(self.tokens)
        while pos < n:
            while token >= 0:
                if not given_up[pos + size[token]]:
                    if not out:
                        break
                    key = out[-1] * base + token
                    fits = pairs.get(key)
                    if fits is None:
                        if len(pairs) > 200_000:
                            pairs.clear()
                        fits = pairs[key] = self.neighbours(out[-1], token)
                    if fits:
                        break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                pos += size[token]
                token = longest[pos] if pos < n else -1
            else:
                if not out:
                    raise ValueError("the vocabulary lacks a byte of the text")
                given_up[pos] = 1
                token = out.pop()
                pos -= size[token]
                token = shorter[token]
        return out

    def __missing__(self, word: str) -> bytes:
        if len(self) >= self.keep:
            self.clear()
        ids = np.array(self.encode_word(word.encode()), "<u4").tobytes()
        if len(word) <= 64:
            self[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, self.words.findall(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_made: dict[str, Encoder] = {}


def _encoder(tokens: list[bytes], splits: np.ndarray, pattern: str) -> Encoder:
    """One encoder for each vocabulary in a Python worker."""
    key = hashlib.sha256(b"\0".join(tokens) + pattern.encode()).hexdigest()
    if key not in _made:
        _made.clear()
        _made[key] = Encoder(tokens, splits, pattern)
    return _made[key]


def encode(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", with_ids: bool = True, digests: bool = True) -> DataFrame:
    """``docs`` without its text, plus n_tokens, ids (array of int), ids_sha256 and decoded_sha256 (of the bytes that the ids decode to)."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(vocabulary(ranks_path))
    new = {"n_tokens": "bigint"} | ({"ids": "array<int>"} if with_ids else {}) | ({"ids_sha256": "string", "decoded_sha256": "string"} if digests else {})

    def run(batch: pd.DataFrame) -> pd.DataFrame:
        coder = _encoder(*shared.value, pattern)
        coded = [coder.encode(t or "") for t in batch[text]]
        out = pd.DataFrame({"n_tokens": [len(c) // 4 for c in coded]}, dtype="int64")
        if with_ids:
            out["ids"] = [np.frombuffer(c, "<i4") for c in coded]
        if digests:
            out["ids_sha256"] = [hashlib.sha256(c).hexdigest() for c in coded]
            out["decoded_sha256"] = [hashlib.sha256(coder.decode(c)).hexdigest() for c in coded]
        return out

    kept = [c for c in docs.columns if c != text and c not in new]
    return add_columns(docs, kept, [text], ", ".join(f"{n} {t}" for n, t in new.items()), run)


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded with the multilingual byte-level vocabulary and decoded again."""
    import public_tokenizers

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=False)
