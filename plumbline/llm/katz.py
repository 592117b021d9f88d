"""Operator 7, Katz backoff scoring.

Spark counts words and word pairs of the training documents. Pairs seen up to CUTOFF times get Good-Turing discounts
(from the counts of counts), the mass so freed in a context goes to the words not seen after it, in proportion to their
unigram probability, with a backoff weight that makes each context sum to one exactly. Unigrams are add-one over the
training vocabulary and one unknown word.

Documents are cut into blocks of about BLOCK tokens. A block sends each of its distinct words and pairs once, with its
training count, to the shard that owns it; the shard adds up the counts of all blocks and answers with the totals in the
order in which the block asked, so that neither keys nor document ids travel back. What a (block, shard) pair exchanges
is one row of compressed integer arrays. The word table numbers the words; pairs are owned by the shard of their first
word, which also sums up the context (its count, its pairs by count, the unigram mass that they cover). Frequent first
words are dealt over several shards in proportion to their frequency; blocks add up such partial contexts. The tables
are stored, partitioned by shard; the driver sees eight numbers. Each token is then scored in its block: the pair's
discounted probability, or else its context's backoff weight times the unigram.

Words are known by 64-bit hashes. Defined cases: null and empty texts consist of the end alone; doc_id has to fit a long; a null doc_id counts as
the empty id (crc32 0, a training document); rows equal in doc_id and text are scored each; without training documents
every word is unknown; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyspark
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import map_frames, mix, read, stored

CUTOFF = 5
#: Hashes that stand for the start (only ever a context) and the end of a text.
START, END = 0, 1
#: Tokens of a block (more only if one document has more), and of a shard on average.
BLOCK, SHARD = 3_000_000, 2_000_000
#: A context is split if it has over 1 / SPLIT of a shard's tokens.
SPLIT = 4

ANSWER = "block bigint, shard int, kind string, parts array<binary>, stats array<bigint>"


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 7 == 2


def pack(a: np.ndarray) -> bytes:
    """64-bit integers as compressed byte planes."""
    a = np.ascontiguousarray(a, np.uint64)
    width = (int(a.max()).bit_length() + 7) // 8 if len(a) else 0
    return bytes([width]) + zstandard.compress(a.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes() or bytes(len(a)), 3)


def unpack(data: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(data[1:]), np.uint8)
    width = data[0]
    if not width:
        return np.zeros(len(raw), np.int64)
    out = np.zeros((len(raw) // width, 8), np.uint8)
    out[:, :width] = raw.reshape(width, -1).T
    return out.view(np.int64).reshape(-1)


def pack_sorted(a: np.ndarray) -> bytes:
    a = a.astype(np.uint64)
    return pack(np.diff(a, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data).view(np.uint64), dtype=np.uint64)


def encode(docs: DataFrame, train: Column) -> DataFrame:
    """Blocks: block, n_tokens, ids and none (doc_id of each document; 1 if it is null), lens and train (its tokens; 1 if it is a training document), tokens (numbers of words), words (sorted hashes), n (training counts) and uses (as context)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = pyspark.TaskContext.get().partitionId() << 32
        ids, lens, mask, seqs, voc, size = [], [], [], [], {}, 0

        def flush(k: int) -> pd.DataFrame:
            first = np.concatenate(seqs)
            hashes = np.fromiter((START, END, *map(xxhash.xxh3_64_intdigest, voc)), np.uint64, len(voc) + 2)
            words, place = np.unique(hashes, return_inverse=True)
            tokens, ln, tr = place[first], np.array(lens), np.array(mask)
            n = np.bincount(tokens, np.repeat(tr, ln), len(words))
            uses = np.bincount(tokens, minlength=len(words))
            uses[START], uses[END] = len(lens), 0
            none = np.array([i is None for i in ids])
            row = {"block": part + k, "n_tokens": size, "ids": pack(np.array([i or 0 for i in ids], np.int64)), "none": pack(none), "lens": pack(ln), "train": pack(tr), "tokens": pack(tokens), "words": pack_sorted(words), "n": pack(n), "uses": pack(uses)}
            return pd.DataFrame([row])

        k = 0
        for batch in batches:
            for d, t, m in zip(batch["doc_id"].astype("Int64"), batch["text"], batch["train"], strict=True):
                seq = [voc.setdefault(w, len(voc) + 2) for w in (t or "").encode("utf-8", "surrogatepass").lower().split()]
                seq.append(END)
                ids.append(None if d is pd.NA else int(d))
                lens.append(len(seq))
                mask.append(int(m))
                seqs.append(np.array(seq, np.int64))
                size += len(seq)
                if size >= BLOCK:
                    yield flush(k)
                    ids, lens, mask, seqs, voc, size, k = [], [], [], [], {}, 0, k + 1
        if size:
            yield flush(k)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(train, F.lit(False)).alias("train"))
    return map_frames(rows, run, "block bigint, n_tokens bigint, ids binary, none binary, lens binary, train binary, tokens binary, words binary, n binary, uses binary")


def ask_words(blocks: DataFrame, shards: int) -> DataFrame:
    """(shard, block, words, n, uses): each block's words, cut by the shard that owns them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for b, words, n, uses in zip(batch["block"], batch["words"], batch["n"], batch["uses"], strict=True):
                words, n, uses = unpack_sorted(words), unpack(n), unpack(uses)
                owner = (words >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)
                s, at = np.unique(owner, return_index=True)
                cuts = list(zip(s, at, np.append(at[1:], len(words)), strict=True))
                yield pd.DataFrame([(int(s), b, pack_sorted(words[i:j]), pack(n[i:j]), pack(uses[i:j])) for s, i, j in cuts], columns=["shard", "block", "words", "n", "uses"])

    return blocks.select("block", "words", "n", "uses").mapInPandas(run, "shard int, block bigint, words binary, n binary, uses binary")


def answer_words(asked: DataFrame, shards: int, tokens: int) -> DataFrame:
    """The word table: per shard and block the words' ids, training counts and numbers of shards as a context; stats: tokens and types in training."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        keys = [unpack_sorted(x) for x in rows["words"]]
        words, place = np.unique(np.concatenate(keys), return_inverse=True)
        total = lambda c: np.bincount(place, np.concatenate([unpack(x) for x in rows[c]]), len(words)).astype(np.int64)
        n, uses = total("n"), total("uses")
        ids = np.empty(len(words), np.int64)
        ids[np.argsort(-n, kind="stable")] = np.arange(len(words))
        ids = ids * shards + int(rows["shard"].iloc[0])
        split = np.minimum(shards, uses * (SPLIT * shards) // tokens + 1)
        ends = np.cumsum([len(k) for k in keys])
        out = [(b, s, "word", [pack(x[p]) for x in (ids, n, split)], None) for b, s, p in zip(rows["block"], rows["shard"], np.split(place, ends[:-1]), strict=True)]
        out[0] = (*out[0][:4], [int(n.sum()), int(np.count_nonzero(n))])
        return pd.DataFrame(out, columns=["block", "shard", "kind", "parts", "stats"])

    return asked.groupBy("shard").applyInPandas(run, ANSWER)


class Pairs:
    """The distinct pairs of one block in the order in which shards are asked: by shard, first word, second word."""

    def __init__(self, block: pd.Series, answers: pd.DataFrame, shards: int):
        answers = answers[answers["kind"] == "word"].sort_values("shard")
        ids, self.c, split = (np.concatenate([unpack(p[k]) for p in answers["parts"]]) for k in range(3))
        self.tokens, self.lens = unpack(block["tokens"]), unpack(block["lens"])
        self.starts = np.concatenate(([0], np.cumsum(self.lens)[:-1]))
        before = np.roll(self.tokens, 1)
        before[self.starts] = START
        key, self.place = np.unique(before * len(ids) + self.tokens, return_inverse=True)
        n = np.bincount(self.place, np.repeat(unpack(block["train"]), self.lens), len(key)).astype(np.int64)
        a, b = key // len(ids), key % len(ids)
        # a split context is asked for in all its shards: second word 0 is none
        wide = np.unique(a[split[a] > 1])
        more = np.repeat(wide, split[wide])
        nth = np.arange(len(more)) - np.repeat(np.cumsum(split[wide]) - split[wide], split[wide])
        home = (mix(ids.astype(np.uint64)) >> np.uint64(2)).astype(np.int64)
        owner = (home[a] + home[b] % split[a]) % shards
        owner = np.concatenate((owner, (home[more] % shards + nth) % shards))
        g1, g2 = ids[np.concatenate((a, more))], np.concatenate((ids[b] + 1, np.zeros(len(more), np.int64)))
        self.order = np.lexsort((g2, g1, owner))
        pad = np.zeros(len(more), np.int64)
        first = np.concatenate((a, more))[self.order]
        self.owner, self.g1, self.g2 = owner[self.order], g1[self.order], g2[self.order]
        self.n, self.c2 = np.concatenate((n, pad))[self.order], np.concatenate((self.c[b], pad))[self.order]
        new = np.ones(len(first), bool)
        new[1:] = (self.g1[1:] != self.g1[:-1]) | (self.owner[1:] != self.owner[:-1])
        self.heads = np.flatnonzero(new)  # of the contexts
        self.first, self.a, self.b = first[self.heads], a, b


def ask_pairs(blocks: DataFrame, words: DataFrame, shards: int) -> DataFrame:
    """(shard, block, parts): first words, pairs of each, second words, training counts, counts of the second words."""

    def run(block: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        p = Pairs(block.iloc[0], answers, shards)
        size = np.diff(np.append(p.heads, len(p.g1)))
        g2 = np.diff(p.g2, prepend=0)
        g2[p.heads] = p.g2[p.heads]
        s, at = np.unique(p.owner, return_index=True)
        out = []
        for s, i, j in zip(s, at, np.append(at[1:], len(p.owner)), strict=True):
            h, k = np.searchsorted(p.heads, (i, j))
            out.append((int(s), block["block"].iloc[0], [pack_sorted(p.g1[p.heads[h:k]]), *map(pack, (size[h:k], g2[i:j], p.n[i:j], p.c2[i:j]))]))
        return pd.DataFrame(out, columns=["shard", "block", "parts"])

    need = blocks.select("block", "tokens", "lens", "train").groupBy("block")
    return need.cogroup(words.groupBy("block")).applyInPandas(run, "shard int, block bigint, parts array<binary>")


def answer_pairs(asked: DataFrame) -> DataFrame:
    """The pair table: per shard and block the pairs' training counts, then for its contexts the count, the pairs of count 1 to CUTOFF, and the sum of (c + 1) over second words seen; stats: counts of counts up to CUTOFF + 1."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        g1, g2, n, c2, contexts = [], [], [], [], []
        for firsts, size, second, count, c in rows["parts"]:
            firsts, size, second = unpack_sorted(firsts).astype(np.int64), unpack(size), unpack(second)
            heads = np.cumsum(size) - size
            total = np.cumsum(second)
            g2.append(total - np.repeat(total[heads] - second[heads], size))
            g1.append(np.repeat(firsts, size))
            n.append(unpack(count))
            c2.append(unpack(c))
            contexts.append(firsts)
        ends = np.cumsum([len(x) for x in n])
        w1, i1 = np.unique(np.concatenate(g1), return_inverse=True)
        w2, i2 = np.unique(np.concatenate(g2), return_inverse=True)
        key, at, place = np.unique(i1 * len(w2) + i2, return_index=True, return_inverse=True)
        total = np.bincount(place, np.concatenate(n), len(key)).astype(np.int64)
        a, seen = key // len(w2), total > 0
        sums = [np.bincount(a, x, len(w1)).astype(np.int64) for x in (total, *(total == r for r in range(1, CUTOFF + 1)), np.where(seen, np.concatenate(c2)[at] + 1, 0))]
        out = []
        for b, s, p, c in zip(rows["block"], rows["shard"], np.split(place, ends[:-1]), contexts, strict=True):
            c = np.searchsorted(w1, c)
            out.append((b, s, "pair", [pack(total[p]), *(pack(x[c]) for x in sums)], None))
        out[0] = (*out[0][:4], np.bincount(np.minimum(total, CUTOFF + 2), minlength=CUTOFF + 3)[1 : CUTOFF + 2].tolist())
        return pd.DataFrame(out, columns=["block", "shard", "kind", "parts", "stats"])

    return asked.groupBy("shard").applyInPandas(run, ANSWER)


def discounts(count_of: dict[int, int]) -> list[float]:
    """Katz's Good-Turing factors for counts 1 .. CUTOFF; (r - 0.5) / r where the counts of counts give none in (0, 1)."""
    out = []
    n = [0.0] + [float(count_of.get(r, 0)) for r in range(1, CUTOFF + 2)]
    rest = (CUTOFF + 1) * n[CUTOFF + 1] / n[1] if n[1] else 1.0
    for r in range(1, CUTOFF + 1):
        d = ((r + 1) * n[r + 1] / n[r] / r - rest) / (1 - rest) if n[r] and rest < 1 else 0.0
        out.append(d if 0 < d < 1 else (r - 0.5) / r)
    return out


class Katz:
    """The model of the rows of ``docs`` (doc_id, text) that ``train`` selects, to score all rows of ``docs``; tokens and types in training."""

    def __init__(self, docs: DataFrame, train: Column | None = None):
        self.blocks = stored(encode(docs, F.lit(True) if train is None else train), "blocks")
        every = self.blocks.agg(F.sum("n_tokens")).first()[0] or 1
        self.shards = max(8, every // SHARD)
        self.words = stored(answer_words(ask_words(self.blocks, self.shards), self.shards, every), "words")
        self.tokens, self.types = self._stats(self.words, 2)
        self.pairs = stored(answer_pairs(ask_pairs(self.blocks, self.words, self.shards)), "pairs")
        self.discounts = discounts(dict(enumerate(self._stats(self.pairs, CUTOFF + 1), 1)))

    @staticmethod
    def _stats(answers: DataFrame, n: int) -> list[int]:
        return [x or 0 for x in answers.agg(*(F.sum(F.col("stats")[i]) for i in range(n))).first()]

    def score(self) -> DataFrame:
        """Per document: doc_id, n_tokens, n_known, base_score, score."""
        shards, total = self.shards, float(self.tokens + self.types + 1)
        d = np.array([0.0, *self.discounts])
        drop = np.arange(1, CUTOFF + 1) * (1 - d[1:])  # what a pair of that count gives up

        def run(block: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
            p = Pairs(block.iloc[0], answers, shards)
            mine = answers[answers["kind"] == "pair"].sort_values("shard")["parts"]
            n = np.empty(len(p.order), np.int64)
            n[p.order] = np.concatenate([unpack(x[0]) for x in mine])
            sums = [np.bincount(p.first, np.concatenate([unpack(x[k]) for x in mine]), len(p.c)) for k in range(1, CUTOFF + 3)]
            count, covered = sums[0], sums[-1]
            mass = count - sum(k * x for k, x in zip(sums[1:-1], drop, strict=True))
            known = count > 0
            # a context that discounts less than one occurrence gives up that of one more
            free = np.maximum(1 - mass / np.where(known, count, 1), 1 / (count + 1))
            scale = (1 - free) / np.where(known, mass, 1)
            alpha = np.where(known, free / np.maximum((total - covered) / total, 1e-300), 1.0)
            uni = (p.c + 1) / total
            n = n[: len(p.a)]
            kept = n * np.where(n <= CUTOFF, d[np.minimum(n, CUTOFF)], 1.0) * scale[p.a]
            logp = np.log10(np.where(n > 0, kept, alpha[p.a] * uni[p.b]))
            add = lambda x: np.add.reduceat(x, p.starts)
            base = np.log10(uni)
            return pd.DataFrame({"doc_id": pd.arrays.IntegerArray(unpack(block["ids"].iloc[0]), unpack(block["none"].iloc[0]).astype(bool)), "n_tokens": p.lens, "n_known": add((p.c > 0)[p.tokens].astype(np.int64)), "base_score": add(base[p.tokens]), "score": add(logp[p.place])})

        need = self.blocks.select("block", "tokens", "lens", "train", "ids", "none").groupBy("block")
        both = self.words.unionByName(self.pairs).drop("stats").groupBy("block")
        return need.cogroup(both).applyInPandas(run, "doc_id bigint, n_tokens bigint, n_known bigint, base_score double, score double")


def op7_katz_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document under the model of the training documents."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = Katz(docs, ~held_out(F.col("doc_id")))
    return model.score().select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")
