"""Token counts by trie-shared dynamic programming over a public vocabulary.

A text's pre-tokens are its words, each with the vocabulary's word mark before it.  The distinct pre-tokens of a block of
texts form a trie; the best unigram score of a prefix depends on nothing else, so it is computed once per trie
node, level by level, from the nodes up to one piece above it.  The node where a pre-token ends stores its number
of tokens, and a text's count is the sum over its words.

The unigram model is the public vocabulary itself: a piece's probability falls with its place in the vocabulary as
1 / (place + 1), and every byte can stand for itself at a price below all pieces (byte fallback).  Of equal scores the
segmentation with fewer tokens counts.  Nothing is learned from the corpus, and nothing is shuffled.

Where fewer than FEW words are still going on, what is left of the trie are single paths; those words go through the same
recursion one by one.  Texts and words of any length are counted whole.  A null or empty text has no tokens.  Rows that repeat count again; a null doc_id is kept; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁".encode()
FEW = 32
SLOTS = 1 << 18
BLOCK = 2 * W.PIECE
COUNTS = "doc_id bigint, n_bytes bigint, n_words bigint, n_tokens bigint, n_fallback bigint"


class Vocabulary:
    """Pieces as bytes with their log-probabilities, and a hash table of them."""

    def __init__(self, pieces: list[bytes]):
        """pieces in the vocabulary's order."""
        total = np.log(sum(1.0 / (k + 1) for k in range(len(pieces) + 256)))
        place = lambda k: float(-np.log(k + 1.0) - total)
        self.score = {p: place(k) for k, p in reversed(list(enumerate(pieces))) if p}
        self.byte = place(len(pieces) + 256) - 4.0
        self.sizes = sorted({len(p) for p in self.score})
        self.largest = self.sizes[-1] if self.sizes else 1
        names = list(self.score)
        self.hash = np.array([self._hash(p) for p in names], np.uint64)
        self.value = np.array([self.score[p] for p in names])
        self.slots = np.full(SLOTS, -1, np.int32)
        self.probes = 1
        for i, h in enumerate(self.hash.tolist()):
            at, step = h >> 46, 0
            while self.slots[(at + step) % SLOTS] >= 0:
                step += 1
            self.slots[(at + step) % SLOTS] = i
            self.probes = max(self.probes, step + 1)

    @staticmethod
    def _hash(piece: bytes) -> int:
        h = 0
        for k, b in enumerate(piece):
            h = (h + int(W._BYTE[0][b]) * pow(W._P[0], k, 1 << 64)) % (1 << 64)
        return int(W.mix(np.array([h + len(piece) * W._SEED & (1 << 64) - 1], np.uint64))[0])

    def look_up(self, h: np.ndarray) -> np.ndarray:
        """The log-probability for each hash of a piece; -inf where there is none."""
        out = np.full(len(h), -np.inf)
        if not len(self.hash):
            return out
        at = (h >> np.uint64(46)).astype(np.int64)
        todo = np.arange(len(h))
        for step in range(self.probes):
            found = self.slots[(at[todo] + step) % SLOTS]
            some = found >= 0
            todo, found = todo[some], found[some]
            hit = self.hash[found] == h[todo]
            out[todo[hit]] = self.value[found[hit]]
            todo = todo[~hit]
            if not len(todo):
                break
        return out


def load(path: str = VOCABULARY) -> Vocabulary:
    """The ordinary pieces of a sentencepiece model file, in order."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    plain = [k for k in range(n) if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k) or model.is_unused(k))]
    return Vocabulary([model.id_to_piece(k).encode() for k in plain])


def count_one(word: bytes, vocabulary: Vocabulary) -> tuple[int, int]:
    """(tokens, fallback bytes) of one pre-token, without sharing."""
    n = len(word)
    best: list[tuple[float, int, int]] = [(0.0, 0, 0)]
    for i in range(1, n + 1):
        s, t, f = best[i - 1]
        top = (s + vocabulary.byte, -t - 1, -f - 1)
        for k in vocabulary.sizes:
            if k > i:
                break
            if (p := vocabulary.score.get(word[i - k : i])) is not None:
                s, t, f = best[i - k]
                top = max(top, (s + p, -t - 1, -f))
        best.append((top[0], -top[1], -top[2]))
    return best[n][1], best[n][2]


def count_trie(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, vocabulary: Vocabulary) -> np.ndarray:
    """(tokens, fallback bytes) for each of some distinct words, which are ranges of bytes, by one trie."""
    n = len(starts)
    out = np.zeros((n, 2), np.int64)
    raw = data.tobytes()
    words = [raw[a : a + k] for a, k in zip(starts.tolist(), sizes.tolist(), strict=True)]
    order = np.array(sorted(range(n), key=words.__getitem__), np.int64)
    starts, sizes = starts[order], sizes[order]
    same = np.ones(n, bool)  # whether a word's prefix is that of the word before it
    longest = int(sizes.max(initial=0))
    power, back = W.powers(W._P[0], longest + 1), W.powers(W.inverse(W._P[0]), longest + 1)
    keep = vocabulary.largest + 1
    state: list[tuple[np.ndarray, ...]] = [(np.zeros(n, np.uint64), np.zeros(n), np.zeros(n, np.int32), np.zeros(n, np.int32))]
    with np.errstate(over="ignore"):
        for i in range(1, longest + 1):
            alive = np.flatnonzero(sizes >= i)
            if len(alive) < FEW:
                for k in alive:
                    out[order[k]] = count_one(words[order[k]], vocabulary)
                break
            if 2 * len(alive) < len(sizes):  # the others have ended: their numbers are not carried along
                lost = np.diff(alive, prepend=-2) > 1  # the word before was shorter than any prefix to come
                order, starts, sizes, same = order[alive], starts[alive], sizes[alive], same[alive] & ~lost
                state = [tuple(x[alive] for x in level) for level in state]
                alive = np.arange(len(order))
            byte = data[starts[alive] + i - 1]
            last = np.maximum(alive - 1, 0)
            same[alive] &= (alive > 0) & (sizes[last] >= i) & (data[starts[last] + np.minimum(i, sizes[last]) - 1] == byte)
            new = ~same[alive]  # the first word with this prefix stands for the node
            node = alive[new]
            prefix, score, tokens, fallback = state[-1]
            h = prefix[node] + W._BYTE[0][byte[new]] * power[i - 1]
            top, count, bytes_ = score[node] + vocabulary.byte, tokens[node] + 1, fallback[node] + 1
            for k in vocabulary.sizes:
                if k > i:
                    break
                prefix, score, tokens, fallback = state[-k]
                p = vocabulary.look_up(W.mix((h - prefix[node]) * back[i - k] + np.uint64(k * W._SEED & (1 << 64) - 1)))
                hit = np.flatnonzero(p > -np.inf)
                some = node[hit]
                got, more, other = score[some] + p[hit], tokens[some] + 1, fallback[some]
                better = (got > top[hit]) | ((got == top[hit]) & ((more < count[hit]) | ((more == count[hit]) & (other < bytes_[hit]))))
                hit = hit[better]
                top[hit], count[hit], bytes_[hit] = got[better], more[better], other[better]
            of = np.cumsum(new) - 1
            now = (np.zeros(len(sizes), np.uint64), np.zeros(len(sizes)), np.zeros(len(sizes), np.int32), np.zeros(len(sizes), np.int32))
            for whole, part in zip(now, (h, top, count, bytes_), strict=True):
                whole[alive] = part[of]
            state = [*state[-(keep - 1):], now]
            ends = alive[sizes[alive] == i]
            out[order[ends], 0], out[order[ends], 1] = now[2][ends], now[3][ends]
    return out


def count_words(found: W.Words, vocabulary: Vocabulary) -> np.ndarray:
    """(tokens, fallback bytes) of each word of a block; each distinct word is looked at once, in one trie for all."""
    _, at, of = np.unique(W.hashes(found), return_index=True, return_inverse=True)
    starts, sizes = found.starts[at], (found.ends - found.starts)[at] + len(MARK)
    begin = np.append(0, np.cumsum(sizes))
    place = np.repeat(starts - begin[:-1] - len(MARK), sizes) + np.arange(begin[-1])
    marked = found.data[np.clip(place, 0, len(found.data) - 1)]
    for k, b in enumerate(MARK):
        marked[begin[:-1] + k] = b
    return count_trie(marked, begin[:-1], sizes, vocabulary)[of]


def token_counts(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Per row of (doc_id, text): doc_id, n_bytes, n_words, n_tokens, n_fallback (tokens that are single bytes)."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # a public file of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.merged_blocks(batches, BLOCK):
            found = W.find(batch.column("text"))
            total = np.zeros((len(found) + 1, 2), np.int64)
            if len(found):
                np.cumsum(count_words(found, shared.value), axis=0, out=total[1:])
            sums = np.diff(total[found.first], axis=0)
            yield pa.RecordBatch.from_arrays(
                [W.ids_out(W.long_ids(batch.column("doc_id"))), pa.array(np.diff(found.texts)), pa.array(found.counts()), pa.array(sums[:, 0]), pa.array(sums[:, 1])],
                names=["doc_id", "n_bytes", "n_words", "n_tokens", "n_fallback"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, COUNTS)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), load())
