"""Quality classifier: an interpolated modified Kneser-Ney trigram model of trusted text.

Trusted are documents labelled good and not toxic.  A quarter of them, by hash of the id, never trains: its perplexities
set the thresholds.  The model learns from all the others, whole.  Nothing of it is held in one place: trigrams' counts,
what they tell of pairs and words (continuations, contexts' totals and kinds) and the documents' questions for them are
dealt by hash, one entry a batch for each distinct word, pair and trigram; replies are whole numbers, from which the
batch works out its probabilities.

A document is judged three times: by its mean log-probability, by that of its worst SPAN tokens in a row (so that a
bad passage is not averaged away), each with PRIOR tokens at its language's trusted mean added, so that a text of a few
words is not judged by one of them, and by the most words in a SPAN that repeat the word before.  It is kept if no
value is beyond what a third of QUANTILE of the trusted held-out documents of its language reach; so the three
together lose about QUANTILE of them.  A language's quantiles, as distances from its mean, are averaged with those
of all languages, which weigh as much as LEAST of its documents.

A null or empty text has no perplexity and is not kept.  A null lang is a language of its own.  Where nothing is
trusted, nothing can be told from it and every document with words is kept.  Several labels of one id must all agree to
be trusted.  Repeated rows are judged alike; other columns are ignored.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import words as W
from .storage import partitions, plan_bytes, release, shuffles_deleted, stored, stored_buckets
from .substrings import planes, unplanes

LONGEST = 8
QUANTILE = 0.005
SPAN = 32
PRIOR = 20
LEAST = 50
#: Rounds in which documents are scored: one for each ROUND_BYTES of input, ROUNDS at most.
ROUNDS = 16
ROUND_BYTES = 32 << 20
#: Turns in which n-grams are counted: one for each TURN_BYTES of text, TURNS at most.
TURNS = 8
TURN_BYTES = 64 << 20
#: Ids of documents that are broadcast at most; more are joined by shuffle.
FEW = 1_000_000
#: What is counted for a word or a pair: the words before it, and as a context: all that follow, and kinds that follow
#: once, twice, more often.  A trigram has its count alone.
COLUMNS = 5
_GRAMS_DDL = "bucket int, n int, low bigint, keys binary, m int, which binary, c binary"
_FACTS_DDL = "bucket int, n int, low bigint, keys binary, values binary"
_COUNTS_DDL = "bucket int, n int, low bigint, keys binary, values binary, told array<bigint>"
_ASKED_DDL = "bucket int, batch string, n int, low bigint, keys binary"
_REPLIES_DDL = "batch string, bucket int, n int, values binary"
_BATCH_DDL = "batch string, ids array<bigint>, langs array<string>, texts array<string>"
_KEYS = [("n", pa.int32()), ("low", pa.int64()), ("keys", pa.binary())]
_GRAMS = pa.schema([("bucket", pa.int32()), *_KEYS, ("m", pa.int32()), ("which", pa.binary()), ("c", pa.binary())])
_FACTS = pa.schema([("bucket", pa.int32()), *_KEYS, ("values", pa.binary())])
_COUNTS = pa.schema([("bucket", pa.int32()), *_KEYS, ("values", pa.binary()), ("told", pa.list_(pa.int64()))])
_ASKED = pa.schema([("bucket", pa.int32()), ("batch", pa.string()), *_KEYS])
_REPLIES = pa.schema([("batch", pa.string()), ("bucket", pa.int32()), ("n", pa.int32()), ("values", pa.binary())])
START, END = np.uint64(0x5E17E5CE_0000_0001), np.uint64(0x5E17E5CE_0000_0002)
_A, _B, _C = (np.uint64(x) for x in (0x9FB21C651E98DF25, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def key2(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return W.mix(a * _A + b * _B)


def key3(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return W.mix(a * _A + b * _B + c * _C)


def sequence(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes with two starts before and an end after each text that has words; the places to be
    predicted (words and ends), and the number of words of each text."""
    found = W.find(texts)
    h, counts = W.hashes(found), found.counts()
    full = counts > 0
    at = np.append(0, np.cumsum(np.where(full, counts + 3, 0)))
    out = np.full(at[-1], START, np.uint64)
    doc = found.doc_of()
    out[at[doc] + 2 + np.arange(len(h)) - found.first[doc]] = h
    out[at[1:][full] - 1] = END
    predicted = np.ones(at[-1], bool)
    predicted[at[:-1][full]] = False
    predicted[at[:-1][full] + 1] = False
    return out, np.flatnonzero(predicted), counts


def pack(x: np.ndarray) -> bytes:
    data = planes(x)
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def unpack(data: bytes, n: int) -> np.ndarray:
    return unplanes(pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True), n)


def _sent(keys: np.ndarray) -> dict:
    return {"n": len(keys), "low": int(keys[0].astype(np.int64)), "keys": pack(np.diff(keys, prepend=keys[:1]))}


def _got(row: dict) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumsum(unpack(row["keys"], row["n"]), dtype=np.uint64) + np.int64(row["low"]).astype(np.uint64)


def _summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sums of their rows of values."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    cut = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[cut], np.add.reduceat(values[order], cut, axis=0)


def _classes(c: np.ndarray) -> np.ndarray:
    """Whether each count is 1, 2, or more."""
    return np.column_stack([c == 1, c == 2, c > 2]).astype(np.int64)


def _wide(c: np.ndarray, place: int) -> np.ndarray:
    """COLUMNS, all 0 but one."""
    out = np.zeros((len(c), COLUMNS), np.int64)
    out[:, place] = c
    return out


def _grams(n: int, turn: int, turns: int):
    """Each block's distinct trigrams and their counts, dealt by a hash of their last two words; of those hashes, one in
    ``turns``."""

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.merged_blocks(batches, 4 * W.PIECE):
            x, at, _ = sequence(batch.column("text"))
            two = key2(x[at - 1], x[at])
            at = at[two % np.uint64(turns) == turn]
            _, one, c = np.unique(key3(x[at - 2], x[at - 1], x[at]), return_index=True, return_counts=True)
            at = at[one]
            two = key2(x[at - 1], x[at])
            order = np.argsort(two)
            at, c, cut = at[order], c[order], W.cuts(two[order], n)
            rows = []
            for b in np.flatnonzero(np.diff(cut)):
                here = at[cut[b] : cut[b + 1]]
                words, which = np.unique(np.concatenate([x[here - 2], x[here - 1], x[here]]), return_inverse=True)
                u, v, w = which.reshape(3, -1)
                order = np.lexsort((u, w, v))
                which = np.concatenate([u[order], np.diff(v[order], prepend=0), w[order]])
                rows.append({"bucket": int(b), **_sent(words), "m": len(here), "which": pack(which), "c": pack(c[cut[b] : cut[b + 1]][order])})
            yield pa.RecordBatch.from_pylist(rows, schema=_GRAMS)

    return grams


def _dealt(levels: list[np.ndarray], n: int) -> Iterator[tuple[int, int, slice]]:
    """(level, bucket, where) of the parts of each level's sorted keys; a level has n buckets."""
    for level, keys in enumerate(levels):
        cut = W.cuts(keys, n)
        for b in np.flatnonzero(np.diff(cut)):
            yield level, level * n + int(b), slice(cut[b], cut[b + 1])


def _facts(n: int):
    """What the trigrams of one bucket, which has all of their copies, tell of n-grams and contexts, dealt by those."""

    def facts(table: pa.Table) -> pa.Table:
        parts, counts = [], []
        for r in table.to_pylist():
            which = unpack(r["which"], 3 * r["m"]).astype(np.int64).reshape(3, r["m"])
            which[1] = np.cumsum(which[1])
            parts.append(_got(r)[which])
            counts.append(unpack(r["c"], r["m"]).astype(np.int64))
        x, c = np.concatenate(parts, axis=1), np.concatenate(counts)
        three, one, same = np.unique(key3(*x), return_index=True, return_inverse=True)
        (u, v, w), c = x[:, one], np.bincount(same, c).astype(np.int64)
        two, one, left = np.unique(key2(v, w), return_index=True, return_counts=True)
        context = lambda c: np.column_stack([np.zeros_like(c), c, _classes(c)])
        pairs = _summed(np.append(two, key2(u, v)), np.concatenate([_wide(left, 0), context(c)]))
        words = _summed(np.append(w[one], v[one]), np.concatenate([_wide(np.ones_like(left), 0), context(left)]))
        told = [words, pairs, (three, c[:, None])]
        rows = [{"bucket": b, **_sent(told[k][0][at]), "values": pack(told[k][1][at].T.ravel())} for k, b, at in _dealt([t[0] for t in told], n)]
        return pa.Table.from_pylist(rows, schema=_FACTS)

    return facts


def _values(row: dict, columns: int) -> np.ndarray:
    return unpack(row["values"], columns * row["n"]).astype(np.int64).reshape(columns, row["n"]).T


def _held(rows: list[dict], columns: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys of some rows, in order, and their sums."""
    if not rows:
        return np.zeros(0, np.uint64), np.zeros((0, columns), np.int64)
    return _summed(np.concatenate([_got(r) for r in rows]), np.concatenate([_values(r, columns) for r in rows]))


def _merge(n: int):
    """One row a bucket: its n-grams with their sums, and how many have a first value of 1, 2, 3, 4, any, and its sum."""

    def merge(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        keys, values = _held(rows, COLUMNS if rows[0]["bucket"] < 2 * n else 1)
        c = values[:, 0]
        told = [*(int((c == k).sum()) for k in (1, 2, 3, 4)), int((c > 0).sum()), int(c.sum())]
        return pa.Table.from_pylist([{"bucket": rows[0]["bucket"], **_sent(keys), "values": pack(values.T.ravel()), "told": told}], schema=_COUNTS)

    return merge


def _discounts(told: list[int]) -> np.ndarray:
    """D1, D2 and D3+ of a level, from its numbers of counts 1 to 4."""
    n1, n2, n3, n4 = told[:4]
    if not (n1 and n2 and n3):
        return np.array([0.5, 1.0, 1.5])
    y = n1 / (n1 + 2 * n2)
    return np.clip([1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3], 0.05, (0.95, 1.95, 2.95))


class Formula:
    """The model's numbers that belong to no n-gram, and its probabilities from n-grams' counts."""

    def __init__(self, told: dict[int, list[int]]):
        self.less = [_discounts(told[k]) if k in told else np.zeros(3) for k in range(3)]
        n1, n2, _, _, self.kinds, self.total = told.get(0, [0] * 6)
        #: The share of each word, and of one more that stands for unknown ones.
        self.even = self.less[0] @ [n1, n2, self.kinds - n1 - n2] / self.total / (self.kinds + 1) if self.kinds else 1.0

    def _own(self, level: int, c: np.ndarray, total: np.ndarray | int) -> np.ndarray:
        return np.where(c > 0, c - self.less[level][np.clip(c, 1, 3) - 1], 0) / np.maximum(total, 1)

    def _back(self, level: int, context: np.ndarray) -> np.ndarray:
        return np.where(context[:, 1] > 0, context[:, 2:] @ self.less[level] / np.maximum(context[:, 1], 1), 1.0)

    def logs(self, levels: list[np.ndarray], names: list[np.ndarray]) -> np.ndarray:
        """log10 P of words; names: the rows of levels (words, pairs, trigrams) that are the word, the one before it, the
        pair that it ends, the pair before it, and the trigram."""
        w, v, vw, uv, uvw = names
        p = self._own(0, levels[0][:, 0], self.total)[w] + self.even
        b2, b3 = self._back(1, levels[0]), self._back(2, levels[1])
        p = self._own(1, levels[1][vw, 0], levels[0][v, 1]) + b2[v] * p
        return np.log10(self._own(2, levels[2][uvw, 0], levels[1][uv, 1]) + b3[uv] * p)


def names(x: np.ndarray, at: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The distinct words, pairs and trigrams in order of hash that predicting the places at takes, and where each place
    finds its own among them (see Formula.logs)."""
    words, w = np.unique(x, return_inverse=True)
    used = np.zeros(len(x), bool)
    used[at], used[at - 1] = True, True
    ends = np.flatnonzero(used)
    number = np.cumsum(used) - 1
    pairs, p = np.unique(key2(x[ends - 1], x[ends]), return_inverse=True)
    three, t = np.unique(key3(x[at - 2], x[at - 1], x[at]), return_inverse=True)
    return [words, pairs, three], [w[at], w[at - 1], p[number[at]], p[number[at - 1]], t]


class Model:
    """Counts of all n-grams, dealt by their hashes: a table with a row or a few for each bucket, n buckets a level."""

    def __init__(self, counts: DataFrame, n: int):
        self.counts, self.n, self._here = counts, n, None
        words = counts.where(F.col("bucket") < n).groupBy("bucket").applyInArrow(_merge(n), _COUNTS_DDL)  # whole only over all turns
        level = F.floor(F.col("bucket") / n).cast("int").alias("level")
        told = words.unionByName(counts.where(F.col("bucket") >= n)).groupBy(level).agg(*[F.sum(F.col("told")[k]).alias(f"t{k}") for k in range(6)]).collect()
        self.formula = Formula({r["level"]: [r[f"t{k}"] for k in range(6)] for r in told})

    def score(self, x: np.ndarray, at: np.ndarray) -> np.ndarray:
        """log10 P(x[i] | x[i-2], x[i-1]) for each i of at; reads all counts into this process: for small tables."""
        if self._here is None:
            rows = self.counts.toArrow().to_pylist()
            self._here = [_held([r for r in rows if r["bucket"] // self.n == k], COLUMNS if k < 2 else 1) for k in range(3)]
        levels, where = names(x, at)
        return self.formula.logs([_found(*here, keys) for here, keys in zip(self._here, levels, strict=True)], where)


def _found(have: np.ndarray, values: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The values of keys among those that are held; 0 where there are none."""
    out = np.zeros((len(keys), values.shape[1]), np.int64)
    if len(have):
        at = np.minimum(np.searchsorted(have, keys), len(have) - 1)
        same = have[at] == keys
        out[same] = values[at[same]]
    return out


def counted(texts: DataFrame) -> Model:
    """A model of all texts.  Trigrams are dealt by their last two words, where their copies meet; what they tell of words,
    pairs and trigrams is dealt by those and added up.  Their hashes take turns, which bounds what is shuffled at once."""
    n = partitions(texts.sparkSession)
    rows = texts.select(F.col("text").cast("string").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0  # files of texts are smaller than texts, by far where these repeat
    turns = min(TURNS, 1 + size // TURN_BYTES)
    parts = []
    for k in range(turns):
        facts = rows.mapInArrow(_grams(n, k, turns), _GRAMS_DDL).groupBy("bucket").applyInArrow(_facts(n), _FACTS_DDL)
        parts.append(facts.groupBy("bucket").applyInArrow(_merge(n), _COUNTS_DDL))
    return Model(stored_buckets(parts, "quality_counts", "bucket", n), n)


def train(texts: DataFrame) -> Model | None:
    """A model of the column text; None where there is no word."""
    model = counted(texts)
    return model if model.formula.kinds else None


SCORES = "doc_id bigint, lang string, n_words bigint, log10_prob double, worst double, repeats bigint"


def most(total: np.ndarray, first: np.ndarray, span: int = SPAN) -> np.ndarray:
    """The largest sum of ``span`` values in a row, or of all where they are fewer, of each text at offsets ``first``;
    total is the values' running sum.  0 for texts without values."""
    out = np.zeros(len(first) - 1, total.dtype)
    sizes = np.diff(first)
    if (full := sizes > 0).any():
        start = np.arange(first[-1])
        stop = np.minimum(start + span, np.repeat(first[1:], sizes))  # the shorter sums at a text's end ...
        sums = total[stop] - total[np.maximum(stop - span, np.repeat(first[:-1], sizes))]  # ... become those of its last span
        out[full] = np.maximum.reduceat(sums, first[:-1][full])
    return out


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in W.merged_blocks(batches):
        whole = pa.array([0, batch.num_rows], pa.int32())
        lists = [pa.ListArray.from_arrays(whole, c) for c in (pa.array(W.long_ids(batch.column("doc_id"))), batch.column("lang").cast(pa.string()), batch.column("text").cast(pa.string()))]
        yield pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().hex]), *lists], names=["batch", "ids", "langs", "texts"])


def _ask(n: int):
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                x, at, _ = sequence(batch.column("texts")[i].values)
                levels, _ = names(x, at)
                rows = [{"bucket": b, "batch": batch.column("batch")[i].as_py(), **_sent(levels[k][part])} for k, b, part in _dealt(levels, n)]
                yield pa.RecordBatch.from_pylist(rows, schema=_ASKED)

    return ask


def _reply(n: int):
    """For each batch that asks a bucket, what the bucket has for its keys."""

    def reply(asked: pa.Table, counts: pa.Table) -> pa.Table:
        rows, out = asked.to_pylist(), []
        if not rows:
            return pa.Table.from_pylist([], schema=_REPLIES)
        have = _held(counts.to_pylist(), COLUMNS if rows[0]["bucket"] < 2 * n else 1)
        for r in rows:
            values = _found(*have, _got(r))
            out.append({"batch": r["batch"], "bucket": r["bucket"], "n": r["n"], "values": pack(values.T.ravel())})
        return pa.Table.from_pylist(out, schema=_REPLIES)

    return reply


def _score(formula: Formula, n: int):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                x, at, counts = sequence(batch.column("texts")[i].values)
                levels, where = names(x, at)
                replies = sorted(batch.column("replies")[i].as_py() or [], key=lambda r: r["bucket"])
                values = []
                for k in range(3):
                    mine = [_values(r, COLUMNS if k < 2 else 1) for r in replies if r["bucket"] // n == k]
                    values.append(np.concatenate(mine) if mine else np.zeros((0, COLUMNS if k < 2 else 1), np.int64))
                total = np.zeros(len(at) + 1)
                np.cumsum(formula.logs(values, where), out=total[1:])
                first = np.append(0, np.cumsum(np.where(counts > 0, counts + 1, 0)))
                again = np.append(0, np.cumsum(x[at] == x[at - 1]))
                yield pa.RecordBatch.from_arrays([W.ids_out(batch.column("ids")[i].values.to_numpy(zero_copy_only=False)), batch.column("langs")[i].values, pa.array(counts),
                                                  pa.array(np.diff(total[first])), pa.array(-most(-total, first)), pa.array(most(again, first))],
                                                 names=["doc_id", "lang", "n_words", "log10_prob", "worst", "repeats"])

    return score


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Per row of (doc_id, text, lang): doc_id, lang, n_words, log10_prob (of its words and its end), worst (the least of
    SPAN such in a row, or of all where they are fewer) and repeats (the most in a SPAN that are the word before).

    A batch of texts asks for its distinct words, pairs and trigrams, by hash.  Documents go through in rounds, by a hash
    of the id, so that what is asked at a time is a share of the corpus; what a round shuffled is deleted with it."""
    n = model.n
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rounds = min(ROUNDS, 1 + plan_bytes(rows) // ROUND_BYTES)
    done = []
    for k in range(rounds):
        mine = rows.where(F.pmod(F.xxhash64("doc_id", F.lit("round")), F.lit(rounds)) == k) if rounds > 1 else rows
        table = stored_buckets(mine.mapInArrow(_batches, _BATCH_DDL), "quality_texts", "batch", n)
        asked = table.select("batch", "texts").mapInArrow(_ask(n), _ASKED_DDL)
        replies = asked.groupBy("bucket").cogroup(model.counts.drop("told").groupBy("bucket")).applyInArrow(_reply(n), _REPLIES_DDL)
        each = replies.groupBy("batch").agg(F.collect_list(F.struct("bucket", "n", "values")).alias("replies"))
        done.append(stored(table.join(each.hint("shuffle_hash"), "batch", "left").mapInArrow(_score(model.formula, n), SCORES), "quality-scores"))
        release(table)
    return functools.reduce(DataFrame.unionAll, done)


def trusted_ids(labels: DataFrame) -> DataFrame:
    """(doc_id, mark, calibrates) of the trusted documents."""
    one = (labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
           .agg(F.min(F.when((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0), 1).otherwise(0)).alias("good")).where("good = 1"))
    return one.select("doc_id", F.xxhash64("doc_id", F.lit("mark")).alias("mark"), (F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(4)) == 0).alias("calibrates"))


def chosen(docs: DataFrame, trusted: DataFrame, most_docs: int | None = None, most_words: int | None = None) -> DataFrame:
    """(doc_id, text) of the trusted documents that train: whole texts, all of them unless the caller sets a bound.  Under
    a bound of words, a text of more than a LONGEST-th of it does not train, so that no single one ends the sample; it
    calibrates like others outside."""
    words = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))
    first = trusted.where(~F.col("calibrates")).select("doc_id", "mark")
    if most_docs is not None:
        first = first.orderBy("mark", "doc_id").limit(most_docs)
    texts = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    few = first.limit(FEW + 1).count() <= FEW
    rows = texts.join(F.broadcast(first) if few else first, "doc_id").dropDuplicates(["doc_id", "text"])
    if most_words is None:
        return stored(rows.select("doc_id", "text"), "quality-training")
    rows = stored(rows.withColumn("size", words).where(F.col("size") <= most_words // LONGEST), "quality-training")
    order = Window.partitionBy(F.lit(0)).orderBy("mark", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)  # within a bound that the caller sets
    within = rows.select("doc_id", "mark", "size").withColumn("upto", F.sum("size").over(order)).where(F.col("upto") <= most_words)
    return rows.join(within.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "text")


def sample(docs: DataFrame, trusted: DataFrame, most_docs: int | None = None, most_words: int | None = None) -> DataFrame:
    """(text) of the documents that train."""
    return chosen(docs, trusted, most_docs, most_words).select("text")


def classify(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, most_docs: int | None = None, most_words: int | None = None) -> DataFrame:
    """Per row of docs: doc_id, lang, n_words, log10_prob, perplexity, threshold (a perplexity) and keep."""
    spark = docs.sparkSession
    trusted = stored(trusted_ids(labels), "quality-trusted")
    with shuffles_deleted(spark):
        learnt = chosen(docs, trusted, most_docs, most_words)
        model = counted(learnt)
        if most_docs is None and most_words is None:
            calibrating = trusted.where("calibrates")
            release(learnt)
        else:
            calibrating = trusted.join(learnt.select("doc_id").distinct(), "doc_id", "left_anti")
        scored = score(docs, model).withColumn("mean", F.col("log10_prob") / (F.col("n_words") + 1))
        release(model.counts)
    known = scored.where("n_words > 0").join(calibrating.select("doc_id"), "doc_id", "left_semi").select("lang", "n_words", "mean", "log10_prob", "worst", "repeats")
    usual = known.groupBy("lang").agg(F.avg("mean").alias("usual"), F.count(F.lit(1)).alias("n"))
    everywhere = known.agg(F.avg("mean")).first()[0]
    centre = F.coalesce((F.col("n") * F.col("usual") + everywhere) / (F.col("n") + 1), F.lit(everywhere), F.lit(0.0)) if everywhere is not None else F.lit(0.0)
    shrunk = lambda x, n: (F.col(x) + PRIOR * F.col("usual")) / (n + PRIOR)
    judged = lambda df: (df.withColumn("usual", centre).withColumn("shrunk", shrunk("log10_prob", F.col("n_words") + 1))
                         .withColumn("low", shrunk("worst", F.least(F.col("n_words") + 1, F.lit(SPAN)))))
    same = lambda a, b: a.join(b.withColumnRenamed("lang", "name"), F.col("lang").eqNullSafe(F.col("name")), "left").drop("name")
    centred = judged(same(known, usual))
    beyond = {"cut": F.percentile_approx(F.col("shrunk") - F.col("usual"), quantile / 3, 10_000),
              "low_cut": F.percentile_approx(F.col("low") - F.col("usual"), quantile / 3, 10_000),
              "most_repeats": F.percentile_approx("repeats", 1 - quantile / 3, 10_000)}
    cuts = centred.groupBy("lang").agg(*[x.alias(k) for k, x in beyond.items()])
    overall = centred.agg(*[x.alias(k) for k, x in beyond.items()]).first()
    told = judged(same(same(scored, usual), cuts))
    for k, none, base in (("cut", -1e9, F.col("usual")), ("low_cut", -1e9, F.col("usual")), ("most_repeats", 1e9, F.lit(0))):
        own = (F.col("n") * F.col(k) + LEAST * F.lit(overall[k])) / (F.col("n") + LEAST)
        told = told.withColumn(k, F.coalesce(base + F.coalesce(own, F.lit(overall[k])), F.lit(none)))
    worded = F.col("n_words") > 0
    good = (F.col("shrunk") >= F.col("cut")) & (F.col("low") >= F.col("low_cut")) & (F.col("repeats") <= F.col("most_repeats"))
    return told.select("doc_id", "lang", "n_words", F.when(worded, F.col("log10_prob")).alias("log10_prob"), F.when(worded, F.pow(F.lit(10.0), -F.col("mean"))).alias("perplexity"),
                       F.pow(F.lit(10.0), F.least(-F.col("cut"), F.lit(300.0))).alias("threshold"), (worded & good).alias("keep"))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
