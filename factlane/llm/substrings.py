"""Substring dedup by level-wise doubling.

Documents are packed into batches of about 4 MB, written once and bucketed by batch.  A level looks at
windows of one length.  Every batch sends each *distinct* window hash once, dealt by hash range, and
gets back bits for the entries it sent: does the window occur in two documents, and is the batch's
smallest doc_id the smallest of all.  So a window that a third of all documents share moves as one
entry per batch, never as a row per document, and no text leaves its batch.

Levels: the first length is half the wanted one (a filter: 40 bits of hash are enough, as a false
repeat only costs work), then the wanted length, then its doublings.  From the wanted length on, windows are compared by
96 bits of hash.  A window is a candidate at a level only if all windows of the level before that it covers repeat;
so after a level what is left of a document are stretches of words, whose hashes are stored for the next level, and no
text is read again.  The doubling ends at ``longest`` words or, where that is None, when no stretch is left.

Removed are the words covered by a window of ``size`` words that also starts in a document with a
smaller doc_id, judged on the input.

Texts of any length are judged whole.  A null text has no words.  A null doc_id counts as larger than any other.  Rows that repeat a doc_id are
judged like other documents, and never remove each other.  Other columns are carried along.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W
from .storage import partitions, plan_bytes, release, stored, stored_buckets

SIZE = 13
_ADDED = ("n_words", "n_removed", "kept", "longest_repeat")
ENTRIES = "bucket int, batch string, level int, n int, low bigint, base bigint, keys binary, checks binary, ids binary, local binary"
REPLIES = "batch string, level int, bucket int, n int, again binary, later binary"
_ENTRIES = pa.schema([("bucket", pa.int32()), ("batch", pa.string()), ("level", pa.int32()), ("n", pa.int32()), ("low", pa.int64()),
                      ("base", pa.int64()), ("keys", pa.binary()), ("checks", pa.binary()), ("ids", pa.binary()), ("local", pa.binary())])
STRETCHES = "batch string, reached array<int>, docs array<int>, ids array<bigint>, sizes array<int>, hashes binary"
_STRETCHES = pa.schema([("batch", pa.string()), ("reached", pa.list_(pa.int32())), ("docs", pa.list_(pa.int32())), ("ids", pa.list_(pa.int64())),
                        ("sizes", pa.list_(pa.int32())), ("hashes", pa.binary())])
_REPLIES = pa.schema([("batch", pa.string()), ("level", pa.int32()), ("bucket", pa.int32()), ("n", pa.int32()),
                      ("again", pa.binary()), ("later", pa.binary())])


def lengths(size: int) -> list[int]:
    """The window lengths of the levels that read text: half of size (where that tells something), and size."""
    return [(size + 1) // 2, size] if size > 3 else [size]


def planes(x: np.ndarray) -> bytes:
    """Byte planes of unsigned numbers, 4 bytes wide where they fit: high planes are mostly zero and compress away."""
    wide = np.uint64 if len(x) and x.max() >= 2**32 else np.uint32
    return x.astype(wide).view(np.uint8).reshape(len(x), -1).T.tobytes()


def unplanes(data: bytes, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, np.uint64)
    raw = np.frombuffer(data, np.uint8).reshape(-1, n).T
    return np.ascontiguousarray(raw).view(np.uint32 if raw.shape[1] == 4 else np.uint64).ravel().astype(np.uint64)


def bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def unbits(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=n).astype(bool)


class Windows:
    """The candidate windows of one batch at one level, as distinct classes in hash order."""

    def __init__(self, starts: np.ndarray, keys: np.ndarray, checks: np.ndarray | None, ids: np.ndarray):
        """ids: the doc_id of each window; windows come in ascending order of doc_id."""
        self.starts, self.window_ids = starts, ids
        order = np.argsort(keys, kind="stable")
        k = keys[order]
        if checks is None:
            new = np.append(True, k[1:] != k[:-1]) if len(k) else np.zeros(0, bool)
        else:
            c = checks[order]
            same = k[1:] == k[:-1]
            if np.any(same & (c[1:] != c[:-1])):
                order = np.lexsort((checks, keys))
                k, c = keys[order], checks[order]
                same = k[1:] == k[:-1]
            new = np.append(True, ~(same & (c[1:] == c[:-1]))) if len(k) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        self.of = np.empty(len(keys), np.int64)
        self.of[order] = group
        self.keys = k[first]
        self.checks = None if checks is None else c[first]
        sorted_ids = ids[order]
        self.least = sorted_ids[first]
        last = np.append(first[1:], len(k)) - 1
        self.local = sorted_ids[last] != self.least if len(first) else np.zeros(0, bool)

    def entries(self, batch: str, level: int, n_buckets: int, width: int) -> Iterator[dict]:
        cut = W.cuts(self.keys, n_buckets, width)
        for b in np.flatnonzero(np.diff(cut)):
            a, z = cut[b], cut[b + 1]
            keys = self.keys[a:z]
            base = int(self.least[a:z].min())
            yield {"bucket": int(b), "batch": batch, "level": level, "n": int(z - a), "low": int(keys[0].astype(np.int64)), "base": base,
                   "keys": planes(np.diff(keys, prepend=keys[:1])),
                   "checks": None if self.checks is None else planes(self.checks[a:z]),
                   "ids": None if self.checks is None else planes(self.least[a:z].astype(np.uint64) - np.uint64(base & (2**64 - 1))),
                   "local": bits(self.local[a:z])}


def _matches(rows: list[dict]) -> Iterator[dict]:
    """The replies to the entries of one bucket."""
    n = np.array([r["n"] for r in rows])
    with np.errstate(over="ignore"):
        keys = np.concatenate([np.cumsum(unplanes(r["keys"], r["n"]), dtype=np.uint64) + np.int64(r["low"]).astype(np.uint64) for r in rows])
    local = np.concatenate([unbits(r["local"], r["n"]) for r in rows])
    exact = rows[0]["checks"] is not None
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    same = k[1:] == k[:-1]
    if exact:
        checks = np.concatenate([unplanes(r["checks"], r["n"]) for r in rows])
        with np.errstate(over="ignore"):
            ids = np.concatenate([(unplanes(r["ids"], r["n"]) + np.int64(r["base"]).astype(np.uint64)).view(np.int64) for r in rows])
        c = checks[order]
        if np.any(same & (c[1:] != c[:-1])):
            order = np.lexsort((checks, keys))
            k, c = keys[order], checks[order]
            same = k[1:] == k[:-1]
        same &= c[1:] == c[:-1]
    first = np.flatnonzero(np.append(True, ~same))
    group = np.cumsum(np.append(True, ~same)) - 1
    again = np.logical_or.reduceat(local[order], first)
    later = None
    if exact:
        least = np.minimum.reduceat(ids[order], first)
        again |= np.maximum.reduceat(ids[order], first) != least
        later = np.empty(len(k), bool)
        later[order] = least[group] < ids[order]
    else:
        again |= np.diff(np.append(first, len(k))) > 1
    each = np.empty(len(k), bool)
    each[order] = again[group]
    at = np.append(0, np.cumsum(n))
    for r, a, z in zip(rows, at[:-1], at[1:], strict=True):
        yield {"batch": r["batch"], "level": r["level"], "bucket": r["bucket"], "n": r["n"], "again": bits(each[a:z]),
               "later": None if later is None else bits(later[a:z])}


class Batch:
    """One packed batch: its words, and the windows of the levels that read text."""

    def __init__(self, ids: np.ndarray, texts: pa.Array, size: int):
        self.found = W.find(texts)
        self.hash = W.hashes(self.found)
        self.ids = ids
        self.size = size
        self.word_ids = np.repeat(ids, self.found.counts())

    def level(self, k: int, replies: dict[int, list[dict]]) -> tuple[Windows, int, int]:
        """The candidate windows at level k; needs the replies to the levels before it."""
        previous = None
        for at, length in enumerate(lengths(self.size)):
            exact = length >= self.size
            starts = W.window_starts(self.found.first, length if exact else self.size)
            if previous is not None:
                starts = starts[previous[0][starts] & previous[0][starts + length - previous[1]]]
            elif not exact:  # the filter looks at all windows inside documents of the wanted size
                starts = W.window_starts(self.found.first, length)
                long_enough = np.repeat(self.found.counts() >= self.size, self.found.counts())
                starts = starts[long_enough[starts]]
            keys = W.windows(self.hash, length)[starts]
            checks = W.windows(self.hash, length, 1)[starts] >> np.uint64(32) if exact else None
            windows = Windows(starts, keys if exact else keys >> np.uint64(24), checks, self.word_ids[starts])
            if at == k:
                return windows, length, 64 if exact else 40
            again = self.answer(windows, replies.get(at, []), "again")
            repeated = np.zeros(len(self.hash) + length, bool)
            repeated[starts] = again[windows.of]
            previous = (repeated, length)
        raise AssertionError

    @staticmethod
    def answer(windows: Windows, replies: list[dict], which: str) -> np.ndarray:
        """The bits of one level for each class, in hash order."""
        if not len(windows.keys):
            return np.zeros(0, bool)
        return np.concatenate([unbits(r[which], r["n"]) for r in sorted(replies, key=lambda r: r["bucket"])])


def _pack(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in W.merged_blocks(batches, size):
        ids = W.long_ids(batch.column("doc_id"))
        batch = batch.take(pa.array(np.argsort(ids, kind="stable")))
        whole = pa.array([0, batch.num_rows], pa.int32())
        other = batch.column("rest")
        yield pa.RecordBatch.from_arrays(
            [pa.array([uuid.uuid4().hex]), pa.ListArray.from_arrays(whole, pa.array(np.sort(ids))),
             pa.ListArray.from_arrays(whole, batch.column("text").cast(pa.string())), pa.ListArray.from_arrays(whole, other)],
            names=["batch", "ids", "texts", "rest"])


def _by_level(row: list[dict] | None) -> dict[int, list[dict]]:
    out: dict[int, list[dict]] = {}
    for r in row or []:
        out.setdefault(r["level"], []).append(r)
    return out


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, np.ndarray, pa.Array, pa.Array, dict]]:
    for batch in batches:
        for i in range(batch.num_rows):
            replies = _by_level(batch.column("replies")[i].as_py()) if "replies" in batch.schema.names else {}
            rest = batch.column("rest")[i].values if "rest" in batch.schema.names else None
            yield batch.column("batch")[i].as_py(), batch.column("ids")[i].values.to_numpy(zero_copy_only=False), batch.column("texts")[i].values, rest, replies


def stretches(again: np.ndarray, doc: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, size) of the longest stretches of words of one document in which every window of ``length`` repeats, where they
    hold one of twice the length; again: for each word whether the window that starts there repeats."""
    at = np.flatnonzero(again)
    if not len(at):
        return at, at
    cut = np.flatnonzero(np.append(True, (at[1:] != at[:-1] + 1) | (doc[at[1:]] != doc[at[:-1]])))
    first, size = at[cut], at[np.append(cut[1:], len(at)) - 1] - at[cut] + length
    return first[size >= 2 * length], size[size >= 2 * length]


def _stretch_row(name: str, again: np.ndarray, doc: np.ndarray, ids: np.ndarray, hashes: np.ndarray, length: int) -> dict | None:
    """again, doc and hashes: of each word; ids: of each document."""
    first, size = stretches(again, doc, length)
    reached = np.unique(doc[again])
    if not len(reached):
        return None
    begin = np.append(0, np.cumsum(size))
    place = np.repeat(first - begin[:-1], size) + np.arange(begin[-1])
    return {"batch": name, "reached": reached.tolist(), "docs": doc[first].tolist(), "ids": ids[doc[first]].tolist(), "sizes": size.tolist(), "hashes": hashes[place].tobytes()}


def _from_text(size: int):
    """The stretches that the level of ``size`` leaves of each batch."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, ids, texts, _, replies in _rows(batches):
            batch = Batch(ids, texts, size)
            windows, _, _ = batch.level(len(lengths(size)) - 1, replies)
            again = np.zeros(len(batch.hash), bool)
            again[windows.starts[batch.answer(windows, replies.get(len(lengths(size)) - 1, []), "again")[windows.of]]] = True
            if row := _stretch_row(name, again, batch.found.doc_of(), ids, batch.hash, size):
                yield pa.RecordBatch.from_pylist([row], schema=_STRETCHES)

    return cut


def _windows(row: dict, length: int) -> tuple[Windows, np.ndarray, np.ndarray]:
    """The windows of a batch's stretches, the stretches' word hashes, and the place in docs and ids of each word."""
    hashes = np.frombuffer(row["hashes"], np.uint64)
    sizes = np.array(row["sizes"], np.int64)
    starts = W.window_starts(np.append(0, np.cumsum(sizes)), length)
    part = np.repeat(np.arange(len(sizes)), sizes)
    checks = W.windows(hashes, length, 1)[starts] >> np.uint64(32)
    return Windows(starts, W.windows(hashes, length)[starts], checks, np.array(row["ids"], np.int64)[part][starts]), hashes, part


def _from_stretches(length: int):
    """The stretches that the level of ``length`` leaves of those it looked at."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                windows, hashes, part = _windows(row, length)
                again = np.zeros(len(hashes), bool)
                again[windows.starts[Batch.answer(windows, row["replies"] or [], "again")[windows.of]]] = True
                # stretches of one document never touch, but may follow each other here: told apart by their number
                if made := _stretch_row(row["batch"], again, part, np.array(row["ids"], np.int64), hashes, length):
                    docs = np.array(row["docs"])
                    made |= {"reached": np.unique(docs[made["reached"]]).tolist(), "docs": docs[made["docs"]].tolist()}
                    yield pa.RecordBatch.from_pylist([made], schema=_STRETCHES)

    return cut


def _stretch_sender(length: int, level: int, n_buckets: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                rows = list(_windows(row, length)[0].entries(row["batch"], level, n_buckets, 64))
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=_ENTRIES)

    return send


def dedup_substrings(docs: DataFrame, size: int = SIZE, longest: int | None = None, batch_bytes: int | None = None) -> DataFrame:
    """docs' columns, then n_words, n_removed, kept (the kept words, joined by one space) and longest_repeat
    (words of the longest window length, of size and its doublings, at which a window of the document repeats; 0: none), which
    replace columns of these names.  batch_bytes: text in a batch; where it is None, more for larger corpora."""
    spark = docs.sparkSession
    n = partitions(spark)
    names = [c for c in docs.columns if c not in ("doc_id", "text", *_ADDED)]
    others = [F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(names)]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                       F.struct(F.lit(0).alias("none"), *others).alias("rest"))
    batch_bytes = batch_bytes or W.batch_size(plan_bytes(rows))
    rest = rows.schema["rest"].dataType
    packed = T.StructType([T.StructField("batch", T.StringType()), T.StructField("ids", T.ArrayType(T.LongType())),
                           T.StructField("texts", T.ArrayType(T.StringType())), T.StructField("rest", T.ArrayType(rest))])
    table = stored_buckets(rows.mapInArrow(lambda b: _pack(b, batch_bytes), packed), "substrings", "batch", n)
    batches = table.count()
    n_buckets = W.bucket_count(n, batches, batch_bytes)
    replies: DataFrame | None = None
    for k in range(len(lengths(size))):
        sent = _with(table.select("batch", "ids", "texts"), replies).mapInArrow(_sender(size, k, n_buckets), ENTRIES)
        level = stored(sent.groupBy("bucket").applyInArrow(_answer, REPLIES), f"substrings-level{k}")
        replies = level if replies is None else replies.unionByName(level)
    length, level, reached = size, len(lengths(size)), []
    left = stored(_with(table.select("batch", "ids", "texts"), replies).mapInArrow(_from_text(size), STRETCHES), "substrings-stretches")
    while True:
        reached.append(left.select("batch", F.lit(length).alias("length"), "reached"))
        words = left.agg(F.sum(F.length("hashes") / 8)).first()[0] or 0
        length *= 2
        if not words or (longest is not None and length > longest):
            break
        some = max(n, min(n_buckets, int(words // (batches * W.ROW_ENTRIES))))
        looked = left.where(F.size("docs") > 0)
        told = stored(looked.mapInArrow(_stretch_sender(length, level, some), ENTRIES).groupBy("bucket").applyInArrow(_answer, REPLIES), "substrings-doubled")
        mine = told.groupBy("batch").agg(F.collect_list(F.struct("bucket", "n", "again")).alias("replies"))
        left = stored(looked.join(mine.hint("shuffle_hash"), "batch").mapInArrow(_from_stretches(length), STRETCHES), "substrings-stretches")
        release(told)
        level += 1
    whole = reached[0]
    for part in reached[1:]:
        whole = whole.unionByName(part)
    whole = whole.groupBy("batch").agg(F.collect_list(F.struct("length", "reached")).alias("reached"))
    out = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("rest", rest),
                        T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()),
                        T.StructField("kept", T.StringType()), T.StructField("longest_repeat", T.LongType())])
    done = _with(table, replies).join(whole.hint("shuffle_hash"), "batch", "left").mapInArrow(_finisher(size), out)
    held = [F.col(c) if c in ("doc_id", "text") else F.col("rest").getField(f"c{names.index(c)}").alias(c) for c in docs.columns if c not in _ADDED]
    return done.select(*held, *_ADDED)


def _with(table: DataFrame, replies: DataFrame | None) -> DataFrame:
    """The batches with their replies; only the replies (bits) move."""
    if replies is None:
        return table
    mine = replies.groupBy("batch").agg(F.collect_list(F.struct("level", "bucket", "n", "again", "later")).alias("replies"))
    return table.join(mine.hint("shuffle_hash"), "batch", "left")


def _sender(size: int, k: int, n_buckets: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, ids, texts, _, replies in _rows(batches):
            windows, _, width = Batch(ids, texts, size).level(k, replies)
            rows = list(windows.entries(name, k, n_buckets, width))
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=_ENTRIES)

    return send


def _answer(table: pa.Table) -> pa.Table:
    return pa.Table.from_pylist(list(_matches(table.to_pylist())), schema=_REPLIES)


def _finisher(size: int):
    last = len(lengths(size)) - 1

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            for i, (_, ids, texts, rest, replies) in enumerate(_rows(iter([part]))):
                batch = Batch(ids, texts, size)
                first, total = batch.found.first, len(batch.hash)
                change = np.zeros(total + 1, np.int64)
                if last in replies:
                    windows, _, _ = batch.level(last, replies)
                    later = batch.answer(windows, replies[last], "later")[windows.of]
                    covered = windows.starts[later | (windows.window_ids > windows.least[windows.of])]
                    np.add.at(change, covered, 1)
                    np.add.at(change, covered + size, -1)
                reach = np.zeros(len(ids), np.int64)
                for r in part.column("reached")[i].as_py() or []:
                    reach[r["reached"]] = np.maximum(reach[r["reached"]], r["length"])
                keep = np.cumsum(change)[:total] == 0
                removed = np.diff(np.append(0, np.cumsum(~keep))[first])
                kept = []
                for j, text in enumerate(texts):
                    parts = (text.as_py() or "").encode().split()
                    kept.append(b" ".join(compress(parts, keep[first[j] : first[j + 1]].tolist()) if removed[j] else parts).decode())
                yield pa.RecordBatch.from_arrays(
                    [W.ids_out(ids), texts, rest, pa.array(np.diff(first)), pa.array(removed), pa.array(kept, pa.string()), pa.array(reach)],
                    names=["doc_id", "text", "rest", "n_words", "n_removed", "kept", "longest_repeat"])

    return finish


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_substrings(docs).select(
        "doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"), "longest_repeat")
