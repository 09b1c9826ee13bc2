"""Benchmark decontamination over a distributed positional inverted index.

``build_index`` cuts the documents into segments and stores, for each, a sorted term dictionary with
the positions of every term (one row per segment; positions of different texts never touch).
``search`` looks a benchmark's windows up in every segment: the window's rarest term of that segment
gives candidate starts (its postings less the term's offset), which are intersected with the
offset-adjusted postings of the next rarer terms until none is left.  With ``slop`` it also reports
proximity matches: runs of a document's words that hold every word of a window, in any order, and are at
most ``slop`` words longer than a whole window (a shorter window's runs in proportion).  Candidates
are the postings of the window's rarest term that have every other term near; n_near counts the words of a
document in any such run, so neither depends on segments or blocks.

Words: lower-cased A-Z, runs of digits, letters and non-ASCII characters.  A text of any length is one
posting range of its segment.  A null or empty text has no
words; a repeated row is judged like any other; a null doc_id is kept as null; items of one item_id count
as one item with the windows of all; an empty benchmark
hits nothing; an empty documents table gives an empty result.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W
from .storage import stored

WINDOW = 10
SLOP = 5
#: Bytes of benchmark text held at once by the driver and by each task; more is searched block by block.
BLOCK_BYTES = 8 << 20

INDEX = ("doc_ids array<bigint>, digests array<bigint>, n_words array<int>, terms binary, counts binary, postings binary")
HITS = "doc_id bigint, digest bigint, n_words bigint, n_hit bigint, spans binary, items array<string>, n_near bigint, near_spans binary"


def _segment(batch: pa.RecordBatch) -> dict:
    found = W.find(batch.column("text"), W.ALNUM, lower=True)
    ids = W.long_ids(batch.column("doc_id"))
    h = W.hashes(found)
    position = (np.arange(len(h)) + found.doc_of()).astype(np.uint32)  # one free position between texts
    order = np.argsort(h, kind="stable")
    h, position = h[order], position[order]
    fresh = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)
    return {"doc_ids": ids, "n_words": found.counts().astype(np.int32), "terms": h[fresh].tobytes(),
            "counts": np.diff(np.append(fresh, len(h))).astype(np.uint32).tobytes(),
            "postings": position.view(np.uint8).reshape(-1, 4).T.tobytes()}  # byte planes compress better


def build_index(docs: DataFrame) -> DataFrame:
    """The stored segments of (doc_id, text); a document is told from others of its doc_id by a digest of the text."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.merged_blocks(batches):
            s = _segment(batch)
            yield pa.RecordBatch.from_arrays(
                [pa.array([s["doc_ids"]], pa.list_(pa.int64())), pa.array([batch.column("digest").to_numpy()], pa.list_(pa.int64())), pa.array([s["n_words"]], pa.list_(pa.int32())),
                 *(pa.array([s[k]], pa.binary()) for k in ("terms", "counts", "postings"))],
                names=["doc_ids", "digests", "n_words", "terms", "counts", "postings"])

    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("digest"))
    return stored(rows.mapInArrow(pack, INDEX), "postings")


class Block:
    """The windows of some benchmark items: term numbers and their offsets."""

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW):
        found = W.find(pa.array([t for _, t in items], pa.string()), W.ALNUM, lower=True)
        h = W.hashes(found)
        self.names = [name for name, _ in items]
        self.terms, numbers = np.unique(h, return_inverse=True)
        counts = found.counts()
        many = np.where(counts > 0, np.maximum(counts - window + 1, 1), 0)  # windows of each item
        owner = np.repeat(np.arange(len(items)), many)
        place = (np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + found.first[owner])[:, None] + np.arange(window)
        table = np.where(place < found.first[owner + 1][:, None], numbers[np.minimum(place, max(0, len(numbers) - 1))], -1) if len(owner) else np.zeros((0, window), np.int64)
        both = np.unique(np.column_stack([table, owner]), axis=0)
        self.table, self.owner = both[:, :window], both[:, window]
        self.length = (self.table >= 0).sum(axis=1)

    def __len__(self) -> int:
        return len(self.table)

    def find(self, seg: dict, first: np.ndarray, slop: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, start) of the exact occurrences, and the (start, end) of the proximity matches, in positions; first:
        where each document begins."""
        none, no_runs = np.zeros(0, np.int64), np.zeros((0, 2), np.int64)
        terms, counts, postings = seg["terms"], seg["counts"], seg["postings"]
        if not len(terms) or not len(self):
            return none, none, no_runs
        at = np.minimum(np.searchsorted(terms, self.terms), len(terms) - 1)
        there = terms[at] == self.terms
        many = np.append(np.where(there, counts[at], 0), np.iinfo(np.int64).max)  # -1: padding
        rarity = many[self.table]
        alive = np.flatnonzero(rarity.min(axis=1) > 0)
        if not len(alive):
            return none, none, no_runs
        begin = np.append(0, np.cumsum(counts.astype(np.int64)))[:-1]
        keys = (np.repeat(np.arange(len(terms), dtype=np.uint64), counts) << np.uint64(32)) | postings
        order = np.argsort(rarity[alive], axis=1, kind="stable")
        rare = order[:, 0]
        term = self.table[alive, rare]
        n = many[term].astype(np.int64)
        row = np.repeat(np.arange(len(alive)), n)
        inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        anchor = postings[begin[at[term]][row] + inner].astype(np.int64)
        start = anchor - rare[row]
        keep = start >= 0
        row, start = row[keep], start[keep]
        for j in range(1, self.table.shape[1]):
            offset = order[row, j]
            term = self.table[alive[row], offset]
            want = (at[term].astype(np.uint64) << np.uint64(32)) | (start + offset).astype(np.uint64)
            place = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
            keep = (keys[place] == want) | (term < 0)
            row, start = row[keep], start[keep]
            if not len(row):
                break
        near = self._near(postings, alive, order, at, begin, keys, many, first, slop) if slop is not None else no_runs
        return alive[row], start, near

    def _near(self, postings, alive, order, at, begin, keys, many, first, slop) -> np.ndarray:
        """The shortest run from each word on that holds every term of a window and is short enough."""
        most = self.length[alive] + slop * self.length[alive] // self.table.shape[1]  # words of a run
        term = self.table[alive, order[:, 0]]
        n = many[term].astype(np.int64)
        row = np.repeat(np.arange(len(alive)), n)
        here = postings[begin[at[term]][row] + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)].astype(np.int64)
        doc = np.searchsorted(first, here, "right") - 1
        ends = first[doc + 1] - 1  # the free position after the document

        def following(row, term, place):
            """The first posting of a term at or after a place; beyond all documents where there is none."""
            base = at[term].astype(np.uint64) << np.uint64(32)
            k = np.minimum(np.searchsorted(keys, base | place.astype(np.uint64)), len(keys) - 1)
            found = (keys[k] >> np.uint64(32) == at[term].astype(np.uint64)) & (keys[k] & np.uint64(2**32 - 1) >= place.astype(np.uint64))
            return np.where(found, (keys[k] & np.uint64(2**32 - 1)).astype(np.int64), np.iinfo(np.int64).max)

        for j in range(1, self.table.shape[1]):
            other = self.table[alive[row], order[row, j]]
            low = np.maximum(here - most[row] + 1, first[doc])
            keep = (other < 0) | (following(row, other, low) <= np.minimum(here + most[row] - 1, ends - 1))
            row, here, doc, ends = row[keep], here[keep], doc[keep], ends[keep]
        out = []
        for back in range(int(most.max(initial=0))):  # runs that begin ``back`` words before the rarest term
            some = np.flatnonzero((back < most[row]) & (here - back >= first[doc]))
            start, begins = here[some] - back, np.zeros(len(some), bool)
            stop = start
            for j in range(self.table.shape[1]):
                other = self.table[alive[row[some]], j]
                place = np.where(other >= 0, following(row[some], np.maximum(other, 0), start), start)
                begins |= (place == start) & (other >= 0)
                stop = np.maximum(stop, place)
            good = begins & (stop < np.minimum(start + most[row[some]], ends[some]))
            out.append(np.column_stack([start[good], stop[good] + 1]))
        return np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 2), np.int64)


def _read(row: dict) -> dict:
    postings = np.frombuffer(row["postings"], np.uint8)
    return {"terms": np.frombuffer(row["terms"], np.uint64), "counts": np.frombuffer(row["counts"], np.uint32).astype(np.int64),
            "postings": np.ascontiguousarray(postings.reshape(4, -1).T).view(np.uint32).ravel().astype(np.uint64)}


def _blocks(benchmark: DataFrame, limit: int) -> Iterator[list[tuple[str, str | None]]]:
    """The items in blocks of about ``limit`` bytes; one block where the table's text is smaller."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    size = items.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 16)).first()[0] or 0
    n = int(size // limit) + 1
    for k in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        yield [(r["item_id"], r["text"]) for r in part.toLocalIterator()]


def search(index: DataFrame, benchmark: DataFrame, window: int = WINDOW, slop: int | None = None,
           block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document: doc_id, digest, n_words, n_hit, spans (hit word ranges), items (with occurring windows), n_near and
    near_spans (those of proximity matches)."""
    parts = []
    for items in _blocks(benchmark, block_bytes):
        block = Block(items, window)

        def scan(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    yield _hits(row, block, slop)

        parts.append(index.mapInArrow(scan, HITS))
    if len(parts) == 1:
        return parts[0]
    both = parts[0].withColumn("row", F.lit(0))
    for k, part in enumerate(parts[1:], 1):
        both = both.unionByName(part.withColumn("row", F.lit(k)))
    merged = (both.groupBy("doc_id", "digest", "n_words")
              .agg(F.collect_set("spans").alias("spans"), F.collect_set("near_spans").alias("near_spans"),
                   F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"), F.count(F.when(F.col("row") == 0, 1)).alias("times")))

    def join_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = batch.to_pylist()
            for r in out:
                for name, count in (("spans", "n_hit"), ("near_spans", "n_near")):
                    spans = _united(np.concatenate([np.zeros((0, 2), np.int64), *(np.frombuffer(x, np.int64).reshape(-1, 2) for x in r[name])]))
                    r |= {name: spans.tobytes(), count: int((spans[:, 1] - spans[:, 0]).sum())}
            # equal rows of a repeated doc_id have equal spans: one result row for each of them
            rows = [{k: r[k] for k in _HITS.names} for r in out for _ in range(r["times"])]
            yield pa.RecordBatch.from_pylist(rows, schema=_HITS)

    return merged.mapInArrow(join_spans, HITS)


_HITS = pa.schema([("doc_id", pa.int64()), ("digest", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("spans", pa.binary()),
                   ("items", pa.list_(pa.string())), ("n_near", pa.int64()), ("near_spans", pa.binary())])


def _united(spans: np.ndarray) -> np.ndarray:
    """The union of ranges (start, end), in order; ranges that touch are one."""
    if not len(spans):
        return spans
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    cut = np.flatnonzero(np.append(True, spans[1:, 0] > reach[:-1]))
    return np.column_stack([spans[cut, 0], reach[np.append(cut[1:], len(spans)) - 1]])


def _per_doc(spans: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """The words in united ranges of positions, and the ranges, of each document."""
    n = len(first) - 1
    words, out = np.zeros(n, np.int64), [b""] * n
    if len(spans):
        owner = np.searchsorted(first, spans[:, 0], "right") - 1
        np.add.at(words, owner, spans[:, 1] - spans[:, 0])
        cut = np.flatnonzero(np.append(True, np.diff(owner) != 0))
        for a, b in zip(cut, np.append(cut[1:], len(owner)), strict=True):
            out[owner[a]] = (spans[a:b] - first[owner[a]]).astype(np.int64).tobytes()
    return words, out


def _hits(row: dict, block: Block, slop: int | None) -> pa.RecordBatch:
    n_words = np.array(row["n_words"], np.int64)
    ids = np.array(row["doc_ids"], np.int64)
    first = np.append(0, np.cumsum(n_words + 1))  # in positions
    window, start, near = block.find(_read(row), first, slop)
    hit, spans = _per_doc(_united(np.column_stack([start, start + block.length[window]])), first)
    close, near_spans = _per_doc(_united(near), first)
    doc = np.searchsorted(first, start, "right") - 1
    pairs = np.unique(np.column_stack([doc, block.owner[window]]), axis=0) if len(doc) else np.zeros((0, 2), np.int64)
    items: list[list[str]] = [[] for _ in ids]
    for d, k in pairs.tolist():
        items[d].append(block.names[k] if block.names[k] is not None else "")
    return pa.RecordBatch.from_arrays(
        [W.ids_out(ids), pa.array(row["digests"], pa.int64()), pa.array(n_words), pa.array(hit), pa.array(spans, pa.binary()),
         pa.array([sorted(set(x)) for x in items], pa.list_(pa.string())), pa.array(close, pa.int64()), pa.array(near_spans, pa.binary())], schema=_HITS)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, slop: int | None = None,
                  block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Index the documents and search the whole benchmark."""
    return search(build_index(docs), benchmark, window, slop, block_bytes)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), slop=SLOP)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.concat_ws(",", F.array_sort("items")).cast("binary"), 256).alias("items_sha256"),
                        (F.col("n_hit") > 0).alias("contaminated"), "n_near")

