"""N-gram Jaccard join by MinHash banding, verified on the full n-gram sets.

1. Every text becomes the set of its hashed word n-grams; equal sets are one node (a 128-bit digest of the set),
   so exact copies are counted, never paired.  A text of fewer than n words has one n-gram, all of it.
2. Each node's MinHash signature is cut into bands; the numbers of bands and rows are the cheapest that find
   a pair at the threshold with the wanted recall.  Band hashes are dealt by value.
3. In each bucket every member is verified against the bucket's leader.  By the triangle inequality of the
   Jaccard distance a member that matches its leader can only be linked to a member that does not if their
   distances from the leader allow it; only such members and the rest go on.  What is left of a bucket
   is compared inside tasks, block by block, as products of incidence matrices; tasks emit forests of links,
   never all pairs, so no bucket is capped.
4. Linked nodes are closed to classes (minimum labels with pointer jumping, on stored tables).
5. Links are counted inside classes, again block by block; a class is cut into blocks however large it is.

Result per input row: doc_id, class_id (smallest doc_id of the class), n_links (other rows whose set has a
similarity at or over the threshold, copies included), n_copies (rows with an equal set).  A null or empty text
has no n-grams: it is a class of its own without links.  A null doc_id is kept; it is named by a class only
where all of its members are null.  Rows that repeat a doc_id count as documents of their own.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W
from .storage import hot_join, hot_keys, partitions, release, stored

NGRAM = 5
THRESHOLD = 0.8
RECALL = 0.9999
#: Members of a block in the comparisons inside tasks.
BLOCK = 1024
#: Left-over buckets of at most so many members are compared as pairs; larger ones in blocks.
SMALL = 8
SIGNATURES = "doc_id bigint, digest bigint, node binary, size int, bands array<bigint>"
SETS = "node binary, grams binary"


def band_plan(threshold: float, recall: float, most: int = 160) -> tuple[int, int]:
    """(bands, rows): the most selective banding of at most ``most`` hashes that reaches the recall at the threshold."""
    best = None
    for rows in range(1, 33):
        p = threshold**rows
        bands = 1 if p >= 1 else math.ceil(math.log(1 - recall) / math.log1p(-p)) if p > 0 else most + 1
        if bands * rows <= most:
            best = (bands, rows)
    if best is None:
        raise ValueError(f"no banding of {most} hashes finds pairs at {threshold} with a recall of {recall}")
    return best


def gram_sets(texts: pa.Array, n: int = NGRAM) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct n-gram hashes of each text, end to end, and the texts' offsets in them."""
    found = W.find(texts)
    h = W.hashes(found)
    counts = found.counts()
    starts = W.window_starts(found.first, n)
    doc = np.searchsorted(found.first, starts, "right") - 1
    grams = W.windows(h, n)[starts] if len(starts) else np.zeros(0, np.uint64)
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        whole = []
        for d in short:
            part = h[found.first[d] : found.first[d + 1]]
            whole.append(W.windows(part, len(part))[0] ^ np.uint64(len(part)))
        grams = np.append(grams, np.array(whole, np.uint64))
        doc = np.append(doc, short)
    order = np.lexsort((grams, doc))
    grams, doc = grams[order], doc[order]
    if len(grams):
        new = np.append(True, (grams[1:] != grams[:-1]) | (doc[1:] != doc[:-1]))
        grams, doc = grams[new], doc[new]
    return grams, np.searchsorted(doc, np.arange(len(counts) + 1))


def nodes(grams: np.ndarray, at: np.ndarray) -> list[bytes | None]:
    """A 128-bit digest of each set; None for an empty one."""
    full = np.flatnonzero(np.diff(at))
    out: list[bytes | None] = [None] * (len(at) - 1)
    if len(full):
        with np.errstate(over="ignore"):
            sums = [W.mix(np.add.reduceat(W.mix(grams ^ np.uint64(s)), at[full])) for s in (0x1234567, 0x89ABCDEF01)]
        for i, a, b in zip(full, *sums, strict=True):
            out[i] = a.tobytes() + b.tobytes()
    return out


def signatures(grams: np.ndarray, at: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Band hashes (sets x bands) of the sets that are not empty."""
    full = np.flatnonzero(np.diff(at))
    sizes = np.diff(at)[full]
    rng = np.random.Generator(np.random.PCG64(77))
    factors = rng.integers(0, 2**63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    masks = rng.integers(0, 2**63, bands * rows, dtype=np.uint64)
    least = np.empty((len(full), bands * rows), np.uint64)
    ends = np.cumsum(sizes)
    i = 0
    with np.errstate(over="ignore"):
        while i < len(full):  # pieces that stay in the processor's cache
            done = ends[i - 1] if i else 0
            j = max(i + 1, int(np.searchsorted(ends, done + 32768, "right")))
            part = grams[done : ends[j - 1]]
            begin = np.append(0, ends[i : j - 1] - done)
            for p in range(bands * rows):
                least[i:j, p] = np.minimum.reduceat((part ^ masks[p]) * factors[p], begin)
            i = j
        out = np.zeros((len(full), bands), np.uint64)
        for b in range(bands):
            h = np.full(len(full), b + 1, np.uint64)
            for r in range(rows):
                h = W.mix(h * np.uint64(0x9E3779B97F4A7C15) + least[:, b * rows + r])
            out[:, b] = h
    return out


def _sign(n: int, bands: int, rows: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.merged_blocks(batches, W.PIECE // 2):
            grams, at = gram_sets(batch.column("text"), n)
            sizes = np.diff(at)
            hashed = signatures(grams, at, bands, rows)
            offsets = np.append(0, np.cumsum(np.where(sizes > 0, bands, 0))).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(W.long_ids(batch.column("doc_id"))), batch.column("digest"), pa.array(nodes(grams, at), pa.binary()), pa.array(sizes.astype(np.int32)),
                 pa.ListArray.from_arrays(pa.array(offsets), pa.array(hashed.ravel().view(np.int64)))],
                names=["doc_id", "digest", "node", "size", "bands"])

    return sign


def _sets(n: int):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.merged_blocks(batches, W.PIECE // 2):
            grams, at = gram_sets(batch.column("text"), n)
            held = [(k, grams[a:b].tobytes()) for k, a, b in zip(nodes(grams, at), at[:-1], at[1:], strict=True) if k]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in held], pa.binary()), pa.array([g for _, g in held], pa.binary())],
                                             names=["node", "grams"])

    return sets


def jaccard(a: list[np.ndarray], b: list[np.ndarray] | None = None) -> np.ndarray:
    """Similarities of all sets of a with all of b (of a, where b is None), from products of incidence matrices."""
    both = a if b is None else a + b
    sizes = np.array([len(x) for x in both], np.float64)
    grams = np.concatenate(both)
    owner = np.repeat(np.arange(len(both)), sizes.astype(np.int64))
    values, column, many = np.unique(grams, return_inverse=True, return_counts=True)
    shared = np.cumsum(many > 1) - 1  # grams of one set alone meet nothing
    keep = many[column] > 1
    owner, column = owner[keep], shared[column[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    m, width = len(a), 4096
    common = np.zeros((m, m if b is None else len(b)))
    for c in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        lo, hi = np.searchsorted(column, (c, c + width))
        part = np.zeros((len(both), width), np.float32)
        part[owner[lo:hi], column[lo:hi] - c] = 1
        common += part[:m] @ (part[:m] if b is None else part[m:]).T
    left, right = sizes[:m], sizes[:m] if b is None else sizes[m:]
    return common / (left[:, None] + right[None, :] - common)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sims = []
        for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
            p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = np.sort(np.concatenate([p, q]))
            common = int(np.count_nonzero(both[1:] == both[:-1]))
            sims.append(common / (len(p) + len(q) - common))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(sims, pa.float64())], names=["a", "b", "sim"])


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, sim) for pairs of nodes, on their full sets."""
    each = pairs.join(sets.select(F.col("node").alias("b"), F.col("grams").alias("y")), "b")
    both = hot_join(each, sets.select(F.col("node").alias("a"), F.col("grams").alias("x")), ["a"], hot=hot_keys(pairs, ["a"]))  # leaders of many
    return both.select("a", "b", "x", "y").mapInArrow(_verify, "a binary, b binary, sim double")


def by_group(rows: DataFrame, keys: list[str], each: Callable[[list[dict]], list[dict]], schema: str, names: list[str]) -> DataFrame:
    """each(the rows of one key) for every key; many small groups cost one task together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        out: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                if held and any(held[0][k] != row[k] for k in keys):
                    out += each(held)
                    held = []
                held.append(row)
            if len(out) > 10_000:
                yield pa.RecordBatch.from_pydict({n: pa.array([r[n] for r in out], _TYPES[n]) for n in names})
                out = []
        if held:
            out += each(held)
        if out:
            yield pa.RecordBatch.from_pydict({n: pa.array([r[n] for r in out], _TYPES[n]) for n in names})

    return rows.repartition(partitions(rows.sparkSession), *keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


_TYPES = {"a": pa.binary(), "b": pa.binary(), "sim": pa.float64(), "node": pa.binary(), "links": pa.int64()}


def _halves(rows: list[dict]) -> tuple[list[dict], list[dict] | None]:
    """The rows of one pair of blocks, each node once; None for a block with itself."""
    left = list({r["node"]: r for r in rows if r["block"] == r["i"]}.values())
    right = list({r["node"]: r for r in rows if r["block"] == r["j"]}.values())
    return (left, None) if rows[0]["i"] == rows[0]["j"] else (left, right)


def _matrix(left: list[dict], right: list[dict] | None) -> np.ndarray:
    grams = lambda rows: [np.frombuffer(r["grams"], np.uint64) for r in rows]
    return jaccard(grams(left), None if right is None else grams(right))


def _forest(threshold: float):
    def forest(rows: list[dict]) -> list[dict]:
        """Links that connect what a pair of blocks connects, at most one fewer than nodes."""
        left, right = _halves(rows)
        if not left or right == [] or (right is None and len(left) < 2):
            return []
        all_rows = left + (right or [])
        near = _matrix(left, right) >= threshold - 1e-12
        root = list(range(len(all_rows)))

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        out = []
        for x, y in np.argwhere(near).tolist():
            y += 0 if right is None else len(left)
            if (p := find(x)) != (q := find(y)):
                root[q] = p
                out.append({"a": all_rows[x]["node"], "b": all_rows[y]["node"], "sim": 1.0})
        return out

    return forest


def _degrees(threshold: float):
    def degrees(rows: list[dict]) -> list[dict]:
        """For each node of a pair of blocks, the rows that are linked to it."""
        left, right = _halves(rows)
        if not left or right == []:
            return []
        near = (_matrix(left, right) >= threshold - 1e-12).astype(np.int64)
        weight = lambda part: np.array([r["copies"] for r in part], np.int64)
        if right is None:
            np.fill_diagonal(near, 0)
            return [{"node": r["node"], "links": int(n)} for r, n in zip(left, near @ weight(left), strict=True)]
        return [{"node": r["node"], "links": int(n)} for r, n in zip(left, near @ weight(right), strict=True)] + [
            {"node": r["node"], "links": int(n)} for r, n in zip(right, weight(left) @ near, strict=True)]

    return degrees


def block_pairs(rows: DataFrame) -> DataFrame:
    """rows (key, node, n, ...; n: the rows of the key) once for each pair (i, j) of the key's blocks that their own block is part of."""
    dealt = rows.withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    return (dealt.withColumn("other", other).withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
            .drop("other", "blocks", "n"))


def components(links: DataFrame) -> DataFrame:
    """(node, label): the smallest node of each node's component."""
    both = stored(links.select("a", "b").union(links.select("b", "a")).distinct(), "near-links")
    hubs = hot_keys(both, ["b"])
    table = stored(both.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("label")), "near-labels")
    while True:
        labels = table.select("node", "label")
        seen = hot_join(both, labels.withColumnRenamed("node", "b"), ["b"], hot=hubs).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("seen"))
        least = stored(labels.join(seen, "node", "left").select("node", F.col("label").alias("old"), F.least("label", "seen").alias("label")), "near-least")
        jump = least.select(F.col("node").alias("label"), F.col("label").alias("over"))
        new = stored(hot_join(least, jump, ["label"], "left").select("node", "old", F.least("label", "over").alias("label")), "near-labels")
        release(table, least)
        table = new
        if new.where(F.col("label") != F.col("old")).isEmpty():
            release(both)
            return new


def jaccard_join(docs: DataFrame, n: int = NGRAM, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """Per row of (doc_id, text): doc_id, class_id, n_links, n_copies, digest (xxhash64 of the text) and keeper.

    keeper marks the rows of one doc_id and text in each class: where it is set, one document of each class stays
    once rows that are equal in both are dropped.
    """
    bands, rows = band_plan(threshold, recall)
    text = F.col("text").cast("string")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("digest"))
    signed = stored(texts.mapInArrow(_sign(n, bands, rows), SIGNATURES), "near-signatures")
    classes = stored(signed.where("node is not null").groupBy("node")
                     .agg(F.min(F.struct("doc_id", "digest")).alias("doc"), F.count(F.lit(1)).alias("copies"), F.first("bands").alias("bands")), "near-classes")
    banded = classes.select("node", F.explode("bands").alias("bucket"))
    leaders = banded.groupBy("bucket").agg(F.min("node").alias("leader"), F.count(F.lit(1)).alias("n")).where("n > 1")
    members = stored(hot_join(banded, leaders.drop("n"), ["bucket"]), "near-members")

    wanted = members.select("node").distinct().join(classes, "node").select("doc.doc_id").distinct()
    sets = stored(texts.withColumn("doc_id", F.coalesce("doc_id", F.lit(W.NULL_ID))).join(wanted.hint("merge"), "doc_id", "left_semi")
                  .mapInArrow(_sets(n), SETS).dropDuplicates(["node"]), "near-sets")  # rows that repeat an id bring a set again

    compared = stored(members.where("node != leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct(), "near-compared")
    stars = stored(verified(compared, sets), "near-stars")
    links = stars.where(F.col("sim") >= threshold - 1e-12)
    far = 1 - threshold
    told = (members.where("node != leader")
            .join(stars.select(F.col("a").alias("leader"), F.col("b").alias("node"), (1 - F.col("sim")).alias("d")), ["leader", "node"])
            .withColumn("off", F.col("d") > far + 1e-12))
    odd = (told.groupBy("bucket").agg(F.count(F.when(F.col("off"), 1)).alias("odd"),
                                      F.min(F.when(F.col("off") & (F.col("d") <= 2 * far + 1e-9), F.col("d"))).alias("reach")).where("odd > 0"))
    left = stored(hot_join(told, odd, ["bucket"]).where(F.col("off") | (F.col("d") >= F.col("reach") - far - 1e-9)).select("bucket", "node"), "near-left")
    sizes = left.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    sized = stored(hot_join(left, sizes, ["bucket"]), "near-sized")
    few = sized.where(F.col("n") <= SMALL).drop("n")
    pairs = stored(few.withColumnRenamed("node", "a").join(few.withColumnRenamed("node", "b"), "bucket").where("a < b").select("a", "b").distinct()
                   .join(stars.select("a", "b"), ["a", "b"], "left_anti"), "near-pairs")
    links = links.unionByName(verified(pairs, sets).where(F.col("sim") >= threshold - 1e-12))
    many = block_pairs(sized.where(F.col("n") > SMALL)).join(sets, "node")
    links = links.unionByName(by_group(many, ["bucket", "i", "j"], _forest(threshold), "a binary, b binary, sim double", ["a", "b", "sim"]))

    table = components(links)
    release(members, compared, stars, left, sized, pairs)
    labels = table.select("node", "label")
    inside = labels.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    grouped = block_pairs(hot_join(labels, inside, ["label"]).join(classes.select("node", "copies"), "node")).join(sets, "node")
    degrees = (by_group(grouped, ["label", "i", "j"], _degrees(threshold), "node binary, links bigint", ["node", "links"])
               .groupBy("node").agg(F.sum("links").alias("links")))
    named = labels.join(classes.select("node", "doc"), "node")
    first = named.groupBy("label").agg(F.min("doc").alias("first"))
    linked = hot_join(named, first, ["label"]).join(degrees, "node", "left").select("node", "first", "links")
    per_node = stored(classes.select("node", "doc", "copies").join(linked, "node", "left")
                      .select("node", "copies", F.coalesce("first", "doc").alias("first"), F.coalesce("links", F.lit(0)).alias("links")), "near-judged")
    release(table, classes, sets)
    blank = lambda c: F.when(c != W.NULL_ID, c)
    own = F.struct("doc_id", "digest")
    return (hot_join(signed.select("doc_id", "digest", "node"), per_node, ["node"], "left").withColumn("first", F.coalesce("first", own))
            .select(blank(F.col("doc_id")).alias("doc_id"), blank(F.col("first.doc_id")).alias("class_id"),
                    (F.coalesce("links", F.lit(0)) + F.coalesce("copies", F.lit(1)) - 1).alias("n_links"),
                    F.coalesce("copies", F.lit(1)).alias("n_copies"), "digest", (F.col("first") == own).alias("keeper")))


def keep_one(docs: DataFrame, judged: DataFrame) -> DataFrame:
    """The rows of docs that stand for their class: one document of each."""
    keys = ["_digest", "_id"]
    stay = judged.where("keeper").select(F.col("digest").alias("_digest"), F.coalesce("doc_id", F.lit(W.NULL_ID)).alias("_id")).distinct()
    keyed = docs.withColumns({"_digest": F.xxhash64(F.col("text").cast("string")), "_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(W.NULL_ID))})
    return keyed.join(stay, keys, "left_semi").dropDuplicates(keys).drop(*keys)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "class_id", "n_links", "n_copies")
