import re
from collections import defaultdict

from pyspark.sql import functions as F

from factlane.llm import mixture as M

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_targets(sizes, weights=(5, 2, 1), most=3):
    """Shares by weight, the excess over the caps shared again until none is above."""
    names = sorted((k for k in sizes if k is not None), key=lambda k: k.encode()) + [k for k in sizes if k is None]
    weight = {k: weights[i % 3] for i, k in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [k for k in names if k not in fixed]
        left, w = total - sum(fixed.values()), sum(weight[k] for k in free)
        share = {k: left * weight[k] / w for k in free}
        over = [k for k in free if share[k] > most * sizes[k]]
        if not over:
            return fixed | share
        fixed |= {k: most * sizes[k] for k in over}


def check(docs, got, slack):
    size = lambda t: len(WORD.findall(t or ""))
    sizes, taken = defaultdict(int), defaultdict(int)
    for _, t, s in docs:
        sizes[s] += size(t)
    want = brute_targets(sizes)
    assert len(got) == len(docs)
    assert sorted((r.doc_id is None, r.doc_id or 0, r["size"]) for r in got) == sorted((d is None, d or 0, size(t)) for d, t, _ in docs)
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source])
        assert 0 <= r.taken <= 3 * r["size"]
        taken[r.source] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= slack(want[s]), (s, taken[s], want[s])


def test_permutation(spark):
    for n in (1, 2, 7, 100):
        got = spark.range(n).select(M.permuted(F.col("id"), F.lit(n), F.lit(5)).alias("p")).collect()
        assert sorted(r.p for r in got) == list(range(n))


def test_fixture(spark):
    docs = [(i, "w " * (i % 50), f"s{i % 7}") for i in range(700)] + [(1000 + i, "x " * 40, "hot") for i in range(600)]
    docs += [(1, None, "s0"), (1, None, "s0"), (2, "", "empty"), (None, "a b c", "s1"), (3, "one two\n\tthree", None), (4, "w " * 20000, "s2"), (5, "tiny", "é")]
    d = spark.createDataFrame([(a, b, c, 1, 2) for a, b, c in docs], "doc_id long, text string, source string, size int, rank int")
    first = M.mix(d, block=16, shard=64).taken().collect()
    check(docs, first, lambda t: 0.03 * t + 16 * 8)
    again = M.mix(d.repartition(5), block=16, shard=64).taken().collect()
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r["size"], r.taken, r.source or "")
    assert sorted(map(key, first)) == sorted(map(key, again))
    assert M.mix(d.limit(0)).taken().count() == 0
    uses = M.mix(d, block=16, shard=64).slots.groupBy("rank", "block").count().agg(F.max("count")).first()[0]
    assert uses <= 3


def test_counts_of_shards_are_drawn(spark):
    """Shards have width slots each, and a source's counts in them spread as a multinomial's, not more evenly."""
    docs = spark.range(400).selectExpr("id as doc_id", "repeat('w ', 400) as text", "if(id % 2 = 0, 'a', 'b') as source")
    m = M.mix(docs, block=4, shard=128)
    width = {r.shard: r["count"] for r in m.slots.groupBy("shard").count().collect()}
    assert sorted(width.values())[1:] == [128] * (len(width) - 1) and len(width) > 300
    counts = defaultdict(int)
    for r in m.slots.where("rank = 0").groupBy("shard").count().collect():
        counts[r.shard] = r["count"]
    share = sum(counts.values()) / sum(width.values())
    spread = sum((counts[k] - n * share) ** 2 for k, n in width.items()) / len(width)
    assert abs(share - 5 / 7) < 0.001 and 0.75 < spread / (128 * share * (1 - share)) < 1.3


def test_query(spark):
    docs = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    source = {d: s for d, _, s in docs}
    class Row(dict):
        __getattr__ = dict.__getitem__
    got = [Row(r.asDict(), source=source[r.doc_id]) for r in M.op7(spark, SF).collect()]
    check(docs, got, lambda t: 0.02 * t + 256)
