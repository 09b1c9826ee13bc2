import math
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from factlane.llm import quality as Q

SF = "/root/testdata/sf0.01"


def brute(texts):
    """P(w | u, v) of the interpolated modified Kneser-Ney model, on words."""
    three = Counter()
    for t in texts:
        w = ["<s>", "<s>", *t.split(), "</s>"] if t.split() else []
        three.update(zip(w, w[1:], w[2:]))
    two, one = Counter(), Counter()
    for _, v, w in three:
        two[v, w] += 1
    for _, w in two:
        one[w] += 1

    def discounts(table):
        n = [sum(c == k for c in table.values()) for k in (1, 2, 3, 4)]
        if not all(n[:3]):
            return (0.5, 1.0, 1.5)
        y = n[0] / (n[0] + 2 * n[1])
        return tuple(min(max(k + 1 - (k + 2) * y * n[k + 1] / n[k], 0.05), k + 0.95) for k in range(3))

    d1, d2, d3 = map(discounts, (one, two, three))
    less = lambda c, d: d[min(c, 3) - 1]
    total1 = sum(one.values())
    even = sum(less(c, d1) for c in one.values()) / total1 / (len(one) + 1)

    def context(table, d):
        total, mass = defaultdict(int), defaultdict(float)
        for g, c in table.items():
            total[g[:-1]] += c
            mass[g[:-1]] += less(c, d)
        return total, mass

    (t2, m2), (t3, m3) = context(two, d2), context(three, d3)

    def p(u, v, w):
        x = even + ((one[w] - less(one[w], d1)) / total1 if w in one else 0)
        for table, d, total, mass, g in ((two, d2, t2, m2, (v, w)), (three, d3, t3, m3, (u, v, w))):
            if c := g[:-1]:
                if c in total:
                    x = m2[c] / t2[c] * x if total is t2 else m3[c] / t3[c] * x
                    if g in table:
                        x += (table[g] - less(table[g], d)) / total[c]
        return x

    return p, set(one)


TEXTS = ["a b c a b d a b c a b", "the cat sat on the mat the cat sat", "a b c the cat a a a a b b c", "d d d", "x y z x y x y z w", "", "solo"] * 2 + ["a c b d x w", "b a"]


def test_against_brute_force(spark):
    model = Q.train(spark.createDataFrame([(t,) for t in [*TEXTS, None]], "text string"))
    p, words = brute(TEXTS)
    for u, v in (("<s>", "<s>"), ("a", "b"), ("the", "cat"), ("never", "seen"), ("never", "a")):
        assert abs(sum(p(u, v, w) for w in words) + p(u, v, "unknown") - 1) < 1e-9  # a distribution
    for t in [*TEXTS, "a b zzz the mat", "q"]:
        x, at, counts = Q.sequence(pa.array([t]))
        w = ["<s>", "<s>", *t.split(), "</s>"] if t.split() else []
        want = [math.log10(p(*w[i - 2 : i + 1])) for i in range(2, len(w))]
        assert counts[0] == len(t.split()) and np.allclose(model.score(x, at), want, atol=1e-4)


def test_odd_rows(spark):
    docs = [(1, "a b c", "en"), (2, None, "en"), (3, "", None), (4, "a b c a b", None), (4, "a b c a b", None), (None, "x", "en"), (5, "w " * 50000, "fr")]
    d = spark.createDataFrame([(*r, 1, "t") for r in docs], "doc_id long, text string, lang string, keep int, n_words string")
    labels = spark.createDataFrame([(1, 1, 0), (4, 1, None), (4, 0, 0), (None, 1, 0), (5, 1, 0), (99, 1, 0)], "doc_id long, quality int, toxic int")
    got = Q.classify(d, labels).collect()
    assert len(got) == len(docs)
    assert {(r.n_words, r.perplexity, r.keep) for r in got if r.doc_id in (2, 3)} == {(0, None, False)}
    assert {r.n_words for r in got if r.doc_id == 5} == {50000}
    assert all(r.keep for r in Q.classify(d, labels.limit(0)).collect() if r.n_words)
    assert Q.classify(d.limit(0), labels).count() == 0
    bounded = Q.sample(d, Q.trusted_ids(labels), most_docs=1, most_words=1000)
    assert bounded.count() <= 1


def test_query_on_labels(spark):
    """Held-out good documents stay; most of the labelled bad ones go."""
    got = {r.doc_id: r for r in Q.op10(spark, SF).collect()}
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    good = [got[r.doc_id].keep for r in labels if r.quality == 1 and not r.toxic]
    bad = [got[r.doc_id].keep for r in labels if r.quality == 0]
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.5


def test_sample_reads_all_of_a_larger_table(spark):
    ids = spark.range(5000).withColumnRenamed("id", "doc_id")
    trusted = Q.trusted_ids(ids.selectExpr("doc_id", "1 as quality", "0 as toxic"))
    train = trusted.where(~F.col("calibrates")).count()
    assert 2500 < train <= 6000
    assert Q.sample(ids.selectExpr("doc_id", "'some words' as text"), trusted).count() == train


def test_recall_of_bad_passages(spark):
    """Nine in ten of quality 0 go; insults alone hardly show in word order, so of the toxic only some do."""
    got = {r.doc_id: r.keep for r in Q.op10(spark, SF).collect()}
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    assert np.mean([got[r.doc_id] for r in labels if r.quality == 0]) < 0.1
    assert not all(got[r.doc_id] for r in labels if r.quality == 1 and r.toxic)
    assert np.mean([got[r.doc_id] for r in labels if r.quality == 1 and not r.toxic]) > 0.98


def test_most_against_all_windows():
    n = np.random.default_rng(0).integers(0, 9, 50)
    first, values = np.append(0, np.cumsum(n)), np.random.default_rng(1).normal(size=n.sum())
    for a, b, x in zip(first, first[1:], Q.most(np.append(0, np.cumsum(values)), first, 4)):
        k = min(4, b - a)
        assert abs(x - max((values[i : i + k].sum() for i in range(a, b - k + 1)), default=0)) < 1e-9


def test_small_language_has_its_own_threshold(spark):
    rows = [(i, "a b c a b c a b c", "xx") for i in range(60)] + [(100 + i, f"q{i} r{i} s{i} t{i}", "yy") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = docs.selectExpr("doc_id", "1 as quality", "0 as toxic")
    cuts = {r.lang: r.threshold for r in Q.classify(docs, labels, most_docs=10).collect()}
    assert cuts["yy"] > 1.5 * cuts["xx"]


def test_sample_with_too_large_a_document(spark):
    docs = spark.range(40).selectExpr("id as doc_id", "'one two three' as text")
    trusted = Q.trusted_ids(docs.selectExpr("doc_id", "1 as quality", "0 as toxic"))
    first = trusted.where(~F.col("calibrates")).orderBy("mark").first().doc_id
    skewed = docs.withColumn("text", F.when(F.col("doc_id") == first, F.repeat(F.lit("many "), 1000)).otherwise(F.col("text")))
    got = [r.text for r in Q.sample(skewed, trusted, most_words=200).collect()]
    assert got.count("one two three") > 10 and sum(len(t.split()) for t in got) <= 200 and set(got) == {"one two three"}


def test_all_trusted_documents_train(spark):
    """More documents and words than the 6,000 and 2.5 million that once bounded the sample."""
    ids = spark.range(9000).withColumnRenamed("id", "doc_id")
    trusted = Q.trusted_ids(ids.selectExpr("doc_id", "1 as quality", "0 as toxic"))
    train = trusted.where(~F.col("calibrates")).count()
    assert train > 6000
    docs = ids.selectExpr("doc_id", "concat('of word', doc_id, repeat(' many', 400)) as text")
    learnt = Q.chosen(docs, trusted)
    assert learnt.count() == train and train * 402 > 2_500_000
    model = Q.counted(learnt)
    told = model.formula
    assert told.kinds == train + 3  # each document's own word, "of", "many" and the end


def test_dealt_scores_against_brute_force(spark, monkeypatch):
    """Documents over several tasks and rounds are scored as one process would."""
    monkeypatch.setattr(Q, "ROUND_BYTES", 64)
    p, _ = brute(TEXTS)
    docs = [(i, t, "en") for i, t in enumerate([*TEXTS, "a b zzz the mat", "q", None])]
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(3)
    model = Q.train(spark.createDataFrame([(t,) for t in TEXTS], "text string").repartition(3))
    got = {r.doc_id: r for r in Q.score(d, model).collect()}
    assert len(got) == len(docs)
    for i, t, _ in docs:
        w = ["<s>", "<s>", *t.split(), "</s>"] if t and t.split() else []
        assert abs(got[i].log10_prob - sum(math.log10(p(*w[k - 2 : k + 1])) for k in range(2, len(w)))) < 1e-6


def test_turns_go_by_text_and_not_by_its_files(spark, monkeypatch):
    """Texts that files hold in far fewer bytes are still counted a share at a time, with the same counts."""
    for name in ("ROUND_BYTES", "TURN_BYTES"):
        monkeypatch.setattr(Q, name, 100_000, raising=False)
    seen, plain = [], Q._grams
    monkeypatch.setattr(Q, "_grams", lambda n, turn, turns: seen.append((turn, turns)) or plain(n, turn, turns))
    texts = Q.stored(spark.range(60).selectExpr("concat('word', id, repeat(' a b c', 1000)) as text"), "texts")
    model = Q.counted(texts)
    assert seen == [(k, 4) for k in range(4)]
    assert model.formula.kinds == 60 + 3 + 1
