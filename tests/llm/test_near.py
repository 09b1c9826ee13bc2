import random
import re

import pytest

from factlane.llm import near as N
from factlane.llm import storage as S

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def grams(text, n=5):
    w = WORD.findall(text or "")
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute(docs, threshold=0.8):
    sets = [grams(t) for _, t in docs]
    root = list(range(len(docs)))
    links, copies = [0] * len(docs), [1] * len(docs)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]) - 1e-9:
                root[find(i)] = find(j)
                links[i] += 1
                links[j] += 1
                if sets[i] == sets[j]:
                    copies[i] += 1
                    copies[j] += 1
    least = {}
    big = float("inf")
    for i, (doc, _) in enumerate(docs):
        least[find(i)] = min(least.get(find(i), big), big if doc is None else doc)
    return sorted((-1 if d is None else d, -1 if least[find(i)] == big else least[find(i)], links[i], copies[i]) for i, (d, _) in enumerate(docs))


def rows(df):
    return sorted(tuple(-1 if x is None else x for x in r) for r in df.select("doc_id", "class_id", "n_links", "n_copies").collect())


def test_band_plan():
    bands, rows = N.band_plan(0.8, 0.9999)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.9999 and bands * rows <= 160
    assert N.band_plan(1.0, 0.99) == (1, 32)
    bands, rows = N.band_plan(0.2, 0.9999)
    assert 1 - (1 - 0.2**rows) ** bands >= 0.9999
    with pytest.raises(ValueError):
        N.band_plan(0.01, 0.9999)


def test_repeated_rows_of_one_id_bring_one_pair(spark, monkeypatch):
    """10,000 rows without an id hold two texts: their sets are compared once, whatever the rows."""
    one, two = " ".join(f"w{k}" for k in range(200)), " ".join(f"w{k}" for k in range(201))
    d = spark.range(10_000).selectExpr("cast(null as long) as doc_id", f"if(id % 2 = 0, '{one}', '{two}') as text")
    seen, verified = [], N.verified
    monkeypatch.setattr(N, "verified", lambda pairs, sets: seen.append((pairs.count(), sets.count())) or verified(pairs, sets))
    got = N.jaccard_join(d).groupBy("class_id", "n_links", "n_copies").count().collect()
    assert [tuple(r) for r in got] == [(None, 9999, 5000, 10_000)]
    assert seen[0] == (1, 2)


def test_nothing_is_left_of_the_steps_between(spark):
    S.clean(spark)
    d = spark.createDataFrame([(i, f"a b c d e f g h {i // 2}") for i in range(20)], "doc_id long, text string")
    assert N.jaccard_join(d).count() == 20
    assert len(S._MADE) <= 2
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("factlane")]


def test_fixture_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 7)
    monkeypatch.setattr(N, "SMALL", 3)
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(4))
    base = [[word() for _ in range(120)] for _ in range(4)]
    docs = []
    for i in range(90):
        w = list(base[i % 4])
        for _ in range(rng.randrange(7)):
            w[rng.randrange(len(w))] = word()
        docs.append((i, " ".join(w)))
    docs += [(200, None), (201, ""), (202, " \n"), (203, "two words"), (204, "two  words"), (205, "two"), (206, docs[0][1]), (206, docs[0][1]),
             (None, docs[1][1]), (None, "only null"), (None, "only null"), (207, "x " * 3000), (208, "x " * 2000)]
    d = spark.createDataFrame([(i, t, i, "n") for i, t in docs], "doc_id long, text string, class_id long, node string").repartition(3)
    got, want = rows(N.jaccard_join(d)), brute(docs)
    assert got == want
    assert max(x[2] for x in want) > 3
    kept = N.keep_one(d, N.jaccard_join(d)).collect()
    empty = {i for i, t in docs if not grams(t)}
    assert len(kept) == len({x[1] for x in want if x[0] not in empty and x[1] >= 0}) + len(empty) + 1  # the class of the null ids
    assert N.jaccard_join(d.limit(0)).count() == 0


def test_left_over_buckets(spark):
    """Bucket mates that do not match their leader are still compared with each other."""
    rng = random.Random(9)
    shared = [f"s{k}" for k in range(60)]
    docs = []
    for i in range(24):
        own = [f"w{i // 2}x{k}" for k in range(28)]
        docs.append((i, " ".join(shared + own + ([f"z{rng.random()}"] if i % 2 else []))))
    d = spark.createDataFrame(docs, "doc_id long, text string")
    assert rows(N.jaccard_join(d)) == brute(docs)


def test_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert rows(N.op9(spark, SF)) == brute(docs)
