import hashlib
import random
import re

from factlane.llm import decontaminate as D

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, window=10):
    wanted = {}
    for item, text in items:
        w = _words(text)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            wanted.setdefault(tuple(w[i : i + window]), set()).add(item)
    sizes = {len(k) for k in wanted}
    out = []
    for doc, text in docs:
        w = _words(text)
        hit, found = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (k := tuple(w[i : i + n])) in wanted:
                    hit.update(range(i, i + n))
                    found |= wanted[k]
        out.append((doc, len(w), len(hit), sorted(found)))
    return out


def rows(df):
    return sorted((r.doc_id if r.doc_id is not None else -1, r.n_words, r.n_hit, sorted(r["items"])) for r in df.collect())


def test_fixture_against_brute_force(spark):
    t = "one two three four five six seven eight nine ten eleven twelve"
    docs = [(1, f"x, y. {t.upper()}!"), (2, None), (3, ""), (4, "short item"), (4, "short item"), (None, t),
            (6, "one two three four five six seven eight nine"), (7, ("a " * 3000) + t + " " + t), (8, "é-ß short\nITEM 5x")]
    items = [(10, t), (2, "Short item"), (3, None), (4, "a a a a a a a a a a a"), (5, "...")]
    d = spark.createDataFrame([(i, x, "clash", 5) for i, x in docs], "doc_id long, text string, items string, n_words int")
    b = spark.createDataFrame(items, "item_id long, text string")
    want = sorted((-1 if i is None else i, n, h, f) for i, n, h, f in brute(docs, [(str(i), x) for i, x in items]))
    assert rows(D.contamination(d, b)) == want
    assert rows(D.contamination(d, b, block_bytes=40)) == want
    assert rows(D.contamination(d, b.limit(0))) == sorted((-1 if i is None else i, n, 0, []) for i, n, _, _ in brute(docs, []))
    assert D.contamination(d.limit(0), b).count() == 0


def brute_near(docs, items, window=10, slop=5):
    """The words in runs that hold all words of a window and are short enough, for each document."""
    wanted = set()
    for _, text in items:
        w = _words(text)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            part = w[i : i + window]
            wanted.add((frozenset(part), len(part) + slop * len(part) // window))
    out = []
    for _, text in docs:
        w, near = _words(text), set()
        for terms, most in wanted:
            if not terms <= set(w):
                continue
            for i in range(len(w)):
                if w[i] in terms:
                    for n in range(len(terms), most + 1):
                        if i + n <= len(w) and terms <= set(w[i : i + n]):
                            near.update(range(i, i + n))
                            break
        out.append(len(near))
    return out


def test_proximity(spark):
    d = spark.createDataFrame([(1, "p q r alpha x beta y gamma"), (2, "gamma beta alpha"), (3, "alpha " + "z " * 50 + "beta gamma")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")
    got = {r.doc_id: (r.n_hit, r.n_near) for r in D.contamination(d, b, window=3, slop=4).collect()}
    assert got == {1: (0, 5), 2: (0, 3), 3: (0, 0)}


def test_proximity_against_brute_force(spark):
    """Small vocabularies, repeated rows and items, and a benchmark in one block or in many: always the same."""
    rng = random.Random(2)
    text = lambda n: " ".join(rng.choice("abcdefg") for _ in range(n))
    docs = [(i, text(rng.randrange(0, 40))) for i in range(60)] + [(7, "a b c d e f g a b"), (100, None)]
    docs += docs[:5]
    items = [(i, text(rng.randrange(0, 9))) for i in range(12)] + [(3, "g f e d c")]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    want = sorted(zip([i for i, _ in docs], [x[2] for x in brute(docs, items, 4)], brute_near(docs, items, 4, 3), strict=True))
    for limit in (1 << 20, 30):
        got = D.contamination(d, b, window=4, slop=3, block_bytes=limit).collect()
        assert sorted((r.doc_id, r.n_hit, r.n_near) for r in got) == want
    assert any(near > hit > 0 for _, hit, near in want)


def test_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    near = brute_near(docs, items)
    want = sorted((i, n, h, len(f), hashlib.sha256(",".join(f).encode()).hexdigest(), h > 0, k) for (i, n, h, f), k in zip(brute(docs, items), near, strict=True))
    assert sorted(map(tuple, D.op5(spark, SF).collect())) == want
    assert any(x[2] for x in want)
