import hashlib
import random
import re

from factlane.llm import substrings as S

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(docs, size=13):
    least = {}
    big = float("inf")
    for doc, text in docs:
        w = WORD.findall(text or "")
        for i in range(len(w) - size + 1):
            k = tuple(w[i : i + size])
            least[k] = min(least.get(k, big), big if doc is None else doc)
    out = []
    for doc, text in docs:
        w = WORD.findall(text or "")
        gone = set()
        for i in range(len(w) - size + 1):
            if least[tuple(w[i : i + size])] < (big if doc is None else doc):
                gone.update(range(i, i + size))
        out.append((-1 if doc is None else doc, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out)


def brute_longest(docs, size=13):
    """The longest of size and its doublings at which a window of a document also occurs in one of another id."""
    every, out, length = [(d, WORD.findall(t or "")) for d, t in docs], [0] * len(docs), size
    while any(len(w) >= length for _, w in every):
        where = {}
        for d, w in every:
            for i in range(len(w) - length + 1):
                where.setdefault(tuple(w[i : i + length]), set()).add(d)
        for k, (_, w) in enumerate(every):
            if any(len(where[tuple(w[i : i + length])]) > 1 for i in range(len(w) - length + 1)):
                out[k] = length
        length *= 2
    return sorted((-1 if d is None else d, x) for (d, _), x in zip(docs, out, strict=True))


def rows(df):
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.kept) for r in df.collect())


def test_fixture_against_brute_force(spark):
    rng = random.Random(5)
    word = lambda: rng.choice("abcdefgh") + rng.choice("xyzé")
    shared = [" ".join(word() for _ in range(n)) for n in (13, 20, 60, 300)]
    docs = [(i, " ".join([" ".join(word() for _ in range(rng.randrange(20))), rng.choice(shared), "\n\t", *(word() for _ in range(9))])) for i in range(80)]
    docs += [(100, None), (101, ""), (102, shared[0]), (102, shared[0]), (None, shared[1]), (None, shared[1]), (103, " \n"), (-5, shared[2] * 50), (104, "w " * 40)]
    d = spark.createDataFrame([(i, "c", t, i) for i, t in docs], "doc_id long, kept string, text string, rest long").repartition(3)
    for size in (13, 3):
        assert rows(S.dedup_substrings(d.select("doc_id", "text"), size, longest=size)) == brute(docs, size)
    clash = d.withColumns({"none": d.doc_id, "_": d.doc_id, "a.b": d.doc_id, "n_words": d.text}).select("none", "_", "`a.b`", "text", "kept", "n_words", "doc_id")
    assert S.dedup_substrings(clash, 13, longest=13).columns == ["none", "_", "a.b", "text", "doc_id", "n_words", "n_removed", "kept", "longest_repeat"]
    assert rows(S.dedup_substrings(clash, 13, longest=13, batch_bytes=700)) == brute(docs)
    full = S.dedup_substrings(d.drop("kept"), 13)
    assert full.columns == ["doc_id", "text", "rest", "n_words", "n_removed", "kept", "longest_repeat"]
    assert rows(full) == brute(docs)
    reach = sorted((-1 if r.doc_id is None else r.doc_id, r.longest_repeat) for r in full.collect())
    assert reach == brute_longest(docs) and max(reach, key=lambda r: r[1])[1] >= 208
    small = S.dedup_substrings(d.select("doc_id", "text"), 1, batch_bytes=900).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.longest_repeat) for r in small) == brute_longest(docs, 1)
    assert {r.rest for r in full.collect()} == {i for i, _ in docs}
    assert S.dedup_substrings(d.limit(0).drop("kept")).count() == 0


def test_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = [(i, n, g, hashlib.sha256(k.encode()).hexdigest()) for i, n, g, k in brute(docs)]
    got = S.op6(spark, SF).collect()
    assert sorted(tuple(r)[:4] for r in got) == want
    assert sorted((r.doc_id, r.longest_repeat) for r in got) == brute_longest(docs)
