import random
import re

import numpy as np

from factlane.llm import tokens as K

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text, vocabulary, memo):
    n = f = 0
    for w in WORD.findall(text or ""):
        if w not in memo:
            memo[w] = K.count_one(K.MARK + w.encode(), vocabulary)
        n, f = n + memo[w][0], f + memo[w][1]
    return n, f


def test_recursion_against_all_segmentations():
    v = K.Vocabulary([b"ab", b"a", b"abc", b"c", b"bc", b"d\xc3\xa9"])

    def best(word):
        if not word:
            return (0.0, 0, 0)
        s, t, f = best(word[:-1])
        options = [(s + v.byte, t - 1, f - 1)]
        for k in range(1, len(word) + 1):
            if word[-k:] in v.score:
                s, t, f = best(word[:-k])
                options.append((s + v.score[word[-k:]], t - 1, f))
        return max(options)

    rng = random.Random(1)
    words = sorted({bytes(rng.choice(b"abcd\xc3\xa9") for _ in range(rng.randrange(1, 9))) for _ in range(200)})
    want = [(-best(w)[1], -best(w)[2]) for w in words]
    assert [K.count_one(w, v) for w in words] == want
    sizes = np.array([len(w) for w in words])
    data = np.frombuffer(b"".join(words), np.uint8)
    rng.shuffle(at := list(range(len(words))))
    got = K.count_trie(data, (np.cumsum(sizes) - sizes)[at], sizes[at], v)
    assert list(map(tuple, got.tolist())) == [want[k] for k in at]


def test_words_of_all_lengths_in_one_trie():
    """Long words that share prefixes, words that end where others go on, and the few that go on alone."""
    v = K.load()
    rng = random.Random(4)
    words = sorted({"".join(rng.choice("thering漢é") for _ in range(rng.choice((1, 2, 3, 5, 9, 40, 150)))) for _ in range(300)} | {"there" * 300 + str(k) for k in range(40)} | {"the" * 2000})
    raw = [K.MARK + w.encode() for w in words]
    sizes = np.array([len(w) for w in raw])
    got = K.count_trie(np.frombuffer(b"".join(raw), np.uint8), np.cumsum(sizes) - sizes, sizes, v)
    assert list(map(tuple, got.tolist())) == [K.count_one(w, v) for w in raw]


def test_fixture(spark):
    v = K.load()
    docs = [(1, "The quick brown fox"), (2, None), (3, ""), (4, " \n"), (None, "naïve Straße 漢字"), (5, "x" * 5000 + " y"), (6, "the " * 20000), (6, "the " * 20000),
            (7, "\x00a \x00 a\x00"), (8, "🙂" * 40)]
    d = spark.createDataFrame([(i, t, 1, "n") for i, t in docs], "doc_id long, text string, n_words int, n_tokens string")
    memo = {}
    want = sorted((-1 if i is None else i, len((t or "").encode()), len(WORD.findall(t or "")), *brute(t, v, memo)) for i, t in docs)
    assert sorted((-1 if r[0] is None else r[0], *r[1:]) for r in K.token_counts(d, v).collect()) == want
    assert K.token_counts(d.limit(0), v).count() == 0


def test_query(spark):
    v, memo = K.load(), {}
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in K.op8(spark, SF).collect():
        assert (r.n_tokens, r.n_fallback) == brute(docs[r.doc_id], v, memo)
        assert (r.n_bytes, r.n_words) == (len(docs[r.doc_id].encode()), len(WORD.findall(docs[r.doc_id])))
