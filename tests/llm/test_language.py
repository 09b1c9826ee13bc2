import itertools
import zlib

import numpy as np

from factlane.llm import language as L

SF = "/root/testdata/sf0.001"


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(1)
    counts = rng.integers(0, 7, 40)
    first = np.append(0, np.cumsum(counts))
    scores = rng.normal(0, 3, (first[-1], 3))
    path = L.label(scores, first, 2.0)

    def worth(p, s):
        return sum(s[i, x] for i, x in enumerate(p)) - 2.0 * sum(a != b for a, b in zip(p, p[1:]))

    for a, b in zip(first[:-1], first[1:]):
        s = scores[a:b]
        best = max((worth(p, s) for p in itertools.product(range(3), repeat=b - a)), default=0)
        assert abs(worth(path[a:b].tolist(), s) - best) < 1e-9


def test_spans_scripts_and_odd_rows(spark):
    en, fr, ru = "the house and the garden with thing", "les maisons sont dans la rue quelque", "это дом и сад который был"
    learn = spark.createDataFrame([(en * 5, "en"), (fr * 5, "fr"), (ru * 5, "ru"), (None, "xx"), ("zzz", None)], "text string, lang string")
    model = L.train(learn)
    assert model.langs == ["en", "fr", "ru"]
    mixed = " ".join([en] * 4 + [fr] * 5)
    docs = [(1, en), (2, mixed), (3, ru), (4, None), (5, ""), (6, "123 456 !?"), (7, "сад the"), (None, fr), (8, fr), (8, fr), (9, "😀 😀"), (10, "the " * 50000)]
    d = spark.createDataFrame([(i, t, "clash", "en") for i, t in docs], "doc_id long, text string, score string, lang string")
    got = {r.doc_id: r for r in L.identify(d, model).collect()}
    assert L.identify(d, model).columns == ["doc_id", "text", "lang", "lang_pred", "score", "spans"]
    assert [got[i].lang_pred for i in (1, 2, 3, 4, 5, 6, 8, 9, 10, None)] == ["en", "fr", "ru", "und", "und", "und", "fr", "und", "en", "fr"]
    assert [s.lang for s in got[2].spans] == ["en", "fr"] and got[2].spans[0].end == 28
    assert [s.lang for s in got[7].spans] == ["ru", "en"]
    assert all(0 <= r.score <= 1 for r in got.values()) and got[4].score == 0
    nothing = L.train(learn.limit(0))
    assert {r.lang_pred for r in L.identify(d, nothing).collect()} == {"und"}
    assert L.identify(d.limit(0), model).count() == 0


def test_query_on_held_out(spark):
    truth = {r.doc_id: (r.lang, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = L.op4(spark, SF).collect()
    assert len(got) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    test = [r for r in got if r.held_out]
    right = sum(r.lang_pred == truth[r.doc_id][0] for r in test)
    assert test and right >= 0.97 * len(test), [(r.doc_id, r.lang_pred, truth[r.doc_id]) for r in test if r.lang_pred != truth[r.doc_id][0]]


def test_a_language_that_neither_half_is_in():
    b, k = np.zeros(6), np.array([3.0, 3, 3, -10, -10, -10])
    assert L.label(np.column_stack([b, k, k[::-1]]), np.array([0, 6]), 12.0).tolist() == [1, 1, 1, 2, 2, 2]


def viterbi(scores, penalty):
    """(value, path) of the best path, a step at a time."""
    best, back = list(scores[0]), []
    for row in scores[1:]:
        top = max(range(len(row)), key=lambda j: best[j])
        back.append([j if best[j] >= best[top] - penalty else top for j in range(len(row))])
        best = [max(best[j], best[top] - penalty) + row[j] for j in range(len(row))]
    at = max(range(len(best)), key=lambda j: best[j])
    path = [at]
    for step in reversed(back):
        path.append(step[path[-1]])
    return max(best), path[::-1]


def test_viterbi_on_long_texts_and_many_languages():
    rng = np.random.default_rng(5)
    counts = rng.integers(20, 200, 120)
    first = np.append(0, np.cumsum(counts))
    for spread in (0.5, 2.0, 6.0):
        truth = np.repeat(rng.integers(0, 5, first[-1] // 7 + 1), 7)[: first[-1]]
        scores = rng.normal(0, spread, (first[-1], 5))
        scores[np.arange(first[-1]), truth] += spread
        path = L.label(scores, first, 12.0)
        for a, b in zip(first[:-1], first[1:]):
            worth = scores[np.arange(a, b), path[a:b]].sum() - 12.0 * np.count_nonzero(path[a + 1 : b] != path[a : b - 1])
            assert abs(worth - viterbi(scores[a:b], 12.0)[0]) < 1e-6


def brute_word(model, word, allowed):
    if word.isdigit():
        return [0.0] * len(model.langs)
    data = b" " + word + b" "
    hashed = [((data[i - 1] << 16 | data[i] << 8 | data[i + 1]) * 2654435761 % 2**32) >> 16 for i in range(1, len(data) - 1)]
    return [sum(model.scores[k][h] for h in hashed) - (0 if ok else 1e4) for k, ok in enumerate(allowed)]


def test_query_against_brute_force(spark):
    """Every row of the query: words, scores, the best path, the vote and the certainty from their definitions."""
    docs = [r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    model = L.train(spark.read.parquet(f"{SF}/documents.parquet").where(~L.held_out(L.F.col("doc_id"))))
    got = {r.doc_id: r for r in L.op4(spark, SF).collect()}
    memo = {}
    for d in docs:
        data = "".join(c.lower() if "A" <= c <= "Z" else c for c in d.text or "").encode()
        words = bytes(32 if L.W.ALNUM[b] else b for b in data).split(b" ")
        words = [w for w in words if w]
        if not any(c.isalpha() for c in d.text or ""):
            assert (got[d.doc_id].lang_pred, got[d.doc_id].score) == ("und", 0)
            continue
        rows = []
        for w in words:
            if w not in memo:
                point = ord(w.decode()[0])
                script = L.SCRIPTS.index([s for a, s in L.RANGES if a <= point][-1])
                memo[w] = brute_word(model, w, model.allowed[:, script])
            rows.append(memo[w])
        value, path = viterbi(rows, L.PENALTY)
        votes = [path.count(k) for k in range(len(model.langs))]
        lead = max(votes)
        if votes.count(lead) > 1:
            continue
        best = votes.index(lead)
        mine = [r for r, p in zip(rows, path) if p == best]
        sums = [sum(r[k] for r in mine) for k in range(len(model.langs))]
        margin = min(30, max(-30, sums[best] - max(x for k, x in enumerate(sums) if k != best)))
        assert got[d.doc_id].lang_pred == model.langs[best]
        assert abs(got[d.doc_id].score - lead / len(words) / (1 + np.exp(-margin))) < 1e-6


def test_ties_go_to_the_smallest_name(spark):
    learn = spark.createDataFrame([("aaa bbb", "yy"), ("aaa bbb", "xx")], "text string, lang string")
    docs = spark.createDataFrame([(1, "aaa bbb ccc")], "doc_id long, text string")
    assert L.identify(docs, L.train(learn)).first().lang_pred == "xx"


def test_more_languages_than_the_table_holds_whole(spark):
    """600 languages in a table for 512: they share hashes and are still told apart."""
    rng = np.random.default_rng(3)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz"))
    texts = {f"l{k:03d}": " ".join("".join(rng.choice(letters, 7)) for _ in range(12)) for k in range(600)}
    docs = spark.createDataFrame([(k, t, x) for k, (x, t) in enumerate(texts.items())], "doc_id long, text string, lang string")
    model = L.train(docs, table=512 << 16)
    assert model.shift == 1 and len(model.langs) == 600 and model.scores.size <= 512 << 16
    got = L.identify(docs, model).collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.95
