import corpus_pipeline as P
from tests.llm import test_decontaminate, test_mixture, test_near, test_substrings

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    kept = []
    for k, (name, stage) in enumerate(P.STAGES):
        before = [(r.doc_id, r.text) for r in docs.collect()]
        held = docs
        docs = P.stored(stage(spark, docs, SF), "test")
        if k < 4:
            assert docs.columns == P.COLUMNS
            after = {r.doc_id: r.text for r in docs.collect()}
            kept.append(len(after))
        if k == 0:
            assert len(after) >= 0.95 * len(before)
        elif k == 1:
            assert sorted(after) == sorted({x[1] for x in test_near.brute(before)})
        elif k == 2:
            want = {i: (n, g, t) for i, n, g, t in test_substrings.brute(before)}
            assert sorted(after) == sorted(i for i, (n, g, _) in want.items() if g < n or not g)
            assert all(" ".join(after[i].split()) == " ".join(want[i][2].split()) for i in after)
        elif k == 3:
            assert sorted(after) == sorted(i for i, _, hit, _ in test_decontaminate.brute(before, items) if not hit)
        else:
            source = {r.doc_id: r.source for r in held.collect()}
            test_mixture.check([(i, t, source[i]) for i, t in before], docs.collect(), lambda t: 0.06 * t + 256)
    assert kept[0] > kept[1] and kept[2] > kept[3]


def test_empty_and_odd_rows(spark):
    rows = [(1, "the house and the garden " * 9, "en", "a", 5), (1, "the house and the garden " * 9, "en", "a", 5), (None, None, None, None, None),
            (2, "", "en", None, 0), (None, "les maisons dans la rue de la ville " * 4, "fr", None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for start in (docs, docs.limit(0)):
        now = start
        for _, stage in P.STAGES:
            now = P.stored(stage(spark, now, SF), "odd")
        assert sorted((r.doc_id is None, r.size) for r in now.select("doc_id", "size").collect()) == ([(False, 45), (True, 32)] if start is docs else [])


def test_run(spark):
    assert P.run(spark, SF).columns == ["doc_id", "source", "size", "source_size", "target", "taken"]
