import math
import re
from collections import defaultdict

from factlane.llm import urls as U
from factlane.llm.storage import hot_join

SF = "/root/testdata/sf0.001"


def parse(url):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    return ("".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]), m[2]) if m else ("", "")


def brute(urls, rules=U.RULES):
    """(host, path, rule, verdict, template) for each url."""
    rows = []
    for u in urls:
        h, p = parse(u)
        fit = [(v, a, b) for v, a, b in rules if (h == a or h.endswith("." + a)) and p.startswith(b)]
        best = max(fit, key=lambda r: len(r[1] + r[2]), default=None)
        rows.append([h, p, best and best[1] + best[2], best and best[0]])
    template = {(h, p): "" for h, p, _, _ in rows}
    segments = {(h, p): [s for s in p.split("/") if s] for h, p in template}
    count = defaultdict(lambda: [0, 0, 0])
    for h, p, _, v in rows:
        for k, x in enumerate((1, v == "block", v is not None)):
            count[h, p][k] += x
    shape = lambda s: re.sub(r"[^\W\d_]+", "a", re.sub("[0-9]+", "9", s))
    for d in range(max(map(len, segments.values()), default=0)):
        child, kind = defaultdict(lambda: [0, 0, 0]), defaultdict(lambda: [0, 0, 0, 0])
        for k, s in segments.items():
            if len(s) > d:
                for i in range(3):
                    child[k[0], template[k], s[d]][i] += count[k][i]
        for (h, t, s), (n, b, lab) in child.items():
            x = kind[h, t, shape(s)]
            x[0] += 1
            x[1] += n
            if lab >= U.LABELS:
                x[2] += b
                x[3] += lab
        new = {}
        for k, s in segments.items():
            if len(s) <= d:
                continue
            (n, b, lab), (kinds, pages, ab, al) = child[k[0], template[k], s[d]], kind[k[0], template[k], shape(s[d])]
            step = s[d]
            if kinds >= U.MANY and ("9" in shape(s[d]) or kinds > U.VARIED * pages):
                step = f"<{shape(s[d])}>"
            elif lab >= U.LABELS and al > lab:
                p = ab / al
                if abs(b / lab - (ab - b) / (al - lab)) <= U.Z * math.sqrt(p * (1 - p) * (1 / lab + 1 / (al - lab))):
                    step = "{" + shape(s[d]) + "}"
            new[k] = template[k] + "/" + step
        template |= new
    sums = defaultdict(lambda: [0, 0])
    for k, (_, b, lab) in count.items():
        sums[k[0], template[k]][0] += b
        sums[k[0], template[k]][1] += lab
    out = []
    for h, p, r, v in rows:
        b, lab = sums[h, template[h, p]]
        out.append((h, p, r, v or ("block" if (b + U.PRIOR) / (lab + 2 * U.PRIOR) >= U.PURE else "allow"), template[h, p]))
    return out


def compare(spark, rows, rules=U.RULES):
    d = spark.createDataFrame([(i, u, "clash", "x") for i, u in rows], "page_id long, url string, host string, verdict string")
    got = sorted((r.page_id or -1, r.host, r.path, r.rule or "", r.verdict, r.template) for r in U.judge(d, rules).collect())
    want = sorted((i or -1, h, p, r or "", v, t) for (i, _), (h, p, r, v, t) in zip(rows, brute([u for _, u in rows], rules)))
    assert got == want
    return got


def test_fixture_against_brute_force(spark):
    urls = [None, "", "no scheme/en/1", "http://", "HTTP://A.Example.COM/en/7#x", "http://a.example.com/en/8?q=http://b.org/es/", "x://y.org/es/é\n/1",
            "http://notexample.com/en/71", "http://example.net/de/81", "http://ÄB.net/de/9", "ftp://com/en/", "http://h.org//es//1", "http://z.net/" + "d/" * 30]
    urls += [f"http://s.example.com/{a}/{i}{e}" for a in ("en", "fr", "en-gb") for i in range(12) for e in ("", ".html")]
    urls += [f"http://s.example.com/shop/{a}/{i}" for a in ("up", "down", "strange") for i in range(4)]
    urls += [f"http://m.org/es/{i % 5}" for i in range(30)] + ["http://hot.com/fr/same"] * 40
    rows = [(i, u) for i, u in enumerate(urls)] + [(3, "http://a.com/en/1"), (None, "http://a.com/en/1")]
    got = compare(spark, rows)
    assert any("<9>" in r[5] for r in got)


def test_deep_paths(spark):
    """Nine segments: the branches differ at the first and the last alone, and labels don't cross over."""
    rules = [("block", "x.com", f"/bad/b/c/d/e/f/g/h/{i}") for i in range(1, 9)]
    urls = [f"http://x.com/{a}/b/c/d/e/f/g/h/{i}" for a in ("bad", "good") for i in range(12)] + ["http://x.com/bad/b/c", "http://x.com/" + "s/" * 300]
    got = compare(spark, list(enumerate(urls)), rules)
    assert {r[4] for r in got if r[2].startswith("/bad/b/c/d")} == {"block"} and {r[4] for r in got if r[2].startswith("/good")} == {"allow"}


def test_rules_of_one_length(spark):
    rules = [("allow", "a.com", "/x"), ("block", "a.com", "/x"), ("block", "a.com", "/y"), ("allow", "com", "/x/zz")]
    compare(spark, list(enumerate(["http://a.com/x", "http://a.com/x/zz", "http://a.com/y", "http://b.a.com/x1"])), rules)


def test_hot_keys_do_not_change_the_join(spark):
    big = spark.range(5000).selectExpr("case when id % 3 = 0 then null when id % 3 = 1 then 7 else id end as k", "id as x").where("k is not null")
    small = big.select("k").distinct().where("k % 2 = 1").selectExpr("k", "k * 2 as y")
    for how in ("inner", "left"):
        assert sorted(map(str, hot_join(big, small, ["k"], how).collect())) == sorted(map(str, big.join(small, ["k"], how).collect()))


def test_templates_carry_labels(spark, monkeypatch):
    """Unlabelled pages of a template whose labelled ones are blocked are blocked; merged branches share labels."""
    monkeypatch.setattr(U, "RULES", [("block", "x.com", f"/p/{i}") for i in range(1, 9)])
    rows = [(i, f"http://x.com/p/{i}") for i in range(40)] + [(100 + i, f"http://x.com/about/{w}") for i, w in enumerate(("us", "team"))]
    d = spark.createDataFrame(rows, "page_id long, url string")
    got = {r.page_id: (r.rule is None, r.verdict) for r in U.judge(d, U.RULES).collect()}
    assert got[0] == (True, "block") and got[100] == (True, "allow")
    assert U.judge(d.limit(0)).count() == 0


def test_query(spark):
    rows = [(r.page_id, r.url) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    compare(spark, rows)
    assert U.op3(spark, SF).columns[:5] == ["page_id", "host", "path", "rule", "verdict"]
