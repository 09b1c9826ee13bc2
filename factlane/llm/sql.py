"""DuckDB SQL for the queries that SQL can express, over the same tables; each runs on whole tables."""

from __future__ import annotations

from .decontaminate import SLOP
from .decontaminate import WINDOW as BENCHMARK
from .near import NGRAM, THRESHOLD
from .substrings import SIZE

SPACED = r"[^\x20\x09-\x0D]+"
WORDED = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Doublings of a window that the longest text of the tables can hold.
DOUBLINGS = 12


def substrings() -> str:
    """Windows by their joined words; a doubled window is known by the numbers of its halves."""
    levels = ["l0 AS (SELECT doc_id, pos, hash(k) AS id FROM win)"]
    for k in range(1, DOUBLINGS):
        half = SIZE * 2 ** (k - 1)
        levels.append(f"l{k} AS (SELECT doc_id, pos, hash(id, other) AS id FROM (SELECT doc_id, pos, id, lead(id, {half}) OVER (PARTITION BY doc_id ORDER BY pos) AS other FROM l{k - 1}) "
                      "WHERE other IS NOT NULL)")
    reached = " UNION ALL ".join(f"SELECT doc_id, {SIZE * 2**k} AS length FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY id) AS a, max(doc_id) OVER (PARTITION BY id) AS z FROM l{k}) WHERE a <> z"
                                 for k in range(DOUBLINGS))
    return f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{SPACED}') AS w FROM documents),
win AS (SELECT doc_id, pos, array_to_string(w[pos : pos + {SIZE - 1}], ' ') AS k FROM d, unnest(range(1, len(w) - {SIZE - 2})) AS t(pos)),
{", ".join(levels)},
longest AS (SELECT doc_id, max(length) AS longest_repeat FROM ({reached}) GROUP BY doc_id),
late AS (SELECT doc_id, pos FROM (SELECT doc_id, pos, min(doc_id) OVER (PARTITION BY k) AS least FROM win) WHERE least < doc_id),
gone AS (SELECT DISTINCT doc_id, pos + o AS pos FROM late, range({SIZE}) AS t(o)),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM d),
kept AS (SELECT words.doc_id, count(gone.pos) AS n_removed, string_agg(CASE WHEN gone.pos IS NULL THEN word END, ' ' ORDER BY words.pos) AS kept
  FROM words LEFT JOIN gone ON words.doc_id = gone.doc_id AND words.pos = gone.pos GROUP BY words.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256, CAST(coalesce(longest_repeat, 0) AS BIGINT) AS longest_repeat
FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id LEFT JOIN longest ON d.doc_id = longest.doc_id"""


def decontamination() -> str:
    """Exact windows by their joined words; proximity from the windows' rarest words, each start word by word."""
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    n = BENCHMARK
    return f"""
WITH d AS (SELECT doc_id, regexp_extract_all({lower}, '{WORDED}') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({lower}, '{WORDED}') AS w FROM benchmark),
win AS (SELECT DISTINCT item, least(len(w), {n}) AS size, w[pos : pos + {n - 1}] AS part FROM b, unnest(range(1, greatest(len(w) - {n - 2}, 2))) AS t(pos) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT size FROM win),
runs AS (SELECT doc_id, pos, size, array_to_string(w[pos : pos + size - 1], ' ') AS k FROM d, sizes, unnest(range(1, len(w) - size + 2)) AS t(pos)),
found AS (SELECT doc_id, pos, runs.size, item FROM runs JOIN (SELECT item, size, array_to_string(part, ' ') AS k FROM win) AS win ON runs.size = win.size AND runs.k = win.k),
hit AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, pos + o AS pos FROM (SELECT DISTINCT doc_id, pos, size FROM found), unnest(range(size)) AS t(o)) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM d),
wide AS (SELECT row_number() OVER () AS wid, terms, size + {SLOP} * size // {n} AS most FROM (SELECT DISTINCT list_sort(list_distinct(part)) AS terms, size FROM win)),
term AS (SELECT wid, unnest(terms) AS word, len(terms) AS many, most FROM wide),
often AS (SELECT word, count(*) AS n FROM words WHERE word IN (SELECT word FROM term) GROUP BY word),
rare AS (SELECT wid, word, most FROM (SELECT wid, term.word, most, row_number() OVER (PARTITION BY wid ORDER BY coalesce(n, 0), term.word) AS r FROM term LEFT JOIN often ON term.word = often.word) WHERE r = 1),
near_by AS (SELECT wid, words.doc_id, words.pos AS anchor, rare.most FROM rare JOIN words ON rare.word = words.word),
around AS (SELECT wid, doc_id, anchor, most, anchor + o AS pos FROM near_by, unnest(range(1 - most, most)) AS t(o)),
there AS (SELECT a.wid, a.doc_id, a.anchor, a.most, a.pos, words.word, term.many FROM around AS a JOIN words ON a.doc_id = words.doc_id AND a.pos = words.pos
  JOIN term ON a.wid = term.wid AND words.word = term.word),
likely AS (SELECT wid, doc_id, anchor FROM there GROUP BY wid, doc_id, anchor HAVING count(DISTINCT word) = max(many)),
close AS (SELECT there.* FROM there JOIN likely ON there.wid = likely.wid AND there.doc_id = likely.doc_id AND there.anchor = likely.anchor),
ends AS (SELECT s.wid, s.doc_id, s.anchor, s.pos AS first, e.word, min(e.pos) AS pos, max(s.many) AS many FROM close AS s JOIN close AS e
  ON s.wid = e.wid AND s.doc_id = e.doc_id AND s.anchor = e.anchor AND e.pos >= s.pos AND e.pos < s.pos + s.most GROUP BY ALL),
short AS (SELECT DISTINCT doc_id, first, max(pos) AS last FROM ends GROUP BY wid, doc_id, anchor, first HAVING count(*) = max(many)),
close_words AS (SELECT doc_id, count(*) AS n_near FROM (SELECT DISTINCT doc_id, unnest(range(first, last + 1)) AS pos FROM short) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near, 0) AS n_near
FROM d LEFT JOIN hit ON d.doc_id = hit.doc_id LEFT JOIN items ON d.doc_id = items.doc_id LEFT JOIN close_words ON d.doc_id = close_words.doc_id"""


def near() -> str:
    """All pairs of texts that share a gram, on their full sets; classes by the smallest label that a row can reach."""
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{SPACED}') AS w FROM documents),
grams AS (SELECT DISTINCT doc_id, array_to_string(w[pos : pos + {NGRAM - 1}], ' ') AS g FROM d, unnest(range(1, greatest(len(w) - {NGRAM - 2}, 2))) AS t(pos) WHERE len(w) > 0),
sets AS (SELECT doc_id, count(*) AS n, sha256(string_agg(g, chr(10) ORDER BY g)) AS node FROM grams GROUP BY doc_id),
nodes AS (SELECT node, any_value(n) AS n, count(*) AS copies, min(doc_id) AS doc FROM sets GROUP BY node),
held AS (SELECT doc, g FROM nodes JOIN grams ON nodes.doc = grams.doc_id),
shared AS (SELECT a.doc AS a, b.doc AS b, count(*) AS common FROM held AS a JOIN held AS b ON a.g = b.g AND a.doc <> b.doc GROUP BY a.doc, b.doc),
links AS (SELECT a, b, y.copies AS copies FROM shared JOIN nodes AS x ON a = x.doc JOIN nodes AS y ON b = y.doc WHERE common >= {THRESHOLD} * (x.n + y.n - common) - 1e-9),
reach(a, label) AS (SELECT doc, doc FROM nodes UNION SELECT links.b, reach.label FROM reach JOIN links ON reach.a = links.a WHERE reach.label < links.b),
class AS (SELECT a, min(label) AS label FROM reach GROUP BY a),
degree AS (SELECT a, sum(copies) AS links FROM links GROUP BY a)
SELECT d.doc_id, coalesce(class.label, d.doc_id) AS class_id, CAST(coalesce(degree.links, 0) + coalesce(nodes.copies, 1) - 1 AS BIGINT) AS n_links, coalesce(nodes.copies, 1) AS n_copies
FROM d LEFT JOIN sets ON d.doc_id = sets.doc_id LEFT JOIN nodes ON sets.node = nodes.node LEFT JOIN class ON nodes.doc = class.a LEFT JOIN degree ON nodes.doc = degree.a"""


SQL: dict[str, str] = {"op5_decontamination": decontamination(), "op6_substring_dedup": substrings(), "op9_jaccard_join": near()}
