"""Language identification of mixed-language text.

Training counts hashed byte trigrams (word bounds included) of each learned language, and in which scripts its
words are written.  The model is one table of TABLE numbers at most, whatever the corpus: with more than TABLE / 2**16
languages, neighbouring hashes share a number, the fewer for each language the more languages there are.
Prediction narrows each word's candidates by the script range of its first character, scores the
word by naive Bayes over its trigrams, and labels the words of a text by Viterbi with a constant penalty for a
change of language.  A text's language is the one with most labelled words (ties: the smallest name); its
score is that share times the certainty that the language beats the next one on its words.

Where no other language gains more than half a penalty over any run of words, the best path is constant (see
``label``); such texts are settled without stepping through their words.

A text of any length is judged whole.  A null or empty text, or one without a letter, is ``und`` with score 0, as is every text where nothing was
learned.  Rows without a lang are not learned from.  Repeated rows count again.  Other columns are carried along.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W
from .storage import stored

FEATURES = 1 << 16
TABLE = 1 << 25
PENALTY = 12.0
SMOOTH = 0.5
#: First code points of script ranges in order, with the script that begins there (0: none).
SCRIPTS = ["none", "latin", "greek", "cyrillic", "armenian", "hebrew", "arabic", "indic", "thai", "georgian", "hangul", "kana", "han", "other"]
RANGES = [
    (0x0000, "none"), (0x0041, "latin"), (0x005B, "none"), (0x0061, "latin"), (0x007B, "none"), (0x00AA, "latin"), (0x02B0, "none"),
    (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"), (0x0900, "indic"),
    (0x0E00, "thai"), (0x0E80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"),
    (0x1F00, "greek"), (0x2000, "none"), (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"),
    (0xD800, "none"), (0xF900, "han"), (0xFB00, "latin"), (0xFB1D, "hebrew"), (0xFB50, "arabic"), (0xFE00, "none"), (0x20000, "han"),
]
_FROM = np.array([a for a, _ in RANGES])
_SCRIPT = np.array([SCRIPTS.index(s) for _, s in RANGES])
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[0x30:0x3A] = True


def scripts(found: W.Words) -> np.ndarray:
    """The script of each word's first character."""
    data = np.append(found.data, np.zeros(4, np.uint8)).astype(np.int64)
    a, b, c, d = (data[found.starts + k] for k in range(4))
    point = np.select([a < 0x80, a < 0xE0, a < 0xF0], [a, (a & 31) << 6 | b & 63, (a & 15) << 12 | (b & 63) << 6 | c & 63],
                      (a & 7) << 18 | (b & 63) << 12 | (c & 63) << 6 | d & 63)
    return _SCRIPT[np.searchsorted(_FROM, point, "right") - 1]


def features(found: W.Words) -> np.ndarray:
    """The hashed trigram around each byte."""
    data = np.where(W.ALNUM[found.data], 0x20, found.data).astype(np.uint32)
    filled = np.flatnonzero(np.diff(found.texts))
    before = np.append(np.uint32(0x20), data[:-1])
    after = np.append(data[1:], np.uint32(0x20))
    before[found.texts[filled]] = 0x20
    after[found.texts[filled + 1] - 1] = 0x20
    with np.errstate(over="ignore"):
        return ((before << np.uint32(16) | data << np.uint32(8) | after) * np.uint32(2654435761)) >> np.uint32(16)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tables: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    for batch in W.blocks(batches, W.PIECE // 2):
        found = W.find(batch.column("text"), W.ALNUM, lower=True)
        hashed, script = features(found), scripts(found)
        inside = ~W.ALNUM[found.data]
        codes = batch.column("lang").dictionary_encode()
        per_doc = codes.indices.to_numpy(zero_copy_only=False)
        per_byte = np.repeat(per_doc, np.diff(found.texts))[inside]
        per_word = np.repeat(per_doc, found.counts())
        n = len(codes.dictionary)
        grams = np.bincount(per_byte * FEATURES + hashed[inside], minlength=n * FEATURES).reshape(n, FEATURES)
        kinds = np.bincount(per_word * len(SCRIPTS) + script, minlength=n * len(SCRIPTS)).reshape(n, len(SCRIPTS))
        for k, lang in enumerate(codes.dictionary.to_pylist()):
            if lang in tables:
                tables[lang][0][:] += grams[k]
                tables[lang][1][:] += kinds[k]
            else:
                tables[lang] = (grams[k].copy(), kinds[k].copy())
    for lang, (grams, kinds) in tables.items():
        both = np.append(grams, kinds)
        at = np.flatnonzero(both)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(both[at])],
                                         names=["lang", "feature", "n"])


class Model:
    def __init__(self, langs: list[str], counts: np.ndarray, shift: int = 0):
        """counts: languages x (features, then scripts); shift: bits of a feature's hash that are dropped."""
        self.langs, self.shift = langs, shift
        grams = counts[:, : FEATURES >> shift].astype(np.float64)
        used = max(1, int((grams.sum(axis=0) > 0).sum()))
        self.scores = np.log(grams + SMOOTH) - np.log(grams.sum(axis=1, keepdims=True) + SMOOTH * used)
        kinds = counts[:, FEATURES >> shift :].astype(np.float64)
        wrote = kinds >= 0.01 * np.maximum(kinds[:, 1:].sum(axis=1, keepdims=True), 1)
        wrote[:, 0] = True
        wrote[:, ~wrote.any(axis=0)] = True  # a script that nobody writes narrows nothing
        self.allowed = wrote


def train(docs: DataFrame, table: int = TABLE) -> Model:
    """From (text, lang) of rows with both."""
    rows = (docs.where("text is not null and lang is not null").select(F.col("text").cast("string"), F.col("lang").cast("string"))
            .mapInArrow(_count, "lang string, feature int, n bigint").groupBy("lang", "feature").agg(F.sum("n").alias("n")))
    rows = stored(rows, "language-counts")
    names = sorted(r["lang"] for r in rows.select("lang").distinct().collect())
    shift = 0
    while shift < 12 and len(names) * (FEATURES >> shift) > table:
        shift += 1
    width = FEATURES >> shift
    place = F.when(F.col("feature") < FEATURES, F.shiftright("feature", shift)).otherwise(F.col("feature") - FEATURES + width)
    told = rows.groupBy("lang", place.alias("feature")).agg(F.sum("n").alias("n"))
    counts = np.zeros((len(names), width + len(SCRIPTS)), np.int64)
    number = {x: k for k, x in enumerate(names)}
    got = told.groupBy("lang").agg(F.collect_list("feature").alias("features"), F.collect_list("n").alias("counts")).toArrow()  # two lists a language
    for lang, features_, n in zip(got.column("lang").to_pylist(), got.column("features"), got.column("counts"), strict=True):
        counts[number[lang], features_.values.to_numpy()] = n.values.to_numpy()
    return Model(names, counts, shift)


def word_scores(model: Model, found: W.Words) -> np.ndarray:
    """words x languages: log-likelihoods; other languages than a word's script allows are ruled out."""
    hashed = features(found) >> np.uint32(model.shift)
    out = np.empty((len(found), len(model.langs)))
    total = np.zeros(len(found.data) + 1)
    for k in range(len(model.langs)):
        np.cumsum(model.scores[k][hashed], out=total[1:])
        out[:, k] = total[found.ends] - total[found.starts]
    digits = np.append(0, np.cumsum(_DIGIT[found.data]))
    only = digits[found.ends] - digits[found.starts] == found.ends - found.starts
    out[only] = 0
    allowed = model.allowed[:, scripts(found)].T
    out[~allowed & ~only[:, None]] -= 1e4
    return out


def label(scores: np.ndarray, first: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """The language number of each word: the best path of each text."""
    n_docs, n_langs = len(first) - 1, scores.shape[1]
    counts = np.diff(first)
    total = np.zeros((len(scores) + 1, n_langs))
    np.cumsum(scores, axis=0, out=total[1:])
    sums = total[first[1:]] - total[first[:-1]]
    best = sums.argmax(axis=1) if n_docs else np.zeros(0, np.int64)
    path = np.repeat(best, counts)
    own = scores[np.arange(len(scores)), path]
    open_docs = np.zeros(n_docs, bool)
    doc = np.repeat(np.arange(n_docs), counts)
    filled = counts > 0
    for k in range(n_langs):
        # the largest gain of language k over the best one on any run of words of a text; m runs of other languages cost
        # m - 1 changes at least, so a path gains nothing where no run gains over half a penalty
        gain = np.cumsum(scores[:, k] - own)
        before = np.append(0, gain[:-1]) if len(gain) else gain
        step = (gain.max(initial=0) - gain.min(initial=0)) + 1.0
        low = np.minimum.accumulate(before - doc * step) + doc * step
        most = np.maximum.reduceat(gain - low, first[:-1][filled]) if filled.any() else np.zeros(0)
        open_docs[np.flatnonzero(filled)[most > penalty / 2]] = True
    todo = np.flatnonzero(open_docs)
    if not len(todo):
        return path
    todo = todo[np.argsort(-counts[todo], kind="stable")]
    left = counts[todo]
    back = np.zeros((len(scores) if len(todo) else 0, n_langs), bool)  # reached by a change
    top = np.zeros(len(scores), np.int32)  # from which language
    now = scores[first[todo]].copy()
    for t in range(1, int(left[0])):
        k = int(np.searchsorted(-left, -t, "left"))
        at = first[todo[:k]] + t
        source = now[:k].argmax(axis=1)
        change = now[np.arange(k), source][:, None] - penalty
        back[at] = change > now[:k]
        top[at] = source
        now[:k] = np.maximum(now[:k], change) + scores[at]
    state = now.argmax(axis=1)
    for t in range(int(left[0]) - 1, -1, -1):
        k = int(np.searchsorted(-left, -t, "left"))
        at = first[todo[:k]] + t
        path[at] = state[:k]
        if t:
            state[:k] = np.where(back[at, state[:k]], top[at], state[:k])
    return path


def _has_letter(texts: pa.Array, found: W.Words) -> np.ndarray:
    seen = np.append(0, np.cumsum(_LETTER[found.data]))[found.texts]
    out = np.diff(seen) > 0
    for i in np.flatnonzero(~out & (found.counts() > 0)):
        out[i] = any(c.isalpha() for c in texts[int(i)].as_py() or "")
    return out


def judge(model: Model, texts: pa.Array, penalty: float = PENALTY) -> tuple[list[str], np.ndarray, list[list[dict]]]:
    """For each text: its language, the score, and the spans of words (start, end, lang)."""
    n = len(texts)
    names, certain, spans = ["und"] * n, np.zeros(n), [[] for _ in range(n)]
    if not model.langs or not n:
        return names, certain, spans
    column = pa.RecordBatch.from_arrays([texts], names=["text"])
    parts, firsts, letters, at = [], [np.zeros(1, np.int64)], [], 0
    for block in W.blocks(iter([column]), W.PIECE // 2):
        found = W.find(block.column(0), W.ALNUM, lower=True)
        parts.append(word_scores(model, found))
        firsts.append(found.first[1:] + at)
        letters.append(_has_letter(block.column(0), found))
        at += len(found)
    scores, first, letter = np.concatenate(parts), np.concatenate(firsts), np.concatenate(letters)
    path = label(scores, first, penalty)
    n_langs = len(model.langs)
    doc = np.repeat(np.arange(n), np.diff(first))
    votes = np.bincount(doc * n_langs + path, minlength=n * n_langs).reshape(n, n_langs)
    chosen = votes.argmax(axis=1)
    share = votes[np.arange(n), chosen] / np.maximum(np.diff(first), 1)
    mine = path == chosen[doc]
    sums = np.zeros((n, n_langs))
    for k in range(n_langs):
        sums[:, k] = np.bincount(doc, weights=np.where(mine, scores[:, k], 0), minlength=n)
    lead = sums[np.arange(n), chosen]
    sums[np.arange(n), chosen] = -np.inf
    margin = np.clip(lead - sums.max(axis=1), -30, 30) if n_langs > 1 else np.full(n, 30.0)
    score = share / (1 + np.exp(-margin))
    cut = np.flatnonzero(np.append(True, (path[1:] != path[:-1]) | (doc[1:] != doc[:-1]))) if len(path) else np.zeros(0, np.int64)
    for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(path)], strict=False):
        d = doc[a]
        if letter[d]:
            spans[d].append({"start": a - int(first[d]), "end": b - int(first[d]), "lang": model.langs[path[a]]})
    for i in np.flatnonzero(letter):
        names[i] = model.langs[chosen[i]]
    return names, np.where(letter, np.clip(score, 0, 1), 0.0), spans


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("lang", T.StringType())]))
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))


def identify(docs: DataFrame, model: Model, penalty: float = PENALTY, with_text: bool = True) -> DataFrame:
    """docs' columns (but text, where that isn't wanted), then lang_pred, score and spans, which replace columns of these names."""
    taken = ("lang_pred", "score", "spans")
    rows = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in taken])
    held = [f for f in rows.schema.fields if with_text or f.name != "text"]
    out = T.StructType([*held, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("spans", SPANS)])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded, see TABLE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.blocks(batches, W.PIECE // max(1, len(shared.value.langs) // 8)):
            names, score, spans = judge(shared.value, batch.column("text"), penalty)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(f.name) for f in held), pa.array(names, pa.string()), pa.array(score), pa.array(spans, _SPANS)],
                names=[*(f.name for f in held), *taken])

    return rows.mapInArrow(run, out)


def held_out(doc_id, parts: int = 4):
    """crc32 of the id as text leaves 2; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts == 2


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = train(docs.where(~held_out(F.col("doc_id"))))
    return (identify(docs.select("doc_id", "text"), model, with_text=False)
            .select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score"))
