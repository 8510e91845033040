"""Toxicity scores: gradient-boosted trees over dense features, with isotonic calibration.

The labelled rows used for learning are a bounded sample in hash order, in three parts: one to mine the
lexicon of words and word beginnings that go with label 1, one to grow the trees, one to calibrate. So no
row's own label is in the features that its part of the model is fitted on. Scoring reads whole texts.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from axisframe.llm._store import bitmap_of, bounded_batches, cut, may_hold
from axisframe.llm._text import LOWER, SMALL_CHUNK, chunks, prefix_hash, span_hash

#: Labelled rows that are learnt from, at most.
SAMPLE_ROWS = 24_000
#: Entries of the mined lexicon, at most.
LEXICON_SIZE = 4_000
PREFIXES = (4, 5, 6)
NEAR_WORDS = 5
# fixed values: plain insults and second-person words of the four languages of the corpus
INSULTS = "idiot moron stupid loser pathetic worthless disgusting scum trash clown dumb fool jerk imbecile crétin débile abruti trottel dummkopf arschloch estúpido imbécil tonto".split()
SECOND_PERSON = "you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine ihr euch euer tú ti tus usted ustedes vosotros".split()
FEATURES = [
    "insult_density", "mined_density", "mined_most", "begin_density", "begin_most", "near_you_density", "you_density", "capital_rate", "shout_rate", "exclaim_rate", "symbol_rate", "obfuscated_rate", "disguised_density", "log_hits", "log_words",
]

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_UNDISGUISE = LOWER.copy()
for _a, _b in zip(b"013457", b"oieast", strict=True):
    _UNDISGUISE[_a] = _b


def _hash_words(words: list[str]) -> np.ndarray:
    out = []
    for w in words:
        b = np.frombuffer(w.encode(), np.uint8)
        out.append(span_hash(prefix_hash(b), np.array([0]), np.array([len(b)]))[0])
    return np.unique(np.array(out, np.uint64))


def _words(data: np.ndarray, off: np.ndarray):
    """Words (start, end, row, hash), and the hash prefix sums of the lower-cased bytes."""
    low = LOWER[data]
    inside = _WORD[data]
    first = np.zeros(len(data) + 1, bool)
    first[off] = True
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1] | first[1:-1]
    end[:-1] &= ~inside[1:] | first[1:-1]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    pre = prefix_hash(low)
    return s, e, np.searchsorted(off, s, "right") - 1, span_hash(pre, s, e), pre


def _beginnings(pre: np.ndarray, s: np.ndarray, e: np.ndarray):
    """For each prefix length: which words are longer, and the hashes of their beginnings (told apart from words)."""
    for n in PREFIXES:
        at = np.flatnonzero(e - s > n)
        yield at, span_hash(pre, s[at], s[at] + n) ^ np.uint64(0xA5A5A5A5)


def _mine():
    schema = pa.schema([("h", pa.int64()), ("toxic", pa.int64()), ("clean", pa.int64())])

    def run(batches):
        for batch in batches:
            label = batch.column("label").to_numpy()
            for a, b, data, off in chunks(batch.column("text"), SMALL_CHUNK):
                s, e, row, h, pre = _words(data, off)
                rows, hs = [row], [h]
                for at, begin in _beginnings(pre, s, e):
                    rows.append(row[at])
                    hs.append(begin)
                row, h = np.concatenate(rows), np.concatenate(hs)
                order = np.lexsort((row, h))
                row, h = row[order], h[order]
                new = np.r_[True, (row[1:] != row[:-1]) | (h[1:] != h[:-1])] if len(h) else np.zeros(0, bool)
                row, h = row[new], h[new]
                toxic = label[a:b][row]
                key, which = np.unique(h, return_inverse=True)
                ones = np.bincount(which, weights=toxic, minlength=len(key)).astype(np.int64)
                yield pa.record_batch([pa.array(key.view(np.int64)), pa.array(ones), pa.array(np.bincount(which, minlength=len(key)) - ones)], schema=schema)

    return run, "h long, toxic long, clean long"


def _features(lexicon: tuple[np.ndarray, np.ndarray]):
    schema = pa.schema([("doc_id", pa.int64()), ("label", pa.float64()), ("part", pa.int32()), ("features", pa.list_(pa.float64()))])
    insults, seconds = _hash_words(INSULTS), _hash_words(SECOND_PERSON)
    keys, weights = lexicon

    def weight(h: np.ndarray) -> np.ndarray:
        if not len(keys) or not len(h):
            return np.zeros(len(h))
        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        return np.where(keys[at] == h, weights[at], 0.0)

    def measure(data: np.ndarray, off: np.ndarray) -> np.ndarray:
        n = len(off) - 1
        s, e, row, h, pre = _words(data, off)
        count = lambda at, w=None: np.bincount(at, weights=w, minlength=n).astype(float)
        most = lambda at, w: (x := np.zeros(n), np.maximum.at(x, at, w))[0]
        total = np.maximum(count(row), 1)
        plain = np.isin(h, insults)
        mined = weight(h)
        begin = np.zeros(len(h))
        for at, bh in _beginnings(pre, s, e):
            begin[at] = np.maximum(begin[at], weight(bh))
        hit = plain | (mined > 0) | (begin > 0)
        you = np.isin(h, seconds)
        # words since or until the next second-person word of the same text
        seen = np.r_[0, np.cumsum(you)]
        lo, hi = np.searchsorted(row, row, "left"), np.searchsorted(row, row, "right")
        place = np.arange(len(row))
        near = hit & (seen[np.minimum(place + NEAR_WORDS + 1, hi)] > seen[np.maximum(place - NEAR_WORDS, lo)])
        byte_row = np.repeat(np.arange(n), np.diff(off))
        upper = (data >= 65) & (data <= 90)
        letter = upper | ((data >= 97) & (data <= 122)) | (data >= 128)
        digit = (data >= 48) & (data <= 57)
        size = np.maximum(np.diff(off), 1).astype(float)
        n_upper, n_digit, n_letter = (np.r_[0, np.cumsum(x)] for x in (upper, digit, letter))
        shout = (e - s > 2) & (n_upper[e] - n_upper[s] == e - s)
        mixed = (n_digit[e] > n_digit[s]) & (n_letter[e] > n_letter[s])
        other = ~letter & ~digit & (data != 32) & (data != 10)
        disguised = np.zeros(len(h), bool)
        if mixed.any():
            true_pre = prefix_hash(_UNDISGUISE[data])
            at = np.flatnonzero(mixed)
            dh = span_hash(true_pre, s[at], e[at])
            disguised[at] = np.isin(dh, insults) | (weight(dh) > 0)
        return np.stack(
            [
                count(row[plain]) / total, count(row, mined) / total, most(row, mined), count(row, begin) / total, most(row, begin), count(row[near]) / total, count(row[you]) / total, count(byte_row[upper]) / size, count(row[shout]) / total,
                count(byte_row[(data == 33) | (data == 63)]) / size, count(byte_row[other]) / size, count(row[mixed]) / total, count(row[disguised]) / total, np.log1p(count(row[hit | disguised])), np.log1p(count(row)),
            ],
            1,
        )

    def run(batches):
        for batch in batches:
            for a, b, data, off in chunks(batch.column("text"), SMALL_CHUNK):
                x = measure(data, off)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))
                yield pa.record_batch([batch.column(c).slice(a, b - a) for c in ("doc_id", "label", "part")] + [lists], schema=schema)

    return run, "doc_id long, label double, part int, features array<double>"


def _mined(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The bounded lexicon: hashes and log odds of what goes with label 1 clearly and often enough."""
    n1, n0 = rows.agg(F.coalesce(F.sum("label"), F.lit(0)), F.coalesce(F.sum(1 - F.col("label")), F.lit(0))).first()
    if not n1 or not n0:
        return np.zeros(0, np.uint64), np.zeros(0)
    found = rows.select("text", F.col("label").cast("long").alias("label")).mapInArrow(*_mine()).groupBy("h").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c"))
    odds = F.log((F.col("t") + 0.5) / (n1 + 1)) - F.log((F.col("c") + 0.5) / (n0 + 1))
    found = found.where(F.col("t") >= max(3, 0.01 * n1)).select("h", "t", odds.alias("w")).where(F.col("w") >= math.log(4)).orderBy(F.desc(F.col("t") * F.col("w")), "h").limit(LEXICON_SIZE).toArrow()
    h, w = found.column("h").to_numpy().view(np.uint64), found.column("w").to_numpy()
    order = np.argsort(h)
    return h[order], w[order]


def held_out(doc_id: Column) -> Column:
    """Rows that no label is learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def toxicity_scores(documents: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS, row_col: str | None = None) -> DataFrame:
    """One row per document row: doc_id, held_out, score (0 to 1, calibrated), predicted (1 from ``threshold`` on).

    Learns from at most ``sample_rows`` labelled documents that aren't held out; null labels, null ids and
    labels without a document are left out, repeated labels of an id count as their largest. Null and empty
    texts are scored like any other, from features that are all 0. With one class of labels or none, every
    score is that class's rate (0 without labels). A lexicon entry needs at least 3 and 1 % of the toxic texts it is
    mined from and 4 times its share of the others; at most LEXICON_SIZE entries stay, the clearest first. Only texts make a score; other columns are ignored. With ``row_col``, a column of row numbers,
    the result has it in place of doc_id and held_out.
    """
    bounded_batches(documents.sparkSession)
    docs = documents.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    marks = labels.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{label_col}`").cast("double").alias("label")).where("doc_id is not null and label is not null")
    marks = marks.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("label").alias("label"))
    marks = cut(marks.withColumn("o", F.xxhash64("doc_id")).orderBy("o", "doc_id").limit(sample_rows).withColumn("part", F.pmod(F.xxhash64("o"), F.lit(10)).cast("int")).drop("o"), "marks")
    wanted = bitmap_of(marks.select(F.xxhash64("doc_id").alias("h")), "h")
    sample = cut(docs.where(may_hold(wanted, F.xxhash64("doc_id"))).join(marks, "doc_id"), "sample")
    lexicon = _mined(sample.where("part < 4"))
    measured = lambda df: df.mapInArrow(*_features(lexicon)).withColumn("features", array_to_vector("features"))
    fitted = cut(measured(sample.where("part >= 4").select("doc_id", "text", "label", "part")).withColumn("features", vector_to_array("features")), "features")
    fitted = fitted.withColumn("features", array_to_vector("features"))
    grow, check = fitted.where("part < 8"), fitted.where("part >= 8")
    classes = lambda df: {int(r[0]): r[1] for r in df.groupBy("label").count().collect()}
    grown, checked, every = classes(grow), classes(check), classes(marks)
    if row_col:
        docs = documents.select(F.col(f"`{row_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    all_docs = docs.withColumn("label", F.lit(None).cast("double")).withColumn("part", F.lit(0))
    if len(grown) < 2:
        rate = every.get(1, 0) / max(1, sum(every.values()))
        scored = docs.select("doc_id", F.lit(float(rate)).alias("score"))
    else:
        trees = GBTClassifier(labelCol="label", featuresCol="features", maxIter=24, maxDepth=4, stepSize=0.25, minInstancesPerNode=3, seed=11).fit(grow)
        chance = lambda df: trees.transform(measured(df) if "text" in df.columns else df).withColumn("chance", vector_to_array("probability")[1])
        scored = chance(all_docs.select("doc_id", "text", "label", "part"))
        if len(checked) == 2:
            even = IsotonicRegression(labelCol="label", featuresCol="chance", predictionCol="level").fit(chance(check).select("chance", "label"))
            # a hundredth of the trees' own chance keeps the order inside the steps
            scored = even.transform(scored.select("doc_id", "chance")).select("doc_id", (0.99 * F.col("level") + 0.01 * F.col("chance")).alias("score"))
        else:
            scored = scored.select("doc_id", F.col("chance").alias("score"))
    score = F.least(F.greatest(F.col("score"), F.lit(0.0)), F.lit(1.0))
    if row_col:
        return scored.select(F.col("doc_id").alias(row_col), score.alias("score"), (score >= threshold).cast("int").alias("predicted"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score.alias("score"), (score >= threshold).cast("int").alias("predicted"))
