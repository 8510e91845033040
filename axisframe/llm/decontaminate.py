"""Benchmark decontamination by winnowing, with DataFrame functions only.

A window of ``window`` words holds ``window - k + 1`` k-grams; its fingerprint is the least of their
hashes. A document window that equals a benchmark window has the same fingerprint, so joining the two
sides' fingerprints misses no shared span of ``window`` words or more (Schleimer, Wilkerson & Aiken,
2003). A joined fingerprint is extended to its whole window, whose words are compared. Items shorter
than a window are one window of their own length, whose fingerprint is the hash of all its words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from axisframe.llm._store import bitmap_of, bits_for, cut, may_hold

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Everything of ASCII but digits and (lower-cased) letters parts words.
BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def word_list(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BETWEEN_WORDS), "")


def _grams(h: Column, k: int) -> Column:
    """Hash of each run of k of the hashes."""
    last = F.size(h) - k
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(k)]))).otherwise(F.array().cast("array<bigint>"))


def _least(g: Column, w: int) -> Column:
    """Least of each run of w of the hashes."""
    last = F.size(g) - w
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.least(*[F.get(g, i + j) for j in range(w)]))).otherwise(F.array().cast("array<bigint>"))


def _with_prints(df: DataFrame, window: int, k: int, lengths: list[int]) -> DataFrame:
    """From ``words``: f<window> holds each window's fingerprint, f<L> that of each run of L words."""
    df = df.withColumn("h", F.transform("words", lambda w: F.xxhash64(w)))
    df = df.withColumn("g", _grams(F.col("h"), k)).withColumn(f"f{window}", _least(F.col("g"), window - k + 1))
    for n in lengths:
        df = df.withColumn(f"f{n}", _grams(F.col("h"), n))
    return df


def _spans(n: int, keep) -> Column:
    """(start, length, fingerprint) of the windows of n words whose fingerprint passes ``keep``."""
    hit = F.transform(F.col(f"f{n}"), lambda x, i: F.when(keep(x), F.struct(i.alias("start"), F.lit(n).alias("length"), x.alias("print"))))
    return F.filter(hit, lambda s: s.isNotNull())


def _window_text(start: Column, length: Column) -> Column:
    return F.array_join(F.slice(F.col("words"), start + 1, length), " ")


def decontaminate(documents: DataFrame, benchmark: DataFrame, window: int = 10, k: int = 5, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per document row: doc_id, n_words, n_hit, items (sorted strings), hits (start, length).

    A word is hit when it lies in an occurrence of a window of any item. Null or word-less documents
    have no hits; null or word-less items have no window; null item ids never match. Repeated document
    rows are judged each on its own; items with equal texts all count. Empty tables give no rows or no
    hits. Other columns are ignored.
    """
    items = cut(benchmark.select(F.col(f"`{item_col}`").cast("string").alias("item"), word_list(F.col(f"`{item_text_col}`")).alias("words")).where("size(words) > 0 and item is not null"), "items")
    # at most window - 1 different lengths
    short = sorted(r[0] for r in items.select(F.size("words").alias("n")).where(F.col("n") < window).distinct().collect())
    own = _with_prints(items, window, k, short)
    whole = F.array(F.struct(F.lit(0).alias("start"), F.size("words").alias("length"), F.element_at(F.coalesce(*[F.when(F.size("words") == n, F.col(f"f{n}")) for n in short], F.col(f"f{window}")), 1).alias("print")))
    spans = F.when(F.size("words") < window, whole).otherwise(_spans(window, lambda x: F.lit(True)))
    item_windows = cut(
        own.select("item", "words", F.explode(spans).alias("s")).select("item", F.col("s.print").alias("print"), F.col("s.length").alias("length"), _window_text(F.col("s.start"), F.col("s.length")).alias("span")).distinct(), "item-windows"
    )
    bits = bits_for(item_windows.count())
    bitmap = bitmap_of(item_windows.select("print"), "print", bits)
    # one pass over the documents: a row for each, and one for each window whose fingerprint the benchmark may hold
    docs = documents.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").alias("doc_id"), word_list(F.col(f"`{text_col}`")).alias("words"))
    docs = _with_prints(docs, window, k, short)
    lengths, ends = [window, *short], [F.size(f"f{window}")]
    for n in short:
        ends.append(ends[-1] + F.size(f"f{n}"))
    at = F.col("pos") - 1
    start, length = at, F.lit(window)
    for n, end in zip(short, ends, strict=False):
        start, length = F.when(at >= end, at - end).otherwise(start), F.when(at >= end, F.lit(n)).otherwise(length)
    prints = F.concat(F.array(F.lit(None).cast("bigint")), *[F.col(f"f{n}") for n in lengths])
    docs = docs.select("*", F.posexplode(prints).alias("pos", "print")).where((F.col("pos") == 0) | may_hold(bitmap, F.col("print"), bits))
    docs = cut(
        docs.select("row", "doc_id", "pos", F.size("words").cast("long").alias("n_words"), start.alias("start"), length.alias("length"), "print", _window_text(F.greatest(start, F.lit(0)), F.when(F.col("pos") > 0, length).otherwise(0)).alias("span")),
        "doc-windows",
    )
    met = docs.where("pos > 0").select("row", "start", "length", "print", "span")
    keys = ["print", "length", "span"]
    spans = met.join(item_windows.select(*keys).distinct(), keys, "left_semi").groupBy("row").agg(F.sort_array(F.collect_set(F.struct("start", "length"))).alias("hits"))
    items_met = met.select("row", *keys).distinct().join(item_windows, keys).select("row", "item").distinct().groupBy("row").agg(F.sort_array(F.collect_list("item")).alias("items"))
    # words under the union of the spans, which come in order of their starts
    covered = F.aggregate(
        "hits",
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda a, s: F.struct(F.greatest(a["end"], s["start"] + s["length"]).alias("end"), (a["n"] + F.greatest(F.lit(0), s["start"] + s["length"] - F.greatest(a["end"], s["start"]))).alias("n")),
        lambda a: a["n"].cast("long"),
    )
    return (
        docs.where("pos = 0")
        .select("row", "doc_id", "n_words")
        .join(spans, "row", "left")
        .join(items_met, "row", "left")
        .select("doc_id", "n_words", F.coalesce(covered, F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.coalesce("hits", F.array().cast("array<struct<start:int,length:int>>")).alias("hits"))
    )
