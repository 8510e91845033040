"""Ranked lexical search over a length-stratified index.

The index is document-partitioned: one pass over the texts writes segments of some thousand documents each,
with the postings (term, frequency, document) of the terms that a block of queries has, and the counts that
weights need. A second pass ranks: a segment's documents are grouped into strata of equal normaliser, a
term's postings of a stratum are ordered by frequency, and an impact is computed once for each stratum and
frequency. The highest frequencies bound what a stratum can score; an item visits strata by falling bound
and leaves the segment when the next bound is below its last ranked score. Only ranked rows are shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from axisframe.llm._store import bounded_batches, cut
from axisframe.llm._text import chunks, words
from axisframe.llm.decontaminate import word_list

#: Terms of a block of queries, about: what is sent to each task. More queries make more blocks, each with its own pass.
BLOCK_TERMS = 1 << 17
#: Documents and postings of a segment, at most (one document aside): what a task holds at a time.
SEGMENT_DOCS, SEGMENT_POSTINGS = 1 << 14, 1 << 20
#: Rows of one item that are merged at a time: tasks are dealt into so many parts first.
SALTS = 64

#: Whatever isn't a digit, a letter or beyond ASCII stands between terms.
BETWEEN = np.zeros(256, bool)
BETWEEN[:128] = True
BETWEEN[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False

INDEX = pa.schema([("n_docs", pa.int64()), ("n_terms", pa.int64()), ("ids", pa.list_(pa.int64())), ("lengths", pa.binary()), ("postings", pa.binary()), ("terms", pa.list_(pa.int32())), ("holding", pa.list_(pa.int64()))])
INDEX_DDL = "n_docs long, n_terms long, ids array<long>, lengths binary, postings binary, terms array<int>, holding array<long>"
RANKED = pa.schema([("item", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])
RANKED_DDL = "item long, doc_id long, score long"


class Vocabulary(NamedTuple):
    """Terms as bytes end to end, and their hashes by rising value with the terms' numbers."""

    data: np.ndarray
    off: np.ndarray
    hashes: np.ndarray
    numbers: np.ndarray


def vocabulary(terms: list[str]) -> Vocabulary:
    raw = [t.encode() for t in terms]
    data = np.frombuffer(b"".join(raw), np.uint8)
    off = np.r_[0, np.cumsum([len(t) for t in raw])].astype(np.int64)
    h = words(data, off, BETWEEN)[3] if terms else np.zeros(0, np.uint64)
    order = np.argsort(h, kind="stable")
    return Vocabulary(data, off, h[order], order)


def spread(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """All indices of the runs."""
    end = np.cumsum(length)
    return np.repeat(start - (end - length), length) + np.arange(end[-1] if len(end) else 0)


def _known(data: np.ndarray, s: np.ndarray, e: np.ndarray, h: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the words that are terms, byte for byte, and the terms' numbers; words that share a term's hash are told apart."""
    at = np.minimum(np.searchsorted(v.hashes, h), len(v.hashes) - 1)
    hit = np.flatnonzero(v.hashes[at] == h)
    number = v.numbers[at[hit]]
    length = e[hit] - s[hit]
    fits = length == v.off[number + 1] - v.off[number]
    hit, number, length = hit[fits], number[fits], length[fits]
    if len(hit):
        here, there = data[spread(s[hit], length)], v.data[spread(v.off[number], length)]
        here = np.where((here >= 65) & (here <= 90), here + 32, here)
        same = np.add.reduceat((here != there).astype(np.int32), np.r_[0, np.cumsum(length)[:-1]]) == 0
        hit, number = hit[same], number[same]
    return hit, number


class _Segment:
    """Documents and postings until they are written; documents then come by rising length."""

    def __init__(self) -> None:
        self.ids, self.lengths, self.parts, self.n, self.docs = [], [], [], 0, 0

    def add(self, ids: list, lengths: np.ndarray, term: np.ndarray, tf: np.ndarray, doc: np.ndarray) -> None:
        self.ids += ids
        self.lengths.append(lengths)
        self.parts.append((term, tf, doc + self.docs))
        self.n += len(term)
        self.docs += len(lengths)

    def full(self) -> bool:
        return self.docs >= SEGMENT_DOCS or self.n >= SEGMENT_POSTINGS

    def written(self) -> pa.RecordBatch:
        length = np.concatenate(self.lengths)
        term, tf, doc = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.argsort(length, kind="stable")
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        doc = place[doc]
        by = np.lexsort((doc, term))
        term, tf, doc = term[by].astype(np.int32), tf[by].astype(np.int32), doc[by].astype(np.int32)
        terms, holding = np.unique(term, return_counts=True)
        row = [[int((length > 0).sum())], [int(length.sum())], [[self.ids[i] for i in order.tolist()]], [length[order].astype(np.int64).tobytes()], [np.concatenate([term, tf, doc]).tobytes()], [terms], [holding]]
        return pa.record_batch([pa.array(x, f.type) for x, f in zip(row, INDEX, strict=True)], schema=INDEX)


def index_documents(documents: DataFrame, terms: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The written segments of all documents, with the postings of ``terms`` (numbered as listed)."""
    own = vocabulary(terms)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Segment()
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for a, b, data, off in chunks(batch.column(1)):
                s, e, row, h = words(data, off, BETWEEN)
                length = np.bincount(row, minlength=b - a)
                hit, number = _known(data, s, e, h, own) if len(own.hashes) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
                pair, tf = np.unique(row[hit] * len(terms) + number, return_counts=True)
                held.add(ids[a:b], length, pair % max(1, len(terms)), tf, pair // max(1, len(terms)))
                if held.full():
                    yield held.written()
                    held = _Segment()
        if held.docs:
            yield held.written()

    bounded_batches(documents.sparkSession)
    rows = documents.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return cut(rows.mapInArrow(build, INDEX_DDL), "search-index")


class _Best:
    """The k best (score, id) so far: higher scores first, then smaller ids, null ids last."""

    def __init__(self, k: int):
        self.k, self.score, self.id, self.null = k, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def floor(self) -> int:
        """What a row must score at least to be ranked."""
        return int(self.score[-1]) if len(self.score) == self.k else 1

    def add(self, score: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        score, ids, null = np.r_[self.score, score], np.r_[self.id, ids], np.r_[self.null, null]
        top = np.lexsort((ids, null, -score))[: self.k]
        self.score, self.id, self.null = score[top], ids[top], null[top]


class _Strata:
    """A segment's postings by term, stratum and falling frequency, with impacts."""

    def __init__(self, lengths: np.ndarray, postings: np.ndarray, n: int, total: int):
        m = 75 + 25 * lengths * n // max(1, total)
        first = np.flatnonzero(np.r_[True, m[1:] != m[:-1]])  # documents come by length, so strata are runs
        self.starts = np.r_[first, len(m)]
        stratum = np.repeat(np.arange(len(first)), np.diff(self.starts))
        term, tf, doc = postings.reshape(3, -1)
        own = stratum[doc]
        order = np.lexsort((-tf, own, term))
        term, tf, own, self.doc = term[order], tf[order].astype(np.int64), own[order], doc[order]
        # one impact for each term, stratum and frequency
        run = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (own[1:] != own[:-1]) | (tf[1:] != tf[:-1])]) if len(term) else np.zeros(0, np.int64)
        impact = 1_000_000_000 * tf[run] // (1000 * tf[run] + 12 * m[first][own[run]])
        self.impact = np.repeat(impact, np.diff(np.r_[run, len(term)]))
        # a list is a term in a stratum; its first posting has the highest frequency
        at = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (own[1:] != own[:-1])]) if len(term) else np.zeros(0, np.int64)
        self.list_at, self.list_n, self.list_stratum, self.list_top = at, np.diff(np.r_[at, len(term)]), own[at], self.impact[at]
        self.list_term = term[at]

    def rank(self, best: _Best, terms: np.ndarray, weight: np.ndarray, score: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        """Visit strata by falling bound. ``score`` is zero for all documents, before and after."""
        a, b = np.searchsorted(self.list_term, terms), np.searchsorted(self.list_term, terms, "right")
        bound = np.zeros(len(self.starts) - 1, np.int64)
        for x, y, w in zip(a.tolist(), b.tolist(), weight.tolist(), strict=True):
            bound[self.list_stratum[x:y]] += w * self.list_top[x:y]
        order = np.argsort(-bound, kind="stable")
        at, step, chosen = 0, 1, np.zeros(len(bound), bool)
        while at < len(order) and bound[order[at]] >= best.floor():
            visit = order[at : at + step]
            visit = visit[bound[visit] >= best.floor()]
            chosen[visit] = True
            for x, y, w in zip(a.tolist(), b.tolist(), weight.tolist(), strict=True):
                own = np.flatnonzero(chosen[self.list_stratum[x:y]]) + x
                if len(own):
                    i = spread(self.list_at[own], self.list_n[own])
                    score[self.doc[i]] += w * self.impact[i]  # a document has one posting of a term
            docs = spread(self.starts[visit], self.starts[visit + 1] - self.starts[visit])
            docs = docs[score[docs] >= best.floor()]
            best.add(score[docs], ids[docs], null[docs])
            for v in visit.tolist():
                score[self.starts[v] : self.starts[v + 1]] = 0
            chosen[visit] = False
            at, step = at + step, 2 * step


def _rank_block(documents: DataFrame, rows: list, k: int, id_col: str, text_col: str) -> DataFrame:
    """The best rows of each task for the items in ``rows`` (item, term, n)."""
    terms = sorted({r["term"] for r in rows})
    number = {t: i for i, t in enumerate(terms)}
    index = index_documents(documents, terms, id_col, text_col)
    sums = index.agg(F.sum("n_docs").alias("n"), F.sum("n_terms").alias("l")).first()
    n, total = sums["n"] or 0, sums["l"] or 0
    holding = index.select(F.explode(F.arrays_zip("terms", "holding")).alias("x")).groupBy("x.terms").agg(F.sum("x.holding").alias("df")).collect()
    weight = {r["terms"]: math.floor(1000 * math.log((2 * n + 2) / (2 * r["df"] + 1))) for r in holding}
    items: dict[int, list[tuple[int, int]]] = {}
    for r in rows:
        if weight.get(number[r["term"]], 0) > 0:
            items.setdefault(r["item"], []).append((number[r["term"]], r["n"] * weight[number[r["term"]]]))
    queries = [(item, *(np.array(x, np.int64) for x in zip(*sorted(own), strict=True))) for item, own in items.items()]

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {item: _Best(k) for item, *_ in queries}
        for batch in batches:
            for row in range(batch.num_rows):
                lengths = np.frombuffer(batch.column("lengths")[row].as_buffer(), np.int64)
                strata = _Strata(lengths, np.frombuffer(batch.column("postings")[row].as_buffer(), np.int32), n, total)
                ids = batch.column("ids")[row].values
                null, ids = np.asarray(ids.is_null()), np.asarray(ids.fill_null(0))
                score = np.zeros(len(lengths), np.int64)
                for item, own, w in queries:
                    strata.rank(best[item], own, w, score, ids, null)
        for item, b in best.items():
            if len(b.score):
                yield pa.record_batch([pa.array(np.full(len(b.score), item)), pa.array(b.id, mask=b.null), pa.array(b.score)], schema=RANKED)

    return index.select("ids", "lengths", "postings").mapInArrow(ranked, RANKED_DDL)


def ranked_search(documents: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The ``k`` highest-scoring document rows of each query row: item_id, rank, doc_id, score.

    Only scores above 0 are ranked; ties go to the smaller document id, null ids last; document rows that
    repeat an id are ranked each on its own. Query rows with equal or null ids are queries of their own;
    those without known terms have no rows. Null and empty texts have no terms. Empty tables give no rows.
    Other columns are ignored. Ids are whole numbers. Queries are ranked in blocks of about
    ``BLOCK_TERMS`` different terms, one query at least.
    """
    items = cut(queries.select(F.col(f"`{item_col}`").alias("item_id"), F.monotonically_increasing_id().alias("item"), word_list(F.col(f"`{item_text_col}`")).alias("words")), "search-items")
    terms = cut(items.select("item", F.explode("words").alias("term")).groupBy("item", "term").agg(F.count("*").alias("n")), "search-terms")
    blocks = max(1, -(-terms.count() // BLOCK_TERMS))
    out = None
    for block in range(blocks):
        rows = terms.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block).collect()
        own = _rank_block(documents, rows, k, id_col, text_col)
        out = own if out is None else out.unionByName(own)
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    for by in (["item", F.pmod(F.spark_partition_id(), F.lit(SALTS)).alias("salt")], ["item"]):
        w = Window.partitionBy("item", "salt").orderBy(*order) if len(by) == 2 else Window.partitionBy("item").orderBy(*order)
        out = out.select("*", by[1]) if len(by) == 2 else out.drop("salt")
        out = out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return out.join(items.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")
