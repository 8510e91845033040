"""Hard negatives, shards and lexical search against brute force, with nulls, ties, repeats, empty tables and clashing columns."""

import math
import random
import re
import zlib
from collections import Counter
from itertools import combinations_with_replacement

import pytest
from pyspark.sql import functions as F

from axisframe.llm import hard_negatives as H
from axisframe.llm import lexical_search as L
from axisframe.llm.hard_negatives import hard_negatives
from axisframe.llm.lexical_search import ranked_search
from axisframe.llm.sharding import Piece, _Line, shard_documents, write_shards

np = pytest.importorskip("numpy")
DOCS = "doc_id long, text string, key string, row long, bytes int, shard2 long, item long, term string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "k", 1, 2, 3, 4, "t") for i, t in rows], DOCS).repartition(3)


# --- hard negatives --------------------------------------------------------------------------------


def brute_negatives(rows, anchor, n_pos=5, n_neg=10):
    ok = [(k, i, lab, [math.floor(256 * x) for x in v]) for k, (i, v, lab) in enumerate(rows) if lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a in ok:
        if not anchor(a[1]):
            continue
        score = {b[0]: sum(x * y for x, y in zip(a[3], b[3], strict=False)) for b in ok}
        order = lambda b: (-score[b[0]], b[1] is None, b[1] or 0)
        for p in sorted((b for b in ok if b[2] == a[2] and b[0] != a[0]), key=order)[:n_pos]:
            ps = score[p[0]]
            own = sorted((b for b in ok if b[2] != a[2] and 30 * ps <= 100 * score[b[0]] <= 90 * ps), key=order)[:n_neg]
            out += [(a[1], p[1], r + 1, b[1], ps, score[b[0]]) for r, b in enumerate(own)]
    return out


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, lab, 1, "s") for i, v, lab in rows], "vec_id long, embedding array<double>, label int, row long, seg string").repartition(3)


@pytest.mark.parametrize("segment,anchors", [(4096, 1024), (16, 3)])
def test_hard_negatives(spark, monkeypatch, segment, anchors):
    """Ties, repeated rows and ids, nulls, infinities and short vectors; also in many segments and blocks of anchors."""
    monkeypatch.setattr(H, "SEGMENT", segment)
    monkeypatch.setattr(H, "ANCHORS", anchors)
    r = random.Random(segment)
    rows = [(i, [round(r.gauss(0, 0.3) + 0.2 * (i % 3), 1) for _ in range(5)], i % 3) for i in range(150)]
    rows += [(7, [0.5] * 5, 1)] * 3 + [(20, [0.5] * 5, 1), (20, [0.1, 0.9], 0), (None, [0.4] * 5, 2), (None, [0.4] * 5, 1), (30, [0.0] * 5, 0), (31, [], 0)]
    rows += [(40, None, 1), (50, [1.0, None, 1.0, 1.0, 1.0], 1), (60, [float("nan")] * 5, 1), (70, [float("-inf")] * 5, 1), (80, [0.3] * 5, None)]
    got = sorted(map(tuple, hard_negatives(vectors(spark, rows), F.col("vec_id") % 10 == 0).collect()), key=str)
    assert got == sorted(brute_negatives(rows, lambda i: i is not None and i % 10 == 0), key=str) and len(got) > 200


def test_hard_negatives_without_rows(spark):
    assert hard_negatives(vectors(spark, []), F.lit(True)).count() == 0
    assert hard_negatives(vectors(spark, [(0, [], 1), (1, [], 1), (2, [], 2)]), F.lit(True)).count() == 2  # all scores are 0
    assert hard_negatives(vectors(spark, [(1, [0.5], 1), (2, [0.5], 2)]), F.lit(True)).count() == 0  # no positives
    with pytest.raises(ArithmeticError):
        hard_negatives(vectors(spark, [(1, [1e30], 1)]), F.lit(True))


def test_threshold_leaves_lists_unread(monkeypatch):
    """With one dominant dimension, most vectors are never scored."""
    pa = pytest.importorskip("pyarrow")
    n, rng = 4000, np.random.default_rng(3)
    whole = np.stack([rng.permutation(n), rng.integers(0, 3, n)], 1).astype(np.int64)
    order = np.argsort(whole.T, axis=1, kind="stable").astype(np.int32)
    row = [[list(range(n))], [np.arange(n).tobytes()], [np.zeros(n, np.int64).tobytes()], [whole.astype("int16").tobytes()], [order.tobytes()]]
    lists = H.Lists(pa.record_batch([pa.array(x, f.type) for x, f in zip(row, H.LISTS, strict=True)], schema=H.LISTS), 0, "int16", True)
    seen = []
    ranked = H.Ranked(5)
    add = ranked.add
    ranked.add = lambda score, *rest: (seen.append(len(score)), add(score, *rest))
    lists.mine(H.Anchor(-1, 0, np.array([100, -1])), np.ones(n, bool), [ranked])
    score = whole @ np.array([100, -1])
    assert ranked.score.tolist() == sorted(score.tolist(), reverse=True)[:5] and sum(seen) < n // 10


# --- shards ----------------------------------------------------------------------------------------


def least_capacity(sizes, shards):
    """By trying all sets of cuts."""
    at = np.r_[0, np.cumsum(sizes)]
    return min(max(np.diff(np.r_[0, list(c), at[-1]])) for c in combinations_with_replacement(at.tolist(), shards - 1))


def test_capacity_and_cuts_against_all_cuts():
    r = random.Random(5)
    for _ in range(60):
        sizes = [r.choice([1, 2, 3, 10, 40]) for _ in range(r.randint(0, 9))]
        shards = r.randint(1, 4)
        line = _Line([Piece(s, False, -1, i) for i, s in enumerate(sizes)])
        capacity = line.capacity(shards)
        assert capacity == (least_capacity(sizes, shards) if sizes else 0)
        cuts = line.cuts(capacity, shards)
        assert len(cuts) == shards - 1 and set(cuts) <= set(line.at) and max(np.diff([0, *cuts, line.total])) <= capacity and not line.met


def check_shards(rows, got, shards):
    assert len(got) == len(rows)
    size = lambda t: len((t or "").encode()) + 1
    crc = lambda t: zlib.crc32((t or "").encode())
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, size(t), crc(t)) for i, t in rows)
    where = {}
    for r in got:
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < shards
        where.setdefault(r.text_crc32, set()).add(r.shard)
    assert all(len(x) == 1 for x in where.values())  # equal texts stay together
    for s in range(shards):
        own = sorted((r for r in got if r.shard == s), key=lambda r: r.slot)
        assert [r.slot for r in own] == list(range(len(own)))
        ids = [(r.doc_id is not None, r.doc_id or 0) for r in own]
        assert ids == sorted(ids)
    total = Counter()
    for r in got:
        total[r.shard] += r.size
    return total


def test_shards(spark):
    r = random.Random(1)
    rows = [(i, "".join(r.choice("abcde ü") for _ in range(r.randint(0, 60)))) for i in range(4000)]
    rows += [(9, "copy " * 30)] * 600 + [(None, None), (None, ""), (3, ""), (3, None)]  # a group of over a third of all bytes
    total = check_shards(rows, shard_documents(table(spark, rows), 6).collect(), 6)
    big = 600 * 151
    others = sorted(total.values())[:-1]
    assert max(total.values()) == big and max(others) - min(others) < 0.01 * sum(others)


def test_shards_of_few_rows_and_none(spark):
    assert shard_documents(table(spark, [])).count() == 0
    check_shards([(1, "a"), (2, None)], shard_documents(table(spark, [(1, "a"), (2, None)]), 5).collect(), 5)
    same = [(1, "same")] * 50
    assert set(check_shards(same, shard_documents(table(spark, same), 3).collect(), 3)) == {0}


def test_written_shards_hold_all_columns(spark, tmp_path):
    rows = [(i, f"text {i % 40} " * (i % 7)) for i in range(200)]
    plan = write_shards(table(spark, rows), str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert Counter((r.doc_id, r.text) for r in back.collect()) == Counter(rows) and {"key", "row", "bytes"} <= set(back.columns)
    sums = {r[0]: r[1] for r in back.groupBy("shard").agg(F.sum(F.octet_length("text") + 1)).collect()}
    assert [sums.get(s, 0) for s in range(4)] == plan.sizes and max(plan.sizes) <= plan.capacity


# --- lexical search --------------------------------------------------------------------------------


def terms_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_search(docs, items, k):
    own = [Counter(terms_of(t)) for _, t in docs]
    held = [c for c in own if c]
    n, total, df = len(held), sum(map(Counter.total, held)), Counter(t for c in held for t in c)
    out = []
    for item, text in items:
        scored = []
        for (i, _), c in zip(docs, own, strict=True):
            m = 75 + 25 * c.total() * n // total if total else 0
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in terms_of(text) if t in c)
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scored)[:k])]
    return out


@pytest.mark.parametrize("block,docs,postings", [(1 << 17, 1 << 14, 1 << 20), (6, 5, 40)])
def test_search(spark, monkeypatch, block, docs, postings):
    """Also in many blocks of queries, and segments of a few documents."""
    monkeypatch.setattr(L, "BLOCK_TERMS", block)
    monkeypatch.setattr(L, "SEGMENT_DOCS", docs)
    monkeypatch.setattr(L, "SEGMENT_POSTINGS", postings)
    r = random.Random(2)
    words = ["the", "Über", "naïve", "x1", "42", "rare", *(f"w{i}" for i in range(30))]
    pick = lambda n: " ".join(r.choice(words[: r.randint(1, 36)]) for _ in range(n))
    rows = [(i, pick(r.choice([0, 1, 3, 10, 50]))) for i in range(120)] + [(5, "the rare"), (5, "the rare"), (None, "rare Rare"), (None, None), (200, ""), (201, "... !"), (202, pick(4000))]
    items = [(1, "the RARE thing"), (2, "w1 w1 w2, über-naïve"), (3, None), (4, "unknown words only"), (1, "42"), (None, "w3 w4 w5 rare")]
    got = ranked_search(table(spark, rows), spark.createDataFrame(items, "item_id long, text string"), 7).collect()
    assert Counter(map(tuple, got)) == Counter(brute_search(rows, items, 7)) and len(got) > 20


def test_search_of_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert ranked_search(table(spark, [(1, "a")]), none).count() == 0
    assert ranked_search(table(spark, []), spark.createDataFrame([(1, "a")], "item_id long, text string")).count() == 0


def test_words_with_a_terms_hash_are_told_apart():
    """A vocabulary whose hashes are made to clash with another word's."""
    v = L.vocabulary(["alpha"])
    data = np.frombuffer(b"omega Alpha alpho", np.uint8)
    s, e = np.array([0, 6, 12]), np.array([5, 11, 17])
    hit, number = L._known(data, s, e, np.repeat(v.hashes, 3), v)
    assert hit.tolist() == [1] and number.tolist() == [0]
