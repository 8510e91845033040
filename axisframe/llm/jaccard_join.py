"""N-gram Jaccard join with skipping by set relations (after Wang et al., "Leveraging Set Relations in
Exact Set Similarity Join", 2017).

Sets of word shingles are ordered from rare to frequent; each set's prefix is posted in index lists.
A list is kept in blocks by set size with the block's least positions: a posting whose position can't
reach the needed overlap with any block is skipped (index-level skipping). In each list only the most
central set is compared in full. The answers of the other sets are derived from that set's answers: with
the differences to it known, the overlap of two others is
|L| - |gone x| - |gone y| + |gone x & gone y| + |extra x & extra y|, so no list is read again and no pairs
of a large list are written out (answer-level skipping). Pairs already connected are skipped. Before
sets are compared, parity bitmaps of theirs are: bits that differ are elements that differ, so a pair with
too many is out, exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axisframe.llm._graph import components, joined_components
from axisframe.llm._store import bitmap_of, cut, may_hold
from axisframe.llm._text import _MULT, chunks, mix, windows, words

#: Shingles that recur inside so many distinct shingles read by a task are counted for the order.
FLUSH = 1 << 21
#: Frequency ranks sent to the tasks (12 bytes each). They only order the shingles: results don't depend on them.
RANKS = 1 << 17
#: Lists of at most so many postings give their partnered pairs; larger ones are compared through a central set.
SMALL_LIST = 8
#: Sets of one side in a block of derived answers.
BLOCK = 2048


def shingle_sets(column: pa.Array, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, row of each shingle, shingle): distinct shingles sorted by row and hash."""
    for a, b, data, off in chunks(column):
        _, _, row, h = words(data, off)
        at, sh = windows(h, row, k)
        rows, n = row[at], np.bincount(row, minlength=b - a)
        few = np.flatnonzero(n[row] < k)
        if len(few):  # the whole sequence as one
            first = np.searchsorted(row, row[few])
            whole = n.astype(np.uint64)
            np.add.at(whole, row[few], h[few] * _MULT[16 + few - first])
            own = np.flatnonzero((n > 0) & (n < k))
            rows, sh = np.concatenate([rows, own]), np.concatenate([sh, mix(whole[own])])
        order = np.lexsort((sh, rows))
        rows, sh = rows[order], sh[order]
        new = np.ones(len(rows), bool)
        new[1:] = (rows[1:] != rows[:-1]) | (sh[1:] != sh[:-1])
        yield a, b, rows[new], sh[new]


def _digests(rows: np.ndarray, sh: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Size and a 128-bit digest of each of the n sets."""
    size = np.bincount(rows, minlength=n)
    out = [np.zeros(n, np.uint64), np.zeros(n, np.uint64)]
    if len(rows):
        starts = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
        for k in (0, 1):
            out[k][rows[starts]] = np.add.reduceat(mix(sh ^ _MULT[40 + k]), starts)
    return size, out[0].view(np.int64), out[1].view(np.int64)


def _scan(k: int):
    schema = pa.schema([("doc_id", pa.int64()), ("id", pa.int64()), ("n", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("shingle", pa.int64()), ("seen", pa.int64())])

    def repeats(parts: list) -> pa.RecordBatch:
        value, count = np.unique(np.concatenate(parts), return_counts=True)
        value, count = value[count > 1].view(np.int64), count[count > 1]
        none = pa.nulls(len(value), pa.int64())
        return pa.record_batch([none] * 5 + [pa.array(value), pa.array(count)], schema=schema)

    def run(batches):
        parts, total = [], 0
        for batch in batches:
            ids = batch.column("doc_id")
            for a, b, rows, sh in shingle_sets(batch.column("text"), k):
                size, d1, d2 = _digests(rows, sh, b - a)
                none = pa.nulls(b - a, pa.int64())
                yield pa.record_batch([ids.slice(a, b - a), batch.column("id").slice(a, b - a), pa.array(size), pa.array(d1), pa.array(d2), none, pa.array(np.full(b - a, -1))], schema=schema)
                parts.append(sh)
                total += len(sh)
                if total > FLUSH:
                    yield repeats(parts)
                    parts, total = [], 0
        if total:
            yield repeats(parts)

    return run, "doc_id long, id long, n long, d1 long, d2 long, shingle long, seen long"


def _needed(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Overlap that sets of n and m shingles need."""
    return (percent * (n + m) + 99 + percent) // (100 + percent)


#: Sets that a task remembers to have posted: those forgotten are posted once more, as by another task.
DONE = 1 << 18


def _postings(k: int, percent: int, hot):
    """Prefix postings (shingle, doc_id, n, pos); a set that a task has posted isn't posted by it again."""
    schema = pa.schema([("shingle", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int32()), ("pos", pa.int32())])

    def run(batches):
        value, rank = hot.value
        done: set = set()
        for batch in batches:
            ids = batch.column("doc_id")
            for a, b, rows, sh in shingle_sets(batch.column("text"), k):
                size, d1, d2 = _digests(rows, sh, b - a)
                post = np.zeros(b - a, bool)
                for i, key in enumerate(zip(d1.tolist(), d2.tolist(), strict=True)):
                    if size[i] and key not in done:
                        if len(done) >= DONE:
                            done.clear()
                        done.add(key)
                        post[i] = True
                own = post[rows]
                rows, sh = rows[own], sh[own]
                order_key = np.zeros(len(sh), np.int32)
                if len(value) and len(sh):
                    at = np.minimum(np.searchsorted(value, sh), len(value) - 1)
                    order_key = np.where(value[at] == sh, rank[at], 0)
                order = np.lexsort((sh, order_key, rows))
                first = np.searchsorted(rows, np.arange(b - a))
                pos = np.arange(len(rows)) - first[rows]
                n = size[rows]
                keep = pos <= n - (percent * n + 99) // 100
                picked = order[keep]  # rows are sorted, so the order only permutes inside a row
                yield pa.record_batch(
                    [pa.array(sh[picked].view(np.int64)), ids.slice(a, b - a).take(pa.array(rows[keep])), pa.array(n[keep].astype(np.int32)), pa.array(pos[keep].astype(np.int32))], schema=schema
                )

    return run, "shingle long, doc_id long, n int, pos int"


def _partnered(n: np.ndarray, pos: np.ndarray, percent: int) -> np.ndarray:
    """Postings of one list that can reach the needed overlap with another one's block of equal sizes."""
    order = np.lexsort((pos, n))
    sizes, start, count = np.unique(n[order], return_index=True, return_counts=True)
    least = pos[order][start].astype(np.int64)
    second = np.where(count > 1, pos[order][np.minimum(start + 1, len(order) - 1)], 1 << 40)
    out = np.zeros(len(n), bool)
    n, pos = n.astype(np.int64), pos.astype(np.int64)
    for i in range(0, len(n), 1024):
        a, p = n[i : i + 1024, None], pos[i : i + 1024, None]
        need = _needed(a, sizes[None], percent)
        other = np.where((a == sizes[None]) & (p == least[None]), second[None], least[None])  # not itself
        out[i : i + 1024] = ((p <= a - need) & (other <= sizes[None] - need) & (100 * np.minimum(a, sizes) >= percent * np.maximum(a, sizes))).any(1)
    return out


def _lists(percent: int):
    """Over postings sorted by shingle: of large lists those with a partner (other is null), of small lists the partnered pairs."""
    schema = pa.schema([("shingle", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int32()), ("other", pa.int64())])

    def partners(n, p, m, q):
        need = _needed(n, m, percent)
        return (p <= n - need) & (q <= m - need) & (100 * np.minimum(n, m) >= percent * np.maximum(n, m))

    def finish(parts):
        t, d, n, p = (np.concatenate(x) for x in zip(*parts, strict=True))
        n, p = n.astype(np.int64), p.astype(np.int64)
        start = np.flatnonzero(np.r_[True, t[1:] != t[:-1]]) if len(t) else np.zeros(0, np.int64)
        count = np.diff(np.r_[start, len(t)])
        first, second = [], []
        for size in range(2, SMALL_LIST + 1):
            own = start[count == size]
            for i in range(size):
                for j in range(i + 1, size):
                    ok = own[partners(n[own + i], p[own + i], n[own + j], p[own + j]) & (d[own + i] != d[own + j])]
                    first.append(ok + i)
                    second.append(ok + j)
        large = np.zeros(len(t), bool)
        for s, c in zip(start[count > SMALL_LIST].tolist(), count[count > SMALL_LIST].tolist(), strict=True):
            large[s : s + c] = _partnered(n[s : s + c], p[s : s + c], percent)
        yield pa.record_batch([pa.array(t[large]), pa.array(d[large]), pa.array(n[large].astype(np.int32)), pa.nulls(int(large.sum()), pa.int64())], schema=schema)
        x, y = (np.concatenate([np.zeros(0, np.int64), *v]) for v in (first, second))
        pairs = np.unique(np.sort(np.stack([d[x], d[y]], 1), 1), axis=0) if len(x) else np.zeros((0, 2), np.int64)
        none = pa.nulls(len(pairs), pa.int64())
        yield pa.record_batch([none, pa.array(pairs[:, 0]), pa.nulls(len(pairs), pa.int32()), pa.array(pairs[:, 1])], schema=schema)

    def run(batches):
        parts: list = []
        for batch in batches:
            if not batch.num_rows:
                continue
            t, d, n, p = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(4))
            last = int(np.searchsorted(t, t[-1]))
            if parts and parts[-1][0][0] == t[-1]:
                parts.append((t, d, n, p))
                continue
            parts.append((t[:last], d[:last], n[:last], p[:last]))
            yield from finish(parts)
            parts = [(t[last:], d[last:], n[last:], p[last:])]
        if parts:
            yield from finish(parts)

    return run, "shingle long, doc_id long, n int, other long"


def _tokens(k: int):
    schema = pa.schema([("doc_id", pa.int64()), ("tokens", pa.binary())])

    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id")
            for a, b, rows, sh in shingle_sets(batch.column("text"), k):
                at = np.searchsorted(rows, np.arange(b - a + 1))
                yield pa.record_batch([ids.slice(a, b - a), pa.array([sh[at[i] : at[i + 1]].tobytes() for i in range(b - a)], pa.binary())], schema=schema)

    return run, "doc_id long, tokens binary"


def _sketches(k: int):
    """Parity bitmaps of at least 4 bits an element; halves of one, xored, are that of half the bits."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("sketch", pa.binary())])

    def sketch(x: np.ndarray) -> bytes:
        bits = 64 << max(0, int(len(x) * 4 - 1).bit_length() - 6)
        return np.packbits((np.bincount((x & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()

    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id")
            for a, b, rows, sh in shingle_sets(batch.column("text"), k):
                at = np.searchsorted(rows, np.arange(b - a + 1))
                yield pa.record_batch([ids.slice(a, b - a), pa.array(np.diff(at)), pa.array([sketch(sh[at[i] : at[i + 1]]) for i in range(b - a)], pa.binary())], schema=schema)

    return run, "doc_id long, n long, sketch binary"


def _fold(x: np.ndarray, size: int) -> np.ndarray:
    while len(x) > size:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x


def _screened(percent: int):
    def run(batches):
        for rows in batches:
            keep = []
            for n, m, x, y in zip(rows["a_n"], rows["b_n"], rows["a_sketch"], rows["b_sketch"], strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                size = min(len(x), len(y))
                keep.append(100 * min(n, m) >= percent * max(n, m) and int(np.bitwise_count(_fold(x, size) ^ _fold(y, size)).sum()) <= n + m - 2 * _needed(n, m, percent))
            yield rows.loc[np.array(keep, bool), ["a", "b"]]

    return run, "a long, b long"


def _mates(percent: int):
    """Sets of one block that may link with one of another component, and those ones."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        hit: set = set()
        if len(left) and len(right):
            sketches = [np.frombuffer(x, np.uint64) for x in right["sketch"]]
            size, n, comp, rep = np.array([len(x) for x in sketches]), right["n"].to_numpy(), right["comp"].to_numpy(), right["rep"].to_numpy()
            # by size: the sets whose bitmaps are of that size or twice it, folded
            level = {z: (i := np.flatnonzero((size == z) | (size == 2 * z)), np.stack([_fold(sketches[j], z) for j in i])) for z in np.unique(np.r_[size, size // 2]).tolist() if z}
            for x in left.itertuples():
                own = np.frombuffer(x.sketch, np.uint64)
                for z in (len(own), len(own) // 2):
                    if z not in level or not z:
                        continue
                    at, bits = level[z]
                    ok = (comp[at] != x.comp) & (100 * np.minimum(n[at], x.n) >= percent * np.maximum(n[at], x.n)) & (size[at] >= len(own) if z == len(own) else size[at] == z)
                    at, bits = at[ok], bits[ok]
                    near = at[np.bitwise_count(bits ^ _fold(own, z)).sum(1) <= n[at] + x.n - 2 * _needed(n[at], x.n, percent)]
                    if len(near):
                        hit.add(x.rep)
                        hit.update(rep[near].tolist())
        return pd.DataFrame({"b": [left["leader"].iloc[0]] * len(hit) if hit else [], "a": sorted(hit)}, dtype="int64")

    return run, "b long, a long"


def _overlaps(batches):
    """Overlap of the two sets of each pair."""
    for rows in batches:
        out = rows[["a", "b"]].copy()
        sets = [(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(rows["a_tokens"], rows["b_tokens"], strict=True)]
        out["n"], out["m"] = [len(x) for x, _ in sets], [len(y) for _, y in sets]
        out["overlap"] = [len(np.intersect1d(x, y, assume_unique=True)) for x, y in sets]
        yield out


def _differences(batches):
    """What each set lacks of its list's central set and has beside it."""
    for rows in batches:
        out = []
        for x, y in zip(rows["a_tokens"], rows["b_tokens"], strict=True):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            out.append((len(x), len(y), np.setdiff1d(y, x, True).tobytes(), np.setdiff1d(x, y, True).tobytes()))
        yield pd.concat([rows[["a", "b"]].reset_index(drop=True), pd.DataFrame(out, columns=["n", "leader_n", "gone", "extra"])], axis=1)


def _derived(percent: int):
    columns = ["a", "b"]

    def flat(values: pd.Series) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        parts = [np.frombuffer(v, np.uint64) for v in values]
        size = np.array([len(p) for p in parts], np.int64)
        value, owner = np.concatenate(parts) if parts else np.zeros(0, np.uint64), np.repeat(np.arange(len(parts)), size)
        order = np.argsort(value, kind="stable")
        return value[order], owner[order], size

    def shared(token: np.ndarray, value: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
        lo, hi = np.searchsorted(value, token, "left"), np.searchsorted(value, token, "right")
        hit = hi > lo
        own = [owner[s:e] for s, e in zip(lo[hit].tolist(), hi[hit].tolist(), strict=True)]
        return np.bincount(np.concatenate(own), minlength=n) if own else np.zeros(n, np.int64)

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame(columns=columns, dtype="int64")
        gone, gone_by, gone_n = flat(right["gone"])
        extra, extra_by, extra_n = flat(right["extra"])
        n, comp, rep = right["n"].to_numpy(), right["comp"].to_numpy(), right["rep"].to_numpy()
        links = []
        for x in left.itertuples():
            g, e = np.frombuffer(x.gone, np.uint64), np.frombuffer(x.extra, np.uint64)
            need = _needed(n, x.n, percent)
            known = x.leader_n - len(g) - gone_n
            open_ = (comp != x.comp) & (known + np.minimum(len(g), gone_n) + np.minimum(len(e), extra_n) >= need)
            if not open_.any():
                continue
            both = known + shared(g, gone, gone_by, len(n)) + shared(e, extra, extra_by, len(n))
            hit = np.flatnonzero(open_ & (both >= need))
            if len(hit):  # one link to each component is enough
                _, at = np.unique(comp[hit], return_index=True)
                links += [(x.rep, rep[h]) for h in hit[at]]
        return pd.DataFrame(links, columns=columns, dtype="int64")

    return run, "a long, b long"


def jaccard_components(documents: DataFrame, percent: int = 80, k: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document row: doc_id, n_shingles, component_id (the smallest id reachable by links).

    Two documents link when 100 * intersection >= percent * union of their sets of distinct ``k``-word
    shingles (fewer words: the whole sequence). Null, empty and word-less texts have no shingles, link
    with nothing and are their own component. Rows that repeat an id are one document: links of any of
    its texts count. Rows with a null id link like others (inside, they go by a hash of their texts), but are
    never a component's name; a component of such rows alone has a null one. Other columns are ignored.
    """
    spark = documents.sparkSession
    own, text = F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`")
    docs = documents.select(F.coalesce(own, F.xxhash64(text)).alias("doc_id"), own.alias("id"), text.alias("text"))
    scan = cut(docs.mapInArrow(*_scan(k)), "sets")
    sets = scan.where("seen = -1").select("doc_id", "id", "n", "d1", "d2")
    reps = sets.where("n > 0").groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("rep"))
    docrep = cut(sets.join(reps, ["d1", "d2", "n"], "left").select("doc_id", "id", "n", "rep"), "reps")
    hot = scan.where("seen > 0").groupBy("shingle").agg(F.sum("seen").alias("seen")).orderBy(F.desc("seen"), "shingle").limit(RANKS).toArrow()
    value = hot.column("shingle").to_numpy().view(np.uint64)
    rank = np.arange(len(value), 0, -1, dtype=np.int32)
    order = np.argsort(value)
    ranks = spark.sparkContext.broadcast((value[order], rank[order]))

    postings = docs.mapInArrow(*_postings(k, percent, ranks))
    posted = cut(postings.repartition("shingle").sortWithinPartitions("shingle").mapInArrow(*_lists(percent)), "lists")
    ranks.destroy()
    owner = docrep.where("rep is not null").select("doc_id", "rep")
    small = posted.where("other is not null").select("doc_id", "other").distinct().join(owner, "doc_id").select("other", F.col("rep").alias("a")).join(owner.select(F.col("doc_id").alias("other"), F.col("rep").alias("b")), "other")
    small = small.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    lists = cut(posted.where("other is null").join(owner, "doc_id").select("shingle", "rep", "n").distinct(), "large-lists")
    # the set with the most company among its own shingles leads each large list
    count = lists.groupBy("shingle").agg(F.count("*").alias("c")).where("c > 1")
    company = lists.join(count, "shingle")
    score = company.groupBy("rep").agg((F.sum("c") / F.max("n")).alias("score"))
    leader = company.join(score, "rep").groupBy("shingle").agg(F.max(F.struct("score", (-F.col("rep")).alias("r"))).alias("m")).select("shingle", (-F.col("m.r")).alias("leader"))
    star = cut(lists.join(leader, "shingle").where("rep <> leader").select(F.col("rep").alias("a"), F.col("leader").alias("b")).distinct(), "star")
    pairs = cut(star.union(small).distinct(), "pairs")

    def of_ids(ids: DataFrame, make, name: str) -> DataFrame:
        wanted = bitmap_of(ids.distinct().select(F.xxhash64("doc_id").alias("h")), "h")
        return cut(docs.where(may_hold(wanted, F.xxhash64("doc_id"))).mapInArrow(*make(k)), name)

    def both(p: DataFrame, sets: DataFrame) -> DataFrame:
        for side in ("a", "b"):
            p = p.join(sets.select(F.col("doc_id").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in sets.columns if c != "doc_id"]), side)
        return p

    ends = lambda p: p.select(F.explode(F.array("a", "b")).alias("doc_id"))
    sketches = of_ids(ends(pairs), _sketches, "sketches")
    near = cut(both(pairs, sketches).mapInPandas(*_screened(percent)), "near")
    overlaps = both(near, of_ids(ends(near), _tokens, "tokens")).mapInPandas(_overlaps, "a long, b long, n long, m long, overlap long")
    links = cut(overlaps.where(100 * F.col("overlap") >= percent * (F.col("n") + F.col("m") - F.col("overlap"))).select("a", "b"), "links")
    label = components(links)

    # large lists with sets still apart from their central set
    root = lambda p, side: p.join(label.select(F.col("id").alias(side), F.col("root").alias(f"{side}_root")), side, "left").withColumn(f"{side}_root", F.coalesce(f"{side}_root", side))
    comp = root(root(star, "a"), "b").select("a", "b", F.col("a_root").alias("comp"), (F.col("a_root") != F.col("b_root")).alias("apart"))

    def blocks(members: DataFrame, run) -> DataFrame:
        sizes = members.groupBy("b").agg(F.sum(F.col("apart").cast("int")).alias("u"), F.count("*").alias("m")).where("u > 0 and m > 1")
        sizes = sizes.select(F.col("b").alias("leader"), F.ceil(F.col("u") / BLOCK).cast("int").alias("lefts"), F.ceil(F.col("m") / BLOCK).cast("int").alias("rights"))
        dealt = members.withColumnsRenamed({"a": "rep", "b": "leader"}).join(sizes, "leader")
        left = dealt.where("apart").withColumn("i", F.pmod(F.xxhash64("rep"), F.col("lefts")).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("rights") - 1)))
        right = dealt.withColumn("j", F.pmod(F.xxhash64("rep"), F.col("rights")).cast("int")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("lefts") - 1)))
        right = right.select(*[F.col(c).alias(c) for c in right.columns])  # new columns: both sides come from one table
        return left.groupBy("leader", "i", "j").cogroup(right.groupBy("leader", "i", "j")).applyInPandas(*run(percent))

    drawn = cut(comp.join(sketches.select(F.col("doc_id").alias("a"), "n", "sketch"), "a"), "open")
    mates = cut(blocks(drawn, _mates).distinct(), "mates")
    if mates.isEmpty():
        derived = links.limit(0)
    else:  # answers by differences to the central set
        apart = both(mates.select("a", "b"), of_ids(ends(mates), _tokens, "tokens")).mapInPandas(_differences, "a long, b long, n long, leader_n long, gone binary, extra binary")
        derived = blocks(cut(apart.join(comp, ["a", "b"]), "differences"), _derived)
    # texts of a repeated id are one document
    twice = docrep.where("rep is not null").groupBy("doc_id").agg(F.min("rep").alias("b"), F.max("rep").alias("most")).where("b <> most")
    twice = docrep.join(twice, "doc_id").where("rep <> b").select(F.col("rep").alias("a"), "b").distinct()
    label = joined_components(label, derived.union(twice))
    # a component's name is its smallest real id
    named = docrep.where("rep is not null").groupBy("rep").agg(F.min("id").alias("id")).join(label.select(F.col("id").alias("rep"), "root"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    named = cut(named, "named")
    names = cut(named.select("rep", "root").join(named.groupBy("root").agg(F.min("id").alias("component_id")), "root").select(F.col("rep").alias("key"), "component_id"), "names")
    keyed = docrep.withColumn("key", F.coalesce("rep", "doc_id"))  # sets without shingles meet nothing
    found = keyed.join(names, "key", "left")
    return found.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component_id")).alias("component_id"))
