"""Near-duplicate lines by a segment-partition edit join.

A line of length n is split into tau + 1 segments; a line within tau edits of it holds one of them at
nearly its place (Li, Deng, Wang & Feng, "Pass-Join", 2011). Segments are posted under (length, number,
text); a line probes the postings of lengths n - tau to n with the substrings whose places the number and
the lengths allow. Candidates are verified with a banded bit-parallel edit distance (Hyyro, 2003).

In each posting list one line is compared with all others. Lists whose lines aren't all connected by then
are open: small ones are compared inside a task, between components only. A large one is refined: in a pair
that the list stands for, its segment is unchanged, so what is left of the lines without the segment is
within tau edits, too, and is posted under the list's key by segments of its own. What is left gets shorter
each time, so no list of unrelated lines stays large, and no pairs of a list are written out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from axisframe.llm._deal import FLUSH, PACKED_DDL, Packer, bucket_bits, buckets, dealt, loose, run_starts
from axisframe.llm._graph import components, joined_components
from axisframe.llm._store import bitmap_of, cut, may_hold
from axisframe.llm._text import _MULT, SMALL_CHUNK, chunks, code_points, mix, prefix_hash_codes, span_hash

TAU, SIMILARITY = 2, 0.8
#: Open lists of at most so many lines are compared inside a task; larger ones are refined.
BLOCK = 512
#: A key's postings in one flush beyond this go past the bucket's task, which sees one of them.
HOT = FLUSH >> 8
_BAG = 32


def segments(n: np.ndarray, tau: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths (rows: lines, columns: segments) of the even partition; the last ones are longer."""
    short, more = n // (tau + 1), n % (tau + 1)
    i = np.arange(tau + 1)
    size = short[:, None] + (i[None] >= tau + 1 - more[:, None])
    return np.cumsum(size, 1) - size, size


def probes(tau: int) -> list[tuple[int, int, int]]:
    """(length difference, segment, shift of place) that a longer line must probe (multi-match-aware)."""
    out = []
    for d in range(tau + 1):
        for i in range(tau + 1):
            for s in range(max(-i, d - (tau - i)), min(i, d + (tau - i)) + 1):
                out.append((d, i, s))
    return out


def edit_distance(a: list[np.ndarray], b: list[np.ndarray], cap: int) -> np.ndarray:
    """Edit distances of a[i] and b[i] over code points, cap + 1 where beyond ``cap``.

    Banded and bit-parallel: a 64-bit word holds the band's column, of 2 * cap + 1 rows; all pairs step together.
    """
    if 2 * cap + 1 > 63:
        raise ValueError("the band is wider than a word")
    swap = [len(x) < len(y) for x, y in zip(a, b, strict=True)]
    p = [y if s else x for x, y, s in zip(a, b, swap, strict=True)]
    t = [x if s else y for x, y, s in zip(a, b, swap, strict=True)]
    out = np.full(len(p), cap + 1, np.int64)
    m, n = np.array([len(x) for x in p], np.int64), np.array([len(x) for x in t], np.int64)
    todo = np.flatnonzero(m - n <= cap)
    tiny = todo[m[todo] <= cap]
    for i in tiny:  # too short for a band
        row = np.arange(n[i] + 1)
        for c in p[i]:
            new = np.minimum(row[1:] + 1, row[:-1] + (t[i] != c))
            new = np.r_[row[0] + 1, new]
            row = np.minimum.accumulate(new - np.arange(len(new))) + np.arange(len(new))
        out[i] = min(row[-1], cap + 1)
    todo = todo[m[todo] > cap]
    todo = todo[np.argsort(n[todo], kind="stable")]
    at = 0
    while at < len(todo):
        # pairs of similar lengths, so that padding stays below the texts themselves
        stop = int(np.searchsorted(n[todo], 2 * n[todo[at]] + 64, "right"))
        stop = min(stop, at + 4096, at + max(1, (1 << 22) // int(max(1, n[todo[min(stop, len(todo)) - 1]]))))
        own = todo[at:stop]
        out[own] = _band([p[i] for i in own], [t[i] for i in own], m[own], n[own], cap)
        at = stop
    return out


def _band(p: list, t: list, m: np.ndarray, n: np.ndarray, cap: int) -> np.ndarray:
    steps = int(n.max()) if len(n) else 0
    pattern = np.zeros((steps + 3 * cap + 2, len(p)), np.uint32)  # 0 and the highest value stand for no character
    text = np.full((steps, len(p)), 0xFFFFFFFF, np.uint32)
    for j, (x, y) in enumerate(zip(p, t, strict=True)):
        pattern[cap : cap + len(x), j] = x + 1
        text[: len(y), j] = y + 1
    u = np.uint64
    vp, vn = np.full(len(p), (~0 << (63 - cap)) & 0xFFFFFFFFFFFFFFFF, u), np.zeros(len(p), u)
    score, one = np.full(len(p), cap, np.int64), u(1)
    shifts = [u(63 - cap + d) for d in range(-cap, cap + 1)]
    for i in range(steps):
        x = np.zeros(len(p), u)
        for d, s in enumerate(shifts):
            x |= (pattern[i + d] == text[i]).astype(u) << s
        d0 = (((x & vp) + vp) ^ vp) | x | vn
        hp, hn = vn | ~(d0 | vp), d0 & vp
        live, below = i < n, i < m - cap
        row = np.where(below, 0, 62 - (i - (m - cap))).clip(0, 63).astype(u)
        diagonal = 1 - (d0 >> u(63)).astype(np.int64)
        flat = ((hp >> row) & one).astype(np.int64) - ((hn >> row) & one).astype(np.int64)
        score += np.where(live, np.where(below, diagonal, flat), 0)
        vp, vn = hn | ~((d0 >> one) | hp), (d0 >> one) & hp
    return np.minimum(score, cap + 1)


def allowed(n: np.ndarray, tau: int, similarity: float) -> np.ndarray:
    """Edits that a pair may have whose longer line has n code points."""
    return np.minimum(tau, np.floor((1 - similarity) * n + 1e-9)).astype(np.int64)


def keyed(code: np.ndarray, char: np.ndarray, n: np.ndarray, salt: np.ndarray, tau: int, similarity: float):
    """(row, key, own, start, size) of the keys of strings code[char[i]:char[i + 1]], left of lines of n code points.

    Own segments come for each number of edits that a pair with the line may be allowed; probes for that of
    pairs in which it is the longer one. ``salt`` tells lists of lists apart. Strings too short for segments
    have a list for their length and for each one that a pair may have.
    """
    pre, base, size_of = prefix_hash_codes(code), char[:-1], np.diff(char)
    out: list = []
    for t in range(1, tau + 1):
        own = np.zeros(len(n), bool)
        for d in range(tau + 1):
            own |= (allowed(n + d, tau, similarity) == t) & (d <= t)
        probing = allowed(n, tau, similarity) == t
        for d in range(t + 1):
            start, size = segments(size_of - d, t)
            for dd, i, s in probes(t):
                if dd != d:
                    continue
                mine = d == 0 and s == 0
                at = start[:, i] + s
                row = np.flatnonzero((own if mine else probing) & (at >= 0) & (size[:, i] > 0) & (at + size[:, i] <= size_of))
                at, m = at[row], size[row, i]
                h = span_hash(pre, base[row] + at, base[row] + at + m)
                key = mix(h ^ ((size_of[row] - d).astype(np.uint64) * _MULT[50]) ^ (_MULT[51] + np.uint64(8 * t + i)) ^ salt[row])
                out.append((row, key, np.full(len(row), mine), at, m))
    row = np.flatnonzero(size_of <= 2 * allowed(n + tau, tau, similarity))
    for d in range(tau + 1):
        key = mix(((size_of[row] + d).astype(np.uint64) * _MULT[52]) ^ salt[row])
        out.append((row, key, np.ones(len(row), bool), np.zeros(len(row), np.int64), np.zeros(len(row), np.int64)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


#: Lines that a task remembers to have posted: those forgotten are posted once more, as by another task.
DONE = 1 << 18


def _postings(tau: int, similarity: float, bits: int):
    """Packed (key, line): a line's name is even, its last bit tells the line's own segments from probes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, done = Packer(bits), set()

        def flushed():
            key, line = packer.taken()
            order = np.argsort(key, kind="stable")
            key, line = key[order], line[order]
            at, count = run_starts(key)
            if (count > HOT).any():
                hot = np.repeat(count > HOT, count)
                yield loose([key[hot], line[hot]])
                own = np.flatnonzero(hot & (line & 1 == 1))
                own = own[np.r_[True, key[own][1:] != key[own][:-1]]] if len(own) else own
                some = np.concatenate([at[count > HOT], at[count > HOT] + 1, own])  # the list's key lives on in its bucket
                key, line = np.concatenate([key[~hot], key[some]]), np.concatenate([line[~hot], line[some]])
            yield packer.pack([key, line])

        for batch in batches:
            names = batch.column("line").to_numpy()
            for a, b, data, off in chunks(batch.column("text"), SMALL_CHUNK):
                fresh = []
                for i, x in enumerate(names[a:b].tolist()):
                    if x not in done:
                        if len(done) >= DONE:
                            done.clear()
                        done.add(x)
                        fresh.append(i)
                fresh = np.array(fresh, np.int64)
                code, char = code_points(data, off)
                n = np.diff(char)[fresh]
                code = code[np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n - char[fresh], n)]
                row, key, own, _, _ = keyed(code, np.r_[0, np.cumsum(n)], n, np.zeros(len(n), np.uint64), tau, similarity)
                packer.add(key, names[a:b][fresh][row] | own)
                if packer.n >= FLUSH:
                    yield from flushed()
        if packer.n:
            yield from flushed()

    return run, PACKED_DDL


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, line, own) of lists with an own segment and at least two lines."""
    for hot, (key, line) in buckets(batches, ["<u8", "<i8"]):
        if hot:
            keep = np.ones(len(key), bool)
        else:
            at, count = run_starts(key)
            name = line & ~np.int64(1)
            good = (np.maximum.reduceat(line & 1, at) == 1) & (np.maximum.reduceat(name, at) > np.minimum.reduceat(name, at))
            keep = np.repeat(good, count)
        yield pa.record_batch([pa.array(key[keep].view(np.int64)), pa.array(line[keep] & ~np.int64(1)), pa.array((line[keep] & 1) == 1)], names=["key", "line", "own"])


def _codes(texts) -> list[np.ndarray]:
    return [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]


def _close(a: list[np.ndarray], b: list[np.ndarray], tau: int, similarity: float) -> np.ndarray:
    if not a:
        return np.zeros(0, bool)
    longer = np.maximum([len(x) for x in a], [len(x) for x in b])
    return edit_distance(a, b, tau) <= allowed(longer, tau, similarity)


def _verified(tau: int, similarity: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield rows.loc[_close(_codes(rows["text_a"]), _codes(rows["text_b"]), tau, similarity), ["a", "b"]]

    return run, "a binary, b binary"


def _bags(codes: list[np.ndarray]) -> np.ndarray:
    """Counts of characters in classes: an edit changes two of them by one at most."""
    size = np.array([len(c) for c in codes], np.int64)
    cell = np.repeat(np.arange(len(codes)), size) * _BAG + (np.concatenate(codes) % _BAG).astype(np.int64)
    return np.minimum(np.bincount(cell, minlength=len(codes) * _BAG), 1 << 14).reshape(-1, _BAG).astype(np.int16)


def _compared(tau: int, similarity: float):
    """Links between components inside lists; rows come sorted by list, a list has BLOCK lines at most."""

    def links(key, ids, own, comp, texts) -> pa.RecordBatch:
        codes = _codes(texts)
        n, bags = np.array([len(c) for c in codes], np.int64), _bags(codes)
        at, count = run_starts(key)
        left, right = [], []
        for s, c in zip(at.tolist(), count.tolist(), strict=True):
            for i in range(0, c, 64):
                a, b = np.arange(s + i, min(s + i + 64, s + c))[:, None], np.arange(s + i + 1, s + c)[None]
                near = (b > a) & (own[a] | own[b]) & (comp[a] != comp[b]) & (np.abs(n[a] - n[b]) <= tau)
                x, y = np.nonzero(near)
                x, y = a[x, 0], b[0, y]
                ok = np.abs(bags[x] - bags[y]).sum(1) <= 2 * tau
                left.append(x[ok])
                right.append(y[ok])
        x, y = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (left, right))
        near = _close([codes[i] for i in x], [codes[i] for i in y], tau, similarity)
        return pa.record_batch([pa.array([ids[i] for i in x[near]], pa.binary()), pa.array([ids[i] for i in y[near]], pa.binary())], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        size = 0

        def done(upto: int):
            nonlocal held, size
            key, ids, own, comp, text = (list(v) for v in zip(*held[:upto], strict=True))
            held = held[upto:]
            size = sum(len(r[4]) for r in held)
            return links(np.array(key), ids, np.array(own, bool), np.unique(np.array(comp, object), return_inverse=True)[1], text)

        for batch in batches:
            for r in zip(*(batch.column(c).to_pylist() for c in ("key", "id", "own", "comp", "text")), strict=True):
                if size > 1 << 20 and held[-1][0] != r[0]:
                    yield done(len(held))
                held.append(r)
                size += len(r[4])
        if held:
            yield done(len(held))

    return run, "a binary, b binary"


def _refined(tau: int, similarity: float):
    """Members (key, salt, id, n, rest) of large lists posted anew under their list, by what is left without its segment."""
    schema = pa.schema([("key", pa.int64()), ("salt", pa.int64()), ("id", pa.binary()), ("n", pa.int64()), ("rest", pa.binary()), ("own", pa.bool_())])
    none = np.zeros(0, np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rests = [np.frombuffer(x, ">u4").astype(np.uint32) for x in batch.column("rest").to_pylist()]
            n = batch.column("n").to_numpy()
            list_key, salt = (batch.column(c).to_numpy().view(np.uint64) for c in ("key", "salt"))
            ends = lambda texts: np.r_[0, np.cumsum([len(x) for x in texts])].astype(np.int64)
            row, key, _, at, m = keyed(np.concatenate([*rests, none]), ends(rests), n, salt, tau, similarity)
            hit = (key == list_key[row]) & (m > 0)
            row, at, m = row[hit], at[hit], m[hit]
            left = [np.concatenate([rests[i][:s], rests[i][s + k :]]) for i, s, k in zip(row.tolist(), at.tolist(), m.tolist(), strict=True)]
            again, key, own, _, _ = keyed(np.concatenate([*left, none]), ends(left), n[row], list_key[row], tau, similarity)
            source = pa.array(row[again])
            yield pa.record_batch(
                [pa.array(key.view(np.int64)), batch.column("key").take(source), batch.column("id").take(source), pa.array(n[row[again]]), pa.array([left[i].astype(">u4").tobytes() for i in again.tolist()], pa.binary()), pa.array(own)],
                schema=schema,
            )

    return run, "key long, salt long, id binary, n long, rest binary, own boolean"


def _numbered(documents: DataFrame, row: Column, id_col: str, text_col: str) -> DataFrame:
    """Every line of every row: row, doc_id, line_no, text; a null text is one empty line."""
    docs = documents.select(row.alias("row"), F.col(f"`{id_col}`").alias("doc_id"), F.split(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), "\n").alias("lines"))
    return docs.select("row", "doc_id", F.posexplode("lines").alias("line_no", "text"))


def _blank(text: str) -> Column:
    return F.btrim(F.col(text), F.lit(" \t\r\x0b\x0c")) == ""


def _first() -> Column:
    """Order of lines: by id, nulls last, then by row and number."""
    return F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "row", "line_no")


def _links(texts: DataFrame, lists: DataFrame, tau: int, similarity: float, block: int) -> DataFrame:
    """(id, root) of the lines that the lists (key, line, own) link; ``texts``: (id, line, text)."""

    def starred(member: DataFrame, name: str) -> DataFrame:
        leader = member.where("own").groupBy("key").agg(F.min(name).alias("leader"))
        star = member.join(leader, "key").where(F.col(name) != F.col("leader")).select(F.col(name).alias("member"), "leader").distinct()
        side = lambda s, key: texts.select(F.col(name).alias(key), F.col("id").alias(s), F.col("text").alias(f"text_{s}"))
        return star.join(side("a", "member"), "member").join(side("b", "leader"), "leader").select("a", "b", "text_a", "text_b").mapInPandas(*_verified(tau, similarity))

    label = components(cut(starred(lists, "line"), "links"))
    member = lists.join(texts.select("id", "line"), "line").select("key", F.lit(0).cast("long").alias("salt"), "id", "own")
    tiny = 8 * tau  # bytes of what is too short for segments
    while True:
        member = member.join(label, "id", "left").withColumn("comp", F.coalesce("root", "id")).drop("root")
        size = member.groupBy("key").agg(F.count_distinct("id").alias("m"), F.min("comp").alias("c1"), F.max("comp").alias("c2"), F.bit_xor(F.xxhash64("id", "own")).alias("x"), F.bit_xor(F.xxhash64("own", "id")).alias("y"))
        # lists of the same lines, such as those of a group's several segments, are compared once
        size = size.where("m > 1 and c1 <> c2").groupBy("m", "x", "y").agg(F.min("key").alias("key")).select("key", "m")
        open_ = cut(member.join(size, "key").join(texts.select("id", "text"), "id"), "open-lists")
        if "rest" not in open_.columns:
            open_ = open_.withColumn("rest", F.encode("text", "UTF-32")).withColumn("n", F.length("text").cast("long"))
        small = open_.where(F.col("m") <= block).select("key", "id", "own", "comp", "text")
        wide = open_.where(F.col("m") > block)
        wide = wide.join(wide.groupBy("key").agg(F.max(F.octet_length("rest")).alias("longest")), "key")
        # where all that is left is too short to be refined, its strings are few, and are compared by pairs of blocks
        blocks = F.ceil(F.col("m") / block).cast("int")
        own_block = F.pmod(F.xxhash64("id"), blocks)
        paired = wide.where(F.col("longest") <= tiny).withColumn("j", F.explode(F.sequence(F.lit(0), blocks - 1)))
        paired = paired.select(F.xxhash64("key", F.least("j", own_block), F.greatest("j", own_block)).alias("key"), "id", "own", "comp", "text")
        compared = small.union(paired).groupBy("key", "id").agg(F.bool_or("own").alias("own"), F.first("comp").alias("comp"), F.first("text").alias("text")).repartition("key").sortWithinPartitions("key")
        label = joined_components(label, compared.mapInArrow(*_compared(tau, similarity)))
        large = wide.where(F.col("longest") > tiny).select("key", "salt", "id", "n", "rest")
        if large.isEmpty():
            return label
        member = cut(large.mapInArrow(*_refined(tau, similarity)).groupBy("key", "salt", "id", "rest").agg(F.max("n").alias("n"), F.bool_or("own").alias("own")), "refined")
        label = joined_components(label, starred(member, "id"))


def _classes(documents: DataFrame, row: Column, tau: int, similarity: float, min_chars: int, block: int, id_col: str, text_col: str) -> DataFrame:
    """One row per line, blank ones left out but for a row's first: row, doc_id, line_no, n, real, first (z, doc_id, row, line_no), n_others."""
    real = ~_blank("text") & (F.length("text") >= min_chars)
    lines = _numbered(documents, row, id_col, text_col).where(real | (F.col("line_no") == 0))
    lines = cut(lines.select("row", "doc_id", "line_no", F.length("text").alias("n"), F.when(real, F.unhex(F.md5("text"))).alias("id")), "lines")
    least = int(np.flatnonzero(allowed(np.arange(1 << 12), tau, similarity) > 0).min(initial=1 << 12))
    long = _numbered(documents, F.lit(0), id_col, text_col).where(~_blank("text") & (F.length("text") >= max(min_chars, least - tau)))
    long = long.select(F.xxhash64("text").bitwiseAND(F.lit(-2)).alias("line"), "text")
    packed = long.mapInArrow(*_postings(tau, similarity, bucket_bits(documents.sparkSession)))
    lists = cut(dealt(packed).mapInArrow(_lists, "key long, line long, own boolean").groupBy("key", "line").agg(F.bool_or("own").alias("own")), "lists")
    listed = lists.select("line").distinct()
    texts = long.where(may_hold(bitmap_of(listed, "line"), F.col("line"))).groupBy(F.unhex(F.md5("text")).alias("id")).agg(F.first("line").alias("line"), F.first("text").alias("text")).join(listed, "line", "left_semi")
    label = _links(cut(texts, "texts"), lists, tau, similarity, block)
    # first line and number of lines, by text, then by class; only classes of several lines meet the lines again
    by_text = lines.where("id is not null").groupBy("id").agg(F.min(_first()).alias("first"), F.count("*").alias("m")).join(label, "id", "left").withColumn("class", F.coalesce("root", "id"))
    by_text = cut(by_text.select("id", "class", "first", "m"), "line-texts")
    whole = by_text.groupBy("class").agg(F.min("first").alias("first"), F.sum("m").alias("m")).where("m > 1")
    again = cut(by_text.select(F.col("id").alias("key"), "class").join(whole, "class").select("key", "first", "m"), "line-classes")
    keyed_lines = lines.withColumn("key", F.coalesce("id", F.col("row").cast("string").cast("binary")))  # lines without an id meet nothing, each in its own place
    return keyed_lines.join(again, "key", "left").select("row", "doc_id", "line_no", "n", F.col("id").isNotNull().alias("real"), F.coalesce("first", _first()).alias("first"), (F.coalesce("m", F.lit(1)) - 1).cast("long").alias("n_others")).withColumn("again", F.col("first") != _first())


def line_classes(documents: DataFrame, tau: int = TAU, similarity: float = SIMILARITY, min_chars: int = 1, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per line: row, doc_id, line_no, n (code points), first_doc, first_line, n_others.

    Lines are parted by newlines; those of white space alone only separate others and have no row. Equal
    lines link; others link when at most min(``tau``, (1 - ``similarity``) * length of the longer one) edits
    apart, so that with the defaults lines below 5 code points link when equal, those below 10 at one edit. A
    class is what links connect. ``first_*`` is its first line by id (null ids last), row and number; with it
    the class's lines are pairs with a representative plus membership. n_others counts the class's other
    lines. ``row`` is a number of each table row, so rows that repeat an id keep their lines apart.
    ``min_chars`` leaves shorter lines out (default: none). Null texts have no lines; an empty table gives no
    rows; other columns are ignored.
    """
    out = _classes(documents, F.monotonically_increasing_id(), tau, similarity, min_chars, block, id_col, text_col).where("real")
    return out.select("row", "doc_id", "line_no", "n", F.col("first.doc_id").alias("first_doc"), F.col("first.line_no").alias("first_line"), "n_others")


def line_report(documents: DataFrame, tau: int = TAU, similarity: float = SIMILARITY, min_chars: int = 1, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document row: doc_id, n_lines, n_dropped (lines that repeat an earlier one), repeats_of (the documents whose lines it repeats, sorted, nulls left out), n_others."""
    out = _classes(documents, F.monotonically_increasing_id(), tau, similarity, min_chars, block, id_col, text_col)
    per = out.groupBy("row", "doc_id").agg(
        F.sum(F.col("real").cast("long")).alias("n_lines"), F.sum(F.col("again").cast("long")).alias("n_dropped"), F.sort_array(F.collect_set(F.when(F.col("again"), F.col("first.doc_id")))).alias("repeats_of"), F.sum("n_others").alias("n_others")
    )
    return per.drop("row")


def dedup_lines(documents: DataFrame, tau: int = TAU, similarity: float = SIMILARITY, min_chars: int = 1, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without the lines that repeat an earlier line; documents that lose all their lines go.

    All columns stay. Rows with a null text stay as they are, those with a null id come last in the order of
    lines. Blank lines stay, but don't keep a document whose other lines all went. The table is written once
    with numbers of its rows, so that lines go from the row they were read from.
    """
    taken = set(documents.columns)
    row, gone = (next(n for n in (f"{name}{'_' * i}" for i in range(len(taken) + 1)) if n not in taken) for name in ("row", "gone"))
    docs = cut(documents.withColumn(row, F.monotonically_increasing_id()), "numbered")
    again = _classes(docs, F.col(f"`{row}`"), tau, similarity, min_chars, block, id_col, text_col).where("again")
    out = docs.join(again.groupBy(F.col("row").alias(row)).agg(F.collect_set("line_no").alias(gone)), row, "left")
    kept = F.filter(F.split(F.col(f"`{text_col}`"), "\n"), lambda x, i: ~F.coalesce(F.array_contains(F.col(gone), i), F.lit(False)))
    text = F.when(F.col(gone).isNull(), F.col(f"`{text_col}`")).otherwise(F.array_join(kept, "\n"))
    left = F.col(gone).isNull() | F.exists(kept, lambda x: F.btrim(x, F.lit(" \t\r\x0b\x0c")) != "")
    return out.where(left).withColumn(text_col, text).select(*[F.col(f"`{c}`") for c in documents.columns])
