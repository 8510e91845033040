"""Repeated passages by collinear chaining of shared seeds.

A seed is a run of k words whose first part has the least hash of its parts (an open syncmer): which runs are
seeds depends on the run alone, so two documents that share a run agree on it. With a seed go fingerprints of
its context, the words up to the shortest passage's length from it on either side. Rows of a seed with the same
context are copies: those of later documents are joined with the first one, whose context holds every shortest
passage around the seed. Rows with different contexts are all joined with each other, so whoever else holds a
seed never comes between two documents: of a passage's verbatim copies, the earliest one is first under every
seed, so a later document meets it with all of them. Where two documents share runs of seeds, the ends and the
least of each few seeds stand for the run.

Seeds with very many contexts go in two steps. Their rows are joined with the first and preceding documents.
Where that leaves a seed's words out of every passage, the row is compared with all earlier rows of the seed, in
blocks inside tasks: pairs with as many equal pairs of words around the seed as a passage keeps are candidates.
No pair is written before.

A pair's matches on one diagonal are segments, ordered segments are chained with gap costs (prefix maxima in a
Fenwick tree), and chains are aligned word by word, which finds passages with changed, missing or added words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axisframe.llm._deal import FLUSH, PACKED_DDL, Packer, bucket_bits, buckets, dealt, loose, run_starts
from axisframe.llm._store import bitmap_of, cut, may_hold
from axisframe.llm._text import _MULT, _grow, chunks, mix, span_hash, windows, words

#: Seeds are 4-word runs whose first 2-word part has the least hash of the three: a third of all runs.
K, SUB = 4, 2
MIN_WORDS, SIMILARITY = 50, 0.8
#: Words between two segments of a passage on either side, at most; what a word of gap costs a chain.
MAX_GAP, GAP_COST = 40, 0.25
#: A seed's rows in one flush beyond this are joined with their copies where they were read.
HOT = FLUSH >> 11
#: Contexts of a seed that are joined outright; of more, those left open are compared in blocks of about so many rows.
MOST, BLOCK = 32, 1 << 13
#: Rows that hold a run of words, at most, where partners are looked up by it.
FEW = 64
#: Pairs of rows at a time, at most; seeds of which the least one stands for a shared run.
PAIRS, STAND_IN = 1 << 20, 7
#: Seed, document, place, context, seed before and after, words after (highest bit: stands for a run).
_SEED, _PAIR = ["<u8", "<i8", "<i4", "<u4", "<u2", "<u2", "<u2"], ["<u8", "<i8", "<i8", "<i4", "<i4", "<i4"]


def _pairs(doc: np.ndarray, other: np.ndarray, pos: np.ndarray, opos: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
    """Columns of matches; the key brings a pair's matches together."""
    return [mix(doc.view(np.uint64) * _MULT[60] + other.view(np.uint64) * _MULT[61]), doc, other, pos.astype(np.int32), opos.astype(np.int32), np.broadcast_to(size, len(doc)).astype(np.int32)]


def _rising(x: np.ndarray) -> np.ndarray:
    """The different values, rising: by sorting, which is faster here than numpy's hash table."""
    x = np.sort(x)
    return x[np.r_[True, x[1:] != x[:-1]]] if len(x) else x


def _heads(rows: np.ndarray, *marks: np.ndarray) -> np.ndarray:
    """For each of the rising ``rows``, the first one with the same marks."""
    order = np.lexsort((rows, *(m[rows] for m in marks)))
    at = rows[order]
    new = np.r_[True, np.logical_or.reduce([m[at[1:]] != m[at[:-1]] for m in marks])] if len(at) else np.zeros(0, bool)
    out = np.empty(len(rows), np.int64)
    out[order] = at[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))] if len(at) else at
    return out


def _copies(rows: list[np.ndarray], k: int, n: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Matches of rows with the first row of the same seed and context, where that is of another document; and the other rows."""
    seed, doc, pos, context, _, _, span = rows
    first = _heads(np.arange(len(seed)), context, seed)
    a = np.flatnonzero(doc != doc[first])
    b = first[a]
    back = np.minimum(pos[a] + k, n) - k
    return _pairs(doc[a], doc[b], pos[a] - back, pos[b] - back, back + (span[a] & np.uint16(0x7FFF))), np.flatnonzero(doc == doc[first])


def _earlier(own: np.ndarray, seed: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Each row with all rows before it under its seed, a bounded number of pairs at a time."""
    at, count = run_starts(seed[own])
    start = np.repeat(at, count)
    many = np.arange(len(own)) - start
    total = np.cumsum(many)
    i = 0
    while i < len(own):
        j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + PAIRS, "right")))
        m = many[i:j]
        left = np.repeat(np.arange(i, j), m)
        yield own[left], own[np.arange(len(left)) - np.repeat(np.cumsum(m) - m, m) + start[left]]
        i = j


def _joined(rows: list[np.ndarray], k: int, n: int, thin: bool, most: int = MOST) -> Iterator[list[np.ndarray]]:
    """Matches among rows sorted by seed, document and place.

    A match has its words as size: a seed's, as a negative number for a run of seeds, or a passage's. Rows of seeds
    with more than ``most`` contexts also go on themselves, as size 0 with the seed instead of the other document.
    """
    seed, doc, pos, _, behind, ahead, span = rows
    match, own = _copies(rows, k, n)
    yield match
    at, count = run_starts(seed[own])
    many = np.repeat(count > most, count)
    for a, b in _earlier(own[~many], seed):
        other = doc[a] != doc[b]
        a, b = a[other], b[other]
        size = np.full(len(a), k)
        if thin:
            left, right = (behind[a] == behind[b]) & (behind[a] > 0), (ahead[a] == ahead[b]) & (ahead[a] > 0)
            size[left | right] = -k
            keep = ~(left & right) | (((span[a] | span[b]) >> np.uint16(15)) > 0)
            a, b, size = a[keep], b[keep], size[keep]
        yield _pairs(doc[a], doc[b], pos[a], pos[b], size)
    hot = own[many]
    if not len(hot):
        return
    first = _heads(hot, seed)
    new = np.r_[True, (seed[hot][1:] != seed[hot][:-1]) | (doc[hot][1:] != doc[hot][:-1])]
    begins = np.flatnonzero(new)
    last = hot[begins[np.maximum(np.cumsum(new) - 2, 0)]]
    last = np.where(seed[last] == seed[hot], last, first)
    other = last != first
    for a, b in ((hot, first), (hot[other], last[other])):
        a, b = a[doc[a] != doc[b]], b[doc[a] != doc[b]]
        yield _pairs(doc[a], doc[b], pos[a], pos[b], k)
    yield _pairs(doc[hot], seed[hot].view(np.int64), pos[hot], pos[hot], 0)


def _sorted(columns: list[np.ndarray], least: int = 2) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Rows of seeds with ``least`` rows at least, sorted by seed, document and place; and the other rows."""
    order = np.argsort(columns[0], kind="stable")
    columns = [c[order] for c in columns]
    _, count = run_starts(columns[0])
    many = np.repeat(count >= least, count)
    rest, own = [c[~many] for c in columns], [c[many] for c in columns]
    order = np.lexsort((own[2], own[1], own[0]))
    return [c[order] for c in own], rest


def _gathered(packer: Packer, k: int, n: int) -> Iterator[pa.RecordBatch]:
    """What a task has collected: matches of copies among very frequent seeds' rows, and the rows it passes on."""
    hot, rest = _sorted(packer.taken(), HOT)
    if len(hot[0]):
        match, own = _copies(hot, k, n)
        if len(match[0]):
            yield loose(match)
        rest = [np.concatenate([c, x[own]]) for c, x in zip(rest, hot, strict=True)]
    yield packer.pack(rest)


def _least_of(seed: np.ndarray, own: np.ndarray, w: int = STAND_IN) -> np.ndarray:
    """Which seeds are the least of ``w`` following ones of their document."""
    out = np.zeros(len(seed), bool)
    if len(seed) < w:
        return out
    order, at = mix(seed), np.flatnonzero(own[w - 1 :] == own[: len(own) - w + 1])
    least = np.minimum.reduce([order[at + i] for i in range(w)])
    for i in range(w):
        out[at[order[at + i] == least] + i] = True
    return out


def _seeds(k: int, sub: int, n: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(bits)
        for batch in batches:
            ids = batch.column("doc_id").to_numpy()
            for a, b, data, off in chunks(batch.column("text")):
                _, _, row, h = words(data, off)
                at, g = windows(h, row, k)
                if not len(at):
                    continue
                if sub < k:
                    part = np.full(len(h), np.iinfo(np.uint64).max, np.uint64)
                    i, p = windows(h, row, sub)
                    part[i] = p
                    chosen = part[at] < np.minimum.reduce([part[at + i] for i in range(1, k - sub + 1)])
                    at, g = at[chosen], g[chosen]
                pre = np.zeros(len(h) + 1, np.uint64)
                np.cumsum(h * _grow(len(h) + 1)[0][: len(h)], out=pre[1:])
                own = row[at]
                pos, words_of = at - np.searchsorted(row, own), np.bincount(row, minlength=b - a)[own]
                long = words_of >= n  # shorter texts hold no passage
                at, g, own, pos, words_of = at[long], g[long], own[long], pos[long], words_of[long]
                if not len(at):
                    continue
                right, left = np.minimum(words_of - pos, n), np.minimum(pos + k, n)
                context = (mix(span_hash(pre, at + k - left, at + right) + left.astype(np.uint64) * _MULT[5]) >> np.uint64(32)).astype(np.uint32)
                follows = np.r_[False, own[1:] == own[:-1]]
                step = np.r_[0, np.diff(at)].astype(np.uint64)
                behind = np.where(follows, (mix(np.r_[g[:1], g[:-1]] + step * _MULT[1]) >> np.uint64(48)) | np.uint64(1), 0).astype(np.uint16)
                ahead = np.r_[np.where(follows[1:], (mix(g[1:] + step[1:] * _MULT[2]) >> np.uint64(48)) | np.uint64(1), 0), 0].astype(np.uint16)
                span = (np.minimum(right, 0x7FFF) | np.where(_least_of(g, own), 0x8000, 0)).astype(np.uint16)
                packer.add(g, ids[a:b][own], pos.astype(np.int32), context, behind, ahead, span)
                if packer.n >= FLUSH:
                    yield from _gathered(packer, k, n)
        if packer.n:
            yield from _gathered(packer, k, n)

    return run, PACKED_DDL


def _matches(k: int, n: int, bits: int, thin: bool, most: int = MOST):
    """Packed matches of the seeds of each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(bits)
        for done, columns in buckets(batches, _SEED, _PAIR):
            if done:
                packer.add(*columns)
            else:
                rows, _ = _sorted(columns)
                for match in _joined(rows, k, n, thin, most) if len(rows[0]) else ():
                    packer.add(*match)
                    if packer.n >= FLUSH:
                        yield packer.pack()
            if packer.n >= FLUSH:
                yield packer.pack()
        if packer.n:
            yield packer.pack()

    return run, PACKED_DDL


class Fenwick:
    """Prefix maxima of (score, item)."""

    def __init__(self, n: int):
        self.best = [(-np.inf, -1)] * (n + 1)

    def put(self, i: int, score: float, item: int) -> None:
        i += 1
        while i < len(self.best):
            if score > self.best[i][0]:
                self.best[i] = (score, item)
            i += i & -i

    def most(self, i: int) -> tuple[float, int]:
        """Over places below ``i``."""
        out = (-np.inf, -1)
        while i > 0:
            if self.best[i][0] > out[0]:
                out = self.best[i]
            i -= i & -i
        return out


def chains(pos: np.ndarray, other: np.ndarray, k: int = 5, window: int = 8, gap_cost: float = GAP_COST, max_gap: int = MAX_GAP) -> list[np.ndarray]:
    """Chains of segments (start, stop, other start) of matching k-word seeds, best first, none in two chains."""
    diagonal = pos.astype(np.int64) - other
    order = np.lexsort((pos, diagonal))
    p, d = pos[order].astype(np.int64), diagonal[order]
    new = np.r_[True, (d[1:] != d[:-1]) | (p[1:] - p[:-1] > window)]
    at = np.flatnonzero(new)
    return chained(p[at], p[np.r_[at[1:], len(p)] - 1] + k, p[at] - d[at], k, gap_cost, max_gap)


def chained(start: np.ndarray, stop: np.ndarray, first_other: np.ndarray, k: int, gap_cost: float = GAP_COST, max_gap: int = MAX_GAP, seeds: np.ndarray | None = None, least: int = 0) -> list[np.ndarray]:
    """Chains of the segments [start, stop) that match [first_other, ...): a segment's last seed lies behind its forerunner's on both sides.

    Of the chains, those that hold ``least`` seeds, given for each segment.
    """
    n = len(start)
    seeds = np.zeros(n, np.int64) if seeds is None else seeds
    if n == 1:
        return [np.stack([start, stop, first_other], 1)] if seeds[0] >= least else []
    order = np.lexsort((first_other, start))
    start, stop, first_other, seeds = start[order], stop[order], first_other[order], seeds[order]
    last, size = stop - k, (stop - start).astype(float)
    last_other = first_other + last - start
    score, back = size.copy(), np.full(n, -1)
    ends = np.unique(last_other)
    rank, below = np.searchsorted(ends, last_other), np.searchsorted(ends, first_other)
    tree, by_end, done = Fenwick(len(ends)), np.argsort(last, kind="stable"), 0
    for j in range(n):  # by start: segments that ended before it are in the tree
        while done < n and last[by_end[done]] < start[j]:
            i = by_end[done]
            tree.put(int(rank[i]), score[i] + gap_cost * (last[i] + last_other[i]), int(i))
            done += 1
        value, i = tree.most(int(below[j]))
        gain = value - gap_cost * (start[j] + first_other[j] - 2 * k)
        if i >= 0 and gain > 0:
            score[j], back[j] = size[j] + gain, i
    out, used = [], np.zeros(n, bool)
    for j in np.argsort(-score, kind="stable").tolist():
        path = []
        while j >= 0 and not used[j]:
            used[j] = True
            path.append(j)
            j = back[j]
        if not path:
            continue
        path = np.array(path[::-1])
        wide = (start[path[1:]] - stop[path[:-1]] > max_gap) | (first_other[path[1:]] - last_other[path[:-1]] - k > max_gap)
        for part in np.split(path, np.flatnonzero(wide) + 1):
            if seeds[part].sum() >= least:
                out.append(np.stack([start[part], stop[part], first_other[part]], 1))
    return out


def least_seeds(k: int, sub: int, min_words: int, similarity: float) -> int:
    """Seeds that a chain needs: what the shortest passage keeps when each changed word spoils all ``k`` runs that hold it, by the share of runs that are seeds."""
    return max(1, (min_words - k + 1 - k * int(round((1 - similarity) * min_words, 6))) // (k - sub + 1))


def _chained(k: int, sub: int, min_words: int, similarity: float, alone: bool = False):
    """Per pair with a chain of enough seeds (``alone``: each segment is one): doc_id, other, its chains' segments (chain, start, stop, other start), and the words they lie in, with a margin.

    Rows of seeds with many contexts pass: doc_id, the seed, its place, and nulls.
    """
    names = ["doc_id", "other", "segments", "low", "high", "other_low", "other_high"]
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.int32(), pa.int32(), pa.int32(), pa.int32()]
    schema = pa.schema(list(zip(names, kinds, strict=True)))
    least = 1 if alone else least_seeds(k, sub, min_words, similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, (_, doc, other, pos, opos, size) in buckets(batches, _PAIR):
            spot = size == 0
            if spot.any():
                yield pa.record_batch([pa.array(doc[spot]), pa.array(other[spot]), pa.ListArray.from_arrays(pa.array(np.arange(spot.sum() + 1, dtype=np.int32)), pa.array(pos[spot])), *[pa.nulls(int(spot.sum()), pa.int32())] * 4], schema=schema)
                doc, other, pos, opos, size = (x[~spot] for x in (doc, other, pos, opos, size))
            if not len(doc):
                continue
            diagonal = pos.astype(np.int64) - opos
            order = np.lexsort((size, pos, diagonal, other, doc))
            doc, other, pos, size, diagonal = (x[order] for x in (doc, other, pos, size, diagonal))
            worth, size = np.where(size < 0, 2, 1), np.abs(size)
            pair = np.r_[True, (doc[1:] != doc[:-1]) | (other[1:] != other[:-1])]
            line = pair | np.r_[True, diagonal[1:] != diagonal[:-1]]
            # a segment: matches of one diagonal that are at most the gap apart
            pos = pos.astype(np.int64)
            group = np.cumsum(line) * np.int64(1 << 33)
            reach = np.maximum.accumulate(group + pos + size)
            begin = line | np.r_[True, (group + pos)[1:] - reach[:-1] > MAX_GAP]
            at = np.flatnonzero(begin)
            start, stop, off = pos[at], (reach - group)[np.r_[at[1:], len(pos)] - 1], diagonal[at]
            # a pair's seeds: its distinct places, a run of seeds counts for two; a passage is enough alone
            fresh = line | np.r_[True, pos[1:] != pos[:-1]]
            heads = np.flatnonzero(pair)
            counted = np.where(size > k, least, fresh * worth).astype(np.int64)
            seeds, in_segment = np.add.reduceat(counted, heads), np.add.reduceat(counted, at)
            lo = np.searchsorted(at, heads)
            hi = np.r_[lo[1:], len(at)]
            out: list = []
            for i in np.flatnonzero(seeds >= least).tolist():
                a, b = lo[i], hi[i]
                # a chain's seeds may have gone to another place of the same words, where a pair has many
                need = least if seeds[i] < 3 * least else 1
                found = list(np.stack([start[a:b], stop[a:b], start[a:b] - off[a:b]], 1)[:, None]) if alone else chained(start[a:b], stop[a:b], start[a:b] - off[a:b], k, seeds=in_segment[a:b], least=need)
                if not found:
                    continue
                flat = np.concatenate([np.c_[np.full(len(c), j), c] for j, c in enumerate(found)])
                margin = min_words
                low, high = max(0, int(flat[:, 1].min()) - margin), int(flat[:, 2].max()) + margin
                olow, ohigh = max(0, int(flat[:, 3].min()) - margin), int((flat[:, 3] + flat[:, 2] - flat[:, 1]).max()) + margin
                out.append((doc[heads[i]], other[heads[i]], flat.ravel(), low, high, olow, ohigh))
            yield pa.record_batch([pa.array([r[c] for r in out], kind) for c, kind in enumerate(kinds)], schema=schema)

    return run, "doc_id long, other long, segments array<int>, low int, high int, other_low int, other_high int"


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, data, off in chunks(batch.column("text")):
            _, _, row, h = words(data, off)
            at = np.searchsorted(row, np.arange(b - a + 1))
            short = (h >> np.uint64(32)).astype(np.uint32)
            yield pa.record_batch([batch.column("doc_id").slice(a, b - a), pa.array([short[at[i] : at[i + 1]].tobytes() for i in range(b - a)], pa.binary())], names=["doc_id", "tokens"])


def _reach(x: np.ndarray, y: np.ndarray, drop: int = 4) -> tuple[int, int]:
    """How far equal words go on from the start of both, over single changed words, and how many are equal."""
    n = min(len(x), len(y))
    same = x[:n] == y[:n]
    score = np.cumsum(np.where(same, 1, -2))
    if not n:
        return 0, 0
    peak = np.maximum.accumulate(np.maximum(score, 0))
    over = np.flatnonzero(peak - score >= drop)
    n = int(over[0]) if len(over) else n
    if not n or score[:n].max() <= 0:
        return 0, 0
    best = int(score[:n].argmax()) + 1
    return best, int(same[:best].sum())


def _trimmed(segments: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
    """(where the last segment ends, and on the other side; start, stop, other start): where segments overlap, the later one gives way."""
    end, oend = int(segments[0, 0]), int(segments[0, 2])
    for s, e, o in segments.tolist():
        cut_ = max(0, end - s, oend - o)
        s, o = s + cut_, o + cut_
        if s < e:
            yield end, oend, s, e, o
            end, oend = e, o + e - s


def align(x: np.ndarray, y: np.ndarray, segments: np.ndarray, known: Known | None = None) -> tuple[int, int, int, int, int]:
    """(start, stop, other start, other stop, equal words) of a chain between two documents' words."""
    known = known or Known(x, y)
    a, oa = int(segments[0, 0]), int(segments[0, 2])
    end, oend, equal = a, oa, 0
    for link in _trimmed(segments):
        equal += len(known.equal(link)[0])
        end, oend = link[3], link[4] + link[3] - link[2]
    go, same = _reach(x[end:], y[oend:])
    end, oend, equal = end + go, oend + go, equal + same
    go, same = _reach(x[:a][::-1], y[:oa][::-1])
    return a - go, end, oa - go, oend, equal + same


def _equal_pairs(x: np.ndarray, y: np.ndarray) -> list[tuple[int, int]]:
    """Places of one longest common subsequence of two short runs of words."""
    if not len(x) or not len(y):
        return []
    rows = [np.zeros(len(y) + 1, np.int64)]
    for c in x:
        row = rows[-1].copy()
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], np.where(y == c, rows[-1][:-1] + 1, 0)))
        rows.append(row)
    out, i, j = [], len(x), len(y)
    while i and j and rows[i][j]:
        if rows[i - 1][j] == rows[i][j]:
            i -= 1
        elif rows[i][j - 1] == rows[i][j]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            out.append((i, j))
    return out[::-1]


class Known:
    """What is known about two documents' words, by places: chains of texts that repeat themselves ask for the same again and again."""

    #: Links at a time, at most.
    MOST = 1 << 14

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.x, self.y, self.links, self.gaps, self.lines, self.chains = x, y, {}, {}, {}, {}

    def equal(self, link: tuple[int, int, int, int, int]) -> tuple[np.ndarray, np.ndarray]:
        """Places of the equal words between two segments and in the later one, on both sides."""
        if link not in self.links:
            end, oend, s, e, o = link
            at = np.flatnonzero(self.x[s:e] == self.y[o : o + e - s])
            own, other = at + s, at + o
            if end < s and oend < o:
                gap = self.x[end:s].tobytes(), self.y[oend:o].tobytes()
                if gap not in self.gaps:
                    self.gaps[gap] = np.array(_equal_pairs(self.x[end:s], self.y[oend:o]), np.int64).reshape(-1, 2).T
                i, j = self.gaps[gap]
                own, other = np.concatenate([i + end, own]), np.concatenate([j + oend, other])
            for held in (self.links, self.gaps):
                if len(held) >= self.MOST:
                    held.clear()
            self.links[link] = own, other
        return self.links[link]

    def similar(self, diagonal: int, min_words: int, similarity: float) -> bool:
        """Whether a diagonal (own place - other place) holds similar words anywhere; if not, no part of it does."""
        if diagonal not in self.lines:
            a, b = max(0, diagonal), min(len(self.x), len(self.y) + diagonal)
            at = np.flatnonzero(self.x[a:b] == self.y[a - diagonal : b - diagonal]) if a < b else np.zeros(0, np.int64)
            self.lines[diagonal] = bool(parts(at, at, min_words, similarity))
        return self.lines[diagonal]


def equal_words(x: np.ndarray, y: np.ndarray, segments: np.ndarray, reach: int = MIN_WORDS, known: Known | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places of a chain's equal words and of those up to ``reach`` words before and behind it, on both sides."""
    known = known or Known(x, y)
    a, oa = int(segments[0, 0]), int(segments[0, 2])
    end, oend = a, oa
    go = min(reach, a, oa)
    at = np.flatnonzero(x[a - go : a] == y[oa - go : oa])
    own, other = [at + a - go], [at + oa - go]
    for link in _trimmed(segments):
        at, oat = known.equal(link)
        own.append(at)
        other.append(oat)
        end, oend = link[3], link[4] + link[3] - link[2]
    go = min(reach, len(x) - end, len(y) - oend)
    at = np.flatnonzero(x[end : end + go] == y[oend : oend + go])
    return np.concatenate([*own, at + end]), np.concatenate([*other, at + oend])


def parts(own: np.ndarray, other: np.ndarray, min_words: int = MIN_WORDS, similarity: float = SIMILARITY) -> list[tuple[int, int]]:
    """(first, last) equal words of the longest runs of a chain that are similar enough: the whole, or runs that cover all such runs.

    Inside a chain, words between two equal ones count by the side that has more of them.
    """
    n = len(own)
    if not n or n < similarity * min_words - 1e-6:
        return []
    a, b = own[-1] - own[0] + 1, other[-1] - other[0] + 1
    if min(a, b) >= min_words and n >= similarity * max(a, b):
        return [(0, n - 1)]
    score = np.arange(n) - similarity * np.r_[0, np.cumsum(np.maximum(np.diff(own), np.diff(other)))]
    most = np.maximum.accumulate(score[::-1])[::-1]  # never rises: the last place that reaches a start's score ends its longest run
    stop = np.searchsorted(-most, -(score - (1 - similarity) - 1e-9), "right") - 1
    good = np.flatnonzero((own[stop] - own + 1 >= min_words) & (other[stop] - other + 1 >= min_words))
    if not len(good):
        return []
    good = good[np.r_[True, stop[good][1:] > np.maximum.accumulate(stop[good])[:-1]]]
    out, i = [], 0
    while i < len(good):
        out.append((int(good[i]), int(stop[good[i]])))
        i = max(i + 1, int(np.searchsorted(good, stop[good[i]], "right")) - 1)
    return out


#: Words of a run by which denser chains are looked for.
RUN = 3


def _runs(w: np.ndarray) -> np.ndarray:
    """Hashes of the runs of ``RUN`` words."""
    w = w.astype(np.uint64)
    n = max(0, len(w) - RUN + 1)
    return w[:n] * _MULT[0] + w[1 : n + 1] * _MULT[1] + w[2 : n + 2] * _MULT[2]


def runs_kept(min_words: int, similarity: float) -> int:
    """Runs that the shortest passage keeps when each changed word spoils all ``RUN`` that hold it; longer passages keep more."""
    return min_words - RUN + 1 - RUN * int(round((1 - similarity) * min_words, 6))


def _shared(own: np.ndarray, ordered: np.ndarray) -> int:
    """How many of the runs are among the sorted ones."""
    if not len(own) or not len(ordered):
        return 0
    return int((ordered[np.minimum(np.searchsorted(ordered, own), len(ordered) - 1)] == own).sum())


def denser(x: np.ndarray, y: np.ndarray, segments: np.ndarray, min_words: int = MIN_WORDS, similarity: float = SIMILARITY) -> list[np.ndarray]:
    """Chains of the runs of ``RUN`` words, near a chain's diagonals and up to ``min_words`` words around it, that both sides have.

    None where fewer runs are shared than a passage keeps.
    """
    a, b = max(0, int(segments[0, 0]) - min_words), min(len(x), int(segments[-1, 1]) + min_words)
    shift = segments[:, 0] - segments[:, 2]
    near, far = int(shift.min()) - MAX_GAP, int(shift.max()) + MAX_GAP  # own place - other place
    oa = max(0, a - far)
    own, other = _runs(x[a:b]), _runs(y[oa : max(oa, b - near)])
    order = np.argsort(other, kind="stable")
    ordered = other[order]
    if _shared(own, ordered) < max(1, runs_kept(min_words, similarity)):
        return []
    low, high = np.searchsorted(ordered, own), np.searchsorted(ordered, own, "right")
    count = high - low
    if count.sum() <= 16 * (len(own) + len(other)):
        pos = np.repeat(np.arange(len(own)), count)
        opos = order[np.arange(len(pos)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)]
        pos, opos = pos + a, opos + oa
        inside = (pos - opos >= near) & (pos - opos <= far)
        pos, opos = pos[inside], opos[inside]
    else:  # much repeated runs: diagonal by diagonal, in bounded memory
        found = [np.zeros((2, 0), np.int64)]
        for d in range(near, far + 1):
            first, last = max(a, oa + d), min(a + len(own), oa + len(other) + d)
            if first < last:
                at = np.flatnonzero(own[first - a : last - a] == other[first - d - oa : last - d - oa]) + first
                found.append(np.stack([at, at - d]))
        pos, opos = np.concatenate(found, 1)
    return chains(pos, opos, RUN, RUN) if len(pos) else []


def passages(x: np.ndarray, y: np.ndarray, segments: np.ndarray, min_words: int = MIN_WORDS, similarity: float = SIMILARITY, known: Known | None = None) -> list[tuple[int, int, int, int, int]]:
    """As :func:`align`: the chain if it is similar enough, or else what of it and of its segments is, or of denser chains around it."""
    known = known or Known(x, y)
    out = _similar(x, y, segments, min_words, similarity, known)
    # with fewer equal words, a chain neither holds a passage nor goes on beyond the words looked at
    least = min(similarity * min_words - 1e-6, (2 * min_words - 3) / 3)
    for c in [] if out else denser(x, y, segments, min_words, similarity):
        key = c.tobytes()
        if key not in known.chains:
            known.chains[key] = _similar(x, y, c, min_words, similarity, known) if len(equal_words(x, y, c, min_words, known)[0]) >= least else []
        out += [p for p in known.chains[key] if not any(q[0] <= p[0] and p[1] <= q[1] for q in out)]
    return out


def _similar(x: np.ndarray, y: np.ndarray, segments: np.ndarray, min_words: int, similarity: float, known: Known) -> list[tuple[int, int, int, int, int]]:
    whole = align(x, y, segments, known)
    a, b, oa, ob, equal = whole
    if min(b - a, ob - oa) >= min_words and equal >= similarity * max(b - a, ob - oa):
        return [whole]
    out: list = []
    for part in [segments, *(segments[i : i + 1] for i in range(len(segments)) if len(segments) > 1)]:
        if len(part) == 1 and not known.similar(int(part[0, 0] - part[0, 2]), min_words, similarity):
            continue
        own, other = equal_words(x, y, part, min_words, known)
        for i, j in parts(own, other, min_words, similarity):
            row = (int(own[i]), int(own[j]) + 1, int(other[i]), int(other[j]) + 1, j - i + 1)
            if not any(r[0] <= row[0] and row[1] <= r[1] for r in out):
                out.append(row)
    return out


def _by_row(tokens: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the different runs of ``k`` of each row's words, rising; their rows, and how often they come."""
    w, row = np.frombuffer(b"".join(tokens), np.uint32), np.repeat(np.arange(len(tokens)), [len(t) // 4 for t in tokens])
    at = np.flatnonzero(row[k - 1 :] == row[: max(0, len(row) - k + 1)])
    key, row = mix((_runs(w) if k == RUN else w.astype(np.uint64))[at] + row[at].astype(np.uint64) * _MULT[6]), row[at]
    order = np.argsort(key)
    begin, count = run_starts(key[order])
    return key[order[begin]], row[order[begin]], count


def shared_runs(tokens: list[bytes], others: list[bytes], k: int = RUN) -> np.ndarray:
    """For each pair of rows: how many runs of ``k`` words (1 or ``RUN``) both have, repeated ones as often as the side that has fewer."""
    (x, row, many), (y, _, others_many) = _by_row(tokens, k), _by_row(others, k)
    if not len(x) or not len(y):
        return np.zeros(len(tokens), np.int64)
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    same = y[at] == x
    return np.bincount(row[same], np.minimum(many, others_many[at])[same], len(tokens)).astype(np.int64)


def _aligned(min_words: int, similarity: float):
    names = ["doc_id", "start_word", "end_word", "ref_doc_id", "ref_start", "ref_end", "n_equal"]
    least, around = runs_kept(min_words, similarity), 2 * min_words + MAX_GAP

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for size, some in ((RUN, least), (1, similarity * min_words - 1e-6)):
                rows = rows[shared_runs(rows.tokens.tolist(), rows.other_tokens.tolist(), size) >= some]
            for r in rows.itertuples():
                x, y = np.frombuffer(r.tokens, np.uint32), np.frombuffer(r.other_tokens, np.uint32)
                found, void, known = [], set(), Known(x, y)
                every = np.asarray(r.segments).reshape(-1, 4) - np.array([0, r.low, r.low, r.other_low])
                for c in np.split(every[:, 1:], np.flatnonzero(np.diff(every[:, 0])) + 1):
                    if c[-1, 1] > len(x) or c[:, 2].min() < 0 or (c[:, 2] + c[:, 1] - c[:, 0]).max() > len(y):
                        continue  # another row's words under a repeated id
                    if any(p[0] <= c[0, 0] and c[-1, 1] <= p[1] and p[2] <= c[0, 2] and c[-1, 2] + c[-1, 1] - c[-1, 0] <= p[3] for p in found):
                        continue  # inside a passage already
                    # texts that repeat themselves have many chains with the same words around them
                    at, oat = max(0, int(c[0, 0]) - around), max(0, int(c[0, 2]) - around)
                    key = ((c - np.array([at, at, oat])).tobytes(), x[at : c[-1, 1] + around].tobytes(), y[oat : c[-1, 2] + c[-1, 1] - c[-1, 0] + around].tobytes()) if len(every) > 8 else None
                    if key in void:
                        continue
                    new = passages(x, y, c, min_words, similarity, known)
                    if key and not new:
                        void.add(key)
                    found += [p for p in new if not any(q[0] <= p[0] and p[1] <= q[1] and q[2] <= p[2] and p[3] <= q[3] for q in found)]
                out += [(r.doc_id, r.low + a, r.low + b, r.other, r.other_low + oa, r.other_low + ob, equal) for a, b, oa, ob, equal in found]
            yield pd.DataFrame(out, columns=names).astype("int64")

    return run, ", ".join(f"{n} long" for n in names)


def _around(k: int, n: int, reach: int):
    """Rows of seeds with many contexts (doc_id, spots: seed, place, open) and texts: each with hashes of the pairs of words around it, and where pairs begin that lie up to a passage's length from the seed."""
    names = ["seed", "doc_id", "pos", "open", "low", "high", "near"]
    schema = pa.schema(list(zip(names, [pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.int32(), pa.int32(), pa.binary()], strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, spots = batch.column("doc_id").to_pylist(), batch.column("spots").to_pylist()
            for a, b, data, off in chunks(batch.column("text")):
                _, _, row, h = words(data, off)
                bounds = np.searchsorted(row, np.arange(b - a + 1))
                out: list = []
                for i in range(a, b):
                    w = h[bounds[i - a] : bounds[i - a + 1]]
                    two = (mix(w[:-1] * _MULT[3] + w[1:] * _MULT[4]) >> np.uint64(48)).astype(np.uint16)
                    for s in spots[i]:
                        pos = s["pos"]
                        if pos + k > len(w):
                            continue  # another row's place under a repeated id
                        first, last = max(0, pos + k - reach), min(len(two), pos + reach - 1)
                        out.append((s["seed"], ids[i], pos, s["open"], max(first, pos + k - n) - first, min(last, pos + n - 1) - first, two[first:last].tobytes()))
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)] if out else [pa.array([], t) for t in schema.types], schema=schema)

    return run, "seed long, doc_id long, pos int, open boolean, low int, high int, near binary"


def common_pairs(own: list[np.ndarray], other: list[np.ndarray]) -> np.ndarray:
    """For rows of ``own`` and of ``other``: how many entries of the first the second one has."""
    size, osize = np.array([len(x) for x in own]), np.array([len(x) for x in other])
    out = np.zeros((len(own), len(other)), np.float32)
    if not size.sum() or not osize.sum():
        return out
    x, y = np.concatenate(own).astype(np.int64), _rising(np.repeat(np.arange(len(other)), osize) + (np.concatenate(other).astype(np.int64) << 32))
    row, orow, y = np.repeat(np.arange(len(own)), size), y & 0xFFFFFFFF, y >> 32
    held = np.bincount(y, minlength=1 << 16)
    # what many rows have is multiplied, the rest counted pair by pair
    often = np.flatnonzero(held > max(4, len(other) // 16))
    if len(often):
        number = np.full(1 << 16, -1)
        number[often] = np.arange(len(often))
        left, right = np.zeros((len(own), len(often)), np.float32), np.zeros((len(often), len(other)), np.float32)
        at = number[x] >= 0
        np.add.at(left, (row[at], number[x[at]]), 1)
        at = number[y] >= 0
        right[number[y[at]], orow[at]] = 1
        out += left @ right
        held[often] = 0
    count = held[x]
    keep = count > 0
    x, row, count = x[keep], row[keep], count[keep]
    start, done = np.searchsorted(y, x), 0
    total = np.cumsum(count)
    while done < len(x):
        stop = max(done + 1, int(np.searchsorted(total, (total[done - 1] if done else 0) + PAIRS, "right")))
        m = count[done:stop]
        at = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m) + np.repeat(start[done:stop], m)
        out += np.bincount(np.repeat(row[done:stop], m) * len(other) + orow[at], minlength=out.size).reshape(out.shape)
        done = stop
    return out


def _near_runs(near: np.ndarray, row: np.ndarray, m: int) -> tuple[np.ndarray, ...]:
    """Runs of three words, as following pairs of words: each one's row, where its holders start and how many they are, and the holders of all runs, rising."""
    at = np.flatnonzero(row[1:] == row[:-1])
    key = ((near[at].astype(np.uint64) << np.uint64(16)) | near[at + 1]) << np.uint64(32)
    held, where = np.unique(key | row[at].astype(np.uint64), return_inverse=True)
    begin, count = run_starts(held >> np.uint64(32))
    of = (np.cumsum(np.r_[False, (held[1:] >> np.uint64(32)) != (held[:-1] >> np.uint64(32))]) if len(held) else np.zeros(0, np.int64))[where]
    return row[at], begin[of], count[of], (held & np.uint64(0xFFFFFFFF)).astype(np.int64)


def _shares(i: np.ndarray, j: np.ndarray, inner: np.ndarray, within: np.ndarray, sets: np.ndarray, least: int, width: int) -> np.ndarray:
    """For pairs of rows: whether the second one has ``least`` of ``width`` following pairs of words of the first one."""
    out = np.zeros(len(i), bool)
    step = max(1, PAIRS // inner.shape[1])
    for a in range(0, len(i), step):
        x, y = i[a : a + step], j[a : a + step]
        wanted = (y[:, None] << 16) | inner[x]
        hit = (sets[np.minimum(np.searchsorted(sets, wanted.ravel()), len(sets) - 1)].reshape(wanted.shape) == wanted) & within[x]
        total = np.zeros((len(x), inner.shape[1] + 1), np.int32)
        np.cumsum(hit, 1, out=total[:, 1:])
        out[a : a + step] = (total[:, width:] - total[:, :-width]).max(1) >= least
    return out


def _compared(k: int, n: int, least: int, width: int, kept: int, side: int = 512):
    """Of a block of a seed's rows, or of two: open rows with earlier ones that have ``least`` equal pairs of words in ``width`` around the seed.

    Verification wants ``kept`` runs of words on both sides. Where fewer of a row's runs are held by many rows, its
    partners hold one of the others and are looked up; only the other rows are compared with all.
    """
    names = ["doc_id", "other", "pos", "opos"]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "pos"], ignore_index=True)
        doc, pos, part, open_ = rows.doc_id.to_numpy(), rows.pos.to_numpy(), rows.part.to_numpy(), rows["open"].to_numpy()
        m, two = len(rows), rows["first"].iloc[0] != rows["second"].iloc[0]
        flat, size = np.frombuffer(b"".join(rows.near), np.uint16), rows.near.str.len().to_numpy() // 2
        row, begin = np.repeat(np.arange(m), size), np.cumsum(size) - size
        sets = _rising((row << 16) | flat)
        low, high = rows.low.to_numpy(), rows.high.to_numpy()
        if not len(sets):
            return pd.DataFrame(np.zeros((0, 4), np.int64), columns=names)
        places = np.arange(max(width, int((high - low).max())))
        within = places < (high - low)[:, None]
        inner = flat[np.minimum((begin + low)[:, None] + places, len(flat) - 1)].astype(np.int64)
        earlier = lambda i, j: (doc[j] < doc[i]) & ((part[i] != part[j]) | (not two))
        found: list = []

        def confirmed(i: np.ndarray, j: np.ndarray) -> None:
            fits = earlier(i, j)
            i, j = i[fits], j[fits]
            good = _shares(i, j, inner, within, sets, least, width)
            found.append((i[good], j[good]))

        of, start, count, holders = _near_runs(flat, row, m)
        often = np.bincount(of[count > FEW], minlength=m)
        looked = open_ & (often < kept)
        use = looked[of] & (count > 1) & (count <= FEW)
        of, start, count = of[use], start[use], count[use]
        total, a = np.cumsum(count), 0
        while a < len(of):
            b = int(np.searchsorted(total, (total[a - 1] if a else 0) + PAIRS, "right"))
            b = max(int(np.searchsorted(of, of[b])) if b < len(of) else b, int(np.searchsorted(of, of[a], "right")))  # whole rows
            c = count[a:b]
            i = np.repeat(of[a:b], c)
            j = holders[np.arange(len(i)) - np.repeat(np.cumsum(c) - c, c) + np.repeat(start[a:b], c)]
            before = j < i
            pair, shared = np.unique(i[before] * m + j[before], return_counts=True)
            i, j = np.divmod(pair, m)
            enough = shared >= kept - often[i]
            confirmed(i[enough], j[enough])
            a = b
        rest = np.flatnonzero(open_ & ~looked)
        near = np.split(flat, begin[1:]) if len(rest) else []
        for a in range(0, len(rest), side):
            own = rest[a : a + side]
            words_ = [inner[x][within[x]] for x in own]
            for b in range(0, int(own[-1]), side):
                other = np.arange(b, min(b + side, int(own[-1])))
                i, j = np.nonzero(common_pairs(words_, [near[x] for x in other]) >= least)
                confirmed(own[i], other[j])
        i, j = (np.concatenate([f[c] for f in found]) if found else np.zeros(0, np.int64) for c in (0, 1))
        return pd.DataFrame(np.stack([doc[i], doc[j], pos[i].astype(np.int64), pos[j].astype(np.int64)], 1), columns=names)

    return run, "doc_id long, other long, pos long, opos long"


def _packed(k: int, bits: int):
    """Packed matches of pairs of rows that share a seed's surroundings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(bits)
        for batch in batches:
            doc, other, pos, opos = (batch.column(c).to_numpy() for c in ("doc_id", "other", "pos", "opos"))
            packer.add(*_pairs(doc, other, pos, opos, k))
            if packer.n >= FLUSH:
                yield packer.pack()
        if packer.n:
            yield packer.pack()

    return run, PACKED_DDL


def _left_open(docs: DataFrame, spots: DataFrame, found: DataFrame, k: int, sub: int, n: int, similarity: float, bits: int) -> DataFrame:
    """Pairs (as of :func:`_chained`) for the rows of seeds with many contexts whose words are in no passage yet."""
    spans = found.groupBy("doc_id").agg(F.collect_list(F.struct("start_word", "end_word")).alias("spans"))
    inside = F.exists("spans", lambda s: (s["start_word"] <= F.col("pos")) & (F.col("pos") + k <= s["end_word"]))
    spots = spots.join(spans, "doc_id", "left").select("doc_id", "seed", "pos", (~F.coalesce(inside, F.lit(False))).alias("open"))
    sizes = spots.groupBy("seed").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"), F.max(F.when(F.col("open"), F.col("doc_id"))).alias("last")).where("last > first").select("seed", F.ceil(F.col("n") / BLOCK).cast("int").alias("parts"))
    lists = cut(spots.join(sizes, "seed").withColumn("part", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int")), "open")
    grouped = lists.groupBy("doc_id").agg(F.collect_set(F.struct("seed", "pos", "open")).alias("spots"))
    wanted = bitmap_of(grouped.select(F.xxhash64("doc_id").alias("h")), "h")
    changed = int(round((1 - similarity) * n, 6))
    reach = n + int(np.ceil(changed / similarity))
    around = docs.where(may_hold(wanted, F.xxhash64("doc_id"))).join(grouped, "doc_id").select("doc_id", "spots", "text").mapInArrow(*_around(k, n, reach))
    around = around.join(lists.select("seed", "parts").distinct(), "seed").withColumn("part", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int"))
    met = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda i: F.struct(F.least(i, F.col("part")).alias("first"), F.greatest(i, F.col("part")).alias("second")))
    blocks = around.select("seed", "doc_id", "pos", "open", "low", "high", "near", "part", F.explode(met).alias("m")).select("seed", "doc_id", "pos", "open", "low", "high", "near", "part", "m.first", "m.second")
    pairs = blocks.groupBy("seed", "first", "second").applyInPandas(*_compared(k, n, n - 1 - 2 * changed, n - 1, runs_kept(n, similarity)))
    return dealt(pairs.mapInArrow(*_packed(k, bits))).mapInArrow(*_chained(k, sub, n, similarity, True))


def _verified(docs: DataFrame, found: DataFrame, min_words: int, similarity: float, tasks: int = 0) -> DataFrame:
    """The passages of chains: only the words around them go on with a pair, where given to so many tasks, whatever their bytes."""
    wanted = bitmap_of(found.select(F.explode(F.array("doc_id", "other")).alias("id")).distinct().select(F.xxhash64("id").alias("h")), "h")
    tokens = cut(docs.where(may_hold(wanted, F.xxhash64("doc_id"))).mapInArrow(_tokens, "doc_id long, tokens binary"), "words")
    piece = lambda c, low, high: F.substring(F.col(c), 4 * F.col(low) + 1, 4 * (F.col(high) - F.col(low)))
    side = lambda i, t: tokens.select(F.col("doc_id").alias(i), F.col("tokens").alias(t))  # noqa: E731  of one form, so that their shuffle is one
    both = found.withColumnRenamed("doc_id", "own").join(side("own", "own_tokens"), "own").withColumn("tokens", piece("own_tokens", "low", "high"))
    both = both.join(side("other", "other_tokens"), "other").withColumn("other_tokens", piece("other_tokens", "other_low", "other_high"))
    both = both.select(F.col("own").alias("doc_id"), "other", "segments", "low", "other_low", "tokens", "other_tokens")
    return (both.repartition(tasks, "doc_id", "other") if tasks else both).mapInPandas(*_aligned(min_words, similarity)).distinct()


def repeated_passages(documents: DataFrame, min_words: int = MIN_WORDS, similarity: float = SIMILARITY, k: int = K, sub: int = SUB, id_col: str = "doc_id", text_col: str = "text", most: int = MOST) -> DataFrame:
    """One row per passage of a document that an earlier one has: doc_id, start_word, end_word, ref_doc_id, ref_start, ref_end, n_equal.

    Passages have ``min_words`` words at least and ``similarity`` of them equal and in order. Words are parted by
    ASCII white space; A-Z are lower-cased; words are compared by 32-bit hashes. Of the documents that have a
    passage, copies are represented by their first one. ``sub``
    = ``k`` makes every run of ``k`` words a seed; with the default a third of the runs are, and passages with
    changed words that share too few of them are missed; the README states the recall against all pairs. Seeds with
    more than ``most`` contexts are compared in blocks only where a passage found before doesn't hold them, so not
    every similar document is reported for those; pairs need as many equal pairs of words as the changed words leave. Rows
    with a null id, null and short texts take no part; of rows that repeat an id each is compared; repeats inside a
    document aren't reported; other columns are ignored; an empty table gives no rows.
    """
    bits = bucket_bits(documents.sparkSession)
    docs = documents.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).where("doc_id is not null and text is not null")
    thin = least_seeds(k, sub, min_words, similarity) <= 2
    matches = dealt(docs.mapInArrow(*_seeds(k, sub, min_words, bits))).mapInArrow(*_matches(k, min_words, bits, thin, most))
    chains_ = cut(dealt(matches).mapInArrow(*_chained(k, sub, min_words, similarity)), "chains")
    spots = chains_.where("low is null").select("doc_id", F.col("other").alias("seed"), F.col("segments")[0].alias("pos"))
    found = _verified(docs, chains_.where("low is not null"), min_words, similarity)
    if spots.isEmpty():
        return found
    found = cut(found, "passages")
    rest = cut(_left_open(docs, spots, found, k, sub, min_words, similarity, bits), "open_chains")
    tasks = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes, but much work: pairs of one seed's rows are alike
    return found.unionByName(_verified(docs, rest, min_words, similarity, tasks)).distinct()


def _unused(columns: list[str], name: str) -> str:
    while name in columns:
        name += "_"
    return name


def remove_passages(documents: DataFrame, passages: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without the words under their passages (doc_id, start_word, end_word); remaining words are joined by single spaces.

    All columns stay, and so do rows without passages, null texts and null ids. Passages go by id, so ids must
    tell rows apart: where rows that have passages repeat an id, this raises (:func:`dedup_passages` numbers rows
    itself). Empty tables give no rows, and no change.
    """
    key, spans = _unused(documents.columns, "key"), _unused(documents.columns, "spans")
    found = passages.groupBy(F.col("doc_id").alias(key)).agg(F.collect_list(F.struct("start_word", "end_word")).alias(spans))
    keyed = documents.withColumn(key, F.col(f"`{id_col}`").cast("long"))
    if not keyed.select(key).join(found, key, "left_semi").groupBy(key).count().where("count > 1").isEmpty():
        raise ValueError(f"rows with passages repeat a {id_col}")
    out = keyed.join(found, key, "left")
    listed = F.filter(F.split(F.col(f"`{text_col}`"), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    kept = F.filter(listed, lambda w, i: ~F.exists(F.col(spans), lambda s: (i >= s["start_word"]) & (i < s["end_word"])))
    text = F.when(F.col(spans).isNull(), F.col(f"`{text_col}`")).otherwise(F.array_join(kept, " "))
    return out.withColumn(text_col, text).select(*[F.col(f"`{c}`") for c in documents.columns])


def dedup_passages(documents: DataFrame, min_words: int = MIN_WORDS, similarity: float = SIMILARITY, k: int = K, sub: int = SUB, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without the passages that an earlier row has: rows come by id, null ids last, then text; all columns stay.

    Rows are numbered in that order in a table written once, so ids may repeat or be null; each row loses its own
    words only.
    """
    row = _unused(documents.columns, "row")
    ordered = documents.orderBy(F.asc_nulls_last(F.col(f"`{id_col}`")), F.xxhash64(F.col(f"`{text_col}`")))
    docs = cut(ordered.withColumn(row, F.monotonically_increasing_id()), "numbered")
    return remove_passages(docs, repeated_passages(docs, min_words, similarity, k, sub, row, text_col), row, text_col).drop(row)
