"""SentencePiece encoding by Unigram Viterbi over a double-array trie, and decoding.

A text gets a leading space and its spaces become the white-space marker. Since no piece holds the marker
after another character, the best segmentation is that of each unit (spaces and the characters up to the
next space) on its own: units are looked up by their hash, and each new one is segmented once in a task.
A character that no piece covers alone costs the penalty score and is written as byte pieces.

A model file of another kind than unigram has ranks or counts for scores, whose sums mean nothing. Its pieces
then get log probabilities by expectation maximisation over their best segmentations of all texts: the different
units are counted once, and a round segments each of them. The pieces themselves are never changed.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axisframe.llm._store import bounded_batches, cut
from axisframe.llm._text import chunks, prefix_hash, span_hash

MARKER = "▁"
#: What an unknown character scores below the least score, as in the published model format.
UNKNOWN_PENALTY = 10.0
#: Units remembered by a task before it forgets them all: bounds memory only.
CACHE_UNITS = 1 << 21
#: Rounds of the scores' estimation.
FIT_ROUNDS = 3
#: Uses that every piece is given besides its counted ones.
PRIOR_USES = 0.1
#: Longer units are segmented one by one.
LONG_UNIT = 256
SPACE = 0x20


@dataclass
class PieceModel:
    """The double array (base, check, value: a state's piece or -1) and the pieces; the marker is kept as a space."""

    base: np.ndarray
    check: np.ndarray
    value: np.ndarray
    score: np.ndarray
    byte_id: np.ndarray
    text: list[bytes]
    unit_safe: bool

    @classmethod
    def from_pieces(cls, pieces: list[str], scores: list[float], kinds: list[str]) -> PieceModel:
        """``kinds``: "normal" or "byte" (whose piece is <0xNN>); any other kind is never produced."""
        text, byte_id, normal = [], np.full(256, -1, np.int32), {}
        for i, (p, kind) in enumerate(zip(pieces, kinds, strict=True)):
            raw = p.replace(MARKER, " ").encode()
            if kind == "byte":
                byte_id[int(p[3:5], 16)] = i
                raw = bytes([int(p[3:5], 16)])
            elif kind == "normal" and raw and raw not in normal:
                normal[raw] = i
            text.append(raw if kind in ("normal", "byte") else b"")
        if (byte_id < 0).any():
            raise ValueError("the model has no full set of byte pieces")
        base, check, value = _double_array(normal)
        return cls(base, check, value, np.asarray(scores, np.float64), byte_id, text, not any(b" " in p.lstrip(b" ") for p in normal))

    @classmethod
    def from_file(cls, path: str) -> PieceModel:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        if any(sp.decode(sp.encode(x)) != x for x in (" a  b ", "Å ﬁ ①")):
            raise ValueError("the model changes texts before it cuts them; only the identity is supported")
        ids = range(sp.get_piece_size())
        kinds = ["byte" if sp.is_byte(i) else "other" if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) else "normal" for i in ids]
        return cls.from_pieces([sp.id_to_piece(i) for i in ids], [sp.get_score(i) for i in ids], kinds)

    @classmethod
    def by_rank(cls, path: str) -> PieceModel:
        """The file's pieces with scores that fall with the logarithm of their place among the normal ones."""
        m = cls.from_file(path)
        normal = m.value[m.value >= 0]
        rank = np.argsort(np.argsort(-m.score[normal], kind="stable"))
        m.score = m.score.copy()
        m.score[normal] = -np.log(rank + 2.0)
        return m

    def rescored(self, uses: dict[int, int]) -> PieceModel:
        """The same pieces with log shares of their uses."""
        normal = self.value[self.value >= 0]
        n = np.zeros(len(self.score))
        n[normal] = PRIOR_USES
        for i, k in uses.items():
            n[i] += k
        score = self.score.copy()
        score[normal] = np.log(n[normal] / n[normal].sum())
        return replace(self, score=score)

    @property
    def unknown(self) -> float:
        return float(self.score[self.value[self.value >= 0]].min()) - UNKNOWN_PENALTY


def _double_array(pieces: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    keys = sorted(pieces)
    base, check, value = [0] * 257, [-2] + [-1] * 256, [-1] * 257
    low, ahead, todo = 257, 257, [(0, 0, len(keys), 0)]
    while todo:
        state, a, b, depth = todo.pop()
        if a < b and len(keys[a]) == depth:
            value[state] = pieces[keys[a]]
            a += 1
        kids, i = [], a
        while i < b:
            c, j = keys[i][depth], i + 1
            while j < b and keys[j][depth] == c:
                j += 1
            kids.append((c, i, j))
            i = j
        if not kids:
            continue
        while low < len(check) and check[low] != -1:
            low += 1
        # a lone child takes the first free cell; siblings are placed from where the last ones went
        at = max(1, low - kids[0][0], ahead * (len(kids) > 1))
        while any(at + c < len(check) and check[at + c] != -1 for c, _, _ in kids):
            at += 1
        if len(kids) > 1:
            ahead = at
        grow = at + 256 - len(check)
        if grow > 0:
            base += [0] * grow
            check += [-1] * grow
            value += [-1] * grow
        base[state] = at
        for c, i, j in kids:
            check[at + c] = state
            todo.append((at + c, i, j, depth + 1))
    return np.array(base + [0] * 256, np.int32), np.array(check + [-1] * 256, np.int32), np.array(value + [-1] * 256, np.int32)


def _edges(m: PieceModel, data: np.ndarray, unit_end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, piece) of every piece found in the bytes, and -1 for characters without a piece of their own."""
    char = np.flatnonzero((data & 0xC0) != 0x80)
    width = np.diff(np.r_[char, len(data)])
    at, state, limit = char, np.zeros(len(char), np.int64), unit_end[char]
    starts, ends, ids, depth = [], [], [], 0
    while len(at):
        ok = at + depth < limit
        at, state, limit = at[ok], state[ok], limit[ok]
        nxt = m.base[state] + data[at + depth]
        ok = m.check[nxt] == state
        at, state, limit = at[ok], nxt[ok].astype(np.int64), limit[ok]
        depth += 1
        piece = m.value[state]
        hit = piece >= 0
        starts.append(at[hit])
        ends.append(at[hit] + depth)
        ids.append(piece[hit])
    start, end, piece = np.concatenate([*starts, char[:0]]), np.concatenate([*ends, char[:0]]), np.concatenate([*ids, np.zeros(0, np.int32)])
    alone = np.zeros(len(data) + 1, np.int64)
    alone[char] = char + width
    own = np.zeros(len(data) + 1, bool)
    own[start[end == alone[start]]] = True
    bare = char[~own[char]]
    return np.concatenate([start, bare]), np.concatenate([end, alone[bare]]), np.concatenate([piece, np.full(len(bare), -1, np.int32)])


def segment(m: PieceModel, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best ids of each unit data[starts[i]:ends[i]] (adjoining, none empty): all ids, and how many each has.

    Of equal scores, the segmentation whose last piece is longest wins, at each place.
    """
    size = ends - starts
    unit = np.repeat(np.arange(len(starts)), size)
    start, end, piece = _edges(m, data, ends[unit])
    score = np.where(piece >= 0, m.score[piece], m.unknown)
    best = np.full(len(data) + 1, -np.inf)
    entry = np.full(len(data) + 1, -np.inf)  # of a unit's first byte: its own best is 0, whatever ended there before
    entry[starts] = 0.0
    back, by = np.zeros(len(data) + 1, np.int64), np.full(len(data) + 1, -1, np.int64)
    rel = start - starts[unit[start]]
    order = np.lexsort((end - start, rel))
    start, end, piece, score, rel = start[order], end[order], piece[order], score[order], rel[order]
    long = size[unit[start]] > LONG_UNIT
    for s, e, p, c in zip(start[long].tolist(), end[long].tolist(), piece[long].tolist(), score[long].tolist(), strict=True):
        v = c + (0.0 if entry[s] == 0.0 else best[s])
        if v > best[e]:
            best[e], back[e], by[e] = v, s, p
    start, end, piece, score, rel = start[~long], end[~long], piece[~long], score[~long], rel[~long]
    group = rel * (1 << 20) + (end - start)
    cut = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else np.zeros(0, np.int64)
    for a, b in zip(cut.tolist(), np.r_[cut[1:], len(group)][: len(cut)].tolist(), strict=True):
        s, e = start[a:b], end[a:b]
        v = score[a:b] + np.where(entry[s] == 0.0, 0.0, best[s])
        up = v > best[e]
        best[e[up]], back[e[up]], by[e[up]] = v[up], s[up], piece[a:b][up]
    place, own = ends.copy(), np.arange(len(ends))
    got_unit, got_start, got_end, got_id = [], [], [], []
    while len(place):
        s = back[place]
        got_unit.append(own)
        got_start.append(s)
        got_end.append(place)
        got_id.append(by[place])
        more = s > starts[own]
        place, own = s[more], own[more]
    u, s, e, p = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (got_unit, got_start, got_end, got_id))
    order = np.lexsort((s, u))
    u, s, e, p = u[order], s[order], e[order], p[order]
    n = np.where(p >= 0, 1, e - s)
    out = np.repeat(p, n)
    inner = np.arange(len(out)) - np.repeat(np.cumsum(n) - n, n)
    raw = out < 0
    out[raw] = m.byte_id[data[(np.repeat(s, n) + inner)[raw]]]
    return out.astype(np.int32), np.bincount(u, weights=n, minlength=len(starts)).astype(np.int64)


def _ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Indices start[i], start[i] + 1, ... of all runs."""
    return np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size - start, size)


class Encoder:
    """Encodes chunks of texts with a memory of the units seen."""

    def __init__(self, model: PieceModel):
        self.m = model
        self.text_at = np.r_[0, np.cumsum([len(t) for t in model.text])]
        self.text = np.frombuffer(b"".join(model.text), np.uint8)
        self.forget()

    def forget(self) -> None:
        self.key, self.at, self.n, self.pool = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def units(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
        """The units of the texts data[off[i]:off[i + 1]] with their leading spaces: bytes, starts, ends, places of the texts' heads, texts that have any."""
        raw = data.tobytes()
        if MARKER.encode() in raw:
            texts = [raw[a:b].replace(MARKER.encode(), b" ") for a, b in zip(off[:-1], off[1:], strict=True)]
            data, off = np.frombuffer(b"".join(texts), np.uint8), np.r_[0, np.cumsum([len(t) for t in texts])]
        size = np.diff(off)
        full = np.flatnonzero(size > 0)
        lead = np.zeros(len(size), np.int64)
        lead[full] = 1
        at = np.arange(len(data)) + np.repeat(np.cumsum(lead), size)
        out = np.full(len(data) + len(full), SPACE, np.uint8)
        out[at] = data
        head = off[full] + np.arange(len(full))
        space = out == SPACE
        begin = space.copy()
        if not self.m.unit_safe:
            begin[:] = False
        begin[1:] &= ~space[:-1]
        begin[head] = True
        starts = np.flatnonzero(begin)
        ends = np.r_[starts[1:], len(out)][: len(starts)]
        return out, starts, ends, head, full

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts data[off[i]:off[i + 1]], and how many each has; an empty text has none."""
        out, starts, ends, head, full = self.units(data, off)
        row = full[np.searchsorted(head, starts, "right") - 1] if len(starts) else starts
        keys, first, which = np.unique(span_hash(prefix_hash(out), starts, ends), return_index=True, return_inverse=True)
        slot = np.searchsorted(self.key, keys)
        known = np.zeros(len(keys), bool)
        if len(self.key):
            known = self.key[np.minimum(slot, len(self.key) - 1)] == keys
        new = np.flatnonzero(~known)
        if len(new):
            s, n = starts[first[new]], (ends - starts)[first[new]]
            unit_ends = np.cumsum(n)
            ids, counts = segment(self.m, out[_ragged(s, n)], unit_ends - n, unit_ends)
            slot = slot[new]  # both are sorted
            self.at = np.insert(self.at, slot, len(self.pool) + np.cumsum(counts) - counts)
            self.n, self.key = np.insert(self.n, slot, counts), np.insert(self.key, slot, keys[new])
            self.pool = np.r_[self.pool, ids]
        slot = np.searchsorted(self.key, keys)
        n = self.n[slot][which]
        ids = self.pool[_ragged(self.at[slot][which], n)]
        per_text = np.bincount(row, weights=n, minlength=len(off) - 1).astype(np.int64)
        if len(self.key) > CACHE_UNITS:
            self.forget()
        return ids, per_text

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all texts and their offsets; the leading space that encoding added is dropped."""
        at, n = self.text_at[ids], np.diff(self.text_at)[ids]
        data = self.text[_ragged(at, n)]
        end = np.r_[0, np.cumsum(n)][np.cumsum(counts)]
        off = np.r_[0, end]
        keep = np.ones(len(data), bool)
        keep[off[:-1][(np.diff(off) > 0)]] = False
        return data[keep], np.r_[0, np.cumsum(np.diff(off) - (np.diff(off) > 0))]


def _batches(model, id_type: pa.DataType, make) -> callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(model.value)
        for batch in batches:
            for a, b, data, off in chunks(batch.column("text")):
                ids, counts = encoder.encode(data, off)
                back, back_off = encoder.decode(ids, counts)
                yield make(batch.column("doc_id").slice(a, b - a), data, off, ids, counts, back, back_off)

    return run


def is_log(scores: np.ndarray) -> bool:
    """Whether scores can be log probabilities: their exponentials sum to about one."""
    return bool(len(scores)) and 0.5 < float(np.exp(np.minimum(scores, 0.0)).sum()) < 2.0


def fitted(documents: DataFrame, model: PieceModel, rounds: int = FIT_ROUNDS, text_col: str = "text") -> PieceModel:
    """``model`` with log probabilities from the best segmentations of all texts.

    The different units of the texts and their numbers are counted once. A round segments each unit, counts the
    pieces (at most the vocabulary's number of rows reach the driver) and rescores. Without any text the scores stay.
    """
    spark = documents.sparkSession
    bounded_batches(spark)
    split = Encoder(model)

    def count_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, off in chunks(batch.column("text")):
                out, starts, ends, _, _ = split.units(data, off)
                _, first, n = np.unique(span_hash(prefix_hash(out), starts, ends), return_index=True, return_counts=True)
                raw = out.tobytes()
                yield pa.record_batch([pa.array([raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)], pa.binary()), pa.array(n, pa.int64())], names=["unit", "n"])

    texts = documents.select(F.col(f"`{text_col}`").alias("text")).where("text is not null")
    units = cut(texts.mapInArrow(count_units, "unit binary, n long").groupBy("unit").agg(F.sum("n").alias("n")), "fit-units")
    if units.isEmpty():
        return model
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(model)

        def count(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            uses = np.zeros(len(sent.value.score))
            for batch in batches:
                raw = batch.column("unit").to_pylist()
                ends = np.cumsum([len(u) for u in raw])
                ids, per_unit = segment(sent.value, np.frombuffer(b"".join(raw), np.uint8), np.r_[0, ends[:-1]], ends)
                uses += np.bincount(ids, weights=np.repeat(batch.column("n").to_numpy(), per_unit), minlength=len(uses))
            used = np.flatnonzero(uses)
            yield pa.record_batch([pa.array(used), pa.array(uses[used].astype(np.int64))], names=["piece", "uses"])

        uses = {r.piece: r.uses for r in units.mapInArrow(count, "piece long, uses long").groupBy("piece").agg(F.sum("uses").alias("uses")).collect()}
        sent.destroy()
        bytes_of = set(model.byte_id.tolist())
        model = model.rescored({i: n for i, n in uses.items() if i not in bytes_of})
    return model


def encode_pieces(documents: DataFrame, model_path: str, model: PieceModel | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document row: doc_id, ids, n_ids, ids_crc32 (little-endian 32-bit ids), decoded, lossless.

    ``decoded`` is the text read back from the ids; ``lossless`` tells whether it equals the text, which
    holds unless the text has the marker character itself, which reads back as a space. Null and empty
    texts have no ids and decode to the empty text. Repeated rows and null ids pass through; other columns
    are ignored; an empty table gives no rows. The trie (its size is the vocabulary's) is broadcast. Scores that
    are no log probabilities are estimated from all texts of the table; ``model`` gives a fitted one instead.
    """
    bounded_batches(documents.sparkSession)
    if model is None:
        model = PieceModel.from_file(model_path)
        if not is_log(model.score[model.value[model.value >= 0]]):
            model = fitted(documents, PieceModel.by_rank(model_path), text_col=text_col)
    model = documents.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("n_ids", pa.int64()), ("ids_crc32", pa.int64()), ("decoded", pa.string()), ("lossless", pa.bool_())])

    def make(doc_ids, data, off, ids, counts, back, back_off):
        at = np.r_[0, np.cumsum(counts)]
        raw, text, again = ids.astype("<u4").tobytes(), data.tobytes(), back.tobytes()
        crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        decoded = [again[a:b] for a, b in zip(back_off[:-1].tolist(), back_off[1:].tolist(), strict=True)]
        same = [text[a:b] == d for a, b, d in zip(off[:-1].tolist(), off[1:].tolist(), decoded, strict=True)]
        lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids))
        return pa.record_batch([doc_ids, lists, pa.array(counts), pa.array(crc, pa.int64()), pa.array([d.decode() for d in decoded], pa.string()), pa.array(same, pa.bool_())], schema=schema)

    docs = documents.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return docs.mapInArrow(_batches(model, pa.int64(), make), "doc_id long, ids array<int>, n_ids long, ids_crc32 long, decoded string, lossless boolean")
