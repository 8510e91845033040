"""Token-ID output in ascending document order, with Re-Pair grammar compression per shard.

Documents are range-partitioned by id; each task encodes its texts, fills shards and writes them to one
file of its own. A shard's ids are compressed by repeatedly replacing frequent adjacent pairs by
nonterminals (Larsson & Moffat, 1999; many pairs a round), until no pair is left whose rule would pay. It
stores the rules and the expansion lengths, so any run of ids is decoded without the rest.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from axisframe.llm._store import cut, new_folder
from axisframe.llm._text import chunks, code_points, prefix_hash_codes, span_hash

#: Ids in a shard, at least, but for a task's last one.
SHARD_IDS = 1 << 20
#: Shards that a reading task gets on average.
TASK_SHARDS = 4
#: A rule takes 12 bytes (two symbols and its expansion length) and saves one symbol of 4 bytes a use, so that it
#: pays from 4 uses on. On 2^20 ids of prose 2.20 MB are left so; with 2 uses 2.34 MB, with 16 uses in 8 rounds 2.51 MB.
PAIR_USES = 4
#: Parts whose prefix sums one task makes; their blocks' sums are made by one task.
BLOCK_PARTS = 1 << 10
#: Words whose ids a task remembers before it forgets them: bounds memory only.
CACHE_WORDS = 1 << 21
MAGIC = b"RPG1"

# --- words -----------------------------------------------------------------------------------------

#: Texts of code points below this are cut into words by array operations; others by the library.
PLAIN = 0x250
_LETTER, _NUMBER, _SPACE, _OTHER = 0, 1, 2, 3


def _classes() -> np.ndarray:
    import unicodedata

    out = np.full(PLAIN, _OTHER, np.uint8)
    for c in range(PLAIN):
        kind = unicodedata.category(chr(c))[0]
        out[c] = _SPACE if c in (9, 10, 11, 12, 13, 32, 0x85, 0xA0) else _LETTER if kind == "L" else _NUMBER if kind == "N" else _OTHER
    return out


_CLASS = _classes()


def word_starts(code: np.ndarray, head: np.ndarray) -> np.ndarray:
    """Where the words of the byte-level pattern start: contractions; an optional space and a run of
    letters, numbers or other characters; white space but its last character before another word; the rest.

    ``head``: where texts start; none of them is empty.
    """
    n = len(code)
    if not n:
        return np.zeros(0, np.int64)
    kind = _CLASS[code]
    first = np.zeros(n + 1, bool)
    first[head] = True
    first[n] = True
    last, first = first[1:], first[:-1]
    before, after = np.r_[np.uint8(9), kind[:-1]], np.r_[kind[1:], np.uint8(9)]
    start = first | (kind != before)
    space = kind == _SPACE
    # the last space of a run goes with the word behind it, if it is a blank; any other stands alone
    ends = space & ~last & (after != _SPACE)
    start |= ends
    behind = np.zeros(n, bool)
    behind[1:] = (ends & (code == 32))[:-1]
    start &= ~(behind & ~first)
    # an apostrophe that begins its own word takes s, t, re, ve, m, ll or d behind it
    quote = np.flatnonzero(start & (code == 39) & ~last)
    if len(quote):
        a = code[quote + 1]
        two = quote + 2 < n
        b = np.where(two & ~last[np.minimum(quote + 1, n - 1)], code[np.minimum(quote + 2, n - 1)], 0)
        one = np.isin(a, [ord(c) for c in "stmd"])
        pair = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
        size = np.where(one, 2, np.where(pair, 3, 0))
        quote, size = quote[size > 0], size[size > 0]
        start[quote + 1] = False
        behind = quote + size
        rest = behind < n
        start[behind[rest]] = True
    return np.flatnonzero(start)


class WordEncoder:
    """Ids of texts; each distinct word of plain texts is encoded by the library once in a task."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.added = [t.content.encode() for t in self.tok.get_added_tokens_decoder().values() if t.content]
        # a byte-level piece is written with one character a byte
        self.width = np.zeros(self.tok.get_vocab_size() + 1, np.int64)
        for piece, i in self.tok.get_vocab().items():
            self.width[i] = len(piece)
        self.forget()

    def forget(self) -> None:
        self.key, self.at, self.n, self.pool = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _learn(self, keys: np.ndarray, words: list[str]) -> None:
        """Encode new words. Those of a blank and another character are laid end to end, since the pattern cuts before each again."""
        glued = np.array([len(w) > 1 and w[0] == " " and not w[1].isspace() for w in words], bool)
        n, found = np.zeros(len(words), np.int64), {}
        at = np.flatnonzero(glued)
        runs = [at[i : i + 1024] for i in range(0, len(at), 1024)]
        got = self.tok.encode_batch_fast(["".join([words[i] for i in run]) for run in runs], add_special_tokens=False)
        for run, g in zip(runs, got, strict=True):
            ids = np.array(g.ids, np.uint32)
            ends = np.cumsum(self.width[ids])
            stop = np.searchsorted(ends, np.cumsum([len(words[i].encode()) for i in run]), "right")
            n[run] = np.diff(np.r_[0, stop])
            found[int(run[0])] = ids
        other = np.flatnonzero(~glued)
        for a in range(0, len(other), 4096):
            own = other[a : a + 4096]
            got = self.tok.encode([words[i] for i in own], is_pretokenized=True, add_special_tokens=False)
            n[own] = np.bincount(np.array(got.word_ids, np.int64), minlength=len(own))
            found[-1 - a] = np.array(got.ids, np.uint32)
        # the pool holds the glued words' ids, then the others'
        order = np.concatenate([at, other])
        place = np.empty(len(words), np.int64)
        place[order] = len(self.pool) + np.cumsum(n[order]) - n[order]
        slot = np.searchsorted(self.key, keys)  # both are sorted
        self.at = np.insert(self.at, slot, place)
        self.n, self.key = np.insert(self.n, slot, n), np.insert(self.key, slot, keys)
        self.pool = np.concatenate([self.pool, *found.values()])

    def _with_added(self, raw: bytes, off: np.ndarray) -> np.ndarray:
        """Which texts hold one of the file's added tokens, which the library finds before it cuts words."""
        out = np.zeros(len(off) - 1, bool)
        for t in self.added:
            at = raw.find(t)
            while at >= 0:
                i = int(np.searchsorted(off, at, "right")) - 1
                inside = at + len(t) <= off[i + 1]
                out[i] |= inside
                at = raw.find(t, int(off[i + 1]) if inside else at + 1)
        return out

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the UTF-8 texts data[off[i]:off[i + 1]] and how many each has."""
        size = np.diff(off)
        code, char = code_points(data, off)
        odd = np.r_[0, np.cumsum(code >= PLAIN)]
        raw = data.tobytes()
        odd = (odd[char[1:]] > odd[char[:-1]]) | self._with_added(raw, off)
        counts = np.zeros(len(size), np.int64)
        parts: dict[int, np.ndarray] = {}
        if odd.any():
            at = np.flatnonzero(odd)
            for i, got in zip(at.tolist(), self.tok.encode_batch([raw[off[i] : off[i + 1]].decode() for i in at], add_special_tokens=False), strict=True):
                parts[i] = np.array(got.ids, np.uint32)
                counts[i] = len(parts[i])
            code = code[np.repeat(~odd, np.diff(char))]
        plain = np.flatnonzero(~odd & (size > 0))
        length = np.diff(char)[plain]
        head = np.cumsum(length) - length
        start = word_starts(code, head)
        ids = np.zeros(0, np.uint32)
        if len(start):
            end = np.r_[start[1:], len(code)]
            key, first, which = np.unique(span_hash(prefix_hash_codes(code), start, end), return_index=True, return_inverse=True)
            slot = np.searchsorted(self.key, key)
            known = self.key[np.minimum(slot, len(self.key) - 1)] == key if len(self.key) else np.zeros(len(key), bool)
            if not known.all():
                new = first[~known]
                text = code.tobytes()
                self._learn(key[~known], [text[4 * a : 4 * b].decode("utf-32-le") for a, b in zip(start[new].tolist(), end[new].tolist(), strict=True)])
            slot = np.searchsorted(self.key, key)[which]
            n = self.n[slot]
            ids = self.pool[np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n - self.at[slot], n)]
            counts[plain] = np.bincount(np.searchsorted(head, start, "right") - 1, weights=n, minlength=len(plain)).astype(np.int64)
            if len(self.key) > CACHE_WORDS:
                self.forget()
        if parts:
            ends = np.cumsum(counts[plain])
            at = dict(zip(plain.tolist(), zip((ends - counts[plain]).tolist(), ends.tolist(), strict=True), strict=True))
            ids = np.concatenate([parts[i] if i in parts else ids[slice(*at.get(i, (0, 0)))] for i in range(len(size))])
        return ids, counts


#: A worker's encoders: the words learnt in a task serve its later tasks.
_ENCODERS: dict[str, WordEncoder] = {}


def _encoder(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


# --- grammar ---------------------------------------------------------------------------------------


def re_pair(ids: np.ndarray, terminals: int, uses: int = PAIR_USES) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, rules): rule r is symbol terminals + r and stands for its two symbols.

    A round replaces all pairs that have ``uses`` places without overlap, or a rule already; where two pairs
    overlap, the more frequent one goes first. Only places that a round changed and those of frequent pairs are
    counted in the next one. Rounds end when a count over the whole sequence finds no such pair.
    """
    seq, rules, top = ids.astype(np.uint32), [np.zeros((0, 2), np.uint32)], terminals
    known, names = np.zeros(0, np.uint64), np.zeros(0, np.uint32)
    open_, whole = np.ones(len(seq), bool), True
    while len(seq) > 1:
        open_[-1] = False
        pos = np.arange(len(seq) - 1) if whole else np.flatnonzero(open_)
        pos = pos[~_overlapped(seq, pos)]
        code, place, count = _pairs(seq, pos, top)
        old = np.zeros(len(code), bool)
        if len(known) and len(code):
            at = np.minimum(np.searchsorted(known, code), len(known) - 1)
            old = known[at] == code
        good = np.flatnonzero((count >= uses) | old)
        if not len(good):
            if whole:
                break
            whole = True
            continue
        by_rank = good[np.argsort(-count[good], kind="stable")]
        rank_of = np.full(len(code), len(good), np.int32)
        rank_of[by_rank] = np.arange(len(good), dtype=np.int32)
        own = np.repeat(rank_of, count)
        place, own = place[own < len(good)], own[own < len(good)]
        rank = np.full(len(seq) + 1, len(good), np.int32)  # the last cell stands before the first
        rank[place] = own
        take = (own < rank[place - 1]) & (own <= rank[place + 1])
        used = np.bincount(own[take], minlength=len(good))
        kept = (used >= uses) | (old[by_rank] & (used > 0))
        new = np.flatnonzero(kept & ~old[by_rank])
        name = np.zeros(len(good), np.uint32)
        name[new] = top + np.arange(len(new))
        if len(known):
            name[old[by_rank]] = names[at[by_rank[old[by_rank]]]]
        hit, symbol = place[take], own[take]
        hit, symbol = hit[kept[symbol]], name[symbol[kept[symbol]]]
        open_[:] = False
        open_[place] = open_[hit - 1] = True
        seq[hit] = symbol
        stay = np.ones(len(seq), bool)
        stay[hit + 1] = False
        seq, open_ = seq[stay], open_[stay]
        pair = code[by_rank[new]]
        rules.append(np.stack([pair >> np.uint64(32), pair & np.uint64(0xFFFFFFFF)], 1).astype(np.uint32))
        known, names, top = np.r_[known, pair], np.r_[names, name[new]], top + len(new)
        order = np.argsort(known)
        known, names = known[order], names[order]
        whole = not len(hit)  # else the places that overlap keep each other open
    return seq, np.concatenate(rules)


def _overlapped(seq: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """Which places hold a pair of equal symbols that overlaps the one counted before it."""
    out = np.zeros(len(pos), bool)
    same = np.flatnonzero(seq[pos] == seq[pos + 1])
    if len(same):
        run = np.flatnonzero(np.r_[True, np.diff(pos[same]) != 1])
        out[same] = (np.arange(len(same)) - np.repeat(run, np.diff(np.r_[run, len(same)]))) & 1 == 1
    return out


def _pairs(seq: np.ndarray, pos: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs (left symbol in the upper half) of the places, the places pair by pair, and each pair's number of them."""
    left, right = seq[pos].astype(np.uint64), seq[pos + 1].astype(np.uint64)
    bits = np.uint64(len(seq).bit_length())
    half = (np.uint64(64) - bits) // np.uint64(2)
    if top < 1 << int(half):  # pair and place in one number: one plain sort
        key = np.sort((left << (half + bits)) | (right << bits) | pos.astype(np.uint64))
        place, code = (key & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64), key >> bits
        code = ((code >> half) << np.uint64(32)) | (code & ((np.uint64(1) << half) - np.uint64(1)))
    else:
        code = (left << np.uint64(32)) | right
        order = np.argsort(code, kind="stable")
        place, code = pos[order], code[order]
    first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]]) if len(code) else np.zeros(0, np.int64)
    return code[first], place, np.diff(np.r_[first, len(code)])


def expansion_lengths(rules: np.ndarray, terminals: int) -> np.ndarray:
    """Ids that each symbol of the rules stands for; rules only use earlier symbols."""
    out = np.zeros(len(rules), np.int64)
    left = np.ones(len(rules), bool)
    while left.any():
        part = [np.where(rules[:, c] < terminals, 1, out[np.maximum(rules[:, c].astype(np.int64) - terminals, 0)] if len(rules) else 0) for c in (0, 1)]
        ready = left & (part[0] > 0) & (part[1] > 0)
        out[ready] = (part[0] + part[1])[ready]
        left &= ~ready
    return out


def expand(seq: np.ndarray, rules: np.ndarray, terminals: int, lengths: np.ndarray | None = None) -> np.ndarray:
    """The ids that a sequence stands for; each symbol's two parts are put straight in their places."""
    seq = seq.astype(np.int64)
    lengths = expansion_lengths(rules, terminals) if lengths is None else lengths.astype(np.int64)
    sized = lambda x: np.where(x < terminals, 1, lengths[np.maximum(x - terminals, 0)]) if len(lengths) else np.ones(len(x), np.int64)
    size = sized(seq)
    place = np.cumsum(size) - size
    out = np.empty(int(size.sum()), np.uint32)
    while len(seq):
        leaf = seq < terminals
        out[place[leaf]] = seq[leaf]
        place, rule = place[~leaf], rules[seq[~leaf] - terminals].astype(np.int64)
        place = np.concatenate([place, place + sized(rule[:, 0])])
        seq = np.concatenate([rule[:, 0], rule[:, 1]])
    return out


class Shard:
    """A written shard: header, document ids, ids per document, rules, expansion lengths, sequence."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("no shard starts here")
        (size,) = struct.unpack_from("<I", data, 4)
        head = json.loads(data[8 : 8 + size])
        at, arrays = 8 + size, []
        for name, kind, n in head["arrays"]:
            arrays.append(np.frombuffer(data, kind, n, at))
            setattr(self, name, arrays[-1])
            at += arrays[-1].nbytes
        self.terminals = head["terminals"]
        self.rules = self.rules.reshape(-1, 2)

    @staticmethod
    def pack(doc_id: np.ndarray, null: np.ndarray, n_ids: np.ndarray, ids: np.ndarray) -> bytes:
        terminals = int(ids.max()) + 1 if len(ids) else 0
        seq, rules = re_pair(ids, terminals)
        small = terminals + len(rules) <= 1 << 16
        arrays = [("doc_id", "<i8", doc_id), ("null", "|u1", null), ("n_ids", "<i8", n_ids), ("rules", "<u4", rules.ravel()), ("lengths", "<u4", expansion_lengths(rules, terminals)), ("seq", "<u2" if small else "<u4", seq)]
        head = json.dumps({"terminals": terminals, "arrays": [(n, k, len(a)) for n, k, a in arrays]}).encode()
        return MAGIC + struct.pack("<I", len(head)) + head + b"".join(a.astype(k).tobytes() for _, k, a in arrays)

    def ids(self, start: int = 0, stop: int | None = None) -> np.ndarray:
        """The ids from ``start`` up to ``stop``; only the symbols that cover them are expanded."""
        size = np.ones(len(self.seq), np.int64)
        inner = self.seq >= self.terminals
        size[inner] = self.lengths[self.seq[inner].astype(np.int64) - self.terminals]
        end = np.cumsum(size)
        stop = int(end[-1]) if stop is None and len(end) else stop or 0
        if start >= stop:
            return np.zeros(0, np.uint32)
        a, b = np.searchsorted(end, start, "right"), np.searchsorted(end, stop, "left") + 1
        skip = start - int(end[a] - size[a])
        return expand(self.seq[a:b], self.rules, self.terminals, self.lengths)[skip : skip + stop - start]


# --- files -----------------------------------------------------------------------------------------

_INDEX = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])


def write_tokens(documents: DataFrame, tokenizer_path: str, end_id: int = 2, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every text, append ``end_id``, write shards in ascending id order; returns the shard index.

    Rows that repeat an id are ordered by a hash of their texts, then by these; null ids come first; null texts are empty, so they
    have the end id alone. A file's name is its task attempt's own, and only the index of finished tasks
    names files. Other columns are ignored. An empty table gives an empty index.
    """
    folder = folder or new_folder(documents.sparkSession, "tokens")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, encoder, out, at, shard = TaskContext.get().partitionId(), _encoder(tokenizer_path), None, 0, 0
        held: list = []

        def flush() -> pa.RecordBatch:
            nonlocal out, at, shard, held
            doc, null, n, ids = (np.concatenate(x) for x in zip(*held, strict=True))
            data = Shard.pack(doc, null, n, ids)
            if out is None:
                files, path = fs.FileSystem.from_uri(folder)
                files.create_dir(path, recursive=True)
                out = files.open_output_stream(f"{path}/{name}")
            out.write(data)
            row = [part, shard, f"{folder}/{name}", at, len(data), len(doc), len(ids)]
            at, shard, held = at + len(data), shard + 1, []
            return pa.record_batch([pa.array([v], t) for v, t in zip(row, _INDEX.types, strict=True)], schema=_INDEX)

        name = f"{part:06d}-{uuid.uuid4().hex}.rpg"
        for batch in batches:
            doc_ids = batch.column("doc_id")
            for a, b, data, off in chunks(batch.column("text")):
                ids, n = encoder.encode(data, off)
                ends = np.cumsum(n + 1)
                full = np.full(len(ids) + len(n), end_id, np.uint32)
                full[np.arange(len(ids)) + np.repeat(np.arange(len(n)), n)] = ids
                own = doc_ids.slice(a, b - a)
                held.append((own.fill_null(0).to_numpy(), own.is_null().to_numpy(zero_copy_only=False).astype(np.uint8), n + 1, full[: ends[-1]]))
                if sum(len(h[3]) for h in held) >= SHARD_IDS:
                    yield flush()
        if held:
            yield flush()
        if out is not None:
            out.close()

    docs = documents.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    index = docs.withColumn("h", F.xxhash64("text")).repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "text").mapInArrow(write, "part int, shard int, file string, offset long, length long, n_docs long, n_ids long")
    return cut(index, "token-index")


def read_tokens(index: DataFrame, with_ids: bool = False) -> DataFrame:
    """Per document, read back from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, if asked for, ids."""
    # prefix sums over blocks of parts, over a block's parts, and over a part's shards
    sized = index.groupBy("part").agg(F.sum("n_ids").alias("total")).withColumn("block", F.floor(F.col("part") / BLOCK_PARTS))
    before = lambda total, w: F.coalesce(F.sum(total).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = sized.groupBy("block").agg(F.sum("total").alias("total")).select("block", before("total", Window.orderBy("block")).alias("block_start"))
    parts = sized.join(blocks, "block").select("part", (F.col("block_start") + before("total", Window.partitionBy("block").orderBy("part"))).alias("part_start"))
    placed = index.join(parts, "part").withColumn("start", F.col("part_start") + before("n_ids", Window.partitionBy("part").orderBy("shard")))
    tasks = max(1, index.count() // TASK_SHARDS)
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.list_(pa.int32()))] * with_ids
    schema = pa.schema(fields)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, name = None, None
        for batch in batches:
            for file, offset, length, start in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length", "start")), strict=True):
                if name != file:
                    name = file
                    files, path = fs.FileSystem.from_uri(file)
                    opened = files.open_input_file(path)
                shard = Shard(opened.read_at(length, offset))
                ids = shard.ids()
                ends = np.cumsum(shard.n_ids)
                raw = ids.astype("<u4").tobytes()
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip((ends - shard.n_ids).tolist(), ends.tolist(), strict=True)]
                columns = [pa.array(shard.doc_id, pa.int64(), mask=shard.null.astype(bool)), pa.array(start + ends - shard.n_ids), pa.array(shard.n_ids), pa.array(crc, pa.int64())]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.array(ids.astype(np.int32))))
                yield pa.record_batch(columns, schema=schema)

    dealt = placed.select("part", "shard", "file", "offset", "length", "start").repartition(tasks, "part", "shard").sortWithinPartitions("file", "offset")
    return dealt.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)
