"""Operators that write and read back: archives, chat windows, token shards, pieces; the classifier; the pipeline."""

import hashlib
import os
import zlib

import pytest
from pyspark.sql import functions as F

from axisframe.llm import chat_format as C
from axisframe.llm import token_output as T
from axisframe.llm import unigram as U
from axisframe.llm.toxicity import held_out, toxicity_scores
from axisframe.llm.warc import payload_digest, read_warc, write_warc

np = pytest.importorskip("numpy")
hypothesis = pytest.importorskip("hypothesis")
given, settings, st = hypothesis.given, hypothesis.settings, hypothesis.strategies
SF = "/root/testdata/sf0.001"


def path(name):
    return pytest.importorskip("public_tokenizers").path(name)


# --- archives --------------------------------------------------------------------------------------


def test_warc_round_trip(spark):
    rows = [(3, "http://a/3", "<p>é</p>"), (1, "http://a/1\r\nX: y", "<p>é</p>"), (2, None, None), (5, "u", ""), (4, "u", "x" * 300000), (None, "n", "<p>é</p>"), (1, "http://a/1", "<p>é</p>")]
    df = spark.createDataFrame([(*r, 0, 0) for r in rows], "page_id long, url string, html string, key int, offset int")
    index = write_warc(df)
    got = read_warc(index).collect()
    assert len(got) == len(rows)
    for r in got:
        html = next((h or "").encode() for i, _, h in rows if i == r.page_id)
        first = min(i for i, _, h in rows if i is not None and (h or "").encode() == html)
        assert (r.payload_bytes, r.payload_digest) == (len(html), payload_digest(html))
        assert (r.record_type, r.refers_to) == (("response", None) if r.page_id == first else ("revisit", first))
        assert r.payload == (bytearray(html) if r.record_type == "response" else None)
    some = read_warc(index.where("page_id = 4")).collect()
    assert len(some) == 1 and some[0].payload_bytes == 300000
    small = read_warc(write_warc(df, min_bytes=100)).where("record_type = 'revisit'")
    assert small.count() == 0
    assert read_warc(write_warc(df.limit(0))).count() == 0


# --- chat ------------------------------------------------------------------------------------------

TRICKY = st.lists(st.sampled_from([*"\\#<>/turn :\nAé", "###", "</turn>", "### Assistant: "]), max_size=12).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(TRICKY, TRICKY), max_size=5))
def test_turns_parse_back(turns):
    assert C.parse_turns("".join(C.format_turn(r, t)[0] for r, t in turns)) == turns
    for r, t in turns:
        whole, a, b = C.format_turn(r, t)
        assert whole.count("</turn>") == 1 and whole.count("###") == 1 and C.unescape(whole[a:b]) == t


def test_windows(spark):
    r = np.random.default_rng(3)
    text = lambda n: " ".join(["word"] * n)
    rows = [(1, 0, "system", text(20))] + [(1, i, ("user", "assistant")[(i + 1) % 2], text(int(r.integers(1, 60)))) for i in range(1, 40)]
    rows += [(2, 0, "assistant", "\\### Assistant: </turn> ok"), (2, 1, None, None), (3, None, "user", text(500)), (3, 1, "assistant", text(400)), (None, 0, "assistant", "x"), (4, 0, "assistant", "same"), (4, 0, "assistant", "same")]
    df = spark.createDataFrame([(*x, 1) for x in rows], "conv_id long, turn long, role string, text string, window int")
    windows = C.format_conversations(df, budget=100, history=40)
    own = windows.where("conv_id = 1").orderBy("window").collect()
    assert len(own) > 5 and sum(w.n_new for w in own) == 40
    for w in own:
        turns = C.parse_turns(w.text)
        assert turns[0] == ("system", text(20)) and len(turns) == w.n_repeated + w.n_new
        assert w.n_tokens <= 100 or w.n_new == 1
        assert sum(C.count_pieces([C.format_turn(*t)[0] for t in turns[1 : w.n_repeated]])) <= 40
        assert [w.text[s.start : s.stop] for s in w.loss] == [C.escape(t) for x, t in turns[w.n_repeated :] if x == "assistant"]
    got = {x.conv_id: x for x in C.read_back(windows).collect()}
    for conv in {x[0] for x in rows}:
        turns = sorted((x for x in rows if x[0] == conv), key=lambda x: (x[1] is not None, x[1] or 0, x[2] or "", x[3] or ""))
        full = "".join(f"{x[2] or ''}\n{x[3] or ''}\n" for x in turns)
        loss = "".join(x[3] or "" for x in turns if x[2] == "assistant")
        assert (got[conv].n_turns, got[conv].turns_sha256) == (len(turns), hashlib.sha256(full.encode()).hexdigest())
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert C.read_back(C.format_conversations(df.limit(0))).count() == 0


# --- token shards ----------------------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 6), max_size=300), st.integers(0, 300), st.integers(0, 300))
def test_grammar_round_trip(ids, a, b):
    ids = np.array(ids * 3, np.uint32)
    terminals = int(ids.max()) + 1 if len(ids) else 0
    seq, rules = T.re_pair(ids, terminals, uses=2)
    assert T.expand(seq, rules, terminals).tolist() == ids.tolist()
    shard = T.Shard(T.Shard.pack(np.arange(1), np.zeros(1, np.uint8), np.array([len(ids)]), ids))
    a, b = sorted((min(a, len(ids)), min(b, len(ids))))
    assert shard.ids(a, b).tolist() == ids[a:b].tolist()


ODD = st.lists(st.sampled_from([*" \n\t\r's\u00a0\u0085é1²!_-x’ñ漢😀", "'re", "'ll", "  ", "don't", "<|endoftext|>"]), max_size=20).map("".join)


@settings(max_examples=150, deadline=None)
@given(st.lists(ODD, min_size=1, max_size=6))
def test_words_give_the_librarys_ids(texts):
    enc = T._encoder(path("byte_bpe_50k.json"))
    raw = [t.encode() for t in texts]
    ids, n = enc.encode(np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum([len(t) for t in raw])])
    at = np.r_[0, np.cumsum(n)]
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [x.ids for x in enc.tok.encode_batch(texts, add_special_tokens=False)]


def test_added_tokens_in_texts_are_the_librarys():
    from tokenizers import Tokenizer

    texts = ["a <|endoftext|> b", "plain", "<|endof", "text|>", "", "<|endoftext|>", "é <|endoftext|><|endoftext|>", "漢 <|endoftext|>", "a <|endoftext |> b", "it's <|endoftext|>x"]
    raw = [t.encode() for t in texts]
    ids, n = T.WordEncoder(path("byte_bpe_50k.json")).encode(np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum([len(t) for t in raw])])
    at, tok = np.r_[0, np.cumsum(n)], Tokenizer.from_file(path("byte_bpe_50k.json"))
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [x.ids for x in tok.encode_batch(texts, add_special_tokens=False)]
    assert ids[:4].tolist() == [64, 220, 50256, 275]


def test_token_files(spark, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(T, "SHARD_IDS", 50)
    rows = [(i, f"text number {i} é " * (i % 7)) for i in range(60)] + [(70, None), (71, ""), (72, "漢字 " * 40), (None, "null id"), (5, "again")]
    df = spark.createDataFrame([(i, t, 1) for i, t in reversed(rows)], "doc_id long, text string, part int").repartition(4)
    got = T.read_tokens(T.write_tokens(df, path("byte_bpe_50k.json")), with_ids=True).orderBy("start").collect()
    tok, at = Tokenizer.from_file(path("byte_bpe_50k.json")), 0
    for (i, t), r in zip(sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "")), got, strict=True):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids) == (i, at, len(ids), ids)
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)
    assert T.read_tokens(T.write_tokens(df.limit(0), path("byte_bpe_50k.json"))).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10**6), st.sampled_from([1, 2, 5, 60]), st.integers(0, 800))
def test_no_rule_that_pays_is_left(seed, symbols, n):
    ids = np.random.default_rng(seed).integers(0, symbols, n).astype(np.uint32)
    seq, rules = T.re_pair(ids, symbols)
    assert T.expand(seq, rules, symbols).tolist() == ids.tolist() and len({tuple(r) for r in rules.tolist()}) == len(rules)
    last, count = {}, {}
    for i, pair in enumerate(zip(seq[:-1].tolist(), seq[1:].tolist(), strict=True)):
        if pair[0] == pair[1] and last.get(pair) == i - 1:
            continue  # overlaps the one before
        last[pair] = i
        count[pair] = count.get(pair, 0) + 1
    assert max(count.values(), default=0) < T.PAIR_USES
    size = [1] * symbols
    for a, b in rules.tolist():
        size.append(size[a] + size[b])
    assert T.expansion_lengths(rules, symbols).tolist() == size[symbols:]


# --- pieces ----------------------------------------------------------------------------------------

PIECES = ["▁", "▁▁", "a", "b", "c", "ab", "bc", "abc", "▁a", "▁ab", "é", "cab"]
SCORES = [-3.0, -2.5, -2.0, -2.2, -2.1, -3.0, -3.3, -4.0, -2.9, -3.1, -5.0, -4.4]


def small_model():
    bytes_ = [f"<0x{b:02X}>" for b in range(256)]
    return U.PieceModel.from_pieces(PIECES + bytes_, SCORES + [0.0] * 256, ["normal"] * len(PIECES) + ["byte"] * 256)


def brute(text, m):
    """Viterbi over whole texts; of equal scores, the longest last piece."""
    if not text:
        return []
    s = "▁" + text.replace(" ", "▁")
    score = dict(zip(PIECES, SCORES, strict=True))
    best = [(0.0, [])] + [(-float("inf"), [])] * len(s)
    for e in range(1, len(s) + 1):
        for a in range(e):
            p = s[a:e]
            if p in score:
                v, ids = best[a][0] + score[p], [PIECES.index(p)]
            elif e - a == 1:
                v, ids = best[a][0] + m.unknown, [len(PIECES) + b for b in p.encode()]
            else:
                continue
            if v > best[e][0]:
                best[e] = (v, best[a][1] + ids)
    return best[-1][1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="aabbcc  é😀\n", max_size=30), min_size=1, max_size=5))
def test_segmentation_is_the_best(texts):
    m = small_model()
    enc = U.Encoder(m)
    raw = [t.encode() for t in texts]
    data, off = np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum([len(t) for t in raw])]
    ids, n = enc.encode(data, off)
    at = np.r_[0, np.cumsum(n)]
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [brute(t, m) for t in texts]
    back, back_off = enc.decode(ids, n)
    assert [back.tobytes()[a:b].decode() for a, b in zip(back_off[:-1], back_off[1:], strict=True)] == texts


def test_scores_become_log_probabilities(spark):
    """A model file of merge ranks: the scores of its pieces sum to one in probability, and texts take about as many ids as by merges."""
    import sentencepiece

    from axisframe.llm.unigram import PieceModel, fitted, is_log

    file, texts = path("piece_bpe_32k.model"), ["Hello world, this is tokenization", "the quick brown fox jumps over the lazy dog and the cat", "a small sample of plain English words to count"] * 20
    assert not is_log(PieceModel.from_file(file).score[PieceModel.from_file(file).value[PieceModel.from_file(file).value >= 0]])
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    model = fitted(df, PieceModel.by_rank(file))
    assert is_log(model.score[model.value[model.value >= 0]]) and fitted(df.limit(0), model) is model
    got = U.encode_pieces(df, file, model).agg({"n_ids": "sum"}).first()[0]
    assert got <= 1.25 * sum(map(len, sentencepiece.SentencePieceProcessor(model_file=file).encode(texts)))
    assert U.encode_pieces(df, file).where("not lossless").isEmpty()


def test_long_unit_and_marker():
    m = small_model()
    for text in ("abcab" * 200, "é😀" * 150):
        data = np.frombuffer(text.encode(), np.uint8)
        assert U.Encoder(m).encode(data, np.array([0, len(data)]))[0].tolist() == brute(text, m)
    data = np.frombuffer("a▁b".encode(), np.uint8)
    assert U.Encoder(m).encode(data, np.array([0, len(data)]))[0].tolist() == brute("a b", m)


def test_encode_pieces(spark):
    rows = [(1, "Hello  world\n\té 😀"), (2, None), (3, ""), (4, "x" * 100000), (None, "a"), (1, "again"), (5, "a▁b")]
    got = U.encode_pieces(spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, ids int"), path("piece_bpe_32k.model")).collect()
    assert sorted((r.decoded for r in got)) == sorted((t or "").replace("▁", " ") for _, t in rows)
    for r in got:
        assert r.lossless == (r.doc_id != 5) and r.n_ids == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
    assert U.encode_pieces(spark.createDataFrame([], "doc_id long, text string"), path("piece_bpe_32k.model")).count() == 0


# --- toxicity --------------------------------------------------------------------------------------


def test_toxicity_learns_and_handles_odd_rows(spark):
    r = np.random.default_rng(5)
    word = lambda: "".join(r.choice(list("abcdefgh"), 4))
    rows, labels = [], []
    for i in range(1200):
        toxic = int(i % 4 == 0)
        w = [word() for _ in range(40)]
        if toxic:
            for at in r.integers(0, 40, 3):
                w[at] = str(r.choice(["grobby", "you idiot", "snazzleby"]))
        rows.append((i, " ".join(w), 0))
        labels.append((i, 1, toxic))
    docs = spark.createDataFrame([*rows, (5000, None, 0), (5001, "", 0), (None, "you idiot", 0), (3, rows[3][1], 0)], "doc_id long, text string, label int")
    marks = spark.createDataFrame([*labels, (3, 1, None), (9999, 1, 1), (None, 1, 1), (4, 1, 1)], "doc_id long, quality int, toxic int")
    got = toxicity_scores(docs, marks).collect()
    assert len(got) == 1204 and all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.3) for x in got)
    held = [x for x in got if x.held_out and x.doc_id < 1200]
    assert len(held) > 200 and sum(x.predicted == int(x.doc_id % 4 == 0) for x in held) >= 0.97 * len(held)
    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 4 == 2) for x in got if x.doc_id is not None)


def test_toxicity_without_two_classes(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    assert [x.score for x in toxicity_scores(docs, spark.createDataFrame([], "doc_id long, toxic int")).collect()] == [0.0, 0.0]
    assert {x.score for x in toxicity_scores(docs, spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, toxic int")).collect()} <= {0.0, 1.0}
    assert docs.select(held_out(F.lit(None).cast("long"))).first()[0] is False


# --- pipeline --------------------------------------------------------------------------------------


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_pipeline_stages(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    from test_text_operators import components, distance, hit_words, shingles

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    kept = pipeline.cut(pipeline.toxicity(spark, docs, SF), "t")
    lines = pipeline.cut(pipeline.line_dedup(spark, kept, SF), "l")
    apart = pipeline.cut(pipeline.jaccard_join(spark, lines, SF), "j")
    clean = pipeline.cut(pipeline.decontamination(spark, apart, SF), "d")
    assert kept.columns == lines.columns == apart.columns == clean.columns == columns
    # lines: pairs whose bags of characters are near enough are compared
    text = {r.doc_id: r.text for r in kept.collect()}
    every = sorted((i, n, x) for i, t in text.items() for n, x in enumerate(t.split("\n")) if x.strip(" \t\r\x0b\x0c"))
    bags = np.stack([np.bincount(np.frombuffer(x.encode("utf-32-le"), np.uint32) % 32, minlength=32) for _, _, x in every]).astype(np.int32)
    size = np.array([len(x) for _, _, x in every])
    links = []
    for k, (_, _, x) in enumerate(every):
        for j in np.flatnonzero((np.abs(size - size[k]) <= 2) & (np.abs(bags - bags[k]).sum(1) <= 4)).tolist():
            y = every[j][2]
            if j > k and (x == y or distance(x, y) <= min(2, int(0.2 * max(len(x), len(y)) + 1e-9))):
                links.append((k, j))
    comp = components(range(len(every)), links)
    gone = {every[k][:2] for k in comp if comp[k] != k}
    want = {}
    for i, t in text.items():
        left = [x for n, x in enumerate(t.split("\n")) if (i, n) not in gone]
        if len(left) == t.count("\n") + 1 or any(x.strip(" \t\r\x0b\x0c") for x in left):
            want[i] = "\n".join(left)
    got = {r.doc_id: r.text for r in lines.collect()}
    assert got == want
    # near copies, benchmark
    sets = {i: shingles(t) for i, t in got.items()}
    comp = components(sets, [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])])
    assert {r.doc_id for r in apart.collect()} == {i for i in comp if comp[i] == i}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert {r.doc_id for r in clean.collect()} == {i for i in comp if comp[i] == i and not hit_words(got[i], items)[1]}
    last = pipeline.sentencepiece(spark, clean, SF)
    assert last.count() == clean.count() and last.where("not lossless").count() == 0


def test_pipeline_of_odd_tables(spark, tmp_path):
    """Null ids and texts, repeated rows, clashing columns, a very long text; an empty table."""
    pipeline = pytest.importorskip("corpus_pipeline")
    r = np.random.default_rng(5)
    prose = lambda n: " ".join("".join(r.choice(list("abcdefgh"), r.integers(2, 8))) for _ in range(n))
    one, long = prose(60), prose(40000)
    rows = [(1, one), (1, one), (2, one + " z"), (3, None), (4, ""), (None, prose(50)), (None, None), (5, " \n "), (6, long), (7, "tiny"), (8, prose(30) + "\n" + prose(30))]
    schema = "doc_id long, text string, row int, gone string, key long, id long, rep long, label double"
    labels = spark.createDataFrame([(1, 0, 0), (2, 0, 0), (8, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([("a", prose(20)), (None, "x"), ("b", None)], "item_id string, text string")
    for name, part in (("full", rows), ("empty", [])):
        spark.createDataFrame([(i, t, 1, "g", 2, 3, 4, 0.5) for i, t in part], schema).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        labels.write.parquet(f"{tmp_path}/{name}/labels.parquet")
        bench.write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
    got = pipeline.run(spark, str(tmp_path / "full")).collect()
    ids = [x.doc_id for x in got]
    # of the copies of document 1 one row has its line; 2 repeats it within an edit; texts without lines stay
    assert sorted(map(str, ids)) == sorted(["1", "3", "4", "None", "None", "5", "6", "7", "8"]) and all(x.lossless for x in got)
    assert pipeline.run(spark, str(tmp_path / "empty")).count() == 0


def test_scores_come_from_all_documents(spark):
    """A word that only the last of 6,000 documents hold counts as often as it is there, however many come before in any order."""
    from axisframe.llm.unigram import Encoder, PieceModel, fitted

    model = PieceModel.by_rank(path("piece_bpe_32k.model"))
    texts = [("the quick brown fox", 5999), ("zebra  zebra é", 1), (None, 1), ("", 1)]
    df = spark.createDataFrame([(t,) for t, n in texts for _ in range(n)], "text string")
    want = model
    for _ in range(3):
        uses = {}
        for t, n in texts:
            raw = (t or "").encode()
            for i in Encoder(want).encode(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0].tolist():
                uses[i] = uses.get(i, 0) + n
        want = want.rescored({i: n for i, n in uses.items() if i not in set(want.byte_id.tolist())})
    assert np.array_equal(fitted(df, model).score, want.score)
