"""Decisions by row where ids repeat or are null, chat budgets, and memories that forget."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from axisframe.llm import chat_format as C
from axisframe.llm import jaccard_join as J
from axisframe.llm import line_dedup as LD
from axisframe.llm.jaccard_join import jaccard_components
from axisframe.llm.line_dedup import line_classes
from axisframe.llm.substring_dedup import dedup_passages, remove_passages, repeated_passages


def words_of(n, seed):
    r = random.Random(seed)
    return ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(n)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["system", "user", "assistant"]), st.integers(1, 130)), min_size=1, max_size=30), st.integers(0, 60))
def test_only_turns_beyond_the_budget_exceed_it(turns, history):
    w, out = C._Windows(1, 100, history, ("assistant",)), []
    system = None
    for i, (role, n) in enumerate(turns):
        done = w.add(role, str(i), n)
        out += [done] if done else []
    out.append(w.close())
    tokens, at = {str(i): n for i, (_, n) in enumerate(turns)}, 0
    for k, x in enumerate(out):
        parsed = C.parse_turns(x["text"])
        new = parsed[x["n_repeated"] :]
        assert [t for _, t in new] == [str(i) for i in range(at, at + len(new))]  # each turn is new once, in order
        at += len(new)
        assert x["n_tokens"] == sum(tokens[t] for _, t in parsed)
        if system is not None:
            assert parsed[0] == ("system", system)
        if x["n_tokens"] > 100:
            assert len(new) == 1 and x["n_repeated"] <= 1 and tokens[new[0][1]] + (tokens[system] if system is not None else 0) > 100
        if k == 0 and turns[0][0] == "system":
            system = "0"
    assert at == len(turns)


def test_turns_of_the_review(spark):
    """209, 709, 249 and 909 tokens under 1,024."""
    w = C._Windows(1, 1024, 256, ("assistant",))
    done = [d for d in (w.add("user", "x", n) for n in (209, 709, 249, 909)) if d] + [w.close()]
    assert [d["n_tokens"] for d in done] == [918, 249, 909]


SCHEMA = "doc_id long, text string, key string, spans int, row long, __id string"


def test_passages_go_from_their_own_row(spark):
    shared, rest = words_of(70, 1), [" ".join(words_of(80, s)) for s in range(10, 16)]
    passage = " ".join(shared)
    rows = [(1, f"{rest[0]} {passage}"), (1, rest[1]), (2, f"{passage} {rest[2]}"), (2, rest[3]), (None, f"{rest[4]} {passage}"), (None, None), (3, "")]
    df = spark.createDataFrame([(i, t, "k", 1, 2, "x") for i, t in rows], SCHEMA)
    got = [(str(r.doc_id), r.text) for r in dedup_passages(df).collect()]
    kept = lambda t: t is None or passage not in t
    assert len(got) == 7 and sum(not kept(t) for _, t in got) == 1
    assert ("1", rest[1]) in got and ("2", rest[3]) in got and ("2", rest[2]) in got and ("None", rest[4]) in got and ("None", None) in got and ("3", "") in got
    with pytest.raises(ValueError):
        remove_passages(df, repeated_passages(df))
    alone = df.where("doc_id = 3 or doc_id is null")
    assert remove_passages(alone, repeated_passages(alone)).count() == 3 and dedup_passages(df.limit(0)).count() == 0
    assert remove_passages(alone, repeated_passages(alone)).columns == df.columns


def test_pipeline_stages_decide_by_row(spark, tmp_path):
    """A clean row stays beside a contaminated one with its id, and null ids are no way out."""
    pipeline = pytest.importorskip("corpus_pipeline")
    item = " ".join(words_of(15, 3))
    text = [" ".join(words_of(40, s)) for s in range(20, 26)]
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    make = lambda rows: spark.createDataFrame([(i, t, 1, "s") for i, t in rows], "doc_id long, text string, row int, own_id string")
    out = pipeline.decontamination(spark, make([(None, f"{text[0]} {item}"), (3, f"{item} {text[1]}"), (3, text[2]), (4, text[3]), (None, text[4])]), str(tmp_path))
    assert sorted((str(r.doc_id), r.text) for r in out.collect()) == sorted([("3", text[2]), ("4", text[3]), ("None", text[4])])
    assert out.columns == ["doc_id", "text", "row", "own_id"]
    copies = [(5, text[0]), (5, text[0]), (None, text[0]), (6, text[0] + " x"), (5, text[1]), (None, text[2]), (None, text[2]), (7, None), (7, ""), (7, "")]
    out = pipeline.jaccard_join(spark, make(copies), str(tmp_path)).collect()
    assert sorted((str(r.doc_id), str(r.text)) for r in out) == sorted([("5", text[0]), ("5", text[1]), ("None", text[2]), ("7", "None"), ("7", ""), ("7", "")])
    assert pipeline.toxicity(spark, make(copies), str(tmp_path)).count() == len(copies)


def test_memories_that_forget_change_nothing(spark, monkeypatch):
    lines = ["the same line of text", "the same line of texts", "another line altogether", *(f"line number {i} {i * i}" for i in range(12))]
    docs = spark.createDataFrame([(i, "\n".join(lines[i % 3 : i % 3 + 5])) for i in range(30)], "doc_id long, text string").repartition(2)
    sets = spark.createDataFrame([(i, " ".join(words_of(60, i % 5) + ["x"] * (i % 2))) for i in range(30)], "doc_id long, text string").repartition(2)
    read = lambda df: sorted(map(str, df.collect()))
    want = read(line_classes(docs)), read(jaccard_components(sets))
    monkeypatch.setattr(LD, "DONE", 2)
    monkeypatch.setattr(J, "DONE", 2)
    assert (read(line_classes(docs)), read(jaccard_components(sets))) == want


def test_rows_of_files_keep_their_numbers(spark, tmp_path):
    """However the files are split, a row has one number; tables that aren't files are numbered, too."""
    pipeline = pytest.importorskip("corpus_pipeline")
    df = spark.range(3000).selectExpr("id as doc_id", "repeat(cast(id as string), 20) as text", "'r' as row")
    df.repartition(3).write.option("parquet.block.size", 4096).parquet(f"{tmp_path}/d")
    docs = spark.read.parquet(f"{tmp_path}/d")
    numbers = lambda: {r.doc_id: r[name] for r in pipeline._numbered(docs)[0].collect()}
    name = pipeline._numbered(docs)[1]
    assert name not in docs.columns
    whole = numbers()
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
        assert numbers() == whole and len(set(whole.values())) == 3000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    made, row = pipeline._numbered(spark.createDataFrame([(1, "a"), (1, "a")], "doc_id long, text string"))
    assert len({r[row] for r in made.collect()}) == 2
