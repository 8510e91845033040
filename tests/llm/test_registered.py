"""The registered queries: SQL on the smallest tables, and brute force where SQL has no words for them."""

import hashlib
import os
import re

import pytest

from axisframe.llm import queries as Q
from axisframe.llm import toxicity as X
from axisframe.llm.substring_dedup import repeated_passages

np = pytest.importorskip("numpy")
SF = "/root/testdata/sf0.001"
TABLES = "documents pages benchmark labels conversations embeddings".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    con = pytest.importorskip("duckdb").connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    got, want = Q.QUERIES[name](spark, SF).toPandas(), duck.sql(Q.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda df: sorted(map(str, df[sorted(df.columns)].astype(object).where(df[sorted(df.columns)].notna(), None).values.tolist()))
    whole = lambda lines: [re.sub(r"(\d)\.0\b", r"\1", x) for x in lines]
    assert whole(rows(got)) == whole(rows(want))


def test_chat_query(spark):
    """Every conversation and the tricky one, recomputed from the table."""
    rows = [(r.conv_id, r.turn, r.role, r.text or "") for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    tricky = "\\### Assistant: </turn> ok"
    rows += [(-7, 0, "user", tricky), (-7, 1, "assistant", tricky)]
    got = {r.conv_id: r for r in Q.op7_chat_format(spark, SF).collect()}
    assert set(got) == {r[0] for r in rows}
    for conv, r in got.items():
        turns = sorted(x for x in rows if x[0] == conv)
        whole, loss = "".join(f"{x[2]}\n{x[3]}\n" for x in turns), "".join(x[3] for x in turns if x[2] == "assistant")
        assert (r.n_turns, r.turns_sha256) == (len(turns), hashlib.sha256(whole.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest()) and r.formatted_chars > len(whole)


def words(text):
    return re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_passages_recall_against_all_pairs(spark):
    """Documents with ids divisible by 20 against all earlier ones: the words in verbatim passages of 50 words that are reported."""
    docs = sorted((r.doc_id, words(r.text)) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    runs, want = {}, set()
    for i, w in docs:
        for p in range(len(w) - 49):
            run = tuple(w[p : p + 50])
            if i % 20 == 0 and run in runs:
                want |= {(i, p + j) for j in range(50)}
        for p in range(len(w) - 49):
            runs.setdefault(tuple(w[p : p + 50]), i)
    found = repeated_passages(spark.read.parquet(f"{SF}/documents.parquet")).where("doc_id % 20 = 0").collect()
    got = {(r.doc_id, j) for r in found for j in range(r.start_word, r.end_word)}
    assert want and len(want & got) >= 0.9 * len(want)
    text = dict(docs)
    for r in found:  # what is reported is there
        x, y = text[r.doc_id][r.start_word : r.end_word], text[r.ref_doc_id][r.ref_start : r.ref_end]
        assert min(len(x), len(y)) >= 50 and r.ref_doc_id < r.doc_id and r.n_equal >= 0.8 * max(len(x), len(y))


def test_toxic_features_against_plain_python():
    """Densities, rates and nearness of a few texts, recomputed word by word."""
    pa = pytest.importorskip("pyarrow")
    texts = ["You are an IDIOT!! really, you idiot", "a calm text about nothing. 3 cats", "", "1d10t you! SCUM", "tu es un crétin — vous savez"]
    lexicon = X._hash_words(["calm"])
    run, _ = X._features((lexicon, np.full(len(lexicon), 2.5)))
    batch = pa.record_batch([pa.array(range(len(texts))), pa.array([None] * len(texts), pa.float64()), pa.array([0] * len(texts), pa.int32()), pa.array(texts)], names=["doc_id", "label", "part", "text"])
    got = [dict(zip(X.FEATURES, r["features"], strict=True)) for b in run([batch]) for r in b.to_pylist()]
    for text, f in zip(texts, got, strict=True):
        w = re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+", text)
        w = [x for x in w]
        low = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in w]
        n, size = max(1, len(w)), max(1, len(text.encode()))
        insult = [x in X.INSULTS for x in low]
        you = [x in X.SECOND_PERSON for x in low]
        hit = [a or x == "calm" for a, x in zip(insult, low, strict=True)]
        near = [h and any(you[max(0, i - 5) : i + 6]) for i, h in enumerate(hit)]
        want = {
            "insult_density": sum(insult) / n, "mined_density": 2.5 * low.count("calm") / n, "near_you_density": sum(near) / n, "you_density": sum(you) / n,
            "capital_rate": sum("A" <= c <= "Z" for c in text) / size, "shout_rate": sum(len(x) > 2 and all("A" <= c <= "Z" for c in x) for x in w) / n,
            "exclaim_rate": sum(c in "!?" for c in text) / size, "log_words": np.log1p(len(w)),
        }
        for k, v in want.items():
            assert f[k] == pytest.approx(v), (text, k)


def test_registered_names(spark):
    assert len(Q.QUERIES) == 13 and {int(n[2:].split("_")[0]) for n in Q.QUERIES} == set(range(1, 14)) and set(Q.ORACLE_SQL) <= set(Q.QUERIES)
