"""Operators on texts against brute force, with nulls, empty texts, repeats, empty tables and clashing columns."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from axisframe.llm import jaccard_join as J
from axisframe.llm import substring_dedup as S
from axisframe.llm.decontaminate import decontaminate
from axisframe.llm.exact_dedup import build_filter, dedup_batch, exact_dedup, in_filter, write_snapshot
from axisframe.llm.line_dedup import dedup_lines, edit_distance, line_classes, line_report, probes, segments
from axisframe.llm.substring_dedup import align, chains, common_pairs, denser, passages, remove_passages, repeated_passages

np = pytest.importorskip("numpy")
SCHEMA = "doc_id long, text string, key string, rep long, line long, start int, bucket long, words string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "k", 1, 2, 3, 4, "w") for i, t in rows], SCHEMA).repartition(3)


def words_of(n, seed):
    r = random.Random(seed)
    return ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(n)]


def components(ids, links):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


# --- exact dedup -----------------------------------------------------------------------------------


def test_filter_has_no_false_negatives():
    keys = np.random.default_rng(1).integers(0, 1 << 63, 5000).astype(np.uint64)
    f = build_filter(np.concatenate([keys, keys]))
    assert in_filter(keys, *f).all()
    other = np.random.default_rng(2).integers(0, 1 << 63, 20000).astype(np.uint64)
    assert in_filter(other, *f).mean() < 0.02
    for n in (0, 1, 2, 3, 10):
        assert in_filter(keys[:n], *build_filter(keys[:n])).all()


def test_exact_dedup(spark):
    rows = [(0, "a b"), (1, "ab "), (2, "a\tb\n"), (3, None), (4, ""), (5, " \x0b"), (6, "x"), (None, "x"), (7, "x"), (7, "x"), (8, "long " * 50000), (9, "long" * 50000)]
    got = exact_dedup(table(spark, rows), F.col("doc_id") % 2 == 0).collect()
    assert len(got) == len(rows)
    strip = lambda t: re.sub(r"[\x20\x09-\x0d]", "", t or "")
    for r in got:
        own = [(i, t) for i, t in rows if hashlib.sha256(strip(t).encode()).hexdigest() == r.text_sha256]
        best = min(own, key=lambda x: (-len(x[1] or ""), x[0] is None, x[0] or 0))[0]
        assert (r.keep_id, r.group_size, r.kept) == (best, len(own), r.doc_id == best)
    assert exact_dedup(table(spark, []), F.lit(True)).count() == 0


def test_groups_of_null_ids_meet(spark):
    """Equal texts whose rows that stay have no id, on either side and on both; rows that repeat an id aren't multiplied."""
    rows = [(None, "x y"), (None, "xy"), (1, "xy"), (None, "null only"), (None, "nullonly"), (2, "z"), (2, "z"), (2, "z")]
    for side in (F.col("doc_id").isNull(), F.col("doc_id").isNotNull(), F.length("text") % 2 == 0):
        got = sorted(((r.doc_id, r.text_sha256[:4], r.keep_id, r.group_size) for r in exact_dedup(table(spark, rows), side).collect()), key=str)
        digest = lambda t: hashlib.sha256(t.encode()).hexdigest()[:4]
        want = [(None, digest("xy"), None, 3)] * 2 + [(1, digest("xy"), None, 3)] + [(None, digest("nullonly"), None, 2)] * 2 + [(2, digest("z"), 2, 3)] * 3
        assert got == sorted(want, key=str)


def test_a_second_batch_meets_the_written_snapshot(spark):
    old = table(spark, [(1, "a b"), (2, "c"), (3, None)])
    folder = write_snapshot(old)
    for batch in ([(10, "ab"), (11, "new"), (12, "")], [(20, "c"), (21, "c "), (22, "ab!")]):
        got = {r.doc_id: (r.keep_id, r.group_size) for r in dedup_batch(table(spark, batch), folder, old).where("not in_snapshot").collect()}
        assert got == ({10: (1, 2), 11: (11, 1), 12: (3, 2)} if batch[0][0] == 10 else {20: (21, 3), 21: (21, 3), 22: (22, 1)})


# --- decontamination -------------------------------------------------------------------------------


def hit_words(text, items, window=10):
    split = lambda t: [w for w in re.split(r"[\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if w]
    doc, hit, found = split(text), set(), set()
    for item, t in items:
        w = split(t)
        n = min(window, len(w))
        spans = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()
        for i in range(len(doc) - n + 1):
            if n and tuple(doc[i : i + n]) in spans:
                hit.update(range(i, i + n))
                found.add(str(item))
    return len(doc), len(hit), sorted(found)


def test_decontaminate(spark):
    w = [words_of(40, s) for s in range(6)]
    items = [(1, " ".join(w[0])), (2, " ".join(w[1][:12])), (10, "One, two THREE"), (11, ""), (12, None), (13, " ".join(w[0])), (14, "é1")]
    docs = [
        (0, " ".join(w[2] + w[0][5:20] + w[3])), (1, " ".join(w[0][3:12] + w[4])), (2, "x-" + "-".join(w[1][:12]).upper() + " one two three"), (3, None), (4, ""), (5, "!!!"), (6, "one TWO three. é1"), (7, " ".join(w[5] * 200 + w[0])), (0, "é1 " * 3), (None, "one two three"),
    ]
    got = decontaminate(table(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()
    key = lambda r: (str(r[0]), r[1:])
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in got), key=key) == sorted(((i, *hit_words(t, items)) for i, t in docs), key=key)
    none = decontaminate(table(spark, docs), spark.createDataFrame([], "item_id long, text string"))
    assert none.where("n_hit > 0").count() == 0 and none.count() == len(docs)


# --- Jaccard join ----------------------------------------------------------------------------------


def shingles(text, k=5):
    w = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def near_copies(seed):
    r, rows = random.Random(seed), []
    for base in range(4):
        w = words_of(120, 100 * seed + base)
        for _ in range(30):
            c = list(w)
            for _ in range(r.randint(0, 6)):
                c[r.randrange(len(c))] = "z" + str(r.randrange(99))
            rows.append((len(rows), " ".join(c)))
    shared = words_of(14, 7)
    rows += [(200 + i, " ".join(shared + words_of(6, 500 + i))) for i in range(20)]
    rows += [(300 + i, t) for i, t in enumerate([None, "", " \n", "a b", "A  b", "a b c d", "a b c d e", "a b c d e f", rows[0][1], rows[0][1].upper()])]
    return rows


@pytest.mark.parametrize("small", [2, 8])
def test_jaccard_components(spark, monkeypatch, small):
    monkeypatch.setattr(J, "SMALL_LIST", small)
    monkeypatch.setattr(J, "BLOCK", 7)
    rows = near_copies(3)
    sets = {i: shingles(t) for i, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = components(sets, links)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.jaccard_components(table(spark, rows)).collect()}
    assert got == {i: (len(sets[i]), want[i]) for i in sets}


def test_mates_across_bitmap_sizes():
    """A block's mates against all pairs, for sets of sizes around powers of two, also where the right block lacks the left one's size."""
    pd, pa = pytest.importorskip("pandas"), pytest.importorskip("pyarrow")
    rows = []
    for n in (15, 16, 17, 18, 31, 32, 33, 34):
        w = words_of(50, n // 20)
        rows.append((len(rows), " ".join(w[: n + 4])))
    make, _ = J._sketches(5)
    drawn = pa.Table.from_batches(make([pa.record_batch([pa.array([i for i, _ in rows]), pa.array([t for _, t in rows])], names=["doc_id", "text"])])).to_pandas()
    drawn = drawn.rename(columns={"doc_id": "rep"}).assign(leader=99, comp=drawn["doc_id"], apart=True)
    run, _ = J._mates(80)
    sets = {i: shingles(t) for i, t in rows}
    for x in sets:
        for y in sets:
            if x != y and 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y]):
                assert run(drawn[drawn["rep"] == x], drawn[drawn["rep"] == y])["a"].tolist() == sorted((x, y))
    assert {len(b) for b in drawn["sketch"]} == {8, 16, 32}


def test_jaccard_odd_rows(spark):
    rows = [(5, "a b c d e f g"), (5, "a b c d e f g"), (None, "a b c d e f g"), (7, "A b c d e f g")]
    got = J.jaccard_components(table(spark, rows)).collect()
    assert len(got) == 4 and {r.component_id for r in got} == {5}
    near = " ".join(words_of(60, 1))
    rows = [(1, near), (None, near + " x"), (None, near + " y"), (None, "only null ids have these words here"), (3, "p q r s t"), (3, "u v w x y"), (4, "u v w x y"), (None, None), (8, None)]
    got = sorted(((r.doc_id, r.component_id) for r in J.jaccard_components(table(spark, rows)).collect()), key=str)
    assert got == sorted([(1, 1), (None, 1), (None, 1), (None, None), (3, 3), (3, 3), (4, 3), (None, None), (8, 8)], key=str)
    assert J.jaccard_components(table(spark, [])).count() == 0


# --- lines -----------------------------------------------------------------------------------------


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(new[-1] + 1, row[j + 1] + 1, row[j] + (x != y)))
        row = new
    return row[-1]


def edited(r, s, n):
    s = list(s)
    for _ in range(n):
        i = r.randrange(len(s) + 1)
        s[i : i + r.randrange(2)] = r.choice(["", "x", "é"])
    return "".join(s)


@pytest.mark.parametrize("cap", [1, 2, 4])
def test_edit_distance(cap):
    r = random.Random(cap)
    a = ["".join(r.choice("ab ") for _ in range(r.randrange(40))) for _ in range(500)]
    b = [edited(r, x, r.randrange(cap + 3)) for x in a]
    codes = lambda t: [np.array([ord(c) for c in x], np.uint32) for x in t]
    assert edit_distance(codes(a), codes(b), cap).tolist() == [min(cap + 1, distance(x, y)) for x, y in zip(a, b, strict=True)]


def test_every_close_pair_shares_a_probe():
    r, tau = random.Random(5), 2
    keys = lambda s, d: {(d, i, s[at : at + m]) for dd, i, sh in probes(tau) if dd == d for at, m in [(int(segments(np.array([len(s) - d]), tau)[0][0, i]) + sh, int(segments(np.array([len(s) - d]), tau)[1][0, i]))] if at >= 0}
    for _ in range(2000):
        a = "".join(r.choice("abc") for _ in range(r.randrange(20, 30)))
        b = edited(r, a, r.randrange(3))
        if distance(a, b) > tau or abs(len(a) - len(b)) > tau:
            continue
        short, long = sorted((a, b), key=len)
        start, size = segments(np.array([len(short)]), tau)
        own = {(i, short[start[0, i] : start[0, i] + size[0, i]]) for i in range(tau + 1)}
        assert own & {(i, t) for _, i, t in keys(long, len(long) - len(short))}


def line_rows():
    r = random.Random(9)
    base = ["".join(r.choice("abcdefg ") for _ in range(r.randrange(24, 60))) for _ in range(6)]
    rows = [(i, "\n".join(edited(r, r.choice(base), r.randrange(4)) for _ in range(5))) for i in range(25)]
    return [*rows, (30, None), (31, ""), (32, "short one\nshort one"), (33, "eleven chars\neleven chars\neleven charz"), (34, rows[0][1]), (35, "\n\n" + rows[1][1])]


def line_classes_by_force(rows, tau=2, similarity=0.8):
    """(id, line number, first id, first line, other lines of the class) of all lines, nulls last, repeated rows in the table's order."""
    lines = sorted((i is None, i or 0, k, n, x) for k, (i, t) in enumerate(rows) for n, x in enumerate((t or "").split("\n")) if x.strip(" \t\r\x0b\x0c"))
    allowed = lambda a, b: min(tau, int((1 - similarity) * max(len(a), len(b)) + 1e-9))
    close = lambda a, b: a == b or (abs(len(a) - len(b)) <= allowed(a, b) and distance(a, b) <= allowed(a, b))
    comp = components(range(len(lines)), [(a, b) for a in range(len(lines)) for b in range(a + 1, len(lines)) if close(lines[a][4], lines[b][4])])
    size = {c: list(comp.values()).count(c) for c in set(comp.values())}
    name = lambda line: None if line[0] else line[1]
    return sorted(((name(x), x[3], name(lines[comp[k]]), lines[comp[k]][3], size[comp[k]] - 1) for k, x in enumerate(lines)), key=str)


def test_line_classes(spark):
    """Lines of 3 to 20 characters too, templates with numbers, a hot beginning, repeated and null ids; with a small block, some lists are refined."""
    r, rows = random.Random(3), line_rows()
    short = ["".join(r.choice("ab") for _ in range(r.randrange(3, 21))) for _ in range(120)]
    rows += [(100 + i, "\n".join(r.choice(short) for _ in range(3))) for i in range(40)]
    rows += [(300 + i, f"common words that stand before {r.randrange(10**6):06d} and after it") for i in range(40)]
    rows += [(400 + i, "a long shared beginning of lines " + "".join(r.choice("abcdefghijklmn") for _ in range(40))) for i in range(20)]
    rows += [(5, "x1\ngamma unique other"), (500, " \t"), (None, "null id line here"), (None, rows[0][1])]
    got = sorted(((x.doc_id, x.line_no, x.first_doc, x.first_line, x.n_others) for x in line_classes(table(spark, rows).coalesce(1), block=12).collect()), key=str)
    assert got == line_classes_by_force(rows)


def test_lines_of_repeated_ids(spark):
    rows = [(5, "alpha line number one\nbeta line number two"), (5, "alpha line number one\ngamma unique important line"), (6, "gamma unique important line")]
    out = sorted(r.text for r in dedup_lines(table(spark, rows).coalesce(1)).collect())
    assert out == sorted(["alpha line number one\nbeta line number two", "gamma unique important line"])


def test_line_classes_count_other_lines(spark):
    """A-B-C with A and C over 2 edits apart: each line has 2 others in its class; below 5 code points only equal lines link."""
    a = "a line of enough characters"
    rows = [(1, a), (2, a[:-2] + "xx"), (3, a[:-2] + "xx" + "yy"), (4, "fifteen letters"), (5, "fifteen letterz"), (6, "fifteen letterzzz"), (7, "four"), (8, "fous"), (9, "four")]
    classes = line_classes(table(spark, rows))
    assert {r.doc_id: (r.first_doc, r.n_others) for r in classes.collect()} == {1: (1, 2), 2: (1, 2), 3: (1, 2), 4: (4, 2), 5: (4, 2), 6: (4, 2), 7: (7, 1), 8: (8, 0), 9: (7, 1)}
    assert {r.doc_id for r in line_classes(table(spark, rows), min_chars=5).collect()} == {1, 2, 3, 4, 5, 6}


def test_line_report_and_texts(spark):
    rows = [(1, "a line of enough characters\nanother line of enough characters"), (2, "a line of enough charactery\nfresh line of enough characters"), (3, "a line of enough characters"), (4, None), (None, "a line of enough characters"), (5, "tiny"), (6, " \n\t")]
    df = table(spark, rows).withColumns({"row": F.lit(1), "gone": F.lit(2), "__gone": F.lit(3)})
    report = {r.doc_id: (r.n_lines, r.n_dropped, r.repeats_of) for r in line_report(df).collect()}
    assert report == {1: (2, 0, []), 2: (2, 1, [1]), 3: (1, 1, [1]), 4: (0, 0, []), None: (1, 1, [1]), 5: (1, 0, []), 6: (0, 0, [])}
    out = dedup_lines(df)
    assert out.columns == df.columns
    assert {r.doc_id: r.text for r in out.collect()} == {1: rows[0][1], 2: "fresh line of enough characters", 4: None, 5: "tiny", 6: " \n\t"}
    assert dedup_lines(table(spark, [])).count() == 0 and line_report(table(spark, [])).count() == 0


# --- passages --------------------------------------------------------------------------------------


def test_chain_bridges_a_gap_and_splits_at_a_wide_one():
    pos = np.array([0, 3, 6, 20, 23, 90, 93])
    other = np.array([100, 103, 106, 121, 124, 191, 194])
    got = [c.tolist() for c in chains(pos, other)]
    assert [[0, 11, 100], [20, 28, 121]] in got and [[90, 98, 191]] in got


def test_align_extends_over_changed_words():
    x = np.arange(100, dtype=np.uint32)
    y = x.copy()
    y[[10, 60]] = 999
    assert align(x, y, np.array([[20, 40, 20]])) == (0, 100, 0, 100, 98)


def test_repeated_passages(spark):
    r, shared, clean = random.Random(4), words_of(70, 1), [words_of(150, s) for s in range(10, 30)]
    fuzzy = [w if r.random() > 0.06 else "changed" for w in shared]
    rows = [(i, " ".join(c)) for i, c in enumerate(clean)]
    rows += [(50, " ".join(clean[0][:20] + shared + clean[1][:5])), (51, " ".join(shared + clean[2][:30])), (52, " ".join(clean[3][:30] + fuzzy)), (53, " ".join(shared[:30] + clean[4][:30])), (60, None), (61, ""), (None, " ".join(shared)), (62, " ".join(words_of(150, 77) * 2))]
    found = repeated_passages(table(spark, rows))
    got = {(r.doc_id, r.ref_doc_id) for r in found.collect()}
    assert (51, 50) in got and (52, 50) in got
    docs = {d for p in got for d in p}
    assert docs == {50, 51, 52}
    cut = {r.doc_id: r.text for r in remove_passages(table(spark, rows), found).collect()}
    assert " ".join(shared[10:60]) not in cut[51] and cut[60] is None and cut[10] == rows[10][1]
    assert repeated_passages(table(spark, [])).count() == 0


def test_exact_passage_stays_beside_a_shared_phrase(spark):
    shared, phrase, rest = words_of(55, 1), words_of(12, 2), [words_of(60, s) for s in range(40, 44)]
    rows = [(i, " ".join(rest[i] + shared + words_of(20, 80 + i) + phrase + rest[i + 2])) for i in (0, 1)]
    got = repeated_passages(table(spark, rows)).collect()
    assert any(r.doc_id == 1 and r.start_word <= 60 and r.end_word >= 115 and r.ref_start <= 60 and r.ref_end >= 115 for r in got)
    assert all(r.n_equal >= 0.8 * max(r.end_word - r.start_word, r.ref_end - r.ref_start) for r in got)


def test_parts_of_chains_against_all_runs():
    r = random.Random(8)
    for n in range(60):
        x = np.arange(200, dtype=np.uint32)
        y, rate = x.copy(), [0.0] * 200
        for a in range(0, 200, 25):
            rate[a : a + 25] = [r.choice([0, 0.1, 0.2, 0.4])] * 25
        y[[i for i in range(1, 199) if r.random() < rate[i]]] = 999
        same = x == y
        got = {i for a, b, *_ in passages(x, y, np.array([[0, 200, 0]])) for i in range(a, b)}
        want = {i for a in range(200) for b in range(a + 50, 201) if same[a] and same[b - 1] and same[a:b].sum() >= 0.8 * (b - a) for i in range(a, b)}
        assert got == want, n


def test_passages_with_regularly_changed_words(spark):
    """Every 5th to 8th word changed: 0.8 to 0.88 equal. Every 4th is too many."""
    rows = []
    for n, step in enumerate((8, 7, 6, 5, 4)):
        for copy in range(5):
            shared = words_of(60, 100 * n + copy)
            changed = [f"x{i}" if i % step == step - 1 and i < 59 else w for i, w in enumerate(shared)]
            rows += [(100 * n + copy, " ".join(words_of(40, 1000 * n + copy) + shared)), (1000 + 100 * n + copy, " ".join(changed + words_of(30, 5000 + 100 * n + copy)))]
    got = {(r.doc_id, r.ref_doc_id) for r in repeated_passages(table(spark, rows)).collect()}
    assert got == {(1000 + 100 * n + c, 100 * n + c) for n in range(4) for c in range(5)}


def _common_words(x, y):
    row = [0] * (len(y) + 1)
    for w in x:
        new = [0]
        for j, v in enumerate(y):
            new.append(row[j] + 1 if w == v else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_denser_chains_over_missing_and_repeated_words():
    x = np.arange(120, dtype=np.uint32)
    y = np.delete(x, [45, 80])
    y[60] = 999
    got = passages(x, y, np.array([[62, 66, 61]]))
    assert got and max(b - a for a, b, *_ in got) >= 60 and all(e >= 0.8 * max(b - a, d - c) for a, b, c, d, e in got)
    same = np.full(100, 7, np.uint32)  # every run equals every other one
    for c in denser(same, same, np.array([[40, 60, 40]])):
        assert all((same[s:e] == same[o : o + e - s]).all() for s, e, o in c.tolist())
    assert denser(same, same, np.array([[40, 60, 40]])) and not denser(x, x[::-1], np.array([[40, 44, 40]])) and not denser(x[:2], x, np.array([[0, 2, 0]]))


@pytest.mark.parametrize("kinds", ["change", "change, add, leave out"])
def test_changed_passages_amid_fragments(spark, kinds):
    """Fragments of 20 words of a passage stand before each of its copies: copies that are 0.8 equal to an earlier one, by common subsequences, are found."""
    r, rows, texts = random.Random(12), [], {}
    bases = [words_of(60, 2000 + f) for f in range(12)]
    for copy, rate in enumerate((0, 0.03, 0.06, 0.09)):
        for f, base in enumerate(bases):
            for _ in range(5):
                a = r.randrange(41)
                rows.append((len(rows), " ".join(words_of(15, 10**6 + len(rows)) + base[a : a + 20] + words_of(15, 2 * 10**6 + len(rows)))))
            own = []
            for w in base:
                kind = r.choice(kinds.split(", ")) if r.random() < rate else "keep"
                own += {"keep": [w], "change": [f"x{r.random()}"], "add": [w, f"x{r.random()}"], "leave out": []}[kind]
            texts[len(rows)] = (f, own)
            rows.append((len(rows), " ".join(words_of(20, 3 * 10**6 + len(rows)) + own + words_of(20, 4 * 10**6 + len(rows)))))
    want = {d for d, (f, x) in texts.items() for e, (g, y) in texts.items() if e < d and f == g and min(len(x), len(y)) >= 50 and _common_words(x, y) >= 0.8 * max(len(x), len(y))}
    found = repeated_passages(table(spark, rows)).collect()
    assert len(want) >= 30 and len(want & {p.doc_id for p in found}) >= 0.9 * len(want)
    assert {p.doc_id for p in found} <= set(texts) and all(p.n_equal >= 0.8 * max(p.end_word - p.start_word, p.ref_end - p.ref_start) for p in found)


@pytest.mark.parametrize("how", [{}, {"most": 3}, {"most": 3, "sub": 4}])
def test_changed_passages_amid_long_fragments(spark, how):
    """Seven fragments of 36 words of a passage stand before each of its copies: whoever holds a copy's seeds, an earlier copy is found."""
    r, rows, texts = random.Random(21), [], {}
    bases = [words_of(60, 7000 + f) for f in range(3)]
    for copy in range(5):
        for f, base in enumerate(bases):
            for _ in range(7):
                a = r.randrange(25)
                rows.append((len(rows), " ".join(words_of(30, 10**6 + len(rows)) + base[a : a + 36] + words_of(30, 2 * 10**6 + len(rows)))))
            own = [f"x{r.random()}" if copy and 0 < i < 59 and r.random() < 0.06 else w for i, w in enumerate(base)]
            texts[len(rows)] = (f, own)
            rows.append((len(rows), " ".join(words_of(20, 3 * 10**6 + len(rows)) + own + words_of(20, 4 * 10**6 + len(rows)))))
    want = {d for d, (f, x) in texts.items() for e, (g, y) in texts.items() if e < d and f == g and _common_words(x, y) >= 0.8 * 60}
    found = repeated_passages(table(spark, rows), **how).collect()
    assert len(want) >= 10 and want == {p.doc_id for p in found if p.doc_id in texts and p.ref_doc_id in texts}
    assert all(p.n_equal >= 0.8 * max(p.end_word - p.start_word, p.ref_end - p.ref_start) for p in found)


def test_common_pairs_against_counting():
    r = random.Random(3)
    own, other = ([np.array([r.choice([1, 2, r.randrange(900)]) for _ in range(r.randrange(40))], np.uint16) for _ in range(n)] for n in (30, 120))
    got = common_pairs(own, other)
    assert all(got[i, j] == np.isin(x, y).sum() for i, x in enumerate(own) for j, y in enumerate(other))
    assert common_pairs(own, [own[0][:0]]).sum() == 0


def blocks_of(texts, seed_at):
    """Rows of one seed as they come to the comparison."""
    pa, pd = pytest.importorskip("pyarrow"), pytest.importorskip("pandas")
    spots = [[{"seed": 1, "pos": p, "open": True}] for p in seed_at]
    run, _ = S._around(4, 50, 63)
    batch = pa.record_batch([pa.array(range(len(texts))), pa.array(spots), pa.array([" ".join(t) for t in texts])], names=["doc_id", "spots", "text"])
    rows = pd.concat([b.to_pandas() for b in run(iter([batch]))])
    return rows.assign(part=0, first=0, second=0)


def test_rows_of_a_frequent_line_are_looked_up(monkeypatch):
    """Rows that share a line only are no longer compared with all others; planted passages stay found, where all runs are frequent, too."""
    line, passage = words_of(12, 1), words_of(60, 2)
    texts = [words_of(60, 1000 + i) + line + words_of(60, 5000 + i) for i in range(300)]
    for i in (40, 150, 290):
        texts[i] = words_of(36, 9000 + i) + passage[:24] + line + passage[24:] + words_of(20, 9500 + i)
    rows = blocks_of(texts, [64] * 300)

    def pairs(kept):
        got = S._compared(4, 50, 29, 49, kept)[0](rows)
        return sorted(map(tuple, got[["doc_id", "other"]].values.tolist()))

    assert pairs(0) == [(150, 40), (290, 40), (290, 150)]  # all with all
    monkeypatch.setattr(S, "FEW", 1)
    assert pairs(18) == [(150, 40), (290, 40), (290, 150)]
    monkeypatch.setattr(S, "FEW", 64)
    monkeypatch.setattr(S, "common_pairs", None)
    assert pairs(18) == [(150, 40), (290, 40), (290, 150)]


def test_texts_that_repeat_themselves_are_verified_once(monkeypatch):
    """Chains with the same words around them: 1,600 places of a unit of which too few words are equal."""
    pd = pytest.importorskip("pandas")
    own, other = [np.tile(np.r_[np.arange(20), np.arange(a, a + 11)], 40).astype(np.uint32) for a in (100, 200)]
    segments = np.array([[40 * i + j, 31 * i, 31 * i + 20, 31 * j] for i in range(40) for j in range(40)]).ravel()
    calls, passages_ = [], S.passages
    monkeypatch.setattr(S, "passages", lambda *a: calls.append(1) or passages_(*a))
    rows = pd.DataFrame({"doc_id": [2], "other": [1], "segments": [segments], "low": [0], "other_low": [0], "tokens": [own.tobytes()], "other_tokens": [other.tobytes()]})
    assert sum(map(len, S._aligned(50, 0.8)[0](iter([rows])))) == 0 and 0 < len(calls) <= 200


def test_shared_runs_count_repeats_once_a_side():
    pack = lambda *w: np.array(w, np.uint32).tobytes()
    own, other = [pack(*[7] * 40), pack(1, 2, 3, 4), b""], [pack(*[7] * 10), pack(9, 1, 2, 3), pack(1)]
    assert S.shared_runs(own, other).tolist() == [8, 1, 0] and S.shared_runs(own, other, 1).tolist() == [10, 3, 0]


def test_verbatim_passages_amid_nested_boilerplate(spark):
    """All words of runs of 50 words that an earlier document has, against brute force over all pairs."""
    r, line = random.Random(6), words_of(90, 3)
    docs = {}
    for i in range(40):
        w = words_of(20, 600 + i)
        for _ in range(r.randint(1, 3)):
            a, n = r.randrange(60), r.choice([20, 30, 40, 55, 60])
            w += line[a : a + n] + words_of(r.randint(1, 15), r.randrange(10**6))
        docs[i] = w
    docs |= {100 + i: words_of(30, 700 + i) + line[a:b] + words_of(30, 800 + i) for i, (a, b) in enumerate([(0, 27), (28, 55), (0, 55), (0, 27), (28, 55), (0, 55)])}
    own = words_of(95, 4)  # the review's A < B < X < C
    docs |= {200 + i: words_of(30, 900 + i) + own[:n] + words_of(30, 950 + i) for i, n in enumerate([40, 55, 40, 55])}
    docs |= {300: own[60:80] + words_of(9, 1) + own[40:95], 301: words_of(30, 5) + own[40:95]}
    runs, want = {}, set()
    for i in sorted(docs):
        w = docs[i]
        want |= {(i, p + j) for p in range(len(w) - 49) if tuple(w[p : p + 50]) in runs for j in range(50)}
        runs |= {tuple(w[p : p + 50]): i for p in range(len(w) - 49)}
    found = repeated_passages(table(spark, [(i, " ".join(w)) for i, w in docs.items()]), sub=4).collect()
    got = {(r.doc_id, j) for r in found for j in range(r.start_word, r.end_word)}
    assert want <= got and any(r.doc_id == 203 and r.ref_doc_id == 201 for r in found)


def test_repeated_lines_are_aligned_once(monkeypatch):
    """Two texts of one line each, over and over: what is between two places is aligned once, not for every chain, and no passage changes."""
    n = 30
    own = np.array([21, 11, 18, 25, 1, 31, 13, 30, 3, 2, 17, 6, 19, 5, 26, 23, 9, 28, 19, 0, 20, 29, 26, 27, 8, 22, 15, 16, 26, 9] * n, np.uint32)
    other = np.array([21, 11, 18, 25, 12, 19, 13, 10, 3, 2, 17, 6, 19, 5, 26, 4, 23, 9, 28, 19, 0, 20, 24, 7, 27, 8, 22, 14, 15, 16] * n, np.uint32)
    every = [np.array([[30 * b, 30 * n, 0]]) for b in range(n - 4)]
    want = [p for c in every for p in passages(own, other, c)]
    asked, pairs = [], S._equal_pairs
    monkeypatch.setattr(S, "_equal_pairs", lambda x, y: asked.append(1) or pairs(x, y))
    known = S.Known(own, other)
    assert [p for c in every for p in passages(own, other, c, known=known)] == want
    assert 0 < len(asked) < 50  # 21,860 without


def test_words_of_both_sides_share_a_shuffle(spark):
    docs = spark.createDataFrame([(i, " ".join(words_of(60, 1))) for i in range(4)], "doc_id long, text string")
    found = spark.createDataFrame([(1, 0, [0, 0, 60, 0], 0, 60, 0, 60)], "doc_id long, other long, segments array<int>, low int, high int, other_low int, other_high int")
    held = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        out = S._verified(docs, found, 50, 0.8)
        assert "ReusedExchange" in out._jdf.queryExecution().executedPlan().toString() and [tuple(r) for r in out.collect()] == [(1, 0, 60, 0, 0, 60, 60)]
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
