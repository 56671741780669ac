"""The llm operators against brute force, exact round trips and their stated cases."""

import random
import uuid

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wetlens.llm import grouping, matching, mixing, overlap, packing, spans, tokens, values
from wetlens.session import create, load, shared_dir

S1 = "/root/testdata/sf0.001"
MANIFEST = "row_idx long, path string, label int, feature_type string, x double, y double, subset string, source string, labelled_at timestamp, added_at timestamp"


def manifest(spark, rows):
    """rows of row_idx, path, feature_type, x, y, subset, source; the other columns are NULL."""
    return spark.createDataFrame([(i, p, None, f, x, y, s, c, None, None) for i, p, f, x, y, s, c in rows], MANIFEST)


# 1: overlaps


def test_overlap_cases(spark):
    X, Y = 328000.0, 6821000.0
    rows = [
        (1, "data/a.npy", None, X, Y, "train", "s"), (2, "DATA\\A.NPY", None, X + 500, Y, "val", "s"), (3, None, None, X + 2.0 - 0.01, Y, "test", "t"), (4, None, None, X + 2.01, Y, "test", "t"),
        (5, None, None, None, None, "train", None), (6, None, None, None, None, "val", None), (7, "data/a.npy", None, X, Y, None, "s"), (8, "data/a.npy", None, X + 1, Y, "train", "s"), (9, "data/a.npy", None, X + 1, Y, "val", None),
    ]
    d = manifest(spark, rows).withColumn("held", F.lit(1)).withColumn("h1", F.lit("x"))
    want = {(1, 2), (1, 3), (1, 9), (8, 2), (8, 3), (8, 4), (8, 9)}
    for hot in (10_000, 1):
        got = [tuple(r) for r in overlap.overlap_pairs(d, hot=hot).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    report = {(r["subset"], r["source"]): (r["n_rows"], r["n_overlapping"], r["n_pairs"]) for r in overlap.overlap_report(d).collect()}
    assert report == {("val", "s"): (1, 1, 2), ("test", "t"): (2, 2, 3), ("val", None): (2, 1, 2)}
    assert overlap.overlap_pairs(d.limit(0)).count() == 0


def test_overlap_with_a_hot_file_and_place(spark):
    """A third of the rows are one file, another third one place; keys are cut into blocks."""
    rng = np.random.default_rng(0)
    rows = []
    for i in range(240):
        p = "data/hot.npy" if i % 3 == 0 else f"data/{rng.integers(60)}.npy"
        x, y = (300000.0 + rng.integers(3), 6700000.0) if i % 3 == 1 else (200000.0 + rng.uniform(0, 300), 6700000.0 + rng.uniform(0, 300))
        rows.append((i, p, None, float(x), float(y), ["train", "train", "val", "test"][rng.integers(4)], "s"))
    want = {(a[0], b[0]) for a in rows if a[5] == "train" for b in rows if b[5] != "train" and (a[1] == b[1] or (a[3] - b[3]) ** 2 + (a[4] - b[4]) ** 2 <= 4)}
    d = manifest(spark, rows)
    got = [tuple(r) for r in overlap.overlap_pairs(d, hot=10).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    report = overlap.overlap_report(d).collect()
    assert sum(r["n_pairs"] for r in report) == len(want) and sum(r["n_overlapping"] for r in report) == len({b for _, b in want})


# 2: grouping


def _groups(rows, r):
    root = {i: i for i, *_ in rows}
    moved = True
    while moved:
        moved = False
        for a in rows:
            for b in rows:
                if None not in (a[1], b[1], a[3]) and a[3] == b[3] and (a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2 <= r * r and root[a[0]] != root[b[0]]:
                    root[a[0]] = root[b[0]] = min(root[a[0]], root[b[0]])
                    moved = True
    return root


TARGETS = {"train": 0.7, "val": 0.15, "test": 0.15}


def table(spark, radius=grouping.RADIUS):
    return grouping.Table(spark, f"{shared_dir(spark)}/t-{uuid.uuid4().hex}", radius)


@pytest.mark.parametrize("direct", [1024, 0])
def test_components_and_growth(spark, monkeypatch, direct):
    """One batch and three; with no pairs compared at once, undecided cells are cut until they are settled."""
    monkeypatch.setattr(grouping, "DIRECT", direct)
    rng = np.random.default_rng(7)
    rows = [(i, float(rng.uniform(0, 900)), float(rng.uniform(0, 900)), int(rng.integers(3))) for i in range(250)]
    rows[:60] = [(i, 450.0 + (i % 4), 450.0, 1) for i in range(60)]
    rows += [(900, None, 1.0, 1), (901, 1.0, 1.0, None), (902, float("nan"), 1.0, 1), (903, 2000.0, 2000.0, 1), (904, 2000.0 + 40.0, 2000.0, 1), (905, 3000.0, 2000.0, 1), (906, 3000.0 + 40.001, 2000.0, 1)]
    d = spark.createDataFrame(rows, "id long, x double, y double, kind int").withColumn("subset", F.lit("x")).withColumn("component", F.lit("x"))
    want = _groups([(i, None, y, k) if x != x else (i, x, y, k) for i, x, y, k in rows], 40.0)
    assert {r["id"]: r["component"] for r in table(spark).grow(d).rows().collect()} == want
    t = table(spark)
    for k in range(3):
        t.grow(d.filter(F.pmod("id", F.lit(3)) == k), TARGETS)
    got = grouping.Table(spark, t.location).rows().collect()
    assert {r["id"]: r["component"] for r in got} == want
    sizes = {c: list(want.values()).count(c) for c in want.values()}
    assert all(r["linked"] == (sizes[r["component"]] > 1) for r in got)
    by = {}
    for r in got:
        by.setdefault(r["component"], set()).add(r["subset"])
    assert all(len(s) == 1 and s <= {*TARGETS, grouping.QUARANTINE} for s in by.values())


def test_a_crowded_site_is_one_cell(spark):
    """Many points on one spot come down to a few cells before anything is joined."""
    d = spark.range(20_000).select("id", (F.rand(1) * 5 + 328000).alias("x"), (F.rand(2) * 5 + 6821000).alias("y"), F.lit(1).alias("kind"))
    t = table(spark).grow(d)
    assert t.rows().select("component").distinct().collect() == [(0,)]
    assert spark.read.parquet(f"{t.location}/{t.version()['batches'][0]}/cells").count() <= 4


def test_existing_splits_are_kept_and_conflicts_quarantined(spark):
    schema = "id long, x double, y double, kind int"
    target = {"a": 0.5, "b": 0.5}
    t = table(spark).grow(spark.createDataFrame([(1, 0.0, 0.0, 1), (2, 100.0, 0.0, 1), (3, 500.0, 0.0, 1), (4, 900.0, 0.0, 1)], schema), target)
    was = {r["id"]: r["subset"] for r in t.rows().collect()}
    assert sorted(was.values()) == ["a", "a", "b", "b"]
    first = t.version()
    x = dict(zip((1, 2, 3, 4), (0.0, 100.0, 500.0, 900.0)))
    one = next(i for i in was if was[i] != was[1])
    # a row beside 1 alone joins it; a bridge of rows from 1 to one of the other subset is a conflict
    t.grow(spark.createDataFrame([(10, 30.0, 0.0, 1)], schema), target)
    now = {r["id"]: (r["component"], r["subset"], r["linked"]) for r in t.rows().collect()}
    assert now[10] == now[1] == (1, was[1], True) and all(now[i][1] == was[i] for i in was)
    bridge = [(20 + i, v, 0.0, 1) for i, v in enumerate(np.arange(min(x[1], x[one]) + 30, max(x[1], x[one]), 30.0).tolist())]
    after = {r["id"]: r["subset"] for r in t.grow(spark.createDataFrame(bridge, schema), target).rows().collect()}
    assert after[1] == after[one] == after[20] == grouping.QUARANTINE
    # an older version still reads as it was, and a version cannot be written twice
    assert {r["id"]: r["subset"] for r in t.rows(first).collect()} == was
    with pytest.raises(Exception):
        create(spark, f"{t.location}/version-000000001.json", "{}")
    # a smaller id takes over the name, through earlier changes too
    renamed = {r["id"]: r["component"] for r in t.grow(spark.createDataFrame([(0, -30.0, 0.0, 1)], schema), target).rows().collect()}
    assert renamed[1] == renamed[10] == renamed[20] == 0
    empty = table(spark).grow(spark.createDataFrame([], schema), target)
    assert empty.rows().count() == 0 and empty.grow(spark.createDataFrame([(7, 0.0, 0.0, 1)], schema), target).rows().count() == 1
    assert table(spark).rows().count() == 0


def test_shares_of_new_components(spark):
    d = spark.range(4000).select("id", (F.col("id") * 1000.0).alias("x"), F.lit(0.0).alias("y"), F.lit(1).alias("kind"))
    got = {r["subset"]: r["count"] / 4000 for r in table(spark).grow(d, TARGETS).rows().groupBy("subset").count().collect()}
    assert got == pytest.approx(TARGETS, abs=0.005)


# 3: values


def test_value_matching(spark):
    ref = load(spark, S1, "feature_ref")
    want = {
        "beaver_flood": 3, "Beaver Flood": 3, "  38) beaverFlood - check": 3, "FLOOD/BEAVER": 3, "Nеgаtivе": 1, "m&auml;rk%C3%A4 mets%E4 ": 2, "metsä märkä": 2, "BÃ¤verkanal": 11, "ｂａｎｋ＿ｄｅｎｎ": 9, "log﻿_jam #47": 60,
        "snsr_strip no 36": 48, "lodgeen": 6, "damt": 5, "no beaver": 1, "okänd": 4, "unknonw": 4, "majavanpesa": 6,
        "berry bed 64 km": 0, "26.2.2021": 0, "684111 7286042": 0, "hgexb": 0, "?": 0, "moose of tent": 0, "x" * 5000: 0,
    }
    want["m&auml;rk%C3%A4 mets%E4 "] = 2
    # what teaches that "check" is a remark
    want |= {"log_jam check": 60, "dam - check": 5}
    d = spark.createDataFrame([(v,) for v in [*want, *want, None, "", " \t", " "]], "value string")
    got = [tuple(r) for r in matching.match_values(d, ref).collect()]
    assert len(got) == len(want)
    assert {k: v for k, v in got if want[k] != v} == {}
    assert matching.match_values(d.limit(0), ref).count() == 0
    assert {r["ref_id"] for r in matching.match_values(d, ref.limit(0)).collect()} == {0}


def test_ambiguous_values_stand_for_none(spark):
    ref = spark.createDataFrame([(1, "abcdefgh", None), (2, "abcdefgi", ["other"]), (3, None, None)], "ref_id int, name string, aliases array<string>")
    d = spark.createDataFrame([("abcdefgx",), ("abcdefgh",), ("othr",)], "value string")
    assert {r["value"]: r["ref_id"] for r in matching.match_values(d, ref).collect()} == {"abcdefgx": 0, "abcdefgh": 1, "othr": 2}


def test_remarks_are_learnt_from_the_values(spark):
    """Words beside two terms written out in full are a remark; a name, or words beside one term, are none."""
    ref = spark.createDataFrame([(1, "open_bog", None), (2, "log_jam", None), (3, "seen", None)], "ref_id int, name string, aliases array<string>")
    d = spark.createDataFrame([(v,) for v in ("open bog seen", "log jam, SEEN", "open bog / sure", "log jam sure", "opne bog - sure", "very old open bog", "sure")], "value string")
    assert {r["value"]: r["ref_id"] for r in matching.match_values(d, ref).collect()} == {"open bog seen": 0, "log jam, SEEN": 0, "open bog / sure": 1, "log jam sure": 2, "opne bog - sure": 1, "very old open bog": 0, "sure": 0}


def test_hot_values_are_dealt(spark):
    rows = spark.createDataFrame([(i, ["a", "b", None, "c"][i % 4]) for i in range(100)], "id long, t string")
    m = spark.createDataFrame([("a", 1), ("b", 0)], "value string, ref_id int")
    plain = sorted(map(str, matching.with_meaning(rows, "t", m, "id").select("id", "t", "ref_id").collect()))
    assert sorted(map(str, matching.with_meaning(rows, "t", m, "id", hot=10).select("id", "t", "ref_id").collect())) == plain and len(plain) == 100


@settings(max_examples=100, deadline=None)
@given(st.text("abc", max_size=7), st.text("abc", max_size=7))
def test_edits(a, b):
    d = [[max(i, j) if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    assert values.edits(a, b) == d[-1][-1]


# 6: packing


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 50), max_size=80))
def test_best_two_fit(sizes):
    s = np.array(sizes, np.int64)
    of, room = packing.best_two_fit(s, 50)
    assert len(of) == len(s) and (room >= 0).all()
    for b in range(len(room)):
        assert s[of == b].sum() == 50 - room[b] and (of == b).any()


def test_best_two_fit_replaces_the_smallest():
    # greedily 60 + 30 leaves 10; 21 + 19 fill the gap of 40 that the 30 leaves
    of, room = packing.best_two_fit(np.array([60, 30, 21, 19]), 100)
    assert sorted(room.tolist()) == [0, 70]


def test_pack_texts(spark):
    rows = [(1, 10), (2, 25), (3, 10), (4, 0), (5, None), (6, 4), (7, 3), (8, 20)]
    d = spark.createDataFrame(rows, "doc_id long, n_tokens long").withColumn("container", F.lit("x"))
    got = packing.pack_texts(d, 10).collect()
    assert sorted((r["doc_id"], r["piece"], r["n_tokens"]) for r in got) == [(1, 1, 10), (2, 1, 10), (2, 2, 10), (2, 3, 5), (3, 1, 10), (4, 1, 0), (6, 1, 4), (7, 1, 3), (8, 1, 10), (8, 2, 10)]
    fill = {}
    for r in got:
        fill[r["container"]] = fill.get(r["container"], 0) + r["n_tokens"]
    assert max(fill.values()) == 10 and len(fill) == 8
    assert packing.pack_texts(d.limit(0), 10).count() == 0


def test_packing_whole_documents(spark):
    sizes = tokens.sized(load(spark, S1, "documents")).cache()
    got = packing.pack_texts(sizes, 512).toPandas()
    total = sizes.agg(F.sum("n_tokens"), F.count("*")).first()
    assert got["n_tokens"].sum() == total[0] and got["doc_id"].nunique() == total[1] and not got.duplicated(["doc_id", "piece"]).any()
    fill = got.groupby("container")["n_tokens"].sum()
    assert fill.max() <= 512 and total[0] / (512 * len(fill)) > 0.97


def test_token_counts(spark):
    texts = ["", "a b", None, "word " * 20_000, "ä" * 3000, "<|endoftext|>"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    enc = tokens.tokenizer()
    got = {r["doc_id"]: r["n_tokens"] for r in tokens.sized(d).collect()}
    assert got == {i: len(enc.encode_ordinary(t)) for i, t in enumerate(texts) if t is not None}
    assert all(enc.decode(enc.encode_ordinary(t)) == t for t in texts if t)


# 7: mixing


def test_mix_meets_its_shares(spark):
    rng = random.Random(0)
    rows = [(i, "abc"[min(2, rng.randrange(6))], rng.randrange(1, 200)) for i in range(6000)] + [(9000, None, 5), (9001, "a", 0)]
    d = spark.createDataFrame(rows, "doc_id long, source string, n_tokens long")
    t = spark.createDataFrame([(1, "a", 0.5, 2), (1, "b", 0.3, 3), (1, "c", 0.2, 1), (2, "a", 0.9, 1), (2, "gone", 0.1, 4), (3, "c", 0.0, 1)], "mix_id int, source string, target_share double, max_repeat int")
    chosen = mixing.mix(d, t)
    got = {(r["mix_id"], r["source"]): r for r in mixing.shares(chosen, t).collect()}
    for s, share in (("a", 0.5), ("b", 0.3), ("c", 0.2)):
        r = got[1, s]
        assert r["share"] == pytest.approx(share, abs=0.001) and r["most_copies"] <= r["max_repeat"]
    assert got[2, "a"]["share"] == 1.0 and got[2, "gone"]["n_texts"] == 0 and got[3, "c"]["share"] == 0.0
    assert chosen.groupBy("mix_id", "doc_id").count().filter("count > 1").isEmpty()
    # the largest mix that meets all shares: a source repeated as often as allowed
    tokens_of = {s: sum(n for _, k, n in rows if k == s) for s in "abc"}
    size = min(2 * tokens_of["a"] / 0.5, 3 * tokens_of["b"] / 0.3, tokens_of["c"] / 0.2, sum(tokens_of.values()))
    assert sum(got[1, s]["n_tokens"] for s in "abc") == pytest.approx(size, rel=0.002)
    big = {r["source"]: r for r in mixing.shares(mixing.mix(d, t.filter("mix_id = 1"), total=100 * size), t.filter("mix_id = 1")).collect()}
    assert {s: big[s]["n_tokens"] / tokens_of[s] for s in "abc"} == pytest.approx({"a": 2, "b": 3, "c": 1})
    assert mixing.mix(d.limit(0), t).count() == 0


def test_newton_solves_the_dual(spark):
    h = spark.createDataFrame([("a", 10, 50), ("a", 400, 3), ("b", 7, 9)], "source string, n_tokens long, n long")
    cells = {(1, "a"): {"cap": 3.0, "tokens": 1700, "mean": 1700 / 53, "target": 900.0}, (2, "a"): {"cap": 3.0, "tokens": 1700, "mean": 1700 / 53, "target": 5000.0}, (1, "b"): {"cap": 2.0, "tokens": 63, "mean": 7.0, "target": 126.0}}
    lam = mixing._solve(h, cells)
    for k, rows in (((1, "a"), ((10, 50), (400, 3))), ((2, "a"), ((10, 50), (400, 3)))):
        got = sum(n * t * min(3.0, np.exp(lam[k] * t / (1700 / 53))) for t, n in rows)
        assert got == pytest.approx(cells[k]["target"], rel=1e-6)
    assert lam[1, "b"] == float("inf")


def test_small_sources_get_their_share(spark):
    """Sources of three texts: what is reached is within one text of the target, whatever the hash does."""
    rows = [(i, f"s{i // 3}", 40 + 17 * (i % 3)) for i in range(60)] + [(100 + i, "big", 100 + i % 50) for i in range(400)]
    d = spark.createDataFrame(rows, "doc_id long, source string, n_tokens long")
    t = spark.createDataFrame([(1, f"s{k}", 0.02, 3) for k in range(20)] + [(1, "big", 0.6, 2)], "mix_id int, source string, target_share double, max_repeat int")
    got = mixing.shares(mixing.mix(d, t, total=10_000), t).collect()
    assert len(got) == 21
    for r in got:
        assert abs(r["n_tokens"] - 10_000 * r["target_share"]) <= (74 if r["source"] != "big" else 150), r
        assert r["error"] == pytest.approx(r["share"] - r["target_share"]) and r["most_copies"] <= r["max_repeat"]


# 8: shared spans


def brute(rows, span=200):
    win: dict = {}
    for k, x in rows.items():
        for i in range(len(x) - span + 1):
            win.setdefault(x[i : i + span], set()).add(k)
    pairs = {(a, b) for v in win.values() if len(v) > 1 for a in v for b in v if a < b}
    cover = {}
    for k, x in rows.items():
        c = bytearray(len(x))
        for i in range(len(x) - span + 1):
            if len(win[x[i : i + span]]) > 1:
                c[i : i + span] = b"\1" * span
        cover[k] = sum(c)
    return pairs, cover


def texts():
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abcdefghij äö\n") for _ in range(n))
    a, b, c = word(200), word(199), word(450)
    rows = {1: word(50) + a + word(90), 2: a, 3: word(300) + a, 4: word(80) + b + word(80), 5: b + word(200), 6: c, 7: word(30) + c[100:320] + word(20) + c[:210], 8: "", 9: word(5), 10: c, 11: c, 12: "x" * 900, 13: word(40) + "x" * 230 + word(40), 14: "ab" * 150, 15: "ba" * 140 + word(90), 16: word(9000) + a[:199] + "𝄞", 17: "𝄞" * 210 + word(10), 18: "𝄞" * 205}
    return rows


@pytest.mark.parametrize("hot", [200, 1])
def test_shared_spans_against_brute_force(spark, hot):
    rows = texts()
    d = spark.createDataFrame([(k, v, 1) for k, v in rows.items()] + [(99, None, 1), (98, None, 2)], "doc_id long, text string, rep int")
    want, cover = brute(rows)
    s = spans.Shared(d, hot=hot)
    got = [tuple(r) for r in s.pairs().collect()]
    assert len(got) == len(set(got)) and set(got) == want
    per: dict = {}
    for r in s.stretches().collect():
        per[r["doc"]] = per.get(r["doc"], 0) + r["end"] - r["start"]
    assert {k: per.get(k, 0) for k in rows} == cover
    links: dict = {k: 0 for k in rows}
    for pair in want:
        for k in pair:
            links[k] += 1
    linked = {r["doc"]: r for r in s.linked().collect()}
    assert {k: linked[k]["links"] if k in linked else 0 for k in rows} == links and linked[10]["rep"] == 6
    assert set(linked) == {k for k, v in rows.items() if len(v) >= 200}


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.text("ab", min_size=1, max_size=20), st.integers(-1, 2)), min_size=1, max_size=6), st.integers(1, 3))
def test_greedy_factors_against_brute_force(segments, times):
    """Each factor is the longest stretch from its start that stands in another owner's segment."""
    segs, owner = [s * times for s, _ in segments], np.array([o for _, o in segments])
    index = spans.Index([spans._codes(s) for s in segs])
    longest = index.longest(owner)
    want = {}
    for i, x in enumerate(segs):
        others = [y for j, y in enumerate(segs) if j != i and owner[j] != owner[i]]
        for p in range(len(x)):
            n = len(x) - p
            while owner[i] >= 0 and n and not any(x[p : p + n] in y for y in others):
                n -= 1
            want[index.start[i] + p] = n
    assert {k: longest[k] for k in want} == want
    f, e, nxt = index.factors(longest)
    assert all(b - a == max(1, want[a]) for a, b in zip(f, e))
    assert sorted(f) == f.tolist() and sum(e - f) == sum(map(len, segs))
    assert all(n == (b if b in index.end else e[k + 1]) for k, (b, n) in enumerate(zip(e, nxt)))


@pytest.mark.parametrize("hot", [5, 500])
def test_shared_spans_of_many_copies_and_quotes(spark, hot):
    """A third of the texts are copies, another third quote one passage; keys are cut into parts."""
    rng = random.Random(1)
    word = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    copy, quote = word(400), word(230)
    rows = {i: copy if i % 3 == 0 else word(rng.randrange(150)) + quote + word(rng.randrange(150)) if i % 3 == 1 else word(300) for i in range(90)}
    d = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    was, spans.PART = spans.PART, 7
    try:
        got = [tuple(r) for r in spans.Shared(d, hot=hot).pairs().collect()]
    finally:
        spans.PART = was
    assert len(got) == len(set(got)) and set(got) == brute(rows)[0]
    assert spans.Shared(d.limit(0)).pairs().count() == 0


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**32), st.integers(1, 3))
def test_two_texts_that_share_a_span_share_an_anchor(seed, letters):
    rng = np.random.default_rng(seed)
    draw = lambda n: rng.integers(97, 97 + letters + 1, n).astype(np.uint32)
    s = draw(40)
    a, b = np.concatenate([draw(rng.integers(60)), s, draw(rng.integers(60))]), np.concatenate([draw(rng.integers(60)), s, draw(rng.integers(60))])
    assert set(spans.anchors(a, 40, 20)[1]) & set(spans.anchors(b, 40, 20)[1])


def test_window_hashes():
    rng = np.random.default_rng(0)
    c = rng.integers(0, 0x110000, 300).astype(np.uint32)
    c[150:200] = c[20:70]
    h = spans.window_hashes(c, 50)
    assert h[150] == h[20] and len(set(h.tolist())) == 250


# all queries run


def test_queries_run(spark):
    import importlib

    from wetlens import llm

    for m in llm.MODULES:
        for name, q in importlib.import_module(f"wetlens.llm.{m}").QUERIES.items():
            assert q(spark, S1).count() > 0, name


def test_p3_classifies_known_names_of_the_table(spark):
    got = matching.p3_found(spark, S1)
    m = load(spark, S1, "manifest")
    odd = m.join(got, "row_idx", "left_anti").select("feature_type").distinct().collect()
    names = {r["name"] for r in load(spark, S1, "feature_ref").collect()}
    assert all(r[0] is None or not r[0].strip() or r[0] in names for r in odd)
