"""Near pairs, containment, components, packing and compaction against brute force."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wetlens.functions.paths import canonical, canonical_path
from wetlens.operators import dualtree
from wetlens.operators import binpack, compaction, graph, near, skew
from wetlens.operators.binpack import packed
from wetlens.operators.compaction import compact, consolidated, first_fit_decreasing, one_per_file, pack
from wetlens.operators.graph import connected
from wetlens.operators.near import containing, near_pairs
from wetlens.session import shared_dir, written


def close(x, y, r):
    d = (x[:, None] - x) ** 2 + (y[:, None] - y) ** 2 <= r * r
    return {(i, j) for i, j in zip(*np.nonzero(d)) if i < j}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 40), st.integers(0, 40)), max_size=60), st.integers(0, 50))
def test_dual_tree_pairs_and_links(points, r):
    x, y = (np.array([p[i] for p in points], float) for i in (0, 1))
    got = [(min(a, b), max(a, b)) for i, j in dualtree.pairs(x, y, float(r)) for a, b in zip(i, j)]
    want = close(x, y, r)
    assert len(got) == len(set(got)) and set(got) == want
    label = dualtree.components(len(x), dualtree.links(x, y, float(r)))
    root = np.arange(len(x))
    for _ in range(len(x)):
        for a, b in want:
            root[a] = root[b] = min(root[a], root[b])
    assert (label == root).all()


def test_dual_tree_across_sets():
    rng = np.random.default_rng(0)
    x, y, u, v = (rng.uniform(0, 100, n) for n in (400, 400, 70, 70))
    got = {(a, b) for i, j in dualtree.pairs(x, y, 9.0, u, v) for a, b in zip(i, j)}
    assert got == set(zip(*np.nonzero((x[:, None] - u) ** 2 + (y[:, None] - v) ** 2 <= 81)))


@pytest.mark.parametrize("cap", [20_000, 40])
def test_near_pairs_with_hot_spots(spark, cap):
    """A third of the rows in one spot, some at one point; a small cap splits nodes at every level and into blocks."""
    rng = np.random.default_rng(5)
    x, y = rng.uniform(0, 9000, 600), rng.uniform(-3000, 9000, 600)
    x[:200], y[:200] = 4096 + rng.uniform(-20, 20, 200), 4096 + rng.uniform(-20, 20, 200)
    x[:60], y[:60] = 4096.0, 4096.0
    rows = [(int(i), float(a), float(b), "c") for i, (a, b) in enumerate(zip(x, y))]
    d = spark.createDataFrame(rows, "key long, east double, north double, leaf string")
    got = [tuple(r) for r in near_pairs(d, 30.0, "key", "east", "north", cap=cap).collect()]
    assert len(got) == len(set(got)) and set(got) == close(x, y, 30.0)


def test_no_search_task_exceeds_its_bound(spark):
    """A crowded spot is dealt to pairs of leaves, none with more than cap core and cap foreign points."""
    cap = 1000
    d = spark.range(12_000).select("id", (F.rand(1) * 5 + 328000).alias("x"), (F.rand(2) * 5 + 6821000).alias("y"))
    one_place = spark.range(12_000, 18_000).select("id", F.lit(328002.0).alias("x"), F.lit(6821002.0).alias("y"))
    tasks = near.dealt(d.unionByName(one_place), 30.0, cap=cap).groupBy("owner", "oblk", "part").agg(F.count("*").alias("n"), F.count_if("core").alias("c")).collect()
    assert max(r["c"] for r in tasks) <= cap and max(r["n"] for r in tasks) <= 2 * cap
    # every pair of points meets once: core with core in part 0, core with foreign in any part
    assert sum((r["c"] * (r["c"] - 1) // 2 if r["part"] == 0 else 0) + r["c"] * (r["n"] - r["c"]) for r in tasks) == 18_000 * 17_999 // 2


def test_near_pairs_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    t = "id long, x double, y double"
    d = spark.createDataFrame([(1, 0.0, 0.0), (2, 30.0, 0.0), (3, None, 0.0), (4, nan, 0.0), (5, inf, 0.0), (6, 0.0, None), (None, 0.0, 0.0), (7, 60.001, 0.0)], t)
    assert [tuple(r) for r in near_pairs(d, 30.0).collect()] == [(1, 2)]
    assert near_pairs(d.limit(0), 30.0).count() == 0
    assert near_pairs(d, 10_000.0).count() == 3  # a radius above the largest node


def test_containing(spark):
    d = spark.createDataFrame([(1, 5.0, 5.0), (2, 10.0, 5.0), (3, 0.0, 0.0), (4, None, 1.0), (5, float("nan"), 1.0), (6, 99999.0, 5.0)], "id long, x double, y double")
    t = "region string, x0 double, y0 double, x1 double, y1 double"
    r = spark.createDataFrame([("b", 0.0, 0.0, 10.0, 10.0), ("a", 4.0, 4.0, 6.0, 6.0), ("a", 4.0, 4.0, 6.0, 6.0), ("c", 10.0, 0.0, 20000.0, 10.0), ("n", None, 0.0, 1.0, 1.0)], t)
    assert {x["id"]: x["region"] for x in containing(d, r).collect()} == {1: "a", 2: "c", 3: "b", 4: None, 5: None, 6: None}
    assert {x["region"] for x in containing(d, r.limit(0)).collect()} == {None}


def test_components_of_graphs(spark):
    rng = np.random.default_rng(2)
    chain = [(i, i + 1) for i in range(300)]
    rand = [tuple(map(int, e)) for e in rng.integers(1000, 1300, (200, 2))]
    edges = chain + rand + [(5, 5), (None, 3), (7, None), (2000, 2000)]
    d = spark.createDataFrame(edges, "u long, v long")
    got = {r["node"]: r["root"] for r in connected(d).collect()}
    assert {r["node"]: r["root"] for r in connected(d, small=10).collect()} == got
    root = {}
    for a, b in edges:
        if a is not None and b is not None:
            root.setdefault(a, a), root.setdefault(b, b)
    moved = True
    while moved:
        moved = False
        for a, b in edges:
            if a is not None and b is not None and root[a] != root[b]:
                root[a] = root[b] = min(root[a], root[b])
                moved = True
    assert got == root
    assert connected(spark.createDataFrame([], "u long, v long")).count() == 0


def test_hot_keys_are_dealt(spark, monkeypatch):
    left = spark.createDataFrame([(i, None if i % 7 == 0 else "a" if i % 3 else f"k{i}") for i in range(200)], "id long, k string")
    right = spark.createDataFrame([("a", 1), ("k3", 2), ("zz", 3)], "k string, v int")
    hot = left.filter("k is not null").groupBy("k").count().filter("count > 10")
    for how in ("left", "inner"):
        want = sorted(map(str, left.join(right, ["k"], how).select("id", "k", "v").collect()))
        assert sorted(map(str, skew.join_hot(left, right, ["k"], hot, "id", how, 10).select("id", "k", "v").collect())) == want
    chain = spark.createDataFrame([(0, i) for i in range(1, 60)] + [(i, i + 100) for i in range(60)], "u long, v long")
    monkeypatch.setattr(graph, "HOT", 10)
    assert {r["root"] for r in connected(chain, small=5).collect()} == {0}


def test_paths(spark):
    want = "data/chips/länsi-008/k1_neg_0001.npy"
    ways = [
        "data/chips/länsi-008/K1_neg_0001.npy", "DATA\\CHIPS\\LÄNSI-008\\K1_NEG_0001.NPY", "./data//chips/./länsi-008/K1_neg_0001.npy", "data/chips/tmp/../länsi-008/K1_neg_0001.npy",
        "data/chips/tmp/../../chips/länsi-008/K1_neg_0001.npy", '"data/chips/länsi-008/K1_neg_0001.npy"\r', " /srv/x/data/chips/la\u0308nsi-008/K1_neg_0001.npy", "file:///srv/x/data/chips/l%C3%A4nsi%2D008/K1%5Fneg_0001.npy",
        "C:\\x\\data/chips/länsi-008/K1_neg_0001.npy", "data/chips/länsi-008/K1_neg_0001.npy\r", "../data/chips/länsi-008/K1_neg_0001.npy",
    ]
    other = ["data/chips/länsi-009/K1_neg_0001.npy", "chips/länsi-008/K1_neg_0001.npy", "x/data/chips/länsi-008/K1_neg_0001.npy", "data/chips/länsi-008/K1_neg_0001.npy.part", "", " ", None]
    d = spark.createDataFrame([(p,) for p in ways + other], "p string")
    got = [r[0] for r in d.select(canonical_path(F.col("p"))).collect()]
    assert got[: len(ways)] == [want] * len(ways)
    assert want not in got[len(ways) :] and got[-3:] == ["", "", None]
    assert got == [canonical(p) for p in ways + other]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 120), max_size=60))
def test_first_fit_decreasing(sizes):
    s = np.array(sizes, np.int64)
    of, room = first_fit_decreasing(s, 100)
    bins: list[int] = []
    for v in sorted(sizes, reverse=True):
        b = next((i for i, r in enumerate(bins) if r >= v), None)
        if b is None:
            bins.append(100)
            b = len(bins) - 1
        bins[b] -= v
    assert len(bins) == len(room) and sorted(bins) == sorted(room.tolist())
    for b in range(len(room)):
        assert s[of == b].sum() == 100 - room[b] and (room[b] >= 0 or (of == b).sum() == 1)


def test_packing_in_rounds(spark):
    rng = np.random.default_rng(0)
    sizes = rng.integers(1, 60, 2000)
    d = spark.createDataFrame([(i, int(v)) for i, v in enumerate(sizes)] + [(9000, 500), (9001, 0), (9002, None)], "id long, size long")
    got = packed(d, 100, first_fit_decreasing, 20, 300).toPandas()
    assert sorted(got["id"]) == [*range(2000), 9000, 9001, 9002]
    per = got.groupby("bin")["size"].agg(["sum", "count"])
    assert ((per["sum"] <= 100) | (per["count"] == 1)).all()
    assert len(per) <= sizes.sum() / 100 * 1.03 + 2
    assert pack(d.limit(0)).count() == 0


def test_no_packing_task_exceeds_its_bound(spark, monkeypatch):
    """Items of which no two fit one bin, ten times what a task may hold: they stay as they are after a turn."""
    turns = []
    turn = binpack._turn
    monkeypatch.setattr(binpack, "_turn", lambda *a: turns.append(a[3]) or turn(*a))
    d = spark.range(4000).select("id", F.lit(60).alias("size"))
    got = packed(d, 100, first_fit_decreasing, 10_000, 400)
    assert got.count() == got.select("bin").distinct().count() == 4000 and len(turns) == 1
    dealt = d.groupBy(F.pmod(F.xxhash64("id", F.lit(0)), F.lit(turns[0]))).count()
    assert dealt.agg(F.max("count")).first()[0] <= 400


def test_one_row_per_file(spark):
    import datetime as dt

    t = [dt.datetime(2020, 1, i) for i in range(1, 5)]
    rows = [(1, "a/x.npy", 5, t[1]), (2, "A\\X.NPY", 7, t[2]), (3, "a/x.npy", 7, t[1]), (4, "a/./x.npy", 7, t[1]), (5, "b/x.npy", 0, t[0]), (6, "b/x.npy", None, t[0]), (7, "b/x.png", 9, t[0]), (8, None, 9, t[0]), (9, "c.npy", 1, None), (10, "c.npy", 1, t[3])]
    d = spark.createDataFrame(rows, "file_id long, path string, n_bytes long, written_at timestamp")
    assert {r["file_id"] for r in one_per_file(d.withColumn("best", F.lit(1))).collect()} == {3, 10}
    assert one_per_file(d.limit(0)).count() == 0


def test_compaction(spark, tmp_path):
    rng = np.random.default_rng(0)
    want = {}
    for i in range(30):
        p = tmp_path / f"in/{i % 4}/f{i}.npy"
        p.parent.mkdir(parents=True, exist_ok=True)
        want[p.name] = rng.bytes(int(rng.integers(1, 3000)))
        p.write_bytes(want[p.name])
    (tmp_path / "in/skip.txt").write_text("x")
    report = compact(spark, str(tmp_path / "in"), str(tmp_path / "out"), 8000)
    assert report.agg(F.sum("files")).first()[0] == 30 and report.agg(F.max("bytes")).first()[0] <= 8000
    back = consolidated(spark, str(tmp_path / "out"))
    assert {r["path"].rpartition("/")[2]: bytes(r["content"]) for r in back.collect()} == want
    with pytest.raises(Exception):
        compact(spark, str(tmp_path / "in"), str(tmp_path / "out"), 8000)
    assert len(list(tmp_path.glob("out/run-*"))) == 1 and consolidated(spark, str(tmp_path / "out")).count() == 30


def test_compaction_notices_swapped_contents(spark, tmp_path, monkeypatch):
    """Two files of one bin that swap contents leave number and bytes as they are."""
    for n in "ab":
        (tmp_path / f"in/{n}.npy").parent.mkdir(exist_ok=True)
        (tmp_path / f"in/{n}.npy").write_bytes(n.encode() * 50)
    rows = compaction._rows

    def swapped(spark, folder):
        r = rows(spark, folder)
        return r.withColumn("content", F.when(F.col("path").endswith("a.npy"), F.lit(b"b" * 50)).otherwise(F.lit(b"a" * 50)))

    monkeypatch.setattr(compaction, "_rows", swapped)
    with pytest.raises(ValueError):
        compact(spark, str(tmp_path / "in"), str(tmp_path / "out"), 8000)
    assert not list(tmp_path.glob("out/*"))


def test_written_tables_live_in_the_shared_folder(spark):
    d = written(spark.range(3), "t")
    assert d.count() == 3 and shared_dir(spark) in d.inputFiles()[0]
    assert written(spark.range(0), "t").count() == 0
