"""Mixing sources to target weights by entropy balancing."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wetlens.llm.tokens import sized
from wetlens.session import load, written

#: Newton stops when every constraint holds to this share of its target.
TOLERANCE = 1e-7
#: Rounds after which a cell that has not converged is an error; each halves a bracket at least.
ROUNDS = 500
#: Classes of the rounding's correction; two passes tell apart a millionth of a copy.
CLASSES = 1024
#: Documents per cell that make up what is still missing after that.
LAST = 4
_EMPTY = -745.0


def _solve(histogram: DataFrame, cells: dict) -> dict:
    """lambda of each (mix, source) so that the tilted tokens meet the target.

    The dual of entropy balancing is convex, with one unknown per cell, and rates
    are min(cap, exp(lambda * u)), u being tokens over the source's mean.  Each round is
    one distributed aggregate of gradient and curvature of all cells over the table of
    (source, n_tokens, n); the steps are safeguarded by brackets.  ``cells``: one
    dict per cell, as many as the mix table has rows.
    """
    spark = histogram.sparkSession
    state = {k: {"l": 0.0, "lo": None, "hi": None} for k in cells}
    open_ = {k for k, c in cells.items() if c["target"] < c["cap"] * c["tokens"] * (1 - 1e-12)}
    for k in cells:
        if k not in open_:
            state[k]["l"] = math.inf
    for _ in range(ROUNDS):
        if not open_:
            break
        rows = [(m, s, state[m, s]["l"], math.log(cells[m, s]["cap"]), cells[m, s]["mean"]) for m, s in sorted(open_)]
        now = spark.createDataFrame(rows, "mix_id int, source string, lam double, top double, mean double")
        u, v = F.col("n_tokens") / F.col("mean"), F.col("lam") * F.col("n_tokens") / F.col("mean")
        w = F.exp(F.greatest(F.lit(_EMPTY), F.least(v, F.col("top"))))
        got = histogram.join(F.broadcast(now), "source").groupBy("mix_id", "source").agg(F.sum(F.col("n") * w * F.col("n_tokens")).alias("g"), F.sum(F.when(v < F.col("top"), F.col("n") * w * F.col("n_tokens") * u)).alias("h")).collect()
        for r in got:
            k = (r["mix_id"], r["source"])
            c, st = cells[k], state[k]
            miss = c["target"] - r["g"]
            if abs(miss) <= TOLERANCE * c["target"]:
                open_.discard(k)
                continue
            st["lo" if miss > 0 else "hi"] = st["l"]
            step = st["l"] + miss / r["h"] if r["h"] else None
            lo, hi = st["lo"], st["hi"]
            if step is None or (lo is not None and step <= lo) or (hi is not None and step >= hi):
                step = (lo + hi) / 2 if lo is not None and hi is not None else (2 * lo + 1 if hi is None else 2 * hi - 1)
            st["l"] = max(-1e6, min(1e6, step))
            if lo is not None and hi is not None and hi - lo < 1e-13 * max(1.0, abs(lo)):
                open_.discard(k)
    if open_:
        raise RuntimeError(f"no rates found for {sorted(open_)}")
    return {k: st["l"] for k, st in state.items()}


def _cells(tokens: dict, mixes: list, total: int | None) -> dict:
    """Target tokens per (mix, source) that is there.

    Shares are taken among the sources present.  Without ``total`` the mix is as large as
    all its shares can be met within the caps, but no larger than the corpus.  With it,
    sources too small for their share of ``total`` are repeated up to their cap.
    """
    out: dict = {}
    for mix in sorted({m["mix_id"] for m in mixes}):
        rows = [m for m in mixes if m["mix_id"] == mix and tokens.get(m["source"], (0, 0))[0] > 0 and (m["target_share"] or 0) > 0 and (m["max_repeat"] or 0) > 0]
        share = sum(m["target_share"] for m in rows)
        size = total or min([m["max_repeat"] * tokens[m["source"]][0] * share / m["target_share"] for m in rows] + [sum(t for t, _ in tokens.values())])
        for m in rows:
            t, n = tokens[m["source"]]
            out[mix, m["source"]] = {"cap": float(m["max_repeat"]), "tokens": t, "mean": t / n, "target": min(size * m["target_share"] / share, m["max_repeat"] * t)}
    return out


def _shift(docs: DataFrame, cells: dict) -> dict:
    """Per cell a sign, a bound and the tokens still missing: documents nearest to their next copy, up to the bound, get or lose one.

    ``docs`` has mix_id, source, n_tokens, copies, x (rate plus hash) and cap.  Sums by
    class of distance reach the driver, a fixed number per cell, never documents.
    """
    spark = docs.sparkSession
    now = {(r["mix_id"], r["source"]): r["t"] for r in docs.groupBy("mix_id", "source").agg(F.sum(F.col("copies") * F.col("n_tokens")).alias("t")).collect()}
    miss = {k: c["target"] - now.get(k, 0) for k, c in cells.items()}
    way = {k: 1 if d > 0 else -1 for k, d in miss.items()}
    sign = spark.createDataFrame([(m, s, d) for (m, s), d in way.items()], "mix_id int, source string, sign int")
    near = docs.join(F.broadcast(sign), ["mix_id", "source"]).select("mix_id", "source", "n_tokens", distance(F.col("sign")).alias("v")).filter("v is not null")
    miss = {k: abs(d) for k, d in miss.items()}
    base, width = {k: 0.0 for k in cells}, 1.0
    for _ in range(2):
        rows = spark.createDataFrame([(m, s, b) for (m, s), b in base.items()], "mix_id int, source string, base double")
        cls = F.floor((F.col("v") - F.col("base")) / (width / CLASSES)).cast("int")
        sums = near.join(F.broadcast(rows), ["mix_id", "source"]).withColumn("c", cls).filter(F.col("c").between(0, CLASSES - 1)).groupBy("mix_id", "source", "c").agg(F.sum("n_tokens").alias("t")).collect()
        by: dict = {}
        for r in sums:
            by.setdefault((r["mix_id"], r["source"]), {})[r["c"]] = r["t"]
        for k in base:
            need, at = miss[k], 0
            for c in sorted(by.get(k, {})):
                t = by[k][c]
                # the first pass stops before the class that is too much, and the second one looks inside it
                if t > need:
                    at = c
                    break
                need, at = need - t, c + 1
                if need <= 0:
                    break
            miss[k] = max(need, 0.0)
            base[k] += at * width / CLASSES
        width /= CLASSES
    return {k: (way[k], b, miss[k]) for k, b in base.items()}


def _last(docs: DataFrame, shift: dict) -> list[tuple[int, int]]:
    """(mix_id, doc_id) of up to ``LAST`` documents per cell that take what is still missing best.

    In each turn every cell takes the one document, of those that may still move, whose size is
    nearest to the need, if that makes the need smaller; one row per cell reaches the driver.
    """
    spark = docs.sparkSession
    need = {k: n for k, (_, _, n) in shift.items() if n > 0}
    taken: list[tuple[int, int]] = []
    for _ in range(LAST):
        if not need:
            break
        rows = spark.createDataFrame([(m, s, shift[m, s][0], shift[m, s][1], float(n)) for (m, s), n in need.items()], "mix_id int, source string, sign int, bound double, need double")
        gone = spark.createDataFrame(taken, "mix_id int, doc_id long")
        miss = F.abs(F.col("n_tokens") - F.col("need"))
        free = docs.join(F.broadcast(rows), ["mix_id", "source"]).filter((distance(F.col("sign")) >= F.col("bound")) & (miss < F.col("need"))).join(F.broadcast(gone), ["mix_id", "doc_id"], "left_anti")
        got = free.groupBy("mix_id", "source").agg(F.min(F.struct(miss.alias("miss"), F.col("doc_id").alias("doc_id"), F.col("n_tokens").alias("t"))).alias("b")).collect()
        new = {}
        for r in got:
            k, b = (r["mix_id"], r["source"]), r["b"]
            taken.append((r["mix_id"], b["doc_id"]))
            if need[k] > b["t"]:
                new[k] = need[k] - b["t"]
        need = new
    return taken


def distance(sign):
    """How far x is from one more copy (sign 1), or from one less; NULL where the cap or zero forbids it."""
    up = F.when(F.col("copies") < F.col("cap"), F.ceil("x") - F.col("x"))
    down = F.when(F.col("copies") > 0, F.col("x") - F.floor("x"))
    return F.when(sign > 0, up).otherwise(down)


def mix(sizes: DataFrame, targets: DataFrame, total: int | None = None) -> DataFrame:
    """(mix_id, doc_id, source, n_tokens, copies) of the texts chosen for each mix.

    ``sizes``: doc_id, source, n_tokens; texts without tokens or source are not chosen.
    ``targets``: mix_id, source, target_share, max_repeat.  Sources that are absent,
    or have no share, get nothing, and the other shares are met among themselves.
    Rates minimise the relative entropy to one copy each under the token constraints,
    capped at max_repeat; they are rounded by a hash of mix and document, and the
    documents nearest to their next copy then make up what a source lacks or exceeds; the last few are chosen by size.
    """
    s = written(sizes.filter("n_tokens > 0 and source is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "source", "n_tokens"), "sizes")
    histogram = written(s.groupBy("source", "n_tokens").agg(F.count("*").alias("n")), "histogram")
    wanted = targets.select("source").distinct()
    per = histogram.join(F.broadcast(wanted), "source", "left_semi").groupBy("source").agg(F.sum(F.col("n") * F.col("n_tokens")).alias("t"), F.sum("n").alias("n")).collect()
    cells = _cells({r["source"]: (r["t"], r["n"]) for r in per}, [r.asDict() for r in targets.collect()], total)
    lam = _solve(histogram, cells)
    spark = sizes.sparkSession
    rows = [(m, s_, 1e300 if math.isinf(lam[m, s_]) else lam[m, s_], c["cap"], c["mean"]) for (m, s_), c in cells.items()]
    rates = spark.createDataFrame(rows, "mix_id int, source string, lam double, cap double, mean double")
    v = F.least(F.col("lam") * F.col("n_tokens") / F.col("mean"), F.log("cap"))
    rate = F.least("cap", F.exp(F.greatest(F.lit(_EMPTY), v)))
    rate = F.when(F.col("lam") >= 1e300, F.col("cap")).otherwise(rate)
    unit = F.pmod(F.xxhash64("mix_id", "doc_id"), F.lit(2**31)) / F.lit(2.0**31)
    docs = s.join(F.broadcast(rates), "source").withColumn("x", rate + unit).withColumn("copies", F.least(F.col("cap"), F.floor("x")).cast("int"))
    docs = written(docs.select("mix_id", "doc_id", "source", "n_tokens", "cap", "x", "copies"), "rates")
    shift = _shift(docs, cells)
    moves = spark.createDataFrame([(m, s_, g, b) for (m, s_), (g, b, _) in shift.items()], "mix_id int, source string, sign int, bound double")
    last = spark.createDataFrame(_last(docs, shift), "mix_id int, doc_id long").withColumn("last", F.lit(True))
    d = docs.join(F.broadcast(moves), ["mix_id", "source"]).join(F.broadcast(last), ["mix_id", "doc_id"], "left")
    moved = F.col("copies") + F.when(F.coalesce(distance(F.col("sign")) < F.col("bound"), F.lit(False)) | F.col("last").isNotNull(), F.col("sign")).otherwise(F.lit(0))
    return d.select("mix_id", "doc_id", "source", "n_tokens", moved.alias("copies")).filter("copies > 0")


def shares(chosen: DataFrame, targets: DataFrame) -> DataFrame:
    """What was reached per mix and source: target_share, share, error, n_texts, n_tokens, mix_tokens, most_copies, max_repeat.

    ``error`` is share less target_share, ``mix_tokens`` the size of the mix.
    """
    got = chosen.groupBy("mix_id", "source").agg(F.count("*").alias("n_texts"), F.sum(F.col("copies") * F.col("n_tokens")).alias("n_tokens"), F.max("copies").alias("most_copies"))
    full = targets.join(got, ["mix_id", "source"], "left").fillna(0, ["n_texts", "n_tokens", "most_copies"])
    total = full.groupBy("mix_id").agg(F.sum("n_tokens").alias("mix_tokens"))
    share = F.when(F.col("mix_tokens") > 0, F.col("n_tokens") / F.col("mix_tokens")).otherwise(F.lit(0.0))
    return full.join(total, "mix_id").select("mix_id", "source", "target_share", share.alias("share"), (share - F.col("target_share")).alias("error"), "n_texts", "n_tokens", "mix_tokens", "most_copies", "max_repeat")


def _mixed(spark: SparkSession, sf_dir: str, whole: bool = False) -> DataFrame:
    """The mixes; ``whole``: as large as the corpus, with small sources repeated up to their cap."""
    sizes = written(sized(load(spark, sf_dir, "documents"), "source"), "tokens")
    total = sizes.agg(F.sum("n_tokens")).first()[0] if whole else None
    return mix(sizes, load(spark, sf_dir, "mix_target"), total)


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chosen texts with their copies, per mix."""
    return _mixed(spark, sf_dir)


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares reached per mix and source beside their targets."""
    return shares(_mixed(spark, sf_dir), load(spark, sf_dir, "mix_target"))


def p7_whole_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chosen texts with their copies, of mixes as large as the corpus."""
    return _mixed(spark, sf_dir, True)


def p7_whole_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares reached by mixes as large as the corpus; sources too small for theirs stand at their cap."""
    return shares(_mixed(spark, sf_dir, True), load(spark, sf_dir, "mix_target"))


def p7_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What holds of every mix: texts of the table, of their own source, chosen once, with one to max_repeat copies.

    ``n_bad`` counts the chosen rows of which it does not, 0 by construction.
    """
    d, t = load(spark, sf_dir, "documents"), load(spark, sf_dir, "mix_target")
    chosen = written(_mixed(spark, sf_dir), "mix")
    known = chosen.join(d.filter("text is not null and text != ''").select("doc_id", "source", F.lit(True).alias("known")), ["doc_id", "source"], "left").join(t, ["mix_id", "source"], "left")
    bad = ~F.coalesce(F.col("known") & F.col("copies").between(1, F.col("max_repeat")), F.lit(False))
    twice = chosen.groupBy("mix_id", "doc_id").agg(F.count("*").alias("m")).groupBy("mix_id").agg(F.sum(F.col("m") - 1).alias("twice"))
    per = known.groupBy("mix_id").agg(F.sum(bad.cast("long")).alias("bad"), F.count_distinct("source").alias("n_sources"))
    return per.join(twice, "mix_id").select("mix_id", "n_sources", (F.col("bad") + F.col("twice")).alias("n_bad"))


QUERIES = {"p7_mix": p7_mix, "p7_shares": p7_shares, "p7_whole_mix": p7_whole_mix, "p7_whole_shares": p7_whole_shares, "p7_limits": p7_limits}
SQL: dict[str, str] = {
    # each source that is there, with a share, is in the mix
    "p7_limits": """SELECT mix_id, count(*) AS n_sources, cast(0 AS BIGINT) AS n_bad FROM mix_target
      WHERE target_share > 0 AND max_repeat > 0 AND source IN (SELECT source FROM documents WHERE text IS NOT NULL AND text != '') GROUP BY 1""",
}
