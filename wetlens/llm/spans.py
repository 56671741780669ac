"""Long exact spans shared between texts, by relative Lempel-Ziv parsing.

What texts may share is cut out of them around anchors: stretches of ``K`` characters that are the
smallest by hash among ``SPAN - K + 1`` neighbours, so two texts that share ``SPAN`` characters share an
anchor inside them.  Reference blocks hold the surroundings of some anchors of all texts, indexed by a
suffix array.  Within a block every text's surroundings are factored greedily, from left to right,
against the surroundings of all other texts: a factor is the longest stretch that stands in one of them.
A shared span has at most one factor boundary inside, so windows of ``SPAN`` characters that lie in one factor or
across the boundary of two are looked up in the index, and those that stand in another text become
duplicate spans.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wetlens.operators import skew
from wetlens.session import load, written

SPAN = 200
#: Characters of an anchor, as a share of the span.
K = 100
#: Surroundings a reference block holds on average, and members of a set a task joins.
BLOCK, PART = 2_000, 2_000
#: Occurrences of one anchor beyond which they do not go into a block, but meet by their windows.
HOT = 500

_BASES = (np.uint64(0x9E3779B97F4A7C15 | 1), np.uint64(0xC2B2AE3D27D4EB4F | 1))


def _mixed(v: np.ndarray) -> np.ndarray:
    v = (v ^ (v >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    v = (v ^ (v >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return v ^ (v >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    p = np.full(n, base, np.uint64)
    if n:
        p[0] = 1
    return np.multiply.accumulate(p)


def window_hashes(codes: np.ndarray, width: int, which: int = 0) -> np.ndarray:
    """A 64-bit hash of each run of ``width`` characters."""
    n = len(codes)
    if n < width:
        return np.zeros(0, np.uint64)
    base = _BASES[which]
    inverse = np.uint64(pow(int(base), -1, 2**64))
    char = _mixed(codes.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(char * _powers(base, n), dtype=np.uint64)])
    return _mixed((total[width:] - total[:-width]) * _powers(inverse, n - width + 1))


def _sliding(v: np.ndarray, width: int, op) -> np.ndarray:
    """op over each run of ``width`` values, in linear time."""
    n = len(v)
    if width == 1:
        return v
    pad = -n % width
    full = np.concatenate([v, np.repeat(v[-1:], pad)]).reshape(-1, width)
    ahead = op.accumulate(full, axis=1).ravel()[:n]
    behind = op.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()[:n]
    return op(behind[: n - width + 1], ahead[width - 1 :])


def anchors(codes: np.ndarray, span: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of a text's anchors.

    Of an anchor that overlaps itself again and again (periodic text) the two first and
    two last occurrences are kept, and some between, no farther apart than an anchor.
    """
    if len(codes) < span:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h, width = window_hashes(codes, k), span - k + 1
    low = _sliding(h, width, np.minimum)
    pad = np.zeros(width - 1, np.uint64)
    pos = np.flatnonzero(_sliding(np.concatenate([pad, low, pad]), width, np.maximum) == h)
    hash_ = h[pos]
    order = np.lexsort((pos, hash_))
    p, g = pos[order], hash_[order]
    chained = np.concatenate([[False], (g[1:] == g[:-1]) & (p[1:] - p[:-1] <= k // 2)])
    if chained.any():
        chain = np.cumsum(~chained)
        first = np.flatnonzero(~chained)
        length = np.bincount(chain)[1:]
        rank = np.arange(len(p)) - first[chain - 1]
        step = (p - p[first[chain - 1]]) // (k // 2)
        keep = (rank < 2) | (rank >= length[chain - 1] - 2) | np.concatenate([[True], step[1:] != step[:-1]])
        order = np.sort(order[keep])
        pos, hash_ = pos[order], hash_[order]
    return pos, hash_


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


_ANCHORS = T.StructType([T.StructField("doc", T.LongType()), T.StructField("pos", T.IntegerType()), T.StructField("hash", T.LongType())])
_AROUND = T.StructType([*_ANCHORS.fields, T.StructField("left", T.IntegerType()), T.StructField("around", T.StringType()), T.StructField("hot", T.BooleanType())])
_FOUND = T.StructType([T.StructField("doc", T.LongType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("h1", T.LongType()), T.StructField("h2", T.LongType())])
_KEYS = T.StructType([T.StructField(n, T.LongType()) for n in ("k1", "k2", "cls")] + [T.StructField("shift", T.IntegerType())])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.string(), pa.bool_())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=[f.name for f in _AROUND.fields])


class Index:
    """A suffix array over segments of text, built by doubling; a character of its own stands between segments.

    ``ranks[k]`` numbers the stretches of ``widths[k]`` characters in their order, so stretches are
    equal where their numbers are; the last width is no less than any segment.
    """

    def __init__(self, segments: list[np.ndarray]):
        lengths = np.array([len(c) for c in segments], np.int64)
        self.start = np.concatenate([[0], np.cumsum(lengths + 1)])[:-1]
        self.end = self.start + lengths
        n = self.n = int(lengths.sum() + len(segments))
        self.seg = np.repeat(np.arange(len(segments)), lengths + 1)
        codes = np.zeros(n, np.int64)
        for c, at in zip(segments, self.start):
            codes[at : at + len(c)] = c
            codes[at : at + len(c)] += 1
        # characters are numbered by those that occur, and as many as fit are packed into one number
        used = np.zeros(0x110002, bool)
        used[codes] = True
        codes = (np.cumsum(used) - 1)[codes]
        bits = max(1, int(codes.max(initial=0)).bit_length())
        width = 62 // bits
        packed = np.zeros(n, np.int64)
        for k in range(width):
            packed <<= bits
            packed[: max(0, n - k)] |= codes[k:]
        self.codes = codes
        self.widths, self.ranks = [width], [np.unique(packed, return_inverse=True)[1].astype(np.int32)]
        while width <= lengths.max(initial=0):
            key = self.ranks[-1] * np.int64(n + 1)
            key[: max(0, n - width)] += self.ranks[-1][width:] + 1
            self.ranks.append(np.unique(key, return_inverse=True)[1].astype(np.int32))
            width *= 2
            self.widths.append(width)
        self.array = np.argsort(self.ranks[-1], kind="stable")

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Characters that the suffixes at i and j have in common."""
        out = np.zeros(len(i), np.int64)
        for w, r in zip(self.widths[::-1], self.ranks[::-1]):
            a, b = i + out, j + out
            inside = (a < self.n) & (b < self.n)
            out += np.where(inside & (r[np.minimum(a, self.n - 1)] == r[np.minimum(b, self.n - 1)]), w, 0)
        for _ in range(self.widths[0] - 1):
            a, b = i + out, j + out
            inside = (a < self.n) & (b < self.n)
            out += inside & (self.codes[np.minimum(a, self.n - 1)] == self.codes[np.minimum(b, self.n - 1)])
        return out

    def longest(self, owner: np.ndarray) -> np.ndarray:
        """For each position, the longest stretch from it that stands in a segment of another owner.

        ``owner``: a number per segment; a negative one is shared, so its whole segment stands elsewhere.
        """
        own = owner[self.seg[self.array]]
        # neighbours in the array of one owner are passed over; those of a shared segment never are
        cut = np.concatenate([[True], (own[1:] != own[:-1]) | (own[1:] < 0)])
        first = np.flatnonzero(cut)
        run = np.cumsum(cut) - 1
        before, after = first[run] - 1, np.append(first[1:], self.n)[run]
        beside = self.common(self.array[1:], self.array[:-1])
        best = np.zeros(self.n, np.int64)
        for other, ahead in ((before, 0), (after, 1)):
            ok = np.flatnonzero((other >= 0) & (other < self.n))
            next_ = np.abs(other[ok] - ok) == 1
            one, far = ok[next_], ok[~next_]
            at = self.array[one]
            best[at] = np.maximum(best[at], beside[one - 1 + ahead])
            at = self.array[far]
            best[at] = np.maximum(best[at], self.common(at, self.array[other[far]]))
        left = self.end[self.seg] - np.arange(self.n)
        return np.where(owner[self.seg] < 0, left, np.minimum(best, left))

    def factors(self, longest: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(from, to, next to) of the factors of all segments' greedy parses; of the last one next is its own end.

        All segments are parsed side by side, one factor each in a step.
        """
        at, segs = self.start.copy(), np.arange(len(self.start))
        out = []
        while len(at):
            open_ = at < self.end[segs]
            at, segs = at[open_], segs[open_]
            to = at + np.maximum(1, longest[at])
            out.append((segs, at, to))
            at = to
        segs, f, e = (np.concatenate(c) for c in zip(*out)) if out else [np.zeros(0, np.int64)] * 3
        order = np.argsort(f)
        segs, f, e = segs[order], f[order], e[order]
        nxt = np.append(e[1:], e[-1:])
        last = np.append(segs[1:] != segs[:-1], True) if len(segs) else np.zeros(0, bool)
        return f, e, np.where(last, e, nxt)


def _set_hashes(sets: np.ndarray, docs: np.ndarray, n: int) -> np.ndarray:
    """Two 64-bit hashes per set of its documents (set and doc: distinct couples)."""
    out = np.zeros((2, n), np.uint64)
    for k in (0, 1):
        np.add.at(out[k], sets, _mixed(docs.astype(np.int64).view(np.uint64) * _BASES[k] + np.uint64(k + 1)))
    return out.view(np.int64)


def block_spans(table: pa.Table, span: int) -> pa.Table:
    """What the texts of one reference block share: (doc, start, end) of spans, and (doc, h1, h2) of sets.

    A set holds texts that all have one window of ``span`` characters in common; of windows that stand in the same
    texts one is enough.  Sets of the same texts have the same hashes in every block.
    """
    number: dict = {}
    seg = np.array([number.setdefault(s, len(number)) for s in table.column("around").to_pylist()], np.int64)
    docs = table.column("doc").to_numpy()
    begin = table.column("pos").to_numpy() - table.column("left").to_numpy()
    low, high = np.full(len(number), np.iinfo(np.int64).max), np.full(len(number), np.iinfo(np.int64).min)
    np.minimum.at(low, seg, docs)
    np.maximum.at(high, seg, docs)
    owner = np.where(low == high, np.unique(low, return_inverse=True)[1], -1)
    index = Index([_codes(s) for s in number])
    f, e, nxt = index.factors(index.longest(owner))
    # windows that begin in a factor and end no later than the next one does
    many = np.maximum(0, np.minimum(e - 1, nxt - span) - f + 1)
    p = np.repeat(f, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    level = max((k for k, w in enumerate(index.widths) if w <= span), default=0)
    r = index.ranks[level]
    cls = np.unique(r[p] * np.int64(index.n + 1) + r[p + span - index.widths[level]], return_inverse=True)[1] if len(p) else p
    n_cls = int(cls.max()) + 1 if len(p) else 0
    own = owner[index.seg[p]]
    lo, hi = np.full(n_cls, np.iinfo(np.int64).max), np.full(n_cls, -2)
    np.minimum.at(lo, cls, own)
    np.maximum.at(hi, cls, own)
    shared = ((lo != hi) | (lo < 0))[cls]
    p, cls = p[shared], cls[shared]
    s = index.seg[p]
    # a segment is shorter than two spans, so its shared windows all overlap
    first, last = np.full(len(number), np.iinfo(np.int64).max), np.full(len(number), -1)
    np.minimum.at(first, s, p - index.start[s])
    np.maximum.at(last, s, p - index.start[s])
    has = last[seg] >= 0
    spans = {"doc": docs[has], "start": (begin[has] + first[seg[has]]).astype(np.int32), "end": (begin[has] + last[seg[has]] + span).astype(np.int32)}
    # windows in the same segments are one set
    couple = np.divmod(np.unique(cls * len(number) + s), max(1, len(number)))
    names, at = np.unique(couple[0], return_inverse=True)
    by_seg = _set_hashes(at, couple[1], len(names))
    order = np.lexsort(by_seg)
    one = order[np.append(True, (np.diff(by_seg[:, order]) != 0).any(0))] if len(names) else order
    chosen = np.zeros(len(names), bool)
    chosen[one] = True
    keep = chosen[at]
    sets, segs = at[keep], couple[1][keep]
    # segments to the texts that have them
    order = np.argsort(seg, kind="stable")
    size = np.bincount(seg, minlength=len(number))
    offset = np.cumsum(size) - size
    times = size[segs]
    member = order[np.repeat(offset[segs], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)]
    ids, nth = np.unique(docs, return_inverse=True)
    pair = np.divmod(np.unique(np.repeat(sets, times) * len(ids) + nth[member]), max(1, len(ids)))
    pair = (pair[0], ids[pair[1]])
    hashes = _set_hashes(pair[0], pair[1], len(names))
    none = lambda n, t: pa.nulls(n, t)
    n_s, n_p = len(spans["doc"]), len(pair[0])
    cols = [
        pa.concat_arrays([pa.array(spans["doc"]), pa.array(pair[1])]),
        pa.concat_arrays([pa.array(spans["start"]), none(n_p, pa.int32())]),
        pa.concat_arrays([pa.array(spans["end"]), none(n_p, pa.int32())]),
        pa.concat_arrays([none(n_s, pa.int64()), pa.array(hashes[0][pair[0]])]),
        pa.concat_arrays([none(n_s, pa.int64()), pa.array(hashes[1][pair[0]])]),
    ]
    return pa.table(cols, names=[f.name for f in _FOUND.fields])


def _window_keys(table: pa.Table, span: int) -> pa.Table:
    """128-bit hashes of all windows of ``span`` characters around a hot anchor, per class of surroundings."""
    k1, k2, cls, shift = [], [], [], []
    for s, c in zip(table.column("around").to_pylist(), table.column("cls").to_numpy()):
        codes = _codes(s)
        h = window_hashes(codes, span, 0)
        k1.append(h)
        k2.append(window_hashes(codes, span, 1))
        cls.append(np.full(len(h), c))
        shift.append(np.arange(len(h), dtype=np.int32))
    join = lambda x, t: np.concatenate(x).view(t) if x else np.zeros(0, t)
    return pa.table({"k1": join(k1, np.int64), "k2": join(k2, np.int64), "cls": join(cls, np.int64), "shift": join(shift, np.int32)})


def _self_pairs(members: DataFrame, key: str, item: str, keep: list[str]) -> DataFrame:
    """All pairs a < b of the items of each key; large keys are cut into parts, each its own task."""
    sizes = members.groupBy(key).agg(F.ceil(F.count("*") / PART).alias("parts")).filter("parts > 1")
    m = members.join(sizes, key, "left").withColumn("parts", F.coalesce("parts", F.lit(1)).cast("long"))
    a = m.select(key, F.col(item).alias("a"), *(F.col(c).alias(f"a_{c}") for c in keep), F.pmod(F.xxhash64(item), "parts").alias("part"))
    b = m.select(key, F.col(item).alias("b"), *(F.col(c).alias(f"b_{c}") for c in keep), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    return a.join(b, [key, "part"]).filter("a < b").drop("part")


class Shared:
    """What texts share: ``members`` (doc, rep, n), and of representatives ``spans`` (doc, start, end) and ``sets`` (h1, h2, doc).

    Equal texts are one class, represented by its smallest id, so copies cost nothing and
    form no hot group.  NULL texts are left out.
    """

    def __init__(self, documents: DataFrame, id: str = "doc_id", text: str = "text", span: int = SPAN, k: int = K, hot: int = HOT):
        self.span = span
        texts = documents.select(F.col(id).cast("long").alias("doc"), F.col(text).cast("string").alias("text")).filter("doc is not null and text is not null")
        key = [F.sha2("text", 256).alias("sha")]
        hashed = texts.filter(F.length("text") >= span).select("doc", *key, F.length("text").alias("n"))
        reps = hashed.groupBy("sha").agg(F.min("doc").alias("rep"))
        self.members = written(hashed.join(reps, "sha").select("doc", "rep", "n"), "members")
        # copies are few or many, texts are large: leaving copies out moves no text if they are few
        texts = texts.filter(F.length("text") >= span).join(self.members.filter("doc != rep").select("doc"), "doc", "left_anti")

        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                doc, pos, hash_ = [], [], []
                for d, s in zip(b.column("doc").to_pylist(), b.column("text").to_pylist()):
                    p, h = anchors(_codes(s), span, k)
                    doc.append(np.full(len(p), d, np.int64))
                    pos.append(p.astype(np.int32))
                    hash_.append(h.view(np.int64))
                if doc:
                    yield pa.RecordBatch.from_pydict({"doc": np.concatenate(doc), "pos": np.concatenate(pos), "hash": np.concatenate(hash_)})

        found = written(texts.mapInArrow(find, _ANCHORS), "anchors")
        twice = found.groupBy("hash").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"), F.count("*").alias("m")).filter("lo != hi")
        # written, so that the optimizer knows whether it is small enough for the texts to stay where they are
        kept = written(found.join(twice.select("hash", (F.col("m") > hot).alias("hot")), "hash").groupBy("doc").agg(F.collect_list(F.struct("pos", "hash", "hot")).alias("at")), "kept")
        side = span - k

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows: list[tuple] = []
            for b in batches:
                for d, s, at in zip(b.column("doc").to_pylist(), b.column("text").to_pylist(), b.column("at").to_pylist()):
                    for x in at:
                        p = x["pos"]
                        lead = min(side, p)
                        rows.append((d, p, x["hash"], lead, s[p - lead : p + k + side], x["hot"]))
                    if len(rows) >= 10_000:
                        yield _batch(rows)
                        rows = []
            if rows:
                yield _batch(rows)

        around = written(texts.join(kept, "doc").mapInArrow(cut, _AROUND), "around")
        blocks = max(1, -(-around.filter("not hot").count() // BLOCK))

        def share(table: pa.Table) -> pa.Table:
            return block_spans(table, span)

        cold = around.filter("not hot").withColumn("block", F.pmod("hash", F.lit(blocks))).groupBy("block").applyInArrow(share, _FOUND)
        hot_rows = around.filter("hot")
        found = written(cold if hot_rows.isEmpty() else cold.unionByName(self._hot(hot_rows)), "found")
        self.spans = found.filter("h1 is null").select("doc", "start", "end")
        self.sets = found.filter("h1 is not null").select("h1", "h2", "doc").distinct()

    def _hot(self, rows: DataFrame) -> DataFrame:
        """The same at anchors with too many occurrences for a block, by windows that are equal as a whole.

        Occurrences with equal surroundings are one class.  A class has one row per window
        of ``span`` characters, at most ``span - k + 1``, whatever the number of texts; windows meet by a hash of 128
        bits, and no two occurrences are compared.
        """
        span = self.span
        rows = rows.withColumn("cls", F.xxhash64("around", "hash"))
        classes = written(rows.groupBy("cls").agg(F.min("around").alias("around"), F.min("doc").alias("lo"), F.max("doc").alias("hi")), "classes")

        def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield from _window_keys(pa.Table.from_batches([b]), span).to_batches()

        windows = written(classes.select("cls", "around").mapInArrow(keys, _KEYS), "windows")
        each = windows.select("k1", "k2", "cls").distinct().join(classes.select("cls", "lo", "hi"), "cls")
        total = lambda *c: F.sum(F.xxhash64(*c).cast("decimal(38,0)"))
        shared = each.groupBy("k1", "k2").agg(F.count("*").alias("count"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), total("cls").alias("s1"), total("cls", F.lit(1)).alias("s2")).filter("lo != hi")
        shared = written(shared.select("k1", "k2", "count", "s1", "s2"), "sharedkeys")
        large = shared.filter(F.col("count") > skew.HOT).select("k1", "k2", "count")
        large = None if large.isEmpty() else large
        member = rows.select("cls", "doc", (F.col("pos") - F.col("left")).alias("begin")).distinct()
        at = skew.join_hot(windows, shared.select("k1", "k2"), ["k1", "k2"], large, "cls", "inner").groupBy("cls").agg(F.min("shift").alias("first"), F.max("shift").alias("last"))
        spans = member.join(at, "cls").select("doc", (F.col("begin") + F.col("first")).alias("start"), (F.col("begin") + F.col("last") + span).alias("end"))
        # of windows that stand in the same classes one is enough
        one = shared.groupBy("count", "s1", "s2").agg(F.min(F.struct("k1", "k2")).alias("k")).select("k.k1", "k.k2")
        sets = skew.join_hot(windows.select("k1", "k2", "cls").distinct(), one, ["k1", "k2"], large, "cls", "inner").join(member.select("cls", "doc").distinct(), "cls")
        none = lambda t, *names: [F.lit(None).cast(t).alias(n) for n in names]
        return spans.select("doc", F.col("start").cast("int"), F.col("end").cast("int"), *none("long", "h1", "h2")).unionByName(sets.select("doc", *none("int", "start", "end"), F.col("k1").alias("h1"), F.col("k2").alias("h2")))

    def pairs(self) -> DataFrame:
        """(doc_a, doc_b): every two texts with a stretch of ``span`` characters in common, once."""
        reps = _self_pairs(self.sets.select(F.struct("h1", "h2").alias("set"), "doc"), "set", "doc", []).select("a", "b").distinct()
        m = self.members.select("doc", "rep")
        across = reps.join(m.select(F.col("rep").alias("a"), F.col("doc").alias("x")), "a").join(m.select(F.col("rep").alias("b"), F.col("doc").alias("y")), "b")
        copies = _self_pairs(m.join(m.filter("doc != rep").select("rep").distinct(), "rep", "left_semi"), "rep", "doc", [])
        return across.select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b")).unionByName(copies.select(F.col("a").alias("doc_a"), F.col("b").alias("doc_b")))

    def stretches(self) -> DataFrame:
        """(doc, start, end): the stretches of each text that stand elsewhere too, merged where they meet."""
        parts = self.spans.select(F.col("doc").alias("rep"), F.col("start").alias("s"), F.col("end").alias("e"))
        copied = self.members.groupBy("rep").agg(F.count("*").alias("m"), F.min("n").alias("e")).filter("m > 1").select("rep", F.lit(0).alias("s"), F.col("e"))
        each = parts.unionByName(copied).groupBy("rep", "s").agg(F.max("e").alias("e"))
        w = W.partitionBy("rep").orderBy("s")
        marked = each.withColumn("new", (F.col("s") > F.coalesce(F.max("e").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(-1))).cast("int"))
        merged = marked.withColumn("g", F.sum("new").over(w)).groupBy("rep", "g").agg(F.min("s").alias("start"), F.max("e").alias("end"))
        return self.members.join(merged, "rep").select("doc", "start", "end")

    def linked(self) -> DataFrame:
        """(doc, rep, links): every text, the one it is a copy of, and the number of texts it shares a stretch with.

        The compact form of :meth:`pairs`: links are counted among representatives and weighed by
        their copies, which are not expanded.
        """
        size = self.members.groupBy("rep").agg(F.count("*").alias("m"))
        reps = _self_pairs(self.sets.select(F.struct("h1", "h2").alias("set"), "doc"), "set", "doc", []).select("a", "b").distinct()
        both = reps.select(F.col("a").alias("x"), F.col("b").alias("rep")).unionByName(reps.select(F.col("b").alias("x"), F.col("a").alias("rep")))
        other = both.join(size, "rep").groupBy(F.col("x").alias("rep")).agg(F.sum("m").alias("others"))
        return self.members.join(size, "rep").join(other, "rep", "left").select("doc", "rep", (F.col("m") - 1 + F.coalesce("others", F.lit(0))).alias("links"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of texts with a stretch of at least 200 characters in common."""
    return Shared(load(spark, sf_dir, "documents")).pairs()


def p8_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stretches of each text that also stand in another."""
    return Shared(load(spark, sf_dir, "documents")).stretches().select(F.col("doc").alias("doc_id"), "start", "end")


def p8_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of at least 200 characters, the text it copies, and the number of texts it shares a stretch with."""
    return Shared(load(spark, sf_dir, "documents")).linked().select(F.col("doc").alias("doc_id"), F.col("rep").alias("copy_of"), F.col("links").alias("n_links"))


def p8_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each text is shared elsewhere."""
    d = load(spark, sf_dir, "documents")
    per = Shared(d).stretches().groupBy("doc").agg(F.count("*").alias("n_spans"), F.sum(F.col("end") - F.col("start")).alias("shared"))
    n = F.length(F.coalesce("text", F.lit("")))
    full = d.select("doc_id", n.alias("n_chars")).join(per, F.col("doc") == F.col("doc_id"), "left")
    shared = F.coalesce("shared", F.lit(0)).cast("long")
    return full.select("doc_id", "n_chars", F.coalesce("n_spans", F.lit(0)).alias("n_spans"), shared.alias("shared_chars"), F.when(F.col("n_chars") > 0, shared / F.col("n_chars")).otherwise(F.lit(0.0)).alias("share"))


QUERIES = {"p8_found": p8_found, "p8_spans": p8_spans, "p8_links": p8_links, "p8_shared": p8_shared}

# every window of 200 characters, by a hash of 128 bits
_HITS = """pos AS (SELECT doc_id, text, unnest(range(1, length(text) - 198)) AS i FROM documents WHERE length(text) >= 200),
  windows AS (SELECT doc_id, i, md5(substr(text, i, 200)) AS k FROM pos),
  common AS (SELECT k FROM windows GROUP BY k HAVING count(DISTINCT doc_id) > 1),
  hits AS (SELECT DISTINCT doc_id, i, k FROM windows JOIN common USING (k))"""
_SPANS = f"""{_HITS}, steps AS (SELECT doc_id, i - 1 AS s, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 200 THEN 0 ELSE 1 END AS fresh FROM (SELECT DISTINCT doc_id, i FROM hits)),
  runs AS (SELECT doc_id, s, sum(fresh) OVER (PARTITION BY doc_id ORDER BY s) AS g FROM steps),
  spans AS (SELECT doc_id, cast(min(s) AS INTEGER) AS start, cast(max(s) + 200 AS INTEGER) AS "end" FROM runs GROUP BY doc_id, g)"""
_PAIRS = f"{_HITS}, pairs AS (SELECT DISTINCT a.doc_id AS doc_a, b.doc_id AS doc_b FROM hits a JOIN hits b ON a.k = b.k AND a.doc_id < b.doc_id)"
SQL = {
    "p8_found": f"WITH {_PAIRS} SELECT doc_a, doc_b FROM pairs",
    "p8_spans": f'WITH {_SPANS} SELECT doc_id, start, "end" FROM spans',
    "p8_links": f"""WITH {_PAIRS}, n AS (SELECT doc_id, count(*) AS n FROM (SELECT doc_a AS doc_id FROM pairs UNION ALL SELECT doc_b FROM pairs) GROUP BY 1)
      SELECT d.doc_id, min(d.doc_id) OVER (PARTITION BY d.text) AS copy_of, coalesce(n, 0)::BIGINT AS n_links FROM documents d LEFT JOIN n USING (doc_id) WHERE length(d.text) >= 200""",
    "p8_shared": f"""WITH {_SPANS}, per AS (SELECT doc_id, count(*) AS n_spans, sum("end" - start)::BIGINT AS shared_chars FROM spans GROUP BY 1)
      SELECT doc_id, length(coalesce(text, ''))::INTEGER AS n_chars, coalesce(n_spans, 0) AS n_spans, coalesce(shared_chars, 0)::BIGINT AS shared_chars,
        CASE WHEN length(coalesce(text, '')) > 0 THEN coalesce(shared_chars, 0) / length(text) ELSE 0 END::DOUBLE AS share FROM documents LEFT JOIN per USING (doc_id)""",
}
