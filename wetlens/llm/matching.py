"""Mapping freely typed values to the entries of a reference list."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wetlens.llm.values import allowed, edits, words
from wetlens.operators.skew import HOT, join_hot
from wetlens.session import load, written

#: Weighted cosine from which an entry is accepted.
THRESHOLD = 0.45
#: What the better of two entries must be ahead by.
MARGIN = 0.01
#: Weight of two letters with one between them, against neighbours; and the power of a bigram's rareness.
SKIP, RARENESS = 0.7, 0.25
#: Reference terms beside which words must stand, written out in full, to count as a remark; and words of a remark.
BESIDE, REMARK = 2, 2
#: Letters a term may have gained at its end, by inflection.
ENDING = 2

_WORDS = T.ArrayType(T.StringType())


@F.pandas_udf(_WORDS)
def _words(values: pd.Series) -> pd.Series:
    return values.map(words)


@F.pandas_udf(_WORDS)
def _orders(terms: pd.Series) -> pd.Series:
    def orders(term):
        w = words(term) if term else []
        return list(dict.fromkeys(["".join(w), "".join(reversed(w))])) if w else []

    return terms.map(orders)


@F.pandas_udf(T.BooleanType())
def _few_edits(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else edits(x, y) <= allowed(y) for x, y in zip(a, b)], dtype=object)


def _spelt(form: Column, term: Column) -> Column:
    """Whether a form is a term but for one edit in four letters, or with an ending; a swap of neighbours is one edit.

    A swap is two edits of the plain distance, so that decides all but few pairs in the JVM.
    """
    most = F.greatest(F.lit(1), F.floor((F.length(term) + 2) / 4)).cast("int")
    far = F.abs(F.length(form) - F.length(term)) > most
    plain = F.when(far, F.lit(None)).otherwise(F.levenshtein(form, term))
    unsure = ~far & (plain > most) & (plain <= 2 * most)
    ending = form.startswith(term) & (F.length(form) - F.length(term) <= ENDING)
    return ending | (~far & ((plain <= most) | (unsure & F.coalesce(_few_edits(F.when(unsure, form), F.when(unsure, term)), F.lit(False)))))


def _grams(text: Column) -> Column:
    """The bigrams of a text with its ends marked, and its pairs of letters with one between them, with repeats."""
    s = F.concat(F.lit("^"), text, F.lit("$"))
    near = F.transform(F.sequence(F.lit(1), F.length(s) - 1), lambda i: F.substring(s, i, F.lit(2)))
    skip = F.transform(F.sequence(F.lit(1), F.length(s) - 2), lambda i: F.concat(F.substring(s, i, F.lit(1)), F.lit("\0"), F.substring(s, i + 2, F.lit(1))))
    return F.concat(near, F.when(F.length(s) > 2, skip).otherwise(F.array().cast("array<string>")))


def _vectors(texts: DataFrame, text: str, weight: DataFrame | None, n: int) -> DataFrame:
    """(texts' columns, gram, w): the vector of each text, of length 1.

    A gram weighs the root of its number times a power of its rareness among the reference terms.
    """
    keys = texts.columns
    grams = texts.withColumn("gram", F.explode(_grams(F.col(text)))).groupBy(*keys, "gram").agg(F.sqrt(F.count("*")).alias("w"))
    rare = F.pow(F.log1p(F.lit(float(n)) / F.coalesce("terms", F.lit(1))), F.lit(RARENESS))
    kind = F.when(F.length("gram") == 3, F.lit(SKIP)).otherwise(F.lit(1.0))
    v = grams.join(weight, "gram", "left").withColumn("w", F.col("w") * rare * kind).drop("terms")
    return v.withColumn("w", F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(W.partitionBy(*keys))))


def blank(value: Column) -> Column:
    """True for NULL, empty and white-space-only values."""
    return value.isNull() | value.rlike(r"(?U)^[\s\x1c-\x1f]*\z")


def terms_of(reference: DataFrame) -> DataFrame:
    """(ref_id, term): each name and alias, words run together in either order."""
    names = F.concat(F.array("name"), F.coalesce("aliases", F.array()))
    one = reference.select("ref_id", F.explode(names).alias("t")).filter("t is not null")
    return one.select("ref_id", F.explode(_orders("t")).alias("term")).distinct()


def _edges(word: DataFrame) -> DataFrame:
    """(value, side, remark, k, rest) of each value of several words: its first or last words, and the others run together."""
    w, n = F.col("words"), F.size("words")
    cuts = [F.when(n > k, F.struct(F.lit(side).alias("side"), F.concat_ws(" ", cut).alias("remark"), F.lit(k).alias("k"), F.concat_ws("", rest).alias("rest"))) for k in range(1, REMARK + 1) for side, cut, rest in (("before", F.slice(w, 1, k), F.slice(w, k + 1, n)), ("after", F.slice(w, n - k + 1, k), F.slice(w, 1, F.greatest(n - k, F.lit(0)))))]
    return word.select("value", F.explode(F.array_compact(F.array(*cuts))).alias("e")).select("value", "e.*")


def _without_remarks(word: DataFrame, terms: DataFrame) -> DataFrame:
    """(value, form): the words of each value run together, remarks at either end left out.

    Which words are remarks is learnt from the values: they stand beside at least ``BESIDE``
    terms of the reference list that are written out in full, and are in none of its terms by themselves.
    """
    edges = _edges(word)
    full = edges.join(terms.select(F.col("term").alias("rest")).distinct(), "rest").groupBy("side", "remark", "k").agg(F.count_distinct("rest").alias("terms")).filter(F.col("terms") >= BESIDE)
    own = terms.select(F.col("term").alias("remark")).distinct()
    remarks = written(full.join(own, F.translate(full["remark"], " ", "") == own["remark"], "left_anti").select("side", "remark"), "remarks")
    cut = edges.join(remarks, ["side", "remark"]).groupBy("value").agg(*(F.max(F.when(F.col("side") == side, F.col("k"))).alias(side) for side in ("before", "after")))
    n, before, after = F.size("words"), F.coalesce("before", F.lit(0)), F.coalesce("after", F.lit(0))
    kept = F.when(before + after < n, F.slice("words", before + 1, F.greatest(n - before - after, F.lit(0)))).otherwise(F.col("words"))
    return word.join(cut, "value", "left").select("value", F.concat_ws("", kept).alias("form"))


def match_values(values: DataFrame, reference: DataFrame, threshold: float = THRESHOLD, margin: float = MARGIN) -> DataFrame:
    """(value, ref_id): the entry each distinct value stands for, 0 if none.

    ``values``: a column ``value``, repeats allowed; ``reference``: ref_id, name, aliases.
    A value that is letter for letter a name stands for it (the smallest ref_id, should
    two entries share it).  Others are normalised and their words run together, without
    remarks (:func:`_without_remarks`).  An inverted index of character bigrams yields the
    candidates, names and aliases in either word order, and their weighted cosine with the value;
    the entry of the highest cosine is accepted if that is at least ``threshold``, and ahead of any other entry's by
    ``margin`` (unless it is written letter for letter); else the value stands for none.  An exact check follows: an accepted value must be a term
    of the entry but for one edit in four letters or an ending.
    NULL and blank values are left out.  An empty reference maps everything to 0.
    """
    tasks = values.sparkSession.sparkContext.defaultParallelism
    values = values.select(F.col("value")).filter(~blank(F.col("value"))).distinct()
    exact = reference.filter("name is not null").groupBy(F.col("name").alias("value")).agg(F.min("ref_id").alias("exact"))
    known = written(values.join(exact, "value", "left").repartition(tasks, "value"), "values")
    terms = written(terms_of(reference), "terms")
    word = written(known.filter("exact is null").select("value", _words("value").alias("words")), "words")
    forms = written(_without_remarks(word, terms).filter("form != ''"), "forms")
    n = max(1, terms.select("term").distinct().count())
    weight = terms.select("term").distinct().select(F.explode(F.array_distinct(_grams(F.col("term")))).alias("gram")).groupBy("gram").agg(F.count("*").alias("terms"))
    index = written(_vectors(terms, "term", weight, n).withColumnRenamed("w", "tw"), "index")
    grams = written(_vectors(forms.select("form").distinct(), "form", weight, n), "grams")
    hot = written(grams.groupBy("gram").count().filter(F.col("count") > HOT), "hot") if grams.count() > HOT else None
    scored = join_hot(grams, index, ["gram"], hot, "form", "inner").groupBy("form", "ref_id", "term").agg(F.sum(F.col("w") * F.col("tw")).alias("cosine"))
    best = scored.groupBy("form", "ref_id").agg(F.max(F.struct("cosine", "term")).alias("best")).filter(F.col("best.cosine") >= threshold - margin)
    rank = W.partitionBy("form").orderBy(F.desc("best.cosine"), "ref_id")
    top = best.withColumn("r", F.row_number().over(rank)).withColumn("next", F.lead("best.cosine").over(rank)).filter("r = 1")
    clear = (F.col("best.cosine") >= threshold) & (F.col("next").isNull() | (F.col("best.cosine") - F.col("next") >= margin) | ((F.col("form") == F.col("best.term")) & (F.col("next") < 1 - 1e-9)))
    accepted = written(top.filter(clear).select("form", "ref_id"), "accepted")
    spelt = accepted.repartition(tasks, "form").join(terms, "ref_id").filter(_spelt(F.col("form"), F.col("term"))).select("form", "ref_id").distinct()
    matched = forms.join(spelt, "form").select("value", F.col("ref_id").alias("m"))
    return written(known.join(matched, "value", "left").select("value", F.coalesce("exact", "m", F.lit(0)).cast("int").alias("ref_id")), "matched")


def with_meaning(rows: DataFrame, column: str, matched: DataFrame, spread: str, hot: int = HOT) -> DataFrame:
    """``rows`` with the ref_id of ``column`` (NULL where it is blank).

    Whether the table of distinct values is broadcast is the optimizer's choice, which knows its written size.
    Values of more than ``hot`` rows are dealt to parts by a hash of ``spread``, so one value may hold any share of the rows.
    """
    m = matched.withColumnRenamed("value", column)
    crowded = None
    if matched.count() > 0 and rows.count() > hot:
        crowded = written(rows.filter(F.col(column).isNotNull()).groupBy(column).count().filter(F.col("count") > hot), "hot")
    return join_hot(rows, m, [column], crowded, spread, limit=hot)


def manifest_meanings(manifest: DataFrame, reference: DataFrame) -> DataFrame:
    """:func:`match_values` of the distinct feature types of the manifest."""
    return match_values(manifest.select(F.col("feature_type").alias("value")), reference)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entry (0: none) of each manifest row whose feature type is neither blank nor a name."""
    m, ref = load(spark, sf_dir, "manifest").select("row_idx", "feature_type"), load(spark, sf_dir, "feature_ref")
    matched = manifest_meanings(m, ref)
    odd = matched.join(ref.select(F.col("name").alias("value")), "value", "left_anti")
    return with_meaning(m.filter(~blank(F.col("feature_type"))), "feature_type", odd, "row_idx").filter("ref_id is not null").select("row_idx", "ref_id")


def p3_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The values that stand for no entry, with their numbers of rows."""
    m = load(spark, sf_dir, "manifest")
    counts = m.groupBy(F.col("feature_type").alias("value")).agg(F.count("*").alias("n_rows"))
    return manifest_meanings(m, load(spark, sf_dir, "feature_ref")).filter("ref_id = 0").join(counts, "value").select("value", "n_rows")


QUERIES = {"p3_found": p3_found, "p3_unmatched": p3_unmatched}
SQL: dict[str, str] = {}
