"""Mixing sources to target token counts by entropy balancing, in DataFrame operations only.

Each source has a target number of words. Among all document rates that meet the targets (rates between
0 and 2), the ones of largest entropy are exponential tilts ``exp(lambda * size)``, cut at 2, with one
multiplier per source. The convex dual is solved by safeguarded Newton steps; each step is one
aggregation by source over a histogram of sizes, so no step reads a document. Rates are then rounded into
whole copies: the fractional parts are settled by a hash of the document, at a threshold per source that
a binned search finds, and at most ``REPAIRS`` documents a source get one copy more or less where this
brings the source closer to its target, which leaves it within half of its largest document. All tables by source stay DataFrames.

Size of a document: the number of ``[^\\x20\\x09-\\x0D]+`` in its text. Weights 3, 1, 2 repeat over the
sources in code-point order, null last. The mix takes 150 % of all words, no source more than twice its
size; what a source can't take is shared out again by weight.

Edge cases: null and empty texts have size 0, one copy and nothing taken; a source of size 0 has target
0; a null source is a source; repeated rows are documents each; an empty table gives an empty result;
other columns are kept by ``mixed`` and ignored otherwise. Reruns give the same copies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ruleloom.llm.common import with_row_numbers, written

WEIGHTS, SHARE, CAP = (3, 1, 2), 1.5, 2.0
STEPS, BINS, REPAIRS = 40, 1024, 3
_BOUND = 1e4


def targets(sizes: DataFrame) -> DataFrame:
    """``source, docs, source_size, target`` by water-filling: the smallest caps in relation to weight fill first."""
    by = sizes.groupBy("source").agg(F.count("*").alias("docs"), F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.row_number().over(order) - 1) % len(WEIGHTS) + 1)
    by = by.withColumn("weight", weight.cast("double")).withColumn("cap", CAP * F.col("source_size"))
    filling = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    before, whole = filling.rowsBetween(Window.unboundedPreceding, -1), filling.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = SHARE * F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    by = by.withColumn("level", left / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    level = F.min(F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.struct(F.col("cap") / F.col("weight"), "level"))).over(whole)["level"]
    return by.withColumn("target", F.least("cap", level * F.col("weight"))).select("source", "docs", "source_size", "target")


def _same(a, b):
    return a.eqNullSafe(b)


def _with(df: DataFrame, table: DataFrame) -> DataFrame:
    """Join a table by source; a null source meets the null source."""
    right = table.withColumnRenamed("source", "__source")
    return df.join(right, _same(df["source"], right["__source"])).drop("__source")


def multipliers(sizes: DataFrame, goals: DataFrame) -> DataFrame:
    """``source, target, mean, lam``: the dual's solution for each source that isn't full."""
    histogram = written(sizes.where("size > 0").groupBy("source", "size").agg(F.count("*").alias("n")), "mix-histogram")
    mean = histogram.groupBy("source").agg((F.sum(F.col("n") * F.col("size")) / F.sum("n")).alias("mean"))
    open_ = goals.where((F.col("target") > 0) & (F.col("target") < CAP * F.col("source_size") * (1 - 1e-9)))
    state = _with(open_, mean).select("source", "target", "mean", F.lit(0.0).alias("lam"), F.lit(-_BOUND).alias("lo"), F.lit(_BOUND).alias("hi"), F.lit(False).alias("done"))
    state = written(state, "mix-state")
    for _ in range(STEPS):
        z = F.col("size") / F.col("mean")
        tilt = F.exp(F.least(F.col("lam") * z, F.lit(50.0)))
        words = F.col("n") * F.col("size")
        terms = _with(histogram, state.where("not done")).groupBy("source").agg(
            F.sum(words * F.least(tilt, F.lit(CAP))).alias("sum"), F.sum(F.when(tilt < CAP, words * z * tilt).otherwise(0.0)).alias("slope")
        )
        right = terms.withColumnRenamed("source", "__source")
        both = state.join(right, _same(state["source"], right["__source"]), "left").drop("__source")
        off = F.col("sum") - F.col("target")
        lo, hi = F.when(off < 0, F.col("lam")).otherwise(F.col("lo")), F.when(off > 0, F.col("lam")).otherwise(F.col("hi"))
        both = both.withColumn("off", off).withColumn("lo2", lo).withColumn("hi2", hi)
        newton = F.col("lam") - F.col("off") / F.when(F.col("slope") > 0, F.col("slope"))
        inside = (newton > F.col("lo2")) & (newton < F.col("hi2"))
        middle = F.when(F.col("lo2") == -_BOUND, F.least(2 * F.col("lam"), F.lit(-1.0))).when(F.col("hi2") == _BOUND, F.greatest(2 * F.col("lam"), F.lit(1.0))).otherwise((F.col("lo2") + F.col("hi2")) / 2)
        done = F.col("done") | F.coalesce(F.abs("off") <= 1e-9 * F.col("target"), F.lit(False)) | F.coalesce(F.col("hi2") - F.col("lo2") < 1e-12, F.lit(False))
        state = both.select(
            "source", "target", "mean", F.when(done, F.col("lam")).when(inside, newton).otherwise(middle).alias("lam"),
            F.coalesce("lo2", "lo").alias("lo"), F.coalesce("hi2", "hi").alias("hi"), done.alias("done"),
        )
        state = written(state, "mix-state")
        if not state.where("not done").take(1):
            break
    return state.select("source", "mean", "lam")


def copies(documents: DataFrame) -> DataFrame:
    """``row, doc_id, text_hash, source, size, source_size, target, rate, copies``: one row per document.

    ``row`` is the number of a row of documents that are numbered (``__doc``), else one of its own.
    """
    row = F.col("__doc") if "__doc" in documents.columns else F.monotonically_increasing_id()
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    sizes = documents.select(
        "doc_id", F.xxhash64(text).alias("text_hash"), "source", F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("size"), row.alias("row")
    )
    sizes = written(sizes, "mix-sizes")
    goals = written(targets(sizes), "mix-targets")
    lam = multipliers(sizes, goals)
    named = _with(sizes, goals.drop("docs"))
    right = lam.withColumnRenamed("source", "__source")
    tilted = F.least(F.exp(F.least(F.col("lam") * F.col("size") / F.col("mean"), F.lit(50.0))), F.lit(CAP))
    rate = F.when(F.col("size") == 0, 1.0).when(F.col("target") <= 0, 0.0).when(F.col("lam").isNull(), CAP).otherwise(tilted)
    rated = named.join(right, _same(named["source"], right["__source"]), "left").drop("__source").withColumn("rate", rate)
    whole = F.floor("rate")
    unit = (F.xxhash64("doc_id", "text_hash").cast("double") / F.lit(2.0**64) + 0.5) + 1e-18
    odds = unit / (F.col("rate") - whole)
    rated = rated.withColumn("whole", whole).withColumn("order", F.when(F.col("rate") > whole, odds / (1 + odds)))
    rated = written(rated.drop("lam", "mean"), "mix-rates")
    chosen = rated.join(_thresholds(rated), _same(F.col("source"), F.col("__source")), "left").drop("__source")
    chosen = chosen.withColumn("copies", F.col("whole") + F.when(F.col("order") < F.col("threshold"), 1).otherwise(0)).drop("threshold", "order", "whole")
    return _repaired(written(chosen, "mix-copies"))


def _thresholds(rated: DataFrame) -> DataFrame:
    """The threshold of each source below which a document's fraction becomes a copy."""
    need = rated.groupBy("source").agg((F.first("target") - F.sum(F.col("size") * F.col("whole"))).alias("need"))
    part = rated.where("order is not null and size > 0").select("source", "size", "order")
    state = need.select("source", "need", F.lit(0.0).alias("lo"), F.lit(1.0).alias("width"))
    state = written(state, "mix-search")
    for _ in range(3):
        inside = _with(part, state).where("order >= lo and order < lo + width")
        binned = inside.groupBy("source", F.least(F.floor((F.col("order") - F.col("lo")) / F.col("width") * BINS), F.lit(BINS - 1)).alias("bin")).agg(F.sum("size").alias("words"), F.first("need").alias("need"))
        rising = Window.partitionBy("source").orderBy("bin")
        cum = binned.withColumn("to", F.sum("words").over(rising)).where("to > need")
        hit = cum.groupBy("source").agg(F.min(F.struct("bin", (F.col("need") - F.col("to") + F.col("words")).alias("rest"), "words")).alias("hit"))
        right = hit.withColumnRenamed("source", "__source")
        state = state.join(right, _same(state["source"], right["__source"]), "left").drop("__source")
        # Without a hit all of the range is taken, and the range after it is empty.
        state = state.select(
            "source", F.coalesce("hit.rest", "need").alias("need"),
            F.when(F.col("hit").isNull(), F.col("lo") + F.col("width")).otherwise(F.col("lo") + F.col("width") * F.col("hit.bin") / BINS).alias("lo"),
            (F.col("width") / BINS).alias("width"), F.coalesce("hit.words", F.lit(0)).alias("words"),
        )
        state = written(state, "mix-search")
    nearer = F.col("lo") + F.when((F.col("words") > 0) & (F.col("need") > F.col("words") / 2), F.col("width")).otherwise(0.0)
    return state.select(F.col("source").alias("__source"), nearer.alias("threshold"))


def _repaired(chosen: DataFrame) -> DataFrame:
    """Give or take one copy of the document whose size fits best what a source lacks or has too much."""
    for _ in range(REPAIRS):
        lack = chosen.groupBy("source").agg((F.first("target") - F.sum(F.col("size") * F.col("copies"))).alias("lack"))
        able = F.when(F.col("lack") > 0, F.col("copies") < int(CAP)).otherwise(F.col("copies") > 0)
        fits = _with(chosen, lack).where((F.col("size") > 0) & able).withColumn("left", F.abs(F.abs("lack") - F.col("size"))).where("left < abs(lack)")
        best = fits.groupBy("source").agg(F.min(F.struct("left", "doc_id", "row", F.signum("lack").cast("int").alias("step"))).alias("best"))
        step = best.select(F.col("best.row").alias("__row"), F.col("best.step").alias("__step"))
        chosen = chosen.join(step, F.col("row") == F.col("__row"), "left").withColumn("copies", F.col("copies") + F.coalesce("__step", F.lit(0))).drop("__row", "__step")
        chosen = written(chosen, "mix-copies")
    return chosen


def mixed(documents: DataFrame) -> DataFrame:
    """The mix itself: every document as often as its copies, with all its columns and the number of the copy.

    That number is in ``copy``, or in ``copy_`` and so on where the documents have a column of that name.
    """
    name = "copy"
    while name in documents.columns:
        name += "_"
    numbered = with_row_numbers(documents)
    found = copies(numbered).select(F.col("row").alias("__row"), F.col("copies").cast("int").alias("__copies")).where("__copies > 0")
    joined = numbered.join(found, F.col("__doc") == F.col("__row"))
    return joined.select(*documents.columns, F.explode(F.sequence(F.lit(1), F.col("__copies"))).alias(name))


def op9_entropy_mixing(spark, sf_dir: str) -> DataFrame:
    """Contract columns over all documents, with each document's rate and copies."""
    found = copies(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"), "rate", F.col("copies").cast("int").alias("copies"))
