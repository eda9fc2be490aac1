"""Mixing sources to target sizes by entropy balancing, in column expressions.

Targets: sources in code-point order, null last, take weights in turn; they share a multiple of all words, no
source more than `most` times its own words, and what is over is shared again by weight (water filling, in closed
form from the order of the ratios of cap to weight).

Rates: of all rates between 0 and `most` that meet a source's target, those closest in relative entropy to one copy
of every document are min(most, exp(lam * size / mean size)), with one multiplier a source, the dual variable of its
token constraint. Newton steps on that convex dual run for all sources at once over counts of documents by
(source, size), each kept inside a shrinking bracket. Rates are then rounded to whole copies: within a source the
running sum of rates, largest documents first, is rounded, and roundings of equal documents are flipped until what is
left of the target is at most half of any document that could still be flipped. Sums are exact integers, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.scratch import Scratch

# The weights in turn, the share of all words, and the most copies of a document.
WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2
#: Newton rounds end when every source is this close to its target, as a part of it (and two units of a sum).
TOLERANCE = 1e-6
#: So many steps go in one job. A step halves what is off or the next halves the bracket, so far fewer rounds are needed.
STEPS, ROUNDS = 3, 100
#: Documents of equal size in a source are ranked in buckets of about so many.
BUCKET_DOCS = 4096
#: Words are summed in units of 1 / UNIT.
UNIT = 1024

#: A source is named by 0 and its name, or 1 for null, so that keys join and sort as the contract orders sources.
GROUP = ("key", "size", "bucket")


def source_key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("0"), source.cast("string")), F.lit("1"))


def word_count(text: Column) -> Column:
    """Number of runs without space and \\\\t..\\\\r; 0 for null."""
    return F.coalesce(F.size(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")), F.lit(0)).cast("long")


def source_targets(counts: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(key, docs, source_size, target) from (key, size, n); one row a source.

    The windows run over one row a source.
    """
    by = counts.groupBy("key").agg(F.sum("n").alias("docs"), F.sum(F.col("size") * F.col("n")).alias("source_size"))
    points = F.col("key").cast("binary")
    turn = F.pmod(F.row_number().over(Window.orderBy(points.asc())) - 1, F.lit(len(weights)))
    by = by.withColumn("weight", F.get(F.array(*(F.lit(float(w)) for w in weights)), turn)).withColumn("cap", (F.col("source_size") * most).cast("double"))
    everything, order = Window.partitionBy(), Window.orderBy(F.col("cap") / F.col("weight"), points.asc())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    by = by.withColumn("place", F.row_number().over(order))
    by = by.withColumn("left", F.lit(share) * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    by = by.withColumn("open", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    # What a unit of weight gets if all sources before this one are full; the first that it does not fill sets the level.
    unit = F.col("left") / F.col("open")
    level = F.min(F.when(unit * F.col("weight") <= F.col("cap"), F.struct("place", unit.alias("unit")))).over(everything)
    by = by.withColumn("level", level)
    return by.select("key", "docs", "source_size", F.coalesce(F.least("cap", F.col("level.unit") * F.col("weight")), "cap").alias("target"))


def _whole(words: Column) -> Column:
    return F.sum(F.round(words * UNIT).cast("long"))


def _rate(lam: Column, size: Column, scale: Column, most: int) -> Column:
    return F.least(F.lit(float(most)), F.exp(F.least(F.lit(60.0), lam * size / scale)))


def tilts(counts: DataFrame, targets: DataFrame, scratch: Scratch, most: int = MOST) -> DataFrame:
    """(key, scale, lam) for every source: the rates of its documents meet its target.

    scale is the mean size. A target of `most` times the source has the multiplier at which every document is full,
    a target of 0 that at which none is taken.
    """
    scale = F.greatest(F.col("source_size") / F.col("docs"), F.lit(1e-9))
    top = F.log(F.lit(float(most))) * scale + 1e-9
    bottom = F.when(F.col("target") > 0, -F.col("source_size") / (F.col("target") * 2.7) - 1).otherwise(-1e6 * scale)
    closed = F.when(F.col("target") >= F.col("source_size") * most, top).when(F.col("target") <= 0, bottom)
    state = targets.select("key", "target", scale.alias("scale"), F.coalesce(closed, F.lit(0.0)).alias("lam"), bottom.alias("lo"), top.alias("hi"), F.lit(float("inf")).alias("gap"), closed.isNotNull().alias("done"))
    state = scratch.keep(state)
    for _ in range(ROUNDS):
        new = state
        for _ in range(STEPS):
            new = _stepped(new, counts, most)
        new = scratch.keep(new)
        scratch.drop(state)
        state = new
        if state.where("NOT done").isEmpty():
            return state.select("key", "scale", "lam")
    raise RuntimeError("a source does not come to its target")


def _stepped(state: DataFrame, counts: DataFrame, most: int) -> DataFrame:
    """state after a Newton step of every source that is not done, or after halving its bracket if the last step was poor."""
    with_state = counts.where("size > 0").join(state.where("NOT done").select("key", "scale", "lam"), "key")
    words, c = F.col("n") * F.col("size"), F.col("size") / F.col("scale")
    rate = _rate(F.col("lam"), F.col("size"), F.col("scale"), most)
    sums = with_state.groupBy("key").agg((_whole(words * rate) / UNIT).alias("got"), (_whole(F.when(rate < most, words * c * rate).otherwise(0.0)) / UNIT).alias("slope"))
    off = F.col("got") - F.col("target")
    lo, hi = F.when(off < 0, F.col("lam")).otherwise(F.col("lo")), F.when(off > 0, F.col("lam")).otherwise(F.col("hi"))
    step = F.col("lam") - F.try_divide(off, F.col("slope"))
    step = F.when((step > lo) & (step < hi) & (F.abs(off) <= F.col("gap") / 2), step).otherwise((lo + hi) / 2)
    ended = F.col("done") | F.col("got").isNull() | (F.abs(off) <= F.col("target") * TOLERANCE + 2 / UNIT)
    out = state.join(sums, "key", "left")
    return out.select("key", "target", "scale", F.when(ended, F.col("lam")).otherwise(step).alias("lam"), lo.alias("lo"), hi.alias("hi"), F.abs(off).alias("gap"), ended.alias("done"))


def _groups(sized: DataFrame, counts: DataFrame) -> DataFrame:
    """sized (key, size, doc_id, ...) with its bucket: equal sizes of a source in buckets of about BUCKET_DOCS."""
    many = counts.where(F.col("n") > BUCKET_DOCS).select("key", "size", F.ceil(F.col("n") / BUCKET_DOCS).alias("buckets"))
    out = sized.join(many, ["key", "size"], "left")
    return out.withColumn("bucket", F.coalesce(F.pmod(F.xxhash64("doc_id"), F.col("buckets")), F.lit(0)).cast("long")).drop("buckets")


def rounded(groups: DataFrame, targets: DataFrame, scratch: Scratch, most: int = MOST) -> DataFrame:
    """(key, size, bucket, n, rate, copies): groups (key, size, bucket, n, rate) with whole copies in all."""
    run = Window.partitionBy("key").orderBy(F.desc("size"), "bucket").rowsBetween(Window.unboundedPreceding, 0)
    upto = F.sum(F.col("n") * F.col("rate")).over(run)
    low, high = F.col("n") * F.floor("rate"), F.col("n") * F.ceil("rate")
    start = F.floor(upto - F.col("n") * F.col("rate") + 0.5)
    held = scratch.keep(groups.withColumn("copies", F.least(high, F.greatest(low, F.floor(upto + 0.5) - start))))
    # One whole number a source: what is off by half a word either way would be mended forth and back for ever.
    whole = targets.select("key", F.round("target").cast("long").alias("target"))
    while True:
        got = held.groupBy("key").agg(F.sum(F.col("size") * F.col("copies")).alias("got"))
        both = held.join(got.join(whole, "key").select("key", (F.col("target") - F.col("got")).alias("off")), "key")
        # As many of a group's roundings as mend most of what is left; any at all make it less.
        can = F.when(F.col("off") > 0, high - F.col("copies")).otherwise(F.col("copies") - low)
        many = F.least(can, F.floor(F.abs("off") / F.col("size") + 0.5 - 1e-9)).cast("long")
        both = both.where("size > 0").withColumn("many", many).where("many > 0")
        picks = both.groupBy("key").agg(F.min(F.struct(F.abs(F.abs("off") - F.col("many") * F.col("size")).alias("gap"), "size", "bucket", (F.signum("off") * F.col("many")).cast("long").alias("flip"))).alias("p"))
        new = held.join(picks.select("key", "p.size", "p.bucket", "p.flip"), list(GROUP), "left")
        new = scratch.keep(new.select(*GROUP, "n", "rate", (F.col("copies") + F.coalesce("flip", F.lit(0))).alias("copies"), F.col("flip").isNotNull().alias("flipped")))
        scratch.drop(held)
        held = new
        if held.where("flipped").isEmpty():
            return held.drop("flipped")


def mix_copies(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST, carry: str | None = None, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, source, size, source_size, target, rate, copies, taken) for every row of docs (doc_id, text, source).

    size is the number of words of the whole text (null: 0), target that of the row's source, copies a whole number
    from 0 to most, taken = copies * size. A null source is a source of its own, last in order; a source without
    words has target 0. Repeated rows are rows of their own. An empty table gives no rows. carry names a column that
    is passed on; all others are ignored.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "mix")
    full = docs.select(F.col("doc_id").cast("long").alias("doc_id"), source_key(F.col("source")).alias("key"), word_count(F.col("text").cast("string")).alias("size"), *([carry] if carry else []))
    sized = scratch.keep(full.select("doc_id", "key", "size"))
    counts = scratch.keep(sized.groupBy("key", "size").agg(F.count("*").alias("n")))
    targets = scratch.keep(source_targets(counts, weights, share, most))
    lams = tilts(counts, targets, scratch, most)
    groups = _groups(sized, counts).groupBy(*GROUP).agg(F.count("*").alias("n"))
    rated = groups.join(lams, "key").select(*GROUP, "n", _rate(F.col("lam"), F.col("size"), F.col("scale"), most).alias("rate"))
    copies = rounded(rated, targets, scratch, most)
    rank = F.row_number().over(Window.partitionBy(*GROUP).orderBy(F.xxhash64("doc_id"), "doc_id"))
    rows = _groups(full if carry else sized, counts).withColumn("rank", rank)
    rows = rows.join(copies.withColumnRenamed("copies", "all_copies"), list(GROUP)).join(targets, "key")
    own = (F.floor(F.col("all_copies") / F.col("n")) + F.when(F.col("rank") <= F.pmod("all_copies", "n"), 1).otherwise(0)).cast("long")
    source = F.when(F.col("key").startswith("0"), F.substring(F.col("key"), 2, 1 << 30))
    return rows.withColumn("copies", own).select("doc_id", source.alias("source"), "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"), *([carry] if carry else []))


def mix_documents(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """The rows of docs, each as often as mix_copies takes it, with all their columns."""
    held = docs.select("doc_id", "source", "text", F.struct(*docs.columns).alias("_row"))
    mixed = mix_copies(held, weights, share, most, carry="_row").where("copies > 0")
    return mixed.select(F.explode(F.sequence(F.lit(1), F.col("copies"))), "_row").select(*(F.col("_row")[c].alias(c) for c in docs.columns))
