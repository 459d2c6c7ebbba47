"""Operator 2, mixing sources to target weights by entropy balancing.

All steps are DataFrame operations.  Documents are first counted by (source, size):
everything iterative runs over that much smaller table.  Entropy balancing asks for
document rates as near to 1 (in relative entropy) as the token constraint of each source
allows, with no rate above the limit.  The dual has one multiplier per source; the rate of
a document of ``size`` words is ``min(limit, exp(multiplier * size / mean size))``.
Newton's method, kept inside a bracket, finds all multipliers at once.

Rates are then rounded: the copies of a bin (the documents of one source and size) are the
floor or the ceiling of what its rate makes, and so are those of each of its documents.
Running sums over sizes choose which, so that at most half of the largest document is
lacking or over; then the choice is turned for bins, largest first, that make up for it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chainloom.llm.shared import Scratch, word_count

#: Rows of one (source, size) that are ranked together; larger groups are split by a hash.
RANKED = 256
#: Newton steps at most, and the relative error at which they end.
STEPS, TOLERANCE = 60, 1e-7
#: Sources, at most: their targets are found in one task.
SOURCES = 1_000_000
#: Rows of the plan (sources and sizes) that are broadcast, at most; beyond it documents are shuffled to them.
PLAN_ROWS = 1_000_000
#: Passes that turn roundings, at most.
PASSES = 12


def source_targets(sources: DataFrame, limit: float = 3.0) -> DataFrame:
    """Add ``target`` to (source, source_size): weights 1, 2, 3, repeating, by code point (null last).

    Targets share the sum of all sizes by weight; none is above ``limit`` times its
    source's size, and what is over is shared by weight among the others.  The sources that
    stop are those with the least size per weight, so one sorted pass finds them.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    weighted = sources.withColumn("weight", (F.row_number().over(order) - 1) % 3 + 1).withColumn("most", limit * F.col("source_size"))
    by_room = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").isNull(), "source")
    every = Window.partitionBy()
    # the level (target per weight) if this source and those with more room don't stop
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("most").over(by_room.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))) / F.sum("weight").over(
        by_room.rowsBetween(0, Window.unboundedFollowing)
    )
    found = weighted.withColumn("level", level).withColumn("stops", F.col("most") <= F.col("weight") * F.col("level"))
    # stops holds for a beginning of the order; the first that doesn't stop sets the level of all after it
    shared = found.withColumn("shared", F.min(F.when(~F.col("stops"), F.struct(F.col("most") / F.col("weight"), "level"))).over(every)["level"])
    return shared.select("source", "source_size", F.when(F.col("stops"), F.col("most")).otherwise(F.col("weight") * F.col("shared")).cast("double").alias("target"))


def _rate(limit: float):
    return F.when(F.col("full"), F.lit(limit)).otherwise(F.least(F.lit(limit), F.exp(F.least(F.lit(50.0), F.col("multiplier") * F.col("size") / F.col("mean")))))


def _exact_sum(x):
    """A sum of millionths as whole numbers: the same in whatever order rows come, so reruns agree."""
    return F.sum((x * 1e6).cast("decimal(38,0)")).cast("double") / 1e6


def balance(bins: DataFrame, targets: DataFrame, limit: float = 3.0) -> DataFrame:
    """(key, multiplier, mean, full, target) per source, where the words at its rates meet its target.

    ``bins``: (key, size, n).  ``targets``: (key, target, source_size).  ``full`` marks
    sources whose target is their limit: all rates are the limit.  Raises RuntimeError if
    a target isn't met, within TOLERANCE, after STEPS steps.
    """
    scratch = Scratch(bins.sparkSession, "balance")
    means = bins.where("size > 0").groupBy("key").agg((F.sum(F.col("n") * F.col("size")) / F.sum("n")).alias("mean"))
    state = scratch.write(
        targets.join(means, "key").select(
            "key",
            "target",
            "mean",
            (F.col("target") >= limit * F.col("source_size") * (1 - 1e-9)).alias("full"),
            F.lit(0.0).alias("multiplier"),
            F.lit(float("-inf")).alias("low"),
            F.lit(float("inf")).alias("high"),
            F.lit(float("inf")).alias("error"),
        )
    )
    for _ in range(STEPS):
        here = bins.where("size > 0").join(state.where(~F.col("full")), "key")
        rate, weight = _rate(limit), F.col("n") * F.col("size")
        slope = F.when(rate < limit, weight * rate * F.col("size") / F.col("mean")).otherwise(0.0)
        sums = here.groupBy("key").agg(_exact_sum(weight * rate).alias("words"), _exact_sum(slope).alias("slope"))
        new = state.join(sums, "key", "left")
        off = F.col("words") - F.col("target")
        low = F.when(off < 0, F.col("multiplier")).otherwise(F.col("low"))
        high = F.when(off > 0, F.col("multiplier")).otherwise(F.col("high"))
        step = F.col("multiplier") - off / F.col("slope")
        inside = (F.col("slope") > 0) & (step > low) & (step < high)
        # outside the bracket: halve it, or double the way to its open end
        other = (
            F.when((low > float("-inf")) & (high < float("inf")), (low + high) / 2)
            .when(off < 0, F.greatest(F.lit(1.0), 2 * F.col("multiplier")))
            .otherwise(F.least(F.lit(-1.0), 2 * F.col("multiplier")))
        )
        error = F.coalesce(F.abs(off) / F.greatest(F.col("target"), F.lit(1.0)), F.lit(0.0))
        done = F.col("full") | (error <= TOLERANCE)
        before, state = state, scratch.write(
            new.select("key", "target", "mean", "full", F.when(done, F.col("multiplier")).when(inside, step).otherwise(other).alias("multiplier"), low.alias("low"), high.alias("high"), error.alias("error"))
        )
        scratch.remove(before)
        if state.where(~F.col("full") & (F.col("error") > TOLERANCE)).isEmpty():
            return state
    raise RuntimeError(f"targets are not met after {STEPS} steps")


def _rounded(rated: DataFrame, scratch: Scratch) -> DataFrame:
    """(key, size, n, rate, copies): copies of each bin, the floor or the ceiling of n * rate.

    By size, a bin takes its ceiling where the running sum of fractions passes a half.  So
    the bins so far never have more than half a document too much or too few, and a source
    at most half of its largest one in words.  Then bins are turned, from the largest
    that is not too large on, as long as they make up for what is lacking or over, and at last
    bins against one another.  Windows hold one row per distinct size of a source, however many documents it has.
    """
    by_size = Window.partitionBy("key").orderBy(F.desc("size"))
    exact = F.col("n") * F.col("rate")
    parts = rated.withColumn("low", F.floor(exact + 1e-9)).withColumn("part", F.greatest(exact - F.col("low"), F.lit(0.0)))
    parts = parts.withColumn("part", F.when(F.col("part") < 1e-9, 0.0).otherwise(F.col("part")))
    sums = parts.withColumn("total", F.sum("part").over(by_size.rowsBetween(Window.unboundedPreceding, 0)))
    up = (F.floor(F.col("total") + 0.5) > F.floor(F.col("total") - F.col("part") + 0.5)) & (F.col("part") > 0)
    plan = scratch.write(sums.select("key", "size", "n", "rate", "low", "part", up.alias("up")))
    for _ in range(PASSES):
        # words that are lacking (over, if less than 0), as whole numbers of millionths so that reruns agree
        over = F.when(F.col("up"), 1 - F.col("part")).otherwise(-F.col("part")) * F.col("size")
        lacks = plan.groupBy("key").agg((-_exact_sum(over)).alias("lack"))
        could = plan.join(lacks, "key").withColumn("helps", (F.col("part") > 0) & (F.col("up") == (F.col("lack") < 0))).withColumn("lack", F.abs("lack"))
        fits = F.col("helps") & (F.col("size") <= F.col("lack"))
        run = F.sum(F.when(fits, F.col("size")).otherwise(0)).over(by_size.rowsBetween(Window.unboundedPreceding, 0))
        could = scratch.write(could.withColumn("turn", fits & (run <= F.col("lack"))))
        swaps = _swaps(could.join(could.where("turn").select("key").distinct(), "key", "left_anti"))
        new = could.join(swaps.withColumn("swap", F.lit(True)), ["key", "size"], "left").withColumn("turn", F.col("turn") | F.coalesce("swap", F.lit(False)))
        before, plan = plan, scratch.write(new.select("key", "size", "n", "rate", "low", "part", (F.col("up") != F.col("turn")).alias("up"), "turn"))
        scratch.remove(before, could)
        if plan.where("turn").isEmpty():
            break
    return plan.select("key", "size", "n", "rate", (F.col("low") + F.col("up").cast("int")).cast("bigint").alias("copies"))


def _swaps(could: DataFrame) -> DataFrame:
    """(key, size) of bins to be turned: one that helps too much, with one that undoes most of what is too much, or alone.

    Each bin that helps looks for the nearest size to its surplus among the bins that would
    undo it: a window over both in order, with size 0 standing for none.
    """
    undo = could.where("part > 0 and not helps").select("key", F.col("size").cast("double").alias("at"), F.lit(None).cast("bigint").alias("size"), "lack", F.col("size").alias("other"))
    none = could.select("key", F.lit(0.0).alias("at"), F.lit(None).cast("bigint").alias("size"), "lack", F.lit(0).cast("bigint").alias("other")).distinct()
    helps = could.where("helps").select("key", (F.col("size") - F.col("lack")).alias("at"), "size", "lack", F.lit(None).cast("bigint").alias("other"))
    order = Window.partitionBy("key").orderBy("at", F.col("size").isNotNull())
    below = F.last("other", True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    above = F.first("other", True).over(order.rowsBetween(0, Window.unboundedFollowing))
    looked = undo.unionByName(none).unionByName(helps).select("key", "at", "size", "lack", below.alias("below"), above.alias("above"))
    found = looked.select("key", "at", "size", "lack", F.explode(F.array("below", "above")).alias("near")).where("size is not null and near is not null")
    off = F.abs(F.col("at") - F.col("near"))
    best = found.groupBy("key").agg(F.min(F.struct(off.alias("off"), "size", "near", "lack")).alias("b")).where("b.off < b.lack - 1e-3")
    return best.select("key", F.explode(F.array("b.size", "b.near")).alias("size")).where("size > 0")


def _place():
    """Where a row stands among those of its bin: parts are a hash's, so that hot bins are ranked in many tasks."""
    return F.struct("part", F.col("doc_id").isNotNull().alias("known"), "doc_id", "sig")


def _plan(docs: DataFrame, doc_id: str, text: str, source: str, limit: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (doc_id, source, key, size, sig), targets by key, and the plan.

    The plan has of each bin with words: n, rate, ``base`` (copies of each document),
    ``parts``, and ``cut``: documents that stand before it are taken once more.  Of the
    ``cut_rows`` equal rows that stand at it, ``cut_more`` are.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    key = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n"))
    sized = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(text).alias("size"), F.xxhash64(text).alias("sig"))
    sized = scratch.write(sized.withColumn("key", key))
    counted = scratch.write(sized.groupBy("source", "key", "size").agg(F.count("*").alias("n")))
    totals = scratch.write(counted.groupBy("source", "key").agg(F.sum(F.col("n") * F.col("size")).alias("source_size")))
    if totals.count() > SOURCES:
        raise ValueError(f"there are more than {SOURCES} sources")
    targets = scratch.write(source_targets(totals.drop("key"), limit).withColumn("key", key))
    bins = counted.where("size > 0").select("key", "size", "n")
    state = balance(bins, targets, limit)
    plan = _rounded(bins.join(state, "key").select("key", "size", "n", _rate(limit).alias("rate")), scratch)
    parts = F.ceil(F.col("n") / RANKED)
    plan = scratch.write(plan.select("*", F.floor(F.col("copies") / F.col("n")).alias("base"), (F.col("copies") % F.col("n")).alias("more"), parts.alias("parts")))

    # of bins where some documents are taken once more: the part in which the last of those stands, and its place there
    bin_ = ["key", "size"]
    dealt = sized.join(plan.where("more > 0").select(*bin_, "more", "parts"), bin_).withColumn("part", F.pmod(F.xxhash64("doc_id", "sig"), F.col("parts")))
    rows = scratch.write(dealt.groupBy(*bin_, "part", "more").agg(F.count("*").alias("rows")))
    run = F.sum("rows").over(Window.partitionBy(*bin_).orderBy("part"))
    at = rows.withColumn("before", run - F.col("rows")).where((F.col("before") < F.col("more")) & (F.col("more") <= F.col("before") + F.col("rows")))
    at = scratch.write(at.select(*bin_, "part", (F.col("more") - F.col("before")).alias("rest")))
    same = dealt.join(at, [*bin_, "part"]).groupBy(*bin_, "part", "doc_id", "sig", "rest").agg(F.count("*").alias("rows"))
    run = F.sum("rows").over(Window.partitionBy(*bin_).orderBy(_place()))
    cuts = same.withColumn("before", run - F.col("rows")).where((F.col("before") < F.col("rest")) & (F.col("rest") <= F.col("before") + F.col("rows")))
    cuts = scratch.write(cuts.select(*bin_, _place().alias("cut"), F.col("rows").alias("cut_rows"), (F.col("rest") - F.col("before")).alias("cut_more")))
    plan = scratch.write(plan.join(cuts, bin_, "left").join(targets.select("key", "source", "source_size", "target"), "key"))
    return sized, targets, plan


def _planned(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Rows (doc_id, key, size, sig) with their bin's plan and ``copies``; null copies for rows equal to a cut that splits them."""
    held = plan.drop("source")
    held = F.broadcast(held) if held.count() <= PLAN_ROWS else held
    joined = rows.join(held, ["key", "size"]).withColumn("part", F.pmod(F.xxhash64("doc_id", "sig"), F.col("parts")))
    place, tied = _place(), F.col("cut_more") < F.col("cut_rows")
    more = F.when(F.col("cut").isNull() | (place > F.col("cut")), 0).when((place < F.col("cut")) | ~tied, 1)
    return joined.withColumn("copies", F.col("base") + more)


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", limit: float = 3.0) -> DataFrame:
    """(doc_id, source, size, source_size, target, rate, copies, taken) for every document.

    Null texts and texts of no words have size 0 and are taken 0 words; a null source is a
    source of its own, last in order.  ``taken`` = copies * size; copies are the floor or
    the ceiling of the rate, so at most ``limit`` (a whole number then).  Equal rows may
    differ by one copy; which of several rows with equal (source, size) gets one more goes
    by hashes of doc_id and text, so reruns agree.  Null doc_ids are like any other;
    repeated rows count as that many documents; an empty table gives an empty table.
    Raises ValueError for more than SOURCES sources.
    """
    sized, targets, plan = _plan(docs, doc_id, text, source, limit)
    columns = ["doc_id", "source", "size", "source_size", "target", "rate", "copies"]
    taken = _planned(sized.where("size > 0"), plan).where("copies is not null")
    # rows that are equal to one another, of which some are taken once more, are told off from their number
    equal = plan.where("cut_more < cut_rows").withColumn("k", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("cut_rows"))))
    equal = equal.select(F.col("cut.doc_id").alias("doc_id"), *columns[1:-1], (F.col("base") + (F.col("k") <= F.col("cut_more")).cast("int")).alias("copies"))
    none = sized.where("size = 0").drop("source").join(targets, "key").withColumn("rate", F.lit(0.0)).withColumn("copies", F.lit(0).cast("bigint"))
    every = taken.select(*columns).unionByName(equal).unionByName(none.select(*columns))
    return every.withColumn("taken", (F.col("copies") * F.col("size")).cast("long"))


def apply_mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", limit: float = 3.0) -> DataFrame:
    """The documents as the mix takes them: each row as often as its copies say, rows of none go.

    Documents stay where they are read, unless the plan is too large to broadcast.
    """
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    at = dict(zip(docs.columns, plain.columns))
    _, _, plan = _plan(docs, doc_id, text, source, limit)
    key = F.coalesce(F.concat(F.lit("s"), F.col(at[source]).cast("string")), F.lit("n"))
    rows = plain.withColumns({"doc_id": F.col(at[doc_id]), "key": key, "size": word_count(at[text]), "sig": F.xxhash64(at[text])})
    planned = _planned(rows.where("size > 0"), plan)
    often = lambda n: F.explode(F.sequence(F.lit(1).cast("bigint"), n))
    taken = planned.where("copies > 0").withColumn("copy", often(F.col("copies"))).select(*plain.columns)
    if not plan.where("cut_more < cut_rows").isEmpty():  # of equal rows: one, as often as all of them
        one = planned.where("copies is null").groupBy("key", "size").agg(F.first(F.struct(*plain.columns)).alias("row"), F.first(F.col("cut_rows") * F.col("base") + F.col("cut_more")).alias("all"))
        taken = taken.unionByName(one.where("all > 0").withColumn("copy", often(F.col("all"))).select("row.*"))
    return taken.select(*plain.columns).toDF(*docs.columns)


def op2_mix_sources(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken", "rate", "copies")
