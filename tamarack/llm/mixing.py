"""Mixing sources to target shares of the total size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tamarack.operators.bounded import small
from tamarack.session import cut

#: Bits of the hash that one refinement looks at: a histogram has at most 2**16 rows a source.
_BITS = 16


def mix(documents: DataFrame, targets: DataFrame, *, doc_id: str, source: str, size: str, target_source: str = "source", share: str = "target_share", most: str = "max_repeats") -> tuple[DataFrame, DataFrame]:
    """Documents with the number of copies to use of each, and a report of the shares reached.

    Returns (chosen, report). chosen: ``doc_id``, ``source``, size and copies (1 or more).
    report, one row for each target: source, target_share, reached_share, max_repeats,
    available (size of the source), budget, used (size with copies), documents (used at least
    once), copies_from and copies_to (fewest and most copies of a document that is used).

    The mixture is the largest whose shares all hold: the source that is scarcest against its
    share is used ``most`` times throughout, and every other source gets its share of the same
    total: all its documents as often as the budget holds them, and once more those whose hash
    lies below a threshold. The threshold comes from sums of sizes by source and hash bucket;
    only the bucket in which the budget ends is read again and refined, until it holds one hash.
    Nothing is sorted but the buckets, at most 2**16 a source. The budget is met up to half
    of the last document's size (documents with the same hash are taken together).

    Sources without documents reach no share and don't hold back the others. Left out:
    documents with null source, source without target, null id, or null or no size; targets with
    null source, and (reported with a budget of 0) with null or no share or repeats. Repeated
    document rows count once, repeated targets once (the largest share). Empty tables give an
    empty choice.
    """
    goals = targets.select(F.col(target_source).alias("source"), F.coalesce(F.col(share).cast("double"), F.lit(0.0)).alias("target_share"), F.coalesce(F.col(most).cast("int"), F.lit(0)).alias("max_repeats"))
    goals = cut(goals.dropna(subset=["source"]).groupBy("source").agg(F.max(F.struct("target_share", "max_repeats")).alias("x")).select("source", "x.*"))
    sized = documents.select(F.col(doc_id).alias("id"), F.col(source).alias("source"), F.col(size).cast("long").alias("size")).dropna().where("size > 0")
    sized = cut(sized.join(small(goals.select("source")), "source", "left_semi").distinct().withColumn("hash", F.xxhash64("id")))
    total = sized.groupBy("source").agg(F.sum("size").alias("available"))
    plan = goals.join(total, "source", "left").withColumn("available", F.coalesce("available", F.lit(0).cast("long")))
    able = (F.col("available") > 0) & (F.col("target_share") > 0) & (F.col("max_repeats") > 0)
    whole = plan.where(able).agg(F.min(F.col("max_repeats") * F.col("available") / F.col("target_share")).alias("whole"))
    plan = plan.crossJoin(F.broadcast(whole))  # one row
    plan = plan.withColumn("budget", F.when(able, F.round(F.col("target_share") * F.col("whole")).cast("long")).otherwise(F.lit(0).cast("long")))
    plan = plan.withColumn("full", F.when(F.col("budget") > 0, F.expr("least(budget div available, cast(max_repeats as long))")).otherwise(F.lit(0).cast("long")))
    plan = plan.withColumn("rest", F.when(F.col("full") < F.col("max_repeats"), F.col("budget") - F.col("full") * F.col("available")).otherwise(F.lit(0).cast("long")))
    plan = cut(plan.drop("whole"))

    # The bucket in which each source's rest ends; 'rest' is what is left for it. Only the first round reads all documents, the
    # others what lies in such a bucket, until each holds one hash.
    edge, inside = plan.where("rest > 0").select("source", "rest"), sized
    for shift in range(64 - _BITS, -1, -_BITS):
        bucket = F.shiftright("hash", shift)
        sums = inside.join(small(edge.select("source", "rest")), "source").groupBy("source", "rest", bucket.alias("bucket")).agg(F.sum("size").alias("size"), F.min("hash").alias("low"), F.max("hash").alias("high"))
        so_far = F.sum("size").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
        ends = sums.withColumn("end", so_far).where("end >= rest").groupBy("source").agg(F.min(F.struct("bucket", "rest", "end", "size", "low", "high")).alias("x"))
        edge = cut(ends.select("source", F.col("x.bucket").alias("prefix"), (F.col("x.rest") - (F.col("x.end") - F.col("x.size"))).alias("rest"), F.col("x.size").alias("last"), F.col("x.low").alias("low"), F.col("x.high").alias("high")))
        if edge.where("low < high").isEmpty():
            break
        inside = cut(inside.join(small(edge.select("source", "prefix")), "source").where(bucket == F.col("prefix")).drop("prefix"))
    last = edge.select("source", F.col("high").alias("threshold"), (2 * F.col("rest") >= F.col("last")).alias("with_last"))

    rule = plan.select("source", "full").join(last, "source", "left")
    once_more = F.coalesce((F.col("hash") < F.col("threshold")) | ((F.col("hash") == F.col("threshold")) & F.col("with_last")), F.lit(False))
    chosen = sized.join(small(rule), "source").select(F.col("id").alias(doc_id), F.col("source").alias(source), "size", (F.col("full") + once_more.cast("long")).cast("int").alias("copies")).where("copies > 0")

    used = chosen.groupBy(F.col(source).alias("source")).agg(
        F.sum(F.col("size") * F.col("copies")).alias("used"), F.count("*").alias("documents"), F.min("copies").alias("copies_from"), F.max("copies").alias("copies_to")
    )
    zero = F.lit(0).cast("long")
    report = plan.join(used, "source", "left").withColumn("used", F.coalesce("used", zero))
    everything = report.agg(F.sum("used").alias("everything"))
    report = report.crossJoin(F.broadcast(everything)).select(
        "source", "target_share", F.coalesce(F.try_divide(F.col("used").cast("double"), F.col("everything")), F.lit(0.0)).alias("reached_share"), "max_repeats", "available", "budget", "used",
        F.coalesce("documents", zero).alias("documents"), F.coalesce("copies_from", F.lit(0)).alias("copies_from"), F.coalesce("copies_to", F.lit(0)).alias("copies_to"),
    )
    return chosen, report
