"""Mixing sources to target weights by a time-varying curriculum, in DataFrame operations only.

Each source has a weight schedule over training time 0 to 1, linear between its knots. The area
under it is the source's weight, so the schedules fix both how many words each source gives and
when: the demand met up to time t is the target times the share of the area up to t. A source's
documents stand in an order of hashed ids; the words that the mix takes of them fill its target
one after the other, and the time at which the demand reaches the middle of a document's words is
the document's training position. The mix is the documents range-sorted by position.

Running sums are made in two levels, over hashed buckets of a source and then within a bucket, so
no task sees a whole source. Only ids, sources and sizes are shuffled; texts or other columns that
the caller keeps go once to their place and once more to the order of positions. `copies` gives a
row for each time that a document is taken, in training order.

Defined results: a null text has size 0 and nothing is taken of it; a null source is one source,
last in the order; repeated rows are counted one by one (rows with the same id share an order, ties
going to the larger size first); a text of any length is counted whole; where all sizes are 0 every target is 0; an empty table gives an
empty result. Columns named like the results are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from unspool.llm.common import WORD, materialize, shuffle_partitions

#: Weights of the sources in order, repeating.
WEIGHTS = (3.0, 1.0, 2.0)
#: Shapes of the schedules, repeating: early, even and late in training. Knots (time, height); each has area 1.
SHAPES = (((0.0, 1.6), (0.5, 1.0), (1.0, 0.4)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.4), (0.5, 1.0), (1.0, 1.6)))


_RESULTS = ("doc_id", "source", "size", "source_size", "target", "taken", "positions", "position")


def size_of(text: Column) -> Column:
    """Number of words: maximal runs without white space."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def integrate(knots: tuple[tuple[float, float], ...]) -> float:
    """The area under a schedule that is linear between its knots."""
    return sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:], strict=False))


def invert(share: Column, knots: tuple[tuple[float, float], ...]) -> Column:
    """The time at which a schedule's area reaches `share` of the whole."""
    total, done, out = integrate(knots), 0.0, None
    for (t0, h0), (t1, h1) in zip(knots, knots[1:], strict=False):
        area = (t1 - t0) * (h0 + h1) / 2
        need = F.greatest(share * total - F.lit(done), F.lit(0.0))
        twice_slope = 2 * (h1 - h0) / (t1 - t0)
        at = F.lit(t0) + (2 * need / (F.lit(h0) + F.sqrt(F.greatest(F.lit(h0 * h0) + twice_slope * need, F.lit(0.0)))) if area else F.lit(0.0))
        at = F.least(at, F.lit(t1))
        out = F.when(share * total <= done + area, at) if out is None else out.when(share * total <= done + area, at)
        done += area
    return out.otherwise(F.lit(knots[-1][0]))


def _ranked(sources: DataFrame) -> DataFrame:
    """sources with rank, their place by code point, null last: each range of names is numbered alone, after those of the ranges before."""
    spark = sources.sparkSession
    order = [F.col("source").isNull(), F.col("source").cast("binary")]
    ranged = sources.repartitionByRange(shuffle_partitions(spark), *order).withColumn("part", F.spark_partition_id())
    ranged = materialize(ranged, "mix-sources")
    # One number for each range reaches the driver, never one for each source.
    counts = {r["part"]: r["count"] for r in ranged.groupBy("part").count().collect()}
    before, at = [], 0
    for part in sorted(counts):
        before += [F.lit(part), F.lit(at)]
        at += counts[part]
    start = F.element_at(F.create_map(*before), F.col("part")) if before else F.lit(0)
    return ranged.withColumn("rank", (F.row_number().over(W.partitionBy("part").orderBy(*order)) - 1 + start).cast("int")).drop("part")


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, ceiling: float = 2.0, shapes: tuple = SHAPES) -> DataFrame:
    """One row per source: its place, weight and target.

    sources: (source, source_size), a row for each. A target stops at `ceiling` times its source's
    size; what it leaves goes to the others by weight. The level of targets per weight at which all
    is given out only rises as sources fill up, so it is found by a few sums over all sources.
    """
    # The schedules' areas scale the weights.
    area = F.element_at(F.array(*[F.lit(integrate(s)) for s in shapes]), F.col("rank") % len(shapes) + 1)
    own = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("rank") % len(weights) + 1) * area
    ranked = materialize(_ranked(sources).withColumn("weight", own).withColumn("most", F.col("source_size") * F.lit(float(ceiling))), "mix-ranks")
    total = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("size")).first()["size"] * share
    level, full = None, -1
    while True:
        # Full are the sources whose ceiling is under the level; the others share what those leave.
        is_full = F.lit(False) if level is None else F.col("weight") * F.lit(level) >= F.col("most")
        sums = ranked.agg(F.count_if(is_full).alias("full"), F.sum(F.when(is_full, F.col("most"))).alias("given"), F.sum(F.when(~is_full, F.col("weight"))).alias("open")).first()
        if sums["full"] == full or not sums["open"]:
            break
        level, full = (total - (sums["given"] or 0.0)) / sums["open"], sums["full"]
    target = F.col("most") if level is None or not sums["open"] else F.least(F.col("most"), F.col("weight") * F.lit(level))
    return ranked.select("source", "source_size", "rank", "weight", target.cast("double").alias("target"))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, ceiling: float = 2.0, shapes: tuple = SHAPES, buckets: int = 0, keep: list[str] | None = None) -> DataFrame:
    """doc_id, size, source_size, target, taken, positions and (the first of them) position of every row of docs, range-sorted by position.

    keep: further columns of docs to return, and source with them, such as the text. buckets:
    hashed parts of each source for the running sums; by default four for each shuffle partition.
    """
    keep = [c for c in keep or [] if c not in _RESULTS]
    spark = docs.sparkSession
    buckets = buckets or 4 * shuffle_partitions(spark)
    order = F.coalesce(F.md5(F.col("doc_id").cast("string").cast("binary")), F.lit(""))
    # The first 28 bits of the key choose the bucket, so the order of buckets is the order of keys.
    first = F.coalesce(F.conv(F.substring(order, 1, 7), 16, 10).cast("long"), F.lit(0))
    name = F.when(F.col("source").isNull(), "").otherwise(F.concat(F.lit("="), F.col("source").cast("string")))
    named = docs.select("doc_id", "source", size_of(F.col("text")).alias("size"), *([F.struct(*keep).alias("kept")] if keep else []))
    named = named.withColumns({"key": order, "bucket": F.shiftright(first * F.lit(buckets), 28).cast("int"), "name": name})
    sizes = materialize(named.drop("kept"), "mix-sizes")
    parts = sizes.groupBy("source", "name", "bucket").agg(F.sum("size").alias("bucket_size"))
    parts = materialize(parts, "mix-buckets")
    goal = targets(parts.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), weights, share, ceiling, shapes)
    within = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.withColumn("bucket_start", F.coalesce(F.sum("bucket_size").over(within), F.lit(0)))
    starts = parts.alias("p").join(goal.alias("g"), F.col("p.source").eqNullSafe(F.col("g.source"))).select("name", "bucket", "bucket_start", "source_size", "rank", "target")
    # The start of each bucket meets its documents by an ordinary join, as both grow with the input;
    # the running sums within a bucket keep the join's partitions.
    rows = (named if keep else sizes).join(starts, ["name", "bucket"])
    inner = W.partitionBy("name", "bucket").orderBy("key", F.desc("size"), "doc_id").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("begin", F.col("bucket_start") + F.coalesce(F.sum("size").over(inner), F.lit(0)))
    # Whole rounds of the source first, then the part of a round that is left.
    goal_words = F.round("target").cast("long")
    rounds = F.when(F.col("source_size") > 0, F.floor(goal_words / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = goal_words - rounds * F.col("source_size")
    last = F.least(F.greatest(rest - F.col("begin"), F.lit(0)), F.col("size"))
    taken = (rounds * F.col("size") + last).cast("long")
    # Each round that a document is taken in has its own time: that of the middle of its words there.
    def time(k: Column) -> Column:
        middle = k * F.col("source_size") + F.col("begin") + F.when(k < rounds, F.col("size")).otherwise(last) / 2
        share_of = F.when(F.col("target") > 0, F.least(middle / F.col("target"), F.lit(1.0))).otherwise(F.lit(1.0))
        when = F.lit(None).cast("double")
        for place, knots in enumerate(shapes):
            when = F.when(F.col("rank") % len(shapes) == place, invert(share_of, knots)).otherwise(when)
        return when

    rows = rows.withColumns({"taken": taken, "copies": rounds.cast("int") + (last > 0).cast("int"), "rounds": rounds})
    times = F.when((F.col("copies") > 0) & (F.col("size") > 0), F.transform(F.sequence(F.lit(0), F.col("copies") - 1), time)).otherwise(F.array().cast("array<double>"))
    out = rows.select("doc_id", *(["source", "kept.*"] if keep else []), "size", F.col("source_size").cast("long").alias("source_size"), "target", "taken", times.alias("positions"))
    # What the mix doesn't take stands at the end.
    out = out.withColumn("position", F.coalesce(F.get("positions", F.lit(0)), F.lit(1.0)))
    return out.repartitionByRange(shuffle_partitions(spark), "position", "doc_id").sortWithinPartitions("position", "doc_id")


def copies(mixed: DataFrame) -> DataFrame:
    """The curriculum: a row for each time that mix() takes a document, with copy (from 1), words (what that copy gives) and its position, range-sorted by position.

    The last copy may be a part of the document: its first `words` words.
    """
    other = [c for c in mixed.columns if c not in ("positions", "position")]
    each = mixed.select(*other, F.posexplode("positions").alias("copy", "position")).withColumn("copy", F.col("copy") + 1)
    # Whole copies give all words; the last gives what is left of those taken.
    each = each.withColumn("words", F.least(F.col("size"), F.col("taken") - (F.col("copy") - 1) * F.col("size")))
    return each.repartitionByRange(shuffle_partitions(mixed.sparkSession), "position", "doc_id").sortWithinPartitions("position", "doc_id")
