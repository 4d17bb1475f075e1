"""Mixing of sources to target weights by Pareto order sampling.

Targets: sources share the total size by weight; a target stops at `most` times its source's size and the excess is
shared anew by weight. Every document then expects target / source size copies. The whole part is allocated for
certain. The fraction f is an inclusion probability: documents get the ranking number q = (u / (1-u)) / (f / (1-f))
from a uniform u, and those with the smallest q are taken until the source's remaining size is filled, which is a
sample of fixed size in words. u is derived from doc_id and text, so reruns agree.

The sum over the ranking is not made by sorting a source: sizes are added up in bins of q (map-side combined), the
bin in which the remaining size is reached is found among the bins, and only rows of that bin are sorted.

The first document that overshoots ends a pass over the ranking. The next pass goes on behind it, over the documents
that still fit the open gap, until none does; then the one that comes nearest to the target may overshoot it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paylens.llm.common import WORD, written

WEIGHTS = (5, 2, 1)
MOST = 3
BINS = 4096
SEED = "mix-1"
_KEY = ("q", "doc_id", "size", "h")
_KEY_TYPE = "struct<q:double,doc_id:bigint,size:bigint,h:bigint>"
_PASSES = f"array<struct<after:{_KEY_TYPE},at_most:bigint,until:{_KEY_TYPE}>>"
_ADDED = ("size", "source_size", "target", "copies", "taken")


def word_count(text: Column) -> Column:
    """Number of words; null or empty: 0."""
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))), F.lit(0)).cast("long")


def uniform(doc_id: Column, text: Column, seed: str = SEED) -> Column:
    """A number in (0, 1) from 48 bits of a hash of id and text: rows without an id, or of one id, differ by their texts."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(text, F.lit("")))))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def _rank(u: Column, f: Column) -> Column:
    """Random odds divided by inclusion odds."""
    return u / (1 - u) / (f / (1 - f))


def _is_in(row: Column, passes: Column, fillers: Column) -> Column:
    """Whether a row (q, doc_id, size, h) lies in one of the passes over the ranking, or fills."""
    after = lambda p: p["after"].isNull() | (row > p["after"])
    before = lambda p: p["until"].isNull() | (row < p["until"])
    small = lambda p: p["at_most"].isNull() | (row["size"] <= p["at_most"])
    return F.coalesce(F.exists(passes, lambda p: after(p) & before(p) & small(p)) | F.array_contains(fillers, row), F.lit(False))


def _next_pass(left: DataFrame) -> DataFrame | None:
    """(_s, until, used): the first row of left (_s, gap, bin, key columns) that overshoots the gap, null if all fit, and the words before it.

    None if left has no rows.
    """
    order = Window.partitionBy("_s").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    sums = left.groupBy("_s", "bin").agg(F.sum("size").alias("s"), F.first("gap").alias("gap")).withColumn("below", F.coalesce(F.sum("s").over(order), F.lit(0)))
    over = F.min(F.when(F.col("below") + F.col("s") > F.col("gap"), F.struct("bin", "below"))).alias("edge")
    edges = written(sums.groupBy(F.col("_s").alias("_t")).agg(over, F.sum("s").alias("all")), "mix-edges")
    if edges.isEmpty():
        return None
    key = F.struct(*_KEY)
    total = F.col("edge.below") + F.sum("size").over(Window.partitionBy("_s").orderBy(key).rangeBetween(Window.unboundedPreceding, 0))
    in_edge = left.join(edges, F.col("_s").eqNullSafe(F.col("_t")) & (F.col("bin") == F.col("edge.bin"))).withColumn("total", total)
    fits = F.col("total") <= F.col("gap")
    found = in_edge.groupBy("_s").agg(F.min(F.when(~fits, key)).alias("until"), F.coalesce(F.max(F.when(fits, F.col("total"))), F.first("edge.below")).alias("used"))
    found = edges.join(found, F.col("_t").eqNullSafe(F.col("_s")), "left")
    return found.select(F.col("_t").alias("_s"), "until", F.coalesce("used", "all").alias("used"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """sizes (source, source_size) with weight and target.

    Sources are weighted in code point order, null last. Filling by weight until caps bind: in order of cap / weight, a source is at its cap if the level that the
    remaining total gives to the remaining weights reaches its cap. One row for each source is sorted here.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*map(F.lit, weights))
    named = sizes.withColumn("weight", F.element_at(cycle, ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")).cast("long"))
    everything = Window.partitionBy()
    ranked = Window.orderBy((F.col("source_size") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = ranked.rowsBetween(Window.unboundedPreceding, -1)
    left = (
        named.withColumn("total", F.sum("source_size").over(everything))
        .withColumn("rest", F.col("total") - most * F.coalesce(F.sum("source_size").over(before), F.lit(0)))
        .withColumn("rest_weight", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    )
    capped = most * F.col("source_size") * F.col("rest_weight") <= F.col("rest") * F.col("weight")
    # The first source below its cap sees the final level, which holds for all later ones.
    by_level = F.struct((F.col("source_size") / F.col("weight")).alias("at"), "rest", "rest_weight")
    first_free = F.min(F.when(~capped, by_level)).over(everything)
    return (
        left.withColumn("capped", capped)
        .withColumn("free", first_free)
        .withColumn(
            "target",
            F.when(F.col("capped"), (most * F.col("source_size")).cast("double")).otherwise(
                F.col("weight") * F.col("free.rest") / F.col("free.rest_weight")
            ),
        )
        .select("source", "source_size", "weight", "target")
    )


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, bins: int = BINS, seed: str = SEED) -> DataFrame:
    """docs with size, source_size, target, copies and taken (= copies * size), replacing columns of these names.

    Documents without words take 0 words. A null source is one source. Documents of equal rank are ordered by doc_id,
    size and text hash; rows equal in all of these are taken alike. The documents that fit in order are in, and all
    behind them that fit the gap then left; the one whose size is nearest to the last gap may overshoot it.
    Empty input gives no rows.
    """
    others = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in _ADDED]
    base = docs.select(F.struct(*others).alias("_row"), "doc_id", "text", "source").withColumn("size", word_count(F.col("text")))
    rank_key = [F.col("doc_id"), F.col("size"), F.xxhash64("text").alias("h")]
    sized = written(base.select("source", *rank_key, uniform(F.col("doc_id"), F.col("text"), seed).alias("u")), "mix-sizes")
    goal = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    some = F.col("source_size") > 0
    goal = (
        goal.withColumn("whole", F.when(some, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
        .withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
        .withColumn("f", F.when(some, F.col("rest") / F.col("source_size")).otherwise(0.0))
        .withColumnRenamed("source", "_s")
    )
    goal = written(goal, "mix-targets")  # a stored table has a known size: it is broadcast only if small
    q = _rank(F.col("u"), F.col("f"))
    ranked = (
        sized.join(goal, F.col("source").eqNullSafe(F.col("_s")))
        .filter("f > 0")
        .select("_s", "rest", q.alias("q"), "doc_id", "size", "h")
        .withColumn("bin", F.floor(F.col("q") / (1 + F.col("q")) * bins))
    )
    key, none = F.struct(*_KEY), F.lit(None)
    passed = lambda after, at_most: F.array(F.struct(after.alias("after"), at_most.alias("at_most"), F.col("until"))).cast(_PASSES)
    # The documents that fit in order: a pass over the whole ranking.
    first = _next_pass(ranked.withColumnRenamed("rest", "gap"))
    plan = goal.filter("f > 0").select(F.col("_s").alias("_t"), F.col("rest").alias("gap"))
    if first is None:
        plan = plan.withColumn("until", none.cast(_KEY_TYPE)).withColumn("passes", F.array().cast(_PASSES))
    else:
        plan = plan.join(first, F.col("_t").eqNullSafe(F.col("_s"))).select("_t", (F.col("gap") - F.col("used")).alias("gap"), "until", passed(none, none).alias("passes"))
    plan = written(plan, "mix-pass")
    while True:
        # Whatever stands before the end of a pass and fits the gap now is taken, as the gap only closes.
        ahead = ranked.join(plan, F.col("_s").eqNullSafe(F.col("_t"))).filter(key > F.col("until"))
        found = _next_pass(ahead.filter((F.col("size") > 0) & (F.col("size") <= F.col("gap"))).select("_s", "gap", "bin", *_KEY))
        if found is None:
            break
        gone = plan.withColumnRenamed("until", "after").join(found, F.col("_t").eqNullSafe(F.col("_s")), "left")
        more = F.col("used").isNotNull()
        plan = gone.select(
            "_t", (F.col("gap") - F.coalesce("used", F.lit(0))).alias("gap"), F.when(more, F.col("until")).alias("until"),
            F.when(more, F.concat("passes", passed(F.col("after"), F.floor("gap")))).otherwise(F.col("passes")).alias("passes"),
        )
        plan = written(plan, "mix-pass")
    # Of all that are left, the one whose size is nearest to the open gap fills it, if that is nearer than leaving it open.
    left = ranked.join(plan, F.col("_s").eqNullSafe(F.col("_t")))
    left = left.filter((F.abs(F.col("size") - F.col("gap")) < F.abs("gap")) & ~_is_in(key, F.col("passes"), F.array().cast(f"array<{_KEY_TYPE}>")))
    left = left.groupBy("_s", "gap", *_KEY).agg(F.sum("size").alias("words"))  # equal rows fill together
    off = F.abs(F.col("words") - F.col("gap"))
    best = left.groupBy("_s").agg(F.min(F.when(off < F.abs("gap"), F.struct(off.alias("off"), key.alias("row")))).alias("best"))
    plan = plan.join(best, F.col("_t").eqNullSafe(F.col("_s")), "left").select("_t", "passes", F.array_compact(F.array("best.row")).alias("fillers"))
    plan = goal.join(plan, F.col("_s").eqNullSafe(F.col("_t")), "left")
    plan = plan.select("_s", "source_size", "target", "whole", "f", "passes", "fillers")
    plan = written(plan, "mix-plan")
    row = F.struct(_rank(uniform(F.col("doc_id"), F.col("text"), seed), F.col("f")).alias("q"), *rank_key)
    more = _is_in(row, F.col("passes"), F.col("fillers"))
    copies = F.col("whole") + F.when(F.col("f") > 0, more.cast("long")).otherwise(0)
    return (
        base.join(plan, F.col("source").eqNullSafe(F.col("_s")))
        .withColumn("copies", copies)
        .withColumn("taken", F.col("copies") * F.col("size"))
        .select("_row.*", *_ADDED)
    )


def take(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs, each as many times as the mix takes it; columns as in docs."""
    columns = [F.col(f"`{c}`") for c in docs.columns]
    plain = docs.select(F.struct(*columns).alias("_taken"), "doc_id", "text", "source")
    taken = mix(plain, **options).filter("copies > 0")
    return taken.select("_taken", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("_taken.*")
