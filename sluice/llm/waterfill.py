"""Mixing sources to target weights by capped water-filling, with DataFrame functions only.

Every source asks for its weight's share of the budget. No source gives more than
``epochs`` times its own size; what is over goes to the others in proportion to
their weights, again and again until none is above. In closed form: order the
sources by cap / weight; the first ones stop at their caps, the rest share one
level times their weights.

A source's target over its size is a number of repetitions: every document is
taken the whole part, and a seeded choice of documents once more for the rest.
The choice is the front of a seeded order, cut where the words taken come
nearest to the target (off by half a document at most).

Scale: documents are summed by (source, first three digits of the seeded
digest), so a source of any size is spread over 4096 partial sums; only the
documents of the one bucket where a source's cut falls are ordered. The per-source
table is broadcast only if counted and at most BROADCAST_SOURCES rows.

Defined cases: a null text or one of white space has size 0; a null source is a
source of its own, last in order; a source without words has target 0; equal rows
are told apart only by order; a null id is ordered by its text instead; extra columns may have any names; an empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, numbered

BROADCAST_SOURCES = 100_000
SEED = "sluice-mix"
PARAMS = ("source_size", "target", "whole", "wanted", "cut_bucket", "cut_before", "last_full")


def cyclic_weight(rank: Column, cycle: int = 3) -> Column:
    """Weights 1, 2, 3, 1, 2, 3, ... along the sources' order."""
    return (F.pmod(rank - 1, F.lit(cycle)) + 1).cast("long")


def sized(docs: DataFrame, seed: str = SEED, whole: bool = False) -> DataFrame:
    """doc_id, source, size and the seeded digest, beside the whole row as a struct where it is to be kept."""
    # A null id has no place of its own in the order: its text's digest gives it one.
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text:"), F.coalesce("text", F.lit(""))))))
    return docs.select(
        "doc_id", "source", *([F.struct(*docs.columns).alias("row")] if whole else []),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        key.alias("ord"),
    )


def water_levels(sources: DataFrame, epochs: int = 3) -> DataFrame:
    """``sources``: source, source_size, weight, rank. Adds target (double).

    In closed form, in one window over all sources: for a counted, small number of them.
    """
    total = Window.partitionBy()
    by_ratio = Window.partitionBy().orderBy(F.col("cap") / F.col("weight"), F.col("rank"))
    before, onward = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    return (
        sources.withColumn("cap", F.lit(epochs) * F.col("source_size"))
        .withColumn("left", F.sum("source_size").over(total) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("sharing", F.sum("weight").over(onward))
        .withColumn("asked", F.col("left").cast("double") * F.col("weight") / F.col("sharing"))
        .withColumn("capped", F.col("cap") <= F.col("asked"))
        .withColumn("level", F.max(F.when(~F.col("capped"), F.col("left").cast("double") / F.col("sharing"))).over(total))
        .withColumn("target", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.col("level") * F.col("weight")))
        .drop("left", "sharing", "asked", "capped", "level", "cap")
    )


def water_levels_by_rounds(sources: DataFrame, epochs: int = 3) -> DataFrame:
    """The same for any number of sources: clamp what the level is above, share out the rest, until none is above."""
    cap = F.lit(epochs) * F.col("source_size")
    budget, level, clamped = sources.agg(F.sum("source_size")).first()[0] or 0, None, 0
    while True:
        above = F.lit(False) if level is None else cap <= F.lit(level) * F.col("weight")
        taken, n, sharing = sources.agg(F.coalesce(F.sum(F.when(above, cap)), F.lit(0)), F.count_if(above), F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0))).first()
        if level is not None and n == clamped or not sharing:
            return sources.withColumn("target", F.when(above, cap.cast("double")).otherwise(F.lit(level or 0.0) * F.col("weight")))
        level, clamped = float(budget - taken) / sharing, n


def source_targets(docs_sized: DataFrame, epochs: int = 3, weight=cyclic_weight, single: int = BROADCAST_SOURCES) -> DataFrame:
    """source, source_size, target. Up to ``single`` sources are ordered in one task, more over ranges."""
    sums = cut(docs_sized.groupBy("source").agg(F.sum("size").alias("source_size")), "mix-sources")
    order = F.col("source").asc_nulls_last()
    if sums.count() <= single:
        ranked = sums.withColumn("rank", F.row_number().over(Window.partitionBy().orderBy(order)))
        return water_levels(ranked.withColumn("weight", weight(F.col("rank"))), epochs).select("source", "source_size", "target")
    ranked = cut(numbered(sums, [order], "rank").withColumn("weight", weight(F.col("rank"))), "mix-ranks")
    return water_levels_by_rounds(ranked, epochs).select("source", "source_size", "target")


def _cuts(docs_sized: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source: whole repetitions, words still wanted, and the bucket where the seeded order is cut."""
    bucket = F.substring("ord", 1, 3)
    sums = docs_sized.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("words"))
    running = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    rate = F.col("target") / F.col("source_size")
    params = (
        targets.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(rate)).otherwise(0).cast("long"))
        .withColumn("wanted", F.col("target") - F.col("whole") * F.col("source_size"))
    )
    marks = sums.withColumn("before", F.coalesce(F.sum("words").over(running), F.lit(0)))
    a, b = params.alias("a"), marks.alias("b")
    hit = (F.col("b.before") < F.col("a.wanted")) & (F.col("a.wanted") < F.col("b.before") + F.col("b.words"))
    edge = (
        a.join(b, F.col("a.source").eqNullSafe(F.col("b.source")))
        .groupBy("a.source", "a.source_size", "a.target", "a.whole", "a.wanted")
        .agg(F.max(F.when(hit, F.struct("b.bucket", "b.before"))).alias("cut"),
             F.max(F.when(F.col("b.before") + F.col("b.words") <= F.col("a.wanted"), F.col("b.bucket"))).alias("last_full"))
    )
    return edge.select("source", "source_size", "target", "whole", "wanted", F.col("cut.bucket").alias("cut_bucket"), F.col("cut.before").alias("cut_before"), "last_full")


def _decided(rows: DataFrame, base: DataFrame, epochs: int, weight) -> DataFrame:
    """``rows`` (as from sized) with their source's numbers and repeats; ``base`` is the narrow, written form."""
    params = cut(_cuts(base, source_targets(base, epochs, weight)), "mix-cuts")
    if params.count() <= BROADCAST_SOURCES:
        params = F.broadcast(params)
    d, p = rows.alias("d"), params.alias("p")
    joined = d.join(p, F.col("d.source").eqNullSafe(F.col("p.source"))).select("d.*", *[F.col(f"p.{c}") for c in PARAMS])
    bucket = F.substring("ord", 1, 3)
    at_cut = F.coalesce(bucket == F.col("cut_bucket"), F.lit(False))
    clear = joined.where(~at_cut).withColumn("extra", F.coalesce(bucket <= F.col("last_full"), F.lit(False)))
    order = Window.partitionBy("source").orderBy("ord", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    edge = joined.where(at_cut).withColumn(
        "extra", F.col("cut_before") + F.coalesce(F.sum("size").over(order), F.lit(0)) + F.col("size") / 2 < F.col("wanted")
    )
    return clear.unionByName(edge).withColumn("repeats", F.col("whole") + F.col("extra").cast("long"))


def mix(docs: DataFrame, epochs: int = 3, seed: str = SEED, weight=cyclic_weight) -> DataFrame:
    """One row per document: size, its source's size and target, the repetitions and words taken."""
    base = cut(sized(docs, seed), "mix-sizes")
    both = _decided(base, base, epochs, weight)
    return both.select("doc_id", "source", "size", "source_size", "target", "repeats", (F.col("repeats") * F.col("size")).alias("taken"))


def mixture(docs: DataFrame, epochs: int = 3, seed: str = SEED, weight=cyclic_weight) -> DataFrame:
    """The mix itself: every document, whole, as often as the mix takes it. Texts are read twice and never shuffled
    (but for the bucket of each source that the cut goes through)."""
    base = cut(sized(docs, seed), "mix-sizes")
    taken = _decided(sized(docs, seed, True), base, epochs, weight).where("repeats > 0")
    return taken.withColumn("_times", F.explode_outer(F.array_repeat(F.lit(1), F.col("repeats").cast("int")))).select("row.*")
