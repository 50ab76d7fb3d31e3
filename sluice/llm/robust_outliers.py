"""Quality rules and robust multivariate outliers.

Every document gets exact counts over its whole text and fails the base rule when
it has too few words or too many repeated ones. The others are judged as vectors
of transformed statistics: for each language and source the minimum covariance
determinant estimate is found by concentration steps, and documents whose
Mahalanobis distance from it is above a chi-square limit are rejected.

The estimate is a deterministic MCD with half of each group's rows, so that junk
of almost half of a group does not carry it. Three of that method's six starts are
taken (the coordinates themselves, their hyperbolic tangents, their spatial signs;
not ranks, normal scores and pairwise scales): the axes of each give a centre and
scatter by medians and median deviations. From each, concentration steps keep the
half of the group's rows nearest to the present centre (a mergeable quantile
sketch gives the radius) and take their mean and covariance, until the determinant
falls by less than SETTLED (a step never raises it, but for the sketch's error).
The smallest determinant of a group counts; all rows within its 97.5 % ellipsoid
then give the final mean and covariance.

Each step is two aggregations of a narrow table with map-side partial sums, over
all rows of all groups and starts not yet settled; no group is gathered anywhere,
so a source with a third of all rows is no special case.

Groups smaller than ``min_rows`` borrow their language's estimate, small languages
that of the corpus. Group tables have one row per (lang, source); they are
broadcast only if counted and at most BROADCAST_GROUPS.

Defined cases: a null text has no words and fails the base rule; null languages
and sources are groups of their own; equal rows count as often as they come; an
empty table gives an empty result; a coordinate that does not vary in a group
has the ridge for its variance; a carried column with the
name of a count comes out with "_in" appended, others are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, cut, set_aside
from .wordbytes import Words, repeated_within, steps, trimmed

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
BROADCAST_GROUPS = 50_000
#: Coordinates: mean word length, symbols per word, repeated lines and repeated words (as roots).
DIMS = 4
#: A ridge: its squares are added to every covariance's diagonal, so that none is singular and what hardly
#: varies in a group is not judged by its last digits. At the default limit of 4.85 a document of a group
#: that never has symbols goes from 0.34 symbols a word on, and for repeated words alone from 24 % on.
RIDGE = (0.08, 0.12, 0.12, 0.10)
#: The logarithm of a determinant is settled when it falls by less than this.
SETTLED = 1e-3
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"


def _dup_lines(text: bytes) -> int:
    if b"\n" not in text:
        return 0
    lines = [x for x in text.split(b"\n") if x.strip(_SPACES)]
    return len(lines) - len(set(lines))


def count_texts(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The five counts of each text."""
    w = Words(data, offsets)
    at = offsets[:-1]

    def per_text(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return total[offsets[1:]] - total[at]

    chars = per_text(w.inside & ((data & 0xC0) != 0x80))
    symbols = per_text(_SYMBOL[data])
    raw = data.tobytes()
    lines = np.array([_dup_lines(raw[offsets[i] : offsets[i + 1]]) for i in range(w.n_docs)], np.int64)
    keys, first, doc = w.windows(w.hashes(), 8)
    again = first[repeated_within(doc, keys)]
    marks = np.zeros(len(w.starts) + 1, np.int64)
    np.add.at(marks, again, 1)
    np.add.at(marks, again + 8, -1)
    covered = np.concatenate([[0], np.cumsum(np.cumsum(marks[:-1]) > 0)])
    repeats = covered[w.per_doc[1:]] - covered[w.per_doc[:-1]]
    return [w.counts.astype(np.int64), chars, symbols, lines, repeats.astype(np.int64)]


def _counter(carry: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in steps(batch.column("text")):
                part = batch.slice(first, end - first)
                yield pa.RecordBatch.from_arrays([part.column(c) for c in carry] + [pa.array(x) for x in count_texts(data, offsets)], [*carry, *COUNTS])

    return run


def text_counts(docs: DataFrame, carry: tuple[str, ...] = ("doc_id", "lang", "source")) -> DataFrame:
    """The exact counts of every whole text beside the carried columns."""
    bound_batches(docs.sparkSession)
    docs, names = set_aside(docs, COUNTS)
    carry = tuple(names[c] for c in carry)
    kinds = dict(docs.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in carry), *(f"{c} long" for c in COUNTS)])
    return docs.select(*carry, "text").mapInArrow(trimmed(_counter([*carry])), schema)


def base_failed(min_words: int = 20, repeat_percent: int = 30) -> Column:
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))


def _vector() -> list[Column]:
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return [
        F.log1p(F.col("word_chars") / n),
        F.sqrt(F.col("n_symbols") / n),
        F.sqrt(F.col("n_dup_lines") / F.sqrt(n)),
        F.sqrt(F.col("n_repeat_words") / n),
    ]


def chi_square_quantile(p: float, k: int) -> float:
    """Quantile of the chi-square distribution with an even number of degrees of freedom, by bisection of its closed form."""
    lo, hi = 0.0, 400.0
    for _ in range(200):
        mid = (lo + hi) / 2
        tail = math.exp(-mid / 2) * sum((mid / 2) ** i / math.factorial(i) for i in range(k // 2))
        lo, hi = (mid, hi) if 1 - tail < p else (lo, mid)
    return hi


def _pack(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Means and covariances per key from partial sums: n, m (array), s (packed lower triangle)."""
    x = [F.col(f"x{i}") for i in range(DIMS)]
    sums = [F.sum(x[i]).alias(f"m{i}") for i in range(DIMS)] + [F.sum(x[i] * x[j]).alias(f"s{i}{j}") for i in range(DIMS) for j in range(i + 1)]
    out = rows.groupBy(*keys).agg(F.count("*").alias("n"), *sums)
    m = [F.col(f"m{i}") / F.col("n") for i in range(DIMS)]
    s = [F.col(f"s{i}{j}") / F.col("n") - m[i] * m[j] for i in range(DIMS) for j in range(i + 1)]
    return out.select(*keys, "n", F.array(*m).alias("m"), F.array(*s).alias("s"))


def _unpacked(packed) -> np.ndarray:
    """The symmetric matrix of a packed lower triangle."""
    full = np.zeros((DIMS, DIMS))
    full[np.tril_indices(DIMS)] = packed
    return full + full.T - np.diag(np.diag(full))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _inverse(s, scale):
    """Packed lower triangles of covariances, scaled and ridged, to their inverses' full matrices and, last, the logarithms of their determinants."""
    import pandas as pd

    out = []
    for packed, c in zip(s, scale, strict=True):
        full = _unpacked(packed) * c + np.diag(np.square(RIDGE))
        out.append([*np.linalg.inv(full).ravel(), np.linalg.slogdet(full)[1]])
    return pd.Series(out)


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _axes(s):
    """Packed lower triangles to the full matrices of their correlations' eigenvectors."""
    import pandas as pd

    out = []
    for packed in s:
        full = _unpacked(packed)
        by = np.sqrt(np.maximum(np.diag(full), 1e-12))
        out.append(np.linalg.eigh(full / np.outer(by, by))[1].ravel())
    return pd.Series(out)


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _along(axes, spread, scale):
    """Packed covariances with the given spreads along the axes of coordinates divided by scale."""
    import pandas as pd

    out = []
    for e, d, c in zip(axes, spread, scale, strict=True):
        e = np.asarray(e).reshape(DIMS, DIMS) * np.asarray(c)[:, None]
        out.append((e @ np.diag(np.square(d)) @ e.T)[np.tril_indices(DIMS)])
    return pd.Series(out)


def _distance() -> Column:
    d = [F.col(f"x{i}") - F.get("m", i) for i in range(DIMS)]
    return reduce(lambda a, b: a + b, [d[i] * d[j] * F.get("inv", i * DIMS + j) for i in range(DIMS) for j in range(DIMS)])


def _with_groups(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Rows beside their group's estimate; ``g`` is never null."""
    return rows.join(F.broadcast(groups) if groups.count() <= BROADCAST_GROUPS else groups, "g")


def _medians(rows: DataFrame, keys: list[str], values: list[Column]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.array(*[F.percentile_approx(v, 0.5, 2000) for v in values]).alias("mid"))


def _starts(rows: DataFrame) -> DataFrame:
    """Centres and inverse scatters (g, k, m, inv) to start from, with a determinant that any step lowers."""
    dims, xs = range(DIMS), [F.col(f"x{i}") for i in range(DIMS)]
    centres = cut(_medians(rows, ["g"], xs).withColumnRenamed("mid", "centre"), "mcd-median")
    away = _medians(_with_groups(rows, centres), ["g"], [F.abs(xs[i] - F.get("centre", i)) for i in dims])
    scale = F.array(*[F.greatest(1.4826 * F.get("mid", i), F.lit(RIDGE[i])) for i in dims])
    centres = cut(centres.join(away.select("g", scale.alias("scale")), "g"), "mcd-scale")
    z = [(xs[i] - F.get("centre", i)) / F.get("scale", i) for i in dims]
    norm = F.sqrt(reduce(lambda a, b: a + b, [F.col(f"z{i}") * F.col(f"z{i}") for i in dims]))
    signs = F.when(norm > 0, 1 / norm).otherwise(0.0)
    shapes = F.array(F.struct(F.lit(1).alias("k"), *[F.tanh(f"z{i}").alias(f"x{i}") for i in dims]), F.struct(F.lit(2).alias("k"), *[(F.col(f"z{i}") * signs).alias(f"x{i}") for i in dims]))
    shaped = _with_groups(rows, centres).select("g", *[z[i].alias(f"z{i}") for i in dims]).select("g", F.inline(shapes))
    axes = _pack(shaped, ["g", "k"]).select("g", "k", _axes("s").alias("axes"))
    plain = centres.select("g", F.lit(0).alias("k"), F.array(*[F.lit(float(i == j)) for i in dims for j in dims]).alias("axes"))
    axes = cut(axes.unionByName(plain).join(centres, "g"), "mcd-axes")
    y = [reduce(lambda a, b: a + b, [z[i] * F.get("axes", i * DIMS + j) for i in dims]) for j in dims]
    turned = _medians(_with_groups(rows, axes), ["g", "k"], y)
    axes = cut(axes.join(turned, ["g", "k"]), "mcd-turned")
    spread = _medians(_with_groups(rows, axes), ["g", "k"], [F.abs(y[j] - F.get("mid", j)) for j in dims]).select("g", "k", F.transform("mid", lambda v: 1.4826 * v).alias("spread"))
    back = F.array(*[F.get("centre", i) + F.get("scale", i) * reduce(lambda a, b: a + b, [F.get("axes", i * DIMS + j) * F.get("mid", j) for j in dims]) for i in dims])
    scatter = _inverse(_along("axes", "spread", "scale"), F.lit(1.0))
    return cut(axes.join(spread, ["g", "k"]).select("g", "k", back.alias("m"), scatter.alias("inv"), F.lit(math.inf).alias("last")), "mcd-start")


def _share_scale(h: float) -> float:
    """What scales the covariance of the nearest share h of normal rows to that of all."""
    q = chi_square_quantile(h, DIMS)
    return h / (1 - math.exp(-q / 2) * sum((q / 2) ** i / math.factorial(i) for i in range(DIMS // 2 + 1)))


def mcd(rows: DataFrame, h: float = 0.5) -> DataFrame:
    """Centre and inverse scatter (g, m, inv) of every group g of rows (g, x0...)."""
    rows = cut(rows.select("g", *[f"x{i}" for i in range(DIMS)]), "mcd-rows")
    going, found = _starts(rows), []
    log_det = F.get("inv", DIMS * DIMS)
    while not found or not going.isEmpty():
        far = _with_groups(rows, going).withColumn("d2", _distance())
        radius = far.groupBy("g", "k").agg(F.percentile_approx("d2", h, 2000).alias("radius"))
        going = cut(going.join(radius, ["g", "k"]), "mcd-radius")
        near = _with_groups(rows, going).where(_distance() <= F.col("radius"))
        after = _pack(near, ["g", "k"]).select("g", "k", "m", _inverse("s", F.lit(_share_scale(h))).alias("inv"))
        after = cut(after.join(going.select("g", "k", "last"), ["g", "k"]), "mcd-step").withColumn("settled", log_det > F.col("last") - SETTLED)
        found.append(after.where("settled").select("g", "k", "m", "inv"))
        going = after.where("NOT settled").select("g", "k", "m", "inv", log_det.alias("last"))
    best = reduce(DataFrame.unionByName, found).groupBy("g").agg(F.min_by(F.struct("m", "inv"), F.struct(log_det, "k")).alias("b"))
    best = cut(best.select("g", "b.*"), "mcd-best")
    inner = _with_groups(rows, best).where(_distance() <= chi_square_quantile(0.975, DIMS))
    return cut(_pack(inner, ["g"]).select("g", "m", F.slice(_inverse("s", F.lit(_share_scale(0.975))), 1, DIMS * DIMS).alias("inv")), "mcd")


def reject_outliers(counts: DataFrame, keys: tuple[str, ...] = ("lang", "source"), min_rows: int = 200, confidence: float = 0.9999, h: float = 0.5) -> DataFrame:
    """``counts`` with base_failed, distance (null where the base rule fails) and kept: not farther than the limit."""
    counts = cut(counts.withColumn("base_failed", base_failed()), "counts")
    judged = counts.where("NOT base_failed")
    key = lambda n: F.to_json(F.struct(*[F.coalesce(F.col(k).cast("string"), F.lit("\0null")).alias(k) for k in keys[:n]]))
    sizes = judged.groupBy(*keys).agg(F.count("*").alias("n2"))
    level = sizes.select(*keys, "n2", key(len(keys)).alias("g2"), key(1).alias("g1"))
    ones = level.groupBy("g1").agg(F.sum("n2").alias("n1"))
    chosen = cut(
        level.join(ones, "g1").select("g2", F.when(F.col("n2") >= min_rows, F.col("g2")).when(F.col("n1") >= min_rows, F.col("g1")).otherwise("all").alias("g")).distinct(), "mcd-level"
    )
    xs = [f"x{i}" for i in range(DIMS)]
    rows = counts.withColumns({**dict(zip(xs, _vector(), strict=True)), "g2": key(len(keys)), "g1": key(1)})
    sample = rows.where("NOT base_failed")
    # Each estimate uses all rows of its level, also those of groups large enough for their own.
    wanted = chosen.select("g").distinct()
    small = wanted.count() <= BROADCAST_GROUPS
    wanted = F.broadcast(wanted) if small else wanted
    levels = [sample.select(F.col("g2").alias("g"), *xs), sample.select(F.col("g1").alias("g"), *xs), sample.select(F.lit("all").alias("g"), *xs)]
    rows_of = reduce(DataFrame.unionByName, [x.join(wanted, "g", "left_semi") for x in levels])
    groups = mcd(rows_of, h)
    picked = chosen.join(groups, "g").select("g2", "m", "inv")
    joined = rows.join(F.broadcast(picked) if small else picked, "g2", "left")
    limit = chi_square_quantile(confidence, DIMS)
    return joined.withColumn("distance", F.when(~F.col("base_failed"), F.sqrt(_distance()))).select(
        *counts.columns, "distance",
        (~F.col("base_failed") & ~F.coalesce(F.col("distance") > math.sqrt(limit), F.lit(False))).alias("kept"),
    )
