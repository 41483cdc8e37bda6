"""Exact order statistics and ranks for groups of any size.

No group is sorted in one task. For ranks, values are first pre-aggregated into (value, count)
rows, so a value shared by a third of the table is one row; distinct values are then spread over
buckets in two steps: by their size on a logarithmic scale, and each such bucket over the range
its own values take. A column of close values far from zero (times in epoch seconds) is spread
as well, also beside a zero or other values far away. Only bucket totals are scanned per group.

For quantiles, an approximate pass brackets each wanted rank, and one more pass counts what is
below the bracket and which values lie within; brackets that still hold too many values are cut
again at quantiles of their own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidyorder.session import materialize

# Buckets of a unit of the logarithmic scale, and finer buckets within one of them.
_STEPS = 8
_FINE = 1 << 20
# The logarithm of any positive double is greater than minus this.
_SHIFT = 800.0
# Relative rank error of the first pass of quantiles is 1 / _ACCURACY.
_ACCURACY = 20_000
# Distinct values of a bracket that one task looks through.
_IN_BRACKET = 1_000_000
_PIECES = 256


def _scale(value: Column) -> Column:
    """Non-decreasing map of doubles in which steps of equal size are equal ratios."""
    size = F.log(F.abs(value)) + _SHIFT
    return F.when(value == 0, F.lit(0.0)).when(F.isnan(value), F.lit(2 * _SHIFT)).otherwise(
        F.signum(value) * F.least(size, F.lit(2 * _SHIFT))
    )


def _bucketed(df: DataFrame, value: str) -> DataFrame:
    """Adds `_bucket`, a non-decreasing whole number of the value."""
    v = F.col(value).cast("double")
    coarse = df.withColumn("_coarse", F.floor(_scale(v) * _STEPS))
    ranges = coarse.groupBy("_coarse").agg(F.min(v).alias("_lo"), F.max(v).alias("_hi"))  # at most 4 * _SHIFT * _STEPS + 1 rows
    width = F.col("_hi") - F.col("_lo")
    fine = F.coalesce(F.floor(F.nanvl((v - F.col("_lo")) / F.when(width > 0, width), F.lit(0.0)) * _FINE), F.lit(0))
    return coarse.join(F.broadcast(ranges), "_coarse").withColumn("_bucket", F.col("_coarse") * (2 * _FINE) + fine).select(*df.columns, "_bucket")


def cumulative_counts(
    df: DataFrame, by: Sequence[str], value: str, weights: dict[str, Column]
) -> DataFrame:
    """One row per (by, value): the summed `weights` and, for each weight w, `w_below`,
    its total over strictly smaller values of the group."""
    by = list(by)
    totals = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(
        *[F.sum(expr).alias(name) for name, expr in weights.items()]
    )
    totals = _bucketed(totals, value)
    per_bucket = totals.groupBy(*by, "_bucket").agg(*[F.sum(n).alias(f"_{n}") for n in weights])
    ordered = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_bucket.select(
        *by, "_bucket", *[F.coalesce(F.sum(f"_{n}").over(ordered), F.lit(0)).alias(f"_{n}_off") for n in weights]
    )
    inside = Window.partitionBy(*by, "_bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    return totals.join(offsets, by + ["_bucket"]).select(
        *by,
        value,
        *weights,
        *[
            (F.col(f"_{n}_off") + F.coalesce(F.sum(n).over(inside), F.lit(0))).alias(f"{n}_below")
            for n in weights
        ],
    )


def value_ranks(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """(by, value, ties, avg_rank): average ranks, ties shared."""
    counted = cumulative_counts(df, by, value, {"ties": F.lit(1)})
    return counted.select(
        *by, value, "ties", (F.col("ties_below") + (F.col("ties") + 1) / 2).alias("avg_rank")
    )


def _cells(df: DataFrame, columns: Sequence[str], by: Sequence[str], kind: str) -> DataFrame:
    """Long form (by, name, v) of the observed cells."""
    cells = ", ".join(f"'{c}', cast(`{c}` as {kind})" for c in columns)
    return df.selectExpr(*by, f"stack({len(columns)}, {cells}) as (name, v)").where("v is not null")


def _few(by: Sequence[str]) -> bool:
    """Groups of which there is one, or one per class or fold."""
    return set(by) <= {"label", "fold"}


def _settled(df: DataFrame) -> DataFrame:
    """The few rows of `df`, computed now: what uses them again does not compute them again."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


def _regrouped(rows: DataFrame, key: list[str]) -> DataFrame:
    """(key, side, v, c, first, last, n): counts of the values within a bracket (side 0), and of
    all that lies below (-1) or above (1) as one row with its extremes."""
    return rows.groupBy(*key, "side", F.expr("if(side = 0, first, null)").alias("v")).agg(
        F.sum("c").alias("c"), F.min("first").alias("first"), F.max("last").alias("last"), F.max("n").alias("n")
    )


def _narrowed(held: DataFrame, key: list[str], ranks: str) -> DataFrame:
    """`held` with brackets cut again until each has at most _IN_BRACKET distinct values."""
    per_key = ", ".join(key)
    held = materialize(held)
    while (held.groupBy(*key).count().agg(F.max("count")).first()[0] or 0) > _IN_BRACKET:
        steps = F.array(*[F.lit(j / _PIECES) for j in range(_PIECES + 1)])
        cuts = held.where("side = 0").groupBy(*key).agg(F.percentile_approx("v", steps, _ACCURACY).alias("cuts"))
        # values up to a cut form a piece
        inner = F.size(F.filter("cuts", lambda x: x < F.col("v")))
        pieces = held.join(cuts, key, "left").withColumn("piece", F.when(F.col("side") == 0, inner).otherwise(F.col("side") * 2 * _PIECES)).drop("cuts")
        totals = pieces.groupBy(*key, "piece").agg(F.sum("c").alias("c"), F.max("n").alias("n"))
        placed = totals.selectExpr("*", f"sum(c) over (partition by {per_key} order by piece) as upto")
        wanted = placed.where(f"exists({ranks}, t -> t.rank >= upto - c and t.rank < upto)").groupBy(*key).agg(F.min("piece").alias("from"), F.max("piece").alias("to"))
        sides = pieces.join(wanted, key).withColumn("side", F.expr("case when side <> 0 then side when piece < from then -1 when piece > to then 1 else 0 end"))
        held = materialize(_regrouped(sides, key))
    return held


def quantiles(
    df: DataFrame, columns: Sequence[str], probs: Sequence[float], by: Sequence[str] = ()
) -> DataFrame:
    """Exact linear-interpolation quantiles: one row per group, arrays `q_<column>` (NULL if empty).

    The first pass takes approximate quantiles a little below and above each wanted rank; their
    error is bounded, so the rank lies between or next to them. The second counts the rows below
    and above and the values in between, combined map-side, so its shuffle is small. Nothing is
    sorted as a whole.
    """
    by, probs = list(by), list(map(float, probs))
    key = [*by, "name", "i"]
    slack = 2 / _ACCURACY
    around = ", ".join(f"{max(p - slack, 0.0)!r}D, {min(p + slack, 1.0)!r}D" for p in probs)
    narrow = df.selectExpr(*by, *[f"cast(`{c}` as double) as `{c}`" for c in columns])
    brackets = narrow.groupBy(*by).agg(
        *[F.expr(f"struct(count(`{c}`) as n, percentile_approx(`{c}`, array({around}), {_ACCURACY}) as b) as `k_{c}`") for c in columns]
    )
    few = _few(by)
    brackets = _settled(brackets) if few else materialize(brackets)
    largest = brackets.agg(F.max(F.greatest(F.lit(0), *[F.col(f"k_{c}")["n"] for c in columns]))).first()[0] or 0
    hint = F.broadcast(brackets) if few else brackets
    joined = narrow.join(hint, by) if by else narrow.crossJoin(hint)
    cells = ", ".join(f"'{c}', `{c}`, `k_{c}`" for c in columns)
    long = joined.selectExpr(*by, f"stack({len(columns)}, {cells}) as (name, v, k)").where("v is not null")
    spans = range(len(probs))
    inside = " or ".join(f"v between k.b[{2 * j}] and k.b[{2 * j + 1}]" for j in spans)
    # what lies outside all brackets becomes one row per column, with its counts for each bracket
    counted = long.groupBy(*by, "name", F.expr(f"if({inside}, v, null)").alias("value")).agg(
        F.count("*").alias("cells"), F.expr("max(k.n) as n"), *[
            F.expr(f"{what} as {letter}{j}") for j in spans for letter, what in (
                ("b", f"count_if(v < k.b[{2 * j}])"), ("m", f"max(if(v < k.b[{2 * j}], v, null))"),
                ("a", f"count_if(v > k.b[{2 * j + 1}])"), ("l", f"min(if(v > k.b[{2 * j + 1}], v, null))"))
        ]
    )
    sides = ", ".join(
        f"{j}, -1, b{j}, m{j}, {j}, 1, a{j}, l{j}, {j}, 0, if(value is not null and b{j} = 0 and a{j} = 0, cells, 0), value" for j in spans)
    rows = counted.selectExpr(*by, "name", "n", f"stack({3 * len(probs)}, {sides}) as (i, side, c, first)").where("c > 0")
    held = _regrouped(rows.withColumn("last", F.col("first")), key)
    at = f"(n - 1) * array({', '.join(f'{x!r}D' for x in probs)})[i]"
    ranks = f"array(struct(0 as end, floor({at}) as rank), struct(1 as end, ceil({at}) as rank))"
    if largest * 3 * slack > _IN_BRACKET:
        held = _narrowed(held, key, ranks)
    per_key = ", ".join(key)
    lost = "raise_error('a rank left its bracket')"
    value = f"case when side = 0 then v when side < 0 and rank = upto - 1 then last when side > 0 and rank = upto - c then first else {lost} end"
    ends = held.selectExpr("*", f"sum(c) over (partition by {per_key} order by side, v) as upto").selectExpr(
        "*", f"{at} - floor({at}) as frac", f"inline(filter({ranks}, t -> t.rank >= upto - c and t.rank < upto))"
    ).selectExpr(*key, "frac", "end", f"{value} as q")
    found = ends.groupBy(*key).agg(
        F.max(F.when(F.col("end") == 0, F.col("q"))).alias("a"), F.max(F.when(F.col("end") == 1, F.col("q"))).alias("b"), F.max("frac").alias("frac")
    ).selectExpr(*key, "a + (b - a) * frac as q")
    lists = found.groupBy(*by).agg(*[F.expr(f"array_sort(collect_list(if(name = '{c}', struct(i, q), null))) as `s_{c}`") for c in columns])
    out = lists.selectExpr(*by, *[f"if(size(`s_{c}`) > 0, transform(`s_{c}`, x -> x.q), null) as `q_{c}`" for c in columns])
    return _settled(out) if few else out


def modes(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Most frequent value per column (ties: smallest), one row per group, `m_<column>`."""
    by = list(by)
    long = _cells(df, columns, by, "int")
    counts = long.groupBy(*by, "name", "v").agg(F.count("*").alias("cnt"))
    out = counts.groupBy(*by).agg(
        *[F.expr(f"max_by(if(name = '{c}', v, null), if(name = '{c}', struct(cnt, -v), null)) as `m_{c}`") for c in columns]
    )
    return _settled(out) if _few(by) else out


def running_extreme(df: DataFrame, by: Sequence[str], value: str, expr: str, kind: str, out: str) -> DataFrame:
    """Over rows distinct in (by, value): `kind`='max' gives the maximum of `expr` up to the
    value, `kind`='min' the minimum from the value on. Two levels, like the ranks."""
    by = list(by)
    direction = F.col("_bucket") if kind == "max" else F.col("_bucket").desc()
    inner = F.col(value) if kind == "max" else F.col(value).desc()
    extreme = F.max if kind == "max" else F.min
    bucketed = _bucketed(df, value)
    tops = bucketed.groupBy(*by, "_bucket").agg(extreme(expr).alias("_top"))
    earlier = Window.partitionBy(*by).orderBy(direction).rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select(*by, "_bucket", extreme("_top").over(earlier).alias("_outside"))
    inside = Window.partitionBy(*by, "_bucket").orderBy(inner).rowsBetween(Window.unboundedPreceding, 0)
    pick = F.greatest if kind == "max" else F.least
    return bucketed.join(tops, [*by, "_bucket"]).select(
        *df.columns, pick(extreme(expr).over(inside), "_outside").alias(out)
    )
