"""Exact group quantiles (type 7, linear interpolation) without large group buffers.

``percentile`` and ``median`` keep every distinct value of a group in the memory
of one task. With seven roles over a table of billions of rows that is seven
tasks. ``grouped_percentiles`` gets the same numbers from a few scans, each reduced
on the map side to counts:

1. Count the rows of each group in fixed, fine bins of the value (0.27 % wide).
   The cumulative counts tell in which bins the wanted ranks lie.
2. Count the rows of those open bins again, split into 1024 each (``levels`` - 1 times).
3. Count the distinct values of the open bins. Offsets come from the bins, so the
   values are windowed bin by bin: one bin's values are all that a task sees.

Sizes: a window task sees one group's bins (256 per doubling of the value), one
bin's 1024 parts, or one part's distinct values. The default, one level, suits amounts of
money, which have few distinct values in a bin. For measures with unlimited digits
set ``levels=2`` (for all queries: ``spark.paylens.quantile.levels``): a part is
then 0.0003 % wide, for one more scan. Rows outside open bins are told off by a broadcast set of cells, into which
open bins are hashed: at most ``CELLS`` numbers, whatever the number of groups; what a shared
cell lets through is dropped when counts meet the open bins. Nothing depends on which group holds most
of the rows. The operator is meant for few groups of many rows: with small groups,
a row's count is no smaller than the row (``operators.small_groups`` serves those).

Overlapping populations (``percentiles_if``) share the scans: rows are counted by a bit mask of their
memberships, and counts, not rows, are dealt to the populations.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paylens.functions.columns import literal, name

BINS_PER_OCTAVE = 256
FINEST_UNIT = 2**-20  # below this magnitude bins get wider, relative to the value
CELLS = 2**20
LEVELS_SETTING = "spark.paylens.quantile.levels"
SPLIT_BITS = 10  # each further level splits a bin into 2**10
DEFAULT_LEVELS = 1
MAX_LEVELS = 3
BIN_LIMIT = 2**40  # above the finest bin number of the largest double
NULL_BIN = f"{-BIN_LIMIT}L"
MAX_POPULATIONS = 62


def _bin(levels: int) -> str:
    """The finest bin number, which never decreases as the value grows."""
    magnitude = f"least(log1p(abs(_value) * {1 / FINEST_UNIT}D), 1000D)"
    scale = BINS_PER_OCTAVE / log(2)
    return f"coalesce(floor(signum(_value) * {magnitude} * {scale}D * {2 ** _hidden_bits(levels, 0)}D), {NULL_BIN})"


def _hidden_bits(levels: int, level: int) -> int:
    """How many low bits of the finest bin number a level does not look at."""
    return SPLIT_BITS * (levels - 1 - level)


def _bin_at(levels: int, level: int) -> str:
    bits = _hidden_bits(levels, level)
    return f"shiftleft(shiftright(_finest, {bits}), {bits})" if bits else "_finest"


def _measures(
    df: DataFrame, keys: Sequence[str], cols: Sequence[str], totals: Mapping[str, str], levels: int
) -> DataFrame:
    """Long form: one row per input row and measure (by position in ``cols``), with its bin."""
    kept = [*map(name, keys), *[f"{expr} AS _t_{out}" for out, expr in totals.items()]]
    if len(cols) == 1:
        long = df.selectExpr(*kept, f"CAST({name(cols[0])} AS double) AS _value")
    else:
        wide = df.selectExpr(*kept, *[f"CAST({name(c)} AS double) AS _m{i}" for i, c in enumerate(cols)])
        pairs = ", ".join(f"{i}, _m{i}" for i in range(len(cols)))
        stacked = f"stack({len(cols)}, {pairs}) AS (_measure, _value)"
        long = wide.selectExpr(*map(name, keys), *[f"_t_{out}" for out in totals], stacked)
    # NaN is no value, as null is none.
    long = long.withColumn("_value", F.expr("nanvl(_value, NULL)"))
    if levels == 1:
        return long.selectExpr("*", f"{_bin(levels)} AS _bin")
    return long.selectExpr("*", f"{_bin(levels)} AS _finest").selectExpr("*", f"{_bin_at(levels, 0)} AS _bin")


def _cell(dims: Sequence[str]) -> str:
    """One of a bounded count of numbers for a group's bin."""
    return f"pmod(xxhash64({', '.join([*map(name, dims), '_bin'])}), {CELLS}) AS _cell"


def _ranked(within: Sequence[str], order: str, base: str = "0L") -> str:
    """Number of values of the group before the row, given the number before its partition."""
    group = f"PARTITION BY {', '.join(map(name, within))} " if within else ""
    return f"{base} + sum({COUNTED}) OVER ({group}ORDER BY {order} ROWS UNBOUNDED PRECEDING) - {COUNTED} AS _before"


COUNTED = "CASE WHEN _value IS NOT NULL THEN _rows ELSE 0L END"


def _covers(rank: str) -> str:
    return f"(_value IS NOT NULL AND _before <= {rank} AND {rank} < _before + _rows)"


def _position(p: float) -> str:
    return f"((_valid - 1) * {literal(float(p))})"


def grouped_percentiles(
    df: DataFrame,
    keys: Sequence[str],
    wanted: Mapping[str, tuple[str, float]],
    totals: Mapping[str, str] | None = None,
    method: str = "two_phase",
    levels: int | None = None,
    few_groups: bool | None = None,
) -> DataFrame:
    """``keys``, row count ``n``, one column per wanted ``(column, p)`` and the totals.

    ``totals`` are numeric SQL expressions summed over each group in the same scans.
    Without keys there is exactly one row, also for empty input.
    ``few_groups`` says that the keys come from fixed lists: the open bins are then few and meet the rows
    themselves, which saves a join. Without keys that is so by itself.
    ``method="exact"`` uses Spark's ``percentile``, which buffers each group's
    distinct values in one task: for small tables.
    """
    totals = dict(totals or {})
    if method == "exact":
        return df.groupBy(*keys).agg(
            F.expr("count(1) AS n"),
            *[F.expr(f"percentile(nanvl(CAST({name(c)} AS double), NULL), {p}) AS {out}") for out, (c, p) in wanted.items()],
            *[F.expr(f"sum({expr}) AS {out}") for out, expr in totals.items()],
        )
    if method != "two_phase":
        raise ValueError(f"unknown method: {method}")
    return _two_phase(df, keys, wanted, totals, levels, not keys if few_groups is None else few_groups, [])


def percentiles_if(
    df: DataFrame,
    populations: Mapping[str, Column],
    wanted: Mapping[str, tuple[str, float]],
    totals: Mapping[str, str] | None = None,
    keys: Sequence[str] = (),
    levels: int | None = None,
) -> DataFrame:
    """Quantiles of overlapping populations: ``keys, population, n``, the wanted ones and the totals.

    ``populations`` maps a name to a condition; unknown is no member. All are answered by the scans of one
    quantile: a row is counted once, in the bins of its bit mask of conditions, and only these counts are dealt to the
    populations of the mask. A population without rows has no result row, nor has one without rows in a group of
    ``keys``. At most 62 populations.
    """
    names = list(populations)
    if not 0 < len(names) <= MAX_POPULATIONS:
        raise ValueError(f"1 to {MAX_POPULATIONS} populations are possible, not {len(names)}")
    conditions = list(populations.values())
    bits = [F.when(condition, F.lit(1 << i).cast("long")).otherwise(0) for i, condition in enumerate(conditions)]
    # Rows of no population go before they are counted; as plain conditions, so that a scan can skip them.
    rows = df.where(reduce(Column.__or__, conditions)).withColumn("_mask", reduce(Column.__add__, bits))
    found = _two_phase(rows, keys, wanted, dict(totals or {}), levels, not keys, names)
    label = F.element_at(F.array(*map(F.lit, names)), F.col("_population") + 1)
    return found.select(*map(name, keys), label.alias("population"), "n", *wanted, *(totals or {}))


def _dealt(counts: DataFrame, names: Sequence[str], by: Sequence[str], totals: Sequence[str]) -> DataFrame:
    """Counts by mask as counts by population."""
    if not names:
        return counts
    members = f"filter(sequence(0, {len(names) - 1}), i -> getbit(_mask, i) = 1)"
    kept = [c for c in counts.columns if c != "_mask"]
    each = counts.selectExpr(*map(name, kept), f"explode({members}) AS _population")
    sums = ["_rows", *totals]
    ends = [f"{f}({c}) AS {c}" for f, c in (("min", "_value"), ("max", "_top")) if c not in by and c in kept]
    return each.groupBy(*by, "_population").agg(*[F.expr(f"sum({c}) AS {c}") for c in sums], *map(F.expr, ends))


def _two_phase(
    df: DataFrame,
    keys: Sequence[str],
    wanted: Mapping[str, tuple[str, float]],
    totals: Mapping[str, str],
    levels: int | None,
    few_groups: bool,
    populations: Sequence[str],
) -> DataFrame:
    """The scans of the module's description; with populations, rows carry ``_mask`` and results ``_population``."""
    levels = levels or int(df.sparkSession.conf.get(LEVELS_SETTING, str(DEFAULT_LEVELS)))
    if not 1 <= levels <= MAX_LEVELS:
        raise ValueError(f"levels must be 1 to {MAX_LEVELS}, not {levels}")

    cols = list(dict.fromkeys(c for c, _ in wanted.values()))
    many = len(cols) > 1
    counted = [*keys, *["_measure"] * many]  # what a row is counted by, besides its mask
    masked = [*counted, *["_mask"] * bool(populations)]
    group_keys = [*keys, *["_population"] * bool(populations)]
    dims = [*counted, *["_population"] * bool(populations)]
    counts = [F.expr("count(1) AS _rows"), F.expr("min(_value) AS _value"), F.expr("max(_value) AS _top")]
    ends = [f"{f}({_position(p)})" for p in sorted({p for _, p in wanted.values()}) for f in ("floor", "ceil")]
    wanted_here = f"({' OR '.join(map(_covers, ends))})"
    shown = [*map(name, dims), "_value", "_rows", "_before", "_valid"]
    sums = [f"_t_{out}" for out in totals]

    rows = _measures(df, [*keys, *["_mask"] * bool(populations)], cols, totals, levels)
    group = f"PARTITION BY {', '.join(map(name, dims))}" if dims else ""
    in_bins = rows.groupBy(*masked, "_bin").agg(*counts, *[F.expr(f"sum({t}) AS {t}") for t in sums])
    bins = _dealt(in_bins, populations, [*counted, "_bin"], sums).selectExpr(
        "*", f"sum({COUNTED}) OVER ({group}) AS _valid", _ranked(dims, "_bin")
    )
    # All bins count for n and the totals; those with one value may hold a wanted one.
    steps = bins.selectExpr(*shown, "_value = _top AS _known", "_rows AS _n", *sums)
    for level in range(levels):
        last = level + 1 == levels
        # Always true: with the totals in use here too, both uses of the bins have one input, which is computed once.
        all_used = f" AND (_rows > 0 OR xxhash64({', '.join(sums)}) <> 0)" if sums and not level else ""
        open_bins = bins.where(f"_value < _top AND {wanted_here}{all_used}").selectExpr(
            *[f"{name(d)} AS _k{i}" for i, d in enumerate(dims)], "_bin AS _in", "_before AS _base", "_valid"
        )

        def same(of: Sequence[str]):
            met = F.col("_bin") == F.col("_in")
            for d in of:
                met = met & F.col(name(d)).eqNullSafe(F.col(f"_k{dims.index(d)}"))
            return met

        bounds = []
        if few_groups and not populations:  # a bin for each end of each quantile of each group
            rows, bounds = rows.join(F.broadcast(open_bins), same(dims)), ["_base", "_valid"]
        elif few_groups:
            rows = rows.join(F.broadcast(open_bins), same(counted), "left_semi")
        else:
            keyed = open_bins.selectExpr(*[f"_k{dims.index(d)} AS {name(d)}" for d in counted], "_in AS _bin")
            cells = F.broadcast(keyed.selectExpr(_cell(counted)).distinct())
            rows = rows.selectExpr("*", _cell(counted)).join(cells, "_cell", "left_semi").drop("_cell")
        if last:
            parts = rows.groupBy(*masked, "_bin", "_value", *bounds).agg(F.expr("count(1) AS _rows"))
            parts = _dealt(parts, populations, [*counted, "_bin", "_value"], []).withColumn("_top", F.col("_value"))
        else:
            rows = rows.selectExpr("*", f"{_bin_at(levels, level + 1)} AS _part")
            parts = rows.groupBy(*masked, "_bin", "_part", *bounds).agg(*counts)
            parts = _dealt(parts, populations, [*counted, "_bin", "_part"], [])
            rows = rows.drop("_bin", "_in", *bounds, *[f"_k{i}" for i in range(len(dims))]).withColumnRenamed("_part", "_bin")
        if not bounds:
            parts = parts.join(F.broadcast(open_bins) if few_groups else open_bins, same(dims))
        order = "_value" if last else "_part"
        parts = parts.selectExpr("*", _ranked([*dims, "_bin"], order, "_base"))
        if not last:
            parts = parts.drop("_bin").withColumnRenamed("_part", "_bin")
        held = parts.where(wanted_here)
        more = held.selectExpr(*shown, "_value = _top AS _known", "0L AS _n", *[f"NULL AS {t}" for t in sums])
        steps = steps.unionByName(more)
        bins = held

    found, interpolated = [], []
    for i, (out, (col, p)) in enumerate(wanted.items()):
        of = f"_measure = {cols.index(col)}" if many else "true"
        position = _position(p)
        for end, f in (("lo", "floor"), ("hi", "ceil")):
            found.append(f"max(CASE WHEN {of} AND _known AND {_covers(f'{f}({position})')} THEN _value END) AS _{end}{i}")
        found.append(f"max(CASE WHEN {of} THEN {position} - floor({position}) END) AS _part{i}")
        between = f"_lo{i} * (1 - _part{i}) + _hi{i} * _part{i}"
        interpolated.append(f"CASE WHEN _lo{i} = _hi{i} THEN _lo{i} ELSE {between} END AS {out}")
    first = "_measure = 0" if many else "true"
    found.append(f"coalesce(sum(CASE WHEN {first} THEN _n END), 0L) AS n")
    found += [f"sum(CASE WHEN {first} THEN _t_{out} END) AS {out}" for out in totals]
    answer = steps.groupBy(*group_keys).agg(*map(F.expr, found))
    return answer.selectExpr(*map(name, group_keys), "n", *interpolated, *totals)


def two_phase_percentile(df: DataFrame, key: str, col: str, ps: Mapping[str, float]) -> DataFrame:
    """Percentiles of one column per key: ``ps`` maps an output name to a fraction."""
    return grouped_percentiles(df, [key], {out: (col, p) for out, p in ps.items()})
