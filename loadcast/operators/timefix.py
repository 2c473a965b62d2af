"""Repair of hourly time axes: series origin, skipped hours, doubled hours."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loadcast.functions.calendar import add_hours, seconds_between
from loadcast.operators.ordered import attach, join_nulls, range_chunks
from loadcast.sources.scratch import materialize

HOUR = 3600
CHAIN_BLOCK = 1000  # chunks whose maps are composed in one step


def shift_origin(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    time: str = "time",
    series_count: int | None = None,
) -> DataFrame:
    """Move a whole series one hour back when its first row is not at hour 0.

    The first row is found by an aggregate with map-side combine, one row per
    series.  ``series_count`` is the number of series where the caller knows it
    (say, the number of files).
    """
    place = F.col(order[0]) if len(order) == 1 else F.struct(*order)
    first = df.groupBy(*keys).agg(F.min_by(F.hour(time), place).alias("_first_hour"))
    moved = F.when(F.col("_first_hour") > 0, add_hours(F.col(time), F.lit(-1))).otherwise(F.col(time))
    return attach(df, first, keys, series_count).withColumn(time, moved).drop("_first_hour")


def _rule(gap: Column, compat_day_gap: bool) -> tuple[Column, Column]:
    """(needed state, correction given) for gaps other than 0, 1 and 2 hours.

    A gap of 3 h shows a skipped hour only behind a row moved forward, a gap of
    -1 h a doubled hour only behind a row moved back.  Every other gap starts
    afresh.  ``compat_day_gap`` also treats two days like two hours.
    """
    need = F.when(gap == 3 * HOUR, 1).when(gap == -HOUR, -1)
    give = F.when(gap == -HOUR, 1).when(gap == 3 * HOUR, -1)
    if compat_day_gap:
        need = need.when(gap == 48 * HOUR, 0).when(gap == 47 * HOUR, -1).when(gap == 49 * HOUR, 1)
        give = give.when(gap.isin(47 * HOUR, 48 * HOUR, 49 * HOUR), -1)
    return need, give


def _with_gaps(chunked: DataFrame, keys: list[str], time: str) -> DataFrame:
    """Add ``_gap`` (s to the previous row of the series) and ``_pos`` (row number)."""
    tails = chunked.groupBy(*keys, "_chunk").agg(
        F.max_by(time, "_id").alias("_tail"), F.count(F.lit(1)).alias("_rows")
    )
    # One row per chunk of a series: at most as many as there are chunks.
    along = W.partitionBy(*keys).orderBy("_chunk")
    borders = tails.select(
        *keys,
        "_chunk",
        F.lag("_tail").over(along).alias("_before"),
        (F.sum("_rows").over(along) - F.col("_rows")).alias("_offset"),
    )
    inside = W.partitionBy(*keys, "_chunk").orderBy("_id")
    previous = F.coalesce(F.lag(time).over(inside), F.col("_before"))
    return (
        join_nulls(chunked, borders, [*keys, "_chunk"])
        .withColumn("_pos", F.row_number().over(inside) + F.col("_offset"))
        .withColumn("_gap", seconds_between(previous, F.col(time)))
        .drop("_before", "_offset")
    )


def _symbolic(rows: DataFrame, keys: list[str], compat_day_gap: bool) -> DataFrame:
    """Columns from which ``_state`` gives a row's correction for any start state.

    Gaps of 0 h and 2 h flip between "no correction" and "some correction", so
    inside a segment the state is a running parity plus the kind of the last
    flip.  Segments begin at the other gaps.  What a segment begins with depends
    on the end of the one before only through the same flag, so it is a running
    parity again, started anew wherever a segment begins with "no correction" in
    any case.  All windows share one partitioning and one order.
    """
    inside = W.partitionBy(*keys, "_chunk").orderBy("_id")
    so_far = inside.rowsBetween(W.unboundedPreceding, W.currentRow)
    gap, begins = F.col("_gap"), F.col("_begins")
    need, give = _rule(gap, compat_day_gap)

    def latest(value: Column, where: Column) -> Column:
        return F.last(F.when(where, value), ignorenulls=True).over(so_far)

    out = rows.withColumns(
        {
            "_flip": F.when(gap == 0, 1).when(gap == 2 * HOUR, -1),
            "_begins": gap.isNull() | ~gap.isin(0, HOUR, 2 * HOUR),
            "_need": need,
            "_give": F.coalesce(give, F.lit(0)),
        }
    )
    out = out.withColumns(
        {
            "_all_flips": F.count("_flip").over(so_far),
            "_kind": F.last("_flip", ignorenulls=True).over(so_far),
            "_seg": F.count_if(begins).over(so_far),
        }
    )
    out = out.withColumns(
        {
            "_flips": F.col("_all_flips") - F.coalesce(latest(F.col("_all_flips"), begins), F.lit(0)),
            "_sign": latest(F.col("_give"), begins),
        }
    )
    out = out.withColumns(
        {
            "_end_flips": F.coalesce(F.lag("_flips").over(inside), F.lit(0)),
            "_end_kind": F.lag("_kind").over(inside),
            "_end_sign": F.lag("_sign").over(inside),
        }
    )
    end_sign = F.when(F.col("_end_flips") == 0, F.col("_end_sign")).otherwise(F.col("_end_kind"))
    later, wanted = begins & (F.col("_seg") > 1), F.col("_need")
    reset = begins & (wanted.isNull() | (later & (wanted != 0) & (F.coalesce(end_sign, F.lit(0)) != wanted)))
    turn = F.when(later & ~reset, F.col("_end_flips") + F.when(wanted == 0, 1).otherwise(0)).otherwise(0)
    opening = F.when(begins, F.struct("_need", "_end_flips", "_end_kind"))
    out = out.withColumns({"_turn": turn, "_reset": reset})
    out = out.withColumns(
        {
            "_opening": F.first(opening, ignorenulls=True).over(so_far),
            "_resets": F.count_if("_reset").over(so_far),
            "_all_turns": F.sum("_turn").over(so_far),
        }
    )
    since = F.coalesce(latest(F.col("_all_turns"), F.col("_reset")), F.lit(0))
    return out.withColumn("_turns", F.col("_all_turns") - since)


def _state(start: Column) -> Column:
    """Correction (-1, 0, +1 h) of a row whose chunk is entered in state ``start``."""

    def odd(n: Column) -> Column:
        return F.pmod(n, F.lit(2)) == 1

    opening = F.col("_opening")
    end = F.when(opening["_end_flips"] == 0, start).otherwise(
        F.when((start != 0) != odd(opening["_end_flips"]), opening["_end_kind"]).otherwise(0)
    )
    entered = (
        F.when(F.col("_seg") == 0, start != 0)
        .when(F.col("_resets") == 0, (end == opening["_need"]) != odd(F.col("_turns")))
        .otherwise(odd(F.col("_turns")))
    )
    sign = F.when(F.col("_seg") == 0, start).otherwise(F.col("_sign"))
    corrected = F.when(F.col("_flips") == 0, entered).otherwise(entered != odd(F.col("_flips")))
    kind = F.when(F.col("_flips") == 0, sign).otherwise(F.col("_kind"))
    return F.when(corrected, kind).otherwise(0).cast("int")


def _start_states(odd: DataFrame, keys: list[str]) -> DataFrame:
    """State in which each chunk of a series is left, from its odd gaps: one row per chunk that has any."""
    maps = (
        odd.groupBy(*keys, "_chunk")
        .agg(F.array(*[F.max_by(_state(F.lit(s)), "_id") for s in (-1, 0, 1)]).alias("map"))
    )
    # Two levels: blocks of chunks become one map each, the blocks of a series are
    # walked, and then the chunks of every block from the state it starts in.
    along = W.partitionBy(*keys).orderBy("_chunk")
    block = F.floor((F.row_number().over(along) - 1) / CHAIN_BLOCK).alias("_block")
    link = F.struct("_chunk", "map")
    blocks = maps.select(*keys, "_chunk", "map", block).groupBy(*keys, "_block").agg(F.sort_array(F.collect_list(link)).alias("chain"))
    through = F.aggregate(
        "chain",
        F.array(*[F.lit(s) for s in (-1, 0, 1)]),
        lambda ends, c: F.transform(ends, lambda state: F.element_at(c["map"], state + 2)),
    )
    composed = blocks.withColumn("map", through).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_block", "map"))).alias("chain"))
    ends = composed.select(*keys, F.inline(_walk("chain", F.lit(0), "_block")).alias("_block", "_end"))
    entered = ends.withColumn("_block", F.col("_block") + 1)
    begun = join_nulls(blocks, entered, [*keys, "_block"], "left").withColumn("_from", F.coalesce("_end", F.lit(0)))
    return begun.select(*keys, F.inline(_walk("chain", F.col("_from"), "_chunk")).alias("_chunk", "_end"))


def _walk(chain: str, start: Column, name: str) -> Column:
    """State behind each link of a chain of maps, as array<struct<name, _end>>; the chain is a block or a series of blocks."""
    return F.aggregate(
        chain,
        F.struct(start.alias("state"), F.array().cast(f"array<struct<{name}:bigint,_end:int>>").alias("ends")),
        lambda acc, c: F.struct(
            F.element_at(c["map"], acc["state"] + 2).alias("state"),
            F.concat(
                acc["ends"], F.array(F.struct(c[name].alias(name), F.element_at(c["map"], acc["state"] + 2).alias("_end")))
            ).alias("ends"),
        ),
        lambda acc: acc["ends"],
    )


def repair_hours(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    time: str = "time",
    compat_day_gap: bool = False,
    chunks: int | None = None,
    position: str | None = None,
) -> DataFrame:
    """Close skipped hours and spread doubled hours, in the order of the rows.

    Each time is compared with the already corrected time before it: two hours
    on means an hour was skipped (moved back one hour), the same hour means a
    doubled hour (moved on one hour).  ``order`` must be unique in a series;
    ``position`` names an optional row-number column to add.

    The correction is a three-state automaton.  Every chunk of the range-cut
    table yields the state it would end in for each of the three start states;
    chaining those small maps gives every chunk its true start state, and all
    chunks are then corrected independently.
    """
    keys, order = list(keys), list(order)
    chunked = range_chunks(df, keys, order, chunks)
    rows = materialize(_with_gaps(chunked, keys, time), "gaps")
    # Rows one hour apart hand the state on unchanged, whatever it is; only the others need the automaton.
    is_odd = F.col("_gap").isNull() | (F.col("_gap") != HOUR)
    odd = materialize(_symbolic(rows.filter(is_odd), keys, compat_day_gap), "odd")  # read for the maps and the states
    ends = _start_states(odd, keys)
    # A chunk without odd gaps has no row in `ends`; it hands its state on.
    along = W.partitionBy(*keys).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    starts = (
        join_nulls(rows.select(*keys, "_chunk").distinct(), ends, [*keys, "_chunk"], "left")
        .withColumn("_start", F.coalesce(F.last("_end", ignorenulls=True).over(along), F.lit(0)))
        .drop("_end")
    )
    known = join_nulls(odd, starts, [*keys, "_chunk"]).select(*rows.columns, _state(F.col("_start")).alias("_own"), "_start")
    # The chunk's start is the state of its rows before the first odd gap.
    plain = join_nulls(rows.filter(~is_odd), starts, [*keys, "_chunk"]).withColumn("_own", F.lit(None).cast("int"))
    so_far = W.partitionBy(*keys, "_chunk").orderBy("_id").rowsBetween(W.unboundedPreceding, W.currentRow)
    states = plain.unionByName(known).withColumn("_state", F.coalesce(F.last("_own", ignorenulls=True).over(so_far), F.col("_start")))
    fixed = states.withColumn(time, add_hours(F.col(time), F.col("_state")))
    extra = [F.col("_pos").alias(position)] if position else []
    return fixed.select(*df.columns, *extra)
