"""Point-in-time reads: cuts, session positions, as-of lookups and window joins.

Two shapes carry everything else:

* one row per (symbol, session) -> a window over `symbol`. The warehouse keys make that row
  unique, so a window partition holds at most one row per session of the calendar, however
  many trades a symbol has.
* a fact that lies in the window of several grid rows -> an equi join on (symbol, bin) where
  a bin is one window length wide. A busy symbol spreads over its bins, and each grid row
  meets only the two bins its window touches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapelens.schemas import CALENDAR_TABLES, TABLES
from tapelens.session import cut_lineage


def pit_filter(df: DataFrame, table: str, as_of) -> DataFrame:
    """Rows that were known on `as_of` (a date, ISO text or column)."""
    spec = TABLES[table]
    day = as_of if isinstance(as_of, Column) else F.lit(as_of).cast("date")
    known = F.col(spec.cut) <= day
    if spec.null_cut_passes:
        known = known | F.col(spec.cut).isNull()
    return df.where(known)


def symbol_since(df: DataFrame, table: str, symbol: str, since=None, as_of=None) -> DataFrame:
    cut = TABLES[table].cut
    out = df.where(F.col("symbol") == symbol)
    if as_of is not None:
        out = pit_filter(out, table, as_of)
    if since is not None:
        out = out.where(F.col(cut) >= F.lit(since).cast("date"))
    return out.orderBy(cut)


# -- calendar ---------------------------------------------------------------------------------
def trading_calendar(tables) -> DataFrame:
    """(trade_date, session_idx): the dates that really traded, counted from 1.

    One row per date, so the global window sorts a few thousand rows at any data size. Almost
    every operator asks for it, so a table set that can hold it (`calendar`) scans for the
    dates once and keeps the checkpointed result.
    """
    held = getattr(tables, "calendar", None)
    if held is not None:
        return held
    days = None
    for name in CALENDAR_TABLES:
        part = tables[name].select("trade_date").where("trade_date is not null").distinct()
        days = part if days is None else days.union(part)
    order = W.orderBy("trade_date")
    calendar = days.distinct().withColumn("session_idx", F.row_number().over(order))
    if hasattr(tables, "calendar"):
        tables.calendar = calendar = cut_lineage(calendar)
    return calendar


def last_sessions(calendar: DataFrame, as_of, count: int) -> DataFrame:
    """The last `count` sessions up to `as_of`, ascending."""
    day = F.lit(as_of).cast("date")
    recent = calendar.where(F.col("trade_date") <= day).orderBy(F.desc("trade_date")).limit(count)
    return recent.orderBy("trade_date")


def with_end_session(grid: DataFrame, calendar: DataFrame, strictly_before: bool = False,
                     on: str = "as_of") -> DataFrame:
    """Add `end_idx`: the last session at (or strictly before) the grid date.

    The lookup runs once per distinct date and is joined back by equality.
    """
    dates = grid.select(F.col(on).alias("_d")).distinct()
    probe_rank = 0 if strictly_before else 2
    points = (
        calendar.select(F.col("trade_date").alias("_d"), F.lit(1).alias("_rank"), "session_idx")
        .unionByName(dates.select("_d", F.lit(probe_rank).alias("_rank"),
                                  F.lit(None).cast("int").alias("session_idx")))
    )
    upto = W.orderBy("_d", "_rank").rowsBetween(W.unboundedPreceding, W.currentRow)
    located = (
        points.withColumn("end_idx", F.max("session_idx").over(upto))
        .where(F.col("_rank") == probe_rank).select("_d", "end_idx")
    )
    return grid.join(located, grid[on] == located["_d"], "left").drop("_d")


def with_session(df: DataFrame, calendar: DataFrame, on: str = "trade_date") -> DataFrame:
    """Add `session_idx` to dated rows; rows on other days than sessions are left out."""
    days = calendar.select(F.col("trade_date").alias("_d"), "session_idx")
    return df.join(days, df[on] == days["_d"]).drop("_d")


def between_sessions(df: DataFrame, calendar: DataFrame, on: str = "trade_date") -> DataFrame:
    """The rows on days that are no session, with the `session_idx` of the last session before.

    A window of sessions holds such a row when it holds that session, unless the row is later
    than the as-of date; whoever joins by session must compare the dates too.
    """
    other = df.join(calendar.select(F.col("trade_date").alias(on)), on, "left_anti")
    return with_end_session(other, calendar, on=on).withColumnRenamed("end_idx", "session_idx").where(
        F.col("session_idx").isNotNull())


def session_days(calendar: DataFrame, last: Column) -> DataFrame:
    """(trade_date, session_idx) of every day up to `last`: the last session at or before it.

    One row per day, so rows on sessions and between them find their session by one equality join.
    """
    following = F.lead("trade_date").over(W.orderBy("trade_date"))
    until = F.coalesce(F.date_sub(following, 1), F.greatest("trade_date", last))
    spans = calendar.select("session_idx", "trade_date", until.alias("_until"))
    return spans.select("session_idx", F.explode(F.sequence("trade_date", "_until")).alias("trade_date"))


# -- prices -----------------------------------------------------------------------------------
def price_history(tables, read=None) -> DataFrame:
    """One close per (symbol, date): daily_transaction first, daily_close fills the holes.

    `read` replaces the plain read of a table, as `window_reader` does.
    """
    keys = ["symbol", "trade_date"]
    parts = None
    for rank, name in enumerate(CALENDAR_TABLES):
        part = (read or tables.__getitem__)(name).where("close_price is not null").select(
            *keys, F.struct(F.lit(rank).alias("rank"), "close_price").alias("candidate"))
        parts = part if parts is None else parts.unionByName(part)
    return parts.groupBy(*keys).agg(F.min("candidate")["close_price"].alias("close_price"))


def last_session(df: DataFrame, column: str = "trade_date") -> DataFrame:
    return df.agg(F.max(column).alias("last_session"))


# -- as-of lookups ------------------------------------------------------------------------------
def asof_join(grid: DataFrame, facts: DataFrame, *, by: list[str], grid_on: str, fact_on: str,
              values: list[str], strict: bool = False, name: str = "latest") -> DataFrame:
    """Attach the newest fact at (or strictly before) each grid date as struct `name`.

    Union and forward fill instead of a range join: one shuffle on `by`, linear in the rows.
    Facts must be unique per (by, fact_on); the window then holds one row per date. `grid`
    must be unique on its columns.
    """
    grid_rank = 0 if strict else 2
    payload = F.struct(*[F.col(v) for v in values])
    fact_rows = facts.select(
        *by, F.col(fact_on).alias("_at"), F.lit(1).alias("_rank"), payload.alias(name))
    carried = [F.col(c) for c in grid.columns if c not in by]
    grid_rows = grid.select(*by, F.col(grid_on).alias("_at"), F.lit(grid_rank).alias("_rank"),
                            F.struct(*carried).alias("_grid"))
    both = fact_rows.unionByName(grid_rows, allowMissingColumns=True)
    upto = W.partitionBy(*by).orderBy("_at", "_rank").rowsBetween(
        W.unboundedPreceding, W.currentRow)
    filled = both.withColumn(name, F.last(name, ignorenulls=True).over(upto))
    return filled.where(F.col("_grid").isNotNull()).select(*by, "_grid.*", name)


def window_join(grid: DataFrame, facts: DataFrame, *, by: list[str], low: str, high: str,
                position: str, width: int) -> DataFrame:
    """Inner join of each grid row to the facts with `low <= position <= high`.

    Equality on (by, bin) with bins of `width`, the window length: a grid row meets two bins
    and half of what it meets is wanted, so the work is linear in the result.
    """
    bins = F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))
    left = grid.where(F.col(low) <= F.col(high)).withColumn("_bin", F.explode(bins))
    right = facts.withColumn("_bin", F.floor(F.col(position) / width))
    joined = left.join(right, [*by, "_bin"])
    return joined.where(F.col(position).between(F.col(low), F.col(high))).drop("_bin")


def window_reader(tables, ended: DataFrame, calendar: DataFrame, sessions: int, sparse: bool = False):
    """A read of dated tables cut down to the windows of a grid: name -> DataFrame.

    `ended` is the grid with `end_idx`. Only days from the first session of the earliest window to
    the last as-of date are read: the bounds are scalar subqueries, known before the scan
    starts, so they choose the folders of a stored table and reach the file scan as filters. For a
    `sparse` grid (few dates per symbol), rows of sessions that lie in no bin of a window are
    left out as well, by a semi-join on (symbol, bin), before anything is shuffled by symbol.
    """
    earliest = ended.agg(F.min("end_idx")).scalar()
    first = calendar.where(F.col("session_idx") > earliest - sessions).agg(F.min("trade_date")).scalar()
    last = ended.agg(F.max("as_of")).scalar()
    bins = F.sequence(F.floor((F.col("end_idx") - sessions + 1) / sessions), F.floor(F.col("end_idx") / sessions))

    def read(name: str) -> DataFrame:
        stored = getattr(tables, "read_between", None)
        rows = stored(name, first, last) if stored else tables[name]
        rows = rows.where(F.col(TABLES[name].cut).between(first, last))
        if not sparse:
            return rows
        wanted = ended.where("end_idx is not null").select("symbol", F.explode(bins).alias("_bin")).distinct()
        placed = with_session(rows, calendar).withColumn("_bin", F.floor(F.col("session_idx") / sessions))
        return placed.join(wanted, ["symbol", "_bin"], "left_semi").drop("_bin", "session_idx")

    return read


# -- grids --------------------------------------------------------------------------------------
def as_of_grid(symbols: DataFrame, dates: DataFrame) -> DataFrame:
    """Every symbol at every as-of date: the input every probe takes.

    The dates become one array (one entry per session at most) that each symbol explodes.
    """
    wanted = dates.agg(F.array_sort(F.collect_set("as_of"))).scalar()
    return symbols.select("symbol", F.explode(wanted).alias("as_of"))


def weekly_sessions(calendar: DataFrame) -> DataFrame:
    """The last session of each calendar week."""
    return calendar.groupBy(F.trunc("trade_date", "week").alias("week")).agg(
        F.max("trade_date").alias("as_of")).select("as_of")


def nth_session_before(events: DataFrame, calendar: DataFrame, lags: list[int],
                       on: str = "event_date") -> DataFrame:
    """Events x lags -> `as_of`, the lag-th session strictly before; missing ones drop out."""
    ended = with_end_session(events, calendar, strictly_before=True, on=on)
    wanted = ended.withColumn("lag", F.explode(F.array(*[F.lit(n) for n in lags])))
    wanted = wanted.withColumn("_idx", F.col("end_idx") - F.col("lag") + 1)
    days = calendar.select(F.col("session_idx").alias("_idx"), F.col("trade_date").alias("as_of"))
    return wanted.join(days, "_idx").drop("_idx", "end_idx")
