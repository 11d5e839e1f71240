"""The daily screen: cheap signals per symbol and date, a weighted score and the watchlist."""

from __future__ import annotations

import bisect

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapelens import constants as K
from tapelens.functions import scalar as S
from tapelens.operators import pit


def aligned_prices(tables, calendar: DataFrame) -> DataFrame:
    """Closes placed on their session number: sessions without a close stay absent."""
    return pit.with_session(pit.price_history(tables), calendar)


def session_return(sessions: int, whole: bool = False) -> Column:
    """Return over exactly `sessions` sessions; null unless both ends traded.

    `whole` also refuses a hole in between. For use on rows with `session_idx` and
    `close_price` (null on marker rows).
    """
    base = W.partitionBy("symbol").orderBy("session_idx")
    start = F.max("close_price").over(base.rangeBetween(-sessions, -sessions))
    end = F.max("close_price").over(base.rangeBetween(0, 0))
    usable = (start > 0) & end.isNotNull()
    if whole:
        usable = usable & (
            F.count("close_price").over(base.rangeBetween(-sessions, 0)) == sessions + 1)
    return F.when(usable, end / start - 1)


def return_signals(tables, grid: DataFrame, calendar: DataFrame) -> DataFrame:
    """return_5d, return_20d and the number of price rows known at each grid date."""
    markers = pit.with_end_session(grid, calendar).select(
        "symbol", F.col("end_idx").alias("session_idx"), "as_of")
    rows = aligned_prices(tables, calendar).select(
        "symbol", "session_idx", "close_price").unionByName(markers, allowMissingColumns=True)
    upto = W.partitionBy("symbol").orderBy("session_idx").rangeBetween(
        W.unboundedPreceding, W.currentRow)
    return (
        rows.withColumn("price_rows", F.count("close_price").over(upto))
        .withColumn("return_5d", session_return(5, whole=True))
        .withColumn("return_20d", session_return(20))
        .where("as_of is not null")
        .select("symbol", "as_of", "price_rows", "return_5d", "return_20d")
    )


def _running_zscore(rows: pd.DataFrame) -> pd.DataFrame:
    """Robust z of every volume of a symbol against all earlier ones, in one ordered pass.

    The earlier volumes are kept sorted; the median deviation is found between the two sorted
    halves beside the median by bisection.
    """
    seen: list[float] = []
    out: list[tuple[int, float | None]] = []

    def deviation(k: int, middle: float, left: int) -> float:
        """The k-th smallest distance to `middle`; `left` volumes are below it."""
        below = lambda i: middle - seen[left - 1 - i]
        above = lambda i: seen[left + i] - middle
        low, high = max(0, k + 1 - (len(seen) - left)), min(k + 1, left)
        while low < high:
            i = (low + high) // 2
            low, high = (i + 1, high) if below(i) < above(k - i) else (low, i)
        return max([below(low - 1)] * (low > 0) + [above(k - low)] * (low <= k))

    ordered = rows.sort_values(["session_idx", "v"])
    for session, value in zip(ordered["session_idx"].tolist(), ordered["v"].tolist()):
        z, n = None, len(seen)
        if n + 1 >= K.SCREEN_MIN_ROWS:
            half = (n - 1) // 2
            middle = (seen[half] + seen[n // 2]) / 2
            left = bisect.bisect_left(seen, middle)
            spread = (deviation(half, middle, left) + deviation(n // 2, middle, left)) / 2 * K.MAD_TO_SIGMA
            z = (value - middle) / spread if spread > 0 else None
        if out and out[-1][0] == session:
            out.pop()
        out.append((session, z))
        bisect.insort(seen, value)
    made = pd.DataFrame(out, columns=["session_idx", "volume_z"]).astype({"volume_z": "float64"})
    return made.assign(symbol=rows["symbol"].iloc[0])[["symbol", "session_idx", "volume_z"]]


def volume_zscore(tables, grid: DataFrame, calendar: DataFrame,
                  fresh_sessions: int = K.SCREEN_FRESH) -> DataFrame:
    """Robust z of the last volume against all earlier rows; null if short, flat or stale.

    The score of every traded session comes from one pass over the symbol's volumes (at most
    one per session); the grid looks up the newest, so its density costs no more passes.
    """
    volumes = pit.with_session(
        tables["daily_transaction"].where("volume is not null and symbol is not null"), calendar).select(
        "symbol", "session_idx", F.col("volume").cast("double").alias("v"))
    scored = volumes.groupBy("symbol").applyInPandas(
        _running_zscore, "symbol string, session_idx int, volume_z double")
    ended = pit.with_end_session(grid, calendar).select("symbol", "as_of", "end_idx").join(
        volumes.select("symbol").distinct(), "symbol", "left_semi")
    known = pit.asof_join(ended, scored, by=["symbol"], grid_on="end_idx", fact_on="session_idx",
                          values=["session_idx", "volume_z"])
    fresh = ((F.col("latest.session_idx") >= F.col("end_idx") - fresh_sessions)
             | (F.col("end_idx") <= fresh_sessions))
    return known.select("symbol", "as_of", F.when(fresh, F.col("latest.volume_z")).alias("volume_z"))


def small_cap(tables, grid: DataFrame) -> DataFrame:
    profile = tables["company_profile"].select("symbol", "market_cap", "listing_date")
    known = F.col("listing_date").isNull() | (F.col("listing_date") <= F.col("as_of"))
    flag = F.when(known & F.col("market_cap").isNotNull(),
                  F.when(F.col("market_cap") < K.SMALL_CAP, 1.0).otherwise(0.0))
    return grid.select("symbol", "as_of").join(profile, "symbol", "left").select(
        "symbol", "as_of", flag.alias("small_cap"))


def recent_event(tables, grid: DataFrame, days: int = K.EVENT_DAYS) -> DataFrame:
    """Flag: a suspension or filing in the last `days` calendar days."""
    events = (
        tables["suspensions"].select("symbol", F.col("start_date").alias("event_day"))
        .unionByName(tables["filings"].select("symbol", F.col("filing_date").alias("event_day")))
        .where("event_day is not null").distinct()
    )
    known = pit.asof_join(grid.select("symbol", "as_of"), events, by=["symbol"],
                          grid_on="as_of", fact_on="event_day", values=["event_day"])
    recent = F.col("latest.event_day") >= F.date_sub("as_of", days)
    return known.select("symbol", "as_of", F.coalesce(recent, F.lit(False)).alias("event"))


def screen(tables, grid: DataFrame) -> DataFrame:
    """Signals, score (4 digits) and reason for every grid point with 20 or more price rows."""
    calendar = pit.trading_calendar(tables)
    keys = ["symbol", "as_of"]
    wide = return_signals(tables, grid, calendar).where(F.col("price_rows") >= K.SCREEN_MIN_ROWS)
    for part in (volume_zscore(tables, grid, calendar), small_cap(tables, grid),
                 recent_event(tables, grid)):
        wide = wide.join(part, keys, "left")
    wide = wide.withColumn("event", F.coalesce("event", F.lit(False)))
    signals = {k: F.col(k) for k in K.SCREEN_WEIGHTS}
    signals["event"] = F.col("event").cast("double")
    score = F.lit(0.0)
    for name, weight in K.SCREEN_WEIGHTS.items():
        score = score + weight * S.norm01(signals[name], K.SCREEN_FULL[name])
    return wide.withColumn("score", S.half_even(score, 4)).withColumn("reason", screen_reason())


def screen_reason() -> Column:
    def percent(c: Column) -> Column:
        return F.format_string("%+.0f%%", S.half_even(c * 100))

    z, r5, r20 = F.col("volume_z"), F.col("return_5d"), F.col("return_20d")
    said = F.concat_ws(
        "; ",
        F.when(z >= 2, F.format_string("volume %.1fσ di atas baseline", S.half_even(z, 1))),
        F.when(F.abs(r5) >= 0.1, F.concat(F.lit("harga "), percent(r5),
                                          F.lit(" dalam 5 hari bursa"))),
        F.when(F.abs(r20) >= 0.2, F.concat(F.lit("harga "), percent(r20),
                                           F.lit(" dalam 20 hari bursa"))),
        F.when(F.col("small_cap") == 1.0, "kapitalisasi kecil"),
        F.when(F.col("event"), "ada suspensi/filing baru"))
    return F.when(said == "", "tidak ada sinyal menonjol").otherwise(said)


def watchlist(screened: DataFrame, size: int = K.WATCHLIST_SIZE) -> DataFrame:
    """Top `size` per date, score first, then symbol."""
    order = W.partitionBy("as_of").orderBy(F.desc("score"), "symbol")
    return screened.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size)


def signals_text(candidates: DataFrame) -> DataFrame:
    """The signals of a candidate as a map of readable texts; missing ones are left out."""
    pct = lambda c: F.format_string("%+.0f%%", S.half_even(F.col(c) * 100))
    pairs = {
        "volume_z": F.format_string("%.1fσ di atas baseline", S.half_even(F.col("volume_z"), 1)),
        "return_5_hari_bursa": pct("return_5d"),
        "return_20_hari_bursa": pct("return_20d"),
        "kapitalisasi": F.when(F.col("small_cap") > 0, "kecil"),
        "peristiwa_korporasi": F.when(F.col("event"), "ada dalam periode"),
        "skor_seleksi_watchlist": F.format_string("%.2f", S.half_even(F.col("score"), 2)),
        "alasan_masuk_watchlist": F.when(F.col("reason") != "", F.col("reason")),
    }
    needs = {"volume_z": "volume_z", "return_5_hari_bursa": "return_5d",
             "return_20_hari_bursa": "return_20d", "skor_seleksi_watchlist": "score"}
    cells = []
    for name, text in pairs.items():
        if name in needs:
            text = F.when(F.col(needs[name]).isNotNull(), text)
        cells += [F.lit(name), text]
    return candidates.withColumn(
        "signals", F.map_filter(F.create_map(*cells), lambda _, v: v.isNotNull()))
