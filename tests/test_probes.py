from datetime import date

import pytest
from pyspark.sql import functions as F

import market
from tapelens import constants as K
from tapelens.operators import pit, probes, scoring, screen


@pytest.fixture(scope="module")
def scored(spark):
    df = probes.run_all(market.tables(spark), market.grid(spark))
    return {r["symbol"]: r for r in df.collect()}


def test_calm_symbol_scores_low(scored):
    for code in K.COMPONENTS:
        assert scored["FIXA"][code]["sub_score"] < 25, code


def test_alert_symbol_scores_high(scored):
    for code in ("VAS", "BCI", "PFD", "FRD"):
        assert scored["FIXB"][code]["sub_score"] > 50, code


def test_extreme_is_never_below_calm(scored):
    for code in K.COMPONENTS:
        assert scored["FIXC"][code]["sub_score"] >= scored["FIXA"][code]["sub_score"], code


def test_new_listing_gives_reasons(scored):
    row = scored["FIXD"]
    assert row["VAS"]["sub_score"] is None and "history" in row["VAS"]["unavailable_reason"]
    assert row["PFD"]["sub_score"] is None and row["PFD"]["unavailable_reason"]
    assert row["FFS"]["sub_score"] is not None


def test_suspended_symbol_does_not_fail(scored):
    assert scored["FIXE"]["SSS"]["sub_score"] == 40.0


def test_closes_only(scored):
    row = scored["FIXF"]
    for code in ("BCI", "VAS", "FFS", "FRD"):
        assert row[code]["sub_score"] is None and row[code]["unavailable_reason"]
    assert row["SSS"]["sub_score"] == 0.0


def test_structural_points(scored):
    # one suspension for an unusual move, two risky actions (both spellings)
    assert scored["FIXC"]["SSS"]["sub_score"] == 40 + 15 + 24
    assert scored["FIXB"]["SSS"]["sub_score"] == 30


def test_free_float_takes_the_newest_snapshot(scored):
    assert scored["FIXB"]["FFS"]["free_float_pct"] == 0.20


def test_empty_event_tables_are_not_clean(spark):
    tables = market.tables(spark)
    for name in ("suspensions", "filings", "corporate_actions"):
        tables[name] = tables[name].limit(0)
    rows = probes.structural(tables, market.grid(spark)).collect()
    assert all(r["sub_score"] is None and r["unavailable_reason"] for r in rows)


def test_future_rows_change_nothing(spark):
    before = probes.score_table(probes.run_all(market.tables(spark), market.grid(spark)))
    after = probes.score_table(
        probes.run_all(market.tables(spark, market.FUTURE), market.grid(spark)))
    assert sorted(map(str, before.collect())) == sorted(map(str, after.collect()))


def test_a_later_date_does_see_them(spark):
    grid = market.grid(spark, date(2026, 9, 9))
    before = probes.score_table(probes.run_all(market.tables(spark), grid))
    after = probes.score_table(probes.run_all(market.tables(spark, market.FUTURE), grid))
    assert sorted(map(str, before.collect())) != sorted(map(str, after.collect()))


def test_evidence_ids_are_unique_and_prefixed(spark):
    rows = probes.evidence_rows(
        probes.run_all(market.tables(spark), market.grid(spark))).collect()
    seen = [(r["symbol"], r["id"]) for r in rows]
    assert len(seen) == len(set(seen))
    assert all(K.PROBE_COMPONENT[r["probe"]] == r["id"][:3].upper() for r in rows)
    clean = [r for r in rows if r["symbol"] == "FIXF"]
    assert [r["id"] for r in clean] == ["sss.clean"]


def test_vas_against_brute_force(spark):
    tables = market.tables(spark)
    got = {r["symbol"]: r for r in probes.volume_anomaly(tables, market.grid(spark)).collect()}
    data = [r for r in market.rows()["daily_transaction"] if r[1] == "FIXB"]
    volumes = [float(r[3]) for r in sorted(data)][-120:]
    base = sorted(volumes[-91:-1])
    mid = lambda v: (sorted(v)[len(v) // 2] + sorted(v)[(len(v) - 1) // 2]) / 2
    med = mid(base)
    z = (volumes[-1] - med) / (mid([abs(v - med) for v in base]) * 1.4826)
    assert abs(got["FIXB"]["zscore"] - z) < 1e-12


def test_composite_null_is_not_zero(spark):
    df = spark.createDataFrame(
        [("A", 100.0, None), ("B", 100.0, 0.0), ("C", None, None)],
        "symbol string, BCI double, VAS double")
    for code in K.COMPONENTS[2:]:
        df = df.withColumn(code, F.lit(None).cast("double"))
    got = {r["symbol"]: r for r in scoring.composite(df).collect()}
    assert (got["A"]["score"], got["A"]["confidence"]) == (100, 0.25)
    assert (got["B"]["score"], got["B"]["confidence"]) == (53, 0.47)
    assert (got["C"]["score"], got["C"]["confidence"], got["C"]["band"]) == (0, 0.0, "normal")


@pytest.mark.parametrize("score, band", [
    (0, "normal"), (29, "normal"), (30, "perhatian"), (59, "perhatian"), (60, "waspada"),
    (79, "waspada"), (80, "sangat_waspada"), (100, "sangat_waspada")])
def test_band_boundaries(spark, score, band):
    from tapelens.functions.scalar import band as to_band
    assert spark.range(1).select(to_band(F.lit(score))).first()[0] == band


def test_screen_ranks_the_extreme_symbol_first(spark):
    rows = screen.watchlist(screen.screen(market.tables(spark), market.grid(spark))).orderBy(
        "rank").collect()
    assert rows[0]["symbol"] == "FIXC"
    assert "FIXD" not in {r["symbol"] for r in rows}  # twelve price rows only


def test_returns_count_sessions_not_rows(spark):
    tables = market.tables(spark)
    gone = market.DAYS[-3]
    for name in ("daily_transaction", "daily_close"):
        tables[name] = tables[name].where(~((F.col("symbol") == "FIXB")
                                            & (F.col("trade_date") == F.lit(gone))))
    calendar = pit.trading_calendar(tables)
    got = {r["symbol"]: r for r in screen.return_signals(
        tables, market.grid(spark), calendar).collect()}
    assert got["FIXB"]["return_5d"] is None and got["FIXB"]["return_20d"] is not None
    assert got["FIXA"]["return_5d"] == 0.0


def test_no_python_and_no_cartesian_in_the_probe_plan(spark):
    plan = probes.run_all(market.tables(spark), market.grid(spark))._jdf.queryExecution()
    text = plan.executedPlan().toString()
    for word in ("CartesianProduct", "PythonUDF", "ArrowEvalPython", "FlatMapGroupsInPandas"):
        assert word not in text


def test_scans_read_only_the_months_of_the_grid(spark, tmp_path):
    import contextlib
    import io

    from tapelens.sources.tables import Warehouse

    tables = market.tables(spark)
    stored = Warehouse(spark, str(tmp_path))
    for name, rows in tables.items():
        stored.upsert(name, rows)
    days = pit.trading_calendar(tables)
    day = date(2026, 5, 4)
    grid = market.grid(spark, day)
    for name, probe in probes.PROBES.items():
        assert sorted(map(str, probe(stored, grid).collect())) == sorted(map(str, probe(tables, grid).collect())), name
    with contextlib.redirect_stdout(io.StringIO()) as shown:
        probes.broker_net(stored, grid).explain("formatted")
    filters = [line for line in shown.getvalue().splitlines() if line.startswith("PartitionFilters") and "part#" in line]
    assert filters and all("subquery" in line.lower() for line in filters)
    ended = pit.with_end_session(grid, days)
    read = pit.window_reader(stored, ended, days, 20)("broker_summary")
    months = {f"{r.m:%Y-%m}" for r in read.select(F.trunc("trade_date", "MM").alias("m")).distinct().collect()}
    assert months <= {"2026-03", "2026-04", "2026-05"}
    few = pit.window_reader(stored, ended, days, 20, sparse=True)("daily_transaction")
    assert 0 < few.count() < tables["daily_transaction"].count()


def test_one_aggregation_joins_the_probes(spark):
    grid = market.grid(spark)
    scored = probes.run_all(market.tables(spark), grid, exclude=("SSS",))
    assert set(scored.columns) == {"symbol", "as_of", *K.COMPONENTS}
    rows = scored.collect()
    assert len(rows) == grid.count() and {r["SSS"]["unavailable_reason"] for r in rows} == {"excluded"}
    sparse = probes.run_all(market.tables(spark), grid, sparse=True)
    full = probes.run_all(market.tables(spark), grid)
    assert sorted(map(str, sparse.collect())) == sorted(map(str, full.collect()))


def test_the_screen_is_registered_on_every_session(spark):
    from statistics import median

    from tapelens.plans import probe_jobs, registry

    assert {f"{n}_daily" for n in probe_jobs.DAILY} <= registry.queries().keys() & registry.checks().keys()
    tables = market.tables(spark)
    screened = probe_jobs.DAILY["p11_screen_score"](tables, probe_jobs.session_grid).collect()
    assert {r["as_of"] for r in screened if r["symbol"] == "FIXB"} == set(market.DAYS[19:])
    got = {(r["symbol"], r["as_of"]): r["volume_z"] for r in probe_jobs.DAILY["w3_volume_zscore"](
        tables, probe_jobs.session_grid).collect()}
    volumes = {}
    for r in tables["daily_transaction"].collect():
        volumes.setdefault(r["symbol"], {})[r["trade_date"]] = float(r["volume"])
    assert len(got) == len(volumes) * len(market.DAYS)
    for (symbol, day), z in got.items():
        known = [v for d, v in sorted(volumes[symbol].items()) if d <= day]
        last = max((i for i, d in enumerate(market.DAYS) if d in volumes[symbol] and d <= day), default=-99)
        at, want = market.DAYS.index(day), None
        if len(known) >= 20 and (last >= at - 5 or at + 1 <= 5):
            middle = median(known[:-1])
            spread = median(abs(v - middle) for v in known[:-1]) * K.MAD_TO_SIGMA
            want = round((known[-1] - middle) / spread, 6) if spread > 0 else None
        assert z == (want if want is None else pytest.approx(want, abs=1e-6)), (symbol, day)
