"""Warehouse tables: explicit schemas, keys and the column that says when a fact was known."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class TableSpec:
    name: str
    ddl: str
    cut: str
    key: tuple[str, ...] = ()
    null_cut_passes: bool = False

    @property
    def types(self) -> dict[str, str]:
        return dict(part.split(" ", 1) for part in self.ddl.split(", "))

    @property
    def columns(self) -> list[str]:
        return list(self.types)


_SPECS = [
    TableSpec("daily_close", "trade_date date, symbol string, close_price double",
              "trade_date", ("trade_date", "symbol")),
    TableSpec("daily_transaction",
              "trade_date date, symbol string, close_price double, volume bigint, "
              "market_cap decimal(38,0)", "trade_date", ("trade_date", "symbol")),
    TableSpec("broker_summary",
              "trade_date date, symbol string, broker_code string, net_value double, "
              "buy_value double, sell_value double", "trade_date",
              ("trade_date", "symbol", "broker_code")),
    TableSpec("foreign_flow", "trade_date date, symbol string, net_value double",
              "trade_date", ("trade_date", "symbol")),
    TableSpec("free_float", "symbol string, free_float_pct double, as_of date",
              "as_of", ("symbol", "as_of")),
    TableSpec("suspensions", "symbol string, start_date date, end_date date, reason string",
              "start_date", ("symbol", "start_date")),
    TableSpec("filings",
              "filing_date date, symbol string, holder_name string, holder_type string, "
              "transaction_type string, shares bigint, price double", "filing_date"),
    TableSpec("corporate_actions",
              "symbol string, action_date date, action_type string, detail string",
              "action_date"),
    TableSpec("quarterly_financials",
              "symbol string, report_date date, revenue decimal(38,0), "
              "net_income decimal(38,0), total_assets decimal(38,0)", "report_date",
              ("symbol", "report_date")),
    TableSpec("company_profile",
              "symbol string, company_name string, sub_sector string, "
              "market_cap decimal(38,0), listing_date date", "listing_date", ("symbol",),
              null_cut_passes=True),
    TableSpec("investigations",
              "symbol string, as_of date, score int, band string, confidence double, "
              "credits_total int, transcript_path string", "as_of", ("symbol", "as_of")),
]
TABLES = {s.name: s for s in _SPECS}
CALENDAR_TABLES = ("daily_transaction", "daily_close")

LEDGER = (
    "ts string, phase string, endpoint string, transport string, credits int, "
    "params_hash string, run_id string, symbol string")

TRANSCRIPT = (
    "symbol string, as_of date, weights_version string, "
    "plan struct<hypotheses: array<struct<id: string, claim: string, probes: array<string>, "
    "priority: int>>, credit_budget_requested: int, rationale: string>, "
    "steps array<struct<step: int, hypothesis: string, probe: string, finding: string, "
    "next_action: string, new_probe: string, budget_granted: int, reason: string, "
    "credits_spent: int, credits_remaining: int>>, "
    "evidence array<struct<id: string, label: string, value: string, display: string, "
    "probe: string, source_endpoint: string, as_of: timestamp, credits_spent: int>>, "
    "components array<struct<code: string, sub_score: double, weight: double, "
    "evidence_ids: array<string>, investigated: boolean>>, "
    "score int, band string, confidence double, credits_total int, baseline_credits int, "
    "narrative string, narrative_source string, memory_ref string")

WATCHLIST = (
    "as_of string, generated_at string, credits_spent int, "
    "rows_written map<string,int>, skipped array<string>, failures array<string>, "
    "candidates array<struct<symbol: string, score: double, signals: struct<return_5d: double, "
    "return_20d: double, volume_z: double, small_cap: double, event: double>, reason: string>>")
