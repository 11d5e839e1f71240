"""Raw JSON payloads -> typed rows, with the bad payloads kept apart.

A payload is text. Rows are `map<string,string>` until their fields are picked, so one code
path serves all shapes, alias lists and partial rows, and everything stays in Spark
expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapelens import constants as K
from tapelens.functions import scalar as S

ROW = "map<string,string>"

# endpoint -> field -> (alias list, type, required). "symbol" is required everywhere.
MODELS: dict[str, dict[str, tuple[str, str, bool]]] = {
    "fetch-close": {
        "trade_date": ("trade_date", "date", True), "close_price": ("close_price", "double", False)},
    "fetch-most-traded-stocks": {
        "trade_date": ("trade_date", "date", False), "volume": ("volume", "bigint", False),
        "price": ("close_price", "double", False)},
    "fetch-companies-top-changes": {
        "price_change": ("price_change", "double", False),
        "last_close": ("last_close", "double", False), "direction": ("direction", "string", False)},
    "fetch-suspensions": {
        "start_date": ("start_date", "date", True), "end_date": ("end_date", "date", False),
        "reason": ("reason", "string", False)},
    "fetch-filings": {
        "filing_date": ("filing_date", "date", True),
        "holder_name": ("holder_name", "string", False),
        "holder_type": ("holder_type", "string", False),
        "transaction_type": ("transaction_type", "string", False),
        "shares": ("shares", "bigint", False), "price": ("price", "double", False)},
    "fetch-daily-transaction": {
        "trade_date": ("trade_date", "date", True), "close_price": ("close_price", "double", False),
        "volume": ("volume", "bigint", False), "market_cap": ("market_cap", "bigint", False)},
    "fetch-broker-summary-top": {
        "trade_date": ("trade_date", "date", True), "broker_code": ("broker_code", "code", True),
        "net_value": ("net_value", "double", False), "buy_value": ("buy_value", "double", False),
        "sell_value": ("sell_value", "double", False)},
    "fetch-foreign-flow": {
        "trade_date": ("trade_date", "date", True), "net_value": ("foreign_net", "double", False)},
    "fetch-free-float": {
        "free_float_pct": ("free_float_pct", "fraction", False), "as_of": ("as_of", "date", False)},
    "fetch-company-report": {
        "company_name": ("company_name", "string", False),
        "sub_sector": ("sub_sector", "string", False),
        "market_cap": ("market_cap", "bigint", False),
        "listing_date": ("listing_date", "date", False)},
    "fetch-quarterly-financials": {
        "report_date": ("report_date", "date", True), "revenue": ("revenue", "bigint", False),
        "net_income": ("net_income", "bigint", False),
        "total_assets": ("total_assets", "bigint", False)},
    "fetch-corporate-actions": {
        "action_date": ("action_date", "date", True),
        "action_type": ("action_type", "string", False), "detail": ("detail", "string", False)},
    "fetch-shareholders-composition": {
        "holder_name": ("holder_name", "string", False), "share_pct": ("share_pct", "double", False)},
}
MODELS["fetch-broker-summary"] = MODELS["fetch-broker-summary-top"]
MODELS["fetch-companies-by-subsector"] = MODELS["fetch-company-report"]


# -- JSON helpers -----------------------------------------------------------------------------
def is_list(text: Column) -> Column:
    return F.coalesce(F.ltrim(text).startswith("["), F.lit(False))


def is_object(text: Column) -> Column:
    return F.coalesce(F.ltrim(text).startswith("{"), F.lit(False))


def as_map(text: Column) -> Column:
    return F.from_json(text, ROW)


def object_rows(text: Column) -> Column:
    """The objects of a JSON list as maps; other elements are left out."""
    elements = F.filter(F.from_json(text, "array<string>"), is_object)
    return F.coalesce(F.transform(elements, as_map), F.array().cast(f"array<{ROW}>"))


def over(base: Column, row: Column) -> Column:
    """Map union in which `row` wins."""
    kept = F.map_filter(base, lambda k, _: ~F.map_contains_key(row, k))
    return F.map_concat(kept, row)


def _pairs(*pairs: tuple[str, Column]) -> Column:
    return F.create_map(*[x for k, v in pairs for x in (F.lit(k), v.cast("string"))])


def no_rows() -> Column:
    return F.array().cast(f"array<{ROW}>")


# -- shapes ---------------------------------------------------------------------------------------
def _rows_of(payload: Column, shape) -> Column:
    """`shape` of the parsed object (parsed once), the plain rows of anything else."""
    return F.when(is_object(payload), S.let(as_map(payload), shape)).otherwise(unwrap(payload))


def unwrap(payload: Column) -> Column:
    """List, wrapper object or single object -> rows; the wrapper's symbol goes into the rows."""
    def shape(top: Column) -> Column:
        context = F.map_filter(top, lambda k, _: k.isin("symbol", "ticker"))

        def rows(base: Column) -> Column:
            out = F.array(top)
            for key in reversed(K.ENVELOPE_KEYS):
                inner = top[key]
                out = (
                    F.when(is_list(inner), F.transform(
                        object_rows(inner), lambda r: over(base, r)))
                    .when(is_object(inner), F.array(over(base, as_map(inner)))).otherwise(out))
            return out

        return S.let(context, rows)

    return F.when(is_list(payload), object_rows(payload)).when(
        is_object(payload), S.let(as_map(payload), shape)).otherwise(no_rows())


def keyed_by_date(payload: Column) -> Column:
    """{date: [rows]} -> rows with the date."""
    def shape(top: Column) -> Column:
        entries = F.filter(F.map_entries(top), lambda e: is_list(e["value"]))
        return F.flatten(F.transform(entries, lambda e: F.transform(
            object_rows(e["value"]), lambda r: over(_pairs(("date", e["key"])), r))))

    return _rows_of(payload, shape)


def top_changes(payload: Column) -> Column:
    """{top_gainers: {period: [rows]}, top_losers: ...} -> rows with direction and period."""
    def side(top: Column, name: str) -> Column:
        periods = F.filter(F.map_entries(F.coalesce(
            F.when(is_object(top[name]), as_map(top[name])), F.create_map().cast(ROW))),
            lambda e: is_list(e["value"]))
        return F.flatten(F.transform(periods, lambda e: F.transform(
            object_rows(e["value"]),
            lambda r: over(_pairs(("direction", F.lit(name)), ("period", e["key"])), r))))

    return _rows_of(payload, lambda top: F.concat(
        side(top, "top_gainers"), side(top, "top_losers")))


def company_report(payload: Column) -> Column:
    """Nested report -> one profile row; the sub-industry stands in for the sub-sector."""
    def shape(top: Column) -> Column:
        def row(overview: Column) -> Column:
            sector = F.coalesce(F.nullif(overview["sub_sector"], F.lit("")),
                                overview["sub_industry"])
            cells = _pairs(("symbol", top["symbol"]), ("company_name", top["company_name"]),
                           ("sub_sector", sector), ("market_cap", overview["market_cap"]),
                           ("listing_date", overview["listing_date"]))
            return F.array(F.map_filter(cells, lambda _, v: v.isNotNull()))

        return S.let(as_map(top["overview"]), row)

    return _rows_of(payload, shape)


def broker_top(payload: Column) -> Column:
    """Buyers and sellers -> rows with their side, dated at the end of the period."""
    def side(top: Column, name: str) -> Column:
        base = _pairs(("symbol", top["symbol"]), ("trade_date", top["end"]),
                      ("side", F.lit(name)))
        rows = F.coalesce(F.when(is_list(top[name]), object_rows(top[name])), no_rows())
        return F.transform(rows, lambda r: over(base, r))

    return _rows_of(payload, lambda top: F.concat(
        side(top, "top_buyers"), side(top, "top_sellers")))


def corporate_actions(payload: Column) -> Column:
    """{type: [rows]} -> rows dated by the column of their type; undated ones drop out."""
    fields = F.create_map(*[F.lit(x) for kv in K.ACTION_DATE_FIELD.items() for x in kv])

    def one(symbol: Column, kind: Column, row: Column) -> Column:
        column = F.coalesce(fields[kind], F.lit("ex_date"))
        present = lambda c: F.nullif(c, F.lit(""))
        day = F.coalesce(present(F.element_at(row, column)), present(row["ex_date"]),
                         present(row["date"]))
        detail = F.to_json(F.map_filter(row, lambda _, v: v.isNotNull() & (v != "")))
        return F.when(day.isNotNull(), _pairs(
            ("symbol", symbol), ("action_date", day), ("action_type", kind),
            ("detail", F.left(detail, F.lit(400)))))

    def shape(top: Column) -> Column:
        entries = F.filter(F.map_entries(as_map(top["corporate_actions"])),
                           lambda e: is_list(e["value"]))
        rows = F.flatten(F.transform(entries, lambda e: F.transform(
            object_rows(e["value"]), lambda r: one(top["symbol"], e["key"], r))))
        return F.when(is_object(top["corporate_actions"]),
                      F.filter(rows, lambda r: r.isNotNull()))

    return F.coalesce(F.when(is_object(payload), S.let(as_map(payload), shape)),
                      unwrap(payload))


SHAPES = {
    "fetch-broker-summary-top": broker_top,
    "fetch-corporate-actions": corporate_actions,
    "fetch-most-traded-stocks": keyed_by_date,
    "fetch-companies-top-changes": top_changes,
    "fetch-company-report": company_report,
}


def flatten(payloads: DataFrame, endpoint: str) -> DataFrame:
    """Add `rows array<map<string,string>>` in the shape of this endpoint."""
    return payloads.withColumn("rows", SHAPES.get(endpoint, unwrap)(F.col("payload")))


# -- fields -----------------------------------------------------------------------------------------
def pick(row: Column, aliases: list[str]) -> Column:
    """The first alias the row carries, even if its value is null."""
    value = F.lit(None).cast("string")
    for name in reversed(aliases):
        value = F.when(F.map_contains_key(row, F.lit(name)), row[name]).otherwise(value)
    return value


def typed(raw: Column, kind: str) -> Column:
    number = raw.try_cast("double")
    return {
        "date": lambda: S.date_part(raw),
        "double": lambda: number,
        "fraction": lambda: S.as_fraction(number),
        "bigint": lambda: F.when(number == F.floor(number), F.coalesce(
            raw.try_cast("bigint"), number.try_cast("bigint"))),
        "code": lambda: F.upper(F.trim(raw)),
        "string": lambda: raw,
    }[kind]()


def parse(payloads: DataFrame, endpoint: str, symbol_pattern: str = "^[A-Z]{4}$") -> DataFrame:
    """payload_id, payload, valid, failure, records: one row per payload.

    One invalid row fails its payload; an explicitly empty payload is a valid answer; an API
    error field is a failure. `records` holds the typed rows.
    """
    model = MODELS[endpoint]

    def said(top: Column) -> Column:
        error = F.when(is_object(F.col("payload")), F.coalesce(
            F.nullif(top["error"], F.lit("")), F.nullif(top["detail"], F.lit(""))))
        page_total = as_map(top["pagination"])["total_count"].try_cast("bigint")
        empty_key = F.lit(False)
        for key in K.ENVELOPE_KEYS:
            empty_key = empty_key | F.coalesce(top[key].rlike(r"^\s*\[\s*\]\s*$"), F.lit(False))
        says_empty = F.when(is_list(F.col("payload")), F.lit(True)).otherwise(
            F.coalesce(page_total == 0, F.lit(False)) | empty_key)
        return F.struct(error.alias("error"), says_empty.alias("empty"))

    def record(row: Column) -> Column:
        """One row's fields and whether they hold; every field is picked and cast once."""
        texts = F.struct(pick(row, K.FIELD_ALIASES["symbol"]).alias("symbol"), *[
            pick(row, K.FIELD_ALIASES.get(alias, [alias])).alias(name)
            for name, (alias, _, _) in model.items()])

        def judged(raw: Column, fields: Column) -> Column:
            good = S.valid_symbol(fields["symbol"], symbol_pattern)
            for name, (_, _, required) in model.items():
                present = fields[name].isNotNull()
                good = good & (present if required else raw[name].isNull() | present)
            return F.struct(good.alias("ok"), fields.alias("fields"))

        return S.let(texts, lambda raw: S.let(F.struct(
            S.clean_symbol(raw["symbol"]).alias("symbol"),
            *[typed(raw[name], kind).alias(name) for name, (_, kind, _) in model.items()]),
            lambda fields: judged(raw, fields)))

    # Lambdas and pushed filters have no common subexpressions, so the answer and its rows are
    # bound once and the columns below only look into them.
    read = flatten(payloads, endpoint).select(
        *payloads.columns, S.let(as_map(F.col("payload")), said).alias("said"),
        S.let(F.col("rows"), lambda rows: F.struct(
            (F.size(F.coalesce(rows, no_rows())) == 0).alias("nothing"),
            F.transform(rows, record).alias("checked"))).alias("found"))
    error = F.col("said.error")
    failure = (
        F.when(error.isNotNull(), F.concat(F.lit("API error: "), error))
        .when(F.col("found.nothing") & ~F.col("said.empty"), "no readable rows")
        .when(F.exists("found.checked", lambda c: ~c["ok"]), "invalid row")
    )
    return read.withColumn("failure", failure).select(
        *payloads.columns, F.col("failure").isNull().alias("valid"), "failure",
        F.col("found.checked.fields").alias("records"))


def good_rows(parsed: DataFrame) -> DataFrame:
    """The rows of the valid payloads.

    The condition stands inside the generator: as a filter it would be pushed below the parsing
    and read every payload again.
    """
    keep = [c for c in parsed.columns if c not in ("payload", "valid", "failure", "records")]
    return parsed.select(*keep, F.inline(F.when(F.col("valid"), F.col("records"))))


def quarantined(parsed: DataFrame) -> DataFrame:
    return parsed.where("not valid").drop("records", "valid")


def split_and_store(parsed: DataFrame, good_path: str, quarantine_path: str) -> None:
    """Good rows and quarantined payloads to two datasets, from one pass over the payloads."""
    held = parsed.persist()
    try:
        good_rows(held).write.mode("append").parquet(good_path)
        quarantined(held).write.mode("append").parquet(quarantine_path)
    finally:
        held.unpersist()


def replay(quarantine: DataFrame, endpoint: str, symbol_pattern: str = "^[A-Z]{4}$") -> DataFrame:
    """Parse quarantined payloads again with today's rules."""
    return parse(quarantine.drop("failure"), endpoint, symbol_pattern)


def payload_shape(payloads: DataFrame) -> DataFrame:
    """kind, row count and sorted keys of the first row of each payload."""
    rows = unwrap(F.col("payload"))
    kind = F.when(is_list(F.col("payload")), "list").when(is_object(F.col("payload")), "dict")
    keys = F.array_sort(F.map_keys(F.get("rows", F.lit(0))))
    return payloads.withColumn("rows", rows).select(
        *[c for c in payloads.columns if c != "payload"], kind.alias("kind"),
        F.size("rows").alias("n_rows"),
        F.coalesce(keys, F.array().cast("array<string>")).alias("keys"))
