"""Column functions: score anchors, text formats, dates. All stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tapelens import constants as K


def let(value: Column, body) -> Column:
    """Evaluate `value` once and use it in `body` (lambdas have no common subexpressions)."""
    return F.get(F.transform(F.array(value), body), 0)


def clip(value: Column, low: float, high: float) -> Column:
    """Clip that keeps null as null (`greatest` and `least` alone would skip it)."""
    return F.when(value.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), value)))


def ramp(value: Column, low: float, high: float) -> Column:
    """0 at `low`, 100 at `high`, linear between, clipped outside."""
    if high == low:
        return F.when(value.isNotNull(), F.lit(0.0))
    return clip((value - F.lit(low)) / F.lit(high - low) * F.lit(100.0), 0.0, 100.0)


def norm01(value: Column, full: float) -> Column:
    """Share of a full signal; a signal that was not measured adds nothing."""
    return F.coalesce(clip(value / F.lit(full), 0.0, 1.0), F.lit(0.0))


def half_even(value: Column, digits: int = 0) -> Column:
    """Round half to even on the binary value (bround works on the shortest decimal text)."""
    scale = F.lit(float(10**digits))
    return F.rint(value * scale) / scale


def nearest(value: Column, digits: int) -> Column:
    """As `half_even`, but exact where the scaled value only looks like a tie.

    The product of value and scale is split into its nearest double and the rest, which decides
    between the two neighbours of a tie. For up to six digits.
    """
    scale = F.lit(float(10**digits))
    far = value * F.lit(134217729.0)  # 2^27 + 1: halves the bits of the value
    high = far - (far - value)
    product = value * scale
    rest = (high * scale - product) + (value - high) * scale
    tie = F.abs(product - F.floor(product).cast("double")) == 0.5
    return F.when(tie & (rest > 0), F.ceil(product).cast("double")).when(
        tie & (rest < 0), F.floor(product).cast("double")).otherwise(F.rint(product)) / scale


def band(score: Column) -> Column:
    expr = F.lit(K.BANDS[-1][1])
    for threshold, name in reversed(K.BANDS[:-1]):
        expr = F.when(score >= threshold, F.lit(name)).otherwise(expr)
    return F.when(score.isNotNull(), expr)


def keyword_any(text: Column, words: list[str]) -> Column:
    """True if any word occurs in the lower-cased text; null text matches nothing."""
    lowered = F.lower(F.coalesce(text, F.lit("")))
    return F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(lowered, w))


def keywords_found(text: Column, words: list[str]) -> Column:
    lowered = F.lower(F.coalesce(text, F.lit("")))
    return F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(lowered, w))


def word_any(text: Column, words: list[str]) -> Column:
    """Like keyword_any, but on word boundaries ("uma" is not found in "pengumuman")."""
    pattern = "|".join(words)
    return F.coalesce(text, F.lit("")).rlike(rf"(?iu)(?<!\w)(?:{pattern})(?!\w)")


# -- text formats ---------------------------------------------------------------------------
def fixed(value: Column, digits: int) -> Column:
    """Fixed decimals, half-even, decimal comma."""
    text = F.format_string(f"%.{digits}f", nearest(value, digits))
    return F.when(value.isNotNull(), F.translate(text, ".", ","))


def money(value: Column) -> Column:
    size = F.abs(value)
    sign = F.when(value < 0, "-").otherwise("")
    text = F.concat(sign, F.lit("Rp "), fixed(size, 0))
    for limit, unit in ((1e3, "rb"), (1e6, "jt"), (1e9, "M"), (1e12, "T")):
        text = F.when(
            size >= limit, F.concat(sign, F.lit("Rp "), fixed(size / limit, 1), F.lit(f" {unit}"))
        ).otherwise(text)
    return F.when(value.isNotNull(), text)


def money_short(value: Column) -> Column:
    """The board's form: no trailing ",0", dots between thousands below a million."""
    size = F.abs(value)
    sign = F.when(value < 0, "−").otherwise("")
    text = F.concat(
        sign, F.lit("Rp "), F.translate(F.format_number(F.floor(size + 0.5), 0), ",", "."))
    for limit, unit in ((1e6, "jt"), (1e9, "M"), (1e12, "T")):
        number = F.regexp_replace(fixed(size / limit, 1), ",0", "")
        text = F.when(
            size >= limit, F.concat(sign, F.lit("Rp "), number, F.lit(f" {unit}"))
        ).otherwise(text)
    return F.when(value.isNotNull(), text)


def percent(value: Column, digits: int = 0) -> Column:
    return F.concat(fixed(value * 100, digits), F.lit("%"))


def signed_percent(value: Column, digits: int = 0) -> Column:
    return F.concat(F.when(value >= 0, "+").otherwise(""), percent(value, digits))


def sigma(value: Column) -> Column:
    return F.concat(fixed(value, 1), F.lit("σ"))


def savings_label(pct: Column) -> Column:
    return (
        F.when(pct > 0, F.concat(F.lit("hemat "), pct.cast("string"), F.lit("%")))
        .when(pct < 0, F.concat((-pct).cast("string"), F.lit("% lebih boros")))
        .when(pct == 0, "setara baseline")
    )


def savings_sign(pct: Column) -> Column:
    return F.when(pct > 0, "good").when(pct < 0, "bad").when(pct == 0, "flat")


def number_word(n: Column) -> Column:
    words = F.array(*[F.lit(w) for w in K.NUMBER_WORDS])
    return F.when(n.between(0, len(K.NUMBER_WORDS) - 1), F.get(words, n)).otherwise("beberapa")


# -- dates ----------------------------------------------------------------------------------
def weekday_name(day: Column) -> Column:
    return F.get(F.array(*[F.lit(w) for w in K.WEEKDAY_NAMES]), F.dayofweek(day) - 1)


def is_weekend(day: Column) -> Column:
    return F.dayofweek(day).isin(1, 7)


def short_date(day: Column) -> Column:
    months = F.array(*[F.lit(m) for m in K.MONTH_NAMES])
    return F.concat_ws(" ", F.dayofmonth(day).cast("string"), F.get(months, F.month(day) - 1),
                       F.year(day).cast("string"))


def local_clock(iso_text: Column) -> Column:
    """ISO text with any offset -> "HH:mm WIB" (UTC+7); empty if missing or unreadable."""
    seconds = F.unix_timestamp(F.try_to_timestamp(iso_text)) + 7 * 3600
    of_day = F.pmod(seconds, F.lit(86400))
    clock = F.format_string("%02d:%02d WIB", F.floor(of_day / 3600), F.floor(of_day % 3600 / 60))
    return F.when(of_day.isNotNull(), clock).otherwise("")


def as_of_text(iso_text: Column) -> Column:
    pattern = r"^(\d{4}-\d{2}-\d{2})T(\d{2}):(\d{2})"
    parts = F.concat(F.regexp_extract(iso_text, pattern, 1), F.lit(" "),
                     F.regexp_extract(iso_text, pattern, 2), F.lit(":"),
                     F.regexp_extract(iso_text, pattern, 3), F.lit(" WIB"))
    return F.when(iso_text.rlike(pattern), parts).otherwise(iso_text)


def market_close_stamp(day: Column) -> Column:
    """A session date as the instant its market closed: 16:00 at UTC+7."""
    return F.to_timestamp(F.concat(day.cast("string"), F.lit("T16:00:00+07:00")))


def months_back(day: Column, months: int, first_of_month: bool = False) -> Column:
    """`months` earlier; day capped at 28, or the first of that month."""
    month = F.add_months(F.trunc(day, "MM"), -months)
    if first_of_month:
        return month
    return F.date_add(month, F.least(F.dayofmonth(day), F.lit(28)) - 1)


def weekdays_back(day: Column, count: int) -> Column:
    """The last `count` Monday-Friday dates up to `day`, ascending."""
    reach = count + 2 * (count // 5 + 2)
    days = F.filter(F.sequence(F.date_sub(day, reach), day), lambda d: F.weekday(d) < 5)
    return F.slice(days, -count, count)


def memory_ref(symbol: Column, day: Column) -> Column:
    return F.concat_ws("-", symbol, day.cast("string"))


def day_number(day: Column) -> Column:
    return F.datediff(day, F.lit("1970-01-01").cast("date"))


# -- rows -----------------------------------------------------------------------------------
def clean_symbol(raw: Column) -> Column:
    return F.regexp_replace(F.upper(F.trim(raw)), r"\.JK$", "")


def valid_symbol(symbol: Column, pattern: str = "^[A-Z]{4}$") -> Column:
    return F.coalesce(symbol.rlike(pattern), F.lit(False))


def date_part(raw: Column) -> Column:
    return F.try_to_date(F.substring_index(raw, "T", 1))


def as_fraction(pct: Column) -> Column:
    return F.when(pct > 1.0, pct / 100.0).otherwise(pct)
