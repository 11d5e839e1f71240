"""Personal data: patterns propose spans, checksums confirm them, context words adjust the score.

Base kinds (email, ip, card, phone) are reported as their patterns and validators decide. Two
further kinds are proposed and reported only with enough score: `iban` (country code, the length
registered for it and mod-97 already score enough; codes without a registered length are no IBANs)
and `short_card` (13 to 15 digits that pass Luhn; one check digit is weak evidence, so a context
word is needed nearby). What follows either after a space (a word, a BIC, an amount, an expiry date)
is not taken for a part of it.

The patterns are written so that they take linear time on long unbroken runs: where a match can
only begin at the start of a run, the start is asserted, and repetitions do not backtrack where
nothing that follows could use it. The spans are those of the plain patterns.

Defined cases: a null or empty text has no spans; every row is scanned by itself, so null or
repeated `doc_id`s, ties and extra columns change nothing; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapelens.functions.scalar import let
from tapelens.llm import spans
from tapelens.llm.base import select_over, whole_text

#: Fixed kinds in the order of the listing.
BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("iban", "short_card")
EMAIL = (r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9]){15,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Length of an IBAN -> countries that use it (ISO 13616 registry).
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK",
    21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR",
    27: "BI DJ FR GF GP GR IT MC MF MQ MR NC PF PM RE SM TF WF YT", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
    29: "BR EG PS QA UA YE", 30: "JO KW MU", 31: "MT SC", 32: "LC", 33: "RU",
}
#: A proposal ends where its country's length is full, whatever follows after a space. Only its first
#: letter is consumed (group 1 is the whole), so one that fails mod-97 hides none that begins inside it.
IBAN = (r"(?<![A-Za-z0-9])(?=[A-Z]{2}[0-9]{2})(?=((?:" + "|".join(
    rf"(?:{countries.replace(' ', '|')})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{length - 4}}}"
    for length, countries in IBAN_LENGTHS.items()) + r")(?![A-Za-z0-9])))[A-Z]")
#: A number goes on after a hyphen, except where a month and a year follow.
_ENDS = r"(?![0-9])(?!-(?!(?:0?[1-9]|1[0-2])/[0-9]{2})[0-9])"
#: Unbroken; in the groups printed on cards; or in any groups, then with no further group beside it.
SHORT_CARDS = (
    rf"(?<![0-9])(?<![0-9]-)[0-9]{{13,15}}+{_ENDS}",
    r"(?<![0-9])(?:(?<![0-9]-)[0-9]{4}([\x20-])[0-9]{6}\1[0-9]{4,5}+"
    r"|(?<![0-9][\x20-])[0-9]{4}([\x20-])(?:[0-9]{3}\2[0-9]{3}\2[0-9]{3}|[0-9]{4}\2[0-9]{4}\2[0-9]{1,3}+))"
    + _ENDS,
    r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,14}+(?![\x20-]?[0-9])")
#: Kind -> score without context, words that raise it by CONTEXT_SCORE within CONTEXT characters.
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.7, "phone": 0.6, "iban": 0.8, "short_card": 0.4}
CONTEXT_WORDS = {
    "email": "email|e-mail|mail|contact|write",
    "ip": "ip|address|host|server|login",
    "card": "card|credit|debit|visa|payment|cvv|expires",
    "phone": "phone|tel|call|mobile|fax|contact",
    "iban": "iban|account|bank|transfer|konto|cuenta|compte",
    "short_card": "card|credit|debit|amex|visa|payment|cvv|expires",
}
CONTEXT, CONTEXT_SCORE, REPORT_FROM = 40, 0.3, 0.6


def _digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a digit string passes: from the right, every second digit doubled, cross sums."""
    values = F.transform(F.split(F.reverse(digits), ""), lambda c: c.cast("int"))

    def weighed(value: Column, i: Column) -> Column:
        twice = value * 2
        return F.when(i % 2 == 0, value).otherwise(twice - F.when(twice > 9, 9).otherwise(0))

    return F.aggregate(F.transform(values, weighed), F.lit(0), lambda a, b: a + b) % 10 == 0


def mod_97(compact: Column) -> Column:
    """Whether letters-as-numbers of the string, its first four characters moved to its end, are 1 mod 97."""
    moved = F.concat(F.substring(compact, 5, 60), F.substring(compact, 1, 4))
    values = F.transform(F.split(moved, ""), lambda c: F.ascii(c) - F.when(c.rlike("[0-9]"), 48).otherwise(55))
    return F.aggregate(values, F.lit(0), lambda rest, v: (
        rest * F.when(v > 9, 100).otherwise(10) + v) % 97) == 1


def _between(value: Column, low: int, high: int) -> Column:
    return (value >= low) & (value <= high)


def _proposals() -> dict[str, Column]:
    compact = lambda found: F.regexp_replace(found, r"\x20", "")
    length = lambda found: F.length(_digits(found))
    part = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
    return {
        "email": spans.find("body_", EMAIL, "email"),
        "ip": spans.find("body_", IP, "ip", lambda t: t.rlike(rf"^{part}(?:\.{part}){{3}}$")),
        "card": spans.find("body_", CARD, "card", lambda t: _between(length(t), 16, 19) & luhn(_digits(t))),
        "phone": spans.find("body_", PHONE, "phone", lambda t: _between(length(t), 8, 15)),
        "iban": spans.apart(spans.find("body_", IBAN, "iban", lambda t: mod_97(compact(t)), ahead=True)),
        **{f"short_card_{i}": spans.find("body_", pattern, "short_card", lambda t: luhn(_digits(t)))
           for i, pattern in enumerate(SHORT_CARDS)},
    }


def _short_cards() -> Column:
    """Those in any groups only where they meet none that is unbroken or in groups of cards."""
    sure = F.concat("short_card_0_", "short_card_1_")
    return F.concat(sure, spans.beside(F.col("short_card_2_"), sure))


def _score(span: Column, parts: Column) -> Column:
    low = F.greatest(F.lit(0), span["start"] - CONTEXT)
    near = F.lower(F.concat_ws(" ", spans.cut(parts, low, span["start"]),
                               spans.cut(parts, span["end"], span["end"] + CONTEXT)))
    score = F.lit(0.0)
    for kind, base in SCORES.items():
        in_context = near.rlike(rf"(?<![a-z])(?:{CONTEXT_WORDS[kind]})(?![a-z])")
        score = F.when(span["kind"] == kind, F.when(
            in_context, min(1.0, base + CONTEXT_SCORE)).otherwise(base)).otherwise(score)
    return score


def scan(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`base` and `found` (base and added, scored) span arrays of every row.

    `found` holds (start, end, kind, text, score), by kind as listed, then start.
    """
    read = select_over(docs, keep, body_=whole_text())
    made = read.select(*keep, "body_", *[value.alias(f"{kind}_") for kind, value in _proposals().items()])
    joined = made.select(
        *keep, "body_",
        F.concat(*[F.col(f"{kind}_") for kind in BASE_KINDS]).alias("base"),
        F.concat(F.col("iban_"), _short_cards()).alias("added"))
    scored = joined.select(
        *keep, spans.ordered(F.col("base"), BASE_KINDS, by_kind=True).alias("base"),
        F.when(F.size("base") + F.size("added") > 0, let(spans.chunks("body_"), lambda parts: F.transform(
            F.concat(spans.ordered(F.col("base"), BASE_KINDS, by_kind=True),
                     spans.ordered(F.col("added"), ADDED_KINDS, by_kind=True)),
            lambda s: F.struct(*[s[n].alias(n) for n in ("start", "end", "kind", "text")],
                               _score(s, parts).alias("score"))))).alias("all_"))
    reported = F.filter("all_", lambda s: s["kind"].isin(*BASE_KINDS) | (s["score"] >= REPORT_FROM))
    return scored.select(*keep, "base", reported.alias("found"))
