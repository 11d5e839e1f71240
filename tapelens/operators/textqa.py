"""Text checks: numbers and names without a source, forbidden wording, secrets, templates.

All but the JSON walk are regular expressions and array functions inside Spark, over whole
texts. `(?U)` gives letters and digits of every script their meaning.
"""

from __future__ import annotations

import json
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapelens import constants as K
from tapelens.functions import scalar as S

NUMBER = (
    r"(?U)(?<![\w,.])(?:\d{1,3}(?:\.\d{3})+(?:,\d+)?|\d+(?:,\d+)?)"
    rf"(?:\s?(?:{K.UNIT_PATTERN})(?!\w))?"
)
TICKER = r"(?U)(?<!\w)([A-Z]{4})(?!\w)"


def _text(col: Column) -> Column:
    return F.coalesce(col, F.lit(""))


# -- numbers ----------------------------------------------------------------------------------
def number_key(magnitude: Column, unit: Column) -> Column:
    return F.struct(F.round(F.abs(magnitude), 6).alias("magnitude"), unit.alias("unit"))


def number_tokens(text: Column) -> Column:
    """array<struct<token, key<magnitude, unit>>>: dots group thousands, a comma is decimal."""
    units = F.create_map(*[F.lit(x) for kv in K.UNIT_NAMES.items() for x in kv])

    def parse(token: Column) -> Column:
        digits = F.regexp_extract(token, r"^[\d.,]+", 0)
        unit = F.lower(F.trim(F.substr(token, F.length(digits) + 1)))
        value = F.translate(F.translate(digits, ".", ""), ",", ".").cast("double")
        return F.struct(F.trim(token).alias("token"),
                        number_key(value, F.coalesce(units[unit], F.lit(""))).alias("key"))

    return F.transform(F.regexp_extract_all(_text(text), F.lit(NUMBER), F.lit(0)), parse)


def allowed_numbers(evidence: Column) -> Column:
    """Keys a narrative may cite: from display and label, and the raw value in each unit the
    entry's display uses. `evidence` has string fields display, label and value."""

    def keys(text: Column) -> Column:
        return F.transform(number_tokens(text), lambda t: t["key"])

    def entry(e: Column) -> Column:
        shown = keys(e["display"])
        value = _text(e["value"])
        number = value.try_cast("double")
        units = F.array_union(F.array(F.lit("")), F.transform(shown, lambda k: k["unit"]))
        raw = F.when(F.lower(value).isin("true", "false", ""), F.slice(shown, 1, 0)).when(
            number.isNotNull(), F.transform(units, lambda u: number_key(number, u))
        ).otherwise(keys(value))
        return F.concat(shown, keys(e["label"]), raw)

    return F.array_distinct(F.flatten(F.transform(evidence, entry)))


def unsupported_numbers(narrative: Column, allowed: Column) -> Column:
    """Tokens whose key is not allowed, in order, each key once."""
    def first_of_each(strange: Column) -> Column:
        return S.let(F.transform(strange, lambda t: t["key"]), lambda keys: F.transform(
            F.filter(strange, lambda t, i: F.array_position(keys, t["key"]) == i + 1),
            lambda t: t["token"]))

    return S.let(allowed, lambda known: S.let(
        F.filter(number_tokens(narrative), lambda t: ~F.array_contains(known, t["key"])),
        first_of_each))


def number_rows(texts: DataFrame, keys: list[str], text: str) -> DataFrame:
    """`keys`, token, magnitude and unit, one row per number: parsed after the explode."""
    units = F.create_map(*[F.lit(x) for kv in K.UNIT_NAMES.items() for x in kv])
    raw = texts.select(*keys, F.explode(F.regexp_extract_all(_text(F.col(text)), F.lit(NUMBER), F.lit(0))).alias("_raw"))
    digits = raw.withColumn("_digits", F.regexp_extract("_raw", r"^[\d.,]+", 0))
    unit = F.lower(F.trim(F.substr(F.col("_raw"), F.length("_digits") + 1)))
    value = F.translate(F.translate("_digits", ".", ""), ",", ".").cast("double")
    return digits.select(*keys, F.trim("_raw").alias("token"), F.round(F.abs(value), 6).alias("magnitude"),
                         F.coalesce(units[unit], F.lit("")).alias("unit"))


def allowed_rows(entries: DataFrame, keys: list[str]) -> DataFrame:
    """`keys`, magnitude, unit: what `allowed_numbers` says, as a relation.

    `entries` has one row per evidence entry with string columns display, label and value.
    """
    out = [*keys, "magnitude", "unit"]
    value = _text(F.col("value"))
    none, number = F.lower(value).isin("true", "false", ""), value.try_cast("double")
    size = F.round(F.abs(number), 6)
    shown = number_rows(entries, [*keys, "value"], "display")
    parts = [
        shown.select(*out), number_rows(entries, keys, "label").select(*out),
        shown.where(~none & number.isNotNull()).select(*keys, size.alias("magnitude"), "unit"),
        entries.where(~none & number.isNotNull()).select(*keys, size.alias("magnitude"), F.lit("").alias("unit")),
        number_rows(entries.where(~none & number.isNull()), keys, "value").select(*out)]
    return reduce(lambda a, b: a.unionAll(b), parts).distinct()


def unsupported_rows(found: DataFrame, allowed: DataFrame, keys: list[str]) -> DataFrame:
    """`keys`, magnitude, unit of numbers without a source: one anti join for a whole corpus."""
    each = found.select(*keys, "magnitude", "unit").distinct()
    return each.join(allowed, [c for c in each.columns if c in allowed.columns], "left_anti")


# -- names --------------------------------------------------------------------------------------
def unsupported_tickers(narrative: Column, symbol: Column) -> Column:
    """Four-capital words that are neither the subject nor a known abbreviation."""
    found = F.array_distinct(F.regexp_extract_all(_text(narrative), F.lit(TICKER), F.lit(1)))
    fine = F.array(F.upper(F.trim(symbol)), *[F.lit(w) for w in K.ALLOWED_CAPITAL_WORDS])
    return F.array_except(found, fine)


# -- wording --------------------------------------------------------------------------------------
def _quote(before: Column, hit: Column, after: Column) -> Column:
    """The hit with up to 38 characters each side; one more character means the text goes on."""
    reach = K.QUOTE_REACH
    left = F.when(F.length(before) > reach, F.right(before, F.lit(reach))).otherwise(before)
    right = F.left(after, F.lit(reach))
    body = F.trim(F.translate(F.concat(left, hit, right), "\n", " "))
    return F.concat(F.when(F.length(before) > reach, "…").otherwise(""), body,
                    F.when(F.length(after) > reach, "…").otherwise(""))


def needed_words(pattern: str) -> list[str]:
    """Lower-case runs of letters one of which every match of `pattern` holds; none if unknown."""

    def needed(sequence) -> list[str]:
        found, run = [], ""
        for kind, value in [*sequence, ("END", None)]:
            letter = chr(value).lower() if str(kind) == "LITERAL" else ""
            if letter.isascii() and letter.isalpha():
                run += letter
                continue
            found, run = [*found, [run]], ""
            if str(kind) == "SUBPATTERN":
                found.append(needed(value[3]))
            elif str(kind) == "BRANCH":
                ways = [needed(way) for way in value[1]]
                found.append([word for way in ways for word in way] if all(ways) else [])
        return max((words for words in found if all(words)), key=lambda words: min(map(len, words), default=0), default=[])

    return needed(re._parser.parse(pattern))


#: Letters that a pattern without regard to case takes for ASCII ones, though lower() does not.
_FOLDED = "\u0130\u0131\u017f\u212a"


def _may_hold(text: Column, pattern: str) -> Column:
    """A cheap test before the pattern itself: plain searches for words it needs."""
    words = needed_words(pattern)
    if not words:
        return F.lit(True)
    return reduce(lambda a, b: a | b, [F.contains(F.lower(text), F.lit(word)) for word in words] + [
        F.contains(text, F.lit(letter)) for letter in _FOLDED])


def _hits(text: Column, pattern: str) -> Column:
    """array<struct<before, hit, after>> with one character more than a quote needs.

    The pattern runs twice, for the hits and for the pieces between; what stands around a hit is
    put together from its neighbours, each of which has at least one character.
    """
    far, full = K.QUOTE_REACH + 1, f"(?isuU)(?:{pattern})"
    found = F.regexp_extract_all(text, F.lit(full), F.lit(0))

    def around(hits: Column) -> Column:
        return S.let(F.split(text, full, -1), lambda pieces: S.let(
            F.transform(F.arrays_zip(pieces.alias("piece"), hits.alias("hit")),
                        lambda x: F.concat(x["piece"], F.coalesce(x["hit"], F.lit("")))),
            lambda both: F.transform(hits, lambda hit, i: F.struct(
                F.right(F.concat(F.array_join(F.slice(both, F.greatest(i - far, F.lit(0)) + 1, F.least(i, F.lit(far))), ""),
                                 F.get(pieces, i)), F.lit(far)).alias("before"),
                hit.alias("hit"),
                F.left(F.array_join(F.slice(both, i + 2, F.lit(far)), ""), F.lit(far)).alias("after")))))

    gated = F.when(_may_hold(text, pattern) & text.rlike(full), S.let(found, around))
    return F.coalesce(gated, F.array().cast("array<struct<before:string,hit:string,after:string>>"))


def wording_findings(text: Column, phrases: list[tuple[str, str]] | None = None,
                     sensitive: list[str] | None = None, service: str = K.SERVICE) -> Column:
    """array<struct<quote, reason>>: forbidden phrases, then sensitive words outside a fixed
    collocation. The exact disclaimer of `service` is removed first."""
    cleaned = F.replace(_text(text), F.lit(service + K.DISCLAIMER_TEXT), F.lit(" "))
    return S.let(cleaned, lambda clean: _findings(
        clean, K.FORBIDDEN_PHRASES if phrases is None else phrases,
        K.SENSITIVE_WORDS if sensitive is None else sensitive))


def _findings(clean: Column, phrases: list[tuple[str, str]], sensitive: list[str]) -> Column:
    def phrase(pattern: str, reason: str) -> Column:
        return F.transform(_hits(clean, pattern), lambda h: F.struct(
            _quote(h["before"], h["hit"], h["after"]).alias("quote"),
            F.lit(reason).alias("reason")))

    found = [phrase(*rule) for rule in phrases]

    def lone(h: Column) -> Column:
        reach = F.lit(K.COLLOCATION_REACH)
        previous = F.lower(F.regexp_extract(
            F.right(h["before"], reach), r"(?U)([\w-]+)[^\w-]*\z", 1))
        following = F.lower(F.regexp_extract(F.left(h["after"], reach), r"(?U)([\w-]+)", 1))
        return ~(previous.isin(*K.WORDS_BEFORE) | following.isin(*K.WORDS_AFTER))

    words = "|".join(sensitive)
    alone = F.filter(_hits(clean, rf"\b(?:{words})\b"), lone)
    found.append(F.transform(alone, lambda h: F.struct(
        _quote(h["before"], h["hit"], h["after"]).alias("quote"),
        F.concat(F.lit("bare word "), F.lower(h["hit"])).alias("reason"))))
    return F.concat(*found)


def vocabulary_scan(texts: DataFrame, text: str = "text", **rules) -> DataFrame:
    """One row per finding."""
    keep = [c for c in texts.columns if c != text]
    return texts.select(*keep, F.inline(wording_findings(F.col(text), **rules)))


# -- JSON leaves ------------------------------------------------------------------------------------
@F.udtf(returnType="path string, text string, problem string")
class JsonStringLeaves:
    """Every string in a JSON document with its path, such as $.a[0].b.

    A document that cannot be read gives one row with the reason.
    """

    def eval(self, document: str):
        try:
            open_nodes = [("$", json.loads(document))]
        except (TypeError, ValueError) as error:
            yield None, None, f"unreadable document: {error}"
            return
        while open_nodes:
            path, node = open_nodes.pop()
            if isinstance(node, str):
                yield path, node, None
            elif isinstance(node, dict):
                open_nodes += reversed([(f"{path}.{k}", v) for k, v in node.items()])
            elif isinstance(node, list):
                open_nodes += reversed([(f"{path}[{i}]", v) for i, v in enumerate(node)])


def json_string_leaves(documents: DataFrame, column: str = "document") -> DataFrame:
    keep = [c for c in documents.columns if c != column]
    leaves = JsonStringLeaves(F.col(column).outer())
    return documents.lateralJoin(leaves).select(*keep, "path", "text", "problem")


# -- cleaning -------------------------------------------------------------------------------------------
def redact(text: Column, secrets: list[str] | None = None) -> Column:
    """Mask known secrets (8 characters or more) and header-like patterns; keep the prefix."""
    out = text
    for secret in sorted((s for s in secrets or [] if len(s) >= 8), key=len, reverse=True):
        out = F.replace(out, F.lit(secret), F.lit(K.MASK))
    for pattern in (
        r"(authorization\s*[:=]\s*(?:bearer\s+)?)[\w.\-]{8,}",
        r"((?:api[_-]?key|x-api-key|token)\s*[\"']?\s*[:=]\s*[\"']?)[\w.\-]{8,}",
    ):
        out = F.regexp_replace(out, F.lit(f"(?iU){pattern}"), F.lit("$1" + K.MASK))
    return out


def no_em_dash(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s*—\s*", ", ")


def tidy_error(text: Column, limit: int = 150) -> Column:
    """Local paths out, white space collapsed, bars escaped, cut at `limit`."""
    out = F.regexp_replace(text, r"""[A-Za-z]:\\[^\s')"]+""", "<jalur lokal>")
    out = F.regexp_replace(out, r"""/(?:home|Users)/[^\s')"]+""", "<jalur lokal>")
    out = F.trim(F.regexp_replace(out, r"(?U)\s+", " "))
    out = F.replace(out, F.lit("|"), F.lit("\\|"))
    return F.concat(F.left(out, F.lit(limit)), F.when(F.length(out) > limit, "…").otherwise(""))


# -- narratives -----------------------------------------------------------------------------------------
def template_narrative(symbol: Column, band: Column, evidence: Column, steps: Column) -> Column:
    """Text put together from the evidence book: opener, first four numbers, counts in words.

    `steps` is an array of structs with a probe; it may be empty.
    """
    opener = F.lit(K.BAND_OPENERS["perhatian"])
    for name, text in K.BAND_OPENERS.items():
        opener = F.when(band == name, F.lit(text)).otherwise(opener)
    opener = F.replace(opener, F.lit("{s}"), symbol)
    shown = F.filter(F.slice(evidence, 1, 4), lambda e: F.length(_text(e["display"])) > 0)
    cited = F.array_join(F.transform(shown, lambda e: F.trim(F.concat_ws(
        " ", e["label"], e["display"]))), "; ")
    probes = F.array_distinct(F.filter(F.transform(steps, lambda s: s["probe"]),
                                       lambda p: p.isNotNull()))
    counts = F.concat(
        F.lit("Putusan disusun dari "), S.number_word(F.size(steps)),
        F.lit(" langkah penyelidikan yang menyentuh "), S.number_word(F.size(probes)),
        F.lit(" probe."))
    return F.concat_ws(
        " ", opener,
        F.when(F.size(shown) > 0, F.concat(F.lit("Bukti yang terkumpul: "), cited, F.lit("."))),
        F.when(F.size(steps) > 0, counts),
        F.lit("Seluruh angka di atas berasal dari buku bukti investigasi ini dan bisa "
              "ditelusuri ke sumber datanya."))


def narrative_source(text: Column, symbol: Column, evidence: Column) -> Column:
    """'llm' if the text passes every check, else 'template'."""
    clean = (
        (F.length(F.trim(_text(text))) > 0)
        & (F.size(unsupported_numbers(text, allowed_numbers(evidence))) == 0)
        & (F.size(unsupported_tickers(text, symbol)) == 0)
        & (F.size(wording_findings(text)) == 0)
    )
    return F.when(clean, "llm").otherwise("template")
