"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document. The ledger keeps the measurements and one failure
bit per rule; a policy is a named, versioned set of rules, applied later by a bitwise AND, so a
new policy or an ablation never reads a text again.

Defined cases: a null or empty text has no words (it fails `few_words`); a null `doc_id` and
repeated rows are kept as rows of their own (nothing is grouped by document); an empty table
gives an empty ledger; extra columns of the input are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapelens.llm.base import bits_of, select_over, whole_text, word_list

WINDOW = 5
SYMBOLS = r"[#*$%&|<>]"


@dataclass(frozen=True)
class Rule:
    """`fails` is a condition over the measurements that reads the same in any SQL."""

    name: str
    fails: str


#: The position of a rule is its bit; add at the end only.
RULES = (
    Rule("few_words", "n_words < 10"),
    Rule("repeated_words", "100 * n_repeat_words > 20 * n_words"),
    Rule("symbols", "100 * n_symbols > 10 * n_words"),
    Rule("repeated_lines", "100 * n_dup_lines > 50 * n_lines"),
    Rule("word_length", "word_chars < 2 * n_words OR word_chars > 20 * n_words"),
)

#: Version of a policy -> rules that reject a document.
POLICIES = {
    "base": ("few_words", "repeated_words"),
    "v1": ("few_words", "repeated_words", "symbols", "repeated_lines", "word_length"),
}
CURRENT = "v1"


def mask_of(rules: tuple[str, ...]) -> int:
    names = [rule.name for rule in RULES]
    return sum(1 << names.index(name) for name in set(rules))


def measure(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Measurements per row; all work stays inside the row, so nothing is shuffled.

    Words in repeated windows are counted without comparing windows pairwise: windows are
    sorted with their positions, equal neighbours mark both, and the marked positions, sorted
    again, add at most WINDOW words each.
    """
    read = select_over(docs, keep, body_=whole_text()).withColumn("words_", word_list(F.col("body_")))
    lines = F.filter(F.split("body_", "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    windows = F.when(
        F.size("words_") >= WINDOW,
        F.transform(F.sequence(F.lit(1), F.size("words_") - (WINDOW - 1)),
                    lambda i: F.array_join(F.slice("words_", i, WINDOW), " ")))
    counted = read.select(
        *keep,
        F.size("words_").cast("long").alias("n_words"),
        F.length(F.array_join("words_", "")).cast("long").alias("word_chars"),
        (F.length("body_") - F.length(F.regexp_replace("body_", SYMBOLS, "")))
        .cast("long").alias("n_symbols"),
        lines.alias("lines_"), windows.alias("windows_"))
    ordered = counted.select(
        *keep, "n_words", "word_chars", "n_symbols",
        F.size("lines_").cast("long").alias("n_lines"),
        (F.size("lines_") - F.size(F.array_distinct("lines_"))).cast("long").alias("n_dup_lines"),
        F.when(F.size(F.array_distinct("windows_")) < F.size("windows_"),
               F.array_sort(F.arrays_zip(
                   F.col("windows_").alias("w"),
                   F.sequence(F.lit(1), F.size("windows_")).alias("p")))).alias("ordered_"))
    places = ordered.withColumn("places_", F.array_sort(F.filter(
        F.transform("ordered_", lambda x, i: F.when(
            (F.get("ordered_", i - 1)["w"] == x["w"]) | (F.get("ordered_", i + 1)["w"] == x["w"]),
            x["p"])), lambda p: p.isNotNull())))
    covered = F.aggregate(
        F.transform("places_", lambda p, i: F.when(i == 0, WINDOW).otherwise(
            F.least(F.lit(WINDOW), p - F.get("places_", i - 1)))),
        F.lit(0), lambda total, n: total + n)
    return places.select(
        *keep, "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines",
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def ledger(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Measurements and `failure_bits`, one bit per rule."""
    return measure(docs, keep).withColumn(
        "failure_bits", bits_of([F.expr(rule.fails) for rule in RULES]))


def rejected(bits: Column, rules: tuple[str, ...]) -> Column:
    return bits.bitwiseAND(F.lit(mask_of(rules)).cast("long")) != 0


def apply_policies(rows: DataFrame, policies: dict[str, tuple[str, ...]] = POLICIES) -> DataFrame:
    """A boolean column `kept_<version>` for each policy; only the bits are read."""
    return rows.withColumns(
        {f"kept_{name}": ~rejected(F.col("failure_bits"), rules) for name, rules in policies.items()})


def ablations(rows: DataFrame, policies: dict[str, tuple[str, ...]] = POLICIES) -> DataFrame:
    """Per policy and rule: how many documents fail it, and how many would come back without it.

    The ledger is counted by bit pattern first (at most 2^rules rows, summed before the
    shuffle); everything else works on those patterns.
    """
    patterns = rows.groupBy("failure_bits").agg(F.count(F.lit(1)).alias("n"))
    cases = F.array(*[
        F.struct(F.lit(version).alias("policy"), F.lit(name).alias("rule"),
                 F.lit(mask_of(rules)).cast("long").alias("mask"),
                 F.lit(mask_of((name,))).cast("long").alias("bit"))
        for version, rules in policies.items() for name in rules])
    each = patterns.select("failure_bits", "n", F.inline(cases))
    of_policy = F.col("failure_bits").bitwiseAND(F.col("mask"))
    return each.groupBy("policy", "rule").agg(
        F.sum("n").alias("n_docs"),
        F.sum(F.when(of_policy == 0, F.col("n")).otherwise(0)).alias("n_kept"),
        F.sum(F.when(of_policy.bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0))
        .alias("n_failing"),
        F.sum(F.when(of_policy == F.col("bit"), F.col("n")).otherwise(0)).alias("n_only_reason"))


def keep_passing(docs: DataFrame, version: str = CURRENT) -> DataFrame:
    """Documents that the policy keeps, with the columns they came with."""
    names = docs.columns
    whole = docs.withColumn("whole_", F.struct(*[F.col(f"`{n}`") for n in names]))
    # A filter on a numbered row stays above the measurements. Pushed below them, it would hold
    # every measurement written out again for each place that uses it.
    scored = ledger(whole, ("whole_",)).withColumn("row_", F.monotonically_increasing_id())
    passes = ~rejected(F.col("failure_bits"), POLICIES[version]) & (F.col("row_") >= 0)
    return scored.where(passes).select("whole_.*")
