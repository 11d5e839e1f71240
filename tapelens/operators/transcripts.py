"""Investigation transcripts: assembly, contract checks, summaries and what memory keeps.

A transcript holds at most a few dozen nested entries (eight steps, six components), so its
checks are array functions inside one row: no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapelens import constants as K
from tapelens.functions import scalar as S
from tapelens.operators import policies


def component_of(probe: Column) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in K.PROBE_COMPONENT.items() for x in kv])
    return pairs[probe]


def _total(items: Column, field: str, kind: str = "int") -> Column:
    zero = F.lit(0).cast(kind)
    return F.aggregate(items, zero, lambda acc, x: (acc + F.coalesce(
        x[field].cast(kind), zero)).cast(kind))


# -- plan -------------------------------------------------------------------------------------
def _by_priority(hypotheses: Column) -> Column:
    numbered = F.transform(hypotheses, lambda h, i: F.struct(
        h["priority"].alias("priority"), i.alias("position"), h["id"].alias("id"),
        h["probes"].alias("probes")))
    return F.array_sort(numbered)


def planned_queue(hypotheses: Column) -> Column:
    """Probes by priority, then position: unknown names and repeats are dropped."""
    names = F.flatten(F.transform(_by_priority(hypotheses), lambda h: h["probes"]))
    known = F.array(*[F.lit(p) for p in K.PROBES])
    return F.array_distinct(F.filter(names, lambda p: F.array_contains(known, p)))


def hypothesis_of(hypotheses: Column, probe: Column) -> Column:
    owners = F.filter(_by_priority(hypotheses), lambda h: F.array_contains(h["probes"], probe))
    return F.get(owners, F.lit(0))["id"]


# -- assembly ----------------------------------------------------------------------------------
def _nested(df: DataFrame, key: str, name: str, order: list[str]) -> DataFrame:
    """Child rows of a document as one array, sorted by `order`."""
    fields = [c for c in df.columns if c != key]
    sortable = F.struct(*order, F.struct(*fields).alias("entry"))
    listed = F.transform(F.array_sort(F.collect_list(sortable)), lambda s: s["entry"])
    return df.groupBy(key).agg(listed.alias(name))


def assemble(heads: DataFrame, hypotheses: DataFrame, steps: DataFrame, evidence: DataFrame,
             components: DataFrame, key: str = "doc_id") -> DataFrame:
    """One nested row per investigation.

    The total is the cost of the steps (a probe that gave up still cost its call) and the
    baseline is never below it.
    """
    out = heads
    for part in (_nested(hypotheses, key, "hypotheses", ["priority", "id"]),
                 _nested(steps, key, "steps", ["step"]),
                 _nested(evidence, key, "evidence", ["probe", "id"]),
                 _nested(components, key, "components", ["position"])):
        name = part.columns[-1]
        nothing = F.array().cast(part.schema[name].dataType)
        out = out.join(part, key, "left").withColumn(name, F.coalesce(name, nothing))
    return (
        out.withColumn("credits_total", _total(F.col("steps"), "credits_spent"))
        .withColumn("baseline_credits", F.greatest(F.lit(K.BASELINE_COST),
                                                   F.col("credits_total")))
        .withColumn("plan", F.struct("hypotheses", "credit_budget_requested", "rationale"))
        .drop("hypotheses", "credit_budget_requested", "rationale")
    )


# -- checks ----------------------------------------------------------------------------------------
def budget_adds_up() -> Column:
    """remaining(step) = remaining before - spent + granted, from the requested budget on."""
    state = "struct<left: int, ok: boolean>"
    start = F.struct(F.col("plan.credit_budget_requested").alias("left"),
                     F.lit(True).alias("ok")).cast(state)
    return F.aggregate("steps", start, lambda acc, s: F.struct(
        s["credits_remaining"].alias("left"),
        (acc["ok"] & (s["credits_remaining"]
                      == acc["left"] - s["credits_spent"] + s["budget_granted"])).alias("ok")
    ).cast(state), lambda acc: acc["ok"])


def budget_ledger(steps: DataFrame, requested: Column, key: str = "doc_id") -> DataFrame:
    """The same rule over step rows: expected and recorded remainder of every step."""
    order = W.partitionBy(key).orderBy("step")
    before = F.coalesce(F.lag("credits_remaining").over(order), requested)
    expected = before - F.col("credits_spent") + F.col("budget_granted")
    return steps.withColumn("expected_remaining", expected.cast("int")).withColumn(
        "adds_up", F.col("credits_remaining") == F.col("expected_remaining"))


def unknown_references(transcripts: DataFrame, key: str = "doc_id") -> DataFrame:
    """Component evidence ids that no evidence entry has."""
    known = F.transform("evidence", lambda e: e["id"])
    lost = F.transform("components", lambda c: F.struct(
        c["code"].alias("code"), F.array_except(c["evidence_ids"], known).alias("missing")))
    return transcripts.select(key, F.inline(lost)).select(
        key, "code", F.explode("missing").alias("evidence_id"))


def contract_rules() -> dict[str, Column]:
    """Rule name -> does the transcript keep it?"""
    steps, comps, evidence = F.col("steps"), F.col("components"), F.col("evidence")
    measured = F.filter(comps, lambda c: c["investigated"])
    ran = F.transform(steps, lambda s: component_of(s["probe"]))
    ids = F.transform(evidence, lambda e: e["id"])
    return {
        "band_matches_score": F.col("band") == S.band(F.col("score")),
        "confidence_is_measured_weight":
            F.abs(_total(measured, "weight", "double") - F.col("confidence")) <= 0.01,
        "weights_sum_to_one": F.abs(_total(comps, "weight", "double") - 1.0) <= 0.01,
        "evidence_refs_exist": F.forall(comps, lambda c: F.size(
            F.array_except(c["evidence_ids"], ids)) == 0),
        "measured_has_evidence": F.forall(
            measured, lambda c: F.size(c["evidence_ids"]) > 0),
        "unmeasured_has_no_score": F.forall(
            comps, lambda c: c["investigated"] | c["sub_score"].isNull()),
        "measured_was_run": F.size(F.array_except(
            F.transform(measured, lambda c: c["code"]), ran)) == 0,
        "costs_add_up": _total(steps, "credits_spent") == F.col("credits_total"),
        "evidence_cost_within_total":
            _total(evidence, "credits_spent") <= F.col("credits_total"),
        "budget_adds_up": budget_adds_up(),
        "within_baseline": F.col("credits_total") <= F.col("baseline_credits"),
        "at_most_8_steps": F.size(steps) <= 8,
        "at_most_25_credits": F.col("credits_total") <= 25,
        "no_repeated_probe": F.size(F.array_distinct(F.transform(
            steps, lambda s: s["probe"]))) == F.size(steps),
        "ends_with_conclude": (F.size(steps) == 0) | (
            F.try_element_at(steps, F.lit(-1))["next_action"] == "conclude"),
        "escalation_names_probe": F.forall(
            steps, lambda s: (s["next_action"] == "escalate") == s["new_probe"].isNotNull()),
        "grant_only_on_escalation": F.forall(
            steps, lambda s: (s["budget_granted"] == 0) | (s["next_action"] == "escalate")),
        "score_in_range": F.col("score").between(0, 100) & F.col("confidence").between(0, 1),
    }


def violations(transcripts: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per broken rule."""
    checks = F.array(*[F.struct(F.lit(name).alias("rule"), F.coalesce(ok, F.lit(False))
                                .alias("ok")) for name, ok in contract_rules().items()])
    return transcripts.select(key, F.inline(F.filter(checks, lambda c: ~c["ok"]))).select(
        key, "rule")


# -- summaries --------------------------------------------------------------------------------------
def moments() -> Column:
    """adaptive, escalation, early_stop, memory: read from what the steps did."""
    steps = F.col("steps")
    planned = F.flatten(F.transform("plan.hypotheses", lambda h: h["probes"]))
    last = F.try_element_at(steps, F.lit(-1))
    early = ((last["next_action"] == "conclude") & (F.size(steps) < 6)
             & (F.col("credits_total") < F.col("baseline_credits")))
    flags = F.array(
        F.when(F.exists(steps, lambda s: ~F.array_contains(planned, s["probe"])), "adaptive"),
        F.when(F.exists(steps, lambda s: s["next_action"] == "escalate"), "escalation"),
        F.when(early, "early_stop"), F.when(F.col("memory_ref").isNotNull(), "memory"))
    return F.filter(flags, lambda f: f.isNotNull())


def headline(narrative: Column) -> Column:
    """The first sentence, at most 118 characters."""
    first = F.regexp_replace(F.trim(F.substring_index(narrative, ". ", 1)), r"\.+$", "")
    return F.when(F.length(first) > 118, F.concat(F.left(first, F.lit(117)), F.lit("…"))
                  ).otherwise(first)


def provenance(transcripts: DataFrame) -> DataFrame:
    """Who decided: the model, or the rules that stand in for it."""
    by_rule = F.filter("steps", lambda s: s["reason"].startswith(K.FALLBACK_DECISION_PREFIX))
    return transcripts.withColumns({
        "planner_model": ~F.col("plan.rationale").startswith(K.FALLBACK_PLAN_PREFIX),
        "fallback_decisions": F.size(by_rule),
        "model_decisions": F.size("steps") - F.size(by_rule),
        "narrative_model": F.col("narrative_source") == "llm",
    })


def summarise(transcripts: DataFrame, key: str = "doc_id") -> DataFrame:
    return provenance(transcripts).select(
        key, S.memory_ref(F.col("symbol"), F.col("as_of")).alias("id"), "symbol", "as_of",
        "score", "band", "confidence", F.size("steps").alias("steps"), "credits_total",
        "baseline_credits",
        policies.saving_pct(F.col("credits_total"), F.col("baseline_credits"))
        .alias("saving_pct"), "memory_ref", "narrative_source", moments().alias("moments"),
        F.size(F.filter("components", lambda c: c["investigated"])).alias("components_measured"),
        F.size("components").alias("components_total"), "planner_model", "model_decisions",
        "fallback_decisions", "narrative_model", headline(F.col("narrative")).alias("headline"))


# -- memory ------------------------------------------------------------------------------------------
def memory_components(transcripts: DataFrame, today: Column, key: str = "doc_id") -> DataFrame:
    """Per component: sub-score, date of its oldest evidence, its age and "still fresh"."""
    def oldest(c: Column) -> Column:
        cited = F.filter("evidence", lambda e: F.array_contains(c["evidence_ids"], e["id"]))
        return F.array_min(F.transform(cited, lambda e: F.to_date(e["as_of"])))

    rows = F.transform("components", lambda c: F.struct(
        c["code"].alias("code"), c["sub_score"].alias("sub_score"), oldest(c).alias("oldest")))
    limits = F.create_map(*[F.lit(x) for kv in K.SLOW_COMPONENT_DAYS.items() for x in kv])
    out = transcripts.select(key, today.alias("today"), F.inline(rows))
    age = F.datediff("today", "oldest")
    return out.select(key, "code", "sub_score", "oldest", age.alias("age_days"), F.coalesce(
        F.col("sub_score").isNotNull() & (age <= limits[F.col("code")]), F.lit(False))
        .alias("fresh"))


def never_measured(transcripts: DataFrame, key: str = "doc_id") -> DataFrame:
    seen = F.transform(F.filter("components", lambda c: c["sub_score"].isNotNull()),
                       lambda c: c["code"])
    return transcripts.select(key, F.array_except(
        F.array(*[F.lit(c) for c in K.COMPONENTS]), seen).alias("never_measured"))


def running_composite(steps: DataFrame, key: str = "doc_id") -> DataFrame:
    """Score, band, confidence and open components after every step of an investigation.

    `steps` has step, probe and sub_score (null where the probe gave up). Eight steps at most
    share a window partition.
    """
    upto = W.partitionBy(key).orderBy("step").rowsBetween(W.unboundedPreceding, W.currentRow)
    weights = F.create_map(*[F.lit(x) for p, c in K.PROBE_COMPONENT.items()
                             for x in (p, K.WEIGHTS[c])])
    measured = F.col("sub_score").isNotNull()
    w = F.when(measured, weights[F.col("probe")])
    done = F.collect_list(F.when(measured, component_of(F.col("probe")))).over(upto)
    by_weight = sorted(K.COMPONENTS, key=lambda c: -K.WEIGHTS[c])
    out = (
        steps.withColumn("_top", F.coalesce(F.sum(w * F.col("sub_score")).over(upto), F.lit(0.0)))
        .withColumn("_covered", F.coalesce(F.sum(w).over(upto), F.lit(0.0)))
        .withColumn("score", F.when(F.col("_covered") > 0, F.rint(S.half_even(
            F.col("_top") / F.col("_covered"), 9))).otherwise(0).cast("int"))
        .withColumn("band", S.band(F.col("score")))
        .withColumn("confidence", S.half_even(F.col("_covered"), 2))
        .withColumn("open", F.array_except(F.array(*[F.lit(c) for c in by_weight]), done))
    )
    return out.drop("_top", "_covered")
