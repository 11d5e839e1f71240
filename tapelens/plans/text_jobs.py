"""Registered jobs: text checks, transcripts, scalar functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapelens import constants as K
from tapelens.functions import scalar as S
from tapelens.operators import boards, probes, scoring, textqa, transcripts
from tapelens.plans import check_sql as C
from tapelens.plans.probe_jobs import monthly_grid
from tapelens.plans.registry import query
from tapelens.session import scratch_dir
from tapelens.sources import documents

# The other engine has no lookaround: every separator is doubled, so that one copy can end a
# token and the other can begin the next.
_DOUBLED = r"regexp_replace({text}, '([^\p{{L}}\p{{N}}_,.])', '\1\1', 'g')"
_TOKEN = (r"(?:^|[^\p{L}\p{N}_,.])(\d{1,3}(?:\.\d{3})+(?:,\d+)?|\d+(?:,\d+)?)"
          r"(?:(?:\s\s)?(%|persen|σ|sigma|×|x|M|T|Jt|jt|juta|miliar|triliun|rb|ribu)"
          r"(?:[^\p{L}\p{N}_]|$))?")


def tokens_cte(source: str, text: str, keep: str) -> str:
    doubled = _DOUBLED.format(text=text)
    unit = "case lower(u) " + " ".join(
        f"when '{k}' then '{v}'" for k, v in K.UNIT_NAMES.items()) + " else '' end"
    return f"""
        select {keep}, round(cast(replace(replace(n, '.', ''), ',', '.') as double), 6)
                 as magnitude, {unit} as unit
        from (select {keep}, unnest(regexp_extract_all({doubled}, '{_TOKEN}', 1)) as n,
                     unnest(regexp_extract_all({doubled}, '{_TOKEN}', 2)) as u
              from {source}) x"""


C.CTES.update({
    "statement_tokens": tokens_cte("statements", "narrative", "doc_id"),
    "shown_1": tokens_cte("statements", "display_1", "doc_id"),
    "shown_2": tokens_cte("statements", "display_2", "doc_id"),
    "label_keys": tokens_cte("statements", "label_2", "doc_id"),
    "allowed": """
        select distinct doc_id, magnitude, unit from (
          select doc_id, magnitude, unit from shown_1 union all
          select doc_id, magnitude, unit from shown_2 union all
          select doc_id, magnitude, unit from label_keys union all
          select s.doc_id, abs(s.value_2), '' from statements s union all
          select s.doc_id, abs(s.value_2), k.unit from statements s
          join shown_2 k on k.doc_id = s.doc_id) a""",
})


def statement_evidence() -> F.Column:
    none = F.lit(None).cast("string")
    return F.array(
        F.struct(F.col("display_1").alias("display"), none.alias("label"), none.alias("value")),
        F.struct(F.col("display_2").alias("display"), F.col("label_2").alias("label"),
                 F.col("value_2").cast("string").alias("value")))


@query("t1_number_tokens", """
    select doc_id, magnitude, unit, count(*) as n from statement_tokens group by 1, 2, 3""")
def tokens(t):
    found = textqa.number_rows(t["statements"], ["doc_id"], "narrative")
    return found.groupBy("doc_id", "magnitude", "unit").agg(F.count("*").alias("n"))


@query("t2_allowed_numbers", "select doc_id, magnitude, unit from allowed")
def allowed(t):
    entries = t["statements"].select("doc_id", F.inline(statement_evidence()))
    return textqa.allowed_rows(entries, ["doc_id"])


@query("t3_unsupported_numbers", """
    select t.doc_id, count(distinct (t.magnitude, t.unit)) as n
    from statement_tokens t left join allowed a
      on a.doc_id = t.doc_id and a.magnitude = t.magnitude and a.unit = t.unit
    where a.doc_id is null group by 1""")
def unsupported(t):
    found = textqa.number_rows(t["statements"], ["doc_id"], "narrative")
    return textqa.unsupported_rows(found, allowed(t), ["doc_id"]).groupBy("doc_id").agg(F.count("*").alias("n"))


# The same checks over whole texts: statements, documents and every turn of the conversations.
TEXT_KEY = ["source", "doc_id", "turn"]
C.CTES["text_tokens"] = tokens_cte("whole_texts", "text", ", ".join(TEXT_KEY))


def text_tokens(t) -> DataFrame:
    """One row per key and text, with the number of times it stands there."""
    found = textqa.number_rows(t["whole_texts"], TEXT_KEY, "text")
    return found.groupBy(*TEXT_KEY, "magnitude", "unit").agg(F.count("*").alias("n"))


@query("t1_number_tokens_corpus", """
    select source, doc_id, turn, magnitude, unit, count(*) as n from text_tokens
    group by 1, 2, 3, 4, 5""")
def corpus_tokens(t):
    return text_tokens(t)


@query("t3_unsupported_numbers_corpus", """
    select t.source, t.doc_id, t.turn, count(distinct (t.magnitude, t.unit)) as n
    from text_tokens t left join allowed a on t.source = 'statement'
      and a.doc_id = t.doc_id and a.magnitude = t.magnitude and a.unit = t.unit
    where a.doc_id is null group by 1, 2, 3""")
def corpus_unsupported(t):
    """Only statements have evidence; every number of the other texts is without a source."""
    known = allowed(t).withColumn("source", F.lit("statement"))
    strange = text_tokens(t).join(known, ["source", "doc_id", "magnitude", "unit"], "left_anti")
    return strange.groupBy(*TEXT_KEY).agg(F.count("*").alias("n"))


@query("t14_emdash_normalise_corpus", r"""
    select source, doc_id, turn, regexp_replace(text, '\s*—\s*', ', ', 'g') as text
    from whole_texts""")
def corpus_dashes(t):
    return t["whole_texts"].select(*TEXT_KEY, textqa.no_em_dash(F.col("text")).alias("text"))


C.CTES["tickers"] = r"""
    select distinct doc_id, w as ticker from (
      select doc_id, symbol, unnest(string_split_regex(text, '[^\p{L}\p{N}_]+')) as w
      from (select doc_id, symbol, narrative as text from statements
            union all select doc_id, '', text from documents) s) x
    where regexp_full_match(w, '[A-Z]{4}') and w <> symbol
      and w not in ('RUPS', 'IUPK', 'LQ45')"""


@query("t4_unsupported_tickers", "select doc_id, ticker from tickers")
def tickers(t):
    texts = t["statements"].select("doc_id", "symbol", F.col("narrative").alias("text")
                                   ).unionByName(t["documents"].select(
                                       "doc_id", F.lit("").alias("symbol"), "text"))
    return texts.select("doc_id", F.explode(textqa.unsupported_tickers(
        F.col("text"), F.col("symbol"))).alias("ticker")).distinct()


def quoted(text: str) -> str:
    return text.replace("'", "''")


_CLEAN = f"replace(text, '{K.SERVICE}{K.DISCLAIMER_TEXT}', ' ')"
C.CTES["wording"] = " union all ".join(
    f"select doc_id, '{quoted(why)}' as reason, len(regexp_extract_all({_CLEAN}, '(?i){p}')) as hits "
    f"from corpus" for p, why in K.FORBIDDEN_PHRASES) + rf"""
    union all
    select doc_id, 'bare word ' || lower(w), count(*) from (
      select doc_id, unnest(regexp_extract_all(c, '(?is)(?:.{{0,24}})\b(beli|jual)\b', 1)) as w,
             unnest(regexp_extract_all(c, '(?is)(.{{0,24}})\b(?:beli|jual)\b', 1)) as before,
             unnest(regexp_extract_all(c, '(?is)\b(?:beli|jual)\b(.{{0,24}})', 1)) as after
      from (select doc_id, {_CLEAN} as c from corpus) k) x
    where lower(regexp_extract(before, '([\p{{L}}\p{{N}}_-]+)[^\p{{L}}\p{{N}}_-]*$', 1))
            not in ({', '.join(repr(w) for w in K.WORDS_BEFORE)})
      and lower(regexp_extract(after, '([\p{{L}}\p{{N}}_-]+)', 1))
            not in ({', '.join(repr(w) for w in K.WORDS_AFTER)})
    group by 1, 2"""


@query("t5_vocab_scan", """
    select doc_id, reason, sum(hits) as hits from wording where hits > 0 group by 1, 2""")
def vocabulary(t):
    return textqa.vocabulary_scan(t["corpus"]).groupBy("doc_id", "reason").agg(
        F.count("*").alias("hits"))


@query("t6_json_string_leaves", """
    select doc_id, '$.symbol' as path, symbol as text from statements
    union all select doc_id, '$.shown[0]', display_1 from statements
    union all select doc_id, '$.shown[1].text', display_2 from statements
    union all select doc_id, '$.body.narrative', narrative from statements""")
def leaves(t):
    document = F.to_json(F.struct(
        "symbol", F.col("value_2"), F.struct("narrative").alias("body")))
    pair = F.concat(F.lit('"shown":["'), F.col("display_1"), F.lit('",{"text":"'),
                    F.col("display_2"), F.lit('"}]}'))
    joined = F.concat(F.expr("substring(d, 1, length(d) - 1)"), F.lit(","), pair)
    docs = t["statements"].select("doc_id", document.alias("d"), "display_1", "display_2")
    found = textqa.json_string_leaves(docs.select("doc_id", joined.alias("document")))
    return found.where("problem is null").drop("problem")


@query("t7_secret_redaction", r"""
    select doc_id, regexp_replace(regexp_replace(text,
        '(?i)(authorization\s*[:=]\s*(?:bearer\s+)?)[\p{L}\p{N}_.\-]{8,}',
        '\1***REDACTED***', 'g'),
        '(?i)((?:api[_-]?key|x-api-key|token)\s*["'']?\s*[:=]\s*["'']?)[\p{L}\p{N}_.\-]{8,}',
        '\1***REDACTED***', 'g') as text
    from documents""")
def redacted(t):
    return t["documents"].select("doc_id", textqa.redact(F.col("text")).alias("text"))


@query("t14_emdash_normalise", r"""
    select doc_id, regexp_replace(narrative, '\s*—\s*', ', ', 'g') as narrative from statements""")
def dashes(t):
    return t["statements"].select("doc_id", textqa.no_em_dash(F.col("narrative"))
                                  .alias("narrative"))


@query("t16_error_text_scrub", r"""
    select page_id, left(s, 150) || case when length(s) > 150 then '…' else '' end as message
    from (select page_id, replace(trim(regexp_replace(regexp_replace(
            'open /home/user/x.py | ' || url || ' failed   on ' || url,
            '/(?:home|Users)/[^\s'')"]+', '<jalur lokal>', 'g'), '\s+', ' ', 'g')),
            '|', '\|') as s from pages) x""")
def errors(t):
    text = F.concat(F.lit("open /home/user/x.py | "), F.col("url"), F.lit(" failed   on "),
                    F.col("url"))
    return t["pages"].select("page_id", textqa.tidy_error(text).alias("message"))


@query("t9_narrative_source", """
    select s.doc_id, case when s.doc_id in (
             select t.doc_id from statement_tokens t left join allowed a
               on a.doc_id = t.doc_id and a.magnitude = t.magnitude and a.unit = t.unit
             where a.doc_id is null)
          or s.doc_id in (select doc_id from tickers where doc_id in (
               select o_orderkey from orders) and length(ticker) = 4
               and contains((select narrative from statements n
                             where n.doc_id = tickers.doc_id), ticker))
          or -1 - s.doc_id in (select doc_id from wording where hits > 0)
        then 'template' else 'llm' end as source
    from statements s""")
def sources(t):
    """The same four checks as `textqa.narrative_source`, as relations over the whole corpus."""
    rows = t["statements"]
    checks = [
        rows.where(F.trim(F.coalesce("narrative", F.lit(""))) == ""),
        textqa.unsupported_rows(textqa.number_rows(rows, ["doc_id"], "narrative"), allowed(t), ["doc_id"]),
        rows.where(F.size(textqa.unsupported_tickers(F.col("narrative"), F.col("symbol"))) > 0),
        textqa.vocabulary_scan(rows.select("doc_id", F.col("narrative").alias("text")))]
    failed = reduce(lambda a, b: a.unionAll(b), [c.select("doc_id") for c in checks]).groupBy("doc_id").agg(
        F.lit("template").alias("failed"))
    return rows.join(failed, "doc_id", "left").select("doc_id", F.coalesce("failed", F.lit("llm")).alias("source"))


@query("t8_template_narrative")
def template(t):
    """Narrative of every month-end evidence book."""
    scored = probes.evidence_array(probes.run_all(t, monthly_grid(t)))
    table = scoring.composite(scored, columns={
        c: F.col(f"{c}.sub_score") for c in K.COMPONENTS})
    steps = F.transform(F.array_distinct(F.transform("evidence", lambda e: e["probe"])),
                        lambda p: F.struct(p.alias("probe")))
    return table.select("symbol", "as_of", textqa.template_narrative(
        F.col("symbol"), F.col("band"), F.col("evidence"), steps).alias("narrative"))


# -- transcripts -------------------------------------------------------------------------------
def built(t) -> DataFrame:
    """Transcripts assembled from step rows: eight steps at most make one document."""
    steps, heads = t["transcript_steps"], t["transcript_heads"]
    code = transcripts.component_of(F.col("probe"))
    step_rows = steps.select(
        "doc_id", "step", F.lit("h1").alias("hypothesis"), "probe", "finding", "next_action",
        "new_probe", F.col("granted").alias("budget_granted"), "reason",
        F.col("spent").alias("credits_spent"), "credits_remaining")
    evidence = steps.where("sub_score is not null").select(
        "doc_id", F.concat(F.lower(code), F.lit(".n"), F.col("step").cast("string")).alias("id"),
        F.lit("Nilai").alias("label"), F.col("sub_score").cast("string").alias("value"),
        F.col("sub_score").cast("string").alias("display"), "probe",
        F.lit("fetch-filings").alias("source_endpoint"),
        S.market_close_stamp(F.date_sub("as_of", F.col("step"))).alias("as_of"),
        F.col("spent").alias("credits_spent"))
    measured = steps.where("sub_score is not null").groupBy("doc_id", code.alias("code")).agg(
        F.max("sub_score").alias("sub_score"),
        F.array_sort(F.collect_list(F.concat(
            F.lower(code), F.lit(".n"), F.col("step").cast("string")))).alias("evidence_ids"))
    weights = F.create_map(*[F.lit(x) for kv in K.WEIGHTS.items() for x in kv])
    all_codes = heads.select("doc_id", F.posexplode(F.array(
        *[F.lit(c) for c in K.COMPONENTS])).alias("position", "code"))
    components = all_codes.join(measured, ["doc_id", "code"], "left").select(
        "doc_id", "position", "code", "sub_score", weights[F.col("code")].alias("weight"),
        F.coalesce("evidence_ids", F.array().cast("array<string>")).alias("evidence_ids"),
        F.col("sub_score").isNotNull().alias("investigated"))
    hypotheses = steps.where("step <= 2").groupBy("doc_id", "step").agg(
        F.array(F.max("probe"), F.lit("unknown")).alias("probes")).select(
        "doc_id", F.concat(F.lit("h"), F.col("step").cast("string")).alias("id"),
        F.lit("claim").alias("claim"), "probes", (3 - F.col("step")).alias("priority"))
    head_rows = heads.select(
        "doc_id", "symbol", "as_of", F.lit(12).alias("credit_budget_requested"), "rationale",
        "score", "band", "confidence", "narrative", "narrative_source", "memory_ref")
    return transcripts.assemble(head_rows, hypotheses, step_rows, evidence, components)


C.CTES.update({
    "step_codes": "select *, case probe " + " ".join(
        f"when '{p}' then '{c}'" for p, c in K.PROBE_COMPONENT.items())
        + " end as code, case probe " + " ".join(
        f"when '{p}' then {K.WEIGHTS[c]}" for p, c in K.PROBE_COMPONENT.items())
        + " end as weight from transcript_steps",
    "doc_weights": """
        select doc_id, sum(weight) as w, count(*) as n from (
          select distinct doc_id, code, weight from step_codes where sub_score is not null) x
        group by 1""",
})


@query("t18_assemble_transcript", """
    select h.doc_id, h.symbol, h.as_of, h.n_steps, s.total as credits_total,
           greatest(16, s.total) as baseline_credits, coalesce(s.evidence, 0) as n_evidence,
           coalesce(w.n, 0) as n_measured
    from transcript_heads h
    join (select doc_id, sum(spent) as total, count(sub_score) as evidence
          from transcript_steps group by 1) s on s.doc_id = h.doc_id
    left join doc_weights w on w.doc_id = h.doc_id""")
def assembled(t):
    return built(t).select(
        "doc_id", "symbol", "as_of", F.size("steps").alias("n_steps"), "credits_total",
        "baseline_credits", F.size("evidence").alias("n_evidence"),
        F.size(F.filter("components", lambda c: c["investigated"])).alias("n_measured"))


@query("a21_transcript_scan", """
    select doc_id, symbol, as_of, n_steps, null as problem from transcript_heads""")
def transcript_scan(t):
    """Written as one JSON document per file folder and read back with its checks."""
    path = scratch_dir(t.spark)
    docs = built(t)
    docs.select(F.to_json(F.struct(*docs.columns)).alias("value")).write.text(path)
    back = documents.read_transcripts(t.spark, path, multi_line=False, extra="doc_id long")
    return back.select("doc_id", "symbol", "as_of", F.size("steps").alias("n_steps"), "problem")


@query("t10_transcript_checks", f"""
    select doc_id, rule from (
      select h.doc_id, unnest(['band_matches_score', 'confidence_is_measured_weight',
               'budget_adds_up', 'no_repeated_probe', 'ends_with_conclude',
               'at_most_25_credits', 'at_most_8_steps', 'escalation_names_probe',
               'score_in_range']) as rule,
             unnest([h.band = {C.band('h.score')},
                     abs(coalesce(w.w, 0) - h.confidence) <= 0.01, b.ok, s.probes = s.n,
                     s.last_action = 'conclude', s.total <= 25, s.n <= 8, true,
                     h.confidence between 0 and 1]) as ok
      from transcript_heads h left join doc_weights w on w.doc_id = h.doc_id
      join (select doc_id, count(distinct probe) as probes, count(*) as n, sum(spent) as total,
                   arg_max(next_action, step) as last_action
            from transcript_steps group by 1) s on s.doc_id = h.doc_id
      join (select doc_id, bool_and(ok) as ok from (
              select doc_id, credits_remaining = coalesce(lag(credits_remaining) over (
                       partition by doc_id order by step), 12) - spent + granted as ok
              from transcript_steps) x group by 1) b on b.doc_id = h.doc_id) y
    where not ok""")
def contract(t):
    return transcripts.violations(built(t))


@query("w9_budget_ledger_check", """
    select doc_id, step, credits_remaining = coalesce(lag(credits_remaining) over (
             partition by doc_id order by step), 12) - spent + granted as adds_up
    from transcript_steps""")
def budget_ledger(t):
    steps = t["transcript_steps"].select(
        "doc_id", "step", F.col("spent").alias("credits_spent"),
        F.col("granted").alias("budget_granted"), "credits_remaining")
    return transcripts.budget_ledger(steps, F.lit(12)).select("doc_id", "step", "adds_up")


@query("c11_evidence_ref_integrity", """
    select doc_id, code, lower(code) || '.n' || step as evidence_id from step_codes
    where sub_score is not null and step > 4""")
def references(t):
    """Evidence of later steps is dropped, so their references must be reported."""
    docs = built(t).withColumn("evidence", F.filter("evidence", lambda e: F.regexp_extract(
        e["id"], r"(\d+)$", 1).cast("int") <= 4))
    return transcripts.unknown_references(docs)


C.CTES["moments"] = """
    select h.doc_id, concat_ws(',', case when s.adaptive then 'adaptive' end,
             case when s.escalated then 'escalation' end,
             case when s.last_action = 'conclude' and s.n < 6 and s.total < 16
                  then 'early_stop' end,
             case when h.memory_ref is not null then 'memory' end) as moments
    from transcript_heads h join (
      select a.doc_id, bool_or(a.probe not in (select b.probe from transcript_steps b
                         where b.doc_id = a.doc_id and b.step <= 2)) as adaptive,
             bool_or(next_action = 'escalate') as escalated, count(*) as n, sum(spent) as total,
             arg_max(next_action, step) as last_action
      from transcript_steps a group by 1) s on s.doc_id = h.doc_id"""


@query("t11_transcript_summary", f"""
    select h.doc_id, h.symbol || '-' || h.as_of as id, h.symbol, h.as_of, h.score, h.band, h.confidence,
           h.n_steps as steps, s.total as credits_total, greatest(16, s.total) as baseline_credits,
           cast(round_even((1 - s.total / greatest(16, s.total)) * 100, 0) as int) as saving_pct,
           coalesce(w.n, 0) as components_measured, m.moments, s.by_rule as fallback_decisions,
           h.n_steps - s.by_rule as model_decisions,
           not starts_with(h.rationale, '{K.FALLBACK_PLAN_PREFIX}') as planner_model,
           h.narrative_source = 'llm' as narrative_model,
           case when length(first) > 118 then left(first, 117) || '…' else first end as headline
    from (select *, regexp_replace(trim(split_part(narrative, '. ', 1)), '\\.+$', '') as first
          from transcript_heads) h
    join (select doc_id, sum(spent) as total, count(case when starts_with(reason, '{K.FALLBACK_DECISION_PREFIX}')
                 then 1 end) as by_rule from transcript_steps group by 1) s
      on s.doc_id = h.doc_id
    join moments m on m.doc_id = h.doc_id
    left join doc_weights w on w.doc_id = h.doc_id""")
def summaries(t):
    return transcripts.summarise(built(t)).select(
        "doc_id", "id", "symbol", "as_of", "score", "band", "confidence", "steps", "credits_total",
        "baseline_credits", "saving_pct", "components_measured", F.array_join("moments", ",").alias("moments"),
        "fallback_decisions", "model_decisions", "planner_model", "narrative_model", "headline")


@query("t12_moment_flags", "select doc_id, moments from moments")
def moment_flags(t):
    return built(t).select("doc_id", F.array_join(transcripts.moments(), ",").alias("moments"))


@query("t17_planned_queue", """
    select doc_id, string_agg(probe, ',' order by step desc) as queue
    from transcript_steps where step <= 2 group by 1""")
def queue(t):
    return built(t).select("doc_id", F.array_join(transcripts.planned_queue(
        F.col("plan.hypotheses")), ",").alias("queue"))


@query("d20_provenance_rollup", """
    select count(*) as investigations, count(case when doc_id % 3 > 0 then 1 end)
             as planner_model, count(case when narrative_source = 'llm' then 1 end)
             as narrative_model,
           (select count(*) from transcript_steps where not starts_with(reason,
              'Keputusan cadangan')) as model_decisions,
           (select count(*) from transcript_steps where starts_with(reason,
              'Keputusan cadangan')) as fallback_decisions,
           (select count(*) from transcript_steps) as steps
    from transcript_heads""")
def provenance(t):
    return boards.provenance_total(transcripts.provenance(built(t)))


@query("p21_memory_components", """
    select h.doc_id, c.code, m.sub_score, m.oldest, date_diff('day', m.oldest, h.as_of)
             as age_days,
           coalesce((c.code = 'FFS' and date_diff('day', m.oldest, h.as_of) <= 15)
             or (c.code = 'SSS' and date_diff('day', m.oldest, h.as_of) <= 7), false) as fresh
    from transcript_heads h
    cross join (select unnest(['BCI', 'VAS', 'PFD', 'FFS', 'FRD', 'SSS']) as code) c
    left join (select doc_id, code, max(sub_score) as sub_score, max(as_of) - max(step) as oldest
               from step_codes where sub_score is not null group by 1, 2) m
      on m.doc_id = h.doc_id and m.code = c.code""")
def memory(t):
    docs = built(t)
    return transcripts.memory_components(docs, F.col("as_of"))


@query("p26_running_composite", f"""
    select doc_id, step, score, {C.band('score')} as band, confidence from (
      select doc_id, step, cast(case when w > 0 then round_even(round_even(top / w, 9), 0)
                                else 0 end as int) as score,
             round_even(w, 2) as confidence
      from (select doc_id, step, coalesce(sum(case when sub_score is not null
                     then cast(weight as double) * sub_score end) over k, 0) as top,
                   coalesce(sum(case when sub_score is not null then cast(weight as double) end)
                            over k, 0) as w
            from step_codes window k as (partition by doc_id order by step)) x) y""")
def running(t):
    steps = t["transcript_steps"].select("doc_id", "step", "probe", "sub_score")
    return transcripts.running_composite(steps).select(
        "doc_id", "step", "score", "band", "confidence")


# -- scalar functions ------------------------------------------------------------------------------
@query("h1_ramp", f"""
    select l_orderkey, l_linenumber, l_partkey, round({C.ramp('l_quantity', 10.0, 40.0)}, 6)
             as score, round(greatest(0, least(1, l_discount / cast(0.08 as double))), 6) as share
    from lineitem""")
def ramps(t):
    return t["lineitem"].select(
        "l_orderkey", "l_linenumber", "l_partkey",
        F.round(S.ramp(F.col("l_quantity"), 10.0, 40.0), 6).alias("score"),
        F.round(S.norm01(F.col("l_discount"), 0.08), 6).alias("share"))


@query("h2_norm01", """
    select event_id, round(greatest(0, least(1, value / cast(200 as double))), 6) as share
    from events""")
def norms(t):
    return t["events"].select("event_id", F.round(S.norm01(F.col("value"), 200.0), 6)
                              .alias("share"))


_AMOUNT = """case o_orderkey % 5 when 0 then -o_totalprice when 1 then o_totalprice / 1000
             when 2 then o_totalprice * 1e3 when 3 then o_totalprice * 1e7 else o_totalprice end"""


@query("h3_money_text", f"""
    select o_orderkey, case when v < 0 then '-' else '' end || 'Rp ' || case
             when a >= 1e12 then replace(format('{{:.1f}}', a / 1e12), '.', ',') || ' T'
             when a >= 1e9 then replace(format('{{:.1f}}', a / 1e9), '.', ',') || ' M'
             when a >= 1e6 then replace(format('{{:.1f}}', a / 1e6), '.', ',') || ' jt'
             when a >= 1e3 then replace(format('{{:.1f}}', a / 1e3), '.', ',') || ' rb'
             else format('{{:.0f}}', a) end as money,
           case when share >= 0 then '+' else '' end
             || replace(format('{{:.1f}}', round_even(share * 100, 1)), '.', ',') || '%' as percent,
           replace(format('{{:.1f}}', round_even(share * 10, 1)), '.', ',') || 'σ' as sigma
    from (select *, abs(v) as a from (
      select o_orderkey, {_AMOUNT} as v, (o_custkey % 200 - 100) / cast(400 as double) as share
      from orders) y) x""")
def money(t):
    share = (F.col("o_custkey") % 200 - 100) / F.lit(400.0)
    return t["orders"].select(
        "o_orderkey", S.money(F.expr(_AMOUNT)).alias("money"),
        S.signed_percent(share, 1).alias("percent"), S.sigma(share * 10).alias("sigma"))


_MONTHS = ", ".join(repr(m) for m in K.MONTH_NAMES)
_DAYS = ", ".join(repr(d) for d in K.WEEKDAY_NAMES)


@query("h4_date_text", f"""
    select o_orderkey, [{_DAYS}][dayofweek(d) + 1] as weekday, dayofweek(d) in (0, 6) as weekend,
           day(d) || ' ' || [{_MONTHS}][month(d)] || ' ' || year(d) as shown,
           case when unread then '' else lpad(cast(local_ // 60 as varchar), 2, '0') || ':'
             || lpad(cast(local_ % 60 as varchar), 2, '0') || ' WIB' end as clock,
           case when unread then 'kapan' else d || ' ' || hh || ':' || mm || ' WIB' end as as_of
    from (select *, o_orderkey % 11 = 0 as unread, lpad(cast(o_orderkey % 24 as varchar), 2, '0') as hh,
                 lpad(cast(o_orderkey % 60 as varchar), 2, '0') as mm,
                 (o_orderkey % 24 * 60 + o_orderkey % 60 + (7 - o_custkey % 10) * 60 + 1440) % 1440 as local_
          from (select o_orderkey, o_custkey, cast(o_orderdate as date) as d from orders) y) x""")
def dates(t):
    d = F.to_date("o_orderdate")
    stamp = F.when(F.col("o_orderkey") % 11 == 0, "kapan").otherwise(F.format_string(
        "%sT%02d:%02d:00+%02d:00", d.cast("string"), F.col("o_orderkey") % 24, F.col("o_orderkey") % 60,
        F.col("o_custkey") % 10))
    return t["orders"].select(
        "o_orderkey", S.weekday_name(d).alias("weekday"), S.is_weekend(d).alias("weekend"),
        S.short_date(d).alias("shown"), S.local_clock(stamp).alias("clock"), S.as_of_text(stamp).alias("as_of"))


@query("h5_savings_label", """
    select id, case when p > 0 then 'hemat ' || p || '%' when p < 0 then -p || '% lebih boros'
             else 'setara baseline' end as label
    from (select id, credits_total - 8 as p from investigations) x""")
def labels_(t):
    return t["investigations"].select(
        "id", S.savings_label(F.col("credits_total") - 8).alias("label"))


@query("h6_keyword_any", f"""
    select symbol, start_date, {C.any_word("coalesce(reason, '')", K.UNUSUAL_REASONS)} as unusual,
           regexp_matches(coalesce(reason, ''), '(?i)(^|[^a-z])({'|'.join(K.UNUSUAL_REASONS)})([^a-z]|$)')
             as unusual_words
    from suspensions""")
def keyword(t):
    return t["suspensions"].select(
        "symbol", "start_date", S.keyword_any(F.col("reason"), K.UNUSUAL_REASONS)
        .alias("unusual"), S.word_any(F.col("reason"), K.UNUSUAL_REASONS)
        .alias("unusual_words"))


@query("h7_rounding", """
    select event_id, round_even(value, 1) as one, round_even(value, 0) as whole from events""")
def rounding(t):
    return t["events"].select("event_id", S.half_even(F.col("value"), 1).alias("one"),
                              S.half_even(F.col("value")).alias("whole"))


@query("h9_memory_ref_id", """
    select id, symbol || '-' || as_of as ref from investigations""")
def refs(t):
    return t["investigations"].select("id", S.memory_ref(F.col("symbol"), F.col("as_of"))
                                      .alias("ref"))
