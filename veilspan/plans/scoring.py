"""Detector scoring, statistics, selection, ordering and limits."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilspan.functions import patterns as P
from veilspan.functions import spans as S
from veilspan.functions.stats import newcombe, wilson
from veilspan.operators import cost, evalrows, facts, score, sweep
from veilspan.operators.catalog import last_writes
from veilspan.operators.detect import identifier_spans
from veilspan.operators.dictionary import apart
from veilspan.plans import world as V
from veilspan.plans.base import query
from veilspan.plans.detect import LETTERS, sql_resolved
from veilspan.plans.leaks import wilson_sql
from veilspan.plans.redaction import FACT_HITS

# three stand-in detectors over all labelled documents, one of which sometimes gives no verdict
FLAG = """case '{0}' when 'long' then n_chars > 2000 when 'marked' then text like '%@%' or text like '%###%' else case when doc_id % 11 = 0 then null else quality = 0 end end"""
LABELLED = " union all ".join(
    f"select '{d}' as detector, source as eval_set, lang, doc_id, case when toxic = 1 then 'leak' else 'clean' end as label, {FLAG.format(d)} as flag, "
    f"case when doc_id % 3 = 0 then lang when doc_id % 3 = 1 then source else '' end as trick from {{documents}} join {{labels}} using (doc_id)"
    for d in ("long", "marked", "judged")
)
LABELLED_SQL = LABELLED.replace("{documents}", "documents").replace("{labels}", "labels")
COUNTS = """count(*) filter (label = 'leak' and flag) as caught, count(*) filter (label = 'leak') as leaks, count(*) filter (label = 'clean' and flag) as false_alarms,
    count(*) filter (label = 'clean') as clean, count(*) as n, count(*) filter (flag is null) as errors"""
RESULTS_SQL = f"""(select detector, coalesce(eval_set, 'independent') as eval_set, {COUNTS} from ({LABELLED_SQL}) l group by grouping sets ((detector, eval_set), (detector)))"""


def labelled(t):
    return t.sql(LABELLED, documents=t.documents, labels=t.labels)


def results(t):
    return score.pooled(labelled(t))


@query("f03_confusion_with_errors", f"select detector, eval_set, {COUNTS} from ({LABELLED_SQL}) l group by detector, eval_set")
def f03(t):
    return score.confusion(labelled(t))


@query("f04_pooled_sets", f"select * from {RESULTS_SQL} r")
def f04(t):
    return results(t)


@query("f06_outcome_tricks", f"""select detector, eval_set, case when label = 'leak' then 'missed' else 'false_alarm' end as outcome, coalesce(nullif(trick, ''), '?') as trick, count(*) as n
  from ({LABELLED_SQL}) l where (label = 'leak' and not coalesce(flag, false)) or (label = 'clean' and flag) group by all""")
def f06(t):
    return score.outcomes(labelled(t).withColumn("trick", evalrows.trick_of(F.col("trick"))))


@query("b18_trick_label", f"""select doc_id, coalesce(nullif(case when doc_id % 4 = 0 then 'i' || doc_id else '' end, ''), nullif(trick, ''), nullif(case when doc_id % 5 = 0 then lang end, ''), '?') as trick from ({LABELLED_SQL}) l where detector = 'long'""")
def b18(t):
    rows = labelled(t).where("detector = 'long'")
    rid = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("i"), F.col("doc_id").cast("string"))).otherwise("")
    return rows.select("doc_id", evalrows.trick_of(rid, F.col("trick"), F.when(F.col("doc_id") % 5 == 0, F.col("lang"))).alias("trick"))


def _wilson4(k, n):
    return f"round_even({wilson_sql(k, n, False)}, 4)", f"round_even({wilson_sql(k, n, True)}, 4)"


@query("f12_interval_table", f"""select detector, eval_set, {_wilson4("caught", "leaks")[0]} as recall_lo, {_wilson4("caught", "leaks")[1]} as recall_hi, {_wilson4("false_alarms", "clean")[0]} as fa_lo,
  {_wilson4("false_alarms", "clean")[1]} as fa_hi from {RESULTS_SQL} r""")
def f12(t):
    return score.interval_table(results(t))


@query("f10_wilson_interval", f"""select l_orderkey, count(*) filter (l_returnflag = 'R') as k, count(*) as n, round({wilson_sql("count(*) filter (l_returnflag = 'R')", "count(*)", False)}, 8) as lo,
  round({wilson_sql("count(*) filter (l_returnflag = 'R')", "count(*)", True)}, 8) as hi from lineitem group by l_orderkey""")
def f10(t):
    counts = t.lineitem.groupBy("l_orderkey").agg(F.count_if(F.col("l_returnflag") == "R").alias("k"), F.count("*").alias("n"))
    w = wilson(F.col("k"), F.col("n"))
    return counts.select("l_orderkey", "k", "n", F.round(w["lo"], 8).alias("lo"), F.round(w["hi"], 8).alias("hi"))


NEWCOMBE = f"""select *, p1 - p2 as d, p1 - p2 - sqrt((p1 - l1) * (p1 - l1) + (u2 - p2) * (u2 - p2)) as dlo, p1 - p2 + sqrt((u1 - p1) * (u1 - p1) + (p2 - l2) * (p2 - l2)) as dhi, l1 <= u2 and l2 <= u1 as overlap from (
    select *, k1 / n1 as p1, k2 / n2 as p2, {wilson_sql("k1", "n1", False)} as l1, {wilson_sql("k1", "n1", True)} as u1, {wilson_sql("k2", "n2", False)} as l2, {wilson_sql("k2", "n2", True)} as u2 from {{0}}) w"""
_COMPARED = "select round(p1, 8) as p1, round(p2, 8) as p2, round(d, 8) as diff, round(dlo, 8) as lo, round(dhi, 8) as hi, overlap"


@query("f11_newcombe_interval", f"""{_COMPARED}, l_suppkey from ({NEWCOMBE.format("(select l_suppkey, count(*) filter (l_returnflag = 'R' and l_linestatus = 'O') as k1, count(*) filter (l_linestatus = 'O') as n1, count(*) filter (l_returnflag = 'R' and l_linestatus = 'F') as k2, count(*) filter (l_linestatus = 'F') as n2 from lineitem group by l_suppkey) c")}) x where n1 > 0 and n2 > 0""")
def f11(t):
    r, o, f = F.col("l_returnflag") == "R", F.col("l_linestatus") == "O", F.col("l_linestatus") == "F"
    c = t.lineitem.groupBy("l_suppkey").agg(
        F.count_if(r & o).alias("k1"), F.count_if(o).alias("n1"), F.count_if(r & f).alias("k2"), F.count_if(f).alias("n2")
    ).withColumn("c", newcombe(F.col("k1"), F.col("n1"), F.col("k2"), F.col("n2"))).where("c is not null")
    return c.select("l_suppkey", *[F.round(f"c.{x}", 8).alias(x) for x in ("p1", "p2", "diff", "lo", "hi")], "c.overlap")


_PAIR = f"(select a.eval_set, a.caught as k1, a.leaks as n1, b.caught as k2, b.leaks as n2 from {RESULTS_SQL} a join {RESULTS_SQL} b using (eval_set) where a.detector = 'long' and b.detector = 'judged' and a.leaks > 0) c"


@query("e15_compare_recall", f"""{_COMPARED}, eval_set from ({NEWCOMBE.format(_PAIR)}) x""")
def e15(t):
    c = score.compare_recall(results(t), "long", "judged").where("p1 is not null")
    return c.select("eval_set", *[F.round(x, 8).alias(x) for x in ("p1", "p2", "diff", "lo", "hi")], "overlap")


STORED = f"""(select detector, eval_set, 'recall' as metric, {wilson_sql("caught", "leaks", False)} + case when n % 2 = 0 then 0.001 else 0.02 end as s_lo, {wilson_sql("caught", "leaks", True)} as s_hi from {RESULTS_SQL} r where leaks > 0)"""


@query("f25_stale_intervals", f"""with m as (select detector, eval_set, 'recall' as metric, caught as k, leaks as n from {RESULTS_SQL} r union all select detector, eval_set, 'false_alarm', false_alarms, clean from {RESULTS_SQL} r),
  w as (select *, {wilson_sql("k", "n", False)} as lo, {wilson_sql("k", "n", True)} as hi from m), j as (select w.*, s_lo, s_hi, coalesce(abs(s_lo - lo) < 0.005 and abs(s_hi - hi) < 0.005, false) as ok from w left join {STORED} s using (detector, eval_set, metric))
  select detector, eval_set, metric, case when n > 0 then round(k / n, 8) end as rate, not ok and s_lo is not null as stale, round(case when ok then s_lo else lo end, 8) as lo, round(case when ok then s_hi else hi end, 8) as hi from j""")
def f25(t):
    r = results(t)
    w = wilson(F.col("caught"), F.col("leaks"))
    stored = r.where("leaks > 0").select(
        "detector", "eval_set", F.lit("recall").alias("metric"), (w["lo"] + F.when(F.col("n") % 2 == 0, 0.001).otherwise(0.02)).alias("lo"), w["hi"].alias("hi")
    )
    out = score.stale_intervals(r, stored)
    return out.select("detector", "eval_set", "metric", F.round("rate", 8).alias("rate"), "stale", F.round("lo", 8).alias("lo"), F.round("hi", 8).alias("hi"))


_CELL = """cast(floor(case when sum(case when detector = '{0}' then leaks end) > 0 then sum(case when detector = '{0}' then caught end) / sum(case when detector = '{0}' then leaks end) * 100 end + 0.5) as bigint) as {0}_recall_pct,
    cast(sum(case when detector = '{0}' then false_alarms end) as bigint) as {0}_fa, coalesce(case when sum(case when detector = '{0}' then clean end) > 0 then sum(case when detector = '{0}' then false_alarms end) / sum(case when detector = '{0}' then clean end) end, 0) >= 0.1 as {0}_fa_high"""


@query("f26_detector_matrix", f"""select eval_set, max(leaks) as leaks, max(clean) as clean, {_CELL.format("long")}, {_CELL.format("judged")}, case when eval_set = 'independent' then 1 else 0 end as place
  from {RESULTS_SQL} r where detector in ('long', 'judged') group by eval_set""")
def f26(t):
    return score.detector_matrix(results(t), ["long", "judged"])


@query("f27_delta_vs_base", f"""with r as (select *, case when leaks > 0 then caught / leaks end as recall from {RESULTS_SQL} x) select a.detector, a.eval_set, round(a.recall, 8) as recall, cast(floor((a.recall - b.recall) * 100 + 0.5) as int) as points
  from r a left join r b on b.eval_set = a.eval_set and b.detector = 'marked'""")
def f27(t):
    return score.delta_vs_base(results(t), "marked").withColumn("recall", F.round("recall", 8))


# --- coverage and selection -----------------------------------------------------------

# the answer key of a letter: its own matter's fact sheet
IDENTS = f"""(select d.draft_id, f.value, f.category = 'distinctive' and contains(f.value, ' ') as quasi from ({V.DRAFTS}) d join ({V.FACTS}) f using (matter_id))"""
FACT_SPANS = f"""(select h.draft_id, 'known' as cond, 'facts' as detector, h."start", h."end" from ({FACT_HITS}) h
   union all select h.draft_id, 'unseen', 'facts', h."start", h."end" from ({FACT_HITS}) h join ({V.DRAFTS}) d using (draft_id) left join (select matter_id, value, (select count(distinct matter_id) from ({V.FACTS}) g where g.value = f.value) as owners from ({V.FACTS}) f) o on o.matter_id = d.matter_id and o.value = h.entity where o.value is null or o.owners > 1)"""
RULE_SPANS = f"""(select draft_id, c as cond, 'rules' as detector, "start", "end" from ({sql_resolved(LETTERS, "draft_id")}) s cross join (select unnest(['known', 'unseen']) as c) cc)"""
DETECTORS = list(V.PER_CHAR)
MIXES = sweep.mixes_of(DETECTORS)
_PARTS = ", ".join(f"('{name}', {listed}, '{p}')" for listed, (name, parts) in enumerate(MIXES.items()) for p in parts)
_STATS = ", ".join(f"('{d}', {s}, {'null' if c is None else c})" for d, (s, c) in V.PER_CHAR.items())
SCORES = f"""mix as (select * from (values {_PARTS}) v(candidate, listed, detector)), per as (select * from (values {_STATS}) v(detector, micros, price)),
  costs as (select candidate, listed, sum(micros) as micros, case when count(price) = count(*) then sum(price) end as price from mix join per using (detector) group by all),
  spans as materialized (select * from {FACT_SPANS} f union all select * from {RULE_SPANS} r union all select draft_id, c, detector, "start", "end" from ({V.MODEL_SPANS}) m cross join (select unnest(['known', 'unseen']) as c) cc),
  cand as materialized (select distinct draft_id, cond, candidate, "start", "end" from spans join mix using (detector)),
  all_c as (select draft_id, cond, candidate from (select draft_id from ({V.DRAFTS}) d) a, (select unnest(['known', 'unseen']) as cond) b, costs c),
  occ as materialized (select draft_id, quasi, cast(pos as int) as s, cast(pos + length(value) as int) as e, value from (select *, sum(length(piece) + length(value)) over (partition by draft_id, value order by i) - length(value) as pos from (
     select *, unnest(range(1, len(g))) as i, unnest(g[1:len(g) - 1]) as piece from (select distinct i.draft_id, i.value, i.quasi, string_split(d.text, i.value) as g from {IDENTS} i join {LETTERS} d using (draft_id)) a) b) c),
  ord as (select *, max("end") over w as reach from cand window w as (partition by draft_id, cond, candidate order by "start", "end" rows between unbounded preceding and 1 preceding)),
  isl as (select *, sum(case when reach is null or "start" > reach then 1 else 0 end) over (partition by draft_id, cond, candidate order by "start", "end" rows unbounded preceding) as k from ord),
  cov as materialized (select draft_id, cond, candidate, min("start") as s, max("end") as e from isl group by draft_id, cond, candidate, k),
  hit as (select a.draft_id, a.cond, a.candidate, o.value, o.s, o.quasi, coalesce(sum(case when c.s is null then 0 else least(c.e, o.e) - greatest(c.s, o.s) end), 0) >= 0.8 * (any_value(o.e) - o.s) as hit
     from all_c a join occ o using (draft_id) left join cov c on c.draft_id = a.draft_id and c.cond = a.cond and c.candidate = a.candidate and c.s < o.e and c.e > o.s group by a.draft_id, a.cond, a.candidate, o.value, o.s, o.quasi),
  tok as (select draft_id, "start" as s, "end" as e from ({V.span_cte(LETTERS, "draft_id", "text", "[A-Za-z0-9_]+")}) t),
  free as materialized (select t.* from tok t where not exists (select 1 from occ o where o.draft_id = t.draft_id and o.s < t.e and o.e > t.s)),
  overs as (select a.draft_id, a.cond, a.candidate, f.s, max(case when c.s is not null then 1 else 0 end) as over from all_c a join free f using (draft_id) left join cov c on c.draft_id = a.draft_id and c.cond = a.cond and c.candidate = a.candidate and c.s < f.e and c.e > f.s group by all),
  h2 as (select cond, candidate, count(*) filter (hit) as caught, count(*) as leaks, count(*) filter (hit and quasi) as q_caught, count(*) filter (quasi) as q_leaks from hit group by all),
  o2 as (select cond, candidate, cast(sum(over) as bigint) as false_alarms, count(*) as clean from overs group by all),
  metrics as materialized (select *, caught / leaks as identifier_recall, case when q_leaks > 0 then q_caught / q_leaks end as quasi_recall, false_alarms / clean as over_redaction,
    round(chars * micros / 1000, 2) as latency_ms_per_paragraph, round(chars * price / 10000, 4) as cost_usd_per_1k_paragraphs
    from h2 join o2 using (cond, candidate) join costs using (candidate), (select avg(length(text))::double as chars from {LETTERS} d) x)"""


def _scored(t):
    """Answer key and every detector's spans per letter and condition; the model detectors' spans are stored."""
    letters, dim = V.drafts(t).select("draft_id", "matter_id", "text"), facts.fact_table(V.matters(t))
    size = facts.size_of(dim)  # of the catalog, which no driver holds: sheets and owners of facts grow with it
    sheet = V.matters(t).select(
        "matter_id", F.array_distinct(F.flatten(F.map_values("facts"))).alias("idents"),
        F.filter(F.col("facts")["distinctive"], lambda v: v.contains(" ")).alias("quasi"),
    )
    hits = facts.fact_hits(letters.drop("matter_id"), "draft_id", dim)
    own = dim.select("matter_id", F.col("value").alias("entity"), F.lit(True).alias("mine")).distinct()
    owners = dim.groupBy(F.col("value").alias("entity")).agg((F.min("matter_id") != F.max("matter_id")).alias("shared"))
    placed = hits.join(letters.select("draft_id", "matter_id"), "draft_id").join(apart(own, *size), ["matter_id", "entity"], "left").join(apart(owners, *size), "entity")
    found = placed.groupBy("draft_id").agg(
        F.collect_list(F.struct("start", "end")).alias("known"), F.collect_list(F.when(F.col("mine").isNull() | F.col("shared"), F.struct("start", "end"))).alias("unseen")
    )
    none = F.from_json(F.lit("[]"), "array<struct<start:int,end:int>>")
    rules = F.transform(identifier_spans(F.col("text")), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    # the text work is done where the letters are read; only spans travel to the join
    read = S.computed(S.computed(letters.join(apart(sheet, *size), "matter_id"), score.answer_key(F.col("text"), F.col("idents"), F.col("quasi")), "key"), rules, "rules")
    models = V.model_spans(t).groupBy("draft_id").agg(*[F.collect_list(F.when(F.col("detector") == d, F.struct("start", "end"))).alias(d) for d in DETECTORS[2:]])
    base = read.select("draft_id", "key", "rules").join(found, "draft_id", "left").join(models, "draft_id", "left").select(
        "key", "rules", *[F.coalesce(c, none).alias(c) for c in ("known", "unseen", *DETECTORS[2:])]
    )
    return S.unnest(base, F.array(*[F.struct(F.lit(c).alias("cond"), F.col(c).alias("facts")) for c in ("known", "unseen")]), "v", "key", *DETECTORS[1:]).select("v.*", "key", *DETECTORS[1:])


def _metrics(t):
    counted = sweep.histogram(_scored(t), ["cond"], {d: d for d in DETECTORS}, MIXES)
    return sweep.mix_metrics(counted, V.detector_stats(t), DETECTORS, MIXES, ["cond"])


@query("f07_coverage_score", f"""with {SCORES} select cond, candidate, caught, leaks, q_caught, q_leaks, false_alarms, clean from metrics""")
def f07(t):
    return _metrics(t).select("cond", "candidate", "caught", "leaks", "q_caught", "q_leaks", "false_alarms", "clean")


@query("f08_metric_row", f"""with {SCORES} select cond, candidate, round(identifier_recall, 8) as identifier_recall, round(quasi_recall, 8) as quasi_recall, round(over_redaction, 8) as over_redaction, latency_ms_per_paragraph, cost_usd_per_1k_paragraphs from metrics""")
def f08(t):
    m = _metrics(t)
    return m.select("cond", "candidate", *[F.round(c, 8).alias(c) for c in ("identifier_recall", "quasi_recall", "over_redaction")], "latency_ms_per_paragraph", "cost_usd_per_1k_paragraphs")


_PICK = " ".join(f"when '{name}' then '{','.join(dict.fromkeys(('facts', *parts)))}'" for name, parts in MIXES.items())


@query("h02_constrained_choice", f"""with {SCORES} select candidate, round(identifier_recall, 8) as identifier_recall, case candidate {_PICK} end as detectors
  from metrics where cond = 'unseen' and over_redaction <= 0.5 order by identifier_recall desc, coalesce(quasi_recall, 0) desc, latency_ms_per_paragraph, listed limit 1""")
def h02(t):
    best = score.strategy(score.choose(_metrics(t).where("cond = 'unseen'"), 0.5))
    return best.select("candidate", F.round("identifier_recall", 8).alias("identifier_recall"), F.array_join("detectors", ",").alias("detectors"))


@query("f09_detector_unions", f"""with {SCORES} select cond, candidate, caught, leaks, false_alarms, clean, latency_ms_per_paragraph, cost_usd_per_1k_paragraphs from metrics where contains(candidate, '+')""")
def f09(t):
    return _metrics(t).where(F.col("candidate").isin(*P.DETECTOR_UNIONS)).select(
        "cond", "candidate", "caught", "leaks", "false_alarms", "clean", "latency_ms_per_paragraph", "cost_usd_per_1k_paragraphs"
    )


@query("h03_strategy_union", f"""with m as (select * from (values {_PARTS}) v(candidate, listed, detector)), ran as (select unnest({DETECTORS}) as detector from orders group by 1)
  select candidate, case candidate {_PICK} end as detectors from m left join ran using (detector) group by candidate having count(*) = count(ran.detector)""")
def h03(t):
    return score.strategy(sweep.mix_costs(V.detector_stats(t), MIXES)).select("candidate", F.array_join("detectors", ",").alias("detectors"))


# --- percentiles, ordering, limits ------------------------------------------------------


@query("f16_usage_percentiles", """with s as (select unnest(['input_tokens', 'output_tokens', 'latency_s']) as metric, unnest([l_extendedprice, l_quantity, l_tax + l_discount]) as v from lineitem)
  select metric, round(avg(v), 6) as mean, round(quantile_cont(v, 0.5), 8) as p50, round(quantile_cont(v, 0.95), 8) as p95, round(case metric when 'input_tokens' then avg(v) * 2 / 1000 when 'output_tokens' then avg(v) * 10 / 1000 end, 4) as usd_per_1k_calls from s group by metric""")
def f16(t):
    samples = t.lineitem.select(F.col("l_extendedprice").alias("input_tokens"), F.col("l_quantity").alias("output_tokens"), (F.col("l_tax") + F.col("l_discount")).alias("latency_s"))
    u = cost.usage_summary(samples, 2.0, 10.0)
    return u.select("metric", F.round("mean", 6).alias("mean"), F.round("p50", 8).alias("p50"), F.round("p95", 8).alias("p95"), F.round("usd_per_1k_calls", 4).alias("usd_per_1k_calls"))


@query("f16_percentile_by_group", """select l_suppkey, round(quantile_cont(l_extendedprice, 0.5), 6) as p50, round(quantile_cont(l_extendedprice, 0.95), 6) as p95 from lineitem group by l_suppkey""")
def f16_groups(t):
    p = score.exact_percentiles(t.lineitem, ["l_suppkey"], "l_extendedprice", [0.5, 0.95], per_bucket=100)
    return p.groupBy("l_suppkey").agg(
        F.round(F.max(F.when(F.col("p") == 0.5, F.col("percentile"))), 6).alias("p50"), F.round(F.max(F.when(F.col("p") == 0.95, F.col("percentile"))), 6).alias("p95")
    )


@query("g04_last_write_wins", """select user_id, event_type, event_id, value from (select *, row_number() over (partition by user_id, event_type order by ts desc, event_id desc) as r from events) e where r = 1""")
def g04(t):
    rows = t.events.select("user_id", "event_type", "event_id", "value", F.struct("ts", "event_id").alias("written"))
    return last_writes(rows, ["user_id", "event_type"], "written").select("user_id", "event_type", "event_id", "value")


@query("h04_head_limit", "select doc_id, source, n_chars from documents order by doc_id limit 50")
def h04(t):
    return t.documents.select("doc_id", "source", "n_chars").orderBy("doc_id").limit(50)


@query("h06_ranked_kinds", f"""select kind, count(*) as n from ({sql_resolved(LETTERS, "draft_id")}) s group by kind""")
def h06(t):
    from veilspan.operators.catalog import kinds_ranked

    return kinds_ranked(V.drafts(t).select(F.lit("done").alias("state"), identifier_spans(F.col("text")).alias("spans")))


@query("f23_kind_precision_recall", f"""with f as (select draft_id, list(distinct kind) as found from ({sql_resolved(LETTERS, "draft_id")}) s group by draft_id),
  e as (select draft_id, list_distinct(case variant when 7 then ['email', 'phone', 'ssn', 'passport', 'a_number', 'receipt', 'address', 'url', 'name', 'org', 'amount', 'date'] when 0 then ['name', 'org', 'amount'] when 3 then ['name', 'org', 'amount'] else ['name', 'org'] end) as expected from ({V.DRAFTS}) d),
  c as (select sum(len(list_intersect(coalesce(found, []), expected))) as tp, sum(len(list_filter(coalesce(found, []), lambda k: not list_contains(expected, k)))) as fp, sum(len(list_filter(expected, lambda k: not list_contains(coalesce(found, []), k)))) as fn from e left join f using (draft_id))
  select cast(tp as bigint) as tp, cast(fp as bigint) as fp, cast(fn as bigint) as fn, round(tp / (tp + fp), 8) as precision, round(tp / (tp + fn), 8) as recall from c""")
def f23(t):
    expected = F.expr("case variant when 7 then array('email','phone','ssn','passport','a_number','receipt','address','url','name','org','amount','date') when 0 then array('name','org','amount') when 3 then array('name','org','amount') else array('name','org') end")
    rows = V.drafts(t).select(F.array_distinct(identifier_spans(F.col("text"))["kind"]).alias("found"), expected.alias("expected"))
    return score.kind_set_score(rows).select("tp", "fp", "fn", F.round("precision", 8).alias("precision"), F.round("recall", 8).alias("recall"))
