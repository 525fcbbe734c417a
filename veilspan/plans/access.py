"""Tenant-scoped reads, catalog, review state and audit."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilspan.functions import spans as S
from veilspan.operators import access, audit, carryover, catalog, cost, facts, fingerprint, score, scrub
from veilspan.plans import world as V
from veilspan.plans.base import query
from veilspan.plans.leaks import CREDITED, NOTE_GRAMS
from veilspan.plans.redaction import _PARTS, DRAFTS_SQL, PARTS_EXPR, scrub_sql
from veilspan.plans.redaction import _requests as _scrub_requests
from veilspan.session import fresh_path
from veilspan.sources import readers, writers

# --- search and page reads: letters are pages, a customer may read its own matter -----------------

PAGES = f"(select matter_id as source_id, 'order-' || draft_id as slug, 'Letter ' || draft_id as title, text as chunk_text from ({V.DRAFTS}) d)"
GRANTS = "(select 'P' || c_custkey as principal, 'M' || c_custkey as source_id from customer)"


def _pages(t):
    return V.drafts(t).select(
        F.col("matter_id").alias("source_id"), F.concat(F.lit("order-"), F.col("draft_id").cast("string")).alias("slug"),
        F.concat(F.lit("Letter "), F.col("draft_id").cast("string")).alias("title"), F.col("text").alias("chunk_text"),
    )


def _key(prefix, column):
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


def _grants(t):
    return t.customer.select(_key("P", "c_custkey").alias("principal"), _key("M", "c_custkey").alias("source_id"))


ASKED = "case when matter_ord % 4 = 1 then '__all__' when matter_ord % 4 = 2 then matter_id when matter_ord % 4 = 3 then 'M' || (matter_ord + 1) end"
REQUESTS = f"(select matter_ord as request_id, 'P' || matter_ord as principal, client || ' of ledger' as query, {ASKED} as asked_source from ({V.MATTERS}) m)"


def _requests(t):
    return V.matters(t).select(
        F.col("matter_ord").alias("request_id"), _key("P", "matter_ord").alias("principal"), F.concat("client", F.lit(" of ledger")).alias("query"), F.expr(ASKED).alias("asked_source")
    )


@query("e10_scoped_search", f"""with r as (select request_id, g.source_id, unnest(list_filter(string_split(lower(query), ' '), lambda w: length(w) > 2)) as term from {REQUESTS} q join {GRANTS} g using (principal) where asked_source is null or asked_source in ('__all__', g.source_id))
  select request_id, slug, source_id, count(distinct term) as score from r join {PAGES} p using (source_id) where contains(lower(chunk_text), term) group by all""")
def e10(t):
    return access.search(_requests(t), _grants(t), _pages(t))


_READ = "case when o_orderkey % 5 = 1 then 'M' || (o_custkey + 1) when o_orderkey % 5 = 2 then '__all__' when o_orderkey % 5 = 3 then 'M' || o_custkey end"
_SLUG = "case when o_orderkey % 7 = 0 then 'intake' else 'order-' || o_orderkey end"


@query("e11_scoped_page_read", f"""select request_id, slug, source_id, case when not ok then 'permission_denied' when p.slug2 is null then 'page_not_found' else 'ok' end as outcome, case when ok and p.slug2 is not null then title end as title, case when ok and p.slug2 is not null then chunk_text end as chunk_text
  from (select o_orderkey as request_id, {_SLUG} as slug, coalesce(nullif({_READ}, '__all__'), g.source_id) as source_id, coalesce(coalesce(nullif({_READ}, '__all__'), g.source_id) = g.source_id, false) as ok from orders o left join {GRANTS} g on g.principal = 'P' || o.o_custkey) q
  left join (select source_id as s2, slug as slug2, title, chunk_text from {PAGES} x) p on p.s2 = q.source_id and p.slug2 = q.slug""")
def e11(t):
    reads = t.orders.select(F.col("o_orderkey").alias("request_id"), _key("P", "o_custkey").alias("principal"), F.expr(_SLUG).alias("slug"), F.expr(_READ).alias("asked_source"))
    return access.get_page(reads, _grants(t), _pages(t))


def _pairs(t):
    m = V.matters(t).select("matter_ord", "client")
    target = m.select((F.col("matter_ord") - 1).alias("matter_ord"), F.col("client").alias("target_query"))
    return m.join(target, "matter_ord").select(
        F.col("matter_ord").alias("pair_id"), _key("P", "matter_ord").alias("attacker"), F.concat(F.lit("P"), (F.col("matter_ord") + 1).cast("string")).alias("target"),
        F.col("client").alias("attacker_query"), "target_query", F.lit("intake").alias("target_slug"),
    )


_FOUND = f"""(select p.source_id, r.k, count(distinct p.slug) as hits from (select matter_ord as k, 'M' || matter_ord as source_id, unnest(list_filter(string_split(lower(client), ' '), lambda w: length(w) > 2)) as term from ({V.MATTERS}) m) r join {PAGES} p on p.source_id = r.source_id and contains(lower(p.chunk_text), r.term) group by all)"""
_CROSS = f"""(select r.k, count(distinct p.slug) as hits from (select matter_ord - 1 as k, 'M' || (matter_ord - 1) as source_id, unnest(list_filter(string_split(lower(client), ' '), lambda w: length(w) > 2)) as term from ({V.MATTERS}) m) r join {PAGES} p on p.source_id = r.source_id and contains(lower(p.chunk_text), r.term) group by all)"""
CHECKS = f"""with pairs as (select m.matter_ord as pair_id from ({V.MATTERS}) m join ({V.MATTERS}) n on n.matter_ord = m.matter_ord + 1), f as materialized (select * from {_FOUND} a), x as materialized (select * from {_CROSS} a)
  select pair_id, 'own_recall' as "check", coalesce(hits, 0) as hits, coalesce(hits, 0) > 0 as passed from pairs left join f on f.k = pair_id
  union all select pair_id, 'control', coalesce(hits, 0), coalesce(hits, 0) > 0 from pairs left join f on f.k = pair_id + 1
  union all select pair_id, c, coalesce(hits, 0), coalesce(hits, 0) = 0 from pairs left join x on x.k = pair_id, (select unnest(['foreign_search', 'all_sources']) as c) cc
  union all select pair_id, 'direct_read', 0, true from pairs"""


@query("e17_attack_suite", CHECKS)
def e17(t):
    return access.attack_checks(_pairs(t), _grants(t), _pages(t))


@query("f13_attack_totals", f"""select pair_id, count(*) filter (passed) as passed, count(*) as total from ({CHECKS}) c group by pair_id""")
def f13(t):
    return access.attack_totals(access.attack_checks(_pairs(t), _grants(t), _pages(t)), ["pair_id"])


# --- catalog and policy -----------------------------------------------------------------------------

_BASE = "select 'R' || r_regionkey as practice, r_name as may, lower(r_name) as never from {region}"
_OVER = "select 'R' || n_nationkey as practice, n_name as may, '' as never from {nation} where n_regionkey = 1"


def _policy(t, sql, **frames):
    return t.sql(sql, **frames).select("practice", F.array("may").alias("may_compound"), F.array("never").alias("never_compounds"))


@query("e13_policy_override", """select practice, coalesce(o.may, b.may) as may, case when o.may is not null then o.never else b.never end as never
  from (select 'R' || r_regionkey as practice, r_name as may, lower(r_name) as never from region) b full join (select 'R' || n_nationkey as practice, n_name as may, '' as never from nation where n_regionkey = 1) o using (practice)""")
def e13(t):
    merged = catalog.merged_policy(_policy(t, _BASE, region=t.region), _policy(t, _OVER, nation=t.nation))
    return merged.select("practice", F.array_join("may_compound", ",").alias("may"), F.array_join("never_compounds", ",").alias("never"))


@query("b14_policy_shape_check", """select practice, case when trim(practice) = '' then 'practice name must be a non-empty string' when n % 5 = 1 then 'missing may_compound' when n % 5 = 2 then 'never_compounds must be a list of non-empty strings' end as reason
  from (select n_nationkey as n, case when n_nationkey % 5 = 0 then ' ' else n_name end as practice from nation) s""")
def b14(t):
    n = F.col("n_nationkey")
    rows = t.nation.select(
        F.when(n % 5 == 0, " ").otherwise(F.col("n_name")).alias("practice"), F.when(n % 5 != 1, F.array("n_name")).alias("may_compound"),
        F.when(n % 5 == 2, F.array(F.lit("x"), F.lit("  "))).otherwise(F.array("n_name")).alias("never_compounds"),
    )
    return catalog.policy_problems(rows).select("practice", "reason")


@query("e20_catalog_documents", f"""select m.matter_id, m.client, m.practice, n.doc_name, length(n.text) as chars from ({V.MATTERS}) m left join ({V.NOTES}) n using (matter_id)""")
def e20(t):
    rows = catalog.catalog_documents(V.matters(t).select("matter_id", "client", "practice"), V.notes(t).select("matter_id", "doc_name", "text"))
    return rows.select("matter_id", "client", "practice", "doc_name", F.length("text").alias("chars"))


STATES = """(select 'M' || c_custkey as matter_id, c_custkey as matter_ord, coalesce(total, 0) as total, coalesce(added, 0) as added, coalesce(flagged, 0) as flagged,
    case when coalesce(flagged, 0) > 0 then 'flagged' when coalesce(added, 0) = 0 then 'todo' when added >= total then 'done' else 'partial' end as state
    from customer left join (select o_custkey, count(*) as total, count(*) filter (o_orderstatus = 'F') as added, count(*) filter (o_orderstatus = 'P' and o_orderkey % 10 = 7) as flagged from orders group by 1) o on o_custkey = c_custkey)"""


def _states(t):
    docs = t.orders.select(_key("M", "o_custkey").alias("matter_id"))
    flagged = (F.col("o_orderstatus") == "P") & (F.col("o_orderkey") % 10 == 7)
    entries = t.orders.select(_key("M", "o_custkey").alias("matter_id"), flagged.alias("flagged"), (F.col("o_orderstatus") == "F").alias("fresh"))
    entries = entries.where("flagged or fresh").drop("fresh")
    return catalog.review_state(t.customer.select(_key("M", "c_custkey").alias("matter_id"), F.col("c_custkey").alias("matter_ord")), docs, entries)


@query("e16_review_state", f"select * from {STATES} s")
def e16(t):
    return _states(t)


@query("h07_next_matter", f"select * from {STATES} s where state in ('flagged', 'partial', 'todo') order by case state when 'flagged' then 1 when 'partial' then 2 else 3 end, matter_ord limit 1")
def h07(t):
    return catalog.next_matter(_states(t))


@query("f20_review_progress", f"select cast(sum(total) as bigint) as total, cast(sum(added) as bigint) as added, cast(sum(flagged) as bigint) as flagged, cast(floor(sum(added) / sum(total) * 100 + 0.5) as bigint) as pct from {STATES} s")
def f20(t):
    return catalog.progress(_states(t))


VERDICT = "case variant when 1 then 'leak' when 2 then 'clean' when 3 then 'clean' when 8 then 'leak' end"
STATE = "case when variant = 5 then 'error' when variant = 6 then 'idle' else 'done' end"
DOCS = f"(select draft_id, 'M/' || draft_id as id, text as redacted, {STATE} as state, {VERDICT} as residual_verdict, cast(draft_id % 13 as int) as removed, case when variant in (1, 2) then 'prompt_judge' end as judge, variant from ({V.DRAFTS}) d)"


def _docs(t):
    flag = F.array(F.struct(F.lit(0).alias("start"), F.lit(1).alias("end"), F.when(F.col("variant") == 2, "judge_flag").otherwise("name").alias("kind")))
    return V.drafts(t).select(
        "draft_id", F.concat(F.lit("M/"), F.col("draft_id").cast("string")).alias("id"), F.col("text").alias("redacted"), F.expr(STATE).alias("state"), F.expr(VERDICT).alias("residual_verdict"),
        (F.col("draft_id") % 13).cast("int").alias("removed"), F.when(F.col("variant").isin(1, 2), "prompt_judge").alias("judge"), flag.alias("spans"),
    )


@query("b16_open_flag", f"select draft_id, coalesce(residual_verdict = 'leak', false) as open from {DOCS} d")
def b16(t):
    return _docs(t).select("draft_id", catalog.open_flag(F.col("residual_verdict")).alias("open"))


@query("b17_export_gate", f"""select draft_id, true as strict from {DOCS} d where state = 'done' and residual_verdict = 'clean' union all select draft_id, false from {DOCS} d where state = 'done' and coalesce(residual_verdict, 'x') <> 'leak'""")
def b17(t):
    d = _docs(t)
    return catalog.exportable(d).select("draft_id", F.lit(True).alias("strict")).unionByName(catalog.exportable(d, True).select("draft_id", F.lit(False).alias("strict")))


@query("f19_readiness", f"""select count(*) as docs, count(*) filter (state = 'done') as done, cast(sum(removed) filter (state = 'done') as bigint) as removed, count(*) filter (state = 'done' and residual_verdict = 'leak') as flags, count(*) filter (state = 'done' and variant = 2) as redacted,
    count(*) filter (state = 'done' and residual_verdict = 'clean') as cleared, count(*) filter (state = 'done' and residual_verdict is null) as unverified, count(*) filter (state = 'error') as failed, count(*) filter (state = 'idle') as todo,
    count(*) filter (state = 'done' and residual_verdict = 'clean') as ready, count(*) filter (state = 'error' or (state = 'done' and coalesce(residual_verdict, 'leak') = 'leak')) as held from {DOCS} d""")
def f19(t):
    return catalog.readiness(_docs(t))


@query("e21_worklist", f"""with d as (select n.matter_id || '/' || n.doc_name as id, 'Intake note' as label, m.client as petitioner, n.matter_id, m.name_1 as beneficiary, n.text from ({V.NOTES}) n join ({V.MATTERS}) m using (matter_id) where m.practice = 'immigration'),
  e as (select 'M' || (o_custkey) || case when o_orderkey = lo then '/intake-note.md' else '/order-' || o_orderkey end as id, case when o_orderkey % 2 = 0 then 'Order ' || o_orderkey else 'Review exhibit' end as label, 'M' || o_custkey as matter_id, 'clean text' as text, o_orderkey % 9 as removed from (select *, min(o_orderkey) over (partition by o_custkey) as lo from orders) o where o_orderstatus = 'P')
  select coalesce(d.id, e.id) as id, coalesce(d.label, e.label) as label, d.petitioner, coalesce(d.matter_id, e.matter_id) as matter_id, beneficiary, length(coalesce(d.text, e.text)) as chars, case when e.id is null then 'matter' else 'review' end as source, case when e.id is null then 'idle' else 'done' end as state, e.removed from d full join e on d.id = e.id""")
def e21(t):
    m = V.matters(t).select("matter_id", "client", "practice", F.col("facts")["names"][0].alias("beneficiary"))
    docs = V.notes(t).select("matter_id", "doc_name", "text").join(m, "matter_id")
    lo = t.orders.groupBy("o_custkey").agg(F.min("o_orderkey").alias("lo"))
    o = t.orders.where("o_orderstatus = 'P'").join(lo, "o_custkey")
    entries = o.select(
        F.concat(_key("M", "o_custkey"), F.when(F.col("o_orderkey") == F.col("lo"), "/intake-note.md").otherwise(_key("/order-", "o_orderkey"))).alias("id"),
        F.when(F.col("o_orderkey") % 2 == 0, _key("Order ", "o_orderkey")).otherwise("").alias("title"), F.lit(None).cast("string").alias("document"), F.lit(None).cast("string").alias("client"),
        _key("M", "o_custkey").alias("matter_id"), F.lit("clean text").alias("text"), (F.col("o_orderkey") % 9).alias("removed"), F.lit(None).cast("string").alias("verdict"), F.lit(None).cast("string").alias("judge"),
    )
    out = catalog.worklist(docs, entries, "immigration")
    return out.select("id", "label", "petitioner", "matter_id", "beneficiary", F.length("text").alias("chars"), "source", "state", "removed")


@query("e22_generated_cases", f"""with m as (select *, matter_ord as c from ({V.MATTERS}) x)
  select c as c_ord, 0 as o_ord, 0 as form, matter_id as current, null as other, 'clean' as label, 'For ' || client || ': ' || name_1 || ' accepts ' || amount_1 || '.' as draft from m
  union all select c, 0, 1, matter_id, null, 'clean', 'Update to ' || client || '. Still open: ' || detail_1 || '.' from m
  union all select a.c, b.c - a.c, f, a.matter_id, b.matter_id, 'leak', case f when 2 then 'For ' || a.client || ': compare ' || b.name_1 || ', who was paid ' || b.amount_1 || '.' when 3 then 'Update to ' || a.client || '. Seen before: ' || b.detail_1 || '.' else 'Memo to ' || a.client || ': ask ' || b.org_1 || '.' end
    from m a join m b on b.c in (a.c + 1, a.c + 2), (select unnest([2, 3, 4]) as f) ff""")
def e22(t):
    return cost.generated_cases(V.matters(t))


@query("f22_evasion_matrix", f"""with {NOTE_GRAMS}, {scrub_sql(DRAFTS_SQL)}, l as (select d.draft_id, d.variant, d.draft_id in (select draft_id from ({CREDITED}) c) as regex, d.draft_id in (select draft_id from phrases) as carryover,
    not len(list_filter({_PARTS}, lambda p: not contains(lower(scrubbed), p))) = 0 as scrub from {DRAFTS_SQL} d join scrubbed using (draft_id))
  select draft_id as case_id, variant, regex, carryover, scrub, not (regex or carryover or scrub) as evades_all from l""")
def f22(t):
    d = V.drafts(t).select(F.col("draft_id").alias("case_id"), "variant")
    drafts = V.drafts(t).select("draft_id", "matter_id", "text")
    named = fingerprint.fingerprint_hits(drafts, facts.fact_table(V.matters(t))).select("draft_id").distinct()
    copied = carryover.carryover_grams(drafts, carryover.gram_owners(V.notes(t))).select("draft_id").distinct()
    done = scrub.scrub(_scrub_requests(t).join(V.drafts(t).select("draft_id", "variant"), "draft_id"), V.matters(t))
    survived = done.select("draft_id", (~scrub.survives(F.col("scrubbed"), F.expr(PARTS_EXPR))).alias("caught"))
    parts = [("regex", named.withColumn("caught", F.lit(True))), ("carryover", copied.withColumn("caught", F.lit(True))), ("scrub", survived)]
    layers = None
    for name, rows in parts:
        rows = rows.select(F.col("draft_id").alias("case_id"), F.lit(name).alias("layer"), "caught")
        layers = rows if layers is None else layers.unionByName(rows)
    return score.evasion_matrix(d, layers, ["regex", "carryover", "scrub"])


# --- audit: events are the log ---------------------------------------------------------------------------

LOG = """select event_id as seq, ts as timestamp, case when event_type = 'error' then null else event_type end as kind, 'M' || cast(user_id as string) as matter, event_type || ' by ' || cast(user_id as string) as summary, props as counts from {events}"""


def _log(t):
    return t.sql(LOG, events=t.events)


@query("a08_event_normalising", """select event_id, coalesce(case when event_type = 'error' then null else event_type end, 'note') as kind, 'M' || user_id as matter, cast(json_extract_string(props, '$.k') as double) as k, 1 as n_counts from events""")
def a08(t):
    done = audit.normalise(_log(t).withColumnRenamed("summary", "said").withColumn("summary", F.col("seq").cast("string")))
    return done.select(F.col("summary").cast("bigint").alias("event_id"), "kind", "matter", F.col("counts")["k"].alias("k"), F.size("counts").alias("n_counts"))


@query("b11_numeric_members", """select event_id, case when event_id % 2 = 0 then event_id + 0.5 end as n, cast(1 as int) + case when event_id % 2 = 0 then 1 else 0 end as members from events""")
def b11(t):
    raw = F.concat(F.lit('{"flag":true,"name":"x","text_number":"12","deep":{"n":7,"list":[1,2]},"one":"0","\\u006fne":1,"list":[3]'), F.when(F.col("event_id") % 2 == 0, F.concat(F.lit(',"n":'), (F.col("event_id") + 0.5).cast("string"))).otherwise(""), F.lit("}"))
    counts = audit.numbers_only(raw)
    return t.events.select("event_id", counts.alias("c")).select("event_id", F.try_element_at("c", F.lit("n")).alias("n"), F.size("c").alias("members"))


@query("h01_recent_events", "select event_id as seq, event_type || ' by ' || user_id as summary from events order by event_id desc limit 100")
def h01(t):
    return audit.recent(_log(t), "bad").select("seq", "summary")


@query("f17_audit_counts", "select case when event_type = 'error' then 'note' else event_type end as kind, count(*) as n from events group by 1")
def f17(t):
    return audit.counts_by_kind(_log(t))


@query("f17_audit_filter", "select event_id as seq, 'M' || user_id as matter from events where event_type = 'error' and user_id = 7")
def f17_filter(t):
    return audit.filtered(_log(t), "note", "M7").select("seq", "matter")


@query("f18_last_event_per_matter", "select matter, seq, summary from (select 'M' || user_id as matter, event_id as seq, event_type || ' by ' || user_id as summary, row_number() over (partition by user_id order by event_id desc) as r from events) e where r = 1")
def f18(t):
    return audit.last_per_matter(_log(t)).select("matter", "seq", "summary")


@query("a10_audit_backfill", """select case event_type when 'view' then 'attack' when 'click' then 'reuse' else 'note' end as kind, case event_type when 'view' then '' else 'M' || user_id end as matter,
    case event_type when 'view' then 'Access checks passed: ' || event_id || '/?' else 'Taken over from ' || event_type || '.json' end as summary, 1 as n_counts from events
  union all select 'eval', '', s_name || ' on all: caught ' || s_suppkey || '/' || s_nationkey || ', ? false alarms (n=' || s_nationkey || ')', 3 from supplier""")
def a10(t):
    return _backfilled(t, _log(t).where("seq < 0")).select("kind", "matter", "summary", F.size("counts").alias("n_counts"))


def _backfilled(t, log):
    cached = t.events.select(F.col("event_type").alias("stem"), F.col("ts").alias("mtime"), F.to_json(F.struct(F.concat(F.lit("M"), F.col("user_id").cast("string")).alias("target"), F.col("event_id").alias("passed"))).alias("data"))
    results = t.supplier.select(F.col("s_name").alias("detector"), F.lit("all").alias("eval_set"), F.col("s_suppkey").alias("caught"), F.col("s_nationkey").alias("leaks"), F.lit(None).cast("int").alias("false_alarms"), F.lit(None).cast("int").alias("clean"), F.col("s_nationkey").alias("n"))
    return audit.backfill(log, cached, results, {"view": "attack", "click": "reuse"}, "view")


@query("a10_backfill_beside_events", """select kind, count(*) as n, count(distinct matter) as matters from (select case when event_type = 'error' then 'note' else event_type end as kind, 'M' || user_id as matter from events) e group by kind""")
def a10_kept(t):
    log = audit.normalise(_log(t))
    whole = log.unionByName(_backfilled(t, _log(t)))
    return whole.groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("matter").alias("matters"))


# --- folders read back -------------------------------------------------------------------------------


@query("a01_matter_folders", f"""select matter_id, client, practice, name_1 as first_name, 2 as n_details from ({V.MATTERS}) m""")
def a01(t):
    root = fresh_path(t.spark, "matters")
    m = V.matters(t).select("matter_id", F.to_json(F.struct(F.col("matter_id").alias("id"), "client", "practice", "facts")).alias("value"))
    writers.write_folders(m, "matter_id", root, "matter.json")
    rows = readers.read_matters(t.spark, root, "*/*")
    return rows.select("matter_id", "client", "practice", F.col("facts")["names"][0].alias("first_name"), F.size(F.col("facts")["distinctive"]).alias("n_details"))


@query("a02_note_folders", f"""select matter_id, text from ({V.NOTES}) n""")
def a02(t):
    root = fresh_path(t.spark, "notes")
    writers.write_folders(V.notes(t).select("matter_id", F.col("text").alias("value")), "matter_id", root, "intake-note.txt")
    rows = readers.read_documents(t.spark, root, "*.txt")
    return rows.select("matter_id", F.regexp_replace("text", r"\n\z", "").alias("text"))


@query("a03_policy_file_with_override", """select practice, coalesce(o.may, b.may) as may, case when o.may is not null then o.never else b.never end as never
  from (select 'R' || r_regionkey as practice, r_name as may, lower(r_name) as never from region) b full join (select 'R' || n_nationkey as practice, n_name as may, '' as never from nation where n_regionkey = 1) o using (practice)""")
def a03(t):
    paths = []
    for rows in (_policy(t, _BASE, region=t.region), _policy(t, _OVER, nation=t.nation)):
        entry = F.struct("practice", F.struct("may_compound", "never_compounds").alias("p"))
        paths.append(fresh_path(t.spark, "policy"))
        rows.agg(F.to_json(F.map_from_entries(F.collect_list(entry))).alias("value")).write.text(paths[-1])  # a row for each practice
    merged = catalog.merged_policy(*[readers.read_policy(t.spark, p) for p in paths])
    return merged.select("practice", F.array_join("may_compound", ",").alias("may"), F.array_join("never_compounds", ",").alias("never"))
