"""Labelled-row parsing, stored completions, corrections and training rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilspan.functions import patterns as P
from veilspan.functions import spans as S
from veilspan.operators import evalrows, score, training
from veilspan.plans import world as V
from veilspan.plans.base import query
from veilspan.plans.leaks import TRIM, grams_sql
from veilspan.plans.scoring import COUNTS, LABELLED_SQL, labelled

BLOCK = r"(?s)(?:(M\d+):\s*)?Client\s+(.+?)\s*\((.+?)\)\s*v\.\s*(.+?),\s*(.+?)\.\s*Matter type:\s*(.+?)\.\s*Confidential:\s*(.+?\$[\d,]+(?:\.\d+)?)\."


def block_sql(text: str, fallback: str) -> str:
    g = lambda i: f"regexp_extract({text}, '{BLOCK}', {i})"
    return f"coalesce(nullif({g(1)}, ''), {fallback}) as matter_id, {g(2)} || '|' || {g(4)} as names, {g(3)} as org, regexp_extract({g(7)}, '\\$[\\d,]+(?:\\.\\d+)?') as amount"


def _block_columns(b):
    return [b["matter_id"].alias("matter_id"), F.array_join(b["names"], "|").alias("names"), F.array_join(b["orgs"], "|").alias("org"), F.array_join(b["amounts"], "|").alias("amount")]


_BROKEN = "case when variant = 4 then 'M9: no such form' when variant = 5 then substr(current, strpos(current, 'Client')) else '  ' || current end"


@query("b01_block_parser", f"""select row_id, {block_sql("c", "'current'")} from (select row_id, {_BROKEN} as c from ({V.CASES}) x where variant <> 4) y""")
def b01(t):
    raw = F.expr(_BROKEN.replace("strpos(", "instr("))
    rows = S.computed(V.cases(t).select("row_id", raw.alias("raw")), evalrows.parse_block(F.col("raw"), F.lit("current")), "b")
    return rows.where("b is not null").select("row_id", *_block_columns(F.col("b")))


@query("b02_protected_blocks", f"""select row_id, {block_sql("line", "'protected_' || i")} from (select row_id, unnest(protected) as line, unnest([0, 1, 2]) as i from ({V.CASES}) x) y""")
def b02(t):
    lines = F.concat(F.transform("protected", lambda p: F.concat(F.lit("- "), p)), F.array(F.lit(""), F.element_at("protected", 2)))
    rows = S.unnest(V.cases(t), evalrows.protected_blocks(lines), "b", "row_id")
    return rows.select("row_id", *_block_columns(F.col("b")))


_CHAT = "'CURRENT MATTER ' || current || chr(10) || chr(10) || 'PROTECTED (other matters):' || chr(10) || '- ' || {join} || chr(10) || chr(10) || 'DRAFT:' || chr(10) || draft"
CHAT_SQL = _CHAT.format(join="array_to_string(protected, chr(10) || '- ')")
CHAT_SPARK = _CHAT.format(join="array_join(protected, chr(10) || '- ')")


def _chat(t):
    return V.cases(t).select("row_id", "variant", "label", _messages().alias("messages"))


def _messages():
    user = F.struct(F.lit("user").alias("role"), F.expr(CHAT_SPARK).alias("content"))
    rest = F.struct(F.lit("assistant").alias("role"), F.lit("{}").alias("content"))
    system = F.struct(F.lit("system").alias("role"), F.lit("s").alias("content"))
    return F.array(system, user, rest)


@query("b03_chat_row_parser", f"""select row_id, upper(label) as label, draft, 3 as blocks, {block_sql("current", "'current'")} from ({V.CASES}) c""")
def b03(t):
    rows = _chat(t).select("row_id", evalrows.parse_chat(F.col("messages"), F.col("label")).alias("r"))
    return rows.select("row_id", "r.label", "r.draft", F.size("r.protected").alias("blocks"), *_block_columns(F.col("r.current")))


@query("b04_flat_row_parser", f"""select row_id, case when variant <> 3 then upper(label) end as label, case when variant <> 3 then draft end as draft from ({V.CASES}) c""")
def b04(t):
    label = F.when(F.col("variant") == 3, F.lit("maybe")).otherwise(F.col("label"))
    return V.cases(t).select("row_id", evalrows.parse_flat(F.col("current"), F.col("protected"), F.col("draft"), label).alias("r")).select("row_id", "r.label", "r.draft")


def _json_lines(t):
    """Chat rows, flat rows, rows of neither form and blank lines, as JSON text."""
    flat = F.to_json(F.struct("current", "protected", "draft", "label"))
    chat = F.to_json(F.struct(_messages().alias("messages"), F.struct("label").alias("meta")))
    line = F.when(F.col("variant") == 1, '{"note": 1}').when(F.col("variant") == 2, "  ").when(F.col("variant") < 6, flat).otherwise(chat)
    # a line comes once for each pair of rows with its key: rows are rendered once and met by the number of their fellows
    fellows = t.orders.groupBy(F.col("o_orderkey").alias("row_id")).agg((F.count("*") * F.count("*")).cast("int").alias("fellows"))
    told = S.computed(V.cases(t), line, "value").select("row_id", "variant", "value").join(fellows, "row_id")
    return told.select("row_id", "variant", "value", F.explode(F.array_repeat(F.lit(1), F.col("fellows")))).drop("col")


@query("a04_labelled_line_scan", f"""select row_id, case when variant <> 1 then upper(label) end as label, case when variant <> 1 then draft end as draft from ({V.CASES}) c where variant <> 2""")
def a04(t):
    return evalrows.parse_rows(_json_lines(t)).select("row_id", "row.label", "row.draft")


@query("b05_judge_cases", f"""select row_id, lower(label) as label, draft, 3 as n_protected, 2 as n_messages, {CHAT_SQL} as user_message from ({V.CASES}) c where variant not in (1, 2)""")
def b05(t):
    rows = evalrows.judge_case(_json_lines(t), "You check drafts.").where("case is not null")
    c = F.col("case")
    return rows.select(
        "row_id", c["label"].alias("label"), c["draft"].alias("draft"), F.size(c["protected"]).alias("n_protected"), F.size(c["messages"]).alias("n_messages"),
        F.element_at(c["messages"], 2)["content"].alias("user_message"),
    )


@query("f15_heldout_summary", f"""select count(*) filter (label = 'leak') as leak, count(*) filter (label = 'clean') as clean, count(*) as n from ({V.CASES}) c where variant not in (1, 2)""")
def f15(t):
    rows = evalrows.parse_rows(_json_lines(t)).where("row is not null")
    return rows.agg(F.count_if(F.col("row.label") == "LEAK").alias("leak"), F.count_if(F.col("row.label") == "CLEAN").alias("clean"), F.count("*").alias("n"))


@query("b12_heldout_check", f"""select row_id, case when variant = 1 then 'row does not parse' end as reason from ({V.CASES}) c where variant <> 2""")
def b12(t):
    rows = evalrows.parse_rows(_json_lines(t))
    reason = F.when(F.col("row").isNull(), "row does not parse").when(F.size("row.protected") == 0, "at least one protected block is required")
    return rows.select("row_id", reason.alias("reason"))


_J = "(o_custkey + i)"
_ROW = f"""with p as (select r.o_orderkey as row_id, r.o_custkey, d.text as draft, d.label, i from ({V.DRAFTS}) d join orders r on r.o_orderkey = d.draft_id, (select unnest([1, 2, 3]) as i) n),
  v as (select *, {V.amount(_J)} as v, {V.amount("o_custkey")} as own from p),
  f as (select row_id, label, bool_or(
     (contains(lower(draft), lower({V.person(_J)})) and lower({V.person(_J)}) not in (lower({V.person("o_custkey")}), lower({V.person("o_custkey + 500")})))
     or (contains(lower(draft), lower({V.person(f"({_J} + 500)")})) and lower({V.person(f"({_J} + 500)")}) not in (lower({V.person("o_custkey")}), lower({V.person("o_custkey + 500")})))
     or (contains(lower(draft), lower({V.org(_J)})) and lower({V.org(_J)}) <> lower({V.org("o_custkey")}))
     or (v <> own and (contains(draft, '$' || format('{{:,}}', v)) or regexp_matches(draft, '(^|[^0-9])' || v || '($|[^0-9])')
        or (v % 1000 = 0 and (contains(draft, '$' || (v // 1000) || 'K') or regexp_matches(draft, '\\b' || (v // 1000) || ' thousand dollars')))
        or (v >= 1000000 and contains(draft, '$' || (v // 1000000) || case when (v // 100000) % 10 = 0 then '' else '.' || ((v // 100000) % 10) end || ' million'))))) as flag from v group by row_id, label)"""


@query("f01_row_fingerprint", f"""{_ROW} select row_id, label, flag from f""")
def f01_rows(t):
    rows = V.cases(t).select("row_id", "label", evalrows.parse_flat(F.col("current"), F.col("protected"), F.col("draft"), F.col("label")).alias("r"))
    return rows.select("row_id", "label", evalrows.row_fingerprint_flag(F.col("r")).alias("flag"))


_PHRASED = f"(select row_id, variant, protected, current, case when variant in (1, 7) then protected[2] || ' ' || draft when variant = 2 then current || draft else draft end as text from ({V.CASES}) c)"


@query("f01_row_carryover", f"""with d as (select distinct row_id, g from ({grams_sql(_PHRASED, "row_id")}) a), c as (select distinct row_id, g from ({grams_sql(f"(select row_id, current as text from {_PHRASED} q)", "row_id")}) b),
  p as (select distinct row_id, k, g from ({grams_sql(f"(select row_id, k, protected[k] as text from {_PHRASED} q, (select unnest([1, 2, 3]) as k) n)", "row_id, k")}) e),
  one as (select row_id, g from p group by row_id, g having count(*) = 1), hit as (select distinct d.row_id from d join one using (row_id, g) anti join c on c.row_id = d.row_id and c.g = d.g)
  select q.row_id, h.row_id is not null as flag from {_PHRASED} q left join hit h using (row_id)""")
def f01_row_carryover(t):
    text = F.when(F.col("variant").isin(1, 7), F.concat(F.element_at("protected", 2), F.lit(" "), "draft")).when(F.col("variant") == 2, F.concat("current", "draft")).otherwise(F.col("draft"))
    rows = V.cases(t).select("row_id", evalrows.parse_flat(F.col("current"), F.col("protected"), text, F.col("label")).alias("r"))
    return rows.select("row_id", evalrows.row_carryover_flag(F.col("r")).alias("flag"))


# --- stored completions ------------------------------------------------------------------

COMPLETION = """case event_type when 'view' then '<think>{{"verdict":"clean"}}</think> {{"verdict": " LEAK ", "matter": null}}' when 'click' then 'Sure: {{"verdict": "clean"}} done' when 'error' then 'no json here'
    when 'signup' then '{{"verdict": "maybe"}}' else '{{"verdict": "leak"' end"""
_DONE = COMPLETION.replace("{{", "{").replace("}}", "}")


@query("b19_stored_verdict", "select event_id, case event_type when 'view' then 'leak' when 'click' then 'clean' end as verdict from events")
def b19(t):
    rows = t.events.select("event_id", F.expr(_DONE).alias("completion"))
    return rows.select("event_id", evalrows.stored_verdict(F.col("completion")).alias("verdict"))


_NAMED = f"(select d.draft_id, d.variant, d.text, m.client from ({V.DRAFTS}) d join ({V.MATTERS}) m using (matter_id))"


def _passages(t):
    return V.drafts(t).join(V.matters(t).select("matter_id", "client", "practice"), "matter_id")


@query("b20_completion_spans", f"""select draft_id, client as text, 'name' as kind, '[PERSON]' as replacement from {_NAMED} n where variant <> 3 union all select draft_id, 'Best wishes', 'quasi_identifier', '[QUASI_IDENTIFIER]' from {_NAMED} n where variant <> 3""")
def b20(t):
    spans = F.concat(
        F.lit('<think>{"spans":[]}</think>{"spans":[{"text":"'), F.col("client"), F.lit('","kind":"name"},{"text":"'), F.col("client"),
        F.lit('","kind":"org"},{"text":"not in it","kind":"org"},{"text":" ","kind":"org"},{"text":"Best wishes","kind":"odd"}]}'),
    )
    completion = F.when(F.col("variant") == 3, "nothing to remove").otherwise(spans)
    rows = _passages(t).select("draft_id", "text", completion.alias("completion"))
    return S.unnest(rows, training.parse_completion(F.col("text"), F.col("completion")), "s", "draft_id").select("draft_id", "s.*")


@query("f21_label_stats", f"""with n as (select count(*) as c, count(*) filter (variant = 4) as failed, count(*) filter (variant = 3) as empty from {_NAMED} x),
  k as (select unnest(['name', 'org', 'amount', 'award', 'year', 'publication', 'id_number', 'location', 'quasi_identifier']) as kind)
  select 'rows' as metric, '' as kind, c - failed as n from n union all select 'dropped', '', failed from n union all select 'spans', '', 2 * (c - failed - empty) from n union all select 'empty_rows', '', empty from n
  union all select 'kind', kind, case when kind in ('name', 'quasi_identifier') then c - failed - empty else 0 end from k, n""")
def f21(t):
    spans = F.concat(F.lit('{"spans":[{"text":"'), F.col("client"), F.lit('","kind":"name"},{"text":"Best wishes","kind":"odd"}]}'))
    completion = F.when(F.col("variant") == 3, "nothing").otherwise(spans)
    rows = _passages(t).select(F.when(F.col("variant") != 4, training.parse_completion(F.col("text"), completion)).alias("spans"))
    return training.label_stats(rows)


@query("b21_message_rendering", f"""select row_id, {CHAT_SQL} as user_message from ({V.CASES}) c""")
def b21(t):
    m = evalrows.judge_messages(F.col("current"), F.col("protected"), F.col("draft"), "s")
    return V.cases(t).select("row_id", F.element_at(m, 2)["content"].alias("user_message"))


def _quoted(text):
    return "'" + text.replace("'", "''") + "'"


_KINDS = chr(10).join(f"- {k} -> {v}" for k, v in P.SPAN_KINDS.items())
_HEAD, _NEVER, _MAY, _TASK, _REPLY = P.DEID_PROMPT
_PROMPT_SQL = f"{_quoted(_HEAD)} || n_name || {_quoted(_NEVER)} || '- ' || lower(n_name) || chr(10) || '- ' || n_regionkey || {_quoted(_MAY)} || n_name || ', ' || n_nationkey || {_quoted(_TASK + _KINDS + _REPLY)}"


@query("b21_policy_prompt", f"select n_nationkey, {_PROMPT_SQL} as prompt from nation")
def b21_prompt(t):
    may, never = F.array("n_name", F.col("n_nationkey").cast("string")), F.array(F.lower("n_name"), F.col("n_regionkey").cast("string"))
    return t.nation.select("n_nationkey", training.system_prompt(F.col("n_name"), may, never).alias("prompt"))


# --- corrections ---------------------------------------------------------------------------

FIX_KIND = "case when variant % 3 = 0 then 'wrong' when variant = 5 then 'other' else 'missed' end"
FIX_TEXT = "case when variant = 8 then 'never written' else client end"
SPAN_KIND = "case when variant = 1 then 'name' when variant = 2 then 'odd' end"
REPLACEMENT = "case when variant = 4 then '[ORG_12]' when variant = 7 then '[PERSON]' end"


def _corrections(t):
    spans = F.array(
        F.struct(F.lit("Best wishes").alias("text"), F.lit(None).cast("string").alias("kind"), F.lit("[LOCATION_3]").alias("replacement")),
        F.struct(F.col("client").alias("text"), F.lit("name").alias("kind"), F.lit("[PERSON]").alias("replacement")),
        F.struct(F.lit("").alias("text"), F.lit("name").alias("kind"), F.lit("[PERSON]").alias("replacement")),
    )
    return _passages(t).select(
        "draft_id", "matter_id", "practice", F.col("text").alias("passage"), F.expr(FIX_KIND).alias("kind"), F.expr(FIX_TEXT).alias("span_text"),
        F.expr(SPAN_KIND).alias("span_kind"), F.expr(REPLACEMENT).alias("replacement"), F.when(F.col("variant") != 6, spans).alias("spans"),
    )


_FINAL = "case when variant = 1 then 'name' when variant = 4 then 'org' when variant = 7 then 'name' else 'quasi_identifier' end"
_SHOWN = "case when variant in (1, 7) then '[PERSON]' when variant = 4 then '[ORG]' else '[QUASI_IDENTIFIER]' end"


@query("b13_correction_check", f"""select draft_id, case when variant = 5 then 'kind must be missed or wrong' when variant = 8 then 'span_text must appear in passage' end as reason from {_NAMED} n""")
def b13(t):
    return training.valid_corrections(_corrections(t)).select("draft_id", "reason")


@query("b23_placeholder_kind", f"""select draft_id, {_FINAL} as kind, {_SHOWN} as replacement from {_NAMED} n""")
def b23(t):
    s = training.corrected_span(F.col("span_text"), F.col("span_kind"), F.col("replacement"))
    return _corrections(t).select("draft_id", s.alias("s")).select("draft_id", "s.kind", "s.replacement")


TARGETS = f"""(select draft_id, 0 as i, 'Best wishes' as text, 'location' as kind, '[LOCATION]' as replacement from {_NAMED} n where variant <> 6
   union all select draft_id, 1, client, 'name', '[PERSON]' from {_NAMED} n where variant = 8
   union all select draft_id, 2, {FIX_TEXT}, {_FINAL}, {_SHOWN} from {_NAMED} n where variant % 3 <> 0 and variant <> 5)"""


def _targets():
    return training.target_spans(F.col("spans"), F.col("kind"), F.col("span_text"), F.col("span_kind"), F.col("replacement"))


@query("b24_target_spans", f"select draft_id, text, kind, replacement from {TARGETS} x")
def b24(t):
    return S.unnest(_corrections(t), _targets(), "s", "draft_id").select("draft_id", "s.*")


@query("b25_training_rows", f"""with a as (select draft_id, string_agg('{{"text":"' || text || '","kind":"' || kind || '","replacement":"' || replacement || '"}}', ',' order by i) as s from {TARGETS} x group by draft_id)
  select n.text as passage, '{{"spans":[' || coalesce(s, '') || ']}}' as answer, {FIX_KIND} as kind, count(*) as n from {_NAMED} n left join a using (draft_id) group by all""")
def b25(t):
    policy = V.matters(t).select("practice").distinct().select("practice", F.array(F.lit("research")).alias("may_compound"), F.array(F.lit("amounts")).alias("never_compounds"))
    rows = training.training_rows(_corrections(t), policy)
    return rows.select(F.col("messages")[1]["content"].alias("passage"), F.col("messages")[2]["content"].alias("answer"), "kind").groupBy("passage", "answer", "kind").agg(F.count("*").alias("n"))


@query("f14_correction_summary", f"""select count(*) as n, count(*) filter (k = 'missed') as missed, count(*) filter (k = 'wrong') as wrong from (select {FIX_KIND} as k from {_NAMED} n) x""")
def f14(t):
    return training.correction_summary(_corrections(t))


@query("f24_retrain_plan", f"""select f as n_feedback, least(b, 200) as n_base, least(b, 200) + 4 * f as n_examples from (select count(*) as f from ({V.DRAFTS}) d) x, (select count(*) as b from conversations) y""")
def f24(t):
    base = training.base_sample(t.conversations.select(F.concat_ws("/", "conv_id", "turn").alias("key")), "key")
    return training.retrain_plan(_corrections(t).agg(F.count("*").alias("n")), base.agg(F.count("*").alias("n")))


@query("g07_seeded_sample", "select doc_id, source from documents order by md5('0/' || doc_id), doc_id limit 200")
def g07(t):
    return training.base_sample(t.documents.select("doc_id", "source"), "doc_id")


@query("i03_upsample", """select role, copy, count(*) as n from (select role, 1 as copy from conversations where role <> 'user' union all select role, unnest([1, 2, 3, 4]) from conversations where role = 'user') u group by role, copy""")
def i03(t):
    rows = t.conversations.select("conv_id", "turn", "role")
    both = training.upsample(rows.where("role = 'user'"), rows.where("role <> 'user'"))
    return both.groupBy("role", "copy").agg(F.count("*").alias("n"))


@query("b09_training_paragraphs", f"""select doc_id, count(*) as paragraphs, cast(sum(length(p)) as bigint) as chars from (select doc_id, {TRIM.format("unnest(string_split(text, chr(10)))")} as p from documents) s
  where p <> '' and len(string_split_regex(p, '\\s+')) >= 12 group by doc_id""")
def b09(t):
    p = training.training_paragraphs(t.documents, ["doc_id"], "\n")
    return p.groupBy("doc_id").agg(F.count("*").alias("paragraphs"), F.sum(F.length("paragraph")).alias("chars"))


@query("e07_pending_cases", """select d.doc_id from documents d left join labels l on l.doc_id = d.doc_id and l.quality = 1 where l.doc_id is null""")
def e07(t):
    verdicts = t.labels.select("doc_id", F.when(F.col("quality") == 1, "clean").alias("verdict"))
    return training.pending(t.documents.select("doc_id"), verdicts, "doc_id")


@query("e14_prediction_alignment", f"""select detector, count(*) as cases, count(*) filter (flag is null) as no_verdict, count(*) filter ((label = 'leak') = flag) as right_calls from ({LABELLED_SQL}) l group by detector""")
def e14(t):
    rows = labelled(t)
    cases = rows.select(F.struct("detector", "doc_id").alias("case_id"), "detector", "label")
    verdicts = rows.select(F.struct("detector", "doc_id").alias("case_id"), F.when(F.col("flag"), "leak").when(~F.col("flag"), "clean").alias("verdict"))
    joined = training.attach_verdicts(cases, verdicts, "case_id")
    return joined.groupBy("detector").agg(F.count("*").alias("cases"), F.count_if(F.col("verdict").isNull()).alias("no_verdict"), F.count_if(F.col("label") == F.col("verdict")).alias("right_calls"))


_HELD = "select distinct source from documents order by source limit 4"


@query("e09_matter_split", f"""select 'train' as part, count(*) as docs, count(distinct source) as matters from documents where source not in ({_HELD}) union all select 'held_out', count(*), count(distinct source) from documents where source in ({_HELD})""")
def e09(t):
    docs = t.documents.select(F.col("source").alias("matter_id"), "doc_id")
    held = docs.select("matter_id").distinct().orderBy("matter_id").limit(4)
    train, out = training.split_by_matter(docs, held)
    n = [F.count("*").alias("docs"), F.countDistinct("matter_id").alias("matters")]
    return train.agg(*n).select(F.lit("train").alias("part"), "*").unionByName(out.agg(*n).select(F.lit("held_out").alias("part"), "*"))
