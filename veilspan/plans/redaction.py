"""De-identification and scrubbing."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilspan.functions import patterns as P
from veilspan.functions import spans as S
from veilspan.operators import catalog, facts, redact, scrub
from veilspan.operators.detect import identifier_spans
from veilspan.plans import world as V
from veilspan.plans.base import query
from veilspan.plans.detect import LETTERS, sql_resolved

KIND = "case category when 'names' then 'name' when 'orgs' then 'org' when 'amounts' then 'amount' else 'quasi_identifier' end"
RANK = "case category when 'names' then 1 when 'orgs' then 2 when 'amounts' then 3 else 4 end"
VALUES = f"(select value, arg_min({KIND}, matter_ord * 100 + {RANK} * 10 + ord) as kind, min(matter_ord * 100 + {RANK} * 10 + ord) as place from ({V.FACTS}) f group by value)"

FACT_HITS = f"""select draft_id, cast(pos as int) as "start", cast(pos + length(value) as int) as "end", kind, value as entity from (
    select draft_id, value, kind, sum(length(piece) + length(value)) over (partition by draft_id, value order by i) - length(value) as pos from (
      select draft_id, value, kind, unnest(range(1, len(g))) as i, unnest(g[1:len(g) - 1]) as piece from (
        select draft_id, value, kind, string_split(text, value) as g from {LETTERS} d join {VALUES} v on contains(d.text, v.value)) a) b) c"""

_COMMON = ", ".join(f"'{w}'" for w in P.PARTIAL_COMMON + P.PARTIAL_TITLES)
PARTS = f"""(select value, kind, place, unnest(range(1, len(p) + 1)) as part_ord, unnest(p) as part from (
    select value, kind, place, case when kind = 'name' then [k[1], k[len(k)]] when kind = 'org' then k else [] end as p from (
      select value, kind, place, list_filter(list_transform(string_split(value, ' '), lambda x: regexp_replace(x, '^[.,&()]+|[.,&()]+$', '', 'g')), lambda x: x <> '') as k from {VALUES} v) a
    where len(k) > 1) b)"""
CLAIMS = f"""(select part, arg_min(kind, place * 100 + part_ord) as kind, arg_min(value, place * 100 + part_ord) as entity from {PARTS} p
    where length(part) >= 3 and regexp_matches(part, '^[A-Z]') and lower(part) not in ({_COMMON}) group by part)"""
OWN_CLAIMS = f"""(select matter_id, part, arg_min(p.kind, place2 * 100 + part_ord) as own_kind, arg_min(p.value, place2 * 100 + part_ord) as own_entity from
    (select matter_id, value, min({RANK} * 10 + ord) as place2 from ({V.FACTS}) f group by matter_id, value) o join {PARTS} p using (value)
    where length(part) >= 3 and regexp_matches(part, '^[A-Z]') and lower(part) not in ({_COMMON}) group by matter_id, part)"""
TOKENS = V.span_cte(LETTERS, "draft_id", "text", r"[A-Za-z0-9_]+")
PARTIAL_HITS = f"""select t.draft_id, t."start", t."end", coalesce(o.own_kind, c.kind) as kind, coalesce(o.own_entity, c.entity) as entity
    from ({TOKENS}) t join {CLAIMS} c on t.m = c.part join (select draft_id, matter_id from ({V.DRAFTS}) d) d using (draft_id)
    left join {OWN_CLAIMS} o on o.matter_id = d.matter_id and o.part = c.part"""


@query("c16_known_fact_scan", FACT_HITS)
def c16(t):
    return facts.fact_hits(V.drafts(t).select("draft_id", "text"), "draft_id", facts.fact_table(V.matters(t)))


@query("c17_partial_forms", PARTIAL_HITS)
def c17(t):
    return facts.partial_hits(V.drafts(t).select("draft_id", "matter_id", "text"), "draft_id", facts.fact_table(V.matters(t)))


@query("g02_first_claim", f"select part, kind, entity from {CLAIMS} c")
def g02(t):
    return facts.partial_table(facts.fact_table(V.matters(t)))


RULES = f"""select s.draft_id, s."start", s."end", s.kind, substr(d.text, s."start" + 1, s."end" - s."start") as entity, 2 as listed
    from ({sql_resolved(LETTERS, "draft_id")}) s join {LETTERS} d using (draft_id)"""
CANDIDATES = f"""select *, 0 as listed from ({FACT_HITS}) a union all select *, 1 as listed from ({PARTIAL_HITS}) b union all select * from ({RULES}) c"""


@query("c18_candidate_entities", f"""select draft_id, count(*) as candidates, count(distinct entity) as entities, cast(sum("start") as bigint) as starts,
    count(*) filter (kind = 'quasi_identifier') as quasi from ({CANDIDATES}) c group by draft_id""")
def c18(t):
    rows = S.unnest(_candidates(t), "candidates", "c", "draft_id").select("draft_id", "c.*")
    return rows.groupBy("draft_id").agg(
        F.count("*").alias("candidates"), F.countDistinct("entity").alias("entities"), F.sum("start").alias("starts"), F.count_if(F.col("kind") == "quasi_identifier").alias("quasi")
    )


def _candidates(t):
    d = V.drafts(t).select("draft_id", "matter_id", "text")
    read = S.computed(d, redact.with_entity(F.col("text"), identifier_spans(F.col("text"))), "rules")
    known = redact.known_candidates(d, "draft_id", facts.fact_table(V.matters(t)))
    none = F.from_json(F.lit("[]"), f"array<{redact.CANDIDATE}>")
    return read.join(known, "draft_id", "left").withColumn("candidates", F.concat(F.coalesce("known", none), "rules")).drop("known", "rules")


def sql_merge(source: str) -> str:
    """Leftmost-longest choice as a fold over the sorted candidates."""
    item = """struct_pack(s := "start", n := "start" - "end", v := kind = 'quasi_identifier', l := listed, e := "end", k := kind, t := entity)"""
    return f"""select draft_id, a.s as "start", a.e as "end", a.k as kind, a.t as entity from (
      select draft_id, unnest(list_reduce(list_sort(c), lambda acc, x: case when len(acc) > 0 and x[1].s < acc[len(acc)].e then acc else list_concat(acc, x) end, c[1][1:0])) as a
      from (select draft_id, list_transform(c, lambda y: [y]) as c from (select draft_id, list({item}) as c from ({source}) u group by draft_id) g) h) r"""


def redact_ctes(prefix: str, source: str) -> str:
    """CTEs ``{prefix}_m`` (merged), ``{prefix}_p`` (with replacement), ``{prefix}_r`` (redacted text)."""
    base = "case when kind = 'judge_flag' then 'QUASI_IDENTIFIER' else upper(kind) end"
    x = prefix
    return f"""{x}_m as materialized ({sql_merge(source)}),
    {x}_b as (select draft_id, {base} as base, min("start") as b0 from {x}_m group by 1, 2),
    {x}_e as (select m.draft_id, entity, m.base, min("start") as e0, min(b0) as b0 from (select *, {base} as base from {x}_m) m join {x}_b b on b.draft_id = m.draft_id and b.base = m.base group by 1, 2, 3),
    {x}_n as (select *, row_number() over (partition by draft_id, base order by e0) as place, count(*) over (partition by draft_id, base) as peers from {x}_e),
    {x}_l as (select draft_id, entity, arg_max(case when peers = 1 then '[' || base || ']' else '[' || base || '_' || place || ']' end, b0) as replacement from {x}_n group by 1, 2),
    {x}_p as materialized (select m.*, replacement, row_number() over (partition by m.draft_id order by "start") as i, lag("end", 1, 0) over (partition by m.draft_id order by "start") as prev,
      sum(length(replacement) - ("end" - "start")) over (partition by m.draft_id order by "start") - (length(replacement) - ("end" - "start")) as shift
      from {x}_m m join {x}_l l on l.draft_id = m.draft_id and l.entity = m.entity),
    {x}_r as materialized (select d.draft_id, coalesce(string_agg(substr(d.text, prev + 1, "start" - prev) || replacement, '' order by i) || substr(any_value(d.text), max("end") + 1), any_value(d.text)) as redacted, count(i) as removed
      from {LETTERS} d left join {x}_p p on p.draft_id = d.draft_id group by d.draft_id)"""


@query("d01_leftmost_longest", sql_merge(CANDIDATES))
def d01(t):
    merged = S.unnest(_candidates(t), S.merge_leftmost_longest(F.col("candidates")), "s", "draft_id")
    return merged.select("draft_id", "s.start", "s.end", "s.kind", "s.entity")


@query("d02_placeholders", f"""with {redact_ctes("x", CANDIDATES)} select draft_id, "start", "end", kind, replacement from x_p""")
def d02(t):
    return S.unnest(redact.redact(_candidates(t)), "spans", "s", "draft_id").select("draft_id", "s.*")


@query("g05_entity_numbering", f"""with {redact_ctes("x", CANDIDATES)} select replacement, count(*) as spans, count(distinct draft_id) as drafts from x_p group by replacement""")
def g05(t):
    spans = S.unnest(redact.redact(_candidates(t)), "spans", "s", "draft_id").select("draft_id", "s.*")
    return spans.groupBy("replacement").agg(F.count("*").alias("spans"), F.countDistinct("draft_id").alias("drafts"))


@query("d03_replaced_text", f"""with {redact_ctes("x", CANDIDATES)} select draft_id, redacted, removed from x_r""")
def d03(t):
    return redact.redact(_candidates(t)).select("draft_id", "redacted", F.size("spans").cast("bigint").alias("removed"))


EVIDENCE = "case variant when 1 then ' client, [NAME_2], settled ' when 3 then 'paid [AMOUNT] in' when 2 then 'not in the text' when 6 then 'Recall [QUASI' when 8 then 'Someone wrote' end"
VERDICTS = f"select draft_id, label as verdict, {EVIDENCE} as evidence, 'prompt_judge' as judge from ({V.DRAFTS}) v where variant <> 5"


def _verdicts(t):
    return V.drafts(t).where("variant <> 5").select("draft_id", F.col("label").alias("verdict"), F.expr(EVIDENCE).alias("evidence"), F.lit("prompt_judge").alias("judge"))


RANGES = """q as materialized (select r.draft_id, strpos(redacted, trim(evidence)) - 1 as p0, strpos(redacted, trim(evidence)) - 1 + length(trim(evidence)) as p1
      from x_r r join verdicts v using (draft_id) where verdict = 'leak' and trim(evidence) <> '' and contains(redacted, trim(evidence))),
    total as (select draft_id, sum(length(replacement) - ("end" - "start")) as shift from x_p group by draft_id),
    lo as (select q.draft_id, arg_min(case when p0 < "start" + shift then p0 - shift else "start" end, i) as a from q join x_p p using (draft_id) where p0 < "start" + shift + length(replacement) group by q.draft_id),
    hi as (select q.draft_id, arg_min(case when p1 <= "start" + shift then p1 - shift else "end" end, i) as b from q join x_p p using (draft_id) where p1 <= "start" + shift + length(replacement) group by q.draft_id),
    flagged as materialized (select q.draft_id, cast(coalesce(a, p0 - coalesce(shift, 0)) as int) as "start", cast(coalesce(b, p1 - coalesce(shift, 0)) as int) as "end"
      from q left join total using (draft_id) left join lo using (draft_id) left join hi using (draft_id))"""


@query("d04_map_back", f"""with verdicts as ({VERDICTS}), {redact_ctes("x", CANDIDATES)}, {RANGES} select * from flagged""")
def d04(t):
    done = redact.redact(_candidates(t)).join(_verdicts(t), "draft_id").where("verdict = 'leak'")
    at = F.instr(F.col("redacted"), F.trim("evidence")) - 1
    mapped = done.where((F.trim("evidence") != "") & (at >= 0)).select("draft_id", S.to_original(F.col("spans"), at, at + F.length(F.trim("evidence"))).alias("r"))
    return mapped.select("draft_id", "r.start", "r.end")


_SECOND = """select c.draft_id, c."start", c."end", c.kind, c.entity, c.listed from candidates c union all
    select f.draft_id, f."start", f."end", 'judge_flag', substr(d.text, f."start" + 1, f."end" - f."start"), 3 from flagged f join {letters} d using (draft_id)""".format(letters=LETTERS)


@query("d05_verify_and_redact", f"""with verdicts as ({VERDICTS}), candidates as materialized ({CANDIDATES}), {redact_ctes("x", "select * from candidates")}, {RANGES}, {redact_ctes("y", _SECOND)}
    select r.draft_id, redacted, removed, verdict as residual_verdict, case when verdict is not null then judge end as judge from y_r r left join verdicts v using (draft_id)""")
def d05(t):
    out = redact.deidentify(V.drafts(t).select("draft_id", "matter_id", "text"), "draft_id", facts.fact_table(V.matters(t)), _verdicts(t))
    return out.select("draft_id", "redacted", F.col("removed").cast("bigint").alias("removed"), "residual_verdict", "judge")


# verdicts on the second redaction; some texts have none, and keep the first one
AGAIN = f"select draft_id, case when draft_id % 3 = 0 then 'leak' else 'clean' end as verdict from ({V.DRAFTS}) v where draft_id % 4 <> 0"


@query("d05_second_verdict", f"""with verdicts as ({VERDICTS}), again as ({AGAIN}), candidates as materialized ({CANDIDATES}), {redact_ctes("x", "select * from candidates")}, {RANGES}, {redact_ctes("y", _SECOND)}
    select r.draft_id, removed, case when f.draft_id is not null then coalesce(a.verdict, v.verdict) else v.verdict end as residual_verdict, case when v.verdict is not null then judge end as judge
    from y_r r left join verdicts v using (draft_id) left join flagged f using (draft_id) left join again a using (draft_id)""")
def d05_again(t):
    second = V.drafts(t).where("draft_id % 4 <> 0").select("draft_id", F.when(F.col("draft_id") % 3 == 0, "leak").otherwise("clean").alias("verdict"))
    out = redact.deidentify(V.drafts(t).select("draft_id", "matter_id", "text"), "draft_id", facts.fact_table(V.matters(t)), _verdicts(t), second_verdicts=second)
    return out.select("draft_id", F.col("removed").cast("bigint").alias("removed"), "residual_verdict", "judge")


# an external detector: one kind of finding comes with offsets, the other as text alone
_OUTSIDE = f"""select m.draft_id, m."start", m."end", 'org' as kind, substr(d.text, m."start" + 1, m."end" - m."start") as entity, 3 as listed from ({V.MODEL_SPANS}) m join {LETTERS} d using (draft_id) where m.detector = 'tuned'
    union all select draft_id, cast(pos as int), cast(pos + length(value) as int), 'name', value, 3 from (
      select draft_id, value, sum(length(piece) + length(value)) over (partition by draft_id order by i) - length(value) as pos from (
        select draft_id, value, unnest(range(1, len(g))) as i, unnest(g[1:len(g) - 1]) as piece from (
          select draft_id, value, string_split(text, value) as g from {LETTERS} d join (select o_orderkey as draft_id, {V.first_name("o_custkey")} as value from orders where o_orderkey % 3 = 1) o using (draft_id)) a) b) c"""


@query("l02_external_spans", f"""with {redact_ctes("x", f"{CANDIDATES} union all select * from ({_OUTSIDE}) x")} select draft_id, redacted, removed from x_r""")
def l02(t):
    letters = V.drafts(t).select("draft_id", "matter_id", "text")
    placed = V.model_spans(t).where("detector = 'tuned'").join(letters, "draft_id").select(
        "draft_id", "start", "end", F.lit("org").alias("kind"), F.col("text").substr(F.col("start") + 1, F.col("end") - F.col("start")).alias("entity")
    )
    named = t.sql(f"select o_orderkey as draft_id, {V.first_name('o_custkey')} as span_text, 'name' as kind from {{orders}} where o_orderkey % 3 = 1", orders=t.orders)
    outside = placed.unionByName(redact.with_offsets(named, letters, "draft_id"))
    out = redact.deidentify(letters, "draft_id", facts.fact_table(V.matters(t)), extra_spans=outside)
    return out.select("draft_id", "redacted", F.col("removed").cast("bigint").alias("removed"))


@query("d06_identity_block", f"""select matter_id, 'M1: Client ' || client || ' (' || org_1 || ') v. the other side. Matter type: general. Confidential: $' || ltrim(amount_1, '$') || '.' as block from ({V.MATTERS}) m""")
def d06(t):
    return V.matters(t).select("matter_id", redact.identity_block(F.col("matter_id"), F.col("client"), F.col("facts")).alias("block"))


@query("e18_beneficiary_placeholder", f"""with {redact_ctes("x", CANDIDATES)}, who as (select draft_id, client from ({V.DRAFTS}) d join ({V.MATTERS}) m on m.matter_id = d.matter_id),
    s as (select p.draft_id, p."start", p.kind, p.replacement, lower(substr(d.text, p."start" + 1, p."end" - p."start")) as o, lower(client) as n from x_p p join {LETTERS} d using (draft_id) join who using (draft_id))
    select draft_id, arg_min(replacement, case when o = n then 0 else 1000000 end + "start") as placeholder from s where o = n or (kind = 'name' and (contains(o, n) or contains(n, o))) group by draft_id""")
def e18(t):
    who = V.matters(t).select("matter_id", F.col("client").alias("beneficiary"))
    spans = S.unnest(redact.redact(_candidates(t)), "spans", "s", "draft_id", "matter_id", "text")
    rows = spans.join(who, "matter_id").select(
        "draft_id", "s.kind", "s.start", "s.replacement", "beneficiary", F.col("text").substr(F.col("s.start") + 1, F.col("s.end") - F.col("s.start")).alias("original")
    )
    return redact.beneficiary_placeholder(rows, "draft_id")


@query("f05_batch_summary", f"""with verdicts as ({VERDICTS}), candidates as materialized ({CANDIDATES}), {redact_ctes("x", "select * from candidates")}, {RANGES}, {redact_ctes("y", _SECOND)}
    select 'docs' as metric, '' as kind, count(*) as n from y_r union all select 'residual_leaks', '', count(*) from verdicts where verdict = 'leak'
    union all select 'spans_removed', kind, count(*) from y_p group by kind""")
def f05(t):
    out = redact.deidentify(V.drafts(t).select("draft_id", "matter_id", "text"), "draft_id", facts.fact_table(V.matters(t)), _verdicts(t))
    return redact.batch_summary(out)


# --- scrub -----------------------------------------------------------------------

SCRUBBED_KEYS = "draft_id, matter_id, practice, text"


def _requests(t):
    practice = V.matters(t).select("matter_id", "practice")
    return V.drafts(t).select("draft_id", "matter_id", "text").join(practice, "matter_id")


FACT_LISTS = f"""(select matter_id, practice, name_1, name_2, org_1, amount_1, detail_1, detail_2 from ({V.MATTERS}) m)"""
_CUT = {
    "exhibit": (r"\bExhibit\s+[A-Za-z0-9]+\b", "the exhibit"),
    "section": (r"\bSection\s+\d+(?:\.\d+)*\b", "the relevant section"),
    "date": (rf"\b(?:{P.MONTHS})\.?\s+\d{{1,2}}(?:st|nd|rd|th)?(?:,?\s+\d{{4}})?\b|\b\d{{1,2}}[/-]\d{{1,2}}(?:[/-]\d{{2,4}})?\b", "[date]"),
    "amount": (r"(?i)\$\s?\d[\d,]*(?:\.\d+)?\s?(?:million|billion|M|K)?\b", "[amount]"),
    "proper_noun": (r"\b[A-Z][a-zA-Z]*(?:\s+[A-Z][a-zA-Z]*){1,3}\b", "the counterparty"),
}


def _literal_step(text: str, removed: str, literals: list[str], placeholder: str) -> tuple[str, str]:
    for v in literals:
        n = f"((length({text}) - length(replace({text}, {v}, ''))) // length({v}))"
        text, removed = f"replace({text}, {v}, '{placeholder}')", f"{removed} + {n}"
    return text, removed


def scrub_sql(letters: str) -> str:
    """The chain as one CTE per step; literals of a step are ordered longest first beforehand."""
    steps = [f"s0 as (select d.draft_id, text as t, 0 as n, m.* from {letters} d join {FACT_LISTS} m using (matter_id))"]
    lists = [
        ("[name_1, name_2, org_1]", "the counterparty"), ("[amount_1]", "[amount]"), ("[detail_1, detail_2]", "[redacted detail]"),
        ("""list_filter(list_distinct(flatten(list_transform([name_1, name_2, org_1, detail_1, detail_2], lambda v: regexp_extract_all(v, '\\b[A-Z][a-zA-Z]{2,}\\b')))), lambda k: k <> upper(k) and k not in ('Inc', 'Corp', 'Ltd', 'Co'))""", "Counterparty"),
    ]
    for i, (values, placeholder) in enumerate(lists):
        # longest first, equal lengths alphabetically; each element is [text, literal, count] as strings
        ordered = f"list_transform(list_sort(list_transform(list_distinct({values}), lambda v: struct_pack(k := -length(v), v := v))), lambda z: z.v)"
        fold = f"""list_reduce(list_transform({ordered}, lambda v: ['', v, '0']), lambda a, x: [replace(a[1], x[2], '{placeholder}'), '', cast(cast(a[3] as int) + (length(a[1]) - length(replace(a[1], x[2], ''))) // length(x[2]) as varchar)], [t, '', '0'])"""
        steps.append(f"f{i} as (select *, {fold} as f from s{i})")
        steps.append(f"s{i + 1} as (select * exclude (t, n, f), f[1] as t, n + cast(f[3] as int) as n from f{i})")
    last = len(lists)
    for name, (pattern, placeholder) in _CUT.items():
        steps.append(f"s{last + 1} as (select * exclude (t, n), regexp_replace(t, '{pattern}', '{placeholder}', 'g') as t, n + len(regexp_extract_all(t, '{pattern}')) as n from s{last})")
        last += 1
    steps.append(f"scrubbed as materialized (select draft_id, matter_id, regexp_replace(t, '(?i)\\bthe\\s+the\\s+counterparty\\b', 'the counterparty', 'g') as scrubbed, cast(n as int) as removed from s{last})")
    return ", ".join(steps)


DRAFTS_SQL = f"(select draft_id, matter_id, text, variant from ({V.DRAFTS}) d)"


@query("d15_scrub_chain", f"with {scrub_sql(DRAFTS_SQL)} select draft_id, scrubbed, removed from scrubbed")
def d15(t):
    return scrub.scrub(_requests(t), V.matters(t)).select("draft_id", "scrubbed", "removed")


def _cut(name: str, op: str):
    pattern, placeholder = _CUT[op]

    @query(name, f"select draft_id, regexp_replace(text, '{pattern}', '{placeholder}', 'g') as scrubbed, cast(len(regexp_extract_all(text, '{pattern}')) as int) as removed from ({V.DRAFTS}) d")
    def run(t):
        text, n = scrub.scrub_pattern(F.col("text"), op)
        return V.drafts(t).select("draft_id", text.alias("scrubbed"), n.alias("removed"))


for _name, _op in (("d09_exhibit_scrub", "exhibit"), ("d10_section_scrub", "section"), ("d11_date_scrub", "date"), ("d12_amount_scrub", "amount"), ("d13_proper_noun_scrub", "proper_noun")):
    _cut(_name, _op)


@query("d07_literal_replacement", f"""with {scrub_sql(DRAFTS_SQL)} select draft_id, t as text, cast(n as int) as removed from s1""")
def d07(t):
    known = V.drafts(t).select("draft_id", "matter_id", "text").join(V.matters(t).select("matter_id", "facts"), "matter_id")
    literals = F.concat(F.col("facts")["names"], F.col("facts")["orgs"])
    s = scrub.replace_literals(F.struct(F.col("text").alias("text"), F.lit(0).alias("n")), literals, "the counterparty")
    return known.select("draft_id", s.alias("s")).select("draft_id", "s.text", F.col("s.n").alias("removed"))


@query("d08_proper_tokens", f"""select matter_id, unnest(list_filter(list_distinct(flatten(list_transform([name_1, name_2, org_1, detail_1, detail_2], lambda v: regexp_extract_all(v, '\\b[A-Z][a-zA-Z]{{2,}}\\b')))),
    lambda k: k <> upper(k) and k not in ('Inc', 'Corp', 'Ltd', 'Co'))) as token from {FACT_LISTS} m""")
def d08(t):
    f = F.col("facts")
    tokens = scrub.proper_tokens(F.concat(f["names"], f["orgs"], f["distinctive"]))
    return S.unnest(V.matters(t), tokens, "token", "matter_id")


@query("d14_article_cleanup", f"""select draft_id, regexp_replace(replace(text, 'file', 'the The  counterparty'), '(?i)\\bthe\\s+the\\s+counterparty\\b', 'the counterparty', 'g') as tidy from ({V.DRAFTS}) d""")
def d14(t):
    return V.drafts(t).select("draft_id", scrub.tidy_articles(F.replace("text", F.lit("file"), F.lit("the The  counterparty"))).alias("tidy"))


@query("h05_longest_first", f"""select matter_id, array_to_string(list_transform(list_sort(list_transform([name_1, name_2, org_1, detail_1, detail_2], lambda v: struct_pack(k := -length(v), v := v))), lambda z: z.v), '|') as ordered from {FACT_LISTS} m""")
def h05(t):
    f = F.col("facts")
    return V.matters(t).select("matter_id", F.array_join(scrub.longest_first(F.concat(f["names"], f["orgs"], f["distinctive"])), "|").alias("ordered"))


_PARTS = f"(case variant when 1 then ['similar', 'settled'] when 7 then ['maple grove', 'nowhere'] when 9 then ['harbor crane', 'exhibit b'] else ['dear'] end)"


PARTS_EXPR = "case variant when 1 then array('similar', 'settled') when 7 then array('maple grove', 'nowhere') when 9 then array('harbor crane', 'exhibit b') else array('dear') end"


@query("d17_survival", f"""with {scrub_sql(DRAFTS_SQL)} select draft_id, len(list_filter({_PARTS}, lambda p: not contains(lower(scrubbed), p))) = 0 as survives from scrubbed join {DRAFTS_SQL} d using (draft_id)""")
def d17(t):
    parts = F.expr(PARTS_EXPR)
    done = scrub.scrub(_requests(t).join(V.drafts(t).select("draft_id", "variant"), "draft_id"), V.matters(t))
    return done.select("draft_id", scrub.survives(F.col("scrubbed"), parts).alias("survives"))


@query("b15_scrub_request_errors", f"""select draft_id, case when p = 'unknown' then 'unknown practice unknown' when m not in (select matter_id from ({V.MATTERS}) m) then 'unknown matter_id ' || m end as error from (
    select draft_id, case when variant = 4 then 'unknown' else 'litigation' end as p, case when variant = 5 then 'X' || matter_id else matter_id end as m from ({V.DRAFTS}) d) s""")
def b15(t):
    rows = V.drafts(t).select(
        "draft_id", "text", F.when(F.col("variant") == 4, "unknown").otherwise("litigation").alias("practice"),
        F.when(F.col("variant") == 5, F.concat(F.lit("X"), "matter_id")).otherwise(F.col("matter_id")).alias("matter_id"),
    )
    return scrub.scrub(rows, V.matters(t), V.matters(t)).select("draft_id", "error")
