"""Span detectors and the small projections around them."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilspan.functions import amounts as A
from veilspan.functions import patterns as P
from veilspan.functions import spans as S
from veilspan.functions import text as X
from veilspan.operators import detect, facts, redact
from veilspan.plans import world as V
from veilspan.plans.base import query

TEXT = V.ASCII.format("text")
DOCS = f"(select doc_id, {TEXT} as text from documents)"
LETTERS = f"(select draft_id, text from ({V.DRAFTS}))"
MONTHS = P.MONTHS
RUN = r"[A-Z][a-z']+(?:\s+[A-Z][a-z']+)"

# the same patterns for an engine without look-around, on text where accented letters read as "_"
SQL_PATTERNS = {
    "email": [r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"],
    "url": [r"""(?i)\b(?:https?://|www\.)[^\s<>"')]+"""],
    "ssn": [r"\b\d{3}-\d{2}-\d{4}\b"],
    "phone": [
        r"(?:\+1[-.\s]?)?\(?\d{3}\)?[-.\s]\d{3}[-.\s]\d{4}\b",
        r"\+\d{1,3}[-.\s]?\d{1,4}(?:[-.\s]\d{2,4}){2,3}\b",
    ],
    "date": [
        r"\b\d{4}-\d{2}-\d{2}\b", r"\b\d{1,2}/\d{1,2}/\d{2,4}\b",
        rf"\b(?:{MONTHS})\.?\s+\d{{1,2}},?\s+\d{{4}}\b", rf"\b\d{{1,2}}\s+(?:{MONTHS})\.?,?\s+\d{{4}}\b",
    ],
    "amount": [
        r"\$\s?\d{1,3}(?:,\d{3})*(?:\.\d+)?(?:\s?[kKmMbB]\b)?", r"(?i)\bUSD\s?\d{1,3}(?:,\d{3})*(?:\.\d+)?\b",
        r"(?i)\b\d{1,3}(?:,\d{3})*\s+(?:thousand|million|billion)\s+dollars\b",
    ],
    "address": [
        rf"\b\d{{1,6}}\s+(?:[A-Z][A-Za-z0-9.'-]*\s+){{1,4}}(?:{P.STREET_SUFFIX})\b(?:,?\s+(?:Suite|Ste\.?|Apt\.?|Unit|#)\s*\w+)?",
    ],
    "a_number": [r"\bA[-\s]?(?:\d{2,3}[-\s]?\d{3}[-\s]?\d{3,4}|\d{8,9})\b"],
    "receipt": [r"(?i)\b(?:EAC|WAC|LIN|SRC|NBC|MSC|IOE|YSC)[-\s]?\d{10}\b"],
    "org": [rf"\b(?:[A-Z][A-Za-z&.'-]*\s+){{1,5}}(?:{P.ORG_SUFFIX})\b"],
    "titled": [rf"\b(?:Mr|Ms|Mrs|Dr|Prof)\.?\s+{RUN}{{0,2}}\b"],
    "salutation": [rf"\bDear\s+{RUN}{{0,2}}\s*[,:]"],
    "bare": [rf"\b{RUN}{{1,2}}\b"],
}
STOP = ", ".join(f"'{w}'" for w in P.NAME_STOPWORDS)


def sql_spans(source: str, key: str, kind: str) -> str:
    """Rows ``key, start, end, kind, listed, i`` of one detector in SQL."""
    if kind == "passport":
        window = span_window(source, key)
        return window
    if kind in ("titled", "salutation", "bare"):
        raw = V.span_cte(source, key, "text", SQL_PATTERNS[kind][0], "name", {"titled": 0, "salutation": 1, "bare": 2}[kind])
        if kind == "salutation":
            lead = r"length(regexp_extract(m, '^Dear\s+'))"
            name = rf"length(regexp_extract(m, '^Dear\s+({RUN.replace(chr(39), chr(39) * 2)}{{0,2}})', 1))"
            return f"""select {key}, "start" + {lead} as "start", "start" + {lead} + {name} as "end", kind, listed, i from ({raw}) s"""
        if kind == "bare":
            return f"""select {key}, "start", "end", kind, listed, i from ({raw}) s
              where not list_has_any(string_split_regex(m, '\\s+'), [{STOP}])
              and not (case when regexp_replace(gap, '\\s+$', '') = '' then "start" = length(gap) else regexp_matches(regexp_replace(gap, '\\s+$', ''), '[.!?]$') end)"""
        return f'select {key}, "start", "end", kind, listed, i from ({raw}) s'
    parts = [V.span_cte(source, key, "text", p, kind, n) for n, p in enumerate(SQL_PATTERNS[kind])]
    return " union all ".join(f'select {key}, "start", "end", kind, listed, i from ({p}) s{n}' for n, p in enumerate(parts))


def span_window(source: str, key: str) -> str:
    contexts = V.span_cte(source, key, "text", "(?i)passport")
    windows = f"""(select c.{key} || '#' || c.i as wkey, c.{key}, c.i, c."end" as w_at, substr(t.text, c."end" + 1, 29) as text from ({contexts}) c join {source} t using ({key}))"""
    tokens = V.span_cte(windows, "wkey", "text", r"\b[A-Za-z0-9]{6,9}\b")
    return f"""select {key}, "start", "end", 'passport' as kind, 0 as listed, i from (
      select w.{key}, w.i, w.w_at + k."start" as "start", w.w_at + k."end" as "end", row_number() over (partition by k.wkey order by k.i) as place
      from ({tokens}) k join {windows} w using (wkey) where k."start" <= 20 and regexp_matches(k.m, '[0-9]')) x where place = 1"""


def sql_found(source: str, key: str, kind: str) -> str:
    return f"""select s.{key}, s."start", s."end", substr(t.text, s."start" + 1, s."end" - s."start") as span_text
      from ({sql_spans(source, key, kind)}) s join {source} t using ({key})"""


def found(df, key, spans, text="text"):
    return S.unnest(df, spans, "s", key, text).select(
        key, "s.start", "s.end", F.col(text).substr(F.col("s.start") + 1, F.col("s.end") - F.col("s.start")).alias("span_text")
    )


def _register(name, kind, source, key, load, build, sql_kind=None):
    @query(name, sql_found(source, key, sql_kind or kind))
    def run(t):
        return found(load(t), key, build(F.col("text")))


def _docs(t):
    return t.documents.select("doc_id", "text")


for _name, _kind in (("c01_email", "email"), ("c04_phone", "phone")):
    _register(_name, _kind, "(select doc_id, text from documents)", "doc_id", _docs, lambda c, k=_kind: detect.kind_spans(c, k))
_register(
    "c02_url", "url", "(select page_id, html as text from pages)", "page_id",
    lambda t: t.pages.select("page_id", F.col("html").alias("text")), lambda c: detect.kind_spans(c, "url"),
)
for _name, _kind in (
    ("c03_ssn", "ssn"), ("c05_date", "date"), ("c06_amount", "amount"), ("c07_address", "address"), ("c08_a_number", "a_number"),
    ("c09_receipt", "receipt"), ("c10_passport", "passport"), ("c14_org", "org"),
):
    _register(_name, _kind, LETTERS, "draft_id", V.drafts, lambda c, k=_kind: detect.kind_spans(c, k))
_register("c11_titled_name", "titled", LETTERS, "draft_id", V.drafts, detect.titled_names)
_register("c12_salutation_name", "salutation", LETTERS, "draft_id", V.drafts, detect.salutation_names)


@query("c13_bare_name", f"""select s.doc_id, s."start", s."end", substr(t.text, s."start" + 1, s."end" - s."start") as span_text
  from ({sql_spans(DOCS, "doc_id", "bare")}) s join documents t using (doc_id)""")
def c13(t):
    return found(_docs(t), "doc_id", detect.bare_names(F.col("text")))


ALL_KINDS = ("email", "url", "ssn", "phone", "date", "amount", "address", "a_number", "receipt", "passport", "org", "titled", "salutation", "bare")
RANKS = "[" + ", ".join(f"'{k}'" for k in P.KIND_PRIORITY) + "]"


def sql_candidates(source: str, key: str) -> str:
    return " union all ".join(f"select * from ({sql_spans(source, key, k)}) u{i}" for i, k in enumerate(ALL_KINDS))


def sql_resolved(source: str, key: str) -> str:
    """Greedy choice by kind priority, then length, as a fold over the sorted candidates."""
    item = """struct_pack(r := list_position({ranks}, kind), n := "start" - "end", l := listed, s := "start", e := "end", k := kind)""".format(ranks=RANKS)
    return f"""select {key}, a.s as "start", a.e as "end", a.k as kind from (
      select {key}, unnest(list_reduce(list_sort(c), lambda acc, x: case when len(list_filter(acc, lambda q: x[1].s < q.e and x[1].e > q.s)) > 0 then acc else list_concat(acc, x) end, c[1][1:0])) as a
      from (select {key}, list_transform(c, lambda y: [y]) as c from (select {key}, list({item}) as c from ({sql_candidates(source, key)}) u group by {key}) g) h) r"""


@query("c15_priority_resolution", sql_resolved(LETTERS, "draft_id"))
def c15(t):
    return S.unnest(V.drafts(t), detect.identifier_spans(F.col("text")), "s", "draft_id").select("draft_id", "s.start", "s.end", "s.kind")


@query("c15_document_identifiers", f"""select kind, count(*) as spans, count(distinct doc_id) as docs, cast(sum("start") as bigint) as starts, cast(sum("end" - "start") as bigint) as chars
  from ({sql_resolved(DOCS, "doc_id")}) s group by kind""")
def c15_docs(t):
    hits = S.unnest(_docs(t), detect.identifier_spans(F.col("text")), "s", "doc_id").select("doc_id", "s.*")
    return hits.groupBy("kind").agg(
        F.count("*").alias("spans"), F.countDistinct("doc_id").alias("docs"), F.sum("start").alias("starts"), F.sum(F.col("end") - F.col("start")).alias("chars")
    )


@query("i01_candidate_union", f"""select kind, count(*) as candidates, count(distinct draft_id) as drafts from ({sql_candidates(LETTERS, "draft_id")}) c group by kind""")
def i01(t):
    hits = S.unnest(V.drafts(t), detect.candidate_spans(F.col("text")), "s", "draft_id").select("draft_id", "s.kind")
    return hits.groupBy("kind").agg(F.count("*").alias("candidates"), F.countDistinct("draft_id").alias("drafts"))


MARKERS = ["the of", "token = ", "password", "ein der", "exhibit b", "418,250"]
_MARKS = ", ".join(f"'{m}'" for m in MARKERS)


@query("c21_literal_markers", f"""select doc_id, marker from (select doc_id, unnest(list_filter([{_MARKS}], lambda m: contains(lower(text), m))) as marker from documents) s""")
def c21(t):
    return S.unnest(_docs(t), detect.marker_hits(F.col("text"), MARKERS), "marker", "doc_id")


@query("i02_ordered_dedupe", """select conv_id, turn, list_aggregate(list_transform(list_filter(range(1, len(w) + 1), lambda i: list_position(w, w[i]) = i), lambda i: w[i]), 'string_agg', ' ') as kept
  from (select conv_id, turn, list_transform(regexp_extract_all(text, '[A-Za-z0-9'']+'), lambda x: lower(x)) as w from conversations) s where len(w) > 0""")
def i02(t):
    w = X.words(F.col("text"))
    return t.conversations.select("conv_id", "turn", w.alias("w")).where(F.size("w") > 0).select("conv_id", "turn", F.array_join(F.array_distinct("w"), " ").alias("kept"))


@query("i04_kind_sets", f"""with f as (select draft_id, list_sort(list(distinct kind)) as kinds from ({sql_resolved(LETTERS, "draft_id")}) s group by draft_id)
  select draft_id, array_to_string(list_filter(kinds, lambda k: list_contains(['name', 'org', 'date'], k)), ',') as both_sets,
    array_to_string(list_filter(kinds, lambda k: not list_contains(['name', 'org', 'date'], k)), ',') as extra,
    array_to_string(list_filter(['date', 'name', 'org'], lambda k: not list_contains(kinds, k)), ',') as absent from f""")
def i04(t):
    kinds = F.array_sort(F.array_distinct(detect.identifier_spans(F.col("text"))["kind"]))
    want = F.array(F.lit("date"), F.lit("name"), F.lit("org"))
    return V.drafts(t).select("draft_id", kinds.alias("kinds")).select(
        "draft_id", F.array_join(F.array_intersect("kinds", want), ",").alias("both_sets"), F.array_join(F.array_except("kinds", want), ",").alias("extra"),
        F.array_join(F.array_except(want, "kinds"), ",").alias("absent"),
    )


# --- amounts and small projections ---------------------------------------------

RAW_AMOUNT = "case when o_orderkey % 4 = 0 then '$' || {f} || '.00' when o_orderkey % 4 = 1 then '$' || {f} when o_orderkey % 4 = 2 then 'about USD ' || cast(cast(floor(o_totalprice) as bigint) * 1000 as string) else 'none given' end"
_SPARK_RAW = RAW_AMOUNT.format(f="format_number(cast(floor(o_totalprice) as bigint), 0)")
_DUCK_RAW = RAW_AMOUNT.format(f="format('{:,}', cast(floor(o_totalprice) as bigint))")


@query("b06_amount_value", f"""select o_orderkey, raw, cast(nullif(regexp_replace(raw, '[^0-9]', '', 'g'), '') as bigint) as amount from (select o_orderkey, {_DUCK_RAW} as raw from orders) s""")
def b06(t):
    rows = t.sql(f"select o_orderkey, {_SPARK_RAW} as raw from {{orders}}", orders=t.orders)
    return rows.select("o_orderkey", "raw", A.amount_value(F.col("raw")).cast("bigint").alias("amount"))


@query("b07_amount_variants", f"""with a as (select draft_id, v, row_number() over () as rn from (select o_orderkey as draft_id, cast(floor(o_totalprice / 1000) as bigint) * case when o_orderkey % 3 = 0 then 100000 when o_orderkey % 3 = 1 then 1000 else 777 end as v from orders) s)
  select draft_id, 'grouped' as form, format('{{:,}}', v) as key from a union all select draft_id, 'digits', cast(v as string) from a
  union all select draft_id, 'kilo', cast(v // 1000 as string) from a where v % 1000 = 0 union all select draft_id, 'thousand', cast(v // 1000 as string) from a where v % 1000 = 0
  union all select draft_id, 'million', case when (v // 100000) % 10 = 0 then cast(v // 1000000 as string) else cast(v // 1000000 as string) || '.' || cast((v // 100000) % 10 as string) end from a where v >= 1000000 and v % 100000 = 0""")
def b07(t):
    scale = F.when(F.col("o_orderkey") % 3 == 0, 100000).when(F.col("o_orderkey") % 3 == 1, 1000).otherwise(777)
    raw = F.concat(F.lit("$"), (F.floor(F.col("o_totalprice") / 1000) * scale).cast("string"))
    rows = S.unnest(t.orders, A.variants(raw), "v", F.col("o_orderkey").alias("draft_id"))
    return rows.select("draft_id", "v.form", "v.key")


@query("b08_paragraphs", """select doc_id, count(*) as paragraphs, cast(sum(length(p)) as bigint) as chars, max(length(p)) as longest
  from (select doc_id, regexp_replace(unnest(string_split(text, chr(10))), '^\\s+|\\s+$', '', 'g') as p from documents) s where p <> '' group by doc_id""")
def b08(t):
    p = S.unnest(_docs(t), X.paragraphs(F.col("text"), "\n"), "p", "doc_id")
    return p.groupBy("doc_id").agg(F.count("*").alias("paragraphs"), F.sum(F.length("p")).alias("chars"), F.max(F.length("p")).alias("longest"))


@query("b10_category_kind", """select event_id, case event_type || 's' when 'names' then 'name' when 'orgs' then 'org' else regexp_replace(event_type || 's', '(.)s$', '\\1') end as kind,
  regexp_replace(event_type, '(.)s$', '\\1') as bare from events""")
def b10(t):
    return t.events.select("event_id", facts.kind_of(F.concat("event_type", F.lit("s"))).alias("kind"), facts.kind_of(F.col("event_type")).alias("bare"))


CLUE_SQL = rf"""case when regexp_matches(t, '\b(prize|award|medal|honou?r|fellowship|won|wins|winning)\b') then 'accomplishment'
  when regexp_matches(t, '\b(chair|founder|founded|ceo|director|head|lead|led|principal|professor|chief)\b') then 'job title'
  when regexp_matches(t, '\b(published|paper|journal|book|article|patent)\b') then 'publication'
  when regexp_matches(t, '\b(featured|profiled|interview|press|magazine|coverage)\b') then 'press coverage'
  when regexp_matches(t, '\b(youngest|first|only|oldest|record)\b') then 'accomplishment' else 'detail' end"""


@query("b22_clue_label", rf"""select doc_id, {CLUE_SQL} as label, case doc_id % 3 when 0 then 'place' when 1 then {CLUE_SQL} else 'job title' end as answered
  from (select doc_id, source, lower({V.ASCII.format("text")}) || case doc_id % 7 when 0 then ' won' when 1 then ' founder' when 2 then ' patent' when 3 then ' press' when 4 then ' oldest' else '' end as t from documents) s""")
def b22(t):
    tail = F.expr("case doc_id % 7 when 0 then ' won' when 1 then ' founder' when 2 then ' patent' when 3 then ' press' when 4 then ' oldest' else '' end")
    # a stored answer counts if it is on the closed list, whatever stands around it
    stored = F.expr("case doc_id % 3 when 0 then ' Place.' when 1 then 'a secret' else '\"job title\"' end")
    clue = F.concat("text", tail)
    return t.documents.select("doc_id", redact.clue_label(clue).alias("label"), redact.clue_label(clue, stored).alias("answered"))


@query("b27_procedure_steps", f"""select matter_id, unnest(regexp_extract_all(text, '(?m)^(\\d+)\\.\\s+(.+)$', 2)) as step from ({V.NOTES}) n""")
def b27(t):
    from veilspan.operators.scrub import procedure_steps

    return S.unnest(V.notes(t), procedure_steps(F.col("text")), "step", "matter_id")


@query("b28_query_keywords", """select conv_id, turn, case when len(k) > 0 then array_to_string(k, ' ') else text end as keywords
  from (select conv_id, turn, text, list_filter(string_split_regex(text, '\\s+'), lambda w: length(w) > 2) as k from conversations) s""")
def b28(t):
    from veilspan.operators.access import keywords

    return t.conversations.select("conv_id", "turn", F.array_join(keywords(F.col("text")), " ").alias("keywords"))


@query("c19_occurrence_offsets", """with f as (select doc_id, needle, string_split(text, needle) as g from (select doc_id, text, unnest(['the', 'er', 'ou']) as needle from documents) d where contains(text, needle)),
  o as (select doc_id, needle, g, unnest(range(1, len(g))) as i, unnest(g[1:len(g) - 1]) as piece from f),
  p as (select doc_id, needle, cast(sum(length(piece) + length(needle)) over (partition by doc_id, needle order by i) - length(needle) as int) as pos from o)
  select doc_id, needle, count(*) as hits, min(pos) as first_at, max(pos) as last_at, cast(sum(pos) as bigint) as at_sum from p group by doc_id, needle""")
def c19(t):
    rows = _docs(t).select("doc_id", "text", F.explode(F.array(F.lit("the"), F.lit("er"), F.lit("ou"))).alias("span_text"))
    placed = S.unnest(rows, S.literal_spans(F.col("text"), F.col("span_text"), "x"), "s", "doc_id", F.col("span_text").alias("needle"))
    return placed.groupBy("doc_id", "needle").agg(
        F.count("*").alias("hits"), F.min("s.start").alias("first_at"), F.max("s.start").alias("last_at"), F.sum("s.start").alias("at_sum")
    )
