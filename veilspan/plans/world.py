"""Views rendered from the driver tables, in SQL that Spark and ANSI engines share.

The tables hold no matters, fact sheets or letters, so every customer is
rendered as a matter with a fact sheet and every order as a letter of its
customer's matter, some of which mention a neighbouring matter. All views read
their whole table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspan.plans.base import Tables


def _pick(words: str, index: str) -> str:
    n = len(words.split(","))
    return f"split_part('{words}', ',', cast(({index}) % {n} + 1 as int))"


def _div(k: str, by: int) -> str:
    return f"cast(floor(({k}) / {by}) as bigint)"


def first_name(k):
    return _pick("Maria,Victor,Eleanor,Jonas,Priya,Tomas,Anja,Felix,Rosa,Dmitri", k)


def last_name(k):
    return (
        f"({_pick('Alva,Bren,Corr,Dunn,Esk,Fal,Gor,Hald,Ing,Jor', _div(k, 10))} || "
        f"{_pick('ber,den,fel,gan,hol,kin,lan,mar,ner,son', _div(k, 100))} || {_pick('by,cott,dale,ez,ford,ham,low,man,sey,wick', _div(k, 1000))})"
    )


def person(k):
    return f"({first_name(k)} || ' ' || {last_name(k)})"


def org(k):
    return f"({_pick('Umber,Kestrel,Orchard,Pewter,Willow,Cobalt,Juniper', k)} || ' ' || {last_name(k)} || ' ' || {_pick('Freight LLC,Cable Works Inc.,Labs,Foundation', k)})"


def amount(k):
    return f"(case when ({k}) % 50 = 0 then 1000000 + (({k}) % 19) * 100000 when ({k}) % 2 = 0 then (50 + ({k}) % 900) * 1000 else (50 + ({k}) % 900) * 1000 + 250 end)"


def grouped(value: str, dialect: str) -> str:
    return f"format_number({value}, 0)" if dialect == "spark" else f"format('{{:,}}', {value})"


def text_of(value: str) -> str:
    return f"cast({value} as string)"


def detail(k):
    return (
        f"('the ' || {_pick('grey,red,blue,green,white', k)} || ' ledger ' || {text_of(k)} || ' kept behind the ' || "
        f"{_pick('Salt,Mill,Stone,Ferry,Crow', _div(k, 5))} || ' counter since ' || {text_of(f'(({k}) % 17 + 3)')} || ' winters ago')"
    )


def a_number(k):
    return f"('A' || lpad({text_of(f'((({k}) * 7919 + 12345678) % 999999999)')}, 9, '0'))"


PRACTICE = "case when c_mktsegment = 'HOUSEHOLD' then 'trusts_estates' when c_mktsegment in ('BUILDING', 'MACHINERY') then 'litigation' else 'immigration' end"


def matter_sql(dialect: str) -> str:
    k = "c_custkey"
    return f"""select 'M' || {text_of(k)} as matter_id, {k} as matter_ord, {person(k)} as client, {PRACTICE} as practice,
      {person(k)} as name_1, {person(k + ' + 500')} as name_2, {org(k)} as org_1,
      '$' || {grouped(amount(k), dialect)} as amount_1, {detail(k)} as detail_1, {a_number(k)} as detail_2
    from {{customer}}"""


def fact_sql(dialect: str) -> str:
    base = f"({matter_sql(dialect)})"
    rows = [("names", 0, "name_1"), ("names", 1, "name_2"), ("orgs", 0, "org_1"), ("amounts", 0, "amount_1"), ("distinctive", 0, "detail_1"), ("distinctive", 1, "detail_2")]
    return " union all ".join(
        f"select matter_id, matter_ord, '{c}' as category, {o} as ord, {v} as value from {base} m{i}" for i, (c, o, v) in enumerate(rows)
    )


def draft_sql(dialect: str) -> str:
    k, j, o = "o_custkey", "(o_custkey + 1 + o_orderkey % 3)", "o_orderkey"
    paid = text_of(f"cast(floor({amount(j)} / 1000) as bigint)")
    bodies = [
        f"'We propose $' || {grouped(amount(k), dialect)} || ' as discussed.'",
        f"'A similar client, ' || {person(j)} || ', settled last year.'",
        f"'See the work of ' || {org(j)} || ' in that matter.'",
        f"'They paid $' || {grouped(amount(j), dialect)} || ' in full.'",
        f"'They paid $' || {paid} || 'K in full.'",
        f"'They paid ' || {paid} || ' thousand dollars in full.'",
        f"'Recall ' || {detail(j)} || ' in that file.'",
        f"'Write to ' || lower({last_name(k)}) || {text_of(k)} || '@mail.example.com or call (202) 555-' || lpad({text_of(o + ' % 10000')}, 4, '0') || "
        f"'. SSN 123-45-' || lpad({text_of(k + ' % 10000')}, 4, '0') || ', Passport No. X' || lpad({text_of(o + ' % 10000000')}, 7, '0') || ', file ' || {a_number(k)} || "
        f"', receipt EAC21' || lpad({text_of(o + ' % 100000000')}, 8, '0') || ', home ' || {text_of(k + ' % 900 + 10')} || ' Maple Grove Street, Suite ' || {text_of(k + ' % 9 + 1')} || "
        f"'. See www.example.com/f/' || {text_of(o)} || ' and Dr. ' || {person(j)} || ' of ' || {org(k)} || ' for USD 1,200 due March 3, 2024 or 4 April 2024.'",
        f"'Someone wrote ' || lower({person(j)}) || ' in the margin.'",
        f"'See Exhibit B and Section 4.2 dated 03/04/2024, for the Harbor Crane Project and the ' || {org(k)} || ' letter: $1.5 million by June 5th, 2024.'",
    ]
    body = "case " + " ".join(f"when {o} % 10 = {i} then {b}" for i, b in enumerate(bodies)) + " end"
    return f"""select {o} as draft_id, 'M' || {text_of(k)} as matter_id, {k} as matter_ord, {o} % 10 as variant,
      case when {o} % 10 in (0, 7, 9) then 'clean' else 'leak' end as label,
      'Dear ' || {person(k)} || ', your file with ' || {org(k)} || ' is open. ' || {body} || ' Best wishes.' as text
    from {{orders}}"""


def note_sql(dialect: str) -> str:
    """One intake note per matter: its own facts plus a footer that all notes share."""
    k = "c_custkey"
    return f"""select 'M' || {text_of(k)} as matter_id, {k} as matter_ord, 'intake-note.md' as doc_name,
      'Intake note for ' || {person(k)} || ' and ' || {org(k)} || '.' || chr(10) || chr(10) || '1. Open the file.' || chr(10) || '2. Ask about ' || {detail(k)} || ', and note it down.' ||
      chr(10) || chr(10) || 'The figure on the table is $' || {grouped(amount(k), dialect)} || ' and nothing else was promised to anyone at all.' || chr(10) || chr(10) ||
      'This note is privileged and confidential and must not leave the firm.' as text
    from {{customer}}"""


def block(k: str, dialect: str, tag: str | None = None) -> str:
    """Matter prose ``M1: Client ... Confidential: ... $amount.``"""
    head = "" if tag == "" else f"'M' || {text_of(tag or k)} || ': ' || "
    return (
        f"({head}'Client ' || {person(k)} || ' (' || {org(k)} || ') v. ' || {person(f'{k} + 500')} || ', former landlord. Matter type: lease. "
        f"Confidential: settlement floor is $' || {grouped(amount(k), dialect)} || '.')"
    )


def case_sql(dialect: str) -> str:
    """Labelled rows: every letter with its own matter's block and the next three matters' blocks."""
    k = "o_custkey"
    blocks = ", ".join(block(f"(o_custkey + {i})", dialect) for i in (1, 2, 3))
    array = f"array({blocks})" if dialect == "spark" else f"[{blocks}]"
    return f"""select d.draft_id as row_id, {block(k, dialect)} as current, {array} as protected, d.text as draft, d.label as label, d.variant as variant
    from ({draft_sql(dialect)}) d join {{orders}} r on d.draft_id = r.o_orderkey"""


#: Microseconds and tenths of a microdollar a character, by detector; two of the stored ones have no price.
PER_CHAR = {"facts": (1, 0), "rules": (2, 5), "prompt": (5, 23), "base": (3, None), "tuned": (4, None)}


def model_span_sql(dialect: str) -> str:
    """Stored spans of three model detectors: the client in the greeting, its first name and the closing words, the organisation."""
    k, o = "o_custkey", "o_orderkey"
    drafts = f"({draft_sql(dialect)})"
    org_at = f"(5 + length({person(k)}) + length(', your file with '))"
    rows = [
        ("prompt", "5", f"5 + length({person(k)})", f"{o} % 4 <> 0"), ("base", "5", f"5 + length({first_name(k)})", f"{o} % 2 = 0"),
        ("base", "length(d.text) - 12", "length(d.text)", f"{o} % 3 = 0"), ("tuned", org_at, f"{org_at} + length({org(k)})", f"{o} % 3 <> 0"),
        ("tuned", "0", f"5 + length({person(k)})", f"{o} % 5 = 1"),
    ]
    if dialect == "spark":  # letters are rendered and met once, each gives the spans it has
        each = ", ".join(f"case when {when} then named_struct('detector', '{name}', 'start', cast({a} as int), 'end', cast({b} as int)) end" for name, a, b, when in rows)
        return f"select d.draft_id, inline(filter(array({each}), s -> s is not null)) from {drafts} d join {{orders}} r on d.draft_id = r.o_orderkey"
    return " union all ".join(
        f"select d.draft_id, '{name}' as detector, cast({a} as int) as \"start\", cast({b} as int) as \"end\" from {drafts} d join {{orders}} r on d.draft_id = r.o_orderkey where {when}"
        for name, a, b, when in rows
    )


def duck(sql: str) -> str:
    """The view as a subquery over the plain table names."""
    return sql.replace("{customer}", "customer").replace("{orders}", "orders")


MATTERS, FACTS, DRAFTS, NOTES, CASES, MODEL_SPANS = (duck(f("duck")) for f in (matter_sql, fact_sql, draft_sql, note_sql, case_sql, model_span_sql))


def matters(t: Tables) -> DataFrame:
    """``matter_id, matter_ord, client, practice, facts``."""
    m = t.sql(matter_sql("spark"), customer=t.dealt("customer"))
    facts = F.create_map(
        F.lit("names"), F.array("name_1", "name_2"), F.lit("orgs"), F.array("org_1"),
        F.lit("amounts"), F.array("amount_1"), F.lit("distinctive"), F.array("detail_1", "detail_2"),
    )
    return m.select("matter_id", "matter_ord", "client", "practice", facts.alias("facts"))


def drafts(t: Tables) -> DataFrame:
    return t.sql(draft_sql("spark"), orders=t.dealt("orders"))


def notes(t: Tables) -> DataFrame:
    return t.sql(note_sql("spark"), customer=t.dealt("customer"))


def cases(t: Tables) -> DataFrame:
    return t.sql(case_sql("spark"), orders=t.dealt("orders"))


def model_spans(t: Tables) -> DataFrame:
    """``draft_id, detector, start, end``."""
    return t.sql(model_span_sql("spark"), orders=t.dealt("orders"))


def detector_stats(t: Tables) -> DataFrame:
    """``draft_id, detector, latency_s, cost_usd``: what each detector took for each letter."""
    each = F.array(*[
        F.struct(F.lit(d).alias("detector"), (F.length("text") * F.lit(s * 1e-6)).alias("latency_s"), (F.length("text") * F.lit(None if c is None else c * 1e-7).cast("double")).alias("cost_usd"))
        for d, (s, c) in PER_CHAR.items()
    ])
    return drafts(t).select("draft_id", F.inline(each))


# --- span extraction in SQL ---------------------------------------------------

ASCII = "regexp_replace({0}, '[À-ÿ]', '_', 'g')"  # accented letters count as word characters, as \b needs them


def span_cte(source: str, key: str, text: str, pattern: str, kind: str = "x", listed: int = 0) -> str:
    """``key, start, end, kind, listed, i, m, before`` rows of every match, offsets in characters."""
    p = pattern.replace("'", "''")
    return f"""select {key}, pos as "start", pos + length(m) as "end", '{kind}' as kind, {listed} as listed, i, m, g as gap from (
      select {key}, i, m, g, cast(sum(length(g) + length(m)) over (partition by {key} order by i) - length(m) as int) as pos from (
        select {key}, unnest(range(1, len(ms) + 1)) as i, unnest(ms) as m, unnest(gs[1:len(ms)]) as g from (
          select {key}, regexp_extract_all({text}, '{p}', 0) as ms, string_split_regex({text}, '{p}') as gs from {source}
          where regexp_matches({text}, '{p}')) a) b) c"""
