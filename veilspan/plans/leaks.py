"""Cross-matter leak detection: facts, copied phrases, contamination."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilspan.functions import patterns as P
from veilspan.functions.stats import wilson
from veilspan.functions.text import word_ngrams, words
from veilspan.operators import carryover, containment, detect, facts, fingerprint, score, screening, scrub
from veilspan.plans import world as V
from veilspan.plans.base import query
from veilspan.plans.redaction import FACT_HITS, RULES, scrub_sql

LETTERS = f"(select draft_id, matter_id, text from ({V.DRAFTS}) d)"


def _letters(t):
    return V.drafts(t).select("draft_id", "matter_id", "text")


def _facts(t):
    return facts.fact_table(V.matters(t))


def _corpus(t):
    return t.documents.select("doc_id", F.col("source").alias("matter_id"), "text")


# --- facts of other matters -------------------------------------------------------


@query("e01_protected_facts", f"""select draft_id, (select count(*) from ({V.FACTS}) a) - (select count(*) from ({V.FACTS}) f where f.matter_id = d.matter_id) as protected_facts
  from {LETTERS} d""")
def e01(t):
    f = _facts(t)
    total = f.count()
    own = f.groupBy("matter_id").agg(F.count("*").alias("own"))
    return _letters(t).join(own, "matter_id", "left").select("draft_id", (F.lit(total) - F.coalesce("own", F.lit(0))).alias("protected_facts"))


OWNERS = f"""(select category, lower(value) as folded, min(matter_ord) as matter_ord, arg_min(ord, matter_ord * 10 + ord) as ord, arg_min(matter_id, matter_ord * 10 + ord) as owner
    from ({V.FACTS}) f where category in ('names', 'orgs') group by 1, 2)"""


def names_sql(letters: str) -> str:
    return f"""select draft_id, category, folded as value_key, matter_ord, ord, owner, 0 as form_ord, cast(pos as int) as "start", cast(pos + length(folded) as int) as "end", substr(text, cast(pos as int) + 1, length(folded)) as evidence from (
      select *, sum(length(piece) + length(folded)) over (partition by draft_id, category, folded order by i) - length(folded) as pos from (
        select *, unnest(range(1, len(g))) as i, unnest(g[1:len(g) - 1]) as piece from (
          select d.draft_id, d.text, o.*, string_split(lower(d.text), folded) as g from {letters} d join {OWNERS} o on contains(lower(d.text), o.folded)) a) b) c"""


AMOUNT_OWNERS = f"""(select cast(regexp_replace(value, '[^0-9]', '', 'g') as bigint) as v, min(matter_ord) as matter_ord, arg_min(ord, matter_ord * 10 + ord) as ord, arg_min(matter_id, matter_ord * 10 + ord) as owner
    from ({V.FACTS}) f where category = 'amounts' group by 1)"""
FORMS = f"""(select *, 1 as form_ord, '$' || format('{{:,}}', v) as lit from {AMOUNT_OWNERS} a union all select *, 2, cast(v as string) from {AMOUNT_OWNERS} b
    union all select *, 3, '$' || cast(v // 1000 as string) || 'K' from {AMOUNT_OWNERS} c where v % 1000 = 0 union all select *, 4, cast(v // 1000 as string) || ' thousand dollars' from {AMOUNT_OWNERS} d where v % 1000 = 0
    union all select *, 5, '$' || cast(v // 1000000 as string) || case when (v // 100000) % 10 = 0 then '' else '.' || cast((v // 100000) % 10 as string) end || ' million' from {AMOUNT_OWNERS} e where v >= 1000000 and v % 100000 = 0)"""
AMOUNTS = f"""select draft_id, 'amounts' as category, cast(v as string) as value_key, matter_ord, ord, owner, form_ord, p as "start", e as "end", substr(text, p + 1, e - p) as evidence from (
    select *, p + length(lit) + (case when form_ord = 1 then length(regexp_extract(substr(text, p + length(lit) + 1), '^\\.[0-9]+')) else 0 end) as e from (
      select *, cast(pos as int) as p, case when pos = 0 then ' ' else substr(text, cast(pos as int), 1) end as before, substr(text, cast(pos as int) + length(lit) + 1, 1) as after from (
        select *, sum(length(piece) + length(lit)) over (partition by draft_id, v, form_ord order by i) - length(lit) as pos from (
          select *, unnest(range(1, len(g))) as i, unnest(g[1:len(g) - 1]) as piece from (
            select d.draft_id, d.text, f.*, string_split(d.text, lit) as g from {LETTERS} d join {FORMS} f on contains(d.text, f.lit)) a) b) c) x
    where form_ord = 1 or (form_ord = 2 and not regexp_matches(before, '[0-9]') and not regexp_matches(after, '[0-9]')) or (form_ord = 3 and not regexp_matches(after, '\\w'))
      or (form_ord = 4 and not regexp_matches(before, '\\w') and not regexp_matches(after, '\\w')) or (form_ord = 5 and not regexp_matches(after, '\\w'))) y"""
OWN = f"""(select distinct matter_id, category, case when category = 'amounts' then cast(cast(regexp_replace(value, '[^0-9]', '', 'g') as bigint) as string) else lower(value) end as value_key from ({V.FACTS}) f where category <> 'distinctive')"""
MATCHES = f"select * from ({names_sql(LETTERS)}) n union all select * from ({AMOUNTS}) a"
FOREIGN = f"select m.*, d.matter_id from ({MATCHES}) m join (select draft_id, matter_id from ({V.DRAFTS}) d) d using (draft_id) anti join {OWN} o on o.matter_id = d.matter_id and o.category = m.category and o.value_key = m.value_key"
CREDITED = f"""select draft_id, matter_id, owner, category, "start", "end", evidence from (
    select *, row_number() over (partition by draft_id, "start", "end" order by matter_ord, case category when 'names' then 1 when 'orgs' then 2 else 3 end, ord, form_ord) as place from ({FOREIGN}) f) r where place = 1"""


@query("e02_dictionary_match", f"""select draft_id, category, value_key, owner, "start", "end", evidence from ({names_sql(LETTERS)}) n""")
def e02(t):
    return fingerprint.name_matches(_letters(t), _facts(t)).select("draft_id", "category", "value_key", "owner", "start", "end", "evidence")


@query("e03_amount_match", f"""select draft_id, value_key, owner, form_ord, "start", "end", evidence from ({AMOUNTS}) a""")
def e03(t):
    return fingerprint.amount_matches(_letters(t), _facts(t)).select("draft_id", "value_key", "owner", "form_ord", "start", "end", "evidence")


@query("e04_fingerprint_hits", CREDITED)
def e04(t):
    return fingerprint.fingerprint_hits(_letters(t), _facts(t))


@query("e06_own_fact_subtraction", f"""select draft_id, category, value_key, count(*) as matches from ({FOREIGN}) f group by all""")
def e06(t):
    d, f = _letters(t), _facts(t)
    every = fingerprint.name_matches(d, f).unionByName(fingerprint.amount_matches(d, f))
    return fingerprint.without_own(every, f).groupBy("draft_id", "category", "value_key").agg(F.count("*").alias("matches"))


@query("g01_first_seen_span", f"""select owner, category, count(*) as spans, count(distinct draft_id) as drafts, cast(sum("start") as bigint) as starts from ({CREDITED}) c group by owner, category""")
def g01(t):
    return fingerprint.fingerprint_hits(_letters(t), _facts(t)).groupBy("owner", "category").agg(
        F.count("*").alias("spans"), F.countDistinct("draft_id").alias("drafts"), F.sum("start").alias("starts")
    )


@query("f01_fingerprint_confusion", f"""with flags as (select d.draft_id, d.label, d.practice, h.draft_id is not null as flag from (select d.*, m.practice from ({V.DRAFTS}) d join ({V.MATTERS}) m using (matter_id)) d left join (select distinct draft_id from ({CREDITED}) c) h using (draft_id))
  select 'regex' as detector, practice as eval_set, count(*) filter (label = 'leak' and flag) as caught, count(*) filter (label = 'leak') as leaks, count(*) filter (label = 'clean' and flag) as false_alarms,
    count(*) filter (label = 'clean') as clean, count(*) as n, count(*) filter (flag is null) as errors from flags group by practice""")
def f01(t):
    hits = fingerprint.fingerprint_hits(_letters(t), _facts(t)).select("draft_id").distinct().withColumn("hit", F.lit(True))
    rows = V.drafts(t).join(V.matters(t).select("matter_id", "practice"), "matter_id").join(hits, "draft_id", "left")
    return score.confusion(rows.select(F.lit("regex").alias("detector"), F.col("practice").alias("eval_set"), "label", F.coalesce("hit", F.lit(False)).alias("flag")))


@query("e12_facts_of_others", f"""with p as (select distinct h.draft_id, h.entity as value, d.matter_id from ({FACT_HITS}) h join {LETTERS} d using (draft_id)),
  v as (select value, category, count(distinct matter_id) as owners from ({V.FACTS}) f group by 1, 2), own as (select distinct matter_id, value, category, 1 as mine from ({V.FACTS}) f)
  select draft_id, p.value, v.category as kind, owners - coalesce(mine, 0) as n_owners from p join v on v.value = p.value left join own o on o.matter_id = p.matter_id and o.value = p.value and o.category = v.category where owners - coalesce(mine, 0) > 0""")
def e12(t):
    return fingerprint.facts_of_others(_letters(t), "draft_id", _facts(t))


ENSEMBLE = f"""(select draft_id, "start", "end", 0 as listed, kind from ({FACT_HITS}) f union all select draft_id, "start", "end", 1, kind from ({RULES}) r)"""


@query("c20_ensemble", f"""with h as (select *, row_number() over (partition by draft_id order by "start", "end", listed, kind) as rn, max("end") over (partition by draft_id order by "start", "end", listed, kind rows between unbounded preceding and 1 preceding) as reach from {ENSEMBLE} e),
  k as (select *, sum(case when reach is null or "start" >= reach then 1 else 0 end) over (partition by draft_id order by rn) as island from h)
  select draft_id, min("start") as "start", max("end") as "end", arg_min(kind, rn) as kind from k group by draft_id, island""")
def c20(t):
    dim = _facts(t)
    detect.register_detector("facts", lambda df, key, text: facts.fact_hits(df, key, dim, text).select(key, "start", "end", "kind"))
    return detect.ensemble(V.drafts(t).select("draft_id", "text"), "draft_id", ["facts", "rules", "unavailable"])


# --- copied phrases ------------------------------------------------------------------


def grams_sql(source: str, keys: str, n: int = P.CARRY_N) -> str:
    return f"""select {keys}, unnest(range(0, len(w) - {n - 1})) as i, unnest(list_transform(range(1, len(w) - {n - 2}), lambda j: array_to_string(w[j:j + {n - 1}], ' '))) as g from (
      select {keys}, list_transform(regexp_extract_all(text, '[A-Za-z0-9'']+'), lambda x: lower(x)) as w from {source}) s where len(w) >= {n}"""


DOC_GRAMS = grams_sql("(select doc_id, source, text from documents)", "doc_id, source")
LEFT_OUT = f"""grams as materialized ({DOC_GRAMS}), per as (select g, source, count(distinct doc_id) as docs, min(doc_id) as d from grams group by 1, 2),
    two as (select g from per group by g having count(*) = 2),
    hits as (select a.g, a.d as draft_id, a.source as matter_id, b.source as owner from per a join per b on a.g = b.g and a.source <> b.source where a.docs = 1 and a.g in (select g from two))"""


def wilson_sql(k: str, n: str, hi: bool) -> str:
    z, z2 = "1.959963984540054", "(1.959963984540054 * 1.959963984540054)"
    k, n = f"cast({k} as double)", f"cast({n} as double)"
    body = f"({k} / {n} + {z2} / (2 * {n}) {'+' if hi else '-'} {z} * sqrt(({k} / {n}) * (1 - {k} / {n}) / {n} + {z2} / (4 * {n} * {n}))) / (1 + {z2} / {n})"
    return f"case when {n} > 0 then {'least(1.0, ' if hi else 'greatest(0.0, '}{body}) end"


@query("e05_carryover_scoreboard", f"""with {LEFT_OUT}, rows as (select d.lang as eval_set, case when l.toxic = 1 then 'leak' else 'clean' end as label, h.draft_id is not null as flag
    from labels l join documents d using (doc_id) left join (select distinct draft_id from hits) h on h.draft_id = l.doc_id),
  counts as (select coalesce(eval_set, 'pooled') as eval_set, count(*) filter (label = 'leak' and flag) as caught, count(*) filter (label = 'leak') as leaks, count(*) filter (label = 'clean' and flag) as false_alarms,
    count(*) filter (label = 'clean') as clean, count(*) as n, count(*) filter (flag is null) as errors from rows group by grouping sets ((eval_set), ()))
  select 'carryover' as detector, *, round({wilson_sql("caught", "leaks", False)}, 6) as recall_lo, round({wilson_sql("caught", "leaks", True)}, 6) as recall_hi,
    round({wilson_sql("false_alarms", "clean", False)}, 6) as fa_lo, round({wilson_sql("false_alarms", "clean", True)}, 6) as fa_hi from counts""")
def e05_scoreboard(t):
    flagged = carryover.left_out_grams(_corpus(t)).select(F.col("draft_id").alias("doc_id")).distinct().withColumn("hit", F.lit(True))
    rows = t.labels.join(t.documents.select("doc_id", "lang"), "doc_id").join(flagged, "doc_id", "left").select(
        F.lit("carryover").alias("detector"), F.col("lang").alias("eval_set"),
        F.when(F.col("toxic") == 1, "leak").otherwise("clean").alias("label"), F.coalesce("hit", F.lit(False)).alias("flag"),
    )
    counts = score.pooled(rows, "pooled")
    recall, alarm = wilson(F.col("caught"), F.col("leaks")), wilson(F.col("false_alarms"), F.col("clean"))
    return counts.select(
        "*", F.round(recall["lo"], 6).alias("recall_lo"), F.round(recall["hi"], 6).alias("recall_hi"),
        F.round(alarm["lo"], 6).alias("fa_lo"), F.round(alarm["hi"], 6).alias("fa_hi"),
    )


@query("e05_left_out_phrases", f"""with {LEFT_OUT}, placed as (select distinct g.doc_id as draft_id, g.i, h.owner from grams g join hits h on h.g = g.g and h.draft_id = g.doc_id),
  f as (select *, case when lag(owner) over w = owner and i - lag(i) over w < 6 then 0 else 1 end as new from placed window w as (partition by draft_id order by i)),
  k as (select *, sum(new) over (partition by draft_id order by i) as island from f)
  select draft_id, owner, cast(min(i) as int) as first, cast(max(i) + 5 as int) as last, count(*) as grams from k group by draft_id, owner, island""")
def e05_phrases(t):
    return carryover.left_out_phrases(_corpus(t)).select("draft_id", "owner", "first", "last", "grams")


NOTE_GRAMS = f"""owners as (select g, min(matter_id) as owner from ({grams_sql(f"({V.NOTES})", "matter_id")}) n group by g having count(distinct matter_id) = 1),
    placed as (select d.draft_id, d.matter_id, d.i, o.owner from ({grams_sql(LETTERS, "draft_id, matter_id")}) d join owners o on o.g = d.g where o.owner <> d.matter_id),
    f as (select *, case when lag(owner) over w = owner and i - lag(i) over w < 6 then 0 else 1 end as new from placed window w as (partition by draft_id order by i)),
    k as (select *, sum(new) over (partition by draft_id order by i) as island from f),
    phrases as (select draft_id, matter_id, owner, cast(min(i) as int) as first, cast(max(i) + 5 as int) as last, count(*) as grams from k group by draft_id, matter_id, owner, island)"""


@query("e05_carryover_hits", f"""with {NOTE_GRAMS}, t as (select draft_id, regexp_extract_all(text, '[A-Za-z0-9'']+') as w, string_split_regex(text, '[A-Za-z0-9'']+') as s from {LETTERS} d)
  select p.*, array_to_string(list_transform(range(p.first + 1, p.last + 2), lambda i: case when i = p.first + 1 then '' else s[i] end || w[i]), '') as evidence from phrases p join t using (draft_id)""")
def e05_hits(t):
    return carryover.carryover_hits(_letters(t), V.notes(t))


SCREENED = f"""with {NOTE_GRAMS}, cut as (select draft_id, regexp_extract_all(text, '[A-Za-z0-9'']+') as w, string_split_regex(text, '[A-Za-z0-9'']+') as s from {LETTERS} d),
  hits as (select draft_id, matter_id, owner, 'fingerprint' as detector, category, evidence from ({CREDITED}) c
    union all select p.draft_id, p.matter_id, p.owner, 'carryover', 'phrase', array_to_string(list_transform(range(p.first + 1, p.last + 2), lambda i: case when i = p.first + 1 then '' else s[i] end || w[i]), '') from phrases p join cut using (draft_id))"""


def _owners(t):
    return carryover.gram_owners(V.notes(t))


@query("b26_combined_hits", f"""{SCREENED} select * from hits""")
def b26_hits(t):
    return screening.combined_hits(_letters(t), _facts(t), _owners(t))


@query("b26_screening_score", f"""{SCREENED} select d.draft_id, case when h.draft_id is not null then 1.0::double else 0.0::double end as score, h.draft_id is not null as blocked, case when h.draft_id is not null then 'leak' else 'clean' end as verdict
  from {LETTERS} d left join (select distinct draft_id from hits) h using (draft_id)""")
def b26(t):
    return screening.screening_scores(V.drafts(t).select("draft_id"), screening.combined_hits(_letters(t), _facts(t), _owners(t)))


@query("g03_phrase_merge", f"""with {NOTE_GRAMS} select last - first + 1 as tokens, count(*) as phrases, cast(sum(grams) as bigint) as grams from phrases group by 1""")
def g03(t):
    hits = carryover.merge_grams(carryover.carryover_grams(_letters(t), carryover.gram_owners(V.notes(t))))
    return hits.groupBy((F.col("last") - F.col("first") + 1).alias("tokens")).agg(F.count("*").alias("phrases"), F.sum("grams").alias("grams"))


@query("f02_gram_owners", f"""select owners, count(*) as grams from (select g, count(distinct source) as owners from ({DOC_GRAMS}) d group by g) o group by owners""")
def f02(t):
    return carryover.gram_owners(carryover.dealt(_corpus(t))).groupBy("owners").agg(F.count("*").alias("grams"))


@query("g06_word_ngrams", f"""select doc_id, count(*) as grams, count(distinct g) as distinct_grams, max(length(g)) as longest from ({DOC_GRAMS}) d group by doc_id""")
def g06(t):
    grams = t.documents.select("doc_id", word_ngrams(words(F.col("text"))).alias("g")).where(F.size("g") > 0)
    return grams.select(
        "doc_id", F.size("g").cast("bigint").alias("grams"), F.size(F.array_distinct("g")).cast("bigint").alias("distinct_grams"),
        F.array_max(F.transform("g", F.length)).alias("longest"),
    )


@query("i05_corpus_grams", f"""select source as matter_id, count(distinct g) as grams from ({DOC_GRAMS}) d group by source""")
def i05(t):
    grams = carryover.gram_rows(carryover.dealt(_corpus(t)), ["matter_id"]).distinct()
    return grams.groupBy("matter_id").agg(F.count("*").alias("grams"))


@query("e19_ngram_overlap", f"""with e as (select distinct item_id, g from ({grams_sql("benchmark", "item_id", 5)}) b), d as (select distinct g from ({grams_sql("documents", "doc_id", 5)}) x)
  select item_id, count(*) as grams, count(d.g) as seen, count(d.g) / count(*) as share, count(d.g) / count(*) > 0.5 as over_half from e left join d using (g) group by item_id""")
def e19(t):
    return carryover.ngram_overlap(t.benchmark, "item_id", t.documents).withColumn("over_half", F.col("share") > 0.5)


# --- contamination ---------------------------------------------------------------------


@query("e08_containing_pairs", "select doc_id, item_id from documents d join benchmark b on contains(d.text, b.text)")
def e08_pairs(t):
    return containment.containing_pairs(t.documents, "doc_id", t.benchmark, "item_id", "text")


TRIM = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"


@query("e08_holdout_contamination", f"""select distinct doc_id from documents d join (select {TRIM.format('text')} as b from benchmark where length({TRIM.format('text')}) >= 40) h on contains(d.text, b) or contains(b, {TRIM.format('d.text')})""")
def e08(t):
    return containment.contaminated(t.documents.select("doc_id", "text"), "doc_id", t.benchmark, "item_id", P.HOLDOUT_MIN_CHARS)


@query("e08_conversation_contamination", f"""select distinct conv_id from (select conv_id, string_agg(text, ' ' order by turn) as t from conversations where role = 'user' group by conv_id) c
  join (select distinct {TRIM.format('text')} as b from conversations where turn = 0 and length({TRIM.format('text')}) >= 40) h on contains(c.t, b) or contains(b, {TRIM.format('c.t')})""")
def e08_conversations(t):
    turns = t.conversations.where("role = 'user'").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("turns"))
    rows = turns.select("conv_id", F.array_join(F.col("turns.text"), " ").alias("text"))
    opening = t.conversations.where("turn = 0").select(F.col("conv_id").alias("holdout_id"), "text")
    return containment.contaminated(rows, "conv_id", opening, "holdout_id", P.HOLDOUT_MIN_CHARS)


# --- scrub, then check again ---------------------------------------------------------------

PROCEDURES = f"(select matter_ord as draft_id, matter_id, text from ({V.NOTES}) n)"


@query("d16_scrub_and_recheck", f"""with {scrub_sql(PROCEDURES)}, clean_text as (select draft_id, matter_id, scrubbed as text from scrubbed),
  named as (select distinct draft_id from (select m.draft_id from ({names_sql("clean_text")}) m join clean_text d using (draft_id) anti join {OWN} o on o.matter_id = d.matter_id and o.category = m.category and o.value_key = m.value_key) x),
  owners as (select g, min(matter_id) as owner from ({grams_sql(f"({V.NOTES})", "matter_id")}) n group by g having count(distinct matter_id) = 1),
  copied as (select distinct d.draft_id from ({grams_sql("clean_text", "draft_id, matter_id")}) d join owners o on o.g = d.g where o.owner <> d.matter_id)
  select c.matter_id, c.text as scrubbed, case when n.draft_id is not null or p.draft_id is not null then 'leak' else 'clean' end as verdict from clean_text c left join named n using (draft_id) left join copied p using (draft_id)""")
def d16(t):
    notes, matters = V.notes(t), V.matters(t)
    requests = notes.join(matters.select("matter_id", "practice"), "matter_id").select(F.col("matter_ord").alias("draft_id"), "matter_id", "practice", "text")
    clean = scrub.scrub(requests, matters).select("draft_id", "matter_id", F.col("scrubbed").alias("text"))
    hits = fingerprint.fingerprint_hits(clean, facts.fact_table(matters)).select("draft_id")
    copied = carryover.carryover_grams(clean, carryover.gram_owners(notes)).select("draft_id")
    flagged = hits.unionByName(copied).distinct().withColumn("hit", F.lit(True))
    return clean.join(flagged, "draft_id", "left").select("matter_id", F.col("text").alias("scrubbed"), F.when(F.col("hit"), "leak").otherwise("clean").alias("verdict"))
