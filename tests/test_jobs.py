import json
import os

import pytest
from pyspark.sql import functions as F

from veilspan import plans
from veilspan.operators import audit, catalog, evalrows, facts, redact, score, scrub, training
from veilspan.sources import ledger, readers, writers
from veilspan.streaming import jobs

SHEET = {"names": ["Lena Voss"], "orgs": ["Voss Mills LLC"], "amounts": ["$90,000"], "distinctive": ["the blue ledger at the mill"]}
MATTER_DDL = "matter_id string, matter_ord int, client string, practice string, facts map<string,array<string>>"


def matters(spark):
    return spark.createDataFrame([("a", 0, "Voss Mills", "litigation", SHEET), ("b", 1, "Pruett", "litigation", {"names": ["Omar Pruett"]})], MATTER_DDL)


def test_deidentify_uses_facts_of_all_matters_and_redacts_flagged_text(spark):
    texts = spark.createDataFrame([(1, None, "Yesterday Voss called Omar Pruett about Lena Voss and the blue ledger at the mill, with odd detail left.")], "id int, matter_id string, text string")
    verdicts = spark.createDataFrame([(1, "leak", " odd detail ", "prompt_judge")], "id int, verdict string, evidence string, judge string")
    dim = facts.fact_table(matters(spark))
    first = redact.deidentify(texts, "id", dim).first()
    assert "Omar" not in first["redacted"] and "Voss" not in first["redacted"] and first["residual_verdict"] is None and first["judge"] is None
    second = redact.deidentify(texts, "id", dim, verdicts).first()
    assert "odd detail" not in second["redacted"] and second["residual_verdict"] == "leak" and second["removed"] == first["removed"] + 1
    assert [s["replacement"] for s in second["spans"] if s["kind"] == "name"][0].startswith("[NAME")


def test_scrub_leaves_no_fact_and_keeps_steps(spark):
    text = "1. Ask Lena Voss about $90,000.\n2. Note the blue ledger at the mill, Exhibit B, Section 4.2, March 3rd, 2024.\n3. Voss again."
    out = scrub.scrub(spark.createDataFrame([("a", "litigation", text), ("zz", "litigation", "x"), ("a", "none", "x")], "matter_id string, practice string, text string"), matters(spark), matters(spark)).collect()
    done = next(r for r in out if r["error"] is None)
    assert all(v not in done["scrubbed"] for vs in SHEET.values() for v in vs) and "Voss" not in done["scrubbed"]
    assert len(done["scrubbed"].splitlines()) == 3 and done["removed"] >= 7
    assert sorted(r["error"] for r in out if r["error"]) == ["unknown matter_id zz", "unknown practice none"]


BLOCK = "M{0}: Client {1} ({2}) v. Greg Noll, former landlord. Matter type: lease. Confidential: floor is {3}."


def test_labelled_rows_both_shapes_and_row_detectors(spark):
    own, other = BLOCK.format(1, "Ana Diaz", "Diaz Foods LLC", "$48,200"), BLOCK.format(2, "Paul Rey", "Rey Auto Inc.", "$310,500")
    user = f"CURRENT MATTER {own}\n\nPROTECTED (other matters):\n- {other}\n\nDRAFT:\nPaul Rey holds 310500."
    lines = [
        json.dumps({"current": own, "protected": [other], "draft": "Ana Diaz of Diaz Foods LLC asks $48,200.", "label": "clean"}),
        json.dumps({"messages": [{"role": "system", "content": "s"}, {"role": "user", "content": user}], "meta": {"label": "LEAK"}}),
        json.dumps({"current": own, "protected": [other], "draft": "Settlement of $310,500 in a lease", "label": "Leak"}), "", json.dumps({"x": 1}),
    ]
    rows = evalrows.parse_rows(spark.createDataFrame([(x,) for x in lines], "value string"))
    got = rows.select("row.label", evalrows.row_fingerprint_flag(F.col("row")).alias("flag"), "row.protected").collect()
    assert [(r["label"], r["flag"]) for r in got] == [("CLEAN", False), ("LEAK", True), ("LEAK", True), (None, None)]
    assert got[0]["protected"][0]["matter_id"] == "M2" and got[0]["protected"][0]["amounts"] == ["$310,500"]
    with pytest.raises(Exception):
        evalrows.parse_rows(spark.createDataFrame([("{broken",)], "value string")).collect()


def test_null_flags_stay_in_the_denominator(spark):
    rows = spark.createDataFrame([("d", "s", "leak", True), ("d", "s", "leak", None), ("d", "s", "clean", False)], "detector string, eval_set string, label string, flag boolean")
    r = score.confusion(rows).first()
    assert (r["caught"], r["leaks"], r["false_alarms"], r["clean"], r["n"], r["errors"]) == (1, 2, 0, 1, 3, 1)


def test_choice_respects_cap_and_ties(spark):
    m = spark.createDataFrame([("x", 0.99, 0.5, 0.3, 1.0, 0), ("y", 0.9, None, 0.05, 9.0, 1), ("z", 0.9, 0.1, 0.1, 50.0, 2)], "candidate string, identifier_recall double, quasi_recall double, over_redaction double, latency_ms_per_paragraph double, listed int")
    assert score.choose(m).first()["candidate"] == "z"


def test_exact_percentile_with_many_buckets_and_hot_value(spark):
    values = [1.0] * 500 + [float(i) for i in range(300)]
    rows = spark.createDataFrame([("k", v) for v in values], "g string, v double")
    got = {r["p"]: r["percentile"] for r in score.exact_percentiles(rows, ["g"], "v", [0.0, 0.5, 0.95, 1.0], per_bucket=50).collect()}
    ordered = sorted(values)
    def want(p):
        k = (len(ordered) - 1) * p
        lo = int(k)
        return ordered[lo] + (ordered[min(lo + 1, len(ordered) - 1)] - ordered[lo]) * (k - lo)
    assert all(abs(got[p] - want(p)) < 1e-9 for p in got)


def test_holdout_overlap_refuses_the_build(spark):
    held = spark.createDataFrame([("h", "  a held out draft that is certainly longer than forty characters  "), ("short", "tiny text")], "holdout_id string, text string")
    clean = spark.createDataFrame([(1, "something else, tiny text included")], "id int, text string")
    assert training.refuse_overlap(clean, "id", held).count() == 1
    for bad in ("prefix a held out draft that is certainly longer than forty characters suffix", "  draft that is certainly longer ", " "):
        with pytest.raises(ValueError):
            training.refuse_overlap(spark.createDataFrame([(1, bad)], "id int, text string"), "id", held)


def test_audit_log_order_corruption_and_limit(spark, tmp_path):
    path = str(tmp_path / "log")
    events = spark.createDataFrame([(None, None, None, "first", '{"a": 1, "b": true, "c": "2"}')], "timestamp timestamp, kind string, matter string, summary string, counts string")
    writers.append_events(events, path)
    spark.createDataFrame([("",), ("{broken",)], "value string").write.mode("append").text(path)
    row = readers.read_audit(spark, path).collect()
    assert len(row) == 1 and row[0]["kind"] == "note" and row[0]["counts"] == {"a": 1.0} and row[0]["timestamp"] is not None
    log = spark.createDataFrame([(i, f"s{i}") for i in range(5)], "seq int, summary string")
    assert [r["seq"] for r in audit.recent(log, 2).collect()] == [4, 3] and audit.recent(log, -3).count() == 0 and audit.recent(log, "x").count() == 5


def test_matter_folder_scan_and_policy(spark, tmp_path):
    for name in ("a-one", "b two"):
        os.makedirs(tmp_path / name)
        (tmp_path / name / "matter.json").write_text(json.dumps({"id": "x", "client": "C " + name, "practice": "litigation", "facts": {"names": ["N"]}}, indent=1))
        (tmp_path / name / "note.md").write_text("para one\n\npara two")
    os.makedirs(tmp_path / "empty")
    (tmp_path / "policy.json").write_text(json.dumps({"litigation": {"may_compound": ["x"], "never_compounds": ["y"]}, "other": {"may_compound": [], "never_compounds": ["z"], "demo": False}}))
    assert {r["matter_id"] for r in readers.read_matters(spark, str(tmp_path)).collect()} == {"a-one", "b two"}
    docs = readers.read_documents(spark, str(tmp_path)).collect()
    assert {(r["matter_id"], r["doc_name"]) for r in docs} == {("a-one", "note.md"), ("b two", "note.md")} and docs[0]["text"] == "para one\n\npara two"
    policy = readers.read_policy(spark, str(tmp_path / "policy.json"))
    assert {r["practice"]: r["may_compound"] for r in policy.collect()} == {"litigation": ["x"], "other": []}
    assert catalog.policy_problems(policy).where("reason is not null").count() == 0


def test_counts_stream_equals_batch(spark, tmp_path):
    source = str(tmp_path / "in")
    schema = "timestamp timestamp, kind string, matter string, summary string, counts string"
    rows = spark.createDataFrame([(None, k, "m", "s", "{}") for k in ("scrub", "scrub", None)], schema)
    rows.write.json(source)
    jobs.write_counts(spark.readStream.schema(schema).json(source), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert {r["kind"]: r["n"] for r in ledger.read_snapshot(spark, str(tmp_path / "out")).collect()} == {"scrub": 2, "note": 1}


SMALL = ["b08_paragraphs", "c01_email", "f04_pooled_sets", "f12_interval_table", "e05_carryover_scoreboard", "e08_containing_pairs", "e19_ngram_overlap", "e16_review_state", "d15_scrub_chain", "e03_amount_match"]


@pytest.mark.parametrize("name", SMALL)
def test_registered_queries_match_sql(spark, name):
    import duckdb

    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no test tables")
    registry = plans.load()
    con = duckdb.connect()
    for file in os.listdir(folder):
        con.execute(f"create view {file.split('.')[0]} as select * from '{folder}/{file}'")
    df = registry.QUERIES[name](spark, folder)
    cur = con.execute(registry.ORACLES[name])
    names = [c[0] for c in cur.description]
    columns = sorted(df.columns)
    assert columns == sorted(names)
    fix = lambda v: round(v, 8) if isinstance(v, float) else v
    mine = sorted(tuple(str(fix(r[c])) for c in columns) for r in df.collect())
    theirs = sorted(tuple(str(fix(r[names.index(c)])) for c in columns) for r in cur.fetchall())
    assert mine == theirs


def test_no_python_worker_in_plans(spark):
    registry = plans.load()
    for name in ("c15_priority_resolution", "e04_fingerprint_hits", "d15_scrub_chain", "e05_carryover_scoreboard"):
        plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_external_spans_and_second_verdicts(spark):
    texts = spark.createDataFrame([(1, "The tall baker met Lena Voss at noon."), (2, "The tall baker met Lena Voss at noon.")], "id int, text string")
    dim = facts.fact_table(matters(spark))
    extra = spark.createDataFrame([(1, 4, 14, "org", "tall baker")], "id int, start int, end int, kind string, entity string")
    first = {r["id"]: r for r in redact.deidentify(texts, "id", dim, extra_spans=extra).collect()}
    assert "tall baker" not in first[1]["redacted"] and "[ORG]" in first[1]["redacted"] and "tall baker" in first[2]["redacted"]
    verdicts = spark.createDataFrame([(1, "clean", None, "j"), (2, "leak", "at noon", "j")], "id int, verdict string, evidence string, judge string")
    again = spark.createDataFrame([(1, "leak"), (2, "clean")], "id int, verdict string")
    done = {r["id"]: r for r in redact.deidentify(texts, "id", dim, verdicts, second_verdicts=again).collect()}
    assert done[1]["residual_verdict"] == "clean"  # not redacted again, so its first verdict stands
    assert done[2]["residual_verdict"] == "clean" and "at noon" not in done[2]["redacted"] and "QUASI_IDENTIFIER" in done[2]["redacted"]
    named = {r["id"]: r for r in redact.deidentify(texts, "id", dim, verdicts, second_verdicts=again, name_clues=True).collect()}
    assert "QUASI_IDENTIFIER" not in named[2]["redacted"] and "at noon" not in named[2]["redacted"]


def test_scan_grows_with_the_text_not_its_square(spark):
    import time

    from veilspan.functions import spans as S

    def seconds(words):
        text = spark.createDataFrame([(" ".join(f"w{i % 97}" for i in range(words)),)], "text string").coalesce(1)
        found = S.scan(F.col("text"), r"\w+", lambda at, m, gap: F.struct(at.alias("start"), (at + F.length(m)).alias("end")), "struct<start:int,end:int>")
        best = []
        for _ in range(3):
            began = time.perf_counter()
            row = text.select(F.size(found).alias("n"), F.element_at(found, -1).alias("last")).first()
            best.append(time.perf_counter() - began)
        assert row["n"] == words and row["last"]["end"] == sum(len(f"w{i % 97}") + 1 for i in range(words)) - 1
        return min(best)

    seconds(1000)
    assert seconds(64_000) < 2.6 * seconds(32_000) + 0.5


def test_page_reads_with_several_grants(spark):
    from veilspan.operators import access

    grants = spark.createDataFrame([("p", "s1"), ("p", "s2"), ("q", "s3"), ("p", "s1")], "principal string, source_id string")
    pages = spark.createDataFrame([("s1", "a", "A", "x"), ("s2", "a", "B", "y"), ("s3", "c", "C", "z")], "source_id string, slug string, title string, chunk_text string")
    asks = [(1, "p", "a", "s1"), (2, "p", "a", "__all__"), (3, "p", "c", "s3"), (4, "p", "zz", None), (5, "nobody", "a", None), (6, "p", "c", "s1")]
    got = access.get_page(spark.createDataFrame(asks, "request_id int, principal string, slug string, asked_source string"), grants, pages).collect()
    assert sorted((r["request_id"], r["outcome"], r["title"] or "") for r in got) == [
        (1, "ok", "A"), (2, "ok", "A"), (2, "ok", "B"), (3, "permission_denied", ""), (4, "page_not_found", ""), (5, "permission_denied", ""), (6, "page_not_found", "")
    ]


def test_numbers_of_a_json_object(spark):
    rows = ['{"a":{"n":5},"n":"12","b":true,"x":1,"y":1.5,"z":1e3,"w":null}', '{"n":1,"n":2}', '{"n":1,"n":"s"}', "[1]", "bad", None, '{"q\\"k":3}']
    got = spark.createDataFrame([(r,) for r in rows], "c string").select(audit.numbers_only(F.col("c"))).collect()
    assert [r[0] for r in got] == [{"x": 1.0, "y": 1.5, "z": 1000.0}, {"n": 2.0}, {}, {}, {}, {}, {'q"k': 3.0}]


def test_upserts_are_snapshots_and_writers_are_told_apart(spark, tmp_path):
    path = str(tmp_path / "results")
    ddl = "detector string, eval_set string, caught long"
    assert writers.upsert_results(spark.createDataFrame([("a", "x", 1), ("b", "x", 2)], ddl), path) == 1
    reader = ledger.read_snapshot(spark, path)  # opened before the next write, read after it
    assert writers.upsert_results(spark.createDataFrame([("b", "x", 9), ("c", "y", 3)], ddl), path) == 2
    assert sorted(map(tuple, reader.select("detector", "eval_set", "caught").collect())) == [("a", "x", 1), ("b", "x", 2)]
    now = ledger.read_snapshot(spark, path)
    assert sorted(map(tuple, now.select("detector", "eval_set", "caught").collect())) == [("a", "x", 1), ("b", "x", 9), ("c", "y", 3)]
    assert ledger.read_snapshot(spark, path, 1).count() == 2
    with pytest.raises(ledger.Conflict):  # meant to follow snapshot 1, but another writer did
        ledger.write_snapshot(spark.createDataFrame([("z", "z", 0)], ddl), path, 1)
    assert ledger.latest(spark, path)[0] == 2
    with pytest.raises(ValueError):
        ledger.read_snapshot(spark, str(tmp_path / "none"))


def test_a_writer_that_lost_a_race_begins_again(spark, tmp_path, monkeypatch):
    path, ddl = str(tmp_path / "t"), "detector string, eval_set string, caught long"
    ledger.upsert(spark.createDataFrame([("a", "x", 1)], ddl), path, ["detector", "eval_set"])
    plain, rivals = ledger.write_snapshot, [spark.createDataFrame([("a", "x", 1), ("rival", "x", 5)], ddl)]

    def slow(table, at, after, **notes):
        if rivals:  # another writer is done first
            plain(rivals.pop(), at, after)
        return plain(table, at, after, **notes)

    monkeypatch.setattr(ledger, "write_snapshot", slow)
    assert ledger.upsert(spark.createDataFrame([("a", "x", 7)], ddl), path, ["detector", "eval_set"]) == 3
    assert sorted(map(tuple, ledger.read_snapshot(spark, path).collect())) == [("a", "x", 7), ("rival", "x", 5)]


def test_a_stream_batch_run_twice_is_one_snapshot(spark, tmp_path):
    path, rows = str(tmp_path / "counts"), spark.createDataFrame([("k", 1)], "kind string, n long")
    assert ledger.save_batch(rows, path, 0) and ledger.save_batch(rows, path, 1) and not ledger.save_batch(rows, path, 1) and not ledger.save_batch(rows, path, 0)
    assert ledger.latest(spark, path)[0] == 2 and ledger.read_snapshot(spark, path).count() == 1


def test_a_batch_replayed_adds_nothing_and_order_survives_compaction(spark, tmp_path):
    path, order = str(tmp_path / "log"), ["batch", "place"]
    events = [spark.createDataFrame([(f"{b}-{i}", i) for i in range(50)], "summary string, i int").repartitionByRange(3, "i") for b in range(3)]
    assert [ledger.append_once(events[b], path, b) for b in (0, 2, 1, 1, 0)] == [True, True, True, False, False]
    rows = [r["summary"] for r in ledger.read_appended(spark, path).orderBy(*order).collect()]
    assert rows == [f"{b}-{i}" for b in range(3) for i in range(50)]
    ledger.compact(spark, path, str(tmp_path / "one"))
    assert [r["summary"] for r in spark.read.parquet(str(tmp_path / "one")).orderBy(*order).collect()] == rows


def test_texts_of_a_table_in_one_part_are_rendered_by_several_tasks(spark, tmp_path):
    from veilspan.plans import world
    from veilspan.plans.base import Tables

    spark.range(25_000).selectExpr("id as o_orderkey", "id as o_custkey").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    drafts = world.drafts(Tables(spark, str(tmp_path)))
    assert drafts.groupBy(F.spark_partition_id()).count().agg(F.count("*"), F.sum("count")).first()[:] == (3, 25_000)


def test_held_out_rows_are_judged_once_for_both_sinks(spark, tmp_path):
    from veilspan.sources import writers

    told = spark.sparkContext.accumulator(0)

    @F.udf("struct<protected:array<string>>")
    def row(value):
        told.add(1)
        return None if int(value) % 2 else {"protected": ["x"]}

    lines = spark.range(10).select(F.col("id").cast("string").alias("value")).withColumn("row", row("value"))
    writers.append_heldout(lines, f"{tmp_path}/kept", f"{tmp_path}/rejects")
    assert spark.read.text(f"{tmp_path}/kept").count() == spark.read.json(f"{tmp_path}/rejects").count() == 5
    assert told.value == 10


def test_folders_are_written_by_several_tasks_whatever_their_bytes(spark, tmp_path, monkeypatch):
    from veilspan.sources import writers

    monkeypatch.setattr(writers, "FOLDERS_A_TASK", 10)
    rows = spark.range(60).selectExpr("'M' || id as matter_id", "'{\"client\": \"C' || id || '\"}' as value")
    odd = spark.createDataFrame([("a=b/c", '{"client": "odd"}'), (None, '{"client": "none"}')], "matter_id string, value string")
    root = f"{tmp_path}/own"
    told = []
    monkeypatch.setattr(writers, "_write_local", lambda dealt, *more, f=writers._write_local: told.append(dealt.rdd.getNumPartitions()) or f(dealt, *more))
    writers.write_folders(rows.unionByName(odd), "matter_id", root, "matter.json")
    assert told == [7] and len(os.listdir(root)) == 62
    rows.unionByName(odd).write.partitionBy("matter_id").text(f"{tmp_path}/spark")
    (tmp_path / "own" / "matter.json").write_text('{"client": "beside"}')
    os.makedirs(tmp_path / "own" / "matter_id=M1" / "deeper")
    (tmp_path / "own" / "matter_id=M1" / "deeper" / "matter.json").write_text('{"client": "deeper"}')
    own, theirs = (sorted((r["matter_id"], r["client"]) for r in readers.read_matters(spark, f"{tmp_path}/{x}", "*/*").collect()) for x in ("own", "spark"))
    assert own == theirs and len(own) == 62


def test_folders_are_listed_and_read_by_tasks_as_sparks_readers_read_them(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(readers, "FOLDERS_A_TASK", 5)
    bodies = {
        "a": '{"client":"C","facts":{"names":["N",null]}}', "b two": '[{"client":"1"},{"client":"2"}]', "c+d": '{"client":"plus"}', "k=v%3D": '{"client":"pct"}', "empty": "", "blank": " \n ",
        "bad": '{"client": ', "none": "[]", "type": '{"client":"x","facts":"no"}', ".hid": '{"client":"h"}', "_hid": '{"client":"h"}', "null": "null", "bom": '\ufeff{"client":"bom"}', "broken": '[{"client":"1"},{"cl',
    }
    for name, body in bodies.items():
        os.makedirs(tmp_path / name)
        for file in ("matter.json", "n+o te.md", "_x.md", ".y.md"):
            (tmp_path / name / file).write_text(body)
    (tmp_path / "beside.md").write_text("beside")
    (tmp_path / "matter.json").write_text('{"client":"beside"}')
    os.makedirs(tmp_path / "a" / "deeper")
    (tmp_path / "a" / "deeper" / "matter.json").write_text('{"client":"deeper"}')
    read = (lambda: readers.read_matters(spark, str(tmp_path)), lambda: readers.read_documents(spark, str(tmp_path)), lambda: readers.read_documents(spark, str(tmp_path), "*"))
    own = [f() for f in read]
    assert all("FileScan" not in p or "folders-" in p for p in (x._jdf.queryExecution().executedPlan().toString() for x in own))
    assert all(x.rdd.getNumPartitions() == 3 for x in own)
    monkeypatch.setattr(readers, "_mounted", lambda *_: None)
    for x, f in zip(own, read):
        assert sorted(map(str, x.collect())) == sorted(map(str, f().collect()))


def test_training_set_takes_far_less_disk_than_its_messages(spark, tmp_path):
    from veilspan.sources import writers

    prompt = "Whatever is listed here never leaves the firm. " * 20
    rows = spark.range(500).selectExpr(f"array(struct('system' as role, '{prompt}' as content), struct('user' as role, 'passage ' || id as content)) as messages")
    writers.write_training_set(rows.unionByName(rows), f"{tmp_path}/train")
    assert spark.read.json(f"{tmp_path}/train").selectExpr("messages[1].content as c").groupBy("c").count().where("count = 2").count() == 500
    assert sum(f.stat().st_size for f in (tmp_path / "train").glob("part-*")) < 1000 * len(prompt) / 5


def test_labelled_rows_are_rendered_and_parsed_once(spark, tmp_path):
    from veilspan.plans import training
    from veilspan.plans.base import QUERIES, Tables

    keys = [(1, 5), (1, 5), (2, 6), (7, None), (None, 3)]
    spark.createDataFrame(keys, "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    lines = training._json_lines(Tables(spark, str(tmp_path)))
    assert lines._jdf.queryExecution().optimizedPlan().toString().count(" Best wishes.") == 1
    assert {r["row_id"]: r["count"] for r in lines.groupBy("row_id").count().collect()} == {1: 16, 2: 1, 7: 1}
    blocks = QUERIES["b01_block_parser"](spark, str(tmp_path))
    joins = [x for x in blocks._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join" in x]
    assert joins and not any("regexp_replace" in x for x in joins)
    assert sorted(r["row_id"] for r in blocks.collect()) == [1, 1, 1, 1, 2]
