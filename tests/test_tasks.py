import json

import pytest
from pyspark.sql import functions as F

from tidegraph.functions import scalars
from tidegraph.functions.registry import Registry
from tidegraph.operators import classify, docs, extract, logs, records, session, store, tasks, telemetry, vectors
from tidegraph.sources import files


def value(spark, column, **values):
    return spark.createDataFrame([tuple(values.values()) or (1,)], list(values) or ["x"]).select(column.alias("v")).first()["v"]


def test_registries():
    r = Registry("thing")
    r.register("First", 1, "one", lambda name: name == "other")
    r.register("first", 2)
    r.register("second", 3, "", lambda name: name == "else")
    assert (r.get("FIRST"), r.get("else"), r.names()) == (2, 3, ["first", "second"])
    assert r.describe()[0] == {"name": "first", "description": ""}
    with pytest.raises(ValueError, match="second"):
        r.get("none")
    assert logs.FILTERS.names() == ["analysis", "prod"]
    assert store.STORES.names() == ["parquet"]


def test_tools_are_listed():
    assert len(tasks.TOOLS) == 17
    assert [t.name for t in tasks.TOOLS.values() if t.requires_interaction] == ["request_human_input"]
    assert all(t.read_only and t.description for t in tasks.TOOLS.values())
    assert vectors.selector_parameters(25, 4) == (75, 4, 25)
    assert vectors.selector_parameters(3, 9, 5) == (5, 3, 3)
    assert len(scalars.config_namespace("a", "b")) == 16


def test_external_servers():
    good = {"name": "a", "url": "http://x", "headers": {"k": "${TOKEN} ${NONE}"}, "include_tools": ["^get", "("]}
    found = session.servers(json.dumps({"servers": [good, {"name": "b", "command": "run", "args": ["-m"]}]}), {"TOKEN": "t"})
    assert [(s["name"], s["headers"], s["include_tools"], s["args"]) for s in found] == [("a", {"k": "t ${NONE}"}, ["^get"], []), ("b", {}, [], ["-m"])]
    for bad in (None, "", "no json", "[]", json.dumps({"servers": [good, {"name": "c"}]}), json.dumps({"servers": [{"name": "d", "url": "u", "command": "c"}]}), json.dumps({"servers": [1]})):
        assert session.servers(bad, {}) == []


def test_a_store_of_tables(spark, tmp_path):
    s = store.STORES.get("parquet")(spark, str(tmp_path))
    assert s.ensure("nodes", "id string, name string")
    assert not s.ensure("nodes", "id string, name string")
    new = spark.createDataFrame([("1", "a", {"k": "v"}), (None, "b", None), ("", "b", None)], "id string, name string, metadata map<string,string>")
    made = store.create_nodes(s.read("nodes"), new)
    s.append("nodes", made.select("id", "name"))
    rows = s.read("nodes").collect()
    assert len({r["id"] for r in rows}) == 3
    assert made.filter("name = 'a'").first()["metadata"] == '{"k":"v"}'
    s.replace("nodes", store.delete_by_id(s.read("nodes"), spark.createDataFrame([("1",)], "id string")))
    assert store.get_by_id(s.read("nodes"), "1").count() == 0
    assert s.read("nodes").count() == 2
    assert store.clear_all(s.read("nodes")).count() == 0
    s.ensure("panda_docs", "id string")
    assert store.invalidate_docs(s)
    assert not store.invalidate_docs(s)
    store.log_turns(spark.createDataFrame([("s", 1)], "session string, turn int"), str(tmp_path / "turns"))
    store.log_turns(spark.createDataFrame([("s", 2)], "session string, turn int"), str(tmp_path / "turns"))
    assert spark.read.json(str(tmp_path / "turns")).count() == 2


def test_inputs_of_evaluations(spark, tmp_path):
    ask = lambda rows, names: {(r["value"], r["is_task"]) for r in store.asked_errors(spark.createDataFrame(rows, names)).collect()}
    assert ask([(1, "e1"), (2, None)], "jediTaskID int, errorDialog string") == {("e1", False), ("", False)}
    assert ask([(11,), (12,)], "taskID int") == {("11", True), ("12", True)}
    (tmp_path / "a.json").write_text(json.dumps({"error": "x", "errorDialog_embedding": [1.0]}))
    (tmp_path / "b.json").write_text(json.dumps({"error": "y"}))
    (tmp_path / "c.json").write_text("{")
    got = store.approved_entries(spark, str(tmp_path), "error string, errorDialog_embedding array<double>").collect()
    assert [(r["error"], r["file"].rpartition("/")[2]) for r in got] == [("x", "a.json")]


def test_novel_drafts_and_feature_names(spark):
    rows = spark.createDataFrame([(7, {"errorDialog": "e"}, "cause", "fix", "why", None, ["s1", "s2"])], "task_id long, task map<string,string>, root_cause string, resolution string, explanation string, hints array<string>, unmatched array<string>")
    r = store.novel_drafts(rows, "now").first()
    assert r["review_hint"].startswith("Novel incident — unmatched symptoms: s1, s2.")
    assert (r["email_body"]["procedure"], r["errorDialog_canonical"], r["reviewed"]) == ([], "e", False)
    assert value(spark, records.tool_text(F.lit("n"), F.lit("d"), F.array(F.lit("a"), F.lit("b")))) == "n: d (args: a, b)"
    assert value(spark, records.page_url(F.lit("docs/source/a/b.rst"), "docs/source/", "http://x/")) == "http://x/a/b.html"
    assert value(spark, scalars.gib(F.lit(3 << 29))) == "1.5 GiB"
    assert value(spark, classify.doc_category(F.lit(True), F.lit(2), F.lit(None).cast("string"), F.lit("unclear"))) == "unclear"
    text = session.mail_text(F.lit(" talk "), F.lit("c "), F.lit(None).cast("string"))
    assert value(spark, text) == "talk\n\nCause: c"
    made = session.extraction_input(F.lit("mail"), F.create_map(F.lit("a"), F.lit("1")), F.create_map().cast("map<string,string>"), F.create_map(F.lit("q"), F.lit("hint")), F.create_map(F.lit("l"), F.lit("log"), F.lit("m"), F.lit(" ")))
    assert value(spark, made) == 'EMAIL THREAD:\nmail\n\nTASK DATA:\n{"a":"1"}\n\nDOMAIN DOCUMENTATION (PanDA system knowledge):\nhint\n\nTASK-LEVEL LOG (l):\nlog'


def test_sessions(spark):
    initial = spark.createDataFrame([(1, "c0", 0.4)], "task_id int, cause string, confidence double")
    causes = spark.createDataFrame([(1, f"c{i}", i) for i in range(1, 6)], "task_id int, name string, rank int")
    novel = spark.createDataFrame([(1, f"s{i}", i) for i in range(7)], "task_id int, name string, place int")
    found = extract.leads(initial, causes, novel).first()["leads"]
    assert len(found) == 9
    assert found[0] == "Initial root cause hypothesis (confidence 0.4): c0 — fetch evidence to confirm or refute."
    assert found[-1].startswith("Novel symptom with no graph DB precedent: s4")
    nodes = spark.createDataFrame([("g", "Cause", "c", 0), ("g", "Symptom", "s", 1)], "graph_id string, node_type string, name string, place int")
    edges = spark.createDataFrame([("g", "s", "indicate", "c")], "graph_id string, src string, rel string, tgt string")
    n, e = extract.append_partial(nodes, edges, nodes.unionByName(spark.createDataFrame([("g", "Cause", "d", 2), ("g", "Cause", "d", 3)], nodes.schema)), edges)
    assert (n.count(), e.count()) == (3, 2)  # edges are added, repeated or not
    told = spark.createDataFrame([("g", "Symptom", "s", "long", {"raw_description": "raw"}), ("g", "Cause", "c", "x", {}), ("g", "Task_Context", "t", " ", {})], "graph_id string, node_type string, name string, description string, metadata map<string,string>")
    points = extract.vector_points(told, spark.createDataFrame([("g", "story")], "graph_id string, summary string")).collect()
    assert {(p["section"], p["content"]) for p in points} == {("Symptom", "raw"), ("Summary", "story")}
    made = extract.rewrite_batches(spark.createDataFrame([("a",), ("b",), ("a",), (None,), ("c",)], "t string").coalesce(1), "t", lambda x: [y.upper() for y in x] if len(x) < 3 else [], 2)
    assert {(r["text"], r["new"]) for r in made.collect()} == {("a", "A"), ("b", "B"), ("c", "C")}
    policies = spark.createDataFrame([("abc", "p1"), ("def", "p2")], "hash string, name string")
    assert [r["name"] for r in records.revoke(policies, "ab").collect()] == ["p2"]
    assert records.revoke(policies).count() == 0
    runs = spark.createDataFrame([(1, ["a", "b"], ["b"]), (2, [], ["x"])], "run int, used array<string>, shown array<string>")
    assert [r["recall"] for r in records.used_of_shown(runs).orderBy("run").collect()] == [0.5, None]
    tools = spark.createDataFrame([("a", True, False), ("b", True, True), ("c", False, False)], "name string, read_only boolean, requires_interaction boolean")
    assert [r["name"] for r in records.explorer_tools(tools, False).collect()] == ["a"]
    assert [r["name"] for r in session.allowed_names(tools, ["a|b", "c"], ["^c$"]).orderBy("name").collect()] == ["a", "b"]
    results, texts = session.stored_results(spark.createDataFrame([("s", "k", "v")], "strategy string, key string, value string"), spark.createDataFrame([("l", "x" * 5000)], "name string, text string"))
    assert results.first()["label"] == "stored:s:k"
    assert len(texts.first()["text"]) == 2000
    rules = records.split_rule_hints(spark.createDataFrame([(1, "A=1, B=2,bad,A=3,=4")], "task_id int, splitRule string"), spark.createDataFrame([("A", "a rule"), ("C", "c")], "name string, description string"))
    assert [tuple(r) for r in rules.collect()] == [(1, 0, "A", "a rule")]


def test_similar_tasks_and_files(spark, tmp_path):
    rows = [(1, "finished", "u", "2024-05-02"), (2, "done", "u", "2024-05-03"), (3, "failed", "u", "2024-05-04"), (4, "done", "v", "2024-05-05"), (5, "done", "u", None), (6, "done", "u", "2024-04-01")]
    t = spark.createDataFrame(rows, "task_id int, status string, userName string, modified string")
    assert [r["task_id"] for r in files.similar_tasks(t, {"userName": "u", "other": None}, ("userName", "other")).collect()] == [2, 1, 6, 5]
    assert [r["task_id"] for r in files.similar_tasks(t, {"userName": "u"}, ("userName",), since="2024-05-01").collect()] == [2, 1]
    import gzip

    (tmp_path / "logs").mkdir()
    (tmp_path / "logs" / "a.log").write_text("x\ny")
    (tmp_path / "logs" / "b.log.gz").write_bytes(gzip.compress(b"z"))
    assert sorted(r["text"] for r in files.read_logs(spark, str(tmp_path / "logs")).collect()) == ["x\ny", "z"]
    results = spark.createDataFrame([("a b", True, False, 1), ("c", True, True, 2), ("d", False, False, 3)], "label string, ok boolean, novel boolean, v int")
    assert tuple(files.write_results(results, str(tmp_path / "out")).first()) == (1, 1, 1, 1)
    assert spark.read.json(str(tmp_path / "out" / "results")).count() == 2
    files.write_samples(spark.createDataFrame([(0, "cpu", None)], "offset_s int, state string, size int"), str(tmp_path / "tsv"))
    assert spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "tsv")).first()["size"] is None


def test_logs_of_tasks(spark):
    funnel = ["2024-01-01 10:00:00 : initial 100 candidates", " skip site=S1 low criteria=-memory", "x 40 candidates passed memory check", "x 5 candidates for final check", "===== Job brokerage summary =====", " 100 -> 40 candidates, 60% cut : memory check", " 40 -> 5 candidates, 88% cut : final check"]
    asked = spark.createDataFrame([(1, '<a href="u1">l</a><a href="u2">m</a>', "managed", "S1", "S9"), (2, "plain", "user", None, None)], "task_id int, error string, label string, site string, includedSite string")
    texts = spark.createDataFrame([("u1", "\n".join(funnel)), ("u2", "an ERROR here\nfine")], "url string, text string")
    stages, fates = tasks.funnels(asked, texts)
    assert {(r["url"], r["name"]) for r in stages.collect()} == {("u1", "memory check"), ("u1", "final check")}
    assert [(r["task_id"], r["site"], r["filtered_at"]) for r in fates.collect()] == [(1, "S1", "memory check")]
    shown = {r["url"]: r["text"] for r in tasks.embedded_logs(asked, texts).collect()}
    assert "Filter stage: final check" in shown["u1"]
    assert shown["u2"] == "an ERROR here\nfine"
    jobs = spark.createDataFrame([(1, 10, "finished"), (1, 11, "closed"), (2, 20, "finished")], "task_id int, job_id int, status string")
    kept = spark.createDataFrame([(11, "payload.stdout", "a\nERROR x"), (20, "payload.stdout", "a\nb")], "job_id int, filename string, text string")
    pairs = spark.createDataFrame([(1, 2), (2, 1)], "task_id int, reference_id int")
    got = {r["task_id"]: r for r in tasks.compared_logs(pairs, jobs, kept).collect()}
    assert got[1]["error"] is None
    assert got[1]["failed_lines"] == 2
    assert got[2]["error"] == "no failed job's log"
    assert value(spark, tasks.log_url("http://m", F.lit(5))) == "http://m/filebrowser/?pandaid=5&json&filename=payload.stdout"


def test_report_of_a_job(spark):
    gib = 1 << 30
    rows = [("h", i * 15, s, 2 * gib, v * gib, 24000, 20000, 4000, 0, m, 2 * m) for i, (s, v, m) in enumerate([("gpu-partial", 1, 10), ("gpu-partial", 1, 40), ("unloaded", 0, 0), ("cpu", 0, 0), ("cpu", 0, 0)])]
    rows += [("idle", 0, "gpu-full", gib, gib, None, None, None, 0, 1, 2), ("none", 3700, "unreachable", 0, 0, None, None, None, None, None, None)]
    names = "host string, offset_s long, state string, size long, size_vram long, gpu_total_mib long, gpu_used_mib long, gpu_free_mib long, sm_min long, sm_mean long, sm_max long"
    text = {r["host"]: r["text"].split("\n") for r in telemetry.report(spark.createDataFrame(rows, names)).collect()}
    assert text["h"] == [
        "accelerator over the job: 5 samples spanning 1m00s", "  gpu-partial      2   40%", "  cpu              2   40%", "  unloaded         1   20%", "  transitions: gpu-partial -> unloaded -> cpu", "  first non-GPU sample: unloaded at +0m30s",
        "  verdict: ollama was on the GPU for 40% of samples", "  compute: sm 0-80% (mean 10%) — device-wide, all processes", "  device VRAM: min free 4000 MiB of 24000 MiB total (max used 20000 MiB, all processes)", "  model footprint: 2.0 GiB total, peak 1.0 GiB in VRAM", "timeline:",
        "  0m00s-0m15s     gpu-partial     2 smp  vram 1.0 GiB    sm 0-80% (mean 25%)", "  0m30s-0m30s     unloaded        1 smp  vram —          sm 0-0% (mean 0%)", "  0m45s-1m00s     cpu             2 smp  vram —          sm 0-0% (mean 0%)",
    ]
    assert "  verdict: resident on the GPU but NO COMPUTE observed (sm never exceeded 2%)" in text["idle"]
    assert "  verdict: the GPU was NEVER used by ollama during this job" in text["none"]
    assert "  compute: sm not measured — device-wide, all processes" in text["none"]


def test_document_index(spark):
    tree = spark.createDataFrame([("docs/source/a.rst", "blob", "1"), ("docs/source/b.rst", "tree", "2"), ("x.rst", "blob", "3"), ("docs/source/skip.rst", "blob", "4")], "path string, type string, sha string")
    listed = docs.listed_pages(tree, excluded=("docs/source/skip.rst",))
    assert [r["path"] for r in listed.collect()] == ["docs/source/a.rst"]
    meta = docs.index_meta(listed, "s", "now").first()
    assert (meta["file_shas"], meta["system_summary"]) == ({"docs/source/a.rst": "1"}, None)
    assert docs.index_meta(listed.limit(0), "s", "now", "text").first()["file_shas"] is None
    nodes = spark.createDataFrame([("n", "u#a", "T", "S")], "id string, url string, title string, summary string")
    point = docs.embedded(nodes, lambda text: F.array(F.length(text).cast("double"))).first()
    assert (point["node_id"], point["text"], point["embedding"]) == ("n", "T S", [3.0])
    hits = spark.createDataFrame([(1, "n", 0.5), (1, "gone", 0.9)], "qid int, node_id string, score double")
    assert [r["url"] for r in docs.known_hits(hits, nodes).collect()] == ["u#a"]
    assert docs.fetched_pages(spark.createDataFrame([("a", ""), ("b", None), ("c", "x")], "path string, html string")).count() == 1
    assert value(spark, vectors.canonical_id(F.lit("k"), F.lit("l"))) == value(spark, vectors.canonical_id(F.lit("k"), F.lit("l")))
    kept = vectors.add_labels(spark.createDataFrame([("i", "old", True)], "id string, label string, auto_generated boolean"), spark.createDataFrame([("k", "new")], "kind string, label string"))
    assert {(r["label"], r["auto_generated"]) for r in kept.collect()} == {("old", True), ("new", False)}
    points = spark.createDataFrame([("a", [1.0, 0.0], "s"), ("b", [-1.0, 0.0], "s"), ("c", [1.0, 0.0], "t")], "id string, embedding array<double>, section string")
    assert [r["id"] for r in vectors.list_labels(points, [1.0, 0.0], "s").collect()] == ["a"]
