import hashlib
import hmac
import json
import re
import uuid

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tidegraph.functions import scalars
from tidegraph.operators import classify, docs, graph, logs, privacy, telemetry, vectors
from tidegraph.sources import files

OBS = "src_type string, src string, rel string, tgt_type string, tgt string, graph_id string, confidence double, parameters string, seq long"


def one(spark, column, **values):
    df = spark.createDataFrame([Row(**values)])
    return df.select(column.alias("x")).first()["x"]


# functions


def test_identifiers_equal_the_standard(spark):
    for name in ("", "graph:1:failed", "é日"):
        assert one(spark, scalars.uuid5(F.col("a")), a=name) == str(uuid.uuid5(uuid.NAMESPACE_URL, name))
        assert one(spark, scalars.uuid5(F.col("a"), scalars.NAMESPACE_OID), a=name) == str(uuid.uuid5(uuid.NAMESPACE_OID, name))
        for key in ("k", "long" * 40):
            assert one(spark, scalars.hmac_sha256(key, F.col("a")), a=name) == hmac.new(key.encode(), name.encode(), hashlib.sha256).hexdigest()


def test_scalars(spark):
    assert one(spark, scalars.safe_filename(F.col("a")), a="/a b//ü.json/") == "a_b_.json"
    assert [one(spark, scalars.token_estimate(F.col("a")), a="x" * n) for n in (0, 1, 3, 4)] == [0, 1, 1, 2]
    assert [one(spark, scalars.duration(F.col("a")), a=s) for s in (-1, 0, 45, 182, 3720)] == [None, "0s", "45s", "3m2s", "1h2m"]
    assert [one(spark, scalars.offset(F.col("a")), a=s) for s in (182, 3900)] == ["3m02s", "1h05m"]
    assert one(spark, scalars.gist(F.col("a")), a=" a \n b ") == "a b"
    assert len(one(spark, scalars.gist(F.col("a")), a="x" * 500)) == 200
    assert one(spark, scalars.hrefs(F.col("a")), a="""<a class=x href="u1">b</a><A HREF='u2'></A><link href="no">""") == ["u1", "u2"]
    assert one(spark, scalars.tool_references(F.col("a")), a="tools.b(tools.a()); tools.b()") == ["a", "b"]
    assert one(spark, scalars.procedure_name(F.array(F.lit("b"), F.lit("a"))), a=1) == "proc__a__b"
    assert len(one(spark, scalars.procedure_name(F.array(F.lit("b" * 80))), a=1)) == 60
    assert str(one(spark, scalars.parse_time(F.col("a")), a="2024-05-01T10:00:00")).startswith("2024-05-01 10:00:00")
    assert one(spark, scalars.parse_time(F.col("a")), a="soon") is None
    assert one(spark, scalars.code_hash(F.col("a")), a="x  \n\n y\n") == hashlib.sha256(b"x\n y").hexdigest()
    assert one(spark, scalars.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0))), a=1) is None


# graph


@pytest.fixture
def observations(spark):
    rows = [
        ("Symptom", "s1", "indicate", "Cause", "c1", "g1", 0.5, "p1", 1),
        ("Symptom", "s1", "indicate", "Cause", "c1", "g1", 0.9, "p2", 2),
        ("Symptom", "s1", "indicate", "Cause", "c1", "g2", 0.7, "p3", 3),
        ("Symptom", "s1", "indicate", "Cause", "c1", " ", 0.7, None, 4),
        ("Environment", "e1", "contribute_to", "Cause", "c1", "g1", 0.2, None, 5),
        ("Symptom", "s2", "indicate", "Cause", "c2", "g2", 0.2, None, 6),
        ("Symptom", "s2", "indicate", "Cause", "gone", "g2", 0.2, None, 7),
    ]
    return spark.createDataFrame(rows, OBS)


@pytest.fixture
def nodes(spark):
    rows = [("Symptom", "s1"), ("Symptom", "s2"), ("Environment", "e1"), ("Cause", "c1"), ("Cause", "c2"), ("Resolution", "alone")]
    return spark.createDataFrame(rows, "node_type string, name string")


def test_a_graph_counts_once_per_edge(observations, nodes):
    got = {(r["src"], r["tgt"]): r for r in graph.merge_edges(observations, nodes).collect()}
    assert set(got) == {("s1", "c1"), ("e1", "c1"), ("s2", "c2")}
    assert got["s1", "c1"]["frequency"] == 2
    assert got["s1", "c1"]["confidence"] == pytest.approx((0.5 + 0.7 + 0.7) / 3)
    asked = graph.provenance(observations, observations.filter("src = 's1'").select(*graph.EDGE).distinct()).collect()
    assert [(r["graph_ids"], r["parameters"]) for r in asked] == [(["g1", "g2"], ["p1", "p3"])]


def test_removing_a_graph_drops_isolated_nodes(observations, nodes):
    rest, left, counts = graph.remove_graph(observations, nodes, ["g1"])
    assert {r["name"] for r in left.collect()} == {"s1", "s2", "c1", "c2"}
    assert counts.first() == Row(rels_affected=2, nodes_removed=2)
    assert rest.filter("graph_id = 'g1'").count() == 0


def test_first_writer_wins(spark):
    old = spark.createDataFrame([("Cause", "c", "old")], "node_type string, name string, description string")
    new = spark.createDataFrame([("Cause", "c", "new", 1), ("Cause", "d", "second", 3), ("Cause", "d", "first", 2)], "node_type string, name string, description string, seq long")
    assert {(r["name"], r["description"]) for r in graph.merge_nodes(old, new).collect()} == {("c", "old"), ("d", "first")}
    assert {(r["name"], r["status"]) for r in graph.diff_nodes(new.drop("seq").distinct(), old).collect()} == {("c", "merge"), ("d", "new")}


def test_causes_are_ranked_by_kinds_of_clues(spark, observations):
    causes = spark.createDataFrame([("c1", 3, 0.5), ("c2", 9, 0.9)], "name string, frequency long, confidence double")
    clues = spark.createDataFrame([("Symptom", "s1"), ("Symptom", "s2"), ("Environment", "e1"), ("Component", None)], "clue_type string, clue string")
    solved = spark.createDataFrame([("c1", "fix")], "cause string, resolution string")
    got = graph.find_causes(observations, causes, clues, solved).collect()
    assert [(r["name"], r["match_score"], r["resolutions"]) for r in got] == [("c1", 2, ["fix"]), ("c2", 1, [])]
    assert graph.find_causes(observations, causes, clues.limit(0)).count() == 0


def test_procedures(spark):
    edges = spark.createDataFrame([("c1", "investigated_by", "p1", 3, ["x"]), ("c2", "investigated_by", "p2", None, None), ("c3", "solved_by", "r", 9, None)], "src string, rel string, tgt string, frequency int, parameters array<string>")
    meta = lambda **k: json.dumps(k)
    procedures = spark.createDataFrame([("p1", meta(signature=["a", "b"], has_side_effects=True)), ("p2", meta(status="tentative")), ("p3", "not json")], "name string, metadata string")
    got = graph.find_procedures(edges, procedures, ["c1", "c2"]).collect()
    assert [(r["name"], r["signature"], r["external_access"], r["frequency"]) for r in got] == [("p1", ["a", "b"], True, 3)]
    assert [r["name"] for r in graph.find_procedures(edges, procedures, ["c1", "c2"], True).collect()] == ["p1", "p2"]
    assert [(r["name"], r["frequency"], r["cause_names"]) for r in graph.all_procedures(edges, procedures).collect()] == [("p1", 3, ["c1"]), ("p3", 0, [])]
    assert [r["name"] for r in graph.all_procedures(edges, procedures, limit=1).collect()] == ["p1"]


def test_links_within_a_graph(spark):
    nodes = spark.createDataFrame([("g", "Symptom", "s", None), ("g", "Cause", "c", None), ("g", "Resolution", "r", None), ("h", "Symptom", "t", None), ("g", "Task_Feature", "f", ["cpu"]), ("g", "Task_Feature", "k", ["context"])], "graph_id string, node_type string, name string, concepts array<string>")
    edges = spark.createDataFrame([("g", "s", "indicate", "c")], "graph_id string, src string, rel string, tgt string")
    got = {(r["src"], r["rel"], r["tgt"]) for r in graph.reconcile_links(nodes, edges).collect()}
    assert got == {("c", "solved_by", "r")}
    assert [(r["src"], r["tgt"]) for r in graph.concept_edges(nodes, edges, ["cpu", "disk"], "Cause", "contribute_to", 0.9).collect()] == [("f", "c")]
    assert [(r["src"], r["tgt"]) for r in graph.concept_edges(nodes, edges, ["context"], "Symptom", "associated_with", 1.0).collect()] == [("k", "s")]
    assert {r["graph_id"]: r["missing"] for r in graph.missing_parts(nodes).collect()} == {"g": ["Procedure"], "h": ["Cause", "Procedure"]}
    seen, _ = graph.reviewed(nodes.withColumn("description", F.lit("d" * 200)), edges)
    assert {r["name"] for r in seen.collect()} == {"s", "c", "r", "t", "f"}


def test_chains_end(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (9, None)], "id long, next long")
    starts = spark.createDataFrame([(1,), (9,)], "id long")
    assert sorted(tuple(r) for r in graph.chain(links, starts, 5).collect()) == [(1, 0, 1), (1, 1, 2), (1, 2, 3), (9, 0, 9)]


# vectors


def test_search_filters_before_it_scores(spark):
    rows = [(1, [1.0, 0.0], "a"), (2, [1.0, 0.1], "b"), (3, [0.0, 1.0], "a"), (4, [0.0, 0.0], "a"), (5, [2.0, 0.0], "a")]
    points = spark.createDataFrame(rows, "id long, embedding array<double>, section string")
    assert [r["id"] for r in vectors.search(points, [1.0, 0.0], section="a").collect()] == [1, 5]
    q = spark.createDataFrame([(7, [1.0, 0.0], "a"), (8, None, "a")], "qid long, embedding array<double>, section string")
    assert [(r["qid"], r["id"], r["rank"]) for r in vectors.batch_search(points, q, 2).orderBy("rank").collect()] == [(7, 1, 1), (7, 5, 2)]
    assert vectors.batch_search(points, q.limit(0), 2).count() == 0


def test_clusters_open_in_order(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.9, 0.45]), (3, [0.6, 0.8]), (4, [0.0, 1.0])]
    items = spark.createDataFrame([(i, v, "k") for i, v in rows], "id long, embedding array<double>, section string")
    assert {r["id"]: r["opener"] for r in vectors.greedy_clusters(items, 0.85).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}


def test_canonical_labels(spark):
    labels = spark.createDataFrame([("e", 1, "A1", "disk full"), ("e", 2, "A2", "full disk"), ("e", 3, "A3", "other"), ("e", 4, "A4", "disk full"), ("f", 5, "A5", "full disk")], "kind string, seq long, raw string, label string")
    embed = lambda s: [s.count(c) for c in "adefhiklorstu"]
    got = {r["seq"]: (r["canonical"], r["is_new"]) for r in vectors.canonicalise(labels, embed, 0.95).collect()}
    assert got == {1: ("disk full", True), 2: ("disk full", False), 3: ("other", True), 4: ("disk full", False), 5: ("full disk", True)}


def test_lists_are_merged_and_packed(spark):
    a = spark.createDataFrame([("k", n, i) for i, n in enumerate("abcd")], "key string, name string, pos int")
    b = spark.createDataFrame([("k", n, i) for i, n in enumerate("xyz")], "key string, name string, pos int")
    got = [r["name"] for r in vectors.merge_sources(a, b, 2).orderBy("pos").collect()]
    assert got[:4] == ["a", "x", "b", "y"]
    assert got == ["a", "x", "b", "y", "c", "d", "z"]
    tools = spark.createDataFrame([("k", "t1", 0, 50, 1), ("k", "t2", 1, 60, 30), ("k", "t3", 2, 10, 90), ("k", "t4", 3, 10, 20)], "key string, name string, pos long, full long, compact long")
    assert {r["name"]: r["tier"] for r in vectors.pack(tools, 100).collect()} == {"t1": "full", "t2": "compact", "t4": "compact"}
    assert [r["name"] for r in vectors.pack(tools, 10).collect()] == ["t1"]


def test_upsert_and_recall(spark):
    old = spark.createDataFrame([(1, "a", 5), (2, "b", 5)], "id long, v string, seq long")
    new = spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, "e", 1)], "id long, v string, seq long")
    assert {(r["id"], r["v"]) for r in vectors.keep_last(old, new).collect()} == {(1, "a"), (2, "d"), (3, "e")}
    want = spark.createDataFrame([(1, 1), (1, 2), (2, 3)], "qid long, id long")
    found = spark.createDataFrame([(1, 1), (1, 9)], "qid long, id long")
    assert {r["qid"]: r["recall"] for r in vectors.recall(want, found).collect()} == {1: 0.5, 2: 0.0}


# records


@pytest.mark.parametrize(("key", "raw", "want"), [("ramCount", "1024", "1-2GB"), ("ramCount", "1500", "1-2GB"), ("ramCount", "256", "<512MB"), ("walltime", "7200", "1-6h"), ("diskIO", "high", "high"), ("ioIntensity", "NaN", "high(>1000)"), ("outDiskCount", "1e9", ">100GB"), ("cpuTime", None, None)])
def test_buckets(spark, key, raw, want):
    df = spark.createDataFrame([(raw,)], "a string")
    assert df.select(classify.bucket(key, F.col("a")).alias("x")).first()["x"] == want


def test_records_become_nodes(spark):
    task = {"errorDialog": "<a>x</a> job  failed", "taskPriority": "9", "taskName": "free text", "splitRule": "AT=1,badentry,NG=10", "status": " fAILED ", "cpuTime": "60", "userName": "me", "vo": "", "other": "x", "coreCount": None}
    rows = spark.createDataFrame([(1, task, {"load": "high"})], "task_id long, task map<string,string>, extra map<string,string>")
    got = {r["name"]: r for r in classify.classify(rows, "salt", "extra").collect()}
    token = hmac.new(b"salt", b"userName:me", hashlib.sha256).hexdigest()[:8]
    assert set(got) == {"x job failed", "taskPriority=9", "taskName", "splitRule:AT=1", "splitRule:NG=10", "TaskStatusFailed", "cpuTime=<1h", f"userName=user-{token}", "load=high"}
    assert got["cpuTime=<1h"]["concepts"] == ["cpu", "walltime"]
    assert got["splitRule:NG=10"]["value"] == "10"
    assert {r["node_type"] for r in got.values()} == {"Symptom", "Task_Feature", "Task_Context"}


def test_command_lines(spark):
    assert classify.parse_command('run --exec "a b" --out=x -v -abc --n 3 --n 4 ds') == {"a": "true", "b": "true", "c": "true", "exec": "a b", "n": "4", "out": "x", "v": "true", "positional_args": "run ds"}
    assert classify.parse_command('run "open') == {"positional_args": 'run "open'}
    assert classify.parse_command("-k=value -x=a=b --y= -- next") == {"k": "value", "x": "a=b", "y": "", "positional_args": "next"}
    assert classify.parse_command("-a -b --c -") == {"a": "true", "b": "true", "c": "true", "positional_args": "-"}
    assert classify.parse_command("--=v -v -1") == {"": "v", "v": "true", "1": "true"}
    got = classify.command_options(spark.createDataFrame([("x -k v",), (None,)], "c string"), "c").collect()
    assert [r["options"] for r in got] == [{"k": "v", "positional_args": "x"}, {}]


def test_errors_are_grouped(spark):
    rows = spark.createDataFrame([(1, "job 123 failed at 1.5"), (2, "job 7 failed at 22.5"), (3, "<b>other</b>")], "seq long, error string")
    got = classify.error_clusters(rows).collect()
    assert [(r["normalised"], r["n"], r["representative"]) for r in got] == [("job <INT> failed at <FLOAT>", 2, "job 7 failed at 22.5"), ("other", 1, "<b>other</b>")]
    assert one(spark, classify.site_list(F.col("a"), F.col("b")), a="A", b="B, A ,C") == ["A", "B", "C"]
    assert one(spark, classify.identifiers(F.col("a")), a="use task_id and taskId, task_id") == ["task_id", "taskId"]
    assert one(spark, classify.tolerant_json(F.col("a"), "x int"), a='```json\n{"x": 1}\n```')["x"] == 1


def test_privacy(spark):
    assert [privacy.prefix(x) for x in ("prodUserID", "userName", "ID", "workingGroupName")] == ["produser", "user", "id", "workingg"]
    m = F.create_map(F.lit("userName"), F.lit(None).cast("string"), F.lit("x"), F.lit("y"))
    assert one(spark, privacy.pseudonymise(m, "s"), a=1) == {"userName": None, "x": "y"}
    assert one(spark, privacy.redact(m), a=1) == {"userName": "<redacted>", "x": "y"}
    assert privacy.sensitive_fields(["a"], "b, c,")[-3:] == ["prodUserID", "prodUserName", "userName"]


# logs


def lines_of(spark, *texts):
    return logs.split_lines(spark.createDataFrame(list(enumerate(texts)), "log_id long, text string"))


def plain_filter(text, context=3, most=300, head=20, tail=50):
    signal = re.compile(logs.SIGNAL.replace("(?iU)", ""), re.IGNORECASE)
    noise = re.compile(logs.NOISE, re.IGNORECASE)
    rows = text.splitlines()
    keep = {j for i, x in enumerate(rows) if signal.search(x) for j in range(max(0, i - context), min(len(rows), i + context + 1))} or set(range(len(rows)))
    out, seen, blank = [], set(), False
    for i in sorted(keep):
        norm = noise.sub("", rows[i]).strip()
        if norm == "":
            if not blank:
                out.append(rows[i])
            blank = True
        elif norm not in seen:
            seen.add(norm)
            out.append(rows[i])
            blank = False
    if len(out) > most:
        out = [*out[:head], f"... ({len(out) - head - tail} lines omitted) ...", *out[-tail:]]
    return "\n".join(out)


def test_log_filter(spark):
    noisy = "\n".join(["plain"] * 10 + ["2024-01-01 10:00:00 ERROR 12345 bad"] + [f"after {i}" for i in range(9)] + ["2024-02-02 11:00:00 ERROR 99999 bad", "", "", "x"])
    long = "\n".join(f"error number {i % 977} of {'ab' * (i % 13)}" for i in range(900))
    texts = [noisy, long, "only\nplain\nplain\n\n\nlines\n", "", "fail\r\nnext\rlast"]
    got = {r["log_id"]: r["text"] for r in logs.filtered_text(lines_of(spark, *texts)).collect()}
    assert got == {i: plain_filter(t) for i, t in enumerate(texts) if t}


def test_log_summary(spark):
    text = "2026-05-05 09:00:00 start\n=== pre job ===\nok\n2026-05-05 09:52:25 IOException here\n==== execute ====\n\tlast words \n\n"
    r = logs.summarise(lines_of(spark, text), tail=2).first()
    assert r["sections_seen"] == ["pre job", "execute"]
    assert (r["last_section_marker"], r["last_timestamp"], r["error_lines"]) == ("execute", "2026-05-05 09:52:25", ["2026-05-05 09:52:25 IOException here"])
    assert r["last_meaningful_action"].strip() == "last words"
    assert r["total_lines"] == 7
    folded = logs.fold_runs(lines_of(spark, "read '/a/b'\nread '/c'\nend\nread 'x'")).orderBy("run").collect()
    assert [(x["first"], x["last"]) for x in folded] == [(0, 1), (2, 2), (3, 3)]


FUNNEL = """12:00 : initial 100 candidates
12:00 : skip site=S1 no room criteria=-disk
12:01 : 40 candidates passed disk check
12:01 : skip site=S2 low memory criteria=-lowmemory
12:01 : skip site=S3 high memory criteria=-highmemory
12:02 : 5 candidates (5 with AUTO) passed memory check
12:03 : skip site=S4 final reason criteria=-final
===== Job brokerage summary =====
100 ->  40 candidates,  60% cut : disk check
 40 ->   5 candidates,  87.5% cut : memory check
  5 ->   0 candidates, 100% cut : final check
no candidates"""


def test_funnels(spark):
    stages, fates = logs.parse_funnel(lines_of(spark, FUNNEL, "no header\n100 -> 40 candidates, 60% cut : x"))
    got = [(r["name"], r["before"], r["after"], r["cut_pct"], r["criteria_seen"]) for r in stages.orderBy("stage").collect()]
    assert got == [("disk check", 100, 40, 60, ["-disk"]), ("memory check", 40, 5, 87, ["-highmemory", "-lowmemory"]), ("final check", 5, 0, 100, ["-final"])]
    assert {(r["initial"], r["final"]) for r in stages.collect()} == {(100, 0)}
    assert {(r["site"], r["filtered_at"]) for r in fates.collect()} == {("S1", "disk check"), ("S2", "memory check"), ("S3", "memory check"), ("S4", "final check")}


def test_funnels_send_nothing_to_the_driver(spark):
    lines = spark.range(2000).select(F.col("id").alias("log_id"), F.posexplode(F.split(F.lit(FUNNEL), "\n")).alias("line_no", "line"))
    stages, fates = logs.parse_funnel(lines)
    assert (stages.count(), fates.count()) == (6000, 8000)
    for df in (stages, fates):  # lines spread from a small table are planned as if they were as small
        df.collect()
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def test_funnel_stages_named_alike_and_counts_told_again(spark):
    first = "initial 9 candidates\nskip site=A r criteria=-x\n4 candidates passed\n9 candidates passed\nskip site=B r criteria=-y\nskip site=A s criteria=-z\nfinal candidates: 7\n== skip\n=== Job brokerage summary ===\n9 -> 4 candidates, 1% cut : m\n4 -> 3 candidates, 2% cut : n\n3 -> 2 candidates, 3% cut : m"
    last = first.replace("final candidates: 7", "7 candidates passed") + "\nfinal candidates: 1\nfinal candidates: 5\ninitial 8 candidates\nskip site=C r criteria=-x"
    stages, fates = logs.parse_funnel(lines_of(spark, first, last, first.replace("===", "==")))
    got = [(r["log_id"], r["stage"], r["name"], r["criteria_seen"], r["initial"], r["final"]) for r in stages.orderBy("log_id", "stage").collect()]
    rows = [(0, "m", ["-x"]), (1, "n", ["-y", "-z"]), (2, "m", ["-x"])]
    assert got == [(k, *row, 9, final) for k, final in ((0, 2), (1, 1)) for row in rows]
    assert sorted((r["log_id"], r["site"], r["filtered_at"], r["reason"]) for r in fates.collect()) == [(k, *f) for k in (0, 1) for f in (("A", "m", "r"), ("B", "n", "r"))]


def test_keyword_windows(spark):
    text = "\n".join(["a", "b", "x", "x", "x", "a b", "y", "b", "a"] + ["z"] * 20)
    got = logs.keyword_windows(lines_of(spark, text), ("A", "b"), span=5, around=2).collect()
    assert [(r["line"], r["context"].count("\n") + 1) for r in got] == [(1, 7), (6, 9)]
    assert logs.keyword_windows(lines_of(spark, text), ("z",), span=5, most=2).count() == 2


# documents


def test_sections(spark):
    html = "<html><body><div role=main><h1>Top</h1><section id=a><h2>A</h2>text a<section id=b><h3>B</h3>text b</section>more</section></div></body></html>"
    pages = spark.createDataFrame([(1, "http://x", html), (2, "http://y", "<title>T</title><body>plain</body>"), (3, "http://z", None)], "page_id long, url string, html string")
    got = [(r["page_id"], r["url"], r["level"], r["title"], r["content"]) for r in docs.section_tree(pages).orderBy("page_id", "place").collect()]
    assert got == [(1, "http://x#a", 0, "A", "A text a more"), (1, "http://x#b", 1, "B", "B text b"), (2, "http://y", 0, "T", "plain"), (3, "http://z", 0, "", "")]


def test_word_ranking(spark):
    d = spark.createDataFrame([(1, "disk full error"), (2, "disk disk"), (3, "other text"), (4, None), (5, "more words here")], "id long, text string")
    q = spark.createDataFrame([(1, "disk full"), (2, "absent")], "qid long, text string")
    got = docs.bm25(d, q).orderBy("rank").collect()
    assert [(r["qid"], r["id"]) for r in got] == [(1, 1), (1, 2)]
    assert got[0]["score"] == 1.0
    assert docs.bm25(d.limit(0), q).count() == 0


def test_hits_are_merged_and_reranked(spark):
    hits = spark.createDataFrame([(1, "u", "bm25", "b", 0.1), (1, "u", "semantic", "s", 0.9), (1, "v", "llm", "l", 0.5), (1, "w", "bm25", "c", 0.2)], "qid long, url string, strategy string, title string, score double")
    got = {r["url"]: (r["title"], r["source"]) for r in docs.merge_hits(hits).collect()}
    assert got == {"u": ("s", "semantic,bm25"), "v": ("l", "llm"), "w": ("c", "bm25")}
    top = docs.rerank(docs.merge_hits(hits), F.col("score") - 0.4, k=3, concept=F.col("title") == "c")
    assert {r["url"] for r in top.collect()} == {"u", "w"}
    none = docs.rerank(docs.merge_hits(hits), F.lit(0.0), k=4)
    assert {r["url"] for r in none.collect()} == {"u", "v"}


def test_document_trees_and_indexes(spark):
    nodes = spark.createDataFrame([("r", None, "Root", "about"), ("m", "r", "Mid", ""), ("l", "m", "Leaf", "x")], "id string, parent_id string, title string, summary string")
    assert {r["id"]: (r["path"], r["context"]) for r in docs.breadcrumbs(nodes).collect()} == {"r": ("", None), "m": ("Root", "about"), "l": ("Root > Mid", "about")}
    old = spark.createDataFrame([("a", "1"), ("b", "1")], "path string, sha string")
    new = spark.createDataFrame([("b", "2"), ("c", "1")], "path string, sha string")
    deep = spark.createDataFrame([(str(i), str(i - 1) if i else None, f"t{i}", "top" if i == 0 else "") for i in range(12)] + [("x", "gone", "X", "")], "id string, parent_id string, title string, summary string")
    path = {r["id"]: (r["path"], r["context"], r["root"]) for r in docs.breadcrumbs(deep).collect()}
    assert path["11"] == (" > ".join(f"t{i}" for i in range(11)), "top", "t0")
    assert path["x"] == ("", None, "X")
    assert {r["path"]: r["change"] for r in docs.index_changes(old, new).collect()} == {"a": "deleted", "b": "changed", "c": "new"}


# telemetry


def test_ticks_windows_and_reports(spark):
    rows = [("h", i, x, s, 1, 10, 5, 5) for i, (x, s) in enumerate([(0, 60), (1, 40), (0, 5), (1, 5), (0, 100)])]
    t = telemetry.ticks(spark.createDataFrame(rows, "host string, seq long, idx int, sm int, membw int, total int, used int, free int")).orderBy("tick").collect()
    assert [r["sm"] for r in t] == [100, 10, 100]
    states = [("h", i * 15, s) for i, s in enumerate(["gpu-partial", "gpu-partial", "unloaded", "cpu", "cpu"])]
    r = telemetry.state_report(spark.createDataFrame(states, "host string, offset_s long, state string")).first()
    assert (r["transitions"], r["gpu_percent"], r["first_off"]) == ("gpu-partial -> unloaded -> cpu", 40, 30)
    assert [one(spark, telemetry.state(F.col("a"), F.col("b")), a=a, b=b) for a, b in ((0, 0), (5, 0), (5, 5), (5, 3))] == ["unloaded", "cpu", "gpu-full", "gpu-partial"]
    lines = ["0\tcpu\t5\t0\t\t\t\t\t\t\t\t1", "15\todd\t5\t0\t\t\t\t\t\t\t\t1", "x\tcpu\t5\t0\t\t\t\t\t\t\t\t1", "short\tline"]
    parsed = telemetry.parse_samples(spark.createDataFrame([(x,) for x in lines], "line string")).collect()
    assert [(p["offset_s"], p["gpu_total_mib"], p["util_ticks"]) for p in parsed] == [(0, None, 1)]
    w = telemetry.windows(spark.createDataFrame([("h", 0, 1, 0, 80, 1, 1), ("h", 1, 2, 0, 80, 1, 1), ("h", 16, None, None, None, None, None)], "host string, offset_s long, sm int, membw int, total int, used int, free int")).orderBy("window_s").collect()
    assert [(x["sm_mean"], x["n"]) for x in w] == [(2, 2), (None, 0)]


# sources and streams


def test_json_folder_and_snapshot(spark, tmp_path):
    d = tmp_path / "tasks"
    d.mkdir()
    (d / "1.json").write_text('{"jediTaskID": 1,\n "status": "done"}')
    (d / "2.json").write_text("{broken")
    (d / "x.txt").write_text("{}")
    assert [r["jediTaskID"] for r in files.read_json_folder(spark, str(d), "jediTaskID long, status string").collect()] == [1]
    (tmp_path / "ids.csv").write_text("Name,TaskID\na,5\nb,\n", encoding="utf-8-sig")
    assert [r["task_id"] for r in files.read_id_list(spark, str(tmp_path / "ids.csv")).collect()] == [5]
    t = spark.createDataFrame([(1, [0.5])], "id long, embedding array<double>")
    files.write_snapshot({"points": t}, str(tmp_path / "snap"), dimension=1)
    assert files.read_snapshot(spark, str(tmp_path / "snap"), 1)["points"].collect() == t.collect()
    with pytest.raises(ValueError):
        files.read_snapshot(spark, str(tmp_path / "snap"), 2)


def test_streams(spark, tmp_path):
    from tidegraph.streaming import telemetry as stream

    rows = spark.createDataFrame([("h", 1, "cpu"), ("h", 2, "cpu"), ("h", 3, "gpu-full"), ("k", 1, "cpu")], "host string, seq long, state string")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    got = stream.state_changes(stream.replay(spark, str(tmp_path / "in"), "host string, seq long, state string"))
    q = got.writeStream.format("memory").queryName("changes").outputMode("append").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert sorted(tuple(r) for r in spark.sql("select * from changes").collect()) == [("h", 1, None, "cpu"), ("h", 3, "cpu", "gpu-full"), ("k", 1, None, "cpu")]


def test_every_oracle_has_a_query():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_windows_of_a_stream(spark, tmp_path):
    import datetime

    from tidegraph.streaming import telemetry as stream

    t = datetime.datetime(2024, 1, 1, 10, 5)
    rows = [(t, "a", 1.0), (t + datetime.timedelta(minutes=50), "a", 2.0), (t + datetime.timedelta(minutes=60), "a", 4.0)]
    spark.createDataFrame(rows, "ts timestamp_ntz, event_type string, value double").coalesce(1).write.parquet(str(tmp_path / "in"))
    events = stream.replay(spark, str(tmp_path / "in"), "ts timestamp_ntz, event_type string, value double")
    got = stream.to_table(stream.event_windows(events), "complete").orderBy("start").collect()
    assert [(r["n"], r["total"]) for r in got] == [(2, 3.0), (1, 4.0)]


def test_posts_of_allowed_channels(spark):
    from tidegraph.streaming import telemetry as stream

    raw = [{"event": "posted", "data": {"channel": "c", "user": "u", "root_id": "", "id": "1", "message": "hi"}}, {"event": "posted", "data": {"channel": "c", "user": "me", "root_id": "1", "id": "2", "message": "own"}}, {"event": "typing", "data": {"channel": "c"}}, {"event": "posted", "data": {"channel": "other", "user": "u", "id": "3"}}]
    df = spark.createDataFrame([(json.dumps(x),) for x in raw] + [("junk",)], "value string")
    assert [tuple(r) for r in stream.posts(df, ["c"], "me").collect()] == [("1", "u", "hi")]


def test_query_blocks_find_the_same(spark, monkeypatch):
    import random

    rng = random.Random(2)
    points = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(6)], "a" if i % 2 else "b") for i in range(60)], "id long, embedding array<double>, section string")
    q = points.withColumnRenamed("id", "qid")
    whole = sorted(map(tuple, vectors.batch_search(points, q, 3).collect()))
    monkeypatch.setattr(vectors, "QUERY_BYTES", 700)
    longer = spark.createDataFrame([(1000, [1.0] * 7, "a"), (1001, None, "a"), (1002, [None] * 6, "b"), (1003, [0.0] * 6, "b")], points.schema)
    assert sorted(map(tuple, vectors.batch_search(points.unionByName(longer).repartition(1), q, 3).collect())) == whole  # other lengths change nothing
    assert len(whole) == 180
