import json

from pyspark.sql import functions as F

from tests.test_operators import FUNNEL, lines_of, one
from tidegraph.operators import compare, logs, records


def numbered(words, start=0):
    return [f"2024-01-01 10:{(start + i) // 60:02d}:{(start + i) % 60:02d} {w}" for i, w in enumerate(words)]


def test_equal_and_empty_logs():
    text = "\n".join(numbered(["alpha", "beta", "gamma"]))
    got = compare.compare(text, text)
    assert (got["truncated"], got["aligned_failed"], got["aligned_successful"], got["next_lines"]) == (False, 3, 3, "")
    for a, b in ((None, text), (text, ""), ("", None)):
        got = compare.compare(a, b)
        assert (got["truncated"], got["aligned_failed"], got["step"]) == (False, 0, None)


def test_a_run_that_stopped_early():
    words = ["setup"] + [f"load {c}" for c in "abcdefgh"] + ["Starting event loop", "work one", "work two", "finished loop", "bye"]
    good = numbered(words)
    failed = numbered(words[:10], 300)
    got = compare.compare("\n".join(failed), "\n".join(good))
    assert got["truncated"]
    assert got["step"].endswith("Starting event loop")
    assert got["step_duration"] == "3s"
    assert got["next_lines"].splitlines() == good[10:]
    early = compare.compare("\n".join(failed[:9]), "\n".join(good))
    assert early["step"] == good[9]
    assert early["step_duration"] == "3s"


def test_loops_sections_and_long_lines():
    one_ = ["start up", *["read '/a/1'"] * 3, "=== files ===", *[f"only here {c}" for c in "abcdefghijklmnopqrstuvwxyz"] * 2, "=== run ===", "go"]
    two = ["start up", *["read '/b/2'"] * 9, "=== files ===", "other", "=== run ===", "go", "x" * 5000]
    got = compare.compare("\n".join(one_), "\n".join(two))
    assert (got["aligned_failed"], got["aligned_successful"]) == (len(one_), len(two) - 1)
    assert got["next_lines"] == "x" * 2000 + " ...[3,000 chars omitted]"
    apart = compare.compare("\n".join(["same", *(f"p{c}" for c in "abcdefghijklmnopqrstuvwxyz")]), "\n".join(["same", *(f"q{c}" for c in "abcdefghijklmnopqrstuvwxyz")]))
    assert (apart["aligned_failed"], apart["aligned_successful"], apart["truncated"]) == (1, 1, False)
    # markers that differ only in their signs don't hold the alignment up
    assert compare.compare("=== a ===\nx", "==== a ====\nx")["aligned_failed"] == 2


def test_tail_of_a_near_prefix():
    loop = [f"item {chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(120)]
    got = compare.compare("\n".join(["odd", *loop[:60]]), "\n".join(loop))
    assert got["truncated"]
    assert got["next_lines"].splitlines()[0] == loop[60]


def test_pairs(spark):
    pairs = spark.createDataFrame([(1, "a\nb", "a\nb\nc"), (2, None, "x")], "pair_id int, failed string, successful string")
    got = {r["pair_id"]: (r["truncated"], r["next_lines"]) for r in compare.compare_logs(pairs).collect()}
    assert got == {1: (True, "c"), 2: (False, "x")}
    jobs = spark.createDataFrame([(1, 10, "failed"), (1, 9, "failed"), (2, 20, "finished")], "task_id long, job_id long, status string")
    texts = spark.createDataFrame([(9, "bad"), (20, "good")], "job_id long, text string")
    refs = spark.createDataFrame([(1, 2), (2, 3)], "task_id long, reference_id long")
    got = {r["pair_id"]: (r["failed"], r["successful"], r["error"]) for r in compare.job_log_pairs(jobs, texts, refs).collect()}
    assert got[1] == ("bad", "good", None)
    assert got[2][2] == "no failed job's log"


def test_rendered_funnels(spark):
    texts = ["dataset is available at 3 sites on DISK\n" + FUNNEL, "plain log\nwith an error", ""]
    got = {r["log_id"]: r["text"] for r in logs.filter_auto(lines_of(spark, *texts)).collect()}
    assert got[1] == "plain log\nwith an error"
    parts = got[0].split("\n## ")
    assert parts[0] == "## Data availability\ndataset is available at 3 sites on DISK\n"
    assert parts[1].startswith("Filter stage: final check  (100% cut, 5→0 candidates)\n12:03 : skip site=S4")
    assert parts[2].startswith("Filter stage: memory check  (88% cut, 40→5 candidates)\n  (35 sites skipped")
    assert parts[3].startswith("Filter stage: disk check  (60% cut, 100→40 candidates)\n  (60 sites skipped")
    assert parts[4].startswith("Final selection\nno candidates")
    assert parts[5].endswith("no candidates")
    one_ = logs.render_funnel(lines_of(spark, FUNNEL), top=1, availability=False).first()["text"]
    assert one_.count("not among the highest-impact stages") == 2


def test_list_tables(spark):
    text = "\n   * - nEvents\n     - NE\n     - number of events\n       per job\n   * - two words\n     - X\n     - no\n\n   * - site\n     - S\n     - where\n"
    pages = spark.createDataFrame([("a", text)], "path string, text string")
    assert {r["name"]: r["description"] for r in records.list_table(pages).collect()} == {"nEvents": "number of events per job", "site": "where"}
    text = "* - MEM_LEAK_<activity>\n  - leak\n* - MEM[_<x>]\n  - limit\n  of it\n"
    table = records.settings_table(spark.createDataFrame([("b", text)], "path string, text string"))
    assert {r["name"]: r["description"] for r in table.collect()} == {"MEM_LEAK_<activity>": "leak", "MEM_LEAK": "leak", "MEM[_<x>]": "limit of it", "MEM": "limit of it"}
    hits = records.lookup(spark.createDataFrame([(1, "see MEM_LEAK and NONE")], "task_id int, text string"), table).collect()
    assert [(r["name"], r["description"]) for r in hits] == [("MEM_LEAK", "leak")]


def test_answers_and_tools(spark):
    rows = spark.createDataFrame([(1, "tools.b(tools.a())", "s"), (2, "tools.a() + tools.b()", "t"), (3, "tools.kill(tools.a())", "u"), (4, " ", "v"), (5, "tools.a()", "w")], "seq int, code string, summary string")
    assert [(r["seq"], r["name"]) for r in records.toolkit(rows, ["kill"]).collect()] == [(1, "proc__a__b")]
    assert {r["seq"] for r in records.toolkit(rows, ["kill"], True).collect()} == {1, 3}
    assert one(spark, records.review(F.col("a")), a="nonsense").asDict() == {"approved": True, "feedback": "", "confidence": 0.0, "issues": [], "failure_dimension": []}
    assert one(spark, records.review(F.col("a")), a='{"approved": false, "confidence": 0.7}')["approved"] is False
    assert [g["gap"] for g in one(spark, records.gaps(F.col("a")), a=json.dumps([{"gap": "x"}, {"gap": "y", "resolvable": False}, {"gap": ""}]))] == ["x"]
    assert tuple(one(spark, records.verdict(F.col("a")), a="so\nVerdict: Good\nReason: it is")) == ("good", "it is")
    assert one(spark, records.verdict(F.col("a")), a="?")["verdict"] == "unclear"
    assert one(spark, records.email_body(F.lit("b"), F.lit(""), F.lit("r"), F.array(F.lit("x"), F.lit("y"))), a=1) == "Background:\nb\n\nResolution:\nr\n\nInvestigation procedure:\n  1. x\n  2. y"
    assert one(spark, records.merge_hints(F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("1")), F.create_map(F.lit("b"), F.lit("2"))), a=1) == {"a": "1", "b": "2"}
    assert one(spark, records.task_query(F.lit("failed"), F.lit("<b>x</b> #tok y")), a=1)["nl_query"] == "task status failed. task status failed. x y"
    assert [one(spark, records.decoded(F.col("a")), a=x) for x in (["t"], ["a", "b"], ['{"k": 1}'])] == ["t", '["a","b"]', '{"k":1}']
