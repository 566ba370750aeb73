import json

from tidegraph.operators import extract
from tidegraph.sources import code


def test_answers_become_graphs(spark):
    answer = {
        "nodes": [
            {"node_type": "Cause", "name": "disk", "description": "Disk was full", "metadata": {"a": "b"}},
            {"node_type": "Resolution", "name": "free", "steps": ["x", "y", "z"]},
            {"node_type": "Secret", "name": "no"},
            {"node_type": "Task_Context", "name": " "},
        ],
        "relationships": [
            {"source_name": "disk", "target_name": "free", "relation_type": "solved_by", "confidence": 0.95},
            {"source_name": "disk", "target_name": "no", "relation_type": "solved_by", "confidence": 0.5},
            {"source_name": "free", "target_name": "disk", "relation_type": "contribute_to", "confidence": 7.0},
        ],
    }
    rows = spark.createDataFrame([("g", json.dumps(answer)), ("h", f"```json\n{json.dumps(answer)}\n```"), ("i", "not json"), ("j", None)], "graph_id string, answer string")
    labels = spark.createDataFrame([("Cause", "Disk was full", "Disk full")], "node_type string, raw string, canonical string")
    nodes, edges = extract.parse_answers(rows, extract.EMAIL_TYPES, labels=labels)
    assert {(r["graph_id"], r["name"]) for r in nodes.collect()} == {(g, n) for g in "gh" for n in ("Disk full", "free")}
    assert {(r["src"], r["rel"], r["tgt"], r["confidence"]) for r in edges.filter("graph_id = 'g'").collect()} == {("Disk full", "solved_by", "free", 0.95), ("free", "contribute_to", "Disk full", 1.0)}


def test_actions_and_finalisation(spark):
    answer = {"atomic_actions": [{"name": "a", "cause": "c"}, {"name": "b", "cause": "c", "depends_on": ["a", "zzz", "b"]}]}
    nodes, edges = extract.actions(spark.createDataFrame([("g", json.dumps(answer)), ("h", "?")], "graph_id string, answer string"))
    assert {(r["src"], r["rel"], r["tgt"]) for r in edges.collect()} == {("c", "investigated_by", "a"), ("c", "investigated_by", "b"), ("b", "depends_on", "a")}
    assert nodes.count() == 2
    rows = [("g", "Symptom", "s", None), ("g", "Cause", "c", None), ("g", "Procedure", "p", "tool_p"), ("g", "Resolution", "r", None), ("h", "Symptom", "t", None)]
    got = extract.finalisation_edges(spark.createDataFrame(rows, "graph_id string, node_type string, name string, tool_name string"))
    assert {(r["src"], r["rel"], r["tgt"], r["confidence"]) for r in got.collect()} == {("s", "indicate", "c", 1.0), ("c", "investigated_by", "tool_p", 1.0), ("c", "solved_by", "r", 1.0)}


CODE = '''class A:
    def run(self):
        raise ValueError("no space left on device")

async def run():
    def inner():
        return "space left"
    return inner
'''


def test_code_search(spark):
    rows = spark.createDataFrame([("m.py", CODE), ("bad.py", "def ("), ("none.py", None)], "module string, text string")
    found = code.methods(rows)
    assert [(r["class"], r["name"], r["first_line"], r["last_line"]) for r in found.orderBy("first_line").collect()] == [("A", "run", 2, 3), (None, "run", 5, 8), (None, "inner", 6, 7)]
    assert code.find_method(found, "m.py", "B.run").first()["first_line"] == 2
    assert [(r["name"], r["class"], r["words"]) for r in code.longest_phrase(found, "error: no space left here").collect()] == [("run", "A", 3)]
    assert [(r["name"], r["score"]) for r in code.overlap(found, ["space left", "no space", "device"]).collect()] == [("run", 3)]
    assert code.longest_phrase(found, "").count() == 0
    whole = "the disk has filled up and there is no space left on device today"
    more = code.methods(spark.createDataFrame([("a.py", f"def f():\n    raise E('{whole} x')"), ("b.py", "def g():\n    raise E('there is no space left on device')")], "module string, text string"))
    assert [(r["name"], r["words"]) for r in code.longest_phrase(more, whole).collect()] == [("f", 14)]  # more than eight words
    assert code.longest_run("b c d", "a b c d".split()) == (3, 1)
    assert code.longest_run("a b x c d", "a b c d".split()) == (2, 0)
    read = code.expand(more, ["filled up"], lambda seen: ["no space left"] if seen.count() == 1 else [])
    assert sorted((r["name"], r["round"]) for r in read.collect()) == [("f", 0), ("g", 1)]
