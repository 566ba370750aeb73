"""More queries over the driver's tables, with their DuckDB SQL: stores, labels, documents, tasks, sessions, telemetry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.functions import scalars
from tidegraph.operators import classify, docs, extract, graph, logs, privacy, records, session, store, tasks, telemetry, vectors
from tidegraph.plans import tables
from tidegraph.plans.registry import OBS, query

table = tables.table


def joined(array: str | Column, by: str = ",") -> Column:
    return F.array_join(array, by)


# graph


@query(f"""WITH {OBS} SELECT src, tgt, md5(string_agg(graph_id, ',' ORDER BY graph_id)) AS graphs, count(*) AS n FROM once WHERE src_type = 'Component' GROUP BY 1, 2""")
def graph_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graphs of every edge from a component."""
    obs = tables.edge_observations(spark, sf_dir)
    asked = obs.filter("src_type = 'Component'").select(*graph.EDGE).distinct()
    return graph.provenance(obs, asked).select("src", "tgt", F.md5(joined("graph_ids")).alias("graphs"), F.size("graph_ids").cast("long").alias("n"))


@query("""WITH new AS (SELECT c_mktsegment AS name, c_name AS description, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS r FROM customer
  UNION ALL SELECT n_name, 'new', 1 FROM nation)
SELECT n_name AS name, 'old' AS description FROM nation UNION ALL SELECT name, description FROM new WHERE r = 1 AND name NOT IN (SELECT n_name FROM nation)""")
def graph_first_writer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations there already, and segments of customers: who comes first names a node."""
    n, c = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer")
    old = n.select(F.lit("Environment").alias("node_type"), F.col("n_name").alias("name"), F.lit("old").alias("description"))
    new = c.select(F.lit("Environment").alias("node_type"), F.col("c_mktsegment").alias("name"), F.col("c_name").alias("description"), F.col("c_custkey").cast("long").alias("seq"))
    new = new.unionByName(old.withColumn("description", F.lit("new")).withColumn("seq", F.lit(1).cast("long")))
    return graph.merge_nodes(old, new).select("name", "description")


@query(f"""WITH {OBS}, n AS (SELECT DISTINCT src_type AS t, src AS name FROM obs UNION SELECT 'Task_Context', p_type FROM part UNION SELECT 'Cause', c_name FROM customer UNION SELECT tgt_type, tgt FROM obs)
SELECT t AS node_type, count(*) AS n FROM n WHERE t <> 'Task_Context' AND name IN (SELECT src FROM obs UNION SELECT tgt FROM obs) GROUP BY 1""")
def graph_storable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes at an end of some edge that aren't contexts; customers are at none."""
    obs = tables.edge_observations(spark, sf_dir)
    nodes = obs.select(F.col("src_type").alias("node_type"), F.col("src").alias("name")).union(obs.select("tgt_type", "tgt"))
    nodes = nodes.union(table(spark, sf_dir, "part").select(F.lit("Task_Context"), "p_type")).union(table(spark, sf_dir, "customer").select(F.lit("Cause"), "c_name")).distinct()
    return graph.storable(nodes, obs.select("src", "tgt")).groupBy("node_type").agg(F.count("*").alias("n"))


@query("""SELECT l.l_orderkey AS graph_id, 'S' || s_suppkey AS src_id, 'B' || p_brand AS tgt_id, l_linenumber AS seq, CASE WHEN l_returnflag = 'R' THEN 'edge' ELSE 'own ' || p_brand END AS parameters
FROM lineitem l JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey WHERE n_regionkey = 1""")
def graph_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as edges from suppliers to brands by stored ids; suppliers of other regions aren't stored."""
    line, part, s, n = (table(spark, sf_dir, t) for t in ("lineitem", "part", "supplier", "nation"))
    obs = line.join(part, F.col("p_partkey") == F.col("l_partkey")).join(s, F.col("s_suppkey") == F.col("l_suppkey"))
    obs = obs.select(F.col("l_orderkey").alias("graph_id"), F.col("s_name").alias("src"), F.lit("investigated_by").alias("rel"), F.col("p_brand").alias("tgt"), F.col("l_linenumber").alias("seq"), F.when(F.col("l_returnflag") == "R", "edge").alias("parameters"))
    here = s.join(n.filter("n_regionkey = 1"), F.col("n_nationkey") == F.col("s_nationkey"))
    ids = here.select(F.col("s_name").alias("name"), F.concat(F.lit("S"), "s_suppkey").alias("id")).union(part.select("p_brand", F.concat(F.lit("B"), "p_brand")).distinct())
    own = part.select(F.col("p_brand").alias("name"), F.concat(F.lit("own "), "p_brand").alias("parameters")).distinct()
    return graph.remap(obs, ids, own).select("graph_id", "src_id", "tgt_id", "seq", "parameters")


@query("""WITH e AS (SELECT o_orderpriority AS name, o_orderkey AS id, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS r FROM orders),
kept AS (SELECT name, id FROM e WHERE r = 1),
edges AS (SELECT k.id AS src, c.o_custkey + 1000000000 AS tgt, c.o_orderkey AS seq FROM orders c JOIN kept k ON k.name = c.o_orderpriority)
SELECT src::VARCHAR AS src, tgt::VARCHAR AS tgt, min(seq) AS seq FROM edges GROUP BY 1, 2 UNION ALL SELECT id::VARCHAR, name, -1 FROM kept""")
def graph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders' priorities as repeated nodes, and an edge to the customer from each: the first node of a name stays, edges follow it."""
    o = table(spark, sf_dir, "orders")
    nodes = o.select(F.lit("Symptom").alias("node_type"), F.col("o_orderpriority").alias("name"), F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderkey").alias("seq"))
    edges = o.select(F.col("o_orderkey").cast("string").alias("src"), F.lit("indicate").alias("rel"), (F.col("o_custkey") + 1_000_000_000).cast("string").alias("tgt"), F.col("o_orderkey").alias("seq"))
    edges = edges.unionByName(edges.withColumn("tgt", F.col("src")))  # an edge to itself as well
    kept, linked = graph.dedup_graph(nodes, edges)
    return linked.select("src", "tgt", "seq").unionByName(kept.select(F.col("id").alias("src"), F.col("name").alias("tgt"), F.lit(-1).cast("long").alias("seq")))


@query("""WITH f AS (SELECT DISTINCT l_orderkey AS g, 'ramCount=' || p_size AS src FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size < 10),
s AS (SELECT o_orderkey AS g, o_orderpriority AS tgt FROM orders)
SELECT f.g AS graph_id, src, tgt FROM f JOIN s USING (g) WHERE NOT (src = 'ramCount=5')""")
def graph_concept_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges from small parts as memory features to the order's priority, where missing."""
    line, part, o = (table(spark, sf_dir, t) for t in ("lineitem", "part", "orders"))
    tags = F.when(F.col("p_size") < 10, F.array(F.lit("memory"))).otherwise(F.array(F.lit("disk")))
    features = line.join(part, F.col("p_partkey") == F.col("l_partkey")).select(F.col("l_orderkey").alias("graph_id"), F.lit("Task_Feature").alias("node_type"), F.concat(F.lit("ramCount="), "p_size").alias("name"), tags.alias("concepts"))
    symptoms = o.select(F.col("o_orderkey").alias("graph_id"), F.lit("Symptom").alias("node_type"), F.col("o_orderpriority").alias("name"), F.array().cast("array<string>").alias("concepts"))
    there = symptoms.select("graph_id", F.lit("ramCount=5").alias("src"), F.lit("associated_with").alias("rel"), F.col("name").alias("tgt"))
    return graph.concept_edges(features.unionByName(symptoms), there, ("memory", "cpu"), "Symptom", "associated_with", 1.0).select("graph_id", "src", "tgt")


@query("""SELECT p_partkey AS id, (CASE WHEN p_size % 2 = 0 THEN p_size ELSE 1 END + coalesce(n, 0))::BIGINT AS frequency FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) ON l_partkey = p_partkey""")
def graph_count_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts' counters, unset for odd sizes, and one more for every return."""
    nodes = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") % 2 == 0, F.col("p_size")).alias("frequency"))
    return graph.count_events(nodes, table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_partkey").alias("id"))).withColumn("frequency", F.col("frequency").cast("long"))


@query("""SELECT c_custkey AS id, CASE WHEN c_mktsegment IN (SELECT c_mktsegment FROM customer WHERE c_acctbal > 9000) THEN 'merge' ELSE 'new' END AS status FROM customer""")
def graph_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' segments: known where a rich customer described one."""
    c = table(spark, sf_dir, "customer")
    rows = c.select(F.col("c_custkey").alias("id"), F.lit("Cause").alias("node_type"), F.col("c_mktsegment").alias("name"))
    known = c.select(F.lit("Cause").alias("node_type"), F.col("c_mktsegment").alias("name"), F.when(F.col("c_acctbal") > 9000, F.col("c_name")).alias("description"))
    return graph.diff_nodes(rows, known).select("id", "status")


@query(f"""WITH {OBS}, hit AS (SELECT tgt AS name, count(DISTINCT src_type) AS match_score FROM obs WHERE (src_type = 'Symptom' AND src = '1-URGENT') GROUP BY 1),
cause AS (SELECT p_brand AS name, count(*) AS frequency, round(avg(l_discount), 6) AS confidence FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1)
SELECT 'known' AS asked, name, frequency FROM (SELECT name, frequency, confidence FROM hit JOIN cause USING (name) ORDER BY match_score DESC, frequency DESC, confidence DESC, name LIMIT 10) UNION ALL SELECT 'novel', 'never seen', NULL""")
def graph_novelty_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Causes of a known symptom; none, but the symptom itself, once a novel one is with it."""
    edges = tables.edge_observations(spark, sf_dir).select("src_type", "src", "rel", "tgt")
    causes = tables.causes(spark, sf_dir)
    known, none = graph.causes_unless_novel(edges, causes, spark.createDataFrame([("Symptom", "1-URGENT")], "clue_type string, clue string"))
    gone, unmatched = graph.causes_unless_novel(edges, causes, spark.createDataFrame([("Symptom", "1-URGENT"), ("Symptom", "never seen")], "clue_type string, clue string"))
    shown = lambda df, asked: df.select(F.lit(asked).alias("asked"), "name", F.col("frequency").cast("long").alias("frequency"))
    out = shown(known, "known").unionByName(shown(gone, "novel"))
    return out.unionByName(shown(none.unionByName(unmatched).withColumn("frequency", F.lit(None)), "novel"))


CHAIN = """WITH RECURSIVE t AS (SELECT conv_id * 1000 + turn AS id, role, text, CASE WHEN turn > 0 THEN conv_id * 1000 + turn - 1 END AS prev FROM conversations),
start AS (SELECT conv_id * 1000 + max(turn) AS id FROM conversations GROUP BY conv_id),
walk AS (SELECT id AS start, 0 AS hop, id FROM start UNION ALL SELECT w.start, w.hop + 1, t.prev FROM walk w JOIN t ON t.id = w.id WHERE t.prev IS NOT NULL AND w.hop < 3)"""


def _turns(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    t = table(spark, sf_dir, "conversations")
    here = F.col("conv_id") * 1000 + F.col("turn")
    turns = t.select(here.alias("task_id"), F.col("role").alias("status"), F.col("text").alias("errorDialog"), F.when(F.col("turn") > 0, here - 1).alias("retryID"), F.lit("x").alias("transUses"))
    return turns, t.groupBy("conv_id").agg(F.max("turn").alias("turn")).select(here.alias("task_id"))


@query(f"""{CHAIN} SELECT w.start, w.hop, w.id AS task_id, t.role AS status, md5(left(t.text, 500)) AS error FROM walk w JOIN t ON t.id = w.id WHERE w.hop > 0""")
def graph_retry_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to three turns before each conversation's last, with what is kept of them."""
    turns, last = _turns(spark, sf_dir)
    return graph.retry_chain(turns, last).select("start", "hop", "task_id", "status", F.md5("errorDialog").alias("error"))


@query("""SELECT c.conv_id * 1000 + c.turn AS task_id, p.role AS parent FROM conversations c LEFT JOIN conversations p ON p.conv_id = c.conv_id AND p.turn = c.turn - 1""")
def graph_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The role of the turn before each turn."""
    turns, _ = _turns(spark, sf_dir)
    return graph.parent_task(turns, turns.select("task_id", "retryID")).select("task_id", F.col("parent.status").alias("parent"))


@query("""SELECT p_partkey AS id, p_size % 3 = 1 AS auto_run FROM part""")
def graph_auto_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as procedures whose flag is set by their last change."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_partkey").cast("string").alias("name"), F.col("p_size").alias("size"), F.lit(False).alias("auto_run"))
    changes = p.select("name", (F.col("size") % 3 != 1).alias("value"), F.lit(1).alias("seq")).union(p.select("name", F.col("size") % 3 == 1, F.lit(2)))
    changed, told = graph.set_auto_run(p, changes.union(spark.createDataFrame([("nobody", True, 1)], "name string, value boolean, seq int")))
    return changed.join(told.filter("matched").select("name"), "name").select("id", "auto_run")


@query("""WITH n AS (SELECT o_orderkey AS g, o_orderpriority AS name, 'Symptom' AS t, NULL AS c FROM orders UNION ALL SELECT l_orderkey, 'f' || l_linenumber, 'Task_Feature', CASE WHEN l_linenumber % 2 = 0 THEN 'memory' ELSE 'unit' END FROM lineitem),
seen AS (SELECT DISTINCT g, name FROM n WHERE t <> 'Task_Feature' OR c = 'memory'), e AS (SELECT l_orderkey AS g, 'f' || l_linenumber AS src, o_orderpriority AS tgt FROM lineitem JOIN orders ON o_orderkey = l_orderkey)
SELECT g AS graph_id, count(*) AS edges FROM e WHERE (g, src) IN (SELECT (g, name) FROM seen) GROUP BY 1""")
def graph_reviewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges that a reviewer sees: those of features about a unit are hidden with them."""
    line, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    tag = F.when(F.col("l_linenumber") % 2 == 0, F.array(F.lit("memory"))).otherwise(F.array(F.lit("unit")))
    name = F.concat(F.lit("f"), "l_linenumber")
    nodes = line.select(F.col("l_orderkey").alias("graph_id"), F.lit("Task_Feature").alias("node_type"), name.alias("name"), tag.alias("concepts"), F.lit("").alias("description"))
    nodes = nodes.unionByName(o.select(F.col("o_orderkey").alias("graph_id"), F.lit("Symptom").alias("node_type"), F.col("o_orderpriority").alias("name"), F.lit(None).cast("array<string>").alias("concepts"), F.lit("").alias("description")))
    edges = line.join(o, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("l_orderkey").alias("graph_id"), name.alias("src"), F.col("o_orderpriority").alias("tgt"))
    return graph.reviewed(nodes, edges)[1].groupBy("graph_id").agg(F.count("*").alias("edges"))


# vectors

Q = """q AS (SELECT vec_id AS qid, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 50 = 0),
s AS (SELECT q.qid, p.vec_id AS id, p.label, round(list_cosine_similarity(q.e, p.embedding::DOUBLE[]), 12) AS score FROM q, embeddings p WHERE p.vec_id % 50 <> 0)"""


def _queries_and_rest(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    p = tables.points(spark, sf_dir)
    return p.filter("id % 50 = 0"), p.filter("id % 50 <> 0")


@query(f"""WITH {Q}, r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS r FROM s WHERE score >= 0.3) SELECT qid AS item, id, round(score, 6) AS score FROM r WHERE r = 1""")
def vector_best_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest of all other vectors for every query vector, if it is near enough."""
    q, rest = _queries_and_rest(spark, sf_dir)
    return vectors.best_match(q.select("id", "embedding"), rest.select("id", "embedding"), 0.3).select("item", "id", F.round("score", 6).alias("score"))


@query(f"""WITH {Q}, t AS (SELECT qid, max(score) FILTER (label % 2 = 0) AS a, max(score) FILTER (label % 2 = 1) AS b FROM s GROUP BY 1)
SELECT qid AS id, CASE WHEN a >= 0.35 THEN 'covered' WHEN b >= 0.35 THEN 'matched' ELSE 'new' END AS tier FROM t""")
def vector_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query vectors against the even labels as known symptoms and the odd ones as a library."""
    q, rest = _queries_and_rest(spark, sf_dir)
    side = lambda k: rest.filter(F.col("section").cast("int") % 2 == k).select("id", "embedding")
    return vectors.coverage(q.select("id", "embedding"), side(0), side(1), 0.35)


@query("""WITH c AS (SELECT DISTINCT o_custkey AS t, o_orderpriority AS e, o_orderstatus AS x FROM orders)
SELECT t AS task_id, 'Error' AS section, 'Error: ' || string_agg(DISTINCT e, ', ' ORDER BY e) AS query FROM c GROUP BY t UNION ALL SELECT t, 'Task_Feature', 'Task features: ' || string_agg(DISTINCT x, ', ' ORDER BY x) FROM c GROUP BY t
UNION ALL SELECT o_custkey, 'Task_Context', 'order ' || o_orderkey FROM orders UNION ALL SELECT c_custkey, 'Error', c_name FROM customer""")
def vector_section_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is asked of each section for a customer: priorities as errors, statuses as features, each order as a context, the name as description."""
    o = table(spark, sf_dir, "orders")
    clue = lambda kind, c: o.select(F.col("o_custkey").alias("task_id"), F.lit(kind).alias("clue_type"), c.alias("clue"))
    clues = clue("Error", F.col("o_orderpriority")).union(clue("Task_Feature", F.col("o_orderstatus"))).union(clue("Task_Context", F.concat(F.lit("order "), "o_orderkey")))
    described = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("task_id"), F.col("c_name").alias("description"))
    return vectors.section_queries(clues, described)


@query("""WITH s AS (SELECT o_custkey AS g, min(o_orderkey) AS id FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) SELECT c_custkey AS graph_id, id, 1.0::DOUBLE AS score FROM customer JOIN s ON g = c_custkey""")
def vector_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first finished order of each customer as its summary point."""
    points = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("graph_id"), F.when(F.col("o_orderstatus") == "F", "Summary").otherwise("Symptom").alias("section"))
    asked = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("graph_id"), F.col("c_custkey").alias("place"))
    return vectors.summaries(points, asked).select("graph_id", "id", "score")


@query("""WITH e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e, [label::VARCHAR, 'm' || vec_id % 5] AS tools FROM embeddings),
s AS (SELECT a.id, b.tools, row_number() OVER (PARTITION BY a.id ORDER BY round(list_cosine_similarity(a.e, b.e), 12) DESC, b.id) AS r FROM e a, e b WHERE a.id <> b.id),
near AS (SELECT id, list_distinct(flatten(list(tools))) AS t FROM s WHERE r <= 5 GROUP BY 1)
SELECT e.id, round(len(list_intersect(e.tools, n.t)) / len(e.tools), 6) AS recall FROM e JOIN near n USING (id)""")
def vector_neighbour_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of a vector's label and number its five nearest others' hold together."""
    items = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", F.array(F.col("label").cast("string"), F.concat(F.lit("m"), F.col("vec_id") % 5)).alias("tools"))
    return vectors.neighbour_recall(items, 5).select("id", F.round("recall", 6).alias("recall"))


@query("""WITH r AS (SELECT l_orderkey, any_value(o_orderpriority) AS prompt, string_agg(DISTINCT l_linestatus || l_returnflag, ',' ORDER BY l_linestatus || l_returnflag) AS tools FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1)
SELECT prompt, tools, arg_max(CASE WHEN l_orderkey % 2 = 0 THEN 2.0 ELSE 1.0 END, l_orderkey)::DOUBLE AS weight FROM r GROUP BY 1, 2""")
def vector_trigger_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as runs whose tools are the states of their lines, one point for each prompt and set of tools."""
    line, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    runs = line.groupBy("l_orderkey").agg(F.collect_list(F.concat("l_linestatus", "l_returnflag")).alias("tools")).join(o, F.col("o_orderkey") == F.col("l_orderkey"))
    runs = runs.select("tools", F.concat(F.lit(" "), "o_orderpriority").alias("prompt"), F.when(F.col("l_orderkey") % 2 == 0, 2.0).alias("weight"), F.col("l_orderkey").alias("seq"))
    return vectors.trigger_points(runs, "ns").select("prompt", joined("tools").alias("tools"), "weight")


@query("""WITH c AS (SELECT l_orderkey AS key, 'p' || l_suppkey AS name, max(l_discount) AS score FROM lineitem GROUP BY 1, 2),
t AS (SELECT l_orderkey AS key, 'p' || l_suppkey AS name, l_linenumber * l_quantity AS v, l_linenumber AS n, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber * l_quantity DESC, '["p' || l_suppkey || '"]') AS r FROM lineitem),
live AS (SELECT DISTINCT key, name FROM c WHERE name <> 'p1'),
s1 AS (SELECT key, name, row_number() OVER (PARTITION BY key ORDER BY r) - 1 AS pos FROM (SELECT key, name, min(r) AS r FROM t JOIN live USING (key, name) GROUP BY 1, 2)),
s2 AS (SELECT key, name, row_number() OVER (PARTITION BY key ORDER BY score DESC, name) - 1 AS pos FROM c JOIN live USING (key, name)),
both_ AS (SELECT key, name, CASE WHEN pos < 2 THEN pos * 2 ELSE pos + 2 END AS place FROM s1 UNION ALL SELECT key, name, CASE WHEN pos < 2 THEN pos * 2 + 1 ELSE pos + 1e9 END FROM s2),
m AS (SELECT key, name, row_number() OVER (PARTITION BY key ORDER BY min(place), name) - 1 AS pos FROM both_ GROUP BY 1, 2)
SELECT key, name, pos, CASE WHEN pos < 3 THEN 'full' ELSE 'compact' END AS tier FROM m WHERE pos < 3 OR 30 + (pos - 2) * 5 <= 40""")
def vector_select_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's suppliers as tools: past runs by quantity and line, descriptions by discount; three whole and two short ones fit."""
    line = table(spark, sf_dir, "lineitem")
    name, key = F.concat(F.lit("p"), "l_suppkey"), F.col("l_orderkey").alias("key")
    triggers = line.select(key, F.array(name).alias("tools"), F.col("l_quantity").cast("double").alias("score"), F.col("l_linenumber").cast("double").alias("weight"))
    catalogue = line.groupBy(key, name.alias("name")).agg(F.max("l_discount").alias("score"))
    live = catalogue.filter("name <> 'p1'").select("key", "name", F.lit(10).cast("long").alias("full"), F.lit(5).cast("long").alias("compact"))
    return vectors.select_tools(triggers, catalogue, live, 40, 2, 3).select("key", "name", F.col("pos").cast("long").alias("pos"), "tier")


@query("""SELECT p_partkey::VARCHAR AS name FROM part WHERE p_size % 3 <> 0""")
def vector_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as tools; those whose stored hash is of the same description aren't indexed again."""
    tools = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("name"), F.col("p_type").alias("description"), F.array("p_brand").alias("arguments"), F.lit("{}").alias("schema"), "p_size")
    empty = spark.createDataFrame([], "id string, tool_hash string")
    stored = vectors.catalogue_points(tools, "ns", empty).join(tools.filter("p_size % 3 = 0 or p_size % 3 = 1").select("name", "p_size"), "name")
    stored = stored.select("id", F.when(F.col("p_size") % 3 == 0, F.col("tool_hash")).otherwise("old").alias("tool_hash"))
    return vectors.catalogue_points(tools, "ns", stored).select("name")


@query("""SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'Unknown' WHEN c_custkey % 3 = 1 THEN 'Unknown' ELSE c_mktsegment END AS category, CASE WHEN c_custkey % 3 = 2 THEN 0.5 ELSE 0.0 END::DOUBLE AS confidence FROM customer""")
def vector_error_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blank errors and failed classifications are Unknown."""
    k = F.col("c_custkey")
    made = vectors.error_category(F.when(k % 3 == 0, "  ").otherwise(F.col("c_name")), F.when(k % 3 != 1, F.col("c_mktsegment")), F.lit(0.5))
    return table(spark, sf_dir, "customer").select(k.alias("id"), made.alias("c")).select("id", "c.*")


# records


@query("""WITH p AS (SELECT p_partkey AS id, p_size, p_brand FROM part)
SELECT id, 'Component' AS node_type, 'prun' AS name FROM p UNION ALL SELECT id, 'Task_Context', 'task_creation_arguments:positional_args' FROM p WHERE p_size % 2 = 0
UNION ALL SELECT id, 'Task_Feature', 'task_creation_arguments:nFilesPerJob=' || p_size FROM p UNION ALL SELECT id, 'Task_Feature', 'task_creation_arguments:memory=' || p_brand FROM p
UNION ALL SELECT id, 'Task_Feature', 'task_creation_arguments:v=true' FROM p UNION ALL SELECT id, 'Task_Feature', 'task_creation_arguments:x=true' FROM p UNION ALL SELECT id, 'Task_Feature', 'task_creation_arguments:k=a=b' FROM p
UNION ALL SELECT id, 'Task_Context', 'task_creation_arguments:exec' FROM p""")
def classify_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as tasks with command lines, to nodes."""
    more = F.when(F.col("p_size") % 2 == 0, " later words").otherwise("")
    line = F.concat(F.lit("prun --inDS user.x --nFilesPerJob="), F.col("p_size").cast("string"), F.lit(" --task_creation_arguments:memory '"), "p_brand", F.lit("' -vx --exec=\"run me\" -k=a=b --"), more)
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("task_id"), F.create_map(F.lit("task_creation_arguments"), line).alias("task"))
    return classify.classify(rows, "salt").select(F.col("task_id").alias("id"), "node_type", "name")


@query("""SELECT o_orderkey AS id, 2 AS names, CASE WHEN o_orderkey % 2 = 0 THEN 0.5 ELSE 1.0 END::DOUBLE AS coverage, o_orderkey % 3 = 0 AS rounds_exhausted, false AS low_term_quality,
 CASE WHEN o_orderkey % 5 = 0 THEN 'empty_error_dialog' WHEN o_orderkey % 7 = 0 THEN 'no_candidates' WHEN o_orderkey % 2 = 0 THEN 'irrelevant' ELSE 'relevant' END AS category FROM orders""")
def classify_searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source searches of orders: names in their terms, how many the answer mentions, and what became of them."""
    k = F.col("o_orderkey")
    terms = F.array(F.concat(F.lit("in task_params "), k), F.lit("getJobs"), F.lit("task_params"))
    answer = F.when(k % 2 == 0, "see GETJOBS").otherwise("see getJobs and TASK_PARAMS")
    flags = classify.search_flags(terms, F.lit(True), F.when(k % 3 == 0, 3).otherwise(1))
    category = classify.source_category(F.when(k % 5 == 0, " ").otherwise("error"), F.when(k % 7 == 0, "No methods found here").otherwise("text"), F.lit(3), F.lit(2), F.when(k % 2 == 0, "irrelevant").otherwise("relevant"))
    return table(spark, sf_dir, "orders").select(k.alias("id"), F.size(classify.identifiers(F.array_join(terms, " "))).alias("names"), classify.identifier_coverage(terms, answer).alias("coverage"), flags["rounds_exhausted"].alias("rounds_exhausted"), flags["low_term_quality"].alias("low_term_quality"), category.alias("category"))


@query("""SELECT a.p_partkey AS id, CASE WHEN a.p_brand = b.p_brand AND a.p_type = b.p_type THEN 'No key task feature differences detected.' ELSE 'Key differences vs. source: ' || concat_ws(', ',
 CASE WHEN a.p_type <> b.p_type THEN 'taskType: ''' || a.p_type || '''→''' || b.p_type || '''' END, CASE WHEN a.p_brand <> b.p_brand THEN 'site: ''' || a.p_brand || '''→''' || b.p_brand || '''' END) END AS diff,
 concat_ws(',', a.p_brand, CASE WHEN b.p_brand <> a.p_brand THEN b.p_brand END) AS sites FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1""")
def classify_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How a part differs from the next one, and the brands of both as sites."""
    p = table(spark, sf_dir, "part")
    a, b = p.select("p_partkey", F.col("p_type").alias("t1"), F.col("p_brand").alias("b1")), p.select((F.col("p_partkey") - 1).alias("k"), F.col("p_type").alias("t2"), F.col("p_brand").alias("b2"))
    task = lambda t, s: F.struct(F.col(t).alias("taskType"), F.lit("x").alias("prodSourceLabel"), F.col(s).alias("site"), F.lit(None).cast("string").alias("coreCount"), F.lit("").alias("splitRule"))
    both = a.join(b, F.col("p_partkey") == F.col("k"))
    return both.select(F.col("p_partkey").alias("id"), classify.feature_diff(task("t1", "b1"), task("t2", "b2")).alias("diff"), joined(classify.site_list(F.col("b1"), F.concat_ws(" , ", "b2", "b1"))).alias("sites"))


@query("""SELECT c_custkey AS id, 'Task_Feature' AS node_type, 'region=' || c_nationkey AS name FROM customer UNION ALL SELECT c_custkey, 'Task_Feature', 'coreCount=' || c_nationkey FROM customer UNION ALL SELECT c_custkey, 'Task_Context', 'taskName' FROM customer""")
def classify_external(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as tasks: a discrete field, a name in free text, and a field from outside."""
    nation = F.col("c_nationkey").cast("string")
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("task_id"), F.create_map(F.lit("coreCount"), nation, F.lit("taskName"), F.col("c_name")).alias("task"), F.create_map(F.lit("region"), nation).alias("more"))
    return classify.classify(rows, "salt", "more").select(F.col("task_id").alias("id"), "node_type", "name")


@query("""SELECT p_partkey AS id, 'size=' || p_size AS name, p_size::VARCHAR AS value FROM part WHERE p_size % 3 = 0 UNION ALL SELECT p_partkey, 'kind=' || p_type, p_type FROM part WHERE p_size % 3 = 1 UNION ALL SELECT p_partkey, p_brand || '=said', 'said' FROM part WHERE p_size % 3 = 2""")
def classify_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model's features always get a name of attribute and value."""
    third = F.col("p_size") % 3
    given = F.when(third == 1, F.create_map(F.lit("attribute"), F.lit("kind"), F.lit("value"), F.col("p_type"))).otherwise(F.create_map(F.lit("x"), F.lit("y")))
    name = F.when(third == 0, F.concat(F.lit("size="), "p_size")).when(third == 1, F.lit("whatever")).otherwise(F.col("p_brand"))
    nodes = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.lit("Task_Feature").alias("node_type"), name.alias("name"), F.lit("said").alias("description"), given.alias("metadata"))
    return classify.attribute_features(nodes).select("id", "name", "value")


@query("""SELECT p_partkey AS id, p_size % 2 = 0 AS changes, p_size % 5 = 0 AS broken FROM part""")
def tool_side_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether code may change things: it names a tool that does, even without calling it; code without any tool doesn't."""
    size = F.col("p_size")
    code = F.when(size % 2 == 0, "m = tools.kill_job\nm(1)").when(size % 3 == 0, "x = 1  # tools.kill_job").otherwise("tools.read(tools.find())")
    broken = F.when(size % 5 == 0, "def (").otherwise("tools.find()")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), records.has_side_effects(code, ["kill_job"]).alias("changes"), records.has_side_effects(broken, ["kill_job"]).alias("broken"))


@query("""SELECT o_orderkey AS id, 'task status ' || o_orderstatus || '. ' || left('task status ' || o_orderstatus || '. error of ' || o_orderpriority, 120) AS nl_query, 'task status ' || o_orderstatus AS keyword_query FROM orders WHERE o_orderkey % 2 = 0
UNION ALL SELECT o_orderkey, 'task status ' || o_orderstatus || '. why ' || o_orderpriority, 'task status ' || o_orderstatus || ' a b' FROM orders WHERE o_orderkey % 2 = 1""")
def record_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is searched for an order: from a model's answer, or from the error's text."""
    answer = F.when(F.col("o_orderkey") % 2 == 1, F.concat(F.lit('```json\n{"nl_query": "why '), "o_orderpriority", F.lit('", "keywords": ["a", "", "b"]}\n```')))
    q = records.task_query(F.col("o_orderstatus"), F.concat(F.lit("<b>error</b> of #42 "), "o_orderpriority"), answer)
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), q.alias("q")).select("id", "q.*")


@query("""SELECT o_orderkey AS id, 'Background:' || chr(10) || o_orderpriority || chr(10) || chr(10) || 'Cause:' || chr(10) || o_orderstatus || chr(10) || chr(10) || 'Investigation procedure:' || chr(10) || '  1. look' || chr(10) || '  2. act' AS body, o_orderkey % 2 = 0 AS same FROM orders""")
def record_mails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies of mails, and whether a change was made."""
    body = lambda cause: F.struct(F.col("o_orderpriority").alias("background"), cause.alias("cause"), F.lit("").alias("resolution"), F.array(F.lit("look"), F.lit("act")).alias("procedure"))
    a, b = body(F.col("o_orderstatus")), body(F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderstatus")).otherwise("other"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), records.email_body(a["background"], a["cause"], a["resolution"], a["procedure"]).alias("body"), records.same_email(a, b).alias("same"))


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN true ELSE o_orderkey % 3 = 1 END AS approved, CASE WHEN o_orderkey % 3 = 0 THEN 0.0 WHEN o_orderkey % 3 = 1 THEN 1.0 ELSE 0.25 END::DOUBLE AS confidence,
 CASE WHEN o_orderkey % 3 = 2 THEN 'a,b' ELSE '' END AS issues, CASE WHEN o_orderkey % 3 = 2 THEN 'gap ' || o_orderkey ELSE '' END AS gaps, CASE WHEN o_orderkey % 3 = 2 THEN 'relevant' ELSE 'unclear' END AS verdict FROM orders""")
def record_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews, gaps and verdicts from models' answers, some of which can't be read."""
    third = F.col("o_orderkey") % 3
    review = records.review(F.when(third == 0, "not json").when(third == 1, '{"feedback": "fine"}').otherwise('```json\n{"approved": false, "confidence": 0.25, "issues": ["a", "b"]}\n```'))
    gaps = records.gaps(F.when(third == 2, F.concat(F.lit('[{"gap": "gap '), "o_orderkey", F.lit('"}, {"gap": "no", "resolvable": false}]'))).otherwise("{}"))
    told = records.verdict(F.when(third == 2, "verdict: relevant\nreason: so").otherwise("I cannot say"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), review["approved"].alias("approved"), review["confidence"].alias("confidence"), joined(review["issues"]).alias("issues"), joined(F.transform(gaps, lambda g: g["gap"])).alias("gaps"), told["verdict"].alias("verdict"))


@query("""WITH n AS (SELECT DISTINCT l_orderkey AS g, l_returnflag AS t, 'p' || lpad(l_partkey::VARCHAR, 8, '0') AS name FROM lineitem), r AS (SELECT *, row_number() OVER (PARTITION BY g, t ORDER BY name) AS r FROM n)
SELECT g AS graph_id, t AS node_type, (SELECT count(*) FROM lineitem WHERE l_orderkey = g AND l_returnflag = t) AS n, string_agg(name, ',' ORDER BY name) FILTER (r <= 2) AS names FROM r GROUP BY 1, 2""")
def record_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many parts of each state an order has, and the first two."""
    nodes = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("graph_id"), F.col("l_returnflag").alias("node_type"), F.concat(F.lit("p"), F.lpad(F.col("l_partkey").cast("string"), 8, "0")).alias("name"))
    return records.digest(nodes, 2).select("graph_id", "node_type", "n", joined("names").alias("names"))


@query("""SELECT conv_id AS session, turn, left(text, 200) AS text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 5""")
def record_last_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last five turns of every conversation, shortened."""
    return records.last_turns(table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session"), "turn", "text"))


# logs


@query("""SELECT user_id AS log_id, event_id * 3 AS line_no, event_type AS section FROM events""")
def log_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Section markers of all event logs."""
    return logs.markers(tables.event_logs(spark, sf_dir))


EVENT_LINES = """l AS (SELECT user_id AS log_id, event_id * 3 AS line_no, '=== ' || event_type || ' ===' AS line, event_type AS section, NULL AS time, event_type = 'error' AS err FROM events
  UNION ALL SELECT user_id, event_id * 3 + 1, '2024-01-01 10:00:' || lpad((event_id % 60)::VARCHAR, 2, '0') || ' value ' || floor(value)::BIGINT, NULL, '2024-01-01 10:00:' || lpad((event_id % 60)::VARCHAR, 2, '0'), false FROM events
  UNION ALL SELECT user_id, event_id * 3 + 2, CASE WHEN value > 60 THEN 'ERROR: value ' || event_id WHEN value < 10 THEN '  ' ELSE 'ok' END, NULL, NULL, value > 60 FROM events)"""


@query(f"""WITH {EVENT_LINES}, r AS (SELECT *, row_number() OVER (PARTITION BY log_id ORDER BY line_no DESC) AS back, sum(err::INT) OVER (PARTITION BY log_id ORDER BY line_no) AS nth FROM l)
SELECT log_id, count(*) AS total_lines, sum(length(line) + 1)::BIGINT AS total_chars, arg_max(section, line_no) FILTER (section IS NOT NULL) AS last_section_marker, md5(string_agg(section, ',' ORDER BY line_no)) AS sections, arg_max(time, line_no) FILTER (time IS NOT NULL) AS last_timestamp,
 arg_max(trim(line), line_no) FILTER (trim(line) <> '') AS last_meaningful_action, coalesce(string_agg(line, ',' ORDER BY line_no) FILTER (err AND nth <= 20), '') AS errors, md5(string_agg(line, chr(10) ORDER BY line_no) FILTER (back <= 50)) AS tail FROM r GROUP BY 1""")
def log_whole_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that a summary tells of each event log."""
    s = logs.summarise(tables.event_logs(spark, sf_dir))
    return s.select("log_id", "total_lines", "total_chars", "last_section_marker", F.md5(joined("sections_seen")).alias("sections"), "last_timestamp", "last_meaningful_action", joined("error_lines").alias("errors"), F.md5("tail_raw").alias("tail"))


K = "c_custkey AS k, 50 + c_custkey % 50 AS a, 20 + c_custkey % 20 AS b, 5 + c_custkey % 5 AS c"


@query(f"""WITH t AS (SELECT {K} FROM customer)
SELECT k AS log_id, 0 AS stage, 'memory' AS name, a AS before, b AS after, 60 AS cut_pct, '-memory' AS criteria, a AS initial, c AS final FROM t UNION ALL SELECT k, 1, 'busy', b, c, 75, '-busy', a, c FROM t""")
def log_funnels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stages of every customer's candidate funnel."""
    stages, _ = logs.parse_funnel(tables.brokerage_logs(spark, sf_dir))
    return stages.select("log_id", F.col("stage").cast("int").alias("stage"), "name", "before", "after", "cut_pct", joined("criteria_seen").alias("criteria"), "initial", "final")


@query(f"""WITH t AS (SELECT {K} FROM customer) SELECT k AS log_id, 'S' || k % 7 AS site, 'memory' AS filtered_at, '-memory' AS criteria, 'too small' AS reason FROM t UNION ALL SELECT k, 'S' || (k + 1) % 7, 'busy', '-busy', 'busy' FROM t""")
def log_funnel_fates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each site of a funnel went."""
    return logs.parse_funnel(tables.brokerage_logs(spark, sf_dir))[1]


# documents

TYPED = "CASE WHEN lang = 'en' AND n_chars > 500 THEN 'concept' ELSE 'other' END"


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when((F.col("lang") == "en") & (F.col("n_chars") > 500), "concept").otherwise("other")
    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), F.concat(F.lit("u/"), "doc_id").alias("url"), (F.col("doc_id") % 3).cast("int").alias("level"), F.coalesce("source", F.lit("")).alias("title"), F.col("text").alias("content"), F.lit("").alias("summary"), kind.alias("doc_type"), F.when(F.col("doc_id") % 3 > 0, (F.col("doc_id") - 1).cast("string")).alias("parent_id"), F.col("doc_id").alias("place"))


@query(f"""SELECT count(*) AS nodes, count(*) FILTER ({TYPED} = 'concept') AS concept, count(*) FILTER ({TYPED} = 'other') AS other FROM documents""")
def doc_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by type."""
    return docs.index_counts(_nodes(spark, sf_dir))


@query(f"""SELECT 'u/' || d.doc_id AS url, (d.doc_id % 3)::INT AS level, 'concept' AS doc_type, CASE WHEN d.doc_id % 3 > 0 AND coalesce(p.source, '') <> '' THEN p.source || ' › ' || coalesce(d.source, '') ELSE coalesce(d.source, '') END AS label, '' AS summary
FROM documents d LEFT JOIN documents p ON p.doc_id = d.doc_id - 1 WHERE d.lang = 'en' AND d.n_chars > 500""")
def doc_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents about concepts, each behind the one above it."""
    return docs.index_listing(_nodes(spark, sf_dir), concept_only=True)


@query("""SELECT doc_id::VARCHAR AS id, CASE WHEN trim(coalesce(text, '')) = '' THEN coalesce(source, '') WHEN doc_id % 4 = 0 THEN 'cached' WHEN doc_id % 4 = 1 THEN 'new ' || length(left(text, 3000)) ELSE left(text, 300) END AS summary,
 CASE WHEN trim(coalesce(text, '')) = '' THEN CASE WHEN lang = 'en' THEN 'concept' ELSE 'other' END WHEN doc_id % 4 = 0 THEN 'concept' ELSE 'other' END AS doc_type, trim(coalesce(text, '')) <> '' AND doc_id % 4 = 0 AS cached FROM documents""")
def doc_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries of documents: the title of empty ones, what was known of the same text, or a model's answer."""
    nodes = _nodes(spark, sf_dir).join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("place"), F.when(F.col("lang") == "en", "Basic Concepts").otherwise("Other").alias("root")), "place")
    known = nodes.select("id", F.when(F.col("place") % 4 == 0, F.sha2(F.coalesce("content", F.lit("")), 256)).otherwise("old").alias("content_hash"), F.lit("cached").alias("summary"), F.lit("concept").alias("doc_type"))
    answer = lambda text: F.struct(F.when(F.col("place") % 4 == 1, F.concat(F.lit("new "), F.length(text).cast("string"))).otherwise("").alias("summary"), F.lit("odd").alias("doc_type"))
    return docs.summarise_pages(nodes, known, answer).select("id", "summary", "doc_type", "cached")


@query("""SELECT page_id, url FROM pages p WHERE NOT EXISTS (SELECT 1 FROM pages q WHERE q.page_id % 20 = 0 AND q.url <> '' AND starts_with(p.url, q.url)) UNION ALL SELECT -1, 'new'""")
def doc_replaced_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages without those whose URL begins like one that was rebuilt, and a new one."""
    p = table(spark, sf_dir, "pages").select("page_id", "url")
    return docs.replace_pages(p, spark.createDataFrame([(-1, "new")], "page_id long, url string"), p.filter("page_id % 20 = 0").select("url"))


@query("""SELECT count(*) AS pages, md5(string_agg('[' || coalesce(source, '') || ']' || chr(10) || left(text, 300), chr(10) || chr(10) ORDER BY doc_id)) AS text FROM documents WHERE (doc_id % 3 = 0 OR (lang = 'en' AND n_chars > 500)) AND coalesce(text, '') <> ''""")
def doc_system_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top documents and those about concepts, as one text."""
    return docs.system_pages(_nodes(spark, sf_dir)).select("pages", F.md5("text").alias("text"))


@query("""SELECT l_orderkey AS qid, CASE WHEN l_linenumber % 3 = 0 THEN 'semantic' WHEN l_linenumber % 3 = 1 THEN 'llm' ELSE 'unknown' END AS strategy, count(*) AS n FROM lineitem GROUP BY 1, 2 UNION ALL SELECT l_orderkey, 'bm25', count(*) FROM lineitem WHERE l_linenumber % 3 = 0 GROUP BY 1""")
def doc_source_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many hits each strategy gave."""
    third = F.col("l_linenumber") % 3
    return docs.source_counts(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("qid"), F.when(third == 0, "semantic, bm25").when(third == 1, "llm").alias("source")))


@query("""SELECT conv_id AS qid, md5(string_agg(trim('[' || role || '] ' || left(text, 500)), chr(10) || chr(10) ORDER BY turn)) AS text FROM conversations WHERE coalesce(text, '') <> '' AND role <> 'user' GROUP BY 1""")
def doc_rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as hits, rendered; those titled as an API are left out."""
    hits = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("qid"), F.col("turn").alias("place"), F.when(F.col("role") == "user", "An API page").otherwise(F.col("role")).alias("title"), F.col("text").alias("content"))
    return docs.rendered_hits(hits).select("qid", F.md5("text").alias("text"))


@query("""SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 0 THEN c_custkey % 8 = 0 ELSE c_custkey % 4 <> 1 END AS stale, false AS frozen FROM customer""")
def doc_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether an index must be built again: the source can't be asked, nothing changed, something did, or there is no index."""
    k = F.col("c_custkey")
    current, known = F.when(k % 4 != 0, "a"), F.when(k % 8 == 0, F.lit(None).cast("string")).when(k % 4 == 1, "a").when(k % 4 == 2, "b").when(k % 4 == 0, "a")
    return table(spark, sf_dir, "customer").select(k.alias("id"), docs.stale(known, current).alias("stale"), docs.stale(known, current, True).alias("frozen"))


@query("""WITH t AS (SELECT n_name AS id, r_name AS parent FROM nation JOIN region ON r_regionkey = n_regionkey) SELECT id FROM t WHERE parent = 'ASIA' AND id LIKE '%I%' UNION ALL SELECT 'lone'""")
def doc_traversal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations below a region by a choice of names; a page without sections is its own result."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    nodes = n.join(r, F.col("r_regionkey") == F.col("n_regionkey")).select(F.col("n_name").alias("id"), F.col("r_name").alias("parent_id")).union(r.select("r_name", F.lit(None).cast("string")))
    nodes = nodes.union(spark.createDataFrame([("lone", None)], "id string, parent_id string"))
    return docs.traverse(nodes, lambda c: c.filter("id = 'ASIA' or id = 'lone' or (parent_id is not null and id like '%I%')")).select("id")


# tasks

J = "j AS (SELECT user_id AS task_id, event_id AS job_id, CASE WHEN event_type IN ('click', 'view') THEN 'failed' ELSE event_type END AS status FROM events)"


@query(f"""WITH {J} SELECT task_id, count(*) AS jobs, count(*) FILTER (status = 'failed') AS unsuccessful FROM j WHERE task_id % 2 = 0 GROUP BY 1""")
def task_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All jobs of some tasks, and those that failed."""
    jobs = tables.jobs(spark, sf_dir)
    asked = jobs.select("task_id").distinct().filter("task_id % 2 = 0")
    bad = tasks.jobs_of(jobs, asked, True).groupBy("task_id").agg(F.count("*").alias("u"))
    return tasks.jobs_of(jobs, asked).groupBy("task_id").agg(F.count("*").alias("jobs")).join(bad, "task_id", "left").select("task_id", "jobs", F.coalesce("u", F.lit(0)).alias("unsuccessful"))


@query("""SELECT l_orderkey AS task_id, l_suppkey AS dataset_id, string_agg(DISTINCT 'f' || l_partkey, ',' ORDER BY 'f' || l_partkey) AS files FROM lineitem WHERE l_returnflag IN ('A', 'N') GROUP BY 1, 2""")
def task_datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers of an order as datasets, parts as files; returned ones are outputs."""
    line = table(spark, sf_dir, "lineitem")
    kind = F.when(F.col("l_returnflag") == "R", "output").when(F.col("l_returnflag") == "A", "input").otherwise("pseudo_input")
    entries = line.select(F.col("l_orderkey").alias("task_id"), F.col("l_suppkey").alias("dataset_id"), F.lit("d").alias("dataset"), kind.alias("kind"), F.concat(F.lit("f"), "l_partkey").alias("file"))
    both = entries.withColumn("type", F.when(F.col("kind") == "output", "output").otherwise("input")).drop("kind")
    return tasks.datasets_of(both, line.select(F.col("l_orderkey").alias("task_id"))).select("task_id", "dataset_id", joined("files").alias("files"))


@query("""SELECT o_orderkey AS task_id, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END AS status, CASE WHEN o_orderkey % 3 = 1 THEN 'no ' || o_orderkey WHEN o_orderkey % 3 = 2 THEN 'connection error: down' END AS error FROM orders""")
def task_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of a service: a record, an error that it tells, or no connection."""
    k = F.col("o_orderkey")
    body = F.when(k % 3 == 0, F.concat(F.lit('{"success": true, "data": {"status": "'), "o_orderpriority", F.lit('"}}'))).when(k % 3 == 1, F.concat(F.lit('{"success": false, "message": "no '), k, F.lit('"}'))).otherwise("down")
    rows = table(spark, sf_dir, "orders").select(k.alias("task_id"), F.when(k % 3 == 2, 1).otherwise(0).alias("status"), body.alias("body"))
    good, bad = tasks.fetched(rows, "status string")
    return good.select("task_id", "status", F.lit(None).cast("string").alias("error")).unionByName(bad.select("task_id", F.lit(None).cast("string").alias("status"), "error"))


@query(f"""WITH {J}, f AS (SELECT task_id, min(job_id) AS job_id FROM j WHERE status = 'failed' GROUP BY 1)
SELECT t.task_id, f.job_id, CASE WHEN f.job_id IS NULL THEN 'no failed jobs found' END AS error, CASE WHEN f.job_id IS NULL THEN NULL WHEN f.job_id % 4 = 0 THEN 0 ELSE 3 END::BIGINT AS total_lines, CASE WHEN f.job_id % 4 <> 0 THEN 'run' END AS last_section_marker, CASE WHEN f.job_id IS NULL THEN NULL WHEN f.job_id % 4 = 0 THEN '' ELSE 'FATAL in ' || f.job_id END AS errors
FROM (SELECT DISTINCT task_id FROM j) t LEFT JOIN f USING (task_id)""")
def task_failed_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary of each task's first failed job's log; every fourth job has none."""
    jobs = tables.jobs(spark, sf_dir)
    text = F.concat(F.lit("=== run ===\nFATAL in "), "job_id", F.lit("\nend"))
    kept = jobs.filter("job_id % 4 <> 0").select("job_id", F.lit("payload.stdout").alias("filename"), text.alias("text")).unionByName(jobs.select("job_id", F.lit("pilotlog.txt").alias("filename"), F.lit("other").alias("text")))
    out = tasks.failed_log_summaries(jobs.select("task_id"), jobs, kept)
    return out.select("task_id", "job_id", "error", "total_lines", "last_section_marker", joined("error_lines").alias("errors"))


@query("""WITH k AS (SELECT c_custkey AS task_id, 50 + c_custkey % 50 AS a, 20 + c_custkey % 20 AS b, 5 + c_custkey % 5 AS c FROM customer)
SELECT task_id, 'http://logs/' || task_id AS url, name, before, after FROM (SELECT task_id, 'memory' AS name, a AS before, b AS after FROM k UNION ALL SELECT task_id, 'busy', b, c FROM k)""")
def task_funnels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Funnels in the logs that errors link to; the second link has no text."""
    url = F.concat(F.lit("http://logs/"), "log_id")
    texts = tables.brokerage_logs(spark, sf_dir).groupBy("log_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("text")).select("log_id", url.alias("url"), "text")
    error = F.concat(F.lit('failed <a href="'), url, F.lit('">log</a>, <a class="x" href="http://logs/none">more</a>'))
    asked = texts.select(F.col("log_id").alias("task_id"), error.alias("error"), F.concat(F.lit("S"), F.col("log_id") % 7).alias("site"), F.lit("S99").alias("includedSite"))
    return tasks.funnels(asked, texts.select("url", "text").unionByName(spark.createDataFrame([("http://logs/none", "")], "url string, text string")))[0].select("task_id", "url", "name", "before", "after")


# sessions and stores


@query("""SELECT o_orderkey AS id, '  status: ' || o_orderstatus || chr(10) || '  site: ' || o_orderpriority AS signals, CASE o_orderstatus WHEN 'F' THEN 'red' ELSE 'green' END AS style, CASE WHEN o_totalprice >= 70000 THEN 'high' WHEN o_totalprice >= 40000 THEN 'medium' ELSE 'low' END AS band FROM orders""")
def session_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a session begins with, the colour of a status, and bands of confidence."""
    task = F.create_map(F.lit("status"), F.col("o_orderstatus"), F.lit("other"), F.lit("x"), F.lit("site"), F.col("o_orderpriority"), F.lit("gshare"), F.lit(""))
    style = session.status_style(F.when(F.col("o_orderstatus") == "F", "failed").otherwise("done"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), session.signals(task).alias("signals"), style.alias("style"), scalars.confidence_band(F.col("o_totalprice") / 100000).alias("band"))


@query("""SELECT doc_id AS id, CASE WHEN text IS NULL THEN '{"status":"failed"}' ELSE '{"status":"failed","taskName":"' || length(left(text, 500)) || '"}' END AS summary FROM documents""")
def session_task_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of a task that matter, in their order; others are left out."""
    d = table(spark, sf_dir, "documents")
    size = F.length(F.get_json_object(session.task_summary(F.create_map(F.lit("errorDialog"), F.col("text"))), "$.errorDialog"))
    task = F.map_filter(F.create_map(F.lit("zone"), F.lit("x"), F.lit("taskName"), F.when(F.col("text").isNotNull(), F.coalesce(size, F.lit(0)).cast("string")), F.lit("status"), F.lit("failed")), lambda k, v: v.isNotNull())
    return d.select(F.col("doc_id").alias("id"), session.task_summary(task).alias("summary"))


@query("""SELECT doc_id AS task_id, 'task_log:a' AS label, md5(left(text, 1000)) AS text FROM documents WHERE regexp_matches(coalesce(text, ''), '\\S') UNION ALL SELECT doc_id, 'email', md5(left(text, 2000)) FROM documents WHERE regexp_matches(coalesce(text, ''), '\\S') AND doc_id % 2 = 0
UNION ALL SELECT doc_id, 'email_investigation', md5('looked') FROM documents WHERE doc_id % 2 = 1""")
def session_excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a reviewer is given of mails and logs."""
    d = table(spark, sf_dir, "documents")
    mails = d.select(F.col("doc_id").alias("task_id"), "text", F.when(F.col("doc_id") % 2 == 1, " looked\n").alias("investigation"))
    kept = d.select(F.col("doc_id").alias("task_id"), F.lit("a").alias("name"), "text")
    pages = kept.limit(0).withColumnRenamed("name", "query")
    return session.excerpts(mails, kept, pages).select("task_id", "label", F.md5("text").alias("text"))


@query("""SELECT c_custkey AS id, '{"userName":"<redacted>","status":"' || c_mktsegment || '"}' AS task, '{"prodUserID":"<redacted>"}' AS external, '[{"score":0.5,"entry":"e","content":"' || c_name || '"}]' AS hits FROM customer""")
def session_cause_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a cause is sought from, without personal fields."""
    task = F.create_map(F.lit("userName"), F.col("c_name"), F.lit("status"), F.col("c_mktsegment"))
    hits = F.array(F.struct(F.lit(0.5).alias("score"), F.lit("e").alias("entry"), F.col("c_name").alias("content")))
    made = session.cause_inputs(task, F.create_map(F.lit("prodUserID"), F.lit(None).cast("string")), hits)
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), made.alias("m")).select("id", "m.*")


@query("""SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE 'Unable to determine root cause' END AS root_cause, CASE WHEN c_custkey % 2 = 0 THEN 0.75 ELSE 0.0 END::DOUBLE AS confidence, CASE WHEN c_custkey % 2 = 0 THEN 'tools.a()' ELSE '' END AS code, CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE 0 END AS gaps,
 CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE '(DRAFT GENERATION FAILED — fill in manually)' END AS draft FROM customer""")
def session_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Causes, code and drafts from models' answers; half of them can't be read."""
    good = F.col("c_custkey") % 2 == 0
    answer = lambda *parts: F.when(good, F.concat(*parts)).otherwise("no json")
    cause = session.cause_answer(answer(F.lit('```json\n{"root_cause": "'), F.col("c_name"), F.lit('", "confidence": 0.75}\n```')))
    code = session.code_answer(answer(F.lit('{"orchest_code": "tools.a()", "capability_gaps": [{"investigation": "x"}, {"investigation": ""}]}')))
    draft = session.draft_body(answer(F.lit('{"cause": "'), F.col("c_name"), F.lit('"}')), F.col("c_custkey"), F.lit("e"))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), cause["root_cause"].alias("root_cause"), cause["confidence"].alias("confidence"), code["code"].alias("code"), F.size(code["gaps"]).alias("gaps"), draft["cause"].alias("draft"))


@query("""WITH n AS (SELECT l_orderkey AS g, '[' || string_agg('{"type":"Cause","name":"p' || l_partkey || '","description":"' || l_returnflag || '"}', ',' ORDER BY l_linenumber, l_partkey, l_returnflag) || ']' AS n, '[' || string_agg('{"source":"p' || l_partkey || '","target":"x","type":"solved_by"}', ',' ORDER BY l_linenumber, l_partkey) || ']' AS e FROM lineitem GROUP BY 1)
SELECT g AS graph_id, md5('{"nodes":' || n || ',"relationships":' || e || '}') AS json FROM n""")
def session_graph_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's parts as a graph in JSON."""
    line = table(spark, sf_dir, "lineitem")
    place, name = F.struct("l_linenumber", "l_partkey").alias("place"), F.concat(F.lit("p"), "l_partkey")
    nodes = line.select(F.col("l_orderkey").alias("graph_id"), place, F.lit("Cause").alias("node_type"), name.alias("name"), F.col("l_returnflag").alias("description"))
    edges = line.select(F.col("l_orderkey").alias("graph_id"), place, name.alias("src"), F.lit("x").alias("tgt"), F.lit("solved_by").alias("rel"))
    return session.graph_json(nodes, edges).select("graph_id", F.md5("json").alias("json"))


@query("""SELECT 'run' AS what, count(*) AS n FROM part WHERE p_size % 3 = 0 UNION ALL SELECT 'suggest', count(*) FROM part WHERE p_size % 3 = 1 UNION ALL SELECT 'anew', count(*) FROM part WHERE p_size % 3 = 2""")
def session_procedures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Procedures with code that may be run again, that changes things, and without code."""
    third = F.col("p_size") % 3
    rows = table(spark, sf_dir, "part").select(F.col("p_brand").alias("cause"), F.col("p_name").alias("name"), F.lit("s").alias("strategy"), F.when(third == 0, "tools.read()").when(third == 1, "tools.kill_job()").otherwise(" ").alias("code"), F.lit("").alias("summary"), F.lit(None).cast("string").alias("description"), F.array(F.lit("p")).alias("parameters"), F.array(F.lit("t")).alias("triggers"))
    again, suggested, anew = session.split_procedures(rows, ["kill_job"])
    count = lambda df, what: df.agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "n")
    return count(again, "run").unionByName(count(suggested, "suggest")).unionByName(count(anew, "anew"))


@query("""SELECT o_orderkey AS graph_id, (CASE WHEN o_orderkey % 2 = 0 THEN 3 ELSE 0 END)::BIGINT AS added FROM orders""")
def session_narration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much a narrated answer adds to an order's graph: a cause, a resolution and the edge between them; symptoms and unknown ends don't count."""
    answer = """{"nodes": [{"node_type": "Cause", "name": "c"}, {"node_type": "Resolution", "name": "r"}, {"node_type": "Symptom", "name": "s"}], "relationships": [{"source_name": "c", "target_name": "r", "relation_type": "solved_by"}, {"source_name": "c", "target_name": "gone", "relation_type": "solved_by"}, {"source_name": "c", "target_name": "r", "relation_type": "odd"}]}"""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("graph_id"), "o_orderpriority")
    nodes = o.select("graph_id", F.lit(0).alias("place"), F.lit("Symptom").alias("node_type"), F.col("o_orderpriority").alias("name"), F.lit("").alias("description"))
    edges = spark.createDataFrame([], "graph_id long, place int, src string, rel string, tgt string, confidence double")
    return extract.merge_narration(nodes, edges, o.select("graph_id", F.when(F.col("graph_id") % 2 == 0, answer).otherwise("none").alias("answer")))[2]


@query("""SELECT o_orderkey AS graph_id, 'Procedure' AS node_type, 's:tentative:' || o_orderkey AS name, 'proc__a__b' AS tool FROM orders UNION ALL SELECT o_orderkey, 'Task_Context', 'result:' || o_orderkey, NULL FROM orders""")
def session_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an action leaves in a session's graph."""
    runs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("graph_id"), F.col("o_orderkey").cast("string").alias("action_id"), F.lit("s").alias("strategy"), F.lit("tools.b(tools.a)").alias("code"), F.lit("does").alias("summary"), F.lit(None).cast("string").alias("error"), F.lit("{}").alias("result"))
    return extract.atomic_action(runs).select("graph_id", "node_type", "name", F.get_json_object("metadata", "$.tool_name").alias("tool"))


@query("""WITH k AS (SELECT c_custkey AS id, 'a' AS name, length(c_name) + 2 AS size FROM customer UNION ALL SELECT c_custkey, 'b', length(c_mktsegment) + 2 FROM customer UNION ALL SELECT c_custkey, 'c', 3 FROM customer)
SELECT id AS task_id, name, size FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY size DESC, name) AS r FROM k) WHERE r <= 2""")
def session_largest_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two longest fields of each customer."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("task_id"), F.create_map(F.lit("a"), F.col("c_name"), F.lit("b"), F.col("c_mktsegment"), F.lit("c"), F.lit("x")).alias("m"))
    return session.largest_keys(rows, "m", most=2).select("task_id", "name", "size")


@query("""WITH f AS (SELECT o_orderpriority AS error, min(o_orderkey) AS id, count(*) AS n FROM orders GROUP BY 1) SELECT error, id AS task_id, n AS tasks, coalesce('label of ' || CASE WHEN error LIKE '1%' THEN error END, '') AS label FROM f""")
def store_drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One draft for all orders of a priority."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("task_id"), F.col("o_orderpriority").alias("error"), F.create_map(F.lit("status"), F.col("o_orderstatus")).alias("task"), F.lit("body").alias("body"))
    labels = rows.select("error").distinct().filter("error like '1%'").withColumn("label", F.concat(F.lit("label of "), "error"))
    return store.drafts(rows, labels, "2024-01-01").select("error", "task_id", F.size("task_ids").cast("long").alias("tasks"), F.col("errorDialog_canonical").alias("label"))


@query("""SELECT c_custkey AS task_id, 'task_' || c_custkey || CASE WHEN c_custkey % 5 = 0 THEN '_now.json' ELSE '.json' END AS file FROM customer WHERE c_custkey % 3 <> 0 OR c_mktsegment <> 'BUILDING'""")
def store_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' drafts to be archived: those filled in from an entry that says the same are not; names that are taken get a stamp."""
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    body = lambda x: F.struct(F.lit("b").alias("background"), x.alias("cause"), F.lit("").alias("resolution"), F.array().cast("array<string>").alias("procedure"))
    rows = c.select(k.alias("task_id"), F.when(k % 3 == 0, "source.json").alias("matched_from"), body(F.col("c_mktsegment")).alias("email_body"))
    approved = c.filter("c_custkey % 5 = 0").select(F.concat(F.lit("task_"), k, F.lit(".json")).alias("file"), body(F.lit("other")).alias("email_body"))
    approved = approved.unionByName(spark.range(1).select(F.lit("source.json").alias("file"), body(F.lit("BUILDING")).alias("email_body")))
    return store.archive(rows, approved, "now").select("task_id", "file")


@query("""SELECT p_partkey AS id, CASE WHEN p_size % 2 = 0 THEN p_type || ' + ' || p_brand ELSE p_brand END AS description FROM part""")
def store_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Procedures whose description differs from the stored one get both."""
    p = table(spark, sf_dir, "part").withColumn("name", F.col("p_partkey").cast("string"))
    old = p.select(F.lit("Procedure").alias("node_type"), "name", F.when(F.col("p_size") % 2 == 0, F.col("p_type")).otherwise(F.concat(F.lit(" "), "p_brand")).alias("description"))
    new = p.select(F.lit("Procedure").alias("node_type"), "name", F.col("p_brand").alias("description"))
    return store.merge_descriptions(old, new, lambda a, b: F.concat(a, F.lit(" + "), b)).select(F.col("name").cast("long").alias("id"), "description")


@query("""SELECT vec_id AS id FROM embeddings WHERE vec_id % 7 <> 0""")
def store_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors without every seventh."""
    p = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"))
    return store.delete_by_id(p, p.filter("id % 7 = 0"))


# functions and telemetry


@query(r"""SELECT o_orderkey AS id, CASE WHEN s < 60 THEN s || 's' WHEN s < 3600 THEN s // 60 || 'm' || s % 60 || 's' ELSE s // 3600 || 'h' || s % 3600 // 60 || 'm' END AS duration,
 CASE WHEN s < 3600 THEN s // 60 || 'm' || lpad((s % 60)::VARCHAR, 2, '0') || 's' ELSE s // 3600 || 'h' || lpad((s % 3600 // 60)::VARCHAR, 2, '0') || 'm' END AS clock,
 trim(regexp_replace(o_orderpriority || '/é', '[^A-Za-z0-9._-]+', '_', 'g'), '_') AS file, ((length(o_orderpriority) + 2) // 3)::INT AS tokens, sha256('x' || chr(10) || '  ' || o_orderstatus) AS code, split_part(o_orderpriority, '-', 1) = '1' AS same, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS time
FROM (SELECT *, o_orderkey % 10000 AS s FROM orders)""")
def function_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formats of times, names and code."""
    s, pr = F.col("o_orderkey") % 10000, F.col("o_orderpriority")
    code = F.concat(F.lit("x  \n\n  "), "o_orderstatus", F.lit(" \n"))
    stamp = F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), scalars.duration(s).alias("duration"), scalars.offset(s).alias("clock"), scalars.safe_filename(F.concat(pr, F.lit("/é"))).alias("file"), scalars.token_estimate(pr).alias("tokens"), scalars.code_hash(code).alias("code"),
        scalars.same_model(F.regexp_replace(pr, "-", ":"), F.lit("1:latest")).alias("same"), F.date_format(scalars.parse_time(F.regexp_replace(stamp, " ", "T")), "yyyy-MM-dd HH:mm:ss").alias("time"),
    )


@query("""SELECT user_id AS host, CASE WHEN on_ = 0 THEN 'the GPU was NEVER used by ollama during this job' WHEN m <= 2 THEN 'resident on the GPU but NO COMPUTE observed (sm never exceeded ' || m || '%)' WHEN on_ = n THEN 'ollama was on the GPU for every sample' ELSE 'ollama was on the GPU for ' || on_ * 100 // n || '% of samples' END AS verdict
FROM (SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'click') AS on_, max(floor(value)::INT) AS m FROM events GROUP BY 1)""")
def accelerator_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each host's samples say, clicks being on the accelerator."""
    by = tables.samples(spark, sf_dir).groupBy("host").agg(F.count("*").alias("n"), F.count_if(F.col("state") == "click").alias("on"), F.max("sm").alias("m"))
    return by.select("host", telemetry.verdict(F.col("on"), F.col("n"), F.col("m")).alias("verdict"))


@query("""SELECT event_id AS id, CASE WHEN event_id % 4 = 0 THEN 'unreachable' WHEN event_id % 4 = 1 THEN 'unloaded' WHEN floor(value) <= 0 THEN 'unloaded' WHEN event_id % 4 = 2 THEN 'cpu' ELSE 'gpu-full' END AS state FROM events""")
def accelerator_residency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a server says that a model is: no answer, not loaded, in memory, on the accelerator."""
    e, size = table(spark, sf_dir, "events"), F.floor("value").cast("string")
    entry = lambda vram: F.concat(F.lit('{"models": [{"name": "other", "size": 5}, {"model": "m:latest", "size": '), size, F.lit(', "size_vram": '), vram, F.lit("}]}"))
    fourth = F.col("event_id") % 4
    payload = F.when(fourth == 0, "<html>").when(fourth == 1, '{"models": []}').when(fourth == 2, entry(F.lit("0"))).otherwise(entry(size))
    return e.select(F.col("event_id").alias("id"), telemetry.residency(payload, "m")["state"].alias("state"))


@query("""SELECT c_custkey AS id, 'produser-' || substr(sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || ('prodUserID:' || c_custkey)::BLOB))), 1, 8) AS token FROM customer""".format(inner=bytes(b ^ 0x36 for b in b"salt".ljust(64, b"\0")).hex(), outer=bytes(b ^ 0x5C for b in b"salt".ljust(64, b"\0")).hex()))
def privacy_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of the fields that a setting adds to the sensitive ones."""
    fields = privacy.sensitive_fields(("x",), " y ,prodUserID, ")
    record = F.create_map(F.lit("prodUserID"), F.col("c_custkey").cast("string"), F.lit("kept"), F.lit("as it is"))
    made = privacy.pseudonymise(record, "salt", fields)
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), made["prodUserID"].alias("token")).filter(F.lit({"x", "y", "userName"} <= set(fields)))
