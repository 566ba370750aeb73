"""Queries over the driver's tables by name, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegraph.functions import scalars
from tidegraph.operators import classify, compare, docs, graph, logs, privacy, telemetry, vectors
from tidegraph.plans import tables
from tidegraph.streaming import telemetry as stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
SALT = "salt"

OBS = """
joined AS (
  SELECT l_orderkey, l_linenumber * 100000000000000 + l_partkey * 10000000 + l_suppkey AS seq, l_discount, l_returnflag, o_orderpriority, p_brand, p_type, s_name, n_name
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
  JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey),
obs AS (
  SELECT 'Symptom' AS src_type, o_orderpriority AS src, 'indicate' AS rel, 'Cause' AS tgt_type, p_brand AS tgt, l_orderkey::VARCHAR AS graph_id, l_discount AS confidence, seq FROM joined
  UNION ALL SELECT 'Task_Feature', p_type, 'contribute_to', 'Cause', p_brand, l_orderkey::VARCHAR, l_discount, seq FROM joined
  UNION ALL SELECT 'Environment', n_name, 'contribute_to', 'Cause', p_brand, l_orderkey::VARCHAR, l_discount, seq FROM joined
  UNION ALL SELECT 'Component', s_name, 'originated_from', 'Cause', p_brand, l_orderkey::VARCHAR, l_discount, seq FROM joined WHERE l_returnflag = 'R'),
once AS (SELECT src_type, src, rel, tgt_type, tgt, graph_id, arg_min(confidence, (seq, confidence)) AS confidence FROM obs GROUP BY ALL)
"""
LINES = r"""
lines AS (
  SELECT doc_id AS log_id, unnest(range(len(l))) AS line_no, unnest(l) AS line
  FROM (SELECT doc_id, string_split(regexp_replace(text, '\n$', ''), chr(10)) AS l FROM documents WHERE length(text) > 0))
"""


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# graph


@query(f"""WITH {OBS},
clue AS (SELECT src_type, min(src) AS src, any_value(rel) AS rel FROM obs GROUP BY src_type),
hit AS (SELECT o.tgt AS name, count(DISTINCT o.src_type) AS match_score FROM obs o JOIN clue c USING (src_type, src, rel) GROUP BY 1),
cause AS (SELECT p_brand AS name, count(*) AS frequency, round(avg(l_discount), 6) AS confidence FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1)
SELECT name, match_score, frequency, confidence FROM hit JOIN cause USING (name)
ORDER BY match_score DESC, frequency DESC, confidence DESC, name LIMIT 10""")
def graph_find_causes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The causes that the first clue of each type leads to."""
    clues = tables.first_clues(spark, sf_dir)
    asked = {r["clue_type"]: [r["clue"]] for r in clues.collect()}  # one of each type
    return graph.find_causes(tables.edge_observations(spark, sf_dir, asked), tables.causes(spark, sf_dir), clues).select("name", "match_score", "frequency", "confidence")


@query(f"""WITH {OBS}
SELECT src_type, src, rel, tgt, count(*) AS frequency, round(sum(confidence) * 100)::BIGINT AS confidence_cents
FROM once GROUP BY 1, 2, 3, 4""")
def graph_merge_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All observations merged to edges."""
    e = graph.merge_edges(tables.edge_observations(spark, sf_dir))
    return e.select("src_type", "src", "rel", "tgt", "frequency", F.round(F.col("confidence") * F.col("frequency") * 100).cast("long").alias("confidence_cents"))


@query(f"""WITH {OBS}
SELECT src_type, src, rel, tgt, count(*) AS occurrences, round(sum(confidence) * 100)::BIGINT AS confidence_cents FROM once GROUP BY 1, 2, 3, 4 HAVING count(*) >= 20""")
def graph_common_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges that at least 20 graphs share."""
    p = graph.common_pattern(tables.edge_observations(spark, sf_dir), least=20)
    return p.select("src_type", "src", "rel", "tgt", "occurrences", F.round(F.col("confidence") * F.col("occurrences") * 100).cast("long").alias("confidence_cents"))


@query(f"""WITH {OBS},
pattern AS (SELECT src_type, src, tgt_type, tgt FROM once GROUP BY ALL HAVING count(*) >= 20)
SELECT node_type, count(*) AS n FROM (SELECT src_type AS node_type, src AS name FROM pattern UNION SELECT tgt_type, tgt FROM pattern) GROUP BY 1""")
def graph_pattern_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Node types of the common pattern."""
    return graph.pattern_report(graph.common_pattern(tables.edge_observations(spark, sf_dir), least=20))


@query(f"""WITH {OBS},
nodes AS (SELECT src_type AS t, src AS n FROM obs UNION SELECT tgt_type, tgt FROM obs),
edges AS (SELECT DISTINCT src_type, src, rel, tgt FROM obs)
SELECT 'node' AS kind, t AS label, count(*) AS n FROM nodes GROUP BY 2 UNION ALL SELECT 'relation', rel, count(*) FROM edges GROUP BY 2""")
def graph_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes and edges by type."""
    obs = tables.edge_observations(spark, sf_dir)
    nodes = obs.select(F.col("src_type").alias("node_type"), F.col("src").alias("name")).union(obs.select("tgt_type", "tgt")).distinct()
    return graph.summary(nodes, obs.select("src_type", "src", "rel", "tgt").distinct())


@query(f"""WITH {OBS},
new AS (SELECT 'Symptom' AS src_type, o_orderstatus AS src, 'indicate' AS rel, 'closed ' || o_orderpriority AS tgt, o_orderkey::VARCHAR AS graph_id FROM orders WHERE o_orderstatus = 'F'),
rest AS (SELECT src_type, src, rel, tgt, graph_id FROM obs WHERE graph_id NOT IN (SELECT graph_id FROM new) UNION ALL SELECT * FROM new)
SELECT src_type, rel, count(DISTINCT src || '|' || tgt) AS edges, count(DISTINCT graph_id) AS graphs FROM rest GROUP BY 1, 2""")
def graph_reprocess(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges by type after the graphs of finished orders were replaced."""
    obs = tables.edge_observations(spark, sf_dir)
    o = tables.table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'")
    new = o.select(F.lit("Symptom").alias("src_type"), F.col("o_orderstatus").alias("src"), F.lit("indicate").alias("rel"), F.lit("Cause").alias("tgt_type"), F.concat(F.lit("closed "), "o_orderpriority").alias("tgt"), F.col("o_orderkey").cast("string").alias("graph_id"), F.lit(1.0).alias("confidence"), F.lit(None).cast("string").alias("parameters"), F.lit(0).cast("long").alias("seq"))
    rest = graph.reprocess(obs, new)
    return rest.groupBy("src_type", "rel").agg(F.count_distinct(F.concat("src", F.lit("|"), "tgt")).alias("edges"), F.count_distinct("graph_id").alias("graphs"))


@query(f"""WITH {OBS}, known AS (SELECT DISTINCT src FROM obs WHERE src_type = 'Symptom'),
asked AS (SELECT DISTINCT o_orderpriority AS name FROM orders UNION SELECT n_name FROM nation)
SELECT name, name IN (SELECT src FROM known) AS matched FROM asked""")
def graph_novelty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which symptoms are known: priorities are, nations aren't."""
    asked = tables.table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("name")).union(tables.table(spark, sf_dir, "nation").select("n_name"))
    return graph.novelty(tables.edge_observations(spark, sf_dir), asked)


@query(f"""WITH {OBS},
links AS (SELECT graph_id, count(DISTINCT src_type || src) FILTER (src_type <> 'Task_Feature') AS a, count(DISTINCT tgt) AS b FROM obs GROUP BY 1),
have AS (SELECT graph_id, count(DISTINCT src_type || '|' || src || '|' || tgt) AS n FROM obs WHERE src_type IN ('Symptom', 'Component') GROUP BY 1)
SELECT l.graph_id, (a * b - coalesce(h.n, 0))::BIGINT AS added FROM links l LEFT JOIN have h USING (graph_id) WHERE a * b - coalesce(h.n, 0) > 0""")
def graph_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many links between the clues and causes of an order are missing."""
    obs = tables.edge_observations(spark, sf_dir)
    n, e = "struct<node_type:string,name:string>", "struct<src:string,rel:string,tgt:string>"
    node = lambda kind, name: F.struct(F.struct(F.col(kind).alias("node_type"), F.col(name).alias("name")).cast(n).alias("node"), F.lit(None).cast(e).alias("edge"))
    edge = F.struct(F.lit(None).cast(n).alias("node"), F.struct("src", "rel", "tgt").cast(e).alias("edge"))
    rows = obs.select("graph_id", F.explode(F.array(node("src_type", "src"), node("tgt_type", "tgt"), edge)).alias("x")).select("graph_id", "x.*")
    return graph.reconcile_grouped(rows).groupBy("graph_id").agg(F.count("*").alias("added"))


@query(f"""WITH {OBS}
SELECT graph_id, array_to_string(list_sort(list(DISTINCT src) FILTER (src_type = 'Symptom')), ',') AS symptoms,
  array_to_string(list_sort(list(DISTINCT src) FILTER (src_type = 'Environment')), ',') AS environments,
  coalesce(array_to_string(list_sort(list(DISTINCT src) FILTER (src_type = 'Component')), ','), '') AS components FROM obs GROUP BY 1""")
def graph_clue_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of each kind of clue per order."""
    obs = tables.edge_observations(spark, sf_dir).select("graph_id", F.col("src_type").alias("node_type"), F.col("src").alias("name"), F.lit(None).cast("string").alias("description"))
    lists = graph.clue_lists(obs)
    return lists.select("graph_id", F.array_join("symptoms", ",").alias("symptoms"), F.array_join("environment_factors", ",").alias("environments"), F.array_join("components", ",").alias("components"))


@query("""WITH RECURSIVE link AS (SELECT conv_id * 1000 + turn AS id, CASE WHEN turn > 0 THEN conv_id * 1000 + turn - 1 END AS next FROM conversations),
last AS (SELECT conv_id * 1000 + max(turn) AS id FROM conversations GROUP BY conv_id),
walk AS (SELECT id AS start, 0 AS hop, id FROM last UNION ALL SELECT w.start, w.hop + 1, l.next FROM walk w JOIN link l ON l.id = w.id WHERE l.next IS NOT NULL AND w.hop < 3)
SELECT start, hop, id FROM walk""")
def graph_retry_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation's last turn and up to three before it."""
    t = tables.table(spark, sf_dir, "conversations")
    here = F.col("conv_id") * 1000 + F.col("turn")
    links = t.select(here.alias("id"), F.when(F.col("turn") > 0, here - 1).alias("next"))
    return graph.chain(links, t.groupBy("conv_id").agg(F.max("turn").alias("turn")).select(here.alias("id")), 3)


@query("""SELECT o_custkey AS id, count(*) AS attempts, sum((o_orderstatus = 'F')::INT)::BIGINT AS successes, round(avg((o_orderstatus = 'F')::INT), 6) AS success_rate FROM orders GROUP BY 1""")
def graph_success_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finished orders of each customer as successes."""
    t = tables.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), (F.col("o_orderstatus") == "F").alias("success"))
    return graph.success_rates(t).withColumn("success_rate", F.round("success_rate", 6))


PROCS = """proc AS (SELECT p_brand AS cause, p_type AS name, count(*) AS frequency FROM part GROUP BY 1, 2)"""


def _procedures(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Types of parts as procedures of their brands; those of PROMO are tentative."""
    part = tables.table(spark, sf_dir, "part")
    edges = part.groupBy(F.col("p_brand").alias("src"), F.col("p_type").alias("tgt")).agg(F.count("*").alias("frequency")).withColumns({"rel": F.lit("investigated_by"), "parameters": F.lit(None).cast("array<string>")})
    status = F.when(F.col("p_type").contains("PROMO"), "tentative").otherwise("final")
    return edges, part.select(F.col("p_type").alias("name"), F.to_json(F.struct(status.alias("status"), F.array("p_type").alias("signature"))).alias("metadata")).distinct()


@query(f"""WITH {PROCS} SELECT cause, name, frequency FROM proc WHERE cause IN ('Brand#1', 'Brand#2') AND NOT contains(name, 'PROMO')""")
def graph_find_procedures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Procedures of two causes, without tentative ones."""
    return graph.find_procedures(*_procedures(spark, sf_dir), ["Brand#1", "Brand#2"]).select("cause", "name", "frequency")


@query(f"""WITH {PROCS}, t AS (SELECT name, sum(frequency)::BIGINT AS frequency, array_to_string(list_sort(list(DISTINCT cause)), ',') AS causes FROM proc GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5)
SELECT * FROM t WHERE NOT contains(name, 'PROMO')""")
def graph_all_procedures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five most frequent procedures, then without tentative ones."""
    return graph.all_procedures(*_procedures(spark, sf_dir), limit=5).select("name", "frequency", F.array_join("cause_names", ",").alias("causes"))


@query(f"""WITH {OBS}, gone AS (SELECT max(graph_id) AS g FROM obs),
hit AS (SELECT DISTINCT src_type, src, rel, tgt FROM obs, gone WHERE graph_id = g), rest AS (SELECT o.* FROM obs o, gone WHERE graph_id <> g),
nodes AS (SELECT src_type AS t, src AS n FROM obs UNION SELECT tgt_type, tgt FROM obs), left_ AS (SELECT src_type AS t, src AS n FROM rest UNION SELECT tgt_type, tgt FROM rest)
SELECT (SELECT count(*) FROM hit) AS rels_affected, (SELECT count(*) FROM nodes) - (SELECT count(*) FROM left_) AS nodes_removed""")
def graph_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What goes with the last graph."""
    obs = tables.edge_observations(spark, sf_dir)
    nodes = obs.select(F.col("src_type").alias("node_type"), F.col("src").alias("name")).union(obs.select("tgt_type", "tgt")).distinct()
    return graph.remove_graph(obs, nodes, [obs.agg(F.max("graph_id")).first()[0]])[2]


@query(f"""WITH {OBS} SELECT graph_id, array_to_string(list_sort(list_filter(['Cause', 'Procedure', 'Component'], lambda x: NOT list_contains(t, x))), ',') AS missing
FROM (SELECT graph_id, list(DISTINCT src_type) || list(DISTINCT tgt_type) AS t FROM obs GROUP BY 1)""")
def graph_missing_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which required kinds each order's graph lacks; components stand for symptoms here."""
    obs = tables.edge_observations(spark, sf_dir)
    kind = F.when(F.col("src_type") == "Component", "Symptom").when(F.col("src_type") == "Symptom", "Other").otherwise(F.col("src_type"))
    nodes = obs.select("graph_id", kind.alias("node_type")).union(obs.select("graph_id", "tgt_type"))
    return graph.missing_parts(nodes).select("graph_id", F.array_join(F.array_sort(F.transform("missing", lambda x: F.when(x == "Symptom", "Component").otherwise(x))), ",").alias("missing"))


@query("""WITH c AS (SELECT c_custkey AS id, c_mktsegment AS segment, c_nationkey AS nation FROM customer),
last AS (SELECT o_custkey AS id, arg_max(o_orderpriority, (o_orderdate, o_orderkey)) AS value FROM orders GROUP BY 1)
SELECT c.id, coalesce(l.value, c.segment) AS segment FROM c LEFT JOIN last l USING (id)""")
def graph_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' segments set by their last order's priority."""
    c = tables.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"))
    changes = tables.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderpriority").alias("value"), F.struct("o_orderdate", "o_orderkey").alias("seq"))
    return graph.override(c, changes, "segment", ["id"])


@query("""SELECT o_custkey AS id, o_orderkey AS last FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY (o_orderstatus = 'F')::INT DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1""")
def vector_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' last orders, finished ones written after the others."""
    o = tables.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("last"), (F.col("o_orderstatus") == "F").alias("f"))
    return vectors.keep_last(o.filter("not f").drop("f"), o.filter("f").drop("f"), "id", "last")


# vectors


@query("""WITH q AS (SELECT vec_id AS qid, embedding::DOUBLE[] AS e, label FROM embeddings WHERE vec_id % 50 = 0),
s AS (SELECT q.qid, p.vec_id AS id, round(list_cosine_similarity(q.e, p.embedding::DOUBLE[]), 6) AS score,
  row_number() OVER (PARTITION BY q.qid ORDER BY round(list_cosine_similarity(q.e, p.embedding::DOUBLE[]), 12) DESC, p.vec_id) AS rank
  FROM q JOIN embeddings p ON p.label = q.label)
SELECT qid, id, score, rank FROM s WHERE rank <= 5""")
def vector_batch_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of the same label for every query vector."""
    p = tables.points(spark, sf_dir)
    q = p.filter("id % 50 = 0").select(F.col("id").alias("qid"), "embedding", "section")
    return vectors.batch_search(p, q, 5).select("qid", "id", F.round("score", 6).alias("score"), "rank")


@query("""WITH q AS (SELECT embedding::DOUBLE[] AS e, label FROM embeddings ORDER BY vec_id LIMIT 1)
SELECT vec_id AS id, round(list_cosine_similarity(q.e, p.embedding::DOUBLE[]), 6) AS score FROM embeddings p, q
WHERE p.label = q.label ORDER BY list_cosine_similarity(q.e, p.embedding::DOUBLE[]) DESC, vec_id LIMIT 10""")
def vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest to the first vector within its label."""
    p = tables.points(spark, sf_dir)
    first = p.orderBy("id").first()
    return vectors.search(p, first["embedding"], 10, None, section=first["section"]).select("id", F.round("score", 6).alias("score"))


@query("""WITH q AS (SELECT vec_id AS qid, embedding::DOUBLE[] AS e, label FROM embeddings WHERE vec_id % 50 = 0),
s AS (SELECT q.qid, p.vec_id % 97 AS graph_id, round(list_cosine_similarity(q.e, p.embedding::DOUBLE[]), 12) AS score,
  row_number() OVER (PARTITION BY q.qid ORDER BY round(list_cosine_similarity(q.e, p.embedding::DOUBLE[]), 12) DESC, p.vec_id) AS rank
  FROM q JOIN embeddings p ON p.label = q.label)
SELECT qid, graph_id, round(max(score), 6) AS score, 'summary ' || graph_id AS summary FROM s WHERE rank <= 20 GROUP BY qid, graph_id""")
def vector_two_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query vectors to graphs by their best hit, with a summary each."""
    p = tables.points(spark, sf_dir)
    q = p.filter("id % 50 = 0").select(F.col("id").alias("qid"), "embedding", "section")
    hits = vectors.batch_search(p, q, 20).join(p.select("id", "graph_id"), "id")
    summaries = spark.range(97).select("id", F.col("id").alias("graph_id"), F.lit("Summary").alias("section"), F.concat(F.lit("summary "), F.col("id")).alias("content"))
    return vectors.two_step(hits, summaries).select("qid", "graph_id", F.round("score", 6).alias("score"), "summary")


@query("""WITH q AS (SELECT vec_id AS qid, embedding::DOUBLE[] AS e, label FROM embeddings WHERE vec_id % 50 = 0),
s AS (SELECT q.qid, p.vec_id AS id, p.label = q.label AS same,
  row_number() OVER (PARTITION BY q.qid ORDER BY round(list_cosine_similarity(q.e, p.embedding::DOUBLE[]), 12) DESC, p.vec_id) AS rank
  FROM q, embeddings p WHERE p.vec_id <> q.qid)
SELECT qid, round(avg(same::INT), 6) AS same_label FROM s WHERE rank <= 10 GROUP BY qid""")
def vector_leave_one_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each query's ten nearest others, the share with its label."""
    p = tables.points(spark, sf_dir)
    q = p.filter("id % 50 = 0").select(F.col("id").alias("qid"), "embedding", F.col("section"))
    hits = vectors.batch_search(p, q, 10, sections=False, skip_self=True)
    return hits.join(p.select("id", "section"), "id").join(q.select("qid", F.col("section").alias("own")), "qid").groupBy("qid").agg(F.round(F.avg((F.col("section") == F.col("own")).cast("int")), 6).alias("same_label"))


@query()
def vector_greedy_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Openers of greedy clusters within labels."""
    return vectors.greedy_clusters(tables.points(spark, sf_dir), 0.85)


@query("""WITH RECURSIVE t AS (SELECT o_custkey AS key, o_orderkey::VARCHAR AS name, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS pos,
  (10 + o_orderkey % 40)::BIGINT AS full_, (5 + o_orderkey % 7)::BIGINT AS compact FROM orders),
walk AS (
  SELECT key, pos, full_ AS used, false AS misfit, 'full' AS tier FROM t WHERE pos = 0
  UNION ALL
  SELECT t.key, t.pos, w.used + CASE WHEN NOT w.misfit AND t.pos < 25 AND w.used + t.full_ <= 100 THEN t.full_ ELSE 0 END, w.misfit OR t.pos >= 25 OR w.used + t.full_ > 100,
    CASE WHEN NOT w.misfit AND t.pos < 25 AND w.used + t.full_ <= 100 THEN 'full' END FROM walk w JOIN t ON t.key = w.key AND t.pos = w.pos + 1),
rest AS (SELECT t.*, row_number() OVER (PARTITION BY t.key ORDER BY t.pos) AS r FROM t JOIN walk w ON w.key = t.key AND w.pos = t.pos WHERE w.tier IS NULL),
spent AS (SELECT key, max(used) AS used FROM walk WHERE tier = 'full' GROUP BY 1),
fill AS (
  SELECT r.key, r.r, r.pos, s.used + CASE WHEN s.used + r.compact <= 100 THEN r.compact ELSE 0 END AS used, s.used + r.compact <= 100 AS taken FROM rest r JOIN spent s ON s.key = r.key WHERE r.r = 1
  UNION ALL
  SELECT r.key, r.r, r.pos, f.used + CASE WHEN f.used + r.compact <= 100 THEN r.compact ELSE 0 END, f.used + r.compact <= 100 FROM fill f JOIN rest r ON r.key = f.key AND r.r = f.r + 1)
SELECT t.key, t.name, t.pos, 'full' AS tier FROM walk w JOIN t ON t.key = w.key AND t.pos = w.pos WHERE w.tier = 'full'
UNION ALL SELECT t.key, t.name, t.pos, 'compact' FROM fill f JOIN t ON t.key = f.key AND t.pos = f.pos WHERE f.taken""")
def vector_tool_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's orders whose costs fit a budget: whole ones first, then short ones."""
    o = tables.table(spark, sf_dir, "orders")
    pos = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    t = o.select(F.col("o_custkey").alias("key"), F.col("o_orderkey").cast("string").alias("name"), pos.cast("long").alias("pos"), (10 + F.col("o_orderkey") % 40).alias("full"), (5 + F.col("o_orderkey") % 7).alias("compact"))
    return vectors.pack(t, 100).select("key", "name", "pos", "tier")


@query("""SELECT vec_id AS id, label::VARCHAR AS section, h FROM (SELECT vec_id, label, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || (label || ':' || vec_id)::BLOB) AS s,
 substr(s, 1, 8) || '-' || substr(s, 9, 4) || '-5' || substr(s, 14, 3) || '-' || substr('89ab', (('0x' || substr(s, 17, 1))::INT % 4) + 1, 1) || substr(s, 18, 3) || '-' || substr(s, 21, 12) AS h FROM embeddings)""")
def vector_point_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deterministic ids from label and number."""
    return tables.points(spark, sf_dir).select("id", "section", vectors.point_id(F.col("section"), F.col("id").cast("string")).alias("h"))


# records

def _cases(x: str, steps: tuple) -> str:
    return "CASE " + " ".join(f"WHEN {x} < {upper} THEN '{label}'" if upper else f"ELSE '{label}'" for upper, label in steps) + " END"


RAM = (512, "<512MB"), (1024, "512MB-1GB"), (2048, "1-2GB"), (3072, "2-3GB"), (4096, "3-4GB"), (6144, "4-6GB"), (8192, "6-8GB"), (12288, "8-12GB"), (16384, "12-16GB"), (32768, "16-32GB"), (None, ">32GB")
SPACE = (1024, "<1GB"), (10240, "1-10GB"), (102400, "10-100GB"), (None, ">100GB")
SPANS = (3600, "<1h"), (21600, "1-6h"), (86400, "6-24h"), (None, ">24h")


@query(f"""SELECT p_partkey AS id, {_cases('p_retailprice * (p_partkey % 40)', RAM)} AS ram, {_cases('p_retailprice * (p_partkey % 200)', SPACE)} AS disk, {_cases('p_size * 1800', SPANS)} AS walltime,
 {_cases('p_size * 4', ((10, '<10MB/s'), (100, '10-100MB/s'), (None, '>100MB/s')))} AS io, {_cases('p_size * 40', ((100, 'low(<100)'), (1000, 'medium(100-1000)'), (None, 'high(>1000)')))} AS intensity, p_type AS other FROM part""")
def classify_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices and sizes of parts as bucketed numbers, and a text that is none."""
    p = tables.table(spark, sf_dir, "part")
    price, size, key = F.col("p_retailprice"), F.col("p_size"), F.col("p_partkey")
    told = {"ram": ("ramCount", price * (key % 40)), "disk": ("outDiskCount", price * (key % 200)), "walltime": ("walltime", size * 1800), "io": ("diskIO", size * 4), "intensity": ("ioIntensity", size * 40), "other": ("cpuTime", F.col("p_type"))}
    return p.select(key.alias("id"), *(classify.bucket(k, x.cast("string")).alias(name) for name, (k, x) in told.items()))


@query("""WITH n AS (
  SELECT o_orderkey AS task_id, 'Symptom' AS node_type, 'TaskStatus' || upper(o_orderstatus) AS name FROM orders
  UNION ALL SELECT o_orderkey, 'Task_Feature', 'taskPriority=' || o_orderpriority FROM orders
  UNION ALL SELECT o_orderkey, 'Task_Feature', 'splitRule:A=' || (o_orderkey % 7) FROM orders
  UNION ALL SELECT o_orderkey, 'Task_Feature', 'splitRule:B=x' FROM orders
  UNION ALL SELECT o_orderkey, 'Symptom', 'code' || (o_orderkey % 5) FROM orders)
SELECT node_type, name, count(*) AS n FROM n GROUP BY ALL""")
def classify_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as task records, classified to nodes."""
    o = tables.table(spark, sf_dir, "orders")
    pairs = {
        "status": F.col("o_orderstatus"), "taskPriority": F.col("o_orderpriority"), "unknownKey": F.lit("x"),
        "splitRule": F.concat(F.lit("A="), F.col("o_orderkey") % 7, F.lit(",bad,B=x")), "errorDialog": F.concat(F.lit("<b>oops</b>  reason=code"), F.col("o_orderkey") % 5, F.lit(" and more")),
    }
    task = F.create_map(*[x for k, v in pairs.items() for x in (F.lit(k), v.cast("string"))])
    rows = o.select(F.col("o_orderkey").alias("task_id"), task.alias("task"))
    return classify.classify(rows, SALT).groupBy("node_type", "name").agg(F.count("*").alias("n"))


ERROR_TEXT = "'<b>job</b> ' || o_orderpriority || ' of ' || o_orderkey || ' at 2024-05-0' || (o_orderkey % 9) || 'T10:00:0' || (o_orderkey % 10) || 'Z took ' || (o_orderkey % 100) || '.5 s on n' || (o_orderkey % 3) || '.grid.example.org id ab12cd34-' || lpad(o_orderkey::VARCHAR, 12, 'e') || '-aaaa-bbbbbbbbb'"


@query(rf"""WITH e AS (SELECT o_orderkey AS seq, {ERROR_TEXT} AS error FROM orders),
n AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(error, '<[^>]+>', ' ', 'g'), '\d{{4}}-\d{{2}}-\d{{2}}[T ]\d{{2}}:\d{{2}}:\d{{2}}\S*', '<TS>', 'g'), '\d+\.\d+', '<FLOAT>', 'g'), '\d+', '<INT>', 'g'),
  '[0-9a-fA-F]{{8}}-[0-9a-fA-F-]{{27}}', '<UUID>', 'g'), '\b[\w-]+(?:\.[\w-]+){{2,}}\b', '<HOST>', 'g') AS x FROM e)
SELECT trim(regexp_replace(x, '\s+', ' ', 'g')) AS normalised, count(*) AS n, arg_min(error, (length(error), seq)) AS representative FROM n GROUP BY 1""")
def classify_error_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error texts of orders with times, fractions, numbers and hosts, grouped by their normal form."""
    key = F.col("o_orderkey")
    text = F.concat(
        F.lit("<b>job</b> "), "o_orderpriority", F.lit(" of "), key, F.lit(" at 2024-05-0"), key % 9, F.lit("T10:00:0"), key % 10, F.lit("Z took "), key % 100, F.lit(".5 s on n"), key % 3,
        F.lit(".grid.example.org id ab12cd34-"), F.lpad(key.cast("string"), 12, "e"), F.lit("-aaaa-bbbbbbbbb"),
    )
    return classify.error_clusters(tables.table(spark, sf_dir, "orders").select(key.alias("seq"), text.alias("error")))


def _pads() -> tuple[str, str]:
    raw = SALT.encode().ljust(64, b"\0")
    return bytes(b ^ 0x36 for b in raw).hex(), bytes(b ^ 0x5C for b in raw).hex()


@query(f"""SELECT c_custkey AS id, 'produser-' || substr(sha256(unhex('{_pads()[1]}') || unhex(sha256(unhex('{_pads()[0]}') || ('prodUserName:' || c_name)::BLOB))), 1, 8) AS token FROM customer""")
def privacy_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyed tokens of customer names."""
    record = F.create_map(F.lit("prodUserName"), F.col("c_name"))
    return tables.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), privacy.pseudonymise(record, SALT)["prodUserName"].alias("token"))


@query("""SELECT s_suppkey AS id, '<redacted>' AS name, s_nationkey::VARCHAR AS nation FROM supplier""")
def privacy_redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier names redacted, other fields as they are."""
    m = privacy.redact(F.create_map(F.lit("userName"), F.col("s_name"), F.lit("nation"), F.col("s_nationkey").cast("string")))
    return tables.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), m["userName"].alias("name"), m["nation"].alias("nation"))


# logs


@query(f"""WITH {LINES}
SELECT log_id, count(*) AS total_lines, sum(length(line) + 1)::BIGINT AS total_chars, count(*) FILTER (regexp_matches(line, '(?i)(error|fatal|exception|traceback|critical|killed|segfault|aborted|panic)([^a-zA-Z0-9_\\p{{L}}\\p{{N}}]|$)')) > 0 AS has_errors FROM lines GROUP BY 1""")
def log_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of documents read as logs, and whether they have error lines."""
    s = logs.summarise(tables.log_lines(spark, sf_dir))
    return s.select("log_id", "total_lines", "total_chars", (F.size("error_lines") > 0).alias("has_errors"))


@query(f"""WITH {LINES},
m AS (SELECT log_id, line_no, line, lag(line) OVER (PARTITION BY log_id ORDER BY line_no) AS before FROM lines),
r AS (SELECT *, sum((before IS NULL OR before <> line)::INT) OVER (PARTITION BY log_id ORDER BY line_no) AS run FROM m)
SELECT log_id, run::BIGINT AS run, count(*) AS n, min(line_no) AS first, max(line_no) AS last FROM r GROUP BY 1, 2""")
def log_equal_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of equal lines in each document."""
    return telemetry.runs(tables.log_lines(spark, sf_dir), "log_id", "line_no", "line").select("log_id", "run", "n", "first", "last")


@query(f"""WITH {LINES},
s AS (SELECT log_id, length(line) AS length, row_number() OVER (PARTITION BY log_id ORDER BY length(line), line_no) - 1 AS nth, count(*) OVER (PARTITION BY log_id) AS n FROM lines)
SELECT log_id, sum(length)::BIGINT AS chars, count(*) AS lines, max(length) AS longest, max(length) FILTER (nth = greatest(0, floor(n * 99 / 100)::INT - 1)) AS p99, max(length) FILTER (nth = n // 2) AS p50, floor(sum(length) / count(*))::BIGINT AS mean FROM s GROUP BY 1""")
def log_line_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of line lengths."""
    return telemetry.line_lengths(tables.log_lines(spark, sf_dir), "log_id")


NOISE = r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:[.,]\d+)?(?:Z|[+-]\d{2}:?\d{2})?|\b\d{2}/\d{2}/\d{4}\b|\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b|0x[0-9a-fA-F]+|\b\d{5,}\b|\b[\w.-]+\.(?:cern\.ch|triumf\.ca|bnl\.gov|slac\.stanford\.edu"
SIGNAL = "error|exception|traceback|fatal|critical|warning|warn|fail|abort|killed|timeout|segfault|panic|denied|refused|missing|not found|brokerage|no candidates|pilot|payload"
MORE = NOISE + r"|desy\.de)\b|(?:root|https?|file|gsiftp)://[^\s''\"]+|/(?:cvmfs|pnfs|eos|tmp|var|home|usr|opt)/[^\s''\"]+|''[^'']*''|\"[^\"]*\"|\[[^\]]*\]|\b[\w.-]+\.(?:data|json|xml|log|root|stdout|stderr|txt|py|so|cfg)\b"


@query(rf"""WITH {LINES},
near AS (SELECT *, max(regexp_matches(line, '(?i){SIGNAL}')::INT) OVER (PARTITION BY log_id ORDER BY line_no ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS near FROM lines),
kept AS (SELECT *, max(near) OVER (PARTITION BY log_id) AS any_ FROM near),
norm AS (SELECT log_id, line_no, line, trim(regexp_replace(line, '{NOISE})\b', '', 'gi')) AS norm FROM kept WHERE near = 1 OR any_ = 0),
once AS (SELECT *, row_number() OVER (PARTITION BY log_id, norm ORDER BY line_no) AS nth FROM norm),
folded AS (SELECT *, lag(norm) OVER (PARTITION BY log_id ORDER BY line_no) AS before FROM once WHERE norm = '' OR nth = 1),
placed AS (SELECT *, row_number() OVER (PARTITION BY log_id ORDER BY line_no) AS place, count(*) OVER (PARTITION BY log_id) AS n FROM folded WHERE norm <> '' OR before IS NULL OR before <> ''),
shown AS (SELECT log_id, place::DOUBLE AS place, line FROM placed WHERE n <= 300 OR place <= 20 OR place > n - 50
  UNION ALL SELECT log_id, 20.5, '... (' || (n - 70) || ' lines omitted) ...' FROM placed WHERE n > 300 AND place = 1)
SELECT log_id, string_agg(line, chr(10) ORDER BY place) AS text FROM shown GROUP BY 1""")
def log_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signal lines of every document."""
    return logs.filtered_text(tables.log_lines(spark, sf_dir))


@query(rf"""WITH {LINES},
norm AS (SELECT log_id, line_no, trim(regexp_replace(line, '{MORE}', '', 'gi')) AS norm FROM lines),
starts AS (SELECT *, (lag(norm) OVER (PARTITION BY log_id ORDER BY line_no) IS DISTINCT FROM norm)::INT AS start FROM norm),
runs AS (SELECT *, sum(start) OVER (PARTITION BY log_id ORDER BY line_no) AS run FROM starts)
SELECT log_id, run::BIGINT AS run, min(norm) AS norm, min(line_no)::INT AS first, max(line_no)::INT AS last FROM runs GROUP BY 1, 2""")
def log_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring lines alike once normalised."""
    return logs.fold_runs(tables.log_lines(spark, sf_dir))


# documents


@query(r"""WITH d AS (SELECT doc_id AS id, list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda x: x <> '') AS w FROM documents),
t AS (SELECT id, unnest(w) AS w FROM d), tf AS (SELECT id, w, count(*) AS tf FROM t GROUP BY ALL),
size AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM d), lens AS (SELECT id, len(w) AS l FROM d),
df AS (SELECT w, count(*) AS df, ln((SELECT n FROM size) - count(*) + 0.5) - ln(count(*) + 0.5) AS idf FROM tf GROUP BY w),
floor_ AS (SELECT 0.25 * avg(idf) AS f FROM df),
q AS (SELECT item_id AS qid, unnest(list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda x: x <> '')) AS w FROM benchmark), qf AS (SELECT qid, w, count(*) AS qf FROM q GROUP BY ALL),
s AS (SELECT qid, id, round(sum(qf * CASE WHEN idf < 0 THEN (SELECT f FROM floor_) ELSE idf END * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * l / (SELECT mean FROM size)))), 9) AS score FROM qf JOIN tf USING (w) JOIN df USING (w) JOIN lens USING (id) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id DESC) AS rank, max(score) OVER (PARTITION BY qid) AS top FROM s WHERE score > 0)
SELECT qid, id, round(score / top, 6) AS score, rank FROM r WHERE rank <= 10""")
def doc_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents by words for each benchmark item."""
    d = tables.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    q = tables.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), "text")
    return docs.bm25(d, q).select("qid", "id", F.round("score", 6).alias("score"), "rank")


@query("""SELECT qid, url, source, score FROM (
 SELECT l_orderkey AS qid, l_partkey::VARCHAR AS url, string_agg(DISTINCT s, ',' ORDER BY s) AS codes,
   array_to_string(list_transform(list_sort(list(DISTINCT o)), lambda x: ['semantic', 'llm', 'bm25'][x]), ',') AS source, arg_min(l_linenumber, o * 100 + l_linenumber)::DOUBLE AS score
 FROM (SELECT l_orderkey, l_partkey, l_linenumber, l_linenumber % 3 + 1 AS o, (l_linenumber % 3)::VARCHAR AS s FROM lineitem) GROUP BY 1, 2)""")
def doc_merge_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as hits of three strategies, merged by order and part."""
    names = F.array(*map(F.lit, ("semantic", "llm", "bm25")))
    first = tables.table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_partkey", (F.col("l_linenumber") % 3 + 1).alias("o")).agg(F.min("l_linenumber").alias("n"))
    hits = first.select(F.col("l_orderkey").alias("qid"), F.col("l_partkey").cast("string").alias("url"), F.element_at(names, F.col("o").cast("int")).alias("strategy"), F.lit("").alias("title"), F.col("n").cast("double").alias("score"))
    return docs.merge_hits(hits).select("qid", "url", "source", "score")


@query(r"""SELECT page_id, len(regexp_extract_all(html, '(?i)<a\s+[^>]*href=["'']([^"'']+)["''][^>]*>', 1)) AS links, md5(array_to_string(regexp_extract_all(html, '(?i)<a\s+[^>]*href=["'']([^"'']+)["''][^>]*>', 1), ' ')) AS digest FROM pages""")
def doc_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of every page."""
    found = scalars.hrefs(F.col("html"))
    return tables.table(spark, sf_dir, "pages").select("page_id", F.size(found).alias("links"), F.md5(F.array_join(found, " ")).alias("digest"))


@query()
def doc_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Section trees of every page."""
    return docs.section_tree(tables.table(spark, sf_dir, "pages"))


@query("""SELECT doc_id AS id, (contains(text, 'the'))::INT + (contains(text, 'License'))::INT + (contains(text, 'token'))::INT AS hits FROM documents
WHERE (contains(text, 'the'))::INT + (contains(text, 'License'))::INT + (contains(text, 'token'))::INT > 0 ORDER BY hits DESC, id LIMIT 30""")
def doc_term_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 30 documents with most of three terms."""
    return docs.term_overlap(tables.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"), ("the", "License", "token"))


@query("""SELECT n_name AS id, r_name AS path, 'about ' || r_name AS context FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT r_name, '', NULL FROM region""")
def doc_breadcrumbs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations under regions as a document tree."""
    n, r = tables.table(spark, sf_dir, "nation"), tables.table(spark, sf_dir, "region")
    leaves = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("id"), F.col("r_name").alias("parent_id"), F.col("n_name").alias("title"), F.lit("").alias("summary"))
    roots = r.select(F.col("r_name").alias("id"), F.lit(None).cast("string").alias("parent_id"), F.col("r_name").alias("title"), F.concat(F.lit("about "), "r_name").alias("summary"))
    return docs.breadcrumbs(leaves.unionByName(roots)).select("id", "path", "context")


@query("""SELECT coalesce(a.p, b.p) AS path, CASE WHEN a.p IS NULL THEN 'new' WHEN b.p IS NULL THEN 'deleted' ELSE 'changed' END AS change
FROM (SELECT doc_id::VARCHAR AS p, source AS s FROM documents WHERE lang <> 'fr') a
FULL JOIN (SELECT doc_id::VARCHAR AS p, CASE WHEN n_chars > 3000 THEN 'changed' ELSE source END AS s FROM documents WHERE lang <> 'de') b ON a.p = b.p WHERE a.s IS DISTINCT FROM b.s""")
def doc_index_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents new, changed and deleted between two listings."""
    d = tables.table(spark, sf_dir, "documents").withColumn("path", F.col("doc_id").cast("string"))
    old = d.filter("lang <> 'fr'").select("path", F.col("source").alias("sha"))
    new = d.filter("lang <> 'de'").select("path", F.when(F.col("n_chars") > 3000, "changed").otherwise(F.col("source")).alias("sha"))
    return docs.index_changes(old, new)


# telemetry

JOBS = """jobs AS (SELECT user_id AS task_id, event_id AS job_id, CASE WHEN event_type IN ('click', 'view') THEN 'failed' ELSE event_type END AS status,
 coalesce(nullif(trim(CASE WHEN event_type = 'click' THEN props ELSE '' END), ''), CASE WHEN value > 50 THEN 'slow' END, 'other') AS error, event_id % 3 AS error_code, event_id % 4 = 0 AS is_scout FROM events)"""


@query(f"""WITH {JOBS}, f AS (SELECT task_id, job_id, row_number() OVER (PARTITION BY task_id ORDER BY job_id) AS r FROM jobs WHERE status = 'failed'),
ids AS (SELECT task_id, string_agg(job_id::VARCHAR, ',' ORDER BY job_id) AS failed_ids FROM f WHERE r <= 20 GROUP BY 1)
SELECT task_id, status, count(*) AS n, any_value(failed_ids) AS failed_ids FROM jobs LEFT JOIN ids USING (task_id) GROUP BY 1, 2""")
def job_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs of each task by status, and its first failed ones."""
    return telemetry.job_summary(tables.jobs(spark, sf_dir))[0].select("task_id", "status", "n", F.array_join(F.transform("failed_ids", lambda x: x.cast("string")), ",").alias("failed_ids"))


@query(f"""WITH {JOBS}, e AS (SELECT task_id, error, count(*) AS n FROM jobs WHERE status = 'failed' GROUP BY 1, 2)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY n DESC, error) AS rank FROM e) WHERE rank <= 10 AND error <> ''""")
def job_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten most frequent errors of each task."""
    return telemetry.job_summary(tables.jobs(spark, sf_dir))[1]


@query(f"""WITH {JOBS},
r AS (SELECT *, error_code::VARCHAR AS code, row_number() OVER (PARTITION BY task_id, is_scout ORDER BY job_id) AS nth FROM jobs WHERE is_scout OR status = 'failed'),
t AS (SELECT *, CASE WHEN is_scout THEN 0 WHEN max((is_scout AND nth <= 5)::INT) OVER (PARTITION BY task_id, code) = 0 AND row_number() OVER (PARTITION BY task_id, is_scout, code ORDER BY job_id) = 1 THEN 1 ELSE 2 END AS tier FROM r)
SELECT task_id, job_id, tier, place FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY tier, job_id) AS place FROM t) WHERE place <= 5""")
def job_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five jobs of each task: scouts, new errors, others."""
    return telemetry.sample_jobs(tables.jobs(spark, sf_dir)).select("task_id", "job_id", "tier", "place")


@query("""WITH s AS (SELECT user_id AS host, event_id AS seq, event_id % 4 AS idx, floor(value)::INT AS sm, floor(value / 2)::INT AS membw FROM events),
t AS (SELECT *, sum((coalesce(lag_, 1000) >= idx)::INT) OVER (PARTITION BY host ORDER BY seq) AS tick FROM (SELECT *, lag(idx) OVER (PARTITION BY host ORDER BY seq) AS lag_ FROM s))
SELECT host, tick::BIGINT AS tick, min(seq) AS seq, sum(sm)::BIGINT AS sm, sum(membw)::BIGINT AS membw, sum(80)::BIGINT AS total, sum(sm)::BIGINT AS used, sum(80 - sm)::BIGINT AS free FROM t GROUP BY 1, 2""")
def accelerator_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples summed per tick."""
    return telemetry.ticks(tables.samples(spark, sf_dir))


@query("""SELECT user_id AS host, (event_id // 1000) * 1000 AS window_s, min(floor(value)::INT) AS sm_min, round_even(avg(floor(value)::INT), 0)::INT AS sm_mean, max(floor(value)::INT) AS sm_max, max(floor(value / 2)::INT) AS membw_max, 80 AS total, max(floor(value)::INT) AS used, min(80 - floor(value)::INT) AS free, count(*) AS n FROM events GROUP BY 1, 2""")
def accelerator_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tumbling windows over samples."""
    return telemetry.windows(tables.samples(spark, sf_dir), 1000)


@query("""WITH m AS (SELECT user_id AS host, event_id AS seq, event_type AS state, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events),
r AS (SELECT *, sum((before IS DISTINCT FROM state)::INT) OVER (PARTITION BY host ORDER BY seq) AS run FROM m)
SELECT host, run::BIGINT AS run, any_value(state) AS state, min(seq) AS first, max(seq) AS last, count(*) AS n FROM r GROUP BY 1, 2""")
def accelerator_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of an unchanged state of each host."""
    return telemetry.runs(tables.samples(spark, sf_dir), "host", "seq", "state")


@query("""WITH s AS (SELECT user_id AS host, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS place, count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT host, event_id AS seq, place FROM s WHERE (place - 1) % ceil(n / 10)::BIGINT = 0 OR place = n""")
def accelerator_downsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """About ten samples of each host."""
    return telemetry.downsample(tables.samples(spark, sf_dir), "host", "seq", 10).select("host", "seq", "place")


@query("""WITH s AS (SELECT user_id AS host, event_id, CASE event_type WHEN 'click' THEN 'gpu-full' WHEN 'view' THEN 'cpu' ELSE 'gpu-partial' END AS state FROM events),
m AS (SELECT *, lag(state) OVER (PARTITION BY host ORDER BY event_id) AS before FROM s),
p AS (SELECT host, string_agg(state, ' -> ' ORDER BY event_id) AS transitions FROM m WHERE before IS DISTINCT FROM state GROUP BY 1)
SELECT host, count(*) AS n, count(*) FILTER (state = 'gpu-full') AS n_gpu_full, count(*) FILTER (state = 'cpu') AS n_cpu, min(event_id) FILTER (state = 'cpu') AS first_off, floor(count(*) FILTER (state LIKE 'gpu%') * 100 / count(*))::INT AS gpu_percent, any_value(transitions) AS transitions FROM s JOIN p USING (host) GROUP BY 1""")
def accelerator_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of states of each host, and their order."""
    state = F.when(F.col("state") == "click", "gpu-full").when(F.col("state") == "view", "cpu").otherwise("gpu-partial")
    return telemetry.state_report(tables.samples(spark, sf_dir).withColumn("state", state)).select("host", "n", "n_gpu_full", "n_cpu", "first_off", "gpu_percent", "transitions")


@query()
def log_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in twos by their numbers, as logs of a failed and a successful run; one without a partner is left out."""
    d = tables.table(spark, sf_dir, "documents")
    pair = F.floor(F.col("doc_id") / 2).cast("long").alias("pair_id")
    twos = d.groupBy(pair).agg(F.min_by("text", "doc_id").alias("failed"), F.max_by("text", "doc_id").alias("successful"), F.count("*").alias("n"))
    return compare.compare_logs(twos.filter("n = 2"))


# streams


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = tables.table(spark, sf_dir, "events").schema
    return stream.replay(spark, sf_dir, schema, only="events.parquet")


@query("""SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def stream_event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly windows of all events, as a stream."""
    w = stream.to_table(stream.event_windows(_events(spark, sf_dir)), "complete")
    return w.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""SELECT host, seq, before, state FROM (SELECT user_id::VARCHAR AS host, event_id AS seq, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before, event_type AS state FROM events) WHERE before IS DISTINCT FROM state""")
def stream_state_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of each user's event type, with state kept by the stream."""
    s = _events(spark, sf_dir).select(F.col("user_id").cast("string").alias("host"), F.col("event_id").alias("seq"), F.col("event_type").alias("state"))
    return stream.to_table(stream.state_changes(s), "append")
