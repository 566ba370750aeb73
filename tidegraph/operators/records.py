"""Tools, procedures, reviews and sessions: filters, parsing of answers, digests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegraph.functions.scalars import procedure_name, tool_references
from tidegraph.operators.classify import tolerant_json, unfenced

# fixed values: how task parameters stand in the lists of a documentation page
PARAMETER = r"(?m)^[ \t]*\* - (\S+)[ \t]*\n(?:(?![ \t]*- )[ \t]*\S[^\n]*\n)*[ \t]*- [^\n]*\n(?:(?![ \t]*- )[ \t]*\S[^\n]*\n)*[ \t]*- ([^\n]*(?:\n(?![ \t]*\* - |[ \t]*- )[ \t]*\S[^\n]*)*)"
SETTING = r"(?m)^[ \t]*\* - ([A-Z][^\n]*?)[ \t]*\n(?:(?![ \t]*- )[ \t]*\S[^\n]*\n)*[ \t]*- ([^\n]*(?:\n(?![ \t]*\* - |[ \t]*- )[ \t]*\S[^\n]*)*)"


def list_table(pages: DataFrame, pattern: str = PARAMETER, key: str = "path") -> DataFrame:
    """pages (path, text) of list tables -> path, name, description; of repeated names the last."""
    flat = lambda c: F.trim(F.regexp_replace(c, r"\s*\n\s*", " "))
    both = F.arrays_zip(F.regexp_extract_all("text", F.lit(pattern), 1).alias("n"), F.regexp_extract_all("text", F.lit(pattern), 2).alias("d"))
    rows = pages.select(key, F.posexplode(both).alias("place", "e")).select(key, "place", F.trim("e.n").alias("name"), flat(F.col("e.d")).alias("description"))
    return rows.filter("description <> ''").groupBy(key, "name").agg(F.max_by("description", "place").alias("description"))


def settings_table(pages: DataFrame, key: str = "path") -> DataFrame:
    """List tables of settings; a name with a variable end also stands without it, unless that is a name of its own."""
    rows = list_table(pages, SETTING, key)
    base = F.regexp_replace(F.regexp_replace("name", r"\[_<[^>]+>\]$", ""), r"_<[^>]+>$", "")
    more = rows.withColumn("b", base).filter("b <> name and b <> ''").groupBy(key, F.col("b").alias("name")).agg(F.min("description").alias("description"))
    return rows.unionByName(more.join(rows.select(key, "name"), [key, "name"], "left_anti"))


def lookup(tokens: DataFrame, table: DataFrame) -> DataFrame:
    """tokens (task_id, text) -> task_id, name, description of the upper-case names in the text that the table has."""
    names = F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\b([A-Z][A-Z0-9_]{2,})\b"), 1)))
    return tokens.select("task_id", names.alias("name")).join(table.select("name", "description"), "name")


def toolkit(procedures: DataFrame, changing: Sequence[str], allow: bool = False) -> DataFrame:
    """procedures (seq, code, summary) that can be offered as tools: with code, two tools or more, none that changes things unless allowed, the first of each name."""
    refs = F.coalesce(tool_references(F.col("code")), F.array().cast("array<string>"))
    out = procedures.filter(F.trim(F.coalesce("code", F.lit(""))) != "").withColumn("tools", refs).filter("size(tools) >= 2")
    if not allow:
        out = out.filter(~F.arrays_overlap("tools", F.array(*map(F.lit, changing))))
    named = out.withColumn("name", procedure_name(F.col("tools")))
    w = Window.partitionBy("name").orderBy("seq")
    return named.withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n").withColumn("description", F.concat(F.coalesce("summary", F.lit("")), F.lit(" Uses: "), F.array_join("tools", ", ")))


def has_side_effects(code: Column, changing: Sequence[str]) -> Column:
    """Whether code uses a tool that changes things; code that can't be parsed counts as such, code without any tool doesn't."""
    return F.coalesce(F.arrays_overlap(tool_references(code), F.array(*map(F.lit, changing)).cast("array<string>")), F.lit(True))


def explorer_tools(tools: DataFrame, interactive: bool) -> DataFrame:
    """Read-only tools, without those that ask a person unless there is one."""
    return tools.filter(F.col("read_only") & (F.lit(interactive) | ~F.col("requires_interaction")))


def tool_text(name: Column, description: Column, arguments: Column) -> Column:
    """name: description (args: a, b)."""
    return F.concat(name, F.lit(": "), description, F.when(F.size(arguments) > 0, F.concat(F.lit(" (args: "), F.array_join(arguments, ", "), F.lit(")"))).otherwise(""))


def gaps(answers: Column) -> Column:
    """Gaps with text that can be resolved, from a JSON list; resolvable unless said otherwise."""
    parsed = tolerant_json(answers, "array<struct<gap:string,resolvable:boolean>>")
    return F.filter(F.coalesce(parsed, F.array().cast("array<struct<gap:string,resolvable:boolean>>")), lambda g: F.coalesce(g["resolvable"], F.lit(True)) & (F.trim(F.coalesce(g["gap"], F.lit(""))) != ""))


def review(answer: Column) -> Column:
    """A review's JSON (approved unless it says otherwise, confidence 1 by default); one that can't be read approves with confidence 0."""
    parsed = tolerant_json(answer, "approved boolean, feedback string, confidence double, issues array<string>, failure_dimension array<string>")
    good = F.try_parse_json(unfenced(answer)).isNotNull() & parsed.isNotNull()
    none = F.array().cast("array<string>")
    return F.struct(
        F.coalesce(parsed["approved"], F.lit(True)).alias("approved"), F.coalesce(parsed["feedback"], F.lit("")).alias("feedback"), F.when(good, F.coalesce(parsed["confidence"], F.lit(1.0))).otherwise(0.0).alias("confidence"),
        F.coalesce(parsed["issues"], none).alias("issues"), F.coalesce(parsed["failure_dimension"], none).alias("failure_dimension"),
    )


def verdict(text: Column) -> Column:
    """verdict and reason of an answer's lines; unclear without."""
    found = lambda k: F.regexp_extract(text, rf"(?im)^\s*{k}\s*:\s*(.+?)\s*$", 1)
    return F.struct(F.coalesce(F.nullif(F.lower(found("verdict")), F.lit("")), F.lit("unclear")).alias("verdict"), found("reason").alias("reason"))


def decoded(results: Column) -> Column:
    """An array of a tool's texts as JSON text: null for none, the text for one, a list for more."""
    one = F.element_at(results, 1)
    return F.when(F.size(results) == 0, F.lit(None).cast("string")).when(F.size(results) == 1, F.coalesce(F.to_json(F.try_parse_json(one)), one)).when(F.size(results) > 1, F.to_json(results))


def digest(nodes: DataFrame, names: int = 5) -> DataFrame:
    """nodes (graph_id, node_type, name) -> per graph and type how many there are, and the first names; no more than those are gathered."""
    by = Window.partitionBy("graph_id", "node_type").orderBy("name")
    first = nodes.select("graph_id", "node_type", "name").distinct().withColumn("r", F.row_number().over(by)).filter(F.col("r") <= names)
    listed = first.groupBy("graph_id", "node_type").agg(F.array_sort(F.collect_list("name")).alias("names"))
    return nodes.groupBy("graph_id", "node_type").agg(F.count("*").alias("n")).join(listed, ["graph_id", "node_type"])


def last_turns(turns: DataFrame, n: int = 5, cut: int = 200) -> DataFrame:
    """The last turns of each session, shortened."""
    w = Window.partitionBy("session").orderBy(F.desc("turn"))
    return turns.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= n).drop("r").withColumn("text", F.substring("text", 1, cut))


def used_of_shown(runs: DataFrame) -> DataFrame:
    """runs (run, used, shown: arrays) -> run, recall: the share of what was used that had been shown."""
    used = F.array_distinct("used")
    return runs.select("run", F.when(F.size(used) > 0, F.size(F.array_intersect(used, "shown")) / F.size(used)).alias("recall"))


def revoke(policies: DataFrame, hash_prefix: str | None = None, name_prefix: str | None = None) -> DataFrame:
    """policies (hash, name) without those that start so; without a prefix none is left."""
    if hash_prefix is None and name_prefix is None:
        return policies.limit(0)
    hit = F.lit(False)
    for column, start in (("hash", hash_prefix), ("name", name_prefix)):
        if start:
            hit = hit | F.col(column).startswith(start)
    return policies.filter(~hit)


def task_query(status: Column, error: Column, answer: Column | None = None) -> Column:
    """struct(nl_query, keyword_query) to search for: the status, and a model's question and keywords (JSON nl_query, keywords; or a list of
    keywords), or without them the error without markup and #tokens, at most 120 characters. Null where there is nothing to ask."""
    state = F.when(F.coalesce(status, F.lit("")) != "", F.concat(F.lit("task status "), status))
    bare = F.regexp_replace(F.regexp_replace(F.nullif(F.coalesce(error, F.lit("")), F.lit("")), r"<[^>]+>", " "), "#[^ ]+", " ")
    plain = F.trim(F.regexp_replace(F.concat_ws(". ", F.when(bare.isNotNull(), state), F.nullif(bare, F.lit(""))), r"\s+", " "))
    if answer is None:
        asked, words = F.lit(None).cast("string"), F.lit(None).cast("string")
    else:
        told, listed = tolerant_json(answer, "nl_query string, keywords array<string>"), tolerant_json(answer, "array<string>")
        keywords = F.filter(F.coalesce(told["keywords"], listed), lambda x: F.coalesce(x, F.lit("")) != "")
        asked, words = F.nullif(told["nl_query"], F.lit("")), F.nullif(F.array_join(keywords, " "), F.lit(""))
    fallback = F.when(words.isNull(), F.nullif(F.substring(plain, 1, 120), F.lit("")))
    question = F.coalesce(asked, fallback)
    return F.when(state.isNotNull() | question.isNotNull(), F.struct(F.concat_ws(". ", state, question).alias("nl_query"), F.concat_ws(" ", state, words).alias("keyword_query")))


def merge_hints(first: Column, second: Column) -> Column:
    """One map of two; the second's values win."""
    return F.map_from_entries(F.concat(F.filter(F.map_entries(first), lambda e: ~F.map_contains_key(second, e["key"])), F.map_entries(second)))


def email_body(background: Column, cause: Column, resolution: Column, steps: Column) -> Column:
    """Sections in fixed order, steps numbered; empty ones are left out."""
    part = lambda title, text: F.when(F.coalesce(text, F.lit("")) != "", F.concat(F.lit(f"{title}:\n"), text))
    numbered = F.array_join(F.transform(steps, lambda s, i: F.concat(F.lit("  "), (i + 1).cast("string"), F.lit(". "), s)), "\n")
    return F.concat_ws("\n\n", part("Background", background), part("Cause", cause), part("Resolution", resolution), part("Investigation procedure", numbered))


def same_email(a: Column, b: Column) -> Column:
    """Whether two bodies (structs of background, cause, resolution, procedure) say the same; what is missing is empty."""
    same = F.lit(True)
    for k in ("background", "cause", "resolution"):
        same = same & (F.coalesce(a[k], F.lit("")) == F.coalesce(b[k], F.lit("")))
    none = F.array().cast("array<string>")
    return same & F.coalesce(a["procedure"], none).eqNullSafe(F.coalesce(b["procedure"], none))


def split_rule_hints(tasks: DataFrame, table: DataFrame) -> DataFrame:
    """tasks (task_id, splitRule), table (name, description) -> task_id, place, name, description of the rules whose key the table has, each once."""
    rules = tasks.select("task_id", F.posexplode(F.split("splitRule", ",")).alias("place", "rule")).filter(F.instr("rule", "=") > 0)
    keyed = rules.select("task_id", "place", F.trim(F.substring_index("rule", "=", 1)).alias("name")).filter("name <> ''")
    return keyed.groupBy("task_id", "name").agg(F.min("place").alias("place")).join(table.select("name", "description"), "name").select("task_id", "place", "name", "description")


def page_url(path: Column, prefix: str, base: str) -> Column:
    """The page that a source file makes."""
    return F.concat(F.lit(base), F.regexp_replace(F.regexp_replace(path, "^" + prefix, ""), r"\.rst$", ".html"))
