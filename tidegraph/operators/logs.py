"""Log texts: signal lines, repeats, runs, sections, summaries and candidate funnels, over (log_id, line_no, line) rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegraph.functions.registry import Registry

# fixed values: patterns of lines worth keeping and of what differs between runs of the same program
SIGNAL = (
    r"(?iU)error|exception|traceback|fatal|critical|warning|warn|fail|abort|killed|timeout|segfault|panic|denied|refused|missing|not found"
    r"|brokerage|no candidates|pilot|payload"
)
NOISE = (
    r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:[.,]\d+)?(?:Z|[+-]\d{2}:?\d{2})?"
    r"|\b\d{2}/\d{2}/\d{4}\b"
    r"|\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b"
    r"|0x[0-9a-fA-F]+"
    r"|\b\d{5,}\b"
)
HOSTS = ("cern.ch", "triumf.ca", "bnl.gov", "slac.stanford.edu")
PATHS = (
    r"|(?:root|https?|file|gsiftp)://[^\s'\"]+"
    r"|/(?:cvmfs|pnfs|eos|tmp|var|home|usr|opt)/[^\s'\"]+"
    r"|'[^']*'"
    r'|"[^"]*"'
    r"|\[[^\]]*\]"
    r"|\b[\w.-]+\.(?:data|json|xml|log|root|stdout|stderr|txt|py|so|cfg)\b"
)
MARKER = r"^\s*={3,}\s*(\S.*?\S|\S)\s*={3,}\s*$"
ERROR_LINE = r"(?iU)(?:error|fatal|exception|traceback|critical|killed|segfault|aborted|panic)\b"
LEADING_TIME = r"^\s*(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2})"
FUNNEL_HEADER = r"(?i)={3,}\s*Job brokerage summary\s*={3,}"
FUNNEL_ROW = r"\s*(\d+)\s*->\s*(\d+)\s*candidates,\s*([\d.]+)%\s*cut\s*:\s*(.+)"
MILESTONE = r"(?i)(?:initial\s+(\d+)\s+candidates|(\d+)\s+candidates?(?:\s*\([^)]*\))?\s+(?:passed|have input data|for final check))"
INITIAL = r"(?i)initial\s+(\d+)\s+candidates"
FINAL = r"(?i)final\s+candidates?:\s*(\d+)"
SKIP = r"(?i)skip\s+site=(\S+)\s+(.*?)\s*criteria=([-\w]+)"

FUNNEL_LINE = r"(?i)Job brokerage summary|candidates (?:passed|have input data|for final check)|skip site=\S+.*?criteria=-"
AVAILABLE = r"(?i)replica_availability|is distributed|is available at \d+ sites(?: on (?:DISK|TAPE))?"
USED = r"(?i)use site=\S+.*?criteria=\+use"
NONE_LEFT = r"(?i)\bno candidates\b"
PROBLEMATIC = r"(?i)getting rid of problematic site|unsuitable for the user"
LEAST_MARKERS = 3


def _hosts(names: tuple[str, ...]) -> str:
    return r"|\b[\w.-]+\.(?:" + "|".join(n.replace(".", r"\.") for n in names) + r")\b"


def normalise(line: Column) -> Column:
    """A line without times, dates, identifiers, long numbers and hosts."""
    return F.trim(F.regexp_replace(line, "(?iU)" + NOISE + _hosts(HOSTS), ""))


def normalise_more(line: Column) -> Column:
    """Also without addresses, paths, quoted and bracketed parts and file names: for folding loops."""
    return F.trim(F.regexp_replace(line, "(?iU)" + NOISE + _hosts((*HOSTS, "desy.de")) + PATHS, ""))


def split_lines(logs: DataFrame, text: str = "text", key: str = "log_id") -> DataFrame:
    """Whole logs -> (log_id, line_no from 0, line); a final line end starts no line; null and empty logs have none."""
    ends = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
    body = F.regexp_replace(F.col(text), f"(?:{ends})\\z", "")
    return logs.filter(F.length(text) > 0).select(key, F.posexplode(F.split(body, ends)).alias("line_no", "line"))


def filter_lines(lines: DataFrame, key: str = "log_id", context: int = 3, most: int = 300, head: int = 20, tail: int = 50) -> DataFrame:
    """Signal lines with their context, without repeats, cut in the middle -> (log_id, place, line).

    A log without signals keeps all. Of lines alike after normalising the first stays; blank lines stay where the
    kept line before isn't blank. Over `most` lines, `head` and `tail` stay around a line that counts the others.
    """
    by = Window.partitionBy(key).orderBy("line_no")
    whole = Window.partitionBy(key)
    near = F.max(F.col("line").rlike(SIGNAL).cast("int")).over(by.rowsBetween(-context, context))
    marked = lines.withColumn("near", near).withColumn("any", F.max("near").over(whole)).filter("near = 1 or any = 0")
    norm = marked.withColumn("norm", normalise(F.col("line")))
    once = norm.withColumn("nth", F.row_number().over(Window.partitionBy(key, "norm").orderBy("line_no"))).filter("norm = '' or nth = 1")
    folded = once.withColumn("before", F.lag("norm").over(by)).filter("norm <> '' or before is null or before <> ''")
    placed = folded.withColumn("place", F.row_number().over(by)).withColumn("n", F.count("*").over(whole))
    kept = placed.filter((F.col("n") <= most) | (F.col("place") <= head) | (F.col("place") > F.col("n") - tail))
    cut = placed.filter((F.col("n") > most) & (F.col("place") == 1)).select(key, F.lit(head).cast("double").alias("place") + 0.5, F.format_string("... (%d lines omitted) ...", (F.col("n") - head - tail).cast("int")).alias("line"))
    return kept.select(key, F.col("place").cast("double").alias("place"), "line").union(cut)


def filtered_text(lines: DataFrame, key: str = "log_id", **how: int) -> DataFrame:
    """filter_lines, joined to a text per log."""
    rows = filter_lines(lines, key, **how)
    return rows.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "line"))), lambda x: x["line"]), "\n").alias("text"))


def fold_runs(lines: DataFrame, key: str = "log_id") -> DataFrame:
    """Neighbouring lines that are alike once normalised -> (log_id, run, norm, first, last)."""
    by = Window.partitionBy(key).orderBy("line_no")
    norm = lines.withColumn("norm", normalise_more(F.col("line")))
    starts = norm.withColumn("start", (~F.col("norm").eqNullSafe(F.lag("norm").over(by))).cast("int")).withColumn("run", F.sum("start").over(by))
    return starts.groupBy(key, "run").agg(F.first("norm").alias("norm"), F.min("line_no").alias("first"), F.max("line_no").alias("last"))


def markers(lines: DataFrame, key: str = "log_id") -> DataFrame:
    """Section markers `=== text ===` -> (log_id, line_no, section)."""
    text = F.regexp_extract("line", MARKER, 1)
    return lines.withColumn("section", F.trim(text)).filter("section <> ''").select(key, "line_no", "section")


def capped(line: Column, limit: int) -> Column:
    """A long line cut to the limit, with a count of what is missing."""
    return F.when(F.length(line) > limit, F.concat(F.substring(line, 1, limit), F.lit(" ...["), F.format_number(F.length(line) - limit, 0), F.lit(" chars omitted]"))).otherwise(line)


def summarise(lines: DataFrame, key: str = "log_id", tail: int = 50, errors: int = 20, limit: int = 2000) -> DataFrame:
    """One row per log: sizes, sections in order, the last time at a line's start, the last line with text, the first errors, the tail.

    Only what is shown is gathered: rows are ranked first, so that a long log brings no more than the tail and the
    first errors into a list.
    """
    by = Window.partitionBy(key)
    up, down = by.orderBy("line_no"), by.orderBy(F.desc("line_no"))
    hit = F.col("line").rlike(ERROR_LINE)
    rows = lines.withColumn("from_end", F.row_number().over(down)).withColumn("nth_error", F.when(hit, F.sum(hit.cast("int")).over(up)))
    rows = rows.withColumn("section", F.trim(F.regexp_extract("line", MARKER, 1))).withColumn("time", F.regexp_extract("line", LEADING_TIME, 1))
    texts = lambda when, line: F.transform(F.array_sort(F.collect_list(F.when(when, F.struct("line_no", line.alias("line"))))), lambda x: x["line"])
    short = F.when(F.length("line") > limit, F.concat(F.substring("line", 1, limit), F.lit(" ...[truncated]"))).otherwise(F.col("line"))
    return rows.groupBy(key).agg(
        F.count("*").alias("total_lines"),
        F.sum(F.length("line") + 1).alias("total_chars"),
        F.max_by("section", F.when(F.col("section") != "", F.col("line_no"))).alias("last_section_marker"),
        texts(F.col("section") != "", F.col("section")).alias("sections_seen"),
        F.max_by("time", F.when(F.col("time") != "", F.col("line_no"))).alias("last_timestamp"),
        F.max_by(F.substring(F.trim("line"), 1, limit), F.when(F.trim("line") != "", F.col("line_no"))).alias("last_meaningful_action"),
        texts(F.col("nth_error") <= errors, short).alias("error_lines"),
        F.array_join(texts(F.col("from_end") <= tail, capped(F.col("line"), limit)), "\n").alias("tail_raw"),
    )


def parse_funnel(lines: DataFrame, key: str = "log_id") -> tuple[DataFrame, DataFrame]:
    """Candidate funnels -> (stages, skipped sites).

    stages: stage, name, before, after, cut_pct, criteria_seen, initial, final. A skip line of the body belongs to the first
    stage between whose counts' first mentions it lies (from the start, or to the end of the body, where a count is
    never mentioned). Logs without the header or without rows give nothing.
    """
    line, no = F.col("line"), F.col("line_no")
    text = lambda p, i=1: F.nullif(F.regexp_extract("line", p, i), F.lit(""))
    row = F.when(line.rlike(FUNNEL_ROW), F.struct(*(F.regexp_extract("line", FUNNEL_ROW, i).alias(c) for i, c in enumerate(("before", "after", "cut", "name"), 1))))
    kept = lines.filter(F.col(key).isNotNull() & (F.lower("line").contains("candidate") | line.rlike(FUNNEL_HEADER)))
    told = kept.select(key, "line_no", line.rlike(FUNNEL_HEADER).alias("header"), row.alias("row"), F.coalesce(text(MILESTONE), text(MILESTONE, 2)).alias("count"), text(INITIAL).alias("initial"), text(FINAL).alias("final"))
    told = told.withColumn("head", F.min(F.when(F.col("header"), no)).over(Window.partitionBy(key))).filter("head is not null")
    told = told.withColumn("count", F.when(no < F.col("head"), F.col("count").cast("int"))).withColumn("nth", F.row_number().over(Window.partitionBy(key, "count").orderBy("line_no")))
    r = lambda c: F.col(f"row.{c}")
    stage = F.struct("line_no", F.trim(r("name")).alias("name"), r("before").cast("int").alias("before"), r("after").cast("int").alias("after"), r("cut").cast("double").cast("int").alias("cut_pct"))
    logs = told.groupBy(key).agg(
        F.min("head").alias("head"),
        F.array_sort(F.collect_list(F.when(F.col("row").isNotNull() & (no >= F.col("head")), stage))).alias("rows"),
        F.map_from_entries(F.collect_list(F.when(F.col("count").isNotNull() & (F.col("nth") == 1), F.struct("count", "line_no")))).alias("at"),
        F.min_by("initial", F.when(F.col("initial").isNotNull(), no)).cast("int").alias("initial"),
        F.min_by("final", F.when(F.col("final").isNotNull() & (no >= F.col("head")), no)).cast("int").alias("final"),
    ).filter("size(rows) > 0")
    ranged = lambda x, i: F.struct(i.alias("stage"), *(x[c].alias(c) for c in ("name", "before", "after", "cut_pct")), F.coalesce(F.col("at")[x["before"]], F.lit(0)).alias("from_line"), F.coalesce(F.col("at")[x["after"]], "head").alias("to_line"))
    logs = logs.select(key, "head", F.transform("rows", ranged).alias("stages"), "initial", F.coalesce("final", F.element_at("rows", -1)["after"]).alias("final"))
    part = lambda i: F.regexp_extract("line", SKIP, i)
    skips = lines.filter(line.rlike(SKIP)).select(key, "line_no", part(1).alias("site"), F.trim(part(2)).alias("reason"), part(3).alias("criteria"))
    inside = F.filter("stages", lambda x: no.between(x["from_line"], x["to_line"]))
    # merged: the planner takes the lines that a small table is spread to for as small as that table, and would send one side to the driver
    owned = logs.join(skips.hint("merge"), key, "left").withColumn("filtered_at", F.when(no < F.col("head"), F.get(inside, F.lit(0))["name"]))
    mine = owned.filter("filtered_at is not null")
    seen = F.collect_set(F.when(F.col("filtered_at").isNotNull(), F.struct("filtered_at", "criteria"))).alias("seen")
    whole = owned.groupBy(key).agg(*(F.first(c).alias(c) for c in ("stages", "initial", "final")), seen)
    criteria = F.array_sort(F.transform(F.filter("seen", lambda x: x["filtered_at"] == F.col("s.name")), lambda x: x["criteria"]))
    out = whole.withColumn("s", F.explode("stages")).select(key, *(f"s.{c}" for c in ("stage", "name", "before", "after", "cut_pct")), criteria.alias("criteria_seen"), "initial", "final")
    first = F.row_number().over(Window.partitionBy(key, "site").orderBy("line_no"))
    fates = mine.withColumn("n", first).filter("n = 1").select(key, "site", "filtered_at", "criteria", "reason")
    return out, fates


def render_funnel(lines: DataFrame, key: str = "log_id", top: int = 3, most: int = 20, availability: bool = True, problematic: str = PROBLEMATIC) -> DataFrame:
    """Funnel logs -> (log_id, text) of what matters: availability, stages by how much they cut, sites demoted, the outcome, the summary.

    Skip lines are shown for the `top` stages that cut most, and counted where a stage drops over `most` sites. Logs with
    fewer than three lines of a funnel aren't funnels and give no row.
    """
    real = lines.groupBy(key).agg(F.count_if(F.col("line").rlike(FUNNEL_LINE)).alias("m"), F.min(F.when(F.col("line").rlike(FUNNEL_HEADER), F.col("line_no"))).alias("head")).filter(F.col("m") >= LEAST_MARKERS)
    told = lines.join(real, key).withColumn("body", F.col("head").isNull() | (F.col("line_no") < F.col("head")))
    at = lambda df, part, line, a=F.lit(0), b=None: df.select(key, F.lit(part).alias("part"), a.cast("double").alias("a"), (F.col("line_no") if b is None else b).cast("double").alias("b"), line.alias("line"))
    rows, line = [], F.col("line")
    titled = lambda df, part, title: [at(df.select(key).distinct(), part, F.lit(title), b=F.lit(-1)), at(df, part, line)]
    if availability:
        rows += titled(told.filter("body").filter(line.rlike(AVAILABLE)), 1, "## Data availability")
    field = lambda i: F.regexp_extract("line", FUNNEL_ROW, i)
    stages = told.filter(~F.col("body") & line.rlike(FUNNEL_ROW)).select(key, "head", "line_no", F.trim(field(4)).alias("name"), field(1).cast("int").alias("before"), field(2).cast("int").alias("after"), field(3).cast("double").alias("cut"))
    stages = stages.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("cut"), "line_no")))
    shown = F.max((F.col("place") <= top).cast("int")).over(Window.partitionBy(key, "name")) == 1
    number = F.coalesce(*(F.nullif(F.regexp_extract("line", MILESTONE, i), F.lit("")) for i in (1, 2))).cast("int")
    miles = told.filter("body").withColumn("n", number).filter("n is not null").groupBy(key, "n").agg(F.min("line_no").alias("at"))
    ranged = stages.withColumn("shown", shown).join(miles.select(key, F.col("n").alias("before"), F.col("at").alias("low")), [key, "before"], "left").join(miles.select(key, F.col("n").alias("after"), F.col("at").alias("high")), [key, "after"], "left").withColumn("low", F.coalesce("low", F.lit(0))).withColumn("high", F.coalesce("high", "head"))
    skips = told.filter("body").filter(F.lower("line").contains("skip site=")).select(key, "line_no", "line")
    inside = ranged.filter("shown").select(key, "place", "low", "high", "before", "after").join(skips, key).filter("line_no between low and high")
    counts = inside.groupBy(key, "place").agg(F.count("*").alias("skips"))
    title = F.format_string("\n## Filter stage: %s  (%s%% cut, %d→%d candidates)", "name", F.bround("cut").cast("int").cast("string"), "before", "after")
    note = (
        F.when(~F.col("shown"), "  (skip lines not shown — not among the highest-impact stages)")
        .when(F.col("skips").isNull(), "  (no per-site skip lines — sites filtered implicitly)")
        .when(F.col("before") - F.col("after") > most, F.format_string("  (%d sites skipped — too many to list individually)", F.col("before") - F.col("after")))
    )
    full = ranged.join(counts, [key, "place"], "left").withColumn("note", note)
    rows += [at(full, 2, title, F.col("place"), F.lit(-2)), at(full.filter("note is not null"), 2, F.col("note"), F.col("place"), F.lit(-1)), at(inside.filter(F.col("before") - F.col("after") <= most), 2, line, F.col("place"))]
    rows += titled(told.filter("body").filter(line.rlike(problematic)), 3, "\n## Problematic sites")
    used, none = told.filter("body").filter(line.rlike(USED)), told.filter(line.rlike(NONE_LEFT))
    rows += [at(used.select(key).union(none.select(key)).distinct(), 4, F.lit("\n## Final selection"), b=F.lit(-1)), at(used, 4, line), at(none, 4, line, F.lit(1))]
    rows += [at(told.filter("line_no = head"), 5, F.lit("\n## " + "=" * 40), b=F.lit(-1)), at(told.filter("not body"), 5, line)]
    out = rows[0]
    for more in rows[1:]:
        out = out.unionByName(more)
    return out.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "a", "b", "line"))), lambda x: x["line"]), "\n").alias("text"))


def filter_auto(lines: DataFrame, sources: DataFrame | None = None, key: str = "log_id") -> DataFrame:
    """The filter that fits each log: the one registered for its source (key, source), else the first registered one that gives a text, else the general one."""
    named = None if sources is None else sources.select(key, "source").filter(F.col("source").isin(*FILTERS.names()))
    rest, out = lines, None
    for source in FILTERS.names():
        mine = rest if named is None else rest.join(named.filter(F.col("source") == source).select(key), key, "left_semi")
        if named is None and out is not None:
            mine = mine.join(out.select(key), key, "left_anti")
        told = FILTERS.get(source)(mine, key)
        out = told if out is None else out.unionByName(told)
    if named is not None:  # logs of no known source
        other = lines.join(named.select(key), key, "left_anti")
        out = out.unionByName(FILTERS.get(FILTERS.names()[0])(other, key))
    return filtered_text(lines, key).join(out.select(key), key, "left_anti").unionByName(out)


def log_source(label: Column) -> Column:
    """Which funnel a task's label means."""
    return F.when(label == "managed", "prod").otherwise("analysis")


def keyword_windows(lines: DataFrame, words: tuple[str, ...], key: str = "log_id", span: int = 5, around: int = 10, most: int = 10) -> DataFrame:
    """Files (lines by key) where all words stand within `span` lines -> key, line (from 1), context: `around` lines before and after.

    A hit skips the next `span` lines of its file; over all files the first `most` by key and line are given.
    """
    by = Window.partitionBy(key).orderBy("line_no")
    near = by.rowsBetween(0, span - 1)
    window = F.lower(F.array_join(F.collect_list("line").over(near), " "))
    hit = F.lit(True)
    for w in words:
        hit = hit & F.contains(window, F.lit(w.lower()))
    step = lambda s, x: F.when((F.size(s) == 0) | (x - F.element_at(s, -1) >= span), F.concat(s, F.array(x))).otherwise(s)
    starts = lines.withColumn("hit", hit).filter("hit").groupBy(key).agg(F.array_sort(F.collect_list("line_no")).alias("l"))
    first = starts.select(key, F.explode(F.aggregate("l", F.array().cast("array<int>"), step)).alias("at")).orderBy(key, "at").limit(most)
    shown = lines.join(F.broadcast(first), key).filter(F.col("line_no").between(F.col("at") - around, F.col("at") + span + around - 1))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n")
    return shown.groupBy(key, "at").agg(text.alias("context")).select(key, (F.col("at") + 1).alias("line"), "context").orderBy(key, "line")


#: Filters of logs by the name of their source: functions of (lines, key) to (key, text).
FILTERS = Registry("log filter")
FILTERS.register("analysis", lambda lines, key: render_funnel(lines, key))
FILTERS.register("prod", lambda lines, key: render_funnel(lines, key, availability=False))
