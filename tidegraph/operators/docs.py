"""Documents: sections of HTML, ranked search by words and by vectors, merging, reranking, incremental indexes."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegraph.functions.scalars import uuid5
from tidegraph.functions.workers import ready, stored

# fixed values: the usual constants of Okapi ranking
K1, B, EPSILON = 1.5, 0.75, 0.25
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
HEADINGS = {"h1", "h2", "h3", "h4"}


class _Node:
    def __init__(self, tag: str, attrs: dict[str, str | None], parent: _Node | None) -> None:
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def is_section(self) -> bool:
        return self.tag == "section" or (self.tag == "div" and "section" in (self.attrs.get("class") or "").split())

    def walk(self) -> Iterator[_Node]:
        stack = [self]
        while stack:
            n = stack.pop()
            yield n
            stack += [c for c in reversed(n.children) if isinstance(c, _Node)]

    def text(self, outside: bool = False) -> str:
        """All text below; `outside`: without that of sections inside."""
        parts, stack = [], list(reversed(self.children))
        while stack:
            c = stack.pop()
            if isinstance(c, str):
                parts.append(c)
            elif not (outside and c.is_section()) and c.tag not in ("script", "style"):
                stack += reversed(c.children)
        return " ".join(" ".join(parts).split())


class _Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.root = self.at = _Node("", {}, None)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        node = _Node(tag, dict(attrs), self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_endtag(self, tag: str) -> None:
        n = self.at
        while n.parent is not None and n.tag != tag:
            n = n.parent
        if n.parent is not None:
            self.at = n.parent

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


def html_sections(url: str, html: str | None) -> list[tuple]:
    """(url, level, title, content, parent url, order) of a page's sections; a page without any is one of level 0."""
    tree = _Tree()
    tree.feed(html or "")
    every = list(tree.root.walk())
    main = next((n for n in every if n.attrs.get("role") == "main" or n.tag == "main"), None) or next((n for n in every if n.tag == "article"), None) or next((n for n in every if "document" in (n.attrs.get("class") or "").split()), None) or next((n for n in every if n.tag == "body"), None) or tree.root
    out: list[tuple] = []

    def visit(node: _Node, level: int, parent: str | None) -> None:
        for c in [c for c in node.children if isinstance(c, _Node)]:
            if c.is_section():
                heading = next((x for x in c.children if isinstance(x, _Node) and x.tag in HEADINGS), None)
                here = f"{url}#{c.attrs['id']}" if c.attrs.get("id") else (url if not out else f"{url}#s{len(out)}")
                out.append((here, level, heading.text() if heading else "", c.text(outside=True), parent, len(out)))
                visit(c, level + 1, here)
            else:
                visit(c, level, parent)

    visit(main, 0, None)
    if not out:
        title = next((n.text() for n in every if n.tag in ("h1", "title")), "")
        out.append((url, 0, title, main.text(), None, 0))
    return out


def section_tree(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html) -> page_id, id, url, level, title, content, parent_id, place."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(p, *s) for p, u, h in zip(f["page_id"], f["url"], f["html"], strict=True) for s in html_sections(u or "", h)]
            yield pd.DataFrame(rows, columns=["page_id", "url", "level", "title", "content", "parent", "place"])

    ready(pages.sparkSession)
    made = pages.select("page_id", "url", "html").mapInPandas(run, "page_id long, url string, level int, title string, content string, parent string, place int")
    return made.select("page_id", uuid5(F.col("url")).alias("id"), "url", "level", "title", "content", F.when(F.col("parent").isNotNull(), uuid5(F.col("parent"))).alias("parent_id"), "place")


#: Queries whose words go out with one scan of the documents; documents scored at a time.
QUERIES, DOCS = 4096, 512
BLANK = re.compile(r"[ \t\n\x0b\f\r]+")


def bm25(docs: DataFrame, queries: DataFrame, k: int = 10, min_score: float = 0.0) -> DataFrame:
    """docs (id, text), queries (qid, text) -> qid, id, score (over the query's best), rank: Okapi ranking over words split at white space.

    Frequencies of all words make the floor for words in over half the documents. Documents are scored where they lie,
    against the words of QUERIES queries at a time; a task keeps the best k of each query, and only those are shuffled.
    A word of a query counts as often as it stands there. Ties go to the larger id.
    """
    spark = docs.sparkSession
    ready(spark)
    split = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    sizes = docs.select(F.coalesce(F.size(split), F.lit(0)).alias("n")).agg(F.count("*").alias("docs"), F.sum(F.greatest("n", F.lit(0))).alias("words")).first()
    types = dict(docs.dtypes) | dict(queries.dtypes)
    kind = f"qid {types['qid']}, id {types['id']}, score double"
    n, total = sizes["docs"], sizes["words"] or 0
    df = stored(docs.select(F.explode(F.array_distinct(split)).alias("w")).groupBy("w").agg(F.count("*").alias("df")).withColumn("idf", F.log(n - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))) if total else None
    out = None
    if total:
        floor = EPSILON * (df.agg(F.avg("idf")).first()[0] or 0.0)
        mean = total / n
        asked = queries.select("qid", F.explode(split).alias("w")).groupBy("qid", "w").agg(F.count("*").alias("qf"))
        weight = df.withColumn("idf", F.when(F.col("idf") < 0, floor).otherwise(F.col("idf")))
        asked = stored(asked.join(weight, "w").select("qid", "w", (F.col("qf") * F.col("idf")).alias("v")))
        blocks = max(1, -(-asked.select("qid").distinct().count() // QUERIES))
        for b in range(blocks):
            part = asked.filter(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == b).toPandas()
            if not len(part):
                continue
            word, qid = {w: i for i, w in enumerate(part["w"].unique())}, part["qid"].unique()
            place = {q: i for i, q in enumerate(qid)}
            sent = spark.sparkContext.broadcast((word, qid, part["w"].map(word).to_numpy(), part["qid"].map(place).to_numpy(), part["v"].to_numpy()))

            def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
                word, qid, rows, columns, values = sent.value
                order = np.argsort(rows, kind="stable")
                rows, columns, values = rows[order], columns[order], values[order]
                edge = np.searchsorted(rows, np.arange(len(word) + 1))
                held: list[pd.DataFrame] = []

                def best() -> pd.DataFrame:
                    found = pd.concat(held).sort_values(["q", "score", "id"], ascending=[True, False, False], kind="stable")
                    return found.groupby("q", sort=False).head(k)

                for batch in batches:
                    ids, texts = batch.column("id").to_pylist(), batch.column("text").to_pylist()
                    for at in range(0, len(ids), DOCS):
                        doc, w, tf = [], [], []
                        for i, text in enumerate(texts[at : at + DOCS]):
                            every = [x for x in BLANK.split(text or "") if x]
                            seen = Counter(filter(word.__contains__, every))
                            doc += [i] * len(seen)
                            w += map(word.__getitem__, seen)
                            tf += [c * (K1 + 1) / (c + K1 * (1 - B + B * len(every) / mean)) for c in seen.values()]
                        if not doc:
                            continue
                        doc, w, tf = np.array(doc), np.array(w), np.array(tf)
                        length = edge[w + 1] - edge[w]
                        flat = np.repeat(edge[w], length) + np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
                        here = min(DOCS, len(ids) - at)
                        score = np.bincount(np.repeat(doc, length) * len(qid) + columns[flat], weights=np.repeat(tf, length) * values[flat], minlength=here * len(qid)).reshape(here, -1)
                        score = np.round(score, 9)
                        score[score <= min_score] = -np.inf
                        if here > k:
                            score[score < np.partition(score, -k, axis=0)[-k][None, :]] = -np.inf
                        i, j = np.nonzero(score > -np.inf)
                        held.append(pd.DataFrame({"q": j, "id": [ids[at + x] for x in i.tolist()], "score": score[i, j]}))
                    if len(held) > 64:
                        held = [best()]
                if held:
                    found = best()
                    yield pa.RecordBatch.from_pandas(pd.DataFrame({"qid": qid[found["q"].to_numpy()], "id": found["id"].to_numpy(), "score": found["score"].to_numpy()}), preserve_index=False)

            found = docs.select("id", "text").mapInArrow(run, kind)
            out = found if out is None else out.unionByName(found)
    if out is None:
        out = spark.createDataFrame([], kind)
    w = Window.partitionBy("qid").orderBy(F.desc("score"), F.desc("id"))
    top = out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return top.withColumn("score", F.col("score") / F.max("score").over(Window.partitionBy("qid"))).select("qid", "id", "score", "rank")


def merge_hits(hits: DataFrame, order: tuple[str, ...] = ("semantic", "llm", "bm25")) -> DataFrame:
    """hits (qid, url, strategy, title, score) -> one row per query and URL: the first strategy's, and all strategies in order."""
    rank = F.array_position(F.array(*map(F.lit, order)), F.col("strategy"))
    return hits.withColumn("o", rank).groupBy("qid", "url").agg(F.min_by(F.struct("title", "score"), "o").alias("r"), F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("o", "strategy"))), lambda x: x["strategy"]), ",").alias("source")).select("qid", "url", "r.*", "source")


def rerank(hits: DataFrame, score: Column, k: int = 5, concept: Column | None = None) -> DataFrame:
    """Hits by a new score, those above zero if any are, the first max(1, k - 2) and up to 2 concept documents from the whole ranking."""
    by = Window.partitionBy("qid").orderBy(F.desc("rerank"), "url")
    ranked = hits.withColumn("rerank", score).withColumn("place", F.row_number().over(by))
    any_good = F.max((F.col("rerank") > 0).cast("int")).over(Window.partitionBy("qid"))
    first = ranked.withColumn("good", any_good).filter((F.col("place") <= max(1, k - 2)) & ((F.col("rerank") > 0) | (F.col("good") == 0))).drop("good")
    if concept is None:
        return first
    rest = ranked.filter(concept).join(first.select("qid", "url"), ["qid", "url"], "left_anti")
    more = rest.withColumn("n", F.row_number().over(by)).filter("n <= 2").drop("n").select(*first.columns)
    return first.unionByName(more)


def breadcrumbs(nodes: DataFrame, doublings: int = 16) -> DataFrame:
    """nodes (id, parent_id, title, summary) -> id, path (titles from the root to the parent), context (nearest ancestor's summary that isn't empty), root (its title).

    Each round looks up what the node reached last round has reached, so that rounds grow with the logarithm of the
    depth. Parents that aren't there end a path; parents in a ring are refused.
    """
    title = F.coalesce("title", F.lit(""))
    at = nodes.join(nodes.select(F.col("id").alias("p"), F.col("parent_id").alias("pp"), title.alias("pt"), F.nullif("summary", F.lit("")).alias("ps")), F.col("parent_id") == F.col("p"), "left")
    at = stored(at.select("id", F.when(F.col("p").isNotNull(), F.col("pp")).alias("next"), F.col("p").alias("up"), F.when(F.col("p").isNotNull(), F.array("pt")).otherwise(F.array().cast("array<string>")).alias("path"), F.col("ps").alias("context"), title.alias("title")))
    for _ in range(doublings):
        if not at.filter("next is not null").limit(1).count():
            break
        beyond = at.select(F.col("id").alias("b"), F.col("up").alias("bu"), F.col("next").alias("bn"), F.col("path").alias("bp"), F.col("context").alias("bc"))
        joined = at.join(beyond, F.col("next").isNotNull() & (F.col("up") == F.col("b")), "left")
        at = stored(joined.select("id", "bn", F.coalesce("bu", "up").alias("up"), F.concat(F.coalesce("bp", F.array().cast("array<string>")), "path").alias("path"), F.coalesce("context", "bc").alias("context"), "title").withColumnRenamed("bn", "next"))
    else:
        raise ValueError("parents that lead back to themselves")
    return at.select("id", F.array_join("path", " > ").alias("path"), "context", F.when(F.size("path") > 0, F.element_at("path", 1)).otherwise(F.col("title")).alias("root"))


def index_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, sha) before and now -> path, change: new, changed or deleted."""
    return old.select("path", F.col("sha").alias("a")).join(new.select("path", F.col("sha").alias("b")), "path", "full").filter(~F.col("a").eqNullSafe(F.col("b"))).select("path", F.when(F.col("a").isNull(), "new").when(F.col("b").isNull(), "deleted").otherwise("changed").alias("change"))


def replace_pages(points: DataFrame, new: DataFrame, urls: DataFrame) -> DataFrame:
    """points without those whose URL starts with one of urls (url), and new ones: old points go first.

    A URL's starts of the lengths that urls have are joined by equality, so neither list is broadcast or met pair by pair.
    """
    u = urls.select(F.col("url").alias("u")).filter("u <> ''").distinct()
    lengths = [r["n"] for r in u.select(F.length("u").alias("n")).distinct().orderBy("n").collect()]
    if not lengths:
        return points.unionByName(new)
    starts = F.explode(F.filter(F.array(*[F.when(F.length("url") >= n, F.substring("url", 1, n)) for n in lengths]), lambda x: x.isNotNull()))
    gone = points.select("url", starts.alias("u")).join(u, "u", "left_semi").select("url").distinct()
    return points.join(gone, "url", "left_anti").unionByName(new)


def term_overlap(texts: DataFrame, terms: tuple[str, ...], most: int = 30) -> DataFrame:
    """texts (id, text) -> id, hits: how many terms each contains, at least one, best first."""
    n = sum((F.contains("text", F.lit(t)).cast("int") for t in terms), F.lit(0))
    return texts.select("id", n.alias("hits")).filter("hits > 0").orderBy(F.desc("hits"), "id").limit(most)


# fixed values: root titles of pages about concepts
CONCEPT_TITLES = ("architecture", "basic concepts", "concept", "introduction", "overview", "system design", "terminology")


def summarise_pages(nodes: DataFrame, cache: DataFrame | None = None, answer: Callable[[Column], Column] | None = None) -> DataFrame:
    """nodes (id, title, content, root) -> with content_hash, summary, doc_type, cached.

    Empty content: the title, a concept if the root's title says so. The same content under the same id in cache (id,
    content_hash, summary, doc_type): what is there. Else `answer` gives struct(summary, doc_type) from the first 3,000 characters;
    without a summary the content's first 300 characters stand, and any other type than concept is other.
    """
    blank = F.trim(F.coalesce("content", F.lit(""))) == ""
    out = nodes.withColumn("content_hash", F.sha2(F.coalesce("content", F.lit("")), 256))
    if cache is None:
        out = out.withColumns({"__summary": F.lit(None).cast("string"), "__type": F.lit(None).cast("string")})
    else:
        known = cache.filter("summary <> ''").select("id", F.col("content_hash").alias("__hash"), F.col("summary").alias("__summary"), F.col("doc_type").alias("__type"))
        out = out.join(known, "id", "left").withColumn("__summary", F.when(F.col("content_hash") == F.col("__hash"), F.col("__summary"))).drop("__hash")
    made = answer(F.substring("content", 1, 3000)) if answer else F.struct(F.lit("").alias("summary"), F.lit("other").alias("doc_type"))
    concept = F.lower(F.coalesce("root", F.lit(""))).rlike("|".join(CONCEPT_TITLES))
    typed = lambda t: F.when(t == "concept", "concept").otherwise("other")
    hit = ~blank & F.col("__summary").isNotNull()
    out = out.withColumn("__made", made)
    summary = F.when(blank, F.col("title")).when(hit, F.col("__summary")).otherwise(F.coalesce(F.nullif("__made.summary", F.lit("")), F.substring("content", 1, 300)))
    kind = F.when(blank, F.when(concept, "concept").otherwise("other")).when(hit, typed(F.col("__type"))).otherwise(typed(F.col("__made.doc_type")))
    return out.withColumns({"summary": summary, "doc_type": kind, "cached": hit}).drop("__made", "__summary", "__type")


def stale(known: Column, current: Column, frozen: bool = False) -> Column:
    """Whether an index must be built again: never if frozen; where the source can't be asked (null) only if there is none; else if the hashes differ."""
    return F.lit(False) if frozen else F.when(current.isNull(), known.isNull()).otherwise(~known.eqNullSafe(current))


def listed_pages(tree: DataFrame, top: str = "docs/source/", excluded: tuple[str, ...] = ()) -> DataFrame:
    """tree (path, type, sha) of a repository -> path, sha of its documentation pages."""
    return tree.filter((F.col("type") == "blob") & F.col("path").startswith(top) & F.col("path").endswith(".rst") & ~F.col("path").isin(*excluded)).select("path", "sha")


def fetched_pages(pages: DataFrame) -> DataFrame:
    """pages (path, html) that came with any text; failures are null or empty."""
    return pages.filter(F.coalesce(F.length("html"), F.lit(0)) > 0)


def embedded(nodes: DataFrame, embed: Callable[[Column], Column]) -> DataFrame:
    """nodes -> points of the index: id from the URL, and the vector of title and summary."""
    text = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("summary", F.lit("")))
    return nodes.select(uuid5(F.col("url")).alias("id"), F.col("id").alias("node_id"), *(c for c in nodes.columns if c != "id"), text.alias("text")).withColumn("embedding", embed(F.col("text")))


def known_hits(hits: DataFrame, nodes: DataFrame) -> DataFrame:
    """hits (qid, node_id, score) on nodes that the tree still has."""
    return hits.join(nodes.select(F.col("id").alias("node_id"), "url", "title"), "node_id")


def traverse(nodes: DataFrame, choose: Callable[[DataFrame], DataFrame], levels: int = 2) -> DataFrame:
    """nodes (id, parent_id, ...) -> those that a descent ends at: `choose` picks pages, then sections below them, at most `levels` deep.

    A node without children, or at the last level, is a result; others are drilled into.
    """
    parents = nodes.filter("parent_id is not null").select(F.col("parent_id").alias("id")).distinct()
    at, out = choose(nodes.filter("parent_id is null")), None
    for level in range(levels + 1):
        ends = at if level == levels else at.join(parents, "id", "left_anti")
        out = ends if out is None else out.unionByName(ends)
        if level < levels:
            at = choose(nodes.join(at.join(parents, "id", "left_semi").select(F.col("id").alias("parent_id")), "parent_id").select(*nodes.columns))
    return out


def system_pages(nodes: DataFrame) -> DataFrame:
    """nodes (id, level, doc_type, title, summary, content, place) -> one row: how many top and concept pages with text there are, and their texts, in order."""
    text = F.coalesce(F.nullif("summary", F.lit("")), F.nullif(F.substring("content", 1, 300), F.lit("")))
    rows = nodes.filter((F.col("level") == 0) | (F.col("doc_type") == "concept")).withColumn("text", text).filter("text is not null")
    once = rows.groupBy("id").agg(F.min(F.struct("place", "title", "text")).alias("r")).select("r.*")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "title", "text"))), lambda x: F.concat(F.lit("["), F.coalesce(x["title"], F.lit("")), F.lit("]\n"), x["text"])), "\n\n")
    return once.agg(F.count("*").alias("pages"), joined.alias("text"))


def index_meta(files: DataFrame, sha: str, built_at: str, summary: str = "") -> DataFrame:
    """files (path, sha) -> the index's one row of metadata: sha, built_at, system_summary, file_shas (null if empty)."""
    shas = F.map_from_entries(F.array_sort(F.collect_list(F.struct("path", "sha"))))
    row = files.filter("sha is not null").agg(F.when(F.count("*") > 0, shas).alias("file_shas"))
    return row.select(F.lit(sha).alias("sha"), F.lit(built_at).alias("built_at"), F.lit(summary or None).cast("string").alias("system_summary"), "file_shas")


def index_counts(nodes: DataFrame) -> DataFrame:
    """How many nodes there are, of concepts and others."""
    concept = F.count_if(F.col("doc_type") == "concept")
    return nodes.agg(F.count("*").alias("nodes"), concept.alias("concept"), (F.count("*") - concept).alias("other"))


def index_listing(nodes: DataFrame, title: str | None = None, concept_only: bool = False) -> DataFrame:
    """nodes by URL and level: doc_type, level, label (parent's title before it), the summary's first 100 characters; some by type or part of the title."""
    parents = nodes.select(F.col("id").alias("__id"), F.nullif("title", F.lit("")).alias("__parent")).dropDuplicates(["__id"])
    out = nodes.join(parents, F.col("parent_id") == F.col("__id"), "left")
    if concept_only:
        out = out.filter("doc_type = 'concept'")
    if title:
        out = out.filter(F.contains(F.lower("title"), F.lit(title.lower())))
    label = F.concat_ws(" › ", "__parent", F.coalesce("title", F.lit("")))
    return out.select("url", "level", F.when(F.col("doc_type") == "concept", "concept").otherwise("other").alias("doc_type"), label.alias("label"), F.substring(F.coalesce("summary", F.lit("")), 1, 100).alias("summary")).orderBy("url", "level")


def rendered_hits(hits: DataFrame) -> DataFrame:
    """hits (qid, place, title, content) -> qid, text: `[title] content` of each, 500 characters long; those without content or about an API are left out."""
    some = hits.filter((F.coalesce("content", F.lit("")) != "") & ~F.coalesce("title", F.lit("")).rlike(r"(?i)\bAPI\b"))
    line = F.trim(F.concat(F.lit("["), F.coalesce("title", F.lit("")), F.lit("] "), F.substring("content", 1, 500)))
    return some.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", line.alias("line")))), lambda x: x["line"]), "\n\n").alias("text"))


def source_counts(hits: DataFrame) -> DataFrame:
    """hits (qid, source: comma-separated strategies) -> qid, strategy, n; `unknown` without any."""
    return hits.select("qid", F.explode(F.split(F.coalesce("source", F.lit("unknown")), ",")).alias("s")).groupBy("qid", F.trim("s").alias("strategy")).agg(F.count("*").alias("n"))
