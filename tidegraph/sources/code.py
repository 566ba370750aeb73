"""Source files to functions by their syntax trees, and searches of their bodies."""

from __future__ import annotations

import ast
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.functions.workers import ready, stored

METHODS = "module string, class string, name string, first_line int, last_line int, body string"


def methods_of(module: str, text: str) -> list[tuple]:
    """(module, class, name, first line, last line, body) of every function, methods with their class; broken files give none."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError):
        return []
    rows, lines = [], text.splitlines()
    stack: list[tuple[ast.AST, str | None]] = [(tree, None)]
    while stack:
        node, owner = stack.pop()
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef)):
                rows.append((module, owner, child.name, child.lineno, child.end_lineno, "\n".join(lines[child.lineno - 1 : child.end_lineno])))
            stack.append((child, child.name if isinstance(child, ast.ClassDef) else owner))
    return sorted(rows, key=lambda r: r[3])


def read_code(spark: SparkSession, path: str) -> DataFrame:
    """All Python files below a folder -> module (path), text."""
    return spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.py").text(path, wholetext=True).select(F.input_file_name().alias("module"), F.col("value").alias("text"))


def methods(code: DataFrame) -> DataFrame:
    """code (module, text) -> METHODS."""
    ready(code.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [r for m, t in zip(f["module"], f["text"], strict=True) for r in methods_of(m, t or "")]
            yield pd.DataFrame(rows, columns=["module", "class", "name", "first_line", "last_line", "body"])

    return code.mapInPandas(run, METHODS)


def find_method(found: DataFrame, module: str, qualified: str) -> DataFrame:
    """The first function of a module called like the last part of a name."""
    return found.filter((F.col("module").endswith(module)) & (F.col("name") == qualified.rpartition(".")[2])).orderBy("first_line").limit(1)


def longest_run(body: str, words: list[str], least: int = 2) -> tuple[int, int]:
    """(words, first) of the longest run of neighbouring words that a text contains, the first of equals; (0, 0) for none of `least` words.

    A run can only be there if it is without its first word, so that two ends move over the words once.
    """
    if len(words) == 1:
        return (1, 0) if words[0] in body else (0, 0)
    best, end = (0, 0), 0
    for first in range(len(words)):
        end = max(end, first)
        while end < len(words) and " ".join(words[first : end + 1]) in body:
            end += 1
        if end - first >= least and end - first > best[0]:
            best = (end - first, first)
    return best


def phrase_terms(found: DataFrame, fragments: Sequence[str], least: int = 2) -> list[str | None]:
    """For each fragment its longest run of words that any function contains, the first of equals; null for none.

    One pass over the functions; what reaches the driver is one run per fragment.
    """
    words = [f.split() for f in fragments]
    ready(found.sparkSession)

    def run(bodies: pd.Series) -> pd.Series:
        return bodies.map(lambda b: [{"f": i, "k": k, "at": -at} for i, w in enumerate(words) for k, at in [longest_run(b or "", w, least)] if k])

    best = found.select(F.explode(F.pandas_udf(run, "array<struct<f:int,k:int,at:int>>")("body")).alias("r")).groupBy("r.f").agg(F.max(F.struct("r.k", "r.at")).alias("b")).collect() if words else []
    told = {r["f"]: (r["b"]["k"], -r["b"]["at"]) for r in best}
    return [" ".join(w[told[i][1] : told[i][1] + told[i][0]]) if i in told else None for i, w in enumerate(words)]


def matching(found: DataFrame, terms: Sequence[str], most: int = 30) -> DataFrame:
    """Functions by how many of the terms their body contains, at least one, best first."""
    n = sum((F.contains("body", F.lit(t)).cast("int") for t in dict.fromkeys(terms)), F.lit(0))
    return found.withColumn("hits", n).filter("hits > 0").orderBy(F.desc("hits"), "module", "first_line").limit(most)


def longest_phrase(found: DataFrame, error: str) -> DataFrame:
    """Functions that contain the longest run of an error's words that any of them contains: module, class, name, first_line, words."""
    term = phrase_terms(found, [error])[0]
    rows = found.filter(F.contains("body", F.lit(term))) if term else found.limit(0)
    return rows.select("module", "class", "name", "first_line", F.lit(len(term.split()) if term else 0).alias("words"))


def overlap(found: DataFrame, fragments: Sequence[str], common: int = 10, most: int = 30) -> DataFrame:
    """Functions by how many fragments they hold, each by its longest run of words that any function contains: module, class, name, first_line, score.

    Fragments found in over `common` functions are left out; of the others those with two or more stay if there are any.
    """
    terms = [t for t in phrase_terms(found, list(dict.fromkeys(fragments))) if t]
    if not terms:
        return found.select("module", "class", "name", "first_line", F.lit(0).alias("score")).limit(0)
    held = stored(found.select("module", "class", "name", "first_line", F.array_compact(F.array(*[F.when(F.contains("body", F.lit(t)), F.lit(i)) for i, t in enumerate(terms)])).alias("held")).filter("size(held) > 0"))
    rare = [r["f"] for r in held.select(F.explode("held").alias("f")).groupBy("f").count().filter(F.col("count") <= common).collect()]
    scored = held.withColumn("score", F.size(F.array_intersect("held", F.array(*map(F.lit, rare)).cast("array<int>")))).filter("score > 0").drop("held")
    top = scored.agg(F.max("score")).first()[0] or 0
    return scored.filter((F.col("score") >= 2) | F.lit(top < 2)).orderBy(F.desc("score"), "module", "first_line").limit(most)


def expand(found: DataFrame, first: Sequence[str], follow: Callable[[DataFrame], Sequence[str]], rounds: int = 3) -> DataFrame:
    """Functions that hold any of the first terms, and in each round those that `follow` names symbols for, from all that were read: with the round.

    At most `rounds` rounds; a function is read once, and no further symbols or no new function end it.
    """
    terms, out = list(first), None
    for n in range(rounds):
        new = matching(found, terms).drop("hits") if terms else found.limit(0)
        if out is not None:
            names = ("module", "class", "name", "first_line")
            read = out.select(*(F.col(c).alias(f"read_{c}") for c in names))
            new = new.join(read, reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(f"read_{c}")) for c in names)), "left_anti")
        new = stored(new.withColumn("round", F.lit(n)))
        if not new.limit(1).count():
            break
        out = new if out is None else stored(out.unionByName(new))
        terms = list(follow(out)) if n + 1 < rounds else []
        if not terms:
            break
    return found.limit(0).withColumn("round", F.lit(0)) if out is None else out
