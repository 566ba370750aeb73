"""Language identification by bit-sliced Bloom filters of character n-grams.

Training counts the n-grams of a bounded sample of labelled documents by language. A language holds the n-grams that
are not much rarer in it than in any other. One Bloom filter stands for all languages: a slot is a mask with a bit
per language, and the AND over an n-gram's slots is the set of languages that hold it. A text's set bits are counted
per language, corrected by the share of bits that are set by chance, and the largest corrected count decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph.functions.workers import ready, stored
from tidegraph.llm.common import slices

UNKNOWN = "und"
#: Characters handled at a time; longer texts run over, joined at their seams.
CHARS = 1_000_000
#: For each so many n-grams of a language's sample an n-gram must occur once more to count.
PLENTY = 20_000
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))
_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _letters


def grams(points: np.ndarray, order: int) -> np.ndarray:
    """A 64-bit hash of every n-gram in a sequence of code points."""
    n = len(points) - order + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.full(n, np.uint64(order))
    for i in range(order):
        h = (h ^ points[i : i + n]) * MIX[0]
        h ^= h >> np.uint64(29)
    h *= MIX[1]
    h ^= h >> np.uint64(32)
    return h


def clean(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one sequence of lower-case letters, every run of other characters one space, and whose each is. A space stands before and after each text."""
    low = [f" {t.lower()} " for t in texts]
    points = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    whose = np.repeat(np.arange(len(low)), [len(t) for t in low])
    points = np.where(letters()[points], points, 32)
    keep = np.concatenate(([True], (points[1:] != 32) | (points[:-1] != 32) | (whose[1:] != whose[:-1])))
    return points[keep].astype(np.uint64), whose[keep]


def grams_of(points: np.ndarray, whose: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every n-gram that lies within one text, whose it is); single characters are letters."""
    h = grams(points, order)
    inside = points != 32 if order == 1 else whose[: len(h)] == whose[order - 1 :][: len(h)]
    return h[inside], whose[: len(h)][inside]


def pieces(texts: list[str], seam: int) -> Iterator[tuple[list[int], list[str]]]:
    """(numbers, texts) of about CHARS characters; a longer text comes in parts that overlap by `seam` characters."""
    numbers, part, size = [], [], 0
    for i, t in enumerate(texts):
        for at in range(0, max(len(t), 1), CHARS):
            cut = t[max(0, at - seam) : at + CHARS] if len(t) > CHARS else t
            numbers.append(i)
            part.append(cut)
            size += len(cut)
            if size >= CHARS:
                yield numbers, part
                numbers, part, size = [], [], 0
    if part:
        yield numbers, part


@dataclass
class Model:
    """Languages by name, and their common filter: slots x words of 64 bits (or fewer) of language bits."""

    languages: list[str]
    slots: np.ndarray
    chance: np.ndarray
    orders: tuple[int, ...]
    probes: int = 3

    @staticmethod
    def fit(found: pd.DataFrame, orders: tuple[int, ...], bits: int = 20, near: float = 0.5, probes: int = 3) -> Model:
        """found: lang, gram (signed 64-bit hash), n."""
        languages = sorted(found["lang"].unique().tolist()) if len(found) else []
        words = max(1, -(-len(languages) // 64))
        kind = np.uint8 if len(languages) <= 8 else np.uint64
        slots = np.zeros((1 << bits, words), kind)
        chance = np.zeros(len(languages))
        if len(found):
            share = found["n"] / found.groupby("lang")["n"].transform("sum")
            top = share.groupby(found["gram"]).transform("max")
            held = found[share >= near * top]
            for i, lang in enumerate(languages):
                h = held.loc[held["lang"] == lang, "gram"].to_numpy(np.int64).view(np.uint64)
                for p in range(probes):
                    slots[Model.slot(h, p, bits), i // 64] |= kind(1 << i % 64)
                chance[i] = float(((slots[:, i // 64] >> kind(i % 64)) & kind(1)).mean()) ** probes
        return Model(languages, slots, chance, orders, probes)

    @staticmethod
    def slot(h: np.ndarray, probe: int, bits: int) -> np.ndarray:
        return (h >> np.uint64(20 * probe) & np.uint64((1 << bits) - 1)).astype(np.int64)

    def counts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(texts x languages) n-grams that each language holds, and n-grams of each text."""
        bits = int(len(self.slots)).bit_length() - 1
        hits, total = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts))
        for numbers, part in pieces(texts, max(self.orders) - 1):
            numbers = np.array(numbers)
            points, whose = clean(part)
            for order in self.orders:
                h, at = grams_of(points, whose, order)
                mask = self.slots[self.slot(h, 0, bits)]
                for p in range(1, self.probes):
                    mask = mask & self.slots[self.slot(h, p, bits)]
                total += np.bincount(numbers[at], minlength=len(texts))[: len(texts)]
                if self.slots.dtype == np.uint8:
                    table = np.bincount(at * 256 + mask[:, 0], minlength=256 * len(part)).reshape(-1, 256)
                    held = table @ (np.arange(256)[:, None] >> np.arange(len(self.languages)) & 1)
                    np.add.at(hits, numbers, held)
                else:
                    for i in range(len(self.languages)):
                        on = (mask[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)
                        hits[:, i] += np.bincount(numbers[at], weights=on, minlength=len(texts))
        return hits, total

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score (its part of all corrected counts) and held (part of the n-grams it holds) of each text."""
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
        known = [t or "" for t in texts]
        hits, total = self.counts(known)
        right = np.maximum(0, (hits - total[:, None] * self.chance) / np.maximum(1e-9, 1 - self.chance))
        best = right.argmax(axis=1)
        top = right[np.arange(len(known)), best]
        score = np.clip(top / np.maximum(right.sum(axis=1), 1e-9), 0, 1)
        some = np.array([bool(letters()[np.frombuffer(t.encode("utf-32-le"), np.uint32)].any()) if t else False for t in known], bool)
        names = [self.languages[b] if ok else UNKNOWN for b, ok in zip(best, some, strict=True)]
        return names, np.where(some, score, 0.0), np.where(some, np.clip(top / np.maximum(total, 1), 0, 1), 0.0)


def train(labelled: DataFrame, per_language: int = 1500, orders: tuple[int, ...] = (1, 3), least: int = 3) -> Model:
    """labelled (doc_id, text, lang) -> model, from about `per_language` whole documents of each language.

    The sample is by a hash of id and text, at a rate that each language's document count gives; rarer languages are
    read whole, and of rows alike one. Null texts and languages are left out. Only the n-grams of that sample reach the
    driver; of a language with many, those that occur `least` times or more. Up to 4,096 languages; a column with more is refused.
    """
    spark = labelled.sparkSession
    ready(spark)
    labelled = labelled.select("doc_id", "text", "lang").filter("text is not null and lang is not null")
    sizes = [(r["lang"], r["count"]) for r in labelled.groupBy("lang").count().limit(4097).collect()]
    if len(sizes) > 4096:
        raise ValueError("over 4,096 languages: is lang the right column?")
    rates = [(lang, int(min(1.0, per_language / n) * (1 << 30))) for lang, n in sizes]
    if not rates:
        return Model([], np.zeros((1, 1), np.uint8), np.zeros(0), orders)
    chosen = labelled.join(F.broadcast(spark.createDataFrame(rates, "lang string, rate long")), "lang").filter(F.pmod(F.xxhash64("doc_id", "lang", "text"), F.lit(1 << 30)) < F.col("rate")).select("doc_id", "lang", "text").distinct()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text"):
                langs = piece.column("lang").to_pylist()
                for lang in dict.fromkeys(langs):
                    texts = [t for t, x in zip(piece.column("text").to_pylist(), langs, strict=True) if x == lang]
                    for _, part in pieces(texts, max(orders) - 1):
                        points, whose = clean(part)
                        for order in orders:
                            gram, n = np.unique(grams_of(points, whose, order)[0], return_counts=True)
                            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram), pa.string()), pa.array(gram.view(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])

    found = stored(chosen.select("lang", "text").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    total = found.groupBy("lang").agg(F.sum("n").alias("total"))
    rare = F.least(F.lit(least), F.floor(F.col("total") / PLENTY) + 1)  # of a short sample all n-grams count
    return Model.fit(found.join(F.broadcast(total), "lang").filter(F.col("n") >= rare).select("lang", "gram", "n").toPandas(), orders)


def predict(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), prefix: str = "") -> DataFrame:
    """docs (text, ...) -> the columns to keep, and lang_pred, score, held (their names after `prefix`), from the text alone.

    `und` with score 0 where the text is null or has no letter (or where nothing was learned). Ties go to the first
    language by code point. Whole texts of any length. Repeated rows each get a row; empty input gives none.
    """
    ready(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "__text"):
                names, score, held = sent.value.predict(piece.column("__text").to_pylist())
                yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in keep), pa.array(names, pa.string()), pa.array(score), pa.array(held)], names=[*keep, *found])

    types = dict(docs.dtypes)
    found = [f"{prefix}{x}" for x in ("lang_pred", "score", "held")]
    kind = "".join(f"`{c}` {types[c]}, " for c in keep) + ", ".join(f"`{c}` {t}" for c, t in zip(found, ("string", "double", "double"), strict=True))
    return docs.select(*keep, F.col("text").cast("string").alias("__text")).mapInArrow(run, kind)


def identify(docs: DataFrame, parts: int = 4, out: int = 2, per_language: int = 1500) -> DataFrame:
    """Learns from documents whose crc32(doc_id) mod `parts` is not `out` and predicts all: doc_id, held_out, lang_pred, score, held.

    Rows without an id are learned from. Repeated rows each get a row; empty input gives none; without labels all are `und`.
    """
    rest = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(parts))
    held_out = F.coalesce(rest == out, F.lit(False))
    model = train(docs.filter(~held_out).select("doc_id", "text", "lang"), per_language)
    return predict(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "held")
