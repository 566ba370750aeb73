"""A document-quality classifier by co-training two views.

One classifier reads the text alone, one the page's metadata (source, language, length as announced). Both start
from the same labelled documents; in each round each predicts all unlabelled documents and hands those it is
most sure of to the other as pseudo-labels. Both are then calibrated on labelled documents that neither has learned
from, and the calibrated views are combined to score every document.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph.functions.workers import discard, ready, stored
from tidegraph.llm.common import slices
from tidegraph.llm.langid import pieces as windows
from tidegraph.llm.shingles import distinct, lowered, word_hashes

#: Bound of the labelled documents that are fitted on, a fifth of them for calibration.
LABELLED = 4000
#: Rounds; a document is handed over with at least this probability; so many by each view in each round.
ROUNDS, SURE, EACH = 5, 0.97, 200
#: Documents for calibration by which a view's confidence is judged.
FEW = 10
#: Steps of confidence that predictions are counted in.
LOGIT_STEP = 0.02
KINDS, WORDS = 16, 256
BASIC = 9
SOURCES, LANGS, LENGTHS = 64, 16, 12
_kinds: np.ndarray | None = None


def kinds() -> np.ndarray:
    """The kind of each code point: space, line end, lower, upper, digit, marks of several sorts, other letters."""
    global _kinds
    if _kinds is None:
        table = np.full(0x110000, 14, np.uint8)
        for i in range(0x110000):
            c = chr(i)
            if c.isspace():
                table[i] = 1 if c in "\n\r" else 0
            elif c.isalpha():
                table[i] = 2 if c.islower() else 3 if c.isupper() else 15
            elif c.isdigit():
                table[i] = 4
        for kind, marks in ((5, "."), (6, ","), (7, "!"), (8, "?"), (9, "|"), (10, "'\"`"), (11, "()[]{}"), (12, "<>/\\="), (13, "@#$%&*")):
            table[[ord(c) for c in marks]] = kind
        _kinds = table
    return _kinds


def text_features(texts: list[str | None]) -> np.ndarray:
    """One row per text, from 0 to 1: shares of neighbouring character kinds and of words by hash (square roots), and how much words and lines repeat."""
    d = len(texts)
    pairs = np.zeros((d, KINDS * KINDS))
    for numbers, part in windows([t or "" for t in texts], 1):
        kind = kinds()[np.frombuffer("".join(part).encode("utf-32-le", "surrogatepass"), np.uint32)].astype(np.int64)
        whose = np.repeat(np.arange(len(part)), [len(p) for p in part])
        both = whose[1:] == whose[:-1]
        found = np.bincount((whose[1:] * KINDS * KINDS + kind[:-1] * KINDS + kind[1:])[both], minlength=len(part) * KINDS * KINDS)
        np.add.at(pairs, np.array(numbers), found.reshape(len(part), -1))
    h, n = word_hashes(lowered(texts))
    whose = np.repeat(np.arange(d), n)
    words = np.bincount(whose * WORDS + (h % np.uint64(WORDS)).astype(np.int64), minlength=d * WORDS).reshape(d, WORDS)
    repeated = np.bincount(whose[1:][(h[1:] == h[:-1]) & (whose[1:] == whose[:-1])], minlength=d)
    _, different = distinct(h, n)  # sorts h within each text
    edge = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (whose[1:] != whose[:-1])))) if len(h) else np.zeros(0, np.int64)
    most = np.zeros(d)
    np.maximum.at(most, whose[edge], np.diff(np.append(edge, len(h))))
    size, some = np.array([len(t or "") for t in texts], float), np.maximum(1, n)
    basic = np.zeros((d, BASIC))
    basic[:, 0], basic[:, 1] = np.log1p(size) / 20, np.log1p(n) / 20
    basic[:, 2], basic[:, 3], basic[:, 4] = different / some, repeated / some, most / some
    basic[:, 5] = np.minimum(1.0, size / some / 30) * (n > 0)
    for i, text in enumerate(texts):
        lines = [x for x in (text or "").split("\n") if x.strip()]
        if lines:
            basic[i, 6], basic[i, 7] = len(set(lines)) / len(lines), min(1.0, len(lines) / some[i])
    basic[:, 8] = n == 0
    shares = [np.sqrt(x / np.maximum(1.0, x.sum(axis=1, keepdims=True))) for x in (pairs, words)]
    return np.clip(np.concatenate([*shares, basic], axis=1), 0, 1)


def meta_features(source: str | None, lang: str | None, n_chars: int | None) -> np.ndarray:
    """Hashed source and language, the announced length in steps, from 0 to 1; nulls have places of their own."""
    out = np.zeros(SOURCES + LANGS + LENGTHS + 4, np.float32)
    if source is None:
        out[-1] = 1
    else:
        out[zlib.crc32(source.encode()) % SOURCES] = 1
    if lang is None:
        out[-2] = 1
    else:
        out[SOURCES + zlib.crc32(lang.encode()) % LANGS] = 1
    if n_chars is None:
        out[-3] = 1
    else:
        size = float(np.log2(1 + max(0, n_chars)))
        out[SOURCES + LANGS + min(LENGTHS - 1, int(size // 2))] = 1
        out[-4] = min(1.0, size / 40)
    return out


@dataclass
class Logistic:
    """Logistic regression on standardised features."""

    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    bias: float

    def logit(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weight + self.bias

    @staticmethod
    def fit(x: np.ndarray, y: np.ndarray, w: np.ndarray, penalty: float = 1.0, rounds: int = 25) -> Logistic:
        """Newton steps on weighted rows; with one class alone, that class's smoothed share."""
        mean, scale = x.mean(axis=0, dtype=np.float64), x.std(axis=0, dtype=np.float64)
        scale = np.where(scale > 1e-8, scale, 1.0)
        share = (float((w * y).sum()) + 0.5) / (float(w.sum()) + 1.0)
        beta = np.zeros(x.shape[1] + 1)
        beta[-1] = np.log(share / (1 - share))
        if y.min() != y.max():
            z = np.concatenate([(x - mean) / scale, np.ones((len(x), 1))], axis=1)
            ridge = np.full(len(beta), penalty)
            ridge[-1] = 1e-6
            for _ in range(rounds):
                p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
                gradient = z.T @ (w * (y - p)) - ridge * beta
                curve = (z * (w * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ z + np.diag(ridge)
                step = np.linalg.solve(curve, gradient)
                beta += step * min(1.0, 10 / max(1e-9, np.abs(step).max()))
                if np.abs(step).max() < 1e-6:
                    break
        return Logistic(mean, scale, beta[:-1], float(beta[-1]))


def probability(logit: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def sure_from(logit: np.ndarray, y: np.ndarray, label: int) -> float | None:
    """The logit (of the label) from which at least SURE of the documents at or above it have the label, but no lower than that of SURE itself; None without FEW of them."""
    mine = logit if label else -logit
    order = np.argsort(-mine, kind="stable")
    right = np.cumsum(y[order] == label) / np.arange(1, len(order) + 1)
    good = np.flatnonzero((right >= SURE) & (np.arange(len(order)) + 1 >= FEW))
    return max(float(np.log(SURE / (1 - SURE))), float(mine[order][good[-1]])) if len(good) else None


def packed(x: np.ndarray) -> np.ndarray:
    """Features from 0 to 1 in 255 steps: what is fitted on and what is predicted from."""
    return np.rint(x * 255).astype(np.uint8)


def unpacked(x: np.ndarray) -> np.ndarray:
    return x.astype(np.float32) / 255


@dataclass
class CoTrained:
    """Two views' classifiers, and the calibrated combination of their logits."""

    text: Logistic
    meta: Logistic
    both: Logistic
    handed: int

    @staticmethod
    def fit(text: np.ndarray, meta: np.ndarray, y: np.ndarray, calibrate: np.ndarray, most_sure) -> CoTrained:
        """y: labels of the rows of text and meta; calibrate: which of them are kept for calibration.

        most_sure(models, quotas, least): for each (view, label) the (text rows, meta rows) of at most so many unlabelled documents that
        the view is most sure of, from a logit on, and that it hasn't handed over yet. A view hands over nothing for which its
        confidence doesn't hold on the documents kept for calibration.
        """
        learn = ~calibrate if (~calibrate).any() else np.ones(len(y), bool)
        check = calibrate if calibrate.any() else learn
        sets = {v: [(x[learn], y[learn], np.ones(learn.sum()))] for v, x in (("text", text), ("meta", meta))}
        share, handed = float(y[learn].mean()), 0

        def train(view: str) -> Logistic:
            x, label, weight = (np.concatenate(part) for part in zip(*sets[view], strict=True))
            return Logistic.fit(x, label, weight)

        models = {v: train(v) for v in sets}
        quotas = {(v, label): max(1, round(EACH * part)) for v in sets for label, part in ((1, share), (0, 1 - share))}
        for _ in range(ROUNDS):
            moved = 0
            least = {(v, label): sure_from(models[v].logit(x[check]), y[check], label) for v, x in (("text", text), ("meta", meta)) for label in (1, 0)}
            asked = {k: n for k, n in quotas.items() if least[k] is not None}
            for (view, label), rows in most_sure(models, asked, least).items() if asked else ():
                other = "meta" if view == "text" else "text"
                x = rows[1] if view == "text" else rows[0]
                if len(x):
                    sets[other].append((x, np.full(len(x), float(label)), np.full(len(x), 0.5)))
                    moved += len(x)
            handed += moved
            if not moved:
                break
            models = {v: train(v) for v in sets}
        logits = np.stack([np.clip(models["text"].logit(text[check]), -30, 30), np.clip(models["meta"].logit(meta[check]), -30, 30)], axis=1)
        return CoTrained(models["text"], models["meta"], Logistic.fit(logits, y[check], np.ones(len(logits)), penalty=1.0), handed)

    def predict(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(combined, text view's, metadata view's) probability of good quality."""
        t, m = np.clip(self.text.logit(text), -30, 30), np.clip(self.meta.logit(meta), -30, 30)
        return probability(self.both.logit(np.stack([t, m], axis=1))), probability(t), probability(m)


COLUMNS = ("text", "source", "lang", "n_chars")


def _both(piece: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    text, source, lang, n = (piece.column(c).to_pylist() for c in COLUMNS)
    return packed(text_features(text)), packed(np.stack([meta_features(*x) for x in zip(source, lang, n, strict=True)]))


def _plain(docs: DataFrame, *extra: str) -> DataFrame:
    return docs.select(*extra, F.col("text").cast("string").alias("text"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.col("n_chars").cast("long").alias("n_chars"))


def _rows(column: pa.Array) -> np.ndarray:
    flat = column.to_pylist()
    return unpacked(np.frombuffer(b"".join(flat), np.uint8).reshape(len(flat), -1))


def _most_sure(free: DataFrame):
    """Over stored features of unlabelled documents (id, t, m): what CoTrained.fit asks for.

    A pass counts documents by view, label and step of confidence; the counts give the confidence from which a view's quota
    is met, and a second pass fetches the documents above it, and of those at it as many as are missing, by a hash.
    """
    spark = free.sparkSession
    gone: dict[tuple[str, int], set[int]] = {}

    def logits(models: dict[str, Logistic], batch: pa.RecordBatch) -> Iterator[tuple[str, int, np.ndarray]]:
        for view, column in (("text", "t"), ("meta", "m")):
            step = np.floor(np.clip(models[view].logit(_rows(batch.column(column))), -30, 30) / LOGIT_STEP).astype(np.int64)
            yield view, 1, step
            yield view, 0, -step

    def ask(models: dict[str, Logistic], quotas: dict[tuple[str, int], int], least: dict[tuple[str, int], float | None]) -> dict[tuple[str, int], tuple[np.ndarray, np.ndarray]]:
        sent = spark.sparkContext.broadcast((models, {k: np.array(sorted(v), np.int64) for k, v in gone.items()}))
        lowest = {k: int(np.ceil(least[k] / LOGIT_STEP)) for k in quotas}

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            given, taken = sent.value
            for batch in batches:
                if not batch.num_rows:
                    continue
                ids = batch.column("id").to_numpy()
                for view, label, step in logits(given, batch):
                    if (view, label) not in lowest:
                        continue
                    hit = step >= lowest[view, label]
                    if (view, label) in taken:
                        hit &= ~np.isin(ids, taken[view, label])
                    steps, n = np.unique(step[hit], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([view] * len(n), pa.string()), pa.array(np.full(len(n), label, np.int32)), pa.array(steps), pa.array(n.astype(np.int64))], names=["view", "label", "step", "n"])

        found = free.mapInArrow(count, "view string, label int, step long, n long").groupBy("view", "label", "step").agg(F.sum("n").alias("n")).collect()
        edge: dict[tuple[str, int], tuple[int, float]] = {}  # the step that meets the quota, and the part of it that is fetched
        for key, quota in quotas.items():
            left = quota
            for step, n in sorted(((r["step"], r["n"]) for r in found if (r["view"], r["label"]) == key), reverse=True):
                edge[key] = (step, min(1.0, 2 * left / n))
                left -= n
                if left <= 0:
                    break
        wanted = spark.sparkContext.broadcast(edge)

        def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            given, taken = sent.value
            for batch in batches:
                if not batch.num_rows:
                    continue
                ids = batch.column("id").to_numpy()
                part = (ids.view(np.uint64) >> np.uint64(11)) / float(1 << 53)
                for view, label, step in logits(given, batch):
                    if (view, label) not in wanted.value:
                        continue
                    at, share = wanted.value[view, label]
                    hit = (step > at) | ((step == at) & (part < share))
                    if (view, label) in taken:
                        hit &= ~np.isin(ids, taken[view, label])
                    if hit.any():
                        keep, n = pa.array(hit), int(hit.sum())
                        yield pa.RecordBatch.from_arrays([pa.array([view] * n, pa.string()), pa.array(np.full(n, label, np.int32)), pa.array(step[hit]), *(batch.column(c).filter(keep) for c in ("id", "t", "m"))], names=["view", "label", "step", "id", "t", "m"])

        rows = free.mapInArrow(fetch, "view string, label int, step long, id long, t binary, m binary").toPandas() if edge else pd.DataFrame(columns=["view", "label", "step", "id", "t", "m"])
        out = {}
        for key, quota in quotas.items():
            mine = rows[(rows["view"] == key[0]) & (rows["label"] == key[1])].sort_values(["step", "id"], ascending=[False, True]).drop_duplicates("id").head(quota)
            gone.setdefault(key, set()).update(mine["id"].tolist())
            out[key] = tuple(unpacked(np.frombuffer(b"".join(mine[c]), np.uint8).reshape(len(mine), -1)) for c in ("t", "m")) if len(mine) else (np.zeros((0, 1)), np.zeros((0, 1)))
        return out

    return ask


def train(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED) -> CoTrained | None:
    """docs (doc_id, text, source, lang, n_chars) and labels (doc_id, quality 0/1) -> model; None without labels.

    About `labelled` labelled documents, chosen by a hash of id and text at a rate from counts, are fitted on. The features
    of all others are written once, in 255 steps; in every round both views predict all of them, and only those handed
    over reach the driver. Repeated labels of a document are averaged, null ones left out; of rows alike one is fitted on.
    """
    spark = docs.sparkSession
    ready(spark)
    docs = docs.select("doc_id", *COLUMNS)
    told = labels.filter("quality is not null and doc_id is not null").groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("y"))
    n_labels = told.count()
    if not n_labels:
        return None
    place = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("quality")), F.lit(1 << 30))
    # a bounded number of ids, about `labelled`
    taken = told.filter(place < int(min(1.0, labelled / n_labels) * (1 << 30))).withColumnRenamed("doc_id", "labelled_id")
    known = docs.join(F.broadcast(taken), F.col("doc_id") == F.col("labelled_id"))
    other = docs.join(F.broadcast(taken.select("labelled_id")), F.col("doc_id") == F.col("labelled_id"), "left_anti")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text"):
                t, m = _both(piece)
                extra = [c for c in piece.schema.names if c not in COLUMNS]
                yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in extra), pa.array([x.tobytes() for x in t], pa.binary()), pa.array([x.tobytes() for x in m], pa.binary())], names=[*extra, "t", "m"])

    got = _plain(known, "doc_id", "y").mapInArrow(run, "doc_id long, y int, t binary, m binary").distinct().toPandas().sort_values(["doc_id", "t", "m"], kind="stable")
    if not len(got):
        return None
    free = stored(_plain(other, F.xxhash64("doc_id", "text").alias("id")).mapInArrow(run, "id long, t binary, m binary"))
    text, meta = (unpacked(np.frombuffer(b"".join(got[c]), np.uint8).reshape(len(got), -1)) for c in ("t", "m"))
    calibrate = np.array([zlib.crc32(f"calibrate:{i}".encode()) % 5 == 0 for i in got["doc_id"]])
    model = CoTrained.fit(text, meta, got["y"].to_numpy().astype(float), calibrate, _most_sure(free))
    discard(free)
    return model


def score(docs: DataFrame, model: CoTrained | None, keep: tuple[str, ...] = ("doc_id",), prefix: str = "") -> DataFrame:
    """docs -> the columns to keep, and score, text_score, meta_score (their names after `prefix`): probabilities of good quality; 0.5 without a model.

    Whole texts of any length; nulls in any column are values of their own. Repeated rows each get a row; no rows in,
    no rows out. A score of exactly one half counts as good.
    """
    ready(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    types = dict(docs.dtypes)
    names = [f"{prefix}{x}" for x in ("score", "text_score", "meta_score")]
    plain = docs.select(*keep, *(F.col(c).cast("long" if c == "n_chars" else "string").alias(f"__{c}") for c in COLUMNS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            for piece in slices(batch, "__text"):
                if m is None:
                    found = (np.full(piece.num_rows, 0.5),) * 3
                else:
                    views = pa.RecordBatch.from_arrays([piece.column(f"__{c}") for c in COLUMNS], names=list(COLUMNS))
                    found = m.predict(*map(unpacked, _both(views)))
                yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in keep), *map(pa.array, found)], names=[*keep, *names])

    return plain.mapInArrow(run, ", ".join([*(f"`{c}` {types[c]}" for c in keep), *(f"`{c}` double" for c in names)]))


def classify(docs: DataFrame, labels: DataFrame, parts: int = 4, out: int = 2, labelled: int = LABELLED) -> DataFrame:
    """Every row of docs -> doc_id, held_out, quality_pred (0/1), score, text_score, meta_score.

    Learns only from rows whose crc32(doc_id) mod `parts` is not `out`. A tie (0.5, as without labels) is good. Empty docs: no rows.
    """
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(parts)) == out, F.lit(False))
    model = train(docs.filter(~held_out), labels, labelled)
    return score(docs, model, ("doc_id",)).select("doc_id", held_out.alias("held_out"), (F.col("score") >= 0.5).cast("int").alias("quality_pred"), "score", "text_score", "meta_score")
