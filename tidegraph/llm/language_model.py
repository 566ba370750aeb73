"""Scoring documents by a gated recurrent language model, trained here with numpy.

Words are counted over all training documents. The model reads the most frequent words as themselves and all others
as one of a few groups; its output is factored: first a class, then the word within it. In a
group the word follows the smoothed counts. Training is by truncated backpropagation: a sample of documents gives all
tasks one start, from which each task learns from all documents of its partition; parameters are averaged by tokens. Scoring carries the state over windows from each document's first word to its end.
"""

from __future__ import annotations

import copy
import heapq
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph.functions.workers import discard, ready, stored
from tidegraph.llm.common import slices
from tidegraph.llm.shingles import lowered, word_hashes, words_in

#: Words that the model knows, its word classes, and groups of all other words.
WORDS, CLASSES, GROUPS = 4096, 48, 16
#: Words whose counts every worker holds; counts of rarer words are joined by a shuffle.
HEAD = 1 << 18
EMBED, HIDDEN = 12, 16
#: Training: documents sampled, streams, steps of backpropagation, updates.
SAMPLE, STREAMS, STEPS, UPDATES = 1500, 64, 16, 500
#: Training: tokens of a document in one stream; the next ones follow in another.
SEGMENT = 512
#: Training on all documents: streams of a task, bytes of text held, and the first rate.
MANY, TEXTS, RATE = 512, 12_000_000, 0.004
#: The common start reads no text of more bytes, for it is made on the driver; such texts are learned from by the tasks.
START_BYTES = 200_000
#: Scoring: tokens held, streams side by side, steps between outputs.
CHUNK, WIDTH, WINDOW = 4_000_000, 1024, 16
#: Slots of the table that finds head words.
SLOTS = 1 << 20
END = b""
SMOOTH = 0.1


def tokens(text: str | None) -> list[bytes]:
    """Words of a text, A-Z lower-cased, without the end."""
    return (text or "").encode().lower().split()


def groups_of(words: list[bytes]) -> np.ndarray:
    """The group of each word, by its hash; the end is in the first."""
    h, n = word_hashes(words)
    out = np.zeros(len(words), np.int32)
    out[n > 0] = h % np.uint64(GROUPS)
    return out


def count_words(docs: DataFrame) -> DataFrame:
    """word, grp, c over all rows' texts, ends included: partial counts of each task, added by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            words = list(seen)
            return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(groups_of(words)), pa.array(list(seen.values()), pa.int64())], names=["word", "grp", "c"])

        for batch in batches:
            for text in batch.column("text").to_pylist():
                seen.update(tokens(text))
            seen[END] += batch.num_rows
            if len(seen) > 400_000:
                yield out()
                seen.clear()
        if seen:
            yield out()

    return docs.select("text").mapInArrow(run, "word binary, grp int, c long").groupBy("word", "grp").agg(F.sum("c").alias("c"))


def sigmoid(x: np.ndarray) -> np.ndarray:
    """In place."""
    x *= 0.5
    np.tanh(x, out=x)
    x *= 0.5
    x += 0.5
    return x


def log_sum(logits: np.ndarray) -> np.ndarray:
    """Natural log of the sum of exponentials of each row; logits are overwritten."""
    top = logits.max(axis=1)
    logits -= top[:, None]
    np.exp(logits, out=logits)
    return top + np.log(logits @ np.ones(logits.shape[1], np.float32))


def probabilities(logits: np.ndarray) -> np.ndarray:
    """Softmax for gradients: scaled by one maximum of all rows, far lower logits alike; in place."""
    logits -= logits.max(initial=0)
    np.maximum(logits, -80, out=logits)
    np.exp(logits, out=logits)
    logits /= (logits @ np.ones(logits.shape[1], np.float32))[:, None]
    return logits


class Room:
    """Arrays that are used again and again, by name: large new ones cost more than what is computed in them."""

    def __init__(self) -> None:
        self.held: dict[str, np.ndarray] = {}

    def __call__(self, name: str, *shape: int) -> np.ndarray:
        size = math.prod(shape)
        if name not in self.held or len(self.held[name]) < size:
            self.held[name] = np.empty(size, np.float32)
        return self.held[name][:size].reshape(shape)


def sums_by(rows: np.ndarray, values: np.ndarray, n: int, room: Room) -> np.ndarray:
    """values added up by their row, for n rows."""
    out = np.zeros((n, values.shape[1]), np.float32)
    order = np.argsort(rows.astype(np.uint16) if n < 1 << 16 else rows, kind="stable")
    rows = rows[order]
    first = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1])))
    out[rows[first]] = np.add.reduceat(values.take(order, axis=0, out=room("sorted", *values.shape), mode="clip"), first, axis=0)
    return out


@dataclass
class Recurrent:
    """Parameters: input embeddings (words, then groups), a gated recurrent layer, class outputs, word outputs."""

    starts: np.ndarray  # of each word class among the words, with the end of the last
    e: np.ndarray
    w: np.ndarray
    b: np.ndarray
    u: np.ndarray
    v: np.ndarray
    cw: np.ndarray
    cb: np.ndarray
    ow: np.ndarray
    ob: np.ndarray
    class_of: np.ndarray = field(init=False)
    room: Room = field(default_factory=Room, repr=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"room": Room()}

    def __post_init__(self) -> None:
        words = int(self.starts[-1])
        inner = np.repeat(np.arange(len(self.starts) - 1), np.diff(self.starts))
        self.class_of = np.concatenate([inner, np.arange(GROUPS) + len(self.starts) - 1])
        assert len(inner) == words

    @staticmethod
    def new(counts: np.ndarray, groups: np.ndarray, seed: int = 1) -> Recurrent:
        """Starts at the unigram model. counts: of the words, falling; groups: weight of each group."""
        rng = np.random.default_rng(seed)
        n = len(counts)
        mass = np.cumsum(np.sqrt(counts + 1.0))
        cut = np.searchsorted(mass, mass[-1] * np.arange(1, CLASSES) / CLASSES)
        starts = np.unique(np.concatenate([[0], cut, [n]])).astype(np.int64)
        small = lambda *shape: (rng.standard_normal(shape) * 0.1).astype(np.float32)
        sums = np.add.reduceat(counts + SMOOTH, starts[:-1])
        everything = np.concatenate([sums, groups])
        return Recurrent(
            starts, small(n + GROUPS, EMBED), small(EMBED, 3 * HIDDEN), np.concatenate([np.ones(HIDDEN), np.zeros(2 * HIDDEN)]).astype(np.float32), small(HIDDEN, 2 * HIDDEN), small(HIDDEN, HIDDEN),
            np.zeros((HIDDEN, len(everything)), np.float32), np.log(everything / everything.sum()).astype(np.float32), np.zeros((n, HIDDEN), np.float32),
            (np.log(counts + SMOOTH) - np.log(np.repeat(sums, np.diff(starts)))).astype(np.float32),
        )

    def step(self, x: np.ndarray, h: np.ndarray, zr: np.ndarray, cand: np.ndarray, rh: np.ndarray, out: np.ndarray) -> np.ndarray:
        """New states (out) from inputs' rows of e @ w + b and states; gates, candidates and reset states are left in zr, cand and rh."""
        np.matmul(h, self.u, out=zr)
        zr += x[:, : 2 * HIDDEN]
        sigmoid(zr)
        np.multiply(zr[:, HIDDEN:], h, out=rh)
        np.matmul(rh, self.v, out=cand)
        cand += x[:, 2 * HIDDEN :]
        np.tanh(cand, out=cand)
        np.subtract(h, cand, out=out)
        out *= zr[:, :HIDDEN]
        out += cand
        return out

    def given(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(embeddings, e @ w + b) of symbols."""
        embedded = self.e.take(x, axis=0, out=self.room("embedded", len(x), EMBED), mode="clip")
        rows = np.matmul(embedded, self.w, out=self.room("given", len(x), 3 * HIDDEN))
        rows += self.b
        return embedded, rows

    def by_class(self, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int, int]]]:
        """(class of each target, rows by class, (first row, last, first word, last) of each word class with rows and several words)."""
        c = self.class_of[y]
        order = np.argsort(c.astype(np.uint8) if len(self.starts) + GROUPS < 256 else c, kind="stable")
        edge = np.searchsorted(c[order], np.arange(len(self.starts))).tolist()
        parts = [(edge[k], edge[k + 1], int(self.starts[k]), int(self.starts[k + 1])) for k in range(len(self.starts) - 1)]
        return c, order, [p for p in parts if p[1] > p[0] and p[3] - p[2] > 1]

    def output(self, h: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Natural log of each target's class (and of the word, where it is one) given the state."""
        c, order, parts = self.by_class(y)
        logits = np.matmul(h, self.cw, out=self.room("classes", len(y), len(self.cb)))
        logits += self.cb
        out = logits[np.arange(len(y)), c]
        out -= log_sum(logits)
        states, targets, more = h.take(order, axis=0, out=self.room("mine", *h.shape), mode="clip"), y[order], np.zeros(len(y), np.float32)
        for i, j, a, b in parts:
            logits = np.matmul(states[i:j], self.ow[a:b].T, out=self.room("words", j - i, b - a))
            logits += self.ob[a:b]
            more[i:j] = logits[np.arange(j - i), targets[i:j] - a]
            more[i:j] -= log_sum(logits)
        out[order] += more
        return out

    def update(self, x: np.ndarray, y: np.ndarray, fresh: np.ndarray, h: np.ndarray, adam: dict, rate: float, live: np.ndarray | None = None) -> np.ndarray:
        """One update on a window (steps x streams) of inputs, targets and starts of documents; the state after it. Positions that aren't live count for nothing."""
        (steps, n), flat, room = x.shape, y.ravel(), self.room
        weight = None if live is None or live.all() else live.reshape(-1, 1).astype(np.float32)
        embedded, given = self.given(x.ravel())
        given = given.reshape(steps, n, 3 * HIDDEN)
        olds, cands, held, states = (room(k, steps, n, HIDDEN) for k in ("olds", "cands", "held", "states"))
        zrs, starts = room("zrs", steps, n, 2 * HIDDEN), fresh.any(axis=1).tolist()
        for t in range(steps):
            np.multiply(h, ~fresh[t][:, None] if starts[t] else 1, out=olds[t])
            h = self.step(given[t], olds[t], zrs[t], cands[t], held[t], states[t])
        last, states = h.copy(), states.reshape(-1, HIDDEN)
        c, order, parts = self.by_class(flat)
        p = np.matmul(states, self.cw, out=room("classes", len(flat), len(self.cb)))
        p += self.cb
        probabilities(p)
        p[np.arange(len(flat)), c] -= 1
        if weight is not None:
            p *= weight
        grads = {"cw": states.T @ p, "cb": p.sum(axis=0), "ow": np.zeros_like(self.ow), "ob": np.zeros_like(self.ob)}
        back = np.matmul(p, self.cw.T, out=room("back", len(flat), HIDDEN))
        mine, targets, more = states.take(order, axis=0, out=room("mine", *states.shape), mode="clip"), flat[order], room("more", *states.shape)
        more.fill(0)
        heavy = None if weight is None else weight[order]
        for i, j, a, b in parts:
            p = np.matmul(mine[i:j], self.ow[a:b].T, out=room("words", j - i, b - a))
            p += self.ob[a:b]
            probabilities(p)
            p[np.arange(j - i), targets[i:j] - a] -= 1
            if heavy is not None:
                p *= heavy[i:j]
            grads["ow"][a:b] = p.T @ mine[i:j]
            grads["ob"][a:b] = p.sum(axis=0)
            np.matmul(p, self.ow[a:b], out=more[i:j])
        back[order] += more
        back = back.reshape(steps, n, HIDDEN)
        z, r = zrs[:, :, :HIDDEN], zrs[:, :, HIDDEN:]
        # factors of the gates' and candidates' gradients
        by_cand, by_z, by_r = (room(k, steps, n, HIDDEN) for k in ("by_cand", "by_z", "by_r"))
        np.subtract(olds, cands, out=by_z)
        by_z *= z
        cands *= cands
        np.subtract(1, cands, out=by_cand)
        one = np.subtract(1, z, out=cands)
        by_z *= one
        by_cand *= one
        np.subtract(1, r, out=by_r)
        by_r *= held
        dx, dh, drh, more = room("dx", steps, n, 3 * HIDDEN), room("dh", n, HIDDEN), room("drh", n, HIDDEN), room("mine", n, HIDDEN)
        dh.fill(0)
        for t in reversed(range(steps)):
            dh += back[t]
            d = dx[t]
            dc = np.multiply(dh, by_cand[t], out=more)
            d[:, 2 * HIDDEN :] = dc
            np.matmul(dc, self.v.T, out=drh)
            np.multiply(dh, by_z[t], out=d[:, :HIDDEN])
            np.multiply(drh, by_r[t], out=d[:, HIDDEN : 2 * HIDDEN])
            dh *= z[t]
            drh *= r[t]
            dh += drh
            dh += np.matmul(d[:, : 2 * HIDDEN], self.u.T, out=drh)
            if starts[t]:
                dh *= ~fresh[t][:, None]
        dx = dx.reshape(-1, 3 * HIDDEN)
        grads |= {"u": olds.reshape(-1, HIDDEN).T @ dx[:, : 2 * HIDDEN], "v": held.reshape(-1, HIDDEN).T @ dx[:, 2 * HIDDEN :], "w": embedded.T @ dx, "b": dx.sum(axis=0)}
        grads["e"] = sums_by(x.ravel(), np.matmul(dx, self.w.T, out=room("words", len(dx), EMBED)), len(self.e), room)
        adam["t"] = adam.get("t", 0) + 1
        for name, g in grads.items():
            g = np.clip(g / n, -5, 5)
            m, s = adam.setdefault(name, (np.zeros_like(g), np.zeros_like(g)))
            m *= 0.9
            m += 0.1 * g
            s *= 0.999
            g *= g
            s += 0.001 * g
            step = (rate / (1 - 0.9 ** adam["t"])) * m / (np.sqrt(s / (1 - 0.999 ** adam["t"])) + 1e-6)
            setattr(self, name, (getattr(self, name) - step).astype(np.float32))
        return last


def lay_out(lengths: np.ndarray, width: int) -> tuple[list[list[int]], np.ndarray]:
    """Documents dealt to streams, longest first to the shortest stream; streams by falling length."""
    width = max(1, min(width, len(lengths)))
    heap = [(0, i) for i in range(width)]
    streams: list[list[int]] = [[] for _ in range(width)]
    for d in np.argsort(-lengths, kind="stable").tolist():
        size, i = heap[0]
        streams[i].append(d)
        heapq.heapreplace(heap, (size + int(lengths[d]), i))
    total = np.array([int(lengths[s].sum()) for s in streams])
    order = np.argsort(-total, kind="stable")
    return [streams[i] for i in order], total[order]


class Streams:
    """Documents side by side in streams, read window by window; nothing is held but the tokens themselves."""

    def __init__(self, docs: list[np.ndarray], width: int) -> None:
        members, self.total = lay_out(np.array([len(d) for d in docs]), width)
        order = [d for s in members for d in s]
        sizes = np.array([len(docs[d]) for d in order])
        self.y = np.concatenate([docs[d] for d in order]).astype(np.int32)
        self.whose = np.repeat(np.array(order, np.int32), sizes)
        self.fresh = np.zeros(len(self.y), bool)
        self.fresh[np.cumsum(sizes) - sizes] = True
        self.first = np.cumsum(self.total) - self.total
        self.steps = int(self.total.max(initial=0))

    def window(self, at: int, steps: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(targets, the ones before, whose, starts, which of them there are): steps x those streams that go on at `at`."""
        n = int(np.searchsorted(-self.total, -at, "left"))
        t = at + np.arange(min(steps, self.steps - at))[:, None]
        live = t < self.total[:n]
        i = np.minimum(self.first[:n] + t, len(self.y) - 1)
        return self.y[i], self.y[np.maximum(i - 1, 0)], self.whose[i], self.fresh[i] & live, live


@dataclass
class LanguageModel:
    """head: words by falling count (END among them); the first of them, `known`, are the model's words."""

    head: list[bytes]
    counts: np.ndarray
    known: int
    total: int
    distinct: int
    group_total: np.ndarray
    group_distinct: np.ndarray
    net: Recurrent

    def __post_init__(self) -> None:
        self.place = {w: i for i, w in enumerate(self.head)}
        self.symbol = np.arange(len(self.head), dtype=np.int32)
        self.symbol[self.known :] = self.known + groups_of(self.head[self.known :])
        self.group_norm = np.log10(self.group_total + SMOOTH * (self.group_distinct + 1))
        self.norm = math.log10(self.total + SMOOTH * (self.distinct + 1))
        self.log_count = np.log10(self.counts + SMOOTH)

        self._index()

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("place", "hashes", "order", "slots")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._index()

    def _index(self) -> None:
        """Head words by hash: sorted, and a table of slots in which the most frequent word of each slot stands."""
        self.place = {w: i for i, w in enumerate(self.head)}
        real = np.array([i for i, w in enumerate(self.head) if w], np.int64)
        h, _ = word_hashes([self.head[i] for i in real.tolist()])
        order = np.argsort(h, kind="stable")
        self.hashes, self.order = h[order], real[order]
        self.slots = np.full(SLOTS, -1, np.int32)
        self.slots[(h[::-1] & np.uint64(SLOTS - 1)).astype(np.int64)] = np.argsort(order)[::-1]

    def find(self, h: np.ndarray) -> np.ndarray:
        """Each word's place in the head by its hash, -1 for a rare word."""
        if not len(self.hashes):
            return np.full(len(h), -1, np.int64)
        at = self.slots[(h & np.uint64(SLOTS - 1)).astype(np.int64)]
        rest = np.flatnonzero((at < 0) | (self.hashes[at] != h))
        out = self.order[at]
        near = np.minimum(np.searchsorted(self.hashes, h[rest]), len(self.hashes) - 1)
        out[rest] = np.where(self.hashes[near] == h[rest], self.order[near], -1)
        return out

    def read(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[list[bytes]]]:
        """Symbols of all texts, ends included, one text after another; tokens of each; each token's place in the head (-1: rare); rare words of each text."""
        data, h, start, end, n = words_in(lowered(texts))
        found, size = self.find(h), n + 1
        tokens = np.ones(len(h) + len(n), bool)
        tokens[np.cumsum(size) - 1] = False
        at = np.full(len(tokens), self.place[END], np.int64)
        at[tokens] = found
        symbols = self.symbol[at]
        missing = np.flatnonzero(found < 0)
        rare: list[list[bytes]] = [[] for _ in texts]
        if len(missing):
            symbols[np.flatnonzero(tokens)[missing]] = self.known + (h[missing] % np.uint64(GROUPS)).astype(np.int32)
            whose = np.searchsorted(np.cumsum(n), missing, "right").tolist()
            for d, a, b in zip(whose, start[missing].tolist(), end[missing].tolist(), strict=True):
                rare[d].append(data[a:b])
        return symbols, size, at, rare

    def likelihood(self, docs: list[np.ndarray]) -> np.ndarray:
        """Log10 probability of each document's symbols, the state carried from its start to its end."""
        score = np.zeros(len(docs))
        if not docs:
            return score
        net, room = self.net, self.net.room
        streams = Streams(docs, WIDTH)
        start = int(self.symbol[self.place[END]])
        h = np.zeros((len(streams.total), HIDDEN), np.float32)
        for at in range(0, streams.steps, WINDOW):
            y, before, whose, fresh, live = streams.window(at, WINDOW)
            steps, n = y.shape
            inputs = net.given(np.where(fresh, start, before).ravel())[1].reshape(steps, n, 3 * HIDDEN)
            starts = fresh.any(axis=1).tolist()
            h = h[:n].copy()
            states, zr, cand, rh = room("states", steps, n, HIDDEN), room("zrs", n, 2 * HIDDEN), room("cands", n, HIDDEN), room("held", n, HIDDEN)
            for t in range(steps):
                if starts[t]:
                    h = h * ~fresh[t][:, None]
                h = net.step(inputs[t], h, zr, cand, rh, states[t])
            found = net.output(states.reshape(-1, HIDDEN), y.ravel())
            score += np.bincount(whose.ravel(), weights=np.where(live.ravel(), found, 0), minlength=len(docs))
        return score / math.log(10)

    def train(self, texts: list[str], updates: int = UPDATES, streams: int = STREAMS, rate: float = 0.01, adam: dict | None = None) -> tuple[int, int]:
        """Truncated backpropagation over streams of segments of documents until all words were read, and from the start again up to `updates`; (updates made, tokens).

        A document of more than SEGMENT tokens goes on in another stream from the word before, with a new state, so no
        document makes its stream longer than the others.
        """
        if not texts or self.known < 2:
            return 0, 0
        start = int(self.symbol[self.place[END]])
        pieces, first = [], []
        for i in range(0, len(texts), 1000):
            flat, size, _, _ = self.read(texts[i : i + 1000])
            for symbols in np.split(flat, np.cumsum(size)[:-1]):
                for at in range(0, len(symbols), SEGMENT):
                    pieces.append(symbols[at : at + SEGMENT])
                    first.append(int(symbols[at - 1]) if at else start)
        dealt = Streams(pieces, streams)
        first = np.array(first, np.int32)
        windows = -(-dealt.steps // STEPS)
        updates = max(updates, windows)
        adam = {} if adam is None else adam
        h = np.zeros((0, HIDDEN), np.float32)
        for i in range(updates):
            at = i % windows * STEPS
            if not at:
                h = np.zeros((len(dealt.total), HIDDEN), np.float32)
            y, before, whose, fresh, live = dealt.window(at, STEPS)
            before = np.where(fresh, first[whose], before)
            h = self.net.update(before, y, fresh, h[: y.shape[1]], adam, rate * (1 - 0.9 * i / updates), live)
        return updates, len(dealt.y)


LEARNED = ("e", "w", "b", "u", "v", "cw", "cb", "ow", "ob")


def train_everywhere(training: DataFrame, model: LanguageModel) -> None:
    """Each task goes on from the model over all documents (text) of its partition; the model takes the mean of their parameters, weighted by tokens."""
    sent = training.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = copy.copy(sent.value)
        m.net = copy.deepcopy(m.net)
        adam: dict = {}
        texts, held, weight = [], 0, 0
        for batch in batches:
            for text in batch.column("text").to_pylist():
                texts.append(text)
                held += len(text or "")
                if held >= TEXTS:
                    weight += m.train(texts, 0, MANY, RATE, adam)[1]
                    texts, held = [], 0
        if texts:
            weight += m.train(texts, 0, MANY, RATE, adam)[1]
        if weight:
            flat = np.concatenate([getattr(m.net, name).ravel() for name in LEARNED]).astype(np.float32)
            yield pa.RecordBatch.from_arrays([pa.array([weight], pa.int64()), pa.array([flat.tobytes()], pa.binary())], names=["n", "flat"])

    total, mean = 0, None
    for r in stored(training.select("text").mapInArrow(run, "n long, flat binary")).toLocalIterator():
        flat = np.frombuffer(r["flat"], np.float32).astype(np.float64) * r["n"]
        mean = flat if mean is None else mean + flat
        total += r["n"]
    if mean is None:
        return
    at = 0
    for name in LEARNED:
        old = getattr(model.net, name)
        setattr(model.net, name, (mean[at : at + old.size] / total).astype(np.float32).reshape(old.shape))
        at += old.size


def values_of(found: list[tuple[int, bytes]]) -> np.ndarray:
    return np.array([c for c, _ in found], np.float64)


def fit(training: DataFrame, counts: DataFrame, sample: int = SAMPLE, updates: int = UPDATES) -> LanguageModel:
    """training (doc_id, text) and its stored word counts -> model. Head words by a histogram of counts, at most HEAD; texts of about `sample` documents reach the driver. All documents are learned from."""
    groups = counts.groupBy("grp").agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect()
    steps = F.floor(F.log2("c") * 8).cast("int")
    bins = sorted(((r["s"], r["n"]) for r in counts.groupBy(steps.alias("s")).agg(F.count("*").alias("n")).collect()), reverse=True)
    room, least = HEAD, None
    for s, n in bins:
        room -= n
        if room < 0:
            break
        least = s
    rows = counts.filter(steps >= (least if least is not None else 1 << 20)).toPandas() if bins else None
    found = sorted(zip(rows["c"].tolist(), map(bytes, rows["word"]), strict=True), key=lambda x: (-x[0], x[1])) if rows is not None else []
    if END not in {w for _, w in found}:
        ends = [r["c"] for r in counts.filter(F.col("word") == F.lit(END)).collect()]
        found = sorted([*found, (ends[0] if ends else 0, END)], key=lambda x: (-x[0], x[1]))
    total, distinct = np.zeros(GROUPS), np.zeros(GROUPS)
    for r in groups:
        total[r["grp"]], distinct[r["grp"]] = r["c"], r["n"]
    everything, kinds = int(total.sum()), int(distinct.sum())
    head = [w for _, w in found]
    known = min(WORDS, len(head))
    if END not in head[:known]:  # the end is always a word of the model
        i = head.index(END)
        found.insert(known - 1, found.pop(i))
        head.insert(known - 1, head.pop(i))
    values = values_of(found)
    group = groups_of(head[:known])
    total -= np.bincount(group, weights=values_of(found[:known]), minlength=GROUPS)
    distinct -= np.bincount(group, weights=values_of(found[:known]) > 0, minlength=GROUPS)
    net = Recurrent.new(values[:known], total + SMOOTH * (distinct + 1))
    model = LanguageModel(head, values, known, everything, kinds, total, distinct, net)
    n = int(values[head.index(END)])
    if n:
        chosen = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < int(min(1.0, sample / n) * (1 << 30))
        some = training.filter(chosen & (F.coalesce(F.octet_length("text"), F.lit(0)) <= START_BYTES)).select("doc_id", "text").distinct().toPandas()
        model.train(some.sort_values(["doc_id", "text"], na_position="first")["text"].tolist(), updates)
        train_everywhere(training, model)
    return model


def score_documents(docs: DataFrame, parts: int = 10, out: int = 0, sample: int = SAMPLE, updates: int = UPDATES) -> DataFrame:
    """Every row of docs (doc_id, text) -> doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from rows whose crc32(doc_id) mod `parts` is not `out` (a null id is learned from). Tokens are words, A-Z
    lower-cased, and one end. base_score: log10 by smoothed counts; score: log10 by the model. Null texts are empty:
    one token. Rows that repeat an id each count and each get a row. Without training rows N = V = 0. No rows in, no
    rows out. Counts of words outside the head are joined by word: each is rare, so no key is hot.
    """
    spark = docs.sparkSession
    ready(spark)
    rest = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(parts))
    held_out = F.coalesce(rest == out, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held_out.alias("held_out"))
    training = rows.filter("not held_out")
    counts = stored(count_words(training))
    model = fit(training, counts, sample, updates)
    sent = spark.sparkContext.broadcast(model)
    shape = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("known", pa.int64()), ("base", pa.float64()), ("score", pa.float64()), ("rare", pa.list_(pa.struct([("w", pa.binary()), ("n", pa.int64())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        made: list[pa.RecordBatch] = []
        symbols: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            rows = pa.Table.from_batches(made).combine_chunks()
            score = rows.column("score").to_numpy() + m.likelihood(symbols)
            return rows.set_column(5, "score", pa.array(score)).to_batches()[0]

        for batch in batches:
            for piece in slices(batch, "text"):
                flat, size, at, rare = m.read(piece.column("text").to_pylist())
                ends = np.cumsum(size)
                first = ends - size
                told = np.where(at >= 0, m.log_count[at], 0.0)
                inside = np.where(at >= m.known, told, 0.0)
                outside = np.where(flat >= m.known, m.group_norm[np.maximum(flat - m.known, 0)], 0.0)
                add = lambda x: np.add.reduceat(x, first)
                counted = [Counter(r) for r in rare]
                columns = [
                    piece.column("doc_id"), piece.column("held_out"), pa.array(size.astype(np.int64)), pa.array(add((at >= 0) & (m.counts[at] > 0)).astype(np.int64)), pa.array(add(told) - size * m.norm),
                    pa.array(add(inside) - add(outside)), pa.array([[{"w": w, "n": n} for w, n in r.items()] for r in counted], shape.field("rare").type),
                ]
                made.append(pa.RecordBatch.from_arrays(columns, schema=shape))
                symbols += np.split(flat, ends[:-1])
                held += len(flat)
                if held >= CHUNK:
                    yield flush()
                    made, symbols, held = [], [], 0
        if made:
            yield flush()

    told = stored(rows.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, known long, base double, score double, rare array<struct<w:binary,n:bigint>>").withColumn("row", F.monotonically_increasing_id()))
    rare = told.select("row", F.explode("rare").alias("x")).select("row", "x.w", "x.n")
    rare = rare.join(counts.select(F.col("word").alias("w"), "c"), "w", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    extra = rare.groupBy("row").agg(F.sum(F.col("n") * F.log10(F.col("c") + SMOOTH)).alias("more"), F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("seen"))
    more, seen = F.coalesce("more", F.lit(0.0)), F.coalesce("seen", F.lit(0))
    return told.drop("rare").join(extra, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + seen).cast("long").alias("n_known"), F.lit(model.total).cast("long").alias("train_tokens"), (F.col("base") + more).alias("base_score"), (F.col("score") + more).alias("score")
    )
