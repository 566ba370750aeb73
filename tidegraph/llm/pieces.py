"""SentencePiece BPE encoding and decoding, in vectorised merge rounds.

A model file gives pieces and scores. A normalised text is cut where no piece can reach over; each distinct cut is
encoded once per worker. The symbols of all new cuts lie in one flat array; every round finds the least rank of a
mergeable pair in each cut, merges its occurrences from the left at once, and compacts the array, until no pair is
left. In a long cut (text without spaces) every pair that is the least for as far as a piece can reach is merged in
the same round. Characters without a piece become the pieces of their UTF-8 bytes.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph.functions.workers import ready
from tidegraph.llm.common import slices

SPACE = "▁"
#: Distinct cuts that a worker keeps; beyond that it starts anew.
CACHE = 300_000
#: Symbols merged at a time.
SYMBOLS = 1_000_000
NONE = np.int64(1 << 40)
#: Cuts of more characters are merged by windows.
LONG = 64
#: Where a round would merge less than one in so many symbols, the rest is merged pair by pair.
FEW = 64


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        value |= (byte & 127) << shift
        at, shift = at + 1, shift + 7
        if byte < 128:
            return value, at


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of each field of a protocol-buffer message."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        if tag & 7 == 0:
            value, at = _varint(data, at)
        elif tag & 7 == 2:
            size, at = _varint(data, at)
            value, at = data[at : at + size], at + size
        else:
            size = 4 if tag & 7 == 5 else 8
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


def _every_second(at: np.ndarray) -> np.ndarray:
    """Of each run of neighbouring places every second one, from its first."""
    run = np.maximum.accumulate(np.where(np.concatenate(([True], at[1:] != at[:-1] + 1)), np.arange(len(at)), 0))
    return at[(np.arange(len(at)) - run) % 2 == 0]


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours, by doubling."""
    size = 1
    while 2 * size <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (width - size)], x[width - size :]) if size < width else x


class Pieces:
    """A BPE model with byte fallback and identity normalisation, as its file says; anything else is refused."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            model = list(_fields(f.read()))
        self.piece: list[str] = []
        self.score: list[float] = []
        kinds: list[int] = []
        trainer: dict[int, object] = {}
        normal: dict[int, object] = {}
        for number, value in model:
            if number == 1:
                p = dict(_fields(value))
                self.piece.append(p[1].decode())
                self.score.append(float(np.frombuffer(p.get(2, b"\0\0\0\0"), "<f4")[0]))
                kinds.append(int(p.get(3, 1)))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                normal = dict(_fields(value))
        # fixed values of the format: model type 2 is BPE; kinds 1 normal, 2 unknown, 3 control, 4 user-defined, 5 unused, 6 byte
        if trainer.get(3) != 2 or not trainer.get(35) or trainer.get(24) or normal.get(2) or normal.get(4, 1) or not normal.get(5, 1) or {4, 5} & set(kinds):
            raise ValueError("only BPE models with byte fallback, identity normalisation and no user-defined or unused pieces")
        self.prefix = bool(normal.get(3, 1))
        self.n = len(self.piece)
        self.ids = {p: i for i, (p, k) in enumerate(zip(self.piece, kinds, strict=True)) if k == 1}
        self.byte = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.piece, kinds, strict=True)) if k == 6}
        self.is_byte = np.array([k == 6 for k in kinds])
        order = sorted(self.ids.values(), key=lambda i: -self.score[i])
        self.rank = np.full(self.n, NONE)
        last, at = None, -1
        for i in order:  # equal scores, equal ranks
            at += self.score[i] != last
            last = self.score[i]
            self.rank[i] = at
        inner = {c for p in self.ids if len(p) > 1 for c in p}
        crossing = any(SPACE in p.lstrip(SPACE) for p in self.ids)
        alone = "".join(re.escape(c) for c in "\n\r\t" if c not in inner)
        # a cut starts before white space that follows anything else; characters of no longer piece are cuts of their own
        self.cuts = re.compile((f"[{alone}]|" if alone else "") + (f"{SPACE}+[^{SPACE}{alone}]*|[^{SPACE}{alone}]+" if not crossing else f"[^{alone}]+"))
        extra: dict[str, int] = {}
        for c in inner:
            if c not in self.ids:
                extra[c] = self.n + len(extra)
        self.symbols = {p: i for p, i in self.ids.items() if len(p) == 1} | extra
        of = {**extra, **self.ids}
        keys, made = [], []
        for p, i in self.ids.items():
            for k in range(1, len(p)):
                a, b = of.get(p[:k]), of.get(p[k:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    made.append(i)
        order = np.argsort(np.array(keys, np.int64))
        self.pair, self.made = np.array(keys, np.int64)[order], np.array(made, np.int64)[order]
        self.makes = dict(zip(self.pair.tolist(), self.made.tolist(), strict=True))
        # pieces after whose making a pair as good or better may stand beside them: their occurrences are merged one by one
        sided = self.made[self.rank[self.made] <= np.maximum(self._ranks(self.pair >> 32), self._ranks(self.pair & 0xFFFFFFFF))]
        parts = np.concatenate([self.pair[np.isin(self.made, sided)] >> 32, self.pair[np.isin(self.made, sided)] & 0xFFFFFFFF])
        whole = np.concatenate([self.made[np.isin(self.made, sided)]] * 2)
        self.single = np.zeros(self.n + len(extra), bool)
        self.single[parts[self.rank[whole] <= self._ranks(parts)]] = True
        self.reach = max(map(len, self.ids), default=1)  # no piece reaches over more characters
        ranks = self.rank[self.rank < NONE]
        self.tied = len(np.unique(ranks)) < len(ranks)  # whether different pieces may come at the same turn
        self.extra = {i: c for c, i in extra.items()}
        self.by_point = np.full(0x110000, -1, np.int64)
        self.by_point[[ord(c) for c in self.symbols]] = list(self.symbols.values())
        self.spelled = [bytes([int(p[3:5], 16)]) if b else p.replace(SPACE, " ").encode() for p, b in zip(self.piece, self.is_byte, strict=True)]
        self.digits = list(map(str, range(self.n)))

    def _ranks(self, symbols: np.ndarray) -> np.ndarray:
        return np.where(symbols < self.n, self.rank[np.minimum(symbols, self.n - 1)], -1)

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that each pair makes, -1 for none."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        return np.where((self.pair[at] == key) & (left >= 0) & (right >= 0), self.made[at], -1)

    def _symbols(self, words: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(symbol of each character, its word, the piece that it makes with the next one)."""
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        sym = self.by_point[points]
        lone = sym < 0  # characters that take part in no merge: below zero, by code point
        sym[lone] = -2 - points[lone].astype(np.int64)
        word = np.repeat(np.arange(len(words)), np.fromiter(map(len, words), np.int64, len(words)))
        made = np.append(self._pairs(sym[:-1], sym[1:]), -1)
        made[:-1][word[:-1] != word[1:]] = -1
        return sym, word, made

    def _taken(self, at: np.ndarray, made: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Of the best pairs of each word (at) those merged in this round."""
        at = _every_second(at)
        once = self.single[made[at]]
        if not once.any():
            return at
        # where the next best pair may be one that the leftmost has just made, the others wait
        whose = word[at]
        heads = np.flatnonzero(np.concatenate(([True], whose[1:] != whose[:-1])))
        waits = np.repeat(np.logical_or.reduceat(once, heads), np.diff(np.append(heads, len(at))))
        first = np.zeros(len(at), bool)
        first[heads] = True
        return at[first | ~waits]

    def _joined(self, sym: np.ndarray, word: np.ndarray, made: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(symbols, words, pieces made with the next one, which symbols stay) after merging the pairs at these places."""
        sym[at] = made[at]
        keep = np.ones(len(sym), bool)
        keep[at + 1] = False
        new = np.cumsum(keep)[at] - 1
        sym, word, made = sym[keep], word[keep], made[keep]
        near = np.concatenate([new, new[new > 0] - 1])
        after = np.minimum(near + 1, len(sym) - 1)
        made[near] = np.where((word[near] == word[after]) & (after > near), self._pairs(sym[near], sym[after]), -1)
        return sym, word, made, keep

    def _by_word(self, words: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """(symbols, words) after merging: in each round the best pair of each word."""
        sym, word, made = self._symbols(words)
        done_sym, done_word = [sym[:0]], [word[:0]]
        while len(sym):
            rank = np.where(made >= 0, self.rank[made], NONE)
            starts = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            sizes = np.diff(np.append(starts, len(sym)))
            least = np.minimum.reduceat(rank, starts)
            # finished words leave the array
            live = least < NONE
            if not live.all():
                keep = np.repeat(live, sizes)
                done_sym.append(sym[~keep])
                done_word.append(word[~keep])
                sym, word, made, rank, sizes, least = sym[keep], word[keep], made[keep], rank[keep], sizes[live], least[live]
                if not len(sym):
                    break
            at = np.flatnonzero(rank == np.repeat(least, sizes))
            at = self._taken(at, made, word)
            sym, word, made, _ = self._joined(sym, word, made, at)
        sym, word = np.concatenate(done_sym), np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        return sym[order], word[order]

    def _by_window(self, words: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for long words: in each round every pair that comes before all others within a piece's reach.

        Merging goes by rank, but a pair that a merge has made waits for nothing: its turn is that of the merge, if that
        came later. So pairs are ordered by turn, then rank, then place. What could take a pair's symbols before its turn
        would be a piece over them, made of pairs within its reach that come before; where there are none, the pair's
        merge doesn't depend on the rest of the text.
        """
        sym, word, made = self._symbols(words)
        turn, place = np.full(len(sym), -1, np.int64), np.arange(len(sym))
        stretch = word.copy()
        done_sym, done_word, done_place = [], [], []
        while len(sym):
            rank = np.where(made >= 0, self.rank[made], NONE)
            after = np.append(turn[1:], -1)
            key = np.where(made >= 0, np.maximum(np.maximum(turn, after), rank) << 20 | rank, NONE)
            padded = np.concatenate([np.full(self.reach, NONE), key, np.full(self.reach, NONE)])
            left = _least(padded, self.reach)[: len(key)]  # of the pairs before, within reach
            least = np.minimum(np.minimum(left, key), _least(padded, self.reach)[self.reach + 1 : self.reach + 1 + len(key)])
            live = least < NONE
            if not live.all():  # nothing can change here any more
                done_sym.append(sym[~live])
                done_word.append(word[~live])
                done_place.append(place[~live])
                stretch = np.cumsum(np.concatenate(([True], ~live[:-1] | (stretch[1:] != stretch[:-1])))) if len(sym) else stretch
                sym, word, made, turn, place, key, least, left, stretch = (x[live] for x in (sym, word, made, turn, place, key, least, left, stretch))
                if not len(sym):
                    break
            best = key == least
            # overlapping equal pairs go by twos from the left, so all of them from the first must be best
            places = np.arange(len(key))
            first = np.maximum.accumulate(np.where(np.concatenate(([True], key[1:] != key[:-1])), places, 0))
            best &= np.maximum.accumulate(np.where(best, -1, places)) < first
            # and where what a merge makes may come before the next equal pair, that one waits
            best &= (left > key) | ~(self.single[made] | self.tied)
            at = _every_second(np.flatnonzero(best))
            if FEW * len(at) < len(sym):  # mostly one after another, as in runs of one letter
                kept = self._in_turn(sym, stretch, made, turn, key)
                done_sym.append(sym[kept])
                done_word.append(word[kept])
                done_place.append(place[kept])
                break
            turn[at] = key[at] >> 20
            sym, stretch, made, keep = self._joined(sym, stretch, made, at)
            word, turn, place = word[keep], turn[keep], place[keep]
        if not done_sym:
            return sym, word
        sym, word, place = (np.concatenate(x) for x in (done_sym, done_word, done_place))
        order = np.argsort(place)
        return sym[order], word[order]

    def _in_turn(self, sym: np.ndarray, stretch: np.ndarray, made: np.ndarray, turn: np.ndarray, key: np.ndarray) -> np.ndarray:
        """Merges what is left pair by pair, in the order of key and place; sym is changed, and the places that stay are returned."""
        n = len(sym)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        s, word, piece, when = sym.tolist(), stretch.tolist(), made.tolist(), turn.tolist()
        keys: list[int | None] = [k if p >= 0 else None for k, p in zip(key.tolist(), piece, strict=True)]
        queue = [(k, i) for i, k in enumerate(keys) if k is not None]
        heapq.heapify(queue)
        makes = self.makes
        gone = np.zeros(n, bool)

        def look(i: int) -> None:
            j = after[i]
            p = makes.get(s[i] << 32 | s[j]) if j < n and word[i] == word[j] and s[i] >= 0 and s[j] >= 0 else None
            if p is None:
                keys[i] = None
                return
            r = int(self.rank[p])
            keys[i] = max(when[i], when[j], r) << 20 | r
            piece[i] = p
            heapq.heappush(queue, (keys[i], i))

        while queue:
            k, i = heapq.heappop(queue)
            if keys[i] != k or gone[i]:
                continue
            j = after[i]
            s[i], when[i] = piece[i], k >> 20
            gone[j], keys[j] = True, None
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            look(i)
            if before[i] >= 0:
                look(before[i])
        sym[:] = s
        return ~gone

    def merge(self, words: Sequence[str]) -> tuple[list[int], list[int]]:
        """The ids of all cuts, one after another, and where each cut's ids end."""
        long = [i for i, w in enumerate(words) if len(w) > LONG]
        if not long:
            sym, word = self._by_word(words)
        elif len(long) == len(words):
            sym, word = self._by_window(words)
        else:
            short = np.array(sorted(set(range(len(words))) - set(long)), np.int64)
            a, b = self._by_word([words[i] for i in short.tolist()]), self._by_window([words[i] for i in long])
            sym, word = np.concatenate([a[0], b[0]]), np.concatenate([short[a[1]], np.array(long, np.int64)[b[1]]])
            order = np.argsort(word, kind="stable")
            sym, word = sym[order], word[order]
        raw = np.flatnonzero((sym < 0) | (sym >= self.n))
        ends = np.cumsum(np.bincount(word, minlength=len(words)))
        if len(raw):
            coded = [[self.byte[b] for b in (chr(-2 - s) if s < 0 else self.extra[s]).encode()] for s in sym[raw].tolist()]
            more = np.fromiter(map(len, coded), np.int64, len(coded)) - 1
            width = np.ones(len(sym), np.int64)
            width[raw] += more
            flat = np.repeat(sym, width)
            to = np.cumsum(width) - width
            flat[np.concatenate([np.arange(a, a + len(c)) for a, c in zip(to[raw].tolist(), coded, strict=True)])] = np.concatenate(coded)
            ends = np.concatenate(([0], np.cumsum(width)))[ends]
            sym = flat
        return sym.tolist(), ends.tolist()

    def normal(self, text: str) -> str:
        return (SPACE if self.prefix and text else "") + text.replace(" ", SPACE)

    def decode(self, ids: Sequence[int]) -> str:
        """Text of ids: pieces joined, marks to spaces, the first space dropped, bytes read as UTF-8."""
        text = b"".join(self.spelled[i] for i in ids).decode("utf-8", "replace")
        return text[1:] if self.prefix and ids and self.piece[ids[0]].startswith(SPACE) else text


class Coder:
    """Encodes texts through a cache of cuts: each has (ids as text with commas, bytes decoded from the ids)."""

    def __init__(self, path: str) -> None:
        self.model = Pieces(path)
        self.seen: dict[str, tuple[str, bytes]] = {}

    def learn(self, cuts: Sequence[str]) -> None:
        part: list[str] = []
        size = 0
        for i, w in enumerate(cuts):
            part.append(w)
            size += len(w)
            if size >= SYMBOLS or i == len(cuts) - 1:
                ids, ends = self.model.merge(part)
                digits, spelled = list(map(self.model.digits.__getitem__, ids)), list(map(self.model.spelled.__getitem__, ids))
                start = 0
                for x, end in zip(part, ends, strict=True):
                    self.seen[x] = (",".join(digits[start:end]), b"".join(spelled[start:end]))
                    start = end
                part, size = [], 0

    def encode(self, texts: Sequence[str]) -> Iterator[tuple[str, bytes]]:
        """(ids joined by commas, decoded text in UTF-8) of each text."""
        found = [self.model.cuts.findall(self.model.normal(t)) for t in texts]
        new = {w for cuts in found for w in cuts}.difference(self.seen)
        if len(self.seen) + len(new) > CACHE:
            self.seen.clear()
            new = {w for cuts in found for w in cuts}
        self.learn(list(new))
        for cuts in found:
            got = list(map(self.seen.__getitem__, cuts))
            joined = b"".join([x[1] for x in got])
            # the dummy prefix's space, if a piece with the mark came first
            yield ",".join([x[0] for x in got]), joined[1:] if cuts and self.model.prefix and joined[:1] == b" " else joined


def encode_column(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row of docs -> doc_id, ids (array<int>), decoded: the operator's real outputs. Null text: like empty, no ids."""
    return _run(docs, model, key, text, True)


def encode_digest(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row of docs -> doc_id, n_tokens, ids_sha256, decoded_sha256, from the same ids and decoded text.

    Whole texts of any length; null like empty: 0 ids. Repeated rows each get a row. Empty input: no rows. Other
    columns don't matter. The model's path is opened by every worker; it must be installed there.
    """
    return _run(docs, model, key, text, False)


def _run(docs: DataFrame, model: str, key: str, text: str, full: bool) -> DataFrame:
    ready(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = None
        for batch in batches:
            for piece in slices(batch, "text"):
                coder = coder or Coder(model)
                got = list(coder.encode([t or "" for t in piece.column("text").to_pylist()]))
                if full:
                    cols = [pa.array([list(map(int, i.split(","))) if i else [] for i, _ in got], pa.list_(pa.int32())), pa.array([d.decode("utf-8", "replace") for _, d in got], pa.string())]
                    yield pa.RecordBatch.from_arrays([piece.column("doc_id"), *cols], names=["doc_id", "ids", "decoded"])
                else:
                    cols = [pa.array([i.count(",") + 1 if i else 0 for i, _ in got], pa.int64())]
                    cols += [pa.array([hashlib.sha256(i.encode()).hexdigest() for i, _ in got]), pa.array([hashlib.sha256(d).hexdigest() for _, d in got])]
                    yield pa.RecordBatch.from_arrays([piece.column("doc_id"), *cols], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = "doc_id long, ids array<int>, decoded string" if full else "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, kind)
