"""A failed run's log against a successful one: how far they go together, and what should have come next."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Sequence
from datetime import datetime

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph.functions.workers import ready
from tidegraph.operators.logs import HOSTS, LEADING_TIME, MARKER, NOISE, PATHS, _hosts

# fixed values: words of lines that begin and end a step
BEGINS = r"\b(start(?:ing)?|begin(?:ning)?|running|executing|launching|initiating)\b"
ENDS = r"\b(end(?:ed)?|finish(?:ed)?|complete(?:d)?|done|exit(?:ed)?)\b"

_NOISE = re.compile(NOISE + _hosts((*HOSTS, "desy.de")) + PATHS, re.IGNORECASE)
_MARKER, _TIME = re.compile(MARKER), re.compile(LEADING_TIME)
_BEGINS, _ENDS = re.compile(BEGINS, re.IGNORECASE), re.compile(ENDS, re.IGNORECASE)


class Folded:
    """A log whose neighbouring lines alike after normalising are one entry, with where each entry's text and each section stands."""

    def __init__(self, lines: Sequence[str]) -> None:
        self.lines = lines
        self.norm = [_NOISE.sub("", x).strip() for x in lines]
        self.text: list[str] = []
        self.end: list[int] = []  # the line after each entry
        self.places: dict[str, list[int]] = defaultdict(list)
        self.sections: list[tuple[int, str]] = []
        self.section_places: dict[str, list[int]] = defaultdict(list)
        for n, (line, norm) in enumerate(zip(lines, self.norm, strict=True)):
            if not self.text or self.text[-1] != norm:
                self.places[norm].append(len(self.text))
                self.text.append(norm)
                self.end.append(n)
            self.end[-1] = n + 1
            if m := _MARKER.match(line):
                at = len(self.text) - 1
                self.sections.append((at, m[1].strip()))
                self.section_places[m[1].strip()].append(at)

    def ahead(self, text: str, at: int, window: int) -> int | None:
        """The next entry of this text within the window after `at`."""
        places = self.places.get(text, ())
        k = bisect_right(places, at)
        return places[k] if k < len(places) and places[k] <= at + window else None

    def section(self, at: int) -> tuple[int, str] | None:
        """The first section marker from `at` on."""
        k = bisect_left(self.sections, (at, ""))
        return self.sections[k] if k < len(self.sections) else None

    def section_called(self, name: str, at: int) -> int | None:
        places = self.section_places.get(name, ())
        k = bisect_left(places, at)
        return places[k] if k < len(places) else None


def common_section(a: Folded, b: Folded, i: int, j: int) -> tuple[int, int] | None:
    """Where both logs meet again at a section: the next of each, or one's next that comes later in the other."""
    x, y = a.section(i), b.section(j)
    if x and y and x[1] == y[1]:
        return x[0], y[0]
    if y and (k := a.section_called(y[1], i)) is not None:
        return k, y[0]
    if x and (k := b.section_called(x[1], j)) is not None:
        return x[0], k
    return None


def align(a: Folded, b: Folded, window: int = 30, patience: int = 20) -> tuple[int, int]:
    """How many entries of each log go together from the start.

    Equal entries advance together. Else the nearer of the two next matches within the window is taken (the second log's on
    a tie), else a common section, else one entry of each is passed over; after `patience` of those in a row the logs
    have parted where that row began.
    """
    i = j = passed = 0
    while i < len(a.text) and j < len(b.text) and passed < patience:
        if a.text[i] == b.text[j]:
            i, j, passed = i + 1, j + 1, 0
            continue
        to_j, to_i = b.ahead(a.text[i], j, window), a.ahead(b.text[j], i, window)
        if to_j is not None and (to_i is None or to_j - j <= to_i - i):
            j, passed = to_j, 0
        elif to_i is not None:
            i, passed = to_i, 0
        elif (met := common_section(a, b, i, j)) and met != (i, j):
            (i, j), passed = met, 0
        else:
            i, j, passed = i + 1, j + 1, passed + 1
    return (i - passed, j - passed) if passed >= patience else (i, j)


def tail_place(a: Folded, b: Folded, size: int = 30, share: float = 0.8) -> int | None:
    """The first line of b where its last `size` lines are mostly a's last ones; null where a's end isn't in b.

    Lines are numbered by their text, and all windows of b that end like a are compared at once.
    """
    if min(len(a.norm), len(b.norm)) < size:
        return None
    numbers: dict[str, int] = {}
    tail, every = (np.array([numbers.setdefault(x, len(numbers)) for x in lines]) for lines in (a.norm[-size:], b.norm))
    ends = np.flatnonzero(every[size - 1 :] == tail[-1])
    alike = (np.lib.stride_tricks.sliding_window_view(every, size)[ends] == tail).sum(axis=1) >= share * size
    return int(ends[alike][0]) + size - 1 if alike.any() else None


def _time(line: str) -> datetime | None:
    m = _TIME.search(line)
    try:
        return datetime.fromisoformat(m[1].replace("T", " ")) if m else None
    except ValueError:
        return None


def _span(start: datetime | None, end: datetime | None) -> str | None:
    seconds = int((end - start).total_seconds()) if start and end else -1
    if seconds < 0:
        return None
    minutes, rest = divmod(seconds, 60)
    return f"{seconds}s" if seconds < 60 else f"{minutes}m{rest}s" if minutes < 60 else f"{minutes // 60}h{minutes % 60}m"


def _short(lines: Sequence[str], limit: int) -> str:
    return "\n".join(x if len(x) <= limit else f"{x[:limit]} ...[{len(x) - limit:,} chars omitted]" for x in lines)


def compare(failed: str | None, good: str | None, tail: int = 50, following: int = 150, limit: int = 2000) -> dict:
    """What a failed run's log lacks of a successful one's; fields in the order of their use."""
    a, b = Folded((failed or "").splitlines()), Folded((good or "").splitlines())
    i, j = align(a, b) if a.lines and b.lines else (0, 0)
    i, j = a.end[i - 1] if i else 0, b.end[j - 1] if j else 0
    anchor = tail_place(a, b)
    go_on = j if anchor is None else anchor + 1
    cut = go_on < len(b.lines) if anchor is not None else bool(a.lines) and i >= len(a.lines) and j < len(b.lines)
    last = lambda f, to: next((k for k in range(to - 1, max(0, to - 30) - 1, -1) if _BEGINS.search(f.lines[k])), None)
    step = start = None
    search = j
    if (k := last(a, i)) is not None:
        step = a.lines[k].strip()
        start = next((t for n in range(j - 1, max(0, j - 30) - 1, -1) if _BEGINS.search(b.lines[n]) and (t := _time(b.lines[n]))), None)
    elif cut:
        k = next((k for k in range(j, min(len(b.lines), j + 10)) if _BEGINS.search(b.lines[k])), None)
        if k is not None:
            step, start, search = b.lines[k].strip(), _time(b.lines[k]), j + 1
    ends = (_span(start, _time(x)) for x in b.lines[search : j + following] if _ENDS.search(x))
    return {
        "truncated": cut,
        "step": step,
        "step_duration": next((x for x in ends if x), None) if step and start else None,
        "next_lines": _short(b.lines[go_on : go_on + following], limit),
        "failed_tail": _short(a.lines[-tail:], limit),
        "aligned_failed": i,
        "aligned_successful": j,
        "failed_lines": len(a.lines),
        "successful_lines": len(b.lines),
    }


RESULT = "truncated boolean, step string, step_duration string, next_lines string, failed_tail string, aligned_failed int, aligned_successful int, failed_lines int, successful_lines int"


def compare_logs(pairs: DataFrame, key: str = "pair_id") -> DataFrame:
    """pairs (key, failed, successful: whole logs) -> key and what compare finds; each pair is on its own."""
    ready(pairs.sparkSession)

    def run(failed: pd.Series, good: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([compare(f, g) for f, g in zip(failed, good, strict=True)])

    told = F.pandas_udf(run, RESULT)
    return pairs.select(key, told("failed", "successful").alias("r")).select(key, "r.*")


def job_log_pairs(jobs: DataFrame, logs: DataFrame, reference: DataFrame) -> DataFrame:
    """Per task the first failed job's log and the first finished job's of its reference task (task_id, reference_id), with which of them is missing."""
    first = lambda status: jobs.filter(F.col("status").isin(*status)).groupBy("task_id").agg(F.min("job_id").alias("job_id"))
    text = lambda df, name: df.join(logs.select("job_id", F.col("text").alias(name)), "job_id", "left")
    bad = text(first(("failed", "closed", "cancelled")), "failed").select("task_id", "failed")
    good = text(first(("finished",)), "successful").select(F.col("task_id").alias("reference_id"), "successful")
    error = F.when(F.col("failed").isNull(), "no failed job's log").when(F.col("successful").isNull(), "no finished job's log in the reference task")
    return reference.join(bad, "task_id", "left").join(good, "reference_id", "left").select(F.col("task_id").alias("pair_id"), "failed", "successful", error.alias("error"))
