"""Periodic runs of words by minimizers at several scales.

Words are stretches without ASCII white space. A run is a stretch of words with smallest period ``q`` (words ``q`` apart
are equal) and a length of at least ``max(least, 2 * q)`` that cannot be extended on either side with the same period.

* Periods below ``base`` are found by direct lag scans: the words are compared with themselves ``q`` places on.
* Periods from ``P`` to ``2 * P - 1`` (``P`` = base, 2 base, 4 base ...) come from minimizers of that scale: of every
  window of ``P`` words the hashes of its grams of ``P / 2`` words are compared, and all places with the least one are
  marked. Inside a run the first window of the repeated part has the same least gram as the window one period on, so two
  marks with the same hash stand exactly one period apart. Pairs of marks at such a distance are extended word by word;
  the extension decides, hashes only propose.
* A gram that itself repeats at a short period (``aaaa``) would be marked densely. Its marks are folded into the runs of
  that short period, known from smaller scales; between two such runs only the lags that line up their starts or ends, or
  whose overlap is a whole period long, can carry a longer period. So the work stays linear per scale for any text.

A stretch found again at a multiple of its period has the same two ends and keeps the smallest period. Two different
grams with one 64-bit hash cost an extension, nothing else.

Rows of a batch are laid side by side with a separator that equals nothing, so one numpy call serves many texts. Spark
carries the rows; there is no shuffle. A text is one row, so its words are held by one task, with memory in proportion.

Defined results: null, empty and blank texts have no words and no runs; equal rows are each reported; other columns are
ignored, whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST = 12
BASE = 32
CHUNK_WORDS = 500_000

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)

Runs = dict[tuple[int, int], int]


def _mixed(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(31))) * _A
        return h ^ (h >> np.uint64(29))


def _slid(values: np.ndarray, span: int, pick: np.ufunc) -> np.ndarray:
    """``pick`` over every ``span`` consecutive values."""
    width = 1
    while 2 * width <= span:
        values = pick(values[:-width], values[width:])
        width *= 2
    rest = span - width
    return pick(values[:-rest], values[rest:]) if rest else values


def stretch(a: np.ndarray, at: int, lag: int) -> tuple[int, int]:
    """The longest [s, e) around ``at`` in which a[i] == a[i + lag]; empty if that fails at ``at``."""
    end, step = at, 64
    while n := min(step, len(a) - lag - end):
        differs = a[end : end + n] != a[end + lag : end + lag + n]
        first = int(differs.argmax())
        if differs[first]:
            end += first
            break
        end, step = end + n, step * 4
    if end == at:
        return at, at
    start, step = at, 64
    while n := min(step, start):
        differs = a[start - n : start][::-1] != a[start - n + lag : start + lag][::-1]
        first = int(differs.argmax())
        if differs[first]:
            start -= first
            break
        start, step = start - n, step * 4
    return start, end


def scan_lag(a: np.ndarray, lag: int, least: int, runs: Runs) -> None:
    """All runs of period ``lag``: stretches of equal words that are long enough."""
    need = max(least - lag, lag)
    same = np.flatnonzero(a[:-lag] == a[lag:])
    if len(same) < need or not (same[need - 1 :] - same[: len(same) - need + 1] == need - 1).any():
        return
    cuts = np.flatnonzero(np.diff(same) != 1)
    first = same[np.concatenate(([0], cuts + 1))]
    last = same[np.concatenate((cuts, [len(same) - 1]))]
    long = last - first + 1 >= need
    for s, e in zip(first[long].tolist(), last[long].tolist(), strict=True):
        runs.setdefault((s, e + 1 + lag), lag)


def single_pairs(x: np.ndarray, scale: int) -> Iterator[tuple[int, int]]:
    """(lag, place) of marks ``scale`` to ``2 * scale - 1`` words apart; marks stand over a quarter scale apart."""
    for step in range(1, len(x)):
        gap = x[step:] - x[:-step]
        inside = (gap >= scale) & (gap < 2 * scale)
        yield from zip(gap[inside].tolist(), x[:-step][inside].tolist(), strict=True)
        if (gap >= 2 * scale).all():
            return


def folded_pairs(a: np.ndarray, x: np.ndarray, gram: int, scale: int, runs: Runs) -> Iterator[tuple[int, int]]:
    """(lag, place) between the short-period runs that hold the marks of one gram."""
    gaps = np.diff(x)
    near = int(np.argmax(gaps <= gram // 2))
    s, e = stretch(a, int(x[near]), int(gaps[near]))
    period = runs.get((s, e + int(gaps[near])), int(gaps[near]))
    inside, i = [], 0
    while i < len(x):
        at = int(x[i])
        s, e = stretch(a, at, period)
        e = max(e + period, at + gram)
        inside.append((s, e, at))
        i = max(i + 1, int(np.searchsorted(x, e - gram, "right")))
    for i, (s1, e1, x1) in enumerate(inside):
        for s2, e2, x2 in inside[i + 1 :]:
            if s2 - e1 >= 2 * scale:
                break
            lags = {e2 - e1, s2 - s1}
            if s2 <= e1:
                most = min(e1 - s1, e2 - s2, (e2 - s1) // 2)
                lags.update(range(scale + (x2 - x1 - scale) % period, most + 1, period))
            for lag in lags:
                at = max(s1, s2 - lag)
                if scale <= lag < 2 * scale and at < min(e1, e2 - lag):
                    yield lag, at


def scan_scale(a: np.ndarray, places: np.ndarray, grams: np.ndarray, doc: np.ndarray, scale: int, runs: Runs) -> None:
    """All runs with periods from ``scale`` to ``2 * scale - 1``. ``grams``: hashes of half a scale at ``places``."""
    gram = scale // 2
    least = _slid(grams, gram + 1, np.minimum)
    edge = np.zeros(gram, dtype=np.uint64)
    marked = np.flatnonzero(_slid(np.concatenate((edge, least, edge)), gram + 1, np.maximum) == grams[: len(least) + gram])
    order = marked[np.argsort(grams[marked], kind="stable")]
    x, hashes, owner = places[order], grams[order], doc[order]
    linked = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1]) & (x[1:] - x[:-1] < 2 * scale)
    if not linked.any():
        return
    turns = np.flatnonzero(np.diff(np.concatenate(([0], linked.view(np.int8), [0]))))
    found: list[tuple[int, int]] = []
    for first, last in zip(turns[::2].tolist(), turns[1::2].tolist(), strict=True):
        group = x[first : last + 1]
        if group[-1] - group[0] < scale:
            continue
        dense = (np.diff(group) <= gram // 2).any()
        found += folded_pairs(a, group, gram, scale, runs) if dense else single_pairs(group, scale)
    before, end = 0, -1
    for lag, at in sorted(found):
        if lag == before and at < end:
            continue
        s, end = stretch(a, at, lag)
        before = lag
        if end - s >= lag:
            runs.setdefault((s, end + lag), lag)


def runs_of(texts: list[np.ndarray], least: int = LEAST, base: int = BASE) -> list[list[tuple[int, int, int]]]:
    """Per sequence of word numbers its runs as (start, length, period), by start, then period.

    ``base`` is a power of two; half of it and one are at least ``least``, so that short-period runs are known in time.
    """
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    a = np.concatenate([part for k, t in enumerate(texts) for part in (t, [-k - 1])]) if texts else np.zeros(0, dtype=np.int64)
    starts = np.cumsum(sizes + 1) - sizes - 1
    longest = int(sizes.max(initial=0))
    runs: Runs = {}
    for lag in range(1, min(base - 1, longest // 2) + 1):
        scan_lag(a, lag, least, runs)
    places, doc = np.arange(len(a)), np.repeat(np.arange(len(sizes)), sizes + 1)
    grams, gram, scale = _mixed(a.astype(np.uint64) + _B), 1, base
    while 2 * scale <= longest:
        while gram < scale // 2:
            with np.errstate(over="ignore"):
                doubled = _mixed(grams[:-gram] * _B + grams[gram:])
            grams, gram = np.concatenate((doubled, np.zeros(gram, dtype=np.uint64))), 2 * gram
        long = sizes[doc] >= 2 * scale
        places, doc, grams = places[long], doc[long], grams[long]
        scan_scale(a, places, grams, doc, scale, runs)
        scale *= 2
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    ordered = sorted((s, q, e) for (s, e), q in runs.items())
    owners = np.searchsorted(starts, [s for s, _, _ in ordered], "right") - 1
    for k, (s, q, e) in zip(owners.tolist(), ordered, strict=True):
        out[k].append((s - int(starts[k]), e - s, q))
    return out


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words left when every run keeps its first period only, joined by one space."""
    if not runs:
        return b" ".join(words)
    change = np.zeros(len(words) + 1, dtype=np.int64)
    for s, n, q in runs:
        change[s + q] += 1
        change[s + n] -= 1
    kept = np.flatnonzero(np.cumsum(change[:-1]) == 0)
    return b" ".join([words[i] for i in kept])


def chunks(texts: list[bytes | None]) -> Iterator[list[list[bytes]]]:
    """Words of consecutive texts, about ``CHUNK_WORDS`` at a time."""
    held, n = [], 0
    for t in texts:
        held.append(t.split() if t else [])
        n += len(held[-1])
        if n >= CHUNK_WORDS:
            yield held
            held, n = [], 0
    if held:
        yield held


def find_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST, base: int = BASE) -> DataFrame:
    """Per row: ``key``, n_words, runs (array of start, length, period in words), collapsed (text without the repeats)."""
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("binary").alias("text"))
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = 0
            for words in chunks(b.column("text").to_pylist()):
                number = defaultdict(count().__next__)
                found = runs_of([np.fromiter(map(number.__getitem__, w), dtype=np.int64, count=len(w)) for w in words], least, base)
                structs = [[dict(zip(("start", "length", "period"), r, strict=True)) for r in f] for f in found]
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column("key").slice(at, len(words)),
                        pa.array([len(w) for w in words], pa.int64()),
                        pa.array(structs, pa.list_(run)),
                        pa.array([collapsed(w, f).decode("utf-8", "replace") for w, f in zip(words, found, strict=True)], pa.string()),
                    ],
                    ["key", "n_words", "runs", "collapsed"],
                )
                at += len(words)

    kind = rows.schema["key"].dataType.simpleString()
    out = rows.mapInArrow(scan, f"key {kind}, n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string")
    return out.withColumnRenamed("key", key)


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """The longest run (ties: first start, then period) and hashes of all runs and of the collapsed text."""
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"], -r["start"], -r["period"], r["start"], r["period"])))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    named = found.withColumns({"_top": longest, "_lines": F.concat_ws("", F.transform(lines, lambda x: F.concat(x, F.lit("\n"))))})
    top = F.col("_top")
    return named.select(
        key,
        F.size("runs").cast("bigint").alias("n_runs"),
        top["start"].alias("start"),
        top["length"].alias("length"),
        top["period"].alias("period"),
        F.floor(1000 * top["length"] / top["period"]).cast("bigint").alias("exponent_milli"),
        F.sha2("_lines", 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
