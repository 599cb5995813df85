"""Best-fit packing of token sequences by minimum bin slack.

Pieces (documents, cut only if longer than a sequence) are tokenised and counted by length in executors. Only the
histogram of lengths, at most ``capacity`` rows, comes to the driver. There each bin takes the longest length left and,
by a bitset subset-sum program over the lengths still available, the combination that fills the bin fullest; that
combination is removed. It stays the fullest as long as its lengths last, so it is taken as many times as they allow in
one step: the plan depends on the number of different lengths, not on the number of documents. In executors, the rank
of a piece among the pieces of its length then decides its sequence and place by arithmetic.

Ranks need no global sort: a task numbers its own pieces of each length, and the numbers of earlier tasks are added
from one row per (task, length).

Defined results: a null text is empty and still a piece (its end mark); repeated rows are packed each on its own; an
empty table gives no rows; extra columns are ignored; ties of length take any order.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from holdfast.plans.storage import stored

CAPACITY = 4096
END_ID = 1
CACHE_WORDS = 800_000


class WordIds:
    """Ids of white-space separated chunks, kept for the chunks seen so far (bounded); the tokenizer sees the others.

    Holds for tokenizers that drop white space and never look across it.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.ids = Tokenizer.from_file(path), {}

    def encode(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype="<u4").tobytes() for e in found]

    def of(self, texts: list[str | None]) -> Iterator[bytes]:
        split = [t.replace("\n", " ").replace("\t", " ").split(" ") if t else [] for t in texts]
        new = list({w for s in split for w in s}.difference(self.ids))
        fresh = dict(zip(new, self.encode(new), strict=True))
        known = self.ids
        if len(known) + len(fresh) <= CACHE_WORDS:
            known.update(fresh)
            fresh = {}
        for s in split:
            yield b"".join([known[w] if w in known else fresh[w] for w in s] if fresh else [known[w] for w in s])


_VOCABULARIES: dict[str, WordIds] = {}


def vocabulary_of(path: str) -> WordIds:
    """Loaded once in each Python worker."""
    if path not in _VOCABULARIES:
        _VOCABULARIES[path] = WordIds(path)
    return _VOCABULARIES[path]


def cut(docs: DataFrame, path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Pieces: doc_id, piece, start, length, ids_crc32, and (task, k), k counting the pieces of a length in a task."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "k"] + ["ids"] * with_ids

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, task, seen = vocabulary_of(path), TaskContext.get().partitionId(), {}
        mark = np.array([END_ID], dtype="<u4").tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                b = batch.slice(at, 256)
                out = []
                for d, ids in enumerate(vocabulary.of(b.column("text").to_pylist())):
                    ids += mark
                    for piece, start in enumerate(range(0, len(ids) // 4, capacity)):
                        own = ids[4 * start : 4 * (start + capacity)]
                        n = len(own) // 4
                        k = seen[n] = seen.get(n, -1) + 1
                        out.append((d, piece, start, n, zlib.crc32(own), task, k) + ((np.frombuffer(own, "<u4"),) if with_ids else ()))
                columns = list(zip(*out, strict=True))
                arrays = [b.column("doc_id").take(pa.array(columns[0]))] + [pa.array(c, t) for c, t in zip(columns[1:7], (pa.int32(), *[pa.int64()] * 5), strict=True)]
                if with_ids:
                    arrays.append(pa.array(columns[7], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(arrays, names)

    schema = f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, task bigint, k bigint"
    return docs.select("doc_id", "text").mapInArrow(pieces, schema + ", ids array<int>" * with_ids)


def fullest(available: dict[int, int], room: int) -> list[int]:
    """Lengths (with repeats) that fill ``room`` as far as can be, each at most as often as available; long ones first."""
    steps, reach, mask, goal = [], 1, (1 << (room + 1)) - 1, 1 << room
    for n in sorted((n for n in available if n <= room), reverse=True):
        left, take = min(available[n], room // n), 1
        while left and not reach & goal:
            m = min(take, left)
            steps.append((n, m, reach))
            reach |= (reach << (n * m)) & mask
            left -= m
            take *= 2
        if reach & goal:
            break
    at, chosen = reach.bit_length() - 1, []
    for n, m, before in reversed(steps):
        if not before >> at & 1:
            chosen += [n] * m
            at -= n * m
    return chosen


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """Combinations of lengths, each with the number of sequences that hold it."""
    left, out = {n: c for n, c in histogram.items() if c > 0}, []
    for longest in sorted(left, reverse=True):
        while left.get(longest):
            left[longest] -= 1
            combination = {longest: 1}
            for n in fullest({n: c for n, c in left.items() if c}, capacity - longest):
                combination[n] = combination.get(n, 0) + 1
            left[longest] += 1
            times = min(left[n] // uses for n, uses in combination.items())
            for n, uses in combination.items():
                left[n] -= uses * times
                if not left[n]:
                    del left[n]
            out.append((combination, times))
    return out


def slots(combinations: list[tuple[dict[int, int], int]]) -> dict[int, np.ndarray]:
    """Per length, rows of (first rank, uses per sequence, first sequence, offset in the sequence) in rank order."""
    rows: dict[int, list] = {}
    ranks: dict[int, int] = {}
    sequence = 0
    for combination, times in combinations:
        offset = 0
        for n, uses in combination.items():
            rank = ranks.get(n, 0)
            rows.setdefault(n, []).append((rank, uses, sequence, offset))
            ranks[n] = rank + uses * times
            offset += n * uses
        sequence += times
    return {n: np.array(r, dtype=np.int64) for n, r in rows.items()}


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Pieces with sequence_id and offset. ``pieces`` must be a stored table: it is read more than once."""
    counts = pieces.groupBy("task", "length").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("task", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    shared = pieces.sparkSession.sparkContext.broadcast(slots(plan(histogram, capacity)))
    columns = [c for c in pieces.columns if c not in ("task", "k")]
    ranked = pieces.join(before, ["task", "length"]).select(*columns, (F.col("before") + F.col("k")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = (b.column(c).to_numpy() for c in ("length", "rank"))
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for n in np.unique(length):
                own, table = length == n, shared.value[n]
                t = table[np.searchsorted(table[:, 0], rank[own], "right") - 1]
                nth = rank[own] - t[:, 0]
                sequence[own] = t[:, 2] + nth // t[:, 1]
                offset[own] = t[:, 3] + nth % t[:, 1] * n
            yield pa.RecordBatch.from_arrays([b.column(c) for c in columns] + [pa.array(sequence), pa.array(offset)], [*columns, "sequence_id", "offset"])

    kinds = ", ".join(f"{c} {pieces.schema[c].dataType.simpleString()}" for c in columns)
    return ranked.mapInArrow(place, f"{kinds}, sequence_id bigint, offset bigint")


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Every piece of every document with its sequence and place; ``with_ids`` adds the token ids themselves."""
    return pack(stored(cut(docs, path, capacity, with_ids), "pieces"), capacity)
