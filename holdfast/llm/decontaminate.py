"""Benchmark decontamination by a broadcast hash set of normalised n-grams.

Words are runs of ASCII letters, digits and non-ASCII characters, with A-Z in lower case. Every ten consecutive words
of an item are a window; an item with fewer words (but not none) is one window. Document words that lie inside an
occurrence of any window are hit. Hash matches are candidates only: each is compared word by word before it counts.

The hash set goes to the executors in blocks of at most ``block_words`` item words, so what is sent at once has a fixed
bound however large the benchmark is. One block (the usual case) needs no shuffle; with more, each block scans the
documents and the hit positions are united per row.

Defined results: null or word-less texts have no words and no hits; an empty benchmark hits nothing; null item ids or
texts are no items; repeated items and repeated documents are each reported (an item id counts once per document).
Extra columns are ignored (:func:`find_hits`) or kept as they are (:func:`remove_contaminated`).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.llm.names import free_name
from holdfast.plans.storage import stored

WINDOW = 10
BLOCK_WORDS = 2_000_000
CHUNK_WORDS = 1_000_000

_KEEP = b"0123456789abcdefghijklmnopqrstuvwxyz" + bytes(range(128, 256))
_NORMAL = bytes(b if (b := bytes([i]).lower()[0]) in _KEEP else 32 for i in range(256))
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_NORMAL).split() if text else []


def rolling(ids: np.ndarray, n: int) -> np.ndarray:
    """A polynomial hash of every ``n`` consecutive ids."""
    out = np.zeros(len(ids) - n + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            out = out * _FACTOR + ids[k : k + len(out)]
        out ^= out >> np.uint64(29)
    return out


class Index:
    """The windows of one block of items: word ids, and per window length the sorted hashes with their items."""

    def __init__(self, items: list[tuple], window: int):
        self.ids: dict[bytes, int] = {}
        self.item_ids = [str(i) for i, _ in items]
        found: dict[int, list[tuple[np.ndarray, np.ndarray, int]]] = {}
        for at, (_, text) in enumerate(items):
            own = words(text)
            if not own:
                continue
            ids = np.array([self.ids.setdefault(w, len(self.ids) + 1) for w in own], dtype=np.uint64)
            n = min(window, len(ids))
            found.setdefault(n, []).append((rolling(ids, n), np.lib.stride_tricks.sliding_window_view(ids, n).astype(np.uint32), at))
        self.by_length = {}
        for n, parts in found.items():
            hashes = np.concatenate([p[0] for p in parts])
            grams = np.concatenate([p[1] for p in parts])
            owner = np.concatenate([np.full(len(p[0]), p[2], dtype=np.int64) for p in parts])
            order = np.argsort(hashes, kind="stable")
            self.by_length[n] = (hashes[order], grams[order], owner[order])

    def search(self, ids: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, set[tuple[int, int]]]:
        """Which words are hit, and the (document, item) pairs; a zero id (not a benchmark word) ends any window."""
        hit, pairs = np.zeros(len(ids) + 1, dtype=np.int32), set()
        known = np.concatenate(([0], np.cumsum(ids != 0)))
        for n, (hashes, grams, owner) in self.by_length.items():
            if len(ids) < n:
                continue
            at = np.nonzero((known[n:] - known[:-n] == n) & (doc[: len(doc) - n + 1] == doc[n - 1 :]))[0]
            if not len(at):
                continue
            with np.errstate(over="ignore"):
                own = np.zeros(len(at), dtype=np.uint64)
                for k in range(n):
                    own = own * _FACTOR + ids[at + k]
                own ^= own >> np.uint64(29)
            lo, hi = np.searchsorted(hashes, own, "left"), np.searchsorted(hashes, own, "right")
            for a, i, j in zip(at[hi > lo], lo[hi > lo], hi[hi > lo], strict=True):
                same = np.nonzero((grams[i:j] == ids[a : a + n]).all(axis=1))[0]
                if len(same):
                    hit[a] += 1
                    hit[a + n] -= 1
                    pairs.update((int(doc[a]), int(owner[i + s])) for s in same)
        return np.cumsum(hit[:-1]) > 0, pairs

    def scan(self, texts: list[str | None]) -> Iterator[tuple[int, np.ndarray, list[str]]]:
        """Per text: number of words, positions of hit words, ids of the items found."""
        get, start = self.ids.get, 0
        while start < len(texts):
            ids, sizes, total = [], [], 0
            while start + len(sizes) < len(texts) and (not sizes or total < CHUNK_WORDS):
                own = words(texts[start + len(sizes)])
                ids += [get(w, 0) for w in own]
                sizes.append(len(own))
                total += len(own)
            sizes = np.array(sizes)
            doc = np.repeat(np.arange(len(sizes)), sizes)
            hit, pairs = self.search(np.array(ids, dtype=np.uint64), doc)
            ends = np.cumsum(sizes)
            items: dict[int, set[str]] = {}
            for d, i in pairs:
                items.setdefault(d, set()).add(self.item_ids[i])
            positions = np.nonzero(hit)[0]
            cuts = np.searchsorted(positions, np.concatenate(([0], ends)))
            for d, (n, end) in enumerate(zip(sizes, ends, strict=True)):
                yield int(n), positions[cuts[d] : cuts[d + 1]] - (end - n), sorted(items.get(d, ()))
            start += len(sizes)


_INDEXES: dict[str, Index] = {}


def index_of(key: str, items: list[tuple], window: int) -> Index:
    """The index of a block, built once in each Python worker; only the last one is kept."""
    if key not in _INDEXES:
        _INDEXES.clear()
        _INDEXES[key] = Index(items, window)
    return _INDEXES[key]


def blocks_of(benchmark: DataFrame, block_words: int) -> tuple[DataFrame, int]:
    """The items, and the number of blocks such that a block has about ``block_words`` words at most."""
    items = benchmark.select("item_id", "text").where("item_id is not null and text is not null")
    n = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return items, max(1, -(-n // (2 * block_words)))


def scanned(rows: DataFrame, key: str, items: DataFrame, block: int, blocks: int, window: int) -> DataFrame:
    """``key`` with what one block of items hits in the text beside it."""
    part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
    shared = rows.sparkSession.sparkContext.broadcast([tuple(r) for r in part.distinct().toLocalIterator()])
    kind = rows.schema[key].dataType.simpleString()
    name = uuid.uuid4().hex

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = index_of(name, shared.value, window)
        for b in batches:
            found = list(index.scan(b.column("text").to_pylist()))
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(key),
                    pa.array([f[0] for f in found], pa.int64()),
                    pa.array([f[1] for f in found], pa.list_(pa.int32())),
                    pa.array([f[2] for f in found], pa.list_(pa.string())),
                ],
                [key, "n_words", "hit_words", "items"],
            )

    return rows.select(key, "text").mapInArrow(scan, f"`{key}` {kind}, n_words bigint, hit_words array<int>, items array<string>")


def united(rows: DataFrame, key: str, items: DataFrame, blocks: int, window: int) -> DataFrame:
    """The hits of all blocks of items per ``key``, which numbers the rows."""
    parts = [scanned(rows, key, items, b, blocks, window) for b in range(blocks)]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionAll(p)
    return union.groupBy(key).agg(
        F.max("n_words").alias("n_words"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("hit_words")))).alias("hit_words"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )


def find_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Per document row: doc_id, n_words, hit_words (array of word positions), items (sorted item ids as strings)."""
    items, blocks = blocks_of(benchmark, block_words)
    if blocks == 1:
        return scanned(docs.select("doc_id", "text"), "doc_id", items, 0, 1, window)
    rows = stored(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"), "decontaminate")
    return rows.select("row", "doc_id").join(united(rows, "row", items, blocks, window), "row").drop("row")


def digest(hits: DataFrame) -> DataFrame:
    return hits.select(
        "doc_id",
        "n_words",
        F.size("hit_words").cast("bigint").alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("hit_words") > 0).alias("contaminated"),
    )


def remove_spans(text: str, hit_words: list[int]) -> str:
    """``text`` without its hit words; what stands between two neighbouring hit words goes with them."""
    data, hit = text.encode("utf-8", "surrogatepass"), set(hit_words)
    normal = data.translate(_NORMAL)
    out, at, pos, last = [], 0, 0, -2
    for k, w in enumerate(normal.split()):
        begin = normal.index(w, pos)
        pos = begin + len(w)
        if k in hit:
            if last != k - 1:
                out.append(data[at:begin])
            at, last = pos, k
    return (b"".join(out) + data[at:]).decode("utf-8", "surrogatepass")


def remove_contaminated(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_share: float = 0.0, block_words: int = BLOCK_WORDS
) -> DataFrame:
    """``docs`` with its own columns: documents with a hit share over ``max_share`` go, of the others the hit spans go.

    The default removes every document with a hit. With one block of items (the usual case) the scan carries the rows
    along, without a join. With more, the hits of all blocks are united first, and each document is judged once on them.
    """
    items, blocks = blocks_of(benchmark, block_words)

    def cleaned(b: pa.RecordBatch, found: list[tuple[int, list[int]]]) -> pa.RecordBatch:
        keep = [len(h) <= max_share * n for n, h in found]
        texts = [remove_spans(t, h) if k and len(h) else t for t, k, (_, h) in zip(b.column("text").to_pylist(), keep, found, strict=True)]
        at = b.schema.get_field_index("text")
        return b.set_column(at, b.schema.field(at), pa.array(texts, b.schema.field(at).type)).filter(pa.array(keep, pa.bool_()))

    if blocks == 1:
        shared = docs.sparkSession.sparkContext.broadcast([tuple(r) for r in items.distinct().toLocalIterator()])
        name = uuid.uuid4().hex

        def scan_and_clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = index_of(name, shared.value, window)
            for b in batches:
                yield cleaned(b, [(n, h.tolist()) for n, h, _ in index.scan(b.column("text").to_pylist())])

        return docs.mapInArrow(scan_and_clean, docs.schema)

    names = docs.columns
    row, n_words, hit_words = (free_name(docs, c) for c in ("_row", "_n_words", "_hit_words"))
    rows = stored(docs.withColumn(row, F.monotonically_increasing_id()), "decontaminate")
    hits = united(rows, row, items, blocks, window).select(row, F.col("n_words").alias(n_words), F.col("hit_words").alias(hit_words))

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = list(zip(b.column(n_words).to_pylist(), b.column(hit_words).to_pylist(), strict=True))
            yield cleaned(b, found).select(names)

    return rows.join(hits, row).mapInArrow(clean, docs.schema)
