"""Ranked lexical search by scanning the documents with an automaton of all item terms.

Terms are stretches of ASCII letters, digits and non-ASCII characters, with A-Z in lower case. All terms of the items go
into one Aho-Corasick automaton, each between two blanks; a document, with every other ASCII character turned into a
blank, runs through it once. So a term is only found between its own borders, and the counts come straight from the
text. What the scan finds (numbers of item terms and their counts per document) is written once; document frequencies,
the collection's totals and the scores are read from there, over all documents.

Scores are integers: w * ((10^9 tf) div (1000 tf + 12 m)) over the item's terms, repeats included, with
w = floor(1000 ln((2 N + 2) / (2 df + 1))) and m = 75 + ((25 n N) div L). N documents have a term, L terms in all, n in
the document. A task scores its documents in pieces against all items of a block, keeping the best ``top`` per item;
ranks come from those, in two steps, so no task sees more than ``top`` rows of an item from each task before it.

The automaton goes to the executors in blocks of items of about ``block_bytes`` of text; further blocks scan again.

Defined results: null and term-less texts are no documents; items without terms, with a null id or a null text have no
rows; texts of one item id count as one item, equal rows of an item once; every document row ranks for itself, equal
scores by ascending id, null ids last; other columns are ignored; an empty table on either side gives an empty table.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from holdfast.plans.storage import stored

TOP = 20
BLOCK_BYTES = 8_000_000
CELLS = 2_000_000
SPREAD = 64

_TERM = b"0123456789abcdefghijklmnopqrstuvwxyz" + bytes(range(128, 256))
_BLANKED = bytes(b if (b := bytes([i]).lower()[0]) in _TERM else 32 for i in range(256))
_NO_ID = np.iinfo(np.int64).max


def blanked(text: bytes | None) -> bytes:
    return text.translate(_BLANKED) if text else b""


def terms_of(text: str | None) -> list[str]:
    return blanked(text.encode()).decode().split(" ") if text else []


class Block:
    """The items of one block: their terms, numbered, and which item holds a term how often."""

    def __init__(self, items: list[tuple]):
        bags: dict = {}
        for key, text in items:
            bags.setdefault(key, Counter()).update(t for t in terms_of(text) if t)
        self.items = [k for k, bag in bags.items() if bag]
        self.terms = sorted({t for bag in bags.values() for t in bag})
        number = {t: i for i, t in enumerate(self.terms)}
        held = [(number[t], at, times) for at, k in enumerate(self.items) for t, times in bags[k].items()]
        held = np.array(sorted(held), dtype=np.int64).reshape(-1, 3)
        self.holder, self.times = held[:, 1], held[:, 2]
        self.first = np.searchsorted(held[:, 0], np.arange(len(self.terms) + 1))


_AUTOMATA: dict[str, object] = {}


def automaton_of(name: str, terms: list[str]):
    """Built once in each Python worker; only the last one is kept."""
    import ahocorasick

    if name not in _AUTOMATA:
        built = ahocorasick.Automaton()
        for i, term in enumerate(terms):
            built.add_word(f" {term} ", i)
        built.make_automaton()
        _AUTOMATA.clear()
        _AUTOMATA[name] = built
    return _AUTOMATA[name]


def scan(docs: DataFrame, terms: list[str], key: str, text: str) -> DataFrame:
    """Per document with a term: id, n (its terms), term (numbers of the item terms in it), tf (their counts)."""
    shared, name = docs.sparkSession.sparkContext.broadcast(terms), uuid.uuid4().hex

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = automaton_of(name, shared.value)
        for b in batches:
            ids, sizes, found, counts = [], [], [], []
            for doc, raw in zip(b.column("id").to_pylist(), b.column("text").to_pylist(), strict=True):
                plain = blanked(raw)
                if n := len(plain.split()):
                    hits = np.fromiter((i for _, i in automaton.iter(f" {plain.decode()} ")), dtype=np.int32)
                    which, often = np.unique(hits, return_counts=True)
                    ids.append(doc)
                    sizes.append(n)
                    found.append(which)
                    counts.append(often.astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(found, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int64()))],
                ["id", "n", "term", "tf"],
            )

    rows = docs.select(F.col(key).cast("bigint").alias("id"), F.col(text).cast("binary").alias("text")).where("text is not null")
    return rows.mapInArrow(count, "id bigint, n bigint, term array<int>, tf array<bigint>")


def document_frequencies(found: DataFrame, terms: int) -> np.ndarray:
    """How many documents hold each term: summed in the tasks, then over them."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(terms, dtype=np.int64)
        for b in batches:
            total += np.bincount(b.column("term").flatten().to_numpy(), minlength=terms)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], ["term", "df"])

    df = np.zeros(terms, dtype=np.int64)
    for term, n in found.select("term").mapInArrow(tally, "term bigint, df bigint").groupBy("term").agg(F.sum("df")).collect():
        df[term] = n
    return df


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


class Best:
    """The best ``top`` documents of each item so far."""

    def __init__(self, items: int, top: int):
        self.top, self.floor = top, np.ones(items, dtype=np.int64)
        self.item = self.score = self.doc = np.zeros(0, dtype=np.int64)

    def add(self, scores: np.ndarray, docs: np.ndarray) -> None:
        """``scores``: a row for each document, a column for each item."""
        if len(docs) > self.top:
            self.floor = np.maximum(self.floor, np.partition(scores, len(docs) - self.top, axis=0)[len(docs) - self.top])
        row, column = np.nonzero(scores >= self.floor)
        item = np.concatenate((self.item, column))
        score = np.concatenate((self.score, scores[row, column]))
        doc = np.concatenate((self.doc, docs[row]))
        order = np.lexsort((doc, -score, item))
        item, score, doc = item[order], score[order], doc[order]
        place = np.arange(len(item)) - np.searchsorted(item, item)
        kept = place < self.top
        self.item, self.score, self.doc = item[kept], score[kept], doc[kept]
        full = np.flatnonzero(place == self.top - 1)
        self.floor[item[full]] = score[full]


def best_of_tasks(found: DataFrame, block: Block, weights: np.ndarray, documents: int, terms: int, top: int) -> DataFrame:
    """Rows (item, score, id): the best documents of each item in each task."""
    shared = found.sparkSession.sparkContext.broadcast((len(block.items), block.holder, block.times, block.first, weights))

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, holder, times, first, w = shared.value
        best, piece = Best(items, top), max(1, CELLS // items)
        for b in batches:
            for start in range(0, b.num_rows, piece):
                part = b.slice(start, piece)
                lengths = part.column("term").value_lengths().to_numpy()
                term, tf = part.column("term").flatten().to_numpy(), part.column("tf").flatten().to_numpy()
                m = 75 + 25 * part.column("n").to_numpy() * documents // terms
                row = np.repeat(np.arange(part.num_rows), lengths)
                value = w[term] * (1_000_000_000 * tf // (1000 * tf + 12 * m[row]))
                scores = np.zeros(part.num_rows * items, dtype=np.int64)
                step = max(1, CELLS // items)  # a term may be in every item
                for k in range(0, len(term), step):
                    here = slice(k, k + step)
                    holders = first[term[here] + 1] - first[term[here]]
                    ends = np.cumsum(holders)
                    at = np.arange(ends[-1]) + np.repeat(first[term[here]] - ends + holders, holders)
                    np.add.at(scores, np.repeat(row[here], holders) * items + holder[at], np.repeat(value[here], holders) * times[at])
                best.add(scores.reshape(-1, items), part.column("id").fill_null(_NO_ID).to_numpy())
        yield pa.RecordBatch.from_arrays(
            [pa.array(best.item), pa.array(best.score), pa.array(best.doc, pa.int64(), mask=best.doc == _NO_ID)], ["item", "score", "id"]
        )

    return found.mapInArrow(rate, "item bigint, score bigint, id bigint")


def rank_documents(
    docs: DataFrame, items: DataFrame, top: int = TOP, key: str = "doc_id", text: str = "text", item: str = "item_id", block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """Per item its ``top`` documents with a score above 0: the item id, rank (from 1), the document id, score."""
    spark = docs.sparkSession
    asked = items.select(F.col(item).alias("item"), F.col("text").alias("text")).where("item is not null and text is not null")
    kind = asked.schema["item"].dataType.simpleString()
    blocks = max(1, -(-(asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // block_bytes))
    totals, parts = None, []
    for b in range(blocks):
        part = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b)
        block = Block([tuple(r) for r in part.distinct().toLocalIterator()])
        if not block.items:
            continue
        found = stored(scan(docs, block.terms, key, text), "lexical")
        if totals is None:
            totals = found.agg(F.count(F.lit(1)), F.sum("n")).first()
        if not totals[0]:
            break
        documents, terms = totals
        weights = np.array([weight(documents, int(n)) for n in document_frequencies(found, len(block.terms))], dtype=np.int64)
        best = best_of_tasks(found, block, weights, documents, terms, top)
        names = spark.createDataFrame(list(enumerate(block.items)), f"item bigint, {item} {kind}")
        parts.append(_ranked(best, top).join(F.broadcast(names), "item").select(item, "rank", F.col("id").alias(key), "score"))
    if not parts:
        return spark.createDataFrame([], f"{item} {kind}, rank int, {key} bigint, score bigint")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def _ranked(best: DataFrame, top: int) -> DataFrame:
    """Ranks per item, first within ``SPREAD`` groups of tasks."""
    order = [F.desc("score"), F.asc_nulls_last("id")]
    spread = best.withColumn("spread", F.pmod(F.spark_partition_id(), F.lit(SPREAD)))
    for keys in (["item", "spread"], ["item"]):
        spread = spread.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= top)
    return spread
