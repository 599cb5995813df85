"""Document quality by a factorisation machine.

Features of a text: its words, hashed; statistics of its structure and its length (the only metadata that is not a label,
language, source or id), each as one of a few levels. Every pair of features interacts through the product of two short
vectors; the sum over all pairs costs linear time by the identity sum_{i<j} <v_i, v_j> x_i x_j
= (|sum_i v_i x_i|^2 - sum_i |v_i x_i|^2) / 2.

The machine learns in numpy on the driver from at most ``max_rows`` labelled rows, the ones first in the order of a hash
of their id; their features are made in executors, from whole texts, and combined to one row for each id. Scoring runs over all rows in executors.

Defined results: a null text is an empty one and has a score like any other; repeated label rows of a document count as
one, by their mean; of repeated rows of a labelled document one is learned from, the text with the smallest hash; without labels every score is 0.5; each of repeated documents is scored; extra columns are ignored;
an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HASHED = 1 << 16
LEVELS = 12
FACTORS = 8
MAX_ROWS = 12_000
EPOCHS = 6
THRESHOLD = 0.3

_UPPER = bytes(range(65, 91))
_SIGNS = b"#*$%&<>_=~^@{}[]\\/"
STATISTICS = ("words", "letters a word", "signs", "bars", "exclamations", "upper", "digits", "same neighbours", "distinct", "top word", "words a line", "same lines", "stops")
SIZE = HASHED + len(STATISTICS) * LEVELS


def level(x: float) -> int:
    """0 for nothing, then one level for each doubling from 1/512 up."""
    return 0 if x <= 0 else int(min(max(np.log2(x) + 10, 1), LEVELS - 1))


def statistics(text: str, words: list[str], counts: Counter) -> list[float]:
    data, n = text.encode("utf-8", "surrogatepass"), max(1, len(words))
    share = lambda signs: (len(data) - len(data.translate(None, signs))) / n
    lines = [x for x in text.split("\n") if x.strip()]
    letters = max(1, sum(map(len, words)))
    return [
        len(words) / 2048,
        letters / n / 16,
        share(_SIGNS),
        share(b"|"),
        share(b"!"),
        share(_UPPER) * n / letters,
        share(b"0123456789"),
        sum(map(str.__eq__, words, words[1:])) / n,
        len(counts) / n,
        max(counts.values(), default=0) / n,
        n / max(1, len(lines)) / 64,
        (len(lines) - len(set(lines))) / max(1, len(lines)),
        share(b".?"),
    ]


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values: hashed words scaled to length one, and a one for the level of each statistic."""
    text = text or ""
    words = text.lower().split()
    counts = Counter(words)
    hashed = np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) % HASHED for w in counts), np.int32, len(counts))
    values = np.log1p(np.fromiter(counts.values(), np.float32, len(counts)))
    values /= max(1e-9, float(np.sqrt((values * values).sum())))
    own = [HASHED + k * LEVELS + level(x) for k, x in enumerate(statistics(text, words, counts))]
    return np.concatenate([hashed, np.array(own, np.int32)]), np.concatenate([values, np.full(len(own), 0.5, np.float32)])


class Machine:
    def __init__(self, bias: float, linear: np.ndarray, vectors: np.ndarray):
        self.bias, self.linear, self.vectors = bias, linear, vectors

    @staticmethod
    def start(seed: int = 0) -> Machine:
        return Machine(0.0, np.zeros(SIZE, np.float32), np.random.default_rng(seed).normal(0, 0.02, (SIZE, FACTORS)).astype(np.float32))

    def terms(self, index: np.ndarray, value: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Margins of rows laid end to end (row r from begin[r]), with what their gradient needs."""
        scaled = self.vectors[index] * value[:, None]
        sums = np.add.reduceat(scaled, begin)
        pairs = 0.5 * ((sums * sums).sum(1) - np.add.reduceat((scaled * scaled).sum(1), begin))
        return self.bias + np.add.reduceat(self.linear[index] * value, begin) + pairs, scaled, sums

    def scores(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        if not rows:
            return np.zeros(0)
        begin = np.concatenate(([0], np.cumsum([len(r[0]) for r in rows])[:-1]))
        margin, _, _ = self.terms(np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows]), begin)
        return 1 / (1 + np.exp(-np.clip(margin.astype(np.float64), -30, 30)))

    def learn(self, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = EPOCHS, rate: float = 0.1, decay: float = 1e-4, batch: int = 64) -> None:
        """Logistic loss, steps scaled by the root of the sum of squared gradients of each weight."""
        rng = np.random.default_rng(1)
        seen_w, seen_v, seen_b = np.full(SIZE, 1e-6, np.float32), np.full((SIZE, FACTORS), 1e-6, np.float32), 1e-6
        for _ in range(epochs):
            order = rng.permutation(len(rows))
            for at in range(0, len(order), batch):
                own = order[at : at + batch]
                sizes = np.array([len(rows[i][0]) for i in own])
                index, value = np.concatenate([rows[i][0] for i in own]), np.concatenate([rows[i][1] for i in own])
                row, begin = np.repeat(np.arange(len(own)), sizes), np.concatenate(([0], np.cumsum(sizes)[:-1]))
                margin, scaled, sums = self.terms(index, value, begin)
                error = ((1 / (1 + np.exp(-np.clip(margin, -30, 30))) - labels[own]) / len(own)).astype(np.float32)
                slope = (error[row] * value).astype(np.float32)
                used, place = np.unique(index, return_inverse=True)
                g_w = np.bincount(place, slope, len(used)).astype(np.float32) + decay * self.linear[used]
                inner = slope[:, None] * (sums[row] - scaled)
                g_v = np.stack([np.bincount(place, inner[:, f], len(used)) for f in range(FACTORS)], 1).astype(np.float32) + decay * self.vectors[used]
                seen_w[used] += g_w * g_w
                seen_v[used] += g_v * g_v
                self.linear[used] -= rate * g_w / np.sqrt(seen_w[used])
                self.vectors[used] -= 0.5 * rate * g_v / np.sqrt(seen_v[used])
                seen_b += float(error.sum()) ** 2
                self.bias -= rate * float(error.sum()) / seen_b**0.5


def held_out(folds: int = 5) -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Machine | None:
    """``labels`` has doc_id and quality of the rows to learn from."""
    chosen = (
        labels.where("doc_id is not null and quality is not null")
        .groupBy("doc_id")
        .agg((F.avg("quality") >= 0.5).cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_rows)
    )
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "label")

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row for each id of the task, of its text with the smallest hash: ``max_rows`` at most."""
        held, schema = {}, None
        for b in batches:
            schema = b.schema
            for key, text, label in zip(b.column("doc_id").to_pylist(), b.column("text"), b.column("label").to_pylist(), strict=True):
                text = text.as_py() or ""
                place = hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()
                if key not in held or place < held[key][0]:
                    held[key] = (place, label, *(x.tobytes() for x in features(text)))
        if held:
            columns = list(zip(*held.values(), strict=True))
            kinds = (pa.binary(), pa.int32(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(held), schema.field("doc_id").type), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], ["doc_id", "place", "label", "indices", "numbers"]
            )

    per_task = rows.mapInArrow(made, f"doc_id {kind}, place binary, label int, indices binary, numbers binary")
    one_each = per_task.groupBy("doc_id").agg(F.min(F.struct("place", "label", "indices", "numbers")).alias("row")).select("row.*")
    found = sorted((r["label"], bytes(r["indices"]), bytes(r["numbers"])) for r in one_each.collect())
    if not found:
        return None
    machine = Machine.start()
    machine.learn([(np.frombuffer(i, np.int32), np.frombuffer(v, np.float32)) for _, i, v in found], np.array([r[0] for r in found], np.float32))
    return machine


_MACHINES: dict[str, Machine] = {}


def machine_of(key: str, parts: tuple) -> Machine:
    """Set up once in each Python worker; only the last one is kept."""
    if key not in _MACHINES:
        _MACHINES.clear()
        _MACHINES[key] = Machine(*parts)
    return _MACHINES[key]


def score(docs: DataFrame, machine: Machine | None) -> DataFrame:
    """Per row: doc_id, score."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text")
    if machine is None:
        return rows.select("doc_id", F.lit(0.5).alias("score"))
    key, sent = uuid.uuid4().hex, docs.sparkSession.sparkContext.broadcast((machine.bias, machine.linear, machine.vectors))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = machine_of(key, sent.value)
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                scores = own.scores([features(t.as_py()) for t in part.column("text")])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return rows.mapInArrow(run, f"doc_id {kind}, score double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, max_rows: int = MAX_ROWS) -> DataFrame:
    """Learn on labelled rows that are not held out; score all rows."""
    machine = fit(docs, labels.select("doc_id", "quality").where(~held_out()), max_rows)
    return score(docs, machine).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
