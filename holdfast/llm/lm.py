"""Documents scored by masked pseudo-likelihood: a small window network predicts every token from both sides.

Every word of the counted corpus has its own probability. The most frequent words are classes of one word; all others
fall into classes by the hash of their ending. The network adds one vector per neighbour (two on either side, a table
for each place), applies tanh, and predicts the class of the token in two steps, its group and its place in the group,
so that a prediction costs two small softmaxes. It never sees the token itself. A word's probability within its class
is its share of the class's count, with one count a class kept for words that were never counted. The counts stay a
table that grows with the corpus: the ``KNOWN_WORDS`` most frequent go to the executors, the rest is joined in Spark.

Training covers every window of every document. Texts, equal ones as one with a weight, are dealt by a hash of what they
say to shards of about ``SHARD_WORDS`` words, so that the file split plays no part. A pass over all windows is ``PARTS``
rounds (fewer over a small corpus, see ``PART_WORDS``): a shard's windows are dealt in turn to that many parts, each to
one. In each round every shard starts from the last average, goes over its next part in batches, with a step size for
each weight from its gradients so far (Adam), and gives its weights and those step sizes; Spark averages them, weighted
by windows, slice by slice and in two steps so that no task gathers more than a fixed share. Rounds end when every window has been learned
from and a round's mean log-probability, taken before each step, is not more than ``GAIN`` above the last round's.
Scores are sums of conditional log-probabilities over whole texts.

Defined results: null, empty and word-less texts have 0 tokens, sum 0, and a null mean; repeated rows count as text and
are scored each; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import itertools
import math
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GROUPS, PLACES = 32, 32
VOCABULARY = GROUPS * PLACES
ENDINGS = 128
WIDTH, REACH = 16, 2
BATCH = 4096
STEP = 4096
RATE = 0.02
KEEP, KEEP_SQUARES = 0.9, 0.999
GAIN = 0.02
SHARD_WORDS = 2_000_000
PARTS, PART_WORDS = 4, 1_000_000
TASK_WORDS = 300_000
CACHE_WORDS = 400_000
ROWS = 500
KNOWN_WORDS = 100_000
SLICES, SPREAD = 16, 64

SHAPES = {"near": (2 * REACH, VOCABULARY, WIDTH), "bias": (WIDTH,), "group": (WIDTH, GROUPS), "group_bias": (GROUPS,), "place": (GROUPS, WIDTH, PLACES), "place_bias": (GROUPS, PLACES)}


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def class_of(word: bytes) -> int:
    """The class of a word that has none of its own."""
    return 1 + zlib.crc32(word[-3:]) % ENDINGS


def counted(docs: DataFrame) -> DataFrame:
    """word, class, n: over all documents; tasks add up in bounded dictionaries first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])
            seen.clear()
            return batch

        for b in batches:
            for t in b.column("text"):
                seen.update(words(t.as_py()))
                if len(seen) > TASK_WORDS:
                    yield out()
        yield out()

    found = docs.select("text").mapInArrow(count, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    ending = F.when(F.octet_length("word") > 3, F.substring("word", -3, 3)).otherwise(F.col("word"))
    return found.select("word", (1 + F.crc32(ending) % ENDINGS).cast("int").alias("class"), "n")


class Vocabulary(dict):
    """Ids of words, one lookup each; 0 stands beyond either end of a text."""

    def __init__(self, frequent: list[bytes], more: dict[bytes, int] | None = None):
        super().__init__(more or {})
        self.update((w, k + 1 + ENDINGS) for k, w in enumerate(frequent))
        self.limit = len(self) + CACHE_WORDS

    def __missing__(self, word: bytes) -> int:
        found = class_of(word)
        if len(self) < self.limit:
            self[word] = found
        return found

    def of(self, own: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, own), np.int32, len(own))


def spaced(own: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of texts end to end with room for the windows between them, and where the tokens are."""
    kind = np.int32 if len(own) + REACH * (1 + len(sizes)) < 2**31 else np.int64
    at = np.arange(len(own), dtype=kind)
    at += np.repeat(np.arange(1, 1 + len(sizes), dtype=kind) * kind(REACH), sizes)
    out = np.zeros(len(own) + REACH * (1 + len(sizes)), np.int32)
    out[at] = own
    return out, at


class Network:
    """Named views of one flat vector of weights."""

    def __init__(self, flat: np.ndarray):
        self.flat, self.w, at = flat.astype(np.float32), {}, 0
        for k, s in SHAPES.items():
            n = math.prod(s)
            self.w[k] = self.flat[at : at + n].reshape(s)
            at += n
        self.near = self.w["near"].reshape(-1, WIDTH)

    @staticmethod
    def start() -> Network:
        rng = np.random.default_rng(7)
        return Network(np.concatenate([(rng.normal(0, 0.1, s) if len(s) > 1 and not k.endswith("bias") else np.zeros(s)).ravel() for k, s in SHAPES.items()]))

    def pass_over(self, ids: np.ndarray, at: np.ndarray, gradient: Network | None = None, weight: np.ndarray | None = None) -> np.ndarray:
        """Log-probability of each token; with ``gradient``, that is set to the gradient of their (weighted) mean's loss.

        Tokens are sorted by group and neighbours by id, as 8 and 16 bits: numpy then sorts by radix.
        """
        w, n, token = self.w, len(at), ids[at]
        group = (token // PLACES).astype(np.uint8)
        order = np.argsort(group, kind="stable")
        at, token, group = at[order], token[order], group[order]
        around = np.concatenate([ids[at + offset] + k * VOCABULARY for k, offset in enumerate((*range(-REACH, 0), *range(1, REACH + 1)))])
        h = self.near[around].reshape(2 * REACH, n, WIDTH).sum(0)
        h += w["bias"]
        np.tanh(h, out=h)
        ends = np.searchsorted(group, np.arange(GROUPS + 1))
        spans = [(k, slice(ends[k], ends[k + 1])) for k in range(GROUPS) if ends[k + 1] > ends[k]]
        g, p = h @ w["group"] + w["group_bias"], w["place_bias"][group]
        for k, s in spans:
            p[s] += h[s] @ w["place"][k]
        in_g, in_p = np.arange(n) * GROUPS + group, np.arange(n) * PLACES + token % PLACES
        logs, found = np.empty(n), 0.0
        for x, own in ((g, in_g), (p, in_p)):
            np.clip(x, -30, 30, out=x)
            found = found + x.ravel()[own].astype(np.float64)
            np.exp(x, out=x)
        sums = [x @ np.ones(x.shape[1], np.float32) for x in (g, p)]
        logs[order] = found - np.log(sums[0].astype(np.float64)) - np.log(sums[1].astype(np.float64))
        if gradient is not None:
            to = gradient.w
            even = np.full(n, 1 / n, np.float32) if weight is None else (weight[order] / weight.sum()).astype(np.float32)
            for x, own, total in zip((g, p), (in_g, in_p), sums, strict=True):
                x *= (even / total)[:, None]
                x.ravel()[own] -= even
            gradient.flat[:] = 0
            back = g @ w["group"].T
            for k, s in spans:
                back[s] += p[s] @ w["place"][k].T
                to["place"][k] = h[s].T @ p[s]
                to["place_bias"][k] = p[s].sum(0)
            to["group"][:] = h.T @ g
            to["group_bias"][:] = g.sum(0)
            back *= 1 - h * h
            to["bias"][:] = back.sum(0)
            sort = np.argsort(around.astype(np.uint16), kind="stable")
            near = around[sort]
            begin = np.flatnonzero(np.diff(near, prepend=-1))
            gradient.near[near[begin]] = np.add.reduceat(back[sort % n], begin)
        return logs


class Learner:
    """A network and the running means of its gradients and of their squares, by which each weight has its own step size.

    All of it is one vector, ``state``, so that it can be averaged: weights, means, squares, and how much of the last two
    is filled (both begin at nothing).
    """

    def __init__(self, state: np.ndarray):
        size = (len(state) - 2) // 3
        self.network, self.gradient = Network(state[:size]), Network(np.zeros(size))
        self.mean, self.squares = (state[k * size : (k + 1) * size].astype(np.float32) for k in (1, 2))
        self.filled, self.filled_squares = state[-2:].tolist()

    @staticmethod
    def start() -> np.ndarray:
        flat = Network.start().flat
        return np.concatenate([flat, np.zeros(2 * len(flat) + 2)])

    def state(self) -> np.ndarray:
        return np.concatenate([self.network.flat, self.mean, self.squares, [self.filled, self.filled_squares]])

    def learn(self, ids: np.ndarray, at: np.ndarray, rate: float, weight: np.ndarray) -> np.ndarray:
        """One step; log-probabilities before it."""
        logs = self.network.pass_over(ids, at, self.gradient, weight)
        slope = self.gradient.flat
        self.mean *= KEEP
        self.mean += slope * np.float32(1 - KEEP)
        slope *= slope
        slope *= np.float32(1 - KEEP_SQUARES)
        self.squares *= KEEP_SQUARES
        self.squares += slope
        self.filled += (1 - KEEP) * (1 - self.filled)
        self.filled_squares += (1 - KEEP_SQUARES) * (1 - self.filled_squares)
        size = np.sqrt(self.squares, out=slope)
        size += 1e-8
        move = np.divide(self.mean, size, out=size)
        move *= rate / self.filled * self.filled_squares**0.5
        self.network.flat -= move
        return logs


def in_groups(texts: Iterator[str | None]) -> Iterator[list[list[bytes]]]:
    """Texts, as words, in groups of about ``BATCH`` words."""
    held, n = [], 0
    for t in texts:
        held.append(words(t))
        n += len(held[-1])
        if n >= BATCH:
            yield held
            held, n = [], 0
    if held:
        yield held


def shards(coded: DataFrame, n_words: int) -> DataFrame:
    """shard, ids (16 bits each, texts end to end), sizes and copies of the texts (32 and 64 bits each)."""
    from holdfast.plans.storage import stored

    n_shards = max(1, -(-n_words // SHARD_WORDS))

    def gather(key: tuple, t: pa.Table) -> pa.Table:
        rows = sorted((zlib.crc32(x), x, n) for x, n in zip(t.column("ids").to_pylist(), t.column("n").to_pylist(), strict=True))
        sizes, copies = np.array([len(x) // 2 for _, x, _ in rows], "<u4"), np.array([n for *_, n in rows], "<u8")
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "ids": pa.array([b"".join(x for _, x, _ in rows)], pa.binary()), "sizes": pa.array([sizes.tobytes()], pa.binary()), "copies": pa.array([copies.tobytes()], pa.binary())})

    texts = coded.where(F.octet_length("ids") > 0).select((F.crc32("ids") % n_shards).cast("int").alias("shard"), "ids")
    rows = texts.groupBy("shard", "ids").agg(F.count("*").alias("n"))
    return stored(rows.groupBy("shard").applyInArrow(gather, "shard int, ids binary, sizes binary, copies binary"), "lm-shards")


def windows(ids: bytes, sizes: bytes, copies: bytes, first: int, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of a shard with room between texts; of every ``step``-th token from ``first`` on, where it is and how often it
    counts."""
    n = np.frombuffer(sizes, "<u4").astype(np.int64)
    own, at = spaced(np.frombuffer(ids, "<u2"), n)
    text = np.searchsorted(np.cumsum(n), np.arange(first, n.sum(), step), side="right")
    return own, at[first::step].copy(), np.frombuffer(copies, "<u8").astype(np.float64)[text]


def one_round(dealt: DataFrame, state: np.ndarray, turn: int, parts: int = 1) -> tuple[np.ndarray, float] | None:
    """The average of what all shards learn from ``state`` on, each from its next of ``parts`` parts, and the mean
    log-probability on the way."""
    sent = dealt.sparkSession.sparkContext.broadcast(state)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _LOADED.clear()  # the worker that read the texts is used again, its words are not
        total, n, logs = 0.0, 0, 0.0
        for shard, *texts in (x for b in batches for x in zip(*(b.column(c).to_pylist() for c in ("shard", "ids", "sizes", "copies")), strict=True)):
            own = Learner(sent.value)
            ids, at, copies = windows(*texts, turn % parts, parts)
            order = np.random.default_rng((turn, shard)).permutation(len(at))
            if not len(order):
                continue
            size, learned = max(64, min(STEP, len(order) // 64)), int(copies[order].sum())
            for k in range(0, len(order), size):
                part = order[k : k + size]
                rate = RATE / (1 + turn + k / len(order)) ** 0.5
                weight = copies[part]
                logs += float(own.learn(ids, at[part], rate, weight) @ weight)
            n += learned
            total = total + own.state() * learned
        if n:
            pieces = np.array_split(total, SLICES)
            task = TaskContext.get().partitionId() % SPREAD
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(SLICES), pa.int32()), pa.array([task] * SLICES, pa.int32()), pa.array([n] * SLICES, pa.int64()), pa.array([logs] * SLICES, pa.float64()), pa.array([x.tobytes() for x in pieces], pa.binary())],
                ["slice", "task", "n", "logs", "weights"],
            )

    def added(key: tuple, t: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(w.as_py(), np.float64) for w in t.column("weights"))
        return pa.table({"slice": pa.array([key[0].as_py()], pa.int32()), "n": pa.array([sum(t.column("n").to_pylist())], pa.int64()), "logs": pa.array([sum(t.column("logs").to_pylist())], pa.float64()), "weights": pa.array([total.tobytes()], pa.binary())})

    schema = "slice int, n bigint, logs double, weights binary"
    rows = dealt.mapInArrow(learn, "slice int, task int, n bigint, logs double, weights binary")
    rows = rows.groupBy("slice", "task").applyInArrow(added, schema).groupBy("slice").applyInArrow(added, schema)
    pieces = {r["slice"]: r for r in rows.collect()}
    sent.destroy()
    if not pieces:
        return None
    flat = np.concatenate([np.frombuffer(bytes(pieces[k]["weights"]), np.float64) for k in range(SLICES)])
    return flat / pieces[0]["n"], pieces[0]["logs"] / pieces[0]["n"]


def trained(coded: DataFrame, n_words: int) -> Network:
    """Rounds of learning and averaging until all windows had their turn and the mean log-probability stays."""
    state, last = Learner.start(), -math.inf
    dealt, parts = shards(coded, n_words), max(1, min(PARTS, n_words // PART_WORDS))
    for turn in itertools.count():
        found = one_round(dealt, state, turn, parts)
        if found is None:
            break
        state, mean = found
        if turn + 1 >= parts and mean - last <= GAIN:
            break
        last = mean
    return Learner(state).network


class Shares:
    """Words and their log-probabilities within their classes: ``logs`` of counts, less the log of the class's own.

    A word has a code, its class's if it has one of its own or no count at hand, a number from ``VOCABULARY`` on else.
    """

    def __init__(self, frequent: list[bytes], known: list[tuple[bytes, int]], totals: dict[int, int]):
        self.codes = Vocabulary(frequent, {w: VOCABULARY + k for k, (w, _) in enumerate(known)})
        self.classes = np.array([*range(VOCABULARY), *(class_of(w) for w, _ in known)], np.int32)
        cost = np.zeros(VOCABULARY)
        for k in range(1, 1 + ENDINGS):
            cost[k] = math.log(totals.get(k, 0) + 1)
        self.logs = np.array([0.0] * VOCABULARY + [math.log(n) for _, n in known]) - cost[self.classes]

    def left(self, codes: np.ndarray) -> np.ndarray:
        """Where the words are whose counts are still to be joined."""
        return np.flatnonzero((codes > 0) & (codes <= ENDINGS))


def shares_of(counts: DataFrame) -> tuple[list[bytes], list[tuple[bytes, int]], dict[int, int]]:
    """Words with a class of their own, other frequent words with their counts, and the count of each shared class."""
    top = [(bytes(r["word"]), r["n"]) for r in counts.orderBy(F.desc("n"), "word").limit(VOCABULARY - 1 - ENDINGS + KNOWN_WORDS).select("word", "n").collect()]
    own, known = top[: VOCABULARY - 1 - ENDINGS], top[VOCABULARY - 1 - ENDINGS :]
    totals = Counter({r["class"]: r["n"] for r in counts.groupBy("class").agg(F.sum("n").alias("n")).collect()})
    for w, n in own:
        totals[class_of(w)] -= n
    return [w for w, _ in own], known, dict(totals)


_LOADED: dict[str, Shares] = {}


def loaded(key: str, shares: tuple) -> Shares:
    """Set up once in each Python worker; only the last one is kept."""
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Shares(*shares)
    return _LOADED[key]


def in_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows, at most ``ROWS`` at once: what a task holds for them does not hang on how Spark batches rows."""
    for b in batches:
        for k in range(0, b.num_rows, ROWS):
            yield b.slice(k, ROWS)


def encoded(docs: DataFrame, shares: tuple) -> DataFrame:
    """Texts read once, for training and for scoring. Per row: row, doc_id, ids (classes, 16 bits each), share (the sum
    of the logarithms at hand of words within their classes); and rows of row, word, times for the counts that are not."""
    from holdfast.plans.storage import stored

    key, sent = uuid.uuid4().hex, docs.sparkSession.sparkContext.broadcast(shares)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_shares = loaded(key, sent.value)
        row = TaskContext.get().partitionId() << 40
        for b in in_slices(batches):
            ids, sums, left = [], [], []
            for texts in in_groups(t.as_py() for t in b.column("text")):
                own, stops = list(itertools.chain.from_iterable(texts)), np.cumsum([0, *(len(x) for x in texts)])
                codes = own_shares.codes.of(own)
                classes, ends = own_shares.classes[codes].astype("<u2").tobytes(), np.concatenate([[0.0], np.cumsum(own_shares.logs[codes])])
                rest = own_shares.left(codes)
                rows = row + len(ids) + np.searchsorted(stops, rest, side="right") - 1
                left.append(Counter(zip(rows.tolist(), map(own.__getitem__, rest.tolist()), strict=True)))
                ids += [classes[2 * x : 2 * y] for x, y in itertools.pairwise(stops.tolist())]
                sums += (ends[stops[1:]] - ends[stops[:-1]]).tolist()
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(row, row + len(ids)), pa.int64()), b.column("doc_id"), pa.array(ids, pa.binary()), pa.array(sums, pa.float64()), pa.nulls(len(ids), pa.binary()), pa.nulls(len(ids), pa.int64())],
                names := ["row", "doc_id", "ids", "share", "word", "times"],
            )
            row += len(ids)
            for part in left:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x for x, _ in part], pa.int64()), pa.nulls(len(part), b.column("doc_id").type), pa.nulls(len(part), pa.binary()), pa.nulls(len(part), pa.float64()), pa.array([w for _, w in part], pa.binary()), pa.array(list(part.values()), pa.int64())],
                    names,
                )

    return stored(docs.select("doc_id", "text").mapInArrow(run, f"row bigint, doc_id {kind}, ids binary, share double, word binary, times bigint"), "lm-coded")


def score(coded: DataFrame, network: Network, counts: DataFrame) -> DataFrame:
    """Per row: doc_id, n_tokens, log_likelihood (sum), mean_log_likelihood.

    The network scores the classes; words whose counts were not at hand, one row for each of a text, are joined to
    ``counts`` and added. A joined word is rarer than ``KNOWN_WORDS`` others, so none is hot.
    """
    sent = coded.sparkSession.sparkContext.broadcast(network.flat)
    kind = coded.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_network = Network(sent.value)
        for b in batches:
            sums, given = [], b.column("ids")
            sizes = np.array([len(x.as_buffer()) // 2 for x in given], np.int64)
            # groups of about BATCH words
            cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // BATCH, prepend=-1)).tolist()
            for first, last in itertools.pairwise([*cuts, len(sizes)]):
                n = sizes[first:last]
                ids, at = spaced(np.frombuffer(b"".join(x.as_py() for x in given[first:last]), "<u2"), n)
                ends = np.cumsum(np.concatenate([[0.0], *(own_network.pass_over(ids, at[k : k + BATCH]) for k in range(0, len(at), BATCH))]))
                stops = np.concatenate([[0], np.cumsum(n)])
                sums += (ends[stops[1:]] - ends[stops[:-1]]).tolist()
            total = np.array(sums) + b.column("share").to_numpy()
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("doc_id"), pa.array(sizes), pa.array(total)], ["row", "doc_id", "n_tokens", "total"])

    joined = coded.where("word is not null").select("row", "word", "times").join(counts.select("word", "n"), "word", "left")
    rest = joined.groupBy("row").agg(F.sum(F.col("times") * F.log(F.coalesce("n", F.lit(1)))).alias("more"))
    told = coded.where("word is null").select("row", "doc_id", "ids", "share").mapInArrow(run, f"row bigint, doc_id {kind}, n_tokens bigint, total double")
    rows = told.join(rest, "row", "left")
    total = F.col("total") + F.coalesce("more", F.lit(0.0))
    return rows.select("doc_id", "n_tokens", total.alias("log_likelihood"), F.when(F.col("n_tokens") > 0, total / F.col("n_tokens")).alias("mean_log_likelihood"))


def score_documents(docs: DataFrame) -> DataFrame:
    """Count, train and score over all of ``docs``."""
    from holdfast.plans.storage import stored

    counts = stored(counted(docs), "lm-counts")
    shares = shares_of(counts)
    n_words = counts.agg(F.sum("n")).first()[0] or 0
    coded = encoded(docs, shares)
    return score(coded, trained(coded, n_words), counts)
