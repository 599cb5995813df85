"""Near-duplicate groups by SetSketch registers.

A text is the set of its distinct word shingles. Register i of a sketch is floor(1 - log_b(min of h_i)), h_i being
exponential hashes of the elements with rate ``RATE``, cut to 16 bits: sketches of parts merge by the larger register,
and two registers agree with about the probability of the Jaccard similarity.

1. Texts with equal sets form a class (one row per class after a map-side combine); only classes go on.
2. Registers are hashed in bands; classes with an equal band are candidates. In each bucket all members are compared
   with one pivot, the one that shares buckets with the most others, so a bucket of any size gives one pair per member.
   Rounds repeat this with another pivot for the members that are not yet connected with each other.
3. What is still apart in a bucket after ``rounds`` rounds is compared exactly: members of different components that
   have one of their rarest shingles in common. None of the links between different texts is lost to a cap.
4. A pair is dropped without reading texts only if its sizes rule the similarity out, or if the joint likelihood of
   its registers is e^25 times higher for some lower similarity than for the threshold. All other pairs are verified
   on their full sets.
5. Components are found by smallest labels over verified links, in tables; nothing is collected.

Bands of 5 registers, 36 of them, miss a pair at a similarity of 0.8 with a probability of about 6e-7.

Defined results: null, empty and word-less texts have the empty set and are linked with nothing; with fewer words than
a shingle has, the whole sequence is the one shingle; repeated rows get a row each, in the same component; rows that
share an id but not a text may be linked differently; a null id is linked with nothing and kept, its component is null;
an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from holdfast.plans.storage import discard, stored

BASE, RATE, LIMIT = 1.001, 20.0, 65_535
BANDS, ROWS = 36, 5
PART_BYTES = 1 << 20
SURE = 25.0

_rng = np.random.default_rng(20240)
_ODD = _rng.integers(0, 2**32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1)
_ADD = _rng.integers(0, 2**32, BANDS * ROWS, dtype=np.uint32)
_BYTE = _rng.integers(1, 2**64, 256, dtype=np.uint64)
_BASE = np.uint64(0xD1342543DE82EF95)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.isin(np.arange(256), list(b" \t\n\v\f\r"))
_GAP = re.compile(rb"[ \t-\r]")


def words(text: str | None) -> list[bytes]:
    """Runs of what is no white space, A-Z in lower case."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def shingles(own: list[bytes], size: int) -> set[tuple[bytes, ...]]:
    return set(zip(*(own[k:] for k in range(size)), strict=False)) if len(own) >= size else {tuple(own)} if own else set()


_POWERS = np.ones(1, dtype=np.uint64)


def powers(n: int) -> np.ndarray:
    """The first n powers of the base at least; as many as the longest word so far has bytes."""
    global _POWERS
    if n > len(_POWERS):
        _POWERS = np.cumprod(np.concatenate(([np.uint64(1)], np.full(2 * n, _BASE))), dtype=np.uint64)
    return _POWERS


def part_hashes(part: bytes) -> np.ndarray:
    """A 64-bit hash of each word, all words at once: random values of bytes times powers by their place in the word."""
    data = np.frombuffer(part, dtype=np.uint8)
    gap = _SPACE[data]
    edges = np.flatnonzero(np.diff(np.concatenate(([True], gap, [True]))))
    if not len(edges):
        return np.empty(0, dtype=np.uint64)
    lengths = edges[1::2] - edges[::2]
    first = np.cumsum(lengths) - lengths
    place = np.arange(first[-1] + lengths[-1]) - np.repeat(first, lengths)
    return np.add.reduceat(_BYTE[data[~gap]] * powers(int(lengths.max()))[place], first)


def word_hashes(text: str | None) -> np.ndarray:
    """In the order of the words; a long text is worked on in parts that end at white space."""
    raw = text.encode("utf-8", "surrogatepass").lower() if text else b""
    cuts, at = [0], 0
    while at + PART_BYTES < len(raw) and (m := _GAP.search(raw, at + PART_BYTES)):
        at = m.end()
        cuts.append(at)
    return np.concatenate([part_hashes(raw[a:b]) for a, b in itertools.pairwise([*cuts, len(raw)])])


def hashes(text: str | None, size: int) -> np.ndarray:
    """Distinct 64-bit hashes of the shingles, sorted; none without words."""
    ids = word_hashes(text)
    if not len(ids):
        return ids
    n = min(size, len(ids))
    out = np.full(len(ids) - n + 1, n, dtype=np.uint64)
    for k in range(n):
        out = (out ^ ids[k : k + len(out)]) * _MIX
        out ^= out >> np.uint64(32)
    out.sort()
    return out[np.concatenate(([True], out[1:] != out[:-1]))]


def registers(elements: np.ndarray) -> np.ndarray:
    """Of the upper halves of hashes."""
    upper = (elements >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(_ODD), np.iinfo(np.uint32).max, dtype=np.uint32)
    for at in range(0, len(upper), 256):
        h = upper[at : at + 256, None] * _ODD
        h += _ADD
        np.minimum(least, h.min(axis=0), out=least)
    h = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**32) / RATE
    return np.clip(np.floor(1 - np.log(h) / np.log(BASE)), 0, LIMIT).astype("<u2")


def bands(r: np.ndarray) -> list[int]:
    return [xxhash.xxh3_64_intdigest(r[k * ROWS : (k + 1) * ROWS].tobytes(), seed=k) - 2**63 for k in range(BANDS)]


def merged(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """A join whose sides both grow with the documents: sorted on both sides at any size, so no side is ever broadcast and
    a small table shows the plan of a large one."""
    return left.join(right.hint("merge"), on, how)


def sketched(docs: DataFrame, shingle: int) -> DataFrame:
    """Per row: doc_id, n_shingles, digest of the set, registers."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text in b.column("text"):
                h = hashes(text.as_py(), shingle)
                rows.append((0, None, None) if not len(h) else (len(h), hashlib.blake2b(h.tobytes(), digest_size=16).digest(), registers(h).tobytes()))
            n, digest, sketch = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(sketch, pa.binary())], ["doc_id", "n_shingles", "digest", "registers"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_shingles bigint, digest binary, registers binary")


def banded(classes: DataFrame) -> DataFrame:
    """A row for each band of each class: bucket, node, n."""
    kind = classes.schema["node"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [bands(np.frombuffer(r.as_py(), "<u2")) for r in b.column("registers")]
            yield pa.RecordBatch.from_arrays([b.column("node"), b.column("n"), pa.array(found, pa.list_(pa.int64()))], ["node", "n", "buckets"])

    rows = classes.select("node", "n", "registers").mapInArrow(run, f"node {kind}, n bigint, buckets array<bigint>")
    return rows.select(F.explode("buckets").alias("bucket"), "node", "n")


def possible(percent: int, a: str, b: str):
    """The sizes allow the similarity: the smaller set has that share of the larger one at least."""
    return F.lit(100) * F.least(a, b) >= F.lit(percent) * F.greatest(a, b)


def log_likelihood(j: np.ndarray, more: np.ndarray, less: np.ndarray, same: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Of similarity j, from how many registers are larger, smaller and equal; u is the share of the first size."""
    p = lambda x: -np.log1p(-np.clip(x, 1e-12, 1) * (BASE - 1) / BASE) / np.log(BASE)
    up, down = p(u - (1 - u) * j), p((1 - u) - u * j)
    return more * np.log(up) + less * np.log(down) + same * np.log(np.clip(1 - up - down, 1e-12, 1))


def likely(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, threshold: float) -> np.ndarray:
    """False only where some lower similarity is e^SURE times likelier than the threshold."""
    more, less = (a > b).sum(1).astype(float), (a < b).sum(1).astype(float)
    same, u = a.shape[1] - more - less, n_a / (n_a + n_b)
    at = log_likelihood(np.full(len(u), threshold), more, less, same, u)
    best = np.max([log_likelihood(np.full(len(u), j), more, less, same, u) for j in np.linspace(0, threshold, 33)], axis=0)
    return best - at < SURE


def verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Of distinct pairs (a, b) the linked ones, on full sets, written."""
    kind = classes.schema["node"].dataType.simpleString()
    side = lambda x: classes.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("registers").alias(f"r_{x}"))

    def estimate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                r_a, r_b = (np.frombuffer(b"".join(b.column(c).to_pylist()), "<u2").reshape(b.num_rows, -1) for c in ("r_a", "r_b"))
                n_a, n_b = (b.column(c).to_numpy().astype(float) for c in ("n_a", "n_b"))
                yield b.select(["a", "b"]).filter(pa.array(likely(r_a, r_b, n_a, n_b, percent / 100)))

    close = stored(merged(merged(pairs, side("a"), "a"), side("b"), "b").mapInArrow(estimate, f"a {kind}, b {kind}"), "close-pairs")
    needed = close.select(F.col("a").alias("node")).unionAll(close.select(F.col("b").alias("node"))).distinct()
    texts = stored(merged(docs.select(F.col("doc_id").alias("node"), "text"), needed, "node", "left_semi"), "close-texts")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, first = None, set()
        for b in batches:
            keep = []
            for a, text_a, text_b in zip(b.column("a").to_pylist(), b.column("text_a"), b.column("text_b"), strict=True):
                if a != last or text_a.as_py() != held:
                    last, held = a, text_a.as_py()
                    first = shingles(words(held), shingle)
                second = shingles(words(text_b.as_py()), shingle)
                both = len(first & second)
                keep.append(bool(both) and 100 * both >= percent * (len(first) + len(second) - both))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    text = lambda x: texts.select(F.col("node").alias(x), F.col("text").alias(f"text_{x}"))
    links = merged(merged(close, text("b"), "b"), text("a"), "a").select("a", "b", "text_a", "text_b").mapInArrow(compare, f"a {kind}, b {kind}").distinct()
    result = stored(links, "links")
    discard(close, texts)
    return result


def overlapping(open_: DataFrame, docs: DataFrame, shingle: int, percent: int) -> tuple[DataFrame, list[DataFrame]]:
    """Pairs of open nodes that may be linked by their rarest shingles; exact, without the pairs of a bucket. And the
    tables that can go when the pairs are written.

    Shingles of a set are ordered by how many open sets have them. If two sets are similar enough, their first common
    shingle in that order leaves room for the common part they need; so only the rare end of each set is joined, and
    what is in one set alone is in no join at all.
    """
    nodes = open_.select("node", "n", "component").distinct()
    kinds = f"node {nodes.schema['node'].dataType.simpleString()}, n bigint, component {nodes.schema['component'].dataType.simpleString()}"
    texts = merged(docs.select(F.col("doc_id").alias("node"), "text"), nodes, "node")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [hashes(t.as_py(), shingle).view(np.int64) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("node"), b.column("n"), b.column("component"), pa.array(found, pa.list_(pa.int64()))], ["node", "n", "component", "tokens"])

    sets = stored(texts.select("node", "n", "component", "text").mapInArrow(split, f"{kinds}, tokens array<bigint>").distinct(), "open-sets")
    tokens = sets.select("node", "n", "component", F.explode("tokens").alias("token"))
    often = tokens.groupBy("token").agg(F.count("*").alias("sets")).where("sets > 1")
    own = Window.partitionBy("node")
    place = F.col("n") - F.count("*").over(own) + F.row_number().over(own.orderBy("sets", "token")) - 1
    rare = merged(tokens, often, "token").select("token", "node", "n", "component", (F.col("n") - place).alias("room")).where(F.lit(100) * F.col("room") >= F.lit(percent) * F.col("n"))
    rare = stored(rare, "rare")
    other = rare.select("token", F.col("node").alias("other"), F.col("n").alias("n_other"), F.col("component").alias("c_other"), F.col("room").alias("room_other"))
    enough = F.lit(100 + percent) * F.least("room", "room_other") >= F.lit(percent) * (F.col("n") + F.col("n_other"))
    found = merged(rare, other, "token").where("node < other and component <> c_other").where(enough).drop("token", "room", "room_other")
    return found, [sets, rare]


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node with a link: the smallest node it reaches, by labels and jumps along them."""
    edges = stored(links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    written = labels = stored(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("component")), "labels")
    while True:
        near = merged(edges, labels.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        lower = merged(labels, near, "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("new"))
        jump = labels.select(F.col("node").alias("new"), F.col("component").alias("far"))
        after = stored(merged(lower, jump, "new", "left").select("node", "old", F.least("new", F.coalesce("far", "new")).alias("component")), "labels")
        discard(written)
        written, labels = after, after.select("node", "component")
        if not after.where("component <> old").head(1):
            discard(edges)
            return labels


def labelled(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return rows.withColumn("component", F.col("node"))
    return merged(rows, labels, "node", "left").withColumn("component", F.coalesce("component", "node"))


def group(docs: DataFrame, shingle: int = 5, percent: int = 80, rounds: int = 1) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (smallest id reachable over links), kept."""
    rows = stored(sketched(docs, shingle), "sketches")
    classes = stored(
        rows.where("n_shingles > 0 and doc_id is not null")
        .groupBy("digest")
        .agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n"), F.first("registers").alias("registers")),
        "classes",
    )
    every = stored(banded(classes), "bands")
    shared = every.groupBy("bucket").agg(F.count("*").alias("members")).where("members > 1")
    buckets = stored(merged(every, shared, "bucket"), "buckets")
    discard(every)
    weight = buckets.groupBy("node").agg(F.sum("members").alias("weight"))
    members = stored(merged(buckets.drop("members"), weight, "node"), "weighted")
    discard(buckets)
    links, labels, tested = None, None, None
    for number in range(rounds + 1):
        own, done = labelled(members, labels), []
        apart = own.groupBy("bucket").agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least <> most").select("bucket")
        open_ = stored(merged(own, apart, "bucket"), "open") if number else own
        if number < rounds:
            # the pivot is the member that shares buckets with the most others (what copies were made from does);
            # a later one is such a member outside of the component of the first
            heaviest = F.max(F.struct("weight", "node", "n", "component"))
            outside = open_ if not number else merged(open_, open_.groupBy("bucket").agg(heaviest.alias("p")).select("bucket", F.col("p.component").alias("first")), "bucket").where("component <> first")
            pivot = outside.groupBy("bucket").agg(heaviest.alias("p"))
            found = merged(open_, pivot, "bucket").select("node", "n", "component", F.col("p.node").alias("other"), F.col("p.n").alias("n_other"), F.col("p.component").alias("c_other"))
        else:
            found, done = overlapping(open_, docs, shingle, percent)
        found = found.where("node <> other and component <> c_other").where(possible(percent, "n", "n_other"))
        pairs = found.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()
        if tested is not None:
            pairs = merged(pairs, tested, ["a", "b"], "left_anti")
        pairs = stored(pairs, "pairs")
        discard(*done, *([open_] if number else []))
        if not pairs.head(1):
            if number < rounds:
                continue
            break
        tested = pairs if tested is None else tested.unionAll(pairs)
        new = verified(pairs, classes, docs, shingle, percent)
        links = new if links is None else links.unionAll(new)
        labels = components(links)
    result = merged(rows.drop("registers"), labelled(classes.select("digest", "node"), labels).select("digest", "component"), "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return result.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def keep_first(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """One row of ``docs`` for each group, with its own columns; rows with a null id stay."""
    kept = group(docs, shingle, percent).where("kept and doc_id is not null").select(F.col("doc_id").alias("_kept_id")).distinct()
    named = docs.where("doc_id is not null")
    one = named.join(kept, named["doc_id"] == kept["_kept_id"], "left_semi").dropDuplicates(["doc_id"])
    return one.unionAll(docs.where("doc_id is null"))
