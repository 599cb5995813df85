"""URL filter: host and path rules first, for all other URLs the ratio of two character language models.

A rule names a host and the start of a path (``example.com/en/``); it fits its host and all subdomains where the URL's
path starts with the rule's. The longest fitting rule wins (equal lengths: the longer host, then block). URLs that a rule
allows are the accepted sample, those that a rule blocks the rejected one.

A model of each sample predicts every character of a URL (without its scheme, A-Z in lower case) from the characters
before it. Its order varies: an n-gram of 1 to ``ORDER + 1`` characters is in the model if it makes up at least
``LEAST_SHARE`` of the characters of either sample, so deep contexts are there where the sample is dense, and the model
has at most 2 / LEAST_SHARE n-grams of each length however large the sample is. Estimates of neighbouring orders are
blended by Witten and Bell's rule, down to the uniform distribution, so nothing has probability zero.

The score of a URL is log P(accepted) - log P(rejected) per character, less a cut. The models learn from the hosts with
crc32(host) mod 5 above 0; the cut is where accepted and rejected URLs of the other hosts are told apart best (the mean of
both rates; ties: the cut next to 0), in steps of 1 / 200. Without such URLs of both kinds it is 0. A score of 0 or more
is allowed. With one sample only, its verdict is that of all; with none, all is allowed.

All counts are Spark aggregates over all rows. Rules go to the executors in blocks of ``block_rules``, n-grams within the
bound above.

Defined results: a null URL or one without ``://`` has an empty host and path and fits no rule; equal rows are each judged
and each counted; rules with a null are ignored; other columns are ignored; empty tables give empty tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ORDER = 5
LEAST_SHARE = 1e-5
FOLDS = 5
BINS = 200
FAR = 20 * BINS
BLOCK_RULES = 200_000
CHUNK_BYTES = 4_000_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_START, _END = 2, 3


def lowered(c: Column) -> Column:
    return F.translate(c, _UPPER, _LOWER)


def address(url: Column) -> Column:
    """What follows the first ``://``; empty without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


def host_of(url: Column) -> Column:
    return lowered(F.regexp_extract(address(url), "^[^/?#]*", 0))


def path_of(url: Column) -> Column:
    return F.regexp_extract(address(url), "^[^/?#]*([^?#]*)", 1)


class Rules:
    """The rules of one block by host."""

    def __init__(self, rows: list[tuple[str, str, str]]):
        self.by_host: dict[str, list[tuple]] = {}
        for host, path, verdict in rows:
            self.by_host.setdefault(host, []).append((len(host) + len(path), len(host), verdict == "block", host, path, verdict))

    def best(self, host: str, path: str) -> tuple | None:
        found, rest = None, host
        while rest:
            for rule in self.by_host.get(rest, ()):
                if path.startswith(rule[4]) and (found is None or rule > found):
                    found = rule
            rest = rest.partition(".")[2]
        return found


def match_rules(urls: DataFrame, rules: DataFrame, block_rules: int = BLOCK_RULES) -> DataFrame:
    """``urls`` (with host and path) and their rule (as host and path in one string) and ruled (its verdict), or nulls."""
    spark = urls.sparkSession
    given = rules.select("host", "path", "verdict").dropna().distinct()
    blocks = max(1, -(-given.count() // block_rules))
    names = urls.columns
    rows = urls.withColumns({c: F.lit(None).cast(k) for c, k in (("rule", "string"), ("ruled", "string"), ("rule_rank", "array<int>"))})
    schema = rows.schema

    def matcher(shared):
        def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = Rules(shared.value)
            for b in batches:
                held = list(zip(*(b.column(c).to_pylist() for c in ("rule", "ruled", "rule_rank")), strict=True))
                for i, (host, path) in enumerate(zip(b.column("host").to_pylist(), b.column("path").to_pylist(), strict=True)):
                    if (found := known.best(host, path)) and (held[i][2] is None or [*map(int, found[:3])] > held[i][2]):
                        held[i] = (found[3] + found[4], found[5], [*map(int, found[:3])])
                columns = [b.column(c) for c in names] + [
                    pa.array([h[k] for h in held], b.schema.field(c).type) for k, c in enumerate(("rule", "ruled", "rule_rank"))
                ]
                yield pa.RecordBatch.from_arrays(columns, schema=b.schema)

        return match

    for block in range(blocks):
        part = given if blocks == 1 else given.where(F.pmod(F.xxhash64("host", "path"), F.lit(blocks)) == block)
        rows = rows.mapInArrow(matcher(spark.sparkContext.broadcast([tuple(r) for r in part.toLocalIterator()])), schema)
    return rows.drop("rule_rank")


def coded(urls: list[str]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Characters of all addresses, each with an end mark: first place of each URL, its size, n-gram codes by order.

    A code holds the order in its top byte and the context and the character (UTF-8 bytes) below.
    """
    pad = bytes([_START]) * ORDER
    raw = [u.encode() + bytes([_END]) for u in urls]
    sizes = np.array([len(r) for r in raw], dtype=np.int64)
    data = np.frombuffer(b"".join(pad + r for r in raw), dtype=np.uint8).astype(np.int64)
    first = np.cumsum(sizes) - sizes
    at = np.arange(int(sizes.sum())) + np.repeat((np.arange(len(raw)) + 1) * ORDER, sizes)
    codes, gram = [], np.zeros(len(at), dtype=np.int64)
    for order in range(ORDER + 1):
        gram = gram | (data[at - order] << (8 * order))
        codes.append(gram | (order << 56))
    return first, sizes, codes


def pieces(urls: list[str]) -> Iterator[list[str]]:
    """Consecutive addresses of about ``CHUNK_BYTES`` together."""
    held, n = [], 0
    for u in urls:
        held.append(u)
        n += len(u)
        if n >= CHUNK_BYTES:
            yield held
            held, n = [], 0
    if held:
        yield held


def count_grams(sample: DataFrame) -> DataFrame:
    """``sample``: address, accepted. Rows (gram, accepted, rejected): how often each n-gram occurs."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for kind in (True, False):
                for part in pieces(b.filter(pc.equal(b.column("accepted"), kind)).column("address").to_pylist()):
                    for codes in coded(part)[2]:
                        gram, n = np.unique(codes, return_counts=True)
                        none = np.zeros(len(n), dtype=np.int64)
                        yield pa.RecordBatch.from_arrays([pa.array(gram), pa.array(n if kind else none), pa.array(none if kind else n)], ["gram", "accepted", "rejected"])

    counted = sample.select("address", "accepted").mapInArrow(tally, "gram bigint, accepted bigint, rejected bigint")
    return counted.groupBy("gram").agg(F.sum("accepted").alias("accepted"), F.sum("rejected").alias("rejected"))


class Model:
    """Counts of the n-grams of both samples, and of their contexts."""

    def __init__(self, gram: np.ndarray, accepted: np.ndarray, rejected: np.ndarray):
        order = np.argsort(gram)
        self.gram, self.count = gram[order], [accepted[order], rejected[order]]
        context = (self.gram >> 56 << 56) | ((self.gram & ((1 << 56) - 1)) >> 8)
        self.context, which = np.unique(context, return_inverse=True)
        self.total = [np.bincount(which, c, len(self.context)) for c in self.count]
        self.kinds = [np.bincount(which, c > 0, len(self.context)) for c in self.count]

    @staticmethod
    def _found(table: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(table):
            return np.zeros(len(codes), dtype=np.int64), np.zeros(len(codes), dtype=bool)
        at = np.minimum(np.searchsorted(table, codes), len(table) - 1)
        return at, table[at] == codes

    def ratios(self, urls: list[str]) -> np.ndarray:
        """Per address log P(accepted) - log P(rejected) for each character."""
        if not urls:
            return np.zeros(0)
        first, sizes, codes = coded(urls)
        chance = [np.full(len(codes[0]), 1 / 256) for _ in range(2)]
        for order, code in enumerate(codes):
            unique, back = np.unique(code, return_inverse=True)
            at, known = self._found(self.gram, unique)
            held, there = self._found(self.context, (unique >> 56 << 56) | ((unique & ((1 << 56) - 1)) >> 8))
            for k in range(2):
                n = np.where(known, self.count[k][at] if len(self.gram) else 0, 0)[back]
                total = np.where(there, self.total[k][held] if len(self.context) else 0, 0)[back]
                kinds = np.where(there, self.kinds[k][held] if len(self.context) else 0, 0)[back]
                seen = total > 0
                chance[k] = np.where(seen, (n + kinds * chance[k]) / np.where(seen, total + kinds, 1), chance[k])
        return np.add.reduceat(np.log(chance[0]) - np.log(chance[1]), first) / sizes


def learn(ruled: DataFrame, least_share: float = LEAST_SHARE) -> Model:
    """The models of the accepted and rejected addresses of the learning hosts."""
    sample = ruled.where(F.col("ruled").isNotNull() & (F.pmod(F.crc32(F.col("host").cast("binary")), F.lit(FOLDS)) > 0))
    counts = count_grams(sample.select("address", (F.col("ruled") == "allow").alias("accepted")))
    sizes = sample.groupBy("ruled").agg(F.sum(F.octet_length("address") + 1).alias("n")).collect()
    least = {r["ruled"]: r["n"] * least_share for r in sizes}
    kept = counts.where((F.col("accepted") >= max(1.0, least.get("allow", 0.0))) | (F.col("rejected") >= max(1.0, least.get("block", 0.0))))
    held = kept.toArrow()
    return Model(*(held.column(c).to_numpy() for c in ("gram", "accepted", "rejected")))


def rated(rows: DataFrame, model: Model) -> DataFrame:
    """``rows`` (with address) and ratio."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = 0
            for part in pieces(b.column("address").to_pylist()):
                here = b.slice(at, len(part))
                yield pa.RecordBatch.from_arrays([*here.columns, pa.array(shared.value.ratios(part))], [*b.schema.names, "ratio"])
                at += len(part)

    return rows.mapInArrow(rate, f"{schema}, ratio double")


def step_of(ratio: Column) -> Column:
    """The ratio in steps of 1 / BINS; beyond FAR steps all are alike."""
    return F.greatest(F.lit(-FAR), F.least(F.lit(FAR), F.floor(ratio * BINS))).cast("int")


def best_cut(counts: list[tuple[int, int, int]]) -> int:
    """``counts``: (step, accepted, rejected). The step from which on URLs are allowed."""
    accepted, rejected = np.zeros(2 * FAR + 1), np.zeros(2 * FAR + 1)
    for at, a, r in counts:
        accepted[at + FAR] += a
        rejected[at + FAR] += r
    if not accepted.sum() or not rejected.sum():
        return 0
    below_a = np.concatenate(([0], np.cumsum(accepted)))[:-1]
    below_r = np.concatenate(([0], np.cumsum(rejected)))[:-1]
    merit = (accepted.sum() - below_a) * rejected.sum() + below_r * accepted.sum()
    cuts = np.flatnonzero(merit == merit.max()) - FAR
    return int(min(cuts, key=lambda c: (abs(c), -c)))


def judge(pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", least_share: float = LEAST_SHARE, block_rules: int = BLOCK_RULES) -> DataFrame:
    """Per row: ``key``, host, path, rule, verdict (allow or block), score (0 or more: the models allow)."""
    given = pages.select(F.col(key).alias("key"), F.coalesce(F.col(url), F.lit("")).alias("url"))
    parts = given.select("key", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), lowered(address(F.col("url"))).alias("address"))
    ruled = match_rules(parts, rules, block_rules)
    kinds = {r["ruled"] for r in ruled.where("ruled is not null").select("ruled").distinct().collect()}
    scored = F.col("ratio")
    if kinds == {"allow", "block"}:
        model = learn(ruled, least_share)
        held_out = ruled.where(F.col("ruled").isNotNull() & (F.pmod(F.crc32(F.col("host").cast("binary")), F.lit(FOLDS)) == 0))
        counts = rated(held_out.select("address", "ruled"), model).groupBy(step_of(F.col("ratio")).alias("step")).agg(
            F.count_if(F.col("ruled") == "allow").alias("a"), F.count_if(F.col("ruled") == "block").alias("r")
        )
        cut = best_cut([tuple(r) for r in counts.collect()])
        out, allowed = rated(ruled, model), step_of(scored) >= cut
        score = (scored - cut / BINS)
    else:
        only = kinds.pop() if kinds else "allow"
        out, allowed, score = ruled, F.lit(only == "allow"), F.lit(1.0 if only == "allow" else -1.0)
    verdict = F.coalesce("ruled", F.when(allowed, "allow").otherwise("block"))
    return out.select(F.col("key").alias(key), "host", "path", "rule", verdict.alias("verdict"), score.alias("score"))
