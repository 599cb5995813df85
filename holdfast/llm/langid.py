"""Language identification with word-first backoff.

A word that training has seen is scored by its log frequency in each language. A word it has not seen is scored by its
character n-grams (with word edges), from the longest kept length down: the first length of which the model knows some
of the word's n-grams decides. A document is the sum over its words; the score is the posterior of the best language.

Counts are taken over every training document: each task adds up its words per language in bounded dictionaries, Spark
adds the tasks up, and n-grams are counted from each distinct word once. Every counted word and n-gram stays, in a table. The ``KNOWN_WORDS`` most frequent words go to the
executors and are summed up where they are read; the distinct other words of the texts are joined to the table, backed
off to its n-grams if it does not have them, and added to the sums of their texts.

Defined results: text that is null or has no letter gives ``und`` with score 0; without any training rows every text
gives ``und``; ties go to the language first in alphabetical order; repeated rows are predicted each; extra columns are
ignored or, in :func:`keep_known`, kept as they are.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.llm.names import free_name

LENGTHS = (4, 3, 2, 1)
KNOWN_WORDS = 120_000
KNOWN_CELLS = 4_000_000
TASK_ENTRIES = 300_000
UNKNOWN = "und"

_LETTERS = re.compile(r"[^\W\d_]+")


def words(text: str | None) -> list[str]:
    return _LETTERS.findall(text.lower()) if text else []


def grams(word: str, n: int) -> list[str]:
    edged = f"^{word}$"
    return [edged[i : i + n] for i in range(len(edged) - n + 1)]


def counted_words(training: DataFrame) -> DataFrame:
    """Per (entry, lang): n. Tasks add up their words in bounded dictionaries; only words are shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, Counter] = {}

        def out() -> pa.RecordBatch:
            entries = [w for seen in found.values() for w in seen]
            langs = [lang for lang, seen in found.items() for _ in seen]
            times = [n for seen in found.values() for n in seen.values()]
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(entries, pa.string()), pa.array(langs, pa.string()), pa.array(times, pa.int64())], ["entry", "lang", "n"])

        for b in batches:
            for text, lang in zip(b.column("text"), b.column("lang").to_pylist(), strict=True):
                found.setdefault(lang, Counter()).update(words(text.as_py()))
                if sum(map(len, found.values())) > TASK_ENTRIES:
                    yield out()
        yield out()

    rows = training.where("lang is not null and text is not null").select("text", "lang")
    return rows.mapInArrow(count, "entry string, lang string, n bigint").groupBy("entry", "lang").agg(F.sum("n").alias("n"))


def counted_grams(counts: DataFrame, lengths: tuple[int, ...]) -> DataFrame:
    """Per (kind, entry, lang): n of the n-grams, from each distinct (word, lang) once: their counts are sums of its count."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, str], Counter] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for (k, lang), seen in found.items():
                m = len(seen)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k] * m, pa.int32()), pa.array(seen, pa.string()), pa.array([lang] * m, pa.string()), pa.array(seen.values(), pa.int64())], ["kind", "entry", "lang", "n"]
                )
            found.clear()

        for b in batches:
            for word, lang, n in zip(*(b.column(c).to_pylist() for c in ("entry", "lang", "n")), strict=True):
                for k in lengths:
                    seen = found.setdefault((k, lang), Counter())
                    for g in grams(word, k):
                        seen[g] += n
            if sum(map(len, found.values())) > TASK_ENTRIES:
                yield from out()
        yield from out()

    rows = counts.mapInArrow(cut, "kind int, entry string, lang string, n bigint")
    return rows.groupBy("kind", "entry", "lang").agg(F.sum("n").alias("n"))


class Known(NamedTuple):
    """The most frequent words and their rows of logs by language."""

    words: pa.Array
    logs: np.ndarray


class Model(NamedTuple):
    """Languages, the words that go to all executors, and the table of all entries: kind, entry, logs by language.

    Kind 0 is a word, another kind the length of an n-gram.
    """

    langs: list[str]
    lengths: tuple[int, ...]
    known: Known
    entries: DataFrame | None


def fit(training: DataFrame, lengths: tuple[int, ...] = LENGTHS) -> Model:
    """What comes to the driver: totals, and the words that go to all executors, packed in one matrix."""
    from holdfast.plans.storage import stored

    own = stored(counted_words(training), "language-words")
    counts = own.select(F.lit(0).alias("kind"), "entry", "lang", "n").unionAll(stored(counted_grams(own, lengths), "language-grams"))
    totals = {(r["kind"], r["lang"]): r["n"] + r["types"] for r in counts.groupBy("kind", "lang").agg(F.sum("n").alias("n"), F.count("*").alias("types")).collect()}
    langs = sorted({lang for _, lang in totals})
    if not langs:
        return Model([], lengths, Known(pa.array([], pa.string()), np.zeros((0, 0))), None)
    base = {kind: [math.log(totals.get((kind, x), 0) + 1) for x in langs] for kind in (0, *lengths)}
    by = [F.coalesce(F.sum(F.when(F.col("lang") == x, F.col("n"))), F.lit(0)).alias(f"n{i}") for i, x in enumerate(langs)]
    less = F.create_map(*[x for kind, logs in base.items() for x in (F.lit(kind), F.array(*map(F.lit, logs)))])
    logs = F.zip_with(F.array(*[F.log(F.col(f"n{i}") + F.lit(0.5)) for i in range(len(langs))]), less[F.col("kind")], lambda a, b: a - b)
    every = F.lit(0)
    for i in range(len(langs)):
        every = every + F.col(f"n{i}")
    entries = stored(counts.groupBy("kind", "entry").agg(*by).select("kind", "entry", every.alias("all"), logs.alias("logs")), "language-entries")
    most = min(KNOWN_WORDS, KNOWN_CELLS // len(langs))
    top = entries.where("kind = 0").orderBy(F.desc("all"), "entry").limit(most).select("entry", "logs").toArrow().combine_chunks()
    matrix = top.column("logs").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, len(langs))
    return Model(langs, lengths, Known(top.column("entry").combine_chunks(), matrix), entries)


def resolved(model: Model, distinct: DataFrame) -> DataFrame:
    """word, logs: of each word by its own counts, or the mean over its known n-grams of the longest length it has."""
    from holdfast.plans.storage import stored

    own = model.entries.where("kind = 0").select(F.col("entry").alias("word"), "logs")
    looked_up = stored(distinct.join(own, "word", "left"), "language-found")
    logs, unseen = looked_up.where("logs is not null"), looked_up.where("logs is null").select("word")
    edged = F.concat(F.lit("^"), F.col("word"), F.lit("$"))
    for k in model.lengths:  # the longest first; only words without a known n-gram of it go on
        places = F.filter(F.sequence(F.lit(1), F.greatest(F.char_length(edged) - (k - 1), F.lit(1))), lambda i: i + (k - 1) <= F.char_length(edged))
        pieces = unseen.select("word", F.explode(F.transform(places, lambda i: F.substring(edged, i, F.lit(k)))).alias("entry"))
        found = pieces.join(model.entries.where(F.col("kind") == k).select("entry", "logs"), "entry")
        means = F.array(*[F.avg(F.col("logs")[i]) for i in range(len(model.langs))])
        own = stored(found.groupBy("word").agg(means.alias("logs")), "language-backed-off")
        logs, unseen = logs.unionByName(own), unseen.join(own.select("word"), "word", "left_anti")
    return logs


_KNOWN: dict[str, dict[str, int]] = {}


def known_of(key: str, known: Known) -> dict[str, int]:
    """The row of each known word; made once in each Python worker, only the last one is kept."""
    if key not in _KNOWN:
        _KNOWN.clear()
        _KNOWN[key] = {w: i for i, w in enumerate(known.words.to_pylist())}
    return _KNOWN[key]


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """Per row: doc_id, lang_pred, score."""
    from holdfast.plans.storage import stored

    key, sent, size = uuid.uuid4().hex, docs.sparkSession.sparkContext.broadcast(model.known), len(model.langs)
    kind = docs.schema["doc_id"].dataType.simpleString()
    if not size:
        return docs.select("doc_id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, logs, row = known_of(key, sent.value), sent.value.logs, TaskContext.get().partitionId() << 40
        names = ["row", "doc_id", "letters", "sums", "word", "times"]
        for b in batches:
            letters, sums, left = [], [], []
            for k, t in enumerate(b.column("text")):
                counts = Counter(words(t.as_py()))
                letters.append(any(c.isalpha() for w in counts for c in w))
                pairs = [(known.get(w), n) for w, n in counts.items()]
                rows = [x for x, _ in pairs if x is not None]
                sums.append((np.array([n for x, n in pairs if x is not None], float) @ logs[rows]).tolist() if rows else [0.0] * size)
                if len(rows) < len(pairs):
                    left += [(row + k, w, n) for (w, n), (x, _) in zip(counts.items(), pairs, strict=True) if x is None]
            n = b.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(range(row, row + n), pa.int64()), b.column("doc_id"), pa.array(letters, pa.bool_()), pa.array(sums, pa.list_(pa.float64())), pa.nulls(n, pa.string()), pa.nulls(n, pa.int64())], names)
            row += n
            for k in range(0, len(left), 65_536):
                part = left[k : k + 65_536]
                m = len(part)
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in part], pa.int64()), pa.nulls(m, b.column("doc_id").type), pa.nulls(m, pa.bool_()), pa.nulls(m, pa.list_(pa.float64())), pa.array([x[1] for x in part], pa.string()), pa.array([x[2] for x in part], pa.int64())], names)

    schema = f"row bigint, doc_id {kind}, letters boolean, sums array<double>, word string, times bigint"
    found = stored(docs.select("doc_id", "text").mapInArrow(run, schema), "language-sums")
    rest = found.where("word is not null").select("row", "word", "times")
    logs = resolved(model, rest.select("word").distinct())
    more = rest.join(logs, "word").groupBy("row").agg(F.array(*[F.sum(F.col("times") * F.col("logs")[k]) for k in range(size)]).alias("more"))
    rows = found.where("word is null").select("row", "doc_id", "letters", "sums").join(more, "row", "left")
    total = F.coalesce(F.zip_with("sums", "more", lambda a, b: a + b), F.col("sums"))
    rows = rows.select("doc_id", "letters", total.alias("total")).withColumn("best", F.array_max("total"))
    share = 1 / F.aggregate("total", F.lit(0.0), lambda a, x: a + F.exp(F.greatest(x - F.col("best"), F.lit(-700.0))))
    names = F.array(*map(F.lit, model.langs))
    pred = F.when(F.col("letters"), F.element_at(names, F.array_position("total", F.col("best")).cast("int"))).otherwise(UNKNOWN)
    return rows.select("doc_id", pred.alias("lang_pred"), F.when(F.col("letters"), share).otherwise(0.0).alias("score"))


def keep_known(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """Rows of ``docs``, with their own columns, whose language is told with a score of ``least`` or more.

    Rows of files are known by file and place in it. Rows that come from anything else are numbered in a copy.
    """
    from holdfast.plans.storage import stored

    at = free_name(docs, "_language_row")
    try:
        numbered = docs.withColumn(at, F.struct("_metadata.file_path", "_metadata.row_index"))
    except AnalysisException:
        numbered = stored(docs.withColumn(at, F.monotonically_increasing_id()), "language-rows")
    told = predict(numbered.select(F.col(at).alias("doc_id"), "text"), model)
    good = told.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)).select(F.col("doc_id").alias(at))
    return numbered.join(good, at, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])


def held_out(fold: int = 2, folds: int = 4) -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == fold, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """Learn on the rows that are not held out, predict all rows."""
    model = fit(docs.select("doc_id", "text", "lang").where(~held_out()))
    return predict(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
