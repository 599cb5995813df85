"""Quality rules as weak supervision: rules vote or abstain, expectation-maximisation weighs them.

Each rule is a pair of conditions on measures of a text: one votes for quality, one against, neither abstains. The
table is combined to one row per vote pattern (at most 3 to the number of rules, so bounded); on these rows
expectation-maximisation estimates how often each rule that votes does so either way on good and on bad documents, and
the share of good ones; an abstention says nothing. The posterior probability of quality given the votes is then a small lookup by pattern. Everything
on the way is DataFrame functions; the driver sees pattern counts only.

Defined results: a null text is an empty one: it has no words and fails the base; an empty table gives no rows; each of
repeated rows gets its own result; extra columns travel inside ``_row`` and :func:`keep_good` returns them as they were.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.plans.storage import stored

MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
THRESHOLD = 0.5
ROUNDS = 40
#: What is held of good texts before any is seen: how often a rule that votes votes against them, worth as many votes as
#: the table has texts. A Beta prior: the estimate moves with the data.
AGAINST_GOOD, PRIOR_WORTH = 0.002, 1.0
SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
#: Ends of sentences in the scripts that have one; a text without any says nothing about its sentences.
STOPS = ".?!。．？！｡।॥؟۔።፧၊။។៕։᙮༎"

#: ASCII characters that are neither symbol nor stop. A class of ASCII alone is one table in the regular expression
#: engine; one with characters beyond is tried part by part, so it only gets to see what this leaves.
PLAIN = r"[\x00-\x20\x22\x27-\x29\x2B-\x2D\x2F-\x3B\x3D\x40-\x7B\x7D-\x7F]+"

#: (name, condition of a vote for, condition of a vote against), over the names of :func:`measured`.
RULES: list[tuple[str, str, str]] = [
    ("few symbols", "100 * n_symbols <= n_words", "10 * n_symbols > n_words"),
    ("few repeated windows", "100 * n_repeat_words <= 20 * n_words", "100 * n_repeat_words > 28 * n_words"),
    ("few repeated lines", "4 * n_dup_lines <= n_lines", "2 * n_dup_lines > n_lines"),
    ("lower case", "4 * n_upper <= word_chars", "2 * n_upper > word_chars"),
    ("no shouting", "100 * n_marks <= n_words", "10 * n_marks > n_words"),
    ("word length", "word_chars between 3 * n_words and 8 * n_words", "word_chars not between 2 * n_words and 12 * n_words"),
    ("sentences", "n_stops > 0 and n_words <= 40 * n_stops", "n_stops > 0 and n_words > 120 * n_stops"),
    ("varied words", "2 * n_distinct >= n_words or n_words > 400 and n_distinct > 150", "10 * n_distinct < n_words"),
]


def measured(docs: DataFrame) -> DataFrame:
    """``docs`` as one struct column ``_row``, with the measures of its text beside it.

    Windows of eight words are compared by a hash built from their word hashes in three doublings (64 bits within one
    text), so that time and memory grow with the length of a text alone.
    """

    def doubled(h: Column, step: int) -> Column:
        n = F.greatest(F.size(h) - step, F.lit(0))
        return F.zip_with(F.slice(h, F.lit(1), n), F.slice(h, F.lit(step + 1), n), lambda a, b: F.xxhash64(a, b))

    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    base = own.select("_row", F.coalesce(F.col("_row.text"), F.lit("")).alias("_text"))
    split = base.withColumn("_signs", F.regexp_replace(F.regexp_replace("_text", PLAIN, ""), f"[^{SYMBOLS}{STOPS}]+", "")).withColumn("_words", F.filter(F.split("_text", SPACE), lambda w: w != "")).withColumn(
        "_lines", F.filter(F.split("_text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    )
    hashed = split.withColumn("_h", F.transform("_words", lambda w: F.xxhash64(w)))
    for step in (1, 2, 4):
        hashed = hashed.withColumn("_w" if step == 4 else f"_h{step}", doubled(F.col("_h" if step == 1 else f"_h{step // 2}"), step))
    twice = F.expr("size(_w) > size(array_distinct(_w))")
    # windows sorted by (hash, place); those with an equal neighbour occur twice or more; each covers the words up to
    # eight from its place, or up to the next one
    ordered = F.sort_array(F.transform("_w", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    count = lambda chars: (F.char_length("_signs") - F.char_length(F.translate("_signs", chars, ""))).cast("bigint")
    found = hashed.withColumn("_o", F.when(twice, ordered)).withColumn(
        "_at",
        F.expr(
            """array_sort(transform(filter(transform(_o, (x, k) -> struct(x.i as i,
                 (k > 0 and _o[k - 1].h = x.h) or (k + 1 < size(_o) and _o[k + 1].h = x.h) as again)), y -> y.again), y -> y.i))"""
        ),
    )
    covered = F.expr("coalesce(aggregate(transform(_at, (p, k) -> if(k + 1 < size(_at), least(8, _at[k + 1] - p), 8)), 0L, (a, x) -> a + x), 0L)")
    result = F.struct(
        F.size("_words").cast("bigint").alias("n_words"),
        F.char_length(F.array_join("_words", "")).cast("bigint").alias("word_chars"),
        count(SYMBOLS).alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
        covered.alias("n_repeat_words"),
        F.size("_lines").cast("bigint").alias("n_lines"),
        F.size(F.array_distinct("_h")).cast("bigint").alias("n_distinct"),
        F.char_length(F.regexp_replace("_text", r"[^\p{Lu}]+", "")).cast("bigint").alias("n_upper"),
        count("!").alias("n_marks"),
        count(STOPS).alias("n_stops"),
    )
    # out of a generator, no later filter or rule can be pushed into (and so repeat) the work on arrays
    return found.select("_row", F.inline(F.array(result)))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (F.lit(100) * F.col("n_repeat_words") > F.lit(MAX_REPEAT_PERCENT) * F.col("n_words"))


def pattern(rules: list[tuple[str, str, str]] = RULES) -> Column:
    """The votes of all rules as text: + for, - against, 0 abstains."""
    return F.concat(*[F.when(F.expr(good), "+").when(F.expr(bad), "-").otherwise("0") for _, good, bad in rules])


def posteriors(counts: dict[str, int], rounds: int = ROUNDS) -> dict[str, float]:
    """Probability of quality for each vote pattern, by expectation-maximisation over pattern counts.

    The first guess takes any vote against for a probable sign of a bad text, so that the classes cannot change places;
    each estimate starts from a count of one for every outcome, so that no probability becomes zero, and for good texts
    from the prior besides.
    """
    good = {v: 0.1 if "-" in v else 0.9 for v in counts}
    for _ in range(rounds):
        total = sum(counts.values())
        share = (1 + sum(counts[v] * good[v] for v in counts)) / (2 + total)
        tables = []
        for k in range(len(next(iter(counts), ""))):
            worth = PRIOR_WORTH * total
            own = {("+", 0): 1.0, ("-", 0): 1.0, ("+", 1): 1.0 + (1 - AGAINST_GOOD) * worth, ("-", 1): 1.0 + AGAINST_GOOD * worth}
            for v, n in counts.items():
                if v[k] != "0":
                    own[v[k], 1] += n * good[v]
                    own[v[k], 0] += n * (1 - good[v])
            sums = [own["+", side] + own["-", side] for side in (0, 1)]
            tables.append({"0": 0.0} | {s: math.log(own[s, 1] / sums[1]) - math.log(own[s, 0] / sums[0]) for s in "+-"})
        prior = math.log(share) - math.log(1 - share)
        good = {v: 1 / (1 + math.exp(-max(-500.0, min(500.0, prior + sum(t[s] for t, s in zip(tables, v, strict=True)))))) for v in counts}
    return good


def judged(measures: DataFrame, rules: list[tuple[str, str, str]] = RULES, threshold: float = THRESHOLD) -> DataFrame:
    """``measures`` (from :func:`measured`) with base_failed, votes, quality (posterior probability) and kept.

    Accuracies are estimated on the documents that pass the base, all of them. The measures are read twice: store them
    first where that costs less than measuring again.
    """
    rows = measures.withColumn("base_failed", base_failed()).withColumn("votes", pattern(rules))
    counts = {r["votes"]: r["n"] for r in rows.groupBy("base_failed", "votes").agg(F.count("*").alias("n")).collect() if not r["base_failed"]}
    good = posteriors(counts)
    lookup = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for v in sorted(good) for x in (v, good[v])]), F.col("votes")), F.lit(0.0)) if good else F.lit(0.0)
    quality = F.when(F.col("base_failed"), F.lit(0.0)).otherwise(lookup)
    return rows.withColumn("quality", quality).withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold))


def keep_good(docs: DataFrame, rules: list[tuple[str, str, str]] = RULES, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that are kept, with their own columns."""
    return judged(measured(docs), rules, threshold).where("kept").select("_row.*")


def digest(docs: DataFrame) -> DataFrame:
    """Measures and verdict of every text. Measures are a few numbers a text, so they are written once."""
    measures = measured(docs)
    slim = stored(measures.select(F.col("_row.doc_id").alias("doc_id"), *measures.columns[1:]), "measures")
    return judged(slim).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality", "votes")
