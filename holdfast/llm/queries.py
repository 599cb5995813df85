"""The corpus queries over the standard tables. Digest columns are derived here; operators keep their own results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(function: Callable) -> Callable:
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op1_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    from holdfast.llm.tokencount import count_tokens

    return count_tokens(table(spark, folder, "documents"), tokenizer_file("piece_bpe_32k.model"))


@query
def op3_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    from holdfast.llm.decontaminate import digest, find_hits

    return digest(find_hits(table(spark, folder, "documents"), table(spark, folder, "benchmark")))


@query
def op5_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    from holdfast.llm.packing import pack_documents

    return pack_documents(table(spark, folder, "documents"), tokenizer_file("word_bpe_49k.json"))


@query
def op6_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    from holdfast.llm.rules import digest

    return digest(table(spark, folder, "documents"))


@query
def op9_chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    from holdfast.llm.chat import digest, format_chats

    said = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string")
    return digest(format_chats(table(spark, folder, "conversations").select(*extra.columns).unionAll(extra)))


@query
def op2_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    from holdfast.llm.quality_fm import classify

    return classify(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query
def op8_language_id(spark: SparkSession, folder: str) -> DataFrame:
    from holdfast.llm.langid import identify

    return identify(table(spark, folder, "documents"))


@query
def op10_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    from holdfast.llm.neardup import group

    return group(table(spark, folder, "documents"), shingle=2)


@query
def op4_main_text(spark: SparkSession, folder: str) -> DataFrame:
    from holdfast.llm.htmltext import main_text

    return main_text(table(spark, folder, "pages"))


@query
def op7_window_lm(spark: SparkSession, folder: str) -> DataFrame:
    from holdfast.llm.lm import score_documents

    return score_documents(table(spark, folder, "documents"))


@query
def op11_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    from holdfast.llm.periodic import digest, find_runs

    return digest(find_runs(with_planted_runs(table(spark, folder, "documents"))))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id and text; where crc32(doc_id) mod 10 is 0, the words from place a on repeat with period p."""
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g, n = F.floor(h / 10), F.greatest(F.size("words"), F.lit(1)).cast("bigint")
    chosen = docs.select("doc_id", "text", F.when(h % 10 == 0, words).alias("words"), g.alias("g"), n.alias("n"))
    placed = chosen.withColumn("a", F.pmod("g", "n")).withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    a, p, n = (F.col(c).cast("int") for c in "apn")
    repeats = F.flatten(F.array_repeat(F.slice("words", a + 1, p), F.ceil((n - a) / p).cast("int")))
    planted = F.concat(F.slice("words", F.lit(1), a), F.slice(repeats, F.lit(1), n - a))
    return placed.select("doc_id", F.when(F.size("words") > 0, F.array_join(planted, " ")).otherwise(F.col("text")).alias("text"))


@query
def op12_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    from holdfast.llm.lexical import rank_documents

    return rank_documents(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


TERMS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

SQL["op12_lexical_search"] = f"""
WITH doc_terms AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERMS}')) AS term FROM documents
), sizes AS (SELECT doc_id, count(*) AS n FROM doc_terms GROUP BY doc_id
), totals AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM sizes
), item_terms AS (
  SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERMS}')) AS term FROM benchmark
), asked AS (SELECT item_id, term, count(*) AS times FROM item_terms GROUP BY item_id, term
), counts AS (
  SELECT doc_id, term, count(*) AS tf FROM doc_terms WHERE term IN (SELECT term FROM asked) GROUP BY doc_id, term
), weights AS (
  SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM counts, totals GROUP BY term, docs
), scored AS (
  SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + ((25 * n * docs) // terms)))))::BIGINT AS score
  FROM counts JOIN sizes USING (doc_id) JOIN weights USING (term) JOIN asked USING (term), totals
  GROUP BY item_id, doc_id
)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INT AS rank, doc_id, score
FROM scored WHERE score > 0
QUALIFY rank <= 20
"""


@query
def op13_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    from holdfast.llm.urlfilter import judge

    rules = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
    return judge(table(spark, folder, "pages"), spark.createDataFrame(rules, "host string, path string, verdict string"))


WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

SQL["op3_decontamination"] = f"""
WITH d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORDS}'), []) AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORDS}') AS w FROM benchmark
), bw AS (SELECT item_id, w, least(10, len(w)) AS n FROM b WHERE len(w) > 0
), wanted AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS gram FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM bw)
), places AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw)
), hits AS (
  SELECT doc_id, i, p.n, item_id FROM (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS gram FROM places) p JOIN wanted q ON p.n = q.n AND p.gram = q.gram
), covered AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS place FROM hits) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""

SQL["op9_chat_formatting"] = r"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), sized AS (
  SELECT *, 15 + length(role) + length(text) + length(regexp_replace(role, '[^\\#<:]', '', 'g')) + length(regexp_replace(text, '[^\\#<]', '', 'g')) AS chars FROM said
), told AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
    coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss, sum(chars)::BIGINT AS formatted_chars,
    string_agg(role || ' ', '' ORDER BY turn, role, text) AS roles
  FROM sized GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars,
  regexp_full_match(roles, '(system )?user (assistant user )*(assistant )?') AS well_formed
FROM told
"""


@query
def quality_base_measures(spark: SparkSession, folder: str) -> DataFrame:
    """What the quality rules measure of every text, before any vote."""
    from holdfast.llm.rules import base_failed, measured

    rows = measured(table(spark, folder, "documents")).withColumn("base_failed", base_failed())
    return rows.select("_row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


SQL["quality_base_measures"] = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), grams AS (
  SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d)
), again AS (
  SELECT doc_id, i FROM grams QUALIFY count(*) OVER (PARTITION BY doc_id, gram) > 1
), covered AS (SELECT doc_id, count(DISTINCT place) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + 8)) AS place FROM again) GROUP BY doc_id
), m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM d LEFT JOIN covered USING (doc_id)
)
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m
"""
