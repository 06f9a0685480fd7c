"""The registered queries of this subpackage: each applies its operator to a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, decontaminate, jaccard_join, lattice_lm, license_scan, mixing, nbsvm, quality_cascade, token_attribution, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_attribution.attribute_tokens(_table(spark, sf_dir, "documents"), rule="majority").withColumn("n_tokens", F.col("n_tokens").cast("long"))


def op2_lattice_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_lm.lattice_scores(_table(spark, sf_dir, "documents"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(_table(spark, sf_dir, "documents")).withColumn("paragraph", F.col("paragraph").cast("long"))


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.benchmark_hits(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = "\\### Assistant: </turn> ok"
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-7, 0, "user", own), (-7, 1, "assistant", own)], "conv_id long, turn long, role string, text string")
    chats = chat_format.format_chats(rows.unionByName(more))
    read = chats.withColumn("turns", chat_format.read_turns(F.col("formatted"))).withColumn("learnt", chat_format.loss_text(F.col("segments")))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"), F.length("learnt").cast("long").alias("loss_chars"),
                       F.sha2("learnt", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


def op6_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    always = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    judged = quality_cascade.quality_cascade(_table(spark, sf_dir, "documents"), always=always)
    return judged.select("doc_id", *always, ((F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))).alias("base_failed"), "kept")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), threshold=0.5)


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nbsvm.quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), threshold=0.3)


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {f.__name__: f for f in (op1_token_attribution, op2_lattice_likelihood, op3_license_scan, op4_benchmark_decontamination, op5_chat_format, op6_quality_cascade, op7_toxicity, op8_jaccard_join, op9_quality_classifier, op10_source_mix)}

_WORD = r"[^\x20\x09-\x0D]+"
ORACLE_SQL = {
    "op5_chat_format": r"""
        WITH rows AS (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations
                      UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
        sized AS (SELECT *, length(t) + length(t) - length(replace(t, '\', '')) + (length(t) - length(replace(t, '</turn>', ''))) // 7
                         + length(t) - length(replace(t, '#', '')) - len(regexp_extract_all(t, '#+')) AS n FROM rows)
        SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(r || chr(10) || t || chr(10), '' ORDER BY turn, r, t)) AS turns_sha256,
               coalesce(sum(length(t)) FILTER (r = 'assistant'), 0)::BIGINT AS loss_chars,
               sha256(coalesce(string_agg(t, '' ORDER BY turn, r, t) FILTER (r = 'assistant'), '')) AS loss_sha256,
               sum(4 + length(r) + 2 + n + 8)::BIGINT AS formatted_chars
        FROM sized GROUP BY conv_id""",
    "op6_quality_cascade": rf"""
        WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        base AS (SELECT doc_id, t, regexp_extract_all(t, '{_WORD}') AS w FROM texts),
        places AS (SELECT doc_id, unnest(range(1, len(w) - 6)) AS i, w FROM base WHERE len(w) >= 8),
        runs AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(w[i:i + 7], ' ')) AS n FROM places),
        covered AS (SELECT doc_id, count(DISTINCT i + j) AS n_repeat FROM runs, range(0, 8) AS x(j) WHERE n >= 2 GROUP BY doc_id),
        lines AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM texts),
        line_counts AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup FROM lines WHERE regexp_matches(line, '{_WORD}') GROUP BY doc_id),
        stats AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
                         coalesce(n_dup, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat, 0)::BIGINT AS n_repeat_words, coalesce(n_lines, 0) AS n_lines,
                         length(regexp_replace(t, '[^A-Z]', '', 'g')) AS upper, length(regexp_replace(t, '[^a-z]', '', 'g')) AS low
                  FROM base LEFT JOIN covered USING (doc_id) LEFT JOIN line_counts USING (doc_id)),
        judged AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM stats)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
               NOT (base_failed OR 10 * n_symbols > 3 * n_words OR 10 * n_dup_lines > 3 * n_lines OR word_chars > 20 * n_words OR word_chars < 2 * n_words OR upper > low) AS kept
        FROM judged""",
    "op8_jaccard_join": rf"""
        WITH RECURSIVE base AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS w FROM documents),
        shingles AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM base WHERE len(w) > 0)),
        sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
        both_ways AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
        links AS (SELECT a, b FROM both_ways JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
        reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
        SELECT d.doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, min(b)::BIGINT AS component_id
        FROM documents d JOIN reach ON a = d.doc_id LEFT JOIN sizes USING (doc_id) GROUP BY d.doc_id""",
}
