"""The queries over the driver's tables, with production parameters, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, fim, fmindex, licenses, lines, minhash, packing, pii, quality, secrets, sql, suffix, toxicity
from .storage import documents


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item_id, distance, budget, item_chars, end: documents and the benchmark items that they hold."""
    return decontaminate.contaminated(documents(spark, sf_dir), _table(spark, sf_dir, "benchmark"))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: components of documents with 85 % of their 3-word shingles in common."""
    return minhash.near_duplicates(documents(spark, sf_dir), width=3, percent=85)


def op3_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256: documents without 50-byte strings of smaller doc_ids."""
    return suffix.remove_repeated_bytes(documents(spark, sf_dir), keep_text=False).drop("kept")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, digest, license_id, notice_ids: the licence whose text a document is, and those that its lines name."""
    return licenses.scan(documents(spark, sf_dir), licenses.catalogue(spark))


def op5_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of documents in sequences of at most 2048 tokens, along the Hilbert curve."""
    return packing.pack(documents(spark, sf_dir), *tokenizer_files(), keep_ids=False).drop("ids")


def op6_repeated_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256: documents without 13-word windows of smaller doc_ids."""
    return fmindex.remove_repeated_words(documents(spark, sf_dir), keep_text=False).drop("kept")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base verdict, divergences and the verdict of every document."""
    return quality.quality(documents(spark, sf_dir))


def op8_boilerplate_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_removed, kept_sha256: documents without the lines that stand on many sites."""
    return lines.clean_lines(documents(spark, sf_dir)).selectExpr("doc_id", "n_lines", "n_removed", "sha2(text, 256) AS kept_sha256")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the chain's probabilities and the verdict of every document, by a chain fitted on labelled ones."""
    docs = documents(spark, sf_dir)
    return toxicity.score(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, counts and digest of base spans, and all spans with those that the field adds."""
    docs = documents(spark, sf_dir)
    return pii.find(docs, pii.fit(docs))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and digests of every document's output and of the text rebuilt from it."""
    output, form = F.col("output"), F.col("form")
    digests = (F.sha2(output, 256).alias("output_sha256"), F.sha2(fim.restored(output, form), 256).alias("restored_sha256"))
    made = fim.transform(documents(spark, sf_dir))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


def op12_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, counts and digest of base spans, and the spans of all rules."""
    counts = (F.col("counts")[i].alias(f"n_{rule.kind}") for i, rule in enumerate(secrets.BASE))
    found = secrets.find(documents(spark, sf_dir))
    return found.select("doc_id", *counts, F.sha2("base", 256).alias("base_sha256"), "spans", "n_added")


def tokenizer_files() -> tuple[str, str]:
    """The installed public tokenizer's file, and its ranks."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    first = (op1_decontaminate, op2_near_duplicates, op3_repeated_bytes, op4_license_scan, op5_pack, op6_repeated_words)
    then = (op7_quality, op8_boilerplate_lines, op9_toxicity, op10_personal_data, op11_fill_in_middle, op12_secrets)
    return {f.__name__: f for f in first + then} | {"pipeline": corpus_pipeline.run}


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _canonical_sql(column: str) -> str:
    out = f"regexp_replace(lower({column}), {_quoted(licenses.COPYRIGHT)}, '', 'g')"
    for old, new in licenses.SPELLINGS:
        out = f"replace({out}, {_quoted(old)}, {_quoted(new)})"
    return f"regexp_replace({out}, '[^a-z0-9\n]+', ' ', 'g')"


def op4_sql() -> str:
    rows = ", ".join(f"({_quoted(i)}, {_quoted(t)})" for i, t in licenses.KNOWN)
    whole = "trim(regexp_replace({}, '[ \n]+', ' ', 'g'), ' ')"
    return f"""
WITH known AS (
  SELECT sha256({whole.format("c")}) AS digest, min(license_id) AS license_id
  FROM (SELECT license_id, {_canonical_sql("text")} AS c FROM (VALUES {rows}) v(license_id, text)) GROUP BY 1),
docs AS (SELECT doc_id, {_canonical_sql("text")} AS c FROM documents),
digests AS (SELECT doc_id, sha256({whole.format("c")}) AS digest, c FROM docs),
notices AS (
  SELECT l.doc_id, string_agg(DISTINCT k.license_id, ',' ORDER BY k.license_id) AS notice_ids
  FROM (SELECT doc_id, trim(unnest(string_split(c, chr(10))), ' ') AS line FROM docs) l
  JOIN known k ON k.digest = sha256(l.line) WHERE l.line <> '' GROUP BY 1)
SELECT d.doc_id, d.digest, k.license_id, coalesce(n.notice_ids, '') AS notice_ids
FROM digests d LEFT JOIN known k ON k.digest = d.digest LEFT JOIN notices n ON n.doc_id = d.doc_id"""


def op8_sql() -> str:
    bare = "trim({}, ' ' || chr(9) || chr(13) || chr(12) || chr(11))"
    return f"""
WITH lines AS (
  SELECT doc_id, source, generate_subscripts(string_split(text, chr(10)), 1) AS i, unnest(string_split(text, chr(10))) AS line FROM documents),
bare AS (SELECT *, {bare.format("line")} AS b FROM lines),
gone AS (SELECT b FROM bare WHERE b <> '' GROUP BY b HAVING count(DISTINCT source) >= {lines.LEAST_SITES}),
marked AS (SELECT bare.*, gone.b IS NOT NULL AS removed FROM bare LEFT JOIN gone ON gone.b = bare.b)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (removed) AS n_removed,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT removed), '')) AS kept_sha256
FROM marked GROUP BY doc_id"""


def oracle_sql() -> dict[str, str]:
    return {
        "op2_near_duplicates": sql.near_duplicates(),
        "op3_repeated_bytes": sql.repeated_bytes(),
        "op4_license_scan": op4_sql(),
        "op6_repeated_words": sql.repeated_words(),
        "op8_boilerplate_lines": op8_sql(),
        "op11_fill_in_middle": sql.fill_in_middle(),
        "op12_secrets": sql.secret_spans(secrets.RULES, len(secrets.BASE)),
    }
