"""The jobs as queries: each run twice into a new folder under spark.checkpoint.dir, and their output read back."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import panel_update, text_release
from tessera.operators.models import root_of
from tessera.plans.catalog import NUDGE
from tessera.plans.sql import BIND

PANEL = ("simple_id", "ord", "gbja", "ge", "entgelt", "rtzb", "code", "death_year", "rehab", "msk", "cum_rehab", "cum_msk")
PANEL += ("last_rehab", "years_since_rehab", "exposed_since", "death_conflict", "ja")


def _folder(spark: SparkSession, name: str) -> str:
    return f"{root_of(spark)}/{name}-{uuid.uuid4().hex}"


def job1_panel_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel of all order years; the second run finds no new year."""
    out = _folder(spark, "job1")
    for _ in range(2):
        panel_update.run(spark, f"{sf_dir}/orders.parquet", out)
    return panel_update.panel_of(spark, out).select(*PANEL)


def job2_text_release(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The released tables about all documents; the second run finds no new file."""
    out = _folder(spark, "job2")
    for _ in range(2):
        text_release.run(spark, f"{sf_dir}/documents.parquet", f"{sf_dir}/labels.parquet", out, f"{out}/checkpoint")
    rounded = F.round(F.col("value") + F.lit(NUDGE), 4).alias("value")
    return spark.read.parquet(f"{out}/export").select("section", "lang", "cell", "statistic", rounded, "status")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (job1_panel_update, job2_text_release)}


JOB1 = f"""
WITH {BIND.split("bind_panel AS")[0]}
known AS (
  SELECT *, (code IS NOT NULL)::INT AS rehab, coalesce((code = 20)::INT, 0) AS msk,
    (simple_id % 6 = 0 AND ja >= 1998 + CAST(floor(simple_id / 6) AS BIGINT) % 3) AS exposed FROM bind_dedup)
SELECT simple_id, ja, ord, gbja, ge, entgelt, rtzb, code, death_year, rehab, msk,
  CAST(sum(rehab) OVER h AS BIGINT) AS cum_rehab, CAST(sum(msk) OVER h AS BIGINT) AS cum_msk,
  max(CASE WHEN rehab = 1 THEN ja END) OVER h AS last_rehab, ja - max(CASE WHEN rehab = 1 THEN ja END) OVER h AS years_since_rehab,
  min(CASE WHEN exposed THEN ja END) OVER h AS exposed_since,
  coalesce(min(death_year) OVER h <> max(death_year) OVER h, false) AS death_conflict
FROM known WINDOW h AS (PARTITION BY simple_id ORDER BY ja ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""

LEAST = text_release.Parameters().least
JOB2 = f"""
WITH docs AS (
  SELECT doc_id, coalesce(lang, '__MISSING__') AS lang, coalesce(source, '__MISSING__') AS source, length(text) AS chars,
    len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS words FROM documents WHERE doc_id IS NOT NULL),
per AS (SELECT lang, source, count(*) AS n FROM docs GROUP BY ALL),
few AS (SELECT lang, count(*) FILTER (n < {LEAST}) AS small FROM per GROUP BY 1),
ranked AS (
  SELECT per.*, small, row_number() OVER (PARTITION BY per.lang ORDER BY n < {LEAST}, n, source) AS r FROM per JOIN few USING (lang)),
pools AS (SELECT lang, source, n, n < {LEAST} OR (small = 1 AND r = 1) AS pooled FROM ranked),
sources AS (
  SELECT lang, CASE WHEN pooled THEN 'pooled' ELSE source END AS cell, pooled, sum(n) AS n FROM pools GROUP BY ALL),
cells AS (
  SELECT 'lengths' AS section, lang, CASE WHEN words IS NULL THEN '__MISSING__' WHEN words >= 1000 THEN '1000+'
    WHEN words >= 100 THEN '100+' WHEN words >= 10 THEN '10+' WHEN words >= 1 THEN '1+' ELSE '0+' END AS cell, count(*) AS n
  FROM docs GROUP BY ALL
  UNION ALL
  SELECT 'ratings', lang, 'quality ' || coalesce(CAST(quality AS VARCHAR), '__MISSING__') || ', toxic ' ||
    coalesce(CAST(toxic AS VARCHAR), '__MISSING__'), count(*) FROM docs LEFT JOIN labels USING (doc_id) GROUP BY ALL),
hid AS (SELECT *, n < {LEAST} AS h, count(*) FILTER (n < {LEAST}) OVER (PARTITION BY section, lang) AS hs FROM cells),
least_told AS (SELECT section, lang, arg_min(cell, (n, cell)) AS cell FROM hid WHERE NOT h GROUP BY ALL),
told AS (
  SELECT hid.section, hid.lang, hid.cell, n, CASE WHEN h THEN 'withheld' WHEN hs = 1 AND hid.cell = t.cell THEN 'complement'
    ELSE 'reported' END AS status FROM hid LEFT JOIN least_told t ON t.section = hid.section AND t.lang = hid.lang),
long AS (
  SELECT lang, 'words' AS cell, CAST(words AS DOUBLE) AS v FROM docs UNION ALL SELECT lang, 'chars', CAST(chars AS DOUBLE) FROM docs),
stats AS (
  SELECT lang, cell, count(v) AS n, avg(v) AS mean, stddev_samp(v) AS sd, quantile_cont(v, 0.05) AS q05, quantile_cont(v, 0.25) AS q25,
    quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) AS q75, quantile_cont(v, 0.95) AS q95 FROM long GROUP BY ALL),
numbers AS (
  SELECT lang, cell, n, unnest(['mean', 'sd', 'q05', 'q25', 'median', 'q75', 'q95']) AS statistic,
    unnest([mean, sd, q05, q25, median, q75, q95]) AS v FROM stats)
SELECT 'sources' AS section, lang, cell, 'documents' AS statistic, CASE WHEN n >= {LEAST} THEN CAST(n AS DOUBLE) END AS value,
  CASE WHEN n < {LEAST} THEN 'withheld' WHEN pooled THEN 'pooled' ELSE 'reported' END AS status FROM sources
UNION ALL SELECT section, lang, cell, 'documents', CASE WHEN status = 'reported' THEN CAST(n AS DOUBLE) END, status FROM told
UNION ALL SELECT 'numbers', lang, cell, statistic, CASE WHEN n >= {LEAST} THEN round(v + {NUDGE}, 4) END,
  CASE WHEN n < {LEAST} THEN 'withheld' ELSE 'reported' END FROM numbers"""


def oracle_sql() -> dict[str, str]:
    return {"job1_panel_update": JOB1, "job2_text_release": JOB2}
