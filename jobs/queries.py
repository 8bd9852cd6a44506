"""The jobs as registered queries: each runs twice into one new folder and gives the whole output read back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from jobs import clone_review, reference_index
from jobs.common import fresh_folder


def job1_clone_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fresh_folder(spark, "clone-review")
    for _ in range(2):
        clone_review.run(spark, f"{sf_dir}/documents.parquet", f"{sf_dir}/labels.parquet", out)
    return clone_review.result(spark, out)


def job2_reference_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fresh_folder(spark, "reference-index")
    for _ in range(2):
        reference_index.run(spark, f"{sf_dir}/documents.parquet", f"{out}/index", f"{out}/checkpoint")
    return reference_index.current(spark, f"{out}/index").drop("bucket")


JOB1_SQL = """
WITH judged AS (SELECT doc_id, coalesce(max(quality), 0) = 1 AS good, coalesce(max(toxic), 0) = 1 AS toxic FROM labels GROUP BY 1),
marked AS (SELECT d.doc_id, d.source, d.text, coalesce(good AND NOT toxic, false) AS reference FROM documents d LEFT JOIN judged USING (doc_id)),
once AS (SELECT text, string_split(text, ' ') AS w, min(doc_id) FILTER (WHERE reference) AS ref FROM marked WHERE text IS NOT NULL GROUP BY text),
g AS (SELECT text, ref, w, unnest(range(1, len(w) - 1)) AS i FROM once WHERE len(w) >= 20),
items AS (SELECT DISTINCT text, ref, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS item FROM g),
sizes AS (SELECT text, count(*) AS size FROM items GROUP BY 1),
pairs AS (SELECT a.text AS a, b.text AS b, b.ref, count(*) AS shared FROM items a JOIN items b ON a.item = b.item AND b.ref IS NOT NULL GROUP BY 1, 2, 3),
scored AS (SELECT a, ref, shared / (s.size + t.size - shared) AS score FROM pairs JOIN sizes s ON s.text = a JOIN sizes t ON t.text = b),
best AS (SELECT a, max(score) AS score, arg_max(ref, (score, -ref)) AS ref FROM scored WHERE score >= 0.5 GROUP BY 1)
SELECT m.doc_id, floor(b.score * 100 + 0.5) / 100 AS score, b.ref AS resembles, j.doc_id IS NULL OR j.toxic AS violates, m.source
FROM marked m JOIN best b ON b.a = m.text LEFT JOIN judged j USING (doc_id) WHERE NOT m.reference
"""

JOB2_SQL = """
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS at_line FROM documents WHERE doc_id IS NOT NULL),
o AS (SELECT doc_id, at_line, unnest(regexp_extract_all(line, '[A-Za-z_$][A-Za-z0-9_$]*')) AS symbol FROM l)
SELECT symbol, doc_id, count(*) AS n_refs, min(at_line)::INT AS first_line, max(at_line)::INT AS last_line FROM o GROUP BY 1, 2
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"job1_clone_review": job1_clone_review, "job2_reference_index": job2_reference_index}


def oracle_sql() -> dict[str, str]:
    return {"job1_clone_review": JOB1_SQL, "job2_reference_index": JOB2_SQL}
