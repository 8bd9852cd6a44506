"""The registered queries of this subpackage and the SQL that checks those SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontam import contamination
from .exact import exact_dedup
from .fmindex import LENGTH, passage_dedup
from .langid import language_id
from .license import license_scan
from .lines import MIN_CHARS, MIN_SITES, line_dedup
from .packing import pack
from .pii import pii_scan
from .shared import table, text_of
from .simhash import simhash_components
from .suffix import suffix_dedup
from .trie import prefix_trie, rebuild
from .warc import roundtrip

TOKENIZER = "byte_bpe_50k.json"


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_scan(table(spark, sf_dir, "documents"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = roundtrip(table(spark, sf_dir, "pages")).filter("kind = 'record'")
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = suffix_dedup(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return done.select(
        "doc_id",
        "found.n_words",
        "found.n_hit",
        F.size("found.item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("found.item_ids", ","), 256).alias("items_sha256"),
        "found.contaminated",
    )


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def op9_packing(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer or tokenizer_path())


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return done.select("doc_id", "n_lines", "n_removed", F.sha2(text_of(), 256).alias("kept_sha256"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(*rebuild(table(spark, sf_dir, "conversations")))


def op12_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passage_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


OP8_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""

OP2_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS payload_bytes FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS owner FROM p),
r AS (SELECT *, payload_bytes >= 1000 AND owner <> page_id AS again FROM g)
SELECT page_id, payload_bytes, sha1(html) AS payload_digest,
       CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN owner END AS refers_to
FROM r
"""

OP10_SQL = f"""
WITH parts AS (
  SELECT doc_id, source, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), spread AS (
  SELECT trim(line, ' ') AS bare, min(doc_id) AS first_doc
  FROM parts WHERE length(trim(line, ' ')) >= {MIN_CHARS}
  GROUP BY 1 HAVING count(DISTINCT source) >= {MIN_SITES}
), judged AS (
  SELECT p.*, s.bare IS NOT NULL AND s.first_doc <> p.doc_id AS goes
  FROM parts p LEFT JOIN spread s ON s.bare = trim(p.line, ' ')
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE goes) AS n_removed,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT goes), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""

# a turn in a path is its lengths, role and text, so paths are equal only where all turns are
OP11_SQL = """
WITH t AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), ids AS (
  SELECT c, count(*) AS own, c - c % 100 AS base,
         xor(list_reduce(list_concat([4294967295], list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
             lambda a, b: list_reduce(list_concat([xor(a, b)], [1, 2, 3, 4, 5, 6, 7, 8]), lambda d, i: xor(d >> 1, 3988292384 * (d & 1)))), 4294967295) % 6 AS h
  FROM t GROUP BY c
), plan AS (
  SELECT i.c, i.base, i.h, least(i.h, coalesce(b.own, 0)) AS taken, least(i.h, coalesce(b.own, 0)) + greatest(i.own - i.h, 0) AS n
  FROM ids i LEFT JOIN ids b ON b.c = i.base
), turns AS (
  SELECT p.c, t.pos, t.role, t.text FROM plan p JOIN t ON t.c = p.base AND t.pos < p.taken
  UNION ALL
  SELECT p.c, t.pos - p.h + p.taken, t.role, t.text FROM plan p JOIN t ON t.c = p.c AND t.pos >= p.h
), members AS (
  SELECT c, pos + 1 AS depth, length(text) AS chars,
         string_agg(length(role) || ':' || length(text) || ':' || role || text, '' ORDER BY pos)
           OVER (PARTITION BY c ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS path FROM turns
  UNION ALL SELECT c, 0, 0, '' FROM plan
), nodes AS (
  SELECT depth, path, min(m.c) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars,
         sha256(coalesce(string_agg(m.c::VARCHAR, ',' ORDER BY m.c) FILTER (WHERE p.n = m.depth), '')) AS ends_sha256
  FROM members m JOIN plan p USING (c) GROUP BY depth, path
), named AS (
  SELECT m.c, m.depth, n.conv_id FROM members m JOIN nodes n USING (depth, path)
), up AS (
  SELECT n.*, a.conv_id AS parent_conv_id FROM nodes n LEFT JOIN named a ON a.c = n.conv_id AND a.depth = n.depth - 1
), children AS (
  SELECT parent_conv_id AS conv_id, depth - 1 AS depth, count(*) AS n_children FROM up WHERE depth > 0 GROUP BY ALL
), full_ AS (
  SELECT u.*, coalesce(k.n_children, 0) AS n_children FROM up u LEFT JOIN children k USING (conv_id, depth)
), below AS (
  SELECT a.conv_id, a.depth, count(*) FILTER (WHERE f.n_children = 0) AS n_leaves, sum((f.n_convs - 1) * f.chars)::BIGINT AS saved_tokens
  FROM full_ f JOIN named a ON a.c = f.conv_id AND a.depth <= f.depth GROUP BY ALL
)
SELECT conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 FROM full_ JOIN below USING (conv_id, depth)
"""

OP12_SQL = f"""
WITH w AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS words FROM documents
), placed AS (
  SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM w
), runs AS (
  SELECT doc_id, i, word, array_to_string(list(word) OVER f, ' ') AS run, count(*) OVER f AS n FROM placed
  WINDOW f AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {LENGTH - 1} FOLLOWING)
), seen AS (
  SELECT *, n = {LENGTH} AND row_number() OVER (PARTITION BY n = {LENGTH}, run ORDER BY doc_id, i) > 1 AS again FROM runs
), judged AS (
  SELECT doc_id, i, word, bool_or(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN {LENGTH - 1} PRECEDING AND CURRENT ROW) AS goes FROM seen
), kept AS (
  SELECT doc_id, count(*) FILTER (WHERE goes) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT goes) AS text FROM judged GROUP BY doc_id
)
SELECT w.doc_id, len(w.words) AS n_words, coalesce(k.n_removed, 0) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM w LEFT JOIN kept k USING (doc_id)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [f for name, f in globals().items() if name.startswith("op") and callable(f)]
    return {f.__name__: f for f in sorted(found, key=lambda f: int(f.__name__[2:].split("_")[0]))}


def oracle_sql() -> dict[str, str]:
    return {"op2_warc": OP2_SQL, "op8_exact_dedup": OP8_SQL, "op10_line_dedup": OP10_SQL, "op11_prefix_trie": OP11_SQL, "op12_passage_dedup": OP12_SQL}
