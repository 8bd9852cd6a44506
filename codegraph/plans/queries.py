"""One registered query per kernel, each beside the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import graph, knowledge, lookup, modules, similarity, types_tier, usage
from ..sources import snapshot
from .relations import DEFS, EDGES, REACH, TRADE, defs, edges, read, trade

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def checked(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def a_name(spark: SparkSession, sf_dir: str) -> str:
    """The part name that sorts first: one that exists at every size."""
    return read(spark, sf_dir, "part").agg(F.min("p_name")).first()[0] or ""


# ---- lookup


@checked(f"WITH {DEFS} SELECT symbol, kind, file, line, signature FROM v_defs WHERE symbol = (SELECT min(p_name) FROM part)")
def def_exact(spark, sf_dir):
    return lookup.find(defs(spark, sf_dir), a_name(spark, sf_dir)).select("symbol", "kind", "file", "line", "signature")


@checked(f"WITH {DEFS} SELECT symbol, file, line FROM v_defs WHERE symbol = (SELECT min(p_name) FROM part) AND regexp_full_match(file, '{X.glob_regex('libs/brand*/?.ts', '', '')}')")
def def_glob_scope(spark, sf_dir):
    return lookup.find(defs(spark, sf_dir), a_name(spark, sf_dir), "libs/brand*/?.ts").select("symbol", "file", "line")


@checked(f"""WITH {DEFS}, q AS (SELECT substr(min(p_name), 1, 4) AS q FROM part), scored AS (
  SELECT d.*, CASE WHEN starts_with(lower(symbol), lower(q)) THEN 0 WHEN contains(lower(symbol), lower(q)) THEN 1
    WHEN length(symbol) >= 4 AND contains(lower(q), lower(symbol)) THEN 2 END AS score FROM v_defs d, q WHERE lower(symbol) <> lower(q)),
firsts AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY file, line) AS n FROM scored WHERE score IS NOT NULL)
SELECT symbol, file, line, kind, score FROM firsts WHERE n = 1 ORDER BY score, length(symbol), symbol LIMIT 12""")
def def_fuzzy_topk(spark, sf_dir):
    return lookup.find_fuzzy(defs(spark, sf_dir), a_name(spark, sf_dir)[:4]).select("symbol", "file", "line", "kind", F.col("score").cast("int").alias("score"))


# ---- locators


def one_kind(spark: SparkSession, sf_dir: str) -> str:
    return read(spark, sf_dir, "part").agg(F.min(F.lower("p_type"))).first()[0] or "none"


@checked(f"""WITH {DEFS} SELECT symbol, file, line FROM v_defs WHERE kind = (SELECT min(lower(p_type)) FROM part)
  AND regexp_full_match(symbol, '{X.glob_regex('*e*', '', '')}') AND regexp_full_match(file, '{X.glob_regex('libs/**', '', '')}') AND contains(signature, 'a')""")
def locator_symbol(spark, sf_dir):
    kind = one_kind(spark, sf_dir)
    d = defs(spark, sf_dir)
    where = (F.col("kind") == kind) & X.matches_glob(F.col("symbol"), "*e*") & X.matches_glob(F.col("file"), "libs/**") & F.col("signature").contains("a")
    if " " not in kind:  # a kind of one word goes through the query grammar
        where = knowledge.symbol_predicate(f"{kind} *e* = a", "libs/**")
    return d.filter(where).select("symbol", "file", "line")


@checked(f"WITH {DEFS} SELECT DISTINCT file FROM v_defs WHERE regexp_full_match(file, '{X.glob_regex('libs/brand2*/1?.ts', '', '')}')")
def locator_path(spark, sf_dir):
    files = defs(spark, sf_dir).select(F.col("file").alias("path"))
    return knowledge.locate(knowledge.Locator("path", glob="libs/brand2*/1?.ts"), None, None, files).select("file")


@checked(f"WITH {EDGES}, q AS (SELECT min('@' || lower(p_type)) AS q FROM part) SELECT DISTINCT file FROM v_edges, q WHERE specifier = q OR starts_with(specifier, q || '/')")
def locator_import(spark, sf_dir):
    return knowledge.locate(knowledge.Locator("import", of="@" + one_kind(spark, sf_dir)), None, edges(spark, sf_dir), None).select("file")


@checked(f"""WITH {DEFS}, {EDGES}, q AS (SELECT min('@' || lower(p_type)) AS q FROM part)
SELECT DISTINCT file, 'import' AS via, 0 AS stage_ord, 'first' AS stage FROM v_edges, q WHERE specifier = q OR starts_with(specifier, q || '/')
UNION ALL SELECT DISTINCT file, 'path', 1, 'second' FROM v_defs WHERE regexp_full_match(file, '{X.glob_regex('libs/brand2*/*', '', '')}')
UNION ALL SELECT DISTINCT file, 'path', 2, 'third' FROM v_defs WHERE regexp_full_match(file, '{X.glob_regex('libs/*2*/*', '', '')}')""")
def locator_union_staged(spark, sf_dir):
    L = knowledge.Locator
    stages = (L("import", of="@" + one_kind(spark, sf_dir), title="first"), L("path", glob="libs/brand2*/*", title="second"), L("path", glob="libs/*2*/*", title="third"))
    files = defs(spark, sf_dir).select(F.col("file").alias("path"))
    return knowledge.resolve(knowledge.Concept("c", "c", stages=stages), defs(spark, sf_dir), edges(spark, sf_dir), files).select("file", "via", "stage_ord", "stage")


@checked("""WITH m AS (SELECT p_brand AS file, p_name AS symbol, p_size AS line, p_partkey AS ord, CASE WHEN p_partkey % 3 = 0 THEN 'function' ELSE 'constant' END AS kind FROM part),
n AS (SELECT *, row_number() OVER (PARTITION BY file, symbol, line ORDER BY kind = 'constant', ord) AS n FROM m)
SELECT file, symbol, line, ord, kind FROM n WHERE n = 1""")
def dedupe_specific_kind(spark, sf_dir):
    kind = F.when(F.col("p_partkey") % 3 == 0, "function").otherwise("constant")
    m = read(spark, sf_dir, "part").select(F.col("p_brand").alias("file"), F.col("p_name").alias("symbol"), F.col("p_size").alias("line"), F.col("p_partkey").alias("ord"), kind.alias("kind"))
    return lookup.dedupe_specific(m)


# ---- modules and references


ITEMS_A_TASK = 100_000  # whose distinct rows a task holds at once: some ten megabytes


def _import_edges(spark, sf_dir):
    """Each supplier's file imports its parts' files by a relative path, with and without a script extension."""
    items = read(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", (F.col("l_linenumber") % 2).alias("odd"))
    parts = max(1, -(-items.count() // ITEMS_A_TASK))  # from the files' footers; few rows repeat, so a table of them before the exchange would only take memory
    items = items.repartition(parts, "l_suppkey", "l_partkey", "odd").distinct()
    spec = F.concat(F.lit("./../parts/"), F.col("l_partkey").cast("string"), F.when(F.col("odd") == 0, ".js").otherwise(""))
    file = F.concat(F.lit("supp/"), F.col("l_suppkey").cast("string"), F.lit(".ts"))
    return items.select(F.concat_ws("|", file, spec).alias("edge_id"), file.alias("file"), spec.alias("specifier"))


@checked("""WITH files AS (SELECT p_partkey, 'parts/' || p_partkey || CASE p_size % 4 WHEN 0 THEN '.ts' WHEN 1 THEN '.tsx' WHEN 2 THEN '/index.ts' ELSE '.css' END AS path, p_size % 4 AS k FROM part),
e AS (SELECT DISTINCT l_suppkey, l_partkey, l_linenumber % 2 AS odd FROM lineitem)
SELECT 'supp/' || l_suppkey || '.ts|./../parts/' || l_partkey || CASE WHEN odd = 0 THEN '.js' ELSE '' END AS edge_id,
  CASE WHEN k < 3 THEN path END AS target FROM e JOIN files ON l_partkey = p_partkey""")
def import_resolve_candidates(spark, sf_dir):
    size = F.col("p_size") % 4
    end = F.when(size == 0, ".ts").when(size == 1, ".tsx").when(size == 2, "/index.ts").otherwise(".css")
    files = read(spark, sf_dir, "part").select(F.concat(F.lit("parts/"), F.col("p_partkey").cast("string"), end).alias("path"))
    return modules.resolve(_import_edges(spark, sf_dir), files).select("edge_id", "target")


@checked(f"""WITH {TRADE}, targets AS (SELECT DISTINCT dst AS def FROM v_graph WHERE dst % 5 = 0),
barrels AS (SELECT DISTINCT src AS barrel, dst AS def FROM v_graph JOIN targets ON dst = def WHERE src % 2 = 0)
SELECT DISTINCT def AS def_file, src AS file FROM v_graph JOIN targets ON dst = def WHERE src % 2 = 1
UNION SELECT DISTINCT b.def, g.src FROM v_graph g JOIN barrels b ON g.dst = b.barrel WHERE g.src % 2 = 1""")
def importers_one_hop(spark, sf_dir):
    """Nations with even keys are barrels that re-export everything; odd ones import by name."""
    g = graph.cut_lineage(trade(spark, sf_dir))
    names = F.when(F.col("src") % 2 == 1, F.array(F.struct(F.lit("x").alias("imported"), F.lit("x").alias("local"))))
    resolved = g.select(
        F.col("src").cast("string").alias("file"), F.when(F.col("src") % 2 == 1, "import").otherwise("re-export").alias("kind"),
        (F.col("src") % 2 == 0).alias("star"), F.col("dst").cast("string").alias("target"), names.alias("names"),
    )
    targets = g.filter("dst % 5 = 0").select(F.lit("x").alias("symbol"), F.col("dst").cast("string").alias("file")).distinct()
    found = modules.importers(resolved, targets)
    return found.select(F.col("def_file").cast("int").alias("def_file"), F.col("file").cast("int").alias("file"))


@checked("""SELECT c_nationkey AS file, min(o_orderkey) AS def_ord, arg_min(o_custkey, o_orderkey) AS via
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1""")
def refs_first_def_wins(spark, sf_dir):
    customer = read(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("file"))
    scans = read(spark, sf_dir, "orders").join(customer, F.col("o_custkey") == F.col("c_custkey")).select("file", F.lit("x").alias("local"), F.col("o_orderkey").alias("def_ord"), F.col("o_custkey").alias("via"))
    return modules.first_target(scans).select("file", "def_ord", "via")


# ---- graphs


@checked(f"""WITH {TRADE}, o AS (SELECT src AS id, count(*) AS out_degree FROM v_graph GROUP BY 1), i AS (SELECT dst AS id, count(*) AS in_degree FROM v_graph GROUP BY 1)
SELECT coalesce(o.id, i.id) AS id, coalesce(in_degree, 0) AS in_degree, coalesce(out_degree, 0) AS out_degree FROM o FULL OUTER JOIN i ON o.id = i.id""")
def dep_hubs(spark, sf_dir):
    return graph.hubs(trade(spark, sf_dir))


@checked(f"""WITH {TRADE}, f AS (SELECT min(src) AS id FROM v_graph), one AS (SELECT src, dst FROM v_graph, f WHERE src = id OR dst = id),
ids AS (SELECT src AS id FROM one UNION SELECT dst FROM one UNION SELECT id FROM f)
SELECT DISTINCT src, dst FROM v_graph WHERE src IN (SELECT id FROM ids) OR dst IN (SELECT id FROM ids)""")
def dep_neighborhood(spark, sf_dir):
    g = graph.cut_lineage(trade(spark, sf_dir))
    return graph.neighborhood(g, g.agg(F.min("src").alias("id")), 2)


@checked(f"""WITH RECURSIVE {TRADE}, {REACH}
SELECT DISTINCT least(r.a, min(q.b) OVER (PARTITION BY r.a)) AS group_id, r.a AS id FROM reach r JOIN reach q ON r.a = q.a JOIN reach p ON p.a = q.b AND p.b = q.a WHERE r.a = r.b AND q.b <> q.a""")
def dep_cycles(spark, sf_dir):
    return graph.cycles(trade(spark, sf_dir))


BFS = """bfs AS (SELECT (SELECT min(src) FROM v_graph) AS id, 0 AS depth UNION SELECT dst, depth + 1 FROM bfs JOIN v_graph ON src = id WHERE depth < 3)"""


@checked(f"WITH RECURSIVE {TRADE}, {BFS} SELECT id, min(depth) AS depth FROM bfs GROUP BY 1")
def closure_bfs(spark, sf_dir):
    g = graph.cut_lineage(trade(spark, sf_dir))
    return graph.closure(g, g.agg(F.min("src").alias("id")), 3)


@checked(f"""WITH RECURSIVE {TRADE}, {BFS}, c AS (SELECT c_nationkey AS id, count(*) AS branches, count(*) FILTER (WHERE c_acctbal < 0) AS errors,
  count(*) FILTER (WHERE c_mktsegment = 'BUILDING') AS awaits FROM customer GROUP BY 1)
SELECT count(*) AS functions, coalesce(sum(branches), 0)::BIGINT AS branches, coalesce(sum(errors), 0)::BIGINT AS errors, coalesce(sum(awaits), 0)::BIGINT AS awaits
FROM c WHERE id IN (SELECT id FROM bfs)""")
def flow_rollup(spark, sf_dir):
    c = read(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("id")).agg(
        F.count(F.lit(1)).alias("branches"), F.count(F.when(F.col("c_acctbal") < 0, 1)).alias("errors"), F.count(F.when(F.col("c_mktsegment") == "BUILDING", 1)).alias("awaits")
    )
    g = graph.cut_lineage(trade(spark, sf_dir))
    return graph.rollup(graph.closure(g, g.agg(F.min("src").alias("id")), 3), c, ["branches", "errors", "awaits"])


# ---- pages as sources


@checked("""WITH links AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS specifier FROM pages),
q AS (SELECT min(specifier) AS q FROM links WHERE specifier <> '/') SELECT DISTINCT page_id, specifier FROM links, q WHERE specifier = q OR starts_with(specifier, substr(q, 1, 2))""")
def page_links_perimeter(spark, sf_dir):
    links = read(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), 1)).alias("specifier"))
    q = links.filter("specifier <> '/'").agg(F.min("specifier")).first()[0] or ""
    return links.filter((F.col("specifier") == q) | F.col("specifier").startswith(q[:2])).distinct()


KINDS = """CASE WHEN node = 'type_identifier' THEN 'type' WHEN parent = 'call_expression' AND field = 'function' THEN 'call' WHEN parent = 'new_expression' AND field = 'constructor' THEN 'new'
  WHEN parent = 'member_expression' AND field = 'object' THEN 'access' WHEN parent IN ('import_specifier', 'namespace_import', 'import_clause') THEN 'import'
  WHEN parent IN ('extends_clause', 'class_heritage', 'implements_clause') THEN 'extends' ELSE 'identifier' END"""
TAGS = [("a", "identifier", "call_expression", "function"), ("script", "identifier", "new_expression", "constructor"), ("div", "identifier", "member_expression", "object"), ("title", "type_identifier", "x", "x"), ("li", "identifier", "import_specifier", "name"), ("ul", "identifier", "implements_clause", "x"), ("p", "identifier", "member_expression", "property")]


@checked(f"""WITH t AS (SELECT page_id, unnest(regexp_extract_all(html, '<([a-z]+)', 1)) AS tag FROM pages), k (tag, node, parent, field) AS (VALUES {', '.join(map(str, TAGS))})
SELECT {KINDS} AS kind, count(*) AS n FROM t JOIN k USING (tag) GROUP BY 1""")
def ref_kind_counts(spark, sf_dir):
    tags = read(spark, sf_dir, "pages").select(F.explode(F.regexp_extract_all("html", F.lit("<([a-z]+)"), 1)).alias("tag"))
    pick = lambda i: F.create_map(*[F.lit(x) for t in TAGS for x in (t[0], t[i])])[F.col("tag")]
    known = tags.select(pick(1).alias("node"), pick(2).alias("parent"), pick(3).alias("field")).filter("node is not null")
    return known.groupBy(X.reference_kind(F.col("node"), F.col("parent"), F.col("field")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


# ---- similarity


def _sets(spark, sf_dir):
    """Distinct word 3-grams of texts of twenty words and more, once for each text (id, shingles); and (doc_id, id) of every document."""
    texts = read(spark, sf_dir, "documents").select("doc_id", "text").withColumn("id", F.sha2("text", 256))
    once = texts.groupBy("id").agg(F.first("text").alias("text"))
    words = once.select("id", F.split("text", " ").alias("w")).filter(F.size("w") >= 20)
    return words.select("id", X.k_grams(F.col("w"), 3, " ").alias("shingles")), texts.select("doc_id", "id")


WORDS = """d AS (SELECT text, min(doc_id) AS id, string_split(text, ' ') AS w FROM documents GROUP BY text), g AS (SELECT id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 20),
items AS (SELECT DISTINCT id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS item FROM g), sizes AS (SELECT id, count(*) AS size FROM items GROUP BY 1),
member AS (SELECT x.doc_id, d.id FROM documents x JOIN d USING (text))"""


@checked(f"WITH {WORDS} SELECT doc_id AS id, size FROM member JOIN sizes USING (id)")
def shingle_sets(spark, sf_dir):
    sets, member = _sets(spark, sf_dir)
    return member.join(sets.select("id", F.size("shingles").cast("long").alias("size")), "id").select(F.col("doc_id").alias("id"), "size")


@checked("""WITH d AS (SELECT doc_id, [x FOR x IN string_split(lower(source || '|' || lang), '|')] AS w FROM documents) SELECT doc_id, w[1] || chr(1) || w[2] AS run FROM d""")
def shingle_runs(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", F.split(F.lower(F.concat_ws("|", "source", "lang")), r"\|").alias("w"))
    return d.select("doc_id", F.explode(X.k_grams(F.col("w"), 2)).alias("run"))


FNV = "list_reduce(list_prepend(2166136261::HUGEINT, [unicode(c)::HUGEINT FOR c IN string_split(source, '')]), lambda h, c: (xor(h::UBIGINT, c::UBIGINT)::HUGEINT * 16777619) % 4294967296)::BIGINT"


@checked(f"SELECT DISTINCT source, {FNV} AS hash FROM documents")
def fnv_hash(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("source", X.fnv1a32(F.col("source")).alias("hash")).distinct()


UNITS = FNV.replace("source", "left(text, 60)")


@checked(f"SELECT DISTINCT left(text, 60) AS head, {UNITS} AS hash FROM documents WHERE text IS NOT NULL")
def fnv_hash_units(spark, sf_dir):
    """Of texts in several languages, whose letters beyond ASCII are one code unit each."""
    head = F.left("text", F.lit(60))
    return read(spark, sf_dir, "documents").filter("text is not null").select(head.alias("head"), X.fnv1a32(head).alias("hash")).distinct()


REFERENCE = "doc_id % 100 = 0"  # the query set: documents whose id is divisible by 100, against all others


@checked(f"""WITH {WORDS}, asked AS (SELECT id, min(doc_id) AS doc_id FROM member WHERE {REFERENCE} GROUP BY 1), q AS (SELECT items.*, doc_id FROM items JOIN asked USING (id)),
pairs AS (SELECT o.id AS a, q.id AS b, doc_id, count(*) AS shared FROM items o JOIN q USING (item) GROUP BY 1, 2, 3),
scored AS (SELECT a, doc_id AS b, shared / (s.size + t.size - shared) AS score FROM pairs JOIN sizes s ON s.id = a JOIN sizes t ON t.id = b),
best AS (SELECT a, max(score) AS score, arg_max(b, (score, -b)) AS b FROM scored WHERE score >= 0.5 GROUP BY 1)
SELECT doc_id AS line, floor(score * 100 + 0.5) / 100 AS score, 'q#' || b AS resembles FROM best JOIN member ON a = id WHERE NOT ({REFERENCE})""")
def jaccard_candidates(spark, sf_dir):
    """Every document outside the query set that is like one in it: sets are compared once for each text, copies get their text's result."""
    sets, member = _sets(spark, sf_dir)
    asked = member.filter(REFERENCE).groupBy("id").agg(F.min("doc_id").alias("ref_ord"))
    # hashes are all that is compared, under numbers that are given once
    hashes = F.transform("shingles", lambda x: F.xxhash64(x)).alias("shingles")
    sets = graph.cut_lineage(sets.join(asked, "id", "left").select(F.monotonically_increasing_id().alias("n"), F.col("id").alias("text_id"), "ref_ord", hashes).withColumnRenamed("n", "id"))
    references = sets.filter("ref_ord is not null").withColumn("name", F.concat(F.lit("q#"), F.col("ref_ord").cast("string")))
    best = similarity.best_matches(sets, references, 0.5).join(sets.select(F.col("id").alias("a"), "text_id"), "a")
    found = member.filter(f"not ({REFERENCE})").join(best, F.col("id") == F.col("text_id"))
    return found.select(F.col("doc_id").alias("line"), X.round2(F.col("score")).alias("score"), F.col("ref").alias("resembles"))


@checked(f"""WITH {WORDS}, asked AS (SELECT id, min(doc_id) AS doc_id FROM member WHERE {REFERENCE} GROUP BY 1), q AS (SELECT items.*, doc_id FROM items JOIN asked USING (id)),
rest AS (SELECT * FROM sizes WHERE id NOT IN (SELECT id FROM asked)),
pairs AS (SELECT o.id AS a, q.id AS b, doc_id, count(*) AS shared FROM items o JOIN rest ON o.id = rest.id JOIN q USING (item) GROUP BY 1, 2, 3),
scored AS (SELECT a, doc_id AS b, shared / (s.size + t.size - shared) AS score FROM pairs JOIN sizes s ON s.id = a JOIN sizes t ON t.id = b),
best AS (SELECT a, max(score) AS score, arg_max(b, (score, -b)) AS b FROM scored WHERE score >= 0.5 GROUP BY 1)
SELECT a AS line, floor(score * 100 + 0.5) / 100 AS score, 'q#' || b AS resembles FROM best ORDER BY 2 DESC, 1 LIMIT 10""")
def clone_topk(spark, sf_dir):
    """The ten texts most like a text of the query set, the reference texts themselves left out."""
    sets, member = _sets(spark, sf_dir)
    least = member.groupBy("id").agg(F.min("doc_id").alias("line"), F.min(F.when(F.expr(REFERENCE), F.col("doc_id"))).alias("ref_ord"))
    rows = graph.cut_lineage(sets.join(least, "id").withColumn("file", F.when(F.col("ref_ord").isNull(), "o").otherwise("q")).withColumn("name", F.coalesce("ref_ord", "line").cast("string")))
    return similarity.best_reference(rows, rows.filter("ref_ord is not null"), 0.5, 10).select("line", "score", "resembles")


@checked("""SELECT d.doc_id, l.doc_id IS NULL OR l.quality = 0 AS violates FROM documents d LEFT JOIN labels l USING (doc_id) WHERE coalesce(l.toxic, 0) = 0""")
def clone_exclude_members(spark, sf_dir):
    labels = read(spark, sf_dir, "labels")
    rest = read(spark, sf_dir, "documents").select("doc_id").join(labels.filter("toxic = 1").select("doc_id"), "doc_id", "left_anti")
    flagged = similarity.flag_violations(rest.withColumnRenamed("doc_id", "file"), labels.filter("quality = 1").withColumnRenamed("doc_id", "file"))
    return flagged.select(F.col("file").alias("doc_id"), "violates")


@checked("""SELECT a.doc_id AS a, b.doc_id AS b, len(list_intersect(wa, wb)) / len(list_distinct(list_concat(wa, wb))) AS score
FROM (SELECT doc_id, list_distinct(string_split(text, ' ')) AS wa FROM documents) a JOIN (SELECT doc_id + 1 AS doc_id, list_distinct(string_split(text, ' ')) AS wb FROM documents) b ON a.doc_id = b.doc_id""")
def jaccard_adjacent(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", F.array_distinct(F.split("text", " ")).alias("w"))
    b = d.select((F.col("doc_id") + 1).alias("b"), F.col("w").alias("v"))
    return d.join(b, F.col("doc_id") == F.col("b")).select(F.col("doc_id").alias("a"), "b", X.jaccard(F.col("w"), F.col("v")).alias("score"))


# ---- drift and conformance

CUT_OLD, CUT_NEW = "o_orderkey % 7 <> 0", "o_orderkey % 11 <> 0"


def _anchors(spark, sf_dir, where, status):
    o = read(spark, sf_dir, "orders").filter(where)
    return o.select(F.col("o_orderkey").cast("string").alias("key"), X.hash16(F.concat_ws(" ", status, "o_orderpriority")).alias("hash"))


def _status():
    return F.when(F.col("o_orderkey") % 13 == 0, "X").otherwise(F.col("o_orderstatus"))


@checked(f"""WITH a AS (SELECT o_orderkey::VARCHAR AS key, substr(sha1(o_orderstatus || ' ' || o_orderpriority), 1, 16) AS old FROM orders WHERE {CUT_OLD}),
b AS (SELECT o_orderkey::VARCHAR AS key, substr(sha1(CASE WHEN o_orderkey % 13 = 0 THEN 'X' ELSE o_orderstatus END || ' ' || o_orderpriority), 1, 16) AS new FROM orders WHERE {CUT_NEW})
SELECT coalesce(a.key, b.key) AS key, CASE WHEN old IS NULL THEN 'added' WHEN new IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM a FULL OUTER JOIN b ON a.key = b.key WHERE old IS NULL OR new IS NULL OR old <> new""")
def drift_diff(spark, sf_dir):
    return knowledge.drift(_anchors(spark, sf_dir, CUT_OLD, F.col("o_orderstatus")), _anchors(spark, sf_dir, CUT_NEW, _status()))


@checked(f"""SELECT o_orderkey AS key, 'entered' AS change FROM orders WHERE {CUT_NEW} AND NOT ({CUT_OLD}) UNION ALL SELECT o_orderkey, 'left' FROM orders WHERE {CUT_OLD} AND NOT ({CUT_NEW})""")
def drift_membership(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"))
    return knowledge.membership_drift(o.filter(CUT_OLD.replace("o_orderkey", "key")), o.filter(CUT_NEW.replace("o_orderkey", "key")))


@checked("""SELECT o_custkey || '#x' AS key, substr(sha1(arg_max(o_orderpriority, o_orderkey) || ' sig'), 1, 16) AS hash FROM orders GROUP BY o_custkey""")
def anchor_last_wins(spark, sf_dir):
    """Orders as locations of one symbol in their customer's file: of equal keys the last location counts."""
    rows = read(spark, sf_dir, "orders").select(
        F.lit("symbol").alias("via"), F.col("o_custkey").cast("string").alias("file"), F.lit("x").alias("symbol"), F.col("o_orderpriority").alias("kind"), F.lit("sig").alias("signature"),
        F.lit(0).alias("locator_ord"), F.lit(None).cast("int").alias("line"), F.col("o_orderkey").alias("ord"),
    )
    return knowledge.anchors(rows)


@checked("""SELECT count(*) AS total, count(*) FILTER (WHERE ok) AS conforming, count(*) FILTER (WHERE NOT ok) AS violating
FROM (SELECT c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority LIKE '1%') AS ok FROM customer)""")
def conformance(spark, sf_dir):
    members = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("file"))
    allowed = read(spark, sf_dir, "orders").filter("o_orderpriority like '1%'").select(F.col("o_custkey").alias("file"))
    return knowledge.conformance(members, allowed)


@checked("SELECT c_custkey AS file FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority LIKE '1%')")
def conformance_violations(spark, sf_dir):
    members = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("file"))
    return knowledge.violations(members, read(spark, sf_dir, "orders").filter("o_orderpriority like '1%'").select(F.col("o_custkey").alias("file")))


# ---- usage and adoption


def _usage(spark, sf_dir):
    return read(spark, sf_dir, "events").select(F.col("event_type").alias("tool"), F.col("ts").cast("string").alias("ts"), "event_id", F.try_parse_json("props").alias("args"), "user_id")


@checked("SELECT event_type AS tool, count(*) AS calls FROM events GROUP BY 1")
def usage_by_tool(spark, sf_dir):
    return usage.by_tool(_usage(spark, sf_dir))


@checked("SELECT json_extract_string(props, '$.k') AS value, count(*) AS calls FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def usage_top_args(spark, sf_dir):
    # the tables' arguments are numbers, which the engine's own summaries skip; they are read as text here
    return usage.top_values(_usage(spark, sf_dir), F.try_variant_get("args", "$.k", "string"))


@checked("SELECT arg_min(event_type || user_id, event_id) AS first_ts, arg_max(event_type || user_id, event_id) AS last_ts, count(*) AS calls FROM events")
def usage_first_last(spark, sf_dir):
    u = read(spark, sf_dir, "events").select(F.concat("event_type", F.col("user_id").cast("string")).alias("ts"), "event_id")
    return usage.first_last(u, "event_id")


TYPES = "list_sort(list_distinct(list(event_type)))"


@checked(f"""WITH k AS (SELECT {TYPES} AS t FROM events), r AS (SELECT CASE event_type WHEN t[1] THEN 'own' WHEN t[2] THEN 'grep' WHEN t[3] THEN 'search' END AS kind FROM events, k),
c AS (SELECT count(*) FILTER (WHERE kind = 'own') AS own, count(*) FILTER (WHERE kind = 'grep') AS grep, count(*) FILTER (WHERE kind = 'search') AS search FROM r)
SELECT *, CASE WHEN own + grep > 0 THEN floor(own * 100 / (own + grep) + 0.5) ELSE 0 END::BIGINT AS share_pct FROM c""")
def adoption_share(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("event_type")
    known = e.agg(F.array_sort(F.collect_set("event_type")).alias("t")).first().t  # the few event types
    kind = F.lit(None).cast("string")
    for name, of in zip(known, ("own", "grep", "search"), strict=False):
        kind = F.when(F.col("event_type") == name, of).otherwise(kind)
    return usage.adoption(e.withColumn("kind", kind))


COMMAND = "CASE event_id % 6 WHEN 0 THEN 'grep x' WHEN 1 THEN 'ls | git grep y' WHEN 2 THEN 'cd a; rg z' WHEN 3 THEN 'echo grep' WHEN 4 THEN 'git log && ls' ELSE 'agx' END"


@checked("""SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'own' WHEN event_id % 7 = 1 THEN 'grep' WHEN event_id % 6 IN (0, 1, 2) THEN 'grep' END AS kind FROM events""")
def classify_calls(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("event_id", F.expr(COMMAND).alias("command"))
    name = F.when(F.col("event_id") % 7 == 0, "mcp__own__find").when(F.col("event_id") % 7 == 1, "Glob").otherwise("Bash")
    return e.select("event_id", X.tool_kind(name, F.col("command"), "mcp__own__").alias("kind"))


# ---- snapshots


@checked(f"""SELECT o_orderkey AS key, 'changed' AS change FROM orders WHERE {CUT_NEW} AND (NOT ({CUT_OLD}) OR o_orderkey % 13 = 0) UNION ALL SELECT o_orderkey, 'removed' FROM orders WHERE {CUT_OLD} AND NOT ({CUT_NEW})""")
def sync_changed_removed(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("size"), F.col("o_orderdate").alias("mtime"))
    old = o.filter(CUT_OLD.replace("o_orderkey", "key"))
    new = o.filter(CUT_NEW.replace("o_orderkey", "key")).withColumn("size", F.when(F.col("key") % 13 == 0, "X").otherwise(F.col("size")))
    return snapshot.diff(old, new, "key", ["mtime", "size"])


@checked(f"SELECT o_orderkey AS key, CASE WHEN o_orderkey % 13 = 0 OR NOT ({CUT_OLD}) THEN 'new' ELSE 'kept' END AS version FROM orders WHERE {CUT_NEW}")
def sync_apply(spark, sf_dir):
    """Old rows with changed and removed keys replaced: equal to a rebuild."""
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("size"))
    old = o.filter(CUT_OLD.replace("o_orderkey", "key"))
    new = o.filter(CUT_NEW.replace("o_orderkey", "key")).withColumn("size", F.when(F.col("key") % 13 == 0, "X").otherwise(F.col("size")))
    gone = snapshot.diff(old, new, "key", ["size"])
    fresh = new.join(gone.filter("change = 'changed'"), "key", "left_semi").select("key", F.lit("new").alias("version"))
    return snapshot.replace_rows(old.select("key", F.lit("kept").alias("version")), gone, "key", fresh)


@checked("""WITH w AS (SELECT DISTINCT doc_id, unnest(string_split(text, ' ')) AS word FROM documents), b AS (SELECT item_id, string_split(text, ' ')[1] AS word FROM benchmark),
words AS (SELECT DISTINCT doc_id, item_id FROM w JOIN b USING (word)), joined AS (SELECT DISTINCT doc_id, item_id FROM documents d JOIN b ON d.text LIKE b.word || ' %')
SELECT doc_id, item_id, 'excluded' AS verdict FROM words ANTI JOIN joined USING (doc_id, item_id) UNION ALL SELECT doc_id, item_id, 'missed' FROM joined ANTI JOIN words USING (doc_id, item_id)""")
def precision_report(spark, sf_dir):
    """Word hits that the stricter match excludes, and strict matches without a word hit."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.split("text", " ").alias("w"))
    items = read(spark, sf_dir, "benchmark").select("item_id", F.element_at(F.split("text", " "), 1).alias("word"))
    found = docs.select("doc_id", F.explode(F.array_distinct("w")).alias("word")).join(items, "word").select("doc_id", "item_id").distinct()
    strict = docs.filter(F.size("w") > 1).select("doc_id", F.element_at("w", 1).alias("word")).join(items, "word").select("doc_id", "item_id").distinct()
    a = found.join(strict, ["doc_id", "item_id"], "left_anti").withColumn("verdict", F.lit("excluded"))
    return a.unionByName(strict.join(found, ["doc_id", "item_id"], "left_anti").withColumn("verdict", F.lit("missed")))


@checked("""WITH p AS (SELECT page_id, url, regexp_replace(url, '^[a-z]+://', '') AS path FROM pages)
SELECT page_id, CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '' END AS dir, regexp_extract(path, '[^/](\\.[^./]*)$', 1) AS ext FROM p""")
def path_parts(spark, sf_dir):
    p = read(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", "^[a-z]+://", "").alias("path"))
    return p.select("page_id", X.dirname(F.col("path")).alias("dir"), X.extension(F.col("path")).alias("ext"))


@checked("SELECT page_id, regexp_replace(trim(regexp_replace(html, '[ \\t\\n\\r]+', ' ', 'g'), ' '), '', '')[1:200] AS signature FROM pages")
def signature_line(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", X.one_line(F.col("html"), 200).alias("signature"))


@checked("""WITH m AS (SELECT c_nationkey AS file, c_custkey AS line, c_name AS symbol FROM customer) SELECT file, min(line) AS line, arg_min(symbol, line) AS symbol FROM m GROUP BY 1""")
def member_first_location(spark, sf_dir):
    rows = read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("file"), F.col("c_custkey").alias("line"), F.col("c_name").alias("symbol"), F.lit(0).alias("stage_ord"), F.lit(0).alias("locator_ord"), F.lit(0).alias("ord"))
    return knowledge.member_files(rows).select("file", "line", "symbol")


@checked("""WITH r AS (SELECT o_custkey AS iface, o_orderkey AS impl, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders) SELECT iface, impl FROM r WHERE n <= 4""")
def impls_at_most_four(spark, sf_dir):
    """Customers as interfaces, their orders as classes that implement them: a call on the interface may run four of these."""
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c"), F.col("o_orderkey").alias("o"))
    faces = o.select("c").distinct()
    face, impl = F.concat(F.lit("I"), F.col("c").cast("string")), F.concat(F.lit("C"), F.col("o").cast("string"))
    body = lambda df, file, cls, id_, has, line: df.select(F.lit(file).alias("file"), cls.alias("cls"), F.lit("m").alias("name"), id_.cast("string").alias("id"), F.lit(has).alias("has_body"), line.cast("int").alias("line"))
    functions = body(faces, "i", face, face, False, F.lit(1)).unionByName(body(o, "o", impl, F.col("o"), True, F.col("o")))
    up = lambda df, file, cls, a_file, a_cls, d: df.select(F.lit(file).alias("file"), cls.alias("cls"), F.lit(a_file).alias("a_file"), a_cls.alias("a_cls"), F.lit(d).alias("distance"))
    ancestors = up(faces, "i", face, "i", face, 0).unionByName(up(o, "o", impl, "o", impl, 0)).unionByName(up(o, "o", impl, "i", face, 1))
    located = faces.select(F.col("c").alias("use_id"), F.lit("i").alias("r_file"), face.alias("r_cls"), F.lit("m").alias("name"))
    found = types_tier.members(located, functions, ancestors)
    return found.select(F.col("use_id").alias("iface"), F.col("id").cast(o.schema["o"].dataType).alias("impl"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
