"""Joins, searches, rankings and budgets over the relational tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sentrel.functions import fixed
from sentrel.functions.expressions import lookup
from sentrel.operators import evaluate as V
from sentrel.operators import knowledge as K
from sentrel.operators import memory as M
from sentrel.operators import paths as P
from sentrel.operators import prioritize as Z
from sentrel.session import table

COMPAT = {"T0": ["C0", "C1"], "T1": ["C2"], "T2": ["C3", "C4"], "T3": ["C0", "C4"]}
PRIORITY = {"1-URGENT": "CRITICAL", "2-HIGH": "HIGH", "3-MEDIUM": "MEDIUM"}
SEGMENT = {"BUILDING": "sql_injection", "AUTOMOBILE": "ssrf", "MACHINERY": "weak_crypto", "HOUSEHOLD": "path_traversal"}
CEILING = 2500


def _sources(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", F.concat(F.lit("T"), (F.col("s_nationkey") % 5).cast("string")).alias("source_type"))


def _nation_sinks(spark, d):
    return table(spark, d, "nation").select("n_nationkey", F.concat(F.lit("C"), F.col("n_regionkey").cast("string")).alias("category"))


def compat_pairs(spark, d):
    pairs = P.compatible_pairs(_sources(spark, d), _nation_sinks(spark, d), P.compat_table(spark, COMPAT))
    return pairs.select("s_suppkey", "n_nationkey", "source_type", "category")


def file_limited_pairs(spark, d):
    nation = table(spark, d, "nation")
    sinks = nation.select("n_nationkey", F.col("n_regionkey").alias("file"), F.concat(F.lit("C"), (F.col("n_nationkey") % 4).cast("string")).alias("category"))
    sources = table(spark, d, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_regionkey").alias("file"))
    return P.file_limited_counts(sources, sinks, ["C1", "C2"], "s_suppkey").select("n_nationkey", "category", "n_sources", "first_source")


def enrich_left(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang")
    labels = table(spark, d, "labels")
    return K.enrich(docs, labels.select("doc_id", "quality"), labels.where("toxic = 1").select("doc_id"), "doc_id")


def knowledge_stats(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") > 10, F.col("p_size") / 50).alias("epss"), (F.col("p_brand") == "Brand#1").cast("int").alias("known_flag"), (F.col("p_size") / 5).alias("cvss"), (F.col("p_type") == "SMALL").cast("int").alias("exploit"))
    return K.statistics(p)


def rank_records(spark, d):
    p = table(spark, d, "part")
    s = K.rank_score((F.col("p_brand") == "Brand#1").cast("int"), F.when(F.col("p_size") > 10, F.col("p_size") / 50), F.col("p_size") / 5, (F.col("p_type") == "SMALL").cast("int"))
    return p.select("p_partkey", F.round(s, 4).alias("score")).orderBy(F.desc("score"), "p_partkey").limit(100)


def upsert_last(spark, d):
    e = table(spark, d, "events").select("user_id", F.col("event_id").alias("seq"), "event_type", "value")
    half = F.col("seq") % 2
    return K.upsert(e.where(half == 0), e.where(half == 1), "user_id").select("user_id", "seq", "event_type", "value")


def like_lookup_top(spark, d):
    p = table(spark, d, "part")
    deps = p.select("p_brand", F.element_at(F.split("p_name", " "), -1).alias("name")).distinct().withColumn("dep", F.concat_ws("/", "p_brand", "name"))
    hits = K.like_lookup(deps, p, "p_brand", "name", "p_name", [F.desc("p_retailprice"), "p_partkey"], 50, "dep")
    return hits.select("dep", "p_partkey", "p_retailprice", "rank")


def _search(spark, d, words):
    docs = table(spark, d, "documents").select("doc_id", "text", "n_chars")
    return K.keyword_search(docs, "doc_id", "text", words, [F.desc("n_chars"), "doc_id"], 100).select("doc_id", "n_chars", "matched")


def keyword_search(spark, d):
    return _search(spark, d, ["the", "idiot"])


def keyword_fallback(spark, d):
    return _search(spark, d, ["zzzzq", "worthless", "scum", "x"])


def index_search(spark, d):
    index = K.inverted_index(table(spark, d, "documents"), "doc_id", "text")
    return K.index_search(index, "doc_id", ["of", "the", "trash"])


def semantic_topk(spark, d):
    e = table(spark, d, "embeddings")
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return K.semantic_topk(e, q, 10, 0.1, "vec_id", "embedding")


def class_catalog(spark, d):
    p = table(spark, d, "part")
    classes = p.select("p_brand", "p_type").distinct().withColumn("cls", F.concat_ws("/", "p_brand", "p_type"))
    rows = K.class_catalogue(p.drop("p_type"), classes, "p_brand", "cls", F.col("p_size") >= 49, F.col("p_size") >= 45, [F.desc("p_retailprice"), "p_partkey"], 10)
    return rows.select("cls", "p_partkey", "how", "rank")


def coverage_anti(spark, d):
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    return docs.join(labels.select("doc_id"), "doc_id", "left_anti").groupBy("lang", "source").agg(F.count("*").alias("n_uncovered"), F.sum("n_chars").alias("chars"))


def resume_anti(spark, d):
    done = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, d, "orders").join(done, "o_orderkey", "left_anti").select("o_orderkey", "o_orderpriority")


def dep_rank(spark, d):
    c = table(spark, d, "customer")
    known, epss, cvss = (F.col("c_mktsegment") == "BUILDING").cast("int"), F.abs("c_acctbal") / 10000, F.col("c_nationkey") % 10
    rows = c.withColumns({"known": known, "epss": epss, "score": F.round(K.dependency_score(known, epss, cvss), 4)}).where((F.col("epss") >= 0.05) | (F.col("known") == 1))
    first = P.keep_first(rows, ["c_nationkey", "c_mktsegment"], ["c_custkey"])
    return first.select("c_custkey", "c_nationkey", "c_mktsegment", "score")


def best_per_sink(spark, d):
    li = table(spark, d, "lineitem")
    rows = Z.best_per_sink(li, ["l_partkey", "l_returnflag"], [F.desc("l_extendedprice"), "l_discount", "l_orderkey", "l_linenumber"])
    return rows.select("l_partkey", "l_returnflag", "l_orderkey", "l_linenumber", "l_extendedprice")


def _findings(spark, d) -> DataFrame:
    o = table(spark, d, "orders")
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    rows = o.join(c, "o_custkey")
    return rows.select(F.col("o_orderkey").alias("id"), lookup(F.col("o_orderpriority"), PRIORITY, "LOW").alias("severity"), lookup(F.col("c_mktsegment"), SEGMENT, "xss").alias("category"), (F.col("o_totalprice") > 495000).alias("direct"), (F.col("o_orderstatus") == "F").alias("blocked"), (F.col("o_custkey") % 7).cast("int").alias("steps"), F.col("o_custkey").alias("sink"))


def tiered_budget(spark, d):
    return Z.tiered_budget(_findings(spark, d), CEILING, ["sink", "category", "severity"]).select("id", "severity", "category", "tier")


def score_prioritise(spark, d):
    f = _findings(spark, d)
    return f.select("id", Z.score(F.col("severity"), F.col("category"), F.col("steps"), F.col("blocked")).alias("score")).orderBy(F.desc("score"), "id").limit(200)


def strategic_sample(spark, d):
    return Z.strategic_sample(_findings(spark, d), 10, 50).select("id", "severity")


def coverage_plan(spark, d):
    p = table(spark, d, "part").select(F.col("p_brand").alias("file"), F.col("p_partkey").alias("at"), "p_size")
    first = lambda df: P.keep_first(df, ["file"], ["at"])
    parts = [(first(p.where("p_size = 50")), 5), (first(p.where("p_size >= 48")), 10), (first(p), None)]
    return Z.coverage_plan(parts, "file", "at")


def keep_first(spark, d):
    e = table(spark, d, "events")
    return P.keep_first(e.withColumn("day", F.to_date("ts")), ["user_id", "event_type", "day"], ["ts", "event_id"]).select("user_id", "event_type", "day", "event_id")


def adaptive_config(spark, d):
    n = table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("files"), (F.sum("n_chars") / 1e6).alias("mb"), (F.sum("n_chars") * 40).alias("n_paths"))
    return n.select("source", Z.scale_of(F.col("files"), F.col("mb")).alias("scale"), Z.adaptive_cap(F.col("n_paths")).cast("long").alias("cap"))


def estimate(spark, d):
    n = table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("files"))
    e = Z.estimate(F.col("files"))
    return n.select("lang", *(c.cast("double").alias(k) for k, c in e.items()))


def exploitable_paths(spark, d):
    f = _findings(spark, d)
    e = P.exploitable(F.col("blocked"), F.col("category"), F.col("steps") % 2 == 0, F.col("steps"))
    return f.groupBy("category", e.alias("exploitable")).agg(F.count("*").alias("n"))


def path_context(spark, d):
    """Suppliers as paths with a CWE by nation, parts as records; nations past 20 have no record and take their region's."""
    nation = table(spark, d, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.concat(F.lit("C"), F.col("n_regionkey")).alias("category"))
    found = table(spark, d, "supplier").join(nation, "s_nationkey").select("s_suppkey", F.concat(F.lit("CWE-"), F.col("s_nationkey")).alias("cwe"), "category")
    cwe = lambda k: F.concat(F.lit("CWE-"), (F.col("p_partkey") % k).cast("string"))
    records = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.array_distinct(F.array(cwe(20), cwe(7))).alias("cwe_ids"), F.concat(F.lit("C"), F.col("p_partkey") % 5).alias("category"), (F.col("p_size") + F.col("p_retailprice")).alias("score"))
    return K.context_for(found, records, "s_suppkey", "cwe", "category", "score").select("s_suppkey", "id", "how", "rank")


def top_records(spark, d):
    return K.top_list(table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice"), F.col("p_size") >= 40, [F.desc("p_size"), F.desc("p_retailprice"), "p_partkey"], 25)


def _records(spark, d) -> DataFrame:
    """Parts as vulnerability records."""
    p = table(spark, d, "part")
    cwe = lambda k: F.concat(F.lit("CWE-"), (F.col("p_partkey") % k).cast("string"))
    return p.select(
        F.col("p_partkey").alias("id"), F.when(F.col("p_size") > 10, F.col("p_size") / 50).alias("epss"), (F.col("p_brand") == "Brand#1").cast("int").alias("known_flag"), (F.col("p_size") / 5).alias("cvss"),
        F.col("p_name").alias("description"), F.col("p_type").alias("cpes"), F.col("p_brand").alias("package"), F.array(cwe(140), cwe(95)).alias("cwe_ids"), F.when(F.col("p_size") % 2 == 0, "pypi").otherwise("npm").alias("ecosystem"),
        F.concat_ws(" ", F.lit("before"), F.col("p_size").cast("string"), (F.col("p_size") + 1).cast("string")).alias("affected"))


def search_filters(spark, d):
    """Records that pass every filter, ranked again."""
    score = F.round(K.rank_score(F.col("known_flag"), F.col("epss"), F.col("cvss"), F.lit(0)), 4)
    found = K.filtered(_records(spark, d), score, 100, min_epss=0.3, tech=["SMALL", "large", "brand#2"], cwes=[f"CWE-{k}" for k in range(40, 90)], ecosystem="pypi")
    return found.select("id", "score", "ecosystem")


def known_filter(spark, d):
    return K.filtered(_records(spark, d), F.col("cvss"), 50, known_only=True).select("id", "score")


def version_lookup(spark, d):
    """Dependencies that state a version keep the records that mention it, the others all of their package."""
    deps = table(spark, d, "supplier").select(F.col("s_suppkey").alias("dep"), F.concat(F.lit("Brand#"), F.col("s_nationkey")).alias("name"), F.when(F.col("s_suppkey") % 3 > 0, (F.col("s_suppkey") % 60).cast("string")).alias("version"), F.when(F.col("s_suppkey") % 2 == 0, "pypi").otherwise("npm").alias("ecosystem"))
    hits = K.like_lookup(deps, _records(spark, d), "ecosystem", "name", "package", [F.desc("cvss"), "id"], 5, "dep", version=("affected", "version"))
    return hits.select("dep", "id", "rank")


def cwe_catalogue(spark, d):
    """Per exploit class the five best records that carry one of its CWE ids."""
    rows = _records(spark, d).select("id", "cvss", F.explode("cwe_ids").alias("cwe")).join(F.broadcast(K.cwe_classes(spark)), "cwe").select("cls", "id", "cvss").distinct()
    w = Window.partitionBy("cls").orderBy(F.desc("cvss"), "id")
    return rows.withColumn("rank", F.row_number().over(w)).where("rank <= 5").select("cls", "id", "rank")


def keyword_words(spark, d):
    """The first eight distinct words of a name."""
    return table(spark, d, "part").select("p_partkey", F.array_join(K.keyword_list(F.split(F.concat_ws(" ", "p_name", "p_type", "p_name"), " ")), " ").alias("words"))


def serious_findings(spark, d):
    """Findings that a report shows, in its order."""
    f = _findings(spark, d).select("id", "severity", "category", (F.col("sink") % 100 / 100).alias("confidence"))
    return V.report_order(V.serious(f), "id").limit(200).select("id", "severity", "confidence")


def stated_confidence(spark, d):
    raw = F.when(F.col("l_returnflag") == "A", "exploitable").when(F.col("l_returnflag") == "R", "")
    li = table(spark, d, "lineitem").select("l_returnflag", V.confidence_of(raw, F.when(F.col("l_linestatus") == "F", F.col("l_discount"))).alias("confidence"))
    return li.groupBy("l_returnflag").agg(F.round(F.sum("confidence"), 2).alias("confidence"), F.count("*").alias("n"))


def confirmed_findings(spark, d):
    """Severe findings need the verdict REAL or none; the others stay."""
    f = _findings(spark, d).select("id", "severity")
    verdicts = table(spark, d, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", "REAL").otherwise("FALSE").alias("verdict"))
    return M.confirmed(f, verdicts, ["id"]).groupBy("severity").agg(F.count("*").alias("n"), F.max("id").alias("last"))


QUERIES = {f.__name__: f for f in (search_filters, known_filter, version_lookup, cwe_catalogue, keyword_words, serious_findings, stated_confidence, confirmed_findings, compat_pairs, file_limited_pairs, enrich_left, knowledge_stats, rank_records, upsert_last, like_lookup_top, keyword_search, keyword_fallback, index_search, semantic_topk, class_catalog, coverage_anti, resume_anti, dep_rank, best_per_sink, tiered_budget, score_prioritise, strategic_sample, coverage_plan, keep_first, adaptive_config, estimate, exploitable_paths, path_context, top_records)}

_TOK = "regexp_extract_all(lower(text), '[a-z0-9]+')"
_F = """f AS (SELECT o_orderkey AS id, CASE o_orderpriority WHEN '1-URGENT' THEN 'CRITICAL' WHEN '2-HIGH' THEN 'HIGH' WHEN '3-MEDIUM' THEN 'MEDIUM' ELSE 'LOW' END AS severity,
  CASE c_mktsegment WHEN 'BUILDING' THEN 'sql_injection' WHEN 'AUTOMOBILE' THEN 'ssrf' WHEN 'MACHINERY' THEN 'weak_crypto' WHEN 'HOUSEHOLD' THEN 'path_traversal' ELSE 'xss' END AS category,
  o_totalprice > 495000 AS direct, o_orderstatus = 'F' AS blocked, (o_custkey % 7)::INT AS steps, o_custkey AS sink FROM orders JOIN customer ON c_custkey = o_custkey)"""
_SCORE = "(p_brand = 'Brand#1')::INT * 1000 + coalesce(CASE WHEN p_size > 10 THEN p_size / 50 END, 0) * 500 + p_size / 5 * 5 + (p_type = 'SMALL')::INT * 100"

_R = """rec AS (SELECT p_partkey AS id, CASE WHEN p_size > 10 THEN p_size / 50 END AS epss, (p_brand = 'Brand#1')::INT AS known, p_size / 5 AS cvss, lower(p_type || ' ' || p_name || ' ' || p_brand) AS txt, p_brand AS package,
  ['CWE-' || p_partkey % 140, 'CWE-' || p_partkey % 95] AS cwes, CASE WHEN p_size % 2 = 0 THEN 'pypi' ELSE 'npm' END AS ecosystem, 'before ' || p_size || ' ' || (p_size + 1) AS affected FROM part)"""
_CLASSES = ", ".join(f"('{c}', '{w}')" for c, ws in fixed.CLASS_CWES.items() for w in ws)
ORACLES = {
    "search_filters": f"""WITH {_R} SELECT id, round(known * 1000 + coalesce(epss, 0) * 500 + cvss * 5, 4) AS score, ecosystem FROM rec WHERE coalesce(epss, 0) >= 0.3 AND (contains(txt, 'small') OR contains(txt, 'large') OR contains(txt, 'brand#2'))
      AND list_has_any(cwes, [{', '.join(f"'CWE-{k}'" for k in range(40, 90))}]) AND ecosystem = 'pypi' ORDER BY score DESC, id LIMIT 100""",
    "known_filter": f"WITH {_R} SELECT id, cvss AS score FROM rec WHERE known = 1 ORDER BY cvss DESC, id LIMIT 50",
    "version_lookup": f"""WITH {_R}, dep AS (SELECT s_suppkey AS dep, 'Brand#' || s_nationkey AS name, CASE WHEN s_suppkey % 3 > 0 THEN (s_suppkey % 60)::VARCHAR END AS version, CASE WHEN s_suppkey % 2 = 0 THEN 'pypi' ELSE 'npm' END AS ecosystem FROM supplier)
      SELECT dep, id, row_number() OVER (PARTITION BY dep ORDER BY cvss DESC, id) AS rank FROM dep JOIN rec USING (ecosystem) WHERE contains(package, name) AND (version IS NULL OR contains(affected, version)) QUALIFY rank <= 5""",
    "cwe_catalogue": f"""WITH {_R}, c(cls, cwe) AS (VALUES {_CLASSES}), x AS (SELECT DISTINCT cls, id, cvss FROM (SELECT id, cvss, unnest(cwes) AS cwe FROM rec) JOIN c USING (cwe))
      SELECT cls, id, row_number() OVER (PARTITION BY cls ORDER BY cvss DESC, id) AS rank FROM x QUALIFY rank <= 5""",
    "keyword_words": """WITH w AS (SELECT p_partkey, string_split(p_name || ' ' || p_type || ' ' || p_name, ' ') AS ws FROM part), u AS (SELECT p_partkey, unnest(ws) AS x, generate_subscripts(ws, 1) AS i FROM w),
      f AS (SELECT p_partkey, x, min(i) AS i FROM u GROUP BY ALL) SELECT p_partkey, array_to_string(list(x ORDER BY i)[:8], ' ') AS words FROM f GROUP BY 1""",
    "serious_findings": f"WITH {_F} SELECT id, severity, sink % 100 / 100 AS confidence FROM f WHERE severity IN ('CRITICAL', 'HIGH') AND sink % 100 / 100 >= 0.6 ORDER BY CASE severity WHEN 'CRITICAL' THEN 0 ELSE 1 END, confidence DESC, id LIMIT 200",
    "stated_confidence": "SELECT l_returnflag, round(sum(CASE WHEN l_returnflag <> 'A' THEN 0.3::DOUBLE WHEN l_linestatus = 'F' THEN l_discount ELSE 0.5::DOUBLE END), 2) AS confidence, count(*) AS n FROM lineitem GROUP BY 1",
    "confirmed_findings": f"WITH {_F} SELECT severity, count(*) AS n, max(id) AS last FROM f JOIN orders ON o_orderkey = id WHERE severity NOT IN ('CRITICAL', 'HIGH') OR o_orderstatus IN ('P', 'F') GROUP BY 1",
    "compat_pairs": """WITH s AS (SELECT s_suppkey, 'T' || s_nationkey % 5 AS source_type FROM supplier), k AS (SELECT n_nationkey, 'C' || n_regionkey AS category FROM nation),
      m(source_type, category) AS (VALUES ('T0','C0'),('T0','C1'),('T1','C2'),('T2','C3'),('T2','C4'),('T3','C0'),('T3','C4'))
      SELECT s_suppkey, n_nationkey, source_type, category FROM s, k WHERE (source_type, category) IN (SELECT (source_type, category) FROM m) OR source_type NOT IN (SELECT source_type FROM m)""",
    "file_limited_pairs": """WITH s AS (SELECT s_suppkey, n_regionkey AS f FROM supplier JOIN nation ON s_nationkey = n_nationkey), k AS (SELECT n_nationkey, n_regionkey AS file, 'C' || n_nationkey % 4 AS category FROM nation)
      SELECT n_nationkey, category, count(*) AS n_sources, min(s_suppkey) AS first_source FROM k, s WHERE category NOT IN ('C1', 'C2') OR f = file GROUP BY ALL""",
    "enrich_left": "SELECT d.doc_id, lang, quality, coalesce(toxic, 0)::INT AS known_flag FROM documents d LEFT JOIN labels l USING (doc_id)",
    "knowledge_stats": "SELECT count(*) AS total, count(*) FILTER (p_brand = 'Brand#1') AS known, count(*) FILTER (p_size > 10) AS scored, count(*) FILTER (p_size / 5 >= 9) AS critical, count(*) FILTER (p_type = 'SMALL') AS exploited FROM part",
    "rank_records": f"SELECT p_partkey, round({_SCORE}, 4) AS score FROM part ORDER BY score DESC, p_partkey LIMIT 100",
    "upsert_last": "SELECT user_id, event_id AS seq, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id % 2 DESC, event_id DESC) = 1",
    "like_lookup_top": """WITH deps AS (SELECT DISTINCT p_brand, string_split(p_name, ' ')[-1] AS name FROM part)
      SELECT deps.p_brand || '/' || name AS dep, p_partkey, p_retailprice, row_number() OVER (PARTITION BY deps.p_brand, name ORDER BY p_retailprice DESC, p_partkey) AS rank
      FROM deps JOIN part ON part.p_brand = deps.p_brand AND contains(p_name, name) QUALIFY rank <= 50""",
    "keyword_search": f"SELECT doc_id, n_chars, 'all' AS matched FROM documents WHERE list_has_all({_TOK}, ['the', 'idiot']) ORDER BY n_chars DESC, doc_id LIMIT 100",
    "keyword_fallback": f"SELECT doc_id, n_chars, 'any' AS matched FROM documents WHERE list_has_any({_TOK}, ['zzzzq', 'worthless', 'scum']) ORDER BY n_chars DESC, doc_id LIMIT 100",
    "index_search": f"WITH t AS (SELECT doc_id, unnest({_TOK}) AS token FROM documents) SELECT doc_id, count(*) AS tf FROM t WHERE token IN ('of', 'the', 'trash') GROUP BY doc_id HAVING count(DISTINCT token) = 3",
    "semantic_topk": """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), n AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS z FROM v),
      p AS (SELECT q.vec_id AS query_id, b.vec_id, round(list_dot_product(q.e, b.e) / (q.z * b.z), 6) AS similarity FROM n q, n b WHERE q.vec_id % 50 = 0)
      SELECT query_id, vec_id, similarity, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank FROM p WHERE similarity >= 0.1 QUALIFY rank <= 10""",
    "class_catalog": """WITH c AS (SELECT DISTINCT p_brand, p_brand || '/' || p_type AS cls FROM part), r AS (SELECT cls, p_partkey, p_size, p_retailprice FROM c JOIN part USING (p_brand)),
      m AS (SELECT *, 'main' AS how FROM r WHERE p_size >= 49), b AS (SELECT * FROM m UNION ALL SELECT *, 'fallback' FROM r WHERE p_size >= 45 AND cls NOT IN (SELECT cls FROM m))
      SELECT cls, p_partkey, how, row_number() OVER (PARTITION BY cls ORDER BY p_retailprice DESC, p_partkey) AS rank FROM b QUALIFY rank <= 10""",
    "coverage_anti": "SELECT lang, source, count(*) AS n_uncovered, sum(n_chars)::BIGINT AS chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY ALL",
    "resume_anti": "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)",
    "dep_rank": """SELECT c_custkey, c_nationkey, c_mktsegment, round((c_mktsegment = 'BUILDING')::INT * 10000 + abs(c_acctbal) / 10000 * 1000 + c_nationkey % 10, 4) AS score FROM customer
      WHERE abs(c_acctbal) / 10000 >= 0.05 OR c_mktsegment = 'BUILDING' QUALIFY row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_custkey) = 1""",
    "best_per_sink": "SELECT l_partkey, l_returnflag, l_orderkey, l_linenumber, l_extendedprice FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey, l_returnflag ORDER BY l_extendedprice DESC, l_discount, l_orderkey, l_linenumber) = 1",
    "tiered_budget": f"""WITH {_F}, w AS (SELECT *, CASE severity WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 ELSE 3 END AS rk,
        CASE category WHEN 'sql_injection' THEN 8 WHEN 'ssrf' THEN 6 WHEN 'weak_crypto' THEN 2 WHEN 'path_traversal' THEN 5 ELSE 1 END AS wt FROM f),
      b AS (SELECT * FROM w WHERE NOT direct QUALIFY row_number() OVER (PARTITION BY sink, category, severity ORDER BY wt DESC, blocked, steps, id) = 1),
      r AS (SELECT *, row_number() OVER (PARTITION BY rk ORDER BY wt DESC, blocked, steps, id) AS n FROM b),
      top AS (SELECT id, severity, category, 0 AS tier FROM w WHERE direct UNION ALL SELECT id, severity, category, 1 FROM r WHERE rk = 0
        UNION ALL SELECT id, severity, category, 2 FROM r WHERE rk = 1 AND n <= greatest({CEILING} - (SELECT count(*) FROM w WHERE direct) - (SELECT count(*) FROM r WHERE rk = 0), 0)),
      ex AS (SELECT id, severity, category, 3 AS tier FROM r WHERE rk >= 2 AND category NOT IN (SELECT category FROM top) QUALIFY row_number() OVER (PARTITION BY category ORDER BY rk, wt DESC, blocked, steps, id) = 1),
      ch AS (SELECT * FROM top UNION ALL SELECT * FROM ex),
      fi AS (SELECT id, severity, category, rk + 2 AS tier, row_number() OVER (ORDER BY rk, wt DESC, blocked, steps, id) AS m FROM r WHERE rk >= 2 AND id NOT IN (SELECT id FROM ex))
      SELECT * FROM ch UNION ALL SELECT id, severity, category, tier FROM fi WHERE m <= greatest({CEILING} - (SELECT count(*) FROM ch), 0)""",
    "score_prioritise": f"""WITH {_F} SELECT id, (CASE severity WHEN 'CRITICAL' THEN 1000 WHEN 'HIGH' THEN 500 WHEN 'MEDIUM' THEN 100 ELSE 10 END
        + CASE category WHEN 'sql_injection' THEN 70 WHEN 'ssrf' THEN 60 WHEN 'weak_crypto' THEN 30 WHEN 'path_traversal' THEN 50 ELSE 20 END + greatest(0, 50 - 5 * steps)) * CASE WHEN blocked THEN 1.0 ELSE 1.5 END::DOUBLE AS score FROM f ORDER BY score DESC, id LIMIT 200""",
    "strategic_sample": f"WITH {_F}, n AS (SELECT id, severity, row_number() OVER (PARTITION BY severity ORDER BY id) AS n FROM f) SELECT id, severity FROM n WHERE severity IN ('CRITICAL', 'HIGH') OR (severity = 'MEDIUM' AND (n - 1) % 10 = 0) OR (severity = 'LOW' AND n <= 50)",
    "coverage_plan": """WITH p AS (SELECT p_brand AS file, p_partkey AS k, p_size FROM part), u AS (
        (SELECT file, min(k) AS ord, 0 AS priority FROM p WHERE p_size = 50 GROUP BY 1 ORDER BY 2 LIMIT 5) UNION ALL (SELECT file, min(k), 1 FROM p WHERE p_size >= 48 GROUP BY 1 ORDER BY 2 LIMIT 10) UNION ALL SELECT file, min(k), 2 FROM p GROUP BY 1)
      SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY file ORDER BY priority, ord) = 1""",
    "keep_first": "SELECT user_id, event_type, ts::DATE AS day, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type, ts::DATE ORDER BY ts, event_id) = 1",
    "adaptive_config": """WITH n AS (SELECT source, count(*) AS files, sum(n_chars) / 1e6 AS mb, sum(n_chars)::BIGINT * 40 AS p FROM documents GROUP BY 1)
      SELECT source, CASE WHEN mb > 1000 THEN 'huge' WHEN files < 100 THEN 'small' WHEN files < 1000 THEN 'medium' WHEN files < 10000 THEN 'large' ELSE 'huge' END AS scale,
        CASE WHEN p < 5000 THEN 0 WHEN p >= 50000 THEN greatest(2000, least(5000, p // 15)) WHEN p >= 30000 THEN greatest(2000, least(4000, p // 15)) ELSE 2000 END AS cap FROM n""",
    "estimate": """WITH n AS (SELECT lang, count(*) AS f FROM documents GROUP BY 1), p AS (SELECT *, greatest(50, floor(f * 3 * f * 2 * 1e-4)) AS paths FROM n)
      SELECT lang, (f * 5)::DOUBLE AS functions, (f * 3)::DOUBLE AS sources, (f * 2)::DOUBLE AS sinks, paths::DOUBLE AS paths, (least(5000, paths) * 15 / 60)::DOUBLE AS minutes FROM p""",
    "path_context": """WITH f AS (SELECT s_suppkey, s_nationkey AS k, n_regionkey AS g FROM supplier JOIN nation ON n_nationkey = s_nationkey), r AS (SELECT p_partkey AS id, p_size + p_retailprice AS score FROM part),
      a AS (SELECT s_suppkey, id, 'cwe' AS how, score FROM f JOIN r ON id % 20 = k OR id % 7 = k), b AS (SELECT * FROM a UNION ALL SELECT s_suppkey, id, 'category', score FROM f JOIN r ON id % 5 = g WHERE s_suppkey NOT IN (SELECT s_suppkey FROM a))
      SELECT s_suppkey, id, how, row_number() OVER (PARTITION BY s_suppkey ORDER BY score DESC, id) AS rank FROM b QUALIFY rank <= 3""",
    "top_records": "SELECT p_partkey, p_size, p_retailprice FROM part WHERE p_size >= 40 ORDER BY p_size DESC, p_retailprice DESC, p_partkey LIMIT 25",
    "exploitable_paths": f"WITH {_F} SELECT category, CASE WHEN blocked THEN false WHEN steps > 0 AND steps % 2 <> 0 THEN false ELSE true END AS exploitable, count(*) AS n FROM f GROUP BY ALL",
}
