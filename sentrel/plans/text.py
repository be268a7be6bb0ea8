"""Tagging queries over documents and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentrel.functions import rules as R
from sentrel.functions.expressions import first_match, severity_rank, weight_of
from sentrel.operators import graph, tagging
from sentrel.operators.paths import keep_first
from sentrel.session import table

BLOCK, WIDE = 10, 25
SECRET = r'(?:token|secret|api_key) = "([0-9A-Za-z]{8,})"'
PAGE_SINKS = [R.Rule("*", r"<script", "xss", "CWE-79"), R.Rule("*", r"href=\"http:", "ssrf", "CWE-918"), R.Rule("*", r"<a href", "csrf", "CWE-352")]


def _lines(spark: SparkSession, d: str, rules) -> DataFrame:
    """Lines of the documents that some rule matches; no rule here spans lines."""
    docs = table(spark, d, "documents")
    return tagging.lines(docs.where(tagging.any_match(F.col("text"), rules)), "doc_id")


def _sinks(spark: SparkSession, d: str) -> DataFrame:
    return tagging.dedup_sinks(tagging.tag(_lines(spark, d, R.TEXT_SINKS), R.TEXT_SINKS), "doc_id")


def tag_sources(spark, d):
    return tagging.tag(_lines(spark, d, R.TEXT_SOURCES), R.TEXT_SOURCES).select("doc_id", "line", "category", "value")


def tag_sinks_dedup(spark, d):
    return _sinks(spark, d)


def tag_sanitizers(spark, d):
    pages = tagging.lines(table(spark, d, "pages"), "page_id", "html")
    hits = tagging.tag(pages, R.HTML_SANITIZERS)
    return hits.groupBy("page_id", "category").agg(F.count("*").alias("n_hits"), F.array_join(F.array_sort(F.first("protects")), ",").alias("protects"))


def sanitizer_block(spark, d):
    pages = tagging.lines(table(spark, d, "pages"), "page_id", "html")
    sinks = tagging.tag(pages, PAGE_SINKS).groupBy("page_id", "category").agg(F.count("*").alias("n_sinks"))
    return tagging.blocking(sinks, tagging.tag(pages, R.HTML_SANITIZERS), "page_id").select("page_id", "category", "n_sinks", "blocked")


def secret_entropy(spark, d):
    return tagging.secrets(_lines(spark, d, [R.Rule("*", SECRET, "secret")]), SECRET, 3.0).select("doc_id", "line", "secret", "entropy")


def _spans(spark, d, *widths: int) -> DataFrame:
    """Blocks of some lines of the documents that have a sink."""
    docs = table(spark, d, "documents").where(tagging.any_match(F.col("text"), R.TEXT_SINKS))
    n = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    out = None
    for w in widths:
        s = docs.select("doc_id", F.explode(F.sequence(F.lit(1), n, F.lit(w))).alias("start")).select("doc_id", "start", (F.col("start") + w - 1).alias("end"))
        out = s if out is None else out.unionByName(s)
    return out


def enclosing_block(spark, d):
    """The innermost block of every sink, and how many blocks it is in: one join and one aggregate."""
    hits = _sinks(spark, d).select("doc_id", "line", "category")
    joined = graph.enclosing(hits, _spans(spark, d, BLOCK, WIDE), "doc_id", "line", "start", "end")
    inner = F.min_by(F.struct("start", "end"), F.struct(F.col("end") - F.col("start"), -F.col("start"))).alias("b")
    return joined.groupBy("doc_id", "line", "category").agg(inner, F.count("*").alias("n_spans")).select("doc_id", "line", "category", "b.start", "b.end", "n_spans")


def risk_report(spark, d):
    """Sinks by severity and category: blocks where they are the worst, documents, matches."""
    hits = graph.enclosing(_sinks(spark, d), _spans(spark, d, BLOCK), "doc_id", "line", "start", "end")
    hits = hits.withColumn("w", weight_of(F.col("category")))
    worst = keep_first(hits, ["doc_id", "start"], [severity_rank(F.col("severity")), F.desc("w"), "line", "category"])
    return worst.groupBy("severity", "category").agg(F.count("*").alias("n_blocks"), F.countDistinct("doc_id").alias("n_documents"), F.sum("n_matches").alias("n_matches"))


def hot_files(spark, d):
    n = _sinks(spark, d).groupBy("doc_id").agg(F.count("*").alias("n_sinks"), F.countDistinct("category").alias("n_categories"))
    return n.orderBy(F.desc("n_sinks"), "doc_id").limit(15)


def context_window(spark, d):
    """Secret lines without a license word within five lines."""
    docs = table(spark, d, "documents").where(F.col("text").rlike(SECRET))
    rows = tagging.context(docs, F.col("content").rlike(SECRET), 4, 5, keep=["doc_id"])
    return rows.select("doc_id", "line", F.length("context").alias("n_context"), F.col("context").rlike("[Ll]icensed under").alias("guarded"))


def snippet(spark, d):
    at = _lines(spark, d, [R.Rule("*", SECRET, "secret")]).where(F.col("content").rlike(SECRET)).groupBy("doc_id").agg(F.min("line").alias("at_line"))
    docs = table(spark, d, "documents").select("doc_id", "text").join(at, "doc_id")
    return tagging.snippet(docs, "at_line", 2, 1).select("doc_id", "at_line", "snippet")


def operand_extract(spark, d):
    """Attribute values of pages with a severity by their shape."""
    hits = tagging.lines(table(spark, d, "pages"), "page_id", "html").select("page_id", F.explode(F.regexp_extract_all("content", F.lit(r'([a-z]+)="[^"]*"'), 0)).alias("m"))
    rows = hits.select("page_id", F.regexp_extract("m", r'^([a-z]+)="([^"]*)"', 1).alias("name"), F.regexp_extract("m", r'^([a-z]+)="([^"]*)"', 2).alias("value"))
    sev = first_match([(F.col("value").rlike("^https?:"), "HIGH"), (F.col("value").rlike("[0-9]"), "MEDIUM"), (F.col("value") == "", "INFO")], "LOW")
    return rows.groupBy("page_id", "name", sev.alias("severity")).agg(F.count("*").alias("n_values"), F.max(F.length("value")).alias("longest"))


def classify_rules(spark, d):
    """First matching rule over url and html; ``second`` if another rule holds too."""
    u, h = F.col("url"), F.col("html")
    rules = [(u.contains("/de/") & h.contains("<table"), "german_table"), (u.contains("utm_source"), "campaign"), (h.contains("<pre"), "code"), (u.rlike(r"\.html$"), "static"), (u.contains("blog."), "blog"), (h.contains("lang=\"en\""), "english")]
    n = sum((c.cast("int") for c, _ in rules), F.lit(0))
    return table(spark, d, "pages").select("page_id", first_match(rules, "other").alias("class"), (n >= 2).alias("second"))


def url_inventory(spark, d):
    """Hosts, depth and extension of pages."""
    path = F.regexp_extract("url", r"^[a-z]+://[^/]+([^?#]*)", 1)
    rows = table(spark, d, "pages").select(F.regexp_extract("url", r"^[a-z]+://([^/?#]+)", 1).alias("host"), F.size(F.filter(F.split(path, "/"), lambda s: s != "")).alias("depth"), F.regexp_extract(path, r"(\.[a-z]+)$", 1).alias("ext"))
    return rows.groupBy("host", "depth", "ext").agg(F.count("*").alias("n_pages"))


QUERIES = {f.__name__: f for f in (risk_report, tag_sources, tag_sinks_dedup, tag_sanitizers, sanitizer_block, secret_entropy, enclosing_block, hot_files, context_window, snippet, operand_extract, classify_rules, url_inventory)}


def _sql_lines(tab: str, key: str, col: str) -> str:
    return f"SELECT {key}, unnest(string_split({col}, chr(10))) AS content, generate_subscripts(string_split({col}, chr(10)), 1) AS line FROM {tab}"


def _sql_tags(src: str, key: str, rules) -> str:
    q = lambda s: s.replace("'", "''")
    return " UNION ALL ".join(f"SELECT {key}, line, {k} AS ord, '{r.category}' AS category, '{r.cwe}' AS cwe, '{','.join(sorted(r.protects))}' AS protects, substr(unnest(regexp_extract_all(content, '{q(r.pattern)}', {r.group})), 1, 200) AS value FROM {src}" for k, r in enumerate(rules))


_DOCS = _sql_lines("documents", "doc_id", "text")
_PAGES = _sql_lines("pages", "page_id", "html")
_SEV = "CASE WHEN category IN ('ssrf') THEN 'HIGH' WHEN category IN ('hardcoded_secret', 'information_disclosure', 'web_framework') THEN 'MEDIUM' ELSE 'LOW' END"
_SINKS = f"""l AS ({_DOCS}), t AS ({_sql_tags('l', 'doc_id', R.TEXT_SINKS)}),
c AS (SELECT doc_id, line, category, string_agg(cwe, ',' ORDER BY o) AS cwe_ids FROM (SELECT doc_id, line, category, cwe, min(ord) AS o FROM t GROUP BY ALL) GROUP BY ALL),
s AS (SELECT doc_id, line, category, arg_min(value, row(ord, value)) AS matched, count(*) AS n_matches, {_SEV} AS severity FROM t GROUP BY doc_id, line, category),
sinks AS (SELECT doc_id, line, category, matched, cwe_ids, n_matches, severity FROM s JOIN c USING (doc_id, line, category))"""
_SQL_SPANS = "SELECT doc_id, unnest(range(1, len(string_split(text, chr(10))) + 1, {0})) AS st, st + {0} - 1 AS en FROM documents"

ORACLES = {
    "tag_sources": f"WITH l AS ({_DOCS}) SELECT doc_id, line, category, value FROM ({_sql_tags('l', 'doc_id', R.TEXT_SOURCES)})",
    "tag_sinks_dedup": f"WITH {_SINKS} SELECT * FROM sinks",
    "tag_sanitizers": f"WITH l AS ({_PAGES}), t AS ({_sql_tags('l', 'page_id', R.HTML_SANITIZERS)}) SELECT page_id, category, count(*) AS n_hits, any_value(protects) AS protects FROM t GROUP BY ALL",
    "sanitizer_block": f"""WITH l AS ({_PAGES}), k AS ({_sql_tags('l', 'page_id', PAGE_SINKS)}), z AS ({_sql_tags('l', 'page_id', R.HTML_SANITIZERS)}),
      need(category, shield) AS (VALUES ('xss', 'xss'), ('xss', 'html_injection'), ('ssrf', 'ssrf'), ('ssrf', 'url_manipulation'), ('csrf', 'csrf')),
      safe AS (SELECT DISTINCT page_id, category FROM need JOIN (SELECT page_id, unnest(string_split(protects, ',')) AS shield FROM z) USING (shield))
      SELECT page_id, category, count(*) AS n_sinks, (page_id, category) IN (SELECT (page_id, category) FROM safe) AS blocked FROM k GROUP BY ALL""",
    "secret_entropy": f"""WITH l AS ({_DOCS}), s AS (SELECT doc_id, line, unnest(regexp_extract_all(content, '{SECRET}', 1)) AS secret FROM l)
      SELECT * FROM (SELECT doc_id, line, secret, round(list_entropy(regexp_extract_all(secret, '.')), 4) AS entropy FROM s) WHERE entropy >= 3.0""",
    "enclosing_block": f"""WITH {_SINKS}, sp AS ({_SQL_SPANS.format(BLOCK)} UNION ALL {_SQL_SPANS.format(WIDE)}),
      j AS (SELECT s.doc_id, line, category, st, en, count(*) OVER (PARTITION BY s.doc_id, line, category) AS n_spans,
              row_number() OVER (PARTITION BY s.doc_id, line, category ORDER BY en - st, st DESC) AS r FROM sinks s JOIN sp ON sp.doc_id = s.doc_id AND line BETWEEN st AND en)
      SELECT doc_id, line, category, st AS start, en AS "end", n_spans FROM j WHERE r = 1""",
    "risk_report": f"""WITH {_SINKS}, b AS (SELECT *, (line - 1) // {BLOCK} AS blk, row_number() OVER (PARTITION BY doc_id, (line - 1) // {BLOCK} ORDER BY CASE severity WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 ELSE 3 END,
        CASE category WHEN 'ssrf' THEN 6 WHEN 'hardcoded_secret' THEN 3 ELSE 1 END DESC, line, category) AS r FROM sinks)
      SELECT severity, category, count(*) AS n_blocks, count(DISTINCT doc_id) AS n_documents, sum(n_matches)::BIGINT AS n_matches FROM b WHERE r = 1 GROUP BY ALL""",
    "hot_files": f"WITH {_SINKS} SELECT doc_id, count(*) AS n_sinks, count(DISTINCT category) AS n_categories FROM sinks GROUP BY doc_id ORDER BY n_sinks DESC, doc_id LIMIT 15",
    "context_window": f"""WITH l AS ({_DOCS}), w AS (SELECT doc_id, line, content, array_to_string(list(content) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN 4 PRECEDING AND 5 FOLLOWING), chr(10)) AS ctx FROM l)
      SELECT doc_id, line, length(ctx) AS n_context, regexp_matches(ctx, '[Ll]icensed under') AS guarded FROM w WHERE regexp_matches(content, '{SECRET}')""",
    "snippet": f"""WITH l AS ({_DOCS}), a AS (SELECT doc_id, min(line) AS at_line FROM l WHERE regexp_matches(content, '{SECRET}') GROUP BY 1)
      SELECT doc_id, at_line, array_to_string(string_split(text, chr(10))[greatest(at_line - 2, 1):at_line + 1], chr(10)) AS snippet FROM documents JOIN a USING (doc_id)""",
    "operand_extract": f"""WITH l AS ({_PAGES}), m AS (SELECT page_id, unnest(regexp_extract_all(content, '([a-z]+)="[^"]*"', 0)) AS m FROM l),
      v AS (SELECT page_id, regexp_extract(m, '^([a-z]+)="([^"]*)"', 1) AS name, regexp_extract(m, '^([a-z]+)="([^"]*)"', 2) AS value FROM m)
      SELECT page_id, name, CASE WHEN regexp_matches(value, '^https?:') THEN 'HIGH' WHEN regexp_matches(value, '[0-9]') THEN 'MEDIUM' WHEN value = '' THEN 'INFO' ELSE 'LOW' END AS severity, count(*) AS n_values, max(length(value)) AS longest FROM v GROUP BY ALL""",
    "classify_rules": """WITH f AS (SELECT page_id, contains(url, '/de/') AND contains(html, '<table') AS a, contains(url, 'utm_source') AS b, contains(html, '<pre') AS c, regexp_matches(url, '\\.html$') AS d, contains(url, 'blog.') AS e, contains(html, 'lang="en"') AS g FROM pages)
      SELECT page_id, CASE WHEN a THEN 'german_table' WHEN b THEN 'campaign' WHEN c THEN 'code' WHEN d THEN 'static' WHEN e THEN 'blog' WHEN g THEN 'english' ELSE 'other' END AS class, a::INT + b::INT + c::INT + d::INT + e::INT + g::INT >= 2 AS second FROM f""",
    "url_inventory": """WITH p AS (SELECT regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/]+([^?#]*)', 1) AS path FROM pages)
      SELECT host, len(list_filter(string_split(path, '/'), lambda s: s <> '')) AS depth, regexp_extract(path, '(\\.[a-z]+)$', 1) AS ext, count(*) AS n_pages FROM p GROUP BY ALL""",
}
