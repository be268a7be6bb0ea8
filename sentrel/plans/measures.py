"""Evaluation, anomalies, votes, inventories and summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from sentrel.functions.expressions import json_body, tokens_of
from sentrel.operators import evaluate as V
from sentrel.session import table

BAD = "idiot|scum|moron|loser|trash|stupid"


def confusion(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", "source", F.lower("text").rlike(BAD).alias("predicted"))
    rows = docs.join(table(spark, d, "labels").select("doc_id", "toxic"), "doc_id")
    return V.confusion(rows, F.col("toxic"), F.col("predicted"), [[], ["lang", "source"], ["lang"]], ["lang", "source"])


def anomaly(spark, d):
    """Days on which a user's share of errors is far below that user's other days."""
    day = table(spark, d, "events").groupBy(F.concat_ws("-", F.lit("u"), F.col("user_id") % 10).alias("grp"), F.to_date("ts").alias("day")).agg((F.count_if(F.col("event_type") == "error") / F.count("*")).alias("ratio"))
    out = V.anomalies(day, day, "grp", 1.5)
    return out.select("grp", "day", F.round("ratio", 6).alias("ratio"), "limit", "suspicious")


def vote(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", "event_type")
    return V.vote(e, "user_id", "event_id", "event_type", 0.2).select("user_id", "first_value", "agreement", "stable", "majority", "by_two_thirds")


def inventory(spark, d):
    docs = table(spark, d, "documents")
    breaks = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))
    return docs.groupBy("lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"), F.sum(breaks).alias("line_breaks"), F.max_by("source", F.struct("n_chars", "doc_id")).alias("largest_source"))


def source_sets(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("langs"), F.countDistinct("lang").alias("n_langs"))


def tree_hash(spark, d):
    """SHA-256 per source over the sorted lines id:hash of its documents."""
    rows = table(spark, d, "documents").select("source", F.lpad(F.col("doc_id").cast("string"), 20, "0").alias("path"), F.sha2("text", 256).alias("hash"))
    return V.tree_hash(rows, "source", "path", "hash").select("source", "tree")


def path_summary(spark, d):
    li = table(spark, d, "lineitem").select((F.col("l_returnflag") == "R").alias("blocked"), (F.col("l_quantity") > 10).alias("exploitable"), F.col("l_orderkey").alias("source_file"), F.col("l_linenumber").alias("source_line"), F.col("l_partkey").alias("sink_file"), F.col("l_suppkey").alias("sink_line"))
    return V.path_summary(li)


def verdict_summary(spark, d):
    raw = F.when(F.col("l_returnflag") == "A", "exploitable").when(F.col("l_returnflag") == "R", "blocked").otherwise("other")
    li = table(spark, d, "lineitem").select(F.col("l_linestatus").alias("analysis_source"), V.verdict_of(raw).alias("verdict"))
    return V.verdict_summary(li)


def best_setting(spark, d):
    """The setting of the highest rate, and how many answers it leaves time for."""
    e = table(spark, d, "events").groupBy((F.col("user_id") % 5 * 8).cast("int").alias("setting")).agg(F.round(F.avg("value"), 4).alias("rate"))
    return V.best_setting(e, "setting", "rate")


def answer_bodies(spark, d):
    """JSON inside answers: fenced, thought about, followed by more brackets, with brackets in strings, cut off or absent."""
    k = F.col("o_orderkey").cast("string")
    body = F.concat(F.lit('{"a": {"id": '), k, F.lit('}, "b": ["}", "\\\\"]}'))
    text = F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit("<think>{no}</think> so\n```json\n"), body, F.lit("\n``` or {x}"))).when(F.col("o_orderkey") % 4 == 1, F.concat(F.lit("say ["), k, F.lit(", {}] and ]"))).when(F.col("o_orderkey") % 4 == 2, F.concat(F.lit("cut "), F.substring(body, 1, 12))).otherwise(F.lit("none"))
    return table(spark, d, "orders").select("o_orderkey", json_body(text).alias("body"))


def unsent_pack(spark, d):
    """Texts that fit in the budget of a source, each once, without those that went out before."""
    docs = table(spark, d, "documents").select("doc_id", "source", F.md5("text").alias("digest"), tokens_of(F.col("text")).alias("n"))
    sent = docs.where("doc_id % 7 = 0")
    return V.budget_pack(V.unsent(docs, ["source", "digest"], "doc_id", sent), "doc_id", F.col("n"), 20000, "source").select("doc_id", "source", "running")


def severity_breakdown(spark, d):
    return V.breakdown(table(spark, d, "orders"), "o_orderpriority")


def calibrate(spark, d):
    li = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.avg((F.col("l_returnflag") == "A").cast("double")).alias("precision"))
    return li.select("l_suppkey", F.round("precision", 6).alias("precision"), F.round(V.calibrated(F.col("precision") * 3, F.lit(0.6)), 4).alias("threshold"))


def json_extract(spark, d):
    e = table(spark, d, "events").select("event_type", F.from_json("props", "k INT").alias("p"))
    return e.groupBy("event_type").agg(F.sum("p.k").alias("k"), F.count_if(F.col("p.k") > 50).alias("large"))


def budget_pack(spark, d):
    docs = table(spark, d, "documents").withColumns({"tokens": F.floor(F.col("n_chars") / 4), "grp": F.concat_ws("/", "source", "lang")})
    return V.budget_pack(docs, "doc_id", F.col("tokens"), 4000, "grp").select("doc_id", "grp", "running")


def event_windows(spark, d):
    """Tumbling hours as a batch; the stream of the same name gives equal rows."""
    e = table(spark, d, "events").groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"), "event_type")
    return e.agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


QUERIES = {f.__name__: f for f in (confusion, anomaly, vote, inventory, source_sets, tree_hash, path_summary, verdict_summary, severity_breakdown, calibrate, json_extract, answer_bodies, best_setting, unsent_pack, budget_pack, event_windows)}

ORACLES = {
    "confusion": f"""WITH r AS (SELECT lang, source, toxic = 1 AS t, regexp_matches(lower(text), '{BAD}') AS p FROM documents JOIN labels USING (doc_id)),
      c AS (SELECT lang, source, sum((t AND p)::INT)::BIGINT AS tp, sum((NOT t AND p)::INT)::BIGINT AS fp, sum((t AND NOT p)::INT)::BIGINT AS fn, sum((NOT t AND NOT p)::INT)::BIGINT AS tn, grouping_id(lang, source) AS grain FROM r GROUP BY GROUPING SETS ((), (lang, source), (lang)))
      SELECT *, round(coalesce(tp / nullif(tp + fp, 0), 0), 4) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 4) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 4) AS f1, round(coalesce((tp + tn) / nullif(tp + fp + fn + tn, 0), 0), 4) AS accuracy FROM c""",
    "anomaly": """WITH x AS (SELECT 'u-' || user_id % 10 AS grp, ts::DATE AS day, count(*) FILTER (event_type = 'error') / count(*) AS ratio FROM events GROUP BY ALL),
      s AS (SELECT grp, avg(ratio) AS m, coalesce(stddev_samp(ratio), avg(ratio) * 0.5) AS z FROM x GROUP BY 1)
      SELECT grp, day, round(ratio, 6) AS ratio, round(m - 1.5 * z, 6) AS "limit", ratio < m - 1.5 * z AS suspicious FROM x JOIN s USING (grp)""",
    "vote": """WITH f AS (SELECT user_id, arg_min(event_type, event_id) AS first_value FROM events GROUP BY 1), c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL),
      b AS (SELECT user_id, sum(n) AS runs, arg_max(event_type, row(n, event_type)) AS majority, max(n) AS top FROM c GROUP BY 1)
      SELECT user_id, first_value, round(n / runs, 4) AS agreement, n / runs >= 0.2 AS stable, majority, top / runs >= 2.0 / 3 AS by_two_thirds FROM b JOIN f USING (user_id) JOIN c ON c.user_id = b.user_id AND c.event_type = first_value""",
    "inventory": "SELECT lang, count(*) AS n, sum(n_chars)::BIGINT AS chars, sum(length(text) - length(replace(text, chr(10), '')))::BIGINT AS line_breaks, arg_max(source, row(n_chars, doc_id)) AS largest_source FROM documents GROUP BY 1",
    "source_sets": "SELECT source, string_agg(DISTINCT lang, ',' ORDER BY lang) AS langs, count(DISTINCT lang) AS n_langs FROM documents GROUP BY 1",
    "tree_hash": "SELECT source, sha256(string_agg(lpad(doc_id::VARCHAR, 20, '0') || ':' || sha256(text), chr(10) ORDER BY doc_id)) AS tree FROM documents GROUP BY 1",
    "path_summary": "SELECT count(*) AS paths, count(*) FILTER (l_returnflag = 'R') AS blocked, count(*) FILTER (l_returnflag <> 'R' AND l_quantity > 10) AS exploitable, count(DISTINCT (l_orderkey, l_linenumber)) AS sources, count(DISTINCT (l_partkey, l_suppkey)) AS sinks FROM lineitem",
    "verdict_summary": "SELECT l_linestatus AS analysis_source, count(*) FILTER (l_returnflag = 'A') AS \"VERIFIED_EXPLOITABLE\", count(*) FILTER (l_returnflag = 'R') AS \"BLOCKED\", count(*) FILTER (l_returnflag NOT IN ('A', 'R')) AS \"UNCERTAIN\" FROM lineitem GROUP BY 1",
    "severity_breakdown": "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1",
    "calibrate": """WITH p AS (SELECT l_suppkey, avg((l_returnflag = 'A')::DOUBLE::DOUBLE) AS p FROM lineitem GROUP BY 1)
      SELECT l_suppkey, round(p, 6) AS precision, round(least(0.95, greatest(0.3, 0.6 + CASE WHEN p * 3 < 0.3 THEN 0.15 WHEN p * 3 < 0.5 THEN 0.1 WHEN p * 3 < 0.7 THEN 0.05 WHEN p * 3 > 0.9 THEN -0.05 ELSE 0 END)), 4)::DOUBLE AS threshold FROM p""",
    "json_extract": "SELECT event_type, sum((props::JSON->>'k')::INT)::BIGINT AS k, count(*) FILTER ((props::JSON->>'k')::INT > 50) AS large FROM events GROUP BY 1",
    "best_setting": "WITH t AS (SELECT (user_id % 5 * 8)::INT AS setting, round(avg(value), 4) AS rate FROM events GROUP BY 1) SELECT setting, rate, least(10, greatest(1, floor(rate * 180 / 2048)))::BIGINT AS hypotheses FROM t ORDER BY rate DESC, setting LIMIT 1",
    "answer_bodies": """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN '{"a": {"id": ' || o_orderkey || '}, "b": ["}", "\\\\"]}' WHEN 1 THEN '[' || o_orderkey || ', {}]' END AS body FROM orders""",
    "unsent_pack": """WITH d AS (SELECT doc_id, source, md5(text) AS h, length(text) AS n FROM documents), u AS (SELECT source, h, min(doc_id) AS doc_id, min(n) AS n FROM d GROUP BY ALL HAVING NOT bool_or(doc_id % 7 = 0)),
      r AS (SELECT doc_id, source, sum(n // 4) OVER (PARTITION BY source ORDER BY doc_id)::BIGINT AS running FROM u) SELECT * FROM r WHERE running <= 20000""",
    "budget_pack": "SELECT * FROM (SELECT doc_id, source || '/' || lang AS grp, sum(n_chars // 4) OVER (PARTITION BY source, lang ORDER BY doc_id)::BIGINT AS running FROM documents) WHERE running <= 4000",
    "event_windows": "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
}
