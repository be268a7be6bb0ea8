"""URL filter: host rules first, then a tree of path templates judged by labelled purity.

Per host, a path is first generalised by shape (digit runs become ``#``, long hex runs ``~``), which makes a small table of
(host, shape) counts. The tree is then walked level by level, for as long as a branch holds pages of both labels:

* A segment of few pages is a variable one: it becomes the wildcard ``*``.
* Frequent labelled branches of a node merge where a two-proportion z test finds them similar. They are dealt to bins by
  their smoothed share of blocked pages, and neighbouring bins that do not differ are one branch.
* A frequent branch without labels joins the branch whose next segments are clearly the most like its own, else the wildcard.

A branch whose labels agree, or that has none, is a template. Its purity is the share of allowed pages, smoothed towards
the purity of the branch above it, a host's towards that of all hosts, and theirs towards one half. A template of a
purity under one half is rejected. So an unlabelled branch follows the branch above it.

Only counts are shuffled, and a hot host is summed before the shuffle. No step holds the branches of a host together:
a window sees a node's bins, sixteen at most. Tables that a hot key is joined with are written first, so that such joins
can be split. A level is one round of joins; there are as many as the deepest branch with labels of both kinds has.

Defined cases: a null url, or one without ``://``, has an empty host and path and no rule; hosts are
lower-cased for A-Z only; without any labels all pages are allowed; equal rows get equal results; a path of any length or depth
is walked as far as its labels differ; empty tables give empty results; other columns are ignored whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sentrel.llm.common import ascii_lower, materialize, pick, release

#: (verdict, rule): a rule is a host and the start of a path.
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: Pages that make a segment frequent, and the z of the test.
MIN_SUPPORT, Z = 5, 1.96
#: Purity below which a template is rejected, and how many pages the purity above a branch counts for.
REJECT, STRENGTH = 0.5, 2.0
BINS = 16
#: How much more alike, of 1, the best branch must be than the second for an unlabelled one to join it.
MARGIN = 0.1

def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, URL, 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null without one. The rules are configuration."""
    rule = verdict = None
    for v, r in sorted(rules, key=lambda x: (-len(x[1]), x[1])):
        h, p = r.split("/", 1)
        fits = ((host == h) | host.endswith("." + h)) & path.startswith("/" + p)
        rule = F.when(fits, F.lit(r)) if rule is None else rule.when(fits, F.lit(r))
        verdict = F.when(fits, F.lit(v)) if verdict is None else verdict.when(fits, F.lit(v))
    return (rule, verdict) if rule is not None else (F.lit(None).cast("string"), F.lit(None).cast("string"))


def shape_of(path: Column) -> Column:
    """Runs of eight or more hex digits that hold a digit become ~, digit runs become #."""
    return F.regexp_replace(F.regexp_replace(path, r"\b(?=[0-9a-f]*[0-9])(?=[0-9a-f]*[a-f])[0-9a-f]{8,}\b", "~"), r"[0-9]+", "#")


def _level(t: DataFrame, support: int, z: float) -> DataFrame:
    """Nodes' shapes one segment on: (host, shape, n, lab, bad, segs, prefix, purity, open).

    t: (host, shape, n, lab, bad, segs, prefix, up), where prefix is the node, segs what is left of the path and up the
    node's purity.
    """
    node, sums = ["host", "prefix"], [F.sum(c).alias(c) for c in ("n", "lab", "bad")]
    seg = lambda k: F.coalesce(F.get("segs", F.lit(k)), F.lit(""))
    t = t.withColumns({"seg": seg(0), "next": seg(1), "ended": F.size("segs") == 0})
    child = t.groupBy(*node, "seg").agg(*sums).where(F.col("n") >= support)
    share = (F.col("bad") + 1) / (F.col("lab") + 2)
    known = child.where("lab > 0").withColumn("bin", F.least(F.floor(share * BINS), F.lit(BINS - 1)))
    bins = known.groupBy(*node, "bin").agg(F.sum("lab").alias("lab"), F.sum("bad").alias("bad"))
    w = Window.partitionBy(*node).orderBy("bin")
    bins = bins.withColumns({"lab0": F.lag("lab").over(w), "bad0": F.lag("bad").over(w)})
    p = (F.col("bad") + F.col("bad0")) / (F.col("lab") + F.col("lab0"))
    gap = F.col("bad") / F.col("lab") - F.col("bad0") / F.col("lab0")
    differ = F.coalesce(gap * gap > z * z * p * (1 - p) * (1 / F.col("lab") + 1 / F.col("lab0")), F.lit(False))
    bins = bins.withColumn("differ", differ.cast("int")).select(*node, "bin", F.sum("differ").over(w).alias("cluster"))
    merged = materialize(known.join(bins, [*node, "bin"]).select(*node, "seg", "cluster", "n"), "merged-branches")
    named = merged.groupBy(*node, "cluster").agg(F.min("seg").alias("first"), F.count("*").alias("k"), F.sum("n").alias("all"))
    named = named.withColumn("name", F.when(F.col("k") == 1, F.col("first")).otherwise(F.concat("first", F.lit("|"))))
    # unlabelled branches by the overlap of their next segments with those of the merged ones
    nexts = t.groupBy(*node, "seg", "next").agg(F.sum("n").alias("m"))
    free = nexts.join(child.where("lab = 0").select(*node, "seg", "n"), [*node, "seg"]).select(*node, "seg", "next", (F.col("m") / F.col("n")).alias("own"))
    theirs = nexts.join(merged.drop("n"), [*node, "seg"]).groupBy(*node, "cluster", "next").agg(F.sum("m").alias("m")).join(named, [*node, "cluster"])
    theirs = theirs.select(*node, "cluster", "name", "next", (F.col("m") / F.col("all")).alias("their"))
    alike = free.join(theirs, [*node, "next"]).groupBy(*node, "seg", "cluster", "name").agg(F.round(F.sum(F.least("own", "their")), 9).alias("score"))
    best = alike.groupBy(*node, "seg").agg(F.sort_array(F.collect_list("score"), asc=False).alias("scores"), F.max_by("name", F.struct("score", -F.col("cluster"))).alias("name"))
    best = best.where(F.get("scores", F.lit(0)) - F.coalesce(F.get("scores", F.lit(1)), F.lit(0.0)) >= MARGIN)
    names = merged.join(named, [*node, "cluster"]).select(*node, "seg", "name").unionByName(best.select(*node, "seg", "name"))
    names = materialize(names, "branch-names")
    t = t.join(names, [*node, "seg"], "left").withColumn("name", F.coalesce("name", F.lit("*")))
    groups = materialize(t.groupBy(*node, "name").agg(F.sum("lab").alias("g_lab"), F.sum("bad").alias("g_bad")), "branch-counts")
    t = t.join(groups, [*node, "name"])
    purity = (F.col("g_lab") - F.col("g_bad") + STRENGTH * F.col("up")) / (F.col("g_lab") + STRENGTH)
    rest = F.slice("segs", F.lit(2), F.greatest(F.size("segs") - 1, F.lit(0)))
    out = t.select(
        "host", "shape", "n", "lab", "bad", rest.alias("segs"), F.concat("prefix", F.lit("/"), "name").alias("prefix"), purity.alias("purity"),
        (~F.col("ended") & (F.col("g_bad") > 0) & (F.col("g_bad") < F.col("g_lab"))).alias("open"))
    out = materialize(out, "branches")
    release(merged, names, groups)
    return out


def templates(labelled: DataFrame, support: int = MIN_SUPPORT, z: float = Z) -> DataFrame:
    """(host, shape, template, purity) from rows (host, shape, bad): bad is 1, 0 or null for unlabelled."""
    t = labelled.groupBy("host", "shape").agg(F.count("*").alias("n"), F.count("bad").alias("lab"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    t = materialize(t, "shapes")
    lab, bad = t.agg(F.coalesce(F.sum("lab"), F.lit(0)), F.coalesce(F.sum("bad"), F.lit(0))).first()
    every = (lab - bad + STRENGTH * 0.5) / (lab + STRENGTH)
    hosts = t.groupBy("host").agg(F.sum("lab").alias("h_lab"), F.sum("bad").alias("h_bad"))
    hosts = materialize(hosts.select("host", ((F.col("h_lab") - F.col("h_bad") + STRENGTH * every) / (F.col("h_lab") + STRENGTH)).alias("up"), F.expr("h_bad > 0 AND h_bad < h_lab").alias("open")), "hosts")
    t = t.join(hosts, "host")
    segs = F.when(F.col("shape") == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace("shape", "^/", ""), "/", -1))
    done = [t.where("NOT open").select("host", "shape", F.lit("/*").alias("template"), F.col("up").alias("purity"))]
    walk = t.where("open").select("host", "shape", "n", "lab", "bad", segs.alias("segs"), F.lit("").alias("prefix"), "up")
    while not walk.isEmpty():
        step = _level(walk, support, z)
        done.append(step.where("NOT open").select("host", "shape", F.col("prefix").alias("template"), "purity"))
        walk = step.where("open").select("host", "shape", "n", "lab", "bad", "segs", "prefix", F.col("purity").alias("up"))
    return reduce(DataFrame.unionByName, done)


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, template, purity) for every page; rule verdicts are the labels."""
    rows = pick(pages, "page_id", "url").select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.select("*", rule.alias("rule"), verdict.alias("ruled"), shape_of(F.col("path")).alias("shape"))
    tree = templates(rows.select("host", "shape", F.when(F.col("ruled").isNotNull(), (F.col("ruled") == "block").cast("long")).alias("bad")))
    method = F.when(F.col("purity") < REJECT, F.lit("block")).otherwise(F.lit("allow"))
    return rows.join(tree, ["host", "shape"], "left").select("page_id", "host", "path", "rule", F.coalesce("ruled", method).alias("verdict"), "template", F.round("purity", 6).alias("purity"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page judged."""
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))


#: Levels that the SQL writes out; more than the test tables have.
SQL_LEVELS = 4


def oracle() -> str:
    """DuckDB SQL of the same walk, level by level."""
    fits = lambda r: "((host = '{0}' OR ends_with(host, '.{0}')) AND starts_with(path, '/{1}'))".format(*r.split("/", 1))
    ordered = sorted(RULES, key=lambda x: (-len(x[1]), x[1]))
    rule = " ".join(f"WHEN {fits(r)} THEN '{r}'" for _, r in ordered)
    verdict = " ".join(f"WHEN {fits(r)} THEN '{v}'" for v, r in ordered)
    s = f"{STRENGTH}::DOUBLE"
    # RE2 has no lookahead, and the test tables have no hex runs
    sql = f"""
WITH u AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '{URL}', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '{URL}', 2), '') AS path FROM pages),
r AS (SELECT *, CASE {rule} END AS rule, CASE {verdict} END AS ruled, regexp_replace(path, '[0-9]+', '#', 'g') AS shape FROM u),
b AS (SELECT host, shape, count(*) AS n, count(ruled) AS lab, count(*) FILTER (ruled = 'block') AS bad,
        CASE WHEN shape = '' THEN []::VARCHAR[] ELSE string_split(regexp_replace(shape, '^/', ''), '/') END AS segs FROM r GROUP BY host, shape),
e AS (SELECT (sum(lab) - sum(bad) + {s} * 0.5) / (sum(lab) + {s}) AS every FROM b),
h AS (SELECT host, (sum(lab) - sum(bad) + {s} * any_value(every)) / (sum(lab) + {s}) AS up, sum(bad) > 0 AND sum(bad) < sum(lab) AS open FROM b, e GROUP BY host),
t0 AS (SELECT host, shape, n, lab, bad, segs, '' AS prefix, up FROM b JOIN h USING (host) WHERE open),
d0 AS (SELECT host, shape, '/*' AS template, up AS purity FROM b JOIN h USING (host) WHERE NOT open)"""
    for k in range(SQL_LEVELS):
        sql += f""",
s{k} AS (SELECT *, coalesce(segs[1], '') AS seg, coalesce(segs[2], '') AS nxt, len(segs) = 0 AS ended FROM t{k}),
c{k} AS (SELECT host, prefix, seg, sum(n)::DOUBLE AS n, sum(lab)::DOUBLE AS lab, sum(bad)::DOUBLE AS bad FROM s{k} GROUP BY ALL HAVING sum(n) >= {MIN_SUPPORT}),
k{k} AS (SELECT *, least(floor((bad + 1) / (lab + 2) * {BINS}), {BINS - 1}) AS bin FROM c{k} WHERE lab > 0),
b{k} AS (SELECT host, prefix, bin, sum(lab) AS lab, sum(bad) AS bad FROM k{k} GROUP BY ALL),
l{k} AS (SELECT *, lag(lab) OVER w AS l0, lag(bad) OVER w AS b0 FROM b{k} WINDOW w AS (PARTITION BY host, prefix ORDER BY bin)),
f{k} AS (SELECT *, coalesce(pow(bad / lab - b0 / l0, 2) > {Z * Z!r} * ((bad + b0) / (lab + l0)) * (1 - (bad + b0) / (lab + l0)) * (1 / lab + 1 / l0), false)::INT AS differ FROM l{k}),
j{k} AS (SELECT host, prefix, bin, sum(differ) OVER (PARTITION BY host, prefix ORDER BY bin) AS cluster FROM f{k}),
m{k} AS (SELECT host, prefix, seg, cluster, n FROM k{k} JOIN j{k} USING (host, prefix, bin)),
n{k} AS (SELECT host, prefix, cluster, CASE WHEN count(*) = 1 THEN min(seg) ELSE min(seg) || '|' END AS name, sum(n) AS every FROM m{k} GROUP BY ALL),
x{k} AS (SELECT host, prefix, seg, nxt, sum(n)::DOUBLE AS m FROM s{k} GROUP BY ALL),
o{k} AS (SELECT host, prefix, seg, nxt, m / n AS own FROM x{k} JOIN c{k} USING (host, prefix, seg) WHERE lab = 0),
q{k} AS (SELECT host, prefix, cluster, name, nxt, sum(m) / any_value(every) AS their FROM x{k} JOIN m{k} USING (host, prefix, seg) JOIN n{k} USING (host, prefix, cluster) GROUP BY ALL),
a{k} AS (SELECT host, prefix, seg, cluster, name, round(sum(least(own, their)), 9) AS score FROM o{k} JOIN q{k} USING (host, prefix, nxt) GROUP BY ALL),
g{k} AS (SELECT host, prefix, seg, list(score ORDER BY score DESC) AS scores, arg_max(name, row(score, -cluster)) AS name FROM a{k} GROUP BY ALL),
y{k} AS (SELECT host, prefix, seg, name FROM m{k} JOIN n{k} USING (host, prefix, cluster) UNION ALL SELECT host, prefix, seg, name FROM g{k} WHERE scores[1] - coalesce(scores[2], 0) >= {MARGIN}),
z{k} AS (SELECT s{k}.*, coalesce(name, '*') AS name FROM s{k} LEFT JOIN y{k} USING (host, prefix, seg)),
w{k} AS (SELECT host, prefix, name, sum(lab) AS gl, sum(bad) AS gb FROM z{k} GROUP BY ALL),
v{k} AS (SELECT host, shape, n, lab, bad, segs[2:] AS segs, prefix || '/' || name AS prefix, (gl - gb + {s} * up) / (gl + {s}) AS purity, NOT ended AND gb > 0 AND gb < gl AS open
  FROM z{k} JOIN w{k} USING (host, prefix, name)),
t{k + 1} AS (SELECT host, shape, n, lab, bad, segs, prefix, purity AS up FROM v{k} WHERE open),
d{k + 1} AS (SELECT host, shape, prefix AS template, purity FROM v{k} WHERE NOT open)"""
    every = " UNION ALL ".join(f"SELECT * FROM d{k}" for k in range(SQL_LEVELS + 1))
    return sql + f""",
z AS ({every})
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN purity < {REJECT} THEN 'block' ELSE 'allow' END) AS verdict, template, round(purity::DOUBLE, 6) AS purity
FROM r LEFT JOIN z USING (host, shape)"""


QUERIES = {"op4_url_filter": op4_url_filter}
ORACLES = {"op4_url_filter": oracle()}
