"""The audit of a source tree: files to functions, tags, call graph, source-to-sink paths, ranking, report."""

from __future__ import annotations

import itertools
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentrel.functions import fixed
from sentrel.functions import rules as R
from sentrel.functions.expressions import blockers_of, severity_rank
from sentrel.operators import chains, evaluate, graph, memory, paths, prioritize, tagging, taint
from sentrel.session import cut_lineage
from sentrel.sources import extract, feeds, files

#: Nodes of a call path at most.
MAX_NODES = 8


@dataclass
class Audit:
    """The relations of an audit; all lazy but the parsed functions and the paths."""

    functions: DataFrame
    calls: DataFrame
    edges: DataFrame
    sources: DataFrame
    sinks: DataFrame
    sanitizers: DataFrame
    entry_points: DataFrame
    imports: DataFrame
    dependencies: DataFrame
    memory: DataFrame
    paths: DataFrame
    selected: DataFrame

    def summary(self) -> DataFrame:
        """One row of counts."""
        out = None
        for name in ("functions", "edges", "sources", "sinks", "sanitizers", "entry_points", "memory", "paths"):
            n = getattr(self, name).agg(F.count("*").alias(name))
            out = n if out is None else out.crossJoin(n)
        return out

    def taint(self, rounds: int = 10) -> DataFrame:
        """(key, tainted, reaches, returns): taint from the variables that sources are assigned to, over all calls."""
        put = self.functions.select("file", "key", F.explode("statements").alias("s")).where("s.target IS NOT NULL").select("file", "key", F.col("s.line").alias("line"), F.col("s.target").alias("var"))
        seeds = put.join(self.sources.select("file", "line").distinct(), ["file", "line"]).select("key", "var")
        return taint.between(self.functions, self.calls, seeds, rounds)

    def chains(self, verdicts: DataFrame, top: int = 50) -> DataFrame:
        """Chains over the paths that verdicts (path_id, confidence) confirm."""
        rank = 4 - severity_rank(F.col("severity"))
        found = self.paths.join(verdicts, "path_id").select(F.col("path_id").alias("id"), chains.role_of(F.col("category")).alias("role"), F.greatest(rank, F.lit(1)).cast("int").alias("severity"), "confidence").where("role IS NOT NULL")
        return chains.chains(found, chains.role_paths(self.paths.sparkSession, sorted(set(fixed.ROLES.values()))), top)

    def write(self, path: str) -> None:
        """Every relation as Parquet in a folder of its own."""
        for f in fields(self):
            getattr(self, f.name).write.mode("overwrite").parquet(f"{path}/{f.name}")

    def report(self) -> str:
        """Sections in order: counts, paths by severity, memory findings by severity and confidence, dependencies."""
        worst = self.selected.orderBy(severity_rank(F.col("severity")), "tier", "source_file", "source_line", "sink")
        severe = evaluate.report_order(self.memory, "file")
        return feeds.markdown("Audit", {"Summary": self.summary(), "Paths": worst, "Memory": evaluate.breakdown(self.memory, "severity").orderBy(severity_rank(F.col("severity"))), "Memory findings": severe, "Dependencies": self.dependencies.orderBy("ecosystem", "name")})


def audit_files(tree: DataFrame, ceiling: int = 0, sinks=R.SINKS, sources=R.SOURCES, sanitizers=R.SANITIZERS, resolve: str = "name") -> Audit:
    """Audit files (path, language, content); calls are resolved by ``name`` or by receiver and ``import``."""
    lines = files.lines_of(tree)
    lang = F.col("language")
    fns = cut_lineage(extract.functions(tree), "functions")
    calls = cut_lineage(extract.call_sites(fns), "calls")
    src, hits, san, entry, imports = _tags(lines, sources, sinks, sanitizers, R.ENTRY_POINTS, R.IMPORTS)
    src = src.select("file", "line", F.col("category").alias("source_type"), F.col("value").alias("variable"))
    snk = cut_lineage(tagging.dedup_sinks(hits, "file"), "audit-sinks")
    san = san.select("file", "line", "category", "protects")
    entry = entry.select("file", "line", F.col("category").alias("type"), F.col("value").alias("method"))
    imports = imports.select("file", "line", F.col("value").alias("module"))
    named = fns.select(F.col("key").alias("dst"), "file", "name", "class_name")
    if resolve == "import":
        edges = graph.resolved_edges(calls, named, graph.import_targets(imports, tree.select("path")))
    else:
        edges = graph.call_edges(calls.select("src", "name"), named)
    edges = cut_lineage(edges, "call-edges")
    found = cut_lineage(_paths(fns, edges, src, snk, san), "audit-paths")
    ranked = found.select("path_id", F.col("path_id").alias("id"), "severity", "category", (F.size("functions") > 0).alias("direct"), "blocked", F.size("functions").alias("steps"), F.concat_ws(":", "sink_file", "sink_line").alias("sink"), "source_file", "source_line", "source_type")
    chosen = prioritize.tiered_budget(ranked, ceiling, ["sink", "category"]).select("path_id", "tier", "severity", "category", "sink", "source_type", "source_file", "source_line", "blocked")
    return Audit(fns, calls, edges, src, snk, san, entry, imports, feeds.dependencies(tree), memory.all_findings(lines.where(lang.isin("c", "cpp", "rust"))), found, chosen)


def _tags(lines: DataFrame, *tables) -> list[DataFrame]:
    """The hits of each rule table. The text is read and matched once for all of them, and only hits are written."""
    every = [r for t in tables for r in t]
    hits = cut_lineage(tagging.tag(lines, every, F.col("language")).drop("content"), "tags")
    ends = list(itertools.accumulate(map(len, tables)))
    return [hits.where(F.col("ord").between(end - len(t), end - 1)) for end, t in zip(ends, tables)]


def _paths(fns: DataFrame, edges: DataFrame, src: DataFrame, snk: DataFrame, san: DataFrame) -> DataFrame:
    """One path per source, sink and category: the least shortest call path, or the file itself outside functions."""
    spark = fns.sparkSession
    spans = fns.select("file", "key", F.col("line").alias("start"), F.col("end_line").alias("end"))
    src = src.withColumn("source_id", F.xxhash64("file", "line", "source_type", "variable"))
    at_source = graph.enclosing_or_next(src.dropDuplicates(["source_id"]), spans, "file", "source_id", "line", "start", "end", 5)
    at_sink = graph.enclosing(snk, spans, "file", "line", "start", "end").select(F.col("file").alias("sink_file"), F.col("line").alias("sink_line"), "category", "severity", F.col("key").alias("node"))
    walks = graph.shortest_paths(edges, at_source.select(F.col("key").alias("node")).distinct(), MAX_NODES)
    starts = at_source.select("source_type", F.col("file").alias("source_file"), F.col("line").alias("source_line"), F.col("key").alias("src"))
    reach = starts.join(walks, "src").select("source_type", "source_file", "source_line", "node", "path")
    inside = paths.compatible_pairs(reach, at_sink, paths.compat_table(spark), on=["node"]).select("source_type", "source_file", "source_line", "sink_file", "sink_line", "category", "severity", F.col("path").alias("functions"))
    # outside functions a source meets the sinks of its own file
    own = spans.withColumnRenamed("file", "_file")
    out_of = lambda t: t.join(own, (F.col("file") == F.col("_file")) & F.col("line").between(F.col("start"), F.col("end")), "left_anti")
    loose_src = out_of(src).select("source_type", "file", F.col("line").alias("source_line"))
    loose_snk = out_of(snk).select("file", F.col("line").alias("sink_line"), "category", "severity")
    loose = paths.compatible_pairs(loose_src, loose_snk, paths.compat_table(spark), on=["file"]).select("source_type", F.col("file").alias("source_file"), "source_line", F.col("file").alias("sink_file"), "sink_line", "category", "severity", F.array().cast("array<string>").alias("functions"))
    combo = ["source_type", "source_file", "source_line", "sink_file", "sink_line", "category"]
    rows = paths.keep_first(inside.unionByName(loose), combo, [F.size("functions"), "functions"]).withColumn("path_id", F.xxhash64(*combo))
    # sanitizers inside the path's functions, or in the file of a path without functions
    shields = graph.enclosing(san, spans, "file", "line", "start", "end").select(F.col("key").alias("where"), F.explode("protects").alias("shield"))
    shields = shields.unionByName(san.select(F.col("file").alias("where"), F.explode("protects").alias("shield"))).distinct()
    where = F.when(F.size("functions") > 0, F.col("functions")).otherwise(F.array("sink_file"))
    need = rows.select("path_id", F.explode(where).alias("where"), blockers_of(F.col("category")).alias("b")).select("path_id", "where", F.explode("b").alias("shield"))
    safe = need.join(shields, ["where", "shield"], "left_semi").select("path_id").distinct().withColumn("blocked", F.lit(True))
    return rows.join(safe, "path_id", "left").withColumn("blocked", F.coalesce("blocked", F.lit(False))).withColumn("exploitable", paths.exploitable(F.col("blocked"), F.col("category"), F.lit(True), F.size("functions")))


def audit(spark: SparkSession, root: str, ceiling: int = 0) -> Audit:
    """Audit a source tree."""
    wanted = [*files.fixed.LANGUAGES, ".txt", ".toml", ".json", ".xml", ".mod", "Gemfile", ".config"]
    return audit_files(files.scan(spark, root, wanted), ceiling)


#: A small tree that shows the steps.
EXAMPLE = [
    ("app/web.py", "python", "import os\nfrom flask import request\n\n@app.route('/run')\ndef run():\n    cmd = request.args.get('c')\n    return launch(cmd)\n\ndef launch(c):\n    os.system(c)\n\ndef safe(c):\n    import shlex\n    os.system(shlex.quote(c))\n\n@app.route('/safe')\ndef entry():\n    safe(request.args['c'])\n"),
    ("app/store.py", "python", "class Store:\n    def find(self, name):\n        q = 'select ' + name\n        self.cur.execute(q)\n\ndef handler():\n    name = input()\n    Store().find(name)\n\nTOKEN = token = 'abcdefgh1234'\n"),
    ("src/copy.c", "c", '#include <string.h>\nint main(int argc, char **argv) {\n  char small[8];\n  strcpy(small, argv[1]);\n  char *p = malloc(n * size);\n  free(p);\n  p[0] = 1;\n  free(p);\n  printf(msg);\n  return 0;\n}\n'),
    ("src/Main.java", "java", 'public class Main {\n  public static void main(String[] args) {\n    String u = request.getParameter("id");\n    query(u);\n  }\n  static void query(String u) {\n    st.executeQuery("select " + u);\n  }\n}\n'),
    ("requirements.txt", None, "Flask==2.0.1\nrequests>=2.5 # http\nplain\n"), ("web/package.json", None, '{"dependencies": {"left-pad": "^1.0"}, "devDependencies": {"jest": "29"}}'),
    ("go.mod", None, "module x\nrequire (\n\tgithub.com/a/b v1.2.3\n)\n"), ("Cargo.toml", None, '[package]\nname = "x"\n[dependencies]\nserde = "1.0"\nrand = { version = "0.8" }\n')]


def _example(spark: SparkSession) -> Audit:
    return audit_files(_tree(spark))


def _tree(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(EXAMPLE, "path string, language string, content string")
