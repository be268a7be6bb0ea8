"""Audits of source trees that are generated from the part table, one module per part.

Module k has a function run<k>, which may read a request and calls step<7k + 3>, and a function step<k>, which runs a command,
with or without quoting it, or calls step<k + size>. Some parts also have a C file or a manifest. So what an audit has to
find follows from the table, and the SQL beside each query says it without parsing anything.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sentrel.functions import rules
from sentrel.operators import graph, memory, tagging
from sentrel.plans import audit as A
from sentrel.session import table
from sentrel.sources import extract, feeds, files

C_FILE = """#include <string.h>
int copy{k}(char *input, int n) {{
  char small[8];
  strcpy(small, input);
  char *p = malloc(n * size);
  free(p);
  p[0] = 1;
  printf(msg);
  return 0;
}}
"""
MODULE = "import os, shlex\nfrom flask import request\n\ndef run{k}():\n    cmd = {read}\n    return step{n}(cmd)\n\ndef step{k}(x):\n    y = x\n    {end}\n"
NEEDS = "lib{s}=={v}.0  # pinned\nplain{r}\n"

#: A file of each further language; names carry the part's key.
OTHERS = {
    "go": ("go", 'package p\n\nimport "os/exec"\n\nfunc (s *Store{k}) Run{k}(a, b string) error {\n\treturn exec.Command(a, b).Run()\n}\n'),
    "java": ("java", 'import java.util.List;\n\npublic class Shop{k} {\n    public Shop{k}(int size) {\n        init(size);\n    }\n\n    @Override\n    public static List<String> find{k}(\n            @Param("id") String id,\n            int most) throws Error {\n        return st.executeQuery("select " + id); // find(id)\n    }\n}\n'),
    "ruby": ("rb", "require 'json'\n\nclass Job{k}\n  def run{k}(name, most = 1)\n    items.each do |i|\n      system(name)\n    end\n  end\nend\n"),
    "scala": ("scala", "import sys.process\n\nobject Main{k} {\n  def load{k}(x: Int): Int = parse(x)\n}\n"),
    "rust": ("rs", "use std::fs;\n\nstruct Kit{k};\nimpl<'a> Kit{k} {\n    fn read{k}(s: &'a str, c: char) -> bool {\n        c == '{' && fs::read(s)\n    }\n}\n"),
    "shell": ("sh", '#!/bin/sh\nsource lib.sh\nfunction clean{k} {\n  rm -rf "$1" # }\n}\n')}


def _text(template: str, **parts: Column) -> Column:
    """A template with columns in place of its names."""
    pieces, out = template.replace("{{", "\x01").replace("}}", "\x02").split("{"), []
    for n, p in enumerate(pieces):
        name, _, rest = p.partition("}") if n else ("", "", p)
        out += [parts[name].cast("string")] if name else []
        out.append(F.lit(rest.replace("\x01", "{").replace("\x02", "}")))
    return F.concat(*out)


#: Parts whose files are made, parsed and matched by a task. A row of the table is a few bytes, so its scan has few tasks.
DEALT = 5000


def tree(spark: SparkSession, d: str) -> DataFrame:
    """(path, language, content)."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("s"))
    dealt = p.repartition(p.count() // DEALT + 1, "k")
    p = dealt.crossJoin(F.broadcast(p.agg(F.count("*").alias("n")))).withColumns({"first": (7 * F.col("k") + 3) % F.col("n"), "next": (F.col("k") + F.col("s")) % F.col("n")})
    k, s = F.col("k"), F.col("s")
    read = F.when(s % 3 == 0, "request.args.get('c')").otherwise("'fixed'")
    end = F.when(s % 4 == 0, "os.system(y)").when(s % 4 == 1, "os.system(shlex.quote(y))").otherwise(_text("return step{n}(y)", n=F.col("next")))
    module = _text(MODULE, k=k, read=read, n=F.col("first"), end=end)
    out = p.select(_text("src/m{k}.py", k=k).alias("path"), F.lit("python").alias("language"), module.alias("content"))
    out = out.unionByName(p.where(s % 5 == 0).select(_text("src/c{k}.c", k=k).alias("path"), F.lit("c").alias("language"), _text(C_FILE, k=k).alias("content")))
    needs = _text(NEEDS, s=s, v=k % 7, r=k % 5)
    return out.unionByName(p.where(s % 10 == 0).select(_text("deps/m{k}/requirements.txt", k=k).alias("path"), F.lit(None).cast("string").alias("language"), needs.alias("content")))


def other_tree(spark: SparkSession, d: str) -> DataFrame:
    """(path, language, content): a file of one of OTHERS per part."""
    k, n = F.col("p_partkey"), len(OTHERS)
    filled = lambda text: F.replace(F.lit(text), F.lit("{k}"), k.cast("string"))
    rows = [F.when(k % n == i, F.struct(filled(f"src/{name}{{k}}.{end}").alias("path"), F.lit(name).alias("language"), filled(body).alias("content"))) for i, (name, (end, body)) in enumerate(OTHERS.items())]
    return table(spark, d, "part").select(F.coalesce(*rows).alias("f")).select("f.*")


def _audit(spark, d, **how) -> A.Audit:
    return A.audit_files(tree(spark, d), **how)


def audit_paths(spark, d):
    return _audit(spark, d).paths.drop("path_id").withColumn("functions", F.array_join("functions", ">"))


def audit_imports(spark, d):
    """Paths where calls only reach functions of the same file or an imported one."""
    return _audit(spark, d, resolve="import").paths.select("source_file", "sink_file", "blocked")


def audit_summary(spark, d):
    return _audit(spark, d).summary()


def audit_selected(spark, d):
    return _audit(spark, d).selected.drop("path_id")


def taint_flows(spark, d):
    """Functions that taint reaches, with their calls on tainted values."""
    t = _audit(spark, d).taint().where(F.size("tainted") > 0)
    return t.select("key", F.array_join(F.array_sort("tainted"), ",").alias("tainted"), F.size("reaches").alias("n_reaches"), F.size(F.filter("reaches", lambda r: r["sanitized"])).alias("n_sanitized"), "returns")


def memory_findings(spark, d):
    return memory.all_findings(files.lines_of(tree(spark, d).where("language = 'c'")))


def dependency_list(spark, d):
    return feeds.dependencies(tree(spark, d))


def _functions(spark, d, language: str) -> DataFrame:
    return extract.functions(tree(spark, d).where(F.col("language") == language))


def function_list(spark, d):
    return extract.functions(tree(spark, d)).select("key", "name", "class_name", "line", "end_line", F.size("params").alias("n_params"), F.size("calls").alias("n_calls"))


def other_functions(spark, d):
    """Functions of the languages that are read by blocks."""
    fns = extract.functions(other_tree(spark, d))
    return fns.select("key", "name", "class_name", "line", "end_line", "is_constructor", "is_static", F.array_join("params", ",").alias("params"), F.array_join(F.transform("calls", lambda c: c["name"]), ",").alias("calls"))


def other_sinks(spark, d):
    hits = tagging.tag(files.lines_of(other_tree(spark, d)), rules.SINKS, F.col("language"))
    return tagging.dedup_sinks(hits, "file").groupBy("line", "category", "severity").agg(F.count("*").alias("n"))


def other_imports(spark, d):
    hits = tagging.tag(files.lines_of(other_tree(spark, d)), rules.IMPORTS, F.col("language"))
    return hits.groupBy("language", "line", "value").agg(F.count("*").alias("n"))


def call_list(spark, d):
    """Call sites with their arguments."""
    calls = extract.call_sites(_functions(spark, d, "python"))
    return calls.select("src", "line", "name", "receiver", F.array_join("arguments", "|").alias("arguments"))


def variable_list(spark, d):
    v = extract.variables(_functions(spark, d, "python"))
    return v.groupBy("name", "is_param").agg(F.count("*").alias("n"), F.min("line").alias("first"), F.countDistinct("assigned_from").alias("n_forms"))


def import_list(spark, d):
    hits = tagging.tag(files.lines_of(tree(spark, d)), rules.IMPORTS, F.col("language")).select("file", "line", F.trim("value").alias("module"))
    return hits.groupBy("line", "module").agg(F.count("*").alias("n"))


def tree_layout(spark, d):
    t = tree(spark, d)
    return files.architecture(t.where("language IS NOT NULL")).select("architecture", F.array_join("languages", ",").alias("languages"), "primary")


def tree_inventory(spark, d):
    return files.inventory(tree(spark, d).withColumn("size", F.octet_length("content")))


def callers_in_spans(spark, d):
    """Call lines back to their innermost function."""
    fns = _functions(spark, d, "python")
    calls = extract.call_sites(fns).select("file", "line", "name")
    spans = fns.select("file", "key", F.col("line").alias("start"), F.col("end_line").alias("end"))
    joined = graph.enclosing(calls, spans, "file", "line", "start", "end")
    return graph.innermost(joined, ["file", "line", "name"], [F.desc("start")]).select("file", "line", "name", "key")


QUERIES = {f.__name__: f for f in (audit_paths, audit_imports, audit_summary, audit_selected, taint_flows, memory_findings, dependency_list, function_list, other_functions, other_sinks, other_imports, call_list, variable_list, import_list, tree_layout, tree_inventory, callers_in_spans)}

_P = "n AS (SELECT count(*) AS n FROM part), p AS (SELECT p_partkey AS k, p_size AS s, (7 * p_partkey + 3) % n AS n1, (p_partkey + p_size) % n AS n2 FROM part, n)"
_RUN, _STEP = "'src/m' || {0} || '.py::run' || {0} || '@4'", "'src/m' || {0} || '.py::step' || {0} || '@8'"
_W = f"""{_P}, w AS (SELECT k AS src, n1 AS node, 2 AS depth, [{_RUN.format('k')}, {_STEP.format('n1')}] AS path FROM p WHERE s % 3 = 0
  UNION ALL SELECT src, p.n2, depth + 1, list_append(path, {_STEP.format('p.n2')}) FROM w JOIN p ON p.k = w.node WHERE s % 4 >= 2 AND depth < {A.MAX_NODES}),
f AS (SELECT 'HTTP_REQUEST' AS source_type, 'src/m' || src || '.py' AS source_file, 5 AS source_line, 'src/m' || node || '.py' AS sink_file, 10 AS sink_line, 'command_execution' AS category, 'CRITICAL' AS severity,
  array_to_string(path, '>') AS functions, s % 4 = 1 AS blocked, s % 4 = 0 AS exploitable FROM w JOIN p ON p.k = w.node WHERE s % 4 < 2)"""
_CALLS = """c AS (SELECT 'src/m' || k || '.py' AS file, '::run' || k || '@4' AS f, 5 AS line, 'get' AS name, NULL AS receiver, chr(39) || 'c' || chr(39) AS arguments FROM p WHERE s % 3 = 0
  UNION ALL SELECT 'src/m' || k || '.py', '::run' || k || '@4', 6, 'step' || n1, NULL, 'cmd' FROM p
  UNION ALL SELECT 'src/m' || k || '.py', '::step' || k || '@8', 10, 'system', 'os', CASE WHEN s % 4 = 0 THEN 'y' ELSE 'shlex.quote(y)' END FROM p WHERE s % 4 < 2
  UNION ALL SELECT 'src/m' || k || '.py', '::step' || k || '@8', 10, 'quote', 'shlex', 'y' FROM p WHERE s % 4 = 1
  UNION ALL SELECT 'src/m' || k || '.py', '::step' || k || '@8', 10, 'step' || n2, NULL, 'y' FROM p WHERE s % 4 >= 2)"""
_MEMORY = "(5, 'allocation_size', 'HIGH', 0.7, 'CWE-190', 'allocation'), (4, 'unbounded_write', 'CRITICAL', 0.95, 'CWE-120', 'buffer'), (7, 'use_after_free', 'CRITICAL', 0.8, 'CWE-416', 'lifetime'), (2, 'integer_overflow', 'HIGH', 0.7, 'CWE-190', 'int_overflow'), (5, 'integer_overflow', 'HIGH', 0.7, 'CWE-190', 'int_overflow'), (8, 'format_string', 'CRITICAL', 0.85, 'CWE-134', 'format')"
_SIZE = {"python": len(MODULE.format(k="", read="", n="", end="")), "c": len(C_FILE.format(k="")), "needs": len(NEEDS.format(s="", v="", r=""))}
_OTHERS = """(0, 'go', 'go', 'Store', 'Run', 5, 7, false, false, 'a,b', 'Command,Run'), (1, 'java', 'java', 'Shop', 'Shop', 4, 6, true, false, 'size', 'init'), (1, 'java', 'java', 'Shop', 'find', 9, 13, false, true, 'id,most', 'executeQuery'),
  (2, 'ruby', 'rb', 'Job', 'run', 4, 8, false, false, 'name,most', 'system'), (3, 'scala', 'scala', 'Main', 'load', 4, 4, false, false, 'x', 'parse'), (4, 'rust', 'rs', 'Kit', 'read', 5, 7, false, false, 's,c', 'read'), (5, 'shell', 'sh', '', 'clean', 3, 5, false, false, '', '')"""
_SINKS = "(0, 6, 'command_execution', 'CRITICAL'), (1, 12, 'sql_injection', 'CRITICAL'), (2, 6, 'command_execution', 'CRITICAL'), (3, 1, 'command_execution', 'CRITICAL'), (4, 6, 'path_traversal', 'HIGH'), (5, 4, 'path_traversal', 'HIGH')"
_NEEDED = "(1, 'java', 1, 'java.util.List'), (0, 'go', 3, 'os/exec'), (2, 'ruby', 1, 'json'), (3, 'scala', 1, 'sys.process'), (4, 'rust', 1, 'std::fs'), (5, 'shell', 2, 'lib.sh')"
ORACLES = {
    "audit_paths": f"WITH RECURSIVE {_W} SELECT * FROM f",
    # no module imports another, so a call only reaches its own file
    "audit_imports": f"WITH {_P} SELECT 'src/m' || k || '.py' AS source_file, 'src/m' || k || '.py' AS sink_file, s % 4 = 1 AS blocked FROM p WHERE n1 = k AND s % 3 = 0 AND s % 4 < 2",
    "audit_summary": f"""WITH RECURSIVE {_W} SELECT 2 * count(*) + count(*) FILTER (s % 5 = 0) AS functions, count(*) + count(*) FILTER (s % 4 >= 2) AS edges, count(*) FILTER (s % 3 = 0) AS sources,
      count(*) FILTER (s % 4 < 2) + 2 * count(*) FILTER (s % 5 = 0) AS sinks, count(*) FILTER (s % 4 = 1) AS sanitizers, 0::BIGINT AS entry_points, 6 * count(*) FILTER (s % 5 = 0) AS memory, (SELECT count(*) FROM f) AS paths FROM p""",
    "audit_selected": f"WITH RECURSIVE {_W} SELECT 0 AS tier, severity, category, sink_file || ':' || sink_line AS sink, source_type, source_file, source_line, blocked FROM f",
    "taint_flows": f"""WITH RECURSIVE {_P}, w AS (SELECT n1 AS node, 1 AS depth FROM p WHERE s % 3 = 0 UNION SELECT p.n2, depth + 1 FROM w JOIN p ON p.k = w.node WHERE s % 4 >= 2 AND depth < 10)
      SELECT {_RUN.format('k')} AS key, 'cmd' AS tainted, 1 AS n_reaches, 0 AS n_sanitized, true AS returns FROM p WHERE s % 3 = 0
      UNION ALL SELECT {_STEP.format('k')}, 'x,y', 1, (s % 4 = 1)::INT, s % 4 >= 2 FROM p WHERE k IN (SELECT node FROM w)""",
    "memory_findings": f"SELECT 'src/c' || p_partkey || '.c' AS file, line, vulnerability_class, severity, confidence::DOUBLE AS confidence, cwe_id, source_module FROM part, (VALUES {_MEMORY}) v(line, vulnerability_class, severity, confidence, cwe_id, source_module) WHERE p_size % 5 = 0",
    "dependency_list": """WITH d AS (SELECT 'lib' || p_size AS name, p_partkey % 7 || '.0' AS version, 'deps/m' || p_partkey || '/requirements.txt' AS file FROM part WHERE p_size % 10 = 0
      UNION ALL SELECT 'plain' || p_partkey % 5, NULL, 'deps/m' || p_partkey || '/requirements.txt' FROM part WHERE p_size % 10 = 0) SELECT 'pypi' AS ecosystem, name, version, min(file) AS file FROM d GROUP BY ALL""",
    "function_list": f"""WITH {_P} SELECT {_RUN.format('k')} AS key, 'run' || k AS name, '' AS class_name, 4 AS line, 6 AS end_line, 0 AS n_params, 1 + (s % 3 = 0)::INT AS n_calls FROM p
      UNION ALL SELECT {_STEP.format('k')}, 'step' || k, '', 8, 10, 1, 1 + (s % 4 = 1)::INT FROM p UNION ALL SELECT 'src/c' || k || '.c::copy' || k || '@2', 'copy' || k, '', 2, 10, 2, 4 FROM p WHERE s % 5 = 0""",
    "other_functions": f"""SELECT 'src/' || language || p_partkey || '.' || ext || '::' || CASE WHEN class_name = '' THEN '' ELSE class_name || p_partkey || '.' END || name || p_partkey || '@' || line AS key, name || p_partkey AS name,
      CASE WHEN class_name = '' THEN '' ELSE class_name || p_partkey END AS class_name, line, end_line, is_constructor, is_static, params, calls FROM part JOIN (VALUES {_OTHERS}) v(i, language, ext, class_name, name, line, end_line, is_constructor, is_static, params, calls) ON i = p_partkey % {len(OTHERS)}""",
    "other_sinks": f"SELECT line, category, severity, count(*) AS n FROM part JOIN (VALUES {_SINKS}) v(i, line, category, severity) ON i = p_partkey % {len(OTHERS)} GROUP BY ALL",
    "other_imports": f"SELECT language, line, value, count(*) AS n FROM part JOIN (VALUES {_NEEDED}) v(i, language, line, value) ON i = p_partkey % {len(OTHERS)} GROUP BY ALL",
    "call_list": f"WITH {_P}, {_CALLS} SELECT file || f AS src, line, name, receiver, arguments FROM c",
    "variable_list": f"""WITH {_P} SELECT 'cmd' AS name, false AS is_param, count(*) AS n, 5 AS first, count(DISTINCT s % 3 = 0) AS n_forms FROM p UNION ALL SELECT 'x', true, count(*), 8, 0 FROM p UNION ALL SELECT 'y', false, count(*), 9, 1 FROM p""",
    "import_list": "SELECT 1 AS line, 'import os' AS module, count(*) AS n FROM part UNION ALL SELECT 2, 'from flask import', count(*) FROM part UNION ALL SELECT 1, 'string.h', count(*) FROM part WHERE p_size % 5 = 0",
    "tree_layout": "SELECT 'library' AS architecture, 'c,python' AS languages, 'python' AS primary",
    "tree_inventory": f"""WITH {_P}, m AS (SELECT {_SIZE['python']} + 2 * len(k::VARCHAR) + len(n1::VARCHAR) + CASE WHEN s % 3 = 0 THEN 21 ELSE 7 END + CASE s % 4 WHEN 0 THEN 12 WHEN 1 THEN 25 ELSE 14 + len(n2::VARCHAR) END AS b FROM p)
      SELECT 'python' AS language, count(*) AS n_files, sum(b)::BIGINT AS bytes FROM m UNION ALL SELECT 'c', count(*), sum({_SIZE['c']} + len(k::VARCHAR))::BIGINT FROM p WHERE s % 5 = 0
      UNION ALL SELECT NULL, count(*), sum({_SIZE['needs']} + len(s::VARCHAR) + 2)::BIGINT FROM p WHERE s % 10 = 0""",
    "callers_in_spans": f"WITH {_P}, {_CALLS} SELECT file, line, name, file || f AS key FROM c",
}
