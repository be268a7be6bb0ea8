"""Scans, parsers, manifests, feeds, streams and the whole audit."""

import json

from pyspark.sql import functions as F

from sentrel.plans import audit as A
from sentrel.sources import extract, feeds, files
from sentrel.streaming import events as E


def test_scan_skips_folders_and_large_files(spark, tmp_path):
    for p, body in {"a/x.py": "import os\n", "node_modules/y.js": "z", "b/w.txt": "t", "big.py": "#" * 5000}.items():
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(body)
    got = files.scan(spark, str(tmp_path), max_bytes=1000).collect()
    assert [(r.path.strip("/"), r.language, r.content) for r in got] == [("a/x.py", "python", "import os\n")]


def test_scan_replaces_bad_bytes_and_filters(spark, tmp_path):
    for p, body in {"a/x.py": b"ok = '\xff\xfe caf\xc3\xa9'\n", ".hidden/y.py": b"z", "Tests/t.py": b"t", "m.min.js": b"q", "n.js": b"r"}.items():
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_bytes(body)
    got = {r.path.strip("/"): r.content for r in files.scan(spark, str(tmp_path), skip_tests=True, skip_hidden=True, ignore=[".min.js"]).collect()}
    assert set(got) == {"a/x.py", "n.js"} and "\ufffd" in got["a/x.py"] and "café" in got["a/x.py"]
    (tmp_path / "c.csv").write_text("cve_id,repo_url,commit_hash,lang\nCVE-1,u,abc,c\nCVE-1,u,abc,c\n")
    assert [tuple(r) for r in files.commit_cases(spark, str(tmp_path / "c.csv")).collect()] == [("CVE-1", "u", "abc", "c", "commits")]


def test_functions_of_python_and_braces():
    f = extract.python_functions("class C:\n    @dec\n    def m(self, a, b=1):\n        x = f(a, g(b))\n        return x\n")
    assert [(x["name"], x["class_name"], x["params"], x["end_line"]) for x in f] == [("m", "C", ["a", "b"], 5)]
    assert {c["name"]: c["arguments"] for c in f[0]["calls"]} == {"f": ["a", "g(b)"], "g": ["b"]}
    assert extract.python_functions("def (") == []
    g = extract.brace_functions('func (s *S) Run(a string, b int) error {\n  x := call(a, "}")\n  return nil\n}\n', "go")
    assert [(x["name"], x["line"], x["end_line"]) for x in g] == [("Run", 1, 4)] and g[0]["calls"][0]["arguments"] == ["a", '"}"']
    assert extract.split_arguments("a, f(b, c), 'x,y', [1, 2]") == ["a", "f(b, c)", "'x,y'", "[1, 2]"]
    assert extract.parameter_names("int argc, char **argv") == ["argc", "argv"] and extract.parameter_names("a: string, b?: number") == ["a", "b"]


def test_manifests(spark):
    got = {(r.ecosystem, r.name, r.version) for r in feeds.dependencies(A._tree(spark)).collect()}
    assert got == {("pypi", "flask", "2.0.1"), ("pypi", "requests", "2.5"), ("pypi", "plain", None), ("npm", "left-pad", "^1.0"), ("npm", "jest", "29"), ("go", "github.com/a/b", "v1.2.3"), ("cargo", "serde", "1.0"), ("cargo", "rand", "0.8")}


def test_feeds(spark, tmp_path):
    cve = {"id": "CVE-1", "descriptions": [{"lang": "es", "value": "no"}, {"lang": "en", "value": "yes"}], "metrics": {"cvssMetricV2": [{"cvssData": {"baseScore": 1.0}}], "cvssMetricV31": [{"cvssData": {"baseScore": 9.8, "baseSeverity": "CRITICAL"}}]}, "weaknesses": [{"description": [{"value": "CWE-79"}, {"value": "NVD-other"}]}], "configurations": [{"nodes": [{"cpeMatch": [{"criteria": "cpe:2.3:a:vendor:product:1"}]}]}]}
    (tmp_path / "p.json").write_text(json.dumps({"vulnerabilities": [{"cve": cve}, {"cve": {"id": "CVE-2"}}]}))
    got = {r.id: r for r in feeds.cve_pages(spark, str(tmp_path / "p.json")).collect()}
    assert (got["CVE-1"].description, got["CVE-1"].cvss, got["CVE-1"].cwe_ids, got["CVE-1"].package) == ("yes", 9.8, ["CWE-79"], "product")
    assert (got["CVE-2"].description, got["CVE-2"].cvss, got["CVE-2"].cwe_ids) == ("", None, [])
    (tmp_path / "e.csv").write_text("#model\ncve,epss,percentile\nCVE-1,0.5,0.9\nCVE-2,bad,0.1\n")
    assert [tuple(r) for r in feeds.epss_scores(spark, str(tmp_path / "e.csv")).collect()] == [("CVE-1", 0.5, 0.9)]
    (tmp_path / "k.json").write_text(json.dumps({"vulnerabilities": [{"cveID": "CVE-1"}, {"cveID": "CVE-1"}]}))
    assert feeds.known_exploited(spark, str(tmp_path / "k.json")).count() == 1
    (tmp_path / "done.jsonl").write_text('{"id": "a"}\nbroken\n')
    assert [r.id for r in feeds.resumed(spark, spark.createDataFrame([("a",), ("b",)], "id string"), str(tmp_path / "done.jsonl"), "id").collect()] == ["b"]


def test_audit_finds_flow_and_sanitizer(spark, tmp_path):
    a = A._example(spark)
    got = {(r.source_file, r.source_line, r.sink_line, r.category): r for r in a.paths.collect()}
    flow = got["app/web.py", 6, 10, "command_execution"]
    assert [f.split("::")[1].split("@")[0] for f in flow.functions] == ["run", "launch"] and not flow.blocked
    assert got["app/web.py", 18, 14, "command_execution"].blocked
    report = a.report()
    assert [x[3:] for x in report.split("\n") if x.startswith("## ")] == ["Summary", "Paths", "Memory", "Memory findings", "Dependencies"]
    verdicts = a.paths.select("path_id").withColumn("confidence", F.lit(0.9))
    assert a.chains(verdicts).columns == ["name", "ids", "size", "severity", "confidence", "impact"]
    a.write(f"{tmp_path}/audit")
    assert spark.read.parquet(f"{tmp_path}/audit/paths").count() == a.paths.count()
    assert a.summary().first().functions == 9


def test_streams(spark, tmp_path):
    import datetime as dt

    at = dt.datetime(2024, 1, 1, 5)
    rows = [(i, at + dt.timedelta(minutes=20 * i), i % 2, "a", 1.0) for i in range(6)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/d/events.parquet")
    assert sorted((r.hour.hour, r.n) for r in E.stream_windows(spark, f"{tmp_path}/d").collect()) == [(5, 3), (6, 3)]
    assert [(r.n, r.n_distinct) for r in E.stream_resume(spark, f"{tmp_path}/d").collect()] == [(6, 6)]


def test_frameworks_cases_and_answers(spark):
    from pyspark.sql import functions as F

    from sentrel.functions.expressions import chunk_of, hypotheses, json_body

    t = A._tree(spark)
    assert {(r.kind, r.name) for r in files.frameworks(t).collect()} >= {("framework", "Flask"), ("build", "npm"), ("build", "cargo"), ("build", "go")}
    assert files.evaluation_cases(t, r"^src/").where("has_vulnerability").count() == 2
    df = spark.createDataFrame([('<think>{"a":0}</think> ok ```json\n{"a": {"b": 1}}\n``` bye', 501, 47.2)], "t string, n int, r double")
    assert tuple(df.select(json_body(F.col("t")), chunk_of(F.col("n")), hypotheses(F.col("r"))).first()) == ('{"a": {"b": 1}}', 1, 4)
    assert files.architecture(t.where("language IS NOT NULL")).first().architecture == "library"


def test_sessions_scanner_reports_and_comments(spark, tmp_path):
    import datetime as dt

    from sentrel.operators.tagging import strip_comments

    at = dt.datetime(2024, 1, 1, 5)
    ev = spark.createDataFrame([(u, at + dt.timedelta(minutes=m)) for u, m in ((1, 0), (1, 20), (1, 90), (2, 5))], "user_id long, ts timestamp")
    assert sorted((r.user_id, r.n) for r in E.sessions(ev).collect()) == [(1, 1), (1, 2), (2, 1)]
    one = {"check_id": "r1", "path": "a.py", "start": {"line": 3, "col": 1}, "end": {"line": 4, "col": 2}, "extra": {"message": "m", "severity": "error", "metadata": "{}"}}
    (tmp_path / "scan.json").write_text(json.dumps({"results": [one]}))
    assert [(r.rule_id, r.file, r.line, r.end_line, r.severity) for r in feeds.scanner_findings(spark, str(tmp_path / "scan.json")).collect()] == [("r1", "a.py", 3, 4, "ERROR")]
    code = spark.createDataFrame([("x = 1 # one\ny = 2", "a(); // b\n/* c\nd */ e();")], "p string, c string")
    assert tuple(code.select(strip_comments(F.col("p"), "python"), strip_comments(F.col("c"), "c")).first()) == ("x = 1 \ny = 2", "a(); \n e();")
    rows = [(i, at, 1, "a", 1.0) for i in (1, 2, 2, 3)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/s/events.parquet")
    E.drain(E.distinct_events(E.event_stream(spark, f"{tmp_path}/s/events.parquet"), ["event_id"]), f"{tmp_path}/out", f"{tmp_path}/check")
    assert sorted(r.event_id for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [1, 2, 3]


def spans(source, language):
    return [(f["class_name"], f["name"], f["line"], f["end_line"], f["params"]) for f in extract.brace_functions(source, language)]


def test_blocks_of_languages():
    assert spans("class A\n  def self.m(x, y = 1)\n    items.each do |i|\n      go(i)\n    end\n  end\nend\ndef top\n  puts 1\nend\n", "ruby") == [("A", "m", 2, 6, ["x", "y"]), ("", "top", 8, 10, [])]
    java = "class A {\n  A(int x) {\n    f(x);\n  }\n  static void m(\n      @P(\"id\") String a,\n      Map<String, Integer> b) throws E {\n    g(a, \"h(b)\"); // k(a)\n  }\n}\nvoid out(int q) {\n}\n"
    assert spans(java, "java") == [("A", "A", 2, 4, ["x"]), ("A", "m", 5, 9, ["a", "b"]), ("", "out", 11, 12, ["q"])]
    f = extract.brace_functions(java, "java")
    assert [(x["is_constructor"], x["is_static"]) for x in f] == [(True, False), (False, True), (False, False)]
    assert [(c["name"], c["arguments"]) for c in f[1]["calls"]] == [("g", ["a", '"h(b)"'])]
    # bodies on the line of the head, expression bodies, the fallbacks of 20 and 200 lines, signatures
    assert [c["name"] for c in extract.brace_functions("int f(int x) { return g(x); }\n", "c")[0]["calls"]] == ["g"]
    assert spans("fun a(x: Int) = g(x)\nfun b(y: String): Int {\n  return h(y)\n}\n", "kotlin") == [("", "a", 1, 1, ["x"]), ("", "b", 2, 4, ["y"])]
    assert spans("def a(x: Int) =\n" + "  x\n" * 300, "scala") == [("", "a", 1, 21, ["x"])] and spans("def a(x: Int) =\n  x", "scala") == [("", "a", 1, 2, ["x"])]
    assert spans("function f($a)\n" + "x\n" * 300, "php") == [("", "f", 1, 201, ["a"])]
    assert spans("trait T {\n  fn z(&self);\n}\nimpl<'a> Foo for Bar<'a> {\n  fn x(s: &'a str, c: char) -> bool {\n    c == '{' && y(s)\n  }\n}\n", "rust") == [("Bar", "x", 5, 7, ["s", "c"])]
    assert spans("const f = (a) => g(a)\nconst h = async (a) => {\n  await k(a)\n}\n", "javascript") == [("", "f", 1, 1, ["a"]), ("", "h", 2, 4, ["a"])]
    assert spans('function foo {\n  rm "$1" # }\n}\n', "shell") == [("", "foo", 1, 3, [])] and spans("filter Get-It { x }\n", "powershell") == [("", "Get-It", 1, 1, [])]
    assert spans("", "c") == [] and spans("}}}{{{(((", "java") == []


def test_parsers_survive_hard_files(spark):
    deep = "def f():\n  return " + "+".join(["a"] * 50_000)
    t = spark.createDataFrame([("a.py", "python", deep), ("b.py", "python", "def g(): pass"), ("c.c", "c", "x" * 1_000_000 + "\nint f(int a) {\n g(a);\n}\n"), ("d", None, None)], "path string, language string, content string")
    assert sorted(r.name for r in extract.functions(t).collect()) == ["f", "g"]


def test_answers_cut_off_or_nested(spark):
    from sentrel.functions.expressions import json_body

    want = {'x {"a": "}"} {"b": 1}': '{"a": "}"}', '[1, [2]] z': "[1, [2]]", 'cut {"a": [1': None, "none": None, "": None, '{"q": "\\"}"}!': '{"q": "\\"}"}', "{not json}": None}
    df = spark.createDataFrame([(t,) for t in want], "t string")
    assert {r.t: r.b for r in df.select("t", json_body(F.col("t")).alias("b")).collect()} == want


def test_parts_of_a_generated_tree_are_dealt_to_tasks(spark, tmp_path):
    from pyspark.sql import functions as F

    from sentrel.plans import trees

    spark.range(3 * trees.DEALT).select(F.col("id").alias("p_partkey"), F.lit(1).alias("p_size")).coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    made = trees.tree(spark, str(tmp_path)).where("language = 'python'").groupBy(F.spark_partition_id()).count().collect()
    assert len(made) > 2 and max(r["count"] for r in made) < 2 * trees.DEALT


def test_short_ways_of_the_parser_equal_the_library():
    import ast

    from sentrel.sources import extract

    source = "def f(a):\n  x = u'q'.join(a)\n  y = f'{a}'.upper()\n  z = 'a\"\\'b'.x(1)(b, *c, k=1).d\n  if a:\n    def g(): return (yield a).b, (lambda: a)(a), (a)(), [h(a, 'x\\n'), 1 .real, b'c']\n  return ('s').join(m(n.o, 'p')), -a.b(), (a + b).c(d)\n"
    for n in ast.walk(ast.parse(source)):
        if isinstance(n, ast.expr) and not isinstance(n, ast.Starred):
            assert extract._source(n) == ast.unparse(n)
    kinds = lambda nodes: [type(n) for n in nodes if not isinstance(n, ast.expr_context)]
    assert kinds(extract._walk(ast.parse(source))) == kinds(ast.walk(ast.parse(source)))
    assert [f["name"] for f in extract.python_functions(source)] == ["f", "g"]
