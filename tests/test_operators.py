"""Operators on small fixtures, against models in plain Python."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from sentrel.functions import fixed
from sentrel.functions import rules as R
from sentrel.functions.expressions import blockers_of, language_of, severity_of
from sentrel.operators import chains, evaluate, graph, knowledge, memory, paths, prioritize, tagging, taint


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


def test_tagging_counts_every_match_and_merges_sinks(spark):
    t = spark.createDataFrame([("a.py", "python", "x = eval(eval(y))\nz = 1\npickle.loads(a); marshal.loads(b)\r"), ("b.c", "c", "strcpy(a, b); strcpy(c, d)")], "file string, language string, text string")
    lines = tagging.lines(t, "file", keep=["language"])
    hits = tagging.tag(lines, R.SINKS, F.col("language"))
    sinks = tagging.dedup_sinks(hits, "file")
    assert rows(hits.where("category = 'code_execution'").groupBy("file").count(), "count") == [(2,)]
    assert ("b.c", 1, "buffer_overflow", 2) in rows(sinks, "file", "line", "category", "n_matches")
    assert ("a.py", 3, "deserialization", "CRITICAL") in rows(sinks, "file", "line", "category", "severity")
    assert rows(tagging.tag(lines.where("language = 'go'"), R.SINKS, F.col("language")), "line") == []


def test_tag_with_group_and_whole_text(spark):
    t = spark.createDataFrame([("m.java", "java", 'String a = q.getParameter("id");\nfoo(\n  bar)')], "file string, language string, text string")
    assert rows(tagging.tag(tagging.lines(t, "file", keep=["language"]), R.SOURCES, F.col("language")), "category", "value") == [("HTTP_PARAM", "id")]
    assert rows(tagging.tag_whole(t, [R.Rule("*", r"foo\(\s*bar\)", "call")]), "line", "category") == [(2, "call")]
    again = spark.createDataFrame([("a", "x(\n1)\n\nx(\n1) x(2)\n"), ("b", "none")], "file string, text string")
    assert rows(tagging.tag_whole(again, [R.Rule("*", r"x\(\s*\d\)", "call")]), "file", "line", "value") == [("a", 1, "x(\n1)"), ("a", 4, "x(\n1)"), ("a", 5, "x(2)")]


def test_rules_of_all_languages(spark):
    code = {
        "python": ("x = request.args['a']", "HTTP_REQUEST"), "javascript": ("const a = req.query.id", "HTTP_REQUEST"), "java": ('q.getParameter("a b")', "HTTP_PARAM"), "c": ("puts(argv[1]);", "CLI_ARG"),
        "go": ("os.Getenv(k)", "ENV_VAR"), "rust": ("std::env::args()", "CLI_ARG"), "csharp": ("var a = Request.Query[k];", "HTTP_REQUEST"), "php": ("$a = $_GET['a'];", "HTTP_REQUEST"), "ruby": ("x = params[key]", "HTTP_PARAM"),
        "powershell": ("echo $env:PATH", "PS_ENV_VAR"), "shell": ('rm "$1"', "CLI_ARG"), "kotlin": ("call.receive()", "HTTP_REQUEST"), "scala": ("request.body", "HTTP_REQUEST"), "swift": ("CommandLine.arguments", "CLI_ARG")}
    df = spark.createDataFrame([(lang, 1, line) for lang, (line, _) in code.items()] + [(lang, 2, "plain words") for lang in code], "language string, line int, content string")
    got = {(r.language, r.category) for r in tagging.tag(df, R.SOURCES, F.col("language")).collect()}
    assert got >= {(lang, category) for lang, (_, category) in code.items()}
    for rules in (R.SINKS, R.SANITIZERS, R.ENTRY_POINTS, R.IMPORTS):
        assert tagging.tag(df.where("line = 2"), rules, F.col("language")).count() == 0
    entry = spark.createDataFrame([("ruby", "get '/x' do"), ("php", "Route::post('/x')"), ("kotlin", "fun main() {"), ("scala", "object A extends App"), ("swift", "@main"), ("shell", "#!/bin/sh")], "language string, content string")
    assert sorted(r.language for r in tagging.tag(entry, R.ENTRY_POINTS, F.col("language")).collect()) == ["kotlin", "php", "ruby", "scala", "shell", "swift"]


def test_sinks_of_all_languages(spark):
    code = {
        "python": ("x = dill.loads(b)", "deserialization"), "javascript": ("el.outerHTML = x", "xss"), "typescript": ("res.redirect(u)", "open_redirect"), "java": ("new ObjectInputStream(in)", "deserialization"), "kotlin": ("db.rawQuery(q)", "sql_injection"),
        "scala": ('sql"select #$x"', "sql_injection"), "c": ("vsprintf(a, b)", "buffer_overflow"), "cpp": ("reinterpret_cast<T>(x)", "type_confusion"), "go": ("os.ReadFile(p)", "path_traversal"), "rust": ("let x = fs::read(p);", "path_traversal"),
        "csharp": ("db.FromSqlRaw(q)", "sql_injection"), "php": ("echo $_GET['a'];", "xss"), "ruby": ("User.find_by_sql(q)", "sql_injection"), "swift": ("web.evaluateJavaScript(s)", "xss"), "powershell": ("$x = invoke-restmethod $u", "ssrf"), "shell": ('rm -rf "$1"', "path_traversal")}
    df = spark.createDataFrame([(lang, line) for lang, (line, _) in code.items()], "language string, content string")
    got = {(r.language, r.category) for r in tagging.tag(df, R.SINKS, F.col("language")).collect()}
    assert got >= {(lang, category) for lang, (_, category) in code.items()}


def test_best_setting_and_unsent(spark):
    t = spark.createDataFrame([(8, 50.0), (0, 50.0), (16, None)], "s int, r double")
    assert tuple(evaluate.best_setting(t, "s", "r").first()) == (0, 50.0, 4)
    assert tuple(evaluate.best_setting(t.where("s > 99"), "s", "r").first()) == (0, 30.0, 2)
    c = spark.createDataFrame([(1, "a", 1), (2, "a", 1), (3, "b", 2), (4, None, 2)], "id int, f string, at int")
    assert rows(evaluate.unsent(c, ["f", "at"], "id"), "id") == [(1,), (3,), (4,)]
    assert rows(evaluate.unsent(c, ["f", "at"], "id", c.where("id = 3")), "id") == [(1,), (4,)]


def test_severity_blockers_language(spark):
    df = spark.createDataFrame([("sql_injection", "x/a.TS"), ("other", "b.unknown")], "c string, p string")
    got = df.select(severity_of(F.col("c")).alias("s"), blockers_of(F.col("c")).alias("b"), language_of(F.col("p")).alias("l")).collect()
    assert [tuple(r) for r in got] == [("CRITICAL", ["sql_injection"], "typescript"), ("LOW", ["other"], None)]


def test_secret_entropy(spark):
    t = spark.createDataFrame([(1, 1, 'token = "aaaaaaaaaa"'), (1, 2, 'token = "a1b2c3d4e5"')], "id int, line int, content string")
    assert rows(tagging.secrets(t, r'token = "(\w+)"', 3.0), "line", "entropy") == [(2, 3.3219)]


def test_enclosing_nested_and_decorated(spark):
    spans = spark.createDataFrame([("f", "outer", 10, 30), ("f", "inner", 15, 20), ("f", "late", 40, 50)], "file string, key string, start int, end int")
    pts = spark.createDataFrame([("f", 1, 15), ("f", 2, 30), ("f", 3, 39), ("f", 4, 35), ("f", 5, 34), ("g", 6, 15)], "file string, id int, line int")
    assert rows(graph.enclosing(pts, spans, "file", "line", "start", "end"), "id", "key") == [(1, "inner"), (1, "outer"), (2, "outer")]
    got = rows(graph.enclosing_or_next(pts, spans, "file", "id", "line", "start", "end", 5), "id", "key", "how")
    assert got == [(1, "inner", "inside"), (1, "outer", "inside"), (2, "outer", "inside"), (3, "late", "next"), (4, "late", "next")]
    for width in (3, 7, 100):
        assert rows(graph.enclosing_bucketed(pts, spans, "file", "line", "start", "end", width), "id", "key") == [(1, "inner"), (1, "outer"), (2, "outer")]


def simple_paths(edges, src, cap):
    best = {src: (src,)}
    level = [(src,)]
    for _ in range(cap - 1):
        grown = {}
        for p in level:
            for b in sorted(d for s, d in edges if s == p[-1]):
                if b not in best:
                    grown[b] = min(grown.get(b, (*p, b)), (*p, b))
        best |= grown
        level = list(grown.values())
    return best


@pytest.mark.parametrize("seed", range(3))
def test_shortest_paths_model(spark, seed):
    rnd = random.Random(seed)
    edges = {(rnd.randrange(8), rnd.randrange(8)) for _ in range(16)}
    cap = rnd.choice([2, 3, 8])
    df = spark.createDataFrame(sorted(edges), "src long, dst long")
    starts = spark.createDataFrame([(0,), (3,)], "node long")
    want = sorted(((s, n, list(p)) for s in (0, 3) for n, p in simple_paths(edges, s, cap).items()), key=str)
    assert sorted(((r.src, r.node, r.path) for r in graph.shortest_paths(df, starts, cap).collect()), key=str) == want


def test_call_edges_scoped_and_arguments(spark):
    fns = spark.createDataFrame([("a.f", "a", "f", ["x", "y"]), ("b.f", "b", "f", ["z"]), ("b.g", "b", "g", [])], "dst string, file string, name string, params array<string>")
    calls = spark.createDataFrame([("a.f", "a", "f"), ("b.g", "b", "f"), ("b.g", "b", "missing")], "src string, file string, name string")
    assert rows(graph.call_edges(calls.drop("file"), fns.drop("file", "params")), "src", "dst") == [("a.f", "a.f"), ("a.f", "b.f"), ("b.g", "a.f"), ("b.g", "b.f")]
    none = spark.createDataFrame([], "file string, target string")
    assert rows(graph.scoped_edges(calls, fns, none), "src", "dst") == [("a.f", "a.f"), ("b.g", "b.f")]
    args = spark.createDataFrame([("s", "f", ["1", "2"])], "src string, callee string, arguments array<string>")
    assert rows(graph.bind_arguments(args, fns.where("dst = 'a.f'")), "argument", "param") == [("1", "x"), ("2", "y")]


def test_compatible_pairs_known_listed_unknown(spark):
    s = spark.createDataFrame([("STDIN",), ("WEBSOCKET",)], "source_type string")
    k = spark.createDataFrame([("command_execution",), ("sql_injection",)], "category string")
    got = rows(paths.compatible_pairs(s, k, paths.compat_table(spark)), "source_type", "category")
    assert got == [("STDIN", "command_execution"), ("WEBSOCKET", "command_execution"), ("WEBSOCKET", "sql_injection")]


def test_blocking_by_taxonomy_and_own_name(spark):
    sinks = spark.createDataFrame([(1, "command_execution"), (1, "odd"), (2, "xss")], "k int, category string")
    san = spark.createDataFrame([(1, ["command_injection"]), (1, []), (2, ["odd"])], "k int, protects array<string>")
    assert rows(tagging.blocking(sinks, san, "k"), "k", "category", "blocked") == [(1, "command_execution", True), (1, "odd", False), (2, "xss", False)]


def budget_model(items, ceiling):
    rank = {"CRITICAL": 0, "HIGH": 1, "MEDIUM": 2, "LOW": 3}
    weight = lambda x: fixed.WEIGHTS.get(x["category"], 1)
    order = lambda x: (-weight(x), x["blocked"], x["steps"], x["id"])
    direct = [x for x in items if x["direct"]]
    best = {}
    for x in sorted((x for x in items if not x["direct"]), key=order):
        best.setdefault((x["sink"], x["category"], x["severity"]), x)
    by = {s: sorted((x for x in best.values() if x["severity"] == s), key=order) for s in rank}
    high = by["HIGH"]
    if ceiling and len(direct) + len(by["CRITICAL"]) + len(high) > ceiling:
        high = high[: max(0, ceiling - len(direct) - len(by["CRITICAL"]))]
    out = [(x["id"], 0) for x in direct] + [(x["id"], 1) for x in by["CRITICAL"]] + [(x["id"], 2) for x in high]
    covered = {x["category"] for x in direct + by["CRITICAL"] + high}
    rest, extra = by["MEDIUM"] + by["LOW"], []
    for x in rest:
        if x["category"] not in covered:
            covered.add(x["category"])
            extra.append(x)
    out += [(x["id"], 3) for x in extra]
    left = [x for x in rest if x not in extra]
    left = left[: max(0, ceiling - len(out))] if ceiling else left
    return sorted(out + [(x["id"], rank[x["severity"]] + 2) for x in left], key=str)


def test_numbers_in_order(spark):
    df = spark.createDataFrame([((i * 37) % 101, i) for i in range(101)], "k long, v long").repartition(7)
    got = prioritize.numbered(df, ["k"], "n").collect()
    assert sorted((r.n, r.k) for r in got) == [(k + 1, k) for k in range(101)]


def test_budget_pack_model(spark):
    rnd = random.Random(4)
    items = [(i, rnd.choice("ab"), rnd.randrange(5)) for i in range(300)]
    df = spark.createDataFrame(items, "id long, g string, size long")
    for budget in (0, 40, 10_000):
        want, total = [], {"a": 0, "b": 0}
        for i, g, n in items:
            total[g] += n
            want += [(i, total[g])] if total[g] <= budget else []
        assert rows(evaluate.budget_pack(df, "id", F.col("size"), budget, "g", parts=8), "id", "running") == sorted(want, key=str)


def test_serious_and_ordered(spark):
    f = spark.createDataFrame([(1, "LOW", 0.9), (2, "HIGH", 0.6), (3, "CRITICAL", 0.5), (4, "CRITICAL", 0.8), (5, "HIGH", 0.9)], "id int, severity string, confidence double")
    assert [r.id for r in evaluate.report_order(evaluate.serious(f), "id").collect()] == [4, 5, 2]
    raw = spark.createDataFrame([("", 0.9), (None, None), ("x", None), ("x", 0.7)], "raw string, c double")
    assert [r[0] for r in raw.select(evaluate.confidence_of(F.col("raw"), F.col("c"))).collect()] == [0.3, 0.3, 0.5, 0.7]


def test_taint_within_and_between(spark):
    st = "array<struct<line:int,target:string,expr:string,call:string,returned:boolean>>"
    fns = spark.createDataFrame([
        ("a", "run", [], [(1, "c", "read()", "read", False), (2, "d", "helper(c)", "helper", False), (3, None, "print(d)", "print", False), (4, None, "send(d)", "send", False), (5, None, "send(shlex.quote(d))", "send", False), (6, None, "send(dd)", "send", False)]),
        ("b", "helper", ["x"], [(8, "y", "x + 1", None, False), (9, None, "y", None, True)]),
        ("c", "safe", ["x"], [(11, None, "shlex.quote(x)", "quote", True)])], f"key string, name string, params array<string>, statements {st}")
    one = {r.key: r for r in taint.within(fns).collect()}
    assert one["b"].tainted == ["x", "y"] and one["b"].returns and one["a"].tainted == [] and not one["c"].returns
    assert [(r.call, r.sanitized) for r in one["c"].reaches] == [("quote", True)]
    calls = spark.createDataFrame([("a", "helper", 2, ["c"]), ("a", "read", 1, [])], "src string, name string, line int, arguments array<string>")
    seeds = spark.createDataFrame([("a", "c")], "key string, var string")
    got = {r.key: r for r in taint.between(fns, calls, seeds).collect()}
    assert sorted(got["a"].tainted) == ["c", "d"] and got["b"].returns and got["c"].tainted == []
    assert [(r.line, r.call, r.sanitized) for r in got["a"].reaches] == [(2, "helper", False), (4, "send", False), (5, "send", True)]  # print is noise, dd another word
    none = {r.key: r.tainted for r in taint.between(fns, calls, seeds.limit(0)).collect()}
    assert none == {"a": [], "b": [], "c": []}
    path = spark.createDataFrame([("p", 1, ["x"], 8, ["x", "y"], [(9, "f", False)]), ("p", 2, ["z"], 8, [], [(12, "g", False)])], "path string, o int, params array<string>, sink int, tainted array<string>, reaches array<struct<line:int,call:string,sanitized:boolean>>")
    assert rows(taint.fold_path(path, "path", "o", "sink"), "o", "tainted", "reach") == [(1, ["x", "y"], True), (2, ["x", "y", "z"], False)]


def test_resolved_edges(spark):
    fns = spark.createDataFrame([("s.get", "s.py", "get", "Store"), ("o.get", "o.py", "get", ""), ("m.run", "m.py", "run", "")], "dst string, file string, name string, class_name string")
    calls = spark.createDataFrame([("m.run", "m.py", "get", "Store"), ("m.run", "m.py", "get", None), ("m.run", "m.py", "get", "other")], "src string, file string, name string, receiver string")
    files = spark.createDataFrame([("pkg/o.py",), ("s.py",)], "path string")
    imports = spark.createDataFrame([("m.py", "from pkg.o import"), ("m.py", "import os")], "file string, module string")
    targets = graph.import_targets(imports, files)
    assert rows(targets, "file", "target") == [("m.py", "pkg/o.py")]
    near = spark.createDataFrame([("m.py", "o.py")], "file string, target string")
    assert rows(graph.resolved_edges(calls, fns, near), "src", "dst") == [("m.run", "o.get"), ("m.run", "s.get")]
    assert rows(graph.resolved_edges(calls, fns, near.limit(0)), "src", "dst") == [("m.run", "s.get")]


def test_filters_and_versions(spark):
    r = spark.createDataFrame([(1, 0.5, 1, "cpe:x:django", "sql", "django", ["CWE-89"], "pypi"), (2, None, 0, "", "flask app", "flask", None, "pypi"), (3, 0.9, 0, "", "other", "left-pad", ["CWE-79"], "npm")], "id int, epss double, known_flag int, cpes string, description string, package string, cwe_ids array<string>, ecosystem string")
    ids = lambda **how: [x.id for x in knowledge.filtered(r, F.coalesce("epss", F.lit(0.0)), 10, **how).collect()]
    assert ids() == [3, 1, 2] and ids(min_epss=0.6) == [3] and ids(known_only=True) == [1] and ids(tech=["FLASK", "django"]) == [1, 2]
    assert ids(cwes=["CWE-89"]) == [1] and ids(ecosystem="npm") == [3]
    v = spark.createDataFrame([("before 1.2", "1.2"), ("", "1"), ("1", None), (None, "1"), ("2.0", "1")], "a string, v string")
    assert [x[0] for x in v.select(knowledge.affects(F.col("a"), F.col("v"))).collect()] == [True, False, False, False, False]


def test_chains_keep_ties(spark):
    """Equal values are common, as a middle finding caps them: the least ids win, whatever the ends' own confidence."""
    f = [(1000, "a", 1, 0.9)] + [(2000 + i, "c", 1, 0.9) for i in range(60)] + [(100 + i, "c", 1, 0.5) for i in range(10)] + [(5, "b", 4, 0.3)]
    df = spark.createDataFrame(f, "id long, role string, severity int, confidence double")
    steps = [("a", "b", "x"), ("b", "c", "y")]
    paths_ = chains.role_paths(spark, ["a", "b", "c"], steps)
    got = [r.ids for r in chains.chains(df, paths_, 50).collect()]
    every = [r.ids for r in chains.chains(df, paths_, 5000).collect()]
    assert got == every[:50] and "5,100,1000" in every
    best = [r.ids for r in chains.chains(df.where("role <> 'b' OR id > 5").unionByName(spark.createDataFrame([(500, "b", 4, 0.3)], df.schema)), paths_, 12).collect()]
    assert best[:10] == ["100,500"] + [f"{100 + i},500" for i in range(1, 10)]


@pytest.mark.parametrize("ceiling", [0, 3, 12, 40])
def test_tiered_budget_model(spark, ceiling):
    rnd = random.Random(ceiling)
    items = [{"id": i, "severity": rnd.choice(["CRITICAL", "HIGH", "MEDIUM", "LOW"]), "category": rnd.choice(["sql_injection", "ssrf", "odd", "xss", "weak_crypto"]), "direct": rnd.random() < 0.05, "blocked": rnd.random() < 0.5, "steps": rnd.randrange(4), "sink": rnd.randrange(12)} for i in range(80)]
    df = spark.createDataFrame(items, "id long, severity string, category string, direct boolean, blocked boolean, steps int, sink long")
    assert rows(prioritize.tiered_budget(df, ceiling, ["sink", "category", "severity"]), "id", "tier") == budget_model(items, ceiling)


def test_chain_model(spark):
    rnd = random.Random(3)
    roles = sorted(set(fixed.ROLES.values()))
    f = [(i, rnd.choice(roles), rnd.randrange(1, 5), rnd.randrange(10, 100) / 100) for i in range(14)]
    step = {(a, b): label for a, b, label in fixed.TRANSITIONS}
    rep = {}
    for x in f:
        rep.setdefault(x[1], x)
    found = {}
    for a, b in itertools.permutations(f, 2):
        level, seen, hit = [[a[1]]], set(), None
        while level and hit is None:
            grown = {}
            for p in level:
                for r in sorted(roles):
                    if (p[-1], r) in step and r in rep and r not in seen:
                        grown[r] = min(grown.get(r, [*p, r]), [*p, r])
            hit = grown.get(b[1])
            seen |= set(grown)
            level = [p for r, p in grown.items() if r != a[1]]
        if hit:
            links = [a, *(rep[r] for r in hit[1:-1]), b]
            key = ",".join(map(str, sorted(x[0] for x in links)))
            conf = round(min(x[3] for x in links) * 0.8 ** (len(links) - 1) + 1e-12, 2)
            name = " -> ".join(step[p] for p in zip(hit, hit[1:]))
            found[key] = min(found.get(key, (-conf, name)), (-conf, name))
    df = spark.createDataFrame(f, "id long, role string, severity int, confidence double")
    got = chains.chains(df, chains.role_paths(spark, sorted({x[1] for x in f})), 1000).collect()
    assert {r.ids: r.name for r in got} == {k: v[1] for k, v in found.items()} and len(got) > 5


def test_lifetimes(spark):
    code = ["p = malloc(1);", "free(p);", "p[0] = 1;", "free(p);", "p = malloc(2);", "p[1] = 2;", "free(q);"]
    lines = spark.createDataFrame([("a.c", i + 1, c) for i, c in enumerate(code)], "file string, line int, content string")
    assert rows(memory.lifetime_findings(lines), "line", "vulnerability_class", "severity") == [(3, "use_after_free", "CRITICAL"), (4, "double_free", "CRITICAL"), (7, "invalid_free", "HIGH")]


def test_memory_detectors(spark):
    code = ["gets(line);", "memcpy(a, input, len);", "p = malloc(n * size);", "printf(msg);", 'printf("ok");', "x = alloca(n + 1);"]
    lines = spark.createDataFrame([("a.c", i + 1, c) for i, c in enumerate(code)], "file string, line int, content string")
    got = rows(memory.all_findings(lines), "line", "vulnerability_class", "severity")
    for want in ((1, "unbounded_write", "CRITICAL"), (2, "unchecked_copy", "HIGH"), (3, "allocation_size", "HIGH"), (4, "format_string", "CRITICAL"), (6, "allocation_size", "CRITICAL")):
        assert want in got
    assert not any(line == 5 for line, *_ in got)
    guarded = spark.createDataFrame([("a.c", 1, "if (len < sizeof(a))"), ("a.c", 2, "memcpy(a, input, len);")], "file string, line int, content string")
    assert rows(memory.buffers(guarded), "line") == []
    verdicts = spark.createDataFrame([("a.c", 1, "FALSE")], "file string, line int, verdict string")
    assert not any(r.line == 1 and r.severity == "CRITICAL" for r in memory.confirmed(memory.all_findings(lines), verdicts, ["file", "line"]).collect())


def test_search_and_fallback(spark):
    d = spark.createDataFrame([(1, "Alpha beta", 3), (2, "beta gamma", 9), (3, "x", 1)], "id int, t string, s int")
    search = lambda *w: [(r.id, r.matched) for r in knowledge.keyword_search(d, "id", "t", w, [F.desc("s"), "id"], 10).collect()]
    assert search("alpha", "beta") == [(1, "all")] and search("beta", "zzz") == [(2, "any"), (1, "any")]
    assert search("q", "z") == [] and search() == []
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [0.6, 0.8])], "id int, v array<double>")
    q = spark.createDataFrame([(9, [2.0, 0.0])], "query_id int, q array<double>")
    assert rows(knowledge.semantic_topk(v, q, 2, 0.6, "id", "v"), "id", "similarity") == [(1, 1.0), (3, 0.6)]


def test_metrics_and_votes(spark):
    t = spark.createDataFrame([("a", True, False), ("a", True, False), ("b", False, False)], "g string, t boolean, p boolean")
    got = evaluate.confusion(t, F.col("t"), F.col("p"), [[], ["g"]], ["g"])
    assert rows(got, "g", "tp", "fn", "tn", "precision", "recall", "accuracy") == [("a", 0, 2, 0, 0.0, 0.0, 0.0), ("b", 0, 0, 1, 0.0, 0.0, 1.0), (None, 0, 2, 1, 0.0, 0.0, 0.3333)]
    base = spark.createDataFrame([("a", 0.4), ("b", 0.5), ("b", 0.5)], "k string, ratio double")
    now = spark.createDataFrame([("a", -0.3), ("b", 0.4), ("c", 0.1), ("a", None)], "k string, ratio double")
    assert rows(evaluate.anomalies(base, now, "k"), "k", "suspicious") == [("a", False), ("a", True), ("b", True), ("c", False)]
    v = spark.createDataFrame([(1, 1, "x"), (1, 2, "y"), (1, 3, "y")], "k int, run int, v string")
    assert rows(evaluate.vote(v, "k", "run", "v", 0.66), "first_value", "agreement", "stable", "majority", "by_two_thirds") == [("x", 0.3333, False, "y", True)]


def test_weights_follow_context():
    w = fixed.category_weights("java", ("Spring Boot",))
    assert w["spel_injection"] == 17 and w["deserialization"] == 17 and fixed.category_weights()["xxe"] == 6
