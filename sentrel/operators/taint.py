"""Taint within and between functions.

Within a function taint is one ordered fold over its statements. Between functions it is a fixpoint: tainted arguments
taint the callee's parameters, and a callee that returns taint taints what the call is assigned to.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentrel.session import cut_lineage

# Functions that only show or describe a value; and functions that make it safe.
NOISE = [
    "print", "log", "logger.", "logging.", "writeln", "Write-Host", "echo", "fmt.Println", "fmt.Printf", "System.out.println",
    "console.log", "dump", "var_dump", "toString", "__repr__", "__str__", "str", "repr", "format", "len", "type", "isinstance"]
SANITIZING = [
    "html.escape", "html_escape", "escape_html", "sanitize_html", "sanitize", "bleach.clean", "strip_tags", "DOMPurify.sanitize", "xss_filter",
    "shlex.quote", "quote", "pipes.quote", "shell_quote", "os.path.normpath", "os.path.realpath", "Path.resolve", "secure_filename",
    "safe_join", "validate_filename", "pathlib.Path.resolve", "yaml.safe_load", "json.loads", "msgpack.unpackb",
    "int.parse", "float.parse", "intval", "parseInt", "parseFloat", "re.match", "re.fullmatch", "re.search",
    "htmlspecialchars", "htmlentities", "urlencode", "rawurlencode", "mysql_real_escape_string", "mysqli_real_escape_string", "pg_escape_string",
    "urllib.parse.quote", "urllib.parse.quote_plus", "encodeURIComponent", "validate_email", "validate_url", "validate_ip",
    "bcrypt.hash", "bcrypt.verify", "password_hash", "argon2.hash", "jwt.verify", "jwt.decode", "verify_signature",
    "canReadFile", "isPathSafe", "isInDirectory", "isAuthorized", "authorize", "checkPermission", "requirePermission",
    "Authentication.verify", "isAuthenticated", "isAdmin"]
#: The same by their last part, as calls name them.
_LAST = lambda names: sorted({n.rstrip(".").split(".")[-1].lower() for n in names})

REACH = "array<struct<line:int,call:string,sanitized:boolean>>"


def within(functions: DataFrame, seeds: Column | None = None, noise: Sequence[str] = NOISE, sanitizing: Sequence[str] = SANITIZING) -> DataFrame:
    """(key, tainted, reaches, returns): taint of a function as one ordered fold.

    functions: (key, params, statements array<struct<line, target, expr, call, returned>>); ``seeds`` are the variables that start
    tainted, the parameters by default. A target is tainted if its expression names a tainted variable as a word. A call
    whose expression does is a reach, but for noise, and is sanitized if the expression goes through a sanitizer. A
    returned expression that does, without a sanitizer, makes the function return taint.
    """
    zero = F.struct(F.coalesce(F.col("params") if seeds is None else seeds, F.array().cast("array<string>")).alias("tainted"), F.array().cast(REACH).alias("reaches"), F.lit(False).alias("returns"))
    safe = F.array(*map(F.lit, _LAST(sanitizing)))

    def step(acc: Column, s: Column) -> Column:
        words = F.split(s["expr"], r"\W+")
        hot = F.arrays_overlap(acc["tainted"], words)
        clean = F.arrays_overlap(F.transform(words, F.lower), safe)
        call = hot & s["call"].isNotNull() & ~F.coalesce(F.lower(s["call"]).isin(*_LAST(noise)), F.lit(False))
        reach = F.array(F.struct(s["line"].alias("line"), s["call"].alias("call"), clean.alias("sanitized")))
        return F.struct(
            F.when(hot & s["target"].isNotNull(), F.array_union(acc["tainted"], F.array(s["target"]))).otherwise(acc["tainted"]).alias("tainted"),
            F.when(call, F.concat(acc["reaches"], reach)).otherwise(acc["reaches"]).alias("reaches"),
            (acc["returns"] | (hot & s["returned"] & ~clean)).alias("returns"))

    return functions.select("key", F.aggregate("statements", zero, step).alias("r")).select("key", "r.tainted", "r.reaches", "r.returns")


def between(functions: DataFrame, calls: DataFrame, seeds: DataFrame, rounds: int = 10) -> DataFrame:
    """(key, tainted, reaches, returns) of every function once taint has gone down into parameters and up through returns.

    functions: (key, name, params, statements); calls: (src, name, line, arguments); seeds: (key, var), what starts tainted. A
    name stands for the function of the least key. Rounds end when nothing new is tainted.
    """
    fns = cut_lineage(functions.select("key", "name", "params", "statements"), "taint-functions")
    first = fns.groupBy("name").agg(F.min("key").alias("callee"))
    params = fns.select(F.col("key").alias("callee"), F.posexplode("params").alias("position", "param"))
    down = calls.join(first, "name").select("src", "callee", F.posexplode("arguments").alias("position", "argument")).join(params, ["callee", "position"]).select("src", "argument", "callee", "param")
    up = fns.select(F.col("key").alias("src"), F.explode("statements").alias("s")).where("s.target IS NOT NULL AND s.call IS NOT NULL").join(first.withColumnRenamed("name", "_name"), F.col("s.call") == F.col("_name")).select("src", F.col("s.target").alias("target"), "callee")
    down, up = cut_lineage(down, "taint-down"), cut_lineage(up, "taint-up")
    known = cut_lineage(seeds.select("key", "var").distinct(), "taint-0")
    for k in range(1, rounds + 1):
        state = cut_lineage(_state(fns, known), f"taint-state-{k}")
        hot = state.select(F.col("key").alias("src"), F.explode("tainted").alias("argument"))
        new = down.join(hot, ["src", "argument"]).select(F.col("callee").alias("key"), F.col("param").alias("var"))
        new = new.unionByName(up.join(state.where("returns").select(F.col("key").alias("callee")), "callee").select(F.col("src").alias("key"), F.col("target").alias("var")))
        new = cut_lineage(new.distinct().join(known, ["key", "var"], "left_anti"), f"taint-new-{k}")
        if new.isEmpty():
            return state
        known = cut_lineage(known.unionByName(new), f"taint-{k}")
    return _state(fns, known)


def _state(fns: DataFrame, known: DataFrame) -> DataFrame:
    own = known.groupBy("key").agg(F.array_sort(F.collect_set("var")).alias("_seeds"))
    return within(fns.join(own, "key", "left"), F.col("_seeds"))


def fold_path(steps: DataFrame, path: str, order: str, sink_line: str) -> DataFrame:
    """(path, order, tainted, reach): taint along the functions of a path, in order.

    steps: (path, order, params, sink_line, tainted, reaches), a function's own fold per step. What is tainted after a step
    is what was before, the step's parameters and its own taint; ``reach`` says whether a reach lies within a line of the sink.
    """
    near = F.exists("reaches", lambda r: F.abs(r["line"] - F.col(sink_line)) <= 1)
    ordered = F.array_sort(F.collect_list(F.struct(F.col(order).cast("long").alias("o"), F.array_union("params", "tainted").alias("own"), near.alias("reach"))))
    kind = "array<struct<o:bigint,tainted:array<string>,reach:boolean>>"
    zero = F.struct(F.array().cast("array<string>").alias("seen"), F.array().cast(kind).alias("out"))

    def step(acc: Column, s: Column) -> Column:
        seen = F.array_union(acc["seen"], s["own"])
        return F.struct(seen.alias("seen"), F.concat(acc["out"], F.array(F.struct(s["o"].alias("o"), seen.alias("tainted"), s["reach"].alias("reach")))).alias("out"))

    rows = steps.groupBy(path).agg(ordered.alias("s")).select(path, F.explode(F.aggregate("s", zero, step, lambda x: x["out"])).alias("x"))
    return rows.select(path, F.col("x.o").alias(order), "x.tainted", "x.reach")
