"""Memory-safety detectors for C, C++ and Rust lines: allocation, buffers, lifetime, overflow, format strings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Variable names that hint at outside data.
OUTSIDE = [
    "input", "buf", "data", "body", "request", "param", "arg", "argv", "content", "line", "str", "msg", "packet", "payload",
    "frame", "user_input", "query", "header", "path", "filename", "url", "stdin", "env", "recv", "read", "fread", "getline",
    "err", "message", "text", "value", "result", "output", "response"]
# Names of checks against overflow; and of operands that make arithmetic on sizes dangerous.
CHECKS = [
    "CHECK_OVERFLOW", "CHECK_SIZE", "OVERFLOW_OK", "__builtin_mul_overflow", "__builtin_add_overflow", "safe_mul", "safe_add",
    "checked_mul", "checked_add", "wrapping_mul", "wrapping_add"]
OPERANDS = [
    "input", "buf", "data", "body", "request", "param", "arg", "argv", "content", "content_length", "len", "size", "n", "sz", "count",
    "user_input", "query", "header", "path", "filename", "url", "stdin", "env", "recv", "read", "fread", "getline", "line",
    "str", "msg", "packet", "payload", "frame", "chunk"]
#: A comparison in a condition or an assertion, a size that is asked for, or a check by name.
GUARDS = r"\bif\s*\([^)]*[<>]|\bassert\s*\([^)]*[<>]|\bsizeof\b|\b(?:" + "|".join(CHECKS) + r")\b"
COLUMNS = ["file", "line", "vulnerability_class", "severity", "confidence", "cwe_id", "source_module"]


def _finding(df: DataFrame, cls, severity, confidence, cwe: str, module: str) -> DataFrame:
    lit = lambda x: x if not isinstance(x, (str, float)) else F.lit(x)
    return df.select("file", "line", lit(cls).alias("vulnerability_class"), lit(severity).alias("severity"), lit(confidence).cast("double").alias("confidence"), F.lit(cwe).alias("cwe_id"), F.lit(module).alias("source_module"))


def _matches(lines: DataFrame, pattern: str, groups: int) -> DataFrame:
    """A row per match with g1.. for its groups."""
    whole = lines.withColumn("_m", F.explode(F.regexp_extract_all("content", F.lit(pattern), 0)))
    return whole.withColumns({f"g{k}": F.regexp_extract("_m", pattern, k) for k in range(1, groups + 1)})


def with_context(lines: DataFrame, before: int, after: int, wanted) -> DataFrame:
    """The wanted lines with ``context``: those around them in their file, joined.

    Only numbers around wanted lines are looked up, by equality, so files without any cost nothing and no window holds one.
    """
    hits = lines.where(wanted)
    near = hits.select("file", F.col("line").alias("at"), F.explode(F.sequence(F.col("line") - before, F.col("line") + after)).alias("line"))
    around = near.join(lines.select("file", "line", "content"), ["file", "line"]).groupBy("file", "at").agg(F.array_sort(F.collect_list(F.struct("line", "content"))).alias("_c"))
    context = around.select("file", F.col("at").alias("line"), F.array_join(F.transform("_c", lambda x: x["content"]), "\n").alias("context"))
    return hits.join(context, ["file", "line"])


def allocations(lines: DataFrame) -> DataFrame:
    """Allocation sizes that are computed; lines: (file, line, content)."""
    m = _matches(lines, r"\b(malloc|calloc|realloc|alloca|with_capacity)\s*\(([^;]*)\)", 2)
    times, other = F.col("g2").rlike(r"\w\s*\*\s*\w"), F.col("g2").rlike(r"\w\s*(?:\+|<<)\s*\w")
    stack = F.col("g1") == "alloca"
    severity = F.when(stack & (times | other), "CRITICAL").when(times, "HIGH").when(other | (F.trim("g2") == ""), "MEDIUM")
    confidence = F.when(stack & (times | other), 0.8).when(times, 0.7).when(other, 0.6).otherwise(0.5)
    return _finding(m.withColumn("_s", severity).where("_s IS NOT NULL"), "allocation_size", F.col("_s"), confidence, "CWE-190", "allocation")


def buffers(lines: DataFrame) -> DataFrame:
    """Unbounded writes, unguarded copies and bounded copies worth a look."""
    unbounded = _matches(lines, r"\b(strcpy|strcat|sprintf|gets)\s*\(\s*(\w+)", 2)
    out = _finding(unbounded, "unbounded_write", "CRITICAL", 0.95, "CWE-120", "buffer")
    copies = _matches(with_context(lines, 4, 5, F.col("content").rlike(r"\b(?:memcpy|memmove)\s*\(")), r"\b(memcpy|memmove)\s*\(\s*(\w+)\s*,\s*(\w+)\s*,\s*([^;]*)\)", 4)
    tainted = F.lower("g3").isin(*OUTSIDE) | F.col("g4").rlike(r"(?i)\b(?:" + "|".join(OUTSIDE) + r"|len|size|n|count)\b")
    out = out.unionByName(_finding(copies.where(tainted & ~F.col("context").rlike(GUARDS)), "unchecked_copy", "HIGH", 0.8, "CWE-119", "buffer"))
    return out.unionByName(_finding(_matches(lines, r"\b(strncpy|snprintf)\s*\(\s*(\w+)", 2), "bounded_copy", "MEDIUM", 0.6, "CWE-119", "buffer"))


def lifetime_events(lines: DataFrame) -> DataFrame:
    """(key, at, event): allocations, frees and uses per (file, variable)."""
    alloc = _matches(lines, r"\b(\w+)\s*=\s*(?:\([^)]*\)\s*)?(?:malloc|calloc|realloc|new)\b", 1).select("file", "line", F.col("g1").alias("var"), F.lit("alloc").alias("event"))
    free = _matches(lines, r"\b(?:free|delete(?:\s*\[\s*\])?)\s*\(?\s*(\w+)", 1).select("file", "line", F.col("g1").alias("var"), F.lit("free").alias("event"))
    use = _matches(lines, r"\b(\w+)\s*(?:->|\[)|\*(\w+)\s*[=;]", 2).select("file", "line", F.when(F.col("g1") != "", F.col("g1")).otherwise(F.col("g2")).alias("var"), F.lit("use").alias("event"))
    return alloc.unionByName(free).unionByName(use).select(F.struct("file", "var").alias("key"), F.col("line").alias("at"), "event")


def lifetimes(events: DataFrame) -> DataFrame:
    """Per key: double_free, use_after_free and invalid_free with the place ``at``.

    events: (key, at, event) with alloc, free and use. A double free is a free whose previous alloc or free is a free; a use
    after free is a use whose previous alloc or free is a free; an invalid free has no alloc at all.
    """
    w = Window.partitionBy("key").orderBy("at", F.expr("CASE event WHEN 'use' THEN 0 WHEN 'free' THEN 1 ELSE 2 END"))
    state = F.last(F.when(F.col("event") != "use", F.col("event")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    allocs = F.count(F.when(F.col("event") == "alloc", 1)).over(Window.partitionBy("key"))
    rows = events.withColumns({"_before": state, "_allocs": allocs})
    kind = F.when((F.col("event") == "free") & (F.col("_before") == "free"), "double_free").when((F.col("event") == "use") & (F.col("_before") == "free"), "use_after_free").when((F.col("event") == "free") & (F.col("_allocs") == 0), "invalid_free")
    return rows.select("key", "at", kind.alias("kind")).where("kind IS NOT NULL")


def lifetime_findings(lines: DataFrame) -> DataFrame:
    rows = lifetimes(lifetime_events(lines)).select(F.col("key.file").alias("file"), F.col("at").alias("line"), "kind")
    severity = F.when(F.col("kind") == "invalid_free", "HIGH").otherwise("CRITICAL")
    confidence = F.when(F.col("kind") == "double_free", 0.85).when(F.col("kind") == "use_after_free", 0.8).otherwise(0.5)
    return _finding(rows, F.col("kind"), severity, confidence, "CWE-416", "lifetime")


def overflows(lines: DataFrame) -> DataFrame:
    """Arithmetic on dangerous operands near an allocation or copy, without a check around."""
    operand = "(?:" + "|".join(OPERANDS) + ")"
    wanted = F.col("content").rlike(rf"\b{operand}\b\s*(?:\*|\+|<<|-)\s*\w|\w\s*(?:\*|\+|<<|-)\s*{operand}\b")
    near = with_context(lines, 10, 4, wanted)
    hot = near.where(F.col("context").rlike(r"\b(?:malloc|calloc|realloc|alloca|memcpy|memmove|with_capacity)\s*\(|\bnew\s+\w+\s*\[|\bBox::new\s*\(") & ~F.col("context").rlike(GUARDS))
    return _finding(hot, "integer_overflow", "HIGH", 0.7, "CWE-190", "int_overflow")


def indexes(lines: DataFrame) -> DataFrame:
    """Reads and writes at an index, and slices of Rust, whose bound is an outside name."""
    outside = F.lower("g2").isin(*OUTSIDE, *OPERANDS)
    out = _finding(_matches(lines, r"\b(\w+)\s*\[\s*([A-Za-z_]\w*)\s*\]", 2).where(outside), "unchecked_index", "HIGH", 0.7, "CWE-129", "buffer")
    return out.unionByName(_finding(_matches(lines, r"\b(\w+)\s*\[[^\]]*?\.\.=?\s*([A-Za-z_]\w*)\s*\]", 2).where(outside), "unchecked_slice", "MEDIUM", 0.5, "CWE-129", "buffer"))


def formats(lines: DataFrame) -> DataFrame:
    """Format functions whose format is a variable."""
    m = _matches(lines, r"\b(printf|fprintf|sprintf|snprintf|dprintf|syslog|warn)\s*\((?:\s*\w+\s*,){0,2}?\s*([A-Za-z_]\w*)\s*\)", 2)
    outside = F.lower("g2").isin(*OUTSIDE)
    return _finding(m, "format_string", F.when(outside, "CRITICAL").otherwise("MEDIUM"), F.when(outside, 0.85).otherwise(0.5), "CWE-134", "format")


def all_findings(lines: DataFrame) -> DataFrame:
    out = allocations(lines)
    for f in (buffers, indexes, lifetime_findings, overflows, formats):
        out = out.unionByName(f(lines))
    return out


def confirmed(findings: DataFrame, verdicts: DataFrame, key: list[str]) -> DataFrame:
    """CRITICAL and HIGH findings need the verdict REAL or none at all; the others stay."""
    rows = findings.join(verdicts, key, "left")
    return rows.where(~F.col("severity").isin("CRITICAL", "HIGH") | F.col("verdict").isNull() | (F.col("verdict") == "REAL"))
