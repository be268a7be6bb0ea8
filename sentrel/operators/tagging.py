"""Rule taggers over lines of text: sources, sinks, sanitizers, entry points, imports, secrets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentrel.functions.expressions import blockers_of, entropy, severity_of
from sentrel.functions.rules import Rule


def lines(texts: DataFrame, key: str, text: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """(key, *keep, line, content): every line of every text, counted from 1."""
    return texts.select(key, *keep, F.posexplode(F.split(F.col(text), "\n", -1)).alias("line", "content")).withColumn("line", F.col("line") + 1)


def any_match(line: Column, rules: Sequence[Rule], language: Column | None = None) -> Column:
    """Whether some rule of the row's language matches."""
    def joined(some: Sequence[Rule]) -> Column:
        return line.rlike("|".join(f"(?:{r.pattern})" for r in some)) if some else F.lit(False)

    if language is None:
        return joined(rules)
    every = [r for r in rules if r.language == "*"]
    out = None
    for name in sorted({r.language for r in rules} - {"*"}):
        hit = joined([*every, *(r for r in rules if r.language == name)])
        out = F.when(language == name, hit) if out is None else out.when(language == name, hit)
    return joined(every) if out is None else out.otherwise(joined(every))


def tag(rows: DataFrame, rules: Sequence[Rule], language: Column | None = None, content: str = "content") -> DataFrame:
    """A row per match: the rows' columns with ord, category, cwe, protects and value.

    A row first meets all patterns of its language joined into one, and only rows that match it are taken apart by the rules
    of their language. Each rule is one literal pattern, so a pattern is compiled once.
    """
    line, kind = F.col(content), "array<struct<ord:int,category:string,cwe:string,protects:array<string>,value:string>>"
    rows = rows.where(any_match(line, rules, language))

    def matches(names: Sequence[str]) -> Column:
        found = [
            F.transform(
                F.regexp_extract_all(line, F.lit(r.pattern), r.group),
                lambda m: F.struct(F.lit(k).alias("ord"), F.lit(r.category).alias("category"), F.lit(r.cwe).alias("cwe"), F.array(*map(F.lit, r.protects)).cast("array<string>").alias("protects"), F.substring(m, 1, 200).alias("value")))
            for k, r in enumerate(rules) if r.language in names]
        return F.concat(*found) if found else F.array().cast(kind)

    names = {r.language for r in rules}
    if language is None:
        found = matches(names)
    else:
        found = matches(["*"])
        for name in sorted(names - {"*"}):
            found = F.when(language == name, matches(["*", name])).otherwise(found)
    return rows.select("*", F.explode(found).alias("hit")).select(*rows.columns, "hit.*")


def tag_whole(texts: DataFrame, rules: Sequence[Rule], text: str = "text") -> DataFrame:
    """As tag() for rules that span lines: over whole texts, with the line that each match starts on.

    A text is cut at its matches, so a match's line follows from the pieces before it and equal matches keep their own.
    """
    out, mark = None, "\ufdd0"  # a noncharacter
    for k, r in enumerate(rules):
        body = F.col(text)
        rest = F.split(F.regexp_replace(body, r.pattern, mark), mark, -1)
        found = F.regexp_extract_all(body, F.lit(r.pattern), 0)
        breaks = lambda c: F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))
        pairs = F.arrays_zip(F.slice(rest, 1, F.size(found)).alias("before"), found.alias("value"))
        zero = F.struct(F.lit(1).alias("line"), F.array().cast("array<struct<line:int,value:string>>").alias("hits"))

        def step(acc: Column, x: Column) -> Column:
            line = acc["line"] + breaks(x["before"])
            return F.struct((line + breaks(x["value"])).alias("line"), F.concat(acc["hits"], F.array(F.struct(line.alias("line"), x["value"].alias("value")))).alias("hits"))

        hits = texts.where(body.rlike(r.pattern)).select("*", F.explode(F.aggregate(pairs, zero, step, lambda a: a["hits"])).alias("hit")).select(*texts.columns, "hit.line", "hit.value")
        hits = hits.withColumns({"ord": F.lit(k), "category": F.lit(r.category), "cwe": F.lit(r.cwe)})
        out = hits if out is None else out.unionByName(hits)
    return out


def dedup_sinks(hits: DataFrame, key: str) -> DataFrame:
    """One row per (key, line, category): the first rule's match, all distinct CWE ids in rule order, the severity."""
    first = F.min_by(F.struct("value", "cwe"), F.struct("ord", "value"))
    ids = F.array_sort(F.collect_set(F.struct("ord", "cwe")))
    cwes = F.array_distinct(F.filter(F.transform(ids, lambda s: s["cwe"]), lambda c: c != ""))
    grouped = hits.groupBy(key, "line", "category").agg(first.alias("f"), F.array_join(cwes, ",").alias("cwe_ids"), F.count("*").alias("n_matches"))
    return grouped.select(key, "line", "category", F.col("f.value").alias("matched"), "cwe_ids", "n_matches", severity_of(F.col("category")).alias("severity"))


def blocking(sinks: DataFrame, sanitizers: DataFrame, key: str) -> DataFrame:
    """Sinks with ``blocked``: some sanitizer of the same key protects against the sink's category."""
    shields = sanitizers.select(F.col(key).alias("_k"), F.explode("protects").alias("shield")).distinct()
    need = sinks.select(key, "category").distinct().select(key, "category", F.explode(blockers_of(F.col("category"))).alias("shield"))
    safe = need.join(shields, (need[key] == shields["_k"]) & (need["shield"] == shields["shield"]), "left_semi").select(key, "category").distinct().withColumn("blocked", F.lit(True))
    return sinks.join(safe, [key, "category"], "left").withColumn("blocked", F.coalesce("blocked", F.lit(False)))


def secrets(rows: DataFrame, pattern: str, least: float, content: str = "content") -> DataFrame:
    """Captured secrets (group 1) whose entropy reaches ``least`` bits."""
    found = rows.select(*[c for c in rows.columns if c != content], F.explode(F.regexp_extract_all(F.col(content), F.lit(pattern), 1)).alias("secret"))
    return found.withColumn("entropy", F.round(entropy(F.col("secret")), 4)).where(F.col("entropy") >= least)


def snippet(texts: DataFrame, at: str, before: int = 10, after: int = 5, text: str = "text") -> DataFrame:
    """``snippet``: the lines around line ``at`` (from 1)."""
    body = F.split(F.col(text), "\n", -1)
    start = F.greatest(F.col(at) - before, F.lit(1))
    return texts.withColumn("snippet", F.array_join(F.slice(body, start, F.col(at) + after - start + 1), "\n"))


def context(texts: DataFrame, at: Column, before: int, after: int, text: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """(*keep, line, content, context): the lines of a text where ``at`` holds of ``line``, with those around joined.

    The lines stay an array in the scan's stage; only the wanted ones become rows.
    """
    body = texts.select(*keep, F.split(F.col(text), "\n", -1).alias("_all"))
    rows = body.select(*keep, "_all", F.posexplode("_all").alias("line", "content")).where(at).withColumn("line", F.col("line") + 1)
    start = F.greatest(F.col("line") - before, F.lit(1))
    around = F.slice("_all", start, F.col("line") + after - start + 1)
    return rows.select(*keep, "line", "content", F.array_join(around, "\n").alias("context"))


def strip_comments(source: Column, language: str) -> Column:
    """The source without line comments, and without block comments where the language has them."""
    if language in ("python", "shell", "ruby", "powershell"):
        return F.regexp_replace(source, r"(?m)#[^\n]*$", "")
    return F.regexp_replace(F.regexp_replace(source, r"(?s)/\*.*?\*/", ""), r"(?m)//[^\n]*$", "")
