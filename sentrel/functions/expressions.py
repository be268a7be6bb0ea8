"""Column expressions that several operators use."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from sentrel.functions import fixed


def lookup(key: Column, values: Mapping, default=None) -> Column:
    """A small constant mapping as a map literal."""
    if not values:
        return F.lit(default)
    table = F.create_map(*(F.lit(x) for kv in values.items() for x in kv))
    return F.coalesce(F.try_element_at(table, key), F.lit(default))


def severity_of(category: Column) -> Column:
    """The severity of a sink category."""
    return lookup(category, {c: s for s, cs in fixed.SEVERITY_CATEGORIES.items() for c in cs}, "LOW")


def severity_rank(severity: Column) -> Column:
    """0 for CRITICAL up to 4 for INFO; unknown ones rank as LOW."""
    return lookup(F.upper(severity), {s: i for i, s in enumerate(fixed.SEVERITIES)}, 3)


def weight_of(category: Column, weights: Mapping[str, int] = fixed.WEIGHTS) -> Column:
    return lookup(category, weights, 1)


def blockers_of(category: Column) -> Column:
    """The protections that block a category; its own name where the taxonomy has none."""
    table = F.create_map(*(x for c, p in fixed.TAXONOMY.items() for x in (F.lit(c), F.array(*map(F.lit, p)))))
    return F.coalesce(F.try_element_at(table, category), F.array(category))


def entropy(text: Column) -> Column:
    """Shannon entropy of a string's characters, in bits."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    n = F.size(chars).cast("double")
    share = lambda c: F.size(F.filter(chars, lambda d: d == c)) / n
    return F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda s, c: s - share(c) * F.log2(share(c)))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1))


def language_of(path: Column) -> Column:
    return lookup(extension(path), fixed.LANGUAGES)


def in_skipped_folder(path: Column, folders: Iterable[str] = fixed.SKIP_FOLDERS) -> Column:
    return F.arrays_overlap(F.split(path, r"[/\\]"), F.array(*map(F.lit, folders)))


def first_match(rules: Iterable[tuple[Column, str]], default: str) -> Column:
    """First rule whose condition holds; null conditions don't hold."""
    out = None
    for cond, name in rules:
        out = F.when(cond, F.lit(name)) if out is None else out.when(cond, F.lit(name))
    return F.lit(default) if out is None else out.otherwise(F.lit(default))


def json_body(text: Column) -> Column:
    """The first JSON object or list inside a model's answer, null where there is none that parses.

    Think blocks and fences go, then brackets are matched from the first one on, but for those in strings.
    """
    bare = F.regexp_replace(F.regexp_replace(text, r"(?s)<think>.*?</think>", ""), r"```(?:json)?", "")
    body = F.regexp_extract(bare, r"(?s)([{\[].*)", 1)
    state = F.struct(*(F.lit(x).alias(n) for n, x in (("depth", 0), ("at", 0), ("end", 0), ("quoted", False), ("escaped", False))))

    def step(s: Column, c: Column) -> Column:
        free = ~s["quoted"]
        depth = s["depth"] + F.when(free & c.isin("{", "["), 1).when(free & c.isin("}", "]"), -1).otherwise(0)
        end = F.when((s["end"] == 0) & (s["depth"] == 1) & (depth == 0), s["at"] + 1).otherwise(s["end"])
        quoted = F.when((c == '"') & ~s["escaped"], free).otherwise(s["quoted"])
        return F.struct(depth.alias("depth"), (s["at"] + 1).alias("at"), end.alias("end"), quoted.alias("quoted"), (s["quoted"] & (c == "\\") & ~s["escaped"]).alias("escaped"))

    found = F.substring(body, F.lit(1), F.aggregate(F.split(body, ""), state, step, lambda s: s["end"]))
    return F.when(F.try_parse_json(found).isNotNull(), found)


def chunk_of(position: Column, size: int = 500) -> Column:
    return F.floor((position - 1) / size)


def tokens_of(text: Column) -> Column:
    """Tokens by the rule of four characters each."""
    return F.floor(F.length(text) / 4)


def hypotheses(tokens_per_second: Column) -> Column:
    """How many answers of 2048 tokens fit in three minutes, 1 to 10."""
    return F.least(F.lit(10), F.greatest(F.lit(1), F.floor(tokens_per_second * 180 / 2048)))
