"""Manifests and vulnerability feeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sentrel.operators.paths import keep_first

#: Manifest names and the ecosystem of each.
MANIFESTS = {"requirements": "pypi", "pyproject.toml": "pypi", "package.json": "npm", "pom.xml": "maven", "Cargo.toml": "cargo", "go.mod": "go", "Gemfile": "rubygems", "packages.config": "nuget"}
_EMPTY = "array<struct<name:string,version:string>>"


def _pairs(text: Column, pattern: str, name: int = 1, version: int = 2) -> Column:
    found = F.regexp_extract_all(text, F.lit(pattern), 0)
    return F.transform(found, lambda m: F.struct(F.regexp_extract(m, pattern, name).alias("name"), F.nullif(F.regexp_extract(m, pattern, version), F.lit("")).alias("version")))


def dependencies(files: DataFrame) -> DataFrame:
    """(ecosystem, name, version, file) of manifests (path, content); a triple keeps its first file."""
    body, name = F.col("content"), F.element_at(F.split("path", "/"), -1)
    bare = F.regexp_replace(body, r"(?m)#[^\n]*$", "")
    npm = F.from_json(body, "dependencies MAP<STRING,STRING>, devDependencies MAP<STRING,STRING>, peerDependencies MAP<STRING,STRING>")
    entries = lambda m: F.coalesce(F.transform(F.map_entries(m), lambda e: F.struct(e["key"].alias("name"), e["value"].alias("version"))), F.array().cast(_EMPTY))
    section = F.regexp_extract(body, r"(?s)\[(?:dev-)?dependencies\](.*?)(?:\n\[|\z)", 1)
    pyproject = F.regexp_extract(body, r"(?s)dependencies\s*=\s*\[(.*?)\n?\]", 1)
    kinds = [
        (name.rlike(r"^requirements.*\.(txt|in)$"), "pypi", _pairs(bare, r"(?m)^\s*([A-Za-z0-9][\w.-]*)(?:\[[^\]]*\])?\s*(?:[=~<>!]=?\s*([\w.*]+))?")),
        (name == "pyproject.toml", "pypi", _pairs(pyproject, r"[\"']([A-Za-z0-9][\w.-]*)(?:\[[^\]]*\])?\s*(?:[=~<>!]=?\s*([\w.*]+))?[^\"']*[\"']")),
        (name == "package.json", "npm", F.concat(entries(npm["dependencies"]), entries(npm["devDependencies"]), entries(npm["peerDependencies"]))),
        (name == "pom.xml", "maven", _pairs(body, r"(?s)<dependency>\s*<groupId>[^<]*</groupId>\s*<artifactId>([^<]+)</artifactId>(?:\s*<version>([^<]+)</version>)?")),
        (name == "Cargo.toml", "cargo", _pairs(section, r"(?m)^\s*([\w-]+)\s*=\s*(?:\{[^}\n]*version\s*=\s*)?\"?([^\"\n{}]*)\"?")),
        (name == "go.mod", "go", _pairs(body, r"(?m)^\s*(?:require\s+)?([\w.-]+\.[\w./-]+)\s+(v[\w.+-]+)")),
        (name == "Gemfile", "rubygems", _pairs(bare, r"(?m)^\s*gem\s+['\"]([\w-]+)['\"](?:\s*,\s*['\"][~<>= ]*([\w.]+)['\"])?")),
        (name == "packages.config", "nuget", _pairs(body, r"<package\s+id=\"([^\"]+)\"\s+version=\"([^\"]+)\""))]
    deps = eco = None
    for cond, e, pairs in kinds:
        deps = F.when(cond, pairs) if deps is None else deps.when(cond, pairs)
        eco = F.when(cond, F.lit(e)) if eco is None else eco.when(cond, F.lit(e))
    rows = files.select(eco.alias("ecosystem"), F.col("path").alias("file"), F.explode(deps).alias("d")).select("ecosystem", F.lower(F.trim("d.name")).alias("name"), F.trim("d.version").alias("version"), "file")
    return keep_first(rows, ["ecosystem", "name", "version"], ["file"])


_CVSS = "ARRAY<STRUCT<cvssData: STRUCT<baseScore: DOUBLE, baseSeverity: STRING>>>"
CVE_SCHEMA = f"""vulnerabilities ARRAY<STRUCT<cve: STRUCT<id: STRING, published: STRING, lastModified: STRING, descriptions: ARRAY<STRUCT<lang: STRING, value: STRING>>,
  metrics: STRUCT<cvssMetricV40: {_CVSS}, cvssMetricV31: {_CVSS}, cvssMetricV30: {_CVSS}, cvssMetricV2: {_CVSS}>, weaknesses: ARRAY<STRUCT<description: ARRAY<STRUCT<value: STRING>>>>,
  configurations: ARRAY<STRUCT<nodes: ARRAY<STRUCT<cpeMatch: ARRAY<STRUCT<criteria: STRING>>>>>>>>>"""


def cve_pages(spark: SparkSession, path: str) -> DataFrame:
    """Vulnerability records of JSON pages: the newest CVSS version, English text, CWE ids, the first 50 CPEs, the package of the first."""
    c = spark.read.schema(CVE_SCHEMA).json(path, multiLine=True).select(F.explode("vulnerabilities").alias("v")).select("v.cve.*")
    first = lambda k, f: F.get(F.col(f"metrics.{k}"), F.lit(0))["cvssData"][f]
    versions = ("cvssMetricV40", "cvssMetricV31", "cvssMetricV30", "cvssMetricV2")
    text = F.coalesce(F.get(F.filter("descriptions", lambda d: d["lang"] == "en"), F.lit(0))["value"], F.get("descriptions", F.lit(0))["value"], F.lit(""))
    cwes = F.filter(F.array_distinct(F.flatten(F.transform("weaknesses", lambda w: F.transform(w["description"], lambda d: d["value"])))), lambda x: x.startswith("CWE-"))
    cpes = F.flatten(F.transform(F.flatten(F.transform("configurations", lambda g: g["nodes"])), lambda n: F.transform(n["cpeMatch"], lambda m: m["criteria"])))
    product = F.split(F.get(cpes, F.lit(0)), ":")
    return c.select(
        "id", text.alias("description"), F.coalesce(*(first(v, "baseScore") for v in versions)).alias("cvss"), F.coalesce(*(first(v, "baseSeverity") for v in versions)).alias("severity"),
        F.coalesce(cwes, F.array().cast("array<string>")).alias("cwe_ids"), F.array_join(F.slice(F.coalesce(cpes, F.array().cast("array<string>")), 1, 50), ", ").alias("cpes"), F.get(product, F.lit(4)).alias("package"), F.col("published").alias("published"))


def epss_scores(spark: SparkSession, path: str) -> DataFrame:
    """(id, epss, percentile) of a CSV; rows that don't parse go."""
    rows = spark.read.schema("cve STRING, epss STRING, percentile STRING").csv(path, header=True, comment="#")
    out = rows.select(F.col("cve").alias("id"), F.expr("try_cast(epss AS DOUBLE)").alias("epss"), F.expr("try_cast(percentile AS DOUBLE)").alias("percentile"))
    return out.where("epss IS NOT NULL AND percentile IS NOT NULL")


def known_exploited(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("vulnerabilities ARRAY<STRUCT<cveID: STRING>>").json(path, multiLine=True).select(F.explode("vulnerabilities.cveID").alias("id")).distinct()


def scanner_findings(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a static scanner's JSON report."""
    schema = "results ARRAY<STRUCT<check_id: STRING, path: STRING, start: STRUCT<line: INT, col: INT>, `end`: STRUCT<line: INT, col: INT>, extra: STRUCT<message: STRING, severity: STRING, metadata: STRING>>>"
    r = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("results").alias("r"))
    return r.select(F.col("r.check_id").alias("rule_id"), F.col("r.path").alias("file"), F.col("r.start.line").alias("line"), F.col("r.start.col").alias("column"), F.col("r.end.line").alias("end_line"), F.col("r.extra.message").alias("message"), F.upper("r.extra.severity").alias("severity"))


def resumed(spark: SparkSession, candidates: DataFrame, done_path: str, key: str) -> DataFrame:
    """Candidates without a row in the checkpoint; lines that don't parse are ignored."""
    done = spark.read.schema(f"{key} STRING").option("mode", "PERMISSIVE").json(done_path).where(F.col(key).isNotNull()).distinct()
    return candidates.join(done, key, "left_anti")


def markdown(title: str, sections: dict[str, DataFrame], rows: int = 50) -> str:
    """A report of the first rows of each section; sections are small results."""
    out = [f"# {title}"]
    for name, df in sections.items():
        head = df.limit(rows).collect()
        out += ["", f"## {name}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
        out += ["| " + " | ".join("" if v is None else str(v).replace("|", "\\|") for v in r) + " |" for r in head]
    return "\n".join(out) + "\n"
