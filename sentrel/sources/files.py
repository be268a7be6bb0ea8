"""Source trees as DataFrames: one scan, filtered by path and size before content is decoded."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentrel.functions import fixed
from sentrel.functions.expressions import first_match, in_skipped_folder, language_of, lookup


#: Folders of tests, compared without case.
TEST_FOLDERS = ("test", "tests", "__tests__", "spec", "fixtures")


def scan(spark: SparkSession, root: str, extensions: Iterable[str] = fixed.LANGUAGES, max_bytes: int = 5 << 20, skip_tests: bool = False, skip_hidden: bool = False, ignore: Iterable[str] = ()) -> DataFrame:
    """(path, language, size, content) of the files with known extensions; paths are relative to ``root``.

    The length filter is pushed into the scan, so larger files are listed but never read. Bytes that are no UTF-8 become
    replacement characters. ``skip_hidden`` leaves out paths with a part that begins with a dot, ``ignore`` those that end in
    one of some suffixes.
    """
    names = "{" + ",".join(f"*{e}" for e in sorted(extensions)) + "}"
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", names).load(root).where(F.col("length") < max_bytes)
    base = root.split("://", 1)[-1].rstrip("/")
    path = F.regexp_replace(F.expr(f"substring(path, instr(path, '{base}') + {len(base) + 1})"), r"\\", "/")
    rows = raw.select(path.alias("path"), F.col("length").alias("size"), F.col("content").alias("raw")).where(~in_skipped_folder(F.col("path")))
    if skip_tests:
        rows = rows.where(~F.arrays_overlap(F.split(F.lower("path"), "/"), F.array(*map(F.lit, TEST_FOLDERS))))
    if skip_hidden:
        rows = rows.where(~F.col("path").rlike(r"(^|/)\.[^/]"))
    for suffix in ignore:
        rows = rows.where(~F.col("path").endswith(suffix))
    return rows.select("path", language_of(F.col("path")).alias("language"), "size", F.make_valid_utf8(F.col("raw").cast("string")).alias("content"))


def lines_of(files: DataFrame) -> DataFrame:
    """(file, language, line, content)."""
    return files.select(F.col("path").alias("file"), "language", F.posexplode(F.split("content", "\r?\n", -1)).alias("line", "content")).withColumn("line", F.col("line") + 1)


def inventory(files: DataFrame) -> DataFrame:
    return files.groupBy("language").agg(F.count("*").alias("n_files"), F.sum("size").alias("bytes"))


#: Layouts by the folders that suggest them, in the order in which they are tried.
LAYOUTS = {"microservices": ("services", "microservices"), "kernel": ("drivers", "kernel"), "mvc": ("controllers", "views", "models"), "api": ("api", "routes"), "cli": ("cmd", "cli"), "library": ("src", "lib")}


def architecture(files: DataFrame) -> DataFrame:
    """One row: the layout that the folders suggest, the languages, the primary one."""
    # a flag per layout and language is all that is gathered, however many folders there are
    parts = F.split("path", "/")
    flags = {k: F.max(F.arrays_overlap(parts, F.array(*map(F.lit, names)))).alias(k) for k, names in LAYOUTS.items()}
    by = files.groupBy("language").agg(F.count("*").alias("n"), *flags.values())
    one = by.agg(F.array_sort(F.collect_list("language")).alias("languages"), F.max_by("language", F.struct("n", "language")).alias("primary"), *(F.max(k).alias(k) for k in LAYOUTS))
    return one.select(first_match([(F.col(k), k) for k in LAYOUTS], "flat").alias("architecture"), "languages", "primary")


#: Words in manifests that name a framework.
FRAMEWORKS = {"django": "Django", "flask": "Flask", "fastapi": "FastAPI", "express": "Express", "react": "React", "vue": "Vue", "spring": "Spring", "rails": "Rails", "laravel": "Laravel", "gin-gonic": "Gin", "actix": "Actix", "next": "Next.js", "torch": "PyTorch", "tensorflow": "TensorFlow"}
#: Build files and the build tool of each.
BUILDS = {"pom.xml": "maven", "build.gradle": "gradle", "package.json": "npm", "Cargo.toml": "cargo", "go.mod": "go", "CMakeLists.txt": "cmake", "Makefile": "make", "setup.py": "setuptools", "pyproject.toml": "pyproject", "Gemfile": "bundler", "composer.json": "composer", "Dockerfile": "docker"}


def frameworks(files: DataFrame) -> DataFrame:
    """(kind, name, file): frameworks named in the first 16 KB of manifests, and build tools by file name."""
    name = F.element_at(F.split("path", "/"), -1)
    manifests = files.where(name.isin(*BUILDS) | name.rlike(r"^requirements.*\.txt$"))
    head = F.lower(F.substring("content", 1, 16384))
    found = F.filter(F.array(*(F.when(head.contains(k), F.lit(v)) for k, v in FRAMEWORKS.items())), lambda x: x.isNotNull())
    hits = manifests.select(F.lit("framework").alias("kind"), F.explode(found).alias("name"), F.col("path").alias("file"))
    return hits.unionByName(files.where(name.isin(*BUILDS)).select(F.lit("build").alias("kind"), lookup(name, BUILDS).alias("name"), F.col("path").alias("file"))).distinct()


def evaluation_cases(files: DataFrame, vulnerable: str) -> DataFrame:
    """(file, language, has_vulnerability) of a corpus whose vulnerable files match a pattern."""
    return files.select(F.col("path").alias("file"), "language", F.col("path").rlike(vulnerable).alias("has_vulnerability"))


def commit_cases(spark: SparkSession, path: str) -> DataFrame:
    """(cve_id, repo_url, vulnerable_commit, language, source) of a CSV of fixing commits, one row per case."""
    rows = spark.read.option("header", "true").csv(path)
    return rows.select("cve_id", "repo_url", F.col("commit_hash").alias("vulnerable_commit"), F.col("lang").alias("language"), F.lit("commits").alias("source")).distinct()
