"""Vulnerability records: enrichment, lookup, keyword and vector search, rankings."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from operator import and_, or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sentrel.functions import fixed


def enrich(records: DataFrame, scores: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Left joins: scores are null where missing, ``known`` becomes a 0/1 flag."""
    flag = known.select(key).distinct().withColumn("known_flag", F.lit(1))
    return records.join(scores, key, "left").join(flag, key, "left").withColumn("known_flag", F.coalesce("known_flag", F.lit(0)))


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The last write of each key wins; within a load, the last by ``seq``."""
    rows = old.withColumn("_l", F.lit(0)).unionByName(new.withColumn("_l", F.lit(1)))
    w = Window.partitionBy(key).orderBy(F.desc("_l"), F.desc("seq"))
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "_l")


def rank_score(known: Column, epss: Column, cvss: Column, exploit: Column) -> Column:
    zero = lambda c: F.coalesce(c, F.lit(0))
    return zero(known) * 1000 + zero(epss) * 500 + zero(cvss) * 5 + zero(exploit) * 100


def dependency_score(known: Column, epss: Column, cvss: Column) -> Column:
    zero = lambda c: F.coalesce(c, F.lit(0))
    return zero(known) * 10000 + zero(epss) * 1000 + zero(cvss)


def affects(ranges: Column, version: Column) -> Column:
    """Whether a record's affected versions mention a version; unknown on either side means no."""
    return F.coalesce((ranges != "") & (version != "") & ranges.contains(version), F.lit(False))


def _containing(names: DataFrame, packages: DataFrame, on: str, name: str, package: str) -> DataFrame:
    """(on, name, package): the distinct packages that contain a name of the same ``on``.

    Packages are cut into their substrings of the lengths that names have, so names meet them by equality.
    """
    names = names.where(F.col(name).isNotNull()).select(on, name).distinct()
    sizes = names.select(F.length(name).alias("_n")).distinct()  # a row per length
    cut = packages.select(on, package).distinct().crossJoin(F.broadcast(sizes)).where(F.length(package) >= F.col("_n"))
    cut = cut.withColumn("_at", F.explode(F.sequence(F.lit(1), F.length(package) - F.col("_n") + 1)))
    parts = cut.select(on, package, F.substring(F.col(package), F.col("_at"), F.col("_n")).alias(name)).distinct()
    return names.join(parts, [on, name])


def like_lookup(deps: DataFrame, records: DataFrame, on: str, name: str, package: str, order: Sequence, top: int, dep_id: str, version: tuple[str, str] | None = None) -> DataFrame:
    """Records of the same ``on`` whose package contains the dependency's name: the top ones per dependency.

    ``version`` names the records' affected versions and the dependency's version; a dependency that states one then only
    keeps records that mention it. ``order`` is of the records' columns. Records alike in what is asked of them fit the same
    dependencies, so only the top ones of each kind meet the kinds of dependencies, and those their dependencies.
    """
    ranges, own = version or (None, None)
    first = lambda rows, by: rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= top)
    best = first(records, [on, package, *([ranges] if version else [])]).drop("rank")
    asked = [on, name, *([own] if version else [])]
    hits = deps.select(*asked).distinct().join(_containing(deps, records, on, name, package), [on, name]).join(best, [on, package])
    if version:
        hits = hits.where(F.col(own).isNull() | affects(F.col(ranges), F.col(own)))
    hits = first(hits, asked).drop("rank").withColumnsRenamed({c: f"_{c}" for c in asked})
    same = reduce(and_, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in asked))
    return first(deps.join(hits, same).drop(*(f"_{c}" for c in asked)), [dep_id])


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda t: t != "")


def keyword_search(docs: DataFrame, ident: str, text: str | Sequence[str], query: Sequence[str], order: Sequence, limit: int) -> DataFrame:
    """Documents with all query tokens in their text columns; if none has, those with any token longer than one letter.

    Ranked, cut at ``limit``. A text without a word of the query as a substring is never taken apart.
    """
    words = [w.lower() for w in query]
    columns = [text] if isinstance(text, str) else list(text)
    whole = F.lower(F.concat_ws(" ", *columns))
    held = lambda some, combine: reduce(combine, (whole.contains(w) for w in some), F.lit(combine is and_))
    every = docs.where(held(words, and_)).where(F.size(F.array_except(F.array(*map(F.lit, words)), tokens(whole))) == 0) if words else docs.limit(0)
    any_of = [w for w in words if len(w) > 1]
    some = docs.where(held(any_of, or_)).where(F.arrays_overlap(tokens(whole), F.array(*map(F.lit, any_of)))) if any_of else docs.limit(0)
    # the fallback only counts when the conjunction has no row: one scalar decides, not a second search
    hit = every.limit(1).agg(F.count("*").alias("_all"))
    rows = every.withColumn("matched", F.lit("all")).unionByName(some.crossJoin(F.broadcast(hit)).where("_all = 0").drop("_all").withColumn("matched", F.lit("any")))
    return rows.orderBy(*order).limit(limit)


def filtered(found: DataFrame, score: Column, limit: int, ident: str = "id", min_epss: float | None = None, known_only: bool = False, tech: Sequence[str] = (), cwes: Sequence[str] = (), ecosystem: str | None = None) -> DataFrame:
    """Search results that pass the filters, ranked again and cut.

    found: (id, epss, known_flag, cpes, description, package, cwe_ids, ecosystem); only the columns of given filters are needed.
    """
    if min_epss is not None:
        found = found.where(F.coalesce("epss", F.lit(0.0)) >= min_epss)
    if known_only:
        found = found.where(F.col("known_flag") == 1)
    if tech:
        text = F.lower(F.concat_ws(" ", "cpes", "description", "package"))
        found = found.where(reduce(or_, (text.contains(t.lower()) for t in tech)))
    if cwes:
        found = found.where(F.coalesce(F.arrays_overlap("cwe_ids", F.array(*map(F.lit, cwes))), F.lit(False)))
    if ecosystem is not None:
        found = found.where(F.col("ecosystem") == ecosystem)
    return found.withColumn("score", score).orderBy(F.desc("score"), ident).limit(limit)


def inverted_index(docs: DataFrame, ident: str, text: str) -> DataFrame:
    """(token, id, tf) postings."""
    return docs.select(ident, F.explode(tokens(F.col(text))).alias("token")).groupBy("token", ident).agg(F.count("*").alias("tf"))


def index_search(index: DataFrame, ident: str, query: Sequence[str]) -> DataFrame:
    """Ids that have every token of the query, with the summed tf."""
    words = sorted({w.lower() for w in query})
    return index.where(F.col("token").isin(*words)).groupBy(ident).agg(F.countDistinct("token").alias("n"), F.sum("tf").alias("tf")).where(F.col("n") == len(words)).drop("n")


#: Vectors of a block.
BLOCK = 4096


def _blocks(rows: DataFrame, ident: str, vec: str, name: str) -> DataFrame:
    """(name_ids, name_rows): vectors dealt to blocks of about BLOCK."""
    n = max(1, -(-rows.count() // BLOCK))
    part = F.pmod(F.xxhash64(ident), F.lit(n))
    return rows.where(F.col(vec).isNotNull()).groupBy(part.alias("_part")).agg(F.collect_list(F.struct(F.col(ident).cast("long").alias("i"), F.col(vec).cast("array<double>").alias("v"))).alias("r")).select(F.transform("r", lambda x: x["i"]).alias(f"{name}_ids"), F.flatten(F.transform("r", lambda x: x["v"])).alias(f"{name}_rows"))


def semantic_topk(vectors: DataFrame, queries: DataFrame, k: int, least: float, ident: str, vec: str) -> DataFrame:
    """Per query the k most similar vectors by cosine, from ``least`` up. queries: (query_id, q), a stated set.

    Blocks of queries meet blocks of vectors, so what meets is matrices of a bounded size, however many queries there are. A
    meeting is one matrix product and gives the k best of each query; a query's best come from those.
    """
    met = _blocks(vectors, ident, vec, "v").crossJoin(_blocks(queries, "query_id", "q", "q"))

    def unit(rows: pa.Array, n: int) -> np.ndarray:
        m = rows.to_numpy(zero_copy_only=False).reshape(n, -1)
        norm = np.sqrt((m * m).sum(axis=1, keepdims=True))
        return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in range(b.num_rows):
                vid, qid = (b.column(f"{c}_ids")[row].values.to_numpy() for c in "vq")
                v, q = (unit(b.column(f"{c}_rows")[row].values, len(i)) for c, i in (("v", vid), ("q", qid)))
                by_id = np.argsort(vid, kind="stable")
                for left in range(0, len(qid), 512):
                    s = np.round(q[left : left + 512] @ v[by_id].T, 6)
                    order = np.argsort(-s, axis=1, kind="stable")[:, :k]  # ties go to the lower id
                    best = np.take_along_axis(s, order, axis=1)
                    i, j = np.nonzero(best >= least)
                    yield pa.RecordBatch.from_arrays([pa.array(qid[left + i]), pa.array(vid[by_id][order[i, j]]), pa.array(best[i, j])], names=["query_id", ident, "similarity"])

    rows = met.mapInArrow(run, f"query_id long, {ident} long, similarity double")
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), ident)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", ident, "similarity", "rank")


def class_catalogue(records: DataFrame, classes: DataFrame, key: str, cls: str, good: Column, fallback: Column, order: Sequence, top: int) -> DataFrame:
    """Per class the top records that meet ``good``; a class without any takes those that meet ``fallback``.

    Classes of a key share its records, so the top ones are taken per key first and only those meet the classes.
    """
    def best(rows: DataFrame) -> DataFrame:
        return rows.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("_r") <= top).drop("_r")

    main, rest = best(records.where(good)), best(records.where(fallback))
    rest = rest.join(main.select(key).distinct(), key, "left_anti")
    both = classes.join(main.withColumn("how", F.lit("main")).unionByName(rest.withColumn("how", F.lit("fallback"))), key)
    return both.withColumn("rank", F.row_number().over(Window.partitionBy(cls).orderBy(*order))).where(F.col("rank") <= top)


def cwe_classes(spark, table: dict[str, list[str]] | None = None) -> DataFrame:
    """(cls, cwe): the exploit classes and the CWE ids that make a record one of theirs."""
    return spark.createDataFrame([(c, w) for c, ws in (table or fixed.CLASS_CWES).items() for w in ws], "cls string, cwe string")


def keyword_list(words: Column, n: int = 8) -> Column:
    return F.slice(F.array_distinct(words), 1, n)


def statistics(records: DataFrame) -> DataFrame:
    """One pass of conditional counts over (id, epss, known_flag, cvss, exploit)."""
    return records.agg(F.count("*").alias("total"), F.count_if(F.col("known_flag") == 1).alias("known"), F.count_if(F.col("epss").isNotNull()).alias("scored"), F.count_if(F.col("cvss") >= 9).alias("critical"), F.count_if(F.col("exploit") == 1).alias("exploited"))


def context_for(paths: DataFrame, records: DataFrame, path_id: str, cwe: str, category: str, score: str, top: int = 3) -> DataFrame:
    """Per path the top records by ``score`` that share its CWE id; a path without any takes those of its category.

    records: (id, cwe_ids array, category, score). CWE ids meet by equality after an explode, not by substring. Only the top
    records of a CWE id or a category meet paths, as no others can be among those of a path.
    """
    first = lambda rows, by: rows.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(score), "id"))).where(F.col("rank") <= top)
    own = first(records.select("id", score, F.explode(F.array_distinct("cwe_ids")).alias(cwe)), cwe).drop("rank")
    by_cwe = paths.select(path_id, cwe).join(own, cwe).withColumn("how", F.lit("cwe"))
    lost = paths.select(path_id, category).join(by_cwe.select(path_id).distinct(), path_id, "left_anti")
    by_class = lost.join(first(records.select("id", score, category), category).drop("rank"), category).withColumn("how", F.lit("category"))
    rows = by_cwe.select(path_id, "id", "how", score).unionByName(by_class.select(path_id, "id", "how", score))
    return first(rows, path_id)


def top_list(records: DataFrame, keep: Column, order: Sequence, limit: int) -> DataFrame:
    return records.where(keep).orderBy(*order).limit(limit)
