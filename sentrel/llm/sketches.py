"""Document fingerprints: threshold-scaled sketches of five-word shingles.

A sketch keeps every shingle hash below a fixed fraction of the hash space, whatever the text's length. So sketches of
documents of very unequal length are comparable, and the sketch of several documents together is the union of theirs.
A fingerprint is the 64-bit digest of the text's words and the 32 leading bits of each hash that is kept; the digest tells
texts apart whose sketches are empty, as those of texts of a few words often are. Likeness is the estimated Jaccard
similarity, containment the share of one sketch that the other has; texts of equal words are alike in full.

The query pairs every document with the next one by (doc_id, hash of the text). Texts are shuffled once, into ranges of that
order; the first document of a range also goes to the range before, so each range is finished by itself and holds one
document at a time. The bounds are quantiles, as many as there are shuffle partitions, and a doc_id of more than one
quantile is cut by the hash of the text. Every range is dealt to a partition of its own.

Defined cases: null is the empty text; two sketches that are empty are unlike unless the digests agree; null ids come
first; a lone document is its own next one; rows that are equal follow each other; empty tables give empty results;
other columns are ignored whatever their names.
"""

from __future__ import annotations

import hashlib
import itertools
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sentrel.llm.common import pick

SHINGLE = 5
SEED = 42
#: One hash in so many is kept, a power of two.
SCALE = 8
LIMIT = (1 << 64) // SCALE
#: Lower bits of a kept hash that are dropped, so that 32 are left.
_DROP = np.uint64(LIMIT.bit_length() - 1 - 32)
#: Least (doc_id, hash) there is.
FLOOR = -(1 << 63)

Sketch = tuple[int, np.ndarray]


def sketch(text: str) -> Sketch:
    """(digest, kept): kept are the leading 32 bits of the shingle hashes below the limit, sorted and distinct."""
    words = text.encode(errors="replace").lower().split()
    if not words:
        return 0, np.zeros(0, np.uint32)
    parts = [b" ".join(words)] if len(words) < SHINGLE else map(b" ".join, zip(*(words[i:] for i in range(SHINGLE))))
    h = np.fromiter(map(xxhash.xxh64_intdigest, parts, itertools.repeat(SEED)), dtype=np.uint64)
    return xxhash.xxh64_intdigest(b" ".join(words), SEED), np.unique((h[h < np.uint64(LIMIT)] >> _DROP).astype(np.uint32))


def merge(a: Sketch, b: Sketch) -> Sketch:
    """The sketch of both documents together; its digest stands for the two digests, in either order."""
    return (a[0] if a[0] == b[0] else (a[0] + b[0]) % (1 << 64)), np.union1d(a[1], b[1])


def _common(a: Sketch, b: Sketch) -> int:
    return len(np.intersect1d(a[1], b[1], assume_unique=True))


def likeness(a: Sketch, b: Sketch) -> float:
    """Estimated Jaccard similarity."""
    if a[0] == b[0]:
        return 1.0
    both = _common(a, b)
    every = len(a[1]) + len(b[1]) - both
    return both / every if every else 0.0


def containment(a: Sketch, b: Sketch) -> float:
    """Estimated share of a's shingles that b has."""
    if a[0] == b[0]:
        return 1.0
    return _common(a, b) / len(a[1]) if len(a[1]) else 0.0


def to_text(s: Sketch) -> str:
    """Sixteen hex digits of the digest, then eight a hash."""
    return f"{s[0]:016x}{s[1].astype('>u4').tobytes().hex()}"


def from_text(s: str) -> Sketch:
    return int(s[:16], 16), np.frombuffer(bytes.fromhex(s[16:]), ">u4").astype(np.uint32)


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint) of every row."""
    src = pick(docs, "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([to_text(sketch(x.as_py() or "")) for x in b.column("text")], pa.string())], names=["doc_id", "fingerprint"])

    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, fingerprint string")


def _bounds(docs: DataFrame, n: int) -> list[tuple[int, int]]:
    """About n lower bounds (sid, tag) of ranges; an id that holds several quantiles is cut evenly by the tag."""
    qs = docs.approxQuantile("sid", [k / n for k in range(1, n)], 0.25 / n) if n > 1 else []
    out = []
    for sid, k in sorted(Counter(int(q) for q in qs).items()):
        out += [(sid, FLOOR + ((i << 64) // k)) for i in range(k)]
    return out


def _range_of(bounds: list[tuple[int, int]]) -> Column:
    """The number of bounds up to (sid, tag): first among groups of about their root, then within one."""
    step = max(1, int(len(bounds) ** 0.5))
    groups = [bounds[i : i + step] for i in range(0, len(bounds), step)] or [[]]
    here = F.struct(F.col("sid").alias("a"), F.col("tag").alias("b"))

    def array(xs: list[tuple[int, int]]) -> Column:
        kind = "array<struct<a:bigint,b:bigint>>"
        return F.array(*(F.struct(F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b")) for a, b in xs)).cast(kind) if xs else F.array().cast(kind)

    g = F.size(F.filter(array([x[0] for x in groups[1:]]), lambda x: x <= here))
    return (g * step + F.size(F.filter(F.get(F.array(*map(array, groups)), g), lambda x: x <= here))).cast("int")


def _spread(spark: SparkSession, ranges: int, n: int) -> list[int]:
    """A number for each range whose hash deals it to a partition of its own, as far as there are any."""
    room = -(-ranges // n)
    tried = spark.range(64 * max(ranges, n)).select(F.pmod(F.hash(F.col("id").cast("int")), F.lit(n)).alias("p"), F.col("id").cast("int").alias("k"))
    own = tried.groupBy("p").agg(F.slice(F.array_sort(F.collect_list("k")), 1, room).alias("ks")).orderBy("p").collect()  # n rows
    found = [k for turn in range(room) for r in own for k in r["ks"][turn : turn + 1]]
    return found[:ranges] if len(found) >= ranges else list(range(ranges))


_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, held_edited double"


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (range, guest, sid, tag): every own row is compared with the row after it."""
    names = [x.split()[0] for x in _OUT.split(", ")]
    rows: list[tuple] = []
    held = None  # (doc_id, text, sketch) that waits for the next row

    def finish(doc_id, text: str, s: Sketch, after: str, t: Sketch) -> None:
        m = len(text) // 4
        edited = text[: len(text) - m] + after[:m]
        e = sketch(edited) if m else s
        rows.append((doc_id, len(text), hashlib.sha256(edited.encode(errors="replace")).hexdigest(), to_text(s), to_text(e), likeness(s, e), likeness(s, t), containment(s, e)))

    for b in batches:
        for guest, doc_id, text in zip(b.column("guest"), b.column("doc_id"), b.column("text")):
            guest, text = guest.as_py(), text.as_py()
            if guest and held is None:
                continue  # further rows like the guest
            s = sketch(text)
            if held is not None:
                finish(*held, text, s)
            held = None if guest else (doc_id.as_py(), text, s)
            if len(rows) >= 256:
                yield pa.RecordBatch.from_pylist([dict(zip(names, x)) for x in rows])
                rows.clear()
    if rows:
        yield pa.RecordBatch.from_pylist([dict(zip(names, x)) for x in rows])


def compare_with_next(docs: DataFrame) -> DataFrame:
    """Sketch every text and its edited text, whose last quarter comes from the next document."""
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    src = pick(docs, "doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(FLOOR).cast("long")).alias("sid"))
    bounds = _bounds(src.select("sid"), n)
    ranged = src.withColumn("tag", F.xxhash64("text")).withColumn("r", _range_of(bounds))
    # the first row of each range: a row per range, and ids only
    firsts = sorted((x["r"], x["f"]["sid"], x["f"]["tag"]) for x in ranged.groupBy("r").agg(F.min(F.struct("sid", "tag")).alias("f")).collect())
    before = [(sid, tag, firsts[k - 1][0]) for k, (_, sid, tag) in enumerate(firsts)]  # the first range comes after the last
    guests = spark.createDataFrame(before, "sid long, tag long, at int")
    own = ranged.select("r", F.lit(False).alias("guest"), "sid", "tag", "doc_id", "text")
    also = own.join(F.broadcast(guests), ["sid", "tag"]).select(F.col("at").alias("r"), F.lit(True).alias("guest"), "sid", "tag", "doc_id", "text")
    to = F.get(F.array(*map(F.lit, _spread(spark, len(bounds) + 1, n))), F.col("r"))
    dealt = own.unionByName(also).withColumn("to", to).repartition(n, F.col("to")).sortWithinPartitions("r", "guest", "sid", "tag", "text")
    return dealt.select("r", "guest", F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_compare, _OUT)


def op6_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against their edited text and the next document."""
    return compare_with_next(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op6_sketches": op6_sketches}
ORACLES: dict[str, str] = {}
