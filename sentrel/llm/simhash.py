"""SimHash near-duplicates: 64-bit fingerprints that differ in at most three bits are linked.

Candidate search is a byte-position inverted index with count filtering. A fingerprint has eight positional bytes;
three differing bits touch at most three of them, so a linked pair shares at least five positions. The index lists
fingerprints by position and byte. A list is split by the byte of a second position, and five shared positions always
hold one of the couples (0, 1), (2, 3), (4, 5), (6, 7), so four lists a fingerprint miss no pair. Within a list the
shared positions of every pair are tallied; pairs that reach five are retained and verified by their Hamming distance.

A list of more than ``LONG`` members is split by further bytes, each time by as many positions as the pairs of the list need
to meet, and once five positions agree by groups of the other bits, four of them, as three differing bits leave
one alone. So every list ends up short, whatever its first byte has in common, no list is ever held by one task
in full, and the work of a fingerprint does not grow with the square of a group. A list yields a spanning forest of
its links, at most one row a member. Equal fingerprints are one member, so copies of any number cost one entry.

Defined cases: null and wordless texts have fingerprint zero and are linked like any other; rows that
repeat a doc_id each get a row; a null doc_id has its fingerprint, and a component of documents without ids
only has a null id; empty tables give empty results; other columns are ignored whatever their names.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentrel.llm.common import lean, materialize, pick, release
from sentrel.llm.components import components

SHINGLE = 3
SEED = 42
BITS = 3
BYTES = 8
SHARED = BYTES - BITS
#: Bits that a list leaves free at least; members up to which a list's pairs are tallied. Longer lists are split.
FREE = 10
LONG = 1 << FREE
#: Members whose pairs are held at a time.
HELD = 1 << 13
#: Shingle hashes whose bits are counted at a time.
SLICE = 1 << 15
_LIST = "key long, mask long, fp long"
_U = np.uint64


def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    """The fingerprint of one text; a bit is set if more than half of the shingle hashes set it."""
    words = text.lower().split()  # bytes: A-Z only, and the six ASCII spaces
    n = len(words)
    if not n:
        return 0
    parts = [b" ".join(words)] if n < size else map(b" ".join, zip(*(words[i:] for i in range(size))))
    total, count = np.zeros(64, np.int64), max(n - size + 1, 1)
    hashes = map(xxhash.xxh64_intdigest, parts, itertools.repeat(SEED))
    for left in range(0, count, SLICE):
        h = np.fromiter(hashes if count - left <= SLICE else itertools.islice(hashes, SLICE), dtype="<u8")
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > count, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long."""
    src = pick(docs, "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").cast(pa.large_binary()).to_pylist()
            fps = np.fromiter((fingerprint(t or b"", size) for t in texts), dtype=np.uint64, count=len(texts))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return src.mapInArrow(lean(run), f"doc_id {src.schema['doc_id'].dataType.simpleString()}, fp long")


def _byte(p: int) -> int:
    return 0xFF << 8 * p


#: Bits that members of a first list agree in: a position's byte and the next one's.
FIRST = [_byte(p) | _byte(p + 1) for p in range(0, BYTES, 2)]


@lru_cache(None)
def split(mask: int) -> list[int]:
    """The masks that split the list of a mask; every linked pair of the list agrees in one of them at least."""
    left = [p for p in range(BYTES) if mask & _byte(p) != _byte(p)]
    need = SHARED - (BYTES - len(left))
    if need > 0:
        return [mask | _byte(p) for p in left[: len(left) - need + 1]]
    free = [b for b in range(64) if not mask >> b & 1]
    return [mask | sum(1 << b for b in free[k :: BITS + 1]) for k in range(BITS + 1)]


def _keys(mask: int, fp: np.ndarray) -> np.ndarray:
    """A list's key from the bits that its members agree in."""
    x = (fp & _U(mask)) ^ _U(mask * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return (x ^ (x >> _U(32))).view(np.int64)


def _posted(masks: list[int], fp: np.ndarray) -> pa.RecordBatch:
    key = np.concatenate([_keys(m, fp) for m in masks])
    mask = np.repeat(np.array(masks, np.uint64).view(np.int64), len(fp))
    return pa.RecordBatch.from_arrays([pa.array(key), pa.array(mask), pa.array(np.tile(fp.view(np.int64), len(masks)))], names=["key", "mask", "fp"])


def _fps(b: pa.RecordBatch) -> np.ndarray:
    return b.column("fp").to_numpy().view(np.uint64)


def _first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fingerprints under their first lists."""
    for b in batches:
        yield _posted(FIRST, _fps(b))


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members of long lists under the lists that these are split into."""
    for b in batches:
        mask, fp = b.column("mask").to_numpy(), _fps(b)
        for m in np.unique(mask):
            yield _posted(split(int(m) & (1 << 64) - 1), fp[mask == m])


def pairs(key: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows (i, j) of linked pairs; rows are sorted by key, and a key is a list."""
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    size = np.diff(np.r_[start, len(key)])
    last = np.repeat(start + size, size)  # the end of each row's list
    at, found = np.arange(len(key)), []
    for apart in range(1, int(size.max(initial=1))):
        at = at[at + apart < last[at]]
        differ = fp[at] ^ fp[at + apart]
        tally = (differ.view(np.uint8).reshape(-1, BYTES) == 0).sum(axis=1)
        kept = tally >= SHARED
        near = np.flatnonzero(kept)[np.bitwise_count(differ[kept]) <= BITS]
        found.append(np.stack([at[near], at[near] + apart]))
    i, j = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
    return i, j


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least row that each of n rows reaches over the links (i, j)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spanning forests of the lists' links; the rows come sorted by key, and few lists are held at a time."""

    def emit(key: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        label = forest(len(fp), *pairs(key, fp))
        own = np.flatnonzero(label != np.arange(len(fp)))
        if len(own):
            yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (fp[own], fp[label[own]])], names=["a", "b"])

    keys, fps = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    for b in batches:
        keys, fps = np.concatenate([keys, b.column("key").to_numpy()]), np.concatenate([fps, _fps(b)])
        while len(keys) > HELD:
            cut = int(np.searchsorted(keys, keys[HELD]))  # lists before this row are complete
            cut = cut or int(np.searchsorted(keys, keys[0], "right"))
            if cut == len(keys):
                break
            yield from emit(keys[:cut], fps[:cut])
            keys, fps = keys[cut:], fps[cut:]
    if len(keys):
        yield from emit(keys, fps)


def links(fps: DataFrame, long: int = LONG) -> DataFrame:
    """(a, b): spanning links between distinct fingerprints (fp) at most three bits apart."""
    lists, found = fps.select("fp").mapInArrow(_first, _LIST), []
    while lists is not None:
        # keys are counted before the shuffle, so the members of a long list never meet in a task
        many = lists.groupBy("key").agg(F.count("*").alias("n"), F.min("mask").alias("mask")).where((F.col("n") > long) & (F.bit_count("mask") < 64 - FREE))
        many = materialize(many.select("key"), "long-lists")
        more = not many.isEmpty()
        short = lists.join(many, "key", "left_anti") if more else lists
        found.append(materialize(short.select("key", "fp").repartition("key").sortWithinPartitions("key").mapInArrow(_tally, "a long, b long"), "simhash-links"))
        rest = materialize(lists.join(many, "key", "left_semi").select("mask", "fp").mapInArrow(_split, _LIST), "split-lists") if more else None
        release(lists, many)
        lists = rest
    return reduce(DataFrame.unionByName, found).distinct()


def near_duplicates(docs: DataFrame, size: int = SHINGLE, long: int = LONG) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row; component_id is the least doc_id reachable."""
    fps = materialize(fingerprints(docs, size), "fingerprints")
    first = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct-fingerprints")
    roots = components(links(first, long), "simhash").select(F.col("node").alias("fp"), "root")
    placed = first.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    named = placed.join(least, "root").select("fp", "component_id")
    return fps.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their fingerprints and components."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op1_simhash": op1_simhash}
ORACLES: dict[str, str] = {}
