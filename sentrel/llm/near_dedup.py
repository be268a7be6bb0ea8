"""SimHash near-dedup's stage form: weighted votes, and links by verified similarity of five-word shingle sets.

Fingerprints of plain votes cannot reach a similarity of 0.8: such a pair differs in about ten of 64 bits, more than a byte
index can bound (figures in the README). So each of the ``POSITIONS`` bytes of the fingerprint has a vote of its own, in
which a shingle weighs u**-4, u being its hash under the position's mixing, from 0 to 1; a bit is set if the shingles that set
it outweigh those that don't. The votes that two texts share then carry most bytes: at a similarity s they agree in a
position with probability ``KEPT`` * s or more (simulated for 9 to 1,800 shingles; plain votes: 0.27 at 0.8).
The index is the same: lists by positions, ``ROWS`` of them to a list, a tally of the shared positions of the pairs
that meet, and a verification, here of the exact sets. A pair at 0.8 shares one of ``LISTS`` lists with probability
1 - (1 - (KEPT * 0.8)**ROWS)**LISTS, 0.99996.

Equal texts are one node, so copies of any number cost one entry. The members of a list are first held against four of
them, which settles small lists and joins the bulk of a large group. Where that leaves several components, the list is
settled in one place: all pairs of different ones are tallied, those that share fewer positions than a pair at the
threshold does but once in 100,000 times are left out, and the others are verified, the most alike first, unless their
components have met by then. So a list gives fewer links than it has members, and no pairs are written. A list of more
than ``LONG`` members is split by further positions first, ``SPLITS`` ways, one of which a pair at 0.8 shares with
probability 0.999. No pair is left out for the size of its group.

Defined cases: texts of fewer words than a shingle are one shingle; null and wordless texts are alike; rows that repeat
a doc_id each get a row; a component of documents without ids only has a null id; of rows that are equal in doc_id and
text one stays; empty tables give empty results; other columns are kept as they are, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentrel.llm.common import fresh, lean, materialize, pick, release
from sentrel.llm.components import components

SHINGLE = 5
SIMILARITY = 0.8
ROWS, LISTS = 4, 25
POSITIONS = ROWS * LISTS
#: What a pair's agreement in a position is of its similarity, at least.
KEPT = 0.95
#: Members up to which all pairs of different components of a list are tallied; longer lists are split.
LONG = 1 << 11
#: Ways to split a list, by three positions each, and how often that is done.
SPLITS, WIDE, TIMES = 12, 3, 2
#: Shingle hashes that vote at a time.
SLICE = 1 << 12
_MIX = np.random.default_rng(42).integers(0, 1 << 63, (2, POSITIONS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_CELL = np.arange(POSITIONS) << 8
#: For each byte, how its bits vote.
_VOTE = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1) * 2.0 - 1


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """The distinct shingle hashes of a text, sorted."""
    words = (text or "").encode(errors="replace").lower().split()  # bytes: A-Z only, and the six ASCII spaces
    if not words:
        return np.zeros(0, np.uint64)
    parts = [b" ".join(words)] if len(words) < size else map(b" ".join, zip(*(words[i:] for i in range(size))))
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, parts), dtype=np.uint64))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def signature(h: np.ndarray) -> tuple[bytes, list[int]]:
    """The fingerprint, a byte per position, and the keys of the lists, each of the bytes of its positions."""
    weights = np.zeros(POSITIONS << 8)  # by position and byte, as shingles of a byte vote alike
    for left in range(0, len(h), SLICE):
        x = h[left : left + SLICE, None] ^ _MIX[0]
        x *= _MIX[1]
        x ^= x >> np.uint64(32)
        x *= _MIX[0]
        u = ((x >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53
        u *= u
        u *= u
        x &= np.uint64(255)
        weights += np.bincount((x.view(np.int64) + _CELL).ravel(), (1 / u).ravel(), POSITIONS << 8)
    sig = np.packbits(weights.reshape(POSITIONS, 256) @ _VOTE > 0, axis=1).tobytes()
    return sig, [xxhash.xxh64_intdigest(sig[k * ROWS : (k + 1) * ROWS], k) - (1 << 63) for k in range(LISTS)]


def _node(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def _nodes(docs: DataFrame) -> DataFrame:
    """(doc_id, text, node): node is the same for equal texts."""
    return pick(docs, "doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), _node(F.col("text")).alias("node"))


def _signed(texts: DataFrame, size: int) -> DataFrame:
    """(node, sig, keys) of every distinct text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sigs, keys = [], []
            for t in b.column("text").to_pylist():
                s, k = signature(shingles(t, size))
                sigs.append(s)
                keys.append(k)
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.array(sigs, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["node", "sig", "keys"])

    return texts.select("text", "node").mapInArrow(lean(run), "node binary, sig binary, keys array<long>").dropDuplicates(["node"])


def _held(texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, text): the texts of some nodes, once each, written so that joins on a hot node can be split."""
    return materialize(texts.join(nodes.distinct(), "node", "left_semi").select("node", "text").dropDuplicates(["node"]), "candidate-texts")


def _verified(pairs: DataFrame, held: DataFrame, size: int, least: float) -> DataFrame:
    """The pairs (a, b) whose shingle sets agree in ``least`` or more."""
    both = pairs.join(held.select(F.col("node").alias("a"), F.col("text").alias("x")), "a").join(held.select(F.col("node").alias("b"), F.col("text").alias("y")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in (whole.slice(i, 512) for i in range(0, whole.num_rows, 512)):
                good = [similarity(shingles(x.as_py(), size), shingles(y.as_py(), size)) >= least for x, y in zip(b.column("x"), b.column("y"))]
                yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    return both.select("a", "b", "x", "y").mapInArrow(lean(run), "a binary, b binary")


def _open(lists: DataFrame) -> DataFrame:
    """The rows (key, node, root, ...) of lists that several components share."""
    keys = lists.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("n")).where("lo <> hi").select("key", "n")
    return lists.join(keys, "key")


def _settled(size: int, least: float):
    """Verified links (a, b) that join the components of each list; the rows come sorted by key."""
    sure = POSITIONS * KEPT * least
    enough = int(sure - 4.3 * (sure * (1 - KEPT * least)) ** 0.5)

    def settle(key: int, rows: list[tuple]) -> Iterator[tuple[bytes, bytes]]:
        node, root, sig, own, text = zip(*rows)
        number = {r: k for k, r in enumerate(dict.fromkeys(root))}
        if len(number) < 2:
            return
        n, up, sets = len(node), list(range(len(number))), {}
        part, sig = np.array([number[r] for r in root]), np.frombuffer(b"".join(sig), np.uint8).reshape(-1, POSITIONS)
        own = np.array(own, np.int64)
        here = np.flatnonzero(own[0] == key)  # which of its lists this is; none if it was split

        def find(k: int) -> int:
            while up[k] != k:
                up[k] = up[up[k]]
                k = up[k]
            return k

        def grams(k: int) -> set[int]:
            if k not in sets:
                sets[k] = set(shingles(text[k], size).tolist())
            return sets[k]

        step = max(1, (1 << 24) // (POSITIONS * n))
        for left in range(0, n, step):  # some rows against themselves and those behind them
            some = slice(left, left + step)
            tally = (sig[some, None, :] == sig[None, left:, :]).sum(axis=2, dtype=np.int32)
            later = np.arange(n - left)[None, :] > np.arange(len(tally))[:, None]
            i, j = np.nonzero((tally >= enough) & later & (part[some, None] != part[None, left:]))
            if len(here):  # a pair is judged in the first list that it shares
                first = (own[i + left, : here[0]] != own[j + left, : here[0]]).all(axis=1)
                i, j = i[first], j[first]
            order = np.argsort(-tally[i, j], kind="stable")
            for x, y in zip((i[order] + left).tolist(), (j[order] + left).tolist()):
                p, q = find(part[x]), find(part[y])
                if p != q:
                    a, b = grams(x), grams(y)
                    both = len(a & b)
                    if both >= least * (len(a) + len(b) - both):
                        up[p] = q
                        yield node[x], node[y]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows, out = None, [], []
        for b in batches:
            for r in zip(*(b.column(c) for c in ("key", "node", "root", "sig", "keys", "text"))):
                key, *rest = (x.as_py() for x in r)
                if key != now:
                    out += settle(now, rows) if len(rows) > 1 else []
                    now, rows = key, []
                rows.append(rest)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in zip(*out)], names=["a", "b"])
                out = []
        out += settle(now, rows) if len(rows) > 1 else []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in zip(*out)], names=["a", "b"])

    return run


def _split(lists: DataFrame, turn: int) -> DataFrame:
    """Long lists under keys of three further positions each; the positions differ from turn to turn."""
    at = [1 + (turn * SPLITS + k) * WIDE % (POSITIONS - WIDE) for k in range(SPLITS)]
    keys = F.array(*(F.xxhash64("key", F.lit(p), F.substring("sig", p, WIDE)) for p in at))
    return lists.select(F.explode(keys).alias("key"), "node", "root", "sig", "keys")


def _rest(live: DataFrame, roots: DataFrame, signed: DataFrame, held: DataFrame, size: int, least: float, long: int) -> DataFrame:
    """Links (a, b) that the first ones left out: of different components, in a list of both, verified."""
    placed = live.join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    # of a list of two the one pair is verified
    lists, out = materialize(_open(placed).where("n > 2").join(signed, "node"), "open-lists"), []
    for turn in range(TIMES + 1):
        short = (lists if turn == TIMES else lists.where(F.col("n") <= long)).join(held, "node")
        found = short.select("key", "node", "root", "sig", "keys", "text").repartition("key").sortWithinPartitions("key").mapInArrow(lean(_settled(size, least)), "a binary, b binary")
        out.append(materialize(found, "rest-links"))
        longer = lists.where(F.col("n") > long)
        if turn == TIMES or longer.isEmpty():
            break
        before, lists = lists, materialize(_open(_split(longer, turn)), "split-lists")
        release(before)
    release(lists)
    return reduce(DataFrame.unionByName, out)


def _linked(docs: DataFrame, size: int, least: float, long: int) -> DataFrame:
    """(doc_id, node, root) of every row; rows of a root are near-duplicates."""
    texts = _nodes(docs)
    signed = materialize(_signed(texts, size), "signatures")
    marks = signed.select(F.explode("keys").alias("key"), "node")
    shared = marks.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi").select("key")
    live = materialize(marks.join(shared, "key"), "shared-lists")
    pivot = lambda k: F.min_by("node", F.xxhash64("node", F.lit(k)))
    pivots = live.groupBy("key").agg(F.array_distinct(F.array(F.min("node"), pivot(1), pivot(2), pivot(3))).alias("pivots"))
    first = live.join(pivots, "key").select("node", F.explode("pivots").alias("other")).where("node <> other")
    first = materialize(first.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct(), "first-pairs")
    held = _held(texts, live.select("node"))
    links = materialize(_verified(first, held, size, least), "first-links")
    roots = components(links, "near-first")
    rest, before = _rest(live, roots, signed, held, size, least, long), roots
    release(signed, live, first, held)
    if not rest.isEmpty():
        roots = components(links.unionByName(rest), "near")
        release(before)
    release(links)
    return texts.select("doc_id", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def near_duplicates(docs: DataFrame, size: int = SHINGLE, least: float = SIMILARITY, long: int = LONG) -> DataFrame:
    """(doc_id, node, component_id) for every row; component_id is the least doc_id that verified pairs reach."""
    rows = _linked(docs, size, least, long)
    named = rows.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return rows.join(named, "root").select("doc_id", "node", "component_id")


def keep_one(docs: DataFrame, size: int = SHINGLE, least: float = SIMILARITY) -> DataFrame:
    """The documents with one row of each group: the one of the least doc_id (null last), then of the least text hash."""
    rows = _linked(docs, size, least, LONG)
    rows = materialize(rows.groupBy("root", "doc_id", "node").agg(F.count("*").alias("n")), "near-rows")
    first = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "node")).alias("k")).select("root", F.col("k.doc_id").alias("kept_id"), F.col("k.node").alias("kept"))
    rows = rows.join(first, "root").withColumn("stays", F.col("doc_id").eqNullSafe(F.col("kept_id")) & (F.col("node") == F.col("kept")))
    names = ident, node, copies = fresh(docs, "near_id", "near_node", "near_copies")
    marked = rows.where("NOT stays OR n > 1").select(F.col("doc_id").alias(ident), F.col("node").alias(node), F.when(F.col("stays"), F.col("n")).otherwise(0).alias(copies))
    out = docs.join(marked, F.col("doc_id").eqNullSafe(F.col(ident)) & (_node(F.col("text")) == F.col(node)), "left").where(F.col(copies).isNull() | (F.col(copies) > 1))
    single = out.where(F.col(copies).isNull())
    if not marked.where(F.col(copies) > 1).isEmpty():  # rows equal in id and text; few, and only they are shuffled
        single = single.unionByName(out.where(F.col(copies) > 1).dropDuplicates([ident, node]))
    return single.drop(*names)
