"""Exact substring deduplication by two-stage suffix sorting.

A byte goes if it lies in a 50-byte string that also starts in a document with a smaller doc_id. Strings are
judged on the input, overlaps count, and no string crosses documents.

1. Documents are packed into compressed blocks, which are written once.
2. Every 50-byte string has an anchor: its 16-byte gram of least hash, the leftmost on a tie. Equal strings have
   equal anchors. Blocks post their anchors' hashes, each once a block with its number of places, to buckets; a bucket
   tells each block which of them other documents have too, and which have more than ``HOT`` places in all.
3. Blocks cut out the context of every shared anchor (the strings that it stands for), each distinct context
   once, under its least doc_id, and post it to the anchor's bucket. A hot anchor's strings are posted one by one,
   to the buckets of their own hashes, so that no bucket holds all that surrounds a common gram.
4. A bucket sorts the suffixes of its contexts to 50 bytes in two stages: suffixes smaller than their successors
   are sorted directly, the others are induced from them by scanning the buckets of first bytes in order.
   Then the common prefixes of neighbours are computed; where one reaches 50, the two are one string, and the least doc_id
   among such neighbours is its owner.
5. Blocks get back a mask per context, mark the strings that a smaller doc_id owns, and cut.

A context that a third of all documents repeat is posted once per block. There are as many buckets as ``BUCKET`` bytes of text
go into the input, and a task holds one at a time. Only hashes, shared contexts, masks and compressed blocks are
shuffled, dealt out by bucket or by block; nothing is collected.

Defined cases: a null text is empty; null ids are larger than all others; rows of equal doc_id don't remove from each
other; documents under 50 bytes lose nothing; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentrel.llm.common import discard, dropping_shuffles, materialize, new_path, pick, release

LENGTH = 50
GRAM = 16
SPAN = LENGTH - GRAM + 1
#: Bytes of text a block, at least one document.
BLOCK = 4 << 20
#: Strings whose anchors are sought at a time.
CHUNK = 1 << 19
#: Anchor buckets per shuffle partition at least, and bytes of text a bucket.
FINER, BUCKET = 4, 4 << 20
#: Places of an anchor beyond which its strings are posted one by one.
HOT = 1 << 16
LAST = (1 << 63) - 1
_U = np.uint64
_LOW = _U((1 << 27) - 1)
#: Posted hashes keep their upper 47 bits; the bit below is a flag, and the others count places. More bits of the hash
#: would only spare a few false candidates.
_FLAG = _U(1 << 16)
_COUNT = _FLAG - _U(1)
_HASH = ~_U((1 << 17) - 1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(29))


def _anchors(buf: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(hash, first string, number of strings) of the anchors of concatenated documents, in order."""
    starts = np.r_[0, ends[:-1]]
    total = int(ends[-1]) if len(ends) else 0
    padded = np.concatenate([buf, np.zeros(LENGTH + 16, np.uint8)])
    for left in range(0, total, CHUNK):
        n = min(CHUNK, total - left)  # strings that start here
        part = padded[left : left + n + LENGTH + 8]
        grams = n + SPAN - 1
        w = np.empty(grams + GRAM - 8, np.uint64)
        for r in range(8):
            v = part[r : r + (len(part) - r) // 8 * 8].view("<u8")
            w[r::8] = v[: len(w[r::8])]
        h = _mix(w[:grams])
        for o in range(8, GRAM, 8):
            h = _mix(h ^ (w[o : o + grams] * _U(0x9E3779B97F4A7C15)))
        m = (h & ~_LOW) | np.arange(grams, dtype=np.uint64)
        width = 1
        while width * 2 <= SPAN:
            m = np.minimum(m[:-width], m[width:])
            width *= 2
        m = np.minimum(m[: len(m) - (SPAN - width)], m[SPAN - width :])
        ok = np.ones(n, bool)  # strings within one document
        for d in range(int(np.searchsorted(ends, left, "right")), len(ends)):
            if starts[d] >= left + n:
                break
            ok[max(int(starts[d]), int(ends[d]) - LENGTH + 1, left) - left : int(ends[d]) - left] = False
        at = np.flatnonzero(ok)
        if not len(at):
            continue
        q = (m[at] & _LOW).astype(np.int64)
        new = np.flatnonzero(np.r_[True, (q[1:] != q[:-1]) | (at[1:] != at[:-1] + 1)])
        yield h[q[new]], at[new] + left, np.diff(np.r_[new, len(at)])


def _all_anchors(buf: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    got = list(_anchors(buf, ends))
    if not got:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*got))


def _pack(*arrays: np.ndarray, level: int = 1) -> bytes:
    """Arrays as one compressed blob; each is preceded by its size in bytes."""
    raw = b"".join(len(b).to_bytes(8, "little") + b for b in (np.ascontiguousarray(a).tobytes() for a in arrays))
    return zstandard.ZstdCompressor(level=level).compress(raw)


def _pack_keys(keys: np.ndarray) -> bytes:
    """Ascending keys as the byte planes of their differences, most of which are empty."""
    return _pack(np.diff(keys, prepend=_U(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T)


def _unpack_keys(blob: bytes) -> np.ndarray:
    planes = _unpack(blob, "u1")[0].reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)


def _unpack(blob: bytes, *kinds: str) -> list[np.ndarray]:
    raw, at, out = zstandard.ZstdDecompressor().decompress(blob), 0, []
    for k in kinds:
        n = int.from_bytes(raw[at : at + 8], "little")
        out.append(np.frombuffer(raw, k, n // np.dtype(k).itemsize, at + 8))
        at += 8 + n
    return out


# A row of every exchange: block, kind (order within a block), bucket, blob.
_ROW = "block long, kind int, bucket int, blob binary"
_NAMES = [x.split()[0] for x in _ROW.split(", ")]


#: Bytes of blobs an Arrow batch.
BATCH = 4 << 20


def _row(block: int, kind: int, bucket: int, blob: bytes) -> tuple[int, int, int, bytes]:
    return block, kind, bucket, blob


def _batched(rows: Iterator[tuple[int, int, int, bytes]]) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches of bounded size."""
    held, room = [], 0
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary())
    for row in rows:
        held.append(row)
        room += len(row[3])
        if room >= BATCH or len(held) >= 4096:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names=_NAMES)
            held, room = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names=_NAMES)


def _map(df: DataFrame, f) -> DataFrame:
    """Rows to rows by an iterator function."""
    return df.mapInArrow(lambda batches: _batched(f(batches)), _ROW)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, int, bytes]]:
    for b in batches:
        for i in range(b.num_rows):
            yield tuple(b.column(c)[i].as_py() for c in range(4))


_BLOCK = ("<i8", "u1", "<i8", "u1")  # ids, null flags, lengths, bytes


def _to_blocks(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        base, k = TaskContext.get().partitionId() << 32, 0
        held: list[tuple[int, bool, bytes]] = []
        room = 0

        def flush() -> tuple:
            held.sort(key=lambda r: (r[0], r[1]))
            blob = _pack(np.array([r[0] for r in held], "<i8"), np.array([r[1] for r in held], "u1"), np.array([len(r[2]) for r in held], "<i8"), np.frombuffer(b"".join(r[2] for r in held), "u1"), level=3)
            held.clear()
            return _row(base + k, 2, 0, blob)

        for b in batches:
            for i, t in zip(b.column("doc_id").cast(pa.int64()).to_pylist(), b.column("text")):
                raw = t.as_py()
                raw = b"" if raw is None else raw.encode(errors="replace")
                held.append((LAST if i is None else i, i is None, raw))
                room += len(raw) + 64
                if room >= size:
                    yield flush()
                    k, room = k + 1, 0
        if held:
            yield flush()

    return run


def _cut_buckets(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, rows of it in order)."""
    order = np.argsort(bucket, kind="stable")
    edge = np.flatnonzero(np.r_[True, np.diff(bucket[order]) != 0]) if len(order) else []
    for s, e in zip(edge, [*edge[1:], len(order)]):
        yield int(bucket[order[s]]), order[s:e]


def _bucket_of(h: np.ndarray, n: int) -> np.ndarray:
    return ((h >> _U(40)) % _U(n)).astype(np.int64)


def _post_hashes(n_buckets: int):
    """A block's anchor hashes by bucket, each once with its places; the flag says that documents of different ids here have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for block, _, _, blob in _rows(batches):
            ids, _, sizes, buf = _unpack(blob, *_BLOCK)
            ends = np.cumsum(sizes)
            h, at, _ = _all_anchors(buf, ends)
            if not len(h):
                continue
            doc = ids[np.searchsorted(ends, at, "right")]
            h &= _HASH
            order = np.argsort(h, kind="stable")  # the ids of a block ascend, so each hash's first id is its least
            h, doc = h[order], doc[order]
            first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
            last = np.r_[first[1:], len(h)] - 1
            keys = h[first] | (doc[first] != doc[last]).astype(np.uint64) * _FLAG | np.minimum(last - first + 1, int(_COUNT)).astype(np.uint64)
            for b, rows in _cut_buckets(_bucket_of(keys, n_buckets)):
                yield _row(block, 0, b, _pack_keys(keys[rows]))

    return run


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple[int, bytes]]]]:
    """(bucket, its (block, blob)) of rows sorted by bucket."""
    now, held = None, []
    for block, _, bucket, blob in _rows(batches):
        if bucket != now and held:
            yield now, held
            held = []
        now = bucket
        held.append((block, blob))
    if held:
        yield now, held


def _shared(hot: int):
    """Per block, the hashes of its postings that occur in another document; the flag says that an anchor is hot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for bucket, posts in _by_bucket(batches):
            keys = [_unpack_keys(blob) for _, blob in posts]
            owner = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
            every = np.concatenate(keys)
            order = np.argsort(every & _HASH, kind="stable")
            every, owner = every[order], owner[order]
            h = every & _HASH
            first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
            size = np.diff(np.r_[first, len(h)])
            many = (size > 1) | np.bitwise_or.reduceat(every & _FLAG, first).astype(bool)
            often = np.add.reduceat(every & _COUNT, first) > _U(hot)
            take = np.repeat(many, size)
            h, owner = (h | np.repeat(often, size).astype(np.uint64) * _FLAG)[take], owner[take]
            for k, rows in _cut_buckets(owner):
                yield _row(posts[k][0], 0, bucket, _pack_keys(h[rows]))

    return run


def _string_hashes(buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Hashes of the strings that start at some places."""
    out = np.empty(len(at), np.uint64)
    windows = np.lib.stride_tricks.sliding_window_view(buf, LENGTH)
    for left in range(0, len(at), 1 << 16):
        w = np.zeros((len(at[left : left + (1 << 16)]), -(-LENGTH // 8) * 8), np.uint8)
        w[:, :LENGTH] = windows[at[left : left + (1 << 16)]]
        h = np.zeros(len(w), np.uint64)
        for word in w.view("<u8").T:
            h = _mix((h ^ word) * _U(0x9E3779B97F4A7C15))
        out[left : left + (1 << 16)] = h
    return out


_CONTEXT = ("u1", "u1", "u1", "u1", "<i8", "u1")  # strings, positions before the seed, real seed, length, owner, bytes
_PLACES = ("<i8", "u1", "<i4", "<i4")  # first string, strings, bucket, number of the context there


def _contexts(n_buckets: int):
    """Contexts of shared anchors, by bucket (kind 1), and where each block has them (kind 0)."""

    def of(block: int, blob: bytes, shared: np.ndarray) -> Iterator[tuple]:
        ids, _, sizes, buf = _unpack(blob, *_BLOCK)
        ends = np.cumsum(sizes)
        h, at, count = _all_anchors(buf, ends)
        key = h & _HASH
        spot = np.minimum(np.searchsorted(shared & _HASH, key), len(shared) - 1)
        live = shared[spot] & _HASH == key
        hot = (shared[spot] & _FLAG)[live].astype(bool)
        key, at, count = key[live], at[live], count[live]
        if not len(key):
            return
        # a hot anchor's strings go one by one
        each = np.where(hot, count, 1)
        row, step = np.repeat(np.arange(len(at)), each), np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
        key, at, count, hot = key[row], at[row] + step, np.where(hot, 1, count)[row], hot[row]
        bucket = _bucket_of(key, n_buckets)
        if hot.any():
            bucket[hot] = _bucket_of(_string_hashes(buf, at[hot]), n_buckets)
        doc = np.searchsorted(ends, at, "right")
        stop = ends[doc]
        # a suffix's type is that of the next differing pair; the last byte of a document is larger than its end
        n = len(buf)
        step = np.r_[np.sign(buf[1:].astype(np.int16) - buf[:-1]), -1].astype(np.int8)
        step[ends[sizes > 0] - 1] = -1
        here = np.arange(n, dtype=np.int32 if n < 1 << 31 else np.int64)
        after = np.minimum.accumulate(np.where(step != 0, here, n)[::-1])[::-1]
        rising = step[after] > 0
        up = np.minimum.accumulate(np.where(rising, here, n)[::-1])[::-1]  # the next suffix smaller than its successor
        final = at + count - 1
        seed = np.minimum(up[final], np.minimum(final + LENGTH, stop))
        real = (seed < stop) & (up[final] == seed)
        size = np.minimum(seed + LENGTH, stop) - at
        number = np.empty(len(key), np.int32)
        raw = buf.tobytes()
        for b, rows in _cut_buckets(bucket):
            known: dict[tuple, int] = {}
            first = []
            for r, s, e, c in zip(rows.tolist(), at[rows].tolist(), (at + size)[rows].tolist(), count[rows].tolist()):
                k = known.setdefault((c, raw[s:e]), len(first))
                if k == len(first):
                    first.append(r)
                number[r] = k
            f = np.array(first)
            yield _row(block, 1, b, _pack(count[f].astype("u1"), (seed - at)[f].astype("u1"), real[f].astype("u1"), size[f].astype("u1"), ids[doc[f]], np.frombuffer(b"".join(raw[s:e] for s, e in zip(at[f].tolist(), (at + size)[f].tolist())), "u1"), level=3))
        yield _row(block, 0, 0, _pack(at, count.astype("u1"), bucket.astype("<i4"), number))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        now, hashes = None, []
        for block, kind, _, blob in _rows(batches):
            if block != now:
                now, hashes = block, []
            if kind == 0:
                hashes.append(_unpack_keys(blob))
            elif hashes:
                yield from of(block, blob, np.unique(np.concatenate(hashes)))

    return run


def two_stage(text: np.ndarray, seeds: np.ndarray, real: np.ndarray) -> np.ndarray:
    """Ranks of the suffixes of several texts, sorted to LENGTH bytes.

    ``text`` has a zero-padded row for each text; of row r, the positions 0 to seeds[r] are ranked. The suffix at
    the seed is smaller than its successor (``real``) or stands for the end. Others get rank -1.
    """
    n, width = text.shape
    flat = text.ravel()
    span = int(seeds.max()) + 1
    col = np.arange(span)
    inside = col[None, :] <= seeds[:, None]
    small = np.zeros((n, span), bool)  # smaller than the successor
    run = np.ones((n, span), np.uint8)  # equal bytes up to the next other one, for the larger ones
    small[np.arange(n), seeds] = real
    for c in range(span - 2, -1, -1):
        before_end = c < seeds
        end_next = (c + 1 == seeds) & ~real
        a, b = text[:, c], text[:, c + 1]
        same = (a == b) & ~end_next
        small[:, c] = np.where(before_end, ((a < b) & ~end_next) | (same & small[:, c + 1]), small[:, c])
        run[:, c] = np.where(before_end & same, run[:, c + 1] + 1, 1)
    at = (np.arange(n)[:, None] * width + col[None, :])
    rank = np.full(n * width, -1, np.int64)
    # stage one: direct sort
    direct = at[inside & small]
    strings = np.lib.stride_tricks.as_strided(flat, (len(flat) - LENGTH + 1, LENGTH), (1, 1))
    direct = direct[np.argsort(strings[direct].view(f"S{LENGTH}").ravel(), kind="stable")]
    # stage two: bucket scans in the order of first bytes; a bucket's larger suffixes come first
    larger = inside & ~small & (col[None, :] < seeds[:, None])
    induced, waves = at[larger], run[larger]
    first = flat[induced]
    order = np.lexsort((waves, first))
    induced, first, waves = induced[order], first[order], waves[order]
    d_first = flat[direct]
    d_edges, i_edges = np.searchsorted(d_first, np.arange(257)), np.searchsorted(first, np.arange(257))
    done = 0
    for c in np.flatnonzero((np.diff(d_edges) > 0) | (np.diff(i_edges) > 0)):
        s, e = i_edges[c], i_edges[c + 1]
        if e > s:
            cuts = np.flatnonzero(np.r_[True, waves[s + 1 : e] != waves[s : e - 1]]) + s
            for x, y in zip(cuts, [*cuts[1:], e]):  # runs of the byte: the shorter ones are smaller
                rows = induced[x:y]
                rank[rows[np.argsort(rank[rows + 1], kind="stable")]] = np.arange(done, done + len(rows))
                done += len(rows)
        s, e = d_edges[c], d_edges[c + 1]
        rank[direct[s:e]] = np.arange(done, done + e - s)
        done += e - s
    return rank.reshape(n, width)


def common_prefixes(body: np.ndarray) -> np.ndarray:
    """The bytes that each row of LENGTH bytes, given as zero-padded words, has in common with the row before."""
    differ = body[1:] ^ body[:-1]
    word = (differ != 0).argmax(axis=1)
    x = differ[np.arange(len(differ)), word]
    same = np.bitwise_count((x & (~x + _U(1))) - _U(1)) // 8  # 8 where no word differs
    return np.r_[0, np.where(x == 0, LENGTH, 8 * word + same)]


def owners(text: np.ndarray, strings: np.ndarray, seeds: np.ndarray, real: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Bit j of a row's mask: string j of the text also starts in a text of a smaller owner."""
    n, width = text.shape
    rank = two_stage(text, seeds, real)
    row, j = np.nonzero(np.arange(int(strings.max()))[None, :] < strings[:, None])
    order = np.argsort(rank[row, j], kind="stable")
    row, j = row[order], j[order]
    body = np.zeros((len(row), -(-LENGTH // 8) * 8), np.uint8)
    body[:, :LENGTH] = np.lib.stride_tricks.sliding_window_view(text.ravel(), LENGTH)[row * width + j]
    first = np.flatnonzero(common_prefixes(body.view(np.uint64)) < LENGTH)
    least = np.repeat(np.minimum.reduceat(owner[row], first), np.diff(np.r_[first, len(row)]))
    mask = np.zeros(n, np.uint64)
    np.bitwise_or.at(mask, row, (least < owner[row]).astype(np.uint64) << j.astype(np.uint64))
    return mask


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Masks of every block's contexts (kind 1), by bucket."""
    for bucket, posts in _by_bucket(batches):
        parts = [_unpack(blob, *_CONTEXT) for _, blob in posts]
        strings, seeds, real, size, owner, raw = (np.concatenate(x) for x in zip(*parts))
        size = size.astype(np.int64)
        text = np.zeros((len(size), int(size.max()) + LENGTH + 1), np.uint8)
        text[np.arange(text.shape[1])[None, :] < size[:, None]] = raw
        mask = owners(text, strings.astype(np.int64), seeds.astype(np.int64), real.astype(bool), owner)
        at = 0
        for (block, _), part in zip(posts, parts):
            yield _row(block, 1, bucket, _pack(owner[at : at + len(part[0])], mask[at : at + len(part[0])]))
            at += len(part[0])


def removed(buf: np.ndarray, ends: np.ndarray, ids: np.ndarray, places: list[np.ndarray], masks: dict[int, list[np.ndarray]]) -> np.ndarray:
    """Which bytes of a block go."""
    at, count, bucket, number = places
    owner, mask = np.empty(len(at), np.int64), np.empty(len(at), np.uint64)
    for b, rows in _cut_buckets(bucket):
        owner[rows], mask[rows] = masks[b][0][number[rows]], masks[b][1][number[rows]]
    # a context that a smaller id of this block has too is repeated as a whole
    mask[owner < ids[np.searchsorted(ends, at, "right")]] = _U((1 << 64) - 1)
    mark = np.zeros(len(buf) + 1, np.int32)
    for j in range(SPAN):
        mark[at[((mask >> _U(j)) & _U(1)).astype(bool) & (count > j)] + j] = 1
    run = np.zeros(len(buf) + LENGTH, np.int32)
    np.cumsum(mark[:-1], out=run[LENGTH:])
    return run[LENGTH:] > run[:-LENGTH]


_RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _cut(with_text: bool):
    def of(blob: bytes, places, masks) -> Iterator[pa.RecordBatch]:
        ids, null, sizes, buf = _unpack(blob, *_BLOCK)
        ends = np.cumsum(sizes)
        gone = removed(buf, ends, ids, places, masks) if places is not None else np.zeros(len(buf), bool)
        out: list[list] = [[] for _ in range(6)]
        for i, no_id, s, e in zip(ids.tolist(), null.tolist(), (ends - sizes).tolist(), ends.tolist()):
            g, b = gone[s:e], buf[s:e]
            n = int(g.sum())
            kept = (b[~g] if n else b).tobytes()
            spans = int(g[0]) + int((g[1:] & ~g[:-1]).sum()) if n else 0
            for c, v in zip(out, (None if no_id else i, e - s, n, spans, hashlib.sha256(kept).hexdigest(), kept if with_text else None)):
                c.append(v)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
        arrays = [pa.array(c, k) for c, k in zip(out, kinds)]
        yield pa.RecordBatch.from_arrays([*arrays, *([pa.array(out[5], pa.binary())] if with_text else [])], names=[x.split()[0] for x in _RESULT.split(", ")] + ["kept"] * with_text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, places, masks = None, None, {}
        for block, kind, bucket, blob in _rows(batches):
            if block != now:
                now, places, masks = block, None, {}
            if kind == 0:
                places = _unpack(blob, *_PLACES)
            elif kind == 1:
                masks[bucket] = _unpack(blob, "<i8", "<u8")
            else:
                yield from of(blob, places, masks)

    return run


def dedup_substrings(docs: DataFrame, with_text: bool = False, block: int = BLOCK, hot: int = HOT) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row; ``with_text`` adds the kept bytes."""
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = lambda df, *by: df.repartition(n, F.col(by[0])).sortWithinPartitions(*by)
    with dropping_shuffles(spark):
        blocks = materialize(_map(pick(docs, "doc_id", "text"), _to_blocks(block)), "blocks")
        buckets = max(FINER * n, blocks.count() * block // BUCKET)
        shared = materialize(_map(dealt(_map(blocks, _post_hashes(buckets)), "bucket"), _shared(hot)), "shared-anchors")
        at = new_path(spark, "contexts")
        _map(dealt(shared.unionByName(blocks), "block", "kind"), _contexts(buckets)).write.partitionBy("kind").option("compression", "zstd").parquet(at)
        cut = lambda kind: spark.read.schema(_ROW).parquet(at).where(F.col("kind") == kind).select(*_NAMES)
        masks = materialize(_map(dealt(cut(1), "bucket"), _judge), "masks")
    discard(spark, f"{at}/kind=1")  # the masks say all about them
    release(shared)
    whole = cut(0).unionByName(masks).unionByName(blocks)
    return dealt(whole, "block", "kind").mapInArrow(_cut(with_text), _RESULT + (", kept binary" if with_text else ""))


def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents."""
    return dedup_substrings(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op9_substrings": op9_substrings}
ORACLES: dict[str, str] = {}
