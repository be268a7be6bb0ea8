"""SentencePiece encoding and decoding by a streaming Viterbi over the piece lattice.

The stream reads characters and keeps, per boundary between them, the best path that ends there and its backpointer. Only
boundaries within the longest piece can still grow. Once all paths that survive there meet in one boundary, the ids up
to it are committed and forgotten; so memory follows the stretch that is still ambiguous, not the text, and every text, long
or short, takes this one way. The ids equal those of the public library.

For a unigram vocabulary a path's score is the sum of its pieces' scores, and the better path survives at a boundary. A
BPE vocabulary's scores are merge ranks. A path is the tokenizer's own result exactly if every two neighbouring pieces,
joined, would be merged back into those two by rank. So there the state is the last piece, and a path survives while its
neighbours are consistent; at most one does at a boundary.

Where no piece spans two neighbouring characters, every path has a boundary between them. Texts are cut at
the spaces among those places, and the cuts' ids are kept in a bounded table per worker, as text repeats words. The model
is read on the driver and broadcast, so the executors need no file.

Defined cases: null and empty texts have no ids and decode to the empty string; characters outside the
vocabulary become byte pieces; the letter U+2581 stands for a space and decodes to one, as in the
library; repeated rows get equal results; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from sentrel.llm.common import lean, pick

MODEL = os.environ.get("SENTREL_PIECES", "/opt/tokenizers/piece_bpe_32k.model")
SPACE = "▁"
#: Words whose ids a worker keeps.
CACHE = 400_000
#: Characters that are fed to the stream at a time.
FEED = 1 << 12


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol buffer message's fields."""
    at = 0

    def varint() -> int:
        nonlocal at
        x = shift = 0
        while True:
            b = raw[at]
            at += 1
            x |= (b & 127) << shift
            shift += 7
            if b < 128:
                return x

    while at < len(raw):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
            continue
        size = varint() if tag & 7 == 2 else 8 if tag & 7 == 1 else 4
        yield tag >> 3, raw[at : at + size]
        at += size


def is_bpe(proto: bytes) -> bool:
    """Whether a model's trainer settings (field 2) name the type (field 3) 2, which is BPE; unigram is 1 and the default."""
    return any(n == 3 and x == 2 for k, spec in _fields(proto) if k == 2 for n, x in _fields(spec))


class Vocabulary:
    """Pieces, ids and scores of a model, given as the bytes of its file."""

    def __init__(self, model: bytes):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.bpe = is_bpe(model)
        n = sp.vocab_size()
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i) for i in range(n)]
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        self.ids = {self.pieces[i]: i for i in range(n) if not special[i]}
        self.rank = {p: -sp.get_score(i) for p, i in self.ids.items()}
        #: A character without a piece scores ten below the worst piece, as in the library.
        self.unknown = max(self.rank.values()) + 10
        self.byte = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.raw = [b"" if special[i] else self.pieces[i].encode() for i in range(n)]
        for b, i in enumerate(self.byte):
            self.raw[i] = bytes([b])
        self.longest = max(map(len, self.ids))
        self.pairs = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        self.edges: dict[str, tuple[list, list] | None] = {}
        self.joined: dict[tuple[str, str], bool] = {}
        #: Prefix tree of the pieces of two characters or more; "" holds the piece that ends at a node.
        self.tree: dict = {}
        for p in self.ids:
            if len(p) > 1 and (not self.bpe or self.edge(p) is not None):
                node = self.tree
                for c in p:
                    node = node.setdefault(c, {})
                node[""] = p
        #: No piece has a space after another character, so a cut before a run of spaces is on every path.
        self.cuts_at_spaces = not any(x != SPACE and y == SPACE for x, y in self.pairs)

    def edge(self, piece: str) -> tuple[list, list] | None:
        """How a piece's first and last parts grow as it is merged: (part, rank of the merge that ends it).

        None for a piece that its own merges don't rebuild; such a piece is never produced.
        """
        parts, first, last = list(piece), [], []
        while len(parts) > 1:
            r, i = min((self.rank.get(parts[i] + parts[i + 1], np.inf), i) for i in range(len(parts) - 1))
            if r == np.inf:
                self.edges[piece] = None
                return None
            if i == 0:
                first.append((parts[0], r))
            if i == len(parts) - 2:
                last.append((parts[-1], r))
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        out = self.edges[piece] = ([*first, (piece, np.inf)], [*last, (piece, np.inf)])
        return out

    def joins(self, left: str, right: str) -> bool:
        """Whether no merge crosses the boundary between two pieces while they are built.

        A merge of the two parts at the boundary happens if it ranks before the merges that end either part;
        on equal ranks the one further left goes first.
        """
        if left[-1] + right[0] not in self.pairs:
            return True
        known = self.joined.get((left, right))
        if known is not None:
            return known
        lefts, rights = (self.edges.get(left) or self.edge(left))[1], (self.edges.get(right) or self.edge(right))[0]
        i = j = 0
        rank, ok = self.rank, True
        while True:
            (x, x_end), (y, y_end) = lefts[i], rights[j]
            r = rank.get(x + y)
            if r is not None and r < x_end and r <= y_end:
                ok = False
                break
            if x_end == y_end == np.inf:
                break
            if x_end <= y_end:
                i += 1
            else:
                j += 1
        if len(self.joined) >= CACHE:
            self.joined.clear()
        self.joined[left, right] = ok
        return ok


Path = tuple[float, int, str]  # score, start and text of the last piece


def extend_by_merges(v: Vocabulary, text: str, i: int, back: list[Path | None], tail: str | None) -> int:
    """Extend the path that ends at offset i by every piece that is consistent with its last one; the furthest boundary reached."""
    known, far = v.joined, 0
    if back[i + 1] is None and (tail is None or v.joins(tail, text[i])):
        back[i + 1], far = (0.0, i, text[i]), i + 1
    node = v.tree.get(text[i])
    j, size = i + 1, len(text)
    while node is not None and j < size:
        node = node.get(text[j])
        j += 1
        if node is not None and "" in node and back[j] is None:
            piece = node[""]
            ok = True if tail is None else known.get((tail, piece))
            if ok is None:
                ok = v.joins(tail, piece)
            if ok:
                back[j], far = (0.0, i, piece), j
    return far


def extend_by_scores(v: Vocabulary, text: str, i: int, back: list[Path | None], tail: str | None) -> int:
    """Extend the path that ends at offset i by every piece, where that beats the path that a boundary has; the furthest boundary reached."""
    rank, so_far = v.rank, back[i][0] if back[i] else 0.0

    def offer(j: int, piece: str, cost: float) -> None:
        if back[j] is None or so_far - cost > back[j][0]:
            back[j] = (so_far - cost, i, piece)

    far = i + 1
    offer(far, text[i], rank.get(text[i], v.unknown))
    node = v.tree.get(text[i])
    j, size = i + 1, len(text)
    while node is not None and j < size:
        node = node.get(text[j])
        j += 1
        if node is not None and "" in node:
            offer(j, node[""], rank[node[""]])
            far = j
    return far


def ids_of(v: Vocabulary, pieces: Iterable[str]) -> list[int]:
    out: list[int] = []
    for p in pieces:
        i = v.ids.get(p)
        if i is None:
            out += [v.byte[b] for b in p.encode()]
        else:
            out.append(i)
    return out


class Stream:
    """Feed characters, get committed ids.

    Offsets count from the start of ``text``, which is cut off behind the last committed boundary now and then.
    """

    def __init__(self, vocab: Vocabulary):
        self.v = vocab
        self.extend = extend_by_merges if vocab.bpe else extend_by_scores
        self.text = ""
        self.back: list[Path | None] = [None]  # per boundary: the last piece of its best path
        self.last: str | None = None  # the piece before the last committed boundary, ``first``
        self.first = self.at = self.far = 0  # offsets before ``at`` have been extended, as far as the boundary ``far``
        self.wait = 2 * vocab.longest  # characters after ``first`` from which a common boundary is sought

    def _commit(self, end: int) -> list[int]:
        back, pieces, at = self.back, [], end
        while at > self.first:
            pieces.append(back[at][2])
            at = back[at][1]
        self.last, self.first = pieces[0], end
        if not self.v.bpe:  # scores count from here on
            zero = back[end][0]
            back[end : self.far + 1] = [x and (x[0] - zero, x[1], x[2]) for x in back[end : self.far + 1]]
        return ids_of(self.v, reversed(pieces))

    def _trim(self) -> None:
        cut = self.first
        self.text = self.text[cut:]
        self.back = [x and (x[0], x[1] - cut, x[2]) for x in self.back[cut:]]
        self.first, self.at, self.far = 0, self.at - cut, self.far - cut

    def _meeting(self) -> int:
        """The last boundary on the paths of all survivors, the boundaries that pieces can still start from."""
        back, meet = self.back, self.far
        for j in range(self.at, self.far):
            if back[j] is not None:
                while j != meet:
                    if j > meet:
                        j = back[j][1]
                    else:
                        meet = back[meet][1] if meet > self.first else meet
        return meet

    def feed(self, text: str, end: bool = False) -> Iterator[list[int]]:
        longest, v, extend = self.v.longest, self.v, self.extend
        if self.first >= FEED:
            self._trim()
        self.text += text
        self.back += [None] * len(text)
        text, back, size = self.text, self.back, len(self.text)
        while self.at < size and (end or self.at + longest <= size):
            i = self.at
            if i == self.first:
                self.far = max(self.far, extend(v, text, i, back, self.last))
            elif back[i] is not None:
                self.far = max(self.far, extend(v, text, i, back, back[i][2]))
            self.at = i + 1
            if self.far == self.at:
                yield self._commit(self.at)
            elif self.at - self.first >= self.wait:
                meet = self._meeting()
                # without one, the next look is when there is twice as much, so that looking stays linear
                self.wait = 2 * longest if meet > self.first else 2 * (self.at - self.first)
                if meet > self.first:
                    yield self._commit(meet)
        if end and self.first < size:
            yield self._commit(size)


class Tokenizer:
    """encode() and decode() of whole texts over a vocabulary."""

    def __init__(self, model: bytes):
        self.v = Vocabulary(model)
        self.cut = re.compile(f"{SPACE}+[^{SPACE}]*" if self.v.cuts_at_spaces else "(?s).+")
        self.known: dict[str, bytes] = {}
        self.inner: dict[str, bytes] = {}

    def _stream(self, part: str) -> bytes:
        stream, out = Stream(self.v), []
        for left in range(0, len(part), FEED):
            for ids in stream.feed(part[left : left + FEED], end=left + FEED >= len(part)):
                out += ids
        return np.array(out, dtype="<i4").tobytes()

    def _word(self, word: str) -> bytes:
        """A word's ids; between two characters that no piece spans, its parts are encoded apart."""
        parts, left, pairs = [], 0, self.v.pairs
        for i in range(1, len(word)):
            if word[i - 1 : i + 1] not in pairs:
                parts.append(word[left:i])
                left = i
        parts.append(word[left:])
        out = []
        for p in parts:
            ids = self.inner.get(p)
            if ids is None:
                ids = self._stream(p)
                if len(p) <= 64:
                    if len(self.inner) >= CACHE:
                        self.inner.clear()
                    self.inner[p] = ids
            out.append(ids)
        ids = b"".join(out)
        if len(word) <= 64:
            if len(self.known) >= CACHE:
                self.known.clear()
            self.known[word] = ids
        return ids

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, "<i4")
        known, word = self.known, self._word
        return np.frombuffer(b"".join([known.get(w) or word(w) for w in self.cut.findall(SPACE + text.replace(" ", SPACE))]), dtype="<i4")

    def decode(self, ids: Iterable[int]) -> str:
        raw = self.v.raw
        text = b"".join([raw[i] for i in (ids.tolist() if isinstance(ids, np.ndarray) else ids)]).decode(errors="replace").replace(SPACE, " ")
        return text[1:] if text[:1] == " " else text


def load(path: str = MODEL) -> bytes:
    """A model's bytes, as the driver reads them."""
    with open(path, "rb") as f:
        return f.read()


@lru_cache(2)
def tokenizer(model: bytes) -> Tokenizer:
    """One per worker and model."""
    return Tokenizer(model)


def encoder(model, digest: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(model.value)
        for whole in batches:
            for b in (whole.slice(i, 512) for i in range(0, whole.num_rows, 512)):
                texts = b.column("text").to_pylist()
                ids = [t.encode(x) for x in texts]
                same = pa.array([t.decode(i) == (x or "") for i, x in zip(ids, texts)])
                counts = np.array([len(i) for i in ids], np.int64)
                if digest:
                    last = pa.array([hashlib.sha256(i.tobytes()).hexdigest() for i in ids], pa.string())
                else:
                    ends = np.r_[0, np.cumsum(counts)].astype(np.int32)
                    last = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(x or "") for x in texts], pa.int64()), pa.array(counts), same, last], names=["doc_id", "n_chars", "n_ids", "round_trip", "ids_sha256" if digest else "ids"])

    return run


def encode_documents(docs: DataFrame, model: str = MODEL, digest: bool = False) -> DataFrame:
    """(doc_id, n_chars, n_ids, round_trip, ids): the piece ids of every text; with ``digest`` their SHA-256 instead.

    ``round_trip`` says whether the decoded ids give the text back. The digest is over little-endian 32-bit ids.
    """
    src = pick(docs, "doc_id", "text")
    kind = src.schema["doc_id"].dataType.simpleString()
    shipped = docs.sparkSession.sparkContext.broadcast(load(model))  # half a megabyte
    return src.mapInArrow(lean(encoder(shipped, digest)), f"doc_id {kind}, n_chars long, n_ids long, round_trip boolean, " + ("ids_sha256 string" if digest else "ids array<int>"))


def decode_documents(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids)."""
    src = pick(encoded, "doc_id", "ids")
    shipped = encoded.sparkSession.sparkContext.broadcast(load(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(shipped.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([t.decode(i or []) for i in b.column("ids").to_pylist()], pa.string())], names=["doc_id", "text"])

    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, text string")


def op8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded and decoded."""
    return encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), digest=True)


QUERIES = {"op8_pieces": op8_pieces}
ORACLES: dict[str, str] = {}
