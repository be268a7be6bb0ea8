"""Quality classifier by co-training over two separate views of a document.

The text view reads the text alone: its words, hashed to slots, and measures of them (repetition, case, symbols, word and line
lengths). The metadata view reads the table's columns alone: language, source, their pair and the recorded length. Either is
an additive log-odds model over bins: a bin's score is the smoothed log ratio of its counts in good and bad documents,
and a logistic regression on labelled rows weighs the features. Over some rounds every unlabelled document is scored by
both views, and where one is sure (by its calibrated probability) and the other not sure of the opposite, the document's
counts go to the other view's bins. Both are then calibrated on labelled rows that made no counts, and a logistic
combination of the two scores all documents.

What the driver holds is bounded: at most ``LABELLED`` labelled rows, the first by a hash of doc_id, and tables of counts of a
fixed size. Everything else covers all documents: bin edges are quantiles of all, pseudo-labels come from all, and they
reach the models as counts summed in the executors. Texts are turned into features once, which are written and read by the rounds.

Defined cases: null and empty texts have zero features and no words; null or missing columns count as a value of
their own; without labels, or with fewer than four of a class, every score is the share of good labels (0.5 without
any); rows that repeat a doc_id are scored one by one, and one of them by a hash of its text stands for its label; empty
tables give empty results; other columns are ignored or kept as they are.
"""

from __future__ import annotations

import operator
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentrel.llm.common import fresh, lean, materialize, pick, release

LABELLED = 4000
ROUNDS = 3
#: A view is sure of a row at this probability or its complement.
SURE = 0.97
#: Bins of a measure, and slots of words and of metadata values.
BINS, SLOTS, VALUES = 10, 1 << 16, 1 << 10
#: Documents that a bin's log ratio is shrunk by.
SHRINK = 4.0
#: Score from which a document counts as good: losing a good document costs more than keeping a bad one.
KEEP = 0.3
#: Distinct words whose slots a worker keeps, and rows of features that are scored at a time.
CACHE, STEP = 100_000, 2048

_CLASS = np.zeros((256, 5))  # upper, lower, digit, symbol, other letters
_CLASS[65:91, 0] = _CLASS[97:123, 1] = _CLASS[48:58, 2] = 1
_CLASS[[ord(c) for c in "!#$%&*+/<=>@[\\]^_`{|}~"], 3] = 1
_CLASS[0xC2:0xF5, 4] = 1
#: Measures of a text, and values of the metadata.
MEASURES, META = 15, 4


class _Slots(dict):
    """Slots of words, looked up once a word."""

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE:
            self.clear()
        s = self[word] = zlib.crc32(word.encode(errors="replace")) % SLOTS
        return s


_slots = _Slots()


class _Slots(dict):
    """Slots of words, looked up once a word."""

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE:
            self.clear()
        s = self[word] = zlib.crc32(word.encode(errors="replace")) % SLOTS
        return s


_slots = _Slots()


def measures(text: str) -> list[float]:
    """Numbers that describe a text's words, characters and lines."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * MEASURES
    counts = Counter(words)
    upper, lower, digit, symbol, other = np.bincount(np.frombuffer(text.encode(errors="replace"), np.uint8), minlength=256) @ _CLASS
    letters, chars = max(upper + lower + other, 1.0), max(len(text), 1)
    repeated = sum(map(operator.eq, words, words[1:]))
    marked = sum(map(len, words))
    lines = list(map(len, text.split("\n")))
    return [
        np.log1p(n), len(counts) / n, max(counts.values()) / n, repeated / n, upper / letters, digit / chars, symbol / chars, marked / n,
        sum(1 for w in counts if not w[-1].isalnum()) / len(counts), text.count("!") / n, sum(1 for w in counts if len(w) == 1) / len(counts),
        np.log1p(len(lines)), np.log1p(max(lines)), sum(1 for s in lines if not s) / len(lines), sum(1 for s in lines if s < 40) / len(lines)]


def describe(text: str) -> tuple[list[float], set[int]]:
    """Numbers that describe a text's words, characters and lines, and the slots of its words."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * MEASURES, set()
    counts = Counter(words)
    upper, lower, digit, symbol, other = np.bincount(np.frombuffer(text.encode(errors="replace"), np.uint8), minlength=256) @ _CLASS
    letters, chars = max(upper + lower + other, 1.0), max(len(text), 1)
    repeated = sum(map(operator.eq, words, words[1:]))
    marked = sum(map(len, words))
    lines = list(map(len, text.split("\n")))
    return [
        np.log1p(n), len(counts) / n, max(counts.values()) / n, repeated / n, upper / letters, digit / chars, symbol / chars, marked / n,
        sum(1 for w in counts if not w[-1].isalnum()) / len(counts), text.count("!") / n, sum(1 for w in counts if len(w) == 1) / len(counts),
        np.log1p(len(lines)), np.log1p(max(lines)), sum(1 for s in lines if not s) / len(lines), sum(1 for s in lines if s < 40) / len(lines)], set(map(_slots.__getitem__, counts))


def meta_values(lang: str | None, source: str | None, n_chars: int | None) -> list[int]:
    """Slots of language, source, both, and the length in half powers of two."""
    size = -1 if n_chars is None else int(2 * np.log2(max(n_chars, 0) + 1))
    return [zlib.crc32(repr(x).encode(errors="replace")) % VALUES for x in (lang, source, (lang, source), size)]


def log_ratio(good: np.ndarray, bad: np.ndarray, all_good: float, all_bad: float) -> np.ndarray:
    """Log ratio of the shares of good and bad documents in each bin, shrunk towards 0 where there are few."""
    share = all_good / max(all_good + all_bad, 1.0)
    n = good + bad
    p = (good + SHRINK * share) / (n + SHRINK)
    with np.errstate(divide="ignore"):
        out = np.log(p / (1 - p)) - np.log(share / (1 - share))
    return np.where(n > 0, np.clip(out, -8, 8), 0.0)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float, steps: int = 25) -> np.ndarray:
    """Ridge logistic regression by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = sigmoid(x @ w)
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


class Rows:
    """Features of some documents: measures (n, MEASURES), words as slots with ends, metadata values (n, META)."""

    def __init__(self, x: np.ndarray, words: np.ndarray, ends: np.ndarray, meta: np.ndarray):
        self.x, self.words, self.ends, self.meta = x, words, ends, meta

    @staticmethod
    def of(texts: list[str | None], lang: list, source: list, n_chars: list) -> Rows:
        both = [describe(t or "") for t in texts]
        ends = np.cumsum([len(s) for _, s in both], dtype=np.int64)
        x = np.array([m for m, _ in both], np.float32).reshape(-1, MEASURES)
        meta = np.array([meta_values(*m) for m in zip(lang, source, n_chars)], np.int32).reshape(-1, META)
        return Rows(x, np.fromiter((k for _, s in both for k in s), np.int32), ends, meta)

    @staticmethod
    def read(b: pa.RecordBatch) -> Rows:
        x, words, meta = (b.column(c) for c in ("x", "words", "meta"))
        return Rows(x.flatten().to_numpy().reshape(-1, MEASURES), words.flatten().to_numpy(), np.cumsum(words.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)), meta.flatten().to_numpy().reshape(-1, META))

    def take(self, rows: np.ndarray) -> Rows:
        starts = np.r_[0, self.ends[:-1]].astype(np.int64)
        parts = [self.words[starts[r] : self.ends[r]] for r in rows]
        return Rows(self.x[rows], np.concatenate([np.zeros(0, np.int32), *parts]), np.cumsum([len(p) for p in parts], dtype=np.int64), self.meta[rows])


class View:
    """An additive log-odds model: a score per bin, and a weight per feature."""

    cells = 0

    def __init__(self) -> None:
        self.t = np.zeros(self.cells)
        self.w = np.zeros(1)

    def cells_of(self, r: Rows) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) of every bin that a row is in."""
        raise NotImplementedError

    def scores(self, r: Rows) -> np.ndarray:
        """A column per feature: the log ratio of its bin."""
        raise NotImplementedError

    def count(self, r: Rows, label: np.ndarray) -> np.ndarray:
        """Rows of class 0 and 1 per cell; other labels don't count."""
        row, cell = self.cells_of(r)
        return np.stack([np.bincount(cell[label[row] == k], minlength=self.cells) for k in (0, 1)])

    def fit(self, counts: np.ndarray, totals: np.ndarray, r: Rows, y: np.ndarray) -> None:
        """Score the bins by counts per class, and weigh the features on labelled rows."""
        self.t = log_ratio(counts[1].astype(float), counts[0].astype(float), totals[1], totals[0])
        x = self.scores(r)
        self.w = logistic(np.column_stack([np.ones(len(x)), x]), y, 1.0)

    def margin(self, r: Rows) -> np.ndarray:
        x = self.scores(r)
        return np.column_stack([np.ones(len(x)), x]) @ self.w


class TextView(View):
    cells = SLOTS + MEASURES * BINS

    def __init__(self, edges: np.ndarray) -> None:
        super().__init__()
        self.edges = edges  # (MEASURES, BINS - 1)

    def _bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], "right") for k, e in enumerate(self.edges)], axis=1)

    def cells_of(self, r: Rows) -> tuple[np.ndarray, np.ndarray]:
        n = len(r.x)
        row = np.repeat(np.arange(n), np.diff(np.r_[0, r.ends]))
        bins = self._bins(r.x) + SLOTS + np.arange(MEASURES) * BINS
        return np.r_[row, np.repeat(np.arange(n), MEASURES)], np.r_[r.words, bins.ravel()]

    def scores(self, r: Rows) -> np.ndarray:
        sums = np.r_[0, np.cumsum(self.t[r.words])]
        size = np.diff(np.r_[0, r.ends])
        mean = (sums[r.ends] - sums[r.ends - size]) / np.maximum(size, 1)
        bins = self._bins(r.x) + SLOTS + np.arange(MEASURES) * BINS
        return np.column_stack([4 * mean, self.t[bins]])


class MetaView(View):
    cells = META * VALUES

    def cells_of(self, r: Rows) -> tuple[np.ndarray, np.ndarray]:
        return np.repeat(np.arange(len(r.meta)), META), (r.meta + np.arange(META) * VALUES).ravel()

    def scores(self, r: Rows) -> np.ndarray:
        return self.t[r.meta + np.arange(META) * VALUES]


class Model:
    """Two views, their calibration and combination; ``base`` alone where there was nothing to learn from."""

    def __init__(self, base: float, views: list[View] | None = None):
        self.base, self.views = base, views
        self.platt: list[np.ndarray] = []
        self.mix: np.ndarray | None = None

    def calibrate(self, r: Rows, y: np.ndarray) -> None:
        margins = [v.margin(r) for v in self.views]
        self.platt = [logistic(np.column_stack([np.ones(len(y)), m]), y, 0.1) for m in margins]
        z = [a * m + b for m, (b, a) in zip(margins, self.platt)]
        self.mix = logistic(np.column_stack([np.ones(len(y)), *z]), y, 0.1)

    def scores(self, r: Rows) -> np.ndarray:
        """Columns: combined score, text view, metadata view."""
        if self.views is None:
            return np.full((len(r.x), 3), self.base)
        z = [a * v.margin(r) + b for v, (b, a) in zip(self.views, self.platt)]
        whole = sigmoid(np.column_stack([np.ones(len(r.x)), *z]) @ self.mix)
        return np.column_stack([whole, *map(sigmoid, z)])

    def pseudo_labels(self, r: Rows, sure: float) -> list[np.ndarray]:
        """Per view what the other one teaches it: 1 or 0 where that is sure and this not of the opposite, else -1."""
        p = self.scores(r)[:, 1:]
        said = np.where(p >= sure, 1, np.where(p <= 1 - sure, 0, -1))
        return [np.where((said[:, me] >= 0) & (said[:, me] != said[:, other]), -1, said[:, other]) for me, other in ((0, 1), (1, 0))]


#: Columns of the two views; those that a table lacks are null.
_COLUMNS = {"text": "string", "lang": "string", "source": "string", "n_chars": "long"}


def _source(docs: DataFrame) -> DataFrame:
    have = set(docs.columns)
    return docs.select("doc_id", *((F.col(f"`{c}`") if c in have else F.lit(None)).cast(k).alias(c) for c, k in _COLUMNS.items()))


def _parts(whole: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    return (whole.slice(i, 512) for i in range(0, whole.num_rows, 512))


def _rows_of(b: pa.RecordBatch) -> Rows:
    return Rows.of(*(b.column(c).to_pylist() for c in _COLUMNS))


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, tag, x, words, meta) of every row."""
    src = _source(docs).withColumn("tag", F.xxhash64("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def lists(values: np.ndarray, ends: np.ndarray) -> pa.Array:
            return pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.array(values))

        for whole in batches:
            for b in _parts(whole):
                r, n = _rows_of(b), b.num_rows
                out = [b.column("doc_id"), b.column("tag"), lists(r.x.ravel(), np.arange(1, n + 1) * MEASURES), lists(r.words, r.ends), lists(r.meta.ravel(), np.arange(1, n + 1) * META)]
                yield pa.RecordBatch.from_arrays(out, names=["doc_id", "tag", "x", "words", "meta"])

    return src.mapInArrow(lean(run), f"doc_id {src.schema['doc_id'].dataType.simpleString()}, tag long, x array<float>, words array<int>, meta array<int>")


def _counted(free: DataFrame, model: Model, sure: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """Counts per view of the rows that the other view is sure of: sparse tables, summed in the executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros((2, v.cells + 1), np.int64) for v in model.views]  # the last cell counts rows
        for whole in batches:
            for b in (whole.slice(i, STEP) for i in range(0, whole.num_rows, STEP)):
                r = Rows.read(b)
                for t, v, label in zip(total, model.views, model.pseudo_labels(r, sure)):
                    t[:, :-1] += v.count(r, label)
                    t[:, -1] += np.bincount(label[label >= 0], minlength=2)
        at = [np.argwhere(t) for t in total]
        view = np.repeat(np.arange(2, dtype=np.int32), [len(a) for a in at])
        kind, cell = np.concatenate(at).T
        yield pa.RecordBatch.from_arrays([pa.array(view), pa.array(kind.astype(np.int32)), pa.array(cell.astype(np.int32)), pa.array(np.concatenate([t[tuple(a.T)] for t, a in zip(total, at)]))], names=["view", "kind", "cell", "n"])

    got = free.mapInArrow(lean(run), "view int, kind int, cell int, n long").groupBy("view", "kind", "cell").agg(F.sum("n").alias("n")).toArrow()  # at most the cells of the tables
    out = []
    for k, v in enumerate(model.views):
        t, own = np.zeros((2, v.cells + 1), np.int64), got.column("view").to_numpy() == k
        t[got.column("kind").to_numpy()[own], got.column("cell").to_numpy()[own]] = got.column("n").to_numpy()[own]
        out.append((t[:, :-1], t[:, -1].astype(float)))
    return out


def _labelled(table: DataFrame, labels: DataFrame, most: int) -> tuple[Rows, np.ndarray, DataFrame]:
    """Features and labels of at most ``most`` documents, and the rows of the others."""
    known = pick(labels, "doc_id", "quality").where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    mine = table.join(F.broadcast(known), "doc_id").groupBy("doc_id").agg(F.min(F.struct("tag", "x", "words", "meta", "quality")).alias("r"))
    got = sorted(mine.select("doc_id", "r.*").collect(), key=lambda r: zlib.crc32(str(r.doc_id).encode()))  # at most ``most`` rows
    words = [np.array(r.words, np.int32) for r in got]
    rows = Rows(np.array([r.x for r in got], np.float32).reshape(-1, MEASURES), np.concatenate([np.zeros(0, np.int32), *words]), np.cumsum([len(w) for w in words], dtype=np.int64), np.array([r.meta for r in got], np.int32).reshape(-1, META))
    free = table.join(F.broadcast(known.select("doc_id")), "doc_id", "left_anti").select("x", "words", "meta")
    return rows, np.array([r.quality for r in got], float), free


def fit_features(table: DataFrame, labels: DataFrame, labelled: int = LABELLED, rounds: int = ROUNDS, sure: float = SURE) -> Model:
    """A model from a bounded sample of (doc_id, quality) and from all other rows of features()."""
    rows, y, free = _labelled(table, labels, labelled)
    if len(y) < 8 or min(y.sum(), (1 - y).sum()) < 4:
        return Model(float(y.mean()) if len(y) else 0.5)
    cut = [k / BINS for k in range(1, BINS)]
    # quantiles of all documents; the tables' sketches are merged, no rows are
    edges = np.array(table.agg(*(F.percentile_approx(F.get("x", F.lit(k)), cut, 1000).alias(f"q{k}") for k in range(MEASURES))).first(), np.float32)
    # half of the labelled rows make counts, a quarter weighs the features, a quarter calibrates
    part = np.arange(len(y)) % 4
    counts, weigh, hold = ((rows.take(np.flatnonzero(k)), y[k]) for k in (part < 2, part == 2, part == 3))
    model = Model(float(y.mean()), [TextView(edges), MetaView()])
    label = counts[1].astype(int)
    own = [(v.count(counts[0], label), np.bincount(label, minlength=2).astype(float)) for v in model.views]
    taught = [(np.zeros_like(c), np.zeros(2)) for c, _ in own]
    for k in range(rounds + 1):
        for v, (c, n), (more, m) in zip(model.views, own, taught):
            v.fit(c + more, n + m, *weigh)
        model.calibrate(*hold)
        if k < rounds:
            taught = _counted(free, model, sure)
    return model


def fit(docs: DataFrame, labels: DataFrame, **how) -> Model:
    """A model of documents; their features are written for the rounds and deleted."""
    table = materialize(features(docs), "features")
    model = fit_features(table, labels, **how)
    release(table)
    return model


def _scored(ids: pa.Array, model: Model, r: Rows, keep: float) -> pa.RecordBatch:
    s = model.scores(r)
    return pa.RecordBatch.from_arrays([ids, *(pa.array(s[:, k]) for k in range(3)), pa.array((s[:, 0] >= keep).astype(np.int32))], names=["doc_id", "score", "text_score", "meta_score", "predicted"])


def score(docs: DataFrame, model: Model, keep: float = KEEP, ready: bool = False) -> DataFrame:
    """(doc_id, score, text_score, meta_score, predicted) of every row; ``ready`` rows are those of features()."""
    src = pick(docs, "doc_id", "x", "words", "meta") if ready else _source(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in _parts(whole):
                yield _scored(b.column("doc_id"), model, Rows.read(b) if ready else _rows_of(b), keep)

    return src.mapInArrow(lean(run), f"doc_id {src.schema['doc_id'].dataType.simpleString()}, score double, text_score double, meta_score double, predicted int")


def keep_good(docs: DataFrame, model: Model, keep: float = KEEP) -> DataFrame:
    """The rows of documents that the model accepts, all columns as they are."""
    names = fresh(docs, *(f"view_{c}" for c in _COLUMNS))
    have = set(docs.columns)
    src = docs.select("*", *((F.col(f"`{c}`") if c in have else F.lit(None)).cast(k).alias(n) for n, (c, k) in zip(names, _COLUMNS.items())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in _parts(whole):
                s = model.scores(Rows.of(*(b.column(n).to_pylist() for n in names)))
                yield b.select(b.schema.names[: -len(names)]).filter(pa.array(s[:, 0] >= keep))

    return src.mapInArrow(lean(run), docs.schema)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model from the labels' bounded sample and all documents; all documents scored."""
    table = materialize(features(spark.read.parquet(f"{sf_dir}/documents.parquet")), "features")
    return score(table, fit_features(table, spark.read.parquet(f"{sf_dir}/labels.parquet")), ready=True)


QUERIES = {"op7_quality": op7_quality}
ORACLES: dict[str, str] = {}
