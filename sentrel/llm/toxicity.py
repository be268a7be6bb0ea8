"""Toxicity: a noisy-channel decoder restores disguised words, then a model scores the restored text.

The channel: a letter may be written as a look-alike digit or sign, repeated, or set apart by spaces or
signs. What was meant is decoded by Viterbi over the lattice of readings of a token (or of a run of short tokens), with a
character trigram language model counted over all documents. Tokens of plain letters, none of them doubled, have
one reading. Tokens without any letter are read if they hold a look-alike sign; plain numbers stay numbers.

The model: words of the restored text, and their beginnings of four to six letters, get a shrunk log ratio of their distinct
lines in toxic and in clean labelled documents; lines are counted once whatever their copies, and a line that clean documents
have too is clean. Keys that lean to toxic make the lexicon, all of them; every word, whether it leans or not, also
counts in a table of hashed slots. A logistic model over a text's strongest and second hit, the number of strong hits and the mean
of its words' slots gives a probability. All are fitted on at most ``LABELLED`` labelled rows, the first by a hash of doc_id.

Defined cases: null and empty texts have no hit and no words and score like any such text; doc_id null counts as the
text ``null`` for the fold; rows that repeat are scored one by one; without labels every score is 0, with labels
of one class its share; empty tables give empty results; other columns are ignored whatever their names.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sentrel.llm.common import lean, materialize, pick, release
from sentrel.llm.quality import logistic, sigmoid

LABELLED = 20_000
THRESHOLD = 0.7
#: Lines that a log ratio is shrunk by, and the least log ratio of a lexicon key.
SHRINK, LEANS = 50.0, 0.5
PREFIXES = (4, 5, 6)
#: Log ratio from which a hit counts as a strong one.
STRONG = 2.0
#: Slots of the words' table.
SLOTS = 1 << 16
#: Features of a text.
FEATURES = 4
#: Letters of a token that may be a part of a spaced word, and the least letters of such a word.
CHUNK, SPACED = 3, 3
#: Letters of the language model; all other characters are boundaries (class 0).
LETTERS = "abcdefghijklmnopqrstuvwxyzßàáâäæçèéêëìíîïñòóôöùúûüœ"
N = len(LETTERS) + 1
_CODE = np.zeros(0x180, np.int64)
for _i, _c in enumerate(LETTERS):
    _CODE[ord(_c)] = _i + 1
CLASS = {c: i + 1 for i, c in enumerate(LETTERS)}
#: Readings of signs and digits.
LOOKS = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "(": "c"}
#: Log costs of the channel: a look-alike, a dropped separator, a kept one, each dropped repetition.
LOOK, DROP, KEEP_GAP, REPEAT = -1.0, -0.5, -1.0, -0.4
#: Log cost of reading a look-alike as no letter at all.
NO_LETTER = -6.0
CACHE = 400_000
_EDGE = re.compile(r"^(?:(?![@$€+|!(0-9])[\W_])+|[\W_]+$")
_PLAIN = re.compile(r"[^\W\d_]+\Z")
_TWICE = re.compile(r"(.)\1", re.S)
_PARTS = re.compile(r"[^\W_]+")


def trigram_counts(text: str) -> np.ndarray:
    """Flat trigram classes of a text; two boundaries on either side belong to it."""
    cp = np.frombuffer(text.lower().encode("utf-32-le", errors="replace"), np.uint32)
    c = _CODE[np.where(cp < len(_CODE), cp, 0)]
    return (c[:-2] * N + c[1:-1]) * N + c[2:] if len(c) > 2 else np.zeros(0, np.int64)


def language_model(docs: DataFrame) -> np.ndarray:
    """Log probabilities [before, last, next] of letters over all documents; the table's size is fixed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(N**3, np.int64)
        for whole in batches:
            for b in (whole.slice(i, 512) for i in range(0, whole.num_rows, 512)):
                joined = "\n\n" + "".join(f"{x}\n\n" for x in b.column("text").to_pylist() if x)  # no trigram holds letters of two texts
                for left in range(0, len(joined), 1 << 20):
                    total += np.bincount(trigram_counts(joined[left : left + (1 << 20) + 2]), minlength=N**3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["at", "n"])

    rows = pick(docs, "text").mapInArrow(lean(run), "at long, n long").groupBy("at").agg(F.sum("n").alias("n"))
    table = rows.toArrow()  # at most N**3 rows
    count = np.zeros(N**3)
    count[table.column("at").to_numpy()] = table.column("n").to_numpy()
    count = count.reshape(N, N, N)
    uni = count.sum((0, 1)) + 1
    bi = count.sum(0) + 5 * (uni / uni.sum())
    bi /= bi.sum(1, keepdims=True)
    tri = count + 5 * bi[None, :, :]
    return np.log(tri / tri.sum(2, keepdims=True))


class Decoder:
    """Viterbi over the readings of a disguised string."""

    def __init__(self, lm: np.ndarray):
        self.lm = lm

    @staticmethod
    def readings(text: str) -> list[list[tuple[str, float]]]:
        """Per group of equal characters: what it may stand for, and the channel's log cost."""
        out = []
        i = 0
        while i < len(text):
            c, k = text[i], 1
            while i + k < len(text) and text[i + k] == c:
                k += 1
            i += k
            if c in CLASS:
                opts = [(c, REPEAT * (k - 1))]
                if k > 1:
                    opts.append((c + c, REPEAT * (k - 2)))
            elif c in LOOKS:
                opts = [(x, LOOK + REPEAT * (k - 1)) for x in LOOKS[c]] + [(" ", NO_LETTER)]
            else:
                opts = [("", DROP), (" ", KEEP_GAP)]
            out.append(opts)
        return out

    def restore(self, text: str) -> str:
        """The likeliest reading; words are parted by single spaces."""
        lm = self.lm
        # state: the last two classes; kept: score, backpointer chain
        states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
        for opts in self.readings(text):
            new: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (a, b), (s, chain) in states.items():
                for said, cost in opts:
                    x, y, t = a, b, s + cost
                    for c in said:
                        z = CLASS.get(c, 0)
                        t += lm[x, y, z]
                        x, y = y, z
                    old = new.get((x, y))
                    if old is None or t > old[0]:
                        new[x, y] = (t, (chain, said) if said else chain)
            states = new
        best = max(((s + lm[a, b, 0], chain) for (a, b), (s, chain) in states.items()), key=lambda r: r[0])[1]
        out = []
        while best is not None:
            best, said = best
            out.append(said)
        return " ".join("".join(reversed(out)).split())


def keys_of(word: str) -> list[str]:
    """A word and its beginnings, as lexicon keys."""
    return [word, *(f"{word[:k]}~" for k in PREFIXES if len(word) >= k)]


def slot_of(word: str) -> int:
    return zlib.crc32(word.encode(errors="replace")) % SLOTS


def plain_words(text: str) -> set[str]:
    return {w for w in _PARTS.findall(text.lower()) if not w.isdigit()}


class Scorer:
    """Scores texts with a lexicon {key: weight}, the slots' table, a decoder and the logistic weights."""

    def __init__(self, lexicon: dict[str, float], slots: np.ndarray, lm: np.ndarray, w: np.ndarray):
        self.lexicon, self.slots, self.w, self.decoder = lexicon, slots, w, Decoder(lm)
        self.starts = {k[:n] for k in lexicon if not k.endswith("~") for n in range(1, len(k) + 1)}
        #: Per token: its hit as (weight, word) or None, and its words' slot weights, summed, and number.
        self.known: dict[str, tuple[tuple[float, str] | None, float, int]] = {}

    def _look_up(self, words: list[str]) -> tuple[float, str] | None:
        found = [(x, w) for w in words for k in keys_of(w) if (x := self.lexicon.get(k)) is not None]
        return max(found) if found else None

    def _token(self, token: str) -> tuple[tuple[float, str] | None, float, int]:
        core = _EDGE.sub("", token)
        words = [w for w in _PARTS.findall(token) if not w.isdigit()]
        plain = _PLAIN.match(core) is not None
        letters = any(c in CLASS for c in token)
        hit = self._look_up(words)
        read = (letters and not plain) or (plain and hit is None and _TWICE.search(core)) or (not letters and len(core) > 2 and not core.isdigit() and all(c in LOOKS for c in core))
        if read:
            restored = self.decoder.restore(core).split()
            hit = max((h for h in (hit, self._look_up(restored)) if h is not None), default=None)
            words = restored or words
        out = (hit, float(sum(self.slots[slot_of(w)] for w in words)), len(words))
        if len(token) <= 64:
            if len(self.known) >= CACHE:
                self.known.clear()
            self.known[token] = out
        return out

    def _spaced(self, tokens: list[str]) -> Iterator[tuple[float, str]]:
        """Hits among words that spaces set apart: runs of single letters, or of parts that make a lexicon word."""
        short = [len(t) <= CHUNK + 2 for t in tokens]
        i, n = 0, len(tokens)
        while i < n:
            if not short[i]:
                i += 1
                continue
            j = i
            run = []
            while j < n and short[j] and 0 < len(c := tokens[j].strip(".,-_*")) <= CHUNK:
                run.append(c)
                j += 1
            single = [len(c) == 1 for c in run]
            if len(run) > 1 and any(single):
                a = 0
                while a < len(run):  # single letters
                    b = a
                    while b < len(run) and single[b]:
                        b += 1
                    if b - a >= SPACED and len(set(run[a:b])) > 1 and (h := self._look_up(self.decoder.restore(" ".join(run[a:b])).split())):
                        yield h
                    a = b + 1
            for a in range(len(run) - 1):
                joined = run[a]
                for b in range(a + 1, len(run)):
                    if joined not in self.starts:
                        break
                    joined += run[b]
                    if len(joined) >= SPACED and joined in self.lexicon and joined in self.decoder.restore(" ".join(run[a : b + 1])).split():
                        yield self.lexicon[joined], joined
            i = max(j, i + 1)

    def read(self, text: str) -> tuple[dict[str, float], float]:
        """Distinct words of the text that the lexicon knows, with their weights, and the mean of its words' slots."""
        tokens = text.lower().split()
        known, out, total, n = self.known, {}, 0.0, 0
        for t in sorted(set(tokens)):
            hit, s, k = known[t] if t in known else self._token(t)
            total, n = total + s, n + k
            if hit is not None:
                out[hit[1]] = hit[0]
        for weight, word in self._spaced(tokens):
            out[word] = weight
        return out, total / max(n, 1)

    def hits(self, text: str) -> dict[str, float]:
        return self.read(text)[0]

    def features(self, text: str) -> tuple[float, ...]:
        h, mean = self.read(text)
        top = sorted(h.values(), reverse=True)[:2]
        return (*top, *[0.0] * (2 - len(top)), math.log1p(sum(w >= STRONG for w in h.values())), 4 * mean)

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(np.column_stack([np.ones(len(x)), x]) @ self.w)


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo three."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary")) % 3).cast("int")


def _labelled(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """At most ``most`` labelled rows outside the held-out fold: (doc_id, text, toxic)."""
    known = pick(labels, "doc_id", "toxic").where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (fold(F.col("doc_id")) != 1))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return pick(docs, "doc_id", "text").join(F.broadcast(known), "doc_id").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.col("toxic").cast("int").alias("toxic"))


def log_ratio(bad: np.ndarray, good: np.ndarray, share: float) -> np.ndarray:
    """Log odds of toxic lines over those of all, shrunk towards 0 where there are few lines."""
    p = (bad + SHRINK * share) / (bad + good + SHRINK)
    return np.log(p / (1 - p)) - math.log(share / (1 - share))


def prune(lexicon: dict[str, float]) -> dict[str, float]:
    """Without beginnings that clean lines share where a longer key is purer."""
    longer: dict[str, float] = {}
    for k, w in lexicon.items():
        for n in range(1, len(k.rstrip("~"))):
            longer[k[:n]] = max(longer.get(k[:n], 0.0), w)
    return {k: w for k, w in lexicon.items() if not k.endswith("~") or w >= longer.get(k[:-1], 0.0) - 1}


def learn(rows: DataFrame) -> tuple[dict[str, float], np.ndarray]:
    """The lexicon {key: weight} and the slots' table from rows (text, toxic), by distinct lines."""
    lines = rows.select(F.explode(F.split(F.lower("text"), "\n")).alias("line"), "toxic").groupBy("line").agg(F.min("toxic").alias("toxic"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = [Counter(), Counter()]

        def flush() -> pa.RecordBatch:
            keys = list(n[0].keys() | n[1].keys())
            out = pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([n[1][k] for k in keys], pa.int64()), pa.array([n[0][k] for k in keys], pa.int64())], names=["key", "bad", "good"])
            n[0].clear()
            n[1].clear()
            return out

        for b in batches:
            for line, toxic in zip(b.column("line").to_pylist(), b.column("toxic").to_pylist()):
                words = plain_words(line)
                n[1 if toxic else 0].update({k for w in words for k in keys_of(w)} | {f" {slot_of(w)}" for w in words} | {""})
                if len(n[0]) + len(n[1]) > 300_000:
                    yield flush()
        yield flush()

    counts = lines.mapInArrow(lean(run), "key string, bad long, good long").groupBy("key").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    counts = materialize(counts, "word-counts")
    total = counts.where("key = ''").first()
    slots = np.zeros(SLOTS, np.float32)
    if not total or not total.bad or not total.good:
        return {}, slots
    share = total.bad / (total.bad + total.good)
    table = counts.where("startswith(key, ' ')").toArrow()  # at most SLOTS rows
    slots[[int(k) for k in table.column("key").to_pylist()]] = log_ratio(table.column("bad").to_numpy().astype(float), table.column("good").to_numpy().astype(float), share)
    # a key of log ratio LEANS or more has this share of toxic lines at least
    least = 1 / (1 + math.exp(-(LEANS + math.log(share / (1 - share)))))
    leaning = counts.where((F.col("key") != "") & ~F.startswith("key", F.lit(" ")) & ((F.col("bad") + SHRINK * share) / (F.col("bad") + F.col("good") + SHRINK) >= least))
    got = leaning.toArrow()  # keys of the labelled rows, of which there are at most LABELLED
    lexicon = dict(zip(got.column("key").to_pylist(), log_ratio(got.column("bad").to_numpy().astype(float), got.column("good").to_numpy().astype(float), share).tolist()))
    release(counts)
    return prune(lexicon), slots


def fit(docs: DataFrame, labels: DataFrame, most: int = LABELLED) -> Scorer:
    """Language model over all documents; lexicon, slots and weights over the labelled sample."""
    rows = _labelled(docs, labels, most)
    # two thirds of the sample make the lexicon, the rest calibrates it on texts that it hasn't seen
    part = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(3))
    scorer = Scorer(*learn(rows.where(part != 2)), language_model(docs), np.zeros(FEATURES + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [list(scorer.features(t)) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), b.column("toxic").cast(pa.int32()), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "y", "x"])

    # a row per document, at most a third of the sample
    held = rows.where(part == 2).mapInArrow(lean(run), "doc_id long, y int, x array<double>").groupBy("doc_id").agg(F.min(F.struct("x", "y")).alias("r")).select("doc_id", "r.*").toArrow().to_pydict()
    order = np.argsort(np.array(held["doc_id"], np.int64))
    y, x = np.array(held["y"], float)[order], np.array(held["x"], float).reshape(-1, FEATURES)[order]
    if not len(y) or not 0 < y.sum() < len(y):
        base = float(y.mean()) if len(y) else 0.0
        scorer.w[0] = math.log(max(base, 1e-9) / max(1 - base, 1e-9))
        return scorer
    scorer.w = logistic(np.column_stack([np.ones(len(x)), x]), y, 0.05)
    return scorer


def score(docs: DataFrame, scorer: Scorer, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted, n_hits) of every row, over whole texts; n_hits counts the strong ones."""
    src = pick(docs, "doc_id", "text").select("doc_id", "text", (fold(F.col("doc_id")) == 1).alias("held_out"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in (whole.slice(i, 1024) for i in range(0, whole.num_rows, 1024)):
                x = np.array([scorer.features(t or "") for t in b.column("text").to_pylist()], float).reshape(-1, FEATURES)
                s = scorer.score(x)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(s), pa.array((s >= threshold).astype(np.int32)), pa.array(np.rint(np.expm1(x[:, 2])).astype(np.int64))], names=["doc_id", "held_out", "score", "predicted", "n_hits"])

    return src.mapInArrow(lean(run), f"doc_id {src.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int, n_hits long")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


QUERIES = {"op10_toxicity": op10_toxicity}
ORACLES: dict[str, str] = {}
