"""run() against a brute-force version of every stage on a small corpus."""

import random
import re
from collections import Counter

import sentencepiece

import corpus_pipeline
from sentrel.llm import pieces, quality
from test_native import brute_lines
from test_near_dedup import kept


def brute_leaks(docs, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    windows = set()
    for t in items:
        w = words(t)
        windows |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9)) if w}
    return [(d, t) for d, t in docs if not any(tuple(words(t)[i : i + n]) in windows for n in {len(x) for x in windows} for i in range(len(words(t))))]


def test_run_against_brute_force(spark, tmp_path):
    rnd = random.Random(9)
    vocab = ["".join(rnd.choice(["ba", "né", "ri", "To", "lu"]) for _ in range(rnd.randrange(1, 4))) for _ in range(200)]
    line = lambda n: " ".join(rnd.choice(vocab) for _ in range(n))
    items = [line(25), line(14), line(4)]
    common = [line(6), line(12), "short one", ""]
    docs, labels = [], []
    for i in range(240):
        lines = [line(rnd.randrange(3, 30)) for _ in range(rnd.randrange(1, 5))] + rnd.sample(common, 2)
        if i % 9 == 0 and i:
            lines = docs[rnd.randrange(len(docs))][1].split("\n")
            w = lines[0].split(" ")
            w[rnd.randrange(len(w))] = "edited"
            lines[0] = " ".join(w)
        if i % 17 == 0:
            lines.append("x, " + items[i % 3].replace(" ", "; ", 2).upper() + " end")
        text = "\n".join(lines)
        if i % 6 == 0:
            text = " ".join([vocab[i % 200]] * 50)
        docs.append((i, text))
        labels.append((i, int(i % 6 != 0), 0))
    docs += [(500, ""), docs[7], (None, docs[9][1]), (None, "no id here, only a few words"), (11, "another text of an id that repeats"), (501, None)]
    spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(k, t) for k, t in enumerate(items)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    frame = spark.read.parquet(f"{tmp_path}/documents.parquet")
    model = quality.fit(frame, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    rows = Counter((r.doc_id, r.text) for r in quality.keep_good(frame, model).collect())
    assert 150 < sum(rows.values()) < len(docs)
    gone, left = brute_lines(rows), Counter()
    for (d, t), n in rows.items():
        lines, lost = (t or "").split("\n"), gone[d, t or ""]
        text = "\n".join(x for k, x in enumerate(lines) if k not in lost) if lost else t
        if not lost or text.strip():
            left[d, text] += n
    want = [(None if least[0] else least[1], texts) for least, texts in kept(list(left.elements()))]
    assert len(want) < sum(left.values())
    got = [(r.doc_id, tuple(r.ids), r.round_trip, r.n_chars) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    found = 0
    for d, texts in want:  # one of the texts that a group's least id has
        clean = brute_leaks([(d, t or "") for t in texts], items)
        match = [g for g in got if g[0] == d and any(g[1] == tuple(sp.encode(t)) and g[2] and g[3] == len(t) for _, t in clean)]
        assert bool(match) or len(clean) < len(texts)
        if match:
            got.remove(match[0])
            found += 1
    assert not got and found > 100


def test_rows_without_ids_and_repeated_ids_stay(spark, tmp_path):
    text = "seven words that make a base text " * 3
    rows = [(1, text), (5, text), (5, "unrelated text of five words or so"), (None, text), (None, "unrelated and without an id here"), (None, "another one that has no id at all"), (9, "twice the same row in here"), (9, "twice the same row in here"), (None, None)]
    spark.createDataFrame([(d, t, "x", "y") for d, t in rows], "doc_id long, text string, gone_id string, near_node string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    got = sorted((str(r.doc_id), sp.decode(r.ids)) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    want = [rows[0], rows[2], rows[4], rows[5], rows[6], (None, "")]
    assert got == sorted((str(d), t) for d, t in want)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
