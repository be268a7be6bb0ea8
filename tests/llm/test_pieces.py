import random
import struct
import time

import pytest
import sentencepiece

from sentrel.llm import pieces as P


@pytest.fixture(scope="module")
def both():
    return P.Tokenizer(P.load()), sentencepiece.SentencePieceProcessor(model_file=P.MODEL)


def texts():
    rnd = random.Random(7)
    alphabet = "abcdefgh  \n\tthe ing tion éß中☃xyzA.,0123"
    yield from ["", " ", "   ", "a", "a" * 5000, "hello world", "\x00\r\n", "The thing,  then: nothing!"]
    for _ in range(1500):
        yield "".join(rnd.choice(alphabet) for _ in range(rnd.randrange(60)))


def test_ids_equal_the_library_and_round_trip(both):
    mine, lib = both
    for t in texts():
        assert mine.encode(t).tolist() == lib.encode(t), t
        assert mine.decode(mine.encode(t)) == t


def test_stream_in_small_feeds_commits_early(both):
    """The window that is not committed yet stays within a few longest pieces, whatever the text's length."""
    mine, _ = both
    rnd = random.Random(3)
    for t in ["abc" * 7000, "the things that nothing brings " * 300, "a" * 10_000, "".join(rnd.choice("abcdefghij") for _ in range(20_000))]:
        y = P.SPACE + t.replace(" ", P.SPACE)
        s, got, widest = P.Stream(mine.v), [], 0
        for i in range(0, len(y), 5):
            got += sum(s.feed(y[i : i + 5]), [])
            widest = max(widest, len(s.text) - s.first)
        got += sum(s.feed("", end=True), [])
        assert got == mine.encode(t).tolist()
        assert widest <= 6 * mine.v.longest


def test_long_texts_without_spaces_are_linear(both):
    mine, lib = both
    rnd = random.Random(4)
    for make in (lambda n: "a" * n, lambda n: "".join(rnd.choice("abcdefghij") for _ in range(n))):
        t = make(300_000)
        began = time.process_time()
        got = mine.encode(t)
        assert time.process_time() - began < 20  # a second; quadratic work would take minutes
        assert got[:1000].tolist() == lib.encode(t[:20_000])[:1000] and mine.decode(got) == t


def message(*fields):
    """A protocol buffer message of (number, int, float or bytes)."""
    def varint(x):
        out = b""
        while x > 127:
            out, x = out + bytes([x & 127 | 128]), x >> 7
        return out + bytes([x])

    out = b""
    for n, x in fields:
        if isinstance(x, int):
            out += varint(n << 3) + varint(x)
        elif isinstance(x, float):
            out += varint(n << 3 | 5) + struct.pack("<f", x)
        else:
            out += varint(n << 3 | 2) + varint(len(x)) + x
    return out


def test_unigram_scores_are_compared():
    """A small unigram model put together by hand: the best sum of scores wins, as in the library."""
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(f"<0x{b:02X}>", -30.0, 6) for b in range(256)]
    words = {P.SPACE: -3.0, "a": -2.5, "b": -2.75, "c": -4.0, "ab": -4.5, "bc": -3.25, "abc": -7.5, "ca": -4.25, P.SPACE + "a": -4.0, "aba": -5.0, "cab": -5.75}
    pieces += [(w, x, 1) for w, x in words.items()]
    model = message(*((1, message((1, w.encode()), (2, x), (3, k))) for w, x, k in pieces), (2, message((3, 1), (35, 1))), (3, message((3, 1), (4, 0), (5, 1))))
    lib = sentencepiece.SentencePieceProcessor(model_proto=model)
    mine = P.Tokenizer(model)
    assert not mine.v.bpe and P.is_bpe(P.load())
    rnd = random.Random(1)
    for _ in range(500):
        t = "".join(rnd.choice("abc ") for _ in range(rnd.randrange(40)))
        assert mine.encode(t).tolist() == lib.encode(t), t
        assert mine.decode(mine.encode(t)) == t
    assert mine.encode("aéb").tolist() == lib.encode("aéb")


def test_documents(spark):
    rows = [(1, "one two"), (2, None), (3, ""), (None, "é\nx"), (1, "one two")]
    df = spark.createDataFrame([(d, t, 5) for d, t in rows], "doc_id long, text string, n_ids int")
    out = P.encode_documents(df).collect()
    assert len(out) == 5 and all(r.round_trip for r in out)
    assert {r.doc_id: r.text for r in P.decode_documents(P.encode_documents(df)).collect()} == {1: "one two", 2: "", 3: "", None: "é\nx"}
    assert P.encode_documents(spark.createDataFrame([], "doc_id long, text string")).collect() == []
