"""WARC archives and SentencePiece: exact round trips and faults."""

import base64
import hashlib
import itertools
import random
import struct

import pytest
import zstandard
from helpers import docs, rows
from pyspark.sql import functions as F

from vigil.llm import pieces, warc

PAGES = "page_id long, url string, html string, name string, offset string"


def pages(spark, data):
    return spark.createDataFrame([(i, u, h, "n", "o") for i, u, h in data], PAGES)


def brute(data):
    best = {}
    for i, _, h in data:
        best[h or ""] = max(best.get(h or "", -1), -1 if i is None else i)
    out = []
    for i, _, h in data:
        raw, first = (h or "").encode(), best[h or ""]
        again = first >= 0 and first != i
        out.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response",
                    first if again else None))
    return sorted(out, key=repr)


COLS = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def test_round_trip(spark):
    rng = random.Random(5)
    data = [(i, f"http://h/{i} é\r\nX: y", "<p>" + "".join(rng.choices("abcé\r\n", k=rng.randrange(400))) + "</p>") for i in range(300)]
    data += [(300 + i, None, "same") for i in range(40)] + [(400, "u", None), (401, "u", ""), (402, "u", "x" * 300_000)]
    data += [(None, "u", "same"), (None, "v", "only null"), (500, "u", "twice"), (500, "u", "twice")]
    got = warc.round_trip(pages(spark, data).repartition(3))
    assert rows(got, *COLS) == brute(data)
    assert got.where("error is not null").count() == 0
    texts = {r.page_id: bytes(r.payload) for r in got.where("record_type = 'response' and page_id < 300").collect()}
    assert texts == {i: (h or "").encode() for i, _, h in data[:300]}


def test_empty_and_small_archives(spark):
    assert warc.round_trip(pages(spark, [])).count() == 0
    data = [(i, "u", "y" * 50 + str(i)) for i in range(30)]
    assert rows(warc.round_trip(pages(spark, data), max_archive_bytes=500), *COLS) == brute(data)


def test_dictionary_is_used():
    samples = [warc.record(i, "http://e/", f"<html><body>{'word ' * 30}{i}</body></html>".encode() * 3, None, False, "d") for i in range(200)]
    book = zstandard.train_dictionary(4096, samples, d=8, k=256)
    frames = [zstandard.ZstdCompressor(dict_data=book).compress(s) for s in samples]
    lead = warc.dictionary_frame(book.as_bytes())
    got = list(warc.read_archive(lead + b"".join(frames)))
    assert len(got) == 200 and all(r["error"] is None for r in got)
    plain = struct.pack("<II", warc.DICT_FRAME, len(book.as_bytes())) + book.as_bytes()
    assert [r["payload_digest"] for r in warc.read_archive(plain + frames[0])] == [got[0]["payload_digest"]]
    # Without, or with a broken, dictionary the frames can't be read.
    assert "dictionary" in next(warc.read_archive(frames[0]))["error"]
    assert "no dictionary" in next(warc.read_archive(struct.pack("<II", warc.DICT_FRAME, 4) + b"abcd" + frames[0]))["error"]


def bad(change):
    return warc.parse_record(change(warc.record(1, "http://e/", b"payload", None, False, "d")))["error"]


def test_faults():
    assert bad(lambda r: r) is None
    assert "version" in bad(lambda r: r.replace(b"WARC/1.1", b"WARC/9"))
    assert "content-length" in bad(lambda r: r.replace(b"\r\nContent-Length", b"\r\nContent-Size", 1))
    assert "no number" in bad(lambda r: r.replace(b"msgtype=response\r\nContent-Length: ", b"msgtype=response\r\nContent-Length: x", 1))
    assert "shorter" in bad(lambda r: r[:-8])
    assert "empty lines" in bad(lambda r: r + b"more")
    assert "digest" in bad(lambda r: r.replace(b"payload\r\n", b"payloaD\r\n"))
    assert "HTTP length" in bad(lambda r: r.replace(b"Content-Length: 7\r\n\r\npayload", b"Content-Length: 8\r\n\r\npayload"))
    assert "header" in bad(lambda r: r.replace(b"WARC-Date: d", b"WARC-Date d"))
    assert warc.parse_record(b"")["error"]
    frame = zstandard.ZstdCompressor().compress(warc.record(1, "u", b"p" * 500, None, False, "d"))
    got = list(warc.read_archive(frame + frame[:-3]))
    assert got[0]["error"] is None and "cut off" in got[1]["error"]
    assert "archive" in list(warc.read_archive(b"garbage and more garbage"))[0]["error"]
    two = zstandard.ZstdCompressor().compress(warc.record(1, "u", b"", None, False, "d") * 2)
    assert "more than one" in list(warc.read_archive(two))[0]["error"]


# -- SentencePiece ----------------------------------------------------------------------

@pytest.fixture(scope="module")
def model():
    with open(pieces.MODEL, "rb") as f:
        return pieces.load_model(f.read())


@pytest.fixture(scope="module")
def library():
    """The library's own Viterbi over the same pieces and scores."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    with open(pieces.MODEL, "rb") as f:
        proto.ParseFromString(f.read())
    proto.trainer_spec.model_type = pb.TrainerSpec.UNIGRAM
    return sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())


def ids(model, text):
    import numpy as np

    return np.frombuffer(pieces.Encoder(model).encode(text), dtype=np.int32).tolist()


TEXTS = ["Hello world", "The quick brown fox jumps", "naïve café über", "日本語 text", "unbelievably long compound", "a", "def f(x): return x"]


@pytest.mark.parametrize("text", TEXTS)
def test_viterbi_equals_the_library(model, library, text):
    want = library.encode(text)
    got = ids(model, text)
    score = lambda x: sum(library.get_score(i) for i in x)
    assert score(got) == pytest.approx(score(want)) and len(got) == len(want)
    assert got == want


def brute_best(m, text):
    """Best score by plain dynamic programming over the whole text."""
    best = [0.0] + [None] * len(text)
    for i in range(len(text)):
        alone = False
        for j in range(i + 1, min(len(text), i + m.longest) + 1):
            hit = m.pieces.get(text[i:j])
            if hit:
                alone |= j == i + 1
                s = best[i] + hit[1]
                best[j] = s if best[j] is None else max(best[j], s)
        if not alone:
            s = best[i] + m.unk_score
            best[i + 1] = s if best[i + 1] is None else max(best[i + 1], s)
    return best[-1]


def test_streaming_is_optimal(model):
    rng = random.Random(2)
    for _ in range(60):
        text = "".join(rng.choices("theandingstr▁é\n日 ", k=rng.randrange(1, 120))).replace(" ", "▁")
        got = list(pieces.viterbi(model, text))
        assert pieces.decode(model, got) == (text.replace("▁", " ")[1:] if text.startswith("▁") else text.replace("▁", " "))
        known = [i for i in got if i not in model.bytes_]
        unknown = [c for c in text if c not in model.pieces]
        total = sum(model.pieces[p][1] for p in _pieces(model, known)) + len(unknown) * model.unk_score
        assert total == pytest.approx(brute_best(model, text))


def words(rng, n):
    """Distinct short stretches, with characters that have no piece and some that only stand inside pieces."""
    some = "theandingstrou" * 3 + "▁éñß日本\n.,-0189\t\x00\U0001f600\U000e0041\ue000"
    return sorted({"▁" * rng.randrange(2) + "".join(rng.choices(some, k=rng.randrange(1, 30))) for _ in range(n)})


def test_side_by_side_equals_one_by_one(model):
    rng = random.Random(7)
    some = sorted([*words(rng, 3_000), "x" * 64, "the" * 21, "\ue000" * 64], key=len, reverse=True)
    got = pieces.Lattice(model).search(some)
    assert [memoryview(x).cast("i").tolist() for x in got] == [list(pieces.whole(model, s)) for s in some]
    assert [memoryview(x).cast("i").tolist() for x in got] == [list(pieces.viterbi(model, s)) for s in some]


def test_side_by_side_ties_and_no_bytes():
    """Equal scores, a character only inside pieces, a model without byte pieces."""
    for table in ({"a": (1, -1.0), "aa": (2, -2.0), "aaa": (3, -3.0), "ab": (4, -1.0), "bca": (5, -2.0)}, {"ab": (1, -1.0)}, {}):
        m = pieces.Model(table, [], 0, -12.0, [], False, False)
        m.longest, m.singles = max(map(len, table), default=1), {p for p in table if len(p) == 1}
        for p, found in table.items():
            node = m.trie
            for c in p:
                node = node.setdefault(c, {})
            node[pieces.PIECE] = found
        some = sorted({"".join(c) for n in range(1, 7) for c in itertools.product("abc", repeat=n)}, key=len, reverse=True)
        got = pieces.Lattice(m).search(some)
        assert [memoryview(x).cast("i").tolist() for x in got] == [pieces.whole(m, s) for s in some]


def test_new_stretches_are_searched_side_by_side(model, monkeypatch):
    """The search one by one is for few stretches, not for each of many texts (it took most of the time)."""
    import pyarrow as pa

    rng = random.Random(8)
    texts = [" ".join(rng.sample(words(rng, 200), 60)) for _ in range(40)] + [None, "", "y" * 200]
    want = [ids(model, t or "") for t in texts]
    calls, one = [], pieces.whole
    monkeypatch.setattr(pieces, "whole", lambda m, s: calls.append(s) or one(m, s))
    part = pa.record_batch([pa.array(texts, pa.string())], names=["text"])
    assert [memoryview(x).cast("i").tolist() for x in pieces._encoded(pieces.Encoder(model), part, "text")] == want
    assert not calls


def test_full_tables_and_long_texts(model, monkeypatch):
    """Small limits change no ids: tables that fill up at once, groups of few texts, texts beyond a group, short runs."""
    import pyarrow as pa

    rng = random.Random(9)
    texts = [" ".join(rng.choices(words(rng, 300), k=rng.randrange(400))) for _ in range(30)]
    texts += [t for t in texts[:5]] + ["", None, "z" * 100]
    want = [[i for s in model.stretches.findall(pieces.normalise(model, t or "")) for i in pieces.viterbi(model, s)] for t in texts]
    part = pa.record_batch([pa.array(texts, pa.string())], names=["text"])
    for name, value in (("KNOWN", 50), ("TOGETHER", 3_000), ("RUN", 7), ("FEW", 3), ("CELLS", 100)):
        monkeypatch.setattr(pieces, name, value)
        got = pieces._encoded(pieces.Encoder(model), part, "text")
        assert [memoryview(x).cast("i").tolist() if x else [] for x in got] == want


def _pieces(m, known):
    back = {i: p for p, (i, _) in m.pieces.items()}
    return [back[i] for i in known]


def test_commits_before_the_end(model):
    """Ids come out while the text is still being read, also without any space."""
    class Watched(str):
        seen = 0

        def __getitem__(self, k):
            Watched.seen = max(Watched.seen, (k.stop if isinstance(k, slice) else k) or 0)
            return str.__getitem__(self, k)

    stream = pieces.viterbi(model, Watched("internationalisation" * 2_000))
    next(stream)
    assert Watched.seen < 200


def test_memory_follows_the_window(model):
    """Of a long text without spaces only the window and its open paths are held."""
    import tracemalloc

    text = "internationalisation" * 20_000
    tracemalloc.start()
    n = sum(1 for _ in pieces.viterbi(model, text))
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert n > 20_000 and peak < 2_000_000


def test_round_trips(spark):
    texts = ["", None, " lead", "tail ", "  two  spaces", "tab\tnew\nline", "emoji 😀 日本", "▁sign", "x" * 50_000, "\x00\x7f", "a b " * 5_000]
    got = pieces.round_trip(docs(spark, texts))
    assert got.columns[:2] == ["doc_id", "text"] and got.where("not same").count() == 0
    by = {r.doc_id: (r.ids, r.decoded) for r in got.collect()}
    assert by[0] == ([], "") and by[1] == ([], "") and by[7][1] == " sign"
    assert pieces.round_trip(docs(spark, [])).count() == 0


def test_decode_odd_ids(spark, model):
    assert pieces.decode(model, []) == ""
    assert "⁇" in pieces.decode(model, [10**6]) and "⁇" in pieces.decode(model, [-1])
    assert pieces.decode(model, [1, 2]) == ""
    df = spark.createDataFrame([(None,), ([None],)], "ids array<int>")
    assert [r.decoded for r in pieces.decode_ids(df).sort(F.col("ids").isNotNull()).collect()][0] == ""
