"""Sum-of-squares packing against a plain version, and its pieces against the tokenizer."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from helpers import docs

from vigil.llm import packing


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.TOKENIZER)
    tok.encode_special_tokens = True
    return tok


def plain_level(fills, size, length):
    """The rule, from the list of open fills: least sum of squared counts, then the fullest."""
    best = None
    for h in sorted({0, *fills}, reverse=True):
        if h + length > size:
            continue
        after = Counter(fills)
        if h:
            after[h] -= 1
        if h + length < size:
            after[h + length] += 1
        total = sum(n * n for n in after.values())
        if best is None or total < best[0]:
            best = (total, h)
    return best[1]


@pytest.mark.parametrize("size, seed", [(8, 1), (16, 2), (50, 3)])
def test_levels_follow_the_rule(size, seed):
    rng, packer, fills = random.Random(seed), packing.Packer(size), []
    for row in range(400):
        n = rng.randint(1, size - 1)
        at = plain_level(fills, size, n)
        assert packer.level(n) == at
        if at:
            fills.remove(at)
        full = list(packer.add(row, np.arange(n, dtype="<u4")))
        if at + n < size:
            fills.append(at + n)
        assert bool(full) == (at + n == size)
        assert Counter({h: int(c) for h, c in enumerate(packer.count) if c}) == Counter(fills)
        assert packer.n_open == len(fills) == sum(map(len, packer.open))


@pytest.mark.parametrize("max_open", [3, 2000])
def test_every_id_is_in_one_window(max_open):
    rng, packer, size = random.Random(7), packing.Packer(32, max_open), 32
    texts = {r: np.array([r * 1000 + i for i in range(rng.choice([1, 5, 17, 31, 32, 33, 200]))], dtype="<u4") for r in range(300)}
    windows = [w for r, ids in texts.items() for w in packer.add(r, ids)]
    assert all(packing.fill(w) == size for w in windows) and packer.n_open < max(max_open, 2)
    last = list(packer.close())
    sizes = [packing.fill(w) for w in last]
    short = [s for s in sizes if s < size]
    assert short == sorted(set(short), reverse=True) and all(s & (s - 1) == 0 for s in short)
    got = defaultdict(list)
    for w in windows + last:
        for r, start, ids in w:
            got[r].append((start, ids.tolist()))
    for r, ids in texts.items():
        at = 0
        for start, part in sorted(got[r]):
            assert start == at and part
            at += len(part)
        assert [i for _, part in sorted(got[r]) for i in part] == ids.tolist()


def test_encoder_gives_the_tokenizers_ids(library):
    rng = random.Random(1)
    signs = [" ", "  ", "\n", "\t", "\xa0", "\x1c", "\u3000", "\x85", "a", "bc", "!", "'s", "1", "日本", "é", "\r\n",
             "<|endoftext|>", "\u200b", "\u0301", "_", "x" * 70, "𝒳", "\u0378", "'LL"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    texts += ["ab" * 30_000, " " * 5_000, "".join(chr(c) for c in range(0x3000) if not 0xD800 <= c < 0xE000)]
    with open(packing.TOKENIZER, encoding="utf-8") as f:
        enc = packing.encoder(f.read(), 1)
    assert enc.fast is not None
    for t, ids in zip(texts, enc.encode(texts)):
        assert ids.tolist() == library.encode(t, add_special_tokens=False).ids + [1], t[:50]


def test_other_tokenizer_files():
    from tokenizers import Tokenizer

    path = packing.TOKENIZER.replace("byte_bpe_50k", "word_bpe_49k")
    with open(path, encoding="utf-8") as f:
        enc = packing.Encoder(f.read(), 7)
    assert enc.fast is None
    tok = Tokenizer.from_file(path)
    texts = ["Two cats, one dog.", "", "längere Straße"]
    assert [x.tolist() for x in enc.encode(texts)] == [tok.encode(t, add_special_tokens=False).ids + [7] for t in texts]


def check(pieces, texts, library, window):
    """Every row's ids lie in exactly one piece each, and sequences have no gap."""
    by_row, by_seq = defaultdict(list), defaultdict(list)
    for p in pieces:
        assert len(p.ids) == 4 * p.length > 0
        by_row[p.row].append(p)
        by_seq[p.sequence_id].append(p)
    found = []
    for parts in by_row.values():
        parts.sort(key=lambda p: p.start)
        raw = b"".join(bytes(p.ids) for p in parts)
        assert [p.start for p in parts] == np.cumsum([0] + [p.length for p in parts[:-1]]).tolist()
        assert {p.doc_tokens for p in parts} == {len(raw) // 4}
        found.append((parts[0].doc_id, np.frombuffer(raw, "<u4").tolist()))
    want = [(i, library.encode(t or "", add_special_tokens=False).ids + [1]) for i, t in texts]
    assert sorted(found, key=repr) == sorted(want, key=repr)
    for parts in by_seq.values():
        parts.sort(key=lambda p: p.offset)
        assert [p.offset for p in parts] == np.cumsum([0] + [p.length for p in parts[:-1]]).tolist()
        total = sum(p.length for p in parts)
        assert total <= window and (total == window or total & (total - 1) == 0)


def test_pieces(spark, library):
    rng = random.Random(3)
    words = "the cat sat on a längere Straße 日本語 42 <|endoftext|>".split()
    texts = [" ".join(rng.choice(words) for _ in range(rng.choice([1, 3, 40, 300]))) for _ in range(120)]
    texts += [None, "", "   ", texts[0], texts[0], "word " * 20_000, "x" * 50_000]
    ids = [None, None, 5, 5] + list(range(4, len(texts)))
    frame = docs(spark, texts, ids).withColumnRenamed("kept", "sequence_id").repartition(3)
    got = packing.pack(frame, window=64, max_open=10)
    assert got.columns == ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "row"]
    check(got.collect(), list(zip(ids, texts)), library, 64)
    sums = packing.sequences(got, 64).agg({"padding": "sum", "tokens": "sum"}).first()
    assert sums["sum(padding)"] == 0 and sums["sum(tokens)"] == got.agg({"length": "sum"}).first()[0]


def test_empty_table(spark):
    assert packing.pack(docs(spark, [])).count() == 0


def test_registered_query(spark, library):
    import __spark_entry__ as entry

    sf = "/root/testdata/sf0.001"
    got = entry.queries()["op12_packing"](spark, sf).collect()
    table = spark.read.parquet(f"{sf}/documents.parquet").collect()
    tokens = {r.doc_id: np.array(library.encode(r.text or "", add_special_tokens=False).ids + [1], dtype="<u4") for r in table}
    assert sum(p.length for p in got) == sum(map(len, tokens.values()))
    for p in got:
        ids = tokens[p.doc_id]
        assert p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(ids[p.start:p.start + p.length].tobytes())
