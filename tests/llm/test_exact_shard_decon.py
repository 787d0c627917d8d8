"""Exact dedup, sharding and decontamination against brute force."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
import xxhash
from helpers import ascii_lower, docs, rows
from pyspark.sql import functions as F

from vigil.llm.decontaminate import decontaminate
from vigil.llm.exact_dedup import exact_dedup, md5_key
from vigil.llm.sharding import ROUNDS, grid, permute, row_at, shard_rows

TEXTS = ["a b", None, "", "a b", "A b", "é" * 5000, "é" * 5000, " a b", "a b", "x" * 100_000]


def brute_exact(texts, ids):
    groups = defaultdict(list)
    for i, t in zip(ids, texts):
        groups[t or ""].append(i)
    return sorted(((i, max(groups[t or ""]), len(groups[t or ""]), i == max(groups[t or ""]),
                    hashlib.sha256((t or "").encode()).hexdigest()) for i, t in zip(ids, texts)), key=repr)


COLS = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")


@pytest.mark.parametrize("weak", [False, True])
def test_exact(spark, weak):
    ids = list(range(len(TEXTS)))
    # A hash of the length alone clashes: bytes decide.
    h = (lambda c: F.lpad(F.length(c).cast("string"), 16, "0").cast("binary")) if weak else md5_key
    assert rows(exact_dedup(docs(spark, TEXTS, ids), hash128=h), *COLS) == brute_exact(TEXTS, ids)


def test_exact_repeats_nulls_empty(spark):
    out = exact_dedup(docs(spark, ["t", "t", "t", "u", None], [5, 5, 3, None, None]))
    got = rows(out, "doc_id", "keep_id", "group_size", "kept")
    assert sorted(r[3] for r in got if r[1] == 5) == [False, False, True]  # one of two equal rows stays
    assert (None, None, 1, True) in got and len(got) == 5
    assert exact_dedup(docs(spark, [])).count() == 0


def xx(n, seed):
    return xxhash.xxh64_intdigest(n.to_bytes(8, "little", signed=True), seed)


def brute_place(x, n, seed):
    """The same network in Python integers."""
    a, b = grid(n)
    while True:
        left, right = x % a, x // a
        for i in range(ROUNDS):
            if i % 2 == 0:
                h = xx(seed, xx(i, xx(right, 42)))
                h -= (h >> 63) << 64
                left = (left + h % a) % a
            else:
                h = xx(seed, xx(i, xx(left, 42)))
                h -= (h >> 63) << 64
                right = (right + h % b) % b
        x = right * a + left
        if x < n:
            return x


@pytest.mark.parametrize("n", [1, 2, 3, 7, 10, 101, 1000])
def test_permutation(spark, n):
    got = spark.range(n).select("id", permute(F.col("id"), n, 9).alias("at")).collect()
    assert sorted(r.at for r in got) == list(range(n))
    assert {r.id: r.at for r in got} == {i: brute_place(i, n, 9) for i in range(n)}
    back = spark.range(n).select("id", permute(F.col("id"), n, 9).alias("at")).select(
        "id", row_at(F.col("at") % 7, F.floor(F.col("at") / 7), n, 7, 9).alias("b"))
    assert back.where("id <> b").count() == 0


def test_shards(spark):
    rng = random.Random(1)
    texts = [None if i % 17 == 0 else "é" * rng.randrange(30) for i in range(500)]
    got = shard_rows(docs(spark, texts, [i * 3 for i in range(500)]), 40, seed=2).collect()
    assert len(got) == 500
    for r in got:
        t = (texts[r.doc_id // 3] or "").encode()
        assert (r.size, r.text_crc32, r.row_number) == (len(t) + 16, zlib.crc32(t), r.doc_id // 3)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert set(slots) == set(range(40)) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    again = shard_rows(docs(spark, texts, [i * 3 for i in range(500)]).repartition(7), 40, seed=2).collect()
    assert {(r.doc_id, r.shard, r.slot) for r in again} == {(r.doc_id, r.shard, r.slot) for r in got}


def test_shards_odd_tables(spark):
    got = shard_rows(docs(spark, ["a", "a", None], [1, 1, None]), 2).collect()
    assert sorted(r.row_number for r in got) == [0, 1, 2] and [r.row_number for r in got if r.doc_id is None] == [0]
    assert shard_rows(docs(spark, []), 40).count() == 0


WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_decon(texts, items, width):
    out = []
    wins = []
    for item, t in items:
        w = WORD.findall(ascii_lower(t or ""))
        n = min(width, len(w))
        wins += [(item, w[s:s + n]) for s in range(max(len(w) - width, 0) + 1)] if w else []
    for i, t in enumerate(texts):
        w = WORD.findall(ascii_lower(t or ""))
        hit, names = set(), set()
        for item, win in wins:
            for s in range(len(w) - len(win) + 1):
                if w[s:s + len(win)] == win:
                    hit |= set(range(s, s + len(win)))
                    names |= {item} - {None}
        ids = sorted(str(x) for x in names)
        out.append((i, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


DECON = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


@pytest.mark.parametrize("shingle,block", [(5, 200_000), (2, 3), (1, 200_000)])
def test_decontaminate(spark, shingle, block):
    rng = random.Random(3)
    vocab = ["The", "of", "a", "b", "É", "é", "xyz", "q9", "ß"]
    texts = [" ".join(rng.choices(vocab, k=rng.randrange(0, 60))) for _ in range(40)]
    texts += [None, "", "...", "the of", "K of a", "a\nb,É"]
    items = [(i, " ".join(rng.choices(vocab, k=rng.randrange(1, 9)))) for i in range(25)]
    items += [(99, texts[0]), (100, texts[0]), (101, None), (102, "--"), (None, texts[1]), (103, "k")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = rows(decontaminate(docs(spark, texts), bench, window=4, shingle=shingle, block=block), *DECON)
    assert got == brute_decon(texts, items, 4)


def test_decontaminate_odd_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    one = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert rows(decontaminate(docs(spark, ["a b", None]), none), *DECON) == brute_decon(["a b", None], [], 10)
    assert decontaminate(docs(spark, []), one).count() == 0
    got = rows(decontaminate(docs(spark, ["x a b c", "x a b c", "a"], [7, 7, None]), one), "doc_id", "n_words", "n_hit", "n_items")
    assert got == sorted([(7, 4, 3, 1), (7, 4, 3, 1), (None, 1, 0, 0)], key=repr)
    long = "w " * 30_000 + "a b c"
    assert rows(decontaminate(docs(spark, [long]), one), "n_words", "n_hit") == [(30_003, 3)]


def test_native_plans(spark):
    """No Python in the plans of the operators that ask for DataFrame functions."""
    d = docs(spark, ["a b", "c"])
    bench = spark.createDataFrame([(1, "a")], "item_id long, text string")
    for df in (exact_dedup(d), shard_rows(d, 4), decontaminate(d, bench)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan
