"""Suffix-array dedup and MinHash near-dedup against brute force."""

import hashlib
import random

import numpy as np
import pytest
from helpers import ascii_lower, docs, rows

from vigil.llm import near_dup, repeats
from vigil.llm.near_dup import near_dedup
from vigil.llm.repeats import remove_repeats


def brute_repeats(texts, length):
    """Documents in order of their position in the list."""
    seen, out = set(), []
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        gone = np.zeros(len(raw) + 1, dtype=bool)
        for s in range(len(raw) - length + 1):
            w = raw[s:s + length]
            if w in seen:
                gone[s:s + length] = True
            seen.add(w)
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        runs = int((gone[1:] & ~gone[:-1]).sum() + gone[0]) if len(raw) else 0
        out.append((i, len(raw), len(raw) - len(kept), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


COLS = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def corpus(rng, n, size, alphabet="abé"):
    passages = ["".join(rng.choices(alphabet, k=rng.randrange(5, size))) for _ in range(6)]
    out = []
    for _ in range(n):
        t = ""
        while rng.random() < 0.8:
            t += rng.choice(passages) if rng.random() < 0.6 else "".join(rng.choices(alphabet, k=rng.randrange(size)))
        out.append(t)
    return out


@pytest.mark.parametrize("length,hot", [(20, 50_000), (20, 2), (100, 50_000), (6, 3), (33, 1)])
def test_repeats(spark, length, hot):
    rng = random.Random(length + hot)
    texts = corpus(rng, 60, 3 * length) + [None, "", "a" * 40, "a" * 400, "ab" * 150, "short"]
    texts += [texts[0], texts[1], texts[0] + "z" + texts[2]]
    assert rows(remove_repeats(docs(spark, texts).repartition(5), length, hot_group=hot), *COLS) == brute_repeats(texts, length)


def test_repeats_one_passage_everywhere(spark):
    """The same passage in every document: ties spread over the ranges."""
    rng = random.Random(8)
    passage = "".join(rng.choices("abcdefgh ", k=400))
    texts = ["".join(rng.choices("abcdefgh ", k=rng.randrange(80))) + passage + "".join(rng.choices("xyz", k=rng.randrange(80)))
             for _ in range(300)]
    assert rows(remove_repeats(docs(spark, texts)), *COLS) == brute_repeats(texts, 100)
    spark.conf.set("spark.sql.shuffle.partitions", "31")
    try:
        assert rows(remove_repeats(docs(spark, texts), hot_group=20), *COLS) == brute_repeats(texts, 100)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_repeats_spans_and_odd_tables(spark):
    text = "".join(random.Random(1).choices("abcdefg", k=150))
    got = {r.doc_id: r for r in remove_repeats(docs(spark, ["12" + text + "3", text + "4", None], [1, 2, 3])).collect()}
    assert [(x.a, x.b) for x in got[2].spans] == [(0, 150)] and bytes(got[2].kept) == b"4"
    assert got[1].spans is None and got[3].n_bytes == 0
    assert remove_repeats(docs(spark, [])).count() == 0
    # Null ids first, repeated ids by text hash: exactly one of three copies stays whole.
    got = rows(remove_repeats(docs(spark, [text, text, text], [None, 4, 4])), "doc_id", "n_removed")
    assert got == sorted([(None, 0), (4, 150), (4, 150)], key=repr)


def test_anchor_of_equal_windows():
    rng = random.Random(4)
    shape = repeats.Shape(100)
    common = bytes(rng.choices(range(97, 105), k=160))
    texts = [bytes(rng.choices(range(97, 105), k=rng.randrange(90))) + common for _ in range(20)]
    doc, g, c, packed = repeats.anchors(texts, shape)
    lo, hi, p = repeats.unpack(packed)
    # Every window start of every text has exactly one anchor.
    for i, t in enumerate(texts):
        starts = np.concatenate([np.arange(a, b + 1) for a, b in zip(lo[doc == i], hi[doc == i])])
        assert sorted(starts.tolist()) == list(range(len(t) - 99))
    at = {(int(g[j]), len(texts[doc[j]]) - int(p[j])) for j in range(len(p)) if len(texts[doc[j]]) - lo[j] <= 160}
    assert len(at) <= 6


# -- near-dedup -------------------------------------------------------------------------

def shingles(text, k):
    w = [x for x in __import__("re").split("[\x20\x09-\x0d]+", ascii_lower(text or "")) if x]
    if not w:
        return set()
    return {tuple(w[i:i + k]) for i in range(max(len(w) - k, 0) + 1)} if len(w) >= k else {tuple(w)}


def brute_near(texts, k, percent, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    sets = [shingles(t, k) for t in texts]
    comp = list(range(len(texts)))

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)), key=lambda x: ids[x])
                comp[b] = a
    return sorted(((ids[i], len(sets[i]), ids[find(i)], find(i) == i) for i in range(len(texts))), key=repr)


NEAR = ("doc_id", "n_shingles", "component_id", "kept")


def edited(rng, words, n):
    w = list(words)
    for _ in range(n):
        w[rng.randrange(len(w))] = "e%d" % rng.randrange(10**6)
    return " ".join(w)


def test_near(spark):
    rng = random.Random(6)
    texts = []
    for size in (3, 8, 40, 120, 300):
        base = [f"w{rng.randrange(500)}" for _ in range(size)]
        texts += [edited(rng, base, rng.randrange(0, max(2, size // 12))) for _ in range(12)]
        texts += [" ".join(base), " ".join(base).upper(), "\n\t".join(base)]
    texts += [None, "", "  ", "one", "One", "one two", "two one", "ÉA b c", "éa b c"]
    rng.shuffle(texts)
    ids = rng.sample(range(1000), len(texts))
    got = near_dedup(docs(spark, texts, ids).repartition(4), 3, 85)
    assert rows(got, *NEAR) == brute_near(texts, 3, 85, ids)


def test_near_chain(spark):
    """A drifting text: neighbours are alike, ends are not; one component by many links."""
    rng = random.Random(7)
    words = [f"w{i}" for i in range(200)]
    texts = []
    for _ in range(60):
        words = list(words)
        words[rng.randrange(200)] = "n%d" % rng.randrange(10**6)
        words[rng.randrange(200)] = "n%d" % rng.randrange(10**6)
        texts.append(" ".join(words))
    order = list(range(60))
    rng.shuffle(order)
    texts = [texts[i] for i in order]
    assert rows(near_dedup(docs(spark, texts), 3, 85), *NEAR) == brute_near(texts, 3, 85)


def test_near_big_group(spark):
    """Many near copies with outliers near the threshold: no link is lost."""
    rng = random.Random(9)
    base = [f"w{rng.randrange(10**5)}" for _ in range(100)]
    texts = [edited(rng, base, rng.choice([0, 1, 2, 3, 4, 5, 6, 7])) for _ in range(150)]
    assert rows(near_dedup(docs(spark, texts), 3, 85), *NEAR) == brute_near(texts, 3, 85)
    assert rows(near_dedup(docs(spark, texts)), *NEAR) == brute_near(texts, 5, 80)


def test_near_odd_tables(spark):
    assert near_dedup(docs(spark, [])).count() == 0
    got = near_dedup(docs(spark, ["a b c d e f", "a b c d e f", "a b c d e f", "z", None], [5, 5, None, None, 5]))
    assert sorted((r.n_shingles, r.kept) for r in got.collect()) == [(0, True), (1, True), (2, False), (2, False), (2, True)]
    long = " ".join(f"v{i}" for i in range(30_000))
    assert rows(near_dedup(docs(spark, [long, long + " end"])), "doc_id", "component_id") == [(0, 0), (1, 0)]


def test_two_permutations_give_all_coordinates():
    """Coordinate k is the least rank after a turn by k, and agreement of signatures estimates the similarity."""
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 2**63, 400, dtype=np.uint64)
    a, b = np.sort(pool[:300]), np.sort(pool[60:])
    both = [(near_dup.mix64(x ^ near_dup.C1) >> np.uint64(32)).astype(np.uint32) for x in (a, b)]
    sig = near_dup.ranks(np.concatenate(both), np.array([0, 300]), 512)
    one = near_dup.ranks(both[0] - np.uint32(7), np.array([0]), 1)
    assert one[0, 0] == sig[7, 0]
    assert abs((sig[:, 0] == sig[:, 1]).mean() - 240 / 400) < 0.08
