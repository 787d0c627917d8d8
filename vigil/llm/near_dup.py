"""MinHash near-dedup with circulant permutations.

A document's set holds the 64-bit hashes of its distinct word shingles.  One
permutation scatters the set over a circle of 2**32 places, a second one ranks
the places; signature coordinate k is the least rank after the circle was
turned by k, so two permutations give all coordinates.  Coordinates are banded;
documents that share a band are candidates, and every link is confirmed by the
exact Jaccard similarity of the full sets.

Groups of copies never meet as all pairs:

* Equal sets are one class, pre-aggregated before the shuffle.
* Star rounds: the classes of a bucket are compared with its smallest class,
  then, where still apart, with its largest.
* What is left are buckets whose members lie in different components.  Buckets
  with common members form a group, and each member x is reduced to its
  difference D from the group's pivot, its smallest set.  Two sets are similar
  enough if, and only if, their differences have enough in common: for
  Q = (100 + p) |D| - (100 - p) |x| at least (Q of one + Q of the other) over
  2 (100 + p).  What all members hold is in no difference, so copies with edits
  of their own meet only in rare shingles: a prefix-filtered join of the
  differences, rarest shingle first, with the bound on what can still be common
  behind a match, gives the pairs that are compared.  Nothing is cut off: a
  candidate pair is confirmed, excluded by an exact bound, or already in one
  component.

With 32 bands of 4 a pair of similarity 0.85 (0.8) is no candidate with
probability 6e-11 (5e-8).

* Null texts and texts without words have an empty set: linked with nothing.
* With fewer words than a shingle the whole sequence is the one shingle.
* Null ids are smaller than any other.  Of repeated ids the first by text hash
  counts as smaller; rows equal in both share one component, one of them stays.
* An empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigil.llm.common import Scratch, checked_broadcast, components, row_keys

BANDS, ROWS = 32, 4
#: Shingles ranked at once, and words remembered in a task.
CHUNK, KNOWN_WORDS = 1 << 16, 100_000
C1, C2, C3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def mix64(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Words(dict):
    """64-bit hashes of words, remembered in two generations."""

    older: dict[bytes, int] = {}

    def __missing__(self, word: bytes) -> int:
        import xxhash

        h = self.older.get(word)
        if h is None:
            h = xxhash.xxh3_64_intdigest(word)
        self[word] = h
        return h


class Shingler:
    """Shingle sets of texts: sorted distinct 64-bit hashes."""

    def __init__(self, k: int):
        self.k = k
        self.known = Words()
        self.steps = np.array([pow(0x9E3779B97F4A7C15, 2 * i + 1, 1 << 64) for i in range(k + 1)], dtype=np.uint64)

    def words(self, words: list[bytes]) -> np.ndarray:
        if len(self.known) > KNOWN_WORDS:
            self.known.older = dict(self.known)
            self.known.clear()
        return np.fromiter(map(self.known.__getitem__, words), dtype=np.uint64, count=len(words))

    def shingles(self, text: bytes) -> np.ndarray:
        words = text.lower().split()  # of bytes: A-Z alone; separators are the six ASCII white spaces
        if not words:
            return np.zeros(0, dtype=np.uint64)
        h = self.words(words)
        k = min(self.k, len(h))
        n = len(h) - k + 1
        s = np.full(n, np.uint64(k) * C3, dtype=np.uint64)
        for i in range(k):
            s += mix64(h[i:i + n] * self.steps[i] + np.uint64(i))
        return np.unique(mix64(s))


def ranks(places: np.ndarray, starts: np.ndarray, coords: int) -> np.ndarray:
    """Signatures (coords x sets) of sets of places that lie one behind another."""
    out = np.empty((coords, len(starts)), dtype=np.uint32)
    v, t = np.empty_like(places), np.empty_like(places)
    for k in range(coords):
        np.subtract(places, np.uint32(k), out=v)
        for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
            np.right_shift(v, np.uint32(shift), out=t)
            np.bitwise_xor(v, t, out=v)
            np.multiply(v, np.uint32(factor), out=v)
        np.right_shift(v, np.uint32(16), out=t)
        np.bitwise_xor(v, t, out=v)
        out[k] = np.minimum.reduceat(v, starts)
    return out


def band_keys(sets: list[np.ndarray], bands: int, rows: int) -> np.ndarray:
    """64-bit band keys (sets x bands) of non-empty shingle sets."""
    keys = np.empty((len(sets), bands), dtype=np.int64)
    at = 0
    while at < len(sets):
        end, size = at, 0
        while end < len(sets) and (end == at or size + len(sets[end]) <= CHUNK):
            size += len(sets[end])
            end += 1
        # First permutation: scatter; the second one ranks, turned by k.
        places = (mix64(np.concatenate(sets[at:end]) ^ C1) >> np.uint64(32)).astype(np.uint32)
        starts = np.cumsum([0] + [len(s) for s in sets[at:end - 1]])
        sig = ranks(places, starts, bands * rows).astype(np.uint64).reshape(bands, rows, end - at)
        key = np.arange(bands, dtype=np.uint64)[:, None] * C2 + C3
        for r in range(rows):
            key = mix64(key * C1 + sig[:, r])
        keys[at:end] = key.T.view(np.int64) if key.T.flags["C_CONTIGUOUS"] else np.ascontiguousarray(key.T).view(np.int64)
        at = end
    return keys


SIGNED = "_k long, _n long, _set binary, _bands array<long>"
FULL = "_k long, _n long, _items binary"
COMPARED = "a long, b long, na long, nb long, common long"


def signatures(keyed: DataFrame, shingle: int, bands: int, rows: int) -> DataFrame:
    """(_k, _n set size, _set 128-bit hash of the set, _bands), per row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        made = Shingler(shingle)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                sets = [made.shingles((t.as_py() or "").encode("utf-8", "surrogatepass")) for t in part.column(1)]
                full = [s for s in sets if len(s)]
                keys = iter(band_keys(full, bands, rows).tolist() if full else [])
                yield pa.RecordBatch.from_arrays([
                    part.column(0), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                    pa.array([next(keys) if len(s) else [] for s in sets], pa.list_(pa.int64()))],
                    names=["_k", "_n", "_set", "_bands"])

    return keyed.select("_k", "_text").mapInArrow(run, SIGNED)


def full_sets(keyed: DataFrame, shingle: int) -> DataFrame:
    """(_k, _n, _items): the whole set, eight bytes a shingle, sorted."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Shingler(shingle)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                sets = [made.shingles((t.as_py() or "").encode("utf-8", "surrogatepass")) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([
                    part.column(0), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([s.tobytes() for s in sets], pa.binary())], names=["_k", "_n", "_items"])

    return keyed.select("_k", "_text").mapInArrow(run, FULL)


def differences(members: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, s): the shingles of ``a`` or its pivot, but not of both, one a row.
    ``members``: (a, pivot)."""
    own = sets.select(F.col("_k").alias("a"), F.col("_items").alias("ia"))
    other = sets.select(F.col("_k").alias("pivot"), F.col("_items").alias("ip"))
    both = members.where("a <> pivot").join(own, "a").join(other, "pivot").select("a", "ia", "ip")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                made = [np.setxor1d(*(np.frombuffer(z.as_buffer(), dtype=np.int64) for z in pair), assume_unique=True)
                        for pair in zip(part.column(1), part.column(2))]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(part.column(0).to_numpy(), [len(m) for m in made])),
                                                  pa.array(np.concatenate(made))], names=["a", "s"])

    return both.mapInArrow(run, "a long, s long")


def meetings(members: DataFrame, tokens: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """(a, b): pairs of ``members`` (a, pivot, n, c, d, q) in one group and
    different components whose differences may have enough in common."""
    p, q = percent, 100 + percent
    held = scratch.cut(tokens.join(members, "a"), "held")
    rare = held.groupBy("pivot", "s").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    at = F.row_number().over(Window.partitionBy("a").orderBy(F.coalesce("df", F.lit(1)), "s")) - 1
    placed = held.join(scratch.cut(rare, "rare"), ["pivot", "s"], "left").withColumn("i", at).where("df is not null")
    up = lambda x: F.greatest(F.ceil(x / q), F.lit(1))  # noqa: E731  at least one in common
    # A pair is found from its member with the larger q; the other one has at most that q.
    probe = F.col("i") <= F.col("d") - up(F.col("q") - (100 - p) * 100 * F.col("n") / p - 1e-6)
    index = F.col("i") <= F.col("d") - up(F.col("q") - 1e-6)
    placed = scratch.cut(placed.withColumn("probe", probe).withColumn("index", index).where("probe or index"), "prefixes")

    def side(name: str, which: str) -> DataFrame:
        return placed.where(which).select("pivot", "s", *[F.col(c).alias(c + name) for c in ("a", "n", "c", "d", "q", "i")])

    still = F.least(F.col("dx") - F.col("ix"), F.col("dy") - F.col("iy"))
    return (side("x", "probe").join(side("y", "index"), ["pivot", "s"])
            .where((F.col("cx") != F.col("cy")) & (F.struct("qx", "ax") > F.struct("qy", "ay"))
                   & (100 * F.least("nx", "ny") >= p * F.greatest("nx", "ny")) & (2 * q * still >= F.col("qx") + F.col("qy")))
            .select(F.greatest("ax", "ay").alias("a"), F.least("ax", "ay").alias("b")).distinct())


def compare(pairs: DataFrame, sets: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, b, na, nb, common) of distinct pairs, by their full sets."""
    pairs = scratch.cut(pairs.select("a", "b").distinct(), "pairs")
    n = pairs.count()
    if not n:
        return pairs.sparkSession.createDataFrame([], COMPARED)
    left = sets.join(checked_broadcast(pairs, n), F.col("_k") == F.col("a")).select("a", "b", F.col("_n").alias("na"), F.col("_items").alias("ia"))
    ends = checked_broadcast(pairs.select(F.col("b").alias("_b")).distinct(), n)  # at most as many as pairs
    right = (sets.join(ends, F.col("_k") == F.col("_b"), "left_semi")
             .select(F.col("_k").alias("b"), F.col("_n").alias("nb"), F.col("_items").alias("ib")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            common = []
            for x, y in zip(batch.column(4), batch.column(5)):
                u, v = (np.frombuffer(z.as_buffer(), dtype=np.uint64) for z in (x, y))
                if len(u) > len(v):
                    u, v = v, u
                at = np.searchsorted(v, u)
                at[at == len(v)] = 0
                common.append(int((v[at] == u).sum()))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), pa.array(common, pa.int64())],
                                             names=["a", "b", "na", "nb", "common"])

    return scratch.cut(left.join(right, "b").select("a", "b", "na", "nb", "ia", "ib")
                       .mapInArrow(run, COMPARED), "compared")


def near_dedup(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text",
               bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per input row: id, n_shingles, component_id, kept.  Rows are
    linked if 100 * intersection >= ``percent`` * union of their sets."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "near")
    keyed = row_keys(docs, id_col, text_col, scratch)
    signed = scratch.cut(signatures(keyed, shingle, bands, rows), "signed")
    ids = keyed.select("_k", "_id")

    # Classes of equal sets; the smallest row stands for its class.
    classes = scratch.cut(signed.where("_n > 0").groupBy("_set").agg(F.min("_k").alias("rep")), "classes")
    reps = signed.join(classes, (signed._set == classes._set) & (signed._k == classes.rep), "left_semi")
    banded = reps.select(F.col("_k").alias("a"), "_n", F.explode("_bands").alias("band"))
    buckets = scratch.cut(banded.groupBy("band").agg(F.count(F.lit(1)).alias("size"), F.min("a").alias("lead"),
                                                     F.max("a").alias("tail")).where("size > 1"), "buckets")
    members = scratch.cut(banded.join(buckets.drop("size"), "band"), "members")
    nodes = scratch.cut(members.select("a").distinct(), "nodes")
    sets = scratch.cut(full_sets(keyed.join(checked_broadcast(nodes), F.col("_k") == F.col("a"), "left_semi"), shingle), "sets")

    alike = 100 * F.col("common") >= percent * (F.col("na") + F.col("nb") - F.col("common"))

    # Star round 1: with the smallest of all leads.
    first = members.groupBy("a").agg(F.min("lead").alias("b")).where("a <> b")
    done = compare(first, sets, scratch)
    edges = scratch.cut(done.where(alike).select("a", "b"), "edges")
    comps = scratch.cut(components(edges, scratch), "comps")

    def with_comp(df: DataFrame, node: str, name: str) -> DataFrame:
        c = comps.select(F.col("node").alias(node), F.col("comp").alias(name))
        return df.join(c, node, "left").withColumn(name, F.coalesce(name, node))

    def merged(comps: DataFrame, links: DataFrame) -> DataFrame:
        """Components with new ``links`` (a, b): only the components they join are looked at again."""
        both = with_comp(with_comp(links.select("a", "b"), "a", "ca"), "b", "cb").where("ca <> cb")
        joined = scratch.cut(both.select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct(), "joined")
        if joined.isEmpty():
            return comps
        top = scratch.cut(components(joined, scratch), "top")
        up = top.select(F.col("node").alias("comp"), F.col("comp").alias("_to"))
        moved = comps.join(up, "comp", "left").select("node", F.coalesce("_to", "comp").alias("comp"))
        return scratch.cut(moved.unionByName(top.join(comps.select("node"), "node", "left_anti")), "comps")

    # Star round 2: with every lead and tail of a bucket, where still apart.
    ends = (members.select("a", F.col("lead").alias("b")).unionByName(members.select("a", F.col("tail").alias("b")))
            .where("a <> b").distinct().join(done.select("a", "b"), ["a", "b"], "left_anti"))
    apart = with_comp(with_comp(ends, "a", "ca"), "b", "cb").where("ca <> cb")
    more = compare(apart, sets, scratch)
    comps = merged(comps, more.where(alike))
    done = scratch.cut(done.select("a", "b", "common", "na", "nb").unionByName(more.select("a", "b", "common", "na", "nb")), "done")

    # What is left: buckets that hold several components.
    placed = scratch.cut(with_comp(members.select("band", "lead", "a", "_n"), "a", "ca"), "placed")
    mixed = scratch.cut(placed.groupBy("band").agg(F.min("ca").alias("lo"), F.max("ca").alias("hi")).where("lo < hi").select("band"), "mixed")
    open_ = scratch.cut(placed.join(mixed, "band").select("a", "lead", "_n").distinct(), "open")
    tied = scratch.cut(components(open_.select("a", F.col("lead").alias("b")), scratch), "tied")
    sized = tied.join(open_.select(F.col("a").alias("node"), F.col("_n").alias("n")).distinct(), "node")
    pivots = sized.groupBy("comp").agg(F.min(F.struct("n", "node"))["node"].alias("pivot"))
    grouped_ = scratch.cut(sized.join(pivots, "comp").select(F.col("node").alias("a"), "pivot", "n"), "pivots")
    tokens = scratch.cut(differences(grouped_.select("a", "pivot"), sets), "differences")
    far = tokens.groupBy("a").agg(F.count(F.lit(1)).alias("d"))
    q = (100 + percent) * F.col("d") - (100 - percent) * F.col("n")
    away = scratch.cut(grouped_.join(far, "a", "left").withColumn("d", F.coalesce("d", F.lit(0))).withColumn("q", q), "away")
    # A member as near to its pivot as a link needs is linked with it.
    size = away.where("a = pivot").select("pivot", F.col("n").alias("np"))
    linked = away.where("a <> pivot").join(size, "pivot").where(F.col("q") <= (100 - percent) * F.col("np")).select("a", F.col("pivot").alias("b"))
    comps = merged(comps, linked)
    met = meetings(with_comp(away, "a", "c"), tokens, percent, scratch)
    rest = met.join(done.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), ["a", "b"], "left_anti")
    last = compare(rest, sets, scratch)
    comps = merged(comps, last.where(alike))
    scratch.drop(buckets, members, nodes, sets, placed, mixed, open_, tokens)

    # Back to rows: class, component, the id of the component's smallest row.
    grouped = scratch.cut(classes.join(comps.withColumnRenamed("node", "rep"), "rep", "left")
                          .select("_set", F.coalesce("comp", "rep").alias("comp")), "grouped")
    named = scratch.cut(grouped.select("comp").distinct().join(ids.select(F.col("_k").alias("comp"), F.col("_id").alias("comp_id")), "comp"), "named")
    rows_ = (signed.select("_k", "_n", "_set").join(grouped, "_set", "left").join(named, "comp", "left")
             .join(ids, "_k"))
    lone = F.col("comp").isNull()
    return rows_.select(F.col("_id").alias(id_col), F.col("_n").alias("n_shingles"),
                        F.when(lone, F.col("_id")).otherwise(F.col("comp_id")).alias("component_id"),
                        (lone | (F.col("_k") == F.col("comp"))).alias("kept"))
