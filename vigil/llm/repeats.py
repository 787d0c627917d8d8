"""Suffix-array dedup of byte strings: every byte under a ``length``-byte string
that also starts earlier in the corpus is removed.

Sorting every suffix of the corpus would shuffle a hundred times its bytes, so
the suffix array is sparse.  Each ``length``-byte window takes its least hashed
``gram`` as anchor (leftmost on ties).  The anchor follows from the window's
bytes, so equal windows have equal anchors at equal offsets, and only suffixes
at anchors need sorting: one for about 35 windows.  An anchor's context is the
stretch of bytes under its windows.

1. Anchored suffixes are range-partitioned by sampled splitters on (hash of
   their leading gram, hash of the context, document, position), and sorted.
   Neighbours tell: a context equal to the one before (128 hash bits) starts
   later, so all its windows repeat; the first of each context stays open if
   its gram has other contexts.  Ties spread over ranges, so a passage found
   in every document fills many tasks.  The runs that touch a range's edge
   stay open too, so they are compared across boundaries.
2. Open suffixes get their bytes.  In each bucket of leading grams the windows
   are sorted by multikey quicksort, one 8-byte token at a time among those
   still tied; of equal windows all but the first repeat.  Grams with more
   than ``HOT_GROUP`` open contexts are first spread window by window through
   step 1, so no task holds more than that of one gram.

Only positions are shuffled, and the contexts of open suffixes.

* Null texts count as empty; texts shorter than ``length`` lose nothing.
* Earlier means smaller id, then earlier start.  Null ids come first; of
  repeated ids the row with the smaller text hash, equal rows in any order.
* Matches never cross documents; strings are judged on the input.
* An empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import Scratch, checked_broadcast, row_keys

#: Open contexts of one gram that a task may hold (about 150 bytes each).
HOT_GROUP = 50_000
#: Positions and spans up to which a table of them is broadcast (16 bytes each).
BROADCAST_POSITIONS = 2_000_000
#: Bytes hashed at once, and contexts sorted at once.
BUFFER, BLOCK = 1 << 20, 8_192
#: Bits for each of the two offsets packed behind a position.
BITS = 12


def mix64(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


ODD = mix64(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


@dataclass(frozen=True)
class Shape:
    length: int

    @property
    def gram(self) -> int:
        return 1 << max(0, (self.length // 3).bit_length() - 1)

    @property
    def places(self) -> int:
        """Places of a gram within a window."""
        return self.length - self.gram + 1


def gram_hashes(buf: np.ndarray, gram: int) -> np.ndarray:
    """64-bit hash of the ``gram`` bytes from each position; ``gram`` is a power of two."""
    h = mix64(np.arange(256, dtype=np.uint64) + np.uint64(7))[buf]
    step, i = 1, 0
    while step < gram:
        h = h[:-step] * ODD[i] + h[step:]
        h ^= h >> np.uint64(29)
        step, i = step * 2, i + 1
    return h


def least(v: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours, from block-wise running minima."""
    pad = np.concatenate([v, np.full(-len(v) % width, np.iinfo(np.uint64).max, dtype=np.uint64)]).reshape(-1, width)
    ahead = np.minimum.accumulate(pad, axis=1).ravel()
    back = np.minimum.accumulate(pad[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(v) - width + 1
    return np.minimum(back[:n], ahead[width - 1:width - 1 + n])


def span_hash(h: np.ndarray, lo: np.ndarray, end: np.ndarray, gram: int, longest: int) -> np.ndarray:
    """Hash of the bytes [lo, end) by overlapping grams that cover them."""
    out = np.zeros(len(lo), dtype=np.uint64)
    for j in range(-(-longest // gram)):
        out += mix64(h[np.minimum(lo + j * gram, end - gram)] ^ ODD[j]) * ODD[j + 1]
    return mix64(out ^ (end - lo).astype(np.uint64))


def anchors(texts: list[bytes], shape: Shape) -> tuple[np.ndarray, ...]:
    """Of every run of windows with one anchor: text number, gram hash, context
    hash, and position packed with the largest and smallest offset of a window
    start before the anchor."""
    size, gram, L = sum(map(len, texts)), shape.gram, shape.length
    none = np.zeros(0, dtype=np.int64)
    starts = np.cumsum([0] + [len(t) for t in texts])
    if size < L:
        return none, none, none, none
    buf = np.frombuffer(b"".join(texts), dtype=np.uint8)
    inside = np.zeros(size - L + 1, dtype=bool)
    for a, t in zip(starts.tolist(), texts):
        if len(t) >= L:
            inside[a:a + len(t) - L + 1] = True
    at = np.flatnonzero(inside)
    if not at.size:
        return none, none, none, none
    h = gram_hashes(buf, gram)
    low = np.uint64(0xFFFFFFFF)
    ranked = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    pick = (least(ranked, shape.places)[at] & low).astype(np.int64)
    turn = np.flatnonzero(pick[1:] != pick[:-1])
    first, last = np.concatenate([[0], turn + 1]), np.concatenate([turn, [len(at) - 1]])
    p, lo, hi = pick[first], at[first], at[last]
    doc = np.searchsorted(starts, p, side="right") - 1
    ctx = span_hash(h, lo, hi + L, gram, L + shape.places - 1) ^ mix64((p - lo).astype(np.uint64) + ODD[0])
    packed = ((p - starts[doc]) << 2 * BITS) | ((p - lo) << BITS) | (p - hi)
    return doc, mix64(h[p]).view(np.int64), ctx.view(np.int64), packed


def unpack(packed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window start, last window start, position."""
    p, mask = packed >> 2 * BITS, (1 << BITS) - 1
    return p - (packed >> BITS & mask), p - (packed & mask), p


def _buffers(keys: list[int], texts: list[bytes]) -> Iterator[tuple[list[int], list[bytes]]]:
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= BUFFER):
            size += len(texts[end])
            end += 1
        yield keys[at:end], texts[at:end]
        at = end


def _longs(*cols, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=names)


SUFFIX = ["g", "c", "k", "pos"]
SUFFIXES = ", ".join(f"{x} long" for x in SUFFIX)


def anchored(keyed: DataFrame, shape: Shape) -> DataFrame:
    """(g, c, k, pos): the sparse suffixes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, texts in _buffers(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                doc, g, c, packed = anchors(texts, shape)
                yield _longs(g, c, np.array(keys, dtype=np.int64)[doc], packed, names=SUFFIX)

    return keyed.select("_k", F.col("_text").cast("binary")).mapInArrow(run, SUFFIXES)


def judge(suffixes: DataFrame, scratch: Scratch) -> DataFrame:
    """(k, g, pos, full): step 1.  ``full`` suffixes repeat with all their
    windows, the others are open; suffixes of neither kind are left out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["k", "g", "pos", "full"]
        edge, held = None, None  # the range's first gram; the latest first-of-its-context, not yet decided
        for batch in batches:
            if not batch.num_rows:
                continue
            g, c, k, pos = (np.asarray(x) for x in batch.columns)
            if edge is None:
                edge, before = g[0], (g[0] ^ 1, 0)
            pg, pc = np.concatenate([[before[0]], g[:-1]]), np.concatenate([[before[1]], c[:-1]])
            new = (g != pg) | (c != pc)
            before = (g[-1], c[-1])
            yield _longs(k[~new], g[~new], pos[~new], np.ones(int((~new).sum()), dtype=bool), names=names)
            rk, rg, rp = k[new], g[new], pos[new]
            if held is not None:
                rk, rg, rp = np.append(held[0], rk), np.append(held[1], rg), np.append(held[2], rp)
            if not len(rk):
                continue
            tied = np.zeros(len(rk), dtype=bool)
            tied[1:] |= rg[1:] == rg[:-1]
            tied[:-1] |= rg[1:] == rg[:-1]
            if held is not None:
                tied[0] |= held[3]
            keep = tied | (rg == edge)
            held = (rk[-1], rg[-1], rp[-1], keep[-1])
            keep[-1] = False
            yield _longs(rk[keep], rg[keep], rp[keep], np.zeros(int(keep.sum()), dtype=bool), names=names)
        if held is not None:  # touches the range's end
            yield _longs(np.array([held[0]]), np.array([held[1]]), np.array([held[2]]), np.zeros(1, dtype=bool), names=names)

    ranged = suffixes.repartitionByRange(*SUFFIX).sortWithinPartitions(*SUFFIX)
    return scratch.cut(ranged.mapInArrow(run, "k long, g long, pos long, full boolean"), "judged")


def contexts(keyed: DataFrame, open_: DataFrame, shape: Shape, scratch: Scratch) -> DataFrame:
    """(g, k, pos, bytes) of open suffixes: documents meet the list of their positions."""
    per_doc = scratch.cut(open_.groupBy("k").agg(F.collect_list(F.struct("g", "pos")).alias("at")), "at")
    small = open_.count() <= BROADCAST_POSITIONS
    pairs = keyed.select("_k", F.col("_text").cast("binary").alias("_raw")).join(
        F.broadcast(per_doc) if small else per_doc, F.col("_k") == F.col("k")).select("k", "_raw", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                out: tuple[list, ...] = ([], [], [], [])
                for k, raw, marks in zip(*(part.column(i).to_pylist() for i in range(3))):
                    for m in marks:
                        lo, hi, _ = unpack(m["pos"])
                        for o, v in zip(out, (m["g"], k, m["pos"], raw[lo:hi + shape.length])):
                            o.append(v)
                yield pa.RecordBatch.from_arrays([*(pa.array(o, pa.int64()) for o in out[:3]), pa.array(out[3], pa.binary())],
                                                 names=["g", "k", "pos", "ctx"])

    return pairs.mapInArrow(run, "g long, k long, pos long, ctx binary")


def split_windows(ctx: DataFrame, shape: Shape) -> DataFrame:
    """The windows of contexts as suffixes of their own, told apart by 128 hash bits."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2_000):
                part = batch.slice(at, 2_000)
                texts = part.column(3).to_pylist()
                g, k, pos = (np.asarray(part.column(i)) for i in range(3))
                lo, hi, p = unpack(pos)
                buf = np.frombuffer(b"".join(texts), dtype=np.uint8)
                begin = np.cumsum([0] + [len(t) for t in texts])[:-1]
                owner = np.repeat(np.arange(len(k)), hi - lo + 1)
                step = np.arange(len(owner)) - np.repeat(np.cumsum(hi - lo + 1) - (hi - lo + 1), hi - lo + 1)
                h, start = gram_hashes(buf, shape.gram), begin[owner] + step
                one = span_hash(h, start, start + shape.length, shape.gram, shape.length)
                off = (p - lo)[owner] - step
                two = span_hash(mix64(h ^ ODD[9]), start, start + shape.length, shape.gram, shape.length) ^ mix64(off.astype(np.uint64))
                yield _longs((one ^ mix64(off.astype(np.uint64) + g[owner].view(np.uint64))).view(np.int64), two.view(np.int64), k[owner],
                             (p[owner] << 2 * BITS) | (off << BITS) | off, names=SUFFIX)

    return ctx.mapInArrow(run, SUFFIXES)


def equal_windows(g: np.ndarray, k: np.ndarray, pos: np.ndarray, texts: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """(k, first start, last start) of window runs that repeat an earlier
    window of the same gram, by multikey quicksort."""
    lo, hi, p = unpack(pos)
    many = hi - lo + 1
    owner = np.repeat(np.arange(len(k)), many)
    step = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
    raw = np.frombuffer(b"".join(texts) + bytes(8), dtype=np.uint8)
    word, width = raw.astype(np.uint64), 1
    while width < 8:  # the 8 bytes from each position as one big-endian token
        word = (word[:-width] << np.uint64(8 * width)) | word[width:]
        width *= 2
    base = np.cumsum([0] + [len(t) for t in texts])[:-1][owner] + step
    off = (p - lo)[owner] - step
    # Windows tie if gram and offset agree; singles drop out after every token.
    live = np.arange(len(owner))
    keys = [g[owner], off]
    tie = np.zeros(len(live), dtype=np.int64)
    tokens = [None, None, *(min(8 * j, max(0, length - 8)) for j in range(-(-length // 8)))]
    for j, at in enumerate(tokens):
        tok = keys[j][live] if at is None else word[base[live] + at]
        if at is not None and length < 8:
            tok = tok >> np.uint64(8 * (8 - length))
        order = np.lexsort((tok, tie))
        live, tok, tie = live[order], tok[order], tie[order]
        new = np.ones(len(live), dtype=bool)
        new[1:] = (tie[1:] != tie[:-1]) | (tok[1:] != tok[:-1])
        alone = new & np.append(new[1:], True)
        tie = np.cumsum(new)[~alone]
        live = live[~alone]
        if not live.size:
            break
    order = np.lexsort((p[owner[live]], k[owner[live]], tie))
    live, tie = live[order], tie[order]
    again = np.zeros(len(owner), dtype=bool)
    again[live[1:][tie[1:] == tie[:-1]]] = True
    # Runs of repeating windows within a context.
    hit = np.flatnonzero(again)
    if not hit.size:
        return (np.zeros(0, dtype=np.int64),) * 3
    turn = np.flatnonzero((hit[1:] != hit[:-1] + 1) | (owner[hit[1:]] != owner[hit[:-1]]))
    a, b = hit[np.concatenate([[0], turn + 1])], hit[np.concatenate([turn, [len(hit) - 1]])]
    return k[owner[a]], lo[owner[a]] + step[a], lo[owner[b]] + step[b]


def settle(ctx: DataFrame, length: int) -> DataFrame:
    """(k, s, e): step 2, runs of window starts that repeat.  A gram's contexts
    lie in one sorted partition; a task holds one block and one gram of them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush(table: pa.Table) -> pa.RecordBatch:
            g, k, pos = (np.asarray(table.column(i).combine_chunks()) for i in range(3))
            return _longs(*equal_windows(g, k, pos, table.column(3).to_pylist(), length), names=["k", "s", "e"])

        for big in batches:
            for at in range(0, big.num_rows, BLOCK):
                batch = big.slice(at, BLOCK)
                g = np.asarray(batch.column(0))
                cut = int(np.flatnonzero(g != g[-1])[-1]) + 1 if (g != g[-1]).any() else 0
                if cut or (held and held[-1].column(0)[-1].as_py() != g[0]):
                    # Whatever comes before the last gram of the batch is complete.
                    done = [*held, batch.slice(0, cut)]
                    yield flush(pa.Table.from_batches(done))
                    held = []
                held.append(batch.slice(cut))
        if held:
            yield flush(pa.Table.from_batches(held))

    return ctx.repartition("g").sortWithinPartitions("g").mapInArrow(run, "k long, s long, e long")


def repeated_spans(keyed: DataFrame, length: int, scratch: Scratch, hot_group: int = HOT_GROUP) -> DataFrame:
    """(k, spans): the removed byte ranges [a, b) of each document that has any, merged."""
    shape = Shape(length)
    if length + shape.places >= 1 << BITS:
        raise ValueError(f"length must stay below {(1 << BITS) * 3 // 5}")
    judged = judge(anchored(keyed, shape), scratch)
    open_ = judged.where("not full").select("k", "g", "pos")
    sure = judged.where("full").select("k", "pos")
    hot = scratch.cut(open_.groupBy("g").count().where(F.col("count") > hot_group).select("g"), "hot")
    if not hot.isEmpty():
        spread = judge(split_windows(contexts(keyed, open_.join(hot, "g", "left_semi"), shape, scratch), shape), scratch)
        sure = sure.unionByName(spread.where("full").select("k", "pos"))
        open_ = open_.join(hot, "g", "left_anti").unionByName(spread.where("not full").select("k", "g", "pos"))
    mask = F.lit((1 << BITS) - 1).cast("long")
    p = F.shiftright("pos", 2 * BITS)
    whole = sure.select("k", (p - F.shiftright("pos", BITS).bitwiseAND(mask)).alias("s"), (p - F.col("pos").bitwiseAND(mask)).alias("e"))
    runs = settle(contexts(keyed, open_, shape, scratch), length).unionByName(whole)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                out = []
                for lists in part.column(1).to_pylist():
                    a = np.array([(x["s"], x["e"]) for x in lists], dtype=np.int64)
                    a = a[np.argsort(a[:, 0], kind="stable")]
                    end = np.maximum.accumulate(a[:, 1]) + length
                    cut = np.flatnonzero(a[1:, 0] > end[:-1])
                    first, last = np.concatenate([[0], cut + 1]), np.concatenate([cut, [len(a) - 1]])
                    out.append([{"a": x, "b": y} for x, y in zip(a[first, 0].tolist(), end[last].tolist())])
                kind = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, kind)], names=["k", "spans"])

    per_doc = runs.groupBy("k").agg(F.collect_list(F.struct("s", "e")).alias("runs"))
    return scratch.cut(per_doc.mapInArrow(merge, "k long, spans array<struct<a: long, b: long>>"), "spans")


def remove_repeats(docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text",
                   hot_group: int = HOT_GROUP) -> DataFrame:
    """One row per input row: id, n_bytes, n_removed, n_spans, kept_sha256,
    spans (removed byte ranges [a, b)) and kept (the remaining bytes)."""
    scratch = Scratch(docs.sparkSession, "repeats")
    keyed = row_keys(docs, id_col, text_col, scratch)
    spans = repeated_spans(keyed, length, scratch, hot_group)
    total = spans.agg(F.coalesce(F.sum(F.size("spans")), F.lit(0))).first()[0]
    side = F.broadcast(spans) if total <= BROADCAST_POSITIONS else spans
    rows = keyed.select("_k", "_id", F.col("_text").cast("binary").alias("_raw")).join(side, F.col("_k") == F.col("k"), "left")
    kind = dict(keyed.dtypes)["_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                kept = []
                for raw, cut in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                    if cut:
                        ends = [0] + [x["b"] for x in cut]
                        raw = b"".join(raw[a:b] for a, b in zip(ends, [x["a"] for x in cut] + [len(raw)]))
                    kept.append(raw)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), part.column(3), pa.array(kept, pa.binary())],
                                                 names=["_id", "spans", "n_bytes", "kept"])

    out = rows.select("_id", "_raw", "spans", F.octet_length("_raw").cast("long").alias("n_bytes")).mapInArrow(
        run, f"_id {kind}, spans array<struct<a: long, b: long>>, n_bytes long, kept binary")
    return out.select(F.col("_id").alias(id_col), "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
                      F.coalesce(F.size("spans"), F.lit(0)).cast("long").alias("n_spans"),
                      F.sha2("kept", 256).alias("kept_sha256"), "spans", "kept")
