"""Benchmark decontamination: a prefix-filtered set join that finds every
occurrence of an item window in the documents.  DataFrame functions only.

A window is ``window`` consecutive words of an item; an item of fewer words
(but not none) is one window.  Containment has to be complete (similarity 1),
so the prefix that a document must share with a window is one token.  Tokens
are shingles of ``shingle`` words (all words of a shorter window), ordered by
rarity over all documents; a window's prefix is its rarest shingle.

1. Count the benchmark's shingles in all documents.
2. Join document shingles with the window prefixes on a 64-bit hash, bound the
   window's start by the shingle's position, its end by the document's length,
   and compare the window's words one for one.

Documents are never shuffled: both passes explode word positions and join with
broadcast benchmark tables inside one stage; only counts and hits leave it.
A benchmark beyond ``block`` rows is joined in blocks of that size, each
broadcast on its own, so the broadcast stays bounded for any benchmark.

* Null texts have no words: zero words, no hit.
* Equal windows of several items count for each of them.  An item without an
  id marks words but can't be named, so it doesn't count among the items.
* Repeated document rows each give a row; an empty table an empty result; an
  empty benchmark marks nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil.llm.common import Scratch, ascii_lower, row_keys

#: Separators between words, after A-Z were lowered.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Benchmark rows that one broadcast may hold (about 200 bytes each).
BLOCK = 200_000


def words_of(text: Column) -> Column:
    lowered = ascii_lower(F.coalesce(text, F.lit("")))
    return F.array_remove(F.split(lowered, SEPARATORS), "")


def item_windows(bench: DataFrame, window: int, shingle: int, item_col: str, text_col: str) -> DataFrame:
    """(item, words, len) of every window of every item."""
    items = bench.select(F.col(item_col).cast("string").alias("item"), words_of(F.col(text_col)).alias("w"))
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - window, F.lit(0)))
    return (items.where(F.size("w") > 0)
            .select("item", "w", F.explode(starts).alias("s"))
            .select("item", F.slice("w", F.col("s") + 1, window).alias("words"))
            .withColumn("len", F.size("words")))


def window_shingles(windows: DataFrame, shingle: int) -> DataFrame:
    """(win, words, len, m, off, h): the shingles of distinct windows."""
    m = F.least(F.col("len"), F.lit(shingle))
    one = (windows.withColumn("m", m)
           .select("win", "words", "len", "m", F.explode(F.sequence(F.lit(0), F.col("len") - F.col("m"))).alias("off")))
    return one.withColumn("h", _hash(F.col("words"), F.col("off"), F.col("m"), shingle))


def _hash(words: Column, pos: Column, m: Column, shingle: int) -> Column:
    """Hash of the m words from ``pos``; words beyond the array are null and
    hash as if they weren't there, which the later comparison rejects."""
    get = [F.get(words, pos + i) for i in range(shingle)]
    out = F.lit(None).cast("long")
    for k in range(1, shingle + 1):
        out = F.when(m == k, F.xxhash64(*get[:k])).otherwise(out) if k < shingle else \
            F.when(m == k, F.xxhash64(*get)).otherwise(out)
    return out


def _positions(keyed: DataFrame, sizes: list[int], marker: bool, shingle: int) -> DataFrame:
    """(_k, _w, _pos, _h) for every word position and shingle size in use; with
    ``marker`` one more row per document at position -1 with a null hash."""
    w = keyed.select("_k", words_of(F.col("_text")).alias("_w"))
    first = F.array(F.lit(None).cast("string"))
    rows = (w.select("_k", "_w", F.posexplode(F.concat(first, F.col("_w"))).alias("_pos", "_word"))
            .withColumn("_pos", F.col("_pos") - 1) if marker else
            w.select("_k", "_w", F.posexplode("_w").alias("_pos", "_word")))
    if len(sizes) == 1:
        h = F.xxhash64("_word", *[F.get("_w", F.col("_pos") + i) for i in range(1, sizes[0])])
    else:
        rows = rows.select("*", F.explode(F.array(*[F.lit(x) for x in sizes])).alias("_m"))
        h = _hash(F.col("_w"), F.col("_pos"), F.col("_m"), shingle)
    return rows.withColumn("_h", F.when(F.col("_pos") < 0, F.lit(None).cast("long")).otherwise(h) if marker else h)


def _blocks(df: DataFrame, rows: int, block: int) -> list[DataFrame]:
    n = max(1, -(-rows // block))
    return [df] if n == 1 else [df.where(F.pmod(F.col("h"), F.lit(n)) == i) for i in range(n)]


def decontaminate(docs: DataFrame, bench: DataFrame, window: int = 10, shingle: int = 5, id_col: str = "doc_id",
                  text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
                  block: int = BLOCK) -> DataFrame:
    """One row per document row: id, n_words, n_hit, n_items, items_sha256,
    items (sorted ids), contaminated."""
    scratch = Scratch(docs.sparkSession, "decon")
    keyed = row_keys(docs, id_col, text_col, scratch)

    owned = item_windows(bench, window, shingle, item_col, item_text_col)
    windows = scratch.cut(owned.groupBy("words", "len").agg(F.collect_set("item").alias("items"))
                          .select(F.monotonically_increasing_id().alias("win"), "words", "len", "items"), "windows")
    toks = scratch.cut(window_shingles(windows, shingle), "tokens")
    sizes = sorted(r[0] for r in toks.select("m").distinct().collect())  # at most ``shingle`` values

    hits = None
    if sizes:
        vocab = scratch.cut(toks.select("h").distinct(), "vocab")
        n_vocab, n_win = vocab.count(), windows.count()
        # 1. Rarity over all documents; hash collisions can only change which shingle serves as prefix.
        counts = None
        for part in _blocks(vocab, n_vocab, block):
            found = _positions(keyed, sizes, False, shingle).join(F.broadcast(part), F.col("_h") == F.col("h"))
            one = found.groupBy("h").agg(F.count(F.lit(1)).alias("n"))
            counts = one if counts is None else counts.unionByName(one)
        counts = scratch.cut(counts, "counts")
        # The rarest shingle of each window; a window has few, so the sort per window is small.
        rare = F.row_number().over(Window.partitionBy("win").orderBy(F.coalesce("n", F.lit(0)), "h", "off"))
        prefix = scratch.cut(toks.join(counts, "h", "left").withColumn("r", rare).where("r = 1")
                             .where("n is not null").select("h", "win", "words", "len", "off"), "prefix")
        n_prefix = prefix.count()
    else:
        n_prefix = 0

    # 2. Candidates by prefix, bounds, verification; the first block also carries one row per document.
    blank = [F.lit(None).cast(t).alias(c) for c, t in (("win", "long"), ("start", "int"), ("len", "int"))]
    n_words = F.size("_w").cast("long").alias("n_words")
    if n_prefix == 0:
        hits = keyed.select("_k", words_of(F.col("_text")).alias("_w")).select("_k", n_words, *blank)
    else:
        for i, part in enumerate(_blocks(prefix, n_prefix, block)):
            pos = _positions(keyed, sizes, i == 0, shingle)
            start = F.col("_pos") - F.col("off")
            match = ((F.col("_h") == F.col("h")) & (start >= 0) & (start + F.col("len") <= F.size("_w"))
                     & (F.slice("_w", start + 1, F.col("len")) == F.col("words")))
            if i == 0:
                # The marker row (null hash) meets one extra prefix row and passes unverified.
                mark = docs.sparkSession.range(1).select(
                    F.lit(MARK).alias("h"), F.lit(-1).cast("long").alias("win"),
                    F.array().cast("array<string>").alias("words"), F.lit(0).alias("len"), F.lit(0).alias("off"))
                part = part.unionByName(mark)
                pos = pos.withColumn("_h", F.coalesce("_h", F.lit(MARK)))
                match = (F.col("_h") == F.col("h")) & (
                    ((F.col("win") < 0) & (F.col("_pos") < 0))
                    | ((F.col("win") >= 0) & (F.col("_pos") >= 0) & (start >= 0) & (start + F.col("len") <= F.size("_w"))
                       & (F.slice("_w", F.greatest(start, F.lit(0)) + 1, F.col("len")) == F.col("words"))))
            one = pos.join(F.broadcast(part), match).select(
                "_k", n_words, F.when(F.col("win") >= 0, F.col("win")).alias("win"),
                F.when(F.col("win") >= 0, start).alias("start"), "len")
            hits = one if hits is None else hits.unionByName(one)
    hits = scratch.cut(hits, "hits")

    # Words under any occurrence: merge the intervals of one document in start order.
    spans = F.array_sort(F.collect_set(F.when(F.col("win").isNotNull(), F.struct("start", (F.col("start") + F.col("len")).alias("end")))))
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    covered = F.aggregate(
        "spans", zero,
        lambda acc, s: F.struct((acc["n"] + F.greatest(s["end"] - F.greatest(s["start"], acc["end"]), F.lit(0))).alias("n"),
                                F.greatest(acc["end"], s["end"]).alias("end")),
        lambda acc: acc["n"].cast("long"))
    per_doc = (hits.groupBy("_k").agg(F.max("n_words").alias("n_words"), spans.alias("spans"))
               .select("_k", "n_words", covered.alias("n_hit")))
    named = (hits.where("win is not null").select("_k", "win").distinct()
             .join(windows.select("win", F.explode("items").alias("item")), "win")
             .groupBy("_k").agg(F.array_sort(F.collect_set("item")).alias("items")))
    ids = keyed.select("_k", "_id")
    items = F.coalesce(F.col("items"), F.array().cast("array<string>"))
    out = ids.join(per_doc, "_k").join(named, "_k", "left").withColumn("items", items)
    return out.select(F.col("_id").alias(id_col), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                      F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "items",
                      (F.col("n_hit") > 0).alias("contaminated"))


#: Hash that stands for "the row of the document itself"; its join partner is marked by a negative window number.
MARK = -(2**62) - 11
