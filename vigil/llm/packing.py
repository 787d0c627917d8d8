"""Packing of tokenised documents into fixed windows by the sum-of-squares rule.

Documents come one after another.  What a document leaves after its full
windows goes, uncut, to the fill level h (0: a new window) for which the sum
of the squared numbers of partially filled windows per level grows least.
Those numbers stand in a level array; a placement changes two of its entries,
so the change for all levels is one vector operation.  Among equal levels the
fullest is taken.

Each task packs its own rows: nothing is shuffled, and a task that is run
again gives the same windows.  Its open windows are bounded: at ``max_open``
of them, and at the end, the fullest are filled up with pieces of the
emptiest, cut where they meet the window's end.  The one window that is left
in the end is cut at powers of two, which need no padding; so no task pads.

* Null and empty texts are the end token alone.  A very long text is cut into
  full windows; its ids are held once (4 bytes each).
* Rows with equal or null ids are separate documents; ``row`` tells them apart.
* Ties in the rule: see above.  An empty table gives an empty result.
* Only the id and the text are read, so other columns may have any name.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
WINDOW, END_ID = 2048, 1
#: Open windows of a task before they are filled up from each other (at most 2,048 ids of 4 bytes each).
MAX_OPEN = 2_000
#: Texts tokenised at once, or characters if that is less.
TEXTS, CHARS = 256, 1_000_000
#: How byte-level tokenizers divide a text (a fixed pattern).
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Numbers of a task's rows and windows start at its partition's number times this.
PER_TASK = 1 << 33

#: A piece: (row, start, ids).  A window: its pieces in order.
Piece = tuple[int, int, np.ndarray]
Window = list[Piece]


def fill(window: Window) -> int:
    return sum(len(p[2]) for p in window)


class Packer:
    """Sum-of-squares packing of one stream; methods give back closed windows."""

    def __init__(self, size: int = WINDOW, max_open: int = MAX_OPEN):
        self.size, self.max_open = size, max_open
        self.count = np.zeros(size + 1, dtype=np.int64)
        self.open: list[list[Window]] = [[] for _ in range(size)]
        self.n_open = 0

    def level(self, length: int) -> int:
        """The fill level that a rest of ``length`` tokens (fewer than a window) goes to."""
        here, there = self.count[:self.size - length + 1], self.count[length:]
        gain = 2 * (there - here) + 2
        gain[0] -= 1  # no window leaves level 0
        gain[-1] = 1 - 2 * here[-1]  # a full window is at no level
        gain[1:][here[1:] == 0] = np.iinfo(np.int64).max
        return self.size - length - int(np.argmin(gain[::-1]))

    def add(self, row: int, ids: np.ndarray) -> Iterator[Window]:
        whole = len(ids) - len(ids) % self.size
        for at in range(0, whole, self.size):
            yield [(row, at, ids[at:at + self.size])]
        rest = ids[whole:]
        if not len(rest):
            return
        at = self.level(len(rest))
        window = self.open[at].pop() if at else []
        window.append((row, whole, rest))
        if at:
            self.count[at] -= 1
            self.n_open -= 1
        yield from self.put(window, at + len(rest))
        if self.n_open >= self.max_open:
            yield from self.pour()

    def put(self, window: Window, at: int) -> Iterator[Window]:
        if at == self.size:
            yield window
        else:
            self.open[at].append(window)
            self.count[at] += 1
            self.n_open += 1

    def pour(self) -> Iterator[Window]:
        """Fill the fullest open windows with pieces of the emptiest; one at most stays open."""
        windows = [w for level in reversed(self.open) for w in level]
        self.__init__(self.size, self.max_open)
        first, last = 0, len(windows) - 1
        while first < last:
            gap = self.size - fill(windows[first])
            while gap and first < last:
                row, start, ids = windows[last].pop()
                if len(ids) > gap:
                    keep = len(ids) - gap
                    windows[last].append((row, start, ids[:keep]))
                    start, ids = start + keep, ids[keep:]
                windows[first].append((row, start, ids))
                gap -= len(ids)
                last -= not windows[last]
            if not gap:
                yield windows[first]
                first += 1
        if first == last:
            yield from self.put(windows[first], fill(windows[first]))

    def close(self) -> Iterator[Window]:
        """All that is open: full windows, then windows of falling powers of two."""
        yield from self.pour()
        for window in [w for level in self.open for w in level]:
            left = fill(window)
            pieces = iter(window)
            row, start, ids = next(pieces)
            while left:
                size, made = 1 << (left.bit_length() - 1), []
                left -= size
                while size:
                    if not len(ids):
                        row, start, ids = next(pieces)
                    made.append((row, start, ids[:size]))
                    n = len(made[-1][2])
                    start, ids, size = start + n, ids[n:], size - n
                yield made


def byte_signs() -> dict[str, int]:
    """The sign that stands for each byte in byte-level vocabularies: itself if
    it is printable, else the next one from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def by_rank(data: str):
    """A tokenizer file of byte-level merges as an encoding of ``tiktoken``,
    which gives the same ids about five times faster, or None if its merges
    are not ranked by id or its text is prepared in another way."""
    import tiktoken

    made = json.loads(data)
    model, pre = made["model"], made.get("pre_tokenizer") or {}
    plain = (model["type"] == "BPE" and pre.get("type") == "ByteLevel" and pre.get("use_regex", True)
             and not pre.get("add_prefix_space") and not made.get("normalizer")
             and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")))
    signs, vocab = byte_signs(), model["vocab"]
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model.get("merges", [])]
    if not plain or not all(s in vocab for s in signs):
        return None
    ids = [vocab.get(a + b, -1) for a, b in merges]
    if ids != sorted(set(ids)) or (ids and ids[0] <= max(vocab[s] for s in signs)):
        return None
    ranks = {bytes(signs[c] for c in t): vocab[t] for t in [*signs, *[a + b for a, b in merges]]}
    return tiktoken.Encoding("merges", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})


class Encoder:
    """Token ids of texts by a tokenizer file; strings of special tokens are ordinary text."""

    def __init__(self, data: str, end_id: int):
        from tokenizers import Tokenizer

        self.end, self.fast = np.array([end_id], dtype="<u4"), by_rank(data)
        if self.fast is None:
            self.tok = Tokenizer.from_str(data)
            self.tok.encode_special_tokens = True
            self.tok.no_truncation()
            self.tok.no_padding()

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Ids of each text with the end id, as little-endian unsigned 32-bit integers."""
        if self.fast is not None:
            made = (self.fast.encode_to_numpy(t, disallowed_special=()) for t in texts)
        else:
            made = (e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False))
        for ids in made:
            yield np.concatenate([np.asarray(ids, dtype="<u4"), self.end])


#: The encoder last used in this process, shared by a worker's tasks.
_LAST: dict[tuple[str, int], Encoder] = {}


def encoder(data: str, end_id: int) -> Encoder:
    """The worker's encoder for a tokenizer file's content."""
    key = hashlib.sha256(data.encode()).hexdigest(), end_id
    if key not in _LAST:
        _LAST.clear()
        _LAST[key] = Encoder(data, end_id)
    return _LAST[key]


def _groups(texts: list[str]) -> Iterator[list[str]]:
    """At most ``TEXTS`` texts or about ``CHARS`` characters at once."""
    group, chars = [], 0
    for t in texts:
        group.append(t)
        chars += len(t)
        if len(group) >= TEXTS or chars >= CHARS:
            yield group
            group, chars = [], 0
    if group:
        yield group


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end_id: int = END_ID,
         tokenizer_path: str = TOKENIZER, max_open: int = MAX_OPEN) -> DataFrame:
    """One row per piece: id, ``start``, ``length``, ``ids`` (its tokens as
    little-endian unsigned 32-bit integers), ``doc_tokens``, ``sequence_id``,
    ``offset`` in the sequence, and ``row``, the number of its input row."""
    with open(tokenizer_path, encoding="utf-8") as f:
        data = docs.sparkSession.sparkContext.broadcast(f.read())
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    long = T.LongType()
    schema = T.StructType([T.StructField(id_col, base.schema["id"].dataType)] + [
        T.StructField("start", long), T.StructField("length", long), T.StructField("ids", T.BinaryType()),
        T.StructField("doc_tokens", long), T.StructField("sequence_id", long), T.StructField("offset", long),
        T.StructField("row", long)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core a task
        enc, packer = encoder(data.value, end_id), Packer(window, max_open)
        next_row = next_sequence = TaskContext.get().partitionId() * PER_TASK
        known: dict[int, list] = {}  # rows with pieces still to come: id, tokens, tokens to come

        def rows_of(windows: list[Window]) -> pa.RecordBatch:
            nonlocal next_sequence
            out: list[tuple] = []
            for w in windows:
                at = 0
                for row, start, ids in w:
                    about, n = known[row], len(ids)
                    out.append((about[0], start, n, ids.tobytes(), about[1], next_sequence, at, row))
                    at += n
                    about[2] -= n
                    if not about[2]:
                        del known[row]
                next_sequence += 1
            cols = zip(*out) if out else [[] for _ in schema]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=schema.names)

        types = None
        for batch in batches:
            if types is None:
                types = [batch.schema.field("id").type, *[pa.int64()] * 2, pa.binary(), *[pa.int64()] * 4]
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            at = 0
            for part in _groups(texts.to_pylist()):
                closed: list[Window] = []
                for tokens in enc.encode(part):
                    known[next_row] = [ids[at], len(tokens), len(tokens)]
                    closed += packer.add(next_row, tokens)
                    next_row += 1
                    at += 1
                if closed:
                    yield rows_of(closed)
        closed = list(packer.close())
        if closed:
            yield rows_of(closed)

    return base.mapInArrow(run, schema)


def sequences(pieces: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per sequence of ``pack``: ``sequence_id``, ``tokens``, ``pieces``
    and ``padding`` (none at a power of two, else up to the window)."""
    total = pieces.groupBy("sequence_id").agg(F.sum("length").alias("tokens"), F.count(F.lit(1)).alias("pieces"))
    power = F.col("tokens").bitwiseAND(F.col("tokens") - 1) == 0
    return total.withColumn("padding", F.when(power, F.lit(0)).otherwise(window - F.col("tokens")).cast("long"))
