"""SentencePiece encoding and decoding by streaming Viterbi.

The best segmentation of a text into the model's pieces (largest sum of their
scores) is found left to right.  Only the last ``longest piece`` positions can
still start a piece; behind them, positions that no surviving path uses are
forgotten, and as soon as all surviving backpointer paths run through one
boundary the ids up to it are committed.  Memory is bounded by the window and
the stretch on which paths still differ, for texts of any length.

Two boundaries are known before: no piece holds a space sign behind another
character, and a character that no longer piece uses stands alone.  All paths
meet there, so the stretches between them are segmented on their own, and the
ids of short stretches are remembered (a bounded table per worker).  The short
stretches of many texts that are not remembered are searched side by side, one
character of all of them at a time (``Lattice``); the search is the same.

A character without a piece becomes its UTF-8 byte pieces (or the unknown id
if the model has none).  The scores are used as they are: for a model made by
pair merges they rank the merges, and the result is the best path under these
ranks, which can differ from replaying the merges.

* Null and empty texts have no ids; no ids decode to the empty text.
* Decoding gives back the text, except that the space sign U+2581 itself comes
  back as a space.  Ids outside the vocabulary decode like the unknown id.
* All columns of the input are kept; a column named like an output is replaced.
* Each row stands alone: repeated rows give the same ids, an empty table gives
  an empty one.  Of two segmentations with equal scores the one whose last
  piece begins first stays.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from math import inf

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: How a piece is used (``type`` in the model file).
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Key of a piece's (id, score) in the trie of characters; characters of a piece looked up at once.
PIECE, HEAD = 0, 3
#: Stretches up to this length are remembered, so many at once.
KNOWN_CHARS, KNOWN = 64, 200_000
#: Texts are encoded together up to so many characters, a longer one in runs of so many stretches; new stretches are
#: searched side by side in blocks of so many cells, fewer than ``FEW`` one by one.
TOGETHER, RUN, CELLS, FEW = 1 << 20, 1 << 17, 1 << 18, 100


@dataclass
class Model:
    pieces: dict[str, tuple[int, float]]
    bytes_: list[int]
    unk_id: int
    unk_score: float
    text_of: list[bytes]
    dummy_prefix: bool
    squeeze: bool
    longest: int = 1
    trie: dict = field(default_factory=dict)
    singles: set[str] = field(default_factory=set)
    heads: dict = field(default_factory=dict)
    chars_of: dict[int, int] = field(default_factory=dict)
    stretches: re.Pattern | None = None


def load_model(data: bytes) -> Model:
    """The model file's pieces and the normaliser's settings."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    proto.ParseFromString(data)
    norm = proto.normalizer_spec
    if norm.precompiled_charsmap:
        raise ValueError("models with a character map in their normaliser are not supported")
    pieces, text_of, byte_ids, unk = {}, [], [-1] * 256, 0
    for i, p in enumerate(proto.pieces):
        text_of.append(p.piece.replace(SPACE, " ").encode())
        if p.type in (NORMAL, USER_DEFINED):
            pieces[p.piece] = (i, float(p.score))
        elif p.type == BYTE:
            byte_ids[int(p.piece[1:-1], 16)] = i
            text_of[-1] = bytes([int(p.piece[1:-1], 16)])
        elif p.type == UNKNOWN:
            unk, text_of[-1] = i, " ⁇ ".encode()
        else:
            text_of[-1] = b""
    lowest = min((s for _, s in pieces.values()), default=0.0)
    m = Model(pieces, byte_ids if min(byte_ids) >= 0 else [], unk, lowest - 10.0, text_of, norm.add_dummy_prefix,
              norm.remove_extra_whitespaces)
    for p, found in pieces.items():
        m.longest = max(m.longest, len(p))
        node = m.trie
        for c in p:
            node = node.setdefault(c, {})
        node[PIECE] = found
    m.singles = {p for p in pieces if len(p) == 1}
    m.chars_of = {i: len(p) for p, (i, _) in pieces.items()}
    joined = {c for p in pieces if len(p) > 1 for c in p}
    lone = re.escape("".join(c for c in map(chr, range(128)) if c not in joined))
    inside = any(SPACE in p.lstrip(SPACE) for p in pieces)
    if not inside:
        m.stretches = re.compile(f"{SPACE}+[^{SPACE}{lone}]*|[^{SPACE}{lone}]+|[{lone}]" if lone else f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
    return m


def normalise(m: Model, text: str) -> str:
    if m.squeeze:
        text = " ".join(x for x in text.split(" ") if x)
    if not text:
        return ""
    return (SPACE if m.dummy_prefix else "") + text.replace(" ", SPACE)


def head(m: Model, chars: str) -> tuple[list[tuple[int, int, float]], dict | None]:
    """Of pieces that begin where ``chars`` (at most ``HEAD`` of them) do:
    (length, id, score) of those that end within, a character without a piece
    counting as unknown, and the trie node for those that go on.  Remembered
    in a bounded table."""
    ends, node = [], m.trie
    for k, c in enumerate(chars):
        node = node.get(c)
        if node is None:
            break
        hit = node.get(PIECE)
        if hit is not None:
            ends.append((k + 1, *hit))
    if chars[0] not in m.singles:
        ends.append((1, m.unk_id, m.unk_score))
    if len(m.heads) >= KNOWN:
        m.heads.clear()
    m.heads[chars] = found = (ends, node if len(chars) == HEAD else None)
    return found


def viterbi(m: Model, text: str) -> Iterator[int]:
    """Piece ids of ``text``, committed as soon as they are certain."""
    n, longest = len(text), m.longest
    # Of reached positions: best score, where its last piece began, that piece's id.
    score, came, by = {0: 0.0}, {}, {}
    # Of settled positions that survive: how many survivors came from there, and the xor of their positions.
    kids, which = {0: 0}, {0: 0}
    root = 0
    for i in range(n):
        if i:
            p = came[i]
            kids[i], which[i] = 0, 0
            kids[p] += 1
            which[p] ^= i
        base, chars = score[i], text[i:i + HEAD]
        ends, node = m.heads.get(chars) or head(m, chars)
        for size, piece, gain in ends:
            if base + gain > score.get(i + size, -inf):
                score[i + size], came[i + size], by[i + size] = base + gain, i, piece
        j = i + HEAD
        while node is not None and j < n:
            node = node.get(text[j])
            j += 1
            hit = node.get(PIECE) if node else None
            if hit is not None and base + hit[1] > score.get(j, -inf):
                score[j], came[j], by[j] = base + hit[1], i, hit[0]
        gone = i - longest  # no later piece can start here
        if gone >= 0:
            del score[gone]
            x = gone
            while x != root and kids[x] == 0:
                p = came.pop(x)
                del kids[x], which[x], by[x]
                kids[p] -= 1
                which[p] ^= x
                x = p
            while root <= gone and kids[root] == 1:
                nxt = which[root]
                yield from emit(m, by[nxt], text[root:nxt])
                del kids[root], which[root]
                came.pop(root, None)
                by.pop(root, None)
                root = nxt
    # The end is the only survivor: what it did not come through is forgotten.
    yield from along(m, text, came, by, root, n)


def whole(m: Model, text: str) -> list[int]:
    """The same for a text that fits into the window: nothing leaves it, so
    nothing is certain before the end."""
    n, heads = len(text), m.heads
    score, came, by = [0.0] + [-inf] * n, [0] * (n + 1), [0] * (n + 1)
    for i in range(n):
        base, chars = score[i], text[i:i + HEAD]
        ends, node = heads.get(chars) or head(m, chars)
        for size, piece, gain in ends:
            gain += base
            size += i
            if gain > score[size]:
                score[size] = gain
                came[size] = i
                by[size] = piece
        if node is None:
            continue
        j = i + HEAD
        while node is not None and j < n:
            node = node.get(text[j])
            j += 1
            hit = node.get(PIECE) if node else None
            if hit is not None and base + hit[1] > score[j]:
                score[j], came[j], by[j] = base + hit[1], i, hit[0]
    return along(m, text, came, by, 0, n)


def along(m: Model, text: str, came, by, root: int, end: int) -> list[int]:
    """Ids of the path from ``root`` to ``end``."""
    out, unk = [], m.unk_id
    while end != root:
        if by[end] == unk:
            out += reversed(emit(m, unk, text[came[end]:end]))
        else:
            out.append(by[end])
        end = came[end]
    out.reverse()
    return out


def emit(m: Model, piece: int, text: str) -> list[int]:
    if piece != m.unk_id or not m.bytes_:
        return [piece]
    return [m.bytes_[b] for b in text.encode("utf-8", "surrogatepass")]


class Lattice:
    """The trie as flat arrays, and the search of ``whole`` on many stretches
    at once.  A node is a slot; its child by the character class ``c`` is slot
    ``base[node] + c`` if ``owner`` of that slot is the node."""

    def __init__(self, m: Model):
        self.m = m
        alphabet = sorted({c for p in m.pieces for c in p})
        # Class 0 is every other character; no node has a child by it.
        self.class_of = np.zeros(0x110000, dtype=np.int32)
        self.class_of[[ord(c) for c in alphabet]] = np.arange(1, len(alphabet) + 1)
        self.alone = np.full(len(alphabet) + 1, m.unk_id, dtype=np.int32)
        self.alone_gain = np.full(len(alphabet) + 1, m.unk_score)
        for k, c in enumerate(alphabet, 1):
            if c in m.singles:
                self.alone[k], self.alone_gain[k] = m.pieces[c]
        self._place({c: k for k, c in enumerate(alphabet, 1)})

    def _place(self, class_of: dict[str, int]) -> None:
        """Gives every node its slot: nodes with most children first, each at
        the first place where its children find free slots."""
        nodes, children, hits = [self.m.trie], [], []
        for node in nodes:
            below = [(class_of[c], x) for c, x in node.items() if c != PIECE]
            children.append((np.array(sorted(k for k, _ in below), dtype=np.int64), len(nodes)))
            nodes += [x for _, x in sorted(below, key=lambda x: x[0])]
            hits.append(node.get(PIECE))
        width = len(class_of) + 1
        free = np.ones(2 * len(nodes) + 3 * width, dtype=bool)
        free[:width] = False  # slot 0 is the root
        slot, base_of = np.zeros(len(nodes), dtype=np.int64), np.zeros(len(nodes), dtype=np.int64)
        low = width
        for i in sorted((i for i, (k, _) in enumerate(children) if len(k) > 1), key=lambda i: -len(children[i][0])):
            keys, first = children[i]
            low += int(free[low:].argmax())
            at, span = low, int(keys[-1] - keys[0])
            while True:
                if at + 1024 + span > len(free):
                    free = np.append(free, np.ones(1024 + span + width, dtype=bool))
                fits = free[at:at + 1024].copy()
                for k in (keys[1:] - keys[0]).tolist():
                    fits &= free[at + k:at + k + 1024]
                if fits.any():
                    break
                at += 1024
            base_of[i] = at + int(fits.argmax()) - keys[0]
            slot[first:first + len(keys)] = base_of[i] + keys
            free[base_of[i] + keys] = False
        # An only child goes anywhere.
        single = [(i, first, int(k[0])) for i, (k, first) in enumerate(children) if len(k) == 1]
        for (i, first, key), at in zip(single, np.flatnonzero(free).tolist()):
            slot[first], base_of[i] = at, at - key
        slots = len(free) + width
        self.base, self.owner = np.zeros(slots, dtype=np.int64), np.full(slots, -1, dtype=np.int64)
        self.piece, self.gain = np.full(slots, -1, dtype=np.int32), np.zeros(slots)
        self.base[slot] = base_of
        for i, (keys, first) in enumerate(children):
            self.owner[slot[first:first + len(keys)]] = slot[i]
            if hits[i] is not None:
                self.piece[slot[i]], self.gain[slot[i]] = hits[i]

    def search(self, stretches: list[str]) -> list[bytes]:
        """Ids of each stretch, as ``whole`` finds them; longest stretches first."""
        out, at = [], 0
        while at < len(stretches):
            n = max(1, CELLS // len(stretches[at]))
            out += self._block(stretches[at:at + n])
            at += n
        return out

    def _block(self, stretches: list[str]) -> list[bytes]:
        lengths = np.array([len(s) for s in stretches])
        n, longest = len(stretches), int(lengths[0])
        starts = np.cumsum(lengths) - lengths
        flat = self.class_of[np.frombuffer("".join(stretches).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
        # The first ``reach[i]`` stretches are longer than i characters.
        reach = np.searchsorted(-lengths, -np.arange(longest + 1)).tolist()
        chars = np.zeros((longest, n), dtype=np.int32)
        for i in range(longest):
            chars[i, :reach[i]] = flat[starts[:reach[i]] + i]
        score = np.full((longest + 1, n), -inf)
        score[0] = 0.0
        size, by = np.zeros((longest + 1, n), dtype=np.int16), np.zeros((longest + 1, n), dtype=np.int32)
        for i in range(longest):
            here, c = score[i, :reach[i]], chars[i, :reach[i]]
            found = here + self.alone_gain[c]
            rows = np.flatnonzero(found > score[i + 1, :reach[i]])
            score[i + 1, rows], size[i + 1, rows], by[i + 1, rows] = found[rows], 1, self.alone[c[rows]]
            node = self.base[0] + c
            rows = np.flatnonzero(self.owner[node] == 0)
            node = node[rows]
            for j in range(i + 1, longest):
                # Where a stretch has ended the character is class 0, which leads nowhere.
                below = self.base[node] + chars[j, rows]
                on = self.owner[below] == node
                rows, node = rows[on], below[on]
                if not len(rows):
                    break
                piece = self.piece[node]
                found = here[rows] + self.gain[node]
                better = np.flatnonzero((piece >= 0) & (found > score[j + 1, rows]))
                to = rows[better]
                score[j + 1, to], size[j + 1, to], by[j + 1, to] = found[better], j + 1 - i, piece[better]
        return self._ids(stretches, lengths, size, by)

    def _ids(self, stretches: list[str], lengths: np.ndarray, size: np.ndarray, by: np.ndarray) -> list[bytes]:
        """The best paths, followed from the ends."""
        end, rows, steps = lengths.copy(), np.arange(len(stretches)), []
        while len(rows):
            at = end[rows]
            steps.append((rows, by[at, rows]))
            end[rows] = at - size[at, rows]
            rows = rows[end[rows] > 0]
        count = np.zeros(len(stretches), dtype=np.int64)
        for rows, _ in steps:
            count[rows] += 1
        ends = np.cumsum(count)
        ids, unknown = np.empty(int(ends[-1]), dtype="<i4"), np.zeros(len(stretches), dtype=bool)
        for k, (rows, step) in enumerate(steps):
            ids[ends[rows] - 1 - k] = step
            unknown[rows[step == self.m.unk_id]] = True
        raw, cuts = ids.tobytes(), [0, *(4 * ends).tolist()]
        out = [raw[a:b] for a, b in zip(cuts[:-1], cuts[1:])]
        for r in np.flatnonzero(unknown).tolist() if self.m.bytes_ else ():
            out[r] = array("i", self._spelt(stretches[r], array("i", out[r]))).tobytes()
        return out

    def _spelt(self, text: str, ids: array) -> Iterator[int]:
        """``ids`` of ``text``, unknown characters as their bytes."""
        at = 0
        for i in ids:
            if i == self.m.unk_id:
                yield from emit(self.m, i, text[at])
                at += 1
            else:
                yield i
                at += self.m.chars_of[i]


class Encoder:
    """Encodes texts, remembering the ids of short stretches.  A full table
    becomes the older generation, from which stretches that are met again come
    back: frequent words are never lost."""

    def __init__(self, m: Model):
        self.m = m
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.lattice: Lattice | None = None

    def encode(self, text: str) -> bytes:
        """The ids as little-endian 32-bit integers."""
        parts = self._parts(normalise(self.m, text))
        return b"".join(self._joined([parts[a:a + RUN]])[0] for a in range(0, len(parts), RUN))

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, new short stretches of all searched side by side."""
        return self._joined(self._parts(normalise(self.m, t)) for t in texts)

    def _joined(self, lists: Iterable[list[str]]) -> list[bytes]:
        """The ids of each list of stretches."""
        made, gaps, known = [], [], self.known.get
        for parts in lists:
            ids = list(map(known, parts))
            if None in ids:
                gaps.append((ids, [(k, s) for k, (s, x) in enumerate(zip(parts, ids)) if x is None]))
            made.append(ids)
        found = self._found({s for _, gap in gaps for _, s in gap})
        for ids, gap in gaps:
            for k, s in gap:
                ids[k] = found[s]
        return [b"".join(ids) for ids in made]

    def _found(self, stretches: set[str]) -> dict[str, bytes]:
        """The ids of stretches that are not in the table."""
        found = {s: x for s in stretches if (x := self.older.get(s)) is not None}
        new = [s for s in stretches if s not in found and len(s) <= KNOWN_CHARS]
        if len(new) >= FEW:
            self.lattice = self.lattice or Lattice(self.m)
            new.sort(key=len, reverse=True)
            found.update(zip(new, self.lattice.search(new)))
        for s in stretches:
            if s not in found:
                found[s] = array("i", viterbi(self.m, s) if len(s) > self.m.longest else whole(self.m, s)).tobytes()
            if len(s) <= KNOWN_CHARS:
                if len(self.known) >= KNOWN:
                    self.older = dict(self.known)
                    self.known.clear()
                self.known[s] = found[s]
        return found

    def _parts(self, text: str) -> list[str]:
        return self.m.stretches.findall(text) if self.m.stretches else ([text] if text else [])


#: The encoder of the model last used in this process: tasks on one worker share what they remember.
_LAST: dict[str, Encoder] = {}


def encoder(data: bytes) -> Encoder:
    """The worker's encoder for a model file."""
    key = hashlib.sha256(data).hexdigest()
    if key not in _LAST:
        _LAST.clear()
        _LAST[key] = Encoder(load_model(data))
    return _LAST[key]


def decode(m: Model, ids: list[int]) -> str:
    n, text_of, unk = len(m.text_of), m.text_of, m.unk_id
    try:
        raw = b"".join([text_of[i] for i in ids]) if not ids or min(ids) >= 0 else None
    except (IndexError, TypeError):
        raw = None
    if raw is None:
        raw = b"".join(text_of[i if i is not None and 0 <= i < n else unk] for i in ids)
    text = raw.decode("utf-8", "replace")
    return text[1:] if m.dummy_prefix and text.startswith(" ") else text


def _lists(ids: pa.ListArray) -> Iterator[list[int]]:
    """The lists of an array, taken from its flat values (a null list is empty)."""
    if ids.null_count or ids.values.null_count:
        yield from (x.as_py() or [] for x in ids)
        return
    ends, values = ids.offsets.to_numpy(), ids.values.to_numpy()
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
        yield values[a:b].tolist()


def _slices(batch: pa.RecordBatch, rows: int = 500) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def _with(batch: pa.RecordBatch, keep: list[str], made: list[pa.Array], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in keep] + made, names=[*keep, *names])


def _model(df: DataFrame, model_path: str):
    """The model file (its size doesn't depend on the data), read on the driver and broadcast."""
    with open(model_path, "rb") as f:
        data = f.read()
    return df.sparkSession.sparkContext.broadcast(data)


def _columns(df: DataFrame, *made: T.StructField) -> tuple[list[str], T.StructType]:
    keep = [c for c in df.columns if c not in [f.name for f in made]]
    return keep, T.StructType([df.schema[c] for c in keep] + list(made))


def _encoded(enc: Encoder, part: pa.RecordBatch, text_col: str) -> list[bytes]:
    """The ids of the rows' texts, taken together up to ``TOGETHER`` characters."""
    out, texts, chars = [], [], 0
    for t in part.column(part.schema.get_field_index(text_col)):
        t = t.as_py() or ""
        if chars + len(t) > TOGETHER:
            out += enc.encode_all(texts)
            texts, chars = [], 0
        if len(t) > TOGETHER:
            out.append(enc.encode(t))
            continue
        texts.append(t)
        chars += len(t)
    return out + enc.encode_all(texts)


def _id_lists(made: list[bytes]) -> pa.ListArray:
    ends = np.cumsum([0] + [len(x) // 4 for x in made], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(made), dtype=np.int32)))


def encode_texts(df: DataFrame, text_col: str = "text", ids_col: str = "ids", model_path: str = MODEL) -> DataFrame:
    """``df`` with ``ids_col`` (array<int>), the piece ids of ``text_col``."""
    data = _model(df, model_path)
    keep, schema = _columns(df, T.StructField(ids_col, T.ArrayType(T.IntegerType(), False), False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(data.value)
        for batch in batches:
            for part in _slices(batch):
                yield _with(part, keep, [_id_lists(_encoded(enc, part, text_col))], [ids_col])

    return df.mapInArrow(run, schema)


def decode_ids(df: DataFrame, ids_col: str = "ids", text_col: str = "decoded", model_path: str = MODEL) -> DataFrame:
    """``df`` with ``text_col``, the text of the piece ids in ``ids_col``."""
    data = _model(df, model_path)
    keep, schema = _columns(df, T.StructField(text_col, T.StringType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = encoder(data.value).m
        for batch in batches:
            for part in _slices(batch):
                texts = [decode(m, x) for x in _lists(part.column(part.schema.get_field_index(ids_col)))]
                yield _with(part, keep, [pa.array(texts, pa.string())], [text_col])

    return df.mapInArrow(run, schema)


def round_trip(df: DataFrame, text_col: str = "text", model_path: str = MODEL) -> DataFrame:
    """``df`` with ``ids``, the text ``decoded`` from them, and whether that is
    the text again (``same``): encoded and decoded in one pass over the rows."""
    data = _model(df, model_path)
    keep, schema = _columns(df, T.StructField("ids", T.ArrayType(T.IntegerType(), False), False),
                            T.StructField("decoded", T.StringType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(data.value)
        for batch in batches:
            for part in _slices(batch):
                ids = _id_lists(_encoded(enc, part, text_col))
                texts = [decode(enc.m, x) for x in _lists(ids)]
                yield _with(part, keep, [ids, pa.array(texts, pa.string())], ["ids", "decoded"])

    want = F.translate(F.coalesce(F.col(text_col), F.lit("")), SPACE, " ")
    return df.mapInArrow(run, schema).withColumn("same", F.col("decoded") == want)
