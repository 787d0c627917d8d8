"""Language ID by cross-parsing entropy.

A suffix automaton of each language's labelled sample text accepts exactly the
substrings of that text.  A document is cut greedily into phrases, each the
longest match with the sample; few long phrases mean that the sample predicts
it well.  A phrase costs log2(sample length) bits for its place and
``LENGTH_BITS`` for its length; a character that the sample lacks costs the bits
of the common alphabet besides, so that a tiny sample does not code texts
cheaply.  Bits over document length estimate the cross entropy; the language
with the least wins.

The automaton is flattened into one transition table in which a failing
character closes the phrase and starts the next one, so parsing is one table
look-up per character, done for all documents of a batch and all languages at
once with numpy.  Texts are parsed whole; a phrase ends at the latest at every
``SEGMENT`` characters, which bounds a batch's steps for very long texts.

Characters are letters in lower case; a run of anything else is one separator.
Samples with more letters than the table has columns (``ALPHABET``) keep them all
apart: the rarer ones are spelt with three codes.

* A text that is null or has no letter is ``und`` with score 0.
* Without any learnable row every text is ``und`` with score 0.  Rows without
  a letter and rows labelled ``und`` are not learnt from.
* Ties go to the language that sorts first.  Repeated rows get equal results,
  columns other than those named are never read, an empty table gives none.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bounds of the labelled sample: rows a language, characters a row, characters a language.
SAMPLE_ROWS, ROW_CHARS, SAMPLE_CHARS = 48, 4_000, 20_000
#: Characters after which a phrase ends at the latest, and characters parsed at once.
SEGMENT, BATCH_CHARS = 16_384, 2_000_000
SEP, OTHER, FIRST = 0, 1, 2
#: Letters that may have a code each.  Beyond that only the ``SINGLES`` most frequent have one, and every other
#: letter of the samples is spelt with three: one of ``LEADS`` and two of ``DIGITS``, enough for all of Unicode.
ALPHABET, SINGLES, LEADS, DIGITS, SPELT = 250, 120, 14, 100, 255
#: Bits for the length of a phrase.
LENGTH_BITS = 3.0
UNDETERMINED = "und"


def suffix_automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions of the automaton of all substrings of ``codes``; state 0 is the empty one."""
    nxt: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in codes:
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return nxt


@dataclass
class Letters:
    codes: np.ndarray  # code of each code point
    rank: np.ndarray | None  # of letters that are spelt: their number
    width: int  # codes in use


@dataclass
class Model:
    langs: list[str]
    letters: Letters
    width: int
    table: np.ndarray  # (next state * width) * 4 + phrases closed, by state * width + code
    roots: np.ndarray  # first state * width of each language
    logs: np.ndarray  # log2 of each sample's length
    lacks: np.ndarray  # bits for each code that a sample lacks, else 0 (languages x codes)


def alphabet(texts: list[str], most: int = ALPHABET) -> Letters:
    """Codes under which all letters of the texts stay apart."""
    codes = np.where(is_letter(), OTHER, SEP).astype(np.uint8)
    counts = Counter(c for t in texts for c in t.lower() if c.isalpha())
    order = [ord(c) for c, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))]
    single = order if len(order) <= most else order[:SINGLES]
    codes[single] = FIRST + np.arange(len(single))
    if len(single) == len(order):
        return Letters(codes, None, FIRST + len(single))
    rank = np.zeros(len(codes), dtype=np.int32)
    spelt = order[SINGLES:]
    codes[spelt] = SPELT
    rank[spelt] = np.arange(len(spelt))
    return Letters(codes, rank, FIRST + SINGLES + LEADS + DIGITS)


def fit(samples: dict[str, str]) -> Model:
    """The model of sample texts by language."""
    samples = {k: t for k, t in samples.items() if k != UNDETERMINED and any(c.isalpha() for c in t.lower())}
    langs = sorted(samples)
    letters = alphabet(list(samples.values()))
    width = letters.width
    tables, roots, logs, states = [], [], [], 0
    lacks = np.zeros((len(langs), width))
    for i, lang in enumerate(langs):
        codes = encode(letters, samples[lang])[:SAMPLE_CHARS]
        nxt = suffix_automaton(codes.tolist())
        t = np.empty((len(nxt), width), dtype=np.int64)
        # A code the sample lacks is a phrase of its own; it also closes an open one.
        start = np.full(width, -1, dtype=np.int64)
        for c, s in nxt[0].items():
            start[c] = s
        lacks[i, start < 0] = np.log2(width)
        t[0] = np.where(start >= 0, (states + start) * width * 4, states * width * 4 + 1)
        t[1:] = np.where(start >= 0, (states + start) * width * 4 + 1, states * width * 4 + 2)
        for s, row in enumerate(nxt):
            for c, to in row.items():
                t[s, c] = (states + to) * width * 4
        tables.append(t)
        roots.append(states * width)
        logs.append(np.log2(max(2, len(codes))))
        states += len(nxt)
    flat = np.concatenate(tables).ravel() if tables else np.zeros(0, dtype=np.int64)
    return Model(langs, letters, width, flat.astype(np.int32) if flat.size and flat.max() < 2**31 else flat,
                 np.array(roots, dtype=np.int64), np.array(logs), lacks)


def is_letter() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)


def encode(letters: Letters, text: str) -> np.ndarray:
    """Codes of the lower-cased text, runs of separators as one."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    codes = letters.codes[points]
    if codes.size > 1:
        keep = codes != SEP
        keep[1:] |= codes[:-1] != SEP
        keep[0] = True
        codes, points = codes[keep], points[keep]
    if letters.rank is None:
        return codes
    spelt = codes == SPELT
    if not spelt.any():
        return codes
    size = np.where(spelt, 3, 1)
    out, at = np.repeat(codes, size), (np.cumsum(size) - size)[spelt]
    rank, lead = letters.rank[points[spelt]], FIRST + SINGLES
    out[at] = lead + rank // DIGITS**2
    out[at + 1] = lead + LEADS + rank // DIGITS % DIGITS
    out[at + 2] = lead + LEADS + rank % DIGITS
    return out


def phrases(m: Model, texts: list[np.ndarray]) -> np.ndarray:
    """Number of phrases of each coded text for each language (languages x texts)."""
    owner, start, size, at = [], [], [], 0
    for i, t in enumerate(texts):
        for cut in range(0, len(t), SEGMENT):
            owner.append(i)
            start.append(at + cut)
            size.append(min(SEGMENT, len(t) - cut))
        at += len(t)
    out = np.zeros((len(m.langs), len(texts)), dtype=np.int64)
    if not owner:
        return out
    codes = np.concatenate(texts)
    size = np.array(size)
    order = np.argsort(-size, kind="stable")
    size, start, owner = size[order], np.array(start)[order], np.array(owner)[order]
    # Lanes sorted by length: the first ``live[t]`` of them have a character at step t.
    live = np.searchsorted(-size, -np.arange(1, size[0] + 1), side="right")
    state = np.repeat(m.roots[:, None], len(size), axis=1)
    count = np.zeros(state.shape, dtype=np.int32)
    for t in range(int(size[0])):
        k = live[t]
        got = m.table.take(state[:, :k] + codes[start[:k] + t])
        state[:, :k] = got >> 2
        count[:, :k] += (got & 3).astype(np.int32)
    count += state != m.roots[:, None]
    for row, lane in zip(out, count):
        np.add.at(row, owner, lane)
    return out


def classify(m: Model, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """Language and confidence of each text."""
    langs, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
    held: list[np.ndarray] = []
    which: list[int] = []
    size = 0

    def flush() -> None:
        if not held:
            return
        n = np.array([len(c) for c in held])
        used = np.stack([np.bincount(c, minlength=m.width) for c in held], axis=1)
        entropy = (phrases(m, held) * (m.logs[:, None] + LENGTH_BITS) + m.lacks @ used) / n
        best = entropy.argmin(axis=0)
        least = entropy.min(axis=0)
        if len(m.langs) > 1:
            second = np.partition(entropy, 1, axis=0)[1]
            sure = second / (least + second)
        else:
            sure = np.ones(len(held))
        for i, b, s in zip(which, best.tolist(), sure.tolist()):
            langs[i], scores[i] = m.langs[b], s
        held.clear()
        which.clear()

    for i, t in enumerate(texts):
        if not t or not m.langs:
            continue
        codes = encode(m.letters, t)
        if not (codes != SEP).any():
            continue
        held.append(codes)
        which.append(i)
        size += len(codes)
        if size >= BATCH_CHARS:
            flush()
            size = 0
    flush()
    return langs, scores


def sample(rows: DataFrame, lang_col: str, text_col: str) -> dict[str, str]:
    """Sample text by language: at most ``SAMPLE_ROWS`` rows with a letter in hash order, rows
    of 200 to ``ROW_CHARS`` characters first, ``ROW_CHARS`` characters of
    longer ones.  The partial top-k before the shuffle keeps a language that
    holds most rows from going to one task whole."""
    n = F.length("_t")
    base = (rows.select(F.col(lang_col).cast("string").alias("_l"), F.col(text_col).alias("_t"))
            .where((F.col("_l") != UNDETERMINED) & F.substring("_t", 1, ROW_CHARS).rlike(r"\p{L}")))
    order = [F.when(n.between(200, ROW_CHARS), 0).otherwise(1), F.xxhash64("_t"), F.substring("_t", 1, 64)]
    w = Window.partitionBy("_l").orderBy(*[F.col(c) for c in ("_o0", "_o1", "_o2")])
    few = (base.select("_l", F.substring("_t", 1, ROW_CHARS).alias("_t"), *[o.alias(f"_o{i}") for i, o in enumerate(order)])
           .withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= SAMPLE_ROWS).select("_l", "_r", "_t").collect())
    out: dict[str, list[str]] = {}
    for lang, _, text in sorted((r["_l"], r["_r"], r["_t"]) for r in few):
        out.setdefault(lang, []).append(text)
    return {k: " ".join(v) for k, v in out.items()}


def identify(docs: DataFrame, model: Model, text_col: str = "text", lang_out: str = "lang_pred",
             score_out: str = "score", letter_out: str | None = None) -> DataFrame:
    """``docs`` with the language and a score of every whole text, and, if
    ``letter_out`` names a column, whether the text has a letter, which no model
    is needed for.  The model is broadcast; its size depends on the number of
    languages and the sample's bounds alone."""
    from pyspark.sql import types as T

    keep = [c for c in docs.columns if c not in (lang_out, score_out, letter_out)]
    flag = [letter_out] if letter_out else []
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(lang_out, T.StringType()), T.StructField(score_out, T.DoubleType())]
                          + [T.StructField(c, T.BooleanType()) for c in flag])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 4_000):
                part = batch.slice(at, 4_000)
                texts = part.column(part.schema.get_field_index(text_col)).to_pylist()
                langs, scores = classify(m, texts)
                letters = [pa.array([any(map(str.isalpha, t or "")) for t in texts], pa.bool_()) for _ in flag]
                yield pa.RecordBatch.from_arrays(
                    [part.column(part.schema.get_field_index(c)) for c in keep] + [pa.array(langs, pa.string()), pa.array(scores, pa.float64())] + letters,
                    names=[*keep, lang_out, score_out, *flag])

    return docs.mapInArrow(run, schema)


def held_out(id_col: str, folds: int, fold: int):
    """Whether crc32 of the id as text is ``fold`` modulo ``folds``; a null id never is."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold, F.lit(False))


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                folds: int = 3, fold: int = 1) -> DataFrame:
    """(id, held_out, lang_pred, score), learnt from rows outside the held-out fold."""
    model = fit(sample(docs.where(~held_out(id_col, folds, fold)), lang_col, text_col))
    narrow = docs.select(id_col, held_out(id_col, folds, fold).alias("held_out"), F.col(text_col).alias("_text"))
    return identify(narrow, model, "_text").drop("_text")
