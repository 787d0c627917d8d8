"""Toxicity: a linear classifier on character n-grams whose features are scaled
by naive Bayes log-count ratios.

A text's features are the character n-grams (``NGRAMS``) of its lower-cased
words with word boundaries, present or not, hashed into ``BUCKETS`` buckets.
The ratio of a feature is log of its smoothed share among toxic texts over its
share among the others; a logistic regression with an L2 penalty is fitted on
presence times ratio.  Scoring sums weight times ratio over the features of
the whole text.

The fit uses a bounded sample: at most ``TOXIC_ROWS`` and ``CLEAN_ROWS``
labelled rows in hash order.  Only texts and the label are used; id, language
and source are never features.

* Null and empty texts have no features; their score is the base rate's.
* Rows without label, and labels without document, are not learnt from.
* With labels of one kind only, or none, every text gets the smoothed rate.
* Repeated rows count as often as they occur; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.llm.language import held_out, is_letter

NGRAMS = (3, 4, 5, 6)
BITS = 18
BUCKETS, SHIFT = 1 << BITS, np.uint64(64 - BITS)
#: Bounds of the labelled sample.
TOXIC_ROWS, CLEAN_ROWS = 2_000, 6_000
#: Features of fewer sample texts, or of a ratio closer to zero, are left out.
MIN_TEXTS, MIN_RATIO = 5, 0.1
ODD = np.uint64(0x9E3779B97F4A7C15)


class Features:
    """Distinct feature buckets of texts."""

    def __init__(self, letters: np.ndarray) -> None:
        self.letters = letters
        self.latest = np.zeros(BUCKETS, dtype=np.int64)

    def text(self, text: str | None) -> np.ndarray:
        """Code points in lower case, everything but letters as one boundary
        between words; an n-gram lies in a word with a boundary on either side."""
        if not text:
            return np.zeros(0, dtype=np.int64)
        chars = np.frombuffer((" " + text.lower() + " ").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        chars = np.where(self.letters[chars], chars, 0)
        chars = chars[np.concatenate([[True], (chars[1:] != 0) | (chars[:-1] != 0)])]
        if len(chars) < 3:
            return np.zeros(0, dtype=np.int64)
        # Steps to the next boundary behind each place.
        ends = np.flatnonzero(chars == 0)
        at = np.arange(len(chars))
        steps = ends[np.minimum(np.searchsorted(ends, at, side="right"), len(ends) - 1)] - at
        h = chars.astype(np.uint64) * ODD
        made = []
        for n in range(2, max(NGRAMS) + 1):
            h = (h[:-1] ^ (h[:-1] >> np.uint64(29))) * ODD + chars[n - 1:]
            if not h.size:
                break
            if n in NGRAMS:
                made.append((((h ^ (h >> np.uint64(31))) * ODD) >> SHIFT)[steps[:len(h)] >= n - 1])
        found = np.concatenate(made).astype(np.int64)
        # One of each: the place that was written last.
        place = np.arange(len(found))
        self.latest[found] = place
        return found[self.latest[found] == place]


@dataclass
class Model:
    weights: np.ndarray  # weight times ratio by bucket
    bias: float
    letters: np.ndarray  # whether a code point is a letter

    def features(self) -> Features:
        return Features(self.letters)


def fit(texts: list[str | None], toxic: list[int], penalty: float = 1.0, steps: int = 60) -> Model:
    y = np.asarray(toxic, dtype=np.float64)
    rate = (y.sum() + 1) / (len(y) + 2)
    base = Model(np.zeros(BUCKETS, dtype=np.float32), float(np.log(rate / (1 - rate))), is_letter())
    if not len(y) or y.min() == y.max():
        return base
    made = base.features()
    sets = [made.text(t).astype(np.int32) for t in texts]
    sizes = np.array([len(x) for x in sets])
    cols = np.concatenate(sets)
    del sets, made
    blocks = list(_blocks(sizes))

    width = BUCKETS

    def spread(per_text: np.ndarray) -> np.ndarray:
        """Per feature, the sum of its texts' values."""
        out = np.zeros(width)
        for a, b, lo, hi in blocks:
            out += np.bincount(cols[lo:hi], weights=np.repeat(per_text[a:b], sizes[a:b]), minlength=width)
        return out

    def gather(per_feature: np.ndarray) -> np.ndarray:
        """Per text, the sum of its features' values."""
        out = np.zeros(len(sizes))
        for a, b, lo, hi in blocks:
            run = np.concatenate([[0.0], np.cumsum(per_feature[cols[lo:hi]])])
            ends = np.concatenate([[0], np.cumsum(sizes[a:b])])
            out[a:b] = run[ends[1:]] - run[ends[:-1]]
        return out

    pos, neg = spread(y), spread(1 - y)
    used = pos + neg >= MIN_TEXTS
    ratio = np.where(used, np.log((pos + 1) / (pos + 1).sum()) - np.log((neg + 1) / (neg + 1).sum()), 0.0)
    used &= np.abs(ratio) >= MIN_RATIO
    names = np.flatnonzero(used)
    if not names.size:
        return base
    # From here on only features in use, in their compact numbering.
    number = np.full(BUCKETS, -1, dtype=np.int32)
    number[names] = np.arange(len(names), dtype=np.int32)
    cols = number[cols]
    sizes = np.array([int((cols[lo:hi] >= 0).sum()) for lo, hi in zip(np.cumsum(sizes) - sizes, np.cumsum(sizes))])
    cols, width, ratio = cols[cols >= 0], len(names), ratio[names]
    blocks = list(_blocks(sizes))

    def loss(w: np.ndarray, b: float) -> tuple[float, np.ndarray, float]:
        z = gather(w * ratio) + b
        p = 1 / (1 + np.exp(-np.clip(z, -35, 35)))
        g = p - y
        value = float(np.sum(np.logaddexp(0, z) - y * z) + penalty / 2 * w @ w)
        return value, spread(g) * ratio + penalty * w, float(g.sum())

    w, b = np.zeros(len(names)), base.bias
    # Limited-memory BFGS with backtracking.
    value, gw, gb = loss(w, b)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    x, g = np.append(w, b), np.append(gw, gb)
    for _ in range(steps):
        d, alphas = -g, []
        for s, t in reversed(past):
            a = s @ d / (s @ t)
            alphas.append(a)
            d = d - a * t
        if past:
            s, t = past[-1]
            d = d * (s @ t) / (t @ t)
        for (s, t), a in zip(past, reversed(alphas)):
            d = d + s * (a - t @ d / (s @ t))
        step = 1.0 if past else 1.0 / max(1.0, np.abs(g).sum())
        slope = g @ d
        for _ in range(30):
            nx = x + step * d
            nv, ngw, ngb = loss(nx[:-1], nx[-1])
            if nv <= value + 1e-4 * step * slope:
                break
            step /= 2
        else:
            break
        ng = np.append(ngw, ngb)
        s, t = nx - x, ng - g
        if s @ t > 1e-12:
            past = [*past[-7:], (s, t)]
        done = value - nv < 1e-4 * max(1.0, abs(value))
        x, g, value = nx, ng, nv
        if done:
            break
    weights = np.zeros(BUCKETS, dtype=np.float32)
    weights[names] = x[:-1] * ratio
    return Model(weights, float(x[-1]), base.letters)


def _blocks(sizes: np.ndarray, most: int = 500_000) -> Iterator[tuple[int, int, int, int]]:
    """Runs of texts with about ``most`` features: first, end, and the same of
    their features.  The fit touches one at a time, which bounds its memory."""
    ends = np.concatenate([[0], np.cumsum(sizes)])
    a = 0
    while a < len(sizes):
        b = max(a + 1, int(np.searchsorted(ends, ends[a] + most, side="right")) - 1)
        yield a, b, int(ends[a]), int(ends[b])
        a = b


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str,
                    folds: int, fold: int) -> tuple[list[str | None], list[int]]:
    """At most ``TOXIC_ROWS`` and ``CLEAN_ROWS`` rows in hash order of the id,
    picked from the labels before any text is touched."""
    marked = (labels.select(F.col(id_col).alias("_i"), F.col(label_col).cast("int").alias("_y"))
              .where(F.col("_y").isin(0, 1) & F.col("_i").isNotNull() & ~held_out("_i", folds, fold)))
    text = docs.select(F.col(id_col).alias("_i"), F.col(text_col).alias("_t"))
    out: list = []
    for y, most in ((1, TOXIC_ROWS), (0, CLEAN_ROWS)):
        # A top-k each, first of the labels, so that few texts are touched, then of the rows that bear their ids,
        # since ids may repeat: at most TOXIC_ROWS + CLEAN_ROWS texts, whatever the data.
        some = marked.where(F.col("_y") == y).orderBy(F.xxhash64("_i"), "_i").limit(most)
        out += (text.join(F.broadcast(some), "_i").orderBy(F.xxhash64("_i"), "_i", F.xxhash64("_t"))
                .limit(most).select("_t", "_y").collect())
    return [r["_t"] for r in out], [r["_y"] for r in out]


def score_texts(docs: DataFrame, model: Model, text_col: str, out: str = "score") -> DataFrame:
    keep = [c for c in docs.columns if c not in (text_col, out)]
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(out, T.DoubleType(), False)])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        made = m.features()
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col))
            z = np.array([m.bias + float(m.weights[made.text(t.as_py())].sum()) for t in texts], dtype=np.float64)
            p = 1 / (1 + np.exp(-np.clip(z, -35, 35)))
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in keep] + [pa.array(p)],
                                             names=[*keep, out])

    return docs.mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             label_col: str = "toxic", folds: int = 5, fold: int = 0) -> DataFrame:
    """(id, held_out, score, predicted) of every row, learnt outside the held-out fold."""
    model = fit(*labelled_sample(docs, labels, id_col, text_col, label_col, folds, fold))
    narrow = docs.select(id_col, held_out(id_col, folds, fold).alias("held_out"), F.col(text_col).alias("_text"))
    return score_texts(narrow, model, "_text").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
