"""Toxicity scores by a character n-gram linear classifier on naive Bayes log-count ratios."""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sugarbeam.llm import kernels as K
from sugarbeam.llm.util import in_batches, kept, labelled_sample, trimmed

#: Most labelled rows that a fit uses, half of them of each class at most.
FIT_ROWS = 6_000
#: Lengths of n-grams in characters of lower-cased text, bits of their hash, and features that the classifier keeps.
SIZES, BITS, FEATURES = (4, 5, 6), 20, 8192
L2 = 1e-4
#: Characters of one text whose n-grams are hashed at once.
WINDOW = 1 << 18


@functools.cache
def _lower() -> np.ndarray:
    """The lower-case form of each code point that has one of a single code point; other code points stay."""
    return np.fromiter((ord(x) if len(x := chr(c).lower()) == 1 else c for c in range(0x110000)), np.uint32, 0x110000)


def block_features(data: np.ndarray, off: np.ndarray, slot: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(features, first): the distinct hashed character n-grams of each text of a block (UTF-8; malformed bytes count as U+FFFD), sorted.
    With `slot`, those it maps to 0 or more, mapped. A text of a block of its own is read in windows, so that memory hardly grows with its length."""
    data, off = K.utf8(data, off)
    cp = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    if len(off) == 2 and len(cp) > WINDOW:
        seen = np.zeros(1 << BITS, bool)
        for a in range(0, len(cp), WINDOW):
            part = cp[a : a + WINDOW + max(SIZES) - 1]
            seen[_grams(part, np.array([0, len(part)]), slot)[0]] = True
        f = np.flatnonzero(seen)
        return f, np.array([0, len(f)])
    return _grams(cp, np.searchsorted(np.flatnonzero((data & 0xC0) != 0x80), off), slot)  # from bytes to characters


def _grams(cp: np.ndarray, off: np.ndarray, slot: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """block_features of texts as code points and their offsets."""
    low = _lower()[cp].astype(np.uint64)
    n = len(low)
    row = np.repeat(np.arange(len(off) - 1), np.diff(off))
    left = off[1:][row] - np.arange(n)  # characters from here to the text's end
    found, rows = [], []
    for k in SIZES:
        if n < k:
            continue
        g = low[: n - k + 1].copy()
        for j in range(1, k):
            g = g * np.uint64(0x9E3779B97F4A7C15) + low[j : n - k + 1 + j]
        h = (g ^ np.uint64(k)) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - BITS)
        f = h.astype(np.int32)
        ok = left[: n - k + 1] >= k
        if slot is not None:
            f = slot[f]
            ok &= f >= 0
        found.append(f[ok])
        rows.append(row[: n - k + 1][ok])
    if not found:
        return np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    key = np.concatenate(rows).astype(np.int64) << BITS | np.concatenate(found)
    key.sort()
    key = key[np.concatenate([[True], key[1:] != key[:-1]])] if len(key) else key
    return key & ((1 << BITS) - 1), np.searchsorted(key, np.arange(len(off), dtype=np.int64) << BITS)


@dataclass(frozen=True)
class NgramModel:
    """log odds = bias + the weights of the features that a text has. `hashes` are their hashes."""

    hashes: np.ndarray
    weights: np.ndarray
    bias: float

    def slots(self) -> np.ndarray:
        out = np.full(1 << BITS, -1, np.int32)
        out[self.hashes] = np.arange(len(self.hashes))
        return out

    def scores(self, data: np.ndarray, off: np.ndarray, slot: np.ndarray) -> np.ndarray:
        f, first = block_features(data, off, slot)
        total = self.bias + K.reduce_rows(np.add, self.weights[f], first, 0.0)
        return 1 / (1 + np.exp(-np.clip(total, -60, 60)))


def fit_texts(data: np.ndarray, off: np.ndarray, y: np.ndarray) -> NgramModel:
    """A model whose bias is set so that a score of 0.5 is the cut that serves best on a third of the rows, by the harmonic mean of recall and
    precision of a model of the other two thirds. The rarer class would else be missed for its rarity. With fewer than 20 rows of a class in
    that third the bias stays as it was fitted."""
    model = _fit_texts(data, off, y)
    test = np.arange(len(y)) % 3 == 0
    if min(y[test].sum(), (1 - y[test]).sum()) < 20:
        return model
    trained = _fit_texts(*_rows(data, off, ~test), y[~test])
    got, truth = [], y[test] > 0
    d, o = _rows(data, off, test)
    for i, j in K.blocks(o, 1 << 18):
        got.append(trained.scores(d[o[i] : o[j]], o[i : j + 1] - o[i], trained.slots()))
    p = np.concatenate(got)
    cuts = np.round(np.arange(0.05, 0.96, 0.05), 2)
    gain = [2 * (truth & (p >= c)).sum() / max(truth.sum() + (p >= c).sum(), 1) for c in cuts]
    best = min(range(len(cuts)), key=lambda k: (-gain[k], abs(cuts[k] - 0.5)))
    return NgramModel(model.hashes, model.weights, model.bias - float(np.log(cuts[best] / (1 - cuts[best]))))


def _rows(data: np.ndarray, off: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and offsets of the texts that are kept."""
    size = np.diff(off)
    return data[np.repeat(keep, size)], np.concatenate([[0], np.cumsum(size[keep])])


def _fit_texts(data: np.ndarray, off: np.ndarray, y: np.ndarray) -> NgramModel:
    """Count n-grams by class, keep the FEATURES that differ most, scale each by its log-count ratio r and fit
    logistic weights on r by gradient descent. Without both classes the score is the share of label 1."""
    np.seterr(over="ignore")
    n1, n0 = int(y.sum()), int(len(y) - y.sum())
    if not n1 or not n0:
        p = np.clip(y.mean(), 1e-3, 1 - 1e-3) if len(y) else 0.5
        return NgramModel(np.zeros(0, np.int64), np.zeros(0), float(np.log(p / (1 - p))))
    count = np.zeros((2, 1 << BITS))
    for i, j in K.blocks(off):
        f, first = block_features(data[off[i] : off[j]], off[i : j + 1] - off[i], None)
        cls = np.repeat(y[i:j], np.diff(first)).astype(int)
        for c in (0, 1):
            count[c] += np.bincount(f[cls == c], minlength=1 << BITS)
    p, q = (count[1] + 1) / (n1 + 2), (count[0] + 1) / (n0 + 2)
    ratio = np.log(p / q)
    spread = p * (1 - p) / n1 + q * (1 - q) / n0
    strength = np.where(count.sum(axis=0) >= 3, (p - q) ** 2 / spread, 0)
    top = np.argsort(-strength, kind="stable")[:FEATURES]
    top = np.sort(top[strength[top] > 4])
    r = ratio[top]
    slot = np.full(1 << BITS, -1, np.int32)
    slot[top] = np.arange(len(top))
    parts = []
    for i, j in K.blocks(off):
        a, b = block_features(data[off[i] : off[j]], off[i : j + 1] - off[i], slot)
        parts.append((a.astype(np.int32), b))
    f = np.concatenate([a for a, _ in parts])
    row = np.repeat(np.arange(len(y), dtype=np.int32), np.concatenate([np.diff(b) for _, b in parts]))
    del parts, count, spread, strength, ratio, p, q
    w, b = np.ones(len(top)) * 0.1, float(np.log(n1 / n0))
    m, s, mb, sb = np.zeros(len(top)), np.zeros(len(top)), 0.0, 0.0
    for t in range(1, 301):
        e = (1 / (1 + np.exp(-np.clip(b + np.bincount(row, (r * w)[f], len(y)), -60, 60))) - y) / len(y)
        gw, gb = r * np.bincount(f, e[row], len(top)) + L2 * w, float(e.sum())
        m, s = 0.9 * m + 0.1 * gw, 0.99 * s + 0.01 * gw * gw
        mb, sb = 0.9 * mb + 0.1 * gb, 0.99 * sb + 0.01 * gb * gb
        up, dn = 1 - 0.9**t, 1 - 0.99**t
        w = w - 0.03 * (m / up) / (np.sqrt(s / dn) + 1e-10)
        b -= 0.03 * (mb / up) / (np.sqrt(sb / dn) + 1e-10)
    return NgramModel(top.astype(np.int64), w * r, float(b))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = FIT_ROWS) -> NgramModel:
    """Fit on at most `rows` labelled documents and FIT_BYTES of their text; see labelled_sample for nulls and repeated rows. Without rows of both
    classes, or from empty tables, the score is the share of label 1, 0.5 without labels."""
    sample = labelled_sample(docs, labels, label, rows).toArrow().combine_chunks().sort_by("doc_id")
    return fit_texts(*K.text_buffers(sample["text"]), sample["y"].to_numpy().astype(float))


def score(docs: DataFrame, model: NgramModel, keep: list[tuple[str, str]]) -> DataFrame:
    """The columns `keep` (name, type) of docs and `score`, the chance of label 1; a column of docs of that name comes first. Only the text
    matters; a null counts as empty, an empty text gets the bias alone, repeated rows repeat, an empty table gives none."""
    inner = kept(keep)
    names = [k for k, _ in inner]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        slot = model.slots()
        for batch in batches:
            data, off = K.text_buffers(batch.column("_text"))
            for i, j in K.blocks(off, 1 << 18):
                got = model.scores(data[off[i] : off[j]], off[i : j + 1] - off[i], slot)
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(i, j - i) for k in names), pa.array(got)], [*names, "_score"])

    rows = docs.select(*(F.col(f"`{k}`").alias(n) for (k, _), n in zip(keep, names, strict=True)), F.col("text").alias("_text"))
    out = rows.transform(in_batches).mapInArrow(trimmed(run), ", ".join([*(f"`{n}` {t}" for n, t in inner), "_score double"]))
    return out.toDF(*(k for k, _ in keep), "score")
