"""Quality scores by a sparse ensemble of rules over text statistics."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sugarbeam.llm import kernels as K
from sugarbeam.llm.util import in_batches, kept, labelled_sample, trimmed

#: Most labelled rows that a fit uses, and the size of its ensemble.
FIT_ROWS = 20_000
TREES, DEPTH, CUTS = 40, 3, 32
L1 = 2e-3

STATS = ["log_bytes", "words", "word_bytes", "upper", "digits", "blanks", "stops", "commas", "bangs", "symbols", "wide", "distinct_words", "distinct_lines", "line_words"]


def _table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, np.int32)
    out[list(chars)] = 1
    return out


_KINDS = {
    "upper": _table(bytes(range(65, 91))), "digits": _table(b"0123456789"), "blanks": _table(b" \t\n\v\f\r"), "stops": _table(b".?"),
    "commas": _table(b",;:"), "bangs": _table(b"!"), "symbols": _table(b"#$%&()*+/<=>@[\\]^_`{|}~"), "wide": _table(bytes(range(128, 256))),
}


def _distinct_share(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Distinct values over values, in each range; 1 for an empty one."""
    h = h.copy()
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        h[a:b].sort()
    new = np.ones(len(h), np.int64)
    new[1:] = h[1:] != h[:-1]
    n = np.diff(first)
    new[first[:-1][n > 0]] = 1
    return np.where(n > 0, K.reduce_rows(np.add, new, first, 0) / np.maximum(n, 1), 1.0)


def block_statistics(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Row i has STATS of text i of a block. All are shares or means, so that they hold for any length; an empty text has zeros."""
    n = np.diff(off)
    size = np.maximum(n, 1)
    out = np.zeros((len(n), len(STATS)))
    start, end, first = K.words(data, off)
    words = np.diff(first)
    lines = np.zeros(len(data), bool)
    lines[data == 10] = True
    heads = np.unique(np.concatenate([off[:-1][n > 0], np.flatnonzero(lines[:-1]) + 1])) if len(data) else np.zeros(0, np.int64)
    line_first = np.searchsorted(heads, off)
    ends = np.append(heads[1:], len(data))
    h = K.span_hashes(K._BYTE_CASED[data], np.concatenate([start, heads]), np.concatenate([end, ends]))
    cols = {
        "log_bytes": np.log1p(n), "words": np.log1p(words), "word_bytes": K.reduce_rows(np.add, end - start, first, 0) / np.maximum(words, 1),
        "distinct_words": _distinct_share(h[: len(start)], first), "distinct_lines": _distinct_share(h[len(start) :], line_first), "line_words": np.log1p(words / np.maximum(np.diff(line_first), 1)),
    }
    for name, table in _KINDS.items():
        cols[name] = K.reduce_rows(np.add, table[data], off, 0) / size
    for i, name in enumerate(STATS):
        out[:, i] = cols[name]
    out[n == 0] = 0
    return out


def statistics(docs: DataFrame, keep: list[tuple[str, str]]) -> DataFrame:
    """The columns `keep` (name, type) of docs under the names _c0, _c1 and so on, and a double column _q_<name> for each of STATS. Statistics are
    of bytes; a null text counts as empty, repeated rows repeat, an empty table gives none."""
    inner = kept(keep)
    names = [k for k, _ in inner]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        for batch in batches:
            data, off = K.text_buffers(batch.column("_text"))
            for i, j in K.blocks(off):
                got = block_statistics(data[off[i] : off[j]], off[i : j + 1] - off[i])
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(i, j - i) for k in names), *(pa.array(got[:, c]) for c in range(len(STATS)))], [*names, *(f"_q_{s}" for s in STATS)])

    rows = docs.select(*(F.col(f"`{k}`").alias(n) for (k, _), n in zip(keep, names, strict=True)), F.col("text").alias("_text"))
    return rows.transform(in_batches).mapInArrow(trimmed(run), ", ".join([*(f"`{n}` {t}" for n, t in inner), *(f"`_q_{s}` double" for s in STATS)]))


Rule = tuple[tuple[int, bool, float], ...]  # (statistic, above, cut), all of which hold


@dataclass(frozen=True)
class RuleModel:
    """log odds = bias + the weights of the rules that hold."""

    bias: float
    rules: tuple[tuple[Rule, float], ...]

    def column(self) -> Column:
        """The score as an expression over the columns STATS."""
        total = F.lit(self.bias)
        for rule, w in self.rules:
            holds = F.lit(True)
            for s, above, cut in rule:
                c = F.col("_q_" + STATS[s])
                holds = holds & ((c > cut) if above else (c <= cut))
            total = total + F.when(holds, F.lit(w)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))

    def scores(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.bias)
        for rule, w in self.rules:
            total += w * _holds(x, rule)
        return 1 / (1 + np.exp(-total))


def _holds(x: np.ndarray, rule: Rule) -> np.ndarray:
    out = np.ones(len(x), bool)
    for s, above, cut in rule:
        out &= (x[:, s] > cut) if above else (x[:, s] <= cut)
    return out


def tree_rules(x: np.ndarray, y: np.ndarray) -> list[Rule]:
    """Paths of boosted regression trees on the logistic loss, each once, in order of discovery."""
    cuts = [np.unique(np.quantile(x[:, s], np.linspace(0, 1, CUTS + 1)[1:-1])) for s in range(x.shape[1])]
    score = np.zeros(len(y))
    rules: dict[Rule, None] = {}
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        grad, weight = y - p, p * (1 - p) + 1e-9
        work: list[tuple[Rule, np.ndarray]] = [((), np.arange(len(y)))]
        while work:
            rule, at = work.pop()
            g, w = grad[at], weight[at]
            base, best = g.sum() ** 2 / (w.sum() + 1), None
            if len(rule) < DEPTH and len(at) >= 10:
                for s, c in enumerate(cuts):
                    if not len(c):
                        continue
                    slot = np.searchsorted(c, x[at, s], "left")  # slot k: at most cut k
                    lg = np.cumsum(np.bincount(slot, g, len(c) + 1))[:-1]
                    lw = np.cumsum(np.bincount(slot, w, len(c) + 1))[:-1]
                    ln = np.cumsum(np.bincount(slot, minlength=len(c) + 1))[:-1]
                    gain = lg**2 / (lw + 1) + (g.sum() - lg) ** 2 / (w.sum() - lw + 1) - base
                    gain[(ln < 5) | (len(at) - ln < 5)] = -np.inf
                    k = int(np.argmax(gain))
                    if gain[k] > (best[0] if best else 1e-6):
                        best = (gain[k], s, float(c[k]))
            if best is None:
                score[at] += 0.3 * g.sum() / (w.sum() + 1)
                continue
            _, s, cut = best
            for above in (False, True):
                path = (*rule, (s, above, cut))
                rules[tuple(sorted(set(path)))] = None
                work.append((path, at[(x[at, s] > cut) == above]))
    return list(rules)


def lasso_logistic(r: np.ndarray, y: np.ndarray, l1: float, rounds: int = 400) -> tuple[float, np.ndarray]:
    """(bias, weights) of least mean logistic loss plus l1 times the weights' sizes, by accelerated proximal gradient."""
    n, m = r.shape
    v = np.ones(m)
    for _ in range(20):
        v = r.T @ (r @ v)
        v /= np.linalg.norm(v) + 1e-12
    step = 1 / (0.25 * (np.linalg.norm(r @ v) ** 2 / n + 1) * 1.1)
    prior = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    w, b = np.zeros(m), float(np.log(prior / (1 - prior)))
    zw, zb, t = w, b, 1.0
    for _ in range(rounds):
        e = 1 / (1 + np.exp(-(zb + r @ zw))) - y
        nw, nb = zw - step * (r.T @ e) / n, zb - step * e.mean()
        nw = np.sign(nw) * np.maximum(np.abs(nw) - step * l1, 0)
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        zw, zb = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw, nb, nt
    return b, w


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = FIT_ROWS) -> RuleModel:
    """Fit on at most `rows` labelled documents. Without both classes the score is the share of label 1 (0.5 without labels)."""
    found = labelled_sample(docs, labels, label, rows)
    sample = statistics(found, found.select("doc_id", "y").dtypes).toPandas().sort_values("_c0")  # ids of any type
    x, y = sample[[f"_q_{s}" for s in STATS]].to_numpy(float), sample["_c1"].to_numpy(float)
    if len(set(y.tolist())) < 2:
        p = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
        return RuleModel(float(np.log(p / (1 - p))), ())
    rules = tree_rules(x, y)
    r = np.stack([_holds(x, q) for q in rules], axis=1).astype(float) if rules else np.zeros((len(y), 0))
    bias, w = lasso_logistic(r, y, L1)
    return RuleModel(bias, tuple((q, float(v)) for q, v in zip(rules, w, strict=True) if abs(v) > 1e-6))


def score(docs: DataFrame, model: RuleModel, keep: list[tuple[str, str]]) -> DataFrame:
    """The columns `keep` of docs and `score`, the chance of label 1; a column of docs of that name comes first. Only the text matters; a null
    counts as empty, an empty text has a score like any other, repeated rows repeat."""
    return statistics(docs, keep).select(*(k for k, _ in kept(keep)), model.column().alias("_score")).toDF(*(k for k, _ in keep), "score")
