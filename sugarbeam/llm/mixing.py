"""Mixing to target weights by soft membership: domain posteriors and nonnegative document rates."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Collection, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sugarbeam.llm import kernels as K
from sugarbeam.llm.util import guarded, in_batches, one_text_each, stored, trimmed

#: Most labelled rows that the classifier is fitted on.
FIT_ROWS = 4_000
TARGETS = {"de": 0.2, "en": 0.4, "es": 0.2, "fr": 0.2}


@dataclass(frozen=True)
class DomainModel:
    """Naive Bayes over byte pairs of lower-cased text. The evidence of a text is divided by the square root of
    its number of pairs, so that a long text's membership stays soft."""

    domains: tuple[str, ...]
    prior: np.ndarray
    weights: np.ndarray  # domain x byte pair

    def posteriors(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """One row for each text; an empty one gets the priors."""
        pair, first = byte_pairs(data, off)
        n = np.maximum(np.diff(first), 1)
        z = np.stack([np.log(p) + K.reduce_rows(np.add, w[pair], first, 0) / np.sqrt(n) for p, w in zip(self.prior, self.weights, strict=True)], axis=1)
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def byte_pairs(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low = K.LOWER[data].astype(np.int32)
    pair = low[:-1] << 8 | low[1:] if len(low) > 1 else np.zeros(0, np.int32)
    inside = np.ones(len(pair), bool)
    ends = off[1:-1]
    inside[ends[(ends > 0) & (ends < len(data))] - 1] = False
    count = np.concatenate([[0], np.cumsum(inside)])
    return pair[inside], count[np.minimum(off, len(pair))]


def fit(docs: DataFrame, labelled: DataFrame, domains: list[str], rows: int = FIT_ROWS) -> DomainModel:
    """Fit on at most `rows` documents (and FIT_BYTES of text) of the table `labelled` (doc_id, domain), those with the smallest id hash.
    Rows of null or other domains do not count; a domain without rows keeps a flat distribution."""
    names = sorted(domains)
    ids = labelled.where(F.col("domain").isin(*names) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("domain").alias("domain"))
    ids = ids.withColumn("h", F.xxhash64("doc_id", F.lit(9))).orderBy("h", "doc_id").limit(rows)
    got = one_text_each(docs, ids, ["domain"]).toArrow().combine_chunks().sort_by("doc_id")
    data, off = K.text_buffers(got["text"])
    y = np.array([names.index(d) for d in got["domain"].to_pylist()], int)
    count, seen = np.ones((len(names), 1 << 16)), np.ones(len(names))
    for i, j in K.blocks(off):
        pair, first = byte_pairs(data[off[i] : off[j]], off[i : j + 1] - off[i])
        of = np.repeat(y[i:j], np.diff(first))
        for d in range(len(names)):
            count[d] += np.bincount(pair[of == d], minlength=1 << 16)
    for d in range(len(names)):
        seen[d] += (y == d).sum()
    w = np.log(count / count.sum(axis=1, keepdims=True))
    return DomainModel(tuple(names), seen / seen.sum(), w - w.mean(axis=0))


def _measured(batch: pa.RecordBatch, model: DomainModel) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(i, j, words, posteriors) of the rows i to j of a batch, block by block."""
    np.seterr(over="ignore")
    data, off = K.text_buffers(batch.column("text"))
    for i, j in K.blocks(off):
        block, o = data[off[i] : off[j]], off[i : j + 1] - off[i]
        inside = ~K.SPACE[block]
        head = inside.copy()
        head[1:] &= ~inside[:-1]
        head[o[:-1][np.diff(o) > 0]] = inside[o[:-1][np.diff(o) > 0]]
        yield i, j, K.reduce_rows(np.add, head.astype(np.int64), o, 0), model.posteriors(block, o)


def memberships(docs: DataFrame, model: DomainModel, keep: list[tuple[str, str]]) -> DataFrame:
    """The columns `keep` (name, type) of docs, `_tokens` (words) and `_p`, the posterior of each domain."""
    names, d = [k for k, _ in keep], len(model.domains)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, tokens, p in _measured(batch, model):
                lists = pa.ListArray.from_arrays(pa.array(np.arange(j - i + 1) * d, pa.int32()), pa.array(p.ravel()))
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(i, j - i) for k in names), pa.array(tokens), lists], [*names, "_tokens", "_p"])

    return docs.select(*dict.fromkeys([*names, "text"])).transform(in_batches).mapInArrow(trimmed(run), ", ".join([*(f"`{n}` {t}" for n, t in keep), "_tokens bigint, _p array<double>"]))


def _lists(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


#: Parts of a token that sums count in. Sums are of whole numbers, so they are the same in any order and for any partitioning.
PARTS = 1 << 20
_LOW = 31


@dataclass(frozen=True)
class Descent:
    """The steps of a projected gradient descent: one number for each domain and step, and the steps before which momentum was dropped. A row's
    rate follows from these and its posterior, so rates are never stored or shuffled: any task finds them."""

    steps: tuple[np.ndarray, ...] = ()
    fresh: frozenset[int] = frozenset()


def replay(p: np.ndarray, steps: Sequence[np.ndarray], least: float = 0.0, most: float = np.inf, fresh: Collection[int] = ()) -> tuple[np.ndarray, np.ndarray]:
    """(rates, point of the next gradient) of rows with the posteriors p after `steps`: accelerated gradients, each followed by the projection onto
    rates between `least` and `most`."""
    x = at = np.clip(np.ones(len(p)), least, most)
    t = 1.0
    for n, g in enumerate(steps):
        if n in fresh:
            at, t = x, 1.0
        # Domain by domain: a product of matrices may round a row by its place in the batch.
        new = np.clip(at - sum(p[:, k] * g[k] for k in range(len(g))), least, most)
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        at = np.clip(new + (t - 1) / nt * (new - x), least, most)
        x, t = new, nt
    return x, at


def rates(p: np.ndarray, fitted: Descent, least: float = 0.0, most: float = np.inf) -> np.ndarray:
    return replay(p, fitted.steps, least, most, fitted.fresh)[0]


def _parts(p: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Sums over rows of weight * p, in parts of a token."""
    return np.rint(p * (weight * PARTS)[:, None]).astype(np.int64).sum(axis=0)


def sums(p: np.ndarray, tokens: np.ndarray, fitted: Descent, least: float, most: float = np.inf) -> np.ndarray:
    """Expected tokens of the domains, in parts, at the rates and at the point of the next gradient."""
    x, at = replay(p, fitted.steps, least, most, fitted.fresh)
    return np.stack([_parts(p, tokens * x), _parts(p, tokens * at)])


def gram(p: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """Sums of tokens * p_a * p_b for the domains a and b, in parts."""
    return np.stack([_parts(p, tokens * p[:, k]) for k in range(p.shape[1])])


def solve(total: Callable[[Descent], np.ndarray], shared: np.ndarray, want: np.ndarray, tolerance: float, rounds: int) -> tuple[Descent, str]:
    """(descent, complaint): projected gradient for the least squares of total - want over the rates that `replay` allows.

    Squares are measured by the inverse of `shared` (see gram), and a row's rate moves by its gradient over its tokens. In these measures the
    slope changes by at most the step, so that steps of length 1 descend, and a rare domain moves as fast as a large one. Momentum is dropped where
    the squares grew. It ends when each domain is within `tolerance` of its target, or after three rounds that hardly lessened the squares (the
    bound on rates or soft memberships forbid more).
    """
    metric = np.linalg.inv(shared + 1e-9 * np.trace(shared) * np.eye(len(want)))
    close = np.maximum(want, shared.sum() * 1e-6)
    steps, fresh, last, idle = [], set(), np.inf, 0
    for n in range(rounds):
        done = Descent(tuple(steps), frozenset(fresh))
        now, ahead = total(done)
        off = now - want
        if (np.abs(off) <= tolerance * close).all():
            return done, ""
        squares = off @ metric @ off
        if squares > last:
            fresh.add(n)
            ahead = now
        idle = idle + 1 if squares > last * (1 - 1e-4) else 0
        if idle == 3:
            return done, "the bound on rates or soft memberships keep the domains from their targets"
        steps.append(metric @ (ahead - want))
        last = squares
    return done, f"no end after {rounds} rounds"


def fit_rates(member: DataFrame, targets: dict[str, float], tolerance: float = 1e-3, rounds: int = 60, least: float = 0.0, most: float = np.inf, strict: bool = False) -> Descent:
    """What `rates` needs, for: least squares of (expected domain tokens - target tokens) over most >= rates >= least >= 0, from rates of 1.
    `member` has (_tokens, _p). The target total is the least at which no domain has to lose tokens.

    Each round sums rate x tokens x posterior over all rows: partial sums in tasks, a few whole numbers on the driver. A warning tells the shares
    if a target is not reached, and `strict` makes that an error.
    """
    names = sorted(targets)
    d = len(names)

    def over_all(measure: Callable[[np.ndarray, np.ndarray], np.ndarray], shape: tuple[int, int]) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            s = [0] * (shape[0] * shape[1])
            for batch in batches:
                got = measure(_lists(batch.column("_p"), d), batch.column("_tokens").to_numpy().astype(float))
                s = [a + int(b) for a, b in zip(s, got.ravel(), strict=True)]
            low = (1 << _LOW) - 1
            yield pa.RecordBatch.from_arrays([pa.array(range(len(s))), pa.array([v >> _LOW for v in s], pa.int64()), pa.array([v & low for v in s], pa.int64())], ["k", "high", "low"])

        got = member.select("_tokens", "_p").transform(in_batches).mapInArrow(trimmed(run), "k bigint, high bigint, low bigint")
        out = np.zeros(shape[0] * shape[1])
        for r in got.groupBy("k").agg(F.sum("high").alias("high"), F.sum("low").alias("low")).collect():
            out[r["k"]] = ((r["high"] << _LOW) + r["low"]) / PARTS
        return out.reshape(shape)

    shared = over_all(gram, (d, d))
    have = shared.sum(axis=0)
    weight = np.array([targets[k] for k in names]) / sum(targets.values())
    if not have.sum():
        return Descent()
    want = weight * (have / np.where(weight > 0, weight, np.inf)).max()

    def total(fitted: Descent) -> np.ndarray:
        return over_all(lambda p, tokens: sums(p, tokens, fitted, least, most), (2, d))

    fitted, complaint = solve(total, shared, want, tolerance, rounds)
    if complaint:
        end = total(fitted)[0]
        shares = ", ".join(f"{k} {e / end.sum():.4f} of {w:.4f}" for k, e, w in zip(names, end, weight, strict=True))
        if strict:
            raise ValueError(f"mixing targets not reached, {complaint}: {shares}")
        warnings.warn(f"mixing targets not reached, {complaint}: {shares}", stacklevel=2)
    return fitted


def rated(member: DataFrame, fitted: Descent, d: int, keep: list[tuple[str, str]], least: float = 0.0, most: float = np.inf) -> DataFrame:
    """The columns `keep` and `_rate`, taken from member's `_p`."""
    names = [k for k, _ in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rate = rates(_lists(batch.column("_p"), d), fitted, least, most)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in names), pa.array(rate)], [*names, "_rate"])

    return member.transform(in_batches).mapInArrow(trimmed(run), ", ".join([*(f"`{n}` {t}" for n, t in keep), "_rate double"]))


def rated_texts(docs: DataFrame, model: DomainModel, fitted: Descent, keep: list[tuple[str, str]], least: float = 0.0, most: float = np.inf) -> DataFrame:
    """The columns `keep` and `_rate`, as `rated` gives them for `memberships`, from the texts in one pass: a task then has one Python worker
    instead of two, and each text goes to it and back once."""
    names = [k for k, _ in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, _, p in _measured(batch, model):
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(i, j - i) for k in names), pa.array(rates(p, fitted, least, most))], [*names, "_rate"])

    return docs.select(*dict.fromkeys([*names, "text"])).transform(in_batches).mapInArrow(trimmed(run), ", ".join([*(f"`{n}` {t}" for n, t in keep), "_rate double"]))


def copies() -> Column:
    """Whole copies of a document for its `_rate`: the floor, and one more with the chance of the rest, decided by doc_id."""
    u = F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1 << 20)) / float(1 << 20)
    return (F.floor("_rate") + (u < F.col("_rate") - F.floor("_rate")).cast("int")).cast("int")


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float] = TARGETS) -> DataFrame:
    """(doc_id, tokens, p_<domain>..., rate, copies) of each row of docs (doc_id, text, ...).

    The classifier is fitted on `labelled` (doc_id, domain). Null, empty and blank texts have 0 tokens and the
    domains' priors; they get a rate as others do. Equal texts get equal rates; repeated rows repeat; an empty
    table gives no rows.
    """
    model = fit(docs, labelled, list(targets))
    keep = [("doc_id", "bigint")]
    member = stored(memberships(docs, model, keep))
    fitted = fit_rates(member, targets)
    out = rated(member, fitted, len(model.domains), [*keep, ("_tokens", "bigint"), ("_p", "array<double>")])
    p = [F.col("_p")[i].alias(f"p_{d}") for i, d in enumerate(model.domains)]
    return out.select("doc_id", F.col("_tokens").alias("tokens"), *p, F.col("_rate").alias("rate"), copies().alias("copies"))


def mixed(docs: DataFrame, labelled: DataFrame, targets: dict[str, float] = TARGETS, least: float = 0.0, most: float = np.inf, strict: bool = False) -> DataFrame:
    """docs with each row repeated as often as its copies say (0: it goes). Rates of 1 at `least` keep every row; `most` bounds how often a row
    can be repeated, where a rare domain would have to stand for many rows. Nulls, empty texts and repeated rows are as in `mix`."""
    docs, named = guarded(docs)
    model = fit(docs, labelled, list(targets))
    fitted = fit_rates(stored(memberships(docs, model, [])), targets, least=least, most=most, strict=strict)
    keep = [(c, t) for c, t in docs.dtypes]
    out = rated_texts(docs, model, fitted, keep, least, most)
    times = out.withColumn("_copies", copies()).where("_copies > 0")
    return named(times.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))))
