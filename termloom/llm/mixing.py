"""Mixing to target weights with soft domain membership: a classifier gives domain posteriors, and projected-gradient least
squares gives each document a nonnegative rate so that the expected token totals of the domains match their targets."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.llm import _vec
from termloom.llm._io import DOC_COLUMNS, cut, drop

DOMAINS = ("good", "low", "toxic")  # by labels: toxic = 1; else quality = 0 is low, quality = 1 good
WEIGHTS = {"good": 0.885, "low": 0.1, "toxic": 0.015}
SAMPLE = 8_000  # labelled documents that the classifier is fitted on at most (those of the smallest hashes of doc_id)
MIN_DF = 6  # labelled documents that a word must occur in to be a feature
VOCABULARY = 3_000  # words kept, by how much their presence depends on the domain
FIT_STEPS = 150
RIDGE = 1e-3
STEPS = 40  # projected-gradient steps at most
PROGRESS = 1e-2  # least relative fall of the objective for another step


def domain(quality: Column, toxic: Column) -> Column:
    return F.when(toxic == 1, F.lit(2)).when(quality == 0, F.lit(1)).when(quality == 1, F.lit(0))


def _style(texts: pa.Array, at: np.ndarray) -> np.ndarray:
    """Form of each text: log words, and shares of repeated marks, of upper case, and of digits among its bytes."""
    b, off = _vec.raw(texts, lower=False)
    size = np.maximum(np.diff(off), 1)
    first = off[:-1]
    marks = np.isin(np.arange(256), np.frombuffer(b"!#$%&*|", np.uint8))[b]
    upper = (b >= 65) & (b <= 90)
    digit = (b >= 48) & (b <= 57)
    shares = [np.add.reduceat(m.astype(np.int64), first) / size for m in (marks, upper, digit)] if len(b) else [np.zeros(len(size))] * 3
    n = np.diff(at)
    return np.stack([np.log1p(n) / 8, (n < 10).astype(float), *[np.minimum(5 * s, 1) for s in shares]], 1)


def _distinct(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Share of distinct words of each text."""
    n = np.diff(at)
    key = (np.repeat(np.arange(len(n), dtype=np.uint64), n) << np.uint64(40)) | (h >> np.uint64(24))
    key.sort()
    new = np.diff(key, prepend=np.uint64(0xFFFFFFFFFFFFFFFF)) != 0
    return np.bincount((key[new] >> np.uint64(40)).astype(np.int64), minlength=len(n)) / np.maximum(n, 1)


def _features(texts: pa.Array, t: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    h, at = _vec.words(texts, t)
    return h, at, np.concatenate([_style(texts, at), _distinct(h, at)[:, None], np.ones((len(texts), 1))], 1)


def _design(h: np.ndarray, at: np.ndarray, vocabulary: np.ndarray, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) of each distinct vocabulary word of each text. slot maps 16 bits of a hash to its only candidate."""
    k = slot[(h >> np.uint64(48)).astype(np.int64)]
    hit = np.flatnonzero((k >= 0) & (vocabulary[k] == h))
    text = np.searchsorted(at, hit, side="right") - 1
    key = np.unique(text.astype(np.int64) * len(vocabulary) + k[hit])
    return key // len(vocabulary), key % len(vocabulary)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict:
    """Multinomial logistic regression on word presence and form, from at most `sample` labelled documents. What reaches the
    driver is bounded by the sample: each document's distinct word hashes. Without labelled documents every posterior is
    the uniform one; with one class only, that class has nearly all."""
    known = labels.select("doc_id", domain(F.col("quality"), F.col("toxic")).alias("y")).dropna().dropDuplicates(["doc_id"])
    picked = cut(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    texts = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")  # of several texts of a doc_id the smallest is used, so there are at most `sample` rows
    texts = texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y")).select("y", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _vec.tables()
        for batch in batches:
            for lo, hi in _vec.pieces(batch.column("text")):
                h, at, dense = _features(batch.column("text").slice(lo, hi - lo), t)
                own = [np.unique(h[at[i] : at[i + 1]]).view(np.int64) for i in range(hi - lo)]
                yield pa.RecordBatch.from_pydict({"y": batch.column("y").slice(lo, hi - lo), "words": pa.array(own, pa.list_(pa.int64())), "dense": pa.array(list(dense), pa.list_(pa.float64()))})

    rows = texts.mapInArrow(_vec.lean(run), "y int, words array<long>, dense array<double>").toArrow()
    c = len(DOMAINS)
    if not rows.num_rows:
        return {"vocabulary": np.zeros(1, np.uint64), "slot": np.full(1 << 16, -1), "w": np.zeros((1, c)), "dense": np.zeros((7, c))}
    y = rows["y"].to_numpy()
    words = rows["words"].combine_chunks()
    text = np.repeat(np.arange(len(y)), np.diff(words.offsets.to_numpy()))
    names, word, df = np.unique(words.flatten().to_numpy().view(np.uint64), return_inverse=True, return_counts=True)
    prior = np.bincount(y, minlength=c) / len(y)
    seen = np.stack([np.bincount(word, weights=(y[text] == k), minlength=len(names)) for k in range(c)], 1)
    expected = df[:, None] * prior
    score = np.where(df >= MIN_DF, ((seen - expected) ** 2 / np.maximum(expected, 1e-9)).sum(1), -1)
    order = np.argsort(-score, kind="stable")[:VOCABULARY]
    order = order[score[order] > 0]
    _, one = np.unique(names[order] >> np.uint64(48), return_index=True)  # the best word of each slot
    order = order[np.sort(one)]
    vocabulary = names[order] if len(order) else np.zeros(1, np.uint64)
    slot = np.full(1 << 16, -1)
    slot[(vocabulary[: len(order)] >> np.uint64(48)).astype(np.int64)] = np.arange(len(order))
    new = np.full(len(names), -1)
    new[order] = np.arange(len(order))
    has = new[word] >= 0
    text, feature = text[has], new[word][has]
    dense = np.stack(rows["dense"].to_pylist())
    target = np.eye(c)[y]
    w, v = np.zeros((len(vocabulary), c)), np.zeros((dense.shape[1], c))
    mw, mv = np.zeros_like(w), np.zeros_like(v)
    sw, sv = np.zeros_like(w), np.zeros_like(v)
    for step in range(1, FIT_STEPS + 1):  # Adam on the whole sample
        z = dense @ v + np.stack([np.bincount(text, weights=w[feature, k], minlength=len(y)) for k in range(c)], 1)
        d = (_softmax(z) - target) / len(y)
        gw = np.stack([np.bincount(feature, weights=d[text, k], minlength=len(w)) for k in range(c)], 1) + RIDGE * w
        gv = dense.T @ d
        for p, g, m, s in ((w, gw, mw, sw), (v, gv, mv, sv)):
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            p -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
    return {"vocabulary": vocabulary, "slot": slot, "w": w, "dense": v}


def _posterior(texts: pa.Array, m: dict, t: dict) -> tuple[np.ndarray, np.ndarray]:
    """Words of each text, and its posteriors (texts x domains)."""
    h, at, dense = _features(texts, t)
    text, feature = _design(h, at, m["vocabulary"], m["slot"])
    z = dense @ m["dense"] + np.stack([np.bincount(text, weights=m["w"][feature, k], minlength=len(texts)) for k in range(len(DOMAINS))], 1)
    return np.diff(at).astype(np.int64), _softmax(z)


def posteriors(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, tokens, p0, p1, ...) for each row of docs; tokens are words. Null and empty texts have 0 tokens."""
    known = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, m = _vec.tables(), known.value
        for batch in batches:
            for lo, hi in _vec.pieces(batch.column("text")):
                n, p = _posterior(batch.column("text").slice(lo, hi - lo), m, t)
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").slice(lo, hi - lo), "tokens": n, **{f"p{k}": p[:, k] for k in range(len(DOMAINS))}})

    return docs.select("doc_id", "text").mapInArrow(_vec.lean(run), "doc_id long, tokens long, " + ", ".join(f"p{k} double" for k in range(len(DOMAINS))))


def _rate(weights: list[np.ndarray]) -> Column:
    """A document's rate after the steps taken so far: w <- max(0, w - x . step), started at 1, with x its posteriors."""
    if not weights:
        return F.lit(1.0)
    table = ", ".join(f"array({', '.join(f'{float(s)!r}D' for s in step)})" for step in weights)
    down = " + ".join(f"p{k} * s[{k}]" for k in range(len(DOMAINS)))
    return F.expr(f"aggregate(array({table}), 1.0D, (w, s) -> greatest(0.0D, w - ({down})))")


def solve(post: DataFrame, weights: dict[str, float] = WEIGHTS, total: float | None = None) -> tuple[list[np.ndarray], np.ndarray]:
    """Steps of the projected gradient and the target totals; post must be a table (cut()), it is read once a step.

    Minimises sum_k (sum_d w_d n_d p_dk - T_k)^2 / M_k over rates w >= 0 from w = 1, M_k being the domain's tokens at w = 1. In
    the metric where a document weighs its tokens, a step takes eta sum_k p_dk r_k / M_k off w_d, r being the residual: it
    doesn't depend on a document's length, and documents of equal posteriors get equal rates. So a step is C numbers, a
    rate is a function of a document's posteriors and the steps, and each step is one aggregation without any state
    that could be lost. eta is 1.9 over the largest eigenvalue of the scaled second moments of p, near 1 for any
    posteriors, so the objective falls at every step; steps end once one lowers it by less than PROGRESS.
    T is `total` times the weights; by default the total at which the domain of the largest weight keeps its own tokens.
    """
    c = len(DOMAINS)
    tri = [(i, j) for i in range(c) for j in range(i, c)]

    def sums(columns: list[Column], rate: Column | None = None) -> np.ndarray:
        row = post.withColumn("amount", F.col("tokens") * (F.lit(1.0) if rate is None else rate)).agg(*[F.sum(F.col("amount") * x) for x in columns]).first()
        return np.array([float(x or 0) for x in row])

    p = [F.col(f"p{k}") for k in range(c)]
    first = sums([*p, *[p[i] * p[j] for i, j in tri]])
    share = np.array([weights[d] for d in DOMAINS], float)
    share = share / share.sum()
    main = int(share.argmax())
    goal = share * (total if total is not None else first[main] / share[main])
    if first[:c].sum() <= 0:
        return [], goal
    mass = np.maximum(first[:c], 1e-9 * first[:c].sum())
    m = np.zeros((c, c))
    for (i, j), v in zip(tri, first[c:]):
        m[i, j] = m[j, i] = v
    eta = 1.9 / np.linalg.eigvalsh(m / np.sqrt(mass[:, None] * mass[None, :])).max()
    steps: list[np.ndarray] = []
    r = first[:c] - goal
    for _ in range(STEPS):
        steps.append(eta * r / mass)
        new = sums(p, _rate(steps)) - goal
        before, after = (r * r / mass).sum(), (new * new / mass).sum()
        r = new
        if after >= (1 - PROGRESS) * before or after <= PROGRESS**2 * goal.sum():
            break
    return steps, goal


def rates(docs: DataFrame, labels: DataFrame, weights: dict[str, float] = WEIGHTS, total: float | None = None, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, tokens, p_<domain>..., rate) for each row of docs: how often a document is to occur in the mixture, on average.

    Null and empty texts have no tokens: they weigh nothing in the fit, and their rate follows from the posteriors of an
    empty text. Rows that repeat a doc_id each have a row. Labels with a null count as none, of repeated labels one
    (of equal doc_id) is used, other columns aren't read. Empty docs give no rows; without labels all posteriors are
    equal. Texts are read twice (sample, posteriors) and never shuffled; each step of the fit is one aggregation over the
    posteriors to C + C (C + 1) / 2 numbers.
    """
    post = cut(posteriors(docs, fit(docs, labels, sample)))
    steps, _ = solve(post, weights, total)
    return post.select("doc_id", "tokens", *[F.col(f"p{k}").alias(f"p_{d}") for k, d in enumerate(DOMAINS)], _rate(steps).alias("rate"))


def copies(rate: np.ndarray, key: np.ndarray) -> np.ndarray:
    """rate rounded up or down by a number in [0, 1) that depends on key, so that the expected number of copies is the rate."""
    u = (_vec.mix(key.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)) >> np.uint64(11)) / float(1 << 53)
    return np.floor(rate).astype(np.int64) + (u < rate - np.floor(rate))


def mixed(docs: DataFrame, labels: DataFrame, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """docs with each row as often as its rate says (see copies()). Posteriors are computed again in the scan that repeats the
    rows, so texts aren't joined or shuffled. A null doc_id is rounded like any other key."""
    model = fit(docs, labels)
    post = cut(posteriors(docs, model))
    steps, _ = solve(post, weights)
    drop(post)
    known = docs.sparkSession.sparkContext.broadcast((model, steps))
    base = docs.select(*DOC_COLUMNS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, (m, down) = _vec.tables(), known.value
        for batch in batches:
            for lo, hi in _vec.pieces(batch.column("text")):
                part = batch.slice(lo, hi - lo)
                p = _posterior(part.column("text"), m, t)[1]
                rate = np.ones(hi - lo)
                for step in down:
                    rate = np.maximum(0.0, rate - p @ step)
                key = part.column("doc_id").fill_null(-1).to_numpy(zero_copy_only=False)
                yield part.take(pa.array(np.repeat(np.arange(hi - lo), copies(rate, key))))

    return base.mapInArrow(_vec.lean(run), base.schema)
