"""Language identification by multilingual mixture inference.

Each language has a byte trigram model P(byte | two bytes before it, within the word). A document's words are taken as
drawn from a mixture of languages and of a "none" component that gives every byte the same probability; the shares
are found by expectation-maximisation, and the language set by backward elimination under a penalised likelihood.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.llm import _vec
from termloom.llm._io import DOC_COLUMNS

BITS = 18  # a trigram is three codes of 6 bits, so its context is the upper 12
SMOOTH = 0.5  # weight of the uniform distribution in each context
NONE_LOGP = float(np.log(1 / 48))  # log-probability of a byte that no language explains
EM_STEPS = 12
PENALTY = 3.0  # times log(words + 1), for each language of the set
MAX_NONE = 0.7  # share of words that no language explains beyond which a document is rejected


def _codes(texts: pa.Array, t: dict) -> tuple[np.ndarray, ...]:
    """Trigram codes of all bytes, which of them are in words, word spans, and each text's first word."""
    if "six" not in t:
        t["word"][48:58] = False  # digits belong to no language
        byte = np.arange(256)
        t["six"] = np.where(byte >= 128, 26 + byte % 37, np.where((byte >= 97) & (byte < 123), byte - 97, 63)).astype(np.int32)
    b, off = _vec.raw(texts)
    s, e = _vec.spans(b, t)
    x = np.concatenate([np.full(2, 63, np.int32), t["six"][b]])
    a = x[1:-1]
    z = np.where(a == 63, np.int32(63), x[:-2])
    x = x[2:]
    return (z << 12) | (a << 6) | x, x != 63, s, e, np.searchsorted(s, off)


def train(docs: DataFrame) -> dict:
    """Models from all documents with a lang. Counts are summed within each partition and then over partitions, so what
    reaches the driver is at most (languages x 2 x 2^BITS) rows, whatever the number of documents. Rows whose lang or
    text is null or empty add nothing; with no labelled text there are no languages, and every document is rejected."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, total = _vec.tables(), {}
        for batch in batches:
            names = np.array(batch.column("lang").to_pylist(), dtype=object)
            for lang in sorted(set(names)):
                texts = batch.column("text").filter(pa.array(names == lang))
                for lo, hi in _vec.pieces(texts):
                    tri, inside, *_ = _codes(texts.slice(lo, hi - lo), t)
                    c = total.setdefault(lang, np.zeros(1 << BITS, np.int64))
                    c += np.bincount(tri[inside], minlength=1 << BITS)
        for lang, c in total.items():
            k = np.flatnonzero(c)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(k)), "k": k.astype(np.int32), "n": c[k]})

    labelled = docs.select("lang", "text").filter("lang is not null and lang <> '' and text is not null")
    counts = labelled.mapInArrow(_vec.lean(count), "lang string, k int, n long").groupBy("lang", "k").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(counts["lang"].unique())
    logp = np.zeros((1 << BITS, len(langs)), np.float32)
    for i, lang in enumerate(langs):
        own = counts[counts["lang"] == lang]
        c = np.zeros((1 << (BITS - 6), 64))
        c.ravel()[own["k"].to_numpy()] = own["n"].to_numpy()
        logp[:, i] = (np.log(c + SMOOTH / 64) - np.log(c.sum(1, keepdims=True) + SMOOTH)).ravel()
    return {"langs": langs, "logp": logp}


def word_scores(texts: pa.Array, model: dict, t: dict) -> tuple[np.ndarray, np.ndarray]:
    """log P(word | component), a row for each component ("none" is the last), and each text's first word."""
    tri, _, s, e, at = _codes(texts, t)
    out = np.empty((len(model["langs"]) + 1, len(s)), np.float32)
    if len(s):
        inside = np.repeat(s - np.concatenate([[0], np.cumsum(e - s)[:-1]]), e - s) + np.arange((e - s).sum())
        first = np.concatenate([[0], np.cumsum(e - s)[:-1]])
        out[:-1] = np.add.reduceat(model["logp"][tri[inside]], first, axis=0).T
    out[-1] = NONE_LOGP * (e - s)
    return out, at


def _em(p: np.ndarray, first: np.ndarray, n: np.ndarray, allowed: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Shares (components x documents) and the mixed likelihood of each word; allowed: what each document may use."""
    pi = (allowed / allowed.sum(0)).astype(np.float32)
    for _ in range(steps):
        mixed = np.maximum((p * np.repeat(pi, n, axis=1)).sum(0), np.float32(1e-30))
        pi *= np.add.reduceat(p / mixed, first, axis=1) / n.astype(np.float32)
    return pi, np.maximum((p * np.repeat(pi, n, axis=1)).sum(0), np.float32(1e-30))


def _part(ll: np.ndarray, at: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, ...]:
    """The words of some documents: likelihoods over the largest, its log, first words, and word counts."""
    m = np.diff(at)[rows]
    first = np.concatenate([[0], np.cumsum(m)[:-1]])
    part = ll if len(rows) == len(at) - 1 else ll[:, np.repeat(at[rows] - first, m) + np.arange(m.sum())]
    top = part.max(0)
    return np.exp(part - top), top, first, m


def mixtures(ll: np.ndarray, at: np.ndarray, steps: int = EM_STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Chosen components and their shares (components x documents). Documents without words have none.

    The log-likelihood is concave in the shares, so from any shares it can rise by at most words * log(max_k g_k), g_k
    being component k's mean likelihood over the mixed one. Where that bound, less two languages' penalty, doesn't
    exceed the best single component, the single one is the optimum; this settles most documents in a few steps.
    The rest go through backward elimination: the smallest share is dropped while that raises the penalised likelihood.
    """
    k, docs = len(ll), len(at) - 1
    chosen, shares = np.zeros((k, docs), bool), np.zeros((k, docs))
    rows = np.flatnonzero(np.diff(at))
    if not len(rows):
        return chosen, shares
    p, top, first, m = _part(ll, at, rows)
    single = np.add.reduceat(ll, at[rows], axis=1, dtype=np.float64)
    best = single.argmax(0)
    pi, mixed = _em(p, first, m, np.ones((k, len(rows))), 3)
    gain = (np.add.reduceat(p / mixed, first, axis=1) / m).max(0)
    bound = np.add.reduceat(np.log(mixed) + top, first, dtype=np.float64) + m * np.log(np.maximum(gain, 1))
    pen = PENALTY * np.log(m + 1)
    settled = single.max(0) - pen >= bound - 2 * pen
    chosen[best[settled], rows[settled]] = True
    shares[best[settled], rows[settled]] = 1
    rows = rows[~settled]
    chosen[:, rows] = True
    score, tried = np.full(docs, -np.inf), False
    while len(rows):  # at most k rounds: each drops one component of every document still open
        p, top, first, m = _part(ll, at, rows)
        use = chosen[:, rows].copy()
        if tried:
            use[np.where(use, shares[:, rows], 9).argmin(0), np.arange(len(rows))] = False
        pi, mixed = _em(p, first, m, use, steps)
        new = np.add.reduceat(np.log(mixed) + top, first, dtype=np.float64) - PENALTY * np.log(m + 1) * use.sum(0)
        better = new >= score[rows]
        took = rows[better]
        chosen[:, took], shares[:, took], score[took] = use[:, better], pi[:, better], new[better]
        rows = took[chosen[:, took].sum(0) > 1]
        tried = True
    return chosen, shares


SCHEMA = "doc_id long, lang string, languages array<string>, shares array<double>, none_share double, n_words long, accepted boolean"


def identify(docs: DataFrame, model: dict | None = None, max_none: float = MAX_NONE) -> DataFrame:
    """One row for each row of docs: the main language, the language set by falling share (ties by name), the shares,
    the share of words that no language explains, and whether the document is accepted, that is, has words and
    none_share <= max_none. Null and empty texts have no languages and aren't accepted; repeated rows give repeated
    results; a null doc_id stays null; other columns aren't read. The model is trained on docs if none is given.
    A map over texts: nothing is shuffled but the model's counts."""
    model = model or train(docs)
    known = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _vec.tables()
        langs = known.value["langs"]
        for batch in batches:
            for lo, hi in _vec.pieces(batch.column("text")):
                ll, at = word_scores(batch.column("text").slice(lo, hi - lo), known.value, t)
                chosen, shares = mixtures(ll, at)
                sets, values = [], []
                for j in range(hi - lo):
                    own = sorted((-shares[i, j], lang, i) for i, lang in enumerate(langs) if chosen[i, j])
                    sets.append([x[1] for x in own])
                    values.append([float(-x[0]) for x in own])
                none = shares[-1]
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": batch.column("doc_id").slice(lo, hi - lo),
                        "lang": pa.array([x[0] if x else None for x in sets], pa.string()),
                        "languages": pa.array(sets, pa.list_(pa.string())),
                        "shares": pa.array(values, pa.list_(pa.float64())),
                        "none_share": none,
                        "n_words": np.diff(at).astype(np.int64),
                        "accepted": np.array([bool(x) for x in sets], bool) & (none <= max_none),
                    }
                )

    return docs.select("doc_id", "text").mapInArrow(_vec.lean(run), SCHEMA)


def accepted_documents(docs: DataFrame) -> DataFrame:
    """The rows of docs that identify() accepts, decided row by row without a join; lang is the detected main language.
    Rows with a null or empty text go. The columns are those of documents."""
    known = docs.sparkSession.sparkContext.broadcast(train(docs))
    docs = docs.select(*DOC_COLUMNS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _vec.tables()
        langs = np.array([*known.value["langs"], None], dtype=object)
        for batch in batches:
            for lo, hi in _vec.pieces(batch.column("text")):
                part = batch.slice(lo, hi - lo)
                ll, at = word_scores(part.column("text"), known.value, t)
                chosen, shares = mixtures(ll, at)
                main = np.where(chosen[:-1], shares[:-1], -1.0)
                keep = chosen[:-1].any(0) & (shares[-1] <= MAX_NONE)
                best = langs[main.argmax(0)] if len(langs) > 1 else np.full(hi - lo, None)
                part = part.set_column(2, "lang", pa.array(best, pa.string()))
                yield part.filter(pa.array(keep))

    return docs.mapInArrow(_vec.lean(run), docs.schema)


