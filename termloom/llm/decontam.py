"""Benchmark decontamination: latent semantic retrieval over a distributed randomised SVD of TF-IDF passages, then
longest-common-subsequence and answer checks."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.llm import _vec
from termloom.llm._io import DOC_COLUMNS, cut, join_ids

WINDOW = 32  # words of a passage
STEP = 16  # words from one passage to the next
BITS = 12  # log2 of the features that words are hashed to
RANK = 64  # latent dimensions
OVERSAMPLE = 8
COSINE = 0.5  # latent cosine from which a passage is a candidate
MASS = 0.3  # share of an item passage's inverse document frequencies that a candidate's words must have in common with it
LCS = 0.6  # share of the item's words in the longest common subsequence
LCS_ANSWER = 0.45  # the share that is enough if the passage also holds the answer
ANSWER_WORDS = 6  # the item's last words count as its answer
ITEMS = 10_000  # benchmark items held by a task at once (about 10 MB of bits and vectors for passages of an item); more take further passes
ROWS = 256  # passages whose cosines with all items are computed at once
SCHEMA = "doc_id long, item_id long, cosine double, lcs double, answer boolean"


def _passages(at: np.ndarray, step: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, end, and text of each passage. The last passage of a text ends with it; every word is in one."""
    n = np.diff(at)
    k = np.where(n > 0, 1 + np.maximum(0, -(-(n - window) // step)), 0)
    text = np.repeat(np.arange(len(n)), k)
    j = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
    first = at[text] + j * step
    return first, np.minimum(first + window, at[text + 1]), text


def _feature(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - BITS)).astype(np.uint16)


def _places(f: np.ndarray, first: np.ndarray, end: np.ndarray, width: int) -> np.ndarray:
    """width x passages: the features of each passage's words, 2^BITS (a row of zeros in all tables) beyond its end."""
    place = first + np.arange(width)[:, None]
    return np.where(place < end, f[np.minimum(place, max(len(f) - 1, 0))], 1 << BITS).astype(np.int32)


def _sums(table: np.ndarray, places: np.ndarray) -> np.ndarray:
    """For each passage the sum of its words' rows; a loop over places is much faster than reduceat along rows."""
    y = np.take(table, places[0], axis=0)
    row = np.empty_like(y)
    for p in places[1:]:
        np.take(table, p, axis=0, out=row, mode="clip")
        y += row
    return y


def _scatter(z: np.ndarray, f: np.ndarray, y: np.ndarray, passage: np.ndarray) -> None:
    """z[feature of each word] += y[its passage]. Features go in order of their counts: the k-th words of all of them are
    added at once, and the long runs of the commonest ones are summed whole."""
    order = np.argsort(f, kind="stable")
    own = f[order]
    runs = np.flatnonzero(np.diff(own, prepend=own[0] ^ 1))
    n = np.diff(np.append(runs, len(own)))
    by = np.argsort(-n, kind="stable")
    n, runs, own, rows = n[by], runs[by], own[runs[by]], passage[order]
    total, limit = np.zeros((len(n), z.shape[1]), np.float32), 64
    for k in range(limit):
        some = int(np.searchsorted(-n, -k, side="left"))
        if not some:
            break
        total[:some] += np.take(y, rows[runs[:some] + k], axis=0)
    for i in range(int(np.searchsorted(-n, -limit, side="left"))):
        total[i] += y[rows[runs[i] + limit : runs[i] + n[i]]].sum(0)
    z[own] += total


def _padded(table: np.ndarray) -> np.ndarray:
    return np.concatenate([table, np.zeros((1, table.shape[1]), table.dtype)])


def idf(docs: DataFrame) -> np.ndarray:
    """log((1 + passages) / (1 + passages with the feature)) over the passages of all documents, cut side by side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, df, total = _vec.tables(), np.zeros(1 << BITS, np.int64), 0
        for batch in batches:
            for lo, hi in _vec.pieces(batch.column("text"), 1 << 19):
                h, at = _vec.words(batch.column("text").slice(lo, hi - lo), t)
                first, end, _ = _passages(at, WINDOW, WINDOW)
                key = np.repeat(np.arange(len(first), dtype=np.uint32) << np.uint32(BITS), end - first) | _feature(h)
                key.sort()
                key = key[np.diff(key, prepend=np.uint32(0xFFFFFFFF)) != 0]
                df += np.bincount(key & np.uint32((1 << BITS) - 1), minlength=1 << BITS)
                total += len(first)
        yield pa.RecordBatch.from_pydict({"k": np.arange(-1, 1 << BITS, dtype=np.int32), "n": np.concatenate([[total], df])})

    rows = docs.select("text").mapInArrow(_vec.lean(run), "k int, n long").groupBy("k").agg(F.sum("n").alias("n")).toPandas()
    n = np.zeros(1 + (1 << BITS))
    n[rows["k"].to_numpy() + 1] = rows["n"].to_numpy()
    return np.log((1 + n[0]) / (1 + n[1:])).astype(np.float32)


def latent(docs: DataFrame, weight: np.ndarray, rank: int = RANK) -> np.ndarray:
    """Features x rank: word vectors whose sum over a passage is its latent vector.

    X has a row of TF-IDF weights for each passage of every document. One pass forms Z = X'(X G) for a random G; Q, an
    orthonormal basis of Z, spans the leading right singular vectors, and Q'Z with Q'G give the singular values, by
    which the coordinates are whitened so that no dominant direction (a language, its commonest words) settles the cosine. What
    is summed over partitions is a matrix of fixed size (2^BITS x (rank + OVERSAMPLE)).
    """
    width = rank + OVERSAMPLE
    g = np.random.default_rng(7).standard_normal((1 << BITS, width)).astype(np.float32)
    wide = docs.sparkSession.sparkContext.broadcast((_padded(g * weight[:, None]), weight))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, z = _vec.tables(), np.zeros((1 << BITS, width))
        wg, w = wide.value
        for batch in batches:
            for lo, hi in _vec.pieces(batch.column("text"), 1 << 19):
                h, at = _vec.words(batch.column("text").slice(lo, hi - lo), t)
                if not len(h):
                    continue
                f = _feature(h)
                first, end, _ = _passages(at, WINDOW, WINDOW)
                y = _sums(wg, _places(f, first, end, WINDOW))
                _scatter(z, f, y, np.repeat(np.arange(len(first), dtype=np.int32), end - first))
        z *= w[:, None]
        k = np.flatnonzero(np.abs(z).sum(1))
        flat = pa.ListArray.from_arrays(pa.array(np.arange(len(k) + 1, dtype=np.int32) * width), pa.array(z[k].ravel()))
        yield pa.RecordBatch.from_pydict({"k": k.astype(np.int32), "z": flat})

    part = docs.select("text").mapInArrow(_vec.lean(run), "k int, z array<double>")
    total = part.groupBy("k").agg(F.array(*[F.sum(F.get("z", F.lit(i))) for i in range(width)]).alias("z")).toPandas()
    z = np.zeros((1 << BITS, width))
    if len(total):
        z[total["k"].to_numpy()] = np.stack(total["z"].to_numpy())
    q, _ = np.linalg.qr(z)
    # X'X is near Q B Q' with B = (Q'Z)(Q'G)^-1
    b = (q.T @ z) @ np.linalg.pinv(q.T @ g)
    value, vector = np.linalg.eigh((b + b.T) / 2)
    top = np.argsort(-value)[:rank]
    scale = np.sqrt(np.maximum(value[top], 1e-9 * max(value.max(), 1e-30)))
    return (weight[:, None] * (q @ vector[:, top]) / scale).astype(np.float32)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _lcs(masks: dict[int, int], words: list[int], n: int) -> int:
    """Length of the longest common subsequence with an item of n words, given as bit masks of each word's places."""
    v = (1 << n) - 1
    full = v
    for w in words:
        m = masks.get(w)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return n - v.bit_count()


def _items(texts: list[str], ids: list[int], vectors: np.ndarray, weight: np.ndarray) -> dict:
    """Benchmark items with words: hashes, masks, answers, and latent vectors of their passages."""
    t = _vec.tables()
    h, at = _vec.words(pa.array(texts, pa.large_string()), t)
    first, end, text = _passages(at, STEP, WINDOW)
    keep = np.flatnonzero(np.diff(at))
    items = []
    for i in keep:
        own = h[at[i] : at[i + 1]].tolist()
        masks: dict[int, int] = {}
        for j, w in enumerate(own):
            masks[w] = masks.get(w, 0) | 1 << j
        items.append({"id": ids[i], "n": len(own), "words": own, "masks": masks, "answer": own[-ANSWER_WORDS:]})
    unit = _unit(np.add.reduceat(vectors[_feature(h)], first, axis=0)) if len(first) else np.zeros((0, vectors.shape[1]), np.float32)
    lens = np.minimum(end, at[text + 1]) - first
    spot = np.cumsum(np.diff(at) > 0) - 1
    held = np.zeros((len(first), (1 << BITS) // 8 + 1), np.uint8)  # a bit for each feature that a passage has
    for i, (a, b) in enumerate(zip(first, end)):
        f = _feature(h[a:b]).astype(np.int64)
        np.bitwise_or.at(held[i], f >> 3, (1 << (f & 7)).astype(np.uint8))
    mass = np.array([weight[_feature(h[a:b])].sum() for a, b in zip(first, end)], np.float32)
    # a passage of few item words lies in a passage of WINDOW words: its cosine is lower by the root of their ratio
    return {"items": items, "unit": unit.astype(np.float32), "item": spot[text], "held": held, "mass": mass, "scale": np.sqrt(np.minimum(1, np.maximum(lens, 1) / WINDOW)).astype(np.float32)}


def _check(item: dict, words: list[int]) -> tuple[float, bool]:
    best = _lcs(item["masks"], words, item["n"]) / item["n"]
    answer, k = item["answer"], len(item["answer"])
    return best, any(words[j : j + k] == answer for j in range(len(words) - k + 1))


def contaminated(docs: DataFrame, benchmark: DataFrame, cosine: float = COSINE, lcs: float = LCS, lcs_answer: float = LCS_ANSWER) -> DataFrame:
    """(doc_id, item_id, cosine, lcs, answer) for every row of docs and benchmark item that its text gives away.

    Passages of WINDOW words, one every STEP words, so that every word of every text is covered, are candidates of an
    item if their latent cosine with one of its passages reaches `cosine` (times the root of an item's share of a passage, for
    shorter items) and their common words have MASS of its inverse document frequencies. A candidate is verified on the words from one item length before the passage to one after: lcs is the
    longest common subsequence's share of the item's words, answer tells whether the item's last ANSWER_WORDS words
    occur in a row. It stands if lcs >= `lcs`, or answer and lcs >= `lcs_answer`; the best passage is reported.

    Null and empty texts, and items without words, match nothing; a null doc_id is reported as null; repeated rows give
    repeated results; other columns aren't read. An empty benchmark or table gives no rows. Passes over docs:
    document frequencies, the SVD, and the search, none of which shuffles texts. Items go to the tasks ITEMS at a time.
    """
    spark = docs.sparkSession
    bench = benchmark.select("item_id", "text").filter("text is not null and item_id is not null")
    if bench.isEmpty():
        return spark.createDataFrame([], SCHEMA)
    weight = idf(docs)
    vectors = latent(docs, weight)
    n = bench.count()
    out = None
    for part in range(-(-n // ITEMS)):
        own = bench if n <= ITEMS else bench.filter(F.pmod(F.xxhash64("item_id"), F.lit(-(-n // ITEMS))) == part)
        rows = own.orderBy("item_id", "text").collect()
        known = spark.sparkContext.broadcast((_items([r.text for r in rows], [r.item_id for r in rows], vectors, weight), _padded(vectors), np.append(weight, np.float32(0))))

        def run(batches: Iterator[pa.RecordBatch], known=known) -> Iterator[pa.RecordBatch]:
            t = _vec.tables()
            bm, vec, weights = known.value
            limit = (cosine * bm["scale"])[None, :]
            for batch in batches:
                doc_ids = batch.column("doc_id")
                found = []
                for lo, hi in _vec.pieces(batch.column("text"), 1 << 19):
                    h, at = _vec.words(batch.column("text").slice(lo, hi - lo), t)
                    if not len(h) or not len(bm["items"]):
                        continue
                    f = _feature(h)
                    first, end, text = _passages(at, STEP, WINDOW)
                    # sums of STEP words, of which a passage is two
                    half, hend, htext = _passages(at, STEP, STEP)
                    sums = _sums(vec, _places(f, half, hend, STEP))
                    at_half = np.searchsorted(half, first)
                    nxt = np.minimum(at_half + 1, len(half) - 1)
                    two = (htext[nxt] == text) & (nxt > at_half)
                    p = _unit(sums[at_half] + sums[nxt] * two[:, None])
                    best: dict[tuple[int, int], tuple[float, float, bool]] = {}
                    places = _places(f, first, end, WINDOW).T
                    for a in range(0, len(p), ROWS):
                        c = p[a : a + ROWS] @ bm["unit"].T
                        hit = np.flatnonzero(c >= limit)
                        i, j = hit // c.shape[1], hit % c.shape[1]
                        cos, i = c.ravel()[hit], i + a
                        own = places[i]
                        mass = (weights[own] * ((bm["held"][j[:, None], own >> 3] >> (own & 7)) & 1)).sum(1)
                        keep = mass >= MASS * bm["mass"][j]
                        for row, k, cos1 in zip(i[keep].tolist(), bm["item"][j[keep]].tolist(), cos[keep].tolist()):
                            item, d = bm["items"][k], int(text[row])
                            old = best.get((d, k))
                            if old and old[1] >= 0.999:
                                continue
                            w = h[max(at[d], first[row] - item["n"]) : min(at[d + 1], end[row] + item["n"])]
                            share, answer = _check(item, w.tolist())
                            if (share >= lcs or answer and share >= lcs_answer) and (not old or (share, cos1) > (old[1], old[0])):
                                best[(d, k)] = (cos1, share, answer)
                    found += [(lo + d, bm["items"][k]["id"], *v) for (d, k), v in sorted(best.items())]
                if found:
                    row, item_id, cos, share, answer = zip(*found)
                    yield pa.RecordBatch.from_pydict({"doc_id": doc_ids.take(pa.array(row)), "item_id": pa.array(item_id, pa.int64()), "cosine": np.array(cos), "lcs": np.array(share), "answer": np.array(answer)})

        got = docs.select("doc_id", "text").mapInArrow(_vec.lean(run), SCHEMA)
        out = got if out is None else out.unionByName(got)
    return out


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs less the documents that contaminated() reports; rows with a null doc_id stay, since no id tells them apart."""
    bad = cut(contaminated(docs, benchmark).select("doc_id").filter("doc_id is not null").distinct())
    return join_ids(docs.select(*DOC_COLUMNS), bad, "doc_id", "left_anti").select(*DOC_COLUMNS)
