"""Disambiguation: the clique of subject classes of the highest score."""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from termloom.functions.classes import SHORTEST, class_index, log_matrix
from termloom.operators.segment import doc_keys


def eligible(matches: DataFrame) -> DataFrame:
    """Matches of scheme msc with a known class, and of at least SHORTEST characters, with msc_index."""
    ok = (F.col("scheme") == "msc") & ~F.col("category").startswith("XX") & (F.length("concept") >= SHORTEST)
    return matches.filter(ok).withColumn("msc_index", class_index(F.col("category"))).filter("msc_index is not null")


def distinct_links(matches: DataFrame) -> DataFrame:
    """Within a document and class, the first match of each link; matches without a link all stay."""
    w = Window.partitionBy(*doc_keys(matches), "msc_index", "link").orderBy("offset_begin", "conceptid")
    return matches.withColumn("rn", F.row_number().over(w)).filter("rn = 1 or link is null or link = ''").drop("rn")


def weights(matches: DataFrame) -> DataFrame:
    """(doc_id, msc_index, weight, size): the characters beyond SHORTEST of a class's matches, and their number."""
    return matches.groupBy(*doc_keys(matches), "msc_index").agg(F.sum(F.length("concept") - SHORTEST).cast("long").alias("weight"), F.count("*").alias("size"))


def ranking(weights_: DataFrame) -> DataFrame:
    """weights with place: by weight as a string, descending (9 before 12), ties by class."""
    w = Window.partitionBy(*doc_keys(weights_)).orderBy(F.col("weight").cast("string").desc(), "msc_index")
    return weights_.withColumn("place", F.row_number().over(w))


def best_clique(queue: list[tuple[int, float, int]], logs: list[list[float]]) -> list[int]:
    """The classes of the best-scoring clique of queue [(class, weight, size)], in that order.

    From a clique, each later class of the queue may be added as long as classes aren't smaller than the last one
    added; adding takes its weight and the log similarities with all members, and must not lower the score. A clique of
    score 0 with classes left isn't a result. Of equal scores the first found wins; [] if nothing is found.
    """

    def search(at: int, score: float, clique: list[int]) -> tuple[float, list[int]] | None:
        if at == len(queue):
            return score, clique
        found: list[tuple[float, list[int]] | None] = [(score, clique)] if score else []
        bound = 0
        for k in range(at, len(queue)):
            own, weight, size = queue[k]
            if size < bound:
                break
            terms = [logs[own][c] for c in clique]
            if any(t == 0 for t in terms):
                continue
            new = score + weight + sum(terms)
            if new < score:
                continue
            found.append(search(k + 1, new, [*clique, own]))
            bound = size
        best: tuple[float, list[int]] | None = None
        for x in found:
            if best is None or (x[0] if x else 0) > best[0]:
                best = x or (0, [])
        return best

    got = search(0, 0.0, [])
    return got[1] if got else []


def disambiguate(matches: DataFrame, include_all: bool = False) -> DataFrame:
    """The eligible matches whose class is in the best clique of their document, in order of offset within a document; all if include_all.

    A document's matches are gathered once, by doc_id; the search sees one row of numbers for each class, at most 63.
    """
    if include_all:
        return matches
    own = distinct_links(eligible(matches))
    keys = doc_keys(matches)
    names = ["offset_begin", *[c for c in matches.columns if c not in (*keys, "offset_begin")]]
    per = own.groupBy(*keys, "msc_index").agg(F.sum(F.length("concept") - SHORTEST).cast("long").alias("weight"), F.count("*").alias("size"), F.collect_list(F.struct(*names)).alias("rows"))
    order = F.struct("weight", "size", "msc_index", "rows")
    docs = per.groupBy(*keys).agg(F.collect_list(order).alias("classes"))
    logs = log_matrix()

    @F.pandas_udf("array<int>")
    def clique(index: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for ids, weight, size in index:
            out = []
            for i, w, s in zip(ids, weight, size):
                # two stable sorts: class ascending, then weight as a string descending
                queue = sorted(sorted(zip(i.tolist(), w.tolist(), s.tolist())), key=lambda x: str(x[1]), reverse=True)
                out.append(best_clique(queue, logs))
            yield pd.Series(out)

    part = lambda f: F.transform("classes", lambda c: c[f])
    won = docs.withColumn("won", clique(part("msc_index"), part("weight"), part("size")))
    kept = F.filter("classes", lambda c: F.array_contains("won", c["msc_index"]))  # at most 63 classes
    rows = F.array_sort(F.flatten(F.transform(kept, lambda c: c["rows"])))
    return won.select(*keys, F.inline(rows)).select(*matches.columns)
