"""Near duplicates: n-gram Jaccard join by a MinHash LSH forest with exact verification of all pairs."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from termloom.llm import _vec
from termloom.llm._io import DOC_COLUMNS, cut, drop, join_ids
from termloom.llm.graph import components

NGRAM = 3
THRESHOLD = 0.5
TREES = 80
DEPTH = 3  # minhashes of a node, the forest's shortest prefix: a pair at the threshold shares none of 80 with a probability of 0.00002
BLOCK = 2048  # documents of a trie node that are compared in one task; more are parted into blocks of about that many
SMALL = 16  # nodes of more documents give each pair in its first common tree only; the pairs of others are made distinct afterwards
UNIT = 256  # documents of a large group, on either side, whose texts are read together


def sequences(h: np.ndarray, at: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """64 bits of the word sequence of each of the texts `rows`, which have words."""
    place = np.arange(len(h), dtype=np.uint64) - np.repeat(at[:-1], np.diff(at)).astype(np.uint64)
    return np.add.reduceat(_vec.mix(h + place * np.uint64(0x9E3779B97F4A7C15)), at[rows]).view(np.int64)


def signatures(docs: DataFrame, n: int = NGRAM) -> DataFrame:
    """(doc_id, tid, low, trees): the word sequence's number, four bits of each minhash, two in a byte, and each tree's label of the
    first DEPTH minhashes, whose last seven bits are the tree. Texts without words, and rows without a doc_id, have none."""
    rng = np.random.default_rng(20240601)
    factor = rng.integers(1, 1 << 63, TREES * DEPTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _vec.tables()
        for batch in batches:
            for lo, hi in _vec.pieces(batch.column("text"), 1 << 20):
                h, at = _vec.words(batch.column("text").slice(lo, hi - lo), t)
                rows = np.flatnonzero(np.diff(at))
                if not len(rows):
                    continue
                g, starts = _vec.ngrams(h, at, n)
                first = starts[rows]
                sig = np.empty((len(rows), TREES * DEPTH), np.uint32)
                for j in range(TREES * DEPTH):
                    sig[:, j] = np.minimum.reduceat(((g * factor[j]) >> np.uint64(32)).astype(np.uint32), first)
                cube = sig.reshape(len(rows), TREES, DEPTH).astype(np.uint64)
                label = np.broadcast_to(np.arange(TREES, dtype=np.uint64), (len(rows), TREES))
                for j in range(DEPTH):
                    label = _vec.mix(label * np.uint64(0x9E3779B97F4A7C15) + cube[:, :, j])
                label = (label & ~np.uint64(127)) | np.arange(TREES, dtype=np.uint64)
                low = (sig & np.uint32(15)).astype(np.uint8)
                low = low[:, 0::2] | (low[:, 1::2] << np.uint8(4))
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": batch.column("doc_id").slice(lo, hi - lo).take(pa.array(rows)),
                        "tid": sequences(h, at, rows),
                        "low": pa.array([r.tobytes() for r in low], pa.binary()),
                        "trees": pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * TREES), pa.array(label.view(np.int64).ravel())),
                    }
                )

    schema = "doc_id long, tid long, low binary, trees array<long>"
    return docs.select("doc_id", "text").filter("doc_id is not null and text is not null").mapInArrow(_vec.lean(run), schema)


def node_members(sigs: DataFrame) -> DataFrame:
    """(tree, p, n, a, b, own, tid) for the trie nodes that two texts or more share. A node of more than BLOCK texts is parted into
    blocks, and each pair of blocks (a, b) is a group of its own, so a group has 2 BLOCK members at most, whatever the node's size; in
    other nodes a = b = 0. own is the member's block."""
    # counted in a window: the forest's rows are shuffled once, not twice
    rows = sigs.select("tid", F.explode("trees").alias("p")).withColumn("n", F.count("*").over(Window.partitionBy("p"))).filter("n > 1")
    rows = rows.withColumn("tree", F.col("p").bitwiseAND(127).cast("int"))
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    rows = rows.withColumn("own", F.when(blocks > 1, F.pmod(F.xxhash64("tid"), blocks)).otherwise(0).cast("int"))
    pair = F.transform(F.sequence(F.lit(0), blocks - 1), lambda k: F.struct(F.least("own", k).alias("a"), F.greatest("own", k).alias("b")))
    one = F.array(F.struct(F.lit(0).alias("a"), F.lit(0).alias("b")))
    return rows.select("tree", "p", "n", "own", "tid", F.inline(F.when(blocks > 1, pair).otherwise(one)))


def node_edges(tids: np.ndarray, low: np.ndarray, least: float, side: np.ndarray | None = None, tags: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """(i, places j < i) of all pairs of a group whose estimate is at least `least`: if `side` is given, of different sides only; if
    `tags`, the labels of earlier trees, are given, of pairs that share none of these only, as an earlier tree has the others."""
    low = np.stack([low & 15, low >> 4], 2).reshape(len(low), -1)
    for i in range(1, len(tids)):
        s = ((low[:i] == low[i]).mean(1) - 1 / 16) / (1 - 1 / 16)
        near = np.flatnonzero((s >= least) & (tids[:i] != tids[i]))
        if side is not None:
            near = near[side[near] != side[i]]
        if tags is not None and len(near):
            near = near[~(tags[near] == tags[i]).any(1)]
        if len(near):
            yield i, near


def candidates(members: DataFrame, sigs: DataFrame, least: float) -> DataFrame:
    """(unit, a, b), a < b: node_edges() of all groups, each pair once. Pairs of one unit are those of one tree and group (for large ones,
    of UNIT members a side), the earliest tree of a pair, so that a text is read for many pairs at a time."""
    large = (F.col("n") > SMALL) & (F.col("tree") > 0)
    rows = members.withColumnsRenamed({"a": "ga", "b": "gb"}).join(sigs.select("tid", "low"), "tid")
    rows = rows.join(join_ids(sigs.select("tid", "trees"), cut(members.filter(large).select("tid").distinct()), "tid", "left_semi"), "tid", "left")
    tags = F.when(large, F.transform(F.slice("trees", 1, F.greatest("tree", F.lit(1))), lambda x: F.shiftright(x, 32).cast("int")))
    rows = rows.select("p", "ga", "gb", "tree", "n", "own", "tid", "low", tags.alias("tags"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, low, own, tags = None, [], [], [], []

        def result() -> Iterator[pa.RecordBatch]:
            if len(ids) < 2:
                return
            p, ga, gb, tree, n = now
            _, first = np.unique(np.array(ids, np.int64), return_index=True)
            tid, bits, side = np.array(ids, np.int64)[first], np.frombuffer(b"".join(low), np.uint8).reshape(len(ids), -1)[first], np.array(own)[first]
            met = np.stack([tags[k] for k in first]) if n > SMALL and tree > 0 else None
            # the unit begins with the tree, so that the least one of a pair is of its earliest
            key = _vec.mix(np.array([p], np.int64).view(np.uint64) + _vec.mix(np.array([ga * (1 << 20) + gb], np.uint64)))
            rank = np.arange(len(tid), dtype=np.uint64) // np.uint64(UNIT)
            a, b, u, many = [], [], [], 0
            for i, near in node_edges(tid, bits, least, side if ga != gb else None, met):
                part = key if len(tid) <= UNIT else _vec.mix(key + rank[near] * np.uint64(1 << 32) + rank[i] + np.uint64(1))
                a.append(tid[near]), b.append(np.full(len(near), tid[i]))
                u.append(np.broadcast_to((part >> np.uint64(8)).view(np.int64) + (tree << 56), len(near)))
                many += len(near)
                if many >= 1 << 18:
                    yield pa.RecordBatch.from_pydict({k: np.concatenate(x) for k, x in (("unit", u), ("a", a), ("b", b))})
                    a, b, u, many = [], [], [], 0
            if many:
                yield pa.RecordBatch.from_pydict({k: np.concatenate(x) for k, x in (("unit", u), ("a", a), ("b", b))})

        for batch in batches:
            keys = zip(*[batch.column(c).to_pylist() for c in ("p", "ga", "gb", "tree", "n")])
            lists = batch.column("tags")
            at, flat = np.asarray(lists.offsets), np.asarray(lists.values)
            for k, (key, tid, x, side) in enumerate(zip(keys, batch.column("tid").to_pylist(), batch.column("low").to_pylist(), batch.column("own").to_pylist())):
                if key != now:
                    yield from result()
                    now, ids, low, own, tags = key, [], [], [], []
                ids.append(tid), low.append(x), own.append(side), tags.append(flat[at[k] : at[k + 1]])
        yield from result()

    found = rows.repartition("p", "ga", "gb").sortWithinPartitions("p", "ga", "gb", "tree").mapInArrow(_vec.lean(run), "unit long, a long, b long")
    return found.groupBy("a", "b").agg(F.min("unit").alias("unit"))


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Common elements of two sorted arrays of distinct numbers."""
    if len(a) > len(b):
        a, b = b, a
    return int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())


def jaccards(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jaccard similarity of the pairs (a, b) of places in sets, sorted arrays of distinct numbers, none of them empty."""
    size = np.array([len(x) for x in sets])
    if len(a) <= len(sets):
        both = np.array([overlap(sets[i], sets[j]) for i, j in zip(a.tolist(), b.tolist())])
        return both / (size[a] + size[b] - both)
    _, flat = np.unique(np.concatenate(sets), return_inverse=True)
    part = np.split(flat, np.cumsum(size)[:-1])
    mark = np.zeros(len(flat), bool)
    order = np.argsort(a, kind="stable")
    both = np.empty(len(a), np.int64)
    for js in np.split(order, np.flatnonzero(np.diff(a[order])) + 1):
        own = part[a[js[0]]]
        mark[own] = True
        at = np.cumsum(np.concatenate([[0], size[b[js[:-1]]]]))
        both[js] = np.add.reduceat(mark[np.concatenate([part[j] for j in b[js].tolist()])].astype(np.int64), at)
        mark[own] = False
    return both / (size[a] + size[b] - both)


def verified(pairs: DataFrame, texts: DataFrame, n: int, threshold: float) -> DataFrame:
    """(a, b, jaccard) of the pairs (unit, a, b) whose n-gram sets reach the threshold. texts (unit, tid, text) has the texts of each
    unit's pairs; of those that come with a tid, the one that it is the number of is read."""
    none = F.lit(None)
    rows = texts.select("unit", F.lit(0).alias("kind"), F.col("tid").alias("a"), none.cast("long").alias("b"), "text")
    rows = rows.unionByName(pairs.select("unit", F.lit(1).alias("kind"), "a", "b", none.cast("string").alias("text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _vec.tables()
        now, place, sets, xs, ys = None, {}, [], [], []

        def result() -> Iterator[pa.RecordBatch]:
            if xs:
                a, b = np.concatenate(xs), np.concatenate(ys)
                jac = jaccards(sets, np.array([place[x] for x in a.tolist()]), np.array([place[x] for x in b.tolist()]))
                keep = jac >= threshold
                if keep.any():
                    yield pa.RecordBatch.from_pydict({"a": a[keep], "b": b[keep], "jaccard": jac[keep]})

        for batch in batches:
            for lo, hi in _vec.pieces(batch.column("text")):
                part = batch.slice(lo, hi - lo)
                unit, kind, a = (np.asarray(part.column(c)) for c in ("unit", "kind", "a"))
                b = np.asarray(part.column("b").fill_null(0))
                h, at = _vec.words(part.column("text"), t)
                g, gs = _vec.ngrams(h, at, n)
                worded = np.flatnonzero(np.diff(at))
                number = np.zeros(len(a), np.int64)
                if len(worded):
                    number[worded] = sequences(h, at, worded)
                for run_of in np.split(np.arange(len(a)), np.flatnonzero((np.diff(unit) != 0) | (np.diff(kind) != 0)) + 1):
                    k = run_of[0]
                    if unit[k] != now:
                        yield from result()
                        now, place, sets, xs, ys = unit[k], {}, [], [], []
                    if kind[k]:
                        xs.append(a[run_of]), ys.append(b[run_of])
                        continue
                    for j in run_of.tolist():
                        if at[j + 1] > at[j] and number[j] == a[j] and int(a[j]) not in place:
                            place[int(a[j])] = len(sets)
                            sets.append(np.unique(g[gs[j] : gs[j + 1]]))
        yield from result()

    return rows.repartition("unit").sortWithinPartitions("unit", "kind").mapInArrow(_vec.lean(run), "a long, b long, jaccard double")


def near_pairs(docs: DataFrame, threshold: float = THRESHOLD, n: int = NGRAM) -> tuple[DataFrame, DataFrame]:
    """Texts (doc_id, tid, rep, next), one row for each document and text, with the text's smallest doc_id and the next one, if any;
    and all pairs (a, b, jaccard) of different texts by their numbers tid. Both are cut()."""
    sigs = cut(signatures(docs, n))
    by = Window.partitionBy("tid")
    of = sigs.groupBy("doc_id", "tid").agg(F.count("*").alias("rows")).withColumn("rep", F.min("doc_id").over(by))
    of = cut(of.withColumn("next", F.min(F.when(F.col("doc_id") > F.col("rep"), F.col("doc_id"))).over(by)))
    copies = cut(of.filter("doc_id <> rep").select("doc_id", "tid"))
    alone = join_ids(sigs, copies, ["doc_id", "tid"], "left_anti")
    if not of.filter("rows > 1 and doc_id = rep").isEmpty():
        alone = alone.dropDuplicates(["tid"])
    error = 5 * (threshold * (1 - threshold) / (TREES * DEPTH)) ** 0.5 / (1 - 1 / 16)  # five standard errors
    members = cut(node_members(alone))
    pairs = cut(candidates(members, alone, threshold - error))
    drop(sigs)
    drop(members)
    units = pairs.select("unit", F.explode(F.array("a", "b")).alias("tid")).distinct()
    units = cut(units.join(of.filter("doc_id = rep").select("tid", F.col("rep").alias("doc_id")), "tid"))
    text = docs.select("doc_id", "text").filter("doc_id is not null and text is not null")
    text = join_ids(text, cut(units.select("doc_id").distinct()), "doc_id", "left_semi").select("doc_id", "text")
    return of.drop("rows"), cut(verified(pairs, units.join(text, "doc_id").select("unit", "tid", "text"), n, threshold))


def _best(jaccard: Column, other: Column) -> Column:
    return F.struct(jaccard.alias("jaccard"), (-other).alias("other"))


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, n: int = NGRAM) -> DataFrame:
    """(doc_id, duplicate_of, jaccard, group_id, n_links): one row for each document with a near duplicate: its most similar one (the
    smallest of equal ones), its group, and its number of links, copies counted each. Documents without a row have no link.

    Two documents are linked if the Jaccard similarity of their sets of n-grams of lower-cased words is at least
    `threshold`. Groups are the components of all links, and group_id is its smallest doc_id. Each link is verified exactly.
    Texts of equal word sequences are one text (jaccard 1): they are counted, but not expanded into pairs.

    Texts without words, null texts and null doc_ids are in no group. Rows that repeat a doc_id are versions of one
    document: each different version is compared and its links counted, but a document is never its own duplicate. A text of fewer
    words than n is one n-gram. Other columns aren't read; an empty table gives no rows.

    Approximate is only the search: a pair at the threshold shares no trie node with a probability of 0.00002, a more similar one with
    less; all pairs of a node are compared by their minhashes, and one is given up unread only if these put it five standard
    errors below the threshold (probability 3e-7). All others are read and counted, so work grows with the number of links
    and, within a node, with the square of the texts that share it; large nodes are spread in blocks.

    Shuffled: small rows of the forest; then pairs, and their texts once for each group of pairs.
    """
    of, near = near_pairs(docs, threshold, n)
    kind = of.filter("doc_id = rep").select("tid", "rep", "next").join(of.groupBy("tid").agg(F.count("*").alias("many")), "tid")
    kind = cut(kind)
    ends = F.array(*[F.struct(F.col(x).alias("tid"), F.col(y).alias("u"), "jaccard") for x, y in (("a", "b"), ("b", "a"))])
    links = cut(near.select(F.inline(ends)).join(kind.select(F.col("tid").alias("u"), "rep", "next", "many"), "u"))
    several = cut(of.groupBy("doc_id").count().filter("count > 1").select("doc_id"))
    # groups: links between the texts' first documents, and documents that have several texts
    joins = links.filter("tid < u").select("tid", F.col("rep").alias("b")).join(kind.select("tid", F.col("rep").alias("a")), "tid").select("a", "b")
    joins = joins.unionByName(join_ids(of, several, "doc_id", "left_semi").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")))
    part = cut(components(joins))
    group = of.join(part.withColumnRenamed("node", "rep"), "rep", "left").groupBy("doc_id").agg(F.min(F.coalesce("root", "rep")).alias("group_id"))
    # links by text; documents of several texts don't count their own
    texts = links.groupBy("tid").agg(F.sum("many").alias("links"), F.max(_best(F.col("jaccard"), F.col("rep"))).alias("x"))
    own = of.join(kind.select("tid", "many"), "tid").withColumn("copy", F.when(F.col("many") > 1, _best(F.lit(1.0), F.when(F.col("doc_id") == F.col("rep"), F.col("next")).otherwise(F.col("rep")))))
    one = join_ids(own, several, "doc_id", "left_anti").join(texts, "tid", "left")
    one = one.select("doc_id", F.greatest("copy", "x").alias("x"), (F.col("many") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    more = join_ids(own, several, "doc_id", "left_semi")
    copies = more.select("doc_id", F.col("copy").alias("x"), (F.col("many") - 1).alias("n_links"))
    has = more.select("doc_id", F.col("tid").alias("u"), F.lit(1).alias("has"))
    met = more.select("doc_id", "tid").join(links, "tid").join(has, ["doc_id", "u"], "left").withColumn("n_links", F.col("many") - F.coalesce("has", F.lit(0)))
    met = met.filter("n_links > 0").select("doc_id", _best(F.col("jaccard"), F.when(F.col("rep") == F.col("doc_id"), F.col("next")).otherwise(F.col("rep"))).alias("x"), "n_links")
    more = copies.unionByName(met).groupBy("doc_id").agg(F.max("x").alias("x"), F.sum("n_links").alias("n_links"))
    found = one.unionByName(more).filter("n_links > 0").join(group, "doc_id")
    return found.select("doc_id", (-F.col("x.other")).alias("duplicate_of"), "x.jaccard", "group_id", "n_links")


def deduplicated(docs: DataFrame, threshold: float = THRESHOLD, n: int = NGRAM) -> DataFrame:
    """docs less all documents of each group but that of the smallest doc_id, as near_duplicates() finds them; all rows of a
    dropped doc_id go. Rows that repeat a kept doc_id with the same text stay once; null doc_ids stay."""
    ids = cut(near_duplicates(docs, threshold, n).filter("doc_id <> group_id").select("doc_id"))
    base = docs.select(*DOC_COLUMNS)
    kept = join_ids(base, ids, "doc_id", "left_anti").select(*DOC_COLUMNS)
    again = cut(base.groupBy("doc_id").count().filter("count > 1 and doc_id is not null").select("doc_id"))
    if again.isEmpty():
        return kept
    once = join_ids(kept, again, "doc_id", "left_anti").select(*DOC_COLUMNS)
    return once.unionByName(join_ids(kept, again, "doc_id", "left_semi").select(*DOC_COLUMNS).dropDuplicates(["doc_id", "text"]))
