"""Near duplicates of embeddings by a subspace pigeonhole join."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.llm import _vec
from termloom.llm._io import cut
from termloom.llm.graph import components

COSINE = 0.98
BLOCK = 8  # dimensions of a block
GRID = 4  # dimensions of a block that are cut into cells
CELL = 2.0  # width of a cell over the radius of its block
SEED = 11


def _cells(y: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, cell, home) for all cells within radius of each row's grid coordinates; home: the cell that holds it."""
    width = CELL * radius
    base = np.floor(y / width).astype(np.int64)
    step = int(np.ceil(1 / CELL))
    moves = np.stack(np.meshgrid(*[np.arange(-step, step + 1)] * y.shape[1], indexing="ij"), -1).reshape(-1, y.shape[1])
    rows, cells, homes = [], [], []
    for move in moves:
        c = base + move
        gap = np.maximum(np.maximum(c * width - y, y - (c + 1) * width), 0)
        near = np.flatnonzero((gap * gap).sum(1) <= radius * radius * (1 + 1e-9))
        key = np.zeros(len(near), np.int64)
        for j in range(y.shape[1]):
            key = key * 1_000_003 + c[near, j]
        rows.append(near)
        cells.append(key)
        homes.append(np.full(len(near), not move.any()))
    return np.concatenate(rows), np.concatenate(cells), np.concatenate(homes)


def near_duplicates(embeddings: DataFrame, cosine: float = COSINE, block: int = BLOCK) -> DataFrame:
    """(vec_id, class_id, n_links): one row for each vector with a near duplicate. Classes are the components of all pairs of a cosine of
    at least `cosine`, class_id being its smallest vec_id; n_links is the number of other ids that the vector makes such a pair with,
    copies counted each. See near_pairs() for the pairs; copies are never expanded into pairs.

    An id with several vectors has a row for each class of theirs. Nulls, empty tables and odd vectors: see near_pairs()."""
    kinds = _kinds(embeddings)
    pairs = cut(near_pairs(kinds, cosine, block))
    many = cut(kinds.groupBy("rep").agg(F.count_distinct("vec_id").alias("many")))
    both = pairs.select(F.inline(F.array(*[F.struct(F.col(x).alias("rep"), F.col(y).alias("other")) for x, y in (("id_a", "id_b"), ("id_b", "id_a"))])))
    links = both.join(many.withColumnRenamed("rep", "other"), "other").groupBy("rep").agg(F.sum("many").alias("links"))
    root = components(pairs.select(F.col("id_b").alias("a"), F.col("id_a").alias("b"))).select(F.col("node").alias("rep"), "root")
    of = many.join(links, "rep", "left").join(root, "rep", "left")
    of = of.select("rep", F.coalesce("root", "rep").alias("class_id"), (F.col("many") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")).filter("n_links > 0")
    return kinds.select("vec_id", "rep").distinct().join(of, "rep").groupBy("vec_id", "class_id").agg(F.max("n_links").alias("n_links"))


def _kinds(embeddings: DataFrame) -> DataFrame:
    """(vec_id, embedding, rep) of the vectors that take part, rep being the smallest id with equal components. Groups of copies are
    summed up on the map side, and only ids go back to their members."""
    good = "vec_id is not null and size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < float('inf')) and exists(embedding, x -> x <> 0)"
    rows = embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).filter(good)
    rows = rows.withColumns({"k1": F.xxhash64("embedding"), "k2": F.xxhash64(F.lit(1), "embedding")})
    reps = rows.groupBy("k1", "k2").agg(F.min("vec_id").alias("rep"))
    return cut(rows.join(reps, ["k1", "k2"]).select("vec_id", "embedding", "rep"))


def near_pairs(kinds: DataFrame, cosine: float = COSINE, block: int = BLOCK) -> DataFrame:
    """(id_a, id_b, cosine): all pairs of different vectors of kinds (see _kinds()), id_a < id_b, whose cosine is at least `cosine`;
    no pair is missed. Of equal vectors only the one of the smallest id takes part.

    Vectors are scaled to length 1, so the cosine bounds the squared distance by e = 2 - 2 cosine, and are rotated at
    random, which spreads distance evenly over dimensions. Cut into blocks, two vectors within e have a block in which
    their squared distance is at most e times its share of the dimensions. So each block is a range join under that
    budget: vectors lie in cells of a grid over its first GRID coordinates and are also listed in the cells within
    its radius, an equi-join on (block, cell) brings a vector's home together with the others' lists, and the block's
    distance is tested within the join. The union of all blocks' candidates is verified on whole vectors.

    Null ids, null or empty vectors, vectors of length 0 and those with a null, NaN or infinite component take no part;
    vectors of different dimension are never a pair. Rows that repeat an id with another vector are each compared, but an
    id is no pair with itself. Other columns aren't read.
    """
    e = 2 - 2 * cosine
    reps = kinds.filter("vec_id = rep").select("vec_id", "embedding").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns = {}
        for batch in batches:
            column = batch.column("embedding")
            size = np.diff(column.offsets.to_numpy())
            flat, first = column.flatten().to_numpy(), column.offsets.to_numpy()[:-1] - column.offsets.to_numpy()[0]
            ids = batch.column("vec_id").to_numpy()
            for d in np.unique(size):
                own = np.flatnonzero(size == d)
                x = flat[first[own][:, None] + np.arange(d)]
                x = x / np.linalg.norm(x, axis=1, keepdims=True)
                if d not in turns:
                    turns[d] = np.linalg.qr(np.random.default_rng(SEED).standard_normal((d, d)))[0]
                y = x @ turns[d]
                for k, lo in enumerate(range(0, d, block)):
                    z = y[:, lo : lo + block]
                    budget = e * z.shape[1] / d + 1e-9
                    row, cell, home = _cells(z[:, :GRID], float(np.sqrt(budget)))
                    coords = pa.ListArray.from_arrays(pa.array(np.arange(len(row) + 1, dtype=np.int32) * z.shape[1]), pa.array(z[row].astype(np.float32).ravel()))
                    yield pa.RecordBatch.from_pydict({"vec_id": ids[own][row], "part": np.full(len(row), int(d) * 4096 + k, np.int64), "cell": cell, "home": home, "budget": np.full(len(row), budget + 1e-6), "z": coords})

    listed = cut(reps.mapInArrow(_vec.lean(run), "vec_id long, part long, cell long, home boolean, budget double, z array<float>"))
    dims = [F.coalesce(F.get("z", F.lit(i)), F.lit(0.0)).cast("float") for i in range(block)]
    left = listed.filter("home").select("part", "cell", "budget", F.col("vec_id").alias("id_a"), *[d.alias(f"a{i}") for i, d in enumerate(dims)])
    right = listed.select("part", "cell", F.col("vec_id").alias("id_b"), *[d.alias(f"b{i}") for i, d in enumerate(dims)])
    apart = sum((F.pow(F.col(f"a{i}") - F.col(f"b{i}"), F.lit(2)) for i in range(block)), F.lit(0.0))
    # a list reaches both ways, so one order of the ids finds every pair
    pairs = left.join(right, ["part", "cell"]).filter((F.col("id_a") < F.col("id_b")) & (apart <= F.col("budget"))).select("id_a", "id_b").distinct()
    a = reps.select(F.col("vec_id").alias("id_a"), F.col("embedding").alias("x"))
    b = reps.select(F.col("vec_id").alias("id_b"), F.col("embedding").alias("y"))
    dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda u, v: u * v), F.lit(0.0), lambda s, u: s + u)
    value = dot("x", "y") / F.sqrt(dot("x", "x") * dot("y", "y"))
    exact = pairs.join(a, "id_a").join(b, "id_b").filter(F.size("x") == F.size("y")).select("id_a", "id_b", value.alias("cosine"))
    return exact.filter(F.col("cosine") >= cosine).groupBy("id_a", "id_b").agg(F.max("cosine").alias("cosine"))


ORACLE = f"""
WITH RECURSIVE k AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x, min(vec_id) OVER (PARTITION BY embedding) AS rep FROM embeddings),
l AS (SELECT a.vec_id AS i, a.rep AS ra, b.rep AS rb FROM k a JOIN k b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.x, b.x) >= {COSINE}),
w AS (SELECT DISTINCT ra AS node, ra AS root FROM l UNION SELECT w.node, l.rb FROM w JOIN l ON l.ra = w.root),
c AS (SELECT node, min(root) AS class_id FROM w GROUP BY 1)
SELECT i AS vec_id, class_id, count(*) AS n_links FROM l JOIN c ON node = ra GROUP BY 1, 2
"""
