"""Licence scan: sparse TF-IDF cosine of lines to licence templates, then inheritance from the nearest ancestor directory."""

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.llm import _vec
from termloom.llm._io import cut

COSINE = 0.6  # least cosine of a line with a template
SLOTS = 1 << 18  # hashed words whose document frequencies are counted
SMOOTH = 0.001  # share of documents added to a word's own, so that weights of rare words don't grow with the table
FILE_SHARE = 0.9  # share of a text's words in licence lines from which it is a licence file of its directory
FILE_NAMES = r"(?i)(?:^|/)(?:licen[cs]e|copying|unlicense)(?:[._-](?:md|txt|rst|html?|mit|apache|bsd|gpl|lgpl|agpl|mpl|[0-9.]+))*$"  # or by its name
GENERIC = "proprietary"  # its sentence stands in files of all licences too: any other licence goes before it
SPDX = re.compile(r"SPDX-License-Identifier:[ \t]*([A-Za-z0-9.+-]+)")

TEMPLATES = (  # (licence, header or sentence of its file)
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution NonCommercial 4.0 International License."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("proprietary", "All rights reserved."),
)
SCHEMA = "path string, own string, cosine double, line int, share double"


def _vocabulary(templates: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted word hashes of all templates, and their counts (words x templates)."""
    h, at = _vec.words(pa.array([x[1] for x in templates]), _vec.tables())
    names, word = np.unique(h, return_inverse=True)
    tf = np.zeros((len(names), len(templates)))
    np.add.at(tf, (word, np.repeat(np.arange(len(templates)), np.diff(at))), 1)
    return names, tf, np.diff(at)


def _slots(h: np.ndarray, names: np.ndarray) -> np.ndarray:
    """Place of each hash in names, or -1."""
    near = np.zeros(1 << 16, bool)
    near[(names >> np.uint64(48)).astype(np.int64)] = True
    out = np.full(len(h), -1)
    k = np.flatnonzero(near[(h >> np.uint64(48)).astype(np.int64)])
    at = np.minimum(np.searchsorted(names, h[k]), len(names) - 1)
    out[k] = np.where(names[at] == h[k], at, -1)
    return out


def _hashed(h: np.ndarray) -> np.ndarray:
    return (h & np.uint64(SLOTS - 1)).astype(np.int64)


def idf(texts: DataFrame) -> np.ndarray:
    """log(1 + 1 / (share of the texts with the word + SMOOTH)) of each hashed word. Shares decide, so the weights of a table and
    of many such tables together are the same."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, df, n = _vec.tables(), np.zeros(SLOTS, np.int64), 0
        for batch in batches:
            for lo, hi in _vec.pieces(batch.column("text")):
                h, at = _vec.words(batch.column("text").slice(lo, hi - lo), t)
                key = np.unique(np.repeat(np.arange(hi - lo), np.diff(at)) * SLOTS + _hashed(h))
                df += np.bincount(key % SLOTS, minlength=SLOTS)
                n += hi - lo
        k = np.flatnonzero(df)
        yield pa.RecordBatch.from_pydict({"k": np.concatenate([[-1], k]).astype(np.int32), "n": np.concatenate([[n], df[k]])})

    rows = texts.select("text").mapInArrow(_vec.lean(run), "k int, n long").groupBy("k").agg(F.sum("n").alias("n")).toArrow()
    n = np.zeros(1 + SLOTS)
    n[rows["k"].to_numpy() + 1] = rows["n"].to_numpy()
    return np.log(1 + 1 / (n[1:] / max(n[0], 1) + SMOOTH))


def own_licenses(texts: DataFrame, templates: tuple = TEMPLATES, cosine: float = COSINE) -> DataFrame:
    """(path, own, cosine, line, share) for each row of texts (path, text): the licence of the first SPDX tag, else of the line that is
    nearest to a template (the first of equal ones; GENERIC only if there is no other), the line's number from 0, and the share of the text's words in licence lines."""
    weights = texts.sparkSession.sparkContext.broadcast(idf(texts))
    names, tf, _ = _vocabulary(templates)
    weight = weights.value[_hashed(names)]
    model = tf * weight[:, None]
    model /= np.maximum(np.linalg.norm(model, axis=0), 1e-12)
    labels = [x[0] for x in templates]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _vec.tables()
        for batch in batches:
            for lo, hi in _vec.pieces(batch.column("text")):
                part = batch.column("text").slice(lo, hi - lo)
                h, at = _vec.words(part, t)
                b, off = _vec.raw(part)
                s, _ = _vec.spans(b, t)
                text = np.repeat(np.arange(hi - lo), np.diff(at))
                breaks = np.cumsum(b == 10)
                line = breaks[s] + text if len(s) else np.zeros(0, np.int64)  # rises from text to text, and at each line break
                k = _slots(h, names)
                hit = np.flatnonzero(k >= 0)
                best = {}
                shares = np.zeros(hi - lo)
                if len(hit):
                    # a line's norm is at least that of its words taken as all distinct: most lines can't reach the cosine
                    uniq, where = np.unique(line[hit], return_inverse=True)
                    dot = np.stack([np.bincount(where, weights=weight[k[hit]] * model[k[hit], c]) for c in range(len(labels))], 1)
                    first, last = np.searchsorted(line, uniq), np.searchsorted(line, uniq, side="right")
                    total = np.concatenate([[0], np.cumsum(weights.value[_hashed(h)] ** 2)])
                    norm = np.sqrt(total[last] - total[first])
                    most = np.flatnonzero(dot.max(1) >= cosine * norm - 1e-9)
                    for u in most.tolist():
                        a, z = int(first[u]), int(last[u])
                        word, n = np.unique(h[a:z], return_counts=True)
                        w = weights.value[_hashed(word)] * n
                        c = dot[u] / max(float(np.sqrt((w * w).sum())), 1e-12)
                        d = int(text[a])
                        if c.max() >= cosine:
                            shares[d] += (z - a) / (at[d + 1] - at[d])
                            at_line = int(uniq[u]) - d - (int(breaks[off[d] - 1]) if off[d] else 0)
                            rank = (labels[int(c.argmax())] != GENERIC, float(c.max()))
                            if d not in best or rank > (best[d][0] != GENERIC, best[d][1] + 1e-9):
                                best[d] = (labels[int(c.argmax())], float(c.max()), at_line)
                for d in np.flatnonzero(pc.fill_null(pc.match_substring(part, "SPDX-License-Identifier:"), False).to_numpy(zero_copy_only=False)).tolist():
                    whole = part[d].as_py()
                    if m := SPDX.search(whole):  # a tag is the plainest statement
                        best[d] = (m.group(1), 1.0, whole.count("\n", 0, m.start()))
                got = [best.get(d, (None, None, None)) for d in range(hi - lo)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("path").slice(lo, hi - lo), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array([g[2] for g in got], pa.int32()), pa.array(shares)],
                    names=["path", "own", "cosine", "line", "share"],
                )

    return texts.select("path", "text").mapInArrow(_vec.lean(run), SCHEMA)


def directory(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def scan(texts: DataFrame, templates: tuple = TEMPLATES, cosine: float = COSINE) -> DataFrame:
    """(path, license, how, cosine, line, inherited_from) for each row of texts (path, text).

    how is 'header' if a line of the text has a cosine of at least `cosine` with a template; else 'inherited' from the
    nearest ancestor directory (the text's own first, the root '' last) that holds a licence file; else 'none'. A
    licence file is a text with a licence line whose name is one of FILE_NAMES or of whose words FILE_SHARE are in
    licence lines. Of several in a directory the highest cosine counts, then the smallest path.

    Weights are counted over all texts. Null and empty texts have no header but inherit; a null path inherits nothing; a
    path without '/' lies in the root; repeated rows give repeated results; other columns aren't read. Texts aren't
    shuffled: directories with their ancestors are joined first, each directory once, and paths join their directory.
    """
    own = cut(own_licenses(texts, templates, cosine))
    files = own.filter(F.col("own").isNotNull() & F.col("path").isNotNull() & (F.col("path").rlike(FILE_NAMES) | (F.col("share") >= FILE_SHARE)))
    held = files.groupBy(directory(F.col("path")).alias("from")).agg(F.min(F.struct((-F.col("cosine")).alias("c"), "path", "own")).alias("x")).select("from", "x.own")
    needed = own.filter(F.col("own").isNull() & F.col("path").isNotNull()).select(directory(F.col("path")).alias("dir")).distinct()
    parts = F.split("dir", "/")
    up = needed.select("dir", F.explode(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("from")).distinct()
    near = up.join(held, "from").groupBy("dir").agg(F.max_by(F.struct("from", "own"), F.length("from")).alias("x"))
    near = near.select("dir", F.col("x.own").alias("theirs"), F.col("x.from").alias("inherited_from"))
    out = own.withColumn("dir", F.when(F.col("own").isNull(), directory(F.col("path")))).join(near, "dir", "left")
    how = F.when(F.col("own").isNotNull(), "header").when(F.col("theirs").isNotNull(), "inherited").otherwise("none")
    return out.select("path", F.coalesce("own", "theirs").alias("license"), how.alias("how"), "cosine", "line", "inherited_from")


def documents_as_files(docs: DataFrame) -> DataFrame:
    """documents as texts with paths: <source>/<lang>/<doc_id>, a null part being 'unknown'."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("unknown"))
    return docs.select("doc_id", F.concat_ws("/", part("source"), part("lang"), part("doc_id")).alias("path"), "text")


def scan_documents(docs: DataFrame) -> DataFrame:
    """scan() of all documents with their doc_id, which is the path's last part (null if that is 'unknown')."""
    out = scan(documents_as_files(docs))
    return out.select(F.expr("try_cast(element_at(split(path, '/'), -1) as long)").alias("doc_id"), *out.columns)
