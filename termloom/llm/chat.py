"""Chat formatting in budgeted windows."""

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUDGET = 512  # tokens of a window
HISTORY = 128  # tokens of earlier turns that a window repeats at most
TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"
SPAN = "array<struct<history:int,first:int,last:int>>"


def token_count(text: Column, tokenizer: str | None = None) -> Column:
    """Words and marks; or the ids of a tokenizer file (JSON of the tokenizers library), whose path all executors can read."""
    if tokenizer is None:
        return F.regexp_count(text, F.lit(TOKEN)).cast("int")

    @F.pandas_udf("int")
    def count(texts: pd.Series) -> pd.Series:
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(tokenizer)
        t.encode_special_tokens = True
        return pd.Series([len(x.ids) for x in t.encode_batch(texts.tolist(), add_special_tokens=False)], dtype="int32")

    return count(text)


def spans(tokens: np.ndarray, system: int, budget: int, history: int) -> list[tuple[int, int, int]]:
    """(first turn repeated, first new turn, end) of each window, over prefix sums p of the turns' tokens.

    From new turn i, the history begins at the least a with p[i] - p[a] <= history, and the window ends at the largest e
    with system + p[e] - p[a] <= budget. If not even turn i fits, history gives way turn by turn; a turn that doesn't fit
    alone is a window of its own.
    """
    p = np.concatenate([[0], np.cumsum(tokens)])
    out, i, n = [], 0, len(tokens)
    while i < n:
        a = max(int(np.searchsorted(p, p[i] - history)), 0)
        a = min(max(a, int(np.searchsorted(p, system + p[i + 1] - budget))), i)
        e = max(int(np.searchsorted(p, budget - system + p[a], side="right")) - 1, i + 1)
        out.append((a, i, e))
        i = e
    return out


def windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY, tokenizer: str | None = None) -> DataFrame:
    """One row for each window of each conversation: conv_id, window_id (from 0), first_turn and last_turn (its new turns, counted
    from 0 without system turns), n_history (turns repeated), n_tokens, n_target_tokens, oversize, text and mask.

    A window holds all system turns of the conversation, then history, then new turns, whole turns always, in order of turn (null
    first; ties by role and text); see spans(). text has a line <|role|> before each turn's text; mask has a character for
    each turn of text: 1 where it is a target, that is, a new assistant turn, so a repeated turn is never trained on
    twice. oversize tells that n_tokens > budget, which only one turn with the system turns can do. A conversation of
    system turns alone has one window without targets.

    Null texts are empty, a null role is 'unknown', repeated rows are turns like others; rows with a null conv_id belong to no
    conversation and are left out; other columns aren't read. One shuffle, by conv_id; Python sees token counts only.
    """
    rows = conversations.filter("conv_id is not null").select("conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("n", token_count(F.col("text"), tokenizer))
    turn = F.struct(F.col("turn").isNotNull().alias("k"), "turn", "role", "text", "n")
    one = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("all"))
    one = one.select("conv_id", F.filter("all", lambda x: x["role"] == "system").alias("system"), F.filter("all", lambda x: x["role"] != "system").alias("turns"))
    total = lambda c: F.aggregate(c, F.lit(0), lambda s, x: s + x["n"])
    one = one.withColumn("head", total(F.col("system")))

    @F.pandas_udf(SPAN)
    def cutting(tokens: pd.Series, system: pd.Series) -> pd.Series:
        out = [[{"history": a, "first": i, "last": e - 1} for a, i, e in spans(np.asarray(t, np.int64), int(s), budget, history)] for t, s in zip(tokens, system)]
        return pd.Series([x or [{"history": 0, "first": 0, "last": -1}] for x in out])

    cuts = one.withColumn("spans", cutting(F.transform("turns", lambda x: x["n"]), F.col("head")))
    w = cuts.select("conv_id", "system", "turns", "head", F.posexplode("spans").alias("window_id", "w"))
    body = F.slice("turns", F.col("w.history") + 1, F.col("w.last") - F.col("w.history") + 1)
    w = w.withColumn("body", F.when(F.col("w.last") >= 0, body).otherwise(F.slice("turns", 1, 0)))
    w = w.withColumn("n_history", F.col("w.first") - F.col("w.history")).withColumn("parts", F.concat("system", "body"))
    target = lambda x, i: (x["role"] == "assistant") & (i >= F.col("n_history"))
    flags = F.transform("body", lambda x, i: F.when(target(x, i), x["n"]).otherwise(F.lit(-1)))
    w = w.withColumn("flags", flags).withColumn("n_tokens", F.col("head") + total(F.col("body")))
    return w.select(
        "conv_id",
        "window_id",
        F.col("w.first").alias("first_turn"),
        F.col("w.last").alias("last_turn"),
        "n_history",
        "n_tokens",
        F.aggregate("flags", F.lit(0), lambda s, x: s + F.greatest(x, F.lit(0))).alias("n_target_tokens"),
        (F.col("n_tokens") > budget).alias("oversize"),
        F.array_join(F.transform("parts", lambda x: F.concat(F.lit("<|"), x["role"], F.lit("|>\n"), x["text"], F.lit("\n"))), "").alias("text"),
        F.concat(F.repeat(F.lit("0"), F.size("system")), F.array_join(F.transform("flags", lambda x: F.when(x >= 0, "1").otherwise("0")), "")).alias("mask"),
    )


ORACLE = rf"""
WITH RECURSIVE t AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
n AS (SELECT *, CAST(len(regexp_extract_all(text, '{TOKEN}')) AS BIGINT) AS n FROM t),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k FROM n WHERE role <> 'system'),
s AS (SELECT conv_id, CAST(sum(n) AS BIGINT) AS head, count(*) AS c, string_agg('<|system|>' || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, text) AS x FROM n WHERE role = 'system' GROUP BY 1),
g AS (SELECT conv_id, coalesce(max(head), 0) AS head, coalesce(max(c), 0) AS c, coalesce(max(x), '') AS x FROM (SELECT DISTINCT conv_id FROM n) LEFT JOIN s USING (conv_id) GROUP BY 1),
p AS (SELECT conv_id, k, CAST(sum(n) OVER (PARTITION BY conv_id ORDER BY k) AS BIGINT) AS p FROM o UNION ALL SELECT conv_id, 0, 0 FROM g),
l AS (SELECT conv_id, list(p ORDER BY k) AS p FROM p GROUP BY 1),
b AS (SELECT conv_id, head, c, x, p, len(p) - 1 AS m FROM g JOIN l USING (conv_id)),
w AS (
  SELECT conv_id, -1 AS window_id, CAST(0 AS BIGINT) AS a, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS e FROM b
  UNION ALL
  SELECT conv_id, window_id + 1, a, i, greatest(len(list_filter(p, lambda y: y <= {BUDGET} - head + p[a + 1])) - 1, i + 1) FROM (
    SELECT w.conv_id, window_id, p, head, w.e AS i, least(greatest(
      len(list_filter(p, lambda y: y < p[w.e + 1] - {HISTORY})), len(list_filter(p, lambda y: y < head + p[w.e + 2] - {BUDGET}))), w.e) AS a
    FROM w JOIN b USING (conv_id) WHERE w.e < m)),
v AS (SELECT * FROM w WHERE window_id >= 0 UNION ALL SELECT conv_id, 0, 0, 0, 0 FROM b WHERE m = 0)
SELECT v.conv_id, CAST(window_id AS INTEGER) AS window_id, CAST(v.i AS INTEGER) AS first_turn, CAST(v.e - 1 AS INTEGER) AS last_turn,
  CAST(v.i - v.a AS INTEGER) AS n_history, CAST(b.head + p[v.e + 1] - p[v.a + 1] AS INTEGER) AS n_tokens,
  CAST(coalesce(sum(o.n) FILTER (o.role = 'assistant' AND o.k > v.i), 0) AS INTEGER) AS n_target_tokens,
  b.head + p[v.e + 1] - p[v.a + 1] > {BUDGET} AS oversize,
  b.x || coalesce(string_agg('<|' || o.role || '|>' || chr(10) || o.text || chr(10), '' ORDER BY o.k), '') AS text,
  repeat('0', CAST(b.c AS BIGINT)) || coalesce(string_agg(CASE WHEN o.role = 'assistant' AND o.k > v.i THEN '1' ELSE '0' END, '' ORDER BY o.k), '') AS mask
FROM v JOIN b USING (conv_id) LEFT JOIN o ON o.conv_id = v.conv_id AND o.k > v.a AND o.k <= v.e
GROUP BY v.conv_id, window_id, v.a, v.i, v.e, b.head, b.c, b.x, b.p
"""
