"""Texts as words with character offsets; HTML as text runs with the depth of skipped elements.

All of it happens within a row, so texts are never shuffled. Results carry doc_id and key, the hash of doc_id and text: rows of
one doc_id with different texts stay apart, rows that are wholly equal count as one document, and a null doc_id is an id."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.functions.text import LETTER, PIECE

TAGS = r"(?s)(<!--.*?-->|<[^>]*>|[^<]+|<)"
SKIPPED = ("head", "style", "title", "script", "xmp", "iframe", "code", "math", "svg", "sup", "a")  # and h1, h2, ...; span.nolink apart
_SKIP = "(?:" + "|".join(SKIPPED) + "|h[0-9]+)"
_BLOCK = 24
_IDS = 1_000_000  # most ids that are broadcast


def doc_keys(df: DataFrame) -> list[str]:
    return [c for c in ("doc_id", "key") if c in df.columns]


def doc_key(text: str) -> Column:
    return F.xxhash64("doc_id", text)


def repeated(docs: DataFrame) -> DataFrame | None:
    """(doc_id) of those that docs have more than once, or None if there are none."""
    again = docs.groupBy("doc_id").count().filter("count > 1").select("doc_id")
    n = again.count()
    return None if n == 0 else F.broadcast(again) if n <= _IDS else again


def distinct(rows: DataFrame, again: DataFrame | None) -> DataFrame:
    """The distinct ones of rows, of which only those of doc_ids in `again` can be equal; no others are shuffled."""
    if again is None:
        return rows
    ids = again.select(F.col("doc_id").alias("_again"))
    same = rows["doc_id"].eqNullSafe(ids["_again"])
    return rows.join(ids, same, "left_anti").unionByName(rows.join(ids, same, "left_semi").distinct())


def once(docs: DataFrame) -> DataFrame:
    """docs without repeats of wholly equal rows."""
    return distinct(docs, repeated(docs))


def running(items: str, state: str, zero: Column, step: Callable[[Column, Column], Column]) -> Column:
    """The states (of type `state`) before each element of the array column `items`, and after the last.

    Appending to an array copies its references, so states are gathered in blocks, which keeps long arrays near linear. A block
    begins with the last state of the one before.
    """
    n = F.size(items)

    def block(done: Column, start: Column) -> Column:
        places = F.sequence(start, F.least(start + _BLOCK, n) - 1)
        first = F.array(F.element_at(F.element_at(done, -1), -1))
        return F.array_append(done, F.aggregate(places, first, lambda out, i: F.array_append(out, step(F.element_at(out, -1), F.get(items, i)))))

    first = F.array(F.array(zero.cast(state)))
    whole = lambda done: F.concat(
        F.flatten(F.transform(done, lambda b: F.slice(b, 1, F.size(b) - 1))), F.array(F.element_at(F.element_at(done, -1), -1))
    )
    return F.when(n > 0, F.aggregate(F.sequence(F.lit(0), n - 1, F.lit(_BLOCK)), first, block, whole)).otherwise(F.array(zero.cast(state)))


def words(texts: DataFrame, ahead: int = 0) -> DataFrame:
    """texts (doc_id[, key], offset, text) as one row for each word: doc_id[, key], offset_begin, offset_end, word, and the `ahead`
    next words as n1, n2, ... with their ends e1, e2, ...; null from where more than white space lies between. Offsets are of
    characters, counted from `offset`. Null and empty texts have no words."""
    keys = doc_keys(texts)
    parts = texts.select(*keys, "offset", F.regexp_extract_all("text", F.lit(PIECE), F.lit(0)).alias("p"))
    parts = parts.withColumn("at", running("p", "int", F.col("offset"), lambda at, x: at + F.length(x)))
    piece = lambda i: F.get("p", i)

    def one(i: Column) -> Column:
        fields = [F.get("at", i).alias("offset_begin"), F.get("at", i + 1).alias("offset_end"), piece(i).alias("word")]
        whole = F.lit(True)
        for k in range(1, ahead + 1):
            gap = piece(i + (2 * k - 1))  # pieces alternate between words and gaps
            whole = whole & ((gap == " ") | gap.rlike(r"^\s+$"))
            fields += [F.when(whole, piece(i + 2 * k)).alias(f"n{k}"), F.when(whole & (F.size("p") > i + 2 * k), F.get("at", i + (2 * k + 1))).alias(f"e{k}")]
        return F.struct(*fields)

    first = F.when(piece(F.lit(0)).rlike(f"^{LETTER}"), 0).otherwise(1)
    places = F.when(F.size("p") > first, F.sequence(first, F.size("p") - 1, F.lit(2)))
    return parts.select(*keys, F.inline(F.transform(places, one)))


def text_runs(texts: DataFrame) -> DataFrame:
    """(doc_id, key, offset, text) from whole texts: one run each, at 0."""
    return texts.select("doc_id", doc_key("text").alias("key"), F.lit(0).alias("offset"), F.coalesce("text", F.lit("")).alias("text"))


def _delta(piece: Column) -> Column:
    """+1 for the start of a skipped element, -1 for its end."""
    start = piece.rlike(f"^<{_SKIP}(?:[\\s/>])") & ~piece.endswith("/>")
    return F.when(start, 1).when(piece.rlike(f"^</{_SKIP}\\s*>"), -1).otherwise(0)


def _parsed(pages: DataFrame) -> DataFrame:
    """pages (doc_id, html) with key, and what segments() needs. Filters on what is computed here, and generators of its columns,
    would be moved below it and compute it once more for each use; generators of expressions stay where they are."""
    p = pages.select("doc_id", doc_key("html").alias("key"), F.regexp_extract_all("html", F.lit(TAGS), F.lit(1)).alias("p"))

    def marks(x: Column) -> Column:
        opens = x.rlike(r"^<span[\s>]") & ~x.endswith("/>")
        span = F.when(opens, 1).when(x.rlike(r"^</span\s*>"), -1).otherwise(0)
        tag = F.struct(F.length(x).alias("n"), _delta(x).alias("skip"), span.alias("span"), (opens & x.rlike(r"class\s*=\s*[\"']?[^\"'>]*\bnolink\b")).alias("nolink"))
        text = F.struct(F.length(x).alias("n"), F.lit(0).alias("skip"), F.lit(0).alias("span"), F.lit(False).alias("nolink"))
        return F.when(x.startswith("<"), tag).otherwise(text)

    p = p.withColumn("m", F.transform("p", marks))
    state = "struct<offset:int,skip:int,spans:int,since:int>"  # since: the level of the outermost open nolink span, or 0

    def step(s: Column, m: Column) -> Column:
        level = s["spans"] + m["span"]
        since = F.when((s["since"] > 0) & (level >= s["since"]), s["since"]).when(m["nolink"], level).otherwise(0)
        return F.struct((s["offset"] + m["n"]).alias("offset"), (s["skip"] + m["skip"]).alias("skip"), level.alias("spans"), since.alias("since"))

    zero = F.struct(*[F.lit(0).alias(c) for c in ("offset", "skip", "spans", "since")])
    return p.withColumn("s", running("m", state, zero, step))


def _segments() -> Column:
    """Of a row of _parsed(): an array of (offset, piece, depth)."""
    inside = lambda i: F.when(F.get("s", i + 1)["since"] > 0, 1).otherwise(0)
    segment = lambda x, i: F.struct(F.get("s", i)["offset"].alias("offset"), x.alias("piece"), (F.get("s", i + 1)["skip"] + inside(i)).alias("depth"))
    return F.transform("p", segment)


def html_segments(pages: DataFrame) -> DataFrame:
    """pages (doc_id, html) as tags, comments and text runs: doc_id, key, pos, offset, piece, depth. depth counts open
    skipped elements; it starts at 0 in each page. A span of class nolink is skipped until its own end: spans are counted,
    and a span is inside while the count is at least that of the outermost open nolink span. Entities aren't decoded. A null or empty
    page has no segments."""
    return _parsed(pages).select("doc_id", "key", F.posexplode(_segments()).alias("pos", "s")).select("doc_id", "key", "pos", "s.offset", "s.piece", "s.depth")


def _is_run(piece: Column, depth: Column) -> Column:
    return ~piece.startswith("<") & (depth == 0) & piece.rlike(LETTER)


def html_runs(pages: DataFrame) -> DataFrame:
    """(doc_id, key, offset, text) of all text runs outside skipped elements that hold a word character."""
    return html_segments(pages).filter(_is_run(F.col("piece"), F.col("depth"))).select("doc_id", "key", "offset", F.col("piece").alias("text"))


def text_length(pages: DataFrame) -> DataFrame:
    """(doc_id, text_length) for each of pages with text: the characters of its runs."""
    p = _parsed(pages).withColumn("runs", F.filter(_segments(), lambda s: _is_run(s["piece"], s["depth"])))
    total = F.aggregate("runs", F.lit(0).cast("long"), lambda n, s: n + F.length(s["piece"]))
    return p.select("doc_id", F.inline(F.when(F.size("runs") > 0, F.array(F.struct(total.alias("text_length"))))))
