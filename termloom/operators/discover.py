"""Dictionary concepts in texts: longest phrase at each word, greedy from left to right, merged and filtered.

Texts stay where they are. Spans of phrases, small rows, are gathered once for each document; everything after that is by
document and keeps that partitioning."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from termloom.functions.classes import stop_words
from termloom.functions.text import canonical_url, concept_of, normalised
from termloom.operators.segment import doc_keys, running, words

BROADCAST_BYTES = 256 << 20  # most bytes of a dictionary that is broadcast; a larger one is joined by a shuffle
CONCEPT = ("conceptid", "firstword", "tailwords", "category", "scheme", "domain", "link", "objectid")
_STOP = ", ".join("'" + w.replace("'", "\\'") + "'" for w in stop_words())


def _bytes(df: DataFrame) -> Column:
    return F.sum(F.octet_length(F.concat_ws("", *df.columns)) + 16 * len(df.columns))


def side(df: DataFrame, size: int | None = None) -> DataFrame:
    """df for a join, marked for broadcast if its size (counted unless given) allows."""
    if size is None:
        size = df.agg(_bytes(df)).first()[0] or 0
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def stop_filter(tokens: DataFrame, column: str = "word") -> DataFrame:
    """tokens whose lower-cased raw word is no stop word; the list is tested before any normalisation. A null word stays."""
    return tokens.filter(F.expr(f"coalesce(lower(`{column}`) not in ({_STOP}), true)"))


def probe(tokens: DataFrame, concepts: DataFrame, domain: str | None = None) -> DataFrame:
    """tokens (with word) and the concepts of the same normalised first word, optionally of one domain."""
    c = domain_filter(concepts.select(*CONCEPT), domain)
    keyed = normalised(tokens, norm="word")
    return keyed.join(side(c), F.col("norm") == F.col("firstword")).drop("norm")


def phrases(concepts: DataFrame) -> DataFrame:
    """concepts with phrase (first word and tail, single blanks) and n_words."""
    phrase = F.regexp_replace(F.trim(concept_of(F.col("firstword"), F.col("tailwords"))), r"\s+", " ")
    return concepts.select(*CONCEPT).withColumn("phrase", phrase).withColumn("n_words", F.size(F.split("phrase", " "))).filter("phrase <> ''")


def spans(runs: DataFrame, concepts: DataFrame) -> DataFrame:
    """Dictionary phrases in runs (doc_id, key, offset, text): doc_id, key, offset_begin, offset_end, n_words, phrase.

    A phrase of k words matches k normalised words with white space only between them, the first no stop word. Words
    that normalise to nothing (determiners) end a phrase. Words are cut down to those that begin some concept before any
    phrase is made, by a join with the distinct first words, which also tell how long their phrases get.
    """
    keys = doc_keys(runs)
    known = phrases(concepts).select("phrase", "n_words").distinct()
    # concepts change rarely and are small beside texts: their size decides how they're joined and how far to look ahead
    size = known.agg(_bytes(known).alias("bytes"), F.max("n_words").alias("words")).first()
    longest = size.words or 1
    firsts = known.groupBy(F.split("phrase", " ")[0].alias("first")).agg(F.max("n_words").alias("most"))
    t = normalised(stop_filter(words(runs, longest - 1)), w1="word")
    t = t.join(side(firsts, size.bytes or 0), F.col("w1") == F.col("first"))
    t = normalised(t, **{f"w{k + 1}": f"n{k}" for k in range(1, longest)})
    options, phrase, ok = [F.struct(F.col("offset_end").alias("end"), F.col("w1").alias("phrase"))], F.col("w1"), F.lit(True)
    for k in range(1, longest):
        ok = ok & (F.col(f"w{k + 1}") != "") & (F.col("most") > k)
        phrase = F.concat_ws(" ", phrase, F.col(f"w{k + 1}"))
        options.append(F.when(ok, F.struct(F.col(f"e{k}").alias("end"), phrase.alias("phrase"))))
    t = t.select(*keys, "offset_begin", F.explode(F.array(*options)).alias("x"))
    t = t.select(*keys, "offset_begin", F.col("x.end").alias("offset_end"), F.col("x.phrase").alias("phrase"))
    return t.join(side(known, size.bytes or 0), "phrase").select(*keys, "offset_begin", "offset_end", "n_words", "phrase")


def longest(found: DataFrame) -> DataFrame:
    """Of the spans that begin at one place, the one of the most words."""
    top = F.max("n_words").over(Window.partitionBy(*doc_keys(found), "offset_begin"))
    return found.withColumn("top", top).filter("n_words = top").drop("top").distinct()


def greedy(found: DataFrame) -> DataFrame:
    """Spans that remain when they are taken from left to right, each beginning at or after the former's end, and the longest
    first at each place.

    The one exchange of the plan: spans are gathered by document as sets, on the map side first, so rows that repeat a whole
    document add nothing. A running maximum of ends over the sorted set tells which ones stay; it is linear.
    """
    keys = doc_keys(found)
    one = F.struct("offset_begin", (-F.col("n_words")).alias("n"), "offset_end", "phrase")
    docs = found.groupBy(*keys).agg(F.sort_array(F.collect_set(one)).alias("s"))
    free = docs.withColumn("free", running("s", "int", F.lit(0), lambda at, s: F.when(s["offset_begin"] >= at, s["offset_end"]).otherwise(at)))
    kept = F.filter("s", lambda s, i: s["offset_begin"] >= F.get("free", i))
    return free.select(*keys, F.inline(kept)).select(*keys, "offset_begin", "offset_end", (-F.col("n")).alias("n_words"), "phrase")


def with_concepts(found: DataFrame, concepts: DataFrame) -> DataFrame:
    """found (with phrase) and the concepts of that phrase: doc_id, key, offset_begin, offset_end, n_words, concept (the phrase) and
    concept columns, and multilinks if concepts are merged()."""
    more = [c for c in ("multilinks",) if c in concepts.columns]
    known = concepts.select("phrase", *CONCEPT, *more) if "phrase" in concepts.columns else phrases(concepts).drop("n_words")
    return found.join(side(known), "phrase").select(*doc_keys(found), "offset_begin", "offset_end", "n_words", F.col("phrase").alias("concept"), *CONCEPT, *more)


def candidates(runs: DataFrame, concepts: DataFrame) -> DataFrame:
    """All matches of dictionary phrases in runs, with their concepts."""
    return with_concepts(spans(runs, concepts), concepts)


def merged(concepts: DataFrame) -> DataFrame:
    """concepts of equal phrase, category and domain as one: the one of the smallest conceptid, with multilinks, the links
    of all in order of conceptid, if there are two or more. As a span has one phrase, this merges matches before they are made."""
    rest = [c for c in CONCEPT if c not in ("category", "domain", "conceptid")]
    rows = F.sort_array(F.collect_list(F.struct("conceptid", *rest)))
    g = phrases(concepts).groupBy("phrase", "category", "domain").agg(rows.alias("rows"))
    links = F.when(F.size("rows") > 1, F.transform("rows", lambda r: r["link"]))
    own = {c: F.col("rows")[0][c] for c in ("conceptid", *rest)} | {c: F.col(c) for c in ("category", "domain")}
    return g.select("phrase", *[own[c].alias(c) for c in CONCEPT], links.alias("multilinks"))


def first_occurrences(matches: DataFrame) -> DataFrame:
    """The first match of each (concept, link, category) of a document."""
    w = Window.partitionBy(*doc_keys(matches), "concept", "link", "category").orderBy("offset_begin", "conceptid")
    return matches.withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")


def without_self_links(matches: DataFrame, urls: DataFrame, concepts: DataFrame | None = None) -> DataFrame:
    """matches whose link isn't their document's url (doc_id[, key], url); both in canonical form. Documents without a url keep all.
    Given the concepts that matches are of, only the documents whose url is some concept's link are looked at; these are as few as
    links, so matches aren't shuffled."""
    keys = [c for c in doc_keys(matches) if c in urls.columns]
    own = urls.select(*[F.col(k).alias(f"_{k}") for k in keys], canonical_url(F.col("url")).alias("own")).distinct()
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    if concepts is not None:
        links = concepts.select("link", canonical_url(F.col("link")).alias("own")).dropna().distinct()
        own = own.join(side(links), "own").withColumnRenamed("link", "_link")
        return matches.join(side(own), [*same, F.col("link") == F.col("_link")], "left_anti").select(*matches.columns)
    both = matches.join(own, same, "left")
    kept = both.filter(F.col("own").isNull() | F.col("link").isNull() | (canonical_url(F.col("link")) != F.col("own")))
    return kept.select(*matches.columns)


def domain_filter(matches: DataFrame, domain: str | None) -> DataFrame:
    """Matches of a domain; all if it is empty or 'all'. Applied after disambiguation, to which all domains contribute."""
    return matches if not domain or domain.lower() == "all" else matches.filter(F.col("domain") == domain)


def discover(runs: DataFrame, concepts: DataFrame, urls: DataFrame | None = None, found: DataFrame | None = None) -> DataFrame:
    """Matches of concepts in runs: longest, greedy (found, if these are known), merged, without self links, first occurrences."""
    m = with_concepts(greedy(spans(runs, concepts)) if found is None else found, merged(concepts))
    return first_occurrences(without_self_links(m, urls, concepts) if urls is not None else m)


def edges(matches: DataFrame, objects: DataFrame) -> DataFrame:
    """(objectid, conceptid) of documents that are objects (doc_id, objectid), for the links cache; before disambiguation."""
    own = objects.select("doc_id", F.col("objectid").alias("from"))
    return matches.join(own, "doc_id").select(F.col("from").alias("objectid"), "conceptid").distinct()
