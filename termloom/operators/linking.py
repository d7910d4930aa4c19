"""Linking in one pass over the texts: words, phrases and choices of a text are found within its row, in Python over Arrow.

It gives what segment.words(), discover.spans(), greedy() and the later steps give, without a row for each word and without a
shuffle of matches. Words are looked up in a trie of the dictionary's phrases, so time is linear in the texts; what workers hold is
the dictionary, bounded by LEXICON_BYTES, and CHUNK bytes of text with their results. Larger dictionaries are joined instead."""

import re
import unicodedata
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType
from pyspark.sql.window import Window

from termloom.functions.classes import SHORTEST, log_matrix, stop_words
from termloom.functions.text import PLAIN_FROM, PLAIN_LONG, PLAIN_TO
from termloom.operators import annotate, classify, discover
from termloom.operators.segment import doc_keys, text_runs

LEXICON_BYTES = 32 << 20  # most bytes of a dictionary that goes to Python
CHUNK = 1 << 18  # bytes of text whose results are held at once, if a text isn't longer
MEMO = 200_000  # most words whose forms are remembered
_SPACE = " \t\n\x0b\f\r"
_PLAIN = {ord(a): b for a, b in PLAIN_LONG} | {ord(c): PLAIN_TO[k] if k < len(PLAIN_TO) else None for k, c in reversed(list(enumerate(PLAIN_FROM)))}
_TAKEN = re.compile("(.+(?:[aeiuo]x|ch|ss))es|(.+(?:ee|[^eiuos]|[^aeio]e))s", re.DOTALL)
_LEXICONS: dict[str, "_Words"] = {}


@cache
def _kinds() -> np.ndarray:
    """By code point: 4 white space, 2 the letters of functions.text.LETTER, 1 what else is INNER, 0 the rest."""
    kinds = np.fromiter((2 if unicodedata.category(c)[0] in "LMN" else 0 for c in map(chr, range(0x110000))), np.uint8, 0x110000)
    for c, kind in [("_", 2), *((c, 1) for c in "+'-"), *((c, 4) for c in _SPACE)]:
        kinds[ord(c)] = kind
    return kinds


class Tokens:
    """The words (functions.text.WORD) of an array of texts, all at once: row, begin and end in characters of their text, word, and
    linked, whether only white space lies between a word and the next one of its text."""

    def __init__(self, texts: pa.Array) -> None:
        texts = pc.fill_null(texts.cast(pa.string()), "")
        _, offsets, data = texts.buffers()
        own = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1]
        low, high = int(own[0]), int(own[-1])
        raw = data[low:high] if high > low else b""
        points = np.frombuffer(bytes(raw).decode().encode("utf-32-le"), np.uint32)
        ascii_only = len(points) == high - low
        sizes = pc.utf8_length(texts).to_numpy(zero_copy_only=False)
        heads = np.cumsum(np.concatenate(([0], sizes)))[:-1].astype(np.int64)
        kind = _kinds()[points]
        inner = (kind == 1) | (kind == 2)
        edge = np.zeros(len(points) + 1, bool)  # where a text begins
        edge[heads] = edge[-1] = True
        before = np.concatenate(([0], kind[:-1])) if len(kind) else kind
        letter = kind == 2
        start = letter & (((before != 1) & (before != 2)) | edge[:-1])
        # a letter after marks of INNER begins a word if no letter is before these
        late = np.flatnonzero(letter & (before == 1) & ~edge[:-1])
        if len(late):
            other = np.flatnonzero(kind != 1)
            at = np.searchsorted(other, late) - 1
            last = np.where(at >= 0, other[np.maximum(at, 0)], -1)
            start[late] = (last < heads[np.searchsorted(heads, late, "right") - 1]) | (kind[last] != 2)
        begins = np.flatnonzero(start)
        stops = np.flatnonzero(inner & (np.concatenate((~inner[1:], [True])) | edge[1:])) + 1 if len(inner) else begins
        ends = stops[np.searchsorted(stops, begins, "right")] if len(begins) else begins
        self.row = np.searchsorted(heads, begins, "right") - 1
        self.begin, self.end = (begins - heads[self.row]).astype(np.int32), (ends - heads[self.row]).astype(np.int32)
        solid = np.concatenate(([0], np.cumsum(kind != 4)))
        self.linked = np.zeros(len(begins), bool)
        if len(begins):
            self.linked[:-1] = (self.row[1:] == self.row[:-1]) & (solid[begins[1:]] == solid[ends[:-1]])
        if ascii_only:
            places = np.stack((begins, ends), 1).ravel() + low
        else:
            width = np.concatenate(([0], np.cumsum(1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000))))
            places = width[np.stack((begins, ends), 1).ravel()] + low
        parts = pa.StringArray.from_buffers(max(0, len(places) - 1), pa.py_buffer(places.astype(np.int32)), data) if len(places) else pa.array([], pa.string())
        self.word = parts.take(pa.array(np.arange(0, len(parts), 2)))


def normal_word(word: str) -> str:
    """functions.text.normal_word() of a single word."""
    p = word.lower()
    if not word.isascii():
        p = p.translate(_PLAIN)
    if p in ("a", "an", "the"):
        return ""
    if "'" in p:
        p = p[:-2] if p.endswith("'s") else p[:-1] if p.endswith("s'") else p
    if p.endswith("s"):
        if len(p) > 5 and p.endswith("rices"):
            return p[:-3] + "x"
        if len(p) > 5 and p.endswith("tices"):
            return p[:-4] + "ex"
        if len(p) > 3 and p.endswith("ies"):
            return p[:-3] + "y"
        m = _TAKEN.fullmatch(p)
        return (m[1] or m[2]) if m else p
    return p[:-2] + "cus" if len(p) > 3 and p.endswith("oci") else p


class _Memo(dict):
    def __init__(self, f) -> None:  # noqa: ANN001
        self.f = f

    def __missing__(self, key: str) -> Any:
        value = self[key] = self.f(key)
        return value


class _Words:
    """A worker's dictionary: the phrases as a trie whose nodes are numbers, with its edges as sorted keys. Node 0 is none."""

    def __init__(self, phrases: list[str]) -> None:
        nodes: dict[tuple[int, str], int] = {}
        number = [-1]
        for n, phrase in enumerate(phrases):
            at = 0
            for word in phrase.split(" "):
                at = nodes.setdefault((at, word), len(nodes) + 1)
                number += [-1] * (at + 1 - len(number))
            number[at] = n
        self.ids = {w: k for k, w in enumerate(dict.fromkeys(w for _, w in nodes), 1)}
        self.first = np.zeros(len(self.ids) + 1, np.int32)
        edges = []
        for (at, word), to in nodes.items():
            if at:
                edges.append((at * (len(self.ids) + 1) + self.ids[word], to))
            else:
                self.first[self.ids[word]] = to
        self.keys, self.to = np.array(sorted(edges), np.int64).reshape(-1, 2).T.copy()
        self.number = np.array(number, np.int32)
        self.more = np.zeros(len(number), bool)
        self.more[self.keys // (len(self.ids) + 1)] = True
        self.stop = set(stop_words())
        self.rest = _Memo(self._code)
        easy = [*self.ids, *(self.stop - self.ids.keys())]
        self.easy = pa.array(easy, pa.string())
        self.codes = np.array([*map(self._code, easy), 0], np.int64)  # the last: of words that are none of these

    def _code(self, word: str) -> int:
        """Twice the number of a text's word in its normal form, 0 if no phrase has it, and 1 more for a stop word."""
        return 2 * self.ids.get(normal_word(word), 0) + (word.lower() in self.stop)

    def coded(self, words: pa.Array) -> np.ndarray:
        """_code() of each of words. An ASCII word without an ending that normal_word() looks at is its own normal form in lower case."""
        unique = words.dictionary_encode()
        some = unique.dictionary
        if not len(some):
            return np.array([], np.int64)
        _, offsets, data = some.buffers()
        offsets = np.frombuffer(offsets, np.int32)[some.offset : some.offset + len(some) + 1]
        last = np.frombuffer(data, np.uint8)[offsets[1:] - 1]
        hard = np.isin(last, np.frombuffer(b"sSiI'", np.uint8)) | (pc.utf8_length(some).to_numpy() != np.diff(offsets))
        out = self.codes[pc.fill_null(pc.index_in(pc.ascii_lower(some), self.easy), -1).to_numpy()]
        if len(self.rest) > MEMO:
            self.rest.clear()
        out[hard] = np.fromiter(map(self.rest.__getitem__, some.filter(pa.array(hard)).to_pylist()), np.int64, int(hard.sum()))
        return out[unique.indices.to_numpy()]

    def spans(self, texts: pa.Array, how: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The row, begin, end and phrase's number of the longest phrase at each word of texts; how: see found()."""
        t = Tokens(texts)
        known = self.coded(t.word)
        word = known >> 1
        at = np.flatnonzero((known & 1 == 0) & (self.first[word] > 0))
        node = self.first[word[at]]
        best, length = self.number[node], np.ones(len(at), np.int64)
        go = np.flatnonzero(self.more[node])
        node, k = node[go], 1
        while len(go):
            last = at[go] + k - 1
            ok = t.linked[last]
            go, node, last = go[ok], node[ok], last[ok]
            key = node.astype(np.int64) * (len(self.ids) + 1) + word[last + 1]
            place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            ok = self.keys[place] == key
            go, node = go[ok], self.to[place[ok]]
            k += 1
            ends = self.number[node] >= 0
            best[go[ends]], length[go[ends]] = self.number[node[ends]], k
            ok = self.more[node]
            go, node = go[ok], node[ok]
        ok = best >= 0
        at, best, length = at[ok], best[ok], length[ok]
        if how != "longest":
            # only phrases of several words keep others out; those that reach into another are few
            many = np.flatnonzero(length > 1)
            begin, end = at[many], at[many] + length[many]
            out: set[int] = set()
            for k in (np.flatnonzero(begin[1:] < np.maximum.accumulate(end)[:-1]) + 1).tolist():
                former = k - 1
                while former in out:
                    former -= 1
                if begin[k] < end[former]:
                    out.add(k)
            kept = np.ones(len(at), bool)
            kept[many[list(out)]] = False
            reach = np.maximum.accumulate(np.concatenate(([0], np.where(kept & (length > 1), at + length, 0))))[:-1]
            kept &= at >= reach
            at, best, length = at[kept], best[kept], length[kept]
            if how == "first":
                _, own = np.unique(t.row[at] * np.int64(len(self.number)) + best, return_index=True)
                own.sort()
                at, best, length = at[own], best[own], length[own]
        return t.row[at], t.begin[at], t.end[at + length - 1], best


def _by_row(n: int, row: np.ndarray, *columns: np.ndarray) -> Iterator[zip]:
    """For each of n rows the tuples of columns that belong to it; row is sorted."""
    lists, ends = [c.tolist() for c in columns], np.searchsorted(row, np.arange(n), "right").tolist()
    for a, b in zip([0, *ends], ends):
        yield zip(*[x[a:b] for x in lists])


@dataclass(frozen=True)
class Lexicon:
    """The phrases of a dictionary, numbered; each worker makes its trie once."""

    phrases: Broadcast
    name: str = field(default_factory=lambda: uuid.uuid4().hex)

    def words(self) -> _Words:
        if self.name not in _LEXICONS:
            if len(_LEXICONS) > 3:
                _LEXICONS.clear()
            _LEXICONS[self.name] = _Words(self.phrases.value)
        return _LEXICONS[self.name]


def lexicon(concepts: DataFrame) -> Lexicon | None:
    """None for a dictionary that is too large for workers."""
    known = discover.phrases(concepts)
    if (known.agg(discover._bytes(known)).first()[0] or 0) > LEXICON_BYTES:
        return None
    return Lexicon(_sent(known, sorted(r.phrase for r in known.select("phrase").distinct().collect())))


def _sent(df: DataFrame, value: Any) -> Broadcast:
    return df.sparkSession.sparkContext.broadcast(value)


def _by_number(words: Lexicon, rows: dict[str, Any]) -> list[Any]:
    return [rows.get(p) for p in words.phrases.value]


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts of batches of CHUNK bytes of text, or of one row."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CHUNK, "right")))
            yield batch.slice(at, to - at)
            at = to


def _schema(df: DataFrame, keys: list[str], *more: tuple[str, Any]) -> StructType:
    return StructType([df.schema[k] for k in keys] + [StructField(n, t) for n, t in more])


def _rows(batch: pa.RecordBatch, keys: list[str], rows: Any, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    """keys of rows of batch, beside columns."""
    rows = pa.array(rows, pa.int64())
    return pa.RecordBatch.from_pydict({k: batch.column(k).take(rows) for k in keys} | columns)


def found(runs: DataFrame, concepts: DataFrame, how: str = "greedy") -> DataFrame:
    """Dictionary phrases in runs (doc_id, key, offset, text), of rows that aren't repeated: doc_id, key, offset_begin, offset_end,
    n_words, phrase. how: "longest" is discover.longest() of all spans, "greedy" discover.greedy(), "first" the first ones of those of
    each phrase (of a run, so that's for runs that are whole texts)."""
    own = lexicon(concepts)
    keys = doc_keys(runs)
    if own is None:
        spans = discover.spans(runs, concepts)
        if how == "longest":
            return discover.longest(spans)
        first = Window.partitionBy(*keys, "phrase").orderBy("offset_begin")
        return discover.greedy(spans) if how == "greedy" else discover.greedy(spans).withColumn("rn", F.row_number().over(first)).filter("rn = 1").drop("rn")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, phrases = own.words(), pa.array(own.phrases.value, pa.string())
        sizes = np.array([p.count(" ") + 1 for p in own.phrases.value], np.int32)
        for batch in _chunks(batches):
            row, begin, end, number = words.spans(batch.column("text"), how)
            offset = batch.column("offset").to_numpy()[row]
            columns = {"offset_begin": pa.array(begin + offset), "offset_end": pa.array(end + offset), "n_words": pa.array(sizes[number]), "phrase": phrases.take(pa.array(number))}
            yield _rows(batch, keys, row, columns)

    more = ("offset_begin", IntegerType()), ("offset_end", IntegerType()), ("n_words", IntegerType()), ("phrase", StringType())
    return runs.select(*keys, "offset", "text").mapInArrow(link, _schema(runs, keys, *more))


# whole documents


def firsts(concepts: DataFrame) -> DataFrame:
    """discover.merged() concepts of which discover.first_occurrences() leaves some match: the first of each phrase, link and category.
    All concepts of a phrase are matched wherever it is, so their first matches are those at its first place."""
    w = Window.partitionBy("phrase", "link", "category").orderBy("conceptid")
    return discover.merged(concepts).withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")


def matches(docs: DataFrame, concepts: DataFrame) -> DataFrame:
    """first_occurrences() of the greedy, merged matches in docs (doc_id, text; of segment.once())."""
    return discover.with_concepts(found(text_runs(docs), concepts, "first"), firsts(concepts))


def _cards(concepts: DataFrame) -> DataFrame:
    """firsts() that are classify.eligible(), numbered. There are few: one window numbers them."""
    own = classify.eligible(firsts(concepts).withColumn("concept", F.col("phrase")))
    return own.withColumn("card", F.row_number().over(Window.orderBy("phrase", "category", "domain")))


class _Choice:
    """Of the cards of a text's phrases those that classify.distinct_links() leaves, and what follows from them."""

    def __init__(self, cards: list[list[tuple] | None]) -> None:
        self.cards = cards  # by phrase: (card, msc_index, group of the class and link or None, characters beyond SHORTEST)
        self.some = np.array([bool(c) for c in cards], bool)
        self.logs = log_matrix()

    def distinct(self, words: _Words, texts: pa.Array) -> Iterator[list[tuple[int, int, tuple]]]:
        """For each of texts (begin, end, card)."""
        row, begin, end, number = words.spans(texts, "first")
        some = self.some[number]
        for spans in _by_row(len(texts), row[some], begin[some], end[some], number[some]):
            seen, out = set(), []
            for b, e, n in spans:
                for card in self.cards[n]:
                    if card[2] is None or card[2] not in seen:
                        seen.add(card[2])
                        out.append((b, e, card))
            yield out

    @staticmethod
    def classes(rows: list[tuple[int, int, tuple]]) -> list[tuple[int, int, int]]:
        """(class, weight, size) by classify.ranking()."""
        sums: dict[int, list[int]] = {}
        for _, _, (_, own, _, weight) in rows:
            s = sums.setdefault(own, [0, 0])
            s[0] += weight
            s[1] += 1
        return sorted(((i, w, n) for i, (w, n) in sorted(sums.items())), key=lambda x: str(x[1]), reverse=True)

    def won(self, rows: list[tuple[int, int, tuple]]) -> list[tuple[int, int, tuple]]:
        best = set(classify.best_clique(self.classes(rows), self.logs))
        return [r for r in rows if r[2][1] in best]


def _choice(own: Lexicon, concepts: DataFrame) -> tuple[DataFrame, Broadcast]:
    cards = _cards(concepts)
    by: dict[str, list[tuple]] = {}
    groups: dict[tuple, int] = {}
    for r in sorted(cards.select("phrase", "conceptid", "card", "msc_index", "link").collect(), key=lambda r: (r.conceptid, r.card)):
        group = groups.setdefault((r.msc_index, r.link), len(groups)) if r.link else None
        by.setdefault(r.phrase, []).append((r.card, r.msc_index, group, len(r.phrase) - SHORTEST))
    return cards, _sent(concepts, _by_number(own, by))


def candidates(docs: DataFrame, concepts: DataFrame, disambiguated: bool = False) -> DataFrame:
    """classify.distinct_links() of classify.eligible() matches(), with msc_index; or, disambiguated, classify.disambiguate()."""
    own = lexicon(concepts)
    if own is None:
        m = matches(docs, concepts)
        return classify.disambiguate(m) if disambiguated else classify.distinct_links(classify.eligible(m))
    cards, sent = _choice(own, concepts)
    runs = text_runs(docs)
    keys = doc_keys(runs)

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, choice = own.words(), _Choice(sent.value)
        for batch in _chunks(batches):
            at, all_rows = [], []
            for i, rows in enumerate(choice.distinct(words, batch.column("text"))):
                rows = choice.won(rows) if disambiguated else rows
                at += [i] * len(rows)
                all_rows += rows
            yield _rows(batch, keys, at, {n: pa.array([f(r) for r in all_rows], pa.int32()) for n, f in (("offset_begin", lambda r: r[0]), ("offset_end", lambda r: r[1]), ("card", lambda r: r[2][0]))})

    more = ("offset_begin", IntegerType()), ("offset_end", IntegerType()), ("card", IntegerType())
    at = runs.select(*keys, "text").mapInArrow(link, _schema(runs, keys, *more))
    columns = [*discover.CONCEPT, "multilinks", *([] if disambiguated else ["msc_index"])]
    return at.join(F.broadcast(cards.select("card", "concept", *columns)), "card").select(*keys, "offset_begin", "offset_end", "concept", *columns)


def weights(docs: DataFrame, concepts: DataFrame) -> DataFrame:
    """classify.ranking() of classify.weights() of candidates(): doc_id, key, msc_index, weight, size, place."""
    own = lexicon(concepts)
    if own is None:
        return classify.ranking(classify.weights(candidates(docs, concepts)))
    _, sent = _choice(own, concepts)
    runs = text_runs(docs)
    keys = doc_keys(runs)

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, choice = own.words(), _Choice(sent.value)
        for batch in _chunks(batches):
            at, rows = [], []
            for i, chosen in enumerate(choice.distinct(words, batch.column("text"))):
                ranked = choice.classes(chosen)
                at += [i] * len(ranked)
                rows += [(*r, place) for place, r in enumerate(ranked, 1)]
            types = (("msc_index", pa.int32()), ("weight", pa.int64()), ("size", pa.int64()), ("place", pa.int32()))
            yield _rows(batch, keys, at, {n: pa.array([r[k] for r in rows], t) for k, (n, t) in enumerate(types)})

    more = ("msc_index", IntegerType()), ("weight", LongType()), ("size", LongType()), ("place", IntegerType())
    return runs.select(*keys, "text").mapInArrow(link, _schema(runs, keys, *more))


def _links(concepts: DataFrame, domain: str | None = None) -> DataFrame:
    """annotate.spans() of a place where a phrase is, for each phrase: phrase, links."""
    known = discover.merged(concepts).select(F.col("phrase").alias("doc_id"), F.lit(0).alias("offset_begin"), F.lit(0).alias("offset_end"), "conceptid", "domain", "link", "multilinks")
    return annotate.spans(discover.domain_filter(known, domain)).select(F.col("doc_id").alias("phrase"), "links")


def spans(docs: DataFrame, concepts: DataFrame) -> DataFrame:
    """annotate.spans() of the greedy, merged matches in docs. The links of a place are those of its phrase."""
    at = found(text_runs(docs), concepts)
    size = concepts.agg(discover._bytes(concepts)).first()[0] or 0
    return at.join(discover.side(_links(concepts), size), "phrase").select(*doc_keys(at), "offset_begin", "offset_end", "links")


def embed(docs: DataFrame, concepts: DataFrame, annotation: str = "html", domain: str | None = None, icons: dict[str, str] = annotate.ICONS) -> DataFrame:
    """annotate.embed() of the greedy, merged matches in docs (doc_id, text)."""
    own = lexicon(concepts)
    if own is None or not annotation.lower().startswith("html"):
        m = discover.with_concepts(discover.greedy(discover.spans(text_runs(docs), concepts)), discover.merged(concepts))
        return annotate.embed(docs, m, annotation, domain, icons)
    before, after = annotate.marks(F.col("links"), annotation.lower() == "html+rdfa", icons)
    marks = _links(concepts, domain).select("phrase", before.alias("before"), after.alias("after"), F.size("links").alias("n"))
    sent = _sent(docs, _by_number(own, {r.phrase: (r.before, r.after, r.n) for r in marks.collect()}))

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, known = own.words(), sent.value
        for batch in _chunks(batches):
            texts, sizes = [], []
            spans = _by_row(batch.num_rows, *words.spans(batch.column("text"), "greedy"))
            for text, own_spans in zip(batch.column("text").to_pylist(), spans):
                parts, at, n = [], 0, 0
                for b, e, number in own_spans:
                    if mark := known[number]:
                        parts += (text[at:b], mark[0], text[b:e], mark[1])
                        at = e
                        n += mark[2]
                texts.append("".join([*parts, text[at:]]) if parts else text)
                sizes.append(n)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "annotated": pa.array(texts, pa.string()), "n_links": pa.array(sizes, pa.int64())})

    return docs.select("doc_id", "text").mapInArrow(link, _schema(docs, ["doc_id"], ("annotated", StringType()), ("n_links", LongType())))


def standoff(docs: DataFrame, concepts: DataFrame, disambiguated: bool = False) -> DataFrame:
    """annotate.standoff() of the greedy, merged matches in docs, or of candidates(disambiguated)."""
    own = lexicon(concepts)
    if own is None:
        greedy = lambda: discover.with_concepts(found(text_runs(docs), concepts), discover.merged(concepts))
        return annotate.standoff(candidates(docs, concepts, True) if disambiguated else greedy())
    if disambiguated:
        rows, sent = _choice(own, concepts)
    else:
        rows, sent = discover.merged(concepts).withColumn("card", F.lit(0)), None
    # all of a match but its place is the same wherever its phrase is
    made = rows.select("phrase", "card", "conceptid", annotate.json_of(F.col("phrase")).alias("json")).collect()
    by: dict[str, list[str]] = {}
    for r in sorted(made, key=lambda r: r.conceptid):
        by.setdefault(r.phrase, []).append(r.json[1:])
    cards = {r.card: r.json[1:] for r in made}
    tails = _sent(docs, cards if disambiguated else _by_number(own, by))

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, choice, tail = own.words(), _Choice(sent.value) if sent else None, tails.value
        for batch in _chunks(batches):
            if choice:
                rows = ([f'{{"offset_begin":{b},"offset_end":{e},{tail[card[0]]}' for b, e, card in choice.won(own_rows)] for own_rows in choice.distinct(words, batch.column("text")))
            else:
                spans = _by_row(batch.num_rows, *words.spans(batch.column("text"), "greedy"))
                rows = ([f'{{"offset_begin":{b},"offset_end":{e},{x}' for b, e, n in own_spans for x in tail[n]] for own_spans in spans)
            made = [(i, f"[{','.join(r)}]") for i, r in enumerate(rows) if r]
            yield _rows(batch, ["doc_id"], [i for i, _ in made], {"payload": pa.array([x for _, x in made], pa.string())})

    return docs.select("doc_id", "text").mapInArrow(link, _schema(docs, ["doc_id"], ("payload", StringType())))
