"""Morphology, URLs and names as Column functions."""

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LETTER = r"[\p{L}\p{M}\p{N}_]"
INNER = r"[\p{L}\p{M}\p{N}_+'-]"
WORD = f"{LETTER}{INNER}*"
PIECE = rf"(?:{WORD}|[^\p{{L}}\p{{M}}\p{{N}}_]+)"  # words and what lies between them, without loss
PHRASE = rf"^{WORD}(?:\s+{WORD})*+$"  # possessive: a group that may give back takes a stack frame for each word


def _letters() -> tuple[str, str]:
    """Lower-case letters of one plain letter, and that letter: Latin with marks by decomposition, Greek and Cyrillic by sound.
    Combining marks come last, without a counterpart: they vanish."""
    pairs = dict(zip("đħıłøŧαβγδεζηικλμνξοπρςστυφωабвгдезийклмнопрстуфыэіїўѕј", "dhilotabgdeziiklmnxoprsstufoabvgdeziiklmnoprstufyeiiusj"))
    for c in map(chr, (*range(0xE0, 0x250), *range(0x370, 0x530), *range(0x1E00, 0x2000))):
        base = unicodedata.normalize("NFKD", c)[0]
        if c not in pairs and c == c.lower() and base != c and (base.isascii() and base.isalpha() or base in pairs):
            pairs[c] = pairs.get(base, base)
    marks = "".join(map(chr, range(0x300, 0x370))) + "ьъ"
    return "".join(pairs) + marks, "".join(pairs.values())


PLAIN_FROM, PLAIN_TO = _letters()
PLAIN_LONG = (
    ("ß", "ss"), ("æ", "ae"), ("œ", "oe"), ("þ", "th"), ("ð", "d"), ("ŋ", "ng"), ("θ", "th"), ("χ", "ch"), ("ψ", "ps"),
    ("ж", "zh"), ("х", "kh"), ("ц", "ts"), ("ч", "ch"), ("ш", "sh"), ("щ", "shch"), ("ю", "iu"), ("я", "ia"), ("є", "ie"), ("ё", "io"),
)

# (end of the stem, ending taken off, ending put on); the first that fits counts
SINGULAR_PHRASE = (
    ("ri", "ces", "x"), ("t", "ices", "ex"), ("[aeiuo]x", "es", ""), ("", "ies", "y"), ("", "ees", "ee"), ("", "ches", "ch"), ("o", "ci", "cus"),
    ("", "sses", "ss"), ("ie", "s", ""), ("[^eiuos]", "s", ""), ("[^aeio]", "es", "e"),
)
PLURAL = (
    ("ri", "x", "ces"), ("t", "ex", "ices"), ("[aeiuo]", "x", "xes"), ("[^aeiou]", "y", "ies"), ("", "ee", "ees"),
    ("", "us", "i"), ("", "ch", "ches"), ("", "ss", "sses"), ("", "", "s"),
)
ROOT = (
    ("ri", "ces", ""), ("[aeiuo]x", "es", ""), ("", "ies", ""), ("", "ches", "ch"), ("o", "ci", "c"), ("", "sses", "ss"),
    ("[^eiuos]", "s", ""), ("[^aeio]", "es", "e"),
)


def let(c: Column, f: Callable[[Column], Column]) -> Column:
    """f(c) with c computed once, however often f uses it: nested rules would otherwise repeat it thousands of times."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def _rules(c: Column, rules: tuple) -> Column:
    def chain(x: Column) -> Column:
        out = x
        for stem, off, on in reversed(rules):
            pattern = f"^(.+{stem}){off}$"
            out = F.when(x.rlike(pattern), F.regexp_replace(x, pattern, f"$1{on}")).otherwise(out)
        return out

    return let(c, chain)


def plain(c: Column) -> Column:
    """Lower case, transliterated to ASCII where a letter has a plain form; ASCII texts are only lowered."""
    out = F.translate(F.lower(c), PLAIN_FROM, PLAIN_TO)
    for a, b in PLAIN_LONG:
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(out)


def is_possessive(c: Column) -> Column:
    return c.rlike(rf"{LETTER}(?:'s|s')(?:\s|$)")


def nonpossessive(c: Column) -> Column:
    """Without the first 's, else with the first s' as s."""
    return F.regexp_replace(c, r"(?s)^(?:(.*?)'s(\s|$)|(.*?s)'(\s|$))", "$1$2$3$4")


def possessive(c: Column) -> Column:
    c = F.regexp_replace(c, f"^({WORD})", "$1'")
    return F.regexp_replace(c, f"^({LETTER}{INNER}*[^s])'", "$1's")


def singular_word(c: Column) -> Column:
    """c should be a column that is computed already: it is used often. The rules that only take something off are one pattern;
    words of other endings, which are most, meet no pattern at all."""
    put = lambda off, on: F.regexp_replace(c, f"{off}$", on)
    taken = F.regexp_replace(c, "^(?:(.+(?:[aeiuo]x|ch|ss))es|(.+(?:ee|[^eiuos]|[^aeio]e))s)$", "$1$2")
    altered = F.when(c.rlike("^.+rices$"), put("ces", "x")).when(c.rlike("^.+tices$"), put("ices", "ex")).when(c.rlike("^.+ies$"), put("ies", "y")).otherwise(taken)
    return F.when(c.endswith("s"), altered).when(c.endswith("oci") & (F.length(c) > 3), put("ci", "cus")).otherwise(c)


def singular_phrase(c: Column) -> Column:
    """Of "... of ..." and "... by ..." only the head is made singular."""
    pattern = rf"^({LETTER}[\p{{L}}\p{{M}}\p{{N}}_\s]+?{LETTER})(\s+(?:of|by)\s+.+)$"
    head, tail = (lambda x: F.regexp_extract(x, pattern, 1)), (lambda x: F.regexp_extract(x, pattern, 2))
    return let(c, lambda x: F.when(x.rlike(pattern), F.concat(_rules(head(x), SINGULAR_PHRASE), tail(x))).otherwise(_rules(x, SINGULAR_PHRASE)))


def plural(c: Column) -> Column:
    """Of "... of ..." and "... by ..." the last word of the head."""
    pattern = rf"^({WORD})(\s+(?:of|by)\s+.+)"
    head, tail = (lambda x: F.regexp_extract(x, pattern, 1)), (lambda x: F.regexp_extract(x, pattern, 2))
    return let(c, lambda x: F.when(x.rlike(pattern), F.concat(_rules(head(x), PLURAL), tail(x))).otherwise(_rules(x, PLURAL)))


def is_plural(c: Column) -> Column:
    return c != singular_phrase(c)


def root(c: Column) -> Column:
    return _rules(c, ROOT)


def undetermined(c: Column) -> Column:
    return F.regexp_replace(c, r"^(?:an?|the)(?:\s+|$)", "")


def _bare(c: Column) -> Column:
    """A plain word without possessive ending; determiners vanish."""
    return F.when(c.isin("a", "an", "the"), F.lit("")).when(c.contains("'"), nonpossessive(c)).otherwise(c)


def normal_word(c: Column) -> Column:
    return let(plain(c), lambda p: let(_bare(p), singular_word))


def normalised(df: DataFrame, **words: str) -> DataFrame:
    """df with a column for each of words (new column = column of single words), never null: normal_word() in steps that stay in
    generated code. Don't filter on the new columns before a shuffle or a join: the filter would move down and repeat the steps."""
    df = df.withColumns({f"_p_{new}": plain(F.col(old)) for new, old in words.items()})
    df = df.withColumns({f"_q_{new}": _bare(F.col(f"_p_{new}")) for new in words})
    df = df.withColumns({new: F.coalesce(singular_word(F.col(f"_q_{new}")), F.lit("")) for new in words})
    return df.drop(*[f"_{k}_{new}" for k in "pq" for new in words])


def normal_phrase(c: Column) -> Column:
    """Each word normalised; words that vanish (determiners) are dropped."""
    words = F.transform(F.split(F.trim(c), r"\s+"), normal_word)
    return F.array_join(F.filter(words, lambda w: w != ""), " ")


def first_word(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, f"^({WORD})", 1), F.lit(""))


def tail_words(c: Column) -> Column:
    return F.when(first_word(c).isNotNull(), F.regexp_extract(c, rf"^{WORD}\s?(.*)$", 1))


def concept_of(first: Column, tail: Column) -> Column:
    return F.concat_ws(" ", first, F.nullif(tail, F.lit("")))


def admissible(c: Column) -> Column:
    return c.rlike(PHRASE)


def canonical_url(c: Column) -> Column:
    """Without protocol, "/./", "x/..", a leading "./" and "www."."""
    c = F.regexp_replace(F.regexp_replace(c, r"^https?://", ""), r"/\./", "/")
    ups = F.regexp_count(c, F.lit(r"/\.\.(?=/|$)"))
    up = lambda x, _: F.regexp_replace(x, r"^(.*?)/(?!\.\./)[^/]+/\.\.(/|$)", "$1$2")
    c = F.when(ups > 0, F.aggregate(F.sequence(F.lit(1), ups), c, up)).otherwise(c)
    return F.regexp_replace(F.regexp_replace(c, r"^\./", ""), r"^www.", "")


def with_protocol(c: Column) -> Column:
    return F.when((c != "") & ~c.rlike("^http"), F.concat(F.lit("http://"), c)).otherwise(c)


def tag_to_concept(c: Column) -> Column:
    c = F.regexp_replace(c, r"^[a-z][a-z]\.", "")
    c = F.regexp_replace(c, r"(?<![0-9])-", " ")
    return F.regexp_replace(c, "semi ", "semi-")


def unescaped(c: Column) -> Column:
    return F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))


def right_trimmed(c: Column) -> Column:
    return F.regexp_replace(c, r"\s+$", "")


def cleaned_title(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"\([^)]*\)", ""), r":.*$", "")


def without_prefix(c: Column, prefix: str) -> Column:
    return F.regexp_replace(c, f"^{prefix}:", "")


def page_concept(c: Column) -> Column:
    return right_trimmed(F.lower(F.regexp_extract(c, r"([^(]+)", 1)))


def absolute_link(c: Column, base: str, notation: bool = False) -> Column:
    return F.concat(F.lit(base), F.regexp_replace(c, r"^.*\./" if notation else r"^(?:\.\./)?\./", ""))


def source_path(c: Column) -> Column:
    return F.regexp_replace(c, r"/([^/]+)$", "/source/$1")


def domain_name(c: Column) -> Column:
    """First letter in upper case, the rest in lower case; null for names with other characters than those of words."""
    return F.when(c.rlike(f"^{LETTER}+$"), F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, 1 << 20))))
