"""DuckDB SQL for the queries; pieces of it are shared as CTEs."""

from pathlib import Path

import pyarrow.parquet as pq

# The rules are written down here anew, so that SQL and engine check each other; only the lists and the matrix are shared data.
_RESOURCES = Path(__file__).parent.parent / "resources"
_STOP_WORDS = pq.read_table(_RESOURCES / "stopwords.parquet")["word"].to_pylist()
_SIMILARITY = pq.read_table(_RESOURCES / "similarity.parquet")["sim"].to_pylist()
DOMAINS = ("alpha", "beta", "gamma")
CODES = (
    "00 01 03 05 06 08 11 12 13 14 15 16 17 18 19 20 22 26 28 30 31 32 33 34 35 37 39 40 41 42 43 44 45 46 47 49 51 52 53 54 55 57 58 "
    "60 62 65 68 70 74 76 78 80 81 82 83 85 86 90 91 92 93 94 97"
).split()
LETTER = r"[\p{L}\p{M}\p{N}_]"
INNER = r"[\p{L}\p{M}\p{N}_+'-]"
WORD = r"[\p{L}\p{M}\p{N}_][\p{L}\p{M}\p{N}_+'-]*"
PIECE = rf"(?:{WORD}|[^\p{{L}}\p{{M}}\p{{N}}_]+)"
PHRASE = rf"^{WORD}(?:\s+{WORD})*$"
TAGS = r"(?s)(<!--.*?-->|<[^>]*>|[^<]+|<)"
SKIP = "(?:head|style|title|script|xmp|iframe|code|math|svg|sup|a|h[0-9]+)"
PLAIN = ("àáâãäåçèéêëìíîïñòóôõöøùúûüýÿāăąćčďđēęěğīłńňőřśšťūůűźżž", "aaaaaaceeeeiiiinoooooouuuuyyaaaccddeeegilnnorsstuuuzzz")
PLAIN_LONG = (("ß", "ss"), ("æ", "ae"), ("œ", "oe"), ("þ", "th"))
# (end of the stem, ending taken off, ending put on)
SINGULAR_WORD = (
    ("ri", "ces", "x"), ("t", "ices", "ex"), ("[aeiuo]x", "es", ""), ("", "ies", "y"), ("", "ees", "ee"), ("", "ches", "ch"),
    ("", "sses", "ss"), ("ie", "s", ""), ("[^eiuos]", "s", ""), ("[^aeio]", "es", "e"), ("o", "ci", "cus"),
)
SINGULAR_PHRASE = (*SINGULAR_WORD[:6], SINGULAR_WORD[10], *SINGULAR_WORD[6:10])
PLURAL = (
    ("ri", "x", "ces"), ("t", "ex", "ices"), ("[aeiuo]", "x", "xes"), ("[^aeiou]", "y", "ies"), ("", "ee", "ees"),
    ("", "us", "i"), ("", "ch", "ches"), ("", "ss", "sses"), ("", "", "s"),
)
ROOT = (
    ("ri", "ces", ""), ("[aeiuo]x", "es", ""), ("", "ies", ""), ("", "ches", "ch"), ("o", "ci", "c"), ("", "sses", "ss"),
    ("[^eiuos]", "s", ""), ("[^aeio]", "es", "e"),
)


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _rules(x: str, rules: tuple) -> str:
    out = "CASE"
    for stem, off, on in rules:
        p = _q(f"^(.+{stem}){off}$")
        out += f" WHEN regexp_matches({x}, {p}) THEN regexp_replace({x}, {p}, {_q(chr(92) + '1' + on)})"
    return f"{out} ELSE {x} END"


def _plain(x: str) -> str:
    out = f"translate(lower({x}), '{PLAIN[0]}', '{PLAIN[1]}')"
    for a, b in PLAIN_LONG:
        out = f"replace({out}, '{a}', '{b}')"
    return out


def _canonical(x: str) -> str:
    """The data have no '..' segments; those are tested apart."""
    for p, new in (("^https?://", ""), (r"/\./", "/"), (r"^\./", ""), ("^www.", "")):
        x = f"regexp_replace({x}, '{p}', '{new}'{', ' + _q('g') if p == chr(47) + chr(92) + './' else ''})"
    return x


def _protocol(x: str) -> str:
    return f"CASE WHEN {x} <> '' AND NOT regexp_matches({x}, '^http') THEN 'http://' || {x} ELSE {x} END"


_UNDETERMINED = r"regexp_replace({x}, '^(?:an?|the)(?:\s+|$)', '')"
_NONPOSSESSIVE = r"regexp_replace({x}, '(?s)^(?:(.*?)''s(\s|$)|(.*?s)''(\s|$))', '\1\2\3\4')"
_CODES = "[" + ", ".join(_q(c) for c in CODES) + "]"
_DOMAINS = "[" + ", ".join(_q(d) for d in DOMAINS) + "]"
_IS_WORD = f"regexp_matches(piece, {_q('^' + LETTER)})"


def _normal(name: str, source: str) -> str:
    """CTEs ending in `name` (w, norm) for the distinct words of `source` (word), step by step."""
    return f"""
{name}_0 AS (SELECT DISTINCT word AS w, {_UNDETERMINED.format(x=_plain("word"))} AS x FROM {source}),
{name}_1 AS (SELECT w, {_NONPOSSESSIVE.format(x="x")} AS x FROM {name}_0),
{name} AS MATERIALIZED (SELECT w, CASE WHEN regexp_matches(x, 'oci|s$') THEN {_rules("x", SINGULAR_WORD)} ELSE x END AS norm FROM {name}_1)"""


def _tokens(name: str, source: str) -> str:
    """name (doc_id, b, e, word, n1, e1, n2, e2) for source (doc_id, off, text)."""
    w = "PARTITION BY doc_id, off ORDER BY pos"
    return f"""
{name}_p AS (SELECT doc_id, off, regexp_extract_all(text, {_q(PIECE)}) AS ps FROM {source}),
{name}_e AS (SELECT doc_id, off, generate_subscripts(ps, 1) AS pos, unnest(ps) AS piece FROM {name}_p),
{name}_o AS (SELECT *, CAST(off + coalesce(sum(length(piece)) OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS b FROM {name}_e),
{name}_l AS (SELECT *, lead(piece, 1) OVER ({w}) AS g1, lead(piece, 2) OVER ({w}) AS x1, lead(piece, 3) OVER ({w}) AS g2, lead(piece, 4) OVER ({w}) AS x2,
  lead(b + length(piece), 2) OVER ({w}) AS y1, lead(b + length(piece), 4) OVER ({w}) AS y2 FROM {name}_o),
{name}_m AS (SELECT *, regexp_matches(g1, '^\\s+$') AND x1 IS NOT NULL AS ok1, regexp_matches(g2, '^\\s+$') AND x2 IS NOT NULL AS ok2 FROM {name}_l WHERE {_IS_WORD}),
{name} AS MATERIALIZED (SELECT doc_id, b, CAST(b + length(piece) AS INTEGER) AS e, piece AS word, CASE WHEN ok1 THEN x1 END AS n1, CASE WHEN ok1 THEN y1 END AS e1,
  CASE WHEN ok1 AND ok2 THEN x2 END AS n2, CASE WHEN ok1 AND ok2 THEN y2 END AS e2 FROM {name}_m)"""


_STOP = "stop AS (SELECT unnest([" + ", ".join(_q(w) for w in _STOP_WORDS) + "]) AS stop)"
_PAGES = "pg AS (SELECT page_id AS doc_id, url, html FROM pages)"
_DOCS = "runs AS (SELECT doc_id, 0 AS off, coalesce(text, '') AS text FROM documents)"
_TOKENS = _DOCS + "," + _tokens("tok", "runs")

_DICTIONARY = f"""
{_STOP}, bench AS (SELECT item_id AS doc_id, 0 AS off, text FROM benchmark),{_tokens("bt", "bench")},
{_normal("bn", "(SELECT word FROM bt UNION SELECT n1 FROM bt WHERE n1 IS NOT NULL UNION SELECT n2 FROM bt WHERE n2 IS NOT NULL)")},
bf AS (SELECT * FROM bt WHERE NOT EXISTS (SELECT 1 FROM stop WHERE stop = lower(word))),
bw AS (SELECT doc_id AS item_id, a.norm AS w1, b.norm AS w2, c.norm AS w3 FROM bf JOIN bn a ON a.w = word LEFT JOIN bn b ON b.w = n1 LEFT JOIN bn c ON c.w = n2 WHERE a.norm <> ''),
bg AS (SELECT item_id, w1 AS concept, 1 AS n_words FROM bw UNION ALL SELECT item_id, w1 || ' ' || w2, 2 FROM bw WHERE w2 <> '' UNION ALL SELECT item_id, w1 || ' ' || w2 || ' ' || w3, 3 FROM bw WHERE w2 <> '' AND w3 <> ''),
bc AS MATERIALIZED (SELECT concept, n_words, min(item_id) AS item_id, row_number() OVER (ORDER BY n_words, concept) AS n FROM bg GROUP BY concept, n_words),
br AS (SELECT n, concept, n_words, item_id, {_CODES}[n % {len(CODES)} + 1] || '-XX' AS category, {_DOMAINS}[n % 3 + 1] AS domain, {_DOMAINS}[(n + 1) % 3 + 1] AS other, 'example.org/' || item_id AS link FROM bc),
dict AS MATERIALIZED (SELECT conceptid, split_part(concept, ' ', 1) AS firstword, substr(concept, length(split_part(concept, ' ', 1)) + 2) AS tailwords, category, 'msc' AS scheme, domain, link, item_id AS objectid, concept, n_words FROM (
  SELECT n AS conceptid, concept, n_words, category, domain, link, item_id FROM br
  UNION ALL SELECT n + 1000000, concept, n_words, category, domain, link || '/more', item_id FROM br WHERE n % 5 = 0
  UNION ALL SELECT n + 2000000, concept, n_words, category, other, 'http://other.example.org/' || item_id, item_id FROM br WHERE n % 7 = 0))"""


def _matching(tok: str = "tok") -> str:
    return f"""
hits AS MATERIALIZED (SELECT * FROM {tok} WHERE NOT EXISTS (SELECT 1 FROM stop WHERE stop = lower(word))),
{_normal("nw", f"(SELECT word FROM hits UNION SELECT n1 FROM hits WHERE n1 IS NOT NULL UNION SELECT n2 FROM hits WHERE n2 IS NOT NULL)")},
grams AS (SELECT doc_id, b, e, a.norm AS w1, e1, x.norm AS w2, e2, y.norm AS w3 FROM hits JOIN nw a ON a.w = word LEFT JOIN nw x ON x.w = n1 LEFT JOIN nw y ON y.w = n2 WHERE a.norm <> ''),
cand AS (SELECT doc_id, b, g.e AS e, d.* FROM (SELECT doc_id, b, e, w1 AS p FROM grams UNION ALL SELECT doc_id, b, e1, w1 || ' ' || w2 FROM grams WHERE w2 <> ''
  UNION ALL SELECT doc_id, b, e2, w1 || ' ' || w2 || ' ' || w3 FROM grams WHERE w2 <> '' AND w3 <> '') g JOIN dict d ON d.concept = p),
lng AS MATERIALIZED (SELECT * FROM (SELECT *, max(n_words) OVER (PARTITION BY doc_id, b) AS top FROM cand) WHERE n_words = top),
sp AS (SELECT doc_id, b, max(e) AS e FROM lng GROUP BY 1, 2),
nxt AS MATERIALIZED (SELECT s.doc_id, s.b, n.b AS nb FROM sp s ASOF JOIN sp n ON s.doc_id = n.doc_id AND s.e <= n.b),
walk(doc_id, b) AS (SELECT doc_id, min(b) FROM sp GROUP BY doc_id UNION ALL SELECT w.doc_id, n.nb FROM walk w JOIN nxt n ON n.doc_id = w.doc_id AND n.b = w.b),
gr AS MATERIALIZED (SELECT lng.* FROM lng JOIN walk USING (doc_id, b)),
mg AS MATERIALIZED (SELECT doc_id, b, e, category, domain, min(conceptid) AS conceptid, arg_min(concept, conceptid) AS concept, arg_min(link, conceptid) AS link, arg_min(scheme, conceptid) AS scheme,
  CASE WHEN count(*) > 1 THEN list(link ORDER BY conceptid) END AS multilinks FROM gr GROUP BY 1, 2, 3, 4, 5),
fo AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, concept, link, category ORDER BY b, conceptid) AS rn FROM mg) WHERE rn = 1)"""


_LINKED = f"WITH RECURSIVE {_TOKENS}, {_DICTIONARY}, {_matching()}"
_MATCH = "doc_id, b AS offset_begin, e AS offset_end, conceptid, concept, category, domain, link"
_FLAT = f"{_MATCH}, coalesce(array_to_string(multilinks, ','), '') AS multilinks"
_WORDS = f"WITH {_TOKENS}, dw AS (SELECT DISTINCT word FROM tok)"

# HTML: the data have no span elements, so their rule is tested apart
_SEGMENTS = f"""{_PAGES}, hp AS (SELECT doc_id, regexp_extract_all(html, {_q(TAGS)}, 1) AS ps FROM pg),
he AS (SELECT doc_id, generate_subscripts(ps, 1) - 1 AS pos, unnest(ps) AS piece FROM hp),
hd AS (SELECT *, CASE WHEN regexp_matches(piece, {_q(f"^<{SKIP}(?:[\\s/>])")}) AND NOT regexp_matches(piece, '/>$') THEN 1 WHEN regexp_matches(piece, {_q(f"^</{SKIP}\\s*>")}) THEN -1 ELSE 0 END AS d FROM he),
hs AS MATERIALIZED (SELECT doc_id, pos, piece, CAST(coalesce(sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS off,
  CAST(sum(d) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS INTEGER) AS depth FROM hd),
hr AS (SELECT doc_id, off, piece AS text FROM hs WHERE NOT starts_with(piece, '<') AND depth = 0 AND regexp_matches(piece, {_q(LETTER)}))"""

_TRIMMED = r"trim(regexp_replace(lower({x}), '[^\p{{L}}\p{{M}}\p{{N}}_+'' -]', '', 'g'))"


def _flattened(name: str, synonyms: str) -> str:
    """CTEs ending in `name`: the admissible names and categories of pages, and {name}_f: all of them."""
    return f"""
{name}_n AS (SELECT doc_id, page, url, category, generate_subscripts(names, 1) AS k, unnest(names) AS name FROM (SELECT *, list_append({synonyms}, concept) AS names FROM hv)),
{name}_t AS (SELECT doc_id, page, url, category, k, generate_subscripts(ws, 1) AS j, unnest(ws) AS word FROM (SELECT *, regexp_split_to_array(trim(name), '\\s+') AS ws FROM {name}_n)),
{_normal(f"{name}_w", f"{name}_t")},
{name}_f AS (SELECT DISTINCT doc_id, page, concept, category, 'msc' AS scheme, url FROM (
  SELECT doc_id, page, url, category, k, string_agg(norm, ' ' ORDER BY j) AS concept FROM {name}_t JOIN {name}_w ON w = word WHERE norm <> '' GROUP BY 1, 2, 3, 4, 5)),
{name} AS MATERIALIZED (SELECT * FROM {name}_f WHERE regexp_matches(concept, {_q(PHRASE)}))"""


_HARVEST = f"""{_PAGES}, hv AS (SELECT doc_id, url AS page, {_TRIMMED.format(x="regexp_extract(html, '<h1>([^<]*)</h1>', 1)")} AS concept, {_canonical("url")} AS url,
  regexp_extract(html, '<html lang="([a-z]+)"', 1) || '-XX' AS category, [{_TRIMMED.format(x="s")} FOR s IN regexp_extract_all(html, '<b>([^<]*)<', 1)] AS synonyms,
  [{_TRIMMED.format(x="s")} FOR s IN regexp_extract_all(html, '<a href="[^"]*">([^<]*)<', 1)] AS anchors FROM pg),{_flattened("hb", "synonyms")}"""
_REVISIONS = f"""{_HARVEST},{_flattened("hl", "anchors")},
old AS (SELECT DISTINCT concept, category FROM hl),
new AS (SELECT DISTINCT concept, category, url AS link FROM hb)"""

_KB = f"""{_LINKED},
objects AS (SELECT id AS objectid, 'example.org/' || id AS url, 'alpha' AS domain FROM (SELECT item_id AS id FROM benchmark UNION SELECT doc_id FROM documents)),
edges AS (SELECT DISTINCT doc_id AS objectid, conceptid FROM fo)"""
_SNAPSHOTS = f"""{_KB}, o2 AS (SELECT *, row_number() OVER (ORDER BY s, id) AS objectid FROM (SELECT 0 AS s, objectid AS id, url FROM objects UNION ALL SELECT 1, objectid, url FROM objects)),
c2 AS (SELECT s, conceptid AS old, row_number() OVER (ORDER BY s, conceptid) AS conceptid, firstword, tailwords, category, domain, link, objectid FROM (SELECT 0 AS s, * FROM dict UNION ALL SELECT 1, * FROM dict WHERE domain = 'beta'))"""
_CONCEPT = "conceptid, firstword, tailwords, category, scheme, domain, link, objectid"

_ELIGIBLE = f"""{_LINKED}, el AS (SELECT *, CAST(list_position({_CODES}, substr(category, 1, 2)) - 1 AS INTEGER) AS msc_index FROM fo WHERE scheme = 'msc' AND NOT starts_with(category, 'XX') AND length(concept) >= 7),
dl AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, msc_index, link ORDER BY b, conceptid) AS r2 FROM el WHERE msc_index IS NOT NULL) WHERE r2 = 1),
cw AS MATERIALIZED (SELECT doc_id, msc_index, CAST(sum(length(concept) - 7) AS BIGINT) AS weight, count(*) AS size FROM dl GROUP BY 1, 2)"""


def _matrix() -> str:
    return ", ".join(f"({k // len(CODES)}, {k % len(CODES)}, {x!r})" for k, x in enumerate(_SIMILARITY))


def _links_sql(domain: str | None) -> str:
    """CTE sl (doc_id, b, e, links): links of a span, those of later matches first, each once."""
    only = f"WHERE domain = '{domain}'" if domain else ""
    return f"""
lk AS (SELECT doc_id, b, e, conceptid, domain, list_prepend(link, coalesce(multilinks, [])) AS ls FROM mg {only}),
lx AS (SELECT doc_id, b, e, conceptid, domain, generate_subscripts(ls, 1) AS k, unnest(ls) AS link FROM lk),
ly AS (SELECT doc_id, b, e, domain, {_protocol("link")} AS link, row_number() OVER (PARTITION BY doc_id, b ORDER BY conceptid DESC, k) AS o FROM lx WHERE link <> ''),
lz AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, b, link ORDER BY o) AS r FROM ly) WHERE r = 1),
sl AS (SELECT doc_id, b, max(e) AS e, count(*) AS c, list(link ORDER BY o) AS links, list(domain ORDER BY o) AS domains FROM lz GROUP BY 1, 2)"""


def _embed_sql(domain: str | None, rdfa: bool, icons: dict[str, str]) -> str:
    extra = 'property="http://purl.org/dc/terms/relation" ' if rdfa else ""
    icon = "CASE d " + " ".join(f"WHEN {_q(k)} THEN {_q(v)}" for k, v in icons.items()) + " ELSE '' END"
    item = f"""'<a class="concept" {extra}href="' || links[i] || '">' || '<img src="' || {icon.replace("CASE d", "CASE domains[i]")} || '" alt="' || domains[i] || '"></img></a>'"""
    span = "substr(text, b + 1, e - b)"
    return f"""{_LINKED}, {_links_sql(domain)},
an AS (SELECT doc_id, b, e, c, CASE WHEN c = 1 THEN '<a class="concept" {extra}href="' || links[1] || '">' || {span} || '</a>'
  ELSE '<a class="concepts" href="javascript:void(0)" onclick="this.nextSibling.style.display=''inline''">' || {span} || '</a><sup style="display: none;">' || array_to_string([{item} FOR i IN range(1, c + 1)], '') || '</sup>' END AS a,
  substr(text, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY b), 0) + 1, b - coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY b), 0)) AS gap FROM sl JOIN documents USING (doc_id)),
jn AS (SELECT doc_id, string_agg(gap || a, '' ORDER BY b) AS x, max(e) AS last, CAST(sum(c) AS BIGINT) AS n FROM an GROUP BY 1)
SELECT d.doc_id, coalesce(x, '') || substr(text, coalesce(last, 0) + 1) AS annotated, coalesce(n, 0) AS n_links FROM documents d LEFT JOIN jn USING (doc_id)"""


_POSSESSIVE = rf"regexp_replace(regexp_replace(p_name, '^({WORD.replace(chr(39), chr(39) * 2)})', '\1'''), '^({LETTER}{INNER.replace(chr(39), chr(39) * 2)}*[^s])''', '\1''s')"
_OF = rf"^({LETTER}[\p{{L}}\p{{M}}\p{{N}}_\s]+?{LETTER})(\s+(?:of|by)\s+.+)$"
_PHRASE_HEAD = f"^({WORD})(\\s+(?:of|by)\\s+.+)"
_CRAWL = f"""WITH RECURSIVE {_PAGES}, cu AS (SELECT {_canonical("url")} AS u, html FROM pg), ch AS (SELECT u, regexp_extract(u, '^([^/]*)', 1) AS h, html FROM cu),
ln AS MATERIALIZED (SELECT DISTINCT * FROM (SELECT 'host:' || h AS url, u AS target FROM ch UNION ALL SELECT u, h || unnest(regexp_extract_all(html, '<a href="(/[^"]*)"', 1)) FROM ch UNION ALL SELECT 'root', 'host:' || h FROM ch)),
wk AS (SELECT 'root' AS url, 0 AS depth UNION SELECT target, depth + 1 FROM wk JOIN ln USING (url) WHERE depth < 3 AND url NOT LIKE '%page=2%')
SELECT url, min(depth) AS depth FROM wk GROUP BY url"""

ORACLES: dict[str, str] = {
    "tokenize_offsets": f"WITH {_TOKENS} SELECT doc_id, b AS offset_begin, e AS offset_end, word FROM tok",
    "normalize_words": f"{_WORDS}, {_normal('nw', 'dw')} SELECT w AS word, norm AS normal FROM nw",
    "possessive_fns": rf"WITH p AS (SELECT p_partkey, {_POSSESSIVE} AS possessive FROM part) SELECT p_partkey, possessive, regexp_matches(possessive, '[\p{{L}}\p{{M}}\p{{N}}_](?:''s|s'')(?:\s|$)') AS is_possessive, {_NONPOSSESSIVE.format(x='possessive')} AS plain FROM p",
    "plural_fns": f"""{_WORDS}, ph AS (SELECT word, word || ' of things' AS phrase FROM dw), ph2 AS (SELECT *, regexp_extract(phrase, {_q(_OF)}, 1) AS h, regexp_extract(phrase, {_q(_OF)}, 2) AS tl, regexp_extract(phrase, {_q(_PHRASE_HEAD)}, 1) AS h2, regexp_extract(phrase, {_q(_PHRASE_HEAD)}, 2) AS t2 FROM ph)
SELECT word, {_rules("word", PLURAL)} AS plural, {_rules("word", SINGULAR_PHRASE)} AS singular, word <> {_rules("word", SINGULAR_PHRASE)} AS is_plural,
  ({_rules("h2", PLURAL)}) || t2 AS phrase_plural, CASE WHEN regexp_matches(phrase, {_q(_OF)}) THEN ({_rules("h", SINGULAR_PHRASE)}) || tl ELSE {_rules("phrase", SINGULAR_PHRASE)} END AS phrase_singular FROM ph2""",
    "root_words": f"{_WORDS} SELECT word, {_rules('word', ROOT)} AS root, {_UNDETERMINED.format(x='lower(word)')} AS undetermined FROM dw",
    "canonical_urls": rf"WITH c AS (SELECT page_id, {_canonical('url')} AS c FROM pages) SELECT page_id, c AS canonical, {_protocol('c')} AS absolute, regexp_replace(c, '/([^/]+)$', '/source/\1') AS source, url_decode(c) AS unescaped FROM c",
    "name_fns": r"WITH p AS (SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS t FROM pages), q AS (SELECT *, regexp_extract(t, '^(\w*)', 1) AS d FROM p) SELECT page_id, regexp_replace(regexp_replace(t, '\([^)]*\)', '', 'g'), ':.*$', '') AS cleaned, regexp_replace(lower(regexp_extract(t, '([^(]+)', 1)), '\s+$', '') AS concept, regexp_replace(t || '  ', '\s+$', '') AS trimmed, CASE WHEN d <> '' THEN upper(substr(d, 1, 1)) || lower(substr(d, 2)) END AS domain FROM q",
    "firstword_split": rf"SELECT p_partkey, nullif(regexp_extract(p_name, {_q('^(' + WORD + ')')}, 1), '') AS firstword, CASE WHEN regexp_extract(p_name, {_q('^(' + WORD + ')')}, 1) <> '' THEN regexp_extract(p_name, {_q('^' + WORD + chr(92) + 's?(.*)$')}, 1) END AS tailwords FROM part",
    "admissible_names": f"SELECT conv_id, turn, name FROM (SELECT conv_id, turn, unnest(regexp_split_to_array(text, '[.!?\\n]+ *')) AS name FROM conversations) WHERE regexp_matches(name, {_q(PHRASE)})",
    "tag_to_concept": r"SELECT p_partkey, replace(regexp_replace(regexp_replace(lower('ab.' || replace(p_name, ' ', '-') || '-' || p_size), '^[a-z][a-z]\.', ''), '(^|[^0-9])-', '\1 ', 'g'), 'semi ', 'semi-') AS concept FROM part",
    "concept_dictionary": f"WITH {_DICTIONARY} SELECT {_CONCEPT} FROM dict",
    "dictionary_probe": f"{_WORDS}, {_DICTIONARY}, {_normal('nw', 'dw')} SELECT w AS word, conceptid, concept FROM nw JOIN dict ON firstword = norm WHERE norm <> '' AND domain = 'alpha'",
    "stopword_antijoin": f"{_WORDS}, {_STOP} SELECT word FROM dw WHERE NOT EXISTS (SELECT 1 FROM stop WHERE stop = lower(word))",
    "phrase_longest_match": f"{_LINKED} SELECT {_MATCH}, n_words FROM lng",
    "link_spans_greedy": f"{_LINKED} SELECT {_MATCH} FROM gr",
    "multilink_merge": f"{_LINKED} SELECT {_FLAT} FROM mg",
    "first_occurrence": f"{_LINKED} SELECT {_FLAT} FROM fo",
    "self_link_filter": f"{_LINKED} SELECT {_MATCH} FROM mg WHERE {_canonical('link')} <> 'example.org/' || doc_id",
    "domain_filter": f"{_LINKED} SELECT {_MATCH} FROM fo WHERE domain = 'beta'",
    "html_skip_depth": f"WITH {_SEGMENTS} SELECT doc_id, pos, off AS \"offset\", length(piece) AS n, depth FROM hs",
    "html_text_runs": f"WITH {_SEGMENTS} SELECT doc_id, off AS \"offset\", text FROM hr",
    "html_text_length": f"WITH {_SEGMENTS} SELECT doc_id, CAST(sum(length(text)) AS BIGINT) AS text_length FROM hr GROUP BY 1",
    "html_links": f"WITH RECURSIVE {_SEGMENTS},{_tokens('tok', 'hr')}, {_DICTIONARY}, {_matching()} SELECT {_MATCH} FROM gr",
    "harvest_pages": f"WITH {_HARVEST} SELECT page, concept, url, category AS categories, array_to_string(synonyms, ',') AS synonyms FROM hv",
    "flatten_harvest": f"WITH {_HARVEST} SELECT page, concept, category, scheme, url FROM hb_f",
    "harvest_diff_delete": f"WITH {_REVISIONS} SELECT * FROM old WHERE NOT EXISTS (SELECT 1 FROM new WHERE new.concept = old.concept AND new.category = old.category)",
    "harvest_diff_add": f"WITH {_REVISIONS} SELECT * FROM new WHERE NOT EXISTS (SELECT 1 FROM old WHERE new.concept = old.concept AND new.category = old.category)",
    "harvest_unchanged": f"WITH {_REVISIONS} SELECT * FROM old WHERE EXISTS (SELECT 1 FROM new WHERE new.concept = old.concept AND new.category = old.category)",
    "upsert_objects": "WITH o AS (SELECT item_id AS objectid, 'example.org/' || item_id AS url FROM benchmark), n AS (SELECT DISTINCT url FROM pages WHERE url NOT IN (SELECT url FROM o)) SELECT objectid, url, 'alpha' AS domain FROM o UNION ALL SELECT (SELECT max(objectid) FROM o) + row_number() OVER (ORDER BY url), url, 'pages' FROM n",
    "upsert_concepts": f"WITH {_DICTIONARY}, s AS (SELECT split_part(lower(p_name), ' ', 1) AS f, substr(lower(p_name), length(split_part(p_name, ' ', 1)) + 2) AS x, p_partkey FROM part) SELECT {_CONCEPT} FROM dict UNION ALL SELECT (SELECT max(conceptid) FROM dict) + row_number() OVER (ORDER BY p_partkey, f, x), f, x, '00-XX', 'msc', 'alpha', 'example.org', p_partkey FROM s",
    "delete_concepts": f"WITH {_DICTIONARY} SELECT {_CONCEPT} FROM dict WHERE domain <> 'beta'",
    "links_cache_build": f"{_KB} SELECT objectid, conceptid FROM edges",
    "links_cache_flush": f"{_KB} SELECT objectid, conceptid FROM edges WHERE conceptid IN (SELECT conceptid FROM dict WHERE domain <> 'gamma') OR objectid NOT IN (SELECT doc_id FROM documents WHERE lang = 'en')",
    "invalidate_urls": f"{_KB} SELECT url FROM edges JOIN objects USING (objectid) WHERE conceptid IN (SELECT conceptid FROM dict WHERE domain = 'beta')",
    "merge_snapshots": f"""{_SNAPSHOTS} SELECT c2.conceptid, firstword, tailwords, category, domain, link, o2.objectid, url FROM c2 JOIN o2 ON o2.s = c2.s AND o2.id = c2.objectid""",
    "merge_snapshot_links": f"""{_SNAPSHOTS} SELECT o2.objectid, c2.conceptid FROM (SELECT 0 AS s, * FROM edges UNION ALL SELECT 1, * FROM edges) e
  JOIN c2 ON c2.s = e.s AND c2.old = e.conceptid JOIN o2 ON o2.s = e.s AND o2.id = e.objectid""",
    "links_of_concept": f"{_KB} SELECT objectid FROM edges WHERE conceptid = (SELECT min(conceptid) FROM edges)",
    "refresh_objects": "WITH o AS (SELECT item_id AS objectid, 'example.org/' || item_id AS url FROM benchmark) SELECT objectid, url, true AS refreshed FROM o WHERE url IN (SELECT 'example.org/' || doc_id FROM documents) UNION ALL SELECT objectid, url, false FROM o WHERE url NOT IN (SELECT 'example.org/' || doc_id FROM documents)",
    "msc_similarity_pairs": f"""WITH {_DICTIONARY}, m(i, j, sim) AS (VALUES {_matrix()}), c AS (SELECT DISTINCT category FROM dict),
p AS (SELECT a.category AS category1, b.category AS category2 FROM c a, c b UNION ALL SELECT 'XX-XX', '00-XX')
SELECT category1, category2, round(coalesce(sim, 0.0), 8) AS sim FROM p LEFT JOIN m ON i = list_position({_CODES}, substr(category1, 1, 2)) - 1 AND j = list_position({_CODES}, substr(category2, 1, 2)) - 1""",
    "msc_log_similarity": f"WITH m(i, j, sim) AS (VALUES {_matrix()}) SELECT i, j, round(CASE WHEN sim > 0 THEN ln(CAST(sim AS DOUBLE)) ELSE (SELECT min(ln(CAST(sim AS DOUBLE))) - 1 FROM m WHERE sim > 0) END, 6) AS log_sim FROM m",
    "eligible_candidates": f"{_ELIGIBLE} SELECT {_MATCH}, msc_index FROM dl",
    "category_weights": f"{_ELIGIBLE} SELECT * FROM cw",
    "category_ranking": f"{_ELIGIBLE} SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY CAST(weight AS VARCHAR) DESC, msc_index) AS INTEGER) AS place FROM cw",
    "annotate_html": _embed_sql(None, False, {"alpha": "http://example.org/a.ico", "beta": "http://example.org/b.ico"}),
    "annotate_rdfa": _embed_sql("alpha", True, {"alpha": "http://example.org/a.ico"}),
    "standoff_spans": f"{_LINKED}, {_links_sql(None)} SELECT doc_id, b AS offset_begin, e AS offset_end, array_to_string([links[i] || '|' || domains[i] FOR i IN range(1, c + 1)], ',') AS links FROM sl",
    "standoff_merged_json": f"""{_LINKED}, js AS (SELECT doc_id, b, conceptid, '{{"offset_begin":' || b || ',"offset_end":' || e || ',"conceptid":' || conceptid || ',"concept":"' || concept || '","category":"' || category
  || '","scheme":"' || scheme || '","domain":"' || domain || '","link":"' || {_protocol("link")} || '"' || CASE WHEN multilinks IS NULL THEN '' ELSE ',"multilinks":[' || array_to_string(['"' || {_protocol("x")} || '"' FOR x IN multilinks], ',') || ']' END || '}}' AS j FROM mg)
SELECT doc_id, '[' || string_agg(j, ',' ORDER BY b, conceptid) || ']' AS payload FROM js GROUP BY doc_id""",
    "crawl_bfs": _CRAWL,
}
