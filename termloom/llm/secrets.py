"""Secret scan by dictionary-primed zstandard novelty."""

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame

from termloom.llm import _vec

WORDS = r"password|passwd|passphrase|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credentials?|authorization|bearer"
RUN = r"[A-Za-z0-9+/_=.~-]"
AHEAD = 32  # characters of a line in which a sensitive word may stand before its string
LEAST = 12  # characters of a candidate
AROUND = 256  # characters on each side that prime the compressor, besides the dictionary
MARGINAL = 8  # least marginal bytes
NOVELTY = 0.5  # least marginal bytes for each character
# a value that is assigned after a sensitive word: quoted, or up to a blank, quote, <, > or the next parameter of a URL
ASSIGNED = re.compile(r"""[\w.\]-]{0,24}["']?\s*(?:=>|:=|=|:)\s*(?:"([^"\s]+)"|'([^'\s]+)'|((?:(?!&\w+=)[^\s"'<>])+))""")
SHORT = 8  # characters of an assigned value, if not all are letters
ASSIGNED_NOVELTY = 0.8  # least marginal bytes for each of its characters; random ones take 0.85 and more in any alphabet
PEM = re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----\s([A-Za-z0-9+/=\s]+?)-----END")
SCHEMA = "doc_id long, offset_begin int, offset_end int, context string, n_chars int, marginal_bytes int, novelty double"

IDENTIFIERS = (
    "abstract access_token account admin api_key apikey application argument array assert async attribute auth authorization await "
    "background basic bearer boolean break buffer cache callback case catch certificate change_me changeme char class client client_id "
    "client_secret config configuration connection const constructor content context continue controller cookie credentials data database "
    "default define delete description development disabled document double dummy else enabled encoding endpoint environment error event "
    "example example.com exception export extends false file filename final finally float foreach format function generate global handler "
    "hash header hidden hostname http https identifier implements import index input insert instance integer interface internal iterator "
    "json key lambda language length library localhost logger login manager message method model module namespace null number object "
    "option optional output override package parameter parser password passwd passphrase path placeholder placeholder_value port prefix "
    "print private private_key process production property protected protocol public public_key query raise redacted refresh_token "
    "register remote request require response return sample schema secret secret_key select server service session setting signature "
    "socket source static status std::string storage stream string struct super switch system table template test_token testing this throw "
    "timeout timestamp token true type typedef undefined union unsigned update upload url user username uuid value variable vector version "
    "virtual void volatile while width window xxxxxxxxxxxxxxxx yield your_api_key your_password_here your_secret_key your_token_here "
    "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789 00000000000000000000 12345678901234567890 deadbeefdeadbeef"
)


def scanner(identifiers: str = IDENTIFIERS):  # noqa: ANN201
    """text -> [(begin, end, context, marginal bytes, novelty)]; one for each task."""
    context = re.compile(WORDS, re.I)
    run, start = re.compile(f"{RUN}+"), re.compile(f"{RUN}+")
    primed = zstandard.ZstdCompressor(level=6, dict_data=zstandard.ZstdCompressionDict(identifiers.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False)

    def scan(text: str) -> list[tuple[int, int, str, int, float]]:
        out, done = [], -1

        def report(begin: int, end: int, word: str, least: float) -> None:
            nonlocal done
            value = text[begin:end]
            before, after = text[max(0, begin - AROUND) : begin], text[end : end + AROUND]
            around = (after + before).replace(value, "").encode("utf-8", "replace")  # a secret doesn't vouch for itself
            marginal = len(primed.compress(around + value.encode("utf-8", "replace"))) - len(primed.compress(around))
            novelty = marginal / len(value)
            if marginal >= MARGINAL and novelty >= least:
                out.append((begin, end, word.lower(), marginal, novelty))
                done = end

        for block in PEM.finditer(text):
            body = block.group(1)
            if body.strip():
                report(block.end(1) - len(body.lstrip()), block.start(1) + len(body.rstrip()), "private key", NOVELTY)
        blocks, done = [(b, e) for b, e, *_ in out], -1
        assigned = run_end = tried = -1  # ends of the last assigned value, of the last run, and of the last run that was judged
        for word in context.finditer(text):
            if word.end() >= assigned and (m := ASSIGNED.match(text, word.end())):
                begin, assigned = m.span(m.lastindex)
                end = assigned if m.lastindex < 3 else begin + len(text[begin:assigned].rstrip(",;)]}."))
                value = text[begin:end]
                odd = m.lastindex < 3 or not value.isalpha() or not (value.islower() or value[1:].islower())  # prose may follow a colon
                if begin >= done and len(value) >= (LEAST if value.isalpha() else SHORT) and odd and not any(b < end and begin < e for b, e in blocks):
                    report(begin, end, word.group(), ASSIGNED_NOVELTY)
            line = text.find("\n", word.end(), word.end() + AHEAD + 1)
            limit = word.end() + AHEAD + 1 if line < 0 else line
            for s in start.finditer(text, word.end(), limit):  # beginnings of runs; where a run goes on beyond is looked up once
                if s.start() >= run_end:
                    run_end = run.match(text, s.start()).end()
                if run_end - s.start() < LEAST or run_end == tried:
                    continue
                # "password=x" is one run for the pattern: an assignment mark parts it
                begin, end = s.start(), run_end
                while begin < end and text[begin] in "=_.~/+-":
                    begin += 1
                while end > begin and text[end - 1] in "=.~-":
                    end -= 1
                if begin - word.end() > AHEAD:
                    break
                if begin < done or end - begin < LEAST:
                    continue
                tried = run_end
                value = text[begin:end]
                if not (any(c.isdigit() for c in value) and any(c.isalpha() for c in value)):
                    continue
                if not any(b < end and begin < e for b, e in blocks):
                    report(begin, end, word.group(), NOVELTY)
        return out

    return scan


def find(docs: DataFrame, identifiers: str = IDENTIFIERS) -> DataFrame:
    """One row for each secret of each row of docs, at character offsets [offset_begin, offset_end) of its text.

    A candidate is a value of at least SHORT characters of any kind that is assigned (=, :) to a sensitive word, on the next line at
    the farthest; it takes ASSIGNED_NOVELTY. So is the body of a PEM block of a private key. Another candidate is a run of at least LEAST letters, digits and +/_=.~- with a digit and a letter, on the same line as and at
    most AHEAD characters after a sensitive word. It is reported if adding it to the text around it (AROUND characters on
    both sides) costs the compressor, primed with the identifier dictionary, at least MARGINAL bytes and NOVELTY bytes
    for each character: sequences, placeholders and variants of what stands close by are cheap and aren't reported. A
    string that is repeated is held against the text without any of its copies, so each copy is reported.

    A sensitive word within an assigned value that was measured is no context for another. Time is linear in a text's length.

    Null and empty texts give no rows; texts are scanned whole; repeated rows give repeated results; a null doc_id is
    reported as null; the string itself isn't returned; other columns aren't read. A map: nothing is shuffled.
    """

    def scan_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = scanner(identifiers)
        for batch in batches:
            maybe = batch.filter(pc.fill_null(pc.match_substring_regex(batch.column("text"), WORDS + "|PRIVATE KEY-----", ignore_case=True), False))
            rows = [(d, *x) for d, text in zip(maybe.column("doc_id").to_pylist(), maybe.column("text").to_pylist()) for x in scan(text)]
            if rows:
                d, b, e, c, m, n = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(d, pa.int64()), pa.array(b, pa.int32()), pa.array(e, pa.int32()), pa.array(c), pa.array([y - x for x, y in zip(b, e)], pa.int32()), pa.array(m, pa.int32()), pa.array(n)],
                    names=["doc_id", "offset_begin", "offset_end", "context", "n_chars", "marginal_bytes", "novelty"],
                )

    return docs.select("doc_id", "text").mapInArrow(_vec.lean(scan_all), SCHEMA)
