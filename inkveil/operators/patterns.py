"""The pattern engine: entities of documents by regular expressions, with character spans."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame

# Fixed values: (entity type, pattern name, expression, score, whether it looks around), matched without regard to case.
PATTERNS = (
    ("PERSON_P", "person_first_last", r"\b[ÆØÅA-Z][æøåa-z]+(?:-[ÆØÅA-Z][æøåa-z]+)?(?:\s+[ÆØÅA-Z][æøåa-z]+(?:-[ÆØÅA-Z][æøåa-z]+)?)+\b(?!\s+(?:gate|vei|veien|gata|veg|vegen|kommune)\b)", 0.55, True),
    ("PERSON_P", "person_single_labeled", r"(?<=\b(?:navn|fornavn|etternavn)\s*:?\s*)[ÆØÅA-Z][æøåa-z]{2,}\b", 0.70, True),
    ("NO_FODSELSNUMMER_P", "fodselsnummer_pattern", r"\b\d{6}\s?\d{5}\b", 0.90, False),
    ("NO_FODSELSNUMMER_P", "fodselsnummer_strict", r"\b[0-3]\d[0-1]\d\d\d\s?\d{5}\b", 0.95, False),
    ("NO_PHONE_NUMBER_P", "norwegian_phone_flex", r"(?<!\d)(?:\+47|0047)?\s*(?:\d[\s\-]?){7}\d(?!\d)", 0.70, True),
    ("NO_PHONE_NUMBER_P", "norwegian_phone_plain", r"(?<!\d)\d{8}(?!\d)", 0.50, True),
    ("NO_ADDRESS_P", "street_postcode_city", r"\b[ÆØÅA-Z][\wÆØÅæøå.\- ]+?\s+\d+\s*[A-Za-z]?(?:\s*[A-Za-z]\d+)?\s*,?\s*\d{4}\s+[A-ZÆØÅæøå][A-Za-zÆØÅæøå]*(?:\s+[A-ZÆØÅæøå][A-Za-zÆØÅæøå]*)*\b", 0.90, False),
    ("NO_ADDRESS_P", "street_and_number", r"\b[ÆØÅA-Z][A-Za-zÆØÅæøå.\- ]+(?:gate|gata|vei|veien|veg|vegen|plass|allé|alle|tun)\s+\d+\s*[A-Za-z]?\b", 0.60, False),
    ("NO_BANK_ACCOUNT_P", "bank_account_pattern", r"\b\d{4}[.\s]?\d{2}[.\s]?\d{5}\b", 0.85, False),
    ("NO_BANK_ACCOUNT_P", "bank_account_with_prefix", r"\b(?:kontonr\.?|kontonummer:?|bankkontonummer:?|konto:?)\s*\d{4}[.\s]?\d{2}[.\s]?\d{5}\b", 0.90, False),
    ("NO_COMPANY_NUMBER_P", "company_number_pattern", r"\b(?:org\.?(?:anisasjons)?nr\.?:?\s?)?\d{3}[\s]?\d{3}[\s]?\d{3}\b", 0.85, False),
    ("NO_COMPANY_NUMBER_P", "company_number_with_prefix", r"\b(?:organisasjonsnummer|organisasjonsnr|orgnr|org\.nr\.|org\s?nr)\.?:?\s*\d{3}[\s]?\d{3}[\s]?\d{3}\b", 0.90, False),
    ("NO_LICENSE_PLATE_P", "license_plate_pattern", r"\b[A-Z]{2}[\s]?\d{4,5}\b", 0.85, False),
    ("NO_LICENSE_PLATE_P", "license_plate_with_prefix", r"\b(?:reg\.?(?:istrerings)?nr\.?|bilnr\.?|bilskilt:?)\s*[A-Z]{2}[\s]?\d{4,5}\b", 0.90, False),
    ("EMAIL_ADDRESS_P", "email_pattern_unicode", r"\b[A-Za-z0-9._%+\-ÆØÅæøå]+@[A-Za-z0-9.\-ÆØÅæøå]+\.[A-Za-zÆØÅæøå]{2,}\b", 0.95, False),
    ("EMAIL_ADDRESS_P", "email_with_prefix_unicode", r"\b(?:e-post|epost|mail|e-mail):?\s*[A-Za-z0-9._%+\-ÆØÅæøå]+@[A-Za-z0-9.\-ÆØÅæøå]+\.[A-Za-zÆØÅæøå]{2,}\b", 0.95, False),
    ("DATE_TIME_P", "norwegian_date_numeric", r"\b(?:0?[1-9]|[12][0-9]|3[01])\.(?:0?[1-9]|1[0-2])\.\d{2,4}\b", 0.60, False),
    ("DATE_TIME_P", "norwegian_date_time", r"\b(?:0?[1-9]|[12][0-9]|3[01])\.(?:0?[1-9]|1[0-2])\.\d{2,4}\s+(?:[01]?\d|2[0-3]):[0-5]\d\b", 0.70, False),
    ("DATE_TIME_P", "iso_date_pattern", r"\b\d{4}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01])\b", 0.60, False),
    ("DATE_TIME_P", "norwegian_text_date", r"\b(?:0?[1-9]|[12][0-9]|3[01])\.?\s*(?:januar|februar|mars|april|mai|juni|juli|august|september|oktober|november|desember)\s*\d{2,4}\b", 0.70, False),
    ("CRYPTO_P", "bitcoin_address", r"\b(bc1|[13])[a-zA-HJ-NP-Z0-9]{25,39}\b", 0.85, False),
    ("CRYPTO_P", "ethereum_address", r"\b0x[a-fA-F0-9]{40}\b", 0.85, False),
    ("IBAN_CODE_P", "iban_pattern", r"\bNO\d{2}\s?\d{4}\s?\d{4}\s?\d{3}\b", 0.90, False),
    ("IP_ADDRESS_P", "ipv4_pattern", r"\b(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\b", 0.90, False),
    ("IP_ADDRESS_P", "ipv6_simple_pattern", r"\b(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}\b", 0.90, False),
    ("URL_P", "url_pattern", r"https?://(?:[-\w.]|(?:%[\da-fA-F]{2}))+[^\s,]", 0.70, False),
    ("URL_P", "domain_pattern", r"\b(?:[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?\.)+[a-z0-9][a-z0-9-]{0,61}[a-z0-9]\b", 0.70, False),
    ("MEDICAL_LICENSE_P", "norwegian_hpr_number", r"\bHPR-(?:\d{7}|[A-Z0-9]{9})\b", 0.90, False),
)
#: The patterns that DuckDB has expressions for, and the others.
PLAIN = tuple(p for p in PATTERNS if not p[4])
LOOKING = tuple(p for p in PATTERNS if p[4])
#: What a text, in lower case, must hold for a pattern to match at all; DIGIT is any decimal digit. A pattern that isn't named needs one.
DIGIT = None
NEEDS = {
    "person_first_last": "", "person_single_labeled": "navn", "email_pattern_unicode": "@", "email_with_prefix_unicode": "@", "ethereum_address": "0x", "norwegian_hpr_number": "hpr-", "url_pattern": "://", "domain_pattern": ".",
    "ipv6_simple_pattern": ":",
}

Spans = Iterator[tuple[int, int]]
_FLAGS = re.IGNORECASE
_LETTER, _LETTERS = "[ÆØÅA-Z]", "[A-Za-zÆØÅæøå"


def _named(name: str) -> str:
    return next(p[2] for p in PATTERNS if p[1] == name)


def _everywhere(expression: str) -> Callable[[str], Spans]:
    rx = re.compile(expression, _FLAGS)
    return lambda text: (m.span() for m in rx.finditer(text))


def _in_runs(name: str, alphabet: str, core: str) -> Callable[[str], Spans]:
    """Matches of an expression that holds `core`, all of whose characters and all word characters are in `alphabet`, within the runs of such characters that hold the core."""
    rx, runs, held = re.compile(_named(name), _FLAGS), re.compile(f"{alphabet}+"), re.compile(core, _FLAGS)

    def spans(text: str) -> Spans:
        if held.search(text):
            for run in runs.finditer(text):
                if held.search(run[0]):
                    for m in rx.finditer(text, run.start(), run.end()):
                        yield m.span()

    return spans


def _before_core(first: str, inner: str, core: str, lazy: bool) -> Callable[[str], Spans]:
    """Matches of `\\b first inner+ core` (`lazy`: inner+?), where `inner` is a class that holds `first`.

    Tried from each letter, such an expression reads the rest of the run of `inner` from each of them. Here the places of the core are found
    first; a match then starts at the run's first letter and takes the run's first core (`lazy`), or the last. Where a core starts with white
    space, of a longer space only its first two places can be taken."""
    word, gap, ends = re.compile(rf"\b{first}", _FLAGS), re.compile(f"[^{inner[1:]}", _FLAGS), re.compile(core, _FLAGS)
    spaced = core.startswith(r"\s")
    places = re.compile(rf"{r'(?<!\s)' if spaced else ''}(?={core})", _FLAGS)

    def spans(text: str) -> Spans:
        at = [m.start() for m in places.finditer(text)]
        if not at:
            return
        at = sorted({x for k in at for x in ([k, k + 1] if spaced and text[k + 1 : k + 2].isspace() else [k])})
        gaps = [-1, *(m.start() for m in gap.finditer(text))]
        done = i = 0
        while i < len(at):
            start = gaps[bisect_left(gaps, at[i]) - 1] + 1  # of the run that ends with the character before the core
            m = word.search(text, max(start, done), at[i])
            if not m or m.start() + 2 > at[i]:
                i += 1
                continue
            if not lazy:
                stop = gaps[k] if (k := bisect_left(gaps, at[i])) < len(gaps) else len(text)
                while i + 1 < len(at) and at[i + 1] <= stop:
                    i += 1
            done = ends.match(text, at[i]).end()
            yield m.start(), done
            while i < len(at) and at[i] < done:
                i += 1

    return spans


def _labelled(text: str) -> Spans:
    """Names behind a label. What may stand between label and name is white space and a colon, so a label allows for one place."""
    done = 0
    for label in _LABEL.finditer(text):
        m = _NAME.match(text, label.end())
        if m and m.start() >= done:
            done = m.end()
            yield m.span()


_LABEL, _NAME = re.compile(r"\b(?:navn|fornavn|etternavn)\s*:?\s*", _FLAGS), re.compile(r"[ÆØÅA-Z][æøåa-z]{2,}\b", _FLAGS)
_CITY = r"[A-ZÆØÅæøå][A-Za-zÆØÅæøå]*"
#: Ways to find the matches of an expression in time that grows with the text only, for those that would try a long stretch of a text from each of its places.
_OTHER_WAYS = {
    "person_single_labeled": _labelled,
    "norwegian_phone_flex": _everywhere(r"(?<!\d)(?:(?!\s)|(?<!\s)|(?<=\d\s))(?:\+47|0047)?\s*(?:\d[\s\-]?){7}\d(?!\d)"),  # within white space, only its beginning can be the first place
    "street_postcode_city": _before_core(_LETTER, r"[\wÆØÅæøå.\- ]", rf"\s+\d+\s*[A-Za-z]?(?:\s*[A-Za-z]\d+)?\s*,?\s*\d{{4}}\s+{_CITY}(?:\s+{_CITY})*\b", True),
    "street_and_number": _before_core(_LETTER, r"[A-Za-zÆØÅæøå.\- ]", r"(?:gate|gata|vei|veien|veg|vegen|plass|allé|alle|tun)\s+\d+\s*[A-Za-z]?\b", False),
    "email_pattern_unicode": _in_runs("email_pattern_unicode", r"[\w.%+\-@]", "@"),
    "domain_pattern": _in_runs("domain_pattern", r"[\w.\-]", r"[a-z0-9]\.[a-z0-9]"),
}


def finder(patterns: tuple = PATTERNS) -> Callable[[str], Iterator[tuple[int, int, int]]]:
    """A function that gives (number of the pattern, start, end) for all matches in a text. Only the patterns whose needs the text meets go over it, each once."""
    own = [(i, NEEDS.get(p[1], DIGIT), _OTHER_WAYS.get(p[1]) or _everywhere(p[2])) for i, p in enumerate(patterns)]
    digit = re.compile(r"\d")

    def find(text: str) -> Iterator[tuple[int, int, int]]:
        low, digits = text.lower(), digit.search(text) is not None
        for i, needs, spans in own:
            if digits if needs is DIGIT else needs in low:
                for start, end in spans(text):
                    yield i, start, end

    return find


#: Entities that a task holds at once.
MOST_FOUND = 10_000


def detect(docs: DataFrame, patterns: tuple = PLAIN) -> DataFrame:
    """Rows (doc_id, entity_type, pattern, start, end, score, original_text). Offsets count characters from 0.

    A text is read once; literals and digits in it say which patterns can match, and each of those goes over it once, in time that grows with
    the text (see _OTHER_WAYS). Word characters are letters and digits of any script. Null and empty texts have no entities; repeated rows and null ids keep theirs."""
    find = finder(patterns)
    kinds, names, scores = ([p[k] for p in patterns] for k in (0, 1, 3))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = ((k, x.as_py() or "") for k, x in enumerate(batch.column(1)))
            found = ((k, i, a, b, text[a:b]) for k, text in texts for i, a, b in find(text))
            while some := list(islice(found, MOST_FOUND)):
                row, which, starts, ends, words = zip(*some)
                take = lambda x, t: pa.array([x[i] for i in which], t)
                out = [batch.column(0).take(pa.array(row, pa.int32())), take(kinds, pa.string()), take(names, pa.string()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), take(scores, pa.float64()), pa.array(words, pa.string())]
                yield pa.RecordBatch.from_arrays(out, ["doc_id", "entity_type", "pattern", "start", "end", "score", "original_text"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, entity_type string, pattern string, start int, end int, score double, original_text string")


def _quoted(s: str) -> str:
    return s.replace("'", "''")


#: Letters that DuckDB's expressions don't take for word characters; an underscore, which they do and which only the classes for e-mail name, stands in for each.
_WIDE = r"[À-ÄÇ-ÖÙ-äç-öù-ÿĀ-ɏ\p{Greek}\p{Cyrillic}\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}\p{Arabic}\p{Hebrew}\p{Devanagari}\p{Thai}]"


def detect_sql(patterns: tuple, source: str = "documents") -> str:
    """The same rows in DuckDB's SQL, of patterns without look-around."""
    one = "SELECT doc_id, '{k}' AS entity_type, '{n}' AS pattern, {v} AS score, text, unnest(list_transform(m, lambda x: length(x))) AS size, unnest(list_transform(range(1, len(m) + 1), lambda i: list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0))) AS start"
    return f"SELECT doc_id, entity_type, pattern, start::INT AS start, (start + size)::INT AS \"end\", score::DOUBLE AS score, substr(text, start::BIGINT + 1, size) AS original_text FROM (WITH wide AS (SELECT doc_id, text, regexp_replace(text, '{_WIDE}', '_', 'g') AS w FROM {source} WHERE text IS NOT NULL)\n" + "\nUNION ALL ".join(
        one.replace("{k}", k).replace("{n}", n).replace("{v}", str(v)) + f" FROM (SELECT doc_id, text, regexp_extract_all({c}, '(?i){_quoted(e)}') AS m, regexp_split_to_array({c}, '(?i){_quoted(e)}') AS g FROM wide)"
        for k, n, e, v, _ in patterns
        for c in ["text" if k == "EMAIL_ADDRESS_P" else "w"]
    ) + ")"


DETECT_SQL = detect_sql(PLAIN)
