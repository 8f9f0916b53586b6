"""Secrets in texts: fixed patterns, and strings that stay novel to a primed compressor.

The second kind starts from candidates: long runs of key-like characters, with
letters and digits, that begin soon after a word of a sensitive context. A
zstandard compressor is primed with common identifiers of code and with the text
around the candidate. What the candidate then adds to the compressed size, in
bits for each character, is its novelty: names and words that the code around or
the dictionary has cost little, random strings cost their entropy.

All offsets are code points of the whole text, ends exclusive.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame

# The base patterns, their kinds in order, and their least lengths.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII,
)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "novel")
ASSIGNED = 12
_NAMES = ("password", "passwd", "secret", "token", "api")

CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_.-])[A-Za-z0-9+/_.-]{16,}={0,2}")
SENSITIVE = re.compile(
    r"pass(?:word|wd|phrase)|pwd|secret|token|api.?key|auth|credential|bearer|private.?key"
    r"|access.?key|signature",
    re.IGNORECASE | re.ASCII,
)
#: A candidate begins at most so many characters after a sensitive word.
REACH = 64
#: Characters of text on either side that prime the compressor.
AROUND = 2_000
#: Bits for each character from which a candidate is reported.
NOVELTY = 3.0
LEVEL = 19
PLACEHOLDER = "[SECRET]"

IDENTIFIERS = """
abstract access account action address admin after append application argument array assert
async attribute auth authorization await base64 before begin bearer boolean break buffer build
byte cache call callback catch channel char check class client close code column command commit
config connect connection const constructor content context continue cookie count create
credential current data database date debug decode default delete description destination
device dict directory document domain double email enable encode encoding endpoint entry enum
environment error event example exception execute export extends false field file filter final
finally float folder format from function generate global group handle handler hash header host
http https identifier image import include index init input insert instance integer interface
invalid item iterator json key label lambda language length level library license limit list
load local localhost location lock logger login long main manager map match message metadata
method model module name namespace native network node null number object offset open operation
option output package page param parent parse password path pattern payload permission pointer
policy port prefix private process profile project property protected protocol provider public
query queue random read record redirect reference refresh register release remote remove render
replace request require resource response result return role route sample schema scope script
search secret section select send sequence server service session setting signature size socket
source stack start state static status stream string struct style submit switch system table tag
target task template test text thread throw time timeout timestamp title token transaction true
type undefined unique update upload user username uuid value variable vector version view void
while window worker write yaml zone
"""  # words are matched anywhere, so their order is of no matter


class Span(NamedTuple):
    start: int
    kind: int
    end: int

    def __str__(self) -> str:
        return f"{KINDS[self.kind]}:{self.start}:{self.end}"


def base_spans(text: str) -> list[Span]:
    """The matches of the base patterns, by start and then kind.

    A run that is too short is dropped as a match and not searched again. For keys
    and hex digits a pattern with the least length gives the same matches, as a run
    has no longer match inside.
    """
    found: list[Span] = []
    lower = text.lower()
    if any(x in lower for x in _NAMES):
        found += [
            Span(m.start(), 0, m.end())
            for m in ASSIGN.finditer(text)
            if m.end(2) - m.start(2) >= ASSIGNED
        ]
    if "AKIA" in text:
        found += [Span(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [Span(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def candidates(text: str) -> list[tuple[int, int]]:
    """Key-like runs with letters and digits that begin within reach of a sensitive word."""
    runs: dict[int, int] = {}
    for word in SENSITIVE.finditer(text):
        at, reach = word.end(), word.end() + REACH
        # A search that may not go on past the reach, then the whole run from there.
        while near := CANDIDATE.search(text, at, reach + 16):
            start = near.start()
            if start > reach:
                break
            if start not in runs:
                whole = CANDIDATE.match(text, start)
                runs[start] = whole.end() if whole else near.end()
            at = runs[start]
    return [
        (start, end)
        for start, end in sorted(runs.items())
        if re.search("[0-9]", text[start:end]) and re.search("[A-Za-z]", text[start:end])
    ]


def novelty(text: str, start: int, end: int) -> float:
    """Bits for each character that ``text[start:end]`` adds to what is around it."""
    before, after = text[max(0, start - AROUND) : start], text[end : end + AROUND]
    primed = zstandard.ZstdCompressionDict(
        f"{IDENTIFIERS}{after}\n{before}".encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT
    )
    zstd = zstandard.ZstdCompressor(level=LEVEL, dict_data=primed, write_content_size=False)
    added = len(zstd.compress(text[start:end].encode())) - len(zstd.compress(b""))
    return 8 * added / (end - start)


def find(text: str | None) -> tuple[list[Span], list[Span]]:
    """The base spans, and all spans: those and novel strings that overlap none of them."""
    text = text or ""
    base = base_spans(text)
    found = list(base)
    k, reached = 0, 0
    for start, end in candidates(text):
        while k < len(base) and base[k].start < end:
            reached = max(reached, base[k].end)
            k += 1
        if reached <= start and novelty(text, start, end) >= NOVELTY:
            found.append(Span(start, 3, end))
    return base, sorted(found)


def redact(text: str, spans: list[Span]) -> str:
    """The text with a placeholder for each run of overlapping spans."""
    out, at = [], 0
    for span in spans:
        if span.start >= at:
            out += [text[at : span.start], PLACEHOLDER]
        at = max(at, span.end)
    return "".join([*out, text[at:]])


SCANNED = (
    "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, "
    "spans string, n_novel long"
)


def scan(docs: DataFrame) -> DataFrame:
    """Per row of ``docs (doc_id, text)`` its counts, digest and spans; null texts are empty.

    Columns are those of ``SCANNED``. Rows are independent: no shuffle, nothing kept.
    """
    types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
    names = [x.split()[0] for x in SCANNED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1):
                base, spans = find(text.as_py())
                n = [sum(x.kind == k for x in spans) for k in range(len(KINDS))]
                digest = hashlib.sha256(",".join(map(str, base)).encode()).hexdigest()
                rows.append((*n[:3], digest, ",".join(map(str, spans)), n[3]))
            columns = zip(*rows, strict=True) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays(
                [batch.column(0)]
                + [pa.array(x, t) for x, t in zip(columns, types[1:], strict=True)],
                names=names,
            )

    return docs.select("doc_id", "text").mapInArrow(run, SCANNED)


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with a placeholder for each secret in ``text``, and ``n_chars`` to fit.

    Other columns and rows stay. Null texts stay null.
    """
    text_at = docs.columns.index("text")
    chars_at = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text in (x.as_py() for x in batch.column(text_at)):
                spans = find(text)[1]
                texts.append(redact(text, spans) if spans else text)
            columns = list(batch.columns)
            columns[text_at] = pa.array(texts, columns[text_at].type)
            if chars_at is not None:
                lengths = pc.utf8_length(columns[text_at]).cast(columns[chars_at].type)
                columns[chars_at] = lengths
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)
