"""Secret scans: patterns for known forms, and token efficiency for the rest.

A random string falls into many tokens of a BPE vocabulary, prose into few: a candidate with fewer than
``least_ratio`` characters a token is a secret of kind ``token``, unless it is a digest (hex of a known length), a
UUID, a number, or an identifier of the shape and the words of plain ones. Strings of letters alone need fewer than
``letters_ratio``, as long words of rare syllables come near ``least_ratio`` too. What is left of a candidate outside the spans
of known forms is tested too, and of one that isn't a secret as a whole each part between separators.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .bpe import _slices
from .common import others, settle, tick

KINDS = ("assign", "access", "hex", "token")
KEYS = ("password", "passwd", "secret", "token", "api_key", "apikey")
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")  # runs end where the characters do, so a length bound takes the same ones
HEX = re.compile(r"[0-9a-f]{16,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
DIGEST = re.compile(r"(?:[0-9A-Fa-f]{32}|[0-9A-Fa-f]{40}|[0-9A-Fa-f]{56}|[0-9A-Fa-f]{64}|[0-9A-Fa-f]{96}|[0-9A-Fa-f]{128})\Z")
UUID = re.compile(r"[0-9A-Fa-f]{8}-(?:[0-9A-Fa-f]{4}-){3}[0-9A-Fa-f]{12}\Z")
#: Runs are taken whole (possessive), so that a text is read once.
PLAIN = re.compile(r"(?:[A-Z]?[a-z]++|[A-Z]++|[0-9]++)(?:[-_/=+]*+(?:[A-Z]?[a-z]{2,}+|[A-Z]{2,}+|[0-9]++(?![A-Za-z])))*+[-_/=+]*+\Z")
PART = re.compile(r"[A-Za-z0-9]{16,}")
RUN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def vocabulary(path: str):  # noqa: ANN201
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("secrets", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _outside(start: int, end: int, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """A candidate's place; where base spans overlap it, those of its parts of 16 characters or more outside them."""
    cut = [(b, e) for b, _, e in base if b < end and e > start]
    if not cut:
        return [(start, end)]
    parts, at = [], start
    for b, e in cut:
        parts.append((at, b))
        at = max(at, e)
    return [(s, e) for s, e in [*parts, (at, end)] if e - s >= 16]


def _known(x: str, encoding, least_ratio: float) -> bool:  # noqa: ANN001
    """Whether each run of letters is one token or as long for its tokens as prose is."""
    counts = ((len(r), len(encoding.encode_ordinary(" " + r.lower()))) for r in RUN.findall(x))
    return all(n == 1 or k >= least_ratio * n for k, n in counts)


def _secret(x: str, encoding, least_ratio: float, letters_ratio: float) -> bool:  # noqa: ANN001
    if not any(c.isalpha() for c in x) or DIGEST.match(x) or UUID.match(x):
        return False
    if x.isalpha():
        least_ratio = min(least_ratio, letters_ratio)
    return len(x) < least_ratio * len(encoding.encode_ordinary(x)) and not (PLAIN.match(x) and _known(x, encoding, least_ratio))


def scan(text: str, encoding, least_ratio: float = 2.2, letters_ratio: float = 2.0) -> list[tuple[str, int, int]]:  # noqa: ANN001
    """(kind, start, end) by start, then kind; places in code points."""
    found: list[tuple[int, int, int]] = []
    low = text.lower()
    if any(k in low for k in KEYS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    base = sorted(found)
    for m in CANDIDATE.finditer(text):
        for s, e in _outside(m.start(), m.end(), base):
            if _secret(text[s:e], encoding, least_ratio, letters_ratio):
                found.append((s, 3, e))
            elif not UUID.match(text[s:e]):
                found += [(s + p.start(), 3, s + p.end()) for p in PART.finditer(text[s:e]) if p.end() - p.start() < e - s and _secret(p.group(), encoding, least_ratio, letters_ratio)]
    return [(KINDS[k], s, e) for s, k, e in sorted(found)]


SPAN = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
SPAN_ARROW = pa.list_(pa.field("element", pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))


def scan_documents(docs: DataFrame, vocabulary_file: str, text: str = "text", spans: str = "spans", redacted: str | None = None) -> DataFrame:
    """Add ``spans`` (array of kind, start, end) and, if named, ``redacted``: the text with [secret] for each span.

    Null and empty texts have no spans; whole texts are read, however long; repeated rows have a row each and an empty
    table gives an empty one. Overlapping spans are redacted as one. Columns of the new names are replaced,
    unless ``redacted`` is the text column itself; a null text stays null.
    """
    kept = others(docs, spans, redacted)
    names = [c for c in docs.columns if c in kept or c == text]
    docs = docs.select(*map(tick, names))
    out = [docs.schema[c] for c in names if c != redacted] + [T.StructField(spans, SPAN)] + ([T.StructField(redacted, T.StringType())] if redacted else [])
    schema, at = T.StructType(out), names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = vocabulary(vocabulary_file)
        for whole in batches:
            for batch in _slices(whole, at):
                texts = batch.column(at).to_pylist()
                found = [scan(t or "", encoding) for t in texts]
                cols = [batch.column(k) for k, c in enumerate(names) if c != redacted]
                cols.append(pa.array([[{"kind": k, "start": s, "end": e} for k, s, e in f] for f in found], SPAN_ARROW))
                if redacted:
                    cols.append(pa.array([redact(t, f) for t, f in zip(texts, found, strict=True)], pa.string()))
                yield pa.RecordBatch.from_arrays(cols, names=schema.names)
        settle()

    return docs.mapInArrow(run, schema)


def redact(text: str | None, spans: list[tuple[str, int, int]], by: str = "[secret]") -> str | None:
    if text is None or not spans:
        return text
    out, end = [], 0
    for _, s, e in sorted(spans, key=lambda x: x[1]):
        if s >= end or not out:
            out += [text[end:s], by]
        end = max(end, e)
    return "".join(out) + text[end:]
