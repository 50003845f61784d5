"""Secret scan: credential patterns, and random strings found by token efficiency.

A byte-pair vocabulary spends few tokens on what people write and many on random
strings, so the characters a tiktoken vocabulary covers per token separate the two.
Every long run of key characters outside the patterns' own matches is tokenised;
a run that mixes letters and digits, or cases, and covers few characters per token is
reported as ``random``, unless it is a known kind of digest or identifier (hex digests of
the common lengths, UUIDs, pure numbers, words joined by dashes or underscores).  The
threshold is set on generated keys of eight alphabets against identifiers and paths of
source code; a test holds it to recall and precision on others.

Edge cases: a null or empty text has no spans; an empty table gives an empty result,
repeated rows each have theirs, columns other than doc_id and text are ignored; texts are
scanned whole; positions are code points of the
whole text; matches of one kind do not overlap, those of different kinds may.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame

from .spans import Span, digest, joined, outside
from .textkit import map_slices

KINDS = ("assign", "access", "hex", "random")
_ASSIGN = re.compile(
    r"(?ai:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_RUN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
#: Letters and digits together, or letters whose case changes to and fro; words, numbers and titles are neither.
_MIXED = re.compile(r"(?=.*[0-9])(?=.*[A-Za-z])|.*[a-z][A-Z].*[a-z][A-Z]")
#: A random run has a long stretch without separators; identifiers and paths are made of short ones.
_STRETCH = re.compile(r"[A-Za-z0-9]{12}")
#: Digests by their hex lengths, UUIDs, and words or numbers joined by dashes and underscores.
_KNOWN = re.compile(
    r"(?ai:(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128})"
    r"|[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12})"
    r"|(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]+)(?:[-_/=+](?:[A-Z]?[a-z]+|[A-Z]+|[0-9]+))*"
)


def base_spans(text: str) -> list[Span]:
    """Matches of the three credential patterns, leftmost and non-overlapping per kind."""
    spans = [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[1]) >= 6]
    if "AKIA" in text:
        spans += [("access", *m.span()) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    return spans + [("hex", *m.span()) for m in _HEX.finditer(text)]


class TokenEfficiency:
    """Characters per token of a string under a tiktoken vocabulary."""

    def __init__(self, ranks_path: str, pattern: str) -> None:
        import base64

        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("given", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def ratio(self, text: str) -> float:
        return len(text) / max(1, len(self.encoding.encode_ordinary(text)))


_MODELS: dict[str, TokenEfficiency] = {}


def _model(ranks_path: str, pattern: str) -> TokenEfficiency:
    if ranks_path not in _MODELS:
        _MODELS[ranks_path] = TokenEfficiency(ranks_path, pattern)
    return _MODELS[ranks_path]


def random_spans(text: str, model: TokenEfficiency, max_ratio: float) -> list[Span]:
    """Long runs of key characters that cover at most ``max_ratio`` characters per token."""
    return [
        ("random", *m.span())
        for m in _RUN.finditer(text)
        if _MIXED.match(m[0]) and _STRETCH.search(m[0]) and not _KNOWN.fullmatch(m[0]) and model.ratio(m[0]) <= max_ratio
    ]


def scan(docs: DataFrame, ranks_path: str, pattern: str, max_ratio: float = 1.8) -> DataFrame:
    """Per document (doc_id, text): counts per kind, base_sha256 and all spans.  Narrow: no shuffle."""
    schema = "doc_id long, n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string"

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        model, rows = _model(ranks_path, pattern), []
        for text in batch.column("text").to_pylist():
            base = base_spans(text or "")
            extra = outside(random_spans(text or "", model, max_ratio), base)
            counts = [sum(s[0] == k for s in base) for k in KINDS[:3]]
            rows.append((*counts, len(extra), digest(base, KINDS), joined(base + extra, KINDS)))
        columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), [pa.int64()] * 4 + [pa.string()] * 2, strict=True)]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=[f.split()[0] for f in schema.split(", ")])

    return map_slices(docs.select("doc_id", "text"), run, schema)
