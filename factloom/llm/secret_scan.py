"""Secrets in texts: three patterns, and random strings found by their token efficiency.

Ordinary words cost few tokens for their length under a trained vocabulary; keys and passwords cost many.
What is known for something else is blanked first: scheme and host of a URL, UUIDs, digests (hexadecimal of a known
length). Candidates are then the runs of key characters, over `-` and `/` too, and the parts between these; numbers
and dates are none. A candidate with fewer than `ratio` characters per token is a span of kind `random`, unless a base
span already covers it. Random letters of one case cost fewer tokens than mixed ones, and rare words more than
frequent ones, so strings that look like one word have a lower limit of their own.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import partial
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame

from factloom.llm.common import column, kind_of, texts

#: The kinds in the order in which equal starts are listed, and their patterns.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
#: Hexadecimal lengths of MD5, SHA-1, SHA-224, SHA-256, SHA-384 and SHA-512.
DIGESTS = {32, 40, 56, 64, 96, 128}
#: What is blanked before the token test: scheme and host of a URL, UUIDs, digests.
URL = re.compile(r"\b[A-Za-z][A-Za-z0-9+.-]*://(?:(?=[^\s/@]*@)|[A-Za-z0-9.-]*)")
HOST = re.compile(r"(?<=@)[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
UUID = re.compile(r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", re.IGNORECASE)
DIGEST = re.compile(r"(?<![A-Za-z0-9])(?:" + "|".join(f"[0-9a-f]{{{n}}}" for n in sorted(DIGESTS, reverse=True)) + r")(?![A-Za-z0-9])", re.IGNORECASE)
RUN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
PART = re.compile(r"[A-Za-z0-9+_=]{16,}")
NUMBER = re.compile(r"[0-9+/_=-]+")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

Span = tuple[int, int, str]


def base_spans(text: str) -> list[Span]:
    """(start, end, kind) in code points, end exclusive, ordered by start and then kind as listed."""
    out = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


class TokenRatio:
    """Characters per token of a string under a tiktoken vocabulary file."""

    def __init__(self, path: str, pattern: str) -> None:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.encode = tiktoken.Encoding("secret-scan", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def __call__(self, run: str) -> float:
        return len(run) / max(1, len(self.encode(run)))


def _blank(m: re.Match) -> str:
    return " " * (m.end() - m.start())


def random_spans(text: str, ratio: TokenRatio, below: float, word_below: float) -> list[Span]:
    """Spans of kind random, in order: runs whose characters per token are below the limit, or else their parts."""
    if not RUN.search(text):
        return []
    for known in (URL, HOST, UUID, DIGEST):
        text = known.sub(_blank, text)

    def is_random(s: str) -> bool:
        return not NUMBER.fullmatch(s) and ratio(s) < (word_below if WORD.fullmatch(s) else below)

    out = []
    for run in RUN.finditer(text):
        if is_random(run.group()):
            out.append((run.start(), run.end(), "random"))
            continue
        for part in PART.finditer(run.group()):
            if part.end() - part.start() < run.end() - run.start() and is_random(part.group()):
                out.append((run.start() + part.start(), run.start() + part.end(), "random"))
    return out


def scan(text: str, ratio: TokenRatio, below: float = 2.1, word_below: float = 1.85) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans) of one whole text."""
    base = base_spans(text)
    extra = [s for s in random_spans(text, ratio, below, word_below) if not any(b[0] < s[1] and s[0] < b[1] for b in base)]
    return base, sorted(base + extra, key=lambda s: (s[0], KINDS.index(s[2])))


def said(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def _scan(batches: Iterator[pa.RecordBatch], path: str, pattern: str, below: float, word_below: float) -> Iterator[pa.RecordBatch]:
    ratio = TokenRatio(path, pattern)
    for batch in batches:
        rows = [scan(t, ratio, below, word_below) for t in texts(batch)]
        n = {k: pa.array([sum(s[2] == k for s in every) for _, every in rows], pa.int64()) for k in KINDS}
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), *n.values(), pa.array([sha256(said(base).encode()).hexdigest() for base, _ in rows]), pa.array([said(every) for _, every in rows])],
            ["id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"],
        )


def secret_spans(docs: DataFrame, vocabulary_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", below: float = 2.1, word_below: float = 1.85) -> DataFrame:
    """One row per row of docs: id, n_assign, n_access, n_hex, n_random, base_sha256, spans.

    vocabulary_path is a tiktoken rank file, pattern its splitting pattern, below the characters per
    token under which a string counts as random, word_below the same for letters that look like one word. Spans are
    kind:start:end in code points of the whole text. A null text counts as empty: no spans, the digest of
    the empty string. Rows that repeat are scanned each; ids of any type, null too, are passed through.
    """
    rows = docs.select(column(id_col).alias("id"), column(text_col).alias("text"))
    kinds = ", ".join(f"n_{k} long" for k in KINDS)
    out = rows.mapInArrow(partial(_scan, path=vocabulary_path, pattern=pattern, below=below, word_below=word_below), f"id {kind_of(rows, 'id')}, {kinds}, base_sha256 string, spans string")
    return out.withColumnRenamed("id", id_col)
