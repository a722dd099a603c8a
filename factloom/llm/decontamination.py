"""Benchmark decontamination with a generalised suffix automaton of the test items.

The automaton is built once over the normalised words of all items. Every document streams through it;
the state and the longest matching length are all that is kept. Where that length reaches a window's, the
last words are an occurrence. Documents never move: the only table that travels is the automaton. A
benchmark of more than `block_words` words goes in blocks of about that size, one pass after the other over
rows that are written in between, so that no more than one automaton is held at any time; an item longer than a block
goes in stretches that overlap by a window less one word, so that each window lies whole in one of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import column, cut, ship, shipped, texts, unpacked, whole

#: ASCII letters in lower case; digits and all bytes above 0x7F as they are; every other byte a space.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(FOLD).split()


class SuffixAutomaton:
    """All substrings (over words) of a set of items, with the items in which windows of `window` words
    occur; an item of fewer words is one window."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = 13) -> None:
        self.window, self.vocabulary = window, {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[tuple[int, str]] = []
        whole: dict[int, list[tuple[int, str]]] = {}
        for name, words in items:
            last = 0
            for word in words:
                last = self._extend(last, self.vocabulary.setdefault(word, len(self.vocabulary)))
                if len(words) >= window:
                    ends.append((last, name))
            if words and len(words) < window:
                whole.setdefault(tuple(words), []).append((len(words), name))
        self.shortest = min([window, *(m for found in whole.values() for m, _ in found)])
        self._finish(ends, whole)

    def _extend(self, last: int, word: int) -> int:
        if word in self.next[last]:
            q = self.next[last][word]
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, word, q)
        new = self._state({}, self.length[last] + 1)
        p = last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][word]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, word, q)
        else:
            self.link[new] = 0
        return new

    def _state(self, following: dict[int, int], length: int) -> int:
        self.next.append(following)
        self.link.append(0)
        self.length.append(length)
        return len(self.next) - 1

    def _clone(self, p: int, word: int, q: int) -> int:
        copy = self._state(dict(self.next[q]), self.length[p] + 1)
        self.link[copy], self.link[q] = self.link[q], copy
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        return copy

    def _finish(self, ends: list[tuple[int, str]], whole: dict) -> None:
        n, w = len(self.next), self.window
        #: the state on the suffix path that holds the window-long suffix, or -1
        self.at_window = [-1] * n
        self.items: list[set[str] | None] = [None] * n
        #: short items that end here, and the next state up the path that has some
        self.short: list[list[tuple[int, str]]] = [[] for _ in range(n)]
        self.up = [-1] * n
        for words, found in whole.items():
            state = 0
            for word in words:
                state = self.next[state][self.vocabulary[word]]
            self.short[state] += found
        for s in sorted(range(n), key=self.length.__getitem__)[1:]:
            parent = self.link[s]
            if self.length[s] >= w:
                self.at_window[s] = s if self.length[parent] < w else self.at_window[parent]
            self.up[s] = parent if self.short[parent] else self.up[parent]
        for state, name in ends:
            if (top := self.at_window[state]) >= 0:
                if self.items[top] is None:
                    self.items[top] = set()
                self.items[top].add(name)

    def matches(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """([start, end) of every window occurrence, in order of their ends; the items they are of)."""
        n = len(words)
        if n < self.shortest or not self.vocabulary:
            return [], set()
        get = self.vocabulary.get
        ids = np.fromiter((get(x, -1) for x in words), np.int64, n)
        edge = np.diff(np.r_[False, ids >= 0, False].astype(np.int8))
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        long = ends - starts >= self.shortest
        spans, tops, names = [], set(), set()
        follow, link, length, at_window, w = self.next, self.link, self.length, self.at_window, self.window
        for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True):
            state = size = 0
            for i, word in enumerate(ids[a:b].tolist(), a):
                while state and word not in follow[state]:
                    state = link[state]
                    size = length[state]
                if word in follow[state]:
                    state = follow[state][word]
                    size += 1
                if size >= w:
                    spans.append((i - w + 1, i + 1))
                    tops.add(at_window[state])
                if self.shortest < w:
                    s = state
                    while s > 0:
                        for m, name in self.short[s]:
                            if m <= size:
                                spans.append((i - m + 1, i + 1))
                                names.add(name)
                        s = self.up[s]
        for top in tops:
            names |= self.items[top]
        return spans, names


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The same positions as disjoint spans in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _stream(batches: Iterator[pa.RecordBatch], automaton: object, text_col: str) -> Iterator[pa.RecordBatch]:
    found = shipped(automaton)
    for batch in batches:
        row = batch.column("__row")
        text_column = pa.RecordBatch.from_arrays([row.field(row.type.get_field_index(text_col))], ["text"])
        n_words, starts, ends, names = [], [], [], []
        before = zip(*(batch.column(c).to_pylist() for c in ("starts", "ends", "items")), strict=True)
        for text, (s, e, items) in zip(texts(text_column), before, strict=True):
            words = words_of(text)
            spans, more = found.matches(words)
            spans = merged([*zip(s or [], e or [], strict=True), *spans])
            n_words.append(len(words))
            starts.append([a for a, _ in spans])
            ends.append([b for _, b in spans])
            names.append(sorted({*(items or []), *more}))
        long = pa.list_(pa.int64())
        arrays = [pa.array(n_words, pa.int64()), pa.array(starts, long), pa.array(ends, long), pa.array(names, pa.list_(pa.string()))]
        carried = [n for n in batch.schema.names if n not in ("n_words", "starts", "ends", "items")]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in carried), *arrays], [*carried, "n_words", "starts", "ends", "items"])


def find_items(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 13, block_words: int = 2_000_000) -> DataFrame:
    """One row per row of docs: all its columns as __row (a struct), n_words, starts and ends of the
    disjoint spans of hit words, items (names of the items with occurring windows, sorted as strings).

    A null text has no words; an item without words is never found; an item without an id is named by
    the empty string. Items that repeat count once by name. Rows of docs that repeat are judged each.
    """
    sc = docs.sparkSession.sparkContext
    item = benchmark.select(F.coalesce(column(item_col).cast("string"), F.lit("")).alias("name"), F.coalesce(column(item_text_col), F.lit("")).alias("text"))
    # a word has a character and, but for the last, one separator: so many words at most
    words = item.agg(F.coalesce(F.sum((F.length("text") + 1) / 2), F.lit(0.0))).first()[0]
    n_blocks = max(1, -(-int(words) // block_words))
    if n_blocks > 1:
        item = cut(item.select("name", F.explode(_stretches(F.col("text"), window, block_words)).alias("text")))
    nothing = "cast(null as array<bigint>)"
    rows = docs.select(whole(docs, "__row"), F.lit(0).cast("long").alias("n_words"), F.expr(nothing).alias("starts"), F.expr(nothing).alias("ends"), F.expr("cast(null as array<string>)").alias("items"))
    for block in range(n_blocks):
        part = item.filter(F.pmod(F.xxhash64("name", "text"), F.lit(n_blocks)) == block) if n_blocks > 1 else item
        automaton = ship(sc, SuffixAutomaton([(r["name"], words_of(r["text"])) for r in part.toLocalIterator()], window))
        rows = rows.mapInArrow(partial(_stream, automaton=automaton, text_col=text_col), rows.schema)
        if n_blocks > 1:
            rows = cut(rows)
            automaton.destroy()
    return rows


def _stretches(text: Column, window: int, block_words: int) -> Column:
    """An item's text as an array: itself, or, if it has more than block_words words, stretches of so many that overlap
    by window - 1."""
    words = F.filter(F.split(text, r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), lambda w: w != "")
    step = max(1, block_words - window + 1)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(words) - (window - 1)), F.lit(step))
    return F.when(F.size(words) <= block_words, F.array(text)).otherwise(F.transform(starts, lambda i: F.array_join(F.slice(words, i, step + window - 1), " ")))


def judged(found: DataFrame, coverage: int = 20) -> DataFrame:
    """find_items() with n_hit, n_items and contaminated: some hit words, a 1/coverage part or more."""
    hit = F.aggregate(F.zip_with("starts", "ends", lambda a, b: b - a), F.lit(0).cast("long"), lambda x, y: x + y)
    out = found.withColumn("n_hit", hit).withColumn("n_items", F.size("items").cast("long"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (coverage * F.col("n_hit") >= F.col("n_words")))


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 13, coverage: int = 20) -> DataFrame:
    """(id, n_words, n_hit, n_items, items_sha256, contaminated) for each row of docs; see find_items()."""
    found = judged(find_items(docs.select(column(id_col), column(text_col)), benchmark, text_col, item_col, item_text_col, window), coverage)
    digest = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return found.select(F.col("__row").getField(id_col).alias(id_col), "n_words", "n_hit", "n_items", digest.alias("items_sha256"), "contaminated")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options: object) -> DataFrame:
    """The rows of docs that are not contaminated, as they are."""
    return unpacked(judged(find_items(docs, benchmark, **options)).filter(~F.col("contaminated")), "__row", docs.columns)


def _without(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    import re

    word = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
    for batch in batches:
        out = []
        for text, starts, ends in zip(batch.column("text").to_pylist(), batch.column("starts").to_pylist(), batch.column("ends").to_pylist(), strict=True):
            gone = [(a, b) for a, b in zip(starts, ends, strict=True) if b - a >= least]
            if gone:
                raw = text.encode()
                at = [m.span() for m in word.finditer(raw)]
                edges = [0, *(x for a, b in gone for x in (at[a][0], at[b - 1][1])), len(raw)]
                text = b"".join(raw[i:j] for i, j in zip(edges[::2], edges[1::2], strict=True)).decode()
            out.append(text)
        yield pa.RecordBatch.from_arrays([batch.column("__row"), pa.array(out, pa.string())], ["__row", "text"])


def remove_spans(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", least_words: int = 13, coverage: int | None = 20, **options: object) -> DataFrame:
    """The rows of docs without the spans of hit words (see find_items()) that have least_words words or more:
    each goes from the start of its first word to the end of its last, and all between the spans stays as it
    is. With coverage, rows that are contaminated as judged() says go whole. A null text stays null."""
    found = find_items(docs, benchmark, text_col=text_col, **options)
    found = judged(found, coverage).filter(~F.col("contaminated")) if coverage else found
    rows = found.select("__row", F.col("__row").getField(text_col).alias("text"), "starts", "ends")
    schema = rows.select("__row", "text").schema
    out = rows.mapInArrow(partial(_without, least=least_words), schema)
    return out.select(*((F.col("text") if c == text_col else F.col("__row").getField(c)).alias(c) for c in docs.columns))
