"""Long repeated passages across documents, through difference-cover anchors.

A difference cover of a period has, for any two residues, a common shift that moves both into the
cover. With period 31 and six residues, two equal windows of 50 words, at whatever positions, share an
anchor: a cover position within the first 31 words at which the same 20 words follow. So only 6 of 31
positions are hashed and shuffled. Anchors that meet are then extended:

* Anchors whose whole surroundings agree (every window that contains them) form a class. All but the
  smallest document of a class lose those windows at once ("covered").
* Where an anchor has several classes, documents part within a window's reach. There the smallest document of
  each class has its windows hashed one by one (128 bits) and compared ("fine").

Both steps send rows to tasks by hash, sorted, and read them as a stream that holds at most one
document's rows of one class. Before the shuffle each task settles what it can among its own rows, so
that a passage in a third of all documents reaches one reader once per block of rows, not per document.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from hashlib import sha256
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import column, cut, texts

#: A perfect difference set; every residue modulo 31 but 0 is one difference of two of them.
PERIOD, COVER = 31, (1, 5, 11, 24, 25, 27)
#: Ids from here on count as one, the largest. Null ids stand there, told apart by 32 bits of their texts' hashes.
LAST = (1 << 63) - (1 << 32)
#: Odd multipliers of the two rolling hashes, modulo 2**64.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
#: Rows that a task combines before they are shuffled, and words whose hashes it remembers.
BLOCK, MEMORY = 1 << 20, 1 << 20
#: at holds the key in its upper half, and below it the position and, in bit 31, whether the row is known to repeat.
ROW = "h long, c long, doc long, at long"
KNOWN = 1 << 31


class WordHashes(dict):
    """Word -> 64-bit hash, filled on demand."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= MEMORY:
            self.clear()
        self[word] = out = xxhash.xxh64_intdigest(word)
        return out


class Rolling:
    """Polynomial hashes modulo 2**64 of any stretch of a document's word hashes."""

    def __init__(self) -> None:
        self.words, self.powers = WordHashes(), [np.ones(1, np.uint64)] * 4

    def _grow(self, n: int) -> None:
        if len(self.powers[0]) <= n:
            size = 1 << int(n).bit_length()
            steps = [b if i == 0 else pow(b, -1, 1 << 64) for b in BASES for i in (0, 1)]
            self.powers = [np.cumprod(np.r_[np.uint64(1), np.full(size, s, np.uint64)], dtype=np.uint64) for s in steps]

    def load(self, words: list[bytes]) -> None:
        n = len(words)
        self._grow(n)
        at = np.fromiter(map(self.words.__getitem__, words), np.uint64, n)
        self.sums = [np.r_[np.uint64(0), np.cumsum(at * self.powers[2 * i][:n], dtype=np.uint64)] for i in (0, 1)]

    def stretch(self, which: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        x = (self.sums[which][end] - self.sums[which][start]) * self.powers[2 * which + 1][start]
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(29))


def combine(h: np.ndarray, c: np.ndarray, doc: np.ndarray, key: np.ndarray, pos: np.ndarray) -> pa.RecordBatch:
    """Settle a block: a row with a smaller document in its class (h, c) is known to repeat, and goes to
    any task; the others are dealt by h."""
    order = np.lexsort((doc, c, h))
    h, c, doc, key, pos = (x[order] for x in (h, c, doc, key, pos))
    new = np.r_[True, (h[1:] != h[:-1]) | (c[1:] != c[:-1])] if len(h) else np.zeros(0, bool)
    least = doc[new][np.cumsum(new) - 1] if len(h) else doc
    known = rank(doc) > rank(least)
    spread = doc * 0x1F123BB5 + pos * np.int64(0x9E3779B1)
    at = (key.astype(np.int64) << 32) | pos | np.where(known, KNOWN, 0)
    return pa.RecordBatch.from_arrays([pa.array(np.where(known, spread, h)), pa.array(c), pa.array(doc), pa.array(at)], ["h", "c", "doc", "at"])


def rank(doc: np.ndarray) -> np.ndarray:
    """What documents are compared by."""
    return np.minimum(doc, LAST)


def blocks(rows: Iterator[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
    """Gather (h, c, doc, key, pos) arrays into blocks and combine each."""
    held, n = [], 0
    for row in rows:
        held.append(row)
        n += len(row[0])
        if n >= BLOCK:
            yield combine(*map(np.concatenate, zip(*held, strict=True)))
            held, n = [], 0
    if held:
        yield combine(*map(np.concatenate, zip(*held, strict=True)))


def _rows(batch: pa.RecordBatch) -> Iterator[tuple[int, int, str]]:
    return zip(batch.column("doc").to_pylist(), batch.column("key").to_pylist(), texts(batch), strict=True)


def anchors_of(roll: Rolling, n: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position, core hash, class hash) of a loaded document's anchors."""
    core, reach = window - PERIOD + 1, PERIOD - 1
    pos = (np.arange(0, n, PERIOD)[:, None] + np.array(COVER)).ravel()
    pos = pos[pos <= n - core]
    start, end = np.maximum(pos - reach, 0), np.minimum(pos + core + reach, n)
    ends = (pos - start) * 64 + (end - pos - core)
    c = roll.stretch(1, start, end) + ends.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return pos, roll.stretch(0, pos, pos + core).view(np.int64), c.view(np.int64)


def _anchors(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple[np.ndarray, ...]]:
        roll = Rolling()
        for batch in batches:
            for doc, key, text in _rows(batch):
                words = text.encode().split()
                if (n := len(words)) >= window:
                    roll.load(words)
                    pos, h, c = anchors_of(roll, n, window)
                    yield h, c, np.full(len(pos), doc, np.int64), np.full(len(pos), key, np.int32), pos.astype(np.int32)

    yield from blocks(rows())


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (h, c, doc) -> (doc, key, pos, fine): the rows with a smaller document in their
    class, and, as fine, the smallest document's rows wherever an h has several classes. Held between
    batches: the first class's rows of its smallest document while no second class is seen, or else two
    rows without a position that stand for what was seen."""
    held = [np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int32, np.int32)]

    def out(doc: np.ndarray, key: np.ndarray, pos: np.ndarray, fine: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(key), pa.array(pos), pa.array(fine)], ["doc", "key", "pos", "fine"])

    for batch in batches:
        if not batch.num_rows:
            continue
        h, c, doc, at = (batch.column(n).to_numpy() for n in ("h", "c", "doc", "at"))
        known = (at & KNOWN) > 0
        arrays = [h, c, doc, (at >> 32).astype(np.int32), (at & (KNOWN - 1)).astype(np.int32)]
        if known.any():
            yield out(*(x[known] for x in arrays[2:]), np.zeros(known.sum(), bool))
        h, c, doc, key, pos = (np.concatenate([a, b[~known]]) for a, b in zip(held, arrays, strict=True))
        if not len(h):
            continue
        new_h = np.r_[True, h[1:] != h[:-1]]
        new_c = new_h | np.r_[True, c[1:] != c[:-1]]
        group, cls = np.cumsum(new_h) - 1, np.cumsum(new_c) - 1
        several = np.bincount(group[new_c])[group] > 1
        covered = rank(doc) > rank(doc[new_c][cls])
        open_ = (group == group[-1]) & ~several & ~covered
        fine = several & ~covered
        send = (covered | fine) & (pos >= 0)
        if send.any():
            yield out(doc[send], key[send], pos[send], fine[send])
        if several[-1]:  # one row for another class, one for the last class's smallest document
            tail = np.flatnonzero(new_c)
            keep = np.array([tail[-2], tail[-1]])
            held = [x[keep].copy() for x in (h, c, doc, key, pos)]
            held[4][:] = -1
        else:
            held = [x[open_] for x in (h, c, doc, key, pos)]


def spans_of(pos: np.ndarray, n: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last window start of those that contain the 31 positions before an anchor and it."""
    return np.maximum(pos - (PERIOD - 1), 0), np.minimum(pos, n - window)


def _union(start: np.ndarray, end: np.ndarray, n: int) -> np.ndarray:
    """Which of n positions lie in any [start, end)."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, start, 1)
    np.add.at(step, end, -1)
    return np.cumsum(step[:-1]) > 0


def _fine(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """The windows around fine anchors that no class has settled, hashed one by one."""

    def rows() -> Iterator[tuple[np.ndarray, ...]]:
        roll = Rolling()
        for batch in batches:
            extra = zip(batch.column("covered").to_pylist(), batch.column("fine").to_pylist(), strict=True)
            for (doc, key, text), (covered, fine) in zip(_rows(batch), extra, strict=True):
                words = text.encode().split()
                n = len(words)
                roll.load(words)
                first, last = spans_of(np.array(fine, np.int64), n, window)
                mine = _union(first, last + 1, n)
                first, last = spans_of(np.array(covered or [], np.int64), n, window)
                at = np.flatnonzero(mine & ~_union(first, last + 1, n))
                if len(at):
                    a, b = (roll.stretch(i, at, at + window).view(np.int64) for i in (0, 1))
                    yield a, b, np.full(len(at), doc, np.int64), np.full(len(at), key, np.int32), at.astype(np.int32)

    yield from blocks(rows())


def _cut_words(batches: Iterator[pa.RecordBatch], window: int, with_text: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_words, n_removed, digests, kept_texts = [], [], [], []
        columns = (batch.column(c).to_pylist() for c in ("covered", "repeats"))
        for text, covered, repeats in zip(texts(batch), *columns, strict=True):
            words = text.encode().split()
            n = len(words)
            if covered or repeats:
                first, last = spans_of(np.array(covered or [], np.int64), n, window)
                at = np.array(repeats or [], np.int64)
                gone = _union(np.r_[first, at], np.r_[last, at] + window, n)
                words = list(compress(words, ~gone))
            joined = b" ".join(words)
            n_words.append(n)
            n_removed.append(n - len(words))
            digests.append(sha256(joined).hexdigest())
            kept_texts.append(joined.decode() if with_text else None)
        arrays = [batch.column("id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests), pa.array(kept_texts, pa.string())]
        yield pa.RecordBatch.from_arrays(arrays, ["id", "n_words", "n_removed", "kept_sha256", "kept_text"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, with_text: bool = False) -> DataFrame:
    """One row per row of docs: id, n_words, n_removed, kept_sha256, and kept_text if with_text.

    A word goes if a window of `window` consecutive words that covers it also starts in a document with
    a smaller id. Windows are judged on the input. Words are separated by common.SPACES. A null text
    has no words. A null id counts as the largest, as do the 2**32 ids before 2**63; rows of one id (repeated rows,
    or several null ids) never remove each other's words. Texts shorter than a window lose nothing.

    Rows are told apart by their id and 31 bits of their text's hash, those without an id by 63 bits.
    """
    if window < PERIOD + 1:
        raise ValueError(f"a window must have more than {PERIOD} words")
    text, none = F.coalesce(column(text_col), F.lit("")), column(id_col).isNull()
    more = F.pmod(F.xxhash64(F.lit("id"), text), F.lit(1 << 32)) + F.lit(LAST)
    half = F.shiftright(F.crc32(F.xxhash64(text).cast("string").cast("binary")), 1) * 2
    # the lowest bit of the key says whether the id is null
    key = (half + none.cast("int") - F.lit(1 << 31)).cast("int")
    rows = docs.select(F.when(none, more).otherwise(column(id_col).cast("long")).alias("doc"), key.alias("key"), text.alias("text"))
    found = "doc long, key int, pos int, fine boolean"
    anchors = rows.select("doc", "key", "text").mapInArrow(partial(_anchors, window=window), ROW)
    met = anchors.repartition("h").sortWithinPartitions("h", "c", "doc").mapInArrow(_meet, found)
    lists = [F.collect_set(F.when(~F.col("fine"), F.col("pos"))).alias("covered"), F.collect_set(F.when(F.col("fine"), F.col("pos"))).alias("fine")]
    marks = cut(met.groupBy("doc", "key").agg(*lists))
    # both joins read the texts in one and the same exchange
    parted = rows.join(marks, ["doc", "key"], "left")
    fine = parted.filter(F.size("fine") > 0).select("doc", "key", "text", "covered", "fine").mapInArrow(partial(_fine, window=window), ROW)
    same = fine.repartition("h").sortWithinPartitions("h", "c", "doc").mapInArrow(_meet, found)
    repeats = same.filter(~F.col("fine")).groupBy("doc", "key").agg(F.collect_set("pos").alias("repeats"))
    whole = rows.join(marks.select("doc", "key", "covered"), ["doc", "key"], "left").join(repeats, ["doc", "key"], "left")
    whole = whole.select(F.when(F.col("key").bitwiseAND(F.lit(1)) == 0, F.col("doc")).alias("id"), "text", "covered", "repeats")
    out = whole.select("id", "text", "covered", "repeats").mapInArrow(partial(_cut_words, window=window, with_text=with_text), "id long, n_words long, n_removed long, kept_sha256 string, kept_text string")
    return out.select(F.col("id").alias(id_col), "n_words", "n_removed", "kept_sha256", *(["kept_text"] if with_text else []))
