"""Language identification with bit-sliced Bloom filters of character n-grams.

One filter holds all languages: a position is a mask with a bit for each language, and an n-gram's mask is
the AND over its positions, so one look-up returns every language that has the n-gram. The masks of a text's
n-grams are summed up bit by bit (eight languages at a time, over a histogram of their mask bytes), and each
language's count of hits is corrected for its filter's rate of false positives. The language with the highest
corrected share wins.

An n-gram belongs to a language if its rate there is at least a third of its highest rate in any
language; so a few foreign sentences in a language's texts do not put their n-grams into its set.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import column, fold, kind_of, ship, shipped, texts

SIZES = (1, 2, 3)
MIX = np.uint64(0x9E3779B97F4A7C15)
#: Code points per step; a step ends at white space, so that steps change nothing.
STEP = 1 << 20
#: The bits of each byte, lowest first.
BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


class Letters:
    """Code point -> is it a letter."""

    def __init__(self) -> None:
        self.low = np.fromiter((chr(c).isalpha() for c in range(0x33000)), bool, 0x33000)

    def __call__(self, points: np.ndarray) -> np.ndarray:
        return self.low[np.minimum(points, 0x32FFF)] & (points < 0x33000)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x * MIX
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def steps(text: str, size: int = STEP) -> Iterator[str]:
    """The text in pieces of about `size` code points that end after white space; a longer run without any
    is one piece."""
    at = 0
    while at < len(text):
        end = at + size
        if end < len(text):
            last = max(text.rfind(c, at, end) for c in " \t\n")
            if last < 0:
                last = min((x for c in " \t\n" if (x := text.find(c, end)) >= 0), default=len(text))
            end = last + 1
        yield text[at:end]
        at = end


def grams(text: str, letters: Letters, step: int = STEP) -> Iterator[np.ndarray]:
    """Hashes of a text's n-grams, in pieces; letters are lower-cased, any run of others is one space.
    A gram of a space alone, or with a space in its middle, is left out, so none reaches over a piece's end."""
    for part in steps(text, step):
        points = np.frombuffer(f" {part.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        is_letter = letters(points)
        keep = is_letter | np.r_[True, is_letter[:-1]]
        points, is_letter = np.where(is_letter, points, np.uint64(32))[keep], is_letter[keep]
        for n in SIZES:
            m = len(points) - n + 1
            if m <= 0:
                continue
            x = np.zeros(m, np.uint64)
            for i in range(n):
                x = x * np.uint64(0x1000003D) + points[i : i + m]
            ok = is_letter[:m] | is_letter[n - 1 :] if n < 3 else is_letter[1 : m + 1]
            yield _mixed(x[ok] + np.uint64(n))


class Filters:
    """The bit-sliced Bloom filter: masks[position, byte] with eight languages to a byte.

    entries: (hash, number of the language). There are about bits_per_entry positions for each n-gram of the
    language that has most, so the filter takes bits_per_entry / 8 bytes for each of these and eight languages.
    """

    def __init__(self, languages: list[str], hashes: np.ndarray, owner: np.ndarray, probes: int = 3, bits_per_entry: int = 16) -> None:
        self.languages, self.probes = languages, probes
        most = int(np.bincount(owner).max()) if len(owner) else 1
        self.shift = 64 - max(10, int(np.ceil(np.log2(most * bits_per_entry))))
        self.masks = np.zeros((1 << (64 - self.shift), max(1, -(-len(languages) // 8))), np.uint8)
        for at in self._positions(hashes.view(np.uint64)) if len(owner) else ():
            np.bitwise_or.at(self.masks, (at, owner // 8), np.left_shift(1, owner % 8).astype(np.uint8))
        self.false = (self._sums(self.masks) / len(self.masks)) ** probes

    def _sums(self, masks: np.ndarray) -> np.ndarray:
        """For each language, in how many of the masks its bit is set."""
        by = [np.bincount(masks[:, i], minlength=256) @ BITS for i in range(masks.shape[1])]
        return np.concatenate(by)[: len(self.languages)]

    def _positions(self, hashes: np.ndarray) -> Iterator[np.ndarray]:
        for i in range(self.probes):
            yield (hashes * np.uint64(2 * i + 0x9E3779B97F4A7C15) >> np.uint64(self.shift)).astype(np.int64)

    def hits(self, hashes: np.ndarray) -> np.ndarray:
        """For each language, how many of the n-grams its filter has."""
        masks = None
        for at in self._positions(hashes):
            masks = self.masks[at] if masks is None else masks & self.masks[at]
        return self._sums(masks)

    def predict(self, text: str, letters: Letters) -> tuple[str, float]:
        n, hits = 0, np.zeros(len(self.languages))
        for found in grams(text, letters):
            n += len(found)
            hits += self.hits(found)
        if not n or not self.languages or not any(c.isalpha() for c in text):
            return "und", 0.0
        share = np.clip((hits - n * self.false) / np.maximum(1e-9, 1 - self.false), 0, None)
        best = int(share.argmax())
        return self.languages[best], float(share[best] / share.sum()) if share.sum() else 0.0


def _collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    letters, held, size = Letters(), {}, 0

    def out() -> Iterator[pa.RecordBatch]:
        for lang, arrays in held.items():
            gram, n = np.unique(np.concatenate(arrays), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram), pa.string()), pa.array(gram.view(np.int64)), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])

    for batch in batches:
        for text, lang in zip(texts(batch), batch.column("lang").to_pylist(), strict=True):
            for found in grams(text, letters):
                held.setdefault(lang, []).append(found)
                size += len(found)
            if size > 4_000_000:
                yield from out()
                held, size = {}, 0
    yield from out()


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 4000) -> Filters:
    """Fit on a sample of labelled rows: about per_language rows of each language, those whose hash of the id
    falls below that share. Every language and every n-gram of the sample counts. Rows with a null language are
    left out; no rows give a filter without languages."""
    spark = docs.sparkSession
    labelled = docs.filter(column(lang_col).isNotNull()).select(column(id_col).alias("id"), column(text_col).alias("text"), column(lang_col).alias("lang"))
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each language
    if not sizes:
        return Filters([], np.zeros(0, np.int64), np.zeros(0, np.int64))
    at = F.shiftrightunsigned(F.xxhash64(F.lit("language"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 11) / F.lit(float(1 << 53))
    share = spark.createDataFrame([(lang, per_language / n) for lang, n in sizes.items()], "lang string, share double")
    sample = labelled.join(F.broadcast(share), "lang").filter(at < F.col("share")).select("text", "lang")
    counts = sample.mapInArrow(_collect, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    rates = counts.join(F.broadcast(totals), "lang").withColumn("rate", F.col("n") / F.col("total"))
    high = rates.groupBy("gram").agg(F.max("rate").alias("high"))
    found = rates.join(high, "gram").filter("rate >= high / 3").select("lang", "gram").toArrow()
    languages = sorted(sizes)
    number = {lang: i for i, lang in enumerate(languages)}
    owner = np.fromiter(map(number.get, found["lang"].to_pylist()), np.int64, len(found))
    return Filters(languages, found["gram"].to_numpy(), owner)


def _predict(batches: Iterator[pa.RecordBatch], filters: object) -> Iterator[pa.RecordBatch]:
    model, letters = shipped(filters), Letters()
    for batch in batches:
        found = [model.predict(t, letters) for t in texts(batch)]
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("held_out"), pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], ["id", "held_out", "lang_pred", "score"])


def languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 5, held_out_fold: int = 0, per_language: int = 4000) -> DataFrame:
    """One row per row of docs: id, held_out, lang_pred, score.

    Learned from rows outside the held-out fold with a language; only the text is used to predict. A text
    that is null or has no letter is `und` with score 0, as is every text when nothing could be learned. Of
    languages with the same share the first by name is taken. Repeated rows get equal predictions; ids
    of any type are passed through, and a null id counts as the empty text for the fold.
    """
    held = fold(column(id_col), folds) == held_out_fold
    model = fit(docs.filter(~held), id_col, text_col, lang_col, per_language)
    rows = docs.select(column(id_col).alias("id"), column(text_col).alias("text"), held.alias("held_out"))
    out = rows.mapInArrow(partial(_predict, filters=ship(docs.sparkSession.sparkContext, model)), f"id {kind_of(rows, 'id')}, held_out boolean, lang_pred string, score double")
    return out.withColumnRenamed("id", id_col)
