"""Toxicity from class-conditional Kneser-Ney models.

Two bigram models, one of toxic and one of ordinary labelled texts, give each word a log-likelihood
ratio. Both use absolute discounting and back off the same way: bigram to the class's own words, and those to one
shared continuation distribution (after how many different words does a word come, in either class). A
rare expression so gets nearly the same probability from both. A text's ratio is normalised by its length
in several ways (per word, per root of the length, its strongest words, and what is strong evidence), and a logistic regression fitted on
labelled texts that the models have not seen turns these into a probability.

The classifier learns from a bounded sample: about `per_class` rows of each label. Every word and pair of the
sample is in the models, under a 64-bit hash. Scoring reads every text whole.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from factloom.llm.common import column, cut, fold, ship, shipped, texts, unpacked, whole
from factloom.llm.decontamination import words_of

DISCOUNT = 0.75
#: How many of a text's strongest words count as its peak.
PEAK = 5
#: What a word's log-likelihood ratio exceeds this by is strong evidence.
STRONG = 2.0
#: Words in fewer training texts are no strong evidence; their ratios count in the sums alone.
SUPPORT = 5
#: Bands of a text's least shingle hashes, and hashes in a band; near copies agree in a band.
BANDS, BAND = 6, 3
FEATURES = 6
#: What is counted of a word or pair.
COUNTS = ("toxic", "ordinary", "in_toxic", "in_ordinary")
#: Words whose hashes a task remembers, and words and pairs that it counts before it passes the counts on.
MEMORY, FLUSH = 1 << 18, 300_000
#: Seed of the hashes of words, as Spark's own function has it.
SEED = 42


class _Hashes(dict):
    """Word -> hash, filled on demand; emptied when it is large."""

    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh64_intdigest

        if len(self) >= MEMORY:
            self.clear()
        self[word] = out = xxh64_intdigest(word, SEED)
        return out


class Table:
    """Rows by 64-bit hash, for look-ups of many at once: a row stands at its hash's lowest bits, or at the next
    free place after it. At most three quarters of the places are taken. Only the rows travel; the places are made where
    the table is used."""

    def __init__(self, keys: np.ndarray, columns: list[np.ndarray]) -> None:
        self.rows: tuple | None = (keys, [c.astype(np.float32) for c in columns])

    def __getstate__(self) -> dict:
        return {"rows": self.rows or (self.keys[self.taken], [c[self.taken] for c in self.columns])}

    def _place(self) -> None:
        (keys, columns), self.rows = self.rows, None
        size = 1 << max(4, (4 * len(keys) // 3).bit_length())
        self.mask = np.uint64(size - 1)
        place = np.full(size, -1, np.int32)
        left, step = np.arange(len(keys)), np.uint64(0)
        while len(left):
            at = ((keys[left] + step) & self.mask).astype(np.int64)
            first = np.zeros(len(left), bool)
            first[np.unique(at, return_index=True)[1]] = True
            first &= place[at] < 0
            place[at[first]] = left[first]
            left, step = left[~first], step + np.uint64(1)
        self.steps, taken = int(step), place >= 0
        self.taken, self.keys = taken, np.zeros(size, np.uint64)
        self.keys[taken] = keys[place[taken]]
        self.columns = []
        for c in columns:
            self.columns.append(np.zeros(size, np.float32))
            self.columns[-1][taken] = c[place[taken]]

    def find(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, found) for each wanted key; the place of one that is not there means nothing."""
        if self.rows is not None:
            self._place()
        at = (wanted & self.mask).astype(np.int64)
        found = self.taken[at] & (self.keys[at] == wanted)
        left = np.flatnonzero(~found & self.taken[at])
        for step in range(1, self.steps):
            if not len(left):
                break
            here = ((wanted[left] + np.uint64(step)) & self.mask).astype(np.int64)
            hit = self.taken[here] & (self.keys[here] == wanted[left])
            at[left[hit]], found[left[hit]] = here[hit], True
            left = left[~hit & self.taken[here]]
        return at, found


def pair_hash(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """A pair's hash from those of its words."""
    return (first << np.uint64(21) | first >> np.uint64(43)) ^ second


class Model:
    """Log-likelihood ratios of words and word pairs by hash.

    words: hash, ratio, firm (the ratio when a text counts a word once, so that lines repeated in it do not weigh; 0 for
    words of fewer than SUPPORT texts), back (log ratio of the two classes' backoff weights after the word);
    pairs: hash, ratio. unseen: the ratio of a word in neither class.
    """

    def __init__(self, words: dict[str, np.ndarray], pairs: dict[str, np.ndarray], unseen: float) -> None:
        self.words = Table(words["hash"], [words[c] for c in ("ratio", "firm", "back")])
        self.pairs = Table(pairs["hash"], [pairs["ratio"]])
        self.unseen, self.hashes = unseen, _Hashes()

    def ratios(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(log-likelihood ratio of each word after the one before it, firm evidence of each)."""
        hashes = np.fromiter(map(self.hashes.__getitem__, words), np.uint64, len(words))
        at, known = self.words.find(hashes)
        ratio, firm, back = (np.where(known, c[at], np.float32(0)) for c in self.words.columns)
        after = np.where(known, ratio, np.float32(self.unseen))
        after[1:] += back[:-1]
        both = np.flatnonzero(known[1:] & known[:-1])  # no other pair was seen
        pair, met = self.pairs.find(pair_hash(hashes[both], hashes[both + 1]))
        after[both[met] + 1] = self.pairs.columns[0][pair[met]]
        return after.astype(float), firm.astype(float)

    def features(self, text: str) -> list[float]:
        words = words_of(text)
        n = len(words)
        if not n:
            return [0.0] * FEATURES
        ratio, firm = self.ratios(words)
        total = float(ratio.sum())
        top = np.partition(firm, n - PEAK)[-PEAK:] if n > PEAK else firm
        strong = float(np.maximum(firm - STRONG, 0).sum())
        return [total / n, total / math.sqrt(n), float(top.sum()) / PEAK, math.log1p(n), math.log1p(strong), strong / math.sqrt(n)]


@dataclass
class Classifier:
    """The models, as they are shipped to executors once, and the regression's weights (intercept first)."""

    model: Model
    shipped: Broadcast
    weights: np.ndarray


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(first, word, toxic, ordinary, in_toxic, in_ordinary): hashes of two words, and how often the second comes after the
    first in the texts of each label; first is null for a word alone, which also has the number of its texts."""
    held, seen = (Counter(), Counter()), (Counter(), Counter())

    hashes = _Hashes()

    def out() -> pa.RecordBatch:
        keys = list(held[0].keys() | held[1].keys())
        pair = [k if isinstance(k, tuple) else (None, k) for k in keys]
        first = pa.array([0 if a is None else hashes[a] for a, _ in pair], pa.uint64(), mask=np.array([a is None for a, _ in pair], bool))
        word = pa.array([hashes[b] for _, b in pair], pa.uint64())
        counts = [pa.array([held[1][k] for k in keys], pa.int64()), pa.array([held[0][k] for k in keys], pa.int64())]
        counts += [pa.array([seen[1][k] for k in keys], pa.int64()), pa.array([seen[0][k] for k in keys], pa.int64())]
        return pa.RecordBatch.from_arrays([first.view(pa.int64()), word.view(pa.int64()), *counts], ["first", "word", *COUNTS])

    for batch in batches:
        for text, label in zip(texts(batch), batch.column("label").to_pylist(), strict=True):
            words = words_of(text)
            held[label].update(words)
            held[label].update(zip(words, words[1:], strict=False))
            seen[label].update(set(words))
        if len(held[0]) + len(held[1]) > FLUSH:
            yield out()
            held, seen = (Counter(), Counter()), (Counter(), Counter())
    yield out()


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys of a text's bands: each is of the least hashes of its shingles of five words under a few functions.
    Texts with a similarity of 0.8 share a key with probability 0.99, with one of 0.3 with 0.15."""
    import xxhash

    factors = (np.arange(BANDS * BAND, dtype=np.uint64) * np.uint64(2) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    for batch in batches:
        out = np.zeros((batch.num_rows, BANDS), np.uint64)
        for i, text in enumerate(texts(batch)):
            words = words_of(text)
            grams = set(map(b" ".join, zip(*(words[j:] for j in range(5)), strict=False))) if len(words) > 5 else {b" ".join(words)}
            hashes = np.fromiter(map(xxhash.xxh64_intdigest, grams), np.uint64)
            least = np.array([(hashes * f ^ (hashes * f >> np.uint64(31))).min() for f in factors]).reshape(BANDS, BAND)
            out[i] = (least * np.array([1, 0x100000001B3, 0x27D4EB2F165667C5], np.uint64)).sum(1, dtype=np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column("__id"), batch.column("label"), *(pa.array(out[:, k].view(np.int64)) for k in range(BANDS))], ["__id", "label", *(f"k{k}" for k in range(BANDS))])


def _features(batches: Iterator[pa.RecordBatch], model: object) -> Iterator[pa.RecordBatch]:
    found = shipped(model)
    for batch in batches:
        rows = np.array([found.features(t) for t in texts(batch)], float).reshape(-1, FEATURES)
        yield pa.RecordBatch.from_arrays([*(pa.array(rows[:, i]) for i in range(FEATURES)), batch.column("label")], [*(f"f{i}" for i in range(FEATURES)), "label"])


def _score(batches: Iterator[pa.RecordBatch], model: object, weights: np.ndarray) -> Iterator[pa.RecordBatch]:
    found = shipped(model)
    for batch in batches:
        z = [float(weights @ np.r_[1.0, found.features(t)]) for t in texts(batch)]
        scores = pa.array([1 / (1 + math.exp(-max(-30.0, min(30.0, x)))) for x in z], pa.float64())
        yield pa.RecordBatch.from_arrays([*batch.columns, scores], [*batch.schema.names, "__score"])


def _with_score(rows: DataFrame) -> StructType:
    return StructType([*rows.schema.fields, StructField("__score", DoubleType())])


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights (intercept first) of a ridge logistic regression, by Newton's method."""
    x = np.c_[np.ones(len(x)), x]
    w = np.zeros(x.shape[1])
    penalty = np.diag(np.r_[1e-6, np.full(x.shape[1] - 1, ridge)])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (p - y)) + penalty @ w
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + penalty, gradient)
        w -= step
        if abs(step).max() < 1e-8:
            break
    return w


def _arrays(df: DataFrame) -> dict[str, np.ndarray]:
    """The columns of a model's table, hashes as unsigned numbers."""
    found = df.toArrow()
    return {c: found[c].to_numpy().view(np.uint64) if c == "hash" else found[c].to_numpy() for c in found.column_names}


def _smoothed(own: Column, total: float, types: float, shared: Column) -> Column:
    total = max(total, 1.0)
    return F.greatest(own - DISCOUNT, F.lit(0.0)) / total + DISCOUNT * max(types, 1.0) / total * shared


def fitted(counts: DataFrame) -> Model:
    """The two models from what _count() gives, summed up: a row for each word and pair of the sample. The
    probabilities are worked out in Spark; the driver gets a hash and a ratio for each pair."""
    alone, pairs = counts.filter("first is null").drop("first"), counts.filter("first is not null").select("first", "word", *COUNTS[:2])
    total = dict(zip(COUNTS, (float(x or 0) for x in alone.agg(*map(F.sum, COUNTS)).first()), strict=True))
    types_t, types_o = (float(x or 0) for x in alone.agg(F.count_if(F.col("toxic") > 0), F.count_if(F.col("ordinary") > 0)).first())
    types = dict(zip(COUNTS, (types_t, types_o) * 2, strict=True))

    after = pairs.groupBy("word").agg(F.count(F.lit(1)).alias("after"))
    follow = pairs.groupBy(F.col("first").alias("word")).agg(*(f(c) for c in COUNTS[:2] for f in (lambda c: F.sum(c).alias(f"sum_{c}"), lambda c: F.count_if(F.col(c) > 0).alias(f"types_{c}"))))
    n_pairs = float(pairs.count())
    words = alone.join(after, "word", "left").join(follow, "word", "left").withColumn("shared", (F.coalesce("after", F.lit(0)) + 0.5) / max(1.0, n_pairs))
    words = words.withColumns({f"p_{c}": _smoothed(F.col(c), total[c], types[c], F.col("shared")) for c in COUNTS})
    for c in COUNTS[:2]:  # what a first word leaves to single words, all of it where it was never followed
        words = words.withColumn(f"total_{c}", F.greatest(F.col(f"sum_{c}"), F.lit(1)))
        words = words.withColumn(f"back_{c}", F.when(F.col(f"sum_{c}") > 0, DISCOUNT * F.col(f"types_{c}") / F.col(f"total_{c}")).otherwise(1.0))
    firm = F.when(F.col("in_toxic") + F.col("in_ordinary") >= SUPPORT, F.log(F.col("p_in_toxic") / F.col("p_in_ordinary"))).otherwise(0.0)
    ratios = {"ratio": F.log(F.col("p_toxic") / F.col("p_ordinary")), "firm": firm, "back": F.log(F.col("back_toxic") / F.col("back_ordinary"))}
    kept = [f"{x}_{c}" for x in ("p", "total", "back") for c in COUNTS[:2]]
    words = cut(words.select("word", *(c.cast("float").alias(n) for n, c in ratios.items()), *kept))
    single = _arrays(words.select(F.col("word").alias("hash"), *ratios))

    first = words.select(F.col("word").alias("first"), *kept[2:])
    met = pairs.join(first, "first").join(words.select("word", *kept[:2]), "word")
    t, o = (F.greatest(F.col(c) - DISCOUNT, F.lit(0.0)) / F.col(f"total_{c}") + F.col(f"back_{c}") * F.col(f"p_{c}") for c in COUNTS[:2])
    pair = F.shiftleft("first", 21).bitwiseOR(F.shiftrightunsigned("first", 43)).bitwiseXOR(F.col("word"))  # pair_hash()
    double = _arrays(met.select(pair.alias("hash"), F.log(t / o).cast("float").alias("ratio")))
    # a word that was never seen has its shared share from both sides
    return Model(single, double, math.log((max(types_t, 1) / max(total["toxic"], 1)) / (max(types_o, 1) / max(total["ordinary"], 1))))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds: int = 5, held_out_fold: int = 0, per_class: int = 5000) -> Classifier:
    """Fit on labelled rows outside the held-out fold: about per_class of each label, those whose hash
    of the id falls below that share; a fifth of them fits the regression, the rest the two models. Of
    near copies with one label in the sample one is learned from, or their words would pass for toxic ones.
    Of several labels for one id the largest counts; rows with a null id or label are left out."""
    sc = docs.sparkSession.sparkContext
    own = labels.select(column(id_col).alias("__id"), column(label_col).alias("label"), (fold(column(id_col), folds) != held_out_fold).alias("learn"))
    own = own.filter(F.col("learn") & F.col("__id").isNotNull() & F.col("label").isNotNull())
    own = own.groupBy("__id").agg(F.max((F.col("label") > 0).cast("int")).alias("label"))
    sizes = {r[0]: r[1] for r in own.groupBy("label").agg(F.count(F.lit(1))).collect()}
    at = F.shiftrightunsigned(F.xxhash64(F.lit("toxicity"), "__id"), 11) / F.lit(float(1 << 53))
    part = F.when(F.pmod(F.xxhash64(F.lit("part"), "__id"), F.lit(5)) == 0, 1).otherwise(0)
    limit = F.when(F.col("label") == 1, per_class / max(1, sizes.get(1, 0))).otherwise(per_class / max(1, sizes.get(0, 0)))
    sample = own.filter(at < limit).select("__id", "label", part.alias("part"))
    rows = docs.select(column(id_col).alias("__id"), column(text_col).alias("text")).join(F.broadcast(sample), "__id")  # 2 * per_class rows or so
    rows = cut(rows.select(F.xxhash64("__id").alias("__id"), "text", "label", "part"))
    keys = rows.select("__id", "label", "text").mapInArrow(_bands, "__id long, label int, " + ", ".join(f"k{i} long" for i in range(BANDS))).toArrow().to_pandas().sort_values("__id")
    for i in range(BANDS):  # of texts of one label that share a band, the one with the smallest hashed id stays
        keys = keys.drop_duplicates([f"k{i}", "label"])
    stay = docs.sparkSession.createDataFrame(keys[["__id"]], "__id long")
    rows = rows.join(F.broadcast(stay), "__id").select("text", "label", "part")

    counts = rows.filter("part = 0").select("text", "label").mapInArrow(_count, "first long, word long, " + ", ".join(f"{c} long" for c in COUNTS))
    model = fitted(cut(counts.groupBy("first", "word").agg(*(F.sum(c).cast("int").alias(c) for c in COUNTS))))

    sent = ship(sc, model)
    seen = rows.filter("part = 1").select("text", "label").mapInArrow(partial(_features, model=sent), ", ".join(f"f{i} double" for i in range(FEATURES)) + ", label int").toArrow().to_pandas()
    y = seen["label"].to_numpy(float)
    prior = sizes.get(1, 0) / max(1, sizes.get(0, 0) + sizes.get(1, 0))
    if 0 < y.sum() < len(y):
        weight = np.where(y == 1, prior / y.mean(), (1 - prior) / (1 - y.mean()))
        weights = logistic(seen[[f"f{i}" for i in range(FEATURES)]].to_numpy(float), y, weight)
    else:  # nothing to compare: the share of toxic labels
        weights = np.r_[math.log((prior + 1e-9) / (1 - prior + 1e-9)), np.zeros(FEATURES)]
    return Classifier(model, sent, weights)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds: int = 5, held_out_fold: int = 0, **options: int) -> DataFrame:
    """One row per row of docs: id, held_out, score, predicted.

    The score uses the text alone. A null text counts as empty, and an empty text, or one without a
    letter or digit, gets the score of no evidence. Without labels of both kinds every score is the
    share of toxic labels. Repeated rows get equal scores; an empty table gives an empty result.
    """
    found = train(docs, labels, id_col, text_col, label_col, folds, held_out_fold, **options)
    rows = docs.select(column(id_col).alias("id"), (fold(column(id_col), folds) == held_out_fold).alias("held_out"), column(text_col).alias("text"))
    scored = rows.mapInArrow(partial(_score, model=found.shipped, weights=found.weights), _with_score(rows))
    return scored.select(F.col("id").alias(id_col), "held_out", F.col("__score").alias("score"), (F.col("__score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options: object) -> DataFrame:
    """The rows of docs with a score below 0.5, with all their columns."""
    found = train(docs, labels, id_col, text_col, **options)
    rows = docs.select(whole(docs, "row"), column(text_col).alias("text"))
    scored = rows.mapInArrow(partial(_score, model=found.shipped, weights=found.weights), _with_score(rows))
    return unpacked(scored.filter("__score < 0.5"), "row", docs.columns)
