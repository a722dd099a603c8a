"""Language-model scores that sum over all segmentations of a text into the pieces of an existing vocabulary.

A word is a path through a lattice: each edge is a piece of the vocabulary, at the start one that begins
a word, and the path ends with a stop. A forward recursion in log space adds up the probabilities of all
paths. The vocabulary's own scores (they order its pieces; rank r counts as 1 / (r + 3)) weight the first
lattice; expected counts over all distinct training words then give the piece probabilities (one EM round).
lattice_score is a text's probability by these pieces alone: the product over its words and its end.

A vocabulary has a fixed number of weights, whatever the corpus. So that what is learned grows with the
corpus, `score` has a second kind of edge, which spans a whole word that was seen in training, with its discounted
share of the training tokens; what the discounts free goes to the piece paths. There is a row for each distinct word.
Words that make up 1 in `heavy` tokens or more, at most `heavy` of them, are looked up in each task; all
others meet their counts in a join, where no key can be hot.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import column, cut, fold, kind_of, ship, shipped, stable, texts

#: The key under which the ends of texts are counted; no word holds a space.
END = " "
#: Distinct words that a task counts before it passes the counts on.
FLUSH = 300_000
MARK = "▁"
#: Fixed value: how the vocabulary names its byte pieces.
BYTE = re.compile(r"<0x[0-9A-F]{2}>")
DISCOUNT = 0.75
#: Words of so many characters at most go through the lattice together, WORDS at once.
LONG, WORDS = 48, 4096
TEN = math.log(10)


def vocabulary(path: str) -> list[tuple[str, float]]:
    """(piece, score) of a sentencepiece file, its control and unknown pieces left out."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(sp.get_piece_size())
    return [(sp.id_to_piece(i), sp.get_score(i)) for i in ids if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]


def _sum(logs: list[float]) -> float:
    """log of the sum of what the logs stand for."""
    if len(logs) == 1:
        return logs[0]
    top = max(logs)
    return top + math.log(sum([math.exp(x - top) for x in logs]))


class Lattice:
    """Piece probabilities and the recursions over a word's segmentations, all in log space.

    weights: piece -> positive weight; the pieces that begin with the mark start a word and share a
    probability of 1, and so do all others together with the stop. A character that is in no piece is
    spelled in its UTF-8 byte pieces, which stand for nothing else.
    """

    def __init__(self, weights: dict[str, float], stop: float) -> None:
        first = sum(w for p, w in weights.items() if p.startswith(MARK))
        later = stop + sum(w for p, w in weights.items() if not p.startswith(MARK))
        self.p = {p: math.log(w / (first if p.startswith(MARK) else later)) for p, w in weights.items()}
        self.stop = math.log(stop / later)
        own = {p: q for p, q in self.p.items() if not BYTE.fullmatch(p)}
        #: every prefix of a piece -> the piece's log probability, None if the prefix itself is none
        self.prefixes = dict.fromkeys((p[:i] for p in own for i in range(1, len(p)))) | own
        self.byte = [self.p.get(f"<0x{b:02X}>", -math.inf) for b in range(256)]
        # the same prefixes as a trie: (number of a prefix, next character) -> number of the longer one
        number = {p: i for i, p in enumerate(self.prefixes, 1)} | {"": 0}
        keys = np.array([number[p[:-1]] << 21 | ord(p[-1]) for p in self.prefixes], np.int64)
        order = np.argsort(keys)
        self.next_keys, self.next_numbers = keys[order], order + 1
        self.names = ["", *self.prefixes]
        self.q = np.array([-math.inf if q is None else q for q in (None, *self.prefixes.values())])

    def edges(self, word: str) -> list[tuple[int, int, float]]:
        """(start, end, log probability), by start. An edge over one character that is no piece stands for
        its bytes. A mark inside the word is a character like others, which only bytes can spell."""
        text, prefixes, out = MARK + word, self.prefixes, []
        n = len(text)
        for start in range(n):
            if start and (text[start] == MARK or prefixes.get(text[start]) is None):
                out.append((start, start + 1, sum(self.byte[b] for b in text[start].encode())))
                if text[start] == MARK:
                    continue
            for end in range(start + 1, n + 1):
                piece = text[start:end]
                if piece not in prefixes:
                    break
                if (q := prefixes[piece]) is not None:
                    out.append((start, end, q))
        return out

    def forward(self, n: int, edges: list[tuple[int, int, float]]) -> list[float]:
        """Log of the summed probability of all paths to each position."""
        into: list[list[float]] = [[] for _ in range(n + 1)]
        log, at = [-math.inf] * (n + 1), -1
        into[0].append(0.0)
        for start, end, q in edges:
            if start != at:  # edges come by start, so all that lead here are known
                at, log[start] = start, _sum(into[start]) if into[start] else -math.inf
            into[end].append(log[at] + q)
        log[n] = _sum(into[n])
        return log

    def log10(self, word: str) -> float:
        """log10 of the word's probability as a product of pieces and the stop, over all segmentations."""
        n = len(word) + 1
        return (self.forward(n, self.edges(word))[n] + self.stop) / TEN

    def expected(self, word: str, into: dict[str, float]) -> None:
        """Add the expected number of uses of each piece in the word."""
        text, n = MARK + word, len(word) + 1
        edges = self.edges(word)
        ahead = self.forward(n, edges)
        out: list[list[float]] = [[] for _ in range(n + 1)]
        back, whole = [-math.inf] * (n + 1), ahead[n]
        out[n].append(0.0)
        back[n] = 0.0
        for start, end, q in reversed(edges):
            if back[end] == -math.inf and out[end]:
                back[end] = _sum(out[end])
            rest = q + back[end]
            out[start].append(rest)
            if (use := math.exp(ahead[start] + rest - whole)) > 0:
                piece = text[start:end]
                if self.prefixes.get(piece) is not None and (start == 0 or piece[0] != MARK):
                    into[piece] = into.get(piece, 0.0) + use
                else:
                    for b in piece.encode():
                        name = f"<0x{b:02X}>"
                        into[name] = into.get(name, 0.0) + use


    def _steps(self, words: list[str]) -> tuple[np.ndarray, list[tuple]]:
        """(lengths of the marked words, the edges of all words by start and end): a step is (start, end, which words,
        log probabilities, numbers of the pieces, or minus the character where its bytes stand for it)."""
        text = np.frombuffer("".join([MARK + w for w in words]).encode("utf-32-le"), np.uint32).astype(np.int64)
        n = np.array([len(w) + 1 for w in words])
        chars = np.full((len(words), n.max()), -1, np.int64)
        chars[np.arange(n.max()) < n[:, None]] = text
        kinds, at = np.unique(text, return_inverse=True)
        spelled = np.zeros(chars.shape)
        spelled[chars >= 0] = np.array([sum(self.byte[b] for b in chr(c).encode()) for c in kinds.tolist()])[at]
        mark, steps = ord(MARK), []

        def go(state: np.ndarray, ch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            wanted = state << 21 | ch
            place = np.minimum(np.searchsorted(self.next_keys, wanted), len(self.next_keys) - 1)
            return self.next_keys[place] == wanted, self.next_numbers[place]

        for start in range(n.max()):
            rows = np.flatnonzero(n > start)
            if start:
                ch = chars[rows, start]
                found, state = go(np.zeros_like(ch), ch)
                alone = (ch == mark) | ~found | (self.q[state] == -np.inf)
                if alone.any():
                    steps.append((start, start + 1, rows[alone], spelled[rows[alone], start], -ch[alone]))
                rows = rows[ch != mark]
            state, end = np.zeros(len(rows), np.int64), start
            while len(rows):
                found, state = go(state, chars[rows, end])
                rows, state, end = rows[found], state[found], end + 1
                q = self.q[state]
                if len(piece := np.flatnonzero(q > -np.inf)):
                    steps.append((start, end, rows[piece], q[piece], state[piece]))
                longer = n[rows] > end
                rows, state = rows[longer], state[longer]
        return n, steps

    def _forward(self, n: np.ndarray, steps: list[tuple]) -> np.ndarray:
        log = np.full((len(n), n.max() + 1), -np.inf)
        log[:, 0] = 0.0
        for start, end, rows, q, _ in steps:
            log[rows, end] = np.logaddexp(log[rows, end], log[rows, start] + q)
        return log

    def log10s(self, words: list[str]) -> list[float]:
        """log10() of each word, all at once; a word over LONG characters goes by itself."""
        out = np.zeros(len(words))
        short = [i for i, w in enumerate(words) if len(w) <= LONG]
        if short:
            n, steps = self._steps([words[i] for i in short])
            out[short] = (self._forward(n, steps)[np.arange(len(n)), n] + self.stop) / TEN
        for i, w in enumerate(words):
            if len(w) > LONG:
                out[i] = self.log10(w)
        return out.tolist()

    def all_expected(self, words: list[str], into: dict[str, float]) -> None:
        """expected() of each word, all at once; a word over LONG characters goes by itself."""
        for w in words:
            if len(w) > LONG:
                self.expected(w, into)
        short = [w for w in words if len(w) <= LONG]
        if not short:
            return
        n, steps = self._steps(short)
        ahead, every = self._forward(n, steps), np.arange(len(n))
        back = np.full(ahead.shape, -np.inf)
        back[every, n] = 0.0
        whole, names, uses = ahead[every, n], [], []
        for start, end, rows, q, name in reversed(steps):
            rest = q + back[rows, end]
            back[rows, start] = np.logaddexp(back[rows, start], rest)
            names.append(name)
            uses.append(np.exp(ahead[rows, start] + rest - whole[rows]))
        kinds, at = np.unique(np.concatenate(names), return_inverse=True)
        for name, use in zip(kinds.tolist(), np.bincount(at, np.concatenate(uses)).tolist(), strict=True):
            for piece in [self.names[name]] if name > 0 else [f"<0x{b:02X}>" for b in chr(-name).encode()]:
                into[piece] = into.get(piece, 0.0) + use


def lower_words(text: str) -> list[bytes]:
    return text.encode().lower().split()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen, trained = Counter(), Counter()

    def out() -> pa.RecordBatch:
        words = list(seen.keys() | trained.keys())
        train = [trained[w] for w in words]
        total = [seen[w] + t for w, t in zip(words, train, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()).cast(pa.string()), pa.array(train, pa.int64()), pa.array(total, pa.int64())], ["word", "c", "uses"])

    for batch in batches:
        for text, train in zip(texts(batch), batch.column("train").to_pylist(), strict=True):
            to = trained if train else seen
            to.update(lower_words(text))
            to[END.encode()] += 1
        if len(seen) + len(trained) > FLUSH:
            yield out()
            seen, trained = Counter(), Counter()
    yield out()


def _expect(batches: Iterator[pa.RecordBatch], lattice: object) -> Iterator[pa.RecordBatch]:
    lattice, found, words = shipped(lattice), {}, 0
    for batch in batches:
        for at in range(0, batch.num_rows, WORDS):
            part = batch.column("word").slice(at, WORDS).to_pylist()
            lattice.all_expected(part, found)
            words += len(part)
    yield pa.RecordBatch.from_arrays([pa.array([*found, ""], pa.string()), pa.array([*found.values(), float(words)], pa.float64())], ["piece", "n"])


def _spell(batches: Iterator[pa.RecordBatch], lattice: object) -> Iterator[pa.RecordBatch]:
    lattice = shipped(lattice)
    for batch in batches:
        spelled = []
        for at in range(0, batch.num_rows, WORDS):
            part = batch.column("word").slice(at, WORDS).to_pylist()
            spelled += [x if w != END else 0.0 for w, x in zip(part, lattice.log10s(part), strict=True)]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in ("word", "c", "uses")), pa.array(spelled, pa.float64())], ["word", "c", "uses", "spelled"])


class Terms:
    """What a token adds to a text's scores, from its training count and the log10 of its spelling."""

    def __init__(self, tokens: int, distinct: int) -> None:
        self.tokens, self.distinct = tokens, distinct

    def base(self, c: int) -> float:
        return math.log10((c + 0.5) / (self.tokens + 0.5 * (self.distinct + 1)))

    def model(self, c: int, spelled: float | None) -> float:
        """The whole-word edge and the piece paths; spelled is None for the end, which has no pieces."""
        n, whole = max(1, self.tokens), max(0.0, c - DISCOUNT)
        free = DISCOUNT * self.distinct / n if self.tokens else 1.0
        if spelled is None:
            return math.log10(whole / n) if whole else math.log10(0.5 / (n + 1))
        path = math.log10(free) + spelled
        if not whole:
            return path
        low = math.log10(whole / n)
        return low + math.log10(1 + 10 ** (path - low)) if path - low < 300 else path


def _documents(batches: Iterator[pa.RecordBatch], heavy: object) -> Iterator[pa.RecordBatch]:
    """A row for each document, with the sums over its heavy words and its end; and one for each of its
    other words. They share a row number that depends on the partition and the order within."""
    from pyspark import TaskContext

    table, end = shipped(heavy)
    number = TaskContext.get().partitionId() << 40
    sums_type = [("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("model", pa.float64()), ("pieces", pa.float64())]
    names = ["rid", "word", "freq", "doc"]
    get = table.get
    for batch in batches:
        doc_type = pa.struct([("id", batch.column("id").type), ("held_out", pa.bool_()), *sums_type])
        words, freq, rare, sums = [], [], [], []
        for text in texts(batch):
            counts = Counter(lower_words(text))
            tokens, before = 1, len(words)
            known, b, m, p = end
            for w, n in counts.items():
                tokens += n
                if (t := get(w)) is not None:
                    known += t[0] * n
                    b += t[1] * n
                    m += t[2] * n
                    p += t[3] * n
                else:
                    words.append(w)
                    freq.append(n)
            rare.append(len(words) - before)
            sums.append((tokens, known, b, m, p))
        numbers = np.arange(number, number + batch.num_rows, dtype=np.int64)
        number += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(numbers, rare)), pa.array(words, pa.binary()).cast(pa.string()), pa.array(freq, pa.int64()), pa.nulls(len(words), doc_type)], names)
        columns = [pa.array(c, k.type) for c, k in zip(zip(*sums, strict=True), list(doc_type)[2:], strict=True)] if sums else [pa.array([], k.type) for k in list(doc_type)[2:]]
        doc = pa.StructArray.from_arrays([batch.column("id"), batch.column("held_out"), *columns], fields=list(doc_type))
        # a document's own row is dealt by its number; no word begins with a space
        yield pa.RecordBatch.from_arrays([pa.array(numbers), pa.array([f" {r}" for r in numbers]), pa.nulls(batch.num_rows, pa.int64()), doc], names)


def lattice_scores(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, held_out_fold: int = 1, heavy: int = 100_000) -> DataFrame:
    """One row per row of docs: id, held_out, n_tokens, n_known, train_tokens, base_score, score, lattice_score.

    The rows whose crc32(id as text) modulo folds is not held_out_fold are learned from. A text's tokens
    are its words (ASCII letters lower-cased, separated by common.SPACES) and one end. base_score sums
    log10((c + 0.5) / (N + 0.5 * (V + 1))); score is the model's log10 probability of the text, lattice_score that of its
    segmentations into the vocabulary's pieces alone. A null text counts as empty: one token, the end. A
    null id counts as the empty text for the fold; ids of any type are passed through. Repeated
    rows are learned from and scored each. With no rows to learn from N is 0 and every c is 0.

    Rows are numbered as they are read; docs that are not read from files are written first, so that a
    task that runs again numbers them alike.
    """
    sc = docs.sparkSession.sparkContext
    rows = stable(docs.select(column(id_col).alias("id"), column(text_col).alias("text"))).withColumn("held_out", fold(F.col("id"), folds) == held_out_fold)
    part = rows.select("text", (~F.col("held_out")).alias("train")).mapInArrow(_count, "word string, c long, uses long")
    counts = cut(part.groupBy("word").agg(F.sum("c").alias("c"), F.sum("uses").alias("uses")))
    sums = counts.agg(F.sum("c"), F.sum(F.when(F.col("c") > 0, 1)), F.sum("uses"), F.sum(F.when(F.col("word") == END, F.col("c")))).first()
    tokens, distinct, uses, ends = (x or 0 for x in sums)
    terms = Terms(tokens, distinct)

    pieces = vocabulary(vocabulary_path)
    ranked = {p: 1.0 / (r + 3) for r, (p, _) in enumerate(sorted(pieces, key=lambda x: -x[1]))}
    seen = counts.filter((F.col("c") > 0) & (F.col("word") != END)).select("word")
    expected = seen.mapInArrow(partial(_expect, lattice=ship(sc, Lattice(ranked, 1.0))), "piece string, n double")
    found = {r["piece"]: r["n"] for r in expected.groupBy("piece").agg(F.sum("n").alias("n")).collect()}  # a row for each piece
    fitted = Lattice({p: found.get(p, 0.0) + 0.05 for p in ranked}, found.get("", 0.0) + 1.0)
    spelled = cut(counts.mapInArrow(partial(_spell, lattice=ship(sc, fitted)), "word string, c long, uses long, spelled double"))

    often = spelled.filter((F.col("uses") * heavy >= uses) & (F.col("word") != END)).select("word", "c", "spelled").toLocalIterator()
    table = {r["word"].encode(): (int(r["c"] > 0), terms.base(r["c"]), terms.model(r["c"], r["spelled"]), r["spelled"]) for r in often}
    end = (int(ends > 0), terms.base(ends), terms.model(ends, None), terms.model(ends, None))
    parts = rows.mapInArrow(
        partial(_documents, heavy=ship(sc, (table, end))),
        f"rid long, word string, freq long, doc struct<id:{kind_of(rows, 'id')},held_out:boolean,n_tokens:long,n_known:long,base:double,model:double,pieces:double>",
    )
    n, free = float(max(1, tokens)), DISCOUNT * distinct / max(1, tokens) if tokens else 1.0
    whole = F.greatest(F.lit(0.0), F.col("c") - DISCOUNT) / n
    path = F.lit(math.log10(free)) + F.col("spelled")
    low = F.log10(F.when(whole > 0, whole))
    model = F.when(low.isNull(), path).otherwise(low + F.log10(1 + F.pow(F.lit(10.0), F.least(F.lit(300.0), path - low))))
    rare = spelled.filter(F.col("uses") * heavy < uses).select(
        "word",
        (F.col("c") > 0).cast("int").alias("known"),
        F.log10((F.col("c") + 0.5) / (tokens + 0.5 * (distinct + 1))).alias("base"),
        model.alias("model"),
        F.col("spelled").alias("pieces"),
    )
    met = parts.join(rare, "word", "left")

    def total(name: str) -> Column:
        return F.max(f"doc.{name}") + F.coalesce(F.sum(rare[name] * F.col("freq")), F.lit(0.0))

    score = met.groupBy("rid").agg(
        F.max("doc.id").alias(id_col),
        F.max("doc.held_out").alias("held_out"),
        F.max("doc.n_tokens").alias("n_tokens"),
        (F.max("doc.n_known") + F.coalesce(F.sum(F.col("known") * F.col("freq")), F.lit(0))).cast("long").alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        total("base").alias("base_score"),
        total("model").alias("score"),
        total("pieces").alias("lattice_score"),
    )
    return score.drop("rid")
