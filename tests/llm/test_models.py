"""Language ID, toxicity, lattice scores, mixing, the pipeline, and the contracts' columns."""

import math
import pickle
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

import __spark_entry__
from factloom.llm.language_id import Filters, Letters, grams, languages
from factloom.llm.lattice_lm import MARK, Lattice, Terms, lattice_scores, vocabulary
from factloom.llm import mixing
from factloom.llm.mixing import hypergeometric, mix, mixed_documents, source_targets
from factloom.llm.toxicity import Table, drop_toxic, toxicity, train

PIECES = public_tokenizers.path("piece_bpe_32k.model")


def fold(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 5


def test_language_held_out_accuracy(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = languages(df).join(df.select("doc_id", "lang"), "doc_id").filter("held_out").toPandas()
    assert (got.lang_pred == got.lang).mean() > 0.95
    assert got.score.between(0, 1).all() and all(fold(i) == 0 for i in got.doc_id)


def test_language_edges(docs):
    rows = [(1, None), (2, ""), (3, "123 !!"), (4, "a"), (None, "the words of a text"), (6, "日本語 " * 3000)]
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in languages(docs(rows)).collect()}
    assert [got[i][0] for i in (1, 2, 3)] == ["und"] * 3 and got[4][0] in ("en", "und")
    assert {r["lang_pred"] for r in languages(docs(rows, lang=None)).collect()} == {"und"}
    assert languages(docs([]).limit(0)).count() == 0


def test_language_repeated_rows_ties_and_text_ids(spark, docs):
    rows = [(i, "das ist ein Satz" if i % 2 else "this is a sentence") for i in range(40)]
    df = docs(rows).selectExpr("'d' || doc_id as doc_id", "text", "if(doc_id % 2 = 1, 'de', 'en') as lang")
    got = languages(df.unionByName(df)).toPandas()
    assert len(got) == 80 and got.groupby("doc_id")[["lang_pred", "score"]].nunique().eq(1).all().all() and got.doc_id.str.startswith("d").all()
    same = languages(spark.createDataFrame([(i, "ab cd", lang) for i in range(9) for lang in ("y", "x")], "doc_id long, text string, lang string")).toPandas()
    assert set(same.lang_pred) == {"x"}  # of equal shares the first by name


def test_language_all_of_many_languages_are_learned(spark):
    """300 languages with words of their own, each with one row: none is left out."""
    word = lambda i: "".join(chr(0x4E00 + (i * 7 + j) % 20000) for j in range(4))
    rows = [(2 * k, f"{word(40 * k)} {word(40 * k + 13)}", f"l{k:03d}") for k in range(300)]
    got = languages(spark.createDataFrame(rows, "doc_id long, text string, lang string")).toPandas().sort_values("doc_id")
    learned = [not h for h in got.held_out]
    assert (got.lang_pred[learned] == [f"l{k:03d}" for k, ok in enumerate(learned) if ok]).all()


@pytest.mark.parametrize("text", ["one two " * 50, "abc", "ΑΣ' ΟΔΟΣ " * 20, "x" * 500 + " tail", " \n ", "日本 語" * 60])
def test_grams_do_not_depend_on_steps(text):
    letters = Letters()
    whole, parts = (sorted(h for x in grams(text, letters, step) for h in x.tolist()) for step in (1 << 20, 16))
    assert whole == parts


def test_filters_hold_every_entry_and_correct_for_false_hits():
    rnd = np.random.default_rng(2)
    own = rnd.integers(-(1 << 62), 1 << 62, (70, 200))
    f = Filters([f"l{i:02d}" for i in range(70)], own.ravel(), np.repeat(np.arange(70), 200))
    probe = np.r_[own[69], own[3][:50]].view(np.uint64)
    masks = np.bitwise_and.reduce([f.masks[at] for at in f._positions(probe)])
    by_hand = [int((masks[:, i // 8] >> (i % 8) & 1).sum()) for i in range(70)]
    hits = f.hits(probe)
    assert hits.tolist() == by_hand and hits[69] >= 200 and hits[3] >= 50 and np.delete(hits, [3, 69]).max() < 30
    assert sum(len(x) for x in grams("ab c", Letters())) == 3 + 5 + 3


def test_toxicity_separates_planted_words(spark, docs):
    plain = ["the house of the river and a garden", "some ordinary words about the weather today", "people walk along the road to the town"]
    rows, labels = [], []
    for i in range(400):
        toxic = i % 4 == 0
        rows.append((i, plain[i % 3] + f" item{i % 17} " + ("you total moron and idiot" if toxic else "thank you kind friend")))
        labels.append((i, None if i % 50 == 49 else int(toxic)))
    rows += [(1000, None), (1001, ""), (1002, "..."), (1003, "idiot " * 20000)]
    table = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity(docs(rows), table).collect()}
    assert len(got) == len(rows)
    assert all(got[i]["predicted"] == int(i % 4 == 0) for i in range(400) if fold(i) == 0)
    assert got[1000]["score"] == got[1001]["score"] == got[1002]["score"] and got[1003]["predicted"] == 1
    none = toxicity(docs(rows), table.limit(0)).toPandas()
    assert none.score.between(0, 1).all() and none.predicted.eq(0).all()


def kneser_ney_by_hand(texts):
    """{(first or None, word): ratio of the two classes' probabilities} and {word: firm evidence}; texts: (words, label)."""
    d, alone, pairs, inside = 0.75, (Counter(), Counter()), (Counter(), Counter()), (Counter(), Counter())
    for words, y in texts:
        alone[y].update(words)
        inside[y].update(set(words))
        pairs[y].update(zip(words, words[1:], strict=False))
    every = pairs[0].keys() | pairs[1].keys()
    after = Counter(b for _, b in every)
    shared = {w: (after[w] + 0.5) / len(every) for w in alone[0].keys() | alone[1].keys()}

    def one(counts, y, w):
        n = sum(counts[y].values())
        return max(counts[y][w] - d, 0) / n + d * len(alone[y]) / n * shared[w]

    def two(y, a, w):
        n = sum(c for (x, _), c in pairs[y].items() if x == a)
        types = sum(x == a for x, _ in pairs[y])
        return max(pairs[y][a, w] - d, 0) / n + d * types / n * one(alone, y, w) if n else one(alone, y, w)

    ratio = {(None, w): math.log(one(alone, 1, w) / one(alone, 0, w)) for w in shared}
    ratio |= {(a, w): math.log(two(1, a, w) / two(0, a, w)) for a in shared for w in shared}
    firm = {w: math.log(one(inside, 1, w) / one(inside, 0, w)) if inside[0][w] + inside[1][w] >= 5 else 0.0 for w in shared}
    return ratio, firm


def test_toxicity_ratios_by_hand(spark, docs):
    """Every word and pair of the sample, the rare ones too, and pairs that were never seen."""
    rnd = np.random.default_rng(5)
    names = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join(rnd.choice(names, 12, p=np.arange(40, 0, -1) / 820))) for i in range(90)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i, _ in rows], "doc_id long, toxic int")
    model = pickle.loads(pickle.dumps(train(docs(rows), labels, per_class=10_000).model))
    parts = {r[0]: r[1] for r in spark.createDataFrame(rows, "id long, t string").selectExpr("id", "pmod(xxhash64('part', id), 5) <> 0").collect()}
    learned = [([w.encode() for w in t.split()], int(i % 3 == 0)) for i, t in rows if fold(i) != 0 and parts[i]]
    ratio, firm = kneser_ney_by_hand(learned)
    words = sorted(firm)
    assert len(model.words.rows[0]) == len(words) and len(model.pairs.rows[0]) == len({p for t, _ in learned for p in zip(t, t[1:], strict=False)})
    for a in words:
        for b in words:
            after, own = model.ratios([a, b])
            assert after == pytest.approx([ratio[None, a], ratio[a, b]], abs=1e-4) and own == pytest.approx([firm[a], firm[b]], abs=1e-4)
    assert model.ratios([b"never", words[0]])[0] == pytest.approx([model.unseen, ratio[None, words[0]]], abs=1e-4)


def test_table_finds_what_it_holds_and_nothing_else():
    rnd = np.random.default_rng(3)
    for n in (0, 1, 7, 5000):
        keys = np.unique(np.r_[rnd.integers(0, 1 << 63, n).astype(np.uint64), (np.arange(min(n, 40), dtype=np.uint64) << np.uint64(40)) + np.uint64(3)]) if n else np.zeros(0, np.uint64)
        table = Table(keys, [np.arange(len(keys), dtype=np.float32)])
        at, found = table.find(keys)
        assert found.all() and (table.columns[0][at] == np.arange(len(keys))).all()
        again = pickle.loads(pickle.dumps(table))
        assert again.find(keys)[1].all() and (again.columns[0][again.find(keys)[0]] == np.arange(len(keys))).all()
        other = np.setdiff1d(np.r_[rnd.integers(0, 1 << 63, 1000).astype(np.uint64), np.arange(50, dtype=np.uint64)], keys)
        assert not table.find(other)[1].any()


def test_toxicity_edges(spark, docs):
    plain = [(i, f"calm words number {i % 9} and more of them {i}") for i in range(60)] + [(100 + i, f"you idiot number {i % 9} and more of them {i}") for i in range(60)]
    labels = spark.createDataFrame([(i, int(i >= 100)) for i, _ in plain], "doc_id long, toxic int")
    df = docs(plain)
    twice = toxicity(df.unionByName(df), labels).toPandas()
    assert len(twice) == 240 and twice.groupby("doc_id").score.nunique().eq(1).all()
    assert toxicity(docs([]).limit(0), labels).count() == 0
    odd = df.selectExpr("*", "1 as label", "2 as row", "3 as `a.b`", "4 as __score", "5 as __id")
    kept = drop_toxic(odd, labels)
    assert kept.columns == odd.columns and {r["a.b"] for r in kept.collect()} == {3}
    assert drop_toxic(docs([(None, None), (None, ""), (1, "calm words")]), labels.limit(0)).count() == 3


def test_toxicity_repeatable(spark, small):
    d, labels = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet")
    a, b = (toxicity(d, labels).orderBy("doc_id").toPandas() for _ in range(2))
    assert np.allclose(a.score, b.score)


def by_hand(lattice, word):
    text = MARK + word

    def rest(i):
        if i == len(text):
            return math.exp(lattice.stop)
        whole = lambda piece: piece in lattice.p and not piece.startswith("<0x")
        total = sum(math.exp(lattice.p[text[i:j]]) * rest(j) for j in range(i + 1, len(text) + 1) if whole(text[i:j]) and (i == 0) == (text[i] == MARK))
        if i and (text[i] == MARK or not whole(text[i])):
            total += math.exp(sum(lattice.p[f"<0x{b:02X}>"] for b in text[i].encode())) * rest(i + 1)
        return total

    return math.log10(rest(0))


@pytest.fixture(scope="module")
def lattice():
    return Lattice({p: 1 / (r + 3) for r, (p, _) in enumerate(vocabulary(PIECES))}, 1.0)


@pytest.mark.parametrize("word", ["the", "x", "", "segmentations", "日本é", "a▁b", "🙂", "x<0x41>", "<0x41>"])
def test_lattice_sums_all_segmentations(lattice, word):
    assert lattice.log10(word) == pytest.approx(by_hand(lattice, word), rel=1e-9)


def test_lattice_long_words_and_expected_counts(lattice):
    once = lattice.log10("q" * 40)
    assert lattice.log10("q" * 4000) < 90 * once / 1.1 and math.isfinite(lattice.log10("日" * 3000))
    found = {}
    lattice.expected("segmentations", found)
    assert sum(len(p) * n for p, n in found.items()) == pytest.approx(len("▁segmentations"))


def paths_by_hand(lattice, word):
    """(probability, pieces) of every segmentation."""
    text, out = MARK + word, []

    def go(i, p, used):
        if i == len(text):
            out.append((p, used))
            return
        for j in range(i + 1, len(text) + 1):
            if text[i:j] in lattice.p and (i == 0) == (text[i] == MARK):
                go(j, p * math.exp(lattice.p[text[i:j]]), [*used, text[i:j]])
        if text[i] not in lattice.p:
            names = [f"<0x{b:02X}>" for b in text[i].encode()]
            go(i + 1, p * math.exp(sum(lattice.p[n] for n in names)), used + names)

    go(0, 1.0, [])
    return out


@pytest.mark.parametrize("word", ["segments", "x🙂y", "aaaaaa", ""])
def test_expected_counts_over_all_segmentations(lattice, word):
    paths, found, want = paths_by_hand(lattice, word), {}, Counter()
    for p, used in paths:
        for piece in used:
            want[piece] += p / sum(q for q, _ in paths)
    lattice.expected(word, found)
    assert found == pytest.approx(dict(want), abs=1e-12)


def test_words_together_are_words_alone(lattice):
    rnd = np.random.default_rng(9)
    letters = [*"etaoinshr", "é", "日", "🙂", "<", "0", MARK, "\u0301"]
    words = ["", "x<0x41>", "a▁b", *("".join(rnd.choice(letters, rnd.integers(1, 60))) for _ in range(150)), "segmentations" * 30]
    assert lattice.log10s(words) == pytest.approx([lattice.log10(w) for w in words], rel=1e-12)
    one, all_ = {}, {}
    for w in words:
        lattice.expected(w, one)
    lattice.all_expected(words, all_)
    assert all_ == pytest.approx(one, rel=1e-9, abs=1e-12)
    assert lattice.log10s([]) == [] and lattice.all_expected([], {}) is None


def test_expected_counts_of_a_long_word_are_of_the_whole(lattice):
    found = {}
    lattice.expected("segmentations" * 30, found)
    assert sum(len(p) * n for p, n in found.items()) == pytest.approx(13 * 30 + 1) and sum(n for p, n in found.items() if p[0] == MARK) == pytest.approx(1)


def test_lattice_scores_contract(docs):
    rows = [(i, f"The cat sat on mat{i % 7} The") for i in range(60)] + [(100, None), (101, "unknownword zzz"), (None, "The"), (102, "w " * 50000)]
    got = {r["doc_id"]: r for r in lattice_scores(docs(rows), PIECES, heavy=3).collect()}
    train = [(i, t) for i, t in rows if fold(i) != 1]
    c = Counter(w for _, t in train for w in [*(t or "").lower().split(), None])
    n, v = sum(c.values()), len(c)
    for i, t in rows:
        tokens = [*(t or "").lower().split(), None]
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (fold(i) == 1, len(tokens), sum(c[w] > 0 for w in tokens), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens), rel=1e-9)
        assert r["score"] < 0
    many = {r["doc_id"]: r["score"] for r in lattice_scores(docs(rows), PIECES, heavy=100_000).collect()}
    assert all(many[i] == pytest.approx(got[i]["score"], rel=1e-9) for i, _ in rows)  # both ways to a word's terms agree
    assert lattice_scores(docs([]).limit(0), PIECES).count() == 0


def targets_by_hand(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, left, open_ = {}, 1.5 * sum(sizes.values()), set(order)
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_} if open_ else {}
        over = {s for s in open_ if share[s] > 2 * sizes[s] + 1e-9}
        if not over:
            return target | share
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        open_ -= over


@pytest.mark.parametrize("sizes", [{"a": 10}, {"a": 10, "b": 1000, "c": 5, None: 70}, {"x": 0, "y": 40, "z": 3}, {f"s{i}": i * i + 1 for i in range(20)}])
def test_source_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, size long")
    got = {r["source"]: r["target"] for r in source_targets(df).collect()}
    want = targets_by_hand(sizes)
    assert got == pytest.approx(want)


def test_scores_by_hand(docs):
    """One round over the few distinct training words, then both scores of seen and unseen words."""
    words, new = ["walking", "talked", "houses", "river", "stone" * 20], "walked"
    train, held = [i for i in range(40) if fold(i) != 1][:5], next(i for i in range(40) if fold(i) == 1)
    ranked = {p: 1.0 / (r + 3) for r, (p, _) in enumerate(sorted(vocabulary(PIECES), key=lambda x: -x[1]))}
    found, first = {}, Lattice(ranked, 1.0)
    for w in words:
        first.expected(w, found)
    fitted = Lattice({p: found.get(p, 0.0) + 0.05 for p in ranked}, len(words) + 1.0)
    terms = Terms(10, 6)
    got = {r["doc_id"]: r for r in lattice_scores(docs([*zip(train, words), (held, new)]), PIECES).collect()}
    for i, w, c in [*((i, w, 1) for i, w in zip(train, words)), (held, new, 0)]:
        assert got[i]["score"] == pytest.approx(terms.model(c, fitted.log10(w)) + terms.model(5, None), abs=1e-9)
        assert got[i]["lattice_score"] == pytest.approx(fitted.log10(w) + terms.model(5, None), abs=1e-9)


def test_lattice_scores_of_repeated_rows_and_text_ids(docs):
    rows = docs([(1, "a cat sat"), (1, "a cat sat"), (1, "another"), (None, None), (None, "x")])
    got = lattice_scores(rows.repartition(3).selectExpr("'d' || doc_id as doc_id", "text"), PIECES).toPandas()
    assert len(got) == 5 and sorted(got.n_tokens) == [1, 2, 2, 4, 4] and got[got.n_tokens == 4].score.nunique() == 1


def test_hypergeometric_law(spark):
    from pyspark.sql import functions as F

    u = (F.col("id") + 0.5) / 4000
    for n, left, q in ((30, 12, 9), (5, 5, 3), (4, 0, 2), (7, 3, 0), (100_000, 40_000, 30_000), (1_000_000_000, 300_000_000, 500_000)):
        x = spark.range(4000).select(hypergeometric(F.lit(n), F.lit(left), F.lit(q), u).alias("x")).toPandas().x
        mean, var = q * left / n, q * left / n * (1 - left / n) * (n - q) / max(1, n - 1)
        assert x.min() >= max(0, q - (n - left)) and x.max() <= min(q, left)
        # u runs over the unit interval evenly, so the values are the quantiles of the law
        assert abs(x.mean() - mean) < 0.02 + 0.001 * math.sqrt(var) and x.var() == pytest.approx(var, rel=0.02, abs=0.02)


def test_hypergeometric_quantiles_by_hand(spark):
    from pyspark.sql import functions as F

    n, left, q = 40, 17, 11
    law = [math.comb(left, k) * math.comb(n - left, q - k) / math.comb(n, q) for k in range(q + 1)]
    u = [(i + 0.5) / 500 for i in range(500)]
    want = [next(k for k in range(q + 1) if sum(law[: k + 1]) >= x - 1e-12) for x in u]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(u)], "i int, u double")
    got = [r["x"] for r in df.select("i", hypergeometric(F.lit(n), F.lit(left), F.lit(q), F.col("u")).alias("x")).orderBy("i").collect()]
    assert got == want


def blocks_by_hand(size, width=128):
    return [width] * (size // width) + ([size % width] if size % width else [])


def kind_by_hand(words, width=128, kinds=8):
    return 0 if words == width else kinds - (words - 1) * kinds // width


def quotas_by_hand(docs_, target):
    """How many blocks of each kind a source with documents of these sizes gives to its last, partial pass."""
    parts = [w for size in docs_ for w in blocks_by_hand(size)]
    left, there, taken, out = (round(target) % sum(docs_)) / sum(docs_), 0, 0.0, []
    if round(target) >= 2 * sum(docs_):
        left = 0.0
    for k in range(9):
        own = [w for w in parts if kind_by_hand(w) == k]
        there += sum(own)
        mean = sum(own) / max(1, len(own))
        q = min(len(own), max(0, math.floor((left * there - taken) / max(1, mean) + 0.5))) if own else 0
        taken += q * mean
        out.append(q)
    return out


def test_mix_invariants(spark, docs):
    rows = [(i, "w " * (i % 300), None if i % 11 == 0 else f"s{i % 4}") for i in range(800)] + [(5000, None, "s1"), (5000, None, "s1"), (None, "a b", "s2"), (7, "w " * 9000, "s0")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 as size", "'x' as shard", "2 as number", "3 as kind")
    out = mixed_documents(df, shard_words=4096).toPandas()
    assert len(out) == len(rows) and (out.taken <= 2 * out["size"]).all()
    by = out.groupby("source", dropna=False).agg(size=("size", "sum"), source_size=("source_size", "first"), target=("target", "first"), taken=("taken", "sum"))
    assert (by["size"] == by.source_size).all() and (abs(by.taken - by.target) < 160).all()
    again = mixed_documents(df.repartition(7), shard_words=4096).toPandas()
    key = ["doc_id", "source", "size", "taken"]
    assert sorted(out[key].astype(str).values.tolist()) == sorted(again[key].astype(str).values.tolist())
    blocks = mix(df, shard_words=4096).toPandas()
    drawn = blocks[blocks.extra == 1]
    assert not drawn.duplicated(["id", "copy", "size", "block", "source"]).any()
    # the blocks are those of the documents, and of each kind the exact number is drawn
    sizes_ = {}
    for _, text, source in rows:
        sizes_.setdefault(source, []).append(len((text or "").split()))
    for source, target in zip(by.index, by.target, strict=True):
        source = None if source != source else source
        own = blocks[blocks.source.isna() if source is None else blocks.source == source]
        assert sorted(own.words[own.words > 0]) == sorted(w for size in sizes_[source] for w in blocks_by_hand(size))
        got = own[own.extra == 1].words.map(kind_by_hand).value_counts()
        assert [got.get(k, 0) for k in range(9)] == quotas_by_hand(sizes_[source], target), source
    # positions: the drawn blocks of a shard come first, each place once
    for _, shard in blocks.groupby("shard"):
        assert sorted(shard.position) == list(range(1, len(shard) + 1))
        taken = (shard.passes + shard.extra > 0) & (shard.words > 0)
        assert shard.position[taken].max() == taken.sum() or not taken.any()
    assert mixed_documents(docs([]).limit(0)).count() == 0
    assert mixed_documents(docs([(1, None), (2, " ")])).toPandas().taken.tolist() == [0, 0]


def test_mix_splits_deep_trees(spark, monkeypatch):
    """One source over 512 pools and three levels: exact totals, and shards that differ as the law says."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(mixing, "POOL_BLOCKS", 16)
    df = spark.range(8192).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), 256).alias("text"), F.lit("s").alias("source"))
    blocks = mix(df, shard_words=8192, total_share=0.5).toPandas()
    assert blocks.extra.sum() == 8192 and blocks.shard.nunique() > 100
    by = blocks.groupby("shard").extra.agg(["sum", "count"])
    z = (by["sum"] - by["count"] / 2) / (by["count"] ** 0.5 / 2)
    assert abs(z.mean()) < 0.2 and 0.7 < z.std() < 1.3


def test_mix_of_many_small_sources(spark):
    """3,000 sources with 8 blocks each over 2,048 shards: each is within half a block of its target."""
    from pyspark.sql import functions as F

    df = spark.range(24_000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), 128).alias("text"), F.format_string("s%04d", F.col("id") % 3000).alias("source"))
    by = mixed_documents(df, shard_words=4096).groupBy("source").agg(F.first("target").alias("target"), F.sum("taken").alias("taken")).toPandas()
    off = by.taken - by.target
    assert len(by) == 3000 and (off.abs() <= 65).all(), (off.abs().max(), off.groupby(by.target.round()).mean())


CONTRACTS = {
    "op1": {"doc_id": "bigint", "keep_id": "bigint", "group_size": "bigint", "kept": "boolean", "text_sha256": "string"},
    "op2": {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
    "op3": {"doc_id": "bigint", "n_bytes": "bigint", "n_tokens": "bigint", "over_limit": "boolean"},
    "op4": {"doc_id": "bigint", "n_assign": "bigint", "n_access": "bigint", "n_hex": "bigint", "base_sha256": "string", "spans": "string"},
    "op5": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op6": {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"},
    "op7": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op8": {"doc_id": "bigint", "n_words": "bigint", "n_removed": "bigint", "kept_sha256": "string"},
    "op9": {"doc_id": "bigint", "held_out": "boolean", "n_tokens": "bigint", "n_known": "bigint", "train_tokens": "bigint", "base_score": "double", "score": "double"},
    "op10": {"doc_id": "bigint", "n_words": "bigint", "n_hit": "bigint", "n_items": "bigint", "items_sha256": "string", "contaminated": "boolean"},
}


@pytest.mark.parametrize("op", CONTRACTS)
def test_query_columns_and_rows(spark, small, op):
    (name,) = [n for n in __spark_entry__.queries() if n.startswith(f"{op}_")]
    df = __spark_entry__.queries()[name](spark, small)
    assert CONTRACTS[op].items() <= dict(df.dtypes).items()
    assert df.count() == spark.read.parquet(f"{small}/documents.parquet").count()


def kept_of_equal(rows):
    """Brute force of the exact stage: of equal texts the longest stays, then the smallest id."""
    best = {}
    for i, t in rows:
        key = "".join((t or "").split(" ")).translate(dict.fromkeys(map(ord, "\t\n\x0b\x0c\r")))
        best[key] = min(best.get(key, (1, 0)), (-len(t or ""), i))
    return {i for _, i in best.values()}


def kept_of_near(rows):
    """Brute force of the near-copy stage: fingerprints of all pairs."""
    from factloom.llm.simhash import word_fingerprints

    prints = {i: word_fingerprints((t or "").encode().lower().split(), 3) for i, t in rows}
    group = {i: i for i in prints}
    for a in sorted(prints):
        for b in sorted(prints):
            if b < a and group[a] != group[b] and any((x ^ y).bit_count() <= 3 for x, y in zip(prints[a], prints[b], strict=True)):
                old, new = max(group[a], group[b]), min(group[a], group[b])
                group = {i: new if g == old else g for i, g in group.items()}
    return set(group.values())


def kept_of_clean(rows, items, window=13):
    """Brute force of the decontamination stage."""
    from factloom.llm.decontamination import words_of

    windows = set()
    for _, t in items:
        w = words_of(t or "")
        windows |= {tuple(w[i : i + window]) for i in range(max(1, len(w) - window + 1))} if w else set()
    kept = set()
    for i, t in rows:
        w, hit = words_of(t or ""), set()
        for size in {len(x) for x in windows}:
            for at in range(len(w) - size + 1):
                if tuple(w[at : at + size]) in windows:
                    hit |= set(range(at, at + size))
        if not hit or 20 * len(hit) < len(w):
            kept.add(i)
    return kept


def test_pipeline_stages(spark, small):
    """Each stage against brute force on what the one before it kept."""
    import corpus_pipeline as p

    docs, benchmark = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/benchmark.parquet")
    columns, items = docs.columns, [(r["item_id"], r["text"]) for r in benchmark.collect()]
    calm = {r["doc_id"] for r in toxicity(docs, spark.read.parquet(f"{small}/labels.parquet")).filter("predicted = 0").collect()}
    want = [lambda rows: calm, kept_of_equal, kept_of_near, lambda rows: kept_of_clean(rows, items)]
    for (name, stage), by_hand in zip(p.STAGES[:-1], want, strict=True):
        rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
        docs = stage(spark, docs, small).checkpoint()
        assert docs.columns == columns, name
        assert sorted(r["doc_id"] for r in docs.collect()) == sorted(by_hand(rows)), name
    left = docs.select("doc_id", "text", "source").collect()
    out = p.STAGES[-1][1](spark, docs, small).toPandas()
    assert sorted(out.doc_id) == sorted(r["doc_id"] for r in left) and (out.taken <= 2 * out["size"]).all()
    drawn = out.draws.map(lambda d: 0 if d is None else sum(r["n_words"] * r["times"] for r in d))
    assert (drawn == out.taken).all()
    sizes_ = {}
    for r in left:
        sizes_.setdefault(r["source"], []).append(len((r["text"] or "").split()))
    targets = targets_by_hand({k: sum(v) for k, v in sizes_.items()})
    for source, own in out.groupby("source", dropna=False):
        source = None if source != source else source
        quotas, words = quotas_by_hand(sizes_[source], targets[source]), Counter()
        for d in own.draws:
            for r in d if d is not None else []:
                words[kind_by_hand(r["n_words"])] += r["times"] - round(targets[source]) // max(1, sum(sizes_[source]))
        assert [words[k] for k in range(9)] == quotas, source
    assert sorted(p.run(spark, small).toPandas().doc_id) == sorted(out.doc_id)


def test_mixing_stage_edges(spark, docs):
    import corpus_pipeline as p

    df = docs([(1, None), (None, ""), (2, "a b c " * 100), (2, "a b c " * 100), (None, "x y")]).selectExpr("*", "1 as taken", "2 as draws", "3 as number", "4 as `a.b`")
    out = p.mixed(spark, df, "").toPandas()
    assert len(out) == 5 and out[out["size"] == 0].taken.eq(0).all() and (out.taken <= 2 * out["size"]).all()
    assert p.mixed(spark, docs([]).limit(0), "").count() == 0
