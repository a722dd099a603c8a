"""Exact dedup, SimHash, components: edge cases and brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash

from factloom.llm import exact_dedup, simhash
from factloom.llm.components import connected_components

SPACE = re.compile(r"[\x20\x09-\x0D]")


def groups_by_hand(rows):
    by = {}
    for i, t in rows:
        by.setdefault(SPACE.sub("", t or ""), []).append((-len(t or ""), i is None, i or 0, i))
    return {k: (min(v)[3], len(v)) for k, v in by.items()}


def test_exact_groups_edges(docs):
    rows = [(3, "a b"), (1, "a  b"), (2, "ab"), (5, None), (4, ""), (6, " \t"), (7, "é b" * 20000), (8, "éb" * 20000), (9, "a b"), (None, "ab"), (None, "zz")]
    got = exact_dedup.exact_groups(docs(rows)).collect()
    want = groups_by_hand(rows)
    assert len(got) == len(rows)
    texts = dict(rows)
    for r in got:
        if r["doc_id"] is not None:
            norm = SPACE.sub("", texts[r["doc_id"]] or "")
            assert (r["keep_id"], r["group_size"]) == want[norm]
            assert r["text_sha256"] == hashlib.sha256(norm.encode()).hexdigest()
    assert sorted(r["doc_id"] for r in got if r["kept"] and r["doc_id"] is not None) == [1, 6, 7, 9]


def test_exact_repeated_rows_keep_one(docs):
    df = docs([(1, "x y"), (1, "x y"), (2, "xy"), (1, "x y")])
    assert sum(r["kept"] for r in exact_dedup.exact_groups(df).collect()) == 1
    assert exact_dedup.drop_copies(df).count() == 1


def test_exact_empty_table(docs):
    df = docs([]).limit(0)
    assert exact_dedup.exact_groups(df).count() == 0
    assert exact_dedup.drop_copies(df).columns == df.columns


def test_collision_splits_the_group(docs, monkeypatch):
    """With a hash that maps all to one value, the bytes still tell texts apart."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(exact_dedup.F, "md5", lambda c: F.lit("00"))
    got = {r["doc_id"]: r["keep_id"] for r in exact_dedup.exact_groups(docs([(1, "a"), (2, "b"), (3, "a "), (4, "b")])).collect()}
    assert got == {1: 3, 2: 2, 3: 3, 4: 2}


def test_drop_copies_keeps_columns(docs):
    df = docs([(2, "a b c"), (1, "abc"), (3, "other")])
    assert sorted((r["doc_id"], r["text"]) for r in exact_dedup.drop_copies(df).collect()) == [(2, "a b c"), (3, "other")]


def fingerprint_by_hand(text, k=3):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", [None, "", " \n ", "one", "One two", "a b c", "É é  x\ty", "w " * 70000, "the quick brown fox " * 5])
def test_fingerprint(text):
    assert simhash.fingerprint((text or "").encode().lower().split()) == fingerprint_by_hand(text)


def test_near_links_find_every_pair(spark):
    """Clusters of few flipped bits, and random ones, against all pairs."""
    rnd = random.Random(5)
    points = set()
    for _ in range(60):
        x = rnd.getrandbits(64)
        points.add(x)
        for _ in range(6):
            points.add(x ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(1, 5))))
    points |= {0, 1, (1 << 64) - 1, 1 << 63}
    fps = sorted(points)
    rows = [(int(np.uint64(x).astype(np.int64)), i) for i, x in enumerate(fps)]
    table = spark.createDataFrame(rows, "fp long, node long").cache()
    for distance, groups in ((3, None), (3, 4), (3, 9), (1, 5), (0, 3), (5, 8)):
        got = {(r["a"], r["b"]) for r in simhash.near_links(table, distance, groups).collect()}
        want = {(j, i) for i in range(len(fps)) for j in range(i + 1, len(fps)) if (fps[i] ^ fps[j]).bit_count() <= distance}
        assert got == want, (distance, groups)


def test_more_points_get_longer_cells():
    for n, most in ((10**5, 6), (10**7, 8), (10**9, 11), (10**11, 16)):
        groups = simhash.groups_for(n, 3)
        assert groups <= most and n * 0.375 ** (32 * (groups - 3) / groups) <= 1
        masks = simhash.group_masks(groups, 3)
        assert len(masks) == len(set(masks)) == groups * (groups - 1) * (groups - 2) // 6


@pytest.mark.parametrize("drop", [exact_dedup.drop_copies, simhash.drop_near_copies])
def test_columns_of_any_name_come_through(docs, drop):
    """Names that the operators use inside, a dot, a back-tick, and ids that are texts."""
    df = docs([(1, "x y z"), (2, "xyz"), (3, "other words here"), (None, "x y z"), (None, None)])
    odd = df.selectExpr("'d' || doc_id as doc_id", "text", "'mine' as __sha", "7 as __n", "8 as `a.b`", "9 as `c``d`", "'r' as row", "1 as mark", "2 as points", "3 as sha", "4 as turn", "5 as copy")
    got = drop(odd)
    assert got.columns == odd.columns
    rows = got.collect()
    assert {(r["__sha"], r["__n"], r["a.b"], r["c`d"], r["row"], r["mark"], r["points"], r["sha"], r["turn"], r["copy"]) for r in rows} == {("mine", 7, 8, 9, "r", 1, 2, 3, 4, 5)}
    assert {r["doc_id"] for r in rows} == {"d1", "d3", None} | ({"d2"} if drop is simhash.drop_near_copies else set())


def test_near_components(docs):
    rows = [(5, "same words here now"), (3, "Same  words here now"), (9, None), (8, "  "), (2, "quite another text about things"), (2, "quite another text about things")]
    got = {(r["doc_id"], r["component_id"]) for r in simhash.near_components(docs(rows)).collect()}
    assert got == {(5, 3), (3, 3), (9, 8), (8, 8), (2, 2)}
    assert simhash.near_components(docs(rows)).count() == 6
    assert sorted(r["doc_id"] for r in simhash.drop_near_copies(docs(rows)).collect()) == [2, 3, 8]
    assert simhash.drop_near_copies(docs([]).limit(0)).count() == 0
    assert simhash.near_components(docs([]).limit(0)).count() == 0


def test_near_copies_of_null_and_shared_ids(docs):
    """Each component keeps one row, whatever its ids; an id does not link the texts that share it."""
    texts = ["same words here now", "quite another text about things", "a third one that is of its own", "the fourth has yet other words in it"]
    rows = [(None, texts[0]), (None, "Same  words here now"), (None, texts[1]), (4, texts[2]), (4, texts[3]), (4, texts[3]), (None, texts[3]), (None, None), (None, "")]
    kept = [(r["doc_id"], r["text"]) for r in simhash.drop_near_copies(docs(rows)).collect()]
    assert len(kept) == 5 and {t or "" for _, t in kept} in ({*texts, ""}, {"Same  words here now", *texts[1:], ""})
    assert {t: i for i, t in kept}[texts[2]] == 4 and {t: i for i, t in kept}[texts[3]] == 4
    by_hand = {simhash.fingerprint(t.encode().lower().split()): t for t in texts}
    found = {int(r["fingerprint"], 16): r["component_id"] for r in simhash.near_components(docs([(9, texts[0]), (4, texts[1]), (4, texts[0]), (7, texts[1])])).collect()}
    assert {by_hand[f]: c for f, c in found.items()} == {texts[0]: 4, texts[1]: 4}
    apart = [(5, texts[0]), (5, texts[1]), (6, texts[1]), (7, texts[0])]
    assert sorted((r["doc_id"], r["text"]) for r in simhash.drop_near_copies(docs(apart)).collect()) == sorted(apart[:2])


def test_near_null_ids_are_linked(docs, monkeypatch):
    """A null id's fingerprint joins those within the distance."""
    monkeypatch.setattr(simhash, "fingerprints", lambda d, *a: d.selectExpr("doc_id as id", "cast(text as long) as fp"))
    got = [(r["doc_id"], r["component_id"]) for r in simhash.near_components(docs([(None, "0"), (8, "7"), (None, "63"), (3, "4095")])).collect()]
    assert sorted(got, key=str) == [(3, 3), (8, 8), (None, 8), (None, 8)]


def test_components_of_chains_and_cycles(spark):
    rnd = random.Random(1)
    links = [(i, i + 1) for i in range(50)] + [(100, 101), (101, 102), (102, 100), (7, 7)] + [(200 + rnd.randrange(40), 200 + rnd.randrange(40)) for _ in range(30)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert got == {x: find(x) for x in linked}


def similarity(a, b, n=5):
    a, b = ({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} for w in (a.lower().split(), b.lower().split()))
    return len(a & b) / len(a | b)


def test_word_fingerprints_by_hand():
    words = [b"one", b"two", b"one", b"three"]

    def mixed(h, i):
        m = (1 << 64) - 1
        x = (h + i * 0x9E3779B97F4A7C15) & m
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & m
        x = (x ^ x >> 27) * 0x94D049BB133111EB & m
        return x ^ x >> 31

    hashes = [xxhash.xxh64_intdigest(w) for w in set(words)]
    want = [sum(1 << b for b in range(64) if 2 * sum(mixed(h, i) >> b & 1 for h in hashes) > 3) for i in range(3)]
    assert simhash.word_fingerprints(words, 3) == want and simhash.word_fingerprints([], 2) == [0, 0]
    many = [f"w{i % 40000}".encode() for i in range(90000)]
    assert simhash.word_fingerprints(many, 1) == simhash.word_fingerprints(many[::-1], 1)


def test_near_copies_are_found_and_others_stay(docs):
    """Edited copies with a similarity of five-word shingles of 0.8 or more, beside texts of the same vocabulary."""
    rnd = random.Random(11)
    vocabulary, common = [f"word{i}" for i in range(3000)], [f"the{i}" for i in range(30)]
    rows, group = [], {}
    for g in range(120):
        text = [rnd.choice(common) if rnd.random() < 0.4 else rnd.choice(vocabulary) for _ in range(rnd.randrange(120, 300))]
        for copy in range(3):
            own = list(text)
            for _ in range(copy * len(own) // 120):
                own[rnd.randrange(len(own))] = rnd.choice(vocabulary)
            group[len(rows)] = g
            rows.append((len(rows), " ".join(own)))
    near = [(a, b) for a in range(len(rows)) for b in range(a + 1, len(rows)) if group[a] == group[b] and similarity(rows[a][1], rows[b][1]) >= 0.8]
    kept = {r["doc_id"] for r in simhash.drop_near_copies(docs(rows)).collect()}
    assert {group[i] for i in kept} == set(range(120))  # of each group at least one stays
    caught = sum(not (a in kept and b in kept) for a, b in near)
    assert len(near) > 200 and caught >= 0.9 * len(near), (caught, len(near))


def test_near_copy_groups_against_all_pairs(docs, spark):
    """Rows that stay are the smallest of each component of the links over all pairs."""
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for g in range(40):
        text = [rnd.choice(words) for _ in range(60)]
        for _ in range(4):
            own = list(text)
            for _ in range(rnd.randrange(3)):
                own[rnd.randrange(60)] = rnd.choice(words)
            rows.append((len(rows), " ".join(own)))
    prints = [simhash.word_fingerprints(t.encode().split(), 3) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if any((x ^ y).bit_count() <= 3 for x, y in zip(prints[a], prints[b], strict=True)):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    assert sorted(r["doc_id"] for r in simhash.drop_near_copies(docs(rows)).collect()) == sorted({find(i) for i in range(len(rows))})
