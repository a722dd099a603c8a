"""SimHash near-duplicates through a segment-popcount embedding.

A fingerprint's 64 bits are 32 segments of two bits; their bit counts (0 to 2) are a point of a
32-dimensional grid. Each differing bit moves one count by at most one, so the Manhattan distance of two
points is a lower bound of the Hamming distance. The segments are dealt into groups: if at most d bits
differ, all groups but d have equal counts. The range join therefore puts a point into a cell for each
choice of groups to leave out, the cell being the counts of the others; points that meet in a cell are tested
for the bound on all 32 counts and then for the bits themselves. The more groups, the longer is a
cell's key and the fewer points meet by chance; their number follows the number of points, so that a point
meets about as many others as it has cells.

near_components() works on one fingerprint of word shingles, as given. drop_near_copies() is for near copies, texts
whose sets of five-word shingles have a similarity of 0.8 or more. An edited word changes up to five shingles but
one word, so it takes fingerprints of the texts' distinct words: several, of independent hashes, since a pair that one
misses is often linked by another.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import column, cut, kind_of, one_of_each, texts, whole
from factloom.llm.components import connected_components

#: Every second bit, as a signed 64-bit number.
LOW = 0x5555555555555555
#: Shingles hashed and counted at once, so that a very long text needs no more memory than that.
CHUNK = 1 << 15


def fingerprint(words: list[bytes], shingle: int = 3, seed: int = 42) -> int:
    """The 64-bit fingerprint of a word list: bit i is set if it is set in over half the shingles'
    hashes. Fewer words than a shingle: the whole list is one; no words: zero."""
    import xxhash

    if not words:
        return 0
    digest = partial(xxhash.xxh64_intdigest, seed=seed)
    n = max(1, len(words) - shingle + 1)
    if n == 1:
        return digest(b" ".join(words))
    ones = np.zeros(64, np.int64)
    for at in range(0, n, CHUNK):
        part = words[at : min(at + CHUNK, n) + shingle - 1]
        grams = map(b" ".join, zip(*(part[i:] for i in range(shingle)), strict=False))
        hashes = np.fromiter(map(digest, grams), np.uint64, len(part) - shingle + 1)
        bits = np.unpackbits(hashes.astype(">u8").view(np.uint8)).reshape(-1, 64)
        ones += bits.sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def word_fingerprints(words: list[bytes], n: int) -> list[int]:
    """n fingerprints of the set of words, each of other hashes; no words: zeros."""
    import xxhash

    hashes = np.fromiter(map(xxhash.xxh64_intdigest, set(words)), np.uint64)
    out = []
    for i in range(n):
        ones = np.zeros(64, np.int64)
        for at in range(0, len(hashes), CHUNK):
            x = hashes[at : at + CHUNK] + np.uint64((i * 0x9E3779B97F4A7C15) & (1 << 64) - 1)
            x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
            x ^= x >> np.uint64(31)
            ones += np.unpackbits(x.astype(">u8").view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
        out.append(int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big"))
    return out


def _word_fingerprints(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [word_fingerprints(t.encode().lower().split(), n) for t in texts(batch)]
        columns = np.array(found, np.uint64).reshape(-1, n).view(np.int64)
        names = [f"f{i}" for i in range(n)]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "mark", "size")), *(pa.array(columns[:, i]) for i in range(n))], ["id", "mark", "size", *names])


def _fingerprints(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = np.fromiter((fingerprint(t.encode().lower().split(), shingle) for t in texts(batch)), np.uint64, batch.num_rows)
        more = batch.schema.names[2:]
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out.view(np.int64)), *map(batch.column, more)], ["id", "fp", *more])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fp) for each row of docs; fp is the fingerprint as a signed 64-bit number."""
    rows = docs.select(column(id_col).alias("id"), column(text_col).alias("text"))
    return rows.mapInArrow(partial(_fingerprints, shingle=shingle), f"id {kind_of(rows, 'id')}, fp long")


def counts(fp: Column) -> Column:
    """The 32 segment counts, each in the two bits of its segment."""
    high = F.shiftrightunsigned(fp, 1)
    both = fp.bitwiseAND(high).bitwiseAND(F.lit(LOW))
    return fp.bitwiseXOR(high).bitwiseAND(F.lit(LOW)).bitwiseOR(F.shiftleft(both, 1))


def manhattan(a: Column, b: Column) -> Column:
    """Distance of two packed count vectors. Of two counts, the bits that differ are 01 or 11 for a
    distance of one, and 10 for two."""
    x = a.bitwiseXOR(b)
    odd = x.bitwiseAND(F.lit(LOW))
    two = F.shiftrightunsigned(x, 1).bitwiseAND(F.lit(LOW)).bitwiseAND(F.bitwise_not(odd))
    return F.bit_count(odd) + 2 * F.bit_count(two)


def group_masks(groups: int, distance: int) -> list[int]:
    """For each choice of `distance` groups to leave out, a mask of the counts of the others (signed)."""
    ends = [32 * i // groups for i in range(groups + 1)]
    own = [sum(3 << 2 * s for s in range(a, b)) for a, b in zip(ends, ends[1:], strict=False)]
    masks = [sum(own) - sum(left) for left in combinations(own, distance)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def groups_for(points: int, distance: int) -> int:
    """The least number of groups with which a point meets no more others by chance than it has cells. Two
    random counts are equal with probability 3/8."""
    groups = 2 * distance
    while groups < 32 and points * 0.375 ** (32 * (groups - distance) / groups) > 1:
        groups += 1
    return max(groups, 1)


def near_links(points: DataFrame, distance: int = 3, groups: int | None = None) -> DataFrame:
    """(a, b): the nodes of every two fingerprints that differ in 1 to `distance` bits.
    points: fp, node, and, if there is one, class: fingerprints of one class need no link between them; one row for
    each fingerprint. groups changes the work, not the links."""
    if not 0 <= distance <= 8:
        raise ValueError("the search is for distances up to 8")
    groups = groups or groups_for(points.count(), distance)
    masks = F.array(*(F.struct(F.lit(i).alias("choice"), F.col("at").bitwiseAND(F.lit(m)).alias("cell")) for i, m in enumerate(group_masks(groups, distance))))
    cells = points.withColumn("at", counts(F.col("fp"))).withColumn("c", F.explode(masks)).select("fp", "node", "at", "c.choice", "c.cell", *(["class"] if "class" in points.columns else []))
    near = (manhattan(F.col("l.at"), F.col("r.at")) <= distance) & (F.bit_count(F.col("l.fp").bitwiseXOR(F.col("r.fp"))) <= distance)
    met = cells.alias("l").join(cells.alias("r"), (F.col("l.choice") == F.col("r.choice")) & (F.col("l.cell") == F.col("r.cell")) & (F.col("l.fp") < F.col("r.fp")) & near & (F.col("l.class") != F.col("r.class") if "class" in points.columns else F.lit(True)))
    return met.select(F.greatest("l.node", "r.node").alias("a"), F.least("l.node", "r.node").alias("b"))


def _components(rows: DataFrame, distance: int) -> DataFrame:
    """(fp, id, component): for each fingerprint of rows, its smallest id and the smallest fingerprint that
    can be reached. Copies are never expanded into pairs: each distinct fingerprint is one node."""
    points = cut(rows.groupBy("fp").agg(F.min("id").alias("id")))
    found = connected_components(near_links(points.select("fp", F.col("fp").alias("node")), distance)).withColumnRenamed("node", "fp")
    return points.join(found, "fp", "left").select("fp", "id", F.coalesce("component", "fp").alias("component"))


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, distance: int = 3) -> DataFrame:
    """(id, fingerprint as 16 hex digits, component_id) for each row of docs.

    ASCII letters are lower-cased; words are separated by common.SPACES. component_id is the smallest id
    that can be reached over links between fingerprints of up to `distance` differing bits. A null text
    counts as empty and gets fingerprint zero. Ids may be of any type that has an order. Rows of equal text, repeated rows included, share a
    fingerprint and so a component. A null id never names a component that has another id. Two components
    have the same component_id only if both hold rows of that id, or if both have null ids alone.
    """
    rows = cut(fingerprints(docs, id_col, text_col, shingle))
    members = cut(_components(rows, distance))
    least = members.groupBy("component").agg(F.min("id").alias("component_id"))
    named = members.join(least, "component").select("fp", "component_id")
    return rows.join(named, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _word_components(points: DataFrame, n: int, distance: int) -> DataFrame:
    """(node, component): nodes are linked that have a fingerprint in common, or two of one kind that differ in up to
    `distance` bits. points: node, f0, f1, ...

    Of many copies nearly all pairs are near each other. So links of one bit come first, with those of common
    fingerprints (all to the smallest node that has one); wider ones are only sought between what is not
    yet linked, and stand for their whole components.
    """
    kinds, links = [], []
    for i in range(n):
        first = cut(points.groupBy(F.col(f"f{i}").alias("fp")).agg(F.min("node").alias("node")))
        kinds.append(first)
        links.append(points.select(F.col(f"f{i}").alias("fp"), F.col("node").alias("a")).join(first.withColumnRenamed("node", "b"), "fp").filter("a <> b").select("a", "b"))
        near = near_links(first.select("fp", F.col("fp").alias("node")), min(1, distance))
        for end in ("a", "b"):  # the nodes are long: only those of links are looked up
            near = near.join(first.select(F.col("fp").alias(end), F.col("node").alias(f"node_{end}")), end)
        links.append(near.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")))
    found = cut(connected_components(reduce(DataFrame.unionByName, links)))
    close = cut(points.select("node").join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component")))
    if distance <= 1:
        return close
    own = close.select("node", F.xxhash64("component").alias("class"))
    wide = [near_links(first.join(own, "node").select("fp", F.col("class").alias("node"), "class"), distance) for first in kinds]
    joined = connected_components(reduce(DataFrame.unionByName, wide).distinct()).withColumnsRenamed({"node": "class", "component": "joined"})
    return own.join(joined, "class", "left").select("node", F.coalesce("joined", "class").alias("component"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fingerprints: int = 3, distance: int = 3) -> DataFrame:
    """One row of each group of near copies, with all its columns: that of the smallest id, null last; of rows that
    share it, the longest text.

    Texts are linked if one of their fingerprints of distinct words (ASCII letters lower-cased, separated by
    common.SPACES) differs in up to `distance` bits; a group is what links reach. Null and empty texts are one group. The
    kept (id, text hash) pairs meet the documents in one join on both, so that neither null ids nor rows of
    one id with different texts stand for one another.
    """
    text = F.coalesce(column(text_col), F.lit(""))
    mark = F.unhex(F.sha2(text.cast("binary"), 256))
    names = [f"f{i}" for i in range(fingerprints)]
    rows = docs.select(column(id_col).alias("id"), column(text_col).alias("text"), mark.alias("mark"), F.length(text).alias("size"))
    rows = cut(rows.mapInArrow(partial(_word_fingerprints, n=fingerprints), f"id {kind_of(rows, 'id')}, mark binary, size int, " + ", ".join(f"{c} long" for c in names)))
    best = F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id"), (-F.col("size")).alias("minus"), "mark")).alias("best")
    points = cut(rows.groupBy(*names).agg(best).withColumn("node", F.unhex(F.concat(*(F.lpad(F.hex(c), 16, "0") for c in names)))))
    found = _word_components(points.select("node", *names), fingerprints, distance)
    members = points.select("node", "best").join(found, "node")
    kept = members.groupBy("component").agg(F.min("best").alias("best")).select("best.id", "best.mark")
    marked = docs.select(whole(docs, "row"), column(id_col).alias("id"), mark.alias("mark"))
    same = F.col("d.id").eqNullSafe(F.col("k.id")) & (F.col("d.mark") == F.col("k.mark"))
    return one_of_each(marked.alias("d").join(kept.alias("k"), same, "left_semi"), ["id", "mark"], docs.columns)
