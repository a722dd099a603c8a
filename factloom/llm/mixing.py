"""Mixing sources to target weights through a multivariate-hypergeometric splitting tree.

Only DataFrame functions run here. Every document is cut into blocks of at most `block_words` consecutive
words. A source's blocks fall into kinds by their words: whole ones, and CLASSES kinds of shorter ones, so that
the blocks of a kind differ little. Its quota is whole passes over the source plus an exact number of blocks
of each kind of one more pass; their words add up to the target. A hash deals the blocks out to the
output shards, and a tree with up to FAN children a node hands the quotas down: at a node they are split among
the children by draws from the hypergeometric law (child by child, each from what the ones before left), so
that a shard's numbers are those of a uniform draw without replacement, and add up exactly. The tree ends
where a source has POOL_BLOCKS blocks or so left; each of these pools takes its number of blocks in permuted
order, and a shard is shuffled on its own. Each node's draw is made once, no step orders or gathers a whole
source, and all draws are functions of (seed, source, node) or (seed, block), so that a rerun gives the same mix.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import cut

WORD = r"[^\x20\x09-\x0D]+"
#: A table of sources with at most so many rows is broadcast; a larger one is joined by shuffle.
BROADCAST_SOURCES = 100_000
#: A source's pools have about so many blocks.
POOL_BLOCKS = 2048
#: Bits of a node's number below its parent, and so the most children of a node.
BITS = 4
FAN = 1 << BITS
#: Kinds of blocks that are not whole.
CLASSES = 8


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id, source, size, copy): words of each row; rows that repeat all three are numbered by copy."""
    words = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long")
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), words.alias("size"))
    many = rows.groupBy("id", "source", "size").agg(F.count(F.lit(1)).cast("int").alias("n"))
    return many.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n")))).drop("n")


def _kind(size: Column, block_words: int) -> Column:
    """Kind of the last block of a document: 0 if whole, else 1 for the longest to CLASSES for the shortest."""
    tail = size % block_words
    return F.when(tail == 0, 0).otherwise(CLASSES - F.floor((tail - 1) * CLASSES / block_words)).cast("int")


def source_targets(sized: DataFrame, weights: tuple[float, ...] = (5, 2, 1), total_share: float = 1.5, most: float = 2.0, block_words: int = 128) -> DataFrame:
    """(number, source, source_size, target, kinds) for each source, null included; kinds are the blocks of
    its documents as an array of (kind, blocks, words).

    Sources by code point, null last, get the weights in turn and share total_share of all words; a
    target stops at `most` times its source's size and the rest goes to the others by weight. The common level
    of the others rises, over rounds of one aggregation each, until no source is above its limit. The
    sources are ordered in ranges, so that no task holds all of them.
    """
    kind, tail = _kind(F.col("size"), block_words), F.col("size") % block_words
    whole = F.sum(F.floor(F.col("size") / block_words)).cast("long")
    kinds = [F.struct(F.lit(0).alias("kind"), whole.alias("n"), (whole * block_words).alias("words"))]
    kinds += [F.struct(F.lit(k).alias("kind"), F.count_if(kind == k).alias("n"), F.coalesce(F.sum(F.when(kind == k, tail)), F.lit(0)).alias("words")) for k in range(1, CLASSES + 1)]
    by = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.array(*kinds).alias("kinds"))
    order = [F.col("source").isNull(), F.col("source")]
    by = cut(by.orderBy(*order).withColumn("part", F.spark_partition_id()))
    counts = sorted((r["part"], r["count"]) for r in by.groupBy("part").count().collect())  # a row for each range
    if not counts:
        return by.select(F.lit(0).cast("long").alias("number"), "source", "source_size", F.lit(0.0).alias("target"), "kinds")
    before = {p: sum(n for q, n in counts if q < p) for p, _ in counts}
    start = F.element_at(F.create_map(*(F.lit(x) for p in before for x in (p, before[p]))), F.col("part"))
    by = by.withColumn("number", (start + F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1).cast("long"))
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("number") % len(weights) + 1).cast("int"))
    by = cut(by.withColumn("weight", weight).withColumn("limit", most * F.col("source_size")))
    level, fixed = 0.0, None
    while True:
        at = F.col("limit") <= level * F.col("weight")
        now = by.agg(F.sum(F.when(at, F.col("limit")).otherwise(0.0)), F.sum(F.when(at, 0.0).otherwise(F.col("weight"))), F.sum("source_size")).first()
        if now[:2] == fixed or not now[1]:
            break
        fixed, level = now[:2], (total_share * now[2] - now[0]) / now[1]
    target = F.least(F.col("limit"), level * F.col("weight"))
    return by.select("number", "source", "source_size", target.cast("double").alias("target"), "kinds")


def _uniform(*parts: Column) -> Column:
    """A number in (0, 1) that depends on the parts alone."""
    return (F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") + 0.5) / F.lit(float(1 << 53))


def hypergeometric(n: Column, left: Column, q: Column, u: Column) -> Column:
    """How many of q draws without replacement from n units fall among `left` of them.

    u is uniform in (0, 1). Inversion at any size, from relative probabilities by the recurrence between
    neighbours: of all values that can come out, or of those within nine deviations of the mean, beyond
    which lies less than double precision tells apart. Takes a time in proportion to the deviation.
    """
    n, left, q = (x.cast("double") for x in (n, left, q))
    low, high = F.greatest(F.lit(0.0), q - (n - left)), F.least(q, left)
    mean = F.when(n > 0, q * left / n).otherwise(0.0)
    var = F.when(n > 1, mean * (1 - left / n) * (n - q) / (n - 1)).otherwise(0.0)
    reach = 9 * F.sqrt(F.greatest(var, F.lit(0.0))) + 30
    first, last = F.greatest(low, F.floor(mean - reach).cast("double")), F.least(high, F.ceil(mean + reach).cast("double"))

    def ratio(k: Column) -> Column:
        return (left - k) * (q - k) / ((k + 1) * (n - left - q + k + 1))

    steps = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0.0), last - first).cast("int")), lambda i: first + i)
    start = F.struct(F.lit(1.0).alias("p"), F.lit(0.0).alias("sum"))
    total = F.aggregate(steps, start, lambda a, k: F.struct(F.when(k < last, a["p"] * ratio(k)).otherwise(0.0).alias("p"), (a["sum"] + a["p"]).alias("sum")), lambda a: a["sum"])
    start = F.struct(F.lit(1.0).alias("p"), (u * total).alias("left"), first.alias("k"))
    drawn = F.aggregate(
        steps,
        start,
        lambda a, k: F.struct(
            F.when(k < last, a["p"] * ratio(k)).otherwise(0.0).alias("p"),
            (a["left"] - a["p"]).alias("left"),
            F.when((a["left"] > 0) & (k <= last), k).otherwise(a["k"]).alias("k"),
        ),
        lambda a: a["k"],
    )
    return F.when(low >= high, low).otherwise(drawn).cast("long")


def kind_quotas(targets: DataFrame) -> DataFrame:
    """targets with passes (whole passes over the source) and quotas: how many blocks of each kind a last,
    partial pass takes. Kind by kind the words so far stay next to the same share of the words there are."""
    left = F.round("target") - F.col("passes") * F.col("source_size")
    targets = targets.withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.round("target") / F.greatest(F.lit(1), F.col("source_size")))).otherwise(0).cast("int"))
    share = F.when(F.col("source_size") > 0, left / F.greatest(F.lit(1), F.col("source_size"))).otherwise(0.0)
    start = F.struct(F.lit(0.0).alias("there"), F.lit(0.0).alias("taken"), F.expr("cast(array() as array<bigint>)").alias("q"))

    def add(a: Column, k: Column) -> Column:
        there, mean = a["there"] + k["words"], k["words"] / F.greatest(F.lit(1), k["n"])
        q = F.when(k["n"] > 0, F.round((share * there - a["taken"]) / F.greatest(F.lit(1.0), mean))).otherwise(0.0)
        q = F.greatest(F.lit(0.0), F.least(k["n"].cast("double"), q))
        return F.struct(there.alias("there"), (a["taken"] + q * mean).alias("taken"), F.concat(a["q"], F.array(q.cast("long"))).alias("q"))

    return targets.withColumn("quotas", F.aggregate("kinds", start, add, lambda a: a["q"]))


def split_quotas(pools: DataFrame, quotas: DataFrame, depth: int, seed: int) -> DataFrame:
    """(number, kind, pool, share): each quota split over its pools.

    pools: number, kind, bits, pool, n (blocks); quotas: number, kind, quota. A pool's bits say how deep it
    lies in the tree, at most depth; its node at a level is the first BITS bits a level of its own number.
    Level by level, a node's quota meets the populations of its children, one row to one row.
    """
    levels = -(-depth // BITS)
    if not levels:
        return pools.join(quotas, ["number", "kind"]).select("number", "kind", "pool", F.col("quota").alias("share"))

    def node(level: Column) -> Column:
        return F.expr(f"shiftright(pool, greatest(0, bits - {BITS} * ({level})))")

    paths = pools.withColumn("level", F.explode(F.sequence(F.lit(1), F.lit(levels))))
    paths = paths.select("number", "kind", "level", node("level - 1").alias("parent"), node("level").alias("child"), "n")
    children = paths.groupBy("number", "kind", "level", "parent", "child").agg(F.sum("n").alias("n"))
    children = children.groupBy("number", "kind", "level", "parent").agg(F.array_sort(F.collect_list(F.struct("child", "n"))).alias("children"), F.sum("n").alias("n"))
    children = cut(children)
    now = quotas.select("number", "kind", F.lit(0).alias("node"), "quota")
    for level in range(1, levels + 1):
        own = children.filter(F.col("level") == level).select("number", "kind", F.col("parent").alias("node"), "children", "n")
        start = F.struct(F.col("n").alias("n"), F.col("quota").alias("q"), F.expr("cast(array() as array<struct<child:int,share:bigint>>)").alias("out"))

        def deal(a: Column, c: Column) -> Column:
            u = _uniform(F.lit("split"), F.lit(seed), F.col("number"), F.col("kind"), F.lit(level), c["child"])  # noqa: B023 - called at once
            x = F.when(a["q"] <= 0, F.lit(0).cast("long")).when(c["n"] >= a["n"], a["q"]).otherwise(hypergeometric(a["n"], c["n"], a["q"], u))
            return F.struct((a["n"] - c["n"]).alias("n"), (a["q"] - x).alias("q"), F.concat(a["out"], F.array(F.struct(c["child"].alias("child"), x.alias("share")))).alias("out"))

        met = now.join(own, ["number", "kind", "node"])
        dealt = met.select("number", "kind", F.explode(F.aggregate("children", start, deal, lambda a: a["out"])).alias("c"))
        now = dealt.select("number", "kind", F.col("c.child").alias("node"), F.col("c.share").alias("quota"))
    return now.select("number", "kind", F.col("node").alias("pool"), F.col("quota").alias("share"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (5, 2, 1), total_share: float = 1.5, block_words: int = 128, shard_words: int = 1 << 18, seed: int = 17) -> DataFrame:
    """The blocks of every row of docs and what the mix takes of them: id, source, copy, size, source_size, target, block,
    words, passes (whole passes), extra (1 if drawn in the last, partial pass), shard, and position of the
    block within its shuffled shard, the drawn ones first. A document without words has one block of no words.

    No block is taken more than twice. A source's taken words differ from its target by half a block at
    most, and by what the drawn blocks of its shorter kinds differ from their means (a sixteenth of a block each, either
    way). Null texts have size 0; a null source is a source of its own, weighed last; null ids and repeated
    rows are documents like any other.
    """
    sized = cut(sizes(docs, id_col, text_col, source_col))
    sources = kind_quotas(source_targets(sized, weights, total_share, block_words=block_words))
    n_blocks = F.aggregate("kinds", F.lit(0).cast("long"), lambda a, k: a + k["n"])
    sources = cut(sources.withColumn("n_blocks", n_blocks))
    n_sources, words = sources.agg(F.count(F.lit(1)), F.sum("source_size")).first()
    depth = max(0, math.ceil(math.log2(max(1.0, (words or 0) * total_share / shard_words))))
    bits = F.ceil(F.log2(F.greatest(F.lit(1.0), F.col("n_blocks") / POOL_BLOCKS)))
    sources = sources.withColumn("bits", F.least(F.lit(depth), bits).cast("int"))

    own = sources.select(F.col("source").alias("own_source"), "number", "bits", "passes", "source_size", "target")
    own = F.broadcast(own) if n_sources <= BROADCAST_SOURCES else own
    rows = sized.join(own, F.col("source").eqNullSafe(F.col("own_source"))).drop("own_source")
    ends = F.greatest(F.lit(1), F.ceil(F.col("size") / block_words)).cast("int")
    blocks = rows.withColumn("block", F.explode(F.sequence(F.lit(0), ends - 1)))
    blocks = blocks.withColumn("words", F.least(F.lit(block_words), F.col("size") - block_words * F.col("block").cast("long")))
    blocks = blocks.withColumn("kind", F.when(F.col("words") == 0, CLASSES + 1).otherwise(_kind(F.col("words"), block_words)))
    key = (F.coalesce("source", F.lit("")), F.coalesce(F.col("id").cast("string"), F.lit("")), F.col("copy"), F.col("block"), F.col("size"))
    blocks = blocks.withColumn("shard", F.pmod(F.xxhash64(F.lit("pool"), F.lit(seed), *key), F.lit(1 << depth)).cast("int"))
    blocks = blocks.withColumn("pool", F.expr(f"shiftright(shard, {depth} - bits)"))
    pools = blocks.filter("words > 0").groupBy("number", "kind", "bits", "pool").agg(F.count(F.lit(1)).alias("n"))
    quotas = sources.select("number", F.posexplode("quotas").alias("kind", "quota"))
    shares = split_quotas(pools, quotas, depth, seed)
    order = [F.xxhash64(F.lit("order"), F.lit(seed), *key), F.col("id"), F.col("source"), F.col("copy"), F.col("block"), F.col("size")]
    blocks = blocks.withColumn("turn", F.row_number().over(Window.partitionBy("number", "kind", "pool").orderBy(*order)))
    dealt = blocks.join(shares, ["number", "kind", "pool"], "left")
    dealt = dealt.withColumn("extra", F.coalesce(F.col("turn") <= F.col("share"), F.lit(False)).cast("int"))
    drawn = F.when(F.col("words") > 0, F.col("passes") + F.col("extra")).otherwise(0) > 0
    shuffled = Window.partitionBy("shard").orderBy(~drawn, F.xxhash64(F.lit("shuffle"), F.lit(seed), *key), "id", "source", "copy", "block")
    dealt = dealt.withColumn("position", F.row_number().over(shuffled))
    return dealt.select("id", "source", "copy", "size", "source_size", "target", "block", "words", "passes", "extra", "shard", "position")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options: object) -> DataFrame:
    """One row for each row of docs: id, source, size, source_size, target, taken (words, repeats counted)."""
    taken = F.sum(F.col("words") * (F.col("passes") + F.col("extra"))).cast("long").alias("taken")
    out = mix(docs, id_col, text_col, source_col, **options).groupBy("id", "source", "copy", "size", "source_size", "target").agg(taken)
    return out.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", "taken")
