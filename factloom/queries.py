"""The registered queries: each runs an operator of the engine over a whole table; SQL says what it must give."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import meta
from factloom.functions.patterns import ANY, Bind
from factloom.functions.text import first, frequencies, last, tokenize
from factloom.operators.components import Custom, accumulator, all_of, any_of, condition, go_on, halt, map_each, python_step, reduce, rule, step
from factloom.operators.state import Aggregate, Fsm, ProcessManager, Saga, StateMachine
from factloom.plans.compiler import Compiled
from factloom.plans.policy import Policy, PolicyRule
from factloom.plans.runtime import dehydrated, frontier, invoke, plan, react, react_until_satisfied, rehydrated, resolve, root_facts
from factloom.plans.workflow import Workflow, from_log, workflow
from factloom.runner import Runner
from factloom.sources.inputs import numbered, read_facts
from factloom.sources.store import ParquetStore
from factloom.streaming.stream import drain, sessions, shared_folder, stream_fold, stream_graph, stream_roots, stream_rowwise

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def register(fn: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return register


def read(spark: SparkSession, d: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{table}.parquet")


def lines(spark: SparkSession, d: str) -> DataFrame:
    """Line items as root facts; their columns are no key, so the id is the row's place in its file."""
    return read_facts(spark, f"{d}/lineitem.parquet")


def orders(spark: SparkSession, d: str) -> DataFrame:
    return root_facts(read(spark, d, "orders"), "o_orderkey")


def events(spark: SparkSession, d: str) -> DataFrame:
    return root_facts(read(spark, d, "events"), "event_id", "user_id")


def docs(spark: SparkSession, d: str) -> DataFrame:
    return root_facts(read(spark, d, "documents"), "doc_id")


def run(wf: Workflow, roots: DataFrame, **options: object) -> Compiled:
    return react_until_satisfied(wf, roots, **options)


def money(c: object) -> object:
    """Cents, so that sums do not depend on the order of addition."""
    return F.round(c * 100).cast("long")


REVENUE = "l_extendedprice * (1 - l_discount)"


# ---- steps, rules, conditions -------------------------------------------------------------------


@query(f"SELECT 'high_value' AS tag, {REVENUE} AS revenue FROM lineitem WHERE {REVENUE} > 50000")
def flagship_revenue_rule(spark: SparkSession, d: str) -> DataFrame:
    wf = workflow("flagship").add(step(lambda v: v["l_extendedprice"] * (1 - v["l_discount"]), "revenue"))
    wf = wf.add(rule(lambda r: F.struct(F.lit("high_value").alias("tag"), r.alias("revenue")), lambda r, *, limit=meta.context("limit"): r > limit, "high"), to="revenue")
    return run(wf, lines(spark, d), context={"limit": 50000}).value_of("high").select("value.*")


@query(f"SELECT l_orderkey, {REVENUE} AS revenue FROM lineitem")
def step_projection(spark: SparkSession, d: str) -> DataFrame:
    wf = workflow().add(step(lambda v: F.struct(v["l_orderkey"], (v["l_extendedprice"] * (1 - v["l_discount"])).alias("revenue")), "s"))
    return run(wf, lines(spark, d)).value_of("s").select("value.*")


@query("SELECT o_orderkey, (o_custkey + 1) * 2 - 3 AS value FROM orders")
def pipeline_chain(spark: SparkSession, d: str) -> DataFrame:
    wf = workflow(steps=[(step(lambda v: v["o_custkey"] + 1, "a"), [(step(lambda x: x * 2, "b"), [step(lambda x: x - 3, "c")])])])
    return run(wf, orders(spark, d)).value_of("c").select(F.col("root_id").alias("o_orderkey"), "value")


@query("SELECT o_orderkey, 'p' || i AS component, o_custkey + i AS value FROM orders, range(1, 6) t(i)")
def branching_fanout(spark: SparkSession, d: str) -> DataFrame:
    wf = workflow().add(step(lambda v: v["o_custkey"], "key"))
    for i in range(1, 6):
        wf = wf.add(step(lambda x, i=i: x + i, f"p{i}"), to="key")
    log = run(wf, orders(spark, d)).productions([f"p{i}" for i in range(1, 6)], typed=True)
    return log.select(F.col("root_id").alias("o_orderkey"), "component", "value")


@query("SELECT o_orderkey, o_custkey * 7 AS value FROM orders")
def multi_step_constant(spark: SparkSession, d: str) -> DataFrame:
    wf = workflow().add(step(7, "seven")).add(step(lambda v: v["o_custkey"], "key")).add(step(lambda a, b: a * b, "product"), to=["seven", "key"])
    return run(wf, orders(spark, d)).value_of("product").select(F.col("root_id").alias("o_orderkey"), "value")


@query("SELECT o_orderkey, CASE WHEN o_totalprice > 250000 THEN 'large' WHEN o_totalprice > 100000 THEN 'medium' ELSE 'small' END AS size_class FROM orders")
def rule_filter(spark: SparkSession, d: str) -> DataFrame:
    price = lambda v: v["o_totalprice"]
    wf = workflow(rules=[rule(lambda v: F.lit("large"), lambda v: price(v) > 250000, "large"), rule(lambda v: F.lit("medium"), lambda v: (price(v) > 100000) & (price(v) <= 250000), "medium"), rule(lambda v: F.lit("small"), lambda v: price(v) <= 100000, "small")])
    log = run(wf, orders(spark, d)).productions(typed=True)
    return log.select(F.col("root_id").alias("o_orderkey"), F.col("value").alias("size_class"))


@query("SELECT o_orderkey, o_custkey AS id, o_totalprice AS total FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'O' AND o_totalprice > 100000")
def rule_given_where_then(spark: SparkSession, d: str) -> DataFrame:
    given = {"o_orderpriority": "1-URGENT", "o_orderstatus": "O", "o_custkey": Bind("id"), "o_totalprice": Bind("total")}
    made = rule(lambda id, total: F.struct(id.alias("id"), total.alias("total")), name="premium", given=given, where=lambda id, total: total > 100000)
    return run(workflow().add(made), orders(spark, d)).value_of("premium").select(F.col("root_id").alias("o_orderkey"), "value.*")


@query("SELECT o_orderkey, o_orderstatus AS status FROM orders")
def rule_match_any(spark: SparkSession, d: str) -> DataFrame:
    made = rule(lambda v: v["o_orderstatus"], name="any", given=ANY)
    return run(workflow().add(made), orders(spark, d)).value_of("any").select(F.col("root_id").alias("o_orderkey"), F.col("value").alias("status"))


@query("SELECT o_orderkey, o_totalprice AS value FROM orders WHERE o_totalprice > 100000 AND o_orderstatus = 'F' AND o_custkey % 2 = 0")
def conjunction(spark: SparkSession, d: str) -> DataFrame:
    made = rule(lambda v: v["o_totalprice"], all_of(lambda v: v["o_totalprice"] > 100000, lambda v: v["o_orderstatus"] == "F", lambda v: v["o_custkey"] % 2 == 0), "all")
    return run(workflow().add(made), orders(spark, d)).value_of("all").select(F.col("root_id").alias("o_orderkey"), "value")


@query("SELECT o_orderkey, o_totalprice AS value FROM orders WHERE o_totalprice > 300000 OR o_orderstatus = 'P'")
def disjunction_once(spark: SparkSession, d: str) -> DataFrame:
    made = rule(lambda v: v["o_totalprice"], any_of(lambda v: v["o_totalprice"] > 300000, lambda v: v["o_orderstatus"] == "P"), "either")
    return run(workflow().add(made), orders(spark, d)).value_of("either").select(F.col("root_id").alias("o_orderkey"), "value")


@query(
    "SELECT o_orderkey, 'big_open' AS rule FROM orders WHERE o_totalprice > 200000 AND o_orderstatus = 'O' "
    "UNION ALL SELECT o_orderkey, 'big_or_urgent' FROM orders WHERE o_totalprice > 200000 OR o_orderpriority = '1-URGENT'"
)
def shared_condition(spark: SparkSession, d: str) -> DataFrame:
    wf = workflow().add(condition(lambda v: v["o_totalprice"] > 200000, "big"))
    wf = wf.add(rule(lambda v: F.lit(1), all_of("big", lambda v: v["o_orderstatus"] == "O"), "big_open"))
    wf = wf.add(rule(lambda v: F.lit(1), any_of("big", lambda v: v["o_orderpriority"] == "1-URGENT"), "big_or_urgent"))
    return run(wf, orders(spark, d)).productions().select(F.col("root_id").alias("o_orderkey"), F.col("component").alias("rule"))


@query("SELECT o_orderkey, 'big' AS condition FROM orders WHERE o_totalprice > 200000 UNION ALL SELECT o_orderkey, 'open' FROM orders WHERE o_orderstatus = 'O'")
def plan_match_phase(spark: SparkSession, d: str) -> DataFrame:
    wf = workflow().add(condition(lambda v: v["o_totalprice"] > 200000, "big")).add(condition(lambda v: v["o_orderstatus"] == "O", "open"))
    return plan(wf, orders(spark, d)).select(F.col("root_id").alias("o_orderkey"), "condition")


@query("SELECT o_orderkey, o_custkey + 1 AS value FROM orders")
def react_one_round(spark: SparkSession, d: str) -> DataFrame:
    wf = workflow(steps=[(step(lambda v: v["o_custkey"] + 1, "a"), [step(lambda x: x + 2, "b")])])
    log = react(wf, orders(spark, d)).productions(typed=True)
    return log.select(F.col("root_id").alias("o_orderkey"), "value")


@query("SELECT event_id, value / CAST(json_extract_string(props, '$.k') AS BIGINT) > 100 AS big FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) <> 0 AND value / CAST(json_extract_string(props, '$.k') AS BIGINT) > 100")
def predicate_null_is_false(spark: SparkSession, d: str) -> DataFrame:
    ratio = lambda v: F.try_divide(v["value"], F.get_json_object(v["props"], "$.k").cast("long"))
    made = rule(lambda v: F.lit(True), lambda v: ratio(v) > 100, "big")
    return run(workflow().add(made), events(spark, d)).value_of("big").select(F.col("root_id").alias("event_id"), F.col("value").alias("big"))


# ---- joins --------------------------------------------------------------------------------------


@query("SELECT o_orderkey, (o_custkey * 2) * (o_custkey * 3) AS product, o_custkey * 5 AS total, o_custkey AS diff FROM orders")
def multi_arity_join(spark: SparkSession, d: str) -> DataFrame:
    wf = workflow().add(step(lambda v: v["o_custkey"] * 2, "twice")).add(step(lambda v: v["o_custkey"] * 3, "thrice"))
    for name, fn in (("product", lambda a, b: a * b), ("total", lambda a, b: a + b), ("diff", lambda a, b: b - a)):
        wf = wf.add(step(fn, name), to=["twice", "thrice"])
    return run(wf, orders(spark, d)).results(["product", "total", "diff"]).select(F.col("root_id").alias("o_orderkey"), "product", "total", "diff")


@query("SELECT o_orderkey, (o_custkey + 1) + (o_custkey * 2) + ((o_custkey + 1) - (o_custkey * 2)) AS value FROM orders")
def deep_join(spark: SparkSession, d: str) -> DataFrame:
    wf = workflow().add(step(lambda v: v["o_custkey"] + 1, "a")).add(step(lambda v: v["o_custkey"] * 2, "b"))
    wf = wf.add(step(lambda a, b: a + b, "sum"), to=["a", "b"]).add(step(lambda a, b: a - b, "diff"), to=["a", "b"]).add(step(lambda a, b: a + b, "all"), to=["sum", "diff"])
    return run(wf, orders(spark, d)).value_of("all").select(F.col("root_id").alias("o_orderkey"), "value")


@query("SELECT o_orderkey, o_custkey || '|' || o_orderstatus || '|' || o_orderpriority AS joined FROM orders")
def join_ordered_values(spark: SparkSession, d: str) -> DataFrame:
    wf = workflow()
    for f in ("o_custkey", "o_orderstatus", "o_orderpriority"):
        wf = wf.add(step(lambda v, f=f: v[f].cast("string"), f))
    wf = wf.add(step(lambda j: F.concat_ws("|", *(j[f"_{i}"] for i in (1, 2, 3))), "joined"), to=["o_custkey", "o_orderstatus", "o_orderpriority"])
    return run(wf, orders(spark, d)).value_of("joined").select(F.col("root_id").alias("o_orderkey"), F.col("value").alias("joined"))


@query("SELECT o_orderkey, o_custkey + 1 AS value FROM orders WHERE o_totalprice > 150000")
def join_needs_both(spark: SparkSession, d: str) -> DataFrame:
    wf = workflow().add(rule(lambda v: v["o_custkey"], lambda v: v["o_totalprice"] > 150000, "some")).add(step(1, "one"))
    wf = wf.add(step(lambda a, b: a + b, "sum"), to=["some", "one"])
    return run(wf, orders(spark, d)).value_of("sum").select(F.col("root_id").alias("o_orderkey"), "value")


# ---- map and reduce -----------------------------------------------------------------------------

WORDS = "list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}_]+'), lambda w: w <> '')"


@query(f"SELECT doc_id, len(w)::BIGINT AS n_words, len(list_distinct(w))::BIGINT AS n_unique, w[1] AS first_word, w[-1] AS last_word FROM (SELECT doc_id, {WORDS} AS w FROM documents)")
def text_processing(spark: SparkSession, d: str) -> DataFrame:
    wf = workflow(steps=[(step(lambda v: tokenize(v["text"]), "words"), [step(lambda w: F.size(w).cast("long"), "n_words"), step(lambda w: F.size(F.array_distinct(w)).cast("long"), "n_unique"), step(first, "first_word"), step(last, "last_word")])])
    names = ["n_words", "n_unique", "first_word", "last_word"]
    return run(wf, docs(spark, d)).results(names).select(F.col("root_id").alias("doc_id"), *names)


@query(f"SELECT word, count(*)::BIGINT AS n FROM (SELECT unnest({WORDS}) AS word FROM documents) GROUP BY word")
def word_count_map(spark: SparkSession, d: str) -> DataFrame:
    wf = workflow().add(step(lambda v: tokenize(v["text"]), "words")).add(map_each(lambda w: w, "each"), to="words")
    return run(wf, docs(spark, d)).value_of("each").groupBy(F.col("value").alias("word")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, max_n::BIGINT AS max_n FROM (SELECT doc_id, max(n) AS max_n FROM (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(string_split(lang || ' ' || source || ' ' || lang, ' ')) AS w FROM documents) GROUP BY ALL) GROUP BY doc_id)")
def frequency_map(spark: SparkSession, d: str) -> DataFrame:
    text = lambda v: F.concat_ws(" ", v["lang"], v["source"], v["lang"])
    wf = workflow().add(step(lambda v: frequencies(F.split(text(v), " ")), "freq")).add(step(lambda m: F.array_max(F.map_values(m)).cast("long"), "top"), to="freq")
    roots = root_facts(read(spark, d, "documents"), "doc_id")
    return run(wf, roots).value_of("top").select(F.col("root_id").alias("doc_id"), F.col("value").alias("max_n"))


@query("SELECT vec_id, (pos - 1)::BIGINT AS pos, x * 2 AS doubled FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings)")
def map_double(spark: SparkSession, d: str) -> DataFrame:
    wf = workflow().add(step(lambda v: v["embedding"], "values")).add(map_each(lambda x: x.cast("double") * 2, "double"), to="values")
    df = run(wf, root_facts(read(spark, d, "embeddings"), "vec_id")).value_of("double")
    pos = next(c for c in df.columns if c.startswith("p:"))
    return df.select(F.col("root_id").alias("vec_id"), F.col(f"`{pos}`").cast("long").alias("pos"), F.col("value").alias("doubled"))


@query(
    "SELECT doc_id, sum(len(w))::BIGINT AS letters, count(*) FILTER (len(w) > 5)::BIGINT AS long_words FROM (SELECT doc_id, unnest(" + WORDS + ") AS w FROM documents) GROUP BY doc_id"
)
def map_list_steps(spark: SparkSession, d: str) -> DataFrame:
    each = [step(lambda w: F.length(w).cast("long"), "length"), step(lambda w: (F.length(w) > 5).cast("long"), "is_long")]
    wf = workflow().add(step(lambda v: tokenize(v["text"]), "words")).add(map_each(each, "each"), to="words")
    wf = wf.add(reduce(0, name="letters", native=F.sum), to="length").add(reduce(0, name="long_words", native=F.sum), to="is_long")
    done = run(wf, docs(spark, d)).results(["letters", "long_words"])
    return done.filter("letters is not null").select(F.col("root_id").alias("doc_id"), "letters", "long_words")


@query("SELECT doc_id, sum(len(w))::BIGINT AS value FROM (SELECT doc_id, unnest(string_split(line, ' ')) AS w FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)) GROUP BY doc_id")
def map_nested(spark: SparkSession, d: str) -> DataFrame:
    inner = map_each(lambda w: F.length(w).cast("long"), "word")
    wf = workflow().add(step(lambda v: F.split(v["text"], "\n"), "lines")).add(map_each((lambda line: F.split(line, " "), [inner]), "line"), to="lines")
    wf = wf.add(reduce(0, name="per_line", native=F.sum), to="line").add(reduce(0, name="total", native=F.sum), to="per_line")
    roots = root_facts(read(spark, d, "documents"), "doc_id")
    return run(wf, roots).value_of("total").select(F.col("root_id").alias("doc_id"), "value")


@query("SELECT doc_id, sum(len(w) * 3)::BIGINT AS value FROM (SELECT doc_id, unnest(" + WORDS + ") AS w FROM documents) GROUP BY doc_id")
def map_with_join(spark: SparkSession, d: str) -> DataFrame:
    n = lambda w: F.length(w).cast("long")
    each = ([step(n, "once"), step(lambda w: n(w) * 2, "twice")], [step(lambda a, b: a + b, "sum3")])
    wf = workflow().add(step(lambda v: tokenize(v["text"]), "words")).add(map_each(each, "each"), to="words").add(reduce(0, name="total", native=F.sum), to="each")
    return run(wf, docs(spark, d)).value_of("total").select(F.col("root_id").alias("doc_id"), "value")


def order_lines(spark: SparkSession, d: str) -> DataFrame:
    """Orders with the cents of their lines in a total order."""
    df = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", money(F.col("l_extendedprice")).alias("cents")))).alias("lines"))
    return root_facts(df, "l_orderkey", value=F.transform("lines", lambda x: x["cents"]))


ORDER_LINES = "SELECT l_orderkey, list(CAST(round(l_extendedprice * 100) AS BIGINT) ORDER BY l_linenumber, l_partkey, l_suppkey, CAST(round(l_extendedprice * 100) AS BIGINT)) AS c FROM lineitem GROUP BY l_orderkey"


@query(f"SELECT l_orderkey, list_sum(c)::BIGINT * 2 AS total FROM ({ORDER_LINES})")
def reduce_sum_over_map(spark: SparkSession, d: str) -> DataFrame:
    wf = workflow().add(map_each(lambda x: x * 2, "double")).add(reduce(0, name="sum", native=F.sum), to="double")
    return run(wf, order_lines(spark, d)).value_of("sum").select(F.col("root_id").alias("l_orderkey"), F.col("value").alias("total"))


@query(f"SELECT l_orderkey, array_to_string(c, ',') AS listed FROM ({ORDER_LINES})")
def reduce_ordered_list(spark: SparkSession, d: str) -> DataFrame:
    wf = workflow().add(map_each(lambda x: x, "same")).add(reduce(F.expr("cast(array() as array<bigint>)"), lambda acc, x: F.concat(acc, F.array(x)), "list"), to="same")
    return run(wf, order_lines(spark, d)).value_of("list").select(F.col("root_id").alias("l_orderkey"), F.array_join("value", ",").alias("listed"))


@query(
    f"SELECT l_orderkey, coalesce(sum(x) FILTER (before < 10000000), 0)::BIGINT AS value FROM (SELECT l_orderkey, x, coalesce(sum(x) OVER (PARTITION BY l_orderkey ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (SELECT l_orderkey, unnest(c) AS x, generate_subscripts(c, 1) AS i FROM ({ORDER_LINES}))) GROUP BY l_orderkey"
)
def reduce_halt(spark: SparkSession, d: str) -> DataFrame:
    """Add lines until the sum reaches a limit; the line that reaches it still counts."""
    wf = workflow().add(reduce(F.lit(0).cast("long"), lambda acc, x: F.when(acc + x >= 10000000, halt(acc + x)).otherwise(go_on(acc + x)), "until", stops=True))
    return run(wf, order_lines(spark, d)).value_of("until").select(F.col("root_id").alias("l_orderkey"), "value")


@query("SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)), 3) AS norm2 FROM embeddings")
def reduce_simple(spark: SparkSession, d: str) -> DataFrame:
    wf = workflow().add(reduce(0.0, lambda acc, x: acc + x.cast("double") * x.cast("double"), "norm2"))
    roots = root_facts(read(spark, d, "embeddings"), "vec_id", value=F.col("embedding"))
    return run(wf, roots).value_of("norm2").select(F.col("root_id").alias("vec_id"), F.round("value", 3).alias("norm2"))


@query(f"SELECT l_orderkey, len(c)::BIGINT AS n, list_sum(c)::BIGINT AS total FROM ({ORDER_LINES})")
def reduce_join_step(spark: SparkSession, d: str) -> DataFrame:
    wf = workflow().add(step(lambda v: F.size(v).cast("long"), "n")).add(map_each(lambda x: x, "each")).add(reduce(0, name="sum", native=F.sum), to="each")
    wf = wf.add(step(lambda n, s: F.struct(n.alias("n"), s.alias("total")), "both"), to=["n", "sum"])
    return run(wf, order_lines(spark, d)).value_of("both").select(F.col("root_id").alias("l_orderkey"), "value.*")


# ---- state --------------------------------------------------------------------------------------

CENTS = "CAST(round(value * 100) AS BIGINT)"
PRIOR = "PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
UPTO = "PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"


def cents_flow(spark: SparkSession, d: str) -> tuple[Workflow, DataFrame]:
    return workflow().add(step(lambda v: money(v["value"]), "cents")), events(spark, d)


@query(f"SELECT event_id, sum({CENTS}) OVER ({UPTO})::BIGINT AS total FROM events")
def accumulator_running_sum(spark: SparkSession, d: str) -> DataFrame:
    wf, roots = cents_flow(spark, d)
    return run(wf.add(accumulator(0, name="sum", native="sum"), to="cents"), roots).value_of("sum").select(F.col("root_id").alias("event_id"), F.col("value").alias("total"))


@query(f"SELECT event_id, greatest(0, max({CENTS}) OVER ({UPTO})) AS highest FROM events")
def accumulator_max(spark: SparkSession, d: str) -> DataFrame:
    wf, roots = cents_flow(spark, d)
    return run(wf.add(accumulator(0, name="max", native="max"), to="cents"), roots).value_of("max").select(F.col("root_id").alias("event_id"), F.col("value").alias("highest"))


@query(
    f"WITH RECURSIVE e AS (SELECT event_id, user_id, {CENTS} AS c, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events), f AS (SELECT event_id, user_id, n, c % 1009 AS state FROM e WHERE n = 1 UNION ALL SELECT e.event_id, e.user_id, e.n, (f.state * 31 + e.c) % 1009 FROM f JOIN e ON e.user_id = f.user_id AND e.n = f.n + 1) SELECT event_id, state::BIGINT AS state FROM f"
)
def accumulator_general_fold(spark: SparkSession, d: str) -> DataFrame:
    wf, roots = cents_flow(spark, d)
    return run(wf.add(accumulator(0, lambda x, s: (s * 31 + x) % 1009, "hash"), to="cents"), roots).value_of("hash").select(F.col("root_id").alias("event_id"), F.col("value").alias("state"))


@query("SELECT user_id, count(*)::BIGINT AS n_states, count(*) FILTER (rn = 1)::BIGINT AS n_init FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events) GROUP BY user_id")
def accumulator_init_fact(spark: SparkSession, d: str) -> DataFrame:
    wf, roots = cents_flow(spark, d)
    log = run(wf.add(accumulator(0, name="sum", native="sum"), to="cents"), roots).productions(["sum"])
    return log.groupBy(F.col("k").alias("user_id")).agg(F.count_if(F.col("label") == "state_produced").alias("n_states"), F.count_if(F.col("label") == "state_initiated").alias("n_init"))


@query(f"SELECT event_id, {CENTS} AS cents, coalesce(before, 0)::BIGINT AS before FROM (SELECT event_id, value, sum({CENTS}) OVER ({PRIOR}) AS before FROM events) WHERE coalesce(before, 0) < 500000")
def state_of_pre(spark: SparkSession, d: str) -> DataFrame:
    """A condition beside the accumulator sees the state before the fact."""
    wf, roots = cents_flow(spark, d)
    wf = wf.add(accumulator(0, name="sum", native="sum"), to="cents")
    wf = wf.add(condition(lambda c, *, s=meta.state_of("sum"): s < 500000, "open"), to="cents")
    wf = wf.add(step(lambda v, *, s=meta.state_of("sum"): F.struct(v.alias("cents"), (s - v).alias("before")), "seen"), to="open")
    return run(wf, roots).value_of("seen").select(F.col("root_id").alias("event_id"), "value.*")


@query(f"SELECT event_id, after FROM (SELECT event_id, sum({CENTS}) OVER ({UPTO})::BIGINT AS after FROM events) WHERE after >= 500000")
def state_of_post(spark: SparkSession, d: str) -> DataFrame:
    """A rule below the accumulator sees the state after the fact."""
    wf, roots = cents_flow(spark, d)
    wf = wf.add(accumulator(0, name="sum", native="sum"), to="cents")
    wf = wf.add(rule(lambda v, *, s=meta.state_of("sum"): s, lambda v, *, s=meta.state_of("sum"): s >= 500000, "over"), to="sum")
    return run(wf, roots).value_of("over").select(F.col("root_id").alias("event_id"), F.col("value").alias("after"))


@query(f"SELECT event_id, n::BIGINT AS purchases FROM (SELECT event_id, count(*) FILTER (event_type = 'purchase') OVER ({UPTO}) AS n FROM events) WHERE n >= 3")
def fact_count_gate(spark: SparkSession, d: str) -> DataFrame:
    wf = workflow().add(rule(lambda v: v["value"], lambda v: v["event_type"] == "purchase", "purchase"))
    wf = wf.add(step(lambda v: v["event_id"], "a")).add(step(lambda v: v, "b"), to="a")
    wf = wf.add(rule(lambda v, *, n=meta.fact_count("purchase"): n, lambda v, *, n=meta.fact_count("purchase"): n >= 3, "gate"), to="b")
    return run(wf, events(spark, d)).value_of("gate").select(F.col("root_id").alias("event_id"), F.col("value").alias("purchases"))


@query(f"SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER ({UPTO}) AS latest, coalesce(bool_or(event_type = 'purchase') OVER ({UPTO}), false) AS ran, event_type = 'purchase' AS here FROM events")
def latest_value_of(spark: SparkSession, d: str) -> DataFrame:
    wf = workflow().add(rule(lambda v: v["value"], lambda v: v["event_type"] == "purchase", "purchase")).add(step(lambda v: v, "a")).add(step(lambda v: v, "b"), to="a")
    seen = step(lambda v, *, x=meta.latest_value_of("purchase"), r=meta.step_ran("purchase"), h=meta.ran_here("purchase"): F.struct(x.alias("latest"), r.alias("ran"), h.alias("here")), "seen")
    return run(wf.add(seen, to="b"), events(spark, d)).value_of("seen").select(F.col("root_id").alias("event_id"), "value.*")


@query("SELECT conv_id, turn, string_agg(role, '>') OVER (PARTITION BY conv_id ORDER BY turn) AS roles FROM conversations")
def all_values_of(spark: SparkSession, d: str) -> DataFrame:
    df = read(spark, d, "conversations")
    wf = workflow().add(step(lambda v: v["role"], "role")).add(step(lambda r, *, xs=meta.all_values_of("role"): F.array_join(xs, ">"), "roles"), to="role")
    return run(wf, root_facts(df, "turn", "conv_id")).value_of("roles").select(F.col("k").alias("conv_id"), F.col("seq").alias("turn"), F.col("value").alias("roles"))


@query("SELECT o_orderkey, o_totalprice AS value FROM orders WHERE o_totalprice > 123456")
def context_threshold(spark: SparkSession, d: str) -> DataFrame:
    made = rule(lambda v: v["o_totalprice"], lambda v, *, t=meta.context("threshold"): v["o_totalprice"] > t, "over")
    return run(workflow().add(made), orders(spark, d), context={"threshold": 123456}).value_of("over").select(F.col("root_id").alias("o_orderkey"), "value")


@query("SELECT o_orderkey, o_custkey * 3 + 10 AS value FROM orders")
def context_default(spark: SparkSession, d: str) -> DataFrame:
    wf = workflow().add(step(lambda v, *, a=meta.context("a", default=3), b=meta.context("b", default=1): v["o_custkey"] * a + b, "s")).put_context({"b": 5}).put_context({"b": 10}, "s")
    return run(wf, orders(spark, d)).value_of("s").select(F.col("root_id").alias("o_orderkey"), "value")


@query(f"SELECT event_id, 'over_limit' AS reactor, s::BIGINT AS state FROM (SELECT event_id, sum({CENTS}) OVER ({UPTO}) AS s FROM events) WHERE s > 1000000 UNION ALL SELECT event_id, 'even', s::BIGINT FROM (SELECT event_id, sum({CENTS}) OVER ({UPTO}) AS s FROM events) WHERE s % 2 = 0")
def state_machine_reactors(spark: SparkSession, d: str) -> DataFrame:
    machine = StateMachine(name="m", init=0, native="sum", reactions={"over_limit": (lambda s: s > 1000000, lambda s: s), "even": (lambda s: s % 2 == 0, lambda s: s)})
    wf, roots = cents_flow(spark, d)
    done = run(wf.add(machine, to="cents"), roots)
    parts = [done.value_of(("m", r)).select(F.col("root_id").alias("event_id"), F.lit(r).alias("reactor"), F.col("value").alias("state")) for r in ("over_limit", "even")]
    return parts[0].unionByName(parts[1])


LIFECYCLE = {"new": {"signup": "active", "view": "visitor"}, "visitor": {"signup": "active"}, "active": {"purchase": "buyer", "error": "blocked"}, "buyer": {"error": "blocked"}, "blocked": {"signup": "active"}}
FSM_SQL = " ".join(f"WHEN f.state = '{s}' AND e.event_type = '{ev}' THEN '{to}'" for s, on in LIFECYCLE.items() for ev, to in on.items())


@query(
    f"WITH RECURSIVE e AS (SELECT event_id, user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events), f AS (SELECT 0::BIGINT AS event_id, user_id, 0::BIGINT AS n, 'new' AS state FROM (SELECT DISTINCT user_id FROM events) UNION ALL SELECT e.event_id, e.user_id, e.n, CASE {FSM_SQL} ELSE f.state END FROM f JOIN e ON e.user_id = f.user_id AND e.n = f.n + 1) SELECT event_id, state FROM f WHERE n > 0"
)
def fsm_user_lifecycle(spark: SparkSession, d: str) -> DataFrame:
    wf = workflow().add(step(lambda v: v["event_type"], "type")).add(Fsm(name="life", initial_state="new", states=LIFECYCLE, on_entry={"blocked": "alert"}), to="type")
    return run(wf, events(spark, d)).value_of("life").select(F.col("root_id").alias("event_id"), F.col("value").alias("state"))


@query(
    f"WITH RECURSIVE e AS (SELECT event_id, user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events), f AS (SELECT 0::BIGINT AS event_id, user_id, 0::BIGINT AS n, 'new' AS old, 'new' AS state FROM (SELECT DISTINCT user_id FROM events) UNION ALL SELECT e.event_id, e.user_id, e.n, f.state, CASE {FSM_SQL} ELSE f.state END FROM f JOIN e ON e.user_id = f.user_id AND e.n = f.n + 1) SELECT event_id, 'entered' AS tag, 'alert' AS payload FROM f WHERE state = 'blocked' AND old <> 'blocked'"
)
def fsm_entry_actions(spark: SparkSession, d: str) -> DataFrame:
    wf = workflow().add(step(lambda v: v["event_type"], "type")).add(Fsm(name="life", initial_state="new", states=LIFECYCLE, on_entry={"blocked": "alert"}), to="type")
    return run(wf, events(spark, d)).emitted("life").select(F.col("root_id").alias("event_id"), "tag", "payload")


@query(
    f"WITH RECURSIVE e AS (SELECT event_id, user_id, event_type, {CENTS} AS c, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events), f AS (SELECT 0::BIGINT AS event_id, user_id, 0::BIGINT AS n, 0::BIGINT AS bal, '' AS tag FROM (SELECT DISTINCT user_id FROM events) UNION ALL SELECT e.event_id, e.user_id, e.n, CASE WHEN e.event_type = 'signup' THEN f.bal + e.c WHEN e.event_type = 'purchase' AND f.bal >= e.c THEN f.bal - e.c ELSE f.bal END, CASE WHEN e.event_type = 'signup' THEN 'deposited' WHEN e.event_type = 'purchase' THEN CASE WHEN f.bal >= e.c THEN 'withdrawn' ELSE 'rejected' END ELSE '' END FROM f JOIN e ON e.user_id = f.user_id AND e.n = f.n + 1) SELECT event_id, bal::BIGINT AS balance, tag FROM f WHERE n > 0"
)
def aggregate_balance(spark: SparkSession, d: str) -> DataFrame:
    account = Aggregate(
        name="account",
        init=0,
        state_type="bigint",
        commands={"signup": (None, lambda s, c: {"tag": "deposited", "by": c["cents"]}), "purchase": (lambda s, c: s >= c["cents"], lambda s, c: {"tag": "withdrawn", "by": c["cents"]})},
        events={"deposited": lambda s, e: s + e["by"], "withdrawn": lambda s, e: s - e["by"]},
    )
    wf = workflow().add(step(lambda v: F.struct(v["event_type"].alias("tag"), money(v["value"]).alias("cents")), "command")).add(account, to="command")
    tag = F.coalesce(F.get("emitted", F.lit(0))["tag"], F.lit("")).alias("tag")
    return run(wf, events(spark, d)).transitions("account").select(F.col("root_id").alias("event_id"), F.col("value").alias("balance"), tag)


@query(
    "SELECT o_orderkey, CASE WHEN o_totalprice <= 50000 THEN 'aborted' WHEN o_orderstatus = 'P' THEN 'compensating' ELSE 'completed' END AS status, CASE WHEN o_totalprice <= 50000 THEN 'reserve' WHEN o_orderstatus = 'P' THEN 'charge' END AS failed, CASE WHEN o_totalprice > 50000 AND o_orderstatus = 'P' THEN 'reserve' ELSE '' END AS compensated FROM orders"
)
def saga_order(spark: SparkSession, d: str) -> DataFrame:
    saga = Saga(
        name="saga",
        transactions={"reserve": lambda r: F.when(r["input"]["o_totalprice"] > 50000, r["input"]["o_orderkey"]), "charge": lambda r: F.when(r["input"]["o_orderstatus"] != "P", r["reserve"] + 1)},
        compensations={"reserve": lambda r: F.lit("released"), "charge": lambda r: F.lit("refunded")},
    )
    s = run(workflow().add(saga), orders(spark, d)).value_of("saga")
    return s.select(F.col("root_id").alias("o_orderkey"), "value.status", "value.failed", F.array_join(F.transform("value.compensated", lambda c: c["name"]), ",").alias("compensated"))


@query(
    f"SELECT event_id, coalesce(bool_or(event_type = 'signup') OVER ({UPTO}), false) AND coalesce(bool_or(event_type = 'purchase') OVER ({UPTO}), false) AND event_type IN ('signup', 'purchase') AS completed, CASE WHEN event_type = 'signup' THEN 'welcome' ELSE '' END AS command FROM events"
)
def process_manager_fulfilment(spark: SparkSession, d: str) -> DataFrame:
    manager = ProcessManager(
        name="pm",
        state_type="struct<signed:boolean,bought:boolean>",
        init={"signed": False, "bought": False},
        on={"signup": (lambda s, e: {"signed": True}, lambda s, e: "welcome"), "purchase": (lambda s, e: {"bought": True}, None)},
        complete=lambda s: s["signed"] and s["bought"],
    )
    wf = workflow().add(step(lambda v: v["event_type"], "type")).add(manager, to="type")
    over = F.exists("emitted", lambda e: e["tag"] == "process_completed").alias("completed")
    command = F.coalesce(F.get(F.filter("emitted", lambda e: e["tag"] == "command"), F.lit(0))["payload"], F.lit("")).alias("command")
    return run(wf, events(spark, d)).transitions("pm").select(F.col("root_id").alias("event_id"), over, command)


# ---- composition, results, policies, log --------------------------------------------------------


@query("SELECT o_orderkey, 'double' AS component, o_custkey * 2 AS value FROM orders UNION ALL SELECT o_orderkey, 'half', o_custkey // 2 FROM orders WHERE o_custkey % 2 = 0")
def merge_workflows(spark: SparkSession, d: str) -> DataFrame:
    a = workflow("a").add(step(lambda v: v["o_custkey"] * 2, "double"))
    b = workflow("b").add(rule(lambda v: F.floor(v["o_custkey"] / 2), lambda v: v["o_custkey"] % 2 == 0, "half"))
    return run(a.merge(b), orders(spark, d)).productions().select(F.col("root_id").alias("o_orderkey"), "component", F.get_json_object("value", "$.v").cast("long").alias("value"))


@query("SELECT o_orderkey, (o_custkey + 1) * 10 AS value FROM orders")
def sub_workflow(spark: SparkSession, d: str) -> DataFrame:
    inner = workflow("inner").add(step(lambda x: x * 10, "ten"))
    wf = workflow("outer").add(step(lambda v: v["o_custkey"] + 1, "plus")).add(inner, to="plus")
    return run(wf, orders(spark, d)).value_of("ten").select(F.col("root_id").alias("o_orderkey"), "value")


@query("SELECT o_orderkey, o_custkey * 10 AS value FROM orders")
def remove_component(spark: SparkSession, d: str) -> DataFrame:
    wf = workflow().add(step(lambda v: v["o_custkey"], "key")).add(step(lambda x: x + 1, "plus"), to="key").add(step(lambda x: x * 10, "ten"), to="plus").remove("plus")
    return run(from_log(wf.log), orders(spark, d)).value_of("ten").select(F.col("root_id").alias("o_orderkey"), "value")


@query(f"SELECT event_id, {CENTS} * 2 AS result, CASE WHEN event_type = 'error' THEN 'error' END AS problem FROM events")
def results_ports_one(spark: SparkSession, d: str) -> DataFrame:
    wf = workflow().add(step(lambda v: money(v["value"]) * 2, "double")).add(rule(lambda v: F.lit("error"), lambda v: v["event_type"] == "error", "problem"))
    wf = wf.with_ports(outputs={"result": {"type": "integer", "source": "double"}, "problem": {"type": "string"}})
    return run(wf, events(spark, d)).results().select(F.col("root_id").alias("event_id"), "result", "problem")


@query(f"SELECT l_orderkey, array_to_string(list_transform(c, lambda x: x * 2), ',') AS doubled FROM ({ORDER_LINES})")
def results_ports_many(spark: SparkSession, d: str) -> DataFrame:
    wf = workflow().add(map_each(lambda x: x * 2, "double")).with_ports(outputs={"doubled": {"cardinality": "many", "source": "double"}})
    return run(wf, order_lines(spark, d)).results().select(F.col("root_id").alias("l_orderkey"), F.array_join("doubled", ",").alias("doubled"))


def order_flow(spark: SparkSession, d: str, extra: bool = False) -> Compiled:
    """A small graph over all orders."""
    wf = workflow(steps=[(step(lambda v: v["o_custkey"] + 1, "plus"), [step(lambda x: x * 2, "twice")])])
    wf = wf.add(step(lambda a, b: a + b, "both"), to=["plus", "twice"]) if extra else wf
    return run(wf, orders(spark, d))


@query("SELECT 'plus' AS component, count(*)::BIGINT AS n, sum(o_custkey + 1)::BIGINT AS total FROM orders UNION ALL SELECT 'twice', count(*), sum((o_custkey + 1) * 2)::BIGINT FROM orders")
def productions_by_component(spark: SparkSession, d: str) -> DataFrame:
    by = order_flow(spark, d).productions_by_component(64)
    values = F.transform("values", lambda x: F.get_json_object(x, "$.v").cast("long"))
    total = F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x)
    return by.groupBy("component").agg(F.sum(F.size("values")).alias("n"), F.sum(total).alias("total"))


@query("SELECT o_orderkey, producer, depth, parent, CASE depth WHEN 1 THEN c + 1 WHEN 2 THEN (c + 1) * 2 WHEN 4 THEN (c + 1) * 3 ELSE -1 END AS value FROM (SELECT o_orderkey, o_custkey AS c FROM orders), (VALUES ('input', 0, ''), ('plus', 1, 'input'), ('twice', 2, 'plus'), ('both/join', 3, 'twice'), ('both', 4, 'both/join')) t(producer, depth, parent)")
def fact_log_lineage(spark: SparkSession, d: str) -> DataFrame:
    """Every fact of every order with its value, and its parent, found by id."""
    log = order_flow(spark, d, extra=True).facts()
    up = log.select(F.col("fact_id").alias("parent_id"), F.replace(F.col("producer"), F.lit("."), F.lit("/")).alias("parent"))
    number = F.when(~F.col("producer").isin("input", "both.join"), F.get_json_object("value", "$.v").cast("long"))
    return log.join(up, "parent_id", "left").select(F.col("root_id").alias("o_orderkey"), F.replace(F.col("producer"), F.lit("."), F.lit("/")).alias("producer"), "depth", F.coalesce("parent", F.lit("")).alias("parent"), F.coalesce(number, F.lit(-1)).alias("value"))


@query("SELECT o_orderkey, 'twice' AS producer, (o_custkey + 1) * 2 AS value FROM orders")
def hot_frontier(spark: SparkSession, d: str) -> DataFrame:
    found = frontier(order_flow(spark, d).facts())
    return found.select(F.col("root_id").alias("o_orderkey"), "producer", F.get_json_object("value", "$.v").cast("long").alias("value"))


@query("SELECT o_orderkey, producer, producer <> 'twice' AS stripped, CASE producer WHEN 'plus' THEN o_custkey + 1 WHEN 'twice' THEN (o_custkey + 1) * 2 ELSE o_custkey END AS value FROM orders, (VALUES ('input'), ('plus'), ('twice')) t(producer)")
def lean_replay(spark: SparkSession, d: str) -> DataFrame:
    """Strip the values of cold facts, and look them up again: each fact has its value back."""
    log = order_flow(spark, d).facts()
    lean = dehydrated(log)
    back = rehydrated(lean, log).select("fact_id", "value")
    met = lean.select("fact_id", "root_id", "producer", "value_stripped").join(back, "fact_id")
    number = F.coalesce(F.get_json_object("value", "$.v.o_custkey"), F.get_json_object("value", "$.v")).cast("long")
    return met.select(F.col("root_id").alias("o_orderkey"), "producer", F.col("value_stripped").alias("stripped"), number.alias("value"))


def needed() -> object:
    """What the Python step reads, so that no other column is read or sent to Python."""
    return step(lambda v: F.struct(v["event_id"], v["props"]), "needed")


def safe_k(v: dict) -> int:
    """A Python step that fails on every third event."""
    import json

    k = int(json.loads(v["props"])["k"])
    if v["event_id"] % 3 == 0:
        raise ValueError("third")
    return k


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN -1 ELSE CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k FROM events")
def policy_fallback_value(spark: SparkSession, d: str) -> DataFrame:
    wf = workflow().add(needed()).add(python_step(safe_k, "bigint", "k"), to="needed").add_policy(PolicyRule("k", Policy(fallback=lambda v, e: -1)))
    return run(wf, events(spark, d)).value_of("k").select(F.col("root_id").alias("event_id"), F.col("value").alias("k"))


@query("SELECT event_id, 'next' AS producer FROM events WHERE event_id % 3 <> 0 UNION ALL SELECT event_id, 'failed:2' FROM events WHERE event_id % 3 = 0")
def failure_skip_downstream(spark: SparkSession, d: str) -> DataFrame:
    """A fact that fails after its retries stops what is below it, for that root fact alone."""
    wf = workflow().add(needed()).add(python_step(safe_k, "bigint", "k"), to="needed").add(step(lambda k: k + 1, "next"), to="k")
    done = run(wf.add_policy(PolicyRule("default", Policy(retries=1))), events(spark, d))
    said = F.concat("status", F.lit(":"), F.col("attempts").cast("string"))
    return done.outcomes("k", ["next"]).select(F.col("root_id").alias("event_id"), F.when(F.col("next").isNotNull(), "next").otherwise(said).alias("producer"))


@query("SELECT vec_id, list_max(embedding)::DOUBLE AS top FROM embeddings")
def custom_component(spark: SparkSession, d: str) -> DataFrame:
    """A component that brings its own plan, over a source read as facts."""
    top = Custom(name="top", compile=lambda df, value, out: df.withColumn(out, F.array_max(F.col(f"`{value}`.embedding")).cast("double")))
    done = run(workflow().add(top), read_facts(spark, f"{d}/embeddings.parquet", "vec_id"))
    return done.value_of("top").select(F.col("root_id").alias("vec_id"), F.col("value").alias("top"))


@query("SELECT o_orderkey, producer, count(*)::BIGINT AS facts FROM orders, (VALUES ('input'), ('plus')) t(producer) GROUP BY ALL")
def reactions_once(spark: SparkSession, d: str) -> DataFrame:
    """Inputs and productions, each once."""
    wf = workflow().add(step(lambda v: v["o_custkey"] + 1, "plus"))
    facts = run(wf, orders(spark, d)).reactions()
    return facts.groupBy(F.col("root_id").alias("o_orderkey"), "producer").agg(F.count(F.lit(1)).alias("facts"))


@query("SELECT o_orderkey, o_custkey + 1 AS value FROM orders WHERE o_orderstatus = 'P'")
def fact_resolver(spark: SparkSession, d: str) -> DataFrame:
    """Values of named facts, looked up by id."""
    wf = workflow().add(step(lambda v: v["o_custkey"] + 1, "plus")).add(rule(lambda v: v["o_custkey"], lambda v: v["o_orderstatus"] == "P", "open"))
    log = run(wf, orders(spark, d)).facts()
    wanted = log.filter("producer = 'open'").select("root_id").join(log.filter("producer = 'plus'"), "root_id")
    got = resolve(log, wanted).join(log.select("fact_id", "root_id"), "fact_id")
    return got.select(F.col("root_id").alias("o_orderkey"), F.get_json_object("value", "$.v").cast("long").alias("value"))


@query("SELECT o_orderkey, (o_custkey + 1) * 2 AS value FROM orders WHERE (o_custkey + 1) % 3 = 0")
def invoke_one_component(spark: SparkSession, d: str) -> DataFrame:
    wf = workflow().add(step(lambda v: v["o_custkey"] + 1, "a")).add(rule(lambda x: x * 2, lambda x: x % 3 == 0, "b"), to="a").add(step(lambda x: x - 1, "unused"), to="a")
    return invoke(wf, orders(spark, d), "b").select(F.col("root_id").alias("o_orderkey"), "value")


# ---- null keys, equal rows, initial values ------------------------------------------------------

NULLED = "CASE WHEN event_id % 5 = 0 THEN NULL ELSE user_id END"


@query(f"SELECT event_id, coalesce({NULLED}, -1) AS user_id, len(string_split(event_type, 'e'))::BIGINT + 2 * len(event_type) AS value FROM events")
def null_key_join(spark: SparkSession, d: str) -> DataFrame:
    """A reduce joined with a step, where a fifth of all root facts has no key."""
    df = read(spark, d, "events").withColumn("user_id", F.when(F.col("event_id") % 5 != 0, F.col("user_id")))
    wf = workflow().add(step(lambda v: F.split(v["event_type"], "e"), "parts")).add(map_each(lambda x: F.lit(1).cast("long"), "one"), to="parts").add(condition(lambda x: x > 0, "any"), to="one")
    wf = wf.add(reduce(0, name="n", native=F.sum), to="any").add(step(lambda v: F.length(v["event_type"]).cast("long"), "length")).add(step(lambda n, m: n + 2 * m, "sum"), to=["n", "length"])
    got = run(wf, root_facts(df, "event_id", "user_id")).results(["sum"])
    return got.select(F.col("root_id").alias("event_id"), F.coalesce("k", F.lit(-1)).alias("user_id"), F.col("sum").alias("value"))


@query(f"SELECT event_id, coalesce({NULLED}, -1) AS user_id, sum({CENTS}) OVER (PARTITION BY {NULLED} ORDER BY event_id)::BIGINT AS total FROM events")
def null_key_state(spark: SparkSession, d: str) -> DataFrame:
    """A fold in Python whose state a step of the root reads: facts without a key share one state."""
    df = read(spark, d, "events").withColumn("user_id", F.when(F.col("event_id") % 5 != 0, F.col("user_id")))
    wf = workflow().add(step(lambda v: money(v["value"]), "cents")).add(accumulator(0, lambda x, s: s + x, "sum"), to="cents")
    wf = wf.add(step(lambda v: v, "a"), to="cents").add(step(lambda v: v, "b"), to="a").add(step(lambda v, *, s=meta.state_of("sum"): s, "seen"), to="b")
    got = run(wf, root_facts(df, "event_id", "user_id")).value_of("seen")
    return got.select(F.col("root_id").alias("event_id"), F.coalesce("k", F.lit(-1)).alias("user_id"), F.col("value").alias("total"))


@query("SELECT l_orderkey, count(*)::BIGINT AS facts, sum(l_linenumber + 1)::BIGINT AS total FROM (SELECT l_orderkey, l_linenumber FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber FROM lineitem) GROUP BY l_orderkey")
def equal_rows_are_facts(spark: SparkSession, d: str) -> DataFrame:
    """Each line twice: equal rows are different root facts, through a map and a reduce."""
    df = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber")
    roots = root_facts(numbered(df.unionByName(df), "place"), "place", "l_orderkey")
    wf = workflow().add(step(lambda v: F.array(v["l_linenumber"].cast("long"), F.lit(1).cast("long")), "two")).add(map_each(lambda x: x, "each"), to="two")
    wf = wf.add(condition(lambda x: x > 0, "any"), to="each").add(reduce(0, name="sum", native=F.sum), to="any")
    got = run(wf, roots).value_of("sum")
    return got.groupBy(F.col("k").alias("l_orderkey")).agg(F.count(F.lit(1)).alias("facts"), F.sum("value").alias("total"))


@query(f"SELECT l_orderkey, greatest(5000000, list_max(c)) AS highest, least(200000, list_min(c)) AS lowest, 100 + len(c)::BIGINT AS n FROM ({ORDER_LINES})")
def reduce_native_init(spark: SparkSession, d: str) -> DataFrame:
    """Initial values of native reduces: compared with by minima and maxima, added by counts."""
    wf = workflow().add(map_each(lambda x: x, "each"))
    for name, init, native in (("highest", 5000000, F.max), ("lowest", 200000, F.min), ("n", 100, F.count)):
        wf = wf.add(reduce(init, name=name, native=native), to="each")
    got = run(wf, order_lines(spark, d)).results(["highest", "lowest", "n"])
    return got.select(F.col("root_id").alias("l_orderkey"), "highest", "lowest", "n")


# ---- streams ------------------------------------------------------------------------------------


def event_stream(spark: SparkSession, d: str, value: object = None) -> DataFrame:
    schema = read(spark, d, "events").schema
    # a pattern, as a stream's plain path must be a folder, and the table may be one file
    return stream_roots(spark.readStream.schema(schema).parquet(f"{d}/events.parque[t]"), "event_id", "user_id", value)


@query(f"SELECT event_id, {CENTS} AS cents FROM events WHERE event_type = 'purchase'")
def stream_rule(spark: SparkSession, d: str) -> DataFrame:
    """A row-wise graph over a stream."""
    wf = workflow().add(rule(lambda v: money(v["value"]), lambda v: v["event_type"] == "purchase", "bought"))
    out = drain(stream_rowwise(wf, event_stream(spark, d), "bought"), "stream_rule")
    return out.select(F.col("root_id").alias("event_id"), F.col("value").alias("cents"))


@query(SQL["fsm_user_lifecycle"])
def stream_state_machine(spark: SparkSession, d: str) -> DataFrame:
    """The machine of fsm_user_lifecycle with its state in the state store."""
    machine = Fsm(name="life", initial_state="new", states=LIFECYCLE, on_entry={"blocked": "alert"})
    out = drain(stream_fold(machine, event_stream(spark, d, F.col("event_type"))), "stream_fsm")
    return out.filter("tag is null").select(F.col("root_id").alias("event_id"), F.get_json_object(F.concat(F.lit('{"v":'), "state", F.lit("}")), "$.v").alias("state"))


@query(SQL["state_of_post"])
def stream_state_graph(spark: SparkSession, d: str) -> DataFrame:
    """The graph of state_of_post over a stream: a step, a state, and a rule that reads it."""
    wf = workflow().add(step(lambda v: money(v["value"]), "cents")).add(accumulator(0, name="sum", native="sum"), to="cents")
    wf = wf.add(rule(lambda v, *, s=meta.state_of("sum"): s, lambda v, *, s=meta.state_of("sum"): s >= 500000, "over"), to="sum")
    out = drain(stream_graph(wf, event_stream(spark, d), "over"), "stream_state_graph")
    return out.select(F.col("root_id").alias("event_id"), F.col("value").alias("after"))


# ---- managed runs -------------------------------------------------------------------------------


def two_batches(spark: SparkSession, d: str) -> tuple[Workflow, DataFrame, DataFrame]:
    """A graph with states of both kinds, and the events in two batches, the earlier ones first."""
    wf, roots = cents_flow(spark, d)
    wf = wf.add(accumulator(0, name="sum", native="sum"), to="cents").add(accumulator(7, lambda x, s: (s * 31 + x) % 1009, "hash"), to="cents")
    wf = wf.add(step(lambda c: c, "a"), to="cents").add(step(lambda c: c, "b"), to="a")
    wf = wf.add(step(lambda c, *, n=meta.fact_count("cents"): n, "nth"), to="b")
    half = read(spark, d, "events").agg(F.max("event_id")).first()[0] // 2
    return wf, roots.filter(F.col("seq") <= half), roots.filter(F.col("seq") > half)


TWO_BATCHES = f"WITH RECURSIVE e AS (SELECT event_id, user_id, {CENTS} AS c, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events), f AS (SELECT event_id, user_id, n, c AS total, (7 * 31 + c) % 1009 AS state FROM e WHERE n = 1 UNION ALL SELECT e.event_id, e.user_id, e.n, f.total + e.c, (f.state * 31 + e.c) % 1009 FROM f JOIN e ON e.user_id = f.user_id AND e.n = f.n + 1) SELECT event_id, total::BIGINT AS total, state::BIGINT AS state, n::BIGINT AS nth FROM f"


@query(TWO_BATCHES)
def runner_two_batches(spark: SparkSession, d: str) -> DataFrame:
    """Two runs give what one run over all events gives: state and counts go from one to the next."""
    wf, early, late = two_batches(spark, d)
    runner = Runner(spark, checkpoint="manual")
    runner.start_workflow("w", wf)
    runner.run("w", early)
    runner.run("w", late)
    got = runner.get_results("w", ["sum", "hash", "nth"])
    return got.select(F.col("root_id").alias("event_id"), F.col("sum").alias("total"), F.col("hash").alias("state"), "nth")


@query(TWO_BATCHES)
def resume_continues(spark: SparkSession, d: str) -> DataFrame:
    """One runner evaluates a batch, notes the next and is lost; another takes up its store, state and open run."""
    wf, early, late = two_batches(spark, d)
    at = shared_folder(spark, "resume")
    first = Runner(spark, ParquetStore(spark, at))
    first.start_workflow("w", wf)
    first.run("w", early)
    first.dispatch("w", late)
    second = Runner(spark, ParquetStore(spark, at))
    second.resume("w", wf)
    second.go_on("w")
    log = second.facts("w").filter("label = 'state_produced' or component = 'nth'")
    number = F.get_json_object("value", "$.v").cast("long")
    each = log.groupBy(F.col("root_id").cast("long").alias("event_id"))
    return each.agg(*(F.max(F.when(F.col("component") == c, number)).alias(n) for c, n in (("sum", "total"), ("hash", "state"), ("nth", "nth"))))


@query("SELECT 1::BIGINT AS run, count(*)::BIGINT AS inputs, sum(event_id)::BIGINT AS ids FROM events WHERE event_id > (SELECT max(event_id) // 2 FROM events)")
def pending_runnables(spark: SparkSession, d: str) -> DataFrame:
    """Of two dispatched runs one was evaluated: the other is open, with its inputs."""
    wf, early, late = two_batches(spark, d)
    runner = Runner(spark, checkpoint="manual")
    runner.start_workflow("w", wf)
    runner.run("w", early)
    runner.dispatch("w", late)
    inputs = runner.store.stream("w", "inputs", "1").agg(F.lit(1).cast("long").alias("run"), F.count(F.lit(1)).alias("inputs"), F.sum("seq").alias("ids"))
    return runner.pending("w").select(F.col("runnable_id").alias("run")).join(inputs, "run")


@query(
    "SELECT user_id, epoch_us(min(ts)) AS start, epoch_us(max(ts)) + 43200000000 AS \"end\", count(*)::BIGINT AS n FROM (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM "
    "(SELECT user_id, ts, CASE WHEN ts <= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 12 HOUR THEN 0 ELSE 1 END AS fresh FROM (SELECT user_id, ts::TIMESTAMP AS ts FROM events))) GROUP BY user_id, session"
)
def event_time_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Each user's sessions: events at most twelve hours apart."""
    df = read(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    by = sessions(df, "ts", "12 hours", "1 day", ["user_id"])
    return by.select("user_id", F.unix_micros("start").alias("start"), F.unix_micros("end").alias("end"), "n")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
