"""Every operator on the driver's tables by name, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import blobs, unsigned
from .operators import aggregates, changes, indexes, keyed, merkle, shards, snapshots
from .plans.circuit import Binary, Constant, Load, Unary, compile_to_column, measure, simplify
from .plans.predicate import col, columns_of, compile_predicate, filter_plain, filter_typed, flag_matches, query, require_plain
from .sources import files, shared
from .streaming import feed

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _register(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return keep


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Filters and projections


def _filter(name: str, predicate, sql: str) -> None:
    def run(spark, sf_dir):
        return filter_typed(_t(spark, sf_dir, "lineitem"), predicate).select("l_orderkey", "l_partkey", "l_quantity", "l_discount")

    run.__name__ = name
    _register(f"SELECT l_orderkey, l_partkey, l_quantity, l_discount FROM lineitem WHERE {sql}")(run)


@_register("SELECT l_orderkey, l_partkey, l_quantity, l_extendedprice FROM lineitem WHERE l_quantity > 24 AND l_discount <= 0.05")
def filter_project(spark, sf_dir):
    """Flagship: predicate and projection reach the scan."""
    found = (col("l_quantity") > 24) & (col("l_discount") <= 0.05)
    return query(_t(spark, sf_dir, "lineitem")).where(found).select("l_orderkey", "l_partkey", "l_quantity", "l_extendedprice").run()


_filter("filter_eq", col("l_returnflag") == "R", "l_returnflag = 'R'")
_filter("filter_ne", col("l_returnflag") != "R", "l_returnflag <> 'R'")
_filter("filter_gt", col("l_quantity") > 45, "l_quantity > 45")
_filter("filter_gte", col("l_quantity") >= 45, "l_quantity >= 45")
_filter("filter_lt", col("l_quantity") < 5, "l_quantity < 5")
_filter("filter_lte", col("l_quantity") <= 5, "l_quantity <= 5")
_filter("filter_and", (col("l_quantity") > 10) & (col("l_discount") < 0.02), "l_quantity > 10 AND l_discount < 0.02")
_filter("filter_or", (col("l_quantity") > 49) | (col("l_discount") == 0.1), "l_quantity > 49 OR l_discount = 0.1")
_filter("filter_not", ~((col("l_quantity") > 3) | (col("l_returnflag") == "A")), "NOT (l_quantity > 3 OR l_returnflag = 'A')")
_filter("filter_two_bounds", (col("l_quantity") > 18) & (col("l_quantity") < 21), "l_quantity > 18 AND l_quantity < 21")


@_register("SELECT doc_id, lang FROM documents WHERE strlen(text) > 64 OR text > 'S'")
def filter_opaque_kept(spark, sf_dir):
    """Values over 64 bytes can't be compared and are kept."""
    return filter_plain(_t(spark, sf_dir, "documents"), col("text") > "S").select("doc_id", "lang")


@_register("SELECT c_custkey, c_acctbal, (c_acctbal > 5000 AND c_mktsegment = 'BUILDING') AS predicate_result FROM customer")
def filter_flagged(spark, sf_dir):
    """All rows with the predicate's result; whoever may read it decides."""
    return flag_matches(_t(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_mktsegment"), (col("c_acctbal") > 5000.0) & (col("c_mktsegment") == "BUILDING")).drop("c_mktsegment")


@_register("SELECT c_custkey FROM customer WHERE c_acctbal > 5000 AND c_mktsegment = 'BUILDING'")
def filter_flagged_then_read(spark, sf_dir):
    return filter_flagged(spark, sf_dir).where("predicate_result").select("c_custkey")


# Reads by key


@_register("SELECT * FROM orders WHERE o_orderkey = 77")
def point_get(spark, sf_dir):
    return keyed.point_get(_t(spark, sf_dir, "orders"), "o_orderkey", 77)


@_register("SELECT * FROM orders WHERE o_orderkey = -5")
def point_get_missing(spark, sf_dir):
    return keyed.point_get(_t(spark, sf_dir, "orders"), "o_orderkey", -5)


_ASKED = "(VALUES (0, 3), (1, 999999999), (2, 1), (3, 3), (4, 140))"


def _asked(spark, key):
    return spark.createDataFrame([(0, 3), (1, 999999999), (2, 1), (3, 3), (4, 140)], f"ordinal int, {key} long")


@_register(f"SELECT ordinal, c_custkey, c_name, c_acctbal FROM {_ASKED} a(ordinal, c_custkey) LEFT JOIN (SELECT c_custkey, c_name, c_acctbal FROM customer) c USING (c_custkey)")
def multi_get(spark, sf_dir):
    return keyed.multi_get(_asked(spark, "c_custkey"), _t(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal"), "c_custkey")


@_register(f"SELECT ordinal, a.k::BIGINT AS c_custkey, EXISTS (SELECT 1 FROM customer WHERE c_custkey = a.k) AS found FROM {_ASKED} a(ordinal, k)")
def contains_keys(spark, sf_dir):
    return keyed.which_exist(_asked(spark, "c_custkey"), _t(spark, sf_dir, "customer"), "c_custkey")


@_register("SELECT * FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 500")
def range_scan(spark, sf_dir):
    return keyed.range_scan(_t(spark, sf_dir, "orders"), "o_orderkey", 100, 500)


@_register("SELECT * FROM orders WHERE o_orderkey >= 500 AND o_orderkey < 100")
def inverted_range(spark, sf_dir):
    return keyed.range_scan(_t(spark, sf_dir, "orders"), "o_orderkey", 500, 100)


@_register("SELECT * FROM customer WHERE c_name >= 'Customer#000000100' AND c_name < 'Customer#000000110'")
def range_scan_text(spark, sf_dir):
    return keyed.range_scan(_t(spark, sf_dir, "customer"), "c_name", "Customer#000000100", "Customer#000000110")


@_register("SELECT p_partkey, p_name FROM part WHERE starts_with(p_name, 'small')")
def prefix_scan(spark, sf_dir):
    return keyed.prefix_scan(_t(spark, sf_dir, "part"), "p_name", "small").select("p_partkey", "p_name")


@_register("SELECT page_id, url FROM pages WHERE starts_with(url, 'https://blog.')")
def prefix_scan_urls(spark, sf_dir):
    return keyed.prefix_scan(_t(spark, sf_dir, "pages"), "url", "https://blog.").select("page_id", "url")


@_register("SELECT DISTINCT l_partkey FROM lineitem")
def keys_list(spark, sf_dir):
    return keyed.keys(_t(spark, sf_dir, "lineitem"), "l_partkey")


@_register("SELECT * FROM supplier")
def full_scan(spark, sf_dir):
    return _t(spark, sf_dir, "supplier")


@_register("SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n = 1")
def latest_per_key(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    log = e.select("user_id", F.col("event_id").alias("seq"), F.lit("put").alias("op"), "event_id", "event_type", "value")
    return changes.latest(log, "user_id").select("user_id", "event_id", "event_type", "value")


@_register("SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n = 1")
def latest_turn(spark, sf_dir):
    c = _t(spark, sf_dir, "conversations")
    return c.groupBy("conv_id").agg(F.max_by(F.struct("turn", "role"), "turn").alias("x")).select("conv_id", "x.turn", "x.role")


# Sorts and pages


@_register("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 25")
def top_values(spark, sf_dir):
    return keyed.top(_t(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", "c_custkey", 25)


@_register("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal, c_custkey LIMIT 10 OFFSET 30")
def sort_limit_offset(spark, sf_dir):
    return query(_t(spark, sf_dir, "customer")).sort_by("c_acctbal").sort_by("c_custkey").offset(30).limit(10).select("c_custkey", "c_acctbal").run()


@_register("SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey)::INT AS position FROM orders QUALIFY position <= 100")
def sort_by_value_desc(spark, sf_dir):
    rows = keyed.top(_t(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey", 100)
    return rows.withColumn("position", F.row_number().over(Window.orderBy(F.desc("o_totalprice"), "o_orderkey")))


_PAGE = "SELECT o_orderkey, o_custkey, true AS has_more, concat(lower(hex('{k}')), '|', sha256('{k}')) AS next_cursor FROM orders WHERE {w} ORDER BY o_orderkey LIMIT 20"


@_register(_PAGE.format(k="19", w="true"))
def page_first(spark, sf_dir):
    return keyed.page(_t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", 20)


@_register(_PAGE.format(k="39", w="o_orderkey > 19"))
def page_after_cursor(spark, sf_dir):
    orders = _t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    after = keyed.page(orders, "o_orderkey", 20).first()["next_cursor"]
    return keyed.page(orders, "o_orderkey", 20, after=int(keyed.read_cursor(after)))


@_register("SELECT r_regionkey, r_name, false AS has_more, NULL::VARCHAR AS next_cursor FROM region WHERE r_regionkey > 1 ORDER BY r_regionkey LIMIT 9 OFFSET 1")
def page_last(spark, sf_dir):
    return keyed.page(_t(spark, sf_dir, "region"), "r_regionkey", 9, after=1, offset=1)


@_register(
    "SELECT *, ((row_number() OVER (ORDER BY event_id) - 1) // 100)::BIGINT AS chunk, (((row_number() OVER (ORDER BY event_id) - 1) // 100) + 1) * 100 < count(*) OVER () AS has_more FROM events"
)
def chunked_results(spark, sf_dir):
    return feed.chunked(_t(spark, sf_dir, "events"), "event_id", 100)


# Unsigned arithmetic and circuits

_BITS = {"u8": 8, "u16": 16, "u32": 32, "u64": 64}


def _arithmetic(kind: str) -> None:
    bits = _BITS[kind]
    # operands spread over the whole width
    a_sql, b_sql = f"((l_partkey::UHUGEINT * {0x9E3779B97F4A7C15}::UHUGEINT) % {1 << bits}::UHUGEINT)", f"((l_suppkey::UHUGEINT * {0xC2B2AE3D27D4EB4F}::UHUGEINT + l_linenumber::UHUGEINT) % {1 << bits}::UHUGEINT)"
    m = f"{1 << bits}::UHUGEINT"

    def run(spark, sf_dir):
        key = {c: Load(c, "word") for c in ("l_partkey", "l_suppkey", "l_linenumber")}
        a, b = key["l_partkey"] * 0x9E3779B97F4A7C15, key["l_suppkey"] * 0xC2B2AE3D27D4EB4F + key["l_linenumber"]
        held = "word" if kind == "u64" else kind  # 16 bytes a row to tell apart, no decimals
        li = _t(spark, sf_dir, "lineitem").select(*[F.col(c).cast("bigint").alias(c) for c in key])
        li = li.select(unsigned.low_bits(compile_to_column(a), held).alias("a"), unsigned.low_bits(compile_to_column(b), held).alias("b"))
        x, y = Load("a", held), Load("b", held)
        values = {"a": x, "b": y, "sum": x + y, "difference": x - y, "product": x * y, "negated": -x}
        compared = {"less": x.compare("lt", y), "not_less": x.compare("ge", y)}
        done = li.distinct().select(*[compile_to_column(e).alias(n) for n, e in (values | compared).items()])
        text = unsigned.text if held == "word" else lambda v: v.cast("string")
        return done.select(*[text(F.col(n)).alias(n) for n in values], *compared)

    run.__name__ = f"{kind}_arithmetic"
    _register(
        f"SELECT a::VARCHAR AS a, b::VARCHAR AS b, ((a + b) % {m})::VARCHAR AS sum, ((a + {m} - b) % {m})::VARCHAR AS difference, "
        + (f"((a * b) % {m})::VARCHAR" if bits < 64 else f"(((((a // 4294967296::UHUGEINT) * b) % 4294967296::UHUGEINT) * 4294967296::UHUGEINT + (a % 4294967296::UHUGEINT) * b) % {m})::VARCHAR")
        + f" AS product, (({m} - a) % {m})::VARCHAR AS negated, a < b AS less, a >= b AS not_less FROM (SELECT DISTINCT {a_sql} AS a, {b_sql} AS b FROM lineitem)"
    )(run)


for _kind in _BITS:
    _arithmetic(_kind)


@_register("SELECT doc_id, (quality = 1) AND (toxic = 1) AS both, (quality = 1) OR (toxic = 1) AS either, (quality = 1) <> (toxic = 1) AS one, NOT (toxic = 1) AS clean FROM labels")
def boolean_circuits(spark, sf_dir):
    labels = _t(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("q"), (F.col("toxic") == 1).alias("t"))
    q, t = Load("q", "bool"), Load("t", "bool")
    return labels.select("doc_id", *[compile_to_column(e).alias(n) for n, e in {"both": q & t, "either": q | t, "one": q ^ t, "clean": ~t}.items()])


@_register("SELECT p_partkey, ((p_size * 30 + (p_partkey % 50) * 20 + p_size) % 256)::INT AS risk FROM part")
def circuit_risk(spark, sf_dir):
    """A weighted sum in 8 bits, which wraps."""
    part = _t(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("smallint").alias("x"), (F.col("p_partkey") % 50).cast("smallint").alias("y"))
    x, y = Load("x", "u8"), Load("y", "u8")
    return part.select("p_partkey", compile_to_column(x * 30 + y * 20 + x).cast("int").alias("risk"))


@_register("SELECT s_suppkey, (((s_suppkey % 100 - (s_nationkey * 2)) % 256 + 256) % 256)::INT AS score FROM supplier")
def circuit_sustainability(spark, sf_dir):
    s = _t(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_suppkey") % 100).cast("smallint").alias("reliability"), F.col("s_nationkey").cast("smallint").alias("co2"))
    return s.select("s_suppkey", compile_to_column(Load("reliability", "u8") - Load("co2", "u8") * 2).cast("int").alias("score"))


@_register("SELECT p_partkey, 0::INT AS nothing, p_size::INT AS same, ((p_size + 5) % 256)::INT AS shifted FROM part")
def circuit_simplified(spark, sf_dir):
    """Identities that Spark may not use go before the column is built."""
    part = _t(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("smallint").alias("x"))
    x, zero = Load("x", "u8"), Constant(0, "u8")
    values = {"nothing": x - x, "same": -(-(x - zero)) + x * zero, "shifted": x + (Constant(250, "u8") + Constant(11, "u8"))}
    return part.select("p_partkey", *[compile_to_column(simplify(e)).cast("int").alias(n) for n, e in values.items()])


@_register(
    """WITH o AS (SELECT o_custkey, count(*) AS n, sum(o_totalprice::DECIMAL(18,2)) AS total, max(o_totalprice) AS largest, bool_or(o_orderstatus = 'P') AS pending,
      sum(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END) AS urgent FROM orders GROUP BY o_custkey),
    f AS (SELECT c_custkey, coalesce(n, 0)::BIGINT AS n, coalesce(floor(total::DOUBLE / n), 0)::BIGINT AS average, coalesce(largest, 0) AS largest, coalesce(pending, false) AS pending,
      coalesce(urgent, 0)::BIGINT AS urgent, c_acctbal FROM customer LEFT JOIN o ON c_custkey = o_custkey)
    SELECT c_custkey, n AS orders, average, largest, pending, urgent,
      greatest(300, least(850, 300 + CASE WHEN average >= 250000 THEN 250 WHEN average >= 150000 THEN 180 WHEN average >= 50000 THEN 100 ELSE 0 END
        + least(n * 10, 150) + CASE WHEN c_acctbal > 0 THEN 100 ELSE 0 END - urgent * 15 - CASE WHEN pending THEN 20 ELSE 0 END))::BIGINT AS score FROM f"""
)
def credit_score(spark, sf_dir):
    """Per customer: integer average, maximum, sums by condition, any; then tiers and a clamped score."""
    orders = _t(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("total"), F.max("o_totalprice").alias("largest"),
        F.bool_or(F.col("o_orderstatus") == "P").alias("pending"), F.sum(F.when(F.col("o_orderpriority") == "1-URGENT", 1).otherwise(0)).alias("urgent"),
    )
    zero = F.lit(0).cast("bigint")
    f = _t(spark, sf_dir, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left").select(
        "c_custkey", "c_acctbal", F.coalesce("n", zero).alias("orders"), F.coalesce(F.floor(F.col("total") / F.col("n")).cast("bigint"), zero).alias("average"),
        F.coalesce("largest", F.lit(0.0)).alias("largest"), F.coalesce("pending", F.lit(False)).alias("pending"), F.coalesce("urgent", zero).alias("urgent"),
    )
    tier = F.when(F.col("average") >= 250_000, 250).when(F.col("average") >= 150_000, 180).when(F.col("average") >= 50_000, 100).otherwise(0)
    score = 300 + tier + F.least(F.col("orders") * 10, F.lit(150)) + F.when(F.col("c_acctbal") > 0, 100).otherwise(0) - F.col("urgent") * 15 - F.when(F.col("pending"), 20).otherwise(0)
    return f.select("c_custkey", "orders", "average", "largest", "pending", "urgent", F.greatest(F.lit(300), F.least(F.lit(850), score)).cast("bigint").alias("score"))


@_register("SELECT s_suppkey, c_custkey, s_acctbal > 0 AND c_acctbal > 0 AS both_solvent FROM supplier JOIN customer ON s_suppkey = c_custkey")
def cross_party(spark, sf_dir):
    """Two parties' collections by a common id, then a circuit over both."""
    s = _t(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_acctbal") > 0).alias("a"))
    c = _t(spark, sf_dir, "customer").select("c_custkey", (F.col("c_acctbal") > 0).alias("b"))
    return s.join(c, F.col("s_suppkey") == F.col("c_custkey")).select("s_suppkey", "c_custkey", compile_to_column(Load("a", "bool") & Load("b", "bool")).alias("both_solvent"))


@_register("SELECT s_suppkey, 'Supplier:' || s_suppkey AS entity, s_nationkey::VARCHAR AS nation, s_acctbal::VARCHAR IS NOT NULL AS has_balance FROM supplier")
def attributes_to_columns(spark, sf_dir):
    """One key a field, `supplier:{id}:{field}`, back to one row an entity."""
    s = _t(spark, sf_dir, "supplier")
    fields = F.array(F.struct(F.lit("nation").alias("f"), F.col("s_nationkey").cast("string").alias("v")), F.struct(F.lit("balance").alias("f"), F.col("s_acctbal").cast("string").alias("v")))
    eav = s.select("s_suppkey", F.inline(fields)).select(F.concat_ws(":", F.lit("supplier"), F.col("s_suppkey").cast("string"), "f").alias("key"), F.col("v").alias("value"))
    parts = F.split("key", ":")
    wide = eav.select(parts[1].cast("bigint").alias("s_suppkey"), parts[2].alias("f"), "value").groupBy("s_suppkey").pivot("f", ["nation", "balance"]).agg(F.first("value"))
    return wide.select("s_suppkey", F.concat(F.lit("Supplier:"), F.col("s_suppkey").cast("string")).alias("entity"), "nation", F.col("balance").isNotNull().alias("has_balance"))


# Writes


@_register("SELECT s_suppkey, s_name, CASE WHEN s_acctbal < 0 THEN -1 ELSE s_nationkey END::INT AS s_nationkey, s_acctbal FROM supplier")
def update_set(spark, sf_dir):
    return changes.update_where(_t(spark, sf_dir, "supplier"), F.col("s_acctbal") < 0, {"s_nationkey": F.lit(-1)})


@_register("SELECT p_partkey, CASE WHEN p_size > 40 THEN (p_size + 220) % 256 ELSE p_size END::INT AS p_size FROM part")
def update_add(spark, sf_dir):
    part = _t(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("smallint").alias("p_size"))
    return changes.update_where(part, F.col("p_size") > 40, {"p_size": unsigned.add(F.col("p_size"), F.lit(220), "u8")}).select("p_partkey", F.col("p_size").cast("int").alias("p_size"))


@_register("SELECT p_partkey, CASE WHEN p_size > 40 THEN (p_size * 7) % 256 ELSE p_size END::INT AS p_size FROM part")
def update_mul(spark, sf_dir):
    part = _t(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("smallint").alias("p_size"))
    return changes.update_where(part, F.col("p_size") > 40, {"p_size": unsigned.mul(F.col("p_size"), F.lit(7), "u8")}).select("p_partkey", F.col("p_size").cast("int").alias("p_size"))


@_register("SELECT count(*) FILTER (WHERE l_quantity > 30)::BIGINT AS affected_rows FROM lineitem")
def update_affected(spark, sf_dir):
    return changes.affected_rows(_t(spark, sf_dir, "lineitem"), F.col("l_quantity") > 30)


def _byte_sql(op: str, fill: int) -> str:
    operand = [10, 2, 255, 7]
    fixed = "[" + ", ".join(map(str, operand)) + "]"
    return f"""SELECT n_nationkey, array_to_string(list_transform(range(0, greatest(strlen(n_name), {len(operand)})), lambda i: printf('%02X',
      ((CASE WHEN i < strlen(n_name) THEN ('0x' || substr(hex(n_name), (2 * i + 1)::INT, 2))::INT ELSE {fill} END) {op}
       (CASE WHEN i < {len(operand)} THEN {fixed}[(i + 1)::INT] ELSE {fill} END)) % 256)), '') AS value FROM nation"""


@_register(_byte_sql("+", 0))
def blob_add(spark, sf_dir):
    return _t(spark, sf_dir, "nation").select("n_nationkey", F.hex(blobs.add_bytes(F.col("n_name").cast("binary"), bytes([10, 2, 255, 7]))).alias("value"))


@_register(_byte_sql("*", 1))
def blob_mul(spark, sf_dir):
    return _t(spark, sf_dir, "nation").select("n_nationkey", F.hex(blobs.mul_bytes(F.col("n_name").cast("binary"), bytes([10, 2, 255, 7]))).alias("value"))


@_register("SELECT c_custkey, CASE WHEN c_custkey < 20 THEN 'new' ELSE c_mktsegment END AS c_mktsegment FROM customer UNION ALL SELECT 1000000000::BIGINT, 'new'")
def upsert(spark, sf_dir):
    customer = _t(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    new = customer.where("c_custkey < 20").select("c_custkey").unionByName(spark.range(10**9, 10**9 + 1).toDF("c_custkey")).withColumn("c_mktsegment", F.lit("new"))
    return changes.upsert(customer, new, "c_custkey")


@_register("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def delete_keys(spark, sf_dir):
    gone = _t(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return changes.delete(_t(spark, sf_dir, "customer").select("c_custkey", "c_name"), gone, "c_custkey")


@_register("SELECT user_id, event_id AS seq, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n = 1 AND event_type <> 'error'")
def log_with_tombstones(spark, sf_dir):
    """Events as an operation log: an error deletes its user, anything else puts it."""
    e = _t(spark, sf_dir, "events")
    log = e.select("user_id", F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", "delete").otherwise("put").alias("op"), F.struct("event_id", "event_type").alias("value"))
    return changes.latest(log, "user_id").select("user_id", F.col("value.event_id").alias("seq"), "value.event_type")


@_register("SELECT r_regionkey, CASE WHEN r_regionkey = 2 THEN 'changed' ELSE r_name END AS r_name FROM region WHERE r_regionkey <> 3 UNION ALL SELECT 9, 'new'")
def transaction_commit(spark, sf_dir):
    region = _t(spark, sf_dir, "region")
    with changes.Transaction(region, "r_regionkey") as t:
        t.set(spark.createDataFrame([(9, "new")], "r_regionkey int, r_name string"))
        t.update(F.col("r_regionkey") == 2, {"r_name": F.lit("changed")})
        t.delete(3)
        return t.commit()


@_register("SELECT r_regionkey, 'seen' AS r_name FROM region WHERE r_regionkey = 1")
def transaction_reads_own_writes(spark, sf_dir):
    t = changes.Transaction(_t(spark, sf_dir, "region"), "r_regionkey")
    t.update(F.lit(True), {"r_name": F.lit("seen")})
    return t.get(1)


@_register("SELECT * FROM region")
def batch_rollback(spark, sf_dir):
    """The second operation fails, so nothing happens."""
    region = _t(spark, sf_dir, "region")
    try:
        return changes.apply_batch(region, [lambda df: df.where("r_regionkey > 1"), lambda df: df.select("no such column")])
    except RuntimeError:
        return region


@_register("SELECT n_nationkey, CASE WHEN n_nationkey < 3 THEN n_name || '!' ELSE n_name END AS n_name FROM nation UNION ALL SELECT 99, '!'")
def read_modify_write(spark, sf_dir):
    nation = _t(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    keys = spark.createDataFrame([(0,), (1,), (2,), (99,)], "n_nationkey int")
    return changes.read_modify_write(nation, keys, "n_nationkey", "n_name", lambda old: F.concat(F.coalesce(old, F.lit("")), F.lit("!")))


# Indexes


@_register("SELECT p_partkey, p_name, p_brand FROM part WHERE p_brand = 'Brand#17'")
def index_lookup(spark, sf_dir):
    part = _t(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand")
    return indexes.lookup(indexes.build(part, "p_brand", "p_partkey"), part, "p_partkey", "Brand#17")


@_register("SELECT p_partkey, p_name, p_size FROM part WHERE p_size >= 10 AND p_size < 13")
def index_range(spark, sf_dir):
    part = _t(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    return indexes.lookup_range(indexes.build(part, "p_size", "p_partkey"), part, "p_partkey", 10, 13)


@_register("SELECT p_name AS indexed_value, count(*)::BIGINT AS keys FROM part GROUP BY p_name HAVING count(*) > 1")
def index_violations(spark, sf_dir):
    return indexes.violations(indexes.build(_t(spark, sf_dir, "part"), "p_name", "p_partkey"))


@_register("SELECT count(*)::BIGINT AS entries, count(DISTINCT p_brand)::BIGINT AS distinct_values FROM part")
def index_stats(spark, sf_dir):
    return indexes.stats(indexes.build(_t(spark, sf_dir, "part"), "p_brand", "p_partkey"))


@_register("SELECT CASE WHEN p_size > 40 THEN 'big' ELSE p_brand END AS indexed_value, p_partkey AS primary_key FROM part")
def index_maintained(spark, sf_dir):
    part = _t(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size")
    old = part.where("p_size > 40")
    return indexes.maintain(indexes.build(part, "p_brand", "p_partkey"), old, old.withColumn("p_brand", F.lit("big")), "p_brand", "p_partkey")


# Snapshots


def _snapshots(spark, sf_dir):
    """Customers, and the same with some changed, removed and added."""
    old = _t(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    new = old.where("c_custkey % 10 <> 3").withColumn("c_mktsegment", F.when(F.col("c_custkey") % 10 == 5, "CHANGED").otherwise(F.col("c_mktsegment")))
    return old, new.unionByName(spark.range(10**9, 10**9 + 7).select(F.col("id").alias("c_custkey"), F.lit("ADDED").alias("c_mktsegment")))


_DIFF = """(SELECT c_custkey, CASE WHEN c_custkey % 10 = 3 THEN 'removed' ELSE 'modified' END AS change, c_mktsegment AS old_value,
  CASE WHEN c_custkey % 10 = 5 THEN 'CHANGED' END AS new_value FROM customer WHERE c_custkey % 10 IN (3, 5)
  UNION ALL SELECT 1000000000 + i, 'added', NULL, 'ADDED' FROM range(7) t(i))"""


@_register(f"SELECT * FROM {_DIFF}")
def snapshot_diff(spark, sf_dir):
    return snapshots.diff(*_snapshots(spark, sf_dir), "c_custkey", "c_mktsegment")


@_register(f"SELECT count(*) FILTER (WHERE change = 'added') AS added, count(*) FILTER (WHERE change = 'removed') AS removed, count(*) FILTER (WHERE change = 'modified') AS modified FROM {_DIFF}")
def diff_stats(spark, sf_dir):
    return snapshots.diff_stats(snapshot_diff(spark, sf_dir))


@_register("SELECT 1000000000 + i AS c_custkey, 'ADDED' AS c_mktsegment FROM range(7) t(i)")
def diff_added(spark, sf_dir):
    return snapshots.added(*_snapshots(spark, sf_dir), "c_custkey")


@_register("SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey % 10 = 3")
def diff_removed(spark, sf_dir):
    return snapshots.removed(*_snapshots(spark, sf_dir), "c_custkey")


@_register("SELECT c_custkey, CASE WHEN c_custkey % 10 = 5 THEN 'CHANGED' ELSE c_mktsegment END AS c_mktsegment FROM customer WHERE c_custkey % 10 <> 3 UNION ALL SELECT 1000000000 + i, 'ADDED' FROM range(7) t(i)")
def incremental_backup(spark, sf_dir):
    """A full copy and an increment give the new snapshot."""
    old, new = _snapshots(spark, sf_dir)
    return snapshots.apply_increment(old, snapshots.increment(old, new, "c_custkey"), "c_custkey")


# Merges and shards


def _parts(spark, sf_dir):
    li = _t(spark, sf_dir, "lineitem").select("l_partkey", "l_returnflag")
    return [li.where(F.col("l_returnflag") == f) for f in "ANR"]


@_register("SELECT l_partkey, l_returnflag FROM lineitem WHERE l_returnflag IN ('A', 'N', 'R')")
def merge_all(spark, sf_dir):
    return shards.merge(*_parts(spark, sf_dir))


@_register("SELECT DISTINCT l_partkey FROM lineitem WHERE l_returnflag IN ('A', 'N', 'R')")
def merge_distinct(spark, sf_dir):
    return shards.merge_distinct(*[p.select("l_partkey") for p in _parts(spark, sf_dir)])


@_register("SELECT l_partkey, l_returnflag, position(l_returnflag IN 'ANR')::INT - 1 AS shard FROM lineitem WHERE l_returnflag IN ('A', 'N', 'R')")
def merge_sorted(spark, sf_dir):
    return shards.merge_sorted(*_parts(spark, sf_dir), by="l_partkey")


@_register("SELECT p_partkey FROM part EXCEPT SELECT l_partkey FROM lineitem")
def except_keys(spark, sf_dir):
    return _t(spark, sf_dir, "part").select("p_partkey").subtract(_t(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey")))


@_register("SELECT c_custkey FROM customer INTERSECT SELECT o_custkey FROM orders")
def intersect_keys(spark, sf_dir):
    return _t(spark, sf_dir, "customer").select("c_custkey").intersect(_t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")))


_SHARDS = [(1, 0, 400, 100, 4000), (2, 400, 900, 101, 5100), (3, 900, 1200, 100, 0), (4, 1250, 1 << 60, 102, 77)]
_SHARDS_SQL = "(VALUES " + ", ".join(str(s) for s in _SHARDS) + ") s(shard_id, start_key, end_key, node, bytes)"


def _shards(spark):
    return spark.createDataFrame(_SHARDS, "shard_id int, start_key long, end_key long, node int, bytes long")


@_register(f"SELECT o_orderkey, shard_id, node FROM orders JOIN {_SHARDS_SQL} ON o_orderkey >= start_key AND o_orderkey < end_key")
def shard_route(spark, sf_dir):
    return shards.route(_t(spark, sf_dir, "orders"), _shards(spark), "o_orderkey").select("o_orderkey", "shard_id", "node")


@_register(f"SELECT shard_id, node FROM {_SHARDS_SQL} WHERE start_key < 1000 AND 300 < end_key")
def range_shards(spark, sf_dir):
    return shards.overlapping(_shards(spark), 300, 1000).select("shard_id", "node")


@_register(f"SELECT shard_id, coalesce(lead(start_key) OVER (ORDER BY start_key) = end_key, false) AS mergeable FROM {_SHARDS_SQL}")
def shards_adjacent(spark, sf_dir):
    return shards.adjacent(_shards(spark)).select("shard_id", "mergeable")


@_register(
    f"""WITH k AS (SELECT shard_id, any_value(node) AS node, any_value(bytes)::BIGINT AS bytes, count(o_orderkey)::BIGINT AS key_count FROM {_SHARDS_SQL} LEFT JOIN orders ON o_orderkey >= start_key AND o_orderkey < end_key GROUP BY shard_id)
    SELECT count(*)::BIGINT AS shards, count(DISTINCT node)::BIGINT AS nodes, sum(key_count)::BIGINT AS total_keys, sum(bytes)::BIGINT AS total_bytes, (sum(key_count) // count(*))::BIGINT AS average_keys, (sum(bytes) // count(*))::BIGINT AS average_bytes FROM k"""
)
def shard_stats(spark, sf_dir):
    counts = shard_route(spark, sf_dir).groupBy("shard_id").agg(F.count(F.lit(1)).alias("key_count"))
    return shards.stats(_shards(spark).join(counts, "shard_id", "left").withColumn("key_count", F.coalesce("key_count", F.lit(0))))


@_register("WITH f AS (SELECT o_custkey // 100 AS f, min(o_orderkey) AS low, max(o_orderkey) AS high FROM orders GROUP BY 1) SELECT a.f AS left_f, b.f AS right_f FROM f a JOIN f b ON a.low <= b.high AND b.low <= a.high WHERE a.f < 3")
def overlap_pairs(spark, sf_dir):
    f = _t(spark, sf_dir, "orders").groupBy(F.floor(F.col("o_custkey") / 100).alias("f")).agg(F.min("o_orderkey").alias("low"), F.max("o_orderkey").alias("high"))
    return shards.overlap_pairs(f.where("f < 3"), f).select("left_f", "right_f")


@_register(
    """WITH a AS (SELECT o_orderkey // 70 AS f, min(o_orderkey) AS low, max(o_orderkey) AS high FROM orders GROUP BY 1),
    b AS (SELECT (o_orderkey + 40) // 250 AS f, min(o_orderkey) AS low, max(o_orderkey) AS high FROM orders GROUP BY 1)
    SELECT a.f AS left_f, b.f AS right_f FROM a JOIN b ON a.low <= b.high AND b.low <= a.high"""
)
def overlap_pairs_of_levels(spark, sf_dir):
    """All files of two levels, key blocks of differing widths."""
    orders, key = _t(spark, sf_dir, "orders"), F.col("o_orderkey")
    level = lambda f: orders.groupBy(F.floor(f).alias("f")).agg(F.min(key).alias("low"), F.max(key).alias("high"))
    return shards.overlap_pairs(level(key / 70), level((key + 40) / 250)).select("left_f", "right_f")


_HASH = "('0x' || substr(md5(%s), 1, 8))::BIGINT"


@_register(f"SELECT ({_HASH % 'o_orderkey::VARCHAR'} % 8)::INT AS shard, count(*) AS keys FROM orders GROUP BY 1")
def hash_shards(spark, sf_dir):
    return _t(spark, sf_dir, "orders").groupBy(shards.hash_shard(F.col("o_orderkey"), 8).alias("shard")).agg(F.count(F.lit(1)).alias("keys"))


@_register(
    f"""WITH ring AS (SELECT {_HASH % "n || '#' || v::VARCHAR"} AS point, n AS node FROM (VALUES ('n1'), ('n2'), ('n3')) t(n), range(100) r(v)),
    placed AS (SELECT o_orderkey, {_HASH % "o_orderkey::VARCHAR"} AS place FROM orders),
    ends AS (SELECT point, min(node) AS node FROM ring GROUP BY point UNION ALL SELECT 4294967296, (SELECT min(node) FROM ring WHERE point = (SELECT min(point) FROM ring)))
    SELECT node, count(*) AS keys FROM placed ASOF JOIN ends ON place <= point GROUP BY node"""
)
def ring_shards(spark, sf_dir):
    return shards.ring_shard(_t(spark, sf_dir, "orders"), "o_orderkey", ["n1", "n2", "n3"]).groupBy("node").agg(F.count(F.lit(1)).alias("keys"))


# Aggregates


@_register("SELECT count(*)::BIGINT AS count FROM lineitem")
def count_all(spark, sf_dir):
    return aggregates.count(_t(spark, sf_dir, "lineitem"))


@_register("SELECT count(*)::BIGINT AS count FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 900")
def count_range(spark, sf_dir):
    return aggregates.count(_t(spark, sf_dir, "orders").where("o_orderkey >= 100 AND o_orderkey < 900"))


@_register("SELECT count(*)::BIGINT AS key_count, sum(strlen(text))::BIGINT AS total_bytes, count(*) > 500 AS truncated FROM documents")
def collection_stats(spark, sf_dir):
    return aggregates.stats(_t(spark, sf_dir, "documents"), "text", 500)


@_register("SELECT count(*)::BIGINT AS checked, count(*) FILTER (WHERE doc_id % 7 = 0)::BIGINT AS corrupt FROM documents")
def verify_checksums(spark, sf_dir):
    """Checksums of all values, every seventh one spoilt."""
    d = _t(spark, sf_dir, "documents").select(F.col("text").cast("binary").alias("value"), (F.crc32(F.col("text").cast("binary")) + (F.col("doc_id") % 7 == 0).cast("int")).alias("checksum"))
    return aggregates.verify(d, "value", "checksum")


_BOUNDS = [10.0, 25.0, 50.0, 100.0, 250.0, 500.0, 1000.0]


@_register("SELECT bound::DOUBLE AS bound, count(value) FILTER (WHERE value <= bound)::BIGINT AS cumulative FROM events, (SELECT unnest([10, 25, 50, 100, 250, 500, 1000]) AS bound) GROUP BY bound")
def value_histogram(spark, sf_dir):
    return aggregates.histogram(_t(spark, sf_dir, "events"), "value", _BOUNDS)


@_register(
    """WITH b AS (SELECT i, bound, coalesce(lag(bound) OVER (ORDER BY i), 0) AS low, count(value) FILTER (WHERE value <= bound) AS c, count(value) AS n
      FROM events, (SELECT unnest(range(7)) AS i, unnest([10.0, 25, 50, 100, 250, 500, 1000]::DOUBLE[]) AS bound) GROUP BY i, bound),
    p AS (SELECT *, coalesce(lag(c) OVER (ORDER BY i), 0) AS before FROM b)
    SELECT coalesce((SELECT round(low + (bound - low) * (n * 0.9::DOUBLE - before) / (c - before), 6) FROM p WHERE c >= n * 0.9::DOUBLE ORDER BY i LIMIT 1), 1000.0) AS percentile"""
)
def value_percentile(spark, sf_dir):
    return aggregates.percentile(_t(spark, sf_dir, "events"), "value", _BOUNDS, 90)


@_register("SELECT user_id, count(*)::BIGINT AS n, max(value) AS largest, min(value) AS smallest, sum(value::DECIMAL(18,2)) AS total, count(*) FILTER (WHERE event_type = 'error')::BIGINT AS errors, bool_or(value > 100) AS any_large FROM events GROUP BY user_id")
def per_key_aggregates(spark, sf_dir):
    return _t(spark, sf_dir, "events").groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n"), F.max("value").alias("largest"), F.min("value").alias("smallest"), F.sum(F.col("value").cast("decimal(18,2)")).cast("decimal(38,2)").alias("total"),
        F.sum((F.col("event_type") == "error").cast("bigint")).alias("errors"), F.bool_or(F.col("value") > 100).alias("any_large"),
    )


def _leaf():
    return F.concat_ws("|", F.col("o_orderkey").cast("string"), "o_orderstatus")


_MERKLE_SQL = """WITH RECURSIVE leaf AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS i, sha256('\\x00'::BLOB || encode(o_orderkey::VARCHAR || '|' || o_orderstatus)) AS h FROM orders),
    up(level, i, h, n) AS (SELECT 0, i, h, (SELECT count(*) FROM leaf) FROM leaf
    UNION ALL SELECT any_value(level) + 1, i // 2, sha256('\\x01'::BLOB || unhex(min_by(h, i)) || unhex(max_by(h, i))), (any_value(n) + 1) // 2 FROM up WHERE n > 1 GROUP BY i // 2)"""


@_register(_MERKLE_SQL + " SELECT h AS root FROM up WHERE n = 1")
def merkle_root(spark, sf_dir):
    return spark.createDataFrame([(merkle.root(_t(spark, sf_dir, "orders"), "o_orderkey", _leaf()),)], "root string")


@_register(_MERKLE_SQL + " SELECT level, h AS sibling FROM up WHERE n > 1 AND i = least(xor(700 >> level, 1), n - 1)")
def merkle_proof(spark, sf_dir):
    """What proves that the order in place 700 is in the tree."""
    p = merkle.proof(_t(spark, sf_dir, "orders"), "o_orderkey", _leaf(), 700)
    return spark.createDataFrame(list(enumerate(p.siblings)), "level int, sibling string")


# Text formats and feeds


@_register("SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'BASE64:' || to_base64(encode(s_name || 'é')) ELSE s_name END AS shown FROM supplier")
def output_sentinel(spark, sf_dir):
    """Text as it is, other bytes in base64."""
    value = F.when(F.col("s_suppkey") % 3 == 0, F.concat("s_name", F.lit("é"))).otherwise(F.col("s_name")).cast("binary")
    return _t(spark, sf_dir, "supplier").select("s_suppkey", files.as_text(value).alias("shown"))


@_register("SELECT count(*)::BIGINT AS total, count(*) FILTER (WHERE c_custkey % 5 <> 0)::BIGINT AS succeeded, count(*) FILTER (WHERE c_custkey % 5 = 0)::BIGINT AS failed FROM customer WHERE c_custkey % 7 <> 0")
def batch_file_counts(spark, sf_dir):
    k = F.col("c_custkey")
    line = F.when(k % 7 == 0, F.concat(F.lit("# put "), "c_name")).when(k % 5 == 0, F.concat(F.lit("drop "), "c_name")).when(k % 2 == 0, F.concat(F.lit("delete "), "c_name"))
    lines = _t(spark, sf_dir, "customer").select(line.otherwise(F.concat(F.lit("put "), "c_name", F.lit("  a value"))).alias("value"))
    return files.batch_counts(files.parse_batch(lines))


@_register("SELECT o_orderkey, concat(lower(hex(o_orderkey::VARCHAR)), '|', sha256(o_orderkey::VARCHAR)) AS cursor FROM orders WHERE o_orderkey < 50")
def cursors(spark, sf_dir):
    return _t(spark, sf_dir, "orders").where("o_orderkey < 50").select("o_orderkey", keyed.cursor(F.col("o_orderkey")).alias("cursor"))


@_register("SELECT o_orderkey, concat(lower(hex(o_orderkey::VARCHAR)), '|', sha256(o_orderkey::VARCHAR)) AS cursor FROM orders")
def cursors_of_all(spark, sf_dir):
    return _t(spark, sf_dir, "orders").select("o_orderkey", keyed.cursor(F.col("o_orderkey")).alias("cursor"))


@_register("SELECT event_id, user_id, event_type FROM events WHERE user_id::VARCHAR LIKE '1%'")
def change_feed(spark, sf_dir):
    """The events of matching users as a stream over all there is now."""
    at = shared.shared_dir(spark, "feed")
    stream = feed.change_feed(spark, f"{sf_dir}/events.parquet*", _t(spark, sf_dir, "events").schema, "user_id", "1*")
    return feed.drain(stream.select("event_id", "user_id", "event_type"), f"{at}/out", f"{at}/checkpoint")


@_register("SELECT o_orderkey, CASE WHEN o_orderstatus > 'F' THEN o_totalprice > 100000 ELSE false END AS result FROM orders")
def partial_logic(spark, sf_dir):
    """Sides evaluated one after the other."""
    p = (col("o_orderstatus") > "F") & (col("o_totalprice") > 100000.0)
    return _t(spark, sf_dir, "orders").select("o_orderkey", compile_predicate(p, left_first=True).alias("result"))


# What single rows of the inventory need besides


@_register("SELECT DISTINCT k FROM (SELECT c_custkey AS k FROM customer WHERE c_custkey < 900 UNION ALL SELECT o_custkey FROM orders UNION ALL SELECT c_custkey FROM customer WHERE c_custkey > 500)")
def merge_sorted_distinct(spark, sf_dir):
    """Sorted results of three shards as one, every key once."""
    keys = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    return shards.merge_sorted_distinct(keys.where("k < 900"), _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")), keys.where("k > 500"), by="k")


@_register("SELECT user_id, event_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS old FROM events) WHERE old IS DISTINCT FROM event_type")
def without_repeats(spark, sf_dir):
    """Every user's events that differ in type from the user's last one."""
    return shards.without_repeats(_t(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), "event_type", "event_id", "user_id")


@_register("SELECT * FROM (VALUES ('61', '63', '62'), ('6161', '6163', '6162'), ('00', 'ff', '7f'), ('61', '62', '62'), ('6100', '62ffff', '6180'), ('ff', 'ff', 'ff'), ('', '61', '')) t(start_key, end_key, middle)")
def key_midpoints(spark, sf_dir):
    rows = [("61", "63"), ("6161", "6163"), ("00", "ff"), ("61", "62"), ("6100", "62ffff"), ("ff", "ff"), ("", "61")]
    return spark.createDataFrame([(a, b, shards.midpoint(bytes.fromhex(a), bytes.fromhex(b)).hex()) for a, b in rows], "start_key string, end_key string, middle string")


@_register(f"SELECT shard_id, bytes > 4500 AS hot, bytes < 4500 AS cold FROM {_SHARDS_SQL}")
def shard_temperature(spark, sf_dir):
    return shards.temperature(_shards(spark).withColumn("key_count", F.lit(10)), 20, 4500).select("shard_id", "hot", "cold")


@_register(
    f"""SELECT shard_id, start_key, CASE shard_id WHEN 1 THEN 200 ELSE end_key END AS end_key, node, CASE shard_id WHEN 1 THEN 2000 ELSE bytes END AS bytes FROM {_SHARDS_SQL}
    UNION ALL SELECT 9, 200, 400, 100, 2000"""
)
def shard_split(spark, sf_dir):
    return shards.split(_shards(spark), 1, 200, 9)


@_register(f"SELECT shard_id, start_key, end_key, node, bytes FROM {_SHARDS_SQL}")
def shard_split_and_join(spark, sf_dir):
    return shards.join_shards(shards.split(_shards(spark), 1, 200, 9), 1, 9, 1)


@_register("SELECT p_partkey, p_name FROM part WHERE p_size > 20")
def plain_values_only(spark, sf_dir):
    """A filter without compute: an opaque value would be an error."""
    part = _t(spark, sf_dir, "part")
    return filter_typed(require_plain(part, "p_name"), col("p_size") > 20).select("p_partkey", "p_name")


@_register("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 1000 ORDER BY o_orderkey LIMIT 250")
def stream_max_results(spark, sf_dir):
    """The first rows of a stream, taken list by list."""
    rows = query(_t(spark, sf_dir, "orders")).where(col("o_totalprice") > 1000.0).select("o_orderkey", "o_totalprice").sort_by("o_orderkey").run()
    taken = [r for some in feed.iterate(rows, 64, 250) for r in some]
    return spark.createDataFrame(taken, "o_orderkey long, o_totalprice double")


@_register(
    """WITH ahead AS (SELECT o_orderkey, o_orderstatus FROM orders WHERE o_totalprice > 1000 AND o_orderkey > 700 ORDER BY o_orderkey LIMIT 26),
    found AS (SELECT *, row_number() OVER (ORDER BY o_orderkey) AS n, count(*) OVER () > 25 AS has_more FROM ahead), last AS (SELECT max(o_orderkey)::VARCHAR AS k FROM found WHERE n <= 25)
    SELECT o_orderkey, o_orderstatus, has_more, CASE WHEN has_more THEN lower(hex(encode(k))) || '|' || sha256(k) END AS next_cursor FROM found, last WHERE n <= 25"""
)
def page_of_builder(spark, sf_dir):
    """Predicate, columns, cursor and page size of the builder together."""
    orders = _t(spark, sf_dir, "orders")
    after = spark.range(1).select(keyed.cursor(F.lit(700))).first()[0]
    return query(orders).where(col("o_totalprice") > 1000.0).select("o_orderkey", "o_orderstatus").page_size(25).cursor(after).page("o_orderkey", "bigint")


@_register("SELECT * FROM nation")
def backup_and_restore(spark, sf_dir):
    at = shared.shared_dir(spark, "backup")
    snapshots.backup(_t(spark, sf_dir, "nation"), at)
    return snapshots.restore(spark, at)


@_register("SELECT 'a' AS name, (SELECT count(*) FROM nation) AS rows, true AS whole UNION ALL SELECT 'c', (SELECT count(*) FROM region), true")
def backup_list(spark, sf_dir):
    """Three backups of which one is deleted, with their rows, each verified."""
    at = shared.shared_dir(spark, "backups")
    for name, t in (("a", "nation"), ("b", "region"), ("c", "region")):
        snapshots.backup(_t(spark, sf_dir, t), f"{at}/{name}")
    snapshots.delete_backup(f"{at}/b")
    found = snapshots.backups(spark, at).collect()
    return spark.createDataFrame([(r["name"], r["rows"], snapshots.is_whole(spark, f"{at}/{r['name']}")) for r in found], "name string, rows long, whole boolean")


@_register("SELECT 'by_brand' AS name, 'p_brand' AS \"column\", false AS is_unique, count(*) AS entries, count(DISTINCT p_brand) AS distinct_values FROM part UNION ALL SELECT 'by_key', 'p_partkey', true, count(*), count(DISTINCT p_partkey) FROM part")
def named_indexes(spark, sf_dir):
    named = indexes.Indexes(_t(spark, sf_dir, "part"), "p_partkey")
    named.create("by_brand", "p_brand")
    named.create("by_key", "p_partkey", unique=True)
    named.create("by_size", "p_size")
    named.drop("by_size")
    return named.describe()


_DURATIONS = [(0, "0ns"), (999, "999ns"), (1_500, "1.50µs"), (2_500_000, "2.50ms"), (3_250_000_000, "3.25s"), (125_000_000_000, "2m 5s"), (5_400_000_000_000, "1h 30m"), (90_061_000_000_000, "25h 1m")]


@_register("SELECT nanos::BIGINT AS nanos, shown FROM (VALUES " + ", ".join(map(str, _DURATIONS)) + ") t(nanos, shown)")
def human_durations(spark, sf_dir):
    return spark.createDataFrame([(n,) for n, _ in _DURATIONS], "nanos long").withColumn("shown", blobs.human_duration(F.col("nanos")))


@_register("SELECT n_nationkey, hex(encode(n_name) || '\\x00'::BLOB || encode('BASE64:' || to_base64(encode('é' || n_name))) || '\\x00'::BLOB) AS record FROM nation")
def output_nul(spark, sf_dir):
    record = files.nul_record(F.col("n_name").cast("binary"), F.concat(F.lit("é"), "n_name").cast("binary"))
    return _t(spark, sf_dir, "nation").select("n_nationkey", F.hex(record.cast("binary")).alias("record"))


@_register("""SELECT '- r_regionkey: "' || r_regionkey || '"' || chr(10) || '  r_name: "' || r_name || '"' AS record FROM region""")
def output_yaml(spark, sf_dir):
    return _t(spark, sf_dir, "region").select(files.yaml_record("r_regionkey", "r_name").alias("record"))


@_register("SELECT '| ' || rpad(r_regionkey::VARCHAR, 4, ' ') || ' | ' || rpad(r_name, 12, ' ') || ' |' AS line FROM region")
def output_table(spark, sf_dir):
    return files.table_lines(_t(spark, sf_dir, "region"), {"r_regionkey": 4, "r_name": 12})


@_register("SELECT p_partkey::VARCHAR AS key, p_name AS value FROM part")
def ndjson_round_trip(spark, sf_dir):
    at = shared.shared_dir(spark, "ndjson")
    files.write_ndjson(_t(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("key"), F.col("p_name").alias("value")), at)
    return files.read_snapshot(spark, at)


@_register("SELECT n_nationkey, n_nationkey % 3 <> 0 AS opaque FROM nation")
def encrypted_guard(spark, sf_dir):
    """Values that begin with 0x01 or are JSON with a cipher_type."""
    n = F.col("n_nationkey") % 3
    value = F.when(n == 1, F.concat(F.lit(b"\x01"), F.col("n_name").cast("binary"))).when(n == 2, F.lit(b'{"cipher_type": "u8"}')).otherwise(F.col("n_name").cast("binary"))
    return _t(spark, sf_dir, "nation").select("n_nationkey", blobs.looks_encrypted(value).alias("opaque"))


@_register("SELECT * FROM (VALUES ('l_discount'), ('l_quantity'), ('l_tax')) t(name)")
def referenced_columns(spark, sf_dir):
    p = ((col("l_tax") > 0.01) | ~(col("l_quantity") < 3)) & (col("l_discount") == 0.05) & (col("l_tax") < 0.5)
    return spark.createDataFrame([(c,) for c in columns_of(p)], "name string")


@_register("SELECT * FROM (VALUES ('a * b + 3', 3, 2, 1), ('(a < b) and not (a = 3)', 4, 4, 2), ('a', 1, 0, 0)) t(circuit, depth, gates, bootstraps)")
def circuit_metrics(spark, sf_dir):
    """Depth, operations and expensive operations of circuits."""
    a, b, three = Load("a", "u8"), Load("b", "u8"), Constant(3, "u8")
    trees = {"a * b + 3": Binary("add", Binary("mul", a, b), three), "(a < b) and not (a = 3)": Binary("and", Binary("lt", a, b), Unary("not", Binary("eq", a, three))), "a": a}
    rows = [(text, *(measure(tree)[k] for k in ("depth", "gates", "bootstraps"))) for text, tree in trees.items()]
    return spark.createDataFrame(rows, "circuit string, depth int, gates int, bootstraps int")


@_register("SELECT count(*) AS rows, true AS same FROM orders")
def collection_checksum(spark, sf_dir):
    """One checksum for the rows of a collection however they are dealt and ordered."""
    orders = _t(spark, sf_dir, "orders")
    one, other = (aggregates.checksum(df, *orders.columns) for df in (orders, orders.repartition(7, "o_custkey").sortWithinPartitions("o_totalprice")))
    return one.join(other.toDF("rows_too", "checksum_too")).select("rows", ((F.col("checksum") == F.col("checksum_too")) & (F.col("rows") == F.col("rows_too"))).alias("same"))


@_register("SELECT user_id, max(event_id) AS event_id, max_by(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def log_apply(spark, sf_dir):
    """The events as a log that is applied batch by batch to a table of every user's last one."""
    at, events = shared.shared_dir(spark, "apply"), _t(spark, sf_dir, "events")
    log = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{sf_dir}/events.parquet*").select("user_id", "event_id", "event_type")
    states = [f"{at}/state-none"]

    def upsert(batch, number):
        last = batch.groupBy("user_id").agg(F.max_by(F.struct("event_id", "event_type"), "event_id").alias("x")).select("user_id", "x.*")
        if number:
            old = batch.sparkSession.read.parquet(states[-1])
            last = old.unionByName(last).groupBy("user_id").agg(F.max_by(F.struct("event_id", "event_type"), "event_id").alias("x")).select("user_id", "x.*")
        # a batch that is run again writes the same state again
        last.write.mode("overwrite").parquet(f"{at}/state-{number}")
        states.append(f"{at}/state-{number}")

    feed.apply_changes(log, f"{at}/checkpoint", upsert).awaitTermination()
    return spark.read.parquet(states[-1])
