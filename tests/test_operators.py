"""Edge cases of single operators, and invariants against plain Python."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from keystrata.functions import blobs, unsigned
from keystrata.operators import aggregates, changes, indexes, keyed, merkle, shards, snapshots
from keystrata.plans.circuit import Binary, Constant, Load, Unary, compile_to_column, measure, simplify, type_of
from keystrata.plans.predicate import col, columns_of, compile_predicate, filter_plain, query
from keystrata.queries import QUERIES
from keystrata.sources import files
from keystrata.streaming import feed

from .conftest import SMALL


def kv(spark, rows, schema="key string, value string"):
    return spark.createDataFrame(rows, schema)


def test_unsigned_edges(spark):
    rng = random.Random(1)
    for kind, (bits, spark_type) in unsigned.TYPES.items():
        top = (1 << bits) - 1
        pairs = [(0, 0), (top, top), (top, 1), (0, 1), (1, top)] + [(rng.randint(0, top), rng.randint(0, top)) for _ in range(40)]
        df = spark.createDataFrame([(str(a), str(b)) for a, b in pairs], "a string, b string").select(F.col("a").cast(spark_type), F.col("b").cast(spark_type))
        a, b = F.col("a"), F.col("b")
        for row in df.select("a", "b", unsigned.add(a, b, kind).alias("s"), unsigned.sub(a, b, kind).alias("d"), unsigned.mul(a, b, kind).alias("p"), unsigned.neg(a, kind).alias("n")).collect():
            x, y, m = int(row.a), int(row.b), 1 << bits
            assert (int(row.s), int(row.d), int(row.p), int(row.n)) == ((x + y) % m, (x - y) % m, x * y % m, -x % m)


def test_words(spark):
    """u64 as bigints of the same bits; the queries on lineitem hold no decimals."""
    rng, m = random.Random(2), 1 << 64
    some = [0, 1, 9, 10, (1 << 32) - 1, 1 << 32, (1 << 63) - 1, 1 << 63, m - 10, m - 1] + [rng.randint(0, m - 1) for _ in range(20)]
    pairs = [(a, b) for a in some for b in some]
    df = spark.createDataFrame([(str(a), str(b)) for a, b in pairs] + [(None, "1")], "a string, b string")
    df = df.select(*[unsigned.word(F.col(c).cast("decimal(38,0)")).alias(c) for c in "ab"])
    a, b = Load("a", "word"), Load("b", "word")
    numbers = {"a": a, "s": a + b, "d": a - b, "p": a * b, "n": -a, "c": a * (m - 3) + 5}
    compared = {op: compile_to_column(a.compare(op, b)).alias(op) for op in ("lt", "le", "gt", "ge", "eq", "ne")}
    columns = {k: compile_to_column(e) for k, e in numbers.items()}
    both = [F.struct(unsigned.text(v), unsigned.value(v).cast("string")).alias(k) for k, v in columns.items()]
    for ansi in ("true", "false"):
        spark.conf.set("spark.sql.ansi.enabled", ansi)
        try:
            rows = df.select(*both, *compared.values(), unsigned.low_bits(F.col("a"), "u16").alias("u16")).collect()
        finally:
            spark.conf.unset("spark.sql.ansi.enabled")
        for (x, y), row in zip(pairs, rows):
            assert [tuple(row[k]) for k in numbers] == [(str(n), str(n)) for n in (x, (x + y) % m, (x - y) % m, x * y % m, -x % m, (x * (m - 3) + 5) % m)]
            assert [row[k] for k in compared] == [x < y, x <= y, x > y, x >= y, x == y, x != y] and row.u16 == x % (1 << 16)
        assert tuple(rows[-1].a) == (None, None) and rows[-1].lt is None
    wide = spark.range(1).select(unsigned.word(F.lit("-1").cast("decimal(38,0)")).alias("a"), unsigned.word(F.lit("9" * 37).cast("decimal(38,0)")).alias("b")).first()
    assert (wide.a, wide.b % m) == (-1, int("9" * 37) % m)
    assert compile_to_column(simplify(Constant(m - 1, "word") * 2)) is not None and simplify(Constant(m - 1, "word") * 2).value == m - 2
    for kind in ("u8", "u16", "u32", "u64"):
        assert "ecimal" not in QUERIES[f"{kind}_arithmetic"](spark, SMALL)._jdf.queryExecution().toString()


def test_byte_updates(spark):
    value = spark.createDataFrame([(bytearray.fromhex("05ff"),), (bytearray(),), (None,)], "v binary")
    got = [r for r in value.select(blobs.add_bytes(F.col("v"), bytes.fromhex("0a02ff")), blobs.mul_bytes(F.col("v"), bytes.fromhex("0a02ff")), blobs.add_bytes(F.col("v"), b"")).collect()]
    assert [tuple(None if x is None else bytes(x).hex() for x in r) for r in got] == [("0f01ff", "32feff", "05ff"), ("0a02ff", "0a02ff", ""), (None, None, None)]


def test_prefix_ends():
    assert [blobs.prefix_end(p) for p in (b"abc", b"ab\xff", b"\xff\xff", b"")] == [b"abd", b"ac", None, None]


def test_prefix_scan_of_binary_keys(spark):
    rows = [(bytearray(k), i) for i, k in enumerate([b"", b"a", b"ab", b"ab\xff", b"ab\xff\xff", b"ac", b"\xff", b"\xff\xff\x01"])]
    df = spark.createDataFrame(rows, "key binary, i int")
    for prefix, want in ((b"ab", [2, 3, 4]), (b"ab\xff", [3, 4]), (b"\xff\xff", [7]), (b"\xff", [6, 7]), (b"", list(range(8))), (b"zz", [])):
        assert [r.i for r in keyed.prefix_scan(df, "key", prefix).collect()] == want


def test_filters_reach_the_scan(spark):
    orders = spark.read.parquet(f"{SMALL}/orders.parquet")
    plan = keyed.range_scan(orders, "o_orderkey", 5, 9)._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(o_orderkey,5)" in plan and "LessThan(o_orderkey,9)" in plan
    plan = query(orders).where((col("o_totalprice") > 5.0) & ~(col("o_orderstatus") == "F")).select("o_orderkey").run()._jdf.queryExecution().toString()
    assert "GreaterThan(o_totalprice,5.0)" in plan


def test_pages_cover_the_collection(spark):
    df = kv(spark, [(f"k{i:03d}", str(i)) for i in range(23)])
    seen, after = [], None
    while True:
        rows = keyed.page(df, "key", 5, after).collect()
        seen += [r.key for r in rows]
        if not rows[-1].has_more:
            break
        after = keyed.read_cursor(rows[-1].next_cursor)
    assert seen == [f"k{i:03d}" for i in range(23)] and rows[-1].next_cursor is None
    with pytest.raises(ValueError):
        keyed.read_cursor("00|00")
    assert keyed.page(df.limit(0), "key", 5).count() == 0


def test_circuit_types():
    with pytest.raises(TypeError):
        type_of(Binary("add", Load("a", "u8"), Load("b", "u16")))
    with pytest.raises(TypeError):
        type_of(Binary("and", Load("a", "u8"), Load("b", "u8")))
    with pytest.raises(TypeError):
        type_of(Unary("not", Load("a", "u8")))
    assert type_of(Load("a", "u8").compare("lt", 3)) == "bool"


def test_simplified_circuits_are_equal(spark):
    rng = random.Random(7)

    def tree(depth):
        if depth == 0:
            return rng.choice([Load("a", "u8"), Load("b", "u8"), Constant(rng.choice([0, 1, 7, 255]), "u8")])
        return rng.choice([Unary("neg", tree(depth - 1)), Binary(rng.choice(["add", "sub", "mul"]), tree(depth - 1), tree(depth - 1))])

    df = spark.createDataFrame([(a, b) for a in (0, 1, 200, 255) for b in (0, 3, 255)], "a smallint, b smallint")
    trees = [tree(3) for _ in range(12)]
    row = df.select(*[(compile_to_column(t) == compile_to_column(simplify(t))).alias(f"t{i}") for i, t in enumerate(trees)])
    assert all(all(r) for r in row.collect())
    assert all(measure(simplify(t))["gates"] <= measure(t)["gates"] for t in trees)


def test_partial_logic(spark):
    df = spark.createDataFrame([(None, True), (None, False), (True, None), (False, None)], "a boolean, b boolean")
    p = (col("a") == True) & (col("b") == True)  # noqa: E712
    assert [r[0] for r in df.select(compile_predicate(p, left_first=True)).collect()] == [None, None, None, False]
    assert columns_of(p | ~(col("c") > 1)) == ["a", "b", "c"]


def test_opaque_values_are_kept(spark):
    df = kv(spark, [("a", "x" * 65), ("b", "x" * 64), ("c", "a")])
    assert sorted(r.key for r in filter_plain(df, col("value") == "a").collect()) == ["a", "c"]


def test_latest_wins_against_a_dict(spark):
    rng, model, rows = random.Random(3), {}, []
    for seq in range(300):
        key, op = f"k{rng.randrange(20)}", rng.choice(["put", "put", "delete"])
        value = None if op == "delete" else rng.choice(["", str(seq)])
        rows.append((seq, op, key, value))
        model[key] = (op, value)
    log = spark.createDataFrame(rows, "seq long, op string, key string, value string").repartition(5)
    assert {r.key: r.value for r in changes.latest(log, "key").collect()} == {k: v for k, (op, v) in model.items() if op == "put"}


def test_compaction_is_sorted_and_complete(spark, tmp_path):
    log = spark.createDataFrame([(i, "put", i % 50, str(i)) for i in range(200)], "seq long, op string, key long, value string")
    changes.compact(log, "key", str(tmp_path / "c"), 3)
    got = spark.read.parquet(str(tmp_path / "c"))
    assert sorted(map(tuple, got.collect())) == [(k, str(150 + k)) for k in range(50)]


def test_transactions(spark):
    df = kv(spark, [("a", "1"), ("b", "2")])
    t = changes.Transaction(df, "key")
    t.set(kv(spark, [("a", "9"), ("c", "3")]))
    t.delete("b")
    assert [r.value for r in t.get("a").collect()] == ["9"] and t.get("b").isEmpty()
    assert sorted(map(tuple, t.commit().collect())) == [("a", "9"), ("c", "3")]
    with pytest.raises(RuntimeError):
        t.delete("a")
    with pytest.raises(RuntimeError, match="operation 1 failed"):
        changes.apply_batch(df, [lambda d: d, lambda d: d.select("none")])
    assert df.count() == 2


def test_indexes(spark):
    df = kv(spark, [("p1", "x"), ("p2", "y"), ("p3", "x")])
    with pytest.raises(ValueError):
        indexes.build_unique(df, "value", "key")
    assert indexes.build_unique(df.where("key <> 'p3'"), "value", "key").count() == 2
    assert indexes.stats(indexes.build(df, "value", "key")).first().asDict() == {"entries": 3, "distinct_values": 2}


def test_ring_moves_few_keys(spark):
    df = spark.range(2000)
    three = {r.id: r.node for r in shards.ring_shard(df, "id", ["a", "b", "c"]).collect()}
    two = {r.id: r.node for r in shards.ring_shard(df, "id", ["a", "b"]).collect()}
    assert all(two[k] == n for k, n in three.items() if n != "c") and len(set(three.values())) == 3


def test_empty_statistics(spark):
    empty = spark.createDataFrame([], "shard_id int, node int, key_count long, bytes long")
    assert shards.stats(empty).first().asDict() == {"shards": 0, "nodes": 0, "total_keys": 0, "total_bytes": 0, "average_keys": 0, "average_bytes": 0}
    assert aggregates.stats(kv(spark, []), "value").first().asDict() == {"key_count": 0, "total_bytes": 0, "truncated": False}


def test_percentile_above_the_last_bound(spark):
    df = spark.createDataFrame([(float(v),) for v in (1, 2, 99)], "v double")
    assert aggregates.percentile(df, "v", [1.0, 5.0], 99).first()[0] == 5.0
    assert aggregates.percentile(df, "v", [2.0, 100.0], 50).first()[0] == 1.5


def merkle_levels(values):
    levels = [[hashlib.sha256(b"\x00" + v.encode()).hexdigest() for v in values]]
    while len(levels[-1]) > 1:
        level = levels[-1]
        pairs = [(level[i], level[min(i + 1, len(level) - 1)]) for i in range(0, len(level), 2)]
        levels.append([hashlib.sha256(b"\x01" + bytes.fromhex(a) + bytes.fromhex(b)).hexdigest() for a, b in pairs])
    return levels


def test_merkle_root_and_proofs(spark, monkeypatch):
    for n, height in ((0, 10), (1, 10), (2, 10), (13, 2), (37, 3)):
        monkeypatch.setattr(merkle.layers, "__defaults__", (height,))
        values = [f"v{i:02d}" for i in range(n)]
        df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "k int, v string").repartition(4)
        want = merkle_levels(values)[-1][0] if n else hashlib.sha256(b"empty").hexdigest()
        assert merkle.root(df, "k", F.col("v")) == want
        for i in {0, n // 2, n - 1} if n else ():
            p = merkle.proof(df, "k", F.col("v"), i)
            assert merkle.verify(values[i].encode(), p, want) and not merkle.verify(b"other", p, want)
        with pytest.raises(IndexError):
            merkle.proof(df, "k", F.col("v"), n)


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_wide_frames_are_numbered_once(spark, adaptive):
    """More rows than a range sampler takes, several columns, partitions of any number: no row is lost,
    chunks are full, and the root is the same."""
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        df = spark.range(200_000).select((F.col("id") * 7919 % 200_003).alias("k"), F.col("id").cast("string").alias("v"), F.sha2(F.col("id").cast("string"), 256).alias("w"))
        out = feed.chunked(df.repartition(9), "k", 100)
        ranks = {r.k: i for i, r in enumerate(df.select("k").orderBy("k").collect())}
        rows = out.select("k", "v", "chunk", "has_more").collect()
        assert len(rows) == 200_000 and all(r.chunk == ranks[r.k] // 100 for r in rows)
        assert sum(not r.has_more for r in rows) == 100
        assert merkle.root(df.repartition(3), "k", F.col("v")) == merkle.root(df.repartition(8), "k", F.col("v"))
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_route_and_keys_by_plan(spark):
    """Routing over many shards, with gaps; keys that are few are broadcast and the collection is not shuffled."""
    rng = random.Random(4)
    cuts = sorted(rng.sample(range(100_000), 3000))
    table = [(i, a, b) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if i % 5]
    shard_table = spark.createDataFrame(table, "shard_id int, start_key long, end_key long")
    got = {r.id: r.shard_id for r in shards.route(spark.range(100_000), shard_table, "id").collect()}
    assert got == {k: i for i, a, b in table for k in range(a, b)}
    df, keys = spark.range(1000).withColumn("v", F.col("id") * 2), spark.createDataFrame([(3,), (3,), (5000,)], "id long")
    assert sorted(map(tuple, keyed.multi_get(keys, df, "id").collect()), key=repr) == sorted([(3, 6), (3, 6), (5000, None)], key=repr)
    assert sorted(map(tuple, keyed.which_exist(keys, df, "id").collect())) == [(3, True), (3, True), (5000, False)]


def test_keys_are_broadcast_and_ranges_of_text_meet(spark):
    keys = spark.createDataFrame([(3,), (5,)], "o_orderkey long")
    orders = spark.read.parquet(f"{SMALL}/orders.parquet")
    plan = keyed.matching(orders, keys, "o_orderkey")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    rng = random.Random(5)
    ranges = [sorted(f"{rng.randrange(500):03d}" for _ in range(2)) for _ in range(60)]
    left, right = (spark.createDataFrame([(i, *r) for i, r in enumerate(some)], "f int, low string, high string") for some in (ranges[:25], ranges[25:]))
    got = sorted((r.left_f, r.right_f) for r in shards.overlap_pairs(left, right).collect())
    assert got == sorted((i, j) for i, a in enumerate(ranges[:25]) for j, b in enumerate(ranges[25:]) if a[0] <= b[1] and b[0] <= a[1])
    assert "NestedLoop" not in shards.overlap_pairs(left, right)._jdf.queryExecution().executedPlan().toString()


def test_opaque_values_need_compute(spark):
    from keystrata.plans.predicate import require_plain

    plain, opaque = kv(spark, [("a", "x" * 64), ("b", None)]), kv(spark, [("a", "x" * 65)])
    assert require_plain(plain, "value").count() == 2
    with pytest.raises(Exception, match="opaque"):
        require_plain(opaque, "value").collect()


def test_named_indexes_and_shards_refuse(spark):
    named = indexes.Indexes(kv(spark, [("a", "1"), ("b", "1")]), "key")
    named.create("by_value", "value")
    for call in (lambda: named.create("by_value", "value"), lambda: named.drop("other"), lambda: named.create("unique", "value", unique=True)):
        with pytest.raises(ValueError):
            call()
    assert named.names() == ["by_value"] and named.lookup("by_value", "1").count() == 2
    table = spark.createDataFrame([(1, 0, 9, 1), (2, 9, 20, 2)], "shard_id int, start_key long, end_key long, node int")
    for call in (lambda: shards.split(table, 1, 9, 3), lambda: shards.join_shards(table, 1, 2, 3)):
        with pytest.raises(ValueError):
            call()


def test_shared_folder_is_forgotten(spark):
    from keystrata.sources import shared

    at = shared.shared_dir(spark, "x")
    spark.range(3).write.parquet(at)
    shared.forget(spark)
    with pytest.raises(Exception):
        spark.read.parquet(at).count()


def test_backup_and_restore(spark, tmp_path):
    df = kv(spark, [("a", "1"), ("b", None), ("c", "")])
    snapshots.backup(df, str(tmp_path / "b"))
    assert sorted(map(tuple, snapshots.restore(spark, str(tmp_path / "b")).collect())) == [("a", "1"), ("b", None), ("c", "")]
    df.limit(1).write.mode("append").parquet(str(tmp_path / "b" / "data"))
    with pytest.raises(ValueError):
        snapshots.restore(spark, str(tmp_path / "b"))


def test_batch_grammar_and_snapshots(spark, tmp_path):
    (tmp_path / "ops.txt").write_text("# comment\n\nput k1 a value\ndelete k1\nput k2\nnonsense\n  PUT k3 v\n")
    parsed = files.read_batch(spark, str(tmp_path / "ops.txt"))
    assert [(r.op, r.key, r.value, r.status) for r in parsed.collect()] == [("put", "k1", "a value", "ok"), ("delete", "k1", None, "ok"), ("put", "k2", None, "invalid"), ("nonsense", None, None, "invalid"), ("put", "k3", "v", "ok")]
    assert files.batch_counts(parsed).first().asDict() == {"total": 5, "succeeded": 3, "failed": 2}
    (tmp_path / "s.json").write_text('{"key":"a","value":"1"}\n{"key":"b","value":"2"}\n{"key":"a","value":"3"}\n')
    assert {r.key: r.value for r in files.read_snapshot(spark, str(tmp_path / "s.json")).collect()} == {"a": "3", "b": "2"}


def test_display(spark):
    df = spark.createDataFrame([(bytearray(b"plain\n"),), (bytearray(b"\x00\xff"),), (bytearray(),), (bytearray(b"\x01x"),)], "v binary")
    assert [tuple(r) for r in df.select(blobs.display(F.col("v")), blobs.looks_encrypted(F.col("v"))).collect()] == [("plain\n", False), ("BASE64:AP8=", False), ("", False), ("BASE64:AXg=", True)]
    assert spark.range(1).select(blobs.human_bytes(F.lit(1536))).first()[0] == "1.50 KB"


def test_stream_resumes_and_delivers_once(spark, tmp_path):
    schema = "seq long, key string"
    source, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "cp"))
    for part in ([(1, "user:1"), (2, "item:1")], [(3, "user:2")]):
        spark.createDataFrame(part, schema).write.mode("append").parquet(source)
        got = feed.drain(feed.change_feed(spark, source, schema, "key", "user:*"), out, checkpoint)
    assert sorted(r.seq for r in got.collect()) == [1, 3]


def test_stream_of_latest_values(spark, tmp_path):
    schema, source = "seq long, key string", str(tmp_path / "in")
    spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], schema).write.parquet(source)
    stream = feed.latest_values(spark.readStream.schema(schema).parquet(source), "key", "seq")
    stream.writeStream.format("memory").queryName("latest_now").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert {r.key: r.seq for r in spark.table("latest_now").collect()} == {"a": 2, "b": 3}


def test_chunks(spark):
    df = spark.range(25).repartition(4)
    rows = {r.id: (r.chunk, r.has_more) for r in feed.chunked(df, "id", 10).collect()}
    assert rows == {i: (i // 10, i < 20) for i in range(25)}
    assert [len(c) for c in feed.iterate(df, 10)] == [10, 10, 5]
    assert feed.chunked(df.limit(0), "id", 10).count() == 0


def test_overlap_pairs_by_blocks(spark):
    """All pairs of ranges, without a join on inequalities."""
    import random

    from keystrata.operators import shards

    rng = random.Random(4)
    top = (1 << 63) - 1
    sides = []
    for _ in range(2):
        rows = [(rng.randint(-300, 300), rng.choice([0, 1, 5, 90])) for _ in range(40)]
        sides.append([(i, low, low + w) for i, (low, w) in enumerate(rows)] + [(40, -top - 1, top), (41, top, top), (42, None, 3), (43, 9, 2), (44, -top - 1, -top - 1)])
    a, b = (spark.createDataFrame(rows, "f long, low long, high long") for rows in sides)
    out = shards.overlap_pairs(a, b).select("left_f", "right_f")
    want = [(f, g) for f, x, y in sides[0] for g, u, v in sides[1] if x is not None and u is not None and x <= v and u <= y]
    assert sorted(map(tuple, out.collect())) == sorted(want)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
