"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations only.

Every source gets a target number of words. A document's expected copies are target / size of
its source; whole copies are certain, and the fraction is an inclusion probability p. Documents
are ranked by their random odds over their inclusion odds, (u / (1 - u)) / (p / (1 - p)), and the
first of them that fill the source's remaining words are taken once more.

Scale: a source may hold any share of all rows, so no task ever sees a whole source. Ranks are
cut into BINS equal bins, sums of (source, bin) are added up in a small table, and only the one
bin in which a source's quota ends is ordered row by row. That gives one row a source, written so
that its size is known to Spark, which the documents meet without a shuffle while it is small. The
text is scanned once.

Defined results: null text has size 0; a null source is a source of its own, after all others;
null or repeated doc_ids are rows like others; rows with equal doc_id and text tie and are taken
one by one; sources without words get target 0; an empty table gives an empty table; other
columns are carried along only if named in `keep` and not like one of the operator's. Random numbers are hashes of seed, doc_id
and text, so reruns agree.
"""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_COPIES = 2
SEED = "mix-1"
BINS = 4096
_OWN = {"size", "source_size", "target", "taken", "u", "importance", "of", "whole", "p", "rank", "bin", "doc_order", "last_bin", "edge", "more"}
WORD = r"[^\x20\x09-\x0D]+"


def uniform(seed: str, *parts: Column) -> Column:
    """A reproducible random number between 0 and 1, never either."""
    text = F.concat_ws("|", F.lit(seed), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return (F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST_COPIES) -> DataFrame:
    """One row per source: source_size, target. Weights repeat over the sources by code point, null
    last; a target stops at `most` times the source's size and the rest is shared again by weight.

    The targets are min(cap, level * weight) for one level; a source is capped if its cap a weight
    lies below the level that the sources with smaller caps a weight leave. The windows run over
    one row per source."""
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    by_cap = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    t = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    t = t.withColumn("w", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.row_number().over(ordered) - 1) % len(weights) + 1).cast("long"))
    t = t.withColumn("cap", F.col("source_size") * most)
    t = t.withColumn("total", F.sum("source_size").over(everything) * F.lit(float(share))).withColumn("all_w", F.sum("w").over(everything))
    t = t.withColumn("left", F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0)))
    t = t.withColumn("left_w", F.col("all_w") - F.coalesce(F.sum("w").over(before), F.lit(0)))
    t = t.withColumn("capped", F.col("cap") * F.col("left_w") < F.col("left") * F.col("w"))
    taken = F.when(F.col("capped"), F.col("cap")).otherwise(0)
    taken_w = F.when(F.col("capped"), F.col("w")).otherwise(0)
    t = t.withColumn("rest", F.col("total") - F.sum(taken).over(everything)).withColumn("rest_w", F.col("all_w") - F.sum(taken_w).over(everything))
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.col("rest") * F.col("w") / F.col("rest_w"))
    return t.select("source", "source_size", target.alias("target"))


def _take_tied(rows: DataFrame) -> DataFrame:
    """Of rows that are equal in all that orders them, as many of each source as fit. They are numbered by
    the partition that holds them and written once, so that no task has to see all of a source's."""
    row = F.monotonically_increasing_id()
    rows = written(rows.withColumns({"_tied_row": row, "_tied_part": F.shiftright(row, 33)}), "mix-tied")
    sizes = rows.groupBy(F.col("source").alias("_tied_of"), F.col("_tied_part").alias("_tied_at")).agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("_tied_of").orderBy("_tied_at")) - F.col("n")  # a row a partition
    sizes = sizes.select("_tied_of", "_tied_at", before.alias("_tied_before"))
    rows = rows.join(sizes, F.col("source").eqNullSafe(F.col("_tied_of")) & (F.col("_tied_part") == F.col("_tied_at")))
    place = F.col("_tied_before") + F.row_number().over(Window.partitionBy("source", "_tied_part").orderBy("_tied_row"))
    return rows.withColumn("more", (place <= F.col("edge.fit")).cast("long")).drop("_tied_row", "_tied_part", "_tied_of", "_tied_at", "_tied_before")


def mix_sources(docs: DataFrame, keep: tuple[str, ...] = (), weights=WEIGHTS, share: float = SHARE, most: int = MOST_COPIES, seed: str = SEED, importance: Column | None = None) -> DataFrame:
    """Every document with its size, its source's size and target, and the words taken of it.

    `importance` (mean about 1 in a source) scales a document's expected copies, up to `most`."""
    keep = tuple(c for c in dict.fromkeys(keep) if c not in _OWN)
    sizes = docs.select(
        "doc_id", "source", *[c for c in keep if c not in ("doc_id", "source")],
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        uniform(seed, F.col("doc_id"), F.md5(F.coalesce("text", F.lit("")))).alias("u"),
        (F.lit(1.0) if importance is None else F.coalesce(importance.cast("double"), F.lit(1.0))).alias("importance"),
    )
    sizes = written(sizes, "mix-sizes")
    targets = written(source_targets(sizes, weights, share, most).withColumnRenamed("source", "of"), "mix-targets")
    rows = sizes.join(targets, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    copies = F.least(F.lit(float(most)), F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size") * F.col("importance")).otherwise(0.0))
    rows = rows.withColumn("whole", F.floor(copies)).withColumn("p", copies - F.floor(copies))
    odds = F.col("u") / (1 - F.col("u"))
    # odds of u over odds of p, brought from (0, inf) to (0, 1) without changing the order
    rank = odds * (1 - F.col("p")) / (odds * (1 - F.col("p")) + F.col("p"))
    rows = rows.withColumn("rank", rank).withColumn("bin", F.least(F.floor(rank * BINS), F.lit(BINS - 1)))
    rows = rows.withColumn("doc_order", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))))

    bins = rows.groupBy("source", "bin").agg(
        F.sum("size").alias("bin_size"), F.sum(F.col("whole") * F.col("size")).alias("bin_whole"), F.first("target").alias("target")
    )
    of_source = Window.partitionBy("source")
    bins = bins.withColumn("quota", F.col("target") - F.sum("bin_whole").over(of_source))
    bins = bins.withColumn("base", F.sum("bin_size").over(of_source.orderBy("bin")) - F.col("bin_size"))
    inside, outside = F.col("base") + F.col("bin_size") <= F.col("quota"), F.col("base") >= F.col("quota")
    cut = ~inside & ~outside
    ends = bins.groupBy(F.col("source").alias("of")).agg(
        F.max(F.when(inside, F.col("bin"))).alias("last_bin"), F.max(F.when(cut, F.col("bin"))).alias("cut_bin"), F.max(F.when(cut, F.col("base"))).alias("base"), F.first("quota").alias("quota")
    )
    ends = written(ends, "mix-ends")

    edge = rows.select("source", "bin", "rank", "doc_order", "size").join(ends, F.col("source").eqNullSafe(F.col("of")) & (F.col("bin") == F.col("cut_bin")))
    in_bin = of_source.orderBy("rank", "doc_order", "size").rowsBetween(Window.unboundedPreceding, 0)
    edge = edge.withColumn("upto", F.col("base") + F.sum("size").over(in_bin))
    # the row on which the quota ends is taken if that comes nearer to it
    edge = edge.groupBy("source", "rank", "doc_order", "size").agg(F.count_if(F.col("upto") - F.col("size") / 2 <= F.col("quota")).alias("fit"), F.count(F.lit(1)).alias("tied"))
    edge = edge.where("fit > 0").groupBy(F.col("source").alias("edge_of")).agg(F.max(F.struct("rank", "doc_order", "size", "fit", "tied")).alias("edge"))
    # up to here in each source, one row each, so that the documents meet them without a shuffle
    ends = written(ends.join(edge, F.col("of").eqNullSafe(F.col("edge_of")), "left").select("of", "last_bin", "edge"), "mix-edges")
    rows = rows.join(ends, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    at, later = F.lit(True), F.lit(False)
    for c in ("size", "doc_order", "rank"):
        later = (F.col(c) > F.col(f"edge.{c}")) | ((F.col(c) == F.col(f"edge.{c}")) & later)
        at = at & (F.col(c) == F.col(f"edge.{c}"))
    taken = F.coalesce(F.col("bin") <= F.col("last_bin"), F.lit(False)) | F.coalesce(~later, F.lit(False))
    out = rows.withColumn("more", taken.cast("long"))
    if not ends.where("edge.fit < edge.tied").isEmpty():
        some = F.coalesce(at & F.expr("edge.fit < edge.tied"), F.lit(False))
        out = out.where(~some).unionByName(_take_tied(rows.where(some)))
    copies = F.least(F.col("whole") + F.when(F.col("size") > 0, F.col("more")).otherwise(0), F.lit(most))
    columns = dict.fromkeys(["doc_id", *keep])
    return out.select(*columns, "size", "source_size", "target", (copies * F.col("size")).alias("taken"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


OP8_SQL = f"""
WITH sizes AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
    (('0x' || substr(md5(concat('{SEED}|', coalesce(doc_id::VARCHAR, ''), '|', md5(coalesce(text, '')))), 1, 12))::BIGINT + 0.5::DOUBLE) / {1 << 48}::DOUBLE AS u
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM sizes GROUP BY source),
w AS (SELECT *, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::BIGINT AS w, source_size * 2 AS cap,
    (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS total FROM s),
l AS (SELECT *, sum(w) OVER () AS all_w,
    total - coalesce(sum(cap) OVER b, 0)::DOUBLE AS left_t, sum(w) OVER () - coalesce(sum(w) OVER b, 0) AS left_w
  FROM w WINDOW b AS (ORDER BY cap::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, cap * left_w < left_t * w AS capped FROM l),
t AS (SELECT source, source_size, CASE WHEN capped THEN cap::DOUBLE ELSE
    (total - (sum(CASE WHEN capped THEN cap ELSE 0 END) OVER ())::DOUBLE) * w::DOUBLE
    / (all_w - sum(CASE WHEN capped THEN w ELSE 0 END) OVER ())::DOUBLE END AS target FROM c),
r AS (SELECT d.*, t.source_size, t.target, least(2.0::DOUBLE, CASE WHEN source_size > 0 THEN target / source_size::DOUBLE ELSE 0 END) AS f
  FROM sizes d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
p AS (SELECT *, floor(f)::BIGINT AS whole, f - floor(f) AS p, u / (1 - u) AS odds FROM r),
k AS (SELECT *, odds * (1 - p) / (odds * (1 - p) + p) AS rank, target - (sum(whole * size) OVER (PARTITION BY source))::DOUBLE AS quota FROM p),
m AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY rank, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto FROM k)
SELECT doc_id, size, source_size, target,
  (size * least(whole + CASE WHEN size > 0 AND upto::DOUBLE - size / 2.0::DOUBLE <= quota THEN 1 ELSE 0 END, 2))::BIGINT AS taken
FROM m
"""
