"""Graphs: text edge lists, and the edge sources of the relational tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

def _parsed(lines: DataFrame, weighted: bool, comment: str) -> DataFrame:
    """``lines`` that are no comments and not blank, with ``src, dst[, weight]`` and whether they are ``good``."""
    text = F.regexp_replace("value", r"^[\t ,;\r]+|[\t ,;\r]+$", "")
    skip = F.col("value").rlike("[%#]") if comment == "any" else F.col("value").startswith("#")
    rows = lines.where(~skip).withColumn("_f", F.split(text, r"[\t ,;]+")).where("_f[0] <> ''")
    src, dst = (F.when(F.get("_f", F.lit(i)).rlike("^[0-9]{1,19}$"), F.get("_f", F.lit(i)).try_cast("long")) for i in (0, 1))
    rows = rows.withColumns({"src": src, "dst": dst})
    if weighted:
        weight = F.coalesce(F.get("_f", F.lit(2)).try_cast("double"), F.lit(1.0))
        rows = rows.withColumn("weight", F.when(weight == 0, 1.0).otherwise(weight) if comment == "any" else weight)
    return rows.drop("_f").withColumn("good", F.col("src").isNotNull() & F.col("dst").isNotNull())


def parse_edge_lines(lines: DataFrame, weighted: bool = False, comment: str = "start", keep_bad: bool = False) -> DataFrame:
    """``src, dst[, weight]`` from ``lines(value)``.

    Fields are parted by any run of tab, comma, blank or semicolon; surplus columns are ignored. ``comment``:
    ``start`` - lines beginning with ``#``; ``any`` - lines with ``%`` or ``#`` anywhere, and a weight of 0 is 1.
    Ids must be decimal and below 2 ** 63; only a curve asks for smaller ones. Other lines are left out, or kept with the line in ``bad``.
    """
    parsed = _parsed(lines.select("value"), weighted, comment)
    if keep_bad:
        return parsed.withColumn("bad", F.when(~F.col("good"), F.col("value"))).drop("value", "good")
    return parsed.where("good").drop("value", "good")


def read_edge_list(spark: SparkSession, path: str, **options) -> DataFrame:
    """A text edge list; Spark splits the file and aligns the parts to lines."""
    return parse_edge_lines(spark.read.text(path), **options)


def bad_lines(spark: SparkSession, path: str, comment: str = "start") -> DataFrame:
    """``file, line, text`` of the lines that no edge can be read from, lines counted from 1.

    A split's rows are marked in their order, so a line's number is its place in its split behind the lines of the
    file's earlier splits; only a count a split is summed up.
    """
    splits = F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")
    lines = spark.read.text(path).select("value", *splits, F.monotonically_increasing_id().alias("mark"))
    sizes = lines.groupBy("file", "start").agg(F.count("*").alias("n"), F.min("mark").alias("first"))
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    bad = _parsed(lines, False, comment).where("not good").join(sizes, ["file", "start"])
    return bad.select("file", (F.col("before") + F.col("mark") - F.col("first") + 1).alias("line"), F.col("value").alias("text"))


def edge_lines(edges: DataFrame, base: int = 0) -> DataFrame:
    """``value``: the lines of a text edge list, ids shifted by ``base``, and the weight if there is one."""
    fields = [(F.col(c) + base).cast("string") for c in ("src", "dst")]
    if "weight" in edges.columns:
        fields.append(F.col("weight").cast("string"))
    return edges.select(F.concat_ws(" ", *fields).alias("value"))


def write_edge_list(edges: DataFrame, path: str, base: int = 0) -> None:
    """Sorted by source and destination; files follow each other in that order."""
    edge_lines(edges.orderBy("src", "dst"), base).write.text(path)


def user_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From each event's user to the next event's, in time; a directed multigraph.

    Events are ranked by ranges of time, and each row meets its successor's rank: no task sees all events.
    """
    from edgeloom.operators.canonical import numbered

    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("ts", "event_id", "user_id")
    placed = numbered(events, "ts", "event_id", name="place").select("place", "user_id")
    after = placed.select((F.col("place") - 1).alias("place"), F.col("user_id").alias("dst"))
    return placed.join(after, "place").select(F.col("user_id").alias("src"), "dst")


def part_supp(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return lines.select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"))


def part_supp_bipartite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with both sides in one id space, suppliers behind the parts."""
    from edgeloom.operators.canonical import bipartite

    edges = part_supp(spark, sf_dir)
    return bipartite(edges, edges.agg(F.coalesce(F.max("src") + 1, F.lit(0)).alias("n1")).first().n1)


def part_supp_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quantity that each part got from each supplier."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return lines.groupBy(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")).agg(F.sum("l_quantity").alias("weight"))


def _ordered(spark: SparkSession, sf_dir: str, what: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", F.col(what).alias("dst"))
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.col("o_custkey").alias("src"))
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).select("src", "dst")


def cust_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ordered(spark, sf_dir, "l_partkey")


def cust_supp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ordered(spark, sf_dir, "l_suppkey")


def order_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From each order to its customer, orders behind the customers in one id space: a component a customer."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("src"), F.col("o_custkey").alias("dst"))
    n1 = orders.agg(F.coalesce(F.max("dst") + 1, F.lit(0)).alias("n1")).first().n1
    return orders.select((F.col("src") + n1).alias("src"), "dst")


def customer_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From each customer to their orders, both sides numbered for themselves."""
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("src"), F.col("o_orderkey").alias("dst"))


def order_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return lines.select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"))
