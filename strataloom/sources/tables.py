"""The bundled tables as a graph: business entities and documents as nodes, keys as dated edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.model import float_value, int_value, string_value

#: Documents are made one a minute from here on.
DOCUMENT_EPOCH_MS = 1_700_000_000_000
DAY_MS = 86_400_000
MODEL = "m64"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def key_id(prefix: str, key: str | Column) -> Column:
    """Ids whose text order is their number order."""
    return F.concat(F.lit(prefix), F.lpad((F.col(key) if isinstance(key, str) else key).cast("string"), 12, "0"))


def ms(column: str) -> Column:
    return F.unix_millis(F.col(column).cast("timestamp"))


def _props(**values: Column) -> Column:
    return F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v)])


def business_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Region, Nation, Supplier, Part (shared), Customer (its segment) and Order (its customer's segment)."""
    t = lambda name: table(spark, sf_dir, name)
    shared = F.lit("shared")
    customers = t("customer")
    parts = [
        t("region").select(key_id("R", "r_regionkey").alias("id"), shared.alias("scope"), F.lit("Region").alias("label"),
                           F.lit(0).cast("long").alias("created_ms"), _props(name=string_value(F.col("r_name"))).alias("props")),
        t("nation").select(key_id("N", "n_nationkey"), shared, F.lit("Nation"), F.lit(0).cast("long"),
                           _props(name=string_value(F.col("n_name")))),
        t("supplier").select(key_id("S", "s_suppkey"), shared, F.lit("Supplier"), F.lit(0).cast("long"),
                             _props(name=string_value(F.col("s_name")), acctbal=float_value(F.col("s_acctbal")))),
        t("part").select(key_id("P", "p_partkey"), shared, F.lit("Part"), F.lit(0).cast("long"),
                         _props(name=string_value(F.col("p_name")), brand=string_value(F.col("p_brand")),
                                size=int_value(F.col("p_size")), price=float_value(F.col("p_retailprice")))),
        customers.select(key_id("C", "c_custkey"), F.col("c_mktsegment"), F.lit("Customer"), F.lit(0).cast("long"),
                         _props(name=string_value(F.col("c_name")), acctbal=float_value(F.col("c_acctbal")))),
        t("orders").join(customers, F.col("o_custkey") == F.col("c_custkey")).select(
            key_id("O", "o_orderkey"), F.col("c_mktsegment"), F.lit("Order"), ms("o_orderdate"),
            _props(status=string_value(F.col("o_orderstatus")), total=float_value(F.col("o_totalprice")))),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def business_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """in_region, in_nation, placed_by and contains edges; returned lines end after 90 days."""
    t = lambda name: table(spark, sf_dir, name)
    none, zero = F.lit(None).cast("long"), F.lit(0).cast("long")
    customers = t("customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    owned = t("orders").join(customers, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_mktsegment", "o_custkey", "o_orderdate")
    line_id = F.concat_ws("-", F.lit("EL"), "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", ms("l_shipdate").cast("string"))
    parts = [
        t("nation").select(key_id("ER", "n_nationkey").alias("id"), F.lit("shared").alias("scope"), F.lit("in_region").alias("ty"),
                           key_id("N", "n_nationkey").alias("src"), key_id("R", "n_regionkey").alias("dst"),
                           zero.alias("valid_from"), none.alias("valid_to")),
        t("supplier").select(key_id("ES", "s_suppkey"), F.lit("shared"), F.lit("in_nation"), key_id("S", "s_suppkey"),
                             key_id("N", "s_nationkey"), zero, none),
        customers.select(key_id("EC", "c_custkey"), F.col("c_mktsegment"), F.lit("in_nation"), key_id("C", "c_custkey"),
                         key_id("N", "c_nationkey"), zero, none),
        owned.select(key_id("EO", "o_orderkey"), F.col("c_mktsegment"), F.lit("placed_by"), key_id("O", "o_orderkey"),
                     key_id("C", "o_custkey"), ms("o_orderdate"), none),
        t("lineitem").join(owned, F.col("l_orderkey") == F.col("o_orderkey")).select(
            line_id, F.col("c_mktsegment"), F.lit("contains"), key_id("O", "l_orderkey"), key_id("P", "l_partkey"), ms("l_shipdate"),
            F.when(F.col("l_linestatus") == "F", ms("l_shipdate") + 90 * DAY_MS)),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as Memory nodes in the scope of their source."""
    return table(spark, sf_dir, "documents").select(
        key_id("D", "doc_id").alias("id"), F.col("source").alias("scope"), F.lit("Memory").alias("label"),
        (F.lit(DOCUMENT_EPOCH_MS) + F.col("doc_id") * 60_000).alias("created_ms"),
        _props(content=string_value(F.col("text")), lang=string_value(F.col("lang"))).alias("props"))


def spread(df: DataFrame) -> DataFrame:
    """Rows of a table that lies in fewer pieces than there are cores, dealt to all of them; a table of many
    pieces is left alone."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores and df.rdd.getNumPartitions() < cores else df


def bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).select(key_id("D", "doc_id").alias("id"), F.col("source").alias("scope"),
                                                   F.col("text").alias("body"))


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(key_id("D", "vec_id").alias("id"), F.lit(MODEL).alias("model"),
                                                    F.col("embedding").alias("vector"))


def bumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views as access bumps of the document with the user's number."""
    return table(spark, sf_dir, "events").where("event_type = 'view'").select(
        key_id("D", "user_id").alias("id"), F.lit(1).cast("long").alias("n"), ms("ts").alias("at"))


def event_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as an op log over user nodes: signups create, errors remove, purchases link a user to the next
    one, clicks and views write a property."""
    from strataloom.model import PROPS

    e = table(spark, sf_dir, "events")
    user, kind = key_id("U", "user_id"), F.col("event_type")
    seq = F.col("event_id") + 1
    none = F.lit(None)
    props = F.when(kind == "signup", F.create_map(F.lit("joined"), int_value(ms("ts")))).when(
        kind.isin("click", "view"), F.create_map(kind, float_value(F.round("value", 2)), F.lit("last"), string_value(kind)))
    op = F.when(kind == "signup", "CreateNode").when(kind == "error", "RemoveNode").when(kind == "purchase", "CreateEdge").otherwise("SetNodeProps")
    return e.select(
        seq.alias("seq"), F.lit(0).cast("long").alias("batch_id"), ms("ts").alias("committed_ms"), op.alias("op"),
        F.when(kind == "purchase", key_id("X", "event_id")).otherwise(user).alias("id"), F.lit("shared").alias("scope"),
        F.when(kind == "signup", "User").alias("label"), F.when(kind == "purchase", "buys").alias("ty"),
        F.when(kind == "purchase", user).alias("src"), F.when(kind == "purchase", key_id("U", F.col("user_id") + 1)).alias("dst"),
        props.cast(PROPS).alias("props"), F.when(kind == "view", F.array(F.lit("click"))).alias("del_keys"),
        none.cast("string").alias("model"), none.cast("array<float>").alias("vector"),
        F.when(kind == "purchase", ms("ts")).alias("valid_from"), none.cast("long").alias("valid_to"))
