"""A knowledge graph over the relational tables: regions, nations, customers, suppliers, parts and orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessergraph.graph import Graph

NO_EXTRA = "cast(map() as map<string,string>)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _key(kind: str, column: str) -> Column:
    return F.concat(F.lit(f"{kind}:"), F.col(column).cast("string"))


def graph_view(spark: SparkSession, sf_dir: str) -> Graph:
    """Ids are ``table:key`` and unique by construction, so nothing is merged. The region is the community; regions are god
    nodes. Orders point at their parts, weighed by quantity and the mean discount; the parts of an order with three or more
    make a hyperedge."""
    t = lambda name: table(spark, sf_dir, name)
    home = t("nation").select(F.col("n_nationkey").alias("home"), F.col("n_regionkey").cast("long").alias("community"))

    def nodes(df: DataFrame, kind: str, place: int, key: str, label: Column, description: Column, importance: Column, nation: str | None = None) -> DataFrame:
        df = df.join(home, df[nation] == F.col("home"), "left") if nation else df
        community = F.col("community") if nation else F.col(key).cast("long") if kind == "region" else F.lit(None).cast("long")
        none = F.lit(None).cast("string")
        return df.select(
            _key(kind, key).alias("id"), label.alias("label"), F.lit(kind).alias("type"), F.lit("concept").alias("file_type"), description.alias("description"), importance.cast("double").alias("importance"),
            none.alias("source_file"), none.alias("source_location"), none.alias("source_url"), community.alias("community"), F.lit(kind == "region").alias("is_god"),
            F.expr(NO_EXTRA).alias("extra"), (F.lit(place * 10**15) + F.col(key).cast("long")).alias("ord"),
        )

    c, zero, blank = F.col, F.lit(0.0), F.lit("")
    all_nodes = [
        nodes(t("region"), "region", 0, "r_regionkey", c("r_name"), blank, zero),
        nodes(t("nation"), "nation", 1, "n_nationkey", c("n_name"), blank, zero, "n_nationkey"),
        nodes(t("customer"), "customer", 2, "c_custkey", c("c_name"), c("c_mktsegment"), F.greatest(zero, "c_acctbal"), "c_nationkey"),
        nodes(t("supplier"), "supplier", 3, "s_suppkey", c("s_name"), blank, F.greatest(zero, "s_acctbal"), "s_nationkey"),
        nodes(t("part"), "part", 4, "p_partkey", c("p_name"), F.concat_ws(" ", "p_brand", "p_type"), c("p_retailprice")),
        nodes(t("orders"), "order", 5, "o_orderkey", _key("order", "o_orderkey"), c("o_orderpriority"), c("o_totalprice")),
    ]

    def edges(df: DataFrame, place: int, src: Column, dst: Column, relation: str, key: str, weight: Column | None = None, sure: Column | None = None) -> DataFrame:
        one = F.lit(1.0)
        return df.select(
            src.alias("src"), dst.alias("dst"), F.lit(relation).alias("relation"), (one if weight is None else weight).cast("double").alias("weight"), F.lit("EXTRACTED").alias("confidence"),
            (one if sure is None else sure).cast("double").alias("confidence_score"), F.expr(NO_EXTRA).alias("extra"), (F.lit(place * 10**15) + c(key).cast("long")).alias("ord"),
        )

    bought = t("lineitem").groupBy("l_orderkey", "l_partkey").agg(F.sum("l_quantity").alias("q"), F.avg("l_discount").alias("d"))
    all_edges = [
        edges(t("nation"), 0, _key("nation", "n_nationkey"), _key("region", "n_regionkey"), "in", "n_nationkey"),
        edges(t("customer"), 1, _key("customer", "c_custkey"), _key("nation", "c_nationkey"), "in", "c_custkey"),
        edges(t("supplier"), 2, _key("supplier", "s_suppkey"), _key("nation", "s_nationkey"), "in", "s_suppkey"),
        edges(t("orders"), 3, _key("customer", "o_custkey"), _key("order", "o_orderkey"), "placed", "o_orderkey"),
        edges(bought, 4, _key("order", "l_orderkey"), _key("part", "l_partkey"), "contains", "l_orderkey", c("q"), 1 - c("d")),
    ]
    baskets = t("lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set(_key("part", "l_partkey"))).alias("nodes")).filter("size(nodes) >= 3")
    hyper = baskets.select(_key("basket", "l_orderkey").alias("id"), blank.alias("label"), "nodes", F.lit("together").alias("relation"), F.lit(1.0).alias("confidence_score"), F.col("l_orderkey").alias("ord"))
    union = lambda parts: parts[0] if len(parts) == 1 else parts[0].unionByName(union(parts[1:]))
    return Graph(union(all_nodes), union(all_edges), hyper)


#: The same in SQL, as common table expressions.
NODES = """
nodes as (
  select 'region:' || r_regionkey as id, r_name as label, 'region' as type, '' as description, 0.0::double as importance, r_regionkey::bigint as community, true as is_god from region
  union all select 'nation:' || n_nationkey, n_name, 'nation', '', 0.0, n_regionkey::bigint, false from nation
  union all select 'customer:' || c_custkey, c_name, 'customer', c_mktsegment, greatest(0.0, c_acctbal), n_regionkey::bigint, false from customer left join nation on c_nationkey = n_nationkey
  union all select 'supplier:' || s_suppkey, s_name, 'supplier', '', greatest(0.0, s_acctbal), n_regionkey::bigint, false from supplier left join nation on s_nationkey = n_nationkey
  union all select 'part:' || p_partkey, p_name, 'part', p_brand || ' ' || p_type, p_retailprice, null, false from part
  union all select 'order:' || o_orderkey, 'order:' || o_orderkey, 'order', o_orderpriority, o_totalprice, null, false from orders
)"""
EDGES = """
edges as (
  select 'nation:' || n_nationkey as src, 'region:' || n_regionkey as dst, 'in' as relation, 1.0::double as weight, 1.0::double as confidence_score from nation
  union all select 'customer:' || c_custkey, 'nation:' || c_nationkey, 'in', 1.0, 1.0 from customer
  union all select 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 'in', 1.0, 1.0 from supplier
  union all select 'customer:' || o_custkey, 'order:' || o_orderkey, 'placed', 1.0, 1.0 from orders
  union all select 'order:' || l_orderkey, 'part:' || l_partkey, 'contains', sum(l_quantity), 1 - avg(l_discount) from lineitem group by l_orderkey, l_partkey
)"""
HYPEREDGES = """
hyperedges as (
  select 'basket:' || l_orderkey as id, list_sort(list(distinct 'part:' || l_partkey)) as members from lineitem group by l_orderkey having count(distinct l_partkey) >= 3
)"""
CLIQUES = """
cliques as (
  select a.m as src, b.m as dst, 1.0 / (a.k - 1) as w
  from (select id, unnest(members) as m, len(members) as k from hyperedges) a join (select id, unnest(members) as m from hyperedges) b on a.id = b.id and a.m <> b.m
)"""
ADJACENCY = """
adjacency as (
  select src, dst, sum(w) as w from (
    select src, dst, greatest(weight, 0) * greatest(confidence_score, 0) as w from edges union all select src, dst, w from cliques
  ) group by src, dst having sum(w) > 0
)"""
GRAPH = f"{NODES}, {EDGES}, {HYPEREDGES}, {CLIQUES}, {ADJACENCY}"
