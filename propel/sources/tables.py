"""Base-table loader and the business views the operators run on.

The driver's parquet tables are TPC-H shaped; the views put the reference's
input shapes on them (ratings, customers, transactions, predictions, ...).
Each view is a lazy DataFrame: Catalyst prunes the columns and pushes the
filters of whatever query uses it down into the parquet scans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BASE_TABLES = ("region nation customer supplier part orders lineitem events documents "
               "embeddings pages benchmark labels conversations").split()


class Tables:
    """Lazy access to ``<sf_dir>/<name>.parquet`` plus the derived views."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def base(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    __call__ = base

    # ---- views -------------------------------------------------------------
    def _lineitem_orders(self) -> DataFrame:
        li = self.base("lineitem")
        o = self.base("orders").select("o_orderkey", "o_custkey", "o_orderdate")
        return li.join(o, li.l_orderkey == o.o_orderkey)

    def ratings(self) -> DataFrame:
        return self._lineitem_orders().select(
            F.col("o_custkey").alias("user_id"),
            F.col("l_partkey").alias("movie_id"),
            (F.lit(1) + F.col("l_quantity").cast("int") % 5).alias("rating"),
            F.col("l_shipdate").cast("timestamp").alias("date"))

    def movies(self) -> DataFrame:
        p = self.base("part")
        return p.select(
            F.col("p_partkey").alias("movie_id"),
            F.when(F.col("p_size") == 50, F.lit(None)).otherwise(F.lit(1970) + F.col("p_size")).alias("year"),
            F.col("p_name").alias("title"))

    def transactions(self) -> DataFrame:
        o = self.base("orders")
        return o.select(
            F.col("o_custkey").alias("customer_id"),
            F.col("o_orderdate").alias("transaction_date"),
            F.col("o_totalprice").alias("amount"))

    def services(self) -> DataFrame:
        return (self._lineitem_orders()
                .where(F.col("l_returnflag") == "N")
                .select(F.col("o_custkey").alias("customer_id"),
                        F.col("l_shipdate").alias("last_service_date")))

    def claims(self) -> DataFrame:
        return (self._lineitem_orders()
                .where(F.col("l_returnflag") == "R")
                .select(F.col("o_custkey").alias("customer_id"),
                        F.col("l_shipdate").alias("last_claim_date")))

    def lost_quotations(self) -> DataFrame:
        o = self.base("orders")
        return (o.where(F.col("o_orderstatus") == "P")
                .select(F.col("o_custkey").alias("customer_id"),
                        F.col("o_orderdate").alias("lost_date"),
                        F.col("o_orderstatus").alias("competitor"),
                        F.col("o_totalprice").alias("competitor_price")))

    def products(self) -> DataFrame:
        p = self.base("part").select("p_partkey", "p_type")
        lo = self._lineitem_orders().where(F.col("l_returnflag") == "A")
        return (lo.join(p, lo.l_partkey == p.p_partkey)
                .select(F.col("o_custkey").alias("customer_id"), F.col("p_type").alias("product"))
                .distinct())

    def customers(self) -> DataFrame:
        c = self.base("customer")
        n = self.base("nation").select("n_nationkey", "n_regionkey")
        r = self.base("region").select("r_regionkey", "r_name")
        acq = (self.base("orders").groupBy("o_custkey")
               .agg(F.min("o_orderdate").alias("acquisition_date")))
        prod = (self.products().groupBy("customer_id")
                .agg(F.concat_ws(",", F.sort_array(F.collect_set("product"))).alias("products_owned_str")))
        # nation/region are dimension tables of fixed size (25 / 5 rows)
        base = (c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey)
                .join(F.broadcast(r), F.col("n_regionkey") == r.r_regionkey))
        return (base.join(acq, c.c_custkey == acq.o_custkey, "left")
                .join(prod, c.c_custkey == prod.customer_id, "left")
                .select(F.col("c_custkey").alias("customer_id"),
                        F.col("c_name").alias("name"),
                        F.col("r_name").alias("region"),
                        (F.lit(18) + F.col("c_custkey") % 57).alias("age"),
                        F.col("c_acctbal").alias("income"),
                        F.col("acquisition_date"),
                        F.col("products_owned_str"),
                        (F.col("c_custkey") % 7 == 0).alias("renewal_in_30_days")))

    def predictions(self) -> DataFrame:
        e = self.base("events")
        return (e.where(F.col("event_type").isin("view", "click"))
                .select(F.col("event_id").alias("id"),
                        F.col("user_id").alias("customer_id"),
                        ((F.col("event_id") * 7919 % 10007) / F.lit(10007.0)).alias("propensity_score"),
                        F.when(F.col("event_id") % 3 == 0, "v1").otherwise("v2").alias("model_version"),
                        F.col("ts").alias("created_at")))

    def feedback(self) -> DataFrame:
        e = self.base("events").crossJoin(self._agent_count())
        return (e.where(F.col("event_type") != "view")
                .select(F.col("event_id").alias("id"),
                        F.col("user_id").alias("customer_id"),
                        F.concat(F.lit("AGT-"), ((F.col("user_id") + F.col("event_id")) % F.col("_agents")).cast("string")).alias("agent_id"),
                        F.col("event_type").alias("action_taken"),
                        F.when(F.col("event_type") == "purchase", "converted")
                         .when(F.col("event_type") == "error", "not_converted")
                         .otherwise("pending").alias("outcome"),
                        F.col("ts").alias("created_at")))

    def agents(self) -> DataFrame:
        s = self.base("supplier")
        n = self.base("nation").select("n_nationkey", "n_name")
        return (s.join(F.broadcast(n), s.s_nationkey == n.n_nationkey)
                .select(F.concat(F.lit("AGT-"), F.col("s_suppkey").cast("string")).alias("agent_id"),
                        F.col("s_name").alias("name"), F.col("n_name").alias("region")))

    def assignments(self) -> DataFrame:
        c = self.base("customer").crossJoin(self._agent_count())
        return c.select(F.concat(F.lit("AGT-"), (F.col("c_custkey") % F.col("_agents")).cast("string")).alias("agent_id"),
                        F.col("c_custkey").alias("customer_id"))

    def _agent_count(self) -> DataFrame:
        """One row: customers and feedback are dealt over all suppliers by their keys."""
        return F.broadcast(self.base("supplier").agg(F.count(F.lit(1)).alias("_agents")))

    def request_log(self) -> DataFrame:
        e = self.base("events")
        return e.select(
            "event_id", "ts", F.col("user_id").alias("client"), F.col("event_type").alias("endpoint"),
            F.when(F.col("event_type") == "error", 500).when(F.col("value") > 150, 404).otherwise(200).alias("status"),
            (F.col("value") / F.lit(100.0)).alias("duration_seconds"),
            (F.col("event_id") % 4 == 0).alias("cache_hit"))

    def scored(self) -> DataFrame:
        d = self.base("documents").select("doc_id", "n_chars")
        lab = self.base("labels").select("doc_id", "quality")
        return (d.join(lab, "doc_id")
                .select(F.col("doc_id").alias("id"), F.col("quality").alias("label"),
                        F.least(F.col("n_chars") / F.lit(2000.0), F.lit(1.0)).alias("score")))
