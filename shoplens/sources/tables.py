"""Read the driver tables and bind them to the standard commerce model.

The standard model has three tables -- orders (fact), products and influencers
(dimensions).  Here they are derived from the TPC-H-like tables with pure column
expressions, so the DuckDB oracle can repeat each binding as a CTE
(``shoplens.plans.oracle``).  Every binding is a lazy DataFrame: Catalyst
prunes the columns a query does not use and pushes date filters into the
``orders`` scan.

Scale notes
-----------
* The order feed repeats ``(l_orderkey, l_linenumber)``; the latest row per key
  wins.  That dedup is a ``groupBy`` + ``max(struct(...))`` -- partial
  aggregation collapses duplicates map-side, so a hot key (even a third of all
  rows) never reaches one reducer as raw rows, unlike a ``row_number`` window.
* It runs on ``lineitem`` alone, before the join: every tie-break column lives
  there and the platform key (``o_orderkey % 3``) equals ``l_orderkey % 3``.
* No explicit ``broadcast()`` on tables that grow with the data (customer,
  part, supplier).  ``nation`` (25 rows) and ``region`` (5 rows) have a fixed
  size by definition and are broadcast; the rest are left to the planner's
  size check (``autoBroadcastJoinThreshold`` / AQE on measured shuffle sizes).
"""

from __future__ import annotations

import datetime as dt
import os
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DRIVER_TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]

# Platform by o_orderkey % 3, currency by region name.
PLATFORM_BY_MOD3 = ["tiktok", "douyin", "manual"]
CURRENCY_BY_REGION = {"AMERICA": "USD", "EUROPE": "EUR", "ASIA": "CNY", "MIDDLE EAST": "AED"}
# Influencer binding: stored is_suspicious uses these thresholds (percent).
BINDING_SUSPICIOUS_ENGAGEMENT = 45.0
BINDING_SUSPICIOUS_CONVERSION = 15.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table; ``timestamp_ntz`` columns become UTC ``timestamp``."""
    df = spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
    casts = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.TimestampNTZType):
            casts.append(F.col(f.name).cast("timestamp").alias(f.name))
        else:
            casts.append(F.col(f.name))
    return df.select(*casts)


def money(c: Column | str, precision: int = 14) -> Column:
    """Cast to ``decimal(precision,2)`` (HALF_UP).  Money stays decimal (rule R1)."""
    return F.col(c).cast(f"decimal({precision},2)") if isinstance(c, str) else c.cast(f"decimal({precision},2)")


def _map_expr(d: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


def latest_lines(spark: SparkSession, sf_dir: str, li: DataFrame | None = None) -> DataFrame:
    """``lineitem`` deduplicated on (l_orderkey, l_linenumber), latest l_shipdate wins.

    Tie-break l_partkey, l_suppkey, l_extendedprice (all descending); unique at
    every scale of the driver data.
    """
    li = table(spark, sf_dir, "lineitem") if li is None else li
    win = F.max(F.struct(
        "l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice",
        "l_discount", "l_quantity", "l_returnflag", "l_linestatus",
    )).alias("w")
    return (li.groupBy("l_orderkey", "l_linenumber").agg(win)
              .select("l_orderkey", "l_linenumber", "w.*"))


def std_orders(spark: SparkSession, sf_dir: str, dedup: bool = True, lines: DataFrame | None = None,
               paid_between: tuple | None = None, by_month: bool = False) -> DataFrame:
    """The standard order fact table (§1.3 of the survey), one row per line.

    ``lines`` replaces the full ``lineitem`` table (e.g. one feed delivery);
    ``dedup=False`` keeps repeated deliveries of a line (a raw feed batch).
    ``paid_between=(lo, hi)`` restricts to orders paid in ``[lo, hi)`` and
    applies that restriction *before* the dedup: every copy of a line shares
    its order, so a left-semi join of the lines against the window's order
    keys (broadcast when the window is small, else a shuffle join) drops the
    out-of-window lines before they are aggregated.  Catalyst cannot push the
    date filter through the dedup aggregate by itself.
    ``by_month`` adds ``paid_month`` ("none" without a paid time) and clusters
    the rows by it: REBALANCE, so each task writes few directories; AQE splits
    a large month across tasks and merges small ones.

    The lines are what is large, so they are shuffled as seldom and as narrow
    as can be: customers meet the orders, not the lines, and the rows are
    clustered before texts are derived from them and the two fixed-size tables
    are joined.
    """
    src = table(spark, sf_dir, "lineitem") if lines is None else lines
    o = table(spark, sf_dir, "orders")
    if paid_between is not None:
        lo, hi = paid_between
        in_window = (F.col("o_orderdate") >= F.lit(lo)) & (F.col("o_orderdate") < F.lit(hi))
        o = o.where(in_window)
        keys = table(spark, sf_dir, "orders").where(in_window).select(F.col("o_orderkey").alias("_wkey"))
        src = src.join(keys, F.col("l_orderkey") == F.col("_wkey"), "left_semi")
    li = latest_lines(spark, sf_dir, src) if dedup else src
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    n = F.broadcast(table(spark, sf_dir, "nation"))
    r = F.broadcast(table(spark, sf_dir, "region"))
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")

    oc = o.select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority").join(c, o.o_custkey == c.c_custkey)
    j = (li.join(oc, F.col("l_orderkey") == F.col("o_orderkey"))
           .join(p, F.col("l_partkey") == F.col("p_partkey"))
           .join(s, F.col("l_suppkey") == F.col("s_suppkey")))
    j = j.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_discount", "l_quantity", "l_returnflag",
                 "l_linestatus", "l_shipdate", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority", "c_nationkey",
                 "p_name", "s_name", "s_nationkey",
                 *([F.coalesce(F.date_format("o_orderdate", "yyyy-MM"), F.lit("none")).alias("paid_month")] if by_month else []))
    if by_month:
        j = j.hint("rebalance", "paid_month")
    j = j.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))

    gmv = (money("l_extendedprice") * (F.lit(1) - F.col("l_discount").cast("decimal(4,2)"))).cast("decimal(14,2)")
    platform = F.element_at(F.array(*[F.lit(x) for x in PLATFORM_BY_MOD3]),
                            (F.col("o_orderkey") % 3 + 1).cast("int"))
    status = (F.when(F.col("l_returnflag") == "R", "refunded")
               .when(F.col("l_linestatus") == "F", "completed")
               .when(F.col("o_orderstatus") == "P", "paid")
               .otherwise("shipped"))
    return j.select(
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("order_id"),
        F.when(F.col("l_suppkey") % 10 != 0,
               F.concat(F.lit("SHOP_"), (F.col("l_suppkey") % 10).cast("string"))).alias("shop_id"),
        platform.alias("platform"),
        F.col("l_partkey").cast("string").alias("product_id"),
        F.col("p_name").alias("product_name"),
        gmv.alias("gmv"),
        F.col("l_quantity").cast("int").alias("quantity"),
        F.col("o_custkey").cast("string").alias("customer_id"),
        F.when(F.col("o_custkey") % 10 < 7, F.floor(F.col("o_custkey") / 10).cast("string")).alias("creator_id"),
        status.alias("status"),
        F.col("o_orderdate").alias("paid_at"),
        F.when(F.col("n_nationkey") % 7 != 0, F.col("n_name")).alias("province"),
        F.concat(F.lit("SKU"), F.col("l_partkey").cast("string"), F.lit("-"),
                 F.col("l_suppkey").cast("string")).alias("sku_id"),
        _map_expr(CURRENCY_BY_REGION)[F.col("r_name")].alias("currency"),
        F.col("r_name").alias("site_code"),
        money("l_extendedprice").alias("original_price"),
        ((F.col("o_orderpriority") == "1-URGENT") & (F.col("l_linenumber") == 1)).alias("is_sample_order"),
        (F.col("o_orderpriority") == "5-LOW").alias("is_cod"),
        F.when(F.col("s_nationkey") % 5 != 0, F.col("s_name")).alias("shipping_provider"),
        F.col("o_orderdate").alias("rts_time"),
        F.when(F.col("l_linestatus") != "O",
               F.col("o_orderdate") + F.make_dt_interval(F.col("l_linenumber"))).alias("delivery_time"),
        F.col("l_shipdate").alias("update_time"),
        *(["paid_month"] if by_month else []),
    )


def std_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products = part x {tiktok, douyin}; manual-platform orders stay unmatched."""
    p = table(spark, sf_dir, "part")
    plats = F.array(F.lit("tiktok"), F.lit("douyin"))
    return p.select(
        F.col("p_partkey").cast("string").alias("product_id"),
        F.explode(plats).alias("platform"),
        F.col("p_name").alias("name"),
        F.col("p_type").alias("category"),
        money("p_retailprice", 12).alias("price"),
        F.lit(0).cast("decimal(14,2)").alias("total_gmv"),
        F.lit(0).cast("bigint").alias("total_sold"),
    )


def std_influencers(spark: SparkSession, sf_dir: str, orders: DataFrame | None = None) -> DataFrame:
    """Influencers = events per user_id, with order roll-up (gmv, orders, roi).

    engagement_rate = 100 * (view + click) / events, conversion_rate =
    100 * purchase / events (percent units), cost = sum of purchase values,
    followers = events * 1000.  gmv / orders come from attributed standard
    orders (refunded excluded from gmv); roi = gmv / cost.
    """
    ev = table(spark, sf_dir, "events")
    base = ev.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("event_type").isin("view", "click")).alias("n_eng"),
        F.count_if(F.col("event_type") == "purchase").alias("n_buy"),
        F.sum(F.when(F.col("event_type") == "purchase", money("value"))).alias("cost"),
    )
    if orders is None:
        orders = std_orders(spark, sf_dir)
    roll = (orders.where(F.col("creator_id").isNotNull())
                  .groupBy("creator_id")
                  .agg(F.sum(F.when(F.col("status") != "refunded", F.col("gmv")).otherwise(0)).alias("gmv"),
                       F.count(F.lit(1)).alias("orders")))
    eng = F.round(F.col("n_eng") * 100.0 / F.col("n"), 4)
    conv = F.round(F.col("n_buy") * 100.0 / F.col("n"), 4)
    inf = base.select(
        F.col("user_id").cast("string").alias("creator_id"),
        F.element_at(F.array(*[F.lit(x) for x in PLATFORM_BY_MOD3]), (F.col("user_id") % 3 + 1).cast("int")).alias("platform"),
        F.concat(F.lit("KOL"), F.lpad(F.col("user_id").cast("string"), 5, "0")).alias("name"),
        F.element_at(F.array(*[F.lit(x) for x in ["beauty", "fashion", "digital", "home", "food"]]),
                     (F.col("user_id") % 5 + 1).cast("int")).alias("category"),
        (F.col("n") * 1000).cast("bigint").alias("followers"),
        F.coalesce(F.col("cost"), F.lit(0).cast("decimal(14,2)")).cast("decimal(14,2)").alias("cost"),
        eng.alias("engagement_rate"),
        conv.alias("conversion_rate"),
        ((eng >= BINDING_SUSPICIOUS_ENGAGEMENT) & (conv < BINDING_SUSPICIOUS_CONVERSION)).alias("is_suspicious"),
    )
    out = inf.join(roll, "creator_id", "left")
    g = F.coalesce(F.col("gmv"), F.lit(0).cast("decimal(14,2)")).cast("decimal(14,2)")
    return out.select(
        "creator_id", "platform", "name", "category", "followers",
        g.alias("gmv"),
        F.coalesce(F.col("orders"), F.lit(0)).cast("bigint").alias("orders"),
        "cost",
        F.when(F.col("cost") > 0, F.round(g.cast("double") / F.col("cost").cast("double"), 2)).alias("roi"),
        "engagement_rate", "conversion_rate",
        F.floor(F.col("followers") / 50).cast("bigint").alias("avg_views"),
        "is_suspicious",
    )


# ---------------------------------------------------------------- stored standard model
_STORED: dict[tuple, str] = {}
_STORED_DF: dict[tuple, DataFrame] = {}
PREPARE_SECONDS: dict[str, float] = {}


def _fingerprint(sf_dir: str, names: list[str]) -> tuple:
    """Sizes and mtimes of the source files (local paths), so a stored model
    is rebuilt when its inputs change; remote paths use the path alone."""
    out = []
    for n in names:
        p = os.path.join(sf_dir, f"{n}.parquet")
        try:
            st = os.stat(p)
            out.append((n, st.st_size, int(st.st_mtime)))
        except OSError:
            out.append((n, None, None))
    return tuple(out)


def stored(spark: SparkSession, sf_dir: str, name: str, build, sources: list[str],
           partition_by: list[str] | None = None) -> DataFrame:
    """The standard table ``name`` for ``sf_dir``, written once per session
    under ``spark.checkpoint.dir`` and read back.  This is the ingest step of
    the model: dashboards query the stored table (as the source system's
    dashboards query its standard tables), and the write cuts the lineage of
    the 7-way binding join and the dedup."""
    from shoplens.session import app_id, checkpoint_root, shuffles_freed
    key = (app_id(spark), os.path.abspath(sf_dir), name, _fingerprint(sf_dir, sources))
    path = _STORED.get(key)
    if path is None:
        t0 = time.perf_counter()
        path = os.path.join(checkpoint_root(spark), "model", f"{name}-{uuid.uuid4().hex}")
        # the frame comes clustered by the partition columns (``std_orders``)
        w = build().write.mode("overwrite")
        if partition_by:
            w = w.partitionBy(*partition_by)
        with shuffles_freed(spark):
            w.parquet(path)
        _STORED[key] = path
        PREPARE_SECONDS[f"{os.path.basename(os.path.normpath(sf_dir))}/{name}"] = round(time.perf_counter() - t0, 3)
    # one DataFrame per stored table and session: its file index (the listing
    # of the month directories) is built once and reused by every query
    df = _STORED_DF.get(key)
    if df is None or df.sparkSession is not spark:
        df = spark.read.parquet(path)
        _STORED_DF[key] = df
    return df


def landed(spark: SparkSession, sf_dir: str, name: str, write, sources: list[str]) -> str:
    """A folder of generated input files (feed pages, upload exports) for
    ``sf_dir``, written once per session by ``write(path)`` under
    ``spark.checkpoint.dir``.  These are the inputs the feed and upload
    operators read -- files that already exist in a real deployment."""
    from shoplens.session import app_id, checkpoint_root, shuffles_freed
    key = (app_id(spark), os.path.abspath(sf_dir), "landed:" + name, _fingerprint(sf_dir, sources))
    path = _STORED.get(key)
    if path is None:
        t0 = time.perf_counter()
        path = os.path.join(checkpoint_root(spark), "landing", f"{name}-{uuid.uuid4().hex}")
        with shuffles_freed(spark):
            write(path)
        _STORED[key] = path
        PREPARE_SECONDS[f"{os.path.basename(os.path.normpath(sf_dir))}/landing:{name}"] = round(time.perf_counter() - t0, 3)
    return path


# Records in the pages of a landed file, at most: one task reads a compressed file.
RECORDS_PER_FILE = 500_000


def land_pages(bodies: DataFrame, path: str, mode: str = "error", records_per_page: int = 1) -> None:
    """Feed pages (``body``) as text files, one page per line; compressed, as
    pages repeat the names of all fields in every record and take several times
    the room of the tables they are made of."""
    (bodies.select(F.regexp_replace("body", r"[\r\n]+", " ").alias("value"))
     .write.option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE // records_per_page).mode(mode).text(path))


ORDER_SOURCES = ["lineitem", "orders", "customer", "nation", "region", "part", "supplier"]


def _month(d: dt.datetime) -> str:
    return d.strftime("%Y-%m")


class Model:
    """The three standard tables for one data directory.

    All three are stored once per session (``stored``) unless ``store=False``;
    orders are partitioned by ``paid_month`` so a paid-date window prunes
    partitions.
    """

    def __init__(self, spark: SparkSession, sf_dir: str, store: bool = True):
        self.spark, self.sf_dir, self.store = spark, sf_dir, store
        self._products = self._influencers = None

    def _orders_table(self) -> DataFrame:
        if not self.store:
            return std_orders(self.spark, self.sf_dir).withColumn("paid_month", F.date_format("paid_at", "yyyy-MM"))
        build = lambda: std_orders(self.spark, self.sf_dir, by_month=True)
        return stored(self.spark, self.sf_dir, "std_orders", build, ORDER_SOURCES, ["paid_month"])

    @property
    def orders(self) -> DataFrame:
        return self._orders_table().drop("paid_month")

    def orders_between(self, lo: dt.datetime, hi: dt.datetime) -> DataFrame:
        """Orders paid in ``[lo, hi)``; the month bounds prune partitions."""
        if not self.store:
            return std_orders(self.spark, self.sf_dir, paid_between=(lo, hi))
        t = self._orders_table()
        last = hi - dt.timedelta(microseconds=1)
        t = t.where((F.col("paid_month") >= _month(lo)) & (F.col("paid_month") <= _month(last)))
        return t.where((F.col("paid_at") >= F.lit(lo)) & (F.col("paid_at") < F.lit(hi))).drop("paid_month")

    def orders_in(self, window, previous: bool = False) -> DataFrame:
        """Standard orders restricted to a window (and its previous period)."""
        lo = window.prev_start if previous else window.start
        return self.orders_between(lo, window.end)

    @property
    def products(self) -> DataFrame:
        if self._products is None:
            if self.store:
                self._products = stored(self.spark, self.sf_dir, "std_products",
                                        lambda: std_products(self.spark, self.sf_dir), ["part"])
            else:
                self._products = std_products(self.spark, self.sf_dir)
        return self._products

    @property
    def influencers(self) -> DataFrame:
        if self._influencers is None:
            if self.store:
                self._influencers = stored(self.spark, self.sf_dir, "std_influencers",
                                           lambda: std_influencers(self.spark, self.sf_dir, self.orders),
                                           ORDER_SOURCES + ["events"])
            else:
                self._influencers = std_influencers(self.spark, self.sf_dir, self.orders)
        return self._influencers

    def raw(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)


def build_standard_model(spark: SparkSession, sf_dir: str, out_dir: str) -> dict[str, str]:
    """Write the three standard tables under ``out_dir`` (orders partitioned
    by ``paid_month`` after a rebalance) -- the batch ingest job of a
    deployment.  Returns the table paths; read them with ``StoredModel``."""
    paths = {n: os.path.join(out_dir, n) for n in ("std_orders", "std_products", "std_influencers")}
    std_orders(spark, sf_dir, by_month=True).write.mode("overwrite").partitionBy("paid_month").parquet(paths["std_orders"])
    stored_orders = spark.read.parquet(paths["std_orders"]).drop("paid_month")
    std_products(spark, sf_dir).write.mode("overwrite").parquet(paths["std_products"])
    std_influencers(spark, sf_dir, stored_orders).write.mode("overwrite").parquet(paths["std_influencers"])
    return paths


class StoredModel(Model):
    """The standard model read from tables written by ``build_standard_model``
    (or by the upsert jobs); raw driver tables are not needed."""

    def __init__(self, spark: SparkSession, model_dir: str):
        super().__init__(spark, sf_dir=model_dir, store=True)
        self.model_dir = model_dir

    def _orders_table(self) -> DataFrame:
        return self.spark.read.parquet(os.path.join(self.model_dir, "std_orders"))

    @property
    def products(self) -> DataFrame:
        return self.spark.read.parquet(os.path.join(self.model_dir, "std_products"))

    @property
    def influencers(self) -> DataFrame:
        return self.spark.read.parquet(os.path.join(self.model_dir, "std_influencers"))
