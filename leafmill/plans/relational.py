"""Relational, window and set queries over the star schema and the event table: extensions beyond the document dataflow."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from leafmill.operators import joins
from leafmill.sources.tables import table

QUERIES: dict = {}
ORACLES: dict = {}


def query(oracle: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return register


cents = lambda c: F.floor(c * 100 + 0.5).cast("long")


@query("SELECT l_returnflag, l_linestatus, sum(l_quantity::BIGINT)::BIGINT AS qty, sum(floor(l_extendedprice * 100 + 0.5)::BIGINT)::BIGINT AS price_cents, count(*)::BIGINT AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2")
def pricing_summary(spark, d):
    rows = table(spark, d, "lineitem").filter("l_shipdate <= timestamp'1998-09-02 00:00:00'")
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.sum(F.col("l_quantity").cast("long")).alias("qty"), F.sum(cents(F.col("l_extendedprice"))).alias("price_cents"), F.count(F.lit(1)).alias("n"))


@query("SELECT n_name, sum(floor(l_extendedprice * 100 + 0.5)::BIGINT)::BIGINT AS price_cents FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey AND s_nationkey = c_nationkey GROUP BY n_name")
def local_suppliers(spark, d):
    t = {n: table(spark, d, n) for n in ("region", "nation", "customer", "orders", "lineitem", "supplier")}
    j = t["lineitem"].join(t["orders"], F.col("l_orderkey") == F.col("o_orderkey")).join(t["customer"], F.col("o_custkey") == F.col("c_custkey"))
    j = j.join(t["supplier"], (F.col("l_suppkey") == F.col("s_suppkey")) & (F.col("s_nationkey") == F.col("c_nationkey")))
    j = j.join(t["nation"], F.col("c_nationkey") == F.col("n_nationkey")).join(t["region"], F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy("n_name").agg(F.sum(cents(F.col("l_extendedprice"))).alias("price_cents"))


_GROUPS = "coalesce(o_orderstatus, '') AS o_orderstatus, coalesce(o_orderpriority, '') AS o_orderpriority, gid::INTEGER AS gid, n::BIGINT AS n"


@query(f"SELECT {_GROUPS} FROM (SELECT o_orderstatus, o_orderpriority, grouping(o_orderstatus, o_orderpriority) AS gid, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority))")
def order_cube(spark, d):
    c = table(spark, d, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.grouping_id().alias("gid"), F.count(F.lit(1)).alias("n"))
    return c.select(F.coalesce("o_orderstatus", F.lit("")).alias("o_orderstatus"), F.coalesce("o_orderpriority", F.lit("")).alias("o_orderpriority"), F.col("gid").cast("int").alias("gid"), "n")


@query(f"SELECT {_GROUPS} FROM (SELECT o_orderstatus, o_orderpriority, grouping(o_orderstatus, o_orderpriority) AS gid, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority))")
def order_rollup(spark, d):
    c = table(spark, d, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.grouping_id().alias("gid"), F.count(F.lit(1)).alias("n"))
    return c.select(F.coalesce("o_orderstatus", F.lit("")).alias("o_orderstatus"), F.coalesce("o_orderpriority", F.lit("")).alias("o_orderpriority"), F.col("gid").cast("int").alias("gid"), "n")


@query("SELECT lang, doc_kind, gid::INTEGER AS gid, n::BIGINT AS n FROM (SELECT lang, doc_kind, grouping(lang, doc_kind) AS gid, count(*) AS n FROM documents GROUP BY GROUPING SETS ((lang), (doc_kind), (lang, doc_kind)))")
def document_grouping_sets(spark, d):
    table(spark, d, "documents").createOrReplaceTempView("_documents")
    return spark.sql("SELECT lang, doc_kind, CAST(grouping_id() AS INT) AS gid, count(*) AS n FROM _documents GROUP BY lang, doc_kind GROUPING SETS ((lang), (doc_kind), (lang, doc_kind))")


@query("SELECT o_custkey, o_orderkey, row_number() OVER w AS rn, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderdate) AS rk, ntile(4) OVER w AS quarter, lag(o_orderkey) OVER w AS before, lead(o_orderkey) OVER w AS after, floor(percent_rank() OVER w * 1000 + 0.5)::BIGINT AS pr FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def order_ranks(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, d, "orders").select("o_custkey", "o_orderkey", F.row_number().over(w).cast("long").alias("rn"), F.rank().over(Window.partitionBy("o_custkey").orderBy("o_orderdate")).cast("long").alias("rk"), F.ntile(4).over(w).cast("long").alias("quarter"), F.lag("o_orderkey").over(w).alias("before"), F.lead("o_orderkey").over(w).alias("after"), F.floor(F.percent_rank().over(w) * 1000 + 0.5).cast("long").alias("pr"))


@query("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS last_hour FROM events")
def events_last_hour(spark, d):
    """Rows are laid on their own hour and on the next one, so a window never spans more than two hours of a user."""
    e = table(spark, d, "events").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    e = e.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("later"), F.floor(F.col("us") / 3_600_000_000).alias("hour")).withColumn("hour", F.col("hour") + F.col("later"))
    w = Window.partitionBy("user_id", "hour").orderBy("us").rangeBetween(-3_600_000_000, 0)
    return e.withColumn("last_hour", F.count(F.lit(1)).over(w)).filter("later = 0").select("event_id", "last_hour")


@query("SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'")
def customers_without_urgent_orders(spark, d):
    return table(spark, d, "customer").select("c_custkey").subtract(table(spark, d, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey")))


@query("SELECT l_partkey AS part FROM lineitem WHERE l_quantity >= 45 INTERSECT SELECT p_partkey FROM part WHERE p_size <= 10")
def small_parts_in_bulk(spark, d):
    bulk = table(spark, d, "lineitem").filter("l_quantity >= 45").select(F.col("l_partkey").alias("part"))
    return bulk.intersect(table(spark, d, "part").filter("p_size <= 10").select(F.col("p_partkey").alias("part")))


@query("SELECT user_id, count(*) FILTER (WHERE event_type = 'click')::BIGINT AS click, count(*) FILTER (WHERE event_type = 'view')::BIGINT AS view, count(*) FILTER (WHERE event_type = 'purchase')::BIGINT AS purchase FROM events GROUP BY user_id")
def event_pivot(spark, d):
    p = table(spark, d, "events").groupBy("user_id").pivot("event_type", ["click", "view", "purchase"]).count()
    return p.na.fill(0, ["click", "view", "purchase"])


@query("SELECT event_id, json_extract_string(props, '$.' || k) AS v, k FROM events, (SELECT unnest(json_keys(props)) AS k, event_id AS e FROM events) j WHERE e = event_id")
def event_properties(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", F.explode(F.from_json("props", "map<string,string>")).alias("k", "v"))


@query("""SELECT e.event_id, (SELECT max(p.event_id) FROM events p WHERE p.user_id = e.user_id AND p.event_type = 'view' AND p.ts = (SELECT max(q.ts) FROM events q WHERE q.user_id = e.user_id AND q.event_type = 'view' AND q.ts <= e.ts)) AS view_id FROM events e WHERE e.event_type = 'purchase'""")
def purchase_asof_view(spark, d):
    e = table(spark, d, "events")
    views = e.filter("event_type = 'view'").select("user_id", F.col("ts").alias("view_ts"), F.col("event_id").alias("view_id"))
    buys = e.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    return joins.asof(buys, views, "user_id", "ts", "view_ts", ["view_id"]).select("event_id", "view_id")


@query("SELECT e.event_id, s.event_id AS span_id FROM events e JOIN (SELECT event_id, user_id, epoch(ts)::BIGINT AS b, epoch(ts)::BIGINT + 1800 AS z FROM events WHERE event_type = 'purchase') s ON s.user_id = e.user_id AND epoch(e.ts)::BIGINT >= b AND epoch(e.ts)::BIGINT < z WHERE e.event_type = 'click'")
def clicks_after_purchase(spark, d):
    e = table(spark, d, "events").withColumn("sec", F.unix_timestamp("ts"))
    spans = e.filter("event_type = 'purchase'").select("user_id", F.col("event_id").alias("span_id"), F.col("sec").alias("b"))
    clicks = e.filter("event_type = 'click'").select("user_id", "event_id", "sec")
    return joins.intervals(clicks, spans, "user_id", F.col("sec"), F.col("b"), F.col("b") + 1800, 1800).select("event_id", "span_id")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS no FROM g)
    SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*)::BIGINT AS events FROM s GROUP BY user_id, no""")
def event_sessions(spark, d):
    return joins.sessions(table(spark, d, "events"), "user_id", "ts", 1800)


@query("SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS hour, count(*)::BIGINT AS n FROM events GROUP BY 1, 2")
def hourly_events(spark, d):
    w = table(spark, d, "events").groupBy("event_type", F.window("ts", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return w.select("event_type", F.col("w.start").alias("hour"), "n")


@query("SELECT coalesce(c_custkey, o_custkey) AS k, count(o_orderkey)::BIGINT AS orders, bool_and(c_custkey IS NULL) AS unknown FROM customer FULL JOIN (SELECT * FROM orders WHERE o_orderstatus = 'F') o ON o_custkey = c_custkey GROUP BY 1")
def customers_full_outer(spark, d):
    o = table(spark, d, "orders").filter("o_orderstatus = 'F'")
    j = table(spark, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "full_outer")
    return j.groupBy(F.coalesce("c_custkey", "o_custkey").alias("k")).agg(F.count("o_orderkey").alias("orders"), F.bool_and(F.col("c_custkey").isNull()).alias("unknown"))


@query("SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders) AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 40)")
def large_orders(spark, d):
    o = table(spark, d, "orders")
    mean = o.agg(F.avg("o_totalprice").alias("mean"))
    big = o.join(F.broadcast(mean), F.col("o_totalprice") > F.col("mean"))  # one row
    return big.join(table(spark, d, "lineitem").filter("l_quantity > 40"), F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select("o_orderkey")


@query("SELECT p_brand, l_partkey, qty, rk FROM (SELECT p_brand, l_partkey, qty, row_number() OVER (PARTITION BY p_brand ORDER BY qty DESC, l_partkey)::INTEGER AS rk FROM (SELECT p_brand, l_partkey, sum(l_quantity::BIGINT)::BIGINT AS qty FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2)) WHERE rk <= 3")
def top_parts(spark, d):
    q = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.sum(F.col("l_quantity").cast("long")).alias("qty"))
    q = q.join(table(spark, d, "part").select("p_partkey", "p_brand"), F.col("p_partkey") == F.col("l_partkey"))
    rk = F.row_number().over(Window.partitionBy("p_brand").orderBy(F.col("qty").desc(), "l_partkey"))
    return q.withColumn("rk", rk).filter("rk <= 3").select("p_brand", "l_partkey", "qty", "rk")


@query("WITH RECURSIVE w(user_id, h, n) AS (SELECT user_id, 0, count(*)::BIGINT FROM events GROUP BY 1 UNION ALL SELECT user_id, h + 1, n // 2 FROM w WHERE n > 1) SELECT user_id, max(h)::INTEGER AS halvings FROM w GROUP BY 1")
def halvings(spark, d):
    n = table(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return n.select("user_id", F.floor(F.log2("n")).cast("int").alias("halvings"))
