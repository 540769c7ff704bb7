"""Queries of the time-series, alert, event and relational operators, with the SQL each is compared with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opsloom.operators import evaluation, folds, timeseries
from opsloom.sources.tables import table


def _events(spark: SparkSession, d: str) -> DataFrame:
    """Events with their second since 1970. Ties within a series go by event id."""
    return table(spark, d, "events").withColumn("s", F.unix_seconds(F.col("ts").cast("timestamp")))


def counter_rate(spark, d):
    """Increase and rate by day of each user's value read as a counter, with its resets."""
    grown = timeseries.rate(_events(spark, d).select("user_id", F.struct("s", "event_id").alias("at"), "s", "value"), ["user_id"], "s", "value", 86400)
    return grown.select("user_id", "bucket", F.round("increase", 4).alias("increase"), F.round("rate", 8).alias("rate"))


COUNTER_RATE = """
    WITH l AS (SELECT user_id, epoch_us(ts) // 1000000 AS s, value, lag(value) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000000, value) AS b FROM events)
    SELECT user_id, s // 86400 * 86400 AS bucket, round(sum(CASE WHEN b IS NULL THEN 0 WHEN value < b THEN value ELSE value - b END), 4) AS increase,
      round(sum(CASE WHEN b IS NULL THEN 0 WHEN value < b THEN value ELSE value - b END) / 86400, 8) AS rate FROM l GROUP BY 1, 2"""


def grid_values(spark, d):
    """The latest value of each event type on a six-hour grid, unless older than a day."""
    last = _events(spark, d).groupBy("event_type", "s").agg(F.max("value").alias("value"))
    return timeseries.on_grid(last, ["event_type"], "s", "value", 21600, 86400)


GRID_VALUES = """
    WITH e AS (SELECT event_type, epoch_us(ts) // 1000000 AS s, max(value) AS value FROM events GROUP BY 1, 2),
    n AS (SELECT *, lead(s) OVER (PARTITION BY event_type ORDER BY s) AS nx FROM e),
    g AS (SELECT event_type, value, (s + 21599) // 21600 * 21600 AS a, least(s + 86400, coalesce(nx - 1, s + 86400)) // 21600 * 21600 AS b FROM n)
    SELECT event_type, unnest(range(a, b + 1, 21600)) AS at, value FROM g WHERE a <= b"""

BOUNDS = [1, 5, 10, 25, 50, 100, 250]


def bucket_quantiles(spark, d):
    """The 95th percentile of each type's values, from cumulative buckets."""
    bounds = F.array(*(F.lit(float(b)) for b in BOUNDS), F.lit(float("inf")))
    e = table(spark, d, "events").select("event_type", "value", F.explode(bounds).alias("le"))
    counted = e.groupBy("event_type", "le").agg(F.sum(F.when(F.col("value") <= F.col("le"), 1).otherwise(0)).alias("n"))
    found = timeseries.bucket_quantile(counted, ["event_type"], "le", "n", 0.95)
    return found.select("event_type", F.round("value", 3).alias("p95"))


BUCKET_QUANTILES = f"""
    WITH b AS (SELECT unnest({BOUNDS})::DOUBLE AS le UNION ALL SELECT 'infinity'::DOUBLE),
    c AS (SELECT event_type, le, count(*) FILTER (value <= le) AS n FROM events, b GROUP BY 1, 2),
    w AS (SELECT *, max(n) OVER (PARTITION BY event_type) * 0.95 AS want, lag(le, 1, 0) OVER o AS low, lag(n, 1, 0) OVER o AS below FROM c WINDOW o AS (PARTITION BY event_type ORDER BY le))
    SELECT event_type, round(CASE WHEN isinf(le) THEN low ELSE coalesce(low + (le - low) * (want - below) / nullif(n - below, 0), le) END, 3) AS p95
    FROM w WHERE n >= want QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY le) = 1"""


def held_conditions(spark, d):
    """Stretches of at least three hours in a row with twice the usual errors: conditions that held long enough to fire."""
    hourly = _events(spark, d).filter("event_type = 'error'").groupBy((F.floor(F.col("s") / 3600)).alias("hour")).agg(F.count("*").alias("n"))
    span = hourly.agg(F.min("hour").alias("a"), F.max("hour").alias("b"), (F.sum("n") / (F.max("hour") - F.min("hour") + 1)).alias("usual"))
    grid = span.select(F.explode(F.sequence("a", "b")).alias("hour"), "usual").withColumn("series", F.lit("error"))
    points = grid.join(hourly, "hour", "left").select("series", "hour", "usual", F.coalesce("n", F.lit(0)).alias("n"))
    runs = timeseries.runs_of(points, ["series"], "hour", F.col("n") > F.col("usual"))
    return runs.filter("points >= 3").select("series", "start", "end", "points")


HELD_CONDITIONS = """
    WITH h AS (SELECT epoch_us(ts) // 1000000 // 3600 AS hour, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1),
    s AS (SELECT min(hour) AS a, max(hour) AS b, sum(n) / (max(hour) - min(hour) + 1) AS usual FROM h),
    g AS (SELECT unnest(range(a, b + 1)) AS hour, usual FROM s),
    p AS (SELECT g.hour, coalesce(n, 0) > usual AS holds FROM g LEFT JOIN h USING (hour)),
    r AS (SELECT hour, hour - row_number() OVER (ORDER BY hour) AS run FROM p WHERE holds)
    SELECT 'error' AS series, min(hour) AS start, max(hour) AS "end", count(*) AS points FROM r GROUP BY run HAVING count(*) >= 3"""


def trends(spark, d):
    """Slope and correlation of each type's hourly mean."""
    hourly = _events(spark, d).groupBy("event_type", F.floor(F.col("s") / 3600).alias("hour")).agg(F.round(F.avg("value"), 6).alias("value"))
    t = timeseries.trend(hourly, ["event_type"], "hour", "value")
    return t.select("event_type", F.round("slope", 5).alias("slope"), F.round("r", 5).alias("r"))


TRENDS = """
    WITH h AS (SELECT event_type, epoch_us(ts) // 1000000 // 3600 AS hour, round(avg(value), 6) AS value FROM events GROUP BY 1, 2)
    SELECT event_type, round(coalesce(regr_slope(value, hour), 0), 5) AS slope, round(coalesce(corr(value, hour), 0), 5) AS r FROM h GROUP BY 1"""


def user_sessions(spark, d):
    s = timeseries.sessions(_events(spark, d), ["user_id"], "s", 1800)
    return s.groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("events").alias("most_events"), F.max(F.col("end") - F.col("start")).alias("longest_s"))


USER_SESSIONS = """
    WITH l AS (SELECT user_id, epoch_us(ts) // 1000000 AS s, lag(epoch_us(ts) // 1000000) OVER (PARTITION BY user_id ORDER BY ts) AS b FROM events),
    n AS (SELECT user_id, s, sum(CASE WHEN b IS NULL OR s - b > 1800 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY s RANGE UNBOUNDED PRECEDING) AS no FROM l),
    g AS (SELECT user_id, no, count(*) AS events, max(s) - min(s) AS len FROM n GROUP BY 1, 2)
    SELECT user_id, count(*) AS sessions, max(events) AS most_events, max(len) AS longest_s FROM g GROUP BY 1"""


def last_change(spark, d):
    """Each error with the user's latest sign-up in the day before it: an as-of join."""
    e = _events(spark, d)
    errors = e.filter("event_type = 'error'").select("event_id", "user_id", "s")
    changes = e.filter("event_type = 'signup'").groupBy("user_id", F.col("s").alias("t")).agg(F.max("event_id").alias("change_id"))
    return timeseries.latest_before(errors, changes, "user_id", "s", "t", 86400, ["change_id"])


LAST_CHANGE = """
    WITH e AS (SELECT event_id, user_id, event_type, epoch_us(ts) // 1000000 AS s FROM events),
    c AS (SELECT user_id, s AS t, max(event_id) AS change_id FROM e WHERE event_type = 'signup' GROUP BY 1, 2)
    SELECT e.event_id, e.user_id, e.s, CASE WHEN e.s - c.t <= 86400 THEN c.change_id END AS change_id
    FROM (SELECT * FROM e WHERE event_type = 'error') e ASOF LEFT JOIN c ON e.user_id = c.user_id AND e.s >= c.t"""


def request_limit(spark, d):
    """Accepted and rejected requests under a sliding limit of two in ten hours per user."""
    limited = folds.sliding_limit(_events(spark, d), "user_id", "s", "event_id", 2, 36000)
    return limited.groupBy("user_id").agg(F.count_if("accepted").alias("accepted"), F.count_if(~F.col("accepted")).alias("rejected"))


def token_buckets(spark, d):
    e = folds.token_bucket(_events(spark, d), "user_id", "s", "event_id", 1 / 36000, 2.0)
    return e.groupBy("user_id").agg(F.count_if("accepted").alias("accepted"), F.count_if(~F.col("accepted")).alias("rejected"))


def breakers(spark, d):
    e = _events(spark, d).withColumn("failed", F.col("event_type") == "error")
    b = folds.circuit_breaker(e, "user_id", "s", "event_id", "failed", 2, 86400)
    return b.groupBy("user_id", "state").agg(F.count_if("admitted").alias("admitted"), F.count_if(~F.col("admitted")).alias("refused"))


# Each fold again as a recursion over the rows of a user, one step at a time.
_ROWS = "o AS (SELECT user_id, event_id, event_type, epoch_us(ts) // 1000000 AS s, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000000, event_id) AS n FROM events)"
REQUEST_LIMIT = f"""WITH RECURSIVE {_ROWS}, f AS (SELECT user_id, n, [s] AS acc, true AS ok FROM o WHERE n = 1
      UNION ALL SELECT user_id, n, CASE WHEN len(kept) < 2 THEN list_append(kept, s) ELSE kept END, len(kept) < 2 FROM (SELECT o.user_id, o.n, o.s, list_filter(f.acc, lambda x: x >= o.s - 36000) AS kept FROM f JOIN o ON o.user_id = f.user_id AND o.n = f.n + 1))
    SELECT user_id, count(*) FILTER (ok) AS accepted, count(*) FILTER (NOT ok) AS rejected FROM f GROUP BY 1"""
TOKEN_BUCKETS = f"""WITH RECURSIVE {_ROWS}, f AS (SELECT user_id, n, s, 1.0::DOUBLE AS left_, true AS ok FROM o WHERE n = 1
      UNION ALL SELECT user_id, n, s, CASE WHEN l < 1 THEN l ELSE l - 1 END, l >= 1 FROM (SELECT o.user_id, o.n, o.s, least(2.0::DOUBLE, f.left_ + (o.s - f.s) * (1.0::DOUBLE / 36000)) AS l FROM f JOIN o ON o.user_id = f.user_id AND o.n = f.n + 1))
    SELECT user_id, count(*) FILTER (ok) AS accepted, count(*) FILTER (NOT ok) AS rejected FROM f GROUP BY 1"""
BREAKERS = f"""WITH RECURSIVE {_ROWS}, f AS (SELECT user_id, 0 AS n, 'closed' AS state, 0 AS fails, 0 AS since, false AS ok FROM (SELECT DISTINCT user_id FROM o)
      UNION ALL SELECT user_id, n, CASE WHEN st = 'open' THEN 'open' WHEN NOT bad THEN 'closed' WHEN st = 'half_open' OR fails + 1 >= 2 THEN 'open' ELSE st END,
        CASE WHEN st = 'open' THEN fails WHEN bad THEN fails + 1 ELSE 0 END, CASE WHEN st <> 'open' AND bad AND (st = 'half_open' OR fails + 1 >= 2) THEN s ELSE since END, st <> 'open'
      FROM (SELECT o.user_id, o.n, o.s, f.fails, f.since, o.event_type = 'error' AS bad, CASE WHEN f.state = 'open' AND o.s - f.since >= 86400 THEN 'half_open' ELSE f.state END AS st FROM f JOIN o ON o.user_id = f.user_id AND o.n = f.n + 1))
    SELECT user_id, state, count(*) FILTER (ok) AS admitted, count(*) FILTER (NOT ok) AS refused FROM f WHERE n > 0 GROUP BY 1, 2"""


def noise_share(spark, d):
    """Deliveries against different alerts by service: how much of the flow repeats itself."""
    t = table(spark, d, "alert_deliveries").withColumn("service", F.col("labels")["service"])
    g = t.groupBy("service").agg(F.count("*").alias("deliveries"), F.count_distinct(F.lower(F.trim("fingerprint"))).alias("alerts"))
    return g.select("service", "deliveries", "alerts", F.round(1 - F.col("alerts") / F.greatest(F.col("deliveries"), F.lit(1)), 6).alias("reduction"))


NOISE_SHARE = """
    SELECT labels['service'] AS service, count(*) AS deliveries, count(DISTINCT lower(trim(fingerprint, ' '))) AS alerts,
      round(1 - count(DISTINCT lower(trim(fingerprint, ' '))) / greatest(count(*), 1), 6) AS reduction FROM alert_deliveries GROUP BY 1"""


def inhibited(spark, d):
    """Warnings of an instance that also has a critical alert in the same hour, left out by an anti-join."""
    t = table(spark, d, "alert_deliveries").select(
        "delivery_id", F.col("labels")["severity"].alias("severity"), F.col("labels")["instance"].alias("instance"),
        F.floor(F.unix_seconds(F.col("received_at").cast("timestamp")) / 3600).alias("hour"),
    )
    critical = t.filter("severity = 'critical'").select("instance", "hour").distinct()
    kept = t.filter("severity = 'warning'").join(critical, ["instance", "hour"], "left_anti")
    return kept.groupBy("instance").agg(F.count("*").alias("warnings"))


INHIBITED = """
    WITH t AS (SELECT delivery_id, labels['severity'] AS severity, labels['instance'] AS instance, epoch_us(received_at) // 1000000 // 3600 AS hour FROM alert_deliveries)
    SELECT instance, count(*) AS warnings FROM t WHERE severity = 'warning' AND NOT EXISTS
      (SELECT 1 FROM t c WHERE c.severity = 'critical' AND c.instance = t.instance AND c.hour = t.hour) GROUP BY 1"""


def topology(spark, d, quantity: int = 50, lines: int = 3):
    """Nations that a supplier's nation reaches in one or two hops over who buys much from whom.

    An edge stands for at least ``lines`` order lines of at least ``quantity`` pieces each, as in the SQL; other lines don't count.
    """
    line, orders, customer = (table(spark, d, n) for n in ("lineitem", "orders", "customer"))
    supplier = table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("src"))
    big = line.filter(F.col("l_quantity") >= quantity).join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    sold = big.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customer, F.col("o_custkey") == F.col("c_custkey"))
    edges = sold.groupBy("src", F.col("c_nationkey").alias("dst")).agg(F.count("*").alias("n")).filter(F.col("n") >= lines).select("src", "dst")
    one = edges.withColumn("hops", F.lit(1))
    two = edges.select("src", F.col("dst").alias("via")).join(edges.select(F.col("src").alias("via"), "dst"), "via").select("src", "dst").withColumn("hops", F.lit(2))
    return one.unionByName(two).groupBy("src", "dst").agg(F.min("hops").alias("hops"))


TOPOLOGY = """
    WITH e AS (SELECT s_nationkey AS src, c_nationkey AS dst FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey
      JOIN customer ON o_custkey = c_custkey WHERE l_quantity >= 50 GROUP BY 1, 2 HAVING count(*) >= 3)
    SELECT src, dst, min(hops)::INT AS hops FROM (SELECT src, dst, 1 AS hops FROM e UNION ALL SELECT a.src, b.dst, 2 FROM e a JOIN e b ON a.dst = b.src) GROUP BY 1, 2"""


def topology_all(spark, d):
    """The same over every order line: an edge for any sale."""
    return topology(spark, d, 0, 1)


TOPOLOGY_ALL = TOPOLOGY.replace("WHERE l_quantity >= 50 ", "").replace(" HAVING count(*) >= 3", "")


def revenue_rollup(spark, d):
    """Order values by region and nation with subtotals."""
    joined = (
        table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    )
    return joined.rollup("r_name", "n_name").agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("value"))


REVENUE_ROLLUP = """
    SELECT r_name, n_name, count(*) AS orders, round(sum(o_totalprice), 2) AS value FROM orders JOIN customer ON o_custkey = c_custkey
      JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)"""


def pricing_summary(spark, d):
    line = table(spark, d, "lineitem").filter("l_shipdate <= timestamp_ntz'1998-09-02'")
    price = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return line.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(price), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("lines")
    )


PRICING_SUMMARY = """
    SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue,
      round(avg(l_discount), 6) AS avg_disc, count(*) AS lines FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2"""


def latency_summary(spark, d):
    """Counts, means and exact percentiles of each type. The values are range-sorted over all partitions, so that five
    types for all events are no five tasks' load."""
    e = table(spark, d, "events").select("event_type", "value")
    plain = e.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))
    q = evaluation.exact_quantiles(e, "event_type", "value", {"p50": 0.5, "p95": 0.95, "p99": 0.99})
    return plain.join(q, "event_type").select("event_type", "n", "mean", *(F.round(c, 6).alias(c) for c in ("p50", "p95", "p99")))


LATENCY_SUMMARY = """
    SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95,
      round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY 1"""


def json_props(spark, d):
    """A number out of each event's JSON, by type; unreadable ones count as missing."""
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "int")
    return table(spark, d, "events").groupBy("event_type").agg(F.count(k).alias("have"), F.sum(k).alias("total"), F.max(k).alias("most"))


JSON_PROPS = """
    SELECT event_type, count(k) AS have, sum(k)::BIGINT AS total, max(k) AS most FROM (SELECT event_type, try_cast(json_extract(props, '$.k') AS INT) AS k FROM events) GROUP BY 1"""


def severity_pivot(spark, d):
    t = table(spark, d, "alert_deliveries").select(F.col("labels")["service"].alias("service"), F.col("labels")["severity"].alias("severity"))
    return t.groupBy("service").pivot("severity", ["critical", "warning", "info"]).count().na.fill(0)


SEVERITY_PIVOT = """
    SELECT labels['service'] AS service, count(*) FILTER (labels['severity'] = 'critical') AS critical, count(*) FILTER (labels['severity'] = 'warning') AS warning,
      count(*) FILTER (labels['severity'] = 'info') AS info FROM alert_deliveries GROUP BY 1"""


def order_order(spark, d):
    """Users whose first view comes before their first purchase, and the share of them."""
    e = _events(spark, d).groupBy("user_id").agg(
        F.min(F.when(F.col("event_type") == "view", F.struct("s", "event_id"))).alias("v"), F.min(F.when(F.col("event_type") == "purchase", F.struct("s", "event_id"))).alias("p")
    )
    ok = F.col("v").isNotNull() & F.col("p").isNotNull() & (F.col("v") < F.col("p"))
    return e.agg(F.count("*").alias("users"), F.count_if(ok).alias("in_order"), F.round(F.avg(ok.cast("int")), 6).alias("share"))


ORDER_ORDER = """
    WITH f AS (SELECT user_id, min(CASE WHEN event_type = 'view' THEN row(epoch_us(ts) // 1000000, event_id) END) AS v, min(CASE WHEN event_type = 'purchase' THEN row(epoch_us(ts) // 1000000, event_id) END) AS p FROM events GROUP BY 1)
    SELECT count(*) AS users, count(*) FILTER (v < p) AS in_order, round(avg(CASE WHEN v < p THEN 1 ELSE 0 END), 6) AS share FROM f"""


def instances_seen(spark, d):
    """Instances of each service, those that only the last month has, and those that it lacks. Each pair is one row before
    services are counted, so no service is gathered."""
    t = table(spark, d, "alert_deliveries").select(F.col("labels")["service"].alias("service"), F.col("labels")["instance"].alias("instance"), "received_at").dropna()
    old = F.col("received_at") < F.lit("2026-10-15").cast("timestamp_ntz")
    pairs = t.groupBy("service", "instance").agg(F.bool_or(old).alias("o"), F.bool_or(~old).alias("n"))
    count = lambda c: F.count_if(c).cast("int")
    return pairs.groupBy("service").agg(F.count("*").cast("int").alias("all"), count(~F.col("o")).alias("only_new"), count(~F.col("n")).alias("only_old"))


INSTANCES_SEEN = """
    WITH t AS (SELECT labels['service'] AS service, labels['instance'] AS instance, received_at < TIMESTAMP '2026-10-15' AS old FROM alert_deliveries
      WHERE labels['service'] IS NOT NULL AND labels['instance'] IS NOT NULL),
    g AS (SELECT service, instance, bool_or(old) AS o, bool_or(NOT old) AS n FROM t GROUP BY 1, 2)
    SELECT service, count(*)::INT AS "all", (count(*) FILTER (NOT o))::INT AS only_new, (count(*) FILTER (NOT n))::INT AS only_old FROM g GROUP BY 1"""

QUERIES = {
    "counter_rate": counter_rate, "grid_values": grid_values, "bucket_quantiles": bucket_quantiles, "held_conditions": held_conditions, "trends": trends,
    "user_sessions": user_sessions, "last_change": last_change, "request_limit": request_limit, "token_buckets": token_buckets, "circuit_breakers": breakers,
    "noise_share": noise_share, "inhibited_warnings": inhibited, "topology_reach": topology, "topology_all": topology_all, "revenue_rollup": revenue_rollup, "pricing_summary": pricing_summary,
    "latency_summary": latency_summary, "json_props": json_props, "severity_pivot": severity_pivot, "event_order": order_order, "instances_seen": instances_seen,
}
SQL = {
    "counter_rate": COUNTER_RATE, "grid_values": GRID_VALUES, "bucket_quantiles": BUCKET_QUANTILES, "held_conditions": HELD_CONDITIONS, "trends": TRENDS,
    "user_sessions": USER_SESSIONS, "last_change": LAST_CHANGE, "noise_share": NOISE_SHARE, "inhibited_warnings": INHIBITED, "topology_reach": TOPOLOGY, "topology_all": TOPOLOGY_ALL,
    "revenue_rollup": REVENUE_ROLLUP, "pricing_summary": PRICING_SUMMARY, "latency_summary": LATENCY_SUMMARY, "json_props": JSON_PROPS,
    "request_limit": REQUEST_LIMIT, "token_buckets": TOKEN_BUCKETS, "circuit_breakers": BREAKERS, "severity_pivot": SEVERITY_PIVOT, "event_order": ORDER_ORDER, "instances_seen": INSTANCES_SEEN,
}
