"""Queries of the metric language, rules, log and alert sources, with the SQL each is compared with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opsloom.operators import metrics, timeseries
from opsloom.sources import documents as docs
from opsloom.sources import logs
from opsloom.sources.tables import table

NOW = 1706572800  # 2024-01-30 00:00:00 UTC, near the end of the events


def _events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").withColumn("s", F.unix_seconds(F.col("ts").cast("timestamp")))


EVENTS = "e AS (SELECT *, epoch_us(ts) // 1000000 AS s FROM events)"


def trailing_rates(spark, d):
    """Rates of each type's value as a counter over the last day, every six hours, carried on to the window's ends."""
    r = metrics.trailing_rate(_events(spark, d), ["event_type"], "s", "value", 86400, 21600)
    return r.select("event_type", "at", F.round("increase", 4).alias("increase"), F.round("rate", 8).alias("rate"))


TRAILING_RATES = f"""WITH {EVENTS}, o AS (SELECT event_type, s, max(value) AS v FROM e GROUP BY 1, 2),
    l AS (SELECT *, lag(v) OVER (PARTITION BY event_type ORDER BY s) AS p FROM o), dl AS (SELECT event_type, s, v, CASE WHEN p IS NULL THEN 0 WHEN v < p THEN v ELSE v - p END AS delta FROM l),
    x AS (SELECT *, unnest(range((s + 21599) // 21600 * 21600, (s + 86399) // 21600 * 21600 + 1, 21600)) AS at_ FROM dl),
    g AS (SELECT event_type, at_, count(*) AS n, min(s) AS a, max(s) AS b, arg_min(v, s) AS v, sum(delta) - arg_min(delta, s) AS dd, (max(s) - min(s)) / (count(*) - 1)::DOUBLE AS mean FROM x GROUP BY 1, 2 HAVING count(*) > 1),
    y AS (SELECT *, a - (at_ - 86400) AS ah, at_ - b AS be, CASE WHEN dd > 0 AND v >= 0 THEN (b - a) * v / dd END AS z FROM g),
    w AS (SELECT *, dd * (b - a + least(CASE WHEN ah < 1.1::DOUBLE * mean THEN ah ELSE mean / 2 END, z) + CASE WHEN be < 1.1::DOUBLE * mean THEN be ELSE mean / 2 END) / (b - a) AS inc FROM y)
    SELECT event_type, at_ AS "at", round(inc, 4) AS increase, round(inc / 86400, 8) AS rate FROM w"""


def label_aggregates(spark, d):
    """By type: the sum and mean of each user's sum, and how many users and days of users there are."""
    e = _events(spark, d)
    users = metrics.by_labels(e, ["event_type", "user_id"], "value", "sum")
    total, mean, count = (metrics.by_labels(users, ["event_type"], "value", how).withColumnRenamed("value", how) for how in ("sum", "avg", "count"))
    days = metrics.by_labels(metrics.by_labels(e.withColumn("day", F.floor(F.col("s") / 86400)), ["event_type", "day"], "value", "count"), ["event_type"], "value", "count")
    both = total.join(mean, "event_type").join(count, "event_type").join(days.withColumnRenamed("value", "days"), "event_type")
    return both.select("event_type", F.round("sum", 4).alias("sum"), F.round("avg", 4).alias("avg"), F.col("count").alias("users"), "days")


LABEL_AGGREGATES = f"""WITH {EVENTS}, u AS (SELECT event_type, user_id, sum(value) AS v FROM e GROUP BY 1, 2), t AS (SELECT event_type, count(DISTINCT s // 86400) AS days FROM e GROUP BY 1)
    SELECT event_type, round(sum(v), 4) AS sum, round(avg(v), 4) AS avg, count(*) AS users, any_value(days) AS days FROM u JOIN t USING (event_type) GROUP BY 1"""


def vector_arithmetic(spark, d):
    """The share of errors among each user's events, where it is above a tenth: a quotient of vectors, then a comparison."""
    e = _events(spark, d)
    errors = e.filter("event_type = 'error'").groupBy("user_id").agg(F.count("*").cast("double").alias("value"))
    every = e.groupBy("user_id").agg(metrics.clamp_min(F.count("*").cast("double"), 0.001).alias("value"))
    share = metrics.combined(errors, every, ["user_id"], "/")
    limit = every.select("user_id", F.lit(0.1).alias("value"))
    return metrics.combined(share, limit, ["user_id"], ">").select("user_id", F.round("value", 6).alias("share"))


VECTOR_ARITHMETIC = """WITH c AS (SELECT user_id, count(*) FILTER (event_type = 'error')::DOUBLE AS a, greatest(count(*), 0.001) AS b FROM events GROUP BY 1)
    SELECT user_id, round(a / b, 6) AS share FROM c WHERE a > 0 AND a / b > 0.1::DOUBLE"""

RULES = [
    metrics.Rule("ManyErrors", "errors", ">", 0.35, 7200, "critical", "service", "error share {{ $value | humanizePercentage }}"),
    metrics.Rule("FewEvents", "events", "<=", 5.0, 3600, "warning", "load", "only {{ $value | printf \"%.1f\" }} events"),
    metrics.Rule("HighValue", "value", ">=", 300.0, 0, "warning", "cpu", "value {{ $value | printf \"%.2f\" }}"),
    metrics.Rule("NoViews", "views", "==", 0.0, 10800, "critical", "service", "no views"),
]


def _hourly(spark, d) -> DataFrame:
    h = _events(spark, d).groupBy((F.floor(F.col("s") / 3600) * 3600).cast("bigint").alias("at")).agg(
        F.count("*").cast("double").alias("events"), (F.count_if(F.col("event_type") == "error") / F.count("*")).alias("errors"),
        F.round(F.avg("value"), 6).alias("value"), F.count_if(F.col("event_type") == "view").cast("double").alias("views"),
    )
    names = ["events", "errors", "value", "views"]
    return h.select("at", F.lit("all").alias("job"), F.inline(F.array(*(F.struct(F.lit(n).alias("metric"), F.col(n).alias("v")) for n in names)))).withColumnRenamed("v", "value")


def alert_rules(spark, d):
    """Stretches of hours in which each rule of a table held, pending or firing."""
    found = metrics.evaluated(_hourly(spark, d), metrics.rule_table(spark, RULES), ["job"], 3600)
    return found.select("name", "severity", "category", "state", "start", "end", "message")


_MESSAGE = {"ManyErrors": "format('error share {:.2f}%', v * 100)", "FewEvents": "format('only {:.1f} events', v)", "HighValue": "format('value {:.2f}', v)", "NoViews": "'no views'"}
ALERT_RULES = f"""WITH {EVENTS}, h AS (SELECT s // 3600 * 3600 AS t, count(*)::DOUBLE AS events, count(*) FILTER (event_type = 'error') / count(*)::DOUBLE AS errors, round(avg(value), 6) AS value, count(*) FILTER (event_type = 'view')::DOUBLE AS views FROM e GROUP BY 1),
    m AS (""" + " UNION ALL ".join(
    f"SELECT '{r.name}' AS name, '{r.severity}' AS severity, '{r.category}' AS category, {r.for_s} AS f, t, {r.metric} AS v FROM h WHERE {r.metric} {'=' if r.op == '==' else r.op} {r.threshold}::DOUBLE" for r in RULES
) + """), l AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY name ORDER BY t) <= 3600 THEN 0 ELSE 1 END AS fresh FROM m),
    r AS (SELECT *, sum(fresh) OVER (PARTITION BY name ORDER BY t ROWS UNBOUNDED PRECEDING) AS run FROM l),
    g AS (SELECT name, severity, category, f, min(t) AS start, max(t) AS fin, arg_max(v, t) AS v FROM r GROUP BY name, severity, category, f, run)
    SELECT name, severity, category, CASE WHEN fin - start >= f THEN 'firing' ELSE 'pending' END AS state, start, fin AS "end", CASE name """ + " ".join(f"WHEN '{n}' THEN {m}" for n, m in _MESSAGE.items()) + " END AS message FROM g"


def instant_values(spark, d):
    return metrics.instant(_events(spark, d), ["event_type"], "s", "value", NOW, 86400)


INSTANT_VALUES = f"WITH {EVENTS} SELECT event_type, {NOW} AS \"at\", arg_max(value, row(s, value)) AS value FROM e WHERE s <= {NOW} AND s > {NOW} - 86400 GROUP BY 1"


def range_values(spark, d):
    r = metrics.ranged(_events(spark, d), ["event_type"], "s", "value", NOW, 1440, 3600, 7200)
    return r.groupBy("event_type").agg(F.count("*").alias("points"), F.min("at").alias("first"), F.max("at").alias("last"), F.round(F.sum("value"), 4).alias("total"))


RANGE_VALUES = f"""WITH {EVENTS}, o AS (SELECT event_type, s, max(value) AS value FROM e WHERE s <= {NOW} AND s > {NOW} - 86400 - 7200 GROUP BY 1, 2),
    n AS (SELECT *, lead(s) OVER (PARTITION BY event_type ORDER BY s) AS nx FROM o), g AS (SELECT event_type, value, unnest(range((s + 3599) // 3600 * 3600, least(s + 7200, coalesce(nx - 1, s + 7200)) // 3600 * 3600 + 1, 3600)) AS t FROM n)
    SELECT event_type, count(*) AS points, min(t) AS first, max(t) AS last, round(sum(value), 4) AS total FROM g WHERE t BETWEEN {NOW} - 86400 AND {NOW} GROUP BY 1"""


def metric_overview(spark, d):
    """Preset expressions in one table: a single series as its value, several as values, none as null."""
    e, parts = _events(spark, d), []
    every = e.agg(F.count("*").cast("double").alias("value")).withColumn("label", F.lit(""))
    by_type = e.groupBy(F.col("event_type").alias("label")).agg(F.count("*").cast("double").alias("value"))
    nothing = by_type.filter("label = 'no such type'")
    for name, part in (("events", every), ("events_by_type", by_type), ("missing", nothing)):
        listed = F.array_sort(F.collect_list(F.struct("label", "value")))
        parts.append(part.agg(listed.alias("l")).select(F.lit(name).alias("name"), F.when(F.size("l") == 1, F.col("l")[0]["value"]).alias("value"), F.when(F.size("l") > 1, F.array_join(F.transform("l", lambda x: F.concat_ws("=", x["label"], x["value"].cast("bigint"))), ",")).alias("values")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


METRIC_OVERVIEW = """SELECT 'events' AS name, count(*)::DOUBLE AS value, NULL::VARCHAR AS "values" FROM events UNION ALL
    SELECT 'events_by_type', CASE WHEN count(*) = 1 THEN any_value(n)::DOUBLE END, CASE WHEN count(*) > 1 THEN string_agg(event_type || '=' || n, ',' ORDER BY event_type) END FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1)
    UNION ALL SELECT 'missing', NULL, NULL"""


def templates(spark, d):
    """Numbers put into templates in each form that rules use."""
    forms = ['a {{ $value | printf "%.1f" }}%', "{{ $value | humanize1024 }}B", "{{ $value | humanizePercentage }} of calls", "after {{ $value | humanizeDuration }}"]
    e = table(spark, d, "events").select("event_id", (F.round("value") + 0.26).alias("value"), F.explode(F.array(*map(F.lit, forms))).alias("form"))
    return e.select("event_id", "form", metrics.filled(F.col("form"), F.col("value")).alias("text"))


TEMPLATES = r"""WITH e AS (SELECT event_id, round(value) + 0.26 AS v FROM events)
    SELECT event_id, 'a {{ $value | printf "%.1f" }}%' AS form, format('a {:.1f}%', v) AS text FROM e UNION ALL SELECT event_id, '{{ $value | humanize1024 }}B', format('{:.2f}B', v) FROM e
    UNION ALL SELECT event_id, '{{ $value | humanizePercentage }} of calls', format('{:.2f}% of calls', v * 100) FROM e
    UNION ALL SELECT event_id, 'after {{ $value | humanizeDuration }}', 'after ' || CASE WHEN v < 1 THEN format('{:.0f}ms', v * 1000) WHEN v < 60 THEN format('{:.1f}s', v) ELSE (floor(v)::BIGINT // 60) || 'm ' || (floor(v)::BIGINT % 60) || 's' END FROM e"""


def risk_levels(spark, d):
    """The trend of each type's daily mean, when it would pass a threshold, and the gauges of it."""
    daily = _events(spark, d).groupBy("event_type", F.floor(F.col("s") / 86400).alias("day")).agg(F.round(F.avg("value"), 6).alias("value"))
    now = daily.groupBy("event_type").agg(F.max_by("value", "day").alias("current"))
    t = timeseries.trend(daily, ["event_type"], "day", "value").join(now, "event_type")
    r = metrics.risk(F.col("current"), F.round("slope", 6), 120.0, 60.0, 0.0)
    t = t.select("event_type", F.round("slope", 5).alias("slope"), "current", r.alias("r"))
    return t.select("event_type", "slope", "current", F.col("r.level").alias("level"), F.round(F.coalesce("r.horizon", F.lit(-1.0)), 3).alias("horizon"))


RISK_LEVELS = f"""WITH {EVENTS}, dy AS (SELECT event_type, s // 86400 AS day, round(avg(value), 6) AS value FROM e GROUP BY 1, 2),
    t AS (SELECT event_type, coalesce(regr_slope(value, day), 0) AS sl, arg_max(value, day) AS c FROM dy GROUP BY 1), r AS (SELECT *, round(sl, 6) AS rs FROM t)
    SELECT event_type, round(sl, 5) AS slope, c AS current, CASE WHEN c >= 120 THEN 3 WHEN NOT (rs > 0) THEN 0 WHEN (120 - c) / nullif(rs, 0) <= 60 THEN 2 ELSE 1 END AS level,
      round(coalesce(CASE WHEN c >= 120 THEN 0 WHEN rs > 0 AND (120 - c) / nullif(rs, 0) <= 60 THEN (120 - c) / nullif(rs, 0) END, -1), 3) AS horizon FROM r"""


def metric_registry(spark, d):
    e = _events(spark, d).withColumn("kind", F.when(F.col("event_type") == "view", "gauge").when(F.col("event_type") == "error", "histogram").otherwise("counter"))
    r = metrics.registry(e, "event_type", ["user_id"], "kind", "s", "value", [10.0, 50.0, 100.0])
    return r.select("event_type", "user_id", "kind", F.round("total", 4).alias("total"), "last", F.array_join(F.col("buckets").cast("array<string>"), ",").alias("buckets"))


METRIC_REGISTRY = f"""WITH {EVENTS}, k AS (SELECT *, CASE event_type WHEN 'view' THEN 'gauge' WHEN 'error' THEN 'histogram' ELSE 'counter' END AS kind FROM e)
    SELECT event_type, user_id, kind, CASE WHEN kind = 'counter' THEN round(sum(value), 4) END AS total, CASE WHEN kind = 'gauge' THEN arg_max(value, row(s, value)) END AS last,
      CASE WHEN kind = 'histogram' THEN count(*) FILTER (value <= 10) || ',' || count(*) FILTER (value <= 50) || ',' || count(*) FILTER (value <= 100) END AS buckets FROM k GROUP BY 1, 2, 3"""


def top_users(spark, d):
    """The three users with the largest sum of each type: a top-k report."""
    from opsloom.operators import retrieval

    g = _events(spark, d).groupBy("event_type", "user_id").agg(F.round(F.sum("value"), 4).alias("score"))
    return retrieval.top(g, 3, ["event_type"], tie="user_id").select("event_type", "user_id", "rank", "score")


TOP_USERS = """SELECT event_type, user_id, row_number() OVER (PARTITION BY event_type ORDER BY round(sum(value), 4) DESC, user_id) - 1 AS rank, round(sum(value), 4) AS score
    FROM events GROUP BY 1, 2 QUALIFY rank < 3"""


def _lines(spark, d) -> DataFrame:
    """The events as log lines of containers, with their time in nanoseconds."""
    e = table(spark, d, "events")
    ns = F.unix_micros(F.col("ts").cast("timestamp")) * 1000
    level = F.when(F.col("event_type") == "error", "ERROR").otherwise("INFO")
    return e.select(F.concat(F.lit("app-"), F.col("user_id") % 7).alias("container"), ns.alias("ns"), F.concat_ws(" ", level, F.col("event_type"), "props").alias("line"))


LINES = "l AS (SELECT 'app-' || (user_id % 7) AS container, epoch_us(ts) * 1000 AS ns, CASE WHEN event_type = 'error' THEN 'ERROR ' ELSE 'INFO ' END || event_type || ' ' || props AS line FROM events)"


def log_range(spark, d):
    """Lines of some containers with a word, in the week before a moment, each with its time of day."""
    rows = logs.ranged(_lines(spark, d), NOW, 7 * 1440).filter(logs.built(F.col("container"), F.col("line"), "app-[1-3]", "ERROR"))
    return rows.select("container", "ns", logs.clock(F.col("ns")).alias("at"), "line")


LOG_RANGE = f"""WITH {LINES} SELECT container, ns, strftime(make_timestamp(ns // 1000), '%H:%M:%S') AS "at", line FROM l
    WHERE ns <= {NOW}::BIGINT * 1000000000 AND ns > ({NOW} - 7 * 86400)::BIGINT * 1000000000 AND regexp_matches(container, '.*app-[1-3].*') AND contains(line, 'ERROR')"""


def log_containers(spark, d):
    return logs.containers(_lines(spark, d), NOW, 60 * 24)


LOG_CONTAINERS = f"WITH {LINES} SELECT DISTINCT container FROM l WHERE ns <= {NOW}::BIGINT * 1000000000 AND ns > ({NOW} - 86400)::BIGINT * 1000000000"


def log_pipeline(spark, d):
    """Lines through a query with line filters, a number out of their JSON, and a format."""
    q = logs.piped(_lines(spark, d), r'|= "ERROR" !~ "\"k\": 1[0-9]" | json | line_format "{{.container}} k={{.k}}"', ["k"])
    return q.groupBy("line").agg(F.count("*").alias("lines"))


LOG_PIPELINE = f"""WITH {LINES}, j AS (SELECT container, json_extract_string('{{' || split_part(line, '{{', 2), '$.k') AS k FROM l WHERE contains(line, 'ERROR') AND NOT regexp_matches(line, '"k": 1[0-9]'))
    SELECT container || ' k=' || coalesce(k, '') AS line, count(*) AS lines FROM j GROUP BY 1"""


def log_keywords(spark, d):
    """Different lines that hold any of some words, the first twenty of them in order: a report."""
    found = logs.any_keyword(_lines(spark, d), ["signup", "purchase"])
    return found.select("line").distinct().orderBy("line").limit(20)


LOG_KEYWORDS = f"WITH {LINES} SELECT DISTINCT line FROM l WHERE contains(line, 'signup') OR contains(line, 'purchase') ORDER BY line LIMIT 20"


def _alerts(spark, d) -> DataFrame:
    return docs.flat_alerts(table(spark, d, "alert_deliveries"))


def alert_list(spark, d):
    """Alerts by severity and name with their place in the list of each service, and what they are known by."""
    from pyspark.sql import Window as W

    a = _alerts(spark, d).filter("status = 'firing'")
    order = W.partitionBy("service").orderBy(docs.severity_rank(F.col("severity")), F.col("alertname").asc_nulls_first(), "delivery_id")
    return a.select("delivery_id", "service", "severity", "alertname", docs.alert_key(F.col("fingerprint"), F.col("alertname"), F.col("instance")).alias("alert_key"), F.row_number().over(order).alias("place"))


_FLAT = """a AS (SELECT delivery_id, lower(trim(status, ' ' || chr(9))) AS status, nullif(lower(trim(fingerprint, ' ' || chr(9))), '') AS fingerprint, labels['service'] AS service, labels['severity'] AS severity,
      labels['alertname'] AS alertname, labels['instance'] AS instance, annotations['summary'] AS summary FROM alert_deliveries)"""
ALERT_LIST = f"""WITH {_FLAT} SELECT delivery_id, service, severity, alertname, CASE WHEN fingerprint IS NOT NULL THEN 'fp:' || fingerprint ELSE coalesce(alertname, '') || ':' || coalesce(instance, '') END AS alert_key,
    row_number() OVER (PARTITION BY service ORDER BY CASE severity WHEN 'critical' THEN 0 WHEN 'warning' THEN 1 WHEN 'info' THEN 2 ELSE 3 END, alertname NULLS FIRST, delivery_id)::INT AS place FROM a WHERE status = 'firing'"""


def severity_histogram(spark, d):
    """How many alerts of each severity a service has, and the first three names of them."""
    g = _alerts(spark, d).groupBy("service", "severity")
    return g.agg(F.count("*").alias("alerts"), F.array_join(F.slice(F.array_sort(F.collect_set("alertname")), 1, 3), ",").alias("first_names"))


SEVERITY_HISTOGRAM = f"WITH {_FLAT} SELECT service, severity, count(*) AS alerts, array_to_string(list_sort(coalesce(list(DISTINCT alertname) FILTER (alertname IS NOT NULL), []))[1:3], ',') AS first_names FROM a GROUP BY 1, 2"


def inhibited_by_category(spark, d):
    """Warnings without a critical alert of the same service that became active in the hour before them.

    The critical alerts are summed up by service and hour first; whether one lies in the hour before a warning shows in the
    earliest of the same hour and the latest of the hour before, so no range is joined and a hot service is no task's load.
    """
    a = table(spark, d, "alert_deliveries").select(
        "delivery_id", F.col("labels")["service"].alias("service"), F.col("labels")["severity"].alias("severity"), F.unix_seconds(F.col("received_at").cast("timestamp")).alias("s")
    ).withColumn("hour", F.floor(F.col("s") / 3600))
    c = a.filter("severity = 'critical'").groupBy("service", "hour").agg(F.min("s").alias("least"), F.max("s").alias("most"))
    same = c.select("service", "hour", "least")
    before = c.select("service", (F.col("hour") + 1).alias("hour"), "most")
    w = a.filter("severity = 'warning'").join(same, ["service", "hour"], "left").join(before, ["service", "hour"], "left")
    held = (F.col("least") <= F.col("s")) | (F.col("most") >= F.col("s") - 3600)
    return w.groupBy("service").agg(F.count_if(F.coalesce(held, F.lit(False))).alias("inhibited"), F.count_if(~F.coalesce(held, F.lit(False))).alias("sent"))


INHIBITED_BY_CATEGORY = """WITH a AS (SELECT delivery_id, labels['service'] AS service, labels['severity'] AS severity, epoch_us(received_at) // 1000000 AS s FROM alert_deliveries),
    w AS (SELECT a.service, EXISTS (SELECT 1 FROM a c WHERE c.severity = 'critical' AND c.service = a.service AND c.s BETWEEN a.s - 3600 AND a.s) AS h FROM a WHERE a.severity = 'warning')
    SELECT service, count(*) FILTER (h) AS inhibited, count(*) FILTER (NOT h) AS sent FROM w GROUP BY 1"""


def notification_groups(spark, d):
    """Groups of deliveries by name and severity: one notice ten seconds after the first, and again after half a minute
    of quiet."""
    a = table(spark, d, "alert_deliveries").select(F.col("labels")["alertname"].alias("alertname"), F.col("labels")["severity"].alias("severity"), F.unix_seconds(F.col("received_at").cast("timestamp")).alias("s")).dropna()
    s = timeseries.sessions(a, ["alertname", "severity"], "s", 30)
    return s.groupBy("alertname", "severity").agg(F.count("*").alias("notices"), F.max("events").alias("most_alerts"), (F.min("start") + 10).alias("first_notice"))


NOTIFICATION_GROUPS = """WITH a AS (SELECT labels['alertname'] AS alertname, labels['severity'] AS severity, epoch_us(received_at) // 1000000 AS s FROM alert_deliveries WHERE labels['alertname'] IS NOT NULL AND labels['severity'] IS NOT NULL AND received_at IS NOT NULL),
    l AS (SELECT *, CASE WHEN s - lag(s) OVER (PARTITION BY alertname, severity ORDER BY s) <= 30 THEN 0 ELSE 1 END AS f FROM a), n AS (SELECT *, sum(f) OVER (PARTITION BY alertname, severity ORDER BY s RANGE UNBOUNDED PRECEDING) AS no FROM l),
    g AS (SELECT alertname, severity, no, count(*) AS n, min(s) AS a FROM n GROUP BY 1, 2, 3) SELECT alertname, severity, count(*) AS notices, max(n) AS most_alerts, min(a) + 10 AS first_notice FROM g GROUP BY 1, 2"""


def red_metrics(spark, d):
    """Requests, failures and mean duration by route, numbers in paths replaced."""
    e = table(spark, d, "events").select(F.concat(F.lit("/users/"), "user_id", F.lit("/"), "event_type").alias("path"), "event_type", "value")
    route = F.regexp_replace("path", r"/\d+", "/{id}")
    return e.groupBy(route.alias("route")).agg(F.count("*").alias("requests"), F.count_if(F.col("event_type") == "error").alias("failed"), F.round(F.avg("value"), 6).alias("mean"))


RED_METRICS = r"""SELECT regexp_replace('/users/' || user_id || '/' || event_type, '/\d+', '/{id}', 'g') AS route, count(*) AS requests, count(*) FILTER (event_type = 'error') AS failed, round(avg(value), 6) AS mean FROM events GROUP BY 1"""

_ALL = [
    (trailing_rates, TRAILING_RATES), (label_aggregates, LABEL_AGGREGATES), (vector_arithmetic, VECTOR_ARITHMETIC), (alert_rules, ALERT_RULES), (instant_values, INSTANT_VALUES),
    (range_values, RANGE_VALUES), (metric_overview, METRIC_OVERVIEW), (templates, TEMPLATES), (risk_levels, RISK_LEVELS), (metric_registry, METRIC_REGISTRY), (top_users, TOP_USERS),
    (log_range, LOG_RANGE), (log_containers, LOG_CONTAINERS), (log_pipeline, LOG_PIPELINE), (log_keywords, LOG_KEYWORDS), (alert_list, ALERT_LIST),
    (severity_histogram, SEVERITY_HISTOGRAM), (inhibited_by_category, INHIBITED_BY_CATEGORY), (notification_groups, NOTIFICATION_GROUPS), (red_metrics, RED_METRICS),
]
QUERIES = {query.__name__: query for query, _ in _ALL}
SQL = {query.__name__: sql for query, sql in _ALL}
