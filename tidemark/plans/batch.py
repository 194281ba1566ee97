"""Queries of scheduled jobs over events and records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.tables import MEMORIES_SQL, memories, table
from ..streaming.jobs import TRANSITIONS

REGISTERED: dict = {}
#: Half-life of a ledger event in days and the weight of harm. Fixed values.
LEDGER_DAYS, HARM = 90.0, 4.0
_NOW = "2024-02-01 00:00:00"


def query(sql: str | None = None):
    def add(f):
        REGISTERED[f.__name__] = (f, sql)
        return f

    return add


def _us(c) -> Column:
    return F.unix_micros(F.col(c).cast("timestamp") if isinstance(c, str) else c)


_AGE = f"greatest(epoch_us(TIMESTAMP '{_NOW}') - epoch_us(ts), 0) / 86400e6"


@query(f"""WITH e AS (SELECT user_id % 200 AS skill, event_type, pow(0.5, {_AGE} / 90.0) AS w FROM events),
s AS (SELECT skill, count(*) FILTER (WHERE event_type = 'view') AS served, count(*) FILTER (WHERE event_type IN ('click', 'purchase', 'error')) AS followed,
  round(coalesce(sum(w) FILTER (WHERE event_type = 'purchase'), 0) - 4 * coalesce(sum(w) FILTER (WHERE event_type = 'error'), 0), 6) AS net FROM e GROUP BY skill)
SELECT skill, served, followed, net, CASE WHEN net > 1e-9 THEN '+' WHEN net < -1e-9 THEN '-' ELSE '0' END AS sign FROM s""")
def ledger_scores(spark: SparkSession, d: str) -> DataFrame:
    """How each skill did: recent outcomes weigh more, harm four times as much as success."""
    now = F.unix_micros(F.lit(_NOW).cast("timestamp"))
    w = F.pow(F.lit(0.5), F.greatest(now - _us("ts"), F.lit(0)) / 86_400e6 / LEDGER_DAYS)
    kind = F.col("event_type")
    total = lambda k: F.coalesce(F.sum(F.when(kind == k, F.col("w"))), F.lit(0.0))
    s = table(spark, d, "events").select((F.col("user_id") % 200).alias("skill"), "event_type", w.alias("w")).groupBy("skill")
    s = s.agg(F.count_if(kind == "view").alias("served"), F.count_if(kind.isin("click", "purchase", "error")).alias("followed"), F.round(total("purchase") - HARM * total("error"), 6).alias("net"))
    return s.withColumn("sign", F.when(F.col("net") > 1e-9, "+").when(F.col("net") < -1e-9, "-").otherwise("0"))


@query("SELECT event_type, count(*) AS n, count(value) AS with_value, round(avg(value), 6) AS mean, min(ts) AS first_at, max(ts) AS last_at FROM events GROUP BY event_type")
def arm_liveness(spark: SparkSession, d: str) -> DataFrame:
    """How often, how recently and with what values each kind of event came."""
    return table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count("value").alias("with_value"), F.round(F.avg("value"), 6).alias("mean"), F.min("ts").alias("first_at"), F.max("ts").alias("last_at"))


@query("SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95 FROM events WHERE value IS NOT NULL GROUP BY event_type")
def latency_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Nearest-rank percentiles of each kind: sketches bracket them, and only values within the brackets are ranked."""
    v = table(spark, d, "events").where("value is not null").select("event_type", "value")
    ps, slack, accuracy = (0.5, 0.95), 0.002, 4000
    marks = v.groupBy("event_type").agg(F.count(F.lit(1)).alias("all"), *(F.percentile_approx("value", min(1.0, max(0.0, p + s)), accuracy).alias(f"{n}{i}") for i, p in enumerate(ps) for n, s in (("lo", -slack), ("hi", slack))))
    rows = v.join(F.broadcast(marks), "event_type")  # a row for each kind
    below = rows.groupBy("event_type").agg(*(F.count_if(F.col("value") < F.col(f"lo{i}")).alias(f"under{i}") for i in range(len(ps))))
    out = marks.select("event_type")
    for i, p in enumerate(ps):
        near = rows.where(F.col("value").between(F.col(f"lo{i}"), F.col(f"hi{i}"))).groupBy("event_type", "all", "value").agg(F.count(F.lit(1)).alias("n")).join(below, "event_type")
        upto = F.col(f"under{i}") + F.sum("n").over(Window.partitionBy("event_type").orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
        found = near.withColumn("upto", upto).where(F.col("upto") >= F.ceil(F.col("all") * p)).groupBy("event_type").agg(F.min("value").alias(f"p{round(100 * p)}"))
        out = out.join(found, "event_type")
    return out


@query("SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type, count(*) AS n, count(DISTINCT user_id) AS users, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def daily_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Events by day and kind."""
    return table(spark, d, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users"), F.round(F.sum("value"), 4).alias("total"))


@query(f"WITH {MEMORIES_SQL}, m AS (SELECT date_trunc('week', created_at) AS week, intensity FROM mem), w AS (SELECT week, count(*) AS n, round(avg(intensity), 6) AS mean FROM m GROUP BY week) SELECT week, n, mean, CASE WHEN mean > lag(mean) OVER (ORDER BY week) THEN 'rising' WHEN mean < lag(mean) OVER (ORDER BY week) THEN 'falling' ELSE 'steady' END AS arc FROM w")
def emotional_arc(spark: SparkSession, d: str) -> DataFrame:
    """Mean intensity by week and how it changed; only weeks, already aggregated, are put in one order."""
    w = memories(spark, d).groupBy(F.date_trunc("week", "created_at").cast("timestamp_ntz").alias("week")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("intensity"), 6).alias("mean"))
    before = F.lag("mean").over(Window.orderBy("week"))
    return w.select("week", "n", "mean", F.when(F.col("mean") > before, "rising").when(F.col("mean") < before, "falling").otherwise("steady").alias("arc"))


@query("""WITH RECURSIVE e AS (SELECT DISTINCT user_id, epoch_us(ts) AS t FROM events), nxt AS (SELECT a.user_id, a.t, min(b.t) AS after FROM e a LEFT JOIN e b ON a.user_id = b.user_id AND b.t - a.t > 3600000000 GROUP BY a.user_id, a.t),
c AS (SELECT user_id, min(t) AS t FROM e GROUP BY user_id UNION ALL SELECT c.user_id, n.after FROM c JOIN nxt n ON c.user_id = n.user_id AND c.t = n.t WHERE n.after IS NOT NULL),
u AS (SELECT user_id, count(*) AS uses, max(t) AS last_use FROM c GROUP BY user_id)
SELECT u.user_id, uses, last_use, n AS events FROM u JOIN (SELECT user_id, count(*) AS n FROM events GROUP BY user_id) x ON u.user_id = x.user_id""")
def usage_reinforce_debounced(spark: SparkSession, d: str) -> DataFrame:
    """Uses of a record: a touch counts if more than an hour has passed since the last one that counted.

    Whether a touch counts depends on all before it, so a record's moments, each once, are folded in order in one row;
    streaming.jobs.uses() keeps only the last use.
    """
    moments = table(spark, d, "events").groupBy("user_id", _us("ts").alias("t")).agg(F.count(F.lit(1)).alias("n"))
    each = moments.groupBy("user_id").agg(F.array_sort(F.collect_list("t")).alias("ts"), F.sum("n").alias("events"))
    start = F.struct(F.lit(0).cast("long").alias("uses"), F.lit(None).cast("long").alias("last_use"))
    counts = lambda s, t: s["last_use"].isNull() | (t - s["last_use"] > 3_600_000_000)
    step = lambda s, t: F.struct((s["uses"] + counts(s, t).cast("long")).alias("uses"), F.when(counts(s, t), t).otherwise(s["last_use"]).alias("last_use"))
    return each.select("user_id", F.aggregate("ts", start, step).alias("s"), "events").select("user_id", "s.uses", "s.last_use", "events")


@query(f"""WITH {MEMORIES_SQL}, c AS (SELECT id, layer, CASE layer WHEN 'short-term' THEN 'mid-term' ELSE 'long-term' END AS target,
  CASE WHEN layer = 'short-term' AND (intensity >= 5 OR access_count >= 3) OR layer = 'mid-term' AND intensity >= 7 THEN row_number() OVER (PARTITION BY layer, (layer = 'short-term' AND (intensity >= 5 OR access_count >= 3) OR layer = 'mid-term' AND intensity >= 7) ORDER BY created_at DESC, id) END AS n FROM mem)
SELECT id, layer, target, n FROM c WHERE n <= 50""")
def promotion_candidates(spark: SparkSession, d: str) -> DataFrame:
    """The newest fifty of each layer that qualify for the next."""
    m, layer = memories(spark, d), F.col("layer")
    rule = (layer == "short-term") & ((F.col("intensity") >= 5) | (F.col("access_count") >= 3)) | (layer == "mid-term") & (F.col("intensity") >= 7)
    n = F.row_number().over(Window.partitionBy("layer").orderBy(F.desc("created_at"), "id"))
    return m.where(rule).select("id", "layer", F.when(layer == "short-term", "mid-term").otherwise("long-term").alias("target"), n.alias("n")).where("n <= 50")


@query("SELECT o_orderkey, o_custkey, CAST(o_orderdate AS TIMESTAMP) AS valid_from, lead(CAST(o_orderdate AS TIMESTAMP)) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS valid_to FROM orders")
def scd2_close(spark: SparkSession, d: str) -> DataFrame:
    """Each order closes the one before it of the same customer."""
    day = F.col("o_orderdate").cast("timestamp_ntz")
    return table(spark, d, "orders").select("o_orderkey", "o_custkey", day.alias("valid_from"), F.lead(day).over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")).alias("valid_to"))


@query(f"SELECT event_id, CAST(epoch_us(ts) // 1000000 + 21600 * ((epoch_us(TIMESTAMP '{_NOW}') - epoch_us(ts)) // 1000000 // 21600 + 1) AS BIGINT) AS next_at FROM events WHERE ts <= TIMESTAMP '{_NOW}'")
def repeat_timer(spark: SparkSession, d: str) -> DataFrame:
    """When a timer of six hours fires next; however long it was down, once."""
    due, now = F.floor(_us("ts") / 1e6), F.lit(1706745600)
    late = F.floor((F.lit(1706745600000000) - _us("ts")) / 1e6)
    return table(spark, d, "events").where(F.col("ts").cast("timestamp") <= F.timestamp_seconds(now)).select("event_id", (due + 21600 * (F.floor(late / 21600) + 1)).cast("long").alias("next_at"))


#: What each kind of event asks of an intention here.
_ASKS = {"signup": "arm", "view": "snooze", "click": "fire", "error": "invalidate", "purchase": "done"}


def _asked_sql() -> str:
    return "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _ASKS.items()) + " END"


@query(f"""WITH RECURSIVE e AS (SELECT user_id, {_asked_sql()} AS ask, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
f AS (SELECT DISTINCT user_id, CAST('pending' AS VARCHAR) AS state, CAST(0 AS BIGINT) AS n FROM e UNION ALL
  SELECT f.user_id, CASE f.state || '|' || e.ask {' '.join(f"WHEN '{a}|{b}' THEN '{c}'" for (a, b), c in TRANSITIONS.items())} ELSE f.state END, e.n FROM f JOIN e ON f.user_id = e.user_id AND e.n = f.n + 1)
SELECT user_id, arg_max(state, n) AS state, max(n) AS events FROM f GROUP BY user_id""")
def intention_fold(spark: SparkSession, d: str) -> DataFrame:
    """The state that each user's events lead to, in order of time; events that a state does not allow change nothing.

    The events of an hour are folded into a map from each state to the one they lead to; a day's maps and then all
    days' are put together in order, so no task has a user's events whole.
    """
    states = sorted({a for a, _ in TRANSITIONS} | set(TRANSITIONS.values()))
    moves = F.create_map(*(F.lit(x) for (a, b), c in TRANSITIONS.items() for x in (f"{a}|{b}", c)))
    asks = F.try_element_at(F.create_map(*(F.lit(x) for p in _ASKS.items() for x in p)), F.col("event_type"))
    own = F.array(*map(F.lit, states))
    e = table(spark, d, "events").select("user_id", "ts", "event_id", asks.alias("ask")).where("ask is not null")
    after = lambda s, ask: F.coalesce(F.try_element_at(moves, F.concat(s, F.lit("|"), ask)), s)
    hours = e.groupBy("user_id", F.date_trunc("hour", "ts").alias("at")).agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "ask"))).alias("es"))
    maps = hours.select("user_id", "at", F.size("es").cast("long").alias("n"), F.aggregate("es", own, lambda s, x: F.transform(s, lambda now: after(now, x["ask"]))).alias("ends"))
    through = lambda s, m: F.transform(s, lambda now: F.element_at(m, F.array_position(own, now).cast("int")))
    for unit in ("day", "year"):
        joined = maps.groupBy("user_id", F.date_trunc(unit, "at").alias("at")).agg(F.array_sort(F.collect_list(F.struct("at", "ends"))).alias("ms"), F.sum("n").alias("n"))
        maps = joined.select("user_id", "at", "n", F.aggregate("ms", own, lambda s, m: through(s, m["ends"])).alias("ends"))
    all_ = maps.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("at", "ends"))).alias("ms"), F.sum("n").alias("events"))
    return all_.select("user_id", F.element_at(F.aggregate("ms", own, lambda s, m: through(s, m["ends"])), states.index("pending") + 1).alias("state"), "events")


@query("SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus")
def pricing_summary(spark: SparkSession, d: str) -> DataFrame:
    """Sums of line items by flag and status."""
    rows = table(spark, d, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count(F.lit(1)).alias("n"))
