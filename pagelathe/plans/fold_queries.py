"""Ordered stateful computations in batch."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagelathe.functions import responses as R
from pagelathe.functions import urls as U
from pagelathe.operators import folds as S
from pagelathe.plans.aggregate_queries import _arms
from pagelathe.plans.registry import query
from pagelathe.sources import tables as T

_L = f"f AS ({T.FETCH_LOG})"
_OUT = "CASE WHEN status_code BETWEEN 200 AND 299 THEN 'success' WHEN challenge_type <> '' THEN 'captcha' WHEN status_code IN (403, 429) THEN 'blocked' ELSE 'failed' END"
_B = f"{_L}, o AS (SELECT domain, CAST(floor(epoch_us(ts) / 86400000000) AS BIGINT) AS bucket, {_OUT} AS o FROM f), b AS (SELECT domain, bucket, count(*) FILTER (o = 'blocked') / count(*) AS blocked, count(*) FILTER (o = 'captcha') / count(*) AS captcha, count(*) FILTER (o = 'failed') / count(*) AS failed FROM o GROUP BY 1, 2)"


@query(
    "st_token",
    f"""WITH {_L}, l AS (SELECT domain, list({{'t': epoch_us(ts), 'o': event_id, 'w': []::BIGINT[], 'v': []::BOOLEAN[]}} ORDER BY ts, event_id) AS e FROM f GROUP BY domain),
r AS (SELECT domain, list_transform(e, lambda x: x.o) AS o, list_reduce(e, lambda a, x: {{'t': x.t, 'o': x.o,
  'w': CASE WHEN len(list_filter(a.w, lambda t: t > x.t - 36000000000)) < 2 THEN list_append(list_filter(a.w, lambda t: t > x.t - 36000000000), x.t) ELSE list_filter(a.w, lambda t: t > x.t - 36000000000) END,
  'v': list_append(a.v, len(list_filter(a.w, lambda t: t > x.t - 36000000000)) < 2)}}, {{'t': 0::BIGINT, 'o': 0::BIGINT, 'w': []::BIGINT[], 'v': []::BOOLEAN[]}}).v AS v FROM l)
SELECT domain, unnest(o) AS event_id, unnest(v) AS ok FROM r""",
)
def st_token(spark, d):
    """Greedy admission of at most two fetches of a domain in ten hours."""
    return S.admit(T.fetch_log(spark, d), "domain", "ts", "event_id", most=2, seconds=36000)


_SPACED = """WITH {with_}, l AS (SELECT {key}, list({{'t': epoch_us(ts), 'o': event_id, 'last': NULL::BIGINT, 'v': []::BOOLEAN[]}} ORDER BY ts, event_id) AS e FROM {rows} GROUP BY {key}),
r AS (SELECT {key}, list_transform(e, lambda x: x.o) AS o, list_reduce(e, lambda a, x: {{'t': x.t, 'o': x.o, 'last': CASE WHEN a.last IS NULL OR x.t - a.last >= {us} THEN x.t ELSE a.last END, 'v': list_append(a.v, a.last IS NULL OR x.t - a.last >= {us})}}, {{'t': 0::BIGINT, 'o': 0::BIGINT, 'last': NULL::BIGINT, 'v': []::BOOLEAN[]}}).v AS v FROM l)
SELECT {key}, unnest(o) AS event_id, unnest(v) AS ok FROM r"""


@query("st_polite", _SPACED.format(with_=_L, key="domain", rows="f", us=14400 * 10**6))
def st_polite(spark, d):
    """A domain's fetches that keep four hours from the last allowed one."""
    return S.spaced(T.fetch_log(spark, d), "domain", "ts", "event_id", seconds=14400)


@query("dedup_ttl", _SPACED.format(with_=f"{_L}, g AS (SELECT *, left(sha256('https://x.example/' || CAST(user_id AS STRING)), 16) AS key FROM f)", key="key", rows="g", us=86400 * 10**6))
def dedup_ttl(spark, d):
    """First sightings of a URL within 24 hours; duplicates do not prolong the time."""
    url = F.concat(F.lit("https://x.example/"), F.col("user_id").cast("string"))
    return S.spaced(T.fetch_log(spark, d).withColumn("key", U.dedup_key(url)), "key", "ts", "event_id", seconds=86400)


_RAW = "least(1.0, greatest(0.0, 0.4::DOUBLE * blocked + 0.4::DOUBLE * captcha + 0.2::DOUBLE * (failed * 0.5::DOUBLE)))"


@query("st_ban", f"WITH {_B}, l AS (SELECT domain, list({_RAW} ORDER BY bucket) AS r FROM b GROUP BY domain) SELECT domain, round(list_reduce(r, lambda a, x: a * 0.7::DOUBLE + x * 0.3::DOUBLE, 0.0::DOUBLE), 6) AS score FROM l")
def st_ban(spark, d):
    """The smoothed ban score of domains after the last day."""
    b = S.buckets(T.fetch_log(spark, d), 86400)
    scores = S.ema(b, "domain", "bucket", S.raw_ban(F.col("blocked"), F.col("captcha"), F.col("failed")))
    return scores.groupBy("domain").agg(F.round(F.max_by("score", "bucket"), 6).alias("score"))


@query(
    "st_pid",
    f"""WITH {_B}, n AS (SELECT domain, bucket, blocked AS b, {_RAW} AS s FROM b), l AS (SELECT domain, list({{'o': bucket, 'b': b::DOUBLE, 's': s::DOUBLE, 'i': 0.0::DOUBLE, 'last': 0.0::DOUBLE, 'q': 1.0::DOUBLE}} ORDER BY bucket) AS e FROM n GROUP BY domain),
r AS (SELECT domain, list_reduce(e, lambda a, x: CASE WHEN abs(0.05::DOUBLE - x.b) < 0.05 THEN {{'o': x.o, 'b': x.b, 's': x.s, 'i': a.i, 'last': a.last, 'q': a.q}}
  ELSE {{'o': x.o, 'b': x.b, 's': x.s, 'i': greatest(-2.0::DOUBLE, least(2.0::DOUBLE, a.i + (0.05::DOUBLE - x.b) * 10)), 'last': 0.05::DOUBLE - x.b,
    'q': CASE WHEN x.s > 0.7 THEN 0.1::DOUBLE ELSE greatest(0.1::DOUBLE, least(10.0::DOUBLE, a.q + (0.5::DOUBLE * (0.05::DOUBLE - x.b) + 0.1::DOUBLE * greatest(-2.0::DOUBLE, least(2.0::DOUBLE, a.i + (0.05::DOUBLE - x.b) * 10)) + 0.05::DOUBLE * ((0.05::DOUBLE - x.b) - a.last) / 10) * a.q)) END}} END,
  {{'o': 0::BIGINT, 'b': 0.0::DOUBLE, 's': 0.0::DOUBLE, 'i': 0.0::DOUBLE, 'last': 0.0::DOUBLE, 'q': 1.0::DOUBLE}}).q AS q FROM l)
SELECT domain, round(q, 6) AS qps FROM r""",
)
def st_pid(spark, d):
    """The controlled request rate of domains after the last day."""
    b = S.buckets(T.fetch_log(spark, d), 86400)
    rates = S.pid(b, "domain", "bucket", F.col("blocked"), S.raw_ban(F.col("blocked"), F.col("captcha"), F.col("failed")))
    return rates.groupBy("domain").agg(F.round(F.max_by("qps", "bucket"), 6).alias("qps"))


_ERR = "(0.05::DOUBLE - (a.s * 0.9::DOUBLE + x.x * (1 - 0.9::DOUBLE)))"
_INT = f"greatest(-2.0::DOUBLE, least(2.0::DOUBLE, a.i + {_ERR} * 10))"
_RATE = f"CASE WHEN abs({_ERR}) < 0.05 THEN a.q ELSE greatest(0.1::DOUBLE, least(10.0::DOUBLE, a.q + (0.5::DOUBLE * {_ERR} + 0.1::DOUBLE * {_INT} + 0.05::DOUBLE * ({_ERR} - a.last) / 10) * a.q)) END"
#: SQL of the rate after every fetch, controlled by the smoothed block indicator.
LOOP = f"""WITH {_L}, l AS (SELECT domain, list({{'o': event_id, 'x': CASE WHEN status_code IN (403, 429) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END, 's': 0.0::DOUBLE, 'i': 0.0::DOUBLE, 'last': 0.0::DOUBLE, 'q': 1.0::DOUBLE, 'v': []::DOUBLE[]}} ORDER BY ts, event_id) AS e FROM f GROUP BY domain),
r AS (SELECT domain, list_transform(e, lambda y: y.o) AS o, list_reduce(e, lambda a, x: {{'o': x.o, 'x': x.x, 's': a.s * 0.9::DOUBLE + x.x * (1 - 0.9::DOUBLE),
  'i': CASE WHEN abs({_ERR}) < 0.05 THEN a.i ELSE {_INT} END, 'last': CASE WHEN abs({_ERR}) < 0.05 THEN a.last ELSE {_ERR} END, 'q': {_RATE}, 'v': list_append(a.v, {_RATE})}},
  {{'o': 0::BIGINT, 'x': 0.0::DOUBLE, 's': 0.0::DOUBLE, 'i': 0.0::DOUBLE, 'last': 0.0::DOUBLE, 'q': 1.0::DOUBLE, 'v': []::DOUBLE[]}}).v AS v FROM l)
SELECT domain, event_id, round(q, 6) AS qps FROM (SELECT domain, unnest(o) AS event_id, unnest(v) AS q FROM r)"""


def _outcomes(spark, d):
    return T.fetch_log(spark, d).select("domain", "proxy_id", "ts", "event_id", (F.unix_micros("ts") / 1e6).alias("t"), R.is_success(F.col("status_code")).alias("ok"), (F.col("status_code") == 403).alias("ban"))


def _fold(name: str, fold: S.Fold, out: str, oracle: str):
    query(name, oracle)(lambda spark, d: S.ordered(_outcomes(spark, d), "domain", ["ts", "event_id"], ["t", "ok"], fold, out))


def _breaker(fields: dict[str, tuple[str, str]], allowed: str = "true") -> str:
    """SQL of a breaker: per state field its start and its next value, over a (before) and x (row). The state of each row
    is kept in a list; rows that are not allowed change nothing."""
    start = ", ".join(f"'{k}': {v[0]}" for k, v in fields.items())
    step = ", ".join(f"'{k}': {v[1]}" for k, v in fields.items())
    state = fields["state"][1]
    return f"""WITH {_L}, l AS (SELECT domain, list({{'t': epoch_us(ts) / 1e6, 'ok': status_code BETWEEN 200 AND 299, 'o': event_id, {start}, 'v': []::VARCHAR[]}} ORDER BY ts, event_id) AS e FROM f GROUP BY domain),
r AS (SELECT domain, list_transform(e, lambda y: y.o) AS o, list_reduce(e, lambda a, x: {{'t': x.t, 'ok': x.ok, 'o': x.o, {step}, 'v': list_append(a.v, coalesce(nullif({state}, ''), 'closed'))}}, {{'t': 0.0::DOUBLE, 'ok': true, 'o': 0::BIGINT, {start}, 'v': []::VARCHAR[]}}).v AS v FROM l)
SELECT domain, unnest(o) AS event_id, unnest(v) AS state FROM r"""


def _lazy(threshold: int, cooldown: int) -> str:
    n = "(CASE WHEN x.ok THEN 0 ELSE a.failures + 1 END)"
    opens = f"(a.state = 'closed' AND {n} >= {threshold})"
    state = f"CASE WHEN {opens} THEN 'open' WHEN a.state = 'open' AND x.t - a.opened >= {cooldown} THEN 'half_open' WHEN a.state = 'half_open' AND {n} = 0 THEN 'closed' ELSE a.state END"
    return _breaker({"state": ("'closed'", state), "failures": ("0", n), "opened": ("0.0::DOUBLE", f"CASE WHEN {opens} THEN x.t ELSE a.opened END")})


def _component(threshold: int, cooldown: int) -> str:
    half = f"(a.state = 'open' AND x.t - a.opened >= {cooldown})"
    n = f"(CASE WHEN x.ok THEN 0 WHEN {half} THEN 1 ELSE a.failures + 1 END)"
    opens = f"(NOT x.ok AND a.state = 'closed' AND {n} >= {threshold})"
    state = f"CASE WHEN x.ok THEN 'closed' WHEN {opens} THEN 'open' WHEN {half} THEN 'half_open' ELSE a.state END"
    return _breaker({"state": ("'closed'", state), "failures": ("0", n), "opened": ("0.0::DOUBLE", f"CASE WHEN {opens} THEN x.t ELSE a.opened END")})


def _domain(threshold: int, cooldown: int, probes: int, forget: int) -> str:
    still = f"(a.state = 'open' AND x.t - a.opened < {cooldown})"
    half = f"(a.state = 'open' AND x.t - a.opened >= {cooldown})"
    tried = "(CASE WHEN a.state = 'open' THEN 0 WHEN a.state = 'half_open' THEN a.probes + 1 ELSE a.probes END)"
    shut = f"({still} OR (a.state = 'half_open' AND a.probes + 1 > {probes}))"
    probing = f"({half} OR a.state = 'half_open')"
    n = f"(CASE WHEN a.at IS NOT NULL AND x.t - a.at > {forget} THEN 1 ELSE a.failures + 1 END)"
    plain = f"(NOT {shut} AND NOT {probing})"
    state = f"CASE WHEN {shut} THEN a.state WHEN {probing} THEN CASE WHEN x.ok THEN 'closed' ELSE 'open' END WHEN NOT x.ok AND {n} >= {threshold} THEN 'open' ELSE a.state END"
    failures = f"CASE WHEN {shut} THEN a.failures WHEN {probing} THEN CASE WHEN x.ok THEN 0 ELSE a.failures END WHEN x.ok THEN CASE WHEN a.state = 'closed' THEN 0 ELSE a.failures END ELSE {n} END"
    opened = f"CASE WHEN {shut} OR x.ok THEN a.opened WHEN {probing} OR {n} >= {threshold} THEN x.t ELSE a.opened END"
    tries = f"CASE WHEN {still} THEN a.probes WHEN {probing} AND x.ok AND NOT {shut} THEN 0 ELSE {tried} END"
    at = f"CASE WHEN {plain} AND NOT x.ok THEN x.t ELSE a.at END"
    return _breaker({"state": ("''", state), "failures": ("0", failures), "opened": ("0.0::DOUBLE", opened), "probes": ("0", tries), "at": ("NULL::DOUBLE", at)})


_fold("st_breaker", S.domain_breaker(4, 7200.0, 3, 86400.0), "state", _domain(4, 7200, 3, 86400))
_fold("st_breaker2", S.lazy_breaker(4, 7200.0), "state", _lazy(4, 7200))
_fold("breaker_op", S.component_breaker(3, 3600.0), "state", _component(3, 3600))


@query(
    "st_aimd",
    f"""WITH {_L}, l AS (SELECT domain, list({{'o': event_id, 'ok': status_code BETWEEN 200 AND 299, 'n': 5.0::DOUBLE, 'g': 0, 'b': 0}} ORDER BY ts, event_id) AS e FROM f GROUP BY domain),
r AS (SELECT domain, list_reduce(e, lambda a, x: {{'o': x.o, 'ok': x.ok,
  'n': CASE WHEN x.ok AND a.g = 7 THEN least(5.0::DOUBLE, a.n + 0.5) WHEN NOT x.ok AND a.b = 1 THEN greatest(1.0::DOUBLE, a.n / 2) ELSE a.n END,
  'g': CASE WHEN x.ok AND a.g < 7 THEN a.g + 1 ELSE 0 END, 'b': CASE WHEN NOT x.ok AND a.b < 1 THEN a.b + 1 ELSE 0 END}}, {{'o': 0::BIGINT, 'ok': true, 'n': 5.0::DOUBLE, 'g': 0, 'b': 0}}).n AS n FROM l) SELECT domain, n AS slots FROM r""",
)
def st_aimd(spark, d):
    """The concurrency of domains after their last fetch."""
    all_ = S.ordered(_outcomes(spark, d), "domain", ["ts", "event_id"], ["ok"], S.aimd(), "slots")
    return all_.groupBy("domain").agg(F.max_by("slots", "event_id").alias("slots"))


@query(
    "st_identity",
    f"""WITH {_L}, l AS (SELECT proxy_id, list(CASE WHEN status_code BETWEEN 200 AND 299 THEN 1.0::DOUBLE ELSE 0.0 END ORDER BY ts, event_id) AS r, least(1.0::DOUBLE, 0.001::DOUBLE * count(*) FILTER (status_code = 403)) AS ban FROM f GROUP BY proxy_id) SELECT proxy_id, round(list_reduce(r, lambda a, x: a * 0.9::DOUBLE + x * 0.1::DOUBLE, 1.0::DOUBLE), 6) AS success_rate, round(ban, 6) AS ban_score FROM l""",
)
def st_identity(spark, d):
    """A smoothed success rate, from 1, and a ban score that grows by 0.001 up to 1."""
    o = _outcomes(spark, d)
    rates = S.decayed_mean(o, "proxy_id", "ts", "event_id", F.col("ok").cast("int"), keep=0.9, start=1.0)
    bans = o.groupBy("proxy_id").agg(F.round(F.least(F.lit(1.0), 0.001 * F.count_if("ban")), 6).alias("ban_score"))
    return rates.select("proxy_id", F.round("score", 6).alias("success_rate")).join(bans, "proxy_id")


@query("st_qps", "SELECT s_suppkey, least(10.0, greatest(0.1, s_acctbal / 500)) AS qps FROM supplier")
def st_qps(spark, d):
    """Configured rates, kept between 0.1 and 10."""
    return T.table(spark, d, "supplier").select("s_suppkey", F.least(F.lit(10.0), F.greatest(F.lit(0.1), F.col("s_acctbal") / 500)).alias("qps"))


@query("st_defer", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 AND r + 1 <= 3 THEN 'deferred' WHEN o_orderkey % 3 = 0 THEN 'failed' WHEN o_orderkey % 3 = 1 AND r + 1 <= 3 THEN 'low' WHEN o_orderkey % 3 = 1 THEN 'failed' ELSE 'done' END AS route FROM (SELECT o_orderkey, o_custkey % 5 AS r FROM orders)")
def st_defer(spark, d):
    """Where a task goes: without a token to deferred, after an error to low, once retries are used up to failed."""
    o = T.table(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 5).alias("r"), (F.col("o_orderkey") % 3).alias("what"))
    again = F.col("r") + 1 <= 3
    return o.select("o_orderkey", F.when((F.col("what") == 0) & again, "deferred").when((F.col("what") == 1) & again, "low").when(F.col("what") < 2, "failed").otherwise("done").alias("route"))


@query("st_offload", "SELECT c_custkey, CASE WHEN depth >= 1000 AND active < 50 THEN greatest(0, least(50 - active, depth - 1000, 40)) ELSE 0 END AS n FROM (SELECT c_custkey, c_custkey * 2 AS depth, c_custkey % 60 AS active FROM customer)")
def st_offload(spark, d):
    """How many tasks go to overflow workers: free slots, excess depth and the limit, whichever is least."""
    depth, active = F.col("c_custkey") * 2, F.col("c_custkey") % 60
    n = F.when((depth >= 1000) & (active < 50), F.greatest(F.lit(0), F.least(50 - active, depth - 1000, F.lit(40)))).otherwise(F.lit(0))
    return T.table(spark, d, "customer").select("c_custkey", n.cast("long").alias("n"))


@query("st_dns", f"WITH {_L}, m AS (SELECT q.event_id, max(p.ts) AS seen, arg_max(p.latency_ms < 10000, (p.ts, p.event_id)) AS up, any_value(q.ts) AS ts FROM f q LEFT JOIN f p ON p.domain = q.domain AND (p.ts, p.event_id) < (q.ts, q.event_id) AND p.ts > q.ts - INTERVAL 6 HOUR GROUP BY q.event_id) SELECT event_id, up, coalesce(ts - seen > INTERVAL 5 HOUR, true) AS refresh FROM m")
def st_dns(spark, d):
    """The last probe of a domain no older than six hours, and whether a new one is due. Every event is a lookup, and a
    probe for the events after it by time and id; so the last probe is the row before, found by one scan."""
    from pagelathe.operators.scans import scan

    log = T.fetch_log(spark, d).select("event_id", "domain", "ts", (F.col("latency_ms") < 10000).alias("fast"))
    f = scan(log, "domain", "ts", ["event_id"], probe=F.struct("ts", F.col("fast").alias("up")))
    age = F.unix_micros("ts") - F.unix_micros("probe.ts")
    return f.select("event_id", F.when(age < 6 * 3600 * 10**6, F.col("probe.up")).alias("up"), F.coalesce(age > 5 * 3600 * 10**6, F.lit(True)).alias("refresh"))


_DISPATCH = f"""WITH {_L}, p AS ({_SPACED.format(with_=_L, key="domain", rows="f", us=600 * 10**6)}), g AS (SELECT f.*, CAST(f.user_id AS STRING) AS key FROM f JOIN p USING (event_id) WHERE ok),
q AS ({_SPACED.format(with_="h AS (SELECT 1 AS one)", key="key", rows="g", us=86400 * 10**6)})
SELECT event_id, 'https://x.example/product/' || key AS url, 85 AS priority, 'high' AS topic, 'queued' AS status FROM q WHERE ok"""


@query("st_dispatch", _DISPATCH)
def st_dispatch(spark, d):
    """Dedup, politeness, score and topic of fetches as one plan; politeness is asked before a URL is marked as seen."""
    log = T.fetch_log(spark, d).withColumn("url", F.concat(F.lit("https://x.example/product/"), F.col("user_id").cast("string")))
    polite = S.spaced(log, "domain", "ts", "event_id", seconds=600).where("ok").select("event_id")
    fresh = S.spaced(log.join(polite, "event_id", "left_semi"), "url", "ts", "event_id", seconds=86400).where("ok").select("event_id")
    queued = log.join(fresh, "event_id", "left_semi")
    return queued.select("event_id", "url", U.url_score(F.col("url")).alias("priority"), U.url_topic(U.url_score(F.col("url"))).alias("topic"), F.lit("queued").alias("status"))


@query("sm_thompson")
def sm_thompson(spark, d):
    """Seeded Beta draws of the arms; a tenth explores uniformly."""
    from pagelathe.operators.sampling import beta_draws

    return beta_draws(_arms(spark, d).where("ban_rate < 0.5"), "proxy_id", "alpha", "beta", seed=7)


@query("sm_weighted")
def sm_weighted(spark, d):
    """Weighted choice of a supplier in each nation, by exponential keys from a seeded hash."""
    from pagelathe.operators.sampling import weighted_choice

    s = T.table(spark, d, "supplier").select("s_nationkey", "s_suppkey", F.greatest(F.lit(0.01), F.col("s_acctbal")).alias("w"))
    return weighted_choice(s, "s_nationkey", "s_suppkey", "w", seed=7)


@query("sm_profile")
def sm_profile(spark, d):
    """A weighted category for each customer."""
    from pagelathe.operators.sampling import categorical

    c = T.table(spark, d, "customer")
    return c.select("c_custkey", categorical(F.col("c_custkey"), {"desktop": 0.6, "mobile": 0.3, "tablet": 0.1}, seed=7).alias("profile"))


_AT = "greatest(x.t, coalesce(a.w[-1], x.t), CASE WHEN len(a.w) >= 2 THEN a.w[-2] + 36000000000 ELSE x.t END)"


@query(
    "st_wait",
    f"""WITH {_L}, l AS (SELECT domain, list({{'t': epoch_us(ts), 'o': event_id, 'w': []::BIGINT[], 'v': []::BIGINT[]}} ORDER BY ts, event_id) AS e FROM f GROUP BY domain),
r AS (SELECT list_transform(e, lambda x: x.o) AS o, list_reduce(e, lambda a, x: {{'t': x.t, 'o': x.o,
  'w': CASE WHEN {_AT} - x.t < 72000000000 THEN list_append(a.w, {_AT}) ELSE a.w END,
  'v': list_append(a.v, CASE WHEN {_AT} - x.t < 72000000000 THEN {_AT} - x.t END)}}, {{'t': 0::BIGINT, 'o': 0::BIGINT, 'w': []::BIGINT[], 'v': []::BIGINT[]}}).v AS v FROM l)
SELECT event_id, v // 1000000 AS wait_s, v IS NOT NULL AS admitted FROM (SELECT unnest(o) AS event_id, unnest(v) AS v FROM r)""",
)
def st_wait(spark, d):
    """How long a fetch waits for one of two slots of its domain in ten hours; after twenty hours it gives up."""
    log = T.fetch_log(spark, d).select("domain", F.unix_micros("ts").alias("t"), "event_id")
    waits = S.ordered(log, "domain", ["t", "event_id"], ["t"], S.waiting(36_000_000_000, 2, 72_000_000_000), "v")
    return waits.select("event_id", F.floor(F.col("v") / 1_000_000).cast("long").alias("wait_s"), F.col("v").isNotNull().alias("admitted"))


@query("st_cookie", f"WITH {_L} SELECT domain, arg_max('sid=' || CAST(event_id AS STRING), (ts, event_id)) AS cookies FROM f WHERE status_code = 200 AND ts > (SELECT max(ts) FROM f) - INTERVAL 30 DAY GROUP BY domain")
def st_cookie(spark, d):
    """The last stored header of each domain that is still valid; of those stored at one time that of the later event."""
    log = T.fetch_log(spark, d).where("status_code = 200")
    now = T.fetch_log(spark, d).agg(F.max("ts").alias("now"))
    live = log.join(F.broadcast(now)).where(F.col("ts") > F.col("now") - F.expr("INTERVAL 30 DAY"))
    return live.groupBy("domain").agg(F.max_by(F.concat(F.lit("sid="), F.col("event_id").cast("string")), F.struct("ts", "event_id")).alias("cookies"))
