"""Aggregations, windows and rankings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pagelathe.functions import extraction as X
from pagelathe.functions import responses as R
from pagelathe.functions import urls as U
from pagelathe.operators import aggregates as A
from pagelathe.operators import scans
from pagelathe.operators.alerts import RULES as ALERTS
from pagelathe.plans.registry import query
from pagelathe.plans.response_queries import BLOCKED, REWARD
from pagelathe.plans.url_queries import segments
from pagelathe.sources import tables as T

_L = f"f AS ({T.FETCH_LOG})"
_OUT = f"CASE WHEN status_code BETWEEN 200 AND 299 AND NOT {BLOCKED} THEN 'success' WHEN challenge_type <> '' THEN 'captcha' WHEN {BLOCKED} THEN 'blocked' ELSE 'failed' END"
_RATES = ", ".join(f"round(count(*) FILTER (o = '{o}') / count(*), 6) AS {o}_rate" for o in ("success", "blocked", "captcha", "failed"))


def _reward():
    return R.reward(F.col("status_code"), F.col("challenge_type"), F.col("latency_ms"))


def _rounded(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


@query("agg_domain", f"WITH {_L} SELECT domain, count(*) AS total, round_even(100.0 * count(*) FILTER (status_code BETWEEN 200 AND 299) / count(*), 1) AS success_pct, round_even(avg(latency_ms), 0) AS avg_ms, count(*) FILTER (NOT status_code BETWEEN 200 AND 299) AS fail FROM f GROUP BY domain")
def agg_domain(spark, d):
    """Totals, success percentage and mean latency of domains, rounded half to even."""
    ok = R.is_success(F.col("status_code"))
    return T.fetch_log(spark, d).groupBy("domain").agg(F.count("*").alias("total"), F.bround(100.0 * F.count_if(ok) / F.count("*"), 1).alias("success_pct"), F.bround(F.avg("latency_ms"), 0).alias("avg_ms"), F.count_if(~ok).alias("fail"))


@query("agg_health", f"WITH {_L}, g AS (SELECT *, {_OUT} AS o FROM f) SELECT domain, count(*) AS total, {_RATES} FROM g GROUP BY domain")
def agg_health(spark, d):
    return _rounded(A.health(T.fetch_log(spark, d), "domain"), "success_rate", "blocked_rate", "captcha_rate", "failed_rate")


@query("agg_health_rollup", f"WITH {_L}, g AS (SELECT *, {_OUT} AS o FROM f) SELECT domain, engine, count(*) AS total, {_RATES} FROM g GROUP BY ROLLUP (domain, engine)")
def agg_health_rollup(spark, d):
    """Extension: health by domain and engine with subtotals."""
    g = T.fetch_log(spark, d).withColumn("o", A.outcome(F.col("status_code"), F.col("challenge_type")))
    rate = lambda o: F.round(F.count_if(F.col("o") == o) / F.count("*"), 6).alias(f"{o}_rate")
    return g.rollup("domain", "engine").agg(F.count("*").alias("total"), *map(rate, ("success", "blocked", "captcha", "failed")))


@query("agg_latency", f"WITH {_L}, r AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY ts DESC, event_id DESC) AS n FROM f WHERE latency_ms > 0), v AS (SELECT domain, list_sort(list(latency_ms)) AS v, avg(latency_ms) AS mean FROM r WHERE n <= 100 GROUP BY domain) SELECT domain, v[least(CAST(floor(len(v) * 0.5) AS INT) + 1, len(v))] AS p50, v[least(CAST(floor(len(v) * 0.99) AS INT) + 1, len(v))] AS p99, round(mean, 6) AS mean FROM v")
def agg_latency(spark, d):
    return _rounded(A.latency(T.fetch_log(spark, d)), "mean")


@query("win_last_n", f"WITH {_L}, r AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY ts DESC, event_id DESC) AS n FROM f) SELECT domain, event_id, n AS nth FROM r WHERE n <= 100")
def win_last_n(spark, d):
    return A.last_n(T.fetch_log(spark, d), 100, "domain", F.desc("ts"), F.desc("event_id")).select("domain", "event_id", F.col("nth").cast("long").alias("nth"))


@query("agg_count", "SELECT o_orderstatus AS status, count(*) AS n, count(*) > 0 AS present FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY o_orderstatus")
def agg_count(spark, d):
    return T.table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"), (F.count("*") > 0).alias("present"))


@query("agg_dedup_count", f"WITH u AS ({T.URLS}) SELECT count(DISTINCT url) AS urls, count(DISTINCT lower(regexp_extract(url, '^[A-Za-z]+://([^/:?#]+)', 1))) AS domains FROM u")
def agg_dedup_count(spark, d):
    return T.urls(spark, d).agg(F.count_distinct("url").alias("urls"), F.count_distinct(U.domain(F.col("url"))).alias("domains"))


@query("agg_dedup_days", f"WITH {_L} SELECT CAST(ts AS DATE) AS day, count(DISTINCT domain || '/' || user_id) AS urls FROM f GROUP BY 1")
def agg_dedup_days(spark, d):
    """Distinct URLs of each day, exactly; seen_by_day() keeps a sketch beside the count, from which any span is estimated."""
    log = T.fetch_log(spark, d).select("ts", F.concat("domain", F.lit("/"), F.col("user_id").cast("string")).alias("url"))
    return A.seen_by_day(log, "ts", "url").select("day", F.col("exact").alias("urls"))


@query("agg_rules", f"WITH r AS ({T.RULES}) SELECT domain, count(DISTINCT path_pattern) AS patterns, count(*) AS total_rules FROM r GROUP BY domain")
def agg_rules(spark, d):
    return T.rules(spark, d).groupBy("domain").agg(F.count_distinct("path_pattern").alias("patterns"), F.count("*").alias("total_rules"))


# link graph of page patterns: each page's pattern and those of its links, resolved against the page
_HREF = """unnest(regexp_extract_all(html, '(?i)<a\\s[^>]*href="([^"]*)"', 1))"""
_SCHEME = "[A-Za-z][A-Za-z0-9+.-]*:"
_EDGES = f"""x AS (SELECT lower(regexp_extract(url, '^[A-Za-z]+://([^/:?#]+)', 1)) AS host, regexp_replace(regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), ';[^/]*$', '') AS path, regexp_replace(trim({_HREF}), '[?#].*$', '') AS rest FROM pages),
w AS (SELECT host, path, CASE WHEN regexp_matches(rest, '^({_SCHEME})?//') THEN regexp_replace(rest, '^({_SCHEME})?//[^/]*', '') WHEN regexp_matches(rest, '^{_SCHEME}') THEN NULL WHEN rest = '' THEN path WHEN starts_with(rest, '/') THEN rest ELSE regexp_replace(path, '[^/]*$', '') || rest END AS whole FROM x),
l AS (SELECT host, path, list_reduce(list_transform(string_split(regexp_replace(whole, ';[^/]*$', ''), '/'), lambda s: [s]), lambda a, s: CASE WHEN s[1] = '..' THEN a[1:len(a) - 1] WHEN s[1] IN ('', '.') THEN a ELSE list_concat(a, s) END, []::VARCHAR[]) AS steps FROM w WHERE whole IS NOT NULL),
t AS (SELECT host, path, '/' || array_to_string(steps, '/') AS target FROM l),
e AS (SELECT DISTINCT regexp_extract(host, '[^.]+\\.[^.]+$', 0) AS domain, {segments("path")} AS src, {segments("target")} AS dst FROM t)"""


def _edges(spark, d):
    """Whole patterns of pages and of their links; an absolute link counts by its path, a relative one from its page."""
    x = T.table(spark, d, "pages").select(F.regexp_extract(U.host(F.col("url")), r"[^.]+\.[^.]+$", 0).alias("domain"), U.path(F.col("url")).alias("path"), F.explode(X.links(F.col("html"))).alias("href"))
    return x.select("domain", U.path_pattern(F.col("path")).alias("src"), U.path_pattern(U.link_path(F.col("path"), F.col("href"))).alias("dst")).where("dst IS NOT NULL").distinct()


@query("agg_hubs", f"WITH {_EDGES} SELECT domain, src AS pattern, count(DISTINCT dst) AS n FROM e GROUP BY 1, 2 HAVING n >= 3")
def agg_hubs(spark, d):
    """Patterns with at least three distinct outgoing patterns."""
    from pagelathe.operators.sitemap import hubs

    return hubs(_edges(spark, d), 3)


@query("agg_hubs_in", f"WITH {_EDGES} SELECT domain, dst AS pattern, count(DISTINCT src) AS n FROM e GROUP BY 1, 2 HAVING n >= 3")
def agg_hubs_in(spark, d):
    """Patterns with at least three distinct incoming patterns."""
    from pagelathe.operators.sitemap import hubs

    return hubs(_edges(spark, d), 3, direction="in")


_KNOWN = f"{_EDGES}, k AS (SELECT domain, src AS pattern FROM e UNION SELECT domain, dst FROM e), v AS (SELECT DISTINCT domain, src AS pattern FROM e)"


@query("agg_sitemap", f"WITH {_KNOWN} SELECT k.domain, count(*) AS total, count(v.pattern) AS visited, count(*) - count(v.pattern) AS unvisited, round(100.0 * count(v.pattern) / count(*), 1) AS coverage FROM k LEFT JOIN v ON k.domain = v.domain AND k.pattern = v.pattern GROUP BY 1")
def agg_sitemap(spark, d):
    """Known, visited and unvisited patterns of domains."""
    from pagelathe.operators.sitemap import coverage

    e = _edges(spark, d)
    return coverage(e, e.select("domain", F.col("src").alias("pattern")))


@query("set_except", f"WITH {_KNOWN} SELECT domain, pattern FROM k EXCEPT SELECT domain, pattern FROM v")
def set_except(spark, d):
    """Known patterns that have not been visited."""
    from pagelathe.operators.sitemap import patterns

    e = _edges(spark, d)
    return patterns(e).subtract(e.select("domain", F.col("src").alias("pattern")))


@query("agg_reward_dom", f"WITH {_L}, r AS (SELECT domain, {REWARD} AS r FROM f) SELECT domain, round(greatest(0.0, least(1.0, (avg(r) - CASE WHEN count(*) > 1 THEN least(0.2, stddev_pop(r) * 0.5) ELSE 0 END) * 0.7 + 0.3)), 6) AS reward FROM r GROUP BY domain")
def agg_reward_dom(spark, d):
    return _rounded(A.domain_reward(T.fetch_log(spark, d), _reward()), "reward")


_ARMS = f"{_L}, r AS (SELECT proxy_id, {REWARD} AS r, (status_code = 403)::INT AS ban FROM f), a AS (SELECT proxy_id, count(*) + sum(ban) AS trials, count(*) FILTER (r > 0.5) AS successes, count(*) FILTER (NOT r > 0.5) + sum(ban) AS failures, sum(ban) AS ban_hits, 1 + sum(CASE WHEN r > 0.5 THEN r ELSE 0 END) AS alpha, 1 + sum(CASE WHEN r > 0.5 THEN 0 ELSE 1 - r END) + sum(ban) AS beta FROM r GROUP BY proxy_id), b AS (SELECT *, alpha / (alpha + beta) AS estimate, ban_hits / trials AS ban_rate FROM a)"


def _arms(spark, d):
    return A.arms(T.fetch_log(spark, d), _reward(), F.col("status_code") == 403, "proxy_id")


@query("st_bandit", f"WITH {_ARMS} SELECT proxy_id, CAST(trials AS BIGINT) AS trials, successes, CAST(failures AS BIGINT) AS failures, CAST(ban_hits AS BIGINT) AS ban_hits, round(alpha, 6) AS alpha, round(beta, 6) AS beta, round(estimate, 6) AS estimate, round(ban_rate, 6) AS ban_rate FROM b")
def st_bandit(spark, d):
    return _rounded(_arms(spark, d), "alpha", "beta", "estimate", "ban_rate")


@query("agg_bandit", f"WITH {_ARMS} SELECT count(*) AS arms, CAST(sum(trials) AS BIGINT) AS trials, CAST(sum(ban_hits) AS BIGINT) AS bans, count(*) FILTER (ban_rate < 0.5) AS active, round(max(estimate), 6) AS best_reward FROM b")
def agg_bandit(spark, d):
    return _arms(spark, d).agg(F.count("*").alias("arms"), F.sum("trials").alias("trials"), F.sum("ban_hits").alias("bans"), F.count_if(F.col("ban_rate") < 0.5).alias("active"), F.round(F.max("estimate"), 6).alias("best_reward"))


@query("argmax_arm", f"WITH {_ARMS} SELECT arg_min(proxy_id, (-round(estimate, 9), proxy_id)) AS proxy_id FROM b WHERE ban_rate < 0.5")
def argmax_arm(spark, d):
    """The arm with the best estimate that is not banned; of those equal in nine digits the one with the smallest id."""
    rank = F.struct((-F.round("estimate", 9)).alias("x"), "proxy_id")
    return _arms(spark, d).where("ban_rate < 0.5").agg(F.min_by("proxy_id", rank).alias("proxy_id"))


@query("sm_ucb", f"WITH {_ARMS}, t AS (SELECT sum(trials) + 1 AS total FROM b) SELECT proxy_id, round(estimate + 2.0 * sqrt(ln(total) / trials), 6) AS ucb FROM b, t WHERE ban_rate < 0.5")
def sm_ucb(spark, d):
    """Upper confidence bounds of the arms that are not banned; the one-row total is broadcast."""
    a = _arms(spark, d)
    total = a.agg((F.sum("trials") + 1).alias("total"))
    return a.where("ban_rate < 0.5").join(F.broadcast(total)).select("proxy_id", F.round(F.col("estimate") + 2.0 * F.sqrt(F.log("total") / F.col("trials")), 6).alias("ucb"))


@query("sm_exp3", f"WITH {_ARMS}, w AS (SELECT proxy_id, greatest(0.001, estimate * (1 - ban_rate)) AS w FROM b WHERE ban_rate < 0.5) SELECT proxy_id, round(0.9 * w / (SELECT sum(w) FROM w) + 0.1 / (SELECT count(*) FROM w), 6) AS p FROM w")
def sm_exp3(spark, d):
    """Selection probabilities with a tenth of uniform exploration."""
    w = _arms(spark, d).where("ban_rate < 0.5").select("proxy_id", F.greatest(F.lit(0.001), F.col("estimate") * (1 - F.col("ban_rate"))).alias("w"))
    total = w.agg(F.sum("w").alias("sum"), F.count("*").alias("n"))
    return w.join(F.broadcast(total)).select("proxy_id", F.round(0.9 * F.col("w") / F.col("sum") + 0.1 / F.col("n"), 6).alias("p"))


@query("agg_counters", f"WITH {_L} SELECT domain, engine, status_code, count(*) AS n FROM f GROUP BY GROUPING SETS ((domain, engine, status_code), (domain), ())")
def agg_counters(spark, d):
    """Labelled counters; the coarser grains are an extension."""
    return spark.sql("SELECT domain, engine, status_code, count(*) AS n FROM {f} GROUP BY GROUPING SETS ((domain, engine, status_code), (domain), ())", f=T.fetch_log(spark, d))


def _hist_sql(bounds: list[float], value: str) -> str:
    return " UNION ALL ".join(f"SELECT domain, engine, {float(b)}::DOUBLE AS le, count(*) FILTER ({value} <= {b}) AS n FROM f GROUP BY domain, engine" for b in bounds)


@query("agg_hist", f"WITH {_L} {_hist_sql(A.TASK_SECONDS, 'latency_ms / 1000')}")
def agg_hist(spark, d):
    return A.histogram(T.fetch_log(spark, d), F.col("latency_ms") / 1000, A.TASK_SECONDS, "domain", "engine")


@query("agg_hist_request", f"WITH {_L} {_hist_sql(A.REQUEST_SECONDS, 'latency_ms / 1000')}")
def agg_hist_request(spark, d):
    return A.histogram(T.fetch_log(spark, d), F.col("latency_ms") / 1000, A.REQUEST_SECONDS, "domain", "engine")


@query("agg_gauges", f"WITH {_L} SELECT domain, arg_max(latency_ms, event_id) AS last_value FROM f GROUP BY domain")
def agg_gauges(spark, d):
    """The last value of each label."""
    return T.fetch_log(spark, d).groupBy("domain").agg(F.max_by("latency_ms", "event_id").alias("last_value"))


_CUM = f"h AS ({' UNION ALL '.join(f'SELECT engine, {float(b)}::DOUBLE AS le, count(*) FILTER (latency_ms / 1000 <= {b}) AS n FROM f GROUP BY engine' for b in A.TASK_SECONDS)})"


@query("agg_hquant", f"WITH {_L}, {_CUM}, w AS (SELECT engine, le, n, coalesce(lag(le) OVER o, 0) AS lo, coalesce(lag(n) OVER o, 0) AS below, max(n) OVER (PARTITION BY engine) * 0.95 AS rank, max(le) OVER (PARTITION BY engine) AS top FROM h WINDOW o AS (PARTITION BY engine ORDER BY le)) SELECT engine, round(coalesce(min(lo + (le - lo) * (rank - below) / (n - below)) FILTER (n >= rank AND below < rank), any_value(top)), 6) AS quantile FROM w GROUP BY engine")
def agg_hquant(spark, d):
    """The 95th percentile of latency, interpolated from histogram buckets."""
    counts = A.histogram(T.fetch_log(spark, d), F.col("latency_ms") / 1000, A.TASK_SECONDS, "engine")
    return _rounded(A.histogram_quantile(counts, 0.95, "engine"), "quantile")


@query("agg_queue", "SELECT CAST(l_linenumber AS BIGINT) AS topic, CAST(sum(l_orderkey - c) AS BIGINT) AS depth FROM (SELECT l_linenumber, l_orderkey, CASE WHEN l_partkey % 5 > 0 THEN l_partkey % 100 END AS c FROM lineitem) WHERE c IS NOT NULL GROUP BY 1")
def agg_queue(spark, d):
    """Queue depth: end less committed offset, partitions without a commit ignored."""
    q = T.table(spark, d, "lineitem").select(F.col("l_linenumber").cast("long").alias("topic"), F.col("l_orderkey").alias("end"), F.when(F.col("l_partkey") % 5 > 0, F.col("l_partkey") % 100).alias("committed"))
    return q.where("committed IS NOT NULL").groupBy("topic").agg(F.sum(F.col("end") - F.col("committed")).cast("long").alias("depth"))


@query("agg_dash", "SELECT count(*) AS total, round(100.0 * count(*) FILTER (o_orderstatus = 'F') / count(*), 1) AS success_pct, count(*) FILTER (o_orderstatus IN ('O', 'P')) AS active FROM orders")
def agg_dash(spark, d):
    s = F.col("o_orderstatus")
    return T.table(spark, d, "orders").agg(F.count("*").alias("total"), F.round(F.try_divide(100.0 * F.count_if(s == "F"), F.count("*")), 1).alias("success_pct"), F.count_if(s.isin("O", "P")).alias("active"))


@query("agg_proxy_health", f"WITH {_L}, g AS (SELECT proxy_id, CASE WHEN status_code BETWEEN 200 AND 299 THEN 1 ELSE 0 END AS ok FROM f) SELECT proxy_id, CAST(sum(ok) AS BIGINT) AS healthy, CAST(count(*) - sum(ok) AS BIGINT) AS unhealthy FROM g GROUP BY proxy_id")
def agg_proxy_health(spark, d):
    ok = R.is_success(F.col("status_code"))
    return T.fetch_log(spark, d).groupBy("proxy_id").agg(F.count_if(ok).alias("healthy"), F.count_if(~ok).alias("unhealthy"))


@query("agg_batch", f"WITH u AS ({T.URLS}) SELECT regexp_extract(id, '^[a-z]+', 0) AS batch, count(*) FILTER (contains(url, '.com')) AS accepted, count(*) FILTER (NOT contains(url, '.com')) AS skipped, min(CASE WHEN contains(url, '.com') THEN id END) AS first_id FROM u GROUP BY 1")
def agg_batch(spark, d):
    """Accepted and skipped URLs of a batch; ids stay in the task table and only the first is shown."""
    good = F.contains("url", F.lit(".com"))
    return T.urls(spark, d).groupBy(F.regexp_extract("id", "^[a-z]+", 0).alias("batch")).agg(F.count_if(good).alias("accepted"), F.count_if(~good).alias("skipped"), F.min(F.when(good, F.col("id"))).alias("first_id"))


_MINUTE = "epoch_us(ts) // 60000000"
_GAUGES = f"""ban AS (SELECT 'HighBanScore' AS rule, domain AS label, m * 60000000 AS t, least(1.0, greatest(0.0, 0.4::DOUBLE * blocked + 0.4::DOUBLE * captcha + 0.2::DOUBLE * (failed * 0.5::DOUBLE))) AS v
  FROM (SELECT domain, {_MINUTE} AS m, count(*) FILTER (o = 'blocked') / count(*) AS blocked, count(*) FILTER (o = 'captcha') / count(*) AS captcha, count(*) FILTER (o = 'failed') / count(*) AS failed FROM (SELECT *, {_OUT} AS o FROM f) GROUP BY 1, 2)),
gauges AS (SELECT * FROM ban UNION ALL SELECT 'DomainBlocked', label, t, v FROM ban
  UNION ALL SELECT 'ProxyPoolLow', 'all', {_MINUTE} * 60000000, count(DISTINCT proxy_id) FROM f GROUP BY {_MINUTE}
  UNION ALL SELECT 'NoWorkers', 'all', {_MINUTE} * 60000000, count(DISTINCT engine) FILTER (status_code BETWEEN 200 AND 299) FROM f GROUP BY {_MINUTE}
  UNION ALL SELECT 'KafkaQueueBacklog', engine, epoch_us(ts), latency_ms FROM f),
last AS (SELECT rule, label, step, arg_max(v, (t, v)) AS v FROM (SELECT *, unnest(range((t + 59999999) // 60000000, (t + 59999999) // 60000000 + 5)) AS step FROM gauges) GROUP BY ALL)"""
_COUNTERS = """counters AS (SELECT engine, CASE WHEN status_code >= 400 THEN 'failed' ELSE 'done' END AS status, epoch_us(ts) AS t, row_number() OVER (PARTITION BY status_code >= 400, epoch_us(ts) // 86400000000 ORDER BY ts, event_id) AS v FROM f),
deltas AS (SELECT *, CASE WHEN p IS NULL THEN 0 WHEN v >= p THEN v - p ELSE v END AS d FROM (SELECT *, lag(v) OVER (PARTITION BY status ORDER BY t, v) AS p FROM counters)),
ranges AS (SELECT status, step, count(*) AS n, CAST(sum(d) - arg_min(d, (t, v)) AS DOUBLE) AS up, arg_min(v, (t, v)) AS v, (max(t) - min(t)) / 1e6 AS span, min(t) / 1e6 - (step * 60 - 300) AS lead, step * 60 - max(t) / 1e6 AS tail
  FROM (SELECT *, unnest(range((t + 59999999) // 60000000, (t + 59999999) // 60000000 + 5)) AS step FROM deltas) GROUP BY status, step HAVING count(*) > 1 AND max(t) > min(t)),
rates AS (SELECT status, step, up * ((span + least(CASE WHEN lead >= span / (n - 1) * 1.1::DOUBLE THEN span / (n - 1) / 2 ELSE lead END, CASE WHEN up > 0 THEN span * v / up END) + CASE WHEN tail >= span / (n - 1) * 1.1::DOUBLE THEN span / (n - 1) / 2 ELSE tail END) / span) / 300 AS r FROM ranges),
ratio AS (SELECT 'HighFailureRate' AS rule, 'all' AS label, step, sum(r) FILTER (status = 'failed') / sum(r) AS v FROM rates GROUP BY step HAVING sum(r) > 0 AND count(*) FILTER (status = 'failed') > 0)"""
_LIMITS = ", ".join(f"('{name}', '{op}', {limit}::DOUBLE, {minutes})" for name, op, limit, minutes in ALERTS)


@query(
    "alert_rules",
    f"""WITH {_L}, {_GAUGES}, {_COUNTERS}, rules(rule, op, lim, hold) AS (VALUES {_LIMITS}),
broken AS (SELECT *, step - row_number() OVER (PARTITION BY rule, label ORDER BY step) AS island FROM (SELECT * FROM last UNION ALL SELECT * FROM ratio) JOIN rules USING (rule) WHERE CASE op WHEN '>' THEN v > lim WHEN '<' THEN v < lim ELSE v = lim END)
SELECT rule, label, min(step) AS since, min(step) + any_value(hold) AS fires, max(step) AS until, round(CASE WHEN any_value(op) = '<' THEN min(v) ELSE max(v) END, 6) AS peak FROM broken GROUP BY rule, label, island HAVING max(step) - min(step) >= any_value(hold)""",
)
def alert_rules(spark, d):
    """All six rules over metrics scraped from the log, at one-minute steps: ban scores of domains by minute, proxies and
    workers in use, queue depths, and the failed tasks' share of the rates of counters that restart every midnight."""
    from pagelathe.operators import alerts, folds

    log = T.fetch_log(spark, d)
    minute = F.floor(F.unix_micros("ts") / 60_000_000)
    sample = lambda df, label, value: df.select(label.alias("label"), F.timestamp_seconds(F.col("bucket") * 60).alias("ts"), value.cast("double").alias("value"))
    bans = folds.buckets(log, 60)
    bans = alerts.last_value(sample(bans, F.col("domain"), folds.raw_ban(F.col("blocked"), F.col("captcha"), F.col("failed"))))
    used = log.groupBy(minute.alias("bucket")).agg(F.count_distinct("proxy_id").alias("pool"), F.count_distinct(F.when(R.is_success(F.col("status_code")), F.col("engine"))).alias("workers"))
    depths = log.select(F.col("engine").alias("label"), "ts", F.col("latency_ms").alias("value"))
    failed = F.col("status_code") >= 400
    since_start = Window.partitionBy(failed, F.floor(F.unix_micros("ts") / 86_400_000_000)).orderBy("ts", "event_id")
    counters = log.select(F.when(failed, "failed").otherwise("done").alias("series"), F.lit("all").alias("label"), "ts", F.row_number().over(since_start).cast("double").alias("value"))
    values = {
        "HighBanScore": bans,
        "DomainBlocked": bans,
        "ProxyPoolLow": alerts.last_value(sample(used, F.lit("all"), F.col("pool"))),
        "NoWorkers": alerts.last_value(sample(used, F.lit("all"), F.col("workers"))),
        "KafkaQueueBacklog": alerts.last_value(depths),
        "HighFailureRate": alerts.failure_ratio(alerts.rate(counters), "failed"),
    }
    out = None
    for rule, found in values.items():
        spans = alerts.firing(found, rule)
        out = spans if out is None else out.unionByName(spans)
    return _rounded(out, "peak")


@query("danger_domains", f"WITH {_L}, g AS (SELECT domain, round(avg(CASE WHEN {BLOCKED} THEN 1.0::DOUBLE ELSE 0 END), 6) AS score FROM f GROUP BY domain) SELECT domain, score FROM g WHERE score >= 0.2")
def danger_domains(spark, d):
    blocked = R.is_blocked(F.col("status_code"), F.col("challenge_type"))
    g = T.fetch_log(spark, d).groupBy("domain").agg(F.round(F.avg(F.when(blocked, 1.0).otherwise(0.0)), 6).alias("score"))
    return g.where("score >= 0.2").orderBy(F.desc("score"), "domain")


@query("win_rate", f"WITH {_L} SELECT event_id, count(*) OVER (PARTITION BY domain ORDER BY epoch_us(ts) RANGE BETWEEN 3600000000 PRECEDING AND 1 PRECEDING) AS n FROM f")
def win_rate(spark, d):
    """Arrivals of a domain in the hour before an event."""
    return scans.arrivals(T.fetch_log(spark, d).select("event_id", "domain", "ts"), "domain", "ts", 3600).select("event_id", "n")


@query("win_gap", f"WITH {_L} SELECT event_id, greatest(0, 3600000 - (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY domain ORDER BY ts, event_id)) // 1000) AS wait_ms FROM f")
def win_gap(spark, d):
    """How long to wait until an hour has passed since the domain's previous request."""
    log = scans.scan(T.fetch_log(spark, d).select("event_id", "domain", "ts"), "domain", "ts", ["event_id"], last=F.unix_micros("ts"))
    gap = F.floor((F.unix_micros("ts") - F.col("last")) / 1000)
    return log.select("event_id", F.when(gap.isNotNull(), F.greatest(F.lit(0), 3_600_000 - gap)).otherwise(F.lit(0)).cast("long").alias("wait_ms"))


@query("win_streak", f"WITH {_L}, g AS (SELECT *, sum(CASE WHEN status_code < 400 THEN 1 ELSE 0 END) OVER (PARTITION BY domain ORDER BY ts, event_id) AS island FROM f) SELECT event_id, CASE WHEN status_code < 400 THEN 0 ELSE row_number() OVER (PARTITION BY domain, island ORDER BY ts, event_id) - CASE WHEN island > 0 THEN 1 ELSE 0 END END AS streak FROM g")
def win_streak(spark, d):
    """Consecutive failures up to each event."""
    log = T.fetch_log(spark, d).select("event_id", "domain", "ts", "status_code")
    return scans.streak(log, "domain", "ts", ["event_id"], F.col("status_code") < 400).select("event_id", "streak")


@query("win_rr", f"WITH {_L}, n AS (SELECT event_id, domain, (row_number() OVER (PARTITION BY domain ORDER BY ts, event_id) - 1) % 10 AS i FROM f), p AS (SELECT proxy_id, row_number() OVER (ORDER BY proxy_id) - 1 AS i FROM (SELECT DISTINCT proxy_id FROM f)) SELECT event_id, proxy_id FROM n JOIN p USING (i)")
def win_rr(spark, d):
    """Round robin over the pool's ids, in their order, along a domain's events. The pool is one row, as in a rotator."""
    log = T.fetch_log(spark, d)
    pool = log.agg(F.array_sort(F.collect_set("proxy_id")).alias("ids"))
    turns = scans.scan(log.select("event_id", "domain", "ts"), "domain", "ts", ["event_id"], nth="nth").join(F.broadcast(pool))
    return turns.select("event_id", F.element_at("ids", (F.pmod(F.col("nth") - 1, F.size("ids")) + 1).cast("int")).alias("proxy_id"))


_ATT = f"{_L}, a AS (SELECT user_id AS request, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS attempt, engine, status_code, challenge_type FROM f)"


def _attempts(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return T.fetch_log(spark, d).select(F.col("user_id").alias("request"), (F.row_number().over(w) - 1).alias("attempt"), "engine", "status_code", "challenge_type")


@query("win_escalate", f"WITH {_ATT}, x AS (SELECT * FROM a WHERE attempt < 4) SELECT request, coalesce(arg_min(engine, attempt) FILTER (status_code BETWEEN 200 AND 299 AND NOT {BLOCKED}), arg_max(engine, attempt)) AS engine, count(*) FILTER (status_code BETWEEN 200 AND 299 AND NOT {BLOCKED}) > 0 AS ok FROM x GROUP BY request")
def win_escalate(spark, d):
    """The engine of the first of four attempts that succeeds, else that of the last."""
    good = R.is_success(F.col("status_code")) & ~R.is_blocked(F.col("status_code"), F.col("challenge_type"))
    a = _attempts(spark, d).where("attempt < 4").withColumn("good", good)
    return a.groupBy("request").agg(F.coalesce(F.min_by("engine", F.when(F.col("good"), F.col("attempt"))), F.max_by("engine", "attempt")).alias("engine"), F.bool_or("good").alias("ok"))


@query("st_retry", f"WITH {_ATT}, x AS (SELECT *, (status_code BETWEEN 200 AND 299) OR ({BLOCKED} AND challenge_type = '') AS stop FROM a WHERE attempt <= 3), s AS (SELECT request, coalesce(min(attempt) FILTER (stop), max(attempt)) AS last FROM x GROUP BY request) SELECT s.request, s.last AS retry_count, x.status_code, CAST(pow(2, s.last) - 1 AS BIGINT) AS nominal_wait_s FROM s JOIN x ON x.request = s.request AND x.attempt = s.last")
def st_retry(spark, d):
    """Up to three retries: the attempt at which retrying stops, its status, and the nominal backoff before it."""
    stop = R.is_success(F.col("status_code")) | (R.is_blocked(F.col("status_code"), F.col("challenge_type")) & (F.col("challenge_type") == ""))
    a = _attempts(spark, d).where("attempt <= 3").withColumn("stop", stop)
    key = F.struct((~F.col("stop")).alias("no"), F.when(F.col("stop"), F.col("attempt")).otherwise(-F.col("attempt")).alias("at"))
    best = a.groupBy("request").agg(F.min_by(F.struct("attempt", "status_code"), key).alias("x"))
    return best.select("request", F.col("x.attempt").cast("long").alias("retry_count"), F.col("x.status_code").alias("status_code"), (F.pow(F.lit(2), "x.attempt") - 1).cast("long").alias("nominal_wait_s"))


@query(
    "mw_chain",
    f"""WITH {_L}, a AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n, (status_code BETWEEN 200 AND 299) OR ({BLOCKED} AND challenge_type = '') AS stop FROM f),
b AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN stop THEN n ELSE 7 - n END) AS best FROM a WHERE n <= 3)
SELECT user_id AS request, n AS retry_count, status_code, round(latency_ms, 3) AS total_ms,
  CASE WHEN k % 3 = 0 THEN 'Accept=*/*;' ELSE '' END || 'Accept-Language=' || CASE WHEN engine = 'http' THEN 'de-DE,de' ELSE 'fr-FR,fr' END || ';q=0.9' || CASE WHEN engine <> 'nodriver' THEN ';User-Agent=agent/' || proxy_id WHEN k % 3 = 0 THEN ';User-Agent=own' ELSE '' END AS headers,
  'lang=x;sid=' || CASE WHEN k % 2 = 0 THEN 'own' ELSE domain END AS cookies FROM b WHERE best = 1""",
)
def mw_chain(spark, d):
    """Requests through the default chain and cached cookies: retries, timing, the identity's headers."""
    from pagelathe.operators.chain import Chain, cookies

    text = lambda *kv: F.create_map(*(F.lit(x) if isinstance(x, str) else x for x in kv))
    k, engine = F.col("k"), F.col("engine")
    log = T.fetch_log(spark, d)
    ended = F.timestamp_micros(F.unix_micros("ts") + F.round(F.col("latency_ms") * 1000).cast("long"))
    requests = log.withColumns({"request": F.col("user_id"), "started": F.col("ts"), "ended": ended, "total_ms": F.when(F.col("event_id") % 3 != 0, F.col("latency_ms")), "headers": F.when(k % 3 == 0, text("Accept", "*/*", "User-Agent", "own")), "cookies": F.when(k % 2 == 0, text("sid", "own"))})
    identity = (F.when(engine != "nodriver", F.concat(F.lit("agent/"), "proxy_id")), F.when(engine == "http", "de-DE").otherwise("fr-FR"))
    done = Chain.default(identity).add(cookies(text("sid", F.col("domain"), "lang", "x")))(requests)
    shown = lambda c: F.array_join(F.transform(F.array_sort(F.map_entries(c)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias(c)
    return done.select("request", F.col("retry_count").cast("long").alias("retry_count"), "status_code", F.round("total_ms", 3).alias("total_ms"), shown("headers"), shown("cookies"))
