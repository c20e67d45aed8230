"""Predicates, classifiers and scores of responses, and data-quality rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagelathe.functions import responses as R
from pagelathe.plans.registry import query
from pagelathe.sources import tables as T

_L = f"f AS ({T.FETCH_LOG})"
BLOCKED = "(status_code IN (403, 429) OR challenge_type <> '')"
REWARD = f"""greatest(0.0, least(1.0, CASE WHEN status_code BETWEEN 200 AND 299 THEN 0.5::DOUBLE WHEN status_code BETWEEN 300 AND 399 THEN 0.3 WHEN status_code = 403 THEN -0.1
  WHEN status_code = 429 THEN 0.0 WHEN status_code BETWEEN 400 AND 499 THEN 0.1 ELSE 0.0 END
  - CASE WHEN challenge_type IN ('cloudflare', 'datadome') THEN 0.5::DOUBLE WHEN challenge_type = 'akamai' THEN 0.4 WHEN challenge_type = 'captcha' THEN 0.6 ELSE 0.0 END
  - CASE WHEN {BLOCKED} THEN 0.3::DOUBLE ELSE 0.0 END
  + CASE WHEN latency_ms <= 0 THEN 0.0::DOUBLE WHEN latency_ms < 1000 THEN 0.2 WHEN latency_ms < 3000 THEN 0.15 WHEN latency_ms < 5000 THEN 0.1 WHEN latency_ms < 10000 THEN 0.05 ELSE 0.0 END
  + CASE WHEN status_code BETWEEN 200 AND 299 THEN 0.2::DOUBLE ELSE 0.0 END))"""
BAN = "greatest(0.0::DOUBLE, CASE WHEN status_code = 403 THEN 0.8 WHEN status_code = 429 THEN 0.5 ELSE 0.0 END, CASE WHEN challenge_type IN ('cloudflare', 'datadome') THEN 0.9 WHEN challenge_type = 'akamai' THEN 0.8 WHEN challenge_type IN ('captcha', 'recaptcha', 'hcaptcha') THEN 0.95 ELSE 0.0 END, CASE WHEN status_code = 200 AND challenge_type = 'suspicious_blank' THEN 0.7 ELSE 0.0 END)"


def _each(name: str, column: str, build, sql: str) -> None:
    query(name, f"WITH {_L} SELECT event_id, {sql} AS {column} FROM f")(lambda spark, d: T.fetch_log(spark, d).select("event_id", build().alias(column)))


_each("resp_success", "ok", lambda: R.is_success(F.col("status_code")), "status_code BETWEEN 200 AND 299")
_each("resp_blocked", "blocked", lambda: R.is_blocked(F.col("status_code"), F.col("challenge_type"), F.col("k") % 3 == 0), "status_code IN (403, 429) OR k % 3 = 0 OR (status_code = 503 AND challenge_type <> '')")
_each("sc_reward", "reward", lambda: F.round(R.reward(F.col("status_code"), F.col("challenge_type"), F.col("latency_ms")), 6), f"round({REWARD}, 6)")
_each("sc_ban", "ban", lambda: R.ban_indicator(F.col("status_code"), F.col("challenge_type")), BAN)
_each("speed_bucket", "speed", lambda: R.speed_bucket(F.when(F.col("k") % 9 != 0, F.col("latency_ms"))), "CASE WHEN k % 9 = 0 THEN 'bad' WHEN latency_ms < 1000 THEN 'fast' WHEN latency_ms < 3000 THEN 'ok' WHEN latency_ms < 5000 THEN 'slow' ELSE 'bad' END")
_each("err_hint", "hint", lambda: R.error_hint(F.expr("CASE k % 5 WHEN 0 THEN 'timeout' WHEN 1 THEN 'connect' WHEN 2 THEN 'dns' WHEN 3 THEN 'http_error' ELSE 'other' END")), "CASE k % 5 WHEN 0 THEN 'timeout' WHEN 1 THEN 'unreachable' WHEN 2 THEN 'dns_failed' WHEN 3 THEN 'http_error' END")


@query("resp_hint", f"WITH {_L} SELECT event_id, CASE WHEN status_code = 403 THEN 'blocked_403' WHEN status_code = 429 THEN 'rate_limited' WHEN status_code >= 500 THEN 'server_error' WHEN k % 7 = 0 THEN 'cloudflare_detected' WHEN k % 7 = 1 THEN 'robots_noindex' WHEN k % 7 = 2 THEN 'cloudflare_server' END AS hint FROM f")
def resp_hint(spark, d):
    """Hints from status and headers; header names and values vary in case."""
    headers = F.expr("CASE k % 7 WHEN 0 THEN map('CF-Ray', 'x', 'Server', 'cloudflare') WHEN 1 THEN map('X-Robots-Tag', 'NoIndex, nofollow') WHEN 2 THEN map('server', 'Cloudflare') ELSE map('Server', 'nginx') END")
    return T.fetch_log(spark, d).select("event_id", R.hint(F.col("status_code"), headers).alias("hint"))


@query("resp_length", "SELECT page_id, strlen(html) AS n_bytes FROM pages")
def resp_length(spark, d):
    return T.table(spark, d, "pages").select("page_id", F.octet_length("html").cast("long").alias("n_bytes"))


_MARK = "html || CASE page_id % 6 WHEN 0 THEN '<i>Verify you are HUMAN</i>' WHEN 1 THEN '<script>__cf_chl_x</script>' WHEN 2 THEN '/_bm/ please wait' WHEN 3 THEN 'hCaptcha' ELSE '' END"
_STRIP = "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '(?is)<script[^>]*>.*?</script>', '', 'g'), '(?is)<style[^>]*>.*?</style>', '', 'g'), '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'))"


def _contains(column: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains(lower({column}), '{w}')" for w in words) + ")"


_G = f"g AS (SELECT page_id, {_MARK} AS html, CASE WHEN page_id % 4 = 2 THEN 403 ELSE 200 END AS status FROM pages)"
_BLOCKPAGE = f"(length(html) >= 500 AND {_contains('html', R.BLOCK_MARKS)})"


def _marked(spark, d):
    return T.table(spark, d, "pages").select("page_id", F.expr(_MARK).alias("html"), F.expr("CASE WHEN page_id % 4 = 2 THEN 403 ELSE 200 END").alias("status"))


@query("html_block", f"WITH {_G} SELECT page_id, {_BLOCKPAGE} AS blocked FROM g")
def html_block(spark, d):
    return _marked(spark, d).select("page_id", R.is_block_page(F.col("html")).alias("blocked"))


@query("html_accept", f"WITH {_G} SELECT page_id FROM g WHERE length(html) > 800 AND NOT {_BLOCKPAGE}")
def html_accept(spark, d):
    return _marked(spark, d).where(R.is_usable_page(F.col("html"))).select("page_id")


@query("challenge_type", f"WITH {_G} SELECT page_id, CASE WHEN contains(html, '__cf_chl_') THEN 'cloudflare' WHEN status = 403 AND contains(html, '/_bm/') THEN 'akamai' WHEN page_id % 10 = 9 THEN 'datadome' WHEN contains(lower(html), 'recaptcha') OR contains(lower(html), 'hcaptcha') THEN 'captcha' ELSE '' END AS challenge FROM g")
def challenge_type(spark, d):
    """Challenges by title, page, cookies and visible text."""
    from pagelathe.functions.extraction import html_strip

    g = _marked(spark, d)
    cookies = F.when(F.col("page_id") % 10 == 9, F.array(F.lit("a"), F.lit("datadome_x"))).otherwise(F.array(F.lit("a")))
    title = F.regexp_extract("html", "(?is)<title>(.*?)</title>", 1)
    return g.select("page_id", R.challenge_type(title, F.col("html"), F.col("status"), cookies, html_strip(F.col("html"))).alias("challenge"))


@query("challenge_phrases", f"WITH {_G} SELECT page_id, {_contains('html', [*R.CHALLENGE_PHRASES, 'captcha'])} AS pending FROM g")
def challenge_phrases(spark, d):
    return _marked(spark, d).select("page_id", R.in_challenge(F.regexp_extract("html", "(?is)<title>(.*?)</title>", 1), F.col("html")).alias("pending"))


@query("identity_check", "SELECT c_custkey, len(list_filter([CASE WHEN c_acctbal < -900 THEN 'acctbal' END, CASE WHEN c_nationkey NOT IN (SELECT n_nationkey FROM nation) THEN 'nation' END, CASE WHEN NOT regexp_matches(c_name, '^Customer#[0-9]+$') THEN 'name' END], lambda x: x IS NOT NULL)) AS n_errors, len(list_filter([CASE WHEN c_acctbal < 0 THEN 'debt' END, CASE WHEN c_mktsegment = 'MACHINERY' THEN 'segment' END], lambda x: x IS NOT NULL)) AS n_warnings FROM customer")
def identity_check(spark, d):
    """Consistency rules of a record as lists of errors and warnings; valid rows have no error."""
    from pagelathe.operators.quality import check_rules

    nations = T.table(spark, d, "nation").select("n_nationkey")
    c = T.table(spark, d, "customer").join(F.broadcast(nations.withColumn("known", F.lit(True))), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    checked = check_rules(
        c,
        errors={"acctbal": F.col("c_acctbal") < -900, "nation": F.col("known").isNull(), "name": ~F.col("c_name").rlike("^Customer#[0-9]+$")},
        warnings={"debt": F.col("c_acctbal") < 0, "segment": F.col("c_mktsegment") == "MACHINERY"},
    )
    return checked.select("c_custkey", F.size("errors").cast("long").alias("n_errors"), F.size("warnings").cast("long").alias("n_warnings"))


@query("identity_fix", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 0.0 ELSE c_acctbal END AS c_acctbal, c_acctbal < 0 AS fixed FROM customer")
def identity_fix(spark, d):
    """Derived replacements for what the rules reject."""
    from pagelathe.operators.quality import fix_rules

    c = T.table(spark, d, "customer").select("c_custkey", "c_acctbal")
    return fix_rules(c, {"c_acctbal": (F.col("c_acctbal") < 0, F.lit(0.0))}).select("c_custkey", "c_acctbal", F.col("n_fixed").cast("boolean").alias("fixed"))


@query("html_strip", f"SELECT page_id, {_STRIP.format('html')} AS text FROM pages")
def html_strip_query(spark, d):
    from pagelathe.functions.extraction import html_strip

    return T.table(spark, d, "pages").select("page_id", html_strip(F.col("html")).alias("text"))


@query("eta", f"WITH {_L}, c AS (SELECT domain, count(*) AS done, 1000 AS target, sum(latency_ms) AS elapsed FROM f GROUP BY domain) SELECT domain, round(elapsed / done * (target - done), 3) AS eta_ms, CAST(round(100.0 * done / target) AS INT) AS pct FROM c")
def eta(spark, d):
    """Remaining time and rounded progress toward 1000 fetches of a domain."""
    c = T.fetch_log(spark, d).groupBy("domain").agg(F.count("*").alias("done"), F.sum("latency_ms").alias("elapsed"))
    return c.select("domain", F.round(F.col("elapsed") / F.col("done") * (1000 - F.col("done")), 3).alias("eta_ms"), F.round(100.0 * F.col("done") / 1000).cast("int").alias("pct"))
