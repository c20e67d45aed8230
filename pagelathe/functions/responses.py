"""Classification and scoring of fetch responses as columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Substrings that mark a blocked page, searched in lower case.
BLOCK_MARKS = ["captcha", "verify you are human", "just a moment", "checking your browser", "_cf_chl_", "recaptcha", "cf-browser-verification"]
# Phrases of pages that are still being checked.
CHALLENGE_PHRASES = ["just a moment", "checking your browser", "verifying you are human", "ddos protection", "please wait", "security check"]
# Labels of fetch error kinds.
ERROR_HINTS = {"timeout": "timeout", "connect": "unreachable", "dns": "dns_failed", "http_error": "http_error"}


def _any(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])


def is_success(status: Column) -> Column:
    return status.between(200, 299)


def is_blocked(status: Column, challenge: Column, script_challenge: Column | None = None) -> Column:
    """403, 429, a script challenge, or a 503 with any challenge type.

    script_challenge is the flag that a page was a challenge; without it a recognised type stands for the flag. Null types
    and flags count as none.
    """
    kind = F.coalesce(challenge, F.lit("")) != ""
    flag = kind if script_challenge is None else F.coalesce(script_challenge, F.lit(False))
    return F.coalesce(status.isin(403, 429), F.lit(False)) | flag | (F.coalesce(status == 503, F.lit(False)) & kind)


def hint(status: Column, headers: Column) -> Column:
    """What a response's status or headers tell; null if nothing. Header names are compared in lower case."""
    h = F.transform_keys(headers, lambda k, v: F.lower(k))
    value = lambda k: F.lower(F.try_element_at(h, F.lit(k)))
    return (
        F.when(status == 403, "blocked_403")
        .when(status == 429, "rate_limited")
        .when(status >= 500, "server_error")
        .when(value("cf-ray").isNotNull(), "cloudflare_detected")
        .when(F.contains(value("x-robots-tag"), F.lit("noindex")), "robots_noindex")
        .when(F.contains(value("server"), F.lit("cloudflare")), "cloudflare_server")
    )


def error_hint(kind: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in ERROR_HINTS.items() for x in kv)), kind)


def is_block_page(html: Column) -> Column:
    """At least 500 characters with one of the marks."""
    return (F.length(html) >= 500) & _any(F.lower(html), BLOCK_MARKS)


def is_usable_page(html: Column) -> Column:
    return (F.length(html) > 800) & ~is_block_page(html)


def challenge_type(title: Column, html: Column, status: Column, cookies: Column, visible: Column) -> Column:
    """The kind of challenge that a page shows, '' if none; cookies is an array of names, visible the page's text."""
    return (
        F.when(F.contains(F.lower(title), F.lit("just a moment")) | F.contains(html, F.lit("__cf_chl_")), "cloudflare")
        .when((status == 403) & F.contains(html, F.lit("/_bm/")), "akamai")
        .when(F.exists(cookies, lambda c: F.startswith(c, F.lit("datadome"))), "datadome")
        .when(_any(F.lower(html), ["recaptcha", "hcaptcha"]), "captcha")
        .when((F.length(F.trim(visible)) < 10) & F.contains(html, F.lit("<script")), "suspicious_blank")
        .otherwise("")
    )


def in_challenge(title: Column, html: Column) -> Column:
    return _any(F.lower(title), CHALLENGE_PHRASES) | _any(F.lower(html), [*CHALLENGE_PHRASES, "captcha"])


def reward(status: Column, challenge: Column, latency_ms: Column, extracted: Column | bool = True) -> Column:
    """A fetch's worth between 0 and 1."""
    base = F.when(is_success(status), 0.5).when(status.between(300, 399), 0.3).when(status == 403, 0.1 - 0.2).when(status == 429, 0.1 - 0.1).when(status.between(400, 499), 0.1).otherwise(0.0)
    penalty = F.when(challenge.isin("cloudflare", "datadome"), 0.5).when(challenge == "akamai", 0.4).when(challenge == "captcha", 0.6).otherwise(0.0)
    blocked = F.when(is_blocked(status, challenge), 0.3).otherwise(0.0)
    speed = F.when(latency_ms <= 0, 0.0).when(latency_ms < 1000, 0.2).when(latency_ms < 3000, 0.15).when(latency_ms < 5000, 0.1).when(latency_ms < 10000, 0.05).otherwise(0.0)
    bonus = F.when(F.lit(extracted) & is_success(status), 0.2).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), base - penalty - blocked + speed + bonus))


def ban_indicator(status: Column, challenge: Column) -> Column:
    """How much a single response points to a ban."""
    return F.greatest(
        F.lit(0.0),
        F.when(status == 403, 0.8),
        F.when(status == 429, 0.5),
        F.when(challenge.isin("cloudflare", "datadome"), 0.9).when(challenge == "akamai", 0.8).when(challenge.isin("captcha", "recaptcha", "hcaptcha"), 0.95),
        F.when((status == 200) & (challenge == "suspicious_blank"), 0.7),
    )


def speed_bucket(latency_ms: Column) -> Column:
    ms = F.coalesce(latency_ms, F.lit(9999.0))
    return F.when(ms < 1000, "fast").when(ms < 3000, "ok").when(ms < 5000, "slow").otherwise("bad")
