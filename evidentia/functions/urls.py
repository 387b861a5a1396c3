"""URL functions: hosts, social platforms, authority of sources, safety."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from evidentia.functions.text import let

# Social domains in order of precedence, their platform, and platform labels.
SOCIAL_DOMAINS = {
    "x.com": "x", "twitter.com": "x", "mobile.twitter.com": "x", "instagram.com": "instagram", "www.instagram.com": "instagram",
    "reddit.com": "reddit", "www.reddit.com": "reddit", "old.reddit.com": "reddit", "youtube.com": "youtube", "www.youtube.com": "youtube",
    "youtu.be": "youtube", "facebook.com": "facebook", "www.facebook.com": "facebook", "m.facebook.com": "facebook", "t.me": "telegram",
    "telegram.me": "telegram", "threads.net": "threads", "www.threads.net": "threads", "linkedin.com": "linkedin", "www.linkedin.com": "linkedin",
}
PLATFORM_LABELS = {"x": "X (Twitter)", "instagram": "Instagram", "reddit": "Reddit", "youtube": "YouTube", "facebook": "Facebook", "telegram": "Telegram", "threads": "Threads", "linkedin": "LinkedIn"}
# Source classes in order of precedence.
FACT_CHECKERS = [
    "altnews.in", "boomlive.in", "factly.in", "snopes.com", "politifact.com", "factcheck.org", "pib.gov.in", "vishvasnews.com", "thip.media", "newschecker.in",
]
OFFICIAL_SUFFIXES = [
    ".gov", ".gov.in", ".nic.in", ".edu",
]
NEWS = [
    "bbc.com", "bbc.co.uk", "reuters.com", "apnews.com", "thehindu.com", "indianexpress.com", "timesofindia.indiatimes.com", "economictimes.indiatimes.com", "ndtv.com",
    "indiatoday.in", "hindustantimes.com", "theprint.in", "scroll.in", "thewire.in", "livemint.com", "aninews.in", "ptinews.com", "aljazeera.com", "nytimes.com",
    "washingtonpost.com", "theguardian.com",
]
SOCIAL_MATCH = [
    "x.com", "twitter.com", "instagram.com", "reddit.com", "youtube.com", "youtu.be", "threads.net", "facebook.com", "t.me",
]
PRIVATE_RANGES = [
    "10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "127.0.0.0/8", "169.254.0.0/16", "0.0.0.0/8",
]


def netloc(url: Column) -> Column:
    """Lower-case authority part, port and user included; empty if there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1), F.lit("")))


def domain(url: Column) -> Column:
    return F.regexp_replace(netloc(url), r"^www\.", "")


def third_part(url: Column) -> Column:
    """The part after the second slash, www. included; null if there is none."""
    return F.get(F.split(url, "/"), F.lit(2))


def _any(test, needles: list[str]) -> Column:
    return F.exists(F.array(*map(F.lit, needles)), test)


def is_social(url: Column) -> Column:
    return let(domain(url), lambda d: (d != "") & _any(lambda k: (d == k) | F.endswith(d, F.concat(F.lit("."), k)), list(SOCIAL_DOMAINS)))


def platform(url: Column) -> Column:
    """First social domain that is a substring of the host; null if none is."""

    def first(host: Column) -> Column:
        start = F.when(F.contains(host, F.lit(next(iter(SOCIAL_DOMAINS)))), F.lit(next(iter(SOCIAL_DOMAINS.values()))))
        return reduce(lambda c, kv: c.when(F.contains(host, F.lit(kv[0])), F.lit(kv[1])), list(SOCIAL_DOMAINS.items())[1:], start)

    return let(netloc(url), first)


def platform_label(p: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in PLATFORM_LABELS.items() for x in kv])[p], F.initcap(F.coalesce(p, F.lit("social"))))


def source_type(url: Column) -> Column:
    def kind(d: Column) -> Column:
        return (
            F.when(_any(lambda k: F.contains(d, k), FACT_CHECKERS), "fact_checker")
            .when(_any(lambda k: F.endswith(d, k), OFFICIAL_SUFFIXES), "government")
            .when(_any(lambda k: F.contains(d, k), NEWS), "news")
            .when(_any(lambda k: F.contains(d, k), SOCIAL_MATCH), "social_media")
            .otherwise("web")
        )

    return F.when(F.coalesce(url, F.lit("")) == "", "unknown").otherwise(let(domain(url), kind))


def authority(kind: Column) -> Column:
    return F.when(kind == "unknown", 0.1).when(kind == "fact_checker", 0.95).when(kind == "government", 1.0).when(kind == "news", 0.85).when(kind == "social_media", 0.45).otherwise(0.55)


def path_parts(url: Column) -> Column:
    path = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)
    return F.filter(F.split(path, "/"), lambda p: p != "")


def author_from_path(url: Column) -> Column:
    p, parts = platform(url), path_parts(url)
    one, two = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    return F.coalesce(
        F.when(p == "x", F.concat(F.lit("@"), one))
        .when((p == "instagram") & ~one.isin("p", "reel", "stories"), F.concat(F.lit("@"), one))
        .when((p == "reddit") & (one == "r"), F.concat(F.lit("r/"), two))
        .when((p == "youtube") & one.startswith("@"), one),
        F.lit(""),
    )


def _address(host: Column) -> Column:
    a = F.split(host, r"\.")
    return reduce(lambda x, i: x * 256 + F.get(a, F.lit(i)).try_cast("long"), range(1, 4), F.get(a, F.lit(0)).try_cast("long"))


def url_reject_reason(url: Column, schemes: tuple[str, ...] = ("http", "https")) -> Column:
    """Null for a fetchable URL; names aren't resolved, literal addresses are tested against private ranges."""
    scheme = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^([A-Za-z][A-Za-z0-9+.\-]*)://", 1))
    host = F.regexp_replace(F.regexp_replace(netloc(url), r"^.*@", ""), r":[0-9]*$", "")
    literal = host.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$")
    ip, private = _address(host), F.lit(False)
    for r in PRIVATE_RANGES:
        base, bits = r.split("/")
        size = 1 << (32 - int(bits))
        low = reduce(lambda x, y: x * 256 + int(y), base.split("."), 0)
        private = private | ip.between(low, low + size - 1)
    return F.when(~scheme.isin(*schemes), "scheme").when(host == "", "host").when((literal & private) | (host == "localhost") | host.isin("[::1]"), "private")
