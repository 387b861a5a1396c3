"""Posts and articles out of fetched HTML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.functions import text as T
from evidentia.functions import urls as U

LEAST_TEXT, PARAGRAPHS, LEAST_PARAGRAPH = 80, 10, 30


def unescape(c: Column) -> Column:
    """The five XML references and the no-break space."""
    for ref, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        c = F.replace(c, F.lit(ref), F.lit(char))
    return c


def meta(html: Column, attribute: str, name: str) -> Column:
    """Trimmed content of the first <meta attribute=name>, in either order of attributes; null if there is none."""
    q = "[\"']"
    key = rf"{attribute}\s*=\s*{q}{name}{q}"
    after = F.regexp_extract(html, rf"(?is)<meta[^>]*?{key}[^>]*?content\s*=\s*{q}(.*?){q}[^>]*>", 1)
    before = F.regexp_extract(html, rf"(?is)<meta[^>]*?content\s*=\s*{q}([^>]*?){q}[^>]*?{key}[^>]*>", 1)
    found = F.coalesce(F.when(after != "", after), F.when(before != "", before))
    return T.strip(unescape(found))


def title(html: Column) -> Column:
    return T.collapse(unescape(F.regexp_extract(T.text(html), r"(?is)<title[^>]*>(.*?)</title>", 1)))


def strip_tags(html: Column) -> Column:
    bare = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    return T.collapse(unescape(F.regexp_replace(bare, r"(?s)<[^>]+>", " ")))


def paragraphs(html: Column) -> Column:
    """The first PARAGRAPHS <p> whose text has over LEAST_PARAGRAPH characters, joined by spaces."""
    found = F.regexp_extract_all(T.text(html), F.lit(r"(?is)<p(?:\s[^>]*)?>(.*?)</p>"), F.lit(1))
    long = F.filter(F.transform(found, strip_tags), lambda p: F.length(p) > LEAST_PARAGRAPH)
    return F.array_join(F.slice(long, 1, PARAGRAPHS), " ")


def articles(pages: DataFrame) -> DataFrame:
    """pages (url, html, snippet) -> adds title, text, extracted_via.

    The article element's text if there is enough of it, else paragraphs, else
    the snippet; null pages have their snippet.
    """
    html = T.text("html")
    body = strip_tags(F.regexp_extract(html, r"(?is)<article[^>]*>(.*?)</article>", 1))
    ps, snippet = paragraphs(F.col("html")), T.text("snippet")
    via = F.when(F.length(body) >= LEAST_TEXT, "article").when(ps != "", "paragraphs").when(snippet != "", "snippet")
    return pages.withColumn("extracted_via", via).withColumn("title", title(F.col("html"))).withColumn("text", F.when(via == "article", body).when(via == "paragraphs", ps).when(via == "snippet", snippet))


def posts(pages: DataFrame) -> DataFrame:
    """pages (url, html, title, snippet) of social URLs -> platform, label, author, title, text, engagement, extracted_via."""
    html = T.text("html")
    first = lambda *cs: F.coalesce(*cs, F.lit(""))
    og_title = first(meta(html, "property", "og:title"), meta(html, "name", "twitter:title"))
    og_desc = first(meta(html, "property", "og:description"), meta(html, "name", "twitter:description"), meta(html, "name", "description"))
    og_author = first(meta(html, "name", "twitter:creator"), meta(html, "property", "article:author"))
    rows = pages.select("url", T.text("title").alias("t0"), T.text("snippet").alias("s0"), (html != "").alias("fetched"), og_title.alias("t"), og_desc.alias("d"), og_author.alias("a"), F.coalesce(U.platform(F.col("url")), F.lit("social")).alias("platform"))
    p, t, d, a, t0, s0 = (F.col(x) for x in ("platform", "t", "d", "a", "t0", "s0"))
    before = lambda mark: T.strip(F.substring_index(t, mark, 1))
    author = (
        F.when(a != "", a)
        .when((p == "x") & F.contains(t, F.lit(" on X:")), before(" on X:"))
        .when((p == "x") & F.contains(t, F.lit(" on Twitter:")), before(" on Twitter:"))
        .when((p == "instagram") & F.contains(t, F.lit("Instagram: ")), T.strip(F.replace(before("Instagram: "), F.lit("on Instagram"), F.lit(""))))
        .otherwise("")
    )
    tweet = T.strip(F.regexp_replace(F.when(d != "", d).otherwise(t), "^[“\"]|[”\"]$", ""))
    caption = T.strip(F.regexp_replace(d, r"(?i)^[0-9,]+\s+likes,?\s*[0-9,]*\s*comments\s*-\s*", ""))
    own = (
        F.when((p == "x") & (tweet != ""), tweet)
        .when((p == "instagram") & (d != ""), F.when(caption != "", caption).otherwise(d))
        .when((p == "reddit") & (F.length(d) > 20), F.concat(t, F.lit(". "), d))
        .when((p == "youtube") & (d != ""), F.concat(t, F.lit(" - "), F.substring(d, 1, 400)))
        .otherwise(s0)
    )
    whole = F.when((d != "") & (F.length(own) < F.length(d)), d).otherwise(own)
    text = F.when(F.col("fetched"), whole).otherwise(s0)
    new_title = F.when(F.col("fetched") & (t != "") & (p.isin("reddit", "youtube") | (t0 == "")), t).otherwise(t0)
    found = F.when(F.col("fetched"), author).otherwise("")
    return rows.select(
        "url", "platform", U.platform_label(p).alias("platform_label"), F.when(found != "", found).otherwise(U.author_from_path(F.col("url"))).alias("author"), new_title.alias("title"),
        F.when(T.strip(text) != "", text).when(s0 != "", s0).otherwise(t0).alias("text"),
        F.when(F.col("fetched") & (p == "instagram"), F.regexp_extract(d, r"([0-9][0-9,]*\s+likes,\s+[0-9][0-9,]*\s+comments)", 1)).otherwise("").alias("engagement_summary"),
        F.when(F.col("fetched"), "opengraph_html").otherwise("snippet_fallback").alias("extracted_via"),
    )
