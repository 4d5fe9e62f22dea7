"""Line dedup by site-relative frequency: drop a line that too large a share of its host's pages contains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftwork.llm.common import col, free, query, read, stage

RATIO = 0.3
MIN_PAGES = 2

# Elements whose tags end a line, and entities that are turned back.
BREAKING = ("address|article|aside|blockquote|body|br|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|h[1-6]|head|header|hr|html|li|main|"
            "nav|ol|option|p|pre|section|table|tbody|td|th|thead|title|tr|ul")
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"))


def host_of(url: Column) -> Column:
    """Lower-case host of a URL without user and port; '' where there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def html_lines(html: Column) -> Column:
    """The visible lines of a page: an array, without blank lines; NULL gives none."""
    text = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>", " ")
    text = F.regexp_replace(text, rf"(?is)</?(?:{BREAKING})\b[^>]*>", "\n")
    text = F.regexp_replace(text, r"(?s)<[^>]*>", "")
    for entity, plain in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(plain))
    return text_lines(text)


def text_lines(text: Column) -> Column:
    """The lines of a plain text with blanks trimmed, blank ones left out; NULL gives none."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.btrim(x, F.lit(" \t\r\x0b\x0c")))
    return F.filter(lines, lambda x: F.length(x) > 0)


def boilerplate(pages: DataFrame, host: str, lines: str, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(``host``, ``drop``): the lines of each host found on more than ``ratio`` of its pages, ``min_pages`` at least.

    A page counts once for a line, so counting is a partial sum that shrinks a hot host or line before the
    shuffle. The list of a host is bounded by its mean number of lines a page over ``ratio``.
    """
    totals = stage(pages.groupBy(col(host).alias("host")).agg(F.count("*").alias("pages")), "hosts")
    counts = (pages.select(col(host).alias("host"), F.explode(F.array_distinct(col(lines))).alias("line"))
              .groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages))
    often = counts.join(totals, "host").where(F.col("n") > ratio * F.col("pages"))
    return stage(often.groupBy("host").agg(F.collect_list("line").alias("drop")), "boilerplate")


def dedup_lines(pages: DataFrame, host: Column, lines: Column, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """``pages`` with ``host``, ``n_lines``, ``n_dropped`` and ``kept_text`` (lines that stay, joined by line feeds) as the last four columns.

    A line must be on ``min_pages`` pages, two by default: the only page of a host has each of its lines on all pages, so there a ratio says nothing.
    URLs without a host (NULL too) form one group, ''. NULL and empty pages have no lines; repeated rows are pages
    of their own; lines repeated inside a page count once but all go, lines of any length are compared whole. An empty table gives
    no rows. Names that clash keep the input's column. Pages are parsed once and written with their lines.
    """
    h, ls = free(pages, "_host"), free(pages, "_lines")
    prepared = stage(pages.withColumn(h, host).withColumn(ls, lines), "lines", "zstd")
    drop = boilerplate(prepared, h, ls, ratio, min_pages)
    drop = drop.select(F.col("host").alias(free(prepared, "_drop_host")), F.col("drop").alias(free(prepared, "_drop")))
    dh, d = drop.columns
    kept = F.when(F.col(d).isNull(), F.col(ls)).otherwise(F.filter(F.col(ls), lambda x: ~F.array_contains(F.col(d), x)))
    k = free(prepared, "_kept")
    return (prepared.join(drop, F.col(h) == F.col(dh), "left").withColumn(k, kept)
            .select(*[col(c) for c in pages.columns], F.col(h).alias(free(pages, "host")), F.size(ls).cast("bigint").alias(free(pages, "n_lines")),
                    (F.size(ls) - F.size(k)).cast("bigint").alias(free(pages, "n_dropped")), F.array_join(k, "\n").alias(free(pages, "kept_text"))))


def _entities(sql: str) -> str:
    for entity, plain in ENTITIES:
        sql = f"replace({sql}, '{entity}', '{plain.replace(chr(39), chr(39) * 2)}')"
    return sql


_CLEAN = rf"regexp_replace(coalesce(html, ''), '(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>', ' ', 'g')"
_CLEAN = rf"regexp_replace({_CLEAN}, '(?is)</?(?:{BREAKING})\b[^>]*>', chr(10), 'g')"
_CLEAN = _entities(rf"regexp_replace({_CLEAN}, '(?s)<[^>]*>', '', 'g')")
_SQL = rf"""
WITH p AS (SELECT page_id, row_number() OVER () AS r,
    lower(coalesce(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1), '')) AS host,
    list_filter(list_transform(string_split({_CLEAN}, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13) || chr(11) || chr(12))), lambda x: length(x) > 0) AS ls FROM pages),
l AS (SELECT r, page_id, host, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM p),
t AS (SELECT host, count(*) AS pages FROM p GROUP BY host),
d AS (SELECT host, line FROM (SELECT host, line, count(DISTINCT r) AS n FROM l GROUP BY host, line) JOIN t USING (host) WHERE n >= {MIN_PAGES} AND n > {RATIO} * pages),
k AS (SELECT l.r, count(*) AS n, string_agg(l.line, chr(10) ORDER BY l.i) AS kept FROM l ANTI JOIN d ON l.host = d.host AND l.line = d.line GROUP BY l.r)
SELECT p.page_id, p.host, CAST(len(p.ls) AS BIGINT) AS n_lines, CAST(len(p.ls) - coalesce(k.n, 0) AS BIGINT) AS n_dropped, coalesce(k.kept, '') AS kept_text
FROM p LEFT JOIN k USING (r)
"""


@query("op8_site_lines", _SQL)
def op8(spark, root):
    """Only lines are written and compared, not the pages' markup."""
    parsed = read(spark, root, "pages").select("page_id", host_of(F.col("url")).alias("site"), html_lines(F.col("html")).alias("visible"))
    return dedup_lines(parsed, F.col("site"), F.col("visible")).select("page_id", "host", "n_lines", "n_dropped", "kept_text")
