"""Line dedup by frequency within a site."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, spread_join

#: A line on more than this share of its host's pages, and on so many pages at least, is boilerplate. Two pages are what
#: repetition needs; on hosts of 20 pages or more, nearly all lines that repeat by chance stand on less than this share.
RATIO, LEAST_PAGES = 0.2, 2
_HIDDEN = r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->"
_BREAKS = r"(?i)</?(?:p|div|h[1-6]|li|ul|ol|br|tr|td|th|table|article|nav|header|footer|section|body|html|head|title)\b[^>]*>"


def html_lines(html: Column) -> Column:
    """The lines of a page that hold text: scripts, styles and comments go, block tags end lines, other tags go."""
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(html, _HIDDEN, " "), _BREAKS, "\n"), "<[^>]*>", "")
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")


def host_of(url: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/:?#]+)", 1)), F.lit(""))


#: Rows of a table of hosts up to which it is broadcast.
BROADCAST_ROWS = 200_000


def _mark(line: Column) -> Column:
    """128 bits that stand for a line."""
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit("line"), line).alias("b"))


def drop_boilerplate(pages: DataFrame, ratio: float = RATIO, least_pages: int = LEAST_PAGES) -> DataFrame:
    """pages(id, host, lines): adds kept_lines, the lines without those that stand on more than `ratio` of the pages of
    their host (and on least_pages or more).

    Each page counts a line once, so the count per (host, line) is a sum with map-side partial sums and a hot host or
    line reaches the shuffle as one row a task. Lines travel as 128 bits, within their host. A host has no more than
    1 / ratio boilerplate lines for each line of its average page, so its list is short: pages are read a second time
    and meet the lists of their hosts by broadcast, or, beyond BROADCAST_ROWS hosts, dealt at random to copies of them.
    Pages are told apart by nothing, and none is shuffled in the first case; nothing is staged. Pages without a host keep
    every line and null lines stay null; repeated rows count as pages of their own and get equal results."""
    pages = pages.drop("kept_lines")  # rows travel as structs, so that no column of theirs can clash with the joins' own
    sited = pages.where("host is not null")
    totals = cut(sited.groupBy("host").agg(F.count(F.lit(1)).alias("pages")).select(F.col("host").alias("site"), "pages"))
    marks = sited.select("host", F.explode(F.array_distinct(F.transform("lines", _mark))).alias("mark"))
    counts = marks.groupBy("host", "mark").agg(F.count(F.lit(1)).alias("on_pages")).where(F.col("on_pages") >= least_pages)
    common = spread_join(counts, totals, [("host", "site")], "inner", BROADCAST_ROWS).where(F.col("on_pages") > F.lit(ratio) * F.col("pages"))
    lists = cut(common.groupBy(F.col("site").alias("_site")).agg(F.collect_set("mark").alias("_gone")))
    rows = pages.select(F.struct(*pages.columns).alias("row"), F.col("host").alias("_host"))
    both = spread_join(rows, lists, [("_host", "_site")], "left", BROADCAST_ROWS)
    stays = F.filter("row.lines", lambda x: ~F.array_contains("_gone", _mark(x)))
    return both.select("row.*", F.when(F.col("_gone").isNull(), F.col("row.lines")).otherwise(stays).alias("kept_lines"))
