"""Line dedup by site-relative frequency.

Pages are grouped by host; the pages that hold a line are divided by all pages of the host, and lines above a ratio
are boilerplate and dropped from every page. Lines are compared normalised (case of A-Z, digits, spaces).

Pages with the same text are one page in both counts, so copies of an article keep its lines, and a line is counted
once a page. A host needs a few pages before a ratio means anything, so a line must also be on MIN_PAGES of them.
Counting combines before it shuffles; a hot host or line is no hot task. Texts move once, to meet the lines their page
loses.

Defined results: a null text is an empty page and stays one; null hosts form one host; repeated rows and copies count
as one page and are all cut alike; an empty table gives an empty result; columns named like ours are replaced by ours.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papertrawl.llm.common import join_on, lines, normal_line, text_key, whole
from papertrawl.session import cut_lineage

#: A line on more than this share of a host's distinct pages, and on so many of them at least, is boilerplate.
MAX_RATIO, MIN_PAGES = 0.1, 5
_KEY = ["doc_id", "host", "text_hash"]


def _page_lines(docs: DataFrame, host: str) -> DataFrame:
    """A row per page and distinct line with words."""
    keyed = docs.select("doc_id", docs[host].alias("host"), text_key().alias("text_hash"), "text")
    hashes = F.array_distinct(F.transform(F.filter(F.transform(lines(whole(F.col("text"))), normal_line),
                                                   lambda x: x != ""), lambda x: F.xxhash64(x)))
    return keyed.select(*_KEY, F.explode(hashes).alias("line_hash"))


def boilerplate(docs: DataFrame, page_lines: DataFrame, host: str = "source", max_ratio: float = MAX_RATIO,
                min_pages: int = MIN_PAGES) -> DataFrame:
    """host, line_hash, pages, host_pages of the lines above the ratio; both count distinct texts."""
    totals = docs.groupBy(docs[host].alias("host")).agg(F.countDistinct(text_key()).alias("host_pages"))
    counted = page_lines.groupBy("host", "line_hash").agg(F.countDistinct("text_hash").alias("pages")).filter(
        F.col("pages") >= min_pages)
    return join_on(counted, totals, ["host"]).filter(F.col("pages") > max_ratio * F.col("host_pages"))


def drop_boilerplate(docs: DataFrame, host: str = "source", max_ratio: float = MAX_RATIO,
                     min_pages: int = MIN_PAGES) -> DataFrame:
    """doc_id, n_lines, n_dropped, text without the boilerplate lines, of every page."""
    rows = cut_lineage(_page_lines(docs, host), "page-lines")  # read twice; texts are normalised once
    found = boilerplate(docs, rows, host, max_ratio, min_pages).select("host", "line_hash")
    lost = (join_on(rows, found, ["host", "line_hash"]).groupBy(*_KEY).agg(F.collect_set("line_hash").alias("lost")))
    own = docs.select("doc_id", docs[host].alias("host"), text_key().alias("text_hash"), "text")
    both = join_on(own, lost, _KEY, "left").select("doc_id", "text", "lost")
    kept = F.filter(lines(F.col("text")), lambda x: ~F.array_contains("lost", F.xxhash64(normal_line(x))))
    text = F.when(F.col("lost").isNull(), whole(F.col("text"))).otherwise(F.array_join(kept, "\n"))
    n = F.size(lines(whole(F.col("text")))).cast("bigint")
    left = F.when(F.col("lost").isNull(), n).otherwise(F.size(kept).cast("bigint"))
    return both.select("doc_id", n.alias("n_lines"), (n - left).alias("n_dropped"), text.alias("text"))
