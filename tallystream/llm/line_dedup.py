"""Line dedup by site-relative frequency.

For every host, the pages that hold a line are divided by the host's pages; lines above a ratio are boilerplate there and
are dropped from all its pages. Lines are counted by their MD5, a page counts a line once, and counts are combined before
they are shuffled, so that neither a very large host nor a very common line makes a large task. At most
(lines a page holds on average) / ratio lines of a host can be boilerplate, so each host's list is short; all lists are
broadcast if they are measured to be small, and joined with salted pages otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallystream.llm.shared import fresh, written

#: Lists of boilerplate lines up to which they are broadcast, in lines and hosts together.
BROADCAST_ROWS = 200_000
SALTS = 64
#: A host with more than this part of all pages is large; so there are fewer of them than this.
LARGE_HOSTS = 10_000


def _line_id(line: Column) -> Column:
    """Null for a blank line; lines are compared without the spaces around them."""
    return F.when(F.trim(line) != "", F.unhex(F.md5(F.trim(line).cast("binary"))))


def boilerplate_lines(docs: DataFrame, ratio: float = 0.08, min_pages: int = 2, *, text: str = "text", host: str = "source", different: bool = True) -> DataFrame:
    """One row per host that has any: host, pages, and ``bad``, the ids of its boilerplate lines."""
    ids = docs.select(F.col(host).alias("host"), F.xxhash64(F.col(text)).alias("page"), F.array_distinct(F.transform(F.split(F.col(text), "\n"), _line_id)).alias("ids"))
    held = ids.select("host", "page", F.explode("ids").alias("line")).filter(F.col("line").isNotNull()).groupBy("host", "line")
    if different:
        counts = held.agg(F.count("*").alias("n"), F.min("page").alias("least"), F.max("page").alias("most")).filter("least <> most").drop("least", "most")
    else:
        counts = held.agg(F.count("*").alias("n"))
    counts = counts.filter(F.col("n") >= min_pages)
    totals = written(docs.groupBy(F.col(host).alias("own_host")).agg(F.count("*").alias("pages")), "host-pages")
    all_pages = totals.agg(F.coalesce(F.sum("pages"), F.lit(0))).first()[0]
    # Lines of a large host would be one task of a join on the host: they find its pages in a broadcast, and a salt spreads them.
    large = totals.filter(F.col("pages") > all_pages / LARGE_HOSTS).select(F.col("own_host").alias("large_host"), F.col("pages").alias("large_pages"))
    rows = counts.join(F.broadcast(large), F.col("host").eqNullSafe(F.col("large_host")), "left")
    salt = F.when(F.col("large_pages").isNull(), -1).otherwise(F.pmod(F.xxhash64("line"), F.lit(1024))).cast("long")
    small = totals.withColumn("no_salt", F.least("pages", F.lit(-1).cast("long")))  # -1, but no literal that the optimizer would take out of the key
    rows = rows.withColumn("salt", salt).join(small, F.col("host").eqNullSafe(F.col("own_host")) & (F.col("salt") == F.col("no_salt")), "left")
    above = rows.withColumn("pages", F.coalesce("large_pages", "pages")).filter(F.col("n") > ratio * F.col("pages"))
    return above.groupBy("host").agg(F.max("pages").alias("pages"), F.array_sort(F.collect_list("line")).alias("bad"))


def drop_boilerplate(docs: DataFrame, ratio: float = 0.08, min_pages: int = 2, *, text: str = "text", host: str = "source", different: bool = True, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Drop from every text the lines that more than ``ratio`` of its host's pages, and at least ``min_pages``, hold.

    The ratio decides at every size of a host. ``different``: the pages with a line must not all be copies of one text, else
    copies on a small host would lose all their lines.

    Returns the rows and columns of ``docs`` with the new text, and ``n_lines`` and ``n_dropped`` (long; columns of these names
    are replaced). Blank lines always stay; a text of boilerplate alone becomes empty and its row stays; a null text stays null with no lines; null hosts are
    one host; repeated rows are pages of their own and stay; a text without boilerplate stays as it is; a line or text of any
    length is handled whole; a share equal to the ratio is not above it; an empty table gives no rows.
    """
    p = fresh(docs)
    bad = written(boilerplate_lines(docs, ratio, min_pages, text=text, host=host, different=different).select(F.col("host").alias(f"{p}host"), F.col("bad").alias(f"{p}bad")), "boilerplate")
    size = bad.agg(F.coalesce(F.sum(F.size(f"{p}bad") + 1), F.lit(0))).first()[0]
    columns = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    own = docs.select(*columns)
    if size <= broadcast_rows:
        joined = own.join(F.broadcast(bad), F.col(host).eqNullSafe(F.col(f"{p}host")), "left")
    else:
        salted = bad.withColumn(f"{p}salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        own = own.withColumn(f"{p}own_salt", F.pmod(F.xxhash64(F.col(text)), F.lit(SALTS)).cast("int"))
        joined = own.join(salted, F.col(host).eqNullSafe(F.col(f"{p}host")) & (F.col(f"{p}own_salt") == F.col(f"{p}salt")), "left")
    lines = F.split(F.col(text), "\n")
    found = F.when(F.col(f"{p}bad").isNotNull(), F.array_intersect(f"{p}bad", F.transform(lines, _line_id)))
    marked = joined.select(*columns, F.explode(F.array(found)).alias(f"{p}found"))  # computed once, before it is used for each line
    hit = F.size(F.coalesce(f"{p}found", F.array().cast("array<binary>"))) > 0
    kept = F.filter(lines, lambda x: ~F.coalesce(F.array_contains(F.col(f"{p}found"), _line_id(x)), F.lit(False)))
    out = marked.select(*columns, F.when(hit, kept).alias(f"{p}kept"))
    n_lines = F.when(F.col(text).isNull(), 0).otherwise(F.size(lines))
    new = F.when(F.col(f"{p}kept").isNotNull(), F.array_join(f"{p}kept", "\n")).otherwise(F.col(text))
    dropped = F.when(F.col(f"{p}kept").isNotNull(), n_lines - F.size(f"{p}kept")).otherwise(0)
    return out.select(*[new.alias(c) if c == text else F.col(c) for c in columns], n_lines.cast("long").alias("n_lines"), dropped.cast("long").alias("n_dropped"))
