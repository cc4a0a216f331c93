"""Boilerplate lines by their site-relative frequency, in DataFrame functions only.

The pages of a host that contain a line, divided by the host's pages: lines above a ratio are dropped. A line is
counted once a page, so counting needs no distinct step; counts are pre-aggregated on the map side, and a hot host
only ever holds as many rows as it has different lines. The lines above the ratio number at most the host's mean
lines a page divided by the ratio, whatever the host's size, so each host carries them as one short array. The
planner broadcasts the hosts' arrays only if they are small; otherwise pages meet them in a join whose hot
partitions adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from copse.llm.common import cut

#: A line goes if it stands on more than this share of its host's pages, and on this many pages at least.
RATIO, MIN_PAGES = 0.1, 3
#: Keys of hosts and lines, of 16 bytes, up to which they are broadcast.
BROADCAST_KEYS = 262_144


def _lines(text: str) -> Column:
    return F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)


def _line_key(line: Column) -> Column:
    return F.struct(F.xxhash64(line).alias("a"), F.hash(line).alias("b"))


def _host_key(host: str) -> Column:
    return F.xxhash64(F.col(host).isNull(), F.col(host))


def boilerplate(pages: DataFrame, host: str, text: str, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """``host_key, lines``: of each host that has any, the keys of its lines above the ratio."""
    each = pages.where(F.col(text).isNotNull()).select(
        _host_key(host).alias("host_key"),
        F.explode(F.array_distinct(F.transform(F.filter(_lines(text), lambda x: F.trim(x) != ""), _line_key))).alias("line"),
    )
    counts = each.groupBy("host_key", "line").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    totals = pages.groupBy(_host_key(host).alias("host_key")).agg(F.count("*").alias("total"))
    above = counts.join(totals, "host_key").where(F.col("n") > F.lit(ratio) * F.col("total"))
    return above.groupBy("host_key").agg(F.collect_list("line").alias("lines"))


def drop_boilerplate(
    pages: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES, keep_whole: bool = False
) -> DataFrame:
    """``pages`` without boilerplate lines in ``text``, with ``n_lines`` and ``n_dropped``.

    A line counts as it stands; lines of spaces alone stay. A null host is a host of its own. A null text stays
    null and has 0 lines, though its page counts in the host's total; an empty text is one blank line. Repeated
    rows are pages of their own. With ``keep_whole``, a page that would lose every line that is not blank stays as
    it is, as when a group of copies makes up much of a host. Columns of ``pages`` named ``n_lines`` or
    ``n_dropped`` are replaced. An empty table gives an empty result.
    """
    names = [c for c in pages.columns if c not in ("n_lines", "n_dropped")]
    flagged = cut(boilerplate(pages, host, text, ratio, min_pages)).select(F.col("host_key").alias("__host"), F.col("lines").alias("__flagged"))
    keys = flagged.agg(F.coalesce(F.sum(F.size("__flagged") + 1), F.lit(0))).first()[0]
    flagged = F.broadcast(flagged) if keys <= BROADCAST_KEYS else flagged
    met = pages.select(*[F.col(f"`{c}`") for c in names], _host_key(host).alias("__host")).join(flagged, "__host", "left")
    drops = lambda x: F.array_contains("__flagged", _line_key(x)) & (F.trim(x) != "")
    kept = F.when(F.col("__flagged").isNull(), _lines(text)).otherwise(F.filter(_lines(text), lambda x: ~drops(x)))
    met = met.withColumn("__kept", kept)
    if keep_whole:
        emptied = ~F.exists("__kept", lambda x: F.trim(x) != "")
        met = met.withColumn("__kept", F.when(emptied, _lines(text)).otherwise(F.col("__kept")))
    n = F.when(F.col(text).isNull(), 0).otherwise(F.size(_lines(text)))
    dropped = F.when(F.col(text).isNull(), 0).otherwise(F.size(_lines(text)) - F.size("__kept"))
    out = [F.when(F.col(text).isNotNull(), F.array_join("__kept", "\n")).alias(c) if c == text else F.col(f"`{c}`") for c in names]
    return met.select(*out, n.cast("long").alias("n_lines"), dropped.cast("long").alias("n_dropped"))
