"""Files of any size, lexed in chunks.

Where a chunk starts, inside a block comment or not, depends on all text before it. So each chunk is lexed from every
state it could start in, which gives a map from its first state to its last; maps compose, and a running composition,
found by doubling, gives each chunk the state it does start in. Only these maps, a few numbers a chunk, are put in order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from copse.functions import text
from copse.operators import scan
from copse.session import cut

#: Characters of a chunk.
SIZE = 1 << 20


def chunked(files: DataFrame, size: int = SIZE) -> DataFrame:
    """``path, part, content`` of ``files``, cut after every ``size`` characters; an empty file is one chunk."""
    parts = F.greatest(F.ceil(F.length(F.coalesce("content", F.lit(""))) / size), F.lit(1)).cast("int")
    out = files.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    return out.withColumn("content", F.substring("content", F.col("part") * size + 1, F.lit(size)))


def whole_lines(chunks: DataFrame) -> DataFrame:
    """``path, part, content`` of chunks that may be cut anywhere, each with the lines that end in one of them.

    What stands behind a chunk's last line end goes to the next chunk that has one, so a chunk and a line must each fit a
    row, and a file need not. Parts are numbered anew, in order.
    """
    rows = cut(chunks.select("path", "part", F.coalesce("content", F.lit("")).alias("content")))
    along = Window.partitionBy("path").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    narrow = rows.select("path", "part", F.col("content").contains("\n").cast("int").alias("ends"))
    placed = rows.join(narrow.withColumn("group", F.coalesce(F.sum("ends").over(along), F.lit(0))), ["path", "part"])
    head = F.length("content") - F.length(F.substring_index("content", "\n", -1))
    piece = lambda group, order, content: F.struct(group.alias("group"), order.alias("order"), content.alias("text"))
    first = piece(F.col("group"), F.struct("part", F.lit(0).alias("side")), F.when(F.col("ends") == 1, F.left("content", head)).otherwise(F.col("content")))
    second = piece(F.col("group") + 1, F.struct("part", F.lit(1).alias("side")), F.substring_index("content", "\n", -1))
    pieces = placed.select("path", F.inline(F.when(F.col("ends") == 1, F.array(first, second)).otherwise(F.array(first))))
    joined = pieces.groupBy("path", "group").agg(F.array_sort(F.collect_list(F.struct("order", "text"))).alias("texts"))
    return joined.select("path", F.col("group").cast("int").alias("part"), F.array_join(F.transform("texts", lambda x: x["text"]), "").alias("content"))


def states(chunks: DataFrame) -> DataFrame:
    """``path, part, state`` of chunks of whole lines: the lexer's state at the start of each."""
    ext = text.extension(F.col("path"))
    ends = F.array(*[text.end_state(F.concat(text.opener(ext, F.lit(s)), F.col("content")), ext) for s in range(text.STATES)])
    maps = cut(chunks.select("path", "part", ends.alias("map")))
    longest = maps.groupBy("path").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 1
    along = Window.partitionBy("path").orderBy("part")
    for j in range((longest - 1).bit_length()):  # after this, a map is that of 2**(j + 1) chunks up to its own
        earlier = F.lag("map", 1 << j).over(along)
        maps = maps.withColumn("__map", earlier).withColumn("map", F.coalesce(F.transform("__map", lambda s: F.element_at("map", s + 1)), "map"))
    return maps.select("path", "part", F.coalesce(F.lag("map").over(along)[0], F.lit(0)).alias("state"))


def with_lines(chunks: DataFrame) -> DataFrame:
    """``scan.with_lines`` of chunks (``path, part, content``) that may be cut anywhere: its columns, and ``part`` and ``state``."""
    lines = cut(whole_lines(chunks))
    return scan.with_lines(lines.join(states(lines), ["path", "part"]))


def measured(chunks: DataFrame) -> DataFrame:
    """``scan.measured`` of files given as chunks that may be cut anywhere."""
    sums = ("code", "comment", "blank", "total", "branch", "loop", "bool", "complexity")
    return scan.measured(with_lines(chunks)).groupBy("path", "ext", "language").agg(*[F.sum(c).alias(c) for c in sums])
