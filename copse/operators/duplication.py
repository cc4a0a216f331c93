"""Maximal blocks of equal code lines, within a file and across files.

Every run of ``min_lines`` code lines of a file is a window, keyed by hashes of its lines. Windows that occur more
than once form classes. Where every occurrence of a class is followed by the same next class, both belong to one
block; such islands are blocks, and a block grows to either side by the islands that stand beside all its occurrences.
How far is found by prefix doubling: names of 1, 2, 4 ... neighbouring islands, each made of two shorter names, are
compared over a class from the longest to the shortest, so the work is the number of islands times the logarithm of a
region's length, and no occurrence carries its surroundings. A repeat of which every window also occurs elsewhere is not
a block of its own: those inside it are. Only keys travel: lines are hashed before anything is shuffled, and windows that
occur once leave after one pre-aggregated count.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from copse.functions import text
from copse.operators.scan import one_value, path_order
from copse.session import cut

MIN_LINES, MIN_COPIES = 5, 2
#: First parts of a path that name its package, and lines below which a block is short.
PACKAGE_PARTS, SHORT = 2, 10
LOCATIONS = ("within-file", "same-directory", "same-package", "cross-package")


def hashed_lines(normalizer: Callable[[Column], Column] = text.normalize_line) -> Column:
    """A struct of arrays (line, h, g): the numbers of the code lines of ``with_lines``, and two hashes of each normalised.

    All code lines of a file are normalised at once; ``normalizer`` keeps line ends.
    """
    number = F.filter(F.transform("kinds", lambda kind, i: F.when(kind == "code", (i + 1).cast("int"))), lambda x: x.isNotNull())
    code = F.filter(F.zip_with("lines", "kinds", lambda line, kind: F.when(kind == "code", line)), lambda x: x.isNotNull())
    lines = F.slice(F.split(normalizer(F.array_join(code, "\n")), "\n", -1), 1, F.size(number))
    return F.struct(number.alias("line"), F.transform(lines, lambda x: F.xxhash64(x)).alias("h"), F.transform(lines, lambda x: F.hash(x)).alias("g"))


def code_rows(lexed: DataFrame, normalizer: Callable[[Column], Column] = text.normalize_line) -> DataFrame:
    """``path, rows`` of ``hashed_lines``; a column ``rows`` is used if there is one."""
    return lexed.select("path", F.col("rows") if "rows" in lexed.columns else hashed_lines(normalizer).alias("rows"))


def windows(rows: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    """``path, i, key, start_line, end_line, total`` of each window of ``code_rows``.

    ``i`` is its first code line's index, ``key`` its lines' hashes, and ``total`` the file's code lines.
    """
    last = F.size("rows.line") - min_lines
    part = lambda name, i: F.slice(F.col(f"rows.{name}"), i + 1, F.lit(min_lines))
    line = lambda i: F.element_at("rows.line", i + 1)
    found = F.transform(
        F.sequence(F.lit(0), last),
        lambda i: F.struct(
            F.struct(F.xxhash64(part("h", i)).alias("a"), F.hash(part("g", i)).alias("b")).alias("key"),
            line(i).alias("start_line"),
            line(i + min_lines - 1).alias("end_line"),
        ),
    )
    placed = rows.where(last >= 0).select("path", F.size("rows.line").alias("total"), F.posexplode(found).alias("i", "w"))
    return placed.select("path", "i", "w.key", "w.start_line", "w.end_line", "total")


def _named(islands: DataFrame, levels: int) -> DataFrame:
    """``islands`` with ``after_j`` and ``before_j``: a name of the 2**j islands from the next one on, or up to the one before.

    Names double: that of 2**j islands is made of two names of 2**(j-1). They are null where a region ends.
    """
    region = Window.partitionBy("path", "region").orderBy("island")
    out = islands.withColumn("name_0", F.xxhash64("class"))
    for j in range(1, levels):
        second = F.lead(f"name_{j - 1}", 1 << (j - 1)).over(region)
        out = out.withColumn(f"name_{j}", F.when(second.isNotNull(), F.xxhash64(f"name_{j - 1}", second)))
    sides = {f"after_{j}": F.lead(f"name_{j}", 1).over(region) for j in range(levels)} | {f"before_{j}": F.lag(f"name_{j}", 1 << j).over(region) for j in range(levels)}
    return out.withColumns(sides).drop(*[f"name_{j}" for j in range(levels)])


def _step(at: DataFrame, side: str, levels: int) -> DataFrame:
    """``class, by``: how many islands of a side all occurrences of a class have in common, as far as one name tells; classes with none are left out."""
    names = [f"{side}_{j}" for j in range(levels)]
    found = at.groupBy("class").agg(F.count("*").alias("n"), *[f(c).alias(f"{f.__name__}_{c}") for c in names for f in (F.min, F.max, F.count)])
    by = F.coalesce(*[F.when((F.col(f"count_{c}") == F.col("n")) & (F.col(f"min_{c}") == F.col(f"max_{c}")), F.lit(1 << j)) for j, c in reversed(list(enumerate(names)))])
    return found.select("class", by.alias("by")).where("by IS NOT NULL")


def _reached(islands: DataFrame, named: DataFrame, side: str, levels: int) -> DataFrame | None:
    """``class, by``: how many islands of a side all occurrences of a class have in common; None if none has any.

    Each step takes the longest name that all occurrences have in common, then goes on from where that name ends with
    shorter ones, so there are no more steps than names.
    """
    names, way = [f"{side}_{j}" for j in range(levels)], 1 if side == "after" else -1
    done, step = None, cut(_step(named, side, levels))
    while not step.isEmpty():
        done = step if done is None else cut(done.unionByName(step).groupBy("class").agg(F.sum("by").cast("int").alias("by")))
        if levels == 1:
            break
        levels, names = levels - 1, names[: levels - 1]
        there = islands.join(step.select("class"), "class", "left_semi").join(done, "class").select("class", "path", (F.col("island") + way * F.col("by")).alias("island"))
        step = cut(_step(there.join(named.select("path", "island", *names), ["path", "island"]), side, levels))
    return done


def _grown(islands: DataFrame) -> DataFrame:
    """``islands`` grown to both sides by the islands that stand beside all occurrences of their class.

    Islands of a region follow each other without a gap, and wherever a class occurs its whole island does, so what all
    occurrences have in common is a number of whole islands to either side.
    """
    longest = islands.groupBy("path", "region").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 1
    if longest == 1:
        return islands
    levels = (longest - 1).bit_length()
    named = cut(_named(islands.select("path", "region", "island", "class"), levels))
    out = islands
    for side, edge, lines in (("after", "end", "end_line"), ("before", "first", "start_line")):
        reached = _reached(islands, named, side, levels)
        if reached is not None:
            way = F.col("by") if side == "after" else -F.col("by")
            last = islands.join(reached, "class").select("path", "island", (F.col("island") + way).alias("__to"))
            ends = islands.select("path", F.col("island").alias("__to"), F.col(edge).alias("__edge"), F.col(lines).alias("__lines"))
            out = out.join(last.join(ends, ["path", "__to"]).drop("__to"), ["path", "island"], "left")
            out = out.withColumns({edge: F.coalesce("__edge", edge), lines: F.coalesce("__lines", lines)}).drop("__edge", "__lines")
    return out


def _blocks(rows: DataFrame, min_lines: int) -> DataFrame:
    """``class, path, first, last, start_line, end_line, total``: each occurrence of each maximal block of ``code_rows``."""
    found = windows(rows, min_lines)
    repeated = found.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    occurrences = cut(found.join(repeated, "key"))
    along = Window.partitionBy("path").orderBy("i")
    follows = (F.lead("i").over(along) == F.col("i") + 1) & (F.lead("n").over(along) == F.col("n"))
    occurrences = occurrences.withColumns({"next": F.when(follows, F.lead("key").over(along)), "region": F.col("i") - F.row_number().over(along)})
    # a class goes on into the next one if every occurrence does
    links = occurrences.groupBy("key", "n").agg(F.min("next").alias("next"), F.max("next").alias("same"), F.count("next").alias("c"))
    links = links.where((F.col("next") == F.col("same")) & (F.col("c") == F.col("n"))).select("key", F.col("next").alias("linked"))
    joined = occurrences.join(links, "key", "left")
    before = F.coalesce(F.lag("linked").over(along) == F.col("key"), F.lit(False)) & (F.lag("i").over(along) == F.col("i") - 1)
    # blocks lie within regions, which are runs of repeated windows
    starts = joined.withColumn("island", F.sum(F.when(before, 0).otherwise(1)).over(along.rowsBetween(Window.unboundedPreceding, 0)))
    islands = starts.groupBy("path", "region", "island").agg(
        F.min_by("key", "i").alias("class"), F.min("i").alias("first"), F.max("i").alias("end"), F.min("start_line").alias("start_line"), F.max("end_line").alias("end_line"), F.first("total").alias("total")
    )
    grown = _grown(cut(islands))
    return grown.select("class", "path", "first", (F.col("end") + min_lines - 1).alias("last"), "start_line", "end_line", "total")


def fragments(rows: DataFrame, min_lines: int = MIN_LINES, min_copies: int = MIN_COPIES, cross_file_only: bool = False) -> DataFrame:
    """A row for each fragment of each group of equal blocks, from ``code_rows``, which is read more than once: give it as a table.

    ``path, start_line, end_line`` are in lines of the file, ``first`` and ``last`` indexes of code lines, and ``total``
    the file's code lines. Overlapping fragments of a file are one; a group needs ``min_copies`` of what is left. Its
    ``class``, ``copies`` and ``line_count`` (of its first fragment) stand on every row. No group is held together:
    classes that have grown into the same block are told by the number and hashes of their fragments.
    """
    found = _blocks(rows, min_lines)
    order = Window.partitionBy("class", "path").orderBy("first", "last")
    reach = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    apart = found.withColumn("new", F.when(F.col("first") <= reach, 0).otherwise(1))
    spans = apart.withColumn("span", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    spans = cut(
        spans.groupBy("class", "path", "span").agg(
            F.min("first").alias("first"), F.max("last").alias("last"), F.min("start_line").alias("start_line"), F.max("end_line").alias("end_line"), F.first("total").alias("total")
        )
    )
    names = ("path", "first", "last")
    groups = spans.groupBy("class").agg(
        F.count("*").cast("int").alias("copies"), F.bit_xor(F.xxhash64(*names)).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), *names)).alias("y"),
        F.min_by((F.col("last") - F.col("first") + 1).cast("int"), F.struct("path", "start_line", "end_line")).alias("line_count"), F.min("path").alias("a"), F.max("path").alias("z"),
    )
    groups = groups.where(F.col("copies") >= max(2, min_copies))
    if cross_file_only:
        groups = groups.where("a <> z")
    kept = groups.groupBy("copies", "x", "y").agg(F.min("class").alias("class"), F.first("line_count").alias("line_count")).select("class", "copies", "line_count")
    return spans.join(kept, "class").select("class", "copies", "line_count", "path", "start_line", "end_line", "first", "last", "total")


def listed(rows: DataFrame) -> DataFrame:
    """``class, line_count, copies, fragments``: each group of ``fragments`` as one row, as listings show it."""
    one = F.struct("path", "start_line", "end_line", "first", "last", "total")
    return rows.groupBy("class", "line_count", "copies").agg(F.sort_array(F.collect_list(one)).alias("fragments"))


def clones(rows: DataFrame, min_lines: int = MIN_LINES, min_copies: int = MIN_COPIES, cross_file_only: bool = False) -> DataFrame:
    """``listed`` groups of equal blocks: see ``fragments``."""
    return listed(fragments(rows, min_lines, min_copies, cross_file_only))


def with_code(groups: DataFrame, files: DataFrame) -> DataFrame:
    """``listed`` groups with ``code``: the lines of their first fragment as they stand in ``files`` (``path, content``), comments and blanks included."""
    first = groups.withColumn("__at", F.element_at("fragments", 1))
    lines = files.select(F.col("path").alias("__path"), text.split_lines(F.coalesce("content", F.lit(""))).alias("__lines"))
    met = first.join(lines, F.col("__at.path") == F.col("__path"), "left")
    part = F.slice("__lines", F.col("__at.start_line"), F.col("__at.end_line") - F.col("__at.start_line") + 1)
    return met.select(*groups.columns, F.coalesce(part, F.array().cast("array<string>")).alias("code"))


def _as_rows(groups: DataFrame) -> DataFrame:
    """Fragments as rows, of listed groups too."""
    return groups.select("class", "copies", "line_count", F.inline("fragments")) if "fragments" in groups.columns else groups


def order(groups: DataFrame) -> DataFrame:
    """Most lines times copies first, then most lines, then path."""
    return groups.orderBy(F.desc(F.col("line_count") * F.col("copies")), F.desc("line_count"), F.expr("fragments[0].path COLLATE UNICODE"), "class")


def ranked(groups: DataFrame) -> DataFrame:
    """``files, copies, line_count, removable`` of each group; what removing all but one copy saves first."""
    files = F.array_distinct("fragments.path")
    out = groups.select(files.alias("files"), "copies", "line_count", (F.col("line_count") * (F.col("copies") - 1)).alias("removable"), "fragments")
    return out.orderBy(F.desc("removable"), F.desc("line_count"), F.expr("files[0] COLLATE UNICODE"))


def shape(groups: DataFrame) -> DataFrame:
    """One row: ``groups, removable, median_lines, max_lines, under_ten, top_ten_share`` and a count for each location.

    Paths of a group lie in one file, directory or package if the least is the greatest.
    """
    parts = F.slice(F.split("path", "/"), 1, F.size(F.split("path", "/")) - 1)
    names = _as_rows(groups).withColumns({"dir": parts, "package": F.slice(parts, 1, PACKAGE_PARTS)})
    sides = [f(c).alias(f"{side}_{c}") for c in ("path", "dir", "package") for side, f in (("least", F.min), ("most", F.max))]
    one = lambda c: F.col(f"least_{c}") == F.col(f"most_{c}")
    where = F.when(one("path"), LOCATIONS[0]).when(one("dir"), LOCATIONS[1]).when(one("package"), LOCATIONS[2]).otherwise(LOCATIONS[3])
    base = names.groupBy("class", "line_count", "copies").agg(*sides)
    base = base.select("line_count", (F.col("line_count") * (F.col("copies") - 1)).cast("long").alias("removable"), where.alias("location"))
    top = base.orderBy(F.desc("removable")).limit(10).agg(F.coalesce(F.sum("removable"), F.lit(0)).alias("top"))
    n = F.count("*")
    out = base.agg(
        n.alias("groups"),
        F.coalesce(F.sum("removable"), F.lit(0)).alias("removable"),
        F.coalesce(F.max("line_count"), F.lit(0)).alias("max_lines"),
        F.when(n > 0, F.count_if(F.col("line_count") < SHORT) / F.when(n > 0, n) * 100).otherwise(0.0).alias("under_ten"),
        *[F.count_if(F.col("location") == name).alias(name.replace("-", "_")) for name in LOCATIONS],
    )
    out = out.crossJoin(F.broadcast(top)).crossJoin(F.broadcast(one_value(base, "line_count", 0.5, "median_lines")))
    return out.withColumn("top_ten_share", F.when(F.col("removable") > 0, F.col("top") / F.col("removable") * 100).otherwise(0.0)).drop("top")


def per_file(groups: DataFrame) -> DataFrame:
    """``path, total_lines, duplicated_lines, percentage`` of files with duplicates, in code lines."""
    spans = _as_rows(groups).select("path", "first", "last", "total").distinct()
    order = Window.partitionBy("path").orderBy("first", "last")
    reach = F.coalesce(F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))
    fresh = F.greatest(F.lit(0), F.col("last") - F.greatest(F.col("first") - 1, reach))
    covered = spans.withColumn("fresh", fresh).groupBy("path").agg(F.first("total").cast("long").alias("total_lines"), F.sum("fresh").cast("long").alias("duplicated_lines"))
    out = covered.withColumn("percentage", F.col("duplicated_lines") / F.col("total_lines") * 100)
    return out.orderBy(F.desc("duplicated_lines"), path_order())


def headline(files: DataFrame, rows: DataFrame) -> DataFrame:
    """One row: ``total_lines, duplicated_lines, percentage`` over all files."""
    whole = rows.agg(F.coalesce(F.sum(F.size("rows.line")), F.lit(0)).alias("total_lines"))
    out = whole.crossJoin(F.broadcast(files.agg(F.coalesce(F.sum("duplicated_lines"), F.lit(0)).alias("duplicated_lines"))))
    return out.withColumn("percentage", F.when(F.col("total_lines") > 0, F.col("duplicated_lines") / F.col("total_lines") * 100).otherwise(0.0))


def touching(groups: DataFrame, changed: DataFrame) -> DataFrame:
    """The groups with a fragment in a changed file, with all their fragments."""
    hit = _as_rows(groups).select("class", "path").join(changed.select("path").distinct(), "path", "left_semi")
    return groups.join(hit.select("class").distinct(), "class", "left_semi")


def renamed_groups(lexed: DataFrame, exact: DataFrame, min_lines: int = MIN_LINES, min_copies: int = MIN_COPIES) -> DataFrame:
    """One row: how many more groups there are if identifiers do not matter."""
    masked = fragments(cut(code_rows(lexed.drop("rows"), text.normalize_renamed)), min_lines, min_copies)
    both = masked.agg(F.count_distinct("class").alias("masked")).crossJoin(F.broadcast(exact.agg(F.count_distinct("class").alias("plain"))))
    return both.select(F.greatest(F.lit(0), F.col("masked") - F.col("plain")).alias("renamed_groups"))


def clone_churn(groups: DataFrame, blame: DataFrame, top: int = 10) -> DataFrame:
    """``path, newest``: the newest line time of each file in the ``top`` groups, from ``blame`` (``path, line, time``)."""
    paths = ranked(groups).limit(top).select(F.explode("files").alias("path")).distinct()
    return blame.join(paths, "path", "left_semi").groupBy("path").agg(F.max("time").alias("newest"))
