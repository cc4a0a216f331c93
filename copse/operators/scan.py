"""The base relation: a row for each file, with its lines and what they are."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from copse.functions import paths, text
from copse.functions.languages import language_name


def spread(files: DataFrame, key: str = "path") -> DataFrame:
    """``files`` dealt out by a key, if they are stored in fewer pieces than there are cores; else as they are.

    A table of one small file would be lexed by one task. A table of many files is read where it lies, without a shuffle.
    """
    cores = files.sparkSession.sparkContext.defaultParallelism
    return files.repartition(cores, key) if len(files.inputFiles()) < cores else files


def with_lines(files: DataFrame) -> DataFrame:
    """``files`` (``path, content``) with ``ext, language, lines, code_lines, kinds``; ``content`` stays.

    A null content has no lines. With a column ``state``, a content starts in that state of the lexer.
    """
    out = files.withColumns({"content": F.coalesce("content", F.lit("")), "ext": text.extension(F.col("path"))})
    whole = F.concat(text.opener(F.col("ext"), F.col("state")), F.col("content")) if "state" in files.columns else F.col("content")
    out = out.withColumns({"language": language_name(F.col("ext")), "lines": text.split_lines(F.col("content")), "code_text": text.code_text(whole, F.col("ext"))})
    out = out.withColumn("code_lines", text.code_lines(F.col("code_text"), F.col("lines")))
    return out.withColumn("kinds", text.line_kinds(F.col("lines"), F.col("code_lines")))


def _count(kind: str) -> Column:
    return F.size(F.filter("kinds", lambda k: k == kind)).cast("long")


def measured(lexed: DataFrame, buckets: bool = True) -> DataFrame:
    """``path, ext, language, code, comment, blank, total, branch, loop, bool, complexity`` of ``with_lines``; more columns stay.

    Without ``buckets`` decisions are not told apart: one pass over the code instead of three.
    """
    of = lambda bucket: text.decisions(F.col("code_text"), F.col("ext"), bucket).cast("long")
    counts = {k: _count(k) for k in ("code", "comment", "blank")} | {"total": F.size("kinds").cast("long")}
    if not buckets:
        return lexed.withColumns(counts | {"complexity": of(None)})
    out = lexed.withColumns(counts | {b: of(b) for b in ("branch", "loop", "bool")})
    return out.withColumn("complexity", F.col("branch") + F.col("loop") + F.col("bool"))


def with_roles(files: DataFrame, patterns: dict[str, Sequence[str]] | None = None, attributes: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """``files`` with ``role``, computed once: filters on it are not pushed below, where they would compute it and what it is made of again."""
    roled = files.withColumn("role", paths.role_of(F.col("path"), F.coalesce("content", F.lit("")), patterns, attributes))
    return roled.where(F.spark_partition_id() >= 0)  # always true


def scoped(files: DataFrame, changed: DataFrame | None = None) -> DataFrame:
    """The files of a changed set, or all of them if there is no set; an empty set leaves nothing."""
    return files if changed is None else files.join(changed.select("path").distinct(), "path", "left_semi")


def included(roled: DataFrame, include_all: bool = False) -> DataFrame:
    """The files that analyses look at: sources, or all."""
    return roled if include_all else roled.where(F.col("role") == "source")


def role_summary(roled: DataFrame) -> DataFrame:
    """``role, files, code`` in the order of roles; roles without files do not appear."""
    found = roled.groupBy("role").agg(F.count("*").alias("files"), F.sum("code").alias("code"))
    return found.orderBy(paths.role_order(F.col("role")))


def quantiles(values: DataFrame, column: str, fraction: float, by: Sequence[str] = ()) -> DataFrame:
    """``by..., value``: of the sorted values the one at index ``min(n - 1, floor(n * fraction))``.

    Values are first counted, and positions come from running sums of the counts, so a group's rows are never held
    together: what a task sorts is the group's different values.
    """
    counted = values.groupBy(*by, column).agg(F.count("*").alias("n"))
    whole = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    upto = F.sum("n").over(whole.orderBy(column).rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("n").over(whole)
    index = F.least(total - 1, F.floor(total * F.lit(float(fraction))))
    placed = counted.withColumns({"upto": upto, "index": index}).where((F.col("upto") > F.col("index")) & (F.col("upto") - F.col("n") <= F.col("index")))
    return placed.select(*by, F.col(column).alias("value"))


#: Accuracy of the sketch that brackets a quantile of many different values: ranks are off by a share of 1 / ACCURACY.
ACCURACY = 10_000


def one_value(values: DataFrame, column: str, fraction: float, name: str) -> DataFrame:
    """The quantile of a whole table as one row, 0 if it is empty; for columns of few different values, as counts are."""
    return quantiles(values, column, fraction).agg(F.coalesce(F.max("value"), F.lit(0)).alias(name))


def wide_values(values: DataFrame, wanted: dict[str, tuple[Column, float]]) -> DataFrame:
    """One row with a quantile for each name, as ``one_value`` has it, of columns that may have as many different values as rows.

    ``wanted`` gives each name's values (nulls do not count) and fraction. ``values`` is read twice, however many quantiles
    there are: sketches that merge bracket all of them in one pass, and in a second what lies in a bracket is kept, as
    counts of equal values, and what lies below is counted.
    """
    sketches = []
    for name, (column, fraction) in wanted.items():
        edges = [max(0.0, fraction - 2 / ACCURACY), min(1.0, fraction + 2 / ACCURACY)]
        sketches += [F.percentile_approx(column, edges, ACCURACY).alias(f"__edges_{name}"), F.count(column).alias(f"__total_{name}")]
    met = values.crossJoin(F.broadcast(values.agg(*sketches)))
    entries = []
    for name, (column, fraction) in wanted.items():
        low, high, total = F.col(f"__edges_{name}")[0], F.col(f"__edges_{name}")[1], F.col(f"__total_{name}")
        index = F.least(total - 1, F.floor(total * F.lit(float(fraction)))).cast("long")
        # a null stands for all values below the bracket
        own = [F.when(column >= low, column).alias(n) if n == name else F.lit(None).cast(met.select(c).schema[0].dataType).alias(n) for n, (c, _) in wanted.items()]
        entries.append(F.when(column <= high, F.struct(F.lit(name).alias("__of"), index.alias("__index"), *own)))
    rows = met.select(F.inline(F.filter(F.array(*entries), lambda x: x.isNotNull())))
    counted = rows.groupBy("__of", "__index", *wanted).agg(F.count("*").alias("__n"))
    order = Window.partitionBy("__of").orderBy(*[F.asc_nulls_first(n) for n in wanted]).rowsBetween(Window.unboundedPreceding, 0)
    placed = counted.withColumn("__upto", F.sum("__n").over(order))
    chosen = placed.where((F.col("__upto") > F.col("__index")) & (F.col("__upto") - F.col("__n") <= F.col("__index")))
    return chosen.agg(*[F.coalesce(F.max(n), F.lit(0)).alias(n) for n in wanted])


def path_order() -> Column:
    """Paths as people sort them: by the root collation."""
    return F.expr("path COLLATE UNICODE")
