"""Checks of match and candidate lists, as rows (rule, severity, n, examples)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinlink.sources.tsv import id_list

PREFIX_OK = r"\AS[23]-"


def _row(found: DataFrame, rule: str, severity: str, example: Column) -> DataFrame:
    """The count of found rows and the five least examples; each is kept by a bounded top list."""
    ids = found.select(example.cast("string").alias("x")).distinct()
    some = ids.orderBy("x").limit(5).agg(F.array_join(F.array_sort(F.collect_list("x")), ",").alias("examples"))
    n = found.agg(F.count("*").alias("n"))
    one = n.withColumn("k", F.lit(1)).join(some.withColumn("k", F.lit(1)), "k")
    return one.select(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), "n", "examples")


def check_lists(lists: DataFrame, required: DataFrame | None = None, known: DataFrame | None = None) -> DataFrame:
    """V5 to V11 over lists (s1_id, ids as a comma string): repeated rows and ids, prefixes, unknown, missing and extra ids.

    required: s1_id of the roster. known: cand_id of the gallery.
    """
    rows = lists.select(F.trim("s1_id").alias("s1_id"), F.filter(id_list(F.trim("ids")), lambda x: x != "").alias("ids"))
    each = rows.select("s1_id", F.explode("ids").alias("id"))
    s1, one = F.col("s1_id"), F.col("id")
    out = [
        _row(rows.groupBy("s1_id").agg(F.count("*").alias("c")).where("c > 1"), "duplicate_row", "E", s1),
        _row(rows.where(F.size("ids") != F.size(F.array_distinct("ids"))), "repeated_id", "E", s1),
        _row(each.where(one.startswith("S1-")), "anchor_in_list", "E", one),
        _row(each.where(~one.startswith("S1-") & ~one.rlike(PREFIX_OK)), "bad_prefix", "E", one),
    ]
    if known is not None:
        valid = each.where(one.rlike(PREFIX_OK))
        out.append(_row(valid.join(known.select(F.col("cand_id").alias("id")).distinct(), "id", "left_anti"), "unknown_id", "E", one))
    if required is not None:
        need = required.select("s1_id").distinct()
        out.append(_row(need.join(rows.select("s1_id").distinct(), "s1_id", "left_anti"), "missing_row", "E", s1))
        out.append(_row(rows.select("s1_id").distinct().join(need, "s1_id", "left_anti"), "extra_row", "E", s1))
    result = out[0]
    for r in out[1:]:
        result = result.unionByName(r)
    return result


def check_subset(matches: DataFrame, candidates: DataFrame) -> DataFrame:
    """V12: matches (s1_id, cand_id) that are no candidates, as a warning."""
    lost = matches.select("s1_id", "cand_id").distinct().join(candidates.select("s1_id", "cand_id").distinct(), ["s1_id", "cand_id"], "left_anti")
    return _row(lost, "match_not_candidate", "W", F.concat_ws(">", "s1_id", "cand_id"))


def check_file(spark: SparkSession, path: str, header: tuple[str, str], optional: bool = False) -> list[tuple[str, str, int, str]]:
    """V1 to V4, V13 and V14 on a file's text: (rule, severity, n, examples) of what is wrong."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return [("file_absent", "W" if optional else "E", 1, path)]
    lines = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("n"))
    first = lines.orderBy("n").limit(1).collect()
    if not first:
        return [("file_empty", "E", 1, path)]
    found, head = [], first[0].value
    if "," in head and "\t" not in head:
        found.append(("comma_separated", "E", 1, head))
    elif [c.strip().lower() for c in head.split("\t")] != list(header):
        found.append(("header", "E", 1, head))
    body = lines.where((F.col("n") > first[0].n) & (F.trim("value") != ""))
    stats = body.agg(F.sum((F.instr("value", "\t") == 0).cast("int")).alias("flat"), F.sum(F.col("value").contains("�").cast("int")).alias("odd")).first()
    found += [("row_without_tab", "E", stats.flat, "")] if stats.flat else []
    found += [("not_utf8", "E", stats.odd, "")] if stats.odd else []
    return found


def passes(checks: DataFrame) -> bool:
    """Whether no error was found; warnings never fail."""
    return checks.where("severity = 'E' and n > 0").limit(1).count() == 0
