"""Tab-separated record tables, match lists and pair scores.

All columns are strings by declared schemas; an empty field is null. Nothing is quoted in either direction.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinlink.functions.text import apply_normalization

RECORDS = T.StructType([T.StructField(c, T.StringType()) for c in ("entity_id", "business_name", "business_address", "country")])
PREFIXES = {"S1": "S1-", "S2": "S2-", "S3": "S3-"}


def read_tsv(spark: SparkSession, path: str | list[str], schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).options(sep="\t", header=True, quote="", escape="", enforceSchema=False).csv(path)


def read_records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return read_tsv(spark, path, RECORDS)


def list_schema(value: str, key: str = "source1_entity_id") -> T.StructType:
    return T.StructType([T.StructField(key, T.StringType()), T.StructField(value, T.StringType())])


def load_training_data(spark: SparkSession, data_dir: str) -> dict[str, DataFrame]:
    """s1, s2, s3 and truth of dataset/train."""
    base = f"{data_dir}/dataset/train/train"
    out = {f"s{k}": read_records(spark, f"{base}_source{k}.tsv") for k in (1, 2, 3)}
    return out | {"truth": read_tsv(spark, f"{base}_ground_truth.tsv", list_schema("matched_entity_ids"))}


def load_test_data(spark: SparkSession, data_dir: str) -> dict[str, DataFrame]:
    base = f"{data_dir}/dataset/test/test"
    return {f"s{k}": read_records(spark, f"{base}_source{k}.tsv") for k in (1, 2, 3)}


def load_frames(spark: SparkSession, data_dir: str, split: str, normalise: bool = False) -> dict[str, DataFrame]:
    """s1, gallery and truth (long, where there is one) of a root or leaf folder; missing fields are empty strings.

    normalise: with the clean columns of names, addresses and countries beside the raw ones.
    """
    leaf = spark._jvm.org.apache.hadoop.fs.Path(f"{data_dir}/dataset/{split}")
    exists = leaf.getFileSystem(spark._jsc.hadoopConfiguration()).exists(leaf)
    base = f"{data_dir}/dataset/{split}/{split}" if exists else f"{data_dir}/{split}"
    s1, s2, s3 = (read_records(spark, f"{base}_source{k}.tsv").na.fill("") for k in (1, 2, 3))
    out = {"s1": s1, "gallery": combine_sources(s2, s3)}
    if normalise:
        out = {name: apply_normalization(df) for name, df in out.items()}
    if split == "train":
        out["truth"] = truth_long(read_tsv(spark, f"{base}_ground_truth.tsv", list_schema("matched_entity_ids")))
    return out


def combine_sources(s2: DataFrame, s3: DataFrame) -> DataFrame:
    return s2.withColumn("source", F.lit("S2")).unionByName(s3.withColumn("source", F.lit("S3")))


def id_list(c: Column) -> Column:
    """Ids of a comma list, trimmed, in order, blank ones kept; none for null or empty."""
    return F.when(c.isNull() | (c == ""), F.array().cast("array<string>")).otherwise(F.transform(F.split(c, ","), lambda x: F.trim(x)))


def id_set(c: Column) -> Column:
    """Distinct ids of a comma list without blank ones."""
    return F.array_distinct(F.filter(id_list(F.trim(c)), lambda x: x != ""))


def truth_long(truth: DataFrame, value: str = "matched_entity_ids", key: str = "source1_entity_id") -> DataFrame:
    """(s1_id, cand_id): a row for each listed id, and one with null for an anchor without any."""
    return truth.select(F.trim(key).alias("s1_id"), F.explode_outer(id_set(F.col(value))).alias("cand_id"))


def read_id_lists(spark: SparkSession, path: str, value: str, key: str = "source1_entity_id") -> DataFrame:
    """(s1_id, ids). Of rows with the same key the last in the file counts."""
    rows = read_tsv(spark, path, list_schema(value, key)).withColumn("_n", F.monotonically_increasing_id())
    last = rows.groupBy(F.trim(key).alias("s1_id")).agg(F.max_by(F.coalesce(F.col(value), F.lit("")), "_n").alias("v"))
    return last.select("s1_id", id_set(F.col("v")).alias("ids"))


def read_pair_scores(spark: SparkSession, path: str) -> DataFrame:
    """(s1_id, cand_id, score); rows with unreadable scores are skipped, of repeated pairs the last counts."""
    names = ("source1_entity_id", "candidate_entity_id", "score")
    rows = read_tsv(spark, path, T.StructType([T.StructField(c, T.StringType()) for c in names]))
    rows = rows.select(F.trim(names[0]).alias("s1_id"), F.trim(names[1]).alias("cand_id"), F.expr("try_cast(trim(score) AS double)").alias("score"), F.monotonically_increasing_id().alias("_n"))
    return rows.where("score is not null").groupBy("s1_id", "cand_id").agg(F.max_by("score", "_n").alias("score"))


def country_map(records: DataFrame) -> DataFrame:
    """(entity_id, country): "?" for a missing one."""
    return records.select(F.trim("entity_id").alias("entity_id"), F.when(F.coalesce("country", F.lit("")) == "", "?").otherwise(F.trim("country")).alias("country"))


def gallery_stats(records: DataFrame) -> DataFrame:
    """(country, n) with a row of null country for the whole."""
    return country_map(records).rollup("country").agg(F.count("*").alias("n"))


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """Distinct first fields of a file with a header; blank lines are skipped."""
    lines = spark.read.text(path).withColumn("n", F.monotonically_increasing_id()).where("trim(value) <> ''")
    first = lines.agg(F.min("n")).first()[0]
    return lines.where(F.col("n") != F.lit(first)).select(F.trim(F.split("value", "\t")[0]).alias("id")).where("id <> ''").distinct()


def head(df: DataFrame, n: int = 3) -> DataFrame:
    """The first rows of a table, to look at."""
    return df.limit(n)


def country_counts(df: DataFrame, key: str = "country") -> DataFrame:
    """(country, n), the most frequent first, ties by name; a missing one is null."""
    return df.groupBy(F.col(key).alias("country")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "country")


def profile(df: DataFrame) -> DataFrame:
    """(column, rows, nulls) of each column; one scan."""
    stats = df.select(F.count("*").alias("rows"), F.array(*[F.struct(F.lit(c).alias("column"), F.count(F.when(F.col(c).isNull(), 1)).alias("nulls")) for c in df.columns]).alias("s"))
    return stats.select("rows", F.explode("s").alias("s")).select("s.column", "rows", "s.nulls")


def write_tsv(df: DataFrame, path: str, one_file: bool = True) -> None:
    """One ordered file with a header, or one for each partition, in their order; empty strings and nulls are written as nothing."""
    (df.coalesce(1) if one_file else df).write.mode("overwrite").options(sep="\t", header=True, quote="", escape="", emptyValue="", nullValue="").csv(path)


def match_lists(selected: DataFrame, roster: DataFrame, value: str = "matched_entity_ids") -> DataFrame:
    """The rows of a results file: an anchor of the roster (s1_id, pos) each, in its order, with its sorted ids joined."""
    lists = selected.groupBy("s1_id").agg(F.array_join(F.array_sort(F.collect_set("cand_id")), ",").alias(value))
    rows = roster.join(lists, "s1_id", "left").orderBy("pos")
    return rows.select(F.col("s1_id").alias("source1_entity_id"), F.coalesce(value, F.lit("")).alias(value))


def pair_score_rows(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("s1_id").alias("source1_entity_id"), F.col("cand_id").alias("candidate_entity_id"), F.format_string("%.6f", F.col("p")).alias("score"))


def write_report(report: dict, path: str) -> None:
    """A bounded report, already on the driver, as JSON."""
    with open(path, "w", encoding="utf-8") as f:
        json.dump(report, f, indent=2, default=str)
