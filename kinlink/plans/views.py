"""Record-linkage views over the part table, in SQL that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kinlink.functions.text import apply_normalization, fold_latin
from kinlink.sources.store import written

_COUNTRY = "case when p_partkey % 10 <= 3 then 'US' when p_partkey % 10 <= 8 then 'India' else 'France' end"
_KEY = "cast({} as varchar(20))"
_NUMBER = _KEY.format("(p_partkey * 37) % 997 + 1")


def _address(street: str, before: str = "") -> str:
    return f"concat('{before}', {_NUMBER}, ' ', lower(p_type), ' {street}, ', p_brand)"


def _entity(source: str, key: str = "p_partkey") -> str:
    return f"concat('{source}-', {_KEY.format(key)})"


S1 = f"""
select {_entity("S1")} as entity_id,
       concat(p_name, ' ', lower(p_type), case p_partkey % 5 when 0 then ' Inc' when 1 then ' Pvt Ltd' when 2 then ' SARL' when 3 then ' LLC' else '' end) as business_name,
       {_address("Street")} as business_address, {_COUNTRY} as country
from {{part}}
"""

GALLERY = f"""
select {_entity("S2")} as entity_id,
       concat(upper(p_name), ' ', lower(p_type), case p_partkey % 3 when 0 then ' Incorporated' when 1 then ' Limited' else '' end) as business_name,
       case when p_partkey % 33 = 0 then '' else {_address("St")} end as business_address, {_COUNTRY} as country, 'S2' as source
from {{part}} where p_partkey % 10 <> 7
union all
select {_entity("S3")} as entity_id, concat(p_name, ' ', lower(p_type)) as business_name, {_address("Street")} as business_address, {_COUNTRY} as country, 'S3' as source
from {{part}} where p_partkey % 10 <> 7 and p_partkey % 3 <> 1
union all
select {_entity("S3", "p_partkey + 1000000")} as entity_id, concat(p_name, ' ', lower(p_type)) as business_name, {_address("Street", "9")} as business_address, {_COUNTRY} as country, 'S3' as source
from {{part}} where p_partkey % 4 = 0
"""

TRUTH = f"""
select {_entity("S1")} as source1_entity_id,
       case when p_partkey % 10 = 7 then '' when p_partkey % 3 = 1 then {_entity("S2")} else concat({_entity("S2")}, ',', {_entity("S3")}) end as matched_entity_ids
from {{part}}
"""


def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return spark.sql(sql, part=spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_name", "p_type", "p_brand"))


def s1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, S1)


def gallery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, GALLERY)


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, TRUTH)


def clean_s1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised anchors. The views hold ASCII text, so folding stays in the JVM.

    Written once in a session, so records are normalised once, and the chain of replacements is not copied into every
    expression that uses a clean column.
    """
    return written(spark, f"clean-s1 {sf_dir}", lambda: apply_normalization(s1(spark, sf_dir), fold_latin), f"{sf_dir}/part.parquet")


def clean_gallery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written(spark, f"clean-gallery {sf_dir}", lambda: apply_normalization(gallery(spark, sf_dir), fold_latin), f"{sf_dir}/part.parquet")
