"""Queries of the training-data problems, over whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillflow.functions.identity import label_key
from rillflow.llm import languages, mixing, packing, percentiles
from rillflow.llm.tokens import token_count
from rillflow.plans.sizing import spread_if_few
from rillflow.queries.registry import Registry, table

registry = Registry()


def _readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "system_metrics").where("service IS NOT NULL")
    return rows.select(label_key(F.col("service")).alias("service"), "metric_type", "value", F.to_date("timestamp").alias("day"))


_PERCENTILES = """
SELECT lower(trim(service)) AS service, metric_type, count(*) AS n_values, {columns}
FROM system_metrics WHERE service IS NOT NULL AND value IS NOT NULL AND NOT isnan(value) GROUP BY ALL""".format(
    columns=", ".join(f"round(quantile_cont(value, {p}), 6) AS {percentiles.name_of(p)}" for p in percentiles.PERCENTILES)
)


@registry.query("p6_percentiles", _PERCENTILES)
def p6_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(percentiles.percentiles(_readings(spark, sf_dir), ["service", "metric_type"], F.col("value")))


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in map(percentiles.name_of, percentiles.PERCENTILES)})


@registry.query("p6_of_days", _PERCENTILES)
def p6_of_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from the runs of separate days, as they would be kept, added up."""
    group = ["service", "metric_type"]
    daily = percentiles.value_runs(_readings(spark, sf_dir), ["day", *group], F.col("value"))
    return _rounded(percentiles.percentiles_of_runs(percentiles.merge_runs([daily.drop("day")], group), group))


def sized_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = spread_if_few(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return texts.select("doc_id", "source", token_count(F.col("text")).alias("n_tokens"))


@registry.query("p7_containers")
def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(sized_documents(spark, sf_dir), table(spark, sf_dir, "pack_capacity"))


@registry.query("p7_fill")
def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = table(spark, sf_dir, "pack_capacity")
    packed = p7_containers(spark, sf_dir).groupBy("container_kind").agg(
        F.count_distinct("container_id").alias("n_containers"), F.sum("n_tokens").alias("n_tokens"), F.count_distinct("doc_id").alias("n_documents")
    )
    return packed.join(kinds, "container_kind").select(
        "*", F.round(1 - F.col("n_tokens") / (F.col("n_containers") * F.col("capacity_tokens")), 6).alias("unused_share")
    )


@registry.query("p8_mix")
def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(sized_documents(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


@registry.query("p8_shares")
def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = table(spark, sf_dir, "mix_targets")
    chosen, parts = mixing.mix_and_plan(sized_documents(spark, sf_dir), targets)
    return mixing.shares(chosen, targets, parts)


def _models(spark: SparkSession, sf_dir: str) -> languages.ByteModels:
    return languages.collected_models(table(spark, sf_dir, "lang_samples"), table(spark, sf_dir, "documents"))


@registry.query("p9_found")
def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages.mislabelled(table(spark, sf_dir, "documents"), _models(spark, sf_dir))


@registry.query("p9_languages")
def p9_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages.language_segments(table(spark, sf_dir, "documents"), _models(spark, sf_dir)).select("doc_id", "lang", "confidence")


@registry.query("p9_segments")
def p9_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = languages.language_segments(table(spark, sf_dir, "documents"), _models(spark, sf_dir))
    return found.select("doc_id", F.posexplode("segments").alias("segment", "s")).select("doc_id", "segment", "s.*")
