"""Token usage and its cost: (call_id, provider, model, input_tokens, output_tokens, ...) and rates for a thousand tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Provider, model, cost of a thousand input and output tokens.
RATES = [
    ("openai", "gpt-4o", 0.005, 0.015), ("openai", "gpt-4o-mini", 0.00015, 0.0006), ("openai", "gpt-4-turbo", 0.01, 0.03),
    ("anthropic", "claude-3-5-sonnet", 0.003, 0.015), ("anthropic", "claude-3-5-haiku", 0.0008, 0.004), ("anthropic", "claude-3-opus", 0.015, 0.075),
    ("groq", "default", 0.0005, 0.0005), ("deepseek", "deepseek-chat", 0.00014, 0.00028), ("deepseek", "deepseek-reasoner", 0.00014, 0.00219),
    ("mistral", "mistral-large", 0.002, 0.006), ("mistral", "mistral-medium", 0.0006, 0.0018), ("gemini", "gemini-1.5-flash", 0.000075, 0.0003), ("gemini", "gemini-1.5-pro", 0.00125, 0.005),
    ("sambanova", "default", 0.001, 0.002), ("nebius", "default", 0.0002, 0.0006), ("openrouter", "default", 0.001, 0.002), ("cerebras", "default", 0.0005, 0.0005),
    ("fireworks", "default", 0.0005, 0.0005), ("together", "default", 0.0006, 0.0006), ("ollama", "default", 0.0, 0.0),
]
OTHERWISE = (0.001, 0.002)


def calls(usage: DataFrame) -> DataFrame:
    """One row for each call: whole-row duplicates counted once, provider folded (null as "unknown"), null tokens as 0."""
    d = usage.dropDuplicates()
    return d.withColumn("provider", F.coalesce(F.lower(F.trim("provider")), F.lit("unknown"))).withColumn("model", F.coalesce(F.trim("model"), F.lit("unknown"))).withColumn("input_tokens", F.coalesce("input_tokens", F.lit(0))).withColumn("output_tokens", F.coalesce("output_tokens", F.lit(0)))


def priced_models(usage: DataFrame) -> DataFrame:
    """(provider, model, input_rate, output_rate) of each model in use: its own rate, else that of the longest model name it
    contains, else its provider's default, else the general one. Only distinct models are joined with rates."""
    rates = usage.sparkSession.createDataFrame(RATES, "rate_provider string, rate_model string, input_rate double, output_rate double")
    models = usage.select("provider", "model").distinct()
    fits = (F.col("rate_model") == F.col("model")) | F.contains(F.lower("model"), F.col("rate_model")) | (F.col("rate_model") == "default")
    order = F.when(F.col("rate_model") == F.col("model"), 0).when(F.col("rate_model") == "default", 2).otherwise(1)
    w = Window.partitionBy("provider", "model").orderBy(order, F.desc(F.length("rate_model")), "rate_model")
    found = models.join(rates, (F.col("provider") == F.col("rate_provider")) & fits, "left").withColumn("n", F.row_number().over(w)).where("n = 1")
    return found.select("provider", "model", F.coalesce("input_rate", F.lit(OTHERWISE[0])).alias("input_rate"), F.coalesce("output_rate", F.lit(OTHERWISE[1])).alias("output_rate"))


def costs(usage: DataFrame) -> DataFrame:
    """Calls with cost_usd, rounded to 6 decimals for each call."""
    c = calls(usage)
    cost = F.col("input_tokens") / 1000 * F.col("input_rate") + F.col("output_tokens") / 1000 * F.col("output_rate")
    return c.join(priced_models(c), ["provider", "model"]).withColumn("cost_usd", F.round(cost, 6)).drop("input_rate", "output_rate")


def by(usage: DataFrame, *keys: str) -> DataFrame:
    """calls, input_tokens, output_tokens, total_tokens and cost_usd for each key, or of all without keys."""
    c = costs(usage)
    return c.groupBy(*keys).agg(
        F.count("*").alias("calls"), F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("input_tokens"), F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("output_tokens"),
        F.coalesce(F.sum(F.col("input_tokens") + F.col("output_tokens")), F.lit(0)).alias("total_tokens"), F.round(F.coalesce(F.sum("cost_usd"), F.lit(0.0)), 6).alias("cost_usd"),
    )


def plateaus(trace: DataFrame, step: float = 0.1, least: float = 0.7, after: int = 2) -> DataFrame:
    """(run_id, stopped_at): the first iteration beyond ``after`` at which a run's quality has changed by less than ``step`` twice in
    a row and is above ``least``; runs (run_id, iteration, quality) that never settle have no row."""
    w = Window.partitionBy("run_id").orderBy("iteration")
    one, two = F.lag("quality", 1).over(w), F.lag("quality", 2).over(w)
    flat = (F.abs(F.col("quality") - one) < step) & (F.abs(one - two) < step) & (F.col("quality") > least) & (F.col("iteration") > after)
    return trace.withColumn("flat", flat).where("flat").groupBy("run_id").agg(F.min("iteration").alias("stopped_at"))
