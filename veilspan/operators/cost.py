"""Generated cases and usage statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspan.operators.score import exact_percentiles

NEIGHBOURS = 2


def generated_cases(matters: DataFrame, neighbours: int = NEIGHBOURS) -> DataFrame:
    """Labelled cases for every matter: two clean drafts, and three leaking ones for each of the next ``neighbours`` matters of the catalog.

    Pairs come from an equi-join on the place in the catalog, so the cases grow with the matters.
    """
    fact = lambda c: F.try_element_at(F.try_element_at("facts", F.lit(c)), F.lit(1))
    told = matters.select(
        "matter_ord", "matter_id", "client", fact("names").alias("name"), fact("orgs").alias("org"), fact("amounts").alias("amount"), fact("distinctive").alias("detail")
    )

    def case(form: int, label: str, *draft):
        return F.struct(F.lit(form).alias("form"), F.lit(label).alias("label"), F.concat(*[F.lit(d) if isinstance(d, str) else d for d in draft]).alias("draft"))

    client, name, amount, org, detail = F.col("client"), F.col("name"), F.col("amount"), F.col("org"), F.col("detail")
    own = told.select("matter_ord", F.lit(0).alias("o_ord"), F.col("matter_id").alias("current"), F.lit(None).cast("string").alias("other"), F.inline(F.array(
        case(0, "clean", "For ", client, ": ", name, " accepts ", amount, "."), case(1, "clean", "Update to ", client, ". Still open: ", detail, "."),
    )))
    asking = told.select("matter_ord", F.col("matter_id").alias("current"), F.col("client").alias("reader"), F.explode(F.sequence(F.lit(1), F.lit(neighbours))).alias("o_ord"))
    other = told.withColumnRenamed("matter_ord", "other_ord").withColumnRenamed("matter_id", "other")
    reader = F.col("reader")
    leaking = asking.join(other, asking["matter_ord"] + asking["o_ord"] == other["other_ord"]).select("matter_ord", "o_ord", "current", "other", F.inline(F.array(
        case(2, "leak", "For ", reader, ": compare ", name, ", who was paid ", amount, "."), case(3, "leak", "Update to ", reader, ". Seen before: ", detail, "."),
        case(4, "leak", "Memo to ", reader, ": ask ", org, "."),
    )))
    return own.unionByName(leaking).select(F.col("matter_ord").alias("c_ord"), "o_ord", "form", "current", "other", "label", "draft")


def usage_summary(samples: DataFrame, price_in: float, price_out: float) -> DataFrame:
    """Mean, p50 and p95 per metric, and the cost of 1,000 calls from token prices per million."""
    stacked = samples.select(F.inline(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in ("input_tokens", "output_tokens", "latency_s")
    ])))
    tails = exact_percentiles(stacked, ["metric"], "v", [0.5, 0.95]).groupBy("metric").agg(
        F.max(F.when(F.col("p") == 0.5, F.col("percentile"))).alias("p50"), F.max(F.when(F.col("p") == 0.95, F.col("percentile"))).alias("p95")
    )
    means = stacked.groupBy("metric").agg(F.avg("v").alias("mean"))
    price = F.when(F.col("metric") == "input_tokens", price_in).when(F.col("metric") == "output_tokens", price_out)
    return means.join(tails, "metric").select("metric", "mean", "p50", "p95", (F.col("mean") * price / 1000).alias("usd_per_1k_calls"))
