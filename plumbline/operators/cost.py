"""What an update's embeddings cost."""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal, InvalidOperation

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class CostEstimate:
    tokens: int
    baseline_tokens: int | None
    cost: Decimal
    avoided: Decimal | None
    currency: str


def token_sums(embed_ids: DataFrame, counts: DataFrame, comparison_ids: DataFrame | None = None) -> DataFrame:
    """One row: tokens, baseline_tokens, missing (ids without a count), outside (embedded, not compared)."""
    want = embed_ids.select("chunk_id").distinct().withColumn("embed", F.lit(True))
    if comparison_ids is not None:
        want = want.join(comparison_ids.select("chunk_id").distinct().withColumn("compared", F.lit(True)), "chunk_id", "full")
    else:
        want = want.withColumn("compared", F.lit(None).cast("boolean"))
    n = counts.groupBy("chunk_id").agg(F.max("tokens").alias("tokens"))
    return want.join(n, "chunk_id", "left").agg(
        F.coalesce(F.sum(F.when(F.col("embed"), F.col("tokens"))), F.lit(0)).alias("tokens"),
        F.coalesce(F.sum(F.when(F.col("compared"), F.col("tokens"))), F.lit(0)).alias("baseline_tokens"),
        F.count_if(F.col("tokens").isNull() | (F.col("tokens") < 0)).alias("missing"),
        F.count_if(F.col("embed") & F.col("compared").isNull()).alias("outside"),
    )


def priced(sums: DataFrame, price_per_million: str) -> DataFrame:
    """token_sums with exact decimal costs: cost of the tokens, avoided that of the tokens not embedded."""
    price, million = F.lit(price_per_million).cast("decimal(18,8)"), F.lit(1_000_000).cast("decimal(7,0)")
    cost = lambda n: (n.cast("decimal(18,0)") * price / million).cast("decimal(38,14)")
    return sums.withColumns({"cost": cost(F.col("tokens")), "avoided": cost(F.col("baseline_tokens") - F.col("tokens"))})


def estimate_cost(embed_ids: DataFrame, counts: DataFrame, price_per_million: object, currency: str, comparison_ids: DataFrame | None = None) -> CostEstimate:
    """Exact decimal cost; every id needs a token count, and a comparison must hold all embedded ids."""
    try:
        price = Decimal(str(price_per_million))
    except InvalidOperation:
        price = Decimal("nan")
    if isinstance(price_per_million, bool) or not price.is_finite() or price < 0:
        raise ValueError("the price must be finite and not negative")
    if not isinstance(currency, str) or not currency.strip():
        raise ValueError("a currency is needed")
    row = token_sums(embed_ids, counts, comparison_ids).first()
    if row.missing:
        raise ValueError("token counts of planned inputs are missing")
    if comparison_ids is not None and row.outside:
        raise ValueError("the comparison must include all planned embeddings")
    million = Decimal(1_000_000)
    if comparison_ids is None:
        return CostEstimate(row.tokens, None, price * row.tokens / million, None, currency)
    return CostEstimate(row.tokens, row.baseline_tokens, price * row.tokens / million, price * (row.baseline_tokens - row.tokens) / million, currency)
