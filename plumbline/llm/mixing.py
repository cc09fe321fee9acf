"""Mixing sources to target weights by capped water-filling, with seeded repetitions."""

from __future__ import annotations

import base64
from collections.abc import Callable
from dataclasses import dataclass
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions.hashing import WHITE, strip
from plumbline.session import cut

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the splitting pattern published with this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Sources are weighed on the driver, so there may be at most as many.
MAX_SOURCES = 100_000
#: A seeded number below this decides on a text's fractional repetition.
SPAN = 1 << 40
CELLS = 4096


@dataclass(frozen=True)
class Target:
    """A source's wish: its share of all tokens, its tokens at hand and how often it may repeat."""

    source: str
    share: float
    tokens: int
    cap: int


def water_fill(targets: list[Target], total: float | None = None) -> dict[str, float]:
    """Tokens to take per source.

    Sources whose share of ``total`` exceeds what their capped repetitions hold are clamped to that;
    what they lack is spread over the others in proportion to their shares, until no further source
    is exceeded. With no total, the tokens at hand of all sources are taken. If all sources are
    clamped, the mix is smaller than total.
    """
    rest = {t.source: t for t in targets if t.share > 0}
    total = float(sum(t.tokens for t in targets)) if total is None else total
    out, left = {t.source: 0.0 for t in targets}, total
    while rest:
        weight = sum(t.share for t in rest.values())
        over = [t for t in rest.values() if left * t.share / weight >= t.cap * t.tokens]
        if not over:
            return out | {t.source: left * t.share / weight for t in rest.values()}
        for t in over:
            out[t.source] = float(t.cap * t.tokens)
            left -= out[t.source]
            del rest[t.source]
    return out


@cache
def _encoder(tokenizer: str, pattern: str) -> Callable[[str], list[int]]:
    """The vocabulary's encoder; made once per worker."""
    import tiktoken

    with open(tokenizer, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("mix", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def count_tokens(text: Column, tokenizer: str = TOKENIZER, pattern: str = PATTERN) -> Column:
    """Tokens of a text under a public byte-level BPE vocabulary in the tiktoken rank format."""

    @F.pandas_udf("long")
    def f(texts: pd.Series) -> pd.Series:
        encode = _encoder(tokenizer, pattern)
        return pd.Series([None if t is None else len(encode(t)) for t in texts], dtype="Int64")

    return f(text)


def source_label(col: Column) -> Column:
    """Labels are the same regardless of case and of outer white space."""
    return F.lower(strip(col))


def sized_texts(documents: DataFrame, targets: DataFrame, doc_id: str, text: str, source: str, tokenizer: str) -> DataFrame:
    """(source, doc_id, tokens): every distinct text of the target sources once, under its least doc_id."""
    rows = documents.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"), source_label(F.col(f"`{source}`")).alias("source"))
    rows = rows.where(F.col("doc_id").isNotNull() & (F.btrim("text", F.lit(WHITE)) != ""))
    rows = rows.join(F.broadcast(targets.select("source")), "source", "left_semi")
    rows = rows.select("source", "doc_id", F.sha2("text", 256).alias("d"), count_tokens(F.col("text"), tokenizer).alias("tokens"))
    return rows.groupBy("source", F.unhex("d").alias("d")).agg(F.min("doc_id").alias("doc_id"), F.max("tokens").alias("tokens")).drop("d")


@dataclass(frozen=True)
class Mix:
    """texts: (doc_id, source, tokens, copies); report: one row per source of the targets."""

    texts: DataFrame
    report: DataFrame


def mix_sources(
    documents: DataFrame,
    targets: DataFrame,
    total_tokens: float | None = None,
    seed: int = 11,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    tokenizer: str = TOKENIZER,
) -> Mix:
    """Combine texts so that each source of ``targets`` (source, target_share, max_repeats) gets its share.

    A source that is to give r times its tokens has every text floor(r) times and a seeded choice of
    texts once more. That choice is a threshold on a seeded hash: the tokens of each source are summed
    in CELLS cells of the hash (a map-side aggregation), and the threshold is set in the cell in which
    the wanted sum is reached, so no source is sorted or gathered however large it is.

    Labels are compared without case and outer white space; repeated targets are added up, with the
    least max_repeats, and shares are divided by their sum; null or negative ones count as 0, a null
    max_repeats as 1. Null and blank texts and those of other sources take no part. No text, also none
    that several documents of a source share, is repeated more than max_repeats times. Sources with no
    text get 0 tokens and stand in the report.
    """
    if total_tokens is not None and not total_tokens >= 0:
        raise ValueError("total_tokens must not be negative")
    share = F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0))
    goals = (
        targets.select(source_label(F.col("source")).alias("source"), share.alias("share"), F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(0)).alias("cap"))
        .where("source is not null").groupBy("source").agg(F.sum("share").alias("share"), F.min("cap").alias("cap"))
    )
    wishes = goals.limit(MAX_SOURCES + 1).collect()
    if len(wishes) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    spark = documents.sparkSession
    goals = spark.createDataFrame(wishes, "source string, share double, cap int")
    draw = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(SPAN))
    texts = cut(sized_texts(documents, goals, doc_id, text, source, tokenizer).withColumn("draw", draw))

    cell = F.floor(F.col("draw") / (SPAN // CELLS)).cast("int").alias("cell")
    cells = cut(texts.groupBy("source", cell).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("texts")))
    at_hand = {r[0]: (r[1], r[2]) for r in cells.groupBy("source").agg(F.sum("tokens"), F.sum("texts")).collect()}
    weight = sum(w.share for w in wishes) or 1.0
    plan = water_fill([Target(w.source, w.share / weight, at_hand.get(w.source, (0, 0))[0], w.cap) for w in wishes], total_tokens)
    rows = []
    for w in wishes:
        have, n = at_hand.get(w.source, (0, 0))
        times = plan[w.source] / have if have else 0.0
        whole = min(int(times), w.cap)
        rows.append((w.source, w.share / weight, w.cap, n, have, plan[w.source], times, whole, (times - whole) * have if whole < w.cap else 0.0))
    plans = spark.createDataFrame(rows, "source string, target_share double, max_repeats int, texts long, tokens_at_hand long, planned_tokens double, repeats double, whole int, more double")

    # The threshold of each source: the cell in which the wanted tokens are reached, and how far in it.
    up_to = F.sum("tokens").over(W.partitionBy("source").orderBy("cell"))
    line = cells.withColumn("up_to", up_to).join(F.broadcast(plans.select("source", "more")), "source").where("up_to >= more and more > 0")
    line = line.groupBy("source").agg(F.min(F.struct("cell", "up_to", "tokens", "more")).alias("c"))
    part = (F.col("c.more") - F.col("c.up_to") + F.col("c.tokens")) / F.col("c.tokens")
    limit = ((F.col("c.cell") + part) * (SPAN // CELLS)).cast("long")
    limits = plans.join(line.select("source", limit.alias("below")), "source", "left").select("source", "whole", F.coalesce("below", F.lit(0)).alias("below"))
    copies = F.col("whole") + F.when(F.col("draw") < F.col("below"), 1).otherwise(0)
    chosen = texts.join(F.broadcast(limits), "source").select("doc_id", "source", "tokens", copies.alias("copies")).where("copies > 0")

    got = chosen.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("mixed_tokens"), F.max("copies").alias("most_copies"))
    report = plans.join(got, "source", "left").na.fill(0, ["mixed_tokens", "most_copies"])
    all_ = F.sum("mixed_tokens").over(W.partitionBy())  # as many rows as targets
    report = report.select(
        "source", "target_share", "max_repeats", "texts", "tokens_at_hand", "planned_tokens", "repeats", "mixed_tokens", "most_copies",
        F.coalesce(F.try_divide(F.col("mixed_tokens").cast("double"), all_), F.lit(0.0)).alias("mixed_share"),
    )
    return Mix(chosen, report)
