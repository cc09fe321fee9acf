"""Differences between two copies of one dataset, by a column-by-bucket checksum matrix.

1. Every entry becomes (key, side, order, one 64-bit fingerprint per field); the newest entry of
   each key and side is kept. Only fixed-width fingerprints are shuffled, never the values.
2. The matrix: keys are hashed into buckets; per bucket and column the 128-bit hashes of
   (key, fingerprint) are added up in 32-bit lanes, positively for the one copy and negatively for
   the other. A cell is zero exactly if both copies agree there (but for 2^-128).
3. Only the unequal buckets are read again, and in them only the values of the unequal columns;
   columns with no unequal cell anywhere are not even scanned. Their newest entries are put side
   by side by one aggregation on the key and compared field by field.

A numeric field with a tolerance is fingerprinted by its cell on a grid of half the tolerance:
equal cells prove that the values agree, unequal ones are settled in step 3.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.hashing import canonical_hash, fingerprint
from plumbline.session import broadcast_if_small, cut

KINDS = ("exact", "hash", "set", "tolerance")
EXPECTED, OBSERVED = 1, -1


@dataclass(frozen=True)
class Field:
    """A compared value column. kind: exact; hash (case and outer white space don't count); set
    (order and repetition don't count); tolerance (numbers may differ by up to ``tolerance``)."""

    name: str
    kind: str = "exact"
    tolerance: float = 0.0

    def __post_init__(self) -> None:
        if self.kind not in KINDS:
            raise ValueError(f"kind must be one of {KINDS}")
        if self.kind == "tolerance" and not self.tolerance > 0:
            raise ValueError("tolerance must be positive")

    def value(self) -> Column:
        c = F.col(f"`{self.name}`")
        if self.kind == "hash":
            return canonical_hash(c)
        if self.kind == "set":
            return F.array_sort(F.array_distinct(c))
        return c.cast("double") if self.kind == "tolerance" else c

    def print(self) -> Column:
        v = self.value()
        if self.kind == "set":
            return fingerprint(F.size(v), v)
        return fingerprint(F.floor(v / (self.tolerance / 2)) if self.kind == "tolerance" else v)

    def differs(self, a: Column, b: Column) -> Column:
        if self.kind != "tolerance":
            return ~a.eqNullSafe(b)
        far = (F.abs(a - b) > self.tolerance) & ~a.eqNullSafe(b)
        return F.when(a.isNull() | b.isNull(), ~(a.isNull() & b.isNull())).otherwise(far)


def _lanes(*cols: Column) -> list[Column]:
    """128 bits as four non-negative 32-bit lanes; sums of up to 2^31 of them fit a BIGINT."""
    out = []
    for salt in (71, 7919):
        h = F.xxhash64(F.lit(salt), *cols)
        out += [h.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(h, 32)]
    return out


def tag_copies(expected: DataFrame, observed: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Two tables as one table of entries with a side column."""
    return (
        expected.select(*columns, F.lit(EXPECTED).alias("side"))
        .unionByName(observed.select(*columns, F.lit(OBSERVED).alias("side")))
    )


def checksum_cells(
    entries: DataFrame, keys: Sequence[str], fields: Sequence[Field], order: str, buckets: int
) -> DataFrame:
    """The unequal cells of the matrix: (bucket, mask, tied); bit i of mask is set if field i is unequal,
    bit len(fields) if the keys are; tied tells whether different entries share a greatest order."""
    key = [F.col(f"k{i}") for i in range(len(keys))]
    prints = [f.print() for f in fields]
    whole = fingerprint(*prints)
    newest = (
        entries.select(
            *[F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(keys)], "side",
            F.struct(F.col(f"`{order}`").alias("o"), whole.alias("r"), *[x.alias(f"p{i}") for i, x in enumerate(prints)]).alias("m"),
            F.struct(F.col(f"`{order}`").alias("o"), F.bitwise_not(whole).alias("r")).alias("other"),
        )
        .groupBy(*key, "side")
        .agg(F.max("m").alias("m"), F.max("other").alias("other"))
    )
    row = fingerprint(*key)
    lanes = [[F.col("side") * x for x in _lanes(F.lit(-1), row)]]
    lanes += [[F.col("side") * x for x in _lanes(F.lit(i), row, F.col(f"m.p{i}"))] for i in range(len(fields))]
    matrix = newest.groupBy(F.pmod(row, F.lit(buckets)).alias("bucket")).agg(
        *[F.sum(x).alias(f"c{i}_{j}") for i, four in enumerate(lanes) for j, x in enumerate(four)], F.max(F.col("m.r") != F.bitwise_not(F.col("other.r"))).alias("tied")
    )
    unequal = [
        F.when(reduce(lambda a, b: a | b, [F.col(f"c{i}_{j}") != 0 for j in range(4)]), F.lit(1 << ((i - 1) % (len(fields) + 1)))).otherwise(F.lit(0))
        for i in range(len(fields) + 1)
    ]
    mask = reduce(lambda a, b: a.bitwiseOR(b), unequal)
    return matrix.select("bucket", mask.alias("mask"), "tied").where("mask <> 0")


def diff_copies(
    entries: DataFrame,
    keys: Sequence[str],
    fields: Sequence[Field],
    order: str,
    bucket_rows: int = 32,
) -> DataFrame:
    """Rows (keys..., field_name) for each key that one copy lacks or whose field values differ.

    ``entries`` has a column ``side``: 1 for the expected copy, -1 for the observed one. Per key and
    side only the entry with the greatest ``order`` counts; should different ones share it, the one whose
    fingerprint over all fields is the greatest, as a whole, so that the result doesn't depend on the
    partitioning. (Only then all fields are read again to tell it.)
    field_name is ``missing_observed``, ``missing_expected`` or the field's name. Null equals only
    null, in keys too. Repeated rows change nothing; an empty table gives no rows; other columns are
    never read.
    """
    if not fields or not keys or len(fields) > 60:
        raise ValueError("keys and 1 to 60 fields are needed")
    if bucket_rows < 1:
        raise ValueError("bucket_rows must be positive")
    entries = entries.where(F.col("side").isin(EXPECTED, OBSERVED))
    buckets = max(1, entries.select("side").count() // (2 * bucket_rows))
    cells = cut(checksum_cells(entries, keys, fields, order, buckets))
    seen, tied = cells.agg(F.coalesce(F.bit_or("mask"), F.lit(0)), F.coalesce(F.max("tied"), F.lit(False))).first()  # the columns to read at all
    used = [f for i, f in enumerate(fields) if seen >> i & 1]

    key = [F.col(f"k{i}") for i in range(len(keys))]
    bit = {f.name: 1 << i for i, f in enumerate(fields)}
    again = entries.select(
        *[F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(keys)], "side", F.col(f"`{order}`").alias("o"),
        (fingerprint(*[f.print() for f in fields]) if tied else F.lit(0)).alias("r"),
        F.pmod(fingerprint(*[F.col(f"`{k}`") for k in keys]), F.lit(buckets)).alias("bucket"),
        *[f.value().alias(f"v{i}") for i, f in enumerate(used)],
    ).join(broadcast_if_small(cells.select("bucket", "mask")), "bucket")
    wanted = [F.when(F.col("mask").bitwiseAND(F.lit(bit[f.name])) != 0, F.struct(F.col(f"v{i}").alias("v"))).alias(f"f{i}") for i, f in enumerate(used)]
    again = again.select(*key, "side", F.struct("o", "r", *wanted).alias("m"))
    both = again.groupBy(*key).agg(*[F.max(F.when(F.col("side") == v, F.col("m"))).alias(s) for s, v in {"e": EXPECTED, "o": OBSERVED}.items()])
    both = both.select(*key, F.col("e").isNotNull().alias("has_e"), F.col("o").isNotNull().alias("has_o"), *[F.col(f"{s}.f{i}").alias(f"{s}{i}") for s in "eo" for i in range(len(used))])
    found = F.when(~F.col("has_o"), F.array(F.lit("missing_observed"))).when(~F.col("has_e"), F.array(F.lit("missing_expected")))
    named = [
        F.when((F.col(f"e{i}").isNotNull() | F.col(f"o{i}").isNotNull()) & f.differs(F.col(f"e{i}.v"), F.col(f"o{i}.v")), F.lit(f.name))
        for i, f in enumerate(used)
    ]
    found = found.otherwise(F.array_compact(F.array(*named)) if named else F.array().cast("array<string>"))
    return both.select(*[F.col(f"k{i}").alias(k) for i, k in enumerate(keys)], F.explode(found).alias("field_name"))
