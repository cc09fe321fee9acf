"""Hash columns: canonical spelling, packed form and row digests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that str.isspace accepts.
WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
HEX64 = "^[0-9a-f]{64}$"


def strip(col: Column) -> Column:
    return F.btrim(col, F.lit(WHITE))


def canonical_hash(col: Column) -> Column:
    """Hashes are equal regardless of case and of surrounding white space."""
    return F.lower(strip(col))


def pack_hash(col: Column) -> Column:
    """The canonical hash as 32 bytes where it is 64 hex digits, else as its UTF-8 bytes."""
    c = canonical_hash(col)
    return F.when(c.rlike(HEX64), F.unhex(c)).otherwise(F.encode(c, "UTF-8"))


def fingerprint(*cols: Column, salt: int = 0) -> Column:
    """64-bit hash in which null differs from every value."""
    parts: list[Column] = [F.lit(salt)]
    for c in cols:
        parts += [c.isNull(), c]
    return F.xxhash64(*parts)


def digest(*cols: Column) -> Column:
    """128-bit digest as a struct of two independent 64-bit hashes."""
    return F.struct(fingerprint(*cols, salt=17).alias("a"), fingerprint(*cols, salt=1009).alias("b"))
