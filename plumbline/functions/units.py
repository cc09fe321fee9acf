"""Units: opaque names of the parts of a source. The page number n is the unit page:n."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions.text import blank


def page_units(pages: Column) -> Column:
    """Page numbers as units."""
    return F.transform(pages, lambda p: F.concat(F.lit("page:"), p.cast("string")))


def valid_units(units: Column) -> Column:
    """No null or blank unit and none twice; null units are not valid, an empty list is."""
    return F.coalesce(~F.exists(units, blank) & (F.size(F.array_distinct(units)) == F.size(units)), F.lit(False))


def valid_pages(pages: Column) -> Column:
    """Positive numbers, none twice."""
    return F.coalesce(F.forall(pages, lambda p: F.coalesce(p > 0, F.lit(False))) & (F.size(F.array_distinct(pages)) == F.size(pages)), F.lit(False))


def canonical_units(units: Column) -> Column:
    """Sorted; the order of units says nothing."""
    return F.array_sort(units)


def empty_units() -> Column:
    return F.array().cast("array<string>")


def is_subset(a: Column, b: Column) -> Column:
    return F.size(F.array_except(a, b)) == 0


def source_path_ok(path: Column) -> Column:
    """A canonical root-relative POSIX path."""
    parts = F.exists(F.split(path, "/"), lambda x: x.isin("", ".", ".."))
    return F.coalesce((path != "") & ~path.contains("\\") & ~path.startswith("/") & ~parts, F.lit(False))


def suffix(path: Column) -> Column:
    """The lower-case suffix of a path's last part, with its dot; none for a leading dot."""
    return F.lower(F.regexp_extract(path, r"[^./][^/]*(\.[^./]+)$", 1))
