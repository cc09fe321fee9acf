"""Audit of chunks: structure, metadata, length, duplicates, boilerplate, distinctiveness."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.checks import check, each, named, number, optional, whole
from plumbline.findings import emit, finding, union
from plumbline.functions import text as T
from plumbline.functions.units import canonical_units, valid_units
from plumbline.operators.numbering import number_rows
from plumbline.session import cut, small

#: What a chunk table may have besides chunk_index and text; absent columns count as null.
OPTIONAL = {
    "chunk_key": "string", "document_id": "string", "source_version": "string", "namespace": "string",
    "units": "array<string>", "metadata": "map<string,string>",
}
#: Marks that a parser of untyped records leaves; absent ones count as true.
MARKS = ("is_record", "is_metadata", "is_text", "json_ok", "units_ok")


@dataclass(frozen=True)
class ChunkPolicy:
    """What to look for. Checks whose bound is None are skipped."""

    required_metadata: Sequence[str] = ("source",)
    max_tokens: int | None = None
    token_counter: Callable[[Column], Column] | None = None
    boilerplate_min_chunks: int = 3
    boilerplate_ratio: float = 0.5
    boilerplate_min_chars: int = 12
    min_chars: int | None = None
    distinctive_term_fraction: float | None = None
    lexical_min_chunks: int = 5

    def __post_init__(self) -> None:
        if isinstance(self.required_metadata, str):
            raise TypeError("required_metadata must be a sequence of keys")
        check(
            self, required_metadata=each(named), max_tokens=optional(whole(1)), min_chars=optional(whole(1)), boilerplate_min_chunks=whole(2), boilerplate_min_chars=whole(1),
            lexical_min_chunks=whole(2), boilerplate_ratio=number(0, 1, low_open=True), distinctive_term_fraction=optional(number(0, 1, low_open=True)),
        )
        if (self.max_tokens is None) != (self.token_counter is None):
            raise ValueError("max_tokens and token_counter go together")
        object.__setattr__(self, "required_metadata", tuple(dict.fromkeys(self.required_metadata)))


@dataclass(frozen=True)
class ChunkAudit:
    """findings, one row of length statistics, and which checks ran. Passed if there is no error."""

    findings: DataFrame
    lengths: DataFrame
    checks_run: tuple[str, ...] = ()
    checks_skipped: tuple[str, ...] = field(default=())

    @property
    def passed(self) -> bool:
        return self.findings.where("severity = 'error'").isEmpty()


def chunk_table(chunks: DataFrame) -> DataFrame:
    """Chunks with all optional columns, in one layout; others are dropped, so no name can clash."""
    have = set(chunks.columns)
    for c in ("chunk_index", "text"):
        if c not in have:
            raise ValueError(f"chunks need a column {c}")
    cols = [F.col("chunk_index").cast("bigint").alias("chunk_index"), F.col("text").cast("string").alias("text")]
    cols += [(F.col(c) if c in have else F.lit(None)).cast(t).alias(c) for c, t in OPTIONAL.items()]
    cols += [(F.coalesce(F.col(c), F.lit(True)) if c in have else F.lit(True)).alias(c) for c in MARKS]
    if "metadata_present" in have:
        cols.append(F.col("metadata_present"))
    return chunks.select(*cols)


def text_ok() -> Column:
    return F.col("is_record") & F.col("is_text") & F.col("text").isNotNull()


def _has(key: str, columns: Sequence[str]) -> Column:
    """Whether a metadata value is there: blank text isn't, neither are empty lists and objects."""
    if "metadata_present" in columns:
        return F.coalesce(F.array_contains("metadata_present", key), F.lit(False))
    value = F.get(F.map_values(F.map_filter("metadata", lambda k, _: k == key)), F.lit(0))
    if key in OPTIONAL and key not in ("metadata", "units"):
        value = F.coalesce(value, F.col(key))
    return ~T.blank(value)


#: What is kept of a chunk after the one pass over its text.
KEPT = ("chunk_index", "document_id", "chunk_key", "source_version", "namespace", "units", *MARKS)


def chunk_facts(t: DataFrame, policy: ChunkPolicy) -> DataFrame:
    """All that the checks need to know about chunks (of chunk_table), without their texts; what facts
    are made of stays as it is. One pass over the texts gives them all; of a DataFrame that isn't cut,
    only those that are used are computed.

    has_text and filled: there is text, and not only white space. missing: required metadata that isn't
    there. d: digest of the normalized text. ends: boundary lines. chars, stripped, lead: length of the
    text, without outer white space, and of the leading white space. tokens: by the policy's counter.
    """
    if "filled" in t.columns:
        return t
    text, ok = F.col("text"), text_ok()
    full = ok & ~T.blank(text)
    missing = F.array_compact(F.array(*[F.when(~_has(k, t.columns), F.lit(k)) for k in policy.required_metadata])) if policy.required_metadata else F.array().cast("array<string>")
    count = F.lit(None) if policy.token_counter is None else F.when(full, policy.token_counter(text))
    return t.select(
        *KEPT, ok.alias("has_text"), full.alias("filled"), missing.alias("missing"),
        F.when(full, F.unhex(F.sha2(T.normalized(text), 256))).alias("d"),
        F.when(full, T.boundary_lines(text, policy.boilerplate_min_chars)).alias("ends"),
        F.length(text).alias("chars"), T.stripped_length(text).alias("stripped"), F.length(F.regexp_extract(text, f"^{T.WS}*", 0)).alias("lead"), count.cast("bigint").alias("tokens"),
    )


def _some(t: DataFrame, policy: ChunkPolicy, *columns: str) -> DataFrame:
    """Some facts of chunks; computed once, if they weren't before."""
    f = chunk_facts(t, policy)
    return f.select(*columns) if f is t else cut(f.select(*columns))


def _at() -> dict[str, Column]:
    return dict(document_id=F.col("document_id"), chunk_index=F.col("chunk_index"), chunk_key=F.col("chunk_key"))


def row_findings(t: DataFrame, policy: ChunkPolicy) -> DataFrame:
    """Findings that a row shows by itself: one scan, one projection."""
    f, at = chunk_facts(t, policy), _at()
    record, filled = F.col("is_record"), F.col("filled")
    found = [
        F.when(~record, finding("invalid_record", message="Record is not a mapping.", **at)),
        F.when(record & ~F.col("is_metadata"), finding("invalid_metadata", message="Metadata is not a mapping.", **at)),
        F.when(record & ~F.col("has_text"), finding("invalid_text", message="Text is not a string.", **at)),
        F.when(F.col("has_text") & ~filled, finding("empty_text", message="Text is empty or white space only.", **at)),
    ]
    for k in policy.required_metadata:
        found.append(F.when(record & F.col("is_metadata") & F.array_contains("missing", k), finding("missing_metadata", message=f"Required metadata {k!r} is missing or empty.", **at)))
    if policy.min_chars is not None:
        found.append(F.when(filled & (F.col("stripped") < policy.min_chars), finding("short_chunk", message=F.concat(F.col("stripped").cast("string"), F.lit(f" characters; the floor is {policy.min_chars}.")), **at)))
    if policy.token_counter is not None:
        found.append(F.when(filled & (F.col("tokens") > policy.max_tokens), finding("token_limit", message=F.concat(F.col("tokens").cast("string"), F.lit(f" tokens; the limit is {policy.max_tokens}.")), **at)))
    return emit(f, found)


def valid_texts(t: DataFrame) -> DataFrame:
    return t.where(text_ok() & ~T.blank(F.col("text")))


def duplicate_texts(t: DataFrame, policy: ChunkPolicy | None = None) -> DataFrame:
    """A finding for each chunk whose text, white space normalized, an earlier one has.

    The first index per text comes from a map-side combined aggregation on the text's digest, so copies
    that make up a third of all rows neither meet in a task nor are sorted. Only digests that occur
    more than once are joined back.
    """
    d = _some(t, policy or ChunkPolicy(), "chunk_index", "document_id", "chunk_key", "d").where("d is not null")
    first = d.groupBy("d").agg(F.min("chunk_index").alias("first"), F.count("*").alias("n")).where("n > 1").select("d", "first")
    hit = d.join(small(first), "d").where("chunk_index <> first")
    text = F.concat(F.lit("Text duplicates chunk "), F.col("first").cast("string"), F.lit(" after white space normalization."))
    return emit(hit, [finding("duplicate_text", message=text, related=F.array("first"), **_at())])


def boundary_line_counts(t: DataFrame, policy: ChunkPolicy | None = None) -> DataFrame:
    """(line, chunks): in how many chunks a line stands first or last."""
    ends = chunk_facts(t, policy or ChunkPolicy()).select(F.explode("ends").alias("line"))
    return ends.groupBy("line").agg(F.count("*").alias("chunks"))


def repeated_boilerplate(t: DataFrame, policy: ChunkPolicy) -> DataFrame:
    """A finding for each chunk and boundary line that at least the threshold of chunks share.

    Lines are counted first, with map-side combination; only those over the threshold, of which there
    are at most 2 / ratio, are joined back.
    """
    ends = _some(t, policy, "chunk_index", "document_id", "chunk_key", "filled", "ends").where("filled")
    lines = ends.select("chunk_index", "document_id", "chunk_key", F.explode("ends").alias("line"))
    valid = ends.agg(F.count("*")).scalar()
    need = F.greatest(F.lit(policy.boilerplate_min_chunks), F.ceil(F.lit(float(policy.boilerplate_ratio)) * valid))
    often = lines.groupBy("line").agg(F.count("*").alias("n")).where(F.col("n") >= need)
    text = F.concat(F.lit("A boundary line repeats in "), F.col("n").cast("string"), F.lit(" chunks."))
    return emit(lines.join(small(often), "line"), [finding("repeated_boilerplate", message=text, **_at())])


def term_frequencies(t: DataFrame) -> DataFrame:
    """(term, chunks): in how many valid chunks a term occurs. One pass, combined on the map side. The
    empty term, which no text has, counts the chunks."""
    terms = valid_texts(t).select(F.explode(F.concat(F.array(F.lit("")), T.terms(F.col("text")))).alias("term"))
    return terms.groupBy("term").agg(F.count("*").alias("chunks"))


def low_distinctiveness(t: DataFrame, policy: ChunkPolicy) -> DataFrame:
    """A finding for each chunk of three or more terms all of which a high fraction of chunks have.

    The texts are read twice: to count the terms, and to compare each chunk's terms with the frequent
    ones. Of these there are at most (terms per chunk) / fraction, so they are sent out as one array;
    no term of a chunk is shuffled.
    """
    df = cut(term_frequencies(t))
    n = F.coalesce(df.where("term = ''").agg(F.max("chunks")).scalar(), F.lit(0))
    often = df.where((F.col("term") != "") & (F.col("chunks") / n >= policy.distinctive_term_fraction)).agg(F.collect_list("term")).scalar()
    v = valid_texts(t).where(n >= policy.lexical_min_chunks).select("chunk_index", "document_id", "chunk_key", T.terms(F.col("text")).alias("terms"))
    hit = v.where((F.size("terms") >= 3) & (F.size(F.array_except("terms", often)) == 0))
    return emit(hit, [finding("low_distinctiveness", message="All terms occur in a high fraction of this batch.", **_at())])


def length_statistics(t: DataFrame, policy: ChunkPolicy | None = None) -> DataFrame:
    """One row: count, min, median, p95 (nearest rank), max of the stripped lengths; zeros of none."""
    n = chunk_facts(t, policy or ChunkPolicy()).where("filled").select(F.col("stripped").cast("bigint").alias("n"))
    return n.agg(
        F.count("*").alias("count"),
        F.coalesce(F.min("n"), F.lit(0)).alias("min"),
        F.coalesce(F.median("n"), F.lit(0.0)).alias("median"),
        F.coalesce(F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY n)"), F.lit(0.0)).cast("bigint").alias("p95"),
        F.coalesce(F.max("n"), F.lit(0)).alias("max"),
    )


def audit_chunks(chunks: DataFrame, policy: ChunkPolicy | None = None, facts: DataFrame | None = None) -> ChunkAudit:
    """Audit chunks (chunk_index, text and any of OPTIONAL and MARKS).

    chunk_index is the order that decides which of several equal texts is the first. Null texts are
    invalid, blank ones empty; both are left out of the other checks. An empty table has no findings.
    The texts are read once, for facts that all checks share (given, if the caller has them), and twice
    more for low_distinctiveness.
    """
    p = policy or ChunkPolicy()
    t = chunk_table(chunks)
    f = cut(chunk_facts(t, p)) if facts is None else facts
    parts = [row_findings(f, p), duplicate_texts(f), repeated_boilerplate(f, p)]
    optional_checks = {"token_limit": p.token_counter, "short_chunk": p.min_chars, "low_distinctiveness": p.distinctive_term_fraction}
    run = ["record_structure", "empty_text", "duplicate_text", "required_metadata", "repeated_boilerplate", "chunk_length_distribution"]
    if p.distinctive_term_fraction is not None:
        parts.append(low_distinctiveness(t, p))
    asked = {k: v is not None for k, v in optional_checks.items()}
    return ChunkAudit(union(parts), length_statistics(f), (*run, *(k for k, v in asked.items() if v)), tuple(k for k, v in asked.items() if not v))


def assign_chunk_keys(chunks: DataFrame) -> DataFrame:
    """Positional keys ["document", unit or [units], ordinal within them] for chunks without keys.

    The units of a chunk are a set; a chunk without usable units or document has no key. Chunks of one
    unit are numbered by chunk_index, in as many tasks as they take (number_rows).
    """
    if "chunk_key" in chunks.columns:
        raise ValueError("existing chunk keys are not replaced")
    ok = ~T.blank(F.col("document_id")) & valid_units(F.col("units")) & (F.size("units") > 0)
    rows = chunks.withColumn("_units", F.when(ok, canonical_units(F.col("units"))))
    rows = number_rows(rows, ["document_id", "_units"], ["chunk_index"], "_at")
    doc = F.regexp_extract(F.to_json(F.struct(F.col("document_id").alias("v"))), r"^\{\"v\":(.*)\}$", 1)
    names = F.when(F.size("_units") == 1, F.regexp_extract(F.to_json("_units"), r"^\[(.*)\]$", 1)).otherwise(F.to_json("_units"))
    key = F.concat(F.lit("["), doc, F.lit(","), names, F.lit(","), F.col("_at").cast("string"), F.lit("]"))
    return rows.withColumn("chunk_key", F.when(F.col("_units").isNotNull(), key)).drop("_units", "_at")
