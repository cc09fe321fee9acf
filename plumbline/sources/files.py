"""Files of a folder tree as sources: listing, reading and chunking in tasks.

A tree is listed level by level: each level is a table of folders whose entries tasks list, so no process
walks the whole tree. Tasks must see the file system that the root lies on.
"""

from __future__ import annotations

import hashlib
import html
import importlib.util
import os
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from io import BytesIO
from pathlib import Path
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from plumbline.findings import emit, finding, union
from plumbline.functions.text import WHITE, blank, split_words
from plumbline.functions.units import source_path_ok, suffix
from plumbline.operators.chunks import assign_chunk_keys
from plumbline.operators.ingestion import AcceptancePolicy, IngestionAudit, audit_ingestion
from plumbline.session import broadcast_if_small, cut, small

# The file types of a folder check.
TEXT = (".txt", ".md", ".rst")
HTML = (".html", ".htm")
SUPPORTED = (".pdf", *TEXT, *HTML, ".docx", ".pptx")
#: Packages that readers need beyond the standard library.
READERS = {".pdf": "pypdf"}
ENTRIES = "kind string, source string, path string, suffix string"
READ = "source string, source_version string, unit string, unit_no int, text string, failed boolean, image_only boolean, reason string, error string"

# Why a file couldn't be read, by the name of a class of the exception and, where it says
# so, the suffix. The first that fits counts.
REASONS = (
    ("ImportError", None, "reader_unavailable"),
    ("UnicodeError", None, "invalid_utf8"),
    ("EmptyFileError", None, "empty_file"),
    ("FileNotDecryptedError", ".pdf", "encrypted_pdf"),
    ("WrongPasswordError", ".pdf", "encrypted_pdf"),
    ("PdfReadError", ".pdf", "invalid_pdf"),
    ("PdfStreamError", ".pdf", "invalid_pdf"),
    ("PermissionError", None, "permission_denied"),
    ("SourceChangedError", None, "source_changed"),
    ("Exception", None, "unknown_read_error"),
)


class SourceChangedError(Exception):
    """A file's bytes weren't the same after it was read."""


def read_failure(suffix: str, e: Exception) -> str:
    kinds = {c.__name__ for c in type(e).__mro__}
    return next(reason for name, only, reason in REASONS if name in kinds and only in (None, suffix))


@dataclass(frozen=True)
class Tree:
    """entries: ENTRIES. kind: file (supported), other, linked (a link to a folder or a supported file;
    never followed) or failed (a folder that couldn't be listed; suffix holds the error)."""

    entries: DataFrame

    def files(self) -> DataFrame:
        return self.entries.where("kind = 'file'").select("source", "path", "suffix")

    def problems(self) -> DataFrame:
        """A finding for each linked or failed entry; without any, the listing is complete."""
        linked = finding("source_path_excluded", message="Links are not followed.", document_id=F.col("source"))
        failed = finding("source_enumeration_failed", message=F.col("suffix"), document_id=F.col("source"))
        return emit(self.entries, [F.when(F.col("kind") == "linked", linked), F.when(F.col("kind") == "failed", failed)])


def _entries_of(folders: DataFrame, suffixes: tuple[str, ...]) -> DataFrame:
    def rows_of(source: str, path: str) -> Iterator[tuple]:
        with os.scandir(path) as found:
            for e in found:
                name, kind = f"{source}/{e.name}".lstrip("/"), Path(e.name).suffix.lower()
                if e.is_symlink():
                    if os.path.isdir(e.path) or kind in suffixes:
                        yield "linked", name, e.path, kind
                    else:
                        yield "other", name, e.path, kind
                elif e.is_dir(follow_symlinks=False):
                    yield "folder", name, e.path, kind
                else:
                    yield "file" if kind in suffixes else "other", name, e.path, kind

    def list_them(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for source, path in zip(b["source"], b["path"]):
                try:
                    rows = list(rows_of(source, path))
                except OSError as e:
                    rows = [("failed", source, path, type(e).__name__)]
                yield pd.DataFrame(rows, columns=["kind", "source", "path", "suffix"])

    return folders.select("source", "path").mapInPandas(list_them, ENTRIES)


def list_tree(spark: SparkSession, root: str, suffixes: tuple[str, ...] = SUPPORTED) -> Tree:
    """List a tree; the root itself may be reached through links."""
    base = os.path.realpath(root, strict=True)
    if not os.path.isdir(base):
        raise ValueError("the root must be a folder")
    level, levels = spark.createDataFrame([("", base)], "source string, path string"), []
    while not levels or not level.isEmpty():
        levels.append(cut(_entries_of(level, suffixes)))
        level = levels[-1].where("kind = 'folder'")
    return Tree(reduce(DataFrame.unionByName, levels).where("kind <> 'folder'"))


_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?:[^>"']|"[^"]*"|'[^']*')*>""", re.DOTALL)
#: Elements whose content isn't shown; that of the first two isn't markup either.
_RAW, _HIDDEN = ("script", "style"), ("script", "style", "template")


def html_text(page: str) -> str:
    """The text between a page's tags, but for scripts, styles and templates, joined by blanks."""
    shown, at, templates = [], 0, 0
    while at < len(page):
        tag = _TAG.search(page, at)
        text = page[at : tag.start() if tag else len(page)]
        if text and not templates:
            shown.append(html.unescape(text))
        if tag is None:
            break
        at, name = tag.end(), (tag["name"] or "").lower()
        if name == "template":
            templates = max(0, templates - 1) if tag["end"] else templates + 1
        elif name in _RAW and not tag["end"]:
            close = re.compile(rf"</{name}(?=[\s/>])", re.IGNORECASE).search(page, at)
            at = close.start() if close else len(page)
    return " ".join(shown)


@F.pandas_udf(StringType())
def html_body(html: pd.Series) -> pd.Series:
    """The visible text of each HTML page; null stays null."""
    return html.map(lambda x: None if x is None else html_text(x))


def _local(element: ElementTree.Element) -> str:
    return element.tag.rpartition("}")[2]


def _runs(element: ElementTree.Element) -> str:
    """The text of a paragraph: its runs, with tabs and breaks."""
    as_text = {"tab": "\t", "br": "\n", "cr": "\n"}
    return "".join((e.text or "") if _local(e) == "t" else as_text.get(_local(e), "") for e in element.iter())


def _paragraphs(element: ElementTree.Element) -> list[str]:
    """The paragraphs below an element in the document's order, those of table cells in their places."""
    return [_runs(e) for e in element.iter() if _local(e) == "p"]


def _docx_units(raw: bytes) -> Iterator[tuple[str, str]]:
    with zipfile.ZipFile(BytesIO(raw)) as z:
        yield "body", "\n".join(_paragraphs(ElementTree.fromstring(z.read("word/document.xml"))))


def _pptx_units(raw: bytes) -> Iterator[tuple[str, str]]:
    """Slides in the order of the presentation; shapes, groups and tables in that of the slide."""
    with zipfile.ZipFile(BytesIO(raw)) as z:
        links = {e.get("Id"): e.get("Target") for e in ElementTree.fromstring(z.read("ppt/_rels/presentation.xml.rels"))}
        show = ElementTree.fromstring(z.read("ppt/presentation.xml"))
        ids = [next(v for k, v in e.attrib.items() if k.endswith("}id")) for e in show.iter() if _local(e) == "sldId"]
        for n, i in enumerate(ids, 1):
            slide = z.read(f"ppt/{links[i]}" if not links[i].startswith("/") else links[i][1:])
            yield f"slide:{n}", "\n".join(_paragraphs(ElementTree.fromstring(slide)))


def _pdf_units(raw: bytes) -> Iterator[tuple[str, str | None, bool, bool]]:
    from pypdf import PdfReader

    for n, page in enumerate(PdfReader(BytesIO(raw)).pages, 1):
        text, image = None, False
        try:
            text = page.extract_text() or ""
            image = not text.strip() and bool(len(page.images))
        except Exception:  # a page that fails is a failed unit; one whose images fail has no sign of being one
            pass
        yield f"page:{n}", text, text is None, image


def units_of(suffix: str, raw: bytes) -> Iterator[tuple[str, str | None, bool, bool]]:
    """(unit, text, failed, likely image only) of a file's bytes."""
    if suffix == ".pdf":
        yield from _pdf_units(raw)
    elif suffix in (".docx", ".pptx"):
        yield from ((u, t, False, False) for u, t in (_docx_units if suffix == ".docx" else _pptx_units)(raw))
    else:
        text = raw.decode("utf-8")
        yield "file", html_text(text) if suffix in HTML else text, False, False


def read_units(paths: DataFrame) -> DataFrame:
    """READ: a row per unit, or one with a reason for a file that can't be read. paths: source, path, suffix.

    The version is the SHA-256 of the file's bytes, taken again after extraction.
    """
    names = [x.split()[0] for x in READ.split(", ")]

    def rows_of(source: str, path: str, kind: str) -> list[tuple]:
        raw = Path(path).read_bytes()
        version = hashlib.sha256(raw).hexdigest()
        rows = [(source, version, unit, n, text, failed, image, None, None) for n, (unit, text, failed, image) in enumerate(units_of(kind, raw))]
        if hashlib.sha256(Path(path).read_bytes()).hexdigest() != version:
            raise SourceChangedError
        return rows or [(source, version, None, 0, None, False, False, None, None)]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for source, path, kind in zip(b["source"], b["path"], b["suffix"]):
                try:
                    rows = rows_of(source, path, kind)
                except Exception as e:
                    rows = [(source, None, None, 0, None, True, False, read_failure(kind, e), type(e).__name__)]
                yield pd.DataFrame(rows, columns=names)

    return paths.select("source", "path", "suffix").mapInPandas(read, READ)


def expected_files(spark: SparkSession, path: str) -> DataFrame:
    """(source) of a list of root-relative paths of supported files, one a line; raises if any isn't one,
    if one is listed twice or if there is none."""
    lines = spark.read.text(path).select(F.btrim(F.regexp_replace("value", "^\\x{FEFF}", ""), F.lit(WHITE)).alias("source")).where("source <> ''")
    lines = cut(lines)
    fits = F.is_valid_utf8("source") & source_path_ok(F.col("source")) & suffix(F.col("source")).isin(*SUPPORTED)
    wrong = lines.groupBy("source").agg(F.count("*").alias("n")).where((F.col("n") > 1) | ~fits).select(F.min("source")).first()[0]
    if wrong is not None:
        raise ValueError(f"not a root-relative path of a supported file, or listed twice: {wrong}")
    if lines.isEmpty():
        raise ValueError("the list of expected files is empty")
    return lines


def unit_chunks(units: DataFrame, words_per_chunk: int = 400, overlap: int = 40) -> DataFrame:
    """Chunks of units (source, source_version, unit, unit_no, text): runs of words within each nonblank unit.

    chunk_index follows source, unit and place in the unit: up to 2^23 sources, 2^20 units of each and
    2^20 chunks of each.
    """
    files = units.select("source").distinct()
    place = small(files.withColumn("n", F.rank().over(_by_source())))
    parts = units.where(~blank(F.col("text"))).select("source", "source_version", "unit", "unit_no", F.posexplode(split_words(F.col("text"), words_per_chunk, overlap)).alias("part", "text"))
    at = F.shiftleft(F.col("n").cast("long"), 40) + F.shiftleft(F.col("unit_no").cast("long"), 20) + F.col("part")
    rows = parts.join(place, "source").select(
        at.alias("chunk_index"), F.col("source").alias("document_id"), "source_version", "source", F.array("unit").alias("units"), "text", F.create_map(F.lit("source"), "source").alias("metadata"),
    )
    return assign_chunk_keys(rows)


def _by_source():
    from pyspark.sql import Window as W

    return W.orderBy("source")  # a narrow row per file


@dataclass(frozen=True)
class FolderCheck:
    outcome: str
    counts: dict[str, int]
    findings: DataFrame
    audit: IngestionAudit
    unverified: tuple[str, ...]

    @property
    def passed(self) -> bool:
        return self.outcome == "passed"


def outcome() -> Column:
    """The outcome of a check by its facts. The names of the outcomes and their order."""
    whole = (F.col("walk_problems") == 0) & (F.col("unreadable") == 0)
    no_reader = (F.col("walk_problems") == 0) & (F.col("audited") == 0) & (F.col("found") > 0) & (F.col("reader_unavailable") == F.col("found"))
    return (
        F.when(no_reader, "reader_unavailable").when(~whole, "incomplete").when((F.col("found") == 0) & ~F.col("listed"), "no_supported_files")
        .when(F.col("errors") > 0, "audit_failed").otherwise("passed")
    )


def source_inventory(units: DataFrame) -> DataFrame:
    """(document_id, source_version, expected_units, processed_units, empty_units, failed_units) of the readable files."""
    sets = {"expected": F.lit(True), "processed": ~F.col("failed"), "empty": ~F.col("failed") & blank(F.col("text")), "failed": F.col("failed")}
    cols = [F.array_sort(F.collect_set(F.when(c, F.col("unit")))).alias(f"{n}_units") for n, c in sets.items()]
    return units.where("reason is null").groupBy(F.col("source").alias("document_id"), "source_version").agg(*cols)


def check_folder(spark: SparkSession, root: str, expected: str | None = None) -> FolderCheck:
    """List, read, chunk and audit a folder, and tell unusable evidence from findings."""
    want = None if expected is None else expected_files(spark, expected)
    tree = list_tree(spark, root)
    tree = Tree(cut(tree.entries))
    units = cut(read_units(tree.files()))
    docs = cut(source_inventory(units))
    documents = docs.select("document_id", "source_version", "expected_units", F.exists("expected_units", lambda u: u.startswith("page:")).alias("legacy"))
    audit = audit_ingestion(documents, docs.withColumn("completed", F.lit(True)), unit_chunks(units.where("reason is null")), AcceptancePolicy(require_documents=not docs.isEmpty()))

    own = [
        tree.problems(),
        emit(units.where("reason is not null"), [finding("source_read_failed", message=F.concat_ws(": ", "reason", "error"), document_id=F.col("source"))]),
        emit(units.where("image_only"), [finding("likely_image_only_page", message=F.col("unit"), document_id=F.col("source"))]),
    ]
    complete = tree.problems().isEmpty()
    gone = None
    if want is not None and complete:
        gone = want.join(broadcast_if_small(tree.files()), "source", "left_anti")
        own.append(emit(gone, [finding("missing_expected_source", message="An expected file isn't there.", document_id=F.col("source"))]))
    found = cut(union(own).unionByName(audit.findings))

    kinds = tree.entries.agg(F.count_if(F.col("kind") == "file").alias("found"), F.count_if(F.col("kind") == "other").alias("other"), F.count_if(F.col("kind").isin("linked", "failed")).alias("walk_problems"))
    reads = units.agg(
        F.count_if(F.col("reason").isNotNull()).alias("unreadable"), F.count_if(F.col("reason") == "reader_unavailable").alias("reader_unavailable"),
        F.count_if(F.col("reason").isNull() & F.col("unit").isNotNull()).alias("units"), F.count_if("image_only").alias("images"),
    )
    rest = [docs.agg(F.count("*").alias("audited")), found.agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("code") == "missing_expected_source").alias("missing"))]
    facts = reduce(lambda x, y: x.crossJoin(y), [kinds, reads, *rest]).withColumn("listed", F.lit(want is not None))  # one row each
    f = facts.withColumn("outcome", outcome()).first()
    claims = {
        "historical_index_coverage": True, "within_unit_text_completeness": True, "expected_files_outside_current_folder": want is None, "expected_file_absence": want is not None and gone is None,
        "unsupported_file_types": f.other, "complete_source_processing": f.unreadable, "complete_source_enumeration": f.walk_problems,
    }
    counts = {
        "files_discovered": f.found, "files_audited": f.audited, "units_enumerated": f.units, "unsupported_files": f.other,
        "image_only_units": f.images, "missing_expected_files": f.missing, "reader_unavailable_files": f.reader_unavailable,
    }
    return FolderCheck(f.outcome, counts, found, audit, tuple(sorted(k for k, v in claims.items() if v)))


def check_manifest(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """(source, problem) of a pinned manifest (source, sha256, pages) against files (source, sha256, pages)."""
    m, f = manifest.select("source", F.struct("sha256", "pages").alias("m")), files.select("source", F.struct("sha256", "pages").alias("f"))
    both = F.col("m").isNotNull() & F.col("f").isNotNull()
    problem = F.array(
        F.when(F.col("f").isNull(), "missing_file"), F.when(F.col("m").isNull(), "unlisted_file"),
        F.when(both & ~F.col("m.sha256").eqNullSafe(F.col("f.sha256")), "wrong_hash"), F.when(both & ~F.col("m.pages").eqNullSafe(F.col("f.pages")), "wrong_page_count"),
    )
    return m.join(f, "source", "full").select("source", F.explode(F.array_compact(problem)).alias("problem"))


def readers_available() -> dict[str, bool]:
    """Which of the readers that need a package have it."""
    return {s: importlib.util.find_spec(m) is not None for s, m in READERS.items()}
