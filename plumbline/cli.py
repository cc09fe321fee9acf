"""Command line: check, chunks, ingestion, embeddings, plan, existing-index, ledger.

Exit status: 0 passed, 1 findings, 2 unusable input.
"""

from __future__ import annotations

import argparse
import json
import sys
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import SparkSession

from plumbline.findings import ordered
from plumbline.operators.chunks import ChunkPolicy, audit_chunks
from plumbline.operators.ingestion import AcceptancePolicy, audit_ingestion
from plumbline.operators.reports import by_code, render, verdict
from plumbline.operators.vectors import audit_embeddings
from plumbline.plans.ledger import Ledger
from plumbline.plans.planning import Guards, plan_update
from plumbline.plans.snapshot import UnsafePlanError, build_snapshot, load_snapshot, save_snapshot
from plumbline.sources import files, records
from plumbline.sources.existing import audit_existing_index

COMMANDS = ("check", "chunks", "ingestion", "embeddings", "plan", "existing-index", "ledger")


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="plumbline", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("check", help="audit a folder of documents")
    c.add_argument("folder")
    c.add_argument("--expected")
    c = sub.add_parser("chunks", help="audit a file of chunks")
    c.add_argument("file")
    c.add_argument("--require", action="append")
    c.add_argument("--min-chars", type=int)
    c.add_argument("--distinctive-term-fraction", type=float)
    c.add_argument("--fail-on-warnings", action="store_true")
    c = sub.add_parser("ingestion", help="audit a batch and, if it passes, save its snapshot")
    c.add_argument("file")
    c.add_argument("--snapshot")
    c = sub.add_parser("embeddings", help="audit embeddings against expected ids")
    c.add_argument("file")
    c = sub.add_parser("plan", help="plan an update between two snapshots")
    c.add_argument("previous")
    c.add_argument("current")
    c.add_argument("--retire", action="append", default=[])
    c.add_argument("--max-delete-fraction", type=float, default=0.25)
    c.add_argument("--max-corpus-delete-fraction", type=float, default=0.15)
    c.add_argument("--max-removed-chunks", type=int)
    c.add_argument("--max-shrinking-documents", type=int)
    c = sub.add_parser("existing-index", help="audit an index export against a folder")
    c.add_argument("folder")
    c.add_argument("export")
    for flag in ("export-complete", "source-scope-complete", "unit-metadata-complete"):
        c.add_argument(f"--{flag}", action="store_true")
    c = sub.add_parser("ledger", help="read a ledger")
    c.add_argument("what", choices=("summary", "history"))
    c.add_argument("path")
    c.add_argument("--last", type=int, default=10)
    for c in sub.choices.values():
        c.add_argument("--json", action="store_true")
        c.add_argument("--max-examples", type=int, default=5)
        c.add_argument("--details", type=int, default=0, metavar="N", help="the first N findings in report order")
    return p


def _show(args: argparse.Namespace, title: str, findings, passed: bool, extra: dict[str, Any] | None = None) -> None:
    groups = by_code(findings, args.max_examples)
    first = [r.asDict() for r in ordered(findings).limit(args.details).collect()] if args.details > 0 else []
    if args.json:
        rows = [r.asDict() for r in groups.orderBy("code", "severity").collect()]  # a row per code
        print(json.dumps({"passed": passed, "findings": rows, **({"details": first} if first else {}), **(extra or {})}, sort_keys=True, default=str))
    else:
        print(render(groups, title, passed))
        for r in first:
            print(" ".join(str(r[k]) for k in ("code", "document_id", "chunk_index", "message") if r[k] not in (None, "")))


def run(args: argparse.Namespace, spark: SparkSession) -> int:
    if args.command == "check":
        r = files.check_folder(spark, args.folder, args.expected)
        _show(args, f"{r.outcome}, {r.counts['files_audited']} of {r.counts['files_discovered']} files audited", r.findings, r.passed, {"outcome": r.outcome, **r.counts})
        return {"passed": 0, "audit_failed": 1}.get(r.outcome, 2)
    if args.command == "chunks":
        chunks = (records.read_chunks_jsonl if args.file.endswith(".jsonl") else records.read_chunks_json)(spark, args.file)
        a = audit_chunks(chunks, ChunkPolicy(required_metadata=args.require or ("source",), min_chars=args.min_chars, distinctive_term_fraction=args.distinctive_term_fraction))
        v = verdict(a.findings, 0 if args.fail_on_warnings else None)
        _show(args, f"{v.errors} errors, {v.warnings} warnings", a.findings, v.passed, {"lengths": a.lengths.first().asDict()})
        return 0 if v.passed else 1
    if args.command == "ingestion":
        w = records.read_workflow(spark, args.file)
        policy = AcceptancePolicy(**{k: v for k, v in (w.get("policy") or {}).items()})
        a = audit_ingestion(w["documents"], w["receipts"], w["chunks"], policy, w.get("namespace"))
        v = a.verdict()
        _show(args, f"{v.errors} errors, {v.warnings} warnings", a.findings, v.passed, a.measurements.first().asDict())
        if v.passed and args.snapshot:
            save_snapshot(build_snapshot(w["documents"], w["receipts"], w["chunks"], w["namespace"], w["pipeline_id"], w["embedding_model"], policy), args.snapshot)
        return 0 if v.passed else 1
    if args.command == "embeddings":
        with open(args.file, encoding="utf-8") as f:
            o = json.load(f)
        e = records.embeddings_from_records(spark, o["embeddings"])
        ids = spark.createDataFrame([(i,) for i in o["expected_chunk_ids"]], "chunk_id string")
        found = audit_embeddings(ids, e, o["dimensions"], norm_range=tuple(o["norm_range"]) if o.get("norm_range") else None)
        v = verdict(found)
        _show(args, f"{v.errors} errors, {v.warnings} warnings", found, v.passed)
        return 0 if v.passed else 1
    if args.command == "plan":
        g = Guards(args.max_delete_fraction, args.max_corpus_delete_fraction, args.max_removed_chunks, args.max_shrinking_documents, tuple(args.retire))
        old = None if args.previous == "none" else load_snapshot(spark, args.previous)
        try:
            plan = plan_update(old, load_snapshot(spark, args.current), g)
        except UnsafePlanError as e:
            print(f"REJECTED: {e}")
            return 1
        print(json.dumps(plan.metrics(), sort_keys=True))
        return 0
    if args.command == "existing-index":
        a = audit_existing_index(spark, args.folder, args.export, args.export_complete, args.source_scope_complete, args.unit_metadata_complete)
        v = verdict(a.findings)
        _show(args, f"{v.errors} errors, {v.warnings} warnings", a.findings, v.passed, {**a.measurements, "checks_unverified": a.unverified})
        return 0 if v.passed else 1
    ledger = Ledger(spark, args.path, read_only=True)
    rows = (ledger.deletion_summary(args.last) if args.what == "summary" else ledger.history(args.last)).collect()  # at most --last rows
    print(json.dumps([r.asDict() for r in rows], sort_keys=True))
    return 0


def main(argv: list[str] | None = None) -> int:
    argv = sys.argv[1:] if argv is None else argv
    if argv and argv[0] not in COMMANDS and not argv[0].startswith("-"):
        argv = ["chunks", *argv]  # a bare file is a file of chunks
    args = _parser().parse_args(argv)
    spark = SparkSession.builder.appName("plumbline").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        return run(args, spark)
    except (OSError, ValueError, KeyError, PySparkException, Py4JJavaError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
