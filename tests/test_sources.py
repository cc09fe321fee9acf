import json
import zipfile

import pytest
from pyspark.sql import functions as F

from plumbline import cli, findings
from plumbline.operators.export_audit import audit_index
from plumbline.sources import files, records
from plumbline.sources.existing import audit_existing_index, source_findings
from plumbline.streaming.audit_stream import audit_stream, stream_findings


def tree(root, **content):
    for name, data in content.items():
        p = root / name.replace("__", "/").replace("_dot_", ".")
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(data if isinstance(data, bytes) else data.encode())
    return str(root)


def test_folder_passes_and_keys_are_stable(spark, rows, tmp_path):
    root = tree(tmp_path, a_dot_txt="word " * 500, sub__b_dot_md="# Title", c_dot_HTML="<html><script>x</script><p>shown</p></html>", x_dot_bin=b"\0")
    r = files.check_folder(spark, root)
    assert r.outcome == "passed" and r.counts["files_audited"] == 3 and r.counts["unsupported_files"] == 1
    assert "unsupported_file_types" in r.unverified
    units = files.read_units(files.list_tree(spark, root).files())
    chunks = files.unit_chunks(units)
    assert [(r.document_id, r.text[:4]) for r in chunks.orderBy("chunk_index").collect()] == [("a.txt", "word"), ("a.txt", "word"), ("c.HTML", "show"), ("sub/b.md", "# Ti")]
    assert rows(chunks, "document_id", "chunk_key") == [("a.txt", '["a.txt","file",0]'), ("a.txt", '["a.txt","file",1]'), ("c.HTML", '["c.HTML","file",0]'), ("sub/b.md", '["sub/b.md","file",0]')]
    assert units.where("source = 'c.HTML'").first().text.strip() == "shown"


def test_outcomes(spark, rows, tmp_path):
    assert files.check_folder(spark, tree(tmp_path / "none", y_dot_bin=b"1")).outcome == "no_supported_files"
    bad = files.check_folder(spark, tree(tmp_path / "bad", a_dot_txt=b"\xff\xfe\xff", b_dot_txt="fine text"))
    assert bad.outcome == "incomplete" and bad.counts["files_audited"] == 1
    assert rows(bad.findings.where("code = 'source_read_failed'"), "document_id", "message") == [("a.txt", "invalid_utf8: UnicodeDecodeError")]
    if not files.readers_available()[".pdf"]:
        pdf = files.check_folder(spark, tree(tmp_path / "pdf", a_dot_pdf=b"%PDF"))
        assert pdf.outcome == "reader_unavailable"
    listed = tree(tmp_path / "want", a_dot_txt="some text")
    (tmp_path / "list.txt").write_text("a.txt\n\nb.txt\n")
    want = files.check_folder(spark, listed, str(tmp_path / "list.txt"))
    assert want.outcome == "audit_failed" and want.counts["missing_expected_files"] == 1
    (tmp_path / "want" / "l.txt").symlink_to(tmp_path / "list.txt")
    linked = files.check_folder(spark, listed, str(tmp_path / "list.txt"))
    assert linked.outcome == "incomplete" and "expected_file_absence" in linked.unverified
    for text in ("../x.txt", "a.txt\na.txt", "x.exe", "", "/a.txt"):
        (tmp_path / "bad.txt").write_text(text)
        with pytest.raises(ValueError):
            files.expected_files(spark, str(tmp_path / "bad.txt"))


def test_manifest(spark, rows):
    s = "source string, sha256 string, pages int"
    a = spark.createDataFrame([("a", "1", 2), ("b", "1", 2), ("c", "1", 2)], s)
    b = spark.createDataFrame([("a", "1", 2), ("b", "2", 3), ("d", "1", 2)], s)
    assert rows(files.check_manifest(a, b)) == [("b", "wrong_hash"), ("b", "wrong_page_count"), ("c", "missing_file"), ("d", "unlisted_file")]


def test_units():
    assert records.as_units([2, "a", 1]) == ["a", "page:1", "page:2"]
    assert records.as_units([1, "1"]) == ["1", "page:1"]
    for bad in ([1, "page:1"], [0], [True], ["a", "a"], [" "], "1", None, [1.5]):
        with pytest.raises(ValueError):
            records.as_units(bad)


def export(tmp_path, *lines):
    p = tmp_path / "export.jsonl"
    p.write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines))
    return str(p)


def codes(df):
    return {r.code: r["count"] for r in df.groupBy("code").count().collect()}


HASH = "a" * 64
MARK = {"algorithm": "sha256", "basis": "file_bytes", "value": HASH}


def test_index_against_sources(spark, tmp_path):
    s = spark.createDataFrame([("a.txt", "b" * 64, ["file"]), ("b.md", HASH, ["file"])], "source string, hash string, units array<string>")
    r = records.read_export(spark, export(tmp_path, {"id": "1", "source_id": "a.txt", "text": " ", "units": ["file"], "source_fingerprint": MARK}, "", {"id": "2", "source_id": "gone.txt", "text": "x", "units": ["file"]}))
    a = audit_index(r, s, True, True, True, True)
    assert codes(a.findings) == {"source_not_indexed": 1, "indexed_source_orphan": 1, "source_hash_mismatch": 1, "empty_indexed_text": 1, "missing_indexed_unit": 2}
    assert "source_absence" not in a.unverified and "source_version_comparison" in a.unverified
    assert "source_absence" in audit_index(r, s).unverified


def test_broken_exports(spark, tmp_path):
    one = {"id": "1", "source_id": "a.txt", "source_fingerprint": MARK}
    r = records.read_export(spark, export(tmp_path, one, one, {**one, "source_fingerprint": {**MARK, "value": "c" * 64}}, {}, {"id": "2", "source_id": "../x"}, '{"id":"3","id":"4"}', "not json", '{"id":"5","x":NaN}', '{"id":"6","x":1e999}', '{"id":"7"} trailing'))
    s = spark.createDataFrame([], "source string, hash string, units array<string>")
    assert codes(audit_index(r, s).findings) == {"duplicate_index_record": 1, "conflicting_index_record": 1, "conflicting_source_versions": 1, "malformed_index_record": 7}
    assert [x.line for x in r.where("error is not null").orderBy("line").collect()] == [4, 5, 6, 7, 8, 9, 10]


def test_command_line(spark, tmp_path, capsys):
    good = tmp_path / "good.json"
    good.write_text(json.dumps([{"text": "a text", "metadata": {"source": "s"}}]))
    assert cli.main([str(good)]) == 0
    assert capsys.readouterr().out.startswith("PASS")
    lines = tmp_path / "bad.jsonl"
    lines.write_text('{"text": "a", "metadata": {}}\n\nnope\n')
    assert cli.main(["chunks", str(lines), "--json", "--details", "9"]) == 1
    said = json.loads(capsys.readouterr().out)
    assert {f["code"] for f in said["findings"]} == {"missing_metadata", "invalid_record"}
    assert [(f["chunk_index"], f["code"]) for f in said["details"]] == [(0, "missing_metadata"), (2, "invalid_record")]
    assert cli.main(["chunks", str(tmp_path / "absent.json")]) != 0
    batch = tmp_path / "batch.json"
    batch.write_text(
        json.dumps(
            {
                "namespace": "n", "pipeline_id": "p", "embedding_model": "m",
                "documents": [{"document_id": "d", "source_version": "v", "expected_pages": [1]}],
                "receipts": [{"document_id": "d", "source_version": "v", "processed_pages": [1], "completed": True}],
                "chunks": [{"text": "t", "chunk_key": "k", "metadata": {"document_id": "d", "source_version": "v", "pages": [1], "source": "s"}}],
            }
        )
    )
    assert cli.main(["ingestion", str(batch), "--snapshot", f"file://{tmp_path}/snap"]) == 0
    capsys.readouterr()
    assert cli.main(["plan", "none", f"file://{tmp_path}/snap"]) == 0
    assert json.loads(capsys.readouterr().out)["planned_embeddings"] == 1
    vectors = tmp_path / "v.json"
    vectors.write_text(json.dumps({"expected_chunk_ids": ["a"], "dimensions": 2, "embeddings": [{"chunk_id": "a", "vector": [1]}]}))
    assert cli.main(["embeddings", str(vectors)]) == 1
    assert cli.main(["ledger", "summary", f"file://{tmp_path}/ledger"]) == 0
    root = tree(tmp_path / "src", a_dot_txt="some text")
    assert cli.main(["check", root]) == 0
    assert cli.main(["existing-index", root, export(tmp_path, {"id": "1", "source_id": "a.txt", "text": "x"}), "--export-complete"]) == 0


def test_stream(spark, tmp_path):
    schema = "chunk_index bigint, text string"
    for n in range(3):
        spark.createDataFrame([(n * 2, "same"), (n * 2 + 1, "same" if n else "other")], schema).coalesce(1).write.mode("append").json(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(f"{tmp_path}/in")
    for _ in range(2):  # started again, there is nothing left to do
        q = audit_stream(stream, f"file://{tmp_path}/out", f"{tmp_path}/checkpoint")
        q.awaitTermination(120)
    f = stream_findings(spark, f"file://{tmp_path}/out")
    assert f.select("batch").distinct().count() == 3
    assert f.where("code = 'missing_metadata'").count() == 6


def test_catalogue_is_what_is_emitted():
    """Every code in the sources is in the catalogue and the other way round."""
    import re
    from pathlib import Path

    root = Path(findings.__file__).parent
    said = "".join(p.read_text() for p in root.rglob("*.py") if p.name != "findings.py" and "queries" not in p.parts)
    # A code counts where it stands as the first argument of finding() or repeated(), or is chosen there.
    calls = re.findall(r'(?:finding|_as_units|repeated)\((?:\w+, )?(?:_as_units\()?"([a-z]+(?:_[a-z]+)+)"', said)
    quoted = set(calls) | set(re.findall(r'"((?:duplicate|conflicting)_index_record)"', said))
    quoted |= {c.replace("pages", "units").replace("page", "unit") for c in quoted if "page" in c}
    assert set(findings.SEVERITY) <= quoted
    assert len(findings.SEVERITY) == 80
    with pytest.raises(KeyError):
        findings.finding("no_such_code")


def test_converters(spark, rows):
    df = spark.createDataFrame([(3, "t", {"document_id": "d", "x": "1"})], "n int, page_content string, metadata map<string,string>")
    assert rows(records.from_columns(df, "n"), "chunk_index", "text", "document_id", "chunk_key") == [(3, "t", "d", None)]
    body = spark.createDataFrame([("<p>a</p><style>b</style> c",), (None,)], "h string")
    assert [r[0] for r in body.select(files.html_body(F.col("h"))).collect()] == ["a  c", None]


@pytest.mark.parametrize(
    "page, text",
    [
        ("<!doctype html><p>a &lt; b &amp; c</p>", "a < b & c"), ("<!-- <p>no</p> -->yes", "yes"), ("<script>if (a<b) '</p>'</script>x", "x"), ("<SCRIPT>1</SCRIPT >x<style>y", "x"),
        ("a<template>b<template>c</template>d</template>e", "a e"), ('<a title="1 > 0">t</a>', "t"), ("1 < 2 and 3 > 2", "1 < 2 and 3 > 2"), ("", ""), ("<br/>a<br>b", "a b"), ("a<!-- open", "a"),
    ],
)
def test_html(page, text):
    assert files.html_text(page) == text


def zipped(path, **parts):
    with zipfile.ZipFile(path, "w") as z:
        for name, xml in parts.items():
            z.writestr(name.replace("__", "/").replace("_dot_", "."), xml)


def test_office_files(spark, rows, tmp_path):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    cell = lambda t: f"<w:tc>{p(t)}</w:tc>"
    table = f"<w:tbl><w:tr>{cell('r1c1')}{cell('r1c2')}</w:tr><w:tr>{cell('r2c1')}{cell('r2c2')}</w:tr></w:tbl>"
    zipped(tmp_path / "a.docx", word__document_dot_xml=f"<w:document {w}><w:body>{p('before')}{table}<w:p><w:r><w:t>af</w:t><w:tab/><w:t>ter</w:t></w:r></w:p></w:body></w:document>")
    a, r, q = ('xmlns:%s="http://schemas.openxmlformats.org/%s"' % x for x in (("a", "drawingml/2006/main"), ("r", "officeDocument/2006/relationships"), ("p", "presentationml/2006/main")))
    t = lambda x: f"<a:p><a:r><a:t>{x}</a:t></a:r></a:p>"
    slide = lambda body: f"<p:sld {a} {q}><p:cSld><p:spTree>{body}</p:spTree></p:cSld></p:sld>"
    zipped(
        tmp_path / "b.pptx",
        ppt__presentation_dot_xml=f'<p:presentation {q} {r}><p:sldIdLst><p:sldId id="9" r:id="r2"/><p:sldId id="8" r:id="r1"/></p:sldIdLst></p:presentation>',
        ppt___rels__presentation_dot_xml_dot_rels='<Relationships xmlns="x"><Relationship Id="r1" Target="slides/slide1.xml"/><Relationship Id="r2" Target="/ppt/slides/slide2.xml"/></Relationships>',
        ppt__slides__slide1_dot_xml=slide(f"<p:grpSp><p:sp><p:txBody>{t('inner')}{t('two')}</p:txBody></p:sp></p:grpSp>"),
        ppt__slides__slide2_dot_xml=slide(f"<p:graphicFrame><a:tbl><a:tr><a:tc><a:txBody>{t('cell')}</a:txBody></a:tc></a:tr></a:tbl></p:graphicFrame>"),
    )
    (tmp_path / "c.docx").write_bytes(b"no archive")
    units = files.read_units(files.list_tree(spark, str(tmp_path)).files())
    assert rows(units, "source", "unit", "text", "reason", "error") == [
        ("a.docx", "body", "before\nr1c1\nr1c2\nr2c1\nr2c2\naf\tter", None, None), ("b.pptx", "slide:1", "cell", None, None), ("b.pptx", "slide:2", "inner\ntwo", None, None), ("c.docx", None, None, "unknown_read_error", "BadZipFile"),
    ]


def test_reasons():
    class PdfReadError(Exception):
        pass

    assert [files.read_failure(".pdf", e) for e in (ModuleNotFoundError(), PdfReadError(), PermissionError(), files.SourceChangedError(), ValueError())] == [
        "reader_unavailable", "invalid_pdf", "permission_denied", "source_changed", "unknown_read_error",
    ]
    assert files.read_failure(".docx", PdfReadError()) == "unknown_read_error"
    assert {r for _, _, r in files.REASONS} == {"reader_unavailable", "invalid_utf8", "empty_file", "encrypted_pdf", "invalid_pdf", "permission_denied", "source_changed", "unknown_read_error"}


def test_existing_index_fails_on_unreadable_sources(spark, tmp_path, capsys):
    root = tree(tmp_path / "src", a_dot_txt="some text", bad_dot_txt=b"\xff")
    path = export(tmp_path, {"id": "1", "source_id": "a.txt", "text": "x"})
    a = audit_existing_index(spark, root, path, True, True, True)
    assert codes(a.findings) == {"source_read_failed": 1} and "source_absence" in a.unverified
    assert cli.main(["existing-index", root, path, "--export-complete", "--json"]) == 1
    assert json.loads(capsys.readouterr().out)["passed"] is False
    (tmp_path / "src" / "bad.txt").unlink()
    (tmp_path / "src" / "l.txt").symlink_to(tmp_path / "src" / "a.txt")
    assert codes(audit_existing_index(spark, root, path, True).findings) == {"source_path_excluded": 1}
    assert codes(audit_existing_index(spark, root, str(tmp_path / "absent"), True).findings) == {"source_path_excluded": 1, "index_export_read_failed": 1}
    (tmp_path / "raw.jsonl").write_bytes(b'{"id": "1"}\n{"id": "\xff"}\n')
    assert codes(audit_existing_index(spark, root, str(tmp_path / "raw.jsonl")).findings)["index_export_read_failed"] == 1
    failed = spark.createDataFrame([("p.pdf", "v", "page:1", 0, None, True, False, None, None)], files.READ)
    assert rows_of(source_findings(files.Tree(spark.createDataFrame([], files.ENTRIES)), failed)) == [("source_extraction_failed", "p.pdf", "page:1")]


def rows_of(df):
    return [(r.code, r.document_id, r.message) for r in df.collect()]


def test_lines_and_arrays(spark, rows, tmp_path):
    (tmp_path / "b.jsonl").write_text('{"text": "a"}\r\n\x85{"text": "b"}\u2028\n \n{"text": "c"}', encoding="utf-8")
    got = rows(records.read_chunks_jsonl(spark, str(tmp_path / "b.jsonl")), "chunk_index", "text")
    assert [t for _, t in got] == ["a", "b", "c"] and sorted(i for i, _ in got) == [i for i, _ in got]
    (tmp_path / "a.json").write_text('\n [{"text": "x", "metadata": {"pages": [2]}}, 5,\n {"text": null}]')
    assert rows(records.read_chunks_json(spark, str(tmp_path / "a.json")), "chunk_index", "text", "is_record", "is_text", "units") == [(0, "x", True, True, ["page:2"]), (1, None, False, True, None), (2, None, True, False, None)]
    (tmp_path / "o.json").write_text('{"a": 1}')
    with pytest.raises(ValueError):
        records.read_chunks_json(spark, str(tmp_path / "o.json"))
    (tmp_path / "e.json").write_text("[]")
    assert records.read_chunks_json(spark, str(tmp_path / "e.json")).count() == 0
