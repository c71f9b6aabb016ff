"""Archives and workbooks: what is read, and what is refused."""

import io
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from dossier.sources import packages, sheets


def zipped(parts, compress=zipfile.ZIP_DEFLATED):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", compress) as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def listed(data):
    return packages.directory(lambda at, n: data[at : at + n], len(data))


def test_directories_are_checked():
    good = zipped({"a.txt": "hello", "ü/b.txt": "x" * 1000, "d/": ""})
    assert [(e.name, e.size) for e in listed(good)] == [("a.txt", 5), ("ü/b.txt", 1000), ("d/", 0)] and listed(b"junk before" * 0 + good)
    for bad, why in ((b"", "no end"), (good[:-30], "no end"), (b"PK\5\6" + b"\0" * 4 + struct.pack("<HHLLH", 1, 1, 46, 5, 0), "outside"), (good[40:], "outside|local|cut"), (good.replace(b"PK\3\4", b"PK\3\5"), "local")):
        with pytest.raises(packages.Damaged, match=why):
            listed(bad)
    # Two names for one stretch of the file.
    at = good.rindex(b"PK\1\2", 0, good.rindex(b"PK\1\2"))
    shared = bytearray(good)
    shared[at + 42 : at + 46] = struct.pack("<L", 0)
    with pytest.raises(packages.Damaged, match="share"):
        listed(bytes(shared))
    with pytest.raises(packages.Damaged, match="over 2"):
        packages.directory(lambda at, n: good[at : at + n], len(good), most=2)


def test_totals_never_overflow():
    most = packages.Entry("a", (1 << 64) - 1, 0)
    assert packages.total([most]) == (1 << 64) - 1 and packages.total([most, packages.Entry("b", 1, 0)]) is None


def test_large_archives_by_zip64():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z, z.open("big", "w", force_zip64=True) as f:
        f.write(b"abc")
    assert [(e.name, e.size) for e in listed(out.getvalue())] == [("big", 3)]
    assert len(listed(zipped({str(n): "" for n in range(66_000)}))) == 66_000


def book(sheet, styles="", shared="", props=""):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    rel = lambda i, kind, target: f'<Relationship Id="{i}" Type="http://x/{kind}" Target="{target}"/>'
    return zipped(
        {
            "_rels/.rels": f"<Relationships>{rel('r1', 'officeDocument', 'xl/workbook.xml')}</Relationships>",
            "xl/workbook.xml": f'<workbook {ns}>{props}<sheets><sheet name="First" r:id="r9"/><sheet name="Gone" r:id="r7"/></sheets></workbook>',
            "xl/_rels/workbook.xml.rels": f"<Relationships>{rel('r9', 'worksheet', '/xl/worksheets/other.xml')}{rel('r2', 'styles', 'styles.xml')}{rel('r3', 'sharedStrings', 'sharedStrings.xml')}</Relationships>",
            "xl/worksheets/other.xml": f"<worksheet {ns}><sheetData>{sheet}</sheetData></worksheet>",
            "xl/styles.xml": f"<styleSheet {ns}>{styles}</styleSheet>",
            "xl/sharedStrings.xml": f"<sst {ns}>{shared}</sst>",
        }
    )


STYLES = '<numFmts><numFmt numFmtId="170" formatCode="yyyy\\-mm\\-dd hh:mm"/><numFmt numFmtId="171" formatCode="0.0%"/><numFmt numFmtId="172" formatCode="&quot;day&quot; 0"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/><xf numFmtId="171"/><xf numFmtId="172"/></cellXfs>'


def test_sheets_by_relationship_with_dates_and_formats():
    shared = "<si><t>plain</t></si><si><r><t>in </t></r><r><t>runs</t></r><rPh><t>said</t></rPh></si>"
    rows = '<row r="2"><c r="A2" t="s"><v>0</v></c><c r="C2" t="s"><v>1</v></c><c t="inlineStr"><is><t>here</t></is></c><c t="b"><v>1</v></c></row><row r="3"/><row r="4"><c r="A4" s="1"><v>45292</v></c><c s="2"><v>45292.5</v></c><c s="3"><v>0.125</v></c><c s="4"><v>7</v></c><c s="1"><v>59</v></c><c t="str"><v>text</v></c><c r="AF4"><v>9</v></c></row><row r="301"><c><v>1</v></c></row>'
    with zipfile.ZipFile(io.BytesIO(book(rows, STYLES, shared))) as archive:
        first, gone = list(sheets.workbook(archive))
    assert [(n, [c.raw for c in cells]) for n, cells in first.rows] == [(2, ["plain", "", "in runs", "here", "1"]), (4, ["45292", "45292.5", "0.125", "7", "59", "text"])]
    assert [c.shown for c in first.rows[1][1]] == ["2024-01-01", "2024-01-01 12:00:00", "12.5%", "7", "1900-02-28", "text"] and first.rows[0][1][4].shown == "TRUE"
    assert first.problem == "first 300 rows" and gone.problem == "its part is missing"
    with zipfile.ZipFile(io.BytesIO(book('<row><c s="1"><v>43830</v></c></row>', STYLES, props='<workbookPr date1904="1"/>'))) as archive:
        assert next(sheets.workbook(archive)).rows[0][1][0].shown == "2024-01-01"
    with zipfile.ZipFile(io.BytesIO(book("<row><c><v>1</v>", STYLES))) as archive:
        assert next(sheets.workbook(archive)).problem == "not well-formed"


def test_folders_as_data_sources(spark, tmp_path):
    spark.dataSource.register(packages.ArchiveEntries)
    spark.dataSource.register(packages.WorkbookRows)
    files = [("a.zip", zipped({"x.txt": "abc", "__MACOSX/y": "1", ".DS_Store": "", "d/z": "12345"})), ("b.zip", b"PK broken"), ("c.zip", zipped({})), ("n.txt", b"no"), ("w.xlsx", book("<row><c><v>5</v></c></row>")), ("v.xlsx", b"broken")]
    files.append(("many.zip", zipped({f"f{i}": "x" for i in range(250)})))
    frame = spark.createDataFrame([(n, bytearray(b)) for n, b in files], "name string, content binary")
    assert packages.write_files(frame, str(tmp_path / "in")) == len(files)
    source = spark.read.format("archive_entries").option("path", str(tmp_path / "in"))
    name = F.regexp_extract("path", "[^/]+$", 0).alias("file")
    found = source.load().select(name, "name", "size", "entries", "total", "problem").collect()
    by = {f: [tuple(r)[1:] for r in found if r.file == f] for f in ("a.zip", "b.zip", "c.zip")}
    assert by == {"a.zip": [("x.txt", 3, 2, 8, None), ("d/z", 5, 2, 8, None)], "b.zip": [(None, None, None, None, "no end of a central directory")], "c.zip": [(None, None, 0, 0, None)]}
    assert sum(r.file == "many.zip" for r in found) == 200 and {r.problem for r in found if r.file == "many.zip"} == {"truncated"}
    assert source.option("bytes", 1).load().rdd.getNumPartitions() == 4 and source.option("bytes", 64 << 20).load().rdd.getNumPartitions() == 1
    rows = spark.read.format("workbook_rows").option("path", str(tmp_path / "in")).load().select(name, "sheet", "row", "cells", "problem").collect()
    assert sorted((r.file, r.sheet, r.cells, (r.problem or "")[:12]) for r in rows if r.file == "w.xlsx") == [("w.xlsx", "First", ["5"], ""), ("w.xlsx", "Gone", None, "its part is ")]
    assert [r.problem[:10] for r in rows if r.file == "v.xlsx"] == ["BadZipFile"]


def test_archives_are_written_part_by_part(spark, tmp_path):
    parts = {"a.zip": [("x", "1" * 500), ("y", "2")], "b.zip": [], "c.zip": None, "d.zip": [("x", "3")]}
    frame = spark.createDataFrame([(n, p, 40 if n == "d.zip" else None) for n, p in parts.items()], "name string, parts array<struct<name:string,text:string>>, bytes int")
    assert packages.write_archives(frame, str(tmp_path / "in")) == 4
    whole = {r["name"]: bytes(r.content) for r in frame.where("parts IS NOT NULL").select("name", packages.zip_of("parts").alias("content")).collect()}
    found = {f.name: f.read_bytes() for f in (tmp_path / "in").iterdir()}
    assert found == {"a.zip": whole["a.zip"], "b.zip": whole["b.zip"], "c.zip": whole["b.zip"], "d.zip": whole["d.zip"][:40]}
    many = spark.range(0, 25_000, 1, 1).select(F.concat("id", F.lit(".zip")).alias("name"), F.array(*[F.struct(F.lit(f"p{k}").alias("name"), F.col("id").cast("string").alias("text")) for k in range(3)]).alias("parts"))
    assert packages.write_archives(many.where("id % 25 = 0"), str(tmp_path / "many")) == 1000  # parts of one archive may come in two batches
    assert listed((tmp_path / "many" / "24975.zip").read_bytes())[2].size == 5
