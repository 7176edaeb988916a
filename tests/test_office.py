"""Office packages built here: segments, write-back, scrubbing and the leak check."""

import io
import zipfile

import pytest

from cloakframe.functions import anonymize as A
from cloakframe.functions.patterns import EMAIL, NAME_RULES
from cloakframe.operators.documents import process_documents
from cloakframe.sources import office, ooxml

REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
RELS = "http://schemas.openxmlformats.org/package/2006/relationships"
WNS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="%s"' % REL


def _zip(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def _rels(*rels):
    return f'<Relationships xmlns="{RELS}">' + "".join(f'<Relationship Id="{i}" Type="{REL}/{t}" Target="{x}"{m}/>' for i, t, x, m in rels) + "</Relationships>"


def _run(text):
    return f'<w:r><w:t xml:space="preserve">{text}</w:t></w:r>'


def docx():
    body = (
        f"<w:p>{_run('Dear Mr Jen')}{_run('nifer Martin')}<w:ins>{_run(' hello')}</w:ins><w:del><w:r><w:delText>Secret Smith</w:delText></w:r></w:del></w:p>"
        f'<w:p><w:hyperlink r:id="rId9">{_run("j.m@firm.local")}</w:hyperlink></w:p>'
        f"<w:tbl><w:tr><w:tc><w:p>{_run('cell')}</w:p></w:tc></w:tr></w:tbl>"
        f"<w:sdt><w:sdtContent><w:p>{_run('Jennifer')}</w:p></w:sdtContent></w:sdt>"
        '<w:sectPr><w:headerReference w:type="default" r:id="rId8"/></w:sectPr>'
    )
    return _zip({
        "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Override PartName="/word/comments.xml" ContentType="x"/></Types>',
        "word/document.xml": f"<w:document {WNS}><w:body>{body}</w:body></w:document>",
        "word/header1.xml": f"<w:hdr {WNS}><w:p>{_run('head')}</w:p></w:hdr>",
        "word/comments.xml": f"<w:comments {WNS}><w:comment><w:p>{_run('by Jennifer Martin')}</w:p></w:comment></w:comments>",
        "word/_rels/document.xml.rels": _rels(("rId9", "hyperlink", "mailto:j.m@firm.local", ' TargetMode="External"'), ("rId8", "header", "header1.xml", ""), ("rId7", "comments", "comments.xml", "")),
        "docProps/core.xml": '<cp:coreProperties xmlns:cp="c" xmlns:dc="d"><dc:creator>Jennifer Martin</dc:creator></cp:coreProperties>',
    })


def xlsx():
    s = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    cells = '<row><c r="A1" t="s"><v>0</v></c><c r="B1"><v>5</v></c><c r="C1" t="s"><f>A1</f><v>0</v></c><c r="D1" t="inlineStr"><is><t>plain</t></is></c></row>'
    return _zip({
        "xl/workbook.xml": f'<workbook {s} xmlns:r="{REL}"><sheets><sheet name="One" r:id="r1"/></sheets></workbook>', "xl/_rels/workbook.xml.rels": _rels(("r1", "worksheet", "worksheets/sheet1.xml", "")),
        "xl/worksheets/sheet1.xml": f"<worksheet {s}><sheetData>{cells.replace('<c r=\"C1\" t=\"s\"><f>A1</f><v>0</v></c>', '')}</sheetData></worksheet>", "xl/sharedStrings.xml": f"<sst {s}><si><t>a.b@firm.local</t></si></sst>",
    })


def pptx():
    ns = f'xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:r="{REL}"'
    body = lambda t: f"<p:txBody><a:p><a:r><a:t>{t}</a:t></a:r></a:p></p:txBody>"
    tree = f'<p:sp>{body("Write to x@y.example")}</p:sp><p:grpSp><p:sp>{body("inner")}</p:sp></p:grpSp><p:pic><p:nvPicPr><p:cNvPr id="1" name="n" descr="x@y.example"/></p:nvPicPr></p:pic>'
    notes = f'<p:sp><p:nvSpPr><p:nvPr><p:ph type="body"/></p:nvPr></p:nvSpPr>{body("note")}</p:sp>'
    return _zip({
        "ppt/presentation.xml": f'<p:presentation {ns}><p:sldIdLst><p:sldId id="1" r:id="r1"/></p:sldIdLst></p:presentation>', "ppt/_rels/presentation.xml.rels": _rels(("r1", "slide", "slides/slide1.xml", "")),
        "ppt/slides/slide1.xml": f"<p:sld {ns}><p:cSld><p:spTree>{tree}</p:spTree></p:cSld></p:sld>", "ppt/slides/_rels/slide1.xml.rels": _rels(("r1", "notesSlide", "../notesSlides/n1.xml", "")),
        "ppt/notesSlides/n1.xml": f"<p:notes {ns}><p:cSld><p:spTree>{notes}</p:spTree></p:cSld></p:notes>",
    })


def test_segments():
    assert [s[:2] for s in ooxml.read_segments(docx(), "docx")] == [("body/p0/r0", "Dear Mr Jen"), ("body/p0/r1", "nifer Martin"), ("body/p0/n0", " hello"), ("body/p1/n0", "j.m@firm.local"), ("table/t0/row0/cell0/p0/r0", "cell"), ("body/sdt0/p0/r0", "Jennifer"), ("hf/s0/header/p0/r0", "head")]
    assert [s[:2] for s in ooxml.read_segments(xlsx(), "xlsx")] == [("sheet=One/A1", "a.b@firm.local"), ("sheet=One/D1", "plain")]
    assert [s[:2] for s in ooxml.read_segments(pptx(), "pptx")] == [("slide0/shape0/p0/r0", "Write to x@y.example"), ("slide0/shape1/group0/p0/r0", "inner"), ("slide0/shape2/alt", "x@y.example"), ("slide0/notes/p0/r0", "note")]
    with pytest.raises(ooxml.UnsupportedFormat):
        ooxml.read_segments(b"", "pdf")


def test_files_end_to_end(spark, tmp_path):
    for name, content in (("a.DOCX", docx()), ("b.xlsx", xlsx()), ("c.pptx", pptx())):
        (tmp_path / name).write_bytes(content)
    (tmp_path / "d.txt").write_text("x")
    every = office.read_files(spark, str(tmp_path))
    assert office.unsupported(every).count() == 1
    clean, quarantine = process_documents(every.where("format is not null"), {"DEFAULT": A.REPLACE}, [EMAIL, *NAME_RULES])
    out = {r.doc_id.rsplit("/", 1)[-1]: bytes(r.content) for r in clean.collect()}
    assert quarantine.count() == 0 and sorted(out) == ["a.DOCX", "b.xlsx", "c.pptx"]
    assert [s[1] for s in ooxml.read_segments(out["a.DOCX"], "docx")] == ["Dear Mr <PERSON>", "", " hello", "<EMAIL_ADDRESS>", "cell", "<PERSON>", "head"]
    with zipfile.ZipFile(io.BytesIO(out["a.DOCX"])) as z:
        every_byte = b"".join(z.read(n) for n in z.namelist())
    assert b"Martin" not in every_byte and b"mailto" not in every_byte and b"Smith" not in every_byte
    assert "a.b@firm.local" not in ooxml.extract_text(out["b.xlsx"], "xlsx") and b"x@y.example" not in out["c.pptx"]
    paths = office.save_files(clean, str(tmp_path / "out")).collect()
    assert len(paths) == 3


def test_leak_keeps_a_file_back(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(docx().replace(b"zz", b"zz"))
    files = office.read_files(spark, str(tmp_path))
    parts = ooxml.Package(docx())
    parts.parts["word/footnotes.xml"] = f"<w:footnotes {WNS}><w:p>{_run('see j.m@firm.local')}</w:p></w:footnotes>".encode()
    (tmp_path / "a.docx").write_bytes(parts.save())
    clean, quarantine = process_documents(files, {"DEFAULT": A.REPLACE}, [EMAIL])
    assert clean.count() == 0 and quarantine.first().leaked_values == 1
