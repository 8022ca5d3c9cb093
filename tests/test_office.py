"""Spreadsheets and Word files that the tests write themselves, and broken ones."""

import io
import zipfile

from siltstone.sources import office

MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
WORD = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def packed(path, parts):
    with zipfile.ZipFile(path, "w") as z:
        for name, text in parts.items():
            z.writestr(name, '<?xml version="1.0" encoding="UTF-8"?>' + text)


def workbook(path, sheets, shared=()):
    names = "".join(f'<sheet name="{n}" sheetId="{i + 1}" r:id="rId{i + 1}"/>' for i, n in enumerate(sheets))
    links = "".join(f'<Relationship Id="rId{i + 1}" Target="{"/xl/" if i else ""}worksheets/sheet{i + 1}.xml"/>' for i in range(len(sheets)))
    parts = {"xl/workbook.xml": f"<workbook {MAIN}><sheets>{names}</sheets></workbook>", "xl/_rels/workbook.xml.rels": f"<Relationships>{links}</Relationships>"}
    parts |= {f"xl/worksheets/sheet{i + 1}.xml": f"<worksheet {MAIN}><sheetData>{rows}</sheetData><mergeCells><mergeCell ref='A4:B4'/></mergeCells></worksheet>" for i, rows in enumerate(sheets.values())}
    if shared:
        parts["xl/sharedStrings.xml"] = f"<sst {MAIN}>" + "".join(f"<si>{s}</si>" for s in shared) + "</sst>"
    packed(path, parts)


def test_spreadsheets(spark, tmp_path):
    rows = """<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row>
      <row r="3"><c r="B3"><v>12.5</v></c><c r="AA3" t="b"><v>1</v></c><c r="AB3"><v>0</v></c></row>
      <row r="4"><c r="A4" t="inlineStr"><is><t>merged</t></is></c><c r="B4"/><c r="C4" t="str"><v>a&amp;b</v></c></row>
      <row><c><v>7</v></c><c t="inlineStr"><is><t>next</t></is></c></row><row r="9"><c r="A9"/></row>"""
    workbook(tmp_path / "a.xlsx", {"One": rows, "Two &amp; last": '<row r="2"><c r="A2" t="s"><v>1</v></c></row>'}, ["<t>who</t>", "<r><t>rich </t></r><r><t>text</t></r>"])
    workbook(tmp_path / "empty.xlsx", {"S": ""})
    (tmp_path / "broken.xlsx").write_bytes(b"no archive")
    packed(tmp_path / "odd.xlsx", {"xl/workbook.xml": "<workbook"})
    found = office.spreadsheet_rows(spark, f"{tmp_path}/*.xlsx").collect()
    good = {(r["sheet"], r["row"]): r["cells"] for r in found if r["error"] is None}
    assert good[("One", 1)] == ["who", "rich text"] and good[("One", 3)] == [None, "12.5", *[None] * 24, "True", "0"]
    assert good[("One", 4)] == ["merged", None, "a&b"] and good[("One", 5)] == ["7", "next"] and good[("Two & last", 2)] == ["rich text"] and len(good) == 5
    assert sorted(r["path"].rsplit("/", 1)[1] for r in found if r["error"]) == ["broken.xlsx", "odd.xlsx"]
    pairs = {tuple(r) for r in office.spreadsheets(spark, f"{tmp_path}/*.xlsx").collect()}
    assert pairs == {("who", "rich text"), ("12.5", "True"), ("merged", "a&b"), ("7", "next")}


def paragraph(text, style=""):
    return f'<w:p>{f"""<w:pPr><w:pStyle w:val="{style}"/></w:pPr>""" if style else ""}<w:r><w:t>{text}</w:t></w:r></w:p>'


def test_word_documents(spark, tmp_path):
    styles = "".join(f'<w:style w:styleId="{i}"><w:name w:val="{n}"/></w:style>' for i, n in (("H1", "heading 1"), ("Kop2", "Heading 2"), ("Title", "Title")))
    body = paragraph("Part", "H1") + paragraph("Asked", "Kop2") + "<w:p><w:r><w:t>one</w:t><w:tab/><w:t>two</w:t><w:br/></w:r><w:r><w:t>three</w:t></w:r></w:p>"
    body += f"<w:tbl><w:tr><w:tc>{paragraph('x')}</w:tc><w:tc>{paragraph('y')}{paragraph('z')}</w:tc></w:tr></w:tbl>" + paragraph("Other", "H1") + paragraph("last", "Title")
    packed(tmp_path / "a.docx", {"word/styles.xml": f"<w:styles {WORD}>{styles}</w:styles>", "word/document.xml": f"<w:document {WORD}><w:body>{body}<w:sectPr/></w:body></w:document>"})
    packed(tmp_path / "none.docx", {"other.xml": "<a/>"})
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        z.writestr("word/document.xml", "<w:document>")
    (tmp_path / "bad.docx").write_bytes(held.getvalue())
    parts = office.document_parts(spark, f"{tmp_path}/*.docx").collect()
    assert [(r["kind"], r["level"], r["text"]) for r in sorted((r for r in parts if r["error"] is None), key=lambda r: r["n"])] == [
        ("paragraph", 1, "Part"), ("paragraph", 2, "Asked"), ("paragraph", 0, "one\ttwo\nthree"), ("row", 0, "x | y\nz"), ("paragraph", 1, "Other"), ("paragraph", 0, "last"),
    ]
    assert sum(r["error"] is not None for r in parts) == 2
    assert {r["question"]: r["answer"].strip() for r in office.word_documents(spark, f"{tmp_path}/*.docx").collect()} == {"Part\nAsked": "one\ttwo\nthree", "Other": "last"}
