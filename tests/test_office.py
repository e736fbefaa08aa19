import zipfile
from xml.sax.saxutils import escape

from docloom.sources import office

W, S, R = (x[1:-1] for x in (office._W, office._S, office._R))


def write_docx(path, paragraphs):
    body = ""
    for style, runs in paragraphs:
        p = f'<w:pPr><w:pStyle w:val="{style}"/></w:pPr>' if style else ""
        body += f"<w:p>{p}" + "".join(f'<w:r><w:t xml:space="preserve">{escape(r)}</w:t></w:r>' if r != "\n" else "<w:r><w:br/></w:r>" for r in runs) + "</w:p>"
    table = "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>in a cell</w:t></w:r></w:p></w:tc></w:tr></w:tbl>"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("word/document.xml", f'<?xml version="1.0"?><w:document xmlns:w="{W}"><w:body>{body}{table}</w:body></w:document>')


def test_docx(spark, tmp_path):
    write_docx(tmp_path / "a.docx", [("Heading1", ["A ", "title"]), (None, [""]), ("ListBullet", ["item & more"]), *[(None, [f"text {i}", "\n", "é漢"]) for i in range(40)]])
    write_docx(tmp_path / "empty.docx", [])
    (tmp_path / "broken.docx").write_bytes(b"no zip archive")
    with zipfile.ZipFile(tmp_path / "other.docx", "w") as z:
        z.writestr("x", "y")
    with zipfile.ZipFile(tmp_path / "cut.docx", "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{W}"><w:body><w:p><w:r><w:t>before</w:t></w:r></w:p><w:p>')
    rows = office.docx(spark, str(tmp_path)).collect()
    by = {}
    for r in rows:
        by.setdefault(r.file.rsplit("/", 1)[-1], []).append(r)
    a = by["a.docx"]
    assert [(r.element_index, r.page_number, r.element_type, r.text) for r in a[:3]] == [(0, 1, "Title", "A title"), (2, 1, "ListItem", "item & more"), (3, 1, "NarrativeText", "text 0\né漢")]
    assert [r.page_number for r in a if r.element_index in (19, 20, 40)] == [1, 2, 3] and a[-1].text == "in a cell" and len(a) == 43
    assert [r.text for r in by["empty.docx"]] == ["in a cell"]
    assert [r.text for r in by["cut.docx"]] == ["before", None] and "ParseError" in by["cut.docx"][1].error
    assert "BadZipFile" in by["broken.docx"][0].error and "KeyError" in by["other.docx"][0].error


def write_xlsx(path, sheets, shared):
    with zipfile.ZipFile(path, "w") as z:
        names = "".join(f'<sheet name="{escape(n)}" sheetId="{i}" r:id="rId{i}"/>' for i, (n, _) in enumerate(sheets, 1))
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{S}" xmlns:r="{R}"><sheets>{names}</sheets></workbook>')
        rels = "".join(f'<Relationship Id="rId{i}" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1))
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{rels}</Relationships>')
        if shared:
            z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{S}">' + "".join(f"<si><t>{escape(x)}</t></si>" for x in shared) + "</sst>")
        for i, (_, data) in enumerate(sheets, 1):
            z.writestr(f"xl/worksheets/sheet{i}.xml", f'<worksheet xmlns="{S}"><sheetData>{data}</sheetData></worksheet>')


def test_xlsx(spark, tmp_path):
    data = (
        '<row r="2"><c r="A2" t="s"><v>0</v></c><c r="B2" t="s"><v>1</v></c><c r="D2" t="s"><v>0</v></c></row>'
        '<row r="3"><c r="A3" t="s"><v>2</v></c><c r="B3"><v>1.5</v></c><c r="C3" t="b"><v>1</v></c><c r="D3" t="inlineStr"><is><t>in </t><t>line</t></is></c></row>'
        '<row r="4"/><row r="5"><c r="B5"><v>7</v></c><c r="AA5" t="str"><v>far</v></c></row>'
    )
    write_xlsx(tmp_path / "t.xlsx", [("Truth", data), ("None & less", "")], ["country", "score", "Chad <x>"])
    (tmp_path / "broken.xlsx").write_bytes(b"PK\x03\x04")
    rows = office.xlsx(spark, str(tmp_path)).collect()
    fine = sorted((r.sheet, r.row_number, r.cells) for r in rows if r.error is None)
    assert fine == [("Truth", 3, {"country": "Chad <x>", "score": "1.5", "C": "TRUE", "country D": "in line"}), ("Truth", 5, {"score": "7", "AA": "far"})]
    assert [r.cells for r in rows if r.error] == [None]
