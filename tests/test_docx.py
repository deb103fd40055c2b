import hashlib
import io
import os
import zipfile

import pytest

from quarrystone.sources import docx as D

SPACES = " ".join(
    f'xmlns:{k}="{v}"'
    for k, v in {
        "w": "http://schemas.openxmlformats.org/wordprocessingml/2006/main",
        "m": "http://schemas.openxmlformats.org/officeDocument/2006/math",
        "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships",
        "a": "http://schemas.openxmlformats.org/drawingml/2006/main",
        "wp": "http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing",
        "v": "urn:schemas-microsoft-com:vml",
    }.items()
)
p = "<w:p><w:r><w:t>{}</w:t></w:r></w:p>".format
row = "<w:tr>{}</w:tr>".format
cell = "<w:tc>{}</w:tc>".format
table = "<w:tbl>{}</w:tbl>".format
drawing = '<w:drawing><wp:docPr name="{1}" descr="{2}"/><a:blip r:embed="{0}"/></w:drawing>'.format
RELATIONS = '<Relationships><Relationship Id="one" Target="media/a.png"/><Relationship Id="two" Target="/word/media/b"/><Relationship Id="gone" Target="media/none.png"/><Relationship Id="up" Target="../other/c.jpeg"/></Relationships>'


def packed(body, relations=RELATIONS, **media):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {SPACES}><w:body>{body}</w:body></w:document>")
        if relations:
            z.writestr("word/_rels/document.xml.rels", relations)
        for name, content in {"word/media/a.png": b"A", "word/media/b": b"B", "other/c.jpeg": b"C", **media}.items():
            z.writestr(name, content)
    return out.getvalue()


@pytest.mark.parametrize(
    "body, wanted",
    [
        (p("one") + p("") + p(" two\xa0") + p(" "), ["one", "two"]),
        ("<w:p><w:r><w:t>a</w:t><w:tab/><w:t>b</w:t><w:br/><w:t> c </w:t></w:r></w:p>", ["a\tb\nc"]),
        ("<w:p><w:r><w:t>a</w:t><w:br/><w:br/><w:cr/><w:br/><w:t>b</w:t></w:r></w:p>", ["a\n\nb"]),
        ("<w:p><w:del><w:r><w:delText>old</w:delText></w:r></w:del><w:r><w:instrText>PAGE</w:instrText></w:r></w:p>", ["oldPAGE"]),
        (table(row(cell(p("a")) + cell(p("b"))) + row(cell(p("")) + cell(p("c"))) + row(cell(""))), ["a | b\nc"]),
        (table(row(cell(p("a") + table(row(cell(p("x")) + cell(p("y"))) + row(cell(p("z")))) + p("b")) + cell(p("c")))), ["a\nx | y\nz\nb | c"]),
        (table(row("<w:sdt>no cell</w:sdt>" + cell("<w:sdt><w:sdtContent>" + p("in") + "</w:sdtContent></w:sdt>"))), ["in"]),
        ("<w:sdt><w:sdtContent>" + p("a") + p("b") + "</w:sdtContent></w:sdt>", ["ab"]),
        ("<w:p><w:r><w:t>so </w:t></w:r><m:oMath><m:sSup><m:e><m:r><m:t>x</m:t></m:r></m:e><m:sup><m:r><m:t>2</m:t></m:r></m:sup></m:sSup></m:oMath></w:p>", ["so ${x}^{2}$"]),
        ("<w:p><m:oMathPara><m:oMath><m:r><m:t>a</m:t></m:r></m:oMath><m:oMath><m:r><m:t>b</m:t></m:r></m:oMath></m:oMathPara></w:p>", ["$$a$$\n$$b$$"]),
        ('<w:p><w:r><w:t>by</w:t><w:object><v:shape alt="x"/></w:object></w:r></w:p>', ["by 【公式对象】"]),
        ("", []),
    ],
)
def test_blocks(body, wanted):
    assert D.opened(packed(body))[0] == wanted


def test_pictures():
    body = (
        f"<w:p>{drawing('two', 'n', 'd')}</w:p>"
        + table(row(cell(f"<w:p>{drawing('one', '', '')}</w:p>") + cell(p("t") + f"<w:p>{drawing('two', 'again', '')}</w:p>")))
        + f"<w:p>{drawing('gone', '', '')}{drawing('nowhere', '', '')}<w:drawing/></w:p>"
        + '<w:p><w:pict><v:imagedata r:id="up"/></w:pict></w:p>'
    )
    blocks, pictures = D.opened(packed(body))
    assert blocks == ["[[asset:image-001]]", "[[asset:image-002]] | t\n[[asset:image-001]]", "[[asset:image-003]]"]
    assert [(x.filename, x.content_type, x.title, x.description, x.content) for x in pictures] == [
        ("image-001.bin", "application/octet-stream", "n", "d", b"B"),
        ("image-002.png", "image/png", None, None, b"A"),
        ("image-003.jpeg", "image/jpeg", None, None, b"C"),
    ]
    assert D.opened(packed(body, relations=None)) == (["t"], [])
    assert D.opened(packed(body, relations="<no")) == (["t"], [])


def test_files(spark, tmp_path):
    (tmp_path / "x.docx").write_bytes(packed(p("one") + p("two")))
    (tmp_path / "y.docx").write_bytes(b"no zip")
    (tmp_path / "z.docx").write_bytes(packed(""))
    rows = sorted(D.read_docx(spark, str(tmp_path / "*.docx")).collect(), key=lambda r: (r.path, r.block_no or 0))
    assert [(r.path[-6:], r.block_no, r.text, r.error) for r in rows] == [("x.docx", 0, "one", None), ("x.docx", 1, "two", None), ("y.docx", None, None, "BadZipFile")]


def test_odd_files(spark):
    files = spark.createDataFrame([("a", None, 1), ("b", bytearray(packed("<w:p>").replace(b"body", b"b0dy")), 2)], "path string, content binary, error int")
    assert [(r.path, r.blocks, r.assets, bool(r.error)) for r in D.parsed(files).orderBy("path").collect()] == [("a", [], [], True), ("b", [], [], True)]
    assert D.blocks(D.parsed(files.limit(0))).count() == 0 == D.assets(D.parsed(files)).count()


def test_assets_written_twice(spark, tmp_path):
    """Attempts that run twice leave one file for each content and the same manifest; drafts do not stay."""
    body = f"<w:p>{drawing('one', '', '')}{drawing('two', '', '')}</w:p>"
    files = spark.createDataFrame([(f"{i}", bytearray(packed(body, **{"word/media/b": b"%d" % (i % 3)}))) for i in range(8)], "path string, content binary").repartition(4)
    found = D.assets(D.parsed(files))
    folder = str(tmp_path / "assets")
    first, again = (sorted(map(tuple, D.write_assets(found, folder).collect())) for _ in range(2))
    assert first == again and len(first) == 16
    made = {f"{hashlib.sha256(c).hexdigest()}{s}" for c, s in ((b"A", ".png"), (b"0", ".bin"), (b"1", ".bin"), (b"2", ".bin"))}
    assert set(os.listdir(folder)) == made == {os.path.basename(r[-2]) for r in first}
    empty = spark.createDataFrame([("p", "x.png", None)], "storage_path string, filename string, content binary")
    assert [tuple(r) for r in D.write_assets(empty, folder).collect()] == [("x.png", None, None)]
