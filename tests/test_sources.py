import io
import zipfile

from pyspark.sql import functions as F

from tessella.functions.chunk import chunk_text
from tessella.operators.index import file_rows
from tessella.sources import files, system

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def packed(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def docx():
    p = lambda t, s="": f'<w:p>{s}<w:r><w:t>{t}</w:t></w:r></w:p>'
    body = p("Title", '<w:pPr><w:pStyle w:val="Heading2"/></w:pPr>') + p("text") + f"<w:tbl><w:tr><w:tc>{p('a')}</w:tc><w:tc>{p('b')}</w:tc></w:tr></w:tbl>"
    return packed(**{"word/document.xml": f"<w:document {W}><w:body>{body}</w:body></w:document>"})


def test_readers():
    assert files.read_docx(docx(), "x.docx") == "## Title\n\ntext\n\na | b"
    slide = '<s xmlns:a="x"><a:p><a:r><a:t>Hi</a:t></a:r></a:p></s>'
    assert files.read_pptx(packed(**{"ppt/slides/slide1.xml": slide, "ppt/notesSlides/notesSlide1.xml": slide}), "") == "--- Slide 1 ---\nHi\n[Speaker notes: Hi]"
    sheet = '<w><row><c t="s"><v>0</v></c><c><v>7</v></c></row></w>'
    book = packed(**{"xl/workbook.xml": '<w><sheet name="S"/></w>', "xl/sharedStrings.xml": "<s><si><t>k</t></si></s>", "xl/worksheets/sheet1.xml": sheet})
    assert files.read_xlsx(book, "") == "## Sheet: S\nk | 7"
    assert files.read_epub(packed(**{"c.xhtml": "<p>A chapter that is long enough.</p>", "d.html": "<p>no</p>"}), "") == "A chapter that is long enough."
    assert files.read_rtf(rb"{\rtf1{\fonttbl{\f0 Arial;}}\b Hi\b0\par there}", "") == "Hi\nthere"
    assert "é" in files.read_rtf(rb"{\rtf1 caf\'e9}", "")
    assert files.read_image(b"\x89PNG\r\n\x1a\n" + b"\0" * 8 + b"\0\0\0\x05\0\0\0\x07", "a.png").endswith("Size: 5x7")


def test_scan_extract_chunk(spark, tmp_path):
    for name, data in {"hello.py": b"print('hi')", "notes.md": b"# One\na\n# Two\nb", ".hidden": b"x", "program.exe": b"MZ\0\0", "d/r.docx": docx(), "bad.docx": b"no zip", "e.txt": b"", "node_modules/x.js": b"x", "l.txt": b"\xff ok"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    found = files.scan(spark, f"file://{tmp_path}")
    assert {r.path for r in found.select("path").collect()} == {"hello.py", "notes.md", "d/r.docx", "bad.docx", "l.txt"}
    texts = {r.path: r.text for r in files.extract_text(found).collect()}
    assert set(texts) == {"hello.py", "notes.md", "d/r.docx", "l.txt"} and texts["d/r.docx"].startswith("## Title") and texts["l.txt"].endswith(" ok")
    chunks = chunk_text(files.extract_text(found))
    assert {(r.path, r.chunk_text) for r in chunks.where("path = 'notes.md'").collect()} == {("notes.md", "# One\na"), ("notes.md", "# Two\nb")}
    rows = {r.path: (r.chunk_count, r.extension) for r in file_rows(found, chunks, F.current_timestamp()).collect()}
    assert rows["notes.md"] == (2, "md") and rows["bad.docx"] == (0, "docx")


def test_stream_of_new_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.py").write_text("x")
    schema_ready = files.watch(spark, f"file://{tmp_path}/in")
    q = schema_ready.select("path").writeStream.format("memory").queryName("seen_files").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r.path for r in spark.table("seen_files").collect()] == ["a.py"]


TCP = """  sl  local_address rem_address   st
   0: 00000000:0016 00000000:0000 0A
   1: 0100007F:0035 00000000:0000 0A
   2: 0100007F:1F90 0100007F:C350 01
   3: 0100007F:1F91 0100007F:C351 01
   4: 0100007F:1F92 0100007F:C352 06"""


def test_sockets(spark):
    rows = system.sockets(spark.createDataFrame([(x,) for x in TCP.split("\n")], "value string")).collect()
    assert [r.local_port for r in rows if r.state == "LISTEN"] == [22, 53]
    assert [r.state for r in rows].count("ESTABLISHED") == 2 and len(rows) == 5


def test_dumps_journal_manifests(spark):
    text = lambda x: spark.createDataFrame([(x,)], "value string")
    d = system.core_dumps(text('[{"pid": 7, "comm": "c", "sig": "11", "timestamp": "t"}, {"pid": 8}]')).collect()
    assert [(r.pid, r.exe, r.signal) for r in d] == [(7, "c", "11"), (8, "unknown", "unknown")]
    j = system.journal(text('{"_SYSTEMD_UNIT": "a.service", "MESSAGE": "m", "PRIORITY": "3"}')).first()
    assert (j.unit, j.message, j.priority) == ("a.service", "m", 3)
    m = system.manifests(spark, ['[tool]\nname = "git"\nbinary = "git"\ncapabilities = ["log"]\n[tool.schemas.log]\nparams = [{name = "n", type = "integer", required = true}]']).first()
    assert m.name == "git" and '"required": ["n"]' in m.schemas["log"]
