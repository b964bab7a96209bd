"""PDF files that are written by the library are read back whole; damaged ones become errors."""

from __future__ import annotations

import re
import zlib

import pytest

from tessella.functions import pdf
from tessella.operators import ingest
from tessella.sources import files


def lines(data):
    return [[text for text, _ in runs] for runs in pdf.runs_of(data)]


PAGES = [["Plain (and) \\ odd", "", "Zweite Zeile – 20 €"], ["second page \r kept", "x" * 5_000]]


@pytest.mark.parametrize("compress", [True, False])
def test_written_pages_are_read_back(compress):
    assert lines(pdf.write(PAGES, compress)) == PAGES
    wide = [["Ελληνικά", "漢字 😀"], ["a"]]
    assert lines(pdf.write(wide, compress)) == wide
    heights = [y for _, y in pdf.runs_of(pdf.write(PAGES, compress))[0]]
    assert heights == [760.0, 744.0, 728.0]


def test_operators_and_revisions():
    body = rb"BT /F1 9 Tf 1 0 0 1 50 700 Tm [(Spa) -20 (ced) -300 (out)] TJ 0 -12 TD (next) Tj T* (third\051) Tj (fourth) ' ET"
    body = body.replace(b"(fourth) '", b"(fourth) '")
    objects = {
        1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [3 0 R] /Resources << /Font << /F1 5 0 R >> >> >>",
        3: b"<< /Type /Page /Parent 2 0 R /Contents [4 0 R] >>", 5: b"<< /Type /Font /Subtype /Type1 >>",
        4: b"<< /Length 6 0 R >>\nstream\n" + body + b"\nendstream", 6: b"%d" % len(body),
    }
    data = b"%PDF-1.4\n4 0 obj\n<< /Length 2 >>\nstream\nET\nendstream\nendobj\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % o for o in objects.items())
    assert pdf.runs_of(data) == [[("Spaced out", 700.0), ("next", 688.0), ("third)", 676.0), ("fourth", 664.0)]]


def test_packed_objects_are_opened():
    inside = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [3 0 R] >>", b"<< /Type /Page /Contents 9 0 R >>"]
    heads, at = [], 0
    for number, body in enumerate(inside, 1):
        heads.append(b"%d %d" % (number, at))
        at += len(body) + 1
    head = b" ".join(heads) + b"\n"
    packed = zlib.compress(head + b"\n".join(inside))
    data = b"%%PDF-1.5\n8 0 obj\n<< /Type /ObjStm /N 3 /First %d /Filter /FlateDecode /Length %d >>\nstream\n%s\nendstream\nendobj\n" % (len(head), len(packed), packed)
    data += b"9 0 obj\n<< /Length 20 >>\nstream\nBT 3 4 Td (hi) Tj ET\n\nendstream\nendobj\n"
    assert pdf.runs_of(data) == [[("hi", 4.0)]]


def test_a_folder_of_files_with_damaged_ones(spark, tmp_path):
    whole = pdf.write(PAGES)
    cut = whole[: whole.index(b"endstream")]
    for name, data in {"a.pdf": whole, "b.PDF": b"no file of this kind", "c.pdf": cut, "d.pdf": pdf.write([[]]), "e.txt": whole}.items():
        (tmp_path / name).write_bytes(data)
    rows = {(r.document.rsplit("/", 1)[1], r.page): (r.text, r.error) for r in files.pdf_pages(files.pdf_files(spark, str(tmp_path))).collect()}
    assert rows.pop(("a.pdf", 1)) == ("Plain (and) \\ odd\nZweite Zeile – 20 €", None)
    assert rows.pop(("a.pdf", 2)) == ("second page \r kept\n" + "x" * 5_000, None)
    assert rows[("b.PDF", 0)] == (None, "ValueError: no PDF header")
    assert rows[("c.pdf", 0)][0] is None and "Error" in rows[("c.pdf", 0)][1]
    assert set(rows) == {("b.PDF", 0), ("c.pdf", 0)}


def test_files_are_read_once_and_pages_are_not_shuffled(spark):
    rows = [(1, "a (b)\n\n\nc\n" * 30), (2, None), (3, "漢字\n😀\n"), (4, "€ – \x81\n" + "z" * 3_000)]
    found = files.pdf_pages(files.pdf_content(spark.createDataFrame(rows, "id long, text string"), "id", "text", 50))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 2 and "Exchange" not in plan
    want = {}
    for key, text in rows:
        for n, page in enumerate(pdf.paged(text, 50), 1):
            want[(f"{key}.pdf", n)] = (re.sub("\n{2,}", "\n", "\n".join(page)), None)
    assert {(r.document, r.page): (r.text, r.error) for r in found.collect()} == want


def test_batches_of_pages_and_files_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(files, "BATCH_CHARS", 20)
    docs = spark.createDataFrame([(i, f"{i}\n" * (i % 9) + "end") for i in range(60)], "id long, text string")
    got = {(r.document, r.page): r.text for r in files.pdf_pages(files.pdf_content(docs, "id", "text", 3)).collect()}
    assert got == {(f"{i}.pdf", n): "\n".join(p) for i in range(60) for n, p in enumerate(pdf.paged(f"{i}\n" * (i % 9) + "end", 3), 1)}


def test_run_lines_equal_glyph_lines(spark):
    pages = {1: [("a", 9.0), ("b", 9.0), ("c", 7.0), ("d", 4.9), ("", 1.0), ("\n", -5.0), ("e", -9.0)], 2: [("", 0.0)], 3: [("x", 5.0), ("y", 2.9)]}
    runs = [("d", n, i, s, y, False) for n, page in pages.items() for i, (s, y) in enumerate(page)]
    want = {r.page: r.text for r in ingest.glyph_lines(spark.createDataFrame(runs, "document string, page int, seq int, str string, y double, has_eol boolean")).collect()}
    rows = [(n, [s for s, _ in page], [y for _, y in page]) for n, page in pages.items()]
    shown = spark.createDataFrame(rows, "page int, strs array<string>, ys array<double>").select("page", ingest.run_lines("strs", "ys").alias("text"))
    assert {r.page: r.text for r in shown.collect()} == want


def test_shown_bytes_go_by_the_map_of_their_font(monkeypatch):
    def fonts(kind, source):
        objects = {
            1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Kids [3 0 R] /Resources << /Font << /F1 5 0 R >> >> >>", 3: b"<< /Contents 4 0 R >>",
            4: b"<< /Length 39 >>\nstream\nBT /F1 9 Tf <006100800062D83DDE00D800> Tj\nendstream", 5: b"<< /Subtype /%s /ToUnicode 6 0 R >>" % kind,
            6: b"<< >>\nstream\n" + source + b"\nendstream",
        }
        return pdf.runs_of(b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % o for o in objects.items()))[0][0][0]

    source = b"beginbfchar <61> <00660069> <0062> <D83DDE01> endbfchar beginbfrange <80> <80> <0080> endbfrange"
    assert fonts(b"Type0", source) == "fi\x80😁😀�"
    # A code that stands for itself in a map of one-byte codes is no Windows-1252 code.
    assert fonts(b"Type1", source) == "\x00fi\x00\x80\x00😁Ø=Þ\x00Ø\x00"
    assert fonts(b"Type1", b"") == "\x00a\x00€\x00bØ=Þ\x00Ø\x00"
    # No object is read twice.
    read, value = [], pdf._value
    monkeypatch.setattr(pdf, "_value", lambda data, at: read.append(at) or value(data, at))
    document = pdf.Document(pdf.write(PAGES))
    assert len(list(document.pages())) == 2
    heads = [at for at in read if at in document.places.values()]
    assert sorted(heads) == sorted(document.places.values())
