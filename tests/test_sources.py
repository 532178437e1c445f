import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from colophon.operators import citations
from colophon.sources import articles, files, sheets

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def paragraph(text, style=None, run=""):
    return f'<w:p><w:pPr>{f"""<w:pStyle w:val="{style}"/>""" if style else ""}</w:pPr><w:r><w:rPr>{run}</w:rPr><w:t xml:space="preserve">{text}</w:t></w:r></w:p>'


def docx(*body, boxes=(), footnote=""):
    styles = f'''<w:styles {W}><w:docDefaults><w:rPrDefault><w:rPr><w:sz w:val="20"/></w:rPr></w:rPrDefault></w:docDefaults>
    <w:style w:type="paragraph" w:styleId="Base"><w:rPr><w:b/><w:rFonts w:ascii="Times New Roman"/></w:rPr></w:style>
    <w:style w:type="paragraph" w:styleId="Head"><w:basedOn w:val="Base"/><w:rPr><w:sz w:val="22"/></w:rPr></w:style></w:styles>'''
    box = "".join(f"<w:p><w:r><w:pict><w:txbxContent>{b}</w:txbxContent></w:pict></w:r></w:p>" for b in boxes)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {W}><w:body>{''.join(body)}{box}</w:body></w:document>")
        z.writestr("word/styles.xml", styles)
        if footnote:
            z.writestr("word/footnotes.xml", f"<w:footnotes {W}>{paragraph(footnote)}</w:footnotes>")
    return out.getvalue()


def test_articles_are_listed_by_number_and_read_once(spark, tmp_path):
    (tmp_path / "b 10.docx").write_bytes(docx(paragraph("Ten")))
    (tmp_path / "a 2.DOCX").write_bytes(docx(paragraph("2.1 Methods", "Head"), paragraph(""), paragraph("Some﻿ text"), boxes=[paragraph("In a box")], footnote="A note"))
    (tmp_path / "none.docx").write_bytes(b"no archive")
    (tmp_path / "~$a 2.docx").write_bytes(b"lock")
    found = articles.article_files(spark, str(tmp_path))
    assert [r["doc_id"] for r in found.orderBy(*articles.file_order()).collect()] == ["a 2", "b 10", "none"]
    rows = articles.article_paragraphs(found)
    got = {(r["doc_id"], r["source"], r["para_idx"]): r for r in rows.collect()}
    assert got["a 2", "body", 0]["text"] == "2.1 Methods" and got["a 2", "body", 1]["text"] == "" and got["a 2", "textbox", 0]["text"] == "In a box"
    run = got["a 2", "body", 0]["runs"][0]
    assert (run["bold"], run["italic"], run["size_pt"], run["fonts"]) == (True, False, 11.0, ["Times New Roman"])
    assert got["none", None, None]["fault"].startswith("BadZipFile")
    texts = {r["doc_id"]: r["text"] for r in articles.full_text(rows).collect()}
    assert texts["a 2"].splitlines()[:3] == ["2.1 Methods", "", "Some text"] and "A note" in texts["a 2"]
    assert [(r["index"], r["text"]) for r in articles.headings(rows).collect()] == [(0, "2.1 Methods")]
    assert citations.abstracts(rows.where("fault is null")).count() == 2


def test_workbook_round_trip_and_column_resolution(spark, tmp_path):
    rows = [["G1-1", 2.5, True, None], [None, None, None, None], [" x & <y> ", 3, False, "last"]]
    (tmp_path / "w.xlsx").write_bytes(sheets.workbook_bytes(["Lable", "Score", "Ok", "Self-cited  Article"], iter(rows)))
    path = str(tmp_path / "w.xlsx")
    read = sheets.read_sheet(spark, path).orderBy("row_no")
    assert [tuple(r) for r in read.collect()] == [(2, "G1-1", "2.5", "true", None), (4, " x & <y> ", "3", "false", "last")]
    some = sheets.read_sheet(spark, path, 0, {"cited": ["self-cited article"]})
    assert [r["cited"] for r in some.orderBy("row_no").collect()] == [None, "last"]
    header = ["Lable", "Score", "score", None, "Article Index"]
    assert sheets.resolve_column(header, ["Score"]) == 1
    assert sheets.resolve_column(header, ["E"], letters=True) == 4
    with pytest.raises(ValueError):
        sheets.resolve_column(header, ["SCORE"])
    with pytest.raises(ValueError):
        sheets.resolve_column(header, ["Title"])
    listed = [("one", ["a"]), ("two", ["A ", "b"])]
    assert sheets.resolve_sheet(listed, "auto", [["a"], ["B"]]) == "two" and sheets.resolve_sheet(listed, 1) == "two" and sheets.resolve_sheet(listed, "one") == "one"
    with pytest.raises(ValueError):
        sheets.resolve_sheet(listed, "three")
    assert [sheets.column_letters(n) for n in (0, 25, 26, 701, 702)] == ["A", "Z", "AA", "ZZ", "AAA"]
    assert all(sheets.column_number(sheets.column_letters(n)) == n for n in range(800))


def test_json_lines_csv_and_guards(spark, tmp_path):
    path = str(tmp_path / "x.jsonl")
    good = [{"messages": [{"role": "user", "content": "ä"}]}]
    df = spark.createDataFrame([json.dumps(x, ensure_ascii=False) for x in good], "string").select(F.from_json("value", "messages array<struct<role:string,content:string>>").alias("r")).select("r.*")
    files.write_lines(df, path)
    with pytest.raises(Exception, match="(?i)exist"):
        files.write_lines(df, path)
    files.write_lines(df, path, overwrite=True)
    assert files.validated_lines(files.read_lines(spark, path)).count() == 1
    with pytest.raises(ValueError):
        files.write_lines(df, str(tmp_path / "x.txt"))
    with pytest.raises(ValueError):
        files.write_lines(df, path, overwrite=True, source=path)
    table = spark.createDataFrame([("a,\"b\"", 1, "line\nbreak"), (None, 2, "é")], "Code string, n int, t string")
    files.write_table(table, str(tmp_path / "t.csv"))
    raw = next((tmp_path / "t.csv").glob("*.csv")).read_bytes()
    assert raw.startswith("﻿".encode())
    assert sorted((r["Code"] or "", r["n"], r["t"]) for r in files.read_table(spark, str(tmp_path / "t.csv"), None).collect()) == [("", "2", "é"), ('a,"b"', "1", "line\nbreak")]
    files.write_json(table, str(tmp_path / "d.json"))
    assert files.read_records(spark, str(tmp_path / "d.json")).count() == 2
    files.write_workbook(table, str(tmp_path / "o.xlsx"))
    with pytest.raises(FileExistsError):
        files.write_workbook(table, str(tmp_path / "o.xlsx"))
    assert sheets.read_sheet(spark, str(tmp_path / "o.xlsx")).count() == 2
    (tmp_path / "p.txt").write_text("﻿ A prompt \n", "utf-8")
    (tmp_path / "q.txt").write_text(" \n", "utf-8")
    assert files.read_prompt(spark, str(tmp_path / "p.txt")) == "A prompt"
    with pytest.raises(ValueError):
        files.read_prompt(spark, str(tmp_path / "q.txt"))
    assert files.insert_after(table, "Code", "t", F.lit(1)).columns == ["Code", "t", "n"]
    flagged = files.with_flags(spark.createDataFrame([("x",), ("-" * 11 + "y" * 400,), (None,)], "c string"), "c").select("is_short", "excess_dashes", "multi_years").collect()
    assert [tuple(r) for r in flagged] == [(True, False, False), (False, True, False), (True, False, False)]


def test_faults_of_json_lines(spark):
    from colophon.operators.chat import line_faults

    cases = [
        (" ", "blank line"), (None, "blank line"), ("{", "invalid JSON"), ("[1]", "not an object"), ("{}", "no messages"), ('{"messages": []}', "no messages"),
        ('{"messages": {"role": "user"}}', "no messages"), ('{"messages": [1]}', "message is no object"), ('{"messages": [{"role": "tool", "content": "x"}]}', "unsupported role"),
        ('{"messages": [{"role": "user", "content": 5}]}', "content is no text"), ('{"messages": [{"role": "user"}]}', "content is no text"),
        ('{"messages": [{"role": "user", "content": ""}]}', ""), ('{"messages": [{"role": "user", "content": "a", "x": [1]}]}', ""),
    ]
    got = line_faults(spark.createDataFrame([(i, v) for i, (v, _) in enumerate(cases)], "i int, value string")).orderBy("i").collect()
    assert [r["fault"] for r in got] == [f for _, f in cases]
