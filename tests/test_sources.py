"""Files to tables and back."""

import io
import json
import zipfile

import pytest

from shroud.sources import parse
from shroud.sources.sinks import output_paths, safe_name, write_index, write_parts, write_table
from shroud.sources.tables import NotTabular, TableSource, data_files, read_cells, read_delimited_native, read_json_lines_native, read_tables

NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def rows_of(table):
    return [list(r) for r in table.df.orderBy("_ord").select(*table.physical).collect()]


def book(sheets: dict[str, str], shared: str = "", styles: str = "", settings: str = "") -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f"<workbook {NS}>{settings}<sheets>" + "".join(f'<sheet name="{n}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(sheets, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="rId{i}" Target="{"/xl/" if i % 2 else ""}worksheets/s{i}.xml"/>' for i in range(1, len(sheets) + 1)) + "</Relationships>")
        if shared:
            z.writestr("xl/sharedStrings.xml", f"<sst {NS}>{shared}</sst>")
        if styles:
            z.writestr("xl/styles.xml", f"<styleSheet {NS}>{styles}</styleSheet>")
        for i, rows in enumerate(sheets.values(), 1):
            z.writestr(f"xl/worksheets/s{i}.xml", f"<worksheet {NS}><sheetData>{rows}</sheetData></worksheet>")
    return out.getvalue()


@pytest.mark.parametrize(
    "raw,columns,rows",
    [
        (b"a,b\r\n1,\r\n\r\n,2\r\n", ["a", "b"], [["1", None], [None, "2"]]),
        (b"a,b\n1,2,3,4\n5\n", ["a", "b", "col_3", "col_4"], [["1", "2", "3", "4"], ["5", None, None, None]]),
        (b'a\r"x\r\ny"\r"p ""q"""\r', ["a"], [["x\r\ny"], ['p "q"']]),
        ("\ufeffa,,a\n1,2,3\n".encode(), ["a", "col_2", "a"], [["1", "2", "3"]]),
        ("이름\n가나다\n".encode("cp949"), ["이름"], [["가나다"]]),
        (b"a\n\xff\xfe\xe9\n", ["a"], [["ÿþé"]]),
        (b"", [], []),
    ],
)
def test_delimited(spark, tmp_path, raw, columns, rows):
    (tmp_path / "t.csv").write_bytes(raw)
    (table,) = read_tables(spark, str(tmp_path / "t.csv"))
    assert (table.name, table.columns) == ("t", columns)
    assert rows == [] or rows_of(table) == rows


@pytest.mark.parametrize(
    "value,tables",
    [
        ([{"id": 1, "tags": ["x", 1]}, {"name": "n", "id": 2.0}], [("j", ["id", "tags", "name"], [["1", '["x", 1]', None], ["2", None, "n"]])]),
        ({"P-1": {"n": True}, "P-2": {"_key": "k"}}, [("j", ["__key", "n", "_key"], [["P-1", "true", None], ["P-2", None, "k"]])]),
        ({"columns": ["a", 2], "data": [[1, None, "x"]]}, [("j", ["a", "2", "col_3"], [["1", None, "x"]])]),
        ([[1, 2.5], [""]], [("j", ["col_1", "col_2"], [["1", "2.5"], [None, None]])]),
        ({"meta": {"v": 1}, "data": [[1], [2]], "people": [{"a": {"가": 1}}, {"a": 1e21}]}, [("data", ["col_1"], [["1"], ["2"]]), ("people", ["a"], [['{"가": 1}'], ["1000000000000000000000"]])]),
    ],
)
def test_json(spark, tmp_path, value, tables):
    (tmp_path / "j.json").write_text(json.dumps(value, ensure_ascii=False), encoding="utf-8")
    got = read_tables(spark, str(tmp_path / "j.json"))
    assert [(t.name, t.columns, rows_of(t)) for t in got] == tables


@pytest.mark.parametrize("value", [{"name": "x", "scripts": {"a": "b"}}, [{"a": 1}], [], 3, [1, 2]])
def test_configs_are_not_tables(spark, tmp_path, value):
    (tmp_path / "c.json").write_text(json.dumps(value))
    with pytest.raises(NotTabular):
        read_tables(spark, str(tmp_path / "c.json"))


def test_json_lines(spark, tmp_path):
    (tmp_path / "l.jsonl").write_text('{"b": 1, "a": "x"}\n\n{"c": null, "a": 2}\n')
    (table,) = read_tables(spark, str(tmp_path / "l.jsonl"))
    assert (table.columns, rows_of(table)) == (["b", "a", "c"], [["1", "x", None], [None, "2", None]])
    native = read_json_lines_native(spark, str(tmp_path / "l.jsonl"))
    assert set(native.columns) == {"a", "b", "c"} and native.count() == 2
    (tmp_path / "one.jsonl").write_text('{"a": 1}\n')
    with pytest.raises(NotTabular):
        read_tables(spark, str(tmp_path / "one.jsonl"))


def test_workbook(spark, tmp_path):
    shared = "<si><t>id</t></si><si><r><t>da</t></r><r><t>te</t></r><rPh><t>reading</t></rPh></si><si><t>x</t></si>"
    styles = '<numFmts><numFmt numFmtId="164" formatCode="yyyy\\-mm"/><numFmt numFmtId="165" formatCode="0.0\\ \\m"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="164"/><xf numFmtId="165"/></cellXfs>'
    first = (
        '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c><c r="D1" t="inlineStr"><is><t>inline</t></is></c></row><row r="2"/><row r="3"><c r="B3"/></row>'
        '<row r="9"><c r="A9"><v>3.0</v></c><c r="B9" s="1"><v>32874</v></c><c r="C9" s="2"><v>32874.5</v></c><c r="D9" s="3"><v>1.5</v></c><c r="AA9" t="b"><v>1</v></c></row>'
    )
    (tmp_path / "w.xlsx").write_bytes(book({"One": first, "Empty": "", "Err": '<row><c r="A1" t="str"><v>h</v></c></row><row><c r="A2" t="e"><v>#N/A</v></c></row>'}, shared, styles))
    one, empty, err = read_tables(spark, str(tmp_path / "w.xlsx"))
    assert one.columns[:5] == ["id", "date", "col_3", "inline", "col_5"] and len(one.columns) == 27
    assert [v for v in rows_of(one)[0] if v] == ["3", "1990-01-01", "1990-01-01 12:00:00", "1.5", "true"]
    assert (empty.columns, err.columns, rows_of(err)) == ([], ["h"], [["#N/A"]])
    (tmp_path / "m.xlsx").write_bytes(book({"S": '<row><c r="A1"><v>7</v></c></row><row><c r="A2" s="1"><v>0</v></c></row>'}, "", styles, '<workbookPr date1904="1"/>'))
    assert rows_of(read_tables(spark, str(tmp_path / "m.xlsx"))[0]) == [["1904-01-01"]]
    (tmp_path / "evil.xlsx").write_bytes(book({"S": ""}, '<!DOCTYPE x [<!ENTITY a "b">]>'.replace("<!DOCTYPE", "<!DOCTYPE") + "<si/>"))
    with pytest.raises(ValueError, match="document type"):
        read_tables(spark, str(tmp_path / "evil.xlsx"))


def test_many_files_by_one_job(spark, tmp_path):
    for i in range(5):
        (tmp_path / f"f{i}.csv").write_text(f"a\n{i}\n")
    (tmp_path / "bad.json").write_text("{")
    cells = read_cells(spark, str(tmp_path)).collect()
    assert sorted(r.cells[0] for r in cells if r.ord == 0) == list("01234")
    assert [r.error.split(":")[0] for r in cells if r.error] == ["JSONDecodeError"]
    spark.dataSource.register(TableSource)
    got = spark.read.format("shroud").load(f"{tmp_path}/f0.csv,{tmp_path}/f1.csv")
    assert sorted(r.cells[0] for r in got.where("ord = 0").collect()) == ["0", "1"]
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "node_modules" / "x.csv").write_text("a\n1\n")
    found = [r.path.rpartition("/")[2] for r in data_files(spark, str(tmp_path)).collect()]
    assert found == ["f0.csv", "f1.csv", "f2.csv", "f3.csv", "f4.csv", "bad.json"]
    assert read_delimited_native(spark, str(tmp_path / "f0.csv")).columns == ["a"]


@pytest.mark.parametrize("kind", ["csv", "tsv", "json", "jsonl"])
def test_written_tables_read_back(spark, tmp_path, kind):
    (tmp_path / "in.csv").write_text('a,b,a\n1,"x, ""y""\nz",\n,2,3\n', encoding="utf-8")
    (table,) = read_tables(spark, str(tmp_path / "in.csv"))
    path = tmp_path / "deep" / f"out.{kind}"
    write_table(table, path)
    (back,) = read_tables(spark, str(path))
    assert rows_of(back) == rows_of(table)
    assert back.columns == (["a", "b", "a"] if kind in ("csv", "tsv") else ["a", "b", "a_2"])
    if kind == "csv":
        assert path.read_bytes() == b'a,b,a\r\n1,"x, ""y""\nz",\r\n,2,3\r\n'
    write_parts(table, str(tmp_path / f"parts-{kind}"), kind)
    assert any((tmp_path / f"parts-{kind}").glob("part-*"))


def test_names_of_copies(tmp_path):
    taken = set()
    assert [safe_name(n, taken) for n in ("a/b", "A_B", "../..", "", "표 1")] == ["a_b", "A_B_2", "sheet", "sheet_2", "표 1"]
    paths, read = output_paths(tmp_path, "x/w.xlsx", ["S", "s"])
    assert [str(p.relative_to(tmp_path)) for p in paths] == [".shroud/out/x/w.xlsx.sheets/S.csv", ".shroud/out/x/w.xlsx.sheets/s_2.csv"] and read.name == "w.xlsx.md"
    write_index(read, "x/w.xlsx", ["one.csv"])
    assert "- `one.csv`" in read.read_text()
    assert output_paths(tmp_path, "a.csv", ["a"])[1] == tmp_path / ".shroud/out/a.csv"


def test_file_types():
    assert parse.is_data_file("A.CSV") and parse.is_data_file("x/y.jsonl") and not parse.is_data_file("csv") and not parse.is_data_file("a.csv.bak")
    with pytest.raises(ValueError, match="unsupported"):
        parse.grids("x.txt", b"")
