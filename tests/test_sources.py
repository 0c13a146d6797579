"""Files, databases, the catalog, streams and the commands."""

import json
import sqlite3
import zipfile

import pytest
from pyspark.sql import functions as F

from assaykit.cli import run
from assaykit.errors import EXIT_CODES, AssayError, EngineError, OperationError, SourceError, classify
from assaykit.model import Rule, RuleType, SourceKind, Target
from assaykit.sources import names
from assaykit.sources import readers as R
from assaykit.streaming.validate import observed, validate_batches, windowed_counts

MESSY = "id,name,email,age,gender,created_at\n1,Alice,alice@example.com,30,1,2023-01-01\n2,,thirty-five,0,2023-01-02\n3,Bob,bob@example.com,-5,3,2023-01-03\n4,Eve,eve@example,150,0,NA\n"


def write_xlsx(path, sheets):
    """A small workbook with numbers, shared and inline texts, booleans and a date."""
    shared = []

    def cell(ref, v):
        if v is None:
            return ""
        if isinstance(v, bool):
            return f'<c r="{ref}" t="b"><v>{int(v)}</v></c>'
        if isinstance(v, tuple):
            return f'<c r="{ref}" s="1"><v>{v[0]}</v></c>'
        if isinstance(v, (int, float)):
            return f'<c r="{ref}"><v>{v}</v></c>'
        shared.append(v)
        return f'<c r="{ref}" t="s"><v>{len(shared) - 1}</v></c>'

    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(path, "w") as z:
        for k, rows in enumerate(sheets.values(), 1):
            body = "".join(f"<row>{''.join(cell(f'{chr(65 + j)}{i}', v) for j, v in enumerate(r))}</row>" for i, r in enumerate(rows, 1))
            z.writestr(f"xl/worksheets/sheet{k}.xml", f"<worksheet {main}><sheetData>{body}</sheetData></worksheet>")
        z.writestr("xl/sharedStrings.xml", f"<sst {main}>{''.join(f'<si><t>{s}</t></si>' for s in shared)}</sst>")
        z.writestr("xl/styles.xml", f'<styleSheet {main}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
        rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
        z.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="{rel}"><sheets>{"".join(f"<sheet name={chr(34)}{n}{chr(34)} r:id={chr(34)}r{k}{chr(34)}/>" for k, n in enumerate(sheets, 1))}</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="r{k}" Target="worksheets/sheet{k}.xml"/>' for k in range(1, len(sheets) + 1)) + "</Relationships>")


def test_names():
    assert [names.column_name(n) for n in ("a b", "1x", "select", "", None, " é ")] == ["a_b", "col_1x", "select_col", "unnamed_column", "unnamed_column", "_"]
    assert [names.table_name(n) for n in ("my-table", "2020", "order", " ")] == ["my_table", "table_2020", "order_table", "data"]
    assert names.column_names(["a", "a", "A", "b"]) == ["a", "a_1", "A_2", "b"]
    assert names.sheet_name("My Sheet-1") == "My_Sheet_1" and names.sheet_name("1") == "sheet_1" and names.sheet_name("!") == "sheet_"


def test_source_strings(tmp_path):
    (tmp_path / "a.csv").write_text("a\n1\n")
    (tmp_path / "b.dat").write_text("a\n1\n")
    (tmp_path / "empty.csv").write_text("")
    assert R.parse_source(str(tmp_path / "a.csv")).kind == SourceKind.CSV and R.parse_source(f"file://{tmp_path}/b.dat").kind == SourceKind.CSV
    s = R.parse_source("postgresql://u:p%40@h/db.public.t")
    assert (s.kind, s.url, s.table, s.options["password"]) == (SourceKind.POSTGRESQL, "jdbc:postgresql://h:5432/db", "t", "p@")
    assert R.parse_source("mysql://u:p@h:99/db/ignored", "t").url == "jdbc:mysql://h:99/db" and R.parse_source("mssql://u@h/db", "t").url == "jdbc:sqlserver://h:1433;databaseName=db"
    assert R.parse_source("oracle://u@h/x", "t").url == "jdbc:oracle:thin:@//h:1521/x" and R.parse_source("sqlite:////tmp/x.db", "t").path == "/tmp/x.db"
    assert R.parse_source("hdfs://n/p/t.parquet").kind == SourceKind.PARQUET and R.parse_source("catalog://db.t").kind == SourceKind.HIVE
    for wrong in ("", "  ", "nonsense", str(tmp_path), str(tmp_path / "empty.csv"), "mysql:///db"):
        with pytest.raises(SourceError):
            R.parse_source(wrong)
    with pytest.raises(FileNotFoundError):
        R.parse_source(str(tmp_path / "none.csv"))


def test_csv(spark, tmp_path):
    (tmp_path / "m.csv").write_text(MESSY)
    df = R.read(spark, str(tmp_path / "m.csv"), "people")["people"]
    assert dict(df.dtypes) == {"id": "bigint", "name": "string", "email": "string", "age": "bigint", "gender": "string", "created_at": "string"}
    assert df.where("name IS NULL").count() == 1 and df.where("created_at IS NULL").count() == 2
    (tmp_path / "s.csv").write_text("a;select;a\n1;x;1.5\n;y;2\n")
    df = R.read(spark, str(tmp_path / "s.csv"))["s"]
    assert dict(df.dtypes) == {"a": "double", "select_col": "string", "a_1": "double"}
    (tmp_path / "t.tsv").write_text("a\tb\ntrue\t1\nfalse\t2\n")
    assert dict(R.read(spark, str(tmp_path / "t.tsv"))["t"].dtypes) == {"a": "boolean", "b": "bigint"}


def test_json_and_parquet(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"x y": 1, "z": "a"}, {"x y": None, "z": "b"}]))
    (tmp_path / "b.jsonl").write_text('{"x": 1}\n{"x": 2}\n')
    spark.range(3).write.parquet(str(tmp_path / "p.parquet"))
    assert R.read(spark, str(tmp_path / "a.json"))["a"].columns == ["x_y", "z"] and R.read(spark, str(tmp_path / "b.jsonl"))["b"].count() == 2
    assert R.read(spark, str(tmp_path / "p.parquet"))["p"].count() == 3
    spark.range(4).write.saveAsTable("four_rows")
    assert R.read(spark, "catalog://four_rows")["four_rows"].count() == 4 and R.table_exists(spark, "four_rows") and "four_rows" in R.list_tables(spark) and "default" in R.list_databases(spark)
    spark.sql("DROP TABLE four_rows")


PRODUCTS = [["product_id", "price", "made on"], [1, 999.9, (45000,)], [2, 999.99, (45001,)], [3, 1234.5, (45002,)], [4, 12.34, None], [5, 10, (45003,)]]
USERS = [["user_id", "name", "age", "ok"], [1, "Alice", 25, True], [2, "Bartholomew Jr", 123, False], [3, "Eve", 150, True]]


def test_workbooks(spark, tmp_path):
    path = str(tmp_path / "book.xlsx")
    write_xlsx(path, {"products": PRODUCTS, "users": USERS, "void": []})
    tables = R.read(spark, path)
    assert set(tables) == {"products", "users"}
    assert dict(tables["products"].dtypes) == {"product_id": "bigint", "price": "double", "made_on": "timestamp_ntz"} and str(tables["products"].first()["made_on"]) == "2023-03-15 00:00:00"
    assert dict(tables["users"].dtypes) == {"user_id": "bigint", "name": "string", "age": "bigint", "ok": "boolean"}
    one = str(tmp_path / "one.xlsx")
    write_xlsx(one, {"Sheet1": USERS})
    assert set(R.read(spark, one, "people")) == {"people"}
    contract = {"products": {"rules": [{"field": "price", "type": "float", "desired_type": "float(4,1)"}]}, "users": {"rules": [{"field": "name", "type": "string", "desired_type": "string(10)"}, {"field": "age", "type": "integer", "desired_type": "integer(2)"}]}}
    (tmp_path / "c.json").write_text(json.dumps(contract))
    code, text = run(["schema", "--conn", path, "--rules", str(tmp_path / "c.json"), "--output", "json"], spark)
    found = {(f["table"], f["column"]): f["checks"]["desired_type"].get("failed_records") for f in json.loads(text)["fields"]}
    assert code == 1 and found == {("products", "price"): 3, ("users", "name"): 1, ("users", "age"): 2}


def test_sqlite(spark, tmp_path):
    path = str(tmp_path / "x.db")
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE people (id INTEGER, name VARCHAR(20), score REAL)")
        db.executemany("INSERT INTO people VALUES (?, ?, ?)", [(1, "a", 1.5), (2, None, None)])
        db.execute("CREATE TABLE other (x TEXT)")
    assert set(R.read(spark, f"sqlite:///{path}")) == {"people", "other"}
    df = R.read(spark, f"sqlite:///{path}", "people")["people"]
    assert dict(df.dtypes) == {"id": "bigint", "name": "string", "score": "double"} and R.list_columns(df)[1]["max_length"] == 20 and R.column_exists(df, "NAME")
    assert R.count_rows(df, "name IS NULL") == 1 and R.page(df.orderBy("id"), 1, 1).first()["id"] == 2
    assert R.execute_query(spark, "SELECT count(*) AS n FROM people_view", people_view=df) == [{"n": 2}]
    with pytest.raises(SourceError):
        R.read(spark, f"sqlite:///{path}", "none")


def test_results_are_written(spark, tmp_path):
    df = spark.range(2)
    for form in ("json", "parquet"):
        R.write_results(df, str(tmp_path / form), form)
        assert spark.read.format(form).load(str(tmp_path / form)).count() == 2
    with pytest.raises(SourceError):
        R.write_results(df, "x", "csv")


def test_check_command(spark, tmp_path):
    path = str(tmp_path / "m.csv")
    (tmp_path / "m.csv").write_text(MESSY)
    code, text = run(["check", "--conn", path, "--table", "people", "--rule", "not_null(id)", "--rule", "range(age,0,120)", "--verbose"], spark)
    assert code == 1 and "RANGE check completed, found 2 out-of-range records" in text and '"age": -5' in text
    assert run(["check", "--conn", path, "--table", "people", "--rule", "not_null(id)", "--quiet"], spark)[0] == 0
    assert run(["check", "--conn", path, "--table", "people", "--rule", "not_null(nope)"], spark)[0] == 8
    assert run(["check", "--conn", path, "--table", "people"], spark)[0] == EXIT_CODES["usage_error"]
    assert run(["check", "--conn", path, "--table", "people", "--rule", "nope(id)"], spark)[0] == EXIT_CODES["rule_syntax_error"]
    assert run(["check", "--conn", str(tmp_path / "none.csv"), "--table", "t", "--rule", "not_null(id)"], spark)[0] == EXIT_CODES["file_not_found"]
    (tmp_path / "c.json").write_text(json.dumps({"rules": [{"field": "id", "type": "integer", "required": True}]}))
    assert run(["schema", "--conn", path, "--rules", str(tmp_path / "c.json")], spark)[0] == 0
    assert run(["schema", "--conn", path, "--rules", str(tmp_path / "c.json"), "--fail-on-error"], spark)[0] == 1


def test_errors():
    assert classify(FileNotFoundError("x")).exit_code == 20 and classify(PermissionError("x")).category == "permission_denied" and classify(RuntimeError("[UNRESOLVED_COLUMN.X] a")).exit_code == 8
    assert classify(RuntimeError("what")).exit_code == 1 and classify(EngineError("x")).exit_code == 12 and classify(OperationError("x")).exit_code == 6 and not OperationError("x").fatal
    assert AssayError("x", table="t").context == {"table": "t"} and classify(OSError("x")).category == "file_system_error"


RULES = [Rule(RuleType.RANGE, Target("t", "v"), {"max": 4}, name="small"), Rule(RuleType.NOT_NULL, Target("t", "v"), {"filter_condition": "v > 7"}, name="given")]


def test_observed_while_written(spark, tmp_path):
    df, report = observed(spark.range(10).withColumnRenamed("id", "v"), RULES)
    df.write.parquet(str(tmp_path / "out"))
    assert [(r.total_records, r.failed_records) for r in report()] == [(10, 5), (2, 0)]


def test_streams(spark, tmp_path):
    for k in range(2):
        spark.range(k * 5, k * 5 + 5).selectExpr("id AS v", f"timestamp'2024-01-01 00:0{k}:30' AS ts").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("v long, ts timestamp").parquet(str(tmp_path / "in"))
    seen = []
    writer = validate_batches(stream, RULES, lambda n, r: seen.append([(x.total_records, x.failed_records) for x in r]), good=lambda df, n: df.write.mode("append").parquet(str(tmp_path / "good")), bad=lambda df, n: df.write.mode("append").parquet(str(tmp_path / "bad")))
    writer.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination(60)
    assert sum(x[0][0] for x in seen) == 10 and sum(x[0][1] for x in seen) == 5
    assert spark.read.parquet(str(tmp_path / "good")).count() == 5 == spark.read.parquet(str(tmp_path / "bad")).where(F.array_contains("broken_rules", "small")).count()
    counts = windowed_counts(stream, RULES[:1], "ts")
    query = counts.writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "state2")).start()
    query.awaitTermination(60)
    assert sorted((r["total_records"], r["failed_records"]) for r in spark.table("windows").collect()) == [(5, 0), (5, 5)]


def test_csv_fields_with_line_breaks_and_encodings(spark, tmp_path):
    path = tmp_path / "notes.csv"
    path.write_text('id,note\n1,"two\nlines, and ""quotes"""\n2,x\n3,"a ""b"" c"\n')
    got = R.read(spark, str(path))["notes"]
    assert dict(got.dtypes) == {"id": "bigint", "note": "string"}
    assert [tuple(r) for r in got.orderBy("id").collect()] == [(1, 'two\nlines, and "quotes"'), (2, "x"), (3, 'a "b" c')]
    assert R.breaks_in_quotes(spark, str(path))
    path.write_text('id,note\n1,"a ""b"""\n')
    assert not R.breaks_in_quotes(spark, str(path))
    path.write_bytes("id;note\n1;é ü\n2;\"x\ny\"\n".encode("latin-1"))
    assert [tuple(r) for r in R.read(spark, str(path), encoding="latin-1")["notes"].orderBy("id").collect()] == [(1, "é ü"), (2, "x\ny")]


def test_folders_of_files(spark, tmp_path):
    spark.range(20).selectExpr("id", "concat('n', id) AS name").repartition(3).write.csv(f"{tmp_path}/many.csv", header=True)
    spark.range(20).selectExpr("id").repartition(3).write.json(f"{tmp_path}/many.json")
    assert R.read(spark, f"{tmp_path}/many.csv")["many"].agg({"id": "sum"}).first()[0] == 190 == R.read(spark, f"{tmp_path}/many.json")["many"].agg({"id": "sum"}).first()[0]


def test_jdbc_reads_in_parts(spark):
    given = R.parse_source("postgresql://u:p@h/db", "t")
    whole = R.jdbc_options(spark, given)
    assert whole == {"url": "jdbc:postgresql://h:5432/db", "dbtable": "t", "fetchsize": 10_000, "user": "u", "password": "p"}
    cut = R.jdbc_options(spark, given, column="id", parts=16, low=1, high=900, fetch_size=500)
    assert cut == whole | {"fetchsize": 500, "partitionColumn": "id", "lowerBound": "1", "upperBound": "900", "numPartitions": 16}


def test_files_that_the_driver_reads_are_bounded(spark, tmp_path):
    path = tmp_path / "big.db"
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE t (a INTEGER)")
    with pytest.raises(SourceError, match="more than the 0 MB"):
        R.read(spark, f"sqlite:///{path}", "t", max_mb=0)
