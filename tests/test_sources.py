import json

import pytest

from tallyfold.errors import InvalidDataset
from tallyfold import allowed_file, clean, read_records, read_transactions, records_json, write_records

CSV = '''InvoiceNo,Quantity,Invoice Date,Unit Price,Customer ID,Description,Country
536365,6,12/1/2010 8:26,2.55,17850,"Lantern, ""white""",France
536366,1,12/2/2010 9:00,1.25,17851,,France
536367,2,12/2/2010 9:00,1.25,NA,Mug,France
'''


def test_csv(spark, tmp_path):
    path = tmp_path / "shop.csv"
    path.write_text(CSV)
    df = read_transactions(spark, str(path))
    assert df.columns == ["Quantity", "Invoice Date", "Unit Price", "Customer ID", "Description", "Country"]
    assert {f.dataType.simpleString() for f in df.schema} == {"string"}
    (row,) = clean(df).collect()
    assert (row.customerid, row.description) == ("17850", 'lantern, "white"')


def test_csv_with_its_first_column(spark, tmp_path):
    path = tmp_path / "shop.csv"
    path.write_text(CSV)
    assert read_transactions(spark, str(path), drop_first_column=False).columns[0] == "InvoiceNo"


def test_extension_in_upper_case(spark, tmp_path):
    path = tmp_path / "SHOP.CSV"
    path.write_text(CSV)
    assert read_transactions(spark, str(path)).count() == 3


RECORDS = [
    {"Quantity": 6, "Invoice Date": "2010-12-01", "Unit Price": 2.50, "Customer ID": "A1", "Country": "France"},
    {"Quantity": None, "Invoice Date": "2010-12-01", "Unit Price": 1, "Customer ID": "A2", "Country": "France"},
]


@pytest.mark.parametrize("name", ["shop.json", "shop.jsonl"])
def test_json(spark, tmp_path, name):
    path = tmp_path / name
    if name.endswith("l"):
        path.write_text("\n".join(json.dumps(r) for r in RECORDS))
    else:
        path.write_text(json.dumps(RECORDS, indent=1))
    df = read_transactions(spark, str(path))
    assert df.count() == 2
    (row,) = clean(df).collect()
    assert (row.customerid, row.quantity, row.country) == ("a1", "6", "france")


def test_unknown_format(spark):
    with pytest.raises(ValueError, match="format"):
        read_transactions(spark, "shop.txt")


@pytest.mark.parametrize("name, allowed", [("a.csv", True), ("a.b.JSON", True), ("csv", False), ("a.txt", False), ("a.csv/b", False), ("a.xlsx", False)])
def test_allowed_file(name, allowed):
    assert allowed_file(name) is allowed


def test_records(spark, transactions, tmp_path):
    df = transactions([("a", "2011-01-31 23:00:00", "1", "2.50", "x"), ("b", "2011-02-01 01:00:00.17", "1", "1", "y")])
    records = [json.loads(r.record) for r in records_json(df).collect()]
    assert records[0] == {"customerid": "a", "invoicedate": "2011-01-31 23:00:00", "quantity": "1", "unitprice": "2.50", "country": "x"}
    assert records[1]["invoicedate"] == "2011-02-01 01:00:00.170000"
    write_records(df, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2


def test_line_breaks_inside_quotes(spark, tmp_path):
    path = tmp_path / "shop.csv"
    path.write_text(CSV.replace("Lantern, ", "Lantern,\n"))
    df = read_transactions(spark, str(path), multiline=True)
    assert df.count() == 3


def test_files_are_read_by_the_names_in_their_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("No,Unit Price,Quantity\n1,5,7\n")
    (tmp_path / "b.csv").write_text("No,Quantity,Unit Price\n2,7,5\n")
    found = read_transactions(spark, str(tmp_path), fmt="csv")
    assert {(r["Unit Price"], r["Quantity"]) for r in found.collect()} == {("5", "7")}
    assert found.select("Quantity").distinct().count() == 1
    (tmp_path / "c.csv").write_text("No,Quantity,Cost\n2,7,5\n")
    with pytest.raises(InvalidDataset, match="columns"):
        read_transactions(spark, str(tmp_path), fmt="csv")


@pytest.mark.parametrize("row", ["1,2,3,4", "1,2"])
def test_ragged_rows_fail(spark, tmp_path, row):
    path = tmp_path / "shop.csv"
    path.write_text(f"No,Quantity,Unit Price\n1,2,3\n{row}\n")
    with pytest.raises(Exception, match="MALFORMED|malformed|Malformed"):
        read_transactions(spark, str(path)).select("Quantity").collect()


def test_workbooks_are_refused(spark):
    with pytest.raises(ValueError, match="format"):
        read_transactions(spark, "shop.xlsx")


def test_records_come_back_whole_or_not_at_all(spark, transactions, tmp_path):
    path = str(tmp_path / "out")
    rows = [(f"c{i}", f"2011-01-{1 + i % 28:02}", str(i), "2.50", 'x "y"\n' if i % 2 else None) for i in range(250)]
    df = transactions(rows).repartition(2)
    write_records(df, path, file_records=50)
    listed = spark.read.json(f"{path}.manifest").collect()
    assert len(listed) >= 5 and max(r.records for r in listed) <= 50 and sum(r.records for r in listed) == 250
    read = read_records(spark, path)
    assert sorted(map(str, read.select(df.columns).collect())) == sorted(map(str, df.withColumn("invoicedate", df.invoicedate.cast("string")).collect()))
    part = sorted(tmp_path.glob("out/part-*"))[0]
    whole = part.read_text()
    part.write_text(whole[:-10])
    (tmp_path / "out" / f".{part.name}.crc").unlink()
    with pytest.raises(InvalidDataset, match=part.name):
        read_records(spark, path)
    part.unlink()
    with pytest.raises(InvalidDataset, match=f"{part.name} has 0 bytes"):
        read_records(spark, path)
    part.write_text(whole)
    assert read_records(spark, path).count() == 250
    (tmp_path / "out" / "part-more.txt").write_text("{}\n")
    with pytest.raises(InvalidDataset, match="part-more.txt has 3 bytes and should have 0"):
        read_records(spark, path)


def test_records_without_a_manifest_are_refused(spark, transactions, tmp_path):
    path = str(tmp_path / "out")
    records_json(transactions([("a", "2011-01-01", "1", "1", "x")])).write.text(path)
    with pytest.raises(InvalidDataset, match="no manifest"):
        read_records(spark, path)


def test_no_records(spark, transactions, tmp_path):
    write_records(transactions([]), str(tmp_path / "out"))
    assert read_records(spark, str(tmp_path / "out"), schema="customerid string").count() == 0
