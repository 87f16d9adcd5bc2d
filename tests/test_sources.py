import datetime as dt
from decimal import Decimal

import pytest
from tables import rows

from retailspark import columns as C
from retailspark.sources import DATASET, load_dataset, null_tokens, read_delimited, write_delimited
from retailspark.sources.delimited import invalid_counts

TICKETS = """TIC_DATETIME;ID_CLI;ID_SCONTRINO;ID_ARTICOLO;TIC_DATE;DIREZIONE;IMPORTO_LORDO;SCONTO;EXTRA
2019-01-05 10:30:00;c1;t1;a1;2019-01-05;1;12,50;0,25;z
2019-01-06 11:00:00;NA;t2;;2019-01-06;-1;-3,00;NA;z
bad;c3;t3;"";oops;x;1.234,5;0;z
"""
FILES = {
    "loyalty": "ID_CLI;LAST_COD_FID\nc1;STANDARD\nc2;NA\n",
    "account": "ID_CLI;ID_ADDRESS;TYP_JOB\nc1;ad1;NA\nc2;ad2;clerk\n",
    "address": "ID_ADDRESS;REGION\nad1;NA\nad2;\n",
    "privacy": "ID_CLI;FLAG\nc1;NA\n",
    "campaign": "ID;NAME\n1;x\n",
    "campaign_event": "ID;EVENT\n1;open\n",
    "ticket_line": TICKETS,
}


@pytest.fixture
def home(tmp_path):
    for name, text in FILES.items():
        (tmp_path / f"{DATASET[name].file}.csv").write_text(text)
    return str(tmp_path)


def test_dataset(spark, home):
    tables = load_dataset(spark, home, on_invalid="null")
    assert list(tables) == ["loyalty", "account", "address", "privacy", "campaign", "campaign_event", "ticket_line"]
    assert rows(tables["loyalty"]) == [("c1", "STANDARD"), ("c2", None)]
    assert rows(tables["account"]) == [("c1", "ad1", None), ("c2", "ad2", "clerk")]
    assert rows(tables["address"]) == [("ad1", "NA"), ("ad2", None)]  # NA is a value in this table
    assert rows(tables["privacy"]) == [("c1", None)]


def test_types_and_decimal_comma(spark, home):
    lines = load_dataset(spark, home, only=["ticket_line"], on_invalid="null")["ticket_line"]
    assert lines.schema == C.TICKET_SCHEMA
    got = {r[C.TICKET]: r for r in lines.collect()}
    assert got["t1"][C.GROSS] == Decimal("12.50") and got["t1"][C.DISCOUNT] == Decimal("0.25")
    assert got["t1"][C.DAY] == dt.date(2019, 1, 5) and got["t1"][C.MOMENT] == dt.datetime(2019, 1, 5, 10, 30)
    assert got["t2"][C.CUSTOMER] is None and got["t2"][C.ARTICLE] is None and got["t2"][C.DISCOUNT] is None
    assert got["t2"][C.DIRECTION] == -1 and got["t2"][C.GROSS] == Decimal("-3.00")
    t3 = got["t3"]
    assert (t3[C.MOMENT], t3[C.DAY], t3[C.DIRECTION], t3[C.GROSS], t3[C.ARTICLE]) == (None,) * 5


def test_round_trip_and_parquet(spark, home, tmp_path):
    lines = load_dataset(spark, home, only=["ticket_line"], on_invalid="null")["ticket_line"]
    path = str(tmp_path / "again")
    write_delimited(lines, path)
    assert rows(read_delimited(spark, path, C.TICKET_SCHEMA, tokens=("NA", ""))) == rows(lines)
    out = tmp_path / "pq"
    for name, df in load_dataset(spark, home, on_invalid="null").items():
        df.write.parquet(str(out / f"{DATASET[name].file}.parquet"))
    again = load_dataset(spark, str(out), fmt="parquet")
    assert rows(again["ticket_line"]) == rows(lines) and rows(again["address"]) == [("ad1", "NA"), ("ad2", None)]
    with pytest.raises(ValueError):
        load_dataset(spark, home, fmt="xml")


def test_null_tokens(spark):
    df = spark.createDataFrame([("NA", "NA", 1), ("", "x", 2)], "a string, b string, c int")
    assert rows(null_tokens(df, ("NA", ""))) == [(None, "x", 2), (None, None, 1)]
    assert rows(null_tokens(df, ("NA", ""), ["a"])) == [(None, "NA", 1), (None, "x", 2)]


def put(folder, **files):
    folder.mkdir()
    for name, text in files.items():
        (folder / f"{name}.csv").write_text(text)
    return str(folder)


@pytest.mark.parametrize("value, kind", [("1.234,50", "decimal(18,2)"), ("02/01/2019", "date"), ("x", "int")])
def test_unreadable_values_raise_or_are_counted(spark, tmp_path, value, kind):
    path = put(tmp_path / "d", a=f"id;v\n1;{value}\n2;\n")
    schema = f"id int, v {kind}"
    with pytest.raises(Exception, match="cannot be read as"):
        read_delimited(spark, path, schema, tokens=("",)).collect()
    assert rows(read_delimited(spark, path, schema, tokens=("",), on_invalid="null")) == [(1, None), (2, None)]
    assert rows(invalid_counts(spark, path, schema, tokens=("",))) == [("id", 0), ("v", 1)]


def test_quotes_separators_and_line_breaks(spark, tmp_path):
    path = put(tmp_path / "q", a='id;t\n1;"p"";q"\n2;"x ""y"" z"\n3;plain\n')
    assert rows(read_delimited(spark, path)) == [("1", 'p";q'), ("2", 'x "y" z'), ("3", "plain")]
    df = spark.createDataFrame([(1, 'a";\nb'), (2, '"'), (3, "\\"), (4, " x "), (5, None), (6, "")], "id int, t string")
    write_delimited(df, str(tmp_path / "w"))
    assert rows(read_delimited(spark, str(tmp_path / "w"), df.schema, multi_line=True)) == rows(df)


def test_broken_records_raise(spark, tmp_path):
    for name, text in {"few": "1\n", "many": "1;2;3\n", "split": '1;"a\nb"\n'}.items():
        path = put(tmp_path / name, a="id;t\n" + text)
        with pytest.raises(Exception, match="(?i)malformed"):
            read_delimited(spark, path, "id string").collect()
    assert rows(read_delimited(spark, path, multi_line=True)) == [("1", "a\nb")]


def test_files_with_other_headers(spark, tmp_path):
    path = put(tmp_path / "h", a="ID_ADDRESS;REGION\nA1;North\n", b="REGION;ID_ADDRESS\nSouth;A2\n")
    with pytest.raises(Exception, match="(?i)header"):
        read_delimited(spark, path, C.ADDRESS_SCHEMA).collect()
    both = read_delimited(spark, path, C.ADDRESS_SCHEMA, headers="per_file")
    assert rows(both) == [("A1", "North"), ("A2", "South")]
