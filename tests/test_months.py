"""Zipped month files as a data source."""

import zipfile

import pytest

from punctual.sources import months, ontime
from tests.test_loading import record

HEADER = ["Origin", "Dest", "Note", "DepDelay"]


@pytest.fixture
def folder(tmp_path):
    def put(path, **members):
        path.parent.mkdir(exist_ok=True)
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as held:
            for name, text in members.items():
                held.writestr(name.replace("_", "."), text)

    put(tmp_path / "a.zip", one_csv='Origin,Dest,Note,DepDelay,\nATL,JFK,"two\nlines, ""quoted""",5.00,\nLAX,ORD,\xe9,,\n'.encode("latin-1"), readme_txt="not,a,month")
    put(tmp_path / "deep" / "b.zip", two_csv="Dest,DepDelay,Origin\nATL,-3,DFW\nORD,7,SEA\n", none_csv="")
    (tmp_path / "notes.txt").write_text("no zip")
    return str(tmp_path)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_members_are_read_by_header_name(spark, folder):
    want = [("ATL", "JFK", 'two\nlines, "quoted"', "5.00"), ("LAX", "ORD", "é", None), ("DFW", "ATL", None, "-3"), ("SEA", "ORD", None, "7")]
    assert rows(months.read_zips(spark, [folder], HEADER)) == sorted(want, key=repr)
    assert rows(months.read_zips(spark, [f"file://{folder}/a.zip"], ["Dest", "Missing"])) == [("JFK", None), ("ORD", None)]


def test_a_partition_for_each_member_and_no_other_columns(spark, folder):
    reader = months.MonthReader([folder], ["Note"], ("ATL",))
    members = reader.partitions()
    assert [m.name for m in members] == ["one.csv", "two.csv", "none.csv"] and members[0].size > members[1].size
    assert [b.schema.names for m in members for b in reader.read(m)] == [["Note"], ["Note"]]
    assert months.read_zips(spark, [folder], ["Note"]).rdd.getNumPartitions() == 3


def test_airports_are_chosen_where_rows_are_read(spark, folder):
    assert rows(months.read_zips(spark, [folder], ["DepDelay"], ["ATL"])) == [("-3",), ("5.00",)]
    assert rows(months.read_zips(spark, [folder], ["DepDelay"], ["XXX"])) == []


def test_filters_are_pushed_if_the_session_lets_them(spark, folder):
    plain = rows(months.read_zips(spark, [folder], HEADER).where("Origin in ('ATL', 'SEA') and Dest = 'ORD'"))
    spark.conf.set(months.PUSHDOWN, "true")
    try:
        df = months.read_zips(spark, [folder], HEADER).where("Origin in ('ATL', 'SEA') and Dest = 'ORD' and DepDelay > '6'")
        assert rows(df) == plain == [("SEA", "ORD", None, "7")]
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "IN (ATL" not in plan.split("BatchScan")[0] and "DepDelay" in plan
        reader = months.FilteringReader([folder], ["DepDelay"], ())
        left = list(reader.pushFilters([months.EqualTo(("DepDelay",), "7"), months.EqualTo(("Dest",), "ORD")]))
        assert left == [months.EqualTo(("Dest",), "ORD")] and [b.to_pydict() for m in reader.partitions() for b in reader.read(m)][-1] == {"DepDelay": ["7"]}
    finally:
        spark.conf.unset(months.PUSHDOWN)


def test_schema_is_the_first_header(spark, folder):
    spark.dataSource.register(months.MonthZips)
    assert spark.read.format(months.NAME).option("paths", folder).load().columns == HEADER


def test_written_zips_come_back_equal(spark, tmp_path):
    lines = [tuple(record(Flight_Number_Reporting_Airline=i, FlightDate=f"2024-{1 + i % 3:02d}-10", Tail_Number=None if i % 4 else f"N{i}")[n] for n in ontime.NAMES) for i in range(300)]
    df = spark.createDataFrame(lines, ontime.SCHEMA).selectExpr("*", "substring(FlightDate, 1, 7) as month")
    held = months.write_zips(df.repartition(5), str(tmp_path / "out"), "month").collect()
    assert sum(r["rows"] for r in held) == 300 and {r["member"] for r in held} == {"2024-01.csv", "2024-02.csv", "2024-03.csv"}
    back = ontime.read_zipped_months(spark, [str(tmp_path / "out")])
    assert rows(back) == rows(df.drop("month"))
    assert ontime.audit(back).first().asDict() == {"records": 300, "flights": 600}
