from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.errors import SchemaError
from tidemark.functions import dates, floors, text
from tidemark.operators import normalize
from tidemark.sources.exports import read_exports, rows_per_file
from tidemark.sources.headers import field_of, resolve_headers
from tidemark.sources.settings import cancelled_choice, check_market_id, load_settings, zip_table


def values(spark, texts, build):
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in frame.orderBy("i").select(build("t")).collect()]


def test_money(spark):
    got = values(spark, ["$1,200", "(500)", "-", "", None, "$ 1 000.5", "abc", "-5", "(-7)"], text.money)
    assert got == [1200.0, -500.0, None, None, None, 1000.5, None, -5.0, 7.0]


def test_boolean_area_zip(spark):
    assert values(spark, ["Y", "no", "", "x", "?"], text.boolean) == [True, False, None, True, None]
    assert values(spark, ["1,234 SqFt", "150", "900 sq. ft.", "30000"], text.area) == [1234.0, None, 900.0, None]
    assert values(spark, ["33131.0", "33131-1234", "312", "x", None], text.postal_code) == [
        "33131", "33131", "00312", None, None,
    ]


def test_whole_numbers_cut(spark):
    assert values(spark, ["1,200", "2.9", "-2.9", "1d", ""], text.whole) == [1200, 2, -2, None, None]


def test_dates(spark):
    texts = ["2023-01-05", "1/5/2023", "1/5/71", "1/5/69", "05-feb-2023", "20230105", "2023-01-05 10:30:00", "soon", "2023-13-01", ""]
    got = values(spark, texts, dates.read_date)
    day = datetime(2023, 1, 5)
    assert got == [
        day, day, datetime(1971, 1, 5), datetime(2069, 1, 5), datetime(2023, 2, 5), day,
        datetime(2023, 1, 5, 10, 30), None, None, None,
    ]
    labels = values(spark, texts, lambda c: dates.date_layout(c, dates.read_date(c)))
    assert labels[0] == "%Y-%m-%d" and labels[7] == labels[8] == "unparsed" and labels[9] is None


def test_status(spark):
    frame = spark.createDataFrame(
        [("Closed Sale",), ("X",), ("Active With Contract",), ("Under Contract",), ("Temp Off-Market",), ("?",)], "status string"
    )
    got = [r[0] for r in text.with_status(frame).collect()]
    assert got == ["SOLD", "EXPIRED", "ACTIVE", "PENDING", "WITHDRAWN", None]


@pytest.mark.parametrize(
    "unit, floor, penthouse",
    [("2506", 25, False), ("805", 8, False), ("PH2", None, True), ("12", None, False), ("1203B", 12, False),
     ("A1203", 12, False), ("TH-4", 1, False), ("15-02", 15, False), ("LPH3", None, True), ("PH", None, True), ("7", 7, False)],
)
def test_floor_from_unit(spark, unit, floor, penthouse):
    frame = spark.createDataFrame([(unit, None, None)], "unit string, stories int, reported int")
    row = floors.parse_floor(frame, "unit", "stories", "reported").first()
    assert (row["floor"], row["is_penthouse"]) == (floor, penthouse)


def test_floor_resolution(spark):
    rows = [("3106", 31, 29), ("106", 106, 12), ("PH1", 40, 30), ("2506", None, 20), ("505", 7, 1), ("505", 7, 9)]
    frame = spark.createDataFrame(rows, "unit string, reported int, stories int")
    got = [
        (r["floor"], r["floor_resolution"], r["floor_rejected"])
        for r in floors.resolve_floor(frame, "unit", "reported", "stories").collect()
    ]
    assert got == [
        (31, "height_impeached_by_unit_number", False), (1, "floor_impeached_by_unit_number", False),
        (None, "unresolved_conflict", True), (None, "unresolved", True),
        (7, "reported_no_height", False), (7, "reported_ok", False),
    ]


def test_unit_from_address(spark):
    got = values(
        spark, ["1 Main St Unit 12B, MIAMI", "9 Bay Ave #4", "5 Ocean Dr 1204, X", "5 Ocean Dr PH01, X", "7 Palm Ave, X", None],
        floors.unit_from_address,
    )
    assert got == ["12B", "4", "1204", "PH01", None, None]


def test_headers():
    assert field_of("MLS #") == "mls_number" and field_of("MLS") is None and field_of("ML#") == "mls_number"
    assert field_of("Short Sale") == "is_short_sale" and field_of("Sale Type") == "sale_type"
    assert field_of("# Beds") == "beds" and field_of("CDOM (Days on Market)") == "cumulative_days_on_market"
    assert field_of("Maintenance Charge / Month") == "hoa_monthly" and field_of("Remarks") is None
    found = resolve_headers(["LP", "Current Price", "Remarks"])
    assert found.chosen == {"last_list_price": "Current Price"} and sorted(found.leftover) == ["LP", "Remarks"]
    assert "status" in found.required_missing


def test_missing_required_header(spark):
    frame = spark.createDataFrame([("1",)], "`ML#` string")
    with pytest.raises(SchemaError):
        normalize.map_columns(frame)


def test_exports_with_different_headers(spark, tmp_path):
    (tmp_path / "Q1-2023.csv").write_text("ML#,Status\n1,Sold\n2,NA\n")
    (tmp_path / "~Q3-2026.csv").write_text('ML#,View\n3,"Bay, Ocean"\n')
    frame = read_exports(spark, str(tmp_path))
    got = sorted((r["ML#"], r["Status"], r["View"], r["_source_quarter"]) for r in frame.collect())
    assert got == [("1", "Sold", None, "2023Q1"), ("2", None, None, "2023Q1"), ("3", None, "Bay, Ocean", "2026Q3")]
    assert sorted(r["rows"] for r in rows_per_file(frame).collect()) == [1, 2]


def test_settings(spark):
    with pytest.raises(SchemaError):
        check_market_id("../x")
    with pytest.raises(SchemaError):
        cancelled_choice({"defaults": {"cancelled_treatment": "maybe"}})
    with pytest.raises(SchemaError):
        load_settings({"market": "miami"}, "miami")
    table = zip_table(spark, {"submarkets": {"a": {"zips": ["33131"], "tier": 1}, "b": {"zips": ["33131", "33132"]}}})
    assert sorted((r["zip_code"], r["submarket"]) for r in table.collect()) == [("33131", "a"), ("33132", "b")]


def test_duration_prefers_pending(spark):
    day = "timestamp_ntz '2023-01-01'"
    frame = spark.sql(
        f"SELECT 'SOLD' AS status, {day} AS list_date, timestamp_ntz '2023-01-11' AS pending_date, timestamp_ntz '2023-02-01' AS close_date, "
        "CAST(NULL AS timestamp_ntz) AS off_market_date, 5 AS days_on_market"
    )
    row = normalize.with_duration(frame, "2023-03-01").first()
    assert (row["duration_days"], row["duration_source"]) == (10.0, "pending_date")
    live = frame.withColumn("status", F.lit("ACTIVE"))
    row = normalize.with_duration(live, "2023-03-01").first()
    assert (row["duration_days"], row["duration_source"]) == (59.0, "export_date")


def exports_of(folder, n):
    for i in range(n):
        head = "ML#,Status" if i % 2 else 'Status,"ML#",,Status'
        body = f"{i},Sold" if i % 2 else f'Sold,{i},"a ""quoted"" word",x'
        if i % 10 == 3:
            body = f'{i},"So\nld"'
        (folder / f"Q{i % 4 + 1}-2023 part{i}.csv").write_text(f"{head}\n{body}\n")


def jobs_of(spark, work):
    before = spark.sparkContext.statusTracker().getJobIdsForGroup(None)
    found = work()
    return found, len(set(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) - set(before))


def test_headers_of_many_files_in_one_pass(spark, tmp_path):
    few, many = tmp_path / "few", tmp_path / "many"
    few.mkdir(), many.mkdir()
    exports_of(few, 100)  # beyond 32 paths of a header, its files are listed by a job of their own
    exports_of(many, 200)
    _, small = jobs_of(spark, lambda: read_exports(spark, [str(p) for p in few.iterdir()]))
    frame, large = jobs_of(spark, lambda: read_exports(spark, [str(p) for p in many.iterdir()]))
    assert small == large
    rows = frame.collect()
    assert len(rows) == 200 and set(frame.columns) >= {"ML#", "Status", "_c2", "Status0", "Status3"}
    by = {int(r["ML#"]): r for r in rows}
    assert by[13]["Status"] == "So\nld" and by[1]["Status"] == "Sold" and by[1]["_c2"] is None
    assert by[4]["_c2"] == 'a "quoted" word' and by[4]["Status3"] == "x" and by[4]["_source_quarter"] == "2023Q1"
