"""Reading raw files and writing and reading tables."""

import pytest
from pyspark.sql import functions as F

from tidewatch import schema as S
from tidewatch.plans.features import build_feature_table
from tidewatch.sources import reports, transactions

HEADER = ",".join(S.RAW_COLUMNS)
GOOD = "12:00:00,2026-01-01,0012,0007,100.5,USD,EUR,US,DE,Wire,0,None"


def write(path, *lines):
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def test_typed_scan(spark, tmp_path):
    path = write(
        tmp_path / "a.csv",
        HEADER,
        GOOD,
        "13:00:00,2026-01-01,0013,0007,1e3,USD,NA,US,DE,Wire,1,Structuring",
        "bad,2026-01-01,0014,0007,5,USD,EUR,US,DE,Wire,0,x",
        "13:00:00,2026-13-01,0015,0007,5,USD,EUR,US,DE,Wire,0,x",
        "13:00:00,2026-01-01,0016,0007,NaN,USD,EUR,US,DE,Wire,0,x",
        "13:00:00,2026-01-01,0017,0007,,USD,EUR,US,DE,Wire,0,x",
    )
    df = transactions.read_transactions(spark, path)
    found = {r[S.SENDER]: r for r in df.collect()}
    assert set(found) == {"0012", "0013"}
    assert found["0012"]["Amount"] == 100.5
    assert found["0012"]["Laundering_type"] is None
    assert found["0013"]["Received_currency"] is None
    assert found["0013"][S.TARGET] == 1
    kinds = dict(df.dtypes)
    assert (kinds[S.AMOUNT], kinds[S.TARGET], kinds["timestamp"]) == ("double", "tinyint", "timestamp")


def test_columns_are_found_by_name_and_extra_ones_kept(spark, tmp_path):
    names = [*reversed(S.RAW_COLUMNS), "note"]
    values = [*reversed(GOOD.split(",")), "hello"]
    path = write(tmp_path / "b.csv", ",".join(names), ",".join(values))
    row = transactions.read_transactions(spark, path).first()
    assert (row[S.SENDER], row["Amount"], row["note"]) == ("0012", 100.5, "hello")


def test_missing_columns_file_and_pointer(spark, tmp_path):
    path = write(tmp_path / "c.csv", "Time,Date", "12:00:00,2026-01-01")
    with pytest.raises(ValueError, match="Amount"):
        transactions.read_transactions(spark, path)
    with pytest.raises(FileNotFoundError, match="no transaction file"):
        transactions.read_transactions(spark, str(tmp_path / "absent.csv"))
    pointer = write(tmp_path / "d.csv", transactions.POINTER_PREFIX, "oid sha256:0")
    with pytest.raises(FileNotFoundError, match="pointer"):
        transactions.read_transactions(spark, pointer)


@pytest.mark.parametrize(
    "line",
    [
        GOOD.replace("100.5", "lots"),
        GOOD.replace(",0,None", ",maybe,None"),
        GOOD.replace(",0,None", ",,None"),
    ],
)
def test_bad_amounts_and_labels_fail(spark, tmp_path, line):
    path = write(tmp_path / "e.csv", HEADER, line)
    with pytest.raises(Exception, match="CAST_INVALID_INPUT|must not be missing"):
        transactions.read_transactions(spark, path).collect()


def test_csv_to_feature_table(spark, tmp_path):
    rows = [GOOD.replace("12:00:00", f"12:{i:02d}:00").replace("2026-01", f"2026-{1 + i % 3:02d}") for i in range(20)]
    path = write(tmp_path / "f.csv", HEADER, *rows)
    out = str(tmp_path / "features")
    build_feature_table(spark, path, out, ["Time"])
    table = transactions.read_features(spark, out)
    assert table.count() == 20
    assert set(S.MODEL_FEATURES) <= set(table.columns)
    assert table.where(F.greatest(*[F.col(c).isNull() for c in S.NUMERIC_FEATURES])).count() == 0
    files = table.where(F.col("event_month") == "2026-02").inputFiles()
    assert files and (tmp_path / "features" / "event_month=2026-02").is_dir()


def test_reports_prefer_the_fresh_folder(spark, tmp_path):
    fresh, published = str(tmp_path / "fresh"), str(tmp_path / "published")
    columns = reports.REPORT_SCHEMAS["ablation"]
    assert reports.read_report(spark, "ablation", fresh, published).count() == 0
    reports.write_csv(spark.createDataFrame([("Base", 0.1, 0.2)], columns), f"{published}/ablation_results")
    assert reports.read_report(spark, "ablation", fresh, published).first()["pr_auc"] == 0.1
    reports.write_csv(spark.createDataFrame([("Base", 0.3, 0.4)], columns), f"{fresh}/ablation_results")
    row = reports.read_report(spark, "ablation", fresh, published).first()
    assert (row["model"], row["pr_auc"], row["recall_at_0.5%"]) == ("Base", 0.3, 0.4)


def test_json_report_keeps_nulls(spark, tmp_path):
    path = str(tmp_path / "j")
    reports.write_json(spark.createDataFrame([("a", None)], "k string, v double"), path)
    assert spark.read.text(path).first()[0] == '{"k":"a","v":null}'


def test_times_are_read_in_several_forms_and_drops_are_counted(spark, tmp_path):
    header = ",".join(S.RAW_COLUMNS)
    times = [("12:00:00", "2026-01-02"), ("12:00", "2026-01-02"), ("12:00:00.250", "2026-01-02"), ("12:00", "01/02/2026"), ("noon", "2026-01-02")]
    place = {"Amount": "1.5", "Is_laundering": "0"}
    lines = []
    for time, date in times:
        row = place | {"Time": time, "Date": date}
        lines.append(",".join(row.get(c, "x") for c in S.RAW_COLUMNS))
    path = tmp_path / "times.csv"
    path.write_text("\n".join([header, *lines]) + "\n")
    found = sorted(str(r[0]) for r in transactions.read_transactions(spark, str(path)).select("timestamp").collect())
    assert found == ["2026-01-02 12:00:00"] * 3 + ["2026-01-02 12:00:00.250000"]
    assert transactions.dropped_rows(spark, str(path)).first().asDict() == {"rows": 5, "without_time": 1, "without_amount": 0, "dropped": 1}
