"""All stages from a raw file to the reports."""

from dataclasses import replace

from pyspark.sql import functions as F

from tidewatch import schema as S
from tidewatch.config import training_config
from tidewatch.plans import fixture
from tidewatch.plans.jobs import run_experiments
from tidewatch.sources import reports

FAST = training_config(fast=True)
TINY = replace(FAST, booster=replace(FAST.booster, trees=1, max_depth=2))


def test_every_report_is_written(spark, small, tmp_path):
    txn = fixture.transactions(spark, small).withColumns(
        {
            "Date": F.date_format(S.TIMESTAMP, "yyyy-MM-dd"),
            "Time": F.date_format(S.TIMESTAMP, "HH:mm:ss"),
            S.TARGET: (F.col("l_linenumber") == 1).cast("int"),
            "txn": F.monotonically_increasing_id(),
        }
    )
    txn.select(*S.RAW_COLUMNS, "txn").write.option("header", True).csv(str(tmp_path / "raw"))
    out = str(tmp_path / "out")
    run_experiments(spark, str(tmp_path / "raw"), out, ["txn"], TINY)
    for kind, rows in (("ablation", 4), ("walk_forward", 4)):
        assert reports.read_report(spark, kind, out, "none").count() == rows
    assert reports.read_report(spark, "typology", out, "none").count() > 0
    for name in ("test_metrics", "baseline_test_metrics", "dropped_rows"):
        assert spark.read.json(f"{out}/{name}").count() == 1
    unseen = spark.read.json(f"{out}/unseen_entity_results").collect()
    assert len(unseen) == 3 and all(r["training_accounts"] > 100 for r in unseen)
