"""A ledger's snapshot: equal to the ledger after every append, and brought forward by new files only."""

import shutil

import pytest
from pyspark.sql import functions as F
from tests.conftest import rows

from storelens.operators import stock
from storelens.sources import snapshots
from storelens.sources.binding import bind

LEDGER = ("itmid", "purchase_date", "instoreid", "outstoreid", "itmcandel", "canordersts", "stockqty")


@pytest.mark.parametrize("merge_every", [16, 2])
def test_equal_to_the_ledger_after_every_append(spark, data, tmp_path, monkeypatch, merge_every):
    monkeypatch.setattr(snapshots, "MERGE_EVERY", merge_every)
    t = bind(spark, data)
    # All kinds of cancel marks and directions, items and days that come again.
    odd = t.ledger.limit(900).select(*LEDGER).withColumns({
        "itmcandel": F.when(F.col("stockqty") % 7 != 0, F.col("stockqty") % 3 % 2), "canordersts": F.when(F.col("stockqty") % 5 != 0, 0),
        "outstoreid": F.col("stockqty") % 2, "itmid": F.col("itmid") % 40}).cache()
    ledger, snapshot = str(tmp_path / "ledger"), str(tmp_path / "sums")
    for k in range(4):
        odd.where(F.col("stockqty") % 4 == k).coalesce(1).write.mode("append").parquet(ledger)
        whole = t.replace(ledger=spark.read.parquet(ledger))
        # From the snapshot before and the new file, and from the snapshot that has it.
        for _ in range(2):
            kept = t.replace(ledger=snapshots.snapshot_ledger(spark, ledger, snapshot, odd.schema))
            for run in (stock.stock_ledger, stock.stock_report):
                assert rows(run(kept)) == rows(run(whole))
            read = snapshots.bring_forward(spark, ledger, snapshot, odd.schema)
            assert len(read) in (0, 1)
        assert snapshots.bring_forward(spark, ledger, snapshot, odd.schema) == set()
        assert len(snapshots.parts(spark, snapshot)) <= merge_every - 1 + (merge_every == 16) * 4
    # A run that fails before its mark leaves the snapshot as it was; a ledger written anew voids it.
    spark.range(1).write.parquet(f"{snapshot}/part=99/sums")
    assert rows(stock.stock_ledger(t.replace(ledger=snapshots.snapshot_ledger(spark, ledger, snapshot, odd.schema)))) == rows(stock.stock_ledger(whole))
    shutil.rmtree(ledger)
    odd.where("itmid < 9").write.parquet(ledger)
    whole = t.replace(ledger=spark.read.parquet(ledger))
    for _ in range(2):
        kept = t.replace(ledger=snapshots.snapshot_ledger(spark, ledger, snapshot, odd.schema))
        assert rows(stock.stock_ledger(kept)) == rows(stock.stock_ledger(whole))
        snapshots.bring_forward(spark, ledger, snapshot, odd.schema)
    assert len(snapshots.parts(spark, snapshot)) == 1


def test_an_empty_ledger(spark, data, tmp_path):
    schema = bind(spark, data).ledger.select(*LEDGER).schema
    got = snapshots.snapshot_ledger(spark, str(tmp_path / "none"), str(tmp_path / "sums"), schema)
    assert got.collect() == [] and snapshots.bring_forward(spark, str(tmp_path / "none"), str(tmp_path / "sums"), schema) == set()
