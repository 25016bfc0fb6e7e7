"""Queries cover their whole input."""

from gridloom.plans import catalogue

SF = "/root/testdata/sf0.01"


def test_gather_covers_all_shuffled_blocks(spark):
    values = {r.event_id: r.value for r in spark.read.parquet(f"{SF}/events.parquet").collect()}
    got = {r.anchor: (r.x, r.y) for r in catalogue.gather_shuffled(spark, SF).collect()}
    assert got == {k: (v, values[k - 1]) for k, v in values.items() if k >= 1} and len(got) > 3 * catalogue.BLOCK * catalogue.SPC
