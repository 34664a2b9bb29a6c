import os

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"


def test_outcomes_of_keys_without_events(spark, tmp_path):
    os.symlink(f"{DATA}/reactor_outcomes.parquet", tmp_path / "reactor_outcomes.parquet")
    gone = spark.read.parquet(f"{DATA}/reactor_outcomes.parquet").filter("reactor_id is not null").first()["reactor_id"]
    events = spark.read.parquet(f"{DATA}/stored_events.parquet")
    events.filter(events.reactor_id.isNull() | (events.reactor_id != gone)).write.parquet(str(tmp_path / "stored_events.parquet"))
    rows = lambda d: {r["key_value"]: r for r in entry.queries()["p2_profiles"](spark, d).filter("field = 'reactor_id'").collect()}
    before, after = rows(DATA), rows(str(tmp_path))
    assert set(before) == set(after) and None not in after
    r = after[gone]
    assert (r["n"], r["first_seq"], r["last_seq"], r["longest_pause_us"]) == (0, None, None, 0)
    assert (r["n_outcomes"], r["n_errors"]) == (before[gone]["n_outcomes"], before[gone]["n_errors"]) and r["n_outcomes"] > 0
