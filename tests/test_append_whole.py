import pandas as pd

import __spark_entry__ as entry
from loomlog.sources.fixtures import events_log

DATA = "/root/testdata/sf0.001"


def test_appends_against_a_share_of_the_log(spark):
    log = [(r["position"], r["event_id"], r["aggregate_id"], r["version"]) for r in events_log(spark, DATA).select("position", "event_id", "aggregate_id", "version").collect()]
    half = max(r[0] for r in log) // 2
    got = entry.queries()["append_idempotent"](spark, DATA).collect()
    assert sorted(tuple(r) for r in got) == sorted(r for r in log if r[0] > half) != []
    last = pd.DataFrame(log, columns=["position", "id", "stream", "version"]).groupby("stream")["position"].max()
    got = entry.queries()["append_conflicts"](spark, DATA).collect()
    assert sorted(r["aggregate_id"] for r in got) == sorted(last[last <= half].index) and len(got) < len(last)
