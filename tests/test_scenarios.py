"""The join of alerts with runs in one namespace that has most of both."""

import random
from datetime import datetime, timedelta

import runwarden.plans.registry  # noqa: F401 - the plans are loaded through it
from runwarden.plans.scenarios import scenario_candidates, scenario_join


def test_candidates_of_a_hot_namespace(spark):
    rng = random.Random(1)
    day = datetime(2024, 1, 1)
    when = lambda: day + timedelta(minutes=rng.randrange(60 * 24 * 30))
    runs = [(i, "hot" if i % 10 else "cold", rng.choice(["", "web", "web-1", "db", "no-such", "web-12345678901"]), t, t + timedelta(hours=rng.randrange(20, 28))) for i in range(200) for t in [when()]]
    alerts = [(i, "hot" if i % 20 else "cold", rng.choice(["web-1-a", "web-2", "db-7", "we", "other"]), when()) for i in range(4000)]
    truth = spark.createDataFrame(runs, "line long, namespace string, pod_prefix string, start timestamp_ntz, stop timestamp_ntz")
    rows = spark.createDataFrame(alerts, "alert_id long, ns string, pod string, time timestamp_ntz")
    want = sorted((r[0], a[0]) for r in runs for a in alerts if r[1] == a[1] and r[2] and a[2].startswith(r[2]) and r[3] <= a[3] <= r[4])
    assert sorted((r.line, r.alert_id) for r in scenario_join(truth, rows).collect()) == want
    assert len(want) <= scenario_candidates(truth, rows).count() <= 2.2 * len(want)
    assert scenario_join(truth.where("false"), rows).collect() == [] and scenario_join(truth, rows.where("false")).collect() == []
