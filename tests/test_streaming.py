"""The live feed as a stream, after a restart too, against a plain loop."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tessera.streaming import polls

SPAN = 3_600_000
START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def plain(rows, limit, upto):
    groups = {}
    for source, commit, at, kind, summary, informative in rows:
        groups.setdefault((source, int(at.timestamp() * 1000) // SPAN), []).append((commit, kind, summary, informative))
    out = []
    for (source, poll), own in groups.items():
        if (poll + 1) * SPAN > upto:
            continue
        own.sort()
        if len(own) > limit:
            out.append((source, poll, "resync", None, f"more than {limit} commits since last poll"))
            continue
        label = None
        for commit, kind, summary, informative in own:
            if kind == "index":
                label = summary if informative or label is None else label
            elif kind != "paired":
                out.append((source, poll, kind, commit, summary))
        runs = sum(kind == "index" for _, kind, _, _ in own)
        if runs:
            out.append((source, poll, "index_run", None, f"{label} ({runs} commits)"))
    return sorted(out, key=str)


@pytest.mark.parametrize("cuts", [[300], [90, 140, 300]])
def test_polls_are_told_once_after_restarts_too(spark, tmp_path, cuts):
    r = random.Random(3)
    rows, at = [], START
    for i in range(300):
        at += timedelta(seconds=r.choice([5, 60, 400, 900]))
        rows.append((r.choice(["a", "a", "a", "b"]), i, at, r.choice(["index", "index", "paired", "decision", "commit"]), f"c{i}", r.random() < 0.2))
    schema = "source string, commit_id long, at timestamp, kind string, summary string, informative boolean"
    limit, low = 9, 0
    for cut in cuts:  # each time a new run goes on from the checkpoint
        spark.createDataFrame(rows[low:cut], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        low = cut
        with polls.provider(spark):
            stream = polls.told(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), SPAN, limit)
            stream.writeStream.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).format("parquet").start(str(tmp_path / "out")).awaitTermination()
    got = sorted((tuple(x) for x in spark.read.parquet(str(tmp_path / "out")).select("source", "poll", "kind", "commit_id", "summary").collect()), key=str)
    upto = max(int(x[2].timestamp() * 1000) for x in rows)
    want = plain(rows, limit, upto)
    assert got == want and {x[2] for x in got} == {"resync", "index_run", "decision", "commit"}
    assert spark.read.parquet(str(tmp_path / "in")).agg(F.count("*")).first()[0] == 300
