"""Streams over a table of several files, in any order, give the batch results."""

import os
import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from hookline.plans import catalog
from hookline.session import checkpoint_dir
from hookline.streaming import streams as SS

SF = "/root/testdata/sf0.001"
PAIRS = [("nav_stats", "stream_running_stats"), ("redirect_alerts", "stream_redirect_alerts"),
         ("warning_dwell", "stream_warning_dwell"), ("navigation_events", "stream_navigation")]


@pytest.fixture(scope="module")
def several(tmp_path_factory):
    """The small tables with `events` dealt out of order into three files; user 1 has
    many redirects in one page view."""
    top = tmp_path_factory.mktemp("sf")
    for name in ("pages", "customer", "part", "supplier", "orders"):
        os.symlink(f"{SF}/{name}.parquet", top / f"{name}.parquet")
    t = pq.read_table(f"{SF}/events.parquet")
    rows = t.slice(0, 200).to_pylist()
    for i, r in enumerate(rows[:40]):
        r |= {"user_id": 1, "event_type": "click" if i % 3 else "error", "ts": rows[0]["ts"].replace(hour=i % 20, minute=i)}
    random.Random(3).shuffle(rows)
    os.mkdir(top / "events.parquet")
    for k in range(3):
        pq.write_table(pa.Table.from_pylist(rows[k::3], t.schema), top / f"events.parquet/part-{k}.parquet")
    return str(top)


def rows(df):
    columns = sorted(df.columns)
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


@pytest.mark.parametrize(("batch", "stream"), PAIRS)
def test_stream_equals_batch(spark, several, batch, stream):
    want = rows(catalog.QUERIES[batch](spark, several))
    assert want
    assert rows(catalog.QUERIES[stream](spark, several)) == want


def test_a_job_resumes_in_its_folder(spark, several):
    folder = SS.stream_folder(spark, "resumed")
    for _ in range(2):
        out = SS.run_append(SS.event_stream(spark, several), folder)
        assert out.count() == 200
    stats = SS.stream_folder(spark, "resumed_stats")
    first = rows(SS.run_upsert(SS.running_stats(SS.event_stream(spark, several)), stats, ["user_id"]))
    assert rows(SS.run_upsert(SS.running_stats(SS.event_stream(spark, several)), stats, ["user_id"])) == first


class _Nothing:
    """A session of a cluster that names no checkpoint folder."""

    master = "spark://host:7077"

    def __getattr__(self, name):
        return self

    def __call__(self, *args):
        return self

    def get(self, key, default=None):
        return default

    def isPresent(self):
        return False


def test_checkpoint_folder_is_required_off_local_masters():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        checkpoint_dir(_Nothing())
