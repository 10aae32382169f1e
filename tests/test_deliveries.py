"""Queries over snapshots of which some were delivered again: the highest delivery replaces the others whole."""

import pytest

from tidewell.plans import registry

SCHEMA = "snapshot_no int, delivery_no int, id string, title string, company string, closed boolean"


@pytest.fixture(scope="module")
def redelivered(spark, tmp_path_factory):
    """Snapshots 4, 5, 7 and 8 were delivered twice: the first time with a row too many, one too few and old values."""
    rows = [(no, 1, "a", f"t{no}", "f", False) for no in range(1, 11)]
    for no in (4, 5, 7, 8):
        rows += [(no, 1, "superseded", "t", "f", False), (no, 2, "a", "t", "f", True), (no, 2, f"late{no}", "t", "f", False)]
    folder = tmp_path_factory.mktemp("snapshots")
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/job_snapshots.parquet")
    return str(folder)


def _got(spark, folder, name, *columns):
    return {tuple(r) for r in registry.queries()[name](spark, folder).select(*columns).collect()}


def test_streaks_count_the_last_delivery(spark, redelivered):
    streak = {4: 1, 5: 2, 7: 1, 8: 2}
    want = {("a", no, streak.get(no, 0)) for no in range(1, 11)} | {(f"late{no}", no, 0) for no in streak}
    assert _got(spark, redelivered, "closed_streaks", "id", "snapshot_no", "streak") == want


def test_every_snapshot_is_compared_with_the_one_before(spark, redelivered):
    """Each in its last delivery; the latest edit of snapshots 4, 5, 7 and 8 is undone in 6 and 9."""
    twice = (4, 5, 7, 8)
    assert _got(spark, redelivered, "append_new", "snapshot_no", "id") == {(no, f"late{no}") for no in twice}
    title = lambda no: "t" if no in twice else f"t{no}"
    cells = {(no, "a", "title", "push" if no > 2 and title(no - 1) == title(no - 2) else "pull") for no in range(2, 11) if title(no) != title(no - 1)}
    assert _got(spark, redelivered, "reconcile_cells", "snapshot_no", "id", "column_name", "action") == cells
    kept = {(no, "a", "carry" if title(no) == title(no - 1) else "build") for no in range(2, 11)}
    want = kept | {(no, f"late{no}", "build") for no in twice} | {(no + 1, f"late{no}", "drop") for no in twice}
    assert _got(spark, redelivered, "incremental_actions", "snapshot_no", "id", "action") == want
