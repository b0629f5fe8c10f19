"""Tables in the shared folder."""

from __future__ import annotations

from pathlib import Path

from tessella import storage


def test_stored_tables_can_be_dropped(spark):
    storage.drop_stored(spark)
    d = storage.stored(spark.range(5), "five")
    path = Path(d.inputFiles()[0].removeprefix("file:").lstrip("/").join(["/", ""])).parent
    assert d.count() == 5 and path.is_dir() and path.parent == Path(storage.shared_dir(spark).removeprefix("file://"))
    assert storage.drop_stored(spark) == 1 and not path.exists() and storage.drop_stored(spark) == 0
