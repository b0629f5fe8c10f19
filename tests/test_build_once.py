"""The whole build searches the places of each object once."""

from __future__ import annotations

import uuid

from oracle import SF

from tessella.operators import placement as P
from tessella.plans.catalogue import QUERIES


def test_places_are_searched_once(spark, monkeypatch, tmp_path):
    """a search that several steps read isn't run again for each."""
    folder, search = str(tmp_path), P.ring_placement

    def counted(*args, **options):
        found = search(*args, **options)

        def count(frames):
            for f in frames:
                with open(f"{folder}/{uuid.uuid4().hex}", "w") as out:
                    out.write("\n".join(f"{i}:{o}" for i, o in zip(f["img_id"], f["obj_id"], strict=True)))
                yield f

        return found.mapInPandas(count, found.schema)

    monkeypatch.setattr(P, "ring_placement", counted)
    assert QUERIES["r32_build_dataset"](spark, SF).count() > 0
    rows = [r for f in tmp_path.iterdir() for r in f.read_text().splitlines()]
    assert rows and len(rows) == len(set(rows))
