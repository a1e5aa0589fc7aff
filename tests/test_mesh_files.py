"""Files of a surface's mesh."""

from __future__ import annotations

from bathyal.plans import exchange


def test_mesh_is_made_once_for_all_files(spark, sf, monkeypatch):
    seen = []

    def watched(write):
        def written(v, f, *rest):
            seen.extend(t._jdf.queryExecution().optimizedPlan().toString() for t in (v, f))
            return write(v, f, *rest)

        return written

    for name in ("write_mesh", "write_ply", "write_stl"):
        monkeypatch.setattr(exchange.writers, name, watched(getattr(exchange.writers, name)))
    rows = {r.kind: (r.vertices, r.faces) for r in exchange.mesh_files(spark, sf).collect()}
    assert len(seen) == 8 and not any("Aggregate" in p or "Join" in p for p in seen)
    assert rows["obj"] == rows["ply"] and rows["stl"][0] == 3 * rows["stl"][1] and rows["dxf"][0] == 4 * rows["dxf"][1]
