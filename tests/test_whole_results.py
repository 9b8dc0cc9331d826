"""Queries that left out rows or part of their method, on tables where that shows."""

import duckdb
import numpy as np
from pyspark.sql import functions as F

import __spark_entry__ as entry
from rasterloom.operators import mesh, scenery, solids, tiling

SF = "/root/testdata/sf0.001"


def same_as_sql(spark, folder, name):
    """The rows of a query, which are those of its SQL."""
    con = duckdb.connect()
    for t in ("lineitem", "orders"):
        con.sql(f"create view {t} as select * from '{folder}/{t}.parquet'")
    got = entry.queries()[name](spark, str(folder))
    want = con.sql(entry.oracle_sql()[name])
    plain = lambda rows, names: sorted(tuple(str(r[list(names).index(c)]) for c in sorted(names)) for r in rows)
    rows = plain(got.collect(), got.columns)
    assert rows and rows == plain(want.fetchall(), want.columns)
    return rows


def test_a_scene_without_faces_has_no_row(spark, tmp_path):
    """Its last scene of a few orders has vertices, but no cell of four."""
    con = duckdb.connect()
    for t, key in (("lineitem", "l_orderkey"), ("orders", "o_orderkey")):
        con.sql(f"copy (select * from '{SF}/{t}.parquet' where {key} < 1024 union all select * replace ({key} + 1024 as {key}) from '{SF}/{t}.parquet' where {key} in (0, 9)) to '{tmp_path}/{t}.parquet' (format parquet)")
    assert len(same_as_sql(spark, tmp_path, "validate_mesh")) == 1


def test_meshes_are_checked_for_components_and_places(spark):
    """Two triangles that share a side, one apart, a loose vertex at another's place, and one that isn't finite; a scene without faces."""
    at = [(0, 0, 0), (1, 0, 0), (0, 1, 0), (1, 1, 5), (9, 9, 1), (8, 9, 1), (9, 8, 1), (1, 0, 1e-8)]
    rows = [(0, k, *map(float, p)) for k, p in enumerate(at)] + [(1, 0, 0.0, 0.0, 0.0), (2, 3, 0.0, 0.0, float("nan")), (2, 1, 1.0, 0.0, 0.0), (2, 2, 0.0, 1.0, 0.0)]
    v = spark.createDataFrame(rows, "scene_id int, vid long, x double, y double, z double")
    f = spark.createDataFrame([(0, 0, 0, 1, 2), (0, 1, 1, 3, 2), (0, 2, 4, 5, 6), (2, 0, 1, 2, 3)], "scene_id int, fid long, a long, b long, c long")
    got = {r["scene_id"]: (r["n_components"], r["n_duplicate"], r["n_unreferenced"], r["finite"]) for r in mesh.validate_mesh(v, f).collect()}
    assert got == {0: (3, 1, 1, True), 1: (0, 0, 1, True), 2: (1, 0, 0, False)}


def test_codings_are_swept_from_24_bits_in_all_layers(spark):
    got = entry.queries()["quantisation_sweep"](spark, SF)
    seen = {(r["layer"], r["bits"]) for r in got.collect()}
    assert seen == {(c, n) for c in ("ref", "h_ref", "sigma", "err") for n in (24, 16, 12, 8)} and "worst_sigmas" in got.columns


def test_codes_in_use_are_counted_across_parts_of_the_range(spark):
    """Values that repeat, skip parts of the range, and stand next to each other across the ends of parts; a constant layer; nulls."""
    values = [0.0, 0.0, 1.0, 1.0000001, 250.4, 250.6, 251.0, 251.3, 255.0, None, 128.49, 128.51]
    px = spark.createDataFrame([(0, v, 7.0) for v in values], "scene_id int, a double, b double")
    got = {(r["layer"], r["bits"]): r["n_codes"] for r in tiling.quantisation_sweep(px, ["a", "b"]).collect()}
    for bits in (24, 16, 12, 8):
        assert got["a", bits] == len({round(v / 255.0 * (2**bits - 1)) for v in values if v is not None}) and got["b", bits] == 1


def test_walks_along_shadows_match_brute_force_and_are_not_broadcast(spark, monkeypatch):
    """Walks of several rounds, each joined without a broadcast of what was exploded."""
    rng = np.random.default_rng(5)
    h, w, gap, azimuth = 40, 50, 2, 117.0
    kind = rng.choice(3, (h, w), p=[0.25, 0.73, 0.02])
    kind[30:33, 5:9] = 2
    d_row, d_col = scenery.anti_solar(azimuth)
    want = {}
    for r, c in zip(*(k.tolist() for k in np.where(kind == 2)), strict=True):
        if kind[min(max(round(r + d_row), 0), h - 1), min(max(round(c + d_col), 0), w - 1)] == 2:
            continue
        last = 0
        for k in range(1, 61):
            y, x = round(r + d_row * k), round(c + d_col * k)
            if not (0 <= y < h and 0 <= x < w) or kind[y, x] == 2 or k - last - 1 > gap:
                break
            last = k if kind[y, x] == 1 else last
        want[r, c] = last
    px = spark.createDataFrame([(0, r, c, int(kind[r, c])) for r in range(h) for c in range(w)], "scene_id int, row int, col int, kind int")
    plans, write = [], scenery.written_pixels
    monkeypatch.setattr(scenery, "written_pixels", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or write(df, name))
    runs = scenery.shadow_runs(px.filter("kind = 2").withColumn("component", F.lit(1)), px.filter("kind = 2"), px.filter("kind = 1"), azimuth, h, w, 60, gap)
    assert {(r["row"], r["col"]): r["length"] for r in runs.collect()} == want and max(want.values()) > 3 * scenery.FIRST_STEPS
    assert len(plans) == 5 and not [p for p in plans if "Broadcast" in p]


def test_instances_are_summed_up_without_their_pixels(spark):
    """The raster of masks is joined once to be painted; no pixel meets its record after that."""
    plan = entry.queries()["instance_summary"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join [" in line]
    assert len(joins) == 2 and all("SortMergeJoin" in line for line in joins)


def test_walls_are_measured_without_their_vertices(spark):
    """Lines of cells and heights move; faces carry the places of their corners, which are those of their vertices."""
    cells = spark.createDataFrame([(0, 1, 2, 3), (0, 1, 2, 4), (0, 1, 3, 3), (0, 2, 2, 6)], "scene_id int, mask_id long, row int, col int")
    px = spark.createDataFrame([(0, r, c, r * 10.0 + c) for r in range(8) for c in range(8) if (r, c) != (4, 4)], "scene_id int, row int, col int, z double")
    roof = solids.heights_at_corners(cells, px, "z")
    want = solids.cells_to_pixels(cells).join(px, ["scene_id", "row", "col"]).select(*roof.columns)
    assert roof.count() == want.count() == 11 and roof.exceptAll(want).isEmpty()
    ground = cells.select("scene_id", "mask_id").distinct().withColumn("ground_m", F.lit(1.0))
    v, f = solids.building_solids(cells, roof, ground, 8, 8, 0.5, floor=True)
    at = {r["vid"]: (r["x"], r["y"], r["z"]) for r in v.collect()}
    assert all([tuple(p) for p in r["p"]] == [at[r[c]] for c in "abc"] for r in f.collect())
    assert "Join" not in mesh.face_normals(v, f)._jdf.queryExecution().executedPlan().toString().replace("Join", "", 1)


def test_outlines_meet_as_lines(spark):
    """Random masks against brute force, one of them missing on a side; nothing is joined."""
    rng = np.random.default_rng(6)
    masks = {(side, m): {(int(r), int(c)) for r in range(14) for c in range(16) if rng.random() < 0.8} for side in "ab" for m in range(4) if (side, m) != ("b", 3)}
    frame = lambda side: spark.createDataFrame([(0, m, *p) for (s, m), own in masks.items() if s == side for p in own], "scene_id int, mask_id int, row int, col int")
    rim = {k: {(r, c) for r, c in own if any((r + i, c + j) not in own for i in (-1, 0, 1) for j in (-1, 0, 1))} for k, own in masks.items()}
    share = lambda x, y: sum(any((r - s) ** 2 + (c - d) ** 2 <= 2.25 for s, d in y) for r, c in x) / len(x) if x else 0.0
    out = scenery.boundary_f1(frame("a"), frame("b"), 1.5)
    got = {r["mask_id"]: r["boundary_f1"] for r in out.collect()}
    for m in range(4):
        x, y = rim["a", m], rim.get(("b", m), set())
        p, q = share(x, y), share(y, x)
        assert abs(got[m] - (2 * p * q / (p + q) if p + q else 0.0)) < 1e-12
    assert len(got) == 4 and "Join" not in out._jdf.queryExecution().executedPlan().toString()
