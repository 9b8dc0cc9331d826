"""Steps whose results Spark takes for smaller than they are: no pixel is broadcast, and the raster is read once."""

import numpy as np
from pyspark.sql import Window as W
from pyspark.sql import functions as F

import __spark_entry__ as entry
from rasterloom.operators import focal, graph, instances, joins, solids
from rasterloom.sources import views

SF = "/root/testdata/sf0.001"
KEYS = ["scene_id", "mask_id", "row", "col"]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_grown_masks_match_brute_force(spark):
    """Masks with gaps of all widths and repeated rows, grown by boxes that meet."""
    rng = np.random.default_rng(3)
    rows = [(s, m, int(r), int(c)) for s in range(2) for m in range(3) for r, c in rng.integers(0, 40, (30, 2))]
    px = spark.createDataFrame(rows + rows[:20], "scene_id int, mask_id long, row int, col int")
    for radius in (1, 3):
        want = {(s, m, r + i, c + j) for s, m, r, c in rows for i in range(-radius, radius + 1) for j in range(-radius, radius + 1)}
        got = [tuple(r) for r in instances.grown(px, "mask_id", radius).select(*KEYS).collect()]
        assert len(got) == len(want) and set(got) == want


def test_grown_and_labelled_pixels_are_never_broadcast(spark):
    px = spark.createDataFrame([(0, 1, 2, 3), (0, 1, 2, 4)], "scene_id int, mask_id long, row int, col int")
    # The other side may not be broadcast in a left join, so Spark would choose these.
    for own in (instances.grown(px, "mask_id", 2), graph.labelled_runs(px, "mask_id"), graph.connected_components(px.drop("mask_id"), 8)):
        last = plan_of(px.drop("mask_id").join(own, ["scene_id", "row", "col"], "left")).split("Project", 2)[1]
        assert "SortMergeJoin" in last.split("\n")[1]


def test_filled_pixels_are_never_broadcast(spark):
    """Holes that are filled in several rounds come from a union."""
    px = spark.createDataFrame([(0, 0, c, 1.0 if c == 0 else None) for c in range(12)], "scene_id int, row int, col int, z double")
    out = joins.nearest_fill(px, "z")
    assert [r["filled"] for r in out.collect()] == [1.0] * 12
    assert "BroadcastHashJoin" not in plan_of(out) and "SortMergeJoin" in plan_of(out)


def test_features_do_not_go_back_to_the_raster(spark):
    assert "lineitem" not in plan_of(entry.queries()["scene_features"](spark, SF))


def test_whole_grids_move_once(spark):
    """Rows and lines of the grid meet without a join, and windows along rows need no further exchange."""
    full = views.px_full(spark, SF)
    want = views.full_grid(spark, SF).join(views.px(spark, SF), ["scene_id", "row", "col"], "left").select(*full.columns)
    assert full.count() == want.count() and full.exceptAll(want).isEmpty()
    assert "Join" not in plan_of(full)
    along = full.withColumn("n", F.count("ref_mm").over(W.partitionBy("scene_id", "row")))
    assert plan_of(along).count("Exchange hashpartitioning(scene_id") == plan_of(full).count("Exchange hashpartitioning(scene_id")


def test_ruggedness_reads_the_raster_once(spark):
    """A raster with gaps wraps around; a pixel that is missing adds nothing."""
    rng = np.random.default_rng(4)
    for h, w in ((5, 7), (1, 2), (3, 1)):
        z = {(r, c): float(rng.integers(0, 50)) for r in range(h) for c in range(w) if (r, c) != (2, 3)}
        px = spark.createDataFrame([(0, *k, v) for k, v in z.items()], "scene_id int, row int, col int, z double")
        out = focal.tri(px, "z", h, w)
        want = {(r, c): sum(abs(z.get(((r + i) % h, (c + j) % w), v) - v) for i in (-1, 0, 1) for j in (-1, 0, 1)) / 8 for (r, c), v in z.items()}
        got = {(r["row"], r["col"]): r["tri"] for r in out.collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert "Union" not in plan_of(out)


def test_pinches_of_all_passes_are_found_in_one_round(spark, monkeypatch):
    """A mask of several blocks of lines against brute force; nothing is written between four passes."""
    rng = np.random.default_rng(8)
    own = {(int(r), int(c)) for r, c in zip(rng.integers(0, 3 * solids.BLOCK, 2500), rng.integers(0, 20, 2500), strict=True)}
    want = set(own)
    for _ in range(4):
        gone = {(r, c) for r, c in want if (r - 1, c) not in want for k in (-1, 1) if (r - 1, c + k) in want and (r, c + k) not in want}
        want -= gone
    names, write = [], solids.written
    monkeypatch.setattr(solids, "written", lambda df, name: names.append(name) or write(df, name))
    got = solids.unpinch(spark.createDataFrame([(0, 1, *p) for p in own], "scene_id int, mask_id long, row int, col int"))
    assert {(r["row"], r["col"]) for r in got.collect()} == want != own and names == ["cells"]


def test_faces_of_solids_are_named_by_one_join_of_masks(spark):
    cells = spark.createDataFrame([(0, 1, 2, 3), (0, 1, 2, 4)], "scene_id int, mask_id long, row int, col int")
    roof = cells.withColumn("z", F.lit(3.0))
    _, f = solids.building_solids(cells, roof, cells.select("scene_id", "mask_id").distinct().withColumn("ground_m", F.lit(0.0)), 8, 8)
    assert plan_of(f).count("Join") == 1 and f.count() == 2 * 2 + 6 * 2
