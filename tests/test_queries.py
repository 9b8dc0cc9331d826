"""Every registered query with a SQL twin gives the same rows as DuckDB on the smallest tables."""

import math
import re
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
LLM = {name for name in entry.queries() if name == "pipeline" or re.match("op[0-9]+_", name)}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    return repr(float(v)) if isinstance(v, float) else str(v)


def rows_of(rows, names):
    order = [list(names).index(c) for c in sorted(names)]
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(set(entry.oracle_sql()) - LLM))
def test_query_matches_sql(spark, duck, name):
    got = entry.queries()[name](spark, SF)
    want = duck.sql(entry.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got.collect(), got.columns) == rows_of(want.fetchall(), want.columns)


def test_bootstrap_of_few_anchors_matches_sql(spark, tmp_path):
    """A scene of three anchors, some of whose subsets hold one."""
    shutil.copy(f"{SF}/lineitem.parquet", tmp_path / "lineitem.parquet")
    con = duckdb.connect()
    con.sql(f"create view lineitem as select * from '{SF}/lineitem.parquet'")
    con.sql(f"create table orders as select * from '{SF}/orders.parquet' where o_orderstatus <> 'O' and (o_orderkey % 64, o_orderkey // 3 % 64) in (select (l_orderkey % 64, l_partkey % 64) from lineitem where l_orderkey < 1024) and o_orderkey < 1024 order by o_orderkey limit 3")
    con.sql(f"copy orders to '{tmp_path}/orders.parquet' (format parquet)")
    got = entry.queries()["bootstrap_affine"](spark, str(tmp_path))
    want = con.sql(entry.oracle_sql()["bootstrap_affine"])
    rows = rows_of(want.fetchall(), want.columns)
    assert len(rows) == 1 and rows_of(got.collect(), got.columns) == rows


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_no_all_pairs_plans(spark):
    for name in ("evaluate_by_class", "slope", "fill_polygon", "lattice_upsample"):
        plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("name", "grid_mesh face_normals vertex_normals verticality weld normal_consistency lattice_upsample profile rank_normalise boundary_f1 choose_roof refit_plane core_and_ring to_cells mask_algebra tri".split())
def test_exploded_pixels_are_never_broadcast(spark, name):
    """Spark takes a grid or mask for as small as the rows that it is exploded from, so its size estimate may not choose the join."""
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    keys = [line.split("]")[0] for line in plan.splitlines() if "BroadcastHashJoin" in line]
    assert not [k for k in keys if any(c in k for c in ("row#", "vid#", "node_r#"))]


def test_masks_and_grids_are_exploded_by_all_tasks(spark):
    """Few rows in one file become many pixels, which more than one task makes."""
    from rasterloom.plans.mesh_queries import masks
    from rasterloom.sources import views

    for df in (masks(spark, SF), views.full_grid(spark, SF)):
        assert df.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_entry_without_training_operators(tmp_path):
    """The entry and its queries stay when the folders of the training-data operators are gone."""
    root = Path(entry.__file__).parent
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if (root / name).exists():
            shutil.copy(root / name, tmp_path / name)
    shutil.copytree(root / "rasterloom", tmp_path / "rasterloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'slope' in q and 'pipeline' not in q and not any(k.startswith('op') and k[2].isdigit() for k in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin", "PYTHONPATH": str(tmp_path)})
