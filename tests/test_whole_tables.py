"""Queries use every row of their tables, not a part of it."""

from pathlib import Path

import duckdb
import pytest

from chronogrid.plans import demo
from chronogrid.plans.queries import QUERIES

FOLDERS = ["/root/testdata/sf0.001", "/root/testdata/sf0.01"]


def duck(folder):
    c = duckdb.connect()
    for p in Path(folder).glob("*.parquet"):
        c.sql(f"create view {p.stem} as select * from read_parquet('{p}')")
    return c


@pytest.mark.parametrize("folder", FOLDERS)
def test_sensor_years_of_all_scenes(spark, folder):
    sql = f"WITH {demo.SCENES_SQL} SELECT year(obs_date)::INTEGER, string_agg(DISTINCT sensor, '+' ORDER BY sensor), count(*) FROM sc GROUP BY 1"
    got = QUERIES["sensor_years"](spark, folder).select("year", "sensors", "n_scenes").collect()
    c = duck(folder)
    assert sorted(map(tuple, got)) == sorted(c.sql(sql).fetchall())
    assert sum(r.n_scenes for r in got) == c.sql("select count(*) from orders").fetchall()[0][0]


@pytest.mark.parametrize("folder", FOLDERS)
def test_asof_pairs_of_all_pixels(spark, folder):
    sql = f"""WITH {demo.SCENES_SQL} SELECT o.scene_id, arg_min(t.scene_id, (abs(t.obs_date - o.obs_date), t.obs_date, t.scene_id)), min(abs(t.obs_date - o.obs_date))
      FROM sc o JOIN sc t ON t.pixel_id = o.pixel_id AND abs(t.obs_date - o.obs_date) <= 45
      WHERE o.sensor IN ('LANDSAT8_OLI', 'LANDSAT9_OLI2') AND t.sensor IN ('LANDSAT5_TM', 'LANDSAT7_ETM') GROUP BY 1"""
    got = QUERIES["asof_sensor_pair"](spark, folder).select("left_id", "right_id", "gap_days").collect()
    assert sorted(map(tuple, got)) == sorted(duck(folder).sql(sql).fetchall())


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.01", "/root/testdata/sf0.1"])
def test_grids_reach_the_last_row(spark, folder):
    sql = lambda q: duck(folder).sql(f"WITH {demo.CELLS_SQL} {q}").fetchall()
    height = sql("SELECT max(row) + 1 FROM ce")[0][0]
    blocks = QUERIES["block_aggregate"](spark, folder).select("block_row", "block_col", "n_valid").collect()
    assert sorted(map(tuple, blocks)) == sorted(sql(f"SELECT row // 3, col // 3, count(value) FROM ce WHERE row < {height // 3 * 3} AND col < 39 GROUP BY 1, 2"))
    # p_partkey 0 lies left of the grid, at column -1
    cells = {(r.row, r.col): r.value for r in QUERIES["unflatten"](spark, folder).collect()}
    assert {k: v for k, v in cells.items() if v is not None} == {(r, c): v for r, c, v in sql("SELECT row, col, value FROM ce WHERE value IS NOT NULL AND col >= 0")}
    source = {(r, c): v for r, c, v in sql("SELECT row, col, value FROM ce")}
    target = [(r, c) for r in range(height) if (r + 0.5) * 1.6 + 0.3 < height for c in range(25)]
    near = {(r.row, r.col): r.value for r in QUERIES["regrid_nearest"](spark, folder).collect()}
    assert near == {(r, c): source.get((int((r + 0.5) * 1.6 + 0.3), int((c + 0.5) * 1.6 + 0.3))) for r, c in target}
    smooth = {(r.row, r.col) for r in QUERIES["regrid_bilinear"](spark, folder).collect()}
    assert smooth == set(target)
