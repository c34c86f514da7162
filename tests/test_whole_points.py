"""Grids, tiles, masks and polygons take all of lineitem."""

import duckdb
import pytest

from tests.test_catalog import SF, normal
from tidewell.plans import catalog

CUT = " WHERE l_partkey % 5 = 0"


@pytest.mark.parametrize("name", ["grid_fill", "tile_counts", "raster_max", "raster_diff", "masked_velocity", "point_in_polygon"])
def test_query_takes_every_row(spark, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{SF}/lineitem.parquet'")
    want = con.sql(catalog.ORACLE_SQL[name].replace(CUT, "")).df()
    assert normal(catalog.QUERIES[name](spark, SF).toPandas()) == normal(want)
