import __spark_entry__ as entry


def test_registry():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) > 250
    assert {"zonal_statistics", "slope_degrees", "flow_accumulation", "idw"} <= set(o)


def test_flagship(spark):
    assert entry.entry(spark).count() == 15
