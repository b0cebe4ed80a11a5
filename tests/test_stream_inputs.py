"""What the stream queries read for each delivery."""

from duelgrid.plans import io_queries as Q


def test_price_join_makes_its_rows_once(spark, sf, monkeypatch):
    """S3: deliveries are cut from tables, not from the join of the prices with their names made anew for each."""
    from duelgrid.plans.workspace import Workspace
    made, ws = [], Workspace(spark, sf)
    keep = ws.keep
    monkeypatch.setattr(ws, "keep", lambda name, df: made.append(name) or keep(name, df))
    Q.price_join(ws).count()
    assert made.count("s3-prices") == made.count("s3-contests") == 1
