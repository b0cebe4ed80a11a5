"""Steps that all products share: hashed aggregates of the contests, de-vig by columns, methods short enough to be compiled."""

import io
from contextlib import redirect_stdout

from pyspark.sql import functions as F

from duelgrid import session
from duelgrid.operators import market as M
from duelgrid.sources import bindings as B


def tables(spark, path):
    flags = {1: ("A", "N"), 2: ("N", "N"), 3: ("B", "A"), 4: ("0", "N"), 5: (None, "A"), 6: (None, None), 7: ("Z", "Z")}
    lines = [(o, s, n, 1.0, 100.0 * n, 0.1, f, "O") for o, pair in flags.items()
             for s, m in ((1, 1), (2, 3), (3, 5)) for n, f in zip((m, m + 1), pair)]
    lines += [(8, 1, 1, 1.0, 5.0, 0.1, "A", "F"), (9, None, 1, 1.0, 5.0, 0.1, "A", "F"), (9, 2, 2, 1.0, 5.0, 0.1, "A", "F")]
    made = {
        "lineitem": (lines, "l_orderkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double,"
                            " l_discount double, l_returnflag string, l_linestatus string"),
        "orders": ([(o, 1, "F", "1-URGENT", "2000-01-02") for o in range(1, 10)],
                   "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_orderpriority string, o_orderdate string"),
        "customer": ([(1, 0)], "c_custkey bigint, c_nationkey int"), "nation": ([(0, 0)], "n_nationkey int, n_regionkey int"),
        "region": ([(0, "ASIA")], "r_regionkey int, r_name string"),
        "supplier": ([(i, 0, 1.0) for i in (1, 2, 3)], "s_suppkey bigint, s_nationkey int, s_acctbal double")}
    for name, (rows, schema) in made.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{path}/{name}.parquet")
    return str(path)


def test_contests_are_hashed_and_take_the_least_flag(spark, tmp_path):
    """A text and two structs among the aggregates had all lines sorted."""
    c = B.contests(spark, tables(spark, tmp_path))
    text = io.StringIO()
    with redirect_stdout(text):
        c.explain()
    assert "SortAggregate" not in text.getvalue()
    rows = c.collect()
    methods = {r.contest_id: r.method for r in rows}
    # orders 8 and 9 have one side with a competitor each; the flag is the least text that is not null
    assert methods == {1: "KO/TKO", 2: "SUB", 3: "KO/TKO", 4: "U-DEC", 5: "KO/TKO", 6: "U-DEC", 7: "U-DEC"}
    assert {(r.c1, r.c2, r.td1, r.td2, r.amount1, r.amount2) for r in rows} == {(1, 2, 2, 2, 300.0, 700.0)}


def test_devig_by_columns_is_the_devig_of_each_row(spark):
    odds = [(1.05 + i * 0.0173, 1.2 + i * 0.061) for i in range(300)] + [(1.9, 1.9), (2.5, 2.5), (1.0, 9.0), (None, 2.0), (1.5, None)]
    df = spark.createDataFrame(odds, "fav_odds double, dog_odds double")
    for compiled in (3, 8):  # rows still move after three steps: the loop goes on with them
        out = M.with_devig(df, compiled=compiled)
        assert out.columns == ["fav_odds", "dog_odds", *[f"p_{m}" for m in M.METHODS]]
        both = out.select(*[F.col(f"p_{m}").alias(f"{m}_new") for m in M.METHODS],
                          *[M.devig(F.col("fav_odds"), F.col("dog_odds"), m).alias(f"{m}_old") for m in M.METHODS]).collect()
        assert all(repr(r[f"{m}_new"]) == repr(r[f"{m}_old"]) for r in both for m in M.METHODS)


def test_method_limit_is_set_where_the_session_has_none(spark):
    was = spark.conf.get(session.METHOD_LIMIT)
    try:
        for given, then in (("65535", "8000"), ("6000", "6000")):
            spark.conf.set(session.METHOD_LIMIT, given)
            session.limit_methods(spark)
            assert spark.conf.get(session.METHOD_LIMIT) == then
    finally:
        spark.conf.set(session.METHOD_LIMIT, was)
