from datetime import datetime, timedelta

from pyspark.sql import functions as F

from teleledger.operators import paging


def test_near_and_deep_pages_keep_rows_without_a_time(spark):
    rows = [(1, datetime(2025, 5, 12)), (2, None), (3, datetime(2025, 5, 13)), (4, None)]
    df = spark.createDataFrame(rows, "id long, t timestamp")
    order = [F.desc("t"), F.asc("id")]
    near = paging.page_of(df, order, 1, 4, "t").collect()
    deep = paging.page_of(df, order, 1, 4, "t", deep_from=1).collect()
    assert [r.id for r in near] == [r.id for r in deep] == [3, 1, 2, 4]


def _backfill(spark):
    """A third of the rows in one instant, rows without a time, equal rows."""
    start = datetime(2025, 5, 12)
    rows = [(i % 700, start + timedelta(seconds=37 * i) if i % 3 else start) for i in range(1_800)] + [(i % 5, None) for i in range(40)]
    ordered = sorted(rows, key=lambda r: (-(r[1] or datetime(1970, 1, 1)).timestamp(), r[0]))
    return spark.createDataFrame(rows, "id long, t timestamp_ntz").repartition(4), ordered


def test_deep_pages_inside_one_instant(spark):
    df, want = _backfill(spark)
    order = [F.desc("t"), F.asc("id")]
    for page, size in ((1, 100), (13, 100), (15, 100), (18, 100), (19, 100), (20, 100), (3, 613)):
        got = paging.page_of(df, order, page, size, "t", deep_from=1).collect()
        assert [tuple(r) for r in got] == want[(page - 1) * size:page * size]


def test_deep_pages_spread_a_hot_minute(spark):
    """The ranges that are ranked hold a part of the hot minute each."""
    df, _ = _backfill(spark)
    order = [F.desc("t"), F.asc("id")]
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        page = paging.page_of(df, order, 14, 100, "t", deep_from=1)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    plan = page._jdf.queryExecution().optimizedPlan().toString()
    assert "_range" in plan and "date_trunc" not in plan and page.count() == 100


def test_pages_of_groups(spark):
    """Deep pages of each group are those of one sort."""
    df, _ = _backfill(spark)
    grouped = df.withColumn("g", F.when(F.col("id") % 10 < 8, 0).otherwise(F.col("id") % 10)).distinct()
    order = [F.desc("t"), F.asc("id")]
    rows = [(r.g, r.id, r.t) for r in grouped.collect()]
    for page, size in ((1, 7), (2, 100), (7, 100), (40, 100)):
        want = set()
        for g in {r[0] for r in rows}:
            mine = sorted((r for r in rows if r[0] == g), key=lambda r: (-(r[2] or datetime(1970, 1, 1)).timestamp(), r[1]))
            want |= {(*r, i + 1) for i, r in enumerate(mine) if (page - 1) * size <= i < page * size}
        for deep_from in (1, 10_000):
            got = paging.group_pages(grouped, "g", "t", order, page, size, deep_from)
            assert {(r.g, r.id, r.t, r.place) for r in got.collect()} == want and sorted(got.columns) == ["g", "id", "place", "t"]


def test_a_page_is_answered_anew(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(1).write.parquet(path)
    search = lambda: paging.kept(paging.page_of(spark.read.parquet(path), [F.asc("id")], 1, 9, "id")).count()
    assert search() == 1
    spark.range(1, 3).write.mode("append").parquet(path)
    assert search() == 3
    assert spark.sparkContext._jsc.getPersistentRDDs().isEmpty()
