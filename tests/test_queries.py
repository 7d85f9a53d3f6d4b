"""Every query against its SQL, on the smallest tables."""

import duckdb
import pytest

from strandlog import queries as Q

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


def rows(frame):
    frame = frame[sorted(frame)]
    return sorted(map(str, frame.astype(object).where(frame.notna(), None).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_matches_sql(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = Q.queries()[name](spark, SF).toPandas(), db.sql(Q.oracle_sql()[name]).df()
    assert sorted(got) == sorted(want)
    assert rows(got) == rows(want)


def test_flagship(spark):
    assert Q.flagship(spark, SF).count() == 8


def test_scan_reaches_the_files(spark):
    plan = Q.queries()["q02_scan"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(aggregate_key,4:user;1:7;)" in plan and "GreaterThanOr" in plan and "Window" not in plan


def test_log_is_written_again_when_its_table_changes(spark, tmp_path):
    from strandlog.sources import adapters

    events = spark.read.parquet(f"{SF}/events.parquet")
    some, more = events.where("user_id = 7").coalesce(1), events.where("user_id = 8").coalesce(1)
    some.write.parquet(f"{tmp_path}/events.parquet")
    first = adapters.user_log(spark, str(tmp_path))
    assert first.inputFiles() == adapters.user_log(spark, str(tmp_path)).inputFiles() and first.select("user_id").distinct().count() == 1
    more.write.mode("append").parquet(f"{tmp_path}/events.parquet")
    assert adapters.user_log(spark, str(tmp_path)).select("user_id").distinct().count() == 2
