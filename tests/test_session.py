import pytest

from deltaloom import session


class Elsewhere:
    """A session whose tasks run on other machines."""

    class conf:  # noqa: N801
        get = staticmethod(lambda key, default: default)

    class sparkContext:  # noqa: N801
        master = "spark://host:7077"


def test_no_folder_of_this_machine_on_a_cluster():
    with pytest.raises(ValueError):
        session.shared_dir(Elsewhere())


def test_staging_restores_the_setting_and_gives_the_rows(spark):
    before = spark.conf.get(session.SHUFFLE_CLEANUP, None)
    df = session.staged(spark.range(100).selectExpr("id % 7 AS k", "id").groupBy("k").agg({"id": "sum"}), "t")
    assert df.count() == 7 and df.select("k").distinct().count() == 7
    assert spark.conf.get(session.SHUFFLE_CLEANUP, None) == before


def test_discarded_tables_are_gone(spark):
    df = session.staged(spark.range(10).selectExpr("id", "id % 2 AS k"), "t", ["k"])
    session.discard(df, "k=1")
    assert spark.read.parquet(df._staged_at).count() == 5
    session.discard(df)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(df._staged_at)
