import pytest

from siltstone import session


def test_cut_and_clear(spark):
    df = session.cut(spark.range(5))
    assert df.count() == 5 and "LogicalRDD" not in df._jdf.queryExecution().optimizedPlan().toString()
    session.clear(spark)
    again = session.cut(spark.range(3))
    assert again.count() == 3


def test_shared_folder_is_kept(spark):
    assert session.shared_dir(spark) == session.shared_dir(spark)


def test_spread_leaves_many_partitions_alone(spark):
    df = spark.range(0, 100, 1, 50)
    assert session.spread(df) is df
    assert session.spread(spark.range(0, 100, 1, 1)).rdd.getNumPartitions() >= 2


def test_no_local_folder_on_a_cluster():
    class Context:
        master = "spark://host:7077"

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(ValueError):
        session.shared_dir(Session())


def test_entry_does_not_hide_errors():
    """The optional subpackage is looked for; an error within it comes out."""
    import pathlib

    text = (pathlib.Path(__file__).parent.parent / "__spark_entry__.py").read_text()
    assert "find_spec" in text and "except" not in text
