import pytest

from gridloom.plans import catalog

from .oracle import connect, spark_rows, sql_rows


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_its_oracle(spark, sf_dir, con, name):
    assert spark_rows(catalog.QUERIES[name](spark, sf_dir)) == sql_rows(con, catalog.ORACLES[name])


def test_every_query_has_rows_or_an_oracle(spark, sf_dir):
    for name in sorted(set(catalog.QUERIES) - set(catalog.ORACLES)):
        assert catalog.QUERIES[name](spark, sf_dir).limit(1).count() == 1, name


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.count() == 397 and "action" in df.columns


@pytest.fixture
def uneven(spark):
    """Adaptive execution merges the small partitions of each side of a union in its own way."""
    settings = {"spark.sql.shuffle.partitions": "20", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1b", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("name", ["replica_operations", "set_if_revision"])
def test_folds_of_unions_whose_sides_are_merged_differently(spark, sf_dir, con, uneven, name):
    assert spark_rows(catalog.QUERIES[name](spark, sf_dir)) == sql_rows(con, catalog.ORACLES[name])


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_keys_are_parsed_once_and_by_all_tasks(spark, sf_dir):
    plan = optimized(catalog.QUERIES["routing_key_parse"](spark, sf_dir))
    assert plan.count("regexp_replace") <= 8 and "RepartitionByExpression" in plan


def test_transactions_read_their_lines_twice_at_most(spark, sf_dir):
    assert optimized(catalog.QUERIES["transaction_fold"](spark, sf_dir)).count("Relation [") <= 2
