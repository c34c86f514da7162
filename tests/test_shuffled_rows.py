"""Statistics of ensembles shuffle the table's rows for its own joins alone; rows of groups are counted where they lie."""

import pytest
from pyspark.sql import functions as F

from tidewell.operators import ensemble
from tidewell.plans import reports, sets  # noqa: F401  register their queries
from tidewell.plans.catalog import QUERIES

DATA = "/root/testdata/sf0.01"


def shuffled(spark, run):
    """Records that all stages of ``run`` write to shuffles."""
    sc = spark.sparkContext._jsc.sc()

    def written():
        sc.listenerBus().waitUntilEmpty()
        stages = sc.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = written()
    run()
    return written() - before


@pytest.fixture(scope="module")
def few_groups(spark, tmp_path_factory):
    """Tables of which few groups come, as in tables so large that each task holds many rows of a group."""
    folder = str(tmp_path_factory.mktemp("few"))
    for t in ("nation", "region", "lineitem"):
        spark.read.parquet(f"{DATA}/{t}.parquet").write.parquet(f"{folder}/{t}.parquet")
    spark.read.parquet(f"{DATA}/orders.parquet").withColumn("o_orderpriority", F.lit("1-URGENT")).write.parquet(f"{folder}/orders.parquet")
    customers = spark.read.parquet(f"{DATA}/customer.parquet").withColumns({"c_nationkey": F.lit(3), "c_mktsegment": F.when(F.col("c_custkey") % 2 == 0, "A").otherwise("B")})
    customers.write.parquet(f"{folder}/customer.parquet")
    return folder


@pytest.mark.parametrize("name", ["culvert_stat_median", "workflow_culvert_statistics", "critical_duration_median", "mean_by_group", "mean_max", "workflow_mean_report", "nway_outer"])
def test_rows_are_shuffled_for_joins_alone(spark, few_groups, name):
    rows = spark.read.parquet(f"{few_groups}/lineitem.parquet").count()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20k")
    try:
        assert shuffled(spark, QUERIES[name](spark, few_groups).collect) < 3 * rows
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_many_groups_are_shuffled_with_the_same_result(spark, monkeypatch):
    df = spark.sql("""SELECT concat('g', id % 7) AS k, if(id % 11 = 0, null, cast(id * 37 % 90 AS double) - 20) AS v,
        concat('TP', id % 3) AS tp, concat('n', id) AS name FROM range(500)""")
    ways = []
    for few in (ensemble.FEW, 0):
        monkeypatch.setattr(ensemble, "FEW", few)
        stats = [ensemble.ensemble_statistics(df, ["k"], "v", "tp", "name"), *(ensemble.statistic_of_columns(df, ["k"], ["v"], s, "v", "name") for s in ("mean", "median"))]
        ways.append([sorted(map(tuple, s.drop("mean_including_zeroes", "mean_excluding_zeroes", "v_mean").collect())) for s in stats])
    assert ways[0] == ways[1]
    assert all(len(s) == 7 for s in ways[0])
