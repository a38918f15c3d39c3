import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry_module
from conftest import SF

CHECKED = [
    "flagship_split_frequencies", "sp1_stratified_exact", "sp7_batches", "a6_combine_annotators",
    "c2_clean_tweet", "c1_clean_basic_decorated", "w3_gap_weights", "m6_emd_loss", "m10_expected_vad",
    "a23_evaluate_multi", "a23_evaluate_single", "t1_input_ids", "m20_bigram_loss", "s3_combined_from_files",
    "g6_model_batches", "k3_result_log", "s11_lexicon", "a13_class_report_lines",
]


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def ordered(rows, columns):
    index = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(r[i] + 0.0 if isinstance(r[i], float) else r[i] for i in index) for r in rows]
    return sorted(columns), sorted(out, key=lambda r: [(x is None, str(type(x)), 0 if x is None else x) for x in r])


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_its_sql(spark, tables, name):
    df = entry_module.queries()[name](spark, SF)
    got = ordered(df.collect(), df.columns)
    result = tables.execute(entry_module.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert got == ordered(result.fetchall(), columns)


def test_entry(spark):
    df = entry_module.entry(spark)
    assert df.columns == ["lang", "train", "valid", "test"] and df.count() > 0


def test_every_sql_has_a_query():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["sp1_stratified_exact", "sp2_stratified_shares", "sp3_train_valid", "sp4_shuffle_cut"])
def test_splits_do_not_shuffle_rows(spark, name):
    plan = plan_of(entry_module.queries()[name](spark, SF))
    assert "Exchange hashpartitioning" not in plan and "SinglePartition" not in plan


@pytest.mark.parametrize("name, columns", [
    ("a1_value_counts", "struct<lang:string>"), ("a11_pearson", "struct<embedding:array<float>>"),
    ("sp3_train_valid", "struct<event_id:bigint>"),
])
def test_scans_read_only_what_they_use(spark, name, columns):
    plan = plan_of(entry_module.queries()[name](spark, SF))
    assert columns in plan or columns.replace("struct<", "struct<vec_id:bigint,") in plan


def test_filters_reach_the_scan(spark):
    assert "PushedFilters: [IsNotNull(event_id), GreaterThan(event_id" in plan_of(entry_module.queries()["p6_skip_rows"](spark, SF))
    assert "In(o_orderstatus" in plan_of(entry_module.queries()["p2_filter_relabel"](spark, SF))


def test_lexicon_hashes(spark):
    assert "SortAggregate" not in plan_of(entry_module.queries()["s11_lexicon"](spark, SF))


class Conf:
    def __init__(self, folder, master):
        self.conf, self.sparkContext, self.master = self, self, master
        self.folder = folder

    def get(self, key, default=None):
        assert key == "spark.checkpoint.dir"
        return self.folder or default


def test_shared_folder_comes_from_the_session(spark):
    from affectlake.session import saved, shared_folder

    assert shared_folder(Conf("/shared/x/", "yarn")).startswith("/shared/x/")
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_folder(Conf(None, "yarn"))
    own = [shared_folder(Conf(None, "local[2]")) for _ in range(2)]
    assert own[0] != own[1] and os.path.dirname(own[0]) == os.path.dirname(own[1])
    assert saved(spark.range(3)).count() == 3


def test_small_tables_are_spread_and_large_ones_are_not(spark):
    from affectlake.session import spread

    df = spark.read.parquet(f"{SF}/documents.parquet")
    assert "REPARTITION_BY_NUM" in plan_of(spread(df, "doc_id"))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1024")
    try:
        assert "Exchange" not in plan_of(spread(df, "doc_id"))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
