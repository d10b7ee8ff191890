"""Queries that write files of each kind to the shared folder and read them back, and
whole-run queries of models and the search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitpanel.operators import inference as I
from pitpanel.operators import splits
from pitpanel.plans import model, proposers, search
from pitpanel.plans.catalog import featured, query, rounded
from pitpanel.plans.queries_scores import FEATURES, scored
from pitpanel.sources import files
from pitpanel.sources import testdata as T
from pitpanel.sources.storage import materialised, new_folder

Frame = DataFrame
Spark = SparkSession
_CUSTOMERS = "SELECT c_custkey, c_name, round(c_acctbal, 6) + 0e0 AS c_acctbal FROM customer"
_SCHEMA = "c_custkey bigint, c_name string, c_acctbal double"


def customers(spark: Spark, d: str) -> Frame:
    return T.table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")


@query("src3_json_lines", _CUSTOMERS)
def src3(spark: Spark, d: str) -> Frame:
    path = new_folder(spark, "lines")
    files.append_json_lines(customers(spark, d), path)
    return rounded(files.read_json(spark, path, _SCHEMA))


@query("src4_gzip_json_lines", _CUSTOMERS)
def src4(spark: Spark, d: str) -> Frame:
    path = new_folder(spark, "gzip")
    customers(spark, d).write.option("compression", "gzip").json(path)
    return rounded(files.read_json(spark, path, _SCHEMA))


@query("src6_keyed_arrays", "SELECT r_name AS key, n_name AS name, n_nationkey AS nationkey FROM nation JOIN region ON r_regionkey = n_regionkey")
def src6(spark: Spark, d: str) -> Frame:
    """One JSON object of arrays a file, as some sources hand out their searches."""
    path = new_folder(spark, "keyed")
    nations = T.table(spark, d, "nation").join(T.table(spark, d, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    arrays = nations.groupBy("r_name").agg(F.collect_list(F.struct(F.col("n_name").alias("name"), F.col("n_nationkey").alias("nationkey"))).alias("items"))
    arrays.select(F.to_json(F.create_map("r_name", "items")).alias("value")).repartition(5, "value").write.text(path)
    return files.keyed_arrays(spark.read.text(path), "struct<name: string, nationkey: int>").select("key", "item.name", "item.nationkey")


@query("snk1_partitioned_parquet", "SELECT c_nationkey, c_custkey, c_name FROM customer WHERE c_nationkey IN (1, 2, 3)")
def snk1(spark: Spark, d: str) -> Frame:
    path = new_folder(spark, "parquet")
    files.write_parquet(T.table(spark, d, "customer"), path, ["c_nationkey"])
    return spark.read.parquet(path).filter(F.col("c_nationkey").isin(1, 2, 3)).select("c_nationkey", "c_custkey", "c_name")


@query("snk3_json_append", "SELECT o_orderkey, o_orderstatus FROM orders")
def snk3(spark: Spark, d: str) -> Frame:
    path = new_folder(spark, "append")
    orders = T.table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    for k in (0, 1):
        files.append_json_lines(orders.filter(F.col("o_orderkey") % 2 == k), path)
    return files.read_json(spark, path, "o_orderkey bigint, o_orderstatus string")


@query("snk5_checkpointed_append", "SELECT doc_id, n_chars FROM documents")
def snk5(spark: Spark, d: str) -> Frame:
    """Two runs: the second scores what the first has not."""
    path = new_folder(spark, "scores")
    docs = T.table(spark, d, "documents").select("doc_id", "n_chars")
    files.checkpointed_append(spark, docs.filter("doc_id % 3 = 0"), path, "doc_id", lambda rows: rows)
    files.checkpointed_append(spark, docs.unionByName(docs), path, "doc_id", lambda rows: rows)
    return spark.read.parquet(path)


@query("ml7_report")
def ml7(spark: Spark, d: str) -> Frame:
    """Pooled macro F1 of the model and the baselines, with intervals against each."""
    rows = materialised(featured(spark, d, True))
    out = model.report(rows, splits.walk_forward(rows), FEATURES, [0], draws=200, n_estimators=8)
    pairs = [(n, f1, *(out["comparisons"].get(n, {}).get("ci95", [None, None]))) for n, f1 in out["pooled_macro_f1"].items()]
    return spark.createDataFrame(pairs, "predictor string, macro_f1 double, low double, high double")


@query("st13_gate")
def st13(spark: Spark, d: str) -> Frame:
    v = I.decide(scored(spark, d), draws=200).to_dict()
    return spark.createDataFrame([(v["reason"], v["mean_gain"], v["dm_p"], v["signflip_p"], v["f1_p"])], "reason string, mean_gain double, dm_p double, signflip_p double, f1_p double")


@query("se1_search_run")
def se1(spark: Spark, d: str) -> Frame:
    """A short run of the search with the random proposer: a row for each trial."""
    import tempfile

    rows = materialised(featured(spark, d, True))
    cfg = proposers.SearchConfig(budget=2, seeds=(0,), placebos=0, columns=tuple(FEATURES), max_depth=2, min_valid=20, draws=100, classifier={"n_estimators": 5})
    with tempfile.TemporaryDirectory() as folder:  # the log of a driver's run
        arm = proposers.RandomArm(5, cfg)
        seen: list[proposers.Outcome] = []
        arm.observe = seen.append
        search.run_search(arm, rows, splits.walk_forward(rows), cfg, f"{folder}/run", oof=False)
    return spark.createDataFrame([(o.trial, o.formula, o.status, o.reason) for o in seen], "trial int, formula string, status string, reason string")
