"""Physical plans keep the shape they were designed for."""

import pytest
from pyspark.sql import functions as F

from pictorium.operators import dedup as D
from pictorium.operators import graph, ingest, search
from pictorium.plans import scratch
from pictorium.sources import adapters as A
from pictorium.sources import sinks


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_exact_dedup_limits_groups_before_the_shuffle(spark, data):
    docs = A.table(spark, data, "documents").select(F.col("doc_id").alias("seq"), F.sha2("text", 256).alias("file_hash"))
    assert "WindowGroupLimit" in plan(ingest.exact_dedup(docs, docs.limit(0)))


def test_batch_search_and_neighbours_keep_k_rows_per_task(spark, data):
    assets = A.assets(spark, data)
    queries = A.table(spark, data, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    assert "WindowGroupLimit" in plan(search.search_many(search.build_index(assets), assets, queries, 5))
    edges = spark.createDataFrame([("a", "b", "semantic", 1.0)], "source_id string, target_id string, edge_type string, weight double")
    asked = spark.createDataFrame([("a",)], "node string")
    assert "WindowGroupLimit" in plan(graph.neighbours_many(asked, edges, 3))


def test_index_build_has_no_text_shuffle(spark, tmp_path, data):
    A.assets(spark, data).write.parquet(str(tmp_path / "assets"))
    built = plan(search.build_index(spark.read.parquet(str(tmp_path / "assets"))))
    assert "Exchange" not in built and "ReadSchema: struct<id:bigint,ai_tags:array<string>,ai_description:string" in built


def test_search_pushes_terms_and_prunes(spark, tmp_path, data):
    path = str(tmp_path / "index")
    search.write_index(search.build_index(A.assets(spark, data)), path)
    read = spark.read.parquet(path).filter(F.col("term").isin("clean", "src1")).select("image_id", "weight")
    assert "In(term" in plan(read) and "field" not in plan(read)


def test_fingerprint_is_computed_once(spark, data):
    from pictorium.operators.dedup import fingerprints

    assert plan(fingerprints(A.assets(spark, data, fingerprint=True))).count("regexp_extract_all") == 1


class Session:
    """The two things the scratch folder depends on."""

    def __init__(self, master, configured=None, context_dir=None):
        self.conf = type("Conf", (), {"get": lambda _, key, default: configured if key == "spark.checkpoint.dir" else default})()
        self.sparkContext = type("Context", (), {"master": master, "applicationId": "x", "getCheckpointDir": lambda _: context_dir})()


def test_scratch_folder(spark):
    assert scratch.shared_dir(Session("yarn", "s3://shared/x")) == "s3://shared/x"
    assert scratch.shared_dir(Session("yarn", None, "hdfs:///c")) == "hdfs:///c"
    with pytest.raises(RuntimeError):
        scratch.shared_dir(Session("yarn"))
    table, seen = scratch.Scratch(spark, "t").write(spark.range(5), n=F.count(F.lit(1)))
    assert seen["n"] == 5 and table.count() == 5


@pytest.mark.parametrize("name", ["functions", "operators", "sources", "streaming", "plans"])
def test_packages_exist(name):
    __import__(f"pictorium.{name}")


def test_scan_broadcasts_nothing_of_its_rows(spark):
    """Small as they are, the tables of a scan are shuffled: broadcast, they would grow in the driver with the library."""
    rows = [(k, f"{(k // 3) * 7:016x}", "completed") for k in range(60)]
    scan = D.scan_duplicates(spark.createDataFrame(rows, "id long, phash string, ai_status string"), 2)
    kept = D.plan_retention(scan.members().selectExpr("*", "1 width", "1 height", "id file_size"))
    left = D.apply_deletions(kept, assets=(scan.prints, "id"))["assets"]
    for frame in (scan.members(), scan.groups(), scan.member_distances(), sinks.dedup_report(scan), kept, left):
        shape = plan(frame)
        assert "SortMergeJoin" in shape and "BroadcastHashJoin" not in shape
