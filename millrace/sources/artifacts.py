"""Content-addressed outputs: file and folder hashes, manifests with parents, lineage."""

from __future__ import annotations

import itertools
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.session import cut


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256, length) of every file below ``path``; contents are hashed where they are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.sha2("content", 256).alias("sha256"), "length")


def folder_hash(spark: SparkSession, path: str) -> str:
    """sha256 over the sorted (relative path, sha256) list of a folder: a list of files, not of their rows."""
    base = path.rstrip("/") + "/"
    rel = F.substring_index("path", base, -1)
    one = file_hashes(spark, path).agg(F.array_sort(F.collect_list(F.struct(rel.alias("path"), "sha256"))).alias("files")).select(F.sha2(F.to_json("files"), 256).alias("h")).first()
    return one["h"]


def verify(spark: SparkSession, path: str, expected: DataFrame) -> DataFrame:
    """(path, problem) of files against ``expected`` (path, sha256): missing, changed or unexpected."""
    have = file_hashes(spark, path).select(F.regexp_replace("path", "^file:/+", "/").alias("path"), F.col("sha256").alias("have"))
    j = expected.select("path", F.col("sha256").alias("want")).join(have, "path", "full_outer")
    problem = F.when(F.col("have").isNull(), "missing").when(F.col("want").isNull(), "unexpected").when(F.col("have") != F.col("want"), "changed")
    return j.withColumn("problem", problem).filter("problem is not null").select("path", "problem")


def lineage(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(node, depth): all ancestors of ``roots`` (node) over ``edges`` (node, parent), with the least depth.

    Breadth-first: each round joins the new nodes to their parents and leaves out
    what has been seen, until there are no new ones, however deep they lie.
    Cycles end by themselves.
    """
    front = roots.select("node").filter("node is not null").distinct().withColumn("depth", F.lit(0))
    seen = cut(front)
    front = seen
    links = edges.select("node", "parent").filter("node is not null and parent is not null").distinct()
    for depth in itertools.count(1):
        front = cut(front.join(links, "node").select(F.col("parent").alias("node")).distinct().join(seen, "node", "left_anti").withColumn("depth", F.lit(depth)))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def missing_parents(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, parent) links to parents that have no manifest."""
    return edges.join(nodes.select(F.col("node").alias("parent")).distinct(), "parent", "left_anti").select("node", "parent")


def latest_per_seed(runs: DataFrame, experiment: str) -> DataFrame:
    """(seed, run_id) of completed runs of one experiment; of several, the one with the last path."""
    return runs.filter((F.col("experiment") == experiment) & (F.col("status") == "completed")).groupBy("seed").agg(F.max_by("run_id", "path").alias("run_id"))


def write_artifact(df: DataFrame, path: str, kind: str, version: str, parents: list[dict] | None = None, extra: dict | None = None) -> dict:
    """``df`` as parquet below ``path`` with a manifest beside it: kind, version, location, hash of the data, parents and what else describes it.

    The data are written to a staging folder first and renamed once complete, so
    a reader never sees half of them; an existing artifact is refused.
    """
    spark = df.sparkSession
    fs, folder = _folder(spark, path)
    if fs.exists(folder):
        raise FileExistsError(path)
    df.write.mode("overwrite").parquet(f"{path}.staging/data")
    manifest = {"kind": kind, "version": version, "path": path, "sha256": folder_hash(spark, f"{path}.staging/data"), "parents": [{k: p[k] for k in ("kind", "version", "path", "sha256")} for p in parents or []], "extra": extra or {}}
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}.staging/manifest")
    if not fs.rename(_folder(spark, f"{path}.staging")[1], folder):
        raise OSError(f"could not publish {path}")
    return manifest


def read_artifact(spark: SparkSession, path: str, kind: str, versions: set[str], check: bool = True) -> tuple[DataFrame, dict]:
    """(data, manifest) of an artifact of one of ``versions``; ValueError where kind, version or hash differ."""
    manifest = json.loads(spark.read.text(f"{path}/manifest").first()["value"])
    if manifest["kind"] != kind or manifest["version"] not in versions:
        raise ValueError(f"{path} holds {manifest['kind']} {manifest['version']}, not {kind} in {sorted(versions)}")
    if check and folder_hash(spark, f"{path}/data") != manifest["sha256"]:
        raise ValueError(f"{path} is not what was written: its hash differs")
    return spark.read.parquet(f"{path}/data"), manifest


def manifest_edges(spark: SparkSession, manifests: list[dict]) -> DataFrame:
    """(node, parent) links between hashes of manifests: what ``lineage`` walks."""
    rows = [(m["sha256"], p["sha256"]) for m in manifests for p in m["parents"]]
    return spark.createDataFrame(rows, "node string, parent string")


def list_artifacts(spark: SparkSession, root: str) -> DataFrame:
    """(path, kind, version, sha256) of every artifact below ``root``."""
    found = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").text(root).select("value")
    field = lambda n: F.get_json_object("value", f"$.{n}").alias(n)
    return found.select(*map(field, ("path", "kind", "version", "sha256"))).filter("kind is not null and sha256 is not null")


def _folder(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), folder
