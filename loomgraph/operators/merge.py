"""A table in buckets of its key: a batch rewrites the buckets that it touches, and one manifest is switched at the end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64  # of a new table; some 100 MB to 1 GB a bucket at its expected size


def _files(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the manifests that are there in full; one that is being written has another name."""
    where, files = _files(spark, f"{path}/manifests")
    if not files.exists(where):
        return []
    names = [s.getPath().getName() for s in files.listStatus(where)]
    return sorted(int(n[2:]) for n in names if n.startswith("v="))


def _switch(spark: SparkSession, path: str, version: int) -> None:
    """From here on readers see ``version``: its manifest takes its name in one step."""
    new, files = _files(spark, f"{path}/manifests/_{version}")
    if not files.rename(new, _files(spark, f"{path}/manifests/v={version}")[0]):
        raise RuntimeError(f"version {version} of {path} was not switched to")


def _bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _manifest(spark: SparkSession, path: str, version: int) -> list:
    """A row (bucket, version, rows) for each bucket that holds rows."""
    return spark.read.parquet(f"{path}/manifests/v={version}").collect()


def _read(spark: SparkSession, path: str, buckets: list) -> DataFrame:
    return spark.read.parquet(*[f"{path}/data/v={m.version}/bucket={m.bucket}" for m in buckets])


def merge_rows(batch: DataFrame, path: str, key: str, order: str, buckets: int = BUCKETS) -> dict[str, int]:
    """Writes the batch's last row (by ``order``) of each key over the table's row of that key; returns rows inserted, updated and kept.

    Only buckets of keys in the batch are read and rewritten; files of the others stay. A call that is broken off before the switch changes nothing that
    readers see, and is repeated as it is. Rows with a null key are one key. One writer at a time; ``buckets`` counts only for a new table.
    """
    spark = batch.sparkSession
    known = _versions(spark, path)
    old = _manifest(spark, path, known[-1]) if known else []
    version = known[-1] + 1 if known else 0
    if known:
        buckets = spark.read.parquet(f"{path}/meta").first()[0]
    else:
        spark.createDataFrame([(buckets,)], "buckets int").coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")
    columns = batch.columns
    last = batch.groupBy(F.col(key).alias("_key")).agg(F.max_by(F.struct(*columns), F.struct(order, F.xxhash64(*columns))).alias("_row")).select("_row.*")
    last = last.withColumn("bucket", _bucket(F.col(key), buckets))
    touched = {r.bucket for r in last.select("bucket").distinct().collect()}
    there = [m for m in old if m.bucket in touched]
    if there:
        before = _read(spark, path, there).select(*columns).withColumn("bucket", _bucket(F.col(key), buckets))
        had = before.select(F.col(key).alias("_key"), F.lit(True).alias("_had"))
        new = last.join(had, F.col(key).eqNullSafe(F.col("_key")), "left").withColumn("_change", F.when(F.col("_had"), "update").otherwise("insert")).drop("_key", "_had")
        stay = before.join(last.select(F.col(key).alias("_key")), F.col(key).eqNullSafe(F.col("_key")), "left_anti").withColumn("_change", F.lit("keep"))
        rows = new.unionByName(stay)
    else:
        rows = last.withColumn("_change", F.lit("insert"))
    rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/data/v={version}")
    found = spark.read.parquet(f"{path}/data/v={version}").groupBy("bucket", "_change").count().collect() if touched else []
    sizes: dict[int, int] = {}
    for r in found:
        sizes[r.bucket] = sizes.get(r.bucket, 0) + r["count"]
    manifest = [(m.bucket, m.version, m.rows) for m in old if m.bucket not in touched] + [(b, version, n) for b, n in sizes.items()]
    spark.createDataFrame(manifest, "bucket int, version int, rows long").coalesce(1).write.mode("overwrite").parquet(f"{path}/manifests/_{version}")
    _switch(spark, path, version)
    counts = {k: sum(r["count"] for r in found if r["_change"] == k) for k in ("insert", "update")}
    return {"inserted": counts["insert"], "updated": counts["update"], "kept": sum(n for _, _, n in manifest) - counts["insert"] - counts["update"]}


def merged(spark: SparkSession, path: str, version: int | None = None) -> DataFrame | None:
    """The rows of the latest version, or of an earlier one whose buckets are still there; None if there is no table."""
    known = _versions(spark, path)
    if not known:
        return None
    parts = _manifest(spark, path, known[-1] if version is None else version)
    if not parts:
        return spark.read.parquet(f"{path}/data/v={known[-1]}").drop("_change", "bucket")
    return _read(spark, path, parts).drop("_change", "bucket")


def merged_keys(spark: SparkSession, path: str, keys: DataFrame, key: str) -> DataFrame:
    """The rows of ``keys`` (column ``key``), read from their buckets alone."""
    known = _versions(spark, path)
    buckets = spark.read.parquet(f"{path}/meta").first()[0]
    wanted = {r[0] for r in keys.select(_bucket(F.col(key), buckets)).distinct().collect()}
    parts = [m for m in _manifest(spark, path, known[-1]) if m.bucket in wanted]
    table = merged(spark, path) if not parts else _read(spark, path, parts).drop("_change", "bucket")
    return table.join(keys.select(key).distinct(), key, "left_semi")


def clean_versions(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Deletes folders of buckets that none of the last ``keep`` manifests names, and older manifests; returns the folders deleted."""
    known = _versions(spark, path)
    live = {(m.version, m.bucket) for v in known[-keep:] for m in _manifest(spark, path, v)}
    gone = 0
    where, files = _files(spark, f"{path}/data")
    for folder in files.listStatus(where):
        version = int(folder.getPath().getName()[2:])
        if version > known[-1]:
            continue  # another writer's
        for part in files.listStatus(folder.getPath()):
            name = part.getPath().getName()
            if name.startswith("bucket=") and (version, int(name[7:])) not in live:
                files.delete(part.getPath(), True)
                gone += 1
    for v in known[:-keep]:
        files.delete(_files(spark, f"{path}/manifests/v={v}")[0], True)
    return gone
