"""Caches as keyed tables: freshness, latest entry, eviction, and tables named by their content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .routing import numbered


def fresh(entries: DataFrame, now: Column, ttl_seconds: int, time: str = "created_at") -> DataFrame:
    return entries.where(F.col(time) >= now - F.make_dt_interval(secs=F.lit(ttl_seconds)))


def latest(entries: DataFrame, key: str = "key", time: str = "created_at", tie: str = "entry") -> DataFrame:
    """An upsert's view of an append-only table: the last entry of each key."""
    rest = [c for c in entries.columns if c != key]
    return entries.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(time, tie)).alias("r")).select(key, "r.*").select(*entries.columns)


def evict(entries: DataFrame, most: int, used: str = "accessed_at", tie: str = "entry", key: str = "key") -> DataFrame:
    """The ``most`` entries that were used last: a top-k, which no task sorts in full."""
    return entries.orderBy(F.col(used).desc(), F.col(tie).desc()).limit(most)


def evict_share(entries: DataFrame, share: int = 4, used: str = "accessed_at", tie: str = "entry", by: str | None = None) -> DataFrame:
    """Without the oldest 1/share (rounded down) of all entries, or of each group of ``by``."""
    if by is None:
        size = entries.agg(F.floor(F.count("*") / share).alias("__gone"))  # one row
        return numbered(entries, [used, tie], "__r").crossJoin(F.broadcast(size)).where("__r >= __gone").drop("__r", "__gone")
    w, all_of = Window.partitionBy(by).orderBy(used, tie), Window.partitionBy(by)
    return entries.withColumn("__r", F.row_number().over(w)).withColumn("__n", F.count("*").over(all_of)).where(F.col("__r") > F.floor(F.col("__n") / share)).drop("__r", "__n")


def put(entries: DataFrame, new: DataFrame, key: str = "key") -> DataFrame:
    """entries with the new ones in the place of those of the same key; the caller writes the result."""
    return entries.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def delete(entries: DataFrame, keys: DataFrame, key: str = "key") -> DataFrame:
    return entries.join(keys.select(key).distinct(), key, "left_anti")


def clear(entries: DataFrame) -> DataFrame:
    return entries.limit(0)


def two_levels(requests: DataFrame, near: DataFrame, far: DataFrame, now: Column, ttl_seconds: int, most: int, key: str = "key") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(hits with their level, misses, the near level afterwards). A request is looked up in the near level and
    then in the far one; what the far one has moves up, and the near level keeps its ``most`` last used entries."""
    live_near, live_far = fresh(near, now, ttl_seconds), fresh(far, now, ttl_seconds)
    first, rest = lookup(requests, live_near, key)
    second, misses = lookup(rest, live_far, key)
    moved = live_far.join(rest.select(key).distinct(), key, "left_semi").withColumn("accessed_at", now)
    used = live_near.join(requests.select(key).distinct(), key, "left_semi").withColumn("accessed_at", now)
    hits = first.withColumn("level", F.lit(1)).unionByName(second.withColumn("level", F.lit(2)))
    return hits, misses, evict(put(live_near, used.unionByName(moved), key), most)


def statistics(entries: DataFrame, now: Column, ttl_seconds: int, size: str = "size_bytes", time: str = "created_at") -> DataFrame:
    live = F.col(time) >= now - F.make_dt_interval(secs=F.lit(ttl_seconds))
    return entries.agg(F.count("*").alias("entries"), F.sum(size).alias("total_size"), F.count_if(live).alias("active"))


def lookup(requests: DataFrame, entries: DataFrame, key: str = "key") -> tuple[DataFrame, DataFrame]:
    """(hits with their values, misses). An empty value is a hit: only an absent key is a miss."""
    return requests.join(entries, key), requests.join(entries.select(key), key, "left_anti")


def batch_key(names: Column, references: Column) -> Column:
    """A key that depends on what a batch holds and not on its order."""
    return F.md5(F.concat_ws("|", F.array_join(F.array_sort(names), "\n"), references.cast("string")))


def content_hash(df: DataFrame) -> str:
    """A name for what a table holds, in any order of rows: count and sum of row hashes."""
    row = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).alias("h")).first()
    return f"{row.n:x}-{int(row.h or 0) & (1 << 96) - 1:x}"


def materialized(df: DataFrame, built: DataFrame, root: str, name: str) -> DataFrame:
    """``built`` as a table under the content of ``df``, written only if that content is new."""
    spark = df.sparkSession
    path = f"{root.rstrip('/')}/{name}/{content_hash(df)}"
    done = spark._jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        built.write.mode("overwrite").parquet(path)
    return spark.read.schema(built.schema).parquet(path)
