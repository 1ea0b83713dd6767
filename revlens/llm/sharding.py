"""Sharding over fixed virtual slots (operator 10).

Every record is hashed into one of ``slots`` virtual slots; bytes and rows are
aggregated per slot; a versioned slot-to-shard map, stored as Parquet, says
where a slot lives.  Its first version deals the slots out in turn, before any
size is known; rebalancing edits the newest version by the slots' bytes and adds
the next one, in which whole slots have moved.  Only the map (one row per slot, a
fixed number) is edited on the driver.

Defined cases: a null text has no bytes; the hash takes id and text, so neither
a hot id nor a group of copies fills one slot; rows that repeat in full share
a slot and get consecutive places; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .runtime import written

SLOTS = 4096
TOLERANCE = 0.0005     # of the mean of a shard's bytes
MAP_SCHEMA = "version int, vslot int, shard int"


def records(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """``doc_id, size, text_crc32, vslot`` of every row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(
        "doc_id", (F.octet_length(text) + F.lit(8)).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.pmod(F.xxhash64("doc_id", text), F.lit(slots)).cast("int").alias("vslot"))


def slot_weights(recs: DataFrame) -> dict[int, tuple[int, int]]:
    """Bytes and rows of each used slot (at most ``slots`` rows)."""
    rows = recs.groupBy("vslot").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).collect()
    return {r["vslot"]: (r["size"], r["n"]) for r in rows}


def dealt_map(shards: int, slots: int = SLOTS) -> list[int]:
    """Slot-to-shard map that deals the slots out in turn."""
    return [v % shards for v in range(slots)]


def rebalanced_map(current: list[int], weights: dict[int, tuple[int, int]], shards: int,
                   tolerance: float = 0.01) -> list[int]:
    """``current`` edited for ``shards`` shards: slots of shards that no longer
    exist, and slots of overfull ones, go to the emptiest shard until none is
    over the mean by more than ``tolerance`` or neither a move nor a swap of two
    slots between the fullest and the emptiest helps."""
    out = list(current)
    size = {v: weights.get(v, (0, 0))[0] for v in range(len(out))}
    load = [0] * shards
    for v, s in enumerate(out):
        if s < shards:
            load[s] += size[v]
    for v in sorted((v for v, s in enumerate(out) if s >= shards), key=lambda v: (-size[v], v)):
        out[v] = min(range(shards), key=lambda s: (load[s], s))
        load[out[v]] += size[v]
    limit = (1 + tolerance) * sum(load) / shards
    owned: list[set[int]] = [set() for _ in range(shards)]
    for v, s in enumerate(out):
        owned[s].add(v)
    for _ in range(len(out)):
        a = max(range(shards), key=lambda s: (load[s], -s))
        b = min(range(shards), key=lambda s: (load[s], s))
        fits = [v for v in owned[a] if 0 < size[v] < load[a] - load[b]]
        if load[a] <= limit:
            break
        half = (load[a] - load[b]) / 2
        if fits:
            moves = [(min(fits, key=lambda v: (abs(size[v] - half), v)), a, b)]
        else:
            swaps = [(abs(size[x] - size[y] - half), x, y) for x in owned[a] for y in owned[b]
                     if 0 < size[x] - size[y] < load[a] - load[b]]
            if not swaps:
                break
            _, x, y = min(swaps)
            moves = [(x, a, b), (y, b, a)]
        for v, old, new in moves:
            owned[old].remove(v)
            owned[new].add(v)
            out[v] = new
            load[old] -= size[v]
            load[new] += size[v]
    return out


def store_map(spark: SparkSession, path: str, version: int, shard_of: list[int]) -> DataFrame:
    """Add a version to the stored map; earlier versions stay readable."""
    rows = [(version, v, s) for v, s in enumerate(shard_of)]
    spark.createDataFrame(rows, MAP_SCHEMA).coalesce(1).write.mode("append").partitionBy("version").parquet(path)
    return load_map(spark, path, version)


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A version of the map, the newest unless one is named."""
    table = spark.read.schema(MAP_SCHEMA).parquet(path)
    if version is None:
        version = table.agg(F.max("version")).first()[0]
    return table.where(F.col("version") == version)


def newest_version(spark: SparkSession, path: str) -> int:
    """The newest stored version, 0 where there is no map."""
    try:
        return spark.read.schema(MAP_SCHEMA).parquet(path).agg(F.max("version")).first()[0] or 0
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return 0


def rebalance(spark: SparkSession, path: str, weights: dict[int, tuple[int, int]], shards: int,
              slots: int = SLOTS) -> tuple[int, list[int]]:
    """The newest version of the stored map after an edit by the bytes of
    its slots.  Where there is no map yet, the first version is stored before; an
    edit that moves nothing adds no version."""
    version = newest_version(spark, path)
    if not version:
        version = 1
        store_map(spark, path, version, dealt_map(shards, slots))
    stored = {r["vslot"]: r["shard"] for r in load_map(spark, path, version).collect()}   # ``slots`` rows
    if sorted(stored) != list(range(slots)):
        raise ValueError(f"the map at {path} has {len(stored)} slots, not {slots}")
    current = [stored[v] for v in range(slots)]
    edited = rebalanced_map(current, weights, shards, TOLERANCE)
    if edited != current:
        version += 1
        store_map(spark, path, version, edited)
    return version, edited


def shard(docs: DataFrame, map_path: str, shards: int = 24, slots: int = SLOTS) -> DataFrame:
    """``doc_id, size, text_crc32, vslot, shard, slot, version``: the shard of
    each row by the newest map, its place there, gapless from 0, and that map's
    version.  Places are counted within a virtual slot and moved by the rows of
    the shard's earlier slots, so no task orders a whole shard."""
    spark = docs.sparkSession
    recs = written(records(docs, slots), "records")
    weights = slot_weights(recs)
    version, shard_of = rebalance(spark, map_path, weights, shards, slots)
    before, base = [0] * shards, []
    for v in range(slots):
        base.append((v, before[shard_of[v]]))
        before[shard_of[v]] += weights.get(v, (0, 0))[1]
    bases = spark.createDataFrame(base, "vslot int, base long")
    mapped = load_map(spark, map_path, version).join(bases, "vslot")
    within = Window.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size")
    # One row per slot on the map's side, whatever the number of records.
    return (recs.withColumn("at", F.row_number().over(within) - 1).join(F.broadcast(mapped), "vslot")
            .select("doc_id", "size", "text_crc32", "vslot", "shard", (F.col("base") + F.col("at")).alias("slot"), "version"))
