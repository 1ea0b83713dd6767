"""Skew-safe "group broadcast" (pandas ``groupby().transform``) for row-level
results.

A window partitioned by customer puts every row of one customer in one task;
if one customer holds a third of the rows, that task holds a third of the job.
Here per-key statistics are first computed with ``groupBy`` (map-side partial
aggregation, so a hot key costs nothing extra), then joined back to the rows:

* a key is *hot* when it holds more than one ``shares``-th of all rows, so
  there are fewer than ``shares`` hot keys whatever the data: the broadcast of
  the hot-key list is bounded by arithmetic, without a limit;
* a hot key with the share ``f`` of the rows gets ``ceil(f * shares)`` salts:
  its rows are spread by a hash of row columns and its statistics row is
  replicated as often (at most ``2 * shares`` more rows in total); other keys
  use salt 0;
* the join on ``(keys, salt)`` is null-safe and left to Spark's own choice of
  physical join.

The rule has no absolute size, so it acts alike at every scale.  The salt is a
pure function of the row, so a recomputed task after an executor loss sends
every row to the same place, and filters still push down through it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROWS_COL = "_rows"
SHARES = 1000


class KeySalting:
    """Which keys are hot and how many salts each gets.  Built from
    one-row-per-key ``stats`` carrying ``_rows``."""

    def __init__(self, stats: DataFrame, keys: Sequence[str], shares: int = SHARES):
        self.keys = list(keys)
        total = stats.agg(F.sum(ROWS_COL)).scalar()
        share = F.col(ROWS_COL) * F.lit(shares) / total
        self.hot = stats.where(share > 1).select(
            *[F.col(k).alias(f"_hot_{k}") for k in self.keys], F.ceil(share).cast("int").alias("_nsalt"))

    def _tagged(self, df: DataFrame) -> DataFrame:
        on = F.lit(True)
        for k in self.keys:
            on = on & df[k].eqNullSafe(F.col(f"_hot_{k}"))
        return df.join(F.broadcast(self.hot), on, "left").drop(*[f"_hot_{k}" for k in self.keys])

    def salt_rows(self, rows: DataFrame, salt_by: Sequence[str]) -> DataFrame:
        """``rows`` plus ``_salt``: a hash of the columns ``salt_by`` modulo the
        key's salt count for hot keys, 0 for the rest."""
        salt = F.when(F.col("_nsalt").isNotNull(), F.pmod(F.xxhash64(*salt_by), F.col("_nsalt"))).otherwise(F.lit(0))
        return self._tagged(rows).withColumn("_salt", salt.cast("int")).drop("_nsalt")

    def fan_out(self, stats: DataFrame) -> DataFrame:
        """One copy of each hot key's statistics row per salt."""
        salts = F.sequence(F.lit(0), F.coalesce(F.col("_nsalt"), F.lit(1)) - 1)
        return self._tagged(stats).withColumn("_salt", F.explode(salts)).drop("_nsalt")


def attach_key_stats(rows: DataFrame, stats: DataFrame, keys: Sequence[str], salt_by: Sequence[str],
                     shares: int = SHARES) -> DataFrame:
    """Left-join one-row-per-key ``stats`` (which must carry ``_rows``, the
    row count of the key in ``rows``) onto ``rows``; hot keys are spread by a
    hash of the row columns ``salt_by``."""
    ks = KeySalting(stats, keys, shares)
    right = ks.fan_out(stats).withColumnsRenamed({k: f"_key_{k}" for k in [*ks.keys, "_salt"]})
    on = F.col("_salt") == F.col("_key__salt")
    for k in ks.keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_key_{k}"))
    return ks.salt_rows(rows, salt_by).join(right, on, "left").drop("_salt", *[f"_key_{k}" for k in [*ks.keys, "_salt"]])
