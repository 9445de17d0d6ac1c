"""Hot accounts: find them, split their timelines, salt their lookups.

An account is hot when it has more than ``CHUNK_ROWS`` legs, whatever the size of the book,
so no chunk of a timeline grows with it. Hot accounts and the boundaries of their chunks are
tables in the shared folder; they are joined like any other, and the optimizer broadcasts them
only while their size allows it. Boundaries are quantiles, ``FAN`` slices at a time: a slice
that is still too large is cut again, so chunks hold about equally many rows at any scale.
Quantiles of time cannot part the rows of one instant (dates without a clock, say); an operator
that knows the order within an instant has such a chunk cut along that order.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stage import stage

CHUNK = "_chunk"
SALT = "_salt"
CHUNK_ROWS = 2_000_000
NULL_PARTS = 1024  # over which rows without an account are dealt
FAN = 64  # slices that one level of boundaries makes
PARTS = 1024  # into which a crowded chunk is cut at most
CROWDED = 4  # times the rows meant for it: a leg may stand on a timeline with its probes
SAMPLED = 16  # rows of a crowded chunk behind each of its cuts


@dataclass(frozen=True)
class HotKeys:
    """``keys(_hot_key, _parts)``: hot accounts and into how many parts their rows go.

    ``levels(_hot_key, _slice, _cuts)``: the time boundaries inside a slice, level by level.
    """

    keys: DataFrame | None = None
    levels: tuple[DataFrame, ...] = ()
    fan: int = FAN
    rows: int = CHUNK_ROWS

    def __bool__(self) -> bool:
        return self.keys is not None

    def split(self, df: DataFrame, account: str = "account", us: str = "us") -> DataFrame:
        """Add the chunk number: -1 for ordinary accounts, else growing with time.

        Chunks are monotone in ``us``, so per-chunk work plus a carried total equals
        the work over the whole timeline wherever the boundaries happen to lie.
        """
        out = df.withColumn(CHUNK, F.lit(-1).cast("bigint"))
        for level, table in enumerate(self.levels):
            first = F.when(F.col("_hot_key").isNull(), F.lit(-1)).otherwise(F.lit(0))
            out = _sliced(out, table, account, us, first if level == 0 else F.col(CHUNK), self.fan)
        return out

    def split_in_order(
        self, df: DataFrame, keys: list[str], order: list[str], backwards: bool = False
    ) -> DataFrame:
        """:meth:`split`, then cut what is still crowded along the whole ``order``.

        ``order`` starts with the time, which runs from late to early if ``backwards``, and tells
        rows of one instant apart as the caller will sort them. Chunk numbers grow with time; read
        backwards they follow the order. Cuts come from a bounded sample of each crowded chunk.
        """
        out = self.split(df, us=order[0])
        if not self:
            return out
        out = stage(out, "chunks")
        place = F.struct((-F.col(order[0]) if backwards else F.col(order[0])).alias("us"), *order[1:])
        counts = out.filter(F.col(CHUNK) >= 0).groupBy(*keys, CHUNK).agg(F.count(F.lit(1)).alias("_n"))
        crowded = stage(counts.filter(F.col("_n") > CROWDED * self.rows), "crowded")
        if crowded.isEmpty():
            return out
        parts = F.least(F.lit(PARTS), F.ceil(F.col("_n") / self.rows)).cast("int")
        draw = F.pmod(F.xxhash64(*df.columns), F.lit(1 << 30)) / float(1 << 30)
        sampled = out.join(crowded, [*keys, CHUNK]).filter(draw * F.col("_n") < parts * SAMPLED)
        listed = sampled.groupBy(*keys, CHUNK).agg(F.array_sort(F.collect_list(place)).alias("_all"))
        cuts = listed.select(
            *keys, CHUNK, F.filter("_all", lambda _, i: i % SAMPLED == SAMPLED - 1).alias("_cuts")
        )
        behind = F.coalesce(F.size(F.filter("_cuts", lambda cut: cut <= place)), F.lit(0))
        sub = F.least(behind, F.lit(PARTS * SAMPLED - 1))
        sub = PARTS * SAMPLED - 1 - sub if backwards else sub
        finer = F.when(F.col(CHUNK) < 0, F.col(CHUNK)).otherwise(F.col(CHUNK) * PARTS * SAMPLED + sub)
        return out.join(cuts, [*keys, CHUNK], "left").withColumn(CHUNK, finer).select(*out.columns)

    def lookup(self, df: DataFrame, key: str, dim: DataFrame, dim_key: str) -> DataFrame:
        """Left join to a table with one row per account, hot accounts salted.

        Only the hot rows of ``dim`` are repeated, once per part of their account.
        """
        if not self:
            return df.join(dim, F.col(key) == F.col(dim_key), "left").drop(dim_key)
        # rows without a key match nothing and may lie anywhere
        into = F.when(F.col(key).isNull(), NULL_PARTS).otherwise(F.coalesce("_parts", F.lit(1)))
        salt = F.pmod(F.xxhash64(*df.columns), into)
        rows = (
            df.join(self.keys, F.col(key) == F.col("_hot_key"), "left")
            .withColumn(SALT, salt)
            .drop("_hot_key", "_parts")
        )
        parts = F.sequence(F.lit(0).cast("bigint"), F.coalesce("_parts", F.lit(1)) - 1)
        copies = (
            dim.join(self.keys, F.col(dim_key) == F.col("_hot_key"), "left")
            .withColumn("_dim_salt", F.explode(parts))
            .drop("_hot_key", "_parts")
        )
        on = (F.col(key) == F.col(dim_key)) & (F.col(SALT) == F.col("_dim_salt"))
        return rows.join(copies, on, "left").drop(dim_key, "_dim_salt", SALT)


def _sliced(
    df: DataFrame, table: DataFrame, account: str, us: str, chunk: Column, fan: int
) -> DataFrame:
    """Every slice becomes ``fan`` finer ones; ordinary rows keep -1."""
    on = F.col(account) == F.col("_hot_key")
    joined = df.join(table, on & (F.greatest(CHUNK, F.lit(0)) == F.col("_slice")), "left")
    cuts = F.col("_cuts")
    slot = F.size(F.filter(cuts, lambda b: b <= F.col(us))) - 1
    slot = F.coalesce(F.least(F.greatest(slot, F.lit(0)), F.size(cuts) - 2), F.lit(0))
    finer = F.when(chunk < 0, F.lit(-1)).otherwise(F.greatest(chunk, F.lit(0)) * fan + slot)
    return joined.withColumn(CHUNK, finer.cast("bigint")).drop("_hot_key", "_slice", "_cuts")


def find_hot(
    df: DataFrame,
    accounts: tuple[str, ...] = ("sender_account", "receiver_account"),
    us: str | None = "us",
    rows: int = CHUNK_ROWS,
    fan: int = FAN,
) -> HotKeys:
    """Hot accounts of a book, counted over both legs.

    One narrow pass with map-side counts; further ones, over the hot rows only, when there
    are any. The boundaries steer balance, never results; without ``us`` only the accounts
    are found, for lookups. An unknown account is nobody's timeline and never hot.
    """
    clock = F.col(us) if us else F.lit(0).cast("bigint")
    legs = df.select(F.explode(F.array(*accounts)).alias("account"), clock.alias("us")).filter(
        "account IS NOT NULL"
    )
    counts = legs.groupBy("account").agg(F.count(F.lit(1)).alias("n"))
    top = counts.agg(F.max("n")).first()[0] or 0
    if top <= rows:
        return HotKeys()
    parts = F.ceil(F.col("n") / F.lit(rows)).alias("_parts")
    keys = stage(counts.filter(F.col("n") > rows).select(F.col("account").alias("_hot_key"), parts), "hot")
    levels: list[DataFrame] = []
    timed = legs.join(keys.select(F.col("_hot_key").alias("account")), "account", "left_semi")
    quantiles = [i / fan for i in range(fan + 1)]
    while us and top > rows:
        placed = HotKeys(keys, tuple(levels), fan, rows).split(timed)
        slices = placed.groupBy("account", F.greatest(CHUNK, F.lit(0)).alias("_slice")).agg(
            F.count(F.lit(1)).alias("n"),
            F.percentile_approx("us", quantiles, 1_000).alias("q"),
            F.min("us").alias("lo"),
            F.max("us").alias("hi"),
        )
        inner = F.array_distinct(F.filter("q", lambda b: (b > F.col("lo")) & (b < F.col("hi"))))
        cut = slices.filter((F.col("n") > rows) & (F.col("hi") > F.col("lo"))).select(
            F.col("account").alias("_hot_key"),
            "_slice",
            F.concat(F.array("lo"), inner, F.array("hi")).alias("_cuts"),
            "n",
        )
        table = stage(cut, "hot-cuts")
        largest = table.agg(F.max("n")).first()[0]
        if not largest:
            break  # what is left are rows of one instant, see HotKeys.split_in_order
        levels.append(table.drop("n"))
        top = -(-largest // fan)
    return HotKeys(keys, tuple(levels), fan, rows)
