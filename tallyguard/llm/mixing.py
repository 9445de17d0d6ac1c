"""Mix sources to target weights: hash-ordered documents, cut at each source's exact budget.

Targets by water filling: every source gets a share of all words by weight, none more than
``epochs`` times its own words; the excess goes to the others by weight. A source whose target
exceeds its words is repeated in whole epochs; the rest of the target is a prefix of the
source's documents in the order of a hash key. Prefix sums are distributed: keys fall into
ranges of bounded size, ranges are summed, and a row's position is the total of the ranges
before its own plus the running sum inside it. So a source with a third of all rows is many
ranges like any other. The document at the cut is taken in part, which makes the words taken
equal the rounded target.

Size is the number of words; a null text has none. A null source is a source of its own, last
in order. Documents without words are never taken. Repeated rows are documents each; rows that
are equal in id and text tie, and since they are alike it does not matter which is cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.stage import stage
from .text import SPACE, let, word_count

WEIGHTS = (5, 2, 1)  # of the sources by code point, repeating
EPOCHS = 3
RANGE_ROWS = 10_000  # rows in one range of keys, with their texts where those are drawn


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """``sizes(source, source_size, rows)``, one row per source, with its ``target``.

    With the caps in order of cap / weight, the level is found where the words that remain,
    divided by the weights that remain, no longer exceed the next ratio. One small row per
    source passes through a single window task.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    listed = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sizes.withColumn(
        "_w", F.get(listed, ((F.row_number().over(order) - 1) % len(weights)).cast("int"))
    ).withColumn("_cap", epochs * F.col("source_size").cast("double"))
    filling = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    everything = filling.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))
    weight = F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(before), F.lit(0.0))
    stepped = ranked.withColumn("_level", left / weight)
    first = F.when(F.col("_cap") >= F.col("_level") * F.col("_w"), F.col("_level"))
    # the first source under its cap fixes the level for all that follow it
    level = F.first(first, ignorenulls=True).over(
        filling.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return stepped.withColumn(
        "target", F.coalesce(F.least(level * F.col("_w"), F.col("_cap")), F.col("_cap"))
    ).drop("_w", "_cap", "_level")


def _placed(
    docs: DataFrame, weights: tuple[int, ...], epochs: int, names: tuple[str, str, str], range_rows: int
) -> DataFrame:
    """Columns of ``docs`` as _0, _1, ... with _size, _source_size, _target and _taken."""
    id_col, text, source = (f"_{docs.columns.index(n)}" for n in names)
    sized = docs.toDF(*[f"_{i}" for i in range(len(docs.columns))]).withColumn(
        "_size", word_count(F.col(text))
    )
    per_source = sized.groupBy(F.col(source).alias("source")).agg(
        F.sum("_size").alias("source_size"), F.count("*").alias("rows")
    )
    plan = stage(targets(per_source, weights, epochs), "mix-targets").select(
        F.col("source").alias("_source"),
        F.col("source_size").alias("_source_size"),
        F.col("target").alias("_target"),
        F.ceil(F.col("rows") / F.lit(range_rows)).cast("int").alias("_ranges"),
    )
    head = F.conv(F.substring("_key", 1, 7), 16, 10).cast("bigint")  # 28 bits of the key
    ranged = (
        sized.withColumn("_key", F.md5(F.concat_ws("|", F.col(id_col).cast("string"), F.col(text))))
        .join(plan, F.col(source).eqNullSafe(F.col("_source")))
        .withColumn("_range", F.floor(head * F.col("_ranges") / F.lit(float(1 << 28))).cast("int"))
    )
    earlier = (
        Window.partitionBy("_source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = stage(
        ranged.groupBy("_source", "_range")
        .agg(F.sum("_size").alias("_sum"))
        .select(
            F.col("_source").alias("_s"),
            F.col("_range").alias("_r"),
            F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_offset"),
        ),
        "mix-offsets",
    )
    inside = (
        Window.partitionBy("_source", "_range")
        .orderBy("_key", F.col(id_col).asc_nulls_first())
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    placed = ranged.withColumn("_inside", F.coalesce(F.sum("_size").over(inside), F.lit(0))).join(
        offsets, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_range") == F.col("_r"))
    )
    budget = F.round("_target").cast("bigint")
    size = F.col("_source_size")
    whole = F.when(size > 0, F.floor(budget / size)).otherwise(0)
    rest = budget - whole * size - F.col("_offset") - F.col("_inside")
    part = F.greatest(F.lit(0), F.least(F.col("_size"), rest))
    return placed.withColumn("_taken", (whole * F.col("_size") + part).cast("bigint"))


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    epochs: int = EPOCHS,
    id_col: str = "doc_id",
    text: str = "text",
    source: str = "source",
    range_rows: int = RANGE_ROWS,
) -> DataFrame:
    """``docs`` with size, source_size, target and taken (words taken, repeats counted).

    A column of ``docs`` that bears one of these names is replaced.
    """
    placed = _placed(docs, weights, epochs, (id_col, text, source), range_rows)
    added = ("size", "source_size", "target", "taken")
    own = [(f"_{i}", name) for i, name in enumerate(docs.columns) if name not in added]
    return placed.select(
        *[F.col(at).alias(name) for at, name in own], *[F.col(f"_{n}").alias(n) for n in added]
    )


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word, n at least 1."""
    starts = F.split(text, f"(?<=[{SPACE}])(?=[^{SPACE}])")  # each part begins with a word
    led = F.when(text.rlike(f"^[{SPACE}]"), 1).otherwise(0)  # but for white space in front
    return let(
        starts, lambda parts: F.rtrim(F.array_join(F.slice(parts, F.lit(1), (n + led).cast("int")), ""))
    )


def draw(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    epochs: int = EPOCHS,
    id_col: str = "doc_id",
    text: str = "text",
    source: str = "source",
    range_rows: int = RANGE_ROWS,
) -> DataFrame:
    """The mixture itself with the columns of ``docs``: one row per epoch that takes a document.

    The document at a source's cut is shortened to the words that still fit; a column
    ``n_chars`` follows its text.
    """
    placed = _placed(docs, weights, epochs, (id_col, text, source), range_rows)
    size, taken = F.col("_size"), F.col("_taken")
    epoch = F.sequence(F.lit(0), F.ceil(taken / size).cast("int") - 1)
    drawn = (
        placed.filter("_taken > 0")
        .withColumn("_epoch", F.explode(epoch))
        .withColumn("_left", taken - F.col("_epoch") * size)
    )
    cut = F.col("_left") < size
    whole = {name: F.col(f"_{i}") for i, name in enumerate(docs.columns)}
    shorter = F.when(cut, first_words(whole[text], F.col("_left"))).otherwise(whole[text])
    fitted = whole | {text: shorter}
    if "n_chars" in whole:
        kind = docs.schema["n_chars"].dataType
        fitted["n_chars"] = F.when(cut, F.length(shorter).cast(kind)).otherwise(whole["n_chars"])
    return drawn.select(*[value.alias(name) for name, value in fitted.items()])
