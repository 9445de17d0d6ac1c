"""The trie of conversation prefixes: which turns many conversations share from the start.

A turn is known by the SHA-256 of its role and text. The turns of a conversation lie in columns,
``WIDTH`` to a block; Spark SQL's ``GROUP BY prior, ROLLUP (t0, ..., t7)`` aggregates all prefixes
of a block together, and grouping_id tells how many turns a group holds. A conversation that has
further turns goes on in the next block, keyed by the node it has reached.

A node is named by its depth and its smallest member, as the members of nodes of one depth are
disjoint. A conversation therefore owns a run of nodes from some depth to its end, and what is
summed over a subtree is a sum over the members' own runs: the same rollup gives it, less the part
of the owner's run above the node. Conversations that have a node for themselves leave the rollup;
their remaining turns are nodes of one member. So rounds follow the longest shared prefix, not
the longest conversation.

Numbers of members are combined before the shuffle. Turns are numbered in ranges of a global order,
so one conversation may hold any part of the rows; equal rows are one row with a count until then.
Lists of conversations that end at a node are built in slices of 512 ids and hashed as a stream.

Rows without a conversation id are no conversation's and are left out. A null role or text is an
empty one. Turns without a number come first; turns of one number are ordered by their SHA-256.
Repeated rows are repeated turns. Other columns are not read. An empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.ladder import totals_before
from ..plans.stage import stage

WIDTH = 8  # turns in a block of columns
SLICE = 512  # ids whose texts are joined before they are hashed
_EMPTY = hashlib.sha256(b"").hexdigest()


def numbered_turns(
    conversations: DataFrame,
    id_col: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
) -> DataFrame:
    """(conv, pos, id, bytes): every turn with its place in its conversation, from 1."""
    whole = lambda name: F.coalesce(F.col(name), F.lit(""))
    said = F.concat(F.octet_length(whole(role)).cast("string"), F.lit(":"), whole(role), whole(text))
    rows = conversations.filter(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("bigint").alias("conv"),
        F.col(turn).alias("turn"),
        F.unhex(F.sha2(said, 256)).alias("id"),
        F.octet_length(whole(text)).cast("bigint").alias("bytes"),
    )
    distinct = rows.groupBy("conv", "turn", "id", "bytes").agg(F.count(F.lit(1)).alias("n"))
    order = [F.asc("conv"), F.asc_nulls_first("turn"), F.asc("id")]
    placed = stage(totals_before(distinct, order, ["n"], "turns"), "turns-placed")
    first = placed.groupBy("conv").agg(F.min("n_before").alias("first"))
    before = F.col("n_before") - F.col("first")
    places = F.explode(F.sequence(before + 1, before + F.col("n")))
    return placed.join(first, "conv").select("conv", places.alias("pos"), "id", "bytes")


def with_family_heads(turns: DataFrame, family: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations) rebuilt: the first h turns of conversation c - c % family, then the
    own turns after the h-th, with h = crc32(c as text) % most. A conversation may lose all turns.
    """
    h = lambda c: F.crc32(c.cast("string")) % most
    lengths = stage(turns.groupBy("conv").agg(F.max("pos").alias("length")), "turns-lengths")
    heads = lengths.select(F.col("conv").alias("base"), F.col("length").alias("base_length"))
    convs = lengths.withColumns({"base": F.col("conv") - F.col("conv") % family, "h": h(F.col("conv"))}).join(
        heads, "base", "left"
    )
    convs = stage(
        convs.select("conv", "base", "h", F.least("h", F.coalesce("base_length", F.lit(0))).alias("taken")),
        "turns-heads",
    )
    lead = turns.filter(F.col("pos") < most).withColumnRenamed("conv", "base")
    given = convs.join(lead, "base").filter("pos <= taken").select("conv", "pos", "id", "bytes")
    own = (
        turns.filter(F.col("pos") > h(F.col("conv")))
        .join(convs.select("conv", "h", "taken"), "conv")
        .select("conv", (F.col("taken") + F.col("pos") - F.col("h")).alias("pos"), "id", "bytes")
    )
    return given.unionByName(own), convs.select("conv")


def _blocks(turns: DataFrame, width: int) -> DataFrame:
    """(conv, block, t0, ...): the turns of a conversation in columns, a row for each block."""
    slot = F.pmod(F.col("pos") - 1, F.lit(width))
    one = F.struct("id", "bytes")
    columns = [F.max(F.when(slot == i, one)).alias(f"t{i}") for i in range(width)]
    block = F.floor((F.col("pos") - 1) / width).alias("block")
    return turns.groupBy("conv", block).agg(*columns)


def _rolled(rows: DataFrame, width: int, measures: str) -> DataFrame:
    """All prefixes of every block: block, prior, depth, path, bytes, owner and ``measures``."""
    names = ", ".join(f"t{i}" for i in range(width))
    groups = rows.sparkSession.sql(
        f"""SELECT block, prior, {names}, {width} - bit_count(grouping_id()) AS level,
                   min(conv) AS owner, {measures}
            FROM {{rows}} GROUP BY block, prior, ROLLUP ({names})""",
        rows=rows,
    )
    turns = F.array(*[F.col(f"t{i}") for i in range(width)])
    last = F.get(turns, F.col("level") - 1)
    given = [c for c in groups.columns if c not in {"block", "prior", "level"} and c not in names.split(", ")]
    return groups.filter(last.isNotNull()).select(
        "block",
        "prior",
        (F.col("block") * width + F.col("level")).alias("depth"),
        F.transform(F.slice(turns, 1, F.col("level")), lambda t: t["id"]).alias("path"),
        last["bytes"].alias("bytes"),
        *given,
    )


def _path(width: int) -> Column:
    """The turns of a row that are there."""
    turns = F.array(*[F.col(f"t{i}") for i in range(width)])
    return F.transform(F.filter(turns, lambda t: t.isNotNull()), lambda t: t["id"])


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def _digests(ends: DataFrame) -> DataFrame:
    """(depth, owner, ends): SHA-256 of the ids of ``ends(depth, owner, conv)``, comma-joined."""
    slices = ends.groupBy("depth", "owner", F.floor(F.col("conv") / SLICE).alias("slice")).agg(
        F.array_sort(F.collect_list("conv")).alias("ids")
    )
    joined = F.array_join(F.transform("ids", lambda c: c.cast("string")), ",")
    ordered = (
        slices.select("depth", "owner", "slice", joined.alias("ids"))
        .repartition("depth", "owner")
        .sortWithinPartitions("depth", "owner", "slice")
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, digest = None, hashlib.sha256()
        out: list[tuple] = []

        def closed() -> pa.RecordBatch:
            columns = [pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int64())]
            return pa.RecordBatch.from_arrays(
                [*columns, pa.array([r[2] for r in out], pa.string())], ["depth", "owner", "ends"]
            )

        for batch in batches:
            keys = zip(batch.column("depth").to_pylist(), batch.column("owner").to_pylist())
            for key, ids in zip(keys, batch.column("ids")):
                if key != at:
                    if at is not None:
                        out.append((*at, digest.hexdigest()))
                    at, digest = key, hashlib.sha256()
                else:
                    digest.update(b",")
                digest.update(ids.as_py().encode())
            yield closed()
            out = []
        if at is not None:
            out.append((*at, digest.hexdigest()))
            yield closed()

    return ordered.mapInArrow(work, "depth bigint, owner bigint, ends string")


def trie(turns: DataFrame, conversations: DataFrame, width: int = WIDTH) -> DataFrame:
    """One row per distinct prefix of ``turns(conv, pos, id, bytes)``, the empty one included.

    ``conversations(conv)`` lists the members, also those without turns. The result has the
    smallest member (``owner``), ``depth``, ``parent`` (the parent's owner; null for the root),
    ``n_convs``, ``n_children``, ``n_leaves`` and ``saved`` of its subtree, and ``ends``, the
    SHA-256 of the comma-joined ids of the members that have no further turn.
    """
    everyone = stage(conversations.select("conv"), "trie-members")
    wide = stage(_blocks(turns, width), "trie-blocks")
    slots = sum((F.col(f"t{i}").isNotNull().cast("bigint") for i in range(width)), F.lit(0))
    lengths = wide.groupBy("conv").agg(F.max(F.col("block") * width + slots).alias("length"))
    lengths = stage(lengths, "trie-lengths")
    root = everyone.agg(F.min("conv").alias("owner"), F.count(F.lit(1)).alias("n_convs")).filter("n_convs > 0")
    root = stage(root, "trie-root")

    going = lengths.crossJoin(F.broadcast(root.select(F.col("owner").alias("prior"))))  # one row
    members, levels, reached, alone = [], [], [], []
    block = 0
    while True:
        rows = wide.filter(F.col("block") == block).join(going, "conv")
        rows = stage(rows, "trie-rows")
        members.append(rows)
        levels.append(stage(_rolled(rows, width, "count(*) AS n_convs"), "trie-level"))
        nodes = levels[-1].select("prior", "path", "depth", "owner", "n_convs")
        placed = rows.select("conv", "length", "prior", _path(width).alias("path"))
        reached.append(stage(placed.join(nodes, ["prior", "path"]).drop("path", "prior"), "trie-reached"))
        on = reached[-1].filter(F.col("length") > F.col("depth"))
        alone.append(on.filter("n_convs = 1").select("conv", "depth", "length"))
        going = on.filter("n_convs > 1").select("conv", "length", F.col("owner").alias("prior"))
        block += 1
        if going.isEmpty():
            break

    # every node with its parent: the node of one turn less, or the node the block started from
    level = _union(levels)
    upper = level.select("prior", F.col("path").alias("above"), F.col("depth") + 1, F.col("owner").alias("parent"))
    upper = upper.toDF("prior", "above", "depth", "parent")
    within = level.filter(F.size("path") > 1).withColumn("above", F.slice("path", 1, F.size("path") - 1))
    within = within.join(upper, ["prior", "above", "depth"])
    starts = level.filter(F.size("path") == 1).withColumn("parent", F.col("prior"))
    own = ("owner", "depth", "parent", "n_convs", "bytes")
    lonely = _union(alone).withColumnRenamed("depth", "from")
    tails = turns.join(lonely, "conv").filter(F.col("pos") > F.col("from"))
    tails = tails.select(
        F.col("conv").alias("owner"),
        F.col("pos").alias("depth"),
        F.col("conv").alias("parent"),
        F.lit(1).cast("bigint").alias("n_convs"),
        "bytes",
    )
    top = root.select(
        "owner",
        F.lit(0).cast("bigint").alias("depth"),
        F.lit(None).cast("bigint").alias("parent"),
        "n_convs",
        F.lit(0).cast("bigint").alias("bytes"),
    )
    found = stage(_union([within.select(*own), starts.select(*own), tails, top]), "trie-nodes")

    children = (
        found.filter("parent IS NOT NULL")
        .groupBy(F.col("parent").alias("owner"), (F.col("depth") - 1).alias("depth"))
        .agg(F.count(F.lit(1)).alias("n_children"))
    )
    saves = (F.col("n_convs") - 1) * F.col("bytes")
    above = Window.partitionBy("owner").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    found = found.join(children, ["owner", "depth"], "left").withColumns(
        {"n_children": F.coalesce("n_children", F.lit(0)), "earlier": F.coalesce(F.sum(saves).over(above), F.lit(0))}
    )
    found = stage(found, "trie-children")

    # sums over subtrees: over the members' own nodes, less the owner's nodes above
    run = found.groupBy(F.col("owner").alias("conv")).agg(
        F.max((F.col("n_children") == 0).cast("bigint")).alias("leaf"), F.sum(saves).alias("saves")
    )
    run = stage(run, "trie-runs")
    weighed = _union(members).join(run, "conv", "left")
    zero = F.lit(0).cast("bigint")
    weighed = weighed.withColumns({"leaf": F.coalesce("leaf", zero), "saves": F.coalesce("saves", zero)})
    sums = _rolled(weighed, width, "sum(leaf) AS leaves, sum(saves) AS saves")
    whole = run.agg(F.sum("leaf").alias("leaves"), F.sum("saves").alias("saves"))
    whole = root.select("owner", zero.alias("depth")).crossJoin(whole)  # one row each
    sums = sums.select("owner", "depth", "leaves", "saves").unionByName(whole)

    ended = _union(reached).filter(F.col("length") == F.col("depth")).select("depth", "owner", "conv")
    by_itself = lonely.select(F.col("length").alias("depth"), F.col("conv").alias("owner"), "conv")
    silent = everyone.join(lengths, "conv", "left_anti").crossJoin(F.broadcast(root.select("owner")))
    silent = silent.select(zero.alias("depth"), "owner", "conv")
    digests = _digests(_union([ended, by_itself, silent]))

    return (
        found.join(sums, ["owner", "depth"], "left")
        .join(digests, ["owner", "depth"], "left")
        .select(
            "owner",
            "depth",
            "parent",
            "n_convs",
            "n_children",
            # a node without a sum is one of a conversation by itself
            F.coalesce("leaves", F.lit(1)).cast("bigint").alias("n_leaves"),
            F.coalesce(F.col("saves") - F.col("earlier"), zero).cast("bigint").alias("saved"),
            F.coalesce("ends", F.lit(_EMPTY)).alias("ends"),
        )
    )
