"""A trie of the beginnings that conversations share, built compressed.

Turns are numbered within their conversation from a global sort, so that no task
needs to hold a conversation; rebuilt conversations are kept in segments of SEGMENT
turns. A node is named by a digest of all turns down to it. Of equal conversations
one, the smallest id, stands for all. Segments are sorted by what precedes them and
by their turns; where neighbours in this order part (or one ends) lies a branch, and
these nodes, the ends and the root are the only ones created, with compressed edges
between them. Members, leaves and tokens are added up on this compressed tree, each
conversation giving suffix sums of its edges to the points on its way; in the end
the nodes within edges are written out, with suffix sums over the edge's turns.

Rows without conv_id are in no conversation and take no part. Null roles and texts
are empty; null turns come first; turns of the same number are ordered by a digest
of role and text, repeated rows count each. Remainders have the sign of the id. No
conversation at all gives an empty table. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import begin_task, join_spread, materialize, ship_package, small_batches

#: Turns of a segment; hexadecimal digits that name a turn; characters of ids that are hashed at once.
SEGMENT, NAME, PIECE = 256, 32, 1 << 16
#: A conversation begins with fewer than HEADS turns of the one at the start of its FAMILY of ids.
HEADS, FAMILY = 6, 100
ROOT = hashlib.blake2b(b"|", digest_size=16).digest()


def _heads(conv: Column) -> Column:
    return (F.crc32(conv.cast("string").cast("binary")) % HEADS).cast("long")


def _base(conv: Column) -> Column:
    return conv - conv % FAMILY


def numbered_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns with their place in the conversation, from 1, and one row for each
    conversation with its number n of turns. A sort over all rows gives the order; a conversation
    that fills several partitions gets its places from the numbers of rows before."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    name = F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, NAME)
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), name.alias("name"), F.length(text).cast("long").alias("size"))
    order = ["conv", F.asc_nulls_first("turn"), "name"]
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    turns = materialize(placed.withColumn("part", F.shiftright("at", 33)), "turns")
    runs = turns.groupBy("conv", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select("conv", "part", (F.col("first") - before - 1).alias("shift"))
    places = turns.join(runs, ["conv", "part"]).select("conv", (F.col("at") - F.col("shift")).alias("place"), "name", "size")
    return places, turns.groupBy("conv").agg(F.count("*").alias("n"))


def rebuilt_turns(places: DataFrame, convs: DataFrame) -> DataFrame:
    """conv, depth (from 1), name and size of all turns of rebuilt conversations."""
    conv = F.col("conv")
    heads = places.where((conv % FAMILY == 0) & (F.col("place") < HEADS)).withColumnRenamed("conv", "base")
    begun = convs.select("conv", _base(conv).alias("base"), _heads(conv).alias("h"))
    borrowed = begun.join(heads, "base").where("place <= h").select("conv", F.col("place").alias("depth"), "name", "size")
    own = places.where(F.col("place") > _heads(conv)).withColumn("base", _base(conv))
    base = heads.groupBy("base").agg(F.count("*").alias("n_base"))
    taken = F.least(_heads(conv), F.coalesce("n_base", F.lit(0)))
    return own.join(base, "base", "left").select("conv", (F.col("place") - _heads(conv) + taken).alias("depth"), "name", "size").unionAll(borrowed)


def segments(rebuilt: DataFrame) -> DataFrame:
    """conv, seg, key (the names of its turns), start and stop (what tells apart all
    that comes before, and all down to its end), sizes of turns, before (the sum of
    earlier segments'), last (whether the conversation ends here)."""
    lane = lambda i: F.conv(F.substring("digest", 1 + 10 * i, 10), 16, 10).cast("long")
    rows = rebuilt.groupBy("conv", ((F.col("depth") - 1) / SEGMENT).cast("int").alias("seg")).agg(F.array_sort(F.collect_list(F.struct("depth", "name", "size"))).alias("t"))
    rows = rows.select("conv", "seg", F.array_join("t.name", "").alias("key"), F.col("t.size").alias("sizes")).withColumn("digest", F.sha2(F.concat_ws(":", "seg", "key"), 256))
    order = Window.partitionBy("conv").orderBy("seg")
    past, upto = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, 0)
    state = lambda w, seg: F.concat_ws(":", seg, *[F.sum(lane(i)).over(w) for i in range(4)])
    here = F.aggregate("sizes", F.lit(0).cast("long"), lambda a, b: a + b)
    return rows.select(
        *["conv", "seg", "key", "sizes"],
        F.when(F.col("seg") == 0, "").otherwise(state(past, F.col("seg"))).alias("start"),
        state(upto, F.col("seg") + 1).alias("stop"),
        F.coalesce(F.sum(here).over(past), F.lit(0)).alias("before"),
        F.lead("seg").over(order).isNull().alias("last"),
    )


def node_names(start: str, stop: str, key: str) -> list[bytes]:
    """Names of the nodes at the start of a segment and behind each of its turns."""
    digest = hashlib.blake2b(f"{start}|".encode(), digest_size=16)
    out = [digest.digest()]
    for at in range(0, len(key), NAME):
        digest.update(key[at : at + NAME].encode())
        out.append(digest.copy().digest())
    if len(out) > SEGMENT:
        out[SEGMENT] = hashlib.blake2b(f"{stop}|".encode(), digest_size=16).digest()
    return out


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            yield from batch.slice(at, 512).to_pylist()


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 2048) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    make = lambda: pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*held), schema)], schema=schema)
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield make()
            held = []
    if held:
        yield make()


def _name_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds to segments the names of their nodes and the sums of all sizes down to each turn."""
    begin_task()
    for batch in batches:
        start, stop, key, sizes, before = (batch.column(i).to_pylist() for i in range(5))
        nodes = [node_names(*x)[1:] for x in zip(start, stop, key)]
        totals = [list(accumulate(x, initial=b))[1:] for x, b in zip(sizes, before)]
        yield batch.append_column("nodes", pa.array(nodes, pa.list_(pa.binary()))).append_column("totals", pa.array(totals, pa.list_(pa.int64())))


def parting(before: tuple[str, str] | None, start: str, stop: str, key: str) -> bytes | None:
    """The node where a segment (start, key) and the one before it in the order part
    or one of them ends; None where they don't touch or are the same full segment."""
    if before is None or before[0] != start:
        return None
    n = min(len(before[1]), len(key)) // NAME
    low, high = 0, n
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if before[1][: middle * NAME] == key[: middle * NAME] else (low, middle - 1)
    return None if low == SEGMENT else node_names(start, stop, key[: low * NAME])[-1]


_FOUND = pa.schema([("node", pa.binary()), ("part", pa.int32()), ("ends", pa.bool_()), ("start", pa.string()), ("stop", pa.string()), ("key", pa.string())])


def _find_partings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted segments: nodes where neighbours part, and the partition's first and last row."""

    def found():
        begin_task()
        part, before, last = TaskContext.get().partitionId(), None, None
        for row in _rows(batches):
            last = (row["start"], row["stop"], row["key"])
            if before is None:
                yield (None, part, False, *last)
            elif node := parting(before, *last):
                yield (node, None, None, None, None, None)
            before = (row["start"], row["key"])
        if last:
            yield (None, part, True, *last)

    yield from _batches(found(), _FOUND)


def _part_borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found = (parting((r["start_before"], r["key_before"]), r["start"], r["stop"], r["key"]) for r in _rows(batches))
    yield from _batches(((node,) for node in found if node), pa.schema([("node", pa.binary())]))


def partings(segs: DataFrame) -> DataFrame:
    """node: where neighbours of the sorted segments part. Borders between partitions
    are compared once more: a row or two of each partition."""
    order = ["start", "key"]
    rows = segs.select("start", "stop", "key").repartitionByRange(*order).sortWithinPartitions(*order)
    found = materialize(rows.mapInArrow(_find_partings, "node binary, part int, ends boolean, start string, stop string, key string"), "partings")
    border = Window.orderBy("part", "ends")
    borders = found.where("part is not null").select("ends", *[F.lag(c).over(border).alias(f"{c}_before") for c in order], "start", "stop", "key")
    across = borders.where("not ends and start_before is not null").drop("ends").mapInArrow(_part_borders, "node binary")
    return found.where("node is not null").select("node").unionAll(across)


def _join_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by node and id: ids joined by commas, in pieces of bounded length."""

    def pieces():
        begin_task()
        part, node, held, size, seq = TaskContext.get().partitionId(), None, [], 0, 0
        for row in _rows(batches):
            if row["node"] != node or size > PIECE:
                if held:
                    yield node, part, seq, ",".join(held)
                node, held, size, seq = row["node"], [], 0, seq + 1
            held.append(str(row["conv"]))
            size += len(held[-1]) + 1
        if held:
            yield node, part, seq, ",".join(held)

    yield from _batches(pieces(), pa.schema([("node", pa.binary()), ("part", pa.int32()), ("seq", pa.int64()), ("ids", pa.string())]), 64)


def _hash_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pieces sorted by node: the digest of each node's pieces, joined by commas."""

    def digests():
        node = digest = None
        for row in _rows(batches):
            if row["node"] == node:
                digest.update(b",")
            else:
                if digest:
                    yield node, digest.hexdigest()
                node, digest = row["node"], hashlib.sha256()
            digest.update(row["ids"].encode())
        if digest:
            yield node, digest.hexdigest()

    yield from _batches(digests(), pa.schema([("node", pa.binary()), ("ends_sha256", pa.string())]))


def end_digests(ends: DataFrame) -> DataFrame:
    """node and ends_sha256 of nodes where conversations end. Large groups of equal
    conversations are sorted over several partitions; the digest itself, which has one
    order, runs over pieces of PIECE characters as they come, holding none."""
    order = ["node", "conv"]
    pieces = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_join_ids, "node binary, part int, seq long, ids string")
    return pieces.repartition("node").sortWithinPartitions("node", "part", "seq").mapInArrow(_hash_pieces, "node binary, ends_sha256 string")


def compressed_tree(segs: DataFrame, reps: DataFrame) -> DataFrame:
    """One row for each branch, end and leaf and the root: node, conv (its smallest
    member), depth, above, above_conv and above_depth (the point over it), n_convs,
    n_leaves, saved (of its subtree), size (of its last text) and total (of all its texts)."""
    points = partings(segs).unionAll(reps.select("node")).unionAll(reps.select(F.lit(ROOT))).distinct()
    turns = f"transform(sizes, (s, i) -> struct(nodes[i] as node, cast(seg as long) * {SEGMENT} + i + 1 as depth, s as size, totals[i] as total))"
    steps = segs.select("conv", "copies", F.inline(F.expr(turns)))
    roots = reps.select("conv", "copies", F.lit(ROOT).alias("node"), *[F.lit(0).cast("long").alias(c) for c in ("depth", "size", "total")])
    path = steps.unionAll(roots.select(steps.columns))
    counted = path.select("node", "copies", "conv", F.lit(0).alias("point")).unionAll(points.select("node", F.lit(0), F.lit(None).cast("long"), F.lit(1)))
    stats = counted.groupBy("node").agg(F.sum("copies").alias("n_convs"), F.min("conv").alias("top"), F.count("conv").alias("count"), F.max("point").alias("point"))
    stats = materialize(stats.where("point = 1").drop("point"), "points")
    crossings = stats.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
    way = Window.partitionBy("conv").orderBy("depth")
    on_way = join_spread(path, stats, "node", crossings, "conv").select(
        *["conv", "node", "depth", "size", "total", "n_convs", "top"],
        (F.col("top") == F.col("conv")).alias("own"),
        *[F.lag(c).over(way).alias(f"above_{c}") for c in ("node", "top", "depth", "total")],
        F.lead("depth").over(way).isNull().alias("end"),
        "copies",
    )
    edge = F.when(F.col("own"), (F.col("n_convs") - 1) * (F.col("total") - F.coalesce("above_total", F.lit(0)))).otherwise(0)
    leaf = F.max(F.col("end") & (F.col("n_convs") == F.col("copies"))).over(Window.partitionBy("conv"))
    below = F.coalesce(F.sum(edge).over(way.rowsBetween(1, Window.unboundedFollowing)), F.lit(0))
    summed = on_way.withColumn("leaf", leaf).withColumn("below", below)
    mine = F.max(F.when(F.col("own"), F.struct("conv", "depth", "size", "total", "n_convs", "above_node", "above_top", "above_depth"))).alias("mine")
    tree = summed.groupBy("node").agg(mine, F.sum("below").alias("below"), F.count_if("leaf").alias("n_leaves"))
    saved = F.col("below") + (F.col("mine.n_convs") - 1) * F.col("mine.size")
    return tree.select("node", "mine.*", "n_leaves", saved.alias("saved"))


def expand(tree: DataFrame, segs: DataFrame) -> DataFrame:
    """All nodes: the points, and those within edges, which have the members and the leaves of the point below."""
    root = tree.where("depth = 0").select("conv", "depth", F.lit(None).cast("long").alias("parent"), "n_convs", "n_children", "n_leaves", "saved", "ends_sha256")
    parts = tree.where("depth > 0").withColumn("seg", F.explode(F.expr(f"sequence(cast(above_depth div {SEGMENT} as int), cast((depth - 1) div {SEGMENT} as int))")))
    parts = parts.join(segs.select("conv", "seg", "sizes", "totals"), ["conv", "seg"])
    base = F.col("seg").cast("long") * SEGMENT
    first, last = F.greatest(F.col("above_depth") + 1, base + 1), F.least(F.col("depth"), base + SEGMENT)
    turns = F.expr("transform(sequence(first, last), d -> struct(d as at, totals[cast(d - base - 1 as int)] - sizes[cast(d - base - 1 as int)] as earlier))")
    parts = parts.withColumn("base", base).withColumn("first", first).withColumn("last", last)
    nodes = parts.select("conv", "depth", "above_depth", "above_top", "n_convs", "n_children", "n_leaves", "saved", "ends_sha256", "size", "total", F.inline(turns))
    inner = F.col("at") < F.col("depth")
    suffix = (F.col("n_convs") - 1) * (F.col("total") - F.col("size") - F.col("earlier"))
    return root.unionAll(
        nodes.select(
            *["conv", F.col("at").alias("depth"), F.when(F.col("at") == F.col("above_depth") + 1, F.col("above_top")).otherwise(F.col("conv")).alias("parent"), "n_convs"],
            *[F.when(inner, 1).otherwise(F.col("n_children")).alias("n_children"), "n_leaves", (F.col("saved") + suffix).alias("saved")],
            F.when(inner, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.col("ends_sha256")).alias("ends_sha256"),
        )
    )


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256 of every node."""
    ship_package(conversations.sparkSession)
    small_batches(conversations.sparkSession)
    places, convs = numbered_turns(conversations)
    cut = segments(rebuilt_turns(places, convs)).select("start", "stop", "key", "sizes", "before", "conv", "seg", "last")
    named = "start string, stop string, key string, sizes array<bigint>, before long, conv long, seg int, last boolean, nodes array<binary>, totals array<bigint>"
    segs = materialize(cut.mapInArrow(_name_nodes, named), "segments")
    last = segs.where("last").select("conv", F.element_at("nodes", -1).alias("node"))
    ends = materialize(convs.select("conv").join(last, "conv", "left").select("conv", F.coalesce("node", F.lit(ROOT)).alias("node")), "ends")
    reps = ends.groupBy("node").agg(F.min("conv").alias("conv"), F.count("*").alias("copies"))
    reps = materialize(reps, "representatives")
    segs = materialize(segs.join(reps.select("conv", "copies"), "conv"), "kept-segments")
    tree = materialize(compressed_tree(segs, reps), "tree")
    children = tree.where("above_node is not null").groupBy(F.col("above_node").alias("node")).agg(F.count("*").alias("n_children"))
    whole = tree.join(children, "node", "left").join(end_digests(ends), "node", "left").na.fill(0, ["n_children"])
    whole = whole.withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)))
    return expand(whole, segs).toDF("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
