"""Near-duplicates by SuperMinHash, banding, verification and components.

A document's words are lower-cased (A-Z only) runs between ASCII white space; its
set holds its distinct shingles as 64-bit hashes. SuperMinHash walks, for every
shingle, one random permutation of the signature's places, all shingles of a text
at once, and stops when no later rank can lower any place. Bands of the signature
make buckets. Documents with one set are one class, known by the set's digest;
only the smallest id of a class goes on.

Buckets don't emit their pairs. Within a bucket, classes whose sizes and marks (a
byte of each place of the signature) allow a link are joined to a forest: what
lies DEVIATIONS standard deviations below the agreement expected at the threshold
can't be linked, so boilerplate alone joins nothing. The components of these
forests are the candidate groups, and only their texts are read again. A group
meets with its full sets; union-find skips what is joined already, and only
confirmed links leave. So every two classes of a bucket are connected by
confirmed links or tested themselves.

Buckets and groups meet in blocks of bounded weight. What is larger than a block, a
bucket as well as a group, is dealt into parts, each with the same few pivots; rows that
then aren't joined with most of their group visit all other parts, so that every two
rows are joined or meet. Keys, digests and components that hold a large
part of all rows are dealt over many tasks. Components of all links are joined on
the executors.

Null texts count as empty; documents without words have an empty set and are
linked with nothing, as are rows with a null doc_id. Texts shorter than a shingle
have one shingle, the whole sequence. Rows that repeat an id each get their row.
An empty table gives an empty table. Columns other than doc_id and text are kept
by `keep_one_of_each` and not read by the rest.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import begin_task, id_and_text, join_spread, map_rows, materialize
from .components import component_labels

#: At a similarity of 0.8, 24 bands of 4 miss a link three times in a million.
BANDS, ROWS = 24, 4
#: Weight of a block; a class weighs 1, and 1 more for every SHINGLES of its set where sets are sent.
BLOCK, SHINGLES = 2048, 1024
#: Classes that every part of a large group meets.
PIVOTS = 16
DEVIATIONS = 6
_ELEMENTS = 8192
_U64 = np.uint64
_RANK = _U64(52)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> _U64(30))) * _U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U64(27))) * _U64(0x94D049BB133111EB)
    return x ^ (x >> _U64(31))


def _salts(n: int, seed: int) -> np.ndarray:
    return _mix(np.arange(1, n + 1, dtype=_U64) * _U64(0x9E3779B97F4A7C15) + _U64(seed)) | _U64(1)


def shingle_set(text: str, size: int) -> np.ndarray:
    """The sorted hashes of a text's distinct shingles."""
    from xxhash import xxh3_64_intdigest

    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, _U64)
    h = np.fromiter(map(xxh3_64_intdigest, words), _U64, len(words))
    salt = _salts(size, 11)
    n = len(words) - size + 1
    if n < 1:
        return _mix((h * salt[: len(h)]).sum(keepdims=True) + _U64(len(h)))
    total = h[:n] * salt[0]
    for i in range(1, size):
        total += h[i : i + n] * salt[i]
    return np.unique(_mix(total))


def superminhash(elements: np.ndarray, places: int) -> np.ndarray:
    """The signature of a set of 64-bit hashes: at each place the least rank
    (high bits) and random number (low bits) that any element brings there."""
    least = np.full(places, np.iinfo(np.uint64).max, _U64)
    draw, swap = _salts(places, 21), _salts(places, 31)
    for at in range(0, len(elements), _ELEMENTS):
        e = elements[at : at + _ELEMENTS]
        row, order = np.arange(len(e)), None
        for rank in range(places):
            if int(least.max() >> _RANK) < rank:
                break
            value = (_mix(e * draw[rank]) >> _U64(12)) | (_U64(rank) << _RANK)
            other = rank + (((_mix(e * swap[rank]) >> _U64(32)) * _U64(places - rank)) >> _U64(32)).astype(np.int64)
            if rank == 0:
                place = first = other
            else:
                if order is None:
                    order = np.tile(np.arange(places, dtype=np.int16), (len(e), 1))
                    order[row, first] = 0
                place = order[row, other]
                order[row, other] = order[row, rank]
            np.minimum.at(least, place, value)
    return least


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    mixed = (signature.reshape(bands, rows) * _salts(rows, 41)).sum(1)
    return _mix(mixed + _salts(bands, 51)).view(np.int64)


def signatures(docs: DataFrame, shingle: int, bands: int, rows: int) -> DataFrame:
    """doc_id, n_shingles, digest (of the set; null if empty), bands, and marks
    (a byte of each place of the signature) of every text."""

    def make():
        def step(table):
            sets = [shingle_set(t, shingle) for t in table["text"]]
            signed = [superminhash(s, bands * rows) if len(s) else None for s in sets]
            return {
                "doc_id": table["doc_id"],
                "n_shingles": [len(s) for s in sets],
                "digest": [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets],
                "bands": [[] if g is None else band_keys(g, bands, rows) for g in signed],
                "marks": [b"" if g is None else g.astype(np.uint8).tobytes() for g in signed],
            }

        return step

    return map_rows(id_and_text(docs), "doc_id long, n_shingles long, digest binary, bands array<long>, marks binary", make)


def shingle_sets(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id and set (sorted 64-bit numbers) of every text."""

    def make():
        return lambda table: {"doc_id": table["doc_id"], "set": [shingle_set(t, shingle).tobytes() for t in table["text"]]}

    return map_rows(id_and_text(docs), "doc_id long, `set` binary", make)


class _Block:
    """Classes that meet in one task, ordered by group: which pairs may be linked, and the links found."""

    def __init__(self, rows: pd.DataFrame, percent: int):
        rows = rows.sort_values(["group", "visits", "rep"], kind="stable")
        self.rows, self.percent = rows, percent
        self.rep, self.label, self.visits, self.n = (rows[c].to_numpy() for c in ("rep", "label", "visits", "n"))
        self.label = self.label.copy()
        self.marks = np.frombuffer(b"".join(rows["marks"]), np.uint8).reshape(len(rows), -1)
        places, share = self.marks.shape[1], percent / 100
        self.least = places * share - DEVIATIONS * math.sqrt(places * share * (1 - share))
        group = rows["group"].to_numpy()
        self.starts = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        self.stops = np.append(self.starts[1:], len(rows))
        self.links: list[tuple[int, int]] = []

    def allowed(self, x, y) -> np.ndarray:
        """Whether sizes allow a link."""
        return 100 * np.minimum(self.n[x], self.n[y]) >= self.percent * np.maximum(self.n[x], self.n[y])

    def agreement(self, x, y) -> np.ndarray:
        return (self.marks[x] == self.marks[y]).sum(1)

    def join(self, x: int, y: int, start: int, stop: int) -> None:
        self.links.append((int(min(self.rep[x], self.rep[y])), int(max(self.rep[x], self.rep[y]))))
        label = self.label[start:stop]
        label[label == label[y - start]] = label[x - start]

    def others(self, x: int, start: int, stop: int) -> np.ndarray:
        """Those of x's group that x is to be tested against: visitors meet residents,
        and nobody those that are joined already."""
        found = np.arange(start, stop)
        return found[(self.label[start:stop] != self.label[x]) & ~(self.visits[start:stop] & self.visits[x])]

    def found(self) -> pd.DataFrame:
        return pd.DataFrame(self.links, columns=["a", "b"], dtype="int64")


def loose_links(rows: pd.DataFrame, percent: int) -> pd.DataFrame:
    """A forest over the pairs of each group that sizes and marks allow."""
    block = _Block(rows, percent)
    first = np.repeat(block.starts, block.stops - block.starts)  # of each group
    everyone = np.arange(len(rows))
    close = block.allowed(first, everyone) & (block.agreement(first, everyone) >= block.least)
    waiting = np.add.reduceat(~close, block.starts)
    fresh = close & (block.label != block.label[first])
    block.links += list(zip(block.rep[first[fresh]].tolist(), block.rep[fresh].tolist()))
    for start, stop, left in zip(block.starts.tolist(), block.stops.tolist(), waiting.tolist()):
        if not left or stop - start < 3:
            continue
        joined = np.isin(block.label[start:stop], block.label[start:stop][close[start:stop]])
        block.label[start:stop][joined] = block.label[start]
        for x in (start + np.flatnonzero(~close[start:stop])).tolist():
            others = block.others(x, start, stop)
            others = others[block.allowed(x, others)]
            for y in others[block.agreement(x, others) >= block.least].tolist():
                if block.label[y] != block.label[x]:
                    block.join(x, y, start, stop)
    return block.found()


def confirmed_links(rows: pd.DataFrame, percent: int) -> pd.DataFrame:
    """A forest over the links of each group, confirmed on full sets."""
    block = _Block(rows, percent)
    sets = [np.frombuffer(s, _U64) for s in block.rows["set"]]
    bands = np.stack(block.rows["bands"].to_list())
    for start, stop in zip(block.starts.tolist(), block.stops.tolist()):
        for x in range(start, stop):
            others = block.others(x, start, stop)
            others = others[(others > x) & block.allowed(x, others)]
            others = others[(bands[others] == bands[x]).any(1)]
            agree = block.agreement(x, others)
            likely = agree >= block.least
            for y in others[likely][np.argsort(-agree[likely], kind="stable")].tolist():
                if block.label[y] == block.label[x]:
                    continue
                common = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                if 100 * common >= percent * (int(block.n[x]) + int(block.n[y]) - common):
                    block.join(x, y, start, stop)
    return block.found()


def _links_within(members: DataFrame, find: Callable[[pd.DataFrame, int], pd.DataFrame], percent: int) -> DataFrame:
    """Links (a, b) that find gives within the groups of members: group, weight (of
    the whole group), rep, n, marks and more."""
    columns = [c for c in members.columns if c not in ("group", "weight")]
    large = F.col("weight") > BLOCK
    light, rows = members.agg(F.coalesce(F.sum(F.when(large, 0).otherwise(1)), F.lit(0)), F.count("*")).first()
    blocks = max(1, math.ceil(light / BLOCK))

    def link(table: pd.DataFrame) -> pd.DataFrame:
        begin_task()
        return find(table.drop_duplicates(["group", "rep"]), percent)

    def run(placed: DataFrame) -> DataFrame:
        return placed.select("block", "part", "group", *columns, "label", "visits").groupBy("block", "part").applyInPandas(link, "a long, b long")

    alone = members.withColumn("label", F.col("rep")).withColumn("visits", F.lit(False))
    few = alone.where(~large).withColumn("block", F.pmod(F.xxhash64("group"), F.lit(blocks))).withColumn("part", F.lit(-1))
    links = materialize(run(few), "links")
    if light == rows:
        return links
    parts = F.ceil(F.col("weight") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("rep"), parts).cast("int")
    everywhere = F.explode(F.sequence(F.lit(0), parts - 1))
    many = alone.where(large).withColumn("block", F.col("group"))
    pick = Window.partitionBy("group").orderBy(F.xxhash64("rep"), "rep")
    pivots = many.withColumn("pick", F.row_number().over(pick)).where(F.col("pick") <= PIVOTS).drop("pick")
    first = materialize(run(many.withColumn("part", own).unionByName(pivots.withColumn("part", everywhere))), "links")
    labels = component_labels(first)
    at = many.drop("label").join(labels.select(F.col("node").alias("rep"), "label"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    at = materialize(at, "parts")
    main = at.groupBy("group", "label").agg(F.count("*").alias("n")).groupBy("group").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.sum("n").alias("count"))
    rest = join_spread(at, main, "group", rows, "rep").where("label <> main").select(at.columns)
    rest = materialize(rest, "rest")
    if rest.isEmpty():
        return links.unionByName(first)
    visitors = rest.withColumn("part", everywhere).where(F.col("part") != own).withColumn("visits", F.lit(True))
    second = materialize(run(at.withColumn("part", own).unionByName(visitors)), "links")
    return links.unionByName(first).unionByName(second)


def _loose_components(classes: DataFrame, percent: int) -> DataFrame:
    """rep and group of all classes that may be linked with another."""
    keyed = classes.select("rep", F.explode("bands").alias("key"))
    rows = classes.agg(F.coalesce(F.sum(F.size("bands")), F.lit(0))).first()[0]
    buckets = materialize(keyed.groupBy("key").agg(F.count("*").alias("count")).where("count > 1"), "buckets")
    held = join_spread(keyed, buckets, "key", rows, "rep").withColumnsRenamed({"key": "group", "count": "weight"})
    held = held.join(classes.select("rep", F.col("n_shingles").alias("n"), "marks"), "rep")
    held = materialize(held.select("group", "weight", "rep", "n", "marks"), "held")
    grouped = component_labels(_links_within(held, loose_links, percent))
    both = grouped.unionAll(grouped.select(F.col("label").alias("node"), "label").distinct())
    return both.select(F.col("node").alias("rep"), F.col("label").alias("group"))


def link_components(docs: DataFrame, shingle: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id that confirmed
    links reach) of every document."""
    signed = materialize(signatures(docs, shingle, bands, rows), "signatures")
    known = signed.where("digest is not null and doc_id is not null")
    one = [F.first(c).alias(c) for c in ("n_shingles", "bands", "marks")]
    classes = materialize(known.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), *one), "classes")

    grouped = materialize(_loose_components(classes, percent), "groups")
    wanted = grouped.select(F.col("rep").alias("doc_id")).hint("merge")  # it grows with the table, so it is never sent whole
    sets = shingle_sets(docs.join(wanted, "doc_id", "left_semi"), shingle).withColumnRenamed("doc_id", "rep")
    members = classes.select("rep", F.col("n_shingles").alias("n"), "bands", "marks").join(grouped, "rep").join(sets.dropDuplicates(["rep"]), "rep")
    members = materialize(members, "members")
    sizes = members.groupBy("group").agg(F.sum(1 + F.floor(F.col("n") / SHINGLES)).alias("weight"), F.count("*").alias("count"))
    sized = join_spread(members, sizes, "group", members.count(), "rep").drop("count")
    labels = component_labels(_links_within(sized, confirmed_links, percent))

    joined = classes.select("digest", "rep", "copies").join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    moved = joined.where("copies > 1 or label is not null").select("digest", F.coalesce("label", "rep").alias("label"), "copies")
    moved = materialize(moved, "moved")
    own = F.when(F.col("digest").isNotNull() & F.col("doc_id").isNotNull(), F.col("label"))
    told = join_spread(signed.select("doc_id", "n_shingles", "digest"), moved, "digest", signed.count(), "doc_id", "copies", "left")
    return told.select("doc_id", "n_shingles", F.coalesce(own, "doc_id").alias("component_id"))


def near_duplicate_digests(docs: DataFrame, shingle: int = 3, percent: int = 85) -> DataFrame:
    found = link_components(docs, shingle, percent)
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one_of_each(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """The rows, with all columns, of the smallest doc_id of each component."""
    gone = link_components(docs, shingle, percent).where("doc_id <> component_id").select(F.col("doc_id").alias("gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["gone"], "left_anti")
