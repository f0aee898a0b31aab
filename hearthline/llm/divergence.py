"""Audit of how the sources of a language diverge in their words.

Terms are counted in tasks first and then by Spark. A language keeps the terms of
at least LEAST of its documents; its kept cells (term and source) are dealt over
blocks of terms by a hash, so that a block of any language has a bounded size. In a
block every (lang, source) group has a sparse vector of smoothed shares; the groups
of a language have their places at STATIONS stations. The vectors of a station stay
where its exchange put them, and in each round of a round-robin tournament the
compressed vectors of another station come by: every two stations meet once, and a
meeting gives the divergence of every two groups in both directions. Blocks add up.
Terms that neither of two groups has are counted, not visited. The terms that a
group has more of than its language are ranked by a heap in every block, and these
bounded lists are ranked once more.

All arithmetic is on whole numbers. Nulls in lang, source and text count as empty
strings; documents are rows, repeated ones count each; equal values are ranked by
item; an empty table gives an empty table; columns other than text, lang and source
are not read.
"""

from __future__ import annotations

import heapq
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import begin_task, materialize, row_slices, ship_package, small_batches

#: A language keeps terms of so many documents; shares are in billionths; ranks of terms end here.
LEAST, WHOLE, TOP = 3, 1_000_000_000, 200
#: An even number of stations, so that nobody sits out in the STATIONS - 1 rounds.
STATIONS = 8
#: Cells of a block: at least so many, and so many for each group of the language.
BLOCK_CELLS, GROUP_CELLS = 100_000, 1_000
#: Entries of counts that a task holds before it hands them on.
HELD_ENTRIES = 400_000
#: Bytes that end terms become blanks, A to Z lower case; all others stay.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))
_GROUP = ["lang", "source"]


def _filled(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit("")).alias(name)


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences) and docs (documents that have it)."""
    ship_package(docs.sparkSession)
    small_batches(docs.sparkSession)
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])

    def counted(found: dict[tuple[str, str], tuple[Counter, Counter]]) -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in found.items():
            terms = pa.array(list(n), pa.binary()).cast(pa.string())
            same = [pa.array([value] * len(terms), pa.string()) for value in (lang, source)]
            yield pa.RecordBatch.from_arrays([*same, terms, pa.array(n.values(), pa.int64()), pa.array(map(docs.__getitem__, n), pa.int64())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin_task()
        found: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        for rows in row_slices(batches):
            for lang, source, text in zip(rows["lang"], rows["source"], rows["text"]):
                n, docs = found.setdefault((lang, source), (Counter(), Counter()))
                terms = text.translate(_FOLD).split()
                n.update(terms)
                docs.update(set(terms))
            if sum(len(n) for n, _ in found.values()) > HELD_ENTRIES:
                yield from counted(found)
                found = {}
        yield from counted(found)

    texts = docs.select(_filled("lang"), _filled("source"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    parts = texts.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return parts.groupBy(*_GROUP, "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def kept_cells(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """lang, source, term, n, n_lang (in the whole language), and first: true for one cell of each term."""
    term = Window.partitionBy("lang", "term")
    cells = term_counts(docs).withColumn("df", F.sum("docs").over(term)).withColumn("n_lang", F.sum("n").over(term))
    cells = cells.where(F.col("df") >= least).withColumn("first", F.row_number().over(term.orderBy("source")) == 1)
    return cells.select(*_GROUP, "term", "n", "n_lang", "first")


def share(count: str, total: str, kept: str) -> Column:
    """1 + floor(WHOLE * (count + 1) / (total + kept)), exact at any size."""
    large = lambda x: f"cast({x} as decimal(19, 0))"
    return F.expr(f"1 + ({WHOLE} * ({large(count)} + 1)) div ({large(total)} + {large(kept)})")


def seat_groups(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """Every (lang, source) that occurs, with its total n_group, the language's n_all
    and number of terms v, the share z of a term it lacks, its station and the
    language's number of blocks. As many rows as there are groups."""
    langs = kept.groupBy("lang").agg(F.sum("n").alias("n_all"), F.count_if("first").alias("v"), F.count("*").alias("cells"))
    totals = kept.groupBy(*_GROUP).agg(F.sum("n").alias("n_group"))
    groups = docs.select(_filled("lang"), _filled("source")).distinct().join(totals, _GROUP, "left").join(langs, "lang", "left").na.fill(0)
    lang = Window.partitionBy("lang")
    block_cells = F.greatest(F.lit(BLOCK_CELLS), GROUP_CELLS * F.count("*").over(lang))
    return groups.select(
        *[*_GROUP, "n_group", "n_all", "v"],
        F.when(F.col("v") > 0, share("0", "n_group", "v")).otherwise(1).alias("z"),
        ((F.row_number().over(lang.orderBy("source")) - 1) % STATIONS).alias("station"),
        F.ceil((F.col("cells") + 1) / block_cells).cast("int").alias("blocks"),
    )


def squeeze(ids: np.ndarray, shares: np.ndarray) -> bytes:
    """A sparse vector in few bytes: steps between ids, and shares."""
    steps = np.diff(ids, prepend=0).astype("<u4")
    return zlib.compress(np.concatenate([steps, shares.astype("<u4")]).tobytes(), 1)


def unsqueeze(data: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    if data is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    both = np.frombuffer(zlib.decompress(data), "<u4").astype(np.int64)
    steps, shares = np.split(both, 2)
    return np.cumsum(steps), shares


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


_PACKED = "lang string, block int, source string, item string, value long, size long, vector binary"
_PACKED_ARROW = pa.schema([("lang", pa.string()), ("block", pa.int32()), ("source", pa.string()), ("item", pa.string()), ("value", pa.int64()), ("size", pa.int64()), ("vector", pa.binary())])


def _pack_block(table: pa.Table) -> pa.Table:
    """A block's vectors, one for each source in it, and the best TOP terms of each."""
    lang, block = table["lang"][0].as_py(), table["block"][0].as_py()
    term = table["term"].combine_chunks().dictionary_encode()
    names = term.dictionary.cast(pa.binary())
    order = pc.sort_indices(names).to_numpy()
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    ids = place[term.indices.to_numpy(zero_copy_only=False)]  # terms by their bytes
    source = table["source"].combine_chunks().dictionary_encode()
    who = source.indices.to_numpy(zero_copy_only=False)
    p, q = table["p"].to_numpy(), table["q"].to_numpy()
    by = np.lexsort((ids, who))
    rows = []
    for part in np.split(by, np.flatnonzero(np.diff(who[by])) + 1):
        name = source.dictionary[int(who[part[0]])].as_py()
        rows.append((lang, block, name, None, None, len(order), squeeze(ids[part], p[part])))
        more = part[p[part] > q[part]]
        best = heapq.nsmallest(TOP, zip((-divergence(p[more], q[more])).tolist(), ids[more].tolist()))
        rows += [(lang, block, name, names[int(order[i])].as_py().decode(), -value, None, None) for value, i in best]
    return pa.Table.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), _PACKED_ARROW)], schema=_PACKED_ARROW)


def pack_blocks(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """Rows with a vector for each source of each block, and rows with its best terms there."""
    cells = kept.join(groups, _GROUP).select(
        *["lang", F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int").alias("block"), "source", "term"],
        share("n", "n_group", "v").alias("p"),
        share("n_lang", "n_all", "v").alias("q"),
    )
    return cells.groupBy("lang", "block").applyInArrow(_pack_block, _PACKED)


def seat_vectors(packed: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, block, station, size (terms of the block) and seats: all groups of the
    station, those without a term in the block too."""
    everywhere = groups.select(*_GROUP, "station", "z", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    vectors = packed.where("item is null").select("lang", "block", "source", "vector")
    sizes = packed.where("item is null").groupBy("lang", "block").agg(F.max("size").alias("size"))
    placed = everywhere.join(vectors, ["lang", "block", "source"], "left").join(sizes, ["lang", "block"], "left")
    seats = F.collect_list(F.struct("source", "z", "vector")).alias("seats")
    return placed.groupBy("lang", "block", "station").agg(F.coalesce(F.max("size"), F.lit(0)).alias("size"), seats)


def tournament(stations: int = STATIONS) -> list[list[tuple[int, int]]]:
    """Rounds of (host, visitor) in which every two stations meet once: one stays, the others move on by a place."""
    rounds = []
    for turn in range(stations - 1):
        ring = [0, *((turn + i) % (stations - 1) + 1 for i in range(stations - 1))]
        pairs = [(ring[i], ring[-1 - i]) for i in range(stations // 2)]
        rounds.append([pair if (turn + i) % 2 else pair[::-1] for i, pair in enumerate(pairs)])
    return rounds


def both_directions(a: tuple[int, np.ndarray, np.ndarray], z_b: int, shares_b: np.ndarray, held: np.ndarray, dense: np.ndarray) -> tuple[int, int]:
    """The divergence of group a from b and of b from a over a block's terms. b is
    given by z_b, its shares, and over all terms whether it has them and its share or z_b."""
    z_a, ids, p = a
    q, common = dense[ids], held[ids]
    met = q[common]
    neither = len(dense) - len(ids) - len(shares_b) + len(met)
    z_ab, z_ba = (int((x - y) ** 2 // y) for x, y in ((z_a, z_b), (z_b, z_a)))
    lone = np.int64(z_a)  # what b has alone: all of b without what both have
    ab = divergence(p, q).sum() + divergence(lone, shares_b).sum() - divergence(lone, met).sum() + neither * z_ab
    ba = divergence(q, p).sum() + divergence(shares_b, lone).sum() - divergence(met, lone).sum() + neither * z_ba
    return int(ab), int(ba)


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Meetings of the seats of two stations, or of a station's seats with each other (visitors null)."""
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("value", pa.int64())])
    unpack = lambda seats: [(s["source"], s["z"], *unsqueeze(s["vector"])) for s in seats]
    begin_task()
    for batch in batches:
        for i in range(batch.num_rows):
            row = {name: batch.column(k)[i].as_py() for k, name in enumerate(batch.schema.names)}
            hosts = unpack(row["seats"])
            visitors = hosts if row["visitors"] is None else unpack(row["visitors"])
            held, dense = np.zeros(row["size"], bool), np.zeros(row["size"], np.int64)
            for k, (name, z, ids, shares) in enumerate(visitors):
                held[:], dense[:] = False, z
                held[ids], dense[ids] = True, shares
                rows = []
                for other, *a in hosts if row["visitors"] is not None else hosts[:k]:
                    ab, ba = both_directions(tuple(a), z, shares, held, dense)
                    rows += [(row["lang"], other, name, ab), (row["lang"], name, other, ba)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def pair_divergences(seated: DataFrame) -> DataFrame:
    """lang, source, item (another source of the lang) and value, over all blocks."""
    ship_package(seated.sparkSession)
    nobody = F.lit(None).cast(seated.schema["seats"].dataType)
    met = seated.select("lang", "size", "seats", nobody.alias("visitors")).mapInArrow(_meet, "lang string, source string, item string, value long")
    for pairs in tournament():
        host = F.create_map(*[F.lit(x) for a, b in pairs for x in (b, a)])
        visits = seated.select("lang", "block", host[F.col("station")].alias("station"), F.col("seats").alias("visitors")).where("station is not null")
        meetings = seated.join(visits, ["lang", "block", "station"]).select("lang", "size", "seats", "visitors")
        met = met.unionAll(meetings.mapInArrow(_meet, "lang string, source string, item string, value long"))
    return met.groupBy(*_GROUP, "item").agg(F.sum("value").alias("value"))


def audit_sources(docs: DataFrame) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value and rank."""
    kept = materialize(kept_cells(docs), "cells")
    groups = materialize(seat_groups(docs, kept), "groups")
    packed = materialize(pack_blocks(kept, groups), "blocks")
    pairs = pair_divergences(materialize(seat_vectors(packed, groups), "seats")).withColumn("part", F.lit("pair"))
    terms = packed.where("item is not null").select(*_GROUP, "item", "value").withColumn("part", F.lit("term"))
    rank = F.row_number().over(Window.partitionBy(*_GROUP).orderBy(F.desc("value"), "item")).alias("rank")
    columns = [*_GROUP, "part", "item", "value"]
    return pairs.select(*columns, rank).unionAll(terms.select(*columns, rank).where(F.col("rank") <= TOP))
