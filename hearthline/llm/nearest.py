"""Nearest neighbours by largest inner product, through cross-polytope hashing.

Vectors are turned to unit length (where lengths differ, a further coordinate
makes up the difference, so that angles follow inner products) and rotated by
three rounds of random signs and a fast Hadamard transform. A hash is the nearest
signed axis; where a table has more vectors than one hash can part into blocks,
its buckets are the axes of several rotations. A query probes, in every table,
the buckets that its own rotations favour. How many is fitted: for a bounded
sample of FIT_QUERIES vectors the true neighbours among all vectors are found in
one pass, and the fewest probes that meet FIT_RECALL of them are taken.
Candidates are reranked by exact inner products of the original vectors.

Every vector is indexed. Buckets lie in places of about BLOCK vectors; a query is
sent only to the places that hold buckets it probes, once to each. What one place
has over BLOCK vectors, or QUERY_BLOCK queries, is dealt over several steps, so
none is dropped. Equal vectors are one class that is searched once, and of which
the smallest k + 1 ids can matter. A query for which too few candidates were
found is searched again in all places.

Vectors that are null, zero, or hold null or non-finite components take no part,
nor do those of another length than most, or with a null vec_id. Where there are
fewer candidates than k, all are returned; an empty table gives an empty table.
Rows that repeat an id and its vector count once. Columns other than vec_id and embedding are not read.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType
from pyspark.sql.window import Window

from .common import column_udf, join_spread, materialize

TABLES, ROUNDS = 4, 3
FIT_QUERIES, FIT_RECALL = 128, 0.95
#: Vectors of a place, and queries, that meet in one step.
BLOCK, QUERY_BLOCK = 8192, 8192
#: A table has this many places at least: about as many as a query probes buckets, so
#: that what a query brings back doesn't grow with the table.
LEAST_PLACES = 16
#: Rotations of which a bucket may be made: enough for 10^12 vectors of 64 components.
MOST_HASHES = 4


@functools.cache
def _signs(size: int) -> np.ndarray:
    return np.random.default_rng(17).choice(np.array([-1.0, 1.0], np.float32), (TABLES, MOST_HASHES, ROUNDS, size))


def _rotate(x: np.ndarray, table: int, which: int) -> np.ndarray:
    """Pseudo-random rotation: signs and Hadamard transforms in n log n."""
    rows, size = x.shape
    for signs in _signs(size)[table, which]:
        x, span = x * signs, 1
        while span < size:
            pair = x.reshape(rows, size // (2 * span), 2, span)
            x = np.stack([pair[:, :, 0] + pair[:, :, 1], pair[:, :, 0] - pair[:, :, 1]], 2).reshape(rows, size)
            span *= 2
        x = x / np.float32(math.sqrt(size))
    return x


class Hashing:
    """How vectors are filed: their longest length, coordinates after padding,
    whether all lengths are alike, rotations in a bucket, and places in a table."""

    def __init__(self, longest: float, low: float, size: int, classes: int):
        self.longest, self.even = longest, longest <= 1.001 * low
        self.padded = max(8, 1 << (size - 1 if self.even else size).bit_length())
        self.axes = 2 * self.padded
        self.hashes = 1
        while self.hashes < MOST_HASHES and classes > BLOCK * self.axes**self.hashes:
            self.hashes += 1
        self.buckets = self.axes**self.hashes
        self.places = min(self.buckets, max(LEAST_PLACES, -(-classes // BLOCK)))

    def place(self, table: int, bucket: np.ndarray) -> np.ndarray:
        return table * self.places + bucket * self.places // self.buckets

    def _directions(self, x: np.ndarray, query: bool) -> np.ndarray:
        """Unit vectors for hashing, filled up to a power of two."""
        out = np.zeros((len(x), self.padded), np.float32)
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        out[:, : x.shape[1]] = x / (norm if query or self.even else self.longest)
        if not self.even and not query:
            out[:, x.shape[1]] = np.sqrt(np.maximum(0, 1 - (norm[:, 0] / self.longest) ** 2))
        return out

    def bucket(self, x: np.ndarray, table: int) -> np.ndarray:
        """The nearest signed axes, as one number: an axis is twice its number, and one more where negative."""
        directions, out = self._directions(x, False), np.zeros(len(x), np.int64)
        for h in range(self.hashes):
            r = _rotate(directions, table, h)
            best = np.abs(r).argmax(1)
            out = out * self.axes + best * 2 + (r[np.arange(len(r)), best] < 0)
        return out

    def _favour(self, x: np.ndarray, table: int) -> list[np.ndarray]:
        """How much each query favours each signed axis, for every rotation of a bucket."""
        directions, out = self._directions(x, True), []
        for h in range(self.hashes):
            r = _rotate(directions, table, h)
            out.append(np.stack([r, -r], 2).reshape(len(r), -1))
        return out

    def probes(self, x: np.ndarray, table: int, count: int) -> np.ndarray:
        """The count buckets that each query favours most (the sum over a bucket's axes)."""
        total = number = None
        for favour in self._favour(x, table):
            take = np.argsort(-favour, axis=1, kind="stable")[:, : min(count, self.axes)]
            score = np.take_along_axis(favour, take, 1)
            if total is None:
                total, number = score, take
            else:
                total = (total[:, :, None] + score[:, None]).reshape(len(x), -1)
                number = (number[:, :, None] * self.axes + take[:, None]).reshape(len(x), -1)
                best = np.argsort(-total, axis=1, kind="stable")[:, :count]
                total, number = np.take_along_axis(total, best, 1), np.take_along_axis(number, best, 1)
        return number

    def needed(self, x: np.ndarray, found: np.ndarray) -> np.ndarray:
        """For one query and the vectors found for it: at which probe each would be met at the earliest."""
        best = np.full(len(found), self.buckets, np.int64)
        for t in range(TABLES):
            favour, bucket = self._favour(x[None], t), self.bucket(found, t)
            digits = [bucket // self.axes ** (self.hashes - 1 - h) % self.axes for h in range(self.hashes)]
            mine = sum(f[0][d] for f, d in zip(favour, digits))
            sums = np.sort(favour[0][0])
            for f in favour[1:-1]:  # all sums but those with the last axis
                sums = np.sort((sums[:, None] + f[0]).ravel())
            if self.hashes == 1:
                before = len(sums) - np.searchsorted(sums, mine, side="right")
            else:
                before = sum(len(sums) - np.searchsorted(sums, mine - last, side="right") for last in favour[-1][0])
            best = np.minimum(best, before)
        return best


def _usable(v: Column) -> Column:
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0)


def _matrix(values: pa.Array) -> np.ndarray:
    """Equally long vectors, in double precision."""
    flat = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(values), -1)


def _stack(values: pd.Series) -> np.ndarray:
    return np.array(values.to_list(), np.float64)


def _top(scores: np.ndarray, names: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of each row and their names."""
    best = np.argpartition(-scores, k - 1, axis=1)[:, :k] if scores.shape[1] > k else np.broadcast_to(np.arange(scores.shape[1]), scores.shape)
    return np.take_along_axis(scores, best, 1), np.take_along_axis(names, best, 1)


def _fit_probes(classes: DataFrame, hashing: Hashing, k: int) -> int:
    """The fewest probes that meet the wanted share of the sample's true
    neighbours: the sample is held against every vector in one pass."""
    sample = classes.select("rep", "vec").orderBy(F.xxhash64("rep"), "rep").limit(FIT_QUERIES).toPandas()  # bounded
    ids, q = sample["rep"].to_numpy(), _stack(sample["vec"])

    def search(batches):
        scores, names, vectors = np.empty((len(q), 0)), np.empty((len(q), 0), np.int64), np.empty((0, q.shape[1]))
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                rep, x = part.column(0).to_numpy(), _matrix(part.column(1))
                fresh = q @ x.T
                fresh[ids[:, None] == rep[None]] = -np.inf
                places = np.broadcast_to(np.arange(len(vectors), len(vectors) + len(x)), fresh.shape)
                scores, names = _top(np.concatenate([scores, fresh], 1), np.concatenate([names, places], 1), k)
                kept, names = np.unique(names, return_inverse=True)
                names, vectors = names.reshape(scores.shape), np.concatenate([vectors, x])[kept]
        for i in range(len(q)):
            real = scores[i] > -np.inf
            need = hashing.needed(q[i], vectors[names[i][real]])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(need), i)), pa.array(scores[i][real]), pa.array(need)], ["query", "score", "needed"])

    met = classes.select("rep", "vec").mapInArrow(search, "query long, score double, needed long")
    w = Window.partitionBy("query").orderBy(F.desc("score"), "needed")
    needed = met.withColumn("n", F.row_number().over(w)).where(F.col("n") <= k).select("needed").toPandas()["needed"].to_numpy()  # k for each of the sample
    return int(np.quantile(needed, FIT_RECALL)) + 1 if len(needed) else 1


def _search(queries: DataFrame, filed: DataFrame, hashing: Hashing, probes: int | None, k: int) -> DataFrame:
    """rep, other and score: the k + 1 nearest classes found for each query class.
    filed: rep, vec, place and bucket of every class and table. Without a number
    of probes a query goes to all places of one table."""

    def send():
        def step(vectors):
            x, out = _matrix(vectors), [[] for _ in range(len(vectors))]
            for t in range(TABLES if probes else 1):
                if not probes:
                    for places in out:
                        places += [{"place": p, "probes": b""} for p in range(hashing.places)]
                    continue
                wanted = np.sort(hashing.probes(x, t, probes), axis=1)
                place = hashing.place(t, wanted)
                for places, w, p in zip(out, wanted, place):
                    edges = np.flatnonzero(np.diff(p, prepend=-1)).tolist()
                    places += [{"place": int(p[a]), "probes": w[a:b].tobytes()} for a, b in zip(edges, [*edges[1:], len(p)])]
            return out

        return step

    sent = column_udf("array<struct<place:long,probes:binary>>", send)
    asked = materialize(queries.select("rep", "vec", F.explode(sent("vec")).alias("to")).select("rep", "vec", "to.*"), "asked")
    held = filed.groupBy("place").agg(F.count("*").alias("held")).join(asked.groupBy("place").agg(F.count("*").alias("asking")), "place")
    parts = held.select("place", "held", "asking", F.ceil(F.col("held") / BLOCK).cast("int").alias("parts"), F.ceil(F.col("asking") / QUERY_BLOCK).cast("int").alias("turns"))
    parts = materialize(parts, "places")
    rows, asks = parts.agg(F.coalesce(F.sum("held"), F.lit(0)), F.coalesce(F.sum("asking"), F.lit(0))).first()
    dealt = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    index = join_spread(filed, parts, "place", rows, "rep", "held").select("rep", "vec", "bucket", "place", dealt("parts").alias("part"), all_of("turns").alias("turn"))
    asked = join_spread(asked, parts, "place", asks, "rep", "asking").select("rep", "vec", "probes", "place", dealt("turns").alias("turn"), all_of("parts").alias("part"))

    def meet(rows: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        if rows.empty or ask.empty:
            return pd.DataFrame({"rep": [], "other": [], "score": []})
        rows = rows.sort_values("bucket", kind="stable")
        x, q, ids = _stack(rows["vec"]), _stack(ask["vec"]), rows["rep"].to_numpy()
        bucket, starts = np.unique(rows["bucket"].to_numpy(), return_index=True)
        stops = np.append(starts[1:], len(x))
        wanted = [np.frombuffer(p, np.int64) for p in ask["probes"]]
        which = np.repeat(np.arange(len(q)), [len(w) or len(bucket) for w in wanted])
        what = np.concatenate([w if len(w) else bucket for w in wanted])
        order = np.argsort(what, kind="stable")
        which, what = which[order], what[order]
        best, who = np.full((len(q), k + 1), -np.inf), np.full((len(q), k + 1), -1)
        for b, start, stop in zip(bucket, starts, stops):
            asking = which[np.searchsorted(what, b) : np.searchsorted(what, b, side="right")]
            for at in range(0, len(asking), 512):
                take = asking[at : at + 512]
                scores = np.concatenate([best[take], q[take] @ x[start:stop].T], 1)
                named = np.concatenate([who[take], np.broadcast_to(np.arange(start, stop), (len(take), stop - start))], 1)
                best[take], who[take] = _top(scores, named, k + 1)
        i, j = np.nonzero(who >= 0)
        exact = np.einsum("ij,ij->i", q[i], x[who[i, j]])
        return pd.DataFrame({"rep": ask["rep"].to_numpy()[i], "other": ids[who[i, j]], "score": exact})

    keys = ["place", "part", "turn"]
    met = index.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(meet, "rep long, other long, score double")
    w = Window.partitionBy("rep").orderBy(F.desc("score"), "other")
    found = met.groupBy("rep", "other").agg(F.max("score").alias("score"))
    return found.withColumn("n", F.row_number().over(w)).where(F.col("n") <= k + 1).drop("n")


def nearest_neighbours(vectors: DataFrame, every: int = 20, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id and score for every row whose id is divisible by every."""
    kind = vectors.schema["embedding"].dataType
    exact = "array<float>" if isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType) else "array<double>"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(exact).alias("vec")).where(F.col("vec_id").isNotNull() & _usable(F.col("vec")))
    usual = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    if usual is None:
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score"))
    size = usual["n"]
    rows = rows.where(F.size("vec") == size)
    is_query = F.pmod("vec_id", F.lit(every)) == 0
    each = rows.groupBy("vec", "vec_id").agg(F.max(is_query).alias("asked"))
    classes = materialize(each.groupBy("vec").agg(F.min("vec_id").alias("rep"), F.count_if("asked").alias("asking"), F.count("*").alias("ids")), "classes")
    length = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x))
    low, high, total, count, asking = classes.agg(F.min(length), F.max(length), F.sum("ids"), F.count("*"), F.sum("asking")).first()
    hashing = Hashing(float(high), float(low), size, count)
    probes = _fit_probes(classes, hashing, k)

    def file():
        def step(vectors):
            x = _matrix(vectors)
            found = [hashing.bucket(x, t) for t in range(TABLES)]
            placed = [hashing.place(t, b) for t, b in enumerate(found)]
            return [[{"place": int(p[i]), "bucket": int(b[i])} for p, b in zip(placed, found)] for i in range(len(x))]

        return step

    filing = column_udf("array<struct<place:long,bucket:long>>", file)
    filed = materialize(classes.select("rep", "vec", F.explode(filing("vec")).alias("at")).select("rep", "vec", "at.*"), "filed")
    queries = classes.where("asking > 0").select("rep", "vec")
    found = materialize(_search(queries, filed, hashing, probes, k), "found")

    ids = classes.select(F.col("rep").alias("other"), "ids")
    reached = found.join(ids, "other").groupBy("rep").agg(F.sum("ids").alias("reached"))
    short = queries.join(reached, "rep", "left").where(F.coalesce("reached", F.lit(0)) < min(k + 1, int(total))).select("rep", "vec")
    short = materialize(short, "short")
    if not short.isEmpty():
        first_table = filed.where(F.col("place") < hashing.places)
        again = _search(short, first_table, hashing, None, k)
        found = materialize(found.join(short.select("rep"), "rep", "left_anti").unionByName(again), "found")

    # the smallest ids of each class, then the best k + 1 rows for each query class
    w = Window.partitionBy("vec").orderBy("vec_id")
    few = each.select("vec", "vec_id").withColumn("copy", F.row_number().over(w)).where(F.col("copy") <= k + 1)
    lists = few.groupBy("vec").agg(F.min("vec_id").alias("other"), F.collect_list("vec_id").alias("members"))
    met = found.groupBy("other").agg(F.count("*").alias("count")).join(lists.select("other", "members"), "other")
    candidates = join_spread(found, met, "other", found.count(), "rep").select("rep", "score", F.explode("members").alias("vec_id"))
    w = Window.partitionBy("rep").orderBy(F.desc("score"), "vec_id")
    best = candidates.withColumn("n", F.row_number().over(w)).where(F.col("n") <= k + 1)
    near = best.groupBy("rep").agg(F.collect_list(F.struct("score", "vec_id")).alias("near"))
    answers = near.join(classes.select("rep", "vec", "asking"), "rep").select("vec", "asking", "near")
    asked = each.where("asked").select("vec", F.col("vec_id").alias("query_id"))
    each_answer = join_spread(asked, answers, "vec", asking, "query_id", "asking").select("query_id", F.explode("near").alias("x")).select("query_id", "x.*").where("vec_id <> query_id")
    nearest = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return each_answer.withColumn("rank", F.row_number().over(nearest).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
