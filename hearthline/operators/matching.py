"""Linking dwellings with sales: exact core addresses first, then scored candidates.

A score only depends on which parts of the address are equal, missing or different,
so sales are summed up under each set of parts and dwellings look sets up: the
rows of every join are some times the dwellings or the sales, however many of both a
postcode has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.dates import date_key
from ..sources.tables import staged

#: Points for each part that is equal, and for one that differs.
POINTS = {"core": (8, 0), "unit": (6, -4), "house": (5, -3), "street": (3, -1), "building": (3, -1)}
LEAST_SCORE = 5


def describe_dwellings(certificates: DataFrame) -> DataFrame:
    """id, postcode_clean and the parts that matching compares."""
    source = T.first_filled(F.col("address"), F.col("address1"), F.col("full_address"))
    return certificates.select(
        "id",
        T.or_null(F.col("postcode_clean")).alias("postcode_clean"),
        T.certificate_core(F.col("address"), F.col("address1")).alias("core"),
        T.extract_unit(source).alias("unit"),
        F.coalesce(T.normalize_house_number(F.col("house_number")), T.house_number_of_address(source)).alias("house"),
        T.normalize_text(T.last_address_part(F.col("address"))).alias("street"),
        T.building_name(F.col("address")).alias("building"),
    )


def describe_sales(sales: DataFrame) -> DataFrame:
    """sale_id, postcode_clean, full_address, dkey and the parts that matching compares.
    A sale without a house number takes one from its full address."""
    house = F.coalesce(T.normalize_house_number(F.col("house_number")), T.house_number_of_address(F.col("full_address")))
    with_house = sales.withColumn("house", house)
    return with_house.select(
        "sale_id",
        "postcode_clean",
        "full_address",
        date_key(F.col("transfer_date")).alias("dkey"),
        T.sale_core(F.col("unit"), F.col("house"), F.col("building_name"), F.col("street")).alias("core"),
        T.normalize_text(F.col("unit")).alias("unit"),
        "house",
        T.normalize_text(F.col("street")).alias("street"),
        T.normalize_text(F.col("building_name")).alias("building"),
    )


def latest_sale_by_core(sold: DataFrame) -> DataFrame:
    """The latest sale of each postcode and core address; the last arrival wins ties."""
    keyed = sold.where("core is not null and postcode_clean is not null")
    return keyed.groupBy("postcode_clean", "core").agg(F.max_by("sale_id", F.struct("dkey", "sale_id")).alias("exact_id"))


def choose_pools(dwellings: DataFrame, sold: DataFrame) -> DataFrame:
    """pool and pool_key: the unit's sales where there are any, else the house
    number's, else the whole postcode's."""
    keys = lambda part, flag: sold.where(F.col(part).isNotNull()).select("postcode_clean", part).distinct().withColumn(flag, F.lit(True))
    found = dwellings.join(keys("unit", "has_unit"), ["postcode_clean", "unit"], "left").join(keys("house", "has_house"), ["postcode_clean", "house"], "left")
    pool = F.when(F.col("has_unit"), "U").when(F.col("has_house"), "H").otherwise("P")
    key = F.when(F.col("has_unit"), F.col("unit")).when(F.col("has_house"), F.col("house")).otherwise("")
    return found.withColumn("pool", pool).withColumn("pool_key", key).drop("has_unit", "has_house")


#: The parts that tell candidates apart: an equal core was matched before. Each has a bit in the masks below.
PARTS = ("unit", "house", "street", "building")
_ALL = (1 << len(PARTS)) - 1


def _points(mine: int, equal: int, nulls: int) -> int:
    """The score of a sale whose parts in the mask equal are the dwelling's, whose parts
    in nulls are missing and whose others differ; mine: the parts that the dwelling has."""
    same, other = ([POINTS[p][i] for p in PARTS] for i in (0, 1))
    return sum(same[b] if equal >> b & 1 else other[b] if mine & ~nulls & _ALL & 1 << b else 0 for b in range(len(PARTS)))


def _submasks(mask: int) -> list[int]:
    return [m for m in range(mask + 1) if m & ~mask == 0]


def _asked_masks() -> list[tuple[str, int, int, int, int]]:
    """pool, mine, equal, nulls and score of all that a dwelling may look up: what is
    in its pool and scores enough. A sale found under fewer equal parts than it has
    scores too little there, and is found with its own score elsewhere."""
    unit, house = 1, 2
    fits = {"U": lambda e: e & unit, "H": lambda e: e & house and not e & unit, "P": lambda e: not e & (unit | house)}
    out = []
    for mine in range(_ALL + 1):
        for equal in _submasks(mine):
            for nulls in _submasks(_ALL & ~equal):
                score = _points(mine, equal, nulls)
                out += [(pool, mine, equal, nulls, score) for pool, fit in fits.items() if score >= LEAST_SCORE and fit(equal)]
    return out


def _bits() -> Column:
    """The parts that are there."""
    return sum((F.when(F.col(p).isNotNull(), 1 << b).otherwise(0) for b, p in enumerate(PARTS)), F.lit(0))


def _key(equal: Column) -> Column:
    """The values of the parts in a mask."""
    return F.concat_ws("\x01", *[F.when(equal.bitwiseAND(1 << b) > 0, F.col(p)) for b, p in enumerate(PARTS)])


def _summary() -> list[Column]:
    """Of sales that count alike: the latest (the first to arrive of equal dates), and the least and greatest address."""
    address = F.coalesce("full_address", F.lit("\x00"))
    return [F.max(F.struct("dkey", (-F.col("sale_id")).alias("back"))).alias("latest"), F.min(address).alias("low"), F.max(address).alias("high")]


def sale_classes(sold: DataFrame) -> DataFrame:
    """Sales of a postcode with the same parts are one class."""
    return sold.where("postcode_clean is not null").groupBy("postcode_clean", *PARTS).agg(*_summary())


def score_candidates(pooled: DataFrame, sold: DataFrame) -> DataFrame:
    """id and, for each score of candidates in the dwelling's pool that is enough, the
    latest sale and the least and greatest address. No dwelling meets single sales:
    classes are summed up under each set of parts that might be equal, and a dwelling
    looks up the few sets that would score enough for it."""
    asked = _asked_masks()
    worth = sorted({equal for _, _, equal, _, _ in asked})
    classes = sale_classes(sold).withColumn("nulls", F.lit(_ALL) - _bits())
    views = classes.withColumn("equal", F.explode(F.filter(F.array(*map(F.lit, worth)), lambda e: e.bitwiseAND(F.col("nulls")) == 0)))
    summed = [F.max("latest").alias("latest"), F.min("low").alias("low"), F.max("high").alias("high")]
    keyed = views.withColumn("key", _key(F.col("equal"))).groupBy("postcode_clean", "nulls", "equal", "key").agg(*summed)
    masks = pooled.sparkSession.createDataFrame(asked, "pool string, mine int, equal int, nulls int, score int")
    lookups = pooled.withColumn("mine", _bits()).join(F.broadcast(masks), ["pool", "mine"])  # a few hundred rows, whatever the data
    met = lookups.withColumn("key", _key(F.col("equal"))).select("id", "score", "postcode_clean", "nulls", "equal", "key").join(keyed, ["postcode_clean", "nulls", "equal", "key"])
    return met.groupBy("id", "score").agg(*summed)


def best_of_scores(by_score: DataFrame) -> DataFrame:
    """id, sale_id and score of the best candidate; none where the best score is too
    low or stands for several addresses. From one row for each id and score."""
    best = by_score.groupBy("id").agg(F.max_by(F.struct("low", "high", "latest"), "score").alias("x"), F.max("score").alias("score"))
    return best.where((F.col("score") >= LEAST_SCORE) & (F.col("x.low") == F.col("x.high"))).select("id", (-F.col("x.latest.back")).alias("sale_id"), "score")


def best_candidates(scored: DataFrame) -> DataFrame:
    """The same from single candidates: id, sale_id, score, dkey and full_address."""
    return best_of_scores(scored.groupBy("id", "score").agg(*_summary()))


def match_counts(matched: DataFrame) -> DataFrame:
    """One row: dwellings, how many have a sale, and how many have none."""
    found = F.col("sale_id").isNotNull()
    return matched.agg(F.count("*").alias("n"), F.count_if(found).alias("matched"), F.count_if(~found).alias("unmatched"))


def match_sales(certificates: DataFrame, sales: DataFrame) -> DataFrame:
    """id, sale_id and match_kind (exact, scored; null without a match) of every certificate."""
    # text is normalised once for each side; all the joins below start from these tables
    dwellings, sold = staged(describe_dwellings(certificates), "dwellings"), staged(describe_sales(sales), "sold")
    exact = staged(dwellings.join(latest_sale_by_core(sold), ["postcode_clean", "core"], "left"), "exact")
    scored = best_of_scores(score_candidates(choose_pools(exact.where("exact_id is null and postcode_clean is not null").drop("exact_id"), sold), sold))
    both = exact.select("id", "exact_id").join(scored.withColumnRenamed("sale_id", "scored_id"), "id", "left")
    kind = F.when(F.col("exact_id").isNotNull(), "exact").when(F.col("scored_id").isNotNull(), "scored")
    return both.select("id", F.coalesce("exact_id", "scored_id").alias("sale_id"), kind.alias("match_kind"))
