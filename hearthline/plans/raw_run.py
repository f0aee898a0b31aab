"""From a folder of raw files to features and estimates.

The folder holds postcodes.csv, sales/ (sold prices), certificates/ (searched with its
folders), stations.csv, schools.csv, crime.csv, price_index.csv and, if there is one,
a hospital file. Processed tables are kept beside them in processed/ and read again
by later runs over the same files with the same settings, unless a refresh is asked for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..functions import text as T
from ..operators.comparables import comparable_estimates
from ..operators.valuation import estimates
from ..sources import readers, tables
from .valuation_run import base_features, enriched_features


#: Names of the hospital file; the first that is there counts.
HOSPITAL_FILES = ("London hospitals.csv", "hospitals.csv", "Hospital.csv")


def _hospitals(spark: SparkSession, folder: str, postcodes: DataFrame) -> DataFrame:
    for name in HOSPITAL_FILES:
        try:
            return readers.read_hospitals(spark, f"{folder}/{name}", postcodes)
        except AnalysisException:  # there is no such file
            continue
    return spark.createDataFrame([], "src_ord long, name string, latitude double, longitude double")


class Processed:
    """The processed tables of a folder. Each has the fingerprint of its raw files, of
    the tables it is made from and of the settings that change it, so a run never
    reads what was made from other files or for other settings."""

    def __init__(self, spark: SparkSession, folder: str, config: EngineConfig):
        self.spark, self.folder, self.config = spark, folder, config
        self.versions: dict[str, str] = {}

    def table(self, name: str, files: list[str], make: Callable[[], DataFrame], *settings: object) -> DataFrame:
        self.versions[name] = version = tables.fingerprint(self.spark, [f"{self.folder}/{f}" for f in files], settings)
        return tables.read_through(self.spark, f"{self.folder}/processed/{name}", make, self.config.refresh, version)

    def postcodes(self) -> DataFrame:
        """All postcodes of the capital."""
        return self.table("all_postcodes", ["postcodes.csv"], lambda: readers.read_postcodes(self.spark, f"{self.folder}/postcodes.csv").drop("ord"))

    def of_wanted(self, name: str, files: str, read: Callable, ids: str) -> DataFrame:
        """Rows of the wanted postcodes, numbered; filtered once more when they are read back."""
        everywhere = self.postcodes()
        wanted = everywhere.where(T.any_prefix(F.col("postcode_clean"), self.config.prefixes)) if self.config.prefixes else everywhere
        make = lambda: readers.with_ids(read(self.spark, f"{self.folder}/{files}", wanted), ids).drop("ord")
        found = self.table(name, [files], make, self.versions["all_postcodes"], sorted(self.config.prefixes))
        return readers.of_postcodes(found, wanted)

    def sales(self) -> DataFrame:
        return self.of_wanted("sales", "sales", readers.read_sales, "sale_id")

    def certificates(self) -> DataFrame:
        return self.of_wanted("certificates", "certificates", readers.read_certificates, "id")


def features_from_files(spark: SparkSession, folder: str, config: EngineConfig) -> DataFrame:
    """The feature table; its parts are read through processed/."""
    kept = Processed(spark, folder, config)
    everywhere, sales, certificates = kept.postcodes(), kept.sales(), kept.certificates()

    def features() -> DataFrame:
        return enriched_features(
            tables.staged(base_features(certificates, sales), "base"),
            readers.read_stations(spark, f"{folder}/stations.csv"),
            readers.read_schools(spark, f"{folder}/schools.csv", everywhere),
            _hospitals(spark, folder, everywhere),
            readers.read_postcode_areas(spark, f"{folder}/postcodes.csv"),
            readers.read_crime(spark, f"{folder}/crime.csv"),
            readers.read_price_index(spark, f"{folder}/price_index.csv"),
            config.as_of,
        )

    files = ["stations.csv", "schools.csv", *HOSPITAL_FILES, "postcodes.csv", "crime.csv", "price_index.csv"]
    return kept.table("features", files, features, sorted(kept.versions.items()), config.as_of.isoformat())


def value_files(spark: SparkSession, folder: str, config: EngineConfig) -> DataFrame:
    """Estimates of all dwellings that have a certificate."""
    features = features_from_files(spark, folder, config)
    return estimates(features, comparable_estimates(features), config.as_of)
