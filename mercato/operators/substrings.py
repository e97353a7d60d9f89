"""Substring search by postings of short grams, for many needles at once.

Every different lower-cased name is posted once under its grams of one to three characters. A needle's
rarest grams are looked up, the names that stand under all of them are candidates, and these are
tested whole. So a search reads the postings of a few grams instead of all names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Longest gram; how many of a needle's grams are looked up; folders of the postings.
GRAM, RAREST, BUCKETS = 3, 3, 64


def _runs(text: Column, n: int) -> Column:
    some = F.transform(F.sequence(F.lit(1), F.length(text) - (n - 1)), lambda i: F.substr(text, i, F.lit(n)))
    return F.when(F.length(text) >= n, some).otherwise(F.array().cast("array<string>"))


def grams(text: Column) -> Column:
    """The different runs of one to GRAM characters."""
    return F.array_distinct(F.concat(*[_runs(text, n) for n in range(1, GRAM + 1)]))


def needle_grams(text: Column) -> Column:
    """The different runs of GRAM characters, or a shorter needle itself."""
    return F.when(F.length(text) >= GRAM, F.array_distinct(_runs(text, GRAM))).otherwise(F.array(text))


def _bucket(gram: Column, n: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(n)).cast("int")


class SubstringIndex:
    """Names, postings and gram counts as Parquet in a folder that all executors share.

    Null names are not posted and match nothing; an empty needle or a null one gives no rows, as a
    search without text filters nothing and needs no index; repeated names are posted once and all
    their rows found; repeated needles count once; upper and lower case are alike.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def create(self, rows: DataFrame, name: str = "name") -> SubstringIndex:
        """Indexes the texts of ``rows``; a hash that two names share only makes one more candidate."""
        texts = rows.select(F.lower(name).alias("name")).where("name is not null").distinct().withColumn("id", F.xxhash64("name"))
        texts.write.parquet(f"{self.folder}/names")
        posted = self.names().select(F.explode(grams(F.col("name"))).alias("gram"), "id").withColumn("bucket", _bucket(F.col("gram")))
        # A gram that most names hold is dealt to many files by its names' ids.
        posted.repartition("bucket", F.pmod("id", F.lit(8))).sortWithinPartitions("bucket", "gram").write.partitionBy("bucket").parquet(f"{self.folder}/postings")
        self.postings().groupBy("gram").agg(F.count("*").alias("n")).write.parquet(f"{self.folder}/counts")
        return self

    def names(self) -> DataFrame:
        return self.spark.read.schema("name string, id long").parquet(f"{self.folder}/names")

    def postings(self) -> DataFrame:
        return self.spark.read.schema("gram string, id long, bucket int").parquet(f"{self.folder}/postings")

    def rarest(self, needles: DataFrame, needle: str = "needle") -> DataFrame:
        """``needle, gram, bucket, grams``: the rarest grams of each different needle, and how many they are.

        A gram that no name holds counts as rarest, and so ends the search.
        """
        wanted = needles.select(F.lower(needle).alias("needle")).where("needle <> ''").distinct().select("needle", F.explode(needle_grams(F.col("needle"))).alias("gram"))
        counts = self.spark.read.schema("gram string, n long").parquet(f"{self.folder}/counts")
        counted = wanted.join(counts, "gram", "left")
        order = Window.partitionBy("needle").orderBy(F.coalesce("n", F.lit(0)), "gram")
        few = counted.withColumn("k", F.row_number().over(order)).where(F.col("k") <= RAREST)
        return few.select("needle", "gram", _bucket(F.col("gram")).alias("bucket"), F.max("k").over(Window.partitionBy("needle")).alias("grams"))

    def candidates(self, needles: DataFrame, needle: str = "needle") -> DataFrame:
        """``needle, id``: the names that hold all of a needle's rarest grams. Folders of other grams aren't opened."""
        found = self.rarest(needles, needle).join(self.postings(), ["bucket", "gram"])
        return found.groupBy("needle", "id").agg(F.count("*").alias("n"), F.first("grams").alias("grams")).where("n = grams").select("needle", "id")

    def matches(self, needles: DataFrame, needle: str = "needle") -> DataFrame:
        """``needle, name``: every different name, lower-cased, that contains a needle."""
        return self.candidates(needles, needle).join(self.names(), "id").where(F.contains("name", "needle")).select("needle", "name")

    def rows(self, rows: DataFrame, needles: DataFrame, name: str = "name", needle: str = "needle") -> DataFrame:
        """The rows whose name contains a needle, one for each of these, with the needle in ``__needle``."""
        found = self.matches(needles, needle).select(F.col("needle").alias("__needle"), F.col("name").alias("__name"))
        return rows.join(found, F.lower(rows[name]) == F.col("__name")).drop("__name")
