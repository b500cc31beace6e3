"""A kept store of the addresses that earlier runs have seen."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from noticeloom.session import write_out
from noticeloom.streaming.incremental import url_key


class SeenStore:
    """Address keys in ``buckets`` folders by hash, and a Bloom filter of each bucket.

    A run reads the filters, which take a few bits a key, and of the keys themselves only
    the buckets in which a filter says that one of the run's addresses may be. ``bits`` is
    the length of a bucket's filter; at ten bits a key one address in a hundred is looked up in vain.
    What a run adds are files of their own, named by the run, and a run that is
    repeated replaces its own.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64, bits: int = 1 << 20):
        if bits % 8:
            raise ValueError("a filter has whole bytes")
        self.spark, self.path, self.buckets, self.bits = spark, path.rstrip("/"), buckets, bits

    def _read(self, part: str, schema: str) -> DataFrame | None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{part}")
        if not path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return None
        return self.spark.read.schema(schema).parquet(f"{self.path}/{part}")

    def _marked(self, keys: DataFrame) -> DataFrame:
        """``bucket`` and the bits of each ``url_key``: four, from two halves of its hash."""
        h = F.xxhash64("url_key")
        step = F.shiftrightunsigned(h, 33).bitwiseOR(F.lit(1))
        bits = F.array(*[F.pmod(h + step * i, F.lit(self.bits)).cast("int") for i in range(4)])
        return keys.withColumns({
            "bucket": F.pmod(F.hash("url_key"), F.lit(self.buckets)), "bits": F.array_distinct(bits)})

    def _words(self, marked: DataFrame) -> DataFrame:
        """``bucket, word, bits``: the filters as numbers of 32 bits, those that are not 0."""
        return marked.select("bucket", F.explode("bits").alias("bit")).groupBy(
            "bucket", F.shiftright("bit", 5).alias("word")).agg(
            F.bit_or(F.expr("shiftleft(1, bit & 31)")).alias("bits"))

    def unseen(self, pages: DataFrame, url: str = "url") -> DataFrame:
        """The rows of ``pages`` whose address no earlier run has added, with their ``url_key``.

        Addresses that no filter knows are new at once; only the others meet the keys of the buckets
        they are in, so the answer is exact.
        """
        keyed = pages.withColumn("url_key", url_key(F.col(url)))
        filters = self._read("filters", "bucket int, word int, bits int, run string")
        if filters is None:
            return keyed
        merged = filters.groupBy("bucket", "word").agg(F.bit_or("bits").alias("have"))
        # The different keys of the run; a key may be there if all its bits are set.
        marked = self._marked(keyed.select("url_key").distinct())
        asked = marked.select("url_key", "bucket", F.size("bits").alias("n"), F.explode("bits").alias("bit"))
        met = asked.join(merged, (asked["bucket"] == merged["bucket"])
                         & (F.shiftright("bit", 5) == merged["word"])).where(
            F.expr("have & shiftleft(1, bit & 31)") != 0)
        maybe = write_out(met.groupBy("url_key", asked["bucket"], "n").count().where("count = n").select(
            "url_key", "bucket"), "maybe")
        # As many numbers as buckets; they become a filter on the folders that are read.
        buckets = [r.bucket for r in maybe.select("bucket").distinct().collect()]
        return keyed.join(self.known(buckets).join(maybe, "url_key", "left_semi").select("url_key"),
                          "url_key", "left_anti")

    def known(self, buckets: list[int] | None = None) -> DataFrame:
        """The keys of these buckets, of all without a list."""
        keys = self._read("keys", "url_key string, bucket int, run string")
        if keys is None:
            return self.spark.createDataFrame([], "url_key string, bucket int, run string")
        return keys if buckets is None else keys.where(F.col("bucket").isin(buckets))

    def add(self, pages: DataFrame, run: str | None = None, url: str = "url") -> None:
        """Keep the addresses of ``pages`` as seen by ``run``."""
        run = run or uuid.uuid4().hex
        marked = write_out(self._marked(
            pages.where(F.col(url).isNotNull()).select(url_key(F.col(url)).alias("url_key")).distinct())
            .withColumn("run", F.lit(run)), "seen")
        # A task writes whole buckets, so a run adds a file or a few to each.
        (marked.select("url_key", "bucket", "run").repartition("bucket").write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "run").parquet(f"{self.path}/keys"))
        (self._words(marked).withColumn("run", F.lit(run)).repartition("bucket").write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("run").parquet(f"{self.path}/filters"))
