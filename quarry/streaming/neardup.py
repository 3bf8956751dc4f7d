"""Near-duplicates in a stream: an index of the admitted items that grows with the batches, and forgets the oldest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import dedupe
from quarry.sources.versioned import VersionedTable
from quarry.sources.working import dropped, written


class NearDuplicateIndex:
    """Items in batches, in the order of their ids: one that reaches the threshold with an admitted earlier one is its duplicate, else it is admitted.

    sets holds the shingles of the admitted items and decisions what became of every item, by bucket of the id. A batch meets the index by its prefix shingles only. Beyond `most` admitted items
    the oldest ids are forgotten, after each batch. Batches have numbers: one that comes again changes nothing.
    """

    def __init__(self, spark: SparkSession, path: str, threshold: float = 0.8, most: int | None = None, buckets: int = 16):
        self.spark, self.threshold, self.most = spark, threshold, most
        self.sets = VersionedTable(spark, f"{path}/sets", "id", "id long, set array<long>", buckets)
        self.decisions = VersionedTable(spark, f"{path}/decisions", "id", "id long, is_duplicate boolean, duplicate_of array<long>", buckets)

    def add(self, items: DataFrame, batch: int) -> None:
        """Decide a batch of items (id, title, text). Equal texts are one set, that of their first item; only that one can be admitted. Items without an id meet nothing."""
        texts = written(dedupe.hashed_texts(items), "new")
        n, ids = texts.agg(F.count("id"), F.count_distinct("id")).first()
        if n > ids:  # a row that came twice
            twice, texts = texts, written(texts.where("id IS NOT NULL").dropDuplicates(["id"]).unionByName(texts.where("id IS NULL")), "new")
            dropped(twice)
        first = texts.where("key IS NOT NULL").groupBy("key").agg(F.min("id").alias("rep"), F.count("*").alias("n")).where("n > 1")
        copies = written(texts.select("id", "key").join(first, "key").where("id > rep").select("id", "rep"), "copies")
        new = texts.where("id IS NOT NULL AND set IS NOT NULL").select("id", "set").join(copies.select("id"), "id", "left_anti")
        # What the index was before this batch: a batch that is delivered again finds the same.
        pairs = self._matched(new, self.sets.read(self._before(batch)))
        paired = pairs.select("id").unionByName(pairs.select(F.col("first").alias("id"))).distinct()  # all others are admitted
        rejected = written(dedupe.admitted(paired, pairs).where("is_duplicate").select("id"), "rejected")
        near = pairs.select(F.col("id").alias("rep"), "first").unionByName(pairs.select(F.col("first").alias("rep"), F.col("id").alias("first"))).unionByName(copies.select("rep", F.col("rep").alias("first")).distinct())
        near = near.join(rejected.select(F.col("id").alias("first")), "first", "left_anti")
        each = copies.select("rep", "id").unionByName(pairs.select(F.col("id").alias("rep"), "id").distinct())
        found = each.join(near, "rep").where("first < id").groupBy("id").agg(F.array_sort(F.collect_set("first")).alias("duplicate_of"))
        rows = texts.select("id").join(found, "id", "left").select("id", F.col("duplicate_of").isNotNull().alias("is_duplicate"), F.coalesce("duplicate_of", F.array().cast("array<long>")).alias("duplicate_of"))
        rows = written(rows, "decisions")
        self.decisions.append(rows, writer="stream", batch=batch)
        self.sets.append(new.join(rejected, "id", "left_anti"), writer="stream", batch=batch)
        if self.most is not None:
            self._forget()
        dropped(texts, copies, pairs, rejected, rows)

    def _before(self, batch: int) -> int:
        """The last version that holds no row of this batch or later ones."""
        at = self.sets.version()
        while at and self.sets._manifest(at)["batches"].get("stream", -1) >= batch:
            at -= 1
        return at

    def _forget(self) -> None:
        held = self.sets.read()
        over = held.count() - self.most
        if over > 0:
            last = held.select("id").orderBy("id").limit(over).agg(F.max("id")).first()[0]
            self.sets.upsert(held.where(F.col("id") <= last), merge=lambda current, gone: current.where(F.col("id") > last))

    def _matched(self, new: DataFrame, known: DataFrame) -> DataFrame:
        """id, first: every pair of a new item and an earlier one, new or known, at the threshold. Sets this alike share one of the rarest shingles of either, as counted in both, and
        have enough left from the first of these on (as in dedupe.jaccard_pairs)."""
        every = known.select("id", F.lit(False).alias("own"), "set").unionByName(new.select("id", F.lit(True).alias("own"), "set"))
        prefix = written(dedupe.rarest(every, self.threshold), "prefixes")
        mine, theirs = prefix.where("own").drop("own"), prefix.select(F.col("id").alias("first"), F.col("n").alias("m"), F.col("at").alias("m_at"), "h")
        enough = f"least(n - at, m - m_at) >= (n + m) * {self.threshold / (1 + self.threshold)} - 1e-6"
        near = written(mine.join(theirs, "h").where(f"first < id AND n >= m * {self.threshold} AND m >= n * {self.threshold} AND {enough}").select("id", "first").distinct(), "near")
        met = written(near.select("id").unionByName(near.select(F.col("first").alias("id"))).distinct(), "met")
        sets = written(every.join(met, "id", "left_semi"), "met-sets")  # only these are compared
        both = near.join(sets.where("own").select("id", "set"), "id").join(sets.select(F.col("id").alias("first"), F.col("set").alias("other")), "first")
        both = both.select("id", "first", (F.size("set") + F.size("other")).alias("n"), F.size(F.array_intersect("set", "other")).alias("c"))
        found = written(both.where(f"c >= (n - c) * {self.threshold - 1e-9}").select("id", "first"), "matched")
        dropped(prefix, near, met, sets)
        return found

    def write(self, rows: DataFrame, batch: int) -> None:
        """For foreachBatch."""
        self.add(rows, batch)
