"""Exact de-duplication by a log-structured merge index, in DataFrame operations only.

Memtables: every input task turns its share into (digest, id) rows. Flush: it writes them as one sorted run with a
Parquet Bloom filter and min/max statistics on the digest. Compaction: the runs merge into one level that keeps the
smallest identifier of each digest and the size of its group. Merging is an aggregation: a task's partial sums leave one row per
digest of its runs before anything is shuffled, so a group that holds a third of all rows is no hot key; the level is sorted by
digest again. Lookups of single digests read the level through its order and filters. Hits: rows whose digest occurs more than once are found through a
filter of fixed size, and their bytes are verified: a group is one text exactly if its least and greatest texts are
equal. Groups that fail (a digest collision) are settled by grouping on the bytes themselves.

Defined results. Null text counts as empty. Identifiers are ordered with nulls last; a group with null identifiers only
has a null keep_id. Of repeated rows with one identifier and equal text exactly one is kept. An empty table gives an
empty result. Other columns are carried through unread, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.llm.common import ROW, SPACE, KeyFilter, packed, unpacked, written

#: Flushed runs carry a Bloom filter on the digest.
RUN_OPTIONS = {"parquet.bloom.filter.enabled#digest": "true", "parquet.bloom.filter.expected.ndv#digest": "1000000"}


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def sha256_hex(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


class MergeIndex:
    """The index over one table. digest: from the normalised text to a string; the default is SHA-256."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest=sha256_hex):
        self.id_col, self.text_col, self.digest = id_col, text_col, digest
        self.rows = packed(docs)
        self.runs = self._flush()
        self.level = self._compact()
        self.hits = self.level.filter("n > 1")
        self.filter = KeyFilter(self.hits, "digest", "dedup-filter")
        self._verify()

    def _keyed(self) -> DataFrame:
        """Input rows with their normalised text and digest, made anew from the table."""
        out = self.rows.withColumn("norm", normalised(F.col(f"{ROW}.`{self.text_col}`")))
        return out.withColumn("digest", self.digest(F.col("norm")))

    def _flush(self) -> DataFrame:
        norm = normalised(F.col(f"{ROW}.`{self.text_col}`"))
        rows = self.rows.select(
            self.digest(norm).alias("digest"),
            F.col(f"{ROW}.`{self.id_col}`").alias("id"),
            F.monotonically_increasing_id().alias("rid"),
            sha256_hex(norm).alias("sha"),
        )
        return written(rows.sortWithinPartitions("digest", "id"), "dedup-run", RUN_OPTIONS)

    def _compact(self) -> DataFrame:
        """One row per digest: the smallest identifier, nulls last, and the group's size."""
        least = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "rid"))
        merged = self.runs.groupBy("digest").agg(least.alias("least"), F.count("*").alias("n"))
        merged = merged.select("digest", F.col("least.id").alias("keep_id"), F.col("least.rid").alias("keep_rid"), "n")
        return written(merged.sortWithinPartitions("digest"), "dedup-level", RUN_OPTIONS)

    def _hit_rows(self) -> DataFrame:
        return self.filter.probe(self._keyed(), "digest").filter("__hit").drop("__hit")

    def _verify(self) -> None:
        """Compare the bytes of every group of equal digests; self.odd holds the digests whose texts differ."""
        spread = self._hit_rows().groupBy("digest").agg(F.min("norm").alias("lo"), F.max("norm").alias("hi"))
        self.odd = written(spread.filter("lo <> hi").select("digest"), "dedup-odd")
        self.clean = self.odd.isEmpty()

    def lookup(self, digests: list[str]) -> DataFrame:
        """(digest, keep_id, n) of the digests that the index holds. The comparison reaches the scan, where statistics of sorted
        pages and Bloom filters skip what can't hold one of them."""
        return self.level.filter(F.col("digest").isin(list(digests))).select("digest", "keep_id", "n")

    def members(self) -> DataFrame:
        """Per input row: id, keep_id, group_size, kept, sha (of the normalised text)."""
        even = self.runs if self.clean else self.runs.join(self.odd, "digest", "left_anti")
        even = even.join(self.hits, "digest", "left").select(
            "id",
            F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
            F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
            F.coalesce(F.col("rid") == F.col("keep_rid"), F.lit(True)).alias("kept"),
            "sha",
        )
        if self.clean:
            return even
        rows = self._odd_rows().withColumn("rid", F.monotonically_increasing_id()).select(
            F.col(f"{ROW}.`{self.id_col}`").alias("id"), "norm", "rid"
        )
        rows = written(rows, "dedup-odd-rows")
        least = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "rid"))
        groups = rows.groupBy("norm").agg(least.alias("least"), F.count("*").alias("n"))
        odd = rows.join(groups, "norm").select(
            "id", F.col("least.id").alias("keep_id"), F.col("n").alias("group_size"),
            (F.col("rid") == F.col("least.rid")).alias("kept"), sha256_hex(F.col("norm")).alias("sha"),
        )
        return even.unionByName(odd)

    def _odd_rows(self) -> DataFrame:
        return self._keyed().join(self.odd, "digest", "left_semi")

    def survivors(self) -> DataFrame:
        """The input rows, with all their columns, that stay. Texts of rows without a hit are never shuffled."""
        probed = self.filter.probe(self._keyed(), "digest")
        alone = unpacked(probed.filter("not __hit"))
        among = probed.filter("__hit").join(self.hits, "digest", "left")
        if not self.clean:
            among = among.join(self.odd, "digest", "left_anti")
        same = F.col(f"{ROW}.`{self.id_col}`").eqNullSafe(F.col("keep_id"))
        single = unpacked(among.filter("n is null"))
        repeated = unpacked(among.filter(F.col("n").isNotNull() & same).dropDuplicates(["digest"]))
        out = alone.unionByName(single).unionByName(repeated)
        if not self.clean:
            rows = self._odd_rows().withColumn("none", F.col(f"{ROW}.`{self.id_col}`").isNull())
            first = rows.groupBy("norm").agg(F.min_by(ROW, F.struct("none", F.col(f"{ROW}.`{self.id_col}`"))).alias(ROW))
            out = out.unionByName(unpacked(first))
        return out


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest=sha256_hex) -> DataFrame:
    return MergeIndex(docs, id_col, text_col, digest).members()
