"""Near-duplicate groups by one-permutation MinHash with optimal densification and exact confirmation.

A document's set holds the 64-bit hashes of its distinct shingles. One permutation deals the set into BINS bins, whose
least hashes are the signature; every empty bin borrows from the non-empty bin that comes first in a random order of its
own (optimal densification), so signatures of short texts keep independent bins. BANDS bands of ROWS bins are the
buckets: a pair of similarity 0.8 misses all of them with probability (1 - 0.8 ** 6) ** 40, 5e-6.

Documents of equal sets are one class from the start. Buckets propose edges in the shape of stars: their first member
against the others; an edge is a link only if the full sets confirm it. Where a bucket still holds several components,
a few members of its largest one are tried against the members outside it, and if that leaves several components, all
outsiders meet the members of other components, in blocks of bounded size: a pair whose sizes, signatures or short hashes are
too far apart for the similarity asked is refuted there, the others are confirmed or refuted on the full sets. So
every pair that shares a bucket is confirmed, refuted or already connected, while a bucket of one group costs as many
edges as it has members.
Components come from alternating large-star and small-star steps over written tables; nothing goes to the driver but
counts.

Defined results. Null or empty texts and texts without words have n_shingles 0 and are linked with nothing; their
component_id is their own identifier. Identifiers are compared with nulls last, one that is no number counts as null; a
component with null identifiers only has a null component_id. Repeated rows are in one class; `keep_one` leaves one of them. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sheaf.llm.common import ROW, KeyFilter, packed, remembers, spread_join, tidy, unpacked, written

BANDS, ROWS = 40, 6
BINS = BANDS * ROWS
#: Similarity in percent from which documents are linked, and words of a shingle.
PERCENT = 80
WORDS = 5
#: Members of a bucket's largest component that are tried against its other members after the first stars.
HUBS = 4
#: Members of a bucket in one block; by how many standard deviations of independent bins a signature may fall short of a similarity
#: (densified ones vary by a quarter more), and shingles of a set below which its signature decides nothing.
BLOCK, DEVIATIONS, SMALL = 256, 8.0, 64

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


class _WordHashes(dict):
    """Hashes of words, kept for as many words as fit a fixed bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 150_000:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


_hashes = _WordHashes()
remembers("near_dedup", _hashes.clear)


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles; fewer words than a shingle's make one shingle of all of them."""
    found = (text or "").encode().lower().split()
    if not found:
        return np.empty(0, np.uint64)
    h = np.array([_hashes[w] for w in found], np.uint64)
    size = min(words, len(found))
    acc = np.full(len(h) - size + 1, size, np.uint64)
    for k in range(size):
        acc = _mix(acc * _A + h[k : len(h) - size + 1 + k])
    return np.unique(acc)


@lru_cache(maxsize=1)
def _orders() -> np.ndarray:
    """For each bin, the rank of every other bin in its own random order; fixed seed."""
    return np.random.default_rng(20).permuted(np.tile(np.arange(BINS, dtype=np.int16), (BINS, 1)), axis=1)


@lru_cache(maxsize=1)
def _edges() -> np.ndarray:
    return np.array([(i << 64) // BINS for i in range(1, BINS)], np.uint64)


def signature(found: np.ndarray) -> np.ndarray:
    """The densified one-permutation signature of a non-empty set."""
    bounds = np.concatenate([[0], np.searchsorted(found, _edges()), [len(found)]])
    full = bounds[1:] > bounds[:-1]
    out = np.zeros(BINS, np.uint64)
    out[full] = found[bounds[:-1][full]]
    if not full.all():
        donors = np.flatnonzero(full)
        out[~full] = out[donors[_orders()[~full][:, donors].argmin(axis=1)]]
    return out


def bands(found: np.ndarray) -> np.ndarray:
    """One 64-bit bucket key per band."""
    rows = signature(found).reshape(BANDS, ROWS)
    acc = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        acc = _mix(acc * _A + rows[:, k])
    return acc.view(np.int64)


def class_of(found: np.ndarray) -> bytes:
    return hashlib.blake2b(found.tobytes(), digest_size=16).digest()


def _sketch(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, cls, keys = [], [], []
            for text in batch.column(1):
                found = shingle_set(text.as_py(), words)
                n.append(len(found))
                cls.append(class_of(found) if len(found) else None)
                keys.append(bands(found) if len(found) else np.empty(0, np.int64))
            columns = [batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(cls, pa.binary()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "th", "n", "cls", "bands"])

    return run


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingle_set(text.as_py(), words) for text in batch.column(0)]
            columns = [pa.array([class_of(x) for x in found], pa.binary()), pa.array([x.tobytes() for x in found], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["cls", "hashes"])

    return run


def _short_signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sixteen bits of every bin of the signature, thirty-two bits of every hash of the set, and the bucket keys."""
    for batch in batches:
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column("hashes")]
        keys = pa.array([bands(x).tobytes() for x in sets], pa.binary())
        short = pa.array([(signature(x) & np.uint64(0xFFFF)).astype(np.uint16).tobytes() for x in sets], pa.binary())
        low = pa.array([np.unique((x & np.uint64(0xFFFFFFFF)).astype(np.uint32)).tobytes() for x in sets], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("cls"), short, low, keys], names=["cls", "short", "low", "keys"])


def _near(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether sets of 32-bit hashes leave a similarity of `percent` possible, with room for hashes that fall together."""
    total = len(x) + len(y)
    both = len(np.intersect1d(x, y, assume_unique=True)) + 2 + 4 * total * total // (1 << 32)
    return 100 * both >= percent * (total - both)


def _compare(percent: int):
    """Pairs of one block: a probe and a member of another component that share no earlier bucket, are of fitting sizes, whose
    signatures, if the sets are not small, agree in nearly as many bins as `percent` asks for, and whose sets of short hashes do too."""
    least = percent / 100 - DEVIATIONS * (percent / 100 * (1 - percent / 100) / BINS) ** 0.5

    def run(table: pa.Table) -> pa.Table:
        probe = np.array(table["probe"].to_pylist())
        cls, comp, n = (np.array(table[c].to_pylist(), object if c != "n" else np.int64) for c in ("cls", "comp", "n"))
        outside = np.array(table["outside"].to_pylist())
        short = np.frombuffer(b"".join(table["short"].to_pylist()), np.uint16).reshape(-1, BINS)
        keys = np.frombuffer(b"".join(table["keys"].to_pylist()), np.int64).reshape(-1, BANDS)
        band = table["band"][0].as_py() if len(cls) else 0
        low = [np.frombuffer(x.as_buffer(), np.uint32) for x in table["low"]]
        members = np.flatnonzero(~probe)
        a, b = [], []
        for i in np.flatnonzero(probe) if len(members) else ():
            fits = 100 * np.minimum(n[i], n[members]) >= percent * np.maximum(n[i], n[members])
            near = (n[members] < SMALL) | (n[i] < SMALL) | ((short[members] == short[i]).sum(1) >= least * BINS)
            hits = members[fits & near & (comp[members] != comp[i])]
            for m in hits[(keys[hits] == keys[i]).argmax(1) == band]:
                if (not outside[m] or cls[i] < cls[m]) and _near(low[i], low[m], percent):
                    a.append(min(cls[i], cls[m]))
                    b.append(max(cls[i], cls[m]))
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    return run


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("hashes_a"), batch.column("hashes_b"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def connected(links: DataFrame) -> DataFrame:
    """(node, root) of every node that isn't its component's least; links: a, b."""
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    last = None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == last:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        last = state
        ways = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = ways.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = spread_join(ways.filter("v > u"), least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = written(large.distinct(), "links")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = spread_join(large, least, "u").filter("v <> m")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = written(small.unionByName(least.withColumnRenamed("m", "v")).distinct(), "links")


class NearDuplicates:
    """Classes, links and components of the texts of `docs`."""

    def __init__(self, docs: DataFrame, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text"):
        self.words, self.percent, self.id_col, self.text_col = words, percent, id_col, text_col
        self.rows = packed(docs)
        self.ids = F.col(f"{ROW}.`{id_col}`").try_cast("long")
        self.texts = F.col(f"{ROW}.`{text_col}`")
        schema = "id long, th long, n long, cls binary, bands array<long>"
        rows = self.rows.select(self.ids.alias("id"), self.texts.alias("text"), F.xxhash64(self.texts).alias("th"))
        self.sketches = written(rows.mapInArrow(tidy("near_dedup", _sketch(words)), schema), "near-sketches")
        grouped = self.sketches.filter("cls is not null").groupBy("cls")
        self.classes = written(grouped.agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands")), "near-classes")
        self._link()

    def _size_fits(self, x: str, y: str):
        return F.least(x, y) * 100 >= F.greatest(x, y) * self.percent

    def _gather_sets(self) -> None:
        """The full sets of all classes that share a bucket, from the texts of their representatives."""
        wanted = self.classes.join(self.members.select("cls").distinct(), "cls", "left_semi").select("cls", "rep")
        wanted = written(wanted, "near-wanted")
        rows = self.rows.select(self.ids.alias("rep"), self.texts.alias("text"))
        rows = KeyFilter(wanted, "rep").probe(rows, "rep").filter("__hit").select("text")
        found = rows.mapInArrow(tidy("near_dedup", _sets(self.words)), "cls binary, hashes binary")
        self.sets = written(found.join(wanted.select("cls"), "cls", "left_semi").dropDuplicates(["cls"]), "near-sets")

    def _confirmed(self, pairs: DataFrame) -> DataFrame:
        ends = pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls")))
        sets = KeyFilter(ends, "cls").probe(self.sets, "cls").filter("__hit").select("cls", "hashes")
        both = pairs.join(sets.select(F.col("cls").alias("b"), F.col("hashes").alias("hashes_b")), "b")
        both = both.join(sets.select(F.col("cls").alias("a"), F.col("hashes").alias("hashes_a")), "a")
        return both.mapInArrow(tidy("near_dedup", _confirm(self.percent)), "a binary, b binary")

    def _link(self) -> None:
        buckets = self.classes.select("cls", "n", F.posexplode("bands").alias("band", "key"))
        shared = buckets.groupBy("key").count().filter("count > 1").select("key")
        self.members = written(buckets.join(shared, "key"), "near-members")
        self._gather_sets()
        stars = self.members.groupBy("key").agg(F.min(F.struct("cls", "n")).alias("hub"))
        pairs = spread_join(self.members, stars, "key").filter(F.col("cls") != F.col("hub.cls"))
        pairs = pairs.filter(self._size_fits("n", "hub.n")).select(F.col("hub.cls").alias("a"), F.col("cls").alias("b"))
        tested = written(pairs.distinct(), "near-pairs")
        self.roots = connected(self._confirmed(tested))
        for propose in (self._more_stars, self._blocks):
            rows = self._open()
            if rows.isEmpty():
                return
            pairs = written(propose(rows).distinct().join(tested, ["a", "b"], "left_anti"), "near-pairs")
            more = written(self._confirmed(pairs), "near-links")
            if not more.isEmpty():
                known = self.roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
                self.roots = connected(known.unionByName(more))
            tested = tested.unionByName(pairs)

    def _open(self) -> DataFrame:
        """Members of buckets that still hold several components, with their component, whether that is not the bucket's
        largest (an outsider), and the bucket's numbers of members and of outsiders."""
        rows = self.members.join(self.roots.withColumnRenamed("node", "cls"), "cls", "left")
        rows = rows.select("key", "band", "cls", "n", F.coalesce("root", "cls").alias("comp"))
        sizes = rows.groupBy("key", "comp").agg(F.count("*").alias("c")).groupBy("key")
        sizes = sizes.agg(F.max(F.struct("c", "comp")).alias("top"), F.sum("c").alias("size")).filter("top.c < size")
        rows = spread_join(rows, sizes, "key").withColumn("outside", F.col("comp") != F.col("top.comp"))
        rows = rows.withColumn("outsiders", F.col("size") - F.col("top.c")).drop("top")
        return written(rows, "near-open")

    def _more_stars(self, rows: DataFrame) -> DataFrame:
        """Pairs of a few members of each bucket's largest component with its outsiders."""
        order = Window.partitionBy("key").orderBy("cls")
        hubs = rows.filter("not outside").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= HUBS)
        hubs = hubs.select("key", F.col("cls").alias("hub"), F.col("n").alias("hub_n"))
        pairs = rows.filter("outside").join(hubs, "key").filter(self._size_fits("n", "hub_n"))
        return pairs.select(F.least("cls", "hub").alias("a"), F.greatest("cls", "hub").alias("b"))

    def _blocks(self, rows: DataFrame) -> DataFrame:
        """Pairs of outsiders with members of other components whose signatures leave a similarity of `percent` possible.

        Buckets are cut into blocks of about BLOCK members and compared block by block, so that no task holds a bucket.
        """
        short = self.sets.mapInArrow(tidy("near_dedup", _short_signatures), "cls binary, short binary, low binary, keys binary")
        rows = rows.join(short, "cls")
        across, down = (F.ceil(F.col(c) / F.lit(BLOCK)).cast("long") for c in ("size", "outsiders"))
        spread = F.pmod(F.xxhash64("cls"), F.lit(1 << 30))
        first = F.lit(0).cast("long")
        named = ["band", "cls", "n", "comp", "outside", "short", "low", "keys"]
        left = rows.filter("outside").select(
            "key", F.pmod(spread, down).alias("i"), F.explode(F.sequence(first, across - 1)).alias("j"), F.lit(True).alias("probe"), *named
        )
        right = rows.select(
            "key", F.explode(F.sequence(first, down - 1)).alias("i"), F.pmod(spread, across).alias("j"), F.lit(False).alias("probe"), *named
        )
        cells = left.unionByName(right)
        return cells.groupBy("key", "i", "j").applyInArrow(_compare(self.percent), "a binary, b binary")

    def components(self) -> DataFrame:
        """(cls, comp) of every class."""
        named = self.classes.select("cls").join(self.roots.withColumnRenamed("node", "cls"), "cls", "left")
        return named.select("cls", F.coalesce("root", "cls").alias("comp"))

    def groups(self) -> DataFrame:
        """(cls, component_id) of every class: the least identifier of its component."""
        named = self.components().join(self.classes.select("cls", "rep"), "cls")
        return spread_join(named.select("cls", "comp"), named.groupBy("comp").agg(F.min("rep").alias("component_id")), "comp").drop("comp")

    def members_of(self) -> DataFrame:
        """Per input row: id, n_shingles, component_id, kept."""
        out = self.sketches.drop("bands").join(self.groups(), "cls", "left")
        component = F.when(F.col("cls").isNull(), F.col("id")).otherwise(F.col("component_id"))
        return out.select("id", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn(
            "kept", F.coalesce(F.col("id") == F.col("component_id"), F.col("component_id").isNull())
        )

    def first_rows(self) -> DataFrame:
        """The input rows, with all their columns, of which one of each component stays: the one with the smallest identifier,
        nulls last, of several the one with the smallest hash of its text, and of rows that agree in both any one."""
        place = F.struct(F.col("id").isNull().alias("none"), "id", "th")
        rows = self.sketches.filter("cls is not null").groupBy("cls", "id", "th").agg(F.count("*").alias("rows")).join(self.components(), "cls")
        best = rows.groupBy("comp").agg(F.min(place).alias("best"))
        marked = spread_join(rows, best, "comp").select("id", "th", (place != F.col("best")).alias("gone"), "rows").filter("gone or rows > 1")
        marked = written(marked.select("id", "th", "gone", F.xxhash64("id", "th").alias("row")), "near-marked")
        docs = self.rows.withColumn("id", self.ids).withColumn("th", F.xxhash64(self.texts)).withColumn("row", F.xxhash64("id", "th"))
        docs = KeyFilter(marked, "row", "near-filter").probe(docs, "row")
        other = marked.select("row", F.col("id").alias("own"), F.col("th").alias("own_th"), "gone")
        same = (F.col("id").eqNullSafe(F.col("own"))) & (F.col("th") == F.col("own_th"))
        hit = docs.filter("__hit").join(other.withColumnRenamed("row", "own_row"), (F.col("row") == F.col("own_row")) & same, "left")
        alone = hit.filter("gone is null")
        repeated = hit.filter("not gone").dropDuplicates(["id", "th"])
        return unpacked(docs.filter("not __hit").select(ROW).unionByName(alone.select(ROW)).unionByName(repeated.select(ROW)))


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    return NearDuplicates(docs, words, percent).members_of()


def keep_one(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row of each component, and all rows that are in none."""
    return NearDuplicates(docs, words, percent).first_rows()
