"""What the operators of this subpackage share: row packing, a membership filter of bounded size, and a join that deals out hot keys."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.scratch import remove, scratch_root, written

__all__ = ["ROW", "SPACE", "KeyFilter", "packed", "remove", "scratch_root", "spread_join", "tidy", "unpacked", "written"]

#: White space of the contracts, as a Java regular expression.
SPACE = r"[\x20\x09-\x0D]+"
#: Column that holds a whole input row while an operator adds columns of its own, so that names never clash.
ROW = "__row"


def packed(docs: DataFrame) -> DataFrame:
    """The input with one more column, ROW, that holds all input columns; the others are dropped but stay reachable through it."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(ROW))


def unpacked(df: DataFrame) -> DataFrame:
    return df.select(f"{ROW}.*")


#: By operator, how to empty what its Python workers remember between tasks.
_caches: dict[str, Callable[[], None]] = {}


def remembers(owner: str, clear: Callable[[], None]) -> None:
    _caches[owner] = clear


def _forget_others(owner: str) -> None:
    """Workers go on to other operators' tasks, which have no use for what earlier ones have remembered."""
    for name, clear in _caches.items():
        if name != owner:
            clear()


def _give_back() -> None:
    """Return free memory to the system; a worker that waits for its next task is counted with what it holds."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # other C libraries than glibc have none
    if trim is not None:
        trim(0)


def tidy(owner: str, run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function of Arrow batches that holds no memory for other operators before its task, and no free memory after it."""

    def tidied(batches: Iterator) -> Iterator:
        _forget_others(owner)
        try:
            yield from run(batches)
        finally:
            _give_back()

    return tidied


#: Bits of one bitmap of the membership filter, bitmaps of the smallest and of the largest one (1 MB and 16 MB), and bits that a
#: key should have. A filter never grows beyond the largest: more keys than fit let more rows pass, and the join behind it decides.
FILTER_WIDTH, FEWEST, MOST, BITS_A_KEY = 32768, 256, 4096, 16


class KeyFilter:
    """A one-hash membership filter over a column of keys: at most MOST rows of 4 KB, so it may always be broadcast."""

    def __init__(self, keys: DataFrame, key: str, label: str = "key-filter"):
        self.buckets = FEWEST
        wanted = keys.count() * BITS_A_KEY // FILTER_WIDTH
        while self.buckets < min(wanted, MOST):
            self.buckets *= 2
        bit = self._bit(F.col(key))
        bitmaps = (
            keys.select(bit.alias("bit"))
            .groupBy(F.expr(f"cast(bit div {FILTER_WIDTH} as int)").alias("__fb"))
            .agg(F.bitmap_construct_agg(F.pmod("bit", F.lit(FILTER_WIDTH))).alias("__bits"))
        )
        self.bitmaps = written(bitmaps, label)

    def _bit(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets * FILTER_WIDTH))

    def probe(self, df: DataFrame, key: str) -> DataFrame:
        """df with a boolean __hit: false where the filter proves that the key isn't among its keys."""
        out = df.withColumn("__at", self._bit(F.col(key))).withColumn("__fb", F.expr(f"cast(__at div {FILTER_WIDTH} as int)"))
        out = out.join(F.broadcast(self.bitmaps), "__fb", "left")
        byte = F.conv(F.hex(F.expr(f"substring(__bits, cast((__at % {FILTER_WIDTH}) div 8 as int) + 1, 1)")), 16, 10).cast("int")
        hit = F.coalesce(byte.bitwiseAND(F.expr("cast(shiftleft(1, cast(__at % 8 as int)) as int)")) != 0, F.lit(False))
        return out.withColumn("__hit", hit).drop("__at", "__fb", "__bits")


#: Shares into which a key's rows are dealt by `spread_join`.
SHARES = 8


def spread_join(many: DataFrame, few: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """A join in which the rows of `many` with one key are dealt to SHARES tasks, and `few`, with one row a key, goes to all of them."""
    dealt = many.withColumn("__share", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in many.columns]), F.lit(SHARES)).cast("int"))
    copies = few.withColumn("__share", F.explode(F.array(*[F.lit(i) for i in range(SHARES)])))
    return dealt.join(copies, [key, "__share"], how).drop("__share")
