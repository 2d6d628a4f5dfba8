"""Class-based n-gram language model: exchange clustering of all training words into classes, and scores of whole texts.

Classes. The HOT_UNITS most frequent words are clustered first, by exchange on their own bigrams. All further words of the
lexicon, the HOT_WORDS most frequent ones, then join the class that raises the likelihood of the class bigrams most, given
how often they stand before and after words of each class; EXCHANGES more passes move the lexicon's words again, all at
once, by the classes that all of them have by then. Last, every other training word joins a class in the same way by the
lexicon's words around it, in a distributed table that grows with the corpus; those with neighbours beyond the lexicon are then
exchanged once more, all at once, by all their neighbours and the classes that these have by then. So each word that training has
seen has a class by exchange and an emission probability of its own:

    p(word | before) = p(class | class before) * p(word | class)

Class transitions are interpolated with class frequencies. Emissions are discounted by the share of words that occur once;
what they leave is the class's share of words that were never seen, and a word that no training text holds is one event whose
probability is the sum of these shares over all classes. After such a word classes come by their frequencies.

Scale. Texts are split into words twice: to count the training texts' words, and to number all texts' words. The numbers are
kept as a table, and all passes of clustering and scoring read them alone. What goes to the driver is bounded by parameters: up to HOT_WORDS
words with counts and classes, bigrams of HOT_UNITS + 2 units, and tables of classes. Words beyond the lexicon are too rare to be
hot keys of a join. The transitions' counts hold every two neighbouring words of training, also those that are both beyond the
lexicon: these are a table of links between words, which both ends' classes are joined to.

Defined results. Null and empty texts are the end token alone. Rows with null identifier are scored like others, an identifier
that is no number becomes null; repeated rows give equal rows. Without training texts the vocabulary is empty, every word is
unseen and every score 0. An empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.llm.common import written

HOT_WORDS, HOT_UNITS, CLASSES = 131_072, 767, 64
#: Passes of exchange clustering over the units, passes over the whole lexicon after its words have joined a class, and weight
#: of class frequencies in a class's transitions.
PASSES, EXCHANGES, BACKOFF = 8, 1, 5.0
#: The end of a text among the words; no word holds white space.
END = b"\n"
#: Distinct words that a counting task holds before it passes them on, and contexts that it sorts at once.
COUNTER_WORDS, CONTEXTS = 300_000, 4_000_000
#: Words of the lexicon in one group of a pass, and rows worked off at once.
BLOCK, SLICE = 128, 512
#: Buckets by which words of equal frequency are told apart.
BUCKETS = 4096
#: Class of a word that a text holds but the lexicon doesn't, until it is looked up.
RARE = 255


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: Counter = Counter()

    def flush():
        columns = [pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())]
        found.clear()
        return pa.RecordBatch.from_arrays(columns, names=["word", "c"])

    for batch in batches:
        for text in batch.column(0):
            found.update(words_of(text.as_py()))
            found[END] += 1
        if len(found) > COUNTER_WORDS:
            yield flush()
    yield flush()


def vocabulary(texts: DataFrame) -> DataFrame:
    """(word, c): the counts of all tokens of a column of texts."""
    counted = texts.mapInArrow(_count, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))
    return written(counted, "lm-vocabulary")


def _upto(histogram: dict[int, int], most: int) -> tuple[list[int], int]:
    """The keys, in rising order, whose numbers add up to at most `most`, and what is left of it."""
    taken = []
    for key in sorted(histogram):
        if histogram[key] > most:
            break
        taken.append(key)
        most -= histogram[key]
    return taken, most


def frequent_words(vocab: DataFrame, most: int) -> tuple[list[bytes], list[int]]:
    """The end, then at most `most` words in falling order of their counts; of about equally frequent words at the limit a
    hash decides. Two histograms name them, so that no task has to merge what all others hold."""
    words = vocab.filter(F.col("word") != F.lit(END))
    scale = -F.floor(F.log2("c") * 16)
    histogram = dict(words.groupBy(scale).agg(F.count("*")).collect())
    whole, left = _upto(histogram, most)
    wanted = scale <= F.lit(whole[-1] if whole else -(1 << 20))
    rest = sorted(set(histogram) - set(whole))
    if rest and left:
        bucket = F.pmod(F.xxhash64("word"), F.lit(BUCKETS))
        some, _ = _upto(dict(words.filter(scale == rest[0]).groupBy(bucket).agg(F.count("*")).collect()), left)
        if some:
            wanted = wanted | ((scale == rest[0]) & (bucket <= some[-1]))
    top = words.filter(wanted).toPandas()
    rows = sorted(zip(top["c"].tolist(), map(bytes, top["word"]), strict=True), key=lambda r: (-r[0], r[1]))
    ends = vocab.filter(F.col("word") == F.lit(END)).first()
    return [END] + [w for _, w in rows], [ends.c if ends else 0] + [c for c, _ in rows]


class Lexicon:
    """The end and the frequent words, by number."""

    def __init__(self, words: list[bytes], counts: list[int]):
        self.words, self.counts = words, np.array(counts, np.int64)
        self._index: _Index | None = None

    @property
    def index(self) -> _Index:
        if self._index is None:
            self._index = _Index((w, i) for i, w in enumerate(self.words))
        return self._index

    def __getstate__(self):
        return self.__dict__ | {"_index": None}


class _Index(dict):
    def __missing__(self, word: bytes) -> int:
        return -1


def _numbers(index: _Index, words: list[bytes]) -> np.ndarray:
    """The words' numbers in the lexicon, -1 for others, and the end's."""
    return np.array([*map(index.__getitem__, words), 0], np.int32)


def _number(lexicon):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = lexicon.value.index
        for batch in batches:
            for i in range(0, batch.num_rows, SLICE):
                numbers, rare = [], []
                for text in batch.column(0).slice(i, SLICE):
                    words = words_of(text.as_py())
                    own = _numbers(index, words)
                    numbers.append(own.tobytes())
                    rare.append([words[j] for j in np.flatnonzero(own < 0)])
                columns = [pa.array(numbers, pa.binary()), pa.array(rare, pa.list_(pa.binary())), *batch.slice(i, SLICE).columns[1:]]
                yield pa.RecordBatch.from_arrays(columns, names=["numbers", "rare", *batch.schema.names[1:]])

    return run


def numbered(texts: DataFrame, lexicon) -> DataFrame:
    """Each text as the numbers of its words, four bytes each, with the words that have none, in order; other columns stay."""
    schema = ", ".join(["numbers binary, rare array<binary>", *(f"{name} {kind}" for name, kind in texts.dtypes[1:])])
    return written(texts.mapInArrow(_number(lexicon), schema), "lm-numbers", {"compression": "zstd"})


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, pa.RecordBatch]]:
    """The numbers of many texts in one row, an end before the first one."""
    for batch in batches:
        for i in range(0, batch.num_rows, SLICE):
            part = batch.slice(i, SLICE)
            rows = [np.frombuffer(x.as_buffer(), np.int32) for x in part.column(0)]
            yield np.concatenate([np.zeros(1, np.int32), *rows]), part


def _bigrams(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n * n, np.int64)
        for numbers, _ in _joined(batches):
            s = np.where((numbers < 0) | (numbers >= n - 1), n - 1, numbers).astype(np.int64)
            total += np.bincount(s[:-1] * n + s[1:], minlength=n * n)
        cells = np.flatnonzero(total)
        for i in range(0, max(len(cells), 1), 100_000):
            part = cells[i : i + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(total[part], pa.int64())], names=["cell", "n"])

    return run


def _square(found: pd.DataFrame, n: int) -> np.ndarray:
    out = np.zeros(n * n, np.int64)
    out[found["cell"].to_numpy()] = found["n"].to_numpy()
    return out.reshape(n, n)


def bigrams(texts: DataFrame, units: int) -> np.ndarray:
    """Counts of neighbouring units in numbered texts: the first `units` numbers, and one more for all other words."""
    found = texts.select("numbers").mapInArrow(_bigrams(units + 1), "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    return _square(found.toPandas(), units + 1)


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def exchange(counts: np.ndarray, classes: int, passes: int) -> np.ndarray:
    """Classes of units by exchange clustering. Unit 0, the end, keeps class 0, and the last unit, which stands for all words
    that have none, keeps class `classes`."""
    units = len(counts)
    weight = counts.sum(1) + counts.sum(0)
    own = np.zeros(units, np.int64)
    own[-1] = classes
    ranked = [u for u in np.argsort(-weight, kind="stable") if 0 < u < units - 1]
    for rank, u in enumerate(ranked):
        own[u] = 1 + rank % (classes - 1)
    member = np.zeros((units, classes + 1))
    member[np.arange(units), own] = 1
    after, before = counts @ member, counts.T @ member  # of each unit: counts by the class of its neighbour
    table = member.T @ after
    left, right = table.sum(1), table.sum(0)
    for _ in range(passes):
        moved = 0
        for u in ranked:
            if not weight[u]:
                continue
            a, d = own[u], counts[u, u]
            row, col = after[u].copy(), before[u].copy()
            row[a] -= d
            col[a] -= d
            t = table.copy()
            t[a] -= row
            t[:, a] -= col
            t[a, a] -= d
            out_of, into = counts[u].sum(), counts[:, u].sum()
            l, r = left.copy(), right.copy()
            l[a] -= out_of
            r[a] -= into
            f = _xlogx(t)
            gain = (_xlogx(t + row) - f).sum(1) + (_xlogx(t + col[:, None]) - f).sum(0)
            at = np.diagonal(t)
            gain += _xlogx(at + row + col + d) - _xlogx(at + row) - _xlogx(at + col) + _xlogx(at)
            gain -= _xlogx(l + out_of) - _xlogx(l) + _xlogx(r + into) - _xlogx(r)
            gain[0] = gain[-1] = -np.inf
            b = int(gain.argmax())
            if b == a or gain[b] <= gain[a] + 1e-9:
                continue
            moved += 1
            t[b] += row
            t[:, b] += col
            t[b, b] += d
            l[b] += out_of
            r[b] += into
            table, left, right, own[u] = t, l, r, b
            after[:, a] -= counts[:, u]
            after[:, b] += counts[:, u]
            before[:, a] -= counts[u]
            before[:, b] += counts[u]
        if not moved:
            break
    return own


def _contexts(shared, words: bool = True):
    """Per task: counts of class bigrams (id -1), and, with words, of the classes before and after each word of the lexicon."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, n = shared.value  # a class for every number, and for -1, which names the last place
        table, held, size = np.zeros(n * n, np.int64), [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held, size
            cells, counts = np.unique(np.concatenate(held), return_counts=True) if held else (np.empty(0, np.int32),) * 2
            held, size = [], 0
            for i in range(0, len(cells), 200_000):
                part = cells[i : i + 200_000]
                columns = [part // (2 * n), part % (2 * n), counts[i : i + 200_000]]
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32)) for c in columns], names=["id", "cell", "n"])

        for numbers, _ in _joined(batches):
            c = own[numbers]
            table += np.bincount(c[:-1] * n + c[1:], minlength=n * n)
            at = np.flatnonzero(numbers > 0) if words else np.empty(0, np.int64)
            held += [numbers[at] * (2 * n) + c[at - 1], numbers[at] * (2 * n) + n + c[at + 1]]
            size += 2 * len(at)
            if size > CONTEXTS:
                yield from flush()
        yield from flush()
        while len(cells := np.flatnonzero(table)):  # one row holds 31 bits of a count
            columns = [np.full(len(cells), -1), cells, np.minimum(table[cells], 1 << 30)]
            yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int32)) for x in columns], names=["id", "cell", "n"])
            table[cells] -= columns[2]

    return run


def gains(table: np.ndarray, cell: np.ndarray, n: np.ndarray, starts: np.ndarray, own: np.ndarray | None = None) -> np.ndarray:
    """What the likelihood of the class bigrams gains if a word joins each of the classes; a row per word.

    cell: a class before the word, or len(table) plus a class after it, with n occurrences; the cells of word i begin at
    starts[i]. own: the classes that the words leave, of whose counts they are a part. Where a word stands next to the class that it
    joins or leaves, its occurrences before and after that class are taken one by one.
    """
    classes = len(table) - 1
    base = np.concatenate([table[:, :classes], table[:classes].T]).astype(np.float64)
    before, after = table.sum(0)[:classes].astype(np.float64), table.sum(1)[:classes].astype(np.float64)
    word = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(cell))))
    n, alone = n.astype(np.float64), _xlogx(base)
    plus = (_xlogx(base + 1) - alone)[cell]  # most cells hold one occurrence
    more = np.flatnonzero(n != 1)
    plus[more] = _xlogx(base[cell[more]] + n[more, None]) - alone[cell[more]]
    totals = [np.add.reduceat(np.where(side, n, 0.0), starts) for side in (cell <= classes, cell > classes)]
    if own is not None:
        rows, o = np.arange(len(cell)), own[word]
        mine = base[cell, o]
        plus[rows, o] = _xlogx(mine) - _xlogx(mine - n)
    out = np.add.reduceat(plus, starts, axis=0)
    for sums, total in ((before, totals[0]), (after, totals[1])):
        less = _xlogx(sums + total[:, None]) - _xlogx(sums)
        if own is not None:
            less[np.arange(len(own)), own] = _xlogx(sums[own]) - _xlogx(sums[own] - total)
        out -= less
    out[:, 0] = -np.inf
    return out


def _moved(shared):
    """The classes that a block of the lexicon's words join."""

    def run(group: pa.Table) -> pa.Table:
        table, own = shared.value
        group = group.sort_by([("id", "ascending"), ("cell", "ascending")])
        ids, starts = np.unique(group["id"].to_numpy(), return_index=True)
        here = None if own is None else own[ids]
        gain = gains(table, group["cell"].to_numpy(), group["n"].to_numpy(), starts, here)
        best = gain.argmax(1)
        if here is not None:
            rows = np.arange(len(ids))
            best = np.where(gain[rows, best] > gain[rows, here] + 1e-9, best, here)
        return pa.table({"id": pa.array(ids, pa.int32()), "class": pa.array(best, pa.int32())})

    return run


def cluster(texts: DataFrame, lexicon: Lexicon, hot_units: int, classes: int, passes: int = PASSES, exchanges: int = EXCHANGES) -> np.ndarray:
    """Classes of the lexicon's words, and one more for all others, from numbered texts."""
    context, size, n = texts.sparkSession.sparkContext, len(lexicon.words), classes + 1
    hot = min(hot_units + 1, size)
    own = np.full(size + 1, classes, np.int64)
    own[:hot] = exchange(bigrams(texts, hot), classes, passes)[:hot]
    for step in range(exchanges + 1):
        found = texts.select("numbers").mapInArrow(_contexts(context.broadcast((own, n))), "id int, cell int, n int")
        found = written(found.groupBy("id", "cell").agg(F.sum("n").alias("n")), "lm-contexts")
        table = _square(found.filter("id < 0").select("cell", "n").toPandas(), n)
        words = found.filter(f"id >= {hot if not step else 1}").withColumn("block", F.expr(f"id div {BLOCK}"))
        shared = context.broadcast((table, own if step else None))
        for i, c in words.groupBy("block").applyInArrow(_moved(shared), "id int, class int").collect():  # at most HOT_WORDS rows
            own[i] = c
    return own


def _surroundings(shared):
    """Rare words with the classes before and after them, in one number, and the word after them if it is rare, too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, n = shared.value
        for numbers, part in _joined(batches):
            at, c, words = np.flatnonzero(numbers < 0), own[numbers], part.column(1).flatten()
            around = pa.array((c[at - 1] * n + c[at + 1]).astype(np.int32))
            after = words.take(pa.array(np.arange(1, len(at) + 1), mask=numbers[at + 1] >= 0))
            yield pa.RecordBatch.from_arrays([words, around, after], names=["word", "around", "next"])

    return run


def _merged(word: np.ndarray, cell: np.ndarray, n: np.ndarray, words: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cells of words, each cell of a word once, with their counts and each word's first place; a word without any has one of count 0."""
    keys = np.concatenate([word[n > 0] * (2 * size) + cell[n > 0], np.arange(words) * (2 * size)])
    keys, at = np.unique(keys, return_inverse=True)
    counts = np.bincount(at, np.concatenate([n[n > 0], np.zeros(words, np.int64)]), len(keys))
    return keys % (2 * size), counts, np.searchsorted(keys, np.arange(words) * (2 * size))


def _lists(column: pa.ListArray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The values of lists, each one's list, and each list's length."""
    sizes = np.diff(column.offsets.to_numpy())
    return column.flatten(), np.repeat(np.arange(len(sizes)), sizes), sizes


def _sides(word: np.ndarray, around: np.ndarray, m: np.ndarray, n: int) -> list[np.ndarray]:
    """Words, cells and counts of the lexicon's words around; a rare word counts 0 here."""
    before, after = around // n, around % n
    m = m.astype(np.int64)
    return [np.append(word, word), np.append(before, n + after), np.append(np.where(before < n - 1, m, 0), np.where(after < n - 1, m, 0))]


RARE_WORDS = "word binary, id long, c long, class int, paired boolean, around array<struct<around:int,next:binary,n:bigint>>"


def _join_classes(shared):
    """Words beyond the lexicon with the class that they join by the lexicon's words around them; words with none around them start
    in the largest. Paired words have neighbours beyond the lexicon, `_exchange_classes` takes them on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        table, row = shared.value, TaskContext.get().partitionId() << 40
        n = len(table)
        largest = 1 + int(table.sum(0)[1 : n - 1].argmax()) if n > 2 else 1
        for batch in batches:
            for i in range(0, batch.num_rows, SLICE):
                part = batch.slice(i, SLICE)
                flat, word, sizes = _lists(part.column(1))
                around, m = flat.field("around").to_numpy(), flat.field("n").to_numpy()
                total = np.bincount(word, m, len(sizes)).astype(np.int64)
                paired = np.bincount(word, (around // n == n - 1) | (around % n == n - 1), len(sizes)) > 0
                cell, count, starts = _merged(*_sides(word, around, m, n), len(sizes), n)
                best = gains(table, cell, count, starts).argmax(1)
                best = np.where(np.add.reduceat(count, starts) > 0, best, largest)
                ids = np.arange(row, row + len(sizes))
                row += len(sizes)
                columns = [part.column(0), pa.array(ids), pa.array(total), pa.array(best, pa.int32()), pa.array(paired), part.column(1)]
                yield pa.RecordBatch.from_arrays(columns, names=["word", "id", "c", "class", "paired", "around"])

    return run


def _exchange_classes(shared):
    """Paired words with the class that they join by all words around them, given the classes that all words have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        n = len(table)
        for batch in batches:
            for i in range(0, batch.num_rows, SLICE):
                part = batch.slice(i, SLICE)
                around, word, sizes = _lists(part.column("around"))
                near, close, _ = _lists(part.column("near"))
                sides = _sides(word, around.field("around").to_numpy(), around.field("n").to_numpy(), n)
                links = close, near.field("cell").to_numpy(), near.field("n").to_numpy()
                cell, count, starts = _merged(*map(np.append, sides, links), len(sizes), n)
                own, rows = part.column("class").to_numpy().astype(np.int64), np.arange(len(sizes))
                gain = gains(table, cell, count, starts, own)
                best = gain.argmax(1)
                best = np.where(gain[rows, best] > gain[rows, own] + 1e-9, best, own)
                columns = [part.column("word"), part.column("id"), part.column("c"), pa.array(best, pa.int32()), part.column("around")]
                yield pa.RecordBatch.from_arrays(columns, names=["word", "id", "c", "class", "around"])

    return run


def _beside(table: np.ndarray, words: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The class bigrams of words (paired, class, around) beyond the lexicon next to words of it: of those not paired, and of the paired."""
    out, n = np.zeros((2, *table.shape), np.int64), len(table)
    around = words.select("paired", "class", F.inline("around")).groupBy("paired", "class", "around").agg(F.sum("n").alias("n"))
    sides = around.select("paired", "class", "n", F.explode(F.array(F.expr(f"around div {n}"), F.expr(f"{n} + around % {n}"))).alias("cell"))
    for paired, c, cell, m in sides.groupBy("paired", "class", "cell").agg(F.sum("n")).collect():  # at most 2 * classes * 2 (classes + 1) rows
        if cell % n < n - 1:
            out[(int(paired), cell, c) if cell < n else (int(paired), c, cell - n)] += m
    return out[0], out[1]


def _linked(table: np.ndarray, links: DataFrame) -> np.ndarray:
    """The table of class bigrams with the links between words beyond the lexicon."""
    table = table.copy()
    for before, after, m in links.groupBy("before", "after").agg(F.sum("n")).collect():  # at most classes ** 2 rows
        table[before, after] += m
    return table


def rare_classes(numbers: DataFrame, own: np.ndarray, table: np.ndarray) -> tuple[DataFrame, np.ndarray]:
    """(word, c, class) of all words beyond the lexicon, and the class bigrams of all neighbours in numbered texts. own, table: the
    classes of the lexicon's words and their bigrams, the last class for all others."""
    context, n = numbers.sparkSession.sparkContext, len(table)
    # dealt by word at once: no word beyond the lexicon has more than one in HOT_WORDS of all tokens
    rare = numbers.filter("size(rare) > 0").mapInArrow(_surroundings(context.broadcast((own, n))), "word binary, around int, next binary").repartition("word")
    rare = rare.groupBy("word", "around", "next").agg(F.count("*").alias("n"))
    rare = rare.groupBy("word").agg(F.collect_list(F.struct("around", "next", "n")).alias("around"))
    rare = written(rare.mapInArrow(_join_classes(context.broadcast(table)), RARE_WORDS), "lm-rare")
    table = table.copy()
    table[-1], table[:, -1] = 0, 0
    done, paired = rare.filter("not paired"), rare.filter("paired")
    alone, beside = _beside(table, rare)
    table += alone
    if paired.isEmpty():
        return done.select("word", "c", "class"), table
    links = paired.select(F.col("id").alias("a"), F.col("class").alias("before"), F.inline("around")).filter("next is not null")
    ends = paired.select(F.col("word").alias("next"), F.col("id").alias("b"), F.col("class").alias("after"))
    links = written(links.select("a", "before", "next", "n").join(ends, "next").drop("next"), "lm-links")
    near = links.select(F.expr(f"inline(array(struct(a as id, {n} + after as cell, n), struct(b as id, before as cell, n)))"))
    near = near.repartition("id").groupBy("id", "cell").agg(F.sum("n").alias("n")).groupBy("id").agg(F.collect_list(F.struct("cell", "n")).alias("near"))
    slim = paired.withColumn("around", F.expr("transform(around, x -> struct(x.around, x.n))")).join(near, "id")
    state = context.broadcast(_linked(table + beside, links))
    schema = "word binary, id long, c long, class int, around array<struct<around:int,n:bigint>>"
    moved = written(slim.drop("paired").mapInArrow(_exchange_classes(state), schema), "lm-rare-paired")
    for end, side in (("a", "before"), ("b", "after")):
        links = links.drop(side).join(moved.select(F.col("id").alias(end), F.col("class").alias(side)), end)
    columns = ["word", "c", "class"]
    return done.select(columns).union(moved.select(columns)), _linked(table + _beside(table, moved.withColumn("paired", F.lit(True)))[1], links)


class ClassModel:
    """log10 probabilities of class transitions, and of words in their classes. The last class stands for unseen words."""

    def __init__(self, table: np.ndarray, sizes: np.ndarray, words: np.ndarray, once: int, twice: int):
        """table: class bigrams; sizes, words: tokens and different words of each class; once, twice: words of these counts."""
        n = len(sizes)
        self.discount = (once + 0.5) / (once + 2 * twice + 1)
        sizes = sizes.astype(np.float64)
        frequency = sizes / sizes.sum() if sizes.sum() else np.zeros(n)
        step = (table + BACKOFF * frequency) / (table.sum(1, keepdims=True) + BACKOFF)
        step = np.concatenate([step, frequency[None]])
        unseen = np.divide(self.discount * words, sizes, out=np.zeros(n), where=sizes > 0)
        unseen[0] = 0.0  # the end is no word
        last = step @ unseen if sizes.sum() else np.ones(n + 1)
        with np.errstate(divide="ignore"):
            self.step = np.log10(np.concatenate([step, last[:, None]], 1))
            self.size = np.log10(sizes)

    def emit(self, cls: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """log10 probabilities of words in their classes, by their counts; the end's is 0."""
        return np.where(cls == 0, 0.0, np.log10(np.maximum(counts - self.discount, 1e-9)) - self.size[cls])


def keyed(docs: DataFrame, *more: Column) -> DataFrame:
    return docs.select("text", F.col("doc_id").try_cast("long").alias("doc_id"), *more)


class Trained:
    """All that scoring needs: the lexicon with classes, the model, and the table of all other words."""

    def __init__(self, train: DataFrame | Column, hot_words: int = HOT_WORDS, hot_units: int = HOT_UNITS, classes: int = CLASSES, docs: DataFrame | None = None):
        """train: a table of texts, or which rows of docs are learnt from; then `numbers` are those of all docs."""
        own = isinstance(train, Column)
        rows = keyed(docs, F.coalesce(train, F.lit(False)).alias("learns")) if own else train.select("text")
        context, n = rows.sparkSession.sparkContext, classes + 1
        texts = rows.filter("learns").select("text") if own else rows
        vocab = vocabulary(texts)
        self.tokens, self.distinct, once, twice = vocab.agg(
            F.coalesce(F.sum("c"), F.lit(0)), F.count("*"), F.count_if(F.col("c") == 1), F.count_if(F.col("c") == 2)
        ).first()
        self.lexicon = lexicon = Lexicon(*frequent_words(vocab, hot_words))
        numbers = numbered(rows, context.broadcast(lexicon))
        self.numbers = numbers if own else None
        if own:
            numbers = numbers.filter("learns")
        own = cluster(numbers, lexicon, hot_units, classes)
        self.own = own[:-1]
        shared = context.broadcast((own, n))
        found = numbers.select("numbers").mapInArrow(_contexts(shared, False), "id int, cell int, n int").filter("id < 0")
        table = _square(found.groupBy("cell").agg(F.sum("n").alias("n")).toPandas(), n)
        self.rare, table = rare_classes(numbers, own, table)
        self.table, sizes, words = table[:classes, :classes], np.zeros(classes), np.zeros(classes)
        np.add.at(sizes, self.own, lexicon.counts)
        np.add.at(words, self.own, 1)
        for c, tokens, m in self.rare.groupBy("class").agg(F.sum("c"), F.count("*")).collect():
            sizes[c] += tokens
            words[c] += m
        self.model = ClassModel(self.table, sizes, words, once, twice)


SEQUENCES = (
    "rid long, doc_id long, n_tokens long, n_known long, base_score double, score double, classes binary, places binary, rare array<binary>"
)


def _sequence(state):
    """What the lexicon tells of each text: sums over its words, the classes in order, and the distinct other words with their places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        lexicon, own, model, floor = state.value
        task, row = TaskContext.get().partitionId() << 40, 0
        base, emit = np.log10(lexicon.counts + 1.0) + floor, model.emit(own, lexicon.counts)
        classes = np.append(own, RARE).astype(np.uint8)  # the last place is that of number -1
        base, emit = np.append(base, 0.0), np.append(emit, 0.0)
        for batch in batches:
            for i in range(0, batch.num_rows, SLICE):
                out: list[list] = [[] for _ in range(9)]
                for key, numbers, words in zip(*(batch.column(c).slice(i, SLICE) for c in ("doc_id", "numbers", "rare")), strict=True):
                    key, at = key.as_py(), np.frombuffer(numbers.as_buffer(), np.int32)
                    places: dict[bytes, int] = {}
                    where = [places.setdefault(w, len(places)) for w in words.values.to_pylist()]
                    known = len(at) - len(where) if lexicon.counts[0] else 0
                    values = (
                        task + row, key, len(at), known, float(base[at].sum()), float(emit[at].sum()),
                        classes[at].tobytes(), np.array(where, np.int32).tobytes(), list(places),
                    )
                    row += 1
                    for column, value in zip(out, values, strict=True):
                        column.append(value)
                kinds = (*[pa.int64()] * 4, *[pa.float64()] * 2, pa.binary(), pa.binary(), pa.list_(pa.binary()))
                names = [x.split()[0] for x in SEQUENCES.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=names)

    return run


SCORES = "doc_id long, n_tokens long, n_known long, base_score double, score double"


def _resolve(state):
    """Scores of texts whose other words have been looked up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, _, model, floor = state.value
        unseen = len(model.step) - 1
        for batch in batches:
            known, base, score = [], [], []
            for n, b, s, classes, places, found in zip(*(batch.column(c) for c in ("n_known", "base_score", "score", "classes", "places", "found")), strict=True):
                c = np.frombuffer(classes.as_buffer(), np.uint8).astype(np.int64)
                n, b, s = n.as_py(), b.as_py(), s.as_py()
                if not lexicon.counts[0]:
                    c[c == 0] = unseen
                if places.as_buffer().size:
                    where = np.frombuffer(places.as_buffer(), np.int32)
                    cls = np.full(int(where.max()) + 1, unseen)
                    if found.is_valid:
                        k, own, count = (found.values.field(f).to_numpy() for f in ("k", "class", "c"))
                        cls[k] = own
                        m = np.bincount(where, minlength=len(cls))[k]
                        n += int(m.sum())
                        b += float((m * np.log10(count + 1.0)).sum())
                        s += float((m * model.emit(own, count)).sum())
                    b += floor * len(where)
                    c[c == RARE] = cls[where]
                known.append(n)
                base.append(b)
                score.append(s + float(model.step[np.concatenate([[0 if lexicon.counts[0] else unseen], c[:-1]]), c].sum()))
            columns = [pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(score, pa.float64())]
            names = [x.split()[0] for x in SCORES.split(", ")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_tokens"), *columns], names=names)

    return run


def score_texts(docs: DataFrame, train: DataFrame | Column, hot_words: int = HOT_WORDS, hot_units: int = HOT_UNITS, classes: int = CLASSES) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score, perplexity of every text of docs, learnt from train: a table, or the
    rows of docs that a condition holds for."""
    trained = Trained(train, hot_words, hot_units, classes, docs)
    floor = -float(np.log10(trained.tokens + trained.distinct + 1.0))
    state = docs.sparkSession.sparkContext.broadcast((trained.lexicon, trained.own, trained.model, floor))
    numbers = trained.numbers
    if numbers is None:
        numbers = numbered(keyed(docs), docs.sparkSession.sparkContext.broadcast(trained.lexicon))
    rows = numbers.select("doc_id", "numbers", "rare").mapInArrow(_sequence(state), SEQUENCES)
    rows = written(rows, "lm-sequences", {"compression": "zstd"})
    words = rows.select("rid", F.posexplode("rare").alias("k", "word")).join(trained.rare, "word")
    found = words.groupBy("rid").agg(F.collect_list(F.struct("k", "class", "c")).alias("found"))  # a text's own words
    out = rows.drop("rare").join(found, "rid", "left").mapInArrow(_resolve(state), SCORES)
    out = out.withColumn("train_tokens", F.lit(int(trained.tokens)).cast("long"))
    return out.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
