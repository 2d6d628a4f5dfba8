"""Token counts that follow edits: a segment tree of pre-token counts per document, kept in a table.

A document is its pre-tokens with their numbers of tokens, in leaves of LEAF each, under a binary tree whose nodes hold sums
of characters and tokens. `build` writes the trees down as the lengths and counts of their pre-tokens; `follow` reads them
back, applies edits and returns the trees to be written again, without a second encoding of what stands.

An edit replaces a range of characters. The tree finds the leaves that the range touches; pre-tokens are split anew from
the first one whose end the change can reach, with one pre-token more as context, until a split falls on an old boundary
behind the range, from where on the old pre-tokens stand; only pre-tokens in between are encoded again, and the sums above
the touched leaves are updated. Pre-tokens do not depend on what stands before their begin, and on no more than REACH
characters behind their end, which makes the result equal to encoding the edited text from scratch. A leaf never holds more
than twice LEAF pre-tokens: what an edit adds beyond that gets leaves of its own.

Defined results. Null texts count as empty; edits beyond the end of a text are moved to its end. Rows with null
identifier are counted like others, an identifier that is no number becomes null; repeated rows give equal rows. An empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.llm.common import written
from sheaf.llm.tokens import SPECIAL, piece_ids, splitter

#: Pre-tokens of a leaf.
LEAF = 64
#: Edits of a document by the registered query, and words that it inserts.
EDITS = 3
#: Pre-tokens whose counts a task remembers, and the longest one that it does.
REMEMBERED, LONGEST = 400_000, 64
#: Characters behind a pre-token's end on which it may depend: a special token's string may begin there.
REACH = len(SPECIAL)


class _Counts(dict):
    """Tokens of pre-tokens."""

    def __missing__(self, piece: str) -> int:
        n = len(piece_ids(piece))
        if len(piece) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
            self[piece] = n
        return n


_counts = _Counts()


class SegmentTree:
    """Pre-tokens of one text. chars and tokens hold the sums of node i, whose children are 2 i and 2 i + 1."""

    def __init__(self, text: str, leaf: int = LEAF, lengths: list[int] | None = None, counts: list[int] | None = None):
        """Of a text, or of a text with the lengths and counts that an earlier tree has written down."""
        self.leaf, self.encoded = leaf, 0
        if lengths is None or counts is None:
            pieces = splitter().findall(text)
            counts = list(map(_counts.__getitem__, pieces))
        else:
            ends = np.cumsum(lengths).tolist()
            pieces = [text[i:j] for i, j in zip([0, *ends], ends, strict=False)]
        self.leaves = [(pieces[i : i + leaf], counts[i : i + leaf]) for i in range(0, len(pieces), leaf)]
        self._grow()

    def _grow(self) -> None:
        """A tree over the leaves; nothing is encoded."""
        self.leaves = [x for x in self.leaves if x[0]] or [([], [])]
        self.size = 1 << max(0, (len(self.leaves) - 1).bit_length())
        self.leaves += [([], []) for _ in range(self.size - len(self.leaves))]
        self.chars, self.tokens = [0] * (2 * self.size), [0] * (2 * self.size)
        for i, (pieces, counts) in enumerate(self.leaves, self.size):
            self.chars[i], self.tokens[i] = sum(map(len, pieces)), sum(counts)
        for i in range(self.size - 1, 0, -1):
            self._sum(i)

    def _sum(self, i: int) -> None:
        self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
        self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    @property
    def n_chars(self) -> int:
        return self.chars[1]

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    def pieces(self) -> list[str]:
        return [p for own, _ in self.leaves for p in own]

    def counts(self) -> list[int]:
        return [n for _, own in self.leaves for n in own]

    def text(self) -> str:
        return "".join(self.pieces())

    def find(self, at: int) -> tuple[int, int]:
        """(leaf, characters before it) of the character `at`; the last leaf with characters for the end of the text."""
        i, before = 1, 0
        at = min(at, max(self.chars[1] - 1, 0))
        while i < self.size:
            i *= 2
            if at - before >= self.chars[i]:
                before += self.chars[i]
                i += 1
        return i - self.size, before

    def _store(self, first: int, last: int, pieces: list[str], counts: list[int]) -> None:
        """Replace the leaves from first to last."""
        step = self.leaf if len(pieces) > 2 * self.leaf else max(len(pieces), 1)
        fresh = [(pieces[i : i + step], counts[i : i + step]) for i in range(0, len(pieces), step)]
        if len(fresh) > last - first + 1:
            self.leaves[first : last + 1] = fresh
            self._grow()
            return
        for k, own in enumerate(fresh + [([], [])] * (last - first + 1 - len(fresh)), first):
            self.leaves[k] = own
            i = self.size + k
            self.chars[i], self.tokens[i] = sum(map(len, own[0])), sum(own[1])
            while i := i // 2:
                self._sum(i)

    def edit(self, start: int, end: int, new: str) -> None:
        """Replace the characters from start to end by new."""
        end = min(max(end, 0), self.n_chars)
        start = min(max(start, 0), end)
        # the first pre-token that the change can reach, and one more before it
        leaf, before = self.find(max(start - REACH - 1, 0))
        (pieces, counts), index, at = self.leaves[leaf], 0, before
        while index < len(pieces) and at + len(pieces[index]) < start - REACH:
            at += len(pieces[index])
            index += 1
        if index:
            index -= 1
            at -= len(pieces[index])
        elif before:
            leaf, _ = self.find(before - 1)
            pieces, counts = self.leaves[leaf]
            index = len(pieces) - 1
            at -= len(pieces[index])
        first, kept, kept_counts = leaf, pieces[:index], counts[:index]
        # old pre-tokens from there on, read leaf by leaf as far as needed
        old, old_counts, parts, bounds, reach, last = pieces[index:], counts[index:], [], {}, at, leaf
        for i, p in enumerate(old):
            bounds[reach] = i
            reach += len(p)
        parts.append("".join(old))

        def more() -> None:
            nonlocal reach, last
            last += 1
            for p, n in zip(*self.leaves[last], strict=True):
                bounds[reach] = len(old)
                old.append(p)
                old_counts.append(n)
                reach += len(p)
            parts.append("".join(self.leaves[last][0]))

        shift = len(new) - (end - start)
        while reach < min(end + REACH + 1, self.n_chars):
            more()
        while True:
            whole = reach >= self.n_chars
            stretch = "".join(parts)
            text = stretch[: start - at] + new + stretch[end - at :]
            fresh, meet = [], None
            for m in splitter().finditer(text):
                back = at + m.start() - shift
                if back >= end and back in bounds and m.start() >= start - at + len(new):
                    meet = bounds[back]
                    break
                if not whole and m.end() >= len(text) - REACH:  # the next leaf may change this pre-token
                    break
                fresh.append(m.group())
            else:
                meet = len(old) if whole else None
            if meet is not None:
                break
            for _ in range(last - first + 1):  # twice as far each time
                if reach < self.n_chars:
                    more()
        self.encoded += sum(map(len, fresh))
        self._store(first, last, kept + fresh + old[meet:], kept_counts + list(map(_counts.__getitem__, fresh)) + old_counts[meet:])


def apply_edits(text: str | None, edits: list[tuple[int, int, str]], leaf: int = LEAF) -> tuple[SegmentTree, int]:
    """The tree after all edits, one after the other, and the number of tokens before them."""
    tree = SegmentTree(text or "", leaf)
    before = tree.n_tokens
    for start, end, new in edits:
        tree.edit(start, end, new)
    return tree, before


def planned_edits(text: str | None, count: int = EDITS) -> list[tuple[int, int, str]]:
    """Edits that depend on the text alone: at places named by its checksum, an insertion, a removal and a replacement in turn."""
    text = text or ""
    seed = zlib.crc32(text.encode())
    out = []
    for k in range(count):
        seed = zlib.crc32(seed.to_bytes(4, "little") + bytes([k]))
        start = seed % (len(text) + 1)
        length = seed // 7 % 24
        source = seed // 11 % (len(text) + 1)
        new = text[source : source + seed // 13 % 24]
        out.append(((start, start, new), (start, start + length, ""), (start, start + length, new))[k % 3])
    return out


TREES = "doc_id long, text string, lengths binary, counts binary"
_TREE_NAMES = ["doc_id", "text", "lengths", "counts"]


def _row_of(tree: SegmentTree) -> tuple[bytes, bytes]:
    return tuple(np.array(x, "<u4").tobytes() for x in (list(map(len, tree.pieces())), tree.counts()))


def _tree_of(text: str | None, lengths: bytes, counts: bytes) -> SegmentTree:
    return SegmentTree(text or "", LEAF, *(np.frombuffer(x, "<u4").tolist() for x in (lengths, counts)))


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, 64):
            part = batch.slice(i, 64)
            made = [_row_of(SegmentTree(t.as_py() or "")) for t in part.column(1)]
            columns = [pa.array([x[k] for x in made], pa.binary()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*part.columns[:2], *columns, *part.columns[2:]], names=[*_TREE_NAMES, *part.schema.names[2:]])


_EDITS = "array<struct<start:int,end:int,new:string>>"


def build(docs: DataFrame, edits: str | None = None) -> DataFrame:
    """The tree of every text, as the lengths and counts of its pre-tokens, with the column of edits where one is named."""
    plan = F.col(f"`{edits}`") if edits else F.lit(None)
    rows = docs.select(F.col("doc_id").try_cast("long").alias("doc_id"), "text", plan.cast(_EDITS).alias("edits"))
    return rows.mapInArrow(_build, f"{TREES}, edits {_EDITS}")


SCHEMA = (
    "doc_id long, n_edits int, tokens_before long, tokens_after long, chars_after long, segments long, encoded_chars long,"
    " text_sha256 string"
)


def _follow(trees: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                out: list[list] = [[] for _ in range(10)]
                for text, lengths, counts, edits in zip(*(part.column(c).to_pylist() for c in (*_TREE_NAMES[1:], "edits")), strict=True):
                    plan = planned_edits(text) if edits is None else [(e["start"], e["end"], e["new"] or "") for e in edits]
                    tree = _tree_of(text, lengths, counts)
                    before = tree.n_tokens
                    for start, end, new in plan:
                        tree.edit(start, end, new)
                    text = tree.text()
                    digest = hashlib.sha256(text.encode()).hexdigest()
                    values = (len(plan), before, tree.n_tokens, tree.n_chars, len(tree.pieces()), tree.encoded, digest)
                    for column, value in zip(out, (*values, *((text, *_row_of(tree)) if trees else ())), strict=False):
                        column.append(value)
                kinds = (pa.int32(), *[pa.int64()] * 5, pa.string(), *((pa.string(), pa.binary(), pa.binary()) if trees else ()))
                names = [x.split()[0] for x in SCHEMA.split(",")] + (_TREE_NAMES[1:] if trees else [])
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, k) for c, k in zip(out, kinds, strict=False))], names=names)

    return run


def follow(trees: DataFrame, keep: bool = False) -> DataFrame:
    """Token counts before and after the edits of each tree; with `keep` also the new text, lengths and counts, to be written
    as the next trees."""
    return trees.mapInArrow(_follow(keep), SCHEMA + (", text string, lengths binary, counts binary" if keep else ""))


def recount(docs: DataFrame, edits: str | None = None) -> DataFrame:
    """Token counts before and after the edits of a column array<struct<start:int,end:int,new:string>>, in order; without such a
    column, or where it is null, after planned_edits. The trees are written to the shared folder and read back."""
    return follow(written(build(docs, edits), "edit-trees", {"compression": "zstd"}))
