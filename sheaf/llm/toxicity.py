"""Toxicity by a subsequence string kernel, Nystroem landmarks and a support vector machine.

Kernel. A word is a string over 32 symbols, of which two mark its begin and end; its features are its subsequences of three symbols within a span of SPAN,
each weighted by DECAY to the power of its span, so that a word keeps most of its features when characters are inserted
or dropped. Punctuation inside a word is dropped and single letters in a row are read as one word, so that an insult
spelt with gaps is one string too. The kernel is the cosine of two feature vectors.

Training. Labels belong to texts, insults to words: of labelled sample texts, the begins of words whose
share of toxic texts is far beyond chance mark the words to learn from, each an instance of the toxic class as often as
toxic texts hold it and of the clean class as often as clean texts do, joined by copies with an inserted character; other
words of clean texts are the rest of the clean class, the hardest of them mined by the machine's own scores. The
machine learns on the Nystroem features of landmarks from both classes, and as its decision is linear in kernels to the
landmarks, scoring a word needs one table of 32 ** 3 weights only. A sentence scores as its worst word; a logistic
curve fitted to the sample texts, and to copies of the toxic ones with inserted characters, turns a text's TOP worst words, and whether the worst one comes back, into a probability.

The sample has at most TOXIC_TEXTS and CLEAN_TEXTS texts, chosen by a hash of their identifier; scoring reads all texts whole.

Defined results. Null and empty texts, and all texts if no toxic words are found, score as texts without any word: near 0.
Labels that are null or belong to no text are not used; of repeated labels of one text the largest counts, of different
texts of one identifier the least one. Rows with null identifier are scored like others; an identifier that is no number becomes null. An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.llm.common import ROW, packed, remembers, tidy, unpacked

TOXIC_TEXTS, CLEAN_TEXTS = 6000, 12_000
#: Probability from which a text counts as toxic.
THRESHOLD = 0.7
DECAY, SPAN, WIDTH = 0.6, 5, 16
LANDMARKS, CLEAN_WORDS, TOXIC_WORDS, HARD_WORDS = 256, 12_000, 2000, 4000
#: Largest chance of a marking string under the texts' share of toxic ones, and the weight of errors in the machine.
CHANCE, PENALTY = 1e-7, 1000.0
#: Share of toxic texts among those that hold a marking string, at least, and worst words of a text that count.
MARKED, TOP = 0.35, 3
#: Words whose scores a worker remembers.
REMEMBERED = 300_000
#: Texts worked through at once.
SLICE = 64
#: Values below and above these count as these.
FLOOR, CEILING = -1.5, 2.0

_PATTERNS = [(j, k) for j in range(1, SPAN - 1) for k in range(j + 1, SPAN)]
# Digits and signs that stand for letters.
_LOOKALIKES = str.maketrans("013457@$", "oieastas")
_DROPPED = bytes(b for b in range(33, 128) if not chr(b).isalnum() and chr(b) not in "@$")
_SINGLES = re.compile(rb"(?<!\S)(?:[0-9a-z@$]\s+){2,}[0-9a-z@$](?!\S)")
_SENTENCE_END = re.compile(r"(?<=[.!?])\s+|\n+")


def words_of(text: str | None) -> list[bytes]:
    """Lower-case words without punctuation; runs of single letters are one more word each."""
    raw = (text or "").encode().lower()
    plain = raw.translate(None, _DROPPED)
    words = plain.split()
    spaced = raw.translate(_TO_SPACE)
    runs = (m for m in _SINGLES.finditer(spaced) if len(raw[m.start() : m.end()].split()) > 1)  # others are one word already
    return words + [b"".join(m.group().split()) for m in runs]


_TO_SPACE = bytes(32 if b in _DROPPED else b for b in range(256))


@lru_cache(maxsize=20_000)
def folded(word: bytes) -> str:
    """Letters a to z, and one sign for any other character; accents and look-alikes are folded."""
    text = word.decode(errors="replace").translate(_LOOKALIKES)
    if not text.isascii():
        text = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    return text


def symbols(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(rows of WIDTH symbols, the word of each row); long words have several overlapping rows."""
    rows, of = [], []
    for i, word in enumerate(words):
        text = "^" + folded(word) + "|"
        for start in range(0, max(1, len(text) - WIDTH // 2), WIDTH // 2):
            piece = text[start : start + WIDTH]
            rows.append(piece.encode("ascii", "replace").ljust(WIDTH, b"\0"))
            of.append(i)
    raw = np.frombuffer(b"".join(rows), np.uint8).reshape(-1, WIDTH).astype(np.int32)
    letters = np.where((raw >= 97) & (raw <= 122), raw - 96, np.where(raw == 94, 28, np.where(raw == 124, 29, 27)))
    return np.where(raw == 0, 0, letters), np.array(of, np.int64)


def features(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes, weights) of each row's feature vector, of length one; unused places have weight 0."""
    codes, weights = [], []
    for j, k in _PATTERNS:
        a, b, c = rows[:, : WIDTH - k], rows[:, j : WIDTH - k + j], rows[:, k:]
        codes.append(a << 10 | b << 5 | c)
        weights.append(np.where(c > 0, DECAY ** (k + 1), 0.0).astype(np.float32))
    codes, weights = np.concatenate(codes, 1), np.concatenate(weights, 1)
    keys = codes << 7 | np.arange(codes.shape[1], dtype=np.int32)
    keys.sort(1)
    codes, weights = keys >> 7, np.take_along_axis(weights, keys & 127, 1)
    total = np.cumsum(weights, 1)  # equal codes of a row count as one feature
    last = np.concatenate([codes[:, 1:] != codes[:, :-1], np.ones((len(codes), 1), bool)], 1)
    upto = np.where(last, total, 0)
    before = np.concatenate([np.zeros((len(codes), 1), np.float32), np.maximum.accumulate(upto, 1)[:, :-1]], 1)
    merged = np.where(last, total - before, 0)
    size = np.sqrt((merged * merged).sum(1, keepdims=True))
    return codes, merged / np.maximum(size, 1e-9)


def kernel(rows: np.ndarray, landmarks: np.ndarray) -> np.ndarray:
    """Kernels of all rows with all landmark rows."""
    table = np.zeros((1 << 15, len(landmarks)), np.float32)
    codes, weights = features(landmarks)
    np.add.at(table, (codes, np.arange(len(landmarks))[:, None]), weights)
    out = np.empty((len(rows), len(landmarks)), np.float32)
    for i in range(0, len(rows), 128):
        codes, weights = features(rows[i : i + 128])
        out[i : i + 128] = np.einsum("ij,ijk->ik", weights, table[codes])
    return out


def _svm(z: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float, rounds: int = 25) -> np.ndarray:
    """Weights and bias of a squared-hinge machine, by Newton steps on the active set; z is worked through in slices."""
    size = z.shape[1] + 1
    w = np.zeros(size)
    ridge = np.eye(size)
    ridge[-1, -1] = 1e-6
    active = None
    for _ in range(rounds):
        now = y * (z @ w[:-1] + w[-1]) < 1
        if active is not None and (now == active).all():
            break
        active = now
        rows = np.flatnonzero(active)
        left, right = ridge.copy(), np.zeros(size)
        for i in range(0, len(rows), 4096):
            part = rows[i : i + 4096]
            x = np.concatenate([z[part].astype(np.float64), np.ones((len(part), 1))], 1)
            c = penalty * weight[part]
            left += (x * c[:, None]).T @ x
            right += x.T @ (c * y[part])
        w = np.linalg.solve(left, right)
    return w


def _chosen(rows: np.ndarray, count: int, given: int = 1) -> np.ndarray:
    """Landmarks: the first `given` rows, then others by farthest-first traversal in the kernel's geometry."""
    chosen = list(range(min(given, len(rows))))
    near = kernel(rows, rows[chosen]).max(1)
    while len(chosen) < min(count, len(rows)):
        far = int(near.argmin())
        if near[far] > 0.999:
            break
        chosen.append(far)
        near = np.maximum(near, kernel(rows, rows[far : far + 1])[:, 0])
    return rows[chosen]


def _inserted(word: bytes, seed: int) -> bytes:
    """The word with a character inserted inside."""
    at = 1 + seed % max(1, len(word) - 1)
    return word[:at] + b"xqzklw"[seed % 6 : seed % 6 + 1] + word[at:]


class KernelMachine:
    """A table of weights over subsequences, a bias, and the logistic curve from scores to probabilities."""

    def __init__(self):
        self.table, self.bias = np.zeros(1 << 15, np.float32), -1.0
        self.slopes, self.shift = np.array([4.0] + [0.0] * TOP), 0.0

    def train(self, marked: list[bytes], toxic: np.ndarray, clean: np.ndarray, usual: list[bytes], hard_from: list[bytes]) -> None:
        """marked: words that hold a marking string, with their numbers of toxic and clean texts; usual and hard_from: words of
        clean texts without one. Marked words weigh as their texts; the usual ones together as all toxic texts do."""
        made = [_inserted(w, i + j) for j in (0, 3) for i, w in enumerate(marked)]
        rows, of = symbols(marked + made)
        of = of % len(marked)
        plain, (hard, _) = symbols(usual)[0], symbols(hard_from or usual[:1])
        for _ in range(2):
            landmarks = np.concatenate([_chosen(rows, LANDMARKS * 3 // 4, LANDMARKS // 2), _chosen(plain[-2000:], LANDMARKS // 4)])
            x = np.concatenate([rows, rows, plain])
            y = np.concatenate([np.ones(len(rows)), -np.ones(len(rows) + len(plain))])
            mass = toxic[of].sum()
            weight = np.concatenate([toxic[of], clean[of], np.full(len(plain), mass / len(plain))]) * len(rows) / mass
            between = kernel(landmarks, landmarks).astype(np.float64)
            value, vector = np.linalg.eigh(between)
            keep = value > 1e-6
            whiten = vector[:, keep] / np.sqrt(value[keep])
            used = weight > 0
            w = _svm(kernel(x[used], landmarks) @ whiten.astype(np.float32), y[used], weight[used], PENALTY)
            codes, weights = features(landmarks)
            self.table = np.zeros(1 << 15, np.float32)
            np.add.at(self.table, codes, weights * (whiten @ w[:-1])[:, None].astype(np.float32))
            self.bias = float(w[-1])
            worst = np.argsort(-self._rows(hard), kind="stable")[:HARD_WORDS]
            plain = np.concatenate([plain, hard[worst]])

    def _rows(self, rows: np.ndarray) -> np.ndarray:
        out = np.empty(len(rows), np.float32)
        for i in range(0, len(rows), 4096):
            codes, weights = features(rows[i : i + 4096])
            out[i : i + 4096] = (self.table[codes] * weights).sum(1)
        return out + self.bias

    def words(self, words: list[bytes]) -> np.ndarray:
        """The decision values of words: the largest of their rows."""
        rows, of = symbols(words)
        out = np.full(len(words), -np.inf, np.float32)
        np.maximum.at(out, of, self._rows(rows))
        return out

    def curve(self, worst: np.ndarray, toxic: np.ndarray) -> None:
        """Fit the logistic curve to the worst words' values (a row per text), with a little regularisation."""
        x = np.concatenate([np.clip(worst, FLOOR, CEILING), np.ones((len(worst), 1))], 1)
        w = np.zeros(TOP + 2)
        ridge = np.diag([1e-5] * (TOP + 1) + [1e-8])
        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            gradient = x.T @ (p - toxic) / len(x) + ridge @ w
            curvature = (x * (p * (1 - p))[:, None]).T @ x / len(x) + ridge
            step = np.clip(np.linalg.solve(curvature, gradient), -2, 2)
            w = w - step
            if np.abs(step).max() < 1e-9:
                break
        self.slopes, self.shift = np.maximum(w[:-1], 0.0), float(w[-1])

    def probability(self, worst: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(np.clip(worst, FLOOR, CEILING) @ self.slopes + self.shift, -30, 30)))


class WordScores(dict):
    """Decision values of words, worked out for all unknown words of a batch at once."""

    def __init__(self, machine: KernelMachine):
        super().__init__()
        self.machine = machine

    def learn(self, words: list[bytes]) -> None:
        if len(self) > REMEMBERED:
            self.clear()
        new = list(dict.fromkeys(w for w in words if w not in self))
        if new:
            self.update(zip(new, self.machine.words(new).tolist(), strict=True))


_kept: list[WordScores] = []


def _forget() -> None:
    _kept.clear()
    folded.cache_clear()


remembers("toxicity", _forget)


def _scores_of(machine: KernelMachine) -> WordScores:
    """The scores that this worker remembers from earlier tasks with the same machine."""
    if not _kept or _kept[0].machine is not machine:
        _kept[:] = [WordScores(machine)]
    return _kept[0]


def _grams(word: bytes) -> set[str]:
    """The begins of a word by which toxic words are found: three to seven letters."""
    text = "^" + folded(word)
    return {text[:n] for n in range(4, min(len(text), 8) + 1)}


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers of toxic and clean texts of words and of their begins, summed up until a fixed number of strings is held."""
    held = {"word": (Counter(), Counter()), "gram": (Counter(), Counter())}

    def flush() -> Iterator[pa.RecordBatch]:
        for kind, (toxic, clean) in held.items():
            keys = list(toxic.keys() | clean.keys())
            columns = [pa.array([kind] * len(keys)), pa.array([k if isinstance(k, bytes) else k.encode() for k in keys], pa.binary())]
            columns += [pa.array([x[k] for k in keys], pa.int64()) for x in (toxic, clean)]
            toxic.clear()
            clean.clear()
            yield pa.RecordBatch.from_arrays(columns, names=["kind", "key", "toxic", "clean"])

    for batch in _slices(batches):
        for label, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            words = set(words_of(text.as_py()))
            side = 0 if label else 1
            held["word"][side].update(words)
            held["gram"][side].update(set().union(*(_grams(w) for w in words)))
        if sum(len(c) for sides in held.values() for c in sides) > REMEMBERED:
            yield from flush()
    yield from flush()


def _marked(marks: set[str]):
    """Rows of words that hold a marking string."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([bool(_grams(k.as_py()) & marks) for k in batch.column(0)], pa.bool_()))

    return run


def _most_counted(words: DataFrame, count: str, most: int):
    """At most `most` rows, all whose count is above some count, in falling order; found by a histogram, so that tasks send no more."""
    histogram = dict(words.groupBy(count).agg(F.count("*")).collect())
    least, taken = None, 0
    for n in sorted(histogram, reverse=True):
        if (taken := taken + histogram[n]) > most:
            break
        least = n
    found = words.filter(F.lit(False) if least is None else F.col(count) >= least).toPandas()
    return found.sort_values([count, "key"], ascending=[False, True], ignore_index=True)


def _chance(toxic: np.ndarray, clean: np.ndarray, share: float) -> np.ndarray:
    """Logarithm of an upper bound on the chance of so many toxic texts among those that hold a string."""
    n = toxic + clean
    q = np.maximum(toxic / n, 1e-12)
    bound = n * (q * np.log(q / share) + np.where(q < 1, (1 - q) * np.log(np.maximum(1 - q, 1e-12) / (1 - share)), 0))
    return np.where(q > share, -bound, 0.0)


def train(docs: DataFrame, labels: DataFrame) -> KernelMachine:
    """A machine learnt from the sampled texts of docs that labels marks."""
    machine = KernelMachine()
    known = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("label"))
    sizes = {row.label: row.n for row in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not sizes.get(1) or not sizes.get(0):
        return machine
    share = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    bound = F.when(F.col("label") == 1, TOXIC_TEXTS / sizes[1]).otherwise(CLEAN_TEXTS / sizes[0])
    ids = known.filter(share <= bound)  # at most about TOXIC_TEXTS + CLEAN_TEXTS identifiers
    texts = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    texts = texts.groupBy("doc_id").agg(F.max("label").alias("label"), F.min("text").alias("text")).select("label", "text").persist()
    try:
        n_toxic, n_clean = (texts.filter(F.col("label") == v).count() for v in (1, 0))
        if not n_toxic or not n_clean:
            return machine
        found = texts.mapInArrow(tidy("toxicity", _word_counts), "kind string, key binary, toxic long, clean long").groupBy("kind", "key")
        found = found.agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).persist()
        base = n_toxic / (n_toxic + n_clean)
        often = found.filter((F.col("kind") == "gram") & (F.col("toxic") >= 3) & (F.col("toxic") >= MARKED * (F.col("toxic") + F.col("clean")))).toPandas()
        sure = _chance(often["toxic"].to_numpy(float), often["clean"].to_numpy(float), base) < np.log(CHANCE)
        marks = {bytes(k).decode() for k in often["key"][sure]}
        words = found.filter(F.col("kind") == "word")
        seen = words.filter("toxic > 0").select("key", "toxic", "clean").mapInArrow(tidy("toxicity", _marked(marks)), "key binary, toxic long, clean long")
        mine = _most_counted(seen, "toxic", TOXIC_WORDS)
        if not len(mine):
            return machine
        usual = words.filter("clean > 0")
        frequent = _most_counted(usual.select("key", "clean"), "clean", CLEAN_WORDS // 2)["key"]
        order, size = F.xxhash64("key"), usual.count()
        part = F.shiftrightunsigned(order, 11).cast("double") / float(1 << 53) < CLEAN_WORDS * 5 / max(size, 1)
        spread = usual.filter(part).select("key", order.alias("order")).toPandas().sort_values(["order", "key"])["key"]
        plain = [w for w in dict.fromkeys(bytes(k) for k in [*frequent, *spread]) if not _grams(w) & marks]
        counts = [mine[c].to_numpy(float) for c in ("toxic", "clean")]
        machine.train([bytes(k) for k in mine["key"]], *counts, plain[:CLEAN_WORDS], plain[CLEAN_WORDS:])
        spark = docs.sparkSession
        shared = spark.sparkContext.broadcast(machine)
        toxic = frozenset(bytes(k) for k in mine["key"][mine["toxic"] > 8 * mine["clean"]])
        seen = texts.mapInArrow(tidy("toxicity", _raw(shared, toxic)), "label int, worst array<double>").toPandas()
        machine.curve(np.stack(seen["worst"].to_list()), seen["label"].to_numpy() == 1)
        found.unpersist()
    finally:
        texts.unpersist()
    return machine


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Small slices, as the words of a slice's texts are held at once."""
    for batch in batches:
        for i in range(0, batch.num_rows, SLICE):
            yield batch.slice(i, SLICE)


def _worst(scores: WordScores, texts: list[str | None]) -> tuple[np.ndarray, list[list[bytes]]]:
    """The values of each text's TOP worst words and of its second worst place, and its words."""
    split = [words_of(t) for t in texts]
    return _worst_words(scores, split), split


def _worst_words(scores: WordScores, split: list[list[bytes]]) -> np.ndarray:
    scores.learn([w for words in split for w in words])
    out = np.full((len(split), TOP + 1), FLOOR)
    for i, words in enumerate(split):
        top = heapq.nlargest(TOP, ((scores[w], w) for w in set(words)))
        out[i, : len(top)] = [value for value, _ in top]
        if top:
            out[i, TOP] = out[i, 0] if words.count(top[0][1]) > 1 else out[i, 1]
    return out


def _raw(shared, toxic: frozenset[bytes]):
    """Labels and worst values of the sample texts, and of copies of the toxic ones whose toxic words have a character inserted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = _scores_of(shared.value)
        for batch in _slices(batches):
            labels, split = batch.column(0).to_pylist(), [words_of(t) for t in batch.column(1).to_pylist()]
            copies = [[_inserted(w, zlib.crc32(w)) if w in toxic else w for w in words] for label, words in zip(labels, split, strict=True) if label and toxic.intersection(words)]
            worst = _worst_words(scores, split + copies)
            columns = [pa.array(labels + [1] * len(copies), pa.int32()), pa.array(worst.tolist(), pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["label", "worst"])

    return run


SCORES = "doc_id long, score double, predicted int, worst_word string, sentence int"


def _predict(shared, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = _scores_of(shared.value)
        for batch in _slices(batches):
            out: list[list] = [[], [], [], []]
            texts = batch.column(1).to_pylist()
            worst, split = _worst(scores, texts)
            for text, words, chance in zip(texts, split, scores.machine.probability(worst).tolist(), strict=True):
                toxic, word, at = chance >= threshold, None, None
                if toxic:  # the sentence that holds the worst word
                    word = max(set(words), key=lambda w: (scores[w], w), default=b"")
                    at = next((k for k, s in enumerate(_SENTENCE_END.split(text or "")) if word in words_of(s)), None)
                    word = word.decode(errors="replace")
                for column, value in zip(out, (chance, int(toxic), word, at), strict=True):
                    column.append(value)
            kinds = (pa.float64(), pa.int32(), pa.string(), pa.int32())
            columns = [pa.array(c, k) for c, k in zip(out, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "score", "predicted", "worst_word", "sentence"])

    return run


def score_texts(docs: DataFrame, machine: KernelMachine, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score, predicted, and for toxic texts the worst word and its sentence (from 0)."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)
    return docs.select(F.col("doc_id").try_cast("long").alias("doc_id"), "text").mapInArrow(tidy("toxicity", _predict(shared, threshold)), SCORES)


def _keep(shared, threshold: float, place: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = _scores_of(shared.value)
        for batch in _slices(batches):
            worst, _ = _worst(scores, batch.column(0).field(place).to_pylist())
            yield batch.filter(pa.array(scores.machine.probability(worst) < threshold))

    return run


def keep_clean(docs: DataFrame, learn: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with all their columns, that a machine learnt from learn and labels does not reject."""
    shared = docs.sparkSession.sparkContext.broadcast(train(learn, labels))
    rows = packed(docs)
    return unpacked(rows.mapInArrow(tidy("toxicity", _keep(shared, threshold, docs.columns.index("text"))), rows.schema))
