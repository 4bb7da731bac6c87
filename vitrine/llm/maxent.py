"""A hashed maximum-entropy language model with a class-factored softmax.

A token is a word or the end of its text. P(token | history) = P(class | history) * P(token | class, history):

- the `HEAD` most frequent words are spread over `HEAD_CLASSES` classes of `PLACES` words, and inside a class a softmax with
  the word before as its feature chooses the word;
- all other words, known or not, are in one of `TAIL_CLASSES` classes by their last letters; inside, only the count speaks:
  (c - d) / n for a known word and d * v / n for the one unknown word of the class (n tokens and v words in training, d the
  share of words seen once), which sums to one.

Features of a history: the word before, the two before as a pair, and the second before alone (a skip), hashed to rows of
`CLASS_ROWS` and, with the class, `WORD_ROWS` weight vectors. Biases are those of the counts, so that the untrained model is
a unigram model.

Learning reads every training text once, in `ROUNDS` slices. In a round each task runs AdaGrad steps (one scale a row) over
its texts from the common weights and sends the changes of all rows with the number of tokens behind them; rows are averaged
by these numbers, task by task in a stream, and only the averaged weights (a few MB, whatever the input) come to the driver.

Counts of words come from all training texts. The most frequent words, `DICTIONARY` at most, and their counts go to the
tasks; the other words of a text are joined to the counts by word.

Defined cases: a null text is empty (its only token is the end); rows that share an id are texts of their own; a null id
is neither learned from nor held out; without training texts every token is unknown; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..storage import materialise

HEAD_CLASSES, PLACES, TAIL_CLASSES = 24, 40, 16
CLASSES, HEAD = HEAD_CLASSES + TAIL_CLASSES, HEAD_CLASSES * PLACES
DICTIONARY = 150_000
CLASS_ROWS, WORD_ROWS = 1 << 13, 1 << 14
ROUNDS = 3
STEP = 16_384  # tokens of one gradient step
RATE = 0.5
SPREAD = 8  # entries of a row that share its step scale
FOLDS, HELD_OUT = 5, 1
END = b"\n"  # no word is blank
_BEGIN = 0xFFFF  # the hash of the place before a text
_PART_ROWS = 256
_CACHE = 300_000
_FLUSH = 400_000
_NO_WORD = -60.0


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % FOLDS


def tokens(text: bytes | None) -> list[bytes]:
    """Words of a UTF-8 text, A-Z lowered, and the end; bytes split at the same six blanks as the contract's words."""
    found = (text or b"").lower().split()
    found.append(END)
    return found


def tail_class(word: bytes) -> int:
    core = word.rstrip(b".,;:!?)\"'")
    return zlib.crc32(core[-3:] if core[-1:] >= b"\x80" else core[-2:], len(core) < len(word)) % TAIL_CLASSES


def _texts(batch: pa.RecordBatch) -> Iterator[bytes | None]:
    column = batch.column(batch.schema.get_field_index("text")).cast(pa.large_binary())
    return (x.as_py() for x in column)


# Counts ----------------------------------------------------------------------------------------------------------


def word_counts(docs: DataFrame) -> DataFrame:
    """word, tail (its class outside the head), c: the times of each token in `docs`."""
    def batch_of(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.string()), pa.array([tail_class(w) for w in counts], pa.int32()),
             pa.array(list(counts.values()), pa.int64())], ["word", "tail", "c"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for text in _texts(batch):
                counts.update(tokens(text))
                if len(counts) > _FLUSH:
                    yield batch_of(counts)
                    counts = Counter()
        yield batch_of(counts)

    partial = docs.select("text").mapInArrow(counted, "word string, tail int, c long")
    return materialise(partial.groupBy("word", "tail").agg(F.sum("c").alias("c")), "word-counts")


# The model -------------------------------------------------------------------------------------------------------


@dataclass
class Model:
    words: dict[bytes, int]  # the dictionary, most frequent first; the first `HEAD` are the head
    counts: np.ndarray
    hashes: np.ndarray
    tails: np.ndarray  # tail class of each word of the dictionary
    total: int  # N
    distinct: int  # V
    tail_tokens: np.ndarray  # n, v and d of the tail classes
    tail_words: np.ndarray
    discount: np.ndarray
    class_bias: np.ndarray
    class_rows: np.ndarray
    word_bias: np.ndarray
    word_rows: np.ndarray

    def base(self, c):
        """log10 of the smoothed unigram probability."""
        return np.log10((c + 0.5) / (self.total + 0.5 * (self.distinct + 1)))

    def unknown(self) -> np.ndarray:
        """log10 P(unknown | tail class)."""
        n = self.tail_tokens
        return np.log10(np.where(n > 0, self.discount * self.tail_words / np.maximum(n, 1), 1.0))

    def known(self, c: np.ndarray, tail: np.ndarray) -> np.ndarray:
        """log10 P(word | tail class) of words with training count c."""
        return np.log10((c - self.discount[tail]) / self.tail_tokens[tail])


def untrained(counts: DataFrame, dictionary: int = DICTIONARY) -> Model:
    sums = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    total, distinct = sums["n"] or 0, sums["v"]
    # Words by eighths of powers of two of their counts: the dictionary has the upper steps that it holds as a whole.
    step = F.floor(F.log2("c") * 8)
    held, least = 0, None
    for r in counts.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect():  # some hundred rows at most
        held += r["count"]
        if held > dictionary:
            break
        least = r["step"]
    top = counts.where(F.lit(False) if least is None else step >= least).toArrow().sort_by([("c", "descending"), ("word", "ascending")])
    words = {w.encode(): k for k, w in enumerate(top["word"].to_pylist())}
    c, tails = (top[name].to_numpy().astype(np.int64) for name in ("c", "tail"))
    hashes = np.array([k if k < HEAD else HEAD + zlib.crc32(w) % (_BEGIN - HEAD) for w, k in words.items()], dtype=np.int64)
    n, v, once = (np.zeros(TAIL_CLASSES) for _ in range(3))
    sums = [F.sum("c").alias("n"), F.count("*").alias("v"), F.count_if(F.col("c") == 1).alias("o")]
    for r in counts.groupBy("tail").agg(*sums).collect():  # one row a class
        n[r["tail"]], v[r["tail"]], once[r["tail"]] = r["n"], r["v"], r["o"]
    for k in range(min(HEAD, len(words))):
        n[tails[k]] -= c[k]
        v[tails[k]] -= 1
        once[tails[k]] -= c[k] == 1
    head = np.zeros(HEAD)
    head[: min(HEAD, len(c))] = c[:HEAD]
    by_class = head.reshape(PLACES, HEAD_CLASSES).T  # rank r is in class r % HEAD_CLASSES
    mass = np.concatenate([by_class.sum(axis=1), n]) + 0.5
    with np.errstate(divide="ignore"):
        word_bias = np.where(by_class > 0, np.log(by_class), _NO_WORD)
    zeros = [np.zeros((rows, width), dtype=np.float32) for rows, width in ((CLASS_ROWS, CLASSES), (WORD_ROWS, PLACES))]
    return Model(
        words, c, hashes, tails, total, distinct, n, v, (once + 0.5) / (v + 1), np.log(mass / mass.sum()).astype(np.float32),
        zeros[0], word_bias.astype(np.float32), zeros[1])


class Codes(dict):
    """Numbers of words: their place in the dictionary, or behind it tail class and hash. Rare words are kept up to a limit."""

    def __init__(self, model: Model):
        super().__init__(model.words)
        self.behind = len(model.words)

    def __missing__(self, word: bytes) -> int:
        code = self.behind + (tail_class(word) << 16) + HEAD + zlib.crc32(word) % (_BEGIN - HEAD)
        if len(self) < self.behind + _CACHE:
            self[word] = code
        return code


@dataclass
class Histories:
    """Tokens of some texts in a row, each with the rows of its features."""

    cls: np.ndarray
    place: np.ndarray  # in the head class; -1 in a tail class
    features: list[np.ndarray]

    def __getitem__(self, at) -> Histories:
        return Histories(self.cls[at], self.place[at], [f[at] for f in self.features])


def histories(model: Model, codes: np.ndarray, inside: np.ndarray) -> Histories:
    """From token codes and their places inside their texts (0 for a text's first)."""
    size = len(model.words)
    listed = codes < size
    at, rest = np.where(listed, codes, 0), np.where(listed, 0, codes - size)
    head = listed & (codes < HEAD)
    none = np.zeros(1, dtype=np.int64)
    tails, hashes = (x if len(x) else none for x in (model.tails, model.hashes))
    tail = np.where(listed, tails[at], rest >> 16)
    hashed = np.where(listed, hashes[at], rest & 0xFFFF)
    cls = np.where(head, codes % HEAD_CLASSES, HEAD_CLASSES + tail)
    place = np.where(head, codes // HEAD_CLASSES, -1)
    before = []
    for k in (1, 2):
        moved = np.full(len(codes), _BEGIN, dtype=np.int64)
        moved[k:] = np.where(inside[k:] >= k, hashed[:-k], _BEGIN)
        before.append(moved)
    one, two = before
    features = [
        np.where(one < HEAD, one, HEAD + one % (3072 - HEAD)),  # rows 0 to 3071, a row of its own for each word of the head
        3072 + (two * 40_503 >> 4) % 1024,
        4096 + (one * 1_000_003 + two * 8_191 >> 3) % 4096,
    ]
    return Histories(cls, place, features)


def word_features(seen: Histories) -> list[np.ndarray]:
    """Inside a class only the word before speaks."""
    return [((seen.features[0] * 37 + seen.cls * 2_654_435) * 40_503 >> 7) % WORD_ROWS]


def _powers(logits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """exp of shifted logits and their sums by row; rows are shifted one by one only where one shift for all underflows."""
    powers = np.exp(logits - logits.max())
    sums = powers @ np.ones(powers.shape[1], dtype=np.float32)
    if sums.min() < 1e-20:
        powers = np.exp(logits - logits.max(axis=1, keepdims=True))
        sums = powers.sum(axis=1)
    return powers, sums


def _log_chosen(logits: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    powers, sums = _powers(logits)
    own = powers[np.arange(len(chosen)), chosen].astype(float)
    with np.errstate(divide="ignore"):
        out = np.log(own) - np.log(sums.astype(float))
    for k in np.flatnonzero(own < 1e-30):  # too small for the common shift
        row = logits[k].astype(float)
        out[k] = row[chosen[k]] - row.max() - math.log(np.exp(row - row.max()).sum())
    return out


def _error(logits: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Gradient of the loss by the logits: probabilities, less one at what came."""
    powers, sums = _powers(logits)
    powers /= sums[:, None]
    powers[np.arange(len(chosen)), chosen] -= 1
    return powers


def _logits(bias: np.ndarray, rows: np.ndarray, features: list[np.ndarray]) -> np.ndarray:
    out = rows[features[0]] + bias
    for f in features[1:]:
        out += rows[f]
    return out


def log_probabilities(model: Model, seen: Histories) -> np.ndarray:
    """Natural log of P(class | history), times P(word | class, history) for words of the head."""
    out = np.empty(len(seen.cls))
    for at in range(0, len(out), STEP):
        some = seen[at : at + STEP]
        n = len(some.cls)
        own = _log_chosen(_logits(model.class_bias, model.class_rows, some.features), some.cls)
        head = np.flatnonzero(some.place >= 0)
        if len(head):
            few = some[head]
            own[head] += _log_chosen(_logits(model.word_bias[few.cls], model.word_rows, word_features(few)), few.place)
        out[at : at + n] = own
    return out


# Learning --------------------------------------------------------------------------------------------------------


class Learner:
    """AdaGrad steps on a task's own copy of the weights."""

    def __init__(self, model: Model):
        self.model = replace(model, class_rows=model.class_rows.copy(), word_rows=model.word_rows.copy())
        self.squares = [np.ones(CLASS_ROWS, dtype=np.float32), np.ones(WORD_ROWS, dtype=np.float32)]
        self.touched = [np.zeros(CLASS_ROWS, dtype=np.int64), np.zeros(WORD_ROWS, dtype=np.int64)]

    def _move(self, which: int, features: list[np.ndarray], gradient: np.ndarray) -> None:
        rows = (self.model.class_rows, self.model.word_rows)[which]
        for f in features:
            order = np.argsort(f)
            own = f[order]
            starts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            sums, ids = np.add.reduceat(gradient[order], starts, axis=0), own[starts]
            squares = self.squares[which][ids] + np.einsum("ij,ij->i", sums, sums) / SPREAD
            self.squares[which][ids] = squares
            rows[ids] -= sums * (RATE / np.sqrt(squares))[:, None]
            self.touched[which][ids] += np.diff(np.concatenate([starts, [len(own)]]))

    def step(self, seen: Histories) -> None:
        model = self.model
        self._move(0, seen.features, _error(_logits(model.class_bias, model.class_rows, seen.features), seen.cls))
        few = seen[np.flatnonzero(seen.place >= 0)]
        if len(few.cls):
            features = word_features(few)
            self._move(1, features, _error(_logits(model.word_bias[few.cls], model.word_rows, features), few.place))


def _coded(codes: Codes, texts: Iterator[bytes | None], least: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list]]:
    """Groups of texts of `least` tokens or more: codes, places inside the texts, tokens of each text, and their words."""
    waiting, total = [], 0

    def group():
        sizes = np.array([len(w) for w in waiting])
        numbers = np.array([code for words in waiting for code in map(codes.__getitem__, words)], dtype=np.int64)
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        return numbers, np.arange(len(numbers)) - np.repeat(starts, sizes), sizes, waiting

    for text in texts:
        waiting.append(tokens(text))
        total += len(waiting[-1])
        if total >= least:
            yield group()
            waiting, total = [], 0
    if waiting:
        yield group()


_CHANGES = "task int, part int, changes binary, touched binary"


def changes(docs: DataFrame, model: Model) -> DataFrame:
    """What every task's steps over its texts change, in parts of `_PART_ROWS` rows; word rows follow the class rows."""
    def learned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learner, codes = Learner(model), Codes(model)
        for batch in batches:
            for numbers, inside, _, _ in _coded(codes, _texts(batch), 16 * STEP):
                seen = histories(model, numbers, inside)
                for at in range(0, len(numbers), STEP):
                    learner.step(seen[at : at + STEP])
        task, part = TaskContext.get().partitionId(), 0
        for old, new, touched in zip((model.class_rows, model.word_rows), (learner.model.class_rows, learner.model.word_rows),
                                     learner.touched):
            for at in range(0, len(old), _PART_ROWS):
                rows = slice(at, at + _PART_ROWS)
                if touched[rows].any():
                    moved = (new[rows] - old[rows]).astype(np.float16)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([task], pa.int32()), pa.array([part], pa.int32()), pa.array([moved.tobytes()], pa.binary()),
                         pa.array([touched[rows].astype(np.int32).tobytes()], pa.binary())],
                        ["task", "part", "changes", "touched"])
                part += 1

    return docs.select("text").mapInArrow(learned, _CHANGES)


def averaged(moved: DataFrame) -> DataFrame:
    """One row a part: the changes averaged by the tokens behind them. Tasks' rows stream through, in order of task."""
    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list[np.ndarray]] = {}  # a bounded number of parts
        for batch in batches:
            for part, change, touched in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3))):
                times = np.frombuffer(touched, np.int32).astype(np.float64)
                change = np.frombuffer(change, np.float16).reshape(len(times), -1) * times[:, None]
                held = sums.setdefault(part, [np.zeros(change.shape), np.zeros(len(times))])
                held[0] += change
                held[1] += times
        means = [(total / np.maximum(times, 1)[:, None]).astype(np.float32).tobytes() for total, times in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(means, pa.binary())], ["part", "changes"])

    return moved.repartition("part").sortWithinPartitions("part", "task").mapInArrow(summed, "part int, changes binary")


def fit(docs: DataFrame, dictionary: int = DICTIONARY, rounds: int = ROUNDS) -> tuple[Model, DataFrame]:
    """The model and the word counts of the training texts in `docs` (doc_id, text)."""
    learned = docs.select("doc_id", "text").where(fold(F.col("doc_id")) != HELD_OUT)
    counts = word_counts(learned)
    model = untrained(counts, dictionary)
    for k in range(rounds):
        part = learned.where(F.pmod(F.xxhash64("doc_id"), F.lit(rounds)) == k)
        for row in averaged(changes(part, model)).collect():
            change = np.frombuffer(row["changes"], np.float32).reshape(_PART_ROWS, -1)
            at = row["part"] * _PART_ROWS
            rows, at = (model.class_rows, at) if at < CLASS_ROWS else (model.word_rows, at - CLASS_ROWS)
            rows[at : at + _PART_ROWS] += change
    return model, counts


# Scoring ---------------------------------------------------------------------------------------------------------


def partly_scored(docs: DataFrame, model: Model) -> DataFrame:
    """One row a text: scores of what the dictionary knows, and the other words (`rare`) with their times."""
    kind = docs.schema["doc_id"].dataType
    doc_type = to_arrow_type(kind)
    rare_type = pa.list_(pa.struct([("word", pa.string()), ("tail", pa.int32()), ("n", pa.int64())]))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, size = Codes(model), len(model.words)
        first, number = TaskContext.get().partitionId() << 33, 0
        base = model.base(model.counts) if size else np.zeros(1)
        spread = np.zeros(max(size, 1))  # log10 P(word | tail class) of listed words outside the head
        spread[HEAD:size] = model.known(model.counts[HEAD:], model.tails[HEAD:])
        for batch in batches:
            ids, held = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            done = 0
            for numbers, inside, sizes, words in _coded(codes, _texts(batch), 4 * STEP):
                text = np.repeat(np.arange(len(sizes)), sizes)
                listed = np.flatnonzero(numbers < size)
                of_listed = numbers[listed]
                natural = log_probabilities(model, histories(model, numbers, inside)) / math.log(10)
                natural[listed] += spread[of_listed]
                score, known, bases = (
                    np.bincount(t, w, len(sizes)) for t, w in ((text, natural), (text[listed], None), (text[listed], base[of_listed])))
                rare = []
                for own, start in zip(words, np.cumsum(sizes) - sizes):
                    behind = np.flatnonzero(numbers[start : start + len(own)] >= size)
                    times = Counter([own[j] for j in behind])
                    rare.append([{"word": w.decode(), "tail": tail_class(w), "n": n} for w, n in times.items()])
                rows = slice(done, done + len(sizes))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(range(first + number, first + number + len(sizes)), pa.int64()), pa.array(ids[rows], doc_type),
                     pa.array(held[rows], pa.bool_()), pa.array(sizes, pa.int64()), pa.array(known.astype(np.int64)),
                     pa.array(bases.astype(float)), pa.array(score.astype(float)), pa.array(rare, rare_type)],
                    ["row", "doc_id", "held_out", "n_tokens", "known", "base", "partial", "rare"])
                done, number = done + len(sizes), number + len(sizes)

    held_out = F.coalesce(fold(F.col("doc_id")) == HELD_OUT, F.lit(False))
    return docs.select("doc_id", "text", held_out.alias("held_out")).mapInArrow(
        scored, f"row long, doc_id {kind.simpleString()}, held_out boolean, n_tokens long, known long, base double, "
        "partial double, rare array<struct<word: string, tail: int, n: long>>")


def score(docs: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every text."""
    found = materialise(partly_scored(docs, model), "partly-scored")
    rare = found.select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.tail", "r.n")
    held = counts.select(F.col("word").alias("_word"), "c")
    joined = rare.join(held, rare["word"] == held["_word"], "left")
    per_class = [F.array(*[F.lit(float(x)) for x in xs]) for xs in (model.discount, np.maximum(model.tail_tokens, 1), model.unknown())]
    discount, tokens_of, unknown = (F.element_at(x, F.col("tail") + 1) for x in per_class)
    c, bottom = F.coalesce("c", F.lit(0)), model.total + 0.5 * (model.distinct + 1)
    inside = F.when(F.col("c").isNull(), unknown).otherwise(F.log10((F.col("c") - discount) / tokens_of))
    more = joined.groupBy("row").agg(
        F.sum(F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0)).alias("_known"),
        F.sum(F.col("n") * F.log10((c + 0.5) / F.lit(bottom))).alias("_base"), F.sum(F.col("n") * inside).alias("_score"))
    both = found.drop("rare").join(more, "row", "left")
    return both.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("_known", F.lit(0))).alias("n_known"),
        F.lit(model.total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("_base", F.lit(0.0))).alias("base_score"),
        (F.col("partial") + F.coalesce("_score", F.lit(0.0))).alias("score"))


def learn_and_score(docs: DataFrame) -> DataFrame:
    model, counts = fit(docs)
    return score(docs, model, counts)
