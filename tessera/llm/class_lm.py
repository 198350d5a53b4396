"""Language-model scoring with a class-based bigram model.

Exchange clustering assigns every word of the training texts to a class. It
starts with the most frequent words, each a type of its own, and all others as
types by their endings: from classes by frequency, each type moves to the
class that raises the likelihood of the bigrams most, until none moves. Then
sweeps go over all other words: of each word the classes before and after it
are counted over all training texts, and it moves by itself to the class where
its bigrams are likeliest (to first order of the same likelihood). Classes by
endings are left for words that no training text holds.

A text's probability is the product over its words (and one end) of

    P(class | class before) P(word | class),

transitions smoothed towards the classes' shares, words by 0.1 each and 0.1
for each ending of unseen words in the class.

Counts cover all training texts: words, their contexts, counts and classes are
tables as large as the vocabulary; the matrix of type bigrams and that of class
bigrams have fixed sizes and are summed from all partitions. The classes of
the most frequent words go to the tasks; a text's other words are looked up by
a join and meet the classes of their neighbours again by text and position.
"""

from __future__ import annotations

import gc
import math
import zlib
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import id_hash_mod, materialize, release_memory

#: Word types, ending types, classes; the end of a text is the type after these.
WORD_TYPES, ENDING_TYPES, CLASSES = 1023, 1024, 40
TYPES = WORD_TYPES + ENDING_TYPES + 1
END_TYPE = TYPES - 1
#: The end as a token: no word holds a space.
END = b" "
#: Counts of so many most frequent words go to the tasks. Bytes of an ending.
HEAD, ENDING = 400_000, 3
#: Words that a task remembers, and tokens that it looks at together.
ROOM, BLOCK, FEW = 400_000, 2_000_000, 300_000
#: Words that a task counts before it gives the counts on.
MANY = 400_000
SMOOTH, PULL = 0.1, 20.0
_CONTEXT = np.dtype([("slot", "u1"), ("n", "<u4")])
#: In a sequence of classes: a word that is looked up.
_LOOKED_UP = 255


def tokens_of(text: str | None) -> list[bytes]:
    """Words between white space, A-Z lower-cased, then the end."""
    out = (text or "").encode().lower().split()
    out.append(END)
    return out


def ending_type(word: bytes) -> int:
    return WORD_TYPES + (zlib.crc32(word[-ENDING:]) & (ENDING_TYPES - 1))


def held_out(doc_id: Column) -> Column:
    return id_hash_mod(doc_id, 10) == 0


class _Types(dict):
    """Word to index, of unknown words by ending; remembers some of those."""

    def __init__(self, known: dict[bytes, int], base: int, room: int = ROOM):
        super().__init__(known)
        self.base, self.room = base - WORD_TYPES, len(known) + room

    def __missing__(self, word: bytes) -> int:
        at = self.base + ending_type(word)
        if len(self) < self.room:
            self[word] = at
        return at


def frequent_words(docs: DataFrame, n: int) -> list[bytes]:
    """The n most frequent words of docs (text), the end aside; equally frequent ones by their bytes.

    A task gives its counts on in blocks, all of them, so the sums are exact
    however the texts are dealt to tasks and cut into blocks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # words are many and hold no cycles
        count: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            count.pop(END, None)
            b = pa.record_batch([pa.array(count.keys(), pa.binary()), pa.array(count.values(), pa.int64())], ["word", "n"])
            count.clear()
            return b

        for b in batches:
            for x in b.column(0):
                count.update(tokens_of(x.as_py()))
                if len(count) >= MANY:
                    yield out()
        yield out()
        release_memory()

    counts = docs.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    # each partition gives n rows at most
    return counts.orderBy(F.col("n").desc(), "word").limit(n).toArrow().column("word").to_pylist()


def _by_count(words: pa.Table) -> pa.Table:
    """Most frequent first, then by the bytes. Arrow holds some hundred thousand words in some megabytes."""
    return words.sort_by([("n", "descending"), ("word", "ascending")])


def _least(counts: DataFrame) -> int | None:
    """A count that no more than HEAD words reach; None if there is none. From a histogram of counts, some thousand rows."""
    steps = counts.groupBy(F.floor(F.log2("n") * 64).alias("step")).agg(F.count("*").alias("words"), F.min("n").alias("least")).orderBy(F.col("step").desc()).collect()
    least, reached = None, 0
    for r in steps:
        reached += r["words"]
        if reached > HEAD:
            break
        least = int(r["least"])
    return least


def count_bigrams(docs: DataFrame, words: dict[bytes, int]) -> np.ndarray:
    """How often each type follows each, over all texts of docs; every text starts after an end. words: the word types."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()
        total, types, held, n = np.zeros(TYPES * TYPES, np.int64), _Types(words, WORD_TYPES), [], 0

        def pairs() -> np.ndarray:
            at = np.concatenate(held).astype(np.int64)  # a text ends with the end, and so does what is before its first word
            return np.bincount(np.concatenate([[END_TYPE], at[:-1]]) * TYPES + at, minlength=TYPES * TYPES)

        for b in batches:
            for x in b.column(0):
                t = tokens_of(x.as_py())
                held.append(np.fromiter(map(types.__getitem__, t), np.int32, len(t)))
                n += len(t)
                if n > BLOCK:
                    total += pairs()
                    held, n = [], 0
        if held:
            total += pairs()
        rows = total.reshape(TYPES, TYPES)
        some = [r for r in range(TYPES) if rows[r].any()]
        to = [np.flatnonzero(rows[r]).astype(np.int32) for r in some]
        yield pa.record_batch([pa.array(some, pa.int32()), pa.array([t.tobytes() for t in to], pa.binary()), pa.array([rows[r][t].tobytes() for r, t in zip(some, to, strict=True)], pa.binary())], ["before", "types", "counts"])
        del total, rows, held, types
        release_memory()

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(TYPES, np.int64)
        for b in batches:
            for t, c in zip(b.column(1), b.column(2), strict=True):
                total[np.frombuffer(t.as_py(), np.int32)] += np.frombuffer(c.as_py(), np.int64)
        yield pa.record_batch([pa.array([key[0].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["before", "counts"])

    def add_table(key: tuple, table: pa.Table) -> pa.Table:
        return pa.Table.from_batches(add(key, iter(table.to_batches())))

    # partitions give at most TYPES rows each; partial sums in two steps keep a group small
    partial = docs.select("text").mapInArrow(run, "before int, types binary, counts binary")
    part = F.pmod(F.spark_partition_id(), F.lit(64))
    some = partial.withColumn("part", part).groupBy("before", "part").applyInArrow(lambda key, t: add_table(key[:1], t), "before int, counts binary")
    sums = some.select("before", F.lit(np.arange(TYPES, dtype=np.int32).tobytes()).alias("types"), "counts").groupBy("before").applyInArrow(add_table, "before int, counts binary")
    # TYPES rows of TYPES numbers: a fixed size
    out = np.zeros((TYPES, TYPES), np.int64)
    for r in sums.collect():
        out[r[0]] = np.frombuffer(r[1], np.int64)
    return out


def exchange(n: np.ndarray, classes: int = CLASSES, sweeps: int = 8) -> np.ndarray:
    """A class for each type. n: type bigram counts; the last type (the end) has a class of its own, the last.

    The likelihood is sum n(c,d) log n(c,d) - sum n(c.) log n(c.) - sum n(.c) log n(.c).
    """
    v, inner = len(n), classes - 1
    n = n.astype(float)
    order = np.argsort(-(n.sum(0) + n.sum(1))[: v - 1], kind="stable")
    of = np.empty(v, int)
    of[order], of[v - 1] = np.arange(v - 1) % inner, inner
    member = np.eye(classes)[of]
    out, into = n @ member, n.T @ member  # of each type, to and from each class
    both = member.T @ out
    xlogx = lambda a: np.where(a > 0.5, a * np.log(np.maximum(a, 1)), 0.0)
    for _ in range(sweeps):
        moved = 0
        for w in order:
            if not (n[w].any() or n[:, w].any()):
                continue
            a, own = of[w], n[w, w]
            r, c = out[w].copy(), into[w].copy()  # counts to and from classes, w itself in class a
            r[a] -= own
            c[a] -= own
            # the matrix of classes without w
            m = both.copy()
            m[a] -= r
            m[:, a] -= c
            m[a, a] -= own
            # the sums with what w adds to them wherever it goes
            rows, cols = m.sum(1) + c, m.sum(0) + r
            # what placing w into class k adds: row k gains r, column k gains c, and (k, k) also own
            base = xlogx(m)
            with_row, with_col = m + r[None, :], m + c[:, None]
            gain = (xlogx(with_row) - base).sum(1) + (xlogx(with_col) - base).sum(0)
            d = np.diagonal(m)
            gain += xlogx(d + r + c + own) - xlogx(d + r) - xlogx(d + c) + xlogx(d)
            weight_r, weight_c = r.sum() + own, c.sum() + own
            gain -= xlogx(rows + weight_r) - xlogx(rows) + xlogx(cols + weight_c) - xlogx(cols)
            gain[inner] = -np.inf
            k = int(gain.argmax())
            if k != a and gain[k] > gain[a] + 1e-6:
                of[w], moved = k, moved + 1
                out[:, a] -= n[:, w]
                out[:, k] += n[:, w]
                into[:, a] -= n[w]
                into[:, k] += n[w]
                m[k] += r
                m[:, k] += c
                m[k, k] += own
                both = m
        if not moved:
            break
    return of


class Start(NamedTuple):
    """The classes before the sweeps."""

    index: dict[bytes, int]  # words that are types, and the end: their places in classes
    classes: np.ndarray  # class of each place, then of each ending
    bigrams: np.ndarray  # class bigrams


class _Growing(dict):
    """Word to place; words met first get the next place, and their endings' classes."""

    def __init__(self, start: Start):
        super().__init__(start.index)
        self.of, self.endings = start.classes[: len(start.index)].tolist(), start.classes[len(start.index) :].tolist()

    def __missing__(self, word: bytes) -> int:
        at = self[word] = len(self)
        self.of.append(self.endings[ending_type(word) - WORD_TYPES])
        return at


def count_contexts(docs: DataFrame, start: Start, types: int) -> DataFrame:
    """word and context (a binary of slots and counts), some rows for each word of docs (text) but the first so many of start. Slots: classes before, then classes after."""
    shared = docs.sparkSession.sparkContext.broadcast(start)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()
        s, held, n = shared.value, [], 0
        end = s.index[END]
        places = _Growing(s)

        def out() -> pa.RecordBatch:
            seq = np.concatenate(held)
            of = np.array(places.of, np.int64)[seq]
            # every text ends with an end, so what comes before a text's first word is one
            at = np.flatnonzero((seq >= types) & (seq != end))
            before, after = np.where(at > 0, of[at - 1], CLASSES - 1), of[np.minimum(at + 1, len(of) - 1)]
            key, count = np.unique(np.concatenate([seq[at] * (2 * CLASSES) + before, seq[at] * (2 * CLASSES) + CLASSES + after]), return_counts=True)
            context = np.empty(len(key), _CONTEXT)
            context["slot"], context["n"] = key % (2 * CLASSES), count
            word = key // (2 * CLASSES)
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]])[: len(word)])
            offsets = (np.append(first, len(word)) * _CONTEXT.itemsize).astype(np.int32)
            label = list(places)
            return pa.record_batch([pa.array([label[w] for w in word[first].tolist()], pa.binary()), pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(context.tobytes())])], ["word", "context"])

        for b in batches:
            for x in b.column(0):
                t = tokens_of(x.as_py())
                held.append(np.fromiter(map(places.__getitem__, t), np.int64, len(t)))
                n += len(t)
                if n >= BLOCK or len(places) >= 2 * ROOM + len(s.index):
                    yield out()
                    places, held, n = _Growing(s), [], 0
        if held:
            yield out()
        del places, held
        release_memory()

    return docs.select("text").mapInArrow(run, "word binary, context binary")


def likeliest(contexts: np.ndarray, bigrams: np.ndarray) -> np.ndarray:
    """For each row of contexts (counts of classes before, then after) the class where these bigrams are likeliest; ties: the lowest. The end's class is not open."""
    c = len(bigrams)
    m = bigrams + 0.5
    after, before = np.log(m / m.sum(1, keepdims=True)), np.log(m / m.sum(0, keepdims=True))
    gain = contexts[:, :c] @ before + contexts[:, c:] @ after.T
    gain[:, c - 1] = -np.inf
    return gain.argmax(1)


def move_words(contexts: DataFrame, bigrams: np.ndarray) -> DataFrame:
    """word, n and class for each word of count_contexts: its contexts are summed, and it goes where it is likeliest."""

    def placed(words: list[bytes], sums: np.ndarray) -> pa.RecordBatch:
        return pa.record_batch([pa.array(words, pa.binary()), pa.array(sums[:, :CLASSES].sum(1).astype(np.int64)), pa.array(likeliest(sums, bigrams).astype(np.int32))], ["word", "n", "class"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, np.zeros(2 * CLASSES)  # rows of a word may go on in the next batch
        for whole in batches:
            for k in range(0, whole.num_rows, 10_000):
                b = whole.slice(k, 10_000)
                coded = b.column(0).dictionary_encode()
                words, of = coded.dictionary.to_pylist(), coded.indices.to_numpy()
                raw = b.column(1).to_pylist()
                row = np.repeat(of, [len(x) // _CONTEXT.itemsize for x in raw]).astype(np.int64)
                context = np.frombuffer(b"".join(raw), _CONTEXT)
                sums = np.bincount(row * (2 * CLASSES) + context["slot"], context["n"], len(words) * 2 * CLASSES).reshape(len(words), -1)
                if last == words[0]:
                    sums[0] += held
                elif last is not None:
                    yield placed([last], held[None])
                last, held = words[-1], sums[-1].copy()
                if len(words) > 1:
                    yield placed(words[:-1], sums[:-1])
        if last is not None:
            yield placed([last], held[None])
        release_memory()

    return contexts.repartition("word").sortWithinPartitions("word").mapInArrow(run, "word binary, n long, class int")


class Words(NamedTuple):
    """Every training word's class."""

    table: DataFrame  # word, n and class, but of the types
    index: dict[bytes, int]  # the frequent words, types among them, and the end: places
    n: np.ndarray  # of each place
    classes: np.ndarray  # of each place, then of each ending
    class_n: np.ndarray  # tokens of each class
    class_size: np.ndarray  # distinct words of each class
    train_tokens: int
    distinct: int

    def below(self) -> np.ndarray:
        """Of each class what the counts are divided by: its tokens, and 0.1 for each word and each ending of unseen words."""
        size = len(self.index)
        return self.class_n + SMOOTH * (self.class_size + np.bincount(self.classes[size:], minlength=CLASSES))


def cluster(train: DataFrame, sweeps: int = 1) -> Words:
    """Classes of all words of train (text)."""
    frequent = frequent_words(train, WORD_TYPES)
    types = {w: i for i, w in enumerate(frequent)}
    bigrams = count_bigrams(train, types | {END: END_TYPE})
    of = exchange(bigrams)
    between = np.zeros((CLASSES, CLASSES))
    np.add.at(between, (of[:, None], of[None, :]), bigrams)
    endings, counts = of[WORD_TYPES:END_TYPE], bigrams.sum(0)
    start = Start(types | {END: len(types)}, np.concatenate([of[: len(types)], [CLASSES - 1], endings]), between)
    for _ in range(sweeps):
        table = materialize(move_words(count_contexts(train, start, len(types)), start.bigrams), "lm-words")
        least = _least(table)
        # at most HEAD words
        head = _by_count(table.filter(F.col("n") >= (2**62 if least is None else least)).select("word", "n", "class").toArrow())
        index = types | {w: len(types) + i for i, w in enumerate(head.column("word").to_pylist())} | {END: len(types) + head.num_rows}
        start = start._replace(index=index, classes=np.concatenate([of[: len(types)], head.column("class").to_numpy().astype(int), [CLASSES - 1], endings]))
    n = np.concatenate([counts[: len(types)], head.column("n").to_numpy(), [counts[END_TYPE]]]).astype(float)
    del head, bigrams
    release_memory()
    known = np.append(counts[: len(types)], counts[END_TYPE])
    place = np.append(start.classes[: len(types)], CLASSES - 1).astype(int)
    class_n, class_size = np.bincount(place, known, CLASSES), np.bincount(place, known > 0, CLASSES)
    rest = table.groupBy("class").agg(F.sum("n"), F.count("*")).collect()
    for r in rest:
        class_n[r[0]] += r[1]
        class_size[r[0]] += r[2]
    return Words(table, start.index, n, start.classes, class_n, class_size, int(known.sum()) + sum(r[1] for r in rest), int((known > 0).sum()) + sum(r[2] for r in rest))


def classed(docs: DataFrame, words: Words) -> DataFrame:
    """Of docs (row, doc_id, text, train) a row each, and one for each word that is not in words.index.

    Of texts: row, train, doc_id, n_tokens, and over the words in the index
    n_known, base and score (without transitions), and classes, a byte a token.
    Of words: row, train, pos, word, class (should the word be unknown), before
    and after (classes of the neighbours, null: looked up as well).
    """
    shared = docs.sparkSession.sparkContext.broadcast(words._replace(table=None))  # at most HEAD words
    fields = ["row", "train", "doc_id", "n_tokens", "n_known", "base", "score", "classes", "pos", "word", "class", "before", "after"]
    kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.int32(), pa.binary(), pa.int8(), pa.int8(), pa.int8())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()
        m = shared.value
        size = len(m.index)
        index, classes = _Types(m.index, size), m.classes.astype(np.int64)
        log = np.log10(m.n + SMOOTH)
        base = np.append(log - math.log10(m.train_tokens + SMOOTH * (m.distinct + 1)), np.zeros(ENDING_TYPES))
        emission = np.append(log - np.log10(np.maximum(m.below(), SMOOTH))[classes[:size]], np.zeros(ENDING_TYPES))
        known = np.append(m.n > 0, np.zeros(ENDING_TYPES, bool))
        held: list[tuple] = []
        flat: list[bytes] = []

        def out() -> Iterator[pa.RecordBatch]:
            row, doc_id, train, size_of = zip(*held)
            at = np.fromiter(map(index.__getitem__, flat), np.int64, len(flat))
            length = np.array(size_of)
            starts = np.cumsum(length) - length
            of, looked = classes[at], np.flatnonzero(at >= size)
            seq = of.astype(np.uint8)
            seq[looked] = _LOOKED_UP
            sums = [np.add.reduceat(x[at], starts) for x in (known, base, emission)]
            offsets = np.append(starts, len(flat)).astype(np.int32)
            sequences = pa.Array.from_buffers(pa.binary(), len(held), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(seq.tobytes())])
            texts = [pa.array(row, pa.int64()), pa.array(train, pa.bool_()), pa.array(doc_id, pa.int64()), pa.array(length, pa.int64()), pa.array(sums[0].astype(np.int64)), pa.array(sums[1]), pa.array(sums[2]), sequences]
            yield pa.record_batch(texts + [pa.nulls(len(held), kind) for kind in kinds[8:]], fields)
            if len(looked):
                text = np.repeat(np.arange(len(held)), length)[looked]
                pos = looked - starts[text]
                # a text ends with the end, which is in the index
                before, after = np.where(pos > 0, seq[looked - 1], CLASSES - 1), seq[looked + 1]
                side = [pa.array(np.where(x == _LOOKED_UP, 0, x).astype(np.int8), pa.int8(), mask=x == _LOOKED_UP) for x in (before, after)]
                words_ = pa.array([flat[i] for i in looked.tolist()], pa.binary())
                yield pa.record_batch([pa.array(np.array(row)[text]), pa.array(np.array(train)[text]), *[pa.nulls(len(looked), kind) for kind in kinds[2:8]], pa.array(pos, pa.int32()), words_, pa.array(of[looked], pa.int8()), *side], fields)
            held.clear()
            flat.clear()

        for b in batches:
            for row, doc_id, train, text in zip(*(x.to_pylist() for x in b.columns[:3]), b.columns[3], strict=True):
                t = tokens_of(text.as_py())
                held.append((row, doc_id, train, len(t)))
                flat += t
                if len(flat) >= FEW:
                    yield from out()
        if held:
            yield from out()
        del index
        release_memory()

    return docs.select("row", "doc_id", "train", "text").mapInArrow(run, "row long, train boolean, doc_id long, n_tokens long, n_known long, base double, score double, classes binary, pos int, word binary, class tinyint, before tinyint, after tinyint")


def _pairs(classes: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """Of all texts' sequences the class pairs as numbers, a text's first after an end, -1 where one is not known; and where the texts start."""
    offsets = np.frombuffer(classes.buffers()[1], np.int32)[classes.offset : classes.offset + len(classes) + 1]
    seq = np.frombuffer(classes.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].astype(np.int32)
    starts = offsets[:-1] - offsets[0]
    before = np.concatenate([[0], seq[:-1]])
    before[starts] = CLASSES - 1
    return np.where((before == _LOOKED_UP) | (seq == _LOOKED_UP), -1, before * CLASSES + seq), starts


def count_transitions(texts: DataFrame, looked_up: DataFrame) -> np.ndarray:
    """How often each class follows each in training texts: pairs within the sequences, and those around words that were looked up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CLASSES * CLASSES, np.int64)
        for b in batches:
            if b.num_rows:
                pairs, _ = _pairs(b.column(0))
                total += np.bincount(pairs[pairs >= 0], minlength=CLASSES * CLASSES)
        yield pa.record_batch([pa.array(np.arange(CLASSES * CLASSES)), pa.array(total)], ["pair", "n"])
        release_memory()

    inside = texts.filter("train").select("classes").mapInArrow(run, "pair long, n long")
    train = looked_up.filter("train")
    left = train.groupBy((F.col("before") * CLASSES + F.col("class")).cast("long").alias("pair")).agg(F.count("*").alias("n"))
    right = train.filter("after is not null").groupBy((F.col("class") * CLASSES + F.col("after")).cast("long").alias("pair")).agg(F.count("*").alias("n"))
    out = np.zeros(CLASSES * CLASSES)
    for r in inside.unionAll(left).unionAll(right).groupBy("pair").agg(F.sum("n")).collect():
        out[r[0]] = r[1]
    return out.reshape(CLASSES, CLASSES)


def transitions(between: np.ndarray, class_n: np.ndarray) -> np.ndarray:
    """log10 P(class | class before), smoothed towards the classes' shares."""
    share = (class_n + 1) / (class_n.sum() + CLASSES)
    return np.log10((between + PULL * share[None, :]) / (between.sum(1, keepdims=True) + PULL))


def look_up(parts: DataFrame, words: DataFrame) -> DataFrame:
    """row, train, before, class, after and n of the words of classed that are not in the index; n is 0 for words that no training text holds."""
    found = parts.filter("word is not null").select("row", "train", "pos", "word", F.col("class").alias("guess"), "before", "after").join(words, "word", "left")
    placed = found.select("row", "train", "pos", F.coalesce(F.col("class"), "guess").cast("int").alias("class"), "before", "after", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    by = Window.partitionBy("row").orderBy("pos")  # the neighbour before was looked up as well, so it is the row before
    return placed.select("row", "train", F.coalesce(F.col("before").cast("int"), F.lag("class").over(by)).alias("before"), "class", F.col("after").cast("int").alias("after"), "n")


def score(docs: DataFrame, words: Words) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, base_score and score of every row of docs (doc_id, text)."""
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", (~held_out(F.col("doc_id"))).alias("train"), "text")
    parts = materialize(classed(numbered, words), "lm-parts")
    looked_up = materialize(look_up(parts, words.table), "lm-looked-up")
    texts = parts.filter("word is null").select("row", "train", "doc_id", "n_tokens", "n_known", "base", "score", "classes")
    move = transitions(count_transitions(texts, looked_up), words.class_n)
    flat = move.reshape(-1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps = np.append(flat, 0.0)  # the last, -1, for pairs that are not known here
        for b in batches:
            at = b.schema.get_field_index("classes")
            if b.num_rows:
                pairs, starts = _pairs(b.column(at))
                yield pa.record_batch([*b.columns[:at], pa.array(np.add.reduceat(steps[pairs], starts))], [*b.schema.names[:at], "moved"])
        release_memory()

    inside = texts.mapInArrow(run, "row long, train boolean, doc_id long, n_tokens long, n_known long, base double, score double, moved double")
    step = F.array(*[F.lit(float(x)) for x in flat])
    under = F.array(*[F.lit(float(x)) for x in np.log10(np.maximum(words.below(), SMOOTH))])
    log = F.log10(F.col("n") + F.lit(SMOOTH))
    after = F.when(F.col("after").isNotNull(), F.get(step, F.col("class") * CLASSES + F.col("after"))).otherwise(0.0)
    rest = looked_up.groupBy("row").agg(
        F.sum(log).alias("r_log"),
        F.sum(log - F.get(under, F.col("class")) + F.get(step, F.col("before") * CLASSES + F.col("class")) + after).alias("r_score"),
        F.count("*").alias("r_n"),
        F.count_if(F.col("n") > 0).alias("r_known"),
    )
    below = math.log10(words.train_tokens + SMOOTH * (words.distinct + 1))
    r_log, r_score, r_n, r_known = (F.coalesce(F.col(x), F.lit(0)) for x in ("r_log", "r_score", "r_n", "r_known"))
    return inside.join(rest, "row", "left").select(
        "doc_id", (~F.col("train")).alias("held_out"), "n_tokens", (F.col("n_known") + r_known).alias("n_known"), (F.col("base") + r_log - r_n * F.lit(below)).alias("base_score"), (F.col("score") + F.col("moved") + r_score).alias("score")
    )


def score_documents(docs: DataFrame, sweeps: int = 1) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of docs.

    docs: doc_id and text; other columns are ignored. The rows that are not
    held out are learned from. A null text counts as empty: one token, the
    end. Null ids are held out or not as the empty text. Repeated rows are
    counted and scored as often as they are there. Very long texts cost time
    in proportion. Without training rows all counts are 0; an empty table
    gives no rows. Ties between classes go to the lowest, equally frequent
    words are ordered by their bytes. sweeps: how often the words past the
    types are moved, each time by the classes of the time before.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    train = base.filter(~held_out(F.col("doc_id")))
    words = cluster(train, sweeps)
    return score(base, words).select("doc_id", "held_out", "n_tokens", "n_known", F.lit(words.train_tokens).cast("long").alias("train_tokens"), "base_score", "score")
