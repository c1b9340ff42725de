"""A Brown class-based n-gram language model.

P(text) is the product over its tokens, the words and one end, of
P(class | class before) * P(word | class). The exchange algorithm assigns all
words of the lexicon to classes: the most frequent ones one after the other on
the table of their bigrams, which begins the classes, then every word in sweeps
of parallel exchange by its counts of classes before and after. Words outside
the lexicon share one unit for each shape of spelling, which takes part as well.
All counts cover all training texts. Word counts and the counts of classes
beside words stay distributed; only class tables come together.
"""

from __future__ import annotations

import itertools
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thermalake.llm.common import cut, fold_of, most_counted

#: Parameters: words known to every task, words that begin the classes, classes, rounds of their exchange, sweeps over all words, parts of a sweep.
LEXICON, UNITS, CLASSES, ROUNDS, SWEEPS, PARTS = 1 << 18, 768, 32, 8, 2, 4
SHAPES = 20
#: Places counted in a dense table, ids of a stored row, and codes held by a task at a time.
_HEAD, _RUN, _CODES = 4096, 1 << 17, 1 << 21
_FLUSH = 400_000


def tokens(text: str | None) -> list[bytes]:
    """The words of a text, A-Z lower-cased; the end is not among them."""
    return (text or "").encode().lower().split()


def shape(word: bytes) -> int:
    """A class of spellings: what the word ends in, and how long it is."""
    last = word[-1]
    if last >= 128 or 97 <= last <= 122:
        tail = 0
    elif last == 46:
        tail = 1
    elif last == 44:
        tail = 2
    else:
        tail = 3 if 48 <= last <= 57 else 4
    size = len(word)
    return tail * 4 + (size > 3) + (size > 6) + (size > 10)


class Lookup(dict):
    """Word to place in the lexicon; other words to the places of their shapes behind it."""

    def __missing__(self, word: bytes) -> int:
        return len(self) + shape(word)


def count_words(texts: DataFrame) -> DataFrame:
    """(word binary, n) over all rows of (text)."""
    schema = pa.schema([("word", pa.binary()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def emit() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(held, pa.binary()), pa.array(held.values(), pa.int64())], schema=schema)
            held.clear()
            return out

        for batch in batches:
            for text in batch.column(0).to_pylist():
                held.update(tokens(text))
                if len(held) > _FLUSH:
                    yield emit()
        yield emit()

    return texts.mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def encode(texts: DataFrame, lookup) -> DataFrame:
    """(ids binary): the places of all words of (text) as int32, with -1 before each text and at the end.

    A row continues the one before by repeating its last id, so that each pair of neighbours is in one row.
    """
    schema = pa.schema([("ids", pa.binary())])

    def pack(parts: list[np.ndarray]) -> tuple[pa.RecordBatch, list[np.ndarray]]:
        ids = np.concatenate(parts)
        cuts = range(0, max(len(ids) - 1, 1), _RUN)
        out = pa.RecordBatch.from_arrays([pa.array([ids[i : i + _RUN + 1].tobytes() for i in cuts], pa.binary())], schema=schema)
        return out, [ids[-1:]]

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, end = lookup.value.__getitem__, np.array([-1], np.int32)
        parts, held = [], 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                words = tokens(text)
                parts += [end, np.fromiter(map(place, words), np.int32, len(words))]
                held += len(words) + 1
                if held > _RUN:
                    out, parts = pack(parts)
                    held = 0
                    yield out
        if parts:
            yield pack([*parts, end])[0]

    return texts.mapInArrow(places, "ids binary")


def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All ids but the last and all but the first of each row of (ids)."""
    for batch in batches:
        for ids in batch.column(0):
            ids = np.frombuffer(ids.as_buffer(), np.int32)
            yield ids[:-1], ids[1:]


def count_unit_pairs(encoded: DataFrame, units: np.ndarray, n_units: int) -> np.ndarray:
    """How often unit b follows unit a, over all rows of (ids); unit 0 is the end, and stands before every text."""
    schema = pa.schema([("code", pa.int32()), ("n", pa.int64())])
    units = np.r_[units, 0].astype(np.int32)  # the end's id is -1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(n_units * n_units, np.int64)
        for before, after in neighbours(batches):
            codes = units[before] * n_units + units[after]
            if len(codes) > 50_000:
                table += np.bincount(codes, minlength=len(table))
            else:
                np.add.at(table, codes, 1)
        seen = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(table[seen])], schema=schema)

    counted = encoded.mapInArrow(count, "code int, n long").groupBy("code").agg(F.sum("n").alias("n")).toPandas()
    table = np.zeros(n_units * n_units, np.int64)
    table[counted["code"].to_numpy(np.int64)] = counted["n"].to_numpy(np.int64)
    return table.reshape(n_units, n_units)


def count_beside(encoded: DataFrame, classes: np.ndarray, n_classes: int, part: int) -> DataFrame:
    """(code, n): how often each place of one part of PARTS has each class before it, each class after it, and itself after it.

    code is place * (2 * n_classes + 1) + the class, n_classes + the class, or 2 * n_classes.
    """
    schema = pa.schema([("code", pa.int64()), ("n", pa.int64())])
    width, parts, flush = 2 * n_classes + 1, PARTS, _CODES
    own = np.r_[np.arange(len(classes)) % parts == part, False]
    classes = np.r_[classes, 0].astype(np.int16)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, rest, held = np.zeros(_HEAD * width, np.int64), [], 0

        def emit() -> pa.RecordBatch:
            seen, n = np.unique(np.concatenate(rest), return_counts=True)
            rest.clear()
            return pa.RecordBatch.from_arrays([pa.array(seen), pa.array(n.astype(np.int64))], schema=schema)

        for before, after in neighbours(batches):
            first, second = np.flatnonzero(own[before]), np.flatnonzero(own[after])
            twice = first[before[first] == after[first]]
            codes = np.concatenate([
                after[second].astype(np.int64) * width + classes[before[second]],
                before[first].astype(np.int64) * width + n_classes + classes[after[first]],
                before[twice].astype(np.int64) * width + 2 * n_classes,
            ])
            frequent = codes < len(head)
            np.add.at(head, codes[frequent], 1)
            rest.append(codes[~frequent])
            held += len(rest[-1])
            if held > flush:
                held = 0
                yield emit()
        if rest:
            yield emit()
        seen = np.flatnonzero(head)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(head[seen])], schema=schema)

    return encoded.mapInArrow(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def best_classes(beside: np.ndarray, own: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The best class of each unit while all others stay: rows of counts as of `count_beside`, the units' classes, the class bigrams."""
    xlogx = lambda x: x * np.log(np.maximum(x, 1.0))
    n_classes, at = len(table), np.arange(len(own))
    column, row, self_ = beside[:, :n_classes].copy(), beside[:, n_classes : 2 * n_classes].copy(), beside[:, 2 * n_classes :]
    row[at, own] -= self_[:, 0]
    column[at, own] -= self_[:, 0]
    rest = np.repeat(table[None], len(own), 0)
    rest[at, own] -= row
    rest[at, :, own] -= column
    rest[at, own, own] -= self_[:, 0]
    left, right, now = rest.sum(2) + column, rest.sum(1) + row, xlogx(rest)
    diagonal = lambda x: np.diagonal(x, axis1=1, axis2=2)
    gain_row = xlogx(rest + row[:, None, :]) - now
    gain_column = xlogx(rest + column[:, :, None]) - now
    gain = gain_row.sum(2) - diagonal(gain_row) + gain_column.sum(1) - diagonal(gain_column)
    gain += xlogx(diagonal(rest) + row + column + self_) - diagonal(now)
    gain -= xlogx(left + row.sum(1, keepdims=True) + self_) - xlogx(left)
    gain -= xlogx(right + column.sum(1, keepdims=True) + self_) - xlogx(right)
    gain[:, 0] = -np.inf
    new = gain.argmax(1)
    return np.where(gain[at, new] > gain[at, own] + 1e-9, new, own)


def level(table: np.ndarray) -> float:
    """The part of the log likelihood that depends on the classes, from the class bigrams."""
    xlogx = lambda x: x * np.log(np.maximum(x, 1.0))
    return float(xlogx(table).sum() - xlogx(table.sum(1)).sum() - xlogx(table.sum(0)).sum())


def sweep(encoded: DataFrame, classes: np.ndarray, table: np.ndarray, sweeps: int) -> tuple[np.ndarray, np.ndarray]:
    """Classes by place and class bigrams after sweeps of exchange over all places.

    A sweep has PARTS steps, in each of which the words of one part name their
    best classes beside the present ones of all. These moves are made if they
    raise the likelihood together, else every other one if that does. A sweep
    without moves is the last.
    """
    n_classes = len(table)
    width, n_blocks = 2 * n_classes + 1, -(-len(classes) // (512 * PARTS))
    schema = pa.schema([("place", pa.int32()), ("class", pa.int32())])

    def chooser(classes: np.ndarray, table: np.ndarray):
        def choose(group: pa.Table) -> pa.Table:
            code, n = group.column("code").to_numpy(), group.column("n").to_numpy()
            places, at = np.unique(code // width, return_inverse=True)
            beside = np.zeros((len(places), width))
            beside[at, code % width] = n
            own = classes[places]
            new = np.concatenate([best_classes(beside[i : i + 64], own[i : i + 64], table) for i in range(0, len(places), 64)])
            moved = new != own
            return pa.Table.from_arrays([pa.array(places[moved], pa.int32()), pa.array(new[moved], pa.int32())], schema=schema)

        return choose

    for turn in range(sweeps):
        any_moved = False
        for part in range(PARTS):
            counts = count_beside(encoded, classes, n_classes, part)
            block = F.floor(F.col("code") / (width * PARTS)).cast("int") % n_blocks
            moves = counts.groupBy(block.alias("block")).applyInArrow(chooser(classes, table), "place int, class int").toPandas()
            place, new = moves["place"].to_numpy(np.int64), moves["class"].to_numpy(np.int64)
            for chosen in (np.ones(len(place), bool), place // PARTS % 2 == turn % 2):
                if not chosen.any():
                    break
                after = classes.copy()
                after[place[chosen]] = new[chosen]
                found = count_unit_pairs(encoded, after, n_classes).astype(np.float64)
                if level(found) > level(table) + 1e-9:
                    classes, table, any_moved = after, found, True
                    break
        if not any_moved:
            break
    return classes, table


def exchange(pairs: np.ndarray, n_classes: int, rounds: int) -> np.ndarray:
    """The class of each unit by the exchange algorithm; unit 0 keeps class 0 for itself.

    The most frequent units begin a class each, the others enter one by one.
    Then each unit in turn moves to the class that makes the class bigram
    likelihood of the counts the largest, until a round moves none.
    """
    xlogx = lambda x: x * np.log(np.maximum(x, 1.0))
    pairs = pairs.astype(np.float64)
    n_units = len(pairs)
    order = np.argsort(-(pairs.sum(0) + pairs.sum(1))[1:], kind="stable") + 1
    classes = np.full(n_units, -1)
    classes[0], classes[order[: n_classes - 1]] = 0, np.arange(1, min(n_classes, n_units))
    member = np.eye(n_classes)[classes] * (classes >= 0)[:, None]
    table = member.T @ pairs @ member
    for _ in range(rounds + 1):
        moved = 0
        for u in order:
            row, column, self_ = pairs[u] @ member, pairs[:, u] @ member, pairs[u, u]
            old = classes[u]
            if old >= 0:
                row[old] -= self_
                column[old] -= self_
                table[old] -= row
                table[:, old] -= column
                table[old, old] -= self_
            left, right = table.sum(1) + column, table.sum(0) + row
            now = xlogx(table)
            gain_row = xlogx(table + row[None, :]) - now
            gain_column = xlogx(table + column[:, None]) - now
            diagonal = np.diagonal(table)
            gain = gain_row.sum(1) - np.diagonal(gain_row) + gain_column.sum(0) - np.diagonal(gain_column)
            gain += xlogx(diagonal + row + column + self_) - np.diagonal(now)
            gain -= xlogx(left + row.sum() + self_) - xlogx(left)
            gain -= xlogx(right + column.sum() + self_) - xlogx(right)
            gain[0] = -np.inf
            new = int(gain.argmax())
            if old >= 0 and gain[new] <= gain[old] + 1e-9:
                new = old
            table[new] += row
            table[:, new] += column
            table[new, new] += self_
            if new != old:
                moved += 1
                member[u] = 0.0
                member[u, new], classes[u] = 1.0, new
        if not moved:
            break
    return classes


@dataclass
class Model:
    lookup: object  # broadcast Lookup
    log_count: np.ndarray  # log10(n + 0.5) by place; 0 for shapes
    place_class: np.ndarray
    transition: np.ndarray  # log10, from row to column
    emission: np.ndarray  # log10 of the denominator of P(word | class)
    vocabulary: DataFrame  # (word, n) of the words that are not in the lookup
    n_tokens: int
    n_types: int
    n_texts: int


def learn(texts: DataFrame, lexicon: int = LEXICON, units: int = UNITS, n_classes: int = CLASSES, rounds: int = ROUNDS, sweeps: int = SWEEPS) -> Model:
    """The model of all rows of (text); null texts count as empty, and an empty table gives a uniform model."""
    spark = texts.sparkSession
    texts = texts.select("text")
    # the lexicon has the most frequent words; of those that tie at its bound a hash of the word chooses
    vocabulary = cut(most_counted(count_words(texts), [], "word", "n", lexicon))
    n_texts = texts.count()
    size = vocabulary.agg(F.count("*").alias("types"), F.coalesce(F.sum("n"), F.lit(0)).alias("total")).first()
    known = sorted(((r.n, bytes(r.word)) for r in vocabulary.filter("chosen").collect()), key=lambda r: (-r[0], r[1]))
    lookup = spark.sparkContext.broadcast(Lookup({w: i for i, (_, w) in enumerate(known)}))

    own = min(units, len(known))
    n_units = 1 + own + SHAPES
    by_shape = np.array([shape(w) for _, w in known] + list(range(SHAPES)), np.int64)
    unit = 1 + own + by_shape  # by place in the lookup
    unit[:own] = 1 + np.arange(own)
    encoded = cut(encode(texts, lookup))
    pairs = count_unit_pairs(encoded, unit, n_units)
    classes = exchange(pairs, n_classes, rounds)
    member = np.eye(n_classes)[classes]
    table, place_class = member.T @ pairs @ member, classes[unit]
    if own < len(known):
        place_class, table = sweep(encoded, place_class, table, sweeps)

    # distinct words of each class: the lexicon's own, and those that stayed distributed by shape
    types = np.bincount(place_class[: len(known)], minlength=n_classes).astype(np.float64)
    rest = vocabulary.filter("NOT chosen").drop("chosen")
    schema = pa.schema([("shape", pa.int32())])

    def shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([shape(w) for w in batch.column(0).to_pylist()], pa.int32())
            yield pa.RecordBatch.from_arrays([found], schema=schema)

    for r in rest.select("word").mapInArrow(shapes, "shape int").groupBy("shape").count().collect():
        types[place_class[len(known) + r["shape"]]] += r["count"]

    share = (table.sum(0) + 0.5) / (table.sum() + 0.5 * n_classes)
    transition = (table + n_classes * share[None, :]) / (table.sum(1) + n_classes)[:, None]
    emission = np.log10(table.sum(0) + 0.5 * (types + 1))
    emission[0] = 0.0  # the end is all of its class
    return Model(
        lookup,
        np.r_[np.log10(np.array([n for n, _ in known], np.float64) + 0.5), np.zeros(SHAPES)],
        place_class,
        np.log10(transition),
        emission,
        rest,
        size.total + n_texts,
        size.types + (n_texts > 0),
        n_texts,
    )


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score) per input row; scores are log10 probabilities.

    base_score is the unigram model's, score the class model's. Words of the
    lookup are scored where the text is; the others travel, once per text and
    word, to their counts. Null and empty texts consist of one end. Repeated
    rows and null ids are rows like others; extra columns are not read.
    """
    fields = [
        ("row", pa.int64()),
        ("doc_id", pa.int64()),
        ("word", pa.binary()),
        ("n", pa.int64()),
        ("n_tokens", pa.int64()),
        ("n_known", pa.int64()),
        ("log_count", pa.float64()),
        ("rest", pa.float64()),
    ]
    schema = pa.schema(fields)
    lookup, log_count, place_class = model.lookup, model.log_count, model.place_class.astype(np.int32)
    transition, emission = model.transition, model.emission

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        place, n_lexicon = lookup.value.__getitem__, len(lookup.value)
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = tokens(text)
                places = np.fromiter(map(place, words), np.int32, len(words))
                classes = np.r_[0, place_class[places], 0]
                rest = transition[classes[:-1], classes[1:]].sum() - emission[classes].sum()
                rare = np.flatnonzero(places >= n_lexicon).tolist()
                known = len(words) - len(rare)
                # a blank makes a key that no word has, and the number deals these rows out
                key = b" %d" % row
                yield row, doc_id, key, 0, len(words) + 1, known, float(log_count[places].sum()), float(rest)
                for word, n in Counter([words[i] for i in rare]).items():
                    yield row, None, word, n, 0, 0, 0.0, 0.0
                row += 1

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = local(batches)
        while chunk := list(itertools.islice(found, 20_000)):
            columns = [pa.array(v, f.type) for v, f in zip(zip(*chunk, strict=True), schema, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    sent = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        emit,
        "row long, doc_id long, word binary, n long, n_tokens long, n_known long, log_count double, rest double",
    )
    counts = model.vocabulary.select(F.col("word").alias("_word"), F.col("n").alias("c"))
    met = sent.join(counts, F.col("word") == F.col("_word"), "left")
    sums = met.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"),
        F.sum("n_tokens").alias("n_tokens"),
        F.sum(F.col("n_known") + F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0)).alias("n_known"),
        F.sum(F.col("log_count") + F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("log_count"),
        F.sum("rest").alias("rest"),
    )
    end = float(np.log10(model.n_texts + 0.5))
    total = float(np.log10(model.n_tokens + 0.5 * (model.n_types + 1)))
    return sums.select(
        "doc_id",
        "n_tokens",
        (F.col("n_known") + F.lit(int(model.n_texts > 0))).alias("n_known"),
        (F.col("log_count") + F.lit(end) - F.col("n_tokens") * F.lit(total)).alias("base_score"),
        (F.col("log_count") + F.col("rest")).alias("score"),
    )


def held_out_scores(docs: DataFrame, folds: int = 5, held_out: int = 1) -> DataFrame:
    """Scores of all rows by a model of those outside one fold of the ids."""
    out = fold_of("doc_id", folds) == held_out
    model = learn(docs.filter(~out))
    return score(docs, model).select(
        "doc_id",
        out.alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(model.n_tokens).cast("long").alias("train_tokens"),
        "base_score",
        "score",
    )
