"""Language identification by words with backoff to character n-grams.

A word that any language's lexicon knows scores its log relative frequency per
language. An unseen word falls back to the longest character n-grams of it that
the model knows, then to shorter ones. A text's score is the mean over its
words, at a scale fitted to labelled texts that were kept out. The number of
labelled texts per language and the size of the model are parameters; the
number of languages is not limited.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thermalake.llm.common import carried, cut, discard, most_counted, stored

UNKNOWN = "und"
_RUN = re.compile(r"[^\W\d_]+")
_FLUSH = 200_000
_MEMO, _MEMO_CELLS = 400_000, 16_000_000
_MEMO_CHARS = 48  # longer words are not remembered
_TEXTS = -1  # the size of entries that count texts
_RARE = 0.01  # a language is written in the letters of at least this share of its texts, so that few texts with a wrong label add none
_UNSEEN = 0.25  # less than one occurrence, for languages in which an entry was not seen
#: Scales of the mean log score that are tried on kept-out texts.
SLOPES = np.geomspace(0.25, 256.0, 41)


def letters(text: str) -> list[str]:
    """The runs of letters (Unicode category L) of a text, in lower case."""
    runs = _RUN.findall(text.lower())
    if "".join(runs).isalpha():
        return runs
    # digits of other scripts and number signs lie in these runs as well
    return [w for run in runs for w in "".join(c if c.isalpha() else " " for c in run).split(" ") if w]


@dataclass
class Table:
    """Sparse scores of entries: `base` per language, and per entry the languages that differ from it, by how much."""

    at: dict[str, int]
    start: np.ndarray
    lang: np.ndarray
    above: np.ndarray
    base: np.ndarray

    @classmethod
    def of(cls, rows: dict[str, np.ndarray], n_langs: int) -> Table:
        """From dense rows by entry."""
        dense = np.array(list(rows.values()), np.float32).reshape(len(rows), n_langs)
        entry, lang = np.nonzero(dense)
        start = np.searchsorted(entry, np.arange(len(rows) + 1))
        return cls({g: i for i, g in enumerate(rows)}, start, lang, dense[entry, lang], np.zeros(n_langs, np.float32))

    def sums(self, entries: np.ndarray, owner: np.ndarray, n_owners: int) -> np.ndarray:
        """Per owner and language the sum of what its entries have above the base."""
        first, counts = self.start[entries], self.start[entries + 1] - self.start[entries]
        places = np.repeat(first - np.r_[0, np.cumsum(counts)[:-1]], counts) + np.arange(counts.sum())
        cells = np.repeat(owner, counts) * len(self.base) + self.lang[places]
        return np.bincount(cells, self.above[places], n_owners * len(self.base)).reshape(n_owners, -1)


class _Places(dict):
    """Words to rows of the table of scores; words met for the first time are listed in `fresh`, long ones are not held."""

    def __init__(self):
        super().__init__()
        self.used, self.fresh = 0, []

    def __missing__(self, word: str) -> int:
        at = self.used
        self.used += 1
        self.fresh.append(word)
        if len(word) <= _MEMO_CHARS:
            self[word] = at
        return at


@dataclass
class Lexicon:
    """Scores per language of words (size 0) and of padded n-grams by size, and the scale of a text's mean score."""

    langs: list[str]
    longest: int
    grams: dict[int, Table]
    slope: float = 30.0
    memo: _Places = field(default_factory=_Places)
    table: np.ndarray | None = None
    alphabets: dict[str, set[str]] = field(default_factory=dict)

    def words(self, words: list[str]) -> np.ndarray:
        """Log10 relative frequencies of known words, and for others the mean of their longest known n-grams (words x languages)."""
        out = np.zeros((len(words), len(self.langs)))
        own = self.grams[0]
        open_ = []
        known, who = [], []
        for i, word in enumerate(words):
            at = own.at.get(word)
            if at is None:
                open_.append((i, f"<{word}>"))
            else:
                known.append(at)
                who.append(i)
        if known:
            out += own.sums(np.array(known), np.array(who), len(words))
            out[who] += own.base
        for size in range(self.longest, 0, -1):
            table, missed, found, who = self.grams[size], [], [], []
            get = table.at.get
            for i, padded in open_:
                hits = [at for k in range(len(padded) - size + 1) if (at := get(padded[k : k + size])) is not None]
                if hits:
                    found += hits
                    who.append((i, len(hits)))
                else:
                    missed.append((i, padded))
            if found:
                owner, n = np.array(who).T
                sums = table.sums(np.array(found), np.repeat(np.arange(len(n)), n), len(n))
                out[owner] = table.base + sums / n[:, None]
            open_ = missed
            if not open_:
                break
        return out

    def mean(self, text: str) -> np.ndarray | None:
        """The mean score per language over the words of a text; None without letters, or if there are no languages."""
        words = letters(text)
        if not words or not self.langs:
            return None
        if self.table is None:
            self.table = np.empty((max(64, min(_MEMO, _MEMO_CELLS // len(self.langs))), len(self.langs)), np.float32)
        memo, total = self.memo, np.zeros(len(self.langs))
        step, at_once = max(1, (1 << 20) // len(self.langs)), len(self.table) // 4
        for at in range(0, len(words), at_once):
            part = words[at : at + at_once]
            if memo.used + len(part) > len(self.table):
                memo.clear()
                memo.used = 0
            places = np.fromiter(map(memo.__getitem__, part), np.int64, len(part))
            if memo.fresh:
                first = memo.used - len(memo.fresh)
                for k in range(0, len(memo.fresh), step):
                    some = memo.fresh[k : k + step]
                    self.table[first + k : first + k + len(some)] = self.words(some)
                memo.fresh = []
            for k in range(0, len(places), step):
                total += self.table[places[k : k + step]].sum(0, dtype=np.float64)
        return total / len(words)

    def text(self, text: str) -> tuple[str, float]:
        """The best language and its probability among all; ties go to the first by name."""
        mean = self.mean(text)
        if mean is None:
            return UNKNOWN, 0.0
        share = np.exp((mean - mean.max()) * self.slope)
        share /= share.sum()
        best = int(share.argmax())
        return self.langs[best], float(share[best])

    def written(self, text: str, lang: str) -> bool:
        """Whether at least half of the letters of a text are ones that a language is written in; true where these aren't known."""
        if lang not in self.alphabets:
            return True
        known, low = self.alphabets[lang], text.lower()
        strange = [c for c in set(low) if c.isalpha() and c not in known]
        if not strange:
            return True
        counts = Counter(low)
        return 2 * sum(counts[c] for c in strange) <= sum(n for c, n in counts.items() if c.isalpha())


def labelled_sample(docs: DataFrame, per_language: int) -> DataFrame:
    """(text, lang, kept_out): at most about `per_language` rows of each language, by a hash of the id and the text.

    One of ten rows is kept out of the counts. All labelled rows of a language
    with fewer are taken.
    """
    draw = lambda salt: F.pmod(F.xxhash64("doc_id", "text", F.lit(salt)), F.lit(1 << 40)) / float(1 << 40)
    named = docs.select("doc_id", "text", "lang").filter("lang IS NOT NULL AND text IS NOT NULL")
    share, path = stored(named.groupBy(F.col("lang").alias("_lang")).agg((F.lit(float(per_language)) / F.count("*")).alias("_share")))
    drawn = named.select("text", "lang", draw(8).alias("_draw"), (draw(9) < 0.1).alias("kept_out"))
    # one row per language; Spark knows the table's size and sends it to the texts if it is small
    met = drawn.join(share, F.col("lang") == F.col("_lang")).filter(F.col("_draw") < F.col("_share"))
    sample = cut(met.select("text", "lang", "kept_out"))
    discard(docs.sparkSession, path)
    return sample


def _count(longest: int):
    schema = pa.schema([("lang", pa.string()), ("size", pa.int32()), ("gram", pa.string()), ("n", pa.int64())])

    def emit(counts: dict) -> pa.RecordBatch:
        rows = [(lang, size, gram, n) for (lang, size), c in counts.items() for gram, n in c.items()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict = defaultdict(Counter)
        for batch in batches:
            for text, lang in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = Counter(letters(text))
                if words:  # texts by letter, and all of them
                    counts[lang, _TEXTS].update({"", *"".join(words)})
                for word, n in words.items():
                    counts[lang, 0][word] += n
                    padded = f"<{word}>"
                    for size in range(1, longest + 1):
                        table = counts[lang, size]
                        for i in range(len(padded) - size + 1):
                            table[padded[i : i + size]] += n
                if sum(map(len, counts.values())) > _FLUSH:
                    yield emit(counts)
                    counts.clear()
        yield emit(counts)

    return count


def assemble(best: Iterable[pa.RecordBatch], longest: int) -> Lexicon:
    """The lexicon of batches (lang, size, gram, n, total), which are folded one by one."""
    at: dict[str, int] = {}
    parts = {size: ({}, [], [], [], {}) for size in range(longest + 1)}
    texts: dict[str, dict[str, int]] = defaultdict(dict)
    for batch in best:
        named = batch.column(0).to_pylist()
        langs = [at.setdefault(x, len(at)) for x in named]
        rest = (batch.column(i).to_pylist() for i in (1, 2, 3, 4))
        for name, lang, size, gram, n, total in zip(named, langs, *rest, strict=True):
            if size == _TEXTS:
                texts[name][gram] = n
                continue
            grams, entry, owner, counts, totals = parts[size]
            entry.append(grams.setdefault(gram, len(grams)))
            owner.append(lang)
            counts.append(n)
            totals[lang] = total
    names = sorted(at)
    rank = np.empty(len(names), np.int64)
    rank[[at[n] for n in names]] = np.arange(len(names))
    tables = {}
    for size, (grams, entry, owner, counts, totals) in parts.items():
        total = np.ones(len(names))
        total[rank[list(totals)]] = list(totals.values())
        entry, lang = np.array(entry, np.int64), rank[np.array(owner, np.int64)]
        order = np.lexsort((lang, entry))
        start = np.searchsorted(entry[order], np.arange(len(grams) + 1))
        above = np.log10(np.array(counts, np.float64)[order] / _UNSEEN).astype(np.float32)
        tables[size] = Table(grams, start, lang[order].astype(np.int32), above, np.log10(_UNSEEN / total).astype(np.float32))
    alphabets = {name: {g for g, n in held.items() if g and n >= _RARE * held[""]} for name, held in texts.items() if "" in held}
    return Lexicon(names, longest, tables, alphabets=alphabets)


def fit_slope(sample: DataFrame, model: Lexicon, smooth: float = 1e-4) -> float:
    """The scale under which kept-out rows (text, lang) are likeliest, less a little for large ones; 30 without such rows."""
    shared = sample.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("at", pa.int32()), ("n", pa.int64()), ("level", pa.float64())])

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, level, n = shared.value, np.zeros(len(SLOPES)), 0
        place = {lang: i for i, lang in enumerate(own.langs)}
        for batch in batches:
            for text, lang in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                mean = own.mean(text)
                if mean is not None and lang in place:
                    odds = (mean - mean[place[lang]])[:, None] * SLOPES
                    top = odds.max(0)
                    level -= top + np.log(np.exp(odds - top).sum(0))
                    n += 1
        yield pa.RecordBatch.from_arrays([pa.array(range(len(SLOPES)), pa.int32()), pa.array([n] * len(SLOPES)), pa.array(level)], schema=schema)

    rows = sample.select("text", "lang").mapInArrow(rate, "at int, n long, level double").groupBy("at").agg(F.sum("n").alias("n"), F.sum("level").alias("level")).collect()
    held = {r["at"]: r.level - smooth * r.n * SLOPES[r["at"]] for r in rows if r.n}
    return float(SLOPES[max(held, key=lambda k: (held[k], -k))]) if held else 30.0


def learn(docs: DataFrame, per_language: int = 1000, entries: int = 20_000, model_entries: int = 1_500_000, longest: int = 4) -> Lexicon:
    """A model from rows (doc_id, text, lang); rows without a text or a label are passed over.

    `per_language` bounds the labelled texts used of each language, in
    expectation. `entries` bounds the words and the n-grams of each size kept
    per language, and `model_entries` those of all languages together, so that
    the model can be sent to every task however many languages there are: of
    each table the largest counts stay, and of those that tie at the bound as
    many as fill it, chosen by a hash of the entry; so the bounds hold in expectation.
    An empty table, or one without labels, gives a model without languages.
    Other columns are not read.
    """
    sample = labelled_sample(docs, per_language)
    counted = cut(
        sample.filter("NOT kept_out")
        .select("text", "lang")
        .mapInArrow(_count(longest), "lang string, size int, gram string, n long")
        .groupBy("lang", "size", "gram")
        .agg(F.sum("n").alias("n"))
    )
    n_langs = counted.select("lang").distinct().count()
    room = max(1, min(entries, model_entries // max(1, n_langs * (longest + 1))))
    totals = counted.groupBy("lang", "size").agg(F.sum("n").alias("total"))
    best = most_counted(counted, ["lang", "size"], "gram", "n", room).filter("chosen").join(totals, ["lang", "size"])
    best = best.select("lang", "size", "gram", "n", "total")
    # about model_entries rows, in columns
    model = assemble(best.toArrow().to_batches(), longest)
    model.slope = fit_slope(sample.filter("kept_out"), model)
    return model


def predict(docs: DataFrame, model: Lexicon) -> DataFrame:
    """(doc_id, lang_pred, score) per input row, from the text alone.

    Null texts and texts without letters are `und` with score 0, as are all
    texts if nothing could be learned. score is the posterior probability of
    the predicted language under equal priors. A text of any length is scored
    whole, in bounded memory. Repeated rows and null ids are rows like others;
    extra columns are not read; an empty table gives an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            found = [own.text(t or "") for t in batch.column(1).to_pylist()]
            columns = [batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(score, "doc_id long, lang_pred string, score double")


def accept(docs: DataFrame, model: Lexicon, least: float = 0.3, sure: float = 0.95) -> DataFrame:
    """The input rows and columns whose text is in a language, with that language in `lang`.

    A text is in its best language if at least half of its letters are ones
    that the language is written in, and its score is at least `least`, or 0.9
    divided by the number of languages if that is less. The label of a row
    stands unless it is missing, or a text in another language has a score of
    at least `sure`. If nothing could be learned, all texts with letters are
    kept as they are. Null and empty texts and those without letters go; of
    repeated rows each is judged alike; ids and extra columns are carried along
    and never read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    floor = min(least, 0.9 / max(1, len(model.langs)))

    def judged(text: str, label: str | None) -> tuple[bool, str | None]:
        own = shared.value
        if not own.langs:
            return bool(letters(text)), label
        lang, score = own.text(text)
        kept = lang != UNKNOWN and score >= floor and own.written(text, lang)
        return kept, lang if label is None or score >= sure else label

    @F.pandas_udf("kept boolean, lang string")
    def judge(texts: pd.Series, labels: pd.Series) -> pd.DataFrame:
        found = [judged(t or "", x) for t, x in zip(texts, labels, strict=True)]
        return pd.DataFrame({"kept": pd.Series([k for k, _ in found], dtype=bool), "lang": pd.Series([x for _, x in found], dtype=object)})

    # nondeterministic, so that the filter isn't moved below and texts are judged once
    found = carried(docs, _found=judge.asNondeterministic()(F.col("text"), F.col("lang").cast("string")))
    return found.filter("_found.kept").select(F.col("row").withField("lang", F.col("_found.lang")).alias("row")).select("row.*")
