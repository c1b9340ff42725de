"""Sum-of-squares packing of token sequences.

Each task packs the documents of its own scan split online. An array holds the
number of open windows at every fill level; the next remainder goes to the
level where it lowers the sum of the squared counts most. At the end of a split
the emptiest windows are cut up to fill the fullest, and what is left becomes
windows whose sizes are powers of two, which need no padding. The memory of a
task is bounded by the number of open windows, far above what splits reach:
past it, the window that lacks the fewest tokens is filled from the emptiest
one, and all others stay open.
"""

from __future__ import annotations

import functools
import itertools
import json
import os
import re
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PIECES = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("start", pa.int64()),
        ("length", pa.int64()),
        ("ids", pa.binary()),
        ("doc_tokens", pa.int64()),
        ("sequence_id", pa.int64()),
        ("offset", pa.int64()),
    ]
)


class _Known(dict):
    """Values by text, found on first use; long texts are never held, and all are forgotten when there are too many."""

    LONGEST = 48

    def __init__(self, find: Callable, most: int):
        super().__init__()
        self.find, self.most = find, most

    def __missing__(self, key):
        value = self.find(key)
        if len(key) <= self.LONGEST:
            if len(self) >= self.most:
                self.clear()
            self[key] = value
        return value


@functools.cache
def _byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: itself if it prints, else the next from U+0100 on."""
    letters, spare = {}, 256
    for byte in range(256):
        if 33 <= byte <= 126 or 161 <= byte <= 172 or byte >= 174:
            letters[byte] = chr(byte)
        else:
            letters[byte], spare = chr(spare), spare + 1
    return letters


def _ranked_merges(inner, own: dict):
    """A `tiktoken` encoding that is proven to give the ids of this byte-level file, or None.

    `tiktoken` joins neighbours whenever the two together are a token, the
    lowest id first; `tokenizers` joins the listed pairs, the first listed
    first. If every token is a byte or comes of one pair, ids rise in the order
    of the pairs, and each token's own text is encoded to that token alone,
    both are the same: neighbours arise by merges within their own text, as if
    it stood alone, and there only the listed pair makes the token.
    """
    try:
        import tiktoken
    except ImportError:
        return None
    model, bytes_of = own["model"], {letter: byte for byte, letter in _byte_letters().items()}
    plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix"))
    if not plain or own.get("truncation") or own.get("padding"):
        return None
    vocab = model["vocab"]
    made = ["".join(pair) for pair in model["merges"]]
    if vocab.keys() != bytes_of.keys() | set(made) or len(vocab) != len(bytes_of) + len(made):
        return None
    if any(vocab[a] >= vocab[b] for a, b in itertools.pairwise(made)):
        return None
    if any([t.id for t in inner.model.tokenize(token)] != [i] for token, i in vocab.items()):
        return None
    ranks = {bytes(map(bytes_of.__getitem__, token)): i for token, i in vocab.items()}
    words = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+"
    return tiktoken.Encoding("byte_level", pat_str=words, mergeable_ranks=ranks, special_tokens={})


class WordCachedTokenizer:
    """Ids of texts by a `tokenizers` file, as bytes of little-endian 32-bit ids.

    Texts go whole through the file's merges in `tiktoken` where that is proven
    to give the same ids; nothing is kept then. Of more than one blank before a
    word, the pre-tokenizer leaves the last one to the word, so texts are cut
    there. Texts that name an added token go whole to `tokenizers`.

    Where `tiktoken` is missing or not proven, the ids of " word" are kept,
    since a byte-level pre-tokenizer never joins what stands on the two sides
    of a single space between non-blank characters. A word not met before is
    put together from its letters and its punctuation, which are encoded once
    each. Tokenizers of other kinds see whole texts.
    """

    _BLANK = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"  # all that \s is in the pre-tokenizer
    _TWO_BLANKS = re.compile(f"[{_BLANK}][{_BLANK}]")
    _LAST_OF_BLANKS = re.compile(f"(?<=[{_BLANK}])(?=[{_BLANK}][^{_BLANK}])")
    _INNER_SPACE = re.compile(r"(?<=\S) (?=\S)")
    _ODD_SPACE = re.compile(r"\s\s|\s$|^\s")
    _INNER_BLANK = re.compile(r"[^\S\n]")
    _TAILED = re.compile(r"( ?[A-Za-zÀ-ÖØ-öø-ɏ]+)([!-&(-/:-@\[-`{-~][!-/:-@\[-`{-~]*)?")

    def __init__(self, path: str, max_words: int = 800_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.inner = Tokenizer.from_file(path)
        own = json.loads(self.inner.to_str())
        pre = own.get("pre_tokenizer") or {}
        self.by_word = (
            pre.get("type") == "ByteLevel"
            and pre.get("use_regex", True)
            and not pre.get("add_prefix_space")
            and not own.get("normalizer")
        )
        self.added = [token["content"] for token in own.get("added_tokens") or []]
        self.ranked = _ranked_merges(self.inner, own) if self.by_word else None
        self.parts = _Known(self._merge, max_words)
        self.first = _Known(self._join, 10_000)
        self.later = _Known(lambda word: self._join(" " + word), max_words * 3 // 2)

    def _encode(self, text: str) -> bytes:
        ids = self.inner.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def _encode_ranked(self, text: str) -> bytes:
        if any(token in text for token in self.added):
            return self._encode(text)
        cuts = self._LAST_OF_BLANKS.split(text) if self._TWO_BLANKS.search(text) else [text]
        return b"".join(self.ranked.encode_to_numpy(cut, disallowed_special=()).astype("<u4", copy=False).tobytes() for cut in cuts)

    def _merge(self, part: str) -> bytes:
        """Ids of what the pre-tokenizer leaves in one piece, by the tokenizer's merges alone."""
        ids = [t.id for t in self.inner.model.tokenize(part.encode().decode("latin-1").translate(_byte_letters()))]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _join(self, word: str) -> bytes:
        """Ids from pieces that the pre-tokenizer never joins: letters, the punctuation after them, single line ends."""
        lines = word.split("\n")
        if self._INNER_BLANK.search(word, 1) or "" in lines:
            return self._encode(word)
        found = []
        for line in lines:
            if tailed := self._TAILED.fullmatch(line):
                letters, tail = tailed.groups()
                found.append(self.parts[letters] + (self.parts[tail] if tail else b""))
            else:
                found.append(self._encode(line))
        return self.parts["\n"].join(found)

    def encode(self, text: str) -> bytes:
        if not self.by_word:
            return self._encode(text)
        if self.ranked is not None:
            return self._encode_ranked(text)
        words = iter(self._INNER_SPACE.split(text) if self._ODD_SPACE.search(text) else text.split(" "))
        return self.first[next(words)] + b"".join(map(self.later.__getitem__, words))


@functools.lru_cache(maxsize=1)
def _coder(path: str, max_words: int) -> WordCachedTokenizer:
    """The tokenizer of a worker process, made once for all tasks that the process runs."""
    return WordCachedTokenizer(path, max_words)


class SumOfSquares:
    """Windows of one task. Pieces are (doc_id, start, ids, doc_tokens); closed windows are lists of pieces."""

    def __init__(self, size: int, max_open: int):
        self.size, self.max_open = size, max_open
        self.level = np.zeros(size + 1, np.int64)  # open windows by fill; full ones don't count
        self.windows: dict[int, list[list[tuple]]] = {}
        self.n_open = 0

    def place(self, piece: tuple) -> Iterator[list[tuple]]:
        n = len(piece[2])
        fills = np.flatnonzero(self.level[1 : self.size - n + 1]) + 1
        best, cost = 0, self.level[n] + 0.5
        if len(fills):
            costs = self.level[fills + n] - self.level[fills] + np.where(fills + n == self.size, 0.5, 1.0)
            at = len(fills) - 1 - int(np.argmin(costs[::-1]))  # of equals the fullest
            if costs[at] < cost:
                best = int(fills[at])
        window = self._pop(best) if best else []
        window.append(piece)
        if best + n == self.size:
            yield window
            return
        self._push(best + n, window)
        if self.n_open > self.max_open:
            if window := self.relieve():
                yield window

    def _pop(self, fill: int) -> list[tuple]:
        self.level[fill] -= 1
        self.n_open -= 1
        return self.windows[fill].pop()

    def _push(self, fill: int, window: list[tuple]) -> None:
        self.level[fill] += 1
        self.n_open += 1
        self.windows.setdefault(fill, []).append(window)

    def relieve(self) -> list[tuple]:
        """The fullest window, filled up from the emptiest, which stays open with the rest if it has more than that."""
        held = np.flatnonzero(self.level)
        low, fill = int(held[0]), int(held[-1])
        donor, window = self._pop(low), self._pop(fill)
        while donor and fill < self.size:
            doc, start, ids, total = donor.pop()
            keep = max(0, len(ids) - (self.size - fill))
            if keep:
                donor.append((doc, start, ids[:keep], total))
            window.append((doc, start + keep, ids[keep:], total))
            fill += len(ids) - keep
        if donor:
            self._push(sum(len(p[2]) for p in donor), donor)
        if fill < self.size:  # the two together don't fill a window: one open window less
            self._push(fill, window)
            return []
        return window

    def merge(self) -> Iterator[list[tuple]]:
        """Fill the fullest windows from cuts of the emptiest until one partial window is left at most."""
        queue = [(fill, w) for fill in sorted(self.windows) for w in self.windows[fill]]
        self.level[:], self.windows, self.n_open = 0, {}, 0
        low, spare = 0, []
        while low < len(queue):
            fill, window = queue.pop()
            while fill < self.size:
                if not spare:
                    if low >= len(queue):
                        break
                    spare = queue[low][1]
                    low += 1
                doc, start, ids, total = spare.pop()
                keep = max(0, len(ids) - (self.size - fill))
                if keep:
                    spare.append((doc, start, ids[:keep], total))
                window.append((doc, start + keep, ids[keep:], total))
                fill += len(ids) - keep
            if fill == self.size:
                yield window
            else:
                self._push(fill, window)
        if spare:
            self._push(sum(len(p[2]) for p in spare), spare)

    def close(self) -> Iterator[list[tuple]]:
        """All that is still open: full windows, then windows of sizes that are powers of two."""
        yield from self.merge()
        rest = [piece for held in self.windows.values() for window in held for piece in window]
        self.windows, self.n_open = {}, 0
        left = sum(len(p[2]) for p in rest)
        while left:
            size = need = 1 << (left.bit_length() - 1)
            window = []
            while need:
                doc, start, ids, total = rest.pop()
                if len(ids) > need:
                    rest.append((doc, start + need, ids[need:], total))
                window.append((doc, start, ids[:need], total))
                need -= len(window[-1][2])
            yield window
            left -= size


class Bins:
    """Windows of one task by a key; together they hold no more open ones than `max_open`."""

    def __init__(self, size: int, max_open: int):
        self.size, self.max_open, self.n_open = size, max_open, 0
        self.of: dict = {}

    def place(self, key, piece: tuple) -> Iterator[list[tuple]]:
        if key not in self.of:
            self.of[key] = SumOfSquares(self.size, self.max_open)
        own = self.of[key]
        before = own.n_open
        yield from own.place(piece)
        self.n_open += own.n_open - before
        if self.n_open > self.max_open:
            most = max(self.of, key=lambda k: self.of[k].n_open)
            own = self.of[most]
            before = own.n_open
            if before > 1:
                if window := own.relieve():
                    yield window
            else:  # more keys than windows
                yield from self.of.pop(most).close()
            self.n_open += own.n_open - before

    def close(self) -> Iterator[list[tuple]]:
        for own in self.of.values():
            yield from own.close()


def pack_documents(
    docs: DataFrame, tokenizer: str | None = None, size: int = 2048, end_id: int = 1, max_open: int = 8192, known_words: int = 800_000, by: str | None = None
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian 32-bit), doc_tokens, sequence_id, offset.

    A document's tokens are its ids and `end_id`; null text counts as empty, so
    each input row has at least one token, and repeated rows are packed each on
    their own. The rows of a sequence_id, by offset, have no gaps; sequences of
    other lengths than `size` have a power of two of tokens. Null ids are
    carried along; an empty table gives an empty one; extra columns are not
    read. With a column `by`, such as the language, all documents of a sequence
    have the same value of it, null being one. `max_open` bounds the windows a
    task holds in memory (64 MB of ids at the default), `known_words` the words
    whose ids a worker keeps where it lacks `tiktoken` or can't use it (about
    0.4 GB at the default).
    """
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    end = np.array([end_id], "<u4").tobytes()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        coder, bins = _coder(tokenizer, known_words), Bins(size, max_open)
        first_id = TaskContext.get().partitionId() << 40

        def closed() -> Iterator[list[tuple]]:
            for batch in batches:
                for doc_id, text, key in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    ids = np.frombuffer(coder.encode(text or "") + end, "<u4")
                    whole = len(ids) // size * size
                    for start in range(0, whole, size):
                        yield [(doc_id, start, ids[start : start + size], len(ids))]
                    if whole < len(ids):
                        yield from bins.place(key, (doc_id, whole, ids[whole:].copy(), len(ids)))  # not a view of the whole text's ids
            yield from bins.close()

        for number, window in enumerate(closed()):
            offset = 0
            for doc_id, start, ids, total in window:
                yield doc_id, start, len(ids), ids.tobytes(), total, first_id + number, offset
                offset += len(ids)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = pieces(batches)
        while chunk := list(itertools.islice(found, 1000)):
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, f.type) for v, f in zip(zip(*chunk, strict=True), PIECES, strict=True)], schema=PIECES
            )

    key = F.lit(None).cast("string") if by is None else F.col(by)
    return docs.select(F.col("doc_id").cast("long"), "text", key.alias("key")).mapInArrow(
        pack,
        "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long",
    )


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )
