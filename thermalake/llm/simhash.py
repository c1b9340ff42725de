"""SimHash near-duplicates with pivot distance tables.

Equal fingerprints collapse first. The Hamming distances of every different
fingerprint to many reference fingerprints, the pivots, are its coordinates.
Two fingerprints that differ in at most 2 bits differ by at most 2 in each of
them, so the first pivots deal the fingerprints into cells: a distance on the
lower side of a cut, but within 2 of it, is sent to both sides. Inside a cell
all pivots' distances are compared; a pair with a larger difference in any is
discarded, and the survivors are verified on all bits. A cell that is still
too full is split by what two near fingerprints must share: they differ in at
most 2 of 8 bytes, so they agree on the other 6 for one of 28 choices, and at
most 65,536 fingerprints agree on 6 bytes.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thermalake.llm.common import carried, cut, shuffle_partitions
from thermalake.llm.components import connected_components

MAX_BITS = 2
#: Parameters: pivots in all, those that deal at most, fingerprints a cell should hold, and those past which it is split.
PIVOTS, DEALING, CELL, FULL = 24, 16, 128, 4096
_CUT = 33  # of 64 bits; half of all fingerprints are nearer to a pivot than that
_CHUNK = 16_384


def text_fingerprint(text: str | None, shingle: int = 3) -> int:
    """64-bit SimHash of the word shingles of a text, A-Z lower-cased; 0 if it has no words."""
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    digest, join = xxhash.xxh64_intdigest, b" ".join
    if len(words) <= shingle:
        hashes = [digest(join(words), 42)]
    else:
        runs = zip(*(itertools.islice(words, k, None) for k in range(shingle)), strict=False)
        hashes = [digest(join(run), 42) for run in runs]
    values = np.array(hashes, "<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(values), _CHUNK):
        part = values[at : at + _CHUNK]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(values), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, text_hash, fp long) per input row; null and empty texts have fingerprint zero."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("fp", pa.int64())])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([text_fingerprint(t.as_py(), shingle) for t in batch.column(2)], np.uint64)  # one text at a time
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(found.view(np.int64))], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), "text").mapInArrow(
        sign, "doc_id long, text_hash long, fp long"
    )


def references(count: int = PIVOTS) -> np.ndarray:
    """The fixed reference fingerprints of the distance tables."""
    return np.random.default_rng(64).integers(0, 2**64, count, dtype=np.uint64)


def near_pairs(
    group: np.ndarray, fps: np.ndarray, pivots: np.ndarray, max_bits: int = MAX_BITS
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (i, j) of pairs of one group within `max_bits`, batch by batch.

    Rows are walked in the order of group, then of the distance to the last
    reference; a row leaves the walk when its next neighbour is of another
    group or too far from it in that distance. The other distances discard
    pairs one after the other, the last first: the first deal, so they differ
    least within a group.
    """
    table = np.bitwise_count(fps[:, None] ^ pivots[None, :]).astype(np.int8)
    order = np.lexsort((table[:, -1], group))
    group, fps = group[order], fps[order]
    columns = np.ascontiguousarray(table[order].T)
    walk, active = columns[-1], np.arange(len(fps))
    for step in range(1, len(fps)):
        active = active[active + step < len(fps)]
        other = active + step
        live = (group[active] == group[other]) & (walk[other] - walk[active] <= max_bits)
        active, other = active[live], other[live]
        if not len(active):
            return
        i, j = active, other
        for column in columns[-2::-1]:
            near = np.abs(column[i] - column[j]) <= max_bits
            i, j = i[near], j[near]
            if not len(i):
                break
        true = np.bitwise_count(fps[i] ^ fps[j]) <= max_bits
        if true.any():
            yield order[i[true]], order[j[true]]


def spanning_links(pairs: Iterator[tuple[np.ndarray, np.ndarray]], nodes: np.ndarray) -> dict[int, int]:
    """Each linked node's smallest linked node within these pairs, by union-find."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up] if up in parent else up
        return x

    for left, right in pairs:
        for a, b in zip(nodes[left].tolist(), nodes[right].tolist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(parent)}


def pivot_cells(fps: np.ndarray, pivots: np.ndarray, max_bits: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """(positions, cells): the cells of every fingerprint, by the side of the cut that each pivot's distance is on.

    Those that lie below a cut by `max_bits` or less are in the cells of both
    sides, so two fingerprints within `max_bits` share the cell that has the
    upper side wherever either of them has it.
    """
    distance = np.bitwise_count(fps[:, None] ^ pivots[None, :]).astype(np.int64)
    at, cell = np.arange(len(fps)), ((distance >= _CUT) << np.arange(len(pivots))).sum(1)
    for j in range(len(pivots)):
        both = np.flatnonzero((distance[at, j] < _CUT) & (distance[at, j] >= _CUT - max_bits))
        at, cell = np.concatenate([at, at[both]]), np.concatenate([cell, cell[both] | 1 << j])
    return at, cell


def near_links(distinct: DataFrame, max_bits: int = MAX_BITS, cell: int = CELL, full: int = FULL) -> DataFrame:
    """Links (a, b) between rows (fp long, node long) of different fingerprints.

    Direct or via others of the same group: enough links for the components,
    at most one per row and group, so dense groups don't grow quadratically.
    The number of dealing pivots grows with that of the fingerprints, up to
    DEALING; cells of more than `full` rows are split by bytes.
    """
    pivots = references()
    n_pivots = min(DEALING, max(0, (distinct.count() // cell).bit_length()))
    dealing = pivots[:n_pivots]
    dealt_schema = pa.schema([("cell", pa.int32()), ("fp", pa.int64()), ("node", pa.int64())])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, nodes = (c.to_numpy() for c in batch.columns)
            at, cells = pivot_cells(fps.view(np.uint64), dealing, max_bits)
            yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int32()), pa.array(fps[at]), pa.array(nodes[at])], schema=dealt_schema)

    dealt = distinct.select("fp", "node").mapInArrow(deal, "cell int, fp long, node long")
    # at most 2^DEALING numbers of cells
    crowded = [r["cell"] for r in dealt.groupBy("cell").count().filter(F.col("count") > full).collect()]
    free = [sum(0xFF << (8 * byte) for byte in pair) for pair in itertools.combinations(range(8), 2)]
    masks = (~np.array(free, np.uint64)).view(np.int64).tolist()
    split = F.col("cell").isin(crowded) if crowded else F.lit(False)
    whole = dealt.filter(~split).select("cell", "fp", "node", F.lit(-1).alias("choice"), F.lit(0).cast("long").alias("bits"))
    # a fingerprint goes to its bytes' groups once, however many of its cells are crowded: they don't depend on the cell
    many = dealt.filter(split).select("fp", "node").distinct()
    by_bytes = many.select(F.lit(-1).alias("cell"), "fp", "node", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("choice", "bits"))
    # a group's work is far above its bytes, so the groups are dealt by number, not put together by size
    tagged = whole.unionByName(by_bytes).repartition(shuffle_partitions(distinct.sparkSession), "cell", "choice", "bits")
    groups = (
        tagged.groupBy("cell", "choice", "bits")
        .agg(F.collect_list(F.struct("fp", "node")).alias("members"))
        .filter(F.size("members") > 1)
        .select("members")
    )
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            ends = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            flat = lists.flatten()
            fps = flat.field(0).to_numpy(zero_copy_only=False).view(np.uint64)
            nodes = flat.field(1).to_numpy(zero_copy_only=False)
            group = np.repeat(np.arange(len(lists)), np.diff(ends))
            at = 0
            while at < len(lists):  # some lists at a time, of about _CHUNK rows in all
                to = max(at + 1, int(np.searchsorted(ends, ends[at] + _CHUNK, "right")) - 1)
                own = slice(ends[at], ends[to])
                links = spanning_links(near_pairs(group[own], fps[own], pivots, max_bits), nodes[own])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(links), pa.int64()), pa.array(list(links.values()), pa.int64())], schema=schema
                )
                at = to

    return groups.mapInArrow(link, "a long, b long").filter("a <> b")


def near_duplicates(docs: DataFrame, shingle: int = 3, max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, text_hash, fp, component_id) per input row; text_hash is xxhash64 of the text.

    component_id is the smallest doc_id reachable by links of at most `max_bits`
    differing bits, own copies included. Rows with equal fingerprints, empty
    texts among them, are linked. A row without an id gets the component of its
    fingerprint, but is never its smallest; if all of a component's rows lack
    one, it is null. Extra columns are not read.
    """
    signed = cut(fingerprints(docs, shingle))
    distinct = cut(signed.groupBy("fp").agg(F.min("doc_id").alias("node")))
    parts = connected_components(near_links(distinct.filter("node IS NOT NULL"), max_bits))
    by_fp = distinct.join(parts, "node", "left").select(
        F.col("fp").alias("_fp"), F.coalesce("component", "node").alias("component_id")
    )
    return signed.join(by_fp, F.col("fp") == F.col("_fp")).select("doc_id", "text_hash", "fp", "component_id")


def one_of_each_group(docs: DataFrame, shingle: int = 3, max_bits: int = MAX_BITS) -> DataFrame:
    """The input rows and columns without near-duplicates: of each component its smallest doc_id stays.

    Of rows that repeat this id, one stays, of those with the smallest hash of
    the text. Null and empty texts are near-duplicates of each other. Rows
    without an id cannot stand for a group and are no document to compare: all
    of them stay. An empty table gives an empty one. Extra columns of any name
    are carried along.
    """
    keepers = (
        near_duplicates(docs.filter("doc_id IS NOT NULL"), shingle, max_bits)
        .filter("doc_id = component_id")
        .groupBy("component_id")
        .agg(F.min("text_hash").alias("text_hash"))
    )
    rows = carried(docs, _id=F.col("doc_id").cast("long"), _hash=F.xxhash64("text"))
    met = rows.join(keepers, (F.col("_id") == F.col("component_id")) & (F.col("_hash") == F.col("text_hash"))).select("row", "_id", "_hash")
    # rows that repeat an id and a text are put together where they are read, before they are sent
    kept = met.groupBy("_id", "_hash").agg(F.first("row").alias("row")).select("row.*")
    return kept.unionByName(docs.filter("doc_id IS NULL"))


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
