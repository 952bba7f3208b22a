"""SimHash near-duplicates by a hierarchical index over fingerprints in Gray order.

Fingerprints are one pass over the texts.  Two fingerprints that differ in at most ``distance`` bits
agree on at least one choice of ``blocks - distance`` out of ``blocks`` bit blocks, so the distinct
fingerprints are dealt out by every such choice.  Within a deal each fingerprint has the chosen bits
moved to its front and is sorted by Gray rank, which keeps equal bit prefixes together.  A prefix
shared by several fingerprints is one node of the index; node pairs are expanded from the front to the
back, carrying the differences so far, and a pair goes with all below it once these exceed the
distance, or once both sides are known to be one component.  A deal emits one edge per fingerprint at
most (to its local root), never all pairs; the edges then meet in distributed union-find.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .components import connected_components

SEED = 42
_SLICE = 1 << 19


def fingerprint(text: bytes | None, shingle: int = 3) -> int:
    """64-bit SimHash of the whole text: majority bits of XXH64 over word shingles, repeats counted."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - shingle + 1]
    ends = ends[shingle - 1 :]
    n = len(starts)
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, _SLICE):
        cut = zip(starts[at : at + _SLICE].tolist(), ends[at : at + _SLICE].tolist(), strict=True)
        hashes = np.array([digest(joined[a:b], SEED) for a, b in cut], np.dtype("<u8"))
        bits = np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(-1, 64)
        for part in range(0, len(bits), 255):
            ones += bits[part : part + 255].sum(0, dtype=np.uint8)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``(doc_id, fp long)`` for every row; a null text has the fingerprint zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = np.fromiter((fingerprint(t, shingle) for t in batch.column(1).to_pylist()), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got.view(np.int64))], names=["doc_id", "fp"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return source.mapInArrow(run, "doc_id long, fp long")


def gray_rank(code: np.ndarray) -> np.ndarray:
    """Position of each 64-bit code in the reflected Gray sequence."""
    rank = code.copy()
    for step in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(step)
    return rank


def _orders(blocks: int, distance: int) -> list[tuple[int, list[int]]]:
    """For each choice of kept blocks: number of front bits, and the bits (most significant first)."""
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    spans = [list(range(63 - edges[i], 63 - edges[i + 1], -1)) for i in range(blocks)]
    orders = []
    for kept in combinations(range(blocks), blocks - distance):
        front = [b for i in kept for b in spans[i]]
        orders.append((len(front), front + [b for i in range(blocks) if i not in kept for b in spans[i]]))
    return orders


def _move(code: np.ndarray, order: list[int]) -> np.ndarray:
    """Bits of ``code`` rearranged: ``order`` names them from the most significant place down."""
    out, at = np.zeros_like(code), 0
    while at < 64:
        run = 1
        while at + run < 64 and order[at + run] == order[at] - run:
            run += 1
        low = order[at] - run + 1
        part = (code >> np.uint64(low)) & np.uint64((1 << run) - 1)
        out |= part << np.uint64(64 - at - run)
        at += run
    return out


class _Forest:
    """Union-find over positions 0..n-1 for edges that come as arrays."""

    def __init__(self, n: int) -> None:
        self.root = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.root[a], self.root[b]
            apart = a != b
            a, b = a[apart], b[apart]
            if not len(a):
                break
            np.minimum.at(self.root, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = self.root[self.root]
                if np.array_equal(up, self.root):
                    break
                self.root = up


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Concatenation of ``start .. start + size - 1``."""
    before = np.cumsum(sizes) - sizes
    return np.arange(int(sizes.sum())) - np.repeat(before - starts, sizes)


class HierarchicalIndex:
    """Nodes of shared bit prefixes over Gray-sorted codes; ``groups`` start the top level."""

    #: Bits from the front that the nodes of each level share; the top level is the caller's groups.
    LEVELS = (32, 44, 54, 64)
    MOST_PAIRS = 1 << 20

    def __init__(self, codes: np.ndarray, group_starts: np.ndarray, distance: int) -> None:
        self.codes, self.distance = codes, distance
        self.forest = _Forest(len(codes))
        self.first = [group_starts]
        cut = np.zeros(len(codes), bool)
        cut[group_starts] = True
        for bits in self.LEVELS:
            top = codes >> np.uint64(64 - bits)
            cut = cut.copy()
            cut[1:] |= top[1:] != top[:-1]
            self.first.append(np.flatnonzero(cut))
        self.child, self.count = [], []
        for upper, lower in zip(self.first, self.first[1:], strict=False):
            begin = np.searchsorted(lower, upper)
            self.child.append(begin)
            self.count.append(np.diff(np.append(begin, len(lower))))

    def _single(self, level: int, node: np.ndarray) -> np.ndarray:
        """The component of a node whose codes are all in one, else -1."""
        starts = self.first[level]
        low, high = np.minimum.reduceat(self.forest.root, starts), np.maximum.reduceat(self.forest.root, starts)
        return np.where(low == high, low, -1)[node]

    def _expand(self, level: int, a: np.ndarray, b: np.ndarray) -> None:
        if level and len(a):
            shift = np.uint64(64 - self.LEVELS[level - 1])
            codes, first = self.codes, self.first[level]
            apart = np.bitwise_count((codes[first[a]] ^ codes[first[b]]) >> shift)
            keep = apart <= self.distance
            a, b = a[keep], b[keep]
        if not len(a):
            return
        if level == len(self.LEVELS):
            apart = a != b
            self.forest.join(a[apart], b[apart])
            return
        one, other = self._single(level, a), self._single(level, b)
        keep = (one < 0) | (one != other)
        a, b = a[keep], b[keep]
        made = self.count[level][a] * self.count[level][b]
        total = np.cumsum(made)
        at = 0
        while at < len(a):
            end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + self.MOST_PAIRS, "right")))
            self._descend(level, a[at:end], b[at:end])
            at = end

    def _descend(self, level: int, a: np.ndarray, b: np.ndarray) -> None:
        wide = self.count[level][a]
        left, mine = _ranges(self.child[level][a], wide), np.repeat(np.arange(len(a)), wide)
        at = 0
        sizes = self.count[level][b][mine]
        total = np.cumsum(sizes)
        while at < len(left):
            end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + self.MOST_PAIRS, "right")))
            x = np.repeat(left[at:end], sizes[at:end])
            y = _ranges(self.child[level][b][mine[at:end]], sizes[at:end])
            ordered = x <= y
            self._expand(level + 1, x[ordered], y[ordered])
            at = end

    def components(self) -> np.ndarray:
        """For each code the position of the smallest code of its component."""
        groups = np.arange(len(self.first[0]))
        self._expand(0, groups, groups)
        return self.forest.root


def _link_groups(batches: Iterator[pa.RecordBatch], distance: int, flush: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    """Batches sorted by (deal, front, rank) -> edges of a fingerprint to its local root."""
    held: list[list[np.ndarray]] = []
    size = 0

    def link(parts: list[list[np.ndarray]], last: bool) -> tuple[list[list[np.ndarray]], pa.RecordBatch | None]:
        deal, front, code, fp = (np.concatenate(x) for x in zip(*parts, strict=True))
        starts = np.flatnonzero(np.append(True, (deal[1:] != deal[:-1]) | (front[1:] != front[:-1])))
        end = len(deal) if last else starts[-1]
        rest = [[x[end:] for x in (deal, front, code, fp)]]
        starts = starts[starts < end]
        if not len(starts):
            return rest, None
        root = HierarchicalIndex(code[:end], starts, distance).components()
        linked = np.flatnonzero(root != np.arange(end))
        return rest, pa.RecordBatch.from_arrays([pa.array(fp[linked]), pa.array(fp[root[linked]])], names=["u", "v"])

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append([batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy().view(np.uint64), batch.column(3).to_numpy()])
        size += batch.num_rows
        if size >= flush:
            held, edges = link(held, False)
            size = len(held[0][0])
            if edges is not None:
                yield edges
    if size:
        _, edges = link(held, True)
        if edges is not None:
            yield edges


def blocks_for(n: int, distance: int) -> int:
    """More blocks make longer keys, hence smaller groups, as the fingerprints grow in number."""
    return distance + (1 if n <= 1 << 24 else 2 if n <= 1 << 32 else 3)


def link_fingerprints(fps: DataFrame, distance: int = 3, blocks: int | None = None) -> DataFrame:
    """``fps(fp long)``, distinct -> ``(node, root)`` for fingerprints linked at ``distance`` bits or fewer."""
    blocks = blocks or blocks_for(fps.count(), distance)
    orders = _orders(blocks, distance)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy()
            for k, (front, order) in enumerate(orders):
                code = _move(fp.view(np.uint64), order)
                rank = gray_rank(code)
                top = (code >> np.uint64(64 - front)).view(np.int64)
                # Spark sorts longs as signed: the top bit is flipped to keep the unsigned order of ranks.
                signed = (rank ^ np.uint64(1 << 63)).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(fp), k, np.int32)), pa.array(top), pa.array(code.view(np.int64)), pa.array(fp), pa.array(signed)],
                    names=["deal", "front", "code", "fp", "rank"],
                )

    dealt = fps.select("fp").mapInArrow(deal, "deal int, front long, code long, fp long, rank long")
    grouped = dealt.repartition("deal", "front").sortWithinPartitions("deal", "front", "rank")
    edges = grouped.select("deal", "front", "code", "fp").mapInArrow(lambda it: _link_groups(it, distance), "u long, v long")
    return connected_components(edges)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, distance: int = 3) -> DataFrame:
    """One row per document: ``doc_id, fp, component_id`` (smallest id of its component).

    Null and wordless texts have the fingerprint zero and link like any other.  Repeated rows share a
    fingerprint, so they share a component.  Null ids are kept and never become a component id unless
    all ids of the component are null.  Other columns of ``docs`` are not read.  No rows give no rows.
    """
    fps = materialize(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    distinct = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("smallest")), "distinct-fps")
    linked = link_fingerprints(distinct, distance)
    rooted = distinct.join(linked, distinct["fp"] == linked["node"], "left").select("fp", "smallest", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("smallest").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")
