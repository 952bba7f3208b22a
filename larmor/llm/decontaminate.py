"""Benchmark decontamination with a distributed positional inverted index.

The index is partitioned by document: a shard holds whole documents up to a number of words, and for
each of its terms the ascending positions at which it stands.  One position between two documents stays
empty, so no phrase crosses.  Shards are rows of a stored table and are searched where they lie: the
test items travel to them in chunks of bounded size, and no posting is shuffled.  In a shard each window
starts from its rarest term; its list, shifted by the term's offset, is intersected with the shifted
lists of the other terms from rare to frequent.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_chunks, materialize

SHARD_WORDS = 1 << 17
QUERY_BYTES = 8 << 20
INDEX_SCHEMA = "shard string, doc_ids array<long>, sizes array<int>, terms binary, freqs binary, gaps binary"
MATCH = "array<struct<item_id:string,start:int,stop:int>>"
HIT_SCHEMA = f"shard string, ord int, doc_id long, n_words long, matches {MATCH}"

_WORD = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 0x80 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)


def words_of(text: bytes | None) -> list[bytes]:
    """Words of letters, digits and all beyond ASCII, A-Z in lower case; a null text has none."""
    return text.translate(_WORD).split() if text else []


def _planes(values: np.ndarray) -> bytes:
    """Int32 values as four byte planes: small values compress well."""
    return np.ascontiguousarray(values.astype("<i4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _unplaned(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<i4").ravel()


def _shard(name: str, doc_ids: list, sizes: list[int], words: list[bytes]) -> dict:
    known: defaultdict[bytes, int] = defaultdict(count().__next__)
    term = np.fromiter(map(known.__getitem__, words), np.int32, len(words))
    place = np.arange(len(words)) + np.repeat(np.arange(len(sizes)), sizes)
    order = np.argsort(term, kind="stable")
    freqs = np.bincount(term, minlength=len(known))
    gaps = np.diff(place[order], prepend=0)
    first = np.cumsum(freqs) - freqs
    gaps[first] = place[order][first]
    return {"shard": name, "doc_ids": doc_ids, "sizes": sizes, "terms": b" ".join(known), "freqs": _planes(freqs), "gaps": _planes(gaps)}


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_words: int = SHARD_WORDS) -> DataFrame:
    """One row per shard, lazily; store it before searching, since shard names hold only for a stored index.

    A document longer than ``shard_words`` closes the shard it is in.
    """
    types = [("shard", pa.string()), ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("terms", pa.binary()), ("freqs", pa.binary()), ("gaps", pa.binary())]
    schema = pa.schema(types)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, made = TaskContext.get().partitionId(), 0
        ids: list = []
        sizes: list[int] = []
        words: list[bytes] = []
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = words_of(text.as_py())
                ids.append(doc_id)
                sizes.append(len(own))
                words += own
                if len(words) >= shard_words:
                    yield pa.RecordBatch.from_pylist([_shard(f"{part}-{made}", ids, sizes, words)], schema)
                    ids, sizes, words, made = [], [], [], made + 1
        if ids:
            yield pa.RecordBatch.from_pylist([_shard(f"{part}-{made}", ids, sizes, words)], schema)

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return source.mapInArrow(run, INDEX_SCHEMA)


class Queries:
    """Windows of test items as term numbers, by window length."""

    def __init__(self, items: list[tuple[str, bytes | None]], window: int) -> None:
        known: defaultdict[bytes, int] = defaultdict(count().__next__)
        self.names: list[str] = []
        rows: dict[int, list[tuple[list[int], int]]] = defaultdict(list)
        for name, text in items:
            own = [known[w] for w in words_of(text)]
            if not own:
                continue
            item, size = len(self.names), min(window, len(own))
            self.names.append(name)
            rows[size] += [(own[i : i + size], item) for i in range(len(own) - size + 1)]
        self.terms = list(known)
        self.windows = {size: (np.array([r[0] for r in x], np.int32), np.array([r[1] for r in x], np.int32)) for size, x in rows.items()}


class Shard:
    """A shard opened for search: term numbers, and the sorted positions of each term."""

    def __init__(self, row: dict) -> None:
        self.doc_ids, self.sizes = row["doc_ids"], np.array(row["sizes"], np.int64)
        terms = row["terms"].split(b" ") if row["terms"] else []
        self.number = dict(zip(terms, range(len(terms)), strict=True))
        self.freqs = _unplaned(row["freqs"]).astype(np.int64)
        self.first = np.cumsum(self.freqs) - self.freqs
        run = np.cumsum(_unplaned(row["gaps"]).astype(np.int64))
        if len(run):
            before = np.where(self.first > 0, run[self.first - 1], 0)
            run -= np.repeat(before, self.freqs)
        self.places = run
        #: A position's key ``term * span + place`` ascends over the whole posting array.
        self.span = int(self.sizes.sum()) + len(self.sizes) + 1
        self.keys = run + np.repeat(np.arange(len(self.freqs)) * self.span, self.freqs)
        self.doc_first = np.cumsum(self.sizes + 1) - (self.sizes + 1)

    def holds(self, term: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Whether the posting list of each term has the place."""
        key = term * self.span + place
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return (self.keys[at] == key) & (place >= 0) & (place < self.span)

    def numbers(self, terms: list[bytes]) -> np.ndarray:
        return np.fromiter((self.number.get(t, -1) for t in terms), np.int64, len(terms))

    def rarest_first(self, rows: np.ndarray) -> np.ndarray:
        return np.argsort(self.freqs[rows], axis=1, kind="stable")

    def expand(self, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All places of each term: (index into ``term``, place)."""
        size = self.freqs[term]
        mine = np.repeat(np.arange(len(term)), size)
        begin = np.cumsum(size) - size
        return mine, self.places[np.arange(len(mine)) - np.repeat(begin - self.first[term], size)]

    def phrases(self, rows: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(row, first place) of each exact occurrence of the windows ``rows`` of term numbers."""
        order = self.rarest_first(rows)
        total = np.cumsum(self.freqs[rows[np.arange(len(rows)), order[:, 0]]])
        at = 0
        while at < len(rows):
            end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most, "right")))
            part, by = rows[at:end], order[at:end]
            every = np.arange(len(part))
            mine, start = self.expand(part[every, by[:, 0]])
            start = start - by[mine, 0]
            for rank in range(1, rows.shape[1]):
                offset = by[mine, rank]
                keep = self.holds(part[mine, offset], start + offset)
                mine, start = mine[keep], start[keep]
            yield mine + at, start
            at = end

    def near(self, row: np.ndarray, slop: int) -> np.ndarray:
        """First places of spans of at most ``len(row) + slop`` words that hold all terms of ``row``, in any order."""
        terms, span = np.unique(row), len(row) + slop
        rare = terms[np.argmin(self.freqs[terms])]
        _, middle = self.expand(np.array([rare]))
        starts = np.unique((middle[:, None] - np.arange(span)[None, :]).ravel())
        starts = starts[starts >= 0]
        doc = np.searchsorted(self.doc_first, starts, "right") - 1
        stops = np.minimum(starts + span, self.doc_first[doc] + self.sizes[doc])
        for term in terms[np.argsort(self.freqs[terms], kind="stable")]:
            lo = np.searchsorted(self.keys, term * self.span + starts)
            hi = np.searchsorted(self.keys, term * self.span + stops)
            starts, stops = starts[hi > lo], stops[hi > lo]
        return starts


def _merge(doc: np.ndarray, item: np.ndarray, start: np.ndarray, stop: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """Overlapping or touching ranges of one document and item become one."""
    order = np.lexsort((start, item, doc))
    held: list[int] | None = None
    for d, i, a, b in zip(*(x[order].tolist() for x in (doc, item, start, stop)), strict=True):
        if held and held[:2] == [d, i] and a <= held[3]:
            held[3] = max(held[3], b)
        else:
            if held:
                yield tuple(held)
            held = [d, i, a, b]
    if held:
        yield tuple(held)


def _search_shard(row: dict, queries: Queries, slop: int | None) -> list[dict]:
    shard = Shard(row)
    matches: list[list] = [[] for _ in shard.doc_ids]
    own = shard.numbers(queries.terms)
    docs, items, starts, stops = [], [], [], []
    for size, (windows, item) in queries.windows.items():
        if not len(shard.keys):
            break
        there = np.flatnonzero((own[windows] >= 0).all(1))
        rows = own[windows[there]]
        if slop is None:
            found = shard.phrases(rows)
        else:
            found = ((np.full(len(x), k), x) for k, row_ in enumerate(rows) for x in [shard.near(row_, slop)])
        for mine, start in found:
            doc = np.searchsorted(shard.doc_first, start, "right") - 1
            docs.append(doc)
            items.append(item[there[mine]])
            starts.append(start - shard.doc_first[doc])
            stops.append(np.minimum(starts[-1] + size + (slop or 0), shard.sizes[doc]))
    if docs:
        for d, i, a, b in _merge(*(np.concatenate(x) for x in (docs, items, starts, stops))):
            matches[d].append({"item_id": queries.names[i], "start": a, "stop": b})
    return [{"shard": row["shard"], "ord": k, "doc_id": doc, "n_words": int(n), "matches": matches[k]} for k, (doc, n) in enumerate(zip(shard.doc_ids, shard.sizes, strict=True))]


def search(index: DataFrame, items: DataFrame, item_id: str = "item_id", item_text: str = "text", window: int = 13, slop: int | None = None, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """Every indexed document with its matches: ``shard, ord, doc_id, n_words, matches``.

    ``slop`` None asks for exact phrases; a number asks for spans of window length plus ``slop`` that hold
    all words of a window in any order.  A match is a range of word places, ranges of one item merged.
    Items come to the driver in chunks of about ``query_bytes`` and each chunk is one pass over the
    stored shards, so their number has no bound.  Null and wordless items match nothing.
    """
    types = [("shard", pa.string()), ("ord", pa.int32()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("matches", pa.list_(pa.struct([("item_id", pa.string()), ("start", pa.int32()), ("stop", pa.int32())])))]
    schema = pa.schema(types)
    source = items.select(F.col(item_id).cast("string").alias("i"), F.col(item_text).cast("binary").alias("t")).where("t is not null")

    def passes(chunk: list) -> DataFrame:
        sent = index.sparkSession.sparkContext.broadcast([(r["i"], bytes(r["t"])) for r in chunk])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            queries = Queries(sent.value, window)
            for batch in batches:
                for k in range(batch.num_rows):
                    yield pa.RecordBatch.from_pylist(_search_shard(batch.slice(k, 1).to_pylist()[0], queries, slop), schema)

        return index.mapInArrow(run, HIT_SCHEMA)

    found = [passes(chunk) for chunk in bounded_chunks(source, F.octet_length("t"), query_bytes)] or [passes([])]
    if len(found) == 1:
        return found[0]
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return every.groupBy("shard", "ord").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.flatten(F.collect_list("matches")).alias("matches"))


def _covered(matches: Column) -> Column:
    """Number of words in the union of the ranges."""
    ordered = F.array_sort(F.transform(matches, lambda m: F.struct(m["start"].alias("a"), m["stop"].alias("b"))))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
    fold = lambda acc, m: F.struct(
        (acc["n"] + F.greatest(F.lit(0), m["b"] - F.greatest(m["a"], acc["end"]))).cast("long").alias("n"), F.greatest(acc["end"], m["b"]).alias("end")
    )
    return F.aggregate(ordered, start, fold, lambda acc: acc["n"])


def summarize(hits: DataFrame, share: int = 20) -> DataFrame:
    """Per document: words, words hit, items found, and whether at least one word in ``share`` is hit."""
    found = F.array_sort(F.array_distinct(F.col("matches.item_id")))
    some = F.size("matches") > 0
    row = hits.select(
        "doc_id", "n_words",
        F.when(some, _covered(F.col("matches"))).otherwise(F.lit(0).cast("long")).alias("n_hit"),
        F.when(some, F.size(found)).otherwise(0).cast("long").alias("n_items"),
        F.sha2(F.when(some, F.array_join(found, ",")).otherwise(""), 256).alias("items_sha256"),
    )
    return row.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words")))


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13, share: int = 20) -> DataFrame:
    """Per row of ``docs`` (repeated rows and null ids too): ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated``.

    Null and empty texts have no words and are clean.  No items leave every document clean; no documents
    give no rows.  Other columns are not read.
    """
    index = materialize(build_index(docs, id_col, text_col), "postings")
    return summarize(search(index, items, window=window), share)
