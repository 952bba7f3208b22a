"""Language-model scores by context-tree weighting, beside a unigram base score.

Each byte of a text and its end is a symbol; it is decomposed into eight binary decisions, and each decision is
predicted in the contexts of the last 0, 1, ... ``DEPTH`` bytes of the text.  A node of the context tree has a
Krichevsky-Trofimov estimate from its counts and is weighted with the product of its children by one half each; the
weights after all training data mix the estimates of all depths along a context's path.

Nothing is sampled and no node is left out.  Texts are packed into chunks of about ``CHUNK`` bytes.  The distinct
(context, symbol) cells of a chunk, sorted, go as one compressed row to each part; a part has all cells whose last
``ROUTE`` bytes of context are dealt to it, so whole subtrees meet in a group.  A part adds up the counts, weighs its
subtrees and stores its cells; what parts say about the shallow contexts is one row for each last byte and binary node,
at most 65,536 in all, and these rows alone reach the driver.  With them each part finds the log probability of each
cell.  Chunks then ask the parts for those of their cells and add them up text by text, in rounds, so that the
disk holds the answers to a share of the chunks at a time.  Chunks, cells and words stay in tables that grow with the corpus.

The most frequent words (``HEAD_ITEMS``, a fixed number) travel to all tasks with their scores; all others meet theirs
in a shuffled join, which then has no hot key.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, free_shuffles, materialize

DEPTH = 7
ROUTE = 2
HEAD_ITEMS = 1 << 19
#: Bytes of text in a chunk, about; a longer text is a chunk by itself.
CHUNK = 6 << 20
#: Bytes of text for each part, about.
PART = 1 << 23
#: Bytes of text in a round, about, and the most rounds.
ROUND, ROUNDS = 1 << 25, 6
ALPHA = 0.1
#: Bytes that UTF-8 never has: the end of a text, and the places before it.
_STOP, _START = 0xFF, 0xFE
#: Distinct words that a task holds while it counts.
_FLUSH = 1 << 20
_LN2 = float(np.log(2))


def units(text: bytes) -> list[bytes]:
    """A text with ``DEPTH`` bytes before it; last the ``DEPTH`` bytes before its end, which stand for the end."""
    whole = bytes([_START]) * DEPTH + text
    return [whole, whole[-DEPTH:]] if text else [whole]


def cells(items: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(context, symbol) of every symbol of the units as one 64-bit key, last byte of context first; and each key's unit."""
    flat = np.frombuffer(b"".join([x if len(x) > DEPTH else x + bytes([_STOP]) for x in items]), np.uint8)
    sizes = np.maximum(np.fromiter(map(len, items), np.int64, len(items)) - DEPTH, 1)
    # Eight bytes as a little-endian number have the symbol first, then the last byte of context: turned by a byte they are the key.
    eight = np.ndarray(len(flat) - DEPTH, "<u8", flat.tobytes(), strides=(1,))
    # Behind the bytes before a unit come its own, or the stop: these are the symbols.
    symbol = np.ones(len(eight), bool)
    symbol[(np.cumsum(sizes + DEPTH)[:-1, None] - DEPTH + np.arange(DEPTH)).ravel()] = False
    eight = eight[symbol]
    return (eight << np.uint64(8)) | (eight >> np.uint64(56)), np.repeat(np.arange(len(items), dtype=np.int32), sizes)


def _firsts(ordered: np.ndarray) -> np.ndarray:
    """Where the values of a sorted array begin."""
    return np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])[: len(ordered)])


def _pressed(values: np.ndarray) -> bytes:
    """Numbers of eight bytes, compressed plane by plane."""
    return pa.compress(np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8).T).tobytes(), "zstd", asbytes=True)


def _loose(blob: bytes, k: int, kind: type) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(blob, 8 * k, "zstd"), np.uint8).reshape(8, k)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def _pressed_keys(ordered: np.ndarray) -> bytes:
    return _pressed(np.diff(ordered, prepend=np.uint64(0)))


def _loose_keys(blob: bytes, k: int) -> np.ndarray:
    return np.cumsum(_loose(blob, k, np.uint64), dtype=np.uint64)


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series after shifting small arguments up by eight."""
    shift = np.zeros_like(x)
    for i in range(8):
        shift += np.log(x + i)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


_HALF, _WHOLE = (np.array([math.lgamma(n + plus) for n in range(1 << 12)]) for plus in (0.5, 1.0))


def _looked_up(n: np.ndarray, table: np.ndarray, plus: float) -> np.ndarray:
    out = table[np.minimum(n, len(table) - 1).astype(np.int64)]
    large = n >= len(table)
    if large.any():
        out[large] = _log_gamma(n[large] + plus)
    return out


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log probability that Krichevsky-Trofimov estimation gives a bit sequence with these counts."""
    return _looked_up(zeros, _HALF, 0.5) + _looked_up(ones, _HALF, 0.5) - _looked_up(zeros + ones, _WHOLE, 1.0) - np.log(np.pi)


def _weighted(kt: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log weight of a node, and the share that its own estimate has in it."""
    both = np.logaddexp(kt, below) - _LN2
    return both, np.exp(np.minimum(kt - _LN2 - both, 0))


class Subtree:
    """Contexts of ``ROUTE`` to ``DEPTH`` bytes above sorted distinct cells with their counts (0 for cells that are only asked for)."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.keys, self.counts, self.up = {DEPTH: keys}, {DEPTH: counts.astype(float)}, {}
        for d in range(DEPTH - 1, ROUTE - 1, -1):
            below = self.keys[d + 1]
            # The oldest byte of context lies above the symbol.
            self.keys[d], self.up[d + 1] = np.unique((below >> np.uint64(16) << np.uint64(8)) | (below & np.uint64(0xFF)), return_inverse=True)
            self.counts[d] = np.bincount(self.up[d + 1], self.counts[d + 1], len(self.keys[d]))

    def _weigh(self, bit: int) -> tuple[dict[int, np.ndarray], ...]:
        """By depth: where the nodes of decision ``bit`` begin, the node of each cell, counts, log estimates and log weights."""
        first, node, own, kts, weight = {}, {}, {}, {}, {}
        for d in range(DEPTH, ROUTE - 1, -1):
            group = self.keys[d] >> np.uint64(8 - bit)
            first[d] = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
            node[d] = np.cumsum(np.append(0, group[1:] != group[:-1]))
            one = (self.keys[d] >> np.uint64(7 - bit)) & np.uint64(1) == 1
            ones = np.add.reduceat(np.where(one, self.counts[d], 0), first[d])
            zeros = np.add.reduceat(np.where(one, 0, self.counts[d]), first[d])
            own[d], kts[d] = (zeros, ones), log_kt(zeros, ones)
            weight[d] = kts[d]
            if d < DEPTH:
                above = node[d][self.up[d + 1][first[d + 1]]]
                weight[d] = np.logaddexp(kts[d], np.bincount(above, weight[d + 1], len(kts[d]))) - _LN2
        return first, node, own, kts, weight

    def shallow(self, bit: int) -> tuple[np.ndarray, ...]:
        """The shallowest nodes: last byte of context and binary node as one number, zeros, ones, log weight."""
        return self._shallow(bit, *self._weigh(bit))

    def _shallow(self, bit: int, first: dict, node: dict, own: dict, kts: dict, weight: dict) -> tuple[np.ndarray, ...]:
        start = self.keys[ROUTE][first[ROUTE]]
        binary = np.uint64(1 << bit) | ((start & np.uint64(0xFF)) >> np.uint64(8 - bit))
        return ((start >> np.uint64(8 * ROUTE)) << np.uint64(8)) | binary, *own[ROUTE], weight[ROUTE]

    def decision(self, bit: int) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
        """Probability of a one in each cell's decision ``bit``, by contexts of ``ROUTE`` bytes and more; and the shallowest nodes."""
        first, node, own, kts, weight = held = self._weigh(bit)
        estimate = {d: (ones + 0.5) / (zeros + ones + 1) for d, (zeros, ones) in own.items()}
        share = {d: np.exp(np.minimum(kts[d] - _LN2 - weight[d], 0)) for d in range(ROUTE, DEPTH)} | {DEPTH: np.ones(len(kts[DEPTH]))}
        sure, rest = share[ROUTE] * estimate[ROUTE], 1 - share[ROUTE]
        for d in range(ROUTE + 1, DEPTH + 1):
            above = node[d - 1][self.up[d][first[d]]]
            sure, rest = sure[above] + rest[above] * share[d] * estimate[d], rest[above] * (1 - share[d])
        return sure[node[DEPTH]], self._shallow(bit, *held)


class Top:
    """The contexts of no and of one byte: shares and estimates by (last byte, binary node)."""

    def __init__(self, node: np.ndarray, zeros: np.ndarray, ones: np.ndarray, weights: np.ndarray) -> None:
        held = np.zeros((3, 1 << 16))
        for row, values in zip(held, (zeros, ones, weights), strict=True):
            np.add.at(row, node, values)
        zeros, ones, weights = held.reshape(3, 256, 256)
        one, self.share = _weighted(log_kt(zeros, ones), weights)
        self.estimate = (ones + 0.5) / (zeros + ones + 1)
        zeros, ones = zeros.sum(0), ones.sum(0)
        self.root = (ones + 0.5) / (zeros + ones + 1)
        self.root_share = _weighted(log_kt(zeros, ones), one.sum(0))[1]

    def log10(self, keys: np.ndarray, deep: np.ndarray) -> np.ndarray:
        """Log probability of each cell's symbol; ``deep`` holds what ``Subtree`` says of its eight decisions."""
        last, symbol = (keys >> np.uint64(56)).astype(np.int64), (keys & np.uint64(0xFF)).astype(np.int64)
        total = np.zeros(len(keys))
        for bit in range(8):
            node = (1 << bit) | (symbol >> (8 - bit))
            share, top = self.share[last, node], self.root_share[node]
            p = top * self.root[node] + (1 - top) * (share * self.estimate[last, node] + (1 - share) * deep[:, bit])
            total += np.log10(np.where(symbol >> (7 - bit) & 1 == 1, p, 1 - p))
        return total


def pack(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, t binary, learn)`` -> ``chunk, doc_ids, learn, sizes, text``: lower-case texts end to end, compressed.

    ``chunk`` is the number of its first text; the others follow it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        uid, ids, learn, texts, size = TaskContext.get().partitionId() << 40, [], [], [], 0

        def out() -> pa.RecordBatch:
            row = [uid], [ids], [learn], [list(map(len, texts))], [pa.compress(b"".join(texts), "zstd", asbytes=True)]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, kinds, strict=True)], names=["chunk", "doc_ids", "learn", "sizes", "text"])

        for batch in batches:
            for who, text, told in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                raw = (text.as_py() or b"").lower()
                ids.append(who)
                learn.append(told)
                texts.append(raw)
                size += len(raw)
                if size >= CHUNK:
                    yield out()
                    uid, ids, learn, texts, size = uid + len(texts), [], [], [], 0
        if texts:
            yield out()

    longs = pa.list_(pa.int64())
    kinds = pa.int64(), longs, pa.list_(pa.bool_()), longs, pa.binary()
    return docs.mapInArrow(run, "chunk long, doc_ids array<long>, learn array<boolean>, sizes array<long>, text binary")


def _texts(row: dict) -> list[bytes]:
    """The texts of a row of ``pack``."""
    sizes = row["sizes"]
    whole, ends = pa.decompress(row["text"], sum(sizes), "zstd", asbytes=True), np.cumsum(sizes).tolist()
    return [whole[end - size : end] for end, size in zip(ends, sizes, strict=True)]


def _keys(row: dict) -> np.ndarray:
    """``cells`` of a chunk: text by text, each byte and the end."""
    return cells([unit for text in _texts(row) for unit in units(text)])[0]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def _dealt(keys: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Part of each key, and the order that lists the keys part by part."""
    of = np.random.default_rng(0).permutation(1 << 8 * ROUTE) % parts
    part = of[(keys >> np.uint64(64 - 8 * ROUTE)).astype(np.int64)].astype(np.uint16)
    return part, np.argsort(part, kind="stable")


def chunk_cells(chunks: DataFrame, parts: int, counted: bool) -> DataFrame:
    """``chunk, part, k, keys, n``: the ``k`` distinct cells of a chunk that a part has; ``counted``: their counts in texts to learn from."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            key = _keys(row)
            learn = np.repeat(np.array(row["learn"], bool), np.array(row["sizes"]) + 1)
            other = np.sort(key[~learn]) if counted else key[:0]
            key.sort()
            first = _firsts(key)
            keys, n = key[first], np.diff(first, append=len(key))
            del key
            if len(other):
                first = _firsts(other)
                n[np.searchsorted(keys, other[first])] -= np.diff(first, append=len(other))
            part, order = _dealt(keys, parts)
            keys, n, part = keys[order], n[order], part[order]
            for group in np.split(np.arange(len(keys)), _firsts(part)[1:]):
                a, b = group[0], group[-1] + 1
                one = [row["chunk"]], [int(part[a])], [int(b - a)], [_pressed_keys(keys[a:b])], [_pressed(n[a:b]) if counted else None]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(one, kinds, strict=True)], names=["chunk", "part", "k", "keys", "n"])

    kinds = pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary()
    return chunks.mapInArrow(run, "chunk long, part int, k long, keys binary, n binary")


def _tree(asked: DataFrame) -> DataFrame:
    """Rows of ``chunk_cells`` -> ``part, k, keys, n`` of all cells of a part, and rows of null ``keys`` with the shallowest nodes."""

    def weigh(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        keys = np.concatenate([_loose_keys(r["keys"], r["k"]) for r in rows])
        n = np.concatenate([_loose(r["n"], r["k"], np.int64) for r in rows])
        order = np.argsort(keys)
        keys = keys[order]
        first = _firsts(keys)
        keys, n = keys[first], np.add.reduceat(n[order], first)
        tree = Subtree(keys, n)
        node, *sums = (np.concatenate(x) for x in zip(*[tree.shallow(bit) for bit in range(8)], strict=True))
        node, at = np.unique(node, return_inverse=True)
        sums = [np.bincount(at, s, len(node)) for s in sums]
        none = [pa.nulls(len(node), t) for t in schema.types[:4]]
        shallow = pa.Table.from_arrays([*none, pa.array(node.astype(np.int64)), *map(pa.array, sums)], schema=schema)
        whole = [rows[0]["part"]], [len(keys)], [_pressed_keys(keys)], [_pressed(n)], [None], [None], [None], [None]
        return pa.concat_tables([pa.Table.from_arrays([pa.array(v, t) for v, t in zip(whole, schema.types, strict=True)], schema=schema), shallow])

    schema = pa.schema([("part", pa.int32()), ("k", pa.int64()), ("keys", pa.binary()), ("n", pa.binary()), ("node", pa.int64()), ("zeros", pa.float64()), ("ones", pa.float64()), ("weight", pa.float64())])
    return asked.select("part", "k", "keys", "n").groupBy("part").applyInArrow(weigh, "part int, k long, keys binary, n binary, node long, zeros double, ones double, weight double")


def cell_scores(asked: DataFrame) -> DataFrame:
    """Rows of ``chunk_cells`` -> ``part, k, keys, p``: the log10 probability of each cell's symbol."""
    spark = asked.sparkSession
    stored = materialize(_tree(asked), "ctw-cells")
    free_shuffles(spark)
    tops = stored.where("node is not null").groupBy("node").agg(*[F.sum(c).alias(c) for c in ("zeros", "ones", "weight")]).toArrow()  # 65,536 rows at most
    sent = spark.sparkContext.broadcast(Top(*[tops.column(c).to_numpy() for c in ("node", "zeros", "ones", "weight")]))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            keys = _loose_keys(row["keys"], row["k"])
            tree = Subtree(keys, _loose(row["n"], row["k"], np.int64))
            deep = np.empty((len(keys), 8))
            for bit in range(8):
                deep[:, bit] = tree.decision(bit)[0]
            one = [row["part"]], [row["k"]], [row["keys"]], [_pressed(sent.value.log10(keys, deep))]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(one, kinds, strict=True)], names=["part", "k", "keys", "p"])

    kinds = pa.int32(), pa.int64(), pa.binary(), pa.binary()
    # One part at a time to a task: a table of parts is small and their trees are not.
    parts = stored.where("keys is not null").select("part", "k", "keys", "n")
    logs = materialize(parts.repartition(max(1, parts.count()), "part").mapInArrow(finish, "part int, k long, keys binary, p binary"), "ctw-logs")
    discard(stored)
    free_shuffles(spark)
    return logs


def text_scores(chunks: DataFrame, logs: DataFrame, parts: int) -> DataFrame:
    """``uid, doc_id, n_bytes, score`` of every text of the chunks."""

    def answer(these: pa.Table, own: pa.Table) -> pa.Table:
        out = []
        if these.num_rows:
            of = own.to_pylist()[0]
            keys, p = _loose_keys(of["keys"], of["k"]), _loose(of["p"], of["k"], np.float64)
            for r in these.to_pylist():
                out.append((r["chunk"], r["part"], r["k"], p[np.searchsorted(keys, _loose_keys(r["keys"], r["k"]))].tobytes()))
        return pa.Table.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(told.types)], schema=told)

    def total(answers: pa.Table, own: pa.Table) -> pa.Table:
        (row,) = own.to_pylist()
        sizes = np.array(row["sizes"], np.int64)
        key = _keys(row)
        order = np.argsort(key)
        key = key[order]
        of = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes + 1)[order]
        del order
        first = _firsts(key)
        times, (_, dealt) = np.diff(first, append=len(key)), _dealt(key[first], parts)
        del key
        p = np.empty(len(first))
        p[dealt] = np.frombuffer(b"".join([r["p"] for r in sorted(answers.to_pylist(), key=lambda r: r["part"])]), np.float64)
        sums = np.bincount(of, np.repeat(p, times), len(sizes))
        uid = np.arange(row["chunk"], row["chunk"] + len(sizes))
        return pa.table({"uid": pa.array(uid), "doc_id": pa.array(row["doc_ids"], pa.int64()), "n_bytes": pa.array(sizes), "score": pa.array(sums)})

    told = pa.schema([("chunk", pa.int64()), ("part", pa.int32()), ("k", pa.int64()), ("p", pa.binary())])
    size = chunks.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, b: a + b))).first()[0] or 0
    rounds, done = min(ROUNDS, size // ROUND + 1), []
    for i in range(rounds):
        now = chunks.where(F.pmod(F.xxhash64("chunk"), F.lit(rounds)) == i)
        answers = chunk_cells(now, parts, False).drop("n").groupBy("part").cogroup(logs.groupBy("part")).applyInArrow(answer, "chunk long, part int, k long, p binary")
        found = answers.groupBy("chunk").cogroup(now.groupBy("chunk")).applyInArrow(total, "uid long, doc_id long, n_bytes long, score double")
        done.append(materialize(found, "ctw-scored"))
        del now, answers, found
        free_shuffles(chunks.sparkSession)
    scored = done[0]
    for more in done[1:]:
        scored = scored.unionByName(more)
    return scored


def _words(row: dict) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words of a chunk, and of every word that stands in it the place among those and the text it stands in."""
    sizes = np.array(row["sizes"], np.int64)
    whole = pa.decompress(row["text"], int(sizes.sum()), "zstd")
    texts = pa.Array.from_buffers(pa.large_string(), len(sizes), [None, pa.py_buffer(np.append(0, np.cumsum(sizes))), whole])
    split = pc.ascii_split_whitespace(texts)
    flat, of = split.flatten(), np.repeat(np.arange(len(sizes)), pc.list_value_length(split).to_numpy(zero_copy_only=False))
    held = pc.binary_length(flat).to_numpy() > 0  # white space at an end leaves an empty word
    coded = flat.dictionary_encode()
    return coded.dictionary.cast(pa.large_binary()).cast(pa.binary()), coded.indices.to_numpy()[held], of[held]


def count_words(chunks: DataFrame) -> DataFrame:
    """``word, c``: words with their counts in the texts to learn from."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["word", "c"])

        for row in _rows(batches):
            words, code, of = _words(row)
            n = np.bincount(code[np.array(row["learn"], bool)[of]], minlength=len(words))
            for word, c in zip(words.filter(pa.array(n > 0)).to_pylist(), n[n > 0].tolist(), strict=True):
                held[word] += c
            if len(held) > _FLUSH:
                yield out()
                held.clear()
        if held:
            yield out()

    return chunks.mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def _head(table: DataFrame, most: int) -> DataFrame:
    """The rows of the largest counts, at most ``most`` of them: a threshold from a histogram of 8 classes an octave."""
    octave = F.floor(F.log2(F.greatest("c", F.lit(1))) * 8).cast("int")
    held, least = 0, None
    for row in sorted(table.groupBy(octave.alias("o")).count().collect(), reverse=True):  # 512 rows at most
        held += row["count"]
        if held > most:
            break
        least = row["o"]
    return table.where(octave >= least) if least is not None else table.where(F.lit(False))


def score(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", head_items: int = HEAD_ITEMS) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_bytes, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte``.

    Counts come from the rows where ``learn`` is true.  ``score`` is the log10 probability of the lower-cased
    bytes of the whole text and its end; ``base_score`` that of its words and one end by add-0.1 unigram counts.
    Null texts are empty texts, a null ``learn`` is false.  Repeated rows score alike up to rounding, null ids are
    kept, other columns are not read.  Nothing to learn from leaves uniform estimates (each decision one half)
    and counts of zero.  No rows give no rows.
    """
    spark = docs.sparkSession
    learn = F.coalesce(learn, F.lit(False))
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("t"), learn.alias("learn"))
    chunks = materialize(pack(source), "ctw-chunks")
    size, ends = chunks.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, b: a + b)), F.sum(F.size(F.filter("learn", lambda told: told)))).first()
    ends = ends or 0
    parts = min(1 << 8 * ROUTE, max(int(spark.conf.get("spark.sql.shuffle.partitions")), (size or 0) // PART))
    logs = cell_scores(chunk_cells(chunks, parts, True))
    scored = text_scores(chunks, logs, parts)
    discard(logs)

    words = materialize(count_words(chunks), "ctw-words")
    free_shuffles(spark)
    sums = words.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    tokens, kinds = (sums["n"] or 0) + ends, sums["v"] + (ends > 0)
    floor = tokens + ALPHA * (kinds + 1)
    head = _head(words, head_items).toArrow()
    sent = spark.sparkContext.broadcast((head.column("word").combine_chunks(), np.log10((head.column("c").to_numpy() + ALPHA) / floor)))
    end_log = float(np.log10((ends + ALPHA) / floor))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, logs = sent.value
        for row in _rows(batches):
            words, code, of = _words(row)
            n, first = len(row["sizes"]), row["chunk"]
            at = pc.index_in(words, value_set=names)
            told = np.append(logs, 0.0)[pc.fill_null(at, len(logs)).to_numpy()]
            rare = at.is_null().to_numpy(zero_copy_only=False)[code]
            tokens, known = np.bincount(of, minlength=n), np.bincount(of[~rare], minlength=n)
            whole = [pa.array(tokens + 1), pa.array(known + (ends > 0)), pa.array(np.bincount(of, told[code], n) + end_log)]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + n)), *whole, pa.nulls(n, pa.binary()), pa.nulls(n, pa.int64())], names=columns)
            pair = of[rare] * len(words) + code[rare]
            pair.sort()
            if len(start := _firsts(pair)):
                nothing = [pa.nulls(len(start), pa.int64()), pa.nulls(len(start), pa.int64()), pa.nulls(len(start), pa.float64())]
                pair, times = pair[start], np.diff(start, append=len(pair))
                yield pa.RecordBatch.from_arrays([pa.array(first + pair // len(words)), *nothing, words.take(pa.array(pair % len(words))), pa.array(times)], names=columns)

    columns = ["uid", "n_tokens", "n_known", "base", "word", "times"]
    both = materialize(chunks.mapInArrow(run, "uid long, n_tokens long, n_known long, base double, word binary, times long"), "ctw-base")
    discard(chunks)
    base_of = F.log10((F.coalesce("c", F.lit(0)) + ALPHA) / floor)
    rare = both.where("word is not null").select("uid", "word", "times").join(words, "word", "left").select("uid", "times", base_of.alias("b"), F.col("c").isNotNull().cast("int").alias("k"))
    gain = lambda name: F.sum(F.col("times") * F.col(name))
    gained = rare.groupBy("uid").agg(gain("b").alias("rare_base"), gain("k").alias("rare_known"))
    joined = both.where("word is null").select("uid", "n_tokens", "n_known", "base").join(scored, "uid").join(gained, "uid", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    bits: Column = -F.col("score") * F.lit(float(np.log2(10))) / F.greatest(F.col("n_bytes"), F.lit(1))
    return joined.select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_known") + zero("rare_known")).alias("n_known"), F.lit(int(tokens)).cast("long").alias("train_tokens"),
        (F.col("base") + zero("rare_base")).alias("base_score"), "score", bits.alias("bits_per_byte"),
    )
