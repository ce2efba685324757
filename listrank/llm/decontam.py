"""Benchmark decontamination through an FM-index of each shard of the training texts."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, staged

WINDOW = 10
#: Benchmark texts that one pass holds, in bytes; a larger benchmark takes several passes.
PASS_BYTES = 32 << 20
#: Words that one index holds. A longer document still gets one index of its own.
SHARD_WORDS = 1 << 20
#: A row held for an index counts as at least one word, and as one word for so many bytes of text.
BYTES_A_WORD = 16
#: Every how many words of a run a suffix position is kept.
SAMPLE = 16
#: Windows that are searched for at once.
SEARCHED = 1 << 16

_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    """A-Z lower-cased; runs of ASCII letters, digits and everything from U+0080 on."""
    return text.translate(_TABLE).split() if text else []


class WaveletTree:
    """Ranks over an array of symbols: one bit vector a level, with running counts of its ones."""

    def __init__(self, symbols: np.ndarray, n_symbols: int):
        self.levels = max(1, int(n_symbols - 1).bit_length())
        self.ones, self.zeros = [], []
        for level in reversed(range(self.levels)):
            bit = (symbols >> level) & 1
            ones = np.zeros(len(symbols) + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(len(symbols) - int(ones[-1]))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before its position."""
        start = np.zeros_like(at)
        for k, (ones, zeros) in enumerate(zip(self.ones, self.zeros, strict=True)):
            bit = (symbol >> (self.levels - 1 - k)) & 1 == 1
            start = np.where(bit, zeros + ones[start], start - ones[start])
            at = np.where(bit, zeros + ones[at], at - ones[at])
        return at - start


class FMIndex:
    """Index of a text of words numbered from 1; 0 ends a run. Suffixes compare up to the end of their run."""

    def __init__(self, text: np.ndarray, n_words: int):
        n = len(text)
        ends = text == 0
        rank = text.astype(np.int64) + int(ends.sum())
        rank[ends] = np.arange(int(ends.sum()))
        order, step = np.argsort(rank, kind="stable"), 1
        while True:
            sorted_rank = rank[order]
            fresh = np.empty(n, np.int64)
            fresh[order] = np.concatenate([[0], np.cumsum(sorted_rank[1:] != sorted_rank[:-1])])
            if fresh[order[-1]] == n - 1:
                break
            rank = fresh * (n + 1)
            rank[: n - step] += fresh[step:] + 1
            order, step = np.argsort(rank, kind="stable"), step * 2
        before = np.where(order > 0, text[order - 1], 0).astype(np.int32)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=n_words + 1))])
        self.tree = WaveletTree(before, n_words + 1)
        self.before = before
        start = np.concatenate([[True], ends[:-1]])
        from_start = np.arange(n) - np.maximum.accumulate(np.where(start, np.arange(n), 0))
        kept = (from_start % SAMPLE == 0)[order]
        self.kept_before = np.concatenate([[0], np.cumsum(kept)])
        self.kept, self.sample = kept, order[kept]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search of phrases of one length (a row each): the range of suffixes that begin with each; 0 and 0
        where there are none. A phrase leaves the search with the first word that ends its range."""
        left = np.arange(len(phrases))
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), len(self.before), np.int64)
        for column in phrases.T[::-1]:
            symbol = column[left]
            low = self.first[symbol] + self.tree.rank(symbol, low)
            high = self.first[symbol] + self.tree.rank(symbol, high)
            stays = low < high
            left, low, high = left[stays], low[stays], high[stays]
        begin, end = np.zeros(len(phrases), np.int64), np.zeros(len(phrases), np.int64)
        begin[left], end[left] = low, high
        return begin, end

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffixes: steps back in the text until one whose position is kept."""
        at, found, steps, left = rows.copy(), np.zeros(len(rows), np.int64), 0, np.arange(len(rows))
        while len(left):
            hit = self.kept[at]
            found[left[hit]] = self.sample[self.kept_before[at[hit]]] + steps
            left, at, steps = left[~hit], at[~hit], steps + 1
            symbol = self.before[at]
            at = self.first[symbol] + self.tree.rank(symbol, at)
        return found


class Benchmark:
    """The words and distinct windows of one pass's items, as arrays: a window is the place in the items' words where it
    starts, so it costs 8 bytes and 4 for each item that has it."""

    def __init__(self, items: Iterable[tuple[int | None, bytes | None]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        names, words, n = [], [np.zeros(0, np.int32)], 0
        starts: dict[int, list[np.ndarray]] = {}
        owners: dict[int, list[np.ndarray]] = {}
        for item, text in items:
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)], np.int32)
            if not len(ids):
                continue
            size = min(window, len(ids))
            count = len(ids) - size + 1
            starts.setdefault(size, []).append(np.arange(n, n + count))
            owners.setdefault(size, []).append(np.full(count, len(names), np.int32))
            names.append(item)
            words.append(ids)
            n += len(ids)
        self.words, self.names = np.concatenate(words), names
        self.by_size = {size: self._distinct(size, np.concatenate(starts[size]), np.concatenate(owners[size])) for size in sorted(starts)}

    def _distinct(self, size: int, start: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where each distinct window starts, the first of its owners, and the owners. Windows are sorted by a hash, and
        neighbours compared word by word; equal ones that another of their hash parts stay apart, which does no harm."""
        h = np.zeros(len(start), np.uint64)
        for k in range(size):
            h = (h ^ self.words[start + k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        order = np.argsort(h, kind="stable")
        start, owner, h = start[order], owner[order], h[order]
        same = h[1:] == h[:-1]
        for k in range(size):
            same &= self.words[start[1:] + k] == self.words[start[:-1] + k]
        first = np.flatnonzero(np.concatenate([[True], ~same]))
        return start[first], np.append(first, len(owner)), owner

    def find(self, docs: list[np.ndarray]) -> list[tuple[list[tuple[int, int]], set[int | None]]]:
        """Merged spans of hit words and the items found, of each document (words as numbers, 0: not in the benchmark).
        The index holds the runs of benchmark words that a window fits in: no occurrence can lie elsewhere."""
        least = min(self.by_size, default=1)
        texts, doc_at, word_at, n = [], [], [], 0
        for k, ids in enumerate(docs):
            edge = np.flatnonzero(np.diff(np.concatenate([[0], (ids > 0).astype(np.int8), [0]])))
            for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
                if b - a >= least:
                    texts += [ids[a:b], np.zeros(1, np.int32)]
                    doc_at.append(np.full(b - a + 1, k, np.int32))
                    word_at.append(np.arange(a, b + 1))
        result: list[tuple[list[tuple[int, int]], set[int | None]]] = [([], set()) for _ in docs]
        if not texts or not self.by_size:
            return result
        index, doc_at, word_at = FMIndex(np.concatenate(texts), len(self.vocabulary)), np.concatenate(doc_at), np.concatenate(word_at)
        spans = [np.zeros((0, 3), np.int64)]
        for size, (start, first, owner) in self.by_size.items():
            for begin in range(0, len(start), SEARCHED):
                part = start[begin : begin + SEARCHED]
                low, high = index.search(self.words[part[:, None] + np.arange(size)])
                count = high - low
                which = np.repeat(np.arange(len(part)), count)
                at = index.locate(np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + low[which])
                spans.append(np.stack([doc_at[at], word_at[at], word_at[at] + size], 1).astype(np.int64))
                for key in np.unique(doc_at[at].astype(np.int64) * len(part) + which).tolist():
                    k = begin + key % len(part)
                    result[key // len(part)][1].update(self.names[o] for o in owner[first[k] : first[k + 1]].tolist())
        for doc, start, end in np.unique(np.concatenate(spans), axis=0).tolist():
            merged = result[doc][0]
            if merged and start <= merged[-1][1]:
                merged[-1] = merged[-1][0], max(end, merged[-1][1])
            else:
                merged.append((start, end))
        return result


def merge_spans(*lists: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(x for spans in lists for x in spans):
        if out and start <= out[-1][1]:
            out[-1] = out[-1][0], max(end, out[-1][1])
        else:
            out.append((start, end))
    return out


_FOUND = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("items", pa.list_(pa.int64()))])
_KIND = "struct<n_words:bigint,spans:array<struct<start:bigint,end:bigint>>,items:array<bigint>>"


def _by_number(items: Iterable[int | None]) -> list[int | None]:
    return sorted(items, key=lambda i: (i is None, i or 0))


def _pass(benchmark: Benchmark, text_at: int, shard_words: int, name: str = "found"):
    """A mapInArrow function that adds what one pass finds as the last column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[pa.RecordBatch, list[np.ndarray]]] = []
        size = 0

        def flush():
            found = iter(benchmark.find([ids for _, docs in held for ids in docs]))
            for batch, docs in held:
                rows = []
                for ids in docs:
                    spans, items = next(found)
                    rows.append({"n_words": len(ids), "spans": [{"start": a, "end": b} for a, b in spans], "items": _by_number(items)})
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, _FOUND)], names=[*batch.schema.names, name])
            held.clear()

        get = benchmark.vocabulary.get
        for whole in batches:
            for begin in range(0, whole.num_rows, 256):
                batch = whole.slice(begin, 256)
                docs = [np.array([get(w, 0) for w in words_of(t.as_py())], np.int32) for t in batch.column(text_at).cast(pa.binary())]
                held.append((batch, docs))
                texts = batch.column(text_at)
                size += max(sum(len(d) for d in docs), (pc.sum(pc.binary_length(texts)).as_py() or 0) // BYTES_A_WORD, batch.num_rows)
                if size >= shard_words:
                    yield from flush()
                    size = 0
        yield from flush()

    return run


def _merge_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the passes found for one row, as one."""
    for batch in batches:
        out = []
        for parts in batch.column(1).to_pylist():
            spans = merge_spans(*[[(s["start"], s["end"]) for s in p["spans"]] for p in parts])
            items = _by_number({i for p in parts for i in p["items"]})
            out.append({"n_words": parts[0]["n_words"], "spans": [{"start": a, "end": b} for a, b in spans], "items": items})
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, _FOUND)], names=["key", "found"])


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, pass_bytes: int = PASS_BYTES, shard_words: int = SHARD_WORDS, found_column: str = "found") -> DataFrame:
    """Adds struct(n_words, spans, items) to each row of docs: its words, the merged removal spans (word positions, end
    exclusive) of every occurrence of a benchmark window, and the ids of the items whose windows occur.

    A window is `window` consecutive words of an item; an item of fewer words, but not none, is one window. Words are
    numbered by the benchmark's vocabulary, so one shard's FM-index is small; shards are cut from the partitions as
    they stream by. The benchmark's size is measured. One of pass_bytes or less takes one pass, in which nothing is
    shuffled. A larger one is dealt by hash to as many passes as needed, which follow one another: docs are staged once,
    a pass ends with a checkpoint of what it found in the rows it found something in, and its broadcast is destroyed
    before the next one's items come to the driver. So the driver and the tasks hold one pass's items, whatever the
    benchmark's size, unless a single item is larger.

    Null text has no words. Items without an id are searched for like any other; in `items`, one null, the last, stands
    for all of them. Repeated rows each get their result; a column named like found_column is replaced."""
    spark = docs.sparkSession
    docs = docs.drop(found_column)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("binary").alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    passes = max(1, -(-total // pass_bytes))

    def shipped(k: int):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == k) if passes > 1 else items
        return spark.sparkContext.broadcast(Benchmark(((r[0], None if r[1] is None else bytes(r[1])) for r in part.toLocalIterator()), window))

    if passes == 1:
        held, at = shipped(0), docs.columns.index("text")
        schema = docs.select("*", F.lit(None).cast(_KIND).alias(found_column)).schema
        return docs.mapInArrow(lambda batches: _pass(held.value, at, shard_words, found_column)(batches), schema)
    work, _ = staged(docs.select(F.struct(*docs.columns).alias("row"), F.monotonically_increasing_id().alias("key")))
    parts = []
    for k in range(passes):
        held = shipped(k)
        texts = work.select("key", "row.text")
        found = texts.mapInArrow(lambda batches, held=held: _pass(held.value, 1, shard_words)(batches), f"key long, text string, found {_KIND}").select("key", "found")
        parts.append(cut(found if k == 0 else found.where(F.size("found.items") > 0)))
        held.destroy()
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    merged = every.groupBy("key").agg(F.collect_list("found").alias("parts")).mapInArrow(_merge_batches, f"key long, found {_KIND}")
    both = work.join(merged.withColumnRenamed("key", "_key"), F.col("key") == F.col("_key"))
    return both.select("row.*", F.col("found").alias(found_column))
