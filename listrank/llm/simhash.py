"""SimHash near-dedup with BK-trees."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, staged

SEED = 42
#: Fingerprints of one shard that meet in one task; larger shards are cut in blocks, and each pair of blocks meets.
BLOCK = 2_048
#: The same of a route of near-duplicate classes, where a pair costs a comparison of sets.
NEAR_BLOCK = 512
#: Keys of more than a block that are broadcast at most.
BROADCAST_KEYS = 1_000_000
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_MASK = (1 << 64) - 1


def shingle_hashes(text: bytes | None, words: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of `words` words (A-Z lower-cased, parted by white space, joined by spaces), repeats
    included; a shorter text is one run, and a text without words has none."""
    parts = text.translate(_LOWER).split() if text else []
    if not parts:
        return np.zeros(0, np.uint64)
    joined, ends, at = b" ".join(parts), [], -1
    for p in parts:
        at += len(p) + 1
        ends.append(at)
    starts = [0] + [e + 1 for e in ends[:-1]]
    last = max(0, len(parts) - words)
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts[: last + 1], ends[min(words, len(parts)) - 1 :], strict=True)], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is 1 where it is 1 in over half the hashes; signed, as Spark's long."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 65_536):
        counts += np.unpackbits(hashes[i : i + 65_536].view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes)).view(np.int64)[0]) if len(hashes) else 0


class BKTree:
    """Fingerprints by Hamming distance: a node's children are keyed by their distance to it."""

    def __init__(self):
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> int:
        new, at = len(self.values), 0
        self.values.append(value)
        self.children.append({})
        while new:
            d = (self.values[at] ^ value).bit_count()
            if d not in self.children[at]:
                self.children[at][d] = new
                break
            at = self.children[at][d]
        return new

    def within(self, value: int, radius: int) -> Iterator[int]:
        """Nodes within the radius. By the triangle inequality only edges within the radius of the distance matter."""
        todo = [0] if self.values else []
        while todo:
            at = todo.pop()
            d = (self.values[at] ^ value).bit_count()
            if d <= radius:
                yield at
            todo += [child for key, child in self.children[at].items() if d - radius <= key <= d + radius]


def shard_links(values: list[int], radius: int, accept=None) -> Iterator[tuple[int, int]]:
    """Index pairs that connect what a shard connects: a spanning forest of its links, never all pairs of a group."""
    tree, parent = BKTree(), list(range(len(values)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, value in enumerate(values):
        for j in tree.within(value, radius):
            a, b = root(i), root(j)
            if a != b and (accept is None or accept(i, j)):
                parent[a] = b
                yield i, j
        tree.add(value)


def connected(edges: DataFrame) -> DataFrame:
    """edges(a, b) of longs: node, root (the smallest node of its component), for every node with an edge.

    Large-star and small-star rounds: each node links its larger, then its smaller neighbours to the least of them, until
    nothing changes. Every round is checkpointed; what a node needs of its neighbours is their minimum, a partial sum."""
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        state = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state[0] == 0 or state == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = state
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least")).withColumnRenamed("a", "_a")
        large = both.join(least, F.col("a") == F.col("_a")).where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b")).where("a <> b").distinct()
        large = cut(large)
        least = large.groupBy(F.col("a").alias("_a")).agg(F.min("b").alias("least"))
        joined = large.join(least, F.col("a") == F.col("_a"))
        small = joined.where("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b")).unionByName(least.select(F.col("_a").alias("a"), F.col("least").alias("b")))
        now = cut(small.distinct())


def _fingerprint_batches(words: int, text_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [fingerprint(shingle_hashes(t.as_py(), words)) for t in batch.column(text_at).cast(pa.binary())]
            columns = [c for i, c in enumerate(batch.columns) if i != text_at]
            names = [n for i, n in enumerate(batch.schema.names) if i != text_at]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(values, pa.int64())], names=[*names, "fingerprint"])

    return run


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """docs without text, plus fingerprint (long). Texts without words have fingerprint 0."""
    rest = [f for f in docs.schema.fields if f.name not in ("text", "fingerprint")]
    docs = docs.select(*[f.name for f in rest], "text")
    schema = docs.select(*[f.name for f in rest], F.lit(0).cast("long").alias("fingerprint")).schema
    return docs.mapInArrow(_fingerprint_batches(words, len(rest)), schema)


def _groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Runs of equal keys of a sorted partition."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(batch.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
        edges = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        if held and held[-1].column(held[-1].schema.get_field_index(key))[-1].as_py() != keys[0]:
            yield pa.Table.from_batches(held)
            held = []
        for a, b in zip(edges[:-2], edges[1:-1], strict=True):
            yield pa.Table.from_batches([*held, batch.slice(a, b - a)])
            held = []
        held.append(batch.slice(edges[-2]))
    if held:
        yield pa.Table.from_batches(held)


def _large(rows: DataFrame, key: str, size: Column, most: int) -> DataFrame | None:
    """_key, _n (tasks' worth) of the keys whose values' sizes sum to more than `most`, for a broadcast; None if there are
    none. Sums are partial before the shuffle; keys are no more than the whole size divided by `most`, and counted."""
    sums = rows.groupBy(F.col(key).alias("_key")).agg(F.sum(size).alias("_sum"))
    large = cut(sums.where(F.col("_sum") > most).select("_key", F.ceil(F.col("_sum") / F.lit(most)).alias("_n")))
    n = large.count()
    if n > BROADCAST_KEYS:
        raise ValueError(f"over {BROADCAST_KEYS} keys of more than {most}: give larger blocks")
    return F.broadcast(large) if n else None


def _meet(rows: DataFrame, key: str, value: str, most: int, size: Column | None = None) -> DataFrame:
    """rows(key, value, ...): those whose key has two values or more, once for each block pair they take part in, with the
    pair's number in `task`. A key whose sizes (one a value, if not given) sum to more than `most` is cut in blocks of
    about `most` by a hash of the value, and each pair of its blocks meets. Only other keys, whose sizes are bounded, are
    counted in a window, so that no hot key comes to one task."""
    size = F.lit(1) if size is None else size
    large = _large(rows, key, size, most)
    few = rows if large is None else rows.join(large, F.col(key) == F.col("_key"), "left_anti")
    few = few.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(key))).where("_n > 1").withColumn("task", F.xxhash64(key)).drop("_n")
    if large is None:
        return few
    mine = F.pmod(F.xxhash64(F.col(value)), F.col("_n"))
    pair = F.transform(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1), lambda k: F.struct(F.least(k, mine).alias("i"), F.greatest(k, mine).alias("j")))
    many = rows.join(large, F.col(key) == F.col("_key")).withColumn("_pair", F.explode(pair))
    many = many.withColumn("task", F.xxhash64(key, "_pair.i", "_pair.j")).drop("_key", "_n", "_pair")
    return few.unionByName(many)


def _link_batches(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for group in _groups(batches, "task"):
            signed = group.column("fingerprint").to_pylist()
            for i, j in shard_links([v & _MASK for v in signed], radius):
                a.append(signed[i])
                b.append(signed[j])
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def hamming_links(distinct: DataFrame, radius: int = 2, block: int = BLOCK) -> DataFrame:
    """distinct(fingerprint): links (a, b) that connect all fingerprints within `radius` bits (2 or fewer) of each other.

    Four bands of 16 bits; two fingerprints within 2 bits agree on two bands at least, so both are dealt to the shard of
    that pair of bands. A shard builds the BK-tree of its own fingerprints and searches it as it grows; shards of one
    fingerprint end before Python, and shards over `block` are dealt again by what is left. A tree of all fingerprints would have to pass the driver to be broadcast and has no
    size bound; dealing the queries to the trees finds the same links."""
    if radius > 2:
        raise ValueError("two whole bands are sure for a radius of 2 at most")
    fp = F.col("fingerprint")
    bands = [F.shiftrightunsigned(fp, 16 * i).bitwiseAND(F.lit(0xFFFF)) for i in range(4)]
    keys = [F.lit(k << 32).cast("long").bitwiseOR(F.shiftleft(bands[i], 16)).bitwiseOR(bands[j]) for k, (i, j) in enumerate(combinations(range(4), 2))]
    rows = distinct.select(F.explode(F.array(*keys)).alias("key"), "fingerprint")
    # a shard over the block is dealt again: two within 2 bits agree on two of four parts of the 32 bits that are left,
    # so that a shard ends with 16 free bits, 65,536 fingerprints at most, whatever its copies or its size before
    large, whole = _large(rows, "key", F.lit(1), block), rows
    if large is not None:
        large = large.select("_key")
        whole = rows.join(large, F.col("key") == F.col("_key"), "left_anti")
        hot = rows.join(large, F.col("key") == F.col("_key"), "left_semi")
        for k, (i, j) in enumerate(combinations(range(4), 2)):
            rest = [b for b in range(4) if b not in (i, j)]
            bytes_left = [F.shiftrightunsigned(fp, 16 * b + 8 * half).bitwiseAND(F.lit(0xFF)) for b in rest for half in (0, 1)]
            finer = [F.xxhash64(F.col("key"), F.lit(n), bytes_left[x], bytes_left[y]) for n, (x, y) in enumerate(combinations(range(4), 2))]
            whole = whole.unionByName(hot.where(F.shiftright("key", 32) == k).select(F.explode(F.array(*finer)).alias("key"), "fingerprint"))
    dealt = _meet(whole, "key", "fingerprint", block).select("task", "fingerprint").repartition("task").sortWithinPartitions("task")
    return dealt.mapInArrow(_link_batches(radius), "a long, b long")


def components(docs: DataFrame, words: int = 3, radius: int = 2) -> DataFrame:
    """doc_id, fingerprint, component_id (the smallest doc_id reachable over links of `radius` bits or fewer), a row for
    each row of docs. Null and empty texts have fingerprint 0 and link like any other. A null doc_id takes part but is no
    component_id unless all are null; repeated rows each get a row; other columns are ignored."""
    narrow = cut(fingerprints(docs.select("doc_id", "text"), words))
    classes = cut(narrow.groupBy("fingerprint").agg(F.min("doc_id").alias("first")))
    roots = connected(hamming_links(classes.select("fingerprint"), radius))
    classes = classes.join(roots, F.col("fingerprint") == F.col("node"), "left").select("fingerprint", "first", F.coalesce("root", "fingerprint").alias("root"))
    least = classes.groupBy(F.col("root").alias("_root")).agg(F.min("first").alias("component_id"))
    named = cut(classes.join(least, F.col("root") == F.col("_root")).select(F.col("fingerprint").alias("_fp"), "component_id"))
    return narrow.join(named, F.col("fingerprint") == F.col("_fp")).select("doc_id", "fingerprint", "component_id")


#: Near duplicates by word shingles: shingle length, least Jaccard similarity, and the routes of a sketch. A pair at the
#: least similarity shares one of 8 routes of 3 minima with probability 0.997.
SHINGLE, SIMILARITY, ROUTES, MINIMA = 5, 0.8, 8, 3
#: 64 bits of shingle sets at similarity 0.8 differ in 9.7 bits with deviation 2.9; small sets spread further.
RADIUS = 24
#: Bytes of the shingle sets of a block; two blocks meet in a task.
BLOCK_BYTES = 8 << 20
#: Rows that go, up to which they are broadcast (24 bytes each).
BROADCAST_ROWS = 500_000
_RNG = np.random.default_rng(SEED)
_A = _RNG.integers(1, 1 << 63, ROUTES * MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 1 << 63, ROUTES * MINIMA, dtype=np.uint64)


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def sketch(text: bytes | None) -> tuple[int, int, list[int], bytes]:
    """Fingerprint, identity of the shingle set, routing keys and the set itself as sorted 32-bit hashes. The fingerprint
    is that of the set: counting repeats would part texts of similar sets that repeat different lines."""
    h = shingle_hashes(text, SHINGLE)
    if not len(h):
        return 0, 0, [], b""
    least = np.full(len(_A), np.iinfo(np.uint64).max, np.uint64)
    distinct = np.unique(h)
    for i in range(0, len(distinct), 8_192):
        least = np.minimum(least, (distinct[i : i + 8_192, None] * _A + _B).min(0))
    routes = [xxhash.xxh64_intdigest(least[k * MINIMA : (k + 1) * MINIMA].tobytes(), k) for k in range(ROUTES)]
    return fingerprint(distinct), _signed(xxhash.xxh64_intdigest(distinct.tobytes(), 1)), [_signed(r) for r in routes], np.unique((distinct >> np.uint64(32)).astype(np.uint32)).tobytes()


def _sketch_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for begin in range(0, batch.num_rows, 1_024):
            part = batch.slice(begin, 1_024)
            got = [sketch(t.as_py()) for t in part.column(2).cast(pa.binary())]
            columns = [pa.array([g[k] for g in got], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()))]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *columns], names=["doc_id", "text_key", "fingerprint", "set_id", "routes", "shingles"])


def _similar_batches(radius: int, similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for group in _groups(batches, "task"):
            ids = group.column("set_id").to_pylist()
            sets = [np.frombuffer(x, np.uint32) for x in group.column("shingles").to_pylist()]

            def accept(i: int, j: int, sets=sets) -> bool:
                short, long = sorted((len(sets[i]), len(sets[j])))
                if short < similarity * long:
                    return False
                both = np.concatenate([sets[i], sets[j]])
                both.sort(kind="stable")
                shared = int((both[1:] == both[:-1]).sum())
                return shared >= similarity * (len(both) - shared)

            for i, j in shard_links([v & _MASK for v in group.column("fingerprint").to_pylist()], radius, accept):
                a.append(ids[i])
                b.append(ids[j])
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def drop_near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS, block: int = NEAR_BLOCK) -> DataFrame:
    """docs with one row of each group of near duplicates: of texts linked by 5-word shingle sets of Jaccard similarity
    `similarity` or more, the row with the smallest doc_id stays (null last; repeated rows: one of them).

    Equal shingle sets are one class, whatever the number of copies. Bits of fingerprints that differ in 10 of 64 places
    can't route a class to the shards where its partners are; minima of its shingles under fixed permutations can. Each
    shard builds the BK-tree of its fingerprints, follows edges within the radius, and verifies what it meets on the
    shingle sets themselves. Texts without words are one class. What goes is told to the rows by broadcast, where its measured
    number allows, so that the texts stay where they are; else by a shuffle. Rows alike in id and text take the least
    hash of all that they hold. All columns stay; clashing names do no harm."""
    keyed = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    kind = keyed.select("doc_id", "text_key", F.lit(0).cast("long").alias("fingerprint"), F.lit(0).cast("long").alias("set_id"), F.lit(None).cast("array<long>").alias("routes"), F.lit(None).cast("binary").alias("shingles")).schema
    work, delete = staged(keyed.mapInArrow(_sketch_batches, kind))
    # a class counts by the bytes of its set, and as 1 / block of a block at least: texts of any length fill blocks alike
    routes = work.select("set_id", F.explode("routes").alias("key"), F.greatest(F.octet_length("shingles"), F.lit(-(-BLOCK_BYTES // block))).cast("long").alias("size")).distinct()
    routed = cut(_meet(routes, "key", "set_id", BLOCK_BYTES, F.col("size")).select("task", "set_id"))
    row = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), F.col("text_key").alias("text_key"))
    classes = cut(work.select("set_id", row.alias("row")).groupBy("set_id").agg(F.min("row").alias("row")))
    wanted = routed.select(F.col("set_id").alias("_set")).distinct()
    # one row stands for a class, so that its copies, however many, are not dealt to one task
    chosen = classes.join(wanted, F.col("set_id") == F.col("_set"), "left_semi").select(F.col("set_id").alias("_set"), F.col("row.doc_id").alias("_id"), F.col("row.text_key").alias("_key"))
    payload = work.join(chosen, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key"))).dropDuplicates(["_set"]).select("_set", "fingerprint", "shingles")
    dealt = routed.join(payload, F.col("set_id") == F.col("_set")).select("task", "set_id", "fingerprint", "shingles").repartition("task").sortWithinPartitions("task")
    roots = connected(dealt.mapInArrow(_similar_batches(radius, similarity), "a long, b long"))
    rows_known = cut(work.select("doc_id", "text_key"))
    delete()  # links, classes and ids are checkpointed: what follows needs the texts, no longer the sketches
    classes = classes.join(roots, F.col("set_id") == F.col("node"), "left").select(F.coalesce("root", "set_id").alias("root"), "row")
    keepers = classes.groupBy("root").agg(F.min("row").alias("row")).select(F.col("row.doc_id").alias("_id"), F.col("row.text_key").alias("_key"))
    keepers = cut(keepers)
    # losers are known by id and text; rows alike in both are told apart by a hash of all they hold, and the least stays
    every = rows_known.groupBy("doc_id", "text_key").agg(F.count(F.lit(1)).alias("n"))
    named = every.join(keepers, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key")), "left")
    gone = cut(named.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_text"), F.col("_key").isNull().alias("_lost"), "n").where("_lost or n > 1"))
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("text_key"))
    gone_side = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone
    marked = rows.join(gone_side, F.col("id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_text")), "left")
    alone = marked.where("_text is null").select("row.*")
    if gone.where("not _lost").isEmpty():
        return alone
    alike = marked.where("_text is not null and not _lost").groupBy("id", "text_key").agg(F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row"))
    return alone.unionByName(alike.select("row.*"))
