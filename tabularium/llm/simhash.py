"""SimHash near-duplicates by a binary trie's self-join.

A fingerprint's bits, from the top, are a path in a binary trie. The self-join walks
pairs of nodes together: a pair's children are the four pairs of their children, a
pair whose branches differ has one bit more of difference, and a pair over the error
budget is cut with all that is below it.

With a budget of k bits, k+1 disjoint blocks of bits leave at least one block of a
linked pair without a difference. So the trie is kept in k+1 rotations, each with
another block on top, and the subtrees under the blocks are joined with themselves:
k+1 copies of each distinct fingerprint are all that is shuffled, and no pair that
differs in its top block is visited. A pair of nodes with more than ``split_rows``
fingerprints is cut into pairs of nodes ``SPLIT_BITS`` lower, which other tasks take,
and those again until none is that large.

Linked fingerprints leave a task as stars around the smallest one of those the task
found connected, never as all pairs.

``near_duplicates`` links documents by the bits of one fingerprint. ``keep_similar`` asks
for a Jaccard similarity of word shingles, from which a fingerprint of 64 bits strays too
far for a narrow budget. It joins several tries, one for each of some fingerprints of the
distinct words. Texts with a link in any of them have their sets of shingles written to
the shared folder; the join is walked again over these texts alone, and each task reads
the sets of the pairs it meets and keeps the similar ones. Pairs that it has connected
already are passed over, and again only stars leave it.
"""

from __future__ import annotations

import uuid
from collections import OrderedDict
from collections.abc import Callable, Iterator
from fractions import Fraction
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabularium.llm.common import LOWER, file_system, located, materialize, shared_dir, trimmed, unused, utf8
from tabularium.llm.components import connected_components

SEED = 42
SPLIT_BITS = 8
#: Node pairs of at most this many fingerprint pairs are compared outright.
LEAF = 24
#: Node pairs that are expanded at once, and links held before they become stars.
FRONT, HELD = 200_000, 1_000_000
#: Near copies: words of a shingle, least similarity, fingerprints and their budget.
WIDTH, SIMILARITY, SKETCHES, SKETCH_BUDGET = 5, 0.8, 6, 3
#: Bytes of shingle sets and files that a task holds.
SETS_HELD, FILES_HELD = 16 << 20, 64
#: The bit map of places has this power of two of bits (4 MB).
SLOTS = 25


def fingerprint(text: bytes | None, width: int = 3) -> int:
    """The unsigned 64-bit fingerprint of a text's word shingles; 0 without words."""
    import xxhash

    words = (text or b"").translate(LOWER).split()
    if not words:
        return 0
    if len(words) < width:
        shingles = iter([b" ".join(words)])
        n = 1
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))
        n = len(words) - width + 1
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(s, SEED) for s in shingles), np.uint64, n)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        part = hashes[at : at + (1 << 16)]
        bits = np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), width: int = 3) -> DataFrame:
    """The columns ``keep`` and ``fp`` (the fingerprint as a signed long) for every row."""
    import pyspark.sql.types as T

    src = docs.select(*keep, F.col(text_col).alias("__text"))
    schema = T.StructType([*(src.schema[c] for c in keep), T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t, width) for t in utf8(b, "__text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), pa.array(fp)], names=[*keep, "fp"])

    return src.mapInArrow(trimmed(run), schema)


def _stars(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links as (member, smallest member) of each connected group."""
    nodes, at = np.unique(np.concatenate([i, j]), return_inverse=True)
    a, b = at[: len(i)], at[len(i) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    other = root != np.arange(len(nodes))
    return nodes[other], nodes[root[other]]


def trie_links(keys: np.ndarray, al, ah, bl, bh, diff, bit: int, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links of the sorted distinct ``keys`` below the given node pairs, as pairs of positions.

    A node is a range of ``keys`` that agree in their first ``bit`` bits; a node paired
    with itself has equal ranges. ``diff`` counts the bits in which a pair's paths differ.
    """
    stack = [(bit, *(np.asarray(x, np.int64) for x in (al, ah, bl, bh, diff)))]
    while stack:
        bit, al, ah, bl, bh, d = stack.pop()
        if len(al) > FRONT:
            half = len(al) // 2
            stack.append((bit, al[half:], ah[half:], bl[half:], bh[half:], d[half:]))
            al, ah, bl, bh, d = al[:half], ah[:half], bl[:half], bh[:half], d[:half]
            stack.append((bit, al, ah, bl, bh, d))
            continue
        na, nb, own = ah - al, bh - bl, al == bl
        live = ~(own & (na == 1))
        small = live & ((na * nb <= LEAF) | (bit >= 64))
        if small.any():
            a0, b0, wide = al[small], bl[small], nb[small]
            reps = na[small] * wide
            pair = np.repeat(np.arange(len(reps)), reps)
            k = np.arange(len(pair)) - np.repeat(np.cumsum(reps) - reps, reps)
            i, j = a0[pair] + k // wide[pair], b0[pair] + k % wide[pair]
            ok = (i < j) & (np.bitwise_count(keys[i] ^ keys[j]) <= budget)
            if ok.any():
                yield i[ok], j[ok]
        go = live & ~small
        if not go.any():
            continue
        al, ah, bl, bh, d, own = al[go], ah[go], bl[go], bh[go], d[go], own[go]
        top = np.uint64(64 - bit)
        one = np.uint64(1) << np.uint64(63 - bit)
        head = lambda x: (keys[x] >> top << top) if bit else np.zeros(len(x), np.uint64)
        am = np.clip(np.searchsorted(keys, head(al) | one), al, ah)
        bm = np.where(own, am, np.clip(np.searchsorted(keys, head(bl) | one), bl, bh))
        kids = [
            (al, am, bl, bm, d, None),
            (am, ah, bm, bh, d, None),
            (al, am, bm, bh, d + 1, None),
            (am, ah, bl, bm, d + 1, ~own),
        ]
        parts = []
        for x in kids:
            ok = (x[0] < x[1]) & (x[2] < x[3]) & (x[4] <= budget)
            if x[5] is not None:
                ok &= x[5]
            parts.append([y[ok] for y in x[:5]])
        nxt = [np.concatenate(x) for x in zip(*parts, strict=True)]
        if len(nxt[0]):
            stack.append((bit + 1, *nxt))


def _as_stars(found: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The links' stars; at most about ``HELD`` links are held at a time."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for x in found:
        held.append(x)
        if sum(len(i) for i, _ in held) > HELD:
            held = [_stars(*(np.concatenate(x) for x in zip(*held, strict=True)))]
            if len(held[0][0]) > HELD // 2:
                yield held.pop()
    if held:
        yield _stars(*(np.concatenate(x) for x in zip(*held, strict=True)))


def _cells(keys: np.ndarray, depth: int, lo: np.ndarray, hi: np.ndarray, budget: int) -> Iterator[tuple[np.ndarray, Iterator]]:
    """For cells of one depth, sorted by (lo, hi): an order of the rows and the links of the rows so ordered.

    A cell joins the nodes lo and hi at that depth; cells that join a node with itself
    are disjoint subtrees and are walked together.
    """
    same = np.flatnonzero(lo == hi)
    if len(same):
        by = same[np.argsort(keys[same])]
        part = keys[by]
        at = np.flatnonzero(np.r_[True, lo[by][1:] != lo[by][:-1]])
        to = np.r_[at[1:], len(part)]
        yield by, trie_links(part, at, to, at, to, np.zeros(len(at), np.int64), depth, budget)
    other = np.flatnonzero(lo != hi)
    if not len(other):
        return
    starts = np.flatnonzero(np.r_[True, (lo[other][1:] != lo[other][:-1]) | (hi[other][1:] != hi[other][:-1])])
    for x, y in zip(starts, np.r_[starts[1:], len(other)], strict=True):
        by = other[x:y][np.argsort(keys[other[x:y]])]
        part = keys[by]
        # The unsigned path of hi is behind that of lo, so lo's rows come first.
        cut = int(np.searchsorted(part >> np.uint64(64 - depth), np.uint64(hi[by[0]].view(np.uint64)))) if depth < 64 else 1
        if 0 < cut < len(part):
            diff = int(np.bitwise_count(lo[by[0]] ^ hi[by[0]]))
            yield by, trie_links(part, [0], [cut], [cut], [len(part)], [diff], depth, budget)


def _rotate(x, by: int):
    return x if by == 0 else F.shiftleft(x, by).bitwiseOR(F.shiftrightunsigned(x, 64 - by))


def _split(rows: DataFrame, depth: int, budget: int, carry: tuple[str, ...]) -> DataFrame:
    """Rows of cells of one depth, dealt to the pairs of nodes up to ``SPLIT_BITS`` lower within the budget."""
    step = min(SPLIT_BITS, 64 - depth)
    masks = [sum(1 << i for i in c) for k in range(min(budget, step) + 1) for c in combinations(range(step), k)]
    own = F.shiftrightunsigned("key", 64 - depth - step).bitwiseAND(F.lit((1 << step) - 1))
    on_lo = F.shiftrightunsigned("key", 64 - depth) == F.col("lo")
    left = budget - F.bit_count(F.col("lo").bitwiseXOR(F.col("hi")))
    dealt = rows.withColumns({"own": own, "on_lo": on_lo, "left": left}).withColumn("mask", F.explode(F.array(*(F.lit(m).cast("long") for m in masks))))
    dealt = dealt.where(F.bit_count("mask") <= F.col("left"))
    far = F.col("own").bitwiseXOR(F.col("mask"))
    twin = F.col("lo") == F.col("hi")
    low = F.when(twin, F.least("own", far)).when(F.col("on_lo"), F.col("own")).otherwise(far)
    high = F.when(twin, F.greatest("own", far)).when(F.col("on_lo"), far).otherwise(F.col("own"))
    return dealt.select(
        "blk", "key", *carry, F.lit(depth + step).alias("depth"),
        F.shiftleft("lo", step).bitwiseOR(low).alias("lo"), F.shiftleft("hi", step).bitwiseOR(high).alias("hi"),
    )


CELL = ("blk", "depth", "lo", "hi")


Ends = tuple[np.ndarray, np.ndarray]


def links(
    prints: DataFrame, budget: int = 2, split_rows: int = 50_000, chunk_rows: int = 200_000, carry: tuple[str, ...] = (),
    stars: Callable[[], Callable[[Iterator[Ends], list[np.ndarray]], Iterator[Ends]]] | None = None,
) -> DataFrame:
    """Edges (family, u, v) that connect all fingerprints (family int, fp long) of a family at most ``budget`` bits apart.

    By default they are stars over the distinct fingerprints of what a task found
    connected: the ends need not be linked themselves, but only a chain of links joins
    them. ``stars``, called once a task, gives a function that turns links (positions i
    and j) into edges by the columns ``carry`` (longs); fingerprints may repeat then.
    """
    n, bits = budget + 1, 64 // (budget + 1)
    turned = F.explode(F.array(*(F.struct(F.lit(b).alias("b"), _rotate(F.col("fp"), b * bits).alias("key")) for b in range(n))))
    rows = prints.select("family", *carry, turned.alias("c"))
    top = F.shiftrightunsigned("c.key", 64 - bits)
    rows = rows.select((F.col("family") * n + F.col("c.b")).alias("blk"), "c.key", *carry, F.lit(bits).alias("depth"), top.alias("lo"), top.alias("hi"))
    depth = bits
    while depth < 64:
        hot = materialize(rows.where(F.col("depth") == depth).groupBy(*CELL).count().where(F.col("count") > split_rows).select(*CELL))
        if hot.isEmpty():
            break
        rows = materialize(rows.join(hot, [*CELL], "left_anti").unionByName(_split(rows.join(hot, [*CELL], "left_semi"), depth, budget, carry)))
        depth += min(SPLIT_BITS, 64 - depth)
    cells = rows.select(*CELL, "key", *carry).repartition(*CELL).sortWithinPartitions(*CELL)

    def solve(part: list[np.ndarray], edges) -> Iterator[pa.RecordBatch]:
        for blk, depth in sorted({*zip(part[0].tolist(), part[1].tolist(), strict=True)}):
            pick = (part[0] == blk) & (part[1] == depth)
            lo, hi, key, *other = (x[pick] for x in part[2:])
            family, b = divmod(blk, n)
            for by, found in _cells(key.view(np.uint64), depth, lo, hi, budget):
                keys = key[by].view(np.uint64)

                def once(found=found, keys=keys, b=b):
                    """A link belongs to the first block of bits in which its ends agree."""
                    for i, j in found:
                        d = _back(keys[i] ^ keys[j], b * bits)
                        ok = np.ones(len(i), bool)
                        for e in range(b):
                            ok &= (d >> np.uint64(64 - (e + 1) * bits)) & np.uint64((1 << bits) - 1) != 0
                        if ok.any():
                            yield i[ok], j[ok]

                if edges:
                    pairs = edges(once(), [x[by] for x in other])
                else:
                    pairs = ([_back(keys[x], b * bits).view(np.int64) for x in ends] for ends in _as_stars(once()))
                for u, v in pairs:
                    if len(u):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(u), family, np.int32)), pa.array(u), pa.array(v)], names=["family", "u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = stars() if stars else None
        held: list[list[np.ndarray]] = []
        rows, wanted = 0, chunk_rows
        for b in batches:
            held.append([b.column(i).to_numpy(zero_copy_only=False) for i in range(5 + len(carry))])
            rows += b.num_rows
            if rows < wanted:
                continue
            rest = [np.concatenate(x) for x in zip(*held, strict=True)]
            same = np.logical_and.reduce([x == x[-1] for x in rest[:4]])
            cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
            if cut:
                yield from solve([x[:cut] for x in rest], edges)
            held = [[x[cut:] for x in rest]]
            rows -= cut
            wanted = max(chunk_rows, 2 * rows)
        if rows:
            yield from solve([np.concatenate(x) for x in zip(*held, strict=True)], edges)

    return cells.mapInArrow(trimmed(run, 0), "family int, u long, v long")


def _back(x: np.ndarray, by: int) -> np.ndarray:
    """``x`` rotated to the right."""
    return (x >> np.uint64(by)) | (x << np.uint64(64 - by)) if by else x


def classes(fps: DataFrame, id_col: str = "doc_id", budget: int = 2, split_rows: int = 50_000) -> DataFrame:
    """(fp, root, first_id) of every distinct fingerprint: its component's root and smallest id."""
    by_fp = materialize(fps.groupBy("fp").agg(F.min(id_col).alias("first")))
    roots = connected_components(links(by_fp.select(F.lit(0).alias("family"), "fp"), budget, split_rows).select("u", "v"))
    every = by_fp.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    # Written before the join: Spark splits a skewed join only between plain shuffles.
    first = materialize(every.groupBy("root").agg(F.min("first").alias("first_id")))
    return every.drop("first").join(first, "root")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = 2, split_rows: int = 50_000) -> DataFrame:
    """One row per document: id, fingerprint (16 hex digits) and component_id.

    component_id is the smallest id that links reach, the document itself included.
    Null and wordless texts have fingerprint zero and link like any other. Rows with
    a null id keep their fingerprint and get the smallest known id of their component,
    null if there is none. Repeated rows give repeated results; other columns of
    ``docs`` are ignored; an empty table gives no rows.
    """
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    fps = materialize(fingerprints(src, "text", ("id",)))
    group = classes(fps, "id", budget, split_rows)
    return fps.join(group, "fp", "left").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("first_id").alias("component_id")
    )


def word_sketches(text: bytes | None, n: int = SKETCHES) -> tuple[int, np.ndarray]:
    """A 64-bit digest of the text's words in order, and ``n`` fingerprints of its distinct words.

    A fingerprint's bit is 1 if set in over half the words' hashes; each fingerprint has
    a family of hashes of its own, made from a word's XXH64 by SplitMix64's finaliser.
    """
    import xxhash

    words = (text or b"").translate(LOWER).split()
    key = xxhash.xxh64_intdigest(b" ".join(words), SEED)
    own = set(words)
    h = np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in own), np.uint64, len(own))
    counts = np.zeros((n, 64), np.int64)
    step = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for at in range(0, len(h), 1 << 13):
        x = h[at : at + (1 << 13), None] + step
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x = (x ^ (x >> np.uint64(31))).astype("<u8")
        counts += np.unpackbits(x.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32).reshape(n, 64)
    return key, np.packbits(2 * counts > len(h), axis=1, bitorder="little").view("<u8")[:, 0]


def shingle_set(text: bytes | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles; one shingle if it has fewer words than ``width``, none without words."""
    import xxhash

    words = (text or b"").translate(LOWER).split()
    n = max(1, len(words) - width + 1) if words else 0
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(b" ".join(words[k : k + width]), SEED) for k in range(n)), np.uint64, n).view(np.int64))


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, parts)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int64), *parts])))


def _read(src: DataFrame, places: DataFrame) -> DataFrame:
    """(key, text) of the texts at (key, file, row). A bit map of their places, 2^SLOTS bits
    however many they are, keeps most others out of the join's shuffle."""

    def slot() -> Column:
        return F.shiftrightunsigned(F.xxhash64("file", "row"), 64 - SLOTS)

    bit = F.call_function("shiftleft", F.lit(1).cast("long"), slot().bitwiseAND(F.lit(31)).cast("int"))
    words = places.groupBy(F.shiftright(slot(), 5).alias("w")).agg(F.bit_or(bit).alias("b")).toArrow()
    bits = np.zeros(1 << SLOTS - 5, np.uint32)
    bits[words.column("w").to_numpy()] = words.column("b").to_numpy()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = b.column(3).to_numpy()
            yield b.select([0, 1, 2]).filter(pa.array(bits[s >> 5] >> (s & 31).astype(np.uint32) & 1 == 1))

    rows = src.select("file", "row", "text", slot().alias("s")).mapInArrow(trimmed(run), "file long, row long, text string")
    return rows.join(places, ["file", "row"]).select("key", "text")


class Sets:
    """Sets of shingle hashes in the shared folder, read by their byte ranges; the last ones used are held."""

    def __init__(self, uri: str):
        self.store, self.root = file_system(uri)
        self.files: OrderedDict = OrderedDict()
        self.known: OrderedDict[tuple[int, int], np.ndarray] = OrderedDict()
        self.held = 0

    def get(self, segment: int, offset: int, size: int) -> np.ndarray:
        at = segment, offset
        if at in self.known:
            self.known.move_to_end(at)
            return self.known[at]
        if segment not in self.files:
            self.files[segment] = self.store.open_input_file(f"{self.root}/{segment:016x}")
            if len(self.files) > FILES_HELD:
                self.files.popitem(last=False)[1].close()
        self.files.move_to_end(segment)
        out = self.known[at] = np.frombuffer(self.files[segment].read_at(size, offset), "<i8")
        self.held += size
        while self.held > SETS_HELD and len(self.known) > 2:
            self.held -= self.known.popitem(last=False)[1].nbytes
        return out


def write_sets(texts: DataFrame, uri: str, width: int = WIDTH) -> DataFrame:
    """Writes the shingle sets of rows (key, text) below ``uri``; (key, digest, segment, offset, size) of each.

    Files get names that no other attempt uses; nothing reads what a lost attempt left.
    """
    import xxhash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = file_system(uri)
        segment, at, out = uuid.uuid4().int >> 65, 0, None
        try:
            for b in batches:
                rows = []
                for x in utf8(b, "text"):
                    raw = shingle_set(x, width).astype("<i8").tobytes()
                    out = out or store.open_output_stream(f"{root}/{segment:016x}", compression=None)
                    out.write(raw)
                    rows.append((xxhash.xxh3_64_intdigest(raw) - (1 << 63), segment, at, len(raw)))
                    at += len(raw)
                if rows:
                    yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in zip(*rows, strict=True))], names=["key", "digest", "segment", "offset", "size"])
        finally:
            if out:
                out.close()

    store, root = file_system(uri)
    store.create_dir(root, recursive=True)
    return materialize(texts.select("key", "text").mapInArrow(trimmed(run), "key long, digest long, segment long, offset long, size long"))


def similar_stars(uri: str, t: Fraction) -> Callable[[], Callable[[Iterator[Ends], list[np.ndarray]], Iterator[Ends]]]:
    """For ``links`` that carry (id, segment, offset, size): stars of ids that links of similar sets connect."""
    p, q = t.numerator, t.denominator

    def begin():
        sets = Sets(uri)

        def edges(found: Iterator[Ends], carried: list[np.ndarray]) -> Iterator[Ends]:
            ids, segment, offset, size = carried
            root = np.arange(len(ids))

            def find(x: int) -> int:
                while root[x] != x:
                    root[x] = root[root[x]]
                    x = root[x]
                return x

            def alike(a: int, b: int) -> bool:
                x, y = (sets.get(int(segment[k]), int(offset[k]), int(size[k])) for k in (a, b))
                return len(np.intersect1d(x, y, assume_unique=True)) * (p + q) >= (len(x) + len(y)) * p

            for i, j in found:
                sized = np.maximum(size[i], size[j]) * p <= np.minimum(size[i], size[j]) * q
                by = np.flatnonzero(sized)[np.lexsort((j[sized], i[sized]))]
                i, j = i[by], j[by]
                while len(i):
                    apart = root[i] != root[j]  # connected pairs with unequal roots are found below
                    i, j = i[apart], j[apart]
                    for a, b in zip(i[:4096].tolist(), j[:4096].tolist(), strict=True):
                        u, v = find(a), find(b)
                        if u != v and alike(a, b):
                            root[max(u, v)] = min(u, v)
                    i, j = i[4096:], j[4096:]
                    while (root != root[root]).any():
                        root = root[root]
            other = root != np.arange(len(ids))
            yield ids[other], ids[root[other]]

        return edges

    return begin


def _similar(texts: DataFrame, places: DataFrame, src: DataFrame, width: int, t: Fraction, budget: int, split_rows: int) -> DataFrame:
    """Edges (u, v) between keys that connect all pairs that a trie links and the sets confirm.

    ``texts`` has (key, fps), a row for each; ``places`` where in ``src`` a key's text is.
    """
    rows = materialize(texts.select("key", F.posexplode("fps").alias("family", "fp")))
    counted = materialize(rows.groupBy("family", "fp").agg(F.count("*").alias("k")))
    stars = links(counted.select("family", "fp"), budget, split_rows)
    met = stars.select("family", F.explode(F.array("u", "v")).alias("fp")).unionByName(counted.where("k > 1").select("family", "fp"))
    keys = materialize(rows.join(materialize(met.distinct()), ["family", "fp"], "left_semi").select("key").distinct())
    uri = shared_dir(src.sparkSession)
    # Written first: with both steps in one stage a task would hold two Python workers.
    sets = write_sets(materialize(_read(src, materialize(places.join(keys, "key")))), uri, width)
    heads = materialize(sets.groupBy("digest").agg(F.min("key").alias("head")))
    equal = sets.join(heads, "digest").where(F.col("key") != F.col("head")).select(F.col("key").alias("u"), F.col("head").alias("v"))
    carry = ("id", "segment", "offset", "size")
    first = materialize(sets.join(heads, F.col("key") == F.col("head"), "left_semi"))
    again = materialize(rows.join(first, "key").select("family", "fp", F.col("key").alias("id"), *carry[1:]))
    return links(again, budget, split_rows, carry=carry, stars=similar_stars(uri, t)).select("u", "v").unionByName(equal)


def _survivors(docs: DataFrame, id_col: str, text_col: str, rooted: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows of ``docs``, one of each group: that with the smallest id, of equal ids or without
    any the first by file and row. ``rooted`` gives (id, file, row, root) for (id, text, file, row).
    """
    file, row = unused(docs.columns, "file"), unused(docs.columns, "row")
    at = located(docs, file, row)
    src = at.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(file).alias("file"), F.col(row).alias("row"))
    rows = rooted(src)
    first = materialize(rows.groupBy("root").agg(F.min(_order()).alias("w")).select("w.file", "w.row"))
    losers = materialize(rows.select("file", "row").join(first, ["file", "row"], "left_anti"))
    return at.join(losers.select(F.col("file").alias(file), F.col("row").alias(row)), [file, row], "left_anti").select(*_plain(docs))


def _order() -> Column:
    return F.struct(F.col("id").isNull().alias("n"), "id", "file", "row")


def _plain(docs: DataFrame) -> list[Column]:
    return [F.col(f"`{c.replace('`', '``')}`") for c in docs.columns]


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = 2) -> DataFrame:
    """The rows of ``docs``, one of each component that ``near_duplicates`` finds: that with the smallest id.

    Null and wordless texts have fingerprint zero and link like any other. Among rows that
    share the smallest id (or when all ids are null) the first by file and row stays.
    Columns of any name come through; an empty table gives no rows. The texts are not
    shuffled unless the losers are too many to broadcast.
    """

    def rooted(src: DataFrame) -> DataFrame:
        fps = materialize(fingerprints(src, "text", ("id", "file", "row")))
        return materialize(fps.join(classes(fps, "id", budget).select("fp", "root"), "fp"))

    return _survivors(docs, id_col, text_col, rooted)


def keep_similar(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, similarity: float = SIMILARITY,
    sketches: int = SKETCHES, budget: int = SKETCH_BUDGET, split_rows: int = 50_000,
) -> DataFrame:
    """The rows of ``docs``, one of each group that near copies connect: that with the smallest id.

    Near copies are texts whose sets of ``width`` lower-case words have a Jaccard similarity
    of at least ``similarity``, and whose distinct words' fingerprints are at most ``budget``
    bits apart in one of ``sketches`` families: each such pair is compared by its whole sets,
    and pairs that all families put further apart are missed. Equal word sequences are always one group, so
    null and wordless texts are copies of each other; a text with fewer words than ``width``
    is one shingle. Among rows that share the smallest id (or when all ids are null) the
    first by file and row stays. Columns of any name come through; an empty table gives no
    rows.
    """
    t = Fraction(similarity).limit_denominator(10_000)

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [word_sketches(x, sketches) for x in utf8(b, "text")]
            key = pa.array(np.array([k for k, _ in got], np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(3)), key, _lists([f.view(np.int64) for _, f in got])], names=["id", "file", "row", "key", "fps"])

    def rooted(src: DataFrame) -> DataFrame:
        id_type = src.schema["id"].dataType.simpleString()
        kept = src.select("id", "file", "row", "text").mapInArrow(trimmed(marks), f"id {id_type}, file long, row long, key long, fps array<long>")
        rows = materialize(kept)
        texts = materialize(rows.groupBy("key").agg(F.min(_order()).alias("w"), F.max("fps").alias("fps")))
        places = texts.select("key", "w.file", "w.row")
        roots = connected_components(_similar(texts.select("key", "fps"), places, src, width, t, budget, split_rows)).withColumnRenamed("node", "key")
        grouped = materialize(texts.join(roots, "key").select("key", "root"))
        return rows.join(grouped, "key", "left").select("id", "file", "row", F.coalesce("root", "key").alias("root"))

    return _survivors(docs, id_col, text_col, rooted)
