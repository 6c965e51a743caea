"""Near-duplicate documents by banded MinHash, odd sketches and exact confirmation.

1. Each text gives the set of its hashed word shingles, `BANDS` keys of `ROWS` MinHash values each, and an odd sketch:
   the set's one-permutation MinHash samples folded into a parity bitmap. Two sketches' XOR has about as many bits as
   their samples differ in, so its population count estimates a high similarity far better than the band keys' few values.
2. Documents with the same set are one class, its smallest identifier the representative; only those go on.
3. In every bucket (equal band key) each member meets the bucket's smallest member: as many pairs as members. Pairs that
   the sketches do not rule out are confirmed on the full sets of both whole texts.
4. Where a bucket's other members still lie in several components, those outside its largest component are strays. While
   that is many comparisons, the bucket's smallest stray meets all members of other components, as in 3, and is done
   with; each such round may connect most of what is left. Then strays are compared with the members in blocks bounded
   in rows and in shingles, by sketch first, then exactly, most similar first, skipping what is connected already. So
   every pair in a bucket is either tested, ruled out, or known to be connected, and only connecting links are emitted;
   members of the largest component, however many, are not compared with one another.
5. Components by large and small stars.

A link at similarity 0.8 is in no common bucket with probability (1 - 0.8 ** ROWS) ** BANDS, 0.000015.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, carried, dropped, written
from .components import Forest, components

ROWS, BANDS = 5, 28
#: Bins of the one-permutation samples and bits of the odd sketch.
BINS, BITS = 1024, 2048
#: Standard deviations that the sketches' verdict leaves to chance.
SLACK = 5.0
#: A block of strays or members holds about so many rows, and so many shingles, at most.
BLOCK, BLOCK_SHINGLES = 512, 400_000
#: Rounds of pivots go on while strays times members are more than so many times the rows, and while they help.
PIVOT_WORK = 256
#: Rows that a task gives out at once.
ROWS_OUT = 512
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3], np.uint64)


def _scrambled(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


class Words(dict):
    """64-bit hashes of words, kept for those seen lately."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 50_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def windows(h: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """One hash for each k consecutive word hashes, in order."""
    total = np.full(max(len(h) - k + 1, 0), (k + seed) % (1 << 64), np.uint64)
    for i in range(k):
        total = _scrambled(total + h[i : i + len(total)] * _MIX[i % len(_MIX)])
    return total


def shingles(text: bytes | None, n: int, words: Words) -> np.ndarray:
    """The sorted distinct hashes of a UTF-8 text's n-word shingles; of the whole sequence where it has fewer words."""
    found = text.translate(_LOWER).split() if text else []
    if not found:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(words.__getitem__, found), np.uint64, len(found))
    return np.unique(windows(h, min(n, len(h))))


def _multipliers() -> np.ndarray:
    i = np.arange(1, ROWS * BANDS + 1, dtype=np.uint64)
    return _scrambled(i * _MIX[0]) | np.uint64(1)


def band_keys(s: np.ndarray, multipliers: np.ndarray) -> np.ndarray:
    least = np.full(len(multipliers), np.uint64(0xFFFFFFFFFFFFFFFF))
    for at in range(0, len(s), 1024):
        x = s[at : at + 1024, None] * multipliers
        least = np.minimum(least, (x ^ (x >> np.uint64(31))).min(axis=0))
    rows = _scrambled(least).reshape(BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for i in range(ROWS):
        key = _scrambled(key * _MIX[1] + rows[:, i])
    return key.view(np.int64)


def odd_sketch(s: np.ndarray) -> tuple[np.ndarray, int]:
    """(parity bitmap, number of samples)"""
    x = _scrambled(s * _MIX[2])
    bins = (x >> np.uint64(54)).astype(np.int64) % BINS
    least = np.full(BINS, np.uint64(0xFFFFFFFFFFFFFFFF))
    np.minimum.at(least, bins, x)
    samples = least[least != np.uint64(0xFFFFFFFFFFFFFFFF)]
    bits = np.bincount((_scrambled(samples * _MIX[3]) % np.uint64(BITS)).astype(np.int64), minlength=BITS) & 1
    return np.packbits(bits.astype(np.uint8)), len(samples)


def may_link(n_a, n_b, samples_a, samples_b, differing, similarity: float):
    """Whether sketches with so many differing bits leave a similarity of at least `similarity` possible (arrays or numbers).

    At that similarity the union has (n_a + n_b) / (1 + similarity) shingles, of which about `union` are samples; the
    samples in common, and then the bits, vary about their expectation; SLACK deviations of both are granted.
    """
    whole = (n_a + n_b) / (1 + similarity)
    union = BINS * -np.expm1(-whole / BINS)
    spread = similarity * (1 - similarity) * union * (1 - union / whole) + 0.25 * union * (1 - union / BINS) * (union / BINS) + 1
    differ = np.maximum(samples_a + samples_b - 2 * similarity * union, 0) + 2 * SLACK * np.sqrt(spread)
    bits = BITS / 2 * -np.expm1(-2 * differ / BITS) + SLACK * np.sqrt(np.minimum(2 * differ**2 / BITS + 1, BITS / 4))
    fits = np.minimum(n_a, n_b) >= similarity * np.maximum(n_a, n_b) - 1e-9
    return fits & (differing <= bits)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    small, large = sorted((len(a), len(b)))
    if not small or 100 * small < percent * large:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (small + large - both)


def _utf8(column: pa.Array) -> Iterator[bytes | None]:
    """The texts as bytes, one at a time."""
    return (x.as_py() for x in column.cast(pa.binary()))


def _features(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, multipliers = Words(), _multipliers()
        types = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.list_(pa.int64())]
        names = ["id", "n", "set", "sketch", "samples", "bands"]
        for b in batches:
            for at in range(0, b.num_rows, ROWS_OUT):
                part, rows = b.slice(at, ROWS_OUT), []
                for i, text in zip(part.column(0).to_pylist(), _utf8(part.column(1))):
                    s = shingles(text, n, words)
                    if not len(s):
                        rows.append((i, 0, None, None, 0, None))
                        continue
                    sketch, samples = odd_sketch(s)
                    rows.append((i, len(s), xxhash.xxh3_128_digest(s.tobytes()), sketch.tobytes(), samples, band_keys(s, multipliers)))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return run


def _sketches(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, BITS // 64)


def _possible(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x, y = _sketches(b["sketch"]), _sketches(b["_sketch"])
            differing = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
            ok = may_link(*(b[c].to_numpy().astype(float) for c in ("n", "_n", "samples", "_samples")), differing, similarity)
            yield b.select(["a", "b"]).filter(pa.array(ok))

    return run


def _confirmed(n: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, last, kept = Words(), None, None
        for b in batches:
            ok = []
            for one, x, y in zip(b["a"].to_pylist(), _utf8(b["_text_a"]), _utf8(b["_text_b"])):
                if (one, x) != last:  # rows come sorted by a
                    last, kept = (one, x), shingles(x, n, words)
                ok.append(linked(kept, shingles(y, n, words), percent))
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def _pairs_of(table: pa.Table, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows (i, j) in different components that the sketches do not rule out, most alike first; across chunks only where
    the block is of two chunks."""
    ids, chunk, component = (np.array(table[c]) for c in ("id", "chunk", "component"))
    n, samples = (np.array(table[c], float) for c in ("n", "samples"))
    sketches = _sketches(table["sketch"].combine_chunks())
    across = chunk.min() != chunk.max()
    found, counts = [], []
    for i in range(len(ids) - 1):
        rest = np.arange(i + 1, len(ids))
        rest = rest[(component[rest] != component[i]) & (ids[rest] != ids[i])]
        if across:
            rest = rest[chunk[rest] != chunk[i]]
        if len(rest):
            differing = np.bitwise_count(sketches[rest] ^ sketches[i]).sum(axis=1, dtype=np.int64)
            ok = may_link(n[rest], n[i], samples[rest], samples[i], differing, similarity)
            found.append(np.stack([np.full(ok.sum(), i), rest[ok]]))
            counts.append(differing[ok])
    if not found:
        return np.empty(0, int), np.empty(0, int)
    pairs, counts = np.concatenate(found, axis=1), np.concatenate(counts)
    pairs = pairs[:, np.argsort(counts, kind="stable")]
    return pairs[0], pairs[1]


def _blocks(others: DataFrame, mixed: DataFrame) -> DataFrame:
    """(k, lo, hi, chunk, id, component): every pair of a bucket's strays, and of a stray and another member, meets in one
    block (k, lo, hi) of two chunks (or one). Strays are dealt into the chunks from 0 on, the others into those behind."""
    spread = lambda rows, size: F.greatest(F.ceil(F.col(rows) / BLOCK), F.ceil(F.col(size) / BLOCK_SHINGLES), F.lit(1)).cast("long")
    m = others.join(mixed.withColumn("few", spread("strays", "stray_size")).withColumn("many", spread("rest", "rest_size")), "k")
    stray, number = F.col("component") != F.col("major"), F.xxhash64("id")
    m = m.withColumn("chunk", F.when(stray, F.pmod(number, F.col("few"))).otherwise(F.col("few") + F.pmod(number, F.col("many"))))
    m = m.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.when(stray, F.col("few") + F.col("many")).otherwise(F.col("few")) - 1)))
    return m.select("k", F.least("chunk", "other").alias("lo"), F.greatest("chunk", "other").alias("hi"), "chunk", "id", "component")


def _mixed(others: DataFrame) -> DataFrame:
    """(k, major, strays, stray_size, rest, rest_size) of the buckets whose members lie in several components: the largest
    of them, and the rows and shingles outside and inside it."""
    parts = others.groupBy("k", "component").agg(F.count("*").alias("rows"), F.sum("n").alias("size"))
    of = parts.groupBy("k").agg(F.sum("rows").alias("rows"), F.sum("size").alias("size"), F.max(F.struct("rows", "component", "size")).alias("top")).filter("rows > top.rows")
    return of.select("k", F.col("top.component").alias("major"), (F.col("rows") - F.col("top.rows")).alias("strays"), (F.col("size") - F.col("top.size")).alias("stray_size"), F.col("top.rows").alias("rest"), F.col("top.size").alias("rest_size"))


def near_links(df: DataFrame, reps: DataFrame, id_col: str, text_col: str, n: int, percent: int) -> DataFrame:
    """(a, b): links that connect whatever is connected among the representatives (id, n, sketch, samples, bands)."""
    similarity = percent / 100
    texts = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    sketches = reps.select("id", "n", "sketch", "samples")
    sides = [sketches.withColumnRenamed("id", "b"), sketches.select(F.col("id").alias("a"), F.col("n").alias("_n"), F.col("sketch").alias("_sketch"), F.col("samples").alias("_samples"))]

    def tested(met: DataFrame) -> DataFrame:
        """Those of the pairs (a, b) that are links."""
        pairs = written(met.distinct().join(sides[0], "b").join(sides[1], "a").mapInArrow(_possible(similarity), "a bigint, b bigint"), "pairs")
        both = pairs.join(texts.select(F.col("_id").alias("b"), F.col("_text").alias("_text_b")), "b").join(texts.select(F.col("_id").alias("a"), F.col("_text").alias("_text_a")), "a")
        links = written(both.mapInArrow(_confirmed(n, percent), "a bigint, b bigint").distinct(), "links")
        dropped(pairs)
        return links

    def labelled(members: DataFrame, links: DataFrame) -> DataFrame:
        label = components(links)
        return written(members.select("k", "id", "n").join(label.withColumnRenamed("node", "id"), "id", "left").select("k", "id", "n", F.coalesce("component", "id").alias("component")), "others")

    entries = reps.select("id", "n", F.explode("bands").alias("k"))
    buckets = written(entries.groupBy("k").agg(F.min("id").alias("a"), F.count("*").alias("rows")).filter("rows > 1"), "buckets")
    grouped = written(entries.join(buckets, "k").filter("id != a"), "grouped")
    dropped(buckets)
    links = tested(grouped.select("a", F.col("id").alias("b")))
    others = labelled(grouped.filter("rows > 2"), links)
    dropped(grouped)
    before = float("inf")
    while True:
        mixed = written(_mixed(others), "mixed")
        work, rows = mixed.agg(F.coalesce(F.sum(F.col("strays") * (F.col("strays") + F.col("rest")).cast("double")), F.lit(0.0)), F.coalesce(F.sum(F.col("strays") + F.col("rest")), F.lit(0))).first()
        if work <= PIVOT_WORK * rows or work > 0.9 * before:
            break
        strays = others.join(mixed.select("k", "major"), "k").filter("component != major")
        pivots = strays.groupBy("k").agg(F.min("id").alias("pivot"))
        pivots = written(strays.join(pivots, "k").filter("id = pivot").select("k", "pivot", F.col("component").alias("_own")).distinct(), "pivots")
        links = links.union(tested(others.join(pivots, "k").filter("component != _own").select(F.col("pivot").alias("a"), F.col("id").alias("b"))))
        others, old = labelled(others.join(pivots.select("k", F.col("pivot").alias("id")), ["k", "id"], "left_anti"), links), others
        dropped(old, mixed, pivots)
        before = work
    members = _blocks(others, mixed).join(sketches, "id")

    def open_members(table: pa.Table) -> pa.Table:
        i, j = _pairs_of(table, similarity)
        return table.select(["k", "lo", "hi", "chunk", "id", "component", "n", "sketch", "samples"]).take(pa.array(np.unique(np.concatenate([i, j]))))

    kinds = "k bigint, lo bigint, hi bigint, chunk bigint, id bigint, component bigint, n bigint, sketch binary, samples bigint"
    still = written(members.groupBy("k", "lo", "hi").applyInArrow(open_members, kinds), "open")

    def confirm(table: pa.Table) -> pa.Table:
        words, forest, sets = Words(), Forest(), {}
        ids, component, text = table["id"].to_pylist(), table["component"].to_pylist(), table["_text"].cast(pa.binary())
        for x, y in zip(*_pairs_of(table, similarity)):
            one, two = ("c", component[x]), ("c", component[y])
            if forest.find(one) == forest.find(two):
                continue
            for z in (x, y):
                if z not in sets:
                    sets[z] = shingles(text[z].as_py(), n, words)
            if linked(sets[x], sets[y], percent):
                forest.join(one, two, edge=False)
                forest.edges.append((ids[x], ids[y]))
        return pa.table({"a": pa.array([e[0] for e in forest.edges], pa.int64()), "b": pa.array([e[1] for e in forest.edges], pa.int64())})

    more = still.join(texts.select(F.col("_id").alias("id"), "_text"), "id").groupBy("k", "lo", "hi").applyInArrow(confirm, "a bigint, b bigint")
    more = written(more, "more")
    dropped(others, mixed, still)
    return links.union(more)


def near_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of df: id_col (long), n_shingles, component_id, kept.

    A-Z are lower-cased, words are runs without ASCII white space. Texts with fewer words than a shingle are one shingle;
    null, empty and blank texts have none and are linked with nothing. component_id is the smallest identifier reachable
    by links (the row's own without any). Rows repeated with one identifier are one document with all their links; a null
    identifier is linked with nothing and is its own, null, component. An empty table gives an empty result; other
    columns are not read.
    """
    bounded_batches(df.sparkSession)
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    found = written(docs.mapInArrow(_features(words), "id bigint, n bigint, set binary, sketch binary, samples bigint, bands array<bigint>"), "features")
    sets = found.filter("n > 0 AND id IS NOT NULL")
    classes = written(sets.groupBy("set").agg(F.min("id").alias("rep")), "classes")
    reps = written(sets.join(classes.select(F.col("rep").alias("id"), "set"), ["id", "set"], "left_semi").dropDuplicates(["id", "set"]).drop("set"), "reps")
    # a row that is repeated very often must not meet each of its pairs as often
    once = docs if sets.groupBy("id").count().filter("count > 1").isEmpty() else docs.distinct()
    links = near_links(once, reps, "id", "text", words, percent)
    same_id = sets.join(classes, "set").filter("id != rep").select(F.col("rep").alias("a"), F.col("id").alias("b")).distinct()
    repeated = sets.groupBy("id").agg(F.count_distinct("set").alias("sets")).filter("sets > 1").select("id")
    # copies belong to their class; only an identifier with several texts ties classes together, and then its copies' edges count
    ties = same_id.join(repeated.withColumnRenamed("id", "b"), "b", "left_semi").select("a", "b")
    top = components(links.select("a", "b").union(ties))
    members = found.select("id", "n", "set").join(classes, "set", "left").withColumn("rep", F.when(F.col("id").isNotNull(), F.coalesce("rep", "id")))
    members = members.join(top.withColumnRenamed("node", "rep"), "rep", "left")
    component = F.coalesce("component", "rep")
    return members.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def distinct_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """df without the rows that near_dedup does not keep; df's own columns, whatever their names.

    Rows with a null identifier, and texts without words (null, empty, blank), are linked with nothing and stay, as do all
    rows repeated with a kept identifier. Of a group of equal or nearly equal texts the smallest identifier's rows stay.
    An empty table gives an empty one.
    """
    lost = near_dedup(df, id_col, text_col, words, percent).filter(~F.col("kept")).select(F.col(id_col).alias("_lost")).distinct()
    return carried(df, _id=F.col(id_col)).join(lost, F.col("_id").eqNullSafe(F.col("_lost")), "left_anti").select("_row.*")
