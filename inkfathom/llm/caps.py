"""Near-duplicate vectors by spherical-cap filters from random product codes.

A filter is a direction put together from one codeword for each half of the (randomly turned) space; a vector's filters
are all whose inner product with it exceeds a threshold, found by list decoding: both halves' codewords are sorted by
their inner products, and for each codeword of the first half only the second half's leading ones can reach the
threshold. Vectors that share a filter (and a label) meet there. The number of filters follows the number of vectors
(`SPARSE` for each), so that unrelated vectors rarely share one at any size; the threshold gives every vector `mean`
filters in each of `tables` independent turns on average, and one that exceeds it in fewer than `least` gets its best ones.

Bit-identical vectors of a label (but for a power of two) are one class beforehand. A pair is counted only at the first
filter its vectors share, so links are counted once and never listed: tasks emit counts, and the links that connect. Two
steps find them, both in blocks of bounded size: the first has only the members' filters and keeps those that some other
member meets here for the first time; only for those the vectors are fetched and compared as matrix products in double
precision. In a dense group, whose vectors share many filters, that is few of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, by_group, dropped, written
from .components import components

COSINE = 0.98
TABLES, MEAN, LEAST, SPARSE = 2, 8.0, 4, 32
#: Codewords of a half; beyond some 10^8 vectors filters hold more unrelated ones (more work, no link lost).
MOST_CODEWORDS = 65_536
BLOCK = 512


class Filters:
    """One table's product code for vectors of `dims` components, the same on every executor."""

    def __init__(self, dims: int, codewords: int, mean: float, table: int, seed: int):
        random = np.random.default_rng([seed, table, dims, codewords])
        turn = np.linalg.qr(random.standard_normal((dims, dims)))[0]
        half = dims // 2
        codes = random.standard_normal((2, codewords, dims))
        # inner products of a unit vector with a filter are standard normal over the filters
        self.first, self.second = codes[0][:, :half] @ turn[:half], codes[1][:, half:] @ turn[half:]
        self.n, self.table = codewords, table
        self.threshold = NormalDist().inv_cdf(1 - min(mean / codewords**2, 0.5))

    def decode(self, x: np.ndarray, least: int = LEAST) -> list[np.ndarray]:
        """For each unit vector (row), the numbers of all filters above the threshold, or of its `least` best if those are more."""
        out = []
        least = min(least, self.n)
        for a, b in zip(x @ self.first.T, x @ self.second.T):
            order = np.argsort(-b)
            falling = -b[order]
            leading = np.flatnonzero(a >= self.threshold + falling[0])
            counts = np.searchsorted(falling, a[leading] - self.threshold, side="right")
            if counts.sum() < least:  # the best sums are of the best of both
                ones, twos = np.argsort(-a)[:least], order[:least]
                best = np.argsort(-(a[ones][:, None] + b[twos][None, :]).ravel(), kind="stable")[:least]
                out.append(ones[best // least] * self.n + twos[best % least])
                continue
            places = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            out.append(np.repeat(leading, counts) * self.n + order[places])
        return out


def _decoded(codewords: int, mean: float, tables: int, seed: int, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, list[Filters]] = {}
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                b = whole.slice(at, 1024)
                unit = [np.frombuffer(v, kind) for v in b["vector"].to_pylist()]
                keys: list[list[np.ndarray]] = [[] for _ in unit]
                for dims in {len(v) for v in unit}:
                    rows = [i for i, v in enumerate(unit) if len(v) == dims]
                    if dims not in made:
                        made[dims] = [Filters(dims, codewords, mean, t, seed) for t in range(tables)]
                    x = np.array([unit[i] for i in rows], np.float64)
                    x /= np.linalg.norm(x, axis=1, keepdims=True)
                    for f in made[dims]:
                        for i, found in zip(rows, f.decode(x)):
                            keys[i].append(found + f.table * codewords**2)
                sorted_keys = [np.sort(np.concatenate(k)) for k in keys]
                yield pa.RecordBatch.from_arrays([b["id"], b["own"], b["label"], pa.array([len(v) for v in unit], pa.int32()), pa.array(sorted_keys, pa.list_(pa.int64()))], names=["id", "own", "label", "dims", "keys"])

    return run


def _vectors(kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The vector's bytes, scaled by a power of two so that its largest component is near 1; null where it links with nothing."""
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                b, out = whole.slice(at, 1024), []
                for v, label in zip(b["v"].to_pylist(), b["label"].to_pylist()):
                    x = None
                    if v and label is not None and None not in v:
                        x = np.array(v, np.float64)
                        x = np.ldexp(x, -np.frexp(np.abs(x).max())[1]) + 0.0 if np.isfinite(x).all() and x.any() else None
                    out.append(None if x is None else x.astype(kind).tobytes())
                yield pa.RecordBatch.from_arrays([b["id"], b["label"], pa.array(out, pa.binary())], names=["id", "label", "vector"])

    return run


def _first_here(table: pa.Table, rows: np.ndarray) -> np.ndarray:
    """For each pair of the rows, whether they share no filter before this one (`before`: each one's earlier filters)."""
    column = table["before"].combine_chunks()
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    values, ends = np.array(column.values), np.array(column.offsets)
    lists = [values[ends[i] : ends[i + 1]] for i in rows]
    first = np.ones((len(rows), len(rows)), bool)
    names, column = np.unique(np.concatenate(lists), return_inverse=True)
    owner = np.repeat(np.arange(len(rows)), [len(k) for k in lists])
    common = np.flatnonzero(np.bincount(column, minlength=len(names)) > 1)
    place = np.full(len(names), -1)
    place[common] = np.arange(len(common))
    for at in range(0, len(common), 4096):
        has = np.zeros((len(rows), min(4096, len(common) - at)), np.float32)
        mine = (place[column] >= at) & (place[column] < at + has.shape[1])
        has[owner[mine], place[column[mine]] - at] = 1
        first &= has @ has.T == 0
    return first


def _pairs_to_test(table: pa.Table, rows: np.ndarray) -> np.ndarray:
    """Which pairs of the rows are this block's to test: two different identifiers, of both chunks where the block has two."""
    ids, chunk = np.array(table["own"])[rows], np.array(table["chunk"])
    test = _first_here(table, rows) & (ids[:, None] != ids[None, :])
    if chunk.min() != chunk.max():
        test &= chunk[rows][:, None] != chunk[rows][None, :]
    return test


def _kinds(table: pa.Table) -> list[np.ndarray]:
    """The rows of each label and number of dimensions: one set, unless keys collide."""
    label, dims = np.array(table["label"]), np.array(table["dims"])
    return [np.flatnonzero((label == a) & (dims == b)) for a, b in sorted({*zip(label.tolist(), dims.tolist())})]


def _met(table: pa.Table) -> pa.Table:
    """The members of a block that have a pair to test in it."""
    table = table.combine_chunks()
    kept = [rows[_pairs_to_test(table, rows).any(axis=1)] for rows in _kinds(table)]
    return table.take(pa.array(np.sort(np.concatenate(kept))))


def _least_reachable(link: np.ndarray) -> np.ndarray:
    """For each row of a symmetric matrix of links, the smallest row reachable."""
    least = np.arange(len(link))
    while True:
        new = np.minimum(least, np.where(link, least[None, :], len(link)).min(axis=1))
        new = new[new]
        if (new == least).all():
            return least
        least = new


def _linked_in(cosine: float, kind: str):
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        ids, own, size = np.array(table["id"]), np.array(table["own"]), np.array(table["size"])
        raw = table["vector"].to_pylist()
        counts, edges = np.zeros(len(ids), np.int64), []
        for rows in _kinds(table):
            x = np.array([np.frombuffer(raw[i], kind) for i in rows], np.float64)
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            link = (x @ x.T >= cosine) & _pairs_to_test(table, rows)
            counts[rows] += link @ size[rows]
            least = _least_reachable(link)
            edges += [(int(own[rows[i]]), int(own[rows[j]])) for i, j in enumerate(least) if i != j]
        met = np.flatnonzero(counts)
        a = [*ids[met].tolist(), *(e[0] for e in edges)]
        b = [*[None] * len(met), *(e[1] for e in edges)]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "links": pa.array([*counts[met].tolist(), *[0] * len(edges)], pa.int64())})

    return run


def near_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = COSINE, tables: int = TABLES, mean: float = MEAN, seed: int = 5) -> DataFrame:
    """One row per row of df: id_col (long), n_links, component_id, kept.

    Rows link when their labels are equal, not null, and the cosine of their vectors is at least `cosine`. Null, empty and
    zero vectors, those with null or non-finite components, null labels and null identifiers link with nothing; vectors
    of different lengths never link. Rows repeated with one identifier count as vectors of their own for others' n_links.
    An empty table gives an empty result; other columns are not read.
    """
    bounded_batches(df.sparkSession)
    kind = "<f4" if df.schema[vector_col].dataType.simpleString() == "array<float>" else "<f8"
    source = df.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).alias("v"))
    vectors = written(source.mapInArrow(_vectors(kind), "id bigint, label bigint, vector binary"), "vectors")
    usable = vectors.filter("vector IS NOT NULL AND id IS NOT NULL")
    classes = usable.groupBy("label", "vector").agg(F.min("id").alias("rep"), F.count("*").alias("size"))
    classes = written(classes.withColumn("class", F.monotonically_increasing_id()), "classes")
    n = classes.count()
    codewords = int(min(max((SPARSE * n) ** 0.5, 16), MOST_CODEWORDS)) + 1
    reps = classes.select(F.col("class").alias("id"), F.col("rep").alias("own"), "label", "vector", "size")
    decoded = written(reps.select("id", "own", "label", "vector").mapInArrow(_decoded(codewords, mean, tables, seed, kind), "id bigint, own bigint, label bigint, dims int, keys array<bigint>"), "decoded")
    entries = decoded.select("id", "label", "dims", F.posexplode("keys").alias("place", "key"))
    entries = entries.select("id", F.xxhash64("label", "dims", "key").alias("k"), "place")
    shared = entries.groupBy("k").agg(F.count("*").alias("n")).filter("n > 1").select("k", F.ceil(F.col("n") / BLOCK).alias("chunks"))
    members = entries.join(shared, "k").withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")))
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    members = members.select("k", F.least("chunk", "other").alias("lo"), F.greatest("chunk", "other").alias("hi"), "chunk", "id", "place")
    members = members.join(decoded, "id").select("k", "lo", "hi", "chunk", "id", "own", "label", "dims", F.expr("slice(keys, 1, place)").alias("before"))
    kinds = "k bigint, lo bigint, hi bigint, chunk bigint, id bigint, own bigint, label bigint, dims int, before array<bigint>"
    met = written(by_group(members, ["k", "lo", "hi"], _met, kinds), "met")
    both = met.join(reps.select("id", "vector", "size"), "id").select("k", "lo", "hi", "chunk", "id", "own", "label", "dims", "before", "vector", "size")
    found = written(by_group(both, ["k", "lo", "hi"], _linked_in(cosine, kind), "a bigint, b bigint, links bigint"), "found")
    dropped(decoded, met)
    counts = found.filter("b IS NULL").groupBy(F.col("a").alias("class")).agg(F.sum("links").alias("links"))
    top = components(found.filter("b IS NOT NULL").select("a", "b")).withColumnRenamed("node", "rep")
    of = classes.join(counts, "class", "left").join(top, "rep", "left").select("label", "vector", "rep", "size", "links", "component")
    out = vectors.join(of.withColumnRenamed("label", "_l").withColumnRenamed("vector", "_v"), (F.col("label") == F.col("_l")) & (F.col("vector") == F.col("_v")) & F.col("id").isNotNull(), "left")
    component = F.coalesce("component", "rep", "id")
    links = F.coalesce(F.col("size") - 1 + F.coalesce("links", F.lit(0)), F.lit(0)).cast("long")
    return out.select(F.col("id").alias(id_col), links.alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
