"""MinHash near-dedup (9): fast similarity sketching, banding, exact verification and components.

A document's set is its distinct shingles of ``size`` lower-cased words. Its sketch has t coordinates and is
filled by rounds: round i < t throws every shingle into a hashed bin with the value (i, hash), and a later
round t + i throws every shingle into bin i, so that every coordinate is filled for any set; rounds stop
once all bins are full, after about t ln t throws. Two sketches agree in a coordinate with a probability
equal to the similarity of the sets, and the agreements are concentrated as if coordinates were independent.

Sketches are banded; rows and bands are chosen so that a pair at the threshold shares no band with a
probability of 1e-5 at most. Equal sets are first joined to one representative. Representatives that share a
bucket are compared with the bucket's least id on full sets, which connects most groups of near copies at one comparison
a member. Buckets that still hold several components are finished exactly: their members, grouped by the
component of that least id and cut into blocks of bounded size, are compared block by block with products of
incidence matrices, and only links that connect something new leave a block. No pairs are listed, no group is
held in one task, and no candidate pair between different components goes untested.

A shingle is 64 bits in the sets, made of the digests of its words: of two compared sets of n and m shingles, different ones
agree with a probability of n * m / 2^64, and no order of letters or words makes them agree.

Defined results: texts without words have an empty set and are linked with nothing; texts with fewer words
than a shingle have the whole sequence as their one shingle; rows with the same id count as one document, linked
by any of their texts; rows with a null id are in no component (null) and are kept; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import cut, keep, partitions
from siltstone.llm.wordhash import U, Words, mix, slices, windows

_EMPTY = np.iinfo(np.uint64).max
#: Ids up to this many are broadcast (16 bytes each); more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def banding(threshold: float, miss: float = 1e-5, most: int = 50) -> tuple[int, int]:
    """Rows and bands: the longest bands that miss a pair at the threshold with a probability of ``miss`` at most."""
    rows, bands = 1, 1
    for r in range(1, 33):
        b = math.ceil(math.log(miss) / math.log1p(-(threshold**r))) if threshold < 1 else 1
        if b > most:
            break
        rows, bands = r, b
    return rows, bands


def shingle_sets(column: pa.Array, size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words = Words(column, lower=True)
    grams = windows(words.hash, size)
    out = []
    for _, a, b in words.texts():
        if b - a >= size:
            out.append(np.unique(grams[a : b - size + 1]))
        elif b > a:
            out.append(windows(words.hash[a:b], b - a))
        else:
            out.append(np.zeros(0, U))
    return out


def sketch(sets: list[np.ndarray], t: int) -> np.ndarray:
    """One row of t coordinates for each set; sets without elements stay unfilled."""
    n = len(sets)
    out = np.full((n, t), _EMPTY, U)
    flat = out.reshape(-1)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    items = np.concatenate(sets) if n else np.zeros(0, U)
    seeds = mix(np.arange(1, 2 * t + 1, dtype=U) * U(0xA0761D6478BD642F))
    for i in range(2 * t):
        if not len(items):
            break
        h = mix(items ^ seeds[i])
        value = (h & U(0xFFFFFFFF)) | U(i << 32)
        where = owner * t + (((h >> U(32)) * U(t)) >> U(32)).astype(np.int64) if i < t else owner * t + (i - t)
        np.minimum.at(flat, where, value)
        live = np.unique(owner)
        full = np.zeros(n, bool)
        full[live] = (out[live] != _EMPTY).all(axis=1)
        if full.any():
            left = ~full[owner]
            items, owner = items[left], owner[left]
    return out


def band_keys(sketches: np.ndarray, rows: int, bands: int) -> np.ndarray:
    """A 64-bit key for each band of each sketch; the band's number is part of it."""
    keys = np.tile(mix(np.arange(1, bands + 1, dtype=U)), (len(sketches), 1))
    for r in range(rows):
        keys = mix(keys ^ sketches[:, r * bands : (r + 1) * bands]) + U(r)
    return keys


def signatures(docs: DataFrame, size: int, threshold: float) -> DataFrame:
    """doc_id, n_shingles, the set's digest (d1, d2) and its band keys; docs: doc_id and text."""
    rows, bands = banding(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                sets = shingle_sets(batch.column("text"), size)
                n = np.array([len(s) for s in sets], np.int64)
                digest = np.frombuffer(b"".join(hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets), np.int64).reshape(-1, 2)
                keys = band_keys(sketch(sets, rows * bands), rows, bands)[n > 0].reshape(-1).view(np.int64)
                offsets = np.concatenate(([0], np.cumsum(np.where(n > 0, bands, 0)))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(n), pa.array(digest[:, 0]), pa.array(digest[:, 1]), pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys))],
                    ["doc_id", "n_shingles", "d1", "d2", "keys"],
                )

    return docs.mapInArrow(run, "doc_id long, n_shingles long, d1 long, d2 long, keys array<long>")


def _sets(docs: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """node and its set as bytes, for the documents named in ``nodes``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                data = [s.tobytes() for s in shingle_sets(batch.column("text"), size)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(data, pa.binary())], ["node", "items"])

    if nodes.count() <= BROADCAST_ROWS:
        nodes = F.broadcast(nodes)
    return docs.join(nodes, docs["doc_id"] == nodes["node"], "left_semi").mapInArrow(run, "node long, items binary")


def verify(pairs: DataFrame, sets: DataFrame, percent: int, block: int = 4096) -> DataFrame:
    """The pairs (a, b) of which 100 * intersection >= percent * union holds on full sets.

    Pairs meet by their pivot ``a`` in blocks of about ``block``: its set is sent once to each block, and the others
    stream past it, so a task holds one set and one batch whatever the size of the group.
    """

    def alike(p: np.ndarray, q: np.ndarray) -> bool:
        place = np.searchsorted(q, p)
        place[place == len(q)] = 0
        both = int((q[place] == p).sum())
        return 100 * both >= percent * (len(p) + len(q) - both)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivot, sets, opening = None, [], False  # an id with several texts is a pivot with several sets
        for batch in batches:
            good = []
            at, nodes = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            for i, item in enumerate(batch.column("items")):
                p = np.frombuffer(item.as_buffer(), U)
                if nodes[i] is None:
                    sets = [*(sets if opening and at[i] == pivot else ()), p.copy()]
                    pivot, opening = at[i], True
                    continue
                opening = False
                if any(alike(p, q) for q in sets):
                    good.append(i)
            yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(good, pa.int64())) for c in ("a", "b")], ["a", "b"])

    many = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("m"))
    dealt = pairs.join(many, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("m") / block)).alias("part"))
    ones = dealt.select("a", "part").distinct().join(sets.withColumnRenamed("node", "a"), "a")
    others = dealt.join(sets.withColumnRenamed("node", "b"), "b")
    rows = ones.select("a", "part", F.lit(None).cast("long").alias("b"), "items").unionByName(others.select("a", "part", "b", "items"))
    # Nulls, the pivots, sort first.
    return rows.repartition(partitions(pairs), "a", "part").sortWithinPartitions("a", "part", "b").select("a", "b", "items").mapInArrow(run, "a long, b long")


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame, most: int | None = None) -> DataFrame:
    """node and label, the least node of its component, for every node of ``links`` (a, b), of which there are ``most`` at most.

    Large-star and small-star steps in turn until nothing changes: each step moves only edges, combines the
    least neighbours before its shuffle, and a hub with very many edges is a skewed join, which is split.
    """
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), most)
    before = _state(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # A step makes two edges at most of each.
        edges = cut(moved.union(least.select("u", "m")).distinct(), 2 * before[0])
        after = _state(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).union(edges.select("v", "v").distinct())


def _compare(percent: int):
    """Links between blocks of sets, by products of their incidence matrices; rows are sorted by (g, i, j)."""

    def intersections(sets: list[np.ndarray]) -> np.ndarray:
        sizes = [len(s) for s in sets]
        owner, items = np.repeat(np.arange(len(sets)), sizes), np.concatenate(sets)
        values, inverse, count = np.unique(items, return_inverse=True, return_counts=True)
        shared = count > 1
        column = (np.cumsum(shared) - 1)[inverse]
        owner, column = owner[shared[inverse]], column[shared[inverse]]
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        out = np.zeros((len(sets), len(sets)))
        for at in range(0, int(shared.sum()), 4096):
            lo, hi = np.searchsorted(column, (at, at + 4096))
            part = np.zeros((len(sets), 4096), np.float32)
            part[owner[lo:hi], column[lo:hi] - at] = 1
            out += part @ part.T
        return out

    def links(nodes: list[int], labels: list[int], sides: list[int], sets: list[np.ndarray], i: int, j: int) -> list[tuple[int, int]]:
        both = intersections(sets)
        n = np.array([len(s) for s in sets])
        label, side = np.array(labels), np.array(sides)
        good = (100 * both >= percent * (n[:, None] + n[None] - both)) & (label[:, None] != label[None])
        if i != j:
            good &= side[:, None] != side[None]
        root = {x: x for x in labels}
        out = []
        for x, y in zip(*np.nonzero(np.triu(good, 1)), strict=True):
            p, q = labels[x], labels[y]
            while root[p] != p:
                p = root[p]
            while root[q] != q:
                q = root[q]
            if p != q:  # a link inside what is connected already adds nothing
                root[max(p, q)] = min(p, q)
                out.append((min(nodes[x], nodes[y]), max(nodes[x], nodes[y])))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, ([], [], [], [])

        def done() -> pa.RecordBatch:
            found = links(*held, key[1], key[2]) if key and len(held[0]) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])

        for batch in batches:
            c = {n: batch.column(n).to_pylist() for n in ("g", "i", "j", "node", "label", "side")}
            for r, item in enumerate(batch.column("items")):
                now = (c["g"][r], c["i"][r], c["j"][r])
                if now != key:
                    if len(held[0]) > 1:
                        yield done()
                    key, held = now, ([], [], [], [])
                for to, x in zip(held, (c["node"][r], c["label"][r], c["side"][r], np.frombuffer(item.as_buffer(), U).copy()), strict=True):
                    to.append(x)
        yield done()

    return run


def _links(docs: DataFrame, sigs: DataFrame, size: int, percent: int, block: int = 128, elements: int = 1 << 18) -> DataFrame | None:
    """Labels of representatives by verified links, enough of them to connect what all candidates connect.

    Blocks hold ``block`` sets or ``elements`` elements, whichever is less, one set at least.
    """
    reps = sigs.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("d1", "d2").agg(F.min(F.struct("doc_id", "n_shingles", "keys")).alias("r"))
    rows = reps.select(F.explode("r.keys").alias("key"), F.col("r.doc_id").alias("node"), F.col("r.n_shingles").alias("n"))
    shared = rows.groupBy("key").agg(F.min(F.struct("node", "n")).alias("f"), F.max("node").alias("y")).where("f.node < y").select("key", F.col("f.node").alias("p"), F.col("f.n").alias("pn"))
    members = cut(rows.join(shared, "key").where("node <> p"))
    most = members.count()
    if not most:
        return None
    nodes = members.select("node").union(members.select("p")).distinct()
    sets = keep(_sets(docs, nodes, size))
    # First every member against the pivot of its bucket.
    alike = 100 * F.least("n", "pn") >= percent * F.greatest("n", "pn")
    pairs = cut(members.where(alike).select(F.col("p").alias("a"), F.col("node").alias("b")).distinct(), most)
    labels = components(verify(pairs, sets, percent), most)
    named = cut(members.join(labels, "node", "left").select("key", "p", "node", "n", F.coalesce("label", "node").alias("label")), most)
    # Then, where a bucket holds several components, its members against each other, in blocks.
    opened = named.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x < y").select("key")
    around = named.join(opened, "key").select("p", "node", "n", "label").distinct()
    around = around.join(labels.select(F.col("node").alias("p"), F.col("label").alias("g")), "p", "left").select(F.coalesce("g", "p").alias("g"), "node", "n", "label").distinct()
    around = cut(around, most)
    sizes = around.groupBy("g").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("e"), F.min("label").alias("x"), F.max("label").alias("y")).where("x < y")
    parts = sizes.select("g", F.greatest(F.ceil(F.col("m") / block), F.ceil(F.col("e") / elements)).cast("int").alias("parts"))
    if parts.isEmpty():
        return labels
    dealt = around.join(parts, "g").withColumn("side", F.pmod(F.xxhash64("node"), "parts").cast("int"))
    spread = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    spread = spread.select("g", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "node", "label", "side").join(sets, "node")
    n = partitions(docs)
    more = spread.repartition(n, "g", "i", "j").sortWithinPartitions("g", "i", "j").mapInArrow(_compare(percent), "a long, b long")
    return components(labels.select(F.col("node").alias("a"), F.col("label").alias("b")).unionByName(more))


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id (least id reachable) and kept."""
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    sigs = cut(signatures(docs, size, percent / 100))
    some = sigs.where("n_shingles > 0 AND doc_id IS NOT NULL").select("doc_id", "d1", "d2")
    exact = some.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"))
    same = keep(some.join(exact, ["d1", "d2"]).select("doc_id", "rep").distinct())
    labels = _links(docs, sigs, size, percent)
    # An id with several texts links their groups; such ids are few.
    several = same.groupBy("doc_id").agg(F.min("rep").alias("x"), F.max("rep").alias("y")).where("x < y").select("doc_id")
    if not several.isEmpty():
        more = same.join(several, "doc_id").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
        labels = components(more if labels is None else labels.select(F.col("node").alias("a"), F.col("label").alias("b")).union(more))
    found = same.groupBy("doc_id").agg(F.min("rep").alias("rep"))
    if labels is not None:
        found = found.join(labels.groupBy(F.col("node").alias("rep")).agg(F.min("label").alias("label")), "rep", "left").select("doc_id", F.coalesce("label", "rep").alias("label"))
    else:
        found = found.withColumnRenamed("rep", "label")
    component = F.coalesce("label", "doc_id")
    return sigs.select("doc_id", "n_shingles").join(found, "doc_id", "left").select(
        "doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id").isNull() | (component == F.col("doc_id"))).alias("kept")
    )
