"""A stored inverted index: postings in files, searched without the texts.

Chunks are numbered inside segments of about ``LISTED_TOKENS`` tokens. A segment is made where its chunks are read: what is shuffled and stored
are its lists, packed. Files of one addition (a generation), Parquet in folders by the token's bucket, sorted by (token's digest, token, segment):

* a row for each segment and distinct token, its list: the numbers of the chunks that have it as gaps (``gaps``), and for each field how
  often they have it there (``tf_``; null: none has it, empty: each has it once). Gaps and counts are bytes of seven bits each.
* a row for each segment in bucket -1, with the ids of its chunks and the lengths of their fields.
* ``gone``: a row for each segment that has lost chunks, with a bit for each of its chunks.

A withdrawal is a generation that has ``gone`` only, and takes chunks from all before it. The manifest (``commits``) names the generations and
their totals. Document frequencies are counted from the lists, without the chunks that are gone, so they are exact at any time, as are
numbers of chunks and mean lengths. Adding a chunk that is there withdraws it first. Generations are folded into one by ``fold``.

Search reads the buckets and pages of the questions' tokens, and the ids and lengths of chunks. All lists of a segment meet in one place with the
questions that ask for them, so the pairs of questions and chunks are summed there and only results leave it: the best field's BM25 sum, for
chunks that match enough distinct tokens (V6-V8).
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator, Mapping
from functools import reduce
from itertools import pairwise
from operator import or_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.operators import lexical as L
from siltstone.operators.commits import CommitLog

#: Digests of up to this many distinct tokens are compared in the scan, which skips pages by them; more are joined only.
PUSHED_TOKENS = 256
#: Tokens of the chunks whose postings are listed together.
LISTED_TOKENS = 1_000_000
#: Postings of a list, about, by which the rows of a page are reckoned.
LIST_POSTINGS = 20
#: Parts in which a segment's lists of a bucket are shuffled, lists that are worth a part, and tasks whose parts go to one place.
SLICES, SLICE_LISTS, SLICE_TASKS = 8, 500, 64
#: Terms of questions whose pairs with a segment are summed together, and pairs that are handed on together.
PACK_TERMS, PAIRS = 20_000, 200_000
LAYOUT = 2


def _or(parts: list[Column]) -> Column:
    """A balanced disjunction."""
    while len(parts) > 1:
        parts = [reduce(or_, parts[i : i + 2]) for i in range(0, len(parts), 2)]
    return parts[0] if parts else F.lit(False)


def _digest(token: Column) -> Column:
    """32 bits, of which a bucket is a range: digests in other buckets don't touch the pages of this one."""
    return F.crc32(token.cast("binary"))


def _bytes(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Numbers as bytes of seven bits each, low ones first, all but a number's last with the high bit; ``counts`` numbers a row."""
    size = 1 + sum((values >= 1 << 7 * i).astype(np.int64) for i in range(1, 5))
    ends = np.concatenate([[0], np.cumsum(size)])
    out = np.empty(ends[-1], np.uint8)
    for i in range(size.max(initial=0)):
        m = size > i
        out[ends[:-1][m] + i] = (values[m] >> 7 * i) & 127 | (size[m] > i + 1) << 7
    offsets = ends[np.concatenate([[0], np.cumsum(counts)])].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(out)])


def _buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column and the offsets of its rows; nulls are empty."""
    x = pc.fill_null(column, b"")
    x = (x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x).cast(pa.binary())
    if not len(x):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(x.buffers()[1], np.int32)[x.offset : x.offset + len(x) + 1].astype(np.int64)
    data = np.frombuffer(x.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if offsets[-1] else np.empty(0, np.uint8)
    return data, offsets - offsets[0]


def _numbers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """What ``_bytes`` was given."""
    data, offsets = _buffer(column)
    last = data < 128
    upto = np.concatenate([[0], np.cumsum(last)])
    counts = upto[offsets[1:]] - upto[offsets[:-1]]
    if last.all():
        return data.astype(np.int64), counts
    starts = np.flatnonzero(np.concatenate([[True], last[:-1]]))
    shift = np.arange(len(data)) - np.repeat(starts, np.diff(np.append(starts, len(data))))
    return np.add.reduceat((data & 127).astype(np.int64) << 7 * shift, starts), counts


def _places(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of chunks from gaps, and how many each row has."""
    gaps, counts = _numbers(column)
    upto = np.cumsum(gaps)
    before = np.cumsum(counts) - counts
    filled = counts > 0
    base = np.zeros(len(counts), np.int64)
    base[filled] = upto[before[filled]] - gaps[before[filled]]
    return upto - np.repeat(base, counts), counts


def _often(column: pa.Array | pa.ChunkedArray, counts: np.ndarray) -> np.ndarray:
    """Counts in a field for each number of ``_places``."""
    values, own = _numbers(column)
    out = np.repeat(pc.is_valid(column).to_numpy(zero_copy_only=False) if isinstance(column, pa.Array) else pc.is_valid(column).to_numpy(), counts).astype(np.int64)
    out[np.repeat(own > 0, counts)] = values
    return out


def _left(places: np.ndarray, counts: np.ndarray, bits: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Whether these chunks are there still; ``bits`` has those of each row's segment that are gone."""
    data, offsets = _buffer(bits)
    out = np.ones(len(places), bool)
    m = np.repeat(np.diff(offsets) > 0, counts)
    out[m] = (data[np.repeat(offsets[:-1], counts)[m] + (places[m] >> 3)] >> (places[m] & 7)) & 1 == 0
    return out


def _bits(table: pa.Table, n: int) -> pa.Array:
    """The bits of the segment that these rows are of, n times."""
    return pa.repeat(next((x for x in table["bits"] if x.is_valid), pa.scalar(None, pa.binary())), n)


def _runs(batches: Iterator[pa.RecordBatch], *by: str) -> Iterator[pa.Table]:
    """Rows in a row with equal values in these columns, a table for each run."""
    held, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(c).to_numpy() for c in by])
        cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
        for a, b in pairwise([0, *cuts.tolist(), batch.num_rows]):
            key = tuple(keys[:, a])
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def _first(ids: np.ndarray, scores: np.ndarray, k: int, margin: float) -> np.ndarray:
    """Places of the k best scores and of all within the margin of the last of them; of equal scores those of the k least ids."""
    if len(scores) <= k:
        return np.arange(len(scores))
    keep = np.flatnonzero(scores >= np.partition(scores, -k)[-k] - margin)
    if len(keep) > 2 * k:
        keep = keep[np.lexsort((ids[keep], scores[keep]))]
        _, first, n = np.unique(scores[keep], return_index=True, return_counts=True)
        keep = keep[np.arange(len(keep)) - np.repeat(first, n) < k]
    return keep


class InvertedIndex:
    """``buckets`` is fixed when the index is made: about one for 32 MB of postings. ``page_rows`` bounds the postings of a page, about."""

    def __init__(self, spark: SparkSession, path: str, fields: list[str], buckets: int = 16, page_rows: int = 20_000, fold_at: int = 16):
        self.spark, self.path, self.fields, self.page_rows, self.fold_at = spark, path.rstrip("/"), list(fields), page_rows, fold_at
        self.log = CommitLog(spark, self.path)
        self.log.change(lambda m: None if m else {"layout": LAYOUT, "fields": self.fields, "buckets": buckets, "generations": []})
        made = self.log.read()
        if made.get("layout") != LAYOUT:
            raise ValueError(f"the index at {path} has files of another layout")
        if made["fields"] != self.fields:
            raise ValueError(f"the index at {path} has the fields {made['fields']}")
        self.buckets = made["buckets"]

    def _columns(self, kind: str) -> str:
        fields = self.fields
        if kind == "gone":
            return ", ".join(["segment long, bits binary, n long", *[f"len_{f} long" for f in fields]])
        return ", ".join(["h long, token string, segment long, gaps binary", *[f"tf_{f} binary" for f in fields], "chunk_id array<long>", *[f"len_{f} array<int>" for f in fields], "bucket int"])

    def _write(self, df: DataFrame, name: str, *by: str) -> None:
        # A dictionary is read whole for any page of its column, so only small ones are wanted.
        plain = {f"parquet.enable.dictionary#{c}": "false" for c in ("token", "h", "gaps", "chunk_id.list.element", *[f"tf_{f}" for f in self.fields])}
        rows = max(8, self.page_rows // LIST_POSTINGS)
        df.write.options(**plain, compression="zstd").option("parquet.page.row.count.limit", rows).option("parquet.block.size", 32 << 20).partitionBy(*by).parquet(f"{self.path}/{name}")

    def _read(self, m: dict, kind: str) -> DataFrame:
        """The files of a kind of all generations."""
        out = None
        for g in m["generations"]:
            if kind in g["kinds"]:
                part = self.spark.read.schema(self._columns(kind)).parquet(f"{self.path}/{g['folder']}/{kind}")
                out = part if out is None else out.unionByName(part)
        return self.spark.createDataFrame([], self._columns(kind)) if out is None else out

    def _counted(self):
        """A fold of batches of chunks, with an array of tokens for each field, into segments: ids, lengths by field, distinct tokens, and
        by token and chunk their numbers and the counts by field."""
        fields = self.fields

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                sizes = np.array([pc.list_value_length(batch.column(f"tokens_{f}")).fill_null(0).to_numpy(zero_copy_only=False) for f in fields])
                upto = np.cumsum(sizes.sum(axis=0), dtype=np.int64)
                part = upto * -(-upto[-1] // LISTED_TOKENS) // (upto[-1] + 1)
                for at in np.unique(part):
                    first, last = np.searchsorted(part, [at, at + 1])
                    yield counted(batch.slice(first, last - first), sizes[:, first:last])

        def counted(batch: pa.RecordBatch, sizes: np.ndarray) -> tuple:
            parts, n = [batch.column(f"tokens_{f}") for f in fields], batch.num_rows
            tokens = pa.concat_arrays([pc.list_flatten(x) for x in parts]).dictionary_encode()
            codes = tokens.indices.fill_null(-1).to_numpy().astype(np.int64)
            key = (codes * n + np.concatenate([pc.list_parent_indices(x).to_numpy() for x in parts])) * len(fields) + np.repeat(np.arange(len(fields)), sizes.sum(axis=1))
            key, times = np.unique(key[codes >= 0], return_counts=True)
            place, f = np.divmod(key, len(fields))
            new = np.diff(place, prepend=-1) > 0
            tfs = np.zeros((len(fields), new.sum()), np.int64)
            tfs[f, np.cumsum(new) - 1] = times
            return batch.column("chunk_id").to_numpy(), sizes, tokens.dictionary, *np.divmod(place[new], n), tfs

        return run

    def _listed(self, forward: DataFrame) -> DataFrame:
        """Postings of chunks with an array of tokens for each field, as lists by token of some chunks each, which are counted where the chunks lie."""
        fields, counted = self.fields, self._counted()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for ids, sizes, tokens, code, rows, tfs in counted(batches):
                starts = np.flatnonzero(np.diff(code, prepend=-1))
                ends, tfs = pa.array(np.append(starts, len(code)), pa.int32()), tfs.astype("int32")
                lists = [ids[rows], *tfs, *[pa.array(n[rows].astype("int32"), mask=tf == 0) for n, tf in zip(sizes, tfs, strict=True)]]
                names = ["token", "chunk_id", *[f"tf_{f}" for f in fields], *[f"len_{f}" for f in fields]]
                yield pa.RecordBatch.from_arrays([tokens.take(pa.array(code[starts])), *[pa.ListArray.from_arrays(ends, pa.array(x)) for x in lists]], names)

        shape = ["token string, chunk_id array<long>", *[f"tf_{f} array<int>" for f in fields], *[f"len_{f} array<int>" for f in fields]]
        return forward.select("chunk_id", *[f"tokens_{f}" for f in fields]).mapInArrow(run, ", ".join(shape))

    def _posted(self, lists: DataFrame) -> DataFrame:
        """Postings of these lists, one by one."""
        return lists.select("token", F.inline(F.arrays_zip("chunk_id", *[f"{x}_{f}" for x in ("tf", "len") for f in self.fields])))

    def _packer(self, folder: str):
        """A function of a segment's chunks and counts that gives its rows as packs (bucket, slice, pack): zstd of Arrow tables."""
        fields, buckets = self.fields, self.buckets

        def pack(table: pa.Table) -> bytes:
            sink = pa.BufferOutputStream()
            with pa.CompressedOutputStream(sink, "zstd") as out, pa.ipc.new_stream(out, table.schema) as stream:
                stream.write_table(table)
            return sink.getvalue().to_pybytes()

        def run(nth: int, ids: np.ndarray, sizes: np.ndarray, tokens: pa.Array, code: np.ndarray, at: np.ndarray, tfs: np.ndarray) -> pa.RecordBatch:
            # Named by its content, so a task that is run again gives the same name to the same chunks and no other.
            name = hashlib.blake2b(f"{folder} {TaskContext.get().partitionId()} {nth} ".encode() + ids.tobytes(), digest_size=8).digest()
            segment = int.from_bytes(name) >> 1
            own = pa.table({"segment": [segment], "chunk_id": pa.array([ids], pa.list_(pa.int64())), **{f"len_{f}": pa.array([n], pa.list_(pa.int32())) for f, n in zip(fields, sizes, strict=True)}})
            more = TaskContext.get().partitionId() // SLICE_TASKS * SLICES
            rows = [(-1, more, pack(own))]
            if len(code):
                starts = np.flatnonzero(np.diff(code, prepend=-1))
                n = np.diff(np.append(starts, len(code)))
                gaps = np.diff(at, prepend=0)
                gaps[starts] = at[starts]
                token = tokens.take(pa.array(code[starts]))
                h = np.array([zlib.crc32(x) for x in token.cast(pa.binary()).to_pylist()], np.int64)
                lists = {"h": h, "token": token, "segment": np.full(len(h), segment), "gaps": _bytes(gaps, n)}
                for f, tf in zip(fields, tfs, strict=True):
                    some, ones = np.maximum.reduceat(tf, starts) > 0, (np.minimum.reduceat(tf, starts) == 1) & (np.maximum.reduceat(tf, starts) == 1)
                    told = some & ~ones
                    lists[f"tf_{f}"] = pc.if_else(pa.array(some), _bytes(tf[np.repeat(told, n)], n * told), pa.scalar(None, pa.binary()))
                slices = min(SLICES, 1 + len(h) // (buckets * SLICE_LISTS))
                part = h * (buckets * slices) >> 32
                order = np.lexsort((h, part))
                table, part = pa.table(lists).take(pa.array(order)), part[order]
                for a, b in pairwise([*np.flatnonzero(np.diff(part, prepend=-1)).tolist(), len(part)]):
                    rows.append((int(part[a]) // slices, int(part[a]) % slices + more, pack(table.slice(a, b - a))))
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.binary()), strict=True)], ["bucket", "slice", "pack"])

        return run

    def _packed(self, forward: DataFrame, folder: str) -> DataFrame:
        counted, packed = self._counted(), self._packer(folder)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for nth, segment in enumerate(counted(batches)):
                yield packed(nth, *segment)

        return forward.select("chunk_id", *[f"tokens_{f}" for f in self.fields]).mapInArrow(run, "bucket int, slice int, pack binary")

    def _generation(self, packs: DataFrame, folder: str) -> dict:
        """Writes the files of packed segments. Of chunks with one id, one counts."""
        fields = self.fields
        shape = pa.schema([("h", pa.int64()), ("token", pa.string()), ("segment", pa.int64()), ("gaps", pa.binary()), *[(f"tf_{f}", pa.binary()) for f in fields], ("chunk_id", pa.list_(pa.int64())), *[(f"len_{f}", pa.list_(pa.int32())) for f in fields], ("bucket", pa.int32())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for bucket, pack in zip(batch.column("bucket").to_pylist(), batch.column("pack"), strict=True):
                    with pa.ipc.open_stream(pa.CompressedInputStream(pa.BufferReader(pack.as_buffer()), "zstd")) as stream:
                        table = stream.read_all()
                    table = table.append_column("bucket", pa.array(np.full(table.num_rows, bucket), pa.int32()))
                    columns = [table[f.name].combine_chunks() if f.name in table.column_names else pa.nulls(table.num_rows, f.type) for f in shape]
                    yield pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip(columns, shape, strict=True)], schema=shape)

        rows = packs.repartition("bucket", "slice").mapInArrow(run, self._columns("postings"))
        self._write(rows.sortWithinPartitions("bucket", "h", "token", "segment"), f"{folder}/postings", "bucket")
        g = {"folder": folder, "kinds": ["postings"], "marked": 0}
        lengths = [F.coalesce(F.sum(F.aggregate(f"len_{f}", F.lit(0).cast("long"), lambda a, x: a + x)), F.lit(0)) for f in fields]
        n, *sums = self._chunks({"generations": [g]}).agg(F.coalesce(F.sum(F.size("chunk_id")), F.lit(0)), *lengths).first()
        again = F.row_number().over(Window.partitionBy("chunk_id").orderBy("segment", "at"))
        if lost := self._mark(self._alive({"generations": [g]}).withColumn("_rn", again).where("_rn > 1"), folder):
            g |= {"kinds": ["postings", "gone"], "marked": lost["marked"]}
            n, sums = n + lost["n"], [s + lost["lengths"][f] for f, s in zip(fields, sums, strict=True)]
        return g | {"n": n, "lengths": dict(zip(fields, sums, strict=True))}

    def _chunks(self, m: dict) -> DataFrame:
        """A row for each segment: segment, chunk_id and lengths as arrays."""
        return self._read(m, "postings").where("bucket = -1").select("segment", "chunk_id", *[f"len_{f}" for f in self.fields])

    def _marks(self, m: dict) -> tuple[DataFrame, int]:
        """Segments that have lost chunks, with the bits of all generations, and a bound of their number."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                bits = [reduce(or_, [np.frombuffer(x, np.uint8) for x in row]).tobytes() for row in batch.column("bits").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("segment"), pa.array(bits, pa.binary())], ["segment", "bits"])

        marks = self._read(m, "gone").groupBy("segment").agg(F.collect_list("bits").alias("bits"))
        return marks.mapInArrow(run, "segment long, bits binary"), sum(g["marked"] for g in m["generations"])

    def _marked(self, df: DataFrame, m: dict) -> DataFrame:
        """Rows with the bits of their segment."""
        marks, n = self._marks(m)
        return df.join(L.small(marks, n), "segment", "left") if n else df.withColumn("bits", F.lit(None).cast("binary"))

    def _alive(self, m: dict) -> DataFrame:
        """A row for each chunk that is there: chunk_id, segment, at, size of the segment, lengths."""
        fields = self.fields

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    row = batch.slice(i, 1)
                    lists = [row.column(x).flatten() for x in ("chunk_id", *[f"len_{f}" for f in fields])]
                    n = len(lists[0])
                    at = np.flatnonzero(_left(np.arange(n), np.array([n]), row.column("bits")))
                    ids, *lengths = [x.take(pa.array(at)) for x in lists]
                    yield pa.RecordBatch.from_arrays([ids, pa.array(np.repeat(row.column("segment").to_numpy(), len(at))), pa.array(at.astype("int32")), pa.array(np.full(len(at), n, "int32")), *lengths], ["chunk_id", "segment", "at", "size", *[f"len_{f}" for f in fields]])

        shape = ["chunk_id long, segment long, at int, size int", *[f"len_{f} int" for f in fields]]
        return self._marked(self._chunks(m), m).mapInArrow(run, ", ".join(shape))

    def _mark(self, found: DataFrame, folder: str) -> dict | None:
        """Writes these chunks (rows of ``_alive``) as gone; what they take from the totals."""
        fields = self.fields

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                bits = []
                for at, size in zip(batch.column("at"), batch.column("size").to_pylist(), strict=True):
                    flags = np.zeros(size, bool)
                    flags[at.values.to_numpy()] = True
                    bits.append(np.packbits(flags, bitorder="little").tobytes())
                rest = ["n", *[f"len_{f}" for f in fields]]
                yield pa.RecordBatch.from_arrays([batch.column("segment"), pa.array(bits, pa.binary()), *[batch.column(x) for x in rest]], ["segment", "bits", *rest])

        by = found.groupBy("segment").agg(F.collect_list("at").alias("at"), F.max("size").alias("size"), F.count(F.lit(1)).alias("n"), *[F.sum(f"len_{f}").alias(f"len_{f}") for f in fields])
        self._write(by.mapInArrow(run, self._columns("gone")), f"{folder}/gone")
        g = {"folder": folder, "kinds": ["gone"]}
        marked, n, *sums = self._read({"generations": [g]}, "gone").agg(F.count(F.lit(1)), F.sum("n"), *[F.sum(f"len_{f}") for f in fields]).first()
        if not marked:
            self.log.delete(f"{folder}/gone")
            return None
        return g | {"marked": marked, "n": -n, "lengths": {f: -s for f, s in zip(fields, sums, strict=True)}}

    def _withdrawal(self, ids: DataFrame, m: dict, rows: int | None = None) -> dict | None:
        """Writes which chunks of these ids are there."""
        ids = L.small(ids.select(F.col("chunk_id").cast("long")), rows)
        folder = f"g{uuid.uuid4().hex}"
        gone = self._mark(self._alive(m).join(ids, "chunk_id", "left_semi"), folder)
        if not gone:
            self.log.delete(folder)
        return gone

    def _commit(self, new: dict | None, ids: DataFrame, rows: int | None = None) -> None:
        """A withdrawal and an addition in one version; the withdrawal is made anew on what another writer has added."""
        while True:
            at = self.log.version()
            m = self.log.read(at)
            old = self._withdrawal(ids, m, rows) if m["generations"] else None
            more = [g for g in (old, new) if g]
            if not more or self.log.put(at + 1, m | {"generations": m["generations"] + more}):
                break
            if old:
                self.log.delete(old["folder"])
        if len(self.log.read()["generations"]) > self.fold_at:
            self.fold()

    def add(self, chunks: DataFrame, fields: Mapping[str, Column], chunk_id: str = "chunk_id") -> None:
        """Adds chunks, with the tokens of each field; those of the same id give way. Of rows that repeat an id one counts."""
        if sorted(fields) != sorted(self.fields):
            raise ValueError(f"the index has the fields {self.fields}")
        forward = chunks.select(F.col(chunk_id).cast("long").alias("chunk_id"), *[fields[f].alias(f"tokens_{f}") for f in self.fields]).where("chunk_id IS NOT NULL")
        folder = f"g{uuid.uuid4().hex}"
        new = self._generation(self._packed(forward, folder), folder)
        self._commit(new, self._alive({"generations": [new]}), new["n"])

    def withdraw(self, ids: DataFrame) -> None:
        """Takes chunks (column ``chunk_id``) out of the index."""
        self._commit(None, ids)

    def fold(self) -> None:
        """Writes all generations anew as one, unless another writer comes between: the lists of segments that lie side by side become one segment's."""
        at = self.log.version()
        m, folder, fields = self.log.read(at), f"g{uuid.uuid4().hex}", self.fields
        # A row for each segment, which is one for ``LISTED_TOKENS`` tokens, is small enough for the driver.
        left = self._alive(m).groupBy("segment").agg(sum(F.sum(f"len_{f}") for f in fields).alias("n")).orderBy("segment").collect()
        upto = np.cumsum([0, *[r["n"] for r in left]])
        groups = self.spark.createDataFrame([(r["segment"], int(b) // LISTED_TOKENS) for r, b in zip(left, upto, strict=False)], "segment long, group int")
        packed = self._packer(folder)

        def merged(table: pa.Table) -> tuple:
            own, lists = table.filter(pc.is_valid(table["chunk_id"])), table.filter(pc.is_valid(table["gaps"]))
            n = pc.list_value_length(own["chunk_id"]).to_numpy()
            there = _left(np.concatenate([np.arange(x) for x in n]), n, own["bits"])
            place, base = np.cumsum(there) - 1, dict(zip(own["segment"].to_pylist(), np.cumsum(n) - n, strict=True))
            at, counts = _places(lists["gaps"])
            at = at + np.repeat(np.array([base[s] for s in lists["segment"].to_pylist()], np.int64), counts)
            tokens = lists["token"].combine_chunks().dictionary_encode()
            code, keep = np.repeat(tokens.indices.to_numpy().astype(np.int64), counts), there[at]
            tfs, at, code = np.array([_often(lists[f"tf_{f}"], counts)[keep] for f in fields]), place[at[keep]], code[keep]
            order = np.lexsort((at, code))
            flat = lambda c: own[c].combine_chunks().flatten().to_numpy()[there]
            return flat("chunk_id"), np.array([flat(f"len_{f}") for f in fields]), tokens.dictionary, code[order], at[order], tfs[:, order]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for nth, table in enumerate(_runs(batches, "group")):
                yield packed(nth, *merged(table))

        rows = self._marked(self._read(m, "postings").drop("bucket", "h"), m).withColumn("bits", F.when(F.col("token").isNull(), F.col("bits")))
        rows = rows.join(L.small(groups, len(left)), "segment").repartition("group").sortWithinPartitions("group", "segment")
        one = self._generation(rows.mapInArrow(run, "bucket int, slice int, pack binary"), folder)
        if not self.log.put(at + 1, m | {"generations": [one]}):
            self.log.delete(folder)

    def vacuum(self) -> None:
        """Deletes versions but the last and folders that it doesn't name. Not while a writer is at work."""
        last = self.log.version()
        used = {g["folder"] for g in self.log.read(last)["generations"]}
        self.log.forget(last)
        for name in self.log.folders():
            if name not in used:
                self.log.delete(name)

    def _lists(self, m: dict, terms: DataFrame, n: int) -> DataFrame:
        """The lists of these questions' tokens: pages are skipped by the digests if there are few."""
        asked = terms.select("token", _digest(F.col("token")).alias("h")).where("token IS NOT NULL").distinct()
        few = [r[0] for r in asked.select("h").limit(PUSHED_TOKENS + 1).collect()]  # bounded
        rows = self._read(m, "postings").where("bucket >= 0")
        if len(few) <= PUSHED_TOKENS:
            rows = rows.where(F.col("bucket").isin(sorted({h * self.buckets >> 32 for h in few})) & _or([F.col("h") == h for h in few]))
        return rows.join(L.small(asked.select("token"), n), "token", "left_semi").select("token", "segment", "gaps", *[f"tf_{f}" for f in self.fields])

    def _frequencies(self, rows: DataFrame) -> DataFrame:
        """Chunks that have a token, by field, without those that are gone: token, df_. The rows of a segment follow one another."""
        fields = self.fields

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for table in _runs(batches, "segment"):
                lists = table.filter(pc.is_valid(table["gaps"]))
                if lists.num_rows:
                    places, counts = _places(lists["gaps"])
                    there, starts = _left(places, counts, _bits(table, len(counts))), np.cumsum(counts) - counts
                    n = [np.add.reduceat(there & (_often(lists[f"tf_{f}"], counts) > 0), starts, dtype=np.int64) for f in fields]
                    yield pa.RecordBatch.from_arrays([lists["token"].combine_chunks(), *[pa.array(x) for x in n]], ["token", *[f"n_{f}" for f in fields]])

        counts = rows.mapInArrow(run, ", ".join(["token string", *[f"n_{f} long" for f in fields]]))
        return counts.groupBy("token").agg(*[F.sum(f"n_{f}").alias(f"df_{f}") for f in fields])

    def _met(self, m: dict, terms: DataFrame, boosts: Mapping[str, float], k: int | None = None, margin: float = 0.0) -> DataFrame:
        """Matches of terms (query_id, token, weight, need) with as many of them as are needed: query_id, chunk_id, score, n_matched. With ``k``
        those of a segment that may be among the k best."""
        fields, total = self.fields, float(sum(g["n"] for g in m["generations"]))
        means = [sum(g["lengths"][f] for g in m["generations"]) / total if total else 0.0 for f in fields]
        weights = [float(boosts.get(f, 1.0)) for f in fields]
        terms = terms.where("token IS NOT NULL")
        n = terms.count()
        few = n <= L.BROADCAST_TOKENS
        packs = 1 if few else -(-n // PACK_TERMS)
        lists, chunks = self._lists(m, terms, n), self._marked(self._chunks(m), m)
        rows = lists.unionByName(chunks, allowMissingColumns=True).repartition("segment")
        pack = F.pmod(F.xxhash64("query_id"), F.lit(packs)).cast("int").alias("pack")
        asked = terms.groupBy("token", pack).agg(F.collect_list(F.struct("query_id", "weight", "need")).alias("asked"))
        asked = asked.join(L.small(self._frequencies(rows.sortWithinPartitions("segment")), n), "token")
        if few:
            # The lists lie by segment already, for the frequencies; they are read and shuffled once.
            rows = rows.join(F.broadcast(asked.drop("pack")), "token", "left").withColumn("pack", F.lit(0)).sortWithinPartitions("segment")
        else:
            chunks = chunks.withColumn("pack", F.explode(F.sequence(F.lit(0), F.lit(packs - 1))))
            rows = lists.join(asked, "token").unionByName(chunks, allowMissingColumns=True).repartition("segment", "pack").sortWithinPartitions("segment", "pack")
        of = pa.schema([("chunk_id", pa.int64()), ("score", pa.float64()), ("n_matched", pa.int32())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for table in _runs(batches, "segment", "pack"):
                own, lists = table.filter(pc.is_valid(table["chunk_id"])), table.filter(pc.is_valid(table["asked"]))
                if lists.num_rows:
                    if own.num_rows != 1:
                        raise ValueError(f"the index has {own.num_rows} rows of chunks for the lists of a segment")
                    yield from handed_on(scored(own, lists))

        def scored(own: pa.Table, lists: pa.Table) -> Iterator[tuple]:
            ids = own["chunk_id"].combine_chunks().flatten().to_numpy()
            places, counts = _places(lists["gaps"])
            there = _left(places, counts, _bits(own, len(counts)))
            parts = []
            for f, mean, weight in zip(fields, means, weights, strict=True):
                tf, length = _often(lists[f"tf_{f}"], counts).astype(float), own[f"len_{f}"].combine_chunks().flatten().to_numpy()
                df = lists[f"df_{f}"].to_numpy()
                idf = np.log(1 + (total - df + 0.5) / (df + 0.5))
                s = weight * np.repeat(idf, counts) * tf / (tf + L.K1 * (1 - L.B + L.B * length[places] / (mean or 1.0)))
                parts.append(s[there])
            row = np.repeat(np.arange(len(counts)), counts)[there]
            places, ends = places[there], np.cumsum(np.bincount(row, minlength=len(counts)))
            starts = ends - np.bincount(row, minlength=len(counts))
            flat = lists["asked"].combine_chunks()
            of_row, flat = pc.list_parent_indices(flat).to_numpy(), flat.flatten()
            question = flat.field("query_id").dictionary_encode()
            codes, term_weights, needs = question.indices.to_numpy(), flat.field("weight").to_numpy(zero_copy_only=False), flat.field("need").to_numpy()
            order = np.argsort(codes, kind="stable")
            for a, b in pairwise([*np.flatnonzero(np.diff(codes[order], prepend=-1)).tolist(), len(order)]):
                rows = of_row[order[a:b]]
                spans = [slice(starts[i], ends[i]) for i in rows]
                at = np.concatenate([places[x] for x in spans])
                met = np.bincount(at, minlength=len(ids))
                hit = np.flatnonzero(met >= needs[order[a]])
                if not len(hit):
                    continue
                each = np.repeat(term_weights[order[a:b]], ends[rows] - starts[rows])
                best = np.max([np.bincount(at, each * np.concatenate([p[x] for x in spans]), len(ids))[hit] for p in parts], axis=0)
                if k is not None:
                    keep = _first(ids[hit], best, k, margin)
                    hit, best = hit[keep], best[keep]
                yield question.dictionary.take(pa.array(np.full(len(hit), codes[order[a]]))), ids[hit], best, met[hit].astype(np.int32)

        def handed_on(parts: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
            held, n = [], 0
            for x in parts:
                held.append(pa.RecordBatch.from_arrays([x[0], *[pa.array(v, f.type) for v, f in zip(x[1:], of, strict=True)]], ["query_id", *of.names]))
                n += len(x[1])
                if n >= PAIRS:
                    yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                    held, n = [], 0
            if held:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()

        return rows.mapInArrow(run, f"query_id {terms.schema['query_id'].dataType.simpleString()}, chunk_id long, score double, n_matched int")

    def matches(self, terms: DataFrame, boosts: Mapping[str, float] | None = None) -> DataFrame:
        """All matches of questions (query_id, token, weight): query_id, chunk_id, score, n_matched."""
        return self._met(self.log.read(), terms.select("query_id", "token", "weight", F.lit(1).cast("long").alias("need")), boosts or {})

    def search(self, terms: DataFrame, k: int = 10, min_match: float = 0.3, boosts: Mapping[str, float] | None = None, digits: int = 6, seed: int = 64) -> DataFrame:
        """The k best chunks of each question, ties by id: query_id, chunk_id, score, n_matched, n_terms, rank.

        ``seed`` is without effect: segments give their own k best, and no first bound is wanted.
        """
        wanted = terms.groupBy("query_id").agg(F.countDistinct("token").alias("n_terms"))
        need = F.greatest(F.lit(1), F.floor(F.lit(min_match) * F.col("n_terms"))).cast("long").alias("need")
        met = self._met(self.log.read(), terms.join(L.small(wanted), "query_id").select("query_id", "token", "weight", need), boosts or {}, k, 2 * 10.0**-digits)
        found = met.join(L.small(wanted), "query_id").select("query_id", "chunk_id", F.round("score", digits).alias("score"), "n_matched", "n_terms")
        return L.top(found, k)
