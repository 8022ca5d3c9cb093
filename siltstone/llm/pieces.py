"""SentencePiece encoding and decoding (11): a table of distinct chunks, segmented once each and joined back by position.

Pieces of these models hold whitespace markers at their beginning only, so no merge crosses the place before a run
of markers. A text is therefore cut there into chunks (markers and the word behind them), and a chunk has the same
ids wherever it stands. The steps:

1. Texts are dealt into slices of bounded size by a hash. Within a slice chunks are told apart (Arrow's dictionary), so a
   word is there once, however often it stands.
2. The slices' distinct chunks are dealt to buckets by their hash, packed: one row for each slice and bucket. A bucket tells its
   chunks apart again, has each distinct one segmented once by the library, and answers every slice in the order it asked.
3. Slices meet their answers, and every position of every text takes its chunk's ids.

The texts are shuffled once, compressed: both plans read the same exchange. A chunk has one entry for each slice at most, also the most frequent
one, and a task holds a slice's texts or a bucket's chunks, whose sizes follow from the number of slices and buckets and not from
any key. Rows that repeat are dealt apart by the partition they come from.

A model whose pieces do cross markers, or which rewrites texts before it segments them, has whole texts as chunks: the
same plan, each distinct text segmented once.

Defined results: a null text counts as empty and has no ids but the end id; rows that repeat give rows that repeat; ids of
documents may be null; a very long text is a slice's only one and is encoded whole; other columns stay; an empty table gives
an empty one. Decoding takes null ids as none and skips control ids, as the library does.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import partitions, unused
from siltstone.llm.wordhash import U, buffers, lanes

_MARK = "▁"


@lru_cache(maxsize=4)
def processor(model: str):
    """The library's processor of a model file, once for each worker."""
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=model)


@lru_cache(maxsize=4)
def separable(model: str) -> bool:
    """Whether chunks can be segmented one by one: markers at pieces' beginnings only, one put before a text, texts taken as they are."""
    sp = processor(model)
    pieces = (sp.id_to_piece(i) for i in range(sp.get_piece_size()))
    plain = all(sp.normalize(t) == (_MARK + t.replace(" ", _MARK)) for t in ("a", " a  b ", "éé ﬁ Ａ", "\t\x00\n "))
    return plain and not any(_MARK in p.lstrip(_MARK) for p in pieces)


def _chunks(texts: pa.Array, whole: bool) -> tuple[pa.Array, np.ndarray]:
    """The chunks of all texts, each led by a blank for its first marker, and the number of the first chunk of each text, and the end.

    Chunks tile the texts' bytes, so they share them.
    """
    texts = pc.fill_null(texts, "")
    if not whole and pc.any(pc.match_substring(texts, _MARK)).as_py():
        texts = pc.replace_substring(texts, _MARK, " ")
    plain, ends = buffers(texts)
    # A blank before each text that isn't empty.
    full = ends[1:] > ends[:-1]
    at = ends + np.concatenate([[0], np.cumsum(full)])
    raw = np.insert(plain, ends[:-1][full], 0x20)
    if not len(raw):
        return pa.array([], pa.large_string()), np.zeros(len(at), np.int64)
    begins = np.zeros(len(raw), bool)
    if not whole:
        blank = raw == 0x20
        begins[1:] = blank[1:] & ~blank[:-1]
    begins[at[:-1][full]] = True
    edges = np.append(np.flatnonzero(begins), len(raw)).astype(np.int64)
    found = pa.LargeStringArray.from_buffers(len(edges) - 1, pa.py_buffer(edges), pa.py_buffer(raw))
    return found, np.searchsorted(edges[:-1], at)


def _dictionary(texts: pa.Array, whole: bool, buckets: int) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """Codes by position, the first position of each text, and the distinct chunks in the order of their codes with their buckets.

    Codes follow the chunks' buckets and digests, so they depend on the set of texts alone.
    """
    found, first = _chunks(texts, whole)
    coded = found.dictionary_encode()
    raw, at = buffers(coded.dictionary)
    hashed = lanes(raw, at[:-1], at[1:])
    bucket = (hashed[:, 0] % U(buckets)).astype(np.int64)
    order = np.lexsort((hashed[:, 1], hashed[:, 0], bucket))
    rank = np.empty(len(order), np.int32)
    rank[order] = np.arange(len(order), dtype=np.int32)
    return rank[coded.indices.to_numpy(zero_copy_only=False)], first, coded.dictionary.take(pa.array(order)), bucket[order]


def _packed(parts: Iterable[np.ndarray]) -> pa.Array:
    """Each array's bytes, compressed: chunks and ids are told by their frequencies, which a shuffle's own codec doesn't use."""
    import zstandard

    press = zstandard.ZstdCompressor(level=3)
    return pa.array([press.compress(np.ascontiguousarray(x)) for x in parts], pa.binary())


def _pressed(texts: pa.Array) -> pa.Array:
    """Each text compressed; null stays null."""
    raw, at = buffers(texts)
    packed = _packed(raw[a:b] for a, b in pairwise(at.tolist()))
    return pc.if_else(texts.is_null(), pa.scalar(None, pa.binary()), packed) if texts.null_count else packed


def _texts(column: pa.ChunkedArray) -> pa.Array:
    import zstandard

    press = zstandard.ZstdDecompressor()
    return pa.array([None if x is None else press.decompress(x) for x in column.to_pylist()], pa.string())


def _unpacked(column: pa.ChunkedArray, kind) -> list[np.ndarray]:
    import zstandard

    press = zstandard.ZstdDecompressor()
    return [np.frombuffer(press.decompress(x), kind) for x in column.to_pylist()]


def _gather(flat: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The runs ``begin[i]:begin[i] + size[i]`` of an array, one behind the other."""
    ends = np.cumsum(size)
    return flat[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(begin - ends + size, size)]


def _segment(model: str, chunks: list[str]) -> list[list[int]]:
    """Ids of each chunk; the library puts the first marker itself, but not before an empty text."""
    sp = processor(model)
    alone = sp.piece_to_id(_MARK)
    ids = sp.encode([c[1:] for c in chunks], num_threads=1)
    return [i or [alone] for i in ids]


def encode(docs: DataFrame, model: str, text: str = "text", ids: str = "ids", add_end: bool = True, slice_bytes: int = 8 << 20) -> DataFrame:
    """The table with an array of ids for each text, the end id last.

    ``slice_bytes`` bounds the mean size of a slice's texts, which a task holds; the slices' number follows from the bytes of all texts.
    """
    spark = docs.sparkSession
    whole = not separable(model)
    end = [processor(model).eos_id()] if add_end else []
    part = unused("_slice", docs.columns)
    kind = np.dtype("<u2" if processor(model).get_piece_size() <= 1 << 16 else "<i4")
    total = docs.agg(F.sum(F.octet_length(text).cast("long"))).first()[0] or 0
    n = max(partitions(docs), -(-total // slice_bytes))
    buckets = max(partitions(docs), n // 16)
    key = F.xxhash64(F.coalesce(F.col(text), F.lit("")), F.spark_partition_id(), *[F.col(f"`{f.name}`") for f in docs.schema if f.dataType.typeName() in ("long", "integer", "string") and f.name != text])

    def pressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.set_column(batch.schema.get_field_index(text), text, _pressed(batch.column(text)))

    moved = ", ".join([f"`{f.name}` {'binary' if f.name == text else f.dataType.simpleString()}" for f in docs.schema] + [f"`{part}` int"])
    dealt = docs.withColumn(part, F.pmod(key, F.lit(n)).cast("int")).mapInArrow(pressed, moved).repartition(n, part)

    def distinct(texts: pa.Table) -> pa.Table:
        """A row for each bucket that the slice asks: its chunks, one behind the other, and their sizes."""
        _, _, chunks, bucket = _dictionary(_texts(texts[text]), whole, buckets)
        raw, at = buffers(chunks)
        cuts = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1))
        spans = list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))
        sizes = np.diff(at).astype(np.int32)
        number = texts[part][0].as_py() if texts.num_rows else 0
        return pa.table({"slice": pa.array([number] * len(spans), pa.int32()), "bucket": pa.array(bucket[cuts[:-1]].astype(np.int32)), "bytes": _packed(raw[at[i] : at[j]] for i, j in spans), "sizes": _packed(sizes[i:j] for i, j in spans)})

    def segment(asked: pa.Table) -> pa.Table:
        """A row for each slice that asked: how many ids each of its chunks has, and the ids."""
        by_slice = _unpacked(asked["sizes"], np.int32)
        counts, sizes = [len(x) for x in by_slice], np.concatenate(by_slice).astype(np.int64)
        edges = np.concatenate([[0], np.cumsum(sizes)])
        coded = pa.LargeStringArray.from_buffers(len(sizes), pa.py_buffer(edges), pa.py_buffer(np.concatenate(_unpacked(asked["bytes"], np.uint8)))).dictionary_encode()
        ids = _segment(model, coded.dictionary.to_pylist())
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter(chain.from_iterable(ids), kind, int(size.sum()))
        at, begin = coded.indices.to_numpy(zero_copy_only=False), np.cumsum(size) - size
        ends = np.cumsum(counts)
        mine = [at[j - c : j] for c, j in zip(counts, ends.tolist(), strict=True)]
        return pa.table({"slice": asked["slice"], "bucket": asked["bucket"], "lengths": _packed(size[m].astype(np.int32) for m in mine), "flat": _packed(_gather(flat, begin[m], size[m]) for m in mine)})

    asked = dealt.groupBy(part).applyInArrow(distinct, "slice int, bucket int, bytes binary, sizes binary")
    answers = asked.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(segment, "slice int, bucket int, lengths binary, flat binary")

    def join(texts: pa.Table, known: pa.Table) -> pa.Table:
        """Each position takes the ids of its chunk."""
        if not texts.num_rows:
            return pa.table({f.name: pa.array([], pa.string() if f.name == text else f.type) for f in texts.schema if f.name != part} | {ids: pa.array([], pa.list_(pa.int32()))})
        plain = _texts(texts[text])
        at, first, chunks, _ = _dictionary(plain, whole, buckets)
        known = known.sort_by("bucket")
        size = np.concatenate([np.zeros(0, np.int64), *_unpacked(known["lengths"], np.int32)])
        flat = np.concatenate([np.zeros(0, kind), *_unpacked(known["flat"], kind)])
        if len(size) != len(chunks):
            raise RuntimeError("the slice's chunks differ from those that were segmented: the input isn't the same when it is read again")
        begin = np.cumsum(size) - size
        # Positions by text, with a last one for the end id.
        flat, begin, size = np.append(flat, end).astype(np.int32), np.append(begin, len(flat)), np.append(size, len(end))
        places = np.insert(at, first[1:], len(chunks))
        took = size[places]
        offsets = np.concatenate([[0], np.cumsum(took)])[first + np.arange(len(first))]
        found = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(_gather(flat, begin[places], took)))
        return texts.set_column(texts.schema.get_field_index(text), text, plain).drop_columns([part]).append_column(ids, found)

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema] + [f"`{ids}` array<int>"])
    return dealt.groupBy(part).cogroup(answers.groupBy("slice")).applyInArrow(join, schema)


def decode(encoded: DataFrame, model: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """The table with the library's text of each array of ids, instead of the array."""
    kept = [c for c in encoded.columns if c != ids]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema if f.name != ids] + [f"`{text}` string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = processor(model)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = sp.decode([[i for i in x if i is not None] if x else [] for x in part.column(ids).to_pylist()], num_threads=1)
                yield pa.RecordBatch.from_arrays([part.column(c) for c in kept] + [pa.array(found, pa.string())], [*kept, text])

    return encoded.mapInArrow(run, schema)
