"""Substring dedup (3): hashed units, grouped by digest; the earliest occurrence stays, offsets are kept.

Units are of two kinds. Lines of ``least`` words or more are hashed with their words lower-cased and their white
space ignored. The query takes every line (``least`` = 1), which covers paragraphs and short texts too, as all their
lines repeat. Passages that repeat inside longer lines share no line, so runs of ``window`` words are units as well: of each ``guard`` consecutive starts the run of the least digest is taken (winnowing), so two texts that share
``window + guard - 1`` words (50) or more share such a unit, wherever lines end. The query's ``guard`` is no larger than
``window``, so neighbouring runs of a shared passage touch and no word between them stays; at each of its ends ``guard - 1`` words may. The default
of 13 leaves 24 words of a passage at most, whatever the digests, with nearly twice as many runs as the query's 25.

Digests have 128 bits: two lanes, from each word on, that are never joined. A pre-aggregated count finds those that occur more than once, with the least id that has them;
only occurrences of those are ranked, by (id, row digest, offset). All but the earliest are removed: their
spans, in code points of the original text, are merged, and the text is cut with the spans kept beside it. A unit
that a third of all rows share is combined before its shuffle, and its occurrences are joined as a skewed key.

Defined results: null texts stay null and have no units; rows with the same id and text get the same
decision; null ids rank first; overlapping repeats inside one text are removed from their second occurrence on; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import keep, row_key
from siltstone.llm.wordhash import U, Words, digests, slices, windows

_UNITS = "_k1 long, _k2 long, start int, end int, h1 long, h2 long"


def _line_hashes(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First word, end word and two digests of each line with words."""
    n = len(words.start)
    if not n:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, U),) * 2
    breaks = np.cumsum(words.raw == 0x0A)
    owner = np.searchsorted(words.first, np.arange(n), side="right")
    line = breaks[words.start] + owner
    first = np.flatnonzero(np.concatenate(([True], line[1:] != line[:-1])))
    last = np.append(first[1:], n)
    # A line is hashed as the sequence of its words' digests.
    lanes = digests(words.lanes.view(np.uint8).ravel(), 16 * first, 16 * last)
    return first, last, lanes[:, 0], lanes[:, 1]


def _picked(h: np.ndarray, guard: int) -> np.ndarray:
    """Positions of the least digest of each ``guard`` consecutive ones."""
    if len(h) < guard:
        return np.zeros(0, np.int64)
    view = np.lib.stride_tricks.sliding_window_view(h, guard)
    return np.unique(view.argmin(axis=1) + np.arange(len(view)))


def units(docs: DataFrame, least: int, window: int, guard: int) -> DataFrame:
    """The units of every text: row key, span in code points, digest; docs: _k1, _k2, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", 1 << 20):
                words = Words(batch.column("text"), lower=True)
                if not len(words.start):
                    continue
                first, last, one, two = _line_hashes(words)
                long = last - first >= least
                parts = [(first[long], last[long], one[long], two[long])]
                h1, h2 = windows(words.hash, window), windows(np.ascontiguousarray(words.lanes[:, 1]), window)
                for _, a, b in words.texts():
                    at = a + _picked(h1[a : b - window + 1], guard) if b - a >= window else np.zeros(0, np.int64)
                    if len(at):
                        parts.append((at, at + window, h1[at] ^ U(1), h2[at]))
                lo, hi, d1, d2 = (np.concatenate(x) for x in zip(*parts, strict=True))
                if not len(lo):
                    continue
                text = np.searchsorted(words.first, lo, side="right") - 1
                base = words.code_points(words.at[text])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("_k1").take(pa.array(text)),
                        batch.column("_k2").take(pa.array(text)),
                        pa.array((words.code_points(words.start[lo]) - base).astype(np.int32)),
                        pa.array((words.code_points(words.end[hi - 1]) - base).astype(np.int32)),
                        pa.array(d1.view(np.int64)),
                        pa.array(d2.view(np.int64)),
                    ],
                    ["_k1", "_k2", "start", "end", "h1", "h2"],
                )

    return docs.mapInArrow(run, _UNITS)


def removed_spans(docs: DataFrame, least: int, window: int, guard: int) -> DataFrame:
    """Row keys with ``spans``, the later occurrences (start, end, id of the earliest)."""
    found = units(docs, least, window, guard)
    keys = ["h1", "h2"]
    groups = found.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("_k2").alias("home")).where("n > 1").select(*keys, "home")
    twice = keep(found.join(groups, keys))
    place = F.struct("_k1", "start")
    earliest = twice.where("_k2 = home").groupBy(*keys).agg(F.min(place).alias("p"), F.max(place).alias("q"))
    at_home = twice.where("_k2 = home").join(earliest.where("p < q").select(*keys, "p"), keys).where(place > F.col("p"))
    gone = twice.where("_k2 <> home").unionByName(at_home.drop("p"))
    return gone.groupBy("_k1", "_k2").agg(F.array_sort(F.collect_set(F.struct("start", "end", "home"))).alias("spans"))


def _cut(text: str | None, spans) -> tuple[str | None, list[tuple[int, int]], list[int]]:
    merged: list[list[int]] = []
    homes = set()
    for s in spans if spans is not None else ():
        homes.add(int(s["home"]))
        if merged and s["start"] <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], s["end"])
        else:
            merged.append([s["start"], s["end"]])
    if text is None or not merged:
        return text, [], []
    ends = [0, *(e for _, e in merged)]
    starts = [*(s for s, _ in merged), len(text)]
    return "".join(text[a:b] for a, b in zip(ends, starts, strict=True)), merged, sorted(homes)


def dedup_substrings(docs: DataFrame, least: int = 1, window: int = 25, guard: int = 13, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, the cut text, ``removed`` (spans start:end of the original text), n_removed_chars and ``kept_in``, the
    ids of documents where the removed units stay."""
    keyed = docs.select(*row_key(doc_id, text), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    spans = removed_spans(keyed.select("_k1", "_k2", F.coalesce("text", F.lit("")).alias("text")), least, window, guard)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", 1 << 20):
                texts, rows = batch.column("text"), [(None, [], [])] * batch.num_rows
                cut_rows = np.flatnonzero(batch.column("spans").is_valid().to_numpy(zero_copy_only=False))
                for i in cut_rows:
                    rows[i] = _cut(texts[i].as_py(), batch.column("spans")[i].as_py())
                if len(cut_rows):
                    changed = np.zeros(batch.num_rows, bool)
                    changed[cut_rows] = True
                    texts = pc.if_else(pa.array(changed), pa.array([r[0] for r in rows], texts.type), texts)
                removed = pa.array([",".join(f"{a}:{b}" for a, b in r[1]) for r in rows], pa.string())
                count = pa.array([sum(b - a for a, b in r[1]) for r in rows], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), texts, removed, count, pa.array([r[2] for r in rows], pa.list_(pa.int64()))], ["doc_id", "text", "removed", "n_removed_chars", "kept_in"])

    kind = keyed.schema["doc_id"].dataType.simpleString()
    joined = keyed.join(spans, ["_k1", "_k2"], "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(run, f"doc_id {kind}, text string, removed string, n_removed_chars long, kept_in array<long>")
