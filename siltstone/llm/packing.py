"""Packing (6): hierarchical multi-length packing of tokenised documents.

Documents are tokenised where they are read and routed to tiers by length (256, 512, 1024, 2048 and 4096
tokens; longer ones give whole windows of 4096 and route the rest). Each tier is packed into windows of its size:
a document opens a window, and the gap behind it is filled from shorter tiers, whole documents first, the last
one cut where the window ends. So every window is full; at the end of a partition the last, open window is cut
into smaller tiers, and at most 255 tokens a partition stand in a padded window. Windows of a tier are dealt
to step groups of equal token budgets over all partitions, so that only the last group of a tier may be short: ``step``
numbers the groups of each tier.

Texts are not shuffled and no state goes beyond the partition: documents wait in tiers up to ``buffer`` tokens, so
the memory of a task is bounded, and a lost task is packed again from its own input alone. Sequence numbers carry the
partition in their upper bits. Step groups come from counts of windows by partition and tier, summed in their order.

Defined results: null and empty texts give the end token alone; repeated rows are packed each; null ids stay
null; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections import deque
from collections.abc import Iterator
from itertools import compress
from operator import add

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.common import keep
from siltstone.llm.wordhash import slices

TIERS = (4096, 2048, 1024, 512, 256)
_FIELDS = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, number long"
_loaded: dict[str, Encoder] = {}
_STOP = re.compile(r"[.,]$", re.M)
_MARK = "\x01"


class Encoder:
    """Ids of whole texts, remembered by word.

    Fit for tokenizers that drop white space and never merge across it: a text's ids are those of the pieces
    between its blanks and line ends, one after the other. For other tokenizers whole texts are encoded.
    What a piece encodes to is kept for up to ``most`` pieces (about 200 bytes each) and outlives tasks, as workers do;
    beyond that all is forgotten but what the texts at hand need.
    Words of letters alone are one token run each, so they are learned many at a time, joined by blanks and
    parted where tokens end words; a word in other case, or with a stop behind it, is put together from its parts.
    """

    def __init__(self, path: str, most: int = 1_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.most, self.known = Tokenizer.from_file(path), most, {"": b""}
        whole = json.loads(self.tokenizer.to_str())
        suffix = whole["model"].get("end_of_word_suffix")
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if suffix and t.endswith(suffix)]] = True
        self.lowers = "Lowercase" in json.dumps(whole["normalizer"])
        self.by_piece = self._splits_at_blanks()
        mark = self.tokenizer.encode(_MARK, add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None
        self.plain = self._plain(whole)

    @classmethod
    def at(cls, path: str, most: int) -> Encoder:
        """The worker's encoder of this file; loading takes longer than many tasks."""
        if path not in _loaded:
            _loaded[path] = cls(path)
        _loaded[path].most = most
        return _loaded[path]

    def _splits_at_blanks(self) -> bool:
        """Whether blanks and line ends leave nothing behind in ids: tried on texts that other tokenizers join or mark."""
        ids = lambda t: self.tokenizer.encode(t, add_special_tokens=False).ids
        return all(ids(t) == [i for p in t.replace("\n", " ").split(" ") if p for i in ids(p)] for t in ("a b", " the  of\nThe, 12 a.\n\nb ", "é x\ny", "don't it 's"))

    def _plain(self, whole: dict) -> Tokenizer:
        """The tokenizer without the steps that words of lower-case letters below U+0180 pass unchanged, if it has such steps."""
        from tokenizers import Tokenizer

        steps = (whole["pre_tokenizer"] or {}).get("pretokenizers") or [{}]
        if not self.by_piece or steps[0].get("type") != "Split":
            return self.tokenizer
        less = whole | {"normalizer": None, "pre_tokenizer": whole["pre_tokenizer"] | {"pretokenizers": [{"type": "WhitespaceSplit"}, *steps[1:]]}}
        made = Tokenizer.from_str(json.dumps(less))
        letters = [chr(i) for i in range(0x180) if chr(i).isalpha() and i != 0x130 and chr(i).lower() == chr(i)]
        tried = [" ".join(a + b + a for a in letters) for b in letters]
        same = all(x.ids == y.ids for x, y in zip(*(t.encode_batch_fast(tried, add_special_tokens=False) for t in (made, self.tokenizer)), strict=True))
        return made if same else self.tokenizer

    def _each(self, pieces: list[str], known: dict[str, bytes]) -> None:
        """Learn any pieces, many at a time between marks that none of them has."""
        for at in range(0, len(pieces), 2000):
            part = pieces[at : at + 2000]
            joined = f" {_MARK} ".join(part)
            if self.mark is None or joined.count(_MARK) != len(part) - 1:
                found = [np.array(e.ids, np.uint32).tobytes() for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)]
            else:
                ids = np.array(self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, np.uint32)
                data, cuts = ids.tobytes(), (4 * np.flatnonzero(ids == self.mark)).tolist()
                found = [data[a:b] for a, b in zip([0, *(c + 4 for c in cuts)], [*cuts, len(data)], strict=True)]
            known.update(zip(part, found, strict=True))

    def _words(self, words: list[str], known: dict[str, bytes], lower: bool) -> None:
        """Learn words of letters alone, which are lower-cased or not."""
        if not self.ends.any():
            return self._each(words, known)
        for at in range(0, len(words), 2000):
            part = words[at : at + 2000]
            ids = np.array((self.plain if lower else self.tokenizer).encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, np.uint32)
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) != len(part) or len(ids) != cuts[-1]:
                self._each(part, known)
                continue
            data, lo = ids.tobytes(), 0
            for p, hi in zip(part, (4 * cuts).tolist(), strict=True):
                known[p] = data[lo:hi]
                lo = hi

    def _learn(self, missing: list[str], known: dict[str, bytes]) -> None:
        """Learn pieces: the plain ones from their stems, others whole.

        Plain are letters below U+0180 with a stop behind them or none: there a letter is lower-cased to one letter,
        whoever does it. Not so U+0130, which leaves a mark that isn't a letter and joins what follows.
        """
        joined = "\n".join(missing)
        if max(joined) >= "\u0180" or "\u0130" in joined:
            odd = {p for p in missing if max(p) >= "\u0180" or "\u0130" in p}
            self._each(list(odd), known)
            missing = [p for p in missing if p not in odd]
            joined = "\n".join(missing)
        if self.lowers:
            joined = joined.lower()
        stems = _STOP.sub("", joined).split("\n")
        plain = list(map(str.isalpha, stems))
        self._words(list(set(compress(stems, plain)).difference(known)), known, self.lowers)
        self._each([p for p, good in zip(missing, plain, strict=True) if not good], known)
        self._each([p for p in (".", ",") if p not in known], known)
        tails = {".": known["."], ",": known[","]}
        whole, stems = list(compress(missing, plain)), compress(stems, plain)
        known.update(zip(whole, map(add, map(known.__getitem__, stems), [tails.get(p[-1], b"") for p in whole]), strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        if not self.by_piece:
            return [np.array(e.ids, np.uint32).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        split = [t.replace("\n", " ").split(" ") for t in texts]
        met = set().union(*split)
        missing = met.difference(self.known)
        if len(self.known) + len(missing) > self.most:
            # What this batch needs stays, and so the frequent pieces do.
            kept = met.difference(missing)
            self.known = dict(zip(kept, map(self.known.__getitem__, kept), strict=True)) | {"": b""}
        if missing:
            self._learn(list(missing), self.known)
        get = self.known.__getitem__
        return [b"".join(map(get, s)) for s in split]


class Packer:
    """Packs pieces (doc, start, ids); ``push`` and ``finish`` give finished windows as lists of pieces."""

    def __init__(self, tiers: tuple[int, ...] = TIERS, buffer: int = 1 << 20):
        self.tiers, self.buffer = tiers, buffer
        self.pools: dict[int, deque] = {t: deque() for t in tiers}
        self.held = 0

    def _tier(self, n: int) -> int:
        return next(t for t in reversed(self.tiers) if n <= t)

    def _put(self, piece: tuple, first: bool = False) -> None:
        pool = self.pools[self._tier(len(piece[2]))]
        (pool.appendleft if first else pool.append)(piece)
        self.held += len(piece[2])

    def _take(self, tier: int) -> tuple:
        piece = self.pools[tier].popleft()
        self.held -= len(piece[2])
        return piece

    def push(self, doc: tuple, ids: np.ndarray) -> Iterator[list[tuple]]:
        top, at = self.tiers[0], 0
        while len(ids) - at >= top:
            yield [(doc, at, ids[at : at + top])]
            at += top
        if at < len(ids):
            self._put((doc, at, ids[at:]))
        if self.held > self.buffer:
            yield from self._drain(self.buffer // 2)

    def _fill(self, size: int) -> tuple[list[tuple], int]:
        """A window of this size opened by its tier's first document, and the gap that is left."""
        window = [self._take(size)]
        gap = size - len(window[0][2])
        while gap:
            fits = next((t for t in self.tiers if t <= gap and self.pools[t]), None)
            if fits is None:
                fits = next((t for t in reversed(self.tiers) if t <= 2 * size and self.pools[t]), None)
            if fits is None:
                break
            doc, start, ids = self._take(fits)
            if len(ids) > gap:
                self._put((doc, start + gap, ids[gap:]), True)
                ids = ids[:gap]
            window.append((doc, start, ids))
            gap -= len(ids)
        return window, gap

    def _drain(self, down_to: int) -> Iterator[list[tuple]]:
        while self.held > down_to:
            size = next(t for t in self.tiers if self.pools[t])
            window, gap = self._fill(size)
            if gap:
                yield from self._shrink(window)
            else:
                yield window

    def _shrink(self, window: list[tuple]) -> Iterator[list[tuple]]:
        """The pieces of a window that can't be filled, in full windows of smaller tiers and a last one below the least."""
        left = sum(len(p[2]) for p in window)
        queue = deque(window)
        for size in [*self.tiers, None]:
            while left and (size is None or left >= size):
                need, out = min(left, size or left), []
                left -= need
                while need:
                    doc, start, ids = queue.popleft()
                    if len(ids) > need:
                        queue.appendleft((doc, start + need, ids[need:]))
                        ids = ids[:need]
                    out.append((doc, start, ids))
                    need -= len(ids)
                yield out

    def finish(self) -> Iterator[list[tuple]]:
        yield from self._drain(0)


def pack(docs: DataFrame, path: str, end_id: int = 2, step_tokens: int = 1 << 16, buffer: int = 1 << 20, remember: int = 1_000_000, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: the document, the piece's place in it, its ids' CRC-32, and its place in a sequence.

    ``tier`` is the length of the sequence with its padding, and ``step`` the step group among those of its tier.
    ``remember`` is how many pieces of texts a worker keeps the ids of; fewer take less memory and more time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, packer = Encoder.at(path, remember), Packer(buffer=buffer)
        at = TaskContext.get().partitionId() << 40
        count, per_tier, rows = at, dict.fromkeys(TIERS, 0), []
        tail = np.array([end_id], "<u4").tobytes()

        def place(window: list[tuple]) -> None:
            nonlocal count
            total, offset = sum(len(p[2]) for p in window), 0
            tier = total if total & (total - 1) == 0 else TIERS[0]
            number = per_tier.get(tier, 0)
            per_tier[tier] = number + 1
            for (doc, n), start, ids in window:
                rows.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), n, count, offset, tier, number))
                offset += len(ids)
            count += 1

        def flush() -> pa.RecordBatch:
            kinds = [pa.int64()] * 7 + [pa.int32(), pa.int64()]
            batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [f.split()[0] for f in _FIELDS.split(", ")])
            rows.clear()
            return batch

        for whole in batches:
            for batch in slices(whole, "text", 1 << 20):
                for doc, data in zip(batch.column("doc_id").to_pylist(), encoder.encode(batch.column("text").to_pylist()), strict=True):
                    ids = np.frombuffer(data + tail, "<u4")
                    for window in packer.push((doc, len(ids)), ids):
                        place(window)
                if len(rows) > 10_000:
                    yield flush()
        for window in packer.finish():
            place(window)
        if rows:
            yield flush()

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    # A lost partition that is made anew may come in another order; in this one it is packed as before.
    pieces = rows.sortWithinPartitions(F.xxhash64("doc_id", "text"), "doc_id").mapInArrow(run, _FIELDS)
    return with_steps(keep(pieces), step_tokens)


def with_steps(pieces: DataFrame, step_tokens: int) -> DataFrame:
    """``pieces`` with ``step`` instead of ``number``, the window's number in its partition and tier."""
    part = F.shiftright("sequence_id", 40).alias("_part")
    before = Window.partitionBy("tier").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = pieces.groupBy(part, "tier").agg((F.max("number") + 1).alias("n"))
    base = counts.select("_part", F.col("tier").alias("_tier"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_base"))
    joined = pieces.join(base, (part == base["_part"]) & (F.col("tier") == base["_tier"]))
    step = F.floor((F.col("_base") + F.col("number")) / F.greatest(F.lit(1), F.floor(F.lit(step_tokens) / F.col("tier")))).cast("long")
    return joined.select(*[c for c in pieces.columns if c != "number"], step.alias("step"))
