"""Evaluation texts leaking into training text: spaced-seed hashing.

A leak is a run of :data:`RUN` words of a passage in a document of which at most
:data:`MISREAD` differ. The run is cut into MISREAD + 2 blocks; whichever words differ, two
blocks are untouched, so one of the fixed masks made of two blocks always hits: the search
loses nothing. Every run of the documents is hashed under every mask; where a hash meets one of
a run of a passage, the two runs are compared word by word.

Passages are cut into runs by Spark, and equal runs of different passages are one. As long as they
fit into one block of bounded size, the block goes to the executors and the corpus needs no
shuffle. Beyond that the hashes are joined by Spark: a bitmap of fixed size of the hashes of the runs
goes out, and only those runs of the documents that it lets through are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshquarry.llm.subtitles import words
from meshquarry.session import spill

#: Words in a row that make a leak, and how many of them may be misread.
RUN, MISREAD = 16, 3
#: Most different runs of passages that are sent to the executors (some 340 bytes each with their hashes).
BLOCK = 250_000
#: Documents searched at once within a task; only speed depends on it.
TOGETHER = 64
#: Bits of the bitmap by which the join drops runs that meet nothing (2^27 bits are 16 MB).
BITMAP_BITS = 27
#: Words of a passage that are cut into runs at once.
PIECE = 4096
_BITS = 22
#: Hits compared at once.
_CHUNK = 1 << 16


def masks(run: int = RUN, misread: int = MISREAD) -> list[tuple[int, ...]]:
    """Word positions that each mask looks at: two of ``misread + 2`` blocks of the run."""
    cut = np.array_split(np.arange(run), misread + 2)
    return [tuple(int(i) for i in np.concatenate((a, b))) for a, b in combinations(cut, 2)]


_ODD = np.random.default_rng(20240229).integers(1 << 62, size=RUN, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_known: dict[str, int] = {}


def _ids(ws: list[str]) -> np.ndarray:
    """A 64-bit hash per word (kept for words met before)."""
    if len(_known) > 500_000:
        _known.clear()
    out = []
    for w in ws:
        h = _known.get(w)
        if h is None:
            h = _known[w] = xxhash.xxh64_intdigest(w)
        out.append(h)
    return np.array(out, dtype=np.uint64)


def seed_hashes(words_at: list[np.ndarray]) -> Iterator[np.ndarray]:
    """The hash of each run under each mask in turn; ``words_at`` has the first, second, ... words of all runs."""
    for k, mask in enumerate(masks()):
        h = np.full(len(words_at[0]), np.uint64((k + 1) * 0x9E3779B97F4A7C15 % (1 << 64)), dtype=np.uint64)
        for o in mask:
            h += words_at[o] * _ODD[o]
            h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        yield h


def _along(ids: np.ndarray) -> list[np.ndarray]:
    """The words of all runs of a text, place by place."""
    n = max(0, len(ids) - RUN + 1)
    return [ids[o : o + n] for o in range(RUN)]


def _windows(ids: np.ndarray) -> np.ndarray:
    return np.lib.stride_tricks.sliding_window_view(ids, RUN) if len(ids) >= RUN else np.zeros((0, RUN), np.uint64)


class SeedIndex:
    """Hashes of all masks of a block of different runs (n, RUN)."""

    def __init__(self, runs: np.ndarray) -> None:
        self.runs = runs
        h = np.concatenate(list(seed_hashes(list(runs.T))))
        order = np.argsort(h, kind="stable")
        self.hash, self.run = h[order], order % max(1, len(runs))
        self.bits = np.zeros(1 << _BITS, dtype=bool)
        self.bits[self.hash >> np.uint64(64 - _BITS)] = True

    def search(self, docs: list[np.ndarray]) -> np.ndarray:
        """(number of the document, number of the run) of each leak, once each."""
        ids = np.concatenate(docs)
        owner = np.repeat(np.arange(len(docs)), [len(x) for x in docs])
        found = []
        for h in seed_hashes(_along(ids)):
            at = np.flatnonzero(self.bits[h >> np.uint64(64 - _BITS)])
            at = at[owner[at] == owner[at + RUN - 1]]
            lo, hi = np.searchsorted(self.hash, h[at], "left"), np.searchsorted(self.hash, h[at], "right")
            n = hi - lo
            ends = np.cumsum(n)
            for a in range(0, int(ends[-1]) if len(ends) else 0, _CHUNK):  # however many runs share a hash, few are held at once
                k = np.arange(a, min(a + _CHUNK, int(ends[-1])))
                own = np.searchsorted(ends, k, "right")
                run, pos = self.run[lo[own] + k - (ends[own] - n[own])], at[own]
                same = (self.runs[run] == ids[pos[:, None] + np.arange(RUN)]).sum(1) >= RUN - MISREAD
                found.append(np.unique(np.stack((owner[pos[same]], run[same])), axis=1))
        return np.unique(np.concatenate(found, axis=1), axis=1).T if found else np.zeros((0, 2), np.int64)


def passage_runs(items: DataFrame) -> DataFrame:
    """run (the word hashes of RUN words, as bytes), item_id: the runs of all passages; passages without a run give nothing.

    A long passage is cut in pieces that overlap by a run, so no task holds all runs of one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, t in zip(b.column("item_id"), b.column("passage")):
                ids = _ids(words(t.as_py()))
                for k in range(0, max(0, len(ids) - RUN + 1), PIECE):
                    w = np.unique(_windows(ids[k : k + PIECE + RUN - 1]), axis=0)
                    yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in w], type=pa.binary()), pa.array([i.as_py()] * len(w), type=pa.int64())], names=["run", "item_id"])

    return items.select(F.col("item_id").cast("long"), "passage").mapInArrow(run, "run binary, item_id long").distinct()


def _texts(b: pa.RecordBatch) -> Iterator[tuple[list[int], list[np.ndarray]]]:
    """Documents with at least one run, some at a time: doc_ids and word hashes."""
    ids, column = b.column("doc_id").to_pylist(), b.column("text")
    for k in range(0, len(ids), TOGETHER):
        texts = [(d, _ids(w)) for d, t in zip(ids[k : k + TOGETHER], column[k : k + TOGETHER]) if len(w := words(t.as_py())) >= RUN]
        if texts:
            yield [d for d, _ in texts], [w for _, w in texts]


def _searched(corpus: DataFrame, runs: list[bytes]) -> DataFrame:
    """doc_id, n (the place of the run in ``runs``) of each leak, by an index of one block in every task."""
    sent = corpus.sparkSession.sparkContext.broadcast(b"".join(runs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = SeedIndex(np.frombuffer(sent.value, dtype=np.uint64).reshape(-1, RUN))
        for b in batches:
            for docs, texts in _texts(b):
                got = index.search(texts)
                yield pa.RecordBatch.from_arrays([pa.array([docs[d] for d, _ in got], type=pa.int64()), pa.array(got[:, 1].astype(np.int64))], names=["doc_id", "n"])

    return corpus.mapInArrow(run, "doc_id long, n long")


def _joined(corpus: DataFrame, runs: DataFrame) -> DataFrame:
    """doc_id, run of each leak, by joining hashes: for indexes of any size."""

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = b.column("run").to_pylist()
            runs_ = np.frombuffer(b"".join(own), dtype=np.uint64).reshape(-1, RUN)
            for h in seed_hashes(list(runs_.T)):
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), b.column("run")], names=["h", "run"])

    index = spill(runs.mapInArrow(seeds, "h long, run binary"), "seeds")
    top = F.shiftrightunsigned("h", 64 - BITMAP_BITS)
    bits = index.groupBy(F.bitmap_bucket_number(top).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(top)).alias("b"))
    pieces = {r.k: bytes(r.b) for r in bits.collect()}  # 2^BITMAP_BITS bits at most
    sent = corpus.sparkSession.sparkContext.broadcast(pieces)

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat = np.zeros((1 << BITMAP_BITS) // 8 + 8192, dtype=np.uint8)
        for k, v in sent.value.items():
            at = 0 if k == 0 else 1 + (k - 1) * len(v)
            flat[at : at + len(v)] = np.frombuffer(v, dtype=np.uint8)
        # bit positions count from 1 in all buckets but that of 0
        held = lambda x: (flat[np.where(x == 0, 0, 1 + (x - 1) // 8)] >> np.where(x == 0, 0, (x - 1) % 8).astype(np.uint8)) & 1
        for b in batches:
            for docs, texts in _texts(b):
                for d, ids in zip(docs, texts):
                    w = _windows(ids)
                    for h in seed_hashes(_along(ids)):
                        at = np.flatnonzero(held((h >> np.uint64(64 - BITMAP_BITS)).astype(np.int64)))
                        if len(at):
                            yield pa.RecordBatch.from_arrays([pa.array(h[at].view(np.int64)), pa.array([d] * len(at), type=pa.int64()), pa.array([w[i].tobytes() for i in at], type=pa.binary())], names=["h", "doc_id", "own"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), dtype=np.uint64).reshape(-1, RUN) for c in ("own", "run"))
            ok = pa.array((x == y).sum(1) >= RUN - MISREAD)
            yield pa.RecordBatch.from_arrays([b.column("doc_id").filter(ok), b.column("run").filter(ok)], names=["doc_id", "run"])

    met = corpus.mapInArrow(hits, "h long, doc_id long, own binary").distinct().join(index, "h")
    return met.select("doc_id", "own", "run").mapInArrow(verify, "doc_id long, run binary").distinct()


def leaks(docs: DataFrame, items: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, item_id of each document with a run of each passage.

    ``docs`` has doc_id and text, ``items`` item_id and passage. Null and empty texts hold nothing; passages shorter than
    a run can't leak. Whole texts are searched; other columns are ignored. More than ``block`` different runs are joined
    rather than sent out.
    """
    rows = items.filter(F.col("passage").isNotNull() & F.col("item_id").isNotNull()).select("item_id", "passage")
    of = spill(passage_runs(rows), "runs")
    runs = of.select("run").distinct()
    corpus = docs.filter(F.col("text").isNotNull()).select(F.col("doc_id").cast("long"), "text")
    few = [bytes(r.run) for r in runs.limit(block + 1).collect()]
    if len(few) > block:
        return _joined(corpus, runs).join(of, "run").select("doc_id", "item_id").distinct()
    numbered = docs.sparkSession.createDataFrame([(bytearray(r), n) for n, r in enumerate(few)], "run binary, n long")
    return _searched(corpus, few).join(of.join(numbered, "run").select("n", "item_id"), "n").select("doc_id", "item_id").distinct()
