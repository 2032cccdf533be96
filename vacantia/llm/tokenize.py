"""Problem 8: encoding a whole corpus with a public byte-level BPE vocabulary.

Texts are cut into pieces by the vocabulary's pattern; each distinct piece is encoded once per task
and its ids are gathered into the documents' lists as Arrow arrays. Pieces are encoded together:

* they are bucketed by length and padded into matrices of token ids, one row a piece;
* in every round each row merges its leftmost pair of minimum rank: the ranks of all neighbouring
  pairs come from one hashed lookup (open addressing over 64-bit keys), the row closes up by one;
* rows without a pair left are finished and leave the matrix.

Pieces of more than `LONGEST_ROW` bytes, for which rows would be quadratic, merge in the same order
over a heap and linked neighbours. The vocabulary is read on the driver and sent once to each executor.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pattern that cuts text into pieces before merging.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Longest piece, in bytes, that becomes a row of a matrix.
LONGEST_ROW = 128
#: Characters of text that are cut and gathered at once.
SLICE_CHARS = 2_000_000
#: Distinct pieces that a task keeps; beyond it the store starts anew.
KEPT_PIECES = 400_000
NO_RANK = np.int32(2**31 - 1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class PairTable:
    """Open-addressing hash table from pairs of token ids to the id, which is the rank, of their union."""

    def __init__(self, ranks: dict[bytes, int]):
        left, right, made = [], [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    made.append(rank)
        keys = (np.array(left, np.uint64) << np.uint64(32)) | np.array(right, np.uint64)
        values = np.array(made, np.int32)
        bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 3))))
        self.shift, self.mask = np.uint64(64 - bits), np.uint64((1 << bits) - 1)
        self.keys = np.full(1 << bits, np.uint64(2**64 - 1))
        self.values = np.full(1 << bits, NO_RANK, np.int32)
        slot, todo = self._home(keys), np.arange(len(keys))
        while len(todo):  # of the keys that want a free slot the last written gets it, the others go on
            free = self.keys[slot[todo]] == np.uint64(2**64 - 1)
            self.keys[slot[todo[free]]] = keys[todo[free]]
            won = self.keys[slot[todo]] == keys[todo]
            self.values[slot[todo[won]]] = values[todo[won]]
            todo = todo[~won]
            slot[todo] = (slot[todo] + 1) & int(self.mask)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _MIX) >> self.shift).astype(np.int64)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair, NO_RANK where the pair doesn't merge."""
        keys = (a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64)
        slot = self._home(keys)
        held = self.keys[slot]
        out = np.where(held == keys, self.values[slot], NO_RANK)
        open_ = np.flatnonzero((held != keys) & (held != np.uint64(2**64 - 1)))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & int(self.mask)
            held, want = self.keys[slot[open_]], keys[open_]
            hit = held == want
            out[open_[hit]] = self.values[slot[open_[hit]]]
            open_ = open_[~hit & (held != np.uint64(2**64 - 1))]
        return out

    def rank(self, a: int, b: int) -> int:
        return int(self.ranks(np.array([a]), np.array([b]))[0])


def merge_rows(rows: np.ndarray, lengths: np.ndarray, pairs: PairTable) -> list[np.ndarray]:
    """The ids of each row: `rows` holds byte ids, padded with -1 beyond `lengths`."""
    out: list[np.ndarray] = [np.empty(0, np.int32)] * len(rows)
    at, length = np.arange(len(rows)), lengths.copy()
    width = rows.shape[1]
    ranks = np.full((len(rows), max(1, width - 1)), NO_RANK, np.int32)
    if width > 1:
        inside = np.arange(width - 1)[None, :] < (length - 1)[:, None]
        ranks[inside] = pairs.ranks(rows[:, :-1][inside], rows[:, 1:][inside])
    while len(at):
        pos = ranks.argmin(axis=1)  # the first of the smallest
        line = np.arange(len(at))
        best = ranks[line, pos]
        done = best == NO_RANK
        if done.any():
            for i in np.flatnonzero(done):
                out[at[i]] = rows[i, : length[i]].copy()
            keep = ~done
            rows, ranks, at, length, pos, best = rows[keep], ranks[keep], at[keep], length[keep], pos[keep], best[keep]
            if not len(at):
                break
            line = np.arange(len(at))
        rows[line, pos] = best
        col = np.arange(rows.shape[1])[None, :]
        rows = np.take_along_axis(rows, np.minimum(col + (col > pos[:, None]), rows.shape[1] - 1), axis=1)
        length = length - 1
        c = col[:, : ranks.shape[1]]
        ranks = np.take_along_axis(ranks, np.minimum(c + (c > pos[:, None]), ranks.shape[1] - 1), axis=1)
        ranks[c >= (length - 1)[:, None]] = NO_RANK
        for near in (pos - 1, pos):  # only the pairs beside the merge have new ranks
            ok = np.flatnonzero((near >= 0) & (near < length - 1))
            ranks[ok, near[ok]] = pairs.ranks(rows[ok, near[ok]], rows[ok, near[ok] + 1])
        widest = int(length.max())
        if widest < rows.shape[1]:
            rows, ranks = rows[:, :widest], ranks[:, : max(1, widest - 1)]
    return out


def merge_long(ids: np.ndarray, pairs: PairTable) -> np.ndarray:
    """The ids of one long piece by the same order of merges, over a heap."""
    token = ids.tolist()
    n = len(token)
    after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    first = pairs.ranks(ids[:-1], ids[1:])
    heap = [(int(r), i) for i, r in enumerate(first) if r != NO_RANK]
    heapq.heapify(heap)
    known: dict[tuple[int, int], int] = {}

    def rank(i: int) -> int:
        j = after[i]
        if j >= n:
            return int(NO_RANK)
        key = (token[i], token[j])
        if key not in known:
            known[key] = pairs.rank(*key)
        return known[key]

    while heap:
        r, i = heapq.heappop(heap)
        if not alive[i] or rank(i) != r:
            continue
        j = after[i]
        token[i], alive[j], after[i] = r, False, after[j]
        if after[j] < n:
            before[after[j]] = i
        for k in (before[i], i):
            if k >= 0 and (x := rank(k)) != NO_RANK:
                heapq.heappush(heap, (x, k))
    return np.array([t for t, a in zip(token, alive) if a], np.int32)


class Encoder:
    """Pieces to ids; made once a task from what the driver sends."""

    def __init__(self, ranks: dict[bytes, int], pairs: PairTable):
        self.ranks, self.pairs = ranks, pairs
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.cut = regex.compile(PIECES).findall
        self._reset()

    def _reset(self) -> None:
        self.codes: dict[str, int] = _Codes()
        self.starts, self.lengths, self.flat = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32)

    def encode_pieces(self, pieces: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray | None] = [None] * len(pieces)
        buckets: dict[int, list[tuple[int, bytes]]] = {}
        for i, p in enumerate(pieces):
            b = p.encode("utf-8", "replace")
            whole = self.ranks.get(b)
            if whole is not None:
                out[i] = np.array([whole], np.int32)
            elif len(b) > LONGEST_ROW:
                out[i] = merge_long(self.byte_ids[np.frombuffer(b, np.uint8)], self.pairs)
            else:
                buckets.setdefault(-(-len(b) // 8), []).append((i, b))
        for size, held in buckets.items():
            for lo in range(0, len(held), 20_000):
                part = held[lo : lo + 20_000]
                lengths = np.array([len(b) for _, b in part])
                rows = np.frombuffer(b"".join(b.ljust(size * 8, b"\0") for _, b in part), np.uint8).reshape(len(part), size * 8)
                rows = np.where(np.arange(size * 8)[None, :] < lengths[:, None], self.byte_ids[rows], -1)
                for (i, _), ids in zip(part, merge_rows(rows, lengths, self.pairs)):
                    out[i] = ids
        return out

    def _learn(self) -> None:
        known = len(self.lengths)
        if len(self.codes) > known:
            made = self.encode_pieces(list(self.codes)[known:])
            lengths = np.array([len(m) for m in made], np.int64)
            self.starts = np.concatenate([self.starts, len(self.flat) + np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)])
            self.lengths = np.concatenate([self.lengths, lengths])
            self.flat = np.concatenate([self.flat, *made])

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, number of ids of each text)."""
        if len(self.codes) > KEPT_PIECES:
            self._reset()
        code, counts = [], np.zeros(len(texts), np.int64)
        look = self.codes.__getitem__
        for i, t in enumerate(texts):
            if t:
                mine = list(map(look, self.cut(t)))
                counts[i] = len(mine)
                code += mine
        self._learn()
        if not code:
            return np.empty(0, np.int32), counts
        codes = np.array(code, np.int64)
        lengths = self.lengths[codes]
        ends = np.cumsum(lengths)
        ids = self.flat[np.arange(ends[-1]) + np.repeat(self.starts[codes] - (ends - lengths), lengths)]
        piece_ends = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
        return ids, np.diff(piece_ends)


class _Codes(dict):
    """Numbers pieces in the order in which they are first looked up."""

    def __missing__(self, piece: str) -> int:
        self[piece] = n = len(self)
        return n


def _slices(texts: list[str | None]) -> Iterator[list[str | None]]:
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t or "")
        if size >= SLICE_CHARS:
            yield held
            held, size = [], 0
    if held:
        yield held


def shared_vocabulary(spark: SparkSession, path: str = DEFAULT_VOCABULARY):
    """The ranks and the pair table as a broadcast; a vocabulary file is bounded (50,000 entries: 15 MB)."""
    ranks = read_ranks(path)
    return spark.sparkContext.broadcast((ranks, PairTable(ranks)))


def encode_documents(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = DEFAULT_VOCABULARY, counts_only: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, ids (array of int) of every row; with `counts_only` doc_id, n_tokens instead; then the columns `keep`.

    NULL and empty texts give an empty list (0), blank texts the ids of their blanks. Texts of any
    length are encoded whole; repeated rows are kept; other columns are ignored; no rows, no rows.
    Special tokens have no standing: their strings are ordinary text.
    """
    shared = shared_vocabulary(documents.sparkSession, vocabulary)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(*shared.value)
        for batch in batches:
            at = 0
            for texts in _slices(batch.column(1).to_pylist()):
                ids, lengths = encoder.encode(texts)
                doc, *kept = (batch.column(i).slice(at, len(texts)) for i in (0, *range(2, batch.num_columns)))
                at += len(texts)
                if counts_only:
                    yield pa.RecordBatch.from_arrays([doc, pa.array(lengths, pa.int64()), *kept], names=["doc_id", "n_tokens", *keep])
                else:
                    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([doc, pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids, pa.int32())), *kept], names=["doc_id", "ids", *keep])

    rows = documents.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"), *[F.col(c) for c in keep])
    made = StructType([StructField("doc_id", LongType()), StructField("n_tokens", LongType()) if counts_only else StructField("ids", ArrayType(IntegerType())), *[rows.schema[c] for c in keep]])
    return rows.mapInArrow(run, made)
