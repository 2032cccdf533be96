"""Pairs of near cores for problem 1: keys under which cores meet, and exact comparison of those that met.

Everything here works on whole arrays of cores (or pairs) of a task; `names` deals the keys to the tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa

#: Multiplier of the hashes of strings of letters, modulo 2 to the 64.
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
#: Pairs that are looked at at once; letters (or n-grams squared) of those that are compared at once.
PAIRS_AT_ONCE, CELLS_AT_ONCE = 1 << 15, 1 << 21
#: Found pairs that are held before repeated ones are left out.
FOUND_AT_ONCE = 1 << 21
#: Cores of a greater squared length meet by single n-grams, as the pairs of their n-grams are many.
LONG = 3000.0
_PAIR, _HEAVY, _LONG = np.uint64(1), np.uint64(2), np.uint64(3)


def of_length(cores: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, letters as a matrix) of the cores of each length."""
    sizes = np.fromiter(map(len, cores), np.int64, len(cores))
    for n in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == n)
        step = max(1, CELLS_AT_ONCE // max(n * n, 1))
        for k in range(0, len(at), step):
            part = at[k : k + step]
            yield part, np.array(cores[part].tolist(), f"U{max(n, 1)}").view(np.uint32).reshape(len(part), -1)[:, :n]


def _windows(letters: np.ndarray, n: int) -> np.ndarray:
    """The n-grams (cores x n-grams x letters) of a matrix of letters, the ends marked."""
    padded = np.empty((len(letters), letters.shape[1] + 2), np.uint32)
    padded[:, 0], padded[:, 1:-1], padded[:, -1] = ord("^"), letters, ord("$")
    return np.lib.stride_tricks.sliding_window_view(padded, min(n, padded.shape[1]), axis=1)


def _codes(windows: np.ndarray) -> np.ndarray:
    """Numbers that are equal for equal n-grams."""
    code = np.full(windows.shape[:2], 1, np.uint64)
    for k in range(windows.shape[2]):
        code = code * MULTIPLIER + windows[:, :, k]
    return code ^ (code >> np.uint64(29))


def _mixed(h: np.ndarray, k: np.ndarray) -> np.ndarray:
    """A step of Murmur3 of 32 bits."""
    k = k * np.uint32(0xCC9E2D51)
    k = ((k << np.uint32(15)) | (k >> np.uint32(17))) * np.uint32(0x1B873593)
    h = h ^ k
    return ((h << np.uint32(13)) | (h >> np.uint32(19))) * np.uint32(5) + np.uint32(0xE6546B64)


def _murmur(octets: np.ndarray) -> np.ndarray:
    """What Spark's hash() says of texts of equally many bytes, given as rows of a matrix."""
    rows, n = octets.shape
    h = np.full(rows, 42, np.uint32)
    for k in range(0, n - n % 4, 4):
        h = _mixed(h, octets[:, k : k + 4].astype(np.uint32) @ np.array([1, 1 << 8, 1 << 16, 1 << 24], np.uint32))
    for k in range(n - n % 4, n):
        h = _mixed(h, octets[:, k].astype(np.int8).astype(np.int32).view(np.uint32))
    h = h ^ np.uint32(n)
    h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    return (h ^ (h >> np.uint32(16))).view(np.int32)


def buckets_of(windows: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each n-gram: pmod(hash(n-gram), buckets), as Spark reckons it."""
    flat = windows.reshape(-1, windows.shape[2])
    out = _murmur(flat.astype(np.uint8)) if len(flat) else np.empty(0, np.int32)
    for i in np.flatnonzero((flat > 127).any(axis=1)).tolist():
        out[i] = _murmur(np.frombuffer("".join(map(chr, flat[i])).encode(), np.uint8)[None])[0]
    return np.mod(out.astype(np.int64), buckets).reshape(windows.shape[:2])


def _first_of_row(values: np.ndarray) -> np.ndarray:
    """Whether each value is the first of its kind in its row."""
    order = np.argsort(values, axis=1, kind="stable")
    ordered = np.take_along_axis(values, order, 1)
    new = np.ones(values.shape, bool)
    new[:, 1:] = ordered[:, 1:] != ordered[:, :-1]
    out = np.empty_like(new)
    np.put_along_axis(out, order, new, 1)
    return out


def bucket_counts(cores: np.ndarray, n: int, buckets: int) -> np.ndarray:
    """How many of the cores have an n-gram of each bucket."""
    out = np.zeros(buckets, np.int64)
    for _, letters in of_length(cores):
        b = buckets_of(_windows(letters, n), buckets)
        out += np.bincount(b[_first_of_row(b)], minlength=buckets)
    return out


def _vectors(letters: np.ndarray, n: int, squares: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes, squared weights) of the n-grams of a matrix of letters; a repeated n-gram weighs 0."""
    windows = _windows(letters, n)
    code = _codes(windows)
    return code, np.where(_first_of_row(code), squares[buckets_of(windows, len(squares))], 0.0)


def cosine_keys(cores: np.ndarray, n: int, squares: np.ndarray, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(position of the core, key, squared length, bound, whether long) of all keys under which cores of the given cosine meet.

    n-grams are in one order, the rarest first. What two cores have in common starts with two of its n-grams and goes on
    behind them, so it is at most the square of the first and the rest from the second on (the bound); the cosine asks
    for the square of it in each. Cores may also be near by one n-gram, which then has that square alone. Where a core is
    `LONG`, single n-grams are the keys, under which cores that may be near a long one are given too.
    """
    least = cosine * cosine - 1e-9  # a hair is left for the rounding of the sums
    for at, letters in of_length(cores):
        code, square = _vectors(letters, n, squares)
        norm = square.sum(axis=1)
        order = np.lexsort((code, -square), axis=1)
        code, square = np.take_along_axis(code, order, 1), np.take_along_axis(square, order, 1)
        rest = np.cumsum(square[:, ::-1], axis=1)[:, ::-1]
        ask = least * norm[:, None]
        for kind, wanted, bound in ((_HEAVY, (norm <= LONG)[:, None] & (square >= ask), square), (_LONG, (norm > least * LONG)[:, None] & (rest >= ask), rest)):
            i, k = np.nonzero(wanted & (square > 0))
            yield at[i], (code[i, k] + kind) * MULTIPLIER, norm[i], bound[i, k], np.full(len(i), kind == _LONG)
        short = np.flatnonzero(norm <= LONG)
        for first in range(code.shape[1] - 1 if len(short) else 0):
            bound = square[short, first, None] + rest[short, first + 1 :]
            i, k = np.nonzero((square[short, first + 1 :] > 0) & (bound >= ask[short]))
            if not len(i):
                continue
            yield at[short[i]], (code[short[i], first] * MULTIPLIER ^ code[short[i], first + 1 + k] + _PAIR) * MULTIPLIER, norm[short[i]], bound[i, k], np.zeros(len(i), bool)


def deletion_keys(cores: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(position of the core, key) of each core without no, one and two of its letters, different ones once."""
    for at, letters in of_length(cores):
        rows, n = letters.shape
        power = np.concatenate([np.ones(1, np.uint64), np.full(n, MULTIPLIER)]).cumprod(dtype=np.uint64)
        before = np.ones((rows, n + 1), np.uint64)
        for k in range(n):
            before[:, k + 1] = before[:, k] * MULTIPLIER + letters[:, k]

        def then(head: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
            """The hash of what `head` is the hash of and the letters from `start` to `end`."""
            return head * power[end - start] + (before[:, end] - before[:, start] * power[end - start])

        one = np.arange(n)
        keys = [before[:, n:], then(before[:, one], one + 1, np.full(n, n))]
        if n > 1:
            i, j = np.triu_indices(n, 1)
            keys.append(then(then(before[:, i], i + 1, j), j + 1, np.full(len(i), n)))
        key = np.sort(np.concatenate(keys, axis=1), axis=1)
        new = np.ones(key.shape, bool)
        new[:, 1:] = key[:, 1:] != key[:, :-1]
        i, k = np.nonzero(new)
        yield at[i], key[i, k]


def meetings(key: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of positions of equal keys, which are in order; some at once, so few that they stay in the cache."""
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, int)
    ends = np.append(starts[1:], len(key)) if len(key) else starts
    behind = np.repeat(ends, ends - starts) - np.arange(len(key)) - 1
    total = np.concatenate([[0], np.cumsum(behind)])
    at = 0
    while at < len(key):
        to = max(at + 1, int(np.searchsorted(total, total[at] + PAIRS_AT_ONCE, "right")) - 1)
        x = np.repeat(np.arange(at, to), behind[at:to])
        y = x + 1 + np.arange(len(x)) - np.repeat(total[at:to] - total[at], behind[at:to])
        if len(x):
            yield x, y
        at = to


def _in_pieces(cores: np.ndarray, a: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(positions of pairs, letters of the first and of the second, filled up with 0 and 1) of pairs of about one length."""
    sizes = np.fromiter(map(len, cores), np.int64, len(cores))
    longer = np.maximum(sizes[a], sizes[b])
    order = np.argsort(longer, kind="stable")
    at = 0
    while at < len(order):
        width = max(8, int(longer[order[at]]) * 5 // 4)
        to = min(int(np.searchsorted(longer[order], width, "right")), at + max(1, CELLS_AT_ONCE // width))
        part = order[at:to]
        used, index = np.unique(np.concatenate([a[part], b[part]]), return_inverse=True)
        text = np.array(cores[used].tolist(), f"U{width}").view(np.uint32).reshape(len(used), width)
        yield part, text[index[: len(part)]], text[index[len(part) :]]
        at = to


def cosines(cores: np.ndarray, a: np.ndarray, b: np.ndarray, n: int, squares: np.ndarray) -> np.ndarray:
    """The cosine of each pair of cores; the vectors are worked out once a core."""
    used, index = np.unique(np.concatenate([a, b]), return_inverse=True)
    sizes = np.fromiter(map(len, cores[used]), np.int64, len(used))
    norm, row, held = np.zeros(len(used)), np.zeros(len(used), np.int64), {}
    for at, letters in of_length(cores[used]):
        code, square = _vectors(letters, n, squares)
        norm[at] = square.sum(axis=1)
        before = held.setdefault(letters.shape[1], [])
        row[at] = sum(len(c) for c, _ in before) + np.arange(len(at))
        before.append((code, square))
    held = {size: [np.concatenate(x) for x in zip(*parts)] for size, parts in held.items()}
    x, y = index[: len(a)], index[len(a) :]
    common = np.zeros(len(a))
    pairs = sizes[x] * (int(sizes.max(initial=0)) + 1) + sizes[y]
    order = np.argsort(pairs, kind="stable")
    starts = np.flatnonzero(np.diff(pairs[order], prepend=-1))
    for start, end in zip(starts.tolist(), np.append(starts[1:], len(order)).tolist()):
        (codes, weights), (others, _) = (held[int(sizes[s[order[start]]])] for s in (x, y))
        cells = codes.shape[1] * others.shape[1]
        step = max(1, CELLS_AT_ONCE // cells)
        for k in range(start, end, step):
            part = order[k : min(k + step, end)]
            c, w, d = codes[row[x[part]]], weights[row[x[part]]], others[row[y[part]]]
            if cells > CELLS_AT_ONCE:
                common[part] = w[0][np.isin(c[0], d[0])].sum()
            else:
                has = np.zeros(c.shape, bool)
                for g in range(d.shape[1]):
                    has |= c == d[:, g, None]
                common[part] = (w * has).sum(axis=1)
    return common / np.sqrt(norm[x] * norm[y])


def edits_of(cores: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Edits between pairs of cores whose sizes differ by two at most: 1 for a single swap of neighbours, 4 only for the same letters in another order, 9 beyond."""
    sizes = np.fromiter(map(len, cores), np.int64, len(cores))
    swap = sizes[a] > sizes[b]
    a, b = np.where(swap, b, a), np.where(swap, a, b)
    out = np.full(len(a), 9, np.uint8)
    for part, p, q in _in_pieces(cores, a, b):
        n, more = sizes[a[part]], sizes[b[part]] - sizes[a[part]]
        wide = np.zeros((len(part), p.shape[1] + 4), np.uint32)
        wide[:, 2:-2] = q
        wide, first = np.ascontiguousarray(wide.T), np.ascontiguousarray(p.T)
        # cells within two places of the diagonal: three edits, or four of equally many letters, never leave them
        row = [np.full(len(part), d if d >= 0 else 9, np.uint8) for d in range(-2, 3)]
        edits = np.full(len(part), 9, np.uint8)
        for i in range(0, int(n.max(initial=0)) + 1):
            if i:
                now = []
                for d in range(-2, 3):
                    if i + d < 0:
                        now.append(np.full(len(part), 9, np.uint8))
                    elif i + d == 0:
                        now.append(np.full(len(part), i, np.uint8))
                    else:
                        cell = row[d + 2] + (first[i - 1] != wide[i + d + 1])
                        if d < 2:
                            cell = np.minimum(cell, row[d + 3] + np.uint8(1))
                        if d > -2:
                            cell = np.minimum(cell, now[-1] + np.uint8(1))
                        now.append(np.minimum(cell, np.uint8(9)))
                row = now
            for e in range(3):
                here = (n == i) & (more == e)
                edits[here] = row[e + 2][here]
        alike = np.flatnonzero((more == 0) & ((edits == 4) | (edits == 2)))
        alike = alike[(np.sort(p[alike], axis=1) == np.sort(q[alike], axis=1)).all(axis=1)]
        same = np.zeros(len(part), bool)
        same[alike] = True
        differ = p[alike] != q[alike]
        at = differ.argmax(axis=1)
        swapped = alike[(differ.sum(axis=1) == 2) & differ[np.arange(len(alike)), np.minimum(at + 1, p.shape[1] - 1)]]
        edits[swapped] = 1  # two neighbours that differ, of the same letters
        edits[(edits > 4) | ((edits == 4) & ~same)] = 9
        out[part] = edits
    return out


def packed(t: pa.Table, parts: int) -> pa.RecordBatch:
    """part, rows: the rows of each part of their keys, as one value a part: rows by themselves cost more than what is done with them."""
    part = np.mod(t.column("key").to_numpy(), parts)
    order = np.argsort(part, kind="stable")
    ordered = t.take(pa.array(order)).combine_chunks()
    used, starts = np.unique(part[order], return_index=True)
    values = []
    for start, end in zip(starts, np.append(starts[1:], len(order))):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, t.schema) as w:
            for b in ordered.slice(start, end - start).to_batches():
                w.write_batch(b)
        values.append(sink.getvalue().to_pybytes())
    return pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(values, pa.binary())], ["part", "rows"])


def unpacked(frames: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each part of a task, by key."""
    parts: dict[int, list[pa.Table]] = {}
    for f in frames:
        for part, rows in zip(f.column("part").to_pylist(), f.column("rows")):
            parts.setdefault(part, []).append(pa.ipc.open_stream(rows.as_buffer()).read_all())
    while parts:
        t = pa.concat_tables(parts.popitem()[1])
        yield t.take(pa.array(np.argsort(t.column("key").to_numpy(), kind="stable"))).combine_chunks()


def coded(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(number of each value, the different values)."""
    d = column.combine_chunks()
    d = (d.chunk(0) if isinstance(d, pa.ChunkedArray) else d).dictionary_encode()
    return d.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.array(d.dictionary.to_pylist(), object)


def different(found: Iterable[tuple[np.ndarray, np.ndarray]], n: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of numbers below n of all arrays, each once, the smaller number first."""
    pairs, held, rows = np.empty(0, np.int64), [], 0
    for x, y in found:
        held.append(np.minimum(x, y) * n + np.maximum(x, y))
        rows += len(x)
        if rows > FOUND_AT_ONCE:
            pairs, held, rows = np.unique(np.concatenate([pairs, *held])), [], 0
    pairs = np.unique(np.concatenate([pairs, *held]))
    return pairs // max(n, 1), pairs % max(n, 1)


def ordered(cores: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[list[str], list[str]]:
    """The cores of pairs, the smaller first as Spark compares texts."""
    pairs = [(x, y) if x.encode() < y.encode() else (y, x) for x, y in zip(cores[a], cores[b])]
    return [p[0] for p in pairs], [p[1] for p in pairs]


def _narrow(key: np.ndarray) -> pa.Array:
    """Keys as they are dealt, in 32 bits: those that meet by chance are told apart by the comparison."""
    return pa.array((key ^ (key >> np.uint64(32))).astype(np.uint32).view(np.int32))


def counter(sizes: dict[int, int]) -> Callable:
    """Of cores: n, bucket, cores that have an n-gram of it; bucket -1 is all cores."""

    def count(frames: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {n: np.zeros(k, np.int64) for n, k in sizes.items()}
        rows = 0
        for f in frames:
            cores = np.array(f.column("core").to_pylist(), object)
            rows += len(cores)
            for n, k in sizes.items():
                total[n] += bucket_counts(cores, n, k)
        for n, t in total.items():
            g = np.flatnonzero(t)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(g) + 1, n, np.int32)), pa.array(np.append(g, -1).astype(np.int32)), pa.array(np.append(t[g], rows))], ["n", "g", "k"])

    return count


def cosine_indexer(n: int, squares: np.ndarray, cosine: float, parts: int) -> Callable:
    def index(frames: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for f in frames:
            cores = f.column("core")
            found = [
                pa.table([_narrow(key), cores.take(pa.array(at)), pa.array(norm.astype(np.float32)), pa.array(bound.astype(np.float32)), pa.array(long)], ["key", "core", "norm", "bound", "long"])
                for at, key, norm, bound, long in cosine_keys(np.array(cores.to_pylist(), object), n, squares, cosine)
            ]
            if found:
                yield packed(pa.concat_tables(found), parts)

    return index


def cosine_matcher(n: int, squares: np.ndarray, cosine: float) -> Callable:
    least, longer = np.float32(cosine - 1e-5), LONG * (1 - 1e-5)  # norms and bounds are short numbers

    def met(t: pa.Table, core: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        norm, bound, single = (t.column(c).to_numpy() for c in ("norm", "bound", "long"))
        root = np.sqrt(norm)
        for x, y in meetings(t.column("key").to_numpy()):
            ok = np.minimum(bound[x], bound[y]) >= least * root[x] * root[y]
            x, y = x[ok], y[ok]
            # two cores that aren't long meet by pairs
            ok = (core[x] != core[y]) & (~single[x] | (norm[x] > longer) | (norm[y] > longer))
            yield core[x[ok]], core[y[ok]]

    def match(frames: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in unpacked(frames):
            core, names = coded(t.column("core"))
            a, b = different(met(t, core), len(names))
            value = cosines(names, a, b, n, squares)
            ok = value >= cosine
            c1, c2 = ordered(names, a[ok], b[ok])
            yield pa.RecordBatch.from_arrays([pa.array(c1, pa.string()), pa.array(c2, pa.string()), pa.array(value[ok])], ["c1", "c2", "cosine"])

    return match


def deletion_indexer(parts: int) -> Callable:
    def index(frames: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for f in frames:
            cores = f.column("core")
            found = [pa.table([_narrow(key), cores.take(pa.array(at))], ["key", "core"]) for at, key in deletion_keys(np.array(cores.to_pylist(), object))]
            if found:
                yield packed(pa.concat_tables(found), parts)

    return index


def deletion_matcher(frames: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in unpacked(frames):
        core, names = coded(t.column("core"))
        sizes = np.fromiter(map(len, names), np.int64, len(names))

        def met(t: pa.Table = t, core: np.ndarray = core, size: np.ndarray = sizes[core]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for x, y in meetings(t.column("key").to_numpy()):
                ok = (core[x] != core[y]) & (np.abs(size[x] - size[y]) <= 2)
                yield core[x[ok]], core[y[ok]]

        a, b = different(met(), len(names))
        edits = edits_of(names, a, b)
        ok = edits < 9
        c1, c2 = ordered(names, a[ok], b[ok])
        yield pa.RecordBatch.from_arrays([pa.array(c1, pa.string()), pa.array(c2, pa.string()), pa.array(edits[ok].astype(np.int32))], ["c1", "c2", "edits"])


def edits_adder(frames: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """c1, c2 with the edits between them, where they are near."""
    for f in frames:
        code, names = coded(pa.chunked_array([f.column("c1"), f.column("c2")]))
        edits = edits_of(names, code[: f.num_rows], code[f.num_rows :])
        ok = pa.array(edits < 9)
        yield pa.RecordBatch.from_arrays([f.column("c1").filter(ok), f.column("c2").filter(ok), pa.array(edits.astype(np.int32)).filter(ok)], ["c1", "c2", "edits"])


def cosine_adder(n: int, squares: np.ndarray) -> Callable:
    """c1, c2, edits with the cosine of the two."""

    def add(frames: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for f in frames:
            code, names = coded(pa.chunked_array([f.column("c1"), f.column("c2")]))
            value = cosines(names, code[: f.num_rows], code[f.num_rows :], n, squares)
            yield pa.RecordBatch.from_arrays([f.column("c1"), f.column("c2"), f.column("edits"), pa.array(value)], ["c1", "c2", "edits", "cosine"])

    return add
