"""Problem 2: near-duplicate records with small edits.

A record's words are the runs of letters and digits of its texts in lower case, its shingles the
distinct triples of consecutive words. A pair counts when both share at least `THRESHOLD` of the
shingles either has.

1. Equal word sequences are one text, so a text that is on a third of all rows costs as much as any other.
2. One Arrow pass over the distinct texts makes each one's sketch: `BANDS` x `ROWS` minimum hashes over its
   whole set of shingles, from them a fingerprint of one bit each, and one hash per band. Sketches are written
   once, bucketed by text, so the joins of steps 4 and 5 move pairs, never sketches, and dropped when the pairs are known.
3. Texts that agree on a band are candidates: one equi-join on the band's hash. This is the index of the method;
   distances to pivots order no space of this kind, as unrelated texts all lie near the same distance from every pivot.
4. `PIVOTS` reference fingerprints are drawn from a sample of `SAMPLE` texts, the ones that share bands with most
   texts that are no duplicates of theirs. Each text gets its Hamming distances to all of them once
   (the pivot table). By the triangle inequality the largest difference of two rows of the table is at most the
   distance of the texts, so pairs with a coordinate further apart than `FAR` are discarded, then pairs
   whose distance itself is. `FAR` is five standard deviations above the mean at the threshold.
5. The survivors are verified on the shingles themselves, in integers.
6. Pairs of texts expand into pairs of records of different keys. Records are grouped by text and key
   first, so the sightings of one key never pair with each other. Texts with more than `HOT` keys are salted by key.

The chance that a pair just at the threshold shares no band is 0.13 per cent (0.8704 ** 48), at a
similarity of 0.7 it is 0.0002 per cent; all later steps lose less than one in a million.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia.session import cut, ensure_checkpoint_dir

#: Shared share of shingles from which a pair counts, as numerator and denominator.
THRESHOLD = (6, 10)
WORDS = 3
BANDS, ROWS = 48, 4
PIVOTS, SAMPLE, MATES = 32, 4096, 256
#: Keys of one text from which it is salted, at least; never more than `HOT_TEXTS` texts are.
HOT, HOT_TEXTS, SALT = 5_000, 100_000, 32
#: Most bits in which fingerprints of a pair at the threshold differ: mean 38.4, deviation 5.5.
FAR = 66
#: Distinct words and texts whose hashes a task keeps.
KEPT_WORDS, KEPT_TEXTS = 500_000, 1_000_000
#: Characters whose shingles are at work at once.
SLICE_CHARS = 4_000_000

_FP = BANDS * ROWS // 64
_SKETCH = "t bigint, h1 bigint, h2 bigint, n int, " + "".join(f"f{i} bigint, " for i in range(_FP)) + "bands array<bigint>, shingles array<int>"
_rng = np.random.default_rng(7)
_XOR = _rng.integers(0, 2**32, BANDS * ROWS, dtype=np.uint32)
_MUL = _rng.integers(0, 2**31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser over an array."""
    x = x.astype(np.uint64)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class _Words(dict):
    def __missing__(self, word: str) -> int:
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def shingle_sets(texts: list[str], known: _Words) -> tuple[np.ndarray, np.ndarray]:
    """(distinct 32-bit shingle hashes of all texts in a row, sorted within each; number per text)."""
    split = [t.split() for t in texts]
    counts = np.array([len(w) for w in split])
    if len(known) > KEPT_WORDS:
        known.clear()
    w = np.array([known[x] for ws in split for x in ws], np.uint64)
    if len(w) < WORDS:
        return np.empty(0, np.uint32), np.zeros(len(texts), np.int64)
    owner = np.repeat(np.arange(len(texts)), counts)
    h = w[: len(w) - WORDS + 1].copy()
    for k in range(1, WORDS):
        h = mix(h) + w[k : len(w) - WORDS + 1 + k]
    inside = owner[: len(h)] == owner[WORDS - 1 :]
    both = (owner[: len(h)][inside].astype(np.uint64) << np.uint64(32)) | (mix(h[inside]) & np.uint64(0xFFFFFFFF))
    both = np.unique(both)
    return (both & np.uint64(0xFFFFFFFF)).astype(np.uint32), np.bincount((both >> np.uint64(32)).astype(np.int64), minlength=len(texts))


def sketches(shingles: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Minimum hashes, one row per text with shingles."""
    starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
    out = np.empty((len(counts), BANDS * ROWS), np.uint32)
    for i in range(BANDS * ROWS):
        v = (shingles ^ _XOR[i]) * _MUL[i]
        out[:, i] = np.minimum.reduceat(v ^ (v >> np.uint32(15)), starts)
    return out


def fingerprints(minima: np.ndarray) -> np.ndarray:
    """One bit of each minimum hash, packed into 64-bit words."""
    bits = (mix(minima) >> np.uint64(40)) & np.uint64(1)
    n = minima.shape[1] // 64
    weights = np.uint64(1) << np.arange(64, dtype=np.uint64)
    return (bits.reshape(len(minima), n, 64) * weights).sum(axis=2, dtype=np.uint64).view(np.int64)


def band_hashes(minima: np.ndarray) -> np.ndarray:
    """One hash of 42 bits a band, below the band's number."""
    m = minima.reshape(len(minima), BANDS, ROWS).astype(np.uint64)
    band = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), m.shape[:2])
    h = band + np.uint64(1)
    for r in range(ROWS):
        h = mix(h * np.uint64(0x100000001B3) + m[:, :, r])
    return ((h >> np.uint64(22)) | (band << np.uint64(42))).view(np.int64)


def references(fps: np.ndarray, bands: np.ndarray, most: int = PIVOTS, far: int = FAR) -> np.ndarray:
    """At most `most` fingerprints of the sample that discard most: those that share bands with most texts they are far from, far from one another.

    Of a band that very many share, the first `MATES` are looked at.
    """
    apart = lambda x, y: np.bitwise_count(x.view(np.uint64)[:, None, :] ^ y.view(np.uint64)[None]).sum(axis=2)
    false = np.zeros(len(fps), np.int64)
    order = np.argsort(bands, axis=None, kind="stable")
    values, owner = bands.ravel()[order], order // bands.shape[1]
    starts = np.flatnonzero(np.diff(values, prepend=values[:1] - 1))
    for lo, hi in zip(starts, [*starts[1:], len(values)]):
        if hi - lo > 1:
            held = owner[lo:hi][:MATES]
            np.add.at(false, held, (apart(fps[held], fps[held]) > far).sum(axis=1))
    out: list[int] = []
    for i in np.argsort(-false, kind="stable"):
        if len(out) == most or (not false[i] and out):
            break
        if not out or apart(fps[[i]], fps[out]).min() > far // 2:
            out.append(int(i))
    return fps[out]


def _list(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(values.ravel(), kind))


def word_sequences(columns: list[pa.Array]) -> pa.Array:
    """The words of the texts in order, in lower case, with a blank between two."""
    parts = [pc.fill_null(pc.cast(c, pa.large_string()), "") for c in columns]
    joined = pc.binary_join_element_wise(*parts, pa.scalar(" ", pa.large_string()))
    return pc.utf8_trim_whitespace(pc.replace_substring_regex(pc.utf8_lower(joined), r"[^\pL\pN]+", " "))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _hashed(with_words: bool, texts: int):
    """Batches of (id, key, texts...) to the 128-bit hash of their words, and the words once a task or the id and key."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            words = word_sequences(batch.columns[2 : 2 + texts])
            enough = pc.greater_equal(pc.count_substring(words, " "), WORDS - 1)
            words, ids, keys = (x.filter(enough) for x in (words, batch.column(0), batch.column(1)))
            digests = [xxhash.xxh3_128_intdigest(w) for w in words.to_pylist()]
            h1, h2 = ([_signed(x) for x in hs] for hs in ([d >> 64 for d in digests], [d & (2**64 - 1) for d in digests]))
            if not with_words:
                yield pa.RecordBatch.from_arrays([ids, keys, pa.array(h1, pa.int64()), pa.array(h2, pa.int64())], names=["id", "key", "h1", "h2"])
                continue
            if len(seen) > KEPT_TEXTS:
                seen.clear()
            new = [d not in seen and not seen.add(d) for d in digests]
            mask = pa.array(new, pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(h1, pa.int64()).filter(mask), pa.array(h2, pa.int64()).filter(mask), pc.cast(words.filter(mask), pa.string())], names=["h1", "h2", "words"])

    return run


def _sketch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of (h1, h2, words), all rows of one h1 in one task, to one sketch per text."""
    known, texts_of = _Words(), {}
    for batch in batches:
        rows = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()))
        new = []
        for h1, h2, words in rows:
            held = texts_of.setdefault(h1, [])
            if h2 not in held:  # two texts of one h1 are as good as impossible; the later one is named by both halves
                new.append((h1 if not held else _signed(int(mix(np.array([(h1 ^ h2) & (2**64 - 1)], np.uint64))[0])), h1, h2, words))
                held.append(h2)
        lo = 0
        while lo < len(new):
            hi, size = lo, 0
            while hi < len(new) and size < SLICE_CHARS:
                size += len(new[hi][3])
                hi += 1
            part = new[lo:hi]
            lo = hi
            shingles, counts = shingle_sets([w for *_, w in part], known)
            minima = sketches(shingles, counts)
            fp, bands = fingerprints(minima), band_hashes(minima)
            yield pa.RecordBatch.from_arrays(
                [*(pa.array([p[i] for p in part], pa.int64()) for i in range(3)), pa.array(counts, pa.int32()), *(pa.array(c, pa.int64()) for c in fp.T),
                 _list(bands, np.full(len(part), BANDS), pa.int64()), _list(shingles.view(np.int32), counts, pa.int32())],
                names=[c.split()[0] for c in _SKETCH.split(", ")],
            )


@contextmanager
def written_sketches(texts: DataFrame) -> Iterator[DataFrame]:
    """The sketches of (h1, h2, words) as a table in the shared checkpoint folder, bucketed by text, dropped in the end."""
    spark = texts.sparkSession
    name, parts = f"bucketed_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = f"{ensure_checkpoint_dir(spark)}/{name}"
    try:
        made = texts.repartition(parts, "h1").mapInArrow(_sketch, _SKETCH)
        made.write.format("parquet").bucketBy(parts, "t").option("compression", "zstd").option("path", path).saveAsTable(name)
        yield spark.table(name)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def _distance(i: str, j: str) -> Column:
    words = [F.bit_count(F.col(f"f{k}{i}").bitwiseXOR(F.col(f"f{k}{j}"))) for k in range(_FP)]
    return sum(words[1:], words[0])


def _row_of_pivots(pivots: np.ndarray) -> Column:
    """A text's row of the pivot table: its distance to each reference, in a byte (at most 192, kept less 128)."""
    far = [sum((F.bit_count(F.col(f"f{k}").bitwiseXOR(F.lit(int(p[k])))) for k in range(1, _FP)), F.bit_count(F.col("f0").bitwiseXOR(F.lit(int(p[0]))))) for p in pivots]
    return F.array(*[(d - 128).cast("byte") for d in far])


def similar_texts(s: DataFrame, far: int = FAR, counts: dict[str, int] | None = None) -> DataFrame:
    """t1, t2 (t1 < t2) of all pairs of sketched texts at the threshold or above.

    `counts`, if given, gets the numbers of candidates, of those that the pivot table and then the distance discard.
    """
    p, q = THRESHOLD
    # t is a hash: texts below a bound are a sample of about SAMPLE texts, 2 MB
    bound = -(1 << 63) + ((1 << 64) * SAMPLE) // max(SAMPLE + 1, s.count())
    sample = sorted(s.select("t", *[f"f{i}" for i in range(_FP)], "bands").filter(F.col("t") < bound).collect())
    pivots = references(np.array([r[1 : 1 + _FP] for r in sample], np.int64), np.array([r["bands"] for r in sample], np.int64)) if sample else np.empty((0, _FP))
    bands = s.select("t", "n", F.explode("bands").alias("band"))
    x, y = bands.alias("x"), bands.alias("y")
    sized = (F.col("x.n") * q >= F.col("y.n") * p) & (F.col("y.n") * q >= F.col("x.n") * p)
    pairs = x.join(y, (F.col("x.band") == F.col("y.band")) & (F.col("x.t") < F.col("y.t")) & sized).select(F.col("x.t").alias("t1"), F.col("y.t").alias("t2")).distinct()
    table = s.select("t", "n", *[f"f{i}" for i in range(_FP)], _row_of_pivots(pivots).alias("row") if len(pivots) else F.array().cast("array<tinyint>").alias("row"))
    a, b = (table.select(*[F.col(c).alias(f"{c}{i}") for c in table.columns]) for i in (1, 2))
    apart = F.exists(F.zip_with("row1", "row2", lambda i, j: F.abs(i.cast("int") - j.cast("int"))), lambda d: d > far)
    met = pairs.join(a, "t1").join(b, "t2")
    if counts is not None:
        met = cut(met)
        counts |= {"candidates": met.count(), "pivots": met.filter(apart).count(), "distance": met.filter(~apart & (_distance("1", "2") > far)).count()}
    near = met.filter(~apart).filter(_distance("1", "2") <= far).select("t1", "t2", "n1", "n2")
    s1, s2 = (s.select(F.col("t").alias(f"t{i}"), F.col("shingles").alias(f"s{i}")) for i in (1, 2))
    both = F.size(F.array_intersect("s1", "s2"))
    return near.join(s1, "t1").join(s2, "t2").filter(both * q >= (F.col("n1") + F.col("n2") - both) * p).select("t1", "t2")


def near_duplicate_pairs(rows: DataFrame, id_col: str, text_cols: list[str], body_col: str, key_cols: list[str]) -> DataFrame:
    """observation_id_a, observation_id_b (a < b) of all pairs of records at the threshold or above.

    Records with a NULL or blank body are left out; other NULL texts count as empty. Records that
    carry the same key (all of `key_cols` equal and none NULL) are no pair. Identifiers are unique;
    repeated rows of one identifier make no pair with themselves. Texts of fewer than three words
    have no shingles and no pairs; texts of any length count whole; other columns are ignored; an
    empty table gives no rows.
    """
    whole = F.lit(True)
    for k in key_cols:
        whole &= F.col(k).isNotNull()
    identifier = F.col(id_col).cast("bigint")
    # a record without a whole key is a key of its own
    parts = [p for k in key_cols for p in (F.length(F.col(k).cast("string")).cast("string"), F.lit(":"), F.col(k).cast("string"))]
    key = F.when(whole, F.concat(*parts)).otherwise(F.concat(F.lit("#"), identifier.cast("string")))
    some = rows.filter(F.col(body_col).rlike(r"[^\s\p{Z}\x{feff}]"))
    read = some.select(identifier.alias("id"), key.alias("key"), *[F.col(c).cast("string").alias(f"text{i}") for i, c in enumerate(text_cols)])
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    with written_sketches(read.mapInArrow(_hashed(True, len(text_cols)), "h1 bigint, h2 bigint, words string")) as s:
        hashed = read.mapInArrow(_hashed(False, len(text_cols)), "id bigint, key string, h1 bigint, h2 bigint")
        member = cut(hashed.join(s.select("t", "h1", "h2"), ["h1", "h2"]).select("id", "t", "key").repartition(parts, "t", "key"))
        similar = cut(similar_texts(s))
    groups = member.select("t", "key").distinct()
    twice = cut(groups.groupBy("t").agg(F.count("*").alias("k")).filter("k > 1"))
    across = similar.unionByName(twice.select(F.col("t").alias("t1"), F.col("t").alias("t2")))
    return _expanded(across, groups, member, twice)


def _expanded(across: DataFrame, groups: DataFrame, member: DataFrame, twice: DataFrame) -> DataFrame:
    """The pairs of records of the pairs of texts `across`; a text with very many keys is dealt by key."""
    keys = twice.agg(F.sum("k")).first()[0] or 0
    # at most one in `HOT` (or HOT_TEXTS in all) of the texts are such
    hot = twice.filter(F.col("k") > max(HOT, keys // HOT_TEXTS)).select("t", F.lit(SALT).cast("bigint").alias("_salts"))

    def salts(df: DataFrame, t: str) -> DataFrame:
        return df.join(F.broadcast(hot.withColumnRenamed("t", t)), t, "left").withColumn("_salts", F.coalesce("_salts", F.lit(1).cast("bigint")))

    every, own = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_salts") - 1)), F.pmod(F.xxhash64("key1"), F.col("_salts"))
    g1, g2 = (groups.select(F.col("t").alias(f"t{i}"), F.col("key").alias(f"key{i}")) for i in (1, 2))
    first = salts(across, "t1").withColumn("_salt", every).drop("_salts").join(salts(g1, "t1").withColumn("_salt", own).drop("_salts"), ["t1", "_salt"]).drop("_salt")
    linked = salts(first, "t2").withColumn("_salt", own).drop("_salts").join(salts(g2, "t2").withColumn("_salt", every).drop("_salts"), ["t2", "_salt"]).drop("_salt")
    linked = linked.filter((F.col("key1") != F.col("key2")) & ((F.col("t1") != F.col("t2")) | (F.col("key1") < F.col("key2"))))
    a, b = (member.select(F.col("t").alias(f"t{i}"), F.col("key").alias(f"key{i}"), F.col("id").alias(x)) for i, x in ((1, "a"), (2, "b")))
    out = linked.join(a, ["t1", "key1"]).join(b, ["t2", "key2"]).filter("a <> b")
    return out.select(F.least("a", "b").alias("observation_id_a"), F.greatest("a", "b").alias("observation_id_b"))
