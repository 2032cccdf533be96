"""Problem 10: subject areas of documents by distributed latent Dirichlet topic models.

1. Texts become sentences of word stems, hashed into `BUCKETS` (all words count, none is cut off).
2. A topic model with one topic per subject and `BACKGROUND` further ones is fitted to all documents by
   variational EM: tasks infer their documents' topic proportions under the current topics and return
   expected counts per bucket, which are summed by bucket; the driver holds the BUCKETS x topics matrix only.
   Rounds go on until the likelihood of the words gains less than `TOLERANCE` of itself, `ROUNDS` at most.
   The labelled samples (bounded, `MAX_SAMPLES`, drawn by a hash where there are more) give the starting point and a weak
   prior (`PRIOR`): words that tell subjects apart start in their subject's topic, the others in the background.
3. Topics are mapped to subjects by their top terms: the terms of the highest lift are looked up among the
   labelled samples, and a topic stands for the subject that most of them come from, or for none.
4. A document's proportions are inferred with the fitted topics until they stand. Subjects with `PROPORTION` of what is
   about any subject, or more, are proposed. A subject is given when the text is exactly checked to hold
   `SENTENCES` sentences with `STEMS` different stems about it (less than that is a passing mention or the name of a firm),
   or, in short documents, `SHARE` of the sentences that are about anything.

Inference works on whole arrays: documents of similar numbers of different stems are padded to one length, and a step
over all of them is two products of matrices.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacantia.session import cut

BUCKETS = 1 << 15
BACKGROUND = 6
STEM = 7
ALPHA, ETA = 0.1, 0.02
#: Most rounds, and the gain of likelihood below which they end; most steps in a document, and the change of proportions below which they end.
ROUNDS, TOLERANCE = 12, 0.01
INNER, STANDING = 40, 0.01
#: How much of all words the labelled start counts for in each round.
PRIOR = 0.3
#: Least part of a document's words on subjects that proposes one.
PROPORTION = 0.03
#: Most labelled samples that the start is made of.
MAX_SAMPLES = 20_000
#: Most subjects; each is a topic of the matrix that the driver holds.
MAX_SUBJECTS = 1_000
#: Top terms by which a topic is mapped, and the part of them that must come from one subject.
TOP_TERMS, TOP_SHARE = 60, 0.35
SENTENCES, STEMS, SHARE = 2, 4, 0.6
#: Least part of a sentence's weight, and least weight in words, that makes it one of a subject.
SENTENCE_SHARE, SENTENCE_WORDS = 0.25, 1.2
#: Distinct words whose buckets a task keeps.
KEPT_WORDS = 500_000
#: Padded cells (documents times different stems) that are inferred at once.
CELLS = 40_000

_BLANKS = r"\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: Signs without width, which hide word and sentence ends.
_HIDDEN = r"[\x{ad}\x{200b}-\x{200f}\x{2060}\x{feff}]"
#: Ends of sentences: blanks after a full stop and the like, line ends and bullets, markup.
_SENTENCE = rf"[.!?\x{{2026}}][{_BLANKS}]+|[\n\r\x{{2028}}\x{{2029}}\x{{2022}}]+|</?[\pL\pN_][^<>]{{0,200}}>"


class _Buckets(dict):
    """Buckets of the stems of the words a task has met; -1 for the end of a sentence, -2 for words too short to tell anything."""

    def __missing__(self, word: str) -> int:
        if len(self) > KEPT_WORDS:
            self.clear()
        self[word] = b = -1 if word == "\n" else -2 if len(word) < 3 else zlib.crc32(word[:STEM].encode()) % BUCKETS
        return b


_BUCKET_OF = _Buckets()


def read_texts(texts: pa.Array | list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buckets of the word stems of all texts in a row, number of them per text, number of its sentence for each).

    Sentences are numbered through all texts; those without words have no number that occurs.
    """
    t = pc.fill_null(pc.cast(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string()), pa.large_string()), "")
    t = pc.replace_substring_regex(pc.utf8_lower(t), _HIDDEN, "")
    t = pc.replace_substring_regex(pc.replace_substring_regex(t, _SENTENCE, "\n"), r"[^\pL\n]+", " ")
    lists = pc.split_pattern(pc.replace_substring(t, "\n", " \n "), " ")
    coded = pc.dictionary_encode(lists.flatten())
    known = np.array([_BUCKET_OF[w] for w in coded.dictionary.to_pylist()] or [0], np.int64)
    flat = known[coded.indices.to_numpy()] if len(coded) else np.empty(0, np.int64)
    owner = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy())
    sentence = np.cumsum(flat == -1) + owner  # a text starts a sentence too
    words = flat >= 0
    return flat[words], np.bincount(owner[words], minlength=len(lists)), sentence[words]


def words_of(texts: list[str | None]) -> list[np.ndarray]:
    """The buckets of the word stems of each text."""
    flat, sizes, _ = read_texts(texts)
    return np.split(flat, np.cumsum(sizes)[:-1]) if texts else []


def sentences(text: str | None) -> list[list[int]]:
    """The buckets of the word stems of each sentence that has any."""
    flat, _, sentence = read_texts([text])
    return [x.tolist() for x in np.split(flat, np.flatnonzero(np.diff(sentence)) + 1) if len(x)]


def _bags(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of (doc_id, text) to each document's different stems with their counts, and its stems in order with the lengths of its sentences."""
    for batch in batches:
        n = batch.num_rows
        flat, sizes, sentence = read_texts(batch.column(1))
        owner = np.repeat(np.arange(n), sizes)
        keys, counts = np.unique(owner * BUCKETS + flat, return_counts=True)
        at = np.flatnonzero(np.diff(sentence, prepend=-1))

        def lists(x: np.ndarray, of: np.ndarray, n: int = n) -> pa.ListArray:
            return pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(n + 1)).astype(np.int32)), pa.array(x.astype(np.int32)))

        columns = [batch.column(0), lists(keys % BUCKETS, keys // BUCKETS), lists(counts, keys // BUCKETS), lists(flat, owner), lists(np.diff(np.append(at, len(flat))), owner[at])]
        yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _BAG.split(", ")])


_BAG = "doc_id bigint, kinds array<int>, counts array<int>, words array<int>, lengths array<int>"


def infer(kinds: np.ndarray, counts: np.ndarray, weights: np.ndarray, inner: int = INNER) -> tuple[np.ndarray, np.ndarray, float]:
    """(topic proportions, what each stem counts for in them, likelihood) of documents under `weights`[bucket, topic].

    Rows of `kinds` are documents; cells with a count of 0 are padding. The second has a weight per cell, so that weight times
    `weights` times proportions are the expected counts of the cell's topics.
    """
    beta, n = weights[kinds], counts.astype(np.float32)
    theta = np.full((len(kinds), weights.shape[1]), 1.0 / weights.shape[1], np.float32)
    total = n.sum(axis=1, keepdims=True)
    for _ in range(inner):
        share = n / np.matmul(beta, theta[:, :, None])[:, :, 0]
        new = theta * np.matmul(share[:, None, :], beta)[:, 0, :] + np.float32(ALPHA)
        new /= new.sum(axis=1, keepdims=True)
        moved = float(np.abs(new - theta).max())
        theta = new
        if moved < STANDING:
            break
    like = np.matmul(beta, theta[:, :, None])[:, :, 0]
    return theta, n / like, float((n * np.log(like)).sum()) if total.any() else 0.0


def _padded(f: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, kinds, counts) of documents with words, padded to one length, those of similar lengths together."""
    sizes = f["kinds"].map(len).to_numpy()
    rows = np.flatnonzero(sizes)
    rows = rows[np.argsort(sizes[rows], kind="stable")]
    lo = 0
    while lo < len(rows):
        hi = lo + 1
        while hi < len(rows) and (hi + 1 - lo) * sizes[rows[hi]] <= CELLS and sizes[rows[hi]] <= 1.3 * sizes[rows[lo]] + 4:
            hi += 1
        part, width = rows[lo:hi], int(sizes[rows[hi - 1]])
        lo = hi
        inside = np.arange(width) < sizes[part][:, None]
        kinds, counts = np.zeros(inside.shape, np.int64), np.zeros(inside.shape, np.int64)
        kinds[inside] = np.concatenate(list(f["kinds"].iloc[part]))
        counts[inside] = np.concatenate(list(f["counts"].iloc[part]))
        yield part, kinds, counts


def start(samples: list[tuple[str, str]], subjects: list[str]) -> np.ndarray:
    """Expected counts to start from: BUCKETS x (subjects + background)."""
    counts = np.zeros((BUCKETS, len(subjects)))
    for (subject, _), words in zip(samples, words_of([t for _, t in samples])):
        if subject in subjects:
            np.add.at(counts[:, subjects.index(subject)], words, 1)
    per = counts / np.maximum(1, counts.sum(axis=0))
    total = per.sum(axis=1, keepdims=True)
    purity = np.divide(per, total, out=np.full_like(per, 1 / max(1, len(subjects))), where=total > 0)
    own = counts * np.clip((purity - 0.4) / 0.6, 0, 1)
    rng = np.random.default_rng(11)
    shared = (counts.sum(axis=1) - own.sum(axis=1) + 0.05)[:, None] * rng.dirichlet(np.ones(BACKGROUND), BUCKETS)
    return np.concatenate([own, shared], axis=1)


def topics(counts: np.ndarray) -> np.ndarray:
    """Word weights of each topic from expected counts."""
    c = counts + ETA
    return (c / c.sum(axis=0, keepdims=True)).astype(np.float32)


def map_topics(weights: np.ndarray, samples: list[tuple[str, str]], subjects: list[str]) -> list[int]:
    """For each topic the subject whose samples hold most of its top terms, or -1."""
    held = np.zeros((BUCKETS, len(subjects)))
    for (subject, _), words in zip(samples, words_of([t for _, t in samples])):
        if subject in subjects:
            held[np.unique(words), subjects.index(subject)] += 1
    per = held / np.maximum(1, held.sum(axis=0))
    seen = held.sum(axis=1) > 1
    lift = weights / weights.mean(axis=1, keepdims=True)
    out = []
    for k in range(weights.shape[1]):
        score = np.where(seen, weights[:, k] * np.log(lift[:, k]), -np.inf)
        top = np.argsort(-score)[:TOP_TERMS]
        top = top[score[top] > 0]
        if not len(top):
            out.append(-1)
            continue
        of = per[top] / np.maximum(1e-12, per[top].sum(axis=1, keepdims=True))
        share = of.mean(axis=0)
        best = int(share.argmax())
        out.append(best if share[best] >= TOP_SHARE else -1)
    return out


def fit(bags: DataFrame, samples: list[tuple[str, str]], subjects: list[str], rounds: int = ROUNDS) -> np.ndarray:
    """The topics' word weights after variational EM over all documents, until the likelihood stands."""
    spark = bags.sparkSession
    first = start(samples, subjects)
    k, counts, before = first.shape[1], first, None
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(topics(counts))  # BUCKETS x topics: 2 MB

        def expect(frames: Iterable[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            weights, total, likelihood = shared.value, None, 0.0
            for f in frames:
                for _, kinds, n in _padded(f):
                    total = np.zeros(weights.shape) if total is None else total
                    theta, share, like = infer(kinds, n, weights)
                    likelihood += like
                    inside = n > 0
                    words = kinds[inside]
                    r = (share[inside][:, None] * weights[words]) * np.repeat(theta, inside.sum(axis=1), axis=0)
                    order = np.argsort(words, kind="stable")
                    at = np.flatnonzero(np.diff(words[order], prepend=-1))
                    total[words[order][at]] += np.add.reduceat(r[order], at, axis=0, dtype=np.float64)
            if total is not None:
                rows = np.flatnonzero(total.sum(axis=1) > 0)
                yield pd.DataFrame({"bucket": np.append(rows, -1), "counts": [*total[rows], np.full(weights.shape[1], likelihood)]})

        parts = bags.select("kinds", "counts").mapInPandas(expect, "bucket bigint, counts array<double>")
        # sums are rounded, so that their order doesn't show
        summed = parts.groupBy("bucket").agg(*[F.sum(F.col("counts")[i]).alias(f"c{i}") for i in range(k)]).toPandas().set_index("bucket")
        likelihood = float(summed["c0"].pop(-1)) if -1 in summed.index else 0.0
        summed = summed.drop(index=-1, errors="ignore")
        counts = np.zeros(first.shape)
        counts[summed.index.to_numpy(np.int64)] = np.round(summed.to_numpy(float), 3)
        counts += first * (PRIOR * counts.sum() / max(1.0, first.sum()))  # the start stays as a prior
        if before is not None and likelihood - before < TOLERANCE * abs(before):
            break
        before = likelihood
    return topics(counts)


def assign(words: np.ndarray, owner: np.ndarray, lengths: np.ndarray, of_word: np.ndarray, proposed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(documents, subjects): the `proposed`[document, subject] that sentences bear out.

    `of_word` says how much of each word is about each subject; `lengths` are those of the sentences of all documents in a row.
    """
    docs, n = proposed.shape
    of_word = of_word * proposed[owner]
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    about = np.add.reduceat(of_word, starts, axis=0)
    best = about.argmax(axis=1)
    top = about[np.arange(len(lengths)), best]
    clear = (top >= SENTENCE_WORDS) & (top >= SENTENCE_SHARE * lengths)
    found = np.bincount(owner[starts][clear] * n + best[clear], minlength=docs * n).reshape(docs, n)
    # different stems of the subject within its sentences
    subject = np.repeat(np.where(clear, best, 0), lengths)
    inside = np.repeat(clear, lengths) & (of_word[np.arange(len(words)), subject] >= 0.5)
    kinds = np.unique((owner[inside] * n + subject[inside]) * BUCKETS + words[inside])
    stems = np.bincount(kinds // BUCKETS, minlength=docs * n).reshape(docs, n)
    given = ((found >= SENTENCES) & (stems >= STEMS)) | ((found > 0) & (found >= SHARE * found.sum(axis=1, keepdims=True)))
    return np.nonzero(given)


def subject_proportions(theta: np.ndarray, total: np.ndarray, subject_of: list[int], n: int) -> np.ndarray:
    """The subjects' parts of the expected words on any subject, from the topic proportions of documents of `total` words."""
    topics = theta.shape[1]
    to_subject = np.zeros((topics, n), np.float32)
    for k, s in enumerate(subject_of):
        if s >= 0:
            to_subject[k, s] = 1
    own = np.maximum(theta * (total[:, None] + ALPHA * topics) - ALPHA, 0) @ to_subject
    return own / np.maximum(own.sum(axis=1, keepdims=True), 1e-9)


def document_subjects(documents: DataFrame, areas: DataFrame, samples: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """doc_id, subject: one row per document and subject a paragraph or more of it is about.

    NULL, empty and blank texts have no subject, nor have texts without words of a subject. Texts of any
    length count whole; repeated rows give repeated rows; other columns are ignored. Empty areas or
    samples, or no documents, give no rows.
    """
    subjects = sorted(r[0] for r in areas.select("subject").dropna().distinct().limit(MAX_SUBJECTS + 1).collect())
    if len(subjects) > MAX_SUBJECTS:
        raise ValueError(f"more than {MAX_SUBJECTS} subjects")
    labelled = sorted(tuple(r) for r in samples.select("subject", "text", F.xxhash64("sample_id", "text").alias("_h")).dropna().orderBy("_h").limit(MAX_SAMPLES).select("subject", "text").collect())
    bags = cut(documents.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).filter("text is not null").mapInArrow(_bags, _BAG))
    schema = "doc_id bigint, subject string"
    if not subjects or not labelled or bags.isEmpty():
        return bags.select("doc_id", F.lit("").alias("subject")).limit(0)
    weights = fit(bags, labelled, subjects, rounds)
    subject_of = map_topics(weights, labelled, subjects)
    shared = bags.sparkSession.sparkContext.broadcast((weights, subject_of))

    def label(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weights, subject_of = shared.value
        for f in frames:
            ids, names = [np.empty(0, np.int64)], []
            for part, kinds, n in _padded(f):
                theta = infer(kinds, n, weights)[0]
                proposed = subject_proportions(theta, n.sum(axis=1), subject_of, len(subjects)) >= PROPORTION
                sizes = f["words"].iloc[part].map(len).to_numpy()
                words, owner = np.concatenate(list(f["words"].iloc[part])).astype(np.int64), np.repeat(np.arange(len(part)), sizes)
                r = weights[words] * theta[owner]
                r /= r.sum(axis=1, keepdims=True)
                of_word = np.stack([r[:, [k for k, s in enumerate(subject_of) if s == i]].sum(axis=1) for i in range(len(subjects))], axis=1)
                doc, subject = assign(words, owner, np.concatenate(list(f["lengths"].iloc[part])).astype(np.int64), of_word, proposed)
                ids.append(f["doc_id"].to_numpy()[part[doc]])
                names += [subjects[s] for s in subject]
            yield pd.DataFrame({"doc_id": np.concatenate(ids), "subject": pd.Series(names, dtype=object)})

    return bags.select("doc_id", "kinds", "counts", "words", "lengths").mapInPandas(label, schema)
