"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts n-grams of a bounded sample of labelled rows; the model is one matrix of log-probabilities
(n-gram buckets by languages) that goes to every task. Scoring is a sparse product in numpy for a batch of texts at
once: the n-grams of all texts lie in one array, their bucket numbers pick rows of the matrix, which are added up text
by text for all languages together.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowloom.llm.common import text_chunks

#: Hash buckets of n-grams; a block of at most BLOCK_LANGUAGES columns of 4 bytes stays under 64 MB.
BUCKETS = 1 << 16
BLOCK_LANGUAGES = 256
ORDERS = (1, 2, 3, 4)
#: Labelled documents for each language that the model is fitted on, about, and the tasks that read them.
SAMPLE_PER_LANGUAGE = 1000
TRAINING_TASKS = 8
SEED = 7
#: N-grams whose rows are added up at once: 16 MB for a full block of languages.
GATHERED = 1 << 14
SMOOTHING = 0.5
#: Fixed value: the answer for texts without a letter.
UNDETERMINED = "und"

_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], dtype=np.uint64)
_SHIFT = np.uint64(64 - BUCKETS.bit_length() + 1)


def buckets_of(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order the buckets of the n-grams of all texts, one text after the other, and how many each text has.

    N-grams are of code points, in lower case with white space as one kind of mark, and never cross texts.
    """
    plain = [" ".join(t.lower().split()) for t in texts]
    sizes = np.array([len(t) for t in plain], dtype=np.int64)
    points = np.frombuffer("".join(plain).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(points))  # code points from here to the text's end
    hashed = np.zeros(len(points), dtype=np.uint64)
    for n in ORDERS:
        if len(points) < n:
            return
        hashed = (hashed[: len(points) - n + 1] + points[n - 1 :] + np.uint64(n)) * _MULTIPLIERS[n - 1]
        hashed ^= hashed >> np.uint64(29)
        whole = left[: len(hashed)] >= n
        yield (hashed[whole] * _MULTIPLIERS[0] >> _SHIFT).astype(np.int32), np.maximum(sizes - (n - 1), 0)


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    blocks: tuple[np.ndarray, ...]  # each (BUCKETS, languages of the block) float32 log-probabilities, in the order of languages
    prior: np.ndarray


def scores(texts: list[str], weights: np.ndarray) -> np.ndarray:
    """(texts, languages of the block): the summed log-likelihoods of every n-gram of each whole text."""
    total = np.zeros((len(texts), weights.shape[1]))
    for buckets, sizes in buckets_of(texts):
        ends = np.cumsum(sizes)
        for a in range(0, len(buckets), GATHERED):
            b = min(len(buckets), a + GATHERED)
            # the texts with n-grams in a .. b, and where each one's begin there
            first, last = np.searchsorted(ends, a, side="right"), np.searchsorted(ends, b - 1, side="right")
            mine = np.arange(first, last + 1)
            mine = mine[sizes[mine] > 0]
            begin = np.maximum(ends[mine] - sizes[mine], a) - a
            total[mine] += np.add.reduceat(weights[buckets[a:b]], begin, axis=0, dtype=np.float64)
    return total


def held_out(key: Column) -> Column:
    """Documents that training never sees: crc32 of the key as text leaves 2 modulo 4. A null key counts as seen."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = SAMPLE_PER_LANGUAGE) -> LanguageModel:
    """Counts n-grams of about per_language labelled, not held-out rows for each language.

    The sample is stratified and seeded: one count for each language sets its share, and rows are drawn where they
    lie, so no text moves to be chosen. Languages are counted in blocks of BLOCK_LANGUAGES, one scan each. The counts
    return as one row of BUCKETS numbers for each language and task, merged on the driver one task after the other:
    bounded by the sample, not by the corpus. Every language is learned, from the whole texts of its sample; the
    driver keeps 256 KB for each. Null texts teach nothing; an empty table gives a model without languages.
    """
    labelled = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    labelled = labelled.where(F.col("lang").isNotNull() & ~held_out(F.col("key")))
    sizes = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()
    shares = sorted((r.lang, min(1.0, per_language / r.n)) for r in sizes)
    fitted = [_fit_block(labelled, dict(shares[k : k + BLOCK_LANGUAGES])) for k in range(0, len(shares), BLOCK_LANGUAGES)]
    fitted = [x for x in fitted if x[0]]
    documents = np.array([n for _, _, seen in fitted for n in seen], dtype=np.float64)
    return LanguageModel(tuple(x for names, _, _ in fitted for x in names), tuple(w for _, w, _ in fitted), np.log(documents / documents.sum()))


def _fit_block(labelled: DataFrame, shares: dict[str, float]) -> tuple[tuple[str, ...], np.ndarray, list[int]]:
    """Languages (those with a sampled text), log-probabilities and sampled documents of one block."""
    chosen = labelled.sampleBy("lang", shares, SEED).where("text is not null")
    # one task's matrix for each language is small, but many tasks have few sampled rows: gather them in a few tasks
    chosen = chosen.select("lang", "text").repartition(TRAINING_TASKS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        seen: dict[str, int] = {}
        for batch, texts in text_chunks(batches):
            found: dict[str, list[str]] = {}
            for language, t in zip(batch.column(0).to_pylist(), texts, strict=True):
                found.setdefault(language, []).append(t)
            for language, mine in found.items():
                seen[language] = seen.get(language, 0) + len(mine)
                if language not in totals:
                    totals[language] = np.zeros(BUCKETS, np.int64)
                for b, _ in buckets_of(mine):
                    totals[language] += np.bincount(b, minlength=BUCKETS)
        for language, total in totals.items():
            yield pa.RecordBatch.from_arrays([pa.array([language]), pa.array([seen[language]], pa.int64()), pa.array([total.astype("<i8").tobytes()], pa.binary())], names=["lang", "docs", "counts"])

    gathered: dict[str, np.ndarray] = {}
    documents: dict[str, int] = {}
    for r in chosen.mapInArrow(count, "lang string, docs long, counts binary").toLocalIterator():
        gathered[r.lang] = gathered.get(r.lang, 0) + np.frombuffer(r.counts, dtype="<i8")
        documents[r.lang] = documents.get(r.lang, 0) + r.docs
    languages = tuple(sorted(gathered))
    if not languages:
        return (), np.zeros((BUCKETS, 0), np.float32), []
    counts = np.stack([gathered[x] for x in languages]) + SMOOTHING
    weights = np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32)
    return languages, np.ascontiguousarray(weights.T), [documents[x] for x in languages]


def predict(docs: DataFrame, model: LanguageModel, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """key, held_out, lang_pred, score for each row of docs, and the columns named in keep as they are.

    Whole texts are scored; only the text is an input of a prediction. Null or empty texts, texts without a letter and
    a model without languages give ``und`` with score 0. Ties go to the alphabetically first language. Null or
    repeated keys: each row is predicted by itself. Other columns are ignored, whatever their names. An empty table
    gives an empty table; a text of any length is scored whole, GATHERED n-grams at a time.
    """
    shared = [docs.sparkSession.sparkContext.broadcast(w) for w in model.blocks]  # each at most BUCKETS x BLOCK_LANGUAGES floats
    languages, prior = model.languages, model.prior
    names = [f"keep_{k}" for k in range(len(keep))]
    narrow = docs.select(F.col(key).alias("key"), held_out(F.col(key)).alias("held_out"), F.col(text).alias("text"), *(F.col(c).alias(n) for c, n in zip(keep, names, strict=True)))
    out = [f for f in narrow.schema if f.name != "text"]
    carried = [f.name for f in out]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        letter = regex.compile(r"\p{L}")
        for batch, texts in text_chunks(batches):
            asked = [k for k, t in enumerate(texts) if languages and letter.search(t)]
            mine = [texts[k] for k in asked]
            found = [(UNDETERMINED, 0.0)] * len(texts)
            if mine:
                parts = []
                for block in shared:
                    parts.append(scores(mine, block.value))
                    if len(shared) > 1 and getattr(block, "_path", None):
                        vars(block).pop("_value", None)  # one block in memory at a time; the next use reads its file again
                total = np.concatenate(parts, axis=1) + prior
                p = np.exp(total - total.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                best = p.argmax(axis=1)  # a tie goes to the first language in alphabetical order
                for k, name, value in zip(asked, best.tolist(), p[np.arange(len(mine)), best].tolist(), strict=True):
                    found[k] = (languages[name], value)
            kept = [batch.column(batch.schema.get_field_index(c)) for c in carried]
            yield pa.RecordBatch.from_arrays([*kept, pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], names=[*carried, "lang_pred", "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out) + ", lang_pred string, score double"
    scored = narrow.mapInArrow(score, schema)
    return scored.select(F.col("key").alias(key), "held_out", "lang_pred", "score", *(F.col(n).alias(c) for c, n in zip(keep, names, strict=True)))
