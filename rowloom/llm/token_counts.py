"""Token counts without token ids.

A byte-level BPE first splits a text into pre-tokens and then merges inside each of them, so that a text's count is
the sum over its distinct pre-tokens of (how often it occurs) times (how many pieces it makes). A first scan collects
the distinct pre-tokens of all documents, pre-aggregated in each task, and the pieces of each are counted once. A
second scan makes per-document pre-token frequencies and joins them: the most frequent pre-tokens, a bounded number,
are broadcast and meet the frequencies inside the task that made them; frequencies of all others are joined by a
shuffle on the pre-token, where none of them is hot. The products are summed for each document. No id is made.
"""

from __future__ import annotations

import json
import os
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.llm.common import text_chunks
from rowloom.session import materialise

#: Fixed value: the published pattern that splits text before byte-level merges.
PRE_TOKEN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pre-tokens that are broadcast: the most frequent ones. Names are short, so they have at most about 50 MB.
HOT = 200_000
#: Longer pre-tokens are named by a digest; only the table of distinct pre-tokens holds them.
LONGEST_NAME = 64
#: No pre-token begins so: a space can only come before letters, before numbers or before neither.
DIGEST = " a1"
#: Distinct pre-tokens that a task collects before it hands them on.
COLLECTED = 200_000


def name_of(pre_token: str) -> str:
    """A pre-token's name in joins: itself, or a digest of 128 bits."""
    if len(pre_token) <= LONGEST_NAME:
        return pre_token
    import hashlib

    return DIGEST + hashlib.blake2b(pre_token.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()


class Splitter:
    """Splits texts into pre-tokens; the file's special strings are pre-tokens of their own wherever they occur."""

    def __init__(self, path: str):
        import regex

        special = [t["content"] for t in json.load(open(path, encoding="utf-8")).get("added_tokens", [])]
        self.pattern = regex.compile(PRE_TOKEN)
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None

    def split(self, text: str) -> list[str]:
        if self.special is None or not self.special.search(text):
            return self.pattern.findall(text)
        found, at = [], 0
        for m in self.special.finditer(text):
            found += self.pattern.findall(text[at : m.start()])
            found.append(m[0])
            at = m.end()
        return found + self.pattern.findall(text[at:])


_splitters: dict[str, Splitter] = {}


def _splitter(path: str) -> Splitter:
    return _splitters.get(path) or _splitters.setdefault(path, Splitter(path))


def vocabulary(docs: DataFrame, tokenizer: str, text: str = "text") -> DataFrame:
    """(name, n, pieces) of each distinct pre-token of all texts: how often it occurs and how many pieces it makes, counted once."""

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, seen = _splitter(tokenizer).split, Counter()

        def handed_on() -> pa.RecordBatch:
            words = list(seen)
            names = [name_of(w) for w in words]
            long = [w if len(w) > LONGEST_NAME else None for w in words]
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(long, pa.string()), pa.array(list(seen.values()), pa.int64())], names=["name", "whole", "n"])

        for _, texts in text_chunks(batches):
            for t in texts:
                seen.update(split(t))
            if len(seen) >= COLLECTED:
                yield handed_on()
                seen = Counter()
        yield handed_on()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(tokenizer)
        library.no_truncation()
        library.no_padding()
        for batch in batches:
            for begin in range(0, batch.num_rows, 2048):
                part = batch.slice(begin, 2048)
                words = [w if w is not None else n for n, w in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)]
                pieces = [len(e.ids) for e in library.encode_batch_fast(words, add_special_tokens=False)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(pieces, pa.int64())], names=["name", "n", "pieces"])

    seen = docs.select(F.col(text).alias("text")).mapInArrow(collect, "name string, whole string, n long")
    distinct = seen.groupBy("name").agg(F.max("whole").alias("whole"), F.sum("n").alias("n"))
    return distinct.mapInArrow(count, "name string, n long, pieces long")


def _most_frequent(words: DataFrame, most: int) -> DataFrame:
    """The words above a frequency that at most `most` words exceed, found from counts of words by the frequency's logarithm."""
    level = F.floor(F.log2("n") * 16).cast("int")
    levels = sorted(((r.level, r.size) for r in words.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("size")).collect()), reverse=True)  # at most 1024 rows
    least, total = 1 << 30, 0
    for at, size in levels:
        total += size
        if total > most:
            break
        least = at
    return words.where(level >= least)


def count_tokens(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", limit: int = 1024) -> DataFrame:
    """key, n_bytes, n_tokens, over_limit for each row of docs; whole texts.

    tokenizer: path of a byte-level BPE file of the tokenizers library, present on every executor. No begin or end
    tokens are added; special strings inside a text are recognised as the library does by default.
    Null text: 0 bytes, 0 tokens. Null, repeated or tied keys: each input row gives one output row. Other columns
    are ignored, whatever their names. An empty table gives an empty table. Very long texts are split into
    pre-tokens like any other; a pre-token of any length is counted.
    """
    spark = docs.sparkSession
    words = materialise(vocabulary(docs, tokenizer, text), "pre-tokens")
    hot = materialise(_most_frequent(words, HOT).select("name", "pieces"), "hot")
    known = spark.sparkContext.broadcast(dict(zip(*(c.to_pylist() for c in hot.toArrow().columns), strict=True)))  # at most HOT short names
    narrow = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(key).alias("key"), F.col(text).alias("text"))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, pieces = _splitter(tokenizer).split, known.value
        for batch, texts in text_chunks(batches):
            sizes, totals, names, counts = [], [], [], []
            for t in texts:
                total, others = 0, []
                found = Counter(split(t))
                for word, n in found.items():
                    p = pieces.get(word)
                    if p is None:
                        others.append((word, n))
                    else:
                        total += n * p
                sizes.append(len(t.encode("utf-8")))
                others = [(name_of(w), n) for w, n in others]
                totals.append(total + sum(n * pieces.get(w, 0) for w, n in others))
                others = [(w, n) for w, n in others if w not in pieces]
                names.append([w for w, _ in others])
                counts.append([n for _, n in others])
            cols = [pa.array(sizes, pa.int64()), pa.array(totals, pa.int64()), pa.array(names, pa.list_(pa.string())), pa.array(counts, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *cols], names=["uid", "key", "n_bytes", "n_hot", "names", "counts"])

    kind = docs.schema[key].dataType.simpleString()
    # written once: hot sums and the other frequencies have to be of one and the same numbering of rows
    made = materialise(narrow.mapInArrow(frequencies, f"uid long, key {kind}, n_bytes long, n_hot long, names array<string>, counts array<long>"), "frequencies")
    rare = words.join(F.broadcast(hot.select("name")), "name", "left_anti").select("name", "pieces")
    others = made.select("uid", F.explode(F.arrays_zip("names", "counts")).alias("e")).select("uid", F.col("e.names").alias("name"), F.col("e.counts").alias("n"))
    sums = others.join(rare, "name").groupBy("uid").agg(F.sum(F.col("n") * F.col("pieces")).alias("n_rare"))
    counted = made.select("uid", "key", "n_bytes", "n_hot").join(sums, "uid", "left")
    n = F.col("n_hot") + F.coalesce("n_rare", F.lit(0))
    return counted.select(F.col("key").alias(key), "n_bytes", n.alias("n_tokens"), (n > limit).alias("over_limit"))
