"""Best-fit packing of documents into token sequences, improved by swap-based local search.

Bins only differ by the lengths they hold, and lengths are integers up to the capacity. So the whole corpus is packed
from the counts of its piece lengths - at most `capacity` numbers, however large the corpus - and a *plan* says how
many bins have which lengths. The plan starts as best-fit decreasing and is then improved by local search over classes
of equal underfull bins: a piece moves to another bin, one is exchanged for one, or two for one, whenever the sum of
squared fills rises; bins that become empty vanish. One step acts on as many bins of a class as possible. Pieces are
dealt to the plan's slots by their rank among pieces of equal length, found exactly inside buckets of bounded size.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from rowloom.llm.common import text_chunks
from rowloom.session import materialise

#: Rank buckets for each length at least, and pieces of a bucket beyond that: a hot length is ranked by many tasks.
RANK_BUCKETS, BUCKET_ROWS = 64, 500_000
#: Buckets whose shifts are broadcast (24 bytes each); more are joined by a shuffle on the key that ranks use already.
BROADCAST_BUCKETS = 1_000_000

_encoders: dict[str, object] = {}


class Encoder:
    """Ids as the tokenizers library gives them, computed by the faster tiktoken over the same vocabulary.

    The file's vocabulary is taken as merge ranks; a probe checks the two libraries against each other, and where
    they differ (a file of another kind) the tokenizers library does all the work.
    """

    #: Texts that make both libraries split, merge and recognise special strings.
    PROBES = ("The quick brown fox's 12,345 jumps!\n\n  \tétude größer señor 日本語 😀 x=1;", "aaaaaaaaaaaa  \n <|endoftext|> <|endoftext |>", "")

    def __init__(self, path: str):
        import json

        import tiktoken
        from tokenizers import Tokenizer

        from rowloom.llm.token_counts import PRE_TOKEN

        self.slow = Tokenizer.from_file(path)
        self.fast = None
        try:
            spec = json.load(open(path, encoding="utf-8"))
            special = {t["content"]: t["id"] for t in spec["added_tokens"]}
            as_byte = {c: b for b, c in byte_letters().items()}
            ranks = {bytes(as_byte[c] for c in piece): rank for piece, rank in spec["model"]["vocab"].items() if piece not in special}
            self.fast = tiktoken.Encoding("file", pat_str=PRE_TOKEN, mergeable_ranks=ranks, special_tokens=special)
            if any(self.fast.encode(p, allowed_special="all") != self.slow.encode(p, add_special_tokens=False).ids for p in self.PROBES):
                self.fast = None
        except (KeyError, ValueError):
            self.fast = None

    def encode(self, text: str) -> list[int]:
        if self.fast is not None:
            try:
                return self.fast.encode(text, allowed_special="all")
            except Exception:  # noqa: BLE001 - the pattern engine refuses some extreme texts; the other library does not
                pass
        return self.slow.encode(text, add_special_tokens=False).ids


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: printable bytes are themselves, others follow from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, key: str, text: str) -> DataFrame:
    """(key, piece, start, length, ids_crc32): each document's ids with end_id, cut only if longer than capacity."""
    narrow = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        encode = encoder(tokenizer).encode
        for batch, texts in text_chunks(batches):
            rows, piece, start, length, crc = [], [], [], [], []
            for k, t in enumerate(texts):
                ids = np.array([*encode(t), end_id], dtype="<u4")
                first = len(ids) % capacity or capacity
                at, n = 0, 0
                while at < len(ids):
                    to = first if n == 0 else at + capacity
                    rows.append(k)
                    piece.append(n)
                    start.append(at)
                    length.append(to - at)
                    crc.append(zlib.crc32(ids[at:to].tobytes()))
                    at, n = to, n + 1
            keys = batch.column(0).take(pa.array(rows, pa.int32()))
            long = [pa.array(c, pa.int64()) for c in (start, length, crc)]
            yield pa.RecordBatch.from_arrays([keys, pa.array(piece, pa.int32()), *long], names=["key", "piece", "start", "length", "ids_crc32"])

    schema = f"key {docs.schema[key].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long"
    return narrow.mapInArrow(cut, schema)


class Plan:
    """How many bins hold which lengths: a dictionary from a bin's sorted lengths to its number of copies."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity = capacity
        self.bins: dict[tuple[int, ...], int] = defaultdict(int)
        self._best_fit_decreasing(counts)
        self.steps = self._local_search()

    @property
    def total(self) -> int:
        return sum(self.bins.values())

    def _best_fit_decreasing(self, counts: dict[int, int]) -> None:
        """Longest pieces first, each into the fullest bin that takes it; equal pieces and equal bins go together."""
        room: dict[int, dict[tuple[int, ...], int]] = defaultdict(dict)  # free space -> bins

        def put(lengths: tuple[int, ...], n: int) -> None:
            free = self.capacity - sum(lengths)
            room[free][lengths] = room[free].get(lengths, 0) + n

        for length in sorted(counts, reverse=True):
            left = counts[length]
            while left:
                free = min((f for f in room if f >= length and room[f]), default=None)
                if free is None:
                    each = self.capacity // length
                    full, rest = divmod(left, each)
                    if full:
                        put((length,) * each, full)
                    if rest:
                        put((length,) * rest, 1)
                    left = 0
                else:
                    lengths, n = next(iter(room[free].items()))
                    fit = free // length  # best fit keeps filling a bin that stays the fullest
                    if left >= fit:
                        used, more = min(n, left // fit), fit
                    else:
                        used, more = 1, left
                    room[free][lengths] -= used
                    if not room[free][lengths]:
                        del room[free][lengths]
                    put(lengths + (length,) * more, used)
                    left -= used * more
        for of_room in room.values():
            for lengths, n in of_room.items():
                self.bins[tuple(sorted(lengths, reverse=True))] += n

    def _local_search(self) -> int:
        """Take improving exchanges until none is left or the lower bound is met; squared fills rise, so it ends."""
        weight = sum(sum(b) * n for b, n in self.bins.items())
        least = -(-weight // self.capacity)
        steps, dead = 0, set()
        while self.total > least:
            # the emptiest class gives pieces away, the fullest underfull ones take them
            fresh = set()
            under = sorted((b for b in self.bins if sum(b) < self.capacity), key=sum)
            for giver in under:
                if giver in dead:
                    continue
                step = self._step(giver, under)
                if step:
                    break
                fresh.add(giver)
            else:
                if not dead:
                    break
                dead.clear()  # givers passed over may have an exchange with bins that changed since
                continue
            dead |= fresh
            for bins, sign in ((step[0], -1), (step[1], 1)):
                for b in bins:
                    if b:
                        self.bins[b] += sign * step[2]
                        if not self.bins[b]:
                            del self.bins[b]
            dead.clear() if steps % 64 == 0 else dead.difference_update(step[1])
            steps += 1
        return steps

    def _step(self, giver: tuple[int, ...], under: list[tuple[int, ...]]):
        """The best exchange of giver with a fuller bin: (old bins, new bins, copies), or None.

        Moving weight d from a bin of fill f to one of fill g >= f changes the squared fills by 2 d (g - f + d) > 0,
        so each exchange that moves weight from the emptier to the fuller bin within its room improves the plan.
        """
        f = sum(giver)
        best, gain = None, 0
        ones = sorted(set(giver), reverse=True)
        twos = {a + b: (a, b) for k, a in enumerate(ones) for b in ones[k:] if a != b or giver.count(a) > 1}
        for taker in reversed(under):
            same = taker == giver
            if same and self.bins[giver] < 2:
                continue
            g = sum(taker)
            if g < f:
                break
            free = self.capacity - g
            reachable = min(free, f)
            if 2 * reachable * (g - f + reachable) <= gain:
                continue
            # what can come back: nothing, or one piece
            for back in (0, *sorted(set(taker))):
                for size, out in [(a, (a,)) for a in ones] + list(twos.items() if back else []):
                    d = size - back
                    if 0 < d <= free and 2 * d * (g - f + d) > gain:
                        gain, best = 2 * d * (g - f + d), (taker, out, back)
        if best is None:
            return None
        taker, out, back = best
        new_giver, new_taker = list(giver), list(taker)
        for x in out:
            new_giver.remove(x)
            new_taker.append(x)
        if back:
            new_taker.remove(back)
            new_giver.append(back)
        copies = self.bins[giver] // 2 if taker == giver else min(self.bins[giver], self.bins[taker])
        return (giver, taker), (tuple(sorted(new_giver, reverse=True)), tuple(sorted(new_taker, reverse=True))), copies

    def slots(self) -> list[tuple[int, int, int, int, list[int], int]]:
        """(length, first rank, last rank + 1, copies each, offsets, first sequence) for each length of each class of bins."""
        used: dict[int, int] = defaultdict(int)
        out, sequence = [], 0
        for bin_, n in sorted(self.bins.items(), reverse=True):
            offsets, at = defaultdict(list), 0
            for length in bin_:
                offsets[length].append(at)
                at += length
            for length, places in offsets.items():
                first = used[length]
                used[length] += n * len(places)
                out.append((length, first, used[length], len(places), places, sequence))
            sequence += n
        return out


SLOTS = T.StructType([
    T.StructField("length", T.LongType()), T.StructField("first", T.LongType()), T.StructField("last", T.LongType()),
    T.StructField("each", T.LongType()), T.StructField("offsets", T.ArrayType(T.LongType())), T.StructField("sequence", T.LongType()),
])


def pack(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, piece, start, length, ids_crc32, sequence_id, offset for each piece of each row of docs.

    tokenizer: path of a tokenizers file, present on every executor. Each document's ids end with end_id. Only a
    document longer than capacity is cut, into full pieces after a first one that may be shorter. Sequences hold at
    most capacity ids, without gaps, numbered from 0.
    Null text: one piece holding end_id alone. Null or repeated keys: each input row is packed by itself. Other
    columns are ignored. An empty table gives an empty table.
    The driver sees the counts of piece lengths (at most `capacity` numbers) and the plan.
    """
    numbered = pieces(docs, tokenizer, capacity, end_id, key, text).withColumn("row", F.monotonically_increasing_id())
    cut = materialise(numbered, "pieces")
    counts = {r.length: r.n for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most capacity rows
    plan = Plan(counts, capacity)
    spark = docs.sparkSession
    # ranks among equal lengths: inside a bucket, then shifted by the buckets before it; a bucket takes rows by number,
    # so neither a hot length nor a key that repeats fills one
    hot = {length: -(-n // BUCKET_ROWS) for length, n in counts.items() if n > RANK_BUCKETS * BUCKET_ROWS}
    buckets = F.lit(RANK_BUCKETS).cast("long")
    if hot:
        sizes = F.create_map(*(F.lit(x).cast("long") for pair in hot.items() for x in pair))
        buckets = F.coalesce(F.element_at(sizes, F.col("length")), buckets)
    cut = cut.withColumn("bucket", F.pmod(F.xxhash64("row"), buckets))
    by_bucket = cut.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    shift = by_bucket.select("length", "bucket", F.coalesce(before, F.lit(0)).alias("shift"))
    small = capacity * RANK_BUCKETS + sum(hot.values()) <= BROADCAST_BUCKETS
    local = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("row")) - 1
    ranked = cut.withColumn("local", local).join(F.broadcast(shift) if small else shift, ["length", "bucket"]).withColumn("rank", F.col("shift") + F.col("local"))
    return _deal(ranked, spark, plan).select(F.col("key").alias(key), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def _deal(ranked: DataFrame, spark, plan: Plan) -> DataFrame:
    """Rank intervals of each length to slots; one record for each length holds all its intervals in order."""
    slots = spark.createDataFrame(plan.slots(), SLOTS)
    by_length = slots.groupBy("length").agg(F.array_sort(F.collect_list(F.struct("first", "last", "each", "offsets", "sequence"))).alias("slots"))
    # the plan has a bounded number of classes: each length opens few of them, and exchanges split one at a time
    joined = ranked.join(F.broadcast(by_length), "length")
    hit = F.filter("slots", lambda s: (F.col("rank") >= s["first"]) & (F.col("rank") < s["last"]))[0]
    placed = joined.select("*", hit.alias("slot")).withColumn("k", F.col("rank") - F.col("slot.first"))
    return placed.select(
        "key", "piece", "start", "length", "ids_crc32",
        (F.col("slot.sequence") + F.floor(F.expr("k div slot.each")).cast("long")).alias("sequence_id"),
        F.element_at("slot.offsets", (F.col("k") % F.col("slot.each") + 1).cast("int")).alias("offset"),
    )
