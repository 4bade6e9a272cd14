"""Chat formatting with cumulative snapshots collapsed, from DataFrame functions only.

Logs often hold a conversation again after every turn. A rolling hash of turns - the exclusive or of each turn's hash
with its place - names every prefix of every conversation; a conversation whose whole hash is the name of a shorter
prefix of another one is a snapshot and goes, by an anti-join. What stays is rendered from a template.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rowloom.session import materialise

#: Turn numbers that share a chunk: prefixes are summed inside chunks and then over chunks, and a rendered row has the turns of one chunk.
CHUNK = 256
#: A chunk of more turns than this, whose numbers are null or repeat, is taken apart by role and text hash.
CROWDED = 4 * CHUNK
#: The marks of the template.
START, END = "<|im_start|>", "<|im_end|>"
_HASHES = ("p", "q")


def _keyed(turns: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(key, no, turn, role, text): conversations as structs, which are never null, and the number of the chunk."""
    # joins and groups on key and chunk share one partitioning; null-safe comparison of two columns would need its own
    t = turns.select(F.struct(F.col(conv).alias("conv")).alias("key"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return t.withColumn("no", F.coalesce(F.floor(F.col("turn") / CHUNK).cast("long"), F.lit(-(2**62))))


def _crowded(keyed: DataFrame) -> DataFrame:
    """(crowded_key, crowded_no, bits) of chunks with more than CROWDED turns; none where turn numbers do not repeat."""
    sizes = keyed.groupBy("key", "no").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CROWDED)
    return sizes.select(F.col("key").alias("crowded_key"), F.col("no").alias("crowded_no"), F.least(F.ceil(F.log2(F.col("n") / CHUNK)), F.lit(40)).cast("int").alias("bits"))


def _chunked(keyed: DataFrame, crowded: DataFrame) -> DataFrame:
    """(key, chunk, turn, role, text, h1, h2): chunks in the order of turns; crowded ones are cut by turn, role and first bits of the hash."""
    t = keyed.withColumns({"h1": F.xxhash64("text"), "h2": F.xxhash64(F.lit(17), "text")})
    t = t.join(crowded, (F.col("key") == F.col("crowded_key")) & (F.col("no") == F.col("crowded_no")), "left")
    cut = lambda c: F.when(F.col("bits").isNotNull(), c)
    chunk = F.struct("no", cut(F.col("turn")).alias("turn"), cut(F.col("role")).alias("role"), cut(F.expr("shiftright(h1, 64 - bits)")).alias("bucket"))
    return t.select("key", chunk.alias("chunk"), "turn", "role", "text", "h1", "h2")


def _places(chunked: DataFrame) -> DataFrame:
    """(key, chunk, at, place, size, p, q): see prefixes(); at counts from 1 in the chunk. Only chunk totals move again."""
    t = chunked.drop("text")
    inside = Window.partitionBy("key", "chunk").orderBy("turn", "role", "h1", "h2")
    t = t.withColumn("at", F.row_number().over(inside).cast("long"))
    # chunks are many times fewer than turns: their sizes give each its first place
    ahead = Window.partitionBy("key").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("key")
    sizes = t.groupBy("key", "chunk").agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.select("key", "chunk", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("skip"), F.sum("n").over(whole).alias("size"))
    t = t.join(sizes, ["key", "chunk"]).withColumn("place", F.col("at") + F.col("skip"))
    t = t.select("key", "chunk", "at", "place", "size", F.xxhash64("place", "role", "h1").alias("hp"), F.xxhash64("h2", "place", "role").alias("hq"))
    upto = Window.partitionBy("key", "chunk").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    sums = t.groupBy("key", "chunk").agg(*(F.bit_xor(f"h{h}").alias(f"h{h}") for h in _HASHES))
    sums = sums.select("key", "chunk", *(F.coalesce(F.bit_xor(f"h{h}").over(ahead), F.lit(0)).alias(f"skip_{h}") for h in _HASHES))
    t = t.withColumns({h: F.bit_xor(f"h{h}").over(upto) for h in _HASHES}).join(sums, ["key", "chunk"])
    return t.select("key", "chunk", "at", "place", "size", *(F.col(h).bitwiseXOR(F.col(f"skip_{h}")).alias(h) for h in _HASHES))


def prefixes(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, place, p, q, size): each turn with its place from 1, the rolling hashes up to it and its conversation's size.

    Turns are ordered by number (null first), then role, then a hash of the text; ties and repeated rows stay as turns
    of their own. Null roles and texts count as empty. Texts do not move: two hashes of 64 bits stand for each.
    """
    keyed = _keyed(turns, conv, turn, role, text)
    return _places(_chunked(keyed, _crowded(keyed))).select(F.col("key.conv").alias("conv"), "place", "p", "q", "size")


def maximal(named: DataFrame) -> DataFrame:
    """(conv, size) of conversations that no longer one starts with; of equal ones the smallest id (null last)."""
    ends = named.where(F.col("place") == F.col("size")).groupBy("place", "p", "q").agg(F.min(F.struct(F.col("conv").isNull().alias("unknown"), "conv")).alias("best"))
    inner = named.where(F.col("place") < F.col("size")).select("place", "p", "q").distinct()
    return ends.join(inner, ["place", "p", "q"], "left_anti").select(F.col("best.conv").alias("conv"), F.col("place").alias("size"))


def render(role: Column, text: Column) -> Column:
    """One turn; marks inside a text are spaced out, so that they cannot open or close a turn."""
    for mark in (START, END):
        text = F.replace(text, F.lit(mark), F.lit(mark.replace("<|", "< |")))
    return F.concat(F.lit(START), role, F.lit("\n"), text, F.lit(END + "\n"))


def format_chats(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv, part, n_turns, total_turns, rendered: the retained conversations, rendered in parts of CHUNK turn numbers.

    Parts of a conversation joined in order make its whole text; ordinary conversations have one. More than CROWDED
    turns with null or repeated numbers make further parts, one for each turn number, role and range of text hashes;
    only turns alike in number, role and text stay together. A null conversation id names one conversation, null
    roles and texts are empty, very long texts move once. Other columns are ignored. An empty table gives an empty table.
    """
    keyed = _keyed(turns, conv, turn, role, text)
    crowded = materialise(_crowded(keyed), "crowded")
    named = materialise(_places(_chunked(keyed, crowded)), "prefixes")
    kept = maximal(named.withColumn("conv", F.col("key.conv"))).select(F.struct("conv").alias("key"))
    chunks = named.where("at = 1").join(kept, "key", "left_semi")
    number = F.row_number().over(Window.partitionBy("key").orderBy("chunk")) - 1
    # written, so that the planner knows its size before it moves texts
    chunks = materialise(chunks.select("key", "chunk", number.cast("int").alias("part"), "size"), "chunks")
    parts = _chunked(keyed, crowded).join(chunks, ["key", "chunk"]).groupBy("key", "chunk", "part", "size")
    parts = parts.agg(F.sort_array(F.collect_list(F.struct("turn", "role", "h1", "h2", "text"))).alias("e"))
    text_ = F.array_join(F.transform("e", lambda x: render(x["role"], x["text"])), "")
    return parts.select(F.col("key.conv").alias(conv), "part", F.size("e").cast("long").alias("n_turns"), F.col("size").alias("total_turns"), text_.alias("rendered"))


#: DuckDB's version of format_chats() for conversations of one part.
SQL = r"""
WITH t AS (SELECT conv_id, turn, COALESCE(role, '') AS role, COALESCE(text, '') AS text FROM conversations),
c AS (
  SELECT conv_id, COUNT(*) AS n, string_agg(role || chr(31) || text || chr(30), '' ORDER BY turn NULLS FIRST, role, text) AS s,
         string_agg('<|im_start|>' || role || chr(10) || replace(replace(text, '<|im_start|>', '< |im_start|>'), '<|im_end|>', '< |im_end|>') || '<|im_end|>' || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS rendered
  FROM t GROUP BY 1),
u AS (SELECT MIN(conv_id) AS conv_id, n, s, MIN(rendered) AS rendered FROM c GROUP BY n, s)
SELECT conv_id, CAST(0 AS INTEGER) AS part, n AS n_turns, n AS total_turns, rendered FROM u a
WHERE NOT EXISTS (SELECT 1 FROM u b WHERE b.n > a.n AND starts_with(b.s, a.s))
"""
