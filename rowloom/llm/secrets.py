"""Secret scans, from DataFrame functions only.

Three patterns find secrets by form (the base). Beyond them, every long token is scored by two character Markov
models - random strings and ordinary identifiers - and added where the log-likelihood ratio favours randomness.
The models are transition counts of labelled samples; both together are one table of log-ratios for pairs of
characters, of fixed size.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The base patterns; an assign match counts from 6 characters of its second group on.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 6, 20, 24
KINDS = ("assign", "access", "hex", "markov")
LABELS = ("random", "ordinary", "word")

#: Characters of a token; a model knows these and the start of a token.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
TOKEN = r"[A-Za-z0-9+/_=-]"
MIN_TOKEN = 12
#: A token is reported if its log-likelihood ratio exceeds this, in total and for each character.
MIN_RATIO, MIN_RATIO_EACH = 20.0, 1.0
#: Share of each character's transitions that is spread evenly over the alphabet: alike for samples of any size.
EVEN = 0.005
#: Bounds of the labelled sample: generated random strings, and documents whose words are ordinary.
RANDOM_STRINGS = 4000
ORDINARY_DOCUMENTS = 2000
SEED = 5
#: Tokens of fewer different characters are rulers and fillers, not secrets.
MIN_DISTINCT = 8


@dataclass(frozen=True)
class MarkovModel:
    """ratios[a * size + b] = log P(b | a, random) - log P(b | a, ordinary); character 0 is the start of a token."""

    ratios: tuple[float, ...]

    @property
    def size(self) -> int:
        return len(ALPHABET) + 1

    def score(self, token: Column) -> Column:
        """The log-likelihood ratio of a token, as a native expression."""
        table = F.split(F.lit(",".join(f"{x:.6f}" for x in self.ratios)), ",").cast("array<double>")  # folded to a constant
        code = lambda k: F.instr(F.lit(ALPHABET), F.substr(token, k, F.lit(1)))
        pair = lambda k: F.when(k == 1, F.lit(0)).otherwise(code(k - 1)) * self.size + code(k) + 1
        return F.aggregate(F.sequence(F.lit(1), F.length(token)), F.lit(0.0), lambda acc, k: acc + F.element_at(table, pair(k)))


def train(samples: DataFrame) -> MarkovModel:
    """From samples(token, label): transition counts of random tokens, ordinary tokens and words; at most 6 * size^2 rows.

    A word stands for the ways in which names are made of words. A model of neighbouring characters sees nothing of a
    joined name but the transitions inside its words and those from a last letter to a mark and from a mark to a first
    letter, so these follow from the words' counts, and no name has to be written.
    """
    t = F.col("token")
    size = F.length(t)
    here = lambda k: F.substr(t, k, F.lit(1))
    pair = lambda k: F.struct(F.when(k == 1, F.lit("")).otherwise(here(k - 1)).alias("a"), F.when(k > size, F.lit("")).otherwise(here(k)).alias("b"), (k == 2).alias("head"))
    pairs = F.transform(F.sequence(F.lit(1), size + 1), pair)  # an empty character before the first and after the last
    counts = samples.where(size > 0).select("label", F.inline(pairs)).groupBy("label", "head", "a", "b").agg(F.count(F.lit(1)).alias("n"))
    known = F.array(*(F.lit(c) for c in ["", *ALPHABET]))
    rows = counts.where(F.array_contains(known, F.col("a")) & F.array_contains(known, F.col("b"))).collect()
    number = {c: k + 1 for k, c in enumerate(ALPHABET)} | {"": 0}
    n = len(ALPHABET) + 1
    seen = {(label, head): [[0.0] * n for _ in range(n)] for label in LABELS for head in (True, False)}
    for r in rows:
        seen[r.label, r.head][number[r.a]][number[r.b]] += r.n
    both = lambda label: [[x + y for x, y in zip(p, q, strict=True)] for p, q in zip(seen[label, True], seen[label, False], strict=True)]
    ordinary = both("ordinary")
    _add_names(ordinary, seen["word", True], both("word"))
    log = [[[math.log((1 - EVEN) * x / max(1.0, sum(row[1:])) + EVEN / (n - 1)) for x in row] for row in table] for table in (both("random"), ordinary)]
    return MarkovModel(tuple(log[0][a][b] - log[1][a][b] for a in range(n) for b in range(n)))


def _add_names(table: list[list[float]], heads: list[list[float]], words: list[list[float]]) -> None:
    """Add the transitions of names made of the counted words: alone, in capitals, in threes joined by a mark, written
    together with capital initials (about five words), and followed by a number below 100."""
    code = {c: k + 1 for k, c in enumerate(ALPHABET)}
    cased = lambda change: [code.get(change(c), 0) for c in ["", *ALPHABET]]
    same, upper, lower = cased(str), cased(str.upper), cased(str.lower)
    first, last = words[0][1:], [row[0] for row in words]  # by letter: how many words begin and end with it
    total = sum(first)
    if not total:
        return
    letters = range(1, len(ALPHABET) + 1)
    for case in (same, upper):
        for marks, share in (("", 1.0), *((mark, 1 / 3) for mark in "_/-")):
            for a in letters:
                table[0][case[a]] += share * first[a - 1]
                for b in letters:
                    table[case[a]][case[b]] += words[a][b]
                for mark in marks:
                    table[case[a]][code[mark]] += 2 / 3 * last[a]
                    table[code[mark]][case[a]] += 2 / 3 * first[a - 1]
    for a in letters:
        table[0][upper[a]] += first[a - 1] / 5
        table[0][a] += first[a - 1]
        for b in letters:
            table[upper[a]][lower[b]] += heads[a][b]
            table[lower[a]][lower[b]] += words[a][b] - heads[a][b]
            table[lower[a]][upper[b]] += 4 / 5 * last[a] * first[b - 1] / total
            table[a][b] += words[a][b]
        for d in "0123456789":
            table[a][code[d]] += last[a] / 10
    for d in "0123456789":
        for e in "0123456789":
            table[code[d]][code[e]] += 0.9 * total / 100


def labelled_samples(docs: DataFrame, text: str = "text") -> DataFrame:
    """(token, label): a bounded labelled sample.

    random: digests of numbers written in hexadecimal of both cases, base64, letters and digits, and capitals.
    word: the words of about ORDINARY_DOCUMENTS whole documents (a seeded sample, drawn where rows lie).
    ordinary: decimal numbers and dates; runs of one character.
    Words with digits stay out, so secrets inside texts do not count as ordinary. Null texts have no words, and an
    empty table leaves the generated samples.
    """
    spark = docs.sparkSession
    sha = F.sha2(F.col("id").cast("string"), 256)
    b64 = F.base64(F.unhex(sha))
    forms = F.array(F.substr(sha, F.lit(1), F.lit(40)), F.upper(F.substr(sha, F.lit(1), F.lit(32))), b64, F.regexp_replace(b64, "[+/=]", ""), F.concat(F.lit("A"), F.upper(F.substr(F.regexp_replace(b64, "[^A-Za-z0-9]", ""), F.lit(1), F.lit(19)))))
    random = spark.range(RANDOM_STRINGS).select(F.explode(forms).alias("token"), F.lit("random").alias("label"))
    share = min(1.0, ORDINARY_DOCUMENTS / max(1, docs.count()))
    few = docs.select(F.col(text).alias("t")).sample(False, share, SEED).where("t is not null")
    words = few.select(F.explode(F.regexp_extract_all("t", F.lit(r"[A-Za-z]{2,}"), F.lit(0))).alias("token"), F.lit("word").alias("label"))
    digits = lambda salt, top: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(top)).cast("string")
    date = F.concat_ws("-", 1900 + F.col("id") % 200, F.lpad((F.col("id") % 12 + 1).cast("string"), 2, "0"), F.lpad((F.col("id") % 28 + 1).cast("string"), 2, "0"))
    run = F.repeat(F.substr(F.lit(ALPHABET), (F.col("id") % len(ALPHABET) + 1).cast("int"), F.lit(1)), F.lit(24))
    numbers = spark.range(RANDOM_STRINGS).select(F.explode(F.array(F.concat(digits(0, 10**9), digits(1, 10**9)), date, run)).alias("token"), F.lit("ordinary").alias("label"))
    return random.unionByName(words).unionByName(numbers)


def _found(text: Column, pattern: str, kind: int, value_group: int = 0) -> Column:
    """All leftmost non-overlapping matches as array<struct<start, kind, end, value>> in code points.

    Splitting at the matches gives the gaps before them; running sums of the lengths of gaps and matches give positions.
    """
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group)) if value_group else hits
    each = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), hits.alias("hit"), values.alias("value"))  # one more gap than matches
    span = "struct<start:int,kind:int,end:int,value:string>"
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{span}>").alias("spans"))

    def extend(acc: Column, e: Column) -> Column:
        begin = acc["at"] + F.length(e["gap"])
        end = begin + F.length(e["hit"])
        one = F.struct(begin.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), e["value"].alias("value")).cast(span)
        return F.struct(end.alias("at"), F.concat(acc["spans"], F.array(one)).alias("spans"))

    found = F.aggregate(F.filter(each, lambda e: e["hit"].isNotNull()), start, extend, lambda acc: acc["spans"])
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(f"array<{span}>"))


def _uncovered(token: Column, base: Column) -> Column:
    """The stretches of a token between the base spans (sorted by start) that overlap it, as spans."""
    over = F.filter(base, lambda b: (b["start"] < token["end"]) & (token["start"] < b["end"]))
    span = "struct<start:int,kind:int,end:int,value:string>"
    start = F.struct(token["start"].alias("at"), F.array().cast(f"array<{span}>").alias("spans"))

    def stretch(begin: Column, end: Column) -> Column:
        value = F.substr(token["value"], begin - token["start"] + 1, F.greatest(end - begin, F.lit(0)))
        return F.struct(begin.alias("start"), token["kind"].alias("kind"), end.alias("end"), value.alias("value")).cast(span)

    def cut(acc: Column, b: Column) -> Column:
        before = F.concat(acc["spans"], F.array(stretch(acc["at"], b["start"])))
        return F.struct(F.greatest(acc["at"], b["end"]).alias("at"), F.when(b["start"] > acc["at"], before).otherwise(acc["spans"]).alias("spans"))

    def rest(acc: Column) -> Column:
        return F.when(acc["at"] < token["end"], F.concat(acc["spans"], F.array(stretch(acc["at"], token["end"])))).otherwise(acc["spans"])

    return F.when(F.size(over) == 0, F.array(token.cast(span))).otherwise(F.aggregate(over, start, cut, rest))


def spans(docs: DataFrame, model: MarkovModel, text: str = "text") -> DataFrame:
    """docs with __base and __all: sorted arrays of (start, kind, end, value); __all has the Markov spans too.

    Markov spans are stretches of tokens, of MIN_TOKEN characters or more, that no base span covers.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    df = docs.withColumn("__t", t)
    t = F.col("__t")
    assign = F.filter(_found(t, ASSIGN, 0, 2), lambda s: F.length(s["value"]) >= MIN_ASSIGN)
    access = F.when(t.contains("AKIA"), F.filter(_found(t, ACCESS, 1), lambda s: s["end"] - s["start"] >= MIN_ACCESS)).otherwise(F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>"))
    # runs are maximal, so asking for the length inside the pattern finds the same matches
    hex_ = _found(t, HEX.removesuffix("+") + f"{{{MIN_HEX},}}", 2)
    tokens = _found(t, TOKEN + f"{{{MIN_TOKEN},}}", 3)
    df = df.withColumns({"__base": F.sort_array(F.concat(assign, access, hex_)), "__tokens": tokens}).drop("__t")
    varied = lambda s: F.size(F.array_distinct(F.split(s["value"], ""))) >= MIN_DISTINCT
    clear = F.filter(F.flatten(F.transform("__tokens", lambda s: _uncovered(s, F.col("__base")))), lambda s: (s["end"] - s["start"] >= MIN_TOKEN) & varied(s))
    scored = F.transform(clear, lambda s: F.struct(s.alias("s"), model.score(s["value"]).alias("ratio")))
    random = F.filter(scored, lambda e: (e["ratio"] > MIN_RATIO) & (e["ratio"] > MIN_RATIO_EACH * (e["s"]["end"] - e["s"]["start"])))
    df = df.withColumn("__all", F.when(F.size("__tokens") == 0, F.col("__base")).otherwise(F.sort_array(F.concat("__base", F.transform(random, lambda e: e["s"])))))
    return df.drop("__tokens")


def joined(found: Column) -> Column:
    """kind:start:end, comma-joined, in the order of the array."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def scan(docs: DataFrame, model: MarkovModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_assign, n_access, n_hex, base_sha256, spans, n_markov for each row of docs; whole texts.

    Null text counts as empty: no spans, and the digest of the empty string. Null or repeated keys: each row by
    itself. Other columns are ignored, whatever their names. An empty table gives an empty table. A text of any length
    is scanned whole, in a fixed number of passes.
    """
    found = spans(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), model)
    n = lambda kind: F.size(F.filter("__all", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        F.col("key").alias(key), n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"),
        F.sha2(joined(F.col("__base")).cast("binary"), 256).alias("base_sha256"), joined(F.col("__all")).alias("spans"), n(3).alias("n_markov"),
    )


def redact(docs: DataFrame, model: MarkovModel, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """docs with every span (overlapping ones merged) replaced by the mark; other columns and null texts stay as they are."""
    names = docs.columns
    plain = docs.select(*(F.col(c).alias(f"c{k}") for k, c in enumerate(names)))
    at = f"c{names.index(text)}"
    found = spans(plain, model, at)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def cut(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        gap = F.substr(F.col(at), acc["at"] + 1, s["start"] - acc["at"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(fresh, F.concat(acc["parts"], F.array(gap, F.lit(mark)))).otherwise(acc["parts"]).alias("parts"))

    whole = F.aggregate("__all", start, cut, lambda acc: F.concat(F.array_join(acc["parts"], ""), F.substr(F.col(at), acc["at"] + 1, F.length(F.col(at)))))
    clean = F.when(F.size("__all") > 0, whole).otherwise(F.col(at))
    return found.select(*(clean.alias(c) if c == text else F.col(f"c{k}").alias(c) for k, c in enumerate(names)))
