"""Benchmark decontamination: windows of benchmark words found in training documents.

Benchmark items become windows of `size` consecutive words (shorter items one window of all their words). Their hashes
fill a Bloom filter; each document's windows are tested against it in the row, the few survivors meet the broadcast
n-gram table (by shuffle when its counted rows or bytes pass a bound) and are verified word by word. A document word inside any
occurrence is hit. Hashes of 1, 2, 4, ... words are made once a text, each from two of the length before; a window of any
length is a hash of few of them, so one pass over the places serves all item lengths. The filter has 32 bits a window until it reaches 2 MB (half a million windows); beyond that the share of
other windows that pass it rises smoothly (0.2 % at a million, 2 % at two, 16 % at four), and all that pass are verified.

Edge cases: null and empty texts have no words and no hits; items without words give no window; windows shared by items
count for each; items without an id count as none, though their words are hit; repeated document rows are reported separately; an empty benchmark leaves every document clean; extra
columns are ignored by `scan` and kept by `clean`.
"""

from __future__ import annotations

import functools
import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basisline.llm.common import BROADCAST_ROWS, bind, checked_join, is_small, lower_ascii, stored, table

#: Everything that is not part of a word, once A-Z are lower-cased.
NON_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A word as it stands in the text (A-Z not yet lowered) with the separators after it.
WORD_AND_GAP = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*"
LEAD_GAP = r"^[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*"
MAX_FILTER_BITS = 1 << 24


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), NON_WORD), "")


def hashed(df: DataFrame, keep: list[str], longest: int) -> DataFrame:
    """Add h2, h4, ... up to `longest` words to a table with h1, the hashes of its words: each is made from two of the half
    length. Places too near the end for a whole window hold hashes that nothing may read."""

    def doubled(half: int) -> Column:
        return F.transform(f"h{half}", lambda x, i: F.xxhash64(x, F.get(F.col(f"h{half}"), i + half)))

    known, half = ["h1"], 1
    while 2 * half <= longest:
        df = bind(df, [*keep, *known], **{f"h{2 * half}": doubled(half)})
        half *= 2
        known.append(f"h{half}")
    return df


def window_hash(i: Column, length: int) -> Column:
    """Hash of the `length` words from place i, out of the hashes that `hashed` adds: of its longest whole parts in turn."""
    parts, at = [], 0
    for k in reversed(range(length.bit_length())):
        if length >> k & 1:
            parts.append(F.get(F.col(f"h{1 << k}"), i + at))
            at += 1 << k
    return parts[0] if len(parts) == 1 else F.xxhash64(*parts)


def gram_table(benchmark: DataFrame, size: int, item: str = "item_id", text: str = "text") -> DataFrame:
    """One row per (length, window): its hash, its words joined by a space, and the items that hold it."""
    b = bind(benchmark.select(F.col(item).cast("string").alias("item"), F.col(text).alias("t")), ["item"], words=words_of(F.col("t")))
    b = bind(b, ["item", "words"], h1=F.transform("words", lambda x: F.xxhash64(x)), n=F.size("words")).where("n > 0")
    b = hashed(b, ["item", "words", "n"], size)
    length = F.least(F.col("n"), F.lit(size))
    b = b.select("*", length.alias("len"), F.explode(F.sequence(F.lit(0), F.col("n") - length)).alias("i"))
    g = F.coalesce(*[F.when(F.col("len") == k, window_hash(F.col("i"), k)) for k in range(1, size + 1)])
    b = b.select("item", "len", g.alias("g"), F.array_join(F.slice("words", F.col("i") + 1, F.col("len")), " ").alias("gram"))
    return b.groupBy("len", "g", "gram").agg(F.collect_set("item").alias("items"))


@dataclass(frozen=True)
class BloomFilter:
    """A constant Bloom filter. `held` is its array of 64-bit words; a caller that tests often binds it once and passes it in."""

    held: Column
    bits: int
    probes: int

    def places(self, g: Column) -> list[Column]:
        again = F.xxhash64(g)
        return [F.call_function("shiftright", x, F.lit(shift)).bitwiseAND(F.lit(self.bits - 1)) for x, shift in ((g, 0), (g, 32), (again, 0), (again, 32))][: self.probes]

    def __call__(self, g: Column, held: Column | None = None) -> Column:
        held = self.held if held is None else held
        hit = [F.call_function("shiftright", held[F.call_function("shiftright", p, F.lit(6)).cast("int")], p.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1 for p in self.places(g)]
        return functools.reduce(Column.__and__, hit)


def bloom_filter(grams: DataFrame, n: int) -> BloomFilter:
    """The filter of the window hashes of the stored n windows."""
    bits = min(MAX_FILTER_BITS, 1 << max(12, (32 * n - 1).bit_length()))
    empty = BloomFilter(F.lit(None), bits, max(1, min(4, round(math.log(2) * bits / max(n, 1)))))
    ones = grams.select(F.explode(F.array(*empty.places(F.col("g")))).alias("place"))
    found = ones.groupBy(F.shiftright("place", 6).alias("k")).agg(F.bit_or(F.expr("shiftleft(1L, cast(place & 63 as int))")).alias("v")).toArrow()  # at most bits / 64 rows
    words = np.zeros(bits // 64, "int64")
    words[found.column("k").to_numpy()] = found.column("v").to_numpy()
    return BloomFilter(F.split(F.lit(",".join(map(str, words.tolist()))), ",").cast("array<bigint>"), bits, empty.probes)


def survivors(passes: BloomFilter, lengths: list[int]) -> Column:
    """The windows (i, len, g) of a text that pass the filter: places where any length passes, then which lengths do there.
    The filter stands in the plan once, as the argument of a lambda."""
    whole = lambda i, k: F.when(i + k <= F.col("n_words"), window_hash(i, k))
    places = F.when(F.col("n_words") >= lengths[0], F.sequence(F.lit(0), F.col("n_words") - lengths[0])).otherwise(F.lit([]).cast("array<int>"))

    def windows(held: Column) -> Column:
        some = F.filter(places, lambda i: F.exists(F.array(*[whole(i, k) for k in lengths]), lambda g: passes(g, held)))
        every = lambda i: F.array(*[F.struct(i.alias("i"), F.lit(k).alias("len"), whole(i, k).alias("g")) for k in lengths])
        return F.flatten(F.transform(some, lambda i: F.filter(every(i), lambda c: passes(c.g, held))))

    return F.get(F.transform(F.array(passes.held), windows), F.lit(0))


def scan(docs: DataFrame, benchmark: DataFrame, size: int = 10, key: str = "doc_id", text: str = "text", bound: int = BROADCAST_ROWS) -> DataFrame:
    """One row per document row: doc_id, row, n_words, n_hit, items (sorted item ids as strings) and the hit spans."""
    grams = stored(gram_table(benchmark, size), "benchmark-grams")
    n = grams.count()
    lengths = sorted(r[0] for r in grams.select("len").distinct().collect())  # at most `size` values
    passes = bloom_filter(grams, n)
    d = docs.select(F.col(key).alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.col(text).alias("t"))
    d = bind(d, ["doc_id", "row"], words=words_of(F.col("t")))
    d = bind(d, ["doc_id", "row", "words"], h1=F.transform("words", lambda x: F.xxhash64(x)), n_words=F.size("words"))
    if lengths:
        d = hashed(d, ["doc_id", "row", "words", "n_words"], lengths[-1])
        d = bind(d, ["doc_id", "row", "words", "n_words"], c=survivors(passes, lengths))
    else:
        d = d.withColumn("c", F.expr("cast(array() as array<struct<i:int,len:int,g:bigint>>)"))
    d = bind(d, ["doc_id", "row", "n_words"], c=F.transform("c", lambda c: F.struct(c.i.alias("i"), c.len.alias("len"), c.g.alias("g"), F.array_join(F.slice("words", c.i + 1, c.len), " ").alias("gram"))))
    d = d.select("doc_id", "row", "n_words", F.explode_outer("c").alias("c")).select("doc_id", "row", "n_words", "c.*")
    d = d.join(F.broadcast(grams) if is_small(grams, bound) else grams, ["len", "g", "gram"], "left")
    hit = F.col("items").isNotNull()
    d = d.groupBy("doc_id", "row").agg(
        F.first("n_words").cast("long").alias("n_words"),
        F.array_sort(F.collect_list(F.when(hit, F.struct(F.col("i").alias("a"), (F.col("i") + F.col("len")).alias("b"))))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    end = F.aggregate("spans", F.struct(F.lit(0).alias("n"), F.lit(0).alias("e")), lambda s, x: F.struct((s.n + F.greatest(F.lit(0), x.b - F.greatest(s.e, x.a))).alias("n"), F.greatest(s.e, x.b).alias("e")))
    return d.select("doc_id", "row", "n_words", end.n.cast("long").alias("n_hit"), "items", "spans")


def clean(docs: DataFrame, benchmark: DataFrame, size: int = 10, mode: str = "document", key: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents without their benchmark passages, all columns kept.

    mode "document" drops every contaminated document; mode "span" cuts the hit words with the separators after them.
    Rows are matched by key and text hash, so repeated rows are treated alike.
    """
    tagged = docs.select(F.col(key).alias("k"), F.xxhash64(text).alias("h"), F.col(text).alias("t"), F.struct("*").alias("__row"))
    ids = tagged.select(F.struct("k", "h").alias("doc_id"), F.col("t").alias("text"))
    hits = scan(ids, benchmark, size).where("n_hit > 0").select(F.col("doc_id.k").alias("hk"), F.col("doc_id.h").alias("hh"), F.col("spans").alias("hs"))
    hits = stored(hits.dropDuplicates(["hk", "hh"]), "benchmark-hits")
    same = F.col("k").eqNullSafe(F.col("hk")) & (F.col("h") == F.col("hh"))
    if mode == "document":
        return checked_join(tagged, hits, same, "left_anti").select("__row.*")
    parts = F.regexp_extract_all(F.coalesce("t", F.lit("")), F.lit(WORD_AND_GAP), F.lit(0))
    left = F.filter(parts, lambda w, i: ~F.exists("hs", lambda s: (s.a <= i) & (i < s.b)))
    cut = F.concat(F.regexp_extract(F.coalesce("t", F.lit("")), LEAD_GAP, 0), F.array_join(left, ""))
    new = checked_join(tagged, hits, same, "left").withColumn("__t", F.when(F.col("hs").isNull(), F.col("t")).otherwise(cut))
    return new.select(*[(F.col("__t") if c == text else F.col("__row")[c]).alias(c) for c in docs.columns])


def op4_benchmark_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )
