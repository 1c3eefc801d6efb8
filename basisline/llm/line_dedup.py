"""Line dedup by distinct-site spread.

Every line with a word is hashed; HyperLogLog sketches of the sites it stands on merge by aggregation. Lines whose
estimate is within the sketch's error of the threshold get an exact distinct count. Lines on enough sites are cross-site
boilerplate: they stay in one document (smallest key) and go everywhere else. Enough are `min_sites` for short lines, which
pages repeat by chance, and `min_sites_long` for lines of `long_words` words or more, which they don't.

Lines seen on one site only never reach a sketch: a cheap first aggregation (count, smallest and largest site hash)
drops them. Hot lines are pre-aggregated to one row a site, or salted, before each shuffle by line.

Edge cases: a line of which every document has a null key is kept by all of them; null texts have no lines and stay null; blank lines are never removed; null sites are one site of their own;
repeats of a line inside a document go with it (the keeping document keeps its own); an empty table gives an empty
result; repeated rows are treated alike; extra columns are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basisline.llm.common import checked_join, is_small, salted_join, stored, table

#: Relative standard error of an HLL sketch with 2**lg_k buckets is about 1.04 / sqrt(2**lg_k); the band is four of them.
LG_K = 10
MIN_SITES = 10
MIN_SITES_LONG = 3
LONG_WORDS = 20


def has_word(line: Column) -> Column:
    return line.rlike(r"[^ \x09-\x0D]")


def line_hash(line: Column) -> Column:
    """Two independent 64-bit hashes of the whole line: collisions are out of reach at any corpus size."""
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit(7), line).alias("b"))


def sites_needed(line: Column, min_sites: int, min_sites_long: int, long_words: int) -> Column:
    """On how many sites a line has to stand: by its number of words."""
    return F.when(F.regexp_count(line, F.lit(r"[^ \x09-\x0D]+")) >= long_words, min_sites_long).otherwise(min_sites)


def site_rows(docs: DataFrame, key: str, text: str, site: str, need: tuple[int, int, int]) -> DataFrame:
    lines = docs.select(F.col(key).alias("k"), F.xxhash64(F.coalesce(F.col(site).cast("string"), F.lit(""))).alias("site"), F.explode(F.array_distinct(F.split(text, "\n"))).alias("line"))
    return lines.where(has_word(F.col("line"))).select("k", "site", line_hash(F.col("line")).alias("l"), sites_needed(F.col("line"), *need).alias("need"))


def sites_of(rows: DataFrame, lines: DataFrame) -> DataFrame:
    """Rows (line, site) of the given lines. Few lines are broadcast; beside many, each line meets them once a site."""
    if is_small(lines):
        return rows.join(F.broadcast(lines), ["a", "b"])
    return rows.select("a", "b", "site").distinct().join(lines, ["a", "b"])


def boilerplate(
    docs: DataFrame, min_sites: int = MIN_SITES, lg_k: int = LG_K, key: str = "doc_id", text: str = "text", site: str = "source", min_sites_long: int = MIN_SITES_LONG, long_words: int = LONG_WORDS
) -> DataFrame:
    """One row per boilerplate line: its hash `l` (a, b), `keeper` (the key that keeps it), and n_sites (estimated or exact)."""
    rows = site_rows(docs, key, text, site, (min_sites, min_sites_long, long_words)).select(F.col("l.a").alias("a"), F.col("l.b").alias("b"), "k", "site", "need")
    wide = rows.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.min("site").alias("lo"), F.max("site").alias("hi"), F.min("k").alias("keeper"), F.min("need").alias("need"))
    wide = stored(wide.where((F.col("n") >= F.col("need")) & (F.col("lo") != F.col("hi"))).select("a", "b", "keeper", "need"), "wide-lines")
    rows = rows.drop("need")
    spread = sites_of(rows, wide)
    sketched = spread.groupBy("a", "b", "keeper", "need").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", lg_k)).alias("est"))
    sketched = stored(sketched, "line-sketches")
    band = F.greatest(F.lit(1.0), F.lit(4 * 1.04 / 2 ** (lg_k / 2)) * F.col("need"))
    sure = sketched.where(F.col("est") > F.col("need") + band).select("a", "b", "keeper", F.col("est").alias("n_sites"))
    unsure = stored(sketched.where(F.col("est").between(F.col("need") - band, F.col("need") + band)).select("a", "b", "keeper", "need"), "near-lines")
    exact = sites_of(rows, unsure).select("a", "b", "keeper", "need", "site").distinct()
    exact = exact.groupBy("a", "b", "keeper", "need").agg(F.count(F.lit(1)).alias("n_sites")).where(F.col("n_sites") >= F.col("need"))
    return sure.unionByName(exact.drop("need"))


def removals(docs: DataFrame, lines: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document (key, text hash) that loses lines: the hashes that go."""
    own = docs.select(F.col(key).alias("k"), F.xxhash64(text).alias("h"), F.explode(F.array_distinct(F.split(text, "\n"))).alias("line"))
    own = own.where(has_word(F.col("line"))).select("k", "h", F.xxhash64("line").alias("a"), F.xxhash64(F.lit(7), F.col("line")).alias("b"))
    gone = salted_join(own, lines, ["a", "b"], F.col("h")).where(~F.col("k").eqNullSafe(F.col("keeper")))
    return gone.groupBy("k", "h").agg(F.collect_set(F.struct("a", "b")).alias("gone"))


def clean_lines(docs: DataFrame, min_sites: int = MIN_SITES, key: str = "doc_id", text: str = "text", site: str = "source", lg_k: int = LG_K) -> DataFrame:
    """Columns: row (all of the document's columns), text (without boilerplate lines), n_lines, n_removed."""
    lines = stored(boilerplate(docs, min_sites, lg_k, key, text, site).select("a", "b", "keeper"), "boilerplate")
    gone = stored(removals(docs, lines, key, text), "line-removals").select(F.col("k").alias("gk"), F.col("h").alias("gh"), "gone")
    tagged = docs.select(F.struct("*").alias("row"), F.col(key).alias("k"), F.xxhash64(text).alias("h"), F.split(text, "\n").alias("parts"))
    out = checked_join(tagged, gone, F.col("k").eqNullSafe(F.col("gk")) & (F.col("h") == F.col("gh")), "left")
    left = F.filter("parts", lambda x: ~F.array_contains("gone", line_hash(x)))
    left = F.when(F.col("gone").isNull(), F.col("parts")).otherwise(left)
    out = out.select("row", "parts", left.alias("left"))
    return out.select("row", F.array_join("left", "\n").alias("text"), F.coalesce(F.size("parts"), F.lit(0)).cast("long").alias("n_lines"), (F.coalesce(F.size("parts"), F.lit(0)) - F.coalesce(F.size("left"), F.lit(0))).cast("long").alias("n_removed"))


def without_boilerplate(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """The documents with their boilerplate lines cut, columns as before (n_chars follows the text).

    A document that loses every line with a word goes: each of its lines stays in the document that keeps it.
    """
    out = clean_lines(docs, min_sites).where((F.col("n_removed") == 0) | has_word(F.col("text")))
    fresh = {"text": F.col("text"), "n_chars": F.when(F.col("n_removed") > 0, F.char_length("text")).otherwise(F.col("row.n_chars")) if "n_chars" in docs.columns else None}
    kinds = dict(docs.dtypes)
    return out.select(*[(fresh[c].cast(kinds[c]) if fresh.get(c) is not None else F.col("row")[c]).alias(c) for c in docs.columns])


def op8_site_spread_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = clean_lines(table(spark, sf_dir, "documents"))
    return out.select(F.col("row.doc_id").alias("doc_id"), "n_lines", "n_removed", "text")
