"""Document fingerprints: one-permutation MinHash with optimal densification, on Spark functions alone."""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from luminal.llm.common import words

BINS = 256  # the top byte of a shingle's hash is its bin
BITS = 4  # low-order bits kept of each bin's minimum
PROBES = 8
NEIGHBOUR_ROWS, MOST_BUCKETS = 500, 20_000


def _let(value: Column, body) -> Column:
    """body(value), with value worked out once."""
    return F.transform(F.array(value), body)[0]


def _probe(bin_: int, k: int) -> int:
    """The k-th bin that an empty bin looks at: the same for all documents, and as good as random."""
    x = (bin_ * 0x9E3779B97F4A7C15 + (k + 1) * 0xC2B2AE3D27D4EB4F) & (1 << 64) - 1
    x = (x ^ x >> 29) * 0xBF58476D1CE4E5B9 & (1 << 64) - 1
    return (x ^ x >> 32) * 0x94D049BB133111EB >> 24 & BINS - 1


def shingle_hashes(text: Column, width: int = 5) -> Column:
    """Hashes of the shingles of width words; of all words together if there are fewer, none if there are none."""
    hashed = F.transform(words(text), lambda w: F.xxhash64(w))

    def roll(h: Column) -> Column:
        whole = F.array(F.xxhash64(h))
        each = F.transform(F.sequence(F.lit(0), F.size(h) - width), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(width)]))
        return F.when(F.size(h) == 0, F.array().cast("array<bigint>")).when(F.size(h) < width, whole).otherwise(each)

    return _let(hashed, roll)


def signature(text: Column, width: int = 5) -> Column:
    """array<int> of BINS values of BITS bits, or an empty array for a text without words.

    Every shingle is hashed once and falls in the bin of its top byte; a bin keeps the low bits of its least
    hash. One sentinel above all others in each bin makes the list of minima complete, so that what an empty bin
    shows is its sentinel. An empty bin takes the value of the first filled bin in its own fixed random order of
    bins (optimal densification)."""
    low = (1 << 56) - 1
    sentinels = F.array(*[F.lit((b - 128) << 56 | low) for b in range(BINS)])
    bin_of = lambda x: F.shiftright(x, 56)
    first = lambda s: F.filter(s, lambda x, i: (i == 0) | (bin_of(x) != bin_of(F.get(s, i - 1))))
    # remixed before its low bits are taken: as a minimum the hash itself is small
    shown = lambda x: F.when(x.bitwiseAND(F.lit(low)) != low, F.xxhash64(x).bitwiseAND(F.lit((1 << BITS) - 1)).cast("int"))
    orders = [F.array(*[F.lit(_probe(b, k)) for b in range(BINS)]) for k in range(PROBES)]

    def dense(bins: Column) -> Column:
        filled = F.filter(F.transform(bins, lambda v, b: F.when(v.isNotNull(), F.struct(b.alias("b"), v.alias("v")))), lambda s: s.isNotNull())

        def fill(full: Column) -> Column:
            last = lambda b: F.array_min(F.transform(full, lambda s: F.struct(F.xxhash64(b, s["b"]).alias("o"), s["v"].alias("v"))))["v"]
            return F.transform(bins, lambda v, b: F.coalesce(v, *[F.get(bins, F.get(o, b)) for o in orders], last(b)))

        return _let(filled, fill)

    made = lambda h: _let(F.transform(_let(F.sort_array(F.concat(h, sentinels)), first), shown), dense)
    return _let(shingle_hashes(text, width), lambda h: F.when(F.size(h) == 0, F.array().cast("array<int>")).otherwise(made(h)))


def packed(sig: Column) -> Column:
    """The signature as hexadecimal digits, BITS bits each."""
    return F.array_join(F.transform(sig, lambda v: F.lower(F.hex(v))), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated resemblance, 0 to 1: the share of equal values, less what BITS bits let agree by chance. Two
    texts without words are alike (1); one without words is unlike any other (0)."""
    chance = 1.0 / (1 << BITS)
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e)) / F.lit(float(BINS))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.greatest(F.lit(0.0), (same - chance) / (1 - chance)))


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5) -> DataFrame:
    """One row per row of df: id_col, fingerprint (packed hexadecimal digits; empty for a text without words) and
    signature (the same as an array, for likeness). Null texts count as empty."""
    return df.select(F.col(id_col), signature(F.coalesce(F.col(text_col), F.lit("")), width).alias("signature")).withColumn("fingerprint", packed(F.col("signature")))


def with_next(df: DataFrame, id_col: str, carried: list[str]) -> DataFrame:
    """df (id_col and carried) with next_<c> for each carried column: that of the next row in descending id_col,
    and for the last row that of the first. Rows with equal ids stand in order of their carried columns' hash;
    null ids come last.

    No single task sees all rows: ids fall into buckets between approximate quantiles, and the first row of each
    bucket is also sent, as a ghost, to the end of the bucket above (the very first one to the end of the last).
    There are MOST_BUCKETS buckets at most, which bounds what is broadcast."""
    ids = df.select(F.col(id_col).cast("double").alias("x"))
    n = ids.count()
    buckets = max(1, min(MOST_BUCKETS, n // NEIGHBOUR_ROWS))
    cuts = ids.agg(F.percentile_approx("x", [(i + 1) / (buckets + 1) for i in range(buckets)], max(10_000, 20 * buckets))).first()[0] or []
    splits = [float("-inf"), *sorted({c for c in cuts if c is not None} or {0.0}), float("inf")]
    own = Bucketizer(splits=splits, inputCol="_x", outputCol="_b", handleInvalid="keep")
    dealt = own.transform(df.withColumn("_x", F.col(id_col).cast("double"))).withColumn("_b", F.when(F.col("_x").isNull(), -1).otherwise(F.col("_b").cast("int")))
    at = own.transform(df.select(F.col(id_col).alias("_id"), F.col(id_col).cast("double").alias("_x"))).withColumn("_b", F.when(F.col("_x").isNull(), -1).otherwise(F.col("_b").cast("int")))
    # a row per bucket: its first id, and the bucket above it that is not empty
    firsts = at.groupBy("_b").agg(F.max("_id").alias("_id"))
    around = W.orderBy("_b").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    firsts = firsts.select(F.col("_b").alias("_fb"), F.col("_id").alias("_fid"), F.coalesce(F.lead("_b").over(W.orderBy("_b")), F.first("_b").over(around)).alias("_to"))
    joined = dealt.join(F.broadcast(firsts), (F.col("_b") == F.col("_fb")) & F.col(id_col).eqNullSafe(F.col("_fid")), "left")
    both = F.when(F.col("_fb").isNull(), F.array(F.struct(F.col("_b").alias("b"), F.lit(False).alias("g")))).otherwise(F.array(F.struct(F.col("_b").alias("b"), F.lit(False).alias("g")), F.struct(F.col("_to").alias("b"), F.lit(True).alias("g"))))
    rows = joined.select(id_col, *carried, F.explode(both).alias("_p")).select(id_col, *carried, F.col("_p.b").alias("_b"), F.col("_p.g").alias("_g"))
    order = W.partitionBy("_b").orderBy(F.col("_g"), F.col(id_col).desc_nulls_last(), F.xxhash64(*carried))
    return rows.select(id_col, *carried, *[F.lead(c).over(order).alias(f"next_{c}") for c in carried], "_g").filter(~F.col("_g")).drop("_g")


def edited_likeness(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5) -> DataFrame:
    """One row per row of df: id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next. The edited text is the text with its last floor(n_chars / 3) characters replaced by the first as
    many (or all) of the next document in descending id_col; a document alone is its own next. ids must be
    numbers. Null texts count as empty; an empty table gives an empty result."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = df.select(F.col(id_col).alias("id"), text.alias("t")).withColumn("sig", signature(F.col("t"), width))
    rows = with_next(base, "id", ["t", "sig"])
    n = F.char_length("t")
    k = F.floor(n / 3).cast("int")
    rows = rows.withColumn("n", n).withColumn("edited", F.concat(F.substring(F.col("t"), F.lit(1), n - k), F.substring(F.col("next_t"), F.lit(1), k)))
    rows = rows.withColumn("esig", signature(F.col("edited"), width))
    return rows.select(
        F.col("id").alias(id_col), F.col("n").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        packed(F.col("sig")).alias("fingerprint"), packed(F.col("esig")).alias("edited_fingerprint"),
        likeness(F.col("sig"), F.col("esig")).alias("near_edited"), likeness(F.col("sig"), F.col("next_sig")).alias("near_next"),
    )
