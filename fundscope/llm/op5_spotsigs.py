"""SpotSigs fingerprints, in DataFrame functions only.

A spot signature is an anchor, i.e. a very common word, with the chain of the next
``CHAIN`` content words after it.  Boilerplate of lists and menus has few anchors, running text has
many.  A text's fingerprint is the sorted set of its signatures' 32-bit hashes in hexadecimal, so
equal texts have equal fingerprints and likeness is the Jaccard similarity of two sets.  A text without
any spot uses every word as an anchor; one with fewer words than a chain needs is one signature.

``near_duplicates`` joins fingerprints: sets are partitioned by length so that sets that can
reach the threshold share a partition, hashes are looked up by the part of a set that cannot be
missed, and pairs are pruned by their lengths before their sets are compared.

``with_next`` gives every document the one that follows it in descending id order.  Ids are cut
into buckets at quantiles of the ids, looked up in the row; every bucket's greatest row is also sent to the
next bucket as a guest.  No task holds more than a bucket, and texts are shuffled once.

Nulls: a null text is empty; its fingerprint is the empty string.  A null id comes last.  Two
empty sets have likeness 1, an empty and another set 0.  Repeated ids are ordered by text.  A single
document is its own next one.  Empty input gives no rows; extra columns pass through.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

NAME = "op5_spotsigs"
CHAIN = 2
#: Rows of one bucket of neighbouring ids, about, and the most buckets (their table is broadcast).
BUCKET_ROWS, MOST_BUCKETS = 512, 1 << 16

# Common words of English, German, French and Spanish.
ANCHORS = """a an and are as at be by for from in is it of on or that the this to was were with
au auf aus aux avec das de del dem den der des die du ein eine el en er es est et für ich il im ist la las le les los mit ne
nicht ou pas pour por que qui se sich sie sur un una und une von y zu""".split()
_SPOT = "\u0001"


def with_spots(df: DataFrame, text_col: str, out: str) -> DataFrame:
    """Add ``out``: the distinct 32-bit hashes of the text's spot signatures, sorted."""
    words = F.filter(F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    marked = F.array_join(F.transform(words, lambda w: F.when(w.isin(ANCHORS), F.concat(F.lit(_SPOT), w)).otherwise(w)), " ")
    # an anchor, then content words with any anchors between them; what is matched is the anchor's mark alone
    spot = rf"(?=({_SPOT}[^ ]+(?:(?: {_SPOT}[^ ]+)*+ [^{_SPOT} ]+){{{CHAIN}}})){_SPOT}"
    any_word = rf"(?:^|(?<= ))(?=([^ ]+(?: [^ ]+){{{CHAIN}}}))"
    plain = F.translate("_marked", _SPOT, "")
    short = F.when(plain == "", F.array().cast("array<string>")).otherwise(F.array(plain))
    rows = (df.withColumn("_marked", marked).withColumn("_spots", F.regexp_extract_all("_marked", F.lit(spot), F.lit(1)))
            .withColumn("_spots", F.when(F.size("_spots") > 0, F.col("_spots"))
                        .otherwise(F.regexp_extract_all(plain, F.lit(any_word), F.lit(1))))
            .withColumn("_spots", F.when(F.size("_spots") > 0, F.col("_spots")).otherwise(short)))
    # anchors inside a chain are no part of its signature
    hashed = F.transform("_spots", lambda s: F.xxhash64(F.regexp_replace(s, f" {_SPOT}[^ ]+", "")).bitwiseAND(F.lit(0xFFFFFFFF)))
    return rows.withColumn(out, F.array_sort(F.array_distinct(hashed))).drop("_marked", "_spots")


def fingerprint(spot_set: Column) -> Column:
    """Eight hexadecimal digits per hash."""
    return F.array_join(F.transform(spot_set, lambda h: F.lpad(F.hex(h), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two sets; sets whose lengths allow none are not compared."""
    common = F.size(F.array_intersect(a, b))
    return (F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).when(F.least(F.size(a), F.size(b)) == 0, F.lit(0.0))
            .otherwise(common / (F.size(a) + F.size(b) - common))).cast("double")


def near_duplicates(sets: DataFrame, id_col: str, set_col: str, threshold: float = 0.8) -> DataFrame:
    """Pairs (a, b, likeness), a < b, of representatives of equal sets with likeness >= threshold.

    Equal sets give one representative, the least id.  Lengths are partitioned by powers of
    1 / threshold; a set is entered in its own partition and looked up there and in the next lower
    one.  Among linked sets, the ``n - ceil(threshold * n) + 1`` least hashes of both must meet.
    """
    n = F.size("s")
    one = sets.select(F.col(id_col).alias("id"), F.col(set_col).alias("s")).filter(n > 0).groupBy("s").agg(F.min("id").alias("id"))
    length = F.floor(F.log(n.cast("double")) / F.lit(-1.0) / F.log(F.lit(threshold)) + 1e-9).cast("int")
    head = one.select("id", "s", n.alias("n"), length.alias("part"),
                      F.explode(F.slice("s", F.lit(1), (n - F.ceil(n * F.lit(threshold) - 1e-9) + 1).cast("int"))).alias("h"))
    mine = head.select("id", "n", "part", "h")
    asks = mine.select("id", "n", F.explode(F.array("part", F.col("part") - 1)).alias("part"), "h")
    a, b = asks.alias("a"), mine.alias("b")
    pairs = (a.join(b, (F.col("a.h") == F.col("b.h")) & (F.col("a.part") == F.col("b.part")) & (F.col("b.n") >= F.col("a.n") * threshold - 1e-9)
                    & (F.col("b.n") <= F.col("a.n")) & (F.col("a.id") != F.col("b.id")))
             .select(F.least("a.id", "b.id").alias("a"), F.greatest("a.id", "b.id").alias("b")).distinct())
    left, right = one.select(F.col("id").alias("a"), F.col("s").alias("_sa")), one.select(F.col("id").alias("b"), F.col("s").alias("_sb"))
    found = pairs.join(left, "a").join(right, "b").withColumn("likeness", likeness(F.col("_sa"), F.col("_sb")))
    return found.filter(F.col("likeness") >= threshold - 1e-9).select("a", "b", "likeness")


def _bucket(key: Column, cuts: list[int]) -> Column:
    """How many of the sorted cuts (2^k - 1 of them) are at most the key, by halving steps in the row."""
    values = F.split(F.lit(",".join(map(str, cuts))), ",").cast("array<bigint>")
    steps = [(len(cuts) + 1) >> i for i in range(1, (len(cuts) + 1).bit_length())]
    steps = F.array(*[F.lit(s) for s in steps])
    return F.aggregate(steps, F.lit(0), lambda b, s: F.when(key >= F.element_at(values, b + s), b + s).otherwise(b))


def with_next(docs: DataFrame, id_col: str, text_col: str, carried: list[str],
              prepare: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """Add ``next_<name>`` for every carried column, from the next document in descending id order.

    ``prepare`` may add columns to carry; it is applied where the rows of a bucket already are, so
    what it adds is not shuffled.
    """
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)))
    ids = docs.select(key.alias("k"))
    n = ids.count()
    if not n:
        return prepare(docs).select("*", *[F.col(name).alias(f"next_{name}") for name in carried])
    many = 1 << max(0, min(MOST_BUCKETS, -(-n // BUCKET_ROWS)).bit_length() - 1)
    bucket = F.lit(0)
    if many > 1:
        shares = [i / many for i in range(1, many)]
        cuts = ids.agg(F.percentile_approx("k", F.array(*[F.lit(s) for s in shares]), F.lit(max(10_000, 4 * many)))).first()[0]
        bucket = _bucket(F.col("_k"), cuts)
    # the buckets' greatest ids and the bucket that follows each one, the first after the last: at most MOST_BUCKETS rows
    greatest = (ids.withColumnRenamed("k", "_k").groupBy(bucket.alias("_at")).agg(F.max("_k").alias("_greatest")).sort("_at").collect())
    order = [r["_at"] for r in greatest]
    edges = docs.sparkSession.createDataFrame(
        [(r["_at"], r["_greatest"], order[(i + 1) % len(order)]) for i, r in enumerate(greatest)], "_at int, _greatest long, _after int")
    rows = docs.withColumn("_k", key).withColumn("_b", bucket).join(F.broadcast(edges), F.col("_b") == F.col("_at"))
    own = F.struct(F.col("_b").alias("bucket"), F.lit(1).alias("rank"))
    guest = F.struct(F.col("_after").alias("bucket"), F.lit(0).alias("rank"))
    rows = (rows.withColumn("_to", F.explode(F.when(F.col("_k") == F.col("_greatest"), F.array(own, guest)).otherwise(F.array(own))))
            .withColumn("_bucket", F.col("_to.bucket")).withColumn("_rank", F.col("_to.rank"))
            .drop("_to", "_b", "_at", "_greatest", "_after").repartition("_bucket"))
    rows = prepare(rows)
    order = Window.partitionBy("_bucket").orderBy("_rank", "_k", F.col(text_col).asc_nulls_first())
    for name in carried:
        rows = rows.withColumn(f"next_{name}", F.lag(name).over(order))
    return rows.filter(F.col("_rank") == 1).drop("_bucket", "_rank", "_k")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = with_next(docs, "doc_id", "text", ["text", "spots"], lambda df: with_spots(df, "text", "spots"))
    rows = rows.withColumn("n_chars", F.length("text").cast("long")).withColumn("_cut", F.floor(F.col("n_chars") / 3).cast("int"))
    kept = F.substring(F.col("text"), F.lit(1), (F.col("n_chars") - F.col("_cut")).cast("int"))
    rows = rows.withColumn("edited", F.concat(kept, F.substring(F.col("next_text"), F.lit(1), F.col("_cut"))))
    rows = with_spots(rows, "edited", "edited_spots")
    return rows.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
                       fingerprint(F.col("spots")).alias("fingerprint"), fingerprint(F.col("edited_spots")).alias("edited_fingerprint"),
                       likeness(F.col("spots"), F.col("edited_spots")).alias("near_edited"),
                       likeness(F.col("spots"), F.col("next_spots")).alias("near_next"))


SQL = None
