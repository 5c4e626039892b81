"""Document fingerprints as threshold-scaled sketches, in DataFrame operations only.

A text's sketch keeps every distinct shingle hash (five words) below a fixed fraction of the hash
range. As all sketches share the threshold, the sketch of a union is the union of the sketches and
containment can be estimated between texts of very unequal length. A text of at most FEW shingles,
WHOLE of them distinct, keeps them all, as too few would lie below the threshold: two such texts are
compared exactly, and with any longer text by what lies below the threshold. A fingerprint is a
string: the 16 hex digits of a digest of all shingles, `=` where all hashes are kept or `~`, then 10
hex digits for each kept hash, ascending.

Defined results: a null text counts as empty; a text without words has the fingerprint of sixteen
zeros and `=`; fewer words than five make one shingle; a text of any length is read whole. Where
neither sketch of two kept a hash, likeness is 1 if their digests agree and else 0. Rows with equal
doc_id stand in the order of their texts. Repeated rows count one by one; an empty table gives an
empty result; columns named like the results are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from unspool.llm.common import SPACE_CHARS, lower_ascii, shuffle_partitions

WIDTH = 5
#: Bits of a hash, and the share of the range that a sketch keeps: one of 2**SCALE_BITS.
HASH_BITS, SCALE_BITS = 40, 2
#: Shingles and distinct shingles up to which a sketch keeps all hashes.
FEW, WHOLE = 1024, 128
#: Bytes of text for which a bucket of neighbouring ids is made, and the most buckets.
BUCKET_BYTES, MOST_BUCKETS = 1 << 20, 1 << 16


def _let(value: Column, use) -> Column:
    """use(value) with value worked out once a row, also inside of what repeats it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def words_of(text: Column) -> Column:
    return F.filter(F.split(lower_ascii(F.coalesce(text, F.lit(""))), f"[{SPACE_CHARS}]+"), lambda w: w != "")


def shingle_hashes(text: Column, width: int = WIDTH) -> Column:
    """All shingle hashes of a text in order, repeats included."""

    def of(words: Column) -> Column:
        n = F.size(words)
        runs = F.transform(F.sequence(F.lit(0), n - width), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(width)]))
        return F.when(n >= width, runs).when(n > 0, F.array(F.xxhash64(words))).otherwise(F.array().cast("array<bigint>"))

    return _let(words_of(text), of)


def sketch(text: Column, width: int = WIDTH, scale_bits: int = SCALE_BITS) -> Column:
    """struct(digest, whole, limit, kept): a digest of the shingles, whether all are kept, the threshold, and the kept hashes, ascending.

    The low HASH_BITS of a shingle's hash are its place in the range; those under the threshold stay.
    """
    mask, limit = (1 << HASH_BITS) - 1, 1 << (HASH_BITS - scale_bits)

    def of(hashes: Column) -> Column:
        low = lambda h: h.bitwiseAND(F.lit(mask))
        own = F.array_distinct(F.transform(F.filter(hashes, lambda h: (F.size(hashes) <= FEW) | (low(h) < limit)), low))

        def kept(own: Column) -> Column:
            whole = (F.size(hashes) <= FEW) & (F.size(own) <= WHOLE)
            hashes_kept = F.sort_array(F.when(whole | (F.size(hashes) > FEW), own).otherwise(F.filter(own, lambda h: h < limit)))
            return F.struct(F.when(F.size(hashes) > 0, F.xxhash64(hashes)).otherwise(F.lit(0)).alias("digest"), whole.alias("whole"), F.lit(limit).alias("limit"), hashes_kept.alias("kept"))

        return _let(own, kept)

    return _let(shingle_hashes(text, width), of)


def as_text(sketch: Column) -> Column:
    digits = HASH_BITS // 4
    head = F.concat(F.lpad(F.hex(sketch["digest"]), 16, "0"), F.when(sketch["whole"], "=").otherwise("~"))
    return F.concat(head, F.array_join(F.transform(sketch["kept"], lambda h: F.lpad(F.hex(h), digits, "0")), ""))


def _below(sketch: Column) -> Column:
    """The kept hashes below the threshold."""
    return F.when(sketch["whole"], F.filter(sketch["kept"], lambda h: h < sketch["limit"])).otherwise(sketch["kept"])


def _comparable(a: Column, b: Column, use) -> Column:
    """use(a's hashes, b's): all where both sketches keep all, else those below the threshold."""
    both = a["whole"] & b["whole"]
    return _let(F.struct(F.when(both, a["kept"]).otherwise(_below(a)).alias("a"), F.when(both, b["kept"]).otherwise(_below(b)).alias("b")), lambda x: use(x["a"], x["b"]))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two texts from their sketches: exact where both keep all hashes, else estimated."""

    def of(x: Column, y: Column) -> Column:
        return _let(F.size(F.array_intersect(x, y)), lambda n: F.when(F.size(x) + F.size(y) > 0, n / (F.size(x) + F.size(y) - n)).otherwise(0.0))

    return F.when(a["digest"] == b["digest"], 1.0).otherwise(_comparable(a, b, of))


def containment(a: Column, b: Column) -> Column:
    """Share of a's shingles that b has, also where b is far longer; null where a has none to go by."""
    return _comparable(a, b, lambda x, y: F.when(F.size(x) > 0, F.size(F.array_intersect(x, y)) / F.size(x)))


def merge(a: Column, b: Column) -> Column:
    """The kept hashes of two texts' union: all where both sketches keep all, else those below the threshold."""
    return _comparable(a, b, lambda x, y: F.sort_array(F.array_union(x, y)))


def _longs(values: list[int]) -> Column:
    """A literal array of any length as one expression."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>") if values else F.array().cast("array<bigint>")


def _place(cuts: list[int], value: Column) -> Column:
    """How many of the sorted cuts are at most value, by binary search."""
    if not cuts:
        return F.lit(0)
    array, steps = _longs(cuts), [1 << k for k in range(len(cuts).bit_length() - 1, -1, -1)]
    found = F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, step: F.when((at + step <= len(cuts)) & (F.get(array, at + step - 1) <= value), at + step).otherwise(at))
    return F.coalesce(found, F.lit(0))


def beside_next(docs: DataFrame, buckets: int = 0) -> tuple[DataFrame, W]:
    """Rows (doc_id, text, sent) and the window in whose order each row's successor by doc_id follows it.

    The successor of the last is the first. Ids are cut at quantiles into buckets that are sorted
    alone; the first row of each bucket is sent to the end of the one before too (sent = 1, to be
    dropped at the end), so no task sees all rows and each text is shuffled once.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    ids = docs.select("doc_id")
    if not buckets:
        size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("size")).first()["size"]
        buckets = min(MOST_BUCKETS, max(4 * shuffle_partitions(spark), -(-size // BUCKET_BYTES)))
    cuts = ids.agg(F.percentile_approx("doc_id", [k / buckets for k in range(1, buckets)] or [0.5], max(10_000, 10 * buckets)).alias("cuts")).first()["cuts"] or []
    cuts = sorted(set(cuts))
    # One row for each bucket reaches the driver, never one for each document.
    lowest = {r["bucket"]: r["lowest"] for r in ids.groupBy(_place(cuts, F.col("doc_id")).alias("bucket")).agg(F.min("doc_id").alias("lowest")).collect()}
    filled = sorted(lowest)
    lows, before = [0] * (len(cuts) + 1), [0] * (len(cuts) + 1)
    for k, b in enumerate(filled):
        lows[b], before[b] = lowest[b] if lowest[b] is not None else 0, filled[k - 1]
    rows = docs.withColumn("bucket", _place(cuts, F.col("doc_id")).cast("long"))
    # Where ids repeat, all rows of the lowest id are sent, and the first of them is the successor.
    is_low = F.col("doc_id").isNull() | (F.col("doc_id") == F.get(_longs(lows), F.col("bucket").cast("int")))
    own = F.struct(F.col("bucket").alias("bucket"), F.lit(0).alias("sent"))
    sent = F.struct(F.get(_longs(before), F.col("bucket").cast("int")).alias("bucket"), F.lit(1).alias("sent"))
    rows = rows.select("doc_id", "text", F.explode(F.when(is_low, F.array(own, sent)).otherwise(F.array(own))).alias("to")).select("doc_id", "text", "to.bucket", "to.sent")
    return rows, W.partitionBy("bucket").orderBy("sent", F.col("doc_id").asc_nulls_first(), "text")


def edited(text: Column, other: Column) -> Column:
    """text with its last floor(n/2) code points replaced by the first as many (or all) of other."""
    n = F.length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - half), F.substring(other, F.lit(1), half))


def fingerprints(docs: DataFrame) -> DataFrame:
    """For every row the fingerprints of its text and of its edited text, and their likenesses."""
    rows, order = beside_next(docs)
    # Sketches are made after the shuffle, in the same order, so that only texts travel.
    rows = rows.withColumn("next_text", F.lead("text").over(order)).withColumn("sketch", sketch(F.col("text")))
    rows = rows.withColumn("next_sketch", F.lead("sketch").over(order)).where("sent = 0")
    rows = rows.withColumn("edited", edited(F.col("text"), F.col("next_text")))
    rows = rows.withColumn("edited_sketch", sketch(F.col("edited")))
    return rows.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("sketch")).alias("fingerprint"),
        as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )
