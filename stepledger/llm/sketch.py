"""Threshold-scaled sketches of documents, in built-in expressions alone.

A text's shingles are hashed to 64 bits and every hash below a fixed fraction of the range is
retained. The sketch of a union is the union of the sketches, and what a sketch holds of another estimates
how much one text contains of the other, however unequal they are. A text whose shingles all lie
above the threshold retains its lowest hash, so that only texts without words have an empty sketch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepledger.llm.common import fresh, whole, words

SHINGLE = 5  # words
FRACTION = 4  # one of so many hashes is retained


def _hashes(word_hashes: str, size: int) -> Column:
    """Hashes of the runs of ``size`` words; of all words where there are fewer. The column holds word hashes."""
    w = F.col(word_hashes)
    n = F.size(w)
    run = lambda x, i: F.xxhash64(x, *[F.get(w, i + k) for k in range(1, size)])
    return F.transform(F.slice(w, F.lit(1), F.when(n >= size, n - size + 1).when(n > 0, 1).otherwise(0)), run)


def _retained(hashes: Column, fraction: int) -> Column:
    """Distinct hashes in the lowest part of the signed range, or the lowest hash, sorted."""
    bar = F.lit(-(2**63) + 2**64 // fraction).cast("long")
    low = F.filter(hashes, lambda h: h < bar)
    lowest = F.when(F.size(hashes) > 0, F.array(F.array_min(hashes))).otherwise(F.array().cast("array<bigint>"))
    return F.sort_array(F.array_distinct(F.when(F.size(low) > 0, low).otherwise(lowest)))


def sketch(docs: DataFrame, text: str = "text", out: str = "sketch", size: int = SHINGLE, fraction: int = FRACTION):
    """``docs`` with the sorted array of retained hashes; empty for null texts and texts without words."""
    w, h = fresh(docs, "_hashed_words"), fresh(docs, "_hashed_runs")
    # Each step is a projection of its own: an array that a lambda looks into must be there already.
    return (
        docs.withColumn(w, F.transform(words(whole(F.col(text))), lambda x: F.xxhash64(x)))
        .withColumn(h, _hashes(w, size))
        .withColumn(out, _retained(F.col(h), fraction))
        .drop(w, h)
    )


def merge(a: Column, b: Column) -> Column:
    """The sketch of two texts together."""
    return F.sort_array(F.array_union(a, b))


def _common(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def contained(a: Column, b: Column) -> Column:
    """Estimated part of ``a``'s shingles that ``b`` has, 0 to 1; null if ``a`` has none."""
    return F.when(F.size(a) > 0, _common(a, b) / F.size(a)).cast("double")


def likeness(a: Column, b: Column) -> Column:
    """Estimated resemblance, 0 to 1: shared of all retained hashes. Two empty sketches are alike."""
    both = _common(a, b)
    every = F.size(a) + F.size(b) - both
    return F.when(every > 0, both / every).otherwise(1.0).cast("double")


def printed(sketch: Column) -> Column:
    """The sketch as text: its hashes in hexadecimal digits, joined by dots."""
    return F.array_join(F.transform(sketch, lambda h: F.lower(F.lpad(F.hex(h), 16, "0"))), ".")


def with_next(docs: DataFrame, doc_id: str, text: str, carried: list[str], out: str) -> DataFrame:
    """``docs`` with the struct ``out``: the ``carried`` columns of the next row by descending id, after the last row the first.

    Null ids come last, rows of one id by a hash of their text; rows with equal id and text stand for
    each other. The ids alone are range-partitioned first, to place the bars between bins; then the rows
    move once, each to its bin, and the first row of each bin also to the bin before it.
    """
    spark = docs.sparkSession
    tie, bin_ = (fresh(docs, n) for n in ("_tie", "_bin"))
    keyed = docs.withColumn(tie, F.xxhash64(F.col(text)))
    # Ascending in this key is descending in the id with nulls last.
    place = F.struct(F.col(doc_id).isNull().alias("absent"), (-F.col(doc_id)).alias("down"), F.col(tie).alias("tie"))
    places = keyed.select(place.alias("p"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    heads = (
        places.repartitionByRange(n, F.col("p"))
        .groupBy(F.spark_partition_id().alias("part"))
        .agg(F.min("p").alias("p"))
    )
    # One short row for each partition.
    firsts = sorted(
        ((r.p.absent, r.p.down, r.p.tie) for r in heads.collect()), key=lambda p: (p[0], p[1] or 0, p[2])
    )
    if not firsts:
        return docs.withColumn(out, F.struct(*[F.col(c) for c in carried]))
    kind = dict(places.select("p.*").dtypes)["down"]
    bars = [
        F.struct(F.lit(a).alias("absent"), F.lit(d).cast(kind).alias("down"), F.lit(t).cast("long").alias("tie"))
        for a, d, t in firsts
    ]
    bars_column = F.array(*bars)
    at = fresh(docs, "_place")
    # The bar at the first row itself counts, so bins are numbered from 0.
    own = F.size(F.filter(bars_column, lambda b: b <= F.col(at))) - 1
    binned = keyed.withColumn(at, place).withColumn(bin_, own)
    before = F.when(F.col(bin_) == 0, F.lit(len(firsts) - 1)).otherwise(F.col(bin_) - 1)
    is_head = F.array_contains(bars_column, F.col(at))
    visits = F.when(
        is_head, F.array(F.struct(F.col(bin_).alias("b"), F.lit(0).alias("g")), F.struct(before.alias("b"), F.lit(1).alias("g")))
    ).otherwise(F.array(F.struct(F.col(bin_).alias("b"), F.lit(0).alias("g"))))
    visit = fresh(docs, "_visit")
    spread = binned.withColumn(visit, F.explode(visits))
    w = Window.partitionBy(F.col(visit)["b"]).orderBy(F.col(visit)["g"], F.col(at))
    # The columns are led one by one: as a struct they would be moved twice.
    led = {fresh(docs, f"_next_{i}"): c for i, c in enumerate(carried)}
    return (
        spread.withColumns({name: F.lead(F.col(c)).over(w) for name, c in led.items()})
        .filter(F.col(visit)["g"] == 0)
        .withColumn(out, F.struct(*[F.col(name).alias(c) for name, c in led.items()]))
        .drop(visit, at, bin_, tie, *led)
    )


def edited(text: Column, follower: Column) -> Column:
    """The last third of the code points replaced by as many of the follower's first (or all it has)."""
    n = F.length(text)
    cut = F.floor(n / 3).cast("int")
    return F.concat(F.left(text, n - cut), F.left(follower, cut))


def report(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and its edited text, and how like the edited and the next text's are to it."""
    whole_docs = docs.select("doc_id", whole(F.col("text")).alias("text"))
    sketched = sketch(whole_docs)
    paired = with_next(sketched, "doc_id", "text", ["text", "sketch"], "next")
    made = paired.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), "sketch",
        F.col("next")["sketch"].alias("next_sketch"), edited(F.col("text"), F.col("next")["text"]).alias("edited"),
    )
    made = sketch(made, "edited", "edited_sketch")
    return made.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        printed(F.col("sketch")).alias("fingerprint"),
        printed(F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
        F.coalesce(contained(F.col("sketch"), F.col("edited_sketch")), F.lit(1.0)).alias("contained_edited"),
    )
