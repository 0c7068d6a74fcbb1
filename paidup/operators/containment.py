"""Which of many needles occur inside which of many texts, without comparing all pairs.

A containment predicate has no equi key, so a plain join would compare every text with every
needle. Instead each text lists the substrings of itself that could be a needle, and those meet the
needles in an ordinary equi-join that is exact.

To keep the list of substrings short, the needles are summarised twice. The *signature* has, for the
hash bucket of the first characters, a 64-bit mask of the needle lengths found there: a position of
a text is followed up only for those lengths. The *bitmap* has one bit per hash of a whole needle, 64
to a row: a substring is listed only when its bit is set. Both tables have a largest number of rows
whatever the number of needles (``len(_PREFIXES) * _BUCKETS`` and ``_WORDS``), which is what makes
broadcasting them safe. Hashes may collide; the final join decides, so collisions cost time and
never change results.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Prefix length -> longest needle it stands for (None = any length). Short needles are their
# own prefix, so needles of one to three characters take the same path.
_PREFIXES = {1: 1, 2: 2, 3: 3, 4: 7, 8: None}
_BUCKETS = 1 << 18
_WORDS = 1 << 20


def prefix_length(needle: Column) -> Column:
    n = F.length(needle)
    return F.when(n >= 8, F.lit(8)).when(n >= 4, F.lit(4)).otherwise(n)


def _bucket(prefix: Column, length: Column) -> Column:
    return F.pmod(F.xxhash64(prefix), F.lit(_BUCKETS)) * 16 + length


def _signatures(needles: DataFrame, needle: str) -> DataFrame:
    plen = prefix_length(F.col(needle))
    return (
        needles.select(
            _bucket(F.left(needle, plen), plen).alias("bucket"),
            ((F.length(needle) - plen) % 64).cast("int").alias("bit"),
        )
        .groupBy("bucket")
        .agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("lengths"))
    )


def _word(needle: Column) -> Column:
    return F.pmod(F.shiftright(F.xxhash64(needle), 6), F.lit(_WORDS))


def _bit(needle: Column) -> Column:
    return F.pmod(F.xxhash64(needle), F.lit(64)).cast("int")


def _bitmap(needles: DataFrame, needle: str) -> DataFrame:
    return (
        needles.select(_word(F.col(needle)).alias("word"), _bit(F.col(needle)).alias("bit"))
        .groupBy("word")
        .agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))
    )


def prefix_lengths_present(needles: DataFrame, needle: str) -> list[int]:
    """The (at most five) prefix classes in use, so that texts probe no others."""
    rows = needles.select(prefix_length(F.col(needle)).alias("p")).distinct().collect()
    return sorted(r["p"] for r in rows if r["p"] in _PREFIXES)


def candidate_substrings(
    texts: DataFrame, keys: Sequence[str], text: str, needles: DataFrame, needle: str
) -> DataFrame:
    """``keys`` and every substring of ``text`` that may equal a needle, as column ``needle``.

    Runs map-side: positions of a text are exploded, probed against the broadcast signatures, cut
    to the lengths that the signature allows, and the substrings probed against the bitmap.
    """
    present = prefix_lengths_present(needles, needle)
    if not present:
        return texts.select(*keys, F.lit(None).cast("string").alias(needle)).limit(0)
    probes = (
        texts.filter(F.length(text) > 0)
        .select(*keys, F.col(text).alias("__text"), F.explode(F.sequence(F.lit(1), F.length(text))).alias("pos"))
        .withColumn("plen", F.explode(F.array(*[F.lit(p) for p in present])))
    )
    last = F.length("__text") - F.col("pos") + 1
    probes = probes.filter(F.col("plen") <= last).withColumn(
        "bucket", _bucket(F.substring("__text", F.col("pos"), F.col("plen")), F.col("plen"))
    )
    longest = F.when(F.col("plen") == 8, last)
    for plen, limit in _PREFIXES.items():
        if limit is not None:
            longest = longest.when(F.col("plen") == plen, F.least(last, F.lit(limit)))
    lengths = F.filter(
        F.sequence(F.col("plen"), longest),
        lambda n: F.getbit(F.col("lengths"), ((n - F.col("plen")) % 64).cast("int")) == 1,
    )
    listed = (
        probes.join(F.broadcast(_signatures(needles, needle)), "bucket")
        .select(*keys, "__text", "pos", F.explode(lengths).alias("len"))
        .select(*keys, F.substring("__text", F.col("pos"), F.col("len")).alias(needle))
    )
    return (
        listed.withColumn("word", _word(F.col(needle)))
        .join(F.broadcast(_bitmap(needles, needle)), "word")
        .filter(F.getbit(F.col("bits"), _bit(F.col(needle))) == 1)
        .select(*keys, needle)
    )
