"""Which invoices an amount pays: one invoice, or a sum of a few.

Both answers depend on the client and the amount only, so they are computed once per distinct
(client, amount) and joined back to the payments.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paidup.config import MatchSettings
from paidup.functions.money import cents
from paidup.skew import lookup, short_lists

_KEY = ["client_norm", "cents"]


def priced_items(open_items: DataFrame) -> DataFrame:
    """The columns of the receivables that matching reads."""
    return open_items.select("client_norm", "item_ord", "document", cents(F.col("open_amount")).alias("cents"))


# --- exact ------------------------------------------------------------------------------------


def price_levels(items: DataFrame) -> DataFrame:
    """Invoices of a client collapsed per amount: how many, and the first of them."""
    return items.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("n_rows"), F.min(F.struct("item_ord", "document")).alias("first"))


def band_start(value: Column, tolerance: int) -> Column:
    """Lower end of the amount band of a value in cents; a tolerance window meets two bands at most."""
    return value - F.pmod(value, F.lit(2 * tolerance + 1))


def bands_near(value: Column, tolerance: int) -> Column:
    """The bands that amounts within the tolerance of a value can lie in."""
    return F.sequence(
        band_start(value - tolerance, tolerance),
        band_start(value + tolerance, tolerance),
        F.lit(2 * tolerance + 1).cast("long"),
    )


def exact_hits(queries: DataFrame, levels: DataFrame, settings: MatchSettings) -> DataFrame:
    """(client_norm, cents) -> ``n_exact`` invoices within the tolerance; ``exact`` lists the document if it is one.

    A band join under the client. A band holds at most ``2 * tolerance + 1`` different amounts in
    whole cents, so the work per query is bounded however many invoices share an amount. Several
    invoices are rows of ``candidates.candidate_sets``.
    """
    tol = settings.tolerance_cents
    probes = queries.select(*_KEY, F.explode(bands_near(F.col("cents"), tol)).alias("band"))
    priced = levels.select(
        "client_norm",
        F.col("cents").alias("level"),
        "n_rows",
        "first",
        band_start(F.col("cents"), tol).alias("band"),
    )
    near = probes.join(priced, ["client_norm", "band"]).filter(F.abs(F.col("level") - F.col("cents")) <= tol)
    return (
        near.groupBy(*_KEY)
        .agg(F.sum("n_rows").alias("n_exact"), F.min("first").alias("first"))
        .select(*_KEY, "n_exact", F.when(F.col("n_exact") == 1, F.array("first.document")).alias("exact"))
    )


# --- sums -------------------------------------------------------------------------------------


def client_profiles(items: DataFrame, settings: MatchSettings) -> DataFrame:
    """client_norm -> ``n_items`` and, for clients whose sums are searched, the ordered ``items``.

    One more item than ``settings.max_items_for_sums`` is enough to know that a client is beyond it, so
    ``n_items`` stops counting there and no client is gathered whole.
    """
    cap = settings.max_items_for_sums
    entry = F.struct("item_ord", "document", "cents")
    n = F.size("entries")
    return short_lists(items, ["client_norm"], "item_ord", entry, cap + 1).select(
        "client_norm", n.alias("n_items"), F.when(n <= cap, F.col("entries")).alias("items")
    )


def within_sum_cap(settings: MatchSettings) -> Column:
    return F.col("n_items").between(2, settings.max_items_for_sums)


def combination_shapes(spark: SparkSession, settings: MatchSettings) -> DataFrame:
    """All choices of 2..k positions out of n items, ranked by size and then by position.

    Fixed by the settings (6,748 rows with the defaults), independent of the data. Positions count
    from 1; position 0 stands for "no further item".
    """
    rows = []
    for n in range(2, settings.max_items_for_sums + 1):
        rank = 0
        for k in range(2, min(settings.max_combination, n) + 1):
            for chosen in combinations(range(1, n + 1), k):
                rows.append((n, rank, k, *chosen, *[0] * (settings.max_combination - k)))
                rank += 1
    positions = ", ".join(f"{p} int" for p in _positions(settings))
    return spark.createDataFrame(rows, f"n_items int, rank int, k int, {positions}", verifySchema=False)


def _positions(settings: MatchSettings) -> list[str]:
    return [f"p{i}" for i in range(settings.max_combination)]


def _with_prices(profiles: DataFrame) -> DataFrame:
    """Add ``prices``: the amounts by position, slot 0 being zero."""
    amounts = F.transform("items", lambda i: i["cents"])
    return profiles.withColumn("prices", F.concat(F.array(F.lit(0).cast("long")), amounts))


def _total(settings: MatchSettings) -> Column:
    return sum((F.get("prices", F.col(p)) for p in _positions(settings)[1:]), F.get("prices", F.col("p0")))


def _documents(settings: MatchSettings) -> Column:
    chosen = [F.get("items", F.col(p) - 1)["document"] for p in _positions(settings)]
    return F.slice(F.array(*chosen), F.lit(1), F.col("k"))


def combinations_of(profiles: DataFrame, settings: MatchSettings = MatchSettings()) -> DataFrame:
    """Every candidate sum of every client within the cap: client_norm, k, documents, total cents."""
    shapes = combination_shapes(profiles.sparkSession, settings)
    priced = _with_prices(profiles.filter(within_sum_cap(settings)))
    return priced.join(F.broadcast(shapes), "n_items").select(
        "client_norm", "k", "rank", _documents(settings).alias("documents"), _total(settings).alias("cents")
    )


def with_sum_hits(queries: DataFrame, settings: MatchSettings) -> DataFrame:
    """Add ``n_sums`` and ``first_sum`` to (client_norm, cents, n_items, items, n_exact, exact).

    Positions are expanded next to the client's (at most 15) items and checked inside the join with
    the fixed shapes, so combinations are never written or shuffled: only those that fit the amount
    leave it. Queries with an exact hit meet no shape.
    """
    shapes = combination_shapes(queries.sparkSession, settings).withColumnRenamed("n_items", "size")
    searched = F.when(within_sum_cap(settings) & F.col("n_exact").isNull(), F.col("n_items"))
    fits = F.abs(_total(settings) - F.col("cents")) <= settings.tolerance_cents
    return (
        _with_prices(queries)
        .withColumn("searched", searched)
        .join(F.broadcast(shapes), (F.col("searched") == F.col("size")) & fits, "left")
        .select(*_KEY, "n_items", "n_exact", "exact", "rank", _documents(settings).alias("documents"))
        .groupBy(*_KEY)
        .agg(
            F.any_value("n_items").alias("n_items"),
            F.any_value("n_exact").alias("n_exact"),
            F.any_value("exact").alias("exact"),
            F.count("rank").alias("n_sums"),
            F.min_by("documents", "rank").alias("first_sum"),
        )
        .withColumn("n_sums", F.nullif("n_sums", F.lit(0)))
    )


def resolve_amounts(
    queries: DataFrame,
    items: DataFrame,
    profiles: DataFrame,
    settings: MatchSettings = MatchSettings(),
    hot_query_clients=(),
) -> DataFrame:
    """Distinct (client_norm, cents) -> n_items, n_exact, exact, n_sums, first_sum.

    ``n_items`` is null for a client without open invoices, ``n_sums`` when no sum fits or an
    invoice fits exactly.
    """
    known = lookup(queries, profiles, ["client_norm"], "left", hot_query_clients, ["cents"])
    return with_sum_hits(known.join(exact_hits(queries, price_levels(items), settings), _KEY, "left"), settings)
