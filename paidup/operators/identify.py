"""Who paid: client identification by alias, then by client name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paidup.functions.text import normal, words
from paidup.operators.containment import candidate_substrings
from paidup.skew import hot_keys, lookup
from paidup.workspace import Workspace

ALIAS, DIRECT = "alias", "directo"
_SHORTEST_WORD = 4


def alias_catalogue(aliases: DataFrame) -> DataFrame:
    """Normalised aliases: a later duplicate replaces the client but keeps the first position."""
    return (
        aliases.select(normal(F.col("alias")).alias("alias"), normal(F.col("real_client")).alias("real_client"), "alias_ord")
        .filter((F.col("alias") != "") & (F.col("real_client") != ""))
        .groupBy("alias")
        .agg(F.max_by("real_client", "alias_ord").alias("real_client"), F.min("alias_ord").alias("alias_ord"))
    )


def client_directory(open_items: DataFrame) -> DataFrame:
    """Distinct clients in order of first appearance."""
    return open_items.groupBy("client_norm").agg(F.min("item_ord").alias("client_ord"))


def client_needles(clients: DataFrame) -> DataFrame:
    """Texts that point to a client: the full name and its longer words."""
    long_words = F.filter(words(F.col("client_norm")), lambda w: F.length(w) >= _SHORTEST_WORD)
    return clients.select(
        "client_norm", "client_ord", F.explode(F.array_union(F.array("client_norm"), long_words)).alias("needle")
    ).filter(F.col("needle") != "")


def needle_table(aliases: DataFrame, clients: DataFrame) -> DataFrame:
    """One owner per needle text. Aliases go before clients, then the smaller ordinal wins;
    any other owner of the same text could never be the answer."""

    alias_order = aliases.schema["alias_ord"].dataType
    catalogue = alias_catalogue(aliases)
    from_alias = catalogue.select(
        F.col("alias").alias("needle"),
        F.struct(
            F.lit(0).alias("method_rank"),
            F.col("alias_ord"),
            F.lit(None).cast("long").alias("client_ord"),
            F.col("real_client").alias("client"),
            F.lit(ALIAS).alias("client_method"),
        ).alias("owner"),
    )
    from_client = client_needles(clients).select(
        "needle",
        F.struct(
            F.lit(1).alias("method_rank"),
            F.lit(None).cast(alias_order).alias("alias_ord"),
            F.col("client_ord").cast("long").alias("client_ord"),
            F.col("client_norm").alias("client"),
            F.lit(DIRECT).alias("client_method"),
        ).alias("owner"),
    )
    return from_alias.unionByName(from_client).groupBy("needle").agg(F.min("owner").alias("owner"))


def identify_texts(texts: DataFrame, needles: DataFrame, ws: Workspace) -> DataFrame:
    """``description`` -> ``client``, ``client_method`` for the descriptions that name somebody.

    ``needles`` should be a stage table; ``texts`` has distinct descriptions.
    """
    candidates = candidate_substrings(texts, ["description"], "description", needles, "needle")
    candidates = ws.stage(candidates, "candidates")
    (hot,) = hot_keys(candidates, ["needle"])
    owners = lookup(candidates, needles, ["needle"], "inner", hot, ["description"])
    return (
        owners.groupBy("description")
        .agg(F.min("owner").alias("owner"))
        .select("description", F.col("owner.client").alias("client"), F.col("owner.client_method").alias("client_method"))
    )


def identify(
    payments: DataFrame, aliases: DataFrame, open_items: DataFrame, ws: Workspace, hot_descriptions=()
) -> DataFrame:
    """Add ``client`` and ``client_method`` (null when nobody is recognised).

    Works on distinct descriptions, so copies of a text are resolved once.
    """
    needles = ws.stage(needle_table(aliases, client_directory(open_items)), "needles")
    texts = payments.select(F.coalesce("description", F.lit("")).alias("description")).distinct()
    owners = identify_texts(texts, needles, ws)
    return lookup(payments, owners, ["description"], "left", hot_descriptions, ["payment_id"])
