"""Invoice numbers quoted in the payment text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paidup.skew import hot_keys, lookup
from paidup.workspace import Workspace

_KEY = ["client_norm", "document"]


def number_shapes(items: DataFrame) -> DataFrame:
    """client_norm -> ``shapes``: the lengths and first characters of its document numbers; ``firsts``: these characters.

    As many as there are lengths times characters in use, however many invoices a client has.
    """
    shape = F.struct(F.length("document").alias("size"), F.left("document", F.lit(1)).alias("first"))
    numbers = items.filter(F.length("document") > 0)
    return numbers.groupBy("client_norm").agg(
        F.collect_set(shape).alias("shapes"), F.collect_set(F.left("document", F.lit(1))).alias("firsts")
    )


def substrings_of_shapes(text: str, shapes: str, firsts: str):
    """The different substrings of ``text`` that have one of the shapes; one pass finds the places of the first characters."""
    places = F.filter(
        F.sequence(F.lit(1), F.length(text)), lambda p: F.array_contains(F.col(firsts), F.substring(text, p, F.lit(1)))
    )
    found = F.transform(
        places,
        lambda p: F.transform(
            F.filter(
                shapes,
                lambda s: (s["first"] == F.substring(text, p, F.lit(1))) & (s["size"] <= F.length(text) - p + 1),
            ),
            lambda s: F.substring(text, p, s["size"]),
        ),
    )
    return F.array_distinct(F.flatten(found))


def quoted_documents(
    payments: DataFrame, items: DataFrame, ws: Workspace, hot_payment_clients=()
) -> DataFrame:
    """payment_id -> ``n_quoted`` invoices of its client whose number occurs in the text, ``quoted``.

    ``payments``: payment_id, client_norm, description. The shapes of the client's numbers travel with the payment; the
    substrings that have such a shape meet the client's numbers in an equi-join, so a payment is never compared with all
    of them, and no filter of a fixed size is involved. ``quoted`` has each number once, by its first
    invoice; ``n_quoted`` counts all invoices that bear them.
    """
    texts = payments.select("payment_id", "client_norm", "description").filter(F.length("description") > 0)
    known = lookup(texts, number_shapes(items), ["client_norm"], "inner", hot_payment_clients, ["payment_id"])
    listed = known.select("payment_id", "client_norm", F.explode(substrings_of_shapes("description", "shapes", "firsts")).alias("document"))
    found = ws.stage(listed, "quoted")
    numbers = items.filter(F.length("document") > 0).groupBy(*_KEY).agg(F.count(F.lit(1)).alias("n_rows"), F.min("item_ord").alias("first"))
    (hot,) = hot_keys(found, _KEY)
    return (
        lookup(found, numbers, _KEY, "inner", hot, ["payment_id"])
        .groupBy("payment_id")
        .agg(F.sum("n_rows").alias("n_quoted"), F.sort_array(F.collect_list(F.struct("first", "document"))).alias("quoted"))
        .withColumn("quoted", F.transform("quoted", lambda q: q["document"]))
    )
