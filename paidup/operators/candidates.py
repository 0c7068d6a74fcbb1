"""Candidate invoices of ambiguous payments as relations, at any length.

A payment whose amount equals several invoices of its client names their set by (client, candidate_cents); the
set's rows exist once, however many payments name it. The other lists of a match row are short by nature:
one invoice, a sum of a few, or the numbers that the payment's text quotes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paidup.config import MatchSettings
from paidup.operators.amounts import band_start, bands_near, priced_items
from paidup.skew import hot_keys, lookup

_BAND = ["client_norm", "band"]


def candidate_sets(matches: DataFrame, open_items: DataFrame, settings: MatchSettings = MatchSettings()) -> DataFrame:
    """(client_norm, cents, item_ord, document): the invoices within the tolerance of every amount that a match row names.

    Invoices are the large side: each looks up its band, which holds at most as many different amounts as
    a band and its neighbours have cents, and bands that hold very many invoices are salted.
    """
    tol = settings.tolerance_cents
    named = matches.filter(F.col("candidate_cents").isNotNull())
    asked = named.select(F.col("client").alias("client_norm"), F.col("candidate_cents").alias("asked")).distinct()
    asked = asked.select("client_norm", "asked", F.explode(bands_near(F.col("asked"), tol)).alias("band"))
    asked = asked.groupBy(*_BAND).agg(F.collect_set("asked").alias("asked"))
    items = priced_items(open_items).withColumn("band", band_start(F.col("cents"), tol))
    (hot,) = hot_keys(items, _BAND)
    near = F.filter("asked", lambda x: F.abs(x - F.col("cents")) <= tol)
    return lookup(items, asked, _BAND, "inner", hot, ["item_ord"]).select(
        "client_norm", F.explode(near).alias("cents"), "item_ord", "document"
    )


def candidates(matches: DataFrame, sets: DataFrame) -> DataFrame:
    """(client, cents, payment_id, pos, document): every candidate of the ambiguous payments.

    Rows of a set have its client and cents and no payment; those of a list in a match row have their payment.
    """
    listed = matches.filter((F.col("match_state") == "AMBIGUO") & F.col("candidate_cents").isNull())
    return sets.select(
        F.col("client_norm").alias("client"), "cents", F.lit(None).cast("long").alias("payment_id"), F.col("item_ord").alias("pos"), "document"
    ).unionByName(
        listed.select(
            "client", F.lit(None).cast("long").alias("cents"), "payment_id", F.posexplode("documents").alias("pos", "document")
        ).withColumn("pos", F.col("pos").cast("long"))
    )


def with_exact_lists(hits: DataFrame, open_items: DataFrame, settings: MatchSettings = MatchSettings()) -> DataFrame:
    """``amounts.exact_hits`` with ``exact`` listing every invoice within the tolerance, in item order, however many."""
    several = hits.filter(F.col("n_exact") > 1).select(F.col("client_norm").alias("client"), F.col("cents").alias("candidate_cents"))
    entry = F.sort_array(F.collect_list(F.struct("item_ord", "document")))
    sets = candidate_sets(several, open_items, settings).groupBy("client_norm", "cents").agg(entry.alias("set"))
    found = F.transform("set", lambda x: x["document"])
    return hits.join(sets, ["client_norm", "cents"], "left").select(
        "client_norm", "cents", "n_exact", F.coalesce("exact", found).alias("exact")
    )


def of_payments(labelled: DataFrame, matches: DataFrame) -> DataFrame:
    """(payment_id, document, label): rows of ``candidates``, those of a set once for every payment that names it."""
    key = ["client", "cents"]
    named = matches.filter((F.col("match_state") == "AMBIGUO") & F.col("candidate_cents").isNotNull())
    named = named.select("payment_id", "client", F.col("candidate_cents").alias("cents"))
    sets = labelled.filter(F.col("cents").isNotNull()).select(*key, "document", "label")
    (hot,) = hot_keys(named, key)
    own = labelled.filter(F.col("cents").isNull()).select("payment_id", "document", "label")
    return own.unionByName(lookup(named, sets, key, "inner", hot, ["payment_id"]).select("payment_id", "document", "label"))


def with_lists(matches: DataFrame, open_items: DataFrame, settings: MatchSettings = MatchSettings()) -> DataFrame:
    """Match rows in the form of the exchange files: ``documents`` holds every candidate, a quoted number once for
    each invoice that bears it, both in item order. The lists are as long as the sets; where that matters, read
    ``candidate_sets`` instead."""
    entry = F.sort_array(F.collect_list(F.struct("item_ord", "document")))
    sets = candidate_sets(matches, open_items, settings).groupBy("client_norm", "cents").agg(entry.alias("set"))
    sets = sets.select(F.col("client_norm").alias("client"), F.col("cents").alias("candidate_cents"), "set")
    shared = matches.filter((F.col("match_method") == "referencia") & (F.size("documents") < F.col("n_documents")))
    shared = shared.select("payment_id", F.col("client").alias("client_norm"), F.explode("documents").alias("document"))
    bearers = shared.join(priced_items(open_items), ["client_norm", "document"]).groupBy("payment_id").agg(entry.alias("bearers"))
    rows = lookup(matches, sets, ["client", "candidate_cents"], "left", (), ["payment_id"]).join(bearers, "payment_id", "left")
    found = F.transform(F.coalesce("set", "bearers"), lambda x: x["document"])
    return rows.withColumn("documents", F.coalesce(found, "documents")).select(
        *[c for c in matches.columns if c != "candidate_cents"]
    )
