"""Registered queries: each operator over the whole derived tables, in a form SQL can be compared with.

Money leaves as double, lists as comma-joined text. Reports that read the outputs of a run share one
stored match table per session and data set, as the reports of a real run read its stored outputs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

import workload as w
from paidup.config import MatchSettings, RunSettings
from paidup.functions.fingerprint import payment_fingerprint
from paidup.functions.money import cents, parse_int, parse_money
from paidup.functions.dates import day_first_date, statement_date
from paidup.functions.text import normal
from paidup.operators import amounts, candidates as cand, decisions as dec, docref, dunning, identify as idn, ledger, reports, worklist
from paidup.operators.cascade import already_processed, match_counters, match_payments, not_yet_processed, payments_of
from paidup.operators.classify import classify, date_filter_counts, flow_of, movement_summary, value_counts
from paidup.operators.consolidate import consolidate_items, exceptions_of, first_payments
from paidup.plans.reconcile import reconcile
from paidup.schemas import MATCH_RESULT
from paidup.skew import hot_keys
from paidup.workspace import Workspace

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
SETTINGS = MatchSettings()


def query(fn: Query) -> Query:
    _QUERIES[fn.__name__] = fn
    return fn


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def plain(df: DataFrame) -> DataFrame:
    """Decimals as double, string arrays as comma-joined text."""
    columns = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, T.DecimalType):
            c = c.cast("double").alias(f.name)
        elif isinstance(f.dataType, T.ArrayType):
            c = F.array_join(c, ",").alias(f.name)
        columns.append(c)
    return df.select(*columns)


def _movements(spark: SparkSession, sf: str) -> DataFrame:
    return classify(w.movements(spark, sf))


def _statement(spark: SparkSession, sf: str) -> DataFrame:
    """The derived movements as a stored table, as a run would have ingested them."""
    return classify(Workspace(spark).stage(w.movements(spark, sf), "statement"))


def _payments(spark: SparkSession, sf: str) -> DataFrame:
    return payments_of(_statement(spark, sf))


def run_cascade(spark: SparkSession, sf: str) -> DataFrame:
    # The cascade reads the movements once, into its own table of payments.
    return match_payments(
        _movements(spark, sf),
        w.open_items(spark, sf),
        w.aliases(spark, sf),
        w.decisions(spark, sf),
        w.history(spark, sf),
        SETTINGS,
    )


def run_segments(spark: SparkSession, sf: str) -> DataFrame:
    """The cascade on a few clients with very many invoices."""
    none = [w.aliases(spark, sf).limit(0), w.decisions(spark, sf).limit(0), w.history(spark, sf).limit(0)]
    return match_payments(w.segment_movements(spark, sf), w.segment_items(spark, sf), *none, SETTINGS)


_STORED: dict[tuple[str, str, str], str] = {}


def stored_matches(spark: SparkSession, sf: str, run: Query = run_cascade) -> DataFrame:
    """The match table of a run, written once per session and data set."""
    key = (spark.sparkContext.applicationId, sf, run.__name__)
    if key in _STORED:
        try:
            return spark.read.schema(MATCH_RESULT).parquet(_STORED[key])
        except AnalysisException:
            del _STORED[key]
    path = Workspace(spark).root + "/matches"
    run(spark, sf).write.parquet(path)
    _STORED[key] = path
    return spark.read.schema(MATCH_RESULT).parquet(path)


def _base(spark: SparkSession, sf: str) -> DataFrame:
    return consolidate_items(w.open_items(spark, sf), stored_matches(spark, sf))


def _exceptions(spark: SparkSession, sf: str) -> DataFrame:
    return exceptions_of(stored_matches(spark, sf))


def _exception_lists(spark: SparkSession, sf: str) -> DataFrame:
    """Exceptions as the exchange file has them, with all candidates in the row."""
    return exceptions_of(cand.with_lists(stored_matches(spark, sf), w.open_items(spark, sf)))


# --- ingest, classification, aging -------------------------------------------------------------


@query
def movements_typed(spark, sf):
    """Statement text fields typed: dates, money, codes, normalised text."""
    raw = w.statement_fields(spark, sf)
    amount = parse_money(F.col("amount"))
    return plain(
        raw.select(
            "movement_ord",
            statement_date(F.col("date_raw")).alias("value_date"),
            amount.alias("amount"),
            F.abs(amount).alias("amount_abs"),
            flow_of(amount).alias("flow"),
            parse_int(F.col("code")).alias("bank_code"),
            normal(F.col("description")).alias("description"),
        )
    )


@query
def day_first_dates(spark, sf):
    """Due dates written day-first, ISO or unreadable, by order."""
    return w.sheet_fields(spark, sf).select("item_ord", day_first_date(F.col("due_date")).alias("due_date"))


@query
def weekly_items(spark, sf):
    """The positional receivables layout, typed, filtered and aged."""
    from paidup.sources.receivables import weekly_items as typed

    return plain(typed(w.sheet_fields(spark, sf), w.CUTOFF, skip_rows=3))


@query
def erp_items(spark, sf):
    """The header-named receivables layout: invoices with a positive balance, aged."""
    from paidup.sources.receivables import erp_items as typed

    return plain(typed(w.erp_fields(spark, sf), w.CUTOFF))


@query
def movement_flow(spark, sf):
    return value_counts(w.movements(spark, sf), "flow")


@query
def movement_categories(spark, sf):
    return _movements(spark, sf).select("movement_ord", "flow", "category")


@query
def category_counts(spark, sf):
    return value_counts(_movements(spark, sf), "category")


@query
def date_filter(spark, sf):
    from paidup.operators.classify import in_date_range

    return in_date_range(w.movements(spark, sf), "2001-07-10", "2001-07-25").select("movement_ord", "value_date")


@query
def date_filter_count(spark, sf):
    return date_filter_counts(w.movements(spark, sf), "2001-07-10", "2001-07-25")


@query
def movement_totals(spark, sf):
    return movement_summary(w.movements(spark, sf))


@query
def open_items_aged(spark, sf):
    return plain(w.open_items(spark, sf).drop("posting_date", "original_amount"))


@query
def portfolio(spark, sf):
    return plain(reports.portfolio_summary(w.open_items(spark, sf)))


@query
def aging_distribution(spark, sf):
    return plain(reports.aging_distribution(w.open_items(spark, sf)))


@query
def band_counts(spark, sf):
    return value_counts(w.open_items(spark, sf), "aging_band")


@query
def fingerprints(spark, sf):
    rows = w.movements(spark, sf)
    return rows.select(
        "movement_ord", payment_fingerprint(F.col("description"), F.col("amount"), F.col("value_date")).alias("fingerprint")
    )


# --- ledgers -----------------------------------------------------------------------------------


@query
def history_semi(spark, sf):
    payments = _payments(spark, sf)
    return already_processed(payments, w.history(spark, sf)).select("payment_id", "fingerprint")


@query
def history_anti(spark, sf):
    payments = _payments(spark, sf)
    return not_yet_processed(payments, w.history(spark, sf)).select("payment_id", "fingerprint")


@query
def decisions_last(spark, sf):
    return plain(dec.last_decisions(w.decisions(spark, sf)).select("fingerprint", "action", "decision_state", "decision_ord"))


@query
def decisions_last_active(spark, sf):
    rows = dec.active_decisions(w.decisions(spark, sf))
    return rows.select("fingerprint", "action", "assigned_document", "assigned_client")


@query
def decision_conflicts(spark, sf):
    return dec.claimed_documents(dec.active_decisions(w.decisions(spark, sf)))


@query
def decision_validity(spark, sf):
    return dec.decision_validity(dec.active_decisions(w.decisions(spark, sf)), w.open_items(spark, sf))


@query
def missing_documents(spark, sf):
    return dec.missing_documents(dec.active_decisions(w.decisions(spark, sf)), w.open_items(spark, sf))


@query
def decision_outcomes(spark, sf):
    return plain(dec.decision_outcomes(w.decisions(spark, sf), w.open_items(spark, sf)))


@query
def decision_totals(spark, sf):
    return ledger.decision_counts(w.decisions(spark, sf))


@query
def decisions_audit(spark, sf):
    rows = worklist.active_decision_list(w.decisions(spark, sf), ["APLICAR_FACTURA", "PAGO_PARCIAL", "PENDIENTE"])
    return rows.select("fingerprint", "action", "details")


@query
def reverts(spark, sf):
    """Revert every decided payment and every second payment without a decision."""
    asked = _payments(spark, sf).filter(F.col("description").startswith("CONSIGNACION")).select("fingerprint")
    when = F.lit(w.CUTOFF).cast("timestamp")
    outcome = ledger.reversals(w.decisions(spark, sf), asked, when, w.history(spark, sf))
    return outcome.select("fingerprint", "accepted", "reopens", F.when(F.col("accepted"), F.col("comment")).alias("comment"))


@query
def aliases_catalogue(spark, sf):
    return idn.alias_catalogue(w.aliases(spark, sf).drop("notes"))


@query
def aliases_new(spark, sf):
    """Every unknown-payer text offered as an alias of its client: those the catalogue lacks."""
    asked = _payments(spark, sf).filter(F.col("description").startswith("TRANSFER ALFA")).select(
        F.lower("description").alias("alias"), F.lit(" nuevo cliente ").alias("real_client"), F.lit("").alias("notes")
    )
    return ledger.new_aliases(asked, w.aliases(spark, sf)).select("alias", "real_client")


@query
def omitted_count(spark, sf):
    return reports.omitted_payments(w.history(spark, sf))


@query
def run_times(spark, sf):
    return value_counts(w.history(spark, sf).select(F.date_format("run_at", "yyyy-MM-dd").alias("run_day")), "run_day")


# --- identification and amounts ------------------------------------------------------------------


@query
def client_directory(spark, sf):
    return idn.client_directory(w.clients_multi(spark, sf))


@query
def client_identify_shared(spark, sf):
    """Clients that share words, texts that name one word: containment, first client wins."""
    ws = Workspace(spark)
    clients = idn.client_directory(w.clients_multi(spark, sf))
    empty = spark.createDataFrame([], "alias string, real_client string, alias_ord long")
    needles = ws.stage(idn.needle_table(empty, clients), "needles")
    return idn.identify_texts(w.texts_multi(spark, sf).distinct(), needles, ws).select("description", "client")


@query
def alias_identify(spark, sf):
    ws = Workspace(spark)
    rows = idn.identify(_payments(spark, sf), w.aliases(spark, sf), w.open_items(spark, sf), ws)
    return rows.filter(F.col("client_method") == "alias").select("payment_id", "client")


@query
def client_identify(spark, sf):
    ws = Workspace(spark)
    rows = idn.identify(_payments(spark, sf), w.aliases(spark, sf), w.open_items(spark, sf), ws)
    return rows.filter(F.col("client_method") == "directo").select("payment_id", "client")


def _queries_of(spark, sf, ws):
    named = idn.identify(_payments(spark, sf), w.aliases(spark, sf), w.open_items(spark, sf), ws)
    named = named.filter(F.col("client").isNotNull()).withColumn("client_norm", F.col("client"))
    return named.withColumn("cents", cents(F.col("amount")))


@query
def exact_hits(spark, sf):
    """Distinct (client, amount) of identified payments with all their equal-amount invoices."""
    ws = Workspace(spark)
    open_items = w.open_items(spark, sf)
    items = ws.stage(amounts.priced_items(open_items), "items")
    asked = _queries_of(spark, sf, ws).select("client_norm", "cents").distinct()
    hits = ws.stage(amounts.exact_hits(asked, amounts.price_levels(items), SETTINGS), "hits")
    return plain(cand.with_exact_lists(hits, open_items, SETTINGS))


@query
def combos(spark, sf):
    """All sums of 2 to 4 invoices of the clients with at most 15."""
    items = amounts.priced_items(w.open_items(spark, sf))
    rows = amounts.combinations_of(amounts.client_profiles(items, SETTINGS), SETTINGS)
    return plain(rows.select("client_norm", F.col("k").cast("long").alias("k"), "documents", "cents"))


@query
def accumulated_hits(spark, sf):
    """Distinct (client, amount) of identified payments with the invoice sums that fit."""
    ws = Workspace(spark)
    items = ws.stage(amounts.priced_items(w.open_items(spark, sf)), "items")
    asked = _queries_of(spark, sf, ws).select("client_norm", "cents").distinct()
    known = asked.join(amounts.client_profiles(items, SETTINGS), "client_norm").select(
        "*", F.lit(None).cast("long").alias("n_exact"), F.lit(None).cast("array<string>").alias("exact")
    )
    hits = amounts.with_sum_hits(known, SETTINGS).filter(F.col("n_sums").isNotNull())
    return plain(hits.select("client_norm", "cents", "n_sums", "first_sum"))


@query
def reference_hits(spark, sf):
    """Invoice numbers of the client quoted in the text of its payments."""
    ws = Workspace(spark)
    items = ws.stage(amounts.priced_items(w.open_items(spark, sf)), "items")
    named = ws.stage(_queries_of(spark, sf, ws).select("payment_id", "client_norm", "description"), "named")
    return plain(docref.quoted_documents(named, items, ws))


@query
def reference_hits_of_many(spark, sf):
    """The same for a few clients with very many invoices, several to a number."""
    ws = Workspace(spark)
    items = ws.stage(amounts.priced_items(w.segment_items(spark, sf)), "items")
    rows = idn.identify(payments_of(w.segment_movements(spark, sf)), w.aliases(spark, sf).limit(0), items, ws)
    named = ws.stage(rows.select("payment_id", F.col("client").alias("client_norm"), "description"), "named")
    return plain(docref.quoted_documents(named, items, ws))


# --- cascade, consolidation ----------------------------------------------------------------------


@query
def match_cascade(spark, sf):
    """Every payment with its outcome; all candidates in the row, as the exchange files have them."""
    return plain(cand.with_lists(run_cascade(spark, sf), w.open_items(spark, sf)))


@query
def match_large_clients(spark, sf):
    """The outcomes for clients with very many invoices, candidate sets named by client and amount."""
    rows = stored_matches(spark, sf, run_segments)
    return plain(rows.drop("value_date", "fingerprint", "note"))


@query
def candidate_sets(spark, sf):
    """The invoices of every candidate set of the large clients, each once."""
    return cand.candidate_sets(stored_matches(spark, sf, run_segments), w.segment_items(spark, sf))


@query
def match_state_counts(spark, sf):
    rows = stored_matches(spark, sf)
    return rows.groupBy("match_state", "match_method", "client_method").agg(F.count(F.lit(1)).alias("rows"))


@query
def match_totals(spark, sf):
    return match_counters(stored_matches(spark, sf))


@query
def payment_first_per_document(spark, sf):
    return first_payments(stored_matches(spark, sf))


@query
def consolidated(spark, sf):
    return plain(_base(spark, sf))


@query
def consolidated_by_client(spark, sf):
    base = consolidate_items(w.open_items(spark, sf), stored_matches(spark, sf), join_on_client=True)
    return base.select("item_ord", "payment_id", "is_paid", "invoice_state")


@query
def priority_counts(spark, sf):
    return value_counts(_base(spark, sf), "priority")


@query
def exceptions(spark, sf):
    return plain(_exception_lists(spark, sf))


@query
def exception_counts(spark, sf):
    return reports.exception_counts(_exceptions(spark, sf))


@query
def history_new(spark, sf):
    rows = ledger.new_history(stored_matches(spark, sf), w.history(spark, sf), F.lit(w.CUTOFF).cast("timestamp"))
    return plain(rows.drop("run_at"))


@query
def history_totals(spark, sf):
    return ledger.history_counters(stored_matches(spark, sf), w.history(spark, sf))


@query
def full_run(spark, sf):
    """The whole run on tables, dense payment ids, summed up per outcome of the invoices."""
    result = reconcile(
        w.movements(spark, sf),
        w.open_items(spark, sf),
        w.aliases(spark, sf),
        w.decisions(spark, sf),
        w.history(spark, sf),
        RunSettings(cutoff=w.CUTOFF, dense_payment_ids=True),
    )
    return plain(
        result.base.groupBy("invoice_state", "priority", "origin").agg(
            F.count(F.lit(1)).alias("invoices"),
            F.sum("open_amount").alias("balance"),
            F.min("payment_id").alias("first_payment"),
        )
    )


# --- reports, worklist, letters --------------------------------------------------------------------


@query
def kpis(spark, sf):
    return plain(reports.kpis(_base(spark, sf)))


@query
def critical_totals(spark, sf):
    return plain(reports.critical_summary(_base(spark, sf)))


@query
def aging_distribution_unpaid(spark, sf):
    return plain(reports.aging_distribution(reports.unpaid(_base(spark, sf))))


@query
def open_clients(spark, sf):
    return plain(reports.open_clients(_base(spark, sf)))


@query
def critical_top10(spark, sf):
    return plain(reports.critical_top(_base(spark, sf), 10))


@query
def detail_sorted(spark, sf):
    return plain(reports.detail(_base(spark, sf)))


@query
def detail_filtered(spark, sf):
    rows = reports.filter_detail(_base(spark, sf), priority="ALTO", invoice_state="VENCIDA", aging_band="31-60")
    return plain(reports.detail(rows))


@query
def option_lists(spark, sf):
    return reports.option_lists(_base(spark, sf))


@query
def origin_options(spark, sf):
    return reports.distinct_values(_exceptions(spark, sf), "origin")


@query
def exceptions_worklist(spark, sf):
    rows = worklist.exceptions_worklist(_exceptions(spark, sf), w.decisions(spark, sf))
    return rows.select("payment_id", "fingerprint", "match_state", "origin", "decided_on")


@query
def exceptions_by_origin(spark, sf):
    rows = worklist.with_origin(_exceptions(spark, sf), ["Manual (pendiente)", "Manual (pago parcial)", "Conflicto manual"])
    return rows.select("payment_id", "origin")


@query
def candidate_labels(spark, sf):
    """Every candidate of every ambiguous payment with its label."""
    matches = stored_matches(spark, sf)
    rows = cand.candidates(matches, cand.candidate_sets(matches, w.open_items(spark, sf)))
    return cand.of_payments(worklist.candidate_labels(rows, _base(spark, sf)), matches)


@query
def client_choices(spark, sf):
    return worklist.client_choices(_base(spark, sf))


@query
def decision_options(spark, sf):
    sets = cand.candidate_sets(stored_matches(spark, sf), w.open_items(spark, sf))
    return worklist.decision_options(_exceptions(spark, sf), _base(spark, sf), sets)


@query
def decision_options_large_clients(spark, sf):
    """The same for clients with very many equal invoices: a set's options once, not once a payment."""
    matches, items = stored_matches(spark, sf, run_segments), w.segment_items(spark, sf)
    sets = cand.candidate_sets(matches, items)
    return worklist.decision_options(exceptions_of(matches), consolidate_items(items, matches), sets)


@query
def decisions_allowed(spark, sf):
    """Every payment applied to its own order's invoice: the requests that the options of the payment hold."""
    matches = stored_matches(spark, sf)
    sets = cand.candidate_sets(matches, w.open_items(spark, sf))
    options = worklist.decision_options(_exceptions(spark, sf), _base(spark, sf), sets)
    asked = matches.select(
        "payment_id",
        F.lit("APLICAR_FACTURA").alias("action"),
        F.concat(F.lit("FV-"), F.col("payment_id").cast("string")).alias("document"),
    )
    return worklist.allowed(asked, _exceptions(spark, sf), options)


@query
def worst_band(spark, sf):
    return dunning.client_stages(_base(spark, sf)).select("client", "worst_band")


@query
def dunning_stage(spark, sf):
    return dunning.client_stages(_base(spark, sf))


@query
def dunning_letters(spark, sf):
    """The whole letter of every client, with all its lines."""
    return plain(dunning.letter_bodies(_base(spark, sf), w.CUTOFF))


@query
def dunning_lines(spark, sf):
    """The lines of all letters in order."""
    return dunning.dunning_lines(_base(spark, sf), Workspace(spark))


@query
def letters_large_clients(spark, sf):
    """Letters of clients with very many invoices as ordered rows: opening, lines, closing."""
    base = w.segment_items(spark, sf).withColumn("is_paid", F.lit(False))
    return dunning.letter_rows(dunning.dunning_letters(base, w.CUTOFF), dunning.dunning_lines(base, Workspace(spark)))


# --- files and ledgers: written from the derived tables, read back by the sources ----------------


@query
def statement_scan(spark, sf):
    """The statement as a ten-column CSV, read within a date range; positions follow the lines."""
    from paidup.sources.statement import read_statement

    ws = Workspace(spark)
    path = f"{ws.root}/statement-csv"
    blank = F.lit(" ")
    raw = w.statement_fields(spark, sf).orderBy("movement_ord")
    raw.select(
        F.lit(" 001 "), blank, blank, "date_raw", blank, "amount", "code", "description", F.lit("0"), blank
    ).write.csv(path, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return plain(read_statement(spark, path, "2001-07-10", "2001-07-25", ws))


@query
def rejected_statement_lines(spark, sf):
    """The contract check on a statement in which some later lines have not ten fields: these lines, by position."""
    from paidup.sources.statement import rejected_lines

    ws = Workspace(spark)
    path = f"{ws.root}/statement-text"
    k = F.col("movement_ord").cast("string")
    whole = F.concat_ws(",", F.lit("001"), F.lit(""), F.lit(""), F.date_format("value_date", "yyyyMMdd"), F.lit(""),
                        F.col("amount").cast("string"), F.lit("1"), k, F.lit("0"), F.lit(""))
    short = F.concat_ws(",", F.lit("001"), F.lit("short"), k)
    line = F.when(F.col("movement_ord") % 40 == 39, short).when(F.col("movement_ord") % 60 == 58, F.concat(whole, F.lit(",more")))
    rows = w.movements(spark, sf).orderBy("movement_ord")
    rows.select(F.coalesce(line, whole).alias("value")).write.text(path)
    return rejected_lines(spark, path, ws)


@query
def erp_scan(spark, sf):
    """The ERP export as a CSV with header: recognised by its columns, typed, filtered, aged."""
    from paidup.sources.receivables import read_receivables

    ws = Workspace(spark)
    path = f"{ws.root}/erp-csv"
    w.erp_fields(spark, sf).orderBy("item_ord").drop("item_ord").write.csv(path, header=True)
    return plain(read_receivables(spark, path, w.CUTOFF, ws=ws))


@query
def weekly_scan(spark, sf):
    """The weekly sheet as a positional Parquet table under three title rows: recognised by its columns, titles skipped."""
    from paidup.sources.receivables import read_receivables

    ws = Workspace(spark)
    path = f"{ws.root}/weekly"
    sheet = w.sheet_fields(spark, sf)
    titles = spark.range(-3, 0).select(F.col("id").alias("item_ord"), F.lit("CARTERA SEMANAL").alias("client"))
    whole = sheet.unionByName(titles, allowMissingColumns=True)
    whole.orderBy("item_ord").drop("item_ord").write.parquet(path)
    return plain(read_receivables(spark, path, w.CUTOFF, skip_rows=3, file_format="parquet", ws=ws))


@query
def decision_ledger(spark, sf):
    """Decisions appended in two batches: the later batch wins per payment."""
    from paidup.sources.ledgers import append_decisions, read_decisions

    path = f"{Workspace(spark).root}/decisions"
    rows = w.decisions(spark, sf)
    append_decisions(rows.filter("action <> 'REVERTIR'"), path)
    append_decisions(rows.filter("action = 'REVERTIR'"), path)
    active = dec.active_decisions(read_decisions(spark, path))
    return active.select("fingerprint", "action", "assigned_document", "assigned_client")


@query
def alias_ledger(spark, sf):
    """Aliases added twice: the catalogue keeps the first client of each."""
    from paidup.sources.ledgers import add_aliases, read_aliases

    path = f"{Workspace(spark).root}/aliases"
    rows = w.aliases(spark, sf)
    add_aliases(rows, path)
    add_aliases(rows.withColumn("real_client", F.lit("OTRO")).withColumn("alias", F.lower("alias")), path)
    return read_aliases(spark, path).select("alias", "real_client")


@query
def history_ledger(spark, sf):
    """New associations appended to the history: rows per run day afterwards."""
    from paidup.sources.ledgers import append_history, read_history

    path = f"{Workspace(spark).root}/history"
    append_history(w.history(spark, sf), path)
    known = read_history(spark, path)
    fresh = ledger.new_history(stored_matches(spark, sf), known, F.lit("2001-08-02").cast("timestamp"))
    append_history(Workspace(spark).stage(fresh, "fresh"), path)
    days = read_history(spark, path).select(F.date_format("run_at", "yyyy-MM-dd").alias("run_day"))
    return value_counts(days, "run_day")


@query
def exceptions_exchange(spark, sf):
    """Exceptions as CSV and back: document lists survive as lists."""
    from paidup.sources.outputs import EXCEPTIONS, export_csv, import_csv

    path = f"{Workspace(spark).root}/exceptions-csv"
    rows = _exception_lists(spark, sf)
    export_csv(rows, path)
    rows = import_csv(spark, path, T.StructType([f for f in EXCEPTIONS.fields if f.name in rows.columns]))
    return plain(rows.select("payment_id", "value_date", "amount", "match_method", "documents", "n_documents", "origin"))


@query
def detail_export(spark, sf):
    """The filtered invoice list as a CSV of nine columns, read back."""
    from paidup.sources.outputs import export_detail

    path = f"{Workspace(spark).root}/detail-csv"
    export_detail(reports.filter_detail(_base(spark, sf), priority="CRITICO", invoice_state="VENCIDA"), path)
    schema = (
        "client string, document string, due_date date, days_overdue int, open_amount decimal(18,2), aging_band string, "
        "invoice_state string, priority string, origin string"
    )
    return plain(spark.read.schema(schema).csv(path, header=True))


@query
def alias_file(spark, sf):
    """The alias catalogue as a CSV file with comment lines between the aliases, read back in order."""
    from paidup.sources.ledgers import read_alias_file

    ws = Workspace(spark)
    rows = w.aliases(spark, sf).select(F.col("alias_ord") * 2, F.col("alias"), F.col("real_client").alias("cliente_real"), F.col("notes").alias("notas"))
    rows = rows.toDF("line", "alias", "cliente_real", "notas")
    comments = rows.select(F.col("line") + 1, F.concat(F.lit("# "), "alias"), F.lit(None).cast("string"), F.lit(None).cast("string"))
    path = f"{ws.root}/alias-csv"
    rows.unionAll(comments).orderBy("line").drop("line").write.option("comment", "~").csv(path, header=True)
    return read_alias_file(spark, path, ws).select("alias", "real_client", "alias_ord")


@query
def decision_file(spark, sf):
    """The decisions as a CSV file from before there were states: all of them count as active."""
    from paidup.schemas import DECISION_FILE_COLUMNS
    from paidup.sources.ledgers import read_decision_file

    ws = Workspace(spark)
    path = f"{ws.root}/decisions-csv"
    names = {own: old for old, own in DECISION_FILE_COLUMNS.items() if own != "decision_state"}
    w.decisions(spark, sf).orderBy("decision_ord").select(*[F.col(own).alias(old) for own, old in names.items()]).write.csv(
        path, header=True, timestampFormat="yyyy-MM-dd HH:mm:ss"
    )
    rows = dec.last_decisions(read_decision_file(spark, path, ws))
    return plain(rows.select("decided_at", "fingerprint", "origin_payment_id", "amount", "action", "assigned_document", "decision_state"))


@query
def last_decision(spark, sf):
    """The last decision of one payment: the one whose fingerprint is the smallest of all decided."""
    rows = w.decisions(spark, sf)
    asked = rows.agg(F.min("fingerprint")).first()[0] or ""
    return dec.last_decision_of(rows, asked).select("fingerprint", "action", "assigned_client", "decision_state", "decision_ord")


@query
def run_time_scan(spark, sf):
    """The run timestamps of a stored history: a scan of that column only."""
    from paidup.sources.ledgers import append_history, read_run_times

    path = f"{Workspace(spark).root}/history"
    append_history(w.history(spark, sf), path)
    return value_counts(read_run_times(spark, path).select(F.date_format("run_at", "yyyy-MM-dd").alias("run_day")), "run_day")


@query
def consolidated_reload(spark, sf):
    """The consolidated table written as a run's output and read back; before that it is empty."""
    from paidup.sources.outputs import CONSOLIDATED, read_table, write_table

    path = f"{Workspace(spark).root}/consolidated"
    before = read_table(spark, path, CONSOLIDATED)
    write_table(_base(spark, sf), path)
    return plain(read_table(spark, path, CONSOLIDATED).unionByName(before))


@query
def run_from_files(spark, sf):
    """Two whole runs on the same files and stored ledgers: payments by what their outputs, read back, say of them.

    Statement and receivables are CSV files, the ledgers start as the given ones. What the first run associates
    is in the history that the second one reads.
    """
    from paidup.plans.reconcile import RunPaths, run_reconciliation
    from paidup.sources import ledgers
    from paidup.sources.outputs import read_table

    ws = Workspace(spark)
    names = ("statement", "receivables", "aliases", "decisions", "history")
    at = {name: f"{ws.root}/{name}" for name in names}
    blank, day = F.lit(" "), F.date_format("value_date", "yyyyMMdd")
    w.movements(spark, sf).orderBy("movement_ord").select(
        F.lit("001"), blank, blank, day, blank, F.col("amount").cast("string"), F.lit("1"), "description", F.lit("0"), blank
    ).write.csv(at["statement"])
    w.open_items(spark, sf).orderBy("item_ord").select(
        F.lit("RF").alias("Tipo"),
        F.col("client").alias("Nombre SN"),
        F.col("document").alias("Nº documento"),
        F.date_format("posting_date", "dd/MM/yyyy").alias("Fecha de contabilización"),
        F.date_format("due_date", "dd/MM/yyyy").alias("Fecha de vencimiento"),
        F.col("open_amount").cast("string").alias("Saldo vencido"),
    ).write.csv(at["receivables"], header=True)
    ledgers.add_aliases(w.aliases(spark, sf), at["aliases"])
    ledgers.append_decisions(w.decisions(spark, sf).withColumn("request_ord", F.col("decision_ord")), at["decisions"])
    ledgers.append_history(w.history(spark, sf), at["history"])

    def outcome(run: str) -> DataFrame:
        paths = RunPaths(**at, output=f"{ws.root}/{run}")
        run_reconciliation(spark, paths, RunSettings(cutoff=w.CUTOFF))
        rows = read_table(spark, f"{paths.output}/matches", MATCH_RESULT)
        return rows.select("payment_id", F.col("match_state").alias(f"{run}_state"), F.col("match_method").alias(f"{run}_method"))

    both = outcome("first").join(outcome("second"), "payment_id")
    return both.groupBy("first_state", "first_method", "second_state", "second_method").agg(F.count("*").alias("payments"))


@query
def learning_loop(spark, sf):
    """Two runs with the analyst between them, on ledgers of their own: payments by their outcome in either run.

    The first run knows no decisions and no history. What it associates goes to the history. Then the
    analyst decides deposits, teaches the alias of every unknown ALFA transfer that the run left, and takes
    some decisions back; the second run reads all that from the ledgers.
    """
    from paidup.plans.reconcile import record_decisions, revert_decisions
    from paidup.sources import ledgers

    ws = Workspace(spark)
    alias_path, decision_path, history_path = (f"{ws.root}/{name}" for name in ("aliases", "decisions", "history"))
    ledgers.add_aliases(w.aliases(spark, sf), alias_path)

    def run(day: str) -> DataFrame:
        history = ledgers.read_history(spark, history_path)
        matches = match_payments(
            _movements(spark, sf),
            w.open_items(spark, sf),
            ledgers.read_aliases(spark, alias_path),
            ledgers.read_decisions(spark, decision_path),
            history,
            SETTINGS,
        )
        matches = ws.stage(matches, "matches")
        fresh = ws.stage(ledger.new_history(matches, history, F.lit(day).cast("timestamp")), "fresh")
        ledgers.append_history(fresh, history_path)
        return matches

    first = run("2001-08-01")
    taught = exceptions_of(first).filter("match_state = 'CLIENTE_DESCONOCIDO' and description like 'TRANSFER ALFA %'").select(
        "fingerprint",
        F.col("payment_id").alias("origin_payment_id"),
        "amount",
        "description",
        F.lit("AGREGAR_ALIAS").alias("action"),
        F.concat(F.lit("Customer#"), F.substring("description", -9, 9)).alias("assigned_client"),
        F.col("description").alias("alias_source"),
        (-F.col("payment_id")).alias("request_ord"),
    )
    decided = w.decisions(spark, sf).withColumn("request_ord", F.col("decision_ord"))
    record_decisions(decided.filter("action <> 'REVERTIR'").drop("decision_ord").unionByName(taught, allowMissingColumns=True), decision_path, alias_path)
    revert_decisions(decided.filter("action = 'REVERTIR'").select("fingerprint", "request_ord"), decision_path, history_path)
    second = run("2001-08-02").select("payment_id", F.col("match_state").alias("second_state"), "match_method", "client_method")
    both = first.select("payment_id", F.col("match_state").alias("first_state")).join(second, "payment_id")
    return both.groupBy("first_state", "second_state", "match_method", "client_method").agg(F.count("*").alias("payments"))
