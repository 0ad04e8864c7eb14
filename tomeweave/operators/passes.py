"""One run over captured data: wanted books to outcomes to ledgers."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ledger, outcomes, worklist
from .skew import first_per_key

PAIR = ["isbn13", "source"]
PAYLOAD = ["blurb", "covers", "reviews", "genres"]


@dataclass
class Run:
    """Outcome of every (book, source) pair, and the ledgers after the run."""

    outcomes: DataFrame
    ledgers: DataFrame


def run(wanted: DataFrame, stored: DataFrame, ledgers: DataFrame, records: DataFrame, log: DataFrame) -> Run:
    """Work list, what the captured records and the fetch log say of it, and the ledgers that follow.

    ``wanted(isbn13)``, ``stored(isbn13, source)`` and ``ledgers(source, kind, isbn13)`` are the
    state before; ``log`` is the fetch log of the run, summed to one row per pair.  ``records`` are
    mapped records.  Of several for one pair the newest by ``seq`` counts, else the one with the
    most fields.  Optional columns are ``incomplete`` (a cover is still to be had), ``warnings`` and
    ``failed`` (the mapping broke).  What a source gave beside the fields (blurb, covers, reviews,
    genres) is a payload: such a pair is not empty and never taken for absent.  Neither is a pair
    without a record and without a contacted host.
    """
    kept = {kind: ledgers.where(F.col("kind") == kind).select("isbn13", "source") for kind in ("no_data", "incomplete")}
    states = worklist.pair_states(wanted.select("isbn13").distinct(), worklist.answered_bits(stored, kept["no_data"], kept["incomplete"]))
    marked = outcomes.completeness(records)
    held = lambda name, default: F.coalesce(F.col(name), default) if name in records.columns else default
    extras = [outcomes.field_present(records, c) for c in PAYLOAD if c in records.columns]
    has_metadata = F.size("found") > 0
    marked = marked.select(*PAIR, has_metadata.alias("has_metadata"), reduce(lambda a, b: a | b, extras, has_metadata).alias("has_payload"), "missing",
                           held("warnings", F.array().cast("array<string>")).alias("warnings"), held("incomplete", F.lit(False)).alias("incomplete"),
                           held("failed", F.lit(False)).alias("failed"), held("seq", F.lit(0)).alias("_seq"))
    found = first_per_key(marked, PAIR, [F.desc("_seq"), F.size("missing"), F.desc("has_payload"), "missing", "warnings", "incomplete", "failed"]).drop("_seq")
    none = F.array().cast("array<string>")
    joined = states.join(found, PAIR, "left").join(outcomes.pair_summary(log), PAIR, "left")
    flag = lambda name: F.coalesce(name, F.lit(False)).alias(name)
    listed = lambda name: F.coalesce(name, none).alias(name)
    passes = joined.select(
        *PAIR, "skip_reason", flag("has_metadata"), flag("has_payload"), listed("missing"), listed("warnings"), flag("incomplete"), flag("failed"),
        "block_reason", F.coalesce("responded_hosts", F.lit(0)).alias("responded_hosts"), F.lit(1).cast("bigint").alias("seq"))
    classified = outcomes.classify(passes)
    return Run(classified, ledger.merge(ledgers, ledger.changes_from_outcomes(classified)))
