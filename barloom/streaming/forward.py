"""Strictly sequential forward ledger: next session only, no backfill, idempotent replay."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from barloom.sources.sinks import checksum
from barloom.sources.sinks import _exists

KINDS = ("candidates", "orders", "trades", "equity", "events")
MANIFESTS = (
    "session date, kind string, records bigint, checksum string, prior_hash string, final_hash string, "
    "session_records bigint, session_digest string, kinds int, batch string"
)
DECISIONS = "session date, decision string, records bigint"


def genesis(kind: str) -> str:
    """Hash of an empty ledger of a kind."""
    return hashlib.sha256(kind.encode()).hexdigest()


def chained(prior: str, session, kind: str, records: int, summed: str) -> str:
    """Hash of a ledger after a session: over the hash before it and what the session adds."""
    return hashlib.sha256("|".join((prior, str(session), kind, str(records), summed)).encode()).hexdigest()


class ForwardLedger:
    """Append-only ledgers under ``root``, one partition per accepted session and kind.

    A session is recorded by its manifest: one row per kind with its count, its checksum and the kind's
    hash before and after. Manifests are written last and by session, so a session counts as processed
    only when all its partitions are written. Every write goes to a place named by its session or by its
    batch and replaces what is there: a batch that is offered again after a crash, wherever it stopped,
    ends as if it had run once. What a crash left behind is not read, since reading starts from manifests.
    """

    def __init__(self, spark: SparkSession, root: str, calendar: DataFrame, first_session=None):
        self.spark, self.root, self.calendar, self.first_session = spark, root.rstrip("/"), calendar, first_session

    def manifests(self) -> DataFrame:
        return self._table("manifests", MANIFESTS)

    def control(self) -> DataFrame:
        """One row per recorded session."""
        return self.manifests().groupBy("session").agg(
            F.first("session_digest").alias("digest"), F.first("session_records").alias("records"), F.first("kinds").alias("kinds")
        )

    def decisions(self) -> DataFrame:
        return self._table("decisions", DECISIONS + ", batch string").drop("batch")

    def heads(self) -> dict[str, str]:
        """Hash of each kind's ledger after its last session."""
        last = self.manifests().groupBy("kind").agg(F.max_by("final_hash", "session").alias("h"))
        return {r["kind"]: r["h"] for r in last.collect()}

    def _table(self, name: str, schema: str) -> DataFrame:
        path = f"{self.root}/{name}"
        if not _exists(self.spark, path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(path)

    def read(self, kind: str, schema) -> DataFrame:
        """Rows of a kind in recorded sessions; no rows before the first of them."""
        recorded = self.manifests().where((F.col("kind") == kind) & (F.col("records") > 0)).select("session")
        return self._table(kind, schema).join(recorded, "session", "left_semi")

    def violations(self, schemas: dict) -> DataFrame:
        """(session, kind, problem): stored rows against their manifest, and each hash against the one before it."""
        out = None
        for kind, schema in schemas.items():
            rows = self._table(kind, schema)
            columns = [c for c in rows.columns if c != "session"]
            stored = rows.groupBy("session").agg(F.count(F.lit(1)).alias("_n"), checksum(columns).alias("_sum"))
            own = self.manifests().where(F.col("kind") == kind).join(stored, "session", "left")
            before = F.lag("final_hash", 1, genesis(kind)).over(Window.partitionBy("kind").orderBy("session"))
            text = F.concat_ws("|", "prior_hash", F.col("session").cast("string"), "kind", F.col("records").cast("string"), "checksum")
            problems = F.array_compact(F.array(
                F.when((F.col("records") > 0) & (F.coalesce("_n", F.lit(0)) != F.col("records")), "count"),
                F.when((F.col("records") > 0) & ~F.col("_sum").eqNullSafe(F.col("checksum")), "content"),
                F.when(F.col("_before") != F.col("prior_hash"), "order"),
                F.when(F.sha2(text, 256) != F.col("final_hash"), "hash"),
            ))
            found = own.withColumn("_before", before).select("session", "kind", F.explode(problems).alias("problem"))
            out = found if out is None else out.unionByName(found)
        return out

    def offer(self, batch: DataFrame, kinds: Callable[[DataFrame], dict[str, DataFrame]], check=None, batch_id=None) -> list[tuple]:
        """Offer the sessions of a batch in order; returns (session, decision, records).

        One aggregation brings a count and checksum per session to the driver;
        the decisions are taken on those, and the rows of all accepted sessions
        are then written together. ``check`` maps the batch to its invalid
        sessions. A batch offered again under its ``batch_id`` gets the decisions it
        had or would have had; without an id it counts as a new one.
        """
        batch = batch.persist()
        try:
            return self._offer(batch, kinds, check, self._next() if batch_id is None else str(batch_id))
        finally:
            batch.unpersist()

    def _next(self) -> str:
        batches = self._table("decisions", DECISIONS + ", batch string").select("batch").distinct()
        return f"n{batches.count()}"

    def _offer(self, batch: DataFrame, kinds, check, batch_id: str) -> list[tuple]:
        facts = (
            batch.groupBy("session")
            .agg(
                F.count(F.lit(1)).alias("records"),
                checksum(batch.columns).alias("checksum"),
            )
            .join(self.calendar.select("session", "prev_session"), "session", "left")
            .orderBy("session")
            .collect()
        )
        invalid = {r["session"] for r in check(batch).collect()} if check is not None else set()
        known = self.manifests().join(batch.select("session").distinct(), "session", "left_semi")
        digests = {r[0]: (r[1], r[2]) for r in known.select("session", "session_digest", "batch").distinct().collect()}
        last = self.manifests().agg(F.max("session").alias("s")).first()["s"]
        decided = []
        for row in facts:
            session, digest = row["session"], f"{row['records']}:{row['checksum']}"
            start = session == self.first_session if self.first_session else row["prev_session"] is None
            follows = start if last is None else row["prev_session"] == last
            if digests.get(session) == (digest, batch_id):
                decision = "recorded"  # by this batch, before it was cut off
            elif session in digests:
                decision = "replayed" if digests[session][0] == digest else "late"
            elif last is not None and session <= last:
                decision = "late"
            elif not follows:
                decision = "skipped_ahead"
            elif session in invalid:
                decision = "invalid"
            else:
                decision, last = "accepted", session
            decided.append((session, decision, row["records"], digest))
        accepted = [d for d in decided if d[1] == "accepted"]
        refused = [d[0] for d in decided if d[1] in ("late", "skipped_ahead", "invalid")]
        if accepted:
            self._record(batch.where(F.col("session").isin([d[0] for d in accepted])), kinds, accepted, batch_id)
        if refused:
            self._replace(batch.where(F.col("session").isin(refused)).withColumn("batch", F.lit(batch_id)), "dead_letter", "batch", "session")
        out = [(s, "accepted" if decision == "recorded" else decision, n) for s, decision, n, _ in decided]
        if out:
            rows = self.spark.createDataFrame([(*d, batch_id) for d in out], DECISIONS + ", batch string")
            self._replace(rows.coalesce(1), "decisions", "batch")
        return out

    def _record(self, rows: DataFrame, kinds, accepted: list[tuple], batch_id: str) -> None:
        """Rows of every kind, then the manifests of the sessions."""
        parts = kinds(rows)
        heads, sums = self.heads(), {}
        for kind, part in parts.items():
            self._replace(part, kind, "session")
            columns = [c for c in part.columns if c != "session"]
            per = part.groupBy("session").agg(F.count(F.lit(1)).alias("n"), checksum(columns).alias("h"))
            sums |= {(r["session"], kind): (r["n"], r["h"]) for r in per.collect()}
        out = []
        for session, _, records, digest in accepted:
            for kind in parts:
                n, summed = sums.get((session, kind), (0, ""))
                prior = heads.get(kind, genesis(kind))
                heads[kind] = chained(prior, session, kind, n, summed)
                out.append((session, kind, n, summed, prior, heads[kind], records, digest, len(parts), batch_id))
        # One file per session: its manifest is there as a whole or not at all.
        self._replace(self.spark.createDataFrame(out, MANIFESTS).repartition("session"), "manifests", "session")

    def _replace(self, rows: DataFrame, name: str, *by: str) -> None:
        writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy(*by).parquet(f"{self.root}/{name}")

    def apply(self, kinds: Callable[[DataFrame], dict[str, DataFrame]], check=None, source: str = ""):
        """A ``foreachBatch`` function; ``source`` tells apart streams whose batches are numbered alike."""

        def run(batch: DataFrame, batch_id: int) -> None:
            self.offer(batch, kinds, check, f"{source}{batch_id}")

        return run


def initial_books(strategies: DataFrame, capital: float, first_session) -> DataFrame:
    """Empty books at the declared capital."""
    money = F.lit(capital).cast("decimal(28,2)")
    return strategies.select(
        "strategy_id",
        F.lit(first_session).cast("date").alias("first_session"),
        money.alias("starting_equity"),
        money.alias("current_equity"),
        F.lit(0).cast("bigint").alias("closed_trades"),
        F.lit(0).cast("bigint").alias("open_positions"),
    )


def missing_roster(roster: DataFrame, key: str = "security_id"):
    """Batch check: sessions of the batch that lack a roster member."""

    def check(batch: DataFrame) -> DataFrame:
        needed = roster.select(F.count_distinct(key)).scalar()
        present = batch.join(roster.select(key), key, "left_semi")
        per = batch.select("session").distinct().join(
            present.groupBy("session").agg(F.count_distinct(key).alias("n")), "session", "left"
        )
        return per.where(F.coalesce("n", F.lit(0)) < needed).select("session")

    return check


def known_by(schedule: DataFrame, session) -> DataFrame:
    """Schedule rows a session may use: known by then, not superseded yet, still ahead."""
    at = F.lit(session).cast("date")
    return schedule.where(
        (F.col("known_session") <= at)
        & (F.col("superseded_session").isNull() | (at < F.col("superseded_session")))
        & (F.col("event_session") > at)
    )


def open_positions(trades: DataFrame, session) -> DataFrame:
    """Positions entered by a session and not closed by its end."""
    at = F.lit(session).cast("date")
    return trades.where((F.col("entry_session") <= at) & (F.col("exit_session") > at))
