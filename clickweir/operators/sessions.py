"""Sessions by silence, open carts and the per-session funnel."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.times import at, minutes as span_of
from ..schemas import ADD, PURCHASE, REMOVE, VIEW
from .metrics import is_type


def sessionize(events: DataFrame, gap_minutes: int = 5, key: str = "user_id") -> DataFrame:
    """Runs of events of one user without a silence of `gap_minutes` or more. Events without a user have no session.

    Events less than a gap apart always share a session, so all events in a cell one gap long do. Cells are
    built first, by an aggregate that spreads a busy user over many keys; only cells are put in order per
    user. A user then has at most as many rows as gaps fit into the time covered, however many events.
    """
    cell = F.window("timestamp", f"{gap_minutes} minutes").getField("start")
    cells = events.filter(F.col(key).isNotNull()).groupBy(key, cell.alias("cell")).agg(
        F.min("timestamp").alias("first"), F.max("timestamp").alias("last"), F.count(F.lit(1)).alias("n"))
    in_order = Window.partitionBy(key).orderBy("cell")
    starts = F.coalesce(F.lag("last").over(in_order) + span_of(gap_minutes) <= F.col("first"), F.lit(True))
    numbered = (
        cells.withColumn("starts", starts)
        .withColumn("session", F.sum(F.col("starts").cast("int")).over(in_order))
    )
    return numbered.groupBy(key, "session").agg(
        F.min("first").alias("session_start"), F.max("last").alias("session_end"),
        F.sum("n").alias("event_count"),
    ).select(key, "session_start", "session_end", "event_count")


def stream_sessions(events: DataFrame, gap_minutes: int = 5, key: str = "user_id") -> DataFrame:
    """The same on a stream, by Spark's session windows; a session is given once the watermark passes its gap.

    The window ends a gap after the last event, so the last event's time needs no buffer of its own.
    """
    return events.filter(F.col(key).isNotNull()).groupBy(F.session_window("timestamp", f"{gap_minutes} minutes").alias("w"), key).agg(
        F.count(F.lit(1)).alias("event_count")
    ).select(key, F.col("w.start").alias("session_start"),
             (F.col("w.end") - span_of(gap_minutes)).alias("session_end"), "event_count")


def cart_moves(events: DataFrame) -> DataFrame:
    """Partials of carts: what events add to each cart line, and the time of the last of them."""
    moves = events.filter(F.col("event_type").isin(ADD, REMOVE, PURCHASE))
    signed = F.when(is_type(ADD), F.col("quantity")).otherwise(-F.col("quantity"))
    return moves.groupBy("session_id", "product_id").agg(F.sum(signed).cast("long").alias("moved"), F.max("timestamp").alias("last_at"))


def added_moves(partials: DataFrame) -> DataFrame:
    """Partials of one cart line as one, whatever it holds: a late add may still come to a line that is empty now."""
    return partials.groupBy("session_id", "product_id").agg(F.sum("moved").alias("moved"), F.max("last_at").alias("last_at"))


def open_carts(partials: DataFrame, since=None) -> DataFrame:
    """cart_state() of the events behind the partials, with the last move; with `since`, without lines that lie still for longer."""
    lines = added_moves(partials).filter(F.col("moved") > 0)
    if since is not None:
        lines = lines.filter(F.col("last_at") >= at(since))
    return lines.select("session_id", "product_id", F.col("moved").alias("open_quantity"), "last_at")


def session_events(events: DataFrame) -> DataFrame:
    """Partials of the funnel: of each session its first view, the times of its adds and purchases, each once, and one
    time of anything else, which tells that there is the session."""
    steps = F.when(F.col("event_type").isin(VIEW, ADD, PURCHASE), F.col("event_type")).otherwise("other")
    known = events.filter(F.col("session_id").isNotNull()).select("session_id", steps.alias("event_type"), "timestamp")
    return funnel_events(known)


def funnel_events(partials: DataFrame) -> DataFrame:
    """Partials of the funnel without what no longer matters."""
    every = F.when(F.col("event_type").isin(ADD, PURCHASE), F.col("timestamp"))
    return (partials.withColumn("own", every).groupBy("session_id", "event_type", "own")
            .agg(F.min("timestamp").alias("timestamp")).select("session_id", "event_type", "timestamp"))


def cart_state(events: DataFrame, as_of=None) -> DataFrame:
    """Open quantity per session and product: added, less removed and bought. `as_of` is exclusive."""
    if as_of is not None:
        events = events.filter(F.col("timestamp") < at(as_of))
    moves = events.filter(F.col("event_type").isin(ADD, REMOVE, PURCHASE))
    signed = F.when(is_type(ADD), F.col("quantity")).otherwise(-F.col("quantity"))
    return (
        moves.groupBy("session_id", "product_id").agg(F.sum(signed).alias("open_quantity"))
        .filter(F.col("open_quantity") > 0)
    )


def session_funnel(events: DataFrame, key: str = "session_id") -> DataFrame:
    """One row: sessions, those with a view, with a cart add after the first view, and with a purchase after the first
    such add. Equal times do not count as after.

    Each step is an equi-join of one type's events with a row per session, so a long session is split like any frequent
    key and is reduced before it is shuffled again.
    """
    known = events.filter(F.col(key).isNotNull()).select(key, "event_type", "timestamp")

    def first(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy(key).agg(F.min("timestamp").alias(name))

    views = first(known.filter(is_type(VIEW)), "view")
    adds = first(known.filter(is_type(ADD)).join(views, key).filter(F.col("timestamp") > F.col("view")), "cart")
    bought = first(known.filter(is_type(PURCHASE)).join(adds, key).filter(F.col("timestamp") > F.col("cart")), "purchase")
    steps = {"sessions": known.select(key).distinct(), "viewed": views, "carted_after_view": adds, "purchased_after_cart": bought}
    counts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("step"), "n") for name, df in steps.items()]
    return reduce(DataFrame.unionByName, counts).agg(*[F.max(F.when(F.col("step") == name, F.col("n"))).alias(name) for name in steps])
