"""Replay of recorded agent steps, and the same logic over a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import base_name, stable_id


def within_budget(steps: DataFrame, run: str, flow: str, at: str, order: str, per_flow: int = 15, per_run: int = 80, seconds: float = 900) -> DataFrame:
    """Steps that an agent with these budgets would have taken."""
    f, r = Window.partitionBy(run, flow).orderBy(at, order), Window.partitionBy(run).orderBy(at, order)
    s = steps.withColumn("__in_flow", F.row_number().over(f)).where(F.col("__in_flow") <= per_flow)
    s = s.withColumn("__in_run", F.row_number().over(r)).withColumn("__start", F.min(at).over(Window.partitionBy(run)))
    ok = (F.col("__in_run") <= per_run) & (F.unix_micros(F.col(at).cast("timestamp")) - F.unix_micros(F.col("__start").cast("timestamp")) <= int(seconds * 1_000_000))
    return s.where(ok).drop("__in_flow", "__in_run", "__start")


def latched(steps: DataFrame, flow: str, order: list[str], outage) -> DataFrame:
    """`fallback` is true from a flow's first outage on."""
    w = Window.partitionBy(flow).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return steps.withColumn("fallback", F.coalesce(F.bool_or(outage).over(w), F.lit(False)))


def seen_before(steps: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    w = Window.partitionBy(*key).orderBy(*order)
    return steps.withColumn("seen", F.row_number().over(w) > 1)


def last_entries(steps: DataFrame, flow: str, order: list[str], n: int = 6) -> DataFrame:
    w = Window.partitionBy(flow).orderBy(*(F.desc(c) for c in order))
    return steps.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).drop("__n")


def windowed_counts(events: DataFrame, every: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, event_type, n, total) of tumbling windows; the same for a table and for a stream, which drops rows later than `late`."""
    e = events.withWatermark("ts", late) if events.isStreaming else events
    return e.groupBy(F.window("ts", every), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def first_of_each(events: DataFrame, key: str = "event_id", late: str = "10 minutes") -> DataFrame:
    """Each key once, as a run saves a screen once."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key]) if events.isStreaming else events.dropDuplicates([key])


def default_run_id():
    """A run's name by the UTC clock, when the session's time zone is UTC."""
    return F.date_format(F.current_timestamp(), "'run-'yyyyMMdd'T'HHmmss'Z'")


def trajectory_line(route, action, element_id, role, name, href):
    """A step in the words of a trajectory; the name without its number."""
    text = F.concat_ws(" ", F.concat(route, F.lit(":")), action, element_id)
    return F.concat(text, F.lit(" | role="), role, F.lit(" | name="), base_name(name), F.lit(" | href="), F.coalesce(href, F.lit("")))


def executed_pairs(steps: DataFrame, line: str = "line") -> DataFrame:
    """(role, name), folded and distinct, of the lines that are steps."""
    pattern = r"(?s) \| role=(.*?) \| name=(.*?) \| href=(.*)$"
    found = steps.where(F.col(line).rlike(pattern))
    return found.select(F.lower(F.regexp_extract(line, pattern, 1)).alias("role"), F.lower(base_name(F.regexp_extract(line, pattern, 2))).alias("name")).distinct()


def blocked_counts(candidates: DataFrame, step: str = "state") -> DataFrame:
    """(step, blocked) of candidate actions."""
    return candidates.groupBy(step).agg(F.count_if(F.col("reason_blocked").isNotNull()).alias("blocked"))


def chosen_elements(decisions: DataFrame, candidates: DataFrame) -> DataFrame:
    """Decisions (state, element_id, ...) with the first candidate that each chose."""
    rest = [c for c in candidates.columns if c not in ("state", "element_id")]
    first = candidates.groupBy("state", "element_id").agg(F.min_by(F.struct(*rest), F.col("ord")).alias("c"))
    return decisions.join(first, ["state", "element_id"])


def navigation_elements(moves: DataFrame) -> DataFrame:
    """(id, screen_id, role, name, locator_evidence, attributes): the made-up element of a move (screen_id, navigate_to)."""
    to = F.col("navigate_to")
    href = F.create_map(F.lit("href"), to)
    return moves.select(stable_id("element", F.col("screen_id"), F.lit("navigation"), to).alias("id"), "screen_id", F.lit("navigation").alias("role"), to.alias("name"), href.alias("locator_evidence"), href.alias("attributes"))
