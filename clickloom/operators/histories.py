"""Click histories as counts instead of texts.

What a user did before a day is kept as changes: one row for each user, item and active day, with the events of that day and the number of the last of them among the user's events. Running
sums over the days of a user and item give the state before any day, so a history is never built as a text or a list of all its events, and its cost
grows with the changes, not with the square of the days. Windows run over the days of a (user, item) or of a user, after rows are summed per day; only the order of events
within a user's day is a window over events.

``events`` are <user, day, ts, id, item> under the given names. Events without an item are no part of a history, and neither are those of the day itself.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _past(*by: str) -> Window:
    return Window.partitionBy(*by).orderBy("day").rowsBetween(Window.unboundedPreceding, -1)


def day_totals(events: DataFrame, user: str = "user_id", item: str = "item") -> DataFrame:
    """<user, day, before>: for each active day of a user, the events with an item before it. An active day needs an event, not an item."""
    totals = events.groupBy(user, "day").agg(F.count(item).alias("n"))
    return totals.select(user, "day", F.coalesce(F.sum("n").over(_past(user)), F.lit(0)).alias("before"))


def day_changes(events: DataFrame, user: str = "user_id", item: str = "item", order: Sequence[str] = ("ts", "id")) -> DataFrame:
    """<user, item, day, n, last>: a day's events of a user with an item, and the number of the last of them among all the user's events with an item, from 1."""
    held = events.where(F.col(item).isNotNull())
    place = F.row_number().over(Window.partitionBy(user, "day").orderBy(*order))
    counted = held.select(user, "day", item, place.alias("_place")).groupBy(user, item, "day").agg(F.count(F.lit(1)).alias("n"), F.max("_place").alias("_place"))
    return counted.join(day_totals(events, user, item), [user, "day"]).select(user, item, "day", "n", (F.col("before") + F.col("_place")).alias("last"))


def states_before(changes: DataFrame, wanted: DataFrame, user: str = "user_id", item: str = "item") -> DataFrame:
    """<user, item, day, times, last>: of each wanted <user, item, day>, the events before the day and the number of the last of them (0 without).

    The wanted days are put among the changes as days without events, so the look-up is the same running sum.
    """
    none = wanted.select(user, item, "day").distinct().select(user, item, "day", F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("last"))
    whole = changes.select(user, item, "day", F.col("n").cast("long").alias("n"), F.col("last").cast("long").alias("last"), F.lit(False).alias("_asked")).unionByName(none.withColumn("_asked", F.lit(True)))
    days = whole.groupBy(user, item, "day").agg(F.sum("n").alias("n"), F.max("last").alias("last"), F.max("_asked").alias("_asked"))
    past = _past(user, item)
    states = days.select(user, item, "day", "_asked", F.coalesce(F.sum("n").over(past), F.lit(0)).alias("times"), F.coalesce(F.max("last").over(past), F.lit(0)).alias("last"))
    return states.where("_asked").drop("_asked")


def candidate_match(rows: DataFrame, events: DataFrame, user: str = "user_id", candidate: str = "candidate", item: str = "item", keep: Sequence[str] = ("id",)) -> DataFrame:
    """<keep..., ad_seen, ad_count, ad_distance>: does the candidate occur in the user's history before the row's day, how often, and how many events from its end (0: never).

    Rows with a null candidate, or of users without events, match nothing.
    """
    events = events.select(user, "day", "ts", "id", F.col(item).alias(item))
    asked = rows.select(*keep, user, "day", F.col(candidate).alias(item))
    states = states_before(day_changes(events, user, item), asked.where(F.col(item).isNotNull()), user, item)
    totals = day_totals(events.unionByName(asked.select(user, "day").distinct(), allowMissingColumns=True), user, item)
    found = asked.join(states, [user, item, "day"], "left").join(totals, [user, "day"], "left")
    count = F.coalesce("times", F.lit(0)).cast("int")
    distance = F.when(F.col("times") > 0, F.col("before") - F.col("last") + 1).otherwise(F.lit(0)).cast("int")
    return found.select(*keep, (count > 0).cast("tinyint").alias("ad_seen"), count.alias("ad_count"), distance.alias("ad_distance"))


def bags(events: DataFrame, user: str = "user_id", item: str = "item") -> DataFrame:
    """<user, day, item, times>: the items of a user's history before each active day with their counts; no row for a day without history.

    A change holds until the next change of the same user and item; it is handed to the active days in between. So nothing is made but the rows of the result.
    """
    changes = events.where(F.col(item).isNotNull()).groupBy(user, item, "day").agg(F.count(F.lit(1)).alias("n"))
    by_day = Window.partitionBy(user, item).orderBy("day")
    held = changes.select(user, item, "day", F.sum("n").over(by_day.rowsBetween(Window.unboundedPreceding, 0)).alias("times"), F.lead("day").over(by_day).alias("_until"))
    days = events.groupBy(user).agg(F.sort_array(F.collect_set("day")).alias("_days"))
    open_days = F.filter("_days", lambda d: (d > F.col("day")) & (F.col("_until").isNull() | (d <= F.col("_until"))))
    return held.join(days, user).select(user, F.explode(open_days).alias("day"), item, "times")


def history_items(events: DataFrame, user: str = "user_id", item: str = "item") -> DataFrame:
    """<item>: every item that occurs in some history, that is, before the last active day of its user; once."""
    first = events.where(F.col(item).isNotNull()).groupBy(user, item).agg(F.min("day").alias("_first"))
    last = events.groupBy(user).agg(F.max("day").alias("_last"))
    return first.join(last, user).where(F.col("_first") < F.col("_last")).select(item).distinct()


def item_arrays(bag: DataFrame, code: Column, keep: Sequence[str] = ("user_id", "day")) -> DataFrame:
    """<keep..., codes, times>: a bag as two arrays, at most one entry for each item."""
    pairs = F.sort_array(F.collect_list(F.struct(code.alias("code"), F.col("times").cast("int").alias("times"))))
    return bag.groupBy(*keep).agg(pairs.alias("_pairs")).select(*keep, F.col("_pairs.code").alias("codes"), F.col("_pairs.times").alias("times"))
