"""An impression table, with click histories, made from the event and order tables.

History is taken as of the end of the previous active day, the way daily
feature jobs produce it. Rows of a user are therefore summed per day before
anything is ordered (a map-side partial sum, so one very active user does not
load one task), the window runs over a user's days, and the events meet the
result once, on (user_id, day).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.hashing import keyed_hash32
from ..session import configure
from .tables import spread

ITEM_SPACE = 500
PREDICTION_MODELS = {"a": 0.3, "b": 0.2, "c": 0.1}
FIRST_TEST_DAY = "2024-01-25"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def spread_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table whose rows cost much work each, dealt to all cores if it is small."""
    return spread(table(spark, sf_dir, name), f"{sf_dir}/{name}.parquet")


def _number(condition: Column) -> Column:
    return F.when(condition, F.lit(1)).otherwise(F.lit(0))


def events(spark: SparkSession, sf_dir: str, heavy: bool = False) -> DataFrame:
    """Columns that need the event row alone. ``heavy`` announces much work per row."""
    user, ts = F.col("user_id"), F.col("ts")
    item = F.get_json_object("props", "$.k")
    return (spread_table if heavy else table)(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        user,
        ts,
        F.to_date(ts).alias("day"),
        _number(F.col("event_type") == "click").alias("clicked"),
        F.lpad(F.hour(ts).cast("string"), 2, "0").alias("hour"),
        (F.weekday(ts) + 1).cast("string").alias("day_of_week"),
        F.when(user % 10 == 0, F.lit(None).cast("string"))
        .when(user % 2 == 0, F.lit("2.0"))
        .otherwise(F.lit("1.0"))
        .alias("gender"),
        (user % 2).cast("int").alias("l_feat_1"),
        F.when(user % 7 != 0, (user % 3 % 2).cast("int")).alias("l_feat_8"),
        item.cast("int").alias("l_feat_14"),
        F.col("event_type"),
        F.col("value"),
    )


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per user: profile columns."""
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        key.alias("user_id"),
        (F.col("c_nationkey") % 8 + 1).cast("string").alias("age_group"),
        F.when(F.col("c_acctbal") >= 0, F.col("c_mktsegment")).alias("inventory_id"),
        F.col("c_nationkey").alias("l_feat_2"),
        (key % 11 - 5).cast("int").alias("l_feat_3"),
        F.col("c_acctbal").alias("feat_b_1"),
    )


def order_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per user: sums over the orders."""
    price, urgency, status = F.col("o_totalprice"), F.col("o_orderpriority"), F.col("o_orderstatus")

    def count_of(condition: Column) -> Column:
        return F.sum(_number(condition)).cast("double")

    return (
        table(spark, sf_dir, "orders")
        .groupBy(F.col("o_custkey").alias("user_id"))
        .agg(
            F.count(F.lit(1)).cast("double").alias("history_b_1"),
            F.avg(price).alias("history_b_2"),
            count_of(urgency == "1-URGENT").alias("history_b_3"),
            count_of(urgency == "2-HIGH").alias("feat_c_1"),
            count_of(urgency == "3-MEDIUM").alias("feat_c_2"),
            count_of(urgency == "5-LOW").alias("feat_c_3"),
            F.sum(F.when(status == "O", price)).alias("feat_d_1"),
            F.sum(F.when(status == "F", price)).alias("feat_d_2"),
            F.min(price).alias("feat_e_1"),
            F.max(price).alias("feat_e_2"),
        )
    )


def day_history(ev: DataFrame) -> DataFrame:
    """One row per user and active day: numbers known before that day."""
    kind, value = F.col("event_type"), F.col("value")

    def total(name: str) -> Column:
        return F.sum(F.when(kind == name, value).otherwise(F.lit(0.0)))

    daily = ev.groupBy("user_id", "day").agg(
        F.sum(_number(kind == "click")).alias("clicks"),
        F.sum(_number(kind == "error")).alias("errors"),
        F.sum(_number(kind == "view")).alias("views"),
        F.count(F.lit(1)).alias("n"),
        F.sum(value).alias("total"),
        total("view").alias("view_total"),
        total("signup").alias("signup_total"),
        total("error").alias("error_total"),
    )
    days = Window.partitionBy("user_id").orderBy("day")
    past = days.rowsBetween(Window.unboundedPreceding, -1)
    return daily.select(
        "user_id",
        "day",
        (F.sum("clicks").over(past) / (F.sum("errors").over(past) + 1)).alias("history_a_1"),
        (F.sum("total").over(past) / F.sum("n").over(past)).alias("history_a_2"),
        (F.sum("clicks").over(past) / (F.sum("views").over(past) + 1)).alias("history_a_3"),
        (-F.sum("total").over(past)).alias("history_a_4"),
        F.lag("view_total").over(days).alias("feat_a_1"),
        F.lag("signup_total").over(days).alias("feat_a_2"),
        F.lag("error_total").over(days).alias("feat_a_3"),
        F.lag(F.col("total") / F.col("n"), 2).over(days).alias("feat_b_2"),
    )


def day_sequences(ev: DataFrame, keep: int | None = None) -> DataFrame:
    """One row per user and active day: the items of all earlier days, oldest first.

    ``keep`` leaves only the newest ``keep`` items. Only the newest ``keep`` events of a day can matter then, and Spark
    applies that rank limit before the shuffle; every active day holds an item, so ``keep`` day rows back is far enough.
    """
    rows = ev.select("user_id", "day", "ts", "id", F.col("l_feat_14").cast("string").alias("item"))
    if keep is not None:
        newest = Window.partitionBy("user_id", "day").orderBy(F.col("ts").desc(), F.col("id").desc())
        rows = rows.withColumn("_rank", F.row_number().over(newest)).where(F.col("_rank") <= keep)
    ordered = F.array_sort(F.collect_list(F.struct("ts", "id", "item"))).getField("item")
    past = Window.partitionBy("user_id").orderBy("day")
    if keep is None:
        text = F.nullif(F.array_join(ordered, ","), F.lit(""))
        day_items = rows.groupBy("user_id", "day").agg(text.alias("_text"))
        past = past.rowsBetween(Window.unboundedPreceding, -1)
        return day_items.select("user_id", "day", F.nullif(F.array_join(F.collect_list("_text").over(past), ","), F.lit("")).alias("seq"))
    day_items = rows.groupBy("user_id", "day").agg(ordered.alias("_items"))
    held = F.flatten(F.collect_list("_items").over(past.rowsBetween(-keep, -1)))
    newest_items = F.slice("_held", F.greatest(F.size("_held") - keep + 1, F.lit(1)), F.lit(keep))
    return day_items.withColumn("_held", held).select(
        "user_id", "day", F.nullif(F.array_join(newest_items, ","), F.lit("")).alias("seq")
    )


def impressions(spark: SparkSession, sf_dir: str, *parts: str) -> DataFrame:
    """The impression table with the asked-for parts: ``users``, ``orders``, ``history``, ``seq``.

    Parts that are not asked for cost nothing.
    """
    ev = events(spark, sf_dir)
    side = None
    if "users" in parts:
        side = users(spark, sf_dir)
    if "orders" in parts:
        totals = order_totals(spark, sf_dir)
        side = side.join(totals, "user_id", "left") if side is not None else totals
    by_day = [f(ev) for name, f in (("history", day_history), ("seq", day_sequences)) if name in parts]
    if by_day:
        profile = by_day[0] if len(by_day) == 1 else by_day[0].join(by_day[1], ["user_id", "day"])
        if side is not None:
            profile = profile.join(side, "user_id", "left")
        return ev.join(profile, ["user_id", "day"])
    if side is None:
        return ev
    return ev.join(side, "user_id", "left")


def is_train() -> Column:
    return F.col("day") < F.lit(FIRST_TEST_DAY).cast("date")


def word_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """<id, lang, source, n_chars, seq>: one sequence per document, one item per word.

    Whole texts of 1 to 20,000 words, so every length bin occurs. Two fixed
    shares of the rows have a missing and an empty sequence.
    """
    item = F.transform(
        F.split("text", " "),
        lambda w: ((F.ascii(w) * 37 + F.length(w) * 11) % ITEM_SPACE).cast("string"),
    )
    share = F.col("doc_id") % 50
    return spread_table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"),
        "lang",
        "source",
        "n_chars",
        F.when(share == 0, F.lit(None).cast("string"))
        .when(share == 1, F.lit(""))
        .otherwise(F.array_join(item, ","))
        .alias("seq"),
    )


def fold_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """<id, clicked, model, fold, pred>: seeded stand-ins for three models and five folds."""
    ev = events(spark, sf_dir, heavy=True).select("id", "clicked")
    cells = []
    for model, w in PREDICTION_MODELS.items():
        for fold in range(1, 6):
            noise = (keyed_hash32("id", model, fold) % 1000) / F.lit(1000.0)
            cells.append(
                F.struct(
                    F.lit(model).alias("model"),
                    F.lit(fold).alias("fold"),
                    (F.lit(w) * F.col("clicked") + F.lit(1 - w) * noise).alias("pred"),
                )
            )
    return ev.select("id", "clicked", F.inline(F.array(*cells)))


def tied_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """<id, y, s>: one score per event out of about 2000 values, so ties are common."""
    noise = (keyed_hash32("id", "x") % 1000) / F.lit(1000.0)
    return events(spark, sf_dir).select(
        "id", F.col("clicked").alias("y"), (0.3 * F.col("clicked") + 0.7 * noise).alias("s")
    )


def model_predictions(spark: SparkSession, sf_dir: str, model: str) -> DataFrame:
    """<id, clicked>: the prediction file of one stand-in model."""
    w = PREDICTION_MODELS[model]
    noise = (keyed_hash32("id", model) % 1000) / F.lit(1000.0)
    return events(spark, sf_dir).select("id", (F.lit(w) * F.col("clicked") + F.lit(1 - w) * noise).alias("clicked"))
