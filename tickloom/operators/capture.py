"""From window observations to captures, through the privacy layers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tickloom import settings as S
from tickloom.functions import privacy, text as X
from tickloom.operators.lists import listed


def drop_hidden(df: DataFrame) -> DataFrame:
    """Drop windows of hidden apps; they leave no mark."""
    return df.filter(~F.coalesce("hidden", F.lit(False)))


def drop_empty(df: DataFrame, min_length: int = S.MIN_TEXT_LENGTH) -> DataFrame:
    """Drop rows that have no title and hardly any text."""
    return df.filter(
        ~((F.coalesce("title", F.lit("")) == "")
          & (F.length(F.coalesce("text", F.lit(""))) < min_length))
    )


def mark_blocked(
    df: DataFrame, blocked: Sequence[str] | DataFrame = S.BLOCKED_APPS, flag: str = "_blocked"
) -> DataFrame:
    """``df`` with ``flag``: the app is on the blocklist, whatever its case. A long list
    comes as a table of one column."""
    app = F.coalesce("app", F.lit(""))
    if isinstance(blocked, DataFrame):
        names = blocked.select(F.lower(F.col(blocked.columns[0])).alias("name"))
        return listed(df, F.lower(app), names, flag)
    return df.withColumn(flag, privacy.is_app_blocked(app, blocked))


def capture(
    observations: DataFrame,
    blocked: Sequence[str] | DataFrame = S.BLOCKED_APPS,
    sensitive_keys: Sequence[str] = S.SENSITIVE_URL_KEYS,
    extra_title: Sequence[str] = (),
    extra_content: Sequence[str] = (),
    max_length: int = S.MAX_TEXT_LENGTH,
    min_length: int = S.MIN_TEXT_LENGTH,
    keep: Sequence[str] = (),
    only_recorded: bool = True,
) -> DataFrame:
    """What is recorded of each observed window. The first layer that matches
    decides: blocked app, hidden app, private window, sensitive page, empty.

    Needs ``app, hidden, matched, ax_title, identifier, descr, subrole, texts,
    page_url, idle_s, pid, window_id``. Where no element matched, title, text
    and url are empty. ``keep`` names further columns to carry along. With
    ``only_recorded=False`` the dropped windows stay, marked by ``recorded``.

    One narrow stage without a shuffle, but for a list of blocked apps that is a table
    (see ``mark_blocked``); the URL scan runs on text that is already cut.
    """
    matched = F.coalesce("matched", F.lit(False))
    title = F.when(matched, X.strip(F.coalesce("ax_title", F.lit("")))).otherwise("")
    shown = F.col("_blocked") | ~F.coalesce("hidden", F.lit(False))
    seen = mark_blocked(observations, blocked)
    if only_recorded:
        seen = seen.filter(shown)
    read = (
        seen.withColumn("_title", title)
        .withColumn(
            "_private",
            matched & privacy.is_private_window(
                F.col("_title"), F.col("identifier"), F.col("descr"), F.col("subrole")
            ),
        )
        # Nothing is read from blocked apps and private windows.
        .withColumn("_open", matched & ~F.col("_blocked") & ~F.col("_private"))
        .withColumn(
            "_text",
            F.when(
                F.col("_open"),
                X.assemble_text(F.coalesce("texts", F.array().cast("array<string>")),
                                F.col("_title"), max_length),
            ).otherwise(""),
        )
        .withColumn("_text", X.scrub_text_urls(F.col("_text"), sensitive_keys))
        .withColumn(
            "_url",
            F.when(F.col("_open"), X.scrub_url(X.clean_url(F.col("page_url")), sensitive_keys)),
        )
        .withColumn(
            "_sensitive",
            F.col("_open") & privacy.is_sensitive_page(
                F.col("_title"), F.col("_text"), extra_title, extra_content
            ),
        )
    )
    filtered = (
        F.when(F.col("_blocked"), "app_blocked")
        .when(F.col("_private"), "private_window")
        .when(F.col("_sensitive"), "sensitive_page")
    )
    masked_title = (
        F.when(F.col("_blocked"), S.BLOCKED_TITLE)
        .when(F.col("_private"), S.PRIVATE_TITLE)
        .when(F.col("_sensitive"), S.SENSITIVE_TITLE)
        .otherwise(F.col("_title"))
    )
    judged = read.withColumn("filtered", filtered)
    unmasked = F.col("filtered").isNull()
    app = F.coalesce("app", F.lit(""))
    recorded = shown & (
        F.col("filtered").isNotNull()
        | (F.col("_title") != "")
        | (F.length("_text") >= min_length)
    )
    # Settled, so that a filter on any of them does not repeat the regexes.
    row = F.struct(
        F.when(unmasked & (app == ""), S.UNKNOWN_APP).otherwise(app).alias("app"),
        masked_title.alias("title"),
        F.when(unmasked, F.col("_text")).otherwise("").alias("text"),
        F.when(unmasked, F.col("_url")).alias("url"),
        F.col("filtered").alias("filtered"),
        recorded.alias("recorded"),
    )
    made = judged.select(*keep, "pid", "window_id", F.round("idle_s", 1).alias("idle_s"),
                         F.inline(F.array(row)))
    captured = made.filter("recorded") if only_recorded else made
    return captured.select(
        *keep, "app", "title", "text", "url", "pid", "window_id", "idle_s", "filtered",
        *([] if only_recorded else ["recorded"]),
    )
