"""Literal statuses for what the corpus lacks: links, hashtags, mentions, reposts, no language."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

ROWS: list[tuple[int, str | None, str]] = [
    (-1, "en", "RT @alice: the 3 best links http://t.co/AbC1 and https://example.org/x?y=1 #spark #2024 /via @bob_b"),
    (-2, "en", "rt lower case repost (via someone) 12,345.67 and 8:30"),
    (-3, None, "no language here &amp; an entity &lt;b&gt; caf&eacute;"),
    (-4, "de", "plain ascii in german /by me /cc you"),
    (-5, "fr", "déjà vu #été @léa"),
    (-6, "en", "MB00012 is a topic [via: x] /RT: y"),
    (-7, "en", ""),
    (-8, "es", "https://bit.ly/Z8ZoFe"),
    (-9, "en", "@project_mmixer/list said hi"),
    (-10, "en", "#hashtag first"),
]
SQL = "SELECT * FROM (VALUES " + ", ".join(f"(CAST({i} AS BIGINT), {'NULL' if lang is None else repr(lang)}, '{text}')" for i, lang, text in ROWS) + ") AS t(id, lang, text)"


def frame(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ROWS, "id bigint, lang string, text string")
