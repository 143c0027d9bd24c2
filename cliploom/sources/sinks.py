"""Writers: tables, documents, and reports of small results."""

from __future__ import annotations

import html
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cliploom.functions.captions import escaped
from cliploom.sources.files import exists, write_text

#: Rows that a page or a document written by the driver holds at most; larger results go to files of a folder.
REPORT_ROWS = 10_000


def write_csv(df: DataFrame, path: str, **new_columns) -> None:
    """CSV with a header; columns that are there already are not added again. Blanks at the ends of values are kept; an
    empty text cannot be told from a null and is read as one."""
    for name, column in new_columns.items():
        if name not in df.columns:
            df = df.withColumn(name, column)
    df.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def write_samples(df: DataFrame, path: str, key: str = "uttid") -> int:
    """Appends the samples whose key is not in the table yet, in folders by shape; returns how many. Running it again adds
    nothing."""
    spark = df.sparkSession
    rows = df
    if exists(spark, path):
        rows = df.join(spark.read.parquet(path).select(key), key, "left_anti")
    rows = rows.dropDuplicates([key]).persist()
    n = rows.count()
    if n:
        rows.write.mode("append").partitionBy("num_frame", "height", "width").parquet(path)
    rows.unpersist()
    return n


def _small(df: DataFrame) -> list:
    rows = df.limit(REPORT_ROWS + 1).collect()
    if len(rows) > REPORT_ROWS:
        raise ValueError(f"more than {REPORT_ROWS} rows; write them as a table")
    return rows


def write_json_document(df: DataFrame, path: str) -> None:
    """One indented JSON array."""
    write_text(df.sparkSession, path, json.dumps([r.asDict(recursive=True) for r in _small(df)], indent=2, ensure_ascii=False, default=str))


def html_table(df: DataFrame, title: str) -> str:
    """A page with one row per row; every value is escaped in the plan."""
    cells = F.concat(*(F.concat(F.lit("<td>"), F.coalesce(escaped(F.col(c).cast("string")), F.lit("")), F.lit("</td>")) for c in df.columns))
    rows = [r[0] for r in _small(df.select(F.concat(F.lit("<tr>"), cells, F.lit("</tr>"))))]
    head = "".join(f"<th>{c}</th>" for c in df.columns)
    return f"<!doctype html><meta charset=utf-8><title>{title}</title><table><tr>{head}</tr>{''.join(rows)}</table>"


def validation_page(videos: DataFrame, title: str) -> str:
    """A page with a grid of videos for each step; (step, kind, idx, slug, path) as ``validation_videos`` gives them. Videos
    are linked, not embedded."""
    label = F.initcap(F.translate("kind", "_", " "))
    card = F.concat(F.lit('<div class="card"><video controls preload="metadata" src="'), escaped(F.col("path")), F.lit('"></video><div>#'), F.col("idx").cast("string"), F.lit(" \u2014 "), label, F.lit("</div><div>"), escaped(F.col("slug")), F.lit("</div></div>"))
    rows = _small(videos.select("step", "kind", "idx", card.alias("card")).orderBy("step", "kind", "idx"))
    body, step = [], None
    for r in rows:
        if r.step != step:
            body.append(("" if step is None else "</div>") + f'<div class="step-header">Step {r.step}</div><div class="grid">')
            step = r.step
        body.append(r.card)
    return f"<!doctype html><meta charset=utf-8><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1><div>{len(rows)} videos</div>{''.join(body)}{'</div>' if rows else ''}"


def leaderboard_metadata(board: DataFrame, timestamp: str | None = None, selected: bool = False, raw: bool = False) -> DataFrame:
    """(Property, Value) of the sheet that goes with a leaderboard of one row per model."""
    metrics = len([c for c in board.columns if c not in ("model", "model_name")])
    fixed = [("timestamp", timestamp or "N/A"), ("num_metrics", str(metrics)), ("filtered", "Yes" if selected else "No"), ("format", "Raw Values" if raw else "Percentage")]
    models = board.agg(F.lit("num_models").alias("Property"), F.count(F.lit(1)).cast("string").alias("Value"))
    return board.sparkSession.createDataFrame(fixed, "Property string, Value string").unionByName(models)


def statistics_report(df: DataFrame, title: str) -> str:
    """Columns of a one-row or small result as lines of text."""
    lines = [title, "=" * len(title)]
    for r in _small(df):
        lines += [f"{k}: {v}" for k, v in r.asDict().items()] + [""]
    return "\n".join(lines)
