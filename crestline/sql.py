"""SQL access: detections and surfaces as temporary views."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .plans.detection import detection
from .sources.tables import SURFACES

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def register_tables(spark: SparkSession, sf_dir: str) -> None:
    for name in TABLES:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


def register_ridges(spark: SparkSession, sf_dir: str, surface: str = "emb", t: float = 1.0, metric: str = "N") -> None:
    """Views surface, edges, cells, points, segments, lines and line_points of one surface."""
    image = SURFACES[surface](spark, sf_dir)
    d = detection(image, t, metric)
    views = {"surface": image, "edges": d.edges, "cells": d.cells(), "points": d.points(), "segments": d.segments(), "lines": d.lines(), "line_points": d.line_points()}
    for name, df in views.items():
        df.createOrReplaceTempView(name)
