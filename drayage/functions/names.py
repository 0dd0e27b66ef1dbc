"""Identifiers, slugs and result paths."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a table name may look like, and what a path part may contain.
IDENTIFIER = r"[A-Za-z_][A-Za-z0-9_]*"
UNSAFE_IN_PATH = r"[^A-Za-z0-9_-]"
EMPTY_SLUG = "unlabeled"


def check_identifier(name: str) -> str:
    if not re.fullmatch(IDENTIFIER, name):
        raise ValueError(f"invalid table name {name!r}")
    return name


def slug(col: Column) -> Column:
    """Every unsafe character becomes ``-``; nothing at all becomes ``unlabeled``."""
    safe = F.regexp_replace(F.coalesce(col, F.lit("")), UNSAFE_IN_PATH, "-")
    return F.when(safe == "", F.lit(EMPTY_SLUG)).otherwise(safe)


def result_path(day: Column, cohort: Column, tool: Column, scenario: Column, route: Column,
                dataset: Column, topology: Column) -> Column:
    """``day/cohort/tool/scenario-route-dataset-topology.json`` with every part slugged."""
    name = F.concat_ws("-", slug(scenario), slug(route), slug(dataset), slug(topology))
    return F.concat_ws("/", slug(day), slug(cohort), slug(tool), F.concat(name, F.lit(".json")))


def utc_day(started_at: Column, instant: bool = False) -> Column:
    """UTC day of a start time: a zoneless time is taken as UTC, an instant is moved to UTC."""
    local = started_at.cast("timestamp_ntz")
    utc = F.convert_timezone(F.current_timezone(), F.lit("UTC"), local) if instant else local
    return F.date_format(utc, "yyyy-MM-dd")
