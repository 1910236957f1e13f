"""Scalar functions on paths, names and labels, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import NAMELESS


def norm_path(path: Column) -> Column:
    """Slashes forward, one leading ``./`` less."""
    forward = F.replace(path, F.lit("\\"), F.lit("/"))
    return F.when(F.startswith(forward, F.lit("./")), F.substr(forward, F.lit(3))).otherwise(forward)


def canonical_name(name: Column) -> Column:
    """The property an accessor is named for; other names unchanged."""
    part = lambda pattern: F.nullif(F.regexp_extract(name, pattern, 1), F.lit(""))
    return F.coalesce(part(r"^\[(?:get|set)\](.+)\z"), part(r"^(?:get|set)(?:ter)?[: ](.+)\z"), name)


def is_accessor(name: Column) -> Column:
    return canonical_name(name) != name


def is_matchable(name: Column) -> Column:
    """Whether a name identifies anything; tested on the name as it is written."""
    return F.coalesce((name != "") & ~name.isin(*NAMELESS), F.lit(False))


def bare_name(label: Column) -> Column:
    """Without a leading dot and trailing ``()``."""
    return F.regexp_replace(F.regexp_replace(label, r"^\.", ""), r"\(\)\z", "")


def line_marker(marker: Column) -> Column:
    """The number in ``L12``; null for anything else."""
    return F.nullif(F.regexp_extract(marker, r"^L(\d+)\z", 1), F.lit("")).try_cast("int")


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def whole_number(text: Column) -> Column:
    """The leading integer of a cell; null without one."""
    return F.nullif(F.regexp_extract(text, r"^\s*([+-]?\d+)", 1), F.lit("")).try_cast("int")


def project_slug(root: Column) -> Column:
    """A file name for a project root."""
    s = F.regexp_replace(F.regexp_replace(root, "[^A-Za-z0-9]+", "_"), r"^_+|_+\z", "")
    return F.when(s == "", "root").otherwise(s)
