"""Projects in a repository's file list, and the one project that owns each file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import base_name

TSCONFIG = r"^tsconfig(\..+)?\.json\z"
# Configuration files in the order they are preferred; others follow by name.
PREFERRED = ("tsconfig.json", "tsconfig.app.json", "tsconfig.lib.json", "tsconfig.base.json", "tsconfig.src.json", "tsconfig.build.json", "tsconfig.spec.json", "tsconfig.test.json")


def directory(path: Column) -> Column:
    d = F.regexp_replace(path, r"/?[^/]*\z", "")
    return F.when(d == "", ".").otherwise(d)


def configs(files: DataFrame) -> DataFrame:
    """(rootPath, tsconfigPath) for every directory with configuration files: the preferred one."""
    name = base_name(F.col("path"))
    rank = F.lit(len(PREFERRED))
    for k, x in reversed(list(enumerate(PREFERRED))):
        rank = F.when(name == x, k).otherwise(rank)
    found = files.where(name.rlike(TSCONFIG)).select(directory(F.col("path")).alias("rootPath"), "path", F.struct(rank.alias("r"), name.alias("n")).alias("k"))
    return found.groupBy("rootPath").agg(F.min_by("path", "k").alias("tsconfigPath"))


def projects(files: DataFrame) -> DataFrame:
    """(rootPath, tsconfigPath, languages, seen): one for each package.json, then one for each other directory with a configuration, and the root in any case. ``seen`` orders them by detection."""
    packages = files.where(base_name(F.col("path")) == "package.json").groupBy(directory(F.col("path")).alias("rootPath")).agg(F.struct(F.lit(0).alias("rule"), F.min("ord").alias("at")).alias("seen"))
    config = configs(files)
    only = files.where(base_name(F.col("path")).rlike(TSCONFIG)).groupBy(directory(F.col("path")).alias("rootPath")).agg(F.struct(F.lit(1).alias("rule"), F.min("ord").alias("at")).alias("seen"))
    root = files.sparkSession.range(1).select(F.lit(".").alias("rootPath"), F.struct(F.lit(2).alias("rule"), F.lit(0).cast("long").alias("at")).alias("seen"))
    roots = packages.unionByName(only).unionByName(root).groupBy("rootPath").agg(F.min("seen").alias("seen"))
    typed = F.array(F.lit("TypeScript"), F.lit("JavaScript"))
    return roots.join(config, "rootPath", "left").select("rootPath", "tsconfigPath", F.when(F.col("tsconfigPath").isNotNull(), typed).otherwise(F.array(F.lit("JavaScript"))).alias("languages"), "seen")


def owners(files: DataFrame, roots: DataFrame) -> DataFrame:
    """(path, rootPath): the deepest project that holds each file. A file meets its own directories by equality, so there is no join by prefix."""
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    each = files.select("path", F.explode(F.concat(F.array(F.lit(".")), above)).alias("rootPath")).distinct()
    depth = F.when(F.col("rootPath") == ".", 0).otherwise(F.length("rootPath"))
    return each.join(roots.select("rootPath"), "rootPath").groupBy("path").agg(F.max_by("rootPath", depth).alias("rootPath"))


def walked_twice(owned: DataFrame) -> DataFrame:
    """Files that more than one project claims; none, if ownership is exclusive."""
    return owned.groupBy("path").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def exclusive(owned: DataFrame) -> DataFrame:
    """``owned``, if no file is claimed by more than one project; else an error that names one."""
    twice = walked_twice(owned).orderBy("path").first()
    if twice:
        raise ValueError(f"{twice['path']} belongs to {twice['n']} projects")
    return owned
