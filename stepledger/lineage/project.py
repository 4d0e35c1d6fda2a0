"""Projects of program files: from a folder of logs and sources to the steps and edges of each project."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stepledger.lineage.graph import edges
from stepledger.lineage.logs import flatten_pieces
from stepledger.lineage.steps import extract_steps_of_pieces, renumber, step_io
from stepledger.settings import store
from stepledger.sources.corpus import (
    LOG_ENDING,
    manifest_order,
    ordered_by_manifest,
    ordered_by_path,
    pair_sources,
    program_files,
    read_corpus,
    read_pieces,
    whole_texts,
)


@dataclass
class Project:
    """``files``: project, path, file_no, text, source; ``steps``: numbered through each project; ``edges`` between them."""

    files: DataFrame
    steps: DataFrame
    edges: DataFrame


def folder_of(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)/[^/]+$", 1)


def read_project(
    spark: SparkSession, paths: str | list[str], project: Column | None = None, manifest: DataFrame | None = None, folder: str = ""
) -> Project:
    """Scan the files, pair logs with sources, put them in order, flatten, cut into steps and link.

    A program is a log, or a source that no log stands beside. The order is that of the paths inside each project, or
    that of ``manifest`` (``line_no, line``), whose paths are relative to ``folder``. ``project`` is a column of
    ``path``, the name of its folder if none is given. Datasets are shared inside a project.
    """
    found = program_files(read_corpus(spark, paths)).select("path")
    named = found.withColumn("project", folder_of(F.col("path")) if project is None else project)
    # Paths stand for the texts, which are read in pieces: none of them is in one row.
    paired = pair_sources(named.withColumn("text", F.col("path")))
    logged = paired.filter(F.lower("path").endswith(LOG_ENDING))
    beside = logged.select(F.regexp_replace("path", r"\.[^./]+$", "").alias("stem"))
    alone = paired.filter(~F.lower("path").endswith(LOG_ENDING)).withColumn("stem", F.regexp_replace("path", r"\.[^./]+$", ""))
    programs = logged.unionByName(alone.join(beside, "stem", "left_anti").drop("stem"))
    if manifest is None:
        files = ordered_by_path(programs, "project")
    else:
        files = ordered_by_manifest(programs, manifest_order(manifest, folder)).filter("text is not null")
    files = store(files.select("project", "path", "file_no", "source"))
    pieces = read_pieces(spark, paths)
    listed = files.select(F.col("path").alias("program"))
    flat = flatten_pieces(pieces.withColumnRenamed("path", "program").join(listed, "program", "left_semi"))
    own = files.select(F.col("path").alias("program"), "project", "file_no")
    # A text that is listed several times is so many texts.
    found_steps = extract_steps_of_pieces(flat).withColumnRenamed("idx", "step_no").join(listed, "program").join(own, "program")
    steps = store(renumber(found_steps.drop("label"), "project", ["file_no", "step_no"]))
    return Project(with_texts(files, pieces), steps, edges(step_io(steps, "project"), "project"))


def with_texts(files: DataFrame, pieces: DataFrame) -> DataFrame:
    """The files with their whole texts, which are put together where they are asked for; ``source`` is a path before."""
    texts = whole_texts(pieces)
    own = files.join(texts, "path", "left").withColumn("text", F.coalesce("text", F.lit("")))
    sources = texts.select(F.col("path").alias("source"), F.col("text").alias("__source"))
    source = F.when(F.col("source").isNotNull(), F.coalesce("__source", F.lit("")))
    return own.join(sources, "source", "left").select("project", "path", "file_no", "text", source.alias("source"))
