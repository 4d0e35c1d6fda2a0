"""Program and log files as a corpus of whole texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stepledger.columns import attach, col
from stepledger.lineage import patterns as P
from stepledger.operators.ordered import number_rows
from stepledger.settings import TEXT_BYTES, store, task_count

# File endings of parametric sources and of run logs.
SOURCE_ENDING = ".sas"
LOG_ENDING = ".log"

# Lines of a piece of a text.
PIECE_LINES = 1024
BYTE_ORDER_MARK = "\ufeff"


def read_corpus(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """path, text: one row per file. Bytes that are not UTF-8 become the replacement character."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
    return raw.select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def read_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """path, line_no, line of text files of any size: a file is read in splits, by as many tasks as it has.

    A line's number is its place in its split and the lines of the splits before it in the file; those are counted
    once, a row for each split. The lines are written once with their places, so that a task that is run again
    cannot number them otherwise.
    """
    raw = spark.read.format("text").option("recursiveFileLookup", "true").load(paths)
    block = [F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("__block")]
    line = F.explode(F.split(F.make_valid_utf8("value"), P.LINE_BREAK)).alias("line")
    # Rows of a split follow each other in their task, and so do these numbers.
    placed = store(raw.select(*block, line).withColumn("__at", F.monotonically_increasing_id()))
    splits = placed.groupBy("path", "__block").agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n"))
    earlier = Window.partitionBy("path").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("__before", F.coalesce(F.sum("__n").over(earlier), F.lit(0))).drop("__n")
    numbered = attach(placed, splits, ["path", "__block"])
    return numbered.select("path", (F.col("__at") - F.col("__first") + F.col("__before") + 1).alias("line_no"), "line")


def read_pieces(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """path, piece, text of program files of any size: joined in order of ``piece``, the texts are those of ``read_corpus``.

    A file is read in splits, by as many tasks as it has, and a piece is some lines of a split. An empty file, or one of a
    byte order mark only, has none.
    """
    raw = spark.read.format("text").option("lineSep", "\n").option("recursiveFileLookup", "true").load(paths)
    meta = {"path": "file_path", "__size": "file_size", "__block": "file_block_start"}
    rows = program_files(raw.select(*[F.col(f"_metadata.{m}").alias(c) for c, m in meta.items()], "value"))
    # Rows of a split follow each other in their task, and so do these numbers.
    rows = rows.withColumn("__at", F.monotonically_increasing_id())
    keys = [*meta, "__no"]
    dealt = spread(rows.withColumn("__no", F.floor(F.col("__at") / PIECE_LINES)), keys)
    lines = dealt.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("__at", "value"))).alias("lines"))
    text = F.array_join(F.transform("lines", lambda x: F.concat(x["value"], F.lit("\n"))), "")
    place = F.struct(F.col("__block").alias("block"), F.col("__no").alias("no")).alias("piece")
    # The path is in the form of a URI here, in which a plus is no blank.
    path = F.url_decode(F.replace(F.col("path"), F.lit("+"), F.lit("%2B"))).alias("path")
    read = lines.select(path, "__size", place, text.alias("text"))
    read = store(read.select("path", "__size", "piece", F.octet_length("text").alias("__bytes"), F.make_valid_utf8("text").alias("text")))
    # Lines come without a mark at the start of a file, and their last one with a line feed; the sizes tell.
    ends = read.groupBy("path").agg((F.first("__size") - F.sum("__bytes")).alias("__more"), F.min("piece").alias("__first"), F.max("piece").alias("__last"))
    marked = F.when((F.col("__more") > 0) & (F.col("piece") == F.col("__first")), F.lit(BYTE_ORDER_MARK)).otherwise("")
    cut = (F.col("__more") % 3 != 0) & (F.col("piece") == F.col("__last"))
    text = F.concat(marked, F.when(cut, F.substring("text", F.lit(1), F.length("text") - 1)).otherwise(F.col("text")))
    return attach(read, store(ends.filter("__more != 0")), ["path"]).select("path", "piece", F.when(F.col("__more").isNull(), F.col("text")).otherwise(text).alias("text"))


def whole_texts(pieces: DataFrame) -> DataFrame:
    """path, text: the pieces of each file joined."""
    found = pieces.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("piece", "text"))).alias("s"))
    return found.select("path", F.array_join(F.transform("s", lambda s: s["text"]), "").alias("text"))


def spread(corpus: DataFrame, by: str | list[str] = "program", tasks: int = 0) -> DataFrame:
    """Texts dealt over the tasks by the bytes they come from: lexing a text costs far more than moving it once.

    ``tasks`` is the least number of them, for texts that are many more bytes than what they come from.
    """
    return corpus.repartition(max(task_count(corpus, TEXT_BYTES), tasks), *([by] if isinstance(by, str) else by))


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)$", 1)


def stem(path: Column) -> Column:
    """The path without its ending."""
    return F.regexp_replace(path, r"\.[^./]+$", "")


def program_files(corpus: DataFrame) -> DataFrame:
    name = F.lower(F.col("path"))
    return corpus.filter(name.endswith(SOURCE_ENDING) | name.endswith(LOG_ENDING))


def pair_sources(corpus: DataFrame) -> DataFrame:
    """Every program with the parametric source beside its log, null where there is none."""
    name = F.lower(F.col("path"))
    sources = corpus.filter(name.endswith(SOURCE_ENDING)).select(
        stem(F.col("path")).alias("stem"), F.col("text").alias("source")
    )
    keyed = corpus.withColumn("stem", F.when(name.endswith(LOG_ENDING), stem(F.col("path"))))
    return keyed.join(sources, "stem", "left").drop("stem")


def manifest_order(manifest: DataFrame, folder: str = "") -> DataFrame:
    """Execution order from manifest lines (``line_no``, ``line``): comments and blanks dropped, paths made absolute."""
    path = F.trim("line")
    kept = manifest.filter((path != "") & ~path.startswith("#"))
    full = F.when(path.startswith("/") | path.contains(":/"), path).otherwise(
        F.concat(F.lit(folder.rstrip("/") + "/" if folder else ""), path)
    )
    return number_rows(kept.select("line_no", full.alias("path")), [], ["line_no"], "file_no").select("file_no", "path")


def ordered_by_manifest(corpus: DataFrame, order: DataFrame) -> DataFrame:
    """The listed files in their order. A listed file that the corpus lacks stays, with null columns: see ``absent_files``."""
    return order.join(corpus, "path", "left")


def absent_files(corpus: DataFrame, order: DataFrame) -> DataFrame:
    """Listed files that the corpus lacks."""
    return order.join(corpus.select("path"), "path", "left_anti")


def ordered_by_path(corpus: DataFrame, project: str = "project") -> DataFrame:
    """File numbers in path order within each project; rows of one path are told apart by digests of their texts, not by the texts."""
    texts = [f.name for f in corpus.schema.fields if f.name not in (project, "path") and f.dataType.simpleString() in ("string", "binary")]
    digests = {f"__digest{i}": F.sha2(col(c), 256) for i, c in enumerate(texts)}
    return number_rows(corpus.withColumns(digests), [project], ["path"], "file_no", texts).drop(*digests)
