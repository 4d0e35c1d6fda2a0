"""Statements to steps, and the datasets each step reads and writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepledger.columns import attach, col
from stepledger.lineage import patterns as P
from stepledger.lineage.lexing import bare_name, first_word, proc_name, split_statements, with_library
from stepledger.operators.ordered import number_rows, running_sum, shift
from stepledger.settings import TEXT_BYTES, store
from stepledger.sources.corpus import spread


def statements(programs: DataFrame, text: str = "text") -> DataFrame:
    """One row per statement, ``stmt_no`` from 0."""
    kept = [c for c in programs.columns if c != text]
    return programs.select(*kept, F.posexplode(split_statements(F.col(text))).alias("stmt_no", "statement"))


def step_numbers(stmts: DataFrame, program: str = "program") -> DataFrame:
    """Number the steps: one starts at ``data`` or ``proc``, and after ``run``, ``quit`` or ``endsas``."""
    known = stmts.withColumn("word", first_word(F.col("statement")))
    prior = shift(known, [program], ["stmt_no"], "word", "prior")
    starts = F.col("word").isin("data", "proc") | F.col("prior").isNull() | F.col("prior").isin(P.TERMINATORS)
    counted = running_sum(prior, [program], ["stmt_no"], {"idx": F.when(starts, 1).otherwise(0).cast("long")})
    return counted.withColumn("idx", F.col("idx") - 1).drop("prior")


def extract_steps(programs: DataFrame, text: str = "text", library: str = "work") -> DataFrame:
    """Steps with kind, procedure, statements, text, reads, writes and label.

    A program text is cut inside its own row, in one pass over its statements, so
    no statement is shuffled and nothing is grouped.
    """
    split = programs.select("program", split_statements(F.col(text)).alias("all"))
    worded = split.select("program", "all", F.transform("all", first_word).alias("words"))

    def begins(place: Column) -> Column:
        word, prior = F.get("words", place - 1), F.get("words", place - 2)
        return (place == 1) | word.isin("data", "proc") | prior.isin(P.TERMINATORS)

    # Not a row filter on the size: it would be pushed below the lexing and cut every text twice.
    places = F.when(F.size("all") > 0, F.sequence(F.lit(1), F.size("all")))
    firsts = worded.withColumn("firsts", F.filter(places, begins))

    def cut_at(first: Column, number: Column) -> Column:
        after = F.coalesce(F.get("firsts", number + 1), F.size("all") + 1)
        return F.struct(F.slice("all", first, after - first).alias("statements"), F.get("words", first - 1).alias("word"))

    rows = firsts.select("program", F.posexplode(F.transform("firsts", cut_at)).alias("idx", "step"))
    statements_, word = F.col("step.statements"), F.col("step.word")
    parts = rows.select(
        "program",
        F.col("idx").cast("long").alias("idx"),
        F.when(word.isin("data", "proc"), word).otherwise(F.lit("other")).alias("kind"),
        F.when(word == "proc", proc_name(statements_[0])).alias("proc"),
        statements_.alias("statements"),
        F.concat(F.array_join(statements_, ";\n"), F.lit(";")).alias("text"),
    )
    return with_label(with_io(parts, library))


# What a piece of a text can start in, as the characters that would open it there: code, quotes of both kinds, a comment.
OPENINGS = ["", "'", '"', "/*"]


def extract_steps_of_pieces(pieces: DataFrame, library: str = "work") -> DataFrame:
    """``extract_steps`` for programs given in pieces of whole lines (``program, piece, text``), however many.

    Pieces become parts of whole steps, which are cut inside their rows as texts are; then the steps are numbered
    through by the numbers of steps in the parts before. No program meets in one row, but for a few numbers a piece.
    """
    parts = whole_steps(pieces)
    found = extract_steps(parts.select(F.struct("program", "part").alias("program"), "text"), library=library).drop("label")
    found = store(found.select("program.program", "program.part", *[c for c in found.columns if c != "program"]))
    sizes = found.groupBy("program", "part").agg((F.max("idx") + 1).alias("__n"))
    earlier = Window.partitionBy("program").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = store(sizes.select("program", "part", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before")))
    numbered = attach(found, before, ["program", "part"]).withColumn("idx", F.col("idx") + F.col("__before"))
    return with_label(numbered.drop("part", "__before"))


def whole_steps(pieces: DataFrame) -> DataFrame:
    """program, part, text: the texts cut before steps, about as often as they were into pieces.

    Each piece is read from every opening: what it leaves open, and how far the step goes that it starts inside.
    A program's pieces then say, one after the other, which opening each of them has; only these numbers meet. A part runs
    from the first step that begins in a piece up to the next such step, or, before the first, from the start of the program.
    """
    opening = F.array(*[F.lit(o) for o in OPENINGS])

    def read_from(opened: Column) -> Column:
        text = F.concat(opened, F.col("text"))
        left = F.array_position(opening, F.regexp_extract(text, P.LEFT_OPEN, 1)).cast("int")
        inside = F.length(F.regexp_extract(text, P.BEFORE_STEP, 0)) - F.length(opened)
        return F.struct(left.alias("left"), F.greatest(inside, F.lit(0)).alias("inside"))

    ways = store(pieces.select("program", "piece", F.octet_length("text").cast("long").alias("bytes"), F.transform(opening, read_from).alias("ways")))
    listed = ways.groupBy("program").agg(F.sort_array(F.collect_list(F.struct("piece", "ways"))).alias("pieces"))
    start = F.struct(F.lit(1).alias("at"), F.lit("").alias("seen"))

    def onwards(state: Column, piece: Column) -> Column:
        return F.struct(F.get(piece["ways"], state["at"] - 1)["left"].alias("at"), F.concat(state["seen"], state["at"].cast("string")).alias("seen"))

    # One digit a piece, so that what is gone through grows by a byte for each.
    seen = listed.select("program", "pieces", F.split(F.aggregate("pieces", start, onwards)["seen"], "").alias("seen"))
    cut = F.transform("pieces", lambda p, i: F.struct(p["piece"].alias("piece"), F.get(p["ways"], F.get("seen", i).cast("int") - 1)["inside"].alias("inside")))
    cuts = seen.select("program", F.inline(cut))
    earlier = Window.partitionBy("program").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    begun = F.when(F.col("inside") > 0, F.col("piece"))
    cuts = store(cuts.select("program", "piece", "inside", F.max(begun).over(earlier).alias("from")))
    tasks = -(-(ways.agg(F.sum("bytes")).first()[0] or 0) // TEXT_BYTES)

    def share(part: str, text: Column) -> Column:
        return F.struct(F.col(part).alias("part"), text.alias("text"))

    placed = attach(pieces, cuts, ["program", "piece"], "inner")
    inside, size = F.col("inside"), F.length("text")
    shares = F.when(inside > 0, F.array(share("from", F.substring("text", F.lit(1), inside)), share("piece", F.substring("text", inside + 1, size))))
    shares = placed.select("program", "piece", F.explode(F.coalesce(shares, F.array(share("from", F.col("text"))))).alias("s"))
    dealt = spread(shares.select("program", "s.part", F.struct("piece", "s.text").alias("s")), ["program", "part"], tasks)
    joined = dealt.groupBy("program", "part").agg(F.sort_array(F.collect_list("s")).alias("s"))
    return joined.select("program", "part", F.array_join(F.transform("s", lambda s: s["text"]), "").alias("text"))


def _keys(names: Column, library: str) -> Column:
    """Dataset keys of the names in first-seen order; unnamed targets are left out."""
    # In two transforms: what a lambda names twice it works out twice.
    keys = F.transform(F.transform(names, bare_name), lambda n: with_library(n, library))
    named = F.filter(keys, lambda k: ~F.regexp_replace(k, r"^[^.]*\.", "").isin(P.UNNAMED))
    return F.array_distinct(named)


def _clause_names(statement: Column, word: Column) -> Column:
    """Dataset tokens of a statement after its keyword; ``key=value`` options are blanked first."""
    rest = F.substr(statement, F.length(word) + 1)
    clause = F.regexp_replace(rest, P.OPTION_PAIR, " ")
    tokens = F.regexp_extract_all(clause, F.lit(P.DATASET_TOKEN), F.lit(0))
    return F.filter(
        tokens,
        lambda t: ~F.lower(F.regexp_extract(t, "^" + P.DATASET_NAME, 0)).isin(P.OPTION_WORDS) | t.contains("."),
    )


def _named_in(statements_: Column, words: list[str]) -> Column:
    picked = F.filter(statements_, lambda s: first_word(s).isin(words))
    return F.flatten(F.transform(picked, lambda s: _clause_names(s, first_word(s))))


def with_io(steps: DataFrame, library: str = "work") -> DataFrame:
    """Add ``inputs`` and ``outputs``, from the row alone."""
    text, stmts = F.col("text"), F.col("statements")

    def found(pattern: str, group: int = 1) -> Column:
        return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))

    options = F.arrays_zip(
        F.transform(found(P.PROC_OPTION, 1), F.lower).alias("key"), found(P.PROC_OPTION, 2).alias("name")
    )
    written = F.filter(options, lambda o: o["key"].isin(P.WRITING_OPTIONS))
    read = F.filter(options, lambda o: ~o["key"].isin(P.WRITING_OPTIONS))
    is_data = F.col("kind") == "data"
    is_sql = F.col("proc").eqNullSafe("sql") & (F.col("kind") == "proc")
    is_proc = F.col("kind") == "proc"
    none = F.array().cast("array<string>")
    outputs = (
        F.when(is_data, _named_in(stmts, ["data"]))
        .when(is_sql, F.concat(found(P.SQL_CREATE), found(P.SQL_INSERT)))
        .when(is_proc, F.transform(written, lambda o: o["name"]))
        .otherwise(none)
    )
    inputs = (
        F.when(is_data, _named_in(stmts, P.READERS))
        .when(is_sql, F.concat(found(P.SQL_FROM), found(P.SQL_JOIN)))
        .when(is_proc, F.transform(read, lambda o: o["name"]))
        .otherwise(none)
    )
    known = steps.withColumns({"inputs": _keys(inputs, library), "outputs": _keys(outputs, library)})
    in_place = F.col("proc").eqNullSafe("sort") & (F.size("outputs") == 0) & (F.size("inputs") > 0)
    return known.withColumn("outputs", F.when(in_place, F.slice("inputs", 1, 1)).otherwise(F.col("outputs")))


def with_label(steps: DataFrame) -> DataFrame:
    """``step007_proc_sort``, ``step003_data_accounts``, ``step000_other``."""
    number = F.when(F.col("idx") < 1000, F.lpad(F.col("idx").cast("string"), 3, "0")).otherwise(
        F.col("idx").cast("string")
    )
    first = F.regexp_replace(F.try_element_at("outputs", F.lit(1)), r"^[^.]*\.", "")
    tail = (
        F.when(F.col("kind") == "proc", F.concat(F.lit("proc_"), F.coalesce("proc", F.lit("proc"))))
        .when(F.col("kind") == "data", F.concat(F.lit("data_"), F.coalesce(first, F.lit("data"))))
        .otherwise(F.lit("other"))
    )
    return steps.withColumn("label", F.concat(F.lit("step"), number, F.lit("_"), tail))


def renumber(steps: DataFrame, project: str, order: list[str], out: str = "idx") -> DataFrame:
    """Number the steps of a project across its files, from 0."""
    numbered = number_rows(steps, [project], order, "__no")
    return numbered.withColumn(out, F.col("__no") - 1).drop("__no")


def step_io(steps: DataFrame, program: str = "program") -> DataFrame:
    """Reads and writes in long form: program, idx, dataset, is_write."""
    sides = F.array(
        F.struct(F.lit(False).alias("is_write"), F.col("inputs").alias("names")),
        F.struct(F.lit(True).alias("is_write"), F.col("outputs").alias("names")),
    )
    rows = steps.select(col(program), "idx", F.explode(sides).alias("io"))
    return rows.select(col(program), "idx", F.explode("io.names").alias("dataset"), "io.is_write")
