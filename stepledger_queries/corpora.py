"""Program, source and log texts that Spark derives from the part table, one of each per part.

Each text is one SQL expression that both engines evaluate on the same row.
"""

from pyspark.sql import functions as F

from stepledger.sources.corpus import spread
from stepledger_queries.base import table

PROGRAM = "concat('part', CAST(p_partkey AS STRING))"
KEY = "CAST(p_partkey % 50 AS STRING)"
KIND = "lower(replace(p_type, ' ', '_'))"
BRAND = "lower(replace(p_brand, '#', '_'))"

TEXT = f"""concat(
    '/* load ', p_name, '; all of it */ options nocenter;', chr(10),
    'DATA Work.base_', {KEY}, '(keep=a b); set raw.', {KIND}, '(where=(size > ', CAST(p_size AS STRING), ')) end=eof; note = ',
    chr(39), 'a; b', chr(39), '; run;', chr(10),
    '* a comment statement;', chr(10),
    'proc sort data=base_', {KEY}, ';   by id; run;', chr(10),
    'proc sql; create table work.j as select * from base_', {KEY}, ' x left join ref.', {BRAND}, ' y on x.id = y.id; quit;', chr(10),
    CASE WHEN p_size % 2 = 0 THEN concat('data final rejects; merge j raw.extra(in=q); by id; if q then output rejects; run;', chr(10)) ELSE '' END,
    CASE WHEN p_size % 3 = 0 THEN concat('proc append base=hist data=', CASE WHEN p_size % 2 = 0 THEN 'final' ELSE 'j' END, '; run;', chr(10)) ELSE '' END,
    CASE WHEN p_size % 5 = 0 THEN concat('data base_', {KEY}, '; update base_', {KEY}, ' tx.', {BRAND}, '; by id;', chr(10)) ELSE '' END)"""

CUT = "concat(CAST(p_size AS STRING), '.5')"
RATE = "CASE WHEN p_partkey % 3 = 0 THEN '7e-4' ELSE concat('-0.', CAST(p_partkey % 1000 + 1000 AS STRING)) END"
# Rounds of the outer loop: a few, in one program of 97 so many that it has more than 100 steps.
MONTHS = "CASE WHEN p_partkey % 97 = 0 THEN 60 ELSE 1 + p_size % 3 END"

# One round of the loop in the log of a yearly archive: a part is cut out, checked and, on a condition, appended.
ROUND = f"""concat(
    'SYMBOLGEN:  Macro variable MON resolves to 4', chr(10),
    'MLOGIC(CUT_PART):  Parameter SLICE has value 4', chr(10),
    'SYMBOLGEN:  Macro variable CUTOFF resolves to 0', chr(10),
    'SYMBOLGEN:  Macro variable CUTOFF resolves to ', {CUT}, chr(10),
    'MPRINT(CUT_PART):   data arch.part_', {KEY}, '(keep=id moved) late;', chr(10),
    'MPRINT(CUT_PART):   set raw.moves_', {KIND}, '; if moved > ', {CUT}, ' then output late;', chr(10),
    'MPRINT(CUT_PART):   run;', chr(10),
    'MLOGIC(YEARLY):  %IF condition &rate ne 0 is TRUE', chr(10),
    'SYMBOLGEN:  Macro variable RATE resolves to ', {RATE}, ' ', chr(10),
    'MPRINT(YEARLY):   data arch.due; set late;  due = moved * (', {RATE}, ') ; run;', chr(10),
    'MPRINT(YEARLY):   proc append base=arch.year data=arch.due;', chr(10),
    'MPRINT(YEARLY):   run;', chr(10))"""

LOG = f"""CASE WHEN p_partkey % 10 = 0 THEN {TEXT} ELSE concat(
    'NOTE: library ARCH holds ', p_name, chr(10),
    'MLOGIC(YEARLY):  Beginning execution.', chr(10),
    'MLOGIC(YEARLY):  Parameter LAST has value 12', chr(10),
    'SYMBOLGEN:  Macro variable LAST resolves to 12', chr(10),
    'MLOGIC(YEARLY):  %DO loop beginning; index variable MON; start value is 1; stop value is 12; by value is 1.', chr(10),
    repeat({ROUND}, CAST({MONTHS} AS INT)),
    'WARNING: a part was empty', chr(10),
    'MPRINT(TIDY):   proc sort data=arch.year out=', {KIND}, '; by id; run;', chr(10),
    'SYMBOLGEN:  Macro variable OWNER resolves to ', p_brand, chr(10),
    'NOTE: The table ARCH.YEAR is complete.', chr(10)) END"""

SOURCE = f"""concat(
    '%macro cut_part(slice=, cutoff=);', chr(10), '  data arch.part_&slice(keep=id moved) late; set raw.moves; if moved > &cutoff then output late; run;', chr(10), '%mend cut_part;', chr(10),
    '%macro yearly(last=12);', chr(10), '  %do mon = 1 %to &last; %let label = %sysfunc(mdy(&mon, 1, 2001));', chr(10),
    '    %cut_part(slice=&mon, cutoff=&limit) %if &rate ne 0 %then %do; data arch.due; set late; due = moved * (&rate); run; %end;', chr(10), '  %end;', chr(10), '%mend yearly;', chr(10),
    CASE WHEN p_partkey % 2 = 0 THEN concat('%macro tidy; proc sort data=arch.year out=', {KIND}, '; by id; run; %mend;', chr(10)) ELSE '' END,
    '%LET Top', CAST(p_size AS STRING), ' = 1;', chr(10))"""


# Programs for each task: their texts are some hundred times the bytes of the rows that they are made of.
TASK_PROGRAMS = 4000


def corpus(spark, sf_dir, text=TEXT):
    """The rows are dealt before the texts are made of them, so no text is moved."""
    part = table(spark, sf_dir, "part")
    named = part.withColumn("program", F.expr(PROGRAM))
    return spread(named, tasks=-(-part.count() // TASK_PROGRAMS)).select("program", F.expr(text).alias("text"))


def corpus_sql(text=TEXT):
    return f"SELECT {PROGRAM} AS program, {text} AS text FROM part"
