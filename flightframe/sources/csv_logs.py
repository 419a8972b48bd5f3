"""Directories of CSV logs as samples, parameters and messages.

Works on lines(log_id, line_no, line): line_no only has to rise within a log.  A job reads its files once: `prepared` stores their lines
in pieces that follow one another, and `parsed` the cells of their rows.  A log's layout (delimiter, names, time
column, group) is one row, found by aggregation; rows without a time column are numbered by counts of the pieces before them.  Values in double
quotes lose the quotes; a delimiter inside quotes still separates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flightframe.operators import scans
from flightframe.sources.store import stored

#: Names of time columns in order of preference, beginnings of others, and delimiters in order.
# fmt: off
TIME_NAMES = [
    "time", "timestamp", "time_s", "time(s)", "time [s]", "time_sec", "offsettime", "time(millisecond)", "timems", "time_ms", "time_us",
    "time_usec", "t", "tick", "ticks", "tow", "gpstime", "utc",
]
TIME_BEGINNINGS = ["time", "timestamp", "offsettime", "tick"]
DELIMITERS = [",", ";", "\t"]
#: Parts of a time column's name that tell its unit, or that it counts from an epoch.
MICROSECONDS, MILLISECONDS = ["microsecond", "time_us", "timeus", "usec"], ["millisecond", "time_ms", "timems", "offsettime"]
EPOCHS = ["gpstime", "tow", "unix", "epoch"]
VENDOR_TIMES = ["offsetTime", "time(millisecond)", "Tick", "Time"]
#: Groups in order, each with a part of the file's name that tells it, or parts of names of columns: one of each set ("=": a whole name).
GROUPS = [
    ("IMU", "imu", [["=wx", "=wy", "=wz"], ["=ax", "=ay", "=az"]]),
    ("INS", "ins", []),
    ("GPS", "gps", [["lat"], ["lon", "lng"]]),
    ("ATT", "att", [["roll"], ["pitch"]]),
    ("BARO", "baro", [["press"]]),
    ("MAG", "mag", []),
]
VENDOR_COLUMNS = ["offsetTime", "time(millisecond)", "Tick"]
#: Patterns of dates that end the name of a file, and the longest name that is a group.
DATES = [r"[_\-]?\d{8}[_\-]\d{4,6}.*$", r"[_\-]\d{4}[_\-]\d{2}[_\-]\d{2}.*$"]
LONGEST_GROUP = 20
# fmt: on
SYNTHETIC_STEP = 0.1


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(log_id: the file, line_no, line) of a file or a directory; large files are read in parts."""
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("log_id"), F.col("_metadata.file_block_start").alias("part"), F.col("value").alias("line"))
    number = F.monotonically_increasing_id()
    return rows.select("log_id", F.struct("part", number.alias("n")).alias("line_no"), "line")


def load_list(files: DataFrame) -> DataFrame:
    """files(path, pos, there boolean) -> (path, label): missing ones and repeats left out; F1, F2, .. in order."""
    first = files.where("there and path is not null").groupBy("path").agg(F.min("pos").alias("pos"))
    from flightframe.operators.logs import labelled

    return labelled(first, "pos").select("path", "label")


def _comment(line: Column) -> Column:
    return F.trim(line).rlike("^(#|//)")


def headers(lines: DataFrame) -> DataFrame:
    """(log_id, first, line): each log's first line that is neither blank nor a comment (its header), and its number."""
    content = lines.where((F.trim("line") != "") & ~_comment(F.col("line")))
    return content.groupBy("log_id").agg(F.min("line_no").alias("first"), F.min_by("line", "line_no").alias("line"))


def header_comments(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """params(log_id, name, value) of "key: value" comments before the header, and messages(log_id, t, text) of all."""
    comments = lines.where(_comment(F.col("line"))).join(headers(lines).select("log_id", "first"), "log_id", "left")
    head = comments.where(F.col("first").isNull() | (F.col("line_no") < F.col("first")))
    text = F.trim(F.regexp_replace(F.trim("line"), "^[#/]+", ""))
    texts = head.select("log_id", "line_no", text.alias("text"))
    named = texts.where(F.col("text").contains(":"))
    pairs = named.select("log_id", "line_no", F.regexp_replace(F.trim(F.split("text", ":", 2)[0]), r"\s+", "_").alias("name"), F.trim(F.split("text", ":", 2)[1]).alias("value"))
    last = pairs.groupBy("log_id", "name").agg(F.max_by("value", "line_no").alias("value"))
    return last, texts.select("log_id", F.lit(0.0).alias("t"), "text")


def delimiter(header: Column) -> Column:
    """The most frequent candidate; the earliest on ties, a comma without any."""
    counts = [F.length(header) - F.length(F.replace(header, F.lit(d), F.lit(""))) for d in DELIMITERS]
    most = F.greatest(*counts)
    out = F.lit(DELIMITERS[-1])
    for d, n in list(zip(DELIMITERS, counts, strict=True))[-2::-1]:
        out = F.when(n == most, d).otherwise(out)
    return out


def _has(text: Column, words: list[str]) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | text.contains(w)
    return found


def group_name(file: Column, names: Column) -> Column:
    """The first of GROUPS whose file part or columns fit, else the vendor's by its columns, else the file's stem without dates, else CSV."""

    def fits(part: str, sets: list[list[str]]) -> Column:
        found = F.lower(file).contains(part)
        columns = F.lit(bool(sets))
        for words in sets:
            columns &= F.exists(names, lambda c: F.lower(c).isin([w[1:] for w in words if w[0] == "="]) | _has(F.lower(c), [w for w in words if w[0] != "="]))  # noqa: B023
        return found | columns

    stem = F.regexp_replace(file, r"\.[^.]*$", "")
    for pattern in DATES:
        stem = F.regexp_replace(stem, pattern, "")
    stem = F.upper(F.trim(F.regexp_replace(stem, "[^a-zA-Z0-9_]", "_"), F.lit("_")))
    group = F.when((F.length(stem) > 0) & (F.length(stem) <= LONGEST_GROUP) & ~stem.rlike("^[0-9]+$"), stem).otherwise("CSV")
    group = F.when(F.exists(names, lambda c: c.isin(VENDOR_COLUMNS)), "DJI").otherwise(group)
    for name, part, sets in reversed(GROUPS):
        group = F.when(fits(part, sets), name).otherwise(group)
    return group


def time_position(names: Column) -> Column:
    """Position (from 1) of the time column, 0 without one: listed names in order, then beginnings, by last dotted part."""
    leaves = F.transform(names, lambda c: F.lower(F.element_at(F.split(c, r"\."), -1)))
    listed = F.transform(F.array(*map(F.lit, TIME_NAMES)), lambda n: F.array_position(leaves, n))
    first = F.get(F.filter(listed, lambda p: p > 0), F.lit(0))
    begins = F.transform(leaves, lambda c: F.exists(F.array(*map(F.lit, TIME_BEGINNINGS)), lambda b: c.startswith(b)))
    return F.coalesce(first, F.array_position(begins, True)).cast("int")


def layouts(lines: DataFrame) -> DataFrame:
    """(log_id, first, sep, names, is_params, time_pos, msg_group), one row per log that has a header."""
    header = headers(lines).select("log_id", "first", F.regexp_replace("line", "#.*$", "").alias("header")).withColumn("sep", delimiter(F.col("header")))
    names = F.transform(F.split(F.col("header"), F.concat(F.lit("\\Q"), "sep", F.lit("\\E"))), lambda c: F.trim(F.regexp_replace(F.trim(c), '^"|"$', "")))
    named = header.withColumn("names", names)
    low = F.transform("names", F.lower)
    is_params = (F.size("names") == 2) & F.exists(low, lambda c: c.isin("parameter", "param", "name"))
    file = F.element_at(F.split(F.col("log_id").cast("string"), "/"), -1)
    return named.select("log_id", "first", "sep", "names", is_params.alias("is_params"), time_position(F.col("names")).alias("time_pos"), group_name(file, F.col("names")).alias("msg_group"))


def prepared(lines: DataFrame) -> DataFrame:
    """lines, read once and stored in pieces that follow one another in each log."""
    return scans.pieces(lines, ["line_no"], ["log_id"])


def parsed(lines: DataFrame) -> DataFrame:
    """data_rows of prepared lines, stored: each line is split once."""
    return stored(data_rows(lines, layouts(lines)), "rows")


def data_rows(lines: DataFrame, layout: DataFrame) -> DataFrame:
    """(log_id, line_no, cells array, layout columns): the lines after the header that hold data."""
    rows = lines.join(layout, "log_id").where("line_no > first").withColumn("line", F.regexp_replace("line", "#.*$", "")).where("trim(line) <> '' and not startswith(trim(line), '//')")
    cells = F.transform(F.split("line", F.concat(F.lit("\\Q"), "sep", F.lit("\\E"))), lambda c: F.regexp_replace(F.trim(c), '^"|"$', ""))
    return rows.withColumn("cells", cells).drop("line", "first", "sep")


def param_rows(rows: DataFrame) -> DataFrame:
    """(log_id, line_no, name, value) of parameter files: the name column is the first if it is called so."""
    first = F.lower(F.col("names")[0]).rlike("param|name")
    a, b = F.get("cells", F.lit(0)), F.get("cells", F.lit(1))
    return rows.where("is_params").select("log_id", "line_no", F.trim(F.when(first, a).otherwise(b)).alias("name"), F.when(first, b).otherwise(a).alias("value"))


def _clock(rows: DataFrame) -> DataFrame:
    """rows with t by their order: only logs without a time column need one."""
    cut = rows if scans.PIECE in rows.columns else prepared(rows)
    numbered = scans.numbered(cut, ["line_no"], ["log_id"])
    return numbered.withColumn("t", F.col("row") * SYNTHETIC_STEP).select(*rows.columns, "t")


def with_time(rows: DataFrame) -> DataFrame:
    """rows with t in seconds; see the rules of the unit and of texts beside each expression.

    What a log's values have in common is one aggregation, so a file's rows are never one task's.
    """
    text = F.nullif(F.get("cells", F.col("time_pos") - 1), F.lit(""))
    timed = rows.where("time_pos > 0").withColumn("x", text.try_cast("double")).withColumn("when", F.unix_micros(F.try_to_timestamp(text)) / 1e6).withColumn("filled", text.isNotNull())
    facts = timed.groupBy("log_id").agg(
        F.count("*").alias("n"),
        F.count("x").alias("n_x"),
        F.count("when").alias("n_when"),
        F.count_if("filled").alias("n_filled"),
        F.max("x").alias("max_x"),
        F.max("when").alias("max_when"),
        F.min_by("when", F.when(F.col("when").isNotNull(), F.col("line_no"))).alias("first"),
    )
    numeric, mostly = F.col("n_x") == F.col("n_filled"), F.col("n_x") / F.col("n") > 0.5  # a numeric column keeps its blanks
    seconds = F.when(numeric, F.col("x")).when(mostly, F.coalesce("x", F.lit(0.0))).otherwise(F.coalesce(F.col("when") - F.col("first"), F.lit(0.0)))
    zero = lambda some: F.when(some < F.col("n"), 0.0)  # noqa: E731  (rows without a value count as 0)
    greatest = F.when(numeric, F.col("max_x")).when(mostly, F.greatest("max_x", zero(F.col("n_x")))).otherwise(F.greatest(F.col("max_when") - F.col("first"), zero(F.col("n_when"))))
    low, most = F.lower(F.col("names")[F.col("time_pos") - 1]), F.coalesce(greatest, F.lit(0.0))
    micro, milli = _has(low, MICROSECONDS), _has(low, MILLISECONDS)
    scale = F.when(micro | ((most > 1e8) & ~milli), 1e6).when(milli | ((most > 1e5) & ~_has(low, EPOCHS)), 1e3).otherwise(1.0)
    known = timed.join(facts, "log_id").withColumn("t", seconds / scale).select(*rows.columns, "t")
    return known.unionByName(_clock(rows.where("time_pos = 0")))


def number_or_zero(text: Column) -> Column:
    """Blanks, texts and NaN are 0."""
    return F.coalesce(F.nanvl(text.try_cast("double"), F.lit(0.0)), F.lit(0.0))


def csv_samples(rows: DataFrame) -> DataFrame:
    """(log_id, msg_type, field, series, line_no, t, v): dotted names give their group, others the log's; no time column."""
    cells = with_time(rows.where("not is_params")).select("log_id", "line_no", "t", "time_pos", "names", "msg_group", F.posexplode("cells").alias("k", "cell"))
    named = cells.where("k + 1 <> time_pos and k < size(names)").withColumn("name", F.col("names")[F.col("k")])
    parts = F.split("name", r"\.", 2)
    dotted = F.size(parts) == 2
    msg, field = F.when(dotted, parts[0]).otherwise(F.col("msg_group")), F.when(dotted, parts[1]).otherwise(F.col("name"))
    return named.select("log_id", msg.alias("msg_type"), field.alias("field"), F.concat_ws(".", msg, field).alias("series"), "line_no", "t", number_or_zero(F.col("cell")).alias("v"))


def vendor_samples(lines: DataFrame) -> DataFrame:
    """As csv_samples for comma-separated vendor logs: group DJI, its own time columns, milliseconds only if named so."""
    lines = prepared(lines)
    layout = layouts(lines)
    listed = F.transform(F.array(*map(F.lit, VENDOR_TIMES)), lambda n: F.array_position("names", n))
    pos = F.coalesce(F.get(F.filter(listed, lambda p: p > 0), F.lit(0)), F.lit(0)).cast("int")
    rows = stored(data_rows(lines, layout.withColumn("time_pos", pos).withColumn("sep", F.lit(","))), "rows")
    raw = rows.where("time_pos > 0").withColumn("raw", F.get("cells", F.col("time_pos") - 1).try_cast("double"))
    most = raw.groupBy("log_id").agg(F.max("raw").alias("most"))
    milli = (F.col("most") > 10000) & F.lower(F.col("names")[F.col("time_pos") - 1]).contains("millisecond")
    known = raw.join(most, "log_id").withColumn("t", F.when(milli, F.col("raw") / 1000).otherwise(F.col("raw"))).select(*rows.columns, "t")
    timed = known.unionByName(_clock(rows.where("time_pos = 0")))
    cells = timed.select("log_id", "line_no", "t", "time_pos", "names", F.posexplode("cells").alias("k", "cell")).where("k + 1 <> time_pos and k < size(names)")
    return cells.select("log_id", F.lit("DJI").alias("msg_type"), F.col("names")[F.col("k")].alias("field"), "line_no", "t", number_or_zero(F.col("cell")).alias("v"))


def csv_job(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """samples, params and messages of a directory of CSV logs; empty files give no rows."""
    lines = prepared(read_lines(spark, path))
    rows = parsed(lines)
    head, texts = header_comments(lines)
    return {"samples": csv_samples(rows), "params": head.unionByName(param_rows(rows).select("log_id", "name", "value")), "messages": texts}
