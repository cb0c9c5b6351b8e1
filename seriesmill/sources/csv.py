"""Reading one CSV per asset into one frame.

1. Blocks. One pass gives a row per file and block of text: its first line and how many of its
   lines have an odd number of quotes. Such a line opens or ends a quoted cell with line breaks,
   so prefix sums over this small table say for every block whether it starts inside a cell.
2. Records. Blocks without odd lines that start outside are records as they are. Only the lines of
   the other blocks are sorted, each block on its own, and only lines of records with breaks meet.
3. Headers. A table with a row per file holds, for every column of the result, the place of that
   column in the file. Records are cut into fields and picked by these places: one expression,
   however many different headers there are.
4. The parsed rows are written once. What is read, the status of the files and the error for a bad
   line all come from them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seriesmill.operators.layout import join_per_key
from seriesmill.sources.scratch import written

# Where the asset stands in a path: the file name, or a partition folder.
FILE_NAME = r"([^/]+)\.csv$"
FOLDER_NAME = r"/asset=([^/]+)/"

# A record's number is its file's number times this, plus its place in the file.
_FILE_BYTES = 1 << 40
_IN_PARTITION = (1 << 33) - 1

# A quoted cell that goes on for more lines than this is taken for a quote that is never closed.
MOST_LINES = 10_000

# Cells that stand for a missing number.
MISSING = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

_FIELD = r',("[^"]*+(?:""[^"]*+)*+"[^,]*+|[^,]*+)'


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, place, value): every line of text, blank ones too.

    ``place`` grows with the line within its file: the first byte of the block, plus the line's
    number in its partition, which is below the partition's size in bytes.
    """
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.csv").text(path)
    number = F.monotonically_increasing_id().bitwiseAND(_IN_PARTITION)
    # The metadata path is a URI, in which a plus sign stands for itself.
    file = F.url_decode(F.regexp_replace("_metadata.file_path", r"\+", "%2B"))
    start = F.col("_metadata.file_block_start")
    return raw.select(
        file.alias("file"), start.alias("block"), (start + number).alias("place"), "value"
    )


def _odd(value: Column) -> Column:
    return F.pmod(F.length(value) - F.length(F.replace(value, F.lit('"'))), F.lit(2)) == 1


def _filled(value: Column) -> Column:
    return F.trim(value) != ""


def _blocks(lines: DataFrame) -> DataFrame:
    """A written table (file, block, first, inside, broken, unclosed), a row per block of text.

    ``first`` is the first line that is not blank, with its place; ``inside`` says that the block
    starts within a quoted cell, ``broken`` that lines and records differ in it, ``unclosed`` that
    the file ends within a quoted cell.
    """
    first = F.min(F.when(_filled(F.col("value")), F.struct("place", "value")))
    found = lines.groupBy("file", "block").agg(
        F.count_if(_odd(F.col("value"))).alias("_odd"), first.alias("first")
    )
    in_file = Window.partitionBy("file")
    before = in_file.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum("_odd").over(before), F.lit(0)) % 2 == 1
    marked = found.withColumns({"inside": inside, "unclosed": F.sum("_odd").over(in_file) % 2 == 1})
    return written(
        marked.withColumn("broken", F.col("inside") | (F.col("_odd") > 0)).drop("_odd"), "csv-blocks"
    )


def _breaks(blocks: DataFrame) -> bool:
    """Whether any record has a line break."""
    return not blocks.where("broken and not unclosed").isEmpty()


def _records(lines: DataFrame, blocks: DataFrame, breaks: bool) -> DataFrame:
    """(file, place, value, lines): records with their line breaks; place is that of the first line."""
    broken = blocks.where("broken and not unclosed").select("file", "block", "inside")
    if not breaks:
        return lines.select("file", "place", "value", F.lit(1).cast("long").alias("lines"))
    known = join_per_key(lines, blocks.select("file", "block", "broken", "unclosed"), ["file", "block"])
    plain = known.where("not broken or unclosed").select(
        "file", "place", "value", F.lit(1).cast("long").alias("lines")
    )
    rows = join_per_key(lines, broken, ["file", "block"])
    in_block = Window.partitionBy("file", "block").orderBy("place")
    so_far = in_block.rowsBetween(Window.unboundedPreceding, 0)
    toggles = F.sum(_odd(F.col("value")).cast("int")).over(so_far) - _odd(F.col("value")).cast("int")
    rows = rows.withColumn("_within", (toggles + F.col("inside").cast("int")) % 2 == 1)
    begins = F.when(~F.col("_within"), F.col("place"))
    rows = written(rows.withColumn("_start", F.last(begins, ignorenulls=True).over(so_far)), "csv-broken")
    # The record that a block starts within began in an earlier one.
    last = rows.groupBy("file", "block").agg(F.max("_start").alias("_last"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    begun = blocks.where("not unclosed").join(last, ["file", "block"], "left").select(
        "file", "block", "first", F.last("_last", ignorenulls=True).over(earlier).alias("_begun")
    )
    rows = join_per_key(rows, begun.drop("first"), ["file", "block"])
    rows = rows.withColumn("_start", F.coalesce("_start", "_begun"))
    single = ~F.col("_within") & ~_odd(F.col("value"))
    alone = rows.where(single).select("file", "place", "value", F.lit(1).cast("long").alias("lines"))
    several = rows.where(~single)
    sizes = several.groupBy("file", "_start").agg(F.count(F.lit(1)).alias("lines"))
    short = several.join(sizes.where(F.col("lines") <= MOST_LINES), ["file", "_start"])
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "value"))), lambda x: x["value"]), "\n")
    joined = short.groupBy("file", "_start").agg(text.alias("value"), F.first("lines").alias("lines"))
    joined = joined.select("file", F.col("_start").alias("place"), "value", "lines")
    long = sizes.where(F.col("lines") > MOST_LINES).select(
        "file", F.col("_start").alias("place"), F.lit("").alias("value"), "lines"
    )
    return plain.unionByName(alone).unionByName(joined).unionByName(long)


def fields_of(record: Column) -> Column:
    """The cells of a record, quotes taken off. A quote counts only in a quoted cell."""
    cells = F.regexp_extract_all(F.concat(F.lit(","), record), F.lit(_FIELD), F.lit(1))

    def bare(cell: Column) -> Column:
        # After the first quote, two stand for one and a single one ends the quoted part.
        inner = F.regexp_replace(F.substring(cell, F.lit(2), F.length(cell)), '"("?)', "$1")
        return F.when(F.startswith(cell, F.lit('"')), inner).otherwise(cell)

    return F.transform(cells, bare)


def inspect_files(
    spark: SparkSession, path: str, time: str = "time", asset_pattern: str = FILE_NAME
) -> DataFrame:
    """A written table (file, file_number, asset, names, header_place, detail), a row per file.

    The files of an asset are numbered in the order of their paths. A file of blank lines holds
    nothing and is not listed.
    """
    lines = _lines(spark, path)
    blocks = _blocks(lines)
    return _files(lines, blocks, _breaks(blocks), time, asset_pattern)


def _files(lines: DataFrame, blocks: DataFrame, breaks: bool, time: str, asset_pattern: str) -> DataFrame:
    firsts = blocks.groupBy("file").agg(
        F.min("first").alias("first"), F.first("unclosed").alias("unclosed")
    ).where(F.col("first").isNotNull())
    odd = firsts.where(_odd(F.col("first.value")) & ~F.col("unclosed")).select("file")
    header = F.col("first.value")
    if breaks and not odd.isEmpty():  # a name with a line break: its file's records are needed
        some = join_per_key(lines, odd, ["file"])
        whole = _records(some, blocks.join(written(odd, "csv-odd"), "file", "left_semi"), breaks)
        whole = whole.where(_filled(F.col("value"))).groupBy("file").agg(F.min_by("value", "place").alias("_whole"))
        firsts = firsts.join(written(whole, "csv-headers"), "file", "left")
        header = F.coalesce("_whole", header)
    # A byte order mark is no part of a name.
    names = F.transform(fields_of(F.regexp_replace(header, "^\ufeff", "")), lambda x: F.trim(x))
    found = firsts.select(
        "file", F.regexp_extract("file", asset_pattern, 1).alias("asset"), names.alias("names"),
        F.col("first.place").alias("header_place"), "unclosed",
    )
    detail = F.when(F.col("unclosed"), "a quote is never closed").when(
        ~F.array_contains("names", time), "no time column"
    ).when(F.size(F.array_distinct("names")) < F.size("names"), "a column name is repeated").when(
        F.col("asset") == "", "no asset in the path"
    ).otherwise("")
    number = F.row_number().over(Window.partitionBy("asset").orderBy("file")).cast("long")
    return written(
        found.select("file", number.alias("file_number"), "asset", "names", "header_place", detail.alias("detail")),
        "csv-files",
    )


def land_csvs(
    spark: SparkSession,
    path: str,
    *,
    time: str = "time",
    time_type: str = "date",
    asset_pattern: str = FILE_NAME,
    text_columns: Sequence[str] = (),
) -> tuple[DataFrame, DataFrame]:
    """(rows, status): the parsed rows of all readable files and the status of every file.

    Both are written. Rows have ``file_number``, ``asset``, the time, ``seq``, the columns, and
    ``_bad`` and ``_line`` where something is wrong with a record.
    """
    lines = _lines(spark, path)
    blocks = _blocks(lines)
    breaks = _breaks(blocks)
    files = _files(lines, blocks, breaks, time, asset_pattern)
    good = files.where("detail = ''")
    # The columns of the result; their number does not grow with that of files or headers.
    names = good.select(F.explode("names").alias("n")).distinct().collect()
    columns = sorted(r[0] for r in names if r[0] != time)
    wanted = F.array(*[F.lit(n) for n in (time, *columns)])
    places = F.transform(wanted, lambda n: F.array_position("names", n).cast("int"))
    dictionary = good.select(
        "file", "file_number", "asset", "header_place", F.size("names").alias("_width"), places.alias("_places")
    )
    records = join_per_key(_records(lines, blocks, breaks), dictionary, ["file"])
    records = records.where((F.col("place") != F.col("header_place")) & (_filled(F.col("value")) | (F.col("lines") > MOST_LINES)))
    fields = F.transform(
        F.array(fields_of(F.col("value"))),
        lambda f: F.struct(
            F.size(f).alias("width"),
            F.transform("_places", lambda p: F.when(p > 0, F.try_element_at(f, F.greatest(p, F.lit(1))))).alias("cells"),
        ),
    )[0]
    rows = records.withColumn("_fields", fields)
    cell = {n: F.col("_fields.cells")[i] for i, n in enumerate((time, *columns))}
    known = {n: F.when(~F.trim(x).isin(*MISSING), x) for n, x in cell.items()}
    at = F.trim(cell[time]).try_cast(time_type)
    metrics = [n for n in columns if n not in text_columns]
    numbers = {n: F.trim(known[n]).try_cast("double") for n in metrics}
    broken = F.lit(False)
    for n in metrics:
        broken = broken | (known[n].isNotNull() & numbers[n].isNull())
    bad = (
        F.when(F.col("lines") > MOST_LINES, "a quote is never closed")
        .when(F.col("_fields.width") != F.col("_width"), "wrong number of fields")
        .when(at.isNull(), "no such time")
        .when(broken, "no such number")
    )
    parsed = rows.select(
        "file_number", "asset", at.alias(time),
        (F.col("file_number") * _FILE_BYTES + F.col("place")).alias("seq"),
        *[(numbers[n] if n in numbers else known[n]).alias(n) for n in columns],
        bad.alias("_bad"), "value",
    )
    parsed = parsed.withColumn("_line", F.when(F.col("_bad").isNotNull(), F.col("value"))).drop("value")
    parsed = written(parsed, "csv-parsed")
    return parsed, written(_status(files, parsed), "csv-status")


def _status(files: DataFrame, parsed: DataFrame) -> DataFrame:
    found = parsed.groupBy("asset", "file_number").agg(
        F.count(F.lit(1)).alias("rows"), F.count("_bad").alias("bad_rows"), F.min("_bad").alias("why"),
        F.min("_line").alias("line"),
    )
    joined = files.join(found, ["asset", "file_number"], "left")
    detail = F.when(F.col("detail") != "", F.col("detail")).when(
        F.col("bad_rows") > 0, F.concat("why", F.lit(", lines: "), F.col("bad_rows").cast("string"))
    ).otherwise("")
    return joined.select(
        "file", "asset", F.when(detail == "", "ok").otherwise("skipped").alias("status"),
        detail.alias("detail"), F.coalesce("rows", F.lit(0)).alias("rows"), "file_number", "line",
    )


def sound_rows(parsed: DataFrame, status: DataFrame, on_error: str) -> DataFrame:
    """The rows of ``land_csvs`` without its helper columns: of all files, or of those that are ok."""
    if on_error not in ("raise", "skip"):
        raise ValueError(f"unknown on_error: {on_error}")
    # those that are not ok come first
    some = status.orderBy(F.desc("status"), "file").limit(20).collect()
    bad = [r for r in some if r["status"] != "ok"]
    if bad and on_error == "raise":
        listed = "; ".join(f"{r['file']} ({r['detail']}{', as in ' + r['line'] if r['line'] else ''})" for r in bad)
        raise ValueError(f"unreadable files, the first of them: {listed}")
    if len(bad) == len(some) and status.where("status = 'ok'").isEmpty():
        raise ValueError("no readable files")
    if bad:
        ok = status.where("status = 'ok'").select("asset", "file_number")
        parsed = parsed.join(ok, ["asset", "file_number"], "left_semi")
    return parsed.drop("file_number", "_bad", "_line")


def file_status(
    spark: SparkSession,
    path: str,
    *,
    time: str = "time",
    time_type: str = "date",
    asset_pattern: str = FILE_NAME,
    text_columns: Sequence[str] = (),
) -> DataFrame:
    """(file, asset, status, detail, rows) per file: a file is ok if all its records are.

    Files that are not ok are those that ``on_error="skip"`` leaves out.
    """
    how = {"time": time, "time_type": time_type, "asset_pattern": asset_pattern, "text_columns": text_columns}
    return land_csvs(spark, path, **how)[1].drop("file_number", "line")


def read_metric_csvs(
    spark: SparkSession,
    path: str,
    *,
    time: str = "time",
    time_type: str = "date",
    on_error: str = "raise",
    asset_pattern: str = FILE_NAME,
    text_columns: Sequence[str] = (),
) -> DataFrame:
    """(asset, time, seq, columns...) from a folder of per-asset files.

    Records are bound to columns by the header of their own file, the first line that is not
    blank; a column that a file lacks is NULL, and so is an empty cell or a mark for a missing
    value. Quoted cells may hold line breaks. Columns are numbers, but for ``text_columns``.
    ``seq`` is unique within its asset and grows with the file's place among the paths of the
    asset and the record within the file; it breaks ties between equal times.

    A record with more or fewer fields than its header, a cell that is no number, a time that is
    none or a quote that is never closed fails the call, before any row is given. With
    ``on_error="skip"`` files with any such record are left out whole; ``file_status`` lists them.
    """
    how = {"time": time, "time_type": time_type, "asset_pattern": asset_pattern, "text_columns": text_columns}
    return sound_rows(*land_csvs(spark, path, **how), on_error)
