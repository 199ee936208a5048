"""Colors as a picture: a row for each bin of records, a column for each block."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows whose strokes are put in order together; one stroke a bucket crosses to the next.
ROWS_A_BUCKET = 4096


def _positive(name: str, value: int | None, what: str) -> None:
    if value is not None and value <= 0:
        raise ValueError(f"--{name} {value} {what}")


def survey(records: DataFrame) -> DataFrame:
    """(blocks, records): one past the largest block, and how many records."""
    return records.agg(F.coalesce(F.max("block_id") + 1, F.lit(0)).alias("blocks"), F.count("*").alias("records"))


def escaped(colors: DataFrame, width: int) -> DataFrame:
    """(seq, block, message) of the first record with a block that has no column: its largest one. No row if all fit."""
    out = colors.filter(F.col("block") >= width).groupBy("seq").agg(F.max("block").alias("block")).orderBy("seq").limit(1)
    return out.withColumn("message", no_column(width))


def no_column(width: int) -> Column:
    """What is said of a ``block`` past the last column."""
    return F.concat(F.lit("block "), F.col("block").cast("string"), F.lit(f" has no column in a {width}-column picture; rerun with --blocks "), (F.col("block") + 1).cast("string"), F.lit(" or more"))


def pixels(colors: DataFrame, bin: int = 1, width: int | None = None) -> DataFrame:
    """(row, block), distinct: ``bin`` consecutive records share a row. A block past ``width`` is an error."""
    _positive("bin", bin, "puts no record in a row")
    _positive("blocks", width, "makes a picture without columns")
    block = F.col("block")
    if width is not None:
        block = F.when(F.col("block") >= width, F.raise_error(no_column(width)).cast("long")).otherwise(F.col("block")).alias("block")
    return colors.select(F.expr(f"seq div {bin}").alias("row"), block).distinct()


def height(records: int, bin: int) -> int:
    """Rows of so many records; a last bin that isn't full is a row."""
    return -(-records // bin)


def packed(pixels: DataFrame, width: int, rows: int) -> DataFrame:
    """(row, bytes): every row's bits, the leftmost block in the highest; blank rows too."""
    size = -(-width // 8)
    bits = pixels.groupBy("row", F.expr("block div 8").cast("int").alias("byte")).agg(F.bit_or(F.expr("shiftright(128, cast(block % 8 as int))")).alias("bits"))
    return byte_rows(bits, size, rows)


def byte_rows(cells: DataFrame, size: int, rows: int, paper: int = 0) -> DataFrame:
    """(row, bytes) of so many rows of ``size`` bytes, from the bytes (row, byte, bits) that aren't paper.

    A row's bytes are sorted once; between neighbours, and at the ends, the gap is filled.
    """
    own = cells.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("byte", "bits"))).alias("at"))
    every = cells.sparkSession.range(rows).withColumnRenamed("id", "row").join(own, "row", "left")
    blank = lambda n: F.repeat(F.lit(f"{paper:02X}"), n)
    place = lambda k: F.get("at", k)["byte"]
    drawn = F.transform("at", lambda x, k: F.concat(blank(x["byte"] - F.coalesce(place(k - 1), F.lit(-1)) - 1), F.lpad(F.hex(x["bits"]), 2, "0")))
    text = F.concat(F.array_join(drawn, ""), blank(F.lit(size - 1) - place(F.size("at") - 1)))
    return every.select("row", F.unhex(F.coalesce(text, blank(F.lit(size)))).alias("bytes"))


def runs(pixels: DataFrame) -> DataFrame:
    """(row, start, length): maximal runs of adjacent blocks."""
    order = Window.partitionBy("row").orderBy("block")
    own = pixels.withColumn("island", F.col("block") - F.row_number().over(order))
    return own.groupBy("row", "island").agg(F.min("block").alias("start"), F.count("*").alias("length")).select("row", "start", "length")


def strokes(runs: DataFrame) -> DataFrame:
    """(row, start, stroke): the path's steps; the first is absolute, every other one says how far the pen moved.

    The pen comes from the row's stroke before, or the last stroke of an earlier row. Earlier rows
    are found within a bucket of rows, and for a bucket's first from the last of the bucket before.
    """
    inside = Window.partitionBy("row").orderBy("start")
    own = runs.withColumn("bucket", F.expr(f"row div {ROWS_A_BUCKET}")).withColumn("end", F.col("start") + F.col("length"))
    last = own.groupBy("bucket", "row").agg(F.max("end").alias("end"))
    pen = F.struct(F.col("end").alias("x"), F.col("row").alias("y"))
    earlier = last.withColumn("near", F.lag(pen).over(Window.partitionBy("bucket").orderBy("row")))
    ends = last.groupBy("bucket").agg(F.max(F.struct("row", "end")).alias("m")).withColumn("pen", F.struct(F.col("m.end").alias("x"), F.col("m.row").alias("y")))
    ends = ends.select("bucket", F.lag("pen").over(Window.orderBy("bucket")).alias("far"))
    earlier = earlier.join(ends, "bucket").select("row", F.coalesce("near", "far").alias("before"))
    own = own.withColumn("here", F.lag(pen).over(inside)).join(earlier, "row").withColumn("pen", F.coalesce("here", "before"))
    step = F.when(F.col("pen").isNull(), F.format_string("M%d %dh%d", "start", "row", "length")).otherwise(F.format_string("m%d %dh%d", F.col("start") - F.col("pen.x"), F.col("row") - F.col("pen.y"), "length"))
    return own.select("row", "start", step.alias("stroke"))


def pbm_header(width: int, rows: int) -> str:
    return f"P4\n{width} {rows:>20}\n"


def svg_header(width: int, rows: int) -> str:
    """The opening of the drawing, as long for any number of rows: the height's digits are made up by spaces, twice."""
    tag = f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{rows}" viewBox="0 0 {width} {rows}" shape-rendering="crispEdges"'
    tag += " " * (2 * (20 - len(str(rows))))
    return f'{tag}><rect width="100%" height="100%" fill="#fff"/><path fill="none" stroke="#000" stroke-width="1" transform="translate(0,.5)" d="'


SVG_TAIL = '"/></svg>\n'


def stats(runs: DataFrame, width: int, rows: int) -> DataFrame:
    """(columns, rows, runs, runs_a_row, pbm_row_bytes, svg_row_bytes): what the picture costs in either format."""
    mean = F.expr(f"count(*) div {max(rows, 1)}")
    return runs.agg(F.count("*").alias("runs"), mean.alias("runs_a_row")).select(F.lit(width).cast("long").alias("columns"), F.lit(rows).cast("long").alias("rows"), "runs", "runs_a_row", F.lit(-(-width // 8)).cast("long").alias("pbm_row_bytes"), (7 * F.col("runs_a_row")).alias("svg_row_bytes"))


def text_lines(colors: DataFrame) -> DataFrame:
    """(seq, line): a record's terms, largest block first, each followed by a space."""
    from ..functions.formats import weight

    weighted = "w" in colors.columns
    value = weight(F.col("w")) if weighted else F.lit("1")
    term = F.concat(F.lit("("), F.col("block").cast("string"), F.lit(" . "), value, F.lit(") "))
    sorted_ = F.sort_array(F.collect_list(F.struct("block", term.alias("t"))), False)
    return colors.groupBy("seq").agg(F.array_join(F.transform(sorted_, lambda x: x["t"]), "").alias("line"))


def write_text(lines: DataFrame, path: str) -> None:
    """The lines in arrival order, a file for each range of records."""
    lines.repartitionByRange("seq").sortWithinPartitions("seq").select("line").write.mode("overwrite").text(path)
