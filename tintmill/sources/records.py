"""Transaction records in their text form: reading, with column pruning and validation, and writing.

A record is ``((timestamp block tx _ _ _ _) (input ...) (output ...))``, an input ``(address amount
prev-tx vout)``, an output ``(address amount _)``. Wanted fields stand in fixed places; what follows
them is ignored, however much it is.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A whole record on one line: three lists, of integers, of lists and of lists. Possessive throughout, so that no
#: list is too long for the matcher's stack and no line is tried twice.
_LIST = r"\((?:\s*+\d++)*+\s*+\)"
_LISTS = rf"\((?:\s*+{_LIST})*+\s*+\)"
_RECORD = rf"^\s*+\(\s*+{_LIST}\s*+{_LISTS}\s*+{_LISTS}\s*+\)\s*+$"
WIDEST = (1 << 64) - 1
#: Where a row comes from: its file, the split of it, and its place among the split's rows.
_PLACE = ("_file", "_split", "_mark")


def lines_of(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(value, _file, _split, _mark): the lines of text files and where they stand."""
    meta = F.col("_metadata")
    return spark.read.text(path).select("value", meta["file_path"].alias("_file"), meta["file_block_start"].alias("_split")).withColumn("_mark", F.monotonically_increasing_id())


def arrival(df: DataFrame) -> DataFrame:
    """Rows that follow the lines of ``lines_of``, with a dense ``seq``: by file, by the split's place in it, then by row.

    Spark deals splits to partitions by size, so partitions say nothing about order, but a split's
    rows stay together in one. Splits are counted; only that table, a row a split, is sorted.
    """
    marked = df.withColumn("_at", F.monotonically_increasing_id())
    counts = marked.groupBy("_file", "_split").agg(F.count("*").alias("_n"), F.min("_at").alias("_low"))
    return _numbered(marked, counts, F.col("_at") - F.col("_low")).drop("_at", "_low", *_PLACE)


def _numbered(df: DataFrame, counts: DataFrame, inside: Column) -> DataFrame:
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_file", "_split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.withColumn("_before", before).drop("_n").withColumnsRenamed({"_file": "_f", "_split": "_s"})
    return df.join(offsets, (F.col("_file") == F.col("_f")) & (F.col("_split") == F.col("_s"))).withColumn("seq", F.col("_before") + inside).drop("_f", "_s", "_before")


def _json(line: Column) -> Column:
    """A record as a JSON array: lists become arrays, white space between elements a comma."""
    out = F.regexp_replace(F.trim(line), r"\s++", " ")
    out = F.regexp_replace(F.regexp_replace(out, r"\( ", "("), r" \)", ")")
    out = F.regexp_replace(out, r"\) ?\(", ") (")
    return F.translate(out, "() ", "[],")


def _once(value: Column, body) -> Column:
    """``body`` of a value that is evaluated once, however often it is referred to."""
    return F.transform(F.array(value), body)[0]


def _taken(line: Column) -> Column:
    """A struct of header fields ``h``, lists of input fields ``i`` and the number of outputs ``o``, digits as text; of nulls if the line is no record."""
    read = lambda x, kind: F.from_json(x, kind, {"allowNumericLeadingZeros": "true"})
    lists = lambda x: F.length(x) - F.length(F.translate(x, "[", "")) - 1
    part = lambda p, k: F.get(p, F.lit(k))
    found = read(F.when(line.rlike(_RECORD), _json(line)), "array<string>")
    return _once(found, lambda p: F.struct(read(part(p, 0), "array<string>").alias("h"), read(part(p, 1), "array<array<string>>").alias("i"), lists(part(p, 2)).alias("o")))


def _too_wide(field: Column, most: int) -> Column:
    """Whether a run of digits is a number beyond ``most``."""
    size = len(str(most))
    short = F.regexp_replace(field, r"^0++(?=\d)", "")
    return (F.length(field) >= size) & ((F.length(short) > size) | ((F.length(short) == size) & (short > F.lit(str(most)))))


def parse_lines(lines: DataFrame, column: str = "value", strict: bool = True, wide: bool = False) -> DataFrame:
    """(block_id, tx_id, outputs, inputs: array of (pos, prev_tx_id, amount)) of one record a line, beside the other columns.

    Only wanted fields are converted: others may be any run of digits. Numbers are longs, or with
    ``wide`` decimals of 20 digits, which hold all 64 unsigned bits. Blank lines are skipped. A
    malformed line raises an error, or without ``strict`` is left out (see ``rejected``); so does a
    number that a long doesn't hold, unless ``wide``.
    """
    line, rest = F.col(column), [c for c in lines.columns if c != column]
    own = lines.filter(F.length(F.trim(line)) > 0).withColumn("_x", _taken(line))
    reason = _reason(line, F.col("_x"))
    if strict:
        where = F.concat(F.lit(" in "), F.col("_file")) if "_file" in rest else F.lit("")
        said = F.raise_error(F.concat(reason, where, F.lit(": "), F.substring(line, 1, 200)))
        own = own.withColumn("_x", F.when(reason.isNull(), F.col("_x")).otherwise(said))
    else:
        own = own.filter(reason.isNull())
    kind, most = ("decimal(20,0)", WIDEST) if wide else ("long", (1 << 63) - 1)

    def number(field: Column) -> Column:
        said = F.raise_error(F.concat(F.lit("wider than a long, read it as a decimal: "), field)).cast(kind)
        value = F.when(F.length(field) > 20, F.regexp_replace(field, r"^0++(?=\d)", "")).otherwise(field).cast(kind)
        return value if wide else F.when(_too_wide(field, most), said).otherwise(value)

    field = lambda x, k: number(F.get(x, F.lit(k)))
    one = lambda x, i: F.struct(i.alias("pos"), field(x, 2).alias("prev_tx_id"), field(x, 1).alias("amount"))
    return own.select(*rest, field("_x.h", 1).alias("block_id"), field("_x.h", 2).alias("tx_id"), F.col("_x.o").cast("long").alias("outputs"), F.transform("_x.i", one).alias("inputs"))


def rejected(line: Column) -> Column:
    """Why a line is no record; null for a good or blank one. Every wanted field is looked at."""
    return _once(_taken(line), lambda x: _reason(line, x))


def _reason(line: Column, x: Column) -> Column:
    at = lambda x, k: F.get(x, F.lit(k))
    beyond = lambda x: F.coalesce(_too_wide(at(x, 1), WIDEST) | _too_wide(at(x, 2), WIDEST), F.lit(False))
    few = F.size(x["h"])
    return (
        F.when(F.length(F.trim(line)) == 0, None)
        .when(x["h"].isNotNull() & (few >= 3) & ~F.exists(x["i"], lambda y: (F.size(y) < 3) | beyond(y)) & ~beyond(x["h"]), None)
        .when(line.rlike(r"-\d"), "negative integer")
        .when(line.rlike(r"[^\s()0-9]"), "expected an integer")
        .when(x["h"].isNull(), "malformed record")
        .when(few < 3, F.concat(F.lit("record header has "), few.cast("string"), F.lit(" fields")))
        .when(F.exists(x["i"], lambda y: F.size(y) < 3), "input has too few fields")
        .otherwise("does not fit in a usize")
    )


def first_rejected(spark: SparkSession, path: str | list[str]) -> tuple[str, str] | None:
    """(file, what is wrong at which byte offset) of the first malformed line in arrival order; None if all are records.

    Only counts of bytes are summed: of the splits before, and of the failing split's lines before.
    """
    own = lines_of(spark, path).withColumn("_bytes", F.octet_length("value") + 1)
    bad = own.filter(rejected(F.col("value")).isNotNull()).orderBy(*_PLACE).limit(1).first()
    if bad is None:
        return None
    same = own.filter((F.col("_file") == bad["_file"]) & ((F.col("_split") < bad["_split"]) | ((F.col("_split") == bad["_split"]) & (F.col("_mark") < bad["_mark"]))))
    begin = int(same.agg(F.sum("_bytes")).first()[0] or 0)
    try:
        list(parse_bytes(bad["value"].encode("utf-8", "surrogatepass")))
    except RecordError as error:
        what, _, at = str(error).rpartition(" at byte offset ")
        return bad["_file"], f"{what} at byte offset {begin + int(at)}"
    return bad["_file"], f"more than a record in a line at byte offset {begin}"


_TOKENS = re.compile(rb"\s+|\(|\)|-?\d+|.", re.S)


class RecordError(ValueError):
    """A malformed record, with the byte at which it is noticed."""


def parse_bytes(data: bytes, source: str = "") -> Iterator[tuple[int, int, int, list[tuple[int, int, int]]]]:
    """(block, tx, outputs, [(pos, prev, amount)]) of each record, which may span lines or share one."""

    def fail(what: str, at: int) -> None:
        raise RecordError(f"{source}{': ' if source else ''}{what} at byte offset {at}")

    depth, path, fields, wanted = 0, [0, 0, 0, 0], [], None
    header: list[int] = []
    paid: list[tuple[int, int, int]] = []
    made, lists = 0, 0
    for m in _TOKENS.finditer(data):
        token, at = m[0], m.start()
        if token.isspace():
            continue
        if token == b"(":
            depth += 1
            if depth == 1:
                header, paid, made, lists = [], [], 0, 0
            elif depth == 2:
                fields = []
                lists += 1
                if lists > 3:
                    fail("expected the record's end", at)
            elif depth == 3 and lists in (2, 3):
                fields = []
            else:
                fail("expected an integer", at)
        elif token == b")":
            depth -= 1
            if depth < 0:
                fail("expected a record", at)
            if depth == 1 and lists == 1:
                if len(fields) < 3:
                    fail(f"record header has {len(fields)} fields", at)
                header = fields
            elif depth == 2 and lists == 2:
                if len(fields) < 3:
                    fail(f"input has {len(fields)} fields", at)
                paid.append((len(paid), fields[2], fields[1]))
            elif depth == 2 and lists == 3:
                made += 1
            elif depth == 0:
                if lists != 3:
                    fail("record has too few lists", at)
                yield header[1], header[2], made, paid
        else:
            here = (depth == 2 and lists == 1) or depth == 3
            if token[:1] == b"-" and len(token) > 1 and here:
                fail("negative integer", at)
            if not token.isdigit() or not here:
                fail("expected an integer" if here else "expected a list", at)
            read = len(fields) in ((1, 2) if lists < 3 else ())
            if read and int(token) > WIDEST:
                fail("integer does not fit in a usize", at)
            # An unread field may be of any width; only its place counts.
            fields.append(int(token) if read else 0)
    if depth:
        fail("record is cut short", len(data))


_FREE = "_file string, _split long, _mark long, _k long, block_id decimal(20,0), tx_id decimal(20,0), outputs long, inputs array<struct<pos:int,prev_tx_id:decimal(20,0),amount:decimal(20,0)>>"


def read_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Records whatever their line breaks, in the files' order; numbers keep all 64 unsigned bits.

    Lines are the unit that files are split into, and a record may span any number of them: how deep
    each line starts in brackets is a running sum, within a split and over the splits. Lines belong
    to the last one before them that starts at depth 0, and those groups are parsed in parallel. So
    no task holds more than a split, or a record and the lines it shares.
    """
    from decimal import Decimal

    value = F.col("value")
    step = F.length(F.regexp_replace(value, r"[^(]++", "")) - F.length(F.regexp_replace(value, r"[^)]++", ""))
    own = lines_of(spark, path).withColumn("_step", step.cast("long"))
    order = Window.partitionBy("_file", "_split").orderBy("_mark").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("_file").orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    sums = own.groupBy("_file", "_split").agg(F.sum("_step").alias("_sum")).withColumn("_deep", F.coalesce(F.sum("_sum").over(upto), F.lit(0)))
    own = own.join(sums.drop("_sum"), ["_file", "_split"]).withColumn("_deep", F.col("_deep") + F.coalesce(F.sum("_step").over(order), F.lit(0)))
    # The last line at depth 0: within the split, or the last one of an earlier split.
    head = F.when(F.col("_deep") == 0, F.struct(F.col("_split").alias("s"), F.col("_mark").alias("m")))
    within = Window.partitionBy("_file", "_split").orderBy("_mark").rowsBetween(Window.unboundedPreceding, 0)
    own = own.withColumn("_near", F.last(head, ignorenulls=True).over(within))
    ends = own.groupBy("_file", "_split").agg(F.max(head).alias("_end")).withColumn("_far", F.last("_end", ignorenulls=True).over(upto)).drop("_end")
    own = own.join(ends, ["_file", "_split"]).withColumn("_head", F.coalesce("_near", "_far"))
    groups = own.groupBy("_file", "_head").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_split", "_mark", "value"))), lambda x: x["value"]), "\n").alias("_text"))

    def run(batches):
        wide = pa.decimal128(20, 0)
        kind = pa.list_(pa.struct([("pos", pa.int32()), ("prev_tx_id", wide), ("amount", wide)]))
        schema = pa.schema([("_file", pa.string()), ("_split", pa.int64()), ("_mark", pa.int64()), ("_k", pa.int64()), ("block_id", wide), ("tx_id", wide), ("outputs", pa.int64()), ("inputs", kind)])
        for batch in batches:
            rows = []
            for file, split, mark, text in zip(*(batch.column(k).to_pylist() for k in ("_file", "_s", "_m", "_text"))):
                for k, (b, t, o, i) in enumerate(parse_bytes(text.encode("utf-8", "surrogatepass"), file)):
                    paid = [{"pos": p, "prev_tx_id": Decimal(q), "amount": Decimal(a)} for p, q, a in i]
                    rows.append({"_file": file, "_split": split, "_mark": mark, "_k": k, "block_id": Decimal(b), "tx_id": Decimal(t), "outputs": o, "inputs": paid})
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    narrow = groups.select("_file", F.col("_head.s").alias("_s"), F.col("_head.m").alias("_m"), "_text")
    found = narrow.mapInArrow(run, _FREE)
    inside = F.row_number().over(Window.partitionBy("_file", "_split").orderBy("_mark", "_k")) - 1
    return _numbered(found.withColumn("_in", inside), found.groupBy("_file", "_split").agg(F.count("*").alias("_n")), F.col("_in")).drop("_in", "_k", *_PLACE)


def read_until(spark: SparkSession, path: str | list[str], wide: bool = False) -> tuple[DataFrame, str | None]:
    """Records up to the first malformed one, with their arrival order, and what is wrong with that one (None: all are records).

    Files of one record a line are read in splits; files with records over several lines, or several
    in one, as free text, in which a malformed record is an error where its rows are read.
    """
    own = lines_of(spark, path).filter(F.length(F.trim("value")) > 0)
    if not own.filter(rejected(F.col("value")).isNotNull()).isEmpty():
        opened = F.length(F.regexp_replace("value", r"[^(]++", "")) - F.length(F.regexp_replace("value", r"[^)]++", ""))
        if not own.filter((opened != 0) | F.col("value").rlike(r"\)\s*+\)\s*+\(\s*+\([^()]*+\)\s*+\([^()]")).isEmpty():
            free = read_files(spark, path)
            return (free if wide else _narrowed(free)), None
    numbered = arrival(own)
    bad = numbered.select("seq", rejected(F.col("value")).alias("reason")).filter("reason is not null").agg(F.min("seq")).first()[0]
    if bad is None:
        return parse_lines(numbered, wide=wide), None
    file, what = first_rejected(spark, path)
    return parse_lines(numbered.filter(F.col("seq") < bad), wide=wide), f"{file}: {what}"


def _narrowed(df: DataFrame) -> DataFrame:
    """Decimals as longs."""
    one = lambda x: F.struct(x["pos"].alias("pos"), x["prev_tx_id"].cast("long").alias("prev_tx_id"), x["amount"].cast("long").alias("amount"))
    return df.withColumn("block_id", F.col("block_id").cast("long")).withColumn("tx_id", F.col("tx_id").cast("long")).withColumn("inputs", F.transform("inputs", one))


def fitted(df: DataFrame) -> DataFrame:
    """Records of decimals as longs, if longs hold them all; as they are otherwise."""
    widest = F.greatest(F.max("block_id"), F.max("tx_id"), F.max(F.array_max(F.transform("inputs", lambda x: F.greatest(x["prev_tx_id"], x["amount"])))))
    most = df.agg(widest).first()[0]
    return _narrowed(df) if most is None or most < 1 << 63 else df


def read_lines(spark: SparkSession, path: str | list[str], strict: bool = True, wide: bool = False) -> DataFrame:
    """Records of text files with one record a line, with their arrival order: files by name, then lines."""
    return arrival(parse_lines(lines_of(spark, path), strict=strict, wide=wide))


def edges(parsed: DataFrame) -> DataFrame:
    """(seq, tx_id, pos, prev_tx_id, amount): an input a row."""
    return parsed.select("seq", "tx_id", F.explode("inputs").alias("i")).select("seq", "tx_id", "i.pos", "i.prev_tx_id", "i.amount")


def lines(records: DataFrame, inputs: DataFrame) -> DataFrame:
    """(seq, value): the records in their text form."""
    one = F.concat(F.lit("(0 "), F.col("amount").cast("string"), F.lit(" "), F.col("prev_tx_id").cast("string"), F.lit(" 0)"))
    paid = inputs.withColumn("one", one).groupBy("seq").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "one"))), lambda x: x["one"]), " ").alias("paid"))
    own = records.join(paid, "seq", "left")
    made = F.array_join(F.array_repeat(F.lit("(0 0 0)"), F.col("outputs").cast("int")), " ")
    head = F.concat(F.lit("((0 "), F.col("block_id").cast("string"), F.lit(" "), F.col("tx_id").cast("string"), F.lit(" 0 0 0 0) ("))
    return own.select("seq", F.concat(head, F.coalesce("paid", F.lit("")), F.lit(") ("), made, F.lit("))")).alias("value"))
