"""The programs: coloring a stream of records, and drawing a graph's forest.

    python -m tintmill color [<limit>|all] [--stats] [--rings|--sets|--weighted]
                             [--pbm <file>|--svg <file> [--blocks <n>] [--bin <n>]] [--records <path>] [-o <file>]
    python -m tintmill tree-svg <graph> [--nodes <n>] [-o <file>] [--scale <px>]
    python -m tintmill tree-bitmap <graph> [--nodes <n>] [-o <file>] [--format pbm|pgm] [--zoom <n>]

Records come from standard input where no path is given. Of several pictures the last one is drawn.
A record that can't be read, or spends what isn't there, ends the run after the lines of those before.
Statistics are those of the records, not of the clock: all lines tell the time and rate of the whole run,
and what is live is counted color by color, whether or not equal ones would share memory.
A graph is a table of arcs (.parquet, .csv, .txt or .arcs), or the basename of a compressed web-graph.
Rows are ordered by the cluster and streamed through the driver partition by partition, so a picture
needs no more memory there than a partition of it.
"""

from __future__ import annotations

import sys
import time
import uuid
from collections.abc import Iterable, Sequence
from typing import BinaryIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import color, forest, layout, picture, usage, utxo
from .plans.lineage import shared_folder, written
from .sources import graphs, webgraph
from .sources import records as text

LIMIT = 1_000_001
#: Records between two lines about what is live.
STATS_EVERY = 100_000


class UsageError(ValueError):
    """A command line that asks for nothing this can do."""


class RunError(ValueError):
    """Records that can't be followed to the end."""


def options(args: Sequence[str], valued: Iterable[str], flags: Iterable[str]) -> tuple[list[str], dict[str, str], list[str]]:
    """Plain arguments, values of ``--name v`` or ``--name=v``, and flags in the order given. A separate value may not start with ``--``."""
    valued, flags = set(valued), set(flags)
    plain, values, given, k = [], {}, [], 0
    while k < len(args):
        name, equals, value = args[k].partition("=")
        if name in flags and not equals:
            given.append(name)
        elif name in valued:
            if not equals:
                k += 1
                if k >= len(args) or args[k].startswith("--"):
                    raise UsageError(f"{name} needs a value")
                value = args[k]
            values[name] = value
        elif args[k].startswith("-") and args[k] != "-":
            raise UsageError(f"unknown option {args[k]}")
        else:
            plain.append(args[k])
        k += 1
    return plain, values, given


def count(name: str, value: str | None, what: str) -> int | None:
    """A positive whole number, if given."""
    if value is None:
        return None
    if not value.isdigit():
        raise UsageError(f"{name} {value} is not a count")
    if int(value) == 0:
        raise UsageError(f"{name} 0 {what}")
    return int(value)


def mode_of(flags: Sequence[str]) -> str:
    """The backend: rings unless another is named; the last one counts, but weights can't be asked of rings that were named."""
    mode = ""
    for flag in flags:
        if flag == "--weighted" and mode == "rings":
            raise UsageError("rings that are asked for can't hold weights: leave out --rings or --weighted")
        if flag in ("--rings", "--sets", "--weighted"):
            mode = flag[2:]
    return mode or "rings"


# Lines about a run that its readers may match.
def surveyed_line(path: str, records: int, blocks: int, bin_: int) -> str:
    return f"{records} records over {blocks} blocks, so a {blocks} x {picture.height(records, bin_)} picture" if records else f"no records, so {path} is empty"


def total_line(seconds: float, records: int) -> str:
    return f"{seconds:>10.2f}s {records:>10} records {pace(records, seconds):>11}  total"


_LABELS = {"rings": ("live nodes", "arena nodes"), "sets": ("live set elems", "peak set elems"), "weighted": ("live terms", "peak terms")}


def progress_line(seconds: float, records: int, rate: str, live: int, most: int, txs: int, mode: str) -> str:
    now, peak = _LABELS[mode]
    return f"{seconds:>10.2f}s {records:>10} records {rate:>11}  {live:>12} {now}  {most:>12} {peak}  {txs:>10} colored txs"


def audit_line(held: int, mode: str, drift: float | None = None) -> str:
    line = f"audit: {held} {_LABELS[mode][0]}, all reachable"
    if drift is not None:
        mantissa, _, power = f"{drift:.3e}".partition("e")
        line += f", worst drift from sum 1 was {mantissa}e{int(power)}"
    return line


def picture_lines(columns: int, rows: int, runs: int, a_row: int, pbm: int, svg: int) -> list[str]:
    return [f"picture: {columns} columns x {rows} rows", f"picture: {runs} runs, {a_row} a row: {pbm} bytes a row as --pbm, {svg} as --svg"]


def pixels_line(width: int, rows: int, size: str) -> str:
    return f"{width} by {rows} pixels, {size} to write"


def shared_line(n: int) -> str:
    return f"{n} node(s) share a pixel with another and are not drawn separately; --zoom does not help, the grid is what it is"


def pace(records: int, seconds: float) -> str:
    """Records a second, in a few characters."""
    if seconds <= 0:
        return "-- rec/s"
    each = records / seconds
    return f"{each / 1e6:.1f}M rec/s" if each >= 1e6 else f"{each / 1e3:.0f}k rec/s" if each >= 1e3 else f"{each:.0f} rec/s"


def size_text(n: int) -> str:
    """A number of bytes in decimal units."""
    if n < 1000:
        return f"{n} B"
    value, unit = n / 1000, "kB"
    for next_ in ("MB", "GB", "TB"):
        if value < 1000:
            break
        value, unit = value / 1000, next_
    return f"{value:.1f} {unit}"


def _say(line: str) -> None:
    print(line, file=sys.stderr)


def _stdin(spark: SparkSession) -> str:
    """Standard input as a file in the shared folder, so that it can be read twice and by all executors."""
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}.records"
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at)
    while data := sys.stdin.buffer.read(1 << 20):
        out.write(bytearray(data))
    out.close()
    return path


def _rows(df: DataFrame, order: str, column: str) -> Iterable:
    for row in df.orderBy(order).select(column).toLocalIterator():
        yield row[0]


def _open(path: str | None) -> BinaryIO:
    return open(path, "wb") if path else sys.stdout.buffer


def run_color(spark: SparkSession, args: Sequence[str]) -> None:
    plain, values, flags = options(args, ("--pbm", "--svg", "--blocks", "--bin", "--records", "-o", "--out"), ("--stats", "--rings", "--sets", "--weighted"))
    if len(plain) > 1 or (plain and plain[0] != "all" and not plain[0].isdigit()):
        raise UsageError(f"a record limit is a count or all, not {' '.join(plain)}")
    limit = LIMIT if not plain else None if plain[0] == "all" else int(plain[0])
    mode = mode_of(flags)
    drawn = [k for k in values if k in ("--pbm", "--svg")][-1:]
    for name in ("--blocks", "--bin"):
        if name in values and not drawn:
            raise UsageError(f"{name} is about a picture: name one with --pbm or --svg")
    bin_ = count("--bin", values.get("--bin"), "puts no record in a row") or 1
    blocks = count("--blocks", values.get("--blocks"), "makes a picture without columns")

    began = time.monotonic()
    read, failure = text.read_until(spark, values.get("--records") or _stdin(spark), wide=True)
    parsed = utxo.limited(read, limit)
    if limit is not None and failure:
        # A malformed record beyond the limit is never read.
        failure = None if parsed.count() == limit else failure
    parsed = written(text.fitted(parsed))
    inputs = text.edges(parsed)
    first = utxo.first_unknown(parsed, inputs).first()
    if first:
        failure, parsed = first["message"], parsed.filter(F.col("seq") < first["seq"])
        inputs = text.edges(parsed)
    spends = written(utxo.spends(parsed, inputs))
    find = color.weighted if mode == "weighted" else lambda r, i, s: color.closure(r, i, s, mode)
    colors = written(find(parsed, inputs, spends))
    surveyed, n = picture.survey(parsed).first()
    surveyed = int(surveyed)
    if not drawn:
        out = _open(values.get("-o") or values.get("--out"))
        for line in _rows(picture.text_lines(colors), "seq", "line"):
            out.write(line.encode() + b"\n")
        out.flush()
    if failure:
        raise RunError(failure)
    if drawn:
        width, rows = blocks or surveyed, picture.height(n, bin_)
        if not blocks:
            _say(surveyed_line(values[drawn[0]], n, surveyed, bin_))
        escaped = picture.escaped(colors, width).first()
        if escaped:
            raise RunError(escaped["message"])
        pixels = written(picture.pixels(colors, bin_))
        with open(values[drawn[0]], "wb") as out:
            if drawn[0] == "--pbm":
                out.write(picture.pbm_header(width, rows).encode())
                for row in _rows(picture.packed(pixels, width, rows), "row", "bytes"):
                    out.write(row)
            else:
                out.write(picture.svg_header(width, rows).encode())
                strokes = picture.strokes(picture.runs(pixels)).orderBy("row", "start").select("stroke")
                for row in strokes.toLocalIterator():
                    out.write(row[0].encode())
                out.write(picture.SVG_TAIL.encode())
    if "--stats" in flags:
        took = time.monotonic() - began
        # Rings hold a node more a color than it has terms, and one more for the empty ring.
        node = 1 if mode == "rings" else 0
        sizes = written(colors.groupBy("seq").agg((F.count("*") + node).alias("size")))
        for r in usage.progress(parsed, inputs, sizes, STATS_EVERY, n).orderBy("records").toLocalIterator():
            _say(progress_line(took, r["records"], pace(n, took), r["live"] + node, r["peak"] + node, r["txs"], mode))
        _say(total_line(took, n))
        held = utxo.live(parsed, inputs).join(sizes, F.col("version_seq") == F.col("seq")).agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
        _say(audit_line(held + node, mode, color.drift(colors).first()[0] if mode == "weighted" else None))
        if drawn:
            said = picture.stats(picture.runs(pixels), width, rows).first()
            for line in picture_lines(width, rows, said["runs"], said["runs_a_row"], said["pbm_row_bytes"], said["svg_row_bytes"]):
                _say(line)


def _drawing(spark: SparkSession, plain: Sequence[str], nodes: int | None) -> DataFrame:
    if len(plain) != 1:
        raise UsageError("one graph: a table of arcs, or a web-graph's basename")
    kind = next((k for k, ends in (("csv", ".csv"), ("text", (".txt", ".arcs")), ("parquet", ".parquet")) if plain[0].endswith(ends)), None)
    if kind is None:
        every, arcs = webgraph.load(spark, plain[0])
        arcs = written(arcs)
    else:
        arcs = written(graphs.load_arcs(spark, plain[0], kind))
        if nodes is None:
            most = arcs.agg(F.max(F.greatest("src", "dst"))).first()[0]
            nodes = 0 if most is None else most + 1
        every = graphs.nodes_of(spark, nodes)
    own = forest.forest(every, arcs)
    print(forest.summary(own, arcs).first()["text"], file=sys.stderr)
    return written(layout.layout(own))


def run_tree_svg(spark: SparkSession, args: Sequence[str]) -> None:
    plain, values, _ = options(args, ("-o", "--out", "--scale", "--nodes"), ())
    try:
        scale = float(values.get("--scale", "10"))
    except ValueError:
        raise UsageError(f"--scale {values['--scale']} is not a number") from None
    if not 0 < scale < float("inf"):
        raise UsageError("--scale must be positive")
    own = _drawing(spark, plain, count("--nodes", values.get("--nodes"), "leaves nothing to draw"))
    head, tail = layout.svg_parts(own, scale)
    out = _open(values.get("-o") or values.get("--out"))
    out.write(head.encode())
    for fill, leaves in (("#000000", False), ("#808080", True)):
        out.write(f'<g fill="{fill}">\n'.encode())
        for line in _rows(layout.circles(own).filter(F.col("is_leaf") == leaves), "node", "circle"):
            out.write(line.encode() + b"\n")
        out.write(b"</g>\n")
    out.write(tail.encode())
    out.flush()


def run_tree_bitmap(spark: SparkSession, args: Sequence[str]) -> None:
    plain, values, _ = options(args, ("-o", "--out", "--format", "--zoom", "--nodes"), ())
    kind = values.get("--format", "pbm")
    if kind not in ("pbm", "pgm"):
        raise UsageError(f"--format {kind} is neither pbm nor pgm")
    zoom = count("--zoom", values.get("--zoom"), "leaves no pixels") or 1
    own = _drawing(spark, plain, count("--nodes", values.get("--nodes"), "leaves nothing to draw"))
    _, _, width, rows = layout.frame(own)
    width, rows = width * zoom, rows * zoom
    _say(pixels_line(width, rows, size_text((-(-width // 8) if kind == "pbm" else width) * rows)))
    shared = layout.collisions(own).first()["collisions"]
    if shared:
        _say(shared_line(shared))
    dots = layout.zoomed(layout.dots(own), zoom)
    header, packed = (layout.pbm_header, layout.pbm_rows) if kind == "pbm" else (layout.pgm_header, layout.pgm_rows)
    out = _open(values.get("-o") or values.get("--out"))
    out.write(header(width, rows).encode())
    for row in _rows(packed(dots, width, rows), "row", "bytes"):
        out.write(row)
    out.flush()


COMMANDS = {"color": run_color, "tree-svg": run_tree_svg, "tree-bitmap": run_tree_bitmap}


def main(argv: Sequence[str]) -> int:
    if not argv or argv[0] not in COMMANDS:
        print(__doc__, file=sys.stderr)
        return 2
    spark = SparkSession.builder.appName("tintmill").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    try:
        COMMANDS[argv[0]](spark, argv[1:])
    except BrokenPipeError:
        return 0  # whoever read this has had enough
    except UsageError as error:
        print(f"tintmill: {error}", file=sys.stderr)
        return 2
    except RunError as error:
        print(f"tintmill: {error}", file=sys.stderr)
        return 1
    finally:
        spark.stop()
    return 0
