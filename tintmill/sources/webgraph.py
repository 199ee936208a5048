"""Compressed web-graphs: successor lists by reference, intervals and residuals, in instantaneous codes.

The published format (Boldi and Vigna, "The WebGraph framework I", 2004): a node's list copies blocks
of an earlier node's, then names intervals of consecutive successors, then gaps. A list needs only
the last few lists, so a graph is decoded in one pass, without its offsets; that pass is one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_CODES = ("DELTA", "GAMMA", "UNARY", "ZETA", "NIBBLE")


class Bits:
    """Reads codes from bytes, most significant bit first."""

    def __init__(self, data: bytes):
        self.data, self.at, self.held, self.width = data, 0, 0, 0

    def _more(self) -> None:
        part = self.data[self.at : self.at + 32]
        if not part:
            raise ValueError("the graph ends inside a list")
        self.held = (self.held << (8 * len(part))) | int.from_bytes(part)
        self.width += 8 * len(part)
        self.at += len(part)

    def bits(self, n: int) -> int:
        while self.width < n:
            self._more()
        self.width -= n
        out = self.held >> self.width
        self.held &= (1 << self.width) - 1
        return out

    def unary(self) -> int:
        zeros = 0
        while not self.held:
            zeros += self.width
            self.width = 0
            self._more()
        lead = self.width - self.held.bit_length()
        self.width -= lead + 1
        self.held &= (1 << self.width) - 1
        return zeros + lead

    def gamma(self) -> int:
        size = self.unary()
        return (1 << size | self.bits(size)) - 1

    def delta(self) -> int:
        size = self.gamma()
        return (1 << size | self.bits(size)) - 1

    def zeta(self, k: int) -> int:
        size = self.unary() * k
        low = 1 << size
        x = self.bits(size + k - 1)
        return x + low - 1 if x < low else (x << 1 | self.bits(1)) - 1


def _signed(x: int) -> int:
    return x >> 1 if x % 2 == 0 else -((x + 1) >> 1)


def properties(data: bytes) -> dict[str, str]:
    """Keys and values of a graph's properties file."""
    lines = (line.strip() for line in data.decode("latin-1").splitlines())
    return dict(tuple(x.strip() for x in line.split("=", 1)) for line in lines if line and line[0] not in "#!" and "=" in line)


def successors(data: bytes, facts: dict[str, str]) -> Iterator[tuple[int, list[int]]]:
    """(node, ascending successors) of every node."""
    nodes, window, least, k = (int(facts.get(name, default)) for name, default in (("nodes", 0), ("windowsize", 7), ("minintervallength", 4), ("zetak", 3)))
    coded = {"OUTDEGREES": "GAMMA", "BLOCKS": "GAMMA", "BLOCK_COUNT": "GAMMA", "RESIDUALS": "ZETA", "REFERENCES": "UNARY"}
    for flag in facts.get("compressionflags", "").split("|"):
        part, _, code = flag.strip().rpartition("_")
        if part in coded and code in _CODES:
            coded[part] = code
    stream = Bits(data)
    code = {"GAMMA": stream.gamma, "DELTA": stream.delta, "UNARY": stream.unary, "ZETA": lambda: stream.zeta(k)}
    if unknown := {c for c in coded.values() if c not in code}:
        raise ValueError(f"codes not read: {', '.join(sorted(unknown))}")
    degree_of, block_of, blocks_of, residual_of, reference_of = (code[coded[x]] for x in ("OUTDEGREES", "BLOCKS", "BLOCK_COUNT", "RESIDUALS", "REFERENCES"))
    recent: list[list[int]] = [[] for _ in range(window + 1)]
    for x in range(nodes):
        degree = degree_of()
        own: list[int] = []
        if degree:
            reference = reference_of() if window else 0
            if reference > x or reference > window:
                raise ValueError(f"node {x} refers {reference} back")
            if reference:
                source, at, copies = recent[(x - reference) % (window + 1)], 0, True
                count = blocks_of()
                for b in range(count):
                    size = block_of() + (b > 0)
                    if copies:
                        own += source[at : at + size]
                    at, copies = at + size, not copies
                if copies:
                    own += source[at:]
            left = degree - len(own)
            if left and least:
                end = None
                for _ in range(stream.gamma()):
                    begin = x + _signed(stream.gamma()) if end is None else end + stream.gamma() + 1
                    size = stream.gamma() + least
                    own += range(begin, begin + size)
                    left, end = left - size, begin + size
            last = None
            for _ in range(left):
                last = x + _signed(residual_of()) if last is None else last + residual_of() + 1
                own.append(last)
            own.sort()
        recent[x % (window + 1)] = own
        yield x, own


def load(spark: SparkSession, basename: str) -> tuple[DataFrame, DataFrame]:
    """``nodes`` (id) and ``arcs`` (src, dst) of the graph stored at ``basename``.graph and .properties."""
    read = lambda kind: spark.read.format("binaryFile").load(f"{basename}.{kind}").select("content")
    facts = properties(bytes(read("properties").first()["content"]))
    kind = pa.schema([("src", pa.int64()), ("dst", pa.int64())])

    def run(batches):
        for batch in batches:
            for data in batch.column("content").to_pylist():
                src: list[int] = []
                dst: list[int] = []
                for x, own in successors(data, facts):
                    src += [x] * len(own)
                    dst += own
                    if len(src) >= 100_000:
                        yield pa.RecordBatch.from_pydict({"src": src, "dst": dst}, schema=kind)
                        src, dst = [], []
                yield pa.RecordBatch.from_pydict({"src": src, "dst": dst}, schema=kind)

    return spark.range(int(facts.get("nodes", 0))), read("graph").mapInArrow(run, "src long, dst long")
