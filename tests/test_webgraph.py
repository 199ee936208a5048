import random

import pytest

from tintmill.sources import webgraph


class Writer:
    """Codes as a string of bits."""

    def __init__(self):
        self.out = []

    def bits(self, x, n):
        self.out.append(format(x, f"0{n}b") if n else "")

    def unary(self, x):
        self.out.append("0" * x + "1")

    def gamma(self, x):
        size = (x + 1).bit_length() - 1
        self.unary(size)
        self.bits((x + 1) - (1 << size), size)

    def zeta(self, x, k):
        x += 1
        h = (x.bit_length() - 1) // k
        self.unary(h)
        low, size = 1 << (h * k), h * k + k
        rest = x - low
        # Minimal binary code of rest among 2**size - low values.
        if rest < low:
            self.bits(rest, size - 1)
        else:
            self.bits(rest + low, size)

    def data(self):
        text = "".join(self.out)
        return int(text + "0" * (-len(text) % 8), 2).to_bytes((len(text) + 7) // 8) if text else b""


def natural(x):
    return 2 * x if x >= 0 else -2 * x - 1


def encode(lists, window, least, k, rng):
    w = Writer()
    for x, own in enumerate(lists):
        w.gamma(len(own))
        if not own:
            continue
        reference = rng.randrange(min(window, x) + 1) if window else 0
        if window:
            w.unary(reference)
        rest = set(own)
        if reference:
            source = lists[x - reference]
            runs, copying, at = [0], True, 0
            for s in source:
                if (s in rest) != copying:
                    runs.append(0)
                    copying = not copying
                runs[-1] += 1
            if copying:
                runs.pop()  # the last copied run is implied
            w.gamma(len(runs))
            for b, size in enumerate(runs):
                w.gamma(size - (b > 0))
            rest -= set(source)
        if rest:
            values = sorted(rest)
            if least:
                spans, at = [], 0
                while at < len(values):
                    end = at
                    while end + 1 < len(values) and values[end + 1] == values[end] + 1:
                        end += 1
                    if end - at + 1 >= least:
                        spans.append((values[at], end - at + 1))
                    at = end + 1
                w.gamma(len(spans))
                last = None
                for begin, size in spans:
                    w.gamma(natural(begin - x) if last is None else begin - last - 1)
                    w.gamma(size - least)
                    last = begin + size
                values = [v for v in values if not any(b <= v < b + n for b, n in spans)]
            last = None
            for v in values:
                w.zeta(natural(v - x) if last is None else v - last - 1, k)
                last = v
    return w.data()


def lists_of(rng, n):
    out = []
    for _ in range(n):
        own = set(rng.sample(range(n), rng.randrange(0, 6)))
        if out and rng.random() < 0.5:
            own |= {v for v in rng.choice(out[-3:]) if rng.random() < 0.8}
        if rng.random() < 0.3:
            begin = rng.randrange(n)
            own |= set(range(begin, min(n, begin + rng.randrange(3, 12))))
        out.append(sorted(own))
    return out


@pytest.mark.parametrize(("window", "least", "k"), [(7, 4, 3), (0, 4, 3), (3, 2, 1), (7, 0, 4)])
def test_lists_come_back(window, least, k):
    rng = random.Random(window + least)
    lists = lists_of(rng, 200)
    facts = {"nodes": "200", "windowsize": str(window), "minintervallength": str(least), "zetak": str(k), "compressionflags": ""}
    assert [own for _, own in webgraph.successors(encode(lists, window, least, k, rng), facts)] == lists


def test_a_graph_is_loaded_from_files(spark, tmp_path):
    rng = random.Random(1)
    lists = lists_of(rng, 50)
    (tmp_path / "g.graph").write_bytes(encode(lists, 7, 4, 3, rng))
    (tmp_path / "g.properties").write_text("#BVGraph properties\nnodes=50\nwindowsize=7\nminintervallength=4\nzetak=3\ncompressionflags=\n")
    nodes, arcs = webgraph.load(spark, str(tmp_path / "g"))
    assert nodes.count() == 50
    assert sorted(map(tuple, arcs.collect())) == [(s, d) for s, own in enumerate(lists) for d in own]


def test_a_graph_that_is_cut_short_is_an_error():
    with pytest.raises(ValueError, match="ends inside"):
        list(webgraph.successors(b"\x00", {"nodes": "3"}))


def test_a_basename_is_drawn(spark, tmp_path):
    from tintmill import cli

    lists = [[1, 2], [3, 4], [5], [], [], [], [7], [5], [9], [8]]
    (tmp_path / "g.graph").write_bytes(encode(lists, 7, 4, 3, random.Random(0)))
    (tmp_path / "g.properties").write_text("nodes=10\nwindowsize=7\nminintervallength=4\nzetak=3\n")
    cli.run_tree_bitmap(spark, [str(tmp_path / "g"), "-o", str(tmp_path / "t.pbm")])
    assert (tmp_path / "t.pbm").read_bytes() == b"P4\n3 5\n" + bytes.fromhex("60a060c0c0")
