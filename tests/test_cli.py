import pytest

from tintmill import cli

RECORDS = """((0 0 1 0 0 0 0) () ((0 0 0) (0 0 0)))
((0 1 2 0 0 0 0) () ((0 0 0)))
((0 2 3 0 0 0 0) ((0 10 1 0) (0 30 2 0)) ((0 0 0)))
((0 9 4 0 0 0 0) ((0 5 3 0) (0 5 1 0)) ())
"""


@pytest.fixture
def records(tmp_path):
    path = tmp_path / "records.txt"
    path.write_text(RECORDS)
    return str(path)


def run(spark, tmp_path, records, *args):
    out = tmp_path / "out"
    cli.run_color(spark, [*args, "--records", records, "-o", str(out)])
    return out.read_text() if out.exists() else None


def test_text(spark, tmp_path, records):
    want = "(0 . 1) \n(1 . 1) \n(1 . 1) (0 . 1) \n(1 . 1) (0 . 1) \n"
    assert run(spark, tmp_path, records) == run(spark, tmp_path, records, "--rings", "all") == want
    assert run(spark, tmp_path, records, "2") == "(0 . 1) \n(1 . 1) \n"
    assert run(spark, tmp_path, records, "--weighted").splitlines()[2:] == ["(1 . 0.750000) (0 . 0.250000) ", "(1 . 0.375000) (0 . 0.625000) "]


def test_pictures(spark, tmp_path, records, capsys):
    pbm, svg = tmp_path / "p.pbm", tmp_path / "p.svg"
    run(spark, tmp_path, records, "--pbm", str(pbm), "--stats")
    assert pbm.read_bytes() == b"P4\n10 " + b"4".rjust(20) + b"\n" + bytes.fromhex("80004000c000c000")
    said = capsys.readouterr().err.splitlines()
    assert said[0] == "4 records over 10 blocks, so a 10 x 4 picture"
    assert "picture: 10 columns x 4 rows" in said and "picture: 4 runs, 1 a row: 2 bytes a row as --pbm, 7 as --svg" in said
    assert any(x.endswith("  total") and "         4 records " in x for x in said)
    (tmp_path / "none").write_text("\n")
    run(spark, tmp_path, str(tmp_path / "none"), "--pbm", str(pbm))
    assert capsys.readouterr().err.splitlines() == [f"no records, so {pbm} is empty"]
    assert pbm.read_bytes() == b"P4\n0 " + b"0".rjust(20) + b"\n"
    run(spark, tmp_path, records, f"--svg={svg}", "--bin", "2", "--blocks=16")
    assert 'width="16" height="2"' in svg.read_text() and svg.read_text().endswith('d="M0 0h2m-2 1h2"/></svg>\n')
    with pytest.raises(ValueError, match="--blocks 2 or more"):
        run(spark, tmp_path, records, "--pbm", str(pbm), "--blocks", "1")


def test_a_spend_of_something_unknown_stops_the_run(spark, tmp_path):
    path = tmp_path / "bad.txt"
    path.write_text("((0 0 1 0) () ((0 0 0)))\n((0 1 2 0) ((0 1 7 0)) ())\n")
    with pytest.raises(cli.RunError, match="^transaction 2 spends unknown transaction 7$"):
        run(spark, tmp_path, str(path))
    assert (tmp_path / "out").read_text() == "(0 . 1) \n"


@pytest.mark.parametrize("bad", ["((0 3 -4 0) () ())", "((0 3", "((0 18446744073709551616 4) () ())"])
def test_lines_before_a_malformed_record_are_written(spark, tmp_path, bad):
    path = tmp_path / "bad.txt"
    path.write_text(f"{RECORDS}\n{bad}\n((0 5 6 0) () ())\n")
    want = "(0 . 1) \n(1 . 1) \n(1 . 1) (0 . 1) \n(1 . 1) (0 . 1) \n"
    if bad != "((0 3":
        with pytest.raises(cli.RunError, match="bad.txt: .* at byte offset"):
            run(spark, tmp_path, str(path))
        assert (tmp_path / "out").read_text() == want
        # Beyond the limit it is never read.
        assert run(spark, tmp_path, str(path), "4") == want
    else:
        with pytest.raises(Exception, match="at byte offset"):
            run(spark, tmp_path, str(path))


def test_numbers_beyond_a_long(spark, tmp_path):
    top = 2**64 - 2
    path = tmp_path / "wide.txt"
    path.write_text(f"((0 {top} {top} 0) () ((0 0 0)))\n((0 1 2 0) () ((0 0 0)))\n((0 {top} 3 0) ((0 {top} {top} 0) (0 5 2 1)) ())\n")
    assert run(spark, tmp_path, str(path)) == f"({top} . 1) \n(1 . 1) \n({top} . 1) (1 . 1) \n"
    with pytest.raises(Exception, match=f"block {top} does not fit"):
        run(spark, tmp_path, str(path), "--sets")


def test_records_that_share_and_span_lines(spark, tmp_path, records):
    path = tmp_path / "free.txt"
    path.write_text(RECORDS.replace("\n", " ").replace(" () ", "\n() ", 1))
    assert run(spark, tmp_path, str(path)) == run(spark, tmp_path, records)


def test_records_from_standard_input(spark, tmp_path, records, monkeypatch):
    import io
    import types

    monkeypatch.setattr(cli.sys, "stdin", types.SimpleNamespace(buffer=io.BytesIO(RECORDS.encode())))
    cli.run_color(spark, ["-o", str(tmp_path / "own")])
    assert (tmp_path / "own").read_text() == run(spark, tmp_path, records)


@pytest.mark.parametrize(
    "args",
    [["x"], ["1", "2"], ["--bin", "2"], ["--pbm", "a", "--bin", "0"], ["--pbm", "a", "--blocks", "0"], ["--pbm", "a", "--bin", "x"], ["--pbm", "--stats"], ["--rings", "--weighted"], ["--other"]],
)
def test_command_lines_that_make_no_sense(spark, records, args):
    with pytest.raises(cli.UsageError):
        cli.run_color(spark, [*args, "--records", records])


def test_the_last_backend_counts():
    assert [cli.mode_of(x) for x in ([], ["--weighted", "--rings"], ["--rings", "--sets"], ["--weighted"])] == ["rings", "rings", "sets", "weighted"]


def test_trees(spark, tmp_path):
    arcs = tmp_path / "graph.arcs"
    arcs.write_text("# arcs\n0 1\n0 2\n1 3\n1 4\n2 5\n6 7\n7 5\n8 9\n9 8\n")
    cli.run_tree_bitmap(spark, [str(arcs), "-o", str(tmp_path / "t.pbm")])
    assert (tmp_path / "t.pbm").read_bytes() == b"P4\n3 5\n" + bytes.fromhex("60a060c0c0")
    cli.run_tree_bitmap(spark, [str(arcs), "-o", str(tmp_path / "t.pgm"), "--format=pgm"])
    assert (tmp_path / "t.pgm").read_bytes() == b"P5\n3 5\n255\n" + bytes.fromhex("ff008000ff80ff00800080ff0080ff")
    cli.run_tree_svg(spark, [str(arcs), "-o", str(tmp_path / "t.svg"), "--scale", "2"])
    drawn = (tmp_path / "t.svg").read_text()
    assert drawn.count("<circle") == 10 and 'viewBox="0 0 3 9" width="6" height="18"' in drawn and drawn.index("#000000") < drawn.index("#808080")
    for bad in (["--scale", "0"], ["--scale", "x"]):
        with pytest.raises(cli.UsageError):
            cli.run_tree_svg(spark, [str(arcs), *bad])


def test_statistics_of_a_run(spark, tmp_path, records, capsys, monkeypatch):
    monkeypatch.setattr(cli, "STATS_EVERY", 2)
    run(spark, tmp_path, records, "--stats", "--sets")
    said = [x.split() for x in capsys.readouterr().err.splitlines()]
    # After two records both are live; the third spends one output of each, the last one spends the rest.
    assert [x[1:3] + x[5:] for x in said[:2]] == [["2", "records", "2", "live", "set", "elems", "2", "peak", "set", "elems", "2", "colored", "txs"], ["4", "records", "0", "live", "set", "elems", "3", "peak", "set", "elems", "0", "colored", "txs"]]
    assert said[2][1:3] == ["4", "records"] and said[2][-1] == "total"
    assert " ".join(said[3]) == "audit: 0 live set elems, all reachable"
    run(spark, tmp_path, records, "3", "--stats")
    said = capsys.readouterr().err.splitlines()
    assert "4 live nodes" not in said[0] and said[0].split()[5:8] == ["5", "live", "nodes"] and said[-1] == "audit: 6 live nodes, all reachable"
    run(spark, tmp_path, records, "--stats", "--weighted")
    assert capsys.readouterr().err.splitlines()[-1] == "audit: 0 live terms, all reachable, worst drift from sum 1 was 0.000e0"


def test_pixels_that_nodes_share_are_told(spark, tmp_path, capsys):
    arcs = tmp_path / "fan.arcs"
    arcs.write_text("".join(f"0 {k}\n" for k in range(1, 40)))
    cli.run_tree_bitmap(spark, [str(arcs), "-o", str(tmp_path / "t.pbm")])
    said = capsys.readouterr().err.splitlines()
    assert any(x == "2 by 39 pixels, 39 B to write" for x in said)
    assert not any("share a pixel" in x for x in said)


@pytest.mark.parametrize(("n", "want"), [(0, "0 B"), (999, "999 B"), (1000, "1.0 kB"), (1_500_000, "1.5 MB"), (2 * 10**15, "2000.0 TB")])
def test_sizes_as_text(n, want):
    assert cli.size_text(n) == want
