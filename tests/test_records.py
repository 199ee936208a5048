import pytest
from pyspark.sql import functions as F

from tintmill.sources import records as text

# Records and what they mean, which any reader of the format must agree with.
GOOD = [
    (b"((1231006505 0 9 1 2 3 4) () ((5 6 7)))", (0, 9, 1, [])),
    (b"((1231006506 1 10 1 2 3 4) ((11 12 9 0)) ((5 6 7) (8 9 10)))", (1, 10, 2, [(0, 9, 12)])),
    (b"((1231006506 1 10\n 1 2 3 4)\n((11 12 9 0))\n((5 6 7)\n(8 9 10)))", (1, 10, 2, [(0, 9, 12)])),
    (b"((1 2 3 0 0 0 0) ((0 0 40 0) (0 0 41 1) (0 0 42 2)) ((1 2 3)))", (2, 3, 1, [(0, 40, 0), (1, 41, 0), (2, 42, 0)])),
    (b"((1 2 3 0 0 0 0) ((0 0 40 0)) ())", (2, 3, 0, [(0, 40, 0)])),
    (b"((1 2 18446744073709551615 0) () ())", (2, 18446744073709551615, 0, [])),
    (b"((99999999999999999999999999 2 3 0) () ())", (2, 3, 0, [])),
    (b"((1 2 3" + b" 0" * 60 + b") () ())", (2, 3, 0, [])),
]
BAD = [
    (b"((1 2 18446744073709551616 0) () ())", "does not fit"),
    (b"((1 -9 3 0) () ())", "negative integer"),
    (b"((-1 9 3 0) () ())", "negative integer"),
    (b"((1 x 3 0) () ())", "expected an integer"),
    (b"((x 2 3 0) () ())", "expected an integer"),
    (b"((1 7) () ((5 6 7)))", "record header has 2 fields"),
    (b"((1 2 3) ((0 0)) ())", "input has 2 fields"),
    (b"((1 2 3", "cut short"),
    (b"((1 2 3) ((0 0 1", "cut short"),
    (b"((1 2 3) ()", "cut short"),
]


@pytest.mark.parametrize(("data", "want"), GOOD)
def test_parses_a_record(data, want):
    assert list(text.parse_bytes(data)) == [want]
    assert list(text.parse_bytes(data + b" \n" + data)) == [want, want]


@pytest.mark.parametrize(("data", "what"), BAD)
def test_says_what_is_wrong_and_where(data, what):
    with pytest.raises(text.RecordError, match=what) as error:
        list(text.parse_bytes(data))
    assert "at byte offset" in str(error.value)


def test_nothing_but_white_space_is_no_record():
    assert list(text.parse_bytes(b"")) == list(text.parse_bytes(b" \n\t ")) == []


def test_lines_agree_with_the_byte_parser(spark):
    lines = [d.decode() for d, w in GOOD if b"\n" not in d and w[1] < 1 << 63]
    rows = text.parse_lines(spark.createDataFrame([(k, v) for k, v in enumerate(lines)], "seq long, value string")).orderBy("seq").collect()
    got = [(r.block_id, r.tx_id, r.outputs, [tuple(i) for i in r.inputs]) for r in rows]
    assert got == [next(text.parse_bytes(v.encode())) for v in lines]


def test_strict_lines_fail_and_lenient_ones_are_left_out(spark):
    df = spark.createDataFrame([(d.decode(),) for d, _ in BAD] + [(GOOD[0][0].decode(),)], "value string")
    assert text.parse_lines(df, strict=False).count() == 1
    with pytest.raises(Exception, match="malformed record|does not fit|fields|integer"):
        text.parse_lines(df).collect()


def test_files_keep_their_order_and_all_bits(spark, tmp_path):
    (tmp_path / "a").write_bytes(GOOD[5][0] + b"\n" + GOOD[1][0])
    (tmp_path / "b").write_bytes(GOOD[2][0])
    rows = text.read_files(spark, str(tmp_path)).orderBy("seq").collect()
    assert [(r.seq, int(r.tx_id), r.outputs) for r in rows] == [(0, 18446744073709551615, 0), (1, 10, 2), (2, 10, 2)]


def test_round_trip_through_text(spark, tmp_path):
    records = spark.createDataFrame([(0, 0, 5, 2), (1, 0, 6, 0), (2, 3, 7, 1)], "seq long, block_id long, tx_id long, outputs long")
    inputs = spark.createDataFrame([(2, 7, 1, 5, 30), (2, 7, 0, 5, 0)], "seq long, tx_id long, pos int, prev_tx_id long, amount long")
    text.lines(records, inputs).orderBy("seq").coalesce(1).select("value").write.text(str(tmp_path / "t"))
    read = text.read_lines(spark, str(tmp_path / "t"))
    assert sorted(map(tuple, read.select("seq", "block_id", "tx_id", "outputs").collect())) == sorted(map(tuple, records.collect()))
    assert sorted(map(tuple, text.edges(read).withColumn("pos", F.col("pos").cast("int")).collect())) == sorted(map(tuple, inputs.collect()))


def record(k, inputs=0):
    return f"((0 {k} {k} 0 0 0 0) ({' '.join(f'(0 5 {j} 0)' for j in range(inputs))}) ((0 0 0)))"


@pytest.mark.parametrize("n", [10, 400, 100_000])
def test_records_of_many_inputs(spark, n):
    df = spark.createDataFrame([(record(7, n),), (record(8, n)[:-1],)], "value string")
    rows = text.parse_lines(df, strict=False).collect()
    assert [(r.tx_id, len(r.inputs)) for r in rows] == [(7, n)]
    assert rows[0].inputs[-1].prev_tx_id == n - 1
    assert df.select(text.rejected(F.col("value")).alias("r")).collect()[1].r == "malformed record"


def test_arrival_follows_names_and_lines_over_unequal_files(spark, tmp_path):
    want, k = [], 0
    for f in range(40):
        n = [1, 30, 2, 400, 0][f % 5]
        (tmp_path / f"part-{f:03}").write_text("".join(f"{record(k + j, j % 3)}\n" + ("\n" if j % 7 == 0 else "") for j in range(n)))
        want += range(k, k + n)
        k += n
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("1000b", before):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            for read in (text.read_lines, text.read_files):
                rows = read(spark, str(tmp_path)).orderBy("seq").collect()
                assert [int(r.tx_id) for r in rows] == want
                assert [r.seq for r in rows] == list(range(len(want)))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_free_form_records_over_many_splits(spark, tmp_path):
    body = "  ".join(record(k, k % 9).replace(" (", "\n(" if k % 3 else " (").replace(" 0", "\n 0" if k % 5 == 0 else " 0") for k in range(300))
    (tmp_path / "free").write_text(f"\n{body}\n\n")
    want = list(text.parse_bytes(body.encode()))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("300b", "5000b", before):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            rows = text.read_files(spark, str(tmp_path / "free")).orderBy("seq").collect()
            assert [(int(r.block_id), int(r.tx_id), r.outputs, [(i.pos, int(i.prev_tx_id), int(i.amount)) for i in r.inputs]) for r in rows] == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_all_64_bits_in_every_wanted_field(spark):
    top = (1 << 64) - 1
    df = spark.createDataFrame([(f"((9{top} {top} {top} 0) ((9{top} {top} {top} 0)) ((9{top} 0 0)))",)], "value string")
    r = text.parse_lines(df, wide=True).first()
    assert (r.block_id, r.tx_id, r.inputs[0].prev_tx_id, r.inputs[0].amount) == (top,) * 4
    with pytest.raises(Exception, match="wider than a long"):
        text.parse_lines(df).collect()
    long_zeros = spark.createDataFrame([(f"((0 {'0' * 50}7 8 0) () ())",)], "value string")
    assert text.parse_lines(long_zeros).first().block_id == 7


def test_lenient_reading_never_fails(spark):
    wide = "9" * 26
    bad = [f"((0 {wide} 1) () ())", f"((0 1 {wide}) () ())", f"((0 1 2) ((0 {wide} 1)) ())", f"((0 1 2) ((0 1 1) (0 1 {wide})) ())", f"((0 {(1 << 64)} 1) () ())", "((1 2 3) ((0 0) (1 2 3)) ())", "(", ")", "((1 2 3) () ()) ((1 2 3) () ())", "\u00e9"]
    df = spark.createDataFrame([(x,) for x in [*bad, "((0 1 2) () ())", "", "  "]], "value string")
    assert [r.tx_id for r in text.parse_lines(df, strict=False).collect()] == [2]
    assert df.filter(text.rejected(F.col("value")).isNotNull()).count() == len(bad)


def test_errors_name_the_file_and_the_byte(spark, tmp_path):
    (tmp_path / "a").write_text("".join(f"{record(k)}\n" for k in range(50)))
    good = "".join(f"{record(k, 2)}\n" for k in range(60))
    (tmp_path / "b").write_text(f"{good}((1 -9 3) () ())\n{record(1)}\n")
    assert text.first_rejected(spark, str(tmp_path / "a")) is None
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("500b", before):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            file, what = text.first_rejected(spark, str(tmp_path))
            assert file.endswith("/b")
            with pytest.raises(text.RecordError) as error:
                list(text.parse_bytes((tmp_path / "b").read_bytes()))
            assert what == str(error.value)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    with pytest.raises(Exception, match=r"negative integer in file:.*/b"):
        text.read_lines(spark, str(tmp_path)).collect()
