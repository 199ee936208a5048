import pytest
from pyspark.sql import functions as F

from tintmill.operators import picture


def colors(spark, rows):
    return spark.createDataFrame([(k, b) for k, row in enumerate(rows) for b in row], "seq long, block long")


def raster(spark, rows, width, bin):
    own = picture.pixels(colors(spark, rows), bin, width)
    return [bytes(r.bytes).hex() for r in picture.packed(own, width, picture.height(len(rows), bin)).orderBy("row").collect()]


def path(spark, rows, width, bin=1):
    found = picture.strokes(picture.runs(picture.pixels(colors(spark, rows), bin, width)))
    return "".join(r.stroke for r in found.orderBy("row", "start").collect())


@pytest.mark.parametrize(
    ("rows", "width", "bin", "want"),
    [
        ([{0}, {7}, {8}, {15}], 16, 1, "8000 0100 0080 0001"),
        ([{0, 1, 2}], 3, 1, "e0"),
        ([{0, 23}, {1}, set()], 24, 1, "800001 400000 000000"),
        ([{0}, {9}, {23}, {1}, {2}, {3}], 24, 3, "804001 700000"),
        ([{0}, {1}, {2}, {3}, {6}, {7}], 8, 4, "f0 03"),
        ([{0, 15}, {1}, {8}, set()], 16, 2, "c001 0080"),
        ([set(), set()], 8, 1, "00 00"),
    ],
)
def test_rows_are_packed(spark, rows, width, bin, want):
    assert raster(spark, rows, width, bin) == want.split()


def test_the_path_moves_relative_after_the_first_stroke(spark):
    assert path(spark, [{2, 3, 4, 30}, set(), {1}], 40) == "M2 0h3m25 0h1m-30 2h1"


def test_the_path_goes_on_across_buckets_of_rows(spark):
    far = 2 * picture.ROWS_A_BUCKET + 3
    own = spark.createDataFrame([(1, 4), (far, 2)], "seq long, block long")
    assert [r.stroke for r in picture.strokes(picture.runs(picture.pixels(own))).orderBy("row").collect()] == ["M4 1h1", f"m-3 {far - 1}h1"]


def test_a_block_without_a_column_is_named(spark):
    own = colors(spark, [{1}, {3, 64, 70}, {99}])
    first = picture.escaped(own, 10).first()
    assert (first.seq, first.block) == (1, 70) and "--blocks 71" in first.message
    with pytest.raises(Exception, match="no column"):
        picture.pixels(own, 1, 10).collect()


def test_headers_have_one_length(spark):
    assert len({len(picture.svg_header(50, n)) for n in (0, 7, 10**9)}) == 1
    assert picture.pbm_header(5, 12) == "P4\n5 " + " " * 18 + "12\n"
    assert 'height="0"' in picture.svg_header(8, 0)


def test_options_are_checked(spark):
    own = colors(spark, [{1}])
    for bad in ({"bin": 0}, {"width": 0}):
        with pytest.raises(ValueError, match="--"):
            picture.pixels(own, **bad)


def test_survey_and_stats(spark):
    records = spark.createDataFrame([(0, 4), (1, 9)], "seq long, block_id long")
    assert tuple(picture.survey(records).first()) == (10, 2)
    assert tuple(picture.survey(records.filter(F.lit(False))).first()) == (0, 0)
    own = picture.runs(picture.pixels(colors(spark, [{0, 1, 5}, {2}])))
    assert tuple(picture.stats(own, 10, 2).first()) == (10, 2, 3, 1, 2, 7)
