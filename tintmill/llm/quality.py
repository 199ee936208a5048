"""Quality classifier: ridge regression on random Fourier features, isotonic calibration.

Statistics of the whole text are standardised and mapped to cosines of random projections, which
approximate a Gaussian kernel. Partitions of the training rows sum their normal equations; the sums
meet on the driver, a bounded number of fixed-size matrices. Scores of the training rows that a
fold of the fit hasn't seen are then calibrated by pool-adjacent-violators.

The fit uses at most ``TRAIN_ROWS`` labelled rows, those of the smallest id hashes (a documented
bound on the sample of labels); every document is scored.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import WORD, cut
from .textops import chunks, release

TRAIN_ROWS, TRAIN_PARTS, FOLDS = 60_000, 8, 4
FEATURES, RIDGE = 256, 1e-2

_WORDS = re.compile(WORD)
NAMES = (
    "log_chars", "log_words", "word_len", "word_len_dev", "letters", "digits", "spaces", "capitals", "punctuation", "symbols", "distinct", "top_word", "repeated_next",
    "pipes", "ends_odd", "all_caps", "initial_caps", "lines", "line_len", "repeated_lines", "stops", "words_a_stop", "short_words", "long_words", "vowels", "non_ascii", "char_entropy", "distinct_pairs", "worst_window", "top_four", "exclaims", "no_stop_run",
)
_VOWELS = frozenset("aeiouyàâäáéèêëíïîóôöúùûü")


def statistics(text: str | None) -> list[float]:
    """Numbers about a whole text, all finite; zeros for an empty one."""
    text = text or ""
    words = _WORDS.findall(text)
    n, size = len(words), max(len(text), 1)
    if not n:
        return [0.0] * len(NAMES)
    chars = Counter(text)
    letters = sum(v for c, v in chars.items() if c.isalpha())
    digits = sum(v for c, v in chars.items() if c.isdigit())
    spaces = sum(v for c, v in chars.items() if c.isspace())
    upper = sum(v for c, v in chars.items() if c.isupper())
    vowels = sum(v for c, v in chars.items() if c.lower() in _VOWELS)
    stops = chars["."] + chars["!"] + chars["?"]
    counts = Counter(words)
    most = counts.most_common(4)
    lengths = np.fromiter(map(len, words), np.int64, n)
    lines = [x for x in text.split("\n") if x.strip()]
    again = np.fromiter((a == b for a, b in zip(words, words[1:])), bool, n - 1)
    odd = np.fromiter((not w[-1].isalnum() and w[-1] not in ".,;:!?" for w in words), bool, n)
    caps = np.fromiter((len(w) > 1 and w.upper() == w and w.lower() != w for w in words), bool, n)
    bad = odd | caps
    bad[1:] |= again
    window = 20
    sums = np.concatenate([[0], np.cumsum(bad)])
    worst = (sums[window:] - sums[:-window]).max() / window if n >= window else bad.mean()
    pairs = len(set(zip(words, words[1:])))
    stop_at = np.flatnonzero(np.fromiter((w[-1] in ".!?" for w in words), bool, n))
    gap = np.diff(np.concatenate([[-1], stop_at, [n]])).max()
    share = np.fromiter(chars.values(), float, len(chars)) / size
    return [
        np.log1p(size), np.log1p(n), lengths.mean(), lengths.std(), letters / size, digits / size, spaces / size, upper / max(letters, 1), (size - letters - digits - spaces) / size, sum(v for c, v in chars.items() if c in "#$%&*@^~{}[]<>|\\_=+") / size,
        len(counts) / n, most[0][1] / n, again.mean() if n > 1 else 0.0, chars["|"] / n, odd.mean(), caps.mean(), sum(w[0].isupper() for w in words) / n, np.log1p(len(lines)), n / max(len(lines), 1) / 50, 1 - len(set(lines)) / max(len(lines), 1),
        stops / n, min(n / max(stops, 1), 200) / 50, (lengths <= 2).mean(), (lengths >= 12).mean(), vowels / max(letters, 1), sum(v for c, v in chars.items() if ord(c) > 127) / size, -(share * np.log2(share)).sum(), pairs / max(n - 1, 1), worst, sum(v for _, v in most) / n, chars["!"] / n, np.log1p(gap),
    ]


def _measure(batches):
    for batch in batches:
        names = [c for c in batch.schema.names if c != "_text"]
        for a, b, texts in chunks(batch.column("_text")):
            values = [list(map(float, statistics(t))) for t in texts]
            yield pa.RecordBatch.from_arrays([*batch.select(names).slice(a, b - a).columns, pa.array(values, pa.list_(pa.float64()))], names=[*names, "_x"])
    release()


class Model:
    """Standardisation, random projections, ridge weights and calibration steps."""

    def __init__(self, mean: np.ndarray, dev: np.ndarray, features: int = FEATURES, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.mean, self.dev = mean, np.where(dev > 1e-9, dev, 1.0)
        # The kernel's width follows the number of statistics.
        self.turn = rng.normal(size=(len(mean), features)) / np.sqrt(2 * len(mean))
        self.phase = rng.uniform(0, 2 * np.pi, features)
        self.weights: np.ndarray | None = None
        self.steps: tuple[np.ndarray, np.ndarray] | None = None

    def lift(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.dev, -8, 8)
        return np.hstack([np.cos(z @ self.turn + self.phase) * np.sqrt(2 / len(self.phase)), z / 10, np.ones((len(z), 1))])

    def calibrated(self, raw: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(raw, *self.steps), 0.0, 1.0)

    def score(self, x: np.ndarray) -> np.ndarray:
        return self.calibrated(self.lift(x) @ self.weights)


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing fit of y to x; each pool stands at its mean x, and values are smoothed towards the base rate."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []
    for a, b in zip(x[order].tolist(), y[order].tolist()):
        pools.append([b, 1.0, a])
        while len(pools) > 1 and pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]:
            s, n, m = pools.pop()
            pools[-1] = [pools[-1][0] + s, pools[-1][1] + n, pools[-1][2] + m]
    rate = float(y.mean())
    return np.array([m / n for _, n, m in pools]), np.array([(s + rate) / (n + 1) for s, n, _ in pools])


def _equations(model: Model):
    def run(batches):
        size = len(model.phase) + len(model.mean) + 1
        left, right = np.zeros((FOLDS, size, size)), np.zeros((FOLDS, size))
        for batch in batches:
            x = np.array(batch.column("_x").to_pylist(), float).reshape(-1, len(model.mean))
            y, fold = batch.column("_y").to_numpy(zero_copy_only=False), batch.column("_fold").to_numpy(zero_copy_only=False)
            lifted = model.lift(x)
            for k in range(FOLDS):
                own = lifted[fold == k]
                left[k] += own.T @ own
                right[k] += own.T @ y[fold == k]
        yield pa.RecordBatch.from_pydict({"left": [left.tobytes()], "right": [right.tobytes()]})

    return run


def fit(train: DataFrame) -> Model | None:
    """Model of (_x, _y, _fold), at most ``TRAIN_ROWS`` rows; None without both labels."""
    names = range(len(NAMES))
    sums = train.agg(F.count("*"), F.sum("_y"), *(F.avg(F.col("_x")[k]) for k in names), *(F.stddev_pop(F.col("_x")[k]) for k in names)).first()
    if not sums[0] or sums[1] in (0, sums[0]):
        return None
    model = Model(np.array(sums[2 : 2 + len(NAMES)], float), np.array(sums[2 + len(NAMES) :], float))
    parts = train.repartition(TRAIN_PARTS).mapInArrow(_equations(model), "left binary, right binary").collect()
    size = len(model.phase) + len(model.mean) + 1
    left = sum(np.frombuffer(p.left).reshape(FOLDS, size, size) for p in parts)
    right = sum(np.frombuffer(p.right).reshape(FOLDS, size) for p in parts)
    solve = lambda a, b, n: np.linalg.solve(a + RIDGE * np.sqrt(max(n, 1)) * np.eye(size) / 10, b)
    others = [solve(left.sum(0) - left[k], right.sum(0) - right[k], sums[0]) for k in range(FOLDS)]
    model.weights = solve(left.sum(0), right.sum(0), sums[0])

    def held(batches):
        for batch in batches:
            x = np.array(batch.column("_x").to_pylist(), float).reshape(-1, len(model.mean))
            fold = batch.column("_fold").to_numpy(zero_copy_only=False)
            raw = np.einsum("ij,ji->i", model.lift(x), np.array(others)[fold].T) if len(x) else np.zeros(0)
            yield pa.RecordBatch.from_pydict({"raw": raw, "y": batch.column("_y").to_numpy(zero_copy_only=False)})

    seen = train.mapInArrow(held, "raw double, y double").toArrow().to_pandas()
    model.steps = isotonic(seen["raw"].to_numpy(), seen["y"].to_numpy())
    return model


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", train_on=None, carry: list[str] | None = None) -> DataFrame:
    """The columns ``carry`` (all by default) of every row, with ``score``: how likely label 1 is.

    Learns from the labels whose id passes ``train_on`` (a condition on the id column; by default
    all). Only statistics of the text enter a score, so equal texts have equal scores. A null or
    empty text counts as a text without words and gets a score like any other. Null labels and ids
    aren't learnt from; an id with several labels counts as its lowest, and its first text in code
    point order. Without labels of both kinds every score is 0.5. An empty table gives no rows. A
    carried column named ``score`` is replaced.
    """
    carry = [c for c in (docs.columns if carry is None else carry) if c.lower() != "score"]
    text = F.col(f"`{text_col}`")
    own = docs.select(F.struct(*(F.col(f"`{c}`") for c in carry), F.lit(True).alias("_all")).alias("_row"), F.col(f"`{id_col}`").cast("long").alias("_id"), text.alias("_text"))
    measured = own.mapInArrow(_measure, StructType([own.schema["_row"], own.schema["_id"], *StructType.fromDDL("_x array<double>")]))
    if text_col not in carry:
        measured = cut(measured)
    known = labels.select(F.col(f"`{id_col}`").cast("long").alias("_lid"), F.col(f"`{label_col}`").cast("double").alias("_y")).filter("_lid is not null and _y is not null")
    if train_on is not None:
        known = known.filter(train_on(F.col("_lid")))
    known = known.groupBy("_lid").agg(F.min("_y").alias("_y"))
    train = known.join(measured.select("_id", "_x") if text_col not in carry else _sampled(own, known), known["_lid"] == F.col("_id"))
    train = train.groupBy("_id").agg(F.min("_y").alias("_y"), F.min("_x").alias("_x")).withColumn("_row", F.xxhash64("_id"))
    train = cut(train.orderBy("_row").limit(TRAIN_ROWS).withColumn("_fold", F.pmod("_row", F.lit(FOLDS)).cast("int")))
    model = fit(train)
    if model is None:
        return measured.select(*(F.col(f"_row.`{c}`").alias(c) for c in carry), F.lit(0.5).alias("score"))

    def rate(batches):
        for batch in batches:
            x = np.array(batch.column("_x").to_pylist(), float).reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array(model.score(x))], names=["_row", "_score"])

    out = measured.select("_row", "_x").mapInArrow(rate, StructType([own.schema["_row"], *StructType.fromDDL("_score double")]))
    return out.select(*(F.col(f"_row.`{c}`").alias(c) for c in carry), F.col("_score").alias("score"))


def _sampled(own: DataFrame, known: DataFrame) -> DataFrame:
    """Statistics of labelled texts alone, measured after the join has found them."""
    texts = own.select("_id", "_text").join(known.select(F.col("_lid").alias("_id")), "_id", "left_semi")
    return texts.mapInArrow(_measure, "_id long, _x array<double>")
