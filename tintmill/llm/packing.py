"""Best-fit packing of token sequences by hierarchical residual packing.

Texts are encoded where they are read; only narrow pieces move. Dealt evenly into groups, they are
best-fitted into sequences there, and nearly full sequences are settled. The underfull ones become
items, which meet in a tree: every round brings the items of ``FAN`` groups together, best-fits
them again and settles the nearly full, until one group is left. A round's moves (bin into bin, at
an offset) are small tables; composed, they place every piece.

Within a group no two bins fit into one after best fit, so at most one is no more than half full, and
only such ones ever move: the others are hosts. A round so moves at most ``FAN`` bins a group, and
hosts of equal room are alike. Of each room, ``FAN`` bins for every round still to come therefore
climb; the rest of that room can't be needed, so leaving them where they are changes no packing. That
bounds every task, at ``FAN * hosts(rounds) * length`` rows, without a cap on what is packed.

Best fit over whole-number sizes needs no search tree: the open bins are kept by their room, one
stack for each of the ``length`` possible rooms, so an item costs at most one scan of a bit mask.
"""

from __future__ import annotations

import json
import sys
import zlib
from array import array
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..plans.lineage import written
from .common import cut
from .textops import chunks, release

LENGTH, END_ID = 1024, 2
#: Room up to which a sequence counts as nearly full and is settled.
NEARLY = 2
#: Groups that meet in one in a round, and pieces of a first group.
FAN, GROUP_PIECES = 8, 250_000

#: The splitting pattern of the byte-level vocabulary (a fixed value of that tokenizer).
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_of() -> dict[str, int]:
    """Byte for each character that byte-level vocabularies write for it: printable bytes stand for themselves, the rest follow from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Encoder:
    """Ids of texts as little-endian 32-bit bytes, equal to those of the tokenizer file at ``path``.

    A byte-level vocabulary whose merges are in the order of the ids they make is read as ranks,
    which a faster library encodes to the same ids; any other tokenizer encodes for itself.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.ranked, self.tokenizer = None, Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        facts = json.loads(self.tokenizer.to_str())
        model, kind = facts["model"], facts.get("pre_tokenizer") or {}
        plain = facts.get("normalizer") is None and kind.get("type") == "ByteLevel" and not kind.get("add_prefix_space") and kind.get("use_regex", True) and model.get("type") == "BPE" and not model.get("ignore_merges")
        if plain:
            import tiktoken

            vocab, byte_of = model["vocab"], _byte_of()
            pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
            made = [vocab.get(a + b, -1) for a, b in pairs]
            if made and made == list(range(made[0], made[0] + len(made))):
                ranks = {bytes(byte_of[c] for c in t): i for t, i in vocab.items() if i <= made[-1]}
                self.ranked = tiktoken.Encoding("ranked", pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
                self.tokenizer = None

    def __call__(self, text: str) -> bytes:
        ids = self.ranked(text) if self.ranked else self.tokenizer.encode(text, add_special_tokens=False).ids
        return array("I", ids).tobytes() if sys.byteorder == "little" and array("I").itemsize == 4 else np.array(ids, "<u4").tobytes()


_encoders: dict[str, Encoder] = {}


def pieces_of(total: int, length: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of so many ids: only the first may be shorter than ``length``."""
    head = total % length or length if total > length else total
    return [(0, head), *((a, length) for a in range(head, total, length))]


class Bins:
    """Open bins by room. Best fit: an item goes where the least room stays."""

    def __init__(self, length: int):
        self.length, self.by_room, self.mask = length, [[] for _ in range(length + 1)], 0

    def add(self, bin_: int, room: int) -> None:
        self.by_room[room].append(bin_)
        self.mask |= 1 << room

    def take(self, size: int) -> tuple[int, int] | None:
        """The fullest bin with room for ``size``, and its room."""
        fits = self.mask >> size
        if not fits:
            return None
        room = size + (fits & -fits).bit_length() - 1
        bin_ = self.by_room[room].pop()
        if not self.by_room[room]:
            self.mask &= ~(1 << room)
        return bin_, room


def best_fit(sizes: Sequence[int], length: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Bin and offset of each item, and the bins' fills; larger items first, ties in their order."""
    bin_of, offset, fill, bins = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64), [], Bins(length)
    for k in np.argsort(-np.asarray(sizes, np.int64), kind="stable").tolist():
        size = int(sizes[k])
        found = bins.take(size)
        at, room = found if found else (len(fill), length)
        if not found:
            fill.append(0)
        bin_of[k], offset[k] = at, fill[at]
        fill[at] += size
        if room > size:
            bins.add(at, room - size)
    return bin_of, offset, fill


def _bin_ids(group: int, n: int, level: int) -> np.ndarray:
    """Numbers that no other group or level gives."""
    return (np.int64(level) << 58) + (np.int64(group) << 30) + np.arange(n, dtype=np.int64)


def _encode(path: str, length: int, with_ids: bool):
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches):
        encode = _encoders.get(path) or _encoders.setdefault(path, Encoder(path))
        for batch in batches:
            for first, last, texts in chunks(batch.column("_text")):
                rows, facts, tokens = [], [], []
                for k in range(first, last):
                    data = encode(texts[k - first] or "") + end
                    for piece, (start, size) in enumerate(pieces_of(len(data) // 4, length)):
                        own = data[4 * start : 4 * (start + size)]
                        rows.append(k)
                        facts.append((piece, start, size, zlib.crc32(own)))
                        if with_ids:
                            tokens.append(own)
                facts = np.array(facts, np.int64).reshape(-1, 4)
                out = batch.select(["_id", "_rest", "_source"]).take(pa.array(rows, pa.int64()))
                new = {"_piece": pa.array(facts[:, 0].astype(np.int32)), "_start": pa.array(facts[:, 1]), "_length": pa.array(facts[:, 2]), "_crc": pa.array(facts[:, 3])}
                if with_ids:
                    flat = np.frombuffer(b"".join(tokens), "<u4").astype(np.int32)
                    new["_ids"] = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(facts[:, 2])]).astype(np.int32), pa.array(flat))
                yield pa.RecordBatch.from_arrays([*out.columns, *new.values()], names=["_id", "_rest", "_source", *new])
        release()

    return run


def _first(length: int):
    def run(key: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by([("_id", "ascending"), ("_piece", "ascending"), ("_crc", "ascending")])
        bin_of, at, fill = best_fit(t.column("_length").to_numpy(), length)
        names, fill = _bin_ids(key[0].as_py(), len(fill), 0), np.array(fill, np.int64)
        for name, value in (("_bin", names[bin_of]), ("_at", at), ("_fill", fill[bin_of])):
            t = t.append_column(name, pa.array(value, pa.int64()))
        return t

    return run


def _again(length: int, level: int):
    def run(key: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by([("_bin", "ascending")])
        bin_of, at, fill = best_fit(t.column("_fill").to_numpy(), length)
        names, fill = _bin_ids(key[0].as_py(), len(fill), level), np.array(fill, np.int64)
        return pa.table({"_bin": t.column("_bin"), "_to": names[bin_of], "_by": at, "_now": fill[bin_of], "_group": np.full(len(at), key[0].as_py(), np.int64)})

    return run


def hosts(rounds: int) -> int:
    """Bins of a group and of a room that may still be needed, with so many rounds to come."""
    return FAN * rounds


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, with_ids: bool = False) -> DataFrame:
    """A row for each piece of each document: its columns (but the text) with ``piece, start, length,
    ids_crc32, sequence_id, offset, row_id`` and, ``with_ids``, ``ids``.

    A document's ids are the tokenizer's, then id 2. Only longer ones than ``length`` are cut, into
    pieces of ``length`` of which the first may be shorter. Pieces fill sequences of at most
    ``length`` gaplessly from offset 0. A null or empty text is one piece: id 2. Null ids and
    repeated rows are packed like others; ``row_id``, a number for each row of ``docs``, tells copies
    of a document apart. An empty table gives no rows. Columns with the names of new ones are
    replaced by these.
    """
    new = ("piece", "start", "length", "ids_crc32", "sequence_id", "offset", "ids", "row_id")
    rest = [c for c in docs.columns if c.lower() not in {id_col.lower(), text_col.lower(), *new}]
    own = docs.select(F.col(f"`{id_col}`").cast("long").alias("_id"), F.col(f"`{text_col}`").alias("_text"), F.struct(*(F.col(f"`{c}`") for c in rest), F.lit(True).alias("_all")).alias("_rest"), F.monotonically_increasing_id().alias("_source"))
    kept = [own.schema["_id"], own.schema["_rest"], *StructType.fromDDL("_source long, _piece int, _start long, _length long, _crc long" + ", _ids array<int>" * with_ids)]
    # Only narrow rows move and are cut into groups; ids wait in a table, and meet their places at the end.
    keyed = own.mapInArrow(_encode(tokenizer, length, with_ids), StructType(kept))
    pieces = written(keyed.withColumn("_key", F.monotonically_increasing_id())) if with_ids else cut(keyed)
    narrow = pieces.select("_key", "_id", "_piece", "_length", "_crc") if with_ids else pieces
    groups = max(1, -(-narrow.count() // GROUP_PIECES))
    # Repeated rows must not share a group: rows are dealt by their place in the table.
    dealt = narrow.withColumn("_group", F.pmod(F.xxhash64("_key" if with_ids else F.monotonically_increasing_id()), F.lit(groups)).cast("long"))
    schema = StructType([*narrow.schema.fields, *StructType.fromDDL("_group long, _bin long, _at long, _fill long")])
    placed = cut(dealt.groupBy("_group").applyInArrow(_first(length), schema))

    def climbing(bins: DataFrame, rounds: int) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("_group", "_fill").orderBy("_bin"))
        return bins.filter(F.col("_fill") < length - NEARLY).distinct().withColumn("_rank", rank).filter(F.col("_rank") <= hosts(rounds)).drop("_rank")

    level, moves, rounds, left = 0, None, 0, groups
    while left > 1:
        left, rounds = -(-left // FAN), rounds + 1
    open_ = climbing(placed.select("_bin", "_fill", "_group"), rounds)
    while groups > 1:
        groups, level = -(-groups // FAN), level + 1
        step = cut(open_.withColumn("_group", F.floor(F.col("_group") / FAN)).groupBy("_group").applyInArrow(_again(length, level), "_bin long, _to long, _by long, _now long, _group long"))
        move = step.select("_bin", "_to", "_by")
        if moves is None:
            moves = move
        else:
            next_ = move.select(F.col("_bin").alias("_to"), F.col("_to").alias("_then"), F.col("_by").alias("_further"))
            moves = moves.join(next_, "_to", "left").select("_bin", F.coalesce("_then", "_to").alias("_to"), (F.col("_by") + F.coalesce("_further", F.lit(0))).alias("_by"))
        open_ = climbing(step.select(F.col("_to").alias("_bin"), F.col("_now").alias("_fill"), "_group"), rounds - level)
    if moves is not None:
        # Only pieces of underfull bins take part; the others keep the place they have.
        short = placed.filter(F.col("_fill") < length - NEARLY).join(moves, "_bin", "left")
        short = short.withColumn("_at", F.col("_at") + F.coalesce("_by", F.lit(0))).withColumn("_bin", F.coalesce("_to", "_bin")).drop("_to", "_by")
        placed = placed.filter(F.col("_fill") >= length - NEARLY).unionByName(short)
    if with_ids:
        placed = pieces.join(placed.select("_key", "_bin", "_at"), "_key")
    id_type = docs.schema[id_col].dataType
    out = [F.col("_id").cast(id_type).alias(id_col), *(F.col(f"_rest.`{c}`").alias(c) for c in rest)]
    out += [F.col(a).alias(b) for a, b in (("_piece", "piece"), ("_start", "start"), ("_length", "length"), ("_crc", "ids_crc32"), ("_bin", "sequence_id"), ("_at", "offset"), ("_source", "row_id"))]
    return placed.select(*out, *([F.col("_ids").alias("ids")] if with_ids else []))
