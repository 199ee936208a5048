"""Substring dedup: a count-min prefilter, then exact grouping of the windows it leaves.

Documents are dealt into blocks by their id; one exchange of the texts serves all three passes.

1. Each block hashes its windows into ``rows`` count-min rows and sends every row's distinct cells,
   delta coded, to the owners of the cell ranges. An owner adds the blocks' sketches and answers
   each block with one bit a cell: whether the merged count is two or more. The least count over
   the rows never underestimates, so no repeated window is lost.
2. Each block sends those of its windows that every row calls repeated, one entry for each distinct
   window (128-bit key, first place in the block), to the owners of key ranges. An owner groups them
   exactly and answers with the places that aren't the window's first.
3. Each block drops the words that such windows cover.

A block sends a window once however often it holds it, so a passage in a third of all documents
costs its owner one entry a block; no task gathers a key's occurrences.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import total_chars
from .textops import Block, Words, deltas, inside, ngrams, release, undeltas

WINDOW = 20
#: Characters of text a block holds at least, about, and entries of a block's message to an owner.
BLOCK_CHARS, MESSAGE_ITEMS = 1 << 21, 64
#: Cells of a count-min row for each window of the corpus, about, and rows.
CELLS_A_WINDOW, ROWS = 8, 2
#: Cells or entries that come to one owner at least, about.
OWNER_ITEMS = 1 << 20

_MESSAGE = "_block long, _owner long, _row int, _data binary"
_KEY = np.dtype([("h1", "<u8"), ("h2", "<u8"), ("doc", "<i8"), ("start", "<i4")])
_PLACE = np.dtype([("doc", "<i8"), ("start", "<i4")])


def _bits(n: float) -> int:
    return max(0, int(np.ceil(np.log2(max(n, 1)))))


def block_sizes(chars: int, block_chars: int, owner_items: int) -> tuple[int, int]:
    """Characters of a block and items of an owner, for a corpus of so many characters.

    Both grow with its square root from where a message would hold fewer than ``MESSAGE_ITEMS``
    items otherwise (at 100 TB: blocks of 180 MB), so that messages stay worth their overhead. Words
    are laid out a part of a block at a time; what a block holds as a whole is its texts and a few
    numbers for each of its distinct windows.
    """
    block = max(block_chars, int((5 * MESSAGE_ITEMS * chars) ** 0.5))
    return block, max(owner_items, block // 5)


class _Plan:
    """Sizes that follow from the corpus: window length, log2 of a row's cells and of the owners."""

    def __init__(self, chars: int, window: int):
        windows = max(1, chars // 5)
        block, items = block_sizes(chars, BLOCK_CHARS, OWNER_ITEMS)
        self.window = window
        self.blocks = max(1, -(-chars // block))
        self.cell_bits = min(62, max(16, _bits(windows * CELLS_A_WINDOW)))
        self.owner_bits = min(self.cell_bits, _bits(windows / items))


def _read(t: pa.Table) -> tuple[np.ndarray, Block]:
    """Ids (null: the smallest number) and documents of a block, by id and text."""
    release()
    ids = np.array([np.iinfo(np.int64).min if v is None else v for v in t.column("_id").to_pylist()], np.int64)
    texts = t.column("_text").to_pylist()
    order = sorted(range(len(texts)), key=lambda k: (ids[k], texts[k] or ""))
    return ids[order], Block(ids.tolist(), texts, order)


def _windows(words: Words, plan: _Plan) -> tuple[np.ndarray, np.ndarray]:
    """Places (index of the first word) and first hashes of the windows."""
    at = inside(words.first, plan.window, len(words.doc))
    return at, ngrams(words.hashes(0), plan.window, 0)[at] if len(at) else np.zeros(0, np.uint64)


def _cells(h: np.ndarray, row: int, plan: _Plan) -> np.ndarray:
    """The cell of each window in a count-min row; rows take different bits of a remixed hash."""
    return (h if row == 0 else (h ^ (h >> np.uint64(29))) * np.uint64(0x9FB21C651E98DF25 + 2 * row)) >> np.uint64(64 - plan.cell_bits)


def _split(cells: np.ndarray, plan: _Plan) -> tuple[np.ndarray, np.ndarray]:
    """Owners that ascending cells go to, and the borders of their shares."""
    owner = cells >> np.uint64(plan.cell_bits - plan.owner_bits)
    cut = np.flatnonzero(np.diff(owner, prepend=owner[:1] ^ np.uint64(1))) if len(cells) else np.zeros(0, np.int64)
    return owner[cut], np.append(cut, len(cells))


def _sketch(plan: _Plan):
    def run(key: tuple, t: pa.Table) -> pa.Table:
        _, block = _read(t)
        h = np.concatenate([_windows(block.words(k), plan)[1] for k in range(len(block.parts))])
        out = []
        for row in range(ROWS):
            cells, n = np.unique(_cells(h, row, plan), return_counts=True)
            # Row 2r has the cells that the block counts once, row 2r+1 those it counts more often.
            for part, more in ((cells[n == 1], 0), (cells[n > 1], 1)):
                owners, cut = _split(part, plan)
                out += [(key[0].as_py(), int(o), 2 * row + more, deltas(part[a:b])) for o, a, b in zip(owners, cut[:-1], cut[1:])]
        return pa.Table.from_pylist([dict(zip(("_block", "_owner", "_row", "_data"), x)) for x in out], schema=_ARROW)

    return run


_ARROW = pa.schema([("_block", pa.int64()), ("_owner", pa.int64()), ("_row", pa.int32()), ("_data", pa.binary())])


def _merge(t: pa.Table) -> pa.Table:
    """Adds the sketches of one range of cells; answers each block's once-counted cells with a bit each."""
    rows = [(b, o, r, undeltas(d)) for b, o, r, d in zip(*(t.column(k).to_pylist() for k in ("_block", "_owner", "_row", "_data")))]
    out = []
    for row in {r // 2 for _, _, r, _ in rows}:
        own = [x for x in rows if x[2] // 2 == row]
        every = np.sort(np.concatenate([np.concatenate([c, c]) if r % 2 else c for _, _, r, c in own]))
        twice = np.unique(every[1:][every[1:] == every[:-1]])
        for b, o, r, c in own:
            if not r % 2 and len(twice):
                hit = twice[np.minimum(np.searchsorted(twice, c), len(twice) - 1)] == c
                if hit.any():
                    out.append({"_block": b, "_owner": o, "_row": row, "_data": deltas(c[hit])})
    return pa.Table.from_pylist(out, schema=_ARROW)


def _exact(plan: _Plan):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _ARROW.empty_table()
        number = left.column("_block")[0].as_py()
        ids, block = _read(left)
        parts = [_windows(block.words(k), plan) for k in range(len(block.parts))]
        good = []
        for row in range(ROWS):
            known = [undeltas(d) for r, d in zip(right.column("_row").to_pylist(), right.column("_data").to_pylist()) if r == row]
            seen, n = np.unique(np.concatenate([_cells(h, row, plan) for _, h in parts]), return_counts=True)
            good.append(np.unique(np.concatenate([*known, seen[n > 1]])))
        found = []
        for k, (at, h) in enumerate(parts):
            keep = np.full(len(at), all(len(x) for x in good))
            for row, own in enumerate(good):
                if keep.any():
                    cells = _cells(h, row, plan)
                    keep &= own[np.minimum(np.searchsorted(own, cells), len(own) - 1)] == cells
            parts[k] = None
            if keep.any():
                words, at = block.words(k), at[keep]
                some = np.zeros(len(at), _KEY)
                some["h1"], some["h2"] = h[keep], ngrams(words.hashes(1), plan.window, 1)[at]
                some["doc"], some["start"] = ids[block.parts[k][0] + words.doc[at]], at - words.first[words.doc[at]]
                found.append(some)
        if not found:
            return _ARROW.empty_table()
        entry = np.concatenate(found)
        entry = entry[np.lexsort((entry["start"], entry["doc"], entry["h2"], entry["h1"]))]
        new = np.ones(len(entry), bool)
        new[1:] = (entry["h1"][1:] != entry["h1"][:-1]) | (entry["h2"][1:] != entry["h2"][:-1])
        lead = entry[np.flatnonzero(new)[np.cumsum(new) - 1]]
        later = entry[(entry["doc"] != lead["doc"]) | (entry["start"] != lead["start"])]
        first = entry[new]
        owner = first["h1"] >> np.uint64(64 - plan.owner_bits) if plan.owner_bits else np.zeros(len(first), np.uint64)
        cut = np.flatnonzero(np.diff(owner, prepend=owner[:1] ^ np.uint64(1)))
        out = [{"_block": number, "_owner": int(owner[a]), "_row": 0, "_data": _planes(first[a:b])} for a, b in zip(cut, [*cut[1:], len(first)])]
        # What the block settles by itself passes through some owner, unchanged.
        out.append({"_block": number, "_owner": number % (1 << plan.owner_bits), "_row": 1, "_data": _places(later["doc"], later["start"])})
        return pa.Table.from_pylist(out, schema=_ARROW)

    return run


def _planes(rows: np.ndarray) -> bytes:
    """Fixed-size rows with their first bytes together, then their second ones: leading zeros and sorted heads compress."""
    return rows.view(np.uint8).reshape(len(rows), rows.dtype.itemsize).T.tobytes()


def _unplanes(data: bytes, kind: np.dtype) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(kind.itemsize, -1).T).view(kind).reshape(-1)


def _places(doc: np.ndarray, start: np.ndarray) -> bytes:
    out = np.zeros(len(doc), _PLACE)
    out["doc"], out["start"] = doc, start
    return _planes(out)


def _group(t: pa.Table) -> pa.Table:
    """Groups one range of keys exactly; answers each block with its places that aren't a key's first."""
    rows = list(zip(*(t.column(k).to_pylist() for k in ("_block", "_owner", "_row", "_data"))))
    out = [{"_block": b, "_owner": o, "_row": 1, "_data": d} for b, o, r, d in rows if r == 1 and d]
    sent = [(b, o, _unplanes(d, _KEY)) for b, o, r, d in rows if r == 0]
    if sent:
        every = np.concatenate([x for _, _, x in sent])
        who = np.repeat(np.arange(len(sent)), [len(x) for _, _, x in sent])
        order = np.lexsort((every["start"], every["doc"], every["h2"], every["h1"]))
        every, who = every[order], who[order]
        new = np.ones(len(every), bool)
        new[1:] = (every["h1"][1:] != every["h1"][:-1]) | (every["h2"][1:] != every["h2"][:-1])
        lead = np.flatnonzero(new)[np.cumsum(new) - 1]
        later = (every["doc"] != every["doc"][lead]) | (every["start"] != every["start"][lead])
        every, who = every[later], who[later]
        by = np.argsort(who, kind="stable")
        cut = np.searchsorted(who[by], np.arange(len(sent) + 1))
        for k, (b, o, _) in enumerate(sent):
            if cut[k] < cut[k + 1]:
                own = every[by[cut[k] : cut[k + 1]]]
                out.append({"_block": b, "_owner": o, "_row": 0, "_data": _places(own["doc"], own["start"])})
    return pa.Table.from_pylist(out, schema=_ARROW)


def _remove(plan: _Plan, join: bool):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, block = _read(left)
        place = np.concatenate([np.zeros(0, _PLACE), *(_unplanes(d, _PLACE) for d in right.column("_data").to_pylist())])
        # Rows that share an id share its places, as far as they have that many words.
        lo, hi = np.searchsorted(ids, place["doc"], "left"), np.searchsorted(ids, place["doc"], "right")
        kept, counts, removed = [], [], []
        for k, (first, last) in enumerate(block.parts):
            words = block.words(k)
            hit = np.zeros(len(words.doc) + 1, np.int64)
            a, b = np.maximum(lo, first), np.minimum(hi, last)
            for j in range(int((b - a).max()) if len(place) else 0):
                doc, start = (a + j)[a + j < b] - first, place["start"][a + j < b]
                fits = start + plan.window <= words.count[doc]
                np.add.at(hit, (words.first[doc] + start)[fits], 1)
                np.add.at(hit, (words.first[doc] + start + plan.window)[fits], -1)
            gone = np.cumsum(hit[:-1]) > 0
            lost = np.diff(np.concatenate([[0], np.cumsum(gone)])[words.first])
            for d, n in enumerate(lost.tolist()):
                if n or join:
                    x, y = words.first[d], words.first[d + 1]
                    stay = ~gone[x:y]
                    kept.append(b" ".join([words.blob[s:e] for s, e in zip(words.starts[x:y][stay].tolist(), words.ends[x:y][stay].tolist())]).decode("utf-8", "surrogatepass"))
                else:
                    kept.append(block.texts[first + d])
            counts.append(words.count)
            removed.append(lost)
        order = block.order
        out = left.drop_columns(["_block", "_text"]).take(pa.array(order, pa.int64()))
        for name, value in (("_words", pa.array(np.concatenate(counts), pa.int64())), ("_removed", pa.array(np.concatenate(removed), pa.int64())), ("_kept", pa.array(kept, pa.string()))):
            out = out.append_column(name, value)
        return out

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, join: bool = False) -> DataFrame:
    """``docs`` without the words of repeated windows, with ``n_words`` and ``n_removed``.

    A word goes if a window of ``window`` consecutive words that covers it has a word sequence that
    also starts earlier: in a document of smaller id, or earlier in the same. Windows are judged on
    the input. A text that loses words becomes its kept words joined by a space; ``join`` writes
    every text so, otherwise the rest stay as they are.

    A null or empty text has no words; texts shorter than a window keep all. A null id counts as
    the smallest. Rows that share an id are one place: none of them is earlier than the others, so
    a repeated row is treated like the first. An empty table gives an empty one. Other columns pass
    through, but for those named ``n_words`` or ``n_removed``, which the new ones replace.
    """
    plan = _Plan(total_chars(docs, text_col), window)
    rest = [c for c in docs.columns if c.lower() not in {id_col.lower(), text_col.lower(), "n_words", "n_removed"}]
    id_type = docs.schema[id_col].dataType
    own = docs.select(
        F.pmod(F.xxhash64(F.col(f"`{id_col}`").cast("long")), F.lit(plan.blocks)).cast("long").alias("_block"),
        F.col(f"`{id_col}`").cast("long").alias("_id"),
        F.col(f"`{text_col}`").alias("_text"),
        F.struct(*(F.col(f"`{c}`") for c in rest), F.lit(True).alias("_all")).alias("_rest"),
    )
    sketches = own.groupBy("_block").applyInArrow(_sketch(plan), _MESSAGE)
    repeated = sketches.groupBy("_owner").applyInArrow(_merge, _MESSAGE)
    entries = own.groupBy("_block").cogroup(repeated.groupBy("_block")).applyInArrow(_exact(plan), _MESSAGE)
    later = entries.groupBy("_owner").applyInArrow(_group, _MESSAGE)
    schema = StructType([own.schema["_id"], own.schema["_rest"], *StructType.fromDDL("_words long, _removed long, _kept string")])
    done = own.groupBy("_block").cogroup(later.groupBy("_block")).applyInArrow(_remove(plan, join), schema)
    place = {id_col: F.col("_id").cast(id_type), text_col: F.col("_kept")}
    return done.select(*(place.get(c, F.col(f"_rest.`{c}`")).alias(c) for c in docs.columns if c in place or c in rest), F.col("_words").alias("n_words"), F.col("_removed").alias("n_removed"))
