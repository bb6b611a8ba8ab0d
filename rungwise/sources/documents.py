"""JSON documents of any size, cut into their elements where they lie (SRC-2).

A file is read in pieces that end at commas, so an element of an array always ends with a piece. What
a piece means depends on whether it starts inside a string and how deep it stands, which is known only
from all pieces before it. Both compose: a split of a file turns either string state into another one
and moves the depth by a fixed number for each of the two. So

1. one pass makes a summary of each split for both states it may start in: the state it ends in, the
   change of depth, and how many commas and closing brackets lead to each relative depth;
2. the summaries, one small row a split, are scanned in file order, which gives each split its start;
   a file is a document if its one value opens with its first character and closes with its last;
3. a second pass cuts each split at the commas of depth 1. Only the elements that cross a split are
   put together from their parts; no other text is moved, and no task sees more than its split.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rungwise.session import materialize

#: Split rows that are broadcast at most; beyond it the pieces are dealt by split instead.
MAX_SPLITS = 500_000
_QUOTE, _COMMA = ord('"'), ord(",")
_STEP = np.zeros(256, np.int64)
_STEP[[ord("["), ord("{")]] = 1
_STEP[[ord("]"), ord("}")]] = -1
_KEPT = _STEP != 0
_KEPT[[_QUOTE, _COMMA]] = True
_BLANK = b" \t\n\r\x0b\x0c"

_SUMMARY = (
    "file string, block bigint, pieces bigint, bytes bigint, size bigint, first string, last string, odd boolean, "
    "delta array<bigint>, commas array<map<bigint,bigint>>, closes array<map<bigint,bigint>>"
)


def read_pieces(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, at, size, piece): the text between commas, in order along ``at`` inside a split."""
    return spark.read.option("lineSep", ",").text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"),
        F.col("_metadata.file_size").alias("size"),
        F.col("value").cast("binary").alias("piece"),
    )


def scan(pieces: list[bytes], inside: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
    """What stands at the brackets and ends of pieces: characters, whether outside strings, depth; and the last state.

    Each piece ends with a comma. Depth counts from the start of the first piece.
    """
    text = (b",".join(pieces) + b",").replace(b"\\\\", b"").replace(b'\\"', b"")
    chars = np.frombuffer(text, np.uint8)
    chars = chars[_KEPT[chars]]
    quoted = (np.cumsum(chars == _QUOTE) + inside) % 2 == 1
    outside = ~quoted
    return chars, outside, np.cumsum(np.where(outside, _STEP[chars], 0)), bool(quoted[-1]) if len(quoted) else inside


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple[str, int], int, int]]:
    """(file, block) and the first and last row of each run of rows of one split."""
    n = batch.num_rows
    if not n:
        return
    # Compared as columns: a file is cut into very many pieces, each a row.
    changes = [pc.not_equal(c.slice(1), c.slice(0, n - 1)) for c in (batch.column("file"), batch.column("block"))]
    starts = [0, *(np.flatnonzero(pc.or_(*changes).to_numpy(zero_copy_only=False)) + 1).tolist()]
    for start, end in zip(starts, [*starts[1:], n]):
        yield (batch.column("file")[start].as_py(), batch.column("block")[start].as_py()), start, end


class _Split:
    """Summary of a split for both states that it may start in."""

    def __init__(self, key: tuple[str, int], size: int) -> None:
        self.key, self.size = key, size
        self.pieces = self.bytes = 0
        self.first = self.last = None
        self.state, self.depth = [False, True], [0, 0]
        self.commas, self.closes = [Counter(), Counter()], [Counter(), Counter()]

    def add(self, pieces: list[bytes]) -> None:
        self.pieces += len(pieces)
        self.bytes += sum(map(len, pieces)) + len(pieces)
        # A piece that is blank stands beside a comma.
        if self.first is None:
            self.first = pieces[0].strip(_BLANK)[:1].decode("latin-1") or ","
        self.last = pieces[-1].strip(_BLANK)[-1:].decode("latin-1") or ","
        for s in (0, 1):
            chars, outside, depth, self.state[s] = scan(pieces, self.state[s])
            depth = depth + self.depth[s]
            for found, held in ((chars == _COMMA, self.commas[s]), (_STEP[chars] < 0, self.closes[s])):
                for d, n in zip(*np.unique(depth[found & outside], return_counts=True)):
                    held[int(d)] += int(n)
            if len(depth):
                self.depth[s] = int(depth[-1])

    def row(self) -> dict:
        return {
            "file": self.key[0], "block": self.key[1], "pieces": self.pieces, "bytes": self.bytes, "size": self.size,
            "first": self.first, "last": self.last, "odd": self.state[0],
            "delta": self.depth, "commas": [list(c.items()) for c in self.commas], "closes": [list(c.items()) for c in self.closes],
        }


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = pa.list_(pa.map_(pa.int64(), pa.int64()))
    schema = pa.schema(
        [("file", pa.string()), ("block", pa.int64()), ("pieces", pa.int64()), ("bytes", pa.int64()), ("size", pa.int64())]
        + [("first", pa.string()), ("last", pa.string()), ("odd", pa.bool_()), ("delta", pa.list_(pa.int64()))]
        + [("commas", counts), ("closes", counts)]
    )
    split = None
    for batch in batches:
        for key, start, end in _runs(batch):
            if split is not None and split.key != key:
                yield pa.RecordBatch.from_pylist([split.row()], schema)
                split = None
            split = split or _Split(key, batch.column("size")[start].as_py())
            split.add(batch.column("piece").slice(start, end - start).to_pylist())
    if split is not None:
        yield pa.RecordBatch.from_pylist([split.row()], schema)


def split_starts(pieces: DataFrame) -> DataFrame:
    """(file, block, kind, inside, depth, number) of each split of a document.

    ``kind`` is the bracket that opens it, ``number`` the element that the split starts in.
    """
    summary = materialize(pieces.select("file", "block", "size", "piece").mapInArrow(_summaries, _SUMMARY), "splits")
    # One row per split.
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(c).over(earlier), F.lit(0))
    state = (before(F.col("odd").cast("int")) % 2).cast("int")
    placed = summary.withColumn("s", state).withColumn("moved", F.get("delta", F.col("s"))).withColumn("depth", before(F.col("moved")))
    at = lambda c, d: F.coalesce(F.try_element_at(F.get(c, F.col("s")), F.lit(d) - F.col("depth")), F.lit(0))
    counted = placed.withColumns({"n": at("commas", 1), "ends": at("closes", 0)})
    # The comma after the last piece of a file is not in it.
    in_order = F.struct("block")
    files = counted.groupBy("file").agg(
        F.min_by("first", in_order).alias("opens"),
        F.max_by("last", in_order).alias("shuts"),
        F.sum("ends").alias("ends"),
        F.sum("moved").alias("deep"),
        F.sum(F.col("odd").cast("int")).alias("quotes"),
        F.sum("bytes").alias("bytes"),
        F.max("size").alias("size"),
    )
    paired = F.concat("opens", "shuts").isin("[]", "{}")
    whole = paired & (F.col("ends") == 1) & (F.col("deep") == 0) & (F.col("quotes") % 2 == 0)
    documents = files.filter(whole & (F.col("bytes") != F.col("size"))).select("file", F.col("opens").alias("kind"))
    numbered = counted.withColumn("number", before(F.col("n")))
    return numbered.join(documents, "file").select("file", "block", "kind", F.col("s").alias("inside"), "depth", "number")


def _elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts of elements, without the brackets of the array around them.

    The first and the last part of a split are marked open, since they may go on outside it.
    """
    schema = pa.schema([("file", pa.string()), ("block", pa.int64()), ("number", pa.int64()), ("open", pa.bool_()), ("text", pa.binary())])
    key, held, number, inside, depth, cut = None, [], 0, False, 0, True

    def part(is_open: bool) -> dict:
        return {"file": key[0], "block": key[1], "number": number, "open": is_open, "text": b",".join(held)}

    def rest() -> list[dict]:
        if not held:
            return []
        if cut and depth == 0:
            held[-1] = held[-1].rstrip(_BLANK)[:-1]
        return [part(True)]

    for batch in batches:
        out = []
        for new, start, end in _runs(batch):
            pieces = batch.column("piece").slice(start, end - start).to_pylist()
            if new != key:
                out += rest()
                key, held, fresh = new, [], True
                number, depth = batch.column("number")[start].as_py(), batch.column("depth")[start].as_py()
                inside, cut = batch.column("inside")[start].as_py() == 1, batch.column("kind")[start].as_py() == "["
                opening = cut and key[1] == 0
            else:
                opening = False
            chars, outside, depths, inside = scan(pieces, inside)
            ends = np.flatnonzero((outside & (depths + depth == 1))[chars == _COMMA]) if cut else ()
            depth += int(depths[-1])
            if opening:
                pieces[0] = pieces[0].lstrip(_BLANK)[1:]
            done = 0
            for e in ends:
                held += pieces[done : e + 1]
                out.append(part(fresh))
                held, done, fresh = [], int(e) + 1, False
                number += 1
            held += pieces[done:]
        yield pa.RecordBatch.from_pylist(out, schema)
    yield pa.RecordBatch.from_pylist(rest(), schema)


def document_elements(spark: SparkSession, path: str, max_splits: int = MAX_SPLITS) -> DataFrame:
    """(file, number, text): the elements of array documents, and object documents whole.

    Files that hold something else give no rows. Brackets are counted here, and nothing else is
    checked: whether the elements are JSON is for the parser. An empty array gives one blank
    element. An element has to fit a row.
    """
    pieces = read_pieces(spark, path)
    starts = materialize(split_starts(pieces), "split-starts")
    if starts.limit(max_splits + 1).count() <= max_splits:
        # Of limited length.
        placed = pieces.join(F.broadcast(starts), ["file", "block"])
    else:
        placed = pieces.join(starts.hint("merge"), ["file", "block"]).repartition("file", "block").sortWithinPartitions("file", "block", "at")
    wanted = placed.select("file", "block", "kind", "inside", "depth", "number", "piece")
    parts = materialize(wanted.mapInArrow(_elements, "file string, block bigint, number bigint, open boolean, text binary"), "elements")
    # Parts of one element, one a split. The comma at which a split ended stands between two parts.
    crossing = (
        parts.filter("open")
        .groupBy("file", "number")
        .agg(F.array_sort(F.collect_list(F.struct("block", F.col("text").cast("string").alias("text")))).alias("p"))
        .select("file", "number", F.array_join(F.transform("p", lambda p: p["text"]), ",").alias("text"))
    )
    return parts.filter("not open").select("file", "number", F.col("text").cast("string").alias("text")).unionByName(crossing)


def of_files(df: DataFrame, files: DataFrame, how: str, max_files: int = MAX_SPLITS, salts: int = 64) -> DataFrame:
    """Rows of ``df`` whose ``file`` is (``left_semi``) or is not (``left_anti``) in ``files``.

    A file may hold most of the rows, so many files are repeated under salts over which rows are dealt.
    """
    if files.limit(max_files + 1).count() <= max_files:
        # Of limited length.
        return df.join(F.broadcast(files), "file", how)
    salted = files.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    dealt = df.withColumn("_salt", F.pmod(F.xxhash64(F.col("at")), F.lit(salts)).cast("int"))
    return dealt.join(salted.hint("merge"), ["file", "_salt"], how).drop("_salt")
