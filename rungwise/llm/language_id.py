"""Language identification by rank-order n-gram profiles.

A profile is the list of the most frequent letter n-grams (one to three characters, words padded
with a boundary). A document's own list is compared with each language's list: every n-gram adds
how far out of place it is, or the full list length if the language lacks it. The language with
the smallest sum wins, ties to the smaller name; the score is 1 minus the sum over its maximum.

Profiles count the n-grams of all training texts. Counting is grouped per batch in the tasks,
summed by (language, n-gram), and only the first ``size`` n-grams of each language reach the
driver. There may be at most ``MAX_LANGUAGES`` labels, which is checked; so the profiles that travel
to the tasks hold at most ``size * MAX_LANGUAGES`` n-grams whatever the input.

Defined results: a text that is null or has no letter gets ``und`` and score 0, and so does every
text when nothing could be learned. Repeated rows are predicted alike, and count each in training.
Rows with a null label take no part in training. A null id is not held out. An empty table gives
no rows. Other columns pass through ``predict`` unread, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

SIZE = 300
MAX_LANGUAGES = 1024
UNKNOWN = "und"
_BOUNDARY = 1
_SHIFT = 21
_COUNT_CHARS = 1_000_000


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def letter_codes(text: str | None) -> np.ndarray:
    """Code points of the lower-cased letters, one boundary around and between words."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    mask = _letters()[points]
    if not mask.any():
        return np.empty(0, np.int64)
    codes = np.where(mask, points, _BOUNDARY).astype(np.int64)
    codes = np.concatenate(([_BOUNDARY], codes, [_BOUNDARY]))
    inside = codes != _BOUNDARY
    return codes[inside | np.concatenate(([True], inside[:-1]))]


def grams(codes: np.ndarray) -> np.ndarray:
    """Numbers of all n-grams of one to three characters; each n-gram has a number of its own."""
    if not len(codes):
        return codes
    pairs = (codes[:-1] << _SHIFT) | codes[1:]
    triples = (pairs[:-1] << _SHIFT) | codes[2:]
    return np.concatenate((codes[codes != _BOUNDARY], pairs, triples))


def ranked(numbers: np.ndarray, size: int = SIZE) -> np.ndarray:
    """The most frequent numbers in order, ties to the smaller one."""
    values, counts = np.unique(numbers, return_counts=True)
    return values[np.argsort(-counts, kind="stable")[:size]]


def learn_profiles(docs: DataFrame, text_col: str = "text", label_col: str = "lang", size: int = SIZE) -> dict[str, list[int]]:
    """The first ``size`` n-grams of each label over all rows of ``docs``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counted(label: str, held: list[np.ndarray]) -> pa.RecordBatch:
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays(
                [pa.array([label] * len(values), pa.string()), pa.array(values, pa.int64()), pa.array(counts, pa.int64())],
                names=["label", "gram", "n"],
            )

        for batch in batches:
            held: dict[str, list[np.ndarray]] = {}
            chars: dict[str, int] = {}
            for label, text in zip(batch.column("label").to_pylist(), batch.column("text")):
                codes = letter_codes(text.as_py())
                if not len(codes):
                    continue
                held.setdefault(label, []).append(grams(codes))
                chars[label] = chars.get(label, 0) + len(codes)
                if chars[label] > _COUNT_CHARS:
                    yield counted(label, held.pop(label))
                    chars[label] = 0
            for label, rest in held.items():
                yield counted(label, rest)

    labelled = docs.select(F.col(label_col).cast("string").alias("label"), F.col(text_col).alias("text")).filter("label is not null and text is not null")
    totals = labelled.mapInArrow(count, "label string, gram bigint, n bigint").groupBy("label", "gram").agg(F.sum("n").alias("n"))
    place = Window.partitionBy("label").orderBy(F.col("n").desc(), "gram")
    first = totals.withColumn("place", F.row_number().over(place)).filter(F.col("place") <= size)
    lists: dict[str, list[int]] = {}
    bound = size * MAX_LANGUAGES
    rows = first.select("label", "place", "gram").take(bound + 1)
    if len(rows) > bound:
        raise ValueError(f"more than {MAX_LANGUAGES} languages to learn")
    for label, _, gram in sorted(rows):
        lists.setdefault(label, []).append(gram)
    return lists


class Profiles:
    """Ranks of all languages in one table, for looking up a document's n-grams at once."""

    def __init__(self, lists: dict[str, list[int]], size: int = SIZE) -> None:
        self.size = size
        self.names = sorted(lists)
        self.known = np.unique(np.concatenate([np.asarray(lists[n], np.int64) for n in self.names]) if self.names else np.empty(0, np.int64))
        # The last row stands for an n-gram that no language has.
        self.ranks = np.full((len(self.known) + 1, len(self.names)), -1, np.int64)
        for column, name in enumerate(self.names):
            self.ranks[np.searchsorted(self.known, lists[name]), column] = np.arange(len(lists[name]))

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and score of a text."""
        own = ranked(grams(letter_codes(text)), self.size)
        if not len(own) or not self.names:
            return UNKNOWN, 0.0
        at = np.searchsorted(self.known, own)
        at[at == len(self.known)] = 0
        at = np.where(self.known[at] == own, at, len(self.known))
        theirs = self.ranks[at]
        away = np.where(theirs < 0, self.size, np.abs(theirs - np.arange(len(own))[:, None])).sum(axis=0)
        best = int(away.argmin())
        return self.names[best], 1.0 - float(away[best]) / (self.size * len(own))


def predict(docs: DataFrame, lists: dict[str, list[int]], text_col: str = "text", size: int = SIZE) -> DataFrame:
    """(row, lang_pred, score): ``row`` holds the whole input row."""
    packed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[text_col].alias("text"))

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiles = Profiles(lists, size)
        for batch in batches:
            found = [profiles.predict(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                names=["row", "lang_pred", "score"],
            )

    # A schema object, since the columns' names need not be plain words.
    return packed.mapInArrow(label, StructType([packed.schema["row"]]).add("lang_pred", "string").add("score", "double"))


def held_out(id_col: Column) -> Column:
    """The fixed fold that takes no part in training."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 3 == 1, F.lit(False))


def _lettered(docs: DataFrame, text_col: str) -> DataFrame:
    """The documents with a letter in them."""
    packed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[text_col].alias("text"))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.select(["row"]).filter(pa.array([len(letter_codes(t.as_py())) > 0 for t in batch.column("text")], pa.bool_()))

    return packed.mapInArrow(keep, StructType([packed.schema["row"]])).select("row.*")


def drop_unidentified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> DataFrame:
    """The documents whose language can be told, all columns as they came.

    A text with no n-gram in common with any profile scores 0 and goes. Where nothing could be
    learned there is nothing to tell by, and all texts with a letter stay.
    """
    lists = learn_profiles(docs.filter(~held_out(docs[id_col])), text_col, label_col)
    if not lists:
        return _lettered(docs, text_col)
    return predict(docs, lists, text_col).filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") > 0)).select("row.*")
