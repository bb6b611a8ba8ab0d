"""Token counts of a unigram tokenizer without making the tokens.

A unigram tokenizer cuts a text into the vocabulary pieces with the greatest sum of scores. An
Aho-Corasick automaton gives all pieces that end at each place; dynamic programming carries the best
score and the number of pieces up to there. Ties follow the tokenizer: starts are taken from left to
right and only a strictly better score replaces a path, so the longest piece wins. A character
without a piece of its own may be unknown, at the least score of the vocabulary less 10; it becomes
one token per UTF-8 byte if the vocabulary has all bytes, else a run of unknowns is one token.

No piece of a usual vocabulary has a space mark after another character. Then no piece crosses the
place before a space mark, the text can be counted word by word, and counts of frequent words are
remembered. A vocabulary with such pieces is counted over the whole text.

Texts are independent rows, so there is no shuffle. The vocabulary is read by the driver from a
file whose path is a parameter and goes to the tasks, as large as the file.

Defined results: a null or empty text has 0 tokens and score 0. Repeated rows and null ids give one
row each. Only the id and text columns are read. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The space mark of the format and the penalty of unknown characters.
SPACE_MARK = "▁"
UNKNOWN_PENALTY = 10.0
MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
REMEMBERED_WORDS = 200_000


def read_vocabulary(path: str) -> tuple[list[tuple[str, float]], bool]:
    """Pieces with scores of a model file, and whether it has a piece for every byte."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces, bytes_known = [], 0
    for i in range(model.get_piece_size()):
        if model.is_byte(i):
            bytes_known += 1
        elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
            pieces.append((model.id_to_piece(i), model.get_score(i)))
    return pieces, bytes_known == 256


class Counter:
    """Counts the pieces of texts for one vocabulary."""

    def __init__(self, pieces: list[tuple[str, float]], byte_fallback: bool) -> None:
        self.byte_fallback = byte_fallback
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min((score for _, score in pieces), default=0.0) - UNKNOWN_PENALTY
        crossing = re.compile(f"[^{SPACE_MARK}]{SPACE_MARK}")
        self.by_word = SPACE_MARK in self.automaton and not any(crossing.search(piece) for piece, _ in pieces)
        self.words = re.compile(f"{SPACE_MARK}*[^{SPACE_MARK}]+|{SPACE_MARK}+")
        self.known: dict[str, tuple[int, float]] = {}

    def best(self, text: str) -> tuple[int, float]:
        """Pieces and score of the best cut of a marked text."""
        size = len(text)
        scores, counts, unknown = [0.0] * (size + 1), [0] * (size + 1), [False] * (size + 1)
        matches: list[list[tuple[int, float]]] = [[] for _ in range(size + 1)]
        for last, found in self.automaton.iter(text):
            matches[last + 1].append(found)
        for end in range(1, size + 1):
            chosen, single = None, False
            # Longest first, which is the order of starts.
            for length, score in sorted(matches[end], reverse=True):
                start = end - length
                single = single or length == 1
                if chosen is None or scores[start] + score > chosen:
                    chosen = scores[start] + score
                    counts[end] = counts[start] + 1
            if not single and (chosen is None or scores[end - 1] + self.unknown > chosen):
                chosen = scores[end - 1] + self.unknown
                unknown[end] = True
                if self.byte_fallback:
                    counts[end] = counts[end - 1] + len(text[end - 1].encode("utf-8", "surrogatepass"))
                else:
                    counts[end] = counts[end - 1] + (not unknown[end - 1])
            scores[end] = chosen
        return counts[size], scores[size]

    def count(self, text: str | None) -> tuple[int, float]:
        """Tokens and score of a plain text."""
        if not text:
            return 0, 0.0
        marked = SPACE_MARK + text.replace(" ", SPACE_MARK)
        if not self.by_word:
            return self.best(marked)
        total, score, known = 0, 0.0, self.known
        for word in self.words.findall(marked):
            found = known.get(word)
            if found is None:
                found = self.best(word)
                if len(known) >= REMEMBERED_WORDS:
                    known.clear()
                known[word] = found
            total += found[0]
            score += found[1]
        return total, score


def count_tokens(docs: DataFrame, model_path: str = MODEL_PATH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_tokens, best_score."""
    pieces, byte_fallback = read_vocabulary(model_path)
    read = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(pieces, byte_fallback)
        for batch in batches:
            found = [counter.count(text.as_py()) for text in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.float64())],
                names=["doc_id", "n_tokens", "best_score"],
            )

    return read.mapInArrow(count, f"doc_id {dict(read.dtypes)['doc_id']}, n_tokens bigint, best_score double")
