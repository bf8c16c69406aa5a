"""Token counts of a unigram tokenizer by a Viterbi pass that carries only scores and counts.

One Aho-Corasick pass lists the vocabulary pieces that end at each character.  For
every position two numbers are kept: the best score of a segmentation up to there, and
its number of pieces.  No path is stored.

Tie rules are the tokenizer's: of equal scores the piece that starts earliest wins; a
character without a piece of its own costs the lowest score minus ten and, by byte
fallback, counts as many tokens as it has bytes in UTF-8.

Scores are added in double precision.  The scores in the vocabulary file are whole
numbers, so sums are exact and words can be counted one by one where no piece has a
space mark inside; counts of recent words are kept, up to ``CACHE`` words a worker.

A null text is empty and has no tokens; texts of any length are counted whole.  Each row
gets its own count, repeated rows too; an empty table gives an empty one.  Only id and
text are read, so other columns can't clash.  The vocabulary file is sent from the driver
to the workers.

The vocabularies at hand are of merge-type tokenizers: their scores are merge ranks, not
log-probabilities.  Read as a unigram model they give exact counts of that model, and of
no tokenizer that was trained as one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from barloom.llm.pieces import SPACE, independent_runs, load, splits_at_spaces
from barloom.llm.workspace import keep, ship_file, tidy
from barloom.session import ship_package

CACHE = 200_000
CACHED_LENGTH = 64
UNKNOWN_PENALTY = 10.0


class UnigramCounter:
    def __init__(self, path: str):
        vocabulary = load(path)
        scores = {p: vocabulary.scores[i] for p, i in vocabulary.normal().items()}
        self.single = {p for p in scores if len(p) == 1}
        self.unknown = min(vocabulary.scores[i] for i in vocabulary.normal().values()) - UNKNOWN_PENALTY
        self.automaton = ahocorasick.Automaton()
        for p, s in scores.items():
            self.automaton.add_word(p, (len(p), s))
        self.automaton.make_automaton()
        exact = all(s == int(s) for s in scores.values())
        self.by_word = exact and splits_at_spaces(scores)
        self.dummy_prefix = vocabulary.dummy_prefix
        self.words = independent_runs(scores)
        self.cache: dict[str, int] = {}

    def viterbi(self, text: str) -> tuple[float, int]:
        """(best score, its number of tokens) of a normalised text."""
        size = len(text)
        best, count, single = [0.0] * (size + 1), [0] * (size + 1), self.single
        matches = self.automaton.iter(text)
        following = next(matches, None)
        for end in range(1, size + 1):
            top, n = None, 0
            while following is not None and following[0] == end - 1:
                length, s = following[1]  # longest first, so starts ascend
                s += best[end - length]
                if top is None or s > top:
                    top, n = s, count[end - length] + 1
                following = next(matches, None)
            c = text[end - 1]
            if c not in single:
                s = best[end - 1] + self.unknown
                if top is None or s > top:
                    top, n = s, count[end - 1] + len(c.encode("utf-8"))
            best[end], count[end] = top, n
        return best[size], count[size]

    def count(self, text: str) -> int:
        if not text:
            return 0
        text = (SPACE if self.dummy_prefix else "") + text.replace(" ", SPACE)
        if not self.by_word:
            return self.viterbi(text)[1]
        cache, total = self.cache, 0
        for w in self.words.findall(text):
            n = cache.get(w)
            if n is None:
                n = self.viterbi(w)[1]
                if len(w) <= CACHED_LENGTH:
                    if len(cache) >= CACHE:
                        cache.clear()
                    cache[w] = n
            total += n
        return total


@lru_cache(2)
def _counter(path: str) -> UnigramCounter:
    return UnigramCounter(path)


def counter(path: str) -> UnigramCounter:
    found = _counter(path)
    keep("token_count", found.cache.clear)
    return found


def count_tokens(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, n_tokens) of every text."""
    schema = T.StructType([docs.schema[id_col], T.StructField("n_chars", T.LongType()), T.StructField("n_tokens", T.LongType())])
    where = ship_file(docs.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(where())
        for b in batches:
            sizes, counts = [], []
            for t in b.column(1):
                t = t.as_py() or ""
                sizes.append(len(t))
                counts.append(c.count(t))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())], names=schema.names)

    ship_package(docs.sparkSession)
    return docs.select(id_col, text_col).mapInArrow(tidy("token_count", run), schema)
