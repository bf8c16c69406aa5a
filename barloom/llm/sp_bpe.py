"""SentencePiece BPE encoding and decoding without running the merges over the text.

A merge-type tokenizer gives a sequence of pieces if and only if every two adjacent
pieces would be left as they are by merging just the two of them.  Encoding is then
a search: at each position take the longest piece that starts there (all matches of
a word come from one Aho-Corasick pass), accept it if it is compatible with the piece
before it, else try the next shorter piece; with none left, mark the position as
failed and step back.  Positions are marked in a bit field, so each fails once and
the search is linear.  Compatibility is decided by re-merging the two pieces and is
remembered.

Pieces that merging can't produce are left out of the automaton.  Characters that no
piece covers are single symbols and become byte pieces at the end.

Where no piece has a space mark inside, or mixes letters with certain marks (both are
checked when the model is loaded), runs between them are independent and the ids of
recent runs are kept, packed, up to twice ``CACHE`` a worker.

A null text is empty and has no ids; texts of any length are encoded whole.  Each row
gets its own result, repeated rows too; an empty table gives an empty one.  Extra columns
pass through ``encode_texts`` and ``decode_ids``, where ``ids`` and ``decoded`` replace
columns of those names; ``digest_texts`` reads id and text only.  The model file is sent
from the driver to the workers.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from barloom.llm.pieces import BYTE, CONTROL, SPACE, UNKNOWN, independent_runs, load, splits_at_spaces
from barloom.llm.workspace import keep, ship_file, tidy
from barloom.session import ship_package

#: Runs whose ids a worker keeps, in each of two generations (about 250 bytes each).
CACHE = 100_000
#: Pairs of pieces whose compatibility a worker keeps (about 150 bytes each).
PAIRS = 200_000
#: Longer words are encoded but not kept.
CACHED_LENGTH = 64


class BpeCodec:
    """Encoder and decoder of one model file."""

    def __init__(self, path: str):
        vocabulary = load(path)
        self.pieces, self.kinds, self.dummy_prefix = vocabulary.pieces, vocabulary.kinds, vocabulary.dummy_prefix
        self.ids = vocabulary.normal()
        self.score = {p: vocabulary.scores[i] for p, i in self.ids.items()}
        self.bytes = vocabulary.byte_ids()
        self.compatible: dict[tuple[str, str], bool] = {}
        reachable = [p for p in self.ids if self.merge(p) == [p]]
        self.automaton = ahocorasick.Automaton()
        for p in reachable:
            self.automaton.add_word(p, p)
        self.automaton.make_automaton()
        known = set(reachable)
        self.shorter = {p: next((p[:n] for n in range(len(p) - 1, 0, -1) if n == 1 or p[:n] in known), None) for p in reachable}
        self.by_word = splits_at_spaces(self.ids)
        self.words = independent_runs(self.ids)
        # Ids of runs as 32-bit numbers: one small object a run, which no garbage collection visits.
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.id_bytes = [self._bytes_of(i) for i in range(len(self.pieces))]
        self.id_text = [str(i) for i in range(len(self.pieces))]

    def merge(self, text: str) -> list[str]:
        """Plain merging, best score first and then leftmost; for short texts."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fits(self, a: str, b: str) -> bool:
        key = (a, b)
        known = self.compatible.get(key)
        if known is None:
            known = not a or self.merge(a + b) == [a, b]
            if len(self.compatible) >= PAIRS:
                self.compatible.clear()
            self.compatible[key] = known
        return known

    def segment(self, text: str) -> list[str]:
        """The pieces of a normalised text."""
        longest: list[str | None] = [None] * len(text)
        for end, p in self.automaton.iter(text):
            longest[end + 1 - len(p)] = p
        out: list[str] = []
        failed = bytearray((len(text) >> 3) + 1)
        at, size, shorter, compatible = 0, len(text), self.shorter, self.compatible.get
        last = ""
        while at < size:
            piece: str | None = longest[at] or text[at]
            while True:
                end = at + len(piece)
                if not failed[end >> 3] >> (end & 7) & 1:
                    fits = compatible((last, piece))
                    if fits or (fits is None and self.fits(last, piece)):
                        out.append(piece)
                        last, at = piece, end
                        break
                piece = shorter.get(piece)
                if piece is None:
                    failed[at >> 3] |= 1 << (at & 7)
                    piece = out.pop()
                    last = out[-1] if out else ""
                    at -= len(piece)
        return out

    def piece_ids(self, parts: Iterable[str]) -> list[int]:
        out = []
        for p in parts:
            i = self.ids.get(p)
            if i is None:
                out += [self.bytes[b] for b in p.encode("utf-8")]
            else:
                out.append(i)
        return out

    def normalise(self, text: str) -> str:
        return (SPACE if self.dummy_prefix and text else "") + text.replace(" ", SPACE)

    def encode(self, text: str) -> list[int]:
        """The ids of a whole text."""
        return memoryview(b"".join(self._by_word(text))).cast("I").tolist()

    def _by_word(self, text: str) -> list[bytes]:
        """The packed ids of every word."""
        text = self.normalise(text)
        words = self.words.findall(text) if self.by_word else [text] * bool(text)
        found = list(map(self.cache.get, words))
        if None in found:
            found = [e or self._word(w) for e, w in zip(found, words, strict=True)]
        return found

    def _word(self, word: str) -> bytes:
        e = self.cache.get(word)  # it may have come up earlier in the same text
        if e is None:
            e = self.older.get(word)
            if e is None:
                e = array("I", self.piece_ids(self.segment(word))).tobytes()
            if len(word) <= CACHED_LENGTH:
                if len(self.cache) >= CACHE:
                    self.older, self.cache = self.cache, {}
                self.cache[word] = e
        return e

    def _bytes_of(self, i: int) -> bytes:
        kind, piece = self.kinds[i], self.pieces[i]
        if kind == BYTE:
            return bytes([int(piece[3:5], 16)])
        if kind == UNKNOWN:
            return " \u2047 ".encode()
        return b"" if kind == CONTROL else piece.replace(SPACE, " ").encode()

    def _joined(self, ids: Iterable[int]) -> str:
        """The text of ids, with the space that encoding put in front."""
        return b"".join(map(self.id_bytes.__getitem__, ids)).decode("utf-8", errors="replace")

    def decode(self, ids: Iterable[int]) -> str:
        text = self._joined(ids)
        return text[1:] if self.dummy_prefix and text.startswith(" ") else text

    def digest(self, text: str) -> tuple[int, str, str]:
        """(number of ids, SHA-256 of the ids, SHA-256 of the decoded text)."""
        ids = self.encode(text)
        listed = ",".join(map(self.id_text.__getitem__, ids))
        return len(ids), hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(self.decode(ids).encode("utf-8", "replace")).hexdigest()

    def forget(self) -> None:
        self.cache, self.older = {}, {}
        self.compatible.clear()


@lru_cache(2)
def _codec(path: str) -> BpeCodec:
    return BpeCodec(path)


def codec(path: str) -> BpeCodec:
    found = _codec(path)
    keep("sp_bpe", found.forget)
    return found


def encode_texts(docs: DataFrame, model: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``docs`` with the ids of each text."""
    keep = [c for c in docs.columns if c != ids_col]
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(ids_col, T.ArrayType(T.IntegerType()))])
    where = ship_file(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(where())
        for b in batches:
            ids = pa.array([c.encode(t or "") for t in b.column(b.schema.get_field_index(text_col)).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*b.columns, ids], names=[*b.schema.names, ids_col])

    ship_package(docs.sparkSession)
    return docs.select(*keep).mapInArrow(tidy("sp_bpe", run), schema)


def decode_ids(df: DataFrame, model: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """``df`` with the text of its ids; null ids give an empty text."""
    keep = [c for c in df.columns if c != text_col]
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(text_col, T.StringType())])
    where = ship_file(df.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(where())
        for b in batches:
            texts = pa.array([c.decode(i or ()) for i in b.column(b.schema.get_field_index(ids_col)).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, texts], names=[*b.schema.names, text_col])

    ship_package(df.sparkSession)
    return df.select(*keep).mapInArrow(tidy("sp_bpe", run), schema)


def digest_texts(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of every text, encoded and decoded a word at a time."""
    schema = T.StructType([docs.schema[id_col], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
    where = ship_file(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(where())
        for b in batches:
            found = [c.digest(t.as_py() or "") for t in b.column(1)]
            n, ids, decoded = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], names=schema.names)

    ship_package(docs.sparkSession)
    return docs.select(id_col, text_col).mapInArrow(tidy("sp_bpe", run), schema)
