"""Byte-level BPE encoding and decoding by longest matches and backtracking.

A vocabulary of ranks says which bytes are tokens; merging the neighbours of lowest rank first is
the definition of an encoding. Merging takes quadratic time on a long piece. Here an automaton
over all tokens (bytes mapped to Latin-1) finds the longest token at every place, and the encoder
walks from left to right:

* A sequence of tokens is the encoding of its bytes exactly if every two neighbours are the
  encoding of theirs. Whether two tokens may stand side by side is found by merging their few bytes
  once and then remembered.
* At each place the longest token is tried first, then its longest prefix that is a token, and so
  on, until one may follow the token before it and its end is not known to be a dead end.
* Where none may, the last token is taken back, its end is marked as a dead end, and its own next
  shorter prefix is tried. An end is marked at most once, so the walk is linear in the bytes.

Text is first split by the tokenizer's pattern; no token crosses two pieces. Workers remember the
ids of the pieces that they have met, up to a bound, which changes no result.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import batched

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanlight.llm.common import documents, free_name, in_batches, vocabulary_path

RANKS = "byte_bpe_50k.tiktoken"
#: Pieces and pairs of tokens that a worker remembers.
KEPT, KEPT_PAIRS = 400_000, 500_000
#: Bytes of a piece whose matches are held at once, and pieces of a text that are encoded at once.
SPAN, PIECES = 1 << 16, 1 << 16


class BytePairs:
    """``encode(text)`` gives ids as little-endian 32-bit integers, ``decode(ids)`` their bytes."""

    def __init__(self, path: str, pattern: str) -> None:
        import ahocorasick
        import regex

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        if any(bytes([b]) not in self.ranks for b in range(256)):
            raise ValueError("every byte has to be a token")
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.longest_token = max(map(len, self.ranks))
        self.split = regex.compile(pattern)
        self.automaton = ahocorasick.Automaton()
        for token in self.ranks:
            self.automaton.add_word(token.decode("latin-1"), len(token))
        self.automaton.make_automaton()
        self.pieces: dict[str, bytes] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.shorter: dict[int, int | None] = {}

    def merge(self, piece: bytes) -> list[int]:
        """The definition: the two neighbours of lowest rank are merged, the leftmost of equals first."""
        parts = [bytes([b]) for b in piece]
        while len(parts) > 1:
            rank, k = min((self.ranks.get(a + b, len(self.ranks)), k) for k, (a, b) in enumerate(zip(parts, parts[1:])))
            if parts[k] + parts[k + 1] not in self.ranks:
                break
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return [self.ranks[p] for p in parts]

    def may_follow(self, left: int, right: int) -> bool:
        """True if the encoding of the two tokens' bytes is these two; a left of -1 asks for the right one alone."""
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) >= KEPT_PAIRS:
                self.pairs.clear()
            both = [right] if left < 0 else [left, right]
            known = self.pairs[left, right] = self.merge(b"".join(self.tokens[t] for t in both)) == both
        return known

    def next_shorter(self, token: int) -> int | None:
        """The longest token that is a proper prefix of ``token``."""
        if token not in self.shorter:
            whole = self.tokens[token]
            self.shorter[token] = next((self.ranks[whole[:n]] for n in range(len(whole) - 1, 0, -1) if whole[:n] in self.ranks), None)
        return self.shorter[token]

    def longest(self, piece: bytes, start: int) -> list[int]:
        """Lengths of the longest tokens that begin at ``start`` and at the places after it, ``SPAN`` of them at most."""
        n = min(SPAN, len(piece) - start)
        found = [1] * n
        for end, length in self.automaton.iter(piece[start : start + n + self.longest_token].decode("latin-1")):
            at = end + 1 - length
            if at < n and length > found[at]:
                found[at] = length
        return found

    def walk(self, piece: bytes) -> list[int]:
        """The encoding of one piece, without merging it."""
        if piece in self.ranks:
            return [self.ranks[piece]]
        out: list[int] = []
        dead = bytearray(len(piece) + 1)
        at, first, spans = 0, 0, self.longest(piece, 0)
        token: int | None = self.ranks[piece[: spans[0]]]
        while True:
            last = out[-1] if out else -1
            while token is not None and (dead[at + len(self.tokens[token])] or not self.may_follow(last, token)):
                token = self.next_shorter(token)
            if token is not None:
                out.append(token)
                at += len(self.tokens[token])
                if at == len(piece):
                    return out
                if not first <= at < first + len(spans):
                    first, spans = at, self.longest(piece, at)
                token = self.ranks[piece[at : at + spans[at - first]]]
            else:
                if not out:
                    return self.merge(piece)  # only where ranks do not come from merges
                dead[at] = 1
                token = out.pop()
                at -= len(self.tokens[token])
                token = self.next_shorter(token)

    def new_piece(self, piece: str) -> bytes:
        if len(self.pieces) >= KEPT:
            self.pieces.clear()
        ids = np.array(self.walk(piece.encode()), "<u4").tobytes()
        if len(piece) <= 64:
            self.pieces[piece] = ids
        return ids

    def encode(self, text: str) -> bytes:
        known, new = self.pieces, self.new_piece
        if len(text) <= PIECES:
            return b"".join([known[p] if p in known else new(p) for p in self.split.findall(text)])
        found = (m.group() for m in self.split.finditer(text))
        return b"".join(b"".join([known[p] if p in known else new(p) for p in part]) for part in batched(found, PIECES))

    def decode(self, ids: bytes) -> bytes:
        """The bytes of ids as ``encode`` gives them; an unknown id is a ``KeyError``."""
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_CODECS: dict[tuple[str, str], BytePairs] = {}


def codec(folder: str | None = None, name: str = RANKS, pattern: str | None = None) -> BytePairs:
    """The worker's own codec, loaded once. ``pattern`` is the installed tokenizers' if none is given."""
    if pattern is None:
        import public_tokenizers

        pattern = public_tokenizers.PATTERN
    key = (vocabulary_path(name, folder), pattern)
    if key not in _CODECS:
        _CODECS[key] = BytePairs(*key)
    return _CODECS[key]


def _with_binary(df: DataFrame, name: str) -> T.StructType:
    return T.StructType([*df.schema.fields, T.StructField(name, T.BinaryType())])


def encode(docs: DataFrame, text: str = "text", ids: str = "ids", folder: str | None = None) -> DataFrame:
    """``docs`` with one more column: the ids of the whole text as little-endian 32-bit integers.

    A null text is an empty one and has no ids. Texts of any length are encoded whole; repeated rows
    are encoded alike, an empty table stays empty. If ``docs`` has a column called like ``ids``, the new one gets an
    underscore before its name.
    """
    name = free_name(docs, ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = codec(folder)
        for batch in batches:
            found = [made.encode(t or "") for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.binary())], [*batch.schema.names, name])

    return in_batches(docs).mapInArrow(run, _with_binary(docs, name))


def decode(rows: DataFrame, ids: str = "ids", bytes_: str = "bytes", folder: str | None = None) -> DataFrame:
    """``rows`` with one more column: the bytes of the ids in column ``ids``; null ids give null, no ids give no bytes.

    An id outside the vocabulary fails the job. Repeated rows, empty tables and clashing names are as in ``encode``.
    """
    name = free_name(rows, bytes_)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = codec(folder)
        for batch in batches:
            found = [None if b is None else made.decode(b) for b in batch.column(batch.schema.get_field_index(ids)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.binary())], [*batch.schema.names, name])

    return in_batches(rows).mapInArrow(run, _with_binary(rows, name))


def digests(docs: DataFrame, id: str = "doc_id", text: str = "text", folder: str | None = None) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every row: its text is encoded, and the ids are decoded again.

    Ids leave no task, so nothing is as wide as the text. Nulls, lengths, repeated rows and empty tables are as in
    ``encode``; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = codec(folder)
        decimal = {i: b"%d" % i for i in made.tokens}
        for batch in batches:
            counts, ids_sha, bytes_sha = [], [], []
            for t in batch.column(1):
                ids = made.encode(t.as_py() or "")
                numbers = np.frombuffer(ids, "<u4").tolist()
                counts.append(len(numbers))
                ids_sha.append(hashlib.sha256(b" ".join(map(decimal.__getitem__, numbers))).hexdigest())
                bytes_sha.append(hashlib.sha256(made.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha), pa.array(bytes_sha)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return in_batches(rows).mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def op12_backtracking_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(documents(spark, sf_dir))
