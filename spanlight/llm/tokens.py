"""Encoding whole texts with a public tokenizer, a word at a time and each word once.

A BPE tokenizer first splits a text into pieces that no merge crosses. The splits used here are
coarser than the tokenizer's own, so the ids of a text are the ids of its pieces in order. Each
worker keeps the pieces it has met with their ids as bytes; only new pieces reach the library.
The stores are emptied when they are full, which bounds their memory and changes no result.
"""

from __future__ import annotations

import functools
import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

from spanlight.llm.common import vocabulary_path

#: Pieces, and parts of pieces, that a worker keeps; about 200 bytes each.
KEPT, KEPT_PARTS = 350_000, 150_000
#: Pieces met since the store was last turned over; as many from before are kept beside them.
KEPT_SPACED = 500_000
#: Characters of texts that are cut into pieces together, and new pieces that the library merges together.
TOGETHER, TOGETHER_PIECES = 1 << 22, 10_000
#: Marks after a word, which are one part by themselves.
_MARKS = ".,;:!?"
_LETTERS = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff"
#: Words of these characters are split here as the tokenizer would; all others are left to it.
_PLAIN = re.compile(f" ?[!-~{_LETTERS}]+")
#: A space or a line break, letters or digits, and marks: the space belongs to the part that follows, a line break and marks are parts.
_SIMPLE = re.compile(f"[ \n](?:[{_LETTERS}]+|[0-9]+)[{_MARKS}]*")
_SOME_MARKS = re.compile(f"[{_MARKS}]+")
#: White space that is neither a space nor a line break, and controls that some rules take for white space.
_OTHER_SPACE = re.compile("[\\t\\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def _byte_letters() -> dict[int, str]:
    """Byte-level vocabularies write printable bytes as themselves and the others from code point 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + n) for n, b in enumerate(others)}


class PieceEncoder:
    """``encode(text)`` gives the ids of a text as little-endian bytes of ``width`` each."""

    #: The tokenizer's own split, for plain words.
    parts: re.Pattern
    kept_parts = KEPT_PARTS

    def __init__(self, path: str, width: int) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        names = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        #: Texts that spell a special token are left to the library as a whole; it turns them into that token.
        self.special = re.compile("|".join(names) or "(?!)")
        self.model = self.tokenizer.model
        self.width, self.letters = width, _byte_letters()
        self.pieces: dict = {}
        self.known_parts: dict[str, bytes] = {}

    def encode(self, text: str) -> bytes:
        """Ids of a whole text, those that ``Tokenizer.encode(text, add_special_tokens=False)`` gives."""
        return self.library(text) if self.special.search(text) else self.pieced(text)

    def encode_all(self, texts: list[str]) -> Iterator[bytes]:
        """``encode`` of each text, in order."""
        return map(self.encode, texts)

    def library(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return b"".join([i.to_bytes(self.width, "little") for i in ids])

    def word(self, word: str) -> bytes:
        """Ids of a plain word: those of its parts, each from the library's merges or met before."""
        if not _PLAIN.fullmatch(word):
            return self.library(word)
        known = self.known_parts
        return b"".join([known[p] if p in known else self.part(p) for p in self.parts.findall(word)])

    def part(self, part: str) -> bytes:
        """Ids of a new part by the library's merges."""
        if len(self.known_parts) >= self.kept_parts:
            self.known_parts.clear()
        written = part.replace(" ", self.letters[32]) if part.isascii() else part.encode().decode("latin-1").translate(self.letters)
        ids = self.known_parts[part] = b"".join([t.id.to_bytes(self.width, "little") for t in self.model.tokenize(written)])
        return ids

    def pieced(self, text: str) -> bytes:
        raise NotImplementedError


class BytePieces(PieceEncoder):
    """For the byte-level vocabulary: a piece is a word with the space or the line break before it.

    Its rule joins one space to the word that follows and keeps runs of white space together, so
    texts with two white-space characters in a row, or with other white space, are encoded at once.
    Many texts are cut together: each of their pieces is looked up once, the parts of new ones reach
    the library's merges in one call, and the ids of all texts are gathered from those of the pieces.
    """

    parts = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[0-9]+| ?[^\\s0-9{_LETTERS}]+")

    def __init__(self, path: str, width: int) -> None:
        super().__init__(path, width)
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        #: The same merges, for parts that are written in the vocabulary's letters with tabs between them.
        self.merges = Tokenizer(self.model)
        self.merges.pre_tokenizer = WhitespaceSplit()
        self.tabbed = self.letters | {9: "\t", 10: self.letters[10] + "\t"}
        vocabulary = self.tokenizer.get_vocab()
        #: Which ids begin with the letter for a space or a line break, which stand nowhere else in a piece.
        self.opens = np.zeros(max(vocabulary.values()) + 1, bool)
        self.opens[[i for token, i in vocabulary.items() if token[0] in (self.letters[32], self.letters[10])]] = True
        self.spaced: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def pieced(self, text: str) -> bytes:
        return self.library(text) if self.runs(text) else self.together([text])[0]

    def runs(self, text: str) -> bool:
        """Whether white space stands so that the library has to see the text as a whole."""
        return bool("  " in text or "\n\n" in text or "\n " in text or " \n" in text or text[-1:] == " " or _OTHER_SPACE.search(text))

    def encode_all(self, texts: list[str]) -> Iterator[bytes]:
        start = size = 0
        for k, text in enumerate(texts):
            if start < k and size + len(text) > TOGETHER:
                yield from self.mixed(texts[start:k])
                start, size = k, 0
            size += len(text)
        yield from self.mixed(texts[start:])

    def mixed(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of texts of which the library has to see some as a whole."""
        whole = [self.special.search(t) is not None or self.runs(t) for t in texts]
        pieced = iter(self.together([t for t, w in zip(texts, whole, strict=True) if not w]))
        return (self.library(t) if w else next(pieced) for t, w in zip(texts, whole, strict=True))

    def together(self, texts: list[str]) -> list[bytes]:
        """Ids of texts without a special token or runs of white space."""
        stored = pa.array(texts, pa.large_string())
        _, ends, data = stored.buffers()
        ends = np.frombuffer(ends, np.int64)[: len(texts) + 1] if texts else np.zeros(1, np.int64)
        if not ends[-1]:
            return [b""] * len(texts)
        letters = np.frombuffer(data, np.uint8)[: ends[-1]]
        cut = (letters == 32) | (letters == 10)
        cut[ends[:-1][np.diff(ends) > 0]] = True
        cuts = np.append(np.flatnonzero(cut), ends[-1])
        found = pa.LargeStringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts), data).dictionary_encode()
        known = self.look_up(found.dictionary.to_numpy(zero_copy_only=False).tolist())
        counts = np.fromiter(map(len, known), np.int64, len(known)) // self.width
        which = found.indices.to_numpy()
        starts, counts = (np.cumsum(counts) - counts)[which], counts[which]
        stops = np.cumsum(counts)
        ids = np.frombuffer(b"".join(known), f"<u{self.width}")[np.repeat(starts - stops + counts, counts) + np.arange(stops[-1])].tobytes()
        bounds = (np.append(0, stops)[np.searchsorted(cuts, ends)] * self.width).tolist()
        return [ids[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]

    def look_up(self, pieces: list[str]) -> list[bytes]:
        """Ids of different pieces, from the store or met now; those not asked for since the turnover before the last are forgotten."""
        if len(self.spaced) >= KEPT_SPACED:
            self.spaced, self.before = {}, self.spaced
        spaced, before, new = self.spaced, self.before, []
        known = list(map(spaced.get, pieces))
        for k in [k for k, ids in enumerate(known) if ids is None]:
            piece = pieces[k]
            if piece in before:
                known[k] = spaced[piece] = before[piece]
            elif _SIMPLE.fullmatch(piece):
                new.append(k)
            else:
                known[k] = spaced[piece] = self.line_break + self.word(piece[1:]) if piece[0] == "\n" else self.word(piece)
        for a in range(0, len(new), TOGETHER_PIECES):
            some = new[a : a + TOGETHER_PIECES]
            for k, ids in zip(some, self.merge([pieces[k] for k in some]), strict=True):
                known[k] = spaced[pieces[k]] = ids
        return known

    def merge(self, pieces: list[str]) -> list[bytes]:
        """Ids of simple pieces, by the library's merges in one call."""
        written = _SOME_MARKS.sub("\t\\g<0>", "\t".join(pieces)).encode().decode("latin-1").translate(self.tabbed)
        ids = np.array(self.merges.encode_batch_fast([written], add_special_tokens=False)[0].ids, f"<u{self.width}")
        bounds = (np.append(np.flatnonzero(self.opens[ids]), len(ids)) * self.width).tolist()
        ids = ids.tobytes()
        return [ids[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]

    @functools.cached_property
    def line_break(self) -> bytes:
        return self.library("\n")


class WordPieces(PieceEncoder):
    """For the lower-casing vocabulary that drops white space: a piece is a word between white space.

    Nothing that it does to a text, composing and lower-casing included, crosses ASCII white
    space; what other white space there is stays inside a piece and is left to the library.
    """

    parts = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\xdf-\xf6\xf8-\xff]+|[0-9]|[^\\sa-z0-9\xdf-\xf6\xf8-\xff]+")

    def pieced(self, text: str) -> bytes:
        words, known = text.encode().split(), self.pieces
        try:
            return b"".join([known[w] for w in words])
        except KeyError:
            if len(known) >= KEPT:
                known.clear()
            return b"".join([known[w] if w in known else known.setdefault(w, self.new(w)) for w in words])

    def new(self, piece: bytes) -> bytes:
        word = piece.decode()
        return self.word(word.lower()) if _PLAIN.fullmatch(word) else self.library(word)


_ENCODERS: dict[tuple, PieceEncoder] = {}


def encoder(kind: Callable[..., PieceEncoder], name: str, width: int, folder: str | None = None) -> PieceEncoder:
    """The worker's own encoder, loaded once and kept from task to task."""
    key = (kind, name, width, folder)
    if key not in _ENCODERS:
        _ENCODERS[key] = kind(vocabulary_path(name, folder), width)
    return _ENCODERS[key]


def byte_encoder(folder: str | None = None) -> PieceEncoder:
    return encoder(BytePieces, "byte_bpe_50k.json", 4, folder)


def word_encoder(folder: str | None = None) -> PieceEncoder:
    return encoder(WordPieces, "word_bpe_49k.json", 4, folder)
