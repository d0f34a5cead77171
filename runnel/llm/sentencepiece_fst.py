"""SentencePiece encoding and decoding as a weighted finite-state transducer.

The model compiles to three machines.  The normaliser is a transducer over
spaces and other characters (dummy prefix, escape, squeeze).  The lexicon is a
trie whose arcs read a character and whose final states emit a piece at its
tropical weight.  Byte fallback has an arc for any character that is no piece;
it emits the bytes' pieces.  A text is normalised, composed with lexicon and
fallback into a lattice, and the shortest path over (min, +) is its encoding.

A unigram model weighs an arc with the piece's negative score.  A BPE model
does not minimise a sum of scores: its encoding is the one path on which every
two neighbours are what BPE itself makes of their concatenation.  So its
lattice is composed with one machine more, the acceptor of pairs: a state is a
position and the piece before it, an arc weighs 0 if the pair is compatible and
infinity if it is not, and the shortest path is the only finite one.

Arcs never cross a place whose two characters stand side by side in no piece.
Characters that pieces connect, directly or through others, form families; a
text is cut where a family ends and before each run of spaces (if no piece
holds a space after another character).  The parts are encoded on their own and
remembered in a table of bounded size; a very long text is many such parts, or
one long lattice of bounded arcs a position.  The normaliser's machine is run
as string replacements, which the tests hold against it.  Null texts count as
empty, and empty texts have no tokens; rows are independent, so repeated rows
repeat results.  Refused with ValueError: models with a character map or with
user-defined symbols.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from .common import Memory, map_rows, texts

SPACE = "▁"
INF = float("inf")
#: Piece types and model kinds of the public model format.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        if byte < 128:
            return value, at
        shift += 7


def _fields(data: bytes):
    """(number, value) of a protocol-buffer message."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        else:
            size, at = _varint(data, at) if kind == 2 else ((4 if kind == 5 else 8), at)
            value, at = data[at : at + size], at + size
        yield key >> 3, value


class Normaliser:
    """The machine before the lexicon: state and class of a character to the next state and output.

    Spaces that are squeezed are held back until a character follows.
    """

    START, TEXT, HELD = range(3)

    def __init__(self, dummy_prefix: bool, escape: bool, squeeze: bool) -> None:
        space = SPACE if escape else " "
        first = space if dummy_prefix else ""
        start, text, held = self.START, self.TEXT, self.HELD
        # (state, is a space): (next state, what is put out before the character, whether the character is)
        self.arcs = {(start, False): (text, first, True), (text, False): (text, "", True), (held, False): (text, space, True)}
        if squeeze:
            self.arcs |= {(start, True): (start, "", False), (text, True): (held, "", False), (held, True): (held, "", False)}
        else:
            self.arcs |= {(start, True): (text, first + space, False), (text, True): (text, space, False)}

    def __call__(self, text: str) -> str:
        state, out = self.START, []
        for c in text:
            state, put, kept = self.arcs[state, c == " "]
            out.append(put + c if kept else put)
        return "".join(out)


class Lexicon:
    """The trie of pieces: ``arcs[state]`` reads a character, ``final[state]`` is the piece that ends there or -1."""

    def __init__(self, pieces: dict[str, int]) -> None:
        self.arcs: list[dict[str, int]] = [{}]
        self.final = [-1]
        for piece, number in pieces.items():
            state = 0
            for c in piece:
                after = self.arcs[state].get(c)
                if after is None:
                    after = self.arcs[state][c] = len(self.arcs)
                    self.arcs.append({})
                    self.final.append(-1)
                state = after
            self.final[state] = number

    def compose(self, text: str) -> list[list[tuple[int, int]]]:
        """The lattice of a text: for each position the (start, piece) of the arcs that end there.

        A character that is no piece has the fallback's arc, piece -1.
        """
        arcs, final, size = self.arcs, self.final, len(text)
        lattice: list[list[tuple[int, int]]] = [[] for _ in range(size + 1)]
        for start in range(size):
            state, end = arcs[0].get(text[start]), start + 1
            if state is None or final[state] < 0:
                lattice[end].append((start, -1))
            while state is not None:
                if final[state] >= 0:
                    lattice[end].append((start, final[state]))
                if end == size:
                    break
                state, end = arcs[state].get(text[end]), end + 1
        return lattice


@dataclass
class Transducer:
    """A compiled model: ``encode`` and ``decode``."""

    pieces: list[str]
    scores: list[float]
    types: list[int]
    kind: int = UNIGRAM
    dummy_prefix: bool = True
    escape: bool = True
    squeeze: bool = False
    fallback: bool = True
    memory: int = 1_500_000

    def __post_init__(self) -> None:
        usable = {NORMAL, USER_DEFINED}
        self.lexicon = {p: i for i, (p, t) in enumerate(zip(self.pieces, self.types, strict=True)) if t in usable}
        self.trie = Lexicon(self.lexicon)
        self.machine = Normaliser(self.dummy_prefix, self.escape, self.squeeze)
        self.unknown = next((i for i, t in enumerate(self.types) if t == UNKNOWN), 0)
        self.bytes = {int(p[1:-1], 16): i for i, (p, t) in enumerate(zip(self.pieces, self.types, strict=True)) if t == BYTE}
        self.fallback = self.fallback and len(self.bytes) == 256
        self.by_word = not any(SPACE in p.lstrip(SPACE) for p in self.lexicon)
        if any(t == USER_DEFINED for t in self.types):
            raise ValueError("models with user-defined symbols aren't supported")
        low = min((s for s, t in zip(self.scores, self.types, strict=True) if t == NORMAL), default=0.0)
        self.penalty = -(low - 10.0)  # of an unknown character in a unigram lattice
        self._out = []
        for p, t in zip(self.pieces, self.types, strict=True):
            if t == BYTE:
                self._out.append(bytes([int(p[1:-1], 16)]))
            elif t == CONTROL:
                self._out.append(b"")
            elif t == UNKNOWN:
                self._out.append(" ⁇ ".encode())
            else:
                self._out.append(p.replace(SPACE, " ").encode())
        self._words, self._pairs = Memory(self._word, self.memory), Memory(self._compatible, self.memory // 2)
        apart = "".join(re.escape(c) for c in self._outsiders())
        self._split = re.compile(f"{SPACE}*[{apart}]+|{SPACE}*[^{SPACE}{apart}]+|{SPACE}+" if apart else f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")

    def _outsiders(self) -> list[str]:
        """Characters of pieces that no piece connects with a letter."""
        up: dict[str, str] = {}

        def find(c: str) -> str:
            while up.setdefault(c, c) != c:
                c = up[c]
            return c

        for p in self.lexicon:
            p = p.lstrip(SPACE)
            for a, b in zip(p, p[1:], strict=False):
                up[find(a)] = find(b)
        letters = {find(c) for c in list(up) if c.isalpha()}
        chars = {p.lstrip(SPACE) for p in self.lexicon if len(p.lstrip(SPACE)) == 1} | set(up)
        return sorted(c for c in chars if not c.isalpha() and find(c) not in letters)

    @classmethod
    def load(cls, data: bytes) -> "Transducer":
        """Compile a serialised model."""
        pieces, scores, types = [], [], []
        kind, fallback, dummy, squeeze, escape = UNIGRAM, False, True, True, True
        for number, value in _fields(data):
            if number == 1:
                piece, score, t = "", 0.0, NORMAL
                for n, v in _fields(value):
                    if n == 1:
                        piece = v.decode()
                    elif n == 2:
                        score = float(np.frombuffer(v, "<f4")[0])
                    elif n == 3:
                        t = v
                pieces.append(piece)
                scores.append(score)
                types.append(t)
            elif number == 2:
                spec = dict(_fields(value))
                kind, fallback = spec.get(3, UNIGRAM), bool(spec.get(35, 0))
                if spec.get(24, 0):
                    raise ValueError("models with spaces as suffixes aren't supported")
            elif number == 3:
                spec = dict(_fields(value))
                if spec.get(2):
                    raise ValueError("only the identity character map is supported")
                dummy, squeeze, escape = bool(spec.get(3, 1)), bool(spec.get(4, 1)), bool(spec.get(5, 1))
        return cls(pieces, scores, types, kind, dummy, escape, squeeze, fallback)

    # -- normaliser ------------------------------------------------------
    def normalise(self, text: str) -> str:
        """What the normaliser's machine puts out."""
        if self.squeeze:
            text = re.sub(" +", " ", text).strip(" ")
        if not text:
            return ""
        if self.dummy_prefix:
            text = " " + text
        return text.replace(" ", SPACE) if self.escape else text

    # -- lexicon ---------------------------------------------------------
    def _merge(self, text: str) -> list[str]:
        """BPE on a short string: what the acceptor's pairs are checked against."""
        parts = list(text)
        while len(parts) > 1:
            best, where = -INF, -1
            for i in range(len(parts) - 1):
                j = self.lexicon.get(parts[i] + parts[i + 1])
                if j is not None and self.scores[j] > best:
                    best, where = self.scores[j], i
            if where < 0:
                break
            parts[where : where + 2] = [parts[where] + parts[where + 1]]
        return parts

    def _compatible(self, pair: tuple[str | None, str]) -> bool:
        """Whether BPE leaves two neighbours as they are (or one piece on its own)."""
        before, piece = pair
        return self._merge(piece) == [piece] if before is None else self._merge(before + piece) == [before, piece]

    def _shortest(self, word: str) -> list[tuple[int, int, int]]:
        """The arcs (start, end, piece) of the shortest path through the lattice of one part.

        ``best`` holds the states of each position that a finite path reaches:
        the weight, the arc that leads there and the piece it reads.  A unigram
        arc has no memory, so a position is one state.  With pairs a state is a
        position and a piece, but a prefix has one BPE encoding only, so again
        one state is finite, and arcs from no other are looked at.
        """
        lattice = self.trie.compose(word)
        best: list[tuple[float, int, int, str | None] | None] = [None] * len(lattice)
        best[0] = (0.0, -1, -1, None)
        by_pairs, pairs = self.kind == BPE, self._pairs
        for end in range(1, len(lattice)):
            least = None
            for start, number in lattice[end]:
                before = best[start]
                if before is None:
                    continue
                if by_pairs:
                    piece = word[start:end]
                    if pairs[before[3], piece]:
                        least = (0.0, start, number, piece)
                        break
                else:
                    weight = before[0] + (self.penalty if number < 0 else -self.scores[number])
                    if least is None or weight < least[0]:
                        least = (weight, start, number, None)
            best[end] = least
        path, at = [], len(word)
        while at:
            _, start, number, _ = best[at]
            path.append((start, at, number))
            at = start
        return path[::-1]

    # -- byte fallback ---------------------------------------------------
    def _emit(self, word: str, path: list[tuple[int, int, int]]) -> list[int]:
        """The output of a path; a fallback arc emits the bytes of its character."""
        ids: list[int] = []
        for start, end, number in path:
            if number >= 0:
                ids.append(number)
            elif self.fallback:
                ids.extend(self.bytes[b] for b in word[start:end].encode())
            elif not ids or ids[-1] != self.unknown:
                ids.append(self.unknown)
        return ids

    def _word(self, word: str) -> bytes:
        return np.array(self._emit(word, self._shortest(word)), "<i4").tobytes()

    def encode(self, text: str) -> np.ndarray:
        """Token ids, int32."""
        text = self.normalise(text)
        words = self._split.findall(text) if self.by_word else [text] * bool(text)
        if len(words) > 1 and not self.fallback:  # unknown neighbours are one token
            ids = np.frombuffer(b"".join(map(self._words.__getitem__, words)), "<i4")
            return ids[~((ids == self.unknown) & (np.concatenate([[-1], ids[:-1]]) == self.unknown))]
        return np.frombuffer(b"".join(map(self._words.__getitem__, words)), "<i4")

    def decode(self, ids) -> str:
        """The text; bytes that aren't UTF-8 become U+FFFD."""
        out = self._out
        text = b"".join([out[i] for i in (ids.tolist() if hasattr(ids, "tolist") else ids)]).decode("utf-8", "replace")
        return text[1:] if self.dummy_prefix and text[:1] == " " else text


@lru_cache(maxsize=4)
def _compiled(data: bytes) -> Transducer:
    return Transducer.load(data)


def encode(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids, lossless): the encoding of each whole text.

    ``model`` is the serialised model (its size is fixed), sent with the task.
    ``lossless`` tells whether decoding gives the text back exactly.
    """

    def make():
        fst = _compiled(model)

        def work(rows):
            for doc_id, text in rows:
                ids = fst.encode(text)
                yield doc_id, len(ids), ids, fst.decode(ids) == text

        return work

    return map_rows(texts(docs, id_col, text_col), make, "doc_id long, n_tokens long, ids array<int>, lossless boolean")


def decode(tokens: DataFrame, model: bytes, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) of token lists; a null list gives an empty text."""

    def make():
        fst = _compiled(model)
        return lambda rows: [(doc_id, fst.decode(ids or [])) for doc_id, ids in rows]

    return map_rows(tokens.select(id_col, ids_col).toDF("doc_id", "ids"), make, "doc_id long, text string")
