"""Token counts by finite-state machines compiled from a tokenizer file.

Two deterministic transducers read a text's bytes.

The boundary transducer (STATES states, SYMBOLS symbols) marks where the
pre-tokenizer's pieces begin.  A text is cut into chunks of CHUNK bytes, each
chunk is folded into a state map (for every state it may begin in, the state it
ends in), and the maps are composed by a parallel prefix scan.  With every
chunk's first state known, all chunks emit their marks at once.  A text of any
length is thus as parallel as many short ones.

The merge transducer reads a piece from its first byte and annotates each
transition with the number of tokens it emits: what the best cut of the bytes so
far has more than the one before (it can be negative, when a merge takes tokens
back).  Its states are compiled when first reached.  A state holds what the
future can still depend on: the longest suffix that begins some token, and for
each place in it the last token there and the count relative to here.  That is a
finite set, because tokens have a longest one; max_states bounds the memory, and
a full table is dropped and compiled again, inside a long piece as well.

The merge transducer's chunks have no state maps: a map has an entry for every state
that a chunk may begin in, and these are too many (182,795 were compiled on 25 MB of text,
where the boundary transducer has 12), so that a map of 64 bytes would take megabytes.
The prefix scan therefore runs over the boundary transducer, which cuts a text at any
length into pieces that are independent of each other, and a piece is read from its first
byte to its last.

Equal pieces of a batch are read once (Arrow's dictionary encoding); the counts
of a text are the sums over its pieces.

Where ids are asked for, the distinct pieces of a block are merged together, a merge of each
in a step (MergeTable); only pieces longer than its matrices are put to the library.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.session import ship

#: Bytes a chunk.
CHUNK = 64
#: Pieces a Python worker remembers.
KNOWN = 400_000
#: Bytes of text handled at once in a Python worker.
BLOCK_BYTES = 8_000_000

# Symbols of the boundary transducer. LETTER to OTHER are Unicode classes; lower-case letters of the contractions
# 's 't 're 've 'm 'll 'd are symbols of their own.
LETTER, NUMBER, WHITE, OTHER, BLANK, QUOTE, STMD, R_OR_V, E, ELL, INSIDE, CUT = range(12)
SYMBOLS = 12
LETTERS = (LETTER, STMD, R_OR_V, E, ELL)

# States: what is open. FRESH: nothing; AFTER: a contraction has ended. SPACE, WHITE1: a run of one white space;
# SPACES, WHITES: of more, by its last. QUOTED: ' where a piece begins; QUOTED_RV, QUOTED_L: and the next letter.
FRESH, IN_L, IN_N, IN_O, SPACE, WHITE1, SPACES, WHITES, QUOTED, QUOTED_RV, QUOTED_L, AFTER = range(12)
STATES = 12

# Marks: a piece begins here; a piece begins at the character before.
HERE, BEFORE = 1, 2

#: In the joined bytes: end of a text, and special tokens, from FIRST_SPECIAL on. None of these bytes occurs in UTF-8.
END, FIRST_SPECIAL = 0xFF, 0xF5


def _boundary_tables() -> tuple[np.ndarray, np.ndarray]:
    """(next state, marks) of [symbol, state]."""
    to, marks = np.zeros((SYMBOLS, STATES), np.uint8), np.zeros((SYMBOLS, STATES), np.uint8)
    opens = {NUMBER: IN_N, OTHER: IN_O, QUOTE: QUOTED, BLANK: SPACE, WHITE: WHITE1, **dict.fromkeys(LETTERS, IN_L)}
    for symbol, begun in opens.items():
        white = symbol in (BLANK, WHITE)
        for state in range(STATES):
            t, m = begun, HERE  # as a rule a piece begins
            if white and state in (SPACE, WHITE1, SPACES, WHITES):
                t, m = (SPACES if symbol == BLANK else WHITES), 0
            elif state == SPACE and not white:  # the blank joins what follows
                t, m = (IN_O if symbol == QUOTE else begun), 0
            elif state == SPACES and not white:  # the run leaves its last blank to what follows
                t, m = (IN_O if symbol == QUOTE else begun), BEFORE
            elif state == WHITES and not white:  # the last white space stands alone
                m = HERE | BEFORE
            elif state == IN_L and symbol in LETTERS or state == IN_N and symbol == NUMBER:
                m = 0
            elif state in (IN_O, QUOTED) and symbol in (OTHER, QUOTE):
                t, m = IN_O, 0
            elif state == QUOTED and symbol == STMD:
                t, m = AFTER, 0
            elif state == QUOTED and symbol in (R_OR_V, ELL):
                t, m = (QUOTED_RV if symbol == R_OR_V else QUOTED_L), 0
            elif (state, symbol) in ((QUOTED_RV, E), (QUOTED_L, ELL)):
                t, m = AFTER, 0
            elif state in (QUOTED_RV, QUOTED_L):  # no contraction: ' is a piece, its letter begins one
                m = BEFORE if symbol in LETTERS else BEFORE | HERE
            to[symbol, state], marks[symbol, state] = t, m
    to[INSIDE] = np.arange(STATES)
    marks[CUT] = HERE
    marks[CUT, [QUOTED_RV, QUOTED_L]] = HERE | BEFORE
    return to, marks


def _compose(first: np.ndarray, then: np.ndarray) -> np.ndarray:
    """Maps (n, STATES): first, then the other."""
    return np.take_along_axis(then, first.astype(np.intp), axis=1)


def prefix_scan(maps: np.ndarray) -> np.ndarray:
    """Exclusive scan: row i composes the maps before i. Work-efficient: pairs are
    composed, their scan is taken, and each pair's second adds its first."""
    n = len(maps)
    out = np.empty_like(maps)
    if not n:
        return out
    out[0] = np.arange(maps.shape[1])
    if n > 1:
        out[::2] = prefix_scan(_compose(maps[0 : n - n % 2 : 2], maps[1::2]) if n % 2 == 0 else np.concatenate([_compose(maps[0 : n - 1 : 2], maps[1::2]), maps[-1:]]))
        out[1::2] = _compose(out[0 : n - n % 2 : 2], maps[0 : n - n % 2 : 2])
    return out


class BoundaryTransducer:
    """Marks the first bytes of the pieces of joined texts."""

    def __init__(self, code_points: np.ndarray):
        self.to, self.marks = _boundary_tables()
        self.points = code_points
        self.ascii = np.full(256, INSIDE, np.uint8)
        self.ascii[:128] = code_points[:128]
        self.ascii[FIRST_SPECIAL:] = CUT
        # two symbols at a time
        self.pairs = self.to[None, :, :].repeat(SYMBOLS, 0)
        for a in range(SYMBOLS):
            self.pairs[a] = self.to[:, self.to[a]]
        self.pairs = self.pairs.reshape(SYMBOLS * SYMBOLS, STATES)

    def symbols(self, data: np.ndarray) -> np.ndarray:
        out = self.ascii[data]
        lead = np.flatnonzero((data >= 0xC0) & (data < FIRST_SPECIAL))
        if len(lead):
            b = np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.uint32)
            x, y, z, w = b[lead], b[lead + 1] & 63, b[lead + 2] & 63, b[lead + 3] & 63
            cp = np.where(x < 0xE0, (x & 31) << 6 | y, np.where(x < 0xF0, (x & 15) << 12 | y << 6 | z, (x & 7) << 18 | y << 12 | z << 6 | w))
            out[lead] = self.points[np.minimum(cp, 0x10FFFF)]
        return out

    def starts(self, data: np.ndarray) -> np.ndarray:
        """Positions where pieces begin; data ends with END."""
        n = len(data)
        rows = -(-n // CHUNK)
        sym = np.full(rows * CHUNK, INSIDE, np.uint8)
        sym[:n] = self.symbols(data)
        lanes = np.ascontiguousarray(sym.reshape(rows, CHUNK).T)
        flat, base = self.pairs.ravel(), np.arange(STATES, dtype=np.uint8)
        maps = np.broadcast_to(base, (rows, STATES))
        for k in range(0, CHUNK, 2):
            at = (lanes[k].astype(np.uint16) * SYMBOLS + lanes[k + 1]) * STATES
            maps = flat.take(at[:, None] + maps)
        state = prefix_scan(maps)[:, FRESH].astype(np.uint16)
        to, marks, out = self.to.ravel(), self.marks.ravel(), np.empty((CHUNK, rows), np.uint8)
        for k in range(CHUNK):
            at = lanes[k] * np.uint16(STATES) + state
            marks.take(at, out=out[k], mode="clip")
            state = to.take(at).astype(np.uint16)
        mark = np.ascontiguousarray(out.T).ravel()[:n]
        here = (mark & HERE).view(bool)
        back = np.flatnonzero(mark & BEFORE)
        if len(back):
            lead = back - 1
            while True:  # the character before begins at its lead byte
                inside = (data[lead] & 0xC0) == 0x80
                if not inside.any():
                    break
                lead = lead - inside
            here = here.copy()
            here[lead] = True
        return np.flatnonzero(here)


class MergeTransducer:
    """Counts (and ids) of a piece under byte-pair merges, compiled lazily.

    A state is (suffix, places): the longest suffix of what was read that begins some
    token, and for each of its places that may begin a token the last token that ends
    there (-1: the piece begins there) and the count there less the count here.
    """

    def __init__(self, vocab: dict[bytes, int], merges: dict[tuple[int, int], tuple[int, int]], max_states: int = 300_000):
        self.vocab, self.max_states = vocab, max_states
        self.ranks = {pair: rank for pair, (rank, _) in merges.items()}
        self.made = {token: (pair, rank) for pair, (rank, token) in merges.items()}
        self.length = {i: len(b) for b, i in vocab.items()}
        self.begins = {b[:k] for b in vocab for k in range(len(b) + 1)}
        self.spines: dict[tuple[int, int], list[tuple[int, int]]] = {}
        self.valid: dict[int, bool] = {}
        self.shapes: dict[tuple[bytes, int], tuple] = {}
        self.go: dict[int, tuple[int, int]] = {}
        self._clear()

    def _clear(self) -> None:
        self.ids: dict[tuple, int] = {}
        self.keys: list[tuple] = []
        self.last: list[int] = []
        self.go.clear()
        self._state((b"", ((-1, 0),)))

    def _bounded(self, state: int) -> int:
        """The state, in a new table if this one is full."""
        if len(self.keys) < self.max_states:
            return state
        key = self.keys[state]
        self._clear()
        return self._state(key)

    def _state(self, key: tuple) -> int:
        if (at := self.ids.get(key)) is None:
            at = self.ids[key] = len(self.keys)
            self.keys.append(key)
            self.last.append(key[1][-1][0])
        return at

    def _spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """The tokens at one edge of a token as it is merged, from its byte on, each with
        the rank at which it is merged further (none: infinite)."""
        if (out := self.spines.get((token, side))) is None:
            out, x, rank = [], token, 1 << 60
            while True:
                out.append((x, rank))
                if x not in self.made:
                    break
                pair, rank = self.made[x]
                x = pair[side]
            out = self.spines[token, side] = out[::-1]
        return out

    def fits(self, a: int, b: int) -> bool:
        """Whether token b can follow token a: while both are built, in the order of ranks,
        no merge across their border comes first. Of equal ranks the left one goes first."""
        if (ok := self.valid.get(a << 20 | b)) is None:
            left, right, i, j, ok = self._spine(a, 1), self._spine(b, 0), 0, 0, True
            while ok:
                (x, up), (y, down) = left[i], right[j]
                across = self.ranks.get((x, y), 1 << 61)
                if across < up and across <= down:
                    ok = False
                elif up == down == 1 << 60:
                    break
                elif up <= down:
                    i += 1
                else:
                    j += 1
            if len(self.valid) > 8 * self.max_states:
                self.valid.clear()
            self.valid[a << 20 | b] = ok
        return ok

    def _shape(self, suffix: bytes, byte: int) -> tuple:
        """What depends on the suffix alone: the tokens that may end here, by the place they
        begin at, the longest first; the next suffix; the places that it keeps."""
        if (out := self.shapes.get((suffix, byte))) is None:
            whole = suffix + bytes([byte])
            old = [j for j in range(len(suffix) + 1) if suffix[j:] in self.begins]
            ends = [(k, t) for k, j in enumerate(old) if (t := self.vocab.get(whole[j:])) is not None]
            kept = [k for k, j in enumerate(old) if whole[j:] in self.begins]
            out = ends, whole[old[kept[0]] :] if kept else b"", kept
            if len(self.shapes) > self.max_states:
                self.shapes.clear()
            self.shapes[suffix, byte] = out
        return out

    def _compile(self, state: int, byte: int) -> tuple[int, int]:
        suffix, places = self.keys[state]
        ends, rest, kept = self._shape(suffix, byte)
        for k, token in ends:
            last, less = places[k]
            if last < 0 or self.fits(last, token):
                break
        else:
            raise ValueError(f"no token ends after byte {byte}")
        delta = less + 1
        step = self._state((rest, (*[(places[k][0], places[k][1] - delta) for k in kept], (token, 0)))), delta
        self.go[state << 8 | byte] = step
        return step

    def count(self, piece: bytes) -> int:
        state = n = 0
        go = self.go
        for b in piece:
            step = go.get(state << 8 | b)
            if step is None:
                step = self._compile(self._bounded(state), b)
            state, delta = step
            n += delta
        return n

    def tokens(self, piece: bytes) -> bytes:
        """The ids as unsigned 32-bit integers."""
        state, ends = 0, []
        go = self.go
        for b in piece:
            step = go.get(state << 8 | b)
            state = (step or self._compile(self._bounded(state), b))[0]
            ends.append(self.last[state])
        out, at = [], len(piece)
        while at:
            out.append(ends[at - 1])
            at -= self.length[out[-1]]
        return array("I", out[::-1]).tobytes()


class MergeTable:
    """Ids of many pieces under byte-pair merges at once. Of each piece the pair of the lowest rank, the
    leftmost of equal ones, is merged in a step, the longest pieces first: a piece that is merged to n
    tokens goes on with those that have n bytes, so that a step's tokens are one matrix."""

    #: Longer pieces are few, and not for matrices.
    LONGEST = 32
    NONE = np.int32(2**31 - 1)

    def __init__(self, vocab: dict[bytes, int], merges: dict[tuple[int, int], tuple[int, int]]):
        self.byte_ids = np.array([vocab.get(bytes([b]), -1) for b in range(256)], np.int32)
        pairs = np.array([a << 32 | b for a, b in merges], np.int64)
        order = np.argsort(pairs)
        self.pairs, self.ranks = pairs[order], np.array([rank for rank, _ in merges.values()], np.int32)[order]
        self.token = np.zeros(int(self.ranks.max(initial=-1)) + 1, np.int32)
        for rank, token in merges.values():
            self.token[rank] = token
        # bytes that follow each other, without a search
        a, b = np.divmod(np.arange(1 << 16), 256)
        self.of_bytes = self._rank(self.byte_ids[a], self.byte_ids[b])

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair of tokens, NONE if it isn't merged."""
        if not len(self.pairs):
            return np.full(len(a), self.NONE)
        key = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.ranks[at], self.NONE)

    def ids(self, data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(places among the pieces, their ids [piece, token]) of pieces of 1 to LONGEST bytes at the
        places `begin` of data, those of as many ids together."""
        order = np.argsort(size, kind="stable")
        cuts = np.searchsorted(size[order], np.arange(self.LONGEST + 2))
        of, tokens, ranks = np.zeros(0, np.int64), np.zeros((0, self.LONGEST), np.int32), np.zeros((0, self.LONGEST - 1), np.int32)
        for width in range(self.LONGEST, 0, -1):
            fresh = order[cuts[width] : cuts[width + 1]]
            piece = data[begin[fresh][:, None] + np.arange(width)]
            of, tokens = np.concatenate([of, fresh]), np.concatenate([tokens, self.byte_ids[piece]])
            if width == 1:
                yield of, tokens
                break
            ranks = np.concatenate([ranks, self.of_bytes[piece[:, :-1].astype(np.int32) << 8 | piece[:, 1:]]])
            at = ranks.argmin(axis=1)
            best = ranks[np.arange(len(at)), at]
            done = best == self.NONE
            yield of[done], tokens[done]
            on = np.flatnonzero(~done)
            of, at, best, tokens, ranks = of[on], at[on], best[on], tokens[on], ranks[on]
            row = np.arange(len(of))
            tokens = np.where(np.arange(width - 1) <= at[:, None], tokens[:, :-1], tokens[:, 1:])
            tokens[row, at] = self.token[best]
            ranks = np.where(np.arange(width - 2) < at[:, None], ranks[:, :-1], ranks[:, 1:])
            for first in (at - 1, at):  # the pairs that the new token is in
                has = np.flatnonzero((first >= 0) & (first < width - 2))
                k = first[has]
                ranks[has, k] = self._rank(tokens[has, k], tokens[has, k + 1])


def _byte_letters() -> dict[str, int]:
    """The printable stand-ins of bytes in byte-level vocabularies: printable Latin-1
    characters stand for themselves, the others follow from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def code_point_symbols(tokenizer) -> np.ndarray:
    """The symbol of each code point, in the Unicode version of the tokenizer: letters
    and numbers that Python's database doesn't know yet are put to its pre-tokenizer."""
    import unicodedata

    import regex

    text = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    out = np.full(0x110000, OTHER, np.uint8)
    for symbol, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (WHITE, r"\s")):
        out[[ord(c) for c in regex.findall(pattern, text)]] = symbol
    new = [c for c in np.flatnonzero(out <= NUMBER).tolist() if unicodedata.category(chr(c)) == "Cn"]
    begins = {o[0] for _, o in tokenizer.pre_tokenizer.pre_tokenize_str("".join(f"\na{chr(c)}1" for c in new))}
    for i, c in enumerate(new):
        own, after = 4 * i + 2 in begins, 4 * i + 3 in begins
        out[c] = OTHER if own and after else NUMBER if own else LETTER
    out[ord(" ")], out[ord("'")] = BLANK, QUOTE
    for letters, symbol in (("stmd", STMD), ("rv", R_OR_V), ("e", E), ("l", ELL)):
        out[[ord(c) for c in letters]] = symbol
    return out


class ByteLevelMachine:
    """Both transducers of a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a worker has one core
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = _byte_letters()
        to_bytes = lambda s: bytes(letters[c] for c in s)
        vocab = {to_bytes(k): v for k, v in spec["model"]["vocab"].items()}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        merges = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(map(to_bytes, p) for p in pairs)}
        self.tokenizer = Tokenizer.from_file(path)
        added = sorted((t["content"] for t in spec["added_tokens"]), key=lambda t: (-len(t), t))
        if len(added) > END - FIRST_SPECIAL:
            raise ValueError(f"{len(added)} special tokens; {END - FIRST_SPECIAL} are supported")
        # a special token is one byte that text can't hold; the longest that begins at a place counts
        self.special = {t.encode(): bytes([FIRST_SPECIAL + k]) for k, t in enumerate(added)}
        self.special_ids = {FIRST_SPECIAL + k: np.uint32(self.tokenizer.token_to_id(t)).tobytes() for k, t in enumerate(added)}
        self.specials = re.compile(b"|".join(map(re.escape, self.special)) or b"(?!)")
        self.boundaries = BoundaryTransducer(code_point_symbols(self.tokenizer))
        self.merger, self.table = MergeTransducer(vocab, merges), MergeTable(vocab, merges)
        self.plain = (self.table.byte_ids >= 0).all() and not spec["model"].get("ignore_merges")
        self.known: dict[bytes, int] = {}

    def _of_all(self, pieces: list[bytes], known: dict, run: Callable[[list[bytes]], list]) -> list:
        """run of each piece; short ones are remembered, up to KNOWN of them."""
        if len(known) > KNOWN:
            known.clear()
        out = list(map(known.get, pieces))
        new = [i for i, x in enumerate(out) if x is None]
        for i, x in zip(new, run([pieces[i] for i in new]), strict=True):
            out[i] = x
            if len(pieces[i]) <= 24:
                known[pieces[i]] = x
        return out

    def _counts_of(self, pieces: list[bytes]) -> list[int]:
        """END is no token, a special one is one."""
        return [(p[0] < END) if len(p) == 1 and p[0] >= FIRST_SPECIAL else self.merger.count(p) for p in pieces]

    def _ids_of(self, pieces: list[bytes]) -> list[bytes]:
        """By the library: of pieces that are too long for the table of merges."""
        marks = [p[0] if len(p) == 1 and p[0] >= FIRST_SPECIAL else 0 for p in pieces]
        coded = iter(self.tokenizer.encode_batch_fast([p.decode() for p, mark in zip(pieces, marks, strict=True) if not mark], add_special_tokens=False))
        return [self.special_ids.get(mark, b"") if mark else array("I", next(coded).ids).tobytes() for mark in marks]

    def pieces(self, texts: list[bytes]) -> tuple[pa.DictionaryArray, np.ndarray]:
        """Dictionary-encoded pieces of the texts, END and special tokens as pieces of their own,
        and the positions of the ENDs among them."""
        if self.special:
            texts = [self.specials.sub(lambda m: self.special[m[0]], t) if any(x in t for x in self.special) else t for t in texts]
        joined = b"\xff".join(texts) + b"\xff"
        data = np.frombuffer(joined, np.uint8)
        begins = self.boundaries.starts(data)
        # what follows END or a special token begins a piece, for the state there is FRESH
        offsets = np.append(begins, len(data)).astype(np.int32)
        array = pa.BinaryArray.from_buffers(pa.binary(), len(begins), [None, pa.py_buffer(offsets), pa.py_buffer(joined)])
        return array.dictionary_encode(), np.flatnonzero(data[begins] == END)

    def counts(self, texts: list[bytes]) -> np.ndarray:
        """Tokens of each text."""
        coded, ends = self.pieces(texts)
        own = np.array(self._of_all(coded.dictionary.to_pylist(), self.known, self._counts_of), np.int64)
        total = np.cumsum(own[coded.indices.to_numpy()])
        return np.diff(total[ends], prepend=0)

    def ids(self, texts: list[bytes]) -> list[np.ndarray]:
        """Token ids of each text."""
        coded, ends = self.pieces(texts)
        flat, lengths = self._ids_of_all(coded.dictionary)
        begin = np.cumsum(lengths) - lengths
        at = coded.indices.to_numpy()
        n = lengths[at]
        upto = np.cumsum(n)
        # the places in flat of every token of every piece
        ids = flat[np.arange(upto[-1] if len(upto) else 0) + np.repeat(begin[at] - (upto - n), n)]
        return np.split(ids, upto[ends])[:-1]

    def _ids_of_all(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the distinct pieces, one after the other; how many each has)."""
        if not len(pieces):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        offsets, data = np.frombuffer(pieces.buffers()[1], np.int32)[: len(pieces) + 1].astype(np.int64), np.frombuffer(pieces.buffers()[2], np.uint8)
        size = np.diff(offsets)
        mark = (size == 1) & (data[offsets[:-1]] >= FIRST_SPECIAL)
        table = ~mark & (size <= MergeTable.LONGEST) & self.plain
        some, rest = np.flatnonzero(table), np.flatnonzero(~table)
        got = [(some[of], ids) for of, ids in self.table.ids(data, offsets[some], size[some])]
        long = [np.frombuffer(x, np.uint32) for x in self._ids_of(pieces.take(pa.array(rest)).to_pylist())]
        lengths = np.zeros(len(pieces), np.int64)
        for of, ids in got:
            lengths[of] = ids.shape[1]
        lengths[rest] = list(map(len, long))
        begin = np.cumsum(lengths) - lengths
        flat = np.empty(int(lengths.sum()), np.uint32)
        for of, ids in got:
            flat[begin[of][:, None] + np.arange(ids.shape[1])] = ids
        for k, ids in zip(begin[rest].tolist(), long, strict=True):
            flat[k : k + len(ids)] = ids
        return flat, lengths


@lru_cache(maxsize=2)
def machine(path: str) -> ByteLevelMachine:
    """One machine a Python worker and file."""
    return ByteLevelMachine(path)


def text_blocks(column: pa.Array, block_bytes: int = BLOCK_BYTES) -> Iterator[list[bytes]]:
    """The texts of an Arrow column as bytes (null: empty), some MB at a time."""
    block, size = [], 0
    for t in column.cast(pa.binary()).to_pylist():
        block.append(t or b"")
        size += len(block[-1])
        if size >= block_bytes:
            yield block
            block, size = [], 0
    if block:
        yield block


def token_counts(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """One row per row of docs: id, n_bytes, n_tokens, over_limit.

    No shuffle: each row is counted where it is read. A null text counts as an empty one
    (0 bytes, 0 tokens). Texts of any length are whole. Repeated rows repeat. Other
    columns of docs are not read. tokenizer_path: a byte-level BPE file, at the same
    place on every executor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = machine(tokenizer_path)
        for batch in batches:
            sizes, counts = [], []
            for block in text_blocks(batch.column(1)):
                sizes += map(len, block)
                counts.append(m.counts(block))
            n = np.concatenate(counts) if counts else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(n, pa.int64()), pa.array(n > limit)], names=[id_col, "n_bytes", "n_tokens", "over_limit"])

    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
