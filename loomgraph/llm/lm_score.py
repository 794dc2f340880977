"""Language-model scoring by online logistic context mixing.

Tokens are words (A-Z as a-z), then one end a text.  A token is coded in binary
decisions: whether it is no training token; if so it is spelled, byte after byte; else
its class, CLASS_BITS bits of its hash; then whether, in its class, it is one of those
that followed the two words before (with its share of these) or not (with its share of
the class's training count).  Several predictors give the probability of a class bit from
counts under contexts: the bits so far, these with the class before, with the word
before, with the two words before.  A mixer adds their log odds with weights that a
gate selects by the contexts' confidence and that learn from every CHUNK tokens of
the text, and an adaptive map refines the result.  Every text starts from the same
weights, so scores don't depend on the order or place of texts.  They are those under which
the decisions of all training texts are the most probable, each text as if it were held out.

The product is the probability of the whole text: those of all training tokens and of
all spellings add up to 1 at each place.  A training text's own occurrences of what is
predicted are left out of a context's counts, however large these are, so that it doesn't
predict itself.

What training gathers grows with the corpus: counts of all tokens, of all classes after each
word and of all words after each two words, never on one machine.  Texts are packed
into blocks; the words and the (context, next) pairs of all blocks are dealt by hash,
counted, and written in buckets by the block that asked, a table for words and for each kind of
pairs: a task writes a file a bucket, and blocks read theirs without another shuffle.  Hashes of contexts have CONTEXT_SLACK
bits more than the number of training tokens, CONTEXT_BITS at least.  A frequent context gives a block as many
pairs as there are codes at most.  Only sums of fixed size reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import bucketed, shuffles_dropped
from loomgraph.llm.ngram_join import _M, _mixed, span_hashes, word_hashes, word_spans, words_of
from loomgraph.session import ship

#: Bits of a word's hash that are its class, and its code (the class and more).
CLASS_BITS, CODE_BITS = 8, 19
CLASSES = 1 << CLASS_BITS
#: Tokens after which a text's weights are updated.
CHUNK = 32
#: The end of a text as a word's hash; it is no word, so it is word 0 of each block.
END_HASH = np.uint64(0x5851F42D4C957F2D)
#: A block has this many bytes of text, about, and texts.
BLOCK_BYTES, BLOCK_TEXTS = 4_000_000, 1024
#: Gates: the two contexts of words unseen, seen a little or often.
GATES, INPUTS = 9, 4
CONTEXT_SLACK, CONTEXT_BITS = 5, 30
BUCKETS = 24
#: Groups in which words and pairs are counted, at least, and pairs in a group, about.
GROUPS, GROUP_PAIRS = 256, 2_000_000
#: Texts that are scored together, and tokens whose decisions are held at once, about: their arrays
#: stay in a core's cache. CELL_SLICE: tokens whose decisions are summed at once.
SCORED_TEXTS, SLICE, CELL_SLICE = 128, 1 << 12, 1 << 17
#: A context of class bits is seen often, for the gate, beyond so many times.
OFTEN = 15
#: Shifts of a pair's key that give the levels at which its context is counted: the context,
#: each further class bit and, for two words before, the code.
LEVELS = (tuple(range(CLASS_BITS, -1, -1)), (*range(CODE_BITS, CODE_BITS - CLASS_BITS - 1, -1), 0))
KEY_BITS = CLASS_BITS, CODE_BITS


@dataclass(frozen=True)
class Mixer:
    """rate: of the weights, a chunk. refine: of the adaptive map. start: weights of the
    predictors, by gate or the same for all; unseen, follow: (bias, weight) of the other two
    decisions. prior: added to each count. fit_rows: None, if the starting weights are to be
    learned (from all training texts, see learned()), or 0; epochs: Newton's steps at most."""

    rate: float = 0.02
    refine: float = 0.02
    start: tuple[tuple[float, ...], ...] = ((0.2,) * GATES, (0.3,) * GATES, (0.3,) * GATES, (0.3,) * GATES)
    unseen: tuple[float, float] = (0.0, 1.0)
    follow: tuple[float, float] = (0.0, 1.0)
    prior: float = 0.4
    fit_rows: int | None = None
    epochs: int = 12

    def __post_init__(self):
        if self.fit_rows:
            raise ValueError("the starting weights are learned from all training texts (None) or none (0)")


def _narrow(x: np.ndarray) -> bytes:
    """Whole numbers of at least 0 as byte planes of the least width that holds them, after the
    width, the number of bytes and that of compressed ones."""
    top = int(x.max(initial=0))
    width = next(w for w in (1, 2, 4, 8) if top < 1 << 8 * w)
    x = x.astype(f"<u{width}")
    planes = np.empty((width, x.size), np.uint8)
    for k, plane in enumerate(planes):
        plane[:] = x >> x.dtype.type(8 * k)
    short = pa.compress(planes.tobytes(), "zstd", asbytes=True)
    return bytes([width]) + planes.size.to_bytes(5, "little") + len(short).to_bytes(5, "little") + short


def _parted(b: bytes) -> list[np.ndarray]:
    """The arrays of one or more _narrow ones after each other."""
    out, at = [], 0
    while at < len(b):
        width, size, end = b[at], int.from_bytes(b[at + 1 : at + 6], "little"), at + 11 + int.from_bytes(b[at + 6 : at + 11], "little")
        planes = np.frombuffer(pa.decompress(b[at + 11 : end], size, "zstd", asbytes=True) if size else b"", np.uint8)
        low, *more = planes.reshape(width, -1)
        x = low.astype(f"<u{width}")
        for k, plane in enumerate(more, 1):
            x |= plane.astype(x.dtype) << x.dtype.type(8 * k)
        out.append(x)
        at = end
    return out


def _wide(b: bytes) -> np.ndarray:
    return _parted(b)[0]


def _text(b: bytes) -> bytes:
    return len(b).to_bytes(5, "little") + pa.compress(b, "zstd", asbytes=True)


def _untext(b: bytes) -> bytes:
    return pa.decompress(b[5:], int.from_bytes(b[:5], "little"), "zstd", asbytes=True)


def _runs(changes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first place, length) of the runs that begin where changes holds."""
    starts = np.flatnonzero(changes)
    lengths = np.empty(len(starts), np.int64)
    np.subtract(starts[1:], starts[:-1], out=lengths[:-1])
    lengths[-1:] = len(changes) - starts[-1:]
    return starts, lengths


def _fresh(x: np.ndarray) -> np.ndarray:
    """Whether each of the sorted values differs from the one before."""
    out = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=out[1:])
    return out


def _places(fresh: np.ndarray) -> np.ndarray:
    """For each place the number of its run, by those at which runs begin."""
    out = np.cumsum(fresh.view(np.int8), dtype=np.int32)
    out -= 1
    return out


def _upto(n: np.ndarray) -> np.ndarray:
    """The sums of what comes before each place, and of all."""
    out = np.zeros(len(n) + 1, np.int64)
    np.cumsum(n, out=out[1:])
    return out


def _run_sums(upto: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The sums of runs that begin at starts, by _upto()."""
    return np.diff(upto[starts], append=upto[-1])


def _ordered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the places of the keys in their order, equal ones as they come; the keys in order). Keys are
    sorted with their places in the low bits, which is several times faster than an argsort."""
    low = max(1, len(keys) - 1).bit_length()
    over = max(0, int(keys.max(initial=0)).bit_length() + low - 64)
    both = np.sort(keys >> np.uint64(over) << np.uint64(low) | np.arange(len(keys), dtype=np.uint64))
    order = (both & np.uint64((1 << low) - 1)).astype(np.intp)
    if not over:
        return order, both >> np.uint64(low)
    # keys that differ in bits that had no room alone are put in order among themselves
    keys = keys[order]
    runs = _places(_fresh(both >> np.uint64(low)))
    mixed = np.zeros(int(runs[-1]) + 1, bool)
    mixed[runs[1:][keys[1:] < keys[:-1]]] = True
    some = np.flatnonzero(mixed[runs])
    by = some[np.argsort(keys[some], kind="stable")]
    order[some], keys[some] = order[by], keys[by]
    return order, keys


def packed(ids: list, held: list, texts: list[bytes]) -> dict:
    """A block of texts: ids, held, n_bytes, lengths (tokens), index (each token's word, the
    frequent ones first), words (distinct), grams (classes before and after, of texts that
    aren't held out)."""
    lower = (b" " + b" ".join(texts) + b" ").translate(_LOWER)
    data = np.frombuffer(lower, np.uint8)
    begin, end = word_spans(data)
    hashes, lengths = span_hashes(data, begin, end), words_of(begin, texts) + 1
    inner = np.ones(int(lengths.sum()), bool)
    inner[np.cumsum(lengths) - 1] = False
    order, ordered = _ordered(hashes)
    starts, runs = _runs(_fresh(ordered))
    often = np.argsort(-runs, kind="stable")
    rank = np.empty(len(starts), np.int32)
    rank[often] = 1 + np.arange(len(starts))
    index = np.zeros(len(inner), np.int32)
    index[np.flatnonzero(inner)[order]] = np.repeat(rank, runs)
    # the words themselves, one occurrence of each with the space after it
    some = order[starts][often]
    size = end[some] - begin[some] + 1
    upto = np.cumsum(size)
    words = data[np.arange(upto[-1] if len(upto) else 0) + np.repeat(begin[some] - (upto - size), size)]
    words[upto - 1] = 32
    kinds = (np.concatenate([[END_HASH], hashes[some]]) >> np.uint64(64 - CLASS_BITS)).astype(np.int64)[index]
    before = np.roll(kinds, 1)
    before[np.cumsum(lengths) - lengths] = CLASSES
    taught = np.repeat(~np.array(held, bool), lengths)
    return {
        "ids": pa.array(ids).cast(pa.string()).to_pylist(), "held": _narrow(np.array(held, np.uint8)), "n_bytes": _narrow(np.array([len(t) for t in texts], np.int64)), "lengths": _narrow(lengths),
        "index": _narrow(index), "words": _text(words.tobytes()), "grams": _narrow(np.bincount((before * CLASSES + kinds)[taught], minlength=(CLASSES + 1) * CLASSES)),
    }


_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def word_blocks(docs: DataFrame) -> DataFrame:
    """Blocks of docs (doc_id, held, text), see packed()."""
    ship(docs.sparkSession)
    names = ["held", "n_bytes", "lengths", "index", "words", "grams"]
    schema = pa.schema([("ids", pa.list_(pa.string())), *[(n, pa.binary()) for n in names]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, held, texts, size = [], [], [], 0
        for batch in batches:
            for i, h, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist(), strict=True):
                ids.append(i)
                held.append(h)
                texts.append(t or b"")
                size += len(texts[-1])
                if size >= BLOCK_BYTES or len(ids) == BLOCK_TEXTS:
                    yield pa.RecordBatch.from_pylist([packed(ids, held, texts)], schema)
                    ids, held, texts, size = [], [], [], 0
        if ids:
            yield pa.RecordBatch.from_pylist([packed(ids, held, texts)], schema)

    return docs.mapInArrow(run, f"ids array<string>, {', '.join(f'{n} binary' for n in names)}")


class Block:
    """A block's tokens and their contexts."""

    def __init__(self, row: dict):
        self.ids = row["ids"]
        self.held, self.n_bytes, self.lengths = _wide(row["held"]).astype(bool), _wide(row["n_bytes"]).astype(np.int64), _wide(row["lengths"]).astype(np.int64)
        self.index, self.words = _wide(row["index"]).astype(np.int32), _untext(row["words"])
        self.hashes = np.concatenate([[END_HASH], word_hashes([self.words])[0]])
        self.doc = np.repeat(np.arange(len(self.lengths), dtype=np.int32), self.lengths)
        self.first = np.cumsum(self.lengths) - self.lengths
        self.kinds = (self.hashes >> np.uint64(64 - CLASS_BITS)).astype(np.int32)
        self.begins = np.zeros(len(self.index), bool)
        self.begins[self.first] = True

    def taught(self) -> np.ndarray:
        """How often each word is in texts that aren't held out."""
        return np.bincount(self.index[~self.held[self.doc]], minlength=len(self.hashes))

    def alone(self) -> np.ndarray:
        """How often each token's word is in the token's own text."""
        order, both = _ordered((self.doc * np.int64(len(self.hashes)) + self.index).astype(np.uint64))
        starts, lengths = _runs(_fresh(both))
        out = np.empty(len(both), np.int64)
        out[order] = np.repeat(lengths, lengths)
        return out

    def keys(self, kind: int, bits: int) -> np.ndarray:
        """Each token's (context, next) pair: `bits` bits of the context's hash, then the
        class (kind 0, after the word before) or code (kind 1, after the two words before)."""
        own = _mixed(self.hashes ^ _M[2])[self.index]
        before = np.roll(own, 1)
        before[self.first] = 0
        if kind:
            two = np.roll(own, 2)
            two[self.first] = two[np.minimum(self.first + 1, len(two) - 1)] = 0
            context = _mixed(before * _M[0] + two)
        else:
            context = _mixed(before + _M[0])
        low = np.uint64(KEY_BITS[kind])
        return (context >> np.uint64(64 - bits)) << low | (self.hashes >> np.uint64(64 - int(low)))[self.index]

    def pairs(self, kind: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(distinct pairs, how often each is in texts that aren't held out, each token's place
        among them, how often the token's pair is in its own text, 0 if that is held out)."""
        order, key = _ordered(self.keys(kind, bits))
        doc, new = self.doc[order], _fresh(key)
        fresh = _fresh(doc)
        fresh |= new
        taught = ~self.held[doc]
        starts, lengths = _runs(fresh)
        own, place = np.empty(len(key), np.int32), np.empty(len(key), np.int32)
        own[order] = (lengths * taught[starts])[_places(fresh)]
        place[order] = _places(new)
        starts, upto = np.flatnonzero(new), np.cumsum(taught.view(np.int8), dtype=np.int32)
        return key[starts], np.diff(upto[np.append(starts[1:], len(key)) - 1], prepend=0), place, own


def _totals(kind: int, keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """(each pair's place among the distinct ones, for these the counts at LEVELS[kind], the first as
    it is and each further one as what it lacks of that before)."""
    distinct, place = np.unique(keys, return_inverse=True)
    total = np.bincount(place, n, len(distinct)).astype(np.int64)
    steps, there = [], None
    for shift in LEVELS[kind]:
        starts, lengths = _runs(_fresh(distinct >> np.uint64(shift)))
        same = np.repeat(np.add.reduceat(total, starts), lengths) if shift and len(starts) else total
        steps.append(same if there is None else there - same)
        there = same
    return place, steps


def counted(kind: int, each: list[np.ndarray], n: list[np.ndarray]) -> list[list[np.ndarray]]:
    """For pairs asked for in several blocks, with their counts there: for each block what _totals()
    gives of its pairs."""
    place, steps = _totals(kind, np.concatenate(each), np.concatenate(n))
    return [[x[p] for x in steps] for p in np.split(place, np.cumsum([len(x) for x in each])[:-1])]


def counted_elsewhere(kind: int, each: list[np.ndarray], n: list[np.ndarray]) -> list[np.ndarray]:
    """Like counted(), but what the other blocks count, and one array for each block, level after
    level: what pairs that are the same up to a level share is there once, and what follows from
    the levels before isn't, see spread()."""
    keys, n, sizes = np.concatenate(each).astype(np.uint64), np.concatenate(n).astype(np.int64), np.array([len(x) for x in each])
    if not len(keys):
        return [n] * len(each)
    ends = np.cumsum(sizes)
    first = _first_levels(kind, keys)
    first[(ends - sizes)[sizes > 0]] = 0
    order, ordered = _ordered(keys)
    place = np.empty(len(keys), np.int32)
    place[order] = np.arange(len(keys), dtype=np.int32)
    first_all, upto, upto_all = _first_levels(kind, ordered), _upto(n), _upto(n[order])
    levels, others, node = [], None, None
    for level, shift in enumerate(LEVELS[kind]):
        # counts of all blocks and of each one
        fresh, fresh_all = first <= level, first_all <= level
        starts, node_all = np.flatnonzero(fresh), _places(fresh_all)
        of = node_all[place[starts]]
        there = _run_sums(upto_all, np.flatnonzero(fresh_all))[of] - _run_sums(upto, starts)
        if level:
            before = others[node[starts]]
            told = before > 0
            if LEVELS[kind][level - 1] == shift + 1:
                told &= first[starts] < level
            told = np.flatnonzero(told)
            got, at = before[told] - there[told], starts[told]
        else:
            got, at = there, starts
        cuts = np.searchsorted(at, ends).tolist()
        levels.append([got[a:b] for a, b in zip([0, *cuts], cuts, strict=False)])
        others, node = there, _places(fresh)
        if not level:
            # contexts first: of those that one block alone has there is nothing more to tell
            on, on_all = others > 0, np.zeros(int(node_all[-1]) + 1, bool)
            on_all[of[on]] = True
            some, some_all = np.flatnonzero(on[node]), on_all[node_all]
            ends = np.searchsorted(some, ends)
            first, node, place = first[some], node[some], _places(some_all)[place[some]]
            upto, upto_all, first_all = _upto(n[some]), _upto(n[order][some_all]), first_all[some_all]
            if not len(some):
                levels += [[got[:0]] * len(each)]
                break
    return [np.concatenate(x) for x in zip(*levels, strict=True)]


def _first_levels(kind: int, keys: np.ndarray) -> np.ndarray:
    """For each of the sorted keys the first of LEVELS[kind] at which it differs from the key before; the
    number of levels, if it is the same."""
    differ = keys[1:] ^ keys[:-1]
    out = np.zeros(len(keys), np.uint8)
    out[1:] = FIRST_LEVEL[np.minimum(differ >> np.uint64(LEVELS[kind][CLASS_BITS]), CLASSES).astype(np.intp)]
    if kind:
        out[1:] += differ == 0
    return out


#: The first level at which keys differ, by the bits of their classes that do (CLASSES: of their contexts).
FIRST_LEVEL = np.array([CLASS_BITS + 1 - x.bit_length() for x in range(CLASSES + 1)], np.uint8)


def spread(kind: int, keys: np.ndarray, n: np.ndarray, part: np.ndarray, answers: list[np.ndarray]) -> np.ndarray:
    """The counts [pair, level] over all blocks of a block's sorted pairs and their counts in it; each run
    of equal `part` has the next of the answers, see counted_elsewhere(). They lack the pairs of a level
    that no other block has up to the level before, and where a level is one bit more than
    that before, the second of two that share it: it has what the first lacks."""
    first, cuts = _first_levels(kind, keys), np.flatnonzero(_fresh(part))
    wide = max((int(x.max(initial=0)) for x in answers), default=0) + int(n.sum()) >= 1 << 31
    whole = np.int64 if wide else np.int32
    out, upto, at = np.empty((len(keys), len(LEVELS[kind])), whole), _upto(n), [0] * len(answers)
    others = node = None  # of the nodes of the level before; each pair's node there
    for level, shift in enumerate(LEVELS[kind]):
        fresh = first <= level
        starts = np.flatnonzero(fresh)
        if level:
            eldest = first[starts] < level
            before = others[node[starts]]
            halves = LEVELS[kind][level - 1] == shift + 1
            told = np.flatnonzero((before > 0) & eldest if halves else before > 0)
        else:
            told = np.arange(len(starts))
        ends = np.searchsorted(starts[told], [*cuts[1:].tolist(), len(keys)])
        lacks, since, got = np.zeros(len(starts), whole), 0, []
        for k, end in enumerate(ends.tolist()):
            got.append(answers[k][at[k] : at[k] + end - since])
            at[k], since = at[k] + end - since, end
        if len(told):
            lacks[told] = np.concatenate(got)
        if not level:
            others = lacks
        else:
            if halves:
                second = np.flatnonzero(~eldest)
                lacks[second] = before[second] - lacks[second - 1]
            others = before - lacks
        node = _places(fresh)
        out[:, level] = (others + _run_sums(upto, starts).astype(whole))[node]
    return out


def recounted(steps: list[np.ndarray]) -> np.ndarray:
    """The counts [pair, level] of what counted() gives of a block."""
    first = steps[0]
    out = np.empty((len(first), len(steps)), np.int32 if int(first.max(initial=0)) < 1 << 31 else np.int64)
    out[:, 0] = first
    for level, lacks in enumerate(steps[1:], 1):
        np.subtract(out[:, level - 1], lacks, out=out[:, level], casting="unsafe")
    return out


def _ask(no: int, part: np.ndarray, keys: np.ndarray, n: np.ndarray, first: int) -> Iterator[tuple]:
    """Rows (part, no, keys, n) of sorted keys, a row a part."""
    cuts = np.flatnonzero(_fresh(part)).tolist()
    for a, b in zip(cuts, [*cuts[1:], len(part)], strict=True):
        steps = keys[a:b].copy()
        steps[1:] -= keys[a : b - 1]
        yield first + int(part[a]), no, _narrow(steps), _narrow(n[a:b])


ASK = "part long, no long, keys binary, n binary"
ASK_SCHEMA = pa.schema([("part", pa.int64()), ("no", pa.int64()), ("keys", pa.binary()), ("n", pa.binary())])


def _asks(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), ASK_SCHEMA.types, strict=True)] if rows else [pa.array([], t) for t in ASK_SCHEMA.types], schema=ASK_SCHEMA)


def asked_words(blocks: DataFrame, parts: int) -> DataFrame:
    """part, no, keys (the words themselves, by hash), n: each block's words with their counts in
    texts that aren't held out. One row for many words keeps shuffles small."""
    ship(blocks.sparkSession)
    bits = parts.bit_length() - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                (row,) = batch.slice(k, 1).to_pylist()
                block = Block(row | {"ids": None, "n_bytes": row["lengths"]})
                n, words = block.taught(), [b"", *block.words.split()]
                order = np.argsort(block.hashes)
                part = (block.hashes[order] >> np.uint64(64 - bits)).astype(np.int64)
                cuts = np.flatnonzero(_fresh(part)).tolist()
                rows = [(int(part[a]), row["no"], _text(b" ".join([words[i] for i in order[a:b].tolist()])), _narrow(n[order[a:b]])) for a, b in zip(cuts, [*cuts[1:], len(part)], strict=True)]
                yield _asks(rows)

    return blocks.select("no", "held", "lengths", "index", "words").mapInArrow(run, ASK)


def _word_list(blob: bytes) -> tuple[list[bytes], np.ndarray]:
    """(words, hashes) of words joined by single spaces; the empty one is the end of a text."""
    words, hashes = blob.split(b" "), word_hashes([blob])[0]
    return words, hashes if len(hashes) == len(words) else np.insert(hashes, words.index(b""), END_HASH)


def spelled(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word number, slot by the byte before, slot by the two bytes before) of each step in the
    spelling of words: byte after byte from the beginning to the end, both 256."""
    if not words:
        return (np.zeros(0, np.int64),) * 3
    blob = b" " + b" ".join(words) + b" "
    a = np.frombuffer(blob, np.uint8).astype(np.int64)
    a[a == 32] = 256
    last, now = a[:-1], a[1:]
    two = np.concatenate([[256], a[:-2]])
    two[last == 256] = 256
    return np.cumsum(last == 256) - 1, last * 257 + now, (two * 257 + last) * 257 + now


#: Keys of the sums: tokens, distinct ones, those seen once; then the spelling's slots.
N_TOKENS, N_WORDS, N_ONCE, BY_ONE = 0, 1, 2, 8
BY_TWO = BY_ONE + 257 * 257


def counted_words(asks: list[tuple[bytes, np.ndarray]]) -> tuple[list[np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """For words asked for in several blocks: [count over all blocks, count of its code] for each
    block, and sums (key, n)."""
    lists = [_word_list(b) for b, _ in asks]
    hashes = np.concatenate([h for _, h in lists])
    order, distinct = _ordered(hashes)
    fresh = _fresh(distinct)
    starts, place = np.flatnonzero(fresh), np.empty(len(hashes), np.int32)
    place[order] = _places(fresh)
    distinct, first, c = distinct[starts], order[starts], _run_sums(_upto(np.concatenate([n for _, n in asks])[order]), starts)
    starts, lengths = _runs(_fresh(distinct >> np.uint64(64 - CODE_BITS)))
    code = np.repeat(np.add.reduceat(c, starts), lengths)
    words = [w for ws, _ in lists for w in ws]
    _, one, two = spelled([words[i] for i in first[c == 1].tolist() if words[i]])
    slots, n = np.unique(np.concatenate([one + BY_ONE, two + BY_TWO]), return_counts=True)
    sums = np.concatenate([[N_TOKENS, N_WORDS, N_ONCE], slots]), np.concatenate([[c.sum(), (c > 0).sum(), (c == 1).sum()], n])
    return [np.stack([c[p], code[p]]) for p in np.split(place, np.cumsum([len(h) for _, h in lists])[:-1])], sums


ANSWER = "no long, part long, seen binary"


def answered_words(asks: DataFrame) -> DataFrame:
    """no, part, seen: the counts of each block's words; rows of blocks below 0 hold sums."""

    def run(group: pa.Table) -> pa.Table:
        counts, sums = counted_words([(_untext(b), _wide(n).astype(np.int64)) for b, n in zip(group["keys"].to_pylist(), group["n"].to_pylist(), strict=True)])
        part = group["part"][0].as_py()
        seen = [_narrow(x.ravel()) for x in counts] + [_narrow(np.concatenate(sums))]
        return pa.table({"no": pa.array([*group["no"].to_pylist(), -1 - part], pa.int64()), "part": pa.array([part] * len(seen), pa.int64()), "seen": pa.array(seen, pa.binary())})

    return asks.groupBy("part").applyInArrow(run, ANSWER)


def _added(keys: list[np.ndarray], n: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(distinct keys, their sums)."""
    distinct, place = np.unique(np.concatenate([np.zeros(0, np.int64), *keys]), return_inverse=True)
    total = np.zeros(len(distinct), np.int64)
    np.add.at(total, place, np.concatenate([np.zeros(0, np.int64), *n]))
    return distinct, total


def _sum(df: DataFrame, read) -> tuple[np.ndarray, np.ndarray]:
    """(keys, sums) over the rows of df: read gives a row's (keys, n). There are as many keys as
    contexts of two bytes and a next one occur at most, a number that the corpus can't raise."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n, have = [], [], 0
        for batch in batches:
            for x in batch.column(0).to_pylist():
                own = read(x)
                keys.append(own[0].astype(np.int64))
                n.append(own[1].astype(np.int64))
                have += len(keys[-1])
                if have > 2_000_000:
                    keys, n = ([x] for x in _added(keys, n))
                    have = 0
        at, total = _added(keys, n)
        yield pa.RecordBatch.from_arrays([pa.array(at[total > 0], pa.int64()), pa.array(total[total > 0], pa.int64())], names=["key", "n"])

    got = df.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    keys, n = got["key"].to_numpy(), got["n"].to_numpy()
    order = np.argsort(keys)
    return keys[order], n[order]


def _halves(b: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = _wide(b).astype(np.int64)
    return both[: len(both) // 2], both[len(both) // 2 :]


def _whole(b: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = _wide(b)
    return np.arange(len(n)), n


def answered_pairs(blocks: DataFrame, kind: int, bits: int, parts: int) -> DataFrame:
    """no, part, seen: for each of a block's pairs of a kind what counted_elsewhere() gives over the texts that aren't
    held out. Parts are numbered from `parts` on for pairs of kind 0, from 2 * parts on for
    those of kind 1."""
    ship(blocks.sparkSession)
    cut = bits - (parts.bit_length() - 1)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                (row,) = batch.slice(k, 1).to_pylist()
                block = Block(row | {"ids": None, "n_bytes": row["lengths"]})
                keys, n, *_ = block.pairs(kind, bits)
                low = KEY_BITS[kind] + cut
                part = (keys >> np.uint64(low)).astype(np.int64)
                yield _asks(list(_ask(row["no"], part, keys & np.uint64((1 << low) - 1), n, (1 + kind) * parts)))

    def answer(group: pa.Table) -> pa.Table:
        each = [np.cumsum(_wide(x).astype(np.uint64)) for x in group["keys"].to_pylist()]
        seen = [_narrow(x) for x in counted_elsewhere(kind, each, [_wide(x) for x in group["n"].to_pylist()])]
        return pa.table({"no": group["no"], "part": group["part"], "seen": pa.array(seen, pa.binary())})

    return blocks.select("no", "held", "lengths", "index", "words").mapInArrow(ask, ASK).groupBy("part").applyInArrow(answer, ANSWER)


@dataclass(frozen=True)
class Seen:
    """A block's answers: words [count, code's count; word]; of both kinds, counts of the pairs
    [pair, level], each token's place among them and how often its own text has its pair."""

    words: np.ndarray
    pairs: tuple[tuple[np.ndarray, np.ndarray, np.ndarray], ...]


def read_answers(block: Block, answers: list[tuple[int, bytes]], bits: int, parts: int) -> Seen:
    """The block's answers, in the order of their parts."""
    got: tuple[list, list, list] = ([], [], [])
    for part, seen in answers:
        got[part // parts].append(_wide(seen))
    words = np.empty((2, len(block.hashes)), np.int64)
    words[:, np.argsort(block.hashes)] = np.concatenate([x.reshape(2, -1) for x in got[0]], axis=1)
    pairs = []
    for kind in (0, 1):
        keys, n, place, own = block.pairs(kind, bits)
        part = keys >> np.uint64(KEY_BITS[kind] + bits - (parts.bit_length() - 1))
        pairs.append((spread(kind, keys, n, part, got[1 + kind]), place, own))
    return Seen(words, tuple(pairs))


@dataclass(frozen=True)
class Inputs:
    """Of tokens: new (no training token), z (the predictors' log odds for the side that came, each
    [bit, token]), side (1 or -1), gate, live (the bit is open); whether it can be one of those that
    followed, log of their number, its share of them and of its class; kind and the class before as one."""

    new: np.ndarray
    was_new: np.ndarray
    z: list[np.ndarray]
    side: np.ndarray
    gate: np.ndarray
    live: np.ndarray
    can_follow: np.ndarray
    known: np.ndarray
    share: np.ndarray
    plain: np.ndarray
    gram: np.ndarray


def _turned(rows: np.ndarray, at: np.ndarray) -> np.ndarray:
    """rows[at], columns first. A row lies in one place of memory, its columns don't."""
    return np.ascontiguousarray(np.take(rows, at, axis=0, mode="clip").T)


class Model:
    """What scoring needs of the whole corpus: sums and tables of fixed size."""

    def __init__(self, sums: tuple[np.ndarray, np.ndarray], grams: np.ndarray, how: Mixer, bits: int):
        keys, n = sums
        self.how, self.bits = how, bits
        few = dict(zip(keys[keys < BY_ONE].tolist(), n[keys < BY_ONE].tolist(), strict=True))
        self.n, self.v, self.once = (few.get(k, 0) for k in (N_TOKENS, N_WORDS, N_ONCE))
        leaves = grams.reshape(CLASSES + 1, CLASSES).astype(np.float64)
        self.totals = leaves.sum(0)
        # by bit and class, or class before and class: the side, the log odds for it, whether the bit is
        # open, with training tokens on both sides
        bits_left, kinds = np.arange(CLASS_BITS - 1, -1, -1)[:, None], np.arange(CLASSES)
        node = (kinds | CLASSES) >> (bits_left + 1)
        self.side = (2 * (kinds >> bits_left & 1) - 1).astype(np.float32)
        self.direct = [self._odds(x)[:, node].transpose(1, 0, 2) * self.side[:, None] for x in (self.totals[None], leaves)]
        self.direct = [np.ascontiguousarray(x.reshape(CLASS_BITS, -1)) for x in self.direct]
        self.direct[1] = np.ascontiguousarray(self.direct[1].T)  # a row is read at once
        tree = self._tree(self.totals[None])[0]
        self.open = ((tree[0 : 2 * CLASSES : 2] > 0) & (tree[1 : 2 * CLASSES : 2] > 0))[node]
        e = min(0.9, max(0.5, self.once) / max(1, self.n)) if self.n else 1.0
        self.escape = float(np.log(e / (1 - e))) if self.n else np.inf
        some = (keys >= BY_ONE) & (keys < BY_TWO)
        one = np.bincount(keys[some] - BY_ONE, n[some], 257 * 257).reshape(257, 257)
        by_one = (one + 0.1) / (one.sum(1, keepdims=True) + 0.1 * 257)
        self.two_keys, self.two_n = keys[keys >= BY_TWO] - BY_TWO, n[keys >= BY_TWO]
        self.by_one, self.two_sums = by_one.ravel(), np.bincount(self.two_keys // 257, self.two_n, 257 * 257)

    def _tree(self, leaves: np.ndarray) -> np.ndarray:
        """Counts [row, node] of the class tree, numbered from 1 at the root; n has 2n and 2n + 1."""
        tree = np.zeros((len(leaves), 2 * CLASSES))
        tree[:, CLASSES:] = leaves
        for node in range(CLASSES - 1, 0, -1):
            tree[:, node] = tree[:, 2 * node] + tree[:, 2 * node + 1]
        return tree

    def _odds(self, leaves: np.ndarray) -> np.ndarray:
        """Log odds of each inner node [row, node]."""
        tree = self._tree(leaves)
        return np.log((tree[:, 1::2] + self.how.prior) / (tree[:, 0::2] + self.how.prior)).astype(np.float32)

    def _ratio(self, these: np.ndarray, others: np.ndarray) -> np.ndarray:
        """Log odds of two counts, the prior added to both."""
        prior = np.float32(self.how.prior)
        return np.log((these.astype(np.float32) + prior) / (others.astype(np.float32) + prior))

    def spelled_byte(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """The probability of each step of a spelling."""
        at = np.minimum(np.searchsorted(self.two_keys, two), max(0, len(self.two_keys) - 1))
        n = np.where(self.two_keys[at] == two, self.two_n[at], 0) if len(self.two_keys) else np.zeros(len(two), np.int64)
        return (n + 4 * self.by_one[one]) / (self.two_sums[two // 257] + 4)

    def spelling(self, block: Block, unseen: np.ndarray) -> np.ndarray:
        """log10 of the probability of the spelling of each of the block's words, if unseen."""
        out = np.zeros(len(unseen))
        chosen = np.flatnonzero(unseen)
        if len(chosen):
            words = [b"", *block.words.split()]
            of, one, two = spelled([words[i] for i in chosen.tolist()])
            out[chosen] = np.bincount(of, np.log10(self.spelled_byte(one, two)), len(chosen))
        return out

    def inputs(self, block: Block, seen: Seen, order: np.ndarray, mine: np.ndarray | int = 0) -> Inputs:
        """Of the tokens at the places `order`. mine: what to leave out of their words' counts."""
        index, before, begins = block.index[order], block.index[order - 1], block.begins[order]
        c, code = np.take(seen.words, index, axis=1) - mine
        new, kinds = c == 0, block.kinds[index].astype(np.intp)
        was_new = (seen.words[0][before] == 0) & ~begins
        gram = np.where(begins, CLASSES, block.kinds[before]) * CLASSES + kinds
        z = [np.take(self.direct[0], kinds, axis=1), _turned(self.direct[1], gram)]
        gate, live = np.zeros(z[0].shape, np.int8), np.take(self.open, kinds, axis=1)
        live &= ~new
        for kind, (counts, at, own) in enumerate(seen.pairs):
            n = _turned(counts, at[order])
            n -= np.minimum(own[order], n)  # counts of other texts alone
            there, same = n[:CLASS_BITS], n[1 : CLASS_BITS + 1]
            sure = (there > 0).view(np.int8) + (there > OFTEN).view(np.int8)
            gate += sure if kind else sure * np.int8(3)
            z.append(self._ratio(same, there - same))
        followed, follows = n[CLASS_BITS], n[CLASS_BITS + 1]
        # the code's share of its class is by all texts, the word's share of its code as well
        share = follows / np.maximum(1, followed) * (c / np.maximum(1, code))
        plain = np.where(new, 1.0, c / np.maximum(1, self.totals[kinds]))
        return Inputs(new, was_new, z, np.take(self.side, kinds, axis=1), gate, live, (followed > 0) & ~new, np.log(followed + np.float32(0.5), dtype=np.float32), share, plain, gram)

    def cells(self, block: Block, seen: Seen) -> np.ndarray:
        """What learned() needs [cell, number of decisions and sums of four] of the texts that aren't
        held out, each as if it were: its own occurrences are left out of all counts by word and context."""
        order = np.flatnonzero(~block.held[block.doc])
        alone = block.alone()[order]
        out = np.zeros((5, CELLS + 1))
        steps = np.tile(_steps(self.direct[0].T) * np.int32(STEPS), (CLASSES + 1, 1)) + _steps(self.direct[1])
        for a in range(0, len(order), CELL_SLICE):
            b = min(len(order), a + CELL_SLICE)
            at, z = np.empty(CLASS_BITS * (b - a), np.int32), np.empty((INPUTS, CLASS_BITS * (b - a)), np.float32)
            for c in range(a, b, SLICE):
                self._place_cells(out, self.inputs(block, seen, order[c : min(b, c + SLICE)], alone[c : min(b, c + SLICE)]), steps, at, z, CLASS_BITS * (c - a))
            at = at.astype(np.intp)
            out[0, : BIT_CELLS + 1] += np.bincount(at, minlength=BIT_CELLS + 1)
            for k, v in enumerate(z, 1):
                out[k, : BIT_CELLS + 1] += np.bincount(at, v, BIT_CELLS + 1)
        return np.delete(out, BIT_CELLS, axis=1).T

    def _place_cells(self, out: np.ndarray, has: Inputs, steps: np.ndarray, at: np.ndarray, z: np.ndarray, since: int) -> None:
        """The cells of bit decisions and their log odds into at and z, from `since` on; closed bits have
        cell BIT_CELLS. Sums of the other decisions, after that cell, are added to out."""
        cell = _turned(steps, has.gram)
        cell += has.gate * np.int32(STEPS**2)
        for x in has.z[2:]:
            cell *= np.int32(STEPS)
            cell += _steps(x)
        np.copyto(cell, BIT_CELLS, where=~has.live)
        at[since : since + cell.size] = cell.ravel()
        for k, v in enumerate(has.z):
            z[k, since : since + cell.size] = v.ravel()
        # one of those that followed: log of their number, log of its share of them to that of its class
        known, share, plain = has.known[has.can_follow], has.share[has.can_follow], has.plain[has.can_follow]
        odds = np.where(share > 0, np.log(np.maximum(share, 1e-300) / plain), 0.0)
        follow = np.clip(np.rint(known * 2), -2, 45).astype(np.int64) + 2
        follow = follow * FOLLOW_STEPS + np.where(share > 0, np.clip(np.rint(odds * 2), -30, 30) + 31, 0).astype(np.int64)
        for k, v in enumerate([None, known, odds]):
            out[k, BIT_CELLS + 1 : -1] += np.bincount(follow, v, CELLS - BIT_CELLS - 1)
        out[:2, -1] += len(has.new), has.new.sum()

    def score(self, block: Block, seen: Seen) -> tuple[np.ndarray, np.ndarray]:
        """(log10 of each text's probability, what of it spells unseen tokens)."""
        docs = len(block.lengths)
        longest = np.argsort(-block.lengths, kind="stable")  # the longest first, so that the texts that go on are always the first ones
        total = np.zeros(docs)
        for a in range(0, docs, SCORED_TEXTS):
            total[longest[a : a + SCORED_TEXTS]] = self._scored(block, seen, longest[a : a + SCORED_TEXTS])
        spelling = np.bincount(block.doc, self.spelling(block, seen.words[0] == 0)[block.index], docs)
        return total + spelling, spelling

    def _scored(self, block: Block, seen: Seen, texts: np.ndarray) -> np.ndarray:
        """log10 of the probability of each of the texts, the longest first, without spellings."""
        how, docs, lengths = self.how, len(texts), block.lengths[texts]
        # pieces of CHUNK tokens, the first ones of all texts, then the second ones, and so on
        chunks = -(-lengths // CHUNK)
        doc = np.repeat(np.arange(docs), chunks)
        chunk = np.arange(len(doc)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
        by = np.argsort(chunk, kind="stable")
        doc, chunk = doc[by], chunk[by]
        size = np.minimum(CHUNK, lengths[doc] - CHUNK * chunk)
        first = np.cumsum(size) - size
        order = np.arange(int(size.sum())) + np.repeat(block.first[texts[doc]] + CHUNK * chunk - first, size)
        active = np.bincount(chunk)
        cuts = np.append(first[np.cumsum(active) - active], len(order))
        doc = np.repeat(doc, size)
        weights = np.repeat(np.array(how.start, np.float32)[:, None, :], docs, axis=1).reshape(INPUTS, docs * GATES)
        other = np.repeat(np.array([[*how.unseen, 0.0], [*how.follow, 0.0]], np.float32)[:, :, None], docs, axis=2)  # [decision, weight, doc]; the last: of an unseen token before
        refined = np.tile((1 / (1 + np.exp(-np.linspace(-8, 8, BUCKETS)))).astype(np.float32), 1 + docs * CLASS_BITS)  # the first are of closed bits
        total, upto = np.zeros(docs), 0
        for start, end, k in zip(cuts[:-1].tolist(), cuts[1:].tolist(), active.tolist(), strict=True):
            if end > upto:  # the decisions and log odds of the tokens of the next steps, in the order of chunks
                since, upto = start, int(cuts[max(np.searchsorted(cuts, start + SLICE, side="right") - 1, np.searchsorted(cuts, end))])
                has = self.inputs(block, seen, order[since:upto])
                all_gates = has.gate + doc[since:upto] * GATES
                first_cells = ((1 + doc[since:upto] * CLASS_BITS + np.arange(CLASS_BITS)[:, None]) * BUCKETS).astype(np.float32 if docs * CLASS_BITS * BUCKETS < 1 << 22 else np.float64)
                closed = ~has.live
                if closed.any():
                    first_cells[closed] = 0
                    for x in has.z:
                        x[closed] = 0
                else:
                    closed = None
            own = slice(start - since, end - since)
            d, live, can, g = doc[start:end], ~has.new[own], has.can_follow[own], np.ascontiguousarray(all_gates[:, own])
            w, map_, z, side = weights[:, : k * GATES], refined[: (1 + k * CLASS_BITS) * BUCKETS], [x[:, own] for x in has.z], has.side[:, own]
            # all by the side that came: its log odds and probability
            logit = w[0].take(g, mode="clip")
            logit *= z[0]
            for i in range(1, INPUTS):
                more = w[i].take(g, mode="clip")
                more *= z[i]
                logit += more
            np.clip(logit, -12, 12, out=logit)
            p = np.exp(-logit)
            p += 1
            np.reciprocal(p, out=p)
            logit *= side
            logit += 8
            logit *= (BUCKETS - 1) / 16
            logit += 0.5
            np.clip(logit, 0, BUCKETS - 1, out=logit)
            at = (np.floor(logit, out=logit) + first_cells[:, own]).astype(np.intp)
            kept = map_.take(at, mode="clip")
            kept += np.minimum(side, 0)  # less 1, if the other side came
            final = np.abs(kept)
            final *= 0.25
            final += 0.75 * p
            np.clip(final, 1e-5, 1 - 1e-5, out=final)
            if closed is not None:
                final[closed[:, own]] = 1
            half = CLASS_BITS // 2
            chance = final[:half].prod(axis=0).astype(np.float64) * final[half:].prod(axis=0)
            error = 1 - p
            flat, at = g.ravel(), at.ravel()
            for i in range(INPUTS):
                w[i] += how.rate * np.bincount(flat, (error * z[i]).ravel(), w.shape[1])
            # bits less what was kept: 1 - kept, or -kept
            kept -= side
            met, moved = np.bincount(at, minlength=map_.size), np.bincount(at, kept.ravel(), map_.size)
            on = np.flatnonzero(met > 0)
            map_[on] = np.clip(map_[on] - how.refine * moved[on] / (1 + how.refine * met[on]), 1e-4, 1 - 1e-4)
            # unseen or not
            if self.n:
                v, was_new = other[0], has.was_new[own]
                p = 1 / (1 + np.exp(-np.clip(v[0].take(d) + v[1].take(d) * self.escape + v[2].take(d) * was_new, -12, 12)))
                chance *= np.where(live, 1 - p, p)
                miss = ~live - p
                v[0, :k] += 0.5 * how.rate * np.bincount(d, miss, k)
                v[2, :k] += 0.5 * how.rate * np.bincount(d, miss * was_new, k)
            # one of those that followed, or by its share of the class
            v, known = other[1], has.known[own]
            p = np.where(can, 1 / (1 + np.exp(-np.clip(v[0].take(d) + v[1].take(d) * known, -12, 12))), 0.0)
            by = p * has.share[own]
            word = by + (1 - p) * has.plain[own]
            chance *= word
            miss = np.where(can, by / word - p, 0.0)
            v[0, :k] += 0.5 * how.rate * np.bincount(d, miss, k)
            v[1, :k] += 0.1 * how.rate * np.bincount(d, miss * known, k)
            total[:k] += np.bincount(d, np.log10(chance), k)
        return total


#: Steps of log odds, by eighths: cells hold sums, so that these tell which decisions share a mean.
STEP_TOP = 36
STEP = np.searchsorted([-35, -23, -15, -9, -5, -1, 1, 5, 9, 15, 23, 35], np.arange(-STEP_TOP, STEP_TOP + 1) + 0.0, side="right").astype(np.int32)
STEPS, FOLLOW_STEPS = 13, 62
BIT_CELLS = GATES * STEPS**INPUTS
CELLS = BIT_CELLS + 48 * FOLLOW_STEPS + 1


def _steps(z: np.ndarray) -> np.ndarray:
    """The step of each of the log odds."""
    eighths = z * np.float32(8)
    eighths += np.float32(STEP_TOP + 0.5)
    return STEP.take(np.clip(eighths, 0, 2 * STEP_TOP, out=eighths).astype(np.intp))


def _chance(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _newton(start: np.ndarray, told, steps: int) -> np.ndarray:
    """The weights with the greatest value of told(weights): (value, gradient, curvature), less half the
    squared distance from start, which holds weights that little is known about."""
    w = start
    value, slope, curve = told(w)
    for _ in range(steps):
        step = np.linalg.solve(curve + np.eye(len(w)), slope - (w - start))
        for _ in range(20):
            new = told(w + step)
            gain = new[0] - value - 0.5 * (((w + step - start) ** 2).sum() - ((w - start) ** 2).sum())
            if gain >= 0:
                break
            step = step / 2
        else:
            return w
        w, (value, slope, curve) = w + step, new
    return w


def learned(cells: np.ndarray, n: np.ndarray, sums: np.ndarray, how: Mixer) -> Mixer:
    """how with the starting weights under which the decisions in cells (number n, sums [cell, 4] of what
    Model.cells() sums) are the most probable, those of a cell taken at their mean."""
    mean = sums / n[:, None]
    start = np.array(how.start)
    for gate in range(GATES):
        at = cells // STEPS**INPUTS == gate
        x, k = mean[at], n[at]

        def bits(w, x=x, k=k):
            p = _chance(x @ w)
            return float(k @ np.log(p)), x.T @ (k * (1 - p)), x.T @ (x * (k * p * (1 - p))[:, None])

        start[:, gate] = _newton(start[:, gate], bits, how.epochs)
    at = (cells >= BIT_CELLS) & (cells < CELLS - 1)
    x, k = np.stack([np.ones(at.sum()), mean[at, 0]], axis=1), n[at]
    ratio = np.where((cells[at] - BIT_CELLS) % FOLLOW_STEPS > 0, np.exp(np.clip(mean[at, 1], -50, 50)), 0.0)

    def follow(w):
        p = _chance(x @ w)
        word = p * ratio + 1 - p
        return float(k @ np.log(word)), x.T @ (k * (p * ratio / word - p)), x.T @ (x * (k * p * (1 - p))[:, None])

    rest = _newton(np.array(how.follow), follow, how.epochs)
    return replace(how, start=tuple(map(tuple, start.tolist())), follow=tuple(rest.tolist()))


def learned_unseen(n: float, new: float, escape: float, how: Mixer) -> Mixer:
    """how with the bias under which `new` of n tokens are as many unseen ones as expected."""
    return replace(how, unseen=(float(np.log((new + 0.5) / (n - new + 0.5)) - how.unseen[1] * escape), how.unseen[1]))


def fitted(docs: DataFrame, how: Mixer) -> Mixer:
    """how with starting weights learned from those of docs (doc_id, held, text) that aren't held out."""
    return trained(docs, how)[1].how


def trained(docs: DataFrame, how: Mixer) -> tuple[DataFrame, Model, int]:
    """(blocks with their answers, the model, parts) of docs (doc_id, held, text)."""
    spark = docs.sparkSession
    with shuffles_dropped(spark):
        blocks = bucketed(word_blocks(docs).withColumn("no", F.monotonically_increasing_id()), "no", "blocks")
        grams = np.bincount(*_sum(blocks.select("grams"), _whole), (CLASSES + 1) * CLASSES).astype(np.int64)
        tokens = int(grams.sum())
        parts = max(GROUPS, 1 << (2 * tokens // GROUP_PAIRS).bit_length())
        bits = max(CONTEXT_BITS, parts.bit_length(), tokens.bit_length() + CONTEXT_SLACK)
        words = bucketed(answered_words(asked_words(blocks, parts)), "no", "words")
        model = Model(_sum(words.where("no < 0").select("seen"), _halves), grams, how, bits)
        # a table after the other, each in the buckets of the blocks: answers are dealt to blocks once, when they are written
        both = blocks
        for k, own in enumerate((words, *(bucketed(answered_pairs(blocks, kind, bits, parts), "no", f"pairs_{kind}") for kind in (0, 1)))):
            both = both.join(own.where("no >= 0").groupBy("no").agg(F.collect_list(F.struct("part", "seen")).alias(f"answers_{k}")), "no")
        if how.fit_rows is None and tokens:
            ship(spark)

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                total = np.zeros((CELLS, 5))
                for batch in batches:
                    for k in range(batch.num_rows):
                        block, seen = answered(batch.slice(k, 1), bits, parts)
                        total += model.cells(block, seen)
                at = np.flatnonzero(total[:, 0])
                yield pa.RecordBatch.from_arrays([pa.array(at), *map(pa.array, total[at].T)], names=["cell", "n", *SUMS])

            got = both.mapInArrow(run, f"cell long, n double, {', '.join(f'{x} double' for x in SUMS)}").groupBy("cell").agg(*[F.sum(x).alias(x) for x in ("n", *SUMS)]).toArrow()  # CELLS rows at most
            got = got.sort_by("cell")
            cells, n, sums = got["cell"].to_numpy(), got["n"].to_numpy(), np.stack([got[x].to_numpy() for x in SUMS], axis=1)
            model.how = learned(cells, n, sums, how)
            if len(cells) and cells[-1] == CELLS - 1:
                model.how = learned_unseen(n[-1], sums[-1, 0], model.escape, model.how)
    return both, model, parts


SUMS = tuple(f"sum_{k}" for k in range(INPUTS))


def answered(batch: pa.RecordBatch, bits: int, parts: int) -> tuple[Block, Seen]:
    """A block and its answers from a row."""
    (row,) = batch.to_pylist()
    block = Block(row)
    return block, read_answers(block, sorted((x["part"], x["seen"]) for k in range(3) for x in row.pop(f"answers_{k}")), bits, parts)


def held_out(id_col: Column) -> Column:
    """crc32 of the id as text, modulo 5, is 1. Null is no held-out id."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 1, F.lit(False))


def lm_scores(docs: DataFrame, how: Mixer = Mixer(), held: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, held_out, n_tokens, n_known, train_tokens, base_score,
    score (log10 of the text's probability), spelled_base (base_score and the spelling of the
    unseen tokens, to compare score with), bits_per_byte (of score; null for an empty text).

    Learns from the texts that aren't held out. Null texts are empty ones: their one token
    is the end. Without training texts all tokens are unseen and all counts 0. Repeated
    rows count as often as they are there; a null id isn't held out. An empty table gives no
    rows. Other columns are not read. Words are told apart by 64-bit hashes."""
    held = held_out(F.col(id_col)) if held is None else held
    src = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(held, F.lit(False)).alias("held"), F.col(text_col).alias("text"))
    both, model, parts = trained(src, how)
    floor = model.n + 0.5 * (model.v + 1)
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                b, seen = answered(batch.slice(k, 1), model.bits, parts)
                score, spelling = model.score(b, seen)
                c = seen.words[0]
                base = np.bincount(b.doc, np.log10((c + 0.5) / floor)[b.index], len(b.lengths))
                n_known = np.bincount(b.doc, (c > 0)[b.index], len(b.lengths)).astype(np.int64)
                with np.errstate(divide="ignore", invalid="ignore"):
                    per_byte = -score / np.log10(2) / b.n_bytes
                columns = [pa.array(b.ids, pa.string()), pa.array(b.held), pa.array(b.lengths), pa.array(n_known), pa.array(np.full(len(b.ids), model.n, np.int64)), pa.array(base), pa.array(score), pa.array(base + spelling), pa.array(per_byte, mask=b.n_bytes == 0)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "spelled_base", "bits_per_byte"])

    out = both.mapInArrow(run, "doc_id string, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, spelled_base double, bits_per_byte double")
    return out.withColumn("doc_id", F.col("doc_id").cast(docs.schema[id_col].dataType)).withColumnRenamed("doc_id", id_col)
