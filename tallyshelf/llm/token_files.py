"""Token ids in grammar-compressed binary blocks, in ascending order of doc_id.

Documents are range-partitioned and sorted by doc_id, encoded, and cut into blocks of whole documents of
about ``BLOCK_IDS`` ids. Each block is compressed by itself: again and again its most frequent pairs of
neighbouring ids are replaced by new ids, nonterminals, until none is frequent, whose rules the block keeps along with the number
of ids that each expands to. With these lengths a document, or any stretch of one, is decoded without
expanding what lies before it. No pair reaches over the end of a document.

A file holds one row per block, in Parquet as the container: what Spark's committer wrote is whole even
if executors were lost. Integers are little-endian, unsigned, 32 bits. Fields: ``first_id``, ``part`` and
``block`` order the blocks; ``doc_ids`` (64-bit), ``no_ids`` (how many of them, the first ones, are null), ``doc_at`` (each document's first place in ``symbols``),
``doc_ids_before`` (ids of the block's documents before it); ``rules`` (pairs; rule i makes id
``FIRST_RULE`` + i from earlier ids), ``lengths`` (ids that rule i expands to), ``symbols``.

Ids equal those of the tokenizers library for the whole text. A chunk between a single space and the
next encodes by itself, as the tokenizer's pattern never matches across such a place, so each step
encodes its distinct chunks once. Chunks of common letters, digits and marks are cut into the pattern's pieces
here, and the library's model encodes each distinct piece; all others go through the whole tokenizer. Texts,
chunks, pieces and their ids lie in Arrow's columns: no Python object is made for a chunk that occurs again.

Defined cases: a null or empty text has the end id only; null doc_ids come first; rows that repeat one
doc_id stand side by side, ordered by text; an empty table gives no blocks and no rows.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyshelf.llm.common import arrow_pass, held, scratch_folder, text_pass

END_ID, FIRST_RULE = 0, 1 << 16
BLOCK_IDS, PER_ROUND, LEAST_COUNT = 1 << 19, 16384, 4
#: Chunks or pieces remembered between steps, and the longest of them.
REMEMBERED, LONGEST = 1_200_000, 64
#: Bytes of texts that a step takes, and of chunks or pieces that go to the library at once, or one longer text, chunk or piece.
STEP, CALL = 1 << 23, 1 << 18

#: Ranges that every version of Unicode since 5.0 has as letters alone, and as neither letters, numbers nor white space.
LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f\u0391-\u03a1\u03a3-\u03ce\u0400-\u0481\u0621-\u063a\u0641-\u064a\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3"
MARKS = "!-/:-@[-`{-~\u00a1-\u00a9\u2010-\u2027\u3001-\u3003\u3008-\u3011\uff01-\uff0f"
#: Chunks that consist of these and of ASCII digits, and the pieces into which the pattern of ByteLevel cuts them.
SIMPLE = re.compile(f" ?[{LETTERS}{MARKS}0-9]+")
PIECE = re.compile(f"'(?:s|t|re|ve|m|ll|d)| ?[{LETTERS}]+| ?[0-9]+| ?[{MARKS}]+")
#: The only ways of cutting texts for which pieces are handed to the model by themselves.
BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
#: The letters by which ByteLevel calls bytes: themselves where they are visible, else those from U+0100 on, in order.
HIDDEN = [*range(33), *range(127, 161), 173]
BYTE_NAMES = {x: chr(256 + i) for i, x in enumerate(HIDDEN)}
#: The code points of bytes' letters; a line end stands for itself, as it parts the pieces of one call.
NAMES = np.array([10 if x == 10 else ord(BYTE_NAMES.get(x, chr(x))) for x in range(256)], "<u4")

#: Kinds of characters of simple chunks, by code point.
LETTER, DIGIT, MARK, SPACE = 1, 2, 3, 4
KINDS = np.zeros(1 << 16, np.uint8)
for _kind, _ranges in ((LETTER, LETTERS), (DIGIT, "0-9"), (MARK, MARKS), (SPACE, " ")):
    KINDS[[ord(c) for c in re.findall(f"[{_ranges}]", "".join(map(chr, range(0xD800))) + "".join(map(chr, range(0xE000, 1 << 16))))]] = _kind

#: Bytes beside which texts may be cut (0), spaces and line ends, and what is or may be other white space.
BESIDE, BLANK, LINE_END, OTHER = range(4)
PLACES = np.array([OTHER] * 33 + [BESIDE] * 94 + [OTHER] + [BESIDE] * 128, np.uint8)
PLACES[32], PLACES[10] = BLANK, LINE_END
#: White space beyond ASCII, and what some version of Unicode has as such, in UTF-8.
WIDE = {2: [0xC285, 0xC2A0], 3: [int.from_bytes(chr(c).encode()) for c in (0x1680, 0x180E, *range(0x2000, 0x200C), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]}


def column(offsets: np.ndarray, data) -> pa.Array:
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(data)])


def parts(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The offsets and bytes of a column of large_binary or large_string."""
    _, offsets, data = values.buffers()
    at = np.frombuffer(offsets, np.int64)[values.offset : values.offset + len(values) + 1] if len(values) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data else np.zeros(0, np.uint8)
    return at - at[0], raw


def runs(values: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """Where runs of values start and how many they are: of most bytes together, or one value."""
    ends = np.cumsum(pc.binary_length(values).to_numpy(zero_copy_only=False).astype(np.int64))
    first = 0
    while first < len(ends):
        after = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + most, "right")))
        yield first, after - first
        first = after


def units(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Offsets at which texts that lie side by side come apart: into their chunks, and after each text an empty unit.

    A space between two characters that are no white space starts a chunk, a line end between two such is one. Texts
    that may hold a special token stay whole.
    """
    place = np.append(PLACES[data], np.uint8(OTHER))
    lead = np.flatnonzero((data == 0xC2) | ((data >= 0xE1) & (data <= 0xE3)))
    if len(lead):
        padded = np.append(data, np.zeros(2, np.uint8)).astype(np.int32)
        two = padded[lead] << 8 | padded[lead + 1]
        for width, found in ((2, np.isin(two, WIDE[2])), (3, np.isin(two << 8 | padded[lead + 2], WIDE[3]))):
            for i in range(width):
                place[lead[found] + i] = OTHER
    border = np.zeros(len(data) + 1, bool)
    border[0] = border[ends] = True
    at = np.flatnonzero(place[:-1])
    at = at[(place[at] != OTHER) & (place[at - 1] == BESIDE) & (place[at + 1] == BESIDE) & ~border[at] & ~border[at + 1]]
    cuts = np.concatenate([at, at[place[at] == LINE_END] + 1])
    special = np.flatnonzero((data[:-1] == 60) & (data[1:] == 124))
    if len(special):
        whole = np.zeros(len(ends) + 1, bool)
        whole[np.searchsorted(ends, special, "right")] = True
        cuts = cuts[~whole[np.searchsorted(ends, cuts, "right")]]
    twice = np.where(np.diff(ends, prepend=0) > 0, 2, 1)
    return np.sort(np.concatenate([[0], cuts, np.repeat(ends, twice)]))


class ChunkEncoder:
    """Encodes texts through the tokenizers library, each distinct chunk once."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import CharDelimiterSplit

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.library, self.known, self.older = Tokenizer.from_file(path), {}, {}
        self.library.no_truncation()
        self.library.no_padding()
        if self.library.get_vocab_size() > FIRST_RULE:
            raise ValueError("ids of this tokenizer reach into the rules")
        read = json.loads(Path(path).read_text())
        marked = any("<|" not in x["content"] for x in read["added_tokens"])
        self.by_piece = read["normalizer"] is None and read["pre_tokenizer"] == BYTE_LEVEL and not marked
        self.model = self.library.model
        self.pieces = Tokenizer(self.model)
        self.pieces.pre_tokenizer = CharDelimiterSplit("\n")
        self.widths = np.zeros(self.library.get_vocab_size(), np.int64)
        for name, i in self.library.get_vocab(with_added_tokens=False).items():
            self.widths[i] = len(name)
        self.pieces_known = (column(np.zeros(1), b""), column(np.zeros(1), b""))
        (self.line_end,) = self.library.encode("\n", add_special_tokens=False).ids

    def of_pieces(self, chunks: list[str]) -> dict[str, bytes]:
        """Ids of chunks that are SIMPLE: the library's model gets each distinct piece, its bytes as the letters that stand for them."""
        cut = list(map(PIECE.findall, chunks))
        tokenize = self.model.tokenize
        named = lambda p: p.replace(" ", "\u0120") if p.isascii() else p.encode().decode("latin-1").translate(BYTE_NAMES)
        ids = {p: array("I", [t.id for t in tokenize(named(p))]).tobytes() for p in set(chain.from_iterable(cut))}
        return {c: b"".join([ids[p] for p in pieces]) for c, pieces in zip(chunks, cut, strict=True)}

    def learn(self, missing: set[str]) -> dict[str, bytes]:
        """Ids of chunks that are not known: from the older half of the memory, which goes when the newer one is full, or anew."""
        found = {c: self.older[c] for c in missing if c in self.older}
        simple, plain, odd = [], [], []
        for c in missing.difference(found):
            if self.by_piece and SIMPLE.fullmatch(c) and "<|" not in c:
                simple.append(c)
                continue
            parts = c.split()
            (plain if len(parts) == 1 and (c == parts[0] or c == " " + parts[0]) else odd).append(c)
        found.update(self.of_pieces(simple))
        for i in range(0, len(plain), 4096):  # many in one call: a line end encodes alone, and never together with its neighbours
            part = plain[i : i + 4096]
            (line,) = self.library.encode_batch_fast(["\n".join(part)], add_special_tokens=False)
            ids = np.array(line.ids, "<u4")
            ends = [*(np.flatnonzero(ids == self.line_end) * 4).tolist(), len(ids) * 4]
            starts, raw = [0, *[e + 4 for e in ends[:-1]]], ids.tobytes()
            found.update(zip(part, [raw[s:e] for s, e in zip(starts, ends, strict=True)], strict=True))
        found.update((c, array("I", x.ids).tobytes()) for c, x in zip(odd, self.library.encode_batch_fast(odd, add_special_tokens=False), strict=True))
        if 2 * len(self.known) > REMEMBERED:
            self.older, self.known = self.known, {}
        self.known.update([x for x in found.items() if len(x[0]) <= LONGEST])
        return found

    def of_model(self, pieces: pa.Array) -> pa.Array:
        """Ids of pieces from the library's model, many in one call; tokens are told apart by the bytes that they stand for."""
        found = [pa.array([], pa.large_binary())]
        for run in runs(pieces, CALL):
            part = pieces.slice(*run)
            raw = np.frombuffer(b"\n".join(part.to_pylist()), np.uint8)
            (line,) = self.pieces.encode_batch_fast([NAMES[raw].tobytes().decode("utf-32-le")], add_special_tokens=False)
            ids = np.array(line.ids, "<u4")
            after, ends = np.cumsum(self.widths[ids]), parts(part)[0][1:]
            at = np.searchsorted(after, ends)
            if at[-1] + 1 != len(ids) or (after[at] != ends).any():
                raise ValueError("tokens do not end where their pieces end")
            found.append(column(np.append(0, (at + 1) * 4), ids))
        return pa.concat_arrays(found)

    def of_simple(self, pieces: pa.Array) -> pa.Array:
        """Ids of distinct pieces of simple chunks: those that are known, and the others from the model."""
        known, known_ids = self.pieces_known
        at = pc.index_in(pieces, value_set=known)
        missing = pc.is_null(at)
        new = pieces.filter(missing)
        new_ids, missing = self.of_model(new), missing.to_numpy(zero_copy_only=False)
        at = at.fill_null(0).to_numpy().astype(np.int64)
        at[missing] = len(known) + np.arange(len(new))
        known, known_ids = pa.concat_arrays([known, new]), pa.concat_arrays([known_ids, new_ids])
        found = known_ids.take(pa.array(at))
        if len(known) > REMEMBERED:  # the memory starts anew with what this step has
            known, known_ids = pieces, found
        short = pc.less_equal(pc.binary_length(known), LONGEST)
        self.pieces_known = (known, known_ids) if pc.all(short).as_py() else (known.filter(short), known_ids.filter(short))
        return found

    def of_odd(self, chunks: pa.Array) -> pa.Array:
        """Ids of chunks that are not simple."""
        found = [pa.array([], pa.large_binary())]
        for run in runs(chunks, CALL):
            texts = chunks.slice(*run).cast(pa.large_string()).to_pylist()
            ids = list(map(self.known.get, texts))
            if None in ids:
                new = self.learn({c for c, x in zip(texts, ids, strict=True) if x is None})
                ids = [new[c] if x is None else x for c, x in zip(texts, ids, strict=True)]
            found.append(pa.array(ids, pa.large_binary()))
        return pa.concat_arrays(found)

    def of_chunks(self, chunks: pa.Array) -> pa.Array:
        """Ids of distinct chunks, as bytes; the empty chunk has none."""
        bounds, data = parts(chunks)
        start = np.flatnonzero((data & 0xC0) != 0x80)  # of each character
        code = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), "<u4")
        kind = KINDS[np.minimum(code, 0xFFFF)] if self.by_piece else np.zeros(len(code), np.uint8)
        first = np.searchsorted(start, bounds)  # the first character of each chunk
        opens = np.zeros(len(code) + 1, bool)
        opens[first] = True
        wrong = (kind == 0) | ((kind == SPACE) & (~opens[:-1] | opens[1:]))
        pair = ((code[:-1] == 39) & (kind[1:] == LETTER)) | ((code[:-1] == 60) & (code[1:] == 124))  # may be 's, or <|
        wrong[:-1] |= pair & ~opens[1:-1]
        odd = np.unique(np.searchsorted(first, np.flatnonzero(wrong), "right") - 1)
        within = np.zeros(len(code) + 1, np.int8)
        within[first[odd]] += 1
        within[first[odd + 1]] -= 1
        cut = opens[:-1].copy()
        cut[1:] |= (kind[1:] != kind[:-1]) & (kind[:-1] != SPACE) & (np.cumsum(within, dtype=np.int8)[1:-1] == 0)
        at = np.flatnonzero(cut)
        pieces = column(np.append(start[at], len(data)), data).dictionary_encode()
        codes, distinct, at = pieces.indices.to_numpy(), pieces.dictionary, np.searchsorted(at, first)
        whole, simple = codes[at[odd]], np.ones(len(distinct), bool)
        simple[whole] = False
        place = np.cumsum(simple) - 1
        place[whole] = int(simple.sum()) + np.arange(len(whole))
        ids = pa.concat_arrays([self.of_simple(distinct.filter(pa.array(simple))), self.of_odd(distinct.take(pa.array(whole)))])
        offsets, raw = parts(ids.take(pa.array(place[codes])))
        return column(offsets[at], raw)

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Each text's ids and the end id."""
        ends, data = parts(texts.cast(pa.large_string()))
        coded = column(units(data, ends[1:]), data).dictionary_encode()
        codes, chunks = coded.indices.to_numpy().copy(), coded.dictionary
        last = np.flatnonzero(parts(chunks)[0][1:][codes] == parts(chunks)[0][:-1][codes])
        codes[last] = len(chunks)
        ids = pa.concat_arrays([self.of_chunks(chunks), pa.array([END_ID.to_bytes(4, "little")], pa.large_binary())])
        offsets, raw = parts(ids.take(pa.array(codes)))
        ids, at = raw.view("<u4"), [0, *(offsets[last + 1] // 4).tolist()]
        return [ids[s:e] for s, e in zip(at[:-1], at[1:], strict=True)]


_encoders: dict[str, ChunkEncoder] = held(__name__)


def encoder(path: str) -> ChunkEncoder:
    if path not in _encoders:
        _encoders[path] = ChunkEncoder(path)
    return _encoders[path]


def alternate(at: np.ndarray) -> np.ndarray:
    """Which of the places that may be replaced are: each but those right after a replaced one, the first, third... of every run."""
    new = np.ones(len(at), bool)
    new[1:] = at[1:] - at[:-1] != 1
    first = at[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
    return (at - first) % 2 == 0


SLOT_BITS = 20


def slots(pairs: np.ndarray) -> np.ndarray:
    return (pairs.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOT_BITS)


def compress(ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rules, their expansion lengths, the symbols left, and the places after each document among them.

    Each round replaces up to ``PER_ROUND`` of the most frequent pairs at once, left to right; rounds go on
    until no pair occurs ``LEAST_COUNT`` times. Every round replaces some place, so they end.
    """
    symbols, last = ids.astype(np.int32), np.zeros(len(ids), bool)
    last[ends - 1] = True
    rules, lengths, n_rules = [np.zeros((0, 2), np.int64)], np.ones(FIRST_RULE, np.int64), 0
    where = None  # the places of pairs that are not known to be rare; none given: all
    while len(symbols) > 1:
        if where is None:
            pairs = symbols[:-1].astype(np.int64) << 32 | symbols[1:]
            pairs[last[:-1]] = -1
        else:
            pairs = symbols[where].astype(np.int64) << 32 | symbols[where + 1]
            pairs[last[where]] = -1
        ordered = np.sort(pairs)
        cut = np.flatnonzero(ordered[1:] != ordered[:-1]) + 1
        cut = np.concatenate([[0], cut]) if len(ordered) else cut
        counts = np.diff(np.append(cut, len(ordered)))
        often = np.flatnonzero(counts >= LEAST_COUNT)
        often = often[ordered[cut[often]] >= 0]
        wait = len(often) > PER_ROUND
        if wait:
            often = often[np.argpartition(-counts[often], PER_ROUND)[:PER_ROUND]]
        chosen = np.sort(ordered[cut[often]])
        if not len(chosen):
            break
        slot = np.zeros(1 << SLOT_BITS, np.uint16)  # of two pairs that share a slot, one waits for a later round
        own = slots(chosen)
        slot[own] = np.arange(len(chosen))
        wait |= bool((slot[own] != np.arange(len(chosen))).any())
        place = slot[slots(pairs)]
        hit = np.flatnonzero(chosen[place] == pairs)
        at = hit if where is None else where[hit]
        taken = alternate(at)
        at, place = at[taken], place[hit[taken]]
        here = np.bincount(place, minlength=len(chosen)) > 0
        used, which = np.flatnonzero(here), (np.cumsum(here) - 1)[place]
        made = np.stack([chosen[used] >> 32, chosen[used] & 0xFFFFFFFF], 1)
        symbols[at] = FIRST_RULE + n_rules + which
        last[at] = last[at + 1]
        keep = np.ones(len(symbols), bool)
        keep[at + 1] = False
        symbols, last = symbols[keep], last[keep]
        if wait:
            where = None
        else:  # pairs without a symbol of this round are rare
            at = at - np.arange(len(at))
            where = np.unique(np.concatenate([at - 1, at]))
            where = where[(where >= 0) & (where < len(symbols) - 1)]
        rules.append(made)
        n_rules += len(made)
        lengths = np.concatenate([lengths, lengths[made[:, 0]] + lengths[made[:, 1]]])
    return np.concatenate(rules).astype("<u4"), lengths[FIRST_RULE:].astype("<u4"), symbols.astype("<u4"), np.flatnonzero(last) + 1


def expand(symbols: np.ndarray, rules: np.ndarray) -> np.ndarray:
    """The ids that symbols stand for."""
    symbols = symbols.astype(np.int64)
    while len(at := np.flatnonzero(symbols >= FIRST_RULE)):
        double = np.ones(len(symbols), np.int64)
        double[at] = 2
        where = np.cumsum(double) - double
        out = np.empty(int(double.sum()), np.int64)
        out[where] = symbols
        out[where[at]], out[where[at] + 1] = rules[symbols[at] - FIRST_RULE].T
        symbols = out
    return symbols.astype("<u4")


def expand_by_lengths(symbols: np.ndarray, rules: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The ids that many symbols of one block stand for: each rule is expanded once, its ids are copied to where it stands."""
    table = np.concatenate([np.arange(FIRST_RULE, dtype="<u4"), expand(np.arange(FIRST_RULE, FIRST_RULE + len(rules)), rules)])
    width = np.concatenate([np.ones(FIRST_RULE, np.int64), lengths.astype(np.int64)])
    first, width = (np.cumsum(width) - width)[symbols], width[symbols]
    after = np.cumsum(width)
    where = np.repeat(first - after + width, width)
    where += np.arange(len(where))
    return table[where]


def stretch(symbols: np.ndarray, rules: np.ndarray, lengths: np.ndarray, start: int, stop: int) -> np.ndarray:
    """Ids start to stop of what symbols stand for; only the symbols that hold them are expanded."""
    width = np.ones(len(symbols), np.int64)
    rule = symbols >= FIRST_RULE
    width[rule] = lengths[symbols[rule].astype(np.int64) - FIRST_RULE]
    after = np.cumsum(width)
    first, last = np.searchsorted(after, start, "right"), np.searchsorted(after, stop, "left")
    skipped = after[first] - width[first] if first < len(after) else 0
    return expand(symbols[first : last + 1], rules)[start - skipped : stop - skipped]


BLOCKS = (
    "first_id long, part int, block long, n_docs long, n_ids long, no_ids long, doc_ids binary, doc_at binary, doc_ids_before binary, "
    "rules binary, lengths binary, symbols binary"
)


def block_row(part: int, number: int, doc_ids: list[int | None], docs: list[np.ndarray]) -> tuple:
    ids = np.concatenate(docs)
    ends = np.cumsum([len(x) for x in docs])
    rules, lengths, symbols, after = compress(ids, ends)
    at = np.concatenate([[0], after[:-1]]).astype("<u4")
    before = np.concatenate([[0], ends[:-1]]).astype("<u4")
    own = np.array([0 if x is None else x for x in doc_ids], "<i8")
    arrays = (own, at, before, rules, lengths, symbols)
    return (doc_ids[0], part, number, len(docs), len(ids), doc_ids.count(None), *[x.tobytes() for x in arrays])


def block_batch(row: tuple) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 4, *[pa.binary()] * 6]
    names = [x.split()[0] for x in BLOCKS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=names)


def steps(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in slices that hold STEP bytes of texts at most, or one text."""
    for first, n in runs(batch.column(1), STEP):
        yield batch.slice(first, n)


def write(docs: DataFrame, tokenizer_path: str, path: str) -> None:
    """Encodes docs and writes the blocks to path."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, number, held = encoder(tokenizer_path).encode, TaskContext.get().partitionId(), 0, 0
        doc_ids, ids = [], []
        for b in batches:
            for rows in steps(b):
                for doc_id, x in zip(rows.column(0).to_pylist(), encode(rows.column(1)), strict=True):
                    doc_ids.append(doc_id)
                    ids.append(x)
                    held += len(x)
                    if held >= BLOCK_IDS:
                        yield block_batch(block_row(part, number, doc_ids, ids))
                        doc_ids, ids, number, held = [], [], number + 1, 0
        if ids:
            yield block_batch(block_row(part, number, doc_ids, ids))

    # texts of one doc_id are told apart, so that repeated ids neither meet in one range nor change places
    order = (F.col("doc_id"), F.xxhash64("text"))
    ranged = docs.select("doc_id", "text").repartitionByRange(*order).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    blocks = text_pass(ranged, BLOCKS, work, "doc_id", "text")
    blocks.write.option("compression", "zstd").option("parquet.block.size", str(16 << 20)).parquet(path)


class Block:
    """A block that was read: random access to its documents."""

    def __init__(self, row: dict):
        get = lambda name, kind: np.frombuffer(row[name], kind)
        self.doc_ids, self.no_ids = get("doc_ids", "<i8"), row["no_ids"]
        self.at = np.append(get("doc_at", "<u4"), len(row["symbols"]) // 4).astype(np.int64)
        self.before = np.append(get("doc_ids_before", "<u4"), row["n_ids"]).astype(np.int64)
        self.rules, self.lengths = get("rules", "<u4").reshape(-1, 2).astype(np.int64), get("lengths", "<u4")
        self.symbols = get("symbols", "<u4")

    def document(self, k: int, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Ids of the k-th document of the block, or a stretch of them."""
        own = self.symbols[self.at[k] : self.at[k + 1]]
        stop = int(self.before[k + 1] - self.before[k]) if stop is None else stop
        return stretch(own, self.rules, self.lengths, start, stop)

    def all_ids(self) -> np.ndarray:
        return expand_by_lengths(self.symbols, self.rules, self.lengths)


def read_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["part", "block", "doc_id", "place", "n_tokens", "ids_crc32"]
    for b in batches:
        for i in range(b.num_rows):
            row = b.slice(i, 1).to_pylist()[0]
            block = Block(row)
            ids, n = block.all_ids(), len(block.doc_ids)
            crc = [zlib.crc32(ids[s:e].data) for s, e in zip(block.before[:-1], block.before[1:], strict=True)]
            cols = [
                pa.array([row["part"]] * n, pa.int32()),
                pa.array([row["block"]] * n, pa.int64()),
                pa.array(block.doc_ids, pa.int64(), mask=np.arange(n) < block.no_ids),
                pa.array(block.before[:-1], pa.int64()),
                pa.array(np.diff(block.before), pa.int64()),
                pa.array(crc, pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(cols, names=names)


def digests(spark: SparkSession, path: str) -> DataFrame:
    """From the files alone: doc_id, start (ids of all documents before it), n_tokens and ids_crc32.

    A block starts where those of its part before it end, and a part where the parts before it end. The
    first comes from a window over the blocks of each part; the second from one row per part, which is
    one per task that wrote, on the driver.
    """
    blocks = spark.read.schema(BLOCKS).parquet(path)
    sizes = blocks.select("part", "block", "n_ids")
    total, parts = 0, []
    for r in sizes.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect():
        parts.append((r.part, total))
        total += r.n
    before = F.sum("n_ids").over(Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.withColumn("in_part", F.coalesce(before, F.lit(0))).join(
        F.broadcast(spark.createDataFrame(parts, "part int, of_part long")), "part"
    )
    starts = starts.select("part", "block", (F.col("in_part") + F.col("of_part")).alias("of_block"))
    found = arrow_pass(blocks, "part int, block long, doc_id long, place long, n_tokens long, ids_crc32 long", read_batches)
    return found.join(starts, ["part", "block"]).select(
        "doc_id", (F.col("of_block") + F.col("place")).alias("start"), "n_tokens", "ids_crc32"
    )


def fresh_path(spark: SparkSession) -> str:
    return f"{scratch_folder(spark)}/token-files-{uuid.uuid4().hex}"
