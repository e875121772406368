"""Exact n-gram Jaccard self-join by vertical partitioning, and the components of its links.

A document's set is its distinct word n-grams as 64-bit hashes; the hashes' order is the global n-gram
order. Equal sets are one set from the start, so exact copies cost a row each.

*Candidates.* The order is cut into m fragments. Sets of at most ``hi`` elements that are similar enough
differ in at most k elements, so they differ in k fragments at most. m follows from the size class of a
pair's larger set; a set also takes part in the next class where a larger partner may be. A set that has
more than k fragments of ``FULL`` elements or more agrees with each similar set on one of these, so such
fragments are its signatures; one that has too few of them leaves signatures of smaller fragments too.
N-grams that very many documents have, a common passage or line, are left out first: what remains of similar
sets still differs in at most k elements. Sets that hold too little else also leave signatures of all their
elements, of empty fragments too where it must be. A set with g such fragments agrees with each similar set on g - k
of them, so signatures of a set of which it shares fewer than that with others are dropped, again and again.

*Overlaps.* Candidate pairs are compared by vertical partitioning: both sets are cut at the same places of
the n-gram order, partial overlaps are counted for each fragment and pair by itself, wherever the shuffle puts
the fragment, and summed up per pair. A set with many partners is dealt out in blocks of them.

*Linear in the rows of signatures.* Each signature ties the sets that have it to one of them, its hub. First
every set is compared with the hub that it shares most signatures with, then with the ``HUBS`` first ones of these that are not in
its component yet. Only signatures whose sets still belong to several components need more. Where ``FEW`` sets or
fewer have one, each is compared with those of other components. Sets tied by larger ones form families; of a
family, the sets outside its largest component are compared with all its sets, block by block: the membership matrix of
a fragment times that of another block adds the partial overlaps of every pair to the sums of the other fragments, and
of the links that a piece of this work finds it returns a spanning forest. Which way compares a pair changes cost, not
results. Very many copies of one text thus cost a comparison or a few each; what does grow with pairs are
different texts that share fragments without being linked: they have to be told apart one by one.

*Disk.* What is at once in shuffles is a fraction of all that goes through them: overlaps are counted in RANGES parts of the n-gram order, one
after the other, each for so many pairs that their sets are at most twice the bytes of all sets that are looked up. ``one_of_each``, which keeps the
texts a second time, also makes signatures and looks up texts of needed sets in PASSES parts, for which all texts are hashed again. Small tables go in one part.

All shuffles are keyed by signature, set, pair or document; none by a word, source or passage.

Defined cases: a null, empty or blank text has the empty set and is linked with nothing; a text with fewer
than n words has its whole word sequence as its only n-gram; rows that repeat are linked with each other;
rows that share a doc_id with different texts share its component only by links; a row with a null doc_id links
others like any row, and its component_id is null where no row of its component has a doc_id; an empty table
gives no rows. ``one_of_each`` goes by rows and not by
doc_ids: a row with a null doc_id is linked like any other and stays if its component has no other row or only
such rows, and of rows that share a doc_id, repeated ones included, one stays for each component. Rows with the
empty set all stay.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyshelf.llm.common import arrow_pass, forget, keep, keeps, passing, pieces, text_pass, utf8
from tallyshelf.llm.components import components

#: Elements of a fragment that says enough by itself, and partners of a set that are compared in one place.
FULL, PARTNERS = 2, 256
#: Hubs of a set that are compared with it by themselves; the others share a signature with it and are found through that.
HUBS = 8
#: The most sets of a signature that are compared one by one; sets and elements of a block; columns that are multiplied at once.
FEW, BLOCK_SETS, BLOCK_ELEMENTS, COLUMNS = 16, 512, 500_000, 2048
#: The bit of a signature's kind from which on it says how many must be shared.
NEED_AT = 10
#: Rarer signatures of a set that come with each one.
RARER = 10
#: Into how many fragments compared sets are cut at least, and the elements of the first set that make one more.
LEAST_FRAGMENTS, FRAGMENT_ELEMENTS = 4, 4096
#: Into how many parts signatures, texts of needed sets and compared elements are divided, and up to how many bytes of elements they are not.
PASSES, RANGES, UNDIVIDED = 2, 3, 1 << 26
#: N-grams in this many of up to AT_ONCE documents of a task are reported as common; the most frequent
#: MOST_COMMON of all reports are left out of signatures. Which n-grams these are changes cost, not results.
COMMON_IN, AT_ONCE, MOST_COMMON = 4, 2000, 1 << 17
#: Upper bounds of size classes grow by this factor, which must be at least 100 / percent.
CLASS_GROWTH = 1.3
#: Bytes of texts whose words are hashed at once; a longer word is hashed by itself.
BLOCK = 1 << 16
P1, P2, P3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
S30, S27, S31, S32 = np.uint64(30), np.uint64(27), np.uint64(31), np.uint64(32)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose every output bit depends on every input bit."""
    x = (x ^ (x >> S30)) * P2
    x = (x ^ (x >> S27)) * P3
    return x ^ (x >> S31)


#: Where words end, and 64-bit numbers for bytes; the powers of P1 and of its inverse by which words' bytes are told apart by place.
GAPS = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
LETTERS = mix(np.arange(1, 257, dtype=np.uint64) * P3)
POWERS, INVERSES = (np.cumprod(np.array([1, *[p] * (BLOCK - 1)], np.uint64)) for p in (int(P1), pow(int(P1), -1, 1 << 64)))


def word_spans(held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of a text, given as its bytes, begin and end."""
    ends = np.flatnonzero(np.diff(GAPS[held], prepend=True, append=True))
    return ends[::2], ends[1::2]


def word_hashes(text: bytes, spans: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of a text begin, and 64-bit hashes of them, which depend on a word's bytes alone.

    A hash is the sum of the bytes' numbers times powers of P1, the difference of two running sums of a block,
    brought back to the word's first place.
    """
    held = np.frombuffer(text, np.uint8)
    starts, ends = word_spans(held) if spans is None else spans
    out, i = np.empty(len(starts), np.uint64), 0
    while i < len(starts):
        at = starts[i]
        j = int(np.searchsorted(ends, at + BLOCK, "right"))
        if i == j:
            out[i] = xxhash.xxh3_64_intdigest(text[at : ends[i]])
            i += 1
            continue
        block = LETTERS[held[at : ends[j - 1]]]
        sums = np.zeros(len(block) + 1, np.uint64)
        np.cumsum(block * POWERS[: len(block)], out=sums[1:])
        out[i:j] = (sums[ends[i:j] - at] - sums[starts[i:j] - at]) * INVERSES[starts[i:j] - at]
        i = j
    return starts, mix(out)


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-grams that begin at each word, as far as there are n words."""
    h = np.full(max(len(words) - n + 1, 0), n, np.uint64)
    for i in range(n):
        h = h * P1 + words[i : i + len(h)]
    return mix(h)


def sorted_set(values: np.ndarray) -> np.ndarray:
    ordered = np.sort(values)
    first = np.ones(len(ordered), bool)
    np.not_equal(ordered[1:], ordered[:-1], out=first[1:])
    return ordered[first]


def ngram_sets(texts: list[bytes], n: int) -> Iterator[np.ndarray]:
    """Of every text the sorted distinct n-gram hashes of its words, with A-Z lower-cased; short texts are hashed together."""
    i = 0
    while i < len(texts):
        size, j = len(texts[i]), i + 1
        while j < len(texts) and size + len(texts[j]) < BLOCK:
            size, j = size + len(texts[j]) + 1, j + 1
        starts, words = word_hashes(b"\n".join(texts[i:j]).lower())  # of bytes: touches ASCII only
        grams = ngram_hashes(words, n)
        at = np.searchsorted(starts, np.cumsum([0, *[len(t) + 1 for t in texts[i:j]]])).tolist()
        for s, e in zip(at, at[1:], strict=False):
            own = grams[s : e - n + 1] if e - s >= n else ngram_hashes(words[s:e], max(e - s, 1))
            yield sorted_set(own)
        i = j


class Classes:
    """Size classes with their fragments, for a similarity of percent / 100 or more."""

    def __init__(self, percent: int):
        self.percent, self.bounds = percent, [1]

    def of(self, size: int) -> int:
        while self.bounds[-1] < size:
            self.bounds.append(max(self.bounds[-1] + 1, int(self.bounds[-1] * CLASS_GROWTH)))
        return int(np.searchsorted(self.bounds, size))

    def differing(self, number: int) -> int:
        """k: how many elements similar sets of this class differ in at most."""
        most = 2 * self.bounds[number]
        return most * (100 - self.percent) // (100 + self.percent)

    def fragments(self, number: int) -> int:
        """m: twice as many as can differ, so that most sets have many more than k full ones."""
        return 2 * self.differing(number)

    def joined_by(self, size: int) -> list[int]:
        """The classes in which a set of this size may have partners that are no smaller."""
        own = self.of(size)
        return list(range(own, self.of(max(size, size * 100 // self.percent)) + 1))


def fragment_marks(elements: np.ndarray, m: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The fragments that hold elements, a number for what each holds, and how many elements that is."""
    if not len(elements):
        return elements, elements, np.zeros(0, np.int64)
    part = ((elements >> S32) * np.uint64(m)) >> S32
    first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
    sums = np.add.reduceat(mix(elements + P1), first)
    marks = mix(sums ^ mix(part[first] * P1 + np.uint64(seed)))
    return part[first], marks, np.diff(np.append(first, len(elements)))


def level(held: np.ndarray, k: int) -> int:
    """The largest size, FULL at most, that more than k fragments have; 0 if not even one element."""
    return next((t for t in range(FULL, 0, -1) if (held >= t).sum() > k), 0)


def kind_of(number: int, whole: int, enough: int, spare: int) -> int:
    """A size class, whether all elements or the rare ones were cut, and how many of a set's signatures of this kind a similar set has.

    That is the number of signatures that cannot all differ, where they are full fragments, which every similar set leaves;
    a set of a lower level may have a partner that leaves its full ones only.
    """
    return (spare if enough == FULL else 1) << NEED_AT | number << 1 | whole


def signatures(elements: np.ndarray, rare: np.ndarray, classes: Classes) -> tuple[np.ndarray, np.ndarray]:
    """The signatures of a set and their kinds."""
    out, kinds = [np.zeros(0, np.uint64)], [0]
    for number in classes.joined_by(len(elements)):
        m, k = classes.fragments(number), classes.differing(number)
        if k == 0:
            continue  # sets that do not differ are one set
        _, marks, held = fragment_marks(rare, m, 4 * number)
        enough = level(held, k)
        out.append(marks[held >= enough])
        kinds.append(kind_of(number, 0, enough, len(out[-1]) - k))
        if enough:
            continue  # a similar set holds one of these fragments and leaves it too, as it is at this level or below
        where, marks, held = fragment_marks(elements, m, 4 * number + 1)
        enough = level(held, k)
        marks = marks[held >= enough]
        if not enough:
            empty = np.setdiff1d(np.arange(m, dtype=np.uint64), where)
            marks = np.concatenate([marks, mix(mix(empty * P1 + np.uint64(4 * number + 2)) + P3)])
        out.append(marks)
        kinds.append(kind_of(number, 1, enough, len(marks) - k))
    return np.concatenate(out), np.repeat(np.array(kinds, np.int32), [len(x) for x in out])


def without(elements: np.ndarray, common: np.ndarray) -> np.ndarray:
    if not len(common) or not len(elements):
        return elements
    place = np.minimum(np.searchsorted(common, elements), len(common) - 1)
    return elements[common[place] != elements]


def often(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Elements of COMMON_IN or more of the sets, with the number of sets."""
    ordered = np.sort(np.concatenate(sets)) if sets else np.zeros(0, np.uint64)
    if not len(ordered):
        return ordered, np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    count = np.diff(np.append(first, len(ordered)))
    return ordered[first[count >= COMMON_IN]], count[count >= COMMON_IN]


def key_of(elements: np.ndarray) -> bytes:
    return hashlib.blake2b(elements.tobytes(), digest_size=16).digest()


def short_key(key: bytes) -> int:
    """What signatures call a set by; sets that share it by chance only end in one family."""
    return int.from_bytes(key[:8], "little", signed=True)


SET_ROWS = "doc_id long, text_hash long, n_shingles long, key binary, key64 long, common long, n_sets long"


def set_rows(docs: DataFrame, n: int) -> DataFrame:
    """Of every row of docs: doc_id, its text's hash, n_shingles, the 128-bit key of its set (null if that is empty) and its short form.

    Further rows, with n_shingles null, report common n-grams and the number of sets that a task saw them in.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, AT_ONCE):
                part = b.slice(i, AT_ONCE)
                sets = list(ngram_sets(utf8(part.column(2)), n))
                keys = [key_of(s) if len(s) else None for s in sets]
                distinct = dict(zip(keys, sets, strict=True))
                distinct.pop(None, None)
                common, seen = often(list(distinct.values()))
                none, more = [None] * len(common), [None] * len(sets)
                cols = [
                    pa.array(part.column(0).to_pylist() + none, pa.int64()),
                    pa.array(part.column(1).to_pylist() + none, pa.int64()),
                    pa.array([len(s) for s in sets] + none, pa.int64()),
                    pa.array(keys + none, pa.binary()),
                    pa.array([None if k is None else short_key(k) for k in keys] + none, pa.int64()),
                    pa.array(more + common.view(np.int64).tolist(), pa.int64()),
                    pa.array(more + seen.tolist(), pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(cols, names=[c.split()[0] for c in SET_ROWS.split(", ")])

    return text_pass(docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text"), SET_ROWS, work, "doc_id", "text_hash", "text")


def common_ngrams(rows: DataFrame) -> np.ndarray:
    """At most MOST_COMMON of the n-grams reported as common, in order."""
    total = rows.where("n_shingles is null").groupBy("common").agg(F.sum("n_sets").alias("n"))
    found = total.orderBy(F.desc("n"), "common").limit(MOST_COMMON).select("common").toPandas()["common"].to_numpy(np.int64)
    return np.sort(found.view(np.uint64))


def signature_rows(docs: DataFrame, n: int, percent: int, common: np.ndarray, part: int = 0, parts: int = 1) -> DataFrame:
    """sig, kind and key64 of every set, for the signatures of one of so many parts; a task names equal sets once."""
    sent = docs.sparkSession.sparkContext.broadcast(common)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, done = Classes(percent), set()
        for b in batches:
            for i in range(0, b.num_rows, 500):
                sigs, kinds, keys = [], [], []
                for s in ngram_sets(utf8(b.column(0).slice(i, 500)), n):
                    key = short_key(key_of(s))
                    if len(s) and key not in done:
                        done.add(key)
                        own, kind = signatures(s, without(s, sent.value), classes)
                        here = own % np.uint64(parts) == part
                        sigs.append(own[here])
                        kinds.append(kind[here])
                        keys.append(key)
                if sigs:
                    key64 = np.repeat(np.array(keys, np.int64), [len(x) for x in sigs])
                    cols = [pa.array(np.concatenate(sigs).view(np.int64)), pa.array(np.concatenate(kinds)), pa.array(key64)]
                    yield pa.RecordBatch.from_arrays(cols, names=["sig", "kind", "key64"])

    return text_pass(docs, "sig long, kind int, key64 long", work, "text")


def shared_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by sig and key64, those whose sig has several; the same row may stay several times."""
    last: list[np.ndarray] = []
    for b in batches:
        cols = [b.column(i).to_numpy() for i in range(3)]
        if last:
            cols = [np.concatenate(x) for x in zip(last, cols, strict=True)]
        if not len(cols[0]):
            continue
        same = cols[0][1:] == cols[0][:-1]
        same[same] = cols[2][1:][same] != cols[2][:-1][same]  # equal sets that several tasks name do not count
        near = np.append(same, False)
        near[1:] |= same
        last = [x[-1:] for x in cols]
        if near.any():
            yield pa.RecordBatch.from_arrays([pa.array(x[near]) for x in cols], names=["sig", "kind", "key64"])


def plausible(rows: DataFrame) -> DataFrame:
    """The rows (sig, kind, sid...) of sets that have as many of a kind as similar sets share at least."""
    enough = rows.groupBy("sid", "kind").agg(F.count(F.lit(1)).alias("n")).where(F.expr(f"n >= shiftright(kind, {NEED_AT})"))
    return rows.join(enough.select("sid", "kind"), ["sid", "kind"], "left_semi")


def of_several(rows: DataFrame, what: str) -> DataFrame:
    """The rows whose signature has more than one value of what."""
    several = rows.groupBy("sig").agg(F.min(what).alias("low"), F.max(what).alias("high")).where("low <> high").select("sig")
    return rows.join(several, "sig", "left_semi")


def united(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def thinned(parts: Iterator[DataFrame], what: str) -> DataFrame:
    """Of all parts the rows without those that cannot tie similar sets with different values of what, as far as that is worth a pass.

    No two parts have a signature in common. Each part and pass is written and the table before it removed.
    """
    tables = []
    for part in parts:
        first = keep(part, "signatures")
        tables.append(keep(of_several(first, what), "signatures"))
        forget(first)
    before, left = None, united(tables).count()
    while left and (before is None or left < 0.9 * before):
        fewer = keep(of_several(plausible(united(tables)), what), "signatures")
        for old in tables:
            forget(old)
        tables, before, left = [fewer], left, fewer.count()
    for empty in tables[1:]:
        forget(empty)
    return tables[0]


def rarest(rows: DataFrame) -> DataFrame:
    """The rows that suffice to find every similar pair: of each kind a set goes without its most frequent signatures.

    Similar sets share as many signatures as their kinds say. The rarest of these, in one order of all signatures, is
    not among the so many less one most frequent ones of either set.
    """
    often = rows.groupBy("sig").agg(F.count(F.lit(1)).alias("times"))
    place = F.row_number().over(Window.partitionBy("sid", "kind").orderBy(F.desc("times"), F.desc("sig")))
    ranked = rows.join(often, "sig").withColumn("place", place)
    return ranked.where(F.expr(f"place >= shiftright(kind, {NEED_AT})")).drop("times", "place")


def shared_signatures(docs: DataFrame, n: int, percent: int, common: np.ndarray, distinct: DataFrame, parts: int) -> DataFrame:
    """sig, kind, sid and size: the sets of every signature that several have. Sets are hashed anew for each part of the signatures."""

    def of_part(part: int) -> DataFrame:
        rows = signature_rows(docs, n, percent, common, part, parts).repartition("sig").sortWithinPartitions("sig", "key64", "kind")
        shared = arrow_pass(rows, "sig long, kind int, key64 long", shared_batches)
        return shared.join(distinct.select("key64", "sid", "size"), "key64").select("sig", "kind", "sid", "size")

    return thinned((of_part(i) for i in range(parts)), "sid")


def element_rows(docs: DataFrame, n: int, needed: DataFrame, parts: int) -> DataFrame:
    """sid and elements of the sets that are needed, from one document of each; so many parts of the documents are looked up one by one."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 500):
                part = b.slice(i, 500)
                sets = list(ngram_sets(utf8(part.column(3)), n))
                right = pa.array([key_of(s) == k for s, k in zip(sets, part.column(2).to_pylist(), strict=True)], pa.bool_())
                cols = [part.column(0), part.column(1), pa.array([s.astype("<u8").tobytes() for s in sets], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["sid", "n_rows", "elements"]).filter(right)

    rows = docs.select(F.col("doc_id").alias("of"), F.xxhash64("text").alias("of_hash"), "text")
    # what is needed grows with the documents, so it is never broadcast: the plan is the same at every size
    tables = []
    for part in range(parts):
        ours = lambda *c: F.pmod(F.xxhash64(*c), F.lit(parts)) == part  # noqa: B023, E731
        some, of = rows.where(ours("of", "of_hash")), needed.where(ours("rep", "rep_hash")).hint("merge")
        both = some.join(of, some["of"].eqNullSafe(of["rep"]) & (some["of_hash"] == of["rep_hash"]))
        tables.append(keep(text_pass(both, "sid long, n_rows long, elements binary", work, "sid", "n_rows", "key", "text"), "elements"))
    found = united(tables)
    once = found.where("n_rows = 1").select("sid", "elements")
    # a set with several rows may come from rows that are the same throughout
    return once.unionByName(found.where("n_rows > 1").groupBy("sid").agg(F.first("elements").alias("elements")))


CUT = "u long, su long, block int, fragment int, v long, sv long, part binary"


def cut_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows (u, su, block, v, sv, elements) one for each fragment: the elements that lie in it."""
    for b in pieces(batches):
        columns: list[list] = [[] for _ in range(7)]
        for u, su, block, v, sv, raw in zip(*[b.column(i).to_pylist() for i in range(6)], strict=True):
            m = LEAST_FRAGMENTS + su // FRAGMENT_ELEMENTS
            elements = np.frombuffer(raw, "<u8")
            cuts = np.array([(i << 64) // m for i in range(1, m)], np.uint64)
            at = [0, *(8 * np.searchsorted(elements, cuts)).tolist(), len(raw)]
            for i, (s, e) in enumerate(zip(at, at[1:], strict=False)):
                if s < e:
                    for c, x in zip(columns, (u, su, block, i, v, sv, raw[s:e]), strict=True):
                        c.append(x)
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in CUT.split(", ")])


def partial_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows of CUT, each u's own part before its partners': the partial overlaps of a fragment's pairs."""
    at, own = None, np.zeros(0, "<u8")
    for b in pieces(batches):
        found: list[tuple] = []
        for u, su, block, i, v, sv, raw in zip(*[b.column(i).to_pylist() for i in range(7)], strict=True):
            if (u, block, i) != at:
                at, own = (u, block, i), np.zeros(0, "<u8")
            part = np.frombuffer(raw, "<u8")
            if v is None:
                own = part
            elif len(own):
                n = int((own[np.minimum(np.searchsorted(own, part), len(own) - 1)] == part).sum())
                if n:
                    found.append((u, su, v, sv, n))
        columns = list(zip(*found, strict=True)) if found else [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["u", "su", "v", "sv", "n"])


def asked(dealt: DataFrame) -> DataFrame:
    """The sets (sid) whose elements pairs dealt out in blocks need: each v with its pair, and u once for each block, with a null v."""
    partners = dealt.select(F.col("v").alias("sid"), "u", "su", "block", "v", "sv")
    none = F.lit(None).cast("long")
    own = dealt.select("u", "su", "block").distinct().select(F.col("u").alias("sid"), "u", "su", "block", none.alias("v"), none.alias("sv"))
    return partners.unionByName(own)


def in_range(elements: DataFrame, i: int, ranges: int) -> DataFrame:
    """sid and elements with those that lie in the i-th of so many equal ranges of the n-gram order; no row for a set that has none there."""
    low, high = (np.uint64((k << 64) // ranges) if k < ranges else None for k in (i, i + 1))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            sids, parts = [], []
            for sid, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                x = np.frombuffer(raw, "<u8")
                s, e = np.searchsorted(x, low), len(x) if high is None else np.searchsorted(x, high)
                if s < e:
                    sids.append(sid)
                    parts.append(raw[8 * s : 8 * e])
            yield pa.RecordBatch.from_arrays([pa.array(sids, pa.int64()), pa.array(parts, pa.binary())], names=["sid", "elements"])

    return arrow_pass(elements.select("sid", "elements"), "sid long, elements binary", work)


def partial_overlaps(dealt: DataFrame, elements: DataFrame) -> DataFrame:
    """u, v, n, su and sv: how many of the elements pairs dealt out in blocks share, where that is any."""
    # the sets of both sides are looked up together: at size each join with elements sends all of them through a shuffle
    both = asked(dealt).join(elements, "sid").select("u", "su", "block", "v", "sv", "elements")
    cut = arrow_pass(both, CUT, cut_batches)
    cut = cut.repartition("u", "block", "fragment").sortWithinPartitions("u", "block", "fragment", F.col("v").asc_nulls_first())
    return summed(arrow_pass(cut, "u long, su long, v long, sv long, n long", partial_batches))


def summed(parts: DataFrame) -> DataFrame:
    return parts.groupBy("u", "v").agg(F.sum("n").alias("n"), F.first("su").alias("su"), F.first("sv").alias("sv"))


def bytes_of(elements: DataFrame) -> int:
    return elements.agg(F.sum(F.octet_length("elements"))).first()[0] or 0


def links(pairs: DataFrame, elements: DataFrame, percent: int) -> DataFrame:
    """u and v of the pairs (u, su, v, sv; sets and their sizes) that are similar enough; no pair may occur twice."""
    fit = pairs.where(100 * F.least("su", "sv") >= percent * F.greatest("su", "sv"))
    fit = keep(fit.select("u", "su", "v", "sv"), "pairs")
    many = fit.groupBy("u").agg(F.ceil(F.count(F.lit(1)) / PARTNERS).cast("int").alias("blocks"), F.sum("sv").alias("theirs"), F.first("su").alias("own"))
    sent = 8 * (many.agg(F.sum(F.col("theirs") + F.col("blocks") * F.col("own"))).first()[0] or 0)
    dealt = fit.join(many.where("blocks > 1").select("u", "blocks"), "u", "left")
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("v"), F.coalesce("blocks", F.lit(1))).cast("int"))
    similar = lambda whole: whole.where(100 * F.col("n") >= percent * (F.col("su") + F.col("sv") - F.col("n"))).select("u", "v")
    size = bytes_of(elements)
    if size + sent <= UNDIVIDED:
        return keep(similar(partial_overlaps(dealt, elements)), "links")
    found, shares = [], math.ceil(sent / max(2 * size, UNDIVIDED)) or 1
    for share in range(shares):
        some = dealt.where(F.pmod(F.xxhash64("u", "block"), F.lit(shares)) == share)
        parts = [keep(partial_overlaps(some, in_range(elements, i, RANGES)), "overlaps") for i in range(RANGES)]
        found.append(keep(similar(summed(united(parts))), "links"))
        for part in parts:
            forget(part)
    return united(found)


def overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets of a with all of b, as sums of partial overlaps by fragment."""
    sizes = [len(x) for x in a] + [len(x) for x in b]
    owner = np.repeat(np.arange(len(sizes)), sizes)
    elements = np.concatenate([*a, *b])
    order = np.argsort(elements, kind="stable")
    elements, owner = elements[order], owner[order]
    same = elements[1:] == elements[:-1]
    shared = np.concatenate([[False], same]) | np.concatenate([same, [False]])
    elements, owner = elements[shared], owner[shared]
    total = np.zeros((len(a), len(b)), np.float32)
    if not len(elements):
        return total
    column = np.cumsum(np.concatenate([[0], elements[1:] != elements[:-1]]))
    for low in range(0, int(column[-1]) + 1, COLUMNS):
        s, e = np.searchsorted(column, [low, low + COLUMNS])
        part = np.zeros((len(sizes), COLUMNS), np.float32)
        part[owner[s:e], column[s:e] - low] = 1
        total += part[: len(a)] @ part[len(a) :].T
    return total  # sums of ones below 2**24 are exact


def linked(a: list[np.ndarray], b: list[np.ndarray], percent: int) -> np.ndarray:
    size_a, size_b = np.array([len(x) for x in a])[:, None], np.array([len(x) for x in b])[None]
    both = overlaps(a, b).astype(np.int64)
    return 100 * both >= percent * (size_a + size_b - both)


def forest(link: np.ndarray, ids_a: np.ndarray, ids_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what link connects: from each node to the smallest id of its component."""
    la, lb = ids_a.copy(), ids_b.copy()
    top = np.iinfo(np.int64).max
    while True:
        na = np.minimum(la, np.where(link, lb[None], top).min(axis=1))
        nb = np.minimum(lb, np.where(link, na[:, None], top).min(axis=0))
        if (na == la).all() and (nb == lb).all():
            break
        la, lb = na, nb
    u, v = np.concatenate([ids_a, ids_b]), np.concatenate([la, lb])
    return u[u != v], v[u != v]


def block_links(members: DataFrame, elements: DataFrame, percent: int) -> DataFrame:
    """u and v that connect the sets of each family that similarity connects, from rows sid, size, label and family."""
    per_label = members.groupBy("family", "label").agg(F.count(F.lit(1)).alias("n"))
    top = per_label.groupBy("family").agg(F.max(F.struct("n", "label"))["label"].alias("top"))
    marked = keep(members.join(top, "family").select("family", "sid", "size", (F.col("label") != F.col("top")).alias("rest")), "families")
    blocks = lambda of: F.ceil(F.greatest(F.count(of) / BLOCK_SETS, F.sum(F.when(of.isNotNull(), F.col("size"))) / BLOCK_ELEMENTS)).cast("int")
    sizes = [F.sum(F.when(F.col("rest"), F.col("size"))).alias("of_rest"), F.sum("size").alias("of_all")]
    numbers = marked.groupBy("family").agg(blocks(F.when(F.col("rest"), 1)).alias("n_rest"), blocks(F.lit(1)).alias("n_all"), *sizes).where("n_rest > 0")
    sent = 8 * (numbers.agg(F.sum(F.col("of_rest") * F.col("n_all") + F.col("of_all") * F.col("n_rest"))).first()[0] or 0)
    rows = marked.join(numbers, "family")
    place = lambda n: F.pmod(F.xxhash64("sid"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    rest = rows.where("rest").withColumn("i", place("n_rest")).withColumn("j", each("n_all"))
    whole = rows.withColumn("j", place("n_all")).withColumn("i", each("n_rest"))
    columns = ["family", "i", "j", "side", "sid"]
    both = rest.withColumn("side", F.lit(0)).select(columns).unionByName(whole.withColumn("side", F.lit(1)).select(columns))

    def piece(rows: list[tuple[int, int, bytes]]) -> tuple[np.ndarray, np.ndarray]:
        a, b = ([(sid, np.frombuffer(x, "<u8")) for own, sid, x in rows if own == side] for side in (0, 1))
        if not a or not b:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        ids = [np.array([sid for sid, _ in side], np.int64) for side in (a, b)]
        return forest(linked([x for _, x in a], [x for _, x in b], percent), *ids)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for b in pieces(batches):
            for family, i, j, side, sid, x in zip(*[b.column(c).to_pylist() for c in range(6)], strict=True):
                if (family, i, j) != at:
                    u, v = piece(held)
                    yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])
                    at, held = (family, i, j), []
                held.append((side, sid, x))
        u, v = piece(held)
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    found, shares = [], math.ceil(sent / max(bytes_of(elements), UNDIVIDED)) or 1
    for share in range(shares):
        some = both.where(F.pmod(F.xxhash64("family", "i", "j"), F.lit(shares)) == share).join(elements, "sid").select(*columns, "elements")
        dealt = some.repartition("family", "i", "j").sortWithinPartitions("family", "i", "j")
        found.append(keep(arrow_pass(dealt, "u long, v long", work), "links"))
    return united(found)


def labelled(rows: DataFrame, labels: DataFrame, *columns: str) -> DataFrame:
    """rows with label_<column>: the component of the set in each of the columns, itself if it has no link."""
    for c in columns:
        own = labels.select(F.col("node").alias(c), F.col("component").alias(f"label_{c}"))
        rows = rows.join(own, c, "left").withColumn(f"label_{c}", F.coalesce(f"label_{c}", c))
    return rows


def all_links(shared: DataFrame, elements: DataFrame, percent: int) -> DataFrame:
    """Links that connect all sets that similarity connects; see the module's text."""
    hub = shared.groupBy("sig").agg(F.min(F.struct("sid", "size")).alias("hub"))
    ties = shared.join(hub, "sig").select(F.col("hub.sid").alias("u"), F.col("hub.size").alias("su"), F.col("sid").alias("v"), F.col("size").alias("sv"))
    stars = ties.where("u <> v").groupBy("u", "v").agg(F.count(F.lit(1)).alias("w"), F.first("su").alias("su"), F.first("sv").alias("sv"))
    nearest = F.row_number().over(Window.partitionBy("v").orderBy(F.desc("w"), "u"))
    stars = keep(stars.withColumn("nearest", nearest).where(F.col("nearest") <= HUBS).drop("nearest"), "stars")
    best = stars.groupBy("v").agg(F.max(F.struct("w", "u", "su", "sv")).alias("best")).select("v", "best.*")
    found = links(best, elements, percent)
    labels = components(found)
    apart = labelled(stars.join(best.select("v", F.col("u").alias("best")), "v").where("u <> best"), labels, "u", "v").where("label_u <> label_v")
    found = found.unionByName(links(apart, elements, percent))
    thin = thinned(iter([labelled(shared, components(found), "sid")]), "label_sid")
    forget(shared)
    rare = keep(of_several(rarest(thin), "label_sid"), "rarest-signatures")
    forget(thin)
    times = rare.groupBy("sig").agg(F.count(F.lit(1)).alias("times"), F.min("sid").alias("hub"))
    # with each row come some rarer ones of its set, so that a pair need not be named again where it shares these
    rarer = F.collect_list("sig").over(Window.partitionBy("sid", "kind").orderBy("times", "sig").rowsBetween(-RARER, -1))
    tied = keep(rare.join(times, "sig").withColumn("rarer", rarer), "tied-sets")
    forget(rare)
    # a set ties all its hubs, so each hub needs one edge to the smallest of them, and many sets ask for the same ones
    hubs = tied.where(F.col("times") > FEW).groupBy("sid").agg(F.collect_set("hub").alias("hubs"))  # a set's signatures at most
    hubs = hubs.select("sid", "hubs", F.array_min("hubs").alias("u"))
    families = components(hubs.select("u", F.explode("hubs").alias("v")).unionByName(hubs.select("u", F.col("sid").alias("v"))))
    members = tied.select("sid", "size", F.col("label_sid").alias("label")).distinct()
    members = members.join(families.select(F.col("node").alias("sid"), F.col("component").alias("family")), "sid")
    found = found.unionByName(block_links(members, elements, percent))
    few = tied.where(F.col("times") <= FEW)
    named = lambda x: [F.col(c).alias(n + x) for c, n in (("sig", "sig_"), ("sid", ""), ("size", "s"), ("label_sid", "label_"), ("rarer", "rarer_"))]
    a, b = few.select(named("u")), few.select(named("v"))
    new = (a["u"] < b["v"]) & (a["label_u"] != b["label_v"]) & ~F.arrays_overlap("rarer_u", "rarer_v")
    rest = a.join(b, (a["sig_u"] == b["sig_v"]) & new).select("u", "su", "v", "sv").distinct()
    rest = rest.join(stars.select("u", "v"), ["u", "v"], "left_anti")  # a hub is the smaller of its pairs
    return found.unionByName(links(rest, elements, percent))


def linked_components(docs: DataFrame, n: int, percent: int, parts: int = 1) -> DataFrame:
    """doc_id, n_shingles, component_id and the set's key, for every row of docs; signatures of large tables are made in so many parts."""
    rows = keep(set_rows(docs, n), "sets")
    sets = rows.where("n_shingles is not null").select("doc_id", "text_hash", "n_shingles", "key", "key64")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("first")
    per_key = [first, F.count(F.lit(1)).alias("n_rows"), F.first("n_shingles").alias("size"), F.first("key64").alias("key64")]
    distinct = sets.where("key is not null").groupBy("key").agg(*per_key)
    distinct = distinct.select(
        F.monotonically_increasing_id().alias("sid"), "key", "key64", "size", "n_rows", F.col("first.doc_id").alias("rep"), F.col("first.text_hash").alias("rep_hash")
    )
    distinct = keep(distinct, "distinct-sets")
    parts = parts if parts > 1 and 8 * (distinct.agg(F.sum("size")).first()[0] or 0) > UNDIVIDED else 1
    with passing(docs.sparkSession) as own:
        shared = shared_signatures(docs, n, percent, common_ngrams(rows), distinct, parts)
        needed = distinct.join(shared.select("sid").distinct(), "sid", "left_semi").select("sid", "key", "n_rows", "rep", "rep_hash")
        labels = components(all_links(shared, element_rows(docs, n, needed, parts), percent))
        kept = own.pop()  # the last table is the labels
    keeps(kept)
    of_set = labelled(distinct.select("sid", "key", "rep"), labels, "sid")
    least = of_set.groupBy("label_sid").agg(F.min("rep").alias("component_id"))
    of_set = of_set.join(least, "label_sid").select(F.col("key").alias("of"), "component_id")
    # documents with the empty set get a join key of their own each, longer than any set's, so that they do not meet
    own = F.concat(F.lit("without any n-gram: "), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary")
    return sets.join(of_set, F.coalesce("key", own) == F.col("of"), "left").select(
        "doc_id", "n_shingles", F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "key"
    )


#: What one_of_each calls its rows by; no column of its input may have this name.
ROW = "row of one_of_each"


def one_of_each(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """One row of each component, as it is: that of the smallest doc_id (nulls last), then of the smallest set key.

    Rows are linked and kept by numbers of their own, written with them, so doc_ids may be null or repeat.
    """
    numbered = keep(docs.withColumn(ROW, F.monotonically_increasing_id()), "numbered", "zstd")
    found = linked_components(numbered.select(F.col(ROW).alias("doc_id"), "text"), n, percent, PASSES)
    ids = numbered.select(F.col(ROW).alias("row"), F.col("doc_id").alias("id"))
    rows = found.select(F.col("doc_id").alias("row"), "component_id", "key").join(ids, "row")
    first = F.min(F.struct(F.col("id").isNull(), "id", "key", "row")).alias("first")
    kept = rows.groupBy("component_id").agg(first).select(F.col("first.row").alias(ROW))
    return numbered.join(kept, ROW, "left_semi").select(*docs.columns)
