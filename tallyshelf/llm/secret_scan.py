"""Secret scan: three stated patterns, and strings that stay incompressible in a sensitive context.

A candidate is a run of 16 or more key-like characters that starts within 64 characters after a sensitive word; of a
run that does not but holds such a word, what follows the first one. A run gives one candidate, so candidates never
overlap, and each is priced once, in pieces of bounded length: time grows with the length of the text. A
zstandard compressor is primed with a dictionary of common identifiers and with the text around the
candidate; the bytes that the candidate adds to the compressed output, against its length, are its
novelty. Names, paths and words that occur nearby cost a few bytes, a random key costs about as many
as its alphabet needs. Candidates whose novelty reaches ``MIN_NOVELTY``, or what random strings of their length
and alphabet reach if that is less, are reported as kind ``novel`` unless a stated pattern covers them. Long
keys of few different characters are such: the compressor spends half a byte on a hexadecimal digit. Candidates
that follow such a candidate on the next line, as those of a key in lines, are in its context too.

Each text is scanned on its own, whole, where it lies; nothing is shuffled. Offsets are code points.

Defined cases: a null or empty text has no spans; several kinds may cover the same place and are all
listed, ordered by start, then kind, then end; repeated rows are scanned alike; null doc_ids stay; a key's last
line is no candidate if it has fewer than 16 characters.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from tallyshelf.llm.common import text_pass

KINDS = ("assign", "access", "hex", "novel")

# The stated patterns. Letters of the first match in either case, ASCII only.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
MIN_ASSIGN, MIN_ACCESS = 6, 20
#: A text without any of these, lower-cased, cannot hold an assignment.
ASSIGN_STEMS = ("passw", "secret", "token", "api")

SENSITIVE = ("auth", "bearer", "credential", "cookie", "key", "passw", "private", "pwd", "secret", "session", "signature", "token")
SENSITIVE_WORD = re.compile("|".join(SENSITIVE), re.I | re.A)
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=.-]{16,}")
REACH, AROUND, MIN_NOVELTY, SHORTEST = 64, 512, 0.8, 16
#: What lies between the lines of a key, line breaks as such or written as in JSON.
NEXT_LINE = re.compile(r"""[\x20\t"',+]*\\?(?:[\r\n]|\\r|\\)+[\x20\t"',+\r\n]*""", re.A)
#: Characters that keys are written in; the first that has all of a candidate's is its alphabet, symbols apart.
DIGITS, SMALL, LARGE = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ALPHABETS = (
    *(DIGITS, DIGITS + SMALL[:6], DIGITS + LARGE[:6], SMALL, LARGE, LARGE + "234567", SMALL + "234567"),
    *(DIGITS + SMALL, DIGITS + LARGE, SMALL + LARGE, DIGITS + SMALL + LARGE),
)
#: Random strings that are tried for a length, the share of the least of them that suffices, and the lengths
#: beyond which lengths are rounded up and are all alike.
TRIED, SUFFICES, ROUNDED, ALIKE = 8, 0.97, 4096, 65536

#: What code and configuration use again and again; primes every compressor.
IDENTIFIERS = (
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 01234567890123456789 "
    "application argument attribute authorization background boolean buffer callback category certificate character "
    "client collection column command comment component condition config configuration connection constructor container "
    "content context controller cookie count create credential current database default delete description destination "
    "development directory document element enable encoding environment error example exception export extension false "
    "filename format function generate handler header height identifier image implementation import index information "
    "initialize input instance integer interface internal iterator language length library license listener localhost "
    "location manager memory message metadata method module namespace network notification number object operation option "
    "output package parameter parent password pattern permission position private process production project property "
    "protocol provider public query reference register remote repository request required resource response result return "
    "schema script secret security select sequence server service session settings signature source standard statement "
    "static status storage string structure subject system target template thread timeout timestamp token transaction "
    "transform translation true update username validate value variable version warning window "
    "http:// https:// www. .com .org .net .json .yaml .html com.example org.apache /usr/local/bin /etc/ /home/user/ "
    "get_ set_ is_ has_ _id _key _name _type _value _path _url _size _time "
).encode()


def novelty(candidate: bytes, around: bytes) -> float:
    """Compressed bytes that the candidate adds per byte, by a compressor that knows the identifiers and what is around it.

    A candidate of more than ALIKE bytes is compressed in pieces of that size.
    """
    primed = zstandard.ZstdCompressionDict(IDENTIFIERS + around, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    press = zstandard.ZstdCompressor(level=6, dict_data=primed, write_checksum=False, write_content_size=False)
    pieces = range(0, len(candidate), ALIKE)
    return (sum(len(press.compress(candidate[i : i + ALIKE])) for i in pieces) - len(pieces) * len(press.compress(b""))) / len(candidate)


def alphabet_of(candidate: str) -> str:
    """The alphabet that a candidate seems to be written in, with the symbols it holds; padding does not count."""
    held = set(candidate.rstrip("="))
    symbols = "".join(sorted(held - set(ALPHABETS[-1])))
    return next(a for a in ALPHABETS if held <= {*a, *symbols}) + symbols


@lru_cache(maxsize=20_000)
def reached(alphabet: str, length: int) -> float:
    """The novelty that random strings of a length reach at least, where nothing is around them."""
    rng = random.Random(f"{alphabet} {length}")
    return SUFFICES * min(novelty("".join(rng.choices(alphabet, k=length)).encode(), b"") for _ in range(TRIED))


def is_novel(candidate: str, around: str) -> bool:
    found = novelty(candidate.encode(), around.encode())
    if found >= MIN_NOVELTY:
        return True
    alphabet, length = alphabet_of(candidate), len(candidate)
    if found < 0.9 * math.log2(len(alphabet)) / 8:
        return False  # random strings need more than that at any length
    if length > ROUNDED:
        length = min(1 << (length - 1).bit_length(), ALIKE)
    return found >= reached(alphabet, length)


def stated_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the stated patterns, in order."""
    found = [(m.start(), "hex", m.end()) for m in HEX.finditer(text)]
    if "AKIA" in text:
        found += [(m.start(), "access", m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    low = text.lower()
    if any(x in low for x in ASSIGN_STEMS):
        found += [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= MIN_ASSIGN]
    return sorted(found, key=place) if len(found) > 1 else found


def candidates(text: str) -> list[tuple[int, int]]:
    """Start and end of the candidates of a text, in order; they do not overlap."""
    found = []
    words = SENSITIVE_WORD.finditer(text)
    word, before, last = next(words, None), -REACH - 1, None  # before: where the last word ended that starts ahead of a run
    for run in CANDIDATE.finditer(text):
        start, end = run.span()
        while word and word.end() <= start:
            before, word = word.end(), next(words, None)
        follows = last is not None and start - last <= REACH and NEXT_LINE.fullmatch(text, last, start)
        inside = word.end() if word and word.end() <= end else None
        if start - before > REACH and not follows:
            if inside is None or end - inside < SHORTEST:
                last = None
                continue
            start = inside
        found.append((start, end))
        last = end
    return found


def novel_spans(text: str, stated: list[tuple[int, str, int]]) -> list[tuple[int, str, int]]:
    """Incompressible strings in a sensitive context that no stated span overlaps."""
    low = text.lower()
    if not any(x in low for x in SENSITIVE):
        return []
    starts, ends, out = [s for s, _, _ in stated], list(accumulate((e for _, _, e in stated), max)), []
    for s, e in candidates(text):
        k = bisect_left(starts, e)
        if k and ends[k - 1] > s:
            continue
        if is_novel(text[s:e], text[max(0, s - AROUND) : s] + text[e : e + AROUND]):
            out.append((s, "novel", e))
    return out


def place(span: tuple[int, str, int]) -> tuple[int, int, int]:
    return span[0], KINDS.index(span[1]), span[2]


def spans(text: str) -> list[tuple[int, str, int]]:
    """All spans of a text as (start, kind, end), by start, then kind."""
    stated = stated_spans(text)
    return sorted(stated + novel_spans(text, stated), key=place)


def joined(found: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, k, e in found)


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, n_novel long, base_sha256 string, spans string"


def scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out: list[tuple] = []
        for text in b.column(1).to_pylist():
            stated = stated_spans(text)
            new = novel_spans(text, stated)
            count = [sum(k == kind for _, k, _ in stated) for kind in KINDS[:3]]
            base = hashlib.sha256(joined(stated).encode()).hexdigest()
            out.append((*count, len(new), base, joined(sorted(stated + new, key=place) if new else stated)))
        kinds = [pa.int64()] * 4 + [pa.string()] * 2
        cols = [pa.array([r[i] for r in out], kinds[i]) for i in range(6)]
        yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=["doc_id", *[c.split()[0] for c in SCHEMA.split(", ")[1:]]])


def scan(docs: DataFrame) -> DataFrame:
    """One row per row of docs with its counts and spans; see SCHEMA."""
    return text_pass(docs, SCHEMA, scan_batches, "doc_id", "text")
