"""Byte-pair encoding and decoding by depth-first traversal of a trie of distinct words.

A text splits at white space, and equal words encode alike, so each batch of texts is reduced to its
distinct words and these to their distinct pre-tokens. The pre-tokens form a trie. Every node carries one
state, the last token in the encoding of the prefix that ends there; it follows from the states of the
nodes above: the last token is the one vocabulary entry that ends the prefix and may follow the last token
of what precedes it. Going depth first, each shared prefix is thus computed once, and the encoding of a
word is read off by walking its states back. Two tokens may stand side by side if the merges, taken in
order of rank, never join the ends that meet.

Merges and vocabulary come from a tokenizer file of the public JSON form; nothing is trained. The ids
equal those of the tokenizers library for such a file with the normaliser and splits of ``WORD_SPLIT``.

Each text is encoded whole, where it lies. What is kept between batches is bounded by ``REMEMBERED`` words of
``LONGEST`` characters at most; longer ones are encoded anew in each step, and a step takes texts of
``CHARACTERS`` together, or one longer text. Pre-tokens beyond ``DEEP`` letters share no prefixes: they are
walked one by one, with their states in arrays of numbers.

Defined cases: a null or empty text, or one of white space, has no ids and decodes to the empty text;
special strings in a text become their special ids; repeated rows encode alike; extra columns are ignored.
"""

from __future__ import annotations

import gc
import hashlib
import json
import re
import unicodedata
from array import array
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from tallyshelf.llm.common import held, text_pass

END = "</w>"
#: Words remembered between batches, above which the memory starts anew, and the longest of them in characters.
REMEMBERED, LONGEST = 400_000, 64
#: Letters of a pre-token above which its states are arrays.
DEEP = 4096
NEVER = 1 << 40

# How the tokenizer file splits words, and what Unicode calls white space.
WORD_SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
SPACES = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
SEPARATORS = re.compile("[\x1c-\x1f]")
BEYOND_LATIN = re.compile("[^\x00-\u024f]")


def byte_letters() -> list[str]:
    """The printable stand-in of each byte: itself if printable, else the next free character from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


LETTERS = byte_letters()
TO_LETTERS = {b: x for b, x in enumerate(LETTERS)}


class WordBpe:
    """A tokenizer file, ready to encode words."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        splits = [x["pattern"].get("Regex") for x in (file["pre_tokenizer"] or {}).get("pretokenizers", []) if x["type"] == "Split"]
        if splits != [WORD_SPLIT.pattern] or file["model"].get("end_of_word_suffix") != END:
            raise ValueError("words of this tokenizer are split in another way")
        self.path = path
        self.vocab: dict[str, int] = file["model"]["vocab"]
        self.special = {x["content"]: x["id"] for x in file["added_tokens"]}
        self.names = {i: t for t, i in [*self.vocab.items(), *self.special.items()]}
        self.special_split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}  # of each token that merges make: left, right
        self.born: dict[int, int] = {}  # its rank
        self.settled: dict[int, bool] = {}
        made = []
        for r, merge in enumerate(file["model"]["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            pair = self.vocab[left], self.vocab[right]
            self.rank[pair] = r
            made.append((pair, self.vocab[left + right], r))
        reachable = {i for t, i in self.vocab.items() if len(t.removesuffix(END)) == 1}
        for (left, right), token, r in made:
            if token not in self.parts and left in reachable and right in reachable and self.meet(left, right) == (left, right):
                self.parts[token], self.born[token] = (left, right), r
                reachable.add(token)
        self.inner = {t: i for t, i in self.vocab.items() if i in reachable and not t.endswith(END)}
        self.final = {t.removesuffix(END): i for t, i in self.vocab.items() if i in reachable and t.endswith(END)}
        self.longest = max(map(len, self.inner)), max(map(len, self.final))
        self.known: dict[str, tuple[bytes, bytes]] = {}
        self.library = None

    def meet(self, left: int, right: int) -> tuple[int, int] | None:
        """The two symbols that merge across the border between two tokens, None if none ever do.

        Both tokens grow by their own merges, the lowest rank first, leftmost first at equal rank.
        """
        xs, ys = [left], [right]
        while xs[-1] in self.parts:
            xs.append(self.parts[xs[-1]][1])
        while ys[-1] in self.parts:
            ys.append(self.parts[ys[-1]][0])
        while True:
            x, y = xs[-1], ys[-1]
            grow_x = self.born[xs[-2]] if len(xs) > 1 else NEVER
            grow_y = self.born[ys[-2]] if len(ys) > 1 else NEVER
            across = self.rank.get((x, y), NEVER)
            if across < grow_x and across <= grow_y and across < NEVER:
                return x, y
            if grow_x == grow_y == NEVER:
                return None
            (xs if grow_x <= grow_y else ys).pop()

    def follows(self, left: int, right: int) -> bool:
        key = left << 20 | right
        if (found := self.settled.get(key)) is None:
            if len(self.settled) > 2_000_000:
                self.settled.clear()
            found = self.settled[key] = self.meet(left, right) is None
        return found

    def traverse(self, words: Iterable[str]) -> dict[str, list[int]]:
        """Ids of distinct pre-tokens. In sorted order the stack of states is the path from the trie's root."""
        words = list(words)
        out = self.walk(sorted(w for w in words if len(w) <= DEEP), [-1], [0])
        for word in (w for w in words if len(w) > DEEP):
            out |= self.walk([word], array("i", [-1]), array("q", [0]))
        return out

    def walk(self, words: list[str], token: list[int] | array, start: list[int] | array) -> dict[str, list[int]]:
        """Ids of sorted pre-tokens. At depth i, token has the last token of the prefix, and start where it starts."""
        out: dict[str, list[int]] = {}
        before = ""
        inner, final, follows = self.inner, self.final, self.follows
        for word in words:
            depth, most = 0, min(len(before), len(word) - 1, len(token) - 1)
            while depth < most and before[depth] == word[depth]:
                depth += 1
            del token[depth + 1 :], start[depth + 1 :]
            for end in range(depth + 1, len(word)):
                at = start[-1]  # most often the last token grows by one symbol
                t = inner.get(word[at:end])
                if t is None or at and not follows(token[at], t):
                    for at in range(end - 1, max(-1, end - 1 - self.longest[0]), -1):
                        t = inner.get(word[at:end])
                        if t is not None and (at == 0 or follows(token[at], t)):
                            break
                    else:
                        raise ValueError(f"no token ends {word[:end]!r}")
                token.append(t)
                start.append(at)
            at = start[-1]
            last = final.get(word[at:])
            if last is None or at and not follows(token[at], last):
                for at in range(len(word) - 1, max(-1, len(word) - 1 - self.longest[1]), -1):
                    last = final.get(word[at:])
                    if last is not None and (at == 0 or follows(token[at], last)):
                        break
                else:
                    raise ValueError(f"no token ends {word!r}")
            ids = [last]
            while at:
                ids.append(token[at])
                at = start[at]
            out[word] = ids[::-1]
            before = word
        return out

    def pre_tokens(self, part: str) -> list[str]:
        """The pre-tokens of a word without special strings, as byte letters."""
        if part.isascii():
            if part.isalpha():
                return [part.lower()]
            if not SEPARATORS.search(part):
                return WORD_SPLIT.findall(part.lower())
        if BEYOND_LATIN.search(part) or SEPARATORS.search(part):  # what Unicode versions may class differently
            if self.library is None:
                from tokenizers import Tokenizer

                self.library = Tokenizer.from_file(self.path)
            low = self.library.normalizer.normalize_str(part)
            return [x for x, _ in self.library.pre_tokenizer.pre_tokenize_str(low)]
        found = WORD_SPLIT.findall(unicodedata.normalize("NFC", part).lower())
        return [x if x.isascii() else x.encode().decode("latin-1").translate(TO_LETTERS) for x in found]

    def learn(self, words: set[str]) -> list[str]:
        """Encodes and decodes the words not known yet; returns those among them that are too long to be kept."""
        if len(self.known) + len(words) > REMEMBERED:
            self.known.clear()
        pieces: dict[str, list[str | int]] = {}
        distinct: set[str] = set()
        for w in [w for w in words if w not in self.known]:
            if w.isascii() and w.isalpha():
                pieces[w] = [low := w.lower()]
                distinct.add(low)
                continue
            found: list[str | int] = []
            for part in self.special_split.split(w) if "<|" in w else (w,):
                if part in self.special:
                    found.append(self.special[part])
                elif part:
                    found += (new := self.pre_tokens(part))
                    distinct.update(new)
            pieces[w] = found
        gc.disable()  # nothing here is cyclic, and walking all of it again and again takes long
        try:
            ids_of = self.traverse(distinct)
            for w, found in pieces.items():
                if len(found) == 1 and found[0] in ids_of:
                    ids = ids_of[found[0]]
                else:
                    ids = []
                    for x in found:
                        if isinstance(x, int):
                            ids.append(x)
                        else:
                            ids += ids_of[x]
                self.known[w] = array("I", ids).tobytes(), self.decode(ids).encode()
        finally:
            gc.enable()
        return [w for w in pieces if len(w) > LONGEST]

    def decode(self, ids: Iterable[int]) -> str:
        """Token names joined by spaces: what the file's lack of a decoder asks for."""
        return " ".join(map(self.names.__getitem__, ids))

    @staticmethod
    def words(text: str) -> list[str]:
        if "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text:
            return [x for x in SPACES.split(text) if x]
        return text.split()

    def encode_batch(self, texts: list[str]) -> Iterator[tuple[bytes, bytes]]:
        """For each text its ids as 32-bit integers in the machine's order, and what they decode to."""
        split = [self.words(t) for t in texts]
        passing = self.learn(set().union(*split))
        try:
            for words in split:
                found = [self.known[w] for w in words]
                yield b"".join([x[0] for x in found]), b" ".join([x[1] for x in found if x[1]])
        finally:
            for w in passing:
                del self.known[w]


_loaded: dict[str, WordBpe] = held(__name__)


def tokenizer(path: str) -> WordBpe:
    """The tokenizer of a file, loaded once in each Python process."""
    if path not in _loaded:
        _loaded[path] = WordBpe(path)
    return _loaded[path]


#: Texts, and their characters, taken together when words are looked up; bounds what one step holds.
AT_ONCE, CHARACTERS = 1000, 1 << 22
DIGEST = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
FULL = "doc_id long, ids array<int>, decoded string"


def steps(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The rows of a batch with texts in its second column, in slices that one step takes."""
    sizes = pc.utf8_length(batch.column(1)).to_pylist()
    first, held = 0, 0
    for i, n in enumerate(sizes):
        if i > first and (i - first == AT_ONCE or held + n > CHARACTERS):
            yield batch.slice(first, i - first)
            first, held = i, 0
        held += n
    if sizes:
        yield batch.slice(first)


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids and decoded text of every row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for b in batches:
            for part in steps(b):
                found = list(bpe.encode_batch(part.column(1).to_pylist()))
                ids = pa.array([memoryview(x).cast("i") for x, _ in found], pa.list_(pa.int32()))
                texts = pa.array([y.decode() for _, y in found], pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), ids, texts], names=["doc_id", "ids", "decoded"])

    return text_pass(docs, FULL, work, "doc_id", "text")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, number of ids, and the SHA-256 of ids and of decoded text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for b in batches:
            out = []
            for part in steps(b):
                for ids, text in bpe.encode_batch(part.column(1).to_pylist()):
                    out.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text).hexdigest()))
            n, ids, text = zip(*out, strict=True) if out else ((), (), ())
            cols = [b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(text, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return text_pass(docs, DIGEST, work, "doc_id", "text")
