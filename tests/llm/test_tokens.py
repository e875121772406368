"""Operators 3 and 8 against the tokenizers library."""

import hashlib
import random
import re
import struct
import zlib

import pytest
from tokenizers import Tokenizer

from tallyshelf.llm import bpe, common, ngram_join, queries, token_files
from tests.llm.shared import EDGES, edges, none

WORD, BYTE = queries.tokenizer_file("word_bpe_49k.json"), queries.tokenizer_file("byte_bpe_50k.json")


def packed(ids):
    return struct.pack(f"<{len(ids)}I", *ids)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def word_expected(rows):
    t = Tokenizer.from_file(WORD)
    t.no_truncation()
    t.no_padding()
    out = []
    for doc_id, text in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids
        back = t.decode(ids, skip_special_tokens=False)
        out.append((doc_id, len(ids), hashlib.sha256(packed(ids)).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    return sorted(out, key=repr)


def byte_expected(rows):
    t = Tokenizer.from_file(BYTE)
    out, start = [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = t.encode(text or "", add_special_tokens=False).ids + [0]
        out.append((doc_id, start, len(ids), zlib.crc32(packed(ids))))
        start += len(ids)
    return sorted(out, key=repr)


MORE = [
    "<|startoftext|>Hello<|endoftext|> it's we'll THEY'RE x'S",
    "á Å ﬁne ½ ²  ٣ ﻿ zero​width­soft",
    "a" * 3000 + " " + "!?" * 900,
    "tab\tand\nnew  double   triple \r\n end ",
    "日本語のテキスト 한국어 ไทย हिन्दी русский العربية",
    "İstanbul ΣΊΣΥΦΟΣ straße ǅ",
]


@pytest.fixture(scope="module")
def docs(spark, sf):
    more = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(MORE)], "doc_id long, text string")
    return edges(spark).select("doc_id", "text").unionByName(more).unionByName(
        spark.read.parquet(f"{sf}/documents.parquet").selectExpr("doc_id + 5000 as doc_id", "text")
    )


def test_word_bpe_equals_the_library(spark, docs):
    rows = [tuple(r) for r in docs.collect()]
    assert rows_of(bpe.digests(docs, WORD)) == word_expected(rows)


def test_word_bpe_keeps_ids_and_text(spark):
    out = {r.doc_id: r for r in bpe.encoded(edges(spark), WORD).select("doc_id", "ids", "decoded").collect()}
    assert list(out[1].ids) == [] and out[1].decoded == ""
    assert out[4].ids == Tokenizer.from_file(WORD).encode("One", add_special_tokens=False).ids


def test_token_files_equal_the_library(spark, docs):
    rows = [tuple(r) for r in docs.collect()]
    path = token_files.fresh_path(spark)
    token_files.write(docs, BYTE, path)
    found = token_files.digests(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")
    assert rows_of(found) == byte_expected(rows)


def test_stretches_of_documents(spark, sf):
    """Random access: any stretch of any document, without what lies before it."""
    path = token_files.fresh_path(spark)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    ends = spark.createDataFrame([(-(1 << 63), "the least id there is"), (None, "no id"), ((1 << 63) - 1, "la " * 5000)], "doc_id long, text string")
    token_files.write(docs.unionByName(ends), BYTE, path)
    t, rng = Tokenizer.from_file(BYTE), random.Random(1)
    texts = {r.doc_id: r.text for r in docs.unionByName(ends).collect()}
    seen = set()
    for row in spark.read.schema(token_files.BLOCKS).parquet(path).collect():
        block = token_files.Block(row.asDict())
        for k, doc_id in enumerate(block.doc_ids.tolist()):
            doc_id = None if k < block.no_ids else doc_id
            seen.add(doc_id)
            ids = t.encode(texts[doc_id] or "", add_special_tokens=False).ids + [0]
            assert block.document(k).tolist() == ids
            for _ in range(3):
                start = rng.randrange(len(ids) + 1)
                stop = rng.randrange(start, len(ids) + 1)
                assert block.document(k, start, stop).tolist() == ids[start:stop]
    assert seen == set(texts)


def test_token_files_of_repeated_rows(spark):
    path = token_files.fresh_path(spark)
    token_files.write(edges(spark), BYTE, path)
    found = token_files.digests(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")
    assert rows_of(found) == byte_expected([r[:2] for r in EDGES])


def test_empty_tables(spark):
    assert bpe.digests(none(spark), WORD).count() == 0
    path = token_files.fresh_path(spark)
    token_files.write(none(spark), BYTE, path)
    assert token_files.digests(spark, path).count() == 0


def test_long_words_are_not_kept(monkeypatch):
    t = bpe.WordBpe(WORD)
    r = random.Random(5)
    texts = ["".join(chr(r.randint(0x4E00, 0x9FFF)) for _ in range(2000)) + " short" for _ in range(20)]
    monkeypatch.setattr(bpe, "DEEP", 3000)  # some pre-tokens of 6,000 byte letters are walked by themselves
    texts += ["x" * 100 + " " + "x" * 5000, "short words only"]
    library = Tokenizer.from_file(WORD)
    for _ in range(2):
        for text, (ids, _) in zip(texts, t.encode_batch(texts), strict=True):
            assert list(memoryview(ids).cast("I")) == library.encode(text, add_special_tokens=False).ids
        assert set(t.known) == {"short", "words", "only"}


def test_steps_hold_a_bounded_number_of_characters():
    texts = ["a" * (bpe.CHARACTERS // 2)] * 3 + ["b" * (3 * bpe.CHARACTERS)] + ["", None] + ["c"] * (bpe.AT_ONCE + 1)
    batch = bpe.pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": [t or "" for t in texts]})
    found = list(bpe.steps(batch))
    assert [x for s in found for x in s.column(0).to_pylist()] == list(range(len(texts)))
    assert [s.num_rows for s in found] == [2, 1, 1, bpe.AT_ONCE, 3]
    assert list(bpe.steps(batch.slice(0, 0))) == []


def test_other_splits_are_refused():
    with pytest.raises(ValueError, match="another way"):
        bpe.WordBpe(BYTE)


def test_a_pass_empties_what_other_operators_hold_in_its_worker(spark):
    rows = spark.createDataFrame([(1, "one two three")], "doc_id long, text string").coalesce(1)
    bpe.digests(rows, WORD).collect()

    def look(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(bpe._loaded) + len(token_files._encoders)] * b.num_rows, pa.int64())], names=["held"])

    bpe.digests(rows, WORD).collect()
    assert [r.held for r in common.arrow_pass(rows, "held long", look).collect()] == [0]
    own, other = common.held("own"), common.held("other")
    own["x"] = other["x"] = 1
    common.make_room("own")
    assert own == {"x": 1} and other == {} and common.held(bpe.__name__) is bpe._loaded
    assert ngram_join.shared_batches.__module__ == ngram_join.__name__


def test_simple_chunks_go_to_the_model_piece_by_piece():
    class Library:
        seen: list[str] = []

        def encode_batch_fast(self, texts, **more):
            self.seen += texts
            return own.library_itself.encode_batch_fast(texts, **more)

    own, whole = token_files.ChunkEncoder(BYTE), Tokenizer.from_file(BYTE)
    own.library_itself, own.library = own.library, Library()
    rng = random.Random(5)
    printable = {rng.choice(["", " "]) + "".join(rng.choices("abTHE's'lld0189.,-_<|>!?$\"~", k=rng.randint(1, 14))) for _ in range(3000)}
    printable |= {" 's", "'s", "'ll've", "it's", " it's5", "x" * 300, " 0", "don't", "'T"}
    printable = {c for c in printable if "<|" not in c}
    wide = "\u00c0\u00ff\u024f\u0391\u03ce\u0436\u0481\u0628\u3041\u30ab\u4e00\u4e8c\u9fa5\ud55c\u00a1\u00a9\u2014\u2019\u2026\u3002\uff0ca5's"
    printable |= {rng.choice(["", " "]) + "".join(rng.choices(wide, k=rng.randint(1, 12))) for _ in range(3000)}
    ranges = re.findall("(.)-(.)", token_files.LETTERS + token_files.MARKS[9:].replace("{-~", ""))
    printable |= {f"{space}a{chr(x)}1{chr(x)}." for low, high in ranges for x in range(ord(low), ord(high) + 1) for space in ("", " ")}
    others = {"\u00bd\u2167", " a\u0301", "\u00aa\u00b2", "\u0969\u0905", "\U0001f600!", "a\u3000b", "<|endoftext|>", " a<|endoftext|>b", "\x7f", " a\x00b", "\u00e9t\u00e9", " caf\u00e9s", "\n", " a \n"}
    found = own.learn(printable | others)
    assert found == {c: packed(whole.encode(c, add_special_tokens=False).ids) for c in printable | others}
    assert not printable.intersection("\n".join(Library.seen).split("\n"))


def test_texts_are_encoded_in_columns_without_an_object_for_each_chunk(monkeypatch):
    """Chunks that occur again make no Python object, and known pieces do not go to the model again."""
    own, whole = token_files.ChunkEncoder(BYTE), Tokenizer.from_file(BYTE)
    seen = []
    monkeypatch.setattr(own, "learn", lambda missing, learn=own.learn: seen.append(set(missing)) or learn(missing))
    monkeypatch.setattr(own, "of_model", lambda new, model=own.of_model: seen.append(new.to_pylist()) or model(new))
    texts = ["the harbour, the harbour. " * 200 + "the end", "it's the end", "", "the harbour"]
    expected = [[*whole.encode(t, add_special_tokens=False).ids, 0] for t in texts]
    assert [x.tolist() for x in own.encode(token_files.pa.array(texts))] == expected
    assert sum(map(len, seen)) < 12 and {"it's"} in seen
    seen.clear()
    assert [x.tolist() for x in own.encode(token_files.pa.array(texts))] == expected
    assert sum(map(len, seen)) == 0


def test_places_where_texts_are_cut():
    own, whole = token_files.ChunkEncoder(BYTE), Tokenizer.from_file(BYTE)
    rng = random.Random(7)
    signs = [*" \n\t\r\x00\x1c\x1f\x7f\x85\xa0\u1680\u180e\u2000\u200a\u200b\u2028\u202f\u205f\u3000\u00ab\u2019\u2026\ufeff\uffff\U0001f600"]
    words = ["a", "The", "don't", "'ll", "'", "x'", "12", ".", "<|endoftext|>", "<", "|", "\u00e9t\u00e9", "\u65e5\u672c", "a\u0301", "\u0939\u093f", "\u0e44\u0e17\u0e22", "end.of"]
    texts = [" ", "\n", "", "  ", " a", "a ", "a\nb", "\na", "a\n", "<", "|a", "<|", "a <|endoftext|> b", "x <", "|endoftext|>", "", ""]
    texts += ["".join(rng.choice(signs if rng.random() < 0.3 else [" "] if rng.random() < 0.4 else words) for _ in range(rng.randint(1, 30))) for _ in range(4000)]
    for t in ([texts[0]], [""], ["", ""], texts, texts[::-1]):
        column = token_files.pa.array(["left out", *t]).slice(1)
        assert [x.tolist() for x in own.encode(column)] == [[*x.ids, 0] for x in whole.encode_batch(t, add_special_tokens=False)]
    ends, data = token_files.parts(token_files.pa.array(["a b\nc", "", "<| d"], token_files.pa.large_string()))
    assert token_files.units(data, ends[1:]).tolist() == [0, 1, 3, 4, 5, 5, 5, 9, 9]


def test_memory_of_pieces_is_bounded_and_long_pieces_are_not_kept(monkeypatch):
    monkeypatch.setattr(token_files, "REMEMBERED", 50)
    own, whole = token_files.ChunkEncoder(BYTE), Tokenizer.from_file(BYTE)
    for k in range(5):
        texts = [" ".join(["often", *[chr(97 + i) * (k + 2) for i in range(20)], "z" * 70])]
        assert own.encode(token_files.pa.array(texts))[0].tolist() == [*whole.encode(texts[0], add_special_tokens=False).ids, 0]
        known = own.pieces_known[0].to_pylist()
        assert b"often" in known and len(known) <= 50 and max(map(len, known)) <= token_files.LONGEST
        assert len(known) == len(own.pieces_known[1])


def test_steps_of_token_files_hold_bounded_bytes(monkeypatch):
    monkeypatch.setattr(token_files, "STEP", 10)
    texts = ["\u00e9" * 5, "a", "b" * 9, "c" * 30, "", "", "d" * 10, ""]
    batch = token_files.pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts})
    assert [s.column(0).to_pylist() for s in token_files.steps(batch)] == [[0], [1, 2], [3], [4, 5, 6, 7]]
    assert list(token_files.steps(batch.slice(0, 0))) == []


def test_blocks_are_read_by_lengths_of_rules():
    rng = random.Random(3)
    ids = token_files.np.array([rng.randrange(1, 5) for _ in range(3000)] + list(range(60000, 65536)), "<u4")
    rules, lengths, symbols, _ = token_files.compress(ids, token_files.np.array([1000, len(ids)]))
    assert token_files.expand_by_lengths(symbols, rules.astype("i8"), lengths).tolist() == ids.tolist()
    assert token_files.expand_by_lengths(symbols[:0], rules[:0].astype("i8"), lengths[:0]).tolist() == []


def test_calls_of_the_library_hold_bounded_bytes(monkeypatch):
    monkeypatch.setattr(token_files, "CALL", 40)
    own, whole, calls = token_files.ChunkEncoder(BYTE), Tokenizer.from_file(BYTE), []
    monkeypatch.setattr(own, "learn", lambda missing, learn=own.learn: calls.append(sum(len(c.encode()) for c in missing)) or learn(missing))
    texts = [" ".join(["हि" * (i % 5 + 1) for i in range(30)] + [f"word{i}" for i in range(60)] + ["ह" * 50, "z" * 90, "end"])]
    assert own.encode(token_files.pa.array(texts))[0].tolist() == [*whole.encode(texts[0], add_special_tokens=False).ids, 0]
    assert len(calls) > 2 and sorted(calls)[-2] <= 40 and max(calls) == 151
    runs = list(token_files.runs(token_files.pa.array(["a" * 30, "b" * 10, "c", "d" * 50, "", "e"], token_files.pa.large_string()), 40))
    assert runs == [(0, 2), (2, 1), (3, 1), (4, 2)]
