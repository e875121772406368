"""Operators 4, 5, 9 and 10."""

import hashlib
import random
import re
import string
import time
import zlib
from collections import Counter

import numpy as np

from tallyshelf.llm import decontaminate, html_text, secret_scan, sharding
from tests.llm.shared import EDGES, edges, none


def base_spans(text):
    """The stated patterns, written anew."""
    out = []
    for m in re.finditer(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m.group(1)) >= 6 and m.group(0).isascii():
            out.append((m.start(), 0, "assign", m.end()))
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 20]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 24]
    return sorted(out)


def test_secret_base_spans(spark, sf):
    docs = edges(spark).select("doc_id", "text").unionByName(spark.read.parquet(f"{sf}/documents.parquet").selectExpr("doc_id + 1000 as doc_id", "text"))
    texts = {}
    for r in docs.collect():
        texts.setdefault(r.doc_id, r.text or "")
    for r in secret_scan.scan(docs).collect():
        want = base_spans(texts[r.doc_id])
        line = ",".join(f"{k}:{s}:{e}" for s, _, k, e in want)
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == x for _, _, k, _ in want) for x in ("assign", "access", "hex"))
        assert r.base_sha256 == hashlib.sha256(line.encode()).hexdigest()
        assert set(filter(None, line.split(","))) <= set(r.spans.split(","))


def test_secret_novel_spans():
    key = "Zq8vXw3LpT7rBn5YcK2mHs9DfJ4gUe6A"
    text = f"the bearer credential is {key} and nothing else"
    assert ("novel", text.index(key)) in {(k, s) for s, k, _ in secret_scan.spans(text)}
    plain = "the session key is configuration_manager_default_value and nothing else"
    assert secret_scan.spans(plain) == []
    assert secret_scan.spans(f"{key} without any context") == []


def novel(text):
    """The novel strings."""
    return {text[s:e] for s, k, e in secret_scan.spans(text) if k == "novel"}


def slow_candidates(text):
    """Every run against every sensitive word."""
    words = [(m.start(), m.end()) for m in re.finditer("|".join(secret_scan.SENSITIVE), text, re.I | re.A)]
    out, last = [], None
    for m in re.finditer(r"[A-Za-z0-9+/_=.-]+", text):
        start, end = m.span()
        if end - start < 16:
            continue
        near = any(e <= start and start - e <= 64 for _, e in words)
        line = last is not None and start - last <= 64 and secret_scan.NEXT_LINE.fullmatch(text[last:start])
        if not near and not line:
            start = min((e for _, e in words if start < e <= end), default=end)
        last = end if end - start >= 16 else None
        if last:
            out.append((start, end))
    return out


def test_secret_candidates_equal_brute_force():
    rng = random.Random(9)
    parts = ["key", "Token", "a secret", "x" * 15, "x" * 16, "session", "\n", " ", "\\n", ", ", "ab", "Q" * 40, "-----", "mykeyis" + "z" * 20, " " * 63, " " * 5]
    for _ in range(3000):
        text = "".join(rng.choices(parts, k=rng.randrange(1, 14)))
        assert secret_scan.candidates(text) == slow_candidates(text), text
        stated = secret_scan.stated_spans(text)
        want = [(s, e) for s, e in slow_candidates(text) if not any(a < e and s < b for a, _, b in stated)]
        want = [(s, "novel", e) for s, e in want if secret_scan.is_novel(text[s:e], text[max(0, s - 512) : s] + text[e : e + 512])]
        assert secret_scan.novel_spans(text, stated) == want


def test_secret_time_grows_with_the_text():
    rng = random.Random(10)
    run = "".join(rng.choices(string.ascii_letters + string.digits, k=200))
    for text in ((run + "key") * 50_000, ("key " + run + "\n") * 5_000, "password" * 300_000, "token=" + " " * 2_000_000):
        began = time.perf_counter()
        found = sorted(secret_scan.spans(text))
        assert time.perf_counter() - began < 20
        new = [(s, e) for s, k, e in found if k == "novel"]
        assert all(e <= s for (_, e), (s, _) in zip(new, new[1:], strict=False))


def test_secret_long_keys_and_keys_in_lines():
    rng = random.Random(8)
    base64 = string.ascii_letters + string.digits + "+/"
    for letters, sizes in (("0123456789ABCDEF", (64, 128, 1000)), (string.ascii_uppercase + "234567", (160, 256, 2000)), (base64, (1000, 4096, 20_000, 100_000))):
        for size in sizes:
            key = "".join(rng.choices(letters, k=size))
            assert novel(f"the signing key is {key} and no more") == {key}, (letters, size)
    lines = ["".join(rng.choices(base64, k=64)) for _ in range(25)]
    for gap in ("\n", "\r\n", "\n    "):
        text = f"-----BEGIN PRIVATE KEY-----{gap}{gap.join(lines)}{gap}-----END PRIVATE KEY-----\n"
        assert novel(text) == set(lines)
    written = "\\n".join(["-----BEGIN PRIVATE KEY-----", *lines, "-----END PRIVATE KEY-----"])
    assert {x.removeprefix("n") for x in novel(written)} == set(lines)
    assert novel("a session key\n" + "configuration_manager_default_value\n" * 9) == set()
    words = "_".join(["resource", "manager", "default", "listener", "handler", "template"] * 6)
    assert novel(f"the session key is {words} {lines[0]}") == set() and novel("\n".join(lines)) == set()


def test_sharding(spark):
    rows = sharding.shard(edges(spark), 16).collect()
    assert sorted((r.size, r.text_crc32) for r in rows) == sorted((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t, *_ in EDGES)
    places = {}
    for r in rows:
        places.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(p) == list(range(len(p))) for p in places.values()) and set(places) <= set(range(16))
    assert sharding.shard(none(spark)).count() == 0


def test_sharding_sizes_and_rebalancing(spark, tmp_path):
    rng = random.Random(1)
    docs = spark.createDataFrame([(i, "x" * rng.randrange(200)) for i in range(20_000)], "doc_id long, text string")
    path = str(tmp_path / "map")
    first = sharding.shard(docs, 16, map_path=path).groupBy("shard").sum("size").collect()
    sizes = [r[1] for r in first]
    assert len(sizes) == 16 and max(sizes) < 1.02 * min(sizes)
    before = {r.doc_id: r.shard for r in sharding.shard(docs, 16, map_path=path).collect()}
    grown = sharding.shard(docs, 17, map_path=path).collect()
    assert {r.map_version for r in grown} == {3}
    moved = [r for r in grown if before[r.doc_id] != r.shard]
    assert len({r.shard for r in grown}) == 17 and len(moved) < 0.12 * len(grown)


def test_html_text(spark):
    article = "<p>First &amp; foremost   a long\nparagraph of the article that says quite a lot about it.</p><p>Second paragraph, which is also rather long &eacute;.</p>"
    page = f"<html><head><title>t</title><script>var a = '<p>no</p>';</script></head><body><nav><a href=/>Home</a></nav><main><article>{article}</article></main><aside class=sidebar>See <a href=/x>more</a></aside><footer>Imprint</footer></body></html>"
    rows = [(1, "u1", page), (2, "u2", None), (3, None, ""), (4, "u4", "<p>unclosed <b>text"), (4, "u4", "<p>unclosed <b>text"), (5, "u5", "<div>" * 30_000 + "deep words of a page")]
    found = {r.page_id: r for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'c' as text", "1 as n_chars")).collect()}
    assert found[1].text == "First & foremost a long paragraph of the article that says quite a lot about it. Second paragraph, which is also rather long é."
    assert found[1].n_chars == len(found[1].text) and found[2].text == found[3].text == ""
    assert found[4].text == "unclosed text" and found[5].text == "deep words of a page"
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_sharding_of_equal_records(spark, tmp_path):
    """A third of all rows are the same, with and without an id: they are divided, and bytes stay even."""
    rows = [(i, f"text {i}" * 5) for i in range(4000)] + [(7, "again and again" * 3)] * 1500 + [(None, "no id" * 6)] * 1500
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    path = str(tmp_path / "map")
    for n_shards in (16, 17):
        found = sharding.shard(docs, n_shards, n_slots=256, map_path=path).collect()
        sizes, places, slots = {}, {}, {}
        for r in found:
            sizes[r.shard] = sizes.get(r.shard, 0) + r.size
            places.setdefault(r.shard, []).append(r.slot)
            slots[r.vslot] = slots.get(r.vslot, 0) + 1
        assert len(found) == len(rows) and all(sorted(p) == list(range(len(p))) for p in places.values())
        assert len(sizes) == n_shards and max(sizes.values()) < 1.1 * min(sizes.values())
        assert max(slots.values()) < 5 * len(rows) / 256


def test_sharding_again_moves_nothing(spark, tmp_path):
    """The same rows cut into other tasks, with a long text and repeated records, on a stored map: every record stays where it was."""
    rows = [(i, f"text {i} " * (1 + i % 7)) for i in range(1000)] + [(5, "long " * 20_000)] + [(None, "no id")] * 400 + [(7, "again")] * 300
    docs, path, found = spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path / "map"), []
    for parts in (1, 9, 3):
        got = sharding.shard(docs.repartition(parts), 16, n_slots=512, map_path=path).collect()
        found.append(Counter((r.doc_id, r.size, r.text_crc32, r.shard, r.vslot) for r in got))
    assert found[0] == found[1] == found[2]
    more = docs.unionByName(spark.createDataFrame([(2000 + i, f"new {i}") for i in range(50)], "doc_id long, text string"))
    got = Counter((r.doc_id, r.size, r.text_crc32, r.shard, r.vslot) for r in sharding.shard(more.repartition(5), 16, n_slots=512, map_path=path).collect())
    assert sum((found[0] - got).values()) < 0.1 * len(rows)


def random_tree(rng, depth=0):
    """(tag, children), with texts as leaves."""
    tag = rng.choice(["div", "p", "a", "section", "span", "ul"]) if depth else "body"
    inner = [" ".join(["word"] * rng.randrange(1, 9)) if rng.random() < 0.5 or depth > 4 else random_tree(rng, depth + 1) for _ in range(rng.randrange(1, 5))]
    return tag, inner


def counted(node):
    """Characters, tags, link characters and link tags of a tree, each counted over the whole of it."""
    if isinstance(node, str):
        return len(node.replace(" ", "")), 0, 0, 0
    below = [counted(x) for x in node[1]]
    chars, link_chars = sum(x[0] for x in below), sum(x[2] for x in below)
    tags = sum(x[1] + (not isinstance(y, str)) for x, y in zip(below, node[1], strict=True))
    link_tags = sum(x[3] + (not isinstance(y, str) and y[0] == "a") for x, y in zip(below, node[1], strict=True))
    return chars, tags, chars if node[0] == "a" else link_chars, link_tags


def test_html_densities_equal_brute_force():
    rng = random.Random(12)

    def node_of(tree, parent=None):
        node = html_text.Node(tree[0], parent)
        node.parts = [x if isinstance(x, str) else node_of(x, node) for x in tree[1]]
        return node

    def compare(node, tree, share):
        c, t, lc, lt = counted(tree)
        assert (node.chars, node.tags, node.link_chars, node.link_tags) == (c, t, lc, lt)
        density = c / max(t, 1) * max(np.log(max(c / max(lc, 1) * max(t, 1) / max(lt, 1), 1)) / np.log(c / max(c - lc, 1) * lc + share * c + np.e), 1e-6)
        assert abs(node.density - density) < 1e-9 * max(density, 1)
        inner = [(x, y) for x, y in zip(node.parts, tree[1], strict=True) if not isinstance(y, str)]
        assert abs(node.dense - sum(compare(x, y, share) for x, y in inner)) < 1e-6
        return density

    for _ in range(200):
        tree = random_tree(rng)
        root = node_of(tree)
        order = html_text.measure(root)
        c, _, lc, _ = counted(tree)
        compare(root, tree, lc / max(c, 1))
        start, path, least = html_text.main_nodes(root)
        core = max(order, key=lambda x: (x.dense, x.density))
        if core.dense > 0:
            up = [core]
            while up[-1].parent is not None:
                up.append(up[-1].parent)
            assert start is root and path == {id(x) for x in up[1:]} and least == min(x.density for x in up)


def test_html_pages_of_other_shapes():
    long = "A sentence of the story that goes on for quite a while, with many words and hardly a link in it. "
    paragraphs = "".join(f"<p>{long * 2}{i}</p>" for i in range(5))
    links = "<ul>" + "".join(f"<li><a href=/{i}>Other story {i}</a></li>" for i in range(12)) + "</ul>"
    want = " ".join(f"{long * 2}{i}" for i in range(5))
    plain = f"<body><div>{links}</div><div><div>{paragraphs}</div></div><div>{links}</div></body>"
    assert html_text.text_of(plain) == want
    teaser = "<article><p>A short teaser of <a href=/t>another page</a></p></article>"
    several = f"<body><main>{teaser}<article>{paragraphs}</article>{teaser}</main></body>"
    assert want in html_text.text_of(several) and len(html_text.text_of(several)) < len(want) + 80
    beside = f"<body><div><div>{paragraphs}</div><section>{long * 6}</section><section>{links}</section></div></body>"
    assert html_text.text_of(beside) == f"{want} {(long * 6).strip()}"  # dense enough to stay beside the core; the links are not


def test_html_names_do_not_cut_the_article():
    """Whole articles in elements whose names or tags stand for something else stay; beside an article such elements go."""
    long = "A sentence of the story that goes on for quite a while, with many words and hardly a link in it. "
    paragraphs, want = "".join(f"<p>{long * 2}{i}</p>" for i in range(5)), " ".join(f"{long * 2}{i}" for i in range(5))
    imprint = "<div class=footer>Imprint <a href=/>home</a></div>"
    for start, end in (("<div class='social-science'>", "</div>"), ("<article class=notice-board>", "</article>"), ("<section id=discussion>", "</section>"), ("<form><div class='widget'>", "</div></form>")):
        assert html_text.text_of(f"<body>{start}{paragraphs}{end}{imprint}</body>") == want
        assert html_text.text_of(f"<body><article>{paragraphs}</article>{start}{long * 9}{end}{imprint}</body>") == want
        assert html_text.text_of(f"<body>{start}<div class=comments>{long * 2}</div>{paragraphs}{end}</body>") == want
    assert html_text.text_of(f"<body><div hidden>{paragraphs}</div></body>") == ""


def test_html_time_grows_with_the_page():
    n = 60_000
    for page in ("<div>" * n + "x" + "</p>" * n, "<span>" * n + "<p>x" * n, "<b><div>" + "<i>" * n + "</b>" * n, "<td>" * n + "<tr>" * n, "<div class=ads>" * n + "x" * 300, "<form>" * n + "<p>yy" * n, "<a " * n, "<" * n):
        began = time.perf_counter()
        html_text.text_of(page)
        assert time.perf_counter() - began < 15


def table_score(a, b):
    """Local alignment cell by cell."""
    best, above = 0.0, [0.0] * (len(b) + 1)
    for x in a:
        row = [0.0]
        for j, y in enumerate(b):
            row.append(max(0, above[j] + (1 if x == y else -0.5), above[j + 1] - 0.5, row[j] - 0.5))
        best, above = max(best, *row), row
    return best


def test_alignment_and_planted_items(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(2000)]
    items = [(i, " ".join(rng.choices(words, k=rng.choice([4, 12, 30])))) for i in range(40)] + [(100, None), (101, ""), (102, "Only two")]
    docs = []
    for i in range(300):
        filler = rng.choices(words, k=rng.choice([0, 5, 400]))
        if i < 120:
            own = items[i % 40][1].split()
            if i >= 40 and len(own) > 4:
                own[rng.randrange(len(own))] = "changed"
            if i >= 80:
                own = [w.upper() + "," for w in own]
            filler = filler[: len(filler) // 2] + own + filler[len(filler) // 2 :]
        docs.append((i, " ".join(filler)))
    docs += [(500, None), (501, ""), (502, "here are only TWO words"), (503, "nothing of the kind")]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as item_id", "2.0 as score")
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as doc_id")
    found = {}
    for r in decontaminate.contaminated(df, bench).collect():
        found.setdefault(r.doc_id, {})[r.item_id] = r.score
    for i in range(120):
        assert i % 40 in found.get(i, {}), i
    assert set(found[502]) == {102} and not {500, 501, 503} & set(found)
    texts, wanted = dict(docs), dict(items)
    for i, hits in list(found.items())[:60]:
        for item, score in hits.items():
            a, b = decontaminate.words_of(wanted[item].encode()), decontaminate.words_of((texts[i] or "").encode())
            assert abs(table_score(a, b) / len(a) - score) < 1e-9
    kept = decontaminate.clean(df, bench)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {d for d, _ in docs} - set(found)
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contaminated(df, empty).count() == 0 and decontaminate.clean(df, empty).count() == len(docs)
    assert decontaminate.contaminated(none(spark), bench).count() == 0


def test_items_with_marks_between_words(spark):
    """Runs of marks are no words, in items and texts alike: verbatim copies score 1, with places that count all runs."""
    items = [(1, "alpha - beta - gamma - delta - epsilon - zeta"), (2, "Q: what is 2 + 2 ? & why / A : four * not five !"), (3, "--- ... ***"), (4, "| one | two | three | four |")]
    docs = [(10 + i, f"some words - before {t} and ; behind") for i, t in items] + [(20, "alpha beta gamma delta epsilon zeta"), (21, "- - -"), (22, "--- ... ***")]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = {(r.doc_id, r.item_id): r for r in decontaminate.contaminated(df, bench).collect()}
    assert set(found) == {(11, 1), (12, 2), (14, 4), (20, 1)} and all(r.score == 1 for r in found.values())
    texts = {d: t.split() for d, t in docs}
    assert texts[11][found[11, 1].first_word : found[11, 1].end_word] == items[0][1].split()
    assert {r.doc_id for r in decontaminate.clean(df, bench).collect()} == {13, 21, 22}


def test_copies_whose_other_ngrams_no_document_or_many_hold(spark):
    own = {i: [f"i{i}w{k}" for k in range(40)] for i in range(4)}
    changed = [f"x{k}" if k % 4 == 3 else w for k, w in enumerate(own[0])]
    docs = [(0, changed), (1, ["before", *own[1][:18], "after"]), (2, own[2])]
    docs += [(10 + i, [f"d{i}", *own[2][:18], "end"]) for i in range(30)]
    docs += [(50, own[3]), (51, [f"x{k}" if k % 4 == 3 else w for k, w in enumerate(own[3])])]
    docs += [(60, [w for k in range(0, 36, 3) for w in (*own[0][k : k + 3], *["far"] * 40)])]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in own.items()], "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(df, bench).collect()}
    assert found == {(0, 0), (1, 1), (2, 2), (50, 3), (51, 3)} | {(10 + i, 2) for i in range(30)}
    assert [r.doc_id for r in decontaminate.clean(df, bench).collect()] == [60]


def test_bound_of_alignments():
    rng = np.random.default_rng(6)
    for _ in range(300):
        item, window = rng.integers(1, 9, rng.integers(1, 14)), rng.integers(0, 14, rng.integers(1, 40))
        score = decontaminate.align(item, window)[0]
        assert decontaminate.bound(*np.unique(item, return_counts=True), window) >= score == table_score(item, window)


def test_recall_of_edited_copies_against_whole_alignment():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(3000)]
    for rate in (0.1, 0.2, 0.3):
        accepted = found = 0
        for _ in range(300):
            own = rng.choices(words, k=rng.randrange(8, 31))
            copy = []
            for w in own:
                how = rng.choice(["replace", "drop", "add"]) if rng.random() < rate else "keep"
                copy += {"replace": ["other"], "drop": [], "add": [w, "other"], "keep": [w]}[how]
            items = decontaminate.Items([(0, " ".join(own).encode())])
            text = " ".join(rng.choices(words, k=60) + copy + rng.choices(words, k=60)).encode()
            numbers = decontaminate.numbers_of(text, decontaminate.Words(items.numbers))
            if decontaminate.align(items.words[0], numbers)[0] >= decontaminate.LEAST_SCORE * len(own):
                accepted += 1
                found += bool(items.matches(numbers))
        assert accepted > 250 and found >= 0.9 * accepted, (rate, found, accepted)
