"""The training-data operators beside brute force, on small fixtures with nulls, ties, repeats and clashing columns."""

import collections
import random
import re
import zlib

import numpy as np
import pytest

from evalspark.llm import byte_bpe, html_text, line_dedup, minhash, packing, quality_model, quality_rules, substring_dedup, url_filter, vector_graph
from evalspark.llm import graph

WORDS = re.compile("[^\x20\x09-\x0d]+")
SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row int, whole string, bits long"


def corpus() -> list[tuple]:
    """Texts with copies, near copies, shared passages, self-repeats, blanks, nulls, one very long text and a repeated row."""
    draw = random.Random(5)
    vocabulary = ["".join(draw.choice("abcdeñé") for _ in range(draw.randint(2, 7))) for _ in range(400)]
    say = lambda n: " ".join(draw.choice(vocabulary) for _ in range(n))
    passage, line = say(70), "  A line that many Documents hold \t"
    texts = [None, "", " \t\n", "one", "one two three", "ab " * 120, "\n\n", line.strip().lower()]
    for _ in range(12):
        texts.append("\n".join([say(60), line, say(30)]))
    base = say(120).split(" ")
    for i in range(6):
        near = list(base)
        near[3 * i] = "changed"
        texts.append(" ".join(near))
    texts += [texts[9], texts[9], f"{say(20)} {passage} {say(20)}", f"{say(5)}\n{passage} {say(40)}", f"{passage} x {passage}", say(6000)]
    rows = [(i, t, "en", "src0", len(t or ""), 1, "w", 2) for i, t in enumerate(texts)]
    return [*rows, rows[10], (None, texts[9], None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words_of(text):
    return WORDS.findall(text or "")


def test_line_dedup(docs, empty):
    rows = corpus()
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(lower)
    holders = collections.defaultdict(list)
    for doc_id, text, *_ in rows:
        for k in {key(x) for x in (text or "").split("\n")}:
            holders[k].append(-1 if doc_id is None else doc_id)
    want = collections.Counter()
    for doc_id, text, *_ in rows:
        lines = (text or "").split("\n")
        own = -1 if doc_id is None else doc_id
        kept = [x for x in lines if len(key(x)) < 20 or len(holders[key(x)]) < 3 or max(holders[key(x)]) == own]
        want[(doc_id, "\n".join(kept), len(lines), len(lines) - len(kept))] += 1
    for options in ({}, {"shard_keys": 1, "salts": 3}):
        got = collections.Counter((r.doc_id, r.kept_text, r.n_lines, r.n_dropped) for r in line_dedup.dedup(docs, **options).collect())
        assert got == want
    assert sum(n for *_, n in want) > 10
    assert line_dedup.dedup(empty).count() == 0


def test_perfect_hash_is_minimal():
    keys = np.random.Generator(np.random.PCG64(1)).integers(0, 1 << 63, 5000, dtype=np.uint64)
    hashed = line_dedup.PerfectHash.build(keys[:4000])
    assert sorted(hashed.numbers(keys[:4000])) == list(range(4000))
    again = line_dedup.PerfectHash(hashed.sizes, hashed.bits)
    assert (again.numbers(keys) < 4000).all()
    assert len(line_dedup.PerfectHash.build(keys[:0]).numbers(keys[:3])) == 3


def test_substring_dedup(docs, empty):
    rows, window = corpus(), 35
    seen = collections.Counter()
    for _, text, *_ in rows:
        w = words_of(text)
        seen.update(tuple(w[i : i + window]) for i in range(len(w) - window + 1))
    want = collections.Counter()
    for doc_id, text, *_ in rows:
        w = words_of(text)
        gone = {i + j for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for j in range(window)}
        want[(doc_id, " ".join(x for i, x in enumerate(w) if i not in gone), len(w), len(gone))] += 1
    for options in ({}, {"subtree_runs": 1, "chunk_words": 100}):
        assert collections.Counter((r.doc_id, r.kept_text, r.n_words, r.n_removed) for r in substring_dedup.dedup(docs, **options).collect()) == want
    assert substring_dedup.dedup(empty).count() == 0


def shingles(text, n):
    w = words_of("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


@pytest.mark.parametrize("n", [4, 5])
def test_minhash(docs, empty, n):
    rows = [(-(1 << 63) if r[0] is None else r[0], r[1]) for r in corpus()]
    sets = [shingles(t, n) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]) or rows[i][0] == rows[j][0]:
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    low = collections.defaultdict(list)
    for i, (doc_id, _) in enumerate(rows):
        low[find(i)].append(doc_id)
    plain = lambda i: None if i == -(1 << 63) else i
    want = collections.Counter((plain(d), len(sets[i]), plain(min(low[find(i)])), d == min(low[find(i)])) for i, (d, _) in enumerate(rows))
    assert collections.Counter(tuple(r) for r in minhash.near_duplicates(docs, words=n).collect()) == want
    assert minhash.near_duplicates(empty).count() == 0


def test_minhash_stage_keeps_unlike_rows_of_one_id(spark):
    draw = random.Random(8)
    say = lambda: " ".join(str(draw.randrange(10**6)) for _ in range(60))
    null, other, twice, unlike, alone = say(), say(), say(), say(), say()
    near = " ".join([*null.split(" ")[:-1], "changed"])
    rows = [(None, null), (None, other), (None, other), (None, None), (1, near), (7, twice), (7, unlike), (7, unlike), (8, twice), (9, alone), (9, "")]
    frame = spark.createDataFrame([(i, t, "en", "s", len(t or ""), k, "w", k) for k, (i, t) in enumerate(rows)], SCHEMA)
    got = minhash.stage(spark, frame, "")
    assert got.columns == frame.columns
    want = [(None, null), (None, other), (None, None), (7, twice), (7, unlike), (9, alone), (9, "")]
    assert collections.Counter((r.doc_id, r.text) for r in got.collect()) == collections.Counter(want)
    named = {(r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(frame).collect()}
    assert {(1, None, False), (8, 7, False), (9, 9, True)} <= named


def test_sketches_fill_and_estimate():
    draw = np.random.Generator(np.random.PCG64(3))
    a = draw.integers(0, 1 << 63, 900, dtype=np.uint64)
    sets = [np.sort(a[:800]), np.sort(a[100:]), a[:1], a[:0]]
    s = minhash.sketches(np.concatenate(sets), np.cumsum([0, *map(len, sets)]), 128)
    assert (s[:3] != np.iinfo(np.uint64).max).all() and (s[3] == np.iinfo(np.uint64).max).all()
    assert abs((s[0] == s[1]).mean() - 700 / 900) < 0.15


def test_components(rows):
    edges = [(i, i + 1) for i in range(0, 30)] + [(50, 60), (60, 55), (7, 7)]
    got = {r.id: r.component for r in graph.components(rows("a long, b long", *edges)).collect()}
    assert got == {**{i: 0 for i in range(31)}, 50: 50, 55: 50, 60: 50}
    assert graph.components(rows("a long, b long")).count() == 0


@pytest.fixture(scope="module")
def tokenizer():
    tokenizers = pytest.importorskip("tokenizers")
    loaded = tokenizers.Tokenizer.from_file(packing.default_tokenizer())
    loaded.encode_special_tokens = True
    return loaded


@pytest.mark.parametrize("length,room", [(2048, 32), (64, 2)])
def test_packing(docs, empty, tokenizer, length, room):
    pieces = packing.pack(docs.coalesce(1), packing.default_tokenizer(), length, room).collect()
    want = collections.Counter((r[0], np.array(tokenizer.encode(r[1] or "", add_special_tokens=False).ids + [1], "<u4").tobytes()) for r in corpus())
    windows, total = collections.defaultdict(list), collections.Counter()
    texts = {k[0]: [c for d, c in want if d == k[0]] for k in want}
    for p in pieces:
        windows[p.sequence_id].append(p)
        total[p.doc_id] += p.length
        assert any(c[4 * p.start : 4 * (p.start + p.length)] == bytes(p.ids) and len(c) == 4 * p.doc_tokens for c in texts[p.doc_id])
    assert total == sum((collections.Counter({d: len(c) // 4 * n}) for (d, c), n in want.items()), collections.Counter())
    for held in windows.values():
        at = 0
        for p in sorted(held, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= length and (at == length or at & (at - 1) == 0)
    assert packing.pack(empty, packing.default_tokenizer()).count() == 0


def test_packing_codes_added_tokens():
    tokenizers = pytest.importorskip("tokenizers")
    plain = tokenizers.Tokenizer.from_file(packing.default_tokenizer())
    texts = ["x <|endoftext|> y", "<|endoftext|>", "a b<|endoftext|><|endoftext|>c d", "x <|endoftext| y", "", "a word"]
    want = [np.array(plain.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert list(packing.encoder(packing.default_tokenizer())(texts)) == want


def test_byte_bpe(docs, empty):
    tiktoken = pytest.importorskip("tiktoken")
    import public_tokenizers

    path = byte_bpe.default_ranks()
    ranks = byte_bpe.read_ranks(path)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = collections.Counter((r[0], tuple(library.encode_ordinary(r[1] or ""))) for r in corpus())
    for frequent in (1, 8):
        coded = byte_bpe.encode(docs, path, frequent).withColumn("back", byte_bpe.decoded(byte_bpe.F.col("ids"), path)).collect()
        assert collections.Counter((r.doc_id, tuple(r.ids)) for r in coded) == want
        assert all(bytes(r.back or b"") == library.decode_bytes(r.ids) for r in coded)
    for piece in ("a" * 500, "ñandú" * 60, "x   y你好" * 40):
        whole = tiktoken.Encoding("one", pat_str="(?s).+", mergeable_ranks=ranks, special_tokens={}).encode_ordinary(piece)
        assert byte_bpe.merge_long(piece.encode(), ranks) == whole == byte_bpe.merge_piece(piece.encode(), ranks)
    assert byte_bpe.encode(empty, path).count() == 0


def test_quality_rules(docs, empty):
    got = {(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality_rules.ledger(docs).collect()}
    want = set()
    for doc_id, text, *_ in corpus():
        text, w = text or "", words_of(text)
        triples = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        covered = {i + j for i in range(len(w) - 2) if triples[tuple(w[i : i + 3])] > 1 for j in range(3)}
        lines = [x for x in text.split("\n") if words_of(x)]
        want.add((doc_id, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)))
    assert got == want
    rows = quality_rules.ledger(docs)
    ablated = {r.rule: (r.failed, r.only) for r in quality_rules.ablation(rows, "v1").collect()}
    few = [r for r in rows.collect() if r.n_words < 50]
    assert ablated["few_words"][0] == len(few) and ablated["few_words"][1] == sum(r.bits == 1 for r in few)
    assert quality_rules.ledger(empty).count() == 0


def test_quality_model(spark, docs, empty):
    labels = spark.createDataFrame([(i, 1 if i % 2 else 0, 0) for i in range(30)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    model = quality_model.train(docs, labels)
    rows = quality_model.scored(docs, model).collect()
    assert len(rows) == len(corpus()) and all(0 <= r.score <= 1 for r in rows)
    none = quality_model.train(docs, labels.where("quality = 1"))
    assert {r.score for r in quality_model.scored(docs, none).collect()} == {0.5}
    assert quality_model.scored(empty, none).count() == 0
    held = spark.range(20).select("id", quality_model.held_out(quality_model.F.col("id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 3 == 1) for r in held)


def test_quality_model_separates(spark):
    frame = quality_model.query(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in frame) >= 0.9 * len(frame)


def test_url_filter(spark):
    urls = [
        (1, "http://www.Example.ORG/en/1299/?q"), (2, "https://example.org/es/x#y"), (3, "https://a.b.org/z"), (4, "http://x.com/de/1"), (5, "http://x.com/fr"),
        (6, "http://casino-win.net/"), (7, None), (8, "no scheme"), (9, "http://org?x=/"), (10, "ftp://notexample.org/es/"), (11, "http://x.com/fr/1"), (11, "http://x.com/fr/1"),
    ]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filtered(spark, spark.createDataFrame(urls, "page_id long, url string")).collect()}
    assert got[1] == ("www.example.org", "/en/1299/", "example.org/en/1", "block")
    assert got[2][2:] == ("example.org/es/", "block") and got[3][2:] == ("org/", "allow") and got[4][2:] == ("com/de/", "block")
    assert got[5] == ("x.com", "/fr", None, "allow") and got[6][2:] == (None, "block")
    assert got[7] == ("", "", None, "allow") == got[8] and got[9] == ("org", "", None, "allow") and got[10][2:] == ("org/", "allow")


def test_digest_collisions_are_confirmed(tmp_path):
    same = lambda key: len(key)
    (tmp_path / "d").write_bytes(url_filter.Digests.packed({b"ab": 1, b"cd": 2, b"e": 3}, same))
    assert url_filter.Digests(str(tmp_path / "d")).probe([b"cd", b"ab", b"zz", b"e", b""], same).tolist() == [2, 1, -1, 3, -1]
    (tmp_path / "none").write_bytes(url_filter.Digests.packed({}))
    assert url_filter.Digests(str(tmp_path / "none")).probe([b"x"]).tolist() == [-1]


def test_html(spark):
    page = (
        "<html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1></header><nav><a href='/'>Home</a></nav>"
        "<div class='cookie-notice'>We use the cookies of all</div><article><header><h1>Head &amp; tail</h1></header><p>First  <b>part\n here<br>"
        "<p>Sh.</p><script>var t='</p>';</script><aside>Related</aside><form><input value='x>y'>Mail</form></article>"
        "<section id=comments><article><p>A reader says it.</p></article></section><footer>&copy; us</footer><fo"
    )
    assert html_text.extract(page) == "Head & tail\nFirst part here\nSh."
    assert html_text.extract("") == "" and html_text.extract("a < b &lt; c") == "a < b < c" and html_text.extract("<!-- x") == ""
    got = html_text.extracted(spark.createDataFrame([(1, None, None), (2, "u", page)], "page_id long, url string, html string")).collect()
    assert [r.text for r in sorted(got, key=lambda r: r.page_id)][0] == ""


PROSE = "This is the story of a river that was hidden in the hills and of the people who have lived by it."


def test_html_rules_run_inside_articles():
    share = "Print Save Email Copy Share Tweet Pin Mail Archive Download Translate Zoom Bookmark Subscribe"
    menu = "<p><a href='/a'>The other page of this site</a> <a href='/b'>and the next of it</a></p>"
    page = f"<body><article><h1>River</h1><p>{PROSE}</p><p>Short.</p><p>{PROSE}</p><div>{share}</div>{menu}</article><p>Top</p></body>"
    assert html_text.extract(page) == f"River\n{PROSE}\nShort.\n{PROSE}"
    # Text outside the mark is judged by the same rules; short text there needs good text on both sides.
    assert html_text.extract(f"<p>Menu</p><h1>River</h1><p>{PROSE}</p><article><p>{PROSE}</p></article>") == f"River\n{PROSE}\n{PROSE}"
    # Where no block has stop words, their absence decides nothing.
    assert html_text.extract(f"<article><p>{share}</p></article>") == share


def test_html_hints_only_raise_doubts():
    text = f"<h1>River</h1><p>{PROSE}</p><p>{PROSE}</p>"
    whole = f"River\n{PROSE}\n{PROSE}"
    ad = "<div class='ad'><p>Buy the best of it.</p></div>"
    for layout in ("div class='layout has-sidebar'", "article class='post category-social'", "article class='tag-search'", "form id='aspnetForm'", "div title='The hidden river' data-id='search-12'"):
        tag = layout.split()[0]
        assert html_text.extract(f"<body><{layout}>{text}{ad}</{tag}><footer>Us</footer></body>") == whole, layout
    assert html_text.extract(f"<nav>Top</nav><div class='entry-header'><h1>River</h1></div><p>{PROSE}</p>") == f"River\n{PROSE}"
    assert html_text.extract(f"<nav>Top</nav><div class='page-header'><h1>River</h1></div><p>{PROSE}</p>") == f"River\n{PROSE}"
    assert html_text.extract(f"{text}<p>{PROSE}</p><div class='comments'><p>{PROSE}</p></div>") == f"{whole}\n{PROSE}"
    assert html_text.extract(f"{text}<p hidden>{PROSE}</p><p style='display:none'>{PROSE}</p>") == whole


def test_vectors(spark):
    draw = np.random.Generator(np.random.PCG64(2))
    centres = draw.normal(size=(12, 16))
    points = [(c + draw.normal(size=16) * s).astype(np.float32).tolist() for c in centres for s in (0.02, 0.05, 0.1, 0.2, 0.3) for _ in range(5)]
    points += [points[0], points[0], None, [0.0] * 16, [float("nan")] * 16, [None] * 16, [], [1.0, 2.0], [1.0, 2.1]]
    frame = spark.createDataFrame(list(enumerate(points)), "vec_id long, embedding array<float>")
    good = {i: np.array(p, float) / np.linalg.norm(p) for i, p in enumerate(points) if p and None not in p and np.isfinite(p).all() and any(p)}
    want = {i: [j for j in good if j != i and len(good[i]) == len(good[j]) and good[i] @ good[j] >= 0.95] for i in good}
    for options in ({}, {"block": 20}):
        result = vector_graph.near_duplicates(frame, **options)
        got = {r.vec_id: r for r in result.collect()}
        assert len(got) == len(points)
        true, found = sum(map(len, want.values())), sum(got[i].n_links for i in want)
        assert all(got[i].n_links <= len(want[i]) for i in want) and found >= 0.9 * true
        assert all(r.n_links == 0 and r.kept for i, r in got.items() if i not in good)
        assert vector_graph.recall(frame.where("vec_id < 300"), result) >= 0.9
    assert vector_graph.near_duplicates(frame.where("vec_id < 0")).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, SF)
        assert kept.columns == docs.columns
        kept = spark.createDataFrame(kept.collect(), docs.schema)
    by_hand = {(r.doc_id, r.start, r.length, bytes(r.ids)) for r in corpus_pipeline.STAGES[-1][1](spark, kept, SF).collect()}
    ran = {(r.doc_id, r.start, r.length, bytes(r.ids)) for r in corpus_pipeline.run(spark, SF).collect()}
    whole = lambda rows: {d: b"".join(ids for _, _, _, ids in sorted(r for r in rows if r[0] == d)) for d in {r[0] for r in rows}}
    assert whole(ran) == whole(by_hand)
    texts = {r.doc_id: r.text for r in kept.collect()}
    assert 0.5 * docs.count() < len(texts) < docs.count()
