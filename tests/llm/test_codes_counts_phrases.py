"""Token counts, vector codes and collocations beside brute force."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from evalspark.llm import collocations, token_counts, vector_codes
from evalspark.llm import textscan as ts

SCHEMA = "doc_id long, text string, lang string, n_tokens long, word string, key int"
VECTORS = "vec_id long, embedding array<double>, label int, code string, error long, key int, salt int"


def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def path(name):
    import public_tokenizers

    return public_tokenizers.path(name)


def texts() -> list:
    draw = random.Random(11)
    vocabulary = ["".join(draw.choice("abcdeñé") for _ in range(draw.randint(1, 8))) for _ in range(300)]
    mixed = " ".join(draw.choice([*vocabulary, "12", "it's", " x", "<|endoftext|>", "...\t", "\n\n  "]) for _ in range(40_000))
    return [None, "", " ", "a", "x <|endoftext|> y", "word " * 30_000, "z" * 70_000, "字" * 40_000, "  " * 40_000, " \n" * 50_000, mixed, mixed]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_token_counts(spark, name):
    rows = texts()
    docs = spark.createDataFrame([(i, t, "en", 1, "w", 1) for i, t in enumerate(rows)] + [(None, "null id", None, None, None, None)], SCHEMA)
    found = sorted(tuple(r) for r in token_counts.token_counts(docs, path(name), piece=5000, batch=20_000).collect() if r.doc_id is not None)
    if name.endswith(".model"):
        import sentencepiece

        plain = sentencepiece.SentencePieceProcessor(model_file=path(name))
        count = lambda t: len(plain.encode(t))
    else:
        from tokenizers import Tokenizer

        plain = Tokenizer.from_file(path(name))
        count = lambda t: len(plain.encode(t, add_special_tokens=False).ids)
    assert found == [(i, len((t or "").encode()), count(t or "")) for i, t in enumerate(rows)]
    assert token_counts.token_counts(docs, path(name)).where("doc_id IS NULL").count() == 1
    assert token_counts.token_counts(docs.limit(0), path(name)).count() == 0


@given(st.lists(st.sampled_from(["a", "é", "'s", "'", " ", "\n", " ", " ", "1", "!", "<|endoftext|>", "\x1c", "́"]), max_size=60))
@settings(max_examples=300, deadline=None)
def test_cuts_leave_tokens_alone(parts):
    text = "".join(parts)
    data = np.frombuffer(text.encode(), np.uint8)
    edges = token_counts.cuts(data, 3)
    pieces = [bytes(data[a:b]).decode() for a, b in zip(edges, edges[1:])]
    plain = tokenizer() if not hasattr(test_cuts_leave_tokens_alone, "t") else test_cuts_leave_tokens_alone.t
    test_cuts_leave_tokens_alone.t = plain
    ids = [i for p in pieces for i in plain.encode(p, add_special_tokens=False).ids]
    assert "".join(pieces) == text and ids == plain.encode(text, add_special_tokens=False).ids


def test_batches_have_nearly_equal_bytes():
    sizes = np.array(random.Random(1).choices(range(1, 400), k=5000))
    batches = token_counts.batches_of(sizes, 20_000)
    assert [a for a, _ in batches[1:]] == [b for _, b in batches[:-1]] and batches[0][0] == 0 and batches[-1][1] == len(sizes)
    assert max(sizes[a:b].sum() for a, b in batches) < 1.1 * min(sizes[a:b].sum() for a, b in batches)


def lloyd(rows, parts=8, entries=16, rounds=6):
    """Plain Python: the codes, errors and codebooks of the usable rows."""
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = -(-max([1, *(len(r[1]) for r in kept)]) // parts) * parts
    step = width // parts
    whole = [[math.floor(x * 4096) if abs(x) < 2**53 else int(x) * 4096 for x in r[1]] + [0] * (width - len(r[1])) for r in kept]
    cut = [[v[p * step : (p + 1) * step] for p in range(parts)] for v in whole]
    books = [[cut[i][p] for i in range(min(entries, len(cut)))] for p in range(parts)]

    def nearest(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, entry)), i) for i, entry in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            groups = collections.defaultdict(list)
            for v in cut:
                groups[nearest(v[p], books[p])[1]].append(v[p])
            books[p] = [[sum(c) // len(groups[i]) for c in zip(*groups[i])] if groups[i] else entry for i, entry in enumerate(books[p])]
    best = [[nearest(v[p], books[p]) for p in range(parts)] for v in cut]
    error = [min(2**63 - 1, sum(d for d, _ in b)) for b in best]
    by_label = collections.Counter()
    for r, e in zip(kept, error):
        by_label[r[2]] += e
    text = ",".join(str(x) for book in books for entry in book for x in entry)
    rows = [(r[0], bytes(i for _, i in b).hex(), e, min(2**63 - 1, by_label[r[2]])) for r, b, e in zip(kept, best, error)]
    return rows, hashlib.sha256(text.encode()).hexdigest()


def coded(spark, rows, **options):
    frame = spark.createDataFrame([(*r, "c", 1, 2, 3) for r in rows], VECTORS)
    codes, books = vector_codes.compress(frame, **options)
    out = vector_codes.with_label_errors(codes).select("vec_id", "codes", "error", "label_error").collect()
    return [(r[0], bytes(r[1]).hex(), r[2], r[3]) for r in out], vector_codes.digest(books)


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1:]))


def test_vector_codes(spark):
    draw = np.random.default_rng(3)
    centres = draw.normal(size=(20, 24))
    rows = [(i, (centres[i % 20] + draw.normal(size=24) * (0.01 if i % 3 else 0.5)).tolist(), i % 4 if i % 5 else None) for i in range(700)]
    rows += [rows[7], (7, [0.5] * 24, 2), (None, [0.25] * 24, 1), (-3, [0.0] * 24, 1), (900, None, 1), (901, [float("nan")] * 24, 1), (902, [None] * 24, 1), (903, [float("inf")] * 24, 0)]
    rows += [(904, [1.0] * 5, 1), (905, [], None), *[(1000 + i, [0.125] * 24, 3) for i in range(100)]]
    want, digest = lloyd(rows)
    found, own = coded(spark, rows, chunk=150, leaf=8)
    assert own == digest and ordered(found) == ordered(want)


def test_vector_codes_of_any_size(spark):
    """Components far beyond 64 bits are exact; ties go to the lower entry."""
    rows = [(i, [float(i % 5), -float(i % 3)] * 4, 0) for i in range(60)]
    rows += [(100, [1e39, -1e300] + [0.0] * 6, 1), (3, [3e9] * 8, 1), (200, [2.0**70 + 2.0**30] * 8, None)]
    want, digest = lloyd(rows)
    found, own = coded(spark, rows, chunk=20)
    assert own == digest and ordered(found) == ordered(want)
    assert coded(spark, rows[:3])[0] and ordered(coded(spark, rows[:3])[0]) == ordered(lloyd(rows[:3])[0])
    assert coded(spark, []) == ([], hashlib.sha256(b"").hexdigest())


@pytest.mark.parametrize("spread", [0, 1, 40, 3000])
def test_cover_tree(spread):
    """Children lie within half the reach of their parent and apart from each other; assignment is that of all pairs."""
    draw = np.random.default_rng(spread)
    points = (draw.integers(-spread, spread + 1, (400, 6)) + 1000 * draw.integers(0, 3, (400, 1))).astype(np.int64)
    order, nodes, radii = vector_codes.cover_tree(points, 6)
    assert sorted(order.tolist()) == list(range(400))
    points = points[order]
    for (low, end, first, count), radius in zip(nodes.tolist(), radii):
        far = np.sqrt(((points[low:end] - points[low]) ** 2).sum(axis=1)).max()
        assert far == pytest.approx(radius)
        heads = points[nodes[first : first + count, 0]]
        for i in range(count):
            assert radii[first + i] <= radius / 2 + 1e-9
            assert (np.sqrt(((heads[:i] - heads[i]) ** 2).sum(axis=1)) > radius / 2 - 1e-9).all()
    entries = np.concatenate([points[:5], points[:1], points[200:204] + 1])
    ranges, single, own = vector_codes.assign(points, nodes, radii, entries)
    best = np.full(400, -1)
    for low, end, entry in ranges.tolist():
        best[low:end] = entry
    best[single] = own
    assert best.tolist() == vector_codes.exact(points, entries)[0].tolist()
    if spread == 40:
        assert len(single) < 400


def phrases(rows, least, top):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    f, n = collections.Counter(), collections.Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(lower)):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in (1, 2, 3):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i : i + k])] += 1
    out = collections.defaultdict(list)
    for (lang, words), a in f.items():
        if len(words) < 2 or a < least:
            continue
        longer = [b for (other, w), b in f.items() if other == lang and len(w) == 3 and b >= least and len(words) == 2 and words in (w[:2], w[1:])]
        if any(100 * b >= 50 * a for b in longer):
            continue
        score, k = min((1_000_000 * a * a // (f[lang, words[:k]] * f[lang, words[k:]]), k) for k in range(1, len(words)))
        out[lang].append((-score, -a, " ".join(words).encode(), f[lang, words[:k]], f[lang, words[k:]]))
    return sorted((lang, i + 1, p.decode(), -a, le, r, n[lang], -s) for lang, own in out.items() for i, (s, a, p, le, r) in enumerate(sorted(own)[:top]))


def said() -> list[tuple]:
    draw = random.Random(4)
    vocabulary = ["New", "york", "city", "Á", "é", "of", "the", "x y", "'", "a-b", *map(str, range(12))]
    rows = []
    for i in range(250):
        words = draw.choices(vocabulary, [9, 9, 5, 1, 1, 8, 12, 1, 1, 1, *[2] * 12], k=draw.randint(0, 60))
        text = "".join(w + draw.choice([" ", " ", " ", "\t ", ", ", "\n", "  "]) for w in words)
        rows.append((text.replace("New ", "New york city ") if i % 2 else text, draw.choice(["en", "en", "en", "fr", None, "und", "d\te\n"])))
    return [*rows, rows[3], (None, "en"), ("", "none"), (" ., ", "none"), ("the " * 4000, "en"), ("no break " * 900, "long")]


@pytest.mark.parametrize("options", [{}, {"slice_bytes": 700, "range_bytes": 500, "union_bytes": 2000}])
def test_collocations(spark, options):
    rows = said()
    docs = spark.createDataFrame([(i, t, lang, 1, "w", 2) for i, (t, lang) in enumerate(rows)], SCHEMA).repartition(3)
    for top in (4, 2000):
        found = sorted(tuple(r) for r in collocations.collocations(docs, least=4, top=top, **options).collect())
        assert found == phrases(rows, 4, top)
    assert collocations.collocations(docs.limit(0)).count() == 0


def test_scores_beyond_64_bits(spark, monkeypatch):
    """Weights whose products pass 64 bits: the exact quotient."""
    n = 3_000_000_019
    weights = [("en", 0, "", 9 * n), ("en", 1, "a", n + 2), ("en", 1, "b", n + 7), ("en", 2, "a b", n)]
    monkeypatch.setattr(collocations, "frequent_phrases", lambda *_: spark.createDataFrame(weights, collocations.FREQUENT_SCHEMA))
    row = collocations.collocations(None).collect()
    assert [tuple(r) for r in row] == [("en", 1, "a b", n, n + 2, n + 7, 9 * n, 1_000_000 * n * n // ((n + 2) * (n + 7)))]


def test_equal_arcs_share_a_tail():
    text = pa.array(["a b c. d e c. f g c. a b c"])
    data, offsets = ts.buffers(text)
    piece = collocations.shard(data, offsets, pa.array(["en"]), 1)
    whole = collocations.Transducer.read(piece)
    assert len(whole.pairs) == 6 and len(whole.fans) == 3  # no arcs; c once; c twice
    twice = collocations.Transducer.united([whole, whole])
    count = {p.as_py(): n for words, phrases, weights in twice.frequent(1) for p, n in zip(phrases, weights.tolist())}
    assert count[b"a b c"] == 4 and count[b"d e c"] == 2 and count[b"b c"] == 4 and count[b"c"] == 8
