"""The classifier and every stage of the pipeline beside versions in plain Python."""

import collections
import math
import random
import re
import string

import numpy as np
import pytest

from evalspark.llm import line_dedup, minhash, packing, quality_model, substring_dedup

WORD = re.compile("[^\\x20\\x09-\\x0D]+")
A_TO_Z = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row int, whole string, score double, x int"
CLASSES = [set(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), set(b"0123456789"), set(b"#*$%&|<>@^~_=+{}[]\\/"), set(b"!?"), set(b".,;:'\"-()"), {10}, set(range(192, 256))]


def rows():
    """Good and bad texts, near and exact copies, shared lines and passages, null and repeated ids, blanks, a long text."""
    draw = random.Random(3)
    vocabulary = ["".join(draw.choice("abcdefgé") for _ in range(draw.randint(2, 8))) for _ in range(500)]
    say = lambda n: " ".join(draw.choice(vocabulary) for _ in range(n)).capitalize() + "."
    line, passage = "A line that Many documents hold", say(60)
    texts = [f"{say(40)}\n{line}\n{say(30)}" if i % 3 else f"{say(50)}\n{say(45)}" for i in range(24)]
    base = say(150).split(" ")
    texts += [" ".join("changed" if j in (3 * i, 70 + i) else w for j, w in enumerate(base)) for i in range(5)]
    texts += [f"{say(25)} {passage} {say(25)}" for _ in range(4)] + [texts[1], texts[1], say(9000)]
    texts += [" ".join("#$%!" * draw.randint(1, 3) + str(draw.randint(0, 99)) for _ in range(40)) for _ in range(20)]
    found = [(i, t) for i, t in enumerate(texts)]
    found += [(900, None), (901, ""), (902, " \n\t"), (None, say(60)), (None, say(70)), (None, texts[2]), (5, say(80)), (5, say(80)), (7, texts[7])]
    return [(i, t, "en", "s", None if t is None else len(t), 1, "w", 0.25, 3) for i, t in found]


def features(text):
    data = (text or "").encode()
    words = [w.encode() for w in WORD.findall(text or "")]
    n, size = max(len(words), 1), max(len(data), 1)
    out = [math.log1p(len(words)), sum(map(len, words)) / n]
    out += [math.log1p(100 * sum(b in members for b in data) / size) for members in CLASSES]
    out += [math.log1p(100 * sum(a == b for a, b in zip(words, words[back:])) / n) for back in (1, 2, 3)]
    return [*out, math.log1p(100 * sum(len(w) > 20 for w in words) / n)]


def strength(model, text):
    return sum((f - m) / s * w for f, m, s, w in zip(features(text), model["mean"], model["scale"], model["weight"]))


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows(), SCHEMA).write.parquet(f"{path}/documents.parquet")
    labels = [(i, int("#$%" not in (t or "")), 0) for i, t, *_ in rows() if i is not None] + [(None, 1, 0), (0, None, 0), (1, 7, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_fit_in_plain_python():
    draw = np.random.Generator(np.random.PCG64(4))
    y = np.array([i % 2 for i in range(60)])
    x = draw.normal(size=(60, 3)) + np.outer(y, [1.0, 0.5, 0.0])
    model = quality_model.fit(x, y, pairs=2000)
    # The same pairs, drawn once more; steps downhill on the loss of plain sums.
    z = [[(v - m) / s for v, m, s in zip(row, model["mean"], model["scale"])] for row in x]
    again = np.random.Generator(np.random.PCG64(7))
    good, bad = again.choice(np.flatnonzero(y == 1), 2000), again.choice(np.flatnonzero(y == 0), 2000)
    gaps = [[a - b for a, b in zip(z[g], z[h])] for g, h in zip(good, bad)]
    weight = [0.0, 0.0, 0.0]
    for _ in range(400):
        slope = [1e-3 * w for w in weight]
        for gap in gaps:
            p = 1 / (1 + math.exp(sum(g * w for g, w in zip(gap, weight))))
            for i in range(3):
                slope[i] -= gap[i] * p / 2000
        weight = [w - 1.5 * s for w, s in zip(weight, slope)]
    assert np.allclose(weight, model["weight"], atol=1e-3)
    value = [sum(a * w for a, w in zip(row, model["weight"])) for row in z]
    right = lambda t: sum((v >= t) == (label == 1) for v, label in zip(value, y))
    assert right(model["threshold"]) == max(right(t) for t in [*value, math.inf])


def test_scores_in_plain_python(spark, tables):
    docs, labels = spark.read.parquet(f"{tables}/documents.parquet"), spark.read.parquet(f"{tables}/labels.parquet")
    model = quality_model.train(docs, labels)
    got = collections.Counter((r.doc_id, round(r.score, 6)) for r in quality_model.scored(docs, model).collect())
    score = lambda t: round(1 / (1 + math.exp(-max(-500, min(500, strength(model, t) - model["threshold"])))), 6)
    assert got == collections.Counter((i, score(t)) for i, t, *_ in rows())


def test_a_repeated_label_stays_bounded(spark):
    docs = spark.range(5000).selectExpr("3L as doc_id", "concat('text ', id) as text").union(spark.range(50).selectExpr("id + 10", "if(id % 2 = 0, '# # #', 'a fine text')"))
    labels = spark.range(80).selectExpr("id as doc_id", "cast(id % 2 as int) as quality")
    got = []
    fit = quality_model.fit
    try:
        quality_model.fit = lambda x, y: got.append(len(y)) or fit(x, y)
        quality_model.train(docs, labels, rows=40)
    finally:
        quality_model.fit = fit
    assert got and got[0] <= 40


def test_every_stage_in_plain_python(spark, tables):
    import corpus_pipeline

    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_model", "line_dedup", "minhash", "substring_dedup", "packing"]
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    pair = lambda found: collections.Counter((r.doc_id, r.text) for r in found)
    again = lambda found: spark.createDataFrame(found, SCHEMA)

    model = quality_model.train(docs, spark.read.parquet(f"{tables}/labels.parquet"))
    accepted = quality_model.stage(spark, docs, tables).collect()
    assert pair(accepted) == collections.Counter((i, t) for i, t, *_ in rows() if strength(model, t) >= model["threshold"])
    assert 20 < len(accepted) < len(rows())
    assert all("#$%" not in (r.text or "") for r in accepted)

    # Lines, over all rows, so that blanks and null ids are there whatever the classifier said.
    source = docs.collect()
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(A_TO_Z)
    number = lambda i: -math.inf if i is None else i
    holders = collections.defaultdict(list)
    for r in source:
        for k in {key(x) for x in (r.text or "").split("\n")}:
            holders[k].append(number(r.doc_id))
    stays = lambda r, k: len(k) < 20 or len(holders[k]) < 3 or max(holders[k]) == number(r.doc_id)
    lined = line_dedup.stage(spark, docs, tables).collect()
    assert pair(lined) == collections.Counter((r.doc_id, "\n".join(x for x in (r.text or "").split("\n") if stays(r, key(x)))) for r in source)
    assert all(r.n_chars == len(r.text) for r in lined)

    # Near copies: one row of each group stays, of its smallest id; all else stays.
    unlike = list(dict.fromkeys((r.doc_id, r.text) for r in lined))
    sets = []
    for _, text in unlike:
        w = WORD.findall(text.translate(A_TO_Z))
        sets.append({tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set())
    group = list(range(len(unlike)))
    for i in range(len(unlike)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                low, high = sorted((group[i], group[j]))
                group = [low if g == high else g for g in group]
    single = minhash.stage(spark, again(lined), tables).collect()
    members = collections.defaultdict(list)
    for row, g in zip(unlike, group):
        members[g].append(row)
    kept = {(r.doc_id, r.text) for r in single}
    assert len(kept) == len(single) == len(members) < len(unlike)
    for held in members.values():
        stay = [row for row in held if row in kept]
        assert len(stay) == 1 and number(stay[0][0]) == min(number(i) for i, _ in held)

    seen = collections.Counter()
    for r in single:
        w = WORD.findall(r.text)
        seen.update(tuple(w[i : i + 35]) for i in range(len(w) - 34))
    want = collections.Counter()
    for r in single:
        w = WORD.findall(r.text)
        gone = {i + j for i in range(len(w) - 34) if seen[tuple(w[i : i + 35])] > 1 for j in range(35)}
        want[(r.doc_id, " ".join(x for i, x in enumerate(w) if i not in gone))] += 1
    cut = substring_dedup.stage(spark, again(single), tables).collect()
    assert pair(cut) == want != pair(single)

    tokenizers = pytest.importorskip("tokenizers")
    plain = tokenizers.Tokenizer.from_file(packing.default_tokenizer())
    ids = collections.Counter((r.doc_id, tuple(plain.encode(r.text or "", add_special_tokens=False).ids + [1])) for r in cut)
    pieces = packing.stage(spark, again(cut).coalesce(1), tables).collect()
    windows, total = collections.defaultdict(list), collections.Counter()
    for p in pieces:
        value = tuple(np.frombuffer(bytes(p.ids), "<u4").tolist())
        assert len(value) == p.length and any(i == p.doc_id and whole[p.start : p.start + p.length] == value for i, whole in ids)
        windows[p.sequence_id].append((p.offset, p.length))
        total[p.doc_id] += p.length
    assert total == sum((collections.Counter({i: n * len(whole)}) for (i, whole), n in ids.items()), collections.Counter())
    for held in windows.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 2048


def test_stages_of_an_empty_table(spark, tables):
    import corpus_pipeline

    docs = spark.createDataFrame([], SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        found = stage(spark, docs, tables)
        assert found.count() == 0
        assert name == "packing" or found.columns == docs.columns
