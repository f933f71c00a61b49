"""Rows whose names once met, line arrays whose keys meet, and whole pages beside a plain reading of their article."""

import html
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from evalspark.llm import html_text, line_dedup, minhash, substring_dedup

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def meeting(spark):
    """Two texts of four words with one 32-bit hash."""
    text = F.concat_ws(" ", F.lit("clean"), F.md5(F.col("id").cast("string")), F.lit("and"), F.col("id").cast("string"))
    pairs = spark.range(300_000).select(text.alias("t")).groupBy(F.hash("t")).agg(F.collect_list("t").alias("t")).where("size(t) > 1")
    return sorted(pairs.first()["t"])


def test_rows_of_one_id_and_hash_stay_apart(spark, meeting):
    first, second = meeting
    line = "a line that many documents hold"
    for i in (None, 7):
        rows = [(i, first), (i, f"{second}"), (8, f"{line}\nx"), (9, f"{line}\ny"), (10, f"{line}\nz"), (i, f"{line}\n{first}")]
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        out = line_dedup.dedup(docs).select("doc_id", "kept_text", "n_dropped").collect()
        assert sorted((r.kept_text, r.n_dropped) for r in out if r.doc_id == i) == sorted([(first, 0), (second, 0), (first, 1)])
        stage = line_dedup.stage(spark, docs, SF)
        assert sorted(r.text for r in stage.where(F.col("doc_id").eqNullSafe(F.lit(i))).collect()) == sorted([first, second, first])


def test_passages_of_rows_of_one_id_and_hash(spark, meeting):
    passage = " ".join(f"w{n}" for n in range(60))
    first, second = meeting
    for i in (None, 7):
        rows = [(i, first), (i, second), (i, f"{passage} tail"), (3, f"head {passage}"), (i, " ".join(f"x{n}" for n in range(300)))]
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        out = substring_dedup.dedup(docs).select("doc_id", "kept_text", "n_removed").collect()
        assert sorted((r.n_removed, r.kept_text) for r in out) == sorted([(0, first), (0, second), (60, "tail"), (60, "head"), (0, rows[4][1])])
        assert sorted(r.text for r in substring_dedup.stage(spark, docs, SF).collect()) == sorted([first, second, "tail", "head", rows[4][1]])


def test_every_row_counts_as_a_document(spark):
    line = "a line that three rows of documents hold"
    docs = spark.createDataFrame([(1, line), (1, f"{line}\nx"), (2, line)], "doc_id long, text string")
    out = sorted((r.doc_id, r.kept_text) for r in line_dedup.dedup(docs).collect())
    assert out == [(1, ""), (1, "x"), (2, line)]


def test_keys_that_meet_in_one_number_get_another_seed(monkeypatch):
    plain = line_dedup.folded
    monkeypatch.setattr(line_dedup, "folded", lambda h1, h2, seed: plain(h1, h2, seed) if seed > 1 else h1 & np.uint64(1))
    frame = pd.DataFrame({"h1": np.arange(500), "h2": np.arange(500) % 3, "n": 5, "keeper": 1})
    row = line_dedup.build_shard((0,), frame).iloc[0]
    assert row["seed"] == 2 and len(row["prints"]) == 500 * 16


def test_hundred_thousand_rows_of_one_prefix(spark):
    """A prefix with more distinct runs than a subtree holds: the same windows by full depth."""
    head = " ".join(f"h{n}" for n in range(40))
    rows = [(n, f"{head} {' '.join(f'{n}x{m}' for m in range(40))}") for n in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for bound in (5, 20_000):
        out = substring_dedup.dedup(docs, subtree_runs=bound).collect()
        assert {r.n_removed for r in out} == {40} and len(out) == 300


def test_kept_is_a_matter_of_ids(spark):
    base = " ".join(f"w{n}" for n in range(100))
    docs = spark.createDataFrame([(7, base), (7, base + " more"), (9, base + " else")], "doc_id long, text string")
    out = {(r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(docs, words=4).collect()}
    assert out == {(7, 7, True), (9, 7, False)}


def plain_article(page: str) -> str:
    """The article's blocks by a plain reading of the test pages' markup, adverts and comments cut out first."""
    body = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    body = re.sub(r"<div class=\"?(?:ad|comments?)\"?[^>]*>.*?</div>|<!--.*?-->|<(script|style|form|aside)\b.*?</\1>", "\0", body, flags=re.S)
    parts = re.split(r"\0|</?(?:p|h[1-6]|li|ul|ol|div|table|tr|td|th|blockquote|section|pre)\b[^>]*>", body)
    texts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", re.sub(r"<br ?/?>", " ", x))).split()) for x in parts]
    return "\n".join(t for t in texts if t)


def test_pages_keep_their_whole_article(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    found = {r.page_id: r.text for r in html_text.extracted(pages).collect()}
    assert all(found[r.page_id] == plain_article(r.html) for r in pages.collect()) and len(found) == pages.count()


def test_quotes_inside_unquoted_values(spark):
    prose = "This is the story of a river that was hidden in the hills and of the people who have lived by it."
    assert html_text.extract("<p>A first text.</p><a title=It's href=x>Main text here</a> and it's <b>more</b>") == "A first text.\nMain text here and it's more"
    assert html_text.extract(f"<article><p>{prose}</p><p title=It's>{prose}</p><p data-a='x>y' data-b=\"'>\">{prose}</p></article>") == "\n".join([prose] * 3)
    names = "Lopez 1 Meier 2 Rossi 3 Novak 4 Ivanov 5 Tanaka 6 Kim 7 Nguyen 8 Silva 9 Haddad 10 Okafor 11 Larsen 12"
    assert html_text.extract(f"<article><p>{prose}</p><p>{names}</p><p>{prose}</p></article>") == f"{prose}\n{names}\n{prose}"
    empty = html_text.extracted(spark.createDataFrame([], "page_id long, url string, html string, text string, n_chars long"))
    assert empty.count() == 0 and empty.columns == ["page_id", "url", "text"]
