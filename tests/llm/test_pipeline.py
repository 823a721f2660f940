"""The stages of the corpus pipeline on odd, repeated and empty rows."""

from __future__ import annotations

import corpus_pipeline
import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, copies int, row string"
T, U, V = (" ".join(f"{c}{i} word" for i in range(50)) for c in "tuv")


@pytest.fixture
def docs(rows):
    return lambda data: rows([(*x, 1, 2, "r") for x in data], SCHEMA)


DATA = [(3, T, "en", "a"), (5, T + " more", "en", "a"), (5, U, "de", "b"), (7, U + " more", "de", None), (7, V, None, "b"), (None, V, "en", "a"), (None, None, "en", "a"), (8, "", "en", "a"), (9, "123 !!", "en", "a")]


def test_language_keeps_what_has_letters(spark, docs):
    out = corpus_pipeline.language_stage(spark, docs(DATA), "")
    assert sorted((x.doc_id or 0, x.text) for x in out.collect()) == sorted((i or 0, t) for i, t, _, _ in DATA if t and any(c.isalpha() for c in t))
    assert out.columns == docs(DATA).columns


def test_near_duplicates_lose_no_text(spark, docs):
    out = corpus_pipeline.near_duplicate_stage(spark, docs(DATA), "").collect()
    # the texts of one id are told apart; null ids and empty texts stay
    assert sorted((x.doc_id or 0, x.text or "") for x in out) == sorted([(3, T), (5, U), (7, V), (0, V), (0, ""), (8, ""), (9, "123 !!")])


def test_mixing_counts_rows(spark, docs):
    out = corpus_pipeline.mixing_stage(spark, docs(DATA * 20), "")
    words = sum(len((x.text or "").split()) for x in out.collect())
    assert abs(words - 1.5 * 20 * sum(len((t or "").split()) for _, t, _, _ in DATA)) <= 900
    assert out.columns == docs(DATA).columns


def test_packing_has_every_row(spark, docs):
    out = corpus_pipeline.packing_stage(spark, docs(DATA), "").collect()
    assert sum(x.length for x in out) == sum(x.doc_tokens for x in out if x.start == 0) and sum(x.start == 0 for x in out) == len(DATA)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_empty(spark, docs, name):
    assert dict(corpus_pipeline.STAGES)[name](spark, docs([]), "").count() == 0


def test_ties_and_equal_rows(spark, docs):
    out = corpus_pipeline.near_duplicate_stage(spark, docs([(1, T, "en", "a")] * 5 + [(2, T, "en", "a")]), "").collect()
    assert [x.doc_id for x in out] == [1]
