"""Ranked search against plain counting."""

import random

import brute
import numpy as np
import pytest

from tableviews.llm import automaton_ranking as ranking
from tableviews.llm import shared

DOCS = "doc_id long, text string, n int, terms string, score double, item long"
ITEMS = "item_id long, text string, doc_id int, term string"


@pytest.fixture(scope="module")
def session(spark):
    shared.ship_package(spark)
    return spark


def ranked(session, docs, items, **options):
    docs = session.createDataFrame([(d, t, 1, "x", 0.5, 1) for d, t in docs], DOCS)
    items = session.createDataFrame([(i, t, 1, "x") for i, t in items], ITEMS)
    return sorted((tuple(r) for r in ranking.rank_items(docs, items, **options).collect()), key=repr)


def drawn(seed, docs=150, items=12):
    draw = random.Random(seed)
    words = ["the", "of", "a1", "Ab", "zürich", "élan", "漢字", "x", "yy", "\U0001f600k", "the2", "he", "thee"] + [f"w{k}" for k in range(60)]
    joined = lambda n: "".join(draw.choice(words) + draw.choice([" ", "-", "\n", ". ", "_", "\x00", "\x7f"]) for _ in range(n))
    return [(k, joined(draw.choice([1, 5, 40, 200]))) for k in range(docs)], [(k, joined(draw.choice([1, 4, 12]))) for k in range(items)]


def test_ranks_equal_plain_counting(session):
    docs, items = drawn(1)
    assert ranked(session, docs, items) == brute.lexical_ranking(docs, items)


def test_parts_pieces_and_salts_change_nothing(session, monkeypatch):
    docs, items = drawn(2, docs=60)
    monkeypatch.setattr(ranking, "PLACES", 7)
    assert ranked(session, docs, items, part_items=3, part_chars=40, k=3) == brute.lexical_ranking(docs, items, 3)


def test_a_text_in_pieces_has_the_counts_of_the_whole():
    docs, _ = drawn(3, docs=20)
    terms = sorted({t for _, text in docs[:5] for t in ranking.terms_of(text)})
    automaton = ranking.TermAutomaton(terms)
    for _, text in docs:
        plain = ranking.folded(text)
        whole = {terms[n].decode(): c for n, c in zip(*(x.tolist() for x in automaton.counts(plain)), strict=True)}
        assert whole == {t: c for t, c in brute.collections.Counter(brute.lexical_terms(text)).items() if t.encode() in terms}
        for size in (1, 3, 50):
            pieces = automaton.counts(plain, size)
            assert {terms[n].decode(): c for n, c in zip(*(x.tolist() for x in pieces), strict=True)} == whole


def test_hard_rows(session):
    long = "alpha beta " * 30_000
    docs = [(None, "alpha"), (3, None), (4, ""), (5, "..."), (7, long), (9, "alpha beta"), (8, "alpha beta"), (8, "alpha beta"), (2, "ALPHA\nBETA"), (1, "gamma ÀB àb")]
    items = [(1, "alpha"), (2, "beta alpha ALPHA"), (3, None), (4, "nowhere"), (5, ""), (None, "gamma"), (6, "àB"), (7, "gam"), (8, "alpha"), (8, "gamma"), (9, "beta alpha"), (9, "beta alpha")]
    got = ranked(session, docs, items)
    assert got == brute.lexical_ranking(docs, items)
    assert [r[2] for r in got if r[0] == 2][:4] == [7, 2, 8, 8] and not [r for r in got if r[0] in (3, 4, 5, 7)]


def test_no_rows(session):
    some = [(1, "a b")]
    assert ranked(session, [], some) == [] and ranked(session, some, []) == [] and ranked(session, [(1, None)], some) == []


def test_large_numbers_stay_exact():
    n = np.array([1, 10**9, 3])
    assert ranking.length_norm(n, 10**10, 10**15).tolist() == [10 + 90 * x * 10**10 // 10**15 for x in n.tolist()]
