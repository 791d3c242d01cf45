"""Language codes: the code, the n-grams and held-out accuracy."""

import random
import zlib

import numpy as np
import pytest

from tableviews.llm import language_codes as codes
from tableviews.llm import shared

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, rank int, place long, x double"


@pytest.fixture(scope="module")
def session(spark):
    shared.ship_package(spark)
    return spark


@pytest.mark.parametrize("languages", [0, 1, 2, 3, 4, 7, 8, 40])
def test_codewords_split_the_languages_and_lie_apart(languages):
    code = codes.codewords(languages)
    assert len(code) == languages and set(np.unique(code)) <= {-1, 1}
    if languages < 2:
        return
    columns = [tuple(c) for c in code.T]
    assert len(set(columns) | {tuple(-x for x in c) for c in columns}) == 2 * len(columns)
    assert all(len(set(c)) == 2 for c in columns)
    apart = min(int((a != b).sum()) for k, a in enumerate(code) for b in code[:k])
    assert apart >= (2 ** (languages - 2) if languages <= 7 else code.shape[1] // 5)
    assert (codes.codewords(languages) == code).all()


def plain_grams(text):
    found = []
    for word in codes.letters(text).split():
        guarded = f" {word} "
        found += [guarded[k : k + n] for n in (1, 2, 3) for k in range(len(guarded) - n + 1) if guarded[k : k + n] != " "]
    return found


def test_grams_stay_inside_words():
    pieces = ["Straße", "...", "a", "x1y", "", "Élan-vital", "漢字", "the"]
    buckets, owner = codes.grams(pieces)
    for at, piece in enumerate(pieces):
        own = plain_grams(piece)
        assert (owner == at).sum() == len(own)
        alone = codes.grams([piece])[0]
        assert sorted(buckets[owner == at].tolist()) == sorted(alone.tolist())
    assert len(set(buckets.tolist())) > 20


def test_margins_are_the_models_sums_however_a_text_is_cut(monkeypatch):
    draw = np.random.default_rng(5)
    model = codes.LanguageModel(["a", "b", "c"], codes.codewords(3), draw.normal(size=(codes.DIMENSIONS, 3)), draw.normal(size=3))
    texts = ["Ein Text, der 2 Wörter mehr hat.", "", "one", " ".join(f"word{k}x" for k in range(300))]
    wanted = []
    for text in texts:
        buckets = codes.grams([text])[0]
        wanted.append(model.weights[buckets, :-1].sum(axis=0, dtype=np.float64) / max(1, len(buckets)) + model.intercepts)
    for chars in (1, 40, 1 << 20):
        monkeypatch.setattr(codes, "PIECE_CHARS", chars)
        monkeypatch.setattr(codes.cut, "__defaults__", (chars,))
        margins, n = model.margins(texts, codes.PieceTable(model.word_sums))
        assert np.allclose(margins, wanted, atol=1e-5)
        assert n.tolist() == [len(plain_grams(t)) for t in texts]


def test_decoding_takes_the_nearest_codeword_and_flags_ties():
    model = codes.LanguageModel(["a", "b", "c", "d"], codes.codewords(4), np.zeros((codes.DIMENSIONS, 7)), np.zeros(7))
    margins = np.concatenate([4.0 * model.code, np.zeros((1, 7))])
    flipped = 4.0 * model.code[2].copy()
    flipped[0] *= -1  # one wrong bit is corrected
    first, score, second = model.decoded(np.concatenate([margins, flipped[None]]))
    assert first.tolist() == [0, 1, 2, 3, 0, 2]
    assert (score[:4] > 0.99).all() and abs(score[4] - 0.25) < 1e-9 and abs(second[4] - 0.25) < 1e-9


def test_bits_that_were_wrong_weigh_less():
    code = codes.codewords(3)
    trust = np.ones(code.shape)
    trust[:, 0] = 0.01
    model = codes.LanguageModel(["a", "b", "c"], code, np.zeros((codes.DIMENSIONS, 3)), np.zeros(3), trust)
    misled = 3.0 * code[1].copy()
    misled[0] *= -3
    assert model.decoded(misled[None])[0].tolist() == [1]


def test_held_out_accuracy(session):
    docs = session.read.parquet(f"{SF}/documents.parquet")
    truth = {r.doc_id: (r.lang, r.text) for r in docs.collect()}
    got = codes.languages_of(docs).collect()
    assert len(got) == len(truth)
    for row in got:
        assert row.held_out == (zlib.crc32(str(row.doc_id).encode()) % 5 == 0) and 0 <= row.score <= 1
    out = [r for r in got if r.held_out and r.lang_pred != "und"]
    right = sum(r.lang_pred == truth[r.doc_id][0] for r in out) / len(out)
    assert right > 0.98


def test_nothing_of_held_out_documents_is_learned(session):
    docs = session.read.parquet(f"{SF}/documents.parquet").limit(200)
    plain = {r.doc_id: r for r in codes.languages_of(docs).collect()}
    from pyspark.sql import functions as F

    # other languages for the held-out ones and other sources change no prediction
    changed = docs.withColumn("lang", F.when(codes.held_out(), "zz").otherwise(F.col("lang"))).withColumn("source", F.lit("s"))
    assert {r.doc_id: r for r in codes.languages_of(changed).collect()} == plain


def test_the_sample_is_bounded_and_repeats(session):
    rows = [(k, f"wort {k}" if k % 3 else f"mot {k} é", "de" if k % 3 else "fr", None, None, None, None) for k in range(900)]
    frame = session.createDataFrame(rows, DOCS)
    first = codes.learned_rows(frame, 50).collect()
    assert {lang: sum(r.lang == lang for r in first) for lang in ("de", "fr")} == {"de": 50, "fr": 50}
    assert sorted(first) == sorted(codes.learned_rows(frame.repartition(7), 50).collect())


def test_hard_rows(session):
    draw = random.Random(2)
    word = lambda letters: "".join(draw.choices(letters, k=draw.randrange(2, 8)))
    rows = [(k, " ".join(word("abcde" if k % 2 else "éòüxyz") for _ in range(20)), "aa" if k % 2 else "bb", "s", 1, 1, 0.0) for k in range(120)]
    hard = [(1000, None, "aa"), (1001, "", None), (1002, "12 34 !?", "aa"), (1003, "abc bad cab " * 60_000, None), (None, "abc bad", "bb"), (1004, "ab cd ea", None), (1004, "ab cd ea", None), (1005, "a" * 70_000, "aa"), (1006, "²③Ⅷ_", None)]
    frame = session.createDataFrame(rows + [(*h, None, None, None, None) for h in hard], DOCS)
    got = codes.languages_of(frame).collect()
    assert len(got) == len(rows) + len(hard)
    of = {r.doc_id: r for r in got}
    assert all(of[k].lang_pred == "und" and of[k].score == 0 for k in (1000, 1001, 1002, 1006))
    assert of[1003].lang_pred == of[1004].lang_pred == of[None].lang_pred == "aa" and of[None].held_out
    assert not of[1000].ambiguous


def test_few_languages(session):
    rows = [(k, "some words", None, None, None, None, None) for k in range(6)]
    assert {r.lang_pred for r in codes.languages_of(session.createDataFrame(rows, DOCS)).collect()} == {"und"}
    one = [(k, "some words", "en", None, None, None, None) for k in range(6)]
    assert {(r.lang_pred, r.score) for r in codes.languages_of(session.createDataFrame(one, DOCS)).collect()} == {("en", 1.0)}
    assert codes.languages_of(session.createDataFrame([], DOCS)).collect() == []
