"""Decontamination: recall of the latent search against a plain search over all windows, and answers of words that no passage has."""

import random

import numpy as np
import pytest

from tableviews.llm import decontamination, shared


@pytest.fixture(scope="module")
def session(spark):
    shared.ship_package(spark)
    return spark


def words(draw, n, letters="abcdefghijklmnop"):
    return ["".join(draw.choices(letters, k=7)) for _ in range(n)]


def plain(passage, text, share=decontamination.COMMON):
    """Whether some window of the operator's length holds enough of the passage in order."""
    scale = next(s for s in decontamination.SCALES if s >= len(passage))
    width = scale + 2 * (scale // 4)
    number = {w: k for k, w in enumerate(dict.fromkeys(passage))}
    own = [number[w] for w in passage]
    return any(decontamination.common_length(own, [number.get(w, -1) for w in text[at : at + width]]) >= share * len(passage) for at in range(max(1, len(text) - width + 1)))


@pytest.mark.parametrize("n", [12, 20, 40, 64])
def test_recall_of_paraphrases_by_kept_words(session, n):
    draw = random.Random(n)
    items, docs = [(k, words(draw, n)) for k in range(60)], []
    for k, passage in items:
        kept = draw.choice([0.62, 0.7, 0.8, 0.9, 1.0])
        scale = next(s for s in decontamination.SCALES if s >= n)
        room = scale + 2 * (scale // 4) - 2
        chosen = sorted(draw.sample(range(n), max(1, round(kept * n + 0.49))))
        text = [passage[c] for c in chosen]
        answer = draw.sample(text, 2)
        # other words between the kept ones, within what a window with its margins holds
        for _ in range(draw.randrange(max(1, min(room - len(text), n)))):
            text.insert(draw.randrange(1, len(text)), words(draw, 1, "qrstuvwxyz")[0])
        before, after = words(draw, draw.randrange(30, 90), "qrstuvwxyz"), words(draw, draw.randrange(30, 90), "qrstuvwxyz")
        docs.append((k, before + text + after, passage, answer))
    benchmark = session.createDataFrame([(k, " ".join(p), " ".join(a)) for k, _, p, a in docs], "item_id long, text string, answer string")
    frame = session.createDataFrame([(k, " ".join(t)) for k, t, _, _ in docs], "doc_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontamination.contaminated(frame, benchmark).collect()}
    wanted = {(k, k) for k, text, passage, _ in docs if plain(passage, text)}
    assert len(wanted) >= 50
    assert len(wanted & found) >= 0.9 * len(wanted)
    assert all(a == b for a, b in found)


def test_answers_of_words_that_no_passage_has(session):
    draw = random.Random(9)
    passage, answer = words(draw, 30), ["zebra", "yonder"]
    other = lambda n: words(draw, n, "qrstuvw")
    benchmark = session.createDataFrame([(1, " ".join(passage), " ".join(answer))], "item_id long, text string, answer string")
    near, far = other(40) + passage + answer + other(40), other(40) + passage + other(120) + answer
    docs = session.createDataFrame([(1, " ".join(near)), (2, " ".join(far)), (3, " ".join(other(40) + answer + other(40)))], "doc_id long, text string")
    assert {r.doc_id for r in decontamination.contaminated(docs, benchmark).collect()} == {1}


def test_parts_by_characters_change_nothing(session, monkeypatch):
    draw = random.Random(10)
    items = [(k, " ".join(words(draw, 20)), None) for k in range(9)]
    docs = session.createDataFrame([(k, " ".join(words(draw, 30, "qrstuv")) + " " + t) for k, t, _ in items], "doc_id long, text string")
    benchmark = session.createDataFrame(items, "item_id long, text string, answer string")
    monkeypatch.setattr(decontamination, "PART_CHARS", 400)
    assert {(r.doc_id, r.item_id) for r in decontamination.contaminated(docs, benchmark).collect()} == {(k, k) for k in range(9)}


def test_the_latent_space_is_fitted_on_all_documents(session, monkeypatch):
    draw, fitted, fit = random.Random(11), [], decontamination.latent_basis
    monkeypatch.setattr(decontamination, "latent_basis", lambda rows, *rest: fitted.append(rows.count()) or fit(rows, *rest))
    passage = words(draw, 20)
    texts = [" ".join(draw.sample(passage, 3)) for _ in range(11_999)] + [" ".join(passage)]
    docs = session.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    benchmark = session.createDataFrame([(1, " ".join(passage))], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontamination.contaminated(docs, benchmark).collect()} == {(11_999, 1)}
    assert fitted == [12_000]


@pytest.mark.parametrize("rank", [1, 5, 64])
def test_windows_are_searched_as_one_by_one(rank):
    """Two columns share a running sum, also where their number is odd; candidates are those of plain cosines."""
    draw = np.random.default_rng(rank)
    passages = decontamination.Passages([(k, " ".join(f"w{n}" for n in draw.integers(0, 300, 10 + 6 * k)), None) for k in range(9)])
    terms = len(passages.vocabulary)
    weights, basis = draw.random(terms) + 0.1, draw.standard_normal((terms, rank))
    retriever = decontamination.Retriever(passages, weights, basis)
    assert len(retriever.columns) == -(-rank // 2)
    ids = draw.integers(-1, terms, 900)
    latent, got = weights[:, None] * basis, []
    for scale, found, starts, cosines in retriever.candidates(ids):
        got += zip([scale] * len(found), found.tolist(), starts.tolist(), cosines.tolist(), strict=True)
    near = {}
    for scale, members, _, least in retriever.scales:
        margin = decontamination.margin_of(scale)
        for at in range(0, len(ids), max(1, scale // 3)):
            if np.count_nonzero(ids[max(0, at - margin) : at + scale + margin] >= 0) < least:
                continue
            v = sum((latent[t] for t in ids[at : at + scale] if t >= 0), np.zeros(rank))
            for k in members.tolist():
                p = sum(latent[t] for t in passages.words[k])
                near[scale, k, at] = v @ p / max(1e-12, np.linalg.norm(v) * np.linalg.norm(p))
    assert got and len({x[:3] for x in got}) == len(got)
    assert all(abs(near[scale, k, at] - cosine) < 1e-3 for scale, k, at, cosine in got)
    assert {x[:3] for x in got} >= {key for key, cosine in near.items() if cosine > decontamination.COSINE + 1e-3}


def test_gram_product_is_that_of_the_rows(monkeypatch):
    """Terms that repeat in a window and in many windows, whatever the parts they are laid out in."""
    draw = np.random.default_rng(3)
    weights, basis = np.where(draw.random(40) < 0.1, 0, draw.random(40)), draw.standard_normal((40, 7))
    sequences = [draw.integers(-1, 40, n).astype(np.int32) for n in (0, 1, 47, 200, 3000)]
    whole = np.zeros(basis.shape)
    for s in sequences:
        for window in np.array_split(s, max(1, len(s) // decontamination.FIT_WINDOW)):
            row = np.bincount(window[window >= 0], minlength=40) * weights
            if row.any():
                # a term counts once for each place, and the norm is that of its places
                row /= np.sqrt((weights[window[window >= 0]] ** 2).sum())
                whole += np.outer(row, row @ basis)
    monkeypatch.setattr(np, "unique", lambda x, **more: pytest.fail("words of a part are sorted") if more else np.array(sorted(set(x))))
    for at_once in (1, 100, 800):
        assert np.allclose(decontamination.gram_product(sequences, weights, basis, at_once), whole)


def test_numbers_are_those_of_the_words():
    """Signs, letters whose lower case is longer or depends on their place, underscores; a worker keeps the vocabulary only."""
    draw = random.Random(4)
    texts = ["", "ΟΔΟΣ.Α ΟΔΟΣ. İz_1 a-b", *["".join(draw.choices("aAbΣσςİ_09 \n\t.,:!'|-é̇­", k=30)) for _ in range(3000)]]
    found = [[word for piece in shared.pieces_of(text) for word in shared.words_of(piece)] for text in texts]
    known = {word: n.to_bytes(4, "little", signed=True) for n, word in enumerate(sorted({word for row in found[:300] for word in row}))}
    table = decontamination.WordNumbers(known)
    assert table.encode(texts) == [b"".join(known.get(word, decontamination.NO_NUMBER) for word in row) for row in found]
    assert set(table) == {*known, ""}
