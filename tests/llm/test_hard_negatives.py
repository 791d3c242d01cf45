"""Hard negatives against plain products."""

import random

import brute
import numpy as np
import pytest

from tableviews.llm import hard_negatives, shared

SCHEMA = "vec_id long, embedding array<double>, label int, score double, block int, dims string"


@pytest.fixture(scope="module")
def session(spark):
    shared.ship_package(spark)
    return spark


def mined(frame, **options):
    rows = [tuple(r) for r in hard_negatives.hard_negatives(frame, **options).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def integers(rows):
    return [(i, (label + 1) % 10 if i % 7 == 0 else label, [int(np.floor(256 * x)) for x in v]) for i, v, label, *_ in rows]


def test_packed_scores_equal_plain_products():
    draw = np.random.default_rng(1)
    for top, dims in ((1, 1), (300, 64), (2**20, 7), (2**31, 5), (2**45, 3), (2**62, 2)):
        values = draw.integers(-top, top, (50, dims), endpoint=True)
        anchors = draw.integers(-min(top, 2**16), min(top, 2**16), (4, dims), endpoint=True) if top < 2**62 else np.array([[1, -1], [0, 1], [-1, 0], [0, 0]])
        block, bias = hard_negatives.PackedBlock(values), -int(anchors.min(initial=0))
        block.ready_for(int(anchors.max(initial=0)) + bias)
        for anchor in anchors.tolist():
            plain = [sum(a * b for a, b in zip(anchor, row, strict=True)) for row in values.tolist()]
            if max(map(abs, plain)) < 2**63:
                assert block.scores(anchor, bias).tolist() == plain


def test_a_score_beyond_64_bits_ends_the_job():
    block = hard_negatives.PackedBlock(np.array([[2**62, 2**62]]))
    block.ready_for(8)
    with pytest.raises(OverflowError):
        block.scores([8, 8], 0)


def test_blocks_and_batches_of_any_size(session):
    draw = random.Random(3)
    rows = [(i, [draw.choice([-0.5, -0.1, 0.0, 0.25, 0.3]) for _ in range(6)], draw.randrange(3), 0.0, 0, "") for i in range(260)]
    frame = session.createDataFrame(rows, SCHEMA)
    wanted = brute.hard_negatives(integers(rows), every=20)
    assert len(wanted) > 50
    assert mined(frame, every=20) == wanted
    assert mined(frame, every=20, block_rows=17, per_batch=3) == wanted


def test_hard_vectors(session):
    same = [0.5, 0.25]
    rows = [
        (0, same, 1, None, None, None),
        (100, same, 1, 1.0, 1, "a"),
        (None, same, 1, 1.0, 1, "a"),
        (1, None, 1, 1.0, 1, "a"),
        (2, same, None, 1.0, 1, "a"),
        (3, [0.5, None], 1, 1.0, 1, "a"),
        (4, [0.5, float("nan")], 1, 1.0, 1, "a"),
        (5, [float("inf"), 0.5], 1, 1.0, 1, "a"),
        (6, [0.5], 2, 1.0, 1, "a"),
        (200, [], 2, 1.0, 1, "a"),
        (201, [], 2, 1.0, 1, "a"),
        (202, [], 3, 1.0, 1, "a"),
        # ties among negatives, and repeated rows
        *[(i, same, 5, 1.0, 1, "a") for i in range(50, 60)],
        *[(i, same, 2, 1.0, 1, "a") for i in range(50, 60) if i % 2],
        (20, same, 2, 1.0, 1, "a"),
        (20, same, 2, 1.0, 1, "a"),
    ]
    got = mined(session.createDataFrame(rows, SCHEMA))
    assert {r[:4] for r in got if r[0] == 200} == {(200, 201, 1, 202)} and all(r[4:] == (0, 0) for r in got if r[0] == 200)
    # row 0 has label 2 by its id; its positives carry label 2 as well
    of_zero = [r for r in got if r[0] == 0]
    assert {r[1] for r in of_zero} == {20, 51, 53, 55, 57}
    assert {r[3] for r in of_zero if r[1] == 20} == {50, 51, 52, 53, 54}
    assert not {r[3] for r in got} & {1, 2, 3, 4, 5, 6, None}


def test_no_rows(session):
    assert mined(session.createDataFrame([], SCHEMA)) == set()


def test_an_endless_component_ends_the_job(session):
    with pytest.raises(Exception, match="beyond 64 bits"):
        mined(session.createDataFrame([(0, [1e300], 1, 0.0, 0, "")], SCHEMA))
