import json
import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]

from records import RECORDS  # noqa: E402
from tableviews.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(cores="4", shuffle_partitions=4, memory="6g")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def corpus_path(tmp_path_factory):
    path = tmp_path_factory.mktemp("corpus") / "corpus.json"
    path.write_text(json.dumps(RECORDS), encoding="utf-8")
    return str(path)


@pytest.fixture(scope="session")
def corpus(spark, corpus_path):
    from tableviews.operators import reshape
    from tableviews.sources.corpus import read_json_array

    records = read_json_array(spark, corpus_path)
    tables = reshape.tables_of(records)
    return records, reshape.samples_of(records), tables, reshape.rows_of(tables)
