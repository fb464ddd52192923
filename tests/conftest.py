from __future__ import annotations

import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path[:0] = [str(ROOT), str(Path(__file__).resolve().parent)]

from trovelake.operators.chunking import chunk_documents  # noqa: E402
from trovelake.plans.index import build_index  # noqa: E402
from trovelake.runtime import local_session  # noqa: E402
from trovelake.sources.documents import load_documents, load_questions  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", cores="8")
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def sample(spark):
    return load_documents(spark, str(ROOT / "data" / "documents.json")).cache()


@pytest.fixture(scope="session")
def sample_questions(spark):
    return load_questions(spark, str(ROOT / "data" / "questions.json")).cache()


@pytest.fixture(scope="session")
def sample_index(spark, sample, tmp_path_factory):
    return build_index(spark, sample, str(tmp_path_factory.mktemp("index")))


@pytest.fixture(scope="session")
def small_index(spark, sample, tmp_path_factory):
    """Short windows, so that sections split into several chunks."""
    path = str(tmp_path_factory.mktemp("small"))
    return build_index(spark, sample, path, chunk_size=90, chunk_overlap=20)


@pytest.fixture(scope="session")
def sample_chunks(sample):
    return [r.asDict() for r in chunk_documents(sample).orderBy("doc_pos", "piece").collect()]
