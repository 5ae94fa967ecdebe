import json
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from mediashelf.session import local_session  # noqa: E402
from mediashelf.sources.tables import Store  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "mediashelf-tests")
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture
def store(spark, tmp_path):
    return Store.create(spark, f"{tmp_path}/store", buckets=4)


def date(year=None, month=None, day=None):
    return {"year": year, "month": month, "day": day}


def media(id, **changes):
    body = {
        "id": id, "type": "ANIME",
        "title": {"romaji": f"title {id}", "english": None, "native": None},
        "synonyms": [], "startDate": date(2021, 3, 4), "endDate": date(),
        "episodes": 12, "duration": None, "chapters": None, "volumes": None,
        "format": "TV", "source": "MANGA", "status": "FINISHED",
        "tags": [], "genres": [], "studios": {"edges": []}, "staff": {"edges": []},
    }
    body.update(changes)
    return json.dumps({"data": {"Media": body}})


def studio(id, name="studio", main=True):
    return {"id": 1, "isMain": main, "node": {"id": id, "name": name}}


def staff(id, role="Director", first="a", last="b", full="a b", native=None):
    name = {"first": first, "last": last, "full": full, "native": native}
    return {"id": 1, "role": role, "node": {"id": id, "name": name}}


def tag(id, name="tag", category="theme"):
    return {"id": id, "name": name, "category": category}


def entry(media_id, user=1, **changes):
    body = {
        "userId": user, "id": 9, "mediaId": media_id, "startedAt": date(2020, 1, 2),
        "completedAt": date(), "score": 8.5, "progress": 1, "repeat": 0, "status": "CURRENT",
    }
    body.update(changes)
    return body


def lists(anime=(), manga=()):
    def branch(parts):
        entries = [{"entries": list(part)} for part in parts]
        return {"data": {"MediaListCollection": {"lists": entries}}}

    return json.dumps({"anime": branch(anime), "manga": branch(manga)})


@pytest.fixture
def documents(spark):
    """Documents given in arrival order, as ``(seq, value)`` rows."""

    def build(*values, start=0):
        rows = [(start + i, v) for i, v in enumerate(values)]
        return spark.createDataFrame(rows, "seq bigint, value string")

    return build
