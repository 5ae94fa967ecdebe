"""Document and table schemas.

Document field names are the input format and therefore fixed.  Leaves that must
be valid for a document to count carry their real type, so ``from_json`` itself
flags a mistyped one as corrupt.  Leaves that may be anything have two types: text
where documents are as usual (a whole number where nothing else counts), and variants, which tell a missing field, null, a number and a
text apart, where they are not.
"""

from __future__ import annotations

import re
from typing import NamedTuple

CORRUPT = "_corrupt"
PARSE_OPTIONS = {"columnNameOfCorruptRecord": CORRUPT}

_DATE_PARTS = "STRUCT<year: INT, month: INT, day: INT>"

# The shape of an incoming media document; ANY is a text, COUNT a number, WHOLE a whole
# number, usually, and UNREAD is asked for only.
MEDIA_FIELDS = f"""
  id: INT, type: ANY,
  title: STRUCT<romaji: ANY, english: ANY, native: ANY>,
  synonyms: ARRAY<STRING>,
  startDate: {_DATE_PARTS}, endDate: {_DATE_PARTS},
  episodes: COUNT, duration: COUNT, chapters: COUNT, volumes: COUNT,
  format: ANY, source: ANY, status: ANY,
  tags: ARRAY<STRUCT<id: INT, name: ANY, category: ANY>>,
  genres: ARRAY<STRING>,
  studios: STRUCT<edges: ARRAY<STRUCT<id: UNREAD, isMain: BOOLEAN, node: STRUCT<id: INT, name: ANY>>>>,
  staff: STRUCT<edges: ARRAY<STRUCT<id: UNREAD, role: ANY,
    node: STRUCT<id: INT, name: STRUCT<first: ANY, last: ANY, full: ANY, native: ANY>>>>>
"""

# The shape of one entry of a viewer's list document.
ENTRY_FIELDS = f"""
  userId: WHOLE, id: UNREAD, mediaId: INT, startedAt: {_DATE_PARTS}, completedAt: {_DATE_PARTS},
  score: DOUBLE, progress: INT, repeat: INT, media: UNREAD, status: ANY
"""

# The two branches of a list document, in reading order.
LIST_BRANCHES = ("anime", "manga")

_BRANCH = f"""STRUCT<data: STRUCT<MediaListCollection: STRUCT<lists:
  ARRAY<STRUCT<entries: ARRAY<STRUCT<{ENTRY_FIELDS}>>>>>>>"""

MEDIA_DOCUMENT = f"data STRUCT<Media: STRUCT<{MEDIA_FIELDS}>>, {CORRUPT} STRING"
LIST_DOCUMENT = ", ".join(f"{b} {_BRANCH}" for b in LIST_BRANCHES) + f", {CORRUPT} STRING"

def leaves(document: str, kind: str) -> tuple[str, ...]:
    """Names of a document's leaves of one kind: ANY, COUNT or WHOLE."""
    return tuple(dict.fromkeys(re.findall(rf"(\w+): {kind}\b", document)))


def usual(document: str) -> str:
    """The schema of documents whose leaves are as usual."""
    return _typed(_read(document), ANY="STRING", COUNT="STRING", WHOLE="INT")


def exact(document: str) -> str:
    """The schema that takes any leaf as it is."""
    return _typed(_read(document), ANY="VARIANT", COUNT="VARIANT", WHOLE="VARIANT")


def requested(fields: str) -> str:
    """The schema of all fields that are asked for."""
    return _typed(fields, ANY="VARIANT", COUNT="VARIANT", WHOLE="VARIANT", UNREAD="VARIANT")


def _typed(document: str, **types: str) -> str:
    return re.sub(rf"\b({'|'.join(types)})\b", lambda kind: types[kind[0]], document)


def _read(document: str) -> str:
    return re.sub(r"\w+: UNREAD, ", "", document)


# Seed rows of the name-type dimension, ids 1 to 4.
NAME_TYPES = ("romaji", "english", "native", "synonyms")


class Table(NamedTuple):
    """A stored table: columns, the column it is hash-bucketed on, its surrogate key if any."""

    ddl: str
    bucket_by: str
    surrogate: str | None = None

    @property
    def columns(self) -> list[str]:
        return [column.split()[0] for column in self.ddl.split(",")]

    def type_of(self, column: str) -> str:
        return dict(c.split() for c in self.ddl.split(","))[column]


TABLES = {name: Table(*spec) for name, spec in {
    "name": ("kind string, name_id bigint, name string", "name", "name_id"),
    "tag": ("tag_id bigint, ext_tag_id int, category_id bigint, name string", "ext_tag_id", "tag_id"),
    "studio": ("studio_id bigint, ext_studio_id int, name string", "ext_studio_id", "studio_id"),
    "staff": (
        "staff_id bigint, ext_staff_id int, first_name string, last_name string,"
        " full_name string, native_name string", "ext_staff_id", "staff_id"),
    "viewer": ("viewer_id bigint, ext_user_id int", "ext_user_id", "viewer_id"),
    "media": (
        "media_id bigint, ext_media_id int, title string, date_start date, date_end date,"
        " episodes int, duration int, chapters int, volumes int,"
        " format_id bigint, source_id bigint, status_id bigint, media_type_id bigint",
        "ext_media_id", "media_id"),
    "media_name": (
        "media_name_id bigint, media_id bigint, name string, name_type_id bigint",
        "media_id", "media_name_id"),
    "genre_link": ("media_id bigint, genre_id bigint", "media_id", None),
    "tag_link": ("media_id bigint, tag_id bigint", "media_id", None),
    "studio_link": ("media_id bigint, studio_id bigint, is_main boolean", "media_id", None),
    "staff_link": ("media_id bigint, staff_id bigint, role string", "media_id", None),
    "list_entry": (
        "viewer_id bigint, media_id bigint, date_start date, date_end date, score int,"
        " progress int, rewatched int, status_id bigint", "viewer_id", None),
    "pending_entry": (
        "viewer_id bigint, ext_media_id int, date_start date, date_end date, score int,"
        " progress int, rewatched int, status_id bigint", "viewer_id", None),
    "recommendation": ("viewer_id bigint, media_id bigint, score int", "viewer_id", None),
    "counter": (
        "counter_id bigint, counter_name string, value_int int, value_str string",
        "counter_name", "counter_id"),
    "quarantine": ("stream string, seq bigint, value string, reason string", "reason", None),
}.items()}

# Declared uniqueness, references, required columns and length bounds.
UNIQUE_KEYS = {
    "name": [["name_id"], ["kind", "name"]],
    "tag": [["tag_id"], ["ext_tag_id"]],
    "studio": [["studio_id"], ["ext_studio_id"]],
    "staff": [["staff_id"], ["ext_staff_id"]],
    "viewer": [["viewer_id"], ["ext_user_id"]],
    "media": [["media_id"], ["ext_media_id"]],
    "media_name": [["media_name_id"]],
    "genre_link": [["media_id", "genre_id"]],
    "tag_link": [["media_id", "tag_id"]],
    "studio_link": [["media_id", "studio_id"]],
    "staff_link": [["media_id", "staff_id", "role"]],
    "list_entry": [["viewer_id", "media_id"]],
    "recommendation": [["viewer_id", "media_id"]],
    "counter": [["counter_id"]],
}
FOREIGN_KEYS = [
    ("media", "format_id", "name", "name_id"),
    ("media", "source_id", "name", "name_id"),
    ("media", "status_id", "name", "name_id"),
    ("media", "media_type_id", "name", "name_id"),
    ("media_name", "media_id", "media", "media_id"),
    ("media_name", "name_type_id", "name", "name_id"),
    ("tag", "category_id", "name", "name_id"),
    ("genre_link", "media_id", "media", "media_id"),
    ("genre_link", "genre_id", "name", "name_id"),
    ("tag_link", "media_id", "media", "media_id"),
    ("tag_link", "tag_id", "tag", "tag_id"),
    ("studio_link", "media_id", "media", "media_id"),
    ("studio_link", "studio_id", "studio", "studio_id"),
    ("staff_link", "media_id", "media", "media_id"),
    ("staff_link", "staff_id", "staff", "staff_id"),
    ("list_entry", "viewer_id", "viewer", "viewer_id"),
    ("list_entry", "media_id", "media", "media_id"),
    ("list_entry", "status_id", "name", "name_id"),
    ("recommendation", "viewer_id", "viewer", "viewer_id"),
    ("recommendation", "media_id", "media", "media_id"),
]
REQUIRED_COLUMNS = {
    "name": ["name_id"],
    "tag": ["tag_id"],
    "studio": ["studio_id", "ext_studio_id"],
    "staff": ["staff_id", "ext_staff_id"],
    "viewer": ["viewer_id"],
    "media": ["media_id", "media_type_id"],
    "media_name": ["media_name_id", "name_type_id"],
    "genre_link": ["media_id", "genre_id"],
    "tag_link": ["media_id", "tag_id"],
    "studio_link": ["media_id", "studio_id", "is_main"],
    "staff_link": ["media_id", "staff_id"],
    "list_entry": ["viewer_id", "media_id"],
    "recommendation": ["viewer_id", "media_id", "score"],
    "counter": ["counter_id"],
}
LENGTH_BOUNDS = {
    "tag": {"name": 255},
    "studio": {"name": 50},
    "staff": {"first_name": 255, "last_name": 255, "full_name": 255, "native_name": 255},
    "media": {"title": 500},
    "media_name": {"name": 500},
    "staff_link": {"role": 255},
    "counter": {"counter_name": 255, "value_str": 255},
}
NAME_LENGTH_BOUNDS = {
    "mediatype": 50, "format": 50, "source": 50, "status": 50,
    "genre": 255, "tagcategory": 255, "nametype": 50, "watchstatus": 50,
}

