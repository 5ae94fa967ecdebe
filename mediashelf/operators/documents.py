"""Parsing and validating documents.

One map-only pass turns raw documents into normalised columns.  A document with any
bad required field contributes nothing: it comes out with a reason and its raw text,
every other column null.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediashelf.functions import text as X
from mediashelf.schemas import (
    LIST_BRANCHES, LIST_DOCUMENT, MEDIA_DOCUMENT, PARSE_OPTIONS, exact, leaves, usual,
)

FEW = 64  # arrays of no more members are compared member by member, longer ones by hashed texts


def _first_reason(*checks: tuple[str, Column]) -> Column:
    """Name of the first check that holds, else null; a check on a null value does not hold."""
    return F.coalesce(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(why)) for why, bad in checks])


def _any(array: Column, bad) -> Column:
    return F.exists(array, lambda item: F.coalesce(bad(item), F.lit(False)))


def _members(array: Column, id_of, whole) -> Column:
    """The members as they are kept, equal ones once; arrays longer than ``FEW`` keep them for now.

    Members are only compared where an id occurs twice.
    """
    members = F.transform(array, whole)
    repeated = F.size(F.array_distinct(F.transform(array, id_of))) < F.size(array)
    return F.when(repeated & (F.size(array) <= FEW), F.array_distinct(members)).otherwise(members)


def _distinct(members: Column) -> Column:
    return F.when(F.size(members) > FEW, F.array_distinct(members)).otherwise(members)


def _conflicting(members: Column, identity: str, *more: str) -> Column:
    """Whether two different members share an identity, whose first field is their integer id."""

    def count(array: Column) -> Column:
        return F.size(F.array_distinct(array))

    def named(x: Column) -> Column:
        return F.struct(x[identity], *[x[f] for f in more])

    repeated = count(F.transform(members, lambda x: x[identity])) < F.size(members)
    few = count(F.transform(members, named)) < F.size(members) if more else repeated
    texts = F.transform(members, lambda x: F.to_json(x))
    many = count(texts) != count(F.transform(members, lambda x: F.to_json(named(x))))
    return F.when(repeated, F.when(F.size(members) <= FEW, few).otherwise(many)).otherwise(F.lit(False))


def _leaf(value: Column) -> Column:
    """Text of a variant, whatever its type; JSON null as the word ``null``, a missing one null."""
    return F.when(value.isNotNull(), X.text_or_null(F.try_variant_get(value, "$", "string")))


def _number(value: Column) -> Column:
    """The digits of a variant that is an integer, else null; a text holding digits is no number."""
    return F.when(F.schema_of_variant(value) == "BIGINT", F.try_variant_get(value, "$", "string"))


def _lacking(holder: Column, *fields: str) -> Column:
    """Whether a field is missing; one that is there and null is not."""
    missing = F.lit(False)
    for field in fields:
        missing = missing | holder[field].isNull()
    return missing


def _tag(t: Column) -> Column:
    return F.struct(
        t["id"].alias("ext_tag_id"),
        t["name"].alias("name"),
        t["category"].alias("category"),
    )


def _studio(e: Column) -> Column:
    return F.struct(
        e["node"]["id"].alias("ext_studio_id"),
        e["node"]["name"].alias("name"),
        e["isMain"].alias("is_main"),
    )


def _staff(e: Column) -> Column:
    name = e["node"]["name"]
    return F.struct(
        e["node"]["id"].alias("ext_staff_id"),
        name["first"].alias("first_name"),
        name["last"].alias("last_name"),
        name["full"].alias("full_name"),
        name["native"].alias("native_name"),
        F.upper(e["role"]).alias("role"),
    )


def _apart(frame: DataFrame, column: str) -> DataFrame:
    """The frame with a computed column that later filters cannot be pushed through.

    Catalyst would copy a costly expression into every filter on it, and parse each document
    again for every field the filter looks at; a generator keeps it evaluated once.  The generator
    only passes the column on, as what stands inside of one is not compiled.
    """
    others = [c for c in frame.columns if c != column]
    return frame.select(*others, F.explode(F.array(column)).alias(column))


def _worded(value: Column, texts: tuple[str, ...]) -> Column:
    """A document whose null texts are the word ``null``.

    Inside a JSON string every quote has a backslash before it, so a quoted name with a colon behind
    it can only be a member.  Searches that begin with a fixed word skip most of the document, so a
    null is found first and its name looked for behind it, with little space around the colon; a
    document with more space somewhere is searched by name.
    """
    names = "|".join(texts)
    spaced = value.rlike(r"null(?<=\s{3}null|\s{3}:\s{0,2}null)")
    by_name = F.regexp_replace(value, rf'"({names})"(\s*:\s*)null(?=[\s,}}])', '"$1"$2"null"')
    by_null = F.regexp_replace(value, rf'null(?=[\s,}}])(?<="(?:{names})"\s{{0,2}}:\s{{0,2}}null)', '"null"')
    return F.when(~value.contains("null"), value).when(spaced, by_name).otherwise(by_null)


def _quoted(value: Column, counts: tuple[str, ...]) -> Column:
    """Whether a document gives a number as a text."""
    found = [value.rlike(rf'{name}(?<="{name})"\s*:\s*"') for name in counts]
    return reduce(or_, found, F.lit(False))


def _parsed(docs: DataFrame, schema: str, plain: Callable[[Column], Column]) -> DataFrame:
    """``seq, value, doc``, where ``doc`` has the usual types, a missing leaf is null and a text
    that is null in the document is the word ``null``.

    Null texts are made words before parsing.  Documents that do not fit the usual types then, or
    give a number as a text, are parsed again, exactly, and made ``plain``.
    """
    worded = _worded(F.col("value"), leaves(schema, "ANY"))
    usually = docs.select("seq", "value", F.from_json(worded, usual(schema), PARSE_OPTIONS).alias("doc"))
    quoted = _quoted(F.col("value"), leaves(schema, "COUNT"))
    fits = F.col("doc").isNotNull() & F.col("doc._corrupt").isNull() & ~quoted
    judged = usually.select("*", fits.alias("fits"))
    exactly = F.when(~F.col("fits"), F.from_json("value", exact(schema), PARSE_OPTIONS))
    both = judged.select("*", exactly.alias("exact"))
    again = F.when(F.col("exact").isNotNull(), plain(F.col("exact")))
    return both.select("seq", "value", F.when(F.col("fits"), F.col("doc")).otherwise(again).alias("doc"))


def _known(value: Column, made: Column) -> Column:
    return F.when(value.isNotNull(), made)


def _texts(holder: Column, *fields: str) -> list[Column]:
    return [_leaf(holder[f]).alias(f) for f in fields]


def _plain_media(doc: Column) -> Column:
    m = doc["data"]["Media"]

    def tag(t: Column) -> Column:
        return _known(t, F.struct(t["id"].alias("id"), *_texts(t, "name", "category")))

    def studio(e: Column) -> Column:
        node = F.struct(e["node"]["id"].alias("id"), *_texts(e["node"], "name"))
        return _known(e, F.struct(e["isMain"].alias("isMain"), _known(e["node"], node).alias("node")))

    def staff(e: Column) -> Column:
        name = e["node"]["name"]
        names = _known(name, F.struct(*_texts(name, "first", "last", "full", "native")))
        node = F.struct(e["node"]["id"].alias("id"), names.alias("name"))
        return _known(e, F.struct(*_texts(e, "role"), _known(e["node"], node).alias("node")))

    def edges(section: Column, edge) -> Column:
        return _known(section, F.struct(F.transform(section["edges"], edge).alias("edges")))

    media = F.struct(
        m["id"].alias("id"), *_texts(m, "type"),
        _known(m["title"], F.struct(*_texts(m["title"], "romaji", "english", "native"))).alias("title"),
        *[m[f].alias(f) for f in ("synonyms", "startDate", "endDate")],
        *[_number(m[f]).alias(f) for f in ("episodes", "duration", "chapters", "volumes")],
        *_texts(m, "format", "source", "status"),
        F.transform(m["tags"], tag).alias("tags"), m["genres"].alias("genres"),
        edges(m["studios"], studio).alias("studios"), edges(m["staff"], staff).alias("staff"))
    return F.struct(F.struct(_known(m, media).alias("Media")).alias("data"), doc["_corrupt"].alias("_corrupt"))


def _plain_lists(doc: Column) -> Column:
    def entry(e: Column) -> Column:
        kept = [e[f].alias(f) for f in ("mediaId", "startedAt", "completedAt", "score", "progress", "repeat")]
        user = X.strict_int(_number(e["userId"]))
        return _known(e, F.struct(user.alias("userId"), *kept, *_texts(e, "status")))

    def lists(one: Column) -> Column:
        return _known(one, F.struct(F.transform(one["entries"], entry).alias("entries")))

    def branch(name: str) -> Column:
        held = F.transform(doc[name]["data"]["MediaListCollection"]["lists"], lists)
        return F.struct(F.struct(F.struct(held.alias("lists")).alias("MediaListCollection")).alias("data")).alias(name)

    return F.struct(*[branch(b) for b in LIST_BRANCHES], doc["_corrupt"].alias("_corrupt"))


def _malformed() -> Column:
    return F.col("doc").isNull() | F.col("doc._corrupt").isNotNull()


def parse_media(docs: DataFrame) -> DataFrame:
    """``(seq, value)`` media documents to one row each, ready to flatten.

    Rows with ``reason`` null are valid.  ``seq`` must be unique and give arrival order.
    """
    m = F.col("doc.data.Media")
    tags, genres, synonyms = m["tags"], m["genres"], m["synonyms"]
    studios, staff = m["studios"]["edges"], m["staff"]["edges"]
    sets = {
        "kept_tags": _members(tags, lambda t: t["id"], _tag),
        "kept_studios": _members(studios, lambda e: e["node"]["id"], _studio),
        "kept_staff": _members(staff, lambda e: e["node"]["id"], _staff),
    }
    sections = [m["title"], synonyms, m["startDate"], m["endDate"], tags, genres, studios, staff]
    missing = F.lit(False)
    for section in sections:
        missing = missing | section.isNull()
    reason = _first_reason(
        ("malformed", _malformed()),
        ("no media", m.isNull()),
        ("no id", m["id"].isNull()),
        ("missing section", missing),
        ("missing field", _lacking(m, "type", "format", "source", "status")
         | _lacking(m["title"], "romaji", "english", "native")),
        ("bad tag", _any(tags, lambda t: t.isNull() | t["id"].isNull())),
        ("bad studio", _any(
            studios, lambda e: e.isNull() | e["node"]["id"].isNull() | e["isMain"].isNull())),
        ("bad staff", _any(
            staff, lambda e: e["node"]["id"].isNull() | e["node"]["name"].isNull())),
        ("missing field", _any(tags, lambda t: _lacking(t, "name", "category"))
         | _any(studios, lambda e: _lacking(e["node"], "name"))
         | _any(staff, lambda e: _lacking(e, "role") | _lacking(
             e["node"]["name"], "first", "last", "full", "native"))),
        ("tag conflict", _conflicting(F.col("kept_tags"), "ext_tag_id")),
        ("studio conflict", _conflicting(F.col("kept_studios"), "ext_studio_id")),
        ("staff conflict", _conflicting(F.col("kept_staff"), "ext_staff_id", "role")),
    )
    title = m["title"]
    columns = {
        "ext_media_id": m["id"],
        "media_type": m["type"],
        "title": title["romaji"],
        "names": X.title_rows(
            synonyms, title["romaji"], title["english"], title["native"]),
        "date_start": X.date_of(m["startDate"]),
        "date_end": X.date_of(m["endDate"]),
        "episodes": X.lenient_int(m["episodes"]),
        "duration": X.lenient_int(m["duration"]),
        "chapters": X.lenient_int(m["chapters"]),
        "volumes": X.lenient_int(m["volumes"]),
        "format": m["format"],
        "source": m["source"],
        "status": m["status"],
        "tags": _distinct(F.col("kept_tags")),
        "genres": F.array_distinct(F.transform(genres, X.text_or_null)),
        "studios": _distinct(F.col("kept_studios")),
        "staff": _distinct(F.col("kept_staff")),
    }
    parsed = _parsed(docs, MEDIA_DOCUMENT, _plain_media)
    return _keep_valid(parsed.select("*", *[c.alias(name) for name, c in sets.items()]), reason, columns)


def _entry(e: Column) -> Column:
    return F.struct(
        e["mediaId"].alias("ext_media_id"),
        X.date_of(e["startedAt"]).alias("date_start"),
        X.date_of(e["completedAt"]).alias("date_end"),
        X.score_points(e["score"]).alias("score"),
        e["progress"].alias("progress"),
        e["repeat"].alias("repeat"),
        e["status"].alias("status"),
    )


def _bad_entry(e: Column) -> Column:
    required = [e["mediaId"], e["startedAt"], e["completedAt"], e["score"], e["progress"], e["repeat"],
                e["status"]]
    bad = F.isnan(e["score"])
    for part in required:
        bad = bad | part.isNull()
    return bad


def parse_lists(docs: DataFrame) -> DataFrame:
    """``(seq, value)`` list documents to ``seq, ext_user_id, entries`` rows.

    ``entries`` keeps document order, the first branch before the second; the viewer is
    named by the first entry, so a document without entries is rejected.
    """
    lists = [F.col(f"doc.{b}.data.MediaListCollection.lists") for b in LIST_BRANCHES]
    no_branch, bad_list = F.lit(False), F.lit(False)
    for branch in lists:
        no_branch = no_branch | branch.isNull()
        bad_list = bad_list | _any(branch, lambda x: x["entries"].isNull())
    raw = F.concat(*[F.flatten(F.transform(b, lambda x: x["entries"])) for b in lists])
    checked = _parsed(docs, LIST_DOCUMENT, _plain_lists).select(
        "seq", "value",
        _first_reason(
            ("malformed", _malformed()), ("missing branch", no_branch), ("missing entries", bad_list),
        ).alias("shape"),
        raw.alias("raw"),
    )
    user = F.get(F.col("raw"), F.lit(0))["userId"]
    reason = F.coalesce(F.col("shape"), _first_reason(
        ("no viewer", user.isNull()),
        ("bad entry", _any(F.col("raw"), _bad_entry)),
    ))
    return _keep_valid(
        checked, reason, {"ext_user_id": user, "entries": F.transform("raw", _entry)})


def _keep_valid(frame: DataFrame, reason: Column, columns: dict[str, Column]) -> DataFrame:
    flagged = _apart(frame.select("*", reason.alias("reason")), "reason")
    valid = F.col("reason").isNull()
    return flagged.select(
        "seq", "reason",
        F.when(~valid, F.col("value")).alias("value"),
        *[F.when(valid, column).alias(name) for name, column in columns.items()],
    )


def valid_documents(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col("reason").isNull()).drop("reason", "value")


def quarantined(parsed: DataFrame, stream: str) -> DataFrame:
    bad = parsed.filter(F.col("reason").isNotNull())
    return bad.select(F.lit(stream).alias("stream"), "seq", "value", "reason")


def latest_marks(valid: DataFrame, key: str) -> DataFrame:
    """The last ``seq`` of every key.

    Only two narrow columns are aggregated, map side first, so many versions of one key
    cost no more than many keys.
    """
    return valid.groupBy(key).agg(F.max("seq").alias("seq"))


def latest_documents(valid: DataFrame, key: str, marks: DataFrame | None = None) -> DataFrame:
    """The last valid document of every key; joined on (key, seq), which no hot key can skew."""
    marks = latest_marks(valid, key) if marks is None else marks
    return valid.join(marks, [key, "seq"], "left_semi")
