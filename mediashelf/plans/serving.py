"""Stored recommendations for many users at once, and the decision to compute them anew."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediashelf.functions import messages
from mediashelf.operators.lookups import lookup_join
from mediashelf.plans.reconcile import reconcile_lists
from mediashelf.session import written
from mediashelf.sources.requests import list_messages
from mediashelf.sources.tables import Store

REJECTED, RECOMPUTE, STORED = "rejected", "recompute", "stored"
RECOMMENDATION_COLUMNS = [
    "viewer_id", "ext_user_id", "media_id", "ext_media_id", "title", "score",
]


def stored_recommendations(
    users: DataFrame, viewers: DataFrame, recommendations: DataFrame, media: DataFrame,
) -> DataFrame:
    """Stored recommendations of the given ``ext_user_id`` rows, lowest score first per user.

    Users stand in no order among themselves.
    """
    wanted = viewers.join(users.select("ext_user_id").distinct(), "ext_user_id", "left_semi")
    found = lookup_join(recommendations, wanted, ["viewer_id"])
    titled = lookup_join(found, media.select("media_id", "ext_media_id", "title"), ["media_id"])
    by_user = titled.select(*RECOMMENDATION_COLUMNS).repartition("ext_user_id")
    return by_user.sortWithinPartitions("ext_user_id", "score", "media_id")


def recommendations_for(store: Store, users: DataFrame) -> DataFrame:
    """The same on a store, reading only the buckets the users fall in."""
    viewers = store.read("viewer", store.touched("viewer", users))
    wanted = viewers.join(users.select("ext_user_id").distinct(), "ext_user_id", "left_semi")
    recommendations = store.read("recommendation", store.touched("recommendation", wanted))
    return stored_recommendations(users, viewers, recommendations, store.read("media"))


def refresh_decisions(
    requests: DataFrame, viewers: DataFrame, recommendations: DataFrame,
) -> DataFrame:
    """What to do with every ``ext_user_id, params`` request.

    Recommendations are computed anew when refresh is the text "true", when none are
    stored, or when there is no other parameter.  The last rule looks inverted but is the
    behaviour to match.  Parameters that are not a JSON object reject the request.
    """
    params = F.col("params")
    counts = recommendations.groupBy("viewer_id").agg(F.count(F.lit(1)).alias("n_stored"))
    stored = viewers.join(counts, "viewer_id").select("ext_user_id", "n_stored")
    flagged = (
        lookup_join(requests, stored, ["ext_user_id"], "left")
        .withColumn("n_stored", F.coalesce("n_stored", F.lit(0).cast("bigint")))
        .withColumn("refresh", messages.wants_refresh(params))
        .withColumn("n_other", messages.other_parameters(params))
    )
    anew = F.col("refresh") | (F.col("n_stored") == 0) | (F.col("n_other") == 0)
    decision = (
        F.when(~messages.is_parameter_object(params), REJECTED)
        .when(anew, RECOMPUTE)
        .otherwise(STORED)
    )
    return flagged.withColumn("decision", decision)


def resolve_users(requests: DataFrame, directory: DataFrame) -> DataFrame:
    """``name`` requests with the user id of that name; unknown names get none."""
    known = lookup_join(requests, directory.select("name", "ext_user_id"), ["name"], "left")
    return known.withColumn("known", F.col("ext_user_id").isNotNull())


def routed(requests: DataFrame, directory: DataFrame, viewers: DataFrame, recommendations: DataFrame) -> DataFrame:
    """``request, ext_user_id, route, reason`` of ``request, name, ext_user_id, params`` requests.

    A request names its user by id, or by a name that ``directory`` (``name, ext_user_id``) knows.
    The route is ``rejected`` (with a reason), ``stored`` or ``recompute``; it is worked out once,
    and written, for everything that follows.
    """
    named = directory.select("name", F.col("ext_user_id").alias("_known"))
    asked = lookup_join(requests, named, ["name"], "left").withColumn(
        "ext_user_id", F.coalesce("ext_user_id", "_known")).drop("_known")
    decided = refresh_decisions(asked, viewers, recommendations)
    reason = F.when(F.col("decision") == REJECTED, "bad parameters").when(
        F.col("ext_user_id").isNull(), F.when(F.col("name").isNull(), "no user").otherwise("unknown name"))
    return written(decided.select(
        "request", "ext_user_id", F.when(reason.isNotNull(), REJECTED).otherwise(F.col("decision")).alias("route"),
        reason.alias("reason")), "routes")


def answered(routes: DataFrame, stored: DataFrame, computed: DataFrame) -> DataFrame:
    """``request, ext_user_id, route, reason, media_id, score``: routed requests with their rows.

    ``stored`` and ``computed`` hold ``ext_user_id, media_id, score``.  Both come under the route
    they answer, so one join serves all requests; one that is turned down, or has no rows, comes
    back once without media.  Only users that are asked for are looked at.
    """
    users = routes.select("ext_user_id", "route").distinct()
    tagged = [frame.select("ext_user_id", "media_id", "score").withColumn("route", F.lit(route))
              for route, frame in ((STORED, stored), (RECOMPUTE, computed))]
    rows = tagged[0].unionByName(tagged[1]).join(users, ["ext_user_id", "route"], "left_semi")
    return routes.join(rows, ["ext_user_id", "route"], "left").select(
        "request", "ext_user_id", "route", "reason", "media_id", "score")


def refresh_lists(
    store: Store,
    users: DataFrame,
    fetch_lists: Callable[[DataFrame], DataFrame],
    fetch_media: Callable[[DataFrame], DataFrame] | None = None,
) -> bool:
    """Fetches and reconciles the lists of the given ``ext_user_id`` rows.

    ``fetch_lists`` turns ``id`` rows into ``id, anime, manga`` documents.
    """
    ids = users.select(F.col("ext_user_id").alias("id")).distinct()
    return reconcile_lists(store, list_messages(fetch_lists(ids)), fetch_media=fetch_media)


def _no_generator(users: DataFrame) -> DataFrame:
    raise NotImplementedError("pass a function that computes recommendations")


def serve(
    store: Store,
    requests: DataFrame,
    fetch_lists: Callable[[DataFrame], DataFrame],
    generate: Callable[[DataFrame], DataFrame] = _no_generator,
    fetch_media: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Recommendations for ``ext_user_id, params`` requests, and the requests turned down.

    Users whose recommendations are to be computed anew have their lists refreshed, media that
    their lists name and the store lacks being fetched on the way, and are handed to
    ``generate``, which returns the six recommendation columns.  A request that is turned down
    comes back as one row without recommendation and with its ``reason``.  Decisions and stored
    answers are written first, as refreshing overwrites tables that they were read from.
    """
    decided = written(
        refresh_decisions(requests, store.read("viewer"), store.read("recommendation")), "decided")
    rejected = _turned_down(decided.filter(F.col("decision") == REJECTED), "bad parameters")
    answered = recommendations_for(store, decided.filter(F.col("decision") == STORED))
    answered = answered.withColumn("reason", F.lit(None).cast("string")).unionByName(rejected)
    anew = decided.filter(F.col("decision") == RECOMPUTE).select("ext_user_id").distinct()
    if anew.isEmpty():
        return answered
    answered = written(answered, "answered")
    refresh_lists(store, anew, fetch_lists, fetch_media)
    made = generate(anew).select(*RECOMMENDATION_COLUMNS)
    return answered.unionByName(made.withColumn("reason", F.lit(None).cast("string")))


def _turned_down(requests: DataFrame, reason: str, *carry: str) -> DataFrame:
    kinds = {
        "viewer_id": "bigint", "media_id": "bigint", "ext_media_id": "int", "title": "string",
        "score": "int",
    }
    columns = [F.lit(None).cast(kinds[c]).alias(c) if c in kinds else F.col(c)
               for c in RECOMMENDATION_COLUMNS]
    return requests.select(*columns, F.lit(reason).alias("reason"), *carry)


def serve_by_name(
    store: Store,
    requests: DataFrame,
    directory: DataFrame,
    fetch_lists: Callable[[DataFrame], DataFrame],
    generate: Callable[[DataFrame], DataFrame] = _no_generator,
    fetch_media: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """The same for ``name, params`` requests, with the ``name`` they were asked under.

    ``directory`` holds ``name, ext_user_id``; a name it lacks is turned down.
    """
    resolved = resolve_users(requests, directory)
    known = resolved.filter("known").select("name", "ext_user_id", "params")
    answers = serve(store, known.drop("name"), fetch_lists, generate, fetch_media)
    names = known.select("name", "ext_user_id").distinct()
    unknown = resolved.filter(~F.col("known")).select("name", "ext_user_id").distinct()
    named = lookup_join(answers, names, ["ext_user_id"])
    return named.unionByName(_turned_down(unknown, "unknown name", "name"))


def refresh_lists_by_name(
    store: Store, names: DataFrame, directory: DataFrame,
    fetch_lists: Callable[[DataFrame], DataFrame],
    fetch_media: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Refreshes the lists of the ``name`` rows' users; returns the names that are unknown."""
    resolved = resolve_users(names.select("name").distinct(), directory)
    refresh_lists(store, resolved.filter("known"), fetch_lists, fetch_media)
    return resolved.filter(~F.col("known")).select("name")
