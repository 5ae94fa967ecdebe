"""Queries by name; each takes a session and the folder of the tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediashelf.functions import messages
from mediashelf.functions import text as X
from mediashelf.operators import audit, dimensions, documents, flatten, lookups, ranges
from mediashelf.operators.diff import after_diff, changes, two_way_diff
from mediashelf.operators.keys import assign_keys, dealt
from mediashelf.plans import filters, recommend, serving, views
from mediashelf.plans.reconcile import media_requests, reconcile_lists, reconcile_media
from mediashelf.session import new_scratch, written
from mediashelf.sources import options, requests, topics
from mediashelf.sources.tables import Store
from mediashelf.streaming.consume import consume_lists, consume_media
from mediashelf.streaming.publish import publish_lists, publish_media, walk_ticks
from mediashelf.streaming.sinks import batch_sink, partition_per_batch
from workload import inputs
from workload.inputs import load

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def _store(spark: SparkSession, label: str) -> Store:
    return Store.create(spark, new_scratch(spark, label))


# -- sources, sinks, requests --------------------------------------------------------


@query
def ticks_to_documents(spark, sf):
    """Ticks become ids; only a due tick carries a document."""
    ticks = load(spark, sf, "events").select(F.col("event_id").alias("value"), "props")
    return requests.ticked(ticks, F.col("props"))


def _counters(customer: DataFrame) -> DataFrame:
    """Counters that name the boundary of a walk over the customers."""
    return customer.select(
        F.col("c_custkey").alias("counter_id"), F.lit("media").alias("counter_name"),
        F.when(F.col("c_acctbal") > 0, F.col("c_custkey") + 500).cast("int").alias("value_int"))


@query
def id_walk(spark, sf):
    """Every id up to a configured boundary, fetched from a table, error documents left out."""
    customer = load(spark, sf, "customer")
    boundary = int(options.config_value(_counters(customer), "media", "int", "5"))
    document = F.when(
        F.col("c_acctbal") < 0, F.concat(F.lit(messages.ERROR_PREFIX), F.lit("[]}"))
    ).otherwise(F.concat(F.lit('{"name":"'), F.col("c_name"), F.lit('"}')))
    table = customer.select(F.col("c_custkey").cast("int").alias("id"), document.alias("data"))
    fetch = requests.from_table(table, "data")
    return requests.media_messages(fetch(topics.id_range(spark, boundary)))


@query
def fetched_documents(spark, sf):
    """A user-supplied function called with batches of ids."""
    ids = load(spark, sf, "part").select(F.col("p_partkey").alias("id"))
    return requests.fetch_documents(
        ids,
        data=lambda keys: [f'{{"id":{k}}}' for k in keys],
        twice=lambda keys: [str(2 * k) for k in keys],
    )


@query
def request_documents(spark, sf):
    """Request bodies for media ids."""
    return load(spark, sf, "part").select(
        "p_partkey", requests.media_request(F.col("p_partkey")).alias("request"))


@query
def list_request_documents(spark, sf):
    """Request bodies for both list types of a user, and for finding the user by name."""
    return load(spark, sf, "customer").select(
        "c_custkey",
        requests.list_request(F.col("c_custkey"), "ANIME").alias("anime"),
        requests.list_request(F.col("c_custkey"), "MANGA").alias("manga"),
        requests.user_request(F.col("c_name")).alias("by_name"),
    )


@query
def config_values(spark, sf):
    """First non-null value per counter name, with a default for names without one."""
    customer = load(spark, sf, "customer")
    balance = F.col("c_acctbal")
    counters = customer.select(
        F.col("c_custkey").alias("counter_id"), F.col("c_mktsegment").alias("counter_name"),
        F.when(balance >= 5000, F.floor(balance)).cast("int").alias("value_int"))
    wanted = counters.select("counter_name").unionByName(
        load(spark, sf, "nation").select(F.col("n_name").alias("counter_name"))).distinct()
    return options.config_values(counters, wanted, "int", "5")


@query
def starting_offsets(spark, sf):
    """Offset words pass, numbers become a position, missing ones start at the beginning."""
    kind = F.col("event_type")
    offset = (
        F.when(kind == "view", "latest").when(kind == "click", "earliest")
        .when(kind == "signup", F.col("user_id").cast("string")))
    return load(spark, sf, "events").select(
        "event_id", options.starting_offsets(kind, offset).alias("starting_offsets"))


def _order_topic(spark, sf) -> DataFrame:
    value = F.concat(
        F.lit('{"id":'), F.col("o_custkey"), F.lit(',"status":"'), F.col("o_orderstatus"), F.lit('"}'))
    return load(spark, sf, "orders").select(F.col("o_orderkey").alias("seq"), value.alias("value"))


@query
def topic_round_trip(spark, sf):
    """Written as a topic, read as a stream, written again by batch, read as a batch."""
    source, sink = new_scratch(spark, "topic"), new_scratch(spark, "topic")
    topics.write_topic(_order_topic(spark, sf), "parquet", {"path": source})
    stream = topics.stream_topic(spark, "parquet", {"path": source})
    writer = batch_sink(
        stream, new_scratch(spark, "checkpoint"),
        lambda batch, _: topics.write_topic(batch, "parquet", {"path": sink}), bounded=True)
    writer.start().awaitTermination()
    return topics.read_topic(spark, "parquet", {"path": sink})


@query
def first_record(spark, sf):
    """The first record of a topic."""
    path = new_scratch(spark, "topic")
    topics.write_topic(_order_topic(spark, sf), "parquet", {"path": path})
    return flatten.first_in_order(topics.read_topic(spark, "parquet", {"path": path}), ["seq"])


def _ticks(spark, sf) -> DataFrame:
    """The events as a stream of ticks."""
    schema = load(spark, sf, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    return events.select(F.col("event_id").alias("value"))


@query
def published_media(spark, sf):
    """A tick stream walks ids, fetches from a table and publishes good documents."""
    customer = load(spark, sf, "customer")
    document = F.when(F.col("c_acctbal") < 0, messages.ERROR_PREFIX).otherwise(F.col("c_name"))
    table = customer.select(F.col("c_custkey").cast("int").alias("id"), document.alias("data"))
    sink = new_scratch(spark, "topic")
    publish_media(
        _ticks(spark, sf), requests.from_table(table, "data"),
        lambda frame: topics.write_topic(frame, "parquet", {"path": sink}),
        boundary=int(options.config_value(_counters(customer), "media", "int", "5")),
        checkpoint=new_scratch(spark, "checkpoint"), bounded=True,
    ).run(poll_seconds=0.2)
    return topics.read_topic(spark, "parquet", {"path": sink})


@query
def walked_ticks(spark, sf):
    """Ids of an endless tick source up to the last customer's, each batch a partition of its own."""
    customer = load(spark, sf, "customer")
    document = F.when(F.col("c_acctbal") < 0, messages.ERROR_PREFIX).otherwise(F.col("c_name"))
    table = customer.select(F.col("c_custkey").cast("int").alias("id"), document.alias("data"))
    boundary, path = customer.agg(X.max_or_zero(F.col("c_custkey"))).first()[0], new_scratch(spark, "walked")
    walk_ticks(
        topics.tick_batches(spark, 4 * boundary + 1), requests.from_table(table, "data"), partition_per_batch(path),
        boundary, new_scratch(spark, "checkpoint"), every="0 seconds",
    ).run(poll_seconds=0.2)
    return spark.read.parquet(path).select("seq", "value")


@query
def published_lists(spark, sf):
    """The same for lists: published while either branch is good, in one envelope."""
    customer = load(spark, sf, "customer")
    balance, name = F.col("c_acctbal"), F.to_json(F.struct("c_name"))
    table = customer.select(
        F.col("c_custkey").cast("int").alias("id"),
        F.when(balance < 3000, messages.ERROR_PREFIX).otherwise(name).alias("anime"),
        F.when(balance > 2000, messages.ERROR_PREFIX).otherwise(name).alias("manga"))
    sink = new_scratch(spark, "topic")
    publish_lists(
        _ticks(spark, sf), requests.from_table(table, "anime", "manga"),
        lambda frame: topics.write_topic(frame, "parquet", {"path": sink}),
        boundary=table.count(), checkpoint=new_scratch(spark, "checkpoint"), bounded=True,
    ).run(poll_seconds=0.2)
    return topics.read_topic(spark, "parquet", {"path": sink})


@query
def good_payloads(spark, sf):
    """Kept while either side is good; both sides in one envelope."""
    error = F.lit(messages.ERROR_PREFIX)
    fetched = load(spark, sf, "events").select(
        F.col("event_id").alias("id"),
        F.when(F.col("event_type") == "error", error).otherwise(F.col("props")).alias("anime"),
        F.when(F.col("value") < 20, error).otherwise(F.col("props")).alias("manga"))
    return requests.list_messages(fetched)


# -- scalar rules --------------------------------------------------------------------


@query
def partial_dates(spark, sf):
    """Dates from parts that may be missing or not exist."""
    shipped, number = F.col("l_shipdate").cast("date"), F.col("l_linenumber")
    return load(spark, sf, "lineitem").select(
        "l_orderkey", number, "l_partkey", "l_suppkey",
        X.partial_date(
            F.when(number != 1, F.year(shipped)), F.when(number != 2, F.month(shipped)),
            F.when(F.col("l_returnflag") != "N", number + 26)).alias("date"),
    ).withColumn("iso", X.iso_text(F.col("date")))


@query
def integers_from_text(spark, sf):
    """Lenient and strict integers from texts that may not be whole numbers."""
    part, number = F.col("l_partkey").cast("string"), F.col("l_linenumber")
    text = (
        F.when(number == 1, part)
        .when(number == 2, F.col("l_quantity").cast("string"))
        .when(number == 3, F.concat(F.lit("x"), part))
        .when(number == 4, F.concat(F.lit("-"), part))
        .when(number == 5, F.concat(F.lit(" "), part))
        .when(number == 6, F.concat(part, F.lit("99999999"))))
    return load(spark, sf, "lineitem").select(
        "l_orderkey", number, "l_partkey", "l_suppkey",
        X.lenient_int(text).alias("lenient"), X.strict_int(text).alias("strict"))


@query
def score_points(spark, sf):
    """Ten times the score, cut toward zero."""
    return load(spark, sf, "events").select(
        "event_id", X.score_points(F.col("value") / 50).alias("points"),
        X.score_points(-F.col("value") / 3).alias("below_zero"))


@query
def flags_and_roles(spark, sf):
    """Strict booleans, upper-cased roles and missing texts."""
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    flag = F.when(status == "F", "true").when(status == "O", "False").otherwise("yes")
    role = F.when(priority != "5-LOW", F.lower(priority))
    return load(spark, sf, "orders").select(
        "o_orderkey", X.strict_bool(flag).alias("flag"), X.role_name(role).alias("role"),
        X.text_or_null(role).alias("text"))


@query
def cleaned_titles(spark, sf):
    """Quotes stripped from raw JSON text, single quotes doubled for export."""
    quote, text = F.lit('"'), F.col("text")
    return inputs.load_spread(spark, sf, "documents").select(
        "doc_id",
        X.clean_title(F.concat(quote, text, quote)).alias("both"),
        F.md5(X.clean_title(F.concat(text, quote))).alias("one_md5"),
        F.md5(X.escape_quotes(text)).alias("escaped_md5"))


@query
def title_names(spark, sf):
    """Typed title rows without missing ones."""
    name, kind = F.col("p_name"), F.col("p_type")
    synonyms = F.concat(F.split(name, " "), F.array(kind, kind, F.lit(None)))
    pairs = X.title_rows(
        synonyms, name, F.when(F.col("p_size") > 25, F.col("p_brand")),
        F.when(F.col("p_size") > 10, kind).otherwise("null"))
    return load(spark, sf, "part").select("p_partkey", F.explode(pairs).alias("p")).select(
        "p_partkey", "p.*")


def _parameters() -> F.Column:
    kind, props = F.col("event_type"), F.col("props")
    rest = F.concat(F.lit(","), F.expr("substring(props, 2)"))
    return (
        F.when(kind == "view", F.concat(F.lit('{"refresh":"true"'), rest))
        .when(kind == "click", F.concat(F.lit('{"refresh":true'), rest))
        .when(kind == "signup", props)
        .when(kind == "purchase", F.when(F.col("value") < 30, '{"refresh":"true"}').otherwise("{}"))
        .otherwise(F.when(F.col("value") < 30, "[1]").otherwise("{broken")))


@query
def request_parameters(spark, sf):
    """The refresh flag and the number of other parameters."""
    params = _parameters()
    return load(spark, sf, "events").select(
        "event_id",
        messages.is_parameter_object(params).alias("is_object"),
        messages.wants_refresh(params).alias("refresh"),
        F.when(messages.is_parameter_object(params), messages.other_parameters(params)).alias("n_other"))


@query
def highest_ids(spark, sf):
    """A maximum that is 0 on no rows."""
    user = F.col("user_id")
    return load(spark, sf, "events").agg(
        X.max_or_zero(user).alias("highest"),
        X.max_or_zero(F.when(F.col("value") < 0, user)).alias("of_none"))


# -- documents ------------------------------------------------------------------------


def _parsed_media(spark, sf) -> DataFrame:
    return documents.parse_media(inputs.media_documents(spark, sf).drop("ordered"))


def _valid_media(spark, sf) -> DataFrame:
    return documents.valid_documents(_parsed_media(spark, sf))


@query
def media_attributes(spark, sf):
    """The flat attributes of valid media documents."""
    return _valid_media(spark, sf).drop("names", "tags", "genres", "studios", "staff")


@query
def media_quarantine(spark, sf):
    """Rejected media documents with their reason; their text is kept."""
    rejected = documents.quarantined(_parsed_media(spark, sf), "media")
    return rejected.withColumn("has_text", F.length("value") > 0).drop("value")


@query
def unnested_tags(spark, sf):
    return flatten.tag_rows(_valid_media(spark, sf), ["seq"])


@query
def unnested_genres(spark, sf):
    return flatten.genre_rows(_valid_media(spark, sf), ["seq"])


@query
def unnested_studios(spark, sf):
    return flatten.studio_rows(_valid_media(spark, sf), ["seq"])


@query
def unnested_staff(spark, sf):
    return flatten.staff_rows(_valid_media(spark, sf), ["seq"])


@query
def unnested_titles(spark, sf):
    return flatten.title_name_rows(_valid_media(spark, sf), ["seq"])


@query
def list_entries_in_order(spark, sf):
    """Entries of valid list documents with their position over both branches."""
    parsed = documents.parse_lists(inputs.list_documents(spark, sf).drop("ts"))
    return flatten.entry_rows(documents.valid_documents(parsed), ["seq", "ext_user_id"])


@query
def list_quarantine(spark, sf):
    """Rejected list documents by reason."""
    parsed = documents.parse_lists(inputs.list_documents(spark, sf).drop("ts"))
    return documents.quarantined(parsed, "lists").drop("value")


@query
def document_entries_collapsed(spark, sf):
    """Every list document's entries, one row per media."""
    parsed = documents.parse_lists(inputs.list_documents(spark, sf).drop("ts"))
    entries = flatten.entry_rows(documents.valid_documents(parsed), ["seq", "ext_user_id"])
    return flatten.collapse_entries(entries, ["seq", "ext_user_id", "ext_media_id"], ["pos"])


@query
def list_collapse(spark, sf):
    """All order lines as list entries, one row per viewer and media."""
    entries = inputs.line_entries(spark, sf).select(
        "ext_user_id", "ext_media_id", "date_start", "date_end",
        X.score_points(F.col("discount") * 100).alias("score"), "status",
        F.col("l_linenumber").alias("progress"), "repeat",
        (F.col("l_linenumber") % 2 == 0).alias("second_branch"), "l_orderkey", "discount")
    return flatten.collapse_entries(
        entries, ["ext_user_id", "ext_media_id"],
        ["second_branch", "l_orderkey", "progress", "date_end", "discount", "status"])


@query
def latest_documents(spark, sf):
    """The last document of every user."""
    events = load(spark, sf, "events").select(
        "user_id", F.col("event_id").alias("seq"), "event_type", "props")
    return documents.latest_documents(events, "user_id")


# -- joins ----------------------------------------------------------------------------


@query
def media_genres(spark, sf):
    links = load(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("media_id"), F.col("l_suppkey").alias("genre_id")).distinct()
    names = load(spark, sf, "supplier").select(
        F.lit("genre").alias("kind"), F.col("s_suppkey").alias("name_id"), F.col("s_name").alias("name"))
    return lookups.media_genres(links, names)


@query
def media_tags(spark, sf):
    """Links, tags and tag categories."""
    links = load(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("media_id"), F.col("l_suppkey").alias("tag_id")).distinct()
    tags = load(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("tag_id"), (F.col("s_suppkey") + 7).alias("ext_tag_id"),
        F.col("s_nationkey").alias("category_id"), F.col("s_name").alias("name"))
    names = load(spark, sf, "nation").select(
        F.lit("tagcategory").alias("kind"), F.col("n_nationkey").alias("name_id"),
        F.col("n_name").alias("name"))
    return lookups.media_tags(links, tags, names)


@query
def media_studios(spark, sf):
    """Studio links, made distinct over all lines, with their studio."""
    links = load(spark, sf, "lineitem").groupBy(
        F.col("l_partkey").alias("media_id"), F.col("l_suppkey").alias("studio_id")
    ).agg(F.bool_or(F.col("l_linenumber") == 1).alias("is_main"))
    studios = load(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("studio_id"), (F.col("s_suppkey") + 7).alias("ext_studio_id"),
        F.col("s_name").alias("name"))
    return lookups.media_studios(links, studios)


@query
def media_staff(spark, sf):
    links = load(spark, sf, "orders").select(
        F.col("o_orderkey").alias("media_id"), F.col("o_custkey").alias("staff_id"),
        F.upper("o_orderpriority").alias("role"))
    staff = load(spark, sf, "customer").select(
        F.col("c_custkey").alias("staff_id"), (F.col("c_custkey") + 7).alias("ext_staff_id"),
        F.col("c_mktsegment").alias("first_name"), F.col("c_name").alias("last_name"),
        F.concat_ws(" ", "c_mktsegment", "c_name").alias("full_name"),
        F.lit("null").alias("native_name"))
    return lookups.media_staff(links, staff)


@query
def media_alternative_names(spark, sf):
    rows = load(spark, sf, "customer").select(
        F.col("c_custkey").alias("media_id"), F.col("c_name").alias("name"),
        F.col("c_nationkey").alias("name_type_id"))
    names = load(spark, sf, "nation").select(
        F.lit("nametype").alias("kind"), F.col("n_nationkey").alias("name_id"),
        F.col("n_name").alias("name"))
    return lookups.media_names(rows, names)


@query
def missing_media(spark, sf):
    """Media ids in use that the catalogue does not hold."""
    used = load(spark, sf, "lineitem").select(F.col("l_orderkey").alias("ext_media_id"))
    known = load(spark, sf, "part").select(F.col("p_partkey").alias("ext_media_id"))
    return lookups.missing_keys(used, known, ["ext_media_id"])


@query
def names_to_ids(spark, sf):
    """Natural names and external ids replaced by surrogate keys."""
    customers = load(spark, sf, "customer").select(
        F.col("c_custkey").alias("ext_user_id"), F.col("c_name").alias("status"))
    names = customers.select(
        F.lit("watchstatus").alias("kind"), (F.col("ext_user_id") * 2 + 1).alias("name_id"),
        F.col("status").alias("name"))
    orders = load(spark, sf, "orders").select(
        "o_orderkey", F.col("o_custkey").alias("ext_user_id"),
        F.concat(F.lit("Customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0")).alias("status"))
    viewers = customers.select("ext_user_id", (F.col("ext_user_id") + 100).alias("viewer_id"))
    named = lookups.lookup_join(
        orders, lookups.names_of(names, "watchstatus", "status_id", "status"), ["status"])
    return lookups.lookup_join(named, viewers, ["ext_user_id"]).select(
        "o_orderkey", "viewer_id", "status_id")


# -- dimensions and keys ----------------------------------------------------------------


def _tag_mentions(spark, sf) -> DataFrame:
    return load(spark, sf, "events").select(
        F.col("user_id").alias("ext_tag_id"), F.col("event_type").alias("name"),
        F.col("props").alias("category"), F.col("event_id").alias("seq"))


@query
def first_seen_tags(spark, sf):
    """Tags keep the first name and category they were seen with."""
    return dimensions.first_seen(_tag_mentions(spark, sf), "ext_tag_id", ["name", "category"])


@query
def last_seen_staff(spark, sf):
    """Staff take the last names they were seen with."""
    return dimensions.last_seen(_tag_mentions(spark, sf), "ext_tag_id", ["name", "category"])


@query
def new_names(spark, sf):
    """Names not yet in the dimension."""
    part = load(spark, sf, "part")
    stored = part.filter("p_size > 40").select(F.lit("format").alias("kind"), F.col("p_name").alias("name"))
    incoming = part.select(F.lit("format").alias("kind"), F.col("p_name").alias("name")).unionByName(
        part.select(F.lit("source").alias("kind"), F.col("p_brand").alias("name"))).distinct()
    return dimensions.absent(incoming, stored, ["kind", "name"])


@query
def new_viewer_keys(spark, sf):
    """Keys given to viewers not stored yet: after the highest stored one, without gaps or repeats."""
    stored = load(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("ext_user_id"), (F.col("s_suppkey") + 1).alias("viewer_id"))
    incoming = load(spark, sf, "orders").select(F.col("o_custkey").alias("ext_user_id")).distinct()
    new = written(dimensions.absent(incoming, stored, ["ext_user_id"]), "new-viewers")
    numbered = assign_keys(new, ["ext_user_id"], "viewer_id", stored.count())
    return numbered.agg(
        F.count(F.lit(1)).alias("n_viewers"), F.count_distinct("viewer_id").alias("n_keys"),
        F.min("viewer_id").alias("lowest"), F.max("viewer_id").alias("highest"),
        F.sum("ext_user_id").alias("ext_total"))


@query
def media_overwrite(spark, sf):
    """Stored media overwritten where an attribute differs; new ones have no key yet."""
    stored = load(spark, sf, "customer").select(
        (F.col("c_custkey") + 1000).alias("media_id"), F.col("c_custkey").alias("ext_media_id"),
        F.lit("red widget").alias("title"), (F.col("c_nationkey") * 2).alias("episodes"))
    incoming = load(spark, sf, "part").select(
        F.col("p_partkey").alias("ext_media_id"), F.col("p_name").alias("title"),
        F.col("p_size").alias("episodes"))
    return dimensions.overwrite(stored, incoming, "ext_media_id", "media_id")


# -- two-way differences ------------------------------------------------------------------


def _part_scope(spark, sf) -> DataFrame:
    """The media a batch speaks for."""
    return load(spark, sf, "part").filter("p_type <> 'PROMO'").select(
        F.col("p_partkey").alias("media_id"))


def _line_links(spark, sf, condition: str, *columns) -> DataFrame:
    lines = load(spark, sf, "lineitem")
    links = lines.filter(condition).select(F.col("l_partkey").alias("media_id"), *columns)
    return dealt(links, lines.rdd.getNumPartitions(), *links.columns).distinct()


STORED_LINES, INCOMING_LINES = "l_returnflag <> 'A'", "l_returnflag <> 'R'"


def _link_diff(spark, sf, **keys: str) -> DataFrame:
    scope = _part_scope(spark, sf)
    columns = [F.col(source).alias(name) for name, source in keys.items()]
    stored = _line_links(spark, sf, STORED_LINES, *columns)
    incoming = _line_links(spark, sf, INCOMING_LINES, *columns)
    return two_way_diff(
        stored, incoming.join(scope, "media_id", "left_semi"), scope, "media_id", list(keys))


@query
def genre_link_diff(spark, sf):
    """What to insert, delete, keep or leave alone among genre links."""
    return _link_diff(spark, sf, genre_id="l_suppkey")


@query
def tag_links_after(spark, sf):
    """Tag links once the difference is carried out."""
    return after_diff(_link_diff(spark, sf, tag_id="l_suppkey"))


@query
def staff_link_changes(spark, sf):
    """Staff links to insert or delete; the role is part of the key."""
    return changes(_link_diff(spark, sf, staff_id="l_suppkey", role="l_linestatus"))


def _main_links(spark, sf, condition: str) -> DataFrame:
    return load(spark, sf, "lineitem").filter(condition).groupBy(
        F.col("l_partkey").alias("media_id"), F.col("l_suppkey").alias("studio_id")
    ).agg(F.bool_or(F.col("l_linestatus") == "O").alias("is_main"))


@query
def studio_link_diff(spark, sf):
    """Studio links whose main flag may change."""
    scope = _part_scope(spark, sf)
    incoming = _main_links(spark, sf, INCOMING_LINES).join(scope, "media_id", "left_semi")
    return two_way_diff(
        _main_links(spark, sf, STORED_LINES), incoming, scope, "media_id", ["studio_id"], ["is_main"])


@query
def name_rows_after(spark, sf):
    """Alternative names once the difference is carried out; rows that stay keep their key."""
    customer = load(spark, sf, "customer")
    stored = customer.select(
        (F.col("c_custkey") + 1).alias("media_name_id"), F.col("c_custkey").alias("media_id"),
        F.lit(1).cast("bigint").alias("name_type_id"), F.col("c_mktsegment").alias("name"))
    incoming = customer.select(
        F.col("c_custkey").alias("media_id"),
        F.when(F.col("c_acctbal") > 5000, 1).otherwise(2).cast("bigint").alias("name_type_id"),
        F.col("c_mktsegment").alias("name"))
    scope = customer.filter("c_mktsegment <> 'BUILDING'").select(F.col("c_custkey").alias("media_id"))
    diff = two_way_diff(
        stored, incoming.join(scope, "media_id", "left_semi"), scope, "media_id",
        ["name_type_id", "name"], retained=["media_name_id"])
    return after_diff(diff)


@query
def list_entry_diff(spark, sf):
    """List entries compared on their whole rows."""
    lines = load(spark, sf, "lineitem")
    scans = lines.rdd.getNumPartitions()

    def entries(condition: str) -> DataFrame:
        chosen = lines.filter(condition).withColumns(
            {"viewer_id": F.col("l_orderkey"), "media_id": F.col("l_partkey")})
        return dealt(chosen, scans, "viewer_id").groupBy("viewer_id", "media_id").agg(
            F.sum("l_linenumber").cast("int").alias("progress"), F.max("l_returnflag").alias("status"))

    scope = dealt(load(spark, sf, "orders").filter("o_orderstatus <> 'P'").select(
        F.col("o_orderkey").alias("viewer_id")), scans, "viewer_id")
    incoming = entries(INCOMING_LINES).join(scope, "viewer_id", "left_semi")
    return two_way_diff(
        entries(STORED_LINES), incoming, scope, "viewer_id", ["media_id"], ["progress", "status"])


@query
def equal_sets(spark, sf):
    """No change at all when both sides are equal."""
    links = _line_links(spark, sf, "true", F.col("l_suppkey").alias("genre_id"))
    scope = load(spark, sf, "part").select(F.col("p_partkey").alias("media_id"))
    diff = two_way_diff(links, links, scope, "media_id", ["genre_id"])
    return changes(diff).agg(F.count(F.lit(1)).alias("n_changes"))


# -- whole jobs ---------------------------------------------------------------------------


@query
def media_reconcile(spark, sf):
    """All relations after two batches of media documents."""
    store = _store(spark, "media")
    for batch in inputs.media_batches(spark, sf):
        reconcile_media(store, batch)
    return views.relations(store)


@query
def media_stream(spark, sf):
    """All relations after the same documents arrived as a stream."""
    store, topic = _store(spark, "media"), new_scratch(spark, "topic")
    checkpoint = new_scratch(spark, "checkpoint")
    for batch in inputs.media_batches(spark, sf):
        topics.write_topic(batch, "parquet", {"path": topic})
        stream = topics.stream_topic(spark, "parquet", {"path": topic})
        consume_media(stream, store, checkpoint, bounded=True).start().awaitTermination()
    return views.relations(store)


@query
def media_versions(spark, sf):
    """Two versions of every part's document, published under the same number, read as one batch."""
    store, topic = _store(spark, "versions"), new_scratch(spark, "topic")
    for extra in (0, 100):
        docs = inputs.catalogue_documents(spark, sf, extra)
        topics.write_topic(docs, "parquet", {"path": topic})
    stream = topics.stream_topic(spark, "parquet", {"path": topic})
    consume_media(stream, store, new_scratch(spark, "checkpoint"), bounded=True).start().awaitTermination()
    return store.read("media").select("ext_media_id", "title", "episodes")


def _catalogue(spark, sf) -> Store:
    store = _store(spark, "lists")
    reconcile_media(store, inputs.catalogue_documents(spark, sf))
    return store


@query
def list_reconcile(spark, sf):
    """List entries, and entries that wait for their media, after two batches."""
    store = _catalogue(spark, sf)
    for batch in inputs.list_batches(spark, sf):
        reconcile_lists(store, batch)
    return _list_rows(store)


def _list_rows(store: Store) -> DataFrame:
    """Stored list entries and those that wait for their media."""
    known = views.list_entries(store).withColumn("waits", F.lit(False))
    status = lookups.names_of(store.read("name"), "watchstatus", "status_id", "status")
    waiting = lookups.lookup_join(store.read("pending_entry"), store.read("viewer"), ["viewer_id"])
    waiting = lookups.lookup_join(waiting, status, ["status_id"]).drop("viewer_id", "status_id")
    return known.unionByName(waiting.withColumn("waits", F.lit(True)))


@query
def list_stream(spark, sf):
    """The same after the documents arrived as a stream, the last batch twice."""
    store, topic = _catalogue(spark, sf), new_scratch(spark, "topic")
    checkpoint = new_scratch(spark, "checkpoint")
    first, second = inputs.list_batches(spark, sf)
    for batch in (first, second, second):
        topics.write_topic(batch, "parquet", {"path": topic})
        stream = topics.stream_topic(spark, "parquet", {"path": topic})
        consume_lists(stream, store, checkpoint, bounded=True).start().awaitTermination()
    return _list_rows(store)


@query
def list_replay(spark, sf):
    """List rows after a committed batch came again under its number, with other documents."""
    store = _catalogue(spark, sf)
    first, second = inputs.list_batches(spark, sf)
    reconcile_lists(store, first, batch_id=0)
    reconcile_lists(store, second, batch_id=1)
    reconcile_lists(store, first, batch_id=1)
    return _list_rows(store)


@query
def waiting_media(spark, sf):
    """Media that stored list entries wait for."""
    store = _catalogue(spark, sf)
    for batch in inputs.list_batches(spark, sf):
        reconcile_lists(store, batch)
    return media_requests(store)


@query
def lists_refreshed(spark, sf):
    """Lists of chosen users fetched and reconciled, unknown media fetched on the way."""
    customer = load(spark, sf, "customer")
    entry = F.struct(
        F.col("c_custkey").cast("int").alias("userId"), F.col("c_nationkey").alias("mediaId"),
        F.struct(F.lit(2001).alias("year")).alias("startedAt"),
        F.struct(F.lit(2).alias("month")).alias("completedAt"),
        F.lit(7.5).alias("score"), F.lit(1).alias("progress"), F.lit(0).alias("repeat"),
        F.col("c_mktsegment").alias("status"))

    def branch(entries):
        lists = F.array(F.struct(entries.alias("entries")))
        inner = F.struct(F.struct(lists.alias("lists")).alias("MediaListCollection"))
        return F.to_json(F.struct(inner.alias("data")))

    lists = customer.select(
        F.col("c_custkey").alias("id"), branch(F.array(entry, entry)).alias("anime"),
        branch(F.array(entry)).alias("manga"))
    parts = inputs.catalogue_documents(spark, sf).select(
        F.col("seq").cast("int").alias("id"), F.col("value").alias("data"))
    store = _store(spark, "refreshed")
    users = customer.filter("c_acctbal > 0").select(F.col("c_custkey").alias("ext_user_id"))
    serving.refresh_lists(
        store, users, requests.from_table(lists, "anime", "manga"), requests.from_table(parts, "data"))
    return views.list_entries(store)


# -- serving ------------------------------------------------------------------------------


def _viewers(spark, sf) -> DataFrame:
    return load(spark, sf, "customer").select(
        (F.col("c_custkey") + 1).alias("viewer_id"), F.col("c_custkey").alias("ext_user_id"))


def _recommendations(spark, sf) -> DataFrame:
    entries = inputs.line_entries(spark, sf)
    return entries.groupBy(
        (F.col("ext_user_id") + 1).alias("viewer_id"), (F.col("ext_media_id") + 5).alias("media_id")
    ).agg(F.max("repeat").alias("score"))


@query
def stored_recommendations(spark, sf):
    """Stored recommendations of all users with a balance, lowest score first."""
    media = load(spark, sf, "part").select(
        (F.col("p_partkey") + 5).alias("media_id"), F.col("p_partkey").alias("ext_media_id"),
        F.col("p_name").alias("title"))
    users = load(spark, sf, "customer").filter("c_acctbal > 0").select(
        F.col("c_custkey").alias("ext_user_id"))
    return serving.stored_recommendations(
        users, _viewers(spark, sf), _recommendations(spark, sf), media)


@query
def refresh_decisions(spark, sf):
    """Whether a request is answered from stored rows."""
    asked = load(spark, sf, "events").select(
        "event_id", F.col("user_id").alias("ext_user_id"), _parameters().alias("params"))
    stored = load(spark, sf, "orders").filter("o_orderpriority = '1-URGENT'").select(
        (F.col("o_custkey") + 1).alias("viewer_id"))
    return serving.refresh_decisions(asked, _viewers(spark, sf), stored).select(
        "event_id", "ext_user_id", "n_stored", "decision")


@query
def users_by_name(spark, sf):
    """Requests by name resolved to user ids; unknown names are marked."""
    customer = load(spark, sf, "customer")
    directory = customer.select(F.col("c_name").alias("name"), F.col("c_custkey").alias("ext_user_id"))
    asked = directory.select("name").unionByName(
        load(spark, sf, "supplier").select(F.col("s_name").alias("name")))
    return serving.resolve_users(asked, directory)


@query
def requests_answered(spark, sf):
    """Every event as a request by id, every customer and supplier as one by name, in one plan."""
    events, customer = load(spark, sf, "events"), load(spark, sf, "customer")
    no_id, no_name = F.lit(None).cast("bigint"), F.lit(None).cast("string")
    by_id = events.select(F.col("event_id").alias("request"), no_name.alias("name"), F.when(
        F.col("event_id") % 50 != 0, F.col("user_id")).alias("ext_user_id"), _parameters().alias("params"))
    by_name = customer.select(
        (-1 - F.col("c_custkey")).alias("request"), F.col("c_name").alias("name"), no_id.alias("ext_user_id"),
        F.when(F.col("c_custkey") % 2 == 0, '{"k": 1}').otherwise("{}").alias("params")).unionByName(
        load(spark, sf, "supplier").select(
            (-1_000_000 - F.col("s_suppkey")).alias("request"), F.col("s_name").alias("name"),
            no_id.alias("ext_user_id"), F.lit("{}").alias("params")))
    directory = customer.select(F.col("c_name").alias("name"), F.col("c_custkey").alias("ext_user_id"))
    rows = _scores(spark, sf).select(F.col("user").alias("ext_user_id"), F.col("item").alias("media_id"), "score")
    stored = rows.where("score >= 45")
    held = stored.select((F.col("ext_user_id") + 1).alias("viewer_id"))
    routes = serving.routed(by_id.unionByName(by_name), directory, _viewers(spark, sf), held)
    return serving.answered(routes, stored, rows.where("score = 1"))


# -- computing and filtering recommendations -----------------------------------------------


def _scores(spark, sf) -> DataFrame:
    """The greatest quantity of a part in a customer's orders."""
    return inputs.line_entries(spark, sf).groupBy(
        F.col("ext_user_id").alias("user"), F.col("ext_media_id").alias("item")
    ).agg(F.max("repeat").alias("score"))


@query
def rank_one_factors(spark, sf):
    """Two rounds of alternating least squares with one factor over all customers and parts."""
    users, media, _ = recommend.factors(
        _scores(spark, sf), rank=1, shrink=2.0, rounds=2,
        start=lambda item, rank: F.array(((item % 7 + 1) / 10).cast("double")))
    sides = {"user": users, "media": media}
    return audit.union_all([
        side.select(F.lit(name).alias("side"), "id", F.round(F.col("factor")[0], 6).alias("factor"))
        for name, side in sides.items()])


@query
def best_unseen_media(spark, sf):
    """The five best parts of every customer that no order of theirs holds, by whole numbers."""
    users = load(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.array(
        (F.col("c_nationkey") % 5 - 2).cast("double"), F.floor(F.col("c_acctbal") / 1000).cast("double")).alias("factor"))
    media = load(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.array(
        (F.col("p_size") % 7 - 3).cast("double"), (F.col("p_partkey") % 11 - 5).cast("double")).alias("factor"))
    seen = inputs.line_entries(spark, sf).select(
        F.col("ext_user_id").alias("user"), F.col("ext_media_id").alias("item"))
    return recommend.best_unseen(users, media, seen, 5)


@query
def computed_recommendations(spark, sf):
    """Factors of all customers and parts, and the ten best unseen parts of every customer."""
    scores = written(_scores(spark, sf), "scores", keep_shuffles=False)
    users, media, mean = recommend.factors(scores)
    best = recommend.best_unseen(users, media, scores, 10)
    return best.select("user", "item", (F.col("score") + F.lit(mean)).alias("score"), "rank")


@query
def recommendations_replaced(spark, sf):
    """Stored recommendations after those of every third customer were replaced, twice the same."""
    path, stored = new_scratch(spark, "stored"), _recommendations(spark, sf)
    recommend.store_recommendations(stored, path, 16)
    viewers = load(spark, sf, "customer").where("c_custkey % 3 = 0").select((F.col("c_custkey") + 1).alias("viewer_id"))
    made = stored.where("media_id % 2 = 0").select("viewer_id", "media_id", (F.col("score") + 100).alias("score"))
    for _ in range(2):
        recommend.replace_recommendations(path, viewers, made, 16)
    return recommend.read_recommendations(spark, path).select("viewer_id", "media_id", "score")


def _asked_filters(spark, sf) -> DataFrame:
    """Requests with parameters of all kinds, by the event's number."""
    n = F.col("event_id")

    def one_of(by: int, *texts: str) -> F.Column:
        return F.element_at(F.array(*map(F.lit, texts)), (n % by + 1).cast("int"))

    body = F.concat(
        F.lit("{"),
        one_of(8, '"genres":["red","widget"]', '"genres":"small"', '"genres":[]', '"genres":null', '"genres":[1]',
               '"genres":["blue"]', '"genres":["blue"]', '"genres":["blue"]'),
        one_of(5, ',"format":["SMALL","LARGE","SMALL"]', ',"format":"ECONOMY"', ',"color":"red"', "", ""),
        one_of(7, ',"startedAfter":"2000-06-15"', ',"startedBefore":"2001-02-30"',
               ',"endedBefore":"2002-01-01","startedAfter":"2000-02-01"', ',"endedAfter":20010101', "", "", ""),
        one_of(3, ',"refresh":"true"', "", ""), F.lit("}"))
    params = F.when(n % 31 == 0, "[1]").when(n % 37 == 0, '{"genres":"a","genres":"b"}').otherwise(body)
    return load(spark, sf, "events").select(n.alias("request_id"), F.col("user_id"), params.alias("params"))


@query
def typed_parameters(spark, sf):
    """Every parameter of every request by its type, or why it is turned down."""
    return filters.typed_parameters(_asked_filters(spark, sf))


@query
def filtered_recommendations(spark, sf):
    """The parts of every request's customer that pass all of its filters."""
    asked = _asked_filters(spark, sf)
    parts = load(spark, sf, "part")
    begin = F.date_add(F.lit("2000-01-01").cast("date"), (F.col("p_partkey") % 600).cast("int"))
    media = parts.select(F.col("p_partkey").alias("media_id"), begin.alias("date_start"),
                         F.date_add(begin, F.col("p_size").cast("int")).alias("date_end"))
    genres = parts.select(F.col("p_partkey").alias("media_id"), F.lit("genres").alias("key"),
                          F.explode(F.split("p_name", " ")).alias("name"))
    formats = parts.select(F.col("p_partkey").alias("media_id"), F.lit("format").alias("key"), F.col("p_type").alias("name"))
    stored = inputs.line_entries(spark, sf).select(
        F.col("ext_user_id").alias("user_id"), F.col("ext_media_id").alias("media_id")).distinct()
    candidates = asked.select(F.col("request_id").alias("request"), "user_id")
    return filters.filtered(
        candidates, filters.typed_parameters(asked), genres.unionByName(formats), media, stored, "user_id")


@query
def orders_in_windows(spark, sf):
    """How many orders fall in each event's span of days; some spans are empty, some very long."""
    n = F.col("event_id")
    low = F.when(n % 101 != 0, F.date_add(F.lit("1995-01-01").cast("date"), (n * 37 % 2400).cast("int")))
    days = F.when(n % 11 == 0, -1).when(n % 97 == 0, 3650).otherwise(n % 5).cast("int")
    spans = load(spark, sf, "events").select("event_id", low.alias("low"), F.date_add(low, days).alias("high"))
    orders = load(spark, sf, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("ordered"))
    totals = [F.count("*").alias("n_orders"), F.sum("o_orderkey").alias("keys")]
    return ranges.in_interval(orders, "ordered", spans, "low", "high", totals).groupBy("event_id").agg(
        F.sum("n_orders").alias("n_orders"), F.sum("keys").alias("keys"))


# -- audits -------------------------------------------------------------------------------


@query
def repeated_keys(spark, sf):
    """Keys held by more than one row."""
    return audit.duplicate_keys(load(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query
def orphaned_references(spark, sf):
    """References without a parent."""
    lines, part = load(spark, sf, "lineitem"), load(spark, sf, "part")
    checks = {
        "l_partkey": (lines, part, "p_partkey"),
        "l_orderkey": (lines, part, "p_partkey"),
        "doc_id": (load(spark, sf, "labels"), load(spark, sf, "customer"), "c_custkey"),
    }
    found = [
        audit.orphans(child, column, parent, key).withColumn("reference", F.lit(column))
        for column, (child, parent, key) in checks.items()]
    return audit.union_all(found)


@query
def missing_values(spark, sf):
    """Nulls per column."""
    orders = load(spark, sf, "orders")
    frame = orders.select(
        "o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_custkey")).alias("o_custkey"),
        F.when(F.col("o_totalprice") > 100000, F.col("o_orderpriority")).alias("o_orderpriority"))
    return audit.null_counts(frame, frame.columns)


@query
def overlong_values(spark, sf):
    """Values longer than their bound."""
    return audit.too_long(load(spark, sf, "documents"), {"text": 500, "source": 10, "lang": 50})


@query
def declared_keys(spark, sf):
    """Unique keys and references over all given tables in one pass, some of them broken."""
    t = {n: load(spark, sf, n) for n in (
        "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels",
        "pages", "embeddings")}
    keys = {
        "region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey",
        "part": "p_partkey", "orders": "o_orderkey", "events": "event_id", "documents": "doc_id", "labels": "doc_id",
        "pages": "page_id", "embeddings": "vec_id"}
    unique = {name: (t[name], [key]) for name, key in keys.items()}
    unique["lines"] = (t["lineitem"], ["l_orderkey", "l_linenumber"])
    unique["users of events"] = (t["events"], ["user_id"])
    kept = t["part"].where("p_partkey % 10 <> 0")
    references = {
        "nation.region": (t["nation"], ["n_regionkey"], t["region"], ["r_regionkey"]),
        "customer.nation": (t["customer"], ["c_nationkey"], t["nation"], ["n_nationkey"]),
        "order.customer": (t["orders"], ["o_custkey"], t["customer"], ["c_custkey"]),
        "line.order": (t["lineitem"], ["l_orderkey"], t["orders"], ["o_orderkey"]),
        "line.part": (t["lineitem"], ["l_partkey"], kept, ["p_partkey"]),
        "line.supplier and flag": (
            t["lineitem"].withColumn("flag", F.when(F.col("l_returnflag") != "N", F.lit("R"))), ["l_suppkey", "flag"],
            t["supplier"].where("s_suppkey % 3 = 0").withColumn("flag", F.lit("R")), ["s_suppkey", "flag"]),
        "label.document": (t["labels"], ["doc_id"], t["documents"], ["doc_id"]),
    }
    return audit.key_checks(unique, references)
