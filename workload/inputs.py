"""Catalogue-shaped frames and documents derived from the given tables.

Every document is built from one row, so nothing is collected to make it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediashelf.operators.lookups import lookup_join

# Where the inputs are cut into a first and a second batch.
ORDER_CUT = "1998-04-01"
EVENT_CUT = "2024-01-30"
UNKNOWN_MEDIA = 1_000_000
WITH_NULLS = {"ignoreNullFields": "false"}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def load_spread(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table for row-wise work that costs far more than its bytes suggest.

    A scan of fewer tasks than there are cores is dealt out to all of them; their number is given,
    as adaptive execution would join such small parts again.  Larger tables are not shuffled.
    """
    table, cores = load(spark, sf_dir, name), spark.sparkContext.defaultParallelism
    return table if table.rdd.getNumPartitions() >= cores else table.repartition(cores)


# -- media documents: one per order, for the order's customer ------------------------


def order_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with the values a media document is made of."""
    date = F.col("o_orderdate").cast("date")
    return load_spread(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("seq"),
        F.col("o_custkey").cast("int").alias("id"),
        F.col("o_orderstatus").alias("st"),
        F.col("o_orderpriority").alias("pr"),
        F.col("o_totalprice").alias("price"),
        date.alias("ordered"),
        F.year(date).alias("y"),
        F.month(date).alias("m"),
        F.day(date).alias("d"),
    )


def media_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``ordered, seq, value``; cheap orders are error documents, some lack their tags."""
    st, pr, y, m, d = (F.col(c) for c in ("st", "pr", "y", "m", "d"))
    broken = (st == "P") & (pr == "3-MEDIUM")
    person = F.struct(
        d.alias("id"),
        F.struct(st.alias("first"), pr.alias("last"), F.concat_ws(" ", st, pr).alias("full"),
                 F.lit(None).cast("string").alias("native")).alias("name"),
    )
    tags = F.array(
        F.struct(m.alias("id"), F.concat(st, m).alias("name"), pr.alias("category")),
        F.struct(m.alias("id"), F.concat(st, m).alias("name"), pr.alias("category")),
        F.struct((F.substring(pr, 1, 1).cast("int") + 100).alias("id"), pr.alias("name"),
                 st.alias("category")),
    )
    studios = F.array(
        F.struct((st == "O").alias("isMain"), F.struct(y.alias("id"), st.alias("name")).alias("node")),
        F.struct((st == "O").alias("isMain"), F.struct(y.alias("id"), st.alias("name")).alias("node")),
        F.struct(F.lit(False).alias("isMain"),
                 F.struct((m + 10).alias("id"), pr.alias("name")).alias("node")),
    )
    staff = F.array(
        F.struct(F.lower(pr).alias("role"), person.alias("node")),
        F.struct(F.lower(pr).alias("role"), person.alias("node")),
        F.struct(F.lower(st).alias("role"), person.alias("node")),
    )
    body = F.struct(
        "id",
        F.when(st == "O", "ANIME").otherwise("MANGA").alias("type"),
        F.struct(
            F.concat_ws(" ", pr, y).alias("romaji"), F.when(st != "F", pr).alias("english"),
            st.alias("native")).alias("title"),
        F.array(pr, st, pr).alias("synonyms"),
        F.struct(y.alias("year"), m.alias("month"), (d + 3).alias("day")).alias("startDate"),
        F.struct(F.when(st != "P", y).alias("year"), m.alias("month")).alias("endDate"),
        F.col("price").alias("episodes"),
        F.floor("price").cast("int").alias("duration"),
        m.alias("volumes"),
        F.when(pr != "5-LOW", pr).alias("format"),
        F.concat(F.lit("S"), m).alias("source"),
        st.alias("status"),
        F.when(~broken, tags).alias("tags"),
        F.when(st == "F", F.array().cast("array<string>")).otherwise(F.split(pr, "-")).alias("genres"),
        F.struct(studios.alias("edges")).alias("studios"),
        F.struct(staff.alias("edges")).alias("staff"),
    )
    document = F.to_json(F.struct(F.struct(body.alias("Media")).alias("data")), WITH_NULLS)
    error = F.lit('{"errors":[{"message":"Not Found."}],"data":null}')
    return order_columns(spark, sf_dir).select(
        "ordered", "seq", F.when(F.col("price") < 50000, error).otherwise(document).alias("value"))


def media_batches(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    docs = media_documents(spark, sf_dir)
    late = F.col("ordered") >= F.to_date(F.lit(ORDER_CUT))
    return [docs.filter(~late).drop("ordered"), docs.filter(late).drop("ordered")]


def catalogue_documents(spark: SparkSession, sf_dir: str, extra: int = 0) -> DataFrame:
    """A plain media document per part; ``extra`` makes another version of it."""
    nothing = F.array().cast("array<string>")
    empty = F.struct(nothing.alias("edges"))
    dates = F.struct(F.lit(2000).alias("year"))
    body = F.struct(
        F.col("p_partkey").cast("int").alias("id"), F.lit("ANIME").alias("type"),
        F.struct(F.col("p_name").alias("romaji"), F.lit(None).cast("string").alias("english"),
                 F.lit(None).cast("string").alias("native")).alias("title"), nothing.alias("synonyms"),
        dates.alias("startDate"), dates.alias("endDate"), (F.col("p_size") + extra).alias("episodes"),
        F.col("p_type").alias("format"), F.col("p_brand").alias("source"),
        F.lit("FINISHED").alias("status"), nothing.alias("tags"),
        F.split("p_name", " ").alias("genres"), empty.alias("studios"), empty.alias("staff"),
    )
    return load_spread(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("seq"),
        F.to_json(F.struct(F.struct(body.alias("Media")).alias("data")), WITH_NULLS).alias("value"))


# -- list documents: one per event, for the event's user -----------------------------


def _entry(media, progress, repeat) -> F.Column:
    when = F.col("ts").cast("date")
    return F.struct(
        F.col("user_id").cast("int").alias("userId"),
        media.cast("int").alias("mediaId"),
        F.struct(F.year(when).alias("year"), F.month(when).alias("month"), F.day(when).alias("day"))
        .alias("startedAt"),
        F.struct(F.lit(2024).alias("year"), (F.col("k") + 1).alias("day")).alias("completedAt"),
        (F.col("value") / 50).alias("score"),
        progress.cast("int").alias("progress"),
        repeat.cast("int").alias("repeat"),
        F.when(F.col("event_type") != "view", F.col("event_type")).alias("status"),
    )


def list_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``ts, seq, value``: the same media in two lists and in both branches, one unknown media.

    Error events have an error document in one branch.
    """
    k = F.get_json_object("props", "$.k").cast("int")
    events = load_spread(spark, sf_dir, "events").withColumn("k", k)
    media, unknown = F.col("k"), F.col("k") + UNKNOWN_MEDIA
    whole = F.floor("value").cast("int")

    def branch(*lists):
        entries = F.array(*[F.struct(F.array(*x).alias("entries")) for x in lists])
        inner = F.struct(entries.alias("lists")).alias("MediaListCollection")
        return F.to_json(F.struct(F.struct(inner).alias("data")), WITH_NULLS)

    anime = branch(
        [_entry(media, whole, F.lit(0)), _entry(media * 2, F.lit(2), F.lit(1))],
        [_entry(media, F.lit(3), F.lit(2))],
    )
    manga = branch([_entry(media, F.lit(5), F.lit(1)), _entry(unknown, F.lit(1), F.lit(0))])
    error = F.lit('{"errors":[{"message":"Private"}],"data":null}')
    shown = F.when(F.col("event_type") == "error", error).otherwise(manga)
    return events.select(
        "ts", F.col("event_id").alias("seq"),
        F.concat(F.lit('{"anime":'), anime, F.lit(',"manga": '), shown, F.lit("}")).alias("value"))


def list_batches(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    docs = list_documents(spark, sf_dir)
    late = F.col("ts") >= F.lit(EVENT_CUT).cast("timestamp_ntz")
    return [docs.filter(~late).drop("ts"), docs.filter(late).drop("ts")]


# -- flat frames -------------------------------------------------------------------


def line_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """List entries as order lines: the viewer is the customer, the media the part."""
    lines = load_spread(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_partkey").alias("ext_media_id"),
        F.col("l_shipdate").cast("date").alias("date_end"),
        F.col("l_discount").alias("discount"),
        F.col("l_quantity").cast("int").alias("repeat"),
        F.col("l_returnflag").alias("status"),
    )
    orders = load(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("ext_user_id"),
        F.col("o_orderdate").cast("date").alias("date_start"))
    return lookup_join(lines, orders, ["l_orderkey"])

