"""The same results in SQL, by query name."""

from __future__ import annotations

from workload.inputs import EVENT_CUT, ORDER_CUT, UNKNOWN_MEDIA

ORACLES: dict[str, str] = {}

DEFAULT_DATE = "DATE '1900-01-01'"


def _date(y: str, m: str, d: str) -> str:
    return f"coalesce(try_cast(printf('%04d-%02d-%02d', {y}, {m}, {d}) AS DATE), {DEFAULT_DATE})"


ORACLES["ticks_to_documents"] = """
SELECT CAST(event_id // 10 AS INTEGER) AS id,
       CASE WHEN event_id % 10 = 0 THEN props ELSE '{"errors":' END AS data
FROM events"""

ORACLES["id_walk"] = """
SELECT c_custkey AS seq, '{"name":"' || c_name || '"}' AS value
FROM customer
WHERE c_acctbal >= 0 AND c_custkey <= (
  SELECT coalesce(arg_min(c_custkey + 500, c_custkey), 5) FROM customer WHERE c_acctbal > 0)"""

ORACLES["fetched_documents"] = """
SELECT p_partkey AS id, '{"id":' || p_partkey || '}' AS data,
       CAST(2 * p_partkey AS VARCHAR) AS twice
FROM part"""


# The request texts.
MEDIA_QUERY = (
    "query ($id: Int) { Media(id: $id, id_not: 0) { id type title { romaji english native }"
    " synonyms startDate { year month day } endDate { year month day } episodes duration chapters"
    " volumes format source status tags { id name category } genres"
    " studios { edges { id isMain node { id name } } }"
    " staff { edges { id role node { id name { first last full native } } } } } }"
)
LIST_QUERY = (
    "query ($userId: Int) { MediaListCollection(userId: $userId, type: %s) { lists { entries"
    " { userId id mediaId startedAt { year month day } completedAt { year month day } score progress"
    " repeat media { id type } status } } } }"
)
USER_QUERY = "query ($name: String) { User(name: $name) { id } }"


def _request(query: str, variable: str, value: str) -> str:
    return f"""'{{"query":"{query}","variables":{{"{variable}":' || {value} || '}}}}'"""


ORACLES["request_documents"] = f"""
SELECT p_partkey, {_request(MEDIA_QUERY, "id", "p_partkey")} AS request FROM part"""

ORACLES["list_request_documents"] = f"""
SELECT c_custkey,
       {_request(LIST_QUERY % "ANIME", "userId", "c_custkey")} AS anime,
       {_request(LIST_QUERY % "MANGA", "userId", "c_custkey")} AS manga,
       {_request(USER_QUERY, "name", "'" + '"' + "' || c_name || '" + '"' + "'")} AS by_name
FROM customer"""

ORACLES["config_values"] = """
WITH wanted AS (SELECT c_mktsegment AS counter_name FROM customer UNION SELECT n_name FROM nation),
stored AS (
  SELECT c_mktsegment AS counter_name,
         arg_min(CAST(floor(c_acctbal) AS INTEGER), c_custkey) AS value
  FROM customer WHERE c_acctbal >= 5000 GROUP BY 1)
SELECT counter_name, coalesce(CAST(value AS VARCHAR), '5') AS value
FROM wanted LEFT JOIN stored USING (counter_name)"""

ORACLES["starting_offsets"] = """
SELECT event_id,
       CASE event_type WHEN 'view' THEN 'latest'
            WHEN 'signup' THEN '{"signup":{"0":' || user_id || '}}'
            ELSE 'earliest' END AS starting_offsets
FROM events"""

_ORDER_TOPIC = """
SELECT o_orderkey AS seq,
       '{"id":' || o_custkey || ',"status":"' || o_orderstatus || '"}' AS value
FROM orders"""
ORACLES["topic_round_trip"] = _ORDER_TOPIC
ORACLES["first_record"] = _ORDER_TOPIC + " ORDER BY seq LIMIT 1"

ORACLES["published_media"] = """
SELECT c_custkey AS seq, c_name AS value
FROM customer
WHERE c_acctbal >= 0
  AND c_custkey IN (SELECT event_id // 10 FROM events WHERE event_id % 10 = 0)
  AND c_custkey <= (
    SELECT coalesce(arg_min(c_custkey + 500, c_custkey), 5) FROM customer WHERE c_acctbal > 0)"""

ORACLES["published_lists"] = """
WITH sides AS (
  SELECT c_custkey AS seq,
         CASE WHEN c_acctbal < 3000 THEN '{"errors":' ELSE '{"c_name":"' || c_name || '"}' END AS a,
         CASE WHEN c_acctbal > 2000 THEN '{"errors":' ELSE '{"c_name":"' || c_name || '"}' END AS m
  FROM customer WHERE c_custkey IN (SELECT event_id // 10 FROM events WHERE event_id % 10 = 0))
SELECT seq, '{"anime":' || a || ',"manga": ' || m || '}' AS value
FROM sides WHERE a <> '{"errors":' OR m <> '{"errors":'"""

ORACLES["good_payloads"] = """
WITH sides AS (
  SELECT event_id AS seq,
         CASE WHEN event_type = 'error' THEN '{"errors":' ELSE props END AS a,
         CASE WHEN value < 20 THEN '{"errors":' ELSE props END AS m
  FROM events)
SELECT seq, '{"anime":' || a || ',"manga": ' || m || '}' AS value
FROM sides WHERE a <> '{"errors":' OR m <> '{"errors":'"""

ORACLES["partial_dates"] = f"""
WITH parts AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
         CASE WHEN l_linenumber = 1 THEN 1900 ELSE year(l_shipdate) END AS y,
         CASE WHEN l_linenumber = 2 THEN 1 ELSE month(l_shipdate) END AS m,
         CASE WHEN l_returnflag = 'N' THEN 1 ELSE l_linenumber + 26 END AS d
  FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {_date('y', 'm', 'd')} AS date,
       strftime({_date('y', 'm', 'd')}, '%Y-%m-%d') AS iso
FROM parts"""

ORACLES["integers_from_text"] = r"""
WITH texts AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
         CASE l_linenumber WHEN 1 THEN CAST(l_partkey AS VARCHAR)
              WHEN 2 THEN CAST(l_quantity AS VARCHAR)
              WHEN 3 THEN 'x' || l_partkey WHEN 4 THEN '-' || l_partkey
              WHEN 5 THEN ' ' || l_partkey WHEN 6 THEN l_partkey || '99999999' END AS t
  FROM lineitem),
ints AS (
  SELECT *, CASE WHEN regexp_full_match(t, '[+-]?[0-9]+') THEN try_cast(t AS INTEGER) END AS strict
  FROM texts)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, coalesce(strict, 0) AS lenient, strict
FROM ints"""

ORACLES["score_points"] = """
SELECT event_id, CAST(trunc(value / 50 * 10) AS INTEGER) AS points,
       CAST(trunc(-value / 3 * 10) AS INTEGER) AS below_zero
FROM events"""

ORACLES["flags_and_roles"] = """
WITH t AS (
  SELECT *, CASE WHEN o_orderpriority <> '5-LOW' THEN lower(o_orderpriority) END AS role FROM orders)
SELECT o_orderkey,
       CASE o_orderstatus WHEN 'F' THEN true WHEN 'O' THEN false END AS flag,
       upper(coalesce(role, 'null')) AS role, coalesce(role, 'null') AS text
FROM t"""

ORACLES["cleaned_titles"] = """
WITH t AS (SELECT doc_id, text,
  CASE WHEN starts_with(text, '"') THEN substr(text, 2) ELSE text END AS one FROM documents)
SELECT doc_id, text AS both, md5(one) AS one_md5, md5(replace(text, '''', '''''')) AS escaped_md5
FROM t"""

ORACLES["title_names"] = """
WITH pairs AS (
  SELECT p_partkey, 'synonyms' AS kind, unnest(string_split(p_name, ' ')) AS name FROM part
  UNION SELECT p_partkey, 'synonyms', p_type FROM part
  UNION SELECT p_partkey, 'romaji', p_name FROM part
  UNION SELECT p_partkey, 'english', p_brand FROM part WHERE p_size > 25
  UNION SELECT p_partkey, 'native', p_type FROM part WHERE p_size > 10)
SELECT * FROM pairs WHERE name <> 'null'"""

_PARAMS = """
params AS (
  SELECT *, CASE event_type
    WHEN 'view' THEN '{"refresh":"true",' || substr(props, 2)
    WHEN 'click' THEN '{"refresh":true,' || substr(props, 2)
    WHEN 'signup' THEN props
    WHEN 'purchase' THEN CASE WHEN value < 30 THEN '{"refresh":"true"}' ELSE '{}' END
    ELSE CASE WHEN value < 30 THEN '[1]' ELSE '{broken' END END AS p
  FROM events),
checked AS (
  SELECT *, CASE WHEN json_valid(p) THEN json_type(p) = 'OBJECT' ELSE false END AS is_object,
         CASE WHEN json_valid(p) THEN json(p) END AS j
  FROM params),
flags AS (
  SELECT *,
         coalesce(json_type(j, '$.refresh') = 'VARCHAR' AND j ->> '$.refresh' = 'true', false)
           AS refresh,
         CASE WHEN is_object THEN CAST(len(list_filter(json_keys(j), lambda k: k <> 'refresh'))
              AS INTEGER) END AS n_other
  FROM checked)"""

ORACLES["request_parameters"] = f"WITH {_PARAMS} SELECT event_id, is_object, refresh, n_other FROM flags"

ORACLES["highest_ids"] = """
SELECT coalesce(max(user_id), 0) AS highest,
       CAST(coalesce(max(user_id) FILTER (WHERE value < 0), 0) AS BIGINT) AS of_none
FROM events"""

_MEDIA = f"""
raw AS (
  SELECT o_orderkey AS seq, o_custkey AS id, o_orderstatus AS st, o_orderpriority AS pr,
         o_totalprice AS price, year(o_orderdate) AS y, month(o_orderdate) AS m,
         day(o_orderdate) AS d,
         CASE WHEN CAST(o_orderdate AS DATE) < DATE '{ORDER_CUT}' THEN 1 ELSE 2 END AS batch
  FROM orders),
valid AS (
  SELECT * FROM raw WHERE price >= 50000 AND NOT (st = 'P' AND pr = '3-MEDIUM')),
latest AS (
  SELECT * FROM valid
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY batch DESC, seq DESC) = 1)"""

_TAGS = """
SELECT {key}, batch, seq, m AS ext_tag_id, st || m AS name, pr AS category FROM {source}
UNION ALL
SELECT {key}, batch, seq, 100 + CAST(substr(pr, 1, 1) AS INTEGER), pr, st FROM {source}"""
_STUDIOS = """
SELECT {key}, batch, seq, y AS ext_studio_id, st AS name, st = 'O' AS is_main FROM {source}
UNION ALL
SELECT {key}, batch, seq, m + 10, pr, false FROM {source}"""
_STAFF = """
SELECT {key}, batch, seq, d AS ext_staff_id, st AS first_name, pr AS last_name,
       st || ' ' || pr AS full_name, 'null' AS native_name, upper(pr) AS role FROM {source}
UNION ALL
SELECT {key}, batch, seq, d, st, pr, st || ' ' || pr, 'null', upper(st) FROM {source}"""
_TITLES = """
SELECT {key}, 'synonyms' AS kind, pr AS name FROM {source}
UNION SELECT {key}, 'synonyms', st FROM {source}
UNION SELECT {key}, 'romaji', pr || ' ' || y FROM {source}
UNION SELECT {key}, 'english', pr FROM {source} WHERE st <> 'F'
UNION SELECT {key}, 'native', st FROM {source}"""
_GENRES = """
SELECT DISTINCT {key}, unnest(string_split(pr, '-')) AS genre FROM {source} WHERE st <> 'F'"""

_ATTRIBUTES = f"""
CASE WHEN st = 'O' THEN 'ANIME' ELSE 'MANGA' END AS media_type, pr || ' ' || y AS title,
{_date('y', 'm', 'd + 3')} AS date_start,
CASE WHEN st = 'P' THEN make_date(1900, m, 1) ELSE make_date(y, m, 1) END AS date_end,
0 AS episodes, CAST(floor(price) AS INTEGER) AS duration, 0 AS chapters,
CAST(m AS INTEGER) AS volumes,
CASE WHEN pr = '5-LOW' THEN 'null' ELSE pr END AS format, 'S' || m AS source, st AS status"""

ORACLES["media_attributes"] = f"""
WITH {_MEDIA} SELECT seq, CAST(id AS INTEGER) AS ext_media_id, {_ATTRIBUTES} FROM valid"""

ORACLES["media_quarantine"] = f"""
WITH {_MEDIA}
SELECT 'media' AS stream, seq, true AS has_text,
       CASE WHEN price < 50000 THEN 'no media' ELSE 'missing section' END AS reason
FROM raw WHERE seq NOT IN (SELECT seq FROM valid)"""



def _unnested(template: str, columns: str) -> str:
    rows = template.format(key="seq AS doc", source="valid")
    return f"WITH {_MEDIA}, rows AS ({rows}) SELECT doc AS seq, {columns} FROM rows"


ORACLES["unnested_tags"] = _unnested(
    _TAGS, "CAST(ext_tag_id AS INTEGER) AS ext_tag_id, name, category")
ORACLES["unnested_genres"] = _unnested(_GENRES, "genre")
ORACLES["unnested_studios"] = _unnested(
    _STUDIOS, "CAST(ext_studio_id AS INTEGER) AS ext_studio_id, name, is_main")
ORACLES["unnested_staff"] = _unnested(
    _STAFF, "CAST(ext_staff_id AS INTEGER) AS ext_staff_id, first_name, last_name, full_name,"
    " native_name, role")
ORACLES["unnested_titles"] = _unnested(_TITLES, "kind, name")

ORACLES["media_reconcile"] = f"""
WITH {_MEDIA},
tag AS (
  SELECT ext_tag_id, arg_min(name || '|' || category, batch * 1000000000000 + seq) AS detail
  FROM ({_TAGS.format(key="id", source="valid")}) GROUP BY 1),
studio AS (
  SELECT ext_studio_id, arg_min(name, batch * 1000000000000 + seq) AS name
  FROM ({_STUDIOS.format(key="id", source="valid")}) GROUP BY 1),
staff AS (
  SELECT ext_staff_id, arg_max(
    first_name || '|' || last_name || '|' || full_name || '|' || native_name,
    batch * 1000000000000 + seq) AS detail
  FROM ({_STAFF.format(key="id", source="valid")}) GROUP BY 1),
relations AS (
  SELECT id, 'genre' AS relation, genre AS item, '' AS detail
  FROM ({_GENRES.format(key="id", source="latest")})
  UNION ALL
  SELECT id, 'tag', CAST(ext_tag_id AS VARCHAR), tag.detail
  FROM ({_TAGS.format(key="id", source="latest")}) JOIN tag USING (ext_tag_id)
  UNION ALL
  SELECT id, 'studio', CAST(ext_studio_id AS VARCHAR), studio.name || '|' || is_main
  FROM ({_STUDIOS.format(key="id", source="latest")}) l JOIN studio USING (ext_studio_id)
  UNION ALL
  SELECT id, 'staff', ext_staff_id || '|' || role, staff.detail
  FROM ({_STAFF.format(key="id", source="latest")}) JOIN staff USING (ext_staff_id)
  UNION ALL
  SELECT id, 'name', name, kind FROM ({_TITLES.format(key="id", source="latest")}))
SELECT CAST(id AS INTEGER) AS ext_media_id, relation, item, detail FROM relations"""

_EVENTS = f"""
raw AS (
  SELECT event_id AS seq, CAST(user_id AS INTEGER) AS ext_user_id, event_type,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
         CAST(ts AS DATE) AS date_start, CAST(trunc(value / 50 * 10) AS INTEGER) AS score,
         CASE WHEN event_type = 'view' THEN 'null' ELSE event_type END AS status,
         CAST(floor(value) AS INTEGER) AS whole,
         CASE WHEN ts < TIMESTAMP '{EVENT_CUT}' THEN 1 ELSE 2 END AS batch
  FROM events),
valid AS (SELECT *, {_date('2024', '1', 'k + 1')} AS date_end FROM raw WHERE event_type <> 'error'),
latest AS (
  SELECT * FROM valid
  QUALIFY row_number() OVER (PARTITION BY ext_user_id ORDER BY batch DESC, seq DESC) = 1)"""


def _entries(source: str) -> str:
    columns = "seq, ext_user_id, date_start, date_end, score, status"
    rows = [
        (0, "k", "whole", 0), (1, "k * 2", "2", 1), (2, "k", "3", 2), (3, "k", "5", 1),
        (4, f"k + {UNKNOWN_MEDIA}", "1", 0),
    ]
    return " UNION ALL ".join(
        f"SELECT {columns}, {pos} AS pos, {media} AS ext_media_id, {progress} AS progress,"
        f" {repeat} AS repeat FROM {source}"
        for pos, media, progress, repeat in rows)


ORACLES["list_entries_in_order"] = f"WITH {_EVENTS} {_entries('valid')}"


def _collapsed(source: str) -> str:
    return f"""
SELECT seq, ext_user_id, ext_media_id,
       arg_min(date_start, pos) AS date_start, arg_min(date_end, pos) AS date_end,
       arg_min(score, pos) AS score, arg_min(status, pos) AS status,
       CAST(sum(progress) AS INTEGER) AS progress, CAST(sum(repeat) AS INTEGER) AS rewatched
FROM ({_entries(source)}) GROUP BY 1, 2, 3"""


ORACLES["document_entries_collapsed"] = f"WITH {_EVENTS} {_collapsed('valid')}"

ORACLES["list_reconcile"] = f"""
WITH {_EVENTS}, entries AS ({_collapsed('latest')})
SELECT ext_user_id, ext_media_id, date_start, date_end, score, status, progress, rewatched,
       ext_media_id NOT IN (SELECT p_partkey FROM part) AS waits
FROM entries"""

ORACLES["waiting_media"] = f"""
WITH {_EVENTS}, entries AS ({_collapsed('latest')})
SELECT DISTINCT ext_media_id FROM entries
WHERE ext_media_id NOT IN (SELECT p_partkey FROM part)"""

ORACLES["list_quarantine"] = """
SELECT 'lists' AS stream, event_id AS seq, 'missing branch' AS reason
FROM events WHERE event_type = 'error'"""

ORACLES["list_collapse"] = """
WITH entries AS (
  SELECT o_custkey AS ext_user_id, l_partkey AS ext_media_id,
         CAST(o_orderdate AS DATE) AS date_start, CAST(l_shipdate AS DATE) AS date_end,
         CAST(trunc(l_discount * 100 * 10) AS INTEGER) AS score, l_returnflag AS status,
         l_linenumber AS progress, CAST(l_quantity AS INTEGER) AS repeat,
         row_number() OVER (PARTITION BY o_custkey, l_partkey ORDER BY
           l_linenumber % 2 = 0, l_orderkey, l_linenumber, CAST(l_shipdate AS DATE), l_discount,
           l_returnflag) AS n
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey)
SELECT ext_user_id, ext_media_id,
       max(date_start) FILTER (n = 1) AS date_start, max(date_end) FILTER (n = 1) AS date_end,
       max(score) FILTER (n = 1) AS score, max(status) FILTER (n = 1) AS status,
       CAST(sum(progress) AS INTEGER) AS progress, CAST(sum(repeat) AS INTEGER) AS rewatched
FROM entries GROUP BY 1, 2"""

ORACLES["latest_documents"] = """
SELECT user_id, event_id AS seq, event_type, props FROM events
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1"""

ORACLES["media_genres"] = """
SELECT DISTINCT l_partkey AS media_id, s_name AS genre
FROM lineitem JOIN supplier ON s_suppkey = l_suppkey"""

ORACLES["media_tags"] = """
SELECT DISTINCT l_partkey AS media_id, s_suppkey + 7 AS ext_tag_id, s_name AS name,
       n_name AS category
FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey"""

ORACLES["media_studios"] = """
SELECT l_partkey AS media_id, s_suppkey + 7 AS ext_studio_id, s_name AS name,
       bool_or(l_linenumber = 1) AS is_main
FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1, 2, 3"""

ORACLES["media_staff"] = """
SELECT o_orderkey AS media_id, c_custkey + 7 AS ext_staff_id, c_mktsegment AS first_name,
       c_name AS last_name, c_mktsegment || ' ' || c_name AS full_name, 'null' AS native_name,
       upper(o_orderpriority) AS role
FROM orders JOIN customer ON c_custkey = o_custkey"""

ORACLES["media_alternative_names"] = """
SELECT c_custkey AS media_id, n_name AS name_type, c_name AS name
FROM customer JOIN nation ON n_nationkey = c_nationkey"""

ORACLES["missing_media"] = """
SELECT DISTINCT l_orderkey AS ext_media_id FROM lineitem
WHERE l_orderkey NOT IN (SELECT p_partkey FROM part)"""

ORACLES["names_to_ids"] = """
SELECT o_orderkey, c_custkey + 100 AS viewer_id, c_custkey * 2 + 1 AS status_id
FROM orders JOIN customer ON c_custkey = o_custkey"""

ORACLES["first_seen_tags"] = """
SELECT user_id AS ext_tag_id, arg_min(event_type, event_id) AS name,
       arg_min(props, event_id) AS category
FROM events GROUP BY 1"""

ORACLES["last_seen_staff"] = """
SELECT user_id AS ext_tag_id, arg_max(event_type, event_id) AS name,
       arg_max(props, event_id) AS category
FROM events GROUP BY 1"""

ORACLES["new_names"] = """
SELECT 'format' AS kind, p_name AS name FROM part
WHERE p_name NOT IN (SELECT p_name FROM part WHERE p_size > 40)
UNION SELECT 'source', p_brand FROM part"""

ORACLES["new_viewer_keys"] = """
WITH new AS (
  SELECT DISTINCT o_custkey FROM orders WHERE o_custkey NOT IN (SELECT s_suppkey FROM supplier)),
stored AS (SELECT count(*) AS n FROM supplier)
SELECT count(*) AS n_viewers, count(*) AS n_keys, max(n) + 1 AS lowest,
       max(n) + count(*) AS highest, CAST(sum(o_custkey) AS BIGINT) AS ext_total
FROM new, stored"""

ORACLES["media_overwrite"] = """
SELECT c_custkey + 1000 AS media_id, coalesce(c_custkey, p_partkey) AS ext_media_id,
       CASE WHEN p_partkey IS NULL THEN 'red widget' ELSE p_name END AS title,
       CASE WHEN p_partkey IS NULL THEN c_nationkey * 2 ELSE p_size END AS episodes,
       p_partkey IS NOT NULL AND (c_custkey IS NULL OR p_name <> 'red widget'
                                  OR p_size <> c_nationkey * 2) AS changed
FROM customer FULL JOIN part ON p_partkey = c_custkey"""


def _diff(key: str, columns: dict[str, str], scope: str, payload: dict[str, str] = {}) -> str:
    """Stored and incoming lines compared on a key and further columns."""
    names = ", ".join(columns)
    select = f"{key}, " + ", ".join(f"{source} AS {name}" for name, source in columns.items())
    values = "".join(f", {source} AS {name}" for name, source in payload.items())
    key_name = key.split(" AS ")[1]
    kept = "".join(
        f", CASE WHEN n.{key_name} IS NOT NULL THEN n.{p} ELSE s.{p} END AS {p}" for p in payload)
    differs = " OR ".join(f"n.{p} IS DISTINCT FROM s.{p}" for p in payload) or "false"
    joined = " AND ".join(f"s.{c} = n.{c}" for c in [key_name, *columns])
    both = ", ".join(f"coalesce(s.{c}, n.{c}) AS {c}" for c in [key_name, *columns])
    group = "GROUP BY ALL"
    return f"""
scope AS ({scope}),
stored AS (SELECT {select}{values} FROM lineitem WHERE l_returnflag <> 'A' {group}),
incoming AS (
  SELECT * FROM (SELECT {select}{values} FROM lineitem WHERE l_returnflag <> 'R' {group})
  WHERE {key_name} IN (SELECT {key_name} FROM scope)),
diff AS (
  SELECT {both}{kept},
    CASE WHEN s.{key_name} IS NULL THEN 'insert'
         WHEN n.{key_name} IS NOT NULL THEN CASE WHEN {differs} THEN 'update' ELSE 'keep' END
         WHEN s.{key_name} IN (SELECT {key_name} FROM scope) THEN 'delete'
         ELSE 'outside' END AS action
  FROM stored s FULL JOIN incoming n ON {joined})"""


_PART_SCOPE = "SELECT p_partkey AS media_id FROM part WHERE p_type <> 'PROMO'"
_MEDIA_KEY = "l_partkey AS media_id"

ORACLES["genre_link_diff"] = (
    f"WITH {_diff(_MEDIA_KEY, {'genre_id': 'l_suppkey'}, _PART_SCOPE)} SELECT * FROM diff")
ORACLES["tag_links_after"] = (
    f"WITH {_diff(_MEDIA_KEY, {'tag_id': 'l_suppkey'}, _PART_SCOPE)}"
    " SELECT media_id, tag_id FROM diff WHERE action <> 'delete'")
ORACLES["staff_link_changes"] = (
    f"WITH {_diff(_MEDIA_KEY, {'staff_id': 'l_suppkey', 'role': 'l_linestatus'}, _PART_SCOPE)}"
    " SELECT * FROM diff WHERE action IN ('insert', 'delete')")
ORACLES["studio_link_diff"] = (
    "WITH " + _diff(_MEDIA_KEY, {"studio_id": "l_suppkey"}, _PART_SCOPE,
                    {"is_main": "bool_or(l_linestatus = 'O')"}) + " SELECT * FROM diff")
ORACLES["list_entry_diff"] = (
    "WITH " + _diff(
        "l_orderkey AS viewer_id", {"media_id": "l_partkey"},
        "SELECT o_orderkey AS viewer_id FROM orders WHERE o_orderstatus <> 'P'",
        {"progress": "CAST(sum(l_linenumber) AS INTEGER)", "status": "max(l_returnflag)"})
    + " SELECT * FROM diff")

ORACLES["name_rows_after"] = """
SELECT c_custkey AS media_id, c_mktsegment AS name,
       CAST(CASE WHEN c_mktsegment = 'BUILDING' OR c_acctbal > 5000 THEN 1 ELSE 2 END AS BIGINT)
         AS name_type_id,
       CASE WHEN c_mktsegment = 'BUILDING' OR c_acctbal > 5000 THEN c_custkey + 1 END
         AS media_name_id
FROM customer"""

ORACLES["equal_sets"] = "SELECT CAST(0 AS BIGINT) AS n_changes"

ORACLES["lists_refreshed"] = """
SELECT CAST(c_custkey AS INTEGER) AS ext_user_id, c_nationkey AS ext_media_id,
       DATE '2001-01-01' AS date_start, DATE '1900-02-01' AS date_end, 75 AS score,
       c_mktsegment AS status, 3 AS progress, 0 AS rewatched
FROM customer WHERE c_acctbal > 0 AND c_nationkey IN (SELECT p_partkey FROM part)"""

ORACLES["stored_recommendations"] = """
WITH recs AS (
  SELECT o_custkey, l_partkey, max(CAST(l_quantity AS INTEGER)) AS score
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2)
SELECT c_custkey + 1 AS viewer_id, c_custkey AS ext_user_id, p_partkey + 5 AS media_id,
       p_partkey AS ext_media_id, p_name AS title, score
FROM recs JOIN customer ON c_custkey = o_custkey JOIN part ON p_partkey = l_partkey
WHERE c_acctbal > 0"""

ORACLES["refresh_decisions"] = f"""
WITH {_PARAMS},
stored AS (
  SELECT o_custkey AS user_id, count(*) AS n FROM orders
  WHERE o_orderpriority = '1-URGENT' AND o_custkey IN (SELECT c_custkey FROM customer) GROUP BY 1)
SELECT event_id, user_id AS ext_user_id, coalesce(n, 0) AS n_stored,
       CASE WHEN NOT is_object THEN 'rejected'
            WHEN refresh OR coalesce(n, 0) = 0 OR n_other = 0 THEN 'recompute'
            ELSE 'stored' END AS decision
FROM flags LEFT JOIN stored USING (user_id)"""

ORACLES["users_by_name"] = """
SELECT c_name AS name, c_custkey AS ext_user_id, true AS known FROM customer
UNION ALL SELECT s_name, NULL, false FROM supplier"""

ORACLES["repeated_keys"] = """
SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem
GROUP BY 1, 2 HAVING count(*) > 1"""

ORACLES["orphaned_references"] = """
SELECT l_partkey AS value, count(*) AS n_rows, 'l_partkey' AS reference FROM lineitem
WHERE l_partkey NOT IN (SELECT p_partkey FROM part) GROUP BY 1
UNION ALL
SELECT l_orderkey, count(*), 'l_orderkey' FROM lineitem
WHERE l_orderkey NOT IN (SELECT p_partkey FROM part) GROUP BY 1
UNION ALL
SELECT doc_id, count(*), 'doc_id' FROM labels
WHERE doc_id NOT IN (SELECT c_custkey FROM customer) GROUP BY 1"""

ORACLES["missing_values"] = """
SELECT 'o_orderkey' AS column_name, count(*) FILTER (o_orderkey IS NULL) AS n_nulls FROM orders
UNION ALL SELECT 'o_custkey', count(*) FILTER (o_orderstatus = 'P') FROM orders
UNION ALL SELECT 'o_orderpriority', count(*) FILTER (o_totalprice <= 100000) FROM orders"""

ORACLES["overlong_values"] = """
SELECT 'text' AS column_name, count(*) FILTER (length(text) > 500) AS n_too_long,
       CAST(max(length(text)) AS INTEGER) AS longest FROM documents
UNION ALL
SELECT 'source', count(*) FILTER (length(source) > 10), CAST(max(length(source)) AS INTEGER)
FROM documents
UNION ALL
SELECT 'lang', count(*) FILTER (length(lang) > 50), CAST(max(length(lang)) AS INTEGER)
FROM documents"""

ORACLES["media_versions"] = """
SELECT CAST(p_partkey AS INTEGER) AS ext_media_id, p_name AS title,
       CAST(p_size + 100 AS INTEGER) AS episodes
FROM part"""

# the same documents by another way
ORACLES["media_stream"] = ORACLES["media_reconcile"]
ORACLES["list_stream"] = ORACLES["list_reconcile"]
ORACLES["list_replay"] = ORACLES["list_reconcile"]

_SCORES = """e AS (
  SELECT o_custkey AS u, l_partkey AS i, max(CAST(l_quantity AS INTEGER)) AS s
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)"""


def _half(of: str, by: str, known: str) -> str:
    return (f"(SELECT {of} AS id, sum(f * r) / (sum(f * f) + 2.0 * count(*)) AS f "
            f"FROM r JOIN {known} ON {by} = id GROUP BY 1)")


ORACLES["rank_one_factors"] = f"""
WITH {_SCORES}, r AS (SELECT u, i, s - (SELECT avg(s) FROM e) AS r FROM e),
v0 AS (SELECT DISTINCT i AS id, (i % 7 + 1) / 10.0::DOUBLE AS f FROM e),
u1 AS {_half("u", "i", "v0")}, v1 AS {_half("i", "u", "u1")},
u2 AS {_half("u", "i", "v1")}, v2 AS {_half("i", "u", "u2")}
SELECT 'user' AS side, id, round(f, 6) AS factor FROM u2
UNION ALL SELECT 'media', id, round(f, 6) FROM v2"""

ORACLES["best_unseen_media"] = f"""
WITH {_SCORES}
SELECT c_custkey AS user, p_partkey AS item,
       CAST((c_nationkey % 5 - 2) * (p_size % 7 - 3) + floor(c_acctbal / 1000) * (p_partkey % 11 - 5) AS DOUBLE) AS score,
       CAST(row_number() OVER w AS INTEGER) AS rank
FROM customer CROSS JOIN part
WHERE (c_custkey, p_partkey) NOT IN (SELECT (u, i) FROM e)
WINDOW w AS (PARTITION BY c_custkey ORDER BY
  (c_nationkey % 5 - 2) * (p_size % 7 - 3) + floor(c_acctbal / 1000) * (p_partkey % 11 - 5) DESC, p_partkey)
QUALIFY row_number() OVER w <= 5"""

ORACLES["recommendations_replaced"] = f"""
WITH {_SCORES}
SELECT u + 1 AS viewer_id, i + 5 AS media_id, CASE WHEN u % 3 = 0 THEN s + 100 ELSE s END AS score
FROM e WHERE u % 3 <> 0 OR u NOT IN (SELECT c_custkey FROM customer) OR (i + 5) % 2 = 0"""

_FILTERS = """given(m, r, key, name, day, reason) AS (VALUES
  (8, 0, 'genres', 'red', NULL, NULL), (8, 0, 'genres', 'widget', NULL, NULL), (8, 1, 'genres', 'small', NULL, NULL),
  (8, 2, 'genres', NULL, NULL, 'empty'), (8, 3, 'genres', NULL, NULL, 'null'), (8, 4, 'genres', NULL, NULL, 'no names'),
  (8, 5, 'genres', 'blue', NULL, NULL), (8, 6, 'genres', 'blue', NULL, NULL), (8, 7, 'genres', 'blue', NULL, NULL),
  (5, 0, 'format', 'SMALL', NULL, NULL), (5, 0, 'format', 'LARGE', NULL, NULL), (5, 1, 'format', 'ECONOMY', NULL, NULL),
  (5, 2, 'color', NULL, NULL, 'unknown'), (7, 0, 'startedAfter', NULL, DATE '2000-06-15', NULL),
  (7, 1, 'startedBefore', NULL, NULL, 'no date'), (7, 2, 'endedBefore', NULL, DATE '2002-01-01', NULL),
  (7, 2, 'startedAfter', NULL, DATE '2000-02-01', NULL), (7, 3, 'endedAfter', NULL, NULL, 'no date')
), typed AS (
  SELECT event_id AS request, key, name, day, reason FROM events JOIN given ON event_id % m = r
  WHERE event_id % 31 <> 0 AND event_id % 37 <> 0
  UNION ALL
  SELECT event_id, NULL, NULL, NULL, 'malformed' FROM events WHERE event_id % 31 = 0 OR event_id % 37 = 0
)"""

ORACLES["typed_parameters"] = f"WITH {_FILTERS} SELECT request, key, name, day, reason FROM typed"

ORACLES["filtered_recommendations"] = f"""
WITH {_FILTERS}, {_SCORES}, candidates AS (
  SELECT event_id AS request, i AS media_id, p_type, string_split(p_name, ' ') AS words,
         DATE '2000-01-01' + CAST(i % 600 AS INTEGER) AS date_start,
         DATE '2000-01-01' + CAST(i % 600 + p_size AS INTEGER) AS date_end
  FROM events JOIN e ON u = user_id JOIN part ON p_partkey = i
), wanted AS (
  SELECT request, bool_or(reason IS NOT NULL) AS bad,
         list(name) FILTER (WHERE key = 'genres' AND name IS NOT NULL) AS genres,
         list(name) FILTER (WHERE key = 'format' AND name IS NOT NULL) AS formats,
         max(day) FILTER (WHERE key = 'startedAfter') AS started_after,
         min(day) FILTER (WHERE key = 'endedBefore') AS ended_before
  FROM typed GROUP BY 1
)
SELECT request, media_id FROM candidates JOIN wanted USING (request)
WHERE NOT bad AND (genres IS NULL OR list_has_all(words, genres)) AND (formats IS NULL OR list_contains(formats, p_type))
  AND (started_after IS NULL OR date_start > started_after) AND (ended_before IS NULL OR date_end < ended_before)"""

ORACLES["orders_in_windows"] = """
WITH spans AS (
  SELECT event_id, DATE '1995-01-01' + CAST(event_id * 37 % 2400 AS INTEGER) AS low,
         CAST(CASE WHEN event_id % 11 = 0 THEN -1 WHEN event_id % 97 = 0 THEN 3650 ELSE event_id % 5 END AS INTEGER) AS days
  FROM events WHERE event_id % 101 <> 0)
SELECT event_id, count(*) AS n_orders, CAST(sum(o_orderkey) AS BIGINT) AS keys
FROM spans JOIN orders ON CAST(o_orderdate AS DATE) BETWEEN low AND low + days GROUP BY 1"""

ORACLES["walked_ticks"] = """
SELECT c_custkey AS seq, c_name AS value FROM customer WHERE c_acctbal >= 0"""

ORACLES["requests_answered"] = f"""
WITH {_PARAMS}, {_SCORES}, asked AS (
  SELECT event_id AS request, NULL AS name, CASE WHEN event_id % 50 <> 0 THEN user_id END AS ext_user_id,
         is_object, refresh, n_other FROM flags
  UNION ALL
  SELECT -1 - c_custkey, c_name, c_custkey, true, false, CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE 0 END FROM customer
  UNION ALL
  SELECT -1000000 - s_suppkey, s_name, NULL, true, false, 0 FROM supplier
), routes AS (
  SELECT request, ext_user_id,
    CASE WHEN NOT is_object THEN 'bad parameters' WHEN ext_user_id IS NOT NULL THEN NULL
         WHEN name IS NULL THEN 'no user' ELSE 'unknown name' END AS reason,
    refresh OR n_other = 0 OR ext_user_id NOT IN (SELECT u FROM e JOIN customer ON u = c_custkey WHERE s >= 45) AS anew
  FROM asked
), tagged AS (
  SELECT request, ext_user_id, reason,
    CASE WHEN reason IS NOT NULL THEN 'rejected' WHEN anew THEN 'recompute' ELSE 'stored' END AS route FROM routes
)
SELECT request, ext_user_id, route, reason, i AS media_id, s AS score
FROM tagged LEFT JOIN e ON u = ext_user_id AND (route = 'stored' AND s >= 45 OR route = 'recompute' AND s = 1)"""


def _unique(name: str, table: str, key: str) -> str:
    return (f"SELECT '{name}' AS constraint, true AS is_unique, count(*) AS n_keys, count(*) FILTER (WHERE n > 1) AS n_values, "
            f"CAST(coalesce(sum(n) FILTER (WHERE n > 1), 0) AS BIGINT) AS n_rows "
            f"FROM (SELECT {key}, count(*) AS n FROM {table} GROUP BY ALL)")


def _reference(name: str, child: str, parent: str) -> str:
    return (f"SELECT '{name}', false, count(*), count(*) FILTER (WHERE k NOT IN ({parent})), "
            f"CAST(coalesce(sum(n) FILTER (WHERE k NOT IN ({parent})), 0) AS BIGINT) "
            f"FROM (SELECT k, count(*) AS n FROM ({child}) WHERE k IS NOT NULL GROUP BY 1)")


ORACLES["declared_keys"] = "\nUNION ALL\n".join([
    _unique("region", "region", "r_regionkey"), _unique("nation", "nation", "n_nationkey"),
    _unique("customer", "customer", "c_custkey"), _unique("supplier", "supplier", "s_suppkey"),
    _unique("part", "part", "p_partkey"), _unique("orders", "orders", "o_orderkey"),
    _unique("events", "events", "event_id"), _unique("documents", "documents", "doc_id"),
    _unique("labels", "labels", "doc_id"), _unique("pages", "pages", "page_id"),
    _unique("embeddings", "embeddings", "vec_id"), _unique("lines", "lineitem", "l_orderkey, l_linenumber"),
    _unique("users of events", "events", "user_id"),
    _reference("nation.region", "SELECT n_regionkey AS k FROM nation", "SELECT r_regionkey FROM region"),
    _reference("customer.nation", "SELECT c_nationkey AS k FROM customer", "SELECT n_nationkey FROM nation"),
    _reference("order.customer", "SELECT o_custkey AS k FROM orders", "SELECT c_custkey FROM customer"),
    _reference("line.order", "SELECT l_orderkey AS k FROM lineitem", "SELECT o_orderkey FROM orders"),
    _reference("line.part", "SELECT l_partkey AS k FROM lineitem", "SELECT p_partkey FROM part WHERE p_partkey % 10 <> 0"),
    _reference("line.supplier and flag", "SELECT l_suppkey AS k FROM lineitem WHERE l_returnflag <> 'N'",
               "SELECT s_suppkey FROM supplier WHERE s_suppkey % 3 = 0"),
    _reference("label.document", "SELECT doc_id AS k FROM labels", "SELECT doc_id FROM documents"),
])
