"""The queries of the keyed-item engine and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from itemloom.functions import expressions as X
from itemloom.functions import keys as K
from itemloom.functions import sizes as S
from itemloom.operators import change_log, expiry, index, mutate, ranges, read, tables, transactions
from itemloom.sources.items import CONVERSATIONS, CUSTOMERS, DOCUMENTS, EVENTS, ORDERS, PARTS, Index, ItemTable, micros, seconds

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

#: 2024-01-20 00:00:00 UTC, the time that queries take for now.
NOW = 1705708800


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLE_SQL[name or f.__name__] = sql
        return f

    return register


def _events(spark: SparkSession, d: str) -> DataFrame:
    return EVENTS.read(spark, d)


def _shown(events: DataFrame) -> DataFrame:
    return events.select("event_id", "user_id", micros("ts").alias("ts_us"), "event_type", "value")


SHOWN = "SELECT event_id, user_id, epoch_us(ts) AS ts_us, event_type, value FROM events"

# Point reads


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey = 42")
def get_item(spark, d):
    return read.get_item(ORDERS.read(spark, d), ORDERS, {"o_orderkey": 42}).select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey = -1")
def get_item_absent(spark, d):
    return read.get_item(ORDERS.read(spark, d), ORDERS, {"o_orderkey": -1}).select("o_orderkey")


@query("SELECT conv_id, turn, role, length(text) AS n FROM conversations WHERE conv_id = 3 AND turn = 1")
def get_item_range_key(spark, d):
    return read.get_item(CONVERSATIONS.read(spark, d), CONVERSATIONS, {"conv_id": 3, "turn": 1}).select("conv_id", "turn", "role", F.length("text").cast("long").alias("n"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (SELECT c_custkey * 7 FROM customer WHERE c_custkey < 100)")
def batch_get(spark, d):
    wanted = CUSTOMERS.read(spark, d).where("c_custkey < 100").select((F.col("c_custkey") * 7).alias("o_orderkey"))
    return read.batch_get(ORDERS.read(spark, d), ORDERS, wanted).select("o_orderkey", "o_totalprice")


# Ordered queries


def _ranged(name: str, condition: Callable[[], Column | None], where: str, forward: bool = True, limit: int | None = None) -> None:
    order = "" if limit is None else f" ORDER BY turn {'' if forward else 'DESC'} LIMIT {limit}"

    def run(spark, d):
        found = read.query(CONVERSATIONS.read(spark, d), CONVERSATIONS, {"conv_id": 5}, condition(), forward, limit)
        return found.select("conv_id", "turn", "role")

    query(f"SELECT conv_id, turn, role FROM conversations WHERE conv_id = 5{where}{order}", name)(run)


_turn = lambda op, v: lambda: X.compare(F.col("turn"), op, v)
_ranged("query_all", lambda: None, "")
_ranged("query_eq", _turn("=", 2), " AND turn = 2")
_ranged("query_lt", _turn("<", 3), " AND turn < 3")
_ranged("query_le", _turn("<=", 3), " AND turn <= 3")
_ranged("query_gt", _turn(">", 1), " AND turn > 1")
_ranged("query_ge", _turn(">=", 1), " AND turn >= 1")
_ranged("query_between", lambda: X.between(F.col("turn"), 1, 3), " AND turn BETWEEN 1 AND 3")
_ranged("query_reverse_top", lambda: None, "", forward=False, limit=2)
_ranged("query_forward_top", _turn(">", 0), " AND turn > 0", limit=2)


@query("SELECT p_brand, p_name, p_partkey FROM part WHERE p_brand = 'Brand#2' AND p_name LIKE 'small%'")
def query_begins_with(spark, d):
    return read.query(PARTS.read(spark, d), PARTS, {"p_brand": "Brand#2"}, X.begins_with(F.col("p_name"), "small")).select("p_brand", "p_name", "p_partkey")


@query(f"WITH q AS ({SHOWN} WHERE user_id = 7 ORDER BY ts LIMIT 20) SELECT * FROM q")
def query_page_forward(spark, d):
    return _shown(read.query(_events(spark, d), EVENTS, {"user_id": 7}, limit=20))


@query("""WITH a AS (SELECT *, row_number() OVER (ORDER BY ts DESC) AS n FROM events WHERE user_id = 7)
SELECT event_id, user_id, epoch_us(ts) AS ts_us, event_type, value FROM a WHERE n BETWEEN 11 AND 20""")
def query_resume_reverse(spark, d):
    """The second page of ten, from a cursor at the first one's last key."""
    newest = read.query(_events(spark, d), EVENTS, {"user_id": 7}, forward=False, limit=10)
    cursor = newest.agg(F.min("ts").alias("ts")).first()
    return _shown(read.query(_events(spark, d), EVENTS, {"user_id": 7}, forward=False, limit=10, start={"ts": cursor.ts}))


@query("""WITH a AS (SELECT *, row_number() OVER (ORDER BY ts) AS n, count(*) OVER () AS total FROM events WHERE user_id = 7), p AS (SELECT * FROM a WHERE n <= 15)
SELECT event_id, least(total, 15) AS scanned, event_type = 'click' AS returned, CASE WHEN total > 15 THEN (SELECT max(epoch_us(ts)) FROM p) END AS cursor_us FROM p""")
def query_cursor(spark, d):
    """A page of fifteen evaluated events, where the next one begins, and which the filter returns."""
    page = read.paged(read.query(_events(spark, d), EVENTS, {"user_id": 7}), ["ts"], 15, X.compare(F.col("event_type"), "=", "click"))
    return page.select("event_id", "scanned", "returned", micros(F.col("cursor.ts")).alias("cursor_us"))


@query("""SELECT o_orderkey, o_custkey, o_totalprice FROM orders
WHERE o_custkey = 85 AND o_orderdate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '2000-12-31' AND o_orderstatus = 'F'""")
def query_filtered(spark, d):
    low, high = (F.lit(t).cast("timestamp_ntz") for t in ("1995-01-01 00:00:00", "2000-12-31 00:00:00"))
    found = read.query(ORDERS.read(spark, d), ORDERS, {"o_custkey": 85}, X.between(F.col("o_orderdate"), low, high), forward=False, index=ORDERS.broad["by_customer"])
    return found.where(X.compare(F.col("o_orderstatus"), "=", "F")).select("o_orderkey", "o_custkey", "o_totalprice")


# Conditions, filters and projections


def _sparse(spark, d) -> DataFrame:
    """Documents with the labels that some of them have."""
    labels = spark.read.parquet(f"{d}/labels.parquet")
    return DOCUMENTS.read(spark, d).select("doc_id", "lang", "source", "n_chars").join(labels, "doc_id", "left")


SPARSE = "(SELECT doc_id, lang, source, n_chars, quality, toxic FROM documents LEFT JOIN labels USING (doc_id))"


@query(f"SELECT doc_id, quality FROM {SPARSE} WHERE quality IS NOT NULL")
def filter_exists(spark, d):
    return _sparse(spark, d).where(X.call("attribute_exists", F.col("quality"))).select("doc_id", "quality")


@query(f"SELECT doc_id, lang FROM {SPARSE} WHERE quality IS NULL")
def filter_not_exists(spark, d):
    return _sparse(spark, d).where(X.call("attribute_not_exists", F.col("quality"))).select("doc_id", "lang")


@query(f"SELECT doc_id FROM {SPARSE} WHERE (coalesce(quality = 1, false) OR lang = 'fr') AND NOT coalesce(toxic = 1, false) AND NOT coalesce(n_chars > 2000, false)")
def filter_boolean(spark, d):
    good = X.any_of(X.compare(F.col("quality"), "=", 1), X.compare(F.col("lang"), "=", "fr"))
    return _sparse(spark, d).where(X.all_of(good, X.negate(X.compare(F.col("toxic"), "=", 1)), X.negate(X.compare(F.col("n_chars"), ">", 2000)))).select("doc_id")


@query(f"SELECT doc_id FROM {SPARSE} WHERE quality IS NULL OR quality <> 1")
def filter_not_equal(spark, d):
    return _sparse(spark, d).where(X.compare(F.col("quality"), "<>", 1)).select("doc_id")


@query(f"SELECT doc_id, lang FROM {SPARSE} WHERE lang IN ('de', 'es') AND starts_with(source, 'src1')")
def filter_in_begins_with(spark, d):
    return _sparse(spark, d).where(X.all_of(X.within(F.col("lang"), ["de", "es"]), X.begins_with(F.col("source"), "src1"))).select("doc_id", "lang")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) BETWEEN 10 AND 20")
def filter_nested(spark, d):
    k = X.attribute("k", "props", "bigint")
    return _events(spark, d).select("event_id", k.alias("k")).where(X.between(F.col("k"), 10, 20))


@query("SELECT event_id, user_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CAST(NULL AS VARCHAR) AS missing FROM events WHERE user_id = 9")
def project_nested(spark, d):
    found = read.query(_events(spark, d), EVENTS, {"user_id": 9})
    return found.select("event_id", "user_id", X.attribute("k", "props", "bigint").alias("k"), X.attribute("a.b[1]", "props").alias("missing"))


# Scans and pages


@query("SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 50")
def scan_page(spark, d):
    return read.scan(CUSTOMERS.read(spark, d), CUSTOMERS, limit=50).select("c_custkey", "c_name")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey > 49 ORDER BY c_custkey LIMIT 50")
def scan_resume(spark, d):
    return read.scan(CUSTOMERS.read(spark, d), CUSTOMERS, limit=50, start={"c_custkey": 49}).select("c_custkey", "c_name")


@query("SELECT n_nationkey, 25::BIGINT AS scanned, 24::BIGINT AS cursor_key FROM nation")
def scan_cursor(spark, d):
    """A scan's page that its maximum cuts has a cursor even at the table's end."""
    nations = ItemTable("nation", ("n_nationkey",))
    page = read.paged(read.scan(nations.read(spark, d), nations), ["n_nationkey"], 25, cut_is_end=False)
    return page.select("n_nationkey", "scanned", F.col("cursor.n_nationkey").cast("long").alias("cursor_key"))


SEGMENT = "(('0x' || substr(md5({0}), 1, 8))::BIGINT * {1} // 4294967296)::BIGINT"


@query(f"SELECT c_custkey, {SEGMENT.format('c_custkey::VARCHAR', 4)} AS segment FROM customer")
def parallel_scan_segments(spark, d):
    parts = [read.scan(CUSTOMERS.read(spark, d), CUSTOMERS, part=i, total=4).select("c_custkey", F.lit(i).cast("long").alias("segment")) for i in range(4)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("""WITH a AS (SELECT doc_id, lang, octet_length(encode(text)) AS n FROM documents ORDER BY doc_id LIMIT 100),
b AS (SELECT *, row_number() OVER (ORDER BY doc_id) AS place, sum(n) OVER (ORDER BY doc_id) AS page_bytes FROM a)
SELECT doc_id, place, page_bytes::BIGINT AS page_bytes, lang = 'en' AS returned FROM b WHERE place = 1 OR page_bytes <= 40000""")
def page_budget(spark, d):
    docs = read.scan(DOCUMENTS.read(spark, d), DOCUMENTS, limit=100)
    paged = read.page(docs, [F.col("doc_id")], F.octet_length("text"), 40_000, X.compare(F.col("lang"), "=", "en"))
    return paged.select("doc_id", F.col("place").cast("long").alias("place"), F.col("page_bytes").cast("long").alias("page_bytes"), "returned")


@query("""WITH RECURSIVE e AS (SELECT conv_id, turn, octet_length(encode(text)) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations),
r AS (SELECT conv_id, turn, n, i, n AS used, 0 AS page FROM e WHERE i = 1
UNION ALL SELECT e.conv_id, e.turn, e.n, e.i, CASE WHEN r.used + e.n > 3000 THEN e.n ELSE r.used + e.n END, CASE WHEN r.used + e.n > 3000 THEN r.page + 1 ELSE r.page END
FROM r JOIN e ON e.conv_id = r.conv_id AND e.i = r.i + 1)
SELECT conv_id, turn, n::BIGINT AS row_bytes, page::BIGINT AS page FROM r""")
def all_pages(spark, d):
    sized = CONVERSATIONS.read(spark, d).withColumn("n", F.octet_length("text"))
    return read.all_pages(sized, ["conv_id"], ["turn"], "n", 3000)


# Local indexes


def _with_score(spark, d) -> DataFrame:
    """Events of which only those above 100 have a score."""
    return _events(spark, d).withColumn("score", F.when(F.col("value") > 100, F.floor("value").cast("long")))


SCORED = "(SELECT *, CASE WHEN value > 100 THEN floor(value)::BIGINT END AS score FROM events)"
BY_SCORE = Index("by_score", ("user_id",), ("score",))


@query(f"SELECT event_id, user_id, score FROM {SCORED} WHERE user_id = 11 AND score IS NOT NULL ORDER BY score, ts LIMIT 15")
def local_index_query(spark, d):
    return read.query(_with_score(spark, d), EVENTS, {"user_id": 11}, limit=15, index=BY_SCORE).select("event_id", "user_id", "score")


@query(f"SELECT event_id, user_id, score FROM {SCORED} WHERE user_id = 11 AND score >= 150 ORDER BY score DESC, ts DESC LIMIT 5")
def local_index_reverse(spark, d):
    return read.query(_with_score(spark, d), EVENTS, {"user_id": 11}, X.compare(F.col("score"), ">=", 150), forward=False, limit=5, index=BY_SCORE).select("event_id", "user_id", "score")


@query(f"SELECT event_id, user_id, score FROM {SCORED} WHERE score IS NOT NULL")
def local_index_sparse(spark, d):
    return index.project(_with_score(spark, d), EVENTS, BY_SCORE).select("event_id", "user_id", "score")


@query(f"SELECT event_id, user_id, score FROM {SCORED} WHERE score IS NOT NULL ORDER BY user_id, ts LIMIT 40")
def local_index_scan_base_order(spark, d):
    return read.scan(index.project(_with_score(spark, d), EVENTS, BY_SCORE), EVENTS, limit=40).select("event_id", "user_id", "score")


# Global indexes


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders WHERE o_custkey = 17")
def global_index_all(spark, d):
    return read.query(ORDERS.read(spark, d), ORDERS, {"o_custkey": 17}, index=ORDERS.broad["by_customer"]).select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")


@query("SELECT o_custkey, epoch_us(o_orderdate) AS date_us, o_orderkey FROM orders WHERE o_custkey IS NOT NULL AND o_orderdate IS NOT NULL")
def global_index_keys_only(spark, d):
    keys = index.project(ORDERS.read(spark, d), ORDERS, ORDERS.broad["by_customer"], "KEYS_ONLY")
    return keys.select("o_custkey", micros("o_orderdate").alias("date_us"), "o_orderkey")


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders WHERE o_custkey IS NOT NULL AND o_orderdate IS NOT NULL")
def global_index_include(spark, d):
    by = Index("by_customer", ("o_custkey",), ("o_orderdate",), include=("o_totalprice",))
    return index.project(ORDERS.read(spark, d), ORDERS, by, "INCLUDE").drop("o_orderdate")


@query("SELECT o_orderkey, o_custkey FROM orders ORDER BY o_custkey, o_orderdate, o_orderkey LIMIT 60")
def global_index_scan(spark, d):
    rows = index.project(ORDERS.read(spark, d), ORDERS, ORDERS.broad["by_customer"])
    return rows.orderBy("o_custkey", "o_orderdate", "o_orderkey").limit(60).select("o_orderkey", "o_custkey")


LOGGED = "(SELECT *, CASE WHEN event_type = 'error' THEN NULL ELSE printf('%.2f', value) END AS image FROM events)"


def _log(spark, d) -> DataFrame:
    """Events as changes of a user's item, of which errors are removals."""
    return _events(spark, d).withColumn("image", F.when(F.col("event_type") != "error", F.format_string("%.2f", "value")))


@query(f"SELECT user_id, arg_max(event_id, event_id) AS event_id, arg_max_null(image, event_id) AS value, arg_max_null(image, event_id) IS NULL AS is_tombstone FROM {LOGGED} GROUP BY user_id")
def global_index_fold(spark, d):
    return index.fold(_log(spark, d).select("user_id", "event_id", F.col("image").alias("value")), ["user_id"], ["event_id"], "value")


@query(f"SELECT user_id FROM (SELECT user_id, arg_max_null(image, event_id) AS v FROM {LOGGED} GROUP BY user_id) WHERE v IS NULL")
def global_index_tombstones(spark, d):
    return global_index_fold(spark, d).where("is_tombstone").select("user_id")


@query(f"""WITH l AS (SELECT user_id, event_id, event_type, image, lag(event_type) OVER w AS old, lag(image) OVER w AS old_image, row_number() OVER w AS i FROM {LOGGED} WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
c AS (SELECT event_type, user_id, event_id, image FROM l WHERE i = 1 OR event_type <> old OR image IS DISTINCT FROM old_image UNION ALL SELECT old, user_id, event_id, NULL FROM l WHERE old IS NOT NULL AND old <> event_type)
SELECT event_type, user_id, arg_max(event_id, event_id) AS event_id, arg_max_null(image, event_id) AS image, arg_max_null(image, event_id) IS NULL AS is_tombstone FROM c GROUP BY event_type, user_id""")
def global_index_key_move(spark, d):
    return index.fold(index.moves(_log(spark, d), ["user_id"], "event_type", "event_id", "image"), ["event_type", "user_id"], ["event_id"], "image")


# Mutations


@query("SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def put_latest_wins(spark, d):
    return change_log.state(_events(spark, d), ["user_id"], "event_id").select("user_id", "event_id", "event_type", "value")


@query("SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1 AND event_type <> 'error'")
def delete_in_log(spark, d):
    return change_log.state(_events(spark, d), ["user_id"], "event_id", removed=F.col("event_type") == "error").select("user_id", "event_id")


@query("SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 'AUDITED' ELSE c_mktsegment END AS c_mktsegment, round(CASE WHEN c_custkey % 10 = 0 THEN c_acctbal + 5 ELSE c_acctbal END, 2) AS c_acctbal FROM customer")
def update_set_add(spark, d):
    customers = CUSTOMERS.read(spark, d)
    changed = mutate.update(customers, customers.where("c_custkey % 10 = 0"), ["c_custkey"], [X.Update("set", "c_mktsegment", "AUDITED"), X.Update("add", "c_acctbal", 5)])
    return changed.select("c_custkey", "c_mktsegment", F.round("c_acctbal", 2).alias("c_acctbal"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 10 <> 0 THEN c_mktsegment END AS c_mktsegment FROM customer")
def update_remove(spark, d):
    customers = CUSTOMERS.read(spark, d)
    return mutate.update(customers, customers.where("c_custkey % 10 = 0"), ["c_custkey"], [X.Update("remove", "c_mktsegment")]).select("c_custkey", "c_mktsegment")


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'c,d,x' ELSE 'a,b,c,d' END AS tags FROM customer UNION ALL SELECT -1, 'x'")
def update_sets(spark, d):
    """Sets: x is added to even keys and one new key, then a and b are deleted from these."""
    tagged = CUSTOMERS.read(spark, d).select("c_custkey", F.array(*(F.lit(c) for c in "abcd")).alias("tags"))
    even = tagged.where("c_custkey % 2 = 0").select("c_custkey").unionByName(spark.range(1).select(F.lit(-1).cast("long").alias("c_custkey")))
    added = mutate.update(tagged, even, ["c_custkey"], [X.Update("add", "tags", X.SetValue(["x"]))])
    return mutate.update(added, even, ["c_custkey"], [X.Update("delete", "tags", X.SetValue(["a", "b"]))]).select("c_custkey", F.array_join("tags", ",").alias("tags"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)")
def delete_items(spark, d):
    gone = CUSTOMERS.read(spark, d).where("c_nationkey = 3").select(F.col("c_custkey").alias("o_custkey"))
    return mutate.delete(ORDERS.read(spark, d).select("o_orderkey", "o_custkey"), gone, ["o_custkey"])


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey % 5 NOT IN (1, 2) UNION ALL SELECT c_custkey, 'new ' || c_custkey FROM customer WHERE c_custkey % 5 = 1 UNION ALL SELECT -7, 'new -7'")
def batch_write(spark, d):
    customers = CUSTOMERS.read(spark, d).select("c_custkey", "c_name")
    new = customers.where("c_custkey % 5 = 1").select("c_custkey").unionByName(spark.range(1).select(F.lit(-7).cast("long").alias("c_custkey")))
    puts = new.withColumn("c_name", F.concat(F.lit("new "), F.col("c_custkey").cast("string")))
    return mutate.batch_write(customers, puts, customers.where("c_custkey % 5 = 2"), ["c_custkey"])


@query("""SELECT k AS c_custkey, CASE WHEN c.c_custkey IS NULL THEN 'Applied' ELSE 'ConditionFailed' END AS outcome, c.c_name AS old_name
FROM (SELECT c_custkey * 2 AS k FROM customer) LEFT JOIN customer c ON c.c_custkey = k""")
def conditional_put(spark, d):
    customers = CUSTOMERS.read(spark, d)
    requests = customers.select((F.col("c_custkey") * 2).alias("c_custkey"))
    return mutate.outcomes(customers, requests, ["c_custkey"], X.call("attribute_not_exists", F.col("old_c_custkey"))).select("c_custkey", "outcome", F.col("old_c_name").alias("old_name"))


@query("""SELECT c_custkey, c_name FROM customer UNION ALL SELECT c_custkey * 2, 'new' FROM customer WHERE c_custkey * 2 NOT IN (SELECT c_custkey FROM customer)""")
def conditional_put_state(spark, d):
    """The items after puts of which those to taken keys are refused."""
    customers = CUSTOMERS.read(spark, d).select("c_custkey", "c_name")
    requests = customers.select((F.col("c_custkey") * 2).alias("c_custkey"), F.lit("new").alias("c_name"))
    return mutate.write(customers, requests, ["c_custkey"], X.call("attribute_not_exists", F.col("old_c_custkey")))[1]


CREDIT = "(SELECT c_custkey AS k, c_acctbal > 0 AS good FROM customer WHERE c_custkey % 2 = 0)"


@query(f"""SELECT c_custkey, CASE WHEN good THEN 'CHECKED' ELSE c_mktsegment END AS c_mktsegment, round(CASE WHEN good THEN c_acctbal + 1 ELSE c_acctbal END, 2) AS c_acctbal
FROM customer LEFT JOIN {CREDIT} ON k = c_custkey""")
def conditional_update(spark, d):
    """Customers with even keys and a positive balance are changed; a key without an item isn't put."""
    customers = CUSTOMERS.read(spark, d).select("c_custkey", "c_mktsegment", "c_acctbal")
    requests = customers.where("c_custkey % 2 = 0").select("c_custkey").unionByName(spark.range(1).select(F.lit(-4).cast("long").alias("c_custkey")))
    actions = [X.Update("set", "c_mktsegment", "CHECKED"), X.Update("add", "c_acctbal", 1)]
    changed = mutate.write(customers, requests, ["c_custkey"], X.compare(F.col("old_c_acctbal"), ">", 0), "update", actions)[1]
    return changed.select("c_custkey", "c_mktsegment", F.round("c_acctbal", 2).alias("c_acctbal"))


@query("""SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'Applied' ELSE 'ConditionFailed' END AS outcome, c_name AS old_name, CASE WHEN c_acctbal >= 0 THEN c_name END AS new_name
FROM customer WHERE c_nationkey < 10 UNION ALL SELECT -4, 'ConditionFailed', NULL, NULL""")
def conditional_delete(spark, d):
    """Outcomes with the images before and after."""
    customers = CUSTOMERS.read(spark, d)
    requests = customers.where("c_nationkey < 10").select("c_custkey").unionByName(spark.range(1).select(F.lit(-4).cast("long").alias("c_custkey")))
    shown = mutate.write(customers, requests, ["c_custkey"], X.compare(F.col("old_c_acctbal"), "<", 0), "delete")[0]
    return shown.select("c_custkey", "outcome", F.col("old.c_name").alias("old_name"), F.col("new.c_name").alias("new_name"))


# Change streams

RECORDS = f"""(SELECT user_id, event_id, CASE WHEN old IS NULL THEN 'INSERT' WHEN image IS NULL THEN 'REMOVE' ELSE 'MODIFY' END AS event_name, old AS old_image, image AS new_image,
octet_length(encode(coalesce(image, old)))::BIGINT AS size_bytes, lpad(event_id::VARCHAR, 20, '0') || '000' AS sequence_number
FROM (SELECT *, lag(image) OVER (PARTITION BY user_id ORDER BY event_id) AS old FROM {LOGGED}) WHERE old IS DISTINCT FROM image)"""


def _records(spark, d) -> DataFrame:
    return change_log.records(_log(spark, d), ["user_id"], "event_id", "image")


@query(f"SELECT * FROM {RECORDS}")
def stream_records(spark, d):
    return _records(spark, d)


def _view(kind: str, shown: str) -> None:
    query(f"SELECT user_id, event_id, event_name, {shown}size_bytes, sequence_number FROM {RECORDS}", f"stream_view_{kind.lower()}")(lambda spark, d: change_log.view(_records(spark, d), kind))


_view("KEYS_ONLY", "")
_view("NEW_IMAGE", "new_image, ")
_view("OLD_IMAGE", "old_image, ")


@query(f"SELECT event_id, user_id, event_name FROM {RECORDS} WHERE event_id > 500 ORDER BY event_id LIMIT 100")
def stream_page(spark, d):
    return change_log.read_page(_records(spark, d), "event_id", after=500, limit=100).select("event_id", "user_id", "event_name")


@query(f"""WITH v AS (SELECT event_id, user_id, size_bytes, row_number() OVER (ORDER BY event_id) AS n, sum(size_bytes) OVER (ORDER BY event_id)::BIGINT AS page_bytes FROM {RECORDS} WHERE event_id > 500 AND event_id > 900),
p AS (SELECT * FROM v WHERE n <= 200 AND page_bytes <= 400)
SELECT event_id, user_id, page_bytes, (SELECT max(event_id) FROM p) AS last_sequence, (SELECT count(*) FROM p) = (SELECT count(*) FROM v) AS exhausted FROM p""")
def stream_get_records(spark, d):
    """A page that is cut by its bytes; event ids stand for the seconds of creation."""
    page = change_log.get_records(_records(spark, d), "event_id", 500, 200, F.col("event_id"), 86400 + 900, F.col("size_bytes"), budget=400)
    return page.select("event_id", "user_id", F.col("page_bytes").cast("long").alias("page_bytes"), "last_sequence", "exhausted")


@query(f"SELECT {SEGMENT.format('user_id::VARCHAR', 8)} AS shard, max(event_id) AS latest FROM {RECORDS} GROUP BY 1")
def stream_tail(spark, d):
    return change_log.tail(_records(spark, d).withColumn("shard", K.segment(F.col("user_id"), 8)), ["shard"], "event_id")


@query(f"SELECT event_id FROM events WHERE floor(epoch_us(ts) / 1000000) > {NOW - 86400}")
def stream_retention(spark, d):
    return change_log.retained(_events(spark, d), seconds("ts"), NOW).select("event_id")


@query(f"SELECT count(*) AS n FROM events WHERE floor(epoch_us(ts) / 1000000) <= {NOW - 86400}")
def stream_prune_count(spark, d):
    return change_log.prunable(_events(spark, d), seconds("ts"), NOW).agg(F.count("*").alias("n"))


# Time to live

TTL = "(SELECT *, CASE WHEN event_type = 'view' THEN -1 WHEN event_type = 'click' THEN value ELSE floor(epoch_us(ts) / 1000000) + 3600 END AS ttl FROM events)"
EXPIRED = f"(ttl > 0 AND ttl = floor(ttl) AND ttl <= {NOW})"


def _ttl(spark, d) -> DataFrame:
    """Events that live for an hour; views' and most clicks' attribute isn't a time."""
    return _events(spark, d).withColumn("ttl", F.when(F.col("event_type") == "view", F.lit(-1.0)).when(F.col("event_type") == "click", F.col("value")).otherwise(seconds("ts") + 3600.0))


@query(f"SELECT event_id, part, ttl::BIGINT AS ttl FROM (SELECT *, row_number() OVER (PARTITION BY part ORDER BY ttl, user_id, ts) AS n FROM (SELECT *, {SEGMENT.format('user_id::VARCHAR', 4)} AS part FROM {TTL}) WHERE {EXPIRED} AND event_id % 3 <> 0) WHERE n <= 2")
def ttl_candidates(spark, d):
    items = _ttl(spark, d).withColumn("part", K.segment(F.col("user_id"), 4))
    locked = items.where("event_id % 3 = 0").select("user_id", "ts")
    return expiry.candidates(items, "ttl", NOW, ["user_id", "ts"], ["part"], locked).select("event_id", "part", F.col("ttl").cast("long").alias("ttl"))


@query(f"SELECT event_id FROM {TTL} WHERE NOT {EXPIRED}")
def ttl_swept_state(spark, d):
    return expiry.sweep(_ttl(spark, d), "ttl", NOW).select("event_id")


@query(f"SELECT user_id, event_id, 'REMOVE' AS event_name, 'dynamodb.amazonaws.com' AS principal FROM {TTL} WHERE {EXPIRED}")
def ttl_stream_removes(spark, d):
    return expiry.removals(_ttl(spark, d), "ttl", NOW, ["user_id", "event_id"])


# Transactions

TXN = "(SELECT o_orderkey, o_orderkey // 4 AS txn_id, o_orderkey % 4 AS pos, o_totalprice < 450000 AS good FROM orders)"


def _operations(spark, d) -> DataFrame:
    return ORDERS.read(spark, d).select("o_orderkey", F.floor(F.col("o_orderkey") / 4).cast("long").alias("txn_id"), (F.col("o_orderkey") % 4).alias("pos"), "o_totalprice")


@query(f"SELECT o_orderkey, txn_id, CASE WHEN bool_and(good) OVER w THEN 'COMMIT' ELSE 'ABORT' END AS decision, coalesce(min(CASE WHEN NOT good THEN pos END) OVER w, -1) AS first_failed FROM {TXN} WINDOW w AS (PARTITION BY txn_id)")
def txn_all_or_nothing(spark, d):
    return transactions.decide(_operations(spark, d), "txn_id", F.col("o_totalprice") < 450000, "pos").select("o_orderkey", "txn_id", "decision", F.coalesce("first_failed", F.lit(-1)).alias("first_failed"))


@query("SELECT i::BIGINT AS pos, i * 37 AS c_custkey, c.c_custkey IS NOT NULL AS found, c_name FROM range(100) t(i) LEFT JOIN customer c ON c.c_custkey = i * 37")
def txn_get(spark, d):
    operations = spark.range(100).select(F.col("id").alias("pos"), (F.col("id") * 37).alias("c_custkey"))
    return transactions.transact_get(operations, CUSTOMERS.read(spark, d), ["c_custkey"], "pos").select("pos", "c_custkey", "found", "c_name")


@query("SELECT o_orderkey, bool_and(c.c_acctbal > 0) OVER (PARTITION BY o_orderkey // 4) AS applied FROM orders LEFT JOIN customer c ON c_custkey = o_custkey")
def txn_condition_check(spark, d):
    """An order is put only if all customers of its transaction have credit."""
    checked = ORDERS.read(spark, d).join(CUSTOMERS.read(spark, d), F.col("o_custkey") == F.col("c_custkey"), "left")
    decided = transactions.decide(checked.withColumns({"txn_id": F.floor(F.col("o_orderkey") / 4), "pos": F.col("o_orderkey") % 4}), "txn_id", X.compare(F.col("c_acctbal"), ">", 0.0), "pos")
    return decided.select("o_orderkey", (F.col("decision") == "COMMIT").alias("applied"))


def _mixed_writes(spark, d) -> tuple[DataFrame, DataFrame]:
    """Per transaction a put, an update, a delete and a check, all on their conditions."""
    customers = CUSTOMERS.read(spark, d)
    kinds = F.element_at(F.array(*(F.lit(k) for k in ("PUT", "UPDATE", "DELETE", "CHECK"))), (F.col("c_custkey") % 4 + 1).cast("int"))
    operations = customers.select((F.floor(F.col("c_custkey") / 4)).alias("txn"), (F.col("c_custkey") % 4).alias("pos"), kinds.alias("kind"), "c_custkey")
    operations = operations.withColumns({"c_name": F.when(F.col("kind") == "PUT", "put"), "c_mktsegment": F.when(F.col("kind") == "UPDATE", "updated")})
    items = customers.select("c_custkey", "c_name", "c_mktsegment", "c_acctbal")
    return transactions.write(items, operations, ["c_custkey"], "txn", "pos", "kind", X.compare(F.col("old_c_acctbal"), ">", -500))


MIXED = "(SELECT *, c_custkey % 4 AS pos, c_acctbal > -500 AS good, bool_and(c_acctbal > -500) OVER (PARTITION BY c_custkey // 4) AS done FROM customer)"


@query(f"SELECT c_custkey // 4 AS txn, pos, CASE WHEN done THEN 'COMMIT' ELSE 'ABORT' END AS decision, CASE WHEN NOT good THEN 'ConditionFailed' END AS failure, c_name AS old_name FROM {MIXED}")
def transact_write(spark, d):
    return _mixed_writes(spark, d)[0].select("txn", "pos", "decision", "failure", F.col("old.c_name").alias("old_name"))


@query(f"""SELECT c_custkey, CASE WHEN done AND pos = 0 THEN 'put' ELSE c_name END AS c_name, CASE WHEN done AND pos = 0 THEN NULL WHEN done AND pos = 1 THEN 'updated' ELSE c_mktsegment END AS c_mktsegment,
CASE WHEN done AND pos = 0 THEN NULL ELSE c_acctbal END AS c_acctbal FROM {MIXED} WHERE NOT (done AND pos = 2)""")
def transact_write_state(spark, d):
    return _mixed_writes(spark, d)[1]


@query("""WITH RECURSIVE l AS MATERIALIZED (SELECT event_id, user_id AS token, event_type, floor(epoch_us(ts) / 1000000)::BIGINT AS s, row_number() OVER (PARTITION BY user_id ORDER BY floor(epoch_us(ts) / 1000000), event_id) AS i FROM events),
r AS (SELECT event_id, token, i, s AS a, event_type AS p, 'Applied' AS outcome FROM l WHERE i = 1
UNION ALL SELECT l.event_id, l.token, l.i, CASE WHEN s - a >= 600 THEN s ELSE a END, CASE WHEN s - a >= 600 THEN event_type ELSE p END, CASE WHEN s - a >= 600 THEN 'Applied' WHEN event_type = p THEN 'Replayed' ELSE 'Mismatch' END
FROM r JOIN l ON l.token = r.token AND l.i = r.i + 1)
SELECT event_id, outcome FROM r""")
def txn_token(spark, d):
    """All requests, each life of a token judged by its own first request."""
    requests = _events(spark, d).select("event_id", "user_id", "event_type", seconds("ts").alias("at"))
    return transactions.token_lives(requests, "user_id", "at", "event_type", "event_id").select("event_id", "outcome")


@query("""WITH RECURSIVE l AS MATERIALIZED (SELECT user_id, event_id, floor(value)::BIGINT AS amount, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
r AS (SELECT user_id, event_id, i, CASE WHEN event_type = 'purchase' AND amount > 0 THEN 0 WHEN event_type = 'purchase' THEN -amount ELSE amount END AS balance, event_type <> 'purchase' OR amount <= 0 AS applied FROM l WHERE i = 1
UNION ALL SELECT l.user_id, l.event_id, l.i, CASE WHEN event_type <> 'purchase' THEN balance + amount WHEN amount <= balance THEN balance - amount ELSE balance END, event_type <> 'purchase' OR amount <= balance
FROM r JOIN l ON l.user_id = r.user_id AND l.i = r.i + 1)
SELECT user_id, event_id, applied, balance FROM r""")
def txn_serial(spark, d):
    """Purchases are applied only if what earlier operations left covers them."""

    def step(balance, row):
        spends, balance = row["event_type"] == "purchase", balance or 0
        applied = not spends or row["amount"] <= balance
        balance += (-row["amount"] if spends else row["amount"]) if applied else 0
        return balance, (applied, balance)

    operations = _events(spark, d).select("user_id", "event_id", "event_type", F.floor("value").cast("long").alias("amount"))
    added = pa.schema([("applied", pa.bool_()), ("balance", pa.int64())])
    return transactions.fold(operations, "user_id", ["event_id"], step, added).select("user_id", "event_id", "applied", "balance")


# Statistics, ranges and directories


@query("""WITH s AS (SELECT *, 7 + octet_length(encode(c_name)) - 1 + 12 + octet_length(encode(c_mktsegment)) AS b FROM customer)
SELECT 'table' AS name, count(*) AS item_count, sum(b)::BIGINT AS item_bytes FROM s
UNION ALL SELECT 'by_credit', count(*), coalesce(sum(b), 0)::BIGINT FROM s WHERE c_acctbal > 5000
UNION ALL SELECT 'by_nation_keys', count(*), coalesce(sum(6 + octet_length(encode(c_name))), 0)::BIGINT FROM s WHERE c_nationkey < 10""")
def table_statistics(spark, d):
    customers = CUSTOMERS.read(spark, d)
    whole = S.item_bytes(c_name=S.string_bytes(F.col("c_name")), c_mktsegment=S.string_bytes(F.col("c_mktsegment")))
    keys = S.item_bytes(c_name=S.string_bytes(F.col("c_name")))
    return ranges.statistics(customers, whole, {"by_credit": (F.col("c_acctbal") > 5000, whole), "by_nation_keys": (F.col("c_nationkey") < 10, keys)})


@query("SELECT o_custkey AS split_key, n AS key_count FROM (SELECT o_custkey, row_number() OVER (ORDER BY o_custkey) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT o_custkey FROM orders)) WHERE i = n // 2 AND n >= 2")
def split_point(spark, d):
    return ranges.split_point(ORDERS.read(spark, d), "o_custkey")


def _directory(spark) -> DataFrame:
    return ranges.directory(spark.createDataFrame([(200,), (500,), (900,)], "fence long"), "fence")


PARTS_OF = "(VALUES (1, NULL, 200), (2, 200, 500), (3, 500, 900), (4, 900, NULL)) r(part, lower, upper)"
OWNED = "(lower IS NULL OR {0} >= lower) AND (upper IS NULL OR {0} < upper)"


@query(f"SELECT o_orderkey, part FROM orders JOIN {PARTS_OF} ON {OWNED.format('o_custkey')}")
def range_route(spark, d):
    return ranges.route(ORDERS.read(spark, d), "o_custkey", _directory(spark)).select("o_orderkey", "part")


@query(f"SELECT part, count(*) AS items, sum(octet_length(encode(o_orderpriority)))::BIGINT AS bytes FROM orders JOIN {PARTS_OF} ON {OWNED.format('o_custkey')} GROUP BY part")
def range_usage(spark, d):
    return ranges.route(ORDERS.read(spark, d), "o_custkey", _directory(spark)).groupBy("part").agg(F.count("*").alias("items"), F.sum(F.octet_length("o_orderpriority")).alias("bytes"))


@query("""SELECT n_nationkey, place, page_bytes FROM (SELECT n_nationkey, row_number() OVER (ORDER BY n_nationkey) AS place, (sum(octet_length(encode(n_name))) OVER (ORDER BY n_nationkey))::BIGINT AS page_bytes FROM nation)
WHERE place = 1 OR page_bytes <= 100""")
def directory_page(spark, d):
    nations = spark.read.parquet(f"{d}/nation.parquet")
    return read.page(nations, [F.col("n_nationkey")], F.octet_length("n_name"), 100).select("n_nationkey", F.col("place").cast("long").alias("place"), F.col("page_bytes").cast("long").alias("page_bytes"))


# Keys


@query("SELECT c_custkey, hex(encode(c_name)) AS raw, '10' || hex(encode(c_name)) || '0000' AS encoded FROM customer")
def key_encode_string(spark, d):
    return CUSTOMERS.read(spark, d).select("c_custkey", F.hex(F.encode("c_name", "UTF-8")).alias("raw"), F.hex(K.string_key(F.col("c_name"))).alias("encoded"))


@query("SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) AS place FROM customer")
def key_encode_number_order(spark, d):
    """The bytes of encoded numbers sort like the numbers, within each nation."""
    encoded = CUSTOMERS.read(spark, d).select("c_nationkey", "c_custkey", K.number_key(F.col("c_acctbal").cast("decimal(20,2)").cast("string")).alias("k"))
    return encoded.select("c_nationkey", "c_custkey", F.row_number().over(Window.partitionBy("c_nationkey").orderBy("k", "c_custkey")).cast("long").alias("place"))


# Tables, tags and streams


def _tables(spark, d) -> DataFrame:
    """Parts as table names."""
    return PARTS.read(spark, d).select(F.concat_ws("-", F.regexp_replace("p_name", " ", "_"), F.col("p_partkey").cast("string")).alias("table_name"), F.col("p_partkey").alias("table_id"))


NAMES = "(SELECT replace(p_name, ' ', '_') || '-' || p_partkey AS table_name, p_partkey AS table_id FROM part)"


@query(f"SELECT table_name, (SELECT count(*) FROM {NAMES} WHERE table_name > 'blue') > 10 AS has_more FROM {NAMES} WHERE table_name > 'blue' ORDER BY table_name LIMIT 10")
def list_tables(spark, d):
    return tables.list_page(_tables(spark, d), ["table_name"], ("blue",), 10).select("table_name", "has_more")


@query(f"SELECT table_id, CASE WHEN table_id % 7 = 0 THEN 'DELETING' ELSE 'ACTIVE' END AS status FROM {NAMES}")
def table_lifecycle(spark, d):
    found = _tables(spark, d)
    return tables.lifecycle(found, found.where("table_id % 7 = 0")).select("table_id", "status")


@query(f"SELECT table_id FROM {NAMES} WHERE table_id % 7 <> 0")
def live_tables(spark, d):
    found = _tables(spark, d)
    return tables.live(found, found.where("table_id % 7 = 0")).select("table_id")


@query("SELECT user_id AS arn, event_type AS tag, v AS value FROM (SELECT user_id, event_type, arg_max_null(CASE WHEN value < 40 THEN NULL ELSE printf('%.2f', value) END, event_id) AS v FROM events GROUP BY 1, 2) WHERE v IS NOT NULL")
def tags_upsert(spark, d):
    changes = _events(spark, d).select(F.col("user_id").alias("arn"), F.col("event_type").alias("tag"), F.when(F.col("value") >= 40, F.format_string("%.2f", "value")).alias("value"), F.col("event_id").alias("seq"))
    return tables.current_tags(changes)


@query("""WITH RECURSIVE l AS MATERIALIZED (SELECT event_id, user_id, floor(epoch_us(ts) / 1000000)::BIGINT AS s, CASE WHEN event_id % 3 = 0 THEN 'STANDARD' ELSE 'INFREQUENT' END AS class FROM events WHERE event_type = 'signup'),
n AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY s, event_id) AS i FROM l),
r AS (SELECT event_id, user_id, i, class, CASE WHEN class = 'STANDARD' THEN []::BIGINT[] ELSE [s] END AS accepted, true AS allowed FROM n WHERE i = 1
UNION ALL SELECT n.event_id, n.user_id, n.i, CASE WHEN len(list_filter(accepted, lambda t: t > s - 2592000)) >= 2 THEN r.class ELSE n.class END,
CASE WHEN n.class = r.class THEN accepted WHEN len(list_filter(accepted, lambda t: t > s - 2592000)) >= 2 THEN list_filter(accepted, lambda t: t > s - 2592000) ELSE list_append(list_filter(accepted, lambda t: t > s - 2592000), s) END,
n.class = r.class OR len(list_filter(accepted, lambda t: t > s - 2592000)) < 2
FROM r JOIN n ON n.user_id = r.user_id AND n.i = r.i + 1)
SELECT event_id, allowed FROM r""")
def table_class_limit(spark, d):
    changes = _events(spark, d).where("event_type = 'signup'").select("event_id", F.col("user_id").alias("table_id"), seconds("ts").alias("at"), F.when(F.col("event_id") % 3 == 0, "STANDARD").otherwise("INFREQUENT").alias("class"))
    return tables.class_changes(changes, "event_id").select("event_id", "allowed")


@query("SELECT user_id AS table_id, max(event_id) AS sampled_at, arg_max(value, event_id) AS item_count FROM events GROUP BY user_id")
def statistics_newest(spark, d):
    samples = _events(spark, d).select(F.col("user_id").alias("table_id"), F.col("event_id").alias("sampled_at"), F.col("value").alias("item_count"))
    return tables.newest_statistics(samples)


@query("SELECT user_id, min(epoch_us(ts)) AS label, count(*) AS records FROM events GROUP BY user_id HAVING min(epoch_us(ts)) > 0 ORDER BY user_id LIMIT 20")
def list_streams(spark, d):
    streams = _events(spark, d).groupBy("user_id").agg(F.min(micros("ts")).alias("label"), F.count("*").alias("records"))
    return tables.list_page(streams, ["user_id", "label"], None, 20).select("user_id", "label", "records")
