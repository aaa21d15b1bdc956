import pytest
from pyspark.sql import functions as F

from itemloom.functions import expressions as X
from itemloom.functions import sizes as S
from itemloom.operators import change_log, expiry, index, mutate, ranges, read, tables, transactions
from itemloom.plans import catalog
from itemloom.sources.items import Index, ItemTable

HOT = ItemTable("hot", ("pk",), ("sk",))


@pytest.fixture(scope="module")
def hot(spark):
    return spark.createDataFrame([("hot", i, "x" * 70_000) for i in range(30)], "pk string, sk int, payload string")


def test_pages_of_a_query_in_both_directions(hot):
    for forward in (True, False):
        seen, start = [], None
        while True:
            page = read.query(hot, HOT, {"pk": "hot"}, X.between(F.col("sk"), 7, 24), forward, 4, start).select("sk").collect()
            if not page:
                break
            seen += [r.sk for r in page]
            start = {"sk": seen[-1]}
        assert seen == sorted(range(7, 25), reverse=not forward)


def test_budget_keeps_the_first_row_and_counts_before_the_filter(hot):
    rows = read.page(hot, [F.col("sk")], F.octet_length("payload"), 1_000_000, F.lit(False)).select("sk", "returned").collect()
    assert len(rows) == 14 and not any(r.returned for r in rows)
    assert len(read.page(hot, [F.col("sk")], F.octet_length("payload"), 10).collect()) == 1


def test_all_pages(hot):
    sized = hot.withColumn("n", F.octet_length("payload"))
    pages = read.all_pages(sized, ["pk"], ["sk"], "n", 1_000_000).groupBy("page").count().orderBy("page").collect()
    assert [r["count"] for r in pages] == [14, 14, 2]


def test_keys_must_be_complete(hot):
    with pytest.raises(ValueError):
        read.get_item(hot, HOT, {"pk": "hot"})
    with pytest.raises(ValueError):
        read.query(hot, HOT, {})
    with pytest.raises(ValueError):
        X.between(F.col("sk"), 3, 1)
    with pytest.raises(ValueError):
        X.call("contains", F.col("sk"), "a")


def test_local_index_is_sparse_and_ordered(spark):
    items = spark.createDataFrame([("same", -2, 10), ("same", 2, 2), ("same", 10, 2), ("same", 20, None)], "pk string, sk int, score int")
    by = Index("by_score", ("pk",), ("score",))
    assert [r.sk for r in read.query(items, HOT, {"pk": "same"}, index=by).collect()] == [2, 10, -2]
    assert [r.sk for r in read.query(items, HOT, {"pk": "same"}, forward=False, index=by).collect()] == [-2, 10, 2]


def test_global_index_forms_and_fold(spark):
    items = spark.createDataFrame([("a", "old", 2, "p"), ("b", "old", 2, "q"), ("c", "old", 10, "r"), ("s", None, 1, "t")], "id string, bucket string, score int, payload string")
    table, by = ItemTable("t", ("id",)), Index("by", ("bucket",), ("score",), include=("payload",))
    assert [r.id for r in read.query(items, table, {"bucket": "old"}, index=by).collect()] == ["a", "b", "c"]
    assert index.project(items, table, by, "KEYS_ONLY").columns == ["bucket", "score", "id"]
    assert index.project(items, table, by, "INCLUDE").columns == ["bucket", "score", "id", "payload"]
    log = spark.createDataFrame([("k", 2, None), ("k", 1, "late"), ("m", 1, "x")], "k string, v int, image string")
    assert {(r.k, r.image, r.is_tombstone) for r in index.fold(log, ["k"], ["v"], "image").collect()} == {("k", None, True), ("m", "x", False)}


def test_updates(spark):
    items = spark.createDataFrame([("a", 1, ["x"]), ("b", None, None)], "id string, n int, tags array<string>")
    target = spark.createDataFrame([("a",), ("new",)], "id string")
    done = {r.id: (r.n, r.tags) for r in mutate.update(items, target, ["id"], [X.Update("add", "n", 5), X.Update("delete", "tags", X.SetValue(["x"]))]).collect()}
    assert done == {"a": (6, None), "b": (None, None), "new": (5, None)}
    with pytest.raises(ValueError):
        mutate.update(items, target, ["id"], [X.Update("set", "id", "z")])


def test_puts_and_conditions(spark):
    items = spark.createDataFrame([("a", 1)], "id string, n int")
    requests = spark.createDataFrame([("a",), ("b",)], "id string")
    found = mutate.outcomes(items, requests, ["id"], X.not_exists(F.col("old_id")))
    assert {r.id: r.outcome for r in found.collect()} == {"a": "ConditionFailed", "b": "Applied"}


def test_records_leave_out_what_changes_nothing(spark):
    log = spark.createDataFrame([("k", 1, "a"), ("k", 2, "a"), ("k", 3, "b"), ("k", 4, None), ("k", 5, None)], "k string, v int, image string")
    made = change_log.records(log, ["k"], "v", "image").orderBy("v").collect()
    assert [(r.v, r.event_name) for r in made] == [(1, "INSERT"), (3, "MODIFY"), (4, "REMOVE")]
    assert made[0].sequence_number == "0" * 19 + "1000"
    with pytest.raises(ValueError):
        change_log.read_page(log, "v", 0, 1001)


def test_expiry_needs_whole_positive_seconds(spark):
    items = spark.createDataFrame([(1, 5.0), (2, 5.5), (3, 0.0), (4, -1.0), (5, None), (6, 100.0)], "id int, ttl double")
    assert [r.id for r in expiry.removals(items, "ttl", 50, ["id"]).collect()] == [1]
    assert sorted(r.id for r in expiry.sweep(items, "ttl", 50).collect()) == [2, 3, 4, 5, 6]


def test_transactions(spark):
    operations = spark.createDataFrame([(1, 0, True), (1, 1, False), (2, 0, True), (3, 0, None)], "txn int, pos int, ok boolean")
    found = transactions.decide(operations, "txn", F.col("ok"), "pos").collect()
    assert {(r.txn, r.decision, r.first_failed) for r in found} == {(1, "ABORT", 1), (2, "COMMIT", None), (3, "ABORT", 0)}
    many = spark.range(101).select(F.lit(1).alias("txn"), "id", F.lit(True).alias("ok"))
    assert {r.decision for r in transactions.decide(many, "txn", F.col("ok"), "id").collect()} == {"ABORT"}


def test_each_life_of_a_token_has_its_first_request(spark):
    rows = [(0, "t", 0, "x"), (1, "t", 700, "x"), (2, "t", 750, "x"), (3, "t", 1299, "y"), (4, "t", 1300, "y"), (5, "u", 5, "x"), (6, "u", 5, "x"), (7, "u", 5, "y"), (8, None, 1, "x"), (9, None, 2, "x")]
    requests = spark.createDataFrame(rows, "id long, token string, at long, print string").repartition(3)
    found = {r.id: r.outcome for r in transactions.token_lives(requests, "token", "at", "print", "id").collect()}
    assert [found[i] for i in range(10)] == ["Applied", "Applied", "Replayed", "Mismatch", "Applied", "Applied", "Replayed", "Mismatch", "Applied", "Replayed"]


def test_a_cancelled_request_frees_its_token(spark):
    rows = [(0, "t", 0, "x", True), (1, "t", 1, "y", False), (2, "t", 2, "y", False)]
    requests = spark.createDataFrame(rows, "id long, token string, at long, print string, gone boolean")
    found = transactions.token_lives(requests, "token", "at", "print", "id", "gone").orderBy("id").collect()
    assert [r.outcome for r in found] == ["Applied", "Applied", "Replayed"]


def test_only_accepted_changes_of_a_class_count(spark):
    day = 86400
    rows = [(1, 0, "B"), (1, day, "A"), (1, 28 * day, "B"), (1, 29 * day, "B"), (1, 32 * day, "B"), (2, 0, "A"), (2, 1, "A"), (2, 2, "A"), (3, 0, "B"), (3, 30 * day, "A"), (3, 30 * day + 1, "B")]
    found = tables.class_changes(spark.createDataFrame(rows, "table_id long, at long, class string"), first="A").orderBy("table_id", "at").collect()
    assert [r.allowed for r in found] == [True, True, False, False, True, True, True, True, True, True, True]


def test_writes_end_in_state(spark):
    items = spark.createDataFrame([("a", 1, "x"), ("b", -1, "y")], "id string, n int, s string")
    requests = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    good = X.compare(F.col("old_n"), ">", 0)
    for kind, want in (("put", {("a", None, None), ("b", -1, "y")}), ("delete", {("b", -1, "y")})):
        shown, after = mutate.write(items, requests, ["id"], good, kind)
        assert {tuple(r) for r in after.collect()} == want
        assert {r.id: r.outcome for r in shown.collect()} == {"a": "Applied", "b": "ConditionFailed", "c": "ConditionFailed"}
    shown, after = mutate.write(items, requests, ["id"], None, "update", [X.Update("add", "n", 5)])
    assert {tuple(r) for r in after.collect()} == {("a", 6, "x"), ("b", 4, "y"), ("c", 5, None)}
    assert {(r.id, r.old and r.old.n, r.new.n) for r in shown.collect()} == {("a", 1, 6), ("b", -1, 4), ("c", None, 5)}
    with pytest.raises(ValueError):
        mutate.write(items, requests, ["id"], None, "update", [X.Update("set", "id", "z")])


def test_mixed_transactions(spark):
    items = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "id string, n int")
    rows = [
        (1, 0, "PUT", "d", 9), (1, 1, "UPDATE", "a", 7), (1, 2, "DELETE", "b", None), (1, 3, "CHECK", "c", None),
        (2, 0, "PUT", "e", 1), (2, 1, "UPDATE", "e", 2), (3, 0, "PUT", "f", 1), (3, 1, "UPDATE", "a", 8), (4, 0, "PUT", "g", -1),
    ]
    operations = spark.createDataFrame(rows, "txn int, pos int, kind string, id string, n int")
    shown, after = transactions.write(items, operations, ["id"], "txn", "pos", "kind", X.negate(X.compare(F.col("n"), "=", -1)))
    assert {tuple(r) for r in after.collect()} == {("a", 7), ("c", 3), ("d", 9)}
    assert {(r.txn, r.pos): r.failure for r in shown.collect() if r.failure} == {(2, 0): "DuplicateItem", (2, 1): "DuplicateItem", (3, 1): "Conflict", (4, 0): "ConditionFailed"}
    assert {r.txn: r.decision for r in shown.collect()} == {1: "COMMIT", 2: "ABORT", 3: "ABORT", 4: "ABORT"}
    read = transactions.transact_read(spark.createDataFrame([(1, 0, "a"), (1, 1, "z")], "txn int, pos int, id string"), items, ["id"], "txn", "pos", F.lit(5 << 20))
    assert {(r.id, r.found, r.failure) for r in read.collect()} == {("a", True, "TooLarge"), ("z", False, "TooLarge")}


def test_repeated_puts(spark):
    items = spark.createDataFrame([("a", 1)], "id string, n int")
    twice = spark.createDataFrame([("a", 2), ("a", 3)], "id string, n int")
    assert {tuple(r) for r in mutate.put(items, twice, ["id"], order="n").collect()} == {("a", 3)}
    assert {tuple(r) for r in mutate.put(items, twice.where("n = 2").union(twice.where("n = 2")), ["id"]).collect()} == {("a", 2)}
    with pytest.raises(Exception, match="several puts"):
        mutate.put(items, twice, ["id"]).collect()
    with pytest.raises(Exception, match="put and delete"):
        mutate.batch_write(items, twice.where("n = 2"), items, ["id"]).collect()


def test_kinds_that_differ_do_not_match(spark):
    rows = spark.createDataFrame([("a", 1, "5"), ("b", 5, None)], "id string, n int, l string")
    assert rows.where(X.compare(F.col("l"), "=", 5)).count() == 0
    assert rows.where(X.negate(X.compare(F.col("l"), "=", 5))).count() == 2
    assert rows.where(X.compare(F.col("l"), "<>", "5")).count() == 1
    assert rows.where(X.within(F.col("n"), [5, "x"])).count() == 1
    assert rows.where(X.between(F.col("n"), 1.5, 5)).count() == 1
    assert rows.where(X.begins_with(F.col("n"), "5")).count() == 0


@pytest.mark.parametrize("name, pushed", [("query_lt", "LessThan(turn,3)"), ("query_between", "GreaterThanOrEqual(turn,1)"), ("query_begins_with", "StringStartsWith(p_name,small)"), ("scan_resume", "GreaterThan(c_custkey,49)"), ("query_resume_reverse", "LessThan(ts,")])
def test_sort_keys_and_cursors_reach_the_scan(spark, name, pushed):
    plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert pushed in plan.split("PushedFilters")[1].split("]")[0]


def test_cursors_of_queries_and_scans(hot):
    rows = read.query(hot, HOT, {"pk": "hot"})
    page = read.paged(rows, ["sk"], 100, F.lit(False), size=F.octet_length("payload"), budget=1_000_000).collect()
    assert len(page) == 14 and {(r.scanned, r.cursor.sk, r.returned) for r in page} == {(14, 13, False)}
    assert {r.cursor.sk for r in read.paged(rows, ["sk"], 12, forward=False).collect()} == {18}
    assert {r.cursor for r in read.paged(rows, ["sk"], 30).collect()} == {None}
    assert {r.cursor.sk for r in read.paged(rows, ["sk"], 30, cut_is_end=False).collect()} == {29}


def test_pages_of_records(spark):
    made = spark.createDataFrame([(i, i, 10) for i in range(1, 8)], "v long, at long, size int")
    page = lambda after, limit, budget: [tuple(r) for r in change_log.get_records(made, "v", after, limit, F.col("at"), 102, F.col("size"), budget, keep=100).select("v", "last_sequence", "exhausted").collect()]
    assert page(0, 2, 100) == [(3, 4, False), (4, 4, False)]
    assert page(4, 9, 25) == [(5, 6, False), (6, 6, False)]
    assert page(5, 2, 25) == [(6, 7, True), (7, 7, True)]
    with pytest.raises(Exception, match="exceeds"):
        page(0, 2, 5)


def test_unchanged_projections_give_no_entry(spark):
    log = spark.createDataFrame([("k", 1, "a", "x"), ("k", 2, "a", "x"), ("k", 3, "b", "x")], "id string, v int, i string, image string")
    assert sorted((r.i, r.v, r.image) for r in index.moves(log, ["id"], "i", "v", "image").collect()) == [("a", 1, "x"), ("a", 3, None), ("b", 3, "x")]


def test_numbers_in_exponent_form(spark):
    row = spark.createDataFrame([(1.2e10, 0.00001, -1.5)], "a double, b double, c double")
    assert row.select(*(S.number_bytes(F.col(c)) for c in "abc")).first()[:] == (2, 2, 3)


def test_whole_tables_are_folded(spark):
    folder = "/root/testdata/sf0.01"
    events = sorted(spark.read.parquet(f"{folder}/events.parquet").select("user_id", "event_id", "event_type", "value").collect(), key=lambda r: r.event_id)
    held, want = {}, {}
    for r in events:
        amount, balance = int(r.value // 1), held.get(r.user_id, 0)
        applied = r.event_type != "purchase" or amount <= balance
        held[r.user_id] = balance + (0 if not applied else -amount if r.event_type == "purchase" else amount)
        want[r.event_id] = applied, held[r.user_id]
    found = catalog.QUERIES["txn_serial"](spark, folder).collect()
    assert len(found) == len(events) and {r.event_id: (r.applied, r.balance) for r in found} == want
    orders = spark.read.parquet(f"{folder}/orders.parquet").count()
    assert all(catalog.QUERIES[q](spark, folder).count() == orders for q in ("global_index_keys_only", "global_index_include"))
    assert catalog.QUERIES["table_class_limit"](spark, folder).count() == sum(r.event_type == "signup" for r in events)


def test_item_sizes(spark):
    row = spark.createDataFrame([("key-n", "row", bytearray(4), 12345)], "id string, sort string, payload binary, n int")
    size = S.item_bytes(id=S.string_bytes(F.col("id")), sort=S.string_bytes(F.col("sort")), payload=F.octet_length("payload"), nested=S.list_bytes(F.lit(1), S.number_bytes(F.col("n"))))
    assert row.select(size).first()[0] == 41


@pytest.mark.parametrize("keys, middle", [([], None), ([4], None), ([1, 2], 2), ([5, 1, 9, 9, 7], 7), (list(range(0, 3000, 3)), 1500)])
def test_split_points(spark, keys, middle):
    found = ranges.split_point(spark.createDataFrame([(k,) for k in keys], "k long"), "k").collect()
    assert [r.split_key for r in found] == ([] if middle is None else [middle])


def test_split_points_of_strings_and_wide_numbers(spark):
    assert ranges.split_point(spark.createDataFrame([("b",), ("a",), ("c",)], "k string"), "k").collect()[0][:] == ("b", 3)
    assert ranges.split_point(spark.createDataFrame([(-(1 << 62),), (1 << 62,)], "k long"), "k").collect()[0][:] == (1 << 62, 2)


def test_directories(spark):
    parts = ranges.directory(spark.createDataFrame([(10,), (20,)], "fence long"), "fence")
    routed = ranges.route(spark.createDataFrame([(i,) for i in (-5, 9, 10, 19, 20)], "k long"), "k", parts)
    assert [r.part for r in routed.orderBy("k").collect()] == [1, 1, 2, 2, 3]


def test_catalog_pages(spark):
    names = spark.createDataFrame([(f"t{i:02}",) for i in range(7)], "name string")
    page = tables.list_page(names, ["name"], ("t02",), 3).collect()
    assert [(r.name, r.has_more) for r in page] == [("t03", True), ("t04", True), ("t05", True)]
    assert [r.has_more for r in tables.list_page(names, ["name"], ("t05",), 3).collect()] == [False]
