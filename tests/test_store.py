"""Conversations, folders, accounts and tokens."""

import datetime as dt

from pyspark.sql import functions as F

from quarryspark import schemas
from quarryspark.functions import tokens as K
from quarryspark.operators import accounts, conversations

T0 = dt.datetime(2026, 5, 11)
KEY = "secret"


def convs(spark, rows):
    return spark.createDataFrame(rows, schemas.CONVERSATIONS)


def test_lists_and_detail(spark):
    c = convs(spark, [("c1", "Test Chat", "u", None, T0), ("c2", "Later", "v", "f", T0 + dt.timedelta(1))])
    assert [r.id for r in conversations.list_conversations(c).collect()] == ["c2", "c1"]
    assert conversations.list_conversations(convs(spark, [])).collect() == []
    m = spark.createDataFrame([("m2", "c1", "assistant", "hi", T0, 1), ("m1", "c1", "user", "hello", T0, 0)], schemas.MESSAGES)
    got = {r.id: [(x.role, x.content) for x in r.messages] for r in conversations.detail(c, m).collect()}
    assert got == {"c1": [("user", "hello"), ("assistant", "hi")], "c2": []}
    assert conversations.owned(c, "c1", "u")[1] == 200 and conversations.owned(c, "c1", "v")[1] == 404 and conversations.owned(c, "x", "u")[1] == 404
    assert [r.id for r in conversations.in_folder(c, None).collect()] == ["c1"] and [r.id for r in conversations.in_folder(c, "f").collect()] == ["c2"]
    c2, m2 = conversations.delete_conversations(c, m, c.where("id = 'c1'"))
    assert c2.count() == 1 and m2.count() == 0


def test_turns(spark):
    c = conversations.start(convs(spark, []), "c", "q" * 150, "u", T0)
    assert c.first().title == "q" * 100
    m = conversations.add_turn(spark.createDataFrame([], schemas.MESSAGES), "c", "question", "answer", T0, 0)
    assert [(r.role, r.content) for r in conversations.history(m, 1).collect()] == [("user", "question")]
    assert [(r.role, r.content) for r in conversations.history(m, 1, newest=True).collect()] == [("assistant", "answer")]
    assert [r.title for r in conversations.titles(m).collect()] == ["question"]


def test_folders(spark):
    f, new = conversations.create_folder(spark.createDataFrame([], schemas.FOLDERS), "f-1", "  Work ", T0)
    assert new["conversation_count"] == 0 and new["name"] == "Work"
    f, _ = conversations.create_folder(f, "f-2", "Empty", T0 + dt.timedelta(1))
    c = convs(spark, [("c1", "a", "u", "f-1", T0), ("c2", "b", "u", "gone", T0), ("c3", "c", "u", None, T0)])
    assert [(r.name, r.conversation_count) for r in conversations.folder_counts(f, c).collect()] == [("Work", 1), ("Empty", 0)]
    renamed, status = conversations.rename_folder(f, "f-1", " Home ")
    assert status == 200 and {r.name for r in renamed.collect()} == {"Home", "Empty"} and conversations.rename_folder(f, "x", "y")[1] == 404
    moved, status = conversations.move(c, "c3", "f-2")
    assert status == 200 and {r.id: r.folder_id for r in moved.collect()}["c3"] == "f-2"
    assert {r.id: r.folder_id for r in conversations.move(c, "c1", None)[0].collect()}["c1"] is None and conversations.move(c, "x", None)[1] == 404
    left, free, status = conversations.delete_folder(f, c, "f-1")
    assert status == 204 and left.count() == 1 and {r.id: r.folder_id for r in free.collect()} == {"c1": None, "c2": "gone", "c3": None}
    assert conversations.delete_folder(f, c, "x")[2] == 404
    assert [r.id for r in conversations.orphans(c, f).collect()] == ["c2"]


def test_accounts(spark):
    NOW = F.lit("2026-05-11 12:00:00").cast("timestamp")
    users = spark.createDataFrame([], schemas.USERS)
    req = spark.createDataFrame([(1, "a@x", "short"), (2, "a@x", "longenough"), (3, "a@x", "longenough2"), (4, "b@x", "longenough")], "request_id int, email string, password string")
    users, out = accounts.signup(users, req, NOW)
    users = users.cache()
    assert {r.request_id: r.status for r in out.collect()} == {1: 422, 2: 201, 3: 409, 4: 201}
    again = accounts.signup(users, spark.createDataFrame([(1, "a@x", "x")], "request_id int, email string, password string"), NOW)[1]
    assert again.first().status == 409
    users = users.withColumn("is_active", F.col("email") != "b@x").cache()
    tries = spark.createDataFrame([(1, "a@x", "longenough"), (2, "a@x", "wrong"), (3, "b@x", "longenough"), (4, "c@x", "longenough")], "request_id int, email string, password string")
    logins = accounts.login(users, tries, NOW, KEY).cache()
    got = {r.request_id: r for r in logins.collect()}
    assert {k: r.status for k, r in got.items()} == {1: 200, 2: 401, 3: 403, 4: 401} and got[2].access_token is None
    tokens = accounts.stored_tokens(logins, NOW).cache()
    given = spark.createDataFrame([(1, got[1].refresh_token), (2, got[1].access_token), (3, "junk"), (4, None)], "request_id int, token string")
    assert {r.request_id: r.status for r in accounts.refresh(given, tokens, users, NOW, KEY).collect()} == {1: 200, 2: 401, 3: 401, 4: 401}
    later = NOW + F.expr("interval 8 days")
    assert accounts.refresh(given, tokens, users, later, KEY).where("status = 200").count() == 0
    revoked = accounts.revoke(tokens, tokens.first().token_hash)
    assert accounts.refresh(given, revoked, users, NOW, KEY).where("status = 200").count() == 0
    assert accounts.revoke(tokens, "none").where("revoked").count() == 0
    me = {r.request_id: (r.status, r.email) for r in accounts.current_users(given, users, NOW, KEY).collect()}
    assert me == {1: (401, None), 2: (200, "a@x"), 3: (401, None), 4: (401, None)}
    none, left = accounts.delete_users(users, tokens, users.where("email = 'a@x'"))
    assert none.count() == 1 and left.count() == 0


def test_token_validity_at_the_instant(spark):
    now = dt.datetime(2026, 5, 11, 12)
    t = spark.createDataFrame([("1", "u", "h1", now, False, now), ("2", "u", "h2", now - dt.timedelta(seconds=1), False, now), ("3", "u", "h3", now, True, now), ("4", "v", "h4", now, False, now)], schemas.REFRESH_TOKENS)
    u = spark.createDataFrame([("u", "e", "h", True, now), ("v", "f", "h", False, now)], schemas.USERS)
    assert [r.id for r in accounts.valid_tokens(t, u, F.lit(now)).collect()] == ["1"]


def test_signatures():
    t = K.encode_token({"sub": "u", "exp": 10}, KEY)
    assert K.decode_token(t, KEY, 9)["sub"] == "u" and K.decode_token(t, KEY, 11) is None and K.decode_token(t, "other", 9) is None and K.decode_token("a.b", KEY, 0) is None


def test_health_and_log(spark):
    assert accounts.health(spark, "1").first().status == "ok"
    log = spark.createDataFrame([("r", "GET", "/", 200, 0.123456), (None, "GET", "/", None, None)], "request_id string, method string, path string, status int, duration double")
    rows = accounts.access_log(log).collect()
    assert rows[0].duration == 0.1235 and rows[1].status == 500 and len(rows[1].request_id) == 36
