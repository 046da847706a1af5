"""Accounts and tokens: sign-up, login, refresh and logout over batches of requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as T
from ..functions import tokens as K

LEAST_PASSWORD, ACCESS_MINUTES, REFRESH_DAYS = 8, 30, 7


def signup(users: DataFrame, requests: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """users', and status per request (request_id, email, password): 409 taken, then 422 short, else 201.

    Of several requests for one email the first with a long enough password gets it.
    """
    known = users.select("email", F.lit(True).alias("_known")).distinct()
    r = requests.join(known, "email", "left").withColumn("_long", F.coalesce(F.char_length("password") >= LEAST_PASSWORD, F.lit(False)))
    first = F.min(F.when(F.col("_long"), F.col("request_id"))).over(W.partitionBy("email"))
    r = r.withColumn("_first", first)
    status = F.when(F.col("_known") | (F.col("request_id") > F.col("_first")), 409).when(~F.col("_long"), 422).otherwise(201)
    r = r.withColumn("status", status)
    new = r.where("status = 201").select(T.content_id(F.lit("user"), F.col("email")).alias("id"), "email", K.password_hash(F.col("password")).alias("hashed_password"), F.lit(True).alias("is_active"), now.alias("created_at"))
    return users.unionByName(new), r.select("request_id", "email", "status")


def login(users: DataFrame, requests: DataFrame, now: Column, key: str) -> DataFrame:
    """request_id, status, user_id, access_token, refresh_token: 401 unknown or wrong password, then 403 inactive, else 200."""
    r = requests.join(users.select("email", F.col("id").alias("user_id"), "hashed_password", "is_active"), "email", "left")
    ok = K.password_matches(F.col("password"), F.col("hashed_password"))
    r = r.withColumn("status", F.when(F.col("user_id").isNull() | ~ok, 401).when(~F.col("is_active"), 403).otherwise(200))
    good = F.col("status") == 200
    who = F.when(good, F.col("user_id"))
    make = lambda kind, at: F.when(good, K.signed(F.coalesce(who, F.lit("")), kind, at, key))
    return r.select("request_id", "status", who.alias("user_id"), make("access", K.expiry(now, minutes=ACCESS_MINUTES)).alias("access_token"), make("refresh", K.expiry(now, days=REFRESH_DAYS)).alias("refresh_token"))


def stored_tokens(logins: DataFrame, now: Column) -> DataFrame:
    """Rows of refresh_tokens for the logins that got one: only the hash is kept."""
    digest = T.sha256_hex(F.col("refresh_token"))
    return logins.where("status = 200").select(T.content_id(F.lit("token"), digest).alias("id"), "user_id", digest.alias("token_hash"), K.expiry(now, days=REFRESH_DAYS).alias("expires_at"), F.lit(False).alias("revoked"), now.alias("created_at"))


def valid_tokens(tokens: DataFrame, users: DataFrame, now: Column) -> DataFrame:
    """Tokens not revoked, not expired (the instant of expiry still counts), of active users."""
    active = users.where("is_active").select(F.col("id").alias("user_id"))
    return tokens.where(~F.col("revoked") & (F.col("expires_at") >= now)).join(active, "user_id", "left_semi")


def refresh(presented: DataFrame, tokens: DataFrame, users: DataFrame, now: Column, key: str) -> DataFrame:
    """request_id, status, access_token for presented refresh tokens: 401 for any failure."""
    p = presented.withColumn("_c", K.claims(F.col("token"), key, now)).withColumns({"_sub": K.subject_of(F.col("_c"), "refresh"), "_hash": T.sha256_hex(F.col("token"))})
    good = valid_tokens(tokens, users, now).select(F.col("token_hash").alias("_hash"), F.col("user_id").alias("_sub"), F.lit(True).alias("_ok")).distinct()
    p = p.join(good, ["_hash", "_sub"], "left").withColumn("status", F.when(F.col("_ok"), 200).otherwise(401))
    return p.select("request_id", "status", F.when(F.col("status") == 200, K.signed(F.coalesce("_sub", F.lit("")), "access", K.expiry(now, minutes=ACCESS_MINUTES), key)).alias("access_token"))


def revoke(tokens: DataFrame, token_hash: str) -> DataFrame:
    """Idempotent; a hash that is not there changes nothing."""
    return tokens.withColumn("revoked", F.col("revoked") | F.col("token_hash").eqNullSafe(F.lit(token_hash)))


def current_users(presented: DataFrame, users: DataFrame, now: Column, key: str) -> DataFrame:
    """request_id, status, id, email, is_active of the active users whose access token is presented."""
    p = presented.withColumn("_sub", K.subject_of(K.claims(F.col("token"), key, now), "access"))
    p = p.join(users.where("is_active").select(F.col("id").alias("_sub"), "email", "is_active"), "_sub", "left")
    ok = F.col("email").isNotNull()
    return p.select("request_id", F.when(ok, 200).otherwise(401).alias("status"), F.when(ok, F.col("_sub")).alias("id"), "email", "is_active")


def delete_users(users: DataFrame, tokens: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Users without ``gone`` (id), and tokens without theirs."""
    ids = gone.select("id").distinct()
    return users.join(ids, "id", "left_anti"), tokens.join(ids.select(F.col("id").alias("user_id")), "user_id", "left_anti")


def health(spark, version: str) -> DataFrame:
    return spark.range(1).select(F.lit("ok").alias("status"), T.iso_timestamp(F.current_timestamp()).alias("timestamp"), F.lit(version).alias("version"))


def access_log(requests: DataFrame) -> DataFrame:
    """Requests with an identifier, a status (500 where none came) and the duration to four places."""
    return requests.select(F.coalesce("request_id", F.uuid()).alias("request_id"), "method", "path", F.coalesce("status", F.lit(500)).alias("status"), F.round("duration", 4).alias("duration"))
