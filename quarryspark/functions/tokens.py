"""Signed tokens and password hashes: no Spark built-in makes these, so they are Arrow-batched functions."""

from __future__ import annotations

import base64
import hashlib
import hmac
import json
import secrets
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _b64(raw: bytes) -> str:
    return base64.urlsafe_b64encode(raw).rstrip(b"=").decode()


def _unb64(text: str) -> bytes:
    return base64.urlsafe_b64decode(text + "=" * (-len(text) % 4))


def encode_token(claims: dict, key: str) -> str:
    """An HS256 JSON web token."""
    body = f"{_b64(json.dumps({'alg': 'HS256', 'typ': 'JWT'}).encode())}.{_b64(json.dumps(claims).encode())}"
    return f"{body}.{_b64(hmac.new(key.encode(), body.encode(), hashlib.sha256).digest())}"


def decode_token(token: str, key: str, now: float) -> dict | None:
    """The claims; None if the token is malformed, signed otherwise or expired."""
    try:
        head, body, sign = token.split(".")
        if json.loads(_unb64(head)).get("alg") != "HS256" or not hmac.compare_digest(_unb64(sign), hmac.new(key.encode(), f"{head}.{body}".encode(), hashlib.sha256).digest()):
            return None
        claims = json.loads(_unb64(body))
        return claims if isinstance(claims, dict) and not ("exp" in claims and claims["exp"] < now) else None
    except (ValueError, AttributeError, TypeError):
        return None


def signed(subject: Column, kind: str, expires: Column, key: str) -> Column:
    """Tokens of a subject; refresh tokens carry a random identifier so that no two are alike."""

    @F.pandas_udf("string")
    def make(s: pd.Series, e: pd.Series) -> pd.Series:
        extra = (lambda: {"jti": secrets.token_hex(16)}) if kind == "refresh" else dict
        return pd.Series([encode_token({"sub": x, "type": kind, "exp": int(t)} | extra(), key) for x, t in zip(s, e, strict=True)])

    return make.asNondeterministic()(subject, F.unix_timestamp(expires))


def claims(token: Column, key: str, now: Column) -> Column:
    """sub, type and exp of valid tokens, else null."""

    @F.pandas_udf("sub string, type string, exp long")
    def read(t: pd.Series, at: pd.Series) -> pd.DataFrame:
        found = [decode_token(x, key, n) or {} if isinstance(x, str) else {} for x, n in zip(t, at, strict=True)]
        return pd.DataFrame({"sub": [c.get("sub") for c in found], "type": [c.get("type") for c in found], "exp": pd.array([c.get("exp") for c in found], "Int64")})

    return read(token, F.unix_timestamp(now))


def subject_of(claims_: Column, kind: str) -> Column:
    """The subject if the token is of the wanted kind and has one."""
    return F.when(claims_["type"] == kind, F.nullif(claims_["sub"], F.lit("")))


def expiry(now: Column, minutes: int = 0, days: int = 0) -> Column:
    return now + F.make_dt_interval(F.lit(days), F.lit(0), F.lit(minutes))


def scrypt_hash(password: str) -> str:
    salt = secrets.token_bytes(16)
    return f"scrypt${salt.hex()}${hashlib.scrypt(password.encode(), salt=salt, n=2**12, r=8, p=1).hex()}"


def scrypt_matches(password: str, stored: str) -> bool:
    try:
        _, salt, digest = stored.split("$")
        return hmac.compare_digest(hashlib.scrypt(password.encode(), salt=bytes.fromhex(salt), n=2**12, r=8, p=1).hex(), digest)
    except (ValueError, AttributeError):
        return False


def password_hash(password: Column, make: Callable[[str], str] = scrypt_hash) -> Column:
    """Salted hashes; ``make`` may be another scheme, such as bcrypt where that is installed."""
    return _udf(make)(password)


def _udf(make: Callable[[str], str]):
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(make, na_action="ignore")

    return run.asNondeterministic()


def password_matches(password: Column, stored: Column, matches: Callable[[str, str], bool] = scrypt_matches) -> Column:
    @F.pandas_udf("boolean")
    def run(p: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series([isinstance(x, str) and isinstance(y, str) and matches(x, y) for x, y in zip(p, h, strict=True)])

    return run(password, stored)
