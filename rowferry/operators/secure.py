"""Encrypt and decrypt columns: AES-256-GCM, ``iv.tag.data`` in base64.

A random 12-byte IV is drawn per value. A key is base64 text of 32 bytes. Given
as text it becomes a literal of the plan, which ``explain`` and event logs show;
a :class:`KeyRing` keeps keys out of both and names the key each value is under,
so that keys can be replaced while old values stay readable.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Mapping as Mapped

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Bytes of the IV and of the tag.
IV_BYTES = 12
TAG_BYTES = 16
KEY_BYTES = 32


def _checked(key_b64: str) -> str:
    if len(base64.b64decode(key_b64)) != KEY_BYTES:
        raise ValueError("the key must be base64 text of 32 bytes")
    return key_b64


def _key(key_b64: str | Column) -> Column:
    return F.unbase64(key_b64 if isinstance(key_b64, Column) else F.lit(_checked(key_b64)))


def encrypt(c: Column, key_b64: str | Column) -> Column:
    """Cipher text of a text column; NULL stays NULL."""
    sealed = F.aes_encrypt(F.encode(c, "UTF-8"), _key(key_b64), F.lit("GCM"))
    return F.transform(
        F.array(sealed),  # bound once: each evaluation would draw a new IV
        lambda b: F.when(b.isNotNull(), F.concat_ws(
            ".",
            F.base64(F.substring(b, 1, IV_BYTES)),
            F.base64(F.substring(b, -TAG_BYTES, TAG_BYTES)),
            F.base64(F.substring(b, F.lit(IV_BYTES + 1),
                                 F.octet_length(b) - F.lit(IV_BYTES + TAG_BYTES))),
        )),
    )[0]


def decrypt(c: Column, key_b64: str | Column) -> Column:
    """Text of a cipher column; raises where the key or the data is wrong."""
    parts = F.split(c, "[.]", 3)
    iv, tag, data = (F.unbase64(parts[i]) for i in range(3))
    return F.decode(F.aes_decrypt(F.concat(iv, data, tag), _key(key_b64), F.lit("GCM")), "UTF-8")


_KEYS = "__keys"


def _c(name: str) -> Column:
    return F.col(f"`{name}`")


def _key_of(key_id: Column) -> Column:
    return F.coalesce(F.try_element_at(F.col(_KEYS), key_id),
                      F.raise_error(F.concat(F.lit("no key of id "), key_id)).cast("string"))


class KeyRing:
    """Keys by id, of which ``current`` seals new values: ``id.iv.tag.data``.

    The keys are rows of a table and reach the rows through a scalar subquery, so a plan shows where they come from and not what they are. Values
    of three parts, without an id, are opened with the key whose id is ``""``.
    Ids are letters, digits, ``_`` and ``-``.
    """

    def __init__(self, spark: SparkSession, keys: Mapped[str, str], current: str):
        if current not in keys or current == "":
            raise ValueError("the current key must be one of the keys and have an id")
        for name in keys:
            if not re.fullmatch(r"[A-Za-z0-9_-]*", name):
                raise ValueError(f"{name!r} is not a key id")
        rows = [(name, _checked(key)) for name, key in keys.items()]
        self.current = current
        self._table = spark.createDataFrame(rows, "key_id string, key string")

    def _keyed(self, df: DataFrame) -> DataFrame:
        """``df`` with the keys by id as a column."""
        return df.withColumn(_KEYS, self._table.agg(F.map_from_entries(F.collect_list(F.struct("key_id", "key")))).scalar())

    def seal(self, df: DataFrame, *columns: str) -> DataFrame:
        """Text ``columns`` as cipher text under the current key; NULL stays NULL."""
        return self._keyed(df).withColumns({c: self._seal(_c(c)) for c in columns}).drop(_KEYS)

    def open(self, df: DataFrame, *columns: str) -> DataFrame:
        """Cipher ``columns`` under any key of the ring as text; NULL stays NULL, an unknown id raises."""
        return self._keyed(df).withColumns({c: self._open(_c(c)) for c in columns}).drop(_KEYS)

    def reseal(self, df: DataFrame, *columns: str) -> DataFrame:
        """Cipher ``columns`` brought under the current key; values already under it stay as they are."""
        return self._keyed(df).withColumns({
            c: F.when(_c(c).startswith(f"{self.current}."), _c(c)).otherwise(self._seal(self._open(_c(c))))
            for c in columns}).drop(_KEYS)

    def _seal(self, c: Column) -> Column:
        return F.concat(F.lit(f"{self.current}."), encrypt(c, _key_of(F.lit(self.current))))

    @staticmethod
    def _open(c: Column) -> Column:
        named = F.size(F.split(c, "[.]")) == 4
        key_id = F.when(named, F.substring_index(c, ".", 1)).otherwise(F.lit(""))
        return F.when(c.isNotNull(), decrypt(F.substring_index(c, ".", -3), _key_of(key_id)))
