"""Detectors as SQL functions, and a table function that finds values with their places."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import textops as t


def _holds_sign(text: str) -> bool:
    return "@" in text


def _any(text: str) -> bool:
    return True


@F.udtf(returnType="kind string, value string, start int, end int")
class FindPii:
    """find_pii(text) -> kind, value, start, end; offsets count code points from 0."""

    def eval(self, text: str | None) -> Iterator[tuple[str, str, int, int]]:
        text = text or ""
        # what is part of every match, and cheaper to look for, is looked for first
        for kind, pattern, group, fine, maybe in (
            ("email", t.EMAIL, 0, None, _holds_sign), ("iban", t.IBAN, 1, t.iban_ok, _any), ("phone", t.PHONE, 0, None, _any), ("bsn", t.BSN_LABELLED, 1, t.bsn_ok, _any),
            ("mac", t.MAC, 0, None, _any), ("postcode", t.POSTCODE_STREET, 0, None, t.POSTCODE_BARE.search), ("dob", t.DOB, 1, None, _any),
            ("ip", t.IPV4, 0, t.ip_token_wanted, _any), ("ip", t.IPV6, 0, t.ip_token_wanted, t.may_hold_ipv6),
        ):
            for m in pattern.finditer(text) if maybe(text) else ():
                if fine is None or fine(m[group]):
                    yield kind, m[group], m.start(group), m.end(group)


def register(spark: SparkSession) -> None:
    """Make find_pii, iban_ok, bsn_ok, is_pii_token and looks_like_name known to SQL."""
    spark.udtf.register("find_pii", FindPii)
    for name, f in (("iban_ok", t.iban_ok), ("bsn_ok", t.bsn_ok), ("is_pii_token", t.is_token), ("looks_like_name", t.looks_like_name)):
        spark.udf.register(name, _vector(f))


def _vector(f):
    @F.pandas_udf("boolean")
    def g(s: pd.Series) -> pd.Series:
        return s.map(lambda v: v is not None and bool(f(v))).astype(bool)

    return g
