"""Secret scan with linking of multipart credentials.

Strong findings (``assign``, ``access``, ``hex``) are reported wherever they
stand. Identifiers, secrets and endpoints that prove nothing alone are weak
parts: an interval join looks for the other parts within a scope around each,
and only parts found together with their complements are reported.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rowferry.llm.words import buffers, per_group
from rowferry.session import stage

#: Parts at most this many code points apart are in one scope; weak secrets between them, of any length, don't count.
SCOPE = 300

_KEYWORDS = (b"passw", b"secret", b"token", b"api")
_ASSIGN = re.compile(
    rb"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_HEX = re.compile(rb"[0-9a-f]{32,}")  # maximal runs, the shorter ones dropped
_WEAK_ID = re.compile(
    rb"\b(?:A[BCGINPRS][A-Z]A[A-Z0-9]{12,}|"
    rb"(?i:client_?id|access_?key_?id|account_?id|user_?name|login)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9_.@-]{3,})")
_WEAK_SECRET = re.compile(rb"(?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/_-]{20,}+={0,2}(?![A-Za-z0-9+/=_-])")
_ENDPOINT = re.compile(
    rb"\b[a-z][a-z0-9+.-]{1,15}://[A-Za-z0-9._~:/?#@!$&()*+,;=%-]+|"
    rb"(?i:host(?:name)?|server|endpoint|url)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9_-]+(?:\.[A-Za-z0-9_-]+)+(?::\d+)?")
#: Kinds in the order in which spans that start together are listed.
KINDS = ("assign", "access", "hex", "weak_id", "weak_secret", "weak_endpoint")
#: The part that each kind plays.
ROLE = {"assign": "secret", "hex": "secret", "access": "id", "weak_id": "id", "weak_secret": "secret",
        "weak_endpoint": "endpoint"}


def _mixed(run: bytes) -> bool:
    return bool(re.search(rb"[0-9]", run) and re.search(rb"[a-z]", run) and re.search(rb"[A-Z]", run))


def base_spans(data: bytes) -> list[tuple[int, int, str]]:
    """Strong findings as (start, end, kind) in bytes."""
    out = []
    low = data.lower()
    if any(k in low for k in _KEYWORDS):
        out += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(data) if m.end(1) - m.start(1) >= 8]
    if b"AKIA" in data:
        out += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(data) if m.end() - m.start() >= 16]
    out += [(m.start(), m.end(), "hex") for m in _HEX.finditer(data)]
    return out


def weak_spans(data: bytes, strong: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Parts that count only together; secrets are looked for where there is an identifier to go with them."""
    out = [(m.start(), m.end(), "weak_id") for m in _WEAK_ID.finditer(data)]
    if b"://" in data or re.search(rb"(?i)host|server|endpoint|url", data):
        out += [(m.start(), m.end(), "weak_endpoint") for m in _ENDPOINT.finditer(data)]
    if out or any(k == "access" for _, _, k in strong):
        taken = [(a, b) for a, b, _ in strong + out]
        for m in _WEAK_SECRET.finditer(data):
            if _mixed(m[0]) and not any(a < m.end() and m.start() < b for a, b in taken):
                out.append((m.start(), m.end(), "weak_secret"))
    roles = {ROLE[k] for _, _, k in strong + out}
    return out if {"id", "secret"} <= roles else []


def _scan(batch: pa.RecordBatch) -> pa.RecordBatch:
    data, offsets = buffers(batch.column(1))
    rows = []
    for i in range(batch.num_rows):
        text = data[offsets[i]:offsets[i + 1]].tobytes()
        strong = base_spans(text)
        found = strong + weak_spans(text, strong)
        if found:
            points = np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)  # code points up to each byte
            found = sorted((int(points[a]) - 1, int(points[b - 1]), KINDS.index(k)) for a, b, k in found)
        rows.append([{"start": a, "end": b, "kind": k} for a, b, k in found])
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.int32())]))
    return pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind)], ["doc_id", "parts"])


def _listing(spans):
    """kind:start:end of an array of spans, comma-joined by start and kind."""
    names = F.array(*[F.lit(k) for k in KINDS])
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"], s["kind"], s["end"])))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """Spans of every document: ``doc_id``, ``base`` and ``linked`` arrays of (start, end, kind number).

    A weak secret is reported when within ``scope`` there are an identifier and
    either an endpoint or an access key; a weak identifier when there are a
    secret and an endpoint; a weak endpoint when there are an identifier and a
    secret. Null and empty texts give a row with no spans; repeated rows and
    null keys are each scanned on their own. Other columns are not read.
    """
    picked = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    rows = per_group(picked, "text", _scan, "doc_id long, parts array<struct<start:long,end:long,kind:int>>")
    # The numbers given to rows are fixed by writing them down.
    rows = stage(rows.withColumn("row", F.monotonically_increasing_id()), "secrets")
    weak_from = KINDS.index("weak_id")
    parts = rows.where(F.exists("parts", lambda p: p["kind"] >= weak_from)).select(
        "row", F.explode("parts").alias("p")).select("row", "p.start", "p.end", "p.kind")
    # The interval join: parts sorted along the text, and for each role the nearest end before and start after a part.
    ahead = Window.partitionBy("row").orderBy("start", "end", "kind").rowsBetween(Window.unboundedPreceding, -1)
    behind = Window.partitionBy("row").orderBy("start", "end", "kind").rowsBetween(1, Window.unboundedFollowing)
    # Places along the text without its weak secrets, so that a long one doesn't part what stands around it.
    weak = F.col("kind") == KINDS.index("weak_secret")
    skipped = F.coalesce(F.sum(F.when(weak, F.col("end") - F.col("start"))).over(ahead), F.lit(0))
    parts = parts.withColumn("from", F.col("start") - skipped).withColumn(
        "to", F.when(weak, F.col("from")).otherwise(F.col("end") - skipped))

    def near(kinds):
        mine = F.col("kind").isin([KINDS.index(k) for k in kinds])
        before = F.max(F.when(mine, F.col("to"))).over(ahead)
        after = F.min(F.when(mine, F.col("from"))).over(behind)
        return F.coalesce(F.col("from") - before <= scope, F.lit(False)) | F.coalesce(
            after - F.col("to") <= scope, F.lit(False))

    marked = parts.select(
        "*", near(["access", "weak_id"]).alias("ids"), near(["assign", "hex", "weak_secret"]).alias("secrets"),
        near(["weak_endpoint"]).alias("ends"), near(["access"]).alias("keys"))
    kind = F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.col("kind") + 1)
    keep = ((kind == "weak_secret") & F.col("ids") & (F.col("ends") | F.col("keys"))
            | (kind == "weak_id") & F.col("secrets") & F.col("ends")
            | (kind == "weak_endpoint") & F.col("ids") & F.col("secrets"))
    linked = marked.where(keep).groupBy("row").agg(F.collect_list(F.struct("start", "end", "kind")).alias("linked"))
    return rows.join(linked, "row", "left").select(
        "doc_id", F.filter("parts", lambda p: p["kind"] < weak_from).alias("base"),
        F.coalesce("linked", F.array().cast("array<struct<start:long,end:long,kind:int>>")).alias("linked"))


def digest(found: DataFrame) -> DataFrame:
    """Counts, the digest of strong findings and the listing of all spans, per document."""
    def count(kind):
        return F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"),
        F.sha2(_listing(F.col("base")), 256).alias("base_sha256"),
        _listing(F.concat("base", "linked")).alias("spans"))
