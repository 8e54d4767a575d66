"""DICOMweb as tables: URLs as expressions, requests made in Arrow batches by a transport, responses as rows.

The transport is a function (method, url, headers, body) -> (status code, headers, body); `urllib_transport` is one.
It runs on the executors, so it must be importable or picklable there.
"""

from __future__ import annotations

import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.arrow import mapped
from lumenframe.sources import dicom_json, part10

Transport = Callable[[str, str, dict, bytes | None], tuple[int, dict, bytes]]
DICOM, JSON, PARTS = "application/dicom", "application/dicom+json", 'multipart/related; type="application/dicom"'


def quoted(text: Column) -> Column:
    """A path segment or query value, percent-encoded."""
    return F.replace(F.url_encode(text.cast("string")), F.lit("+"), F.lit("%20"))


def url(base: Column | str, *segments: Column | str) -> Column:
    """base and path segments: strings as they are, columns encoded; a NULL segment gives NULL."""
    start = F.lit(base) if isinstance(base, str) else base
    return F.concat(F.regexp_replace(start, "/+$", ""), *[F.concat(F.lit("/"), F.lit(s) if isinstance(s, str) else quoted(s)) for s in segments])


def search_url(base: Column | str, level: str, study: Column | None = None, series: Column | None = None, query: Column | None = None, limit: int | None = None, offset: int | None = None) -> Column:
    """A search for studies, series or instances; query is a map of attributes to match."""
    if (limit is not None and limit <= 0) or (offset is not None and offset < 0):
        raise ValueError("invalidQIDOPagination")
    path: list[Column | str] = []
    if study is not None:
        path += ["studies", study]
    if series is not None:
        path += ["series", series]
    items = F.array() if query is None else F.transform(F.array_sort(F.map_entries(query)), lambda e: F.concat(quoted(e["key"]), F.lit("="), quoted(e["value"])))
    extra = [f"{k}={v}" for k, v in (("limit", limit), ("offset", offset)) if v is not None]
    listed = F.concat(items.cast("array<string>"), F.array(*map(F.lit, extra)).cast("array<string>"))
    return F.concat(url(base, *path, level), F.when(F.size(listed) > 0, F.concat(F.lit("?"), F.array_join(listed, "&"))).otherwise(F.lit("")))


def instance_url(base: Column | str, study: Column, series: Column, instance: Column, *what: str) -> Column:
    """An instance, or its metadata, rendered image or thumbnail."""
    return url(base, "studies", study, "series", series, "instances", instance, *what)


def frames_url(base: Column | str, study: Column, series: Column, instance: Column, numbers: Column) -> Column:
    """Frames by their numbers from one; NULL without numbers or with one below."""
    fits = (F.size(numbers) > 0) & F.forall(numbers, lambda n: n > 0)
    return F.when(fits, F.concat(instance_url(base, study, series, instance, "frames"), F.lit("/"), F.array_join(numbers.cast("array<string>"), ",")))


def urllib_transport(method: str, address: str, headers: dict, body: bytes | None, timeout: float = 30.0) -> tuple[int, dict, bytes]:
    request = urllib.request.Request(address, data=body, headers=headers, method=method)
    try:
        with urllib.request.urlopen(request, timeout=timeout) as r:
            return r.status, dict(r.headers), r.read()
    except urllib.error.HTTPError as e:
        return e.code, dict(e.headers), e.read()


def performed(requests: DataFrame, transport: Transport = urllib_transport, attempts: int = 1) -> DataFrame:
    """(file_id, url, code, content_type, body, attempts, status) of requests with file_id, url and any of method, accept,
    content_type and body.

    Codes 429 and 5xx are tried again, attempts times in all, without a pause. status is ok, unsuccessfulHTTPStatus for
    codes beyond 2xx, or invalidHTTPResponse where there was no response. Requests run in parallel as their partitions do.
    """
    if attempts < 1:
        raise ValueError("invalidRetryPolicy")
    schema = pa.schema([("file_id", pa.string()), ("url", pa.string()), ("code", pa.int32()), ("content_type", pa.string()), ("body", pa.binary()), ("attempts", pa.int32()), ("status", pa.string())])

    def one(row: dict) -> dict:
        headers = {k: row[c] for k, c in (("Accept", "accept"), ("Content-Type", "content_type")) if row[c]}
        out = {"file_id": row["file_id"], "url": row["url"], "status": "invalidHTTPResponse"}
        for n in range(1, attempts + 1):
            out["attempts"] = n
            try:
                code, got, body = transport(row["method"] or "GET", row["url"], headers, row["body"])
            except (OSError, ValueError):
                continue
            kind = next((v for k, v in got.items() if k.lower() == "content-type"), None)
            out |= {"code": code, "content_type": kind, "body": body, "status": "ok" if 200 <= code < 300 else "unsuccessfulHTTPStatus"}
            if not (code == 429 or 500 <= code < 600):
                break
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 16):
                yield pa.RecordBatch.from_pylist([one(r) for r in batch.slice(k, 16).to_pylist()], schema=schema)

    have = [F.col(c) if c in requests.columns else F.lit(None).cast(t).alias(c) for c, t in (("file_id", "string"), ("url", "string"), ("method", "string"), ("accept", "string"), ("content_type", "string"), ("body", "binary"))]
    return mapped(requests.select(*have), run, "file_id string, url string, code int, content_type string, body binary, attempts int, status string")


def found(responses: DataFrame) -> DataFrame:
    """Decoded files of searches' and metadata's JSON arrays; file_id is the request's, with the place in the array."""
    texts = responses.where("status = 'ok'").select("file_id", F.from_json(F.decode("body", "UTF-8"), "array<string>").alias("all"))
    each = texts.select("file_id", F.posexplode("all").alias("at", "json")).select(F.concat_ws("#", "file_id", "at").alias("file_id"), "json")
    return dicom_json.read_json(each)


def retrieved(responses: DataFrame) -> DataFrame:
    """(file_id, content, status) of retrieved instances: a multipart body's first part, or the body itself."""
    good = responses.where("status = 'ok'")
    several = F.coalesce(F.lower("content_type").startswith("multipart/"), F.lit(False))
    parts = part10.first_parts(good.where(several).select("file_id", "body", "content_type"))
    return parts.unionByName(good.where(~several).select("file_id", F.col("body").alias("content"), "status"))


def store_requests(instances: DataFrame, base: str, boundary: str = "lumenframe", study: Column | None = None) -> DataFrame:
    """Requests that store rows' array `parts` of Part 10 files."""
    address = url(base, "studies") if study is None else url(base, "studies", study)
    where = instances.select("file_id", address.alias("url"))
    bodies = part10.multipart_bodies(instances.select("file_id", "parts"), boundary)
    return bodies.join(where, "file_id").select("file_id", "url", F.lit("POST").alias("method"), F.lit(JSON).alias("accept"), F.lit(f'{PARTS}; boundary="{boundary}"').alias("content_type"), "body")
