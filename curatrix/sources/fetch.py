"""Fetching in tasks. The fetcher is given (url -> (status, content type, body)), so tests and sealed clusters need no
network. An error is a value in a row and never fails a job."""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame

Fetcher = Callable[[str], tuple[int, str, bytes]]
OUTCOME = "key string, url string, sha256 string, mime_type string, width int, height int, byte_size long, local_path string, error string"
#: What a picture's file begins with, and its mime type.
SIGNATURES = {b"\x89PNG\r\n\x1a\n": "image/png", b"\xff\xd8": "image/jpeg", b"GIF8": "image/gif", b"RIFF": "image/webp"}


def picture_header(body: bytes) -> tuple[str | None, int | None, int | None]:
    """Mime type, width and height by a file's header; None for what it does not say."""
    mime = next((m for s, m in SIGNATURES.items() if body.startswith(s)), None)
    size = (None, None)
    if mime == "image/png" and len(body) >= 24:
        size = struct.unpack(">II", body[16:24])
    elif mime == "image/gif" and len(body) >= 10:
        size = struct.unpack("<HH", body[6:10])
    elif mime == "image/webp":
        if body[8:12] != b"WEBP":
            mime = None
        elif body[12:16] == b"VP8X" and len(body) >= 30:
            size = (1 + int.from_bytes(body[24:27], "little"), 1 + int.from_bytes(body[27:30], "little"))
        elif body[12:16] == b"VP8L" and len(body) >= 25:
            bits = int.from_bytes(body[21:25], "little")
            size = (1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF))
        elif body[12:16] == b"VP8 " and len(body) >= 30:
            w, h = struct.unpack("<HH", body[26:30])
            size = (w & 0x3FFF, h & 0x3FFF)
    elif mime == "image/jpeg":
        at = 2
        while at + 9 <= len(body) and body[at] == 0xFF:
            kind = body[at + 1]
            if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):  # a frame
                h, w = struct.unpack(">HH", body[at + 5 : at + 9])
                size = (w, h)
                break
            at += 2 + struct.unpack(">H", body[at + 2 : at + 4])[0]
    return mime, *size


def _store(body: bytes, digest: str, root: str) -> str:
    """The path of a file with these bytes under root, by their hash, so that a task that runs again writes the same file."""
    files, folder = fs.FileSystem.from_uri(root)
    path = f"{folder}/{digest[:2]}/{digest}"
    if files.get_file_info(path).type == fs.FileType.NotFound:
        files.create_dir(f"{folder}/{digest[:2]}", recursive=True)
        part = f"{path}.{uuid.uuid4().hex}"
        with files.open_output_stream(part) as out:
            out.write(body)
        files.move(part, path)
    return f"{root.rstrip('/')}/{digest[:2]}/{digest}"


def _try(fetch: Fetcher, urls) -> tuple[str | None, str | None, bytes | None, str | None]:
    """The first URL that answers well; else the last error."""
    error = "no url"
    for url in urls if urls is not None else []:
        try:
            status, kind, body = fetch(url)
            if 200 <= status < 300 and body:
                return url, kind, body, None
            error = f"{url}: status {status}"
        except Exception as e:  # noqa: BLE001  whatever a fetcher raises is the row's error
            error = f"{url}: {e}"
    return None, None, None, error


def fetch_one(fetch: Fetcher, urls: list[str]) -> tuple[str | None, bytes | None]:
    """An error, or the bytes of the first URL that answers well."""
    _, _, body, error = _try(fetch, urls)
    return error, body


def http_get(url: str, timeout: float = 30.0) -> tuple[int, str, bytes]:
    """A fetcher of http and https addresses by the standard library."""
    from urllib.error import HTTPError
    from urllib.request import Request, urlopen

    if not url.lower().startswith(("http://", "https://")):
        raise ValueError("not an http address")
    try:
        with urlopen(Request(url, headers={"User-Agent": "curatrix"}), timeout=timeout) as answer:
            return answer.status, answer.headers.get_content_type(), answer.read()
    except HTTPError as e:
        return e.code, "", b""


def fetch_all(wanted: DataFrame, fetch: Fetcher, store: str | None = None) -> DataFrame:
    """wanted (key, urls: candidates in order) to outcomes; bytes are hashed in the task and do not travel. store: a shared
    folder, with its scheme, where they are written by their hash; else local_path is null."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, urls in zip(batch["key"], batch["urls"]):
                url, kind, body, error = _try(fetch, urls)
                path = None
                if body and store:
                    try:
                        path = _store(body, hashlib.sha256(body).hexdigest(), store)
                    except Exception as e:  # noqa: BLE001  a file that cannot be stored is not there, and the job goes on
                        kind, body, error = None, None, f"{url}: not stored, {e}"
                digest = hashlib.sha256(body).hexdigest() if body else None
                mime, width, height = picture_header(body) if body else (None, None, None)
                rows.append((key, url, digest, mime or kind, width, height, len(body) if body else None, path, error))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in OUTCOME.split(", ")]).astype({c: "Int64" for c in ("byte_size", "width", "height")})

    return wanted.select("key", "urls").mapInPandas(run, OUTCOME)


def fetch_missing(wanted: DataFrame, existing: DataFrame, fetch: Fetcher, force: bool = False, store: str | None = None) -> DataFrame:
    """Only what has no file yet, unless forced. existing: (key)."""
    return fetch_all(wanted if force else wanted.join(existing.select("key"), "key", "left_anti"), fetch, store)


def fetch_texts(wanted: DataFrame, fetch: Fetcher) -> DataFrame:
    """JSON documents by candidates in order: the first that answers; all errors joined if none does."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, urls in zip(batch["key"], batch["urls"]):
                errors, text = [], None
                for url in urls if urls is not None else []:
                    _, _, body, error = _try(fetch, [url])
                    if body is not None:
                        text = body.decode("utf-8", "replace")
                        break
                    errors.append(error)
                rows.append((key, text, None if text is not None else "; ".join(errors)))
            yield pd.DataFrame(rows, columns=["key", "text", "error"])

    return wanted.select("key", "urls").mapInPandas(run, "key string, text string, error string")


def probe_urls(wanted: DataFrame, head: Callable[[str], int], get_range: Callable[[str], int]) -> DataFrame:
    """(key, ok, status) of (key, url): a HEAD request, and where that fails a request for one byte."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, url in zip(batch["key"], batch["url"]):
                status = 0
                for ask in (head, get_range):
                    try:
                        status = ask(url)
                    except Exception:  # noqa: BLE001
                        status = 0
                    if 200 <= status < 300:
                        break
                rows.append((key, 200 <= status < 300, status))
            yield pd.DataFrame(rows, columns=["key", "ok", "status"])

    return wanted.select("key", "url").mapInPandas(run, "key string, ok boolean, status int")
