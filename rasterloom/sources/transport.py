"""Fetching tiles: transports by URL scheme, with retries; failures are values, not exceptions."""

from __future__ import annotations

import math
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np

from ..errors import InvalidRequestError
from .decode import encode_tiff


@dataclass(frozen=True)
class Request:
    """One tile's request as a task sees it."""

    url: str
    params: dict[str, list[str]]
    headers: dict[str, str] = field(default_factory=dict)
    output_format: str | None = None
    bbox: tuple[float, float, float, float] | None = None
    width: int | None = None
    height: int | None = None
    timeout: float = 30.0
    retries: int = 3
    backoff: float = 0.0


@dataclass(frozen=True)
class Response:
    """What came of it; status 0 is a network failure."""

    data: bytes = b""
    content_type: str = ""
    status_code: int = 0
    headers: dict[str, str] = field(default_factory=dict)
    url: str = ""
    success: bool = False
    error_message: str | None = None


Transport = Callable[[Request], Response]


def full_url(request: Request) -> str:
    return request.url + ("&" if "?" in request.url else "?") + urllib.parse.urlencode(request.params, doseq=True)


def _http(request: Request) -> Response:
    url = full_url(request)
    headers = dict(request.headers)
    if request.output_format:
        headers.setdefault("Accept", request.output_format)
    try:
        with urllib.request.urlopen(urllib.request.Request(url, headers=headers), timeout=request.timeout) as got:
            kind = got.headers.get("content-type", "")
            if got.status != 200:
                return Response(b"", kind, got.status, dict(got.headers), url, False, f"HTTP {got.status}")
            return Response(got.read(), kind, 200, dict(got.headers), url, True)
    except urllib.error.HTTPError as e:
        text = e.read().decode("utf-8", "replace")[:200]
        return Response(b"", e.headers.get("content-type", ""), e.code, dict(e.headers), url, False, f"HTTP {e.code}: {text}")
    except (OSError, ValueError) as e:
        return Response(url=request.url, error_message=f"Network error: {e}")


def _file(request: Request) -> Response:
    """``file:///folder``: the file that the ``file`` parameter names; for tests and mounted stores."""
    path = urllib.parse.urlparse(request.url).path.rstrip("/") + "/" + "".join(request.params.get("file", []))
    try:
        with open(path, "rb") as f:
            return Response(f.read(), request.output_format or "", 200, {}, "file://" + path, True)
    except OSError as e:
        return Response(url="file://" + path, error_message=f"Network error: {e}")


def _synthetic(request: Request) -> Response:
    """``synthetic://``: a TIFF whose samples are x + 1000 y at pixel centres, for tests and dry runs."""
    x0, y0, x1, y1 = request.bbox
    xs = x0 + (np.arange(request.width) + 0.5) * ((x1 - x0) / request.width)
    ys = y1 - (np.arange(request.height) + 0.5) * ((y1 - y0) / request.height)
    return Response(encode_tiff((xs[None, :] + 1000 * ys[:, None]).astype(np.float32)), "image/tiff", 200, {}, request.url, True)


TRANSPORTS: dict[str, Transport] = {"http": _http, "https": _http, "file": _file, "synthetic": _synthetic}


def fetch(request: Request, transport: Transport | None = None) -> Response:
    """The first success of at most ``retries + 1`` attempts, else the last failure.

    A success whose body is an XML report where an image was asked for counts as a failure, so it
    is neither cached nor handed to a decoder.
    """
    if not request.url:
        raise InvalidRequestError("a URL is needed")
    if not request.params:
        raise InvalidRequestError("request parameters are needed")
    scheme = urllib.parse.urlparse(request.url).scheme
    if transport is None and scheme not in TRANSPORTS:
        raise InvalidRequestError(f"no transport for {scheme!r}")
    send = transport or TRANSPORTS[scheme]
    got = Response(url=request.url, error_message="no attempt was made")
    for attempt in range(max(0, request.retries) + 1):
        if attempt and request.backoff:
            time.sleep(min(30.0, request.backoff * math.pow(2, attempt - 1)))
        got = send(request)
        if got.success and (request.output_format or "").startswith("image/") and "xml" in got.content_type.lower():
            return Response(b"", got.content_type, got.status_code, got.headers, got.url, False, got.data[:200].decode("utf-8", "replace"))
        if got.success:
            return got
    return got
