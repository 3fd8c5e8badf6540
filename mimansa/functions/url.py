"""URL canonicalisation: an exact Arrow function for everything a query string may hold."""

from __future__ import annotations

import re
from urllib.parse import parse_qsl, urlencode, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Query parameters that only track, and the ports that go without saying.
TRACKING = frozenset(
    [
        "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "utm_id", "fbclid", "gclid", "msclkid", "ref", "ref_src", "ref_url", "fb_action_ids", "fb_action_types", "mc_eid", "_hsenc", "_hsmi",
    ]
)
PORTS = {"http": ":80", "https": ":443"}


def canonical_url(url: str | None, tracking: frozenset[str] = TRACKING) -> str:
    """Scheme and host in lower case, no default port, single slashes and no last one, parameters sorted, no fragment.

    Null is the empty text; an address without a host comes back trimmed; one that cannot be read does too.
    """
    if not isinstance(url, str) or not url:
        return ""
    try:
        parts = urlsplit(url.strip())
    except ValueError:
        return url.strip()
    if not parts.netloc:
        return url.strip()
    scheme = parts.scheme.lower() or "http"
    host = parts.netloc.lower().removesuffix(PORTS.get(scheme, " "))
    path = re.sub("/+", "/", parts.path) or "/"
    path = path.rstrip("/") or "/"
    query = sorted(kv for kv in parse_qsl(parts.query, keep_blank_values=True) if kv[0].lower() not in tracking)
    return urlunsplit((scheme, host, path, urlencode(query), ""))


@F.pandas_udf(T.StringType())
def canonical_url_udf(urls: pd.Series) -> pd.Series:
    return urls.map(canonical_url)
