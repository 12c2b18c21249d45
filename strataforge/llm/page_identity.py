"""Which URLs name one page: a canonical spelling that keeps only what chooses the content."""

from __future__ import annotations

import posixpath
import re
from urllib.parse import parse_qsl, quote, unquote, urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Query parameters that carry tracking or session data, by name or by prefix.
TRACKING_NAMES = frozenset(
    "_ga _gl _hsenc _hsmi aff affiliate campaign_id dclid fbclid from gbraid gclid gclsrc igshid jsessionid li_fat_id mc_cid mc_eid mkt_tok msclkid "
    "phpsessid ref ref_src referer referrer s_cid session session_id sessionid sid source spm trk twclid utm wbraid yclid zanpid".split()
)
TRACKING_PREFIXES = ("utm_", "mtm_", "pk_", "piwik_", "hsa_", "oly_", "vero_")
#: Default ports and index files.
DEFAULT_PORTS = {"http": "80", "https": "443"}
INDEX_FILE = re.compile(r"/(?:index|default)\.(?:html?|php|aspx?|jsp)$", re.I)
_SESSION_PART = re.compile(r";(?:jsessionid|phpsessid|sid)=[^/?#]*", re.I)
_SAFE = "-._~!$'()*,;:@+"


def _path(raw: str) -> str:
    """Escapes decoded where they need not be escaped, dot segments and doubled slashes removed, no index file or last slash."""
    p = _SESSION_PART.sub("", raw)
    p = "/".join(quote(unquote(x), safe=_SAFE) for x in re.sub(r"/{2,}", "/", p).split("/"))
    p = posixpath.normpath(p) if p else "/"
    p = re.sub(r"^//", "/", p)
    p = INDEX_FILE.sub("", p if p.startswith("/") else "/" + p)
    return p.rstrip("/") or "/"


def _query(raw: str) -> str:
    kept = [(k, v) for k, v in parse_qsl(raw, keep_blank_values=True) if k.lower() not in TRACKING_NAMES and not k.lower().startswith(TRACKING_PREFIXES)]
    return "&".join(f"{quote(k, safe=_SAFE)}={quote(v, safe=_SAFE + '/')}" for k, v in sorted(set(kept)))


def canonical_url(url: str | None) -> str | None:
    """The canonical spelling; None for null, blank or unparsable input.

    Scheme and host letter case, http or https, default ports, user data, escapes, `//`, dot segments, index files, a last slash,
    session and tracking parameters and the order of the others do not count. A fragment counts only as a route (`#/`).
    """
    if not url or not url.strip():
        return None
    try:
        s = urlsplit(url.strip())
        host, port, scheme = (s.hostname or "").rstrip("."), s.port, s.scheme.lower()
    except ValueError:
        return None
    if not scheme:
        return None
    keep = "" if port is None or str(port) in (DEFAULT_PORTS.get(scheme), "80", "443") else f":{port}"
    out = ("web" if scheme in DEFAULT_PORTS else scheme) + "://" + host + keep + _path(s.path)
    if q := _query(s.query):
        out += "?" + q
    if s.fragment.startswith(("/", "!/")):
        route, _, tail = s.fragment.lstrip("!").partition("?")
        route = route.partition("#")[0]
        out += "#" + _path(route) + ("?" + q if (q := _query(tail)) else "")
    return out


@F.pandas_udf(T.StringType())
def _canonical(urls: pd.Series) -> pd.Series:
    memo: dict[str, str | None] = {}
    return urls.map(lambda u: memo[u] if u in memo else memo.setdefault(u, canonical_url(u)), na_action="ignore")


def canonical_url_column(url: Column | str) -> Column:
    return _canonical(url)


def same_page_hits(hits: DataFrame, hit_id: str, query_id: str, url: str) -> DataFrame:
    """(id_a, id_b), id_a < id_b: hits of one query whose URLs differ in spelling but name one page.

    Null or unparsable URLs and null queries pair with nothing; re-delivered hits count once; hits with the same spelling make no pair; other
    columns are ignored. The join key is query and page, so its groups are the pairs that come out.
    """
    h = hits.select(F.col(hit_id).cast("bigint").alias("id"), F.col(query_id).alias("q"), F.col(url).alias("url")).where("id is not null and q is not null and url is not null").dropDuplicates(["id"])
    h = h.withColumn("page", _canonical("url")).where(F.col("page").isNotNull())
    x, y = h.alias("x"), h.alias("y")
    on = (F.col("x.q") == F.col("y.q")) & (F.col("x.page") == F.col("y.page")) & (F.col("x.id") < F.col("y.id")) & (F.col("x.url") != F.col("y.url"))
    return x.join(y, on).select(F.col("x.id").alias("id_a"), F.col("y.id").alias("id_b"))
