"""Local files, and predicates about where documents may come from."""

from __future__ import annotations

import ipaddress
import os
from urllib.parse import unquote, urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Supported extensions and their media types.
MEDIA_TYPES = {
    "txt": "text/plain", "text": "text/plain", "md": "text/markdown", "markdown": "text/markdown", "html": "text/html", "htm": "text/html",
    "pdf": "application/pdf", "epub": "application/epub+zip", "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "json": "application/json", "yaml": "application/yaml", "yml": "application/yaml",
}


class BlockedSource(ValueError):
    """A source outside the allowed roots."""


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def media_type_of(path: Column) -> Column:
    types = F.create_map(*[F.lit(x) for pair in MEDIA_TYPES.items() for x in pair])
    return F.coalesce(types[extension(path)], F.lit("application/octet-stream"))


def allowed(path: str, roots: list[str]) -> str:
    """The canonical path, if it lies under one of the roots."""
    real = os.path.realpath(path)
    for root in {os.path.realpath(r) for r in roots}:
        if real == root or real.startswith(root.rstrip("/") + "/"):
            return real
    raise BlockedSource(path)


def inside(path: Column, tops: list[str]) -> Column:
    """Whether a file that a scan found really lies below one of the tops: links may lead out of them."""

    @F.pandas_udf("boolean")
    def real(paths: pd.Series) -> pd.Series:
        def below(uri: str) -> bool:
            at = os.path.realpath(unquote(urlsplit(uri).path) if uri.startswith("file:") else uri)
            return any(at == t or at.startswith(t.rstrip("/") + "/") for t in tops)

        return paths.map(below).astype(bool)

    return real(path)


def scan(spark: SparkSession, roots: list[str], path: str | None = None, recursive: bool = True, max_bytes: int | None = None) -> DataFrame:
    """Supported files below the roots, as binaryFile rows; sizes are checked before bodies are read.
    Links are followed only to places below the roots."""
    real_roots = sorted({os.path.realpath(r) for r in roots})
    tops = [allowed(path, roots)] if path else real_roots
    found = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(tops)
    found = found.where(extension(F.col("path")).isin(*MEDIA_TYPES)).where(inside(F.col("path"), real_roots))
    return found if max_bytes is None else found.where(F.col("length") <= max_bytes)


def list_documents(spark: SparkSession, roots: list[str], path: str | None = None, recursive: bool = True, max_results: int = 100) -> DataFrame:
    """path, name, media_type, size_bytes in order of path; file bodies aren't read."""
    at = scan(spark, roots, path, recursive)
    return at.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), media_type_of(F.col("path")).alias("media_type"), F.col("length").alias("size_bytes")).orderBy("path").limit(max_results)


def read(spark: SparkSession, roots: list[str], path: str | None = None, max_bytes: int = 134_217_728) -> DataFrame:
    """Files as resources(source, media_type, bytes, metadata)."""
    name = F.element_at(F.split("path", "/"), -1)
    stem = F.regexp_replace(name, r"\.[^.]+$", "")
    at = scan(spark, roots, path, max_bytes=max_bytes)
    return at.select(F.col("path").alias("source"), media_type_of(F.col("path")).alias("media_type"), F.col("content").alias("bytes"), F.create_map(F.lit("file_name"), name, F.lit("file_stem"), stem).alias("metadata"))


def is_http(source: Column) -> Column:
    return F.lower(F.trim(source)).rlike("^https?://")


# Media types that a fetch may return, besides those of files.
FETCHED = ("text/plain", "text/markdown", "text/html", "application/xhtml+xml", "application/pdf", "application/epub+zip", "application/json", "application/yaml", "application/x-yaml", "text/yaml", "application/vnd.oai.openapi", "application/vnd.oai.openapi+json", "application/vnd.openxmlformats-officedocument.wordprocessingml.document")


def bare_media_type(name: Column) -> Column:
    """A media type without its parameters, in lower case."""
    return F.lower(F.trim(F.substring_index(name, ";", 1)))


def media_type_of_url(url: Column, declared: Column | None = None) -> Column:
    """The media type of what a URL names: the declared one where it says anything, else by the suffix of
    the URL's path; null where neither is known."""
    path = F.regexp_extract(F.regexp_replace(url, r"[?#].*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/]*(/.*)?$", 1)
    types = F.create_map(*[F.lit(x) for pair in MEDIA_TYPES.items() for x in pair])
    by_suffix = types[extension(path)]
    if declared is None:
        return by_suffix
    said = bare_media_type(declared)
    return F.when(said.isNull() | said.isin("", "application/octet-stream", "binary/octet-stream"), by_suffix).otherwise(said)


def fetch_allowed(media_type: Column) -> Column:
    """Whether a fetched resource of this media type may be parsed."""
    return F.coalesce(bare_media_type(media_type).isin(*FETCHED), F.lit(False))


_PORT, _NAME = r"(?::\d*)?", r"[^/?#@:\[\]]*"


def host_of(url: Column) -> Column:
    """The host of an HTTP URL in lower case, without a last dot; null where there is none, and where the
    URL carries credentials."""
    at = F.lower(F.trim(url))
    host = F.regexp_replace(F.regexp_extract(at, rf"^https?://({_NAME}|\[[0-9a-f:.]+\]){_PORT}(?:[/?#]|$)", 1), r"\.$", "")
    return F.nullif(host, F.lit(""))


def _quad(host: Column) -> Column:
    """The number of a dotted IPv4 address."""
    parts = F.split(host, r"\.")
    return sum((F.get(parts, F.lit(k)).try_cast("long") * (1 << (24 - 8 * k)) for k in range(1, 4)), F.get(parts, F.lit(0)).try_cast("long") * (1 << 24))


# IPv4 networks that aren't public.
CLOSED_NETWORKS = ("0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "224.0.0.0/4", "240.0.0.0/4")


def public_host(host: Column) -> Column:
    """Whether a host may be public: no local name, no IPv4 address of a closed network, and no IPv6
    address, whose rules only is_public_address knows. Numbers that aren't four parts of 0 to 255 are
    refused: resolvers read them in several ways."""
    local = (host == "localhost") | F.expr("false")
    for tail in (".localhost", ".local", ".internal"):
        local = local | host.endswith(tail)
    numeric = host.rlike(r"^[0-9.]+$|^0x|\.0x")
    quad = host.rlike(r"^((25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(\.(?!$)|$)){4}$")
    number, closed = _quad(host), F.lit(False)
    for net in map(ipaddress.ip_network, CLOSED_NETWORKS):
        closed = closed | number.between(int(net.network_address), int(net.broadcast_address))
    return F.when(host.isNull() | host.startswith("[") | local, False).when(numeric, F.coalesce(quad & ~closed, F.lit(False))).otherwise(True)


def url_verdict(url: Column) -> Column:
    """ok, or why a URL isn't fetched: not_http, credentials, no_host or closed_host."""
    at = F.lower(F.trim(url))
    credentials = F.coalesce(F.regexp_extract(at, r"^https?://([^/?#]*)", 1).contains("@"), F.lit(False))
    return (
        F.when(~F.coalesce(is_http(url), F.lit(False)), "not_http").when(credentials, "credentials")
        .when(host_of(url).isNull(), "no_host").when(~public_host(host_of(url)), "closed_host").otherwise("ok")
    )


def host_matches(host: Column, pattern: str) -> Column:
    """`*.` stands for one label or more, not for none."""
    p = pattern.lower()
    return F.lower(host).endswith(p[1:]) if p.startswith("*.") else F.lower(host) == p


def host_allowed(host: Column, patterns: list[str]) -> Column:
    """Whether a host matches one of the patterns; no patterns allow none."""
    out = F.lit(False)
    for p in patterns:
        out = out | host_matches(host, p)
    return F.coalesce(out, F.lit(False))


def is_public_url(url: str) -> bool:
    """Whether a URL names a public HTTP host without credentials. Names that need DNS pass here;
    their addresses must be checked with is_public_address when they are resolved."""
    try:
        u = urlsplit(url.strip())
        host = (u.hostname or "").rstrip(".").lower()
    except ValueError:
        return False
    if u.scheme.lower() not in ("http", "https") or not host or u.username is not None or u.password is not None:
        return False
    if host == "localhost" or host.endswith((".localhost", ".local", ".internal")):
        return False
    try:
        return is_public_address(host)
    except ValueError:
        return True


def is_public_address(address: str) -> bool:
    ip = ipaddress.ip_address(address)
    ip = getattr(ip, "ipv4_mapped", None) or ip
    return ip.is_global and not ip.is_multicast
