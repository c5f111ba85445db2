"""Which images of an HTML page may be taken, and under what names; nothing is fetched here."""

from __future__ import annotations

import ipaddress

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values
MAX_BYTES, MAX_EM, PIXELS_PER_EM = 8 << 20, 38.0, 16
# ----


def _own_network(host: str) -> bool:
    name = host.lower().strip(".")
    if name == "localhost" or name.endswith(".localhost"):
        return True
    try:
        ip = ipaddress.ip_address(host)
    except ValueError:
        return False
    return ip.is_private or ip.is_loopback or ip.is_link_local or ip.is_multicast or ip.is_reserved


def _own_networks(hosts: pa.Array) -> pa.Array:
    return pa.array([x.is_valid and _own_network(x.as_py()) for x in hosts], pa.bool_())


def is_own_network(host: Column) -> Column:
    """Whether a host is this machine or inside a private, link-local, multicast or reserved range; names are not looked up."""
    return F.arrow_udf(_own_networks, "boolean")(host)


def inside(path: Column, root: Column) -> Column:
    """Whether a path, once its dots are resolved, stays under root."""
    step = lambda kept, x: F.when(x == "..", F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0)))).otherwise(F.concat(kept, F.array(x)))
    parts = F.filter(F.split(path, "/"), lambda x: (x != "") & (x != "."))
    plain = F.concat(F.lit("/"), F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/"))
    top = F.regexp_replace(root, "/+$", "")
    return (plain == top) | plain.startswith(F.concat(top, F.lit("/")))


def image_decision(src: Column, root: Column, *, network: bool = False, private: bool = False, outside: bool = False) -> Column:
    """Why an image's source is passed over, null if it may be taken.

    Files only under root unless `outside`; the network only with `network`, and hosts of its own only with `private`; data URLs only
    if they hold an image.  Other schemes are passed over; sources without a scheme lie under root if they don't climb out of it.
    """
    scheme = F.lower(F.regexp_extract(src, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    rest = F.regexp_extract(src, r"^[A-Za-z]+://[^/]*(/[^?#]*)", 1)
    host = F.regexp_replace(F.regexp_extract(src, r"^[A-Za-z]+://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/:?#]*)", 1), r"[\[\]]", "")
    local = F.concat(root, F.lit("/"), F.regexp_extract(src, "^[^?#]*", 0))
    return (
        F.when(F.coalesce(F.trim(src), F.lit("")) == "", "empty")
        .when(scheme == "data", F.when(~src.rlike("(?i)^data:image/"), "not_an_image"))
        .when(scheme == "file", F.when(~F.lit(outside) & ~inside(rest, root), "outside_the_page"))
        .when(scheme.isin("http", "https"), F.when(~F.lit(network), "network_disabled").when(~F.lit(private) & is_own_network(host), "disallowed_host"))
        .when(scheme != "", "unsupported_scheme")
        .when(src.startswith("/") | ~inside(local, root), "outside_the_page")
    )


def stored_name(content: Column, extension: Column) -> Column:
    """The name of an image's copy, null for one of no or too many bytes."""
    size = F.octet_length(content)
    return F.when((size > 0) & (size <= MAX_BYTES), F.concat(F.lit("img_"), F.left(F.sha2(content, 256), F.lit(16)), extension))


def width_em(pixels: Column) -> Column:
    return F.coalesce(F.round(F.least(pixels / PIXELS_PER_EM, F.lit(MAX_EM)), 1), F.lit(MAX_EM))
