"""URLs: resolution against a base, parts, and item names.

Resolution covers absolute URIs, and relative ones (``//host``, ``/path``, ``path``,
``?query``, ``#fragment``, empty) against a hierarchical base, with dot segments
removed. :func:`normalised` then gives the form that the URL standard writes, for URLs of
the schemes that have a host: scheme and host in lower case, no default port, back slashes
as slashes, dot segments also where dots are escaped, an empty path as ``/``, and characters
that a part may not hold as escapes. Other URLs stay as they are. Left out: internationalised
hosts (a host that is not ASCII is kept), and numbers as hosts.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from segmentry.functions.binary import once

SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:"
# The schemes with a host, and their default ports.
PORTS = {"http": "80", "https": "443", "ws": "80", "wss": "443", "ftp": "21"}
#: What most URLs look like, in their normal form already.
PLAIN = r"^https?://[a-z0-9.-]+(?:/(?!\.|%2)[A-Za-z0-9_~!$&()*+,;=:@.-]*)+(?:\?[A-Za-z0-9_~!$&()*+,;=:@/?.-]+)?$"
# ASCII characters that are escaped in each part, beside controls and DEL.
ESCAPED = {"path": ' "#<>?^`{}', "query": " \"#<>'", "fragment": ' "<>`'}


def escaped(text: Column, part: str) -> Column:
    """``text`` with what may not stand in a part of a URL as percent escapes of its UTF-8."""
    held = "".join(f"\\x{ord(c):02X}" for c in ESCAPED[part])
    unsafe = rf"[\x00-\x1F\x7F{held}]|[^\x00-\x7F]"

    def escape(c: Column) -> Column:
        pairs = F.regexp_replace(F.hex(F.encode(c, "UTF-8")), "(..)", "%$1")
        return F.when(c.rlike(unsafe), pairs).otherwise(c)

    # Runs of what needs no escape stay together, so a plain text is one piece.
    pieces = F.regexp_extract_all(text, F.lit(rf"(?s)(?:{unsafe})|(?:(?!{unsafe}).)+"), F.lit(0))
    return F.when(text.rlike(unsafe), F.array_join(F.transform(pieces, escape), "")).otherwise(text)


def normalised(url: Column) -> Column:
    """An absolute URL as the URL standard writes it; null where a host is missing or a port is
    no number up to 65535."""
    return F.when(url.rlike(PLAIN), url).otherwise(once(url, _normal_form))


def _normal_form(url: Column) -> Column:
    """:func:`normalised` of a URL that has been computed; each part is computed once too."""
    clean = F.regexp_replace(F.regexp_replace(url, r"[\t\n\r]", ""), r"^[\x00-\x20]+|[\x00-\x20]+$", "")
    ports = F.create_map(*(F.lit(x) for pair in PORTS.items() for x in pair))

    def split(x: Column) -> Column:
        # Of these schemes any number of slashes, either way, leads to the host.
        rest = F.regexp_extract(x, r"^[A-Za-z][A-Za-z0-9+.-]*:[/\\]*(.*)$", 1)
        scheme = F.lower(F.regexp_extract(x, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
        return once(F.struct(x.alias("clean"), scheme.alias("scheme"), rest.alias("rest")), placed)

    def placed(x: Column) -> Column:
        place = F.regexp_extract(x["rest"], r"^([^/\\?#]*)", 1)
        server = F.regexp_replace(place, r"^.*@", "")
        port = F.regexp_extract(server, r"^(?:\[[^\]]*\]|[^:\[]*):(.*)$", 1)
        path = F.translate(F.regexp_extract(x["rest"], r"^[^/\\?#]*([^?#]*)", 1), "\\", "/")
        parts = F.struct(
            x["clean"], x["scheme"], F.regexp_extract(place, r"^(.*@)", 1).alias("login"),
            F.lower(F.regexp_extract(server, r"^(\[[^\]]*\]|[^:\[]*)", 1)).alias("host"),
            F.when(port == "", "").when(port.rlike("^[0-9]+$"), F.regexp_replace(port, "^0+(?=[0-9])", "")).otherwise("bad").alias("port"),
            F.concat(F.lit("/"), F.regexp_replace(path, "^/", "")).alias("path"),
            F.regexp_extract(x["rest"], r"^[^?#]*\?([^#]*)", 1).alias("query"),
            F.regexp_extract(x["rest"], r"^[^#]*#(.*)$", 1).alias("fragment"),
        )
        return F.when(~x["scheme"].isin(*PORTS), x["clean"]).otherwise(once(parts, joined))

    def joined(x: Column) -> Column:
        port = x["port"]
        bad_port = (port == "bad") | (F.length(port) > 5) | (port.try_cast("int") > 65535)
        own_port = F.when((port == "") | (port == F.try_element_at(ports, x["scheme"])), "").otherwise(F.concat(F.lit(":"), port))
        dotted = F.regexp_replace(
            F.regexp_replace(x["path"], r"(?i)(?<=/)(\.%2e|%2e\.|%2e%2e)(?=/|$)", ".."), r"(?i)(?<=/)%2e(?=/|$)", "."
        )

        def tail(mark: str, part: str) -> Column:
            return F.when(x[part] == "", "").otherwise(F.concat(F.lit(mark), escaped(x[part], part)))

        path = once(once(dotted, _without_dots), lambda p: escaped(p, "path"))
        whole = F.concat(
            x["scheme"], F.lit("://"), x["login"], x["host"], own_port, path, tail("?", "query"), tail("#", "fragment")
        )
        return F.when((x["host"] == "") | F.coalesce(bad_port, F.lit(False)), None).otherwise(whole)

    return once(clean, split)


def _without_dots(path: Column) -> Column:
    parts = F.split(path, "/")
    none = F.array().cast("array<string>")
    kept = F.aggregate(
        parts,
        none,
        lambda found, x: F.when(x == "..", F.slice(found, 1, F.greatest(F.size(found) - 1, F.lit(1))))
        .when(x == ".", found)
        .otherwise(F.concat(found, F.array(x))),
    )
    # A path that ends in a dot segment names a directory.
    slash = F.when(F.element_at(parts, -1).isin(".", ".."), F.lit("/")).otherwise(F.lit(""))
    return F.concat(F.array_join(kept, "/"), slash)


def absolute(base: Column, uri: Column) -> Column:
    """``uri`` against its base in normal form, null where that cannot be."""
    return once(resolve(base, uri), normalised)


def resolve(base: Column, uri: Column) -> Column:
    """Absolute form of ``uri``, null where it is relative and the base cannot serve."""
    origin = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    scheme = F.regexp_extract(base, SCHEME, 0)
    path = F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    own_path = F.regexp_extract(uri, r"^([^?#]*)", 1)
    tail = F.regexp_extract(uri, r"^[^?#]*(.*)$", 1)
    folder = F.regexp_extract(path, r"^(.*/)", 1)
    folder = F.when(folder == "", F.lit("/")).otherwise(folder)
    return (
        F.when(uri.rlike(SCHEME), uri)
        .when(base.isNull() | (origin == ""), F.lit(None).cast("string"))
        .when(uri.startswith("//"), F.concat(scheme, uri))
        .when((uri == "") | uri.startswith("#"), F.concat(F.regexp_extract(base, r"^[^#]*", 0), uri))
        .when(uri.startswith("?"), F.concat(origin, path, uri))
        .when(uri.startswith("/"), F.concat(origin, _without_dots(own_path), tail))
        .otherwise(F.concat(origin, _without_dots(F.concat(folder, own_path)), tail))
    )


def protocol(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))


def key_kind(url: Column) -> Column:
    """``http``, ``inline`` for data URIs, or ``external``."""
    return (
        F.when(protocol(url).isin("http", "https"), F.lit("http"))
        .when(protocol(url) == "data", F.lit("inline"))
        .otherwise(F.lit("external"))
    )


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def authority(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)


def item_name(index: Column, url: Column) -> Column:
    """Six-digit index, ``_``, and the last 238 characters of the last path part."""
    digits = index.cast("string")
    padded = F.when(F.length(digits) < 6, F.lpad(digits, 6, "0")).otherwise(digits)
    last = F.element_at(F.split(url_path(url), "/"), -1)
    return F.concat(padded, F.lit("_"), F.right(last, F.lit(238)))


def site_item_name(url: Column) -> Column:
    """The sequence part of a ``/NUMBER/goap`` path, null where there is none."""
    return F.nullif(F.regexp_extract(url, r"/(\d+?)/goap", 1), F.lit(""))


def range_header(offset: Column, length: Column) -> Column:
    return F.concat(F.lit("bytes="), offset, F.lit("-"), offset + length - 1)
