"""Relative address resolution (RFC 3986) as a column expression."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from noticeloom.functions.text import let

_SCHEME = r"^([A-Za-z][A-Za-z0-9+.\-]*):"
# scheme, authority with slashes, path, query, fragment
_PARTS = r"^(?s)(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(//[^/?#]*)?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def _parts(url: Column) -> Column:
    names = ("scheme", "auth", "path", "query", "frag")
    return F.struct(*[F.regexp_extract(url, _PARTS, i + 1).alias(n) for i, n in enumerate(names)])


def _folded(path: Column) -> Column:
    """Path without ``.`` and ``..`` segments."""
    def fold(segments: Column) -> Column:
        kept = F.aggregate(
            segments,
            F.array().cast("array<string>"),
            lambda acc, s: F.when(
                s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))
            ).when(s == ".", acc).otherwise(F.concat(acc, F.array(s))),
        )
        tail = F.when(F.element_at(segments, -1).isin(".", ".."), F.array(F.lit("")))
        return F.array_join(F.concat(kept, F.coalesce(tail, F.array().cast("array<string>"))), "/")

    plain = ~path.rlike(r"(^|/)\.\.?(/|$)")
    return F.when(plain, path).otherwise(let(F.split(path, "/", -1), fold))


def _build(u: Column) -> Column:
    path = F.when((u["auth"] == "") | (u["path"] == "") | u["path"].startswith("/"), u["path"]) \
        .otherwise(F.concat(F.lit("/"), u["path"]))
    return F.concat(
        F.when(u["scheme"] != "", F.concat(u["scheme"], F.lit(":"))).otherwise(""),
        u["auth"],
        path,
        F.when(u["query"] != "", F.concat(F.lit("?"), u["query"])).otherwise(""),
        F.when(u["frag"] != "", F.concat(F.lit("#"), u["frag"])).otherwise(""),
    )


# A path or a query, with what may follow it, that needs no cleaning and no folding ...
_PLAIN_HREF = (
    r"(?s)^(?![\x00-\x20]|//|[A-Za-z][A-Za-z0-9+.\-]*:|(?:[^?#]*/)?\.\.?(?:[/?#]|\z)|[^?#]*//)"
    r"(?:[^?#\t\r\n]+(?:\?[^#\t\r\n]+)?|\?[^#\t\r\n]+)(?:#[^\t\r\n]+)?\z")
# ... and a base with a host, on whose path it can be put as it is.
_PLAIN_BASE = (
    r"(?s)^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//[^/?#]+"
    r"(?!(?:[^?#]*/)?\.\.?(?:[/?#]|\z)|[^?#]*//)(?:/[^?#]*)?(?:[?#]|\z)")
_ROOT = r"^(?:[^/?#]*:)?//[^/?#]+"


def _put_on(base: Column, href: Column) -> Column:
    """A plain ``href`` on a plain ``base``: most links, without taking both apart."""
    path = F.substring_index(F.substring_index(base, "#", 1), "?", 1)
    folder = F.regexp_extract(base, _ROOT + r"(?:/(?:[^?#]*/)?)?", 0)
    return (
        F.when(href.startswith("/"), F.concat(F.regexp_extract(base, _ROOT, 0), href))
        .when(href.startswith("?"), F.concat(path, href))
        .when(folder.endswith("/"), F.concat(folder, href))
        .otherwise(F.concat(folder, F.lit("/"), href))
    )


def resolve_url(base: Column, href: Column) -> Column:
    """Absolute address of ``href`` found on the page at ``base``."""
    return F.when(href.rlike(_PLAIN_HREF) & base.rlike(_PLAIN_BASE), _put_on(base, href)).otherwise(
        _resolved(base, href))


def _resolved(base: Column, href: Column) -> Column:
    # Leading blanks and inner line breaks are not part of an address.
    clean = F.regexp_replace(href, r"^[\x00-\x20]+|[\t\r\n]", "")

    def join(v: Column) -> Column:
        b, h = v["b"], v["h"]
        folder = F.regexp_replace(b["path"], "[^/]*$", "")
        # Empty inner segments vanish when a relative path is merged.
        merged = F.regexp_replace(
            F.concat(F.when(folder == "", F.lit("/")).otherwise(folder), h["path"]),
            "(?<=/)/+", "")
        target = F.when(h["path"].startswith("/"), h["path"]).otherwise(merged)
        own_auth = F.length(h["auth"]) > 2
        same_path = h["path"] == ""
        path = (
            F.when(own_auth, h["path"])
            .when(same_path, b["path"])
            .otherwise(let(target, lambda t: let(
                _folded(t), lambda f: F.when(f == "", F.lit("/")).otherwise(f))))
        )
        query = F.when(same_path & ~own_auth & (h["query"] == ""), b["query"]).otherwise(h["query"])
        auth = F.when(own_auth, h["auth"]).otherwise(b["auth"])
        whole = F.struct(b["scheme"].alias("scheme"), auth.alias("auth"), path.alias("path"),
                         query.alias("query"), h["frag"].alias("frag"))
        return let(whole, _build)

    scheme = F.lower(F.regexp_extract(clean, _SCHEME, 1))
    own = (scheme != "") & (scheme != F.lower(F.regexp_extract(base, _SCHEME, 1)))
    return (
        F.when(href == "", base)
        .when(own, href)
        .otherwise(let(F.struct(_parts(base).alias("b"), _parts(clean).alias("h")), join))
    )
