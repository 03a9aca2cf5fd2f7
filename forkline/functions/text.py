"""Scalar functions over names, labels, paths and snippets, as Spark column expressions (no Python per row)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEPARATOR = "\x1f"
# Languages by file suffix.
LANGUAGES = {
    "py": "python", "js": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "html": "html", "css": "css",
    "json": "json", "md": "markdown", "yml": "yaml", "yaml": "yaml", "toml": "toml", "sql": "sql",
}
# Types of routes' path converters.
HTTP_STATUS = {
    "HttpResponse": "200", "JsonResponse": "200", "HttpResponseRedirect": "302", "HttpResponsePermanentRedirect": "301", "HttpResponseNotModified": "304",
    "HttpResponseBadRequest": "400", "HttpResponseForbidden": "403", "HttpResponseNotFound": "404", "HttpResponseNotAllowed": "405", "HttpResponseGone": "410", "HttpResponseServerError": "500",
}


def module_fqn(path: Column) -> Column:
    """Dotted module name of a ``.py`` path."""
    return F.translate(F.regexp_replace(path, r"\.py$", ""), "/", ".")


def package_of(path: Column) -> Column:
    """Dotted name of the path's directory; empty at the top."""
    return F.when(F.instr(path, "/") > 0, F.translate(F.regexp_replace(path, r"/[^/]*$", ""), "/", ".")).otherwise(F.lit(""))


def split_segments(path: Column) -> Column:
    """Non-empty parts of a path."""
    return F.filter(F.split(path, "/"), lambda s: s != "")


def normalize_out_path(url: Column) -> Column:
    """Segments of a rooted path without query or fragment; null for absolute urls and relative paths."""
    bare = F.regexp_replace(url, r"[?#].*$", "")
    return F.when(url.contains("://") | ~F.startswith(url, F.lit("/")), None).otherwise(split_segments(bare))


def is_placeholder(segment: Column) -> Column:
    return segment.rlike(r"^\{.*\}$")


def sql_table(statement: Column) -> Column:
    """Table named first after FROM, INTO or UPDATE; empty if none is."""
    return F.regexp_extract(statement, r"(?i)(?:FROM|INTO|UPDATE)\s+(\w+)", 1)


def title_words(words: Column) -> Column:
    """First letter of each word upper-case, the rest as it is."""
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.substr(w, F.lit(2)))), " ")


def humanize(name: Column) -> Column:
    """Last dotted segment, split at underscores and case changes, each word capitalised."""
    last = F.element_at(F.split(name, r"\."), -1)
    spaced = F.regexp_replace(F.regexp_replace(last, r"([a-z0-9])([A-Z])", "$1 $2"), r"_+", " ")
    return title_words(F.filter(F.split(spaced, r"\s+"), lambda w: w != ""))


def handler_name(name: Column) -> Column:
    """Words split at underscores and blanks, lower-case, as a sentence."""
    words = F.lower(F.array_join(F.filter(F.split(name, r"[_\s]+"), lambda w: w != ""), " "))
    return F.concat(F.upper(F.left(words, F.lit(1))), F.substr(words, F.lit(2)))


def route_method(label: Column) -> Column:
    return F.regexp_extract(label, r"^([A-Z]+) (/\S*)$", 1)


def route_path(label: Column) -> Column:
    return F.regexp_extract(label, r"^([A-Z]+) (/\S*)$", 2)


def path_params(path: Column) -> Column:
    """Ordered distinct names of ``{x}``, ``{x:conv}`` and ``<conv:x>`` segments."""
    braces = F.regexp_replace(F.regexp_replace(path, r"<(?:\w+:)?(\w+)>", "{$1}"), r"\{(\w+):\w+\}", "{$1}")
    return F.array_distinct(F.regexp_extract_all(braces, F.lit(r"\{(\w+)\}"), F.lit(1)))


def openapi_path(path: Column) -> Column:
    return F.regexp_replace(path, r"<(?:\w+:)?(\w+)>", "{$1}")


def catalog_label(label: Column) -> Column:
    """Label without a trailing count of routes."""
    return F.regexp_replace(label, r" · \d+ routes?.*$", "")


def clamp(text: Column, most: int = 48) -> Column:
    """At most ``most`` characters, the last an ellipsis if something was cut."""
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most - 1)), F.lit("…"))).otherwise(text)


def word_clamp(text: Column, most: int) -> Column:
    return F.array_join(F.slice(F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != ""), 1, most), " ")


def step_label(label: Column) -> Column:
    """Call text without arguments and receiver, underscores as spaces."""
    bare = F.regexp_replace(label, r"\(.*$", "")
    return F.trim(F.regexp_replace(F.element_at(F.split(bare, r"\."), -1), "_+", " "))


def noise_rule(call: Column) -> Column:
    """Name of the rule that makes a call noise, or null."""
    root = F.lower(F.element_at(F.split(call, r"\."), 1))
    last = F.element_at(F.split(call, r"\."), -1)
    return (
        F.when(root.isin("logging", "logger", "log") | (root == "ext:logging"), "logging")
        .when(last == "print", "print")
        .when(last.isin("gettext", "gettext_lazy", "ngettext", "_"), "gettext")
        .when(last.isin("str", "int", "float", "bool", "list", "dict", "set", "tuple", "len", "repr", "isinstance"), "conversion")
    )


def language_of(path: Column) -> Column:
    """Language by suffix; the suffix itself if unknown, ``text`` without one."""
    suffix = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    known = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.coalesce(F.element_at(known, suffix), F.when(suffix == "", "text").otherwise(suffix))


def http_status(target: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in HTTP_STATUS.items() for x in kv])
    explicit = F.regexp_extract(target, r"status(?:_code)?\s*=\s*(\d{3})", 1)
    return F.coalesce(F.when(explicit != "", explicit), F.element_at(known, F.regexp_extract(target, r"(\w+)\s*(?:\(|$)", 1)))


def depth_scale(depth: Column) -> Column:
    return F.greatest(F.lit(0.82), F.round(F.pow(F.lit(0.9), depth), 3))


def fingerprint(*parts: Column) -> Column:
    """SHA-256 of the parts, null as empty, with a separator between."""
    return F.sha2(F.concat_ws(SEPARATOR, *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def source_slice(text: Column, start: Column, most: int) -> Column:
    """Lines ``start`` (from 1) and up to ``most`` in all."""
    lines = F.split(text, "\n")
    return F.when(start <= F.size(lines), F.array_join(F.slice(lines, start, most), "\n")).otherwise(F.lit(""))


def path_prefixes(path: Column) -> Column:
    """``a``, ``a/b``, ``a/b/c`` of ``a/b/c``."""
    parts = split_segments(path)
    return F.transform(F.when(F.size(parts) > 0, F.sequence(F.lit(1), F.size(parts))).otherwise(F.array().cast("array<int>")), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def etag(*parts: Column) -> Column:
    return F.concat(F.lit('W/"'), F.sha1(F.to_json(F.struct(*parts))), F.lit('"'))
