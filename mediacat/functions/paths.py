"""Path arithmetic on string columns ("/" separated, as the catalogue stores them)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from mediacat.functions.constants import SKIP_DIRS, VIDEO_EXTENSIONS


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent(path: Column) -> Column:
    """Folder of a path; the root stays the root."""
    cut = F.regexp_replace(path, "/[^/]*$", "")
    return F.when((cut == "") & path.startswith("/"), F.lit("/")).otherwise(cut)


def suffix(name: Column) -> Column:
    """Extension without its dot; '' for dot-files and names ending in a dot."""
    last = F.substring_index(name, ".", -1)
    # The dot must neither be missing nor come first.
    return F.when(F.length(name) - F.length(last) >= 2, last).otherwise(F.lit(""))


def stem(name: Column) -> Column:
    ext = suffix(name)
    cut = F.length(name) - F.length(ext) - 1
    return F.when(ext != "", F.substr(name, F.lit(1), cut)).otherwise(name)


def with_suffix(path: Column, extension: Column) -> Column:
    """Swap the extension of the last path part, or append one."""
    ext = suffix(file_name(path))
    cut = F.length(path) - F.length(ext) - 1
    bare = F.when(ext != "", F.substr(path, F.lit(1), cut)).otherwise(path)
    return F.concat(bare, F.lit("."), extension)


# Each test reads its path once: a path that is itself computed is not computed again.
_VIDEO = rf"(?s)^[^.].*\.(?:{'|'.join(VIDEO_EXTENSIONS)})\z"
_SKIPPED = rf"(?:^|/)(?:{'|'.join(re.escape(d) for d in SKIP_DIRS)})(?:/|\z)"


def is_video(path: Column) -> Column:
    """A known extension, and a name that does not begin with a dot."""
    return F.lower(file_name(path)).rlike(_VIDEO)


def in_skip_dir(path: Column) -> Column:
    return F.lower(path).rlike(_SKIPPED)


def unify_slashes(path: Column) -> Column:
    """One separator style, no trailing separator; NULL becomes ''."""
    return F.rtrim(F.translate(F.coalesce(path, F.lit("")), "\\", "/"), F.lit("/"))


def depth(path: Column) -> Column:
    return F.size(F.split(path, "/"))


def ancestor_at(path: Column, level: int) -> Column:
    """Leading `level` parts of a path, NULL where the path is not deeper than that."""
    head = F.substring_index(path, "/", level)
    return F.when(F.length(head) < F.length(path), head)


def map_prefix(path: Column, mounts: Column, source: str, target: str) -> Column:
    """Path moved from one side of the first matching mount to the other, NULL if none matches.

    A mount matches only where its prefix is followed by a separator.
    """
    normal = unify_slashes(path)
    pairs = F.transform(
        F.coalesce(mounts, F.array().cast("array<struct<server:string,local:string>>")),
        lambda m: F.struct(
            unify_slashes(m[source]).alias("from"), unify_slashes(m[target]).alias("to")
        ),
    )
    hits = F.filter(
        pairs,
        lambda m: (m["from"] != "") & normal.startswith(F.concat(m["from"], F.lit("/"))),
    )
    first = F.try_element_at(hits, F.lit(1))
    return F.concat(first["to"], F.substr(normal, F.length(first["from"]) + 1))


def resolve_path(path: Column, mounts: Column) -> Column:
    """struct(transport, node_path): where a node would read this server path."""
    local = map_prefix(path, mounts, "server", "local")
    return F.struct(
        F.when(local.isNotNull(), F.lit("local")).otherwise(F.lit("stream")).alias("transport"),
        F.coalesce(local, path).alias("node_path"),
    )


def reverse_path(node_path: Column, mounts: Column) -> Column:
    """A node's local path in server space; unchanged where no mount matches."""
    server = map_prefix(node_path, mounts, "local", "server")
    return F.when(F.coalesce(node_path, F.lit("")) == "", node_path).otherwise(
        F.coalesce(server, node_path)
    )


def originals_dir(
    name: Column, watch_path: Column, output_path: Column, originals_path: Column
) -> Column:
    """Folder that holds a library's archived sources."""
    chosen = F.trim(F.coalesce(originals_path, F.lit("")))
    output = F.coalesce(output_path, F.lit(""))
    return (
        F.when(chosen != "", join(chosen, name))
        .when(output != "", join(join(parent(_folder(output)), F.lit("Originals")), name))
        .otherwise(join(watch_path, F.lit("Originals")))
    )


def _folder(path: Column) -> Column:
    """Drop trailing separators, except from the root itself."""
    return F.regexp_replace(path, "(.)/+$", "$1")


def join(left: Column, right: Column) -> Column:
    """left/right without doubling the separator."""
    return F.concat(F.regexp_replace(left, "/+$", ""), F.lit("/"), right)


def relative_to(path: Column, root: Column) -> Column:
    """Part of a path below a root, NULL when the path is not below it."""
    base = F.concat(F.regexp_replace(root, "/+$", ""), F.lit("/"))
    return F.when(path.startswith(base), F.substr(path, F.length(base) + 1))
