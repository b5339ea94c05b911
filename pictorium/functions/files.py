"""File validation, header checks and path rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as V


def extension(path: Column) -> Column:
    """Lower-cased text after the last dot of the file name, '' when none."""
    return F.lower(F.regexp_extract(path, r"[^/\\]\.([^./\\]*)$", 1))


def supported(path: Column) -> Column:
    return extension(path).isin(V.EXTENSIONS)


def mime_for_model(ext: Column) -> Column:
    """MIME type sent along with a picture; whatever is not known counts as JPEG."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in V.MODEL_MIME.items() for x in kv]), F.lower(ext)), F.lit("image/jpeg"))


def mime_from_extension(ext: Column) -> Column:
    pairs = [F.lit(x) for kv in V.MIME_BY_EXTENSION.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.lower(ext)), F.lit("application/octet-stream"))


def magic_ok(content: Column, ext: Column) -> Column:
    """Do the first bytes fit the extension?  Reads 16 bytes, no UDF."""
    head = F.hex(F.substring(content, 1, 16))

    def fits(parts):
        return reduce(
            lambda a, b: a & b,
            [F.substring(head, 2 * off + 1, len(code)) == code for off, code in parts],
        )

    rule = None
    for name, alternatives in V.MAGIC.items():
        ok = reduce(lambda a, b: a | b, [fits(parts) for parts in alternatives])
        rule = F.when(ext == name, ok) if rule is None else rule.when(ext == name, ok)
    return (F.octet_length(content) >= 4) & rule.otherwise(F.lit(True))


def reject_reason(path: Column, size: Column, content: Column) -> Column:
    """First failing rule, NULL when the file is accepted."""
    ext = extension(path)
    mime = mime_from_extension(ext)
    return F.coalesce(
        F.when(size == 0, F.lit("empty")),
        F.when(size > V.MAX_FILE_BYTES, F.lit("too_large")),
        F.when(~ext.isin(V.EXTENSIONS), F.lit("unsupported_extension")),
        F.when(~mime.isin(V.MIME_TYPES), F.lit("unsupported_mime")),
        F.when(~magic_ok(content, ext), F.lit("magic_mismatch")),
    )


def path_issue(path: Column) -> Column:
    """First import-path rule that the path breaks, NULL when it is fine."""
    lowered = F.lower(path)
    traversal = reduce(lambda a, b: a | b, [F.contains(lowered, F.lit(p)) for p in V.ENCODED_TRAVERSAL])
    device = F.contains(lowered, F.lit("\\\\.\\")) | F.contains(lowered, F.lit("\\\\?\\"))
    return F.coalesce(
        F.when(~path.rlike(r"\S"), F.lit("blank")),
        F.when(F.octet_length(path) > V.MAX_PATH_BYTES, F.lit("too_long")),
        F.when(path.startswith("\\\\") | path.startswith("//"), F.lit("network_path")),
        F.when(device, F.lit("device_path")),
        F.when(F.contains(path, F.lit("::$")), F.lit("data_stream")),
        F.when(traversal, F.lit("encoded_traversal")),
        F.when(path.rlike(r"[\x00-\x08\x0A-\x1F\x7F-\x9F]"), F.lit("control_character")),
    )


def export_path_issue(path: Column) -> Column:
    """Export targets may not be in a system directory nor climb with ``..``."""
    lowered = F.lower(path)
    system = reduce(lambda a, b: a | b, [lowered.startswith(d) for d in V.SYSTEM_DIRECTORIES])
    return F.coalesce(
        F.when(system, F.lit("system_directory")),
        F.when(F.array_contains(F.split(path, "/"), ".."), F.lit("traversal")),
    )
