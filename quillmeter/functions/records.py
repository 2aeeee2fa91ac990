"""Predicates and texts of records: passthrough summaries, remotes, paths, opaque tokens, bounded content."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Formats of summaries.
DERIVED_FORMATS = ["daily_rollup.v1", "claude_stats_cache"]
EXACT_DAILY_FORMATS = ["external_daily", "manual_daily", "custom_daily", "ccusage_daily"]
EXACT_PERIOD_FORMATS = ["manual_period_summary", "custom_period_summary"]
# Media types by file extension.
MEDIA_TYPES = {
    "avif": "image/avif",
    "bmp": "image/bmp",
    "gif": "image/gif",
    "heic": "image/heic",
    "heif": "image/heif",
    "ico": "image/x-icon",
    "jpeg": "image/jpeg",
    "jpg": "image/jpeg",
    "png": "image/png",
    "svg": "image/svg+xml",
    "svgz": "image/svg+xml",
    "tif": "image/tiff",
    "tiff": "image/tiff",
    "webp": "image/webp",
}
# Marks of cut content, without and with a kept tail.
CUT_MARK, CUT_MIDDLE = "\n[truncated]", "\n[... truncated ...]\n"


def passes_through(form: Column, kind: Column, start: Column, end: Column) -> Column:
    """Whether a summary is sent beside the rollups: an adapter's own, a daily one of one day (25 hours at most) or
    one of a period over several days; never a derived format or a local summary. Null forms and kinds are unknown ones."""
    form, kind = F.coalesce(form, F.lit("")), F.coalesce(kind, F.lit(""))
    one_day = F.to_date(start) == F.to_date(end)
    hours = F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))
    daily = form.isin(EXACT_DAILY_FORMATS) & (one_day | hours.between(0, 25 * 3_600_000_000))
    period = form.isin(EXACT_PERIOD_FORMATS) & ~one_day
    return ~form.isin(DERIVED_FORMATS) & (kind != "local_summary") & ((kind == "local_adapter") | daily | period)


def in_report_window(start: Column, end: Column, since: Column, until: Column) -> Column:
    """Whether [start, end) meets the closed window from since (null: the beginning) to until."""
    meets = (start <= until) & (end.isNull() | (since.isNull() | (since < end)))
    return F.coalesce(~(since > until), F.lit(True)) & meets


def git_remote(value: Column) -> Column:
    """host/path of a remote in lower case, without user, scheme and .git; null if there is no path."""
    bare = F.regexp_replace(F.trim(value), "/+$", "")
    scheme = F.regexp_replace(F.regexp_extract(bare, r"^.*?:///*([^/]+)/", 1), "^.*@", "")
    path = F.regexp_extract(bare, r"^.*?:///*[^/]+/(.*)$", 1)
    ssh = F.when(bare.rlike("^git@[^:]*:"), F.regexp_replace(bare, "^git@([^:]*):", "$1/"))
    joined = F.when(bare.startswith("git@"), ssh).when(bare.contains("://"), F.when(scheme != "", F.concat(scheme, F.lit("/"), path))).otherwise(bare)
    parts = F.filter(F.transform(F.split(joined, "/"), lambda p: F.lower(F.trim(p))), lambda p: p != "")
    return F.when(F.size(parts) >= 2, F.regexp_replace(F.array_join(parts, "/"), r"\.git$", ""))


def committer_hash(email: Column) -> Column:
    return F.sha2(F.concat(F.lit("git-committer.v1:"), F.lower(F.trim(email))), 256)


def contained_path(path: Column) -> Column:
    """path, or null if it is absolute or climbs out of its root at any step."""
    steps = F.filter(F.split(path, "/"), lambda p: ~p.isin("", "."))
    depths = F.aggregate(
        steps,
        F.struct(F.lit(0).alias("depth"), F.lit(0).alias("least")),
        lambda a, p: F.struct(
            (a["depth"] + F.when(p == "..", -1).otherwise(1)).alias("depth"),
            F.least(a["least"], a["depth"] + F.when(p == "..", -1).otherwise(1)).alias("least"),
        ),
    )
    return F.when(~path.startswith("/") & (depths["least"] >= 0), path)


def opaque_token(token: Column) -> Column:
    """Whether a token of 16 bytes or more looks like a key: eyJ..., or letters with digits and - _ . = alone."""
    bare = F.regexp_replace(token, r"^[,;:\"'()\[\]]+|[,;:\"'()\[\]]+$", "")
    mixed = bare.rlike("[A-Za-z]") & bare.rlike("[0-9]") & bare.rlike(r"\A[A-Za-z0-9._=-]+\z")
    return (F.octet_length(bare) >= 16) & (F.lower(bare).startswith("eyj") | mixed)


def media_type(path: Column) -> Column:
    """Media type of an image's extension, null for others."""
    name = F.element_at(F.split(path, "/"), -1)
    extension = F.when(name.rlike(r"^.+\.[^.]*$"), F.lower(F.element_at(F.split(name, r"\."), -1)))
    types = F.create_map(*[F.lit(x) for pair in MEDIA_TYPES.items() for x in pair])
    return F.try_element_at(types, extension)


def bucket_key(remote: Column, path: Column, branch: Column) -> Column:
    """A project's bucket, of its hashes; 'none' without a remote and a path that aren't blank."""
    part = lambda c: F.coalesce(c, F.lit("none"))
    hashes = F.concat(F.lit("repo:"), part(remote), F.lit("|path:"), part(path), F.lit("|branch:"), part(branch))
    named = F.coalesce(F.nullif(F.trim(remote), F.lit("")), F.nullif(F.trim(path), F.lit("")))
    return F.when(named.isNull(), "none").otherwise(hashes)


def weighted_overlap(added: Column, n_added: Column, deleted: Column, n_deleted: Column) -> Column:
    total = n_added + n_deleted
    return F.when(total == 0, F.lit(0.0)).otherwise((added * n_added + deleted * n_deleted) / total)


def ratio(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, F.lit(0.0)).otherwise(part / whole)


def f1(hits: Column, predicted: Column, truth: Column) -> Column:
    """Harmonic mean of precision and recall; 0 where both are 0 or 0 / 0."""
    p, r = ratio(hits, predicted), ratio(hits, truth)
    return F.when((p == 0) & (r == 0), F.lit(0.0)).otherwise(2 * p * r / (p + r))


def bounded(text: Column, most: int, tail: int = 0) -> Column:
    """text within most UTF-8 bytes: its head, a mark and (tail > 0) its end, cut between characters."""
    mark = CUT_MIDDLE if tail else CUT_MARK
    budget = max(most - len(mark), 0)
    kept = min(tail, budget)
    raw = F.encode(text, "utf-8")
    size = F.octet_length(text)
    # Bytes 10xxxxxx continue a character: a head that ends before one loses its unfinished character, a tail that begins with some loses these.
    after = F.hex(F.substring(raw, budget - kept + 1, 1))
    head = F.hex(F.substring(raw, 1, budget - kept))
    whole = F.when(after.rlike("^[89AB]"), F.regexp_replace(head, "([C-F][0-9A-F])([89AB][0-9A-F]){0,3}$", "")).otherwise(head)
    end = F.regexp_replace(F.hex(raw.substr(size - kept + 1, F.lit(kept))), "^([89AB][0-9A-F]){1,3}", "") if kept else F.lit("")
    cut = F.concat(F.decode(F.unhex(whole), "utf-8"), F.lit(mark), F.decode(F.unhex(end), "utf-8"))
    return F.when(size > most, cut).otherwise(text)
