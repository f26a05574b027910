"""What happens to jobs when they end, and whether they can be tried again."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mediacat.functions import rules


def route_completion(
    salvage: Column,
    verdict: Column,
    restored: Column,
    ladder: Column,
    quality: Column,
    salvage_when_stuck: Column,
    path_busy: Column,
) -> Column:
    """struct(route, next_state, next_quality) for a conversion that finished.

    A result not worth keeping is retried one rung down, or redone with the picture copied, but
    only if its original could be put back and no other job holds the path; else it is parked.
    """
    rung = F.when(restored & ~path_busy, rules.next_rung(ladder, quality))
    copy = restored & ~path_busy & F.coalesce(salvage_when_stuck, F.lit(True)) & ~salvage
    route = (
        F.when(salvage, "salvaged")
        .when(verdict["ok"], "done")
        .when(rung.isNotNull(), "retry_quality")
        .when(copy, "salvage_copy")
        .otherwise("bloated")
    )
    state = (
        F.when(route.isin("salvaged", "done"), "done")
        .when(route.isin("retry_quality", "salvage_copy"), "queued")
        .otherwise("bloated")
    )
    return F.struct(
        route.alias("route"),
        state.alias("next_state"),
        F.when(route == "retry_quality", rung).alias("next_quality"),
    )


def route_failure(audio_related: Column, audio: Column, path_busy: Column) -> Column:
    """struct(route, next_state, next_quality) for a conversion that failed.

    An audio fault is tried once more with the audio copied; when it already was, the job is
    ignored from then on. The failing job itself does not make its path busy.
    """
    related = F.coalesce(audio_related, F.lit(False))
    copied = F.coalesce(audio == "copy", F.lit(False))
    route = (
        F.when(related & ~copied & ~path_busy, "retry_audio_copy")
        .when(related & copied, "ignored")
        .otherwise("failed")
    )
    return F.struct(
        route.alias("route"),
        F.when(route == "retry_audio_copy", "queued").otherwise(route).alias("next_state"),
        F.lit(None).cast("int").alias("next_quality"),
    )


def refused(state: Column, completing: bool) -> Column:
    """State named as the reason for refusing a late report, NULL when it is accepted."""
    if completing:
        return F.when(state.isin("cancelled", "queued"), state)
    return F.when(~state.isin("leased", "running"), state)


def retry_block(
    source_present: Column,
    archived_present: Column,
    has_record: Column,
    has_library: Column,
    keeps_now: Column,
    kept_then: Column,
) -> Column:
    """Code of what prevents a new conversion, NULL when it is possible."""
    return (
        F.when(source_present | archived_present, F.lit(None).cast("string"))
        .when(~has_library, "no_library")
        .when(~keeps_now, "library_keeps_no_originals")
        .when(~kept_then, "kept_no_original_then")
        .when(has_record, "archived_copy_missing")
        .otherwise("never_archived")
    )
