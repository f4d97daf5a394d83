"""Decisions over the columns of one row: ingest, uploads, recorder state. The first rule that applies
decides; a condition that is null does not apply."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

c = F.col


def first_of(cases: list[tuple[Column, str]], otherwise: str) -> Column:
    """The value of the first case that is true."""
    out = None
    for condition, value in cases:
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return out.otherwise(otherwise)


#: White space of Unicode, with the four information separators that count as such in texts.
SPACE = r"[\s\x1c-\x1f]"


def strip(column: str) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(column, rf"(?U)\A{SPACE}+|{SPACE}+\z", "")


def one_spaced(column: str) -> Column:
    """Words parted by white space of any kind, joined by one space."""
    return F.trim(F.regexp_replace(column, rf"(?U){SPACE}+", " "))


def segment_outcome() -> Column:
    """The first rule that a transcript segment breaks, by its stripped key, text and language."""
    language = F.nullif(F.lower(strip("language")), F.lit(""))
    return first_of(
        [
            (F.coalesce(F.length(strip("producer_key")), F.lit(0)) == 0, "producer_key_blank"),
            (F.length(strip("producer_key")) > 160, "producer_key_length"),
            ((c("start_ms") < 0) | (c("end_ms") <= c("start_ms")), "time"),
            (F.coalesce(F.length(strip("text")), F.lit(0)) == 0, "text"),
            (F.length(language) > 32, "language"),
        ],
        "accepted",
    )


def gap_outcome() -> Column:
    """A gap has a sequence range, an interval of wall time or both, and each whole and in order."""
    parts = lambda a, b: (c(a).isNotNull() | c(b).isNotNull(), c(a).isNull() | c(b).isNull() | (c(b) < c(a)))
    (range_, bad_range), (wall, bad_wall) = parts("lo", "hi"), parts("wall_from", "wall_to")
    return first_of([(~range_ & ~wall, "nothing"), (range_ & bad_range, "range"), (wall & bad_wall, "wall")], "accepted")


#: Session states that take chunks.
OPEN = ("recording", "recovering", "interrupted", "finalizing")


def chunk_outcome(most_bytes: int) -> Column:
    """Time, payload and digest first, then the writer's fence, the session's state and its boundary."""
    size = F.coalesce(F.octet_length("payload"), F.lit(0))
    return first_of(
        [
            (c("end_ms") < c("start_ms"), "time"),
            (size == 0, "empty"),
            (size > most_bytes, "too_large"),
            (~F.sha2("payload", 256).eqNullSafe(F.lower("declared_sha256")), "digest"),
            (~c("active_writer").eqNullSafe(c("writer_id")) | ~c("active_epoch").eqNullSafe(c("epoch")), "fenced"),
            (~F.coalesce(c("state").isin(*OPEN), F.lit(False)), "closed"),
            ((c("state") == "finalizing") & (c("sequence") > c("final_sequence")), "beyond_boundary"),
        ],
        "accepted",
    )


def utterance_outcome(key: Column, content_type: Column) -> Column:
    """``key`` and ``content_type`` are stripped."""
    return first_of(
        [
            (F.coalesce(F.length(key), F.lit(0)) == 0, "blank_key"),
            (F.length(key) > 160, "long_key"),
            (~F.coalesce((c("start_ms") >= 0) & (c("end_ms") > c("start_ms")), F.lit(False)), "time"),
            (F.coalesce(F.length(content_type), F.lit(0)) == 0, "blank_type"),
            (F.length(content_type) > 128, "long_type"),
            (F.coalesce(F.octet_length("payload"), F.lit(0)) == 0, "payload"),
        ],
        "accepted",
    )


def result_state(segments: Column) -> Column:
    """The state that an uploader sees. What a finished run came to hangs on its segments alone."""
    broken = (c("session_state") == "failed") | c("failure_code").isNotNull()
    upload = F.when(broken, "failed").otherwise("uploading")
    run = (
        F.when(c("processing").isNull() | c("processing").isin("pending", "claimed", "retry_wait"), "preparing")
        .when(c("processing") == "waiting_stt", "transcribing")
        .when(c("processing") == "succeeded", F.when(segments > 0, "complete").otherwise("no_speech"))
        .otherwise("failed")
    )
    return F.when(c("uploaded_at").isNull(), upload).otherwise(run)


def local_fence() -> Column:
    """Whether the server's state shuts this recorder out."""
    same = c("server_epoch") == c("epoch")
    done = (c("server_state") == "complete") & same & c("final_sequence").eqNullSafe(c("last_sequence")) & c("final_end_ms").eqNullSafe(c("last_end_ms"))
    taken = c("server_writer").isNotNull() & (c("server_writer") != c("writer"))
    return first_of([(done, "matching_completion"), (claim_advanced(), "advanced"), ((c("server_state") == "complete") | ~same | taken, "fenced")], "open")


def claim_advanced() -> Column:
    return (F.coalesce(c("pending_writer"), F.lit("")) != "") & (c("server_epoch") == c("epoch") + 1) & c("server_writer").eqNullSafe(c("pending_writer"))


def pending_claim() -> Column:
    """What becomes of a claim that was pending when the recording is finished."""
    return first_of(
        [
            (F.coalesce(c("pending_writer"), F.lit("")) == "", "none"),
            (claim_advanced() & (F.coalesce(c("recovery_token"), F.lit("")) == ""), "no_capability"),
            (claim_advanced(), "adopt"),
            ((c("server_epoch") == c("epoch")) & c("server_writer").eqNullSafe(c("writer")), "drop"),
        ],
        "conflict",
    )


def recorder_labels() -> dict[str, Column]:
    """What a recorder shows of a snapshot, and the actions it offers."""
    fenced, phase, pending, known = c("fenced"), c("phase"), c("n_pending") > 0, c("session_id").isNotNull()
    # Labels and tones.
    lifecycle = first_of(
        [
            (fenced, "Needs attention/warning"),
            (phase == "requesting", "Starting microphone…/neutral"),
            (phase == "recording", "recording/positive"),
            (phase == "finalizing", "Finalizing/neutral"),
            (phase == "recoverable", "Needs recovery/warning"),
            ((phase == "complete") & (c("n_gaps") > 0), "Complete/warning"),
            (phase == "complete", "Complete/positive"),
            (phase == "error", "Ready to retry/warning"),
        ],
        "Ready/neutral",
    )
    audio = first_of(
        [
            (fenced & pending, "Orphaned local evidence — action blocked/danger"),
            (fenced, "Session ownership changed/warning"),
            (c("write_failed"), "Unsafe audio storage/danger"),
            (c("n_missing") > 0, "Audio missing — action required/danger"),
            (pending & ~c("online") & F.coalesce(c("persisted"), F.lit(False)), "Audio saved locally/warning"),
            (pending & ~c("online"), "Audio saved locally/danger"),
            (pending & (phase == "recoverable"), "Recovering audio/warning"),
            (pending, "Syncing audio/warning"),
            ((phase == "complete") & (c("n_gaps") > 0), "Audio finalized with declared loss/warning"),
            (known & (phase == "recoverable"), "Audio recovery ready/warning"),
            (known, "Audio synced/positive"),
        ],
        "Audio ready/neutral",
    )
    transcription = first_of(
        [
            (~known, "Not started/neutral"),
            (c("realtime") == "connecting", "Starting transcription/neutral"),
            (c("realtime") == "live", "Transcribing/positive"),
            ((c("realtime") == "degraded") | c("realtime_error").isNotNull(), "Transcription delayed/warning"),
            (phase == "complete", "Processing may continue/neutral"),
        ],
        "Not active/neutral",
    )
    lost = (phase == "recoverable") & (c("n_missing") > 0)
    primary = F.when(fenced, None).when(phase == "recording", "stop").when(phase == "finalizing", "defer-finalization").when(lost, "finish-recovered").when(phase == "recoverable", "resume").when(phase.isin("idle", "complete", "error"), "start")
    more = [F.when((phase == "recoverable") & ~lost, "finish-recovered"), F.when(known & pending & ~phase.isin("requesting", "finalizing"), "sync")]
    return {
        "lifecycle": lifecycle,
        "audio": audio,
        "transcription": transcription,
        "primary_action": primary,
        "secondary_actions": F.when(fenced, "").otherwise(F.concat_ws(",", *more)),
        "danger_actions": F.when(~fenced & lost, "declare-missing-gaps").otherwise(""),
        "message": F.when((phase == "complete") & (c("acknowledged") == 0) & (c("n_gaps") == 0), "Recording finalized with no durable audio captured.").otherwise(c("message")),
    }


#: The hooks that are acted upon; the shape of their JSON.
HOOKS = ("pre-create", "post-create", "post-receive", "pre-finish", "post-finish")
HOOK_JSON = "Type string, Event struct<Upload: struct<ID: string, Size: bigint, SizeIsDeferred: boolean, `Offset`: bigint, MetaData: map<string, string>>, HTTPRequest: struct<Header: map<string, array<string>>>>, broken string"
_UUID = r"^\p{XDigit}{8}(-\p{XDigit}{4}){3}-\p{XDigit}{12}$"


def hook_header(name: str) -> Column:
    """The first value of the request header of that name, whatever its case."""
    own = F.filter(F.map_entries("j.Event.HTTPRequest.Header"), lambda e: (F.lower(e["key"]) == name.lower()) & (F.size(e["value"]) > 0))
    return F.try_element_at(own, F.lit(1))["value"][0]


def hook_session() -> Column:
    """The session that a hook names, if it is a UUID."""
    own = c("j.Event.Upload.MetaData")["session"]
    return F.when(own.rlike(_UUID), F.lower(own))


def hook_status(now: int) -> Column:
    """Status of the answer to a hook: 200 when it is taken or not acted upon. ``token``, ``session`` and
    the columns of the upload's row stand beside the decoded ``j``."""
    up = "j.Event.Upload"
    kind, size = c("j.Type"), c(f"{up}.Size")
    offset = F.coalesce(c(f"{up}.Offset"), F.lit(0))
    filetype = F.coalesce(F.nullif(F.lower(F.trim(F.split_part(F.coalesce(c(f"{up}.MetaData")["filetype"], F.lit("")), F.lit(";"), F.lit(1)))), F.lit("")), F.lit("application/octet-stream"))
    id_ = c(f"{up}.ID")
    return (
        F.when(c("j.broken").isNotNull() | kind.isNull() | size.isNull() | (size < 0) | (offset < 0), 422)
        .when(~kind.isin(*HOOKS), 200)
        .when(c("session").isNull() | (F.coalesce("token", F.lit("")) == ""), 403)
        .when(c("declared").isNull(), 404)
        .when(~F.sha2("token", 256).eqNullSafe(c("token_hash")), 403)
        .when(F.lit(now) >= c("expires_at"), 410)
        .when(F.coalesce(c(f"{up}.SizeIsDeferred"), F.lit(False)), 422)
        .when((size != c("declared")) | ~c(f"{up}.MetaData")["filename"].eqNullSafe(c("file_name")) | (filetype != c("content_type")) | (offset > c("declared")), 409)
        .when(kind == "pre-create", F.when(c("bound_id").isNull(), 200).otherwise(409))
        .when(id_.isNull() | (c("bound_id") != id_), 409)
        .when(kind.isin("pre-finish", "post-finish") & (offset != c("declared")), 409)
        .otherwise(200)
    )
