"""Stored documents: JSON payloads to checked rows of passages and speakers, and back to JSON.

A payload is parsed once into a VARIANT, so fields that no operator knows stay
with their row. What can't be read goes to a reject table with a reason; what
can be read but breaks a rule is told by rule.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = "recording_id"
#: Limits (fixed values): speakers of a document, characters of a speaker's key and name, passages, characters of an id and a text, and seconds that an end may lie behind the recording's.
MOST_SPEAKERS, KEY_CHARS, NAME_CHARS = 64, 80, 100
MOST_PASSAGES, ID_CHARS, TEXT_CHARS, TOLERANCE = 20_000, 100, 20_000, 0.001
#: Fields of a passage and a document in the order in which they are printed (fixed values); others follow as they came.
PASSAGE_FIELDS = ("id", "start", "end", "speaker", "text", "language", "language_detection", "transcription_review", "reading_turns", "reading_turn_provenance", "alignment", "speaker_activity", "acoustic_evidence", "refinement_state", "machine_revision", "protected_fields", "review_resolution", "retry_candidate", "canonical_utterance_id", "audio_revision", "review", "capture_source", "separation")
DOCUMENT_FIELDS = ("speakers", "segments", "provenance", "warnings", "diarization", "edited_at")


def parsed(payloads: DataFrame) -> DataFrame:
    """(recording_id, document, reject): ``payloads`` (recording_id, payload) as VARIANT, or why not.

    reject: empty (null or blank), bad_json, not_an_object, or other_id (the
    payload says another id than its row).
    """
    v = F.try_parse_json("payload")
    known = payloads.select(KEY, "payload", v.alias("document"))
    kind = F.schema_of_variant("document")
    own = F.try_variant_get("document", "$.id", "string")
    reject = (
        F.when(F.coalesce(F.col("payload"), F.lit("")).rlike(r"^\s*$"), "empty").when(F.col("document").isNull(), "bad_json").when(~F.startswith(kind, F.lit("OBJECT")), "not_an_object")
        .when(own.isNotNull() & (own != F.col(KEY).cast("string")), "other_id")
    )
    return known.select(KEY, "document", reject.alias("reject"))


def accepted(found: DataFrame) -> DataFrame:
    return found.where("reject IS NULL").select(KEY, "document")


def rejected(found: DataFrame) -> DataFrame:
    return found.where("reject IS NOT NULL").select(KEY, "reject")


def is_kind(column: Column, *kinds: str) -> Column:
    """Whether a VARIANT is of one of these kinds; a missing value is of none."""
    return F.coalesce(F.regexp_extract(F.schema_of_variant(column), r"^[A-Z]+", 0).isin(*kinds), F.lit(False))


def number(column: Column) -> Column:
    """A number, or a text that is one; null for anything else."""
    value = F.when(is_kind(column, "BIGINT", "DECIMAL", "DOUBLE", "FLOAT"), F.try_variant_get(column, "$", "double"))
    return F.coalesce(value, F.when(is_kind(column, "STRING"), F.trim(F.try_variant_get(column, "$", "string")).try_cast("double")))


def string(column: Column) -> Column:
    return F.when(is_kind(column, "STRING"), F.try_variant_get(column, "$", "string"))


def speakers(documents: DataFrame) -> DataFrame:
    """(recording_id, speaker, name, known): the speaker map of each document; a name is trimmed, and null if it is no text."""
    entries = F.map_entries(F.try_variant_get("document", "$.speakers", "map<string,variant>"))
    each = documents.select(KEY, F.explode(entries).alias("e"))
    return each.select(KEY, F.col("e.key").alias("speaker"), F.regexp_replace(string(F.col("e.value")), r"(?U)^\s+|\s+$", "").alias("name"))


def passages(documents: DataFrame) -> DataFrame:
    """(recording_id, pos, passage_id, start, end, speaker, text, segment): the segments of each document in their order.

    Without an id a segment is called by its position; one that is no text is
    null. start and end are numbers or texts that are. segment is the whole
    VARIANT, with what isn't listed here.
    """
    listed = F.try_variant_get("document", "$.segments", "array<variant>")
    each = documents.select(KEY, F.posexplode(listed).alias("pos", "segment"))
    part = {c: F.try_variant_get("segment", f"$.{c}", "variant") for c in ("id", "start", "end", "speaker", "text")}
    name = F.when(part["id"].isNull(), F.concat(F.lit("seg-"), F.col("pos").cast("string"))).otherwise(string(part["id"]))
    return each.select(KEY, "pos", name.alias("passage_id"), number(part["start"]).alias("start"), number(part["end"]).alias("end"), string(part["speaker"]).alias("speaker"), string(part["text"]).alias("text"), is_kind(F.col("segment"), "OBJECT").alias("is_object"), "segment")


def passage_violations(documents: DataFrame, durations: DataFrame) -> DataFrame:
    """(recording_id, pos, rule): the first rule that a passage breaks, of segment_object, segment_times, segment_bounds, speaker_or_text and segment_ids.

    durations: recording_id, duration in seconds.
    """
    p = passages(documents).join(durations, KEY, "left")
    known = speakers(documents).select(KEY, "speaker", F.lit(True).alias("_known"))
    p = p.join(known, [KEY, "speaker"], "left")
    finite = lambda c: ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))
    inside = finite("start") & finite("end") & (F.col("start") >= 0) & (F.col("start") < F.col("end")) & (F.col("end") <= F.col("duration") + TOLERANCE)
    again = F.row_number().over(Window.partitionBy(KEY, "passage_id").orderBy("pos")) > 1
    rule = (
        F.when(~F.col("is_object"), "segment_object").when(F.col("start").isNull() | F.col("end").isNull(), "segment_times").when(~F.coalesce(inside, F.lit(False)), "segment_bounds")
        .when(F.col("_known").isNull() | F.col("text").isNull() | (F.length("text") > TEXT_CHARS), "speaker_or_text").when(F.col("passage_id").isNull() | (F.length("passage_id") > ID_CHARS) | again, "segment_ids")
    )
    return p.select(KEY, "pos", rule.alias("rule")).where("rule IS NOT NULL")


def violations(documents: DataFrame, durations: DataFrame) -> DataFrame:
    """(recording_id, rule, pos): what is wrong first with each document, null if nothing is.

    A document's speakers are judged first (speaker_count, speaker_names),
    then the list of its segments (segment_list), then each in order.
    """
    told = speakers(documents).groupBy(KEY).agg(F.count("*").alias("n"), F.bool_and(F.coalesce(F.length("name").between(1, NAME_CHARS), F.lit(False)) & (F.length("speaker") <= KEY_CHARS)).alias("named"))
    listed = F.try_variant_get("document", "$.segments", "array<variant>")
    heads = documents.select(KEY, is_kind(F.try_variant_get("document", "$.speakers", "variant"), "OBJECT").alias("map"), is_kind(F.try_variant_get("document", "$.segments", "variant"), "ARRAY").alias("list"), F.size(listed).alias("size"))
    first = passage_violations(documents, durations).groupBy(KEY).agg(F.min(F.struct("pos", "rule")).alias("first"))
    joined = heads.join(told, KEY, "left").join(first, KEY, "left")
    rule = (
        F.when(~F.col("map") | ~F.coalesce(F.col("n"), F.lit(0)).between(1, MOST_SPEAKERS), "speaker_count").when(~F.col("named"), "speaker_names")
        .when(~F.col("list") | (F.col("size") > MOST_PASSAGES), "segment_list")
    )
    return joined.select(KEY, F.coalesce(rule, "first.rule").alias("rule"), F.when(rule.isNull(), F.col("first.pos")).alias("pos"))


def printed(payload: str) -> str:
    """A document as indented JSON: known fields in their order, deleted passages and pending candidates left out."""
    given = json.loads(payload)
    rows = []
    for k, s in enumerate(given.get("segments") or []):
        if s.get("deleted") is True:
            continue
        own = {"id": f"seg-{k}"} | s | {c: float(s[c]) for c in ("start", "end") if c in s}
        rows.append({c: own[c] for c in PASSAGE_FIELDS if own.get(c) is not None} | {c: v for c, v in own.items() if c not in PASSAGE_FIELDS and c != "separation_candidate"})
    rows.sort(key=lambda s: (s["start"], s["end"]))
    names = {k: v.strip() for k, v in sorted(given["speakers"].items())}
    head = {"speakers": names, "segments": rows} | {c: given[c] for c in DOCUMENT_FIELDS[2:] if given.get(c) not in (None, [])}
    rest = {c: v for c, v in given.items() if c not in (*DOCUMENT_FIELDS, "schema_version")}
    return json.dumps(head | {"schema_version": 1} | rest, ensure_ascii=False, indent=2) + "\n"


def as_json(payloads: DataFrame) -> DataFrame:
    """(recording_id, body, allowed): valid ``payloads`` (recording_id, payload) as printed JSON, if that is within the size of an export."""
    from parley.operators.exports import LARGEST

    @F.pandas_udf("string")
    def show(payload: pd.Series) -> pd.Series:
        return payload.map(printed)

    out = payloads.select(KEY, show("payload").alias("body"))
    fits = F.octet_length("body") <= LARGEST
    return out.select(KEY, F.when(fits, F.col("body")).alias("body"), fits.alias("allowed"))


def lookup(documents: DataFrame, ids: list, metadata: bool = False) -> DataFrame:
    """The stored rows (recording_id, name, status, document, extra) of a few ids.

    As metadata, documents and private columns are null and ``refinable`` tells
    whether a passage of a ready recording has words and no protected field.
    """
    found = documents.where(F.col(KEY).isin(list(ids)))
    if not metadata:
        return found
    words = lambda s: F.coalesce(F.try_variant_get(s, "$.text", "string"), F.lit("")).rlike(r"(?U)\S")
    free = lambda s: F.size(F.coalesce(F.try_variant_get(s, "$.protected_fields", "array<string>"), F.array().cast("array<string>"))) == 0
    some = F.exists(F.try_variant_get("document", "$.segments", "array<variant>"), lambda s: words(s) & free(s))
    bit = (F.col("status") == "ready") & F.coalesce(some, F.lit(False))
    return found.withColumn("refinable", bit).withColumns({c: F.lit(None).cast(kind) for c, kind in (("document", "variant"), ("extra", "string"))})
