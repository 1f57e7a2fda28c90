"""Schemas of the tables the library reads and writes."""

from __future__ import annotations

# Raw items keep every field as VARIANT, so one badly typed field neither
# fails the read nor hides the rest of its row.
RAW_ITEM = (
    "id VARIANT, title VARIANT, overview VARIANT, genres VARIANT, poster VARIANT, "
    "release_date VARIANT, _corrupt_record STRING"
)

ITEM = (
    "id BIGINT, title STRING, overview STRING, genres ARRAY<STRING>, poster STRING, release_date BIGINT"
)

ENRICHMENT_PAYLOAD = (
    "STRUCT<keywords: STRUCT<keywords: ARRAY<STRUCT<name: STRING>>>, "
    "credits: STRUCT<cast: ARRAY<STRUCT<name: STRING, `character`: STRING>>, "
    "crew: ARRAY<STRUCT<job: STRING, name: STRING>>>>"
)

CORPUS = (
    "doc_id STRING, item_id BIGINT, content STRING, title STRING, overview STRING, "
    "genres ARRAY<STRING>, poster STRING, release_date BIGINT, embedding ARRAY<FLOAT>, metadata STRING"
)
