"""Column expressions for items, metadata, queries and results."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rankweave.functions.vectors import NUMBER_PREFIX

POSTER_PLACEHOLDER = "https://via.placeholder.com/200x300?text=No+Poster"  # fixed value
DEFAULT_TITLE = "Unknown"
DEFAULT_RATIO = 0.3
DEFAULT_LIMIT = 20


def filled(text: Column) -> Column:
    """True for text that is neither null, '' nor '0' (the reference's notion of empty)."""
    return F.coalesce(~text.isin("", "0"), F.lit(False))


def no_strings() -> Column:
    return F.array().cast("array<string>")


def release_year(epoch: Column) -> Column:
    """UTC year of epoch seconds, whatever the session's time zone; null for 0."""
    day = F.floor(epoch / 86400).cast("int")
    return F.when(epoch != 0, F.year(F.date_add(F.lit("1970-01-01").cast("date"), day)))


def content_document(title: Column, overview: Column, genres: Column, release_date: Column,
                     keywords: Column | None = None, characters: Column | None = None,
                     director: Column | None = None) -> Column:
    """One labelled line per filled field; the title line is always there."""
    def line(label, value, present):
        return F.when(present, F.concat(F.lit(label + ": "), value))

    def listed(label, values):
        return line(label, F.array_join(values, ", "), F.size(values) > 0)

    year = release_year(release_date)
    lines = [
        F.concat(F.lit("title: "), title),
        line("year", year.cast("string"), year.isNotNull()),
        listed("genres", genres),
        line("overview", overview, filled(overview)),
    ]
    if keywords is not None:
        lines.append(listed("keywords", keywords))
    if characters is not None:
        lines.append(listed("characters", characters))
    if director is not None:
        lines.append(line("director", director, filled(director)))
    return F.concat_ws("\n", *lines)


def full_text(title: Column, overview: Column) -> Column:
    """What keyword search reads: title, one blank, overview."""
    return F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(overview, F.lit("")))


def metadata_pack(content: Column, title: Column, overview: Column, genres: Column, poster: Column,
                  release_date: Column, item_id: Column) -> Column:
    """JSON of the seven entries, nulls written out."""
    entries = F.struct(
        content.alias("text"), title.alias("title"), overview.alias("overview"), genres.alias("genres"),
        poster.alias("poster"), release_date.alias("release_date"), item_id.alias("movie_id"),
    )
    return F.to_json(entries, {"ignoreNullFields": "false"})


def genres_normalise(genres: Column) -> Column:
    """VARIANT holding an array or a single text, as an array of strings."""
    many = F.try_variant_get(genres, "$", "array<string>")
    one = F.try_variant_get(genres, "$", "string")
    return F.coalesce(many, F.when(one.isNotNull(), F.array(one)), no_strings())


def doc_identity(source: Column, item_id: Column) -> Column:
    """Same item, same id: importing again or retrying a task adds no duplicate."""
    return F.sha2(F.concat_ws(":", source, item_id.cast("string")), 256)


def number_prefix(text: Column) -> Column:
    """Leading number of a text; 0 when there is none."""
    return F.coalesce(F.regexp_extract(text, NUMBER_PREFIX, 1).try_cast("double"), F.lit(0.0))


def prepared_ratio(ratio: Column) -> Column:
    given = F.least(F.greatest(number_prefix(ratio), F.lit(0.0)), F.lit(1.0))
    return F.when(ratio.isNull(), F.lit(DEFAULT_RATIO)).otherwise(given)


def prepared_limit(limit: Column) -> Column:
    return F.when(limit.isNull(), F.lit(DEFAULT_LIMIT)).otherwise(number_prefix(limit).cast("int"))


def card_genres(genres: Column) -> Column:
    return F.slice(F.coalesce(genres, no_strings()), 1, 3)


def card_poster(poster: Column) -> Column:
    return F.coalesce(F.nullif(poster, F.lit("")), F.lit(POSTER_PLACEHOLDER))


def card_score(score: Column) -> Column:
    return F.when(score != 0, F.format_string("%.3f", score)).otherwise("N/A")
