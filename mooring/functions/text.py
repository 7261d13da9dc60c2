"""Text expressions of the relevance modes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def words_of(text: Column) -> Column:
    """Runs of a-z and 0-9 in the lower-cased text, in order."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def token_set(text: Column) -> Column:
    return F.array_distinct(words_of(text))


def normalised(text: Column) -> Column:
    return F.array_join(words_of(text), " ")


def overlap(query: Column, text: Column) -> Column:
    """Share of the query's distinct tokens that occur in the text, 0 without any."""
    q = token_set(query)
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, token_set(text))) / F.size(q)).otherwise(F.lit(0.0))


#: Scores of a title that equals, lies in, or contains the query (fixed values).
TITLE_EQUAL, TITLE_INSIDE, TITLE_AROUND = 1.0, 0.85, 0.65


def title_match(query: Column, title: Column) -> Column:
    q, t = normalised(query), normalised(title)
    return (F.when((q == "") | (t == ""), 0.0).when(q == t, TITLE_EQUAL)
            .when(F.contains(q, t), TITLE_INSIDE).when(F.contains(t, q), TITLE_AROUND).otherwise(0.0))


def title_aware(query: Column, title: Column, text: Column) -> Column:
    """Title overlap, title match and overall overlap, weighted .30, .25 and .45."""
    joined = F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(text, F.lit("")))
    return 0.30 * overlap(query, title) + 0.25 * title_match(query, title) + 0.45 * overlap(query, joined)


def subject_title(query: Column, title: Column, text: Column, subject: Column) -> Column:
    """As title_aware; with a subject, .30 of that and .70 if the title is the subject.  An
    empty subject is one that no title equals; null is none."""
    base, s = title_aware(query, title, text), normalised(subject)
    same = F.when((normalised(title) == s) & (s != ""), 1.0).otherwise(0.0)
    return F.when(subject.isNull(), base).otherwise(0.30 * base + 0.70 * same)


def word_count(text: Column) -> Column:
    """Pieces between white space of any kind, at least 1."""
    pieces = F.filter(F.split(F.coalesce(text, F.lit("")), r"(?U)[\s\x1c-\x1f]+"), lambda w: w != "")
    return F.greatest(F.lit(1), F.size(pieces)).cast("long")
