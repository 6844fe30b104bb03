"""Vocabulary hits and weighted scores against a profile.

The profile is one small set of word lists, so every term becomes a literal in
the plan: no join, and the whole score is computed where the row is read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Points per hit.
WEIGHTS = {"role": 5, "keyword": 2, "ops": 3, "tech": 2, "method": 2, "exclude": -100}
# Categories in report order, with the way their terms match.
CATEGORIES = (
    ("role", "roles", "any_word_gt3"),
    ("keyword", "preferred_keywords", "substring"),
    ("ops", "operations_finance", "substring"),
    ("tech", "technical", "whole_word"),
    ("method", "methodology", "substring"),
    ("exclude", "exclude_keywords", "substring"),
)


@dataclass(frozen=True)
class Profile:
    """Weighted vocabulary lists (one profile is a few hundred short terms)."""

    roles: tuple[str, ...] = ()
    preferred_keywords: tuple[str, ...] = ()
    operations_finance: tuple[str, ...] = ()
    technical: tuple[str, ...] = ()
    methodology: tuple[str, ...] = ()
    exclude_keywords: tuple[str, ...] = ()
    exclude_companies: tuple[str, ...] = ()
    profile_id: str = field(default="default")


def _hit_list(flags: list[tuple[str, Column]]) -> Column:
    if not flags:
        return F.array().cast("array<string>")
    return F.array_compact(F.array(*[F.when(test, F.lit(term)) for term, test in flags]))


def has_role(text: Column, role: str) -> Column:
    """Any word of the role longer than three letters occurs in the text."""
    words = [w for w in role.lower().split() if len(w) > 3]
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words], F.lit(False))


def has_word(text: Column, term: str) -> Column:
    """Whole-word test; the plain search in front spares most rows the regex."""
    low = term.lower()
    pattern = r"(?U)\b" + re.sub(r"([^\w\s])", r"\\\1", low) + r"\b"
    return F.contains(text, F.lit(low)) & text.rlike(pattern)


def role_hits(text: Column, roles) -> Column:
    return _hit_list([(r, has_role(text, r)) for r in roles])


def substring_hits(text: Column, terms) -> Column:
    return _hit_list([(t, F.contains(text, F.lit(t.lower()))) for t in terms])


def word_hits(text: Column, terms) -> Column:
    return _hit_list([(t, has_word(text, t)) for t in terms])


def json_list(tags: Column) -> Column:
    """JSON text of a string list, ``", "`` between the entries."""
    quoted = F.transform(tags, lambda t: F.concat(
        F.lit('"'), F.replace(F.replace(t, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')),
        F.lit('"')))
    return F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit("]"))


def combined_text(title: Column, description: Column, tags: Column) -> Column:
    parts = [F.coalesce(c, F.lit("")) for c in (title, description, tags)]
    return F.lower(F.concat_ws(" ", *parts))


def hit_lists(role_text: Column, text: Column, profile: Profile) -> dict[str, Column]:
    """Hit list per category."""
    matchers = {"any_word_gt3": role_hits, "substring": substring_hits, "whole_word": word_hits}
    return {f"{name}_hits": matchers[mode](role_text if name == "role" else text,
                                           getattr(profile, terms))
            for name, terms, mode in CATEGORIES}


def points() -> dict[str, Column]:
    """Subtotals and total from the hit lists."""
    scores = {f"{name}_score": (F.size(f"{name}_hits") * WEIGHTS[name]).cast("bigint")
              for name, _, _ in CATEGORIES}
    return {**scores, "total": reduce(lambda a, b: a + b, scores.values())}


def vocabulary_hits(df: DataFrame, id_col: str, role_text: Column, text: Column,
                    profiles: list[Profile]) -> DataFrame:
    """Long table of hits, one row per (row, profile, category, term)."""
    def entries(p: Profile):
        for name, terms, mode in CATEGORIES:
            for pos, term in enumerate(getattr(p, terms)):
                test = (has_role(F.col("_role"), term) if mode == "any_word_gt3" else
                        has_word(F.col("_text"), term) if mode == "whole_word" else
                        F.contains(F.col("_text"), F.lit(term.lower())))
                yield F.when(test, F.struct(
                    F.lit(p.profile_id).alias("profile_id"), F.lit(name).alias("category"),
                    F.lit(term).alias("term"), F.lit(pos).cast("bigint").alias("pos"),
                    F.lit(WEIGHTS[name]).cast("bigint").alias("weight")))
    staged = df.select(id_col, role_text.alias("_role"), text.alias("_text"))
    hits = F.array_compact(F.array(*[e for p in profiles for e in entries(p)]))
    return staged.select(id_col, F.explode(hits).alias("hit")).select(id_col, "hit.*")
