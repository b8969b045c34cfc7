"""Column expressions for captions: normal forms, tokens, n-grams, lemmas, tags and ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that do not begin or end a readable phrase.
EDGE_WORDS = ("a", "an", "and", "at", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "with")


def normalized(text: Column, apostrophes: bool = True) -> Column:
    """Lower case, hyphens as spaces, only letters, digits and (on demand) apostrophes, single spaces."""
    kept = "[^a-z0-9' ]" if apostrophes else "[^a-z0-9 ]"
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(text), "[-\n\t]", " "), kept, ""), " +", " "))


def tokens(text: Column) -> Column:
    """The words of a normalized text without apostrophes at their ends."""
    return F.filter(F.transform(F.split(text, " "), lambda w: F.trim(w, F.lit("'"))), lambda w: w != "")


def ngrams(words: Column, most: int) -> Column:
    """The distinct readable n-grams of 1 to ``most`` words: of two letters at least, no edge word at either end."""
    edge = list(EDGE_WORDS)
    # The places whose word may stand at an end; a gram's text is made once its ends are known to be good.
    ends = F.array_compact(F.transform(words, lambda w, i: F.when(~w.isin(edge), i + 1)))

    def of(n: int) -> Column:
        if n == 1:
            return F.filter(F.filter(words, lambda w: ~w.isin(edge)), lambda w: F.length(w) >= 2)
        last = lambda i: F.get(words, i + (n - 2))  # noqa: E731  from 0
        starts = F.filter(ends, lambda i: (i + (n - 1) <= F.size(words)) & ~last(i).isin(edge))
        return F.transform(starts, lambda i: F.concat_ws(" ", *[F.get(words, i + (k - 1)) for k in range(n)]))

    return F.array_distinct(F.concat(*[of(n) for n in range(1, most + 1)]))


def lemmas(word: Column) -> Column:
    """The word and what stands before its endings -ies, -ing, -ed, -es, -s, a doubled consonant undone."""
    ing, ed = F.regexp_replace(word, "ing$", ""), F.regexp_replace(word, "ed$", "")

    def stem(base: Column, ends: str) -> list[Column]:
        hit = word.endswith(ends) & (F.length(base) >= 3)
        return [F.when(hit, base), F.when(hit, F.concat(base, F.lit("e"))), F.when(hit & (F.substring(base, -1, 1) == F.substring(base, -2, 1)), F.substring(base, F.lit(1), F.length(base) - 1))]

    forms = [word, F.when(word.endswith("ies") & (F.length(word) > 4), F.regexp_replace(word, "ies$", "y")), *stem(ing, "ing"), *stem(ed, "ed")]
    forms += [F.when(word.endswith("es") & (F.length(word) > 4), F.regexp_replace(word, "es$", "")), F.when(word.endswith("s") & ~word.endswith("ss") & (F.length(word) > 3), F.regexp_replace(word, "s$", ""))]
    return F.array_distinct(F.array_compact(F.array(*forms)))


def any_of(text: Column, patterns: list[str]) -> Column:
    """Whether any pattern (without look-around) is found, case ignored."""
    hit = F.lit(False)
    for p in patterns:
        hit = hit | text.rlike(f"(?i){p}")
    return hit


def slug(text: Column, most: int = 48) -> Column:
    """Letters, digits, _ and - only; runs of others become one _; none at the ends; at most ``most`` long."""
    return F.substring(F.trim(F.regexp_replace(text, "[^A-Za-z0-9_-]+", "_"), F.lit("_")), 1, most)


def short_id(*parts: Column) -> Column:
    """12 hex digits of SHA-1 of the parts joined by ||."""
    return F.substring(F.sha1(F.concat_ws("||", *parts).cast("binary")), 1, 12)
