"""Names: tokens, canonical keys, accents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ACCENTS = ("àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")
UNKNOWN = "unk"


def strip_accents(text: Column) -> Column:
    """Lower case without the accents of Latin-1."""
    return F.translate(F.lower(text), *ACCENTS)


def tokens(name: Column) -> Column:
    """Lower-case words of more than one letter, without punctuation and the mark for unknown."""
    words = F.split(F.regexp_replace(F.lower(name), r"[^a-z0-9 ]", ""), " ")
    return F.filter(words, lambda w: (F.length(w) > 1) & (w != UNKNOWN))


def canonical_key(name: Column, expand: dict[str, str]) -> Column:
    """Sorted tokens, abbreviations expanded, joined by blanks."""
    table = F.create_map(*[F.lit(x) for kv in expand.items() for x in kv])
    return F.array_join(F.array_sort(F.transform(tokens(name), lambda w: F.coalesce(table[w], w))), " ")


def levenshtein_ratio(a: Column, b: Column) -> Column:
    """1 - distance / longer length; 1 for equal, 0 for empty or different first letters."""
    gate = (F.length(a) > 0) & (F.length(b) > 0) & (F.substring(a, 1, 1) == F.substring(b, 1, 1))
    return F.when(a == b, F.lit(1.0)).when(gate, 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b))).otherwise(F.lit(0.0))
