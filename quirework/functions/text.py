"""Column functions over words, titles and numbers."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

def _unmarked() -> dict[str, str]:
    """Every letter that decomposes into one letter and marks, and that letter in lower case."""
    found = {}
    for code in range(0xC0, 0x2000):
        c = chr(code).lower()
        bare = "".join(x for x in unicodedata.normalize("NFD", c) if not unicodedata.combining(x))
        if len(c) == len(bare) == 1 and c != bare:
            found[c] = bare
    return found


_BARE = _unmarked()


def plain(c: Column) -> Column:
    """Lower case without marks, whether they are part of a letter or follow it."""
    return F.regexp_replace(F.translate(F.lower(c), "".join(_BARE), "".join(_BARE.values())), r"\p{M}", "")


def word_key(c: Column) -> Column:
    """A key that early and modern spellings of a word share.

    Long s, u/v, i/j/y and marks are levelled, only a-z is kept, then ck, doubled letters, a final e
    and the endings of weak participles are reduced, in that order.
    """
    k = F.regexp_replace(F.translate(plain(c), "ſvjy", "suii"), "[^a-z]", "")
    k = F.regexp_replace(F.regexp_replace(k, "ck", "c"), r"(.)\1+", "$1")
    k = F.regexp_replace(F.regexp_replace(k, "(?<=.)e$", ""), r"(..)ed$", "$1d")
    return F.regexp_replace(k, r"([pkcsx])t$", "$1d")


_PLAIN, _LEVEL = str.maketrans(_BARE), str.maketrans("ſvjy", "suii")


@lru_cache(1 << 16)
def key(word: str) -> str:
    """``word_key`` of a word in a kernel, where words come again and again."""
    k = re.sub("[^a-z]", "", word.lower().translate(_PLAIN).translate(_LEVEL)).replace("ck", "c")
    k = re.sub("(?<=.)e$", "", re.sub(r"(.)\1+", r"\1", k))
    return re.sub("([pkcsx])t$", r"\1d", re.sub("(..)ed$", r"\1d", k))


def spaced(text: Column, of: Callable[[Column], Column]) -> Column:
    """``of`` a text's words with one blank between two and none at the ends; ``of`` keeps the blanks."""
    return of(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\s—–-]+", " ")))


def pieces(text: Column) -> Column:
    """Words between white space, hyphens and dashes; no empty ones."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\s—–-]+"), lambda w: w != "")


#: For whole texts, what ``plain`` and ``word_key`` make of a letter, and blanks for what is between words.
_WHOLE = {c: x.translate(_LEVEL) for c, x in _BARE.items()} | {"ſ": "s", "v": "u", "j": "i", "y": "i"} | dict.fromkeys("\t\n\x0b\f\r—–-", " ")


def keys(text: Column) -> Column:
    """The word keys of a text in order; every ``&`` reads as a word ``and`` and empty keys go.

    They are ``word_key`` of its ``pieces``, told by a few passes over the text in place of several over each word.
    """
    k = F.translate(F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("&"), F.lit(" and "))), "".join(_WHOLE), "".join(_WHOLE.values()))
    k = F.regexp_replace(F.replace(F.regexp_replace(k, "[^a-z ]+", ""), F.lit("ck"), F.lit("c")), r"([a-z])\1+", "$1")
    # endings are looked for by their last letters, as few places have them
    k = F.regexp_replace(F.regexp_replace(k, "e(?![a-z])(?<=[a-z]e)", ""), "ed(?![a-z])(?<=[a-z]{2}ed)", "d")
    return F.filter(F.split(F.regexp_replace(k, "t(?![a-z])(?<=[pkcsx]t)", "d"), " "), lambda k: k != "")


def candidates(text: Column) -> Column:
    """Letters with inner apostrophes."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(\p{L}+(?:['’]\p{L}+)*)"), 1)


def phrase_words(text: Column) -> Column:
    """Words of letters and apostrophes, lone apostrophes left out."""
    level = F.regexp_replace(F.coalesce(text, F.lit("")), "’", "'")
    return F.filter(F.split(F.regexp_replace(level, r"[^\p{L}' ]", " "), r"\s+"), lambda w: ~w.isin("", "'"))


def title_key(c: Column) -> Column:
    """Lower case, letters and digits only."""
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", "")


def sort_title(c: Column) -> Column:
    """Lower case without a leading article."""
    return F.regexp_replace(F.lower(c), r"^(the|a|an)\s+", "")


def slug(c: Column) -> Column:
    """Lower-case words of a-z and digits joined by hyphens."""
    return F.regexp_replace(F.regexp_replace(plain(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def number_parts(c: Column) -> Column:
    """A dotted number as an array that sorts by its numbers."""
    return F.split(c, r"\.").cast("array<int>")


def is_form_of(word: Column, head: Column) -> Column:
    """Equal, or at most three letters longer than the headword it begins with."""
    return word.startswith(head) & (F.length(word) - F.length(head) <= 3)


def equivalent(a: Column, b: Column) -> Column:
    """Two arrays of as many words, each pair within a third of the longer word's letters."""
    near = lambda x, y: F.levenshtein(x, y) <= F.ceil(F.greatest(F.length(x), F.length(y)) / 3)
    return (F.size(a) == F.size(b)) & F.forall(F.zip_with(a, b, near), lambda ok: ok)


def roman(c: Column) -> Column:
    """The value of a Roman numeral in any case; null for anything else."""
    value = F.create_map(*[F.lit(x) for pair in {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}.items() for x in pair])
    digits = F.transform(F.split(F.lower(c), ""), lambda d: F.element_at(value, d))
    signed = F.zip_with(digits, F.slice(F.concat(digits, F.array(F.lit(0))), 2, F.size(digits)), lambda a, b: F.when(a < b, -a).otherwise(a))
    return F.when(F.lower(c).rlike("^[ivxlcdm]+$"), F.aggregate(signed, F.lit(0), lambda t, x: t + x))


def common_prefix(a: Column, b: Column) -> Column:
    """How many characters two texts begin with alike."""
    same = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x.eqNullSafe(y))
    return F.coalesce(F.nullif(F.array_position(same, False), F.lit(0)) - 1, F.length(a)).cast("int")


def common_suffix(a: Column, b: Column) -> Column:
    """How many characters two texts end with alike."""
    return common_prefix(F.reverse(a), F.reverse(b))


def safe_url(c: Column) -> Column:
    """Whether a url is http or https."""
    return F.coalesce(F.lower(F.try_parse_url(c, F.lit("PROTOCOL"))).isin("http", "https"), F.lit(False))


def authors(names: Column, most: int = 3) -> Column:
    """The first names joined by commas, ``et al.`` after more than ``most``."""
    return F.concat(F.array_join(F.slice(names, 1, most), ", "), F.when(F.size(names) > most, " et al.").otherwise(""))


def name_list(names: Column) -> Column:
    """``a, b and c`` of an array of names."""
    n = F.size(names)
    return F.when(n < 2, F.array_join(names, "")).otherwise(F.concat_ws(" and ", F.array_join(F.slice(names, 1, F.greatest(n - 1, F.lit(1))), ", "), F.element_at(names, -1)))
