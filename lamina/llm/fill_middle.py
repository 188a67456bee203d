"""Fill-in-the-middle: documents cut at token boundaries into prefix, middle and suffix.

A text's tokens are maximal runs of A-Z and a-z, and every other code point alone. No token is ever
listed. One byte for each code point says whether it is a letter (bytes.translate); read as one
binary number, shifted against itself, these bits mark where tokens start; their bit_count is the
number of tokens, and the start of the k-th token is the k-th set bit, found by halving the number.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.llm.common import LOWER, UPPER, free, with_columns

_BITS = bytes.maketrans(bytes(range(256)), bytes(ord("1") if chr(c) in UPPER + LOWER else ord("0") for c in range(256)))


def token_starts(text: str) -> int:
    """Bit i is set if a token starts at code point i."""
    # latin-1 keeps one byte for each code point; those it lacks become '?', no letter either
    digits = text.encode("latin-1", "replace").translate(_BITS)[::-1]
    letters = int(digits or b"0", 2)
    return ((1 << len(text)) - 1) & ~(letters & letters << 1)


def ranked_bit(number: int, width: int, rank: int) -> int:
    """The place of the set bit that has ``rank`` set bits below it, among ``width`` bits; ``width``
    if there is none. Each step keeps one half, so all steps together read the number twice."""
    at, end = 0, width
    if rank >= number.bit_count():
        return end
    while width > 1:
        half = width >> 1
        low = number & ((1 << half) - 1)
        below = low.bit_count()
        if rank < below:
            number, width = low, half
        else:
            number, width, rank, at = number >> half, width - half, rank - below, at + half
    return at


def transformed(key: str, text: str, sentinels: tuple[str, str, str], fim_percent: int, spm_percent: int) -> tuple[int, str, int | None, int | None, str]:
    """(n, form, prefix_chars, middle_chars, output) of one text; ``key`` seeds the draws."""
    pre, suf, mid = sentinels
    starts = token_starts(text)
    n = starts.bit_count()
    seed = hashlib.sha256(key.encode()).hexdigest()
    h1, h2, h3, h4 = (int(seed[8 * k : 8 * k + 8], 16) for k in range(4))
    if not text or any(s in text for s in sentinels) or h3 % 100 >= fim_percent:
        return n, "plain", None, None, text
    a, b = (ranked_bit(starts, len(text), k) for k in sorted((h1 % (n + 1), h2 % (n + 1))))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < spm_percent:
        return n, "spm", a, b - a, f"{suf}{suffix}{pre}{prefix}{mid}{middle}"
    return n, "psm", a, b - a, f"{pre}{prefix}{suf}{suffix}{mid}{middle}"


def fill_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sentinels: tuple[str, str, str] = ("<P>", "<S>", "<M>"), fim_percent: int = 90, spm_percent: int = 20, seed: str = "1") -> DataFrame:
    """``docs`` with columns n (tokens, long), form (plain, psm or spm), prefix_chars, middle_chars
    (code points, null if plain) and output. ``sentinels`` stand before prefix, suffix and middle.

    The draws come from the sha256 of seed, a colon and the id, so a row's result depends on
    its id and text alone: repeated rows get equal results, repeated ids with other texts the same
    draws. A null id counts as empty. Null or empty text: n 0, plain, output empty. A text that
    contains a sentinel stays plain, so that restored() is exact for every row. Texts of any length
    are read whole, in memory of a few times their size. Empty table: no rows. Other columns pass
    through; a new column whose name is taken gets an underscore.
    """
    text = free(docs, "__fim_text")
    ids = F.replace(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit("\n"), F.lit(" "))
    # id and text travel as one string, the id up to the first line feed
    joined = docs.withColumn(text, F.concat(F.lit(f"{seed}:"), ids, F.lit("\n"), F.coalesce(F.col(text_col), F.lit(""))))

    def make(rows: list[str]):
        cut = (r.partition("\n") for r in rows)
        return list(zip(*(transformed(k, t, sentinels, fim_percent, spm_percent) for k, _, t in cut), strict=True)) or [[]] * 5

    fields = {"n": "long", "form": "string", "prefix_chars": "long", "middle_chars": "long", "output": "string"}
    return with_columns(joined, fields, make, text).drop(text)


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = ("<P>", "<S>", "<M>")) -> Column:
    """The text that an output was made from. Null for a null form."""
    parts = F.split(output, "|".join(rf"\Q{s}\E" for s in sentinels), -1)
    return F.when(form == "plain", output).when(form == "psm", F.concat(parts[1], parts[3], parts[2])).when(form == "spm", F.concat(parts[2], parts[3], parts[1]))
