"""Nucleotide expressions. All are Spark expressions and stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The IUPAC codes and their bases, and the complements.
DEGENERATE = {
    "R": "AG", "Y": "CT", "S": "CG", "W": "AT", "K": "GT", "M": "AC",
    "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT",
}
COMPLEMENT = ("ACGTRYSWKMBDHVN", "TGCAYRSWMKVHDBN")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def letters(sequence: Column | str) -> Column:
    """The characters of a sequence; an empty sequence has none."""
    return F.array_remove(F.split(col(sequence), ""), "")


def variants(sequence: Column | str) -> Column:
    """All readings of a sequence with degenerate codes, sorted."""
    codes = F.create_map(*(x for k, v in DEGENERATE.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))

    def grown(so_far: Column, letter: Column) -> Column:
        bases = F.coalesce(F.try_element_at(codes, letter), F.array(letter))
        return F.flatten(F.transform(so_far, lambda p: F.transform(bases, lambda b: F.concat(p, b))))

    sequence = col(sequence)
    expanded = F.array_sort(F.aggregate(letters(sequence), F.array(F.lit("")), grown))
    return F.when(sequence.rlike(f"[{''.join(DEGENERATE)}]"), expanded).otherwise(F.array(sequence))


def reverse_complement(sequence: Column | str) -> Column:
    return F.reverse(F.translate(col(sequence), *COMPLEMENT))


def reverse_complement_text(sequence: str) -> str:
    return sequence.translate(str.maketrans(*COMPLEMENT))[::-1]


def hamming(a: Column | str, b: Column | str) -> Column:
    """Places at which two sequences of one length differ, letter by letter."""
    differ = F.zip_with(F.split(col(a), ""), F.split(col(b), ""), lambda x, y: (~x.eqNullSafe(y)).cast("int"))
    return F.aggregate(differ, F.lit(0), lambda n, d: n + d)


def count_degenerates(sequence: Column | str) -> Column:
    """Letters other than A, C, G and T."""
    return F.length(F.regexp_replace(col(sequence), "[ACGT]", ""))


def db_seq(name: Column | str) -> Column:
    """The id before a variant's number."""
    return F.split_part(col(name), F.lit("@"), F.lit(1))


def split_ids(ids: Column | str) -> Column:
    return F.split(col(ids), "[|]")


def join_ids(ids: Column) -> Column:
    return F.array_join(F.array_sort(ids), "|")


def short(ids: Column | str) -> Column:
    """A key for an id set: itself, or for a long one its beginning, hash and length.

    Sets are as long as groups, and rows as many; keys are what rows can be moved
    and grouped by. A key of the second kind begins with ``|``, which no set does.
    """
    c = col(ids)
    key = F.concat_ws("|", F.lit(""), F.substring(c, 1, 24), F.hex(F.xxhash64(c)), F.octet_length(c).cast("string"))
    return F.when(F.octet_length(c) <= 64, c).when(c.isNotNull(), key)


def primer_pattern(primer: Column | str) -> Column:
    """A primer as a regular expression: each code becomes its class of bases."""
    out = col(primer)
    codes = F.create_map(*(x for k, v in DEGENERATE.items() for x in (F.lit(k), F.lit(f"[{v}]"))))
    return F.array_join(F.transform(letters(out), lambda c: F.coalesce(F.try_element_at(codes, c), c)), "")


def primer_pattern_text(primer: str, errors: int | None = None) -> str:
    """The same for a string; with ``errors`` in the syntax of fuzzy matching,
    where the first letter must match and the rest may differ so often."""
    parts = [f"[{DEGENERATE[c]}]" if c in DEGENERATE else c for c in primer]
    if errors is None:
        return "".join(parts)
    return f"((?<=({parts[0]})))(({''.join(parts[1:])}){{e<={errors}}})"


def find_end(sequence: Column, pattern: Column) -> Column:
    """The offset behind the first match, or null."""
    at = F.regexp_instr(sequence, pattern)
    return F.when(at > 0, at - 1 + F.length(F.regexp_substr(sequence, pattern)))


def find_start(sequence: Column, pattern: Column) -> Column:
    """The offset of the first match, or null."""
    at = F.regexp_instr(sequence, pattern)
    return F.when(at > 0, at - 1)
