"""Column builders for names, strands, coordinates and matching rules. Coordinates are zero based, on the + strand."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The nucleotide codes and their complements, in the same order.
CODES = "ACGTMRWSYKVHDBacgtmrwsykvhdb"
COMPLEMENTS = "TGCAKYWSRMBDHVtgcakywsrmbdhv"


def species(name: Column) -> Column:
    return F.substring_index(name, ".", 1)


def chromosome(name: Column) -> Column:
    """What follows the first dot; empty without one."""
    return F.when(F.instr(name, ".") > 0, F.substring(name, F.instr(name, ".") + 1, F.length(name))).otherwise("")


def reverse_complement(text: Column) -> Column:
    """A character that is no code, N, X or gap is an error."""
    strange = text.rlike(f"[^{CODES}NnXx-]")
    return F.when(strange, F.raise_error(F.concat(F.lit("no nucleotide code in "), text)).cast("string")).otherwise(F.translate(F.reverse(text), CODES, COMPLEMENTS))


def bases(text: Column) -> Column:
    return F.length(F.replace(text, F.lit("-"), F.lit("")))


def sign(strand: Column) -> Column:
    return F.when(strand == "+", 1).otherwise(-1)


def pos_start(start: Column, strand: Column, source_length: Column) -> Column:
    """Place of the first base in text order."""
    return F.when(strand == "+", start).otherwise(source_length - start - 1)


def pos_left(start: Column, length: Column, strand: Column, source_length: Column) -> Column:
    """Leftmost place that the row covers."""
    return F.when(strand == "+", start).otherwise(source_length - (start + length))


def starts_with_any(name: Column, prefixes: list[str]) -> Column:
    """Bare prefixes: hg18 matches hg180.x too."""
    out = F.lit(False)
    for p in prefixes:
        out = out | name.startswith(p)
    return out


def wildcard(name: Column, pattern: str) -> Column:
    """Exact, or a prefix if the pattern ends with an asterisk."""
    return name.startswith(pattern[:-1]) if pattern.endswith("*") else name == pattern


def close_enough(a: Column, b: Column, near: int) -> Column:
    return F.abs(a - b) <= near


def subsequence(seq: Column, start: Column, n: Column, strand: Column) -> Column:
    """n bases from start on the given strand of the whole sequence."""
    forward = F.substring(seq, (start + 1).cast("int"), n.cast("int"))
    back = F.substring(seq, (F.length(seq) - start - n + 1).cast("int"), n.cast("int"))
    return F.when(strand == "+", forward).otherwise(reverse_complement(back))


def vignette(text: Column, offset: Column, flank: int = 5) -> Column:
    """The base at an offset among the text's bases between its neighbours, with dots where more bases follow."""
    plain = F.replace(text, F.lit("-"), F.lit(""))
    left = F.greatest(offset - flank, F.lit(0))
    after = F.substring(plain, (offset + 2).cast("int"), F.lit(flank))
    return F.concat(
        F.when(left > 0, "...").otherwise(""),
        F.substring(plain, (left + 1).cast("int"), (offset - left).cast("int")),
        F.lit(" ->"), F.substring(plain, (offset + 1).cast("int"), F.lit(1)), F.lit("<- "), after,
        F.when(offset + 1 + flank < F.length(plain), "...").otherwise(""),
    )
