"""Knowledge-graph ids and labels inside query text, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed patterns. An id is letters, a colon, letters, digits; a label is the prefix and digits.
# Word characters are letters, numbers and underscore of any script; digits are decimal digits
# of any script. Possessive repeats and the look-behind on letters leave the matches as they are
# and keep the search linear in the text, whatever its longest run of letters.
_WORD = r"[\p{L}\p{N}_]"
_EID = r"[a-zA-Z]++:[a-zA-Z]++\p{Nd}++"
EID = rf"(?<![a-zA-Z]){_EID}"
EID_BOUNDED = rf"(?<!{_WORD}){_EID}(?!{_WORD})"
LABEL_BOUNDED = rf"(?<!{_WORD})ENTITY_\p{{Nd}}++(?!{_WORD})"


def extract_eids(text: Column) -> Column:
    """All ids in the text, bounded or not, left to right."""
    return F.regexp_extract_all(text, F.lit(EID), F.lit(0))


def extract_bounded_eids(text: Column) -> Column:
    """The ids that stand as whole words: the ones a rewrite replaces."""
    return F.regexp_extract_all(text, F.lit(EID_BOUNDED), F.lit(0))


def extract_labels(text: Column) -> Column:
    """All labels that stand as whole words, left to right, repeats kept."""
    return F.regexp_extract_all(text, F.lit(LABEL_BOUNDED), F.lit(0))


def stitch(text: Column, replacements: Column) -> Column:
    """Put one replacement for every bounded id, in order, back between the other text."""
    between = F.split(text, EID_BOUNDED, -1)
    ends = F.concat(replacements, F.array(F.lit("")))
    return F.array_join(F.flatten(F.zip_with(between, ends, lambda a, b: F.array(a, b))), "")


def numbered_label(number: Column, width: Column | int) -> Column:
    """``ENTITY_`` and the number, zero-padded to ``width`` digits."""
    width = F.lit(width) if isinstance(width, int) else width
    return F.concat(F.lit("ENTITY_"), F.lpad(number.cast("string"), width, F.lit("0")))
