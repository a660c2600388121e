"""Which labels name an option, and which a wood."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import stripped

# Patterns of option labels, option codes and woods.
OPTION = r"(?i)(\bcat\.?\s*[123]\b|\bcolor|\bfabric|\bleather|\bpoly\b|\bwoodgrain|\bcom\b|\bpremium\b|\bstandard\b|\bultra\b|\bglazed?\b|\bpaint\b|\bbright\b|\btropical\b|\bupholster|^black$|^white$|^brown$|^grey$|^gray$|^green$|^blue$|^red$)"
OPTION_CODE = r"(?i)^(cat\.?\s*[123]|-?\d{2,3}[A-Z]{0,4}|-[A-Z]{2,6})$"
OPTION_SURE = r"(?i)color|fabric|leather|poly|woodgrain|premium|standard|cat\.?"
WOOD = r"(?i)\b(oak|maple|cherry|walnut|hickory|elm|birch|ash|poplar|pine|alder|beech|mahogany|qswo|pswo|qsw|wormy|rustic|quarter\s*sawn|rough\s*sawn|ruff\s*sawn|barnwood|cedar)\b"
NO_WOOD = r"(?i)^([\d$#+%.\-\"']+|and|or|the|with|also|add|option|species|stain|part|number|color|r\.?|combo|standard|premium|unf\.?|fin\.?|wood|tier|quarter)$"
WOOD_TIER = r"(?i)^wood\s*tier\s*\d+$"
NO_OPTION = r"(?i)^(finished|unfinished|finshed|none|null|nan|n/?a)$"
CHARGE = r"(?i)[@$%]|\+\d|option:|stain part"


def _fits(s: Column, least: int) -> Column:
    return F.length(s).between(least, 48)


def is_option(x: Column, stored_as_option: bool = False) -> Column:
    """Whether a label belongs among options; a stored option key does unless it is punctuation, a charge or a finish."""
    s = stripped(x)
    base = _fits(s, 1) & ~s.rlike(NO_OPTION) & ~s.rlike(CHARGE + "|electrical control")
    if stored_as_option:
        return F.coalesce(base & ~s.rlike(r"^[\s.\-_/'\"]+$"), F.lit(False))
    return F.coalesce(base & (s.rlike(OPTION_CODE) | (s.rlike(OPTION) & ~(s.rlike(WOOD) & ~s.rlike(OPTION_SURE)))), F.lit(False))


def is_wood(x: Column) -> Column:
    s = stripped(x)
    plain = _fits(s, 2) & ~s.rlike(r"^\d+(\.\d+)?$") & ~s.rlike(NO_WOOD) & ~s.rlike(CHARGE)
    return F.coalesce(plain & (s.rlike(WOOD_TIER) | (~is_option(s) & s.rlike(WOOD))), F.lit(False))
