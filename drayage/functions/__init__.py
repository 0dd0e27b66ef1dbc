"""Column functions shared by the operators."""

from drayage.functions.casts import (
    coded, lenient_int, minute_of, money, parse_number, zero_if_null, zoneless,
)
from drayage.functions.names import check_identifier, result_path, slug

__all__ = [
    "check_identifier", "coded", "lenient_int", "minute_of", "money", "parse_number",
    "result_path", "slug", "zero_if_null", "zoneless",
]
