from tablewash.functions.names import c, q
from tablewash.functions.missing import is_missing, normalize_nan, missing_count
from tablewash.functions.text import WHITESPACE, unicode_trim, title_case

__all__ = ["c", "q", "is_missing", "normalize_nan", "missing_count", "WHITESPACE", "unicode_trim", "title_case"]
