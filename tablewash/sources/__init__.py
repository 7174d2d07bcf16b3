from tablewash.sources.census import census_of_files, file_census
from tablewash.sources.readers import (
    detect_key, flatten, key_candidate, read_any, read_csv, read_json, read_json_with_rejects,
)
from tablewash.sources.vocabulary import clean_vocabulary, load_vocabulary
from tablewash.sources.workbook import read_workbook, workbook_rows

__all__ = [
    "census_of_files", "file_census", "detect_key", "flatten", "key_candidate", "read_any", "read_csv", "read_json",
    "read_json_with_rejects", "clean_vocabulary", "load_vocabulary", "read_workbook", "workbook_rows",
]
