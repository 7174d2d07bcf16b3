from tablewash.operators.clean import (
    drop_cols_any, drop_rows_any, fill_literal, fill_mean, fill_median, fill_mode, handle_missing,
    numeric_columns, remove_duplicates, replace_zeros, standardize_case, text_columns, trim_text,
)
from tablewash.operators.casts import fix_types, infer_types, na_to_null
from tablewash.operators.profile import (
    column_types, duplicate_summary, missing_by_column, preview, profile_table, snapshot, snapshot_long,
)
from tablewash.operators.membership import keep_known
from tablewash.operators.sequence import number_rows, running_total, with_file_ordinal, with_row_ordinal
from tablewash.operators.sort import sort_by
from tablewash.operators.union import union_by_name
