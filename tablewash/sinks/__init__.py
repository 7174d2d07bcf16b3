from tablewash.sinks.writers import (
    jdbc_url, to_documents, write_csv, write_documents, write_jdbc, write_parquet, write_table, write_to,
)

__all__ = ["jdbc_url", "to_documents", "write_csv", "write_documents", "write_jdbc", "write_parquet", "write_table", "write_to"]
