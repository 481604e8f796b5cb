"""Readers and writers."""

from millrace.sources.files import document_text, read_documents, write_documents  # noqa: F401
from millrace.sources.tables import (  # noqa: F401
    append_columns,
    jdbc_table,
    read_json,
    read_snapshot,
    read_table,
    run_sql,
    save_typed_table,
    write_csv,
    write_jdbc,
    write_snapshot,
)
