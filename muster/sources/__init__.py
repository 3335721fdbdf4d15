"""Readers. Each gives the same cells frame: source, file, kind, n_sheets, sheet_idx, sheet_name, table_id, row_pos,
col_idx, value, error.

A file that can't be read gives a row with an error, never a failed job.
"""

from .readers import errors, label_sheets, read_cells, read_csv, read_errors, read_lines, read_office

__all__ = ["errors", "label_sheets", "read_cells", "read_csv", "read_errors", "read_lines", "read_office"]
