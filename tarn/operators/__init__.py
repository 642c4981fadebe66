"""Pure table-to-table operators, quality checks, publishing, profiling and retention."""
