"""Where version logs come from: tables, stores of Parquet generations, and raw log and table files."""
