from gaugework.sources.files import export_filtered, malformed_lines, read_observations, read_table, write_csv, write_table

__all__ = ["export_filtered", "malformed_lines", "read_observations", "read_table", "write_csv", "write_table"]
