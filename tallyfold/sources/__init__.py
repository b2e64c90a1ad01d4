from tallyfold.sources.folders import new_shared_folder
from tallyfold.sources.tables import read_table, stream_table

__all__ = ["new_shared_folder", "read_table", "stream_table"]
