"""Files in and out."""

from .model import load, save
from .sources.export import flashlfq_input, to_readable, write_csv, write_flashlfq_input
from .sources.readers import read_diann, read_fragpipe, read_maxquant, read_sage
from .sources.tables import read_table

__all__ = ["flashlfq_input", "load", "read_diann", "read_fragpipe", "read_maxquant", "read_sage", "read_table", "save", "to_readable", "write_csv", "write_flashlfq_input"]
