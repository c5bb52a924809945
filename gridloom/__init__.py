"""Gridloom: a PySpark analytics engine for operating a sharded fleet of data stores."""

__version__ = "0.1.0"
