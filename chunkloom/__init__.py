"""chunkloom: a PySpark-native engine for redundancy analytics over blobs, documents and logs."""

__version__ = "0.1.0"
