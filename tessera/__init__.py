"""tessera: a PySpark-native engine for dense-retrieval data processing.

Every operator is a plain DataFrame -> DataFrame function; nothing here starts
a job on import.
"""
