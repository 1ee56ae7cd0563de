"""memlift: a PySpark-native engine that measures what a memory store adds to question answering."""
