"""tidelog: an indexed, append-only message log and query engine on PySpark."""
