"""tessera: a Spark-first engine for converting, reconstructing and querying heterogeneous files and text."""
