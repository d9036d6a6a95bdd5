"""notegrid: analytics over large collections of typed documents, as Spark plans."""
