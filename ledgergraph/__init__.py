"""ledgergraph: business documents to a typed graph, and questions over it, as Spark jobs."""

__version__ = "0.1.0"
