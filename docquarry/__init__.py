"""docquarry: document retrieval and corpus preparation expressed as Spark plans."""

__version__ = "0.1.0"
