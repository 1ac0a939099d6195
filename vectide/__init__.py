"""A retrieval engine on Spark: vectors, keywords, metadata filters, and their fusion."""

from .client import Client, RemoteCollection
from .functions.embedding import EmbeddingFunction
from .plans.catalog import Collection, Database

__all__ = ["Client", "Collection", "Database", "EmbeddingFunction", "RemoteCollection"]
