"""lodestrata: incremental passage indexing and retrieval as Spark plans."""

from importlib import import_module

__version__ = "0.1.0"

#: Where the names that the package offers are defined; each module is imported when its name is first used.
_HOMES = {
    "build_index": "plans.indexer", "BuildReport": "plans.indexer", "SourceReader": "plans.reader", "SearchOptions": "schema", "SearchResult": "schema",
    "IndexedChunk": "schema", "SnapshotStore": "sources.store", "Router": "sources.discovery", "Embedder": "embed", "HashingEmbedder": "embed",
    "register_embedder": "embed", "register_strategy": "chunking.strategies", "watch": "streaming.watch",
}
__all__ = ["__version__", *_HOMES]


def __getattr__(name: str):
    if name not in _HOMES:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    return getattr(import_module(f"{__name__}.{_HOMES[name]}"), name)
