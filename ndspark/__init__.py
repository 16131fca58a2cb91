"""A Spark-native engine for chunked, compressed N-dimensional arrays."""

from importlib import import_module

__version__ = "0.1.0"
_NAMES = {
    "ArrayFrame": "operators.frame", "Group": "operators.group", "open_node": "operators.group",
    "cached_array": "operators.group", "open_store": "sources.stores", "write_zip": "sources.stores",
    "append_stream": "streaming", "register": "sources.array_source",
}


def __getattr__(name: str):
    """Names of the API, imported when they are first used: Python workers need few of them."""
    if name in _NAMES:
        return getattr(import_module(f"{__name__}.{_NAMES[name]}"), name)
    raise AttributeError(name)
