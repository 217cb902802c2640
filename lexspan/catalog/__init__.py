"""Named queries over the standard tables."""


def load():
    """Import every catalogue module once and return the registry."""
    import importlib

    from lexspan.catalog import registry

    for module in (
        "text", "sources", "structure", "metadata", "governance", "chunking", "vectors",
        "analysis", "retrieval", "ranking", "grounding", "evaluation", "integrity",
        "conversations", "streams", "search", "whole",
    ):
        try:
            importlib.import_module(f"lexspan.catalog.{module}")
        except ModuleNotFoundError as error:
            if error.name != f"lexspan.catalog.{module}":
                raise
    return registry
