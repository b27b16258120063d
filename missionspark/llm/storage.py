"""Tables that cut lineage, in the shared folder of the library's :mod:`missionspark.sources.storage`."""

from ..sources.storage import discard, materialise, new_path, release, shared_dir, small

__all__ = ["discard", "materialise", "new_path", "release", "shared_dir", "small"]
