"""Importing this module registers every query of the subpackage."""

from arbora.llm import (fuzzy_lines, id_files, language_id, maxent, near_docs, packing, prefix_trie, quality,  # noqa: F401
                        repeats, simhash, spelling, templates, warc)
from arbora.llm.registry import ORACLES, REGISTRY

__all__ = ["ORACLES", "REGISTRY"]
