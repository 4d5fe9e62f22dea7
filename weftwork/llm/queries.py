"""Importing this module registers the queries of all operators; ``QUERIES`` and ``SQL`` hold them."""

import importlib

from weftwork.llm.common import QUERIES, SQL  # noqa: F401

for _name in ("quality", "sharding", "warc", "chat", "tokens", "lines", "mixing", "ngram_join", "decontaminate", "toxicity", "fim", "url_filter", "whitening"):
    importlib.import_module(f"weftwork.llm.{_name}")
