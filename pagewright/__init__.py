"""Grounded reading and retrieval over tables of documents.

The public names are found on first use, so that workers load only what they run.
"""

from importlib import import_module

__version__ = "0.2.0"

#: Public names by module.
_PUBLIC = {
    "errors": ("BackendError", "BudgetExhausted", "DocumentError", "EngineError", "ReplyError"),
    "functions.text": ("flatten", "grounded", "normalize", "tokenize"),
    "host": ("Runner", "document_map", "trace_json", "trace_text", "write_traces"),
    "operators.bm25": ("hits", "term_report"),
    "operators.outline": ("render",),
    "operators.pack": ("excerpts", "full_excerpts"),
    "operators.rank": ("fuse", "signals", "uses_enrichment", "view_counts"),
    "operators.reading": ("Index", "Limits", "index", "read"),
    "operators.report": ("flat_answers", "plain_results", "rollup"),
    "operators.segment": ("build_units", "children_of", "node_id", "page_node_id", "page_ref", "refs", "unit", "unit_kind"),
    "sources.chat": ("Chat", "OllamaChat", "OpenAIChat", "message"),
    "sources.docjson": ("DefaultRules", "elements", "project", "read_files"),
    "types": ("Iteration", "ROWS", "Result", "RunStatus", "StructuredMode", "UnitKind"),
}
_HOME = {name: module for module, names in _PUBLIC.items() for name in names}
__all__ = ["__version__", *sorted(_HOME)]


def __getattr__(name: str):
    if name not in _HOME:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    return getattr(import_module(f"{__name__}.{_HOME[name]}"), name)


def __dir__() -> list[str]:
    return [*globals(), *_HOME]
