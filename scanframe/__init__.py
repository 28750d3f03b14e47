"""Static code and text security scanning as DataFrame transformations."""

_EXPORTS = {
    "detect": "scanframe.plans.scan",
    "scan": "scanframe.plans.scan",
    "scan_coverage": "scanframe.plans.scan",
    "scan_covered": "scanframe.plans.scan",
    "register_detector": "scanframe.plans.scan",
    "ranked": "scanframe.operators.findings",
    "summary": "scanframe.operators.findings",
    "files_from_table": "scanframe.sources.files",
    "files_from_tree": "scanframe.sources.files",
    "write_report": "scanframe.sources.sinks",
    "save_report": "scanframe.sources.sinks",
    "register": "scanframe.functions.sql",
}
__all__ = list(_EXPORTS)


def __getattr__(name: str):
    """Exports are loaded on first use, so that workers load only what they run."""
    if name not in _EXPORTS:
        raise AttributeError(name)
    from importlib import import_module

    return getattr(import_module(_EXPORTS[name]), name)
