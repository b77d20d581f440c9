"""Backends by name.  A backend compresses the chunk rows' ``_body`` and adds ``_out`` and ``_dropped``."""

from __future__ import annotations

import warnings
from importlib import metadata

from pyspark.sql import DataFrame

from ..functions import lexicon
from ..operators import ranker, rules

ENTRY_POINTS = "quillmill.backends"
PREFERRED = ("rules", "ranker", "cascade")


class BackendNotFoundError(KeyError):
    """No backend has this name."""


class Backend:
    """Base of backends; options that only the constructor takes are named in ``construction_only``."""

    name = ""
    description = ""
    extra: str | None = None
    generative = False
    requires_configuration = False
    construction_only: tuple[str, ...] = ()
    language: str | lexicon.Language = "en"
    #: Whether ``compress`` leaves rows where they are; else they are brought together again by an exchange.
    keeps_order = True

    @classmethod
    def is_available(cls) -> bool:
        return True

    @classmethod
    def require_available(cls) -> None:
        if not cls.is_available():
            raise ImportError(f"backend {cls.name!r} is not available" + (f"; it needs {cls.extra}" if cls.extra else ""))

    def compress(self, rows: DataFrame, rate: float, text: str, out: str) -> DataFrame:
        """``rows`` with the columns ``out`` and ``out``_dropped."""
        raise NotImplementedError


_KNOWN: dict[str, type[Backend]] = {}
_looked = False


def register_backend(cls: type[Backend]) -> type[Backend]:
    if not cls.name:
        raise ValueError("a backend needs a name")
    if _KNOWN.get(cls.name, cls) is not cls:
        raise ValueError(f"there is a backend {cls.name!r} already")
    _KNOWN[cls.name] = cls
    return cls


def unregister_backend(name: str) -> None:
    get_backend(name)
    del _KNOWN[name]


def _discover() -> None:
    global _looked
    if _looked:
        return
    _looked = True
    for e in metadata.entry_points(group=ENTRY_POINTS):
        try:
            register_backend(e.load())
        except Exception as why:  # a broken plugin must not take the others along
            warnings.warn(f"backend plugin {e.name!r} could not be loaded: {why}", stacklevel=2)


def list_backends() -> list[str]:
    _discover()
    return sorted(_KNOWN)


def get_backend(name: str) -> type[Backend]:
    _discover()
    if name not in _KNOWN:
        raise BackendNotFoundError(f"no backend {name!r}; there are: {', '.join(list_backends())}")
    return _KNOWN[name]


def create_backend(name: str, **options) -> Backend:
    cls = get_backend(name)
    cls.require_available()
    return cls(**options)


def backend_info() -> list[dict]:
    keys = ("name", "description", "extra", "generative", "requires_configuration")
    return [{k: getattr(get_backend(n), k) for k in keys} | {"available": get_backend(n).is_available()} for n in list_backends()]


def default_backend_name() -> str:
    for name in (*PREFERRED, *list_backends()):
        if name in _KNOWN and _KNOWN[name].is_available() and not _KNOWN[name].requires_configuration:
            return name
    raise BackendNotFoundError("no backend is available")


@register_backend
class RulesBackend(Backend):
    name = "rules"
    description = "Composable word and phrase rules with language packs."
    construction_only = ("language", "rules", "keep_words", "keep_patterns")

    def __init__(self, *, language: str | lexicon.Language = "en", rules: lexicon.RuleSet | None = None, keep_words=frozenset(), keep_patterns=()) -> None:
        self.language = lexicon.get_language(language)
        self.options = {"rules": rules, "keep_words": frozenset(keep_words), "keep_patterns": tuple(keep_patterns)}

    def compress(self, rows: DataFrame, rate: float, text: str, out: str) -> DataFrame:
        return rules.compress(rows, rate, text=text, out=out, language=self.language, **self.options)


@register_backend
class RankerBackend(Backend):
    name = "ranker"
    description = "Keeps the words that a scorer ranks highest; negations and numbers stay."
    construction_only = ("scorer", "language", "force_tokens")

    def __init__(self, *, scorer: ranker.Scorer = ranker.length_scores, language: str | lexicon.Language = "en", force_tokens=frozenset()) -> None:
        self.scorer, self.language, self.force = scorer, lexicon.get_language(language), frozenset(force_tokens)
        self.keeps_order = not getattr(scorer, "moves_rows", False)

    def compress(self, rows: DataFrame, rate: float, text: str, out: str) -> DataFrame:
        return ranker.select(rows, rate, text=text, out=out, scorer=self.scorer, language=self.language, force_tokens=self.force)


@register_backend
class CascadeBackend(Backend):
    name = "cascade"
    description = "Rules first, then the ranker on what is left."
    construction_only = ("scorer", "language")

    def __init__(self, *, scorer: ranker.Scorer = ranker.length_scores, language: str | lexicon.Language = "en") -> None:
        self.scorer, self.language = scorer, lexicon.get_language(language)
        self.keeps_order = not getattr(scorer, "moves_rows", False)

    def compress(self, rows: DataFrame, rate: float, text: str, out: str) -> DataFrame:
        done = ranker.cascade(rows, rate, text=text, out=out, scorer=self.scorer, language=self.language)
        return done.drop(f"{out}_rules_ratio", f"{out}_inner")
