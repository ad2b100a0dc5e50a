"""Registers a relational query with its SQL, under the inventory's identifiers."""

from __future__ import annotations

from collections.abc import Callable

from vellum import registry
from vellum.plans.base import book_fixture
from vellum.plans.dialect import DUCK, Text, over_folder, over_views


def query(ids: str, name: str = "", about: str = "", made: bool = False) -> Callable[[Text], Text]:
    """Those about books, and where made is set those about rare signs, run over documents made into books (see base.book_fixture); as functions they take any documents."""

    def take(text: Text) -> Text:
        key = name or text.__name__
        documents = book_fixture if made or "\nbook AS (" in text(DUCK) else None
        registry.register(key, over_folder(text, documents), over_views(text, documents), ids.split(), about or (text.__doc__ or "").strip())
        return text

    return take


def native(ids: str, name: str, about: str = "", sql: str | None = None) -> Callable:
    """For queries that are functions of (spark, sf_dir)."""

    def take(run: Callable) -> Callable:
        registry.register(name, run, sql, ids.split(), about or (run.__doc__ or "").strip())
        return run

    return take
