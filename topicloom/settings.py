"""Fixed values and defaults. Every operator takes them as parameters."""

from __future__ import annotations

from dataclasses import dataclass

# --- fixed values: sentinels written where an article lacks a field ---------
NO_TEXT = "Без текста"
NO_TITLE = "Без названия"
NO_HUBS = "Без хабов"
NO_TAGS = "Без тегов"
NO_DATE = "Без даты"
NO_SUMMARY = "Без саммари"

# --- fixed values: label cleaning -------------------------------------------
BLOG_PREFIX = "блог"
NAME_FIXES = ((r"Распредел.+ые системы", "Распределённые системы"),)

# --- fixed values: site layout ----------------------------------------------
HOST = "https://habr.com"
LISTING_URL = HOST + "/ru/hubs/%s/articles/page%d/"
ARTICLE_ID = r"/articles/([0-9]+)"
PAGE_NUMBER = r"/page([0-9]+)(?:/|$)"
HUBS = ("artificial_intelligence", "popular_science", "programming")
PAGE_CAP = 20

# --- fixed values: sequences and splits -------------------------------------
UNK = "<unk>"
UNK_ID = 0
PAD_ID = 0
MAX_LEN = 4096
SERVE_MAX_LEN = 90
PREVIEW_CHARS = 200
SEED = 42
TEST_PART = 0.2
VAL_PART = 0.05
BEST_RUNS = 5


@dataclass(frozen=True)
class Selector:
    """An HTML element by tag and, optionally, one attribute value.

    ``exact`` compares the whole attribute; otherwise one of its
    space-separated words has to be equal (the usual class rule).
    """

    tag: str
    attr: str | None = None
    value: str | None = None
    exact: bool = False


@dataclass(frozen=True)
class Layout:
    """Where the fields of an article are on its page."""

    body: Selector = Selector("div", "id", "post-content-body", exact=True)
    title: Selector = Selector("h1", "class", "tm-title tm-title_h1", exact=True)
    hubs: Selector = Selector("span", "class", "tm-publication-hub__link-container")
    tags: Selector = Selector("meta", "name", "keywords", exact=True)
    tags_attr: str = "content"
    date: Selector = Selector("time")
    date_attr: str = "title"
    link: Selector = Selector("a", "class", "tm-title__link")
    pager: Selector = Selector("a", "class", "tm-pagination__page")


DEFAULT_LAYOUT = Layout()
