"""Which pages to read and which links are new."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from topicloom.functions.html import attr_values, visible
from topicloom.operators.joins import unseen
from topicloom.operators.ranking import first_per_key
from topicloom.settings import DEFAULT_LAYOUT, HOST, HUBS, LISTING_URL, PAGE_CAP, PAGE_NUMBER, Selector


def hub_table(spark: SparkSession, hubs=HUBS) -> DataFrame:
    """The configured hubs with their order."""
    return spark.createDataFrame([(h, i) for i, h in enumerate(hubs)], "hub string, ord int")


def resume_from(hubs: DataFrame, last_hub: str | None) -> DataFrame:
    """Hubs from ``last_hub`` on; all of them if it is unknown."""
    start = hubs.where(F.col("hub") == F.lit(last_hub)).agg(F.max("ord"))
    first = F.coalesce(start.scalar(), F.lit(0))
    return hubs.where(F.col("ord") >= first)


def page_numbers(hrefs: Column, pattern: str = PAGE_NUMBER) -> Column:
    """Page numbers found in an array of links."""
    found = F.transform(
        hrefs, lambda h: F.regexp_extract(h, pattern, 1).try_cast("bigint")
    )
    return F.filter(found, lambda n: n.isNotNull())


def pager_links(html: Column, pager: Selector = DEFAULT_LAYOUT.pager) -> Column:
    """Targets of the pagination anchors of a listing page."""
    return attr_values(visible(html), pager, "href")


def last_page(pages: DataFrame, hub: Column, hrefs: Column, pattern: str = PAGE_NUMBER) -> DataFrame:
    """Largest page number linked per hub, at least 1."""
    rows = pages.select(
        hub.alias("hub"), F.coalesce(F.array_max(page_numbers(hrefs, pattern)), F.lit(1)).alias("n")
    )
    return rows.groupBy("hub").agg(F.greatest(F.max("n"), F.lit(1)).alias("last_page"))


def capped(last: Column, cap: int = PAGE_CAP) -> Column:
    """Pages to read of a hub; a cap of 0 or less means all."""
    return F.least(last, F.lit(cap).cast("bigint")) if cap > 0 else last


def page_urls(
    hubs: DataFrame, last_pages: DataFrame, cap: int = PAGE_CAP, template: str = LISTING_URL
) -> DataFrame:
    """``(hub, page, url)`` of all listing pages; a hub without pagination has one."""
    n = capped(F.coalesce(F.col("last_page"), F.lit(1)), cap)
    return (
        hubs.join(last_pages, "hub", "left")
        .select("hub", F.explode(F.sequence(F.lit(1).cast("bigint"), n)).alias("page"))
        .withColumn("url", F.format_string(template, "hub", "page"))
    )


def page_links(
    pages: DataFrame,
    keep: list[str],
    html: str = "html",
    host: str = HOST,
    link: Selector = DEFAULT_LAYOUT.link,
) -> DataFrame:
    """One row per article link on a listing page: ``keep``, position and URL."""
    hrefs = attr_values(visible(F.col(html)), link, "href")
    return pages.select(*keep, F.posexplode(hrefs).alias("pos", "href")).select(
        *keep, "pos", F.concat(F.lit(host), F.col("href")).alias("url")
    )


def new_links(links: DataFrame, store: DataFrame, order: list[Column]) -> DataFrame:
    """Links not stored yet, each URL once at its first place in ``order``."""
    return unseen(first_per_key(links, "url", order), store)


def link_report(hubs: DataFrame, links: DataFrame, fresh: DataFrame) -> DataFrame:
    """Found and new links per hub, zero for hubs without any."""
    found = links.groupBy("hub").agg(F.count(F.lit(1)).alias("found"))
    new = fresh.groupBy("hub").agg(F.count(F.lit(1)).alias("new"))
    zero = F.lit(0).cast("bigint")
    return (
        hubs.join(found, "hub", "left")
        .join(new, "hub", "left")
        .select(
            "hub",
            F.coalesce("found", zero).alias("found"),
            F.coalesce("new", zero).alias("new"),
        )
    )


def hubs_without_links(hubs: DataFrame, links: DataFrame) -> DataFrame:
    """Hubs no link was found for."""
    return hubs.join(links.select("hub").distinct(), "hub", "left_anti")
