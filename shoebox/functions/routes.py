"""Hash routes: views of the library as ``#/page/...``, built from columns and read back from text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The segment of each page, what a review group and a section of the settings may be called, the segments before a cluster and a group, and the largest whole number of a route.
PAGES = {"people": "bilder", "renaming": "dateinamen", "review": "gesichter-pruefen", "settings": "einstellungen"}
GROUPS = ("unassigned", "unknown_person", "not_face")
SECTIONS = ("erkennung", "dateinamen", "darstellung", "updates", "daten")
CLUSTER, GROUP = "gruppe", "kategorie"
LARGEST = 2**53 - 1


def route(page: Column, cluster_id: Column, group_key: Column, section: Column) -> Column:
    """The route of a view. A cluster comes before a group, and both count on the review page alone, a section on the settings page; an unknown page has no route."""
    base = reduce(lambda a, p: a.when(page == p[0], f"#/{p[1]}"), list(PAGES.items())[1:], F.when(page == "people", f"#/{PAGES['people']}"))
    more = (
        F.when((page == "review") & cluster_id.isNotNull(), F.concat(F.lit(f"/{CLUSTER}/"), cluster_id.cast("string")))
        .when((page == "review") & group_key.isNotNull(), F.concat(F.lit(f"/{GROUP}/"), group_key)).when((page == "settings") & section.isNotNull(), F.concat(F.lit("/"), section))
    )
    return F.concat(base, F.coalesce(more, F.lit("")))


def view_of(text: Column) -> Column:
    """struct<page, cluster_id, group_key, section> of a route; a null or unknown one is the page of people, and parts that say nothing known are left out.

    A cluster's number is what digits its segment begins with, after blanks and a plus sign.
    """
    parts = F.filter(F.split(F.regexp_replace(F.coalesce(text, F.lit("")), r"^#/?", ""), "/"), lambda s: s != "")
    first, second, third = (F.get(parts, F.lit(i)) for i in range(3))
    page = F.coalesce(reduce(lambda a, p: a.when(first == p[1], p[0]), list(PAGES.items())[1:], F.when(first == PAGES["people"], "people")), F.lit("people"))
    number = F.regexp_extract(third, r"^\s*\+?(\d+)", 1).try_cast("bigint")
    known = first == PAGES["review"]
    return F.struct(
        page.alias("page"), F.when(known & (second == CLUSTER) & number.between(1, LARGEST), number).alias("cluster_id"),
        F.when(known & (second == GROUP) & third.isin(*GROUPS), third).alias("group_key"), F.when((first == PAGES["settings"]) & second.isin(*SECTIONS), second).alias("section"),
    )
