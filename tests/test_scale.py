"""Plans that must hold at any size."""

import fixture_pages as fx
import pytest

from pageloom.operators import dom, images, inspect, leads, lists, pages, paginate, select


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("pages") / "p")
    fx.pages_df(spark).write.parquet(folder)
    return spark.read.parquet(folder)


PER_PAGE = {
    "summary": pages.page_summary,
    "links": pages.page_links,
    "scoped": lambda p: pages.page_summary(p, selector="article"),
    "nodes": dom.nodes,
    "selector": lambda p: select.selector_match(p, "table tbody tr"),
    "leads": leads.page_leads,
    "contact_edges": leads.contact_edges,
    "items": lambda p: lists.extract_items(p, "table tbody tr"),
    "fields": lambda p: lists.extract_items(p, ".x", {"a": {"selector": "b > i"}}),
    "detect": lists.detect_selectors,
    "next": paginate.next_links,
    "images": images.image_candidates,
    "suggestions": inspect.suggest_selectors,
}


@pytest.mark.parametrize("name", list(PER_PAGE))
def test_per_page_work_never_shuffles(stored, name):
    text = plan(PER_PAGE[name](stored))
    for node in ("Exchange", "Window", "Join", "Sort"):
        assert node not in text, node


def test_text_only_reads_its_columns(stored):
    text = plan(pages.page_texts(stored))
    assert "ReadSchema: struct<page_id:bigint,html:string>" in text
    assert "MapInArrow" not in text and "Python" not in text


def test_no_nested_loops_across_pages(spark, stored):
    found = paginate.extract_list(fx.target_df(spark, "/urunler?page=1"), stored, max_pages=3)
    for df in (found.items, found.summary, leads.site_leads(fx.target_df(spark), stored, 2)):
        text = plan(df)
        assert "NestedLoop" not in text and "Cartesian" not in text
        for line in text.splitlines():
            assert "SinglePartition" not in line


def test_hot_values_are_combined_before_the_shuffle(spark):
    """One record copied many times reaches the shuffle once per task."""
    rows = spark.range(0, 200_000, 1, 8).selectExpr(
        "1L AS target_id", "CAST(id % 7 AS INT) AS page_idx", "CAST(id AS INT) AS item_idx", "IF(id % 3 = 0, 'x', 'y') AS title"
    )
    text = plan(lists.distinct_items(rows))
    best = lists.distinct_items(rows)
    assert sorted((r.title, r.page_idx, r.item_idx) for r in best.collect()) == [("x", 0, 0), ("y", 0, 7)]
    assert text.count("Aggregate(") == 2 and text.count("Exchange") == 1
