"""Page analytics on Spark: captured web pages in, structured tables out."""

from pageloom.operators.images import image_candidates, image_contents, image_store, judged_images
from pageloom.operators.inspect import inspect_pages, suggest_selectors
from pageloom.operators.leads import page_leads, site_leads
from pageloom.operators.lists import extract_items
from pageloom.operators.pages import page_summary
from pageloom.operators.paginate import extract_list
from pageloom.sources.export import export, export_dataset

__all__ = [
    "export",
    "export_dataset",
    "extract_items",
    "extract_list",
    "image_candidates",
    "image_contents",
    "image_store",
    "inspect_pages",
    "judged_images",
    "page_leads",
    "page_summary",
    "site_leads",
    "suggest_selectors",
]
