"""Row types shared by sources and operators."""

from __future__ import annotations

#: A posting as any source gives it; parsers and importers all produce these columns.
POSTING = (
    "source string, source_id string, url string, title string, company_name string, company_name_source string, company_name_confidence double, "
    "company_identifiers array<struct<kind:string,value:string,source:string,confidence:double>>, company_website_candidates array<struct<url:string,source:string,confidence:double>>, "
    "city string, description string, published_at string, refreshed_at string"
)
POSTING_COLUMNS = [c.split()[0] for c in POSTING.replace("array<struct<kind:string,value:string,source:string,confidence:double>>", "x").replace("array<struct<url:string,source:string,confidence:double>>", "x").split(", ")]
#: A fetched page or response as a connector records it.
PAYLOAD = "source string, url string, body string, fetched_at timestamp"
