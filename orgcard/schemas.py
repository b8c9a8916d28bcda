"""Schemas of the tables that the jobs read and write."""

PAGES = "page_id bigint, url string, html string, fetched_at timestamp"
COMPANIES = "company_id bigint, company_name string"
SERP = "query string, engine_ord int, rank int, url string"
CONTACTS = (
    "company_id bigint, company_name string, website string, email string, phone string, status string"
)
RAW_CANDIDATE = (
    "struct<method_ord:int,stage:int,chunk_ord:int,kind:string,source_class:string,"
    "always:boolean,raw:string>"
)
