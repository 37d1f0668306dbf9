"""Schemas of the candidate record and of the search interfaces' payloads."""

from __future__ import annotations

from paperloom.rules import CANDIDATE_COLUMNS, JSON_ONLY_COLUMNS

_INT = {"year", "country_score", "workplace_organization_score", "category_score", "exclusion_medical_score"}
CANDIDATE = ", ".join(f"{c} {'int' if c in _INT else 'boolean' if c == 'is_oa' else 'string'}" for c in CANDIDATE_COLUMNS + JSON_ONLY_COLUMNS)

_PART = "struct<`date-parts`:array<array<int>>>"
WORK = (
    "id string, doi string, title string, display_name string, publication_year int, authorships array<struct<author:struct<display_name:string>>>, "
    "primary_location struct<landing_page_url:string, source:struct<display_name:string>>, best_oa_location struct<pdf_url:string, version:string, license:string>, "
    "open_access struct<is_oa:boolean, oa_status:string>, abstract_inverted_index map<string, array<int>>"
)
ITEM = f"title array<string>, author array<struct<given:string, family:string>>, `container-title` array<string>, DOI string, URL string, abstract string, `published-print` {_PART}, `published-online` {_PART}, issued {_PART}, created {_PART}"
PAPER = "paperId string, title string, abstract string, year int, authors array<struct<name:string>>, venue string, externalIds struct<DOI:string>, openAccessPdf struct<url:string>, isOpenAccess boolean"
LOOKUP = "doi string, is_oa boolean, oa_status string, best_oa_location struct<url_for_pdf:string, license:string, host_type:string>"
